"""Benchmark decontamination by greedy string tiling (operator 8).

Documents and benchmark items are cut into lower-cased words. Runs of `seed` shared words (hashed,
then compared word by word) point to the documents and items worth tiling, and to the stretches of
the document that can hold a match at all. Greedy string tiling then takes the longest matches that
don't overlap, found by running Karp-Rabin; matches may stand in any order, so reordered passages are
caught. A document is contaminated by an item when tiles cover at least `coverage` of its words.

The benchmark is a set of queries against all rows: its index is sent to every worker. A benchmark of
more than `BLOCK_WORDS` words goes in blocks of about so many, one pass over the rows for each, whose
findings (one row for a text and block that share a seed) are put together by the text's hash. No rows
are joined on seeds, so a phrase that very many texts and items hold costs what any other does. Verdicts
are a matter of the text alone; the result is the same in any number of blocks.

Defined results
    null or empty text      no match. An item without words matches nothing.
    items under `seed` words their whole sequence is the seed.
    ties                    the item with the highest coverage, then the least item_id, is named.
    repeated rows           each row has its own result; repeated items count once.
    null ids                passed through; a null item_id is never named or listed but does contaminate.
    empty tables            no documents: no rows; no items: nothing is contaminated.
    other columns           ignored by `find_contamination`, carried by `decontaminate`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import cut, pieces

SEED, COVERAGE = 5, 0.5
#: Words of the benchmark whose seeds are sent to every worker at a time (about 100 bytes each).
BLOCK_WORDS = 1_000_000
#: Tilings remembered in one worker.
REMEMBERED = 20_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


# ---- greedy string tiling ------------------------------------------------------------------------

_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _rolling(seq: list, marked: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of every unmarked stretch of the given size."""
    top = pow(_BASE, size - 1, _MOD)
    h, run = 0, 0
    for i, x in enumerate(seq):
        if marked[i]:
            h = run = 0
            continue
        if run >= size:
            h = (h - hash(seq[i - size]) * top) % _MOD
        h = (h * _BASE + hash(x)) % _MOD
        run += 1
        if run >= size:
            yield i - size + 1, h


def _matches(a: list, b: list, ma: bytearray, mb: bytearray, size: int) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal unmarked matches (length, start in a, start in b) of at least `size`, and the longest."""
    table = defaultdict(list)
    for j, h in _rolling(b, mb, size):
        table[h].append(j)
    found, longest = [], 0
    for i, h in _rolling(a, ma, size):
        for j in table.get(h, ()):
            if i and j and not ma[i - 1] and not mb[j - 1] and a[i - 1] == b[j - 1]:
                continue  # part of a match that starts before
            k = 0
            while i + k < len(a) and j + k < len(b) and not ma[i + k] and not mb[j + k] and a[i + k] == b[j + k]:
                k += 1
            if k >= size:
                found.append((k, i, j))
                longest = max(longest, k)
    return found, longest


def tile(a: list, b: list, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length) of the tiles, longest first."""
    ma, mb, tiles = bytearray(len(a)), bytearray(len(b)), []
    size = max(least, min(len(a), len(b), 64))
    while len(a) >= least and len(b) >= least:
        found, longest = _matches(a, b, ma, mb, size)
        if longest > 2 * size:
            size = longest
            continue
        for k, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if not any(ma[i : i + k]) and not any(mb[j : j + k]):
                ma[i : i + k] = mb[j : j + k] = b"\x01" * k
                tiles.append((i, j, k))
        # what a longer tile has cut short may still hold a match of this size
        if any(k > size for k, _, _ in found) and _matches(a, b, ma, mb, size)[0]:
            continue
        if size == least:
            break
        size = max(least, size // 2)
    return tiles


def coverage(doc: list, item: list, seed: int = SEED) -> float:
    """Share of the item's words that tiles of at least `seed` words (the item, if shorter) cover."""
    return sum(k for _, _, k in tile(doc, item, min(seed, len(item)))) / len(item) if item else 0.0


# ---- seeds -----------------------------------------------------------------------------------------


class Index:
    """Benchmark items by their seeds; words are numbered, others than the benchmark's are -1."""

    def __init__(self, items: list[tuple[int | None, str]], seed: int):
        self.seed = seed
        self.items = sorted({(i, tuple(words(t))) for i, t in items if words(t)}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.vocab: dict[str, int] = {}
        self.coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in seq] for _, seq in self.items]
        self.by_size: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        for n, seq in enumerate(self.coded):
            k = min(seed, len(seq))
            for j in range(len(seq) - k + 1):
                if not (at := self.by_size[k][tuple(seq[j : j + k])]) or at[-1] != n:
                    at.append(n)
        self.by_size = {k: dict(v) for k, v in self.by_size.items()}
        self.hashes = {k: np.unique(self._hash(np.array(list(v), np.int64))) for k, v in self.by_size.items()}
        self.memory: dict[tuple, float] = {}

    @property
    def n_seeds(self) -> int:
        return sum(map(len, self.by_size.values()))

    @staticmethod
    def _hash(grams: np.ndarray) -> np.ndarray:
        h = np.zeros(grams.shape[0], np.uint64)
        for k in range(grams.shape[1]):
            h = (h ^ grams[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, coded: np.ndarray) -> dict[int, set[int]]:
        """item number -> positions of the document's words that lie in one of its seeds."""
        out: dict[int, set[int]] = defaultdict(set)
        for k, table in self.by_size.items():
            if len(coded) < k:
                continue
            grams = np.lib.stride_tricks.sliding_window_view(coded, k)
            inside = np.flatnonzero((grams >= 0).all(axis=1))
            if not len(inside):
                continue
            h = self._hash(grams[inside])
            at = np.searchsorted(self.hashes[k], h)
            at[at == len(self.hashes[k])] = 0
            for p in inside[self.hashes[k][at] == h].tolist():
                for n in table.get(tuple(coded[p : p + k].tolist()), ()):
                    out[n].update(range(p, p + k))
        return out

    def covered(self, seq: list[int], positions: set[int], n: int) -> float:
        """Coverage of item n; stretches of the document without a seed can't hold a tile and are left out."""
        parts, last = [], None
        for p in sorted(positions):
            if last is not None and p != last + 1:
                parts.append(-2 - len(parts))  # a word that no item has
            parts.append(seq[p])
            last = p
        key = (n, tuple(parts))
        if (got := self.memory.get(key)) is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            got = self.memory[key] = coverage(parts, self.coded[n], self.seed)
        return got

    def best(self, text: str | None, least: float) -> tuple[float, int | None, list[int]]:
        """Highest coverage, its item's id, and the ids of all items covered by at least `least`."""
        get = self.vocab.get
        seq = [get(w, -1) for w in words(text)]
        if not seq:
            return 0.0, None, []
        top, name, over = 0.0, None, []
        for n, positions in sorted(self.hits(np.array(seq, np.int64)).items()):
            c = self.covered(seq, positions, n)
            if c > top:
                top, name = c, self.items[n][0]
            if c >= least and self.items[n][0] is not None:
                over.append(self.items[n][0])
        return top, name, over


def _blocks(items: DataFrame, seed: int, limit: int, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of the benchmark in blocks of about `limit` words, counted by the class that Python's \\w
    stands for; always one at least. A block is collected when it is asked for."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    n = rows.select(F.sum(F.size(F.split(F.lower("t"), r"[^\p{L}\p{N}_]+"))).alias("n")).first().n or 0
    many = max(1, -(-n // limit))
    for k in range(many):
        part = rows if many == 1 else rows.filter(F.pmod(F.xxhash64("t", "i"), F.lit(many)) == k)
        yield Index([(r.i, r.t) for r in part.collect()], seed)


def _shipped(docs: DataFrame, index: Index):
    return docs.sparkSession.sparkContext.broadcast(([(i, " ".join(s)) for i, s in index.items], index.seed))


_BUILT: dict[int, tuple[tuple, Index]] = {}


def _built(value: tuple) -> Index:
    """The index of a broadcast value, made once in a worker, not in every task."""
    got = _BUILT.get(id(value))
    if got is None or got[0] is not value:
        _BUILT.clear()
        got = _BUILT[id(value)] = (value, Index(*value))
    return got[1]


def _text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def _found(docs: DataFrame, index: Index, least: float, text: str) -> DataFrame:
    """doc_key (hash of the text) and what this block of the benchmark says, of texts that share a seed
    with it; repeated texts have repeated rows."""
    shipped = _shipped(docs, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _built(shipped.value)
        for b in pieces(batches):
            got = [(k, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and (x := own.best(t, least))[0] > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in got], pa.string()), pa.array([x[2] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[3] for x in got], pa.list_(pa.int64()))],
                names=["doc_key", "best_item", "coverage", "items"])

    return docs.select(_text_key(F.col(text)).alias("doc_key"), F.col(text).alias("text")).mapInArrow(run, "doc_key string, best_item long, coverage double, items array<long>")


def _together(docs: DataFrame, blocks: Iterator[Index], least: float, text: str) -> DataFrame:
    """doc_key, best_item, coverage, items, contaminated of each distinct text that shares a seed with
    the benchmark."""
    found = None
    for k, index in enumerate(blocks):
        # equal texts are one row before anything is written
        one = cut(_found(docs, index, least, text).groupBy("doc_key").agg(F.first("best_item").alias("best_item"), F.first("coverage").alias("coverage"), F.first("items").alias("items")), f"bench-block-{k}")
        found = one if found is None else found.unionAll(one)
    best = found.groupBy("doc_key").agg(F.max_by("best_item", F.struct("coverage", -F.col("best_item"))).alias("best_item"), F.max("coverage").alias("coverage"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    return cut(best.withColumn("contaminated", F.col("coverage") >= least), "bench-best")


def find_contamination(docs: DataFrame, items: DataFrame, seed: int = SEED, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, best_item, coverage, items (all over the threshold),
    contaminated."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _blocks(items, seed, block_words, item_id, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is not None:
        best = _together(rows, chain([first, second], blocks), least, "text")
        out = rows.select("doc_id", _text_key(F.col("text")).alias("_key")).join(best.hint("merge"), F.col("_key") == F.col("doc_key"), "left")
        return out.select("doc_id", "best_item", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))
    shipped = _shipped(docs, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _built(shipped.value)
        for b in pieces(batches):
            got = [own.best(t, least) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[1] for x in got], pa.int64()), pa.array([x[0] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.list_(pa.int64())), pa.array([x[0] >= least for x in got], pa.bool_())],
                names=["doc_id", "best_item", "coverage", "items", "contaminated"])

    return rows.mapInArrow(run, "doc_id long, best_item long, coverage double, items array<long>, contaminated boolean")


def decontaminate(docs: DataFrame, items: DataFrame, seed: int = SEED, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns: row by row, or, for a benchmark
    of several blocks, by an anti-join on the text's hash."""
    blocks = _blocks(items, seed, block_words, item_id, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _without(docs, first, least, text_col)
    bad = _together(docs, chain([first, second], blocks), least, text_col).filter("contaminated").select("doc_key")
    return docs.join(bad.hint("merge"), _text_key(docs[text_col]) == bad["doc_key"], "left_anti")


def _without(docs: DataFrame, index: Index, least: float, text_col: str) -> DataFrame:
    shipped, at = _shipped(docs, index), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _built(shipped.value)
        for b in pieces(batches):
            yield b.filter(pa.array([own.best(t, least)[0] < least for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
