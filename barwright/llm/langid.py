"""Language identification with a linear-chain conditional random field (operator 6).

A line is a chain of words. A word's features are its affixes, its character n-grams (hashed) and its
membership in a lexicon of each language's frequent words; the chain adds learned transitions.
Forward-backward gives each word's label probabilities, so a text that switches between languages is
labelled word by word; a document takes the language with the largest share of its words.

Training uses a bounded sample: `per_lang` rows of each language (the least hashes of their ids, equal
rows once), whole texts, joined into chains of which some switch language; lines of more than
`PIECE` words are trained in pieces. Every language that such rows name is learned; beyond
`FULL_LANGS` of them, with fewer rows and hash buckets of each, so that the weights stay bounded
(`FEATURES * FULL_LANGS` numbers, or `LEAST_FEATURES` for each language).

A word is known when most of its features occurred in training. `keep_identified` rejects texts
without letters and texts of which too few words are known: they are in none of the learned languages.

Defined results
    null text, no letter    lang_pred 'und', score 0. Letters are Unicode's; numerals, symbols and
                            marks are none.
    null lang, null doc_id  never learned from; predicted like any other.
    repeated rows           the same prediction for each.
    ties                    the first language in alphabetical order.
    empty table             no rows; with no labelled row at all, every prediction is 'und'.
    other columns           ignored by `identify` and `label_runs`, carried by `keep_identified`.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwright.llm.common import pieces

#: Hash buckets of affixes and n-grams.
FEATURES = 1 << 16
#: Words of each language in the lexicon.
LEXICON = 400
#: Rows of each language in the training sample, and the languages up to which each has as many.
PER_LANG, FULL_LANGS = 120, 64
#: Hash buckets at least, where there are very many languages.
LEAST_FEATURES = 1 << 12
#: Words of a chain in training.
PIECE = 400
#: Words times languages whose probabilities training holds at a time.
CELLS = 8_000_000
#: Characters labelled at a time, and words whose scores a worker remembers.
CHUNK, REMEMBERED = 800_000, 200_000
#: Longer words go through the features in a block of their own.
WIDE = 32
#: Share of a word's features that must occur in training to call it known; share of a text's words
#: that must be known to keep it.
KNOWN, LEAST_KNOWN = 0.6, 0.25

#: By code point: what Python counts as a word character but is a numeral, not a letter; taken as a digit.
_NUMERAL = np.zeros(sys.maxunicode + 1, bool)
_NUMERAL[[c for c in range(0x80, sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]] = True
#: Words, and line ends. Letters next to digits or within addresses are no words ...
_TOKEN = re.compile(r"(?<![\w@.])[^\W\d_]+(?![\w@])|\n")
#: ... unless a text has no others.
_LETTERS = re.compile(r"[^\W\d_]+|\n")


def _plain(low: str) -> str:
    """The text, of the same length, with digits for numerals."""
    if low.isascii():
        return low
    codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    at = _NUMERAL[codes]
    return np.where(at, np.uint32(ord("0")), codes).tobytes().decode("utf-32-le") if at.any() else low


def lines(text: str) -> list[list[str]]:
    """Lower-cased words of each line that has any."""
    low = _plain(text.lower())
    return _split(_TOKEN.findall(low)) or _split(_LETTERS.findall(low))


def _split(found: list[str]) -> list[list[str]]:
    out, now = [], []
    for w in found:
        if w == "\n":
            if now:
                out.append(now)
                now = []
        else:
            now.append(w)
    if now:
        out.append(now)
    return out


def _bucket(*parts: np.ndarray, kind: int, among: int) -> np.ndarray:
    h = np.full(parts[0].shape, 0x9E3779B97F4A7C15 * (kind + 1) % 2**64, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(among)).astype(np.int64)


def features(words: list[str], among: int = FEATURES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a word, bucket): affixes of 1 to 3 characters, bigrams and trigrams with word ends."""
    for wide in (False, True):
        at = np.array([i for i, w in enumerate(words) if (len(w) > WIDE) == wide], np.int64)
        for block in np.array_split(at, max(1, len(at) // 64)) if wide else [at]:
            if len(block) == 0:
                continue
            own = [words[i] for i in block]
            n = np.array([len(w) for w in own])
            width = int(n.max())
            ch = np.array(own, dtype=f"U{width}").view(np.uint32).reshape(len(own), width)
            pad = np.zeros((len(own), width + 3), np.uint32)
            pad[:, 1 : width + 1] = ch
            pad[:, 0] = 1
            pad[np.arange(len(own)), n + 1] = 2
            for k in (1, 2, 3):
                ok = n >= k
                if ok.any():
                    r = np.flatnonzero(ok)
                    yield block[r], _bucket(*[pad[r, 1 + j] for j in range(k)], kind=k, among=among)
                    yield block[r], _bucket(*[pad[r, n[r] - k + 1 + j] for j in range(k)], kind=10 + k, among=among)
            for j in range(width + 1):
                r = np.flatnonzero(n >= j)
                if len(r):
                    yield block[r], _bucket(pad[r, j], pad[r, j + 1], kind=20, among=among)
                r = np.flatnonzero(n >= j + 1)
                if len(r):
                    yield block[r], _bucket(pad[r, j], pad[r, j + 1], pad[r, j + 2], kind=30, among=among)


def posteriors(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains that lie one after the other in scores (rows: words).

    start, move: exponentials of the start and transition weights. Returns each word's label
    probabilities and the expected number of each transition. All chains go step by step together."""
    order = np.argsort(-lengths, kind="stable")
    size, first = lengths[order], (np.cumsum(lengths) - lengths)[order]
    psi = np.exp(scores - scores.max(axis=1, keepdims=True))
    fwd, bwd = np.empty_like(psi), np.ones_like(psi)
    alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) + 1)]  # chains longer than t
    a = start * psi[first]
    for t in range(int(size[0])):
        at = first[: alive[t]] + t
        if t:
            a = (a[: alive[t]] @ move) * psi[at]
        a = a / a.sum(axis=1, keepdims=True)
        fwd[at] = a
    pairs = np.zeros_like(move)
    for t in range(int(size[0]) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = psi[at + 1] * bwd[at + 1]
        b = ahead @ move.T
        z = (fwd[at] * b).sum(axis=1, keepdims=True)
        pairs += move * (fwd[at].T @ (ahead / z))
        bwd[at] = b / b.sum(axis=1, keepdims=True)
    p = fwd * bwd
    return p / p.sum(axis=1, keepdims=True), pairs


@dataclass
class Crf:
    """Weights of a fitted model; scores are remembered word by word up to a bound."""

    langs: list[str]
    weights: np.ndarray
    seen: np.ndarray  # of each bucket, whether it occurred in training
    lexicon: dict[str, np.ndarray]
    lexicon_weights: np.ndarray
    start: np.ndarray
    move: np.ndarray
    _known: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def fresh(self) -> Crf:
        """The same weights with an empty memory, so that what a task remembers goes with it."""
        return Crf(self.langs, self.weights, self.seen, self.lexicon, self.lexicon_weights, self.start, self.move)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A score for each language, and last whether the word is known."""
        c = len(self.langs)
        out = np.zeros((len(words), c + 1), np.float32)
        every = np.zeros(len(words))
        for rows, buckets in features(words, len(self.weights)):
            out[rows, :c] += self.weights[buckets]
            out[rows, c] += self.seen[buckets]
            every[rows] += 1
        out[:, c] = out[:, c] >= KNOWN * every
        for i, w in enumerate(words):
            if (m := self.lexicon.get(w)) is not None:
                out[i, :c] += m @ self.lexicon_weights
                out[i, c] = 1
        return out

    def _rows(self, words: list[str]) -> np.ndarray:
        known = self._known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            fresh = list({w for w in words if w not in known})
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            self._scores, fresh = None, list(set(words))
        add = self.word_scores(fresh)
        base = len(known)
        self._scores = add if self._scores is None else np.vstack([self._scores, add])
        known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def label(self, chains: list[list[str]]) -> np.ndarray:
        """Label probabilities of all words of the chains, in order; last, whether they are known."""
        flat = [w for c in chains for w in c]
        scores = self._scores_of(flat)
        p = posteriors(scores[:, :-1].astype(np.float64), np.array([len(c) for c in chains]), np.exp(self.start), np.exp(self.move))[0]
        return np.hstack([p, scores[:, -1:]])

    def _scores_of(self, words: list[str]) -> np.ndarray:
        at = self._rows(words)
        return self._scores[at]

    def predict(self, texts: list[str]) -> list[Prediction]:
        out: list[Prediction] = []
        c, i = len(self.langs), 0
        while i < len(texts):
            chains, words, n = [], [], 0
            j = i
            while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK):
                own = lines(texts[j])
                chains += own
                words.append(sum(map(len, own)))
                n += len(texts[j])
                j += 1
            if c and chains:
                p = self.label(chains)
                best = np.zeros((len(p) + 1, c), np.int64)
                best[np.arange(1, len(p) + 1), p[:, :c].argmax(axis=1)] = 1
                counts, total = np.cumsum(best, axis=0), np.vstack([np.zeros(c + 1), np.cumsum(p, axis=0)])
                for e, k in zip(np.cumsum(words), words, strict=True):
                    if k:
                        share = (total[e] - total[e - k]) / k
                        top = int(share[:c].argmax())
                        own = counts[e] - counts[e - k]
                        order = sorted(np.flatnonzero(own).tolist(), key=lambda x: (-own[x], x))
                        out.append(Prediction(self.langs[top], float(min(1.0, max(0.0, share[top]))), float(share[c]), [(self.langs[x], int(own[x])) for x in order]))
                    else:
                        out.append(UND)
            else:
                out += [UND] * (j - i)
            i = j
        return out

    def runs(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, language, words) of each run of words with one most probable label, code points."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        low = _plain(low)
        pattern = _TOKEN if any(m[0] != "\n" for m in _TOKEN.finditer(low)) else _LETTERS
        chains: list[list[re.Match]] = [[]]
        for m in pattern.finditer(low):
            if m[0] == "\n":
                chains.append([])
            else:
                chains[-1].append(m)
        chains = [c for c in chains if c]
        if not chains or not self.langs:
            return []
        best = self.label([[m[0] for m in c] for c in chains])[:, :-1].argmax(axis=1).tolist()
        out: list[tuple[int, int, str, int]] = []
        for m, y in zip((m for c in chains for m in c), best, strict=True):
            if out and out[-1][2] == self.langs[y]:
                out[-1] = (out[-1][0], m.end(), out[-1][2], out[-1][3] + 1)
            else:
                out.append((m.start(), m.end(), self.langs[y], 1))
        return out


@dataclass
class Prediction:
    """Language with the largest share of the words, that share, the share of known words, and the
    number of words by their most probable label, most first."""

    lang: str
    score: float
    known: float
    words: list[tuple[str, int]]


UND = Prediction("und", 0.0, 0.0, [])


def _blocks(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of chains with at most so many words each, or one chain."""
    out, lo, n = [], 0, 0
    for i, k in enumerate(lengths.tolist()):
        if n and n + k > most:
            out.append((lo, i))
            lo, n = i, 0
        n += k
    return [*out, (lo, len(lengths))]


def train(sample: list[tuple[str, str]], rounds: int = 40, rate: float = 0.15, decay: float = 1e-4, switch: float = 0.25, seed: int = 5) -> Crf:
    """Fit a field on (lang, text) rows by gradient ascent on the chains' likelihood (Adam)."""
    langs = sorted({lang for lang, _ in sample})
    c = len(langs)
    among = max(LEAST_FEATURES, min(FEATURES, FEATURES * FULL_LANGS // max(c, 1)))
    number = {lang: i for i, lang in enumerate(langs)}
    own = [(number[lang], line[k : k + PIECE]) for lang, text in sample for line in lines(text) for k in range(0, len(line), PIECE)]
    if not own:
        return Crf([], np.zeros((among, 0)), np.zeros(among, bool), {}, np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    chains, labels = [], []
    for y, line in own:
        if c > 1 and rng.random() < switch:  # a chain that goes on in another document's language
            y2, other = own[rng.integers(len(own))]
            cut1, cut2 = rng.integers(1, len(line) + 1), rng.integers(0, len(other))
            chains.append(line[:cut1] + other[cut2:])
            labels.append([y] * int(cut1) + [y2] * (len(other) - int(cut2)))
        else:
            chains.append(line)
            labels.append([y] * len(line))
    counts = [Counter() for _ in langs]
    for y, line in own:
        counts[y].update(line)
    lexicon: dict[str, np.ndarray] = {}
    for y, k in enumerate(counts):
        for w, _ in sorted(k.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, np.zeros(c, np.float32))[y] = 1
    words = sorted({w for ch in chains for w in ch})
    index = {w: i for i, w in enumerate(words)}
    flat = np.array([index[w] for ch in chains for w in ch])
    truth = np.array([y for ys in labels for y in ys])
    lengths = np.array([len(ch) for ch in chains])
    parts = list(features(words, among))
    row, col = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    lex = np.array([lexicon.get(w, np.zeros(c)) for w in words])
    firsts = np.cumsum(lengths) - lengths
    inner = np.ones(len(flat), bool)
    inner[firsts] = False
    seen_moves = np.zeros((c, c))
    np.add.at(seen_moves, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
    edges = _blocks(lengths, CELLS // c)
    params = [np.zeros((among, c)), np.zeros((c, c)), np.zeros(c), np.zeros((c, c))]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        w, lw, start, move = params
        per_word = lex @ lw
        for k in range(c):
            per_word[:, k] += np.bincount(row, weights=w[col, k], minlength=len(words))
        by_word, starts, moves = np.zeros((len(words), c)), np.zeros(c), np.zeros((c, c))
        for lo, hi in edges:
            at = slice(firsts[lo], firsts[hi - 1] + lengths[hi - 1])
            p, pairs = posteriors(per_word[flat[at]], lengths[lo:hi], np.exp(start), np.exp(move))
            miss = np.eye(c)[truth[at]] - p
            by_word += np.stack([np.bincount(flat[at], weights=miss[:, k], minlength=len(words)) for k in range(c)], axis=1)
            starts += miss[firsts[lo:hi] - firsts[lo]].sum(axis=0)
            moves += pairs
        grads = [
            np.stack([np.bincount(col, weights=by_word[row, k], minlength=among) for k in range(c)], axis=1),
            lex.T @ by_word, starts, seen_moves - moves,
        ]
        for i, g in enumerate(grads):
            g = g / len(flat) - decay * params[i]
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g * g
            params[i] = params[i] + rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-8)
    return Crf(langs, params[0].astype(np.float32), np.bincount(col, minlength=among) > 0, lexicon, params[1].astype(np.float32), params[2], params[3])


def _crc(col: str):
    return F.crc32(F.col(col).cast("string").cast("binary"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Crf:
    """Train on at most `per_lang` rows of each language, of those whose crc32(id) mod 4 is not 2. One scan
    picks them (tasks keep the least `per_lang` of each language before the shuffle), one fetches their
    texts; what comes to the driver is bounded by `per_lang` times the languages, or `FULL_LANGS`."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null").filter(_crc("id") % 4 != 2)
    rows = rows.withColumn("h", F.xxhash64("text"))
    first = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "h")
    # one task a language gets at most per_lang rows from each task of the scan
    picked = rows.select("id", "lang", "h").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_lang)
    keys = sorted({(r.lang, r.n, r.id, r.h) for r in picked.collect()})
    langs = len({k[0] for k in keys})
    if not langs:
        return train([])
    each = min(per_lang, max(1, per_lang * FULL_LANGS // langs))
    chosen = {(i, lang, h) for lang, n, i, h in keys if n <= each}
    ids = docs.sparkSession.createDataFrame(sorted(chosen), "id long, lang string, h long")
    got = rows.join(F.broadcast(ids), ["id", "lang", "h"]).select("lang", "id", "text").distinct().orderBy("id", "lang", "text")
    return train([(r.lang, r.text) for r in got.collect()])


def _predicted(m: Crf, texts: pa.Array) -> list[Prediction]:
    return m.predict([t or "" for t in texts.to_pylist()])


_WORDS = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, known (share of known words) and word_langs (number of words by
    most probable label) of each row; one pass, no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value.fresh()
        for b in pieces(batches):
            got = _predicted(m, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.lang for x in got], pa.string()), pa.array([x.score for x in got], pa.float64()), pa.array([x.known for x in got], pa.float64()),
                                              pa.array([[{"lang": k, "words": n} for k, n in x.words] for x in got], _WORDS)], names=["doc_id", "held_out", "lang_pred", "score", "known", "word_langs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", F.coalesce(_crc("doc_id") % 4 == 2, F.lit(True)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, known double, word_langs array<struct<lang:string,words:long>>")


def label_runs(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, lang, words of every run of words with one label; code points, end exclusive.
    No row for a text without letters."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value.fresh()
        for b in pieces(batches):
            got = [(d, *r) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for r in m.runs(t)]
            columns = list(zip(*got, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "start", "end", "lang", "words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, end long, lang string, words long")


def keep_identified(docs: DataFrame, model: Crf, least_known: float = LEAST_KNOWN, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has an identified language: some letters, and a share
    of known words of at least least_known."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value.fresh()
        for b in pieces(batches):
            got = _predicted(m, b.column(at))
            yield b.filter(pa.array([x.lang != "und" and x.known >= least_known for x in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
