"""Near-duplicate groups by an LSH forest over MinHash signatures (operator 4).

1. Rows with the same shingle set form a class; all else works on classes.
2. A signature is cut into orders of `DEPTH` values. Their number and the base depth follow the
   threshold (`forest_shape`): a pair at the threshold shares a prefix of the base depth in at least
   one order with probability 0.99999. All (order, values, class) rows are range-sorted together, so a
   region with very many equal prefixes spreads over tasks like any other.
3. In sorted order, neighbours by longest common prefix are candidates: a class takes the region of
   the least depth (from the base depth on) that has at most `REGION` members, and always the next
   class in the order. Neighbours across the edge of two partitions are found in the same way among
   the few rows at the edges.
4. Candidates are confirmed on the full sets, the best of each class first; links are contracted to
   components, and only candidates between different components go on.
5. For the rest: members of regions with more than `REGION` members at base depth that still hold
   several components. A class of which too few shingles occur in any other component can have no link
   left and goes (`_survivors`); this rids regions of what only shares boilerplate. The others are
   compared on full sets region by region, a region in one block or, beyond a bound, in blocks of
   its largest component against its others, and those against each other. Blocks count common
   shingles, and only the links that join components are given out.

Defined results
    null or empty text, no word   n_shingles 0, linked with nothing: component_id = doc_id, kept.
    fewer words than a shingle    the whole sequence is the one shingle.
    null doc_id                   takes part; component_id is the least id that isn't null, or null.
    repeated rows                 the same class; each gets the same component.
    empty table                   no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import cut, discard, pieces
from barwright.llm.components import components
from barwright.llm.shingles import WordHashes, minhash, multipliers, shingle_set, similar

#: Values of an order; members up to which a region is covered by neighbours.
DEPTH, REGION = 8, 4
#: Chance to miss a pair at the threshold, greatest base depth, most orders.
MISS, DEEPEST, MOST_TREES = 1e-5, 6, 48
#: Bits of the filter that spares most texts the way to the confirmation; fixed size, exact join behind.
FILTER_BITS = 1 << 23
#: Members and shingles of a block of a region; shingles in more members than that are counted by a
#: product of matrices, of so many columns at a time, others pair by pair.
BLOCK_ROWS, BLOCK_SHINGLES, COMMON, COLUMNS = 2048, 1_000_000, 24, 512
#: Rows of a table that go into one file where each carries a text or two.
TEXTS, PAIRS = 20_000, 5_000


def forest_shape(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(base depth, orders): the deepest base at which so many orders at most make a pair at the
    threshold share a prefix of that length somewhere with probability 1 - miss."""
    for base in range(DEEPEST, 0, -1):
        each = min(threshold, 1 - 1e-12) ** base
        trees = max(1, math.ceil(math.log(miss) / math.log1p(-each)))
        if trees <= MOST_TREES:
            return base, trees
    return 1, trees


def _signatures(docs: DataFrame, shingle: int, trees: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, by = WordHashes(), multipliers(trees * DEPTH)
        for b in pieces(batches):
            n, cls, sig = [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t, shingle, hashes)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                # 16 mixed bits of each value: two different ones seldom look alike, and what does is confirmed
                sig.append((minhash(s, by) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())],
                                             names=["doc_id", "row_key", "n_shingles", "cls", "sig"])

    return rows.mapInArrow(run, "doc_id long, row_key long, n_shingles long, cls binary, sig binary")


# ---- the forest ------------------------------------------------------------------------------------


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as rows of bytes."""
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * width].reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def _orders(rows: pa.RecordBatch) -> np.ndarray:
    """Number of the order, then its values, of each row."""
    values = np.ascontiguousarray(_matrix(rows.column("path"), 2 * DEPTH)).view(">u2").astype(np.int32)
    return np.hstack([rows.column("tree").to_numpy().astype(np.int32).reshape(-1, 1), values])


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix, row by row; the first column is the order's number."""
    return np.logical_and.accumulate(x == y, axis=1).sum(axis=1) - 1


def _neighbours(rows: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (i, j, common prefix) of consecutive rows of the order, and which rows lie in a
    region of more than REGION members at base depth or reach the first or last row."""
    n = len(rows)
    step = _shared(rows[1:], rows[:-1])
    depth, dense = np.full(n, DEPTH), np.zeros(n, bool)
    for d in range(DEPTH, base - 1, -1):
        run = np.concatenate([[0], np.cumsum(step < d)])  # the region of each row at this depth
        size = np.bincount(run)[run]
        depth = np.where(size <= REGION, d, depth)
        if d == base:
            dense = (size > REGION) | (run == run[0]) | (run == run[-1])
    found = []
    for j in range(1, min(REGION, n)):
        common = _shared(rows[j:], rows[:-j])
        near = common >= np.maximum(np.minimum(depth[j:], depth[:-j]), base) if j > 1 else common >= base
        at = np.flatnonzero(near)
        found.append((at, at + j, common[at]))
    i, j, c = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    return i, j, c, dense


_PAIR, _EDGE, _DENSE = 0, 1, 2
_FOREST = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("pos", pa.int32()), ("gap", pa.bool_()), ("tree", pa.int32()), ("path", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("common", pa.int32())])
_FOREST_DDL = "kind int, part int, pos int, gap boolean, tree int, path binary, a binary, b binary, common int"
#: Sorted rows looked at together in a task; the last REGION of them are seen again.
WINDOW = 50_000
#: Rows at the edges of partitions that one task looks at.
EDGE_ROWS = 200_000


def _out(n: int, kind: int, **columns) -> pa.RecordBatch:
    full = {"kind": pa.array(np.full(n, kind, np.int32))} | columns
    return pa.RecordBatch.from_arrays([full[f.name].cast(f.type) if f.name in full else pa.nulls(n, f.type) for f in _FOREST], schema=_FOREST)


def _pairs(cls: pa.Array, i: np.ndarray, j: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
    """Pairs with the lesser class first; the same class isn't its own partner."""
    key = np.ascontiguousarray(_matrix(cls, 16)).view(">u8").astype(np.uint64)
    x, y = key[i], key[j]
    less = (x[:, 0] < y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] <= y[:, 1]))
    lo, hi = np.where(less, i, j), np.where(less, j, i)
    return _out(len(i), _PAIR, a=cls.take(pa.array(lo)), b=cls.take(pa.array(hi)), common=pa.array(common.astype(np.int32)))


def _edges(part: int, head: pa.RecordBatch, tail: pa.RecordBatch, seen: int) -> pa.RecordBatch:
    """The first and last REGION rows of a partition of `seen` rows, each once."""
    if seen <= 2 * REGION:
        rows, gap = (head if seen <= REGION else pa.Table.from_batches([head, tail.slice(tail.num_rows - (seen - head.num_rows))]).combine_chunks().to_batches()[0]), -1
    else:
        rows, gap = pa.Table.from_batches([head, tail]).combine_chunks().to_batches()[0], head.num_rows
    at = np.arange(rows.num_rows)
    gaps = at == gap
    if "gap" in rows.schema.names:
        gaps |= rows.column("gap").to_numpy(zero_copy_only=False)
    return _out(len(at), _EDGE, part=pa.array(np.full(len(at), part, np.int32)), pos=pa.array(at.astype(np.int32)), gap=pa.array(gaps), tree=rows.column("tree"), path=rows.column("path"), a=rows.column("cls"))


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _forest(classes: DataFrame, base: int, trees: int) -> DataFrame:
    width = 2 * DEPTH
    rows = classes.select("cls", F.posexplode(F.array(*[F.col("sig").substr(1 + t * width, width) for t in range(trees)])).alias("tree", "path"))
    order = rows.repartitionByRange("tree", "path", "cls").sortWithinPartitions("tree", "path", "cls").select("tree", "path", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        head = tail = None
        seen = fresh = 0

        def work() -> Iterator[pa.RecordBatch]:
            rows = _one(held)
            orders = _orders(rows)
            i, j, c, dense = _neighbours(orders, base)
            new = j >= fresh  # a pair of two rows seen before was given out with the window before
            if new.any():
                yield _pairs(rows.column("cls"), i[new], j[new], c[new])
            if dense.any():
                at = pa.array(np.flatnonzero(dense))
                region = pa.array([p[: 2 * base] for p in rows.column("path").take(at).to_pylist()], pa.binary())
                yield _out(len(at), _DENSE, tree=rows.column("tree").take(at), path=region, a=rows.column("cls").take(at))

        for b in batches:
            if not b.num_rows:
                continue
            head = b.slice(0, REGION) if head is None else _one([head, b.slice(0, REGION - head.num_rows)]) if head.num_rows < REGION else head
            both = b if tail is None else _one([tail, b.slice(max(0, b.num_rows - REGION))])
            tail = both.slice(max(0, both.num_rows - REGION))
            seen += b.num_rows
            held.append(b)
            if sum(x.num_rows for x in held) >= WINDOW:
                yield from work()
                last = _one(held)
                held = [last.slice(max(0, last.num_rows - REGION))]
                fresh = held[0].num_rows
        if held and sum(x.num_rows for x in held) > fresh:
            yield from work()
        if seen:
            yield _edges(part, head, tail, seen)

    # read several times and not at all after that: kept on the executors' disks, made again where one is lost
    return order.mapInArrow(run, _FOREST_DDL).persist(StorageLevel.DISK_ONLY)


def _across(forest: DataFrame, base: int) -> DataFrame:
    """Candidates whose two rows lie in different partitions, from the rows at the edges of partitions:
    in one task while they are few, else spread over tasks, whose edges then are far fewer."""
    edges = forest.filter(F.col("kind") == _EDGE).select("part", "pos", "gap", "tree", "path", F.col("a").alias("cls"))
    tasks = -(-edges.count() // EDGE_ROWS)
    order = (edges.coalesce(1) if tasks <= 1 else edges.repartitionByRange(tasks, "part", "pos")).sortWithinPartitions("part", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if not (held := [b for b in batches if b.num_rows]):
            return
        rows = _one(held)
        orders, part = _orders(rows), rows.column("part").to_numpy()
        run = np.cumsum(rows.column("gap").to_numpy(zero_copy_only=False))
        for j in range(1, REGION):
            common = _shared(orders[j:], orders[:-j])
            at = np.flatnonzero((common >= base) & (run[j:] == run[:-j]) & (part[j:] != part[:-j]))
            if len(at):
                yield _pairs(rows.column("cls"), at, at + j, common[at])
        last = rows.slice(max(0, rows.num_rows - REGION))
        yield _edges(TaskContext.get().partitionId(), rows.slice(0, REGION), last, rows.num_rows)

    found = cut(order.mapInArrow(run, _FOREST_DDL), "forest-edges")
    pairs = found.filter(F.col("kind") == _PAIR).select("a", "b", "common")
    return pairs if tasks <= 1 else pairs.unionAll(_across(found, base))


# ---- confirmation ----------------------------------------------------------------------------------


def _texts(docs: DataFrame, nodes: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(cls, text) of the given classes. A bit filter of fixed size over row keys spares most texts the
    shuffle; the join behind it is exact."""
    spark = docs.sparkSession
    want = cut(classes.join(nodes.hint("merge"), "cls").select("cls", "rep.row_key", F.col("rep.doc_id").alias("rep_id")), "confirm-keys", rows=n)
    spot = F.pmod(F.col("row_key"), F.lit(FILTER_BITS)) + 1
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    # at most FILTER_BITS / 32768 rows of 4 KB
    for r in want.select(F.bitmap_bucket_number(spot).alias("k"), F.bitmap_bit_position(spot).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect():
        bits[(r.k - 1) * 4096 : r.k * 4096] |= np.frombuffer(bytes(r.m), np.uint8)
    shipped = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        at = np.mod(key.to_numpy(np.int64), FILTER_BITS)
        return pd.Series((shipped.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    rows = rows.filter(maybe("row_key"))
    got = rows.join(want.hint("merge"), (rows["row_key"] == want["row_key"]) & rows["id"].eqNullSafe(want["rep_id"])).select("cls", "text")
    out = cut(got.dropDuplicates(["cls"]), "confirm-texts", rows=n, per_file=TEXTS)
    discard(want)
    return out


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = pairs.select("a", "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
    both = left.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for r in pieces(batches):
            keep = [similar(shingle_set(x, shingle, hashes), shingle_set(y, shingle, hashes), num, den) for x, y in zip(r.column(2).to_pylist(), r.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.coalesce(max(1, -(-pairs.count() // PAIRS))).mapInArrow(run, "a binary, b binary"), "links")


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    ca, cb = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    out = pairs.join(ca.hint("merge"), "a", "left").withColumn("ca", F.coalesce("ca", "a"))
    out = out.join(cb.hint("merge"), "b", "left").withColumn("cb", F.coalesce("cb", "b"))
    return out.filter("ca <> cb")


# ---- large regions -----------------------------------------------------------------------------------


def _survivors(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of (cls, comp, n_shingles, shingles), the classes that can still have a link to another component:
    as den * intersection >= num * union, that many of their shingles must occur in other components."""
    n = sets.agg(F.sum("n_shingles").alias("n")).first().n
    each = sets.select("cls", "comp", F.explode("shingles").alias("h"))
    shared = cut(each.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h"), "rest-shared", rows=n)
    count = each.select("cls", "h").join(shared.hint("merge"), "h").groupBy("cls").agg(F.count(F.lit(1)).alias("shared"))
    out = sets.select("cls", "comp", "n_shingles").join(count.hint("merge"), "cls").filter(F.col("shared") * den >= F.col("n_shingles") * num)
    out = cut(out.select("cls", "comp", "n_shingles"), "rest-alive", rows=n)
    discard(shared)
    return out


def _joining(cls: list[bytes], comp: list[bytes], sets: list[np.ndarray], num: int, den: int) -> list[tuple[bytes, bytes]]:
    """Links that join the components of a bounded group: all pairs of different components are looked
    at, on full sets, but only the links that join two of them are given."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float32)
    common = count > COMMON
    rank = np.cumsum(common) - 1
    here = common[code]
    row, column = owner[here], rank[code[here]]
    for start in range(0, int(common.sum()), COLUMNS):
        at = (column >= start) & (column < start + COLUMNS)
        m = np.zeros((n, COLUMNS), np.float32)
        m[row[at], column[at] - start] = 1
        both += m @ m.T
    rare = (count >= 2) & ~common
    here = rare[code]
    order = np.argsort(code[here], kind="stable")
    row, column = owner[here][order], code[here][order]  # members of each rare shingle, in order
    for k in range(1, COMMON):
        at = np.flatnonzero(column[k:] == column[:-k]) if len(column) > k else np.zeros(0, np.int64)
        if not len(at):
            break
        np.add.at(both, (row[at], row[at + k]), 1)
        np.add.at(both, (row[at + k], row[at]), 1)
    names = {c: k for k, c in enumerate(sorted(set(comp)))}
    group = np.array([names[c] for c in comp])
    top = list(range(len(names)))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for i in range(n):
        inter = both[i].astype(np.int64)
        for j in np.flatnonzero((den * inter >= num * (size[i] + size - inter)) & (group > group[i])).tolist():
            x, y = root(group[i]), root(group[j])
            if x != y:
                top[x] = y
                out.append((cls[i], cls[j]))
    return out


def _rest(dense: DataFrame, comp: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame | None:
    """Links between different components of regions that are larger than what neighbours cover."""
    n = dense.count()
    rows = dense.join(comp.select(F.col("node").alias("cls"), "comp").hint("merge"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rows = cut(rows, "rest-rows", rows=n)
    several = cut(rows.groupBy("tree", "region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("tree", "region"), "rest-several", rows=n)
    rows = cut(rows.join(several.hint("merge"), ["tree", "region"]), "rest-open", rows=n)
    who = cut(rows.select("cls", "comp").distinct(), "rest-classes", rows=n)
    m = who.count()
    if not m:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in pieces(batches):
            sets = [shingle_set(t, shingle, hashes).view(np.int64) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "comp", "n_shingles", "shingles"])

    full = who.join(texts.hint("merge"), "cls").select("cls", "comp", "text").coalesce(max(1, -(-m // PAIRS)))
    sets = cut(full.mapInArrow(run, "cls binary, comp binary, n_shingles long, shingles array<long>"), "rest-sets")
    alive = _survivors(sets, num, den)
    rows = cut(rows.select("tree", "region", "cls").join(alive.hint("merge"), "cls"), "rest-members", rows=n)
    per = rows.groupBy("tree", "region", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    total = per.groupBy("tree", "region").agg(F.max_by(F.struct("comp", "n", "size"), F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("comps"))

    def blocks(n, size):
        return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")

    regions = cut(total.filter("comps > 1").select("tree", "region", F.col("main.comp").alias("main"), blocks(F.col("n"), F.col("size")).alias("all"), blocks(F.col("main.n"), F.col("main.size")).alias("mains"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("others")), "rest-regions", rows=n)
    dealt = cut(rows.join(regions.hint("merge"), ["tree", "region"]).withColumns({"other": F.col("comp") != F.col("main"), "h": F.xxhash64("cls")}), "rest-dealt", rows=n)
    key, each = ["tree", "region", "cls", "comp"], lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = dealt.filter("all = 1").select(*key, F.lit("whole").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    large = dealt.filter("all > 1")
    mains = large.filter("not other").select(*key, F.lit("across").alias("kind"), F.pmod("h", "mains").cast("int").alias("i"), each("others").alias("j"))
    across = large.filter("other").select(*key, F.lit("across").alias("kind"), each("mains").alias("i"), F.pmod("h", "others").cast("int").alias("j"))
    among = large.filter("other").select(*key, F.pmod("h", "others").cast("int").alias("x"), each("others").alias("y")).select(*key, F.lit("among").alias("kind"), F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    full = whole.unionByName(mains).unionByName(across).unionByName(among).join(sets.select("cls", "shingles").hint("merge"), "cls")

    def compare(group: pa.Table) -> pa.Table:
        cls, comp = group.column("cls").to_pylist(), group.column("comp").to_pylist()
        sets = [np.asarray(s.values) for chunk in group.column("shingles").chunks for s in chunk]
        found = _joining(cls, comp, sets, num, den)
        return pa.table({"a": pa.array([min(x) for x in found], pa.binary()), "b": pa.array([max(x) for x in found], pa.binary())})

    found = full.select("tree", "region", "kind", "i", "j", "cls", "comp", "shingles").groupBy("tree", "region", "kind", "i", "j").applyInArrow(compare, "a binary, b binary")
    out = cut(found.distinct(), "rest-links", rows=n)  # at most one a member and region
    discard(rows, several, who, sets, alive, regions, dealt)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (least doc_id reachable over
    links, itself included), kept (doc_id = component_id), row_key (hash of id and text).

    Links: den * intersection >= num * union of the word-shingle sets."""
    base, trees = forest_shape(num / den)
    rows = cut(_signatures(docs, shingle, trees, id_col, text_col), "signatures")
    n = rows.count()
    classes = cut(
        rows.filter("n_shingles > 0").groupBy("cls")
        .agg(F.min("doc_id").alias("low"), F.min(F.struct("row_key", "doc_id", "sig")).alias("rep"))
        .select("cls", "low", F.struct("rep.row_key", "rep.doc_id").alias("rep"), "rep.sig"),
        "classes", rows=n, per_file=TEXTS,
    )
    n = classes.count()
    forest = _forest(classes, base, trees)
    kinds = {r.kind: r["count"] for r in forest.groupBy("kind").count().collect()}
    pairs = forest.filter(F.col("kind") == _PAIR).select("a", "b", "common").unionAll(_across(forest, base))
    pairs = cut(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees"), F.max("common").alias("common")), "pairs", rows=kinds.get(_PAIR, 0))
    texts = _texts(docs, pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct(), classes, id_col, text_col, n)

    # the best candidate of each class first: most of a group is joined before its other pairs are looked at
    best = cut(pairs.groupBy("b").agg(F.max_by("a", F.struct("trees", "common", "a")).alias("a")), "best", rows=n)
    links = _confirm(best, texts, shingle, num, den)
    comp = components(links)
    more = cut(_between(pairs, comp).select("a", "b").join(best.hint("merge"), ["a", "b"], "left_anti"), "more", rows=pairs.count())
    if not more.isEmpty():
        links = links.unionAll(_confirm(more, texts, shingle, num, den))
        comp = components(links)

    dense = cut(forest.filter(F.col("kind") == _DENSE).select("tree", F.col("path").alias("region"), F.col("a").alias("cls")).distinct(), "dense", rows=kinds.get(_DENSE, 0))
    forest.unpersist()
    if not dense.isEmpty():
        joined = _rest(dense, comp, texts, shingle, num, den)
        if joined is not None and not joined.isEmpty():
            comp = components(links.unionAll(joined))
    discard(pairs, texts, best, more, dense)

    named = cut(classes.select("cls", "low").join(comp.select(F.col("node").alias("cls"), "comp").hint("merge"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "class-components", rows=n)
    lows = cut(named.groupBy("comp").agg(F.min("low").alias("component_id")), "component-ids", rows=n)
    final = cut(named.join(lows.hint("merge"), "comp").select("cls", "component_id"), "class-ids", rows=n)
    discard(classes, named, lows)
    out = rows.select("doc_id", "row_key", "n_shingles", "cls").join(final.hint("merge"), "cls", "left")
    component = F.coalesce("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row_key")


def dedup(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns. Rows are told apart by id
    and by a hash of id and text together."""
    keys = near_duplicates(docs, shingle, num, den, id_col, text_col).filter("kept").select("row_key", F.col("doc_id").alias("_kept")).distinct()
    keys = cut(keys, "kept-keys", rows=docs.count())
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"))
    stay = rows.join(keys.hint("merge"), (F.col("_key") == F.col("row_key")) & F.col("_id").eqNullSafe(F.col("_kept")), "left_semi")
    return stay.dropDuplicates(["_key", "_id"]).select("row.*")
