"""Mixing sources to target weights by Pfair scheduling (operator 2).

Each source's rows are put into a random but fixed order and cut into blocks. Ideally every source runs
at its weight without a break, and when one has run out the rest go on with their weights scaled up.
Block k of a source may not start before the slot in which the ideal has k blocks of it (its release)
and must be out by the slot in which the ideal has k + 1 (its deadline); earliest-deadline-first over
the released blocks keeps every source less than one block away from the ideal in every prefix. Weights
are taken as the exact rationals that the given numbers are, and all blocks are scheduled on the driver,
one heap step a block; 4 bytes a block go to the workers. There are `MOST_BLOCKS` of them at most (blocks
grow with very many rows). No row is dropped or repeated.

Rows of a source are numbered without bringing them together: they are spread over buckets of the
hash that orders them, numbered within each bucket, and shifted by the sizes of the buckets before.

Defined results
    null source         a source of its own, named by None in `weights`.
    source not named    takes `default_weight`; with None, a source that isn't named raises ValueError.
    null id             dealt by a hash of the row instead.
    repeated rows       each has its own place.
    weight 0 or less    raises ValueError. Any number of sources; their sizes come to the driver, one
                        number each.
    ties                equal deadlines go to the source that sorts first.
    empty table         no rows. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Mapping
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwright.llm.common import cut

#: Rows in one numbering bucket: total / BUCKETS, within these bounds. The table of bucket sizes has
#: at most one row for each BUCKET_ROWS[0] rows, and about total / BUCKET_ROWS[1] at large sizes.
BUCKETS, BUCKET_ROWS = 4096, (500, 50_000)
#: Blocks of a schedule at most: 64 MB, and about a minute of the driver.
MOST_BLOCKS = 16_000_000
#: Sources whose sizes are broadcast; beyond, the planner chooses.
BROADCAST_SOURCES = 100_000


def exact_order(blocks: list[int], weights: list[float]) -> np.ndarray:
    """The source of every slot: earliest deadline first in windows of the exact weights.

    At the moment v of a common clock the ideal has min(w * v, n) blocks of a source of weight w and n
    blocks; its slots until then are done + rate * v, with the blocks of the sources that have run out
    and the weights of the others. All are whole numbers or quotients of them, so nothing is rounded."""
    ratios = [Fraction(w) for w in weights]
    unit = math.lcm(*[r.denominator for r in ratios]) if ratios else 1
    whole = [int(r * unit) for r in ratios]
    ends = sorted((i for i in range(len(blocks)) if blocks[i]), key=lambda i: (Fraction(blocks[i], whole[i]), i))
    done, rate = [0], [sum(whole[i] for i in ends)]
    for i in ends:
        done.append(done[-1] + blocks[i])
        rate.append(rate[-1] - whole[i])
    at = [0] * len(blocks)  # sources that have run out before a source's next moment

    def moment(i: int, k: int) -> tuple[int, int]:
        """The ideal's slots when it has k blocks of source i, rounded down and up."""
        while k * whole[ends[at[i]]] > blocks[ends[at[i]]] * whole[i]:
            at[i] += 1
        d, r = done[at[i]], rate[at[i]] * k
        return d + r // whole[i], d - (-r // whole[i])

    out, used = array("I"), [0] * len(blocks)
    deadline = [moment(i, 1)[1] if blocks[i] else 0 for i in range(len(blocks))]
    coming = [(0, i) for i in sorted(ends)]  # (release, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for t in range(sum(blocks)):
        while coming and coming[0][0] <= t:
            _, i = heapq.heappop(coming)
            heapq.heappush(ready, (deadline[i], i))
        _, i = heapq.heappop(ready)
        out.append(i)
        used[i] += 1
        if used[i] < blocks[i]:
            release = moment(i, used[i])[0]
            deadline[i] = moment(i, used[i] + 1)[1]
            heapq.heappush(coming, (max(t + 1, release), i))
    return np.frombuffer(out, np.uint32) if out else np.zeros(0, np.uint32)


def slots_by_source(order: np.ndarray, sources: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all blocks, source after source, and where each source's begin."""
    slots = np.argsort(order, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(order, minlength=sources))])
    return slots.astype(np.int32 if len(order) < 2**31 else np.int64), first


def smoothed(sizes: Mapping[str | None, int], power: float = 0.5) -> dict[str | None, float]:
    """Target weights from source sizes, raised to a power under 1 so that large sources count less."""
    return {s: float(n) ** power for s, n in sizes.items()}


def source_sizes(docs: DataFrame, source_col: str = "source") -> dict[str | None, int]:
    return {r.s: r["count"] for r in docs.groupBy(F.col(source_col).cast("string").alias("s")).count().collect()}


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = 64, power: float = 0.5, default_weight: float | None = None, seed: str = "mix", most_blocks: int = MOST_BLOCKS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows and columns of docs, and mix_slot (the block's place in the mixed order), mix_block
    (the block's number in its source) and mix_row (the row's number in the block). Ordered by
    mix_slot and mix_row, every prefix of whole slots holds the target weights.

    weights: target of each source; None smooths the sources' own sizes by `power`.
    block_rows: rows of a block; more where the schedule would have over `most_blocks` blocks otherwise, so
    that what the driver schedules and sends to the workers is bounded. No prefix is a block off either way."""
    sizes = source_sizes(docs, source_col)
    block_rows = max(block_rows, -(-sum(sizes.values()) // most_blocks))
    targets = smoothed(sizes, power) if weights is None else dict(weights)
    if missing := [s for s in sizes if s not in targets]:
        if default_weight is None:
            raise ValueError(f"sources without a weight: {sorted(map(str, missing))[:10]}")
        targets |= dict.fromkeys(missing, default_weight)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    if any(not targets[s] > 0 for s in names):
        raise ValueError("weights must be above 0")
    blocks, wanted = [-(-sizes[s] // block_rows) for s in names], [targets[s] for s in names]
    planned = slots_by_source(exact_order(blocks, wanted), len(names))
    number = {s: i for i, s in enumerate(names)}

    clash = {c.lower() for c in docs.columns} & {"mix_slot", "mix_block", "mix_row"}
    row = F.struct(*[docs[c] for c in docs.columns if c.lower() not in clash]).alias("row")
    # rows without an id are dealt by what else they hold, so that any number of them spreads over buckets
    rest = [docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\x1f"), F.xxhash64(*rest).cast("string")))
    key = F.md5(F.concat_ws("\x1f", F.lit(seed), own).cast("binary"))
    each = min(max(sum(sizes.values()) // BUCKETS, BUCKET_ROWS[0]), BUCKET_ROWS[1])
    # one row a source
    parts = docs.sparkSession.createDataFrame([(s, -(-n // each)) for s, n in sizes.items()], "_s string, _parts long")
    rows = docs.select(row, F.col(source_col).cast("string").alias("_source"), F.col(id_col).alias("_id"), key.alias("_key"))
    rows = rows.join(F.broadcast(parts) if len(sizes) <= BROADCAST_SOURCES else parts, F.col("_source").eqNullSafe(F.col("_s")), "left")
    # buckets are ranges of the ordering hash, of which 28 bits are used
    share = F.conv(F.substring("_key", 1, 7), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.floor(share * F.col("_parts") / F.lit(1 << 28)).cast("long")).drop("_s", "_parts")
    counts = rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = cut(counts.select("_source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before")), "mix-offsets", rows=sum(-(-n // each) for n in sizes.values()))
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy("_source", "_bucket").orderBy("_key", "_id")) - 1)
    # one row for each source and bucket: rows / BUCKET_ROWS or so, the planner broadcasts it while small
    numbered = numbered.join(offsets.withColumnsRenamed({"_source": "_s", "_bucket": "_b"}), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
    numbered = numbered.withColumn("_n", F.col("_n") + F.col("_before"))
    shipped = docs.sparkSession.sparkContext.broadcast((planned, number))

    @F.pandas_udf("long")
    def slot(source: pd.Series, block: pd.Series) -> pd.Series:
        (slots, first), number = shipped.value
        # the number of each distinct source in the batch, then of each row
        code, names = pd.factorize(source, use_na_sentinel=False)
        start = np.array([first[number[None if pd.isna(s) else s]] for s in names], np.int64)
        return pd.Series(slots[start[code] + block.to_numpy()].astype(np.int64))

    block = F.floor(F.col("_n") / F.lit(block_rows)).cast("long")
    return numbered.select("row", "_source", block.alias("mix_block"), (F.col("_n") % block_rows).cast("int").alias("mix_row")).select("row.*", slot("_source", "mix_block").alias("mix_slot"), "mix_block", "mix_row")
