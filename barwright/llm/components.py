"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import NARROW, cut, discard

#: Links that a task joins before it gives out what it has and starts anew (about 100 MB).
HELD = 500_000


def _joined(links: DataFrame, held: int, n: int) -> DataFrame:
    """The same components by fewer links: of every `held` links that a task sees, one from each node
    to the least node that they lead to. Of n links, about NARROW meet in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            top.setdefault(x, x)
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        def out() -> pa.RecordBatch:
            rows = [(r, x) for x in top if (r := root(x)) != x]
            top.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["a", "b"])

        n = 0
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    top[max(x, y)] = min(x, y)
            n += batch.num_rows
            if n >= held:
                yield out()
                n = 0
        yield out()

    return links.select("a", "b").coalesce(max(1, -(-n // NARROW))).mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, held: int = HELD) -> DataFrame:
    """links (a, b) -> (node, comp): comp is the least node of the component.

    Tasks first join the links that they see anyway. Then, in rounds, every node points at its least
    neighbour or itself, and links are carried over to what their ends point at; links within one node
    go. The image of a connected set stays connected and its least node points at itself, so rounds go
    on until no link is left. Names of nodes are digests, in no order along any path, so a round leaves a
    constant share of the nodes, and a few rounds do. Nodes with very many links only meet
    pre-aggregated minima and joins whose other side has one row a node.
    """
    edges = cut(_joined(links, held, links.count()), "cc-links")
    n, found = edges.count(), None
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    while n:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "cc-up", rows=2 * n)
        step = up.select(F.col("node").alias("comp"), "up")
        old, found = found, up.select("node", F.col("up").alias("comp")) if found is None else cut(found.join(step.hint("merge"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "cc-found", rows=found.count())
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")).hint("merge"), "a").select("x", "b")
        ends = ends.join(up.select(F.col("node").alias("b"), F.col("up").alias("y")).hint("merge"), "b").filter("x <> y")
        fewer = cut(_joined(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), held, n), "cc-links")
        discard(edges, old)
        edges, n = fewer, fewer.count()
    return found
