"""Queries that run a stream over a table and return what it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barwright.plans import shared, sql
from barwright.streaming import bars as S

QUERIES, ORACLES = {}, {}


def _folder(spark) -> str:
    return shared.folder(spark, "stream")


def _ticks(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads folders; the glob matches the table whether it is a file or a folder
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events*")


def stream_bars_tumbling(spark, sf_dir):
    """Bars of the whole stream; complete mode, so that the last bars show too."""
    at = _folder(spark)
    bars = S.bars(_ticks(spark, sf_dir), "event_type", "ts", "value", "event_id")
    out = S.collected(bars, f"bars_{uuid.uuid4().hex[:8]}", f"{at}/checkpoint", "complete")
    return out.select("sym", "bar_ts", *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close", "volume")])


QUERIES["stream_bars_tumbling"] = stream_bars_tumbling
ORACLES["stream_bars_tumbling"] = f"WITH {sql.HOURLY} SELECT sym, bar_ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume FROM bars"


def stream_dedup(spark, sf_dir):
    """One event an hour and type stays, however many come."""
    at = _folder(spark)
    e = _ticks(spark, sf_dir).select(F.col("event_type").alias("sym"), F.date_trunc("hour", "ts").alias("bar_ts"))
    return S.collected(S.deduplicated(e), f"dedup_{uuid.uuid4().hex[:8]}", f"{at}/checkpoint")


QUERIES["stream_dedup"] = stream_dedup
ORACLES["stream_dedup"] = "SELECT DISTINCT event_type AS sym, date_trunc('hour', ts) AS bar_ts FROM events"


def stream_upsert(spark, sf_dir):
    """Deliveries upserted into a store, the same ones twice; then the store's keys."""
    at = _folder(spark)
    for k in range(2):
        e = _ticks(spark, sf_dir).select(F.col("event_type").alias("sym"), F.date_trunc("day", "ts").alias("bar_ts"))
        S.upserting(e, f"{at}/store", f"{at}/checkpoint{k}").awaitTermination()
    return spark.read.parquet(f"{at}/store").groupBy("sym", "bar_ts").agg(F.count(F.lit(1)).alias("copies"))


QUERIES["stream_upsert"] = stream_upsert
ORACLES["stream_upsert"] = "SELECT DISTINCT event_type AS sym, date_trunc('day', ts) AS bar_ts, 1::BIGINT AS copies FROM events"
