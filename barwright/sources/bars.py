"""Bars: schema, building them from ticks or fact rows, and reading and writing bar stores.

A bar is (sym, bar_ts, open, high, low, close, volume); all operators of the library take a DataFrame
with these columns and partition by `sym`, ordered by `bar_ts`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("sym", T.StringType()), T.StructField("bar_ts", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
])
STORE_SCHEMA = T.StructType([T.StructField("date", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("open", "high", "low", "close", "volume")]])


def resample(ticks: DataFrame, sym: Column, bar: Column, price: Column, order: Column, volume: Column) -> DataFrame:
    """Ticks to bars in one grouped aggregation; `order` decides which tick with a price opens and closes a bar."""
    return (
        ticks.select(sym.cast("string").alias("sym"), bar.alias("bar_ts"), price.alias("p"), F.when(price.isNotNull(), order).alias("o"), volume.alias("v"))
        .groupBy("sym", "bar_ts")
        .agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").cast("double").alias("volume"))
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type; volume is the number of ticks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    return resample(e, F.col("event_type"), F.date_trunc("hour", "ts"), F.col("value"), F.struct("ts", "event_id"), F.lit(1.0))


def daily_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices by the supplier's nation."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey)
    return resample(j, F.col("s_nationkey"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber", F.col("l_extendedprice") / F.col("l_quantity")), F.col("l_quantity"))


def daily_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices by the part's brand."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return resample(j, F.col("p_brand"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber", F.col("l_extendedprice") / F.col("l_quantity")), F.col("l_quantity"))


def escaped(sym: Column) -> Column:
    """The file stem of a symbol."""
    return F.translate(sym, ".-/", "___")


def read_csv_store(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one CSV a symbol (date, open, high, low, close, volume; the symbol is the file's
    stem) as bars. Values that aren't numbers become null, rows without a close or date are left out."""
    raw = spark.read.schema(STORE_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv(?:\.gz)?$", 1)
    rows = raw.select(stem.alias("sym"), F.expr("try_cast(date as timestamp)").alias("bar_ts"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("open", "high", "low", "close", "volume")])
    return rows.filter("close is not null and bar_ts is not null")


def replaced(spark: SparkSession, path: str, write) -> None:
    """Calls write(folder) for a new folder beside `path` and moves it there once it is complete: readers
    find the old store or the new one, never half of it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, new, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + x) for x in ("", f".new-{uuid.uuid4().hex[:8]}", f".old-{uuid.uuid4().hex[:8]}"))
    fs = at.getFileSystem(conf)
    try:
        write(str(new.toString()))
        if fs.exists(at):
            fs.rename(at, old)
        if not fs.rename(new, at):
            raise OSError(f"can't move {new.toString()} to {path}")
    finally:
        fs.delete(new, True)
        fs.delete(old, True)


def write_csv_store(bars: DataFrame, path: str) -> None:
    """One CSV folder a symbol, in date order; takes the place of what is there as a whole."""
    out = bars.select(escaped(F.col("sym")).alias("sym"), F.date_format("bar_ts", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume")
    ready = out.repartition("sym").sortWithinPartitions("sym", "date")
    replaced(bars.sparkSession, path, lambda at: ready.write.option("header", True).partitionBy("sym").csv(at))


def read_csv_folders(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv_store wrote."""
    raw = spark.read.schema(T.StructType([*STORE_SCHEMA.fields, T.StructField("sym", T.StringType())])).option("header", True).csv(path)
    return raw.select("sym", F.expr("try_cast(date as timestamp)").alias("bar_ts"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("open", "high", "low", "close", "volume")])


def write_store(bars: DataFrame, path: str) -> None:
    """Parquet partitioned by year, sorted by symbol and time within files, so that a symbol or a span of
    time reads few row groups. Overwrites only the years that it brings."""
    year = bars.withColumn("year", F.year("bar_ts"))
    (year.repartitionByRange("year", "sym").sortWithinPartitions("year", "sym", "bar_ts").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path))


def read_store(spark: SparkSession, path: str, sym: str | None = None) -> DataFrame:
    """A Parquet store; with a symbol, its bars only (pushed down to the files)."""
    out = spark.read.parquet(path).drop("year")
    return out if sym is None else out.filter(F.col("sym") == sym)


def store_age_days(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """Age of each file of a store in days."""
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at")).distinct()
    return files.select("file", ((F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("at")) / 86400.0).alias("age_days"))


def write_signals(signals: DataFrame, path: str) -> None:
    """Signal streams as gzipped JSON lines, a folder an indicator."""
    signals.repartition("indicator").sortWithinPartitions("indicator", "sym", "bar_ts").write.mode("overwrite").option("compression", "gzip").partitionBy("indicator").json(path)


def read_signals(spark: SparkSession, path: str, schema: str = "sym string, bar_ts timestamp, state string, open double, close double, indicator string") -> DataFrame:
    return spark.read.schema(schema).json(path)
