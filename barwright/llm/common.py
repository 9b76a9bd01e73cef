"""Shared helpers: the cluster's shared folder, cutting lineage, reading tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    found = tempfile.mkdtemp(prefix="barwright-shared-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


#: Rows of a narrow table (ids, digests, counts) that go into one file.
NARROW = 200_000


def cut(df: DataFrame, name: str, rows: int | None = None, per_file: int = NARROW) -> DataFrame:
    """Write df to the shared folder and read it back, so that later stages survive a lost executor
    without computing it again, and so that plans see it as an input of their own.

    rows: an upper bound of its rows, where one is known. A last stage of more tasks than `per_file`
    rows each call for is narrowed, so that the number of files follows the data and nothing else."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/barwright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    out = df if rows is None else df.coalesce(max(1, -(-rows // per_file)))
    out.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that `cut` has written, once nothing reads them any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_cut_path", None)):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that a worker holds the texts of few rows as strings."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
