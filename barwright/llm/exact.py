"""Exact dedup against a persistent digest index (operator 10).

The index is a Parquet table bucketed and sorted by digest. A batch is first reduced to one row
for each digest (so a text that a third of all rows share costs one row a task), its digests are
sort-merge anti-joined with the index, and those the index lacks are appended.

Defined results
    null text       counts as the empty text.
    null doc_id     loses against any other id; a group of null ids only keeps all its rows.
    repeated rows   rows equal in id and text are one document to `annotate` (the same verdict);
                    `dedup` returns one of them.
    empty table     no rows.
    later batches   a digest keeps the id that its first batch gave it, whatever ids come later, as
                    what was kept then has been passed on; `group_size` counts the batch.
    other columns   carried by `dedup` whatever their names; `annotate` returns its own columns only.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import cut, text_or_empty

#: Digests of one bucket, about 150 MB; the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 2_000_000, 8


def digest(col: str = "text"):
    """Lowercase hex SHA-256 of the text's UTF-8 bytes."""
    return F.sha2(text_or_empty(col).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, with the id that stays for each.

    path: folder shared by the cluster; None puts the table into the warehouse.
    rows: digests that it is to hold in the end; they set the number of buckets, which is fixed when
    the index is made. An index that exists keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, name: str | None = None, rows: int = 0):
        self.spark = spark
        self.buckets = buckets or max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
        if path:
            self.buckets = self._noted(path, self.buckets)
        key = hashlib.md5((path or name or uuid.uuid4().hex).encode()).hexdigest()[:20]
        self.name = f"digest_index_{key}"
        at = f" LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{at}"
        )
        if path:
            spark.catalog.refreshTable(self.name)
        found = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
        self.buckets = int(found["Num Buckets"])

    def _noted(self, path: str, buckets: int) -> int:
        """The number of buckets that an index in this folder was made with, noted there; else this one."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path, "_buckets")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            noted = fs.open(at)
            try:
                return noted.readInt()
            finally:
                noted.close()
        out = fs.create(at)
        try:
            out.writeInt(buckets)
        finally:
            out.close()
        return buckets

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of groups (unique digests) that the index lacks: the sort-merge anti-join. The index
        side is read in its buckets and isn't shuffled."""
        dealt = groups.repartition(self.buckets, "digest")
        return dealt.join(self.table().hint("merge").select("digest"), "digest", "left_anti")

    def append(self, fresh: DataFrame) -> None:
        # the bucket as Spark's writer takes it; in order of buckets each task writes few files, one as a rule
        rows = fresh.select("digest", "keep_id", F.pmod(F.hash("digest"), F.lit(self.buckets)).alias("bucket"))
        rows = rows.repartitionByRange(self.buckets, "bucket").sortWithinPartitions("bucket", "digest")
        rows.select("digest", "keep_id").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _verdicts(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str) -> DataFrame:
    """(digest, keep_id, group_size) of each digest in docs, after the index has taken in the new ones."""
    n = docs.count()
    groups = cut(
        docs.select(F.col(id_col).cast("long").alias("id"), digest(text_col).alias("digest"))
        .groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "digest-groups", rows=n,
    )
    index.append(index.unseen(groups))
    known = index.table().select("digest", "keep_id")
    out = groups.select("digest", "group_size").repartition(index.buckets, "digest").join(known.hint("merge"), "digest")
    return cut(out.select("digest", "keep_id", "group_size"), "digest-verdicts", rows=n)


def annotate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Both sides of the last join are plain shuffles of narrow rows, so that adaptive execution can
    split the digest of a text with very many copies.
    """
    verdicts = _verdicts(docs, index, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest"))
    return rows.join(verdicts.hint("merge"), "digest").select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Joined on digest and id together, so the
    copies of one text are spread over all tasks."""
    verdicts = _verdicts(docs, index, id_col, text_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), digest(text_col).alias("digest"))
    keep = verdicts.select("digest", F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("id"))
    stay = rows.join(keep.hint("merge"), ["digest", "id"], "left_semi")
    one = stay.filter(F.col("id") != "").dropDuplicates(["digest", "id"])
    return one.unionByName(stay.filter(F.col("id") == "")).select("row.*")
