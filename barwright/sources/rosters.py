"""Listings, rosters and the registry's floors: which symbols a universe holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of a registry at least, regions with any, share of the last size, members of a listing region at most.
LEAST_MEMBERS, LEAST_REGIONS, SHRINK, BUDGET = 8000, 12, 0.8, 3400
#: Roots of symbols by region suffix.
ROOTS = {".T": r"^\d{4}$", ".KS": r"^\d{6}$", ".KQ": r"^\d{6}$"}


def read_listing(spark: SparkSession, path: str, form: str = r"^[A-Z]{1,5}$") -> DataFrame:
    """Symbols of a listing: the first column of a CSV, where it looks like a symbol."""
    raw = spark.read.option("header", False).schema("sym string").csv(path)
    return listed(raw, form)


def listed(raw: DataFrame, form: str = r"^[A-Z]{1,5}$") -> DataFrame:
    return raw.select(F.trim("sym").alias("sym")).filter(F.col("sym").rlike(form)).distinct()


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """(code, segment, name) of a roster whose comments start with #."""
    return spark.read.option("header", True).option("comment", "#").schema("code string, segment string, name string").csv(path)


def member_ok(sym: Column) -> Column:
    """Whether a symbol has the root that its region suffix asks for; others pass."""
    ok = F.lit(None).cast("boolean")
    for suffix, root in ROOTS.items():
        ok = F.coalesce(ok, F.when(sym.endswith(suffix), F.regexp_replace(sym, suffix.replace(".", r"\.") + "$", "").rlike(root)))
    return F.coalesce(ok, F.lit(True))


def roster_members(roster: DataFrame, segments: dict[str, str], form: str = r"^\d{4}$", budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Members (sym, segment) of the wanted segments with their suffix appended, and a count of each kind of
    row: rejected for its code first, then left out for its segment. The members are at most `budget`."""
    suffix = F.coalesce(*[F.when(F.col("segment") == s, F.lit(x)) for s, x in segments.items()])
    kind = F.when(~F.coalesce(F.col("code").rlike(form), F.lit(False)), "rejected").when(suffix.isNull(), "other segment").otherwise("kept")
    marked = roster.withColumns({"kind": kind, "suffix": suffix})
    members = marked.filter("kind = 'kept'").select(F.concat("code", "suffix").alias("sym"), "segment").distinct()
    counts = marked.groupBy("kind").agg(F.count(F.lit(1)).alias("rows")).withColumn("over_budget", (F.col("kind") == "kept") & (F.col("rows") > budget))
    return members, counts


def floor_reasons(assigned: DataFrame, anchor: int | None = None, least: int = LEAST_MEMBERS, regions: int = LEAST_REGIONS, shrink: float = SHRINK) -> DataFrame:
    """Why a registry is refused: too few members, too few regions, or much smaller than before. assigned:
    (sym, region); unchecked symbols don't count."""
    own = assigned.filter("region <> 'unchecked'").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("region").alias("regions"))
    reasons = F.array_compact(F.array(
        F.when(F.col("members") < least, "too few members"), F.when(F.col("regions") < regions, "too few regions"),
        F.when(F.col("members") < shrink * anchor, "shrunk") if anchor else F.lit(None).cast("string"),
    ))
    return own.select("members", "regions", reasons.alias("reasons"))


def remaining(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Keys still to do: an anti-join with those that are done."""
    return wanted.select("sym").distinct().join(done.select("sym"), "sym", "left_anti")


def year_coverage(bars: DataFrame, least: int = 10) -> DataFrame:
    """Years that a symbol has bars of, and whether they are enough."""
    g = bars.groupBy("sym").agg(F.countDistinct(F.year("bar_ts")).alias("years"))
    return g.withColumn("enough", F.col("years") >= least)


def fileless(members: DataFrame, bars: DataFrame, keep: DataFrame) -> DataFrame:
    """Members without any bar that aren't on the keep list."""
    return remaining(members, bars.select("sym")).join(keep.select("sym"), "sym", "left_anti")


def scan_history(history: DataFrame, sym: str, since: Column) -> DataFrame:
    """A symbol's past signals from a day on, oldest first."""
    return history.filter((F.col("sym") == sym) & (F.col("day") >= since)).orderBy("day", "score")
