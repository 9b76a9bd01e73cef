"""Upkeep of a bar store: merging, trimming, staleness, accounting and guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days kept, days until stale, jump that marks a split between deliveries, closing hour.
KEEP_DAYS, STALE_DAYS, BREAK, CLOSING_HOUR = 730, 28, 0.30, 19
#: Nights missed until a symbol is excluded, and the share of members that may be.
EXCLUDE_NIGHTS, EXCLUDE_SHARE = 2, 0.005
#: Least bars to score, share of rows and of each region that must be there, and its floor.
LEAST_BARS, ROW_SHARE, REGION_SHARE, ROW_FLOOR = 20, (2, 5), (1, 2), 2500


def cased(rows: DataFrame) -> DataFrame:
    """Columns by their names in small letters, blanks as underscores; of names that then are alike, the
    first stays."""
    out: dict[str, Column] = {}
    for c in rows.columns:
        out.setdefault("_".join(c.strip().lower().split()), rows[f"`{c}`"])
    return rows.select(*[col.alias(name) for name, col in out.items()])


def normalized(rows: DataFrame) -> DataFrame:
    """Numbers from whatever the columns hold; rows without a close go."""
    return rows.select("sym", "bar_ts", *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("open", "high", "low", "close", "volume")]).filter("close is not null and not isnan(close)")


def settled(bars: DataFrame, zones: DataFrame, now: Column, hour: int = CLOSING_HOUR) -> DataFrame:
    """Without bars dated today in their region while its day isn't over. zones: (region, timezone); a
    region that isn't there counts as UTC. bars have a region column."""
    b = bars.join(F.broadcast(zones), "region", "left")
    local = F.from_utc_timestamp(now, F.coalesce("timezone", F.lit("UTC")))
    open_ = (F.hour(local) < hour) & (F.to_date("bar_ts") == F.to_date(local))
    return b.filter(~open_).drop("timezone")


def trimmed(bars: DataFrame, days: int = KEEP_DAYS) -> DataFrame:
    """The last `days` of each symbol."""
    last = F.max("bar_ts").over(Window.partitionBy("sym"))
    return bars.withColumn("_last", last).filter(F.to_date("bar_ts") >= F.date_sub(F.to_date("_last"), days)).drop("_last")


def upsert(stored: DataFrame, fetched: DataFrame, replace: bool = False, days: int = KEEP_DAYS) -> DataFrame:
    """Stored bars win; fetched ones come in for days that aren't there. With replace, the fetched symbols'
    bars take the place of theirs."""
    new = normalized(fetched)
    if replace:
        kept = normalized(stored).join(new.select("sym").distinct(), "sym", "left_anti")
        return trimmed(kept.unionByName(new), days)
    old = normalized(stored)
    return trimmed(old.unionByName(new.join(old.select("sym", "bar_ts"), ["sym", "bar_ts"], "left_anti")), days)


def breaks(stored: DataFrame, fetched: DataFrame, jump: float = BREAK) -> DataFrame:
    """Symbols whose fetched close on their last stored day is off by more than the share."""
    last = stored.groupBy("sym").agg(F.max("bar_ts").alias("bar_ts"), F.max_by("close", "bar_ts").alias("stored_close"))
    f = fetched.select("sym", "bar_ts", F.col("close").alias("fetched_close"))
    off = F.abs(F.col("fetched_close") - F.col("stored_close")) / F.abs(F.when(F.col("stored_close") != 0, F.col("stored_close")))
    return last.join(f, ["sym", "bar_ts"]).select("sym", "bar_ts", "stored_close", "fetched_close", F.coalesce(off > jump, F.lit(False)).alias("broken"))


def staleness(members: DataFrame, bars: DataFrame, today: Column, days: int = STALE_DAYS) -> DataFrame:
    """Which members need a full delivery and which only the latest bars, with the reason."""
    last = bars.groupBy("sym").agg(F.to_date(F.max("bar_ts")).alias("last_day"))
    m = members.select("sym").distinct().join(last, "sym", "left").withColumn("age", F.datediff(today, "last_day"))
    note = F.when(F.col("last_day").isNull(), "missing").when(F.col("age") > days, F.concat(F.lit("stale "), F.col("age").cast("string"), F.lit("d"))).otherwise("")
    return m.select("sym", "last_day", F.when(note == "", "delta").otherwise("backfill").alias("period"), note.alias("note"))


def accounting(members: DataFrame) -> DataFrame:
    """Exactly one class for each member of (sym, has_row, fetched, usable): the first that fits."""
    c = F.when(F.col("has_row"), "scored").when(~F.col("fetched"), "not_fetched").when(~F.col("usable"), "dead").otherwise("insufficient")
    return members.select("sym", c.alias("class"))


def partition_reasons(classes: DataFrame, total: int, skip_fetch: bool = False) -> DataFrame:
    """What keeps the partition from closing: classes that don't add up, members that weren't fetched (the
    first ten are named)."""
    g = classes.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == "not_fetched").alias("nf"))
    first = classes.filter(F.col("class") == "not_fetched").orderBy("sym").limit(10).agg(F.array_join(F.array_sort(F.collect_list("sym")), ", ").alias("names"))
    reasons = F.array_compact(F.array(
        F.when(F.col("n") != total, F.concat(F.lit("not closed: "), F.col("n").cast("string"), F.lit(f" of {total}"))),
        F.when((F.col("nf") > 0) & F.lit(not skip_fetch), F.concat(F.lit("not fetched: "), F.col("nf").cast("string"), F.lit(": "), F.col("names"))),
    ))
    return g.crossJoin(F.broadcast(first)).select(reasons.alias("reasons"))


def at_least(n: Column, share: tuple[int, int]) -> Column:
    """The share of n rounded up, in whole numbers."""
    num, den = share
    return F.floor((n * num + den - 1) / den).cast("long")


def coverage(rows: DataFrame, members: DataFrame, floor: int = ROW_FLOOR) -> DataFrame:
    """Rows against members for each region (half must be there) and for all (two fifths, and a floor)."""
    m = members.groupBy("region").agg(F.count(F.lit(1)).alias("members"))
    r = rows.groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    j = m.join(r, "region", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    each = j.select("region", "members", "rows", at_least(F.col("members"), REGION_SHARE).alias("least"))
    total = j.agg(F.lit("(all)").alias("region"), F.sum("members").alias("members"), F.sum("rows").alias("rows"))
    whole = total.select("region", "members", "rows", F.greatest(F.lit(floor).cast("long"), at_least(F.col("members"), ROW_SHARE)).alias("least"))
    return each.unionByName(whole).withColumn("enough", F.col("rows") >= F.col("least"))


def refresh_guard(old: DataFrame, new: DataFrame, least: float = 0.8, most: float = 1.5, required: Sequence[str] = ()) -> DataFrame:
    """Region by region: members before and after, and why a refresh is refused (vanished, shrunk, grown)."""
    a, b = old.groupBy("region").agg(F.countDistinct("sym").alias("before")), new.groupBy("region").agg(F.countDistinct("sym").alias("after"))
    j = a.join(b, "region", "full_outer").select("region", F.coalesce("before", F.lit(0).cast("long")).alias("before"), F.coalesce("after", F.lit(0).cast("long")).alias("after"))
    reason = F.when((F.col("after") == 0) & (F.col("before") > 0), "vanished").when(F.col("after") < least * F.col("before"), "shrunk").when((F.col("before") > 0) & (F.col("after") > most * F.col("before")), "grown").when(F.col("region").isin(*required or [""]) & (F.col("after") == 0), "required")
    return j.withColumn("reason", reason)


def exclusions(state: DataFrame, misses: DataFrame, tonight: Column) -> DataFrame:
    """State (sym, first_seen, last_seen, nights, reason) after tonight's misses (sym, reason): a symbol
    missed again counts on, a new one starts at one, one that came back goes."""
    j = misses.select("sym", F.col("reason").alias("why")).join(state, "sym", "left")
    return j.select("sym", F.coalesce("first_seen", tonight).alias("first_seen"), tonight.alias("last_seen"), (F.coalesce("nights", F.lit(0)) + 1).cast("int").alias("nights"), F.col("why").alias("reason"))


def excluded(state: DataFrame, nights: int = EXCLUDE_NIGHTS) -> DataFrame:
    """Symbols that have been missed so many nights."""
    return state.filter(F.col("nights") >= nights)


def too_many(state: DataFrame, members: DataFrame, share: float = EXCLUDE_SHARE, nights: int = EXCLUDE_NIGHTS) -> DataFrame:
    """Number of excluded symbols and of members, and whether the first are so many that the fetch has
    failed rather than they."""
    out = excluded(state, nights).agg(F.count(F.lit(1)).alias("excluded"))
    all_ = members.agg(F.countDistinct("sym").alias("members"))
    return out.crossJoin(F.broadcast(all_)).withColumn("too_many", F.col("excluded") > F.col("members") * share)


def merged_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Results (sym, score, error) of two passes: the second's take the place of the first's where they have
    a score; a second pass that failed only leaves its error. Symbols of the second alone don't count."""
    b = second.select("sym", F.col("score").alias("score2"), F.col("error").alias("error2"))
    j = first.join(b, "sym", "left")
    return j.select("sym", F.coalesce("score2", "score").alias("score"), F.when(F.col("score2").isNotNull(), F.col("error2")).otherwise(F.coalesce("error2", "error")).alias("error"), F.col("score2").isNotNull().alias("replaced"))


def anchor(stats: Column) -> Column:
    """The size of the registry that published statistics (JSON) state, null where they state none."""
    return F.from_json(F.get_json_object(stats, "$.registry"), "m_unique int")["m_unique"]


def is_stale(day: Column, today: Column) -> Column:
    """Older than the last weekday before today (today's own bar isn't due yet)."""
    back = F.when(F.weekday(today) == 0, 3).when(F.weekday(today) == 6, 2).otherwise(1)
    return day < F.date_sub(today, back)


def class_of_store(bars: DataFrame, members: DataFrame, scored: DataFrame, least: int = LEAST_BARS) -> DataFrame:
    """Every symbol of store and registry with its class and whether the registry has it."""
    b = bars.groupBy("sym").agg(F.count(F.lit(1)).alias("bars"))
    m = members.select("sym").distinct().withColumn("in_registry", F.lit(True))
    s = scored.select("sym").distinct().withColumn("has_row", F.lit(True))
    j = b.join(m, "sym", "full_outer").join(s, "sym", "left")
    c = F.when(F.col("has_row"), "scored").when(F.col("bars").isNull(), "not_fetched").when(F.col("bars") < least, "insufficient").otherwise("dead")
    return j.select("sym", c.alias("class"), F.coalesce("in_registry", F.lit(False)).alias("in_registry"))


def summary(errors: DataFrame, first: int = 10) -> DataFrame:
    """Number of errors, the first few by symbol, and whether there are more."""
    few = errors.orderBy("sym", "error").limit(first).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "sym", "error"))), "; ").alias("first"))
    return errors.agg(F.count(F.lit(1)).alias("errors")).crossJoin(F.broadcast(few)).select("errors", "first", (F.col("errors") > first).alias("truncated"))
