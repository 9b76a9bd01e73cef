"""Cleaning of bars: splits, outliers, winsorising, validation, range-based sizing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import windows as X

#: A fall by more than this share is taken for a split; scale of the median deviation.
JUMP, MAD_SCALE = 0.30, 1.4826
PRICES = ("open", "high", "low", "close")
NUMBERS = (*PRICES, "volume")


def _share(c: str = "close") -> Column:
    before = X.lag(c)
    return F.round(F.col(c) / F.when(before != 0, before) - 1, 10)


def detect_splits(bars: DataFrame, jump: float = JUMP) -> DataFrame:
    """Bars that jump by more than the share, with the ratio that a split would have."""
    b = bars.withColumn("move", _share()).filter(F.abs("move") > jump)
    ratio = F.when(F.col("move") < 0, 1 / F.when(F.col("move") != -1, 1 + F.col("move"))).otherwise(1 + F.col("move"))
    return b.select("sym", "bar_ts", F.round("move", 6).alias("move"), F.round(ratio, 4).alias("ratio"))


def adjust_splits(bars: DataFrame, jump: float = JUMP) -> DataFrame:
    """Bars from each fall on are scaled by its ratio, volumes the other way; rises aren't splits. The
    product runs along with the window."""
    move = _share()
    ratio = F.when(move < -jump, F.round(1 / F.when(move != -1, 1 + move), 4))
    b = bars.withColumn("ratio", ratio).withColumn("factor", F.coalesce(F.product("ratio").over(X.past()), F.lit(1.0)))
    return b.select("sym", "bar_ts", *[(F.col(c) * F.col("factor")).alias(c) for c in PRICES], (F.col("volume") / F.col("factor")).alias("volume"), "factor")


def apply_splits(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Closes before each known split scaled by its ratio (the opposite convention). splits: (sym, bar_ts,
    ratio), few a symbol."""
    s = splits.groupBy("sym").agg(F.array_sort(F.collect_list(F.struct("bar_ts", "ratio"))).alias("splits"))
    b = bars.join(s, "sym", "left")
    later = F.filter(F.coalesce("splits", F.array().cast("array<struct<bar_ts:timestamp,ratio:double>>")), lambda x: x["bar_ts"] > F.col("bar_ts"))
    return b.select("sym", "bar_ts", (F.col("close") * F.aggregate(later, F.lit(1.0), lambda acc, x: acc * x["ratio"])).alias("close"))


def largest_move(bars: DataFrame, most: float = 0.10) -> DataFrame:
    """Largest share moved from close to close, and whether it is within bounds."""
    g = bars.withColumn("move", F.abs(_share())).groupBy("sym").agg(F.max("move").alias("largest"))
    return g.withColumn("smooth", F.coalesce(F.col("largest") <= most, F.lit(True)))


def _flagged(v: DataFrame, k: float, deviations: float) -> DataFrame:
    """Flags of (sym, field, bar_ts, x): two aggregations joined back, none over all rows of one task."""
    keys = ["sym", "field"]
    stats = v.groupBy(*keys).agg(F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3"), F.percentile("x", F.lit(0.5)).alias("med"), F.count("x").alias("n"))
    d = v.join(stats, keys)
    mad = d.groupBy(*keys).agg(F.percentile(F.abs(F.col("x") - F.col("med")), F.lit(0.5)).alias("mad"))
    d = d.join(mad, keys)
    iqr = F.col("q3") - F.col("q1")
    by_iqr = (F.col("n") >= 4) & ((F.col("x") < F.round(F.col("q1") - k * iqr, 8)) | (F.col("x") > F.round(F.col("q3") + k * iqr, 8)))
    by_mad = (F.col("mad") > 0) & (F.round(F.abs(F.col("x") - F.col("med")), 8) > F.round(deviations * MAD_SCALE * F.col("mad"), 8))
    return d.select("sym", "field", "bar_ts", "x", F.coalesce(by_iqr, F.lit(False)).alias("iqr"), F.coalesce(by_mad, F.lit(False)).alias("mad"))


def outliers(bars: DataFrame, col: str = "close", k: float = 1.5, deviations: float = 3.0) -> DataFrame:
    """Flags by quartiles and by median deviation of each symbol's values; fewer than four values have
    no quartile outlier."""
    return _flagged(bars.select("sym", F.lit(col).alias("field"), "bar_ts", F.col(col).alias("x")), k, deviations).drop("field")


def outlier_report(bars: DataFrame, cols: Sequence[str] = NUMBERS, k: float = 1.5, deviations: float = 3.0) -> DataFrame:
    """Numbers of outliers by either rule, by both, and by any, for each symbol and column. The columns are
    turned into rows once, so the bars are read and grouped once for all."""
    v = bars.unpivot(["sym", "bar_ts"], list(cols), "field", "x")
    return _flagged(v, k, deviations).groupBy("sym", "field").agg(F.count_if("iqr").alias("n_iqr"), F.count_if("mad").alias("n_mad"), F.count_if(F.col("iqr") & F.col("mad")).alias("n_both"), F.count_if(F.col("iqr") | F.col("mad")).alias("n_any"))


def winsorized(bars: DataFrame, cols: Sequence[str] = NUMBERS, clip: float = 0.01) -> DataFrame:
    """Each symbol's values held within its outer quantiles (linear interpolation). The quantiles are exact:
    a task holds the distinct values of the symbols that it is dealt, after the map tasks have counted."""
    g = bars.groupBy("sym").agg(*[F.percentile(c, F.lit(q)).alias(f"_{c}_{n}") for c in cols for n, q in (("lo", clip), ("hi", 1 - clip))])
    held = [F.greatest(F.least(F.col(c), F.col(f"_{c}_hi")), F.col(f"_{c}_lo")).alias(c) if c in cols else F.col(c) for c in NUMBERS]
    return bars.join(g, "sym").select("sym", "bar_ts", *held)


def validate(bars: DataFrame) -> DataFrame:
    """Issues of each symbol's bars: negative prices and missing numbers."""
    checks = [(F.count_if(F.col(c) < 0), f"{c}: negative") for c in PRICES] + [(F.count_if(F.col(c).isNull() | F.isnan(c)), f"{c}: missing") for c in NUMBERS]
    g = bars.groupBy("sym").agg(*[n.alias(f"c{i}") for i, (n, _) in enumerate(checks)])
    issues = F.array_compact(F.array(*[F.when(F.col(f"c{i}") > 0, F.concat(F.lit(text + " "), F.col(f"c{i}").cast("string"))) for i, (_, text) in enumerate(checks)]))
    return g.select("sym", issues.alias("issues")).withColumn("passed", F.size("issues") == 0)


def clean(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned bars of the symbols that pass validation, and one row of notes a symbol."""
    checked = validate(bars)
    good = bars.join(checked.filter("passed").select("sym"), "sym", "left_semi")
    adjusted = adjust_splits(good)
    done = winsorized(adjusted.drop("factor"))
    atr = position_sizes(done).select("sym", "atr")
    notes = checked.join(largest_move(adjusted), "sym", "left").join(atr, "sym", "left")
    return done, notes.select("sym", "passed", F.array_join("issues", "; ").alias("reason"), "smooth", "atr")


def atr_series(bars: DataFrame, n: int = 14) -> DataFrame:
    """True range averaged over n bars; null before n + 1 bars."""
    before = X.lag("close")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    b = bars.withColumns({"tr": tr, "idx": F.row_number().over(X.order()) - 1})
    return b.withColumn("atr", F.when(F.col("idx") >= n - 1, X.mean("tr", n))).select("sym", "bar_ts", "idx", "close", "atr")


def position_sizes(bars: DataFrame, risk_pct: float = 1.0, most_pct: float = 25.0, n: int = 14) -> DataFrame:
    """Share of the capital to hold of each symbol so that one range costs `risk_pct` of it. The capital
    cancels out."""
    a = atr_series(bars, n).withColumn("last", F.row_number().over(Window.partitionBy("sym").orderBy(F.desc("bar_ts")))).filter("last = 1")
    ok = (F.col("idx") >= n) & (F.col("atr") > 0) & (F.col("close") > 0)
    size = F.least(F.lit(risk_pct / 100) / F.when(F.col("atr") > 0, F.col("atr")) * F.col("close"), F.lit(most_pct / 100))
    return a.select("sym", F.when(F.col("idx") >= n, F.col("atr")).alias("atr"), F.coalesce(F.when(ok, size), F.lit(0.0)).alias("position"))


def normalized_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Ranges scaled to [0, 1] within each symbol; 0 when they are all alike."""
    a = atr_series(bars, n)
    lo, hi = F.min("atr").over(X.whole()), F.max("atr").over(X.whole())
    return a.select("sym", "bar_ts", F.when(hi - lo < 1e-10, 0.0).otherwise((F.col("atr") - lo) / F.when(hi - lo >= 1e-10, hi - lo)).alias("atr_scaled"))
