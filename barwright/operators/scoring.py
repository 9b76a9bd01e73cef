"""From indicator states to one score a symbol: family votes, direction, confidence, risk, regime."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions import windows as X
from barwright.operators import native, recursive

#: Weights of the families, in the order that breaks ties for the dominant one.
FAMILIES = {"trend": 0.35, "momentum": 0.50, "volume": 0.15}
#: Weights of the older category means.
CATEGORIES = {"momentum": 0.50, "trend": 0.35, "volatility": 0.05, "volume": 0.10}
#: Indicators of risk that don't vote.
RISK_ONLY = ("Bollinger Bands", "ATR", "Donchian Channel")


def family_of(category: Column) -> Column:
    """The family that a category votes in; what is neither momentum nor volume votes with trend."""
    c = F.lower(category)
    return F.when(c.isin("momentum", "volume"), c).otherwise("trend")


def vote_of(state: Column) -> Column:
    s = F.upper(F.coalesce(state, F.lit("HOLD")))
    return F.when(s.isin("BUY", "BULLISH"), 1).when(s.isin("SELL", "BEARISH"), -1).otherwise(0)


def votes(signals: DataFrame, *more: str) -> DataFrame:
    """Directional votes: sym, bar_ts, indicator, family, vote, strength, and more columns."""
    return signals.filter(~F.col("indicator").isin(*RISK_ONLY)).select("sym", "bar_ts", "indicator", family_of(F.col("category")).alias("family"), vote_of(F.col("state")).alias("vote"), F.abs("score").alias("strength"), *more)


def _majority(buy: Column, sell: Column) -> Column:
    return F.when((buy > sell) & (buy >= 2), 1).when((sell > buy) & (sell >= 2), -1).otherwise(0)


def family_votes(v: DataFrame) -> DataFrame:
    """One row a family with any vote: counts, strength (buys less sells over all) and the family's vote."""
    g = v.groupBy("sym", "bar_ts", "family").agg(F.count_if(F.col("vote") > 0).alias("buys"), F.count_if(F.col("vote") < 0).alias("sells"), F.count_if(F.col("vote") == 0).alias("holds"), F.count(F.lit(1)).alias("members"))
    return g.select("*", ((F.col("buys") - F.col("sells")) / F.col("members")).alias("strength"), _majority(F.col("buys"), F.col("sells")).alias("vote"))


def directions(v: DataFrame, *more: str) -> DataFrame:
    """direction (0 to 1), dominant family, consensus and confidence with its parts, in one aggregation; more
    columns, which a bar's votes share or lack, come along."""
    aggs = [F.avg("strength").alias("avg_strength"), *[F.max(c).alias(c) for c in more]]
    for f in FAMILIES:
        mine = F.col("family") == f
        aggs += [F.count_if(mine).alias(f"n_{f}"), F.count_if(mine & (F.col("vote") > 0)).alias(f"b_{f}"), F.count_if(mine & (F.col("vote") < 0)).alias(f"s_{f}")]
    g = v.groupBy("sym", "bar_ts").agg(*aggs)
    strength = {f: F.when(F.col(f"n_{f}") > 0, (F.col(f"b_{f}") - F.col(f"s_{f}")) / F.col(f"n_{f}")) for f in FAMILIES}
    vote = {f: F.when(F.col(f"n_{f}") > 0, _majority(F.col(f"b_{f}"), F.col(f"s_{f}"))) for f in FAMILIES}
    g = g.select("sym", "bar_ts", "avg_strength", *more, *[strength[f].alias(f"strength_{f}") for f in FAMILIES], *[vote[f].alias(f"vote_{f}") for f in FAMILIES])
    present = {f: F.col(f"strength_{f}").isNotNull() for f in FAMILIES}

    def total(pick) -> Column:
        out = F.lit(0.0)
        for f in FAMILIES:
            out = out + F.when(present[f], pick(f)).otherwise(0.0)
        return out

    weight = total(lambda f: F.lit(FAMILIES[f]))
    raw = total(lambda f: F.col(f"strength_{f}") * FAMILIES[f]) / F.when(weight != 0, weight)
    count = total(lambda f: F.lit(1.0))
    ups, downs = total(lambda f: (F.col(f"vote_{f}") > 0).cast("double")), total(lambda f: (F.col(f"vote_{f}") < 0).cast("double"))
    top = F.greatest(*[F.abs(F.col(f"strength_{f}")) for f in FAMILIES])
    least = F.least(*[F.abs(F.col(f"strength_{f}")) for f in FAMILIES])
    dominant = F.coalesce(*[F.when(F.abs(F.col(f"strength_{f}")) == top, f) for f in FAMILIES])
    same = (F.greatest(*[F.col(f"vote_{f}") for f in FAMILIES]) == F.least(*[F.col(f"vote_{f}") for f in FAMILIES]))
    agreement = (
        F.when(count >= 3, F.when(ups >= 2, ups).when(downs >= 2, downs).otherwise(F.greatest(ups, downs)) / count)
        .otherwise(F.when(same, 1.0).otherwise(0.5))
    )
    overall = F.when(ups > downs, 1).when(downs > ups, -1).otherwise(0)
    confirmed = F.col("vote_volume") == overall
    volume = F.when(~present["volume"], 0.5).when(confirmed, 1.0).otherwise(0.2)
    return g.select(
        "sym", "bar_ts", *[f"strength_{f}" for f in FAMILIES], *[f"vote_{f}" for f in FAMILIES],
        F.coalesce((raw + 1) / 2, F.lit(0.5)).alias("direction"), dominant.alias("dominant"), F.when(same, 1.0).otherwise(least).alias("consensus"),
        agreement.alias("agreement"), F.col("avg_strength"), F.coalesce(confirmed, F.lit(False)).alias("volume_confirmed"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * agreement + 0.3 * F.col("avg_strength") + 0.2 * volume)).alias("confidence"), *more,
    )


def risk_multiplier(atr_pct: Column, squeeze: Column, volume_ratio: Column) -> Column:
    """1 without risk, down to 0.5: absolute range in percent, width of the band, unusual volume."""
    atr = F.when(atr_pct < 2, 0.0).when(atr_pct < 5, (atr_pct - 2) / 3).otherwise(F.least(F.lit(1.0), (atr_pct - 5) / 5 + 0.5))
    band = F.when(squeeze < 0.03, 0.9).when(squeeze < 0.08, 0.4).otherwise(0.1)
    vol = F.when(volume_ratio < 2, 0.0).when(volume_ratio < 5, (volume_ratio - 2) / 6).otherwise(F.least(F.lit(1.0), (volume_ratio - 5) / 10 + 0.5))
    return 1 - 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * atr + 0.3 * band + 0.3 * vol))


def squeeze(kernels: DataFrame) -> DataFrame:
    """Width of the Bollinger band over its middle, and the risk multiplier of the nightly path (which
    knows neither the range nor the volume)."""
    return kernels.select("sym", "bar_ts", "idx", "n", *_squeezed())


def _squeezed() -> list[Column]:
    s = F.coalesce(F.when(F.col("sma20") > 0, (F.col("upper") - F.col("lower")) / F.col("sma20")), F.lit(0.05))
    return [F.round(s, 8).alias("squeeze"), risk_multiplier(F.lit(0.0), F.round(s, 8), F.lit(1.0)).alias("risk_multiplier")]


def regimes(index_bars: DataFrame) -> DataFrame:
    """Regime of an index at every bar: sym, bar_ts, regime, regime_score, regime_multiplier. The two
    averages are simple ones; the trend strength is the last unsmoothed DX."""
    k = native.kernels(index_bars)
    dm_up, dm_down = F.greatest(F.col("high") - F.col("prev_high"), F.lit(0.0)), F.greatest(F.col("prev_low") - F.col("low"), F.lit(0.0))
    k = k.withColumns({"up": F.when(dm_up > dm_down, dm_up).otherwise(0.0), "down": F.when(F.col("prev_low").isNotNull(), dm_down).otherwise(0.0)})
    k = k.withColumn("down", F.when(F.col("down") > F.col("up"), F.col("down")).otherwise(0.0))
    k = k.withColumns({"up14": X.mean("up", 14), "down14": X.mean("down", 14)})
    both = F.col("up14") + F.col("down14")
    dx = F.when((F.col("atr14") > 0) & (both > 0), 100 * F.abs(F.col("up14") - F.col("down14")) / F.when(both > 0, both)).otherwise(0.0)
    k = k.withColumns({
        "dx": F.round(F.when(F.col("idx") >= 14, dx).otherwise(0.0), 8),
        "vs50": F.round(F.when(F.col("sma50") > 0, F.col("close") / F.when(F.col("sma50") > 0, F.col("sma50")) - 1).otherwise(0.0), 8),
        "vs200": F.round(F.when(F.col("sma200") > 0, F.col("close") / F.when(F.col("sma200") > 0, F.col("sma200")) - 1).otherwise(0.0), 8),
    })
    trend = (F.col("vs50") + F.col("vs200")) / 2
    known = F.col("idx") >= 49
    regime = F.when(~known | (F.col("dx") < 15), "CHOP").when((F.col("vs50") > 0.02) & (F.col("vs200") > 0.01), "BULL").otherwise("BEAR")
    k = k.withColumn("regime", regime)
    score = F.when(~known, 0.0).when(F.col("regime") == "CHOP", 0.6).when(F.col("regime") == "BULL", F.least(F.lit(1.0), 0.5 + trend * 5)).otherwise(F.least(F.lit(1.0), 0.5 + F.abs(trend) * 3))
    mult = F.when(F.col("regime") == "CHOP", 0.5).when(F.col("regime") == "BULL", 1.0).otherwise(0.7)
    return k.select("sym", "bar_ts", "idx", "n", "regime", score.alias("regime_score"), mult.alias("regime_multiplier"))


def final_score(direction: Column, confidence: Column, risk: Column, regime: Column, social: Column | None = None, options: Column | None = None) -> Column:
    out = (2 * direction - 1) * confidence * risk * regime
    if social is not None:
        out = out + 0.1 * F.coalesce(social, F.lit(0.0))
    if options is not None:
        out = out + 0.05 * F.coalesce(options, F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), out))


def strength_label(score: Column, confidence: Column) -> Column:
    a = F.abs(score)
    return (
        F.when(a < 0.2, "Neutral").when(confidence < 0.4, "Weak").when(a < 0.4, "Moderate")
        .when(a < 0.6, F.when(score > 0, "Bullish").otherwise("Bearish")).otherwise(F.when(score > 0, "Strong Bullish").otherwise("Strong Bearish"))
    )


def action(label: Column) -> Column:
    return F.when(label.isin("Bullish", "Strong Bullish"), "BUY").when(label.isin("Bearish", "Strong Bearish"), "SELL").otherwise("HOLD")


def page_row(scores: DataFrame, compat: bool = False) -> DataFrame:
    """Scores as 0 to 100 columns. compat keeps a published oddity: a selling family's strength, negative
    already, is negated once more, which puts it above 50."""
    def shown(f: str) -> Column:
        s, v = F.col(f"strength_{f}"), F.col(f"vote_{f}")
        value = F.when(v > 0, s).when(v < 0, -s if compat else s).otherwise(0.0)
        return F.round((F.coalesce(value, F.lit(0.0)) + 1) * 50, 4).alias(f)

    return scores.select("sym", F.round((F.col("final_score") + 1) * 50, 4).alias("overall"), F.round((1 - F.col("risk_multiplier")) * 200, 4).alias("volatility"), *[shown(f) for f in FAMILIES], "label", action(F.col("label")).alias("action"))


def score(bars: DataFrame, index_bars: DataFrame | None = None, region: DataFrame | None = None, names: Iterable[str] | None = None, social: DataFrame | None = None, options: DataFrame | None = None) -> DataFrame:
    """The score of each symbol's last bar.

    index_bars: an index's bars for each region (its name as `sym`); region: (sym, region), without it
    the one index holds for all. Regions without an index count as choppy. social, options: (sym,
    social) and (sym, options) in [-1, 1], where known. names: indicators to use, all by default."""
    chosen = set(names) if names is not None else set(native.NATIVE) | set(recursive.RECURSIVE)
    own, rec = [n for n in native.NATIVE if n in chosen], [n for n in recursive.RECURSIVE if n in chosen]
    # the bars are sorted once for the native rows and the width of the band, and once for the rest
    k, risk = native.kernels(bars).filter("idx = n - 1"), ("squeeze", "risk_multiplier")
    carried = [n for n in own if n not in RISK_ONLY]
    rows = native.rows_of(k, carried, *_squeezed()).drop("idx", "n", "open", "close") if carried else None
    if rec:
        more = recursive.signals(bars, rec, last_only=True).drop("idx", "n", "open", "close")
        rows = more if rows is None else rows.unionByName(more, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no indicator that votes")
    if carried:
        out = directions(votes(rows, *risk), *risk)
    else:
        out = directions(votes(rows)).join(squeeze(k).select("sym", *risk), "sym")
    if index_bars is None:
        out = out.withColumns({"regime": F.lit("CHOP"), "regime_multiplier": F.lit(0.5)})
    else:
        last = regimes(index_bars).filter("idx = n - 1").select(F.col("sym").alias("region"), "regime", "regime_multiplier")
        if region is None:
            out = out.crossJoin(F.broadcast(last.drop("region").limit(1)))  # one row
        else:
            out = out.join(region, "sym", "left").join(last, "region", "left")
            out = out.withColumns({"regime": F.coalesce("regime", F.lit("CHOP")), "regime_multiplier": F.coalesce("regime_multiplier", F.lit(0.5))})
    for extra in (social, options):
        if extra is not None:
            out = out.join(extra, "sym", "left")
    fs = F.round(final_score(F.col("direction"), F.col("confidence"), F.col("risk_multiplier"), F.col("regime_multiplier"), F.col("social") if social is not None else None, F.col("options") if options is not None else None), 6)
    out = out.withColumn("final_score", fs)
    return out.withColumns({"label": strength_label(F.col("final_score"), F.col("confidence")), "leaning": F.when(F.col("final_score") > 0, "BULLISH").otherwise("BEARISH")})


def category_summary(signals: DataFrame) -> DataFrame:
    """Means of scores by category, their weighted sum, and counts of states."""
    means = {c: F.avg(F.when(F.col("category") == c, F.col("score"))) for c in CATEGORIES}
    g = signals.groupBy("sym", "bar_ts").agg(*[F.coalesce(m, F.lit(0.0)).alias(f"avg_{c}") for c, m in means.items()], *[F.count_if(F.col("state") == s).alias(f"n_{s.lower()}") for s in ("BUY", "SELL", "HOLD")])
    total = F.lit(0.0)
    for c, w in CATEGORIES.items():
        total = total + F.col(f"avg_{c}") * w
    return g.withColumn("summary_score", F.round(total, 4)).withColumns({f"avg_{c}": F.round(f"avg_{c}", 4) for c in CATEGORIES})


def weighted_score(summary: DataFrame) -> DataFrame:
    """The older 0 to 100 score of the category means."""
    scaled = {c: (F.col(f"avg_{c}") + 1) * 50 for c in CATEGORIES}
    total = F.lit(0.0)
    for c, w in CATEGORIES.items():
        total = total + scaled[c] * w
    return summary.select("sym", "bar_ts", *[F.round(x, 4).alias(f"{c}_100") for c, x in scaled.items()], F.round(total, 6).alias("total_100"))


def quality_filter(rows: DataFrame, price: str, volume: str, cap: str, least_volume: float = 5e5, least_price: float = 1.0, least_cap: float = 5e7) -> DataFrame:
    """passed, and the reasons against; a market value of 0 or null is unknown and passes."""
    known = F.coalesce(F.col(cap), F.lit(0.0))
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.col(price), F.lit(0.0)) < least_price, "price"), F.when(F.coalesce(F.col(volume), F.lit(0.0)) < least_volume, "volume"), F.when((known > 0) & (known < least_cap), "market cap"),
    ))
    return rows.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
