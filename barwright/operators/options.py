"""Options chains and fundamentals: max pain, gamma exposure, put/call ratio, bias; banded scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strikes looked at, as multiples of the price.
BAND = (0.1, 3.0)

# A chain is (sym, side 'call' or 'put', strike, oi, volume); spots are (sym, price).


def _by_strike(chain: DataFrame) -> DataFrame:
    """Open interest a side and strike; of a strike listed twice the row with the larger volume counts."""
    pick = {s: F.max_by(F.when(F.col("side") == s, F.col("oi")), F.when(F.col("side") == s, F.struct("volume", "oi"))) for s in ("call", "put")}
    return chain.groupBy("sym", "strike").agg(F.coalesce(pick["call"], F.lit(0.0)).alias("call_oi"), F.coalesce(pick["put"], F.lit(0.0)).alias("put_oi"))


def max_pain(chain: DataFrame, spots: DataFrame) -> DataFrame:
    """The strike in band at which buyers would be paid least, the lowest of equals; the price itself
    without such a strike. Written with running sums over the strikes instead of all pairs:
    calls below a strike pay (strike * sum oi - sum strike * oi), puts above it the other way."""
    b = _by_strike(chain)
    w = Window.partitionBy("sym").orderBy("strike")
    below, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("sym")
    co, cs = F.sum("call_oi").over(below), F.sum(F.col("call_oi") * F.col("strike")).over(below)
    po = F.sum("put_oi").over(whole) - F.sum("put_oi").over(below)
    ps = F.sum(F.col("put_oi") * F.col("strike")).over(whole) - F.sum(F.col("put_oi") * F.col("strike")).over(below)
    paid = b.select("sym", "strike", F.round(F.col("strike") * co - cs + ps - F.col("strike") * po, 4).alias("pain"))
    inside = paid.join(spots, "sym").filter((F.col("strike") >= BAND[0] * F.col("price")) & (F.col("strike") <= BAND[1] * F.col("price")))
    best = inside.groupBy("sym").agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"))
    return spots.join(best, "sym", "left").select("sym", F.coalesce("max_pain", "price").alias("max_pain"))


def gamma_exposure(chain: DataFrame, spots: DataFrame) -> DataFrame:
    """Net exposure of calls over puts, weighted by nearness to the price, and the first strike at which
    its running sum, with the strike's own part counted once more, changes sign."""
    near = F.exp(-0.5 * F.pow(F.abs(F.col("strike") - F.col("price")) / F.col("price") * 10, F.lit(2.0)))
    b = _by_strike(chain).join(spots, "sym").filter((F.col("strike") >= BAND[0] * F.col("price")) & (F.col("strike") <= BAND[1] * F.col("price")))
    b = b.withColumn("net", (F.greatest("call_oi", F.lit(0.0)) - F.greatest("put_oi", F.lit(0.0))) * near)
    run = F.round(F.sum("net").over(Window.partitionBy("sym").orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)), 6)
    b = b.withColumn("run", run)
    again = F.round(F.col("run") + F.col("net"), 6)
    turns = ((F.col("run") > 0) & (again <= 0)) | ((F.col("run") < 0) & (again >= 0))
    g = b.groupBy("sym").agg(F.sum("net").alias("net_gamma"), F.min(F.when(turns, F.col("strike"))).alias("flip"))
    return spots.select("sym").join(g, "sym", "left").select("sym", F.coalesce("net_gamma", F.lit(0.0)).alias("net_gamma"), F.coalesce("flip", F.lit(0.0)).alias("flip"))


def put_call(chain: DataFrame) -> DataFrame:
    """Volume of puts over calls, 0 without calls."""
    calls, puts = (F.sum(F.when(F.col("side") == s, F.col("volume")).otherwise(0.0)) for s in ("call", "put"))
    g = chain.groupBy("sym").agg(calls.alias("c"), puts.alias("p"))
    return g.select("sym", F.when(F.col("c") != 0, F.col("p") / F.when(F.col("c") != 0, F.col("c"))).otherwise(0.0).alias("put_call"))


def bias(chain: DataFrame, spots: DataFrame, days: Column) -> DataFrame:
    """Direction and confidence that a chain suggests. days: days to expiration, over the spots' columns."""
    j = spots.withColumn("days", days).join(max_pain(chain, spots), "sym").join(gamma_exposure(chain, spots), "sym").join(put_call(chain), "sym", "left")
    off = F.abs(F.col("price") - F.col("max_pain")) / F.col("price") * 100
    pull = F.when(off > 0, (F.col("max_pain") - F.col("price")) / F.col("price") * F.least(off / 10, F.lit(1.0)) * 0.4).otherwise(0.0)
    pc = F.coalesce("put_call", F.lit(0.0))
    crowd = F.when(pc > 0, (1 - pc) * 0.15 * 0.25).otherwise(0.0)
    total = pull + F.signum("net_gamma") * 0.05 * 0.35 + crowd
    sure = F.when(off > 0, 0.1).otherwise(0.0) + F.when(F.col("net_gamma") != 0, 0.1).otherwise(0.0) + F.when(pc > 0, 0.1).otherwise(0.0) + F.when(F.col("days") <= 7, 0.2).when(F.col("days") <= 14, 0.1).otherwise(0.0)
    return j.select("sym", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)).alias("bias"), F.least(sure, F.lit(1.0)).alias("confidence"), off.alias("off_max_pain"), "max_pain", "net_gamma", F.when(F.col("flip") > 0, F.col("flip")).alias("flip"), pc.alias("put_call"))


def nearest_weekly(expirations: DataFrame, today: Column) -> DataFrame:
    """The next Friday expiration within 30 days, else the first listed. expirations: (sym, expiration)."""
    days = F.datediff("expiration", today)
    friday = F.when((days > 0) & (days <= 30) & (F.weekday("expiration") == 4), F.col("expiration"))
    g = expirations.groupBy("sym").agg(F.min(friday).alias("friday"), F.min("expiration").alias("first"))
    picked = F.coalesce("friday", "first")
    return g.select("sym", picked.alias("expiration"), F.greatest(F.lit(0), F.datediff(picked, today)).alias("days"))


# ---- fundamentals ---------------------------------------------------------------------------------

#: Field -> (weight, lower is better, bounds, points for each band, values that count).
#: Returns on equity are compared in percent, growth and margins as shares, as published.
BANDS = {
    "pe": (0.20, True, (15.0, 25.0, 35.0), (0.20, 0.15, 0.08, 0.02), "> 0"),
    "roe": (0.20, False, (20.0, 15.0, 10.0), (0.20, 0.15, 0.08, 0.02), "> 0"),
    "growth": (0.20, False, (0.20, 0.10, 0.05), (0.20, 0.15, 0.08, 0.02), "any"),
    "margin": (0.15, False, (0.20, 0.15, 0.10), (0.15, 0.12, 0.06, 0.01), "> 0"),
    "debt": (0.15, True, (0.3, 0.5, 1.0), (0.15, 0.12, 0.06, 0.01), ">= 0"),
    "peg": (0.10, True, (0.5, 1.0, 1.5), (0.10, 0.08, 0.04, 0.01), "> 0"),
}


def number(col: str) -> Column:
    """A finite number or null."""
    x = F.expr(f"try_cast({col} as double)")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def fundamentals(rows: DataFrame, least: float = 0.3) -> DataFrame:
    """Points over the weights of the fields that are there, a label, and the share of fields filled."""
    points, weights, filled = F.lit(0.0), F.lit(0.0), F.lit(0)
    for f, (w, low, bounds, pts, valid) in BANDS.items():
        x = number(f)
        counts = x.isNotNull() & {"> 0": x > 0, ">= 0": x >= 0, "any": F.lit(True)}[valid]
        band = F.lit(pts[-1])
        for limit, p in reversed(list(zip(bounds, pts, strict=False))):
            band = F.when((x < limit) if low else (x > limit), p).otherwise(band)
        points = points + F.when(counts, band).otherwise(0.0)
        weights = weights + F.when(counts, w).otherwise(0.0)
        filled = filled + x.isNotNull().cast("int")
    score = F.when(weights > 0, points / F.when(weights > 0, weights)).otherwise(0.0)
    out = rows.withColumns({"score": F.round(score, 6), "filled": filled})
    label = F.when(F.col("filled") == 0, "UNKNOWN").when(F.col("score") >= 0.7, "STRONG").when(F.col("score") >= 0.5, "GOOD").when(F.col("score") >= least, "FAIR").otherwise("WEAK")
    out = out.withColumn("label", label)
    return out.withColumn("rejected", F.when(F.col("label") == "WEAK", "low score").when(F.col("label") == "UNKNOWN", "no data"))


def meme_score(rows: DataFrame) -> DataFrame:
    """Points for bullish talk, short interest, short ratio and volume; 50 make a meme. rows: sym,
    sentiment (0 to 1), short_interest, short_ratio, volume, avg_volume."""
    usual = F.when(F.coalesce("avg_volume", F.lit(0.0)) > 0, F.col("avg_volume")).when(F.col("volume") > 0, F.col("volume")).otherwise(1.0)
    bull = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce("sentiment", F.lit(0.5)) * 100))
    short, spike = F.greatest(F.coalesce("short_interest", F.lit(0.0)), F.lit(0.0)), F.coalesce("volume", F.lit(0.0)) / usual
    score = F.when(bull > 70, 35.0).otherwise(0.0) + F.when(short > 20, 25.0).otherwise(0.0) + F.when(F.coalesce("short_ratio", F.lit(0.0)) > 5, 20.0).otherwise(0.0) + F.when(spike > 3, 20.0).otherwise(0.0)
    return rows.select(F.upper("sym").alias("sym"), score.alias("meme_score"), (score >= 50).alias("is_meme"), F.round(bull, 1).alias("bull_pct"), F.round(spike, 2).alias("volume_spike"))
