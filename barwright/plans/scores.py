"""Queries of votes, scores and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import native, scoring
from barwright.plans import indicators, sql
from barwright.sources import bars as B

QUERIES, ORACLES = {}, {}
R = F.round
LAST = "WHERE idx = n - 1"


def _native_last(spark, sf_dir):
    return native.signals(B.hourly(spark, sf_dir)).filter("idx = n - 1")


def indicator_votes(spark, sf_dir):
    return scoring.votes(_native_last(spark, sf_dir)).select("sym", "bar_ts", "indicator", "family", "vote", R("strength", 5).alias("strength"))


SIG = f"WITH {sql.HOURLY}, {sql.KERNELS}, {sql.signals_cte(where=LAST)}"
VOTES = f"""{SIG}, v AS (SELECT sym, bar_ts, indicator, CASE WHEN category IN ('momentum', 'volume') THEN category ELSE 'trend' END AS family,
    CASE state WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END AS vote, abs(score) AS strength FROM sig WHERE category <> 'volatility')"""
FAMILY = f"""{VOTES}, f AS (SELECT sym, bar_ts, family, count(*) FILTER (vote > 0) AS buys, count(*) FILTER (vote < 0) AS sells, count(*) FILTER (vote = 0) AS holds, count(*) AS members FROM v GROUP BY ALL),
    fv AS (SELECT *, (buys - sells) / members AS strength, CASE WHEN buys > sells AND buys >= 2 THEN 1 WHEN sells > buys AND sells >= 2 THEN -1 ELSE 0 END AS vote FROM f)"""
DIRECTION = f"""{FAMILY}, s AS (SELECT sym, avg(strength) AS avg_strength FROM v GROUP BY 1),
    w AS (SELECT *, CASE family WHEN 'trend' THEN 0.35 WHEN 'momentum' THEN 0.50 ELSE 0.15 END AS weight, CASE family WHEN 'trend' THEN 1 WHEN 'momentum' THEN 2 ELSE 3 END AS ord FROM fv),
    d AS (SELECT sym, bar_ts, (sum(strength * weight) / sum(weight) + 1) / 2 AS direction, arg_max(family, (abs(strength), -ord)) AS dominant,
        CASE WHEN count(DISTINCT vote) = 1 THEN 1.0 ELSE min(abs(strength)) END AS consensus, count(*) AS fams, count(*) FILTER (vote > 0) AS ups, count(*) FILTER (vote < 0) AS downs,
        count(DISTINCT vote) = 1 AS same, max(CASE WHEN family = 'volume' THEN vote END) AS vol,
        max(strength) FILTER (family = 'trend') AS strength_trend, max(strength) FILTER (family = 'momentum') AS strength_momentum, max(strength) FILTER (family = 'volume') AS strength_volume,
        max(vote) FILTER (family = 'trend') AS vote_trend, max(vote) FILTER (family = 'momentum') AS vote_momentum, max(vote) FILTER (family = 'volume') AS vote_volume FROM w GROUP BY 1, 2),
    c AS (SELECT d.*, avg_strength, CASE WHEN fams >= 3 THEN CASE WHEN ups >= 2 THEN ups WHEN downs >= 2 THEN downs ELSE greatest(ups, downs) END / fams WHEN same THEN 1.0 ELSE 0.5 END AS agreement,
        CASE WHEN vol IS NULL THEN 0.5 WHEN vol = CASE WHEN ups > downs THEN 1 WHEN downs > ups THEN -1 ELSE 0 END THEN 1.0 ELSE 0.2 END AS vf FROM d JOIN s USING (sym)),
    cc AS (SELECT *, greatest(0.0, least(1.0, 0.5 * agreement + 0.3 * avg_strength + 0.2 * vf)) AS confidence FROM c)"""
RISK = """risk AS (SELECT sym, round(coalesce(CASE WHEN sma20 > 0 THEN (upper - lower) / sma20 END, 0.05), 8) AS squeeze FROM k3 WHERE idx = n - 1),
    rm AS (SELECT sym, squeeze, 1 - 0.5 * 0.3 * CASE WHEN squeeze < 0.03 THEN 0.9 WHEN squeeze < 0.08 THEN 0.4 ELSE 0.1 END AS risk_multiplier FROM risk)"""

QUERIES["indicator_votes"] = indicator_votes
ORACLES["indicator_votes"] = f"{VOTES} SELECT sym, bar_ts, indicator, family, vote, round(strength, 5) AS strength FROM v"


def family_votes(spark, sf_dir):
    return scoring.family_votes(scoring.votes(_native_last(spark, sf_dir))).select("sym", "bar_ts", "family", "buys", "sells", "holds", "members", R("strength", 6).alias("strength"), "vote")


QUERIES["family_votes"] = family_votes
ORACLES["family_votes"] = f"{FAMILY} SELECT sym, bar_ts, family, buys, sells, holds, members, round(strength, 6) AS strength, vote FROM fv"


def direction(spark, sf_dir):
    d = scoring.directions(scoring.votes(_native_last(spark, sf_dir)))
    return d.select("sym", "bar_ts", R("direction", 6).alias("direction"), "dominant", R("consensus", 6).alias("consensus"))


QUERIES["direction"] = direction
ORACLES["direction"] = f"{DIRECTION} SELECT sym, bar_ts, round(direction::DOUBLE, 6) AS direction, dominant, round(consensus::DOUBLE, 6) AS consensus FROM cc"


def confidence(spark, sf_dir):
    d = scoring.directions(scoring.votes(_native_last(spark, sf_dir)))
    return d.select("sym", R("agreement", 6).alias("agreement"), R("avg_strength", 5).alias("avg_strength"), "volume_confirmed", R("confidence", 5).alias("confidence"))


QUERIES["confidence"] = confidence
ORACLES["confidence"] = f"{DIRECTION} SELECT sym, round(agreement::DOUBLE, 6) AS agreement, round(avg_strength, 5) AS avg_strength, vf = 1.0 AS volume_confirmed, round(confidence::DOUBLE, 5) AS confidence FROM cc"


def risk(spark, sf_dir):
    return scoring.squeeze(native.kernels(B.hourly(spark, sf_dir))).filter("idx = n - 1").select("sym", R("squeeze", 6).alias("squeeze"), R("risk_multiplier", 6).alias("risk_multiplier"))


QUERIES["risk"] = risk
ORACLES["risk"] = f"WITH {sql.HOURLY}, {sql.KERNELS}, {RISK} SELECT sym, round(squeeze, 6) AS squeeze, round(risk_multiplier::DOUBLE, 6) AS risk_multiplier FROM rm"


def risk_bands(spark, sf_dir):
    """The whole multiplier over lines of three measures."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", R(scoring.risk_multiplier(F.col("l_quantity") / 6, F.col("l_discount"), F.col("l_tax") * 100), 6).alias("risk_multiplier"))


QUERIES["risk_bands"] = risk_bands
ORACLES["risk_bands"] = """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity / 6 AS a, l_discount AS s, l_tax * 100 AS v FROM lineitem),
    y AS (SELECT *, CASE WHEN a < 2 THEN 0 WHEN a < 5 THEN (a - 2) / 3 ELSE least(1.0, (a - 5) / 5 + 0.5) END AS ar, CASE WHEN s < 0.03 THEN 0.9 WHEN s < 0.08 THEN 0.4 ELSE 0.1 END AS br,
        CASE WHEN v < 2 THEN 0 WHEN v < 5 THEN (v - 2) / 6 ELSE least(1.0, (v - 5) / 10 + 0.5) END AS vr FROM x)
    SELECT l_orderkey, l_linenumber, round(1 - 0.5 * greatest(0.0, least(1.0, 0.4 * ar + 0.3 * br + 0.3 * vr)::DOUBLE), 6) AS risk_multiplier FROM y"""


def index_bars(bars):
    """One index over all symbols: the means of their bars."""
    return bars.groupBy("bar_ts").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume")).withColumn("sym", F.lit("ALL"))


def regime(spark, sf_dir):
    return scoring.regimes(index_bars(B.daily_by_nation(spark, sf_dir))).select("bar_ts", "regime", R("regime_score", 9).alias("regime_score"), "regime_multiplier")


REGIME = f"""ibars AS (SELECT 'ALL' AS sym, bar_ts, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close, sum(volume) AS volume FROM bars GROUP BY bar_ts),
    i0 AS (SELECT *, row_number() OVER ({sql.W}) - 1 AS idx, count(*) OVER () AS n, {sql.lag('close')} AS pc, {sql.lag('high')} AS ph, {sql.lag('low')} AS pl FROM ibars),
    i1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, coalesce(greatest(high - ph, 0), 0) AS u0, coalesce(greatest(pl - low, 0), 0) AS d0 FROM i0),
    i2 AS (SELECT *, CASE WHEN u0 > d0 THEN u0 ELSE 0.0 END AS up FROM i1), i3 AS (SELECT *, CASE WHEN d0 > up THEN d0 ELSE 0.0 END AS dn FROM i2),
    i4 AS (SELECT *, {sql.roll('avg', 'tr', 14)} AS atr, {sql.roll('avg', 'up', 14)} AS u14, {sql.roll('avg', 'dn', 14)} AS d14, {sql.roll('avg', 'close', 50)} AS s50, {sql.roll('avg', 'close', 200)} AS s200 FROM i3),
    i5 AS (SELECT *, round(CASE WHEN idx >= 14 AND atr > 0 AND u14 + d14 > 0 THEN 100 * abs(u14 - d14) / (u14 + d14) ELSE 0 END, 8) AS dx, round(coalesce(CASE WHEN s50 > 0 THEN close / s50 - 1 END, 0), 8) AS v50, round(coalesce(CASE WHEN s200 > 0 THEN close / s200 - 1 END, 0), 8) AS v200 FROM i4),
    i6 AS (SELECT *, CASE WHEN idx < 49 OR dx < 15 THEN 'CHOP' WHEN v50 > 0.02 AND v200 > 0.01 THEN 'BULL' ELSE 'BEAR' END AS regime FROM i5),
    ireg AS (SELECT *, CASE WHEN idx < 49 THEN 0.0 WHEN regime = 'CHOP' THEN 0.6 WHEN regime = 'BULL' THEN least(1.0, 0.5 + (v50 + v200) / 2 * 5) ELSE least(1.0, 0.5 + abs((v50 + v200) / 2) * 3) END AS regime_score,
        CASE regime WHEN 'CHOP' THEN 0.5 WHEN 'BULL' THEN 1.0 ELSE 0.7 END AS regime_multiplier FROM i6)"""
QUERIES["regime"] = regime
ORACLES["regime"] = f"WITH {sql.NATION}, {REGIME} SELECT bar_ts, regime, round(regime_score::DOUBLE, 9) AS regime_score, regime_multiplier::DOUBLE AS regime_multiplier FROM ireg"

SCORE_COLS = ("sym", "final_score", "direction", "confidence", "risk_multiplier", "regime", "label", "leaning")


def _shown(df):
    return df.select("sym", R("final_score", 5).alias("final_score"), R("direction", 5).alias("direction"), R("confidence", 5).alias("confidence"), R("risk_multiplier", 5).alias("risk_multiplier"), "regime", "label", "leaning")


def final_score(spark, sf_dir):
    """All 31 voting indicators, ranked by score."""
    bars = B.hourly(spark, sf_dir)
    return _shown(scoring.score(bars, index_bars(bars))).orderBy(F.desc("final_score"), "sym")


def final_score_native(spark, sf_dir):
    """The same path over the indicators that are window expressions."""
    bars = B.hourly(spark, sf_dir)
    return _shown(scoring.score(bars, index_bars(bars), names=native.NATIVE))


FINAL = f"""{DIRECTION}, {RISK}, {REGIME}, fs AS (
    SELECT cc.*, risk_multiplier, regime, round(greatest(-1.0, least(1.0, (2 * direction - 1) * confidence * risk_multiplier * regime_multiplier)), 6) AS final_score
    FROM cc JOIN rm USING (sym) CROSS JOIN (SELECT regime, regime_multiplier FROM ireg WHERE idx = n - 1) g),
    ranked AS (SELECT *, CASE WHEN abs(final_score) < 0.2 THEN 'Neutral' WHEN confidence < 0.4 THEN 'Weak' WHEN abs(final_score) < 0.4 THEN 'Moderate' WHEN abs(final_score) < 0.6 THEN CASE WHEN final_score > 0 THEN 'Bullish' ELSE 'Bearish' END
        ELSE CASE WHEN final_score > 0 THEN 'Strong Bullish' ELSE 'Strong Bearish' END END AS label, CASE WHEN final_score > 0 THEN 'BULLISH' ELSE 'BEARISH' END AS leaning FROM fs)"""
QUERIES["final_score"] = final_score
QUERIES["final_score_native"] = final_score_native
ORACLES["final_score_native"] = f"{FINAL} SELECT sym, round(final_score::DOUBLE, 5) AS final_score, round(direction::DOUBLE, 5) AS direction, round(confidence::DOUBLE, 5) AS confidence, round(risk_multiplier::DOUBLE, 5) AS risk_multiplier, regime, label, leaning FROM ranked"

_ALL = f"""sig1 AS (SELECT sym, bar_ts, indicator, category, state, score FROM sig), lastbar AS (SELECT DISTINCT sym, bar_ts FROM sig), sig2 AS (SELECT * FROM sig1 UNION ALL {indicators.last_rows_sql()}),"""
ORACLES["final_score"] = ORACLES["final_score_native"].replace("v AS (SELECT sym, bar_ts, indicator,", f"{_ALL} v AS (SELECT sym, bar_ts, indicator,", 1).replace("abs(score) AS strength FROM sig WHERE category <> 'volatility'", f"abs(score) AS strength FROM sig2 WHERE indicator NOT IN {scoring.RISK_ONLY!r}", 1)


def page_rows(spark, sf_dir):
    bars = B.hourly(spark, sf_dir)
    return scoring.page_row(scoring.score(bars, index_bars(bars), names=native.NATIVE)).select("sym", *[R(c, 3).alias(c) for c in ("overall", "volatility", "trend", "momentum", "volume")], "label", "action")


def _family_cell(f):
    return f"round((CASE vote_{f} WHEN 1 THEN strength_{f} WHEN -1 THEN strength_{f} ELSE 0.0 END::DOUBLE + 1) * 50, 3) AS {f}"


QUERIES["page_rows"] = page_rows
ORACLES["page_rows"] = f"""{FINAL} SELECT sym, round((final_score + 1) * 50, 3) AS overall, round(((1 - risk_multiplier) * 200)::DOUBLE, 3) AS volatility, {_family_cell('trend')}, {_family_cell('momentum')}, {_family_cell('volume')}, label,
    CASE WHEN label IN ('Bullish', 'Strong Bullish') THEN 'BUY' WHEN label IN ('Bearish', 'Strong Bearish') THEN 'SELL' ELSE 'HOLD' END AS action FROM ranked"""


def signal_summary(spark, sf_dir):
    s = scoring.category_summary(_native_last(spark, sf_dir))
    return s.select("sym", *[R(c, 3).alias(c) for c in ("avg_momentum", "avg_trend", "avg_volatility", "avg_volume", "summary_score")], "n_buy", "n_sell", "n_hold")


SUMMARY = f"""{SIG}, m AS (SELECT sym, coalesce(avg(score) FILTER (category = 'momentum'), 0) AS am, coalesce(avg(score) FILTER (category = 'trend'), 0) AS at_, coalesce(avg(score) FILTER (category = 'volatility'), 0) AS av, coalesce(avg(score) FILTER (category = 'volume'), 0) AS au,
    count(*) FILTER (state = 'BUY') AS n_buy, count(*) FILTER (state = 'SELL') AS n_sell, count(*) FILTER (state = 'HOLD') AS n_hold FROM sig GROUP BY 1)"""
QUERIES["signal_summary"] = signal_summary
ORACLES["signal_summary"] = f"{SUMMARY} SELECT sym, round(round(am, 4), 3) AS avg_momentum, round(round(at_, 4), 3) AS avg_trend, round(round(av, 4), 3) AS avg_volatility, round(round(au, 4), 3) AS avg_volume, round(round(am * 0.5 + at_ * 0.35 + av * 0.05 + au * 0.1, 4), 3) AS summary_score, n_buy, n_sell, n_hold FROM m"


def weighted_score(spark, sf_dir):
    w = scoring.weighted_score(scoring.category_summary(_native_last(spark, sf_dir)))
    return w.select("sym", *[R(c, 3).alias(c) for c in ("momentum_100", "trend_100", "volatility_100", "volume_100")], R("total_100", 6).alias("total_100"))


QUERIES["weighted_score"] = weighted_score
ORACLES["weighted_score"] = f"""{SUMMARY}, r AS (SELECT sym, round((round(am, 4) + 1) * 50, 4) AS a, round((round(at_, 4) + 1) * 50, 4) AS b, round((round(av, 4) + 1) * 50, 4) AS c, round((round(au, 4) + 1) * 50, 4) AS d FROM m)
    SELECT sym, round(a, 3) AS momentum_100, round(b, 3) AS trend_100, round(c, 3) AS volatility_100, round(d, 3) AS volume_100, round((a * 0.5 + b * 0.35 + c * 0.05 + d * 0.1)::DOUBLE, 6) AS total_100 FROM r"""


def quality_filter(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_retailprice") / 1000).alias("price"), (F.col("p_size") * 20000.0).alias("volume"), (F.col("p_retailprice") * 50000 * (F.col("p_size") % 3)).alias("cap"))
    out = scoring.quality_filter(p, "price", "volume", "cap")
    return out.select("p_partkey", F.concat_ws(",", "reasons").alias("reasons"), "passed")


QUERIES["quality_filter"] = quality_filter
ORACLES["quality_filter"] = """
    WITH x AS (SELECT p_partkey, p_retailprice / 1000 AS price, p_size * 20000.0 AS volume, p_retailprice * 50000 * (p_size % 3) AS cap FROM part),
    y AS (SELECT p_partkey, concat_ws(',', CASE WHEN price < 1.0 THEN 'price' END, CASE WHEN volume < 5e5 THEN 'volume' END, CASE WHEN cap > 0 AND cap < 5e7 THEN 'market cap' END) AS reasons FROM x)
    SELECT p_partkey, reasons, reasons = '' AS passed FROM y"""
