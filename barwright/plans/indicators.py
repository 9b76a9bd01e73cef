"""Queries of bars and indicators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwright.operators import native, recursive
from barwright.plans import sql
from barwright.sources import bars as B

QUERIES, ORACLES = {}, {}


def _bars(name, build, cte):
    def query(spark, sf_dir):
        return build(spark, sf_dir).select("sym", "bar_ts", *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close", "volume")])

    QUERIES[name] = query
    ORACLES[name] = f"WITH {cte} SELECT sym, bar_ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume FROM bars"


_bars("bars_hourly", B.hourly, sql.HOURLY)
_bars("bars_daily_nation", B.daily_by_nation, sql.NATION)
_bars("bars_daily_brand", B.daily_by_brand, sql.BRAND)

KEYS = {
    "rsi": "RSI", "stochastic": "Stochastic", "williams_r": "Williams %R", "cci": "CCI", "roc": "ROC", "adx": "ADX", "ichimoku": "Ichimoku",
    "bollinger": "Bollinger Bands", "donchian": "Donchian Channel", "atr": "ATR", "obv": "OBV", "mfi": "MFI", "vwap": "VWAP",
}
for _key, _name in KEYS.items():
    QUERIES[_key] = lambda spark, sf_dir, n=_name: native.indicator(B.hourly(spark, sf_dir), n)
    ORACLES[_key] = sql.indicator(_name)

PAST = "OVER (PARTITION BY sym ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _ewm(col: str, span: int, adjust: bool = False) -> str:
    """Exponential mean of a column up to each row."""
    a = 2.0 / (span + 1)
    if not adjust:
        return f"list_reduce(list({col}) {PAST}, lambda acc, x: {a!r}::DOUBLE * x + {1 - a!r}::DOUBLE * acc)"
    num = f"list_reduce(list({col}) {PAST}, lambda acc, x: x + {1 - a!r}::DOUBLE * acc)"
    den = f"list_reduce(list(1.0::DOUBLE) {PAST}, lambda acc, x: x + {1 - a!r}::DOUBLE * acc)"
    return f"({num}) / ({den})"


def _recursive(key, name, oracle=None):
    def query(spark, sf_dir):
        out = recursive.indicator(B.hourly(spark, sf_dir), name)
        return out.select("sym", "bar_ts", "state", (F.round("score", 5) + 0.0).alias("score"))

    QUERIES[key] = query
    if oracle:
        ORACLES[key] = oracle


def _ema_sql(span: int) -> str:
    return f"""WITH {sql.HOURLY}, e AS (SELECT *, row_number() OVER ({sql.W}) AS k, {_ewm('close', span)} AS ema FROM bars)
        SELECT sym, bar_ts, CASE WHEN k < {span} THEN 'HOLD' WHEN close > ema THEN 'BUY' WHEN close < ema THEN 'SELL' ELSE 'HOLD' END AS state,
               round(CASE WHEN k < {span} OR close = ema THEN 0.0 ELSE {sql.clamp('(close - ema) / nullif(close, 0) * 2')} END::DOUBLE, 5) + 0.0::DOUBLE AS score FROM e"""


for _span in (9, 21, 50, 200):
    _recursive(f"ema{_span}", f"EMA{_span}", _ema_sql(_span))

_recursive("ema_cross", "EMA9/21", f"""
    WITH {sql.HOURLY}, e AS (SELECT *, {_ewm('close', 9)} AS f, {_ewm('close', 21)} AS s FROM bars),
    p AS (SELECT *, lag(f) OVER ({sql.W}) AS pf, lag(s) OVER ({sql.W}) AS ps FROM e),
    q AS (SELECT *, pf <= ps AND f > s AS up, pf >= ps AND f < s AS down, (f - s) / (f + s) * 2 AS rel FROM p)
    SELECT sym, bar_ts, CASE WHEN pf IS NULL THEN 'HOLD' WHEN f > s THEN 'BUY' ELSE 'SELL' END AS state,
           round(CASE WHEN pf IS NULL THEN 0.0 WHEN up THEN 0.8 WHEN down THEN -0.8 WHEN f > s THEN least(rel, 0.6) ELSE greatest(rel, -0.6) END::DOUBLE, 5) + 0.0::DOUBLE AS score FROM q""")

_recursive("macd", "MACD", f"""
    WITH {sql.HOURLY}, e AS (SELECT *, {_ewm('close', 12, True)} - {_ewm('close', 26, True)} AS line FROM bars),
    g AS (SELECT *, {_ewm('line', 9, True)} AS sig FROM e), h AS (SELECT *, line - sig AS hist, abs(line + sig) AS size FROM g)
    SELECT sym, bar_ts, CASE WHEN hist > 0 THEN 'BUY' WHEN hist < 0 THEN 'SELL' ELSE 'HOLD' END AS state,
           round(CASE WHEN hist = 0 THEN 0.0 WHEN size = 0 THEN 0.5 * sign(hist) ELSE greatest(-1.0, least(1.0, hist / size)) END::DOUBLE, 5) + 0.0::DOUBLE AS score FROM h""")

_recursive("supertrend", "Supertrend", f"""
    WITH {sql.HOURLY}, {sql.KERNELS}, l AS (SELECT *, list(tr) {PAST} AS trs FROM k1),
    a AS (SELECT *, CASE WHEN idx < 10 THEN list_avg(trs) ELSE list_reduce(list_prepend(list_avg(trs[1:10]), trs[11:]), lambda acc, x: x / 10 + acc * 0.9) END AS atr FROM l),
    b AS (SELECT *, (high + low) / 2 + 3 * atr AS up, (high + low) / 2 - 3 * atr AS lo FROM a)
    SELECT sym, bar_ts, CASE WHEN close > lo THEN 'BUY' ELSE 'SELL' END AS state,
           round({sql.clamp('CASE WHEN close > lo THEN (close - lo) / (up - lo + 1) ELSE -(up - close) / (up - lo + 1) END')}, 5) + 0.0::DOUBLE AS score FROM b""")

for _key, _name in {
    "parabolic_sar": "Parabolic SAR", "autotrend": "AutoTrend", "fractals": "AutoFractal", "double_top_bottom": "DoubleTopBottom", "head_shoulders": "HeadShoulders", "wedge": "WedgePattern",
    "pattern_combined": "PatternDetector", "echo_chamber": "EchoChamber", "rube_goldberg": "RubeGoldberg", "chimera": "Chimera",
}.items():
    _recursive(_key, _name)


def cup_handle(spark, sf_dir):
    """Over bars whose shapes repeat: a made cup every 48 bars on top of the hourly closes' hundredths."""
    out = recursive.indicator(_shaped(B.hourly(spark, sf_dir)), "CupAndHandle")
    return out.select("sym", "bar_ts", "state", (F.round("score", 5) + 0.0).alias("score"))


#: A cup with its handle: rim, bowl, rim, a dip with one deep low, a spike and what follows, a level a bar.
CUP = [100, 101, 102, 103, 104, 105, 104, 102, 100, 98, 96, 95, 94, 93, 92, 91, 90, 91, 92, 93, 94, 95, 97, 99, 101, 103, 104, 105, 104, 103.4, 103.2, 103.1, 103, 103, 103, 104.3, 103.2, 103, 103, 103, 103.2, 104.2, 104.3, 104.3, 104.2, 103, 102, 101]
DEEP = 34


def _shaped(bars):
    at = (F.row_number().over(Window.partitionBy("sym").orderBy("bar_ts")) - 1) % len(CUP)
    level = F.element_at(F.array(*[F.lit(float(x)) for x in CUP]), (at + 1).cast("int")) + F.col("close") % 1 / 100
    shaped = bars.withColumns({"close": level, "at": at})
    return shaped.withColumns({"open": F.col("close"), "high": F.col("close") + 0.1, "low": F.col("close") - F.when(F.col("at") == DEEP, 3.0).otherwise(0.1)}).drop("at")


QUERIES["cup_handle"] = cup_handle


def ufvg(spark, sf_dir):
    out = recursive.indicator(B.daily_by_nation(spark, sf_dir), "UnFairValueGap")
    return out.select("sym", "bar_ts", "state", (F.round("score", 5) + 0.0).alias("score"))


QUERIES["ufvg"] = ufvg

#: Bars of the reference series that patterns are looked for in.
REFERENCE = 150


def match_finder(spark, sf_dir):
    """Every symbol's closes against the first bars of one symbol, which come to the driver."""
    bars = B.hourly(spark, sf_dir)
    ref = [r.close for r in bars.filter("sym = 'view'").orderBy("bar_ts").limit(REFERENCE).select("close").collect()]
    rule = {"MatchFinder": (native.TREND, recursive.match({"view": ref}))}
    out = recursive.signals(bars, ["MatchFinder"], rule)
    return out.select("sym", "bar_ts", "state", (F.round("score", 5) + 0.0).alias("score"))


QUERIES["match_finder"] = match_finder
ORACLES["match_finder"] = f"""WITH {sql.HOURLY}, n AS (SELECT sym, bar_ts, close, row_number() OVER ({sql.W}) - 1 AS i FROM bars),
    ref AS (SELECT i, close FROM n WHERE sym = 'view' AND i < {REFERENCE}), len AS (SELECT count(*) AS k FROM ref),
    k AS (SELECT sym, i, list(close) OVER ({sql.W.replace('bar_ts', 'i')} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS x FROM n UNION ALL SELECT '(ref)', i, list(close) OVER (ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) FROM ref),
    u AS (SELECT sym, i, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM k WHERE i >= 19 AND (i >= 59 OR sym = '(ref)')),
    z AS (SELECT sym, i, avg(v) AS m, sqrt(greatest(sum(v * v) - 20 * avg(v) * avg(v), 0)) AS sz, max(v) > min(v) AS moves FROM u GROUP BY ALL),
    q AS (SELECT u.sym, u.i, list((v - m) / sz ORDER BY j) AS y FROM u JOIN z USING (sym, i) WHERE moves GROUP BY ALL),
    c AS (SELECT a.sym, a.i, b.i - 19 AS s, round(list_dot_product(a.y, b.y), 9) AS r FROM q a JOIN q b ON b.sym = '(ref)' AND b.i - 19 < (SELECT k FROM len) - 20 WHERE a.sym <> '(ref)'),
    t AS (SELECT sym, i, max(r) AS r, arg_max(s, (r, -s)) AS s FROM c GROUP BY ALL),
    e AS (SELECT t.sym, t.i, r, sign(b.close - a.close) AS way FROM t JOIN ref a ON a.i = t.s + 20 JOIN ref b ON b.i = least(t.s + 40, (SELECT k FROM len)) - 1 WHERE r >= 0.8)
    SELECT n.sym, n.bar_ts, CASE WHEN way > 0 THEN 'BUY' WHEN way < 0 THEN 'SELL' ELSE 'HOLD' END AS state, round(coalesce(greatest(-1.0, least(1.0, r)) * way, 0)::DOUBLE, 5) + 0.0::DOUBLE AS score FROM n LEFT JOIN e ON e.sym = n.sym AND e.i = n.i"""

# the five-bar fractal needs only neighbours, so SQL can express it
ORACLES["fractals"] = f"""
    WITH {sql.HOURLY}, x AS (
      SELECT *, row_number() OVER w - 1 AS idx,
        max(high) OVER f2 = high AND high > avg(high) OVER f2 AS t2, max(high) OVER f1 = high AND high > avg(high) OVER f1 AS t1, max(high) OVER f0 = high AND high > avg(high) OVER f0 AS t0,
        min(low) OVER f2 = low AND low < avg(low) OVER f2 AS b2, min(low) OVER f1 = low AND low < avg(low) OVER f1 AS b1, min(low) OVER f0 = low AND low < avg(low) OVER f0 AS b0
      FROM bars WINDOW w AS ({sql.W}), f2 AS ({sql.W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), f1 AS ({sql.W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), f0 AS ({sql.W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    y AS (
      SELECT *, max(CASE WHEN t2 AND idx >= 2 THEN idx END) OVER h AS kt, max(CASE WHEN b2 AND idx >= 2 THEN idx END) OVER h AS kb,
        lag(t1) OVER ({sql.W}) AS pt, lag(b1) OVER ({sql.W}) AS pb FROM x WINDOW h AS ({sql.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
    z AS (SELECT *, CASE WHEN kt IS NULL AND kb IS NULL THEN 0 WHEN coalesce(kt, -1) >= coalesce(kb, -1) THEN 1 ELSE -1 END AS side,
        CASE WHEN t0 THEN idx WHEN pt AND idx >= 3 THEN idx - 1 ELSE kt END AS st, CASE WHEN b0 THEN idx WHEN pb AND idx >= 3 THEN idx - 1 ELSE kb END AS sb FROM y),
    v AS (SELECT z.sym, z.bar_ts, z.idx, z.side, z.close, pt_.high AS th, pb_.low AS bl FROM z LEFT JOIN z pt_ ON pt_.sym = z.sym AND pt_.idx = z.st LEFT JOIN z pb_ ON pb_.sym = z.sym AND pb_.idx = z.sb),
    u AS (SELECT *, CASE WHEN idx >= 4 AND side = 1 AND abs(close - th) / th < 0.02 THEN 'SELL' WHEN idx >= 4 AND side = -1 AND abs(close - bl) / bl < 0.02 THEN 'BUY' ELSE 'HOLD' END AS state FROM v)
    SELECT sym, bar_ts, state, CASE WHEN state = 'HOLD' THEN 0.0 ELSE 0.6 END::DOUBLE AS score FROM u"""


def zigzag(spark, sf_dir):
    return recursive.pivots(B.hourly(spark, sf_dir))


QUERIES["zigzag"] = zigzag


_LAST9 = f"list(close) OVER ({sql.W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)"
_ALMA = [2.718281828459045 ** (-((s - 0.85 * 8) ** 2) / (2 * 9.0)) for s in range(9)]


def _weighted(weights):
    return f"CASE WHEN len(x) = 9 THEN ({' + '.join(f'x[{i + 1}] * {w!r}::DOUBLE' for i, w in enumerate(weights))}) / {sum(weights)!r}::DOUBLE END"


def moving_averages(spark, sf_dir):
    m = recursive.moving_averages(B.hourly(spark, sf_dir))
    return m.select("sym", "bar_ts", *[F.round(c, 6).alias(c) for c in ("sma", "wma", "vwma", "smma", "lsma", "alma", "ema")])


QUERIES["moving_averages"] = moving_averages
ORACLES["moving_averages"] = f"""WITH {sql.HOURLY}, b AS (SELECT sym, bar_ts, {_LAST9} AS x, list(close) {PAST} AS h FROM bars)
    SELECT sym, bar_ts, round({_weighted([1.0] * 9)}, 6) AS sma, round({_weighted([float(i) for i in range(1, 10)])}, 6) AS wma, round({_weighted([1.0] * 9)}, 6) AS vwma,
      round(CASE WHEN len(h) >= 9 THEN list_reduce(list_prepend(list_avg(h[1:9]), h[10:]), lambda acc, v: (acc * 8 + v) / 9) END, 6) AS smma,
      round(CASE WHEN len(x) = 9 THEN list_avg(x) + ({' + '.join(f'x[{i + 1}] * {i - 4}' for i in range(9))}) / 60.0::DOUBLE * 4 END, 6) AS lsma, round({_weighted(_ALMA)}, 6) AS alma,
      round(CASE WHEN len(h) >= 9 THEN list_reduce(list_prepend(list_avg(h[1:9]), h[10:]), lambda acc, v: 0.2::DOUBLE * v + 0.8::DOUBLE * acc) END, 6) AS ema FROM b"""


def _mood_refs(bars):
    """Reference series made from the bars of one symbol."""
    return bars.filter("sym = 'view'").select("bar_ts", (F.col("high") / 10).alias("vix"), (F.col("volume") / 10).alias("put_call"), (F.col("close") / 20).alias("junk_yield"), (F.col("open") / 30).alias("treasury_yield"))


GAUGES = ("momentum", "strength", "options", "volatility", "junk", "overall")


def fear_greed_gauges(spark, sf_dir):
    bars = B.hourly(spark, sf_dir)
    g = recursive.fear_greed_gauges(bars, _mood_refs(bars))
    return g.select("sym", "bar_ts", *[F.round(c, 4).alias(c) for c in GAUGES])


QUERIES["fear_greed_gauges"] = fear_greed_gauges


def fear_greed(spark, sf_dir):
    """Fear and greed with all its series, over gauges of a short span so that it signals."""
    bars = B.hourly(spark, sf_dir)
    out = recursive.fear_greed_signals(bars, _mood_refs(bars), span=MOOD_SPAN, least_bars=MOOD_LEAST)
    return out.select("sym", "bar_ts", "state", (F.round("score", 4) + 0.0).alias("score"))


QUERIES["fear_greed"] = fear_greed
MOOD_SPAN, MOOD_LEAST = 20, 140


def rube_triggers(spark, sf_dir):
    """The parts of the finder of tops and bottoms, with one symbol as the reference."""
    bars = B.daily_by_nation(spark, sf_dir)
    t = recursive.rube_triggers(bars, bars.filter("sym = '7'").select("bar_ts", "close"))
    return t.select("sym", "bar_ts", F.round("osc", 5).alias("osc"), F.round("adx", 5).alias("adx"), (F.round("apart", 5) + 0.0).alias("apart"), "leading", "lagging", "gap")


QUERIES["rube_triggers"] = rube_triggers

# ---- SQL for kernels with state: recursion over bar numbers, folds over lists ------------------------

_SAR = f"""WITH RECURSIVE {sql.HOURLY}, n AS (SELECT *, row_number() OVER ({sql.W}) - 1 AS i FROM bars),
    z AS (SELECT a.sym, CASE WHEN c.close < a.close THEN -1 ELSE 1 END AS side, a.high, a.low, a.close FROM n a LEFT JOIN n c ON c.sym = a.sym AND c.i = 2 WHERE a.i = 0),
    s AS (
      SELECT sym, 0::BIGINT AS i, side, CASE WHEN side > 0 THEN high ELSE low END AS ep, 0.02::DOUBLE AS af,
        CASE WHEN side > 0 THEN CASE WHEN low < close THEN low ELSE close * 0.99::DOUBLE END ELSE CASE WHEN high > close THEN high ELSE close * 1.01::DOUBLE END END AS sar FROM z
      UNION ALL
      SELECT sym, i, CASE WHEN broken THEN -side ELSE side END, CASE WHEN broken THEN CASE WHEN side > 0 THEN low ELSE high END WHEN fresh THEN CASE WHEN side > 0 THEN high ELSE low END ELSE ep END,
        CASE WHEN broken THEN 0.02::DOUBLE WHEN fresh THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END, CASE WHEN broken THEN ep ELSE stop END
      FROM (SELECT q.*, side * (close - stop) < 0 AS broken, CASE WHEN side > 0 THEN high > ep ELSE low < ep END AS fresh
            FROM (SELECT s.sym, n.i, s.side, s.ep, s.af, n.high, n.low, n.close,
                    CASE WHEN s.side > 0 THEN least(s.sar + s.af * (s.ep - s.sar), s.sar, p.high) ELSE greatest(s.sar + s.af * (s.ep - s.sar), s.sar, p.low) END AS stop
                  FROM s JOIN n ON n.sym = s.sym AND n.i = s.i + 1 JOIN n p ON p.sym = s.sym AND p.i = s.i) q) r)
    SELECT n.sym, n.bar_ts, CASE WHEN n.i < 4 THEN 'HOLD' WHEN close > sar THEN 'BUY' WHEN close < sar THEN 'SELL' ELSE 'HOLD' END AS state,
      round(CASE WHEN n.i < 4 THEN 0.0 ELSE greatest(-1.0, least(1.0, (close - sar) / close)) END::DOUBLE, 5) + 0.0::DOUBLE AS score FROM n JOIN s ON s.sym = n.sym AND s.i = n.i"""
ORACLES["parabolic_sar"] = _SAR


def _wilder(h: str, n: int = 14) -> str:
    """Wilder's average at the end of a list."""
    return f"CASE WHEN len({h}) >= {n} THEN list_reduce(list_prepend(list_avg({h}[1:{n}]), {h}[{n + 1}:]), lambda acc, v: (acc * {n - 1} + v) / {n}) END"


ORACLES["ufvg"] = f"""WITH {sql.NATION}, {sql.KERNELS},
    m AS (SELECT sym, bar_ts, idx, tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pd, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS md FROM k1),
    l AS (SELECT sym, bar_ts, idx, list(tr) {PAST} AS ht, list(pd) {PAST} AS hp, list(md) {PAST} AS hm FROM m),
    w AS (SELECT sym, bar_ts, idx, {_wilder('ht')} AS t, {_wilder('hp')} AS p, {_wilder('hm')} AS m FROM l),
    d AS (SELECT sym, bar_ts, idx, 100 * p / nullif(t, 0) AS pdi, 100 * m / nullif(t, 0) AS mdi, coalesce(100 * abs(p - m) / nullif(p + m, 0), 0) AS dx FROM w),
    x AS (SELECT *, list(dx) {PAST} AS hx FROM d), y AS (SELECT *, {_wilder('hx')} AS adx FROM x),
    g AS (SELECT *, lag(adx) OVER ({sql.W}) < 14 AS calm, pdi - lag(pdi) OVER ({sql.W}) > 10 AS up, mdi - lag(mdi) OVER ({sql.W}) > 10 AS down FROM y),
    v AS (SELECT sym, bar_ts, CASE WHEN idx < 59 OR NOT coalesce(calm, false) THEN 0 WHEN up AND NOT down THEN -1 WHEN down AND NOT up THEN 1 ELSE 0 END AS s FROM g)
    SELECT sym, bar_ts, CASE s WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END AS state, s * 0.5::DOUBLE AS score FROM v"""

ORACLES["echo_chamber"] = f"""WITH {sql.HOURLY}, n AS (SELECT sym, bar_ts, close, row_number() OVER ({sql.W}) - 1 AS i FROM bars),
    k AS (SELECT sym, i, list(close) OVER ({sql.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS x FROM n),
    u AS (SELECT sym, i, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM k WHERE i >= 19),
    z AS (SELECT sym, i, avg(v) AS m, sqrt(greatest(sum(v * v) - 20 * avg(v) * avg(v), 0)) AS sz, max(v) > min(v) AS moves FROM u GROUP BY ALL),
    q AS (SELECT u.sym, u.i, list((v - m) / sz ORDER BY j) AS y FROM u JOIN z USING (sym, i) WHERE moves GROUP BY ALL),
    c AS (SELECT a.sym, a.i, b.i - 19 AS s, round(list_dot_product(a.y, b.y), 9) AS r FROM q a JOIN q b ON b.sym = a.sym AND b.i - 19 < least(320, a.i + 1 - 40) WHERE a.i >= 59),
    t AS (SELECT sym, i, max(r) AS r, arg_max(s, (r, -s)) AS s FROM c GROUP BY ALL),
    e AS (SELECT t.sym, t.i, r, sign(b.close - a.close) AS way FROM t JOIN n a ON a.sym = t.sym AND a.i = t.s + 20 JOIN n b ON b.sym = t.sym AND b.i = t.s + 39 WHERE r >= 0.8)
    SELECT n.sym, n.bar_ts, CASE WHEN way > 0 THEN 'BUY' WHEN way < 0 THEN 'SELL' ELSE 'HOLD' END AS state, round(coalesce(greatest(-1.0, least(1.0, r)) * way, 0)::DOUBLE, 5) + 0.0::DOUBLE AS score FROM n LEFT JOIN e ON e.sym = n.sym AND e.i = n.i"""


def _standing(x: str, n: int) -> str:
    """50 plus 15 deviations among the last n that are there."""
    w = f"OVER ({sql.W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"coalesce(CASE WHEN {x} IS NOT NULL AND stddev_pop({x}) {w} > 0 THEN greatest(0, least(100, 50 + 15 * ({x} - avg({x}) {w}) / stddev_pop({x}) {w})) END, 50)"


def _within(x: str, n: int) -> str:
    w = f"OVER ({sql.W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"coalesce(CASE WHEN {x} IS NOT NULL AND max({x}) {w} > min({x}) {w} THEN greatest(0, least(100, ({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) * 100)) END, 50)"


def _mood_sql(span: int, least: int) -> str:
    """CTEs up to `mood`: the gauges and their mean."""
    return f"""WITH {sql.HOURLY}, v AS (SELECT bar_ts, high / 10 AS vix, volume / 10 AS pc, close / 20 AS jy, open / 30 AS ty FROM bars WHERE sym = 'view'),
    j AS (SELECT b.*, vix, pc, jy - ty AS spread, row_number() OVER (PARTITION BY b.sym ORDER BY b.bar_ts) - 1 AS idx, close - lag(close) OVER (PARTITION BY b.sym ORDER BY b.bar_ts) AS ch FROM bars b LEFT JOIN v USING (bar_ts)),
    l AS (SELECT *, list(greatest(ch, 0)) FILTER (ch IS NOT NULL) {PAST} AS hg, list(greatest(-ch, 0)) FILTER (ch IS NOT NULL) {PAST} AS hl FROM j),
    w AS (SELECT *, {_wilder('hg')} AS g, {_wilder('hl')} AS ls FROM l),
    r AS (SELECT * EXCLUDE (hg, hl), CASE WHEN ls = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / ls) END AS rsi, 100 * (close / {sql.roll('avg', 'close', 125)} - 1) AS lead125, -({sql.roll('avg', 'pc', 5)}) AS calls, 1 - vix / ({sql.roll('avg', 'vix', 50)}) AS calm,
        spread - ({sql.roll('avg', 'spread', 5)}) AS demand FROM w),
    s AS (SELECT *, {_standing('lead125', span)} AS momentum, {_within('rsi', span)} AS strength, {_standing('calls', span)} AS options, {_standing('calm', span)} AS volatility, {_within('demand', 100)} AS junk FROM r),
    mood AS (SELECT sym, bar_ts, {', '.join(f'CASE WHEN idx >= {least - 1} THEN {c} ELSE 50 END::DOUBLE AS {c}' for c in GAUGES[:-1])}, CASE WHEN idx >= {least - 1} THEN (momentum + strength + options + volatility + junk + 100) / 7 ELSE 50 END::DOUBLE AS overall FROM s)"""


ORACLES["fear_greed_gauges"] = f"{_mood_sql(252, 260)} SELECT sym, bar_ts, {', '.join(f'round({c}, 4) AS {c}' for c in GAUGES)} FROM mood"
ORACLES["fear_greed"] = f"""{_mood_sql(MOOD_SPAN, MOOD_LEAST)} SELECT sym, bar_ts, CASE WHEN overall <= 25 THEN 'BUY' WHEN overall >= 75 THEN 'SELL' ELSE 'HOLD' END AS state,
    round(CASE WHEN overall <= 25 THEN (25 - overall) / 25 WHEN overall >= 75 THEN -(overall - 75) / 25 ELSE 0 END::DOUBLE, 4) + 0.0::DOUBLE AS score FROM mood"""


# ---- values of the recursive indicators -----------------------------------------------------------------

VALUES = ("ema9", "ema21", "macd", "macd_signal", "supertrend_upper", "supertrend_lower", "rsi_wilder", "plus_di", "minus_di", "adx_wilder")


def recursive_values(spark, sf_dir):
    v = recursive.values(B.hourly(spark, sf_dir))
    return v.select("sym", "bar_ts", *[F.round(c, 6).alias(c) for c in VALUES])


#: CTEs up to `wi`: Wilder's strength and directional indices of every bar.
_WILDER = f"""m AS (SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pd, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS md FROM k1),
    l AS (SELECT *, list(tr) {PAST} AS ht, list(pd) {PAST} AS hp, list(md) {PAST} AS hm, list(greatest(ch, 0)) FILTER (ch IS NOT NULL) {PAST} AS hg, list(greatest(-ch, 0)) FILTER (ch IS NOT NULL) {PAST} AS hl FROM m),
    w AS (SELECT * EXCLUDE (ht, hp, hm, hg, hl), {_wilder('ht')} AS wt, {_wilder('hp')} AS wp, {_wilder('hm')} AS wm, {_wilder('hg')} AS wg, {_wilder('hl')} AS wl FROM l),
    d AS (SELECT *, 100 * wp / wt AS plus_di, 100 * wm / wt AS minus_di, coalesce(100 * abs(wp - wm) / nullif(wp + wm, 0), 0) AS dx, CASE WHEN wl = 0 THEN 100.0 ELSE 100 - 100 / (1 + wg / wl) END AS rsi_wilder FROM w),
    x AS (SELECT *, list(dx) {PAST} AS hx FROM d), wi AS (SELECT * EXCLUDE (hx), {_wilder('hx')} AS adx_wilder FROM x)"""

QUERIES["recursive_values"] = recursive_values
ORACLES["recursive_values"] = f"""
    WITH {sql.HOURLY}, {sql.KERNELS}, {_WILDER},
    l2 AS (SELECT *, list(tr) {PAST} AS trs, {_ewm('close', 9)} AS ema9, {_ewm('close', 21)} AS ema21, {_ewm('close', 12, True)} - {_ewm('close', 26, True)} AS line FROM wi),
    a AS (SELECT *, {_ewm('line', 9, True)} AS sig, CASE WHEN idx < 10 THEN list_avg(trs) ELSE list_reduce(list_prepend(list_avg(trs[1:10]), trs[11:]), lambda acc, x: x / 10 + acc * 0.9) END AS atr FROM l2)
    SELECT sym, bar_ts, round(ema9, 6) AS ema9, round(ema21, 6) AS ema21, round(line, 6) AS macd, round(sig, 6) AS macd_signal, round((high + low) / 2 + 3 * atr, 6) AS supertrend_upper, round((high + low) / 2 - 3 * atr, 6) AS supertrend_lower,
      round(rsi_wilder, 6) AS rsi_wilder, round(plus_di, 6) AS plus_di, round(minus_di, 6) AS minus_di, round(adx_wilder, 6) AS adx_wilder FROM a"""


def gap_lines(spark, sf_dir):
    """The last gap line of every bar, and whether nothing has touched it since."""
    return recursive.values(B.daily_by_nation(spark, sf_dir)).select("sym", "bar_ts", F.round("gap_level", 6).alias("gap_level"), "gap_active")


QUERIES["gap_lines"] = gap_lines
ORACLES["gap_lines"] = f"""WITH {sql.NATION}, {sql.KERNELS}, {_WILDER},
    j AS (SELECT sym, bar_ts, idx, open, high, low, pc, coalesce(lag(adx_wilder) OVER ({sql.W}) < 14 AND (plus_di - lag(plus_di) OVER ({sql.W}) > 10 OR minus_di - lag(minus_di) OVER ({sql.W}) > 10), false) AS jump FROM wi),
    b AS (SELECT *, jump AND NOT coalesce(lag(jump) OVER ({sql.W}), false) AS begins FROM j),
    r AS (SELECT *, sum(begins::INT) OVER ({sql.W}) AS run, last_value(CASE WHEN begins THEN open END IGNORE NULLS) OVER ({sql.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM b),
    h AS (SELECT *, run > 0 AND NOT begins AND (low <= level + 1e-9 AND high >= level - 1e-9 OR coalesce((pc - level) * (open - level) < 0, false)) AS hit FROM r)
    SELECT sym, bar_ts, round(level, 6) AS gap_level, run > 0 AND NOT bool_or(hit) OVER (PARTITION BY sym, run ORDER BY bar_ts) AS gap_active FROM h"""


def sar_wilder(spark, sf_dir):
    """Wilder's own stop, which two bars bound and whose turn needs the bar's extreme."""
    return recursive.values(B.hourly(spark, sf_dir)).select("sym", "bar_ts", F.round("sar_wilder", 6).alias("sar_wilder"))


QUERIES["sar_wilder"] = sar_wilder
ORACLES["sar_wilder"] = f"""WITH RECURSIVE {sql.HOURLY}, n AS (SELECT *, row_number() OVER ({sql.W}) - 1 AS i FROM bars),
    z AS (SELECT a.sym, CASE WHEN c.close < a.close THEN -1 ELSE 1 END AS side, a.high, a.low, a.close FROM n a LEFT JOIN n c ON c.sym = a.sym AND c.i = 2 WHERE a.i = 0),
    s AS (
      SELECT sym, 0::BIGINT AS i, side, CASE WHEN side > 0 THEN high ELSE low END AS ep, 0.02::DOUBLE AS af,
        CASE WHEN side > 0 THEN CASE WHEN low < close THEN low ELSE close * 0.99::DOUBLE END ELSE CASE WHEN high > close THEN high ELSE close * 1.01::DOUBLE END END AS sar FROM z
      UNION ALL
      SELECT sym, i, CASE WHEN broken THEN -side ELSE side END, CASE WHEN broken THEN CASE WHEN side > 0 THEN low ELSE high END WHEN fresh THEN CASE WHEN side > 0 THEN high ELSE low END ELSE ep END,
        CASE WHEN broken THEN 0.02::DOUBLE WHEN fresh THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END, CASE WHEN broken THEN ep ELSE stop END
      FROM (SELECT q.*, CASE WHEN side > 0 THEN low < stop ELSE high > stop END AS broken, CASE WHEN side > 0 THEN high > ep ELSE low < ep END AS fresh
            FROM (SELECT s.sym, n.i, s.side, s.ep, s.af, n.high, n.low, n.close,
                    CASE WHEN s.side > 0 THEN least(s.sar + s.af * (s.ep - s.sar), p.low, coalesce(pp.low, p.low)) ELSE greatest(s.sar + s.af * (s.ep - s.sar), p.high, coalesce(pp.high, p.high)) END AS stop
                  FROM s JOIN n ON n.sym = s.sym AND n.i = s.i + 1 JOIN n p ON p.sym = s.sym AND p.i = s.i LEFT JOIN n pp ON pp.sym = s.sym AND pp.i = s.i - 1) q) r)
    SELECT n.sym, n.bar_ts, round(sar, 6) AS sar_wilder FROM n JOIN s ON s.sym = n.sym AND s.i = n.i"""


# ---- pivots and patterns: a fold over turning points, then list expressions over the pivots of each bar ---


def _numbered(cte: str) -> str:
    return f"WITH RECURSIVE {cte}, n AS (SELECT *, row_number() OVER ({sql.W}) - 1 AS i, count(*) OVER (PARTITION BY sym) AS cnt FROM bars)"


def _pivots(move: float, gap: int, reach: int = 5, tag: str = "") -> str:
    """CTEs over `n` up to `snap`: from which bar on which pivots hold. A point that comes too soon may only
    replace the pending one by going further in its own sense; else it needs a large enough move."""
    w = f"(PARTITION BY sym ORDER BY i ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)"
    return f"""ext{tag} AS (SELECT sym, i, cnt, high, low, max(high) OVER w AS hi, avg(high) OVER w AS ha, min(low) OVER w AS lo, avg(low) OVER w AS la FROM n WINDOW w AS {w}),
    pts{tag} AS (SELECT sym, i, high AS price, true AS top FROM ext{tag} WHERE i >= {reach} AND i < cnt - {reach} AND high = hi AND high > ha
      UNION ALL SELECT sym, i, low, false FROM ext{tag} WHERE i >= {reach} AND i < cnt - {reach} AND low = lo AND low < la),
    tp{tag} AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY i, top DESC) AS k FROM pts{tag}),
    zz{tag} AS (
      SELECT sym, k, i AS seen, {{'at': i, 'price': price, 'top': top}} AS p, list_filter([{{'at': i, 'price': price, 'top': top}}], lambda x: false) AS done FROM tp{tag} WHERE k = 1
      UNION ALL
      SELECT sym, k, i, CASE WHEN swaps THEN x ELSE p END, CASE WHEN holds THEN list_append(done, p) ELSE done END FROM (
        SELECT *, CASE WHEN soon THEN further ELSE big AND (x.top <> p.top OR further) END AS swaps, NOT soon AND big AND x.top <> p.top AS holds FROM (
          SELECT z.sym, t.k, t.i, z.p, z.done, {{'at': t.i, 'price': t.price, 'top': t.top}} AS x, t.i - z.p.at < {gap} AS soon, CASE WHEN t.top THEN t.price > z.p.price ELSE t.price < z.p.price END AS further, abs(t.price - z.p.price) / z.p.price >= {move}::DOUBLE AS big
          FROM zz{tag} z JOIN tp{tag} t ON t.sym = z.sym AND t.k = z.k + 1) a) b),
    snap{tag} AS (SELECT sym, seen + {reach} AS start, list_append(done, p) AS v FROM zz{tag} WHERE k >= 2 QUALIFY row_number() OVER (PARTITION BY sym, seen ORDER BY k DESC) = 1),
    held{tag} AS (SELECT n.sym, n.bar_ts, n.i, n.close, snap{tag}.v FROM n ASOF LEFT JOIN snap{tag} ON n.sym = snap{tag}.sym AND n.i >= snap{tag}.start)"""


def _any(kinds: str, condition: str) -> str:
    """Whether some consecutive pivots of these kinds (T, B) meet a condition over v[j], v[j + 1], ..."""
    shape = " AND ".join(f"{'' if k == 'T' else 'NOT '}v[j + {m}].top" for m, k in enumerate(kinds))
    return f"coalesce(len(list_filter(range(1, len(v) - {len(kinds) - 2}), lambda j: {shape} AND {condition})) > 0, false)"


_RIM, _FLOOR = "((v[j].price + v[j + 2].price) / 2)", "((v[j].price + v[j + 2].price) / 2)"
_NECK = "((v[j + 1].price + v[j + 3].price) / 2)"
_EVEN = "abs(v[j].price - v[j + 4].price) / ((v[j].price + v[j + 4].price) / 2) <= 0.03"
_SIDES = {
    "double": (10, _any("TBT", f"abs(v[j].price - v[j + 2].price) / {_RIM} <= 0.02 AND ({_RIM} - v[j + 1].price) / {_RIM} >= 0.03 AND close >= v[j + 1].price AND close <= {_RIM} * 1.01"),
               _any("BTB", f"abs(v[j].price - v[j + 2].price) / {_FLOOR} <= 0.02 AND (v[j + 1].price - {_FLOOR}) / v[j + 1].price >= 0.03 AND close >= {_FLOOR} * 0.99 AND close <= v[j + 1].price"), 0.7),
    "head": (20, _any("BTBTB", f"{_EVEN} AND v[j + 2].price < least(v[j].price, v[j + 4].price) AND -({_NECK} - close) / {_NECK} >= 0.01"),
             _any("TBTBT", f"{_EVEN} AND v[j + 2].price > greatest(v[j].price, v[j + 4].price) AND ({_NECK} - close) / {_NECK} >= 0.01"), 0.8),
    "cup": (40, _any("TBTT", "v[j + 2].at - v[j].at BETWEEN 20 AND 65 AND (v[j].price - v[j + 1].price) / v[j].price >= 0.05 AND abs(v[j].price - v[j + 2].price) / ((v[j].price + v[j + 2].price) / 2) <= 0.02 "
                             "AND v[j + 3].at - v[j + 2].at BETWEEN 5 AND 15 AND (v[j + 2].price - v[j + 3].price) / v[j + 2].price BETWEEN 0 AND 0.03 AND close >= v[j + 2].price * 0.99"), "false", 0.85),
}


def _fit(points: str, name: str) -> str:
    """Slope, intercept and correlation of a line through a list of pivots, as columns."""
    mx, my = f"list_avg(list_transform({points}, lambda q: q.at))", f"list_avg(list_transform({points}, lambda q: q.price))"
    dx, dy = f"(q.at - {mx})", f"(q.price - {my})"
    xy, xx, yy = (f"list_sum(list_transform({points}, lambda q: {a} * {b}))" for a, b in ((dx, dy), (dx, dx), (dy, dy)))
    return f"{xy} / {xx} AS {name}_s, {my} - {xy} / {xx} * {mx} AS {name}_i, coalesce({xy} / nullif(sqrt({xx}) * sqrt({yy}), 0), 0) AS {name}_r"


def _lined(tag: str = "") -> str:
    """A CTE `lin`: the lines through the last three tops and bottoms of each bar."""
    return f"""lt{tag} AS (SELECT *, list_filter(v, lambda q: q.top) AS ts, list_filter(v, lambda q: NOT q.top) AS bs FROM held{tag}), l3{tag} AS (SELECT *, ts[-3:] AS t3, bs[-3:] AS b3 FROM lt{tag}),
    lin{tag} AS (SELECT *, {_fit('t3', 'u')}, {_fit('b3', 'd')} FROM l3{tag})"""


_WEDGED = "len(v) >= 4 AND len(ts) >= 2 AND len(bs) >= 2"
_WEDGE = ("u_s < 0 AND d_s < u_s AND close > u_s * v[-1].at * 1.01", "d_s > 0 AND u_s > d_s AND close < d_s * v[-1].at * 0.99")


def _verdicts(buy: str, sell: str, score: float, least: int, src: str) -> str:
    state = f"CASE WHEN i < {least - 1} THEN 0 WHEN {buy} THEN 1 WHEN {sell} THEN -1 ELSE 0 END"
    return f"SELECT sym, bar_ts, CASE {state} WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END AS state, CASE WHEN {state} = 0 THEN 0.0 ELSE {score} END::DOUBLE AS score FROM {src}"


ORACLES["zigzag"] = f"{_numbered(sql.HOURLY)}, {_pivots(0.05, 3)} SELECT sym, x.at::INT AS at, round(x.price, 6) AS price, x.top AS top FROM (SELECT sym, unnest(v) AS x FROM snap QUALIFY start = max(start) OVER (PARTITION BY sym))"
for _key, _kind, _cte, _move, _gap in (("double_top_bottom", "double", sql.HOURLY, 0.05, 3), ("head_shoulders", "head", sql.HOURLY, 0.06, 5)):
    _least, _buy, _sell, _score = _SIDES[_kind]
    ORACLES[_key] = f"{_numbered(_cte)}, {_pivots(_move, _gap)} {_verdicts(_buy, _sell, _score, _least, 'held')}"
ORACLES["wedge"] = f"{_numbered(sql.HOURLY)}, {_pivots(0.05, 4)}, {_lined()} {_verdicts(f'{_WEDGED} AND {_WEDGE[0]}', f'{_WEDGED} AND {_WEDGE[1]}', 0.75, 20, 'lin')}"
ORACLES["autotrend"] = f"""{_numbered(sql.HOURLY)}, {_pivots(0.02, 3, 3)}, {_lined()}, q AS (SELECT *, u_i + u_s * i AS up, d_i + d_s * i AS dn, (abs(u_r) + abs(d_r)) / 2 AS sure, i >= 39 AND len(ts) >= 3 AND len(bs) >= 3 AS ok FROM lin),
    w AS (SELECT *, CASE WHEN NOT coalesce(ok, false) THEN 0 WHEN close > up THEN CASE WHEN (close - up) / up >= 0.005 THEN 1 ELSE 0 END WHEN close < dn AND (dn - close) / dn >= 0.005 THEN -1 ELSE 0 END AS s FROM q)
    SELECT sym, bar_ts, CASE s WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END AS state, round(CASE WHEN s = 0 THEN 0 ELSE greatest(-1.0, least(1.0, s * sure)) END::DOUBLE, 5) + 0.0::DOUBLE AS score FROM w"""
_SHAPED = f"""{sql.HOURLY.replace('bars AS (', 'bars0 AS (', 1)}, bars1 AS (SELECT *, (row_number() OVER (PARTITION BY sym ORDER BY bar_ts) - 1) % {len(CUP)} AS step FROM bars0),
    bars AS (SELECT sym, bar_ts, level AS open, level + 0.1::DOUBLE AS high, level - CASE WHEN step = {DEEP} THEN 3.0::DOUBLE ELSE 0.1::DOUBLE END AS low, level AS close FROM (SELECT *, ({[float(x) for x in CUP]}::DOUBLE[])[step + 1] + close % 1 / 100 AS level FROM bars1))"""
ORACLES["cup_handle"] = f"{_numbered(_SHAPED)}, {_pivots(0.04, 3)} {_verdicts(_SIDES['cup'][1], _SIDES['cup'][2], 0.85, 40, 'held')}"
ORACLES["pattern_combined"] = f"""{_numbered(sql.HOURLY)}, {_pivots(0.05, 3)}, {_lined()},
    fr AS ({ORACLES['fractals']}),
    c AS (SELECT lin.sym, lin.bar_ts, lin.close, list_filter([{', '.join(
        "{'s': CASE WHEN i < %d THEN 0 WHEN %s THEN 1 WHEN %s THEN -1 ELSE 0 END, 'v': %s::DOUBLE}" % (_l - 1, _b, _s, _v)
        for _l, _b, _s, _v in (_SIDES['double'], _SIDES['head'], (20, f'{_WEDGED} AND {_WEDGE[0]}', f'{_WEDGED} AND {_WEDGE[1]}', 0.75), (5, "fr.state = 'BUY'", "fr.state = 'SELL'", 0.6), _SIDES['cup']))}], lambda x: x.s <> 0) AS hits
      FROM lin JOIN fr ON fr.sym = lin.sym AND fr.bar_ts = lin.bar_ts),
    b AS (SELECT sym, bar_ts, list_max(list_transform(hits, lambda x: x.v)) AS v, list_filter(hits, lambda x: x.v = list_max(list_transform(hits, lambda y: y.v)))[1].s AS s FROM c)
    SELECT sym, bar_ts, CASE s WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END AS state, round(coalesce(v * s, 0)::DOUBLE, 5) + 0.0::DOUBLE AS score FROM b"""


# ---- composites -----------------------------------------------------------------------------------------


def _filled(x: str) -> str:
    """A column with its first value before that."""
    return f"coalesce({x}, first_value({x} IGNORE NULLS) OVER ({sql.W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


def _seeded(h: str, n: int) -> str:
    """Exponential average at the end of a list, from the mean of its first n values."""
    a = 2.0 / (n + 1)
    return f"CASE WHEN len({h}) >= {n} THEN list_reduce(list_prepend(list_avg({h}[1:{n}]), {h}[{n + 1}:]), lambda acc, v: {a!r}::DOUBLE * v + {1 - a!r}::DOUBLE * acc) END"


#: CTEs over `wi` up to `os`: the averaged strength.
_OSC = f"""w0 AS (SELECT *, {_filled('rsi_wilder')} AS seeded FROM wi), w1 AS (SELECT *, list(seeded) {PAST} AS h3 FROM w0), os AS (SELECT * EXCLUDE (h3), {_seeded('h3', 3)} AS osc FROM w1)"""


def oscillators(spark, sf_dir):
    o = recursive.oscillators(B.hourly(spark, sf_dir))
    return o.select("sym", "bar_ts", *[F.round(c, 5).alias(c) for c in ("none", "dema", "alma", "kalman")])


QUERIES["oscillators"] = oscillators
ORACLES["oscillators"] = f"""WITH {sql.HOURLY}, {sql.KERNELS}, {_WILDER}, {_OSC},
    f AS (SELECT *, {_filled('osc')} AS x FROM os), f1 AS (SELECT *, list(x) {PAST} AS hx, list(x) OVER ({sql.W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS x9 FROM f),
    f2 AS (SELECT * EXCLUDE (hx), {_seeded('hx', 5)} AS e1 FROM f1), f3 AS (SELECT *, {_filled('e1')} AS e1f FROM f2), f4 AS (SELECT *, list(e1f) {PAST} AS he FROM f3)
    SELECT sym, bar_ts, round(osc, 5) AS "none", round(2 * e1 - ({_seeded('he', 5)}), 5) AS dema, round({_weighted(_ALMA).replace('x[', 'x9[').replace('len(x)', 'len(x9)')}, 5) AS alma,
      round(CASE WHEN osc IS NOT NULL THEN (100 + sum(osc) {PAST}) / (count(osc) {PAST} + 2) END, 5) AS kalman FROM f4"""

_BARS252 = f"OVER ({sql.W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"


def _stands(x: str) -> str:
    return f"CASE WHEN count({x}) {_BARS252} = 252 AND stddev_samp({x}) {_BARS252} > 0 THEN greatest(0, least(100, 50 + 15 * ({x} - avg({x}) {_BARS252}) / stddev_samp({x}) {_BARS252})) ELSE 50 END"


ORACLES["chimera"] = f"""WITH {sql.HOURLY}, {sql.KERNELS}, {_WILDER},
    a AS (SELECT *, {_filled('rsi_wilder')} AS r, {_ewm('close', 12)} - {_ewm('close', 26)} AS line, {sql.roll('avg', 'close', 20)} AS s20, 2 * ({sql.roll('stddev_samp', 'close', 20)}) AS dev, {sql.roll('max', 'high', 14)} AS h14, {sql.roll('min', 'low', 14)} AS l14, {sql.roll('avg', 'tr', 14)} AS atr FROM wi),
    b AS (SELECT *, line - {_ewm('line', 9)} AS gap, CASE WHEN dev = 0 THEN 50 ELSE 100 * (close - s20 + dev) / (2 * dev) END AS place, CASE WHEN h14 = l14 THEN 50 ELSE 100 * (close - l14) / (h14 - l14) END AS k, CASE WHEN close = 0 THEN 0 ELSE atr / close * 100 END AS wide FROM a),
    c AS (SELECT *, {_filled('place')} AS pf, {_filled('k')} AS kf, {_filled('wide')} AS wf FROM b), e AS (SELECT *, {sql.roll('avg', 'kf', 3)} AS sw, {sql.roll('avg', 'wf', 252)} AS usual FROM c),
    f AS (SELECT *, (plus_di - minus_di) * CASE WHEN usual = 0 THEN 1 ELSE wf / usual END AS force FROM e),
    g AS (SELECT *, ({_stands('r')} + {_stands('gap')} + {_stands('pf')} + coalesce(sw, 50) + CASE WHEN idx >= 251 AND force IS NOT NULL AND max(force) {_BARS252} > min(force) {_BARS252} THEN 100 * (force - min(force) {_BARS252}) / (max(force) {_BARS252} - min(force) {_BARS252}) ELSE 50 END) / 5 AS mean FROM f),
    h AS (SELECT *, {sql.roll('avg', 'mean', 12)} AS slow FROM g), i AS (SELECT *, lag(mean) OVER ({sql.W}) AS m0, lag(slow) OVER ({sql.W}) AS s0 FROM h),
    j AS (SELECT *, coalesce(last_value(CASE WHEN mean > slow AND m0 <= s0 THEN 1 WHEN mean < slow AND m0 >= s0 THEN 0 END IGNORE NULLS) {PAST}, 1) AS up FROM i),
    s AS (SELECT *, CASE WHEN idx < 259 THEN 0 WHEN up = 1 AND mean > slow THEN 1 WHEN up = 0 AND mean < slow THEN -1 ELSE 0 END AS s FROM j)
    SELECT sym, bar_ts, CASE s WHEN 1 THEN 'BUY' WHEN -1 THEN 'SELL' ELSE 'HOLD' END AS state, round(CASE WHEN s = 0 THEN 0 ELSE greatest(-1, least(1, (mean - 50) / 50)) END::DOUBLE, 5) + 0.0::DOUBLE AS score FROM s"""

_NATION_SAR = ORACLES["sar_wilder"].replace(sql.HOURLY, sql.NATION)
ORACLES["rube_triggers"] = f"""WITH {sql.NATION}, {sql.KERNELS}, {_WILDER}, {_OSC},
    sr AS (SELECT * FROM ({_NATION_SAR.replace('round(sar, 6) AS sar_wilder', 'sar')})),
    rf AS (SELECT os.*, sr.sar, v.close AS ref FROM os JOIN sr ON sr.sym = os.sym AND sr.bar_ts = os.bar_ts LEFT JOIN (SELECT bar_ts, close FROM bars WHERE sym = '7') v ON v.bar_ts = os.bar_ts),
    r0 AS (SELECT *, bool_or(ref IS NULL) {PAST} AS lost, coalesce(ref - lag(ref) OVER ({sql.W}), 0) AS rm FROM rf),
    r1 AS (SELECT *, list(abs(rm)) {PAST} AS rt, list(greatest(rm, 0)) {PAST} AS rp, list(greatest(-rm, 0)) {PAST} AS rn FROM r0),
    r2 AS (SELECT * EXCLUDE (rt, rp, rn), {_wilder('rt')} AS t, {_wilder('rp')} AS p, {_wilder('rn')} AS n2 FROM r1),
    r3 AS (SELECT *, CASE WHEN lost THEN 0 ELSE coalesce(plus_di - minus_di - (100 * p / t - 100 * n2 / t), 0) END AS apart, coalesce(adx_wilder, 0) AS ax FROM r2),
    r4 AS (SELECT *, coalesce(ax > 20 AND ax > {sql.roll('avg', 'ax', 10)}, false) AS strong, lag(osc) OVER ({sql.W}) AS was, sign(close - sar) AS side, lag(sign(close - sar)) OVER ({sql.W}) AS side0 FROM r3),
    r5 AS (SELECT *, was >= 30 AND osc < 30 AND (strong AND minus_di > 35 OR apart < -25) AS dn, was <= 70 AND osc > 70 AND (strong AND plus_di > 35 OR apart > 25) AS up FROM r4)
    SELECT sym, bar_ts, round(osc, 5) AS osc, round(ax, 5) AS adx, round(apart, 5) + 0.0::DOUBLE AS apart, (coalesce(dn, false)::INT - coalesce(up, false)::INT)::INT AS leading,
      CASE WHEN side0 < 0 AND side > 0 AND osc > was THEN 1 WHEN side0 > 0 AND side < 0 AND osc < was THEN -1 ELSE 0 END AS lagging, coalesce(ax < 22 AND (minus_di > 35 OR plus_di > 35), false) AS gap FROM r5"""

#: Both triggers on one bar, from the triggers of the hourly bars (where no symbol is the reference).
ORACLES["rube_goldberg"] = f"""SELECT t.sym, t.bar_ts, CASE WHEN i >= 49 AND "leading" = 1 AND "lagging" = 1 THEN 'BUY' WHEN i >= 49 AND "leading" = -1 AND "lagging" = -1 THEN 'SELL' ELSE 'HOLD' END AS state,
    CASE WHEN i >= 49 AND "leading" = "lagging" THEN "leading" ELSE 0 END::DOUBLE + 0.0::DOUBLE AS score FROM ({ORACLES['rube_triggers'].replace(sql.NATION, sql.HOURLY)}) t JOIN (WITH {sql.HOURLY} SELECT sym, bar_ts, row_number() OVER ({sql.W}) - 1 AS i FROM bars) b ON b.sym = t.sym AND b.bar_ts = t.bar_ts"""


def last_rows_sql() -> str:
    """Rows (sym, bar_ts, indicator, category, state, score) of the recursive indicators over a CTE `lastbar`
    (sym, bar_ts), scores to nine places; hourly bars."""
    own = dict(zip(("MACD", "EMA9/21", "EMA9", "EMA21", "EMA50", "EMA200", "Supertrend", "AutoTrend", "Parabolic SAR", "DoubleTopBottom", "HeadShoulders", "WedgePattern", "AutoFractal", "PatternDetector", "EchoChamber", "Chimera"),
                   (ORACLES[k] for k in ("macd", "ema_cross", "ema9", "ema21", "ema50", "ema200", "supertrend", "autotrend", "parabolic_sar", "double_top_bottom", "head_shoulders", "wedge", "fractals", "pattern_combined", "echo_chamber", "chimera")), strict=True))
    own["CupAndHandle"] = f"{_numbered(sql.HOURLY)}, {_pivots(0.04, 3)} {_verdicts(_SIDES['cup'][1], _SIDES['cup'][2], 0.85, 40, 'held')}"
    own["UnFairValueGap"] = ORACLES["ufvg"].replace(sql.NATION, sql.HOURLY)
    # five of the seven gauges have no series
    own["FearGreed"] = f"{_mood_sql(252, 260)} SELECT sym, bar_ts, CASE WHEN m <= 25 THEN 'BUY' WHEN m >= 75 THEN 'SELL' ELSE 'HOLD' END AS state, CASE WHEN m <= 25 THEN (25 - m) / 25 WHEN m >= 75 THEN -(m - 75) / 25 ELSE 0 END AS score FROM (SELECT *, (momentum + strength + 250) / 7 AS m FROM mood)"
    # without references there is no match, and the triggers exclude each other
    own["MatchFinder"] = own["RubeGoldberg"] = "SELECT sym, bar_ts, 'HOLD' AS state, 0.0::DOUBLE AS score FROM lastbar"
    assert set(own) == set(recursive.RECURSIVE)
    rows = [f"SELECT o.sym, o.bar_ts, '{name}' AS indicator, '{recursive.RECURSIVE[name][0]}' AS category, o.state, o.score FROM ({q.replace(', 5) + 0.0::DOUBLE AS score', ', 9) + 0.0::DOUBLE AS score')}) o JOIN lastbar USING (sym, bar_ts)" for name, q in own.items()]
    return " UNION ALL ".join(rows)
