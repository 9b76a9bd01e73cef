"""Queries of back-tests and campaigns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barwright.operators import backtest as T
from barwright.operators import campaign as C
from barwright.operators import native, recursive
from barwright.plans import indicators, shared, sql
from barwright.sources import bars as B

QUERIES, ORACLES = {}, {}
R = F.round
#: Indicators of the trading queries, and the levers of the grid.
STUDIED = ["CCI", "MFI", "OBV", "ROC", "RSI", "VWAP"]


def _signals(spark, sf_dir):
    return native.signals(B.hourly(spark, sf_dir), STUDIED)


SIG = f"WITH {sql.HOURLY}, {sql.KERNELS}, {sql.signals_cte(STUDIED)}"


def _edges(keys: str, src: str = "sig", warmup: int = 60) -> str:
    return f"""e0 AS (SELECT * REPLACE (CASE WHEN idx >= {warmup} THEN state ELSE 'HOLD' END AS state) FROM {src}),
    e AS (SELECT *, lag(state, 1, 'HOLD') OVER w AS prev, lead(open) OVER w AS entry_open, min(CASE WHEN state = 'SELL' THEN idx END) OVER f AS ns, min(CASE WHEN state = 'BUY' THEN idx END) OVER f AS nb
      FROM e0 WINDOW w AS (PARTITION BY {keys} ORDER BY idx), f AS (PARTITION BY {keys} ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


def _trades(keys: str, src: str = "sig", warmup: int = 60) -> str:
    cols = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""{_edges(keys, src, warmup)},
    x AS (SELECT e.*, h.horizon, CASE state WHEN 'BUY' THEN 'long' ELSE 'short' END AS side, least(coalesce(CASE state WHEN 'BUY' THEN ns ELSE nb END, idx + h.horizon), idx + h.horizon) AS exit_idx
      FROM e, (VALUES (5), (10), (20)) h(horizon) WHERE state <> 'HOLD' AND state <> prev),
    px AS (SELECT DISTINCT sym, idx, bar_ts, close FROM sig),
    t AS (SELECT {cols}, x.idx, x.bar_ts, x.horizon, x.side, x.entry_open, x.exit_idx, px.bar_ts AS exit_ts, x.exit_idx < x.n AS complete,
        CASE WHEN x.exit_idx < x.n THEN (px.close / nullif(x.entry_open, 0) - 1) * 100 * CASE x.side WHEN 'long' THEN 1 ELSE -1 END END AS gross
      FROM x LEFT JOIN px ON px.sym = x.sym AND px.idx = x.exit_idx),
    tt AS (SELECT *, gross - 0.3::DOUBLE AS net FROM t)"""


def edge_signals(spark, sf_dir):
    return T.edges(_signals(spark, sf_dir)).filter("edge").select("sym", "indicator", "bar_ts", "idx", "state")


QUERIES["edge_signals"] = edge_signals
ORACLES["edge_signals"] = f"{SIG}, {_edges('sym, indicator')} SELECT sym, indicator, bar_ts, idx, state FROM e WHERE state <> 'HOLD' AND state <> prev"


def event_trades(spark, sf_dir):
    t = T.event_trades(_signals(spark, sf_dir))
    return t.select("sym", "indicator", "bar_ts", "horizon", "side", "exit_idx", "exit_ts", "complete", (R("gross", 5) + 0.0).alias("gross"), (R("net", 5) + 0.0).alias("net"))


QUERIES["event_trades"] = event_trades
ORACLES["event_trades"] = f"{SIG}, {_trades('sym, indicator')} SELECT sym, indicator, bar_ts, horizon, side, exit_idx, exit_ts, complete, round(gross, 5) + 0.0::DOUBLE AS gross, round(net, 5) + 0.0::DOUBLE AS net FROM tt"


def event_study(spark, sf_dir):
    s = T.event_study(T.event_trades(_signals(spark, sf_dir)))
    return s.select("indicator", "horizon", "side", "trades", "incomplete", *[R(c, 5).alias(c) for c in ("hit_rate", "avg_gross", "avg_net", "median_net", "best", "worst")])


QUERIES["event_study"] = event_study
ORACLES["event_study"] = f"""{SIG}, {_trades('sym, indicator')}
    SELECT indicator, horizon, side, count(net) AS trades, count(*) FILTER (NOT complete) AS incomplete, round(avg((net > 0)::INT), 5) AS hit_rate, round(avg(gross), 5) AS avg_gross, round(avg(net), 5) AS avg_net,
      round(quantile_cont(net, 0.5), 5) AS median_net, round(max(net), 5) AS best, round(min(net), 5) AS worst FROM tt GROUP BY ALL"""


def evidence(spark, sf_dir):
    e = T.evidence(T.event_trades(_signals(spark, sf_dir)))
    return e.select("indicator", "trades", R("mean", 5).alias("mean"), R("t", 5).alias("t"), "weight")


QUERIES["evidence"] = evidence
ORACLES["evidence"] = f"""{SIG}, {_trades('sym, indicator')}, g AS (SELECT indicator, count(net) AS trades, avg(net) AS mean, stddev_samp(net) AS sd FROM tt WHERE horizon = 10 AND side = 'long' GROUP BY 1),
    h AS (SELECT *, CASE WHEN trades > 1 AND sd > 0 THEN round(mean / (sd / sqrt(trades)), 6) END AS t FROM g)
    SELECT indicator, trades, round(mean, 5) AS mean, round(t, 5) AS t, CASE WHEN trades < 20 THEN 'insufficient' WHEN t >= 2 THEN 'strong' WHEN t >= 1 THEN 'moderate' WHEN t > 0 THEN 'weak' ELSE 'none' END AS weight FROM h"""


def event_study_recursive(spark, sf_dir):
    """The study of the indicators that keep state, on the daily bars of nations."""
    s = recursive.signals(B.daily_by_nation(spark, sf_dir), ["MACD", "Parabolic SAR", "AutoFractal", "EMA9/21", "EchoChamber"])
    return T.event_study(T.event_trades(s)).select("indicator", "horizon", "side", "trades", "incomplete", R("avg_net", 4).alias("avg_net"))


QUERIES["event_study_recursive"] = event_study_recursive
_RECURSIVE = {"MACD": "macd", "Parabolic SAR": "parabolic_sar", "AutoFractal": "fractals", "EMA9/21": "ema_cross", "EchoChamber": "echo_chamber"}
_OWN = " UNION ALL ".join(f"SELECT sym, bar_ts, state, '{name}' AS indicator FROM ({indicators.ORACLES[key].replace(sql.HOURLY, sql.NATION)})" for name, key in _RECURSIVE.items())
ORACLES["event_study_recursive"] = f"""WITH {sql.NATION}, nb AS (SELECT *, row_number() OVER ({sql.W}) - 1 AS idx, count(*) OVER (PARTITION BY sym) AS n FROM bars),
    sig AS (SELECT nb.sym, nb.bar_ts, idx, n, open, close, indicator, state FROM nb JOIN ({_OWN}) o ON o.sym = nb.sym AND o.bar_ts = nb.bar_ts), {_trades('sym, indicator')}
    SELECT indicator, horizon, side, count(net) AS trades, count(*) FILTER (NOT complete) AS incomplete, round(avg(net), 4) AS avg_net FROM tt GROUP BY ALL"""


def _scans(spark, sf_dir):
    return native.signals(B.hourly(spark, sf_dir), ["ROC"]).select("sym", "bar_ts", "idx", "n", "open", "close", "score")


SCAN = f"WITH {sql.HOURLY}, {sql.KERNELS}, {sql.signals_cte(['ROC'])}"
RET = "(exit - exit * 0.0005::DOUBLE - entry * 1.0005::DOUBLE) / nullif(entry * 1.0005::DOUBLE, 0) * 100"
MOM = f"""{SCAN}, m AS (SELECT sym, idx, bar_ts AS entry_ts, close AS entry, score, lead(close, 3) OVER w AS exit, lead(bar_ts, 3) OVER w AS exit_ts FROM sig WINDOW w AS (PARTITION BY sym ORDER BY idx)),
    mt AS (SELECT sym, idx, entry_ts, exit_ts, entry, exit, 3 AS held, coalesce({RET}, 0) AS return_pct, (entry + exit) * 0.001::DOUBLE / nullif(entry, 0) * 100 AS commission_pct FROM m WHERE score > 0.5 AND exit IS NOT NULL)"""


def _trade_cols(t):
    return t.select("sym", "idx", "entry_ts", "exit_ts", "held", R("return_pct", 5).alias("return_pct"), R("commission_pct", 5).alias("commission_pct"))


QUERIES["strategy_momentum"] = lambda spark, sf_dir: _trade_cols(T.strategy_momentum(_scans(spark, sf_dir)))
ORACLES["strategy_momentum"] = f"{MOM} SELECT sym, idx, entry_ts, exit_ts, held, round(return_pct, 5) AS return_pct, round(commission_pct, 5) AS commission_pct FROM mt"


def _one_position(threshold: str, hold: int) -> str:
    """Entries of one position at a time: a fold over the wishes in order, keeping those from the free bar on."""
    return f"""{SCAN}, wish AS (SELECT sym, list(idx ORDER BY idx) FILTER (score > {threshold}) AS ws, max(n) AS n FROM sig GROUP BY 1),
    folded AS (SELECT sym, n, list_reduce(list_prepend([]::BIGINT[], list_transform(ws, lambda x: [x::BIGINT])), lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] >= acc[len(acc)] + {hold} THEN list_concat(acc, x) ELSE acc END) AS ins FROM wish WHERE ws IS NOT NULL),
    en AS (SELECT sym, n, unnest(ins) AS idx FROM folded),
    mt AS (SELECT en.sym, en.idx, a.bar_ts AS entry_ts, b.bar_ts AS exit_ts, a.close AS entry, b.close AS exit, least(en.idx + {hold}, en.n - 1) - en.idx AS held FROM en JOIN sig a ON a.sym = en.sym AND a.idx = en.idx JOIN sig b ON b.sym = en.sym AND b.idx = least(en.idx + {hold}, en.n - 1))
    SELECT sym, idx, entry_ts, exit_ts, held, round(coalesce({RET}, 0), 5) AS return_pct, round((entry + exit) * 0.001::DOUBLE / nullif(entry, 0) * 100, 5) AS commission_pct FROM mt"""


QUERIES["strategy_threshold"] = lambda spark, sf_dir: _trade_cols(T.strategy_threshold(_scans(spark, sf_dir)))
ORACLES["strategy_threshold"] = _one_position("0.3", 5)
QUERIES["strategy_top10"] = lambda spark, sf_dir: _trade_cols(T.strategy_top10(_scans(spark, sf_dir)))
ORACLES["strategy_top10"] = _one_position("-9", 5)


def strategy_stops(spark, sf_dir):
    """Momentum with a stop at 20 and a target at 30 percent, half size."""
    return _trade_cols(T.strategy_momentum(_scans(spark, sf_dir), stop=20.0, take=30.0, size=0.5))


QUERIES["strategy_stops"] = strategy_stops
ORACLES["strategy_stops"] = f"""{MOM}, s AS (SELECT *, (exit - entry) / nullif(entry, 0) * 100 AS move FROM mt)
    SELECT sym, idx, entry_ts, exit_ts, held, round(coalesce((CASE WHEN move >= 30 THEN entry * 1.3::DOUBLE WHEN move <= -20 THEN entry * 0.8::DOUBLE ELSE exit END - exit * 0.0005::DOUBLE - entry * 1.0005::DOUBLE) / nullif(entry * 1.0005::DOUBLE, 0) * 100, 0) * 0.5::DOUBLE, 5) AS return_pct,
      round(commission_pct, 5) AS commission_pct FROM s"""


def _scaled(spark, sf_dir):
    """Momentum trades, a tenth of the size, so that compounding stays in range."""
    return T.strategy_momentum(_scans(spark, sf_dir), size=0.01)


def trade_metrics(spark, sf_dir):
    days = _scans(spark, sf_dir).groupBy("sym").agg(F.count(F.lit(1)).alias("days"))
    m = T.trade_metrics(_scaled(spark, sf_dir), days)
    return m.select("sym", "trades", *[R(c, 5).alias(c) for c in ("win_rate", "total_return", "max_drawdown", "sharpe", "sortino", "annualised", "avg_held", "commission_pct")])


SCALED = f"{MOM}, st AS (SELECT * REPLACE (return_pct * 0.01::DOUBLE AS return_pct) FROM mt), rs AS (SELECT sym, list(return_pct ORDER BY idx) AS r FROM st GROUP BY 1)"
_WALK = "list_reduce(list_prepend({'v': 1.0::DOUBLE, 'peak': 1.0::DOUBLE, 'dd': 0.0::DOUBLE}, list_transform(r, lambda q: {'v': q, 'peak': q, 'dd': q})), lambda acc, q: {'v': acc.v * (1 + q.v / 100), 'peak': greatest(acc.peak, acc.v * (1 + q.v / 100)), 'dd': greatest(acc.dd, (greatest(acc.peak, acc.v * (1 + q.v / 100)) - acc.v * (1 + q.v / 100)) / greatest(acc.peak, acc.v * (1 + q.v / 100)) * 100)})"
QUERIES["trade_metrics"] = trade_metrics
ORACLES["trade_metrics"] = f"""{SCALED}, d AS (SELECT sym, count(*) AS days FROM sig GROUP BY 1), w AS (SELECT sym, {_WALK} AS k FROM rs),
    g AS (SELECT sym, count(*) AS trades, avg((return_pct > 0)::INT) * 100 AS win_rate, avg(return_pct) AS mean, stddev_pop(return_pct) AS sd, sqrt(avg(return_pct * return_pct) FILTER (return_pct < 0)) AS down, avg(held) AS avg_held, sum(commission_pct) AS commission_pct FROM st GROUP BY 1)
    SELECT sym, trades, round(win_rate, 5) AS win_rate, round((k.v - 1) * 100, 5) AS total_return, round(k.dd, 5) AS max_drawdown, round(CASE WHEN trades >= 2 AND sd > 0 THEN mean / sd ELSE 0 END, 5) AS sharpe,
      round(CASE WHEN trades >= 2 AND down > 0 THEN mean / down ELSE 0 END, 5) AS sortino, round((pow(k.v, 252.0 / days) - 1) * 100, 5) AS annualised, round(avg_held, 5) AS avg_held, round(commission_pct, 5) AS commission_pct FROM g JOIN d USING (sym) JOIN w USING (sym)"""


def drawdown(spark, sf_dir):
    return T.equity(_scaled(spark, sf_dir)).select("sym", "idx", *[R(c, 5).alias(c) for c in ("growth", "peak", "drawdown")])


QUERIES["drawdown"] = drawdown
ORACLES["drawdown"] = f"""{SCALED}, c AS (SELECT sym, idx, list_reduce(list_prepend(1.0::DOUBLE, list(return_pct) OVER w), lambda acc, x: acc * (1 + x / 100)) AS growth FROM st WINDOW w AS (PARTITION BY sym ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    p AS (SELECT *, greatest(1.0, max(growth) OVER (PARTITION BY sym ORDER BY idx)) AS peak FROM c) SELECT sym, idx, round(growth, 5) AS growth, round(peak::DOUBLE, 5) AS peak, round((peak - growth) / peak * 100, 5) AS drawdown FROM p"""


def streaks(spark, sf_dir):
    return T.streaks(_scaled(spark, sf_dir)).select("sym", "best_streak", "worst_streak", R("profit_factor", 5).alias("profit_factor"))


QUERIES["streaks"] = streaks
ORACLES["streaks"] = f"""{SCALED}, a AS (SELECT *, (return_pct > 0)::INT AS win, row_number() OVER (PARTITION BY sym ORDER BY idx) - row_number() OVER (PARTITION BY sym, return_pct > 0 ORDER BY idx) AS run FROM st),
    b AS (SELECT sym, win, run, count(*) AS len, sum(greatest(return_pct, 0)) AS up, sum(greatest(-return_pct, 0)) AS down FROM a GROUP BY ALL)
    SELECT sym, coalesce(max(len) FILTER (win = 1), 0) AS best_streak, coalesce(max(len) FILTER (win = 0), 0) AS worst_streak, round(sum(up) / nullif(sum(down), 0), 5) AS profit_factor FROM b GROUP BY 1"""


def walk_forward(spark, sf_dir):
    return T.walk_forward(_scans(spark, sf_dir)).select("sym", "window", "idx", "entry_ts", "exit_ts", R("return_pct", 5).alias("return_pct"))


QUERIES["walk_forward"] = walk_forward
ORACLES["walk_forward"] = f"""{SCAN}, a AS (SELECT *, (idx - 60) // 20 AS wn FROM sig WHERE idx >= 60),
    b AS (SELECT *, wn AS window_ FROM a UNION ALL SELECT *, wn - 1 FROM a WHERE wn > 0 AND (idx - 60) % 20 < 10),
    c AS (SELECT sym, window_, idx, bar_ts AS entry_ts, close AS entry, score, lead(close, 3) OVER w AS exit, lead(bar_ts, 3) OVER w AS exit_ts FROM b WINDOW w AS (PARTITION BY sym, window_ ORDER BY idx))
    SELECT sym, window_ AS "window", idx, entry_ts, exit_ts, round(coalesce({RET}, 0), 5) AS return_pct FROM c WHERE score > 0.5 AND exit IS NOT NULL"""


def rule_strategies(spark, sf_dir):
    bars = B.hourly(spark, sf_dir)

    def averages(pdf):
        from barwright.operators import kernels as K

        pdf = pdf.sort_values("bar_ts")
        c = pdf["close"].to_numpy(float)
        return pdf[["sym", "bar_ts"]].assign(fast=K.ewm(c, 9), slow=K.ewm(c, 21))

    crosses = bars.select("sym", "bar_ts", "close").groupBy("sym").applyInPandas(averages, "sym string, bar_ts timestamp, fast double, slow double")
    return T.rule_actions(native.kernels(bars), crosses)


PAST = "OVER (PARTITION BY sym ORDER BY bar_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
QUERIES["rule_strategies"] = rule_strategies
ORACLES["rule_strategies"] = f"""WITH {sql.HOURLY}, {sql.KERNELS},
    a AS (SELECT sym, bar_ts, idx, round(rsi, 8) AS rsi, volume, list_reduce(list(close) {PAST}, lambda acc, x: 0.2::DOUBLE * x + 0.8::DOUBLE * acc) AS f, list_reduce(list(close) {PAST}, lambda acc, x: {2 / 22!r}::DOUBLE * x + {1 - 2 / 22!r}::DOUBLE * acc) AS s,
        avg(volume) OVER (PARTITION BY sym ORDER BY bar_ts ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS usual FROM k3),
    b AS (SELECT *, lag(f) OVER (PARTITION BY sym ORDER BY bar_ts) AS pf, lag(s) OVER (PARTITION BY sym ORDER BY bar_ts) AS ps FROM a),
    c AS (SELECT *, coalesce(pf <= ps AND f > s, false) AS up, coalesce(pf >= ps AND f < s, false) AS down FROM b),
    d AS (SELECT *, coalesce((rsi < 35)::INT, 0) + up::INT + coalesce((volume > usual)::INT, 0) AS hits FROM c)
    SELECT sym, bar_ts, CASE WHEN idx = 0 THEN 'BUY' ELSE 'HOLD' END AS buy_hold, CASE WHEN idx >= 26 AND up THEN 'BUY' WHEN idx >= 26 AND down THEN 'SELL' ELSE 'HOLD' END AS "cross",
      CASE WHEN idx >= 14 AND rsi < 30 THEN 'BUY' WHEN idx >= 14 AND rsi > 70 THEN 'SELL' ELSE 'HOLD' END AS reversal, CASE WHEN idx >= 26 AND hits >= 2 THEN 'BUY' WHEN idx >= 26 AND (rsi > 65 OR down) THEN 'SELL' ELSE 'HOLD' END AS combo FROM d"""


def top_signals(spark, sf_dir):
    return T.top_signals(_signals(spark, sf_dir).filter("indicator = 'RSI'"), 3).select("bar_ts", "rank", "sym", "score")


QUERIES["top_signals"] = top_signals
ORACLES["top_signals"] = f"{SIG}, r AS (SELECT bar_ts, row_number() OVER (PARTITION BY bar_ts ORDER BY score DESC, sym) AS rank, sym, score FROM sig WHERE indicator = 'RSI') SELECT bar_ts, rank, sym, score FROM r WHERE rank <= 3"

# ---- campaign -----------------------------------------------------------------------------------------

CUT = """cut AS (SELECT last_, c3 - INTERVAL 3 MONTH - INTERVAL 3 MONTH AS c1, c3 - INTERVAL 3 MONTH AS c2, c3 FROM (SELECT CAST(max(bar_ts) AS DATE) AS last_, CAST(max(bar_ts) AS DATE) - INTERVAL 2 MONTH AS c3 FROM bars))"""


def fold_cuts(spark, sf_dir):
    return C.cuts(B.daily_by_nation(spark, sf_dir))


QUERIES["fold_cuts"] = fold_cuts
ORACLES["fold_cuts"] = f'WITH {sql.NATION}, {CUT} SELECT last_ AS "last", CAST(c1 AS DATE) AS c1, CAST(c2 AS DATE) AS c2, CAST(c3 AS DATE) AS c3 FROM cut'


def fold_day_counts(spark, sf_dir):
    bars = B.daily_by_nation(spark, sf_dir)
    return C.fold_days(bars, C.cuts(bars))


QUERIES["fold_day_counts"] = fold_day_counts
ORACLES["fold_day_counts"] = f"""WITH {sql.NATION}, {CUT}, d AS (SELECT DISTINCT CAST(bar_ts AS DATE) AS day FROM bars),
    f AS (SELECT day, CASE WHEN day <= c1 THEN 'train' WHEN day <= c2 THEN 'val1' WHEN day <= c3 THEN 'val2' ELSE 'holdout' END AS fold FROM d, cut)
    SELECT fold, count(*) AS days, min(day) AS first_day, max(day) AS last_day, count(*) >= CASE fold WHEN 'train' THEN 60 WHEN 'holdout' THEN 30 ELSE 55 END AS enough FROM f GROUP BY 1"""


def equal_folds(spark, sf_dir):
    return C.equal_folds(B.daily_by_nation(spark, sf_dir))


QUERIES["equal_folds"] = equal_folds
ORACLES["equal_folds"] = f"""WITH {sql.NATION}, d AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT bar_ts FROM bars)),
    f AS (SELECT *, least((k - least(60, n - 2)) // greatest((n - least(60, n - 2)) // 3, 1), 2) AS fold FROM d WHERE k >= least(60, n - 2))
    SELECT fold::INT AS fold, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts, count(*) AS days FROM f GROUP BY 1"""


def fold_slices(spark, sf_dir):
    bars = B.daily_by_nation(spark, sf_dir)
    cut = C.cuts(bars)
    out = None
    for fold in ("train", "trainval", "val1", "val2", "holdout"):
        g = C.in_fold(bars, fold, cut).agg(F.lit(fold).alias("fold"), F.count(F.lit(1)).alias("bars"), F.max("bar_ts").alias("last_ts"))
        out = g if out is None else out.unionAll(g)
    return out


QUERIES["fold_slices"] = fold_slices
ORACLES["fold_slices"] = f"""WITH {sql.NATION}, {CUT}, x AS (SELECT bars.*, cut.* FROM bars, cut)
    SELECT 'train' AS fold, count(*) AS bars, max(bar_ts) AS last_ts FROM x WHERE CAST(bar_ts AS DATE) <= c1 UNION ALL SELECT 'trainval', count(*), max(bar_ts) FROM x WHERE CAST(bar_ts AS DATE) <= c2
    UNION ALL SELECT 'val1', count(*), max(bar_ts) FROM x WHERE CAST(bar_ts AS DATE) > c1 AND CAST(bar_ts AS DATE) <= c2 UNION ALL SELECT 'val2', count(*), max(bar_ts) FROM x WHERE CAST(bar_ts AS DATE) > c2 AND CAST(bar_ts AS DATE) <= c3
    UNION ALL SELECT 'holdout', count(*), max(bar_ts) FROM x WHERE CAST(bar_ts AS DATE) > c3"""


def levers(spark, sf_dir):
    return C.levers(native.signals(B.hourly(spark, sf_dir)))


QUERIES["levers"] = levers
ORACLES["levers"] = f"""WITH {sql.HOURLY}, {sql.KERNELS}, {sql.signals_cte()} SELECT indicator, count(*) FILTER (state <> 'HOLD') AS signals FROM sig WHERE category <> 'volatility' GROUP BY 1
    HAVING count(*) FILTER (state <> 'HOLD') > 0 AND count(DISTINCT sym) = (SELECT count(DISTINCT sym) FROM bars)"""


def _grid_trades(spark, sf_dir):
    return C.combo_trades(_signals(spark, sf_dir), C.combos(spark, STUDIED, 2))


def _grid_sql(head: str, warmup: int = 60) -> str:
    """CTEs up to the trades `tt` of singles and pairs over a CTE `sig`."""
    return f"""{head}, one AS (SELECT DISTINCT indicator FROM sig), grid AS (SELECT indicator AS combo, indicator AS a, indicator AS b FROM one UNION ALL SELECT x.indicator || '+' || y.indicator, x.indicator, y.indicator FROM one x JOIN one y ON x.indicator < y.indicator),
    cs AS (SELECT p.sym, p.bar_ts, p.idx, p.n, p.open, p.close, grid.combo, CASE WHEN p.state = q.state THEN p.state ELSE 'HOLD' END AS state FROM grid JOIN sig p ON p.indicator = grid.a JOIN sig q ON q.indicator = grid.b AND q.sym = p.sym AND q.idx = p.idx),
    {_trades('sym, combo', 'cs', warmup)}"""


GRID = _grid_sql(SIG)


def combo_grid(spark, sf_dir):
    s = T.event_study(_grid_trades(spark, sf_dir), ("combo",))
    return s.select("combo", "horizon", "side", "trades", "incomplete", R("hit_rate", 5).alias("hit_rate"), R("avg_net", 4).alias("avg_net"))


QUERIES["combo_grid"] = combo_grid
ORACLES["combo_grid"] = f"{GRID} SELECT combo, horizon, side, count(net) AS trades, count(*) FILTER (NOT complete) AS incomplete, round(avg((net > 0)::INT), 5) AS hit_rate, round(avg(net), 4) AS avg_net FROM tt GROUP BY ALL"

def _panel_sql(grid: str) -> str:
    return f"""{grid}, days AS (SELECT bar_ts AS day, count(DISTINCT sym) AS symbols FROM sig GROUP BY 1), keys AS (SELECT DISTINCT combo FROM tt),
    nets AS (SELECT combo, exit_ts AS day, sum(net) AS net FROM tt WHERE side = 'long' AND horizon = 10 AND complete GROUP BY ALL),
    panel AS (SELECT keys.combo, days.day, coalesce(net / symbols, 0) AS x FROM keys CROSS JOIN days LEFT JOIN nets ON nets.combo = keys.combo AND nets.day = days.day)"""


PANEL = _panel_sql(GRID)


def _panel(spark, sf_dir):
    return C.panel(_grid_trades(spark, sf_dir), B.hourly(spark, sf_dir))


QUERIES["panel_daily"] = lambda spark, sf_dir: _panel(spark, sf_dir).select("combo", "day", R("x", 4).alias("x"))
ORACLES["panel_daily"] = f"{PANEL} SELECT combo, day, round(x, 4) AS x FROM panel"

_LAGGED = ", ".join(f"coalesce(sum(dev * d{i}), 0) AS g{i}" for i in range(1, 11))
def _stats_sql(panel: str) -> str:
    return f"""{panel}, dv AS (SELECT *, x - avg(x) OVER (PARTITION BY combo) AS dev FROM panel),
    lg AS (SELECT *, {', '.join(f"lag(dev, {i}) OVER (PARTITION BY combo ORDER BY day) AS d{i}" for i in range(1, 11))} FROM dv),
    gs AS (SELECT combo, count(*) AS days, avg(x) AS mean, avg(dev * dev) AS m2, avg(dev * dev * dev) AS m3, avg(dev * dev * dev * dev) AS m4, {_LAGGED} FROM lg GROUP BY 1),
    st AS (SELECT *, CASE WHEN m2 > 1e-18 THEN sqrt(greatest(m2 + {' + '.join(f"2 * (1 - {i} / 11.0::DOUBLE) * g{i} / days" for i in range(1, 11))}, 0)) ELSE 0 END AS long_sd FROM gs)"""


STATS = _stats_sql(PANEL)


def newey_west(spark, sf_dir):
    s = C.series_statistics(_panel(spark, sf_dir))
    return s.select("combo", "days", *[R(c, 4).alias(c) for c in ("mean", "long_sd", "skew", "kurt", "sr")])


QUERIES["newey_west"] = newey_west
ORACLES["newey_west"] = f"""{STATS} SELECT combo, days, round(mean, 4) AS mean, round(long_sd::DOUBLE, 4) AS long_sd, round(CASE WHEN m2 > 1e-18 THEN m3 / pow(m2, 1.5) ELSE 0 END::DOUBLE, 4) AS skew, round(CASE WHEN m2 > 1e-18 THEN m4 / (m2 * m2) ELSE 0 END::DOUBLE, 4) AS kurt,
    round(CASE WHEN long_sd > 1e-12 THEN mean / long_sd END, 4) AS sr FROM st"""


#: Levers of the campaign: all native indicators but those of risk.
LEVERS = sorted(set(native.NATIVE) - {"ATR", "Bollinger Bands", "Donchian Channel"})
FOLDS = ("val1", "val2")


def _fold_signals(spark, sf_dir, fold, names):
    """The signals of a fold of the daily bars, numbered within it."""
    bars = B.daily_by_nation(spark, sf_dir)
    return C.sliced(native.signals(bars, names), fold, C.cuts(bars))


def _slice_sql(names, where):
    """CTEs up to `sig`: the signals of a fold of the daily bars."""
    return f"""WITH {sql.NATION}, {sql.KERNELS}, {CUT}, {sql.signals_cte(names).replace('sig AS (', 'sig0 AS (', 1)},
    sig AS (SELECT sig0.sym, bar_ts, row_number() OVER own - 1 AS idx, count(*) OVER (PARTITION BY sig0.sym, indicator) AS n, open, close, indicator, CASE WHEN idx >= 60 THEN state ELSE 'HOLD' END AS state
      FROM sig0, cut WHERE {where} WINDOW own AS (PARTITION BY sig0.sym, indicator ORDER BY bar_ts))"""


IN_FOLD = {"val1": "CAST(bar_ts AS DATE) > c1 AND CAST(bar_ts AS DATE) <= c2", "val2": "CAST(bar_ts AS DATE) > c2 AND CAST(bar_ts AS DATE) <= c3", "holdout": "CAST(bar_ts AS DATE) > c3"}


def _fold_statistics(spark, sf_dir, fold, names, most):
    """(statistics, trades, days) of a pass over a fold; the trades are written once."""
    signals = _fold_signals(spark, sf_dir, fold, names)
    trades = shared.written(C.combo_trades(signals, C.combos(spark, names, most), warmup=0), f"trades-{fold}")
    bars = shared.written(signals.filter(F.col("indicator") == names[0]).select("sym", "bar_ts"), f"bars-{fold}")
    return C.series_statistics(C.panel(trades, bars)), trades, bars.select("bar_ts").distinct().count()


def fold_statistics(spark, sf_dir):
    out = None
    for fold in FOLDS:
        s = _fold_statistics(spark, sf_dir, fold, STUDIED, 2)[0].select(F.lit(fold).alias("fold"), "combo", "days", *[R(c, 4).alias(c) for c in ("mean", "long_sd", "sr")])
        out = s if out is None else out.unionAll(s)
    return out


QUERIES["fold_statistics"] = fold_statistics
ORACLES["fold_statistics"] = " UNION ALL ".join(
    f"SELECT * FROM ({_stats_sql(_panel_sql(_grid_sql(_slice_sql(STUDIED, IN_FOLD[f]), 0)))} SELECT '{f}' AS fold, combo, days, round(mean, 4) AS mean, round(long_sd::DOUBLE, 4) AS long_sd, round(CASE WHEN long_sd > 1e-12 THEN mean / long_sd END, 4) AS sr FROM st)" for f in FOLDS)


def eligible_combos(spark, sf_dir):
    """The five best combinations of the second fold that both folds bear out, with ten long trades in each."""
    tables = []
    for fold in FOLDS:
        stats, trades, _ = _fold_statistics(spark, sf_dir, fold, STUDIED, 2)
        long = trades.filter("side = 'long' and horizon = 10 and complete").groupBy("combo").agg(F.count(F.lit(1)).alias("trades"))
        tables.append(stats.join(long, "combo"))
    return C.eligible_keys(*tables, k=5, least=10).select("combo", R("sr1", 4).alias("sr1"), "trades1", R("sr2", 4).alias("sr2"), "trades2")


def _eligible_sql(fold):
    return f"""({_stats_sql(_panel_sql(_grid_sql(_slice_sql(STUDIED, IN_FOLD[fold]), 0)))} SELECT st.combo, CASE WHEN long_sd > 1e-12 THEN mean / long_sd END AS sr, k AS trades
      FROM st JOIN (SELECT combo, count(*) AS k FROM tt WHERE side = 'long' AND horizon = 10 AND complete GROUP BY 1) c ON c.combo = st.combo)"""


QUERIES["eligible_combos"] = eligible_combos
ORACLES["eligible_combos"] = f"""SELECT a.combo, round(a.sr, 4) AS sr1, a.trades AS trades1, round(b.sr, 4) AS sr2, b.trades AS trades2 FROM {_eligible_sql('val1')} a JOIN {_eligible_sql('val2')} b ON b.combo = a.combo
    WHERE a.sr * b.sr > 0 AND a.trades >= 10 AND b.trades >= 10 ORDER BY b.sr DESC, a.combo LIMIT 5"""


def _charged(spark, n):
    """Trials of the passes over both folds, each of n combinations: the second pays for the first as well."""
    return {r.fold: r.trials for r in C.trial_ledger(spark.createDataFrame([(k, f, n) for k, f in enumerate(FOLDS)], "k int, fold string, trials long")).collect()}


def _gated(spark, sf_dir):
    n = C.combos(spark, LEVERS, 3).count()
    charged, tables, long = _charged(spark, n), {}, None
    for fold in FOLDS:
        stats, trades, days = _fold_statistics(spark, sf_dir, fold, LEVERS, 3)
        tables[fold] = shared.written(C.deflated(stats, days, charged[fold]), f"deflated-{fold}")
        own = trades.filter("side = 'long' and horizon = 10 and complete").select("combo")
        long = own if long is None else long.unionAll(own)
    return tables, C.gate(tables["val1"], tables["val2"], long.groupBy("combo").agg(F.count(F.lit(1)).alias("trades")))


def dsr(spark, sf_dir):
    tables, _ = _gated(spark, sf_dir)
    out = [tables[f].select(F.lit(f).alias("fold"), "combo", R("sr", 6).alias("sr"), R("z", 6).alias("z"), R("dsr", 6).alias("dsr"), R("bar", 6).alias("bar")) for f in FOLDS]
    return out[0].unionAll(out[1])


QUERIES["dsr"] = dsr


def gate_rows(spark, sf_dir):
    """Every combination on both folds, with what the gate says of it."""
    g = _gated(spark, sf_dir)[1]
    return g.select("combo", *[R(c, 6).alias(c) for c in ("sr1", "dsr1", "sr2", "dsr2")], "trades", "same_sign", "passes_ratio", "passes_trades", "passes")


QUERIES["gate_rows"] = gate_rows
QUERIES["gate_verdict"] = lambda spark, sf_dir: C.verdict(_gated(spark, sf_dir)[1])


#: Trials charged to each fold: all combinations of one to three levers, once and twice.
CHARGED = {f: (k + 1) * sum(math.comb(len(LEVERS), n) for n in (1, 2, 3)) for k, f in enumerate(FOLDS)}


def _triples_sql(head):
    """CTEs up to the trades `tt` of singles, pairs and triples over a CTE `sig`."""
    return f"""{head}, one AS (SELECT DISTINCT indicator AS i FROM sig), grid AS (SELECT i AS combo, i AS a, i AS b, i AS c FROM one UNION ALL SELECT x.i || '+' || y.i, x.i, y.i, y.i FROM one x JOIN one y ON x.i < y.i
      UNION ALL SELECT x.i || '+' || y.i || '+' || z.i, x.i, y.i, z.i FROM one x JOIN one y ON x.i < y.i JOIN one z ON y.i < z.i),
    cs AS (SELECT p.sym, p.bar_ts, p.idx, p.n, p.open, p.close, grid.combo, CASE WHEN p.state = q.state AND p.state = r.state THEN p.state ELSE 'HOLD' END AS state
      FROM grid JOIN sig p ON p.indicator = grid.a JOIN sig q ON q.indicator = grid.b AND q.sym = p.sym AND q.idx = p.idx JOIN sig r ON r.indicator = grid.c AND r.sym = p.sym AND r.idx = p.idx),
    {_trades('sym, combo', 'cs', 0)}"""


def _dsr_sql(fold):
    """A CTE `d` of a fold: combo, sr, z, dsr, bar and its long trades."""
    bar = C.expected_best(1.0, CHARGED[fold])
    return f"""{_stats_sql(_panel_sql(_triples_sql(_slice_sql(LEVERS, IN_FOLD[fold]))))},
    rt AS (SELECT combo, days, CASE WHEN long_sd > 1e-12 THEN mean / long_sd END AS sr, CASE WHEN m2 > 1e-18 THEN m3 / pow(m2, 1.5) ELSE 0 END AS skew, CASE WHEN m2 > 1e-18 THEN m4 / (m2 * m2) ELSE 0 END AS kurt FROM st),
    rz AS (SELECT combo, sr, (SELECT stddev_samp(sr) FROM rt) * {bar!r}::DOUBLE AS bar, days, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS v FROM rt WHERE sr IS NOT NULL),
    ry AS (SELECT combo, sr, bar, (sr - bar) * sqrt(days - 1) / sqrt(CASE WHEN v > 0 THEN v END) AS z FROM rz),
    d AS (SELECT ry.*, {sql.phi('z')} AS dsr, coalesce(k, 0) AS trades FROM ry LEFT JOIN (SELECT combo, count(*) AS k FROM tt WHERE side = 'long' AND horizon = 10 AND complete GROUP BY 1) c ON c.combo = ry.combo)"""


ORACLES["dsr"] = " UNION ALL ".join(f"SELECT * FROM ({_dsr_sql(f)} SELECT '{f}' AS fold, combo, round(sr, 6) AS sr, round(z, 6) AS z, round(dsr, 6) AS dsr, round(bar, 6) AS bar FROM d)" for f in FOLDS)
_GATED = f"""g AS (SELECT a.combo, a.sr AS sr1, a.dsr AS dsr1, b.sr AS sr2, b.dsr AS dsr2, a.trades + b.trades AS trades, sign(a.sr) = sign(b.sr) AND a.sr <> 0 AS same_sign
      FROM ({_dsr_sql('val1')} SELECT * FROM d) a JOIN ({_dsr_sql('val2')} SELECT * FROM d) b ON b.combo = a.combo),
    h AS (SELECT *, dsr1 >= 0.95 AND dsr2 >= 0.95 AND same_sign AS passes_ratio, trades >= 400 AS passes_trades FROM g)"""
ORACLES["gate_rows"] = f"WITH {_GATED} SELECT combo, round(sr1, 6) AS sr1, round(dsr1, 6) AS dsr1, round(sr2, 6) AS sr2, round(dsr2, 6) AS dsr2, trades::BIGINT AS trades, same_sign, passes_ratio, passes_trades, passes_ratio AND passes_trades AS passes FROM h"
ORACLES["gate_verdict"] = f"""WITH {_GATED}, c AS (SELECT count(*) FILTER (passes_ratio AND passes_trades) AS passing, count(*) FILTER (passes_ratio) AS ratio_only FROM h)
    SELECT CASE WHEN passing > 0 THEN 'LEADERBOARD' ELSE 'NO-EDGE' END AS verdict, passing, CASE WHEN passing > 0 THEN NULL WHEN ratio_only > 0 THEN 'too few trades' ELSE 'no ratio on both folds' END AS reason FROM c"""


def trial_ledger(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return C.trial_ledger(n.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("fold"), F.col("n_regionkey").cast("string")).alias("fold"), F.length("n_name").cast("long").alias("trials")))


QUERIES["trial_ledger"] = trial_ledger
ORACLES["trial_ledger"] = """WITH e AS (SELECT n_nationkey AS k, 'fold' || n_regionkey AS fold, sum(length(n_name)) OVER (ORDER BY n_nationkey)::BIGINT AS trials FROM nation)
    SELECT fold, arg_max(trials, k) AS trials FROM e GROUP BY 1 UNION ALL SELECT 'total', arg_max(trials, k) FROM e"""


def metric_block(spark, sf_dir):
    return C.metric_block(_grid_trades(spark, sf_dir).filter("horizon = 10"), reps=199)


QUERIES["metric_block"] = metric_block


QUERIES["metric_rows"] = lambda spark, sf_dir: C.metric_rows(_grid_trades(spark, sf_dir))
ORACLES["metric_rows"] = f"{GRID} SELECT combo, side, horizon, count(*) AS trades, round(avg((net > 0)::INT), 4) AS hit_rate, round(avg(net), 4) AS mean_net, round(quantile_cont(net, 0.5), 4) AS median_net FROM tt WHERE complete GROUP BY ALL"


def bh_ranking(spark, sf_dir):
    """Discoveries among tests whose p values come from parts, so that both engines hold the same."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    tests = p.select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") % 3).alias("fold"), (F.col("p_retailprice") % 1000 / 1000 * F.col("p_size") / 200).alias("p"))
    return C.discoveries(tests).select("name", "fold", R("p", 8).alias("p"), "significant")


QUERIES["bh_ranking"] = bh_ranking
ORACLES["bh_ranking"] = """WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS name, p_size % 3 AS fold, p_retailprice % 1000 / 1000 * p_size / 200 AS p FROM part),
    r AS (SELECT *, row_number() OVER (ORDER BY p, name, fold) AS rk, count(*) OVER () AS m FROM t), l AS (SELECT max(p) AS lim FROM r WHERE p <= 0.1 * rk / m)
    SELECT name, fold, round(p, 8) AS p, coalesce(p <= lim, false) AS significant FROM r, l"""


def campaign_ranking(spark, sf_dir):
    """Indicators over three folds of the daily bars, ranked by discoveries."""
    bars = B.daily_by_nation(spark, sf_dir)
    trades = T.event_trades(native.signals(bars, STUDIED))
    folds = C.equal_folds(bars)
    joined = trades.join(F.broadcast(folds.select("fold", "first_ts", "last_ts")), F.col("bar_ts").between(F.col("first_ts"), F.col("last_ts")))
    r = C.ranked_discoveries(C.test_rows(joined.drop("first_ts", "last_ts"), F.col("fold")))
    return r.select("name", "folds", "trades", R("mean", 4).alias("mean"))


QUERIES["campaign_ranking"] = campaign_ranking
ORACLES["campaign_ranking"] = f"""WITH {sql.NATION}, {sql.KERNELS}, {sql.signals_cte(STUDIED)}, {_trades('sym, indicator')},
    dk AS (SELECT bar_ts, row_number() OVER (ORDER BY bar_ts) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT bar_ts FROM bars)),
    fd AS (SELECT bar_ts, least((k - least(60, n - 2)) // greatest((n - least(60, n - 2)) // 3, 1), 2) AS fold FROM dk WHERE k >= least(60, n - 2)),
    ts AS (SELECT indicator AS name, fold, count(net) AS n, avg(net) AS mean, stddev_samp(net) AS sd FROM tt JOIN fd USING (bar_ts) WHERE side = 'long' AND horizon = 10 AND complete GROUP BY ALL HAVING count(net) >= 2 AND stddev_samp(net) > 0),
    tp AS (SELECT *, 1 - ({sql.phi('mean / (sd / sqrt(n))')}) AS p FROM ts), rk AS (SELECT *, row_number() OVER (ORDER BY p, name, fold) AS rk, count(*) OVER () AS m FROM tp),
    lim AS (SELECT max(p) AS lim FROM rk WHERE p <= 0.1 * rk / m)
    SELECT name, count(*) FILTER (p <= lim) AS folds, sum(n)::BIGINT AS trades, round(sum(mean * n) / sum(n), 4) AS mean FROM rk, lim GROUP BY 1"""


def _holdout_trades(spark, sf_dir, grid):
    return C.combo_trades(_fold_signals(spark, sf_dir, "holdout", STUDIED), grid, warmup=0)


def holdout_rows(spark, sf_dir):
    """The chosen combinations on the days after the last cut."""
    grid = C.combos(spark, STUDIED, 2)
    known = [r.combo for r in grid.select("combo").collect()]
    return C.holdout(_holdout_trades(spark, sf_dir, grid), ["ROC", "MFI+VWAP"], known=known).select("combo", "horizon", "side", "trades", "incomplete", R("avg_net", 4).alias("avg_net"))


QUERIES["holdout"] = holdout_rows
ORACLES["holdout"] = f"""{_grid_sql(_slice_sql(STUDIED, IN_FOLD['holdout']), 0)} SELECT combo, horizon, side, count(net) AS trades, count(*) FILTER (NOT complete) AS incomplete, round(avg(net), 4) AS avg_net FROM tt WHERE combo IN ('ROC', 'MFI+VWAP') GROUP BY ALL"""


def holdout_span(spark, sf_dir):
    """Bars of the opened holdout by symbol, and how many of them lie at or before the cut."""
    bars = B.daily_by_nation(spark, sf_dir)
    cut = C.cuts(bars)
    s = C.sliced(native.signals(bars, ["ROC"]), "holdout", cut)
    early = C.opened_early(s, cut).groupBy("sym").agg(F.count(F.lit(1)).alias("early"))
    g = s.groupBy("sym").agg(F.count(F.lit(1)).alias("bars"), F.max("idx").alias("last_idx"), F.min("bar_ts").alias("first_ts"))
    return g.join(early, "sym", "left").select("sym", "bars", "last_idx", "first_ts", F.coalesce("early", F.lit(0).cast("long")).alias("early"))


QUERIES["holdout_span"] = holdout_span
ORACLES["holdout_span"] = f"WITH {sql.NATION}, {CUT} SELECT sym, count(*) AS bars, (count(*) - 1)::INT AS last_idx, min(bar_ts) AS first_ts, 0::BIGINT AS early FROM bars, cut WHERE CAST(bar_ts AS DATE) > c3 GROUP BY 1"


def churn(spark, sf_dir):
    classes = B.hourly(spark, sf_dir).select("sym").distinct().withColumn("class", F.when(F.length("sym") > 5, "scored")).filter("class is not null")
    return C.churn(_grid_trades(spark, sf_dir), classes)


QUERIES["churn"] = churn
ORACLES["churn"] = f"{GRID} SELECT combo, CASE WHEN length(sym) > 5 THEN 'scored' ELSE 'dead' END AS class, count(*) AS trades, sign(round(avg(net), 9))::DOUBLE AS sign FROM tt WHERE complete GROUP BY ALL"

QUERIES["best_combos"] = lambda spark, sf_dir: C.best_keys(C.series_statistics(_panel(spark, sf_dir)), 5).select("combo", R("sr", 4).alias("sr"))
ORACLES["best_combos"] = f"{STATS} SELECT combo, round(mean / long_sd, 4) AS sr FROM st WHERE long_sd > 1e-12 ORDER BY mean / long_sd DESC, combo LIMIT 5"
QUERIES["listing_sha"] = lambda spark, sf_dir: C.listing_digest(B.daily_by_nation(spark, sf_dir))
ORACLES["listing_sha"] = f"""WITH {sql.NATION}, l AS (SELECT sym || ',' || strftime(max(bar_ts), '%Y-%m-%d') AS line FROM bars GROUP BY sym) SELECT count(*) AS symbols, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l"""


def _frozen(spark, sf_dir):
    return shared.written(C.snapshot(B.daily_by_nation(spark, sf_dir)), "snapshot")


def snapshot_rows(spark, sf_dir):
    return _frozen(spark, sf_dir).select("symbols", "digest", "last", "c1", "c2", "c3", F.explode("fold_days").alias("f")).select("symbols", "digest", "last", "c1", "c2", "c3", "f.fold", "f.days")


_LISTED = "l AS (SELECT sym || ',' || strftime(max(bar_ts), '%Y-%m-%d') AS line FROM bars GROUP BY sym), dg AS (SELECT count(*) AS symbols, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l)"
_DAYS = "d AS (SELECT DISTINCT CAST(bar_ts AS DATE) AS day FROM bars), fd AS (SELECT CASE WHEN day <= c1 THEN 'train' WHEN day <= c2 THEN 'val1' WHEN day <= c3 THEN 'val2' ELSE 'holdout' END AS fold, count(*) AS days FROM d, cut GROUP BY 1)"
QUERIES["snapshot"] = snapshot_rows
ORACLES["snapshot"] = f'WITH {sql.NATION}, {CUT}, {_LISTED}, {_DAYS} SELECT symbols, digest, last_ AS "last", CAST(c1 AS DATE) AS c1, CAST(c2 AS DATE) AS c2, CAST(c3 AS DATE) AS c3, fold, days FROM dg, cut, fd'


def snapshot_drift(spark, sf_dir):
    """A snapshot against the store that it froze, one that has lost its last days, and one of other cuts."""
    frozen, bars = _frozen(spark, sf_dir), B.daily_by_nation(spark, sf_dir)
    cases = {"same": (frozen, bars), "shorter": (frozen, bars.filter(F.to_date("bar_ts") <= F.lit("1998-01-01").cast("date"))), "other cuts": (frozen.withColumn("c1", F.date_add("c1", 1)), bars)}
    out = None
    for name, (f, b) in cases.items():
        r = C.snapshot_reasons(f, b).select(F.lit(name).alias("store"), F.array_join("reasons", ",").alias("reasons"))
        out = r if out is None else out.unionAll(r)
    return out


def _moved(where="true", c1="c1"):
    return f"(SELECT list(f ORDER BY f) FROM (SELECT fold || count(*) AS f FROM (SELECT DISTINCT CAST(bar_ts AS DATE) AS day, CASE WHEN CAST(bar_ts AS DATE) <= {c1} THEN 'train' WHEN CAST(bar_ts AS DATE) <= c2 THEN 'val1' WHEN CAST(bar_ts AS DATE) <= c3 THEN 'val2' ELSE 'holdout' END AS fold FROM bars, cut WHERE {where}) GROUP BY fold))"


_SHORT = "CAST(bar_ts AS DATE) <= DATE '1998-01-01'"
QUERIES["snapshot_drift"] = snapshot_drift
ORACLES["snapshot_drift"] = f"""WITH {sql.NATION}, {CUT} SELECT 'same' AS store, '' AS reasons
    UNION ALL SELECT 'shorter', concat_ws(',', CASE WHEN (SELECT list(x ORDER BY x) FROM (SELECT sym || max(bar_ts) AS x FROM bars GROUP BY sym)) <> (SELECT list(x ORDER BY x) FROM (SELECT sym || max(bar_ts) AS x FROM bars WHERE {_SHORT} GROUP BY sym)) THEN 'listing' END, CASE WHEN {_moved()} <> {_moved(_SHORT)} THEN 'fold days' END)
    UNION ALL SELECT 'other cuts', concat_ws(',', 'cuts', CASE WHEN {_moved()} <> {_moved(c1='c1 + INTERVAL 1 DAY')} THEN 'fold days' END)"""


def attested(spark, sf_dir):
    """Whether streams may stand for a snapshot: those of its run, of another run, and without slices."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    frozen = n.filter("n_nationkey = 1").select(F.col("n_name").alias("run"), F.sha2("n_name", 256).alias("digest"))
    other = n.filter("n_nationkey = 2").select(F.col("n_name").alias("run"), F.sha2("n_name", 256).alias("digest"))
    slices = n.select(F.concat(F.lit("val"), F.col("n_regionkey").cast("string")).alias("fold"))
    cases = {"same": (frozen, "val1"), "other": (other, "val1"), "no slices": (frozen, "val9"), "none": (other.limit(0), "val1")}
    out = None
    for name, (s, fold) in cases.items():
        r = C.attestation(frozen, s, slices, fold).select(F.lit(name).alias("streams"), F.array_join("reasons", ",").alias("reasons"))
        out = r if out is None else out.unionAll(r)
    return out


QUERIES["attestation"] = attested
ORACLES["attestation"] = "SELECT 'same' AS streams, '' AS reasons UNION ALL SELECT 'other', CASE WHEN a.n_name <> b.n_name THEN 'run,digest' ELSE '' END FROM nation a, nation b WHERE a.n_nationkey = 1 AND b.n_nationkey = 2 UNION ALL SELECT 'no slices', CASE WHEN (SELECT count(*) FROM nation WHERE n_regionkey = 9) = 0 THEN 'no slices' ELSE '' END UNION ALL SELECT 'none', 'run,digest'"
