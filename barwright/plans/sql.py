"""DuckDB SQL fragments that the oracles share."""

from __future__ import annotations

HOURLY = """bars AS (
  SELECT event_type AS sym, date_trunc('hour', ts) AS bar_ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""

NATION = """bars AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS sym, l_shipdate AS bar_ts, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""

BRAND = """bars AS (
  SELECT p_brand AS sym, l_shipdate AS bar_ts, arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS open,
         max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

W = "PARTITION BY sym ORDER BY bar_ts"


def roll(fn: str, col: str, n: int) -> str:
    w = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} = {n} THEN {fn}({col}) {w} END"


def lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) OVER ({W})"


def clamp(x: str) -> str:
    return f"coalesce(greatest(-1.0, least(1.0, {x})), 0.0)"


EPS = "2.220446049250313e-16"

#: k0 .. k3: the kernel columns in stages, over a CTE named bars.
KERNELS = f"""k0 AS (
  SELECT *, row_number() OVER ({W}) - 1 AS idx, count(*) OVER (PARTITION BY sym) AS n, {lag('close')} AS pc, {lag('high')} AS ph, {lag('low')} AS pl, (high + low + close) / 3 AS tp FROM bars),
k1a AS (
  SELECT *, close - pc AS ch, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS pdm, tp - {lag('tp')} AS dtp, tp * volume AS flow,
         greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM k0),
k1 AS (
  SELECT *, CASE WHEN ch IS NOT NULL THEN greatest(ch, 0) END AS gain, CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0) END AS loss,
         CASE WHEN pl - low > pdm AND pl - low > 0 THEN pl - low ELSE 0.0 END AS mdm, coalesce(sign(ch), 0) * volume AS sv,
         CASE WHEN dtp > 0 THEN flow ELSE 0.0 END AS fin, CASE WHEN dtp < 0 THEN flow ELSE 0.0 END AS fout FROM k1a),
k2 AS (
  SELECT *, {roll('avg', 'gain', 14)} AS gain14, {roll('avg', 'loss', 14)} AS loss14, {roll('min', 'low', 14)} AS low14, {roll('max', 'high', 14)} AS high14,
         {roll('avg', 'tp', 20)} AS tp20, list(tp) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS tps, {lag('close', 10)} AS c10,
         {roll('avg', 'tr', 14)} AS atr14, {roll('avg', 'pdm', 14)} AS p14, {roll('avg', 'mdm', 14)} AS m14,
         {roll('avg', 'close', 20)} AS sma20, {roll('stddev_samp', 'close', 20)} AS sd20, {roll('max', 'high', 20)} AS high20, {roll('min', 'low', 20)} AS low20,
         ({roll('max', 'high', 9)} + {roll('min', 'low', 9)}) / 2 AS conv, ({roll('max', 'high', 26)} + {roll('min', 'low', 26)}) / 2 AS basel,
         ({roll('max', 'high', 52)} + {roll('min', 'low', 52)}) / 2 AS span_b,
         sum(sv) OVER ({W}) AS obv, {roll('avg', 'fin', 14)} AS in14, {roll('avg', 'fout', 14)} AS out14,
         sum(flow) OVER ({W}) / (sum(volume) OVER ({W}) + {EPS}) AS vwap, {roll('avg', 'close', 50)} AS sma50, {roll('avg', 'close', 200)} AS sma200 FROM k1),
k2b AS (
  SELECT *, 100 - 100 / (1 + gain14 / CASE WHEN loss14 = 0 THEN {EPS} ELSE loss14 END) AS rsi,
         100 * (close - low14) / CASE WHEN high14 = low14 THEN {EPS} ELSE high14 - low14 END AS stoch_k,
         (high14 - close) / CASE WHEN high14 = low14 THEN {EPS} ELSE high14 - low14 END * -100 AS williams,
         list_sum(list_transform(tps, lambda x: abs(x - tp20))) / 20 AS mad20, 100 * (close / nullif(c10, 0) - 1) AS roc,
         100 * p14 / (atr14 + {EPS}) AS plus_di, 100 * m14 / (atr14 + {EPS}) AS minus_di, (conv + basel) / 2 AS span_a,
         100 - 100 / (1 + in14 / (out14 + {EPS})) AS mfi, sma20 + 2 * sd20 AS upper, sma20 - 2 * sd20 AS lower FROM k2),
k2c AS (
  SELECT *, (tp - tp20) / (0.015 * CASE WHEN mad20 = 0 THEN {EPS} ELSE mad20 END) AS cci, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + {EPS}) AS dx FROM k2b),
k3 AS (
  SELECT *, {roll('avg', 'stoch_k', 3)} AS stoch_d, {roll('avg', 'dx', 14)} AS adx, obv - {lag('obv', 20)} AS obv_trend FROM k2c)"""

#: name -> (category, state, score, reported values as SQL) over k3.
INDICATORS = {
    "RSI": ("momentum", "CASE WHEN round(rsi, 8) > 70 THEN 'SELL' WHEN round(rsi, 8) < 30 THEN 'BUY' ELSE 'HOLD' END",
            "CASE WHEN round(rsi, 8) > 70 THEN -(round(rsi, 8) - 70) / 30 WHEN round(rsi, 8) < 30 THEN (30 - round(rsi, 8)) / 30 ELSE (round(rsi, 8) - 50) / 50 END", {"rsi": "rsi"}),
    "Stochastic": ("momentum", "CASE WHEN idx < 14 THEN 'HOLD' WHEN round(stoch_k, 8) < 20 AND round(stoch_k, 8) > round(stoch_d, 8) THEN 'BUY' WHEN round(stoch_k, 8) > 80 AND round(stoch_k, 8) < round(stoch_d, 8) THEN 'SELL' ELSE 'HOLD' END",
                   "CASE WHEN idx < 14 THEN 0.0 WHEN round(stoch_k, 8) < 20 AND round(stoch_k, 8) > round(stoch_d, 8) THEN (20 - round(stoch_k, 8)) / 20 WHEN round(stoch_k, 8) > 80 AND round(stoch_k, 8) < round(stoch_d, 8) THEN (80 - round(stoch_k, 8)) / 20 ELSE (round(stoch_k, 8) - 50) / 50 END", {"stoch_k": "stoch_k", "stoch_d": "stoch_d"}),
    "Williams %R": ("momentum", "CASE WHEN idx < 14 THEN 'HOLD' WHEN round(williams, 8) > -20 THEN 'BUY' WHEN round(williams, 8) < -80 THEN 'SELL' ELSE 'HOLD' END",
                    "CASE WHEN idx < 14 THEN 0.0 WHEN round(williams, 8) > -20 THEN (round(williams, 8) + 20) / 60 WHEN round(williams, 8) < -80 THEN (round(williams, 8) + 80) / 60 ELSE (round(williams, 8) + 50) / 100 END", {"williams": "williams"}),
    "CCI": ("momentum", "CASE WHEN idx < 20 THEN 'HOLD' WHEN round(cci, 8) < -100 THEN 'BUY' WHEN round(cci, 8) > 100 THEN 'SELL' ELSE 'HOLD' END",
            "CASE WHEN idx < 20 THEN 0.0 WHEN round(cci, 8) < -100 THEN (-100 - round(cci, 8)) / 200 WHEN round(cci, 8) > 100 THEN (100 - round(cci, 8)) / 200 ELSE round(cci, 8) / 200 END", {"cci": "cci"}),
    "ROC": ("momentum", "CASE WHEN round(roc, 8) > 0 THEN 'BUY' WHEN round(roc, 8) < 0 THEN 'SELL' ELSE 'HOLD' END", "CASE WHEN round(roc, 8) <> 0 THEN round(roc, 8) / 20 ELSE 0.0 END", {"roc": "roc"}),
    "ADX": ("trend", "CASE WHEN round(adx, 8) > 25 AND round(plus_di, 8) > round(minus_di, 8) THEN 'BUY' WHEN round(adx, 8) > 25 AND round(minus_di, 8) > round(plus_di, 8) THEN 'SELL' ELSE 'HOLD' END",
            "CASE WHEN round(adx, 8) > 25 AND round(plus_di, 8) > round(minus_di, 8) THEN round(adx, 8) / 100 WHEN round(adx, 8) > 25 AND round(minus_di, 8) > round(plus_di, 8) THEN -round(adx, 8) / 100 ELSE 0.0 END", {"adx": "adx", "plus_di": "plus_di", "minus_di": "minus_di"}),
    "Ichimoku": ("trend", "CASE WHEN close > span_a AND close > span_b THEN 'BUY' WHEN close < span_a AND close < span_b THEN 'SELL' ELSE 'HOLD' END",
                 "CASE WHEN close > span_a AND close > span_b THEN (close - greatest(span_a, span_b)) / close WHEN close < span_a AND close < span_b THEN -(greatest(span_a, span_b) - close) / close ELSE 0.0 END", {"span_a": "span_a", "span_b": "span_b"}),
    "Bollinger Bands": ("volatility", "CASE WHEN round(upper, 8) <> round(lower, 8) AND close >= round(upper, 8) THEN 'SELL' WHEN round(upper, 8) <> round(lower, 8) AND close <= round(lower, 8) THEN 'BUY' ELSE 'HOLD' END",
                        "CASE WHEN close >= round(upper, 8) THEN -(close - round(upper, 8)) / nullif(round(upper, 8) - round(lower, 8), 0) WHEN close <= round(lower, 8) THEN (round(upper, 8) - close) / nullif(round(upper, 8) - round(lower, 8), 0) ELSE (close - round(lower, 8)) / nullif(round(upper, 8) - round(lower, 8), 0) - 0.5 END", {"upper": "upper", "sma20": "sma20", "lower": "lower"}),
    "Donchian Channel": ("volatility", "CASE WHEN close > high20 THEN 'BUY' WHEN close < low20 THEN 'SELL' ELSE 'HOLD' END", "((close - low20) / nullif(high20 - low20, 0) - 0.5) * 2", {"high20": "high20", "low20": "low20"}),
    "ATR": ("volatility", "'HOLD'", "0.0", {"atr14": "atr14"}),
    "OBV": ("volume", "CASE WHEN obv_trend > 0 THEN 'BUY' WHEN obv_trend < 0 THEN 'SELL' ELSE 'HOLD' END",
            "CASE WHEN obv_trend > 0 THEN least(obv_trend / (abs(obv) + 1), 0.7) WHEN obv_trend < 0 THEN greatest(obv_trend / (abs(obv) + 1), -0.7) ELSE 0.0 END", {"obv": "obv", "obv_trend": "obv_trend"}),
    "MFI": ("volume", "CASE WHEN round(mfi, 8) > 80 THEN 'SELL' WHEN round(mfi, 8) < 20 THEN 'BUY' ELSE 'HOLD' END",
            "CASE WHEN round(mfi, 8) > 80 THEN -(round(mfi, 8) - 80) / 20 WHEN round(mfi, 8) < 20 THEN (20 - round(mfi, 8)) / 20 ELSE (round(mfi, 8) - 50) / 50 END", {"mfi": "mfi"}),
    "VWAP": ("volume", "CASE WHEN close > round(vwap, 8) THEN 'BUY' ELSE 'SELL' END",
             "CASE WHEN close > round(vwap, 8) THEN least((close - round(vwap, 8)) / nullif(close, 0), 0.7) ELSE greatest(-(round(vwap, 8) - close) / nullif(close, 0), -0.7) END", {"vwap": "vwap"}),
}


def indicator(name: str, bars: str = HOURLY) -> str:
    _, state, score, values = INDICATORS[name]
    cols = ", ".join(f"round({v}, 6) + 0.0::DOUBLE AS {k}" for k, v in values.items())
    return f"WITH {bars}, {KERNELS} SELECT sym, bar_ts, {state} AS state, round(({clamp(score)})::DOUBLE, 6) + 0.0::DOUBLE AS score, {cols} FROM k3"


def signals_cte(names: list[str] | None = None, where: str = "") -> str:
    """A CTE `sig` of indicator rows over k3."""
    parts = [f"SELECT sym, bar_ts, idx, n, open, close, '{name}' AS indicator, '{c}' AS category, {state} AS state, round(({clamp(score)})::DOUBLE, 6) + 0.0::DOUBLE AS score FROM k3 {where}" for name, (c, state, score, _) in INDICATORS.items() if names is None or name in names]
    return "sig AS (" + " UNION ALL ".join(parts) + ")"


def phi(z: str) -> str:
    """Normal distribution function: the power series of erf, to about 1e-8; beyond six deviations, 0 or 1."""
    x = f"(({z}) / sqrt(2.0::DOUBLE))"
    terms = f"list_sum(list_transform(range(0, 90), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - lgamma(k + 1)) / (2 * k + 1)))"
    return f"CASE WHEN ({z}) > 6 THEN 1.0 WHEN ({z}) < -6 THEN 0.0 ELSE 0.5 + sign({z}) * {terms} / sqrt(pi()) END"
