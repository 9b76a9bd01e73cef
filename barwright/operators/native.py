"""Indicators that are plain window expressions.

All kernels (rolling extrema, means, true range, flows, ...) are columns of three stages over one
window specification, so Spark plans one exchange and one sort, and drops the kernels that no
requested indicator uses. Every bar gets each indicator's state and score: the last bar's are the
current signal, all of them are the replay that back-tests need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions import windows as X
from barwright.functions.windows import EPS, clamp, steady

#: Which family a vote counts in.
MOMENTUM, TREND, VOLATILITY, VOLUME = "momentum", "trend", "volatility", "volume"


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with idx (from 0) and n (bars of the symbol)."""
    return bars.withColumns({"idx": F.row_number().over(X.order()) - 1, "n": F.count(F.lit(1)).over(X.whole())})


def kernels(bars: DataFrame) -> DataFrame:
    """Bars with all kernel columns."""
    k = numbered(bars).withColumns({
        "prev_close": X.lag("close"), "prev_high": X.lag("high"), "prev_low": X.lag("low"),
        "typical": (F.col("high") + F.col("low") + F.col("close")) / 3,
    })
    up, down = F.col("high") - F.col("prev_high"), F.col("prev_low") - F.col("low")
    plus = F.when((up > down) & (up > 0), up).otherwise(0.0)
    change = F.col("close") - F.col("prev_close")
    k = k.withColumns({
        "change": change, "gain": F.greatest(change, F.lit(0.0)) * F.when(change.isNotNull(), 1.0), "loss": F.greatest(-change, F.lit(0.0)) * F.when(change.isNotNull(), 1.0),
        "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close"))),
        "plus_dm": plus, "minus_dm": F.when((down > plus) & (down > 0), down).otherwise(0.0),
        "signed_volume": F.coalesce(F.signum(change), F.lit(0.0)) * F.col("volume"),
        "typical_change": F.col("typical") - X.lag("typical"), "flow": F.col("typical") * F.col("volume"),
    })
    k = k.withColumns({
        "flow_in": F.when(F.col("typical_change") > 0, F.col("flow")).otherwise(0.0),
        "flow_out": F.when(F.col("typical_change") < 0, F.col("flow")).otherwise(0.0),
    })
    # second stage: rolling values of the first
    k = k.withColumns({
        "gain14": X.mean("gain", 14), "loss14": X.mean("loss", 14), "low14": X.low("low", 14), "high14": X.high("high", 14),
        "typical20": X.mean("typical", 20), "mad20": X.mean_abs_dev("typical", 20), "close_10": X.lag("close", 10),
        "atr14": X.mean("tr", 14), "plus14": X.mean("plus_dm", 14), "minus14": X.mean("minus_dm", 14),
        "sma20": X.mean("close", 20), "sd20": X.sd("close", 20), "high20": X.high("high", 20), "low20": X.low("low", 20),
        "conversion": (X.high("high", 9) + X.low("low", 9)) / 2, "base": (X.high("high", 26) + X.low("low", 26)) / 2, "span_b": (X.high("high", 52) + X.low("low", 52)) / 2,
        "obv": X.running("signed_volume"), "in14": X.mean("flow_in", 14), "out14": X.mean("flow_out", 14),
        "vwap": X.running("flow") / (X.running("volume") + EPS), "sma50": X.mean("close", 50), "sma200": X.mean("close", 200),
    })
    spread14 = F.col("high14") - F.col("low14")
    plus_di, minus_di = 100 * F.col("plus14") / (F.col("atr14") + EPS), 100 * F.col("minus14") / (F.col("atr14") + EPS)
    k = k.withColumns({
        "rsi": 100 - 100 / (1 + F.col("gain14") / F.when(F.col("loss14") == 0, EPS).otherwise(F.col("loss14"))),
        "stoch_k": 100 * (F.col("close") - F.col("low14")) / F.when(spread14 == 0, EPS).otherwise(spread14),
        "williams": (F.col("high14") - F.col("close")) / F.when(spread14 == 0, EPS).otherwise(spread14) * -100,
        "cci": (F.col("typical") - F.col("typical20")) / (0.015 * F.when(F.col("mad20") == 0, EPS).otherwise(F.col("mad20"))),
        "roc": 100 * (F.col("close") / F.when(F.col("close_10") != 0, F.col("close_10")) - 1),
        "plus_di": plus_di, "minus_di": minus_di, "dx": 100 * F.abs(plus_di - minus_di) / (plus_di + minus_di + EPS),
        "span_a": (F.col("conversion") + F.col("base")) / 2, "mfi": 100 - 100 / (1 + F.col("in14") / (F.col("out14") + EPS)),
        "upper": F.col("sma20") + 2 * F.col("sd20"), "lower": F.col("sma20") - 2 * F.col("sd20"),
    })
    # third stage: rolling values of the second
    return k.withColumns({"stoch_d": X.mean("stoch_k", 3), "adx": X.mean("dx", 14), "obv_trend": F.col("obv") - X.lag("obv", 20)})


def _verdict(*cases: tuple[Column, str, Column], hold: Column) -> tuple[Column, Column]:
    """State and score: the first case that is true, else HOLD with its own score."""
    state, score = F.lit("HOLD"), hold
    for cond, s, v in reversed(cases):
        state, score = F.when(cond, s).otherwise(state), F.when(cond, v).otherwise(score)
    return state, clamp(score)


def _rsi():
    r = steady(F.col("rsi"))
    return _verdict((r > 70, "SELL", -(r - 70) / 30), (r < 30, "BUY", (30 - r) / 30), hold=(r - 50) / 50)


def _stochastic():
    k, d = steady(F.col("stoch_k")), steady(F.col("stoch_d"))
    s, v = _verdict(((k < 20) & (k > d), "BUY", (20 - k) / 20), ((k > 80) & (k < d), "SELL", (80 - k) / 20), hold=(k - 50) / 50)
    return F.when(F.col("idx") >= 14, s).otherwise("HOLD"), F.when(F.col("idx") >= 14, v).otherwise(0.0)


def _williams():
    r = steady(F.col("williams"))
    s, v = _verdict((r > -20, "BUY", (r + 20) / 60), (r < -80, "SELL", (r + 80) / 60), hold=(r + 50) / 100)
    return F.when(F.col("idx") >= 14, s).otherwise("HOLD"), F.when(F.col("idx") >= 14, v).otherwise(0.0)


def _cci():
    c = steady(F.col("cci"))
    s, v = _verdict((c < -100, "BUY", (-100 - c) / 200), (c > 100, "SELL", (100 - c) / 200), hold=c / 200)
    return F.when(F.col("idx") >= 20, s).otherwise("HOLD"), F.when(F.col("idx") >= 20, v).otherwise(0.0)


def _roc():
    r = steady(F.col("roc"))
    return _verdict((r > 0, "BUY", r / 20), (r < 0, "SELL", r / 20), hold=F.lit(0.0))


def _adx():
    a, p, m = steady(F.col("adx")), steady(F.col("plus_di")), steady(F.col("minus_di"))
    return _verdict(((a > 25) & (p > m), "BUY", a / 100), ((a > 25) & (m > p), "SELL", -a / 100), hold=F.lit(0.0))


def _ichimoku():
    c, a, b = F.col("close"), F.col("span_a"), F.col("span_b")
    top = F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
    # a close of zero is infinitely far off
    far = F.coalesce(F.try_divide(c - top, c), F.signum(c - top))
    return _verdict(((c > a) & (c > b), "BUY", far), ((c < a) & (c < b), "SELL", far), hold=F.lit(0.0))


def _bollinger():
    c, u, lo = F.col("close"), steady(F.col("upper")), steady(F.col("lower"))
    width = F.when(u != lo, u - lo)
    return _verdict(((c >= u) & (u != lo), "SELL", -(c - u) / width), ((c <= lo) & (u != lo), "BUY", (u - c) / width), hold=(c - lo) / width - 0.5)


def _donchian():
    c, u, lo = F.col("close"), F.col("high20"), F.col("low20")
    width = F.when(u != lo, u - lo)
    return _verdict(((c > u) & (u != lo), "BUY", (c - u) / width), ((c < lo) & (u != lo), "SELL", -(u - c) / width), hold=((c - lo) / width - 0.5) * 2)


def _atr():
    return F.lit("HOLD"), F.lit(0.0)


def _obv():
    t, size = F.col("obv_trend"), F.abs(F.col("obv")) + 1
    return _verdict((t > 0, "BUY", F.least(t / size, F.lit(0.7))), (t < 0, "SELL", F.greatest(t / size, F.lit(-0.7))), hold=F.lit(0.0))


def _mfi():
    m = steady(F.col("mfi"))
    return _verdict((m > 80, "SELL", -(m - 80) / 20), (m < 20, "BUY", (20 - m) / 20), hold=(m - 50) / 50)


def _vwap():
    c, v = F.col("close"), steady(F.col("vwap"))
    per = F.when(c != 0, c)
    return _verdict((c > v, "BUY", F.least((c - v) / per, F.lit(0.7))), (F.lit(True), "SELL", F.greatest(-(v - c) / per, F.lit(-0.7))), hold=F.lit(0.0))


#: name -> (category, state and score, values to report)
NATIVE: dict[str, tuple[str, Callable[[], tuple[Column, Column]], tuple[str, ...]]] = {
    "RSI": (MOMENTUM, _rsi, ("rsi",)), "Stochastic": (MOMENTUM, _stochastic, ("stoch_k", "stoch_d")), "Williams %R": (MOMENTUM, _williams, ("williams",)),
    "CCI": (MOMENTUM, _cci, ("cci",)), "ROC": (MOMENTUM, _roc, ("roc",)), "ADX": (TREND, _adx, ("adx", "plus_di", "minus_di")),
    "Ichimoku": (TREND, _ichimoku, ("span_a", "span_b")), "Bollinger Bands": (VOLATILITY, _bollinger, ("upper", "sma20", "lower")),
    "Donchian Channel": (VOLATILITY, _donchian, ("high20", "low20")), "ATR": (VOLATILITY, _atr, ("atr14",)),
    "OBV": (VOLUME, _obv, ("obv", "obv_trend")), "MFI": (VOLUME, _mfi, ("mfi",)), "VWAP": (VOLUME, _vwap, ("vwap",)),
}


def indicator(bars: DataFrame, name: str) -> DataFrame:
    """One indicator at every bar: sym, bar_ts, state, score and its values."""
    _, rule, values = NATIVE[name]
    state, score = rule()
    return kernels(bars).select("sym", "bar_ts", state.alias("state"), (F.round(score, 6) + 0.0).alias("score"), *[(F.round(v, 6) + 0.0).alias(v) for v in values])


def signals(bars: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Indicators at every bar as rows: sym, bar_ts, idx, n, open, close, indicator, category, state, score."""
    return rows_of(kernels(bars), names)


def rows_of(k: DataFrame, names: Iterable[str] | None = None, *more: Column) -> DataFrame:
    """The rows of `signals` from kernels, with more columns of the kernels' bars."""
    cells = []
    for name in names if names is not None else NATIVE:
        state, score = NATIVE[name][1]()
        cells.append(F.struct(F.lit(name).alias("indicator"), F.lit(NATIVE[name][0]).alias("category"), state.alias("state"), (F.round(score, 6) + 0.0).alias("score")))
    return k.select("sym", "bar_ts", "idx", "n", "open", "close", *more, F.inline(F.array(*cells)))
