"""Back-tests over signal rows (sym, bar_ts, idx, n, open, close, indicator, state, score)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the event study: first bar that may signal, horizons in bars, cost of a round trip in percent.
WARMUP, HORIZONS, ROUND_TRIP = 60, (5, 10, 20), 0.3
#: Fixed value: trading days of a year.
YEAR = 252


def _by(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("idx")


def edges(signals: DataFrame, warmup: int = WARMUP, keys: Sequence[str] = ("sym", "indicator")) -> DataFrame:
    """Signals with `edge`: a state that isn't HOLD and differs from the bar before. Bars before the
    warm-up have no state."""
    state = F.when(F.col("idx") >= warmup, F.col("state")).otherwise("HOLD")
    s = signals.withColumn("state", state)
    return s.withColumn("edge", (F.col("state") != "HOLD") & (F.col("state") != F.lag("state", 1, "HOLD").over(_by(*keys))))


def event_trades(signals: DataFrame, horizons: Sequence[int] = HORIZONS, cost: float = ROUND_TRIP, warmup: int = WARMUP, keys: Sequence[str] = ("sym", "indicator")) -> DataFrame:
    """A trade for each edge and horizon: in at the next bar's open, out at the close of the first bar
    with the opposite state within the horizon, else at its end. Trades that would end beyond the data
    are kept with `complete` false.

    One window pass finds the next opposite state within the longest horizon of every bar; the exit price
    comes from a join on (symbol, bar number)."""
    w = _by(*keys)
    ahead = w.rowsBetween(1, max(horizons))  # no exit is ever looked for further on
    s = edges(signals, warmup, keys).withColumns({
        "entry_open": F.lead("open").over(w),
        "next_sell": F.min(F.when(F.col("state") == "SELL", F.col("idx"))).over(ahead), "next_buy": F.min(F.when(F.col("state") == "BUY", F.col("idx"))).over(ahead),
    })
    return settled(s.filter("edge"), signals, horizons, cost, keys)


def settled(entries: DataFrame, prices: DataFrame, horizons: Sequence[int] = HORIZONS, cost: float = ROUND_TRIP, keys: Sequence[str] = ("sym", "indicator")) -> DataFrame:
    """Trades of edges with entry_open, next_sell and next_buy. prices: rows with sym, idx, bar_ts, close."""
    t = entries.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    opposite = F.when(F.col("state") == "BUY", F.col("next_sell")).otherwise(F.col("next_buy"))
    end = F.col("idx") + F.col("horizon")
    t = t.select(*keys, "idx", "n", "bar_ts", "horizon", F.when(F.col("state") == "BUY", "long").otherwise("short").alias("side"), "entry_open", F.least(F.coalesce(opposite, end), end).alias("exit_idx"))
    at = prices.select("sym", F.col("idx").alias("exit_idx"), F.col("bar_ts").alias("exit_ts"), F.col("close").alias("exit_close")).dropDuplicates(["sym", "exit_idx"])
    out = t.join(at, ["sym", "exit_idx"], "left")
    gross = (F.col("exit_close") / F.when(F.col("entry_open") != 0, F.col("entry_open")) - 1) * 100 * F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    out = out.withColumn("complete", F.col("exit_idx") < F.col("n")).withColumn("gross", F.when(F.col("complete"), gross))
    return out.withColumn("net", F.col("gross") - cost)


def event_study(trades: DataFrame, keys: Sequence[str] = ("indicator",)) -> DataFrame:
    """Trades by key, horizon and side: number, hit rate, means, median, best and worst; null without trades."""
    return trades.groupBy(*keys, "horizon", "side").agg(
        F.count("net").alias("trades"), F.count_if(~F.col("complete")).alias("incomplete"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"),
        F.avg("gross").alias("avg_gross"), F.avg("net").alias("avg_net"), F.percentile("net", 0.5).alias("median_net"), F.max("net").alias("best"), F.min("net").alias("worst"),
    )


def evidence(trades: DataFrame, keys: Sequence[str] = ("indicator",), horizon: int = 10, side: str = "long", least: int = 20) -> DataFrame:
    """t value of the mean net return on the primary horizon, and its weight."""
    t = trades.filter((F.col("horizon") == horizon) & (F.col("side") == side)).groupBy(*keys).agg(F.count("net").alias("trades"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("sd"))
    value = F.when((F.col("trades") > 1) & (F.col("sd") > 0), F.round(F.col("mean") / (F.when(F.col("sd") > 0, F.col("sd")) / F.sqrt("trades")), 6))
    weight = F.when(F.col("trades") < least, "insufficient").when(F.col("t") >= 2, "strong").when(F.col("t") >= 1, "moderate").when(F.col("t") > 0, "weak").otherwise("none")
    return t.select(*keys, "trades", "mean", value.alias("t")).withColumn("weight", weight)


# ---- strategies -------------------------------------------------------------------------------------


def executed(entry: Column, exit_: Column, slip_in: float = 0.0005, slip_out: float = 0.0005, stop: float = 0.0, take: float = 0.0, size: float = 1.0) -> Column:
    """Return in percent after slippage; a stop or a target, where given, replaces the exit price (both
    are looked at on the exit bar only). Commission isn't part of it."""
    move = (exit_ - entry) / F.when(entry != 0, entry) * 100
    out = exit_
    if stop > 0:
        out = F.when(move <= -stop, entry * (1 - stop / 100)).otherwise(out)
    if take > 0:
        out = F.when(move >= take, entry * (1 + take / 100)).otherwise(out)
    paid = entry * (1 + slip_in)
    return F.coalesce((out - exit_ * slip_out - paid) / F.when(paid != 0, paid) * 100, F.lit(0.0)) * size


def commission(entry: Column, exit_: Column, rate: float = 0.001, size: float = 1.0) -> Column:
    """Commission of both sides in percent of the entry."""
    return (entry + exit_) * rate / F.when(entry != 0, entry) * 100 * size


def strategy_momentum(scans: DataFrame, threshold: float = 0.5, hold: int = 3, **costs: float) -> DataFrame:
    """Every score above the threshold buys the close and sells `hold` bars later; positions may overlap."""
    w = _by("sym")
    t = scans.withColumns({"exit_close": F.lead("close", hold).over(w), "exit_ts": F.lead("bar_ts", hold).over(w)}).filter((F.col("score") > threshold) & F.col("exit_close").isNotNull())
    return t.select("sym", "idx", F.col("bar_ts").alias("entry_ts"), "exit_ts", F.col("close").alias("entry"), F.col("exit_close").alias("exit"), F.lit(hold).alias("held"),
                    executed(F.col("close"), F.col("exit_close"), **costs).alias("return_pct"), commission(F.col("close"), F.col("exit_close")).alias("commission_pct"))


def _one_at_a_time(pdf: pd.DataFrame, threshold: float, hold: int) -> pd.DataFrame:
    pdf = pdf.sort_values("idx", kind="stable").reset_index(drop=True)
    wants = np.flatnonzero(pdf["score"].to_numpy() > threshold)
    rows, free, n = [], 0, len(pdf)
    while (k := int(np.searchsorted(wants, free))) < len(wants):
        start = int(wants[k])
        end = min(start + hold, n - 1)
        rows.append((pdf["sym"].iloc[0], int(pdf["idx"].iloc[start]), pdf["bar_ts"].iloc[start], pdf["bar_ts"].iloc[end], float(pdf["close"].iloc[start]), float(pdf["close"].iloc[end]), end - start))
        free = start + hold  # the bar that closes a position may open the next
        if free >= n:
            break
    return pd.DataFrame(rows, columns=["sym", "idx", "entry_ts", "exit_ts", "entry", "exit", "held"])


def strategy_threshold(scans: DataFrame, threshold: float = 0.3, hold: int = 5, **costs: float) -> DataFrame:
    """One position at a time: in above the threshold, out after `hold` bars or at the last bar. With a
    threshold of minus infinity, every bar that has a signal at all enters (the top-ten portfolio)."""
    out = scans.select("sym", "idx", "bar_ts", "close", "score").groupBy("sym").applyInPandas(
        lambda pdf: _one_at_a_time(pdf, threshold, hold), "sym string, idx int, entry_ts timestamp, exit_ts timestamp, entry double, exit double, held int")
    return out.withColumns({"return_pct": executed(F.col("entry"), F.col("exit"), **costs), "commission_pct": commission(F.col("entry"), F.col("exit"))})


def top_signals(scans: DataFrame, per_day: int = 10) -> DataFrame:
    """The best signals of each day over all symbols."""
    rn = F.row_number().over(Window.partitionBy("bar_ts").orderBy(F.desc("score"), "sym"))
    return scans.withColumn("rank", rn).filter(F.col("rank") <= per_day)


def strategy_top10(scans: DataFrame, hold: int = 5, **costs: float) -> DataFrame:
    return strategy_threshold(scans.filter(F.col("score").isNotNull()), float("-inf"), hold, **costs)


def walk_forward(scans: DataFrame, train: int = 60, test: int = 20, tail: int = 10, threshold: float = 0.5, hold: int = 3, **costs: float) -> DataFrame:
    """The momentum strategy over adjoining test windows, each with `tail` more bars for its exits. A
    signal in that tail belongs to the next window too and is traded in both, as published."""
    rows = scans.filter(F.col("idx") >= train)
    first = F.floor((F.col("idx") - train) / test)
    spare = F.when((first > 0) & ((F.col("idx") - train) % test < tail), F.array(first, first - 1)).otherwise(F.array(first))
    w = Window.partitionBy("sym", "window").orderBy("idx")
    t = rows.withColumn("window", F.explode(spare)).withColumns({"exit_close": F.lead("close", hold).over(w), "exit_ts": F.lead("bar_ts", hold).over(w)})
    t = t.filter((F.col("score") > threshold) & F.col("exit_close").isNotNull())
    return t.select("sym", "window", "idx", F.col("bar_ts").alias("entry_ts"), "exit_ts", F.col("close").alias("entry"), F.col("exit_close").alias("exit"), executed(F.col("close"), F.col("exit_close"), **costs).alias("return_pct"))


def trade_metrics(trades: DataFrame, days: DataFrame) -> DataFrame:
    """Metrics of each symbol's trades in order of entry: total and annualised return, win rate, drawdown,
    Sharpe and Sortino (not annualised), mean days held, commission. days: (sym, days) of trading."""
    r = F.col("r")
    g = trades.groupBy("sym").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "return_pct"))), lambda x: x["return_pct"]).alias("r"), F.count(F.lit(1)).alias("trades"),
        (F.avg((F.col("return_pct") > 0).cast("double")) * 100).alias("win_rate"), F.avg("return_pct").alias("mean"), F.stddev_pop("return_pct").alias("sd"),
        F.sqrt(F.avg(F.when(F.col("return_pct") < 0, F.col("return_pct") * F.col("return_pct")))).alias("down"), F.avg("held").alias("avg_held"), F.sum("commission_pct").alias("commission_pct"),
    )
    growth = F.aggregate(r, F.lit(1.0), lambda acc, x: acc * (1 + x / 100))
    walk = F.aggregate(
        r, F.struct(F.lit(1.0).alias("v"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("dd")),
        lambda acc, x: F.struct(
            (acc["v"] * (1 + x / 100)).alias("v"), F.greatest(acc["peak"], acc["v"] * (1 + x / 100)).alias("peak"),
            F.greatest(acc["dd"], (F.greatest(acc["peak"], acc["v"] * (1 + x / 100)) - acc["v"] * (1 + x / 100)) / F.greatest(acc["peak"], acc["v"] * (1 + x / 100)) * 100).alias("dd"),
        ),
        lambda acc: acc["dd"],
    )
    out = g.join(days, "sym").withColumn("growth", growth)
    enough = F.col("trades") >= 2
    return out.select(
        "sym", "trades", "win_rate", ((F.col("growth") - 1) * 100).alias("total_return"), walk.alias("max_drawdown"),
        F.when(enough & (F.col("sd") > 0), F.col("mean") / F.when(F.col("sd") > 0, F.col("sd"))).otherwise(0.0).alias("sharpe"),
        F.when(enough & (F.col("down") > 0), F.col("mean") / F.when(F.col("down") > 0, F.col("down"))).otherwise(0.0).alias("sortino"),
        F.when(F.col("days") > 0, (F.pow(F.col("growth"), YEAR / F.when(F.col("days") > 0, F.col("days"))) - 1) * 100).otherwise(0.0).alias("annualised"), "avg_held", "commission_pct",
    )


def equity(trades: DataFrame) -> DataFrame:
    """Growth of one unit trade by trade, its peak, and the drawdown in percent."""
    w = _by("sym").rowsBetween(Window.unboundedPreceding, 0)
    steps = trades.withColumn("growth", F.aggregate(F.collect_list("return_pct").over(w), F.lit(1.0), lambda acc, x: acc * (1 + x / 100)))
    steps = steps.withColumn("peak", F.greatest(F.lit(1.0), F.max("growth").over(w)))
    return steps.select("sym", "idx", "growth", "peak", ((F.col("peak") - F.col("growth")) / F.col("peak") * 100).alias("drawdown"))


def streaks(trades: DataFrame) -> DataFrame:
    """Longest runs of winning and losing trades, profit factor, and return over drawdown."""
    w = _by("sym")
    win = (F.col("return_pct") > 0).cast("int")
    g = trades.withColumn("win", win).withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy("sym", "win").orderBy("idx")))
    runs = g.groupBy("sym", "win", "run").agg(F.count(F.lit(1)).alias("len"), F.sum(F.greatest("return_pct", F.lit(0.0))).alias("up"), F.sum(F.greatest(-F.col("return_pct"), F.lit(0.0))).alias("down"))
    return runs.groupBy("sym").agg(F.coalesce(F.max(F.when(F.col("win") == 1, F.col("len"))), F.lit(0)).alias("best_streak"), F.coalesce(F.max(F.when(F.col("win") == 0, F.col("len"))), F.lit(0)).alias("worst_streak"),
                                   F.try_divide(F.sum("up"), F.sum("down")).alias("profit_factor"))


def rule_actions(kernels: DataFrame, crosses: DataFrame) -> DataFrame:
    """Actions of the rule strategies at every bar: buy and hold, average cross, oscillator reversal, and
    two of three. crosses: (sym, bar_ts, fast, slow) averages."""
    w = Window.partitionBy("sym").orderBy("bar_ts")
    k = kernels.select("sym", "bar_ts", "idx", F.round("rsi", 8).alias("rsi"), "volume").join(crosses, ["sym", "bar_ts"])
    k = k.withColumns({"pf": F.lag("fast").over(w), "ps": F.lag("slow").over(w), "usual": F.avg("volume").over(w.rowsBetween(-14, -1))})
    up, down = (F.col("pf") <= F.col("ps")) & (F.col("fast") > F.col("slow")), (F.col("pf") >= F.col("ps")) & (F.col("fast") < F.col("slow"))
    hits = F.coalesce((F.col("rsi") < 35).cast("int"), F.lit(0)) + F.coalesce(up.cast("int"), F.lit(0)) + F.coalesce((F.col("volume") > F.col("usual")).cast("int"), F.lit(0))
    late = F.col("idx") >= 26
    return k.select(
        "sym", "bar_ts", F.when(F.col("idx") == 0, "BUY").otherwise("HOLD").alias("buy_hold"),
        F.when(late & up, "BUY").when(late & down, "SELL").otherwise("HOLD").alias("cross"),
        F.when((F.col("idx") >= 14) & (F.col("rsi") < 30), "BUY").when((F.col("idx") >= 14) & (F.col("rsi") > 70), "SELL").otherwise("HOLD").alias("reversal"),
        F.when(late & (hits >= 2), "BUY").when(late & ((F.col("rsi") > 65) | down), "SELL").otherwise("HOLD").alias("combo"),
    )
