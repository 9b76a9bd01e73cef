"""Walk-forward campaigns: folds, combinations of indicators, daily panels and corrections for many trials."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Sequence
from itertools import combinations
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.operators import backtest

#: Bars of the autocovariance window, Euler's constant, gates of the deflated ratio.
LAGS, EULER, GATE, LEAST_TRIALS, LEAST_TRADES = 10, 0.5772156649015329, 0.95, 30, 400
#: Seed, repetitions and mean block of the bootstrap.
SEED, REPS, BLOCK = 20261009, 999, 10
#: False discovery rate, least days of each fold.
FDR, FOLD_DAYS = 0.10, {"train": 60, "val1": 55, "val2": 55, "holdout": 30}

_N = NormalDist()


class Refused(RuntimeError):
    """A guard that was violated; `reasons` names each."""

    def __init__(self, reasons: Iterable[str]):
        self.reasons = list(reasons)
        super().__init__("; ".join(self.reasons))


def cuts(bars: DataFrame) -> DataFrame:
    """Last day and the three cuts: two months before it, and three months before each other."""
    last = bars.agg(F.to_date(F.max("bar_ts")).alias("last"))
    c3 = F.add_months("last", -2)
    return last.select("last", F.add_months(F.add_months(c3, -3), -3).alias("c1"), F.add_months(c3, -3).alias("c2"), c3.alias("c3"))


def fold_of(day: Column, c1: Column, c2: Column, c3: Column) -> Column:
    """Half-open folds: train up to c1, val1 to c2, val2 to c3, holdout after."""
    return F.when(day <= c1, "train").when(day <= c2, "val1").when(day <= c3, "val2").otherwise("holdout")


def in_fold(rows: DataFrame, fold: str, cut: DataFrame) -> DataFrame:
    """Rows of a fold; trainval is all up to c2. The cuts are one row."""
    day = F.to_date("bar_ts")
    keep = {"train": day <= F.col("c1"), "trainval": day <= F.col("c2"), "val1": (day > F.col("c1")) & (day <= F.col("c2")), "val2": (day > F.col("c2")) & (day <= F.col("c3")), "holdout": day > F.col("c3")}[fold]
    return rows.crossJoin(F.broadcast(cut)).filter(keep).drop("last", "c1", "c2", "c3")


def fold_days(bars: DataFrame, cut: DataFrame) -> DataFrame:
    """Distinct days of each fold and whether they are enough."""
    d = bars.select(F.to_date("bar_ts").alias("day")).distinct().crossJoin(F.broadcast(cut))
    g = d.groupBy(fold_of(F.col("day"), F.col("c1"), F.col("c2"), F.col("c3")).alias("fold")).agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    least = F.coalesce(*[F.when(F.col("fold") == k, F.lit(v)) for k, v in FOLD_DAYS.items()])
    return g.withColumn("enough", F.col("days") >= least)


def equal_folds(bars: DataFrame, folds: int = 3, margin: int = 60) -> DataFrame:
    """Contiguous folds of equally many days after a margin; the last takes the rest. Numbered on the
    distinct days only."""
    days = bars.select("bar_ts").distinct().withColumn("k", F.row_number().over(Window.orderBy("bar_ts")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    start = F.least(F.lit(margin), F.greatest(F.lit(0), F.col("n") - 2))
    size = F.floor((F.col("n") - start) / folds)
    kept = days.filter(F.col("k") >= start).withColumn("fold", F.least(F.floor((F.col("k") - start) / F.greatest(size, F.lit(1))), F.lit(folds - 1)).cast("int"))
    return kept.groupBy("fold").agg(F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"), F.count(F.lit(1)).alias("days"))


def levers(signals: DataFrame, risk_only: Sequence[str] = ("Bollinger Bands", "ATR", "Donchian Channel")) -> DataFrame:
    """Indicators that every symbol has, that aren't of risk, and that signal at all."""
    total = signals.select("sym").distinct().agg(F.count(F.lit(1)).alias("symbols"))
    g = signals.groupBy("indicator").agg(F.countDistinct("sym").alias("have"), F.count_if(F.col("state") != "HOLD").alias("signals"))
    return g.crossJoin(F.broadcast(total)).filter((F.col("have") == F.col("symbols")) & (F.col("signals") > 0) & ~F.col("indicator").isin(*risk_only)).select("indicator", "signals")


#: Names packed into one number.
BITS = 62


def combos(spark: SparkSession, names: Sequence[str], most: int = 3) -> DataFrame:
    """All combinations of one to `most` names: (combo, members)."""
    rows = [("+".join(c), list(c)) for k in range(1, most + 1) for c in combinations(sorted(names), k)]
    return spark.createDataFrame(rows, "combo string, members array<string>")


def _masked(signals: DataFrame, grid: DataFrame, warmup: int) -> tuple[DataFrame, DataFrame, int]:
    """Bars with the buying and selling names of each as bits (buy0, sell0, ...), those of the bar before
    (prefix was_) and the next open; the grid with its members as bits (m0, ...); the numbers it takes. The
    grid, which is bounded by its names, comes to the driver."""
    keys = [(r.combo, r.members) for r in grid.select("combo", "members").collect()]
    names = sorted({x for _, members in keys for x in members})
    words = [names[i : i + BITS] for i in range(0, len(names), BITS)]
    bit = [F.coalesce(*[F.when(F.col("indicator") == x, F.lit(1 << k)) for k, x in enumerate(w)], F.lit(0)).cast("long") for w in words]
    side = {f"{word}{k}": F.coalesce(F.bit_or(F.when(F.col("state") == state, b)), F.lit(0)) for k, b in enumerate(bit) for word, state in (("buy", "BUY"), ("sell", "SELL"))}
    bars = signals.groupBy("sym", "bar_ts", "idx", "n", "open", "close").agg(*[c.alias(k) for k, c in side.items()])
    bars = bars.withColumns({k: F.when(F.col("idx") >= warmup, F.col(k)).otherwise(F.lit(0)) for k in side})
    w = Window.partitionBy("sym").orderBy("idx")
    bars = bars.withColumns({"entry_open": F.lead("open").over(w), **{f"was_{k}": F.lag(k, 1, 0).over(w) for k in side}})
    rows = [(key, *[sum(1 << k for k, x in enumerate(w) if x in members) for w in words]) for key, members in keys]
    masks = signals.sparkSession.createDataFrame(rows, "combo string, " + ", ".join(f"m{k} long" for k in range(len(words))))
    return bars, masks, len(words)


def _holds(word: str, n: int) -> Column:
    """Whether all members of a combination are in the bits of a bar."""
    out = F.lit(True)
    for k in range(n):
        out = out & (F.col(f"{word}{k}").bitwiseAND(F.col(f"m{k}")) == F.col(f"m{k}"))
    return out


def _state(n: int, prefix: str = "") -> Column:
    return F.when(_holds(f"{prefix}buy", n), "BUY").when(_holds(f"{prefix}sell", n), "SELL").otherwise("HOLD")


def combo_signals(signals: DataFrame, grid: DataFrame) -> DataFrame:
    """Signals of combinations at every bar: the state that all members share, else HOLD. States are packed
    into bits first, so a combination costs two comparisons a bar. The grid is bounded by its names
    (4,991 rows for 31) and broadcast."""
    bars, masks, n = _masked(signals, grid, 0)
    return bars.crossJoin(F.broadcast(masks)).select("sym", "bar_ts", "idx", "n", "open", "close", "combo", _state(n).alias("state"))


def combo_trades(signals: DataFrame, grid: DataFrame, warmup: int = backtest.WARMUP) -> DataFrame:
    """The trades of combinations, as `backtest.event_trades` makes them of `combo_signals`. Bars meet the
    grid without a shuffle, and only those where a combination fires go on."""
    bars, masks, n = _masked(signals, grid, warmup)
    fired = bars.crossJoin(F.broadcast(masks)).select("sym", "combo", "bar_ts", "idx", "n", "entry_open", _state(n).alias("state"), _state(n, "was_").alias("was")).filter("state <> 'HOLD'")
    ahead = Window.partitionBy("sym", "combo").orderBy("idx").rangeBetween(1, max(backtest.HORIZONS))
    fired = fired.withColumns({f"next_{x.lower()}": F.min(F.when(F.col("state") == x, F.col("idx"))).over(ahead) for x in ("SELL", "BUY")})
    return backtest.settled(fired.filter("state <> was"), signals, keys=("sym", "combo"))


def sliced(signals: DataFrame, fold: str, cut: DataFrame, warmup: int = backtest.WARMUP) -> DataFrame:
    """The signals of a fold alone, with bars numbered and counted within it; states before the warm-up of
    the whole series are HOLD. Trades are then made with a warm-up of 0, and end within the fold."""
    s = signals.withColumn("state", F.when(F.col("idx") >= warmup, F.col("state")).otherwise("HOLD"))
    s = in_fold(s, fold, cut)
    own = Window.partitionBy("sym", "indicator")
    return s.withColumns({"n": F.count(F.lit(1)).over(own), "idx": (F.row_number().over(own.orderBy("bar_ts")) - 1).cast("int")})


def trial_ledger(events: DataFrame) -> DataFrame:
    """Trials charged by selection events (k, fold, trials): every event adds to one running sum, and a
    fold's trials are that sum at its latest event. (fold, trials), and `total` over all. One row an
    event, in one order."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ran = events.select("k", "fold", F.sum("trials").over(w).alias("trials"))
    each = ran.groupBy("fold").agg(F.max_by("trials", "k").alias("trials"))
    return each.unionByName(ran.agg(F.lit("total").alias("fold"), F.max_by("trials", "k").alias("trials")))


def panel(trades: DataFrame, bars: DataFrame, side: str = "long", horizon: int = 10, key: str = "combo") -> DataFrame:
    """Daily series of each key: net returns that end that day, over the symbols with a bar that day; 0
    without. Every key has every day."""
    days = bars.groupBy(F.col("bar_ts").alias("day")).agg(F.countDistinct("sym").alias("symbols"))
    nets = trades.filter((F.col("side") == side) & (F.col("horizon") == horizon) & F.col("complete")).groupBy(key, F.col("exit_ts").alias("day")).agg(F.sum("net").alias("net"))
    keys = trades.select(key).distinct()
    return keys.crossJoin(days).join(nets, [key, "day"], "left").select(key, "day", F.coalesce(F.col("net") / F.col("symbols"), F.lit(0.0)).alias("x"))


def series_statistics(series: DataFrame, key: str = "combo", lags: int = LAGS) -> DataFrame:
    """Mean, long-run deviation (Bartlett weights), skewness, kurtosis (3 for a normal) and their ratio `sr`,
    null for a series that never moves."""
    whole = Window.partitionBy(key)
    w = whole.orderBy("day")
    d = series.withColumns({"dev": F.col("x") - F.avg("x").over(whole), "k": F.row_number().over(w)})
    products = {f"g{i}": F.col("dev") * F.lag("dev", i).over(w) for i in range(1, lags + 1)}
    d = d.withColumns(products)
    g = d.groupBy(key).agg(F.count(F.lit(1)).alias("days"), F.avg("x").alias("mean"), F.avg(F.col("dev") * F.col("dev")).alias("m2"), F.avg(F.pow("dev", F.lit(3.0))).alias("m3"), F.avg(F.pow("dev", F.lit(4.0))).alias("m4"), *[F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in products])
    s = F.col("m2")
    for i in range(1, lags + 1):
        s = s + F.when(F.col("days") > i, 2.0 * (1 - i / (lags + 1)) * F.col(f"g{i}") / F.col("days")).otherwise(0.0)
    moved = F.col("m2") > 1e-18
    g = g.withColumn("long_sd", F.when(moved, F.sqrt(F.greatest(s, F.lit(0.0)))).otherwise(0.0))
    return g.select(key, "days", "mean", "long_sd", F.when(moved, F.col("m3") / F.pow(F.when(moved, F.col("m2")), F.lit(1.5))).otherwise(0.0).alias("skew"), F.when(moved, F.col("m4") / F.pow(F.when(moved, F.col("m2")), F.lit(2.0))).otherwise(0.0).alias("kurt"),
                    F.when(F.col("long_sd") > 1e-12, F.col("mean") / F.when(F.col("long_sd") > 1e-12, F.col("long_sd"))).alias("sr"))


def expected_best(spread: float, trials: int) -> float:
    """The ratio that the best of so many trials without any edge is expected to show."""
    return spread * ((1 - EULER) * _N.inv_cdf(1 - 1 / trials) + EULER * _N.inv_cdf(1 - 1 / (trials * math.e)))


def ratio_error(sr: float, skew: float, kurt: float) -> float:
    d = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    if d <= 0:
        raise Refused([f"variance {d:.6g} of the ratio isn't positive"])
    return math.sqrt(d)


def deflated(stats: DataFrame, days: int, trials: int, key: str = "combo") -> DataFrame:
    """Probability that each ratio beats the best of `trials` without an edge. Refuses with fewer than 30
    trials or ratios, without spread among them, or where a series has other days than the fold. Series
    that never move are missing, not 0."""
    spread = stats.agg(F.count("sr").alias("n"), F.stddev_samp("sr").alias("sd"), F.count_if(F.col("days") != days).alias("off"), F.count(F.lit(1)).alias("all")).first()
    why = []
    if trials < LEAST_TRIALS:
        why.append(f"{trials} trials, fewer than {LEAST_TRIALS}")
    if spread.n < LEAST_TRIALS:
        why.append(f"{spread.n} usable ratios of {spread['all']}, fewer than {LEAST_TRIALS}")
    if not why and not spread.sd:
        why.append("the ratios have no spread")
    if spread.off:
        why.append(f"{spread.off} series don't have {days} days")
    if why:
        raise Refused(why)
    bar, root = expected_best(spread.sd, trials), math.sqrt(days - 1)

    @F.pandas_udf("double")
    def phi(z: pd.Series) -> pd.Series:
        return z.map(lambda v: _N.cdf(v) if v == v else None)

    var = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    z = (F.col("sr") - bar) * root / F.sqrt(F.when(var > 0, var))
    return stats.filter("sr is not null").withColumn("z", z).select(key, "sr", "z", phi("z").alias("dsr"), F.lit(bar).alias("bar"))


def gate(v1: DataFrame, v2: DataFrame, traded: DataFrame, key: str = "combo") -> DataFrame:
    """Both folds above the gate with the same sign, and enough long trades over both. traded: (key, trades)."""
    a, b = v1.select(key, F.col("sr").alias("sr1"), F.col("dsr").alias("dsr1")), v2.select(key, F.col("sr").alias("sr2"), F.col("dsr").alias("dsr2"))
    j = a.join(b, key).join(traded, key, "left").withColumn("trades", F.coalesce("trades", F.lit(0)))
    same = (F.signum("sr1") == F.signum("sr2")) & (F.col("sr1") != 0)
    first = (F.col("dsr1") >= GATE) & (F.col("dsr2") >= GATE) & same
    return j.withColumns({"same_sign": same, "passes_ratio": first, "passes_trades": F.col("trades") >= LEAST_TRADES}).withColumn("passes", F.col("passes_ratio") & F.col("passes_trades"))


def verdict(gated: DataFrame) -> DataFrame:
    """LEADERBOARD if any key passes, else NO-EDGE with the gate that refused."""
    g = gated.agg(F.count_if("passes").alias("passing"), F.count_if("passes_ratio").alias("ratio_only"))
    word = F.when(F.col("passing") > 0, "LEADERBOARD").otherwise("NO-EDGE")
    return g.select(word.alias("verdict"), "passing", F.when(F.col("passing") > 0, F.lit(None).cast("string")).when(F.col("ratio_only") > 0, "too few trades").otherwise("no ratio on both folds").alias("reason"))


def one_sided_p(t: float) -> float:
    """Upper normal tail of a t value."""
    return 0.5 * math.erfc(t / math.sqrt(2))


def test_rows(trades: DataFrame, fold: Column, key: str = "indicator", horizon: int = 10, least: int = 2) -> DataFrame:
    """One test a key and fold for `discoveries`: the one-sided p of the mean long return. trades are cut
    into folds by an expression."""
    t = trades.withColumn("fold", fold).filter((F.col("side") == "long") & (F.col("horizon") == horizon) & F.col("complete"))
    g = t.groupBy(F.col(key).alias("name"), "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("sd")).filter((F.col("n") >= least) & (F.col("sd") > 0))

    @F.pandas_udf("double")
    def tail(t: pd.Series) -> pd.Series:
        return t.map(one_sided_p)

    return g.select("name", "fold", "n", "mean", tail(F.col("mean") / (F.when(F.col("sd") > 0, F.col("sd")) / F.sqrt("n"))).alias("p"))


def ranked_discoveries(tests: DataFrame, q: float = FDR) -> DataFrame:
    """Keys by number of significant folds, then by the mean return weighted by trades."""
    sig = discoveries(tests, q).select("name", "fold", "significant")
    g = tests.join(sig, ["name", "fold"]).groupBy("name").agg(F.count_if("significant").alias("folds"), F.sum("n").alias("trades"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
    return g.orderBy(F.desc("folds"), F.desc("mean"), "name")


def discoveries(tests: DataFrame, q: float = FDR) -> DataFrame:
    """Benjamini-Hochberg over all rows (name, fold, p): `significant` up to the largest p within its step.
    One row a test; the ordering is over the tests only."""
    w = Window.orderBy("p", "name", "fold")
    ranked = tests.withColumns({"rank": F.row_number().over(w), "m": F.count(F.lit(1)).over(Window.partitionBy())})
    limit = ranked.agg(F.max(F.when(F.col("p") <= q * F.col("rank") / F.col("m"), F.col("p"))).alias("limit"))
    return ranked.crossJoin(F.broadcast(limit)).select("name", "fold", "p", "rank", F.coalesce(F.col("p") <= F.col("limit"), F.lit(False)).alias("significant"))


def bootstrap_interval(values: Sequence[float], reps: int = REPS, seed: int = SEED, block: int = BLOCK) -> tuple[float, float] | None:
    """95 % interval of the mean by the stationary bootstrap, the same on every run."""
    n = len(values)
    if n < 2:
        return None
    rng = random.Random(seed)
    means = []
    for _ in range(reps):
        at = rng.randrange(n)
        total = 0.0
        for _ in range(n):
            total += values[at]
            at = rng.randrange(n) if rng.random() < 1 / block or at + 1 >= n else at + 1
        means.append(total / n)
    means.sort()

    def at_share(q: float) -> float:
        return round(means[min(int(q * (reps - 1) + 0.5), reps - 1)], 4)

    return at_share(0.025), at_share(0.975)


def metric_block(trades: DataFrame, key: str = "combo", reps: int = REPS) -> DataFrame:
    """Number, hit rate, mean, median and bootstrap interval of net returns by key, side and horizon."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(["sym", "idx"])["net"].tolist()
        ci = bootstrap_interval(v, reps)
        return pd.DataFrame([(pdf[key].iloc[0], pdf["side"].iloc[0], int(pdf["horizon"].iloc[0]), len(v), ci[0] if ci else None, ci[1] if ci else None)], columns=[key, "side", "horizon", "n", "ci_low", "ci_high"])

    done = trades.filter("complete")
    boot = done.select(key, "side", "horizon", "sym", "idx", "net").groupBy(key, "side", "horizon").applyInPandas(run, f"{key} string, side string, horizon int, n long, ci_low double, ci_high double")
    return boot.join(metric_rows(trades, key).drop("trades"), [key, "side", "horizon"])


def metric_rows(trades: DataFrame, key: str = "combo") -> DataFrame:
    """Number, hit rate, mean and median of net returns by key, side and horizon."""
    return trades.filter("complete").groupBy(key, "side", "horizon").agg(
        F.count(F.lit(1)).alias("trades"), F.round(F.avg((F.col("net") > 0).cast("double")), 4).alias("hit_rate"), F.round(F.avg("net"), 4).alias("mean_net"), F.round(F.percentile("net", 0.5), 4).alias("median_net"))


def best_keys(stats: DataFrame, k: int = 10, key: str = "combo") -> DataFrame:
    """The k highest ratios, names breaking ties."""
    return stats.filter("sr is not null").orderBy(F.desc("sr"), key).limit(k)


def listing_digest(bars: DataFrame) -> DataFrame:
    """SHA-256 over the sorted lines `symbol,last day`. One line a symbol goes into one row."""
    last = bars.groupBy("sym").agg(F.max("bar_ts").alias("last"))
    line = F.concat_ws(",", "sym", F.date_format("last", "yyyy-MM-dd"))
    return last.agg(F.count(F.lit(1)).alias("symbols"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("digest"))


def eligible_keys(first: DataFrame, second: DataFrame, k: int = 10, least: int = LEAST_TRADES, by_second: bool = True, key: str = "combo") -> DataFrame:
    """The k highest ratios of one fold among the keys that both folds can speak of: a ratio in each, of one
    sign, and `least` long trades in each. first, second: (key, sr, trades)."""
    a = first.select(key, F.col("sr").alias("sr1"), F.col("trades").alias("trades1"))
    b = second.select(key, F.col("sr").alias("sr2"), F.col("trades").alias("trades2"))
    both = a.join(b, key).filter((F.col("sr1") * F.col("sr2") > 0) & (F.col("trades1") >= least) & (F.col("trades2") >= least))
    return both.orderBy(F.desc("sr2" if by_second else "sr1"), key).limit(k)


def snapshot(bars: DataFrame) -> DataFrame:
    """What a frozen snapshot states of its store: digest of the listing, cuts, and days of each fold."""
    cut = cuts(bars)
    days = fold_days(bars, cut).agg(F.array_sort(F.collect_list(F.struct("fold", "days"))).alias("fold_days"))
    return listing_digest(bars).crossJoin(F.broadcast(cut)).crossJoin(F.broadcast(days))


def snapshot_reasons(frozen: DataFrame, bars: DataFrame) -> DataFrame:
    """What no longer holds of a frozen snapshot (one row) against a store: its listing, its cuts, which
    must follow from its own last day, and its days by fold."""
    now = listing_digest(bars).select(F.col("digest").alias("now"))
    # the cuts as they follow from the day that was frozen
    again = frozen.select(F.add_months("last", -2).alias("x3")).select("x3", F.add_months("x3", -3).alias("x2")).select("x3", "x2", F.add_months("x2", -3).alias("x1"))
    days = fold_days(bars, frozen.select("last", "c1", "c2", "c3")).agg(F.array_sort(F.collect_list(F.struct("fold", "days"))).alias("now_days"))
    j = frozen.crossJoin(F.broadcast(now)).crossJoin(F.broadcast(again)).crossJoin(F.broadcast(days))
    drift = F.when(F.col("digest") != F.col("now"), "listing"), F.when((F.col("c1") != F.col("x1")) | (F.col("c2") != F.col("x2")) | (F.col("c3") != F.col("x3")), "cuts"), F.when(F.col("fold_days") != F.col("now_days"), "fold days")
    return j.select(F.array_compact(F.array(*drift)).alias("reasons"))


def attestation(frozen: DataFrame, streams: DataFrame, slices: DataFrame, fold: str) -> DataFrame:
    """Why streams may not stand for a snapshot: they name another run or listing, or the fold has no
    slice. frozen, streams: (run, digest), one row; slices: (fold, ...)."""
    s = streams.select(F.col("run").alias("of_run"), F.col("digest").alias("of_digest"))
    held = slices.filter(F.col("fold") == fold).agg((F.count(F.lit(1)) > 0).alias("held"))
    j = frozen.select("run", "digest").join(s, F.lit(True), "left").crossJoin(F.broadcast(held))
    why = F.when(~F.col("run").eqNullSafe(F.col("of_run")), "run"), F.when(~F.col("digest").eqNullSafe(F.col("of_digest")), "digest"), F.when(~F.col("held"), "no slices")
    return j.select(F.array_compact(F.array(*why)).alias("reasons"))


def holdout(trades: DataFrame, chosen: Sequence[str], spent: bool = False, key: str = "combo", most: int = 10, known: Iterable[str] | None = None) -> DataFrame:
    """Descriptive rows of a few chosen keys, once: refuses when spent, for too many or unknown keys. trades
    are those of the holdout fold (see `sliced`). known: the keys of the grid, of which one without a trade
    in the fold has no row; those of the trades where it isn't given."""
    why = []
    if spent:
        why.append("the holdout has been opened")
    if len(chosen) > most:
        why.append(f"{len(chosen)} keys, more than {most}")
    if known is None:
        known = [r[0] for r in trades.filter(F.col(key).isin(*chosen)).select(key).distinct().collect()] if chosen else []
    if missing := sorted(set(chosen) - set(known)):
        why.append(f"unknown: {', '.join(missing)}")
    if why:
        raise Refused(why)
    return backtest.event_study(trades.filter(F.col(key).isin(*chosen)), (key,))


def opened_early(signals: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows of an opened holdout that lie at or before its cut; there must be none."""
    return signals.crossJoin(F.broadcast(cut)).filter(F.to_date("bar_ts") <= F.col("c3")).select(*signals.columns)


def churn(trades: DataFrame, classes: DataFrame, key: str = "combo") -> DataFrame:
    """Trades and the sign of their mean by key and class of symbol. classes: (sym, class)."""
    g = trades.filter("complete").join(classes, "sym", "left").groupBy(key, F.coalesce("class", F.lit("dead")).alias("class"))
    return g.agg(F.count(F.lit(1)).alias("trades"), F.signum(F.round(F.avg("net"), 9)).alias("sign"))
