"""Studies and campaigns on executed rows, against plain Python over the collected signals."""

import math
import statistics
from collections import defaultdict
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from barwright.operators import backtest as T
from barwright.operators import campaign as C
from barwright.operators import native, recursive, scoring
from barwright.plans import scores, trading
from barwright.sources import bars as B

SF = "/root/testdata/sf0.001"


def plain_trades(rows, keys, horizons=(5, 10, 20), warmup=60, cost=0.3):
    """Trades of signal rows, one series of a key after the other."""
    out = []
    series = defaultdict(list)
    for r in rows:
        series[tuple(r[k] for k in keys)].append(r)
    for key, bars in series.items():
        bars.sort(key=lambda r: r["idx"])
        states = [r["state"] if r["idx"] >= warmup else "HOLD" for r in bars]
        for i, s in enumerate(states):
            if s == "HOLD" or i and states[i - 1] == s:
                continue
            for h in horizons:
                other = "SELL" if s == "BUY" else "BUY"
                end = next((j for j in range(i + 1, min(i + h, len(bars) - 1) + 1) if states[j] == other), i + h)
                done = end < bars[i]["n"]
                gross = (bars[end]["close"] / bars[i + 1]["open"] - 1) * 100 * (1 if s == "BUY" else -1) if done else None
                out.append({**dict(zip(keys, key, strict=True)), "idx": i, "horizon": h, "side": "long" if s == "BUY" else "short", "exit": end, "complete": done, "net": gross - cost if done else None, "exit_ts": bars[end]["bar_ts"] if done else None})
    return out


def plain_combos(rows, names, most=3):
    """Signals of combinations, state by state."""
    from itertools import combinations

    at = defaultdict(dict)
    for r in rows:
        at[r["sym"], r["idx"]][r["indicator"]] = r
    out = []
    for k in range(1, most + 1):
        for c in combinations(sorted(names), k):
            for (sym, idx), own in at.items():
                states = {own[x]["state"] for x in c}
                first = own[c[0]]
                out.append({**{x: first[x] for x in ("bar_ts", "n", "open", "close")}, "sym": sym, "idx": idx, "combo": "+".join(c), "state": states.pop() if len(states) == 1 else "HOLD"})
    return out


def study(trades, keys):
    groups = defaultdict(list)
    for t in trades:
        groups[tuple(t[k] for k in (*keys, "horizon", "side"))].append(t)
    return {k: (sum(t["complete"] for t in v), sum(not t["complete"] for t in v), [t["net"] for t in v if t["complete"]]) for k, v in groups.items()}


NAMES = ["MFI", "ROC", "RSI", "VWAP"]


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in native.signals(B.hourly(spark, SF), NAMES).collect()]


def test_combination_trades_against_plain_loops(spark, rows):
    got = C.combo_trades(native.signals(B.hourly(spark, SF), NAMES), C.combos(spark, NAMES, 3)).collect()
    want = plain_trades(plain_combos(rows, NAMES), ("sym", "combo"))
    key = lambda t: (t["sym"], t["combo"], t["idx"], t["horizon"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 500
    by = {key(t): t for t in want}
    for t in got:
        w = by[key(t)]
        assert (t.side, t.exit_idx, t.complete) == (w["side"], w["exit"], w["complete"])
        assert t.net == (pytest.approx(w["net"]) if w["complete"] else None)


def test_more_names_than_one_number_holds(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "BITS", 2)
    wide = C.combo_trades(native.signals(B.hourly(spark, SF), NAMES), C.combos(spark, NAMES, 3)).select("sym", "combo", "idx", "horizon", "exit_idx")
    want = plain_trades(plain_combos(rows, NAMES), ("sym", "combo"))
    assert sorted(map(tuple, wide.collect())) == sorted((t["sym"], t["combo"], t["idx"], t["horizon"], t["exit"]) for t in want)
    states = C.combo_signals(native.signals(B.hourly(spark, SF), NAMES), C.combos(spark, NAMES, 2)).collect()
    assert {(r.sym, r.idx, r.combo): r.state for r in states} == {(r["sym"], r["idx"], r["combo"]): r["state"] for r in plain_combos(rows, NAMES, 2)}


def test_study_of_recursive_indicators(spark):
    names = ["MACD", "Parabolic SAR", "AutoFractal", "EMA9/21", "EchoChamber"]
    own = [r.asDict() for r in recursive.signals(B.daily_by_nation(spark, SF), names).collect()]
    want = study(plain_trades(own, ("sym", "indicator")), ("indicator",))
    got = trading.QUERIES["event_study_recursive"](spark, SF).collect()
    assert {(r.indicator, r.horizon, r.side): (r.trades, r.incomplete) for r in got} == {k: v[:2] for k, v in want.items()}
    for r in got:
        nets = want[r.indicator, r.horizon, r.side][2]
        assert r.avg_net == (pytest.approx(statistics.fmean(nets), abs=1e-4) if nets else None)


def test_metric_block_against_plain_python(spark):
    names = trading.STUDIED
    own = [r.asDict() for r in native.signals(B.hourly(spark, SF), names).collect()]
    want = study(plain_trades(plain_combos(own, names, 2), ("sym", "combo"), (10,)), ("combo",))
    got = trading.QUERIES["metric_block"](spark, SF).collect()
    assert len(got) == sum(v[0] > 0 for v in want.values()) > 10
    for r in got:
        nets = want[r.combo, 10, r.side][2]
        assert r.n == len(nets) and r.mean_net == pytest.approx(statistics.fmean(nets), abs=1e-4) and r.median_net == pytest.approx(statistics.median(nets), abs=1e-4)
        assert r.hit_rate == pytest.approx(sum(x > 0 for x in nets) / len(nets), abs=1e-4)
        if len(nets) > 1:
            assert min(nets) - 1e-3 <= r.ci_low <= r.ci_high <= max(nets) + 1e-3
            mean, error = statistics.fmean(nets), statistics.pstdev(nets) / math.sqrt(len(nets))
            assert r.ci_low <= mean + 4 * error + 1e-3 and r.ci_high >= mean - 4 * error - 1e-3


def test_campaign_ranking_against_plain_python(spark):
    bars = B.daily_by_nation(spark, SF)
    own = [r.asDict() for r in native.signals(bars, trading.STUDIED).collect()]
    trades = [t for t in plain_trades(own, ("sym", "indicator"), (10,)) if t["side"] == "long" and t["complete"]]
    at = {(r["sym"], r["idx"]): r["bar_ts"] for r in own}
    days = sorted({r["bar_ts"] for r in own})
    start = min(60, max(0, len(days) - 2))
    size = max(1, (len(days) - start) // 3)
    fold = {d: min((k - start) // size, 2) for k, d in enumerate(days) if k >= start}
    tests = defaultdict(list)
    for t in trades:
        if (d := at[t["sym"], t["idx"]]) in fold:
            tests[t["indicator"], fold[d]].append(t["net"])
    p = {k: (0.5 * math.erfc(statistics.fmean(v) / (statistics.stdev(v) / math.sqrt(len(v))) / math.sqrt(2)), len(v), statistics.fmean(v)) for k, v in tests.items() if len(v) > 1 and statistics.stdev(v) > 0}
    order = sorted(p, key=lambda k: (p[k][0], k))
    limit = max((p[k][0] for i, k in enumerate(order, 1) if p[k][0] <= 0.1 * i / len(order)), default=-1)
    want = {}
    for name in {k[0] for k in p}:
        mine = [v for k, v in p.items() if k[0] == name]
        want[name] = (sum(v[0] <= limit for v in mine), sum(v[1] for v in mine), round(sum(v[1] * v[2] for v in mine) / sum(v[1] for v in mine), 4))
    got = trading.QUERIES["campaign_ranking"](spark, SF).collect()
    assert {r.name: (r.folds, r.trades) for r in got} == {k: v[:2] for k, v in want.items()}
    assert all(r.mean == pytest.approx(want[r.name][2], abs=1e-3) for r in got)


def plain_statistics(xs):
    n, mean = len(xs), statistics.fmean(xs)
    dev = [x - mean for x in xs]
    m2 = sum(d * d for d in dev) / n
    if m2 <= 1e-18:
        return None
    long = m2 + sum(2 * (1 - i / 11) * sum(a * b for a, b in zip(dev[i:], dev)) / n for i in range(1, 11) if n > i)
    sd = math.sqrt(max(long, 0))
    return (mean / sd if sd > 1e-12 else None, sum(d**3 for d in dev) / n / m2**1.5, sum(d**4 for d in dev) / n / m2**2)


def test_gate_on_both_folds_against_plain_python(spark, tmp_path):
    """Two folds of made signals: statistics, deflated ratios and the gate, from the trades up."""
    import random
    from datetime import datetime, timedelta

    rng = random.Random(4)
    names, syms, n = [f"i{k}" for k in range(6)], ["A", "B", "C"], 330
    data = []
    for s in syms:
        price, drift = 100.0, 0
        for i in range(n):
            drift = rng.choice([-1, 1]) if i % 7 == 0 else drift
            new = price * (1 + rng.gauss(0.001 * drift, 0.01))
            for k, x in enumerate(names):
                state = ("BUY" if drift > 0 else "SELL") if rng.random() < 0.2 + 0.1 * k else rng.choice(["HOLD", "BUY", "SELL"])
                data.append((s, datetime(2024, 1, 1) + timedelta(days=i), i, n, price, new, x, "trend", state, 0.0))
            price = new
    sig = spark.createDataFrame(data, "sym string, bar_ts timestamp, idx int, n int, open double, close double, indicator string, category string, state string, score double").cache()
    cut = C.cuts(sig)
    c = cut.first()
    grid = C.combos(spark, names, 3)
    charged = {"val1": grid.count(), "val2": 2 * grid.count()}
    assert {r.fold: r.trials for r in C.trial_ledger(spark.createDataFrame([(0, "val1", 41), (1, "val2", 41)], "k int, fold string, trials long")).collect()} == {"val1": 41, "val2": 82, "total": 82} and grid.count() == 41
    keep = {"val1": lambda d: c.c1 < d <= c.c2, "val2": lambda d: c.c2 < d <= c.c3}
    tables, long, want, want_long = {}, None, {}, defaultdict(int)
    for fold in ("val1", "val2"):
        s = C.sliced(sig, fold, cut)
        trades = C.combo_trades(s, grid, warmup=0)
        stats = C.series_statistics(C.panel(trades, s.select("sym", "bar_ts").distinct()))
        days = s.select("bar_ts").distinct().count()
        tables[fold] = C.deflated(stats, days, charged[fold])
        own = trades.filter("side = 'long' and horizon = 10 and complete").select("combo")
        long = own if long is None else long.unionAll(own)
        # the same in plain Python
        rows = [dict(zip(("sym", "bar_ts", "idx", "n", "open", "close", "indicator", "category", "state", "score"), r, strict=True)) for r in data if keep[fold](r[1].date())]
        first = min(r["idx"] for r in rows)
        size = len({r["idx"] for r in rows})
        rows = [{**r, "state": r["state"] if r["idx"] >= 60 else "HOLD", "idx": r["idx"] - first, "n": size} for r in rows]
        done = plain_trades(plain_combos(rows, names), ("sym", "combo"), warmup=0)
        axis = sorted({r["bar_ts"] for r in rows})
        assert days == len(axis)
        series = {k: dict.fromkeys(axis, 0.0) for k in {t["combo"] for t in done}}
        for t in done:
            if t["side"] == "long" and t["horizon"] == 10 and t["complete"]:
                series[t["combo"]][t["exit_ts"]] += t["net"] / len(syms)
                want_long[t["combo"]] += 1
        st = {k: x for k, v in series.items() if (x := plain_statistics(list(v.values()))) and x[0] is not None}
        spread, nd, e = statistics.stdev(x[0] for x in st.values()), NormalDist(), 0.5772156649015329
        bar = spread * ((1 - e) * nd.inv_cdf(1 - 1 / charged[fold]) + e * nd.inv_cdf(1 - 1 / (charged[fold] * math.e)))
        want[fold] = {k: (sr, nd.cdf((sr - bar) * math.sqrt(days - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))) for k, (sr, skew, kurt) in st.items()}
    for fold, t in tables.items():
        got = {r.combo: (r.sr, r.dsr) for r in t.collect()}
        assert set(got) == set(want[fold])
        assert all(got[k] == (pytest.approx(v[0], abs=1e-9), pytest.approx(v[1], abs=1e-9)) for k, v in want[fold].items())
    gated = C.gate(tables["val1"], tables["val2"], long.groupBy("combo").agg(F.count(F.lit(1)).alias("trades"))).collect()
    assert {r.combo for r in gated} == set(want["val1"]) & set(want["val2"])
    for r in gated:
        (s1, d1), (s2, d2) = want["val1"][r.combo], want["val2"][r.combo]
        assert r.trades == want_long[r.combo]
        assert r.passes == (d1 >= 0.95 and d2 >= 0.95 and s1 * s2 > 0 and want_long[r.combo] >= 400)
    # the folds differ: a gate over one fold given twice would say something else
    assert any((r.sr1 > 0) != (r.sr2 > 0) for r in gated)


def test_holdout_holds_no_day_up_to_the_cut(spark):
    bars = B.daily_by_nation(spark, SF)
    cut = C.cuts(bars)
    s = C.sliced(native.signals(bars, ["ROC"]), "holdout", cut)
    assert s.count() > 0 and C.opened_early(s, cut).count() == 0 and C.opened_early(native.signals(bars, ["ROC"]), cut).count() > 0
    t = C.combo_trades(s, C.combos(spark, ["ROC"], 1), warmup=0)
    c3 = cut.first().c3
    assert t.filter(F.to_date("bar_ts") <= F.lit(c3)).count() == 0


def test_final_score_against_plain_python(spark):
    """From the votes of all indicators to the score, family by family."""
    bars = B.hourly(spark, SF)
    sig = native.signals(bars).filter("idx = n - 1").select("sym", "indicator", "category", "state", "score").unionAll(recursive.signals(bars, last_only=True).select("sym", "indicator", "category", "state", "score"))
    by = defaultdict(list)
    for r in sig.collect():
        if r.indicator not in scoring.RISK_ONLY:
            by[r.sym].append((r.category if r.category in ("momentum", "volume") else "trend", {"BUY": 1, "SELL": -1}.get(r.state, 0), abs(r.score)))
    risk = {r.sym: r.risk_multiplier for r in scoring.squeeze(native.kernels(bars)).filter("idx = n - 1").collect()}
    index = scoring.regimes(scores.index_bars(bars)).filter("idx = n - 1").first()
    got = {r.sym: r for r in scores.QUERIES["final_score"](spark, SF).collect()}
    assert set(got) == set(by)
    for sym, votes in by.items():
        strength, vote = {}, {}
        for f in scoring.FAMILIES:
            own = [v for g, v, _ in votes if g == f]
            if own:
                b, s = own.count(1), own.count(-1)
                strength[f] = (b - s) / len(own)
                vote[f] = 1 if b > s and b >= 2 else -1 if s > b and s >= 2 else 0
        weight = sum(scoring.FAMILIES[f] for f in strength)
        direction = (sum(strength[f] * scoring.FAMILIES[f] for f in strength) / weight + 1) / 2
        ups, downs = sum(v > 0 for v in vote.values()), sum(v < 0 for v in vote.values())
        agreement = (ups if ups >= 2 else downs if downs >= 2 else max(ups, downs)) / len(vote) if len(vote) >= 3 else 1.0 if len(set(vote.values())) == 1 else 0.5
        overall = (ups > downs) - (downs > ups)
        volume = 0.5 if "volume" not in vote else 1.0 if vote["volume"] == overall else 0.2
        confidence = max(0.0, min(1.0, 0.5 * agreement + 0.3 * statistics.fmean(x for *_, x in votes) + 0.2 * volume))
        final = max(-1.0, min(1.0, (2 * direction - 1) * confidence * risk[sym] * index.regime_multiplier))
        assert got[sym].direction == pytest.approx(direction, abs=1e-5) and got[sym].confidence == pytest.approx(confidence, abs=1e-5)
        assert got[sym].final_score == pytest.approx(final, abs=1e-5) and got[sym].leaning == ("BULLISH" if final > 0 else "BEARISH")


def test_long_series_take_time_in_proportion(spark):
    """The exit search looks as far as the longest horizon only."""
    from time import perf_counter

    def seconds(n):
        s = spark.range(n).selectExpr("'X' as sym", "timestamp_seconds(id * 60) as bar_ts", "cast(id as int) as idx", f"{n} as n", "100.0D + id % 7 as open", "100.0D + id % 5 as close", "'I' as indicator", "case id % 3 when 0 then 'BUY' when 1 then 'SELL' else 'HOLD' end as state")
        t = perf_counter()
        T.event_trades(s).write.format("noop").mode("overwrite").save()
        return perf_counter() - t

    seconds(1000)
    assert seconds(80_000) < 20
