"""Hand-computed outcomes of trades, metrics and corrections."""

import math
from datetime import datetime, timedelta

import pytest

from barwright.operators import backtest as T
from barwright.operators import campaign as C
from barwright.operators import options, quality, registry, scoring, store
from barwright.sources import bars as B

DAY = datetime(2024, 1, 1)


def signals(spark, n, states, opens=None, closes=None):
    opens, closes = opens or {}, closes or {}
    rows = [("X", DAY + timedelta(days=i), i, n, float(opens.get(i, 100.0)), float(closes(i) if callable(closes) else closes.get(i, 100.0)), "I", "trend", states.get(i, "HOLD"), 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "sym string, bar_ts timestamp, idx int, n int, open double, close double, indicator string, category string, state string, score double")


def trades(spark, *a, **k):
    return T.event_trades(signals(spark, *a, **k), horizons=[5]).collect()


def test_entry_is_the_next_open(spark):
    (t,) = trades(spark, 100, {65: "BUY"}, opens={66: 200.0})
    assert t.side == "long" and t.gross == pytest.approx(-50.0) and t.net == pytest.approx(-50.3)


def test_opposite_state_ends_a_trade(spark):
    got = {t.side: t for t in trades(spark, 100, {**{i: "BUY" for i in range(65, 70)}, 70: "SELL"}, closes=lambda i: 105.0 if i >= 70 else 100.0)}
    assert got["long"].gross == pytest.approx(5.0) and got["long"].net == pytest.approx(4.7)
    assert got["short"].gross == pytest.approx(-5.0) and got["short"].net == pytest.approx(-5.3)


def test_trade_beyond_the_data_is_incomplete(spark):
    (t,) = trades(spark, 80, {78: "BUY"})
    assert not t.complete and t.net is None


def test_warm_up_bars_never_signal(spark):
    assert trades(spark, 100, {30: "BUY"}) == []


def test_evidence_grades(spark):
    rows = [("I", 10, "long", 100.0 + k % 2) for k in range(30)]
    df = spark.createDataFrame(rows, "indicator string, horizon int, side string, net double")
    assert T.evidence(df).first().weight == "strong"
    assert T.evidence(df.limit(5)).first().weight == "insufficient"


def test_metrics_by_hand(spark):
    t = spark.createDataFrame([("X", i, r, 3, 0.2) for i, r in enumerate([10.0, -50.0, 20.0])], "sym string, idx int, return_pct double, held int, commission_pct double")
    m = T.trade_metrics(t, spark.createDataFrame([("X", 252)], "sym string, days long")).first()
    assert m.total_return == pytest.approx((1.1 * 0.5 * 1.2 - 1) * 100)
    assert m.max_drawdown == pytest.approx(50.0) and m.win_rate == pytest.approx(200 / 3)
    assert m.annualised == pytest.approx(m.total_return)
    assert m.sortino == pytest.approx((-20 / 3) / 50)


def test_stop_and_target_move_the_exit(spark):
    df = spark.createDataFrame([(100.0, 50.0), (100.0, 150.0)], "a double, b double")
    got = [r[0] for r in df.select(T.executed(df.a, df.b, slip_in=0.0, slip_out=0.0, stop=10.0, take=20.0)).collect()]
    assert got == [pytest.approx(-10.0), pytest.approx(20.0)]


def test_one_position_at_a_time(spark):
    s = spark.createDataFrame([("X", i, DAY + timedelta(days=i), 10.0 + i, 0.9) for i in range(12)], "sym string, idx int, bar_ts timestamp, close double, score double")
    assert [(t.idx, t.held) for t in T.strategy_threshold(s).orderBy("idx").collect()] == [(0, 5), (5, 5), (10, 1)]


def test_corrections_by_hand():
    assert C.expected_best(0.5, 30) == pytest.approx(1.0366, abs=1e-4)
    assert C.ratio_error(1.0, 0.0, 3.0) ** 2 == pytest.approx(1.5)
    with pytest.raises(C.Refused):
        C.ratio_error(10.0, 5.0, 0.0)
    assert C.one_sided_p(0.0) == pytest.approx(0.5)


def test_bootstrap_is_the_same_every_time():
    v = [math.sin(i) for i in range(50)]
    assert C.bootstrap_interval(v, 99) == C.bootstrap_interval(v, 99)
    assert C.bootstrap_interval([1.0]) is None


def test_deflation_refuses_few_trials(spark):
    stats = spark.createDataFrame([("a", 10, 0.1, 0.0, 3.0)], "combo string, days long, sr double, skew double, kurt double")
    with pytest.raises(C.Refused) as e:
        C.deflated(stats, 10, 5)
    assert len(e.value.reasons) == 2


def test_gate_needs_both_folds_and_trades(spark):
    v = lambda s, d: spark.createDataFrame([("a", s, d), ("b", s, 0.5)], "combo string, sr double, dsr double")
    n = spark.createDataFrame([("a", 500), ("b", 500)], "combo string, trades long")
    assert C.verdict(C.gate(v(0.2, 0.99), v(0.1, 0.99), n)).first().verdict == "LEADERBOARD"
    assert C.verdict(C.gate(v(0.2, 0.99), v(-0.1, 0.99), n)).first().verdict == "NO-EDGE"
    few = n.withColumn("trades", n.trades - 200)
    assert C.verdict(C.gate(v(0.2, 0.99), v(0.1, 0.99), few)).first().reason == "too few trades"


def test_holdout_refusals(spark):
    t = T.event_trades(signals(spark, 100, {65: "BUY"})).withColumnRenamed("indicator", "combo")
    with pytest.raises(C.Refused):
        C.holdout(t, ["I"], spent=True)
    with pytest.raises(C.Refused):
        C.holdout(t, ["nobody"])
    assert C.holdout(t, ["I"]).count() == 3


def test_holdout_of_a_key_without_trades(spark):
    t = T.event_trades(signals(spark, 100, {65: "BUY"})).withColumnRenamed("indicator", "combo")
    got = C.holdout(t, ["I", "quiet"], known=["I", "quiet", "other"]).collect()
    assert [r.combo for r in got] == ["I"] * 3
    assert C.holdout(t, ["quiet"], known=["I", "quiet"]).count() == 0
    with pytest.raises(C.Refused, match="nobody"):
        C.holdout(t, ["I", "nobody"], known=["I", "quiet"])


def test_quotas_shave_the_largest():
    assert registry.quotas({"a": 90, "b": 5, "c": 5}, 10) == {"a": 8, "b": 1, "c": 1} or sum(registry.quotas({"a": 90, "b": 5, "c": 5}, 10).values()) <= 10
    assert registry.quotas({"a": 1, "b": 1, "c": 1}, 2) and sum(registry.quotas({"a": 1, "b": 1, "c": 1}, 2).values()) == 2


def bars(spark, closes, sym="X"):
    rows = [(sym, DAY + timedelta(days=i), c, c, c, c, 10.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, B.SCHEMA)


def test_split_is_made_continuous(spark):
    got = [r.close for r in quality.adjust_splits(bars(spark, [100.0, 100.0, 50.0, 50.0])).orderBy("bar_ts").collect()]
    assert got == [100.0, 100.0, 100.0, 100.0]
    assert quality.detect_splits(bars(spark, [100.0, 140.0])).first().ratio == pytest.approx(1.4)


def test_stored_bars_win(spark):
    merged = {r.bar_ts.day: r.close for r in store.upsert(bars(spark, [1.0, 2.0]), bars(spark, [9.0, 9.0, 3.0])).collect()}
    assert merged == {1: 1.0, 2: 2.0, 3: 3.0}


def test_csv_and_parquet_stores(spark, tmp_path):
    b = bars(spark, [1.0, 2.0, 3.0], "BRK-B")
    B.write_csv_store(b, str(tmp_path / "csv"))
    back = B.read_csv_folders(spark, str(tmp_path / "csv"))
    assert sorted((r.sym, r.close) for r in back.collect()) == [("BRK_B", 1.0), ("BRK_B", 2.0), ("BRK_B", 3.0)]
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "A_B.csv").write_text("date,open,high,low,close,volume\n2024-01-01,1,2,0.5,1.5,10.0\n2024-01-02,x,2,1,,5\n")
    (r,) = B.read_csv_store(spark, str(tmp_path / "flat")).collect()
    assert (r.sym, r.close, r.volume) == ("A_B", 1.5, 10.0)
    B.write_store(b, str(tmp_path / "pq"))
    assert B.read_store(spark, str(tmp_path / "pq"), "BRK-B").count() == 3
    assert B.store_age_days(spark, str(tmp_path / "pq")).first().age_days < 1


def test_signal_files(spark, tmp_path):
    s = signals(spark, 5, {2: "BUY"}).select("sym", "bar_ts", "state", "open", "close", "indicator")
    B.write_signals(s, str(tmp_path / "s"))
    assert B.read_signals(spark, str(tmp_path / "s")).filter("state = 'BUY'").count() == 1


def test_registry_file(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"version": 2, "timestamp": "t", "tickers": {"usa": ["A", "bad sym"], "international": ["A", "Z"]}}')
    r = registry.read_registry(spark, str(tmp_path / "r.json"))
    assert [x.reason for x in registry.charset_reasons(r).collect()] == ["symbol"]
    got = {x.sym: x.region for x in registry.primary_regions(r.filter("sym != 'bad sym'"), ["usa"]).collect()}
    assert got == {"A": "usa", "Z": "unchecked"}


def test_max_pain_by_hand(spark):
    chain = spark.createDataFrame([("X", "call", 90.0, 10.0, 1.0), ("X", "put", 110.0, 10.0, 3.0)], "sym string, side string, strike double, oi double, volume double")
    spots = spark.createDataFrame([("X", 100.0), ("Y", 5.0)], "sym string, price double")
    got = {r.sym: r.max_pain for r in options.max_pain(chain, spots).collect()}
    assert got == {"X": 90.0, "Y": 5.0}
    assert options.put_call(chain).first().put_call == 3.0


def test_labels_of_strength(spark):
    df = spark.createDataFrame([(0.1, 0.9), (0.5, 0.3), (0.3, 0.9), (0.5, 0.9), (-0.5, 0.9), (0.8, 0.9), (-0.8, 0.9)], "s double, c double")
    got = [r[0] for r in df.select(scoring.strength_label(df.s, df.c)).collect()]
    assert got == ["Neutral", "Weak", "Moderate", "Bullish", "Bearish", "Strong Bullish", "Strong Bearish"]


def test_compat_row_keeps_the_published_sign(spark):
    row = [("X", -0.5, 0.9, -0.5, None, None, -1, None, None, "Bearish")]
    df = spark.createDataFrame(row, "sym string, final_score double, risk_multiplier double, strength_trend double, strength_momentum double, strength_volume double, vote_trend int, vote_momentum int, vote_volume int, label string")
    assert scoring.page_row(df).first().trend == 25.0
    assert scoring.page_row(df, compat=True).first().trend == 75.0


def test_weekday_staleness(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2024-01-05", "2024-01-08", False), ("2024-01-04", "2024-01-08", True), ("2024-01-08", "2024-01-09", False)], "d string, t string, want boolean")
    assert all(r[0] == r[1] for r in df.select(store.is_stale(F.to_date("d"), F.to_date("t")), "want").collect())
