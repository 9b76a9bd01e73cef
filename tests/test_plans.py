"""Shapes of physical plans: one exchange for all native windows, no Python there, columns pruned."""

import re

from barwright.operators import native, scoring
from barwright.plans import trading
from barwright.sources import bars as B

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_signals_share_one_sort(spark):
    p = plan(native.signals(B.hourly(spark, SF)))
    assert "Python" not in p and "Pandas" not in p
    # one exchange aggregates ticks to bars, one deals bars by symbol
    assert len(re.findall(r"Exchange hashpartitioning\(sym", p)) <= 2


def test_unused_kernels_are_pruned(spark):
    one, all_ = plan(native.indicator(B.hourly(spark, SF), "ROC")), plan(native.signals(B.hourly(spark, SF)))
    assert one.count("windowspecdefinition") < all_.count("windowspecdefinition") / 4


def test_scans_read_needed_columns_only(spark):
    p = plan(B.hourly(spark, SF))
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp(_ntz)?,event_type:string,value:double>", p)


def test_event_study_stays_in_the_jvm(spark):
    p = plan(trading.QUERIES["event_study"](spark, SF))
    assert "Python" not in p and "CartesianProduct" not in p and "BroadcastNestedLoop" not in p


def test_direction_is_one_aggregation(spark):
    s = native.signals(B.hourly(spark, SF)).filter("idx = n - 1")
    p = plan(scoring.directions(scoring.votes(s)))
    assert p.count("keys=[sym") <= 6
