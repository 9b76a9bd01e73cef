"""Queries against DuckDB on series with ties that the last bit decides, and on customers whose keys are repeated or missing."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barwright.plans.registry import ORACLES, QUERIES
from tests.test_queries import _text

#: The last close is half a percent under the lower line, but for the last bit.
TIED = [
    179.85, 164.82, 180.95, 148.5, 148.95, 182.6, 167.33, 167.83, 167.5, 184.8, 168.5, 169.0, 152.55, 153.0, 171.35, 171.0, 172.36, 172.0, 189.75, 173.86, 173.5, 174.0, 191.95, 157.5, 176.38,
    176.88, 194.15, 177.0, 159.75, 160.2, 196.35, 196.9, 197.45, 198.0, 180.5, 181.0, 180.59, 182.0, 182.5, 183.0, 182.58, 202.4, 202.95, 185.92, 184.57, 186.0, 167.85, 187.93, 206.25,
]

#: Level for as long as a turning point looks about, then moving: with the prices of a level stretch summed
#: another way their mean is above them, and they count as bottoms.
LEVEL = [0.2] * 40 + [10.55, 0.32, 2.87, 5.38, 4.97, 1.68, 4.19, 0.41, 4.73, 1.84, 2.9, 1.76, 12.74, 14.44, 0.85, 13.27, 1.04, 3.57, 0.27, 8.28]


def _same(spark, at, name, series):
    """Both give the same of one tick an hour, a series a symbol."""
    start = datetime.datetime(2024, 1, 1)
    rows = [{"ts": start + datetime.timedelta(hours=h), "event_type": sym, "value": v} for sym, values in series.items() for h, v in enumerate(values)]
    t = pa.Table.from_pylist([{"event_id": i, "user_id": 1, "props": "{}", **r} for i, r in enumerate(rows)])
    pq.write_table(t, at / "events.parquet", coerce_timestamps="us")
    return _same_table(spark, at, name, "events")


def _same_table(spark, at, name, table):
    duck = duckdb.connect()
    duck.execute("set timezone = 'UTC'")
    duck.execute(f"create view {table} as select * from '{at}/{table}.parquet'")
    df = QUERIES[name](spark, str(at))
    cols = sorted(df.columns)
    got = sorted(tuple(map(_text, r)) for r in df.select(*cols).collect())
    exp = sorted(tuple(map(_text, r)) for r in duck.sql(ORACLES[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert len(got) > 0 and got == exp
    return got


def test_autotrend_closes_tied_with_a_line(spark, tmp_path):
    _same(spark, tmp_path, "autotrend", {"a": TIED})


def test_wedge_level_bars(spark, tmp_path):
    got = _same(spark, tmp_path, "wedge", {"a": LEVEL})
    assert len(got) == len(LEVEL)


def _holed(seed, *odd):
    rng = random.Random(seed)
    return [rng.choice(odd) if rng.random() < 0.06 else round(rng.expovariate(0.02), 2) for _ in range(300)]


@pytest.mark.parametrize("name", ["autotrend", "wedge"])
def test_ticks_without_price_or_symbol(spark, tmp_path, name):
    nan = float("nan")
    series = {f"{k}{i}": _holed(i, *odd) for k, odd in {"none": [None], "nan": [nan], "both": [None, nan, 0.0]}.items() for i in range(8)}
    got = _same(spark, tmp_path, name, {**series, None: _holed(9, 1.0)})
    assert {"BUY", "SELL"} <= {v for row in got for v in row}


def test_hour_that_ends_without_price(spark, tmp_path):
    """The last tick with a price closes the bar."""
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=20 * k) for k in range(6)]
    rows = [{"event_id": k, "user_id": 1, "props": "{}", "ts": ts, "event_type": "a", "value": v} for k, (ts, v) in enumerate(zip(at, (None, 2.0, None, 3.0, 1.0, None), strict=True))]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "events.parquet", coerce_timestamps="us")
    _same_table(spark, tmp_path, "bars_hourly", "events")


def test_page_rewrite_repeated_keys_and_large_balances(spark, tmp_path):
    balances = (250.0, 7123.45, -3.0, None, 1234567.8, 2e9, -0.0, 0.0, float("nan"), float("inf"))
    rows = [{"c_custkey": key, "c_nationkey": i % 3, "c_acctbal": b, "c_mktsegment": seg} for i, b in enumerate(balances) for key, seg in ((1, "AUTO"), (None, "AUTO"), (100 + i, None), (200 + i, "Seg 1"), (300 + i, ""))]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "customer.parquet")
    _same_table(spark, tmp_path, "page_rewrite", "customer")
