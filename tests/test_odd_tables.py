"""Queries against DuckDB on tables with prices and balances of zero, signed zeros among them, and with bars
that are level before an average begins."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from barwright.plans.registry import ORACLES, QUERIES
from tests.test_queries import _text

#: High, low and close of bars whose first averages differ by the last bit with the order of a sum.
LEVEL = list(zip(
    [64.5, 79.9, 78.4, 85.2, 52.5, 73.6, 54.6, 94.7, 54.1, 89.1, 90.6, 57.0, 78.7, 58.0, 53.4, 71.0], [43.3, 32.5, 63.2, 73.0, 51.5, 19.1, 26.2, 45.2, 38.9, 61.4, 38.9, 13.0, 26.5, 24.9, 26.4, 41.8],
    [57.3, 44.0, 70.3, 77.7, 52.3, 23.3, 41.3, 58.4, 45.9, 80.2, 61.8, 31.0, 34.7, 48.9, 35.4, 63.6], strict=True))


def _events():
    rng, rows = random.Random(5), []
    for sym in ("click", "error", "purchase", "signup", "view"):
        for hour in range(320):
            for minute in range(rng.randint(1, 3)):
                zero = hour < 319 and rng.random() < 0.05
                rows.append({"ts": datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour, minutes=minute), "event_type": sym, "value": 0.0 if zero else round(rng.expovariate(0.02), 2)})
    return [{"event_id": i, "user_id": i % 7, "props": "{}", **r} for i, r in enumerate(rows)]


def _lineitem():
    rows = []
    for nation in (3, 7):
        for day, (high, low, close) in enumerate(LEVEL):
            at = datetime.datetime(1995, 1, 2) + datetime.timedelta(days=day)
            rows += [{"l_orderkey": day, "l_linenumber": k, "l_suppkey": nation, "l_quantity": 1.0, "l_extendedprice": p, "l_shipdate": at} for k, p in enumerate((close, high, low, close))]
    return rows


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    tables = {
        "events": _events(), "lineitem": _lineitem(),
        "supplier": [{"s_suppkey": n, "s_name": f"s{n}", "s_nationkey": n, "s_acctbal": 0.0} for n in (3, 7)],
        "customer": [{"c_custkey": i, "c_name": f"c{i}", "c_nationkey": i % 3, "c_acctbal": b, "c_mktsegment": "AUTO"} for i, b in enumerate((-0.0, -0.0, 0.0, -0.01, 0.01, 99.99, -250.0, 7123.45, 4000.0, 7000.0, -0.0, 123.0), 1)],
    }
    duck = duckdb.connect()
    duck.execute("set timezone = 'UTC'")
    for name, rows in tables.items():
        t = pa.Table.from_pylist(rows)
        t = t.set_column(t.schema.get_field_index("s_nationkey"), "s_nationkey", t["s_nationkey"].cast(pa.int32())) if name == "supplier" else t
        pq.write_table(t, at / f"{name}.parquet", coerce_timestamps="us")
        duck.execute(f"create view {name} as select * from '{at}/{name}.parquet'")
    return str(at), duck


@pytest.mark.parametrize("name", [
    "zigzag", "double_top_bottom", "head_shoulders", "pattern_combined", "autotrend", "wedge", "final_score", "ichimoku", "rube_triggers", "display_format", "html_scores", "page_rewrite",
])
def test_same_as_duckdb(spark, odd, name):
    sf, duck = odd
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    got = sorted(tuple(map(_text, r)) for r in df.select(*cols).collect())
    exp = sorted(tuple(map(_text, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert len(got) > 0 and got == exp
