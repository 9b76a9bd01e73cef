"""Queries of cleaning, store upkeep, registry, ranking, options and fundamentals."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import options as O
from barwright.operators import quality as Q
from barwright.operators import registry as G
from barwright.operators import store as S
from barwright.plans import sql
from barwright.sources import bars as B

QUERIES, ORACLES = {}, {}
R = F.round
N = f"WITH {sql.NATION}"
MOVES = f"{N}, mv AS (SELECT *, round(close / nullif(lag(close) OVER ({sql.W}), 0) - 1, 10) AS move FROM bars)"


def query(oracle=None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _bars(spark, sf_dir):
    return B.daily_by_nation(spark, sf_dir)


@query(f"{MOVES} SELECT sym, bar_ts, round(move, 6) AS move, round(CASE WHEN move < 0 THEN 1 / nullif(1 + move, 0) ELSE 1 + move END, 4) AS ratio FROM mv WHERE abs(move) > 0.3")
def split_detect(spark, sf_dir):
    return Q.detect_splits(_bars(spark, sf_dir))


@query(f"""WITH {sql.HOURLY}, mv AS (SELECT *, round(close / nullif(lag(close) OVER ({sql.W}), 0) - 1, 10) AS move FROM bars),
    r AS (SELECT *, CASE WHEN move < -0.3 THEN round(1 / nullif(1 + move, 0), 4) END AS ratio FROM mv),
    f AS (SELECT *, coalesce(list_reduce(list_prepend(1.0::DOUBLE, coalesce(list(ratio) FILTER (ratio IS NOT NULL) OVER ({sql.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), [])), lambda acc, x: acc * x), 1) AS factor FROM r)
    SELECT sym, bar_ts, round(log10(factor), 6) AS magnitude, round(log10(close * factor), 6) AS log_close FROM f WHERE close > 0""")
def split_adjust(spark, sf_dir):
    """Factors compound over hundreds of noisy falls, so that logarithms are compared."""
    a = Q.adjust_splits(B.hourly(spark, sf_dir)).filter("close > 0")
    return a.select("sym", "bar_ts", R(F.log10("factor"), 6).alias("magnitude"), R(F.log10("close"), 6).alias("log_close"))


@query(f"{MOVES}, s AS (SELECT sym, bar_ts, CASE WHEN move < 0 THEN 1.7::DOUBLE ELSE 0.7::DOUBLE END AS ratio FROM mv WHERE abs(move) > 20) SELECT b.sym, b.bar_ts, round(b.close * coalesce((SELECT list_reduce(list_prepend(1.0::DOUBLE, list(ratio ORDER BY s.bar_ts)), lambda acc, x: acc * x) FROM s WHERE s.sym = b.sym AND s.bar_ts > b.bar_ts), 1), 9) AS close FROM bars b")
def split_apply(spark, sf_dir):
    """Known splits: by 1.7 or 0.7 at moves of more than twentyfold."""
    bars = _bars(spark, sf_dir)
    known = Q.detect_splits(bars, 20.0).select("sym", "bar_ts", F.when(F.col("move") < 0, 1.7).otherwise(0.7).alias("ratio"))
    return Q.apply_splits(bars, known).select("sym", "bar_ts", R("close", 9).alias("close"))


@query(f"{MOVES} SELECT sym, round(max(abs(move)), 6) AS largest, coalesce(max(abs(move)) <= 0.1, true) AS smooth FROM mv GROUP BY 1")
def max_jump(spark, sf_dir):
    return Q.largest_move(_bars(spark, sf_dir)).select("sym", R("largest", 6).alias("largest"), "smooth")


def _out(col):
    return f"""s_{col} AS (SELECT sym, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3, quantile_cont({col}, 0.5) AS med, count({col}) AS n FROM bars GROUP BY 1),
    m_{col} AS (SELECT b.sym, quantile_cont(abs(b.{col} - s.med), 0.5) AS mad FROM bars b JOIN s_{col} s USING (sym) GROUP BY 1),
    o_{col} AS (SELECT b.sym, b.bar_ts, b.{col} AS x, coalesce(s.n >= 4 AND (b.{col} < round(s.q1 - 1.5 * (s.q3 - s.q1), 8) OR b.{col} > round(s.q3 + 1.5 * (s.q3 - s.q1), 8)), false) AS iqr,
      coalesce(mad > 0 AND round(abs(b.{col} - s.med), 8) > round(3.0 * 1.4826 * mad, 8), false) AS mad FROM bars b JOIN s_{col} s USING (sym) JOIN m_{col} USING (sym))"""


@query(f"{N}, {_out('close')} SELECT sym, bar_ts, round(x, 8) AS x, iqr FROM o_close WHERE iqr")
def outliers_iqr(spark, sf_dir):
    return Q.outliers(_bars(spark, sf_dir)).filter("iqr").select("sym", "bar_ts", R("x", 8).alias("x"), "iqr")


@query(f"{N}, {_out('close')} SELECT sym, bar_ts, round(x, 8) AS x, mad FROM o_close WHERE mad")
def outliers_mad(spark, sf_dir):
    return Q.outliers(_bars(spark, sf_dir)).filter("mad").select("sym", "bar_ts", R("x", 8).alias("x"), "mad")


_COLS = ("open", "high", "low", "close", "volume")


@query(f"{N}, {', '.join(map(_out, _COLS))} " + " UNION ALL ".join(f"SELECT sym, '{c}' AS field, count(*) FILTER (iqr) AS n_iqr, count(*) FILTER (mad) AS n_mad, count(*) FILTER (iqr AND mad) AS n_both, count(*) FILTER (iqr OR mad) AS n_any FROM o_{c} GROUP BY 1" for c in _COLS))
def outlier_report(spark, sf_dir):
    return Q.outlier_report(_bars(spark, sf_dir))


_Q = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in _COLS)


@query(f"{N}, q AS (SELECT sym, {_Q} FROM bars GROUP BY 1) SELECT b.sym, b.bar_ts, " + ", ".join(f"round(greatest(least(b.{c}, q.{c}_hi), q.{c}_lo), 8) AS {c}" for c in ("close", "volume")) + " FROM bars b JOIN q USING (sym)")
def winsorize(spark, sf_dir):
    return Q.winsorized(_bars(spark, sf_dir)).select("sym", "bar_ts", *[R(c, 8).alias(c) for c in ("close", "volume")])


_V = "f AS (SELECT *, CASE WHEN bar_ts < TIMESTAMP '2024-01-02' AND sym = 'click' THEN NULL ELSE close END AS c2, CASE WHEN sym = 'view' AND bar_ts < TIMESTAMP '2024-01-01 03:00:00' THEN -low ELSE low END AS l2 FROM bars)"


@query(f"WITH {sql.HOURLY}, {_V}, g AS (SELECT sym, count(*) FILTER (open < 0) AS a, count(*) FILTER (high < 0) AS b, count(*) FILTER (l2 < 0) AS c, count(*) FILTER (c2 < 0) AS d, count(*) FILTER (c2 IS NULL) AS e FROM f GROUP BY 1) SELECT sym, concat_ws('; ', CASE WHEN a > 0 THEN 'open: negative ' || a END, CASE WHEN b > 0 THEN 'high: negative ' || b END, CASE WHEN c > 0 THEN 'low: negative ' || c END, CASE WHEN d > 0 THEN 'close: negative ' || d END, CASE WHEN e > 0 THEN 'close: missing ' || e END) AS issues, a + b + c + d + e = 0 AS passed FROM g")
def validate_ohlcv(spark, sf_dir):
    """Bars of which some have been spoilt."""
    b = B.hourly(spark, sf_dir)
    b = b.withColumns({"close": F.when((F.col("bar_ts") < F.lit("2024-01-02").cast("timestamp")) & (F.col("sym") == "click"), None).otherwise(F.col("close")),
                       "low": F.when((F.col("sym") == "view") & (F.col("bar_ts") < F.lit("2024-01-01 03:00:00").cast("timestamp")), -F.col("low")).otherwise(F.col("low"))})
    return Q.validate(b).select("sym", F.array_join("issues", "; ").alias("issues"), "passed")


@query(f"""{MOVES}, r AS (SELECT *, CASE WHEN move < -0.3 THEN round(1 / nullif(1 + move, 0), 4) ELSE 1 END AS ratio FROM mv),
    j AS (SELECT sym, max(abs(round((1 + move) * ratio - 1, 8))) AS largest FROM r GROUP BY 1) SELECT sym, true AS passed, '' AS reason, coalesce(largest <= 0.1, true) AS smooth FROM j""")
def clean_ohlcv(spark, sf_dir):
    return Q.clean(_bars(spark, sf_dir))[1].select("sym", "passed", "reason", "smooth")


ATR = f"a AS (SELECT sym, bar_ts, idx, n, close, CASE WHEN idx >= 13 THEN atr14 END AS atr FROM k3)"


@query(f"WITH {sql.HOURLY}, {sql.KERNELS}, {ATR} SELECT sym, round(CASE WHEN idx >= 14 THEN atr END, 6) AS atr, round(coalesce(CASE WHEN idx >= 14 AND atr > 0 AND close > 0 THEN least(0.01 / atr * close, 0.25) END, 0)::DOUBLE, 6) AS position FROM a WHERE idx = n - 1")
def atr_position_size(spark, sf_dir):
    return Q.position_sizes(B.hourly(spark, sf_dir)).select("sym", R("atr", 6).alias("atr"), R("position", 6).alias("position"))


@query(f"WITH {sql.HOURLY}, {sql.KERNELS}, {ATR}, m AS (SELECT sym, min(atr) AS lo, max(atr) AS hi FROM a GROUP BY 1) SELECT sym, bar_ts, round(CASE WHEN hi - lo < 1e-10 THEN 0 ELSE (atr - lo) / (hi - lo) END, 6) AS atr_scaled FROM a JOIN m USING (sym)")
def atr_normalized(spark, sf_dir):
    return Q.normalized_atr(B.hourly(spark, sf_dir)).select("sym", "bar_ts", R("atr_scaled", 6).alias("atr_scaled"))


# ---- store ------------------------------------------------------------------------------------------


def _halves(spark, sf_dir):
    """Stored bars up to 1998 and a delivery from mid 1997, its closes half of what is stored for even symbols."""
    b = _bars(spark, sf_dir)
    stored = b.filter(F.col("bar_ts") < F.lit("1998-01-01").cast("timestamp"))
    late = b.filter(F.col("bar_ts") >= F.lit("1997-07-01").cast("timestamp"))
    return stored, late.withColumn("close", F.when(F.col("sym").cast("int") % 2 == 0, F.col("close") / 2).otherwise(F.col("close")))


HALVES = f"{N}, st AS (SELECT * FROM bars WHERE bar_ts < TIMESTAMP '1998-01-01'), fe AS (SELECT * REPLACE (CASE WHEN sym::INT % 2 = 0 THEN close / 2 ELSE close END AS close) FROM bars WHERE bar_ts >= TIMESTAMP '1997-07-01')"
_TRIM = "SELECT sym, bar_ts, round(close, 8) AS close FROM (SELECT *, max(bar_ts) OVER (PARTITION BY sym) AS last_ FROM m) WHERE bar_ts::DATE >= last_::DATE - 730"


@query(f"{HALVES}, m AS (SELECT * FROM st UNION ALL SELECT * FROM fe WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.sym = fe.sym AND st.bar_ts = fe.bar_ts)) {_TRIM}")
def upsert_antijoin(spark, sf_dir):
    return S.upsert(*_halves(spark, sf_dir)).select("sym", "bar_ts", R("close", 8).alias("close"))


@query(f"{HALVES}, m AS (SELECT * FROM fe UNION ALL SELECT * FROM st WHERE sym NOT IN (SELECT sym FROM fe)) {_TRIM}")
def upsert_replace(spark, sf_dir):
    return S.upsert(*_halves(spark, sf_dir), replace=True).select("sym", "bar_ts", R("close", 8).alias("close"))


@query(f"{HALVES}, l AS (SELECT sym, max(bar_ts) AS bar_ts, arg_max(close, bar_ts) AS sc FROM st GROUP BY 1) SELECT l.sym, l.bar_ts, round(sc, 8) AS stored_close, round(fe.close, 8) AS fetched_close, coalesce(abs(fe.close - sc) / abs(nullif(sc, 0)) > 0.3, false) AS broken FROM l JOIN fe USING (sym, bar_ts)")
def split_break(spark, sf_dir):
    return S.breaks(*_halves(spark, sf_dir)).select("sym", "bar_ts", R("stored_close", 8).alias("stored_close"), R("fetched_close", 8).alias("fetched_close"), "broken")


@query(f"{N}, m AS (SELECT * FROM bars) {_TRIM}")
def trim_730(spark, sf_dir):
    return S.trimmed(_bars(spark, sf_dir)).select("sym", "bar_ts", R("close", 8).alias("close"))


@query(f"""{N}, z AS (SELECT b.*, CASE WHEN n_regionkey = 0 THEN 'Asia/Tokyo' WHEN n_regionkey = 1 THEN 'America/New_York' ELSE 'UTC' END AS tz FROM bars b JOIN nation ON n_nationkey = sym::INT),
    l AS (SELECT *, (TIMESTAMPTZ '1998-06-15 20:30:00+00' AT TIME ZONE tz) AS loc FROM z) SELECT sym, bar_ts, round(close, 8) AS close FROM l WHERE NOT (extract(hour FROM loc) < 19 AND bar_ts::DATE = loc::DATE)""")
def session_strip(spark, sf_dir):
    zones = spark.createDataFrame([("0", "Asia/Tokyo"), ("1", "America/New_York")], "region string, timezone string")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("sym"), F.col("n_regionkey").cast("string").alias("region"))
    b = _bars(spark, sf_dir).join(nation, "sym")
    return S.settled(b, zones, F.lit("1998-06-15 20:30:00").cast("timestamp")).select("sym", "bar_ts", R("close", 8).alias("close"))


@query(f"""{N}, t AS (SELECT max(bar_ts)::DATE AS today FROM bars), l AS (SELECT sym, max(bar_ts)::DATE AS last_day FROM bars WHERE sym::INT % 5 <> 0 AND bar_ts < TIMESTAMP '1998-07-01' + INTERVAL 1 DAY * (sym::INT * 4) GROUP BY 1),
    m AS (SELECT CAST(n_nationkey AS VARCHAR) AS sym FROM nation), j AS (SELECT m.sym, last_day, datediff('day', last_day, DATE '1998-10-01') AS age FROM m LEFT JOIN l USING (sym))
    SELECT sym, last_day, CASE WHEN last_day IS NULL OR age > 28 THEN 'backfill' ELSE 'delta' END AS period, CASE WHEN last_day IS NULL THEN 'missing' WHEN age > 28 THEN 'stale ' || age || 'd' ELSE '' END AS note FROM j""")
def staleness(spark, sf_dir):
    """Stores that end on different days."""
    b = _bars(spark, sf_dir).filter((F.col("sym").cast("int") % 5 != 0) & (F.to_date("bar_ts") < F.date_add(F.lit("1998-07-01").cast("date"), F.col("sym").cast("int") * 4)))
    members = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("sym"))
    return S.staleness(members, b, F.lit("1998-10-01").cast("date"))


def _members(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("sym"), (F.col("c_custkey") % 2 == 0).alias("has_row"), (F.col("c_custkey") % 3 != 0).alias("fetched"), (F.col("c_custkey") % 5 != 0).alias("usable"), F.col("c_mktsegment").alias("region"), "c_acctbal", "c_nationkey")


CLASS = "CASE WHEN c_custkey % 2 = 0 THEN 'scored' WHEN c_custkey % 3 = 0 THEN 'not_fetched' WHEN c_custkey % 5 = 0 THEN 'dead' ELSE 'insufficient' END"


@query(f"SELECT {CLASS} AS class, count(*) AS n FROM customer GROUP BY 1")
def partition(spark, sf_dir):
    return S.accounting(_members(spark, sf_dir)).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS sym, {CLASS} AS class FROM customer), nf AS (SELECT sym FROM c WHERE class = 'not_fetched' ORDER BY sym LIMIT 10)
    SELECT 'not closed: ' || (SELECT count(*) FROM c) || ' of 10|not fetched: ' || (SELECT count(*) FROM c WHERE class = 'not_fetched') || ': ' || (SELECT string_agg(sym, ', ' ORDER BY sym) FROM nf) AS reasons""")
def partition_reasons(spark, sf_dir):
    return S.partition_reasons(S.accounting(_members(spark, sf_dir)), 10).select(F.array_join("reasons", "|").alias("reasons"))


@query("""WITH m AS (SELECT c_mktsegment AS region, count(*) AS members, count(*) FILTER (c_acctbal > 4500) AS rows_ FROM customer GROUP BY 1)
    SELECT region, members, rows_ AS "rows", (members + 1) // 2 AS least, rows_ >= (members + 1) // 2 AS enough FROM m UNION ALL
    SELECT '(all)', sum(members)::BIGINT, sum(rows_)::BIGINT, greatest(500, ((sum(members) * 2 + 4) // 5)::BIGINT), sum(rows_) >= greatest(500, (sum(members) * 2 + 4) // 5) FROM m""")
def coverage_floor(spark, sf_dir):
    m = _members(spark, sf_dir)
    return S.coverage(m.filter("c_acctbal > 4500"), m, floor=500)


@query("""WITH a AS (SELECT c_mktsegment AS region, count(DISTINCT c_custkey) AS before FROM customer WHERE c_nationkey < 10 GROUP BY 1), b AS (SELECT c_mktsegment AS region, count(DISTINCT c_custkey) AS after FROM customer WHERE c_nationkey < length(c_mktsegment) + 2 AND c_mktsegment <> 'BUILDING' GROUP BY 1),
    j AS (SELECT region, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM a FULL JOIN b USING (region))
    SELECT *, CASE WHEN after = 0 AND before > 0 THEN 'vanished' WHEN after < 0.8 * before THEN 'shrunk' WHEN before > 0 AND after > 1.5 * before THEN 'grown' END AS reason FROM j""")
def refresh_guard(spark, sf_dir):
    m = _members(spark, sf_dir)
    return S.refresh_guard(m.filter("c_nationkey < 10"), m.filter("c_nationkey < length(region) + 2 and region <> 'BUILDING'"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS sym, CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS first_seen, DATE '2024-02-01' AS last_seen, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 1 ELSE 1 END AS nights, 'dead' AS reason
    FROM customer WHERE c_custkey % 3 = 0""")
def exclusions(spark, sf_dir):
    m = _members(spark, sf_dir)
    state = m.filter("cast(sym as long) % 2 = 0").select("sym", F.lit("2024-01-01").cast("date").alias("first_seen"), F.lit("2024-01-01").cast("date").alias("last_seen"), F.col("c_nationkey").alias("nights"), F.lit("x").alias("reason"))
    return S.exclusions(state, m.filter("cast(sym as long) % 3 = 0").select("sym", F.lit("dead").alias("reason")), F.lit("2024-02-01").cast("date"))


@query(f"""{N}, b AS (SELECT sym, count(*) AS bars FROM bars GROUP BY 1), m AS (SELECT CAST(n_nationkey AS VARCHAR) AS sym FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 'X1'), s AS (SELECT CAST(n_nationkey AS VARCHAR) AS sym FROM nation WHERE n_nationkey % 2 = 0)
    SELECT sym, CASE WHEN sym IN (SELECT sym FROM s) THEN 'scored' WHEN bars IS NULL THEN 'not_fetched' WHEN bars < 1000 THEN 'insufficient' ELSE 'dead' END AS class, sym IN (SELECT sym FROM m) AS in_registry FROM (SELECT coalesce(b.sym, m.sym) AS sym, bars FROM b FULL JOIN m ON b.sym = m.sym) j""")
def store_classes(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("sym"), "n_nationkey")
    members = n.filter("n_nationkey % 3 <> 0").select("sym").unionAll(spark.createDataFrame([("X1",)], "sym string"))
    return S.class_of_store(_bars(spark, sf_dir), members, n.filter("n_nationkey % 2 = 0").select("sym"), least=1000)


# ---- registry ---------------------------------------------------------------------------------------


def _scores(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_custkey").cast("string").alias("sym"), F.col("c_mktsegment").alias("region"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 4 != 0).alias("passed"))


SC = "s AS (SELECT CAST(c_custkey AS VARCHAR) AS sym, c_mktsegment AS region, c_acctbal AS score, c_custkey % 4 <> 0 AS passed FROM customer)"


@query(f"WITH {SC} SELECT * FROM (SELECT sym, region, score, row_number() OVER (PARTITION BY region ORDER BY score DESC, sym) AS rank FROM s WHERE passed) WHERE rank <= 20")
def rank_regions(spark, sf_dir):
    return G.rank_regions(_scores(spark, sf_dir)).select("sym", "region", "score", "rank")


@query(f"WITH {SC} SELECT sym, score FROM s ORDER BY score DESC, sym LIMIT 10")
def top_overall(spark, sf_dir):
    return G.top_overall(_scores(spark, sf_dir)).select("sym", "score")


@query(f"WITH {SC}, t AS (SELECT sym FROM s ORDER BY score DESC, sym LIMIT 500) SELECT s.sym, s.region, score + 1 AS score FROM s WHERE sym IN (SELECT sym FROM t) UNION ALL SELECT s.sym, s.region, score FROM s WHERE sym NOT IN (SELECT sym FROM t)")
def top500_semi(spark, sf_dir):
    """A second pass over the best 500 only; its rows replace those of the first."""
    s = _scores(spark, sf_dir)
    second = s.join(G.top_overall(s, 500).select("sym"), "sym", "left_semi").select("sym", (F.col("score") + 1).alias("again"))
    return s.join(second, "sym", "left").select("sym", "region", F.coalesce("again", "score").alias("score"))


@query("""WITH m AS (SELECT c_mktsegment AS region, CAST(c_custkey AS VARCHAR) AS sym FROM customer), z AS (SELECT region, count(*) AS n, sum(count(*)) OVER () AS live FROM m GROUP BY 1),
    q AS (SELECT region, n, greatest(1, round_even(100.0 * n / live, 0)::INT) AS quota FROM z), tot AS (SELECT sum(quota) - 100 AS over_ FROM q),
    q2 AS (SELECT region, n, quota - CASE WHEN row_number() OVER (ORDER BY quota DESC, region DESC) <= (SELECT over_ FROM tot) THEN 1 ELSE 0 END AS quota FROM q),
    r AS (SELECT m.region, sym, row_number() OVER (PARTITION BY m.region ORDER BY sym) - 1 AS rn, quota, greatest(1, n // quota) AS stride FROM m JOIN q2 USING (region)) SELECT region, sym FROM r WHERE rn % stride = 0 AND rn // stride < quota""")
def stratified_sample(spark, sf_dir):
    return G.stratified_sample(_scores(spark, sf_dir).select("region", "sym"), 100)


@query("""WITH b AS (SELECT CAST(o_custkey AS VARCHAR) AS name, CASE WHEN count(*) < 9 THEN 'thin' WHEN count(*) < 14 THEN 'mid' ELSE 'tall' END AS class FROM orders GROUP BY 1),
    r AS (SELECT name, class, row_number() OVER (PARTITION BY class ORDER BY sha256('seed7' || chr(31) || name), name) AS rank FROM b) SELECT * FROM r WHERE rank <= CASE class WHEN 'thin' THEN 20 WHEN 'mid' THEN 30 ELSE 10 END""")
def hash_sample(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    items = o.select("name", F.when(F.col("n") < 9, "thin").when(F.col("n") < 14, "mid").otherwise("tall").alias("class"))
    return G.hash_sample(items, {"thin": 20, "mid": 30, "tall": 10}, "seed7")


def _listing(spark, sf_dir):
    """Symbols that several regions list: an order's customer under its priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    region = F.when(F.col("o_orderpriority").startswith("1"), "international").otherwise(F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")))
    return o.select(region.alias("region"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("sym"))


LISTING = "l AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'international' ELSE lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) END AS region, CAST(o_custkey AS VARCHAR) AS sym FROM orders)"
PRIMARY = f"{LISTING}, p AS (SELECT sym, coalesce(arg_min(region, (CASE region WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, region)) FILTER (region <> 'international'), 'unchecked') AS region FROM l GROUP BY 1)"


@query(f"WITH {PRIMARY} SELECT sym, region FROM p")
def primary_region(spark, sf_dir):
    return G.primary_regions(_listing(spark, sf_dir), ["low", "medium"])


@query(f"WITH {PRIMARY}, c AS (SELECT region, count(*) AS members FROM p GROUP BY 1) SELECT region, members, row_number() OVER (ORDER BY CASE region WHEN 'high' THEN 0 ELSE 1 END, members DESC, region)::INT AS tab FROM c")
def tab_order(spark, sf_dir):
    return G.tab_order(G.primary_regions(_listing(spark, sf_dir), ["low", "medium"]), ["high"]).select("region", "members", "tab")


@query("WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS sym FROM customer UNION ALL SELECT DISTINCT p_brand FROM part), k AS (SELECT sym, row_number() OVER (ORDER BY regexp_full_match(sym, '[0-9]+'), sym) - 1 AS rn, ceil(count(*) OVER () / 50.0)::BIGINT AS n FROM r) SELECT sym, (rn % n)::INT AS batch FROM k")
def batches(spark, sf_dir):
    syms = _scores(spark, sf_dir).select("sym").unionAll(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand")).distinct())
    return G.batches(syms)


@query("""WITH s AS (SELECT n_name || CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.ST' WHEN 2 THEN '.B' ELSE '.XX' END AS sym, CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN '.ST' ELSE '.DE' END AS suf FROM nation)
    SELECT sym, CASE WHEN suf IS NULL THEN sym WHEN sym LIKE '%' || suf THEN sym WHEN contains(sym, '.') AND NOT regexp_matches(sym, '\\.([A-Z]|UN)$') THEN regexp_replace(sym, '\\.[^.]*$', '') || suf ELSE sym || suf END AS resolved FROM s""")
def region_suffix(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    tail = F.when(F.col("n_nationkey") % 4 == 0, "").when(F.col("n_nationkey") % 4 == 1, ".ST").when(F.col("n_nationkey") % 4 == 2, ".B").otherwise(".XX")
    suffixes = F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>")).when(F.col("n_regionkey") == 1, F.array(F.lit(".ST"))).otherwise(F.array(F.lit(".DE")))
    return n.select(F.concat("n_name", tail).alias("sym"), suffixes.alias("s")).select("sym", G.with_suffix(F.col("sym"), F.col("s")).alias("resolved"))


@query("SELECT sym, regexp_replace(sym, '^([A-Z]{1,5})/([A-Z])$', '\\1-\\2') AS request, translate(sym, '.-/', '___') AS stem FROM (SELECT upper(left(n_name, 4)) || '/' || chr(65 + n_nationkey::INT) AS sym FROM nation UNION ALL SELECT n_name || '/' || 'AB' FROM nation)")
def class_shares(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    syms = n.select(F.concat(F.upper(F.substring("n_name", 1, 4)), F.lit("/"), F.chr((65 + F.col("n_nationkey")).cast("long"))).alias("sym")).unionAll(n.select(F.concat("n_name", F.lit("/AB"))))
    return syms.select("sym", G.request_symbol(F.col("sym")).alias("request"), B.escaped(F.col("sym")).alias("stem"))


@query("""WITH m AS (SELECT c_mktsegment AS region, CASE c_nationkey % 3 WHEN 0 THEN 'listing' WHEN 1 THEN 'scraped' ELSE 'fallback' END AS source, CAST(c_custkey AS VARCHAR) AS sym FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 0)),
    g AS (SELECT region, source, count(DISTINCT sym) AS n, CASE source WHEN 'listing' THEN 0 WHEN 'scraped' THEN 1 ELSE 2 END AS rk, CASE source WHEN 'listing' THEN 5 WHEN 'scraped' THEN 20 ELSE 1 END AS need FROM m GROUP BY ALL), b AS (SELECT region, arg_min(source, rk) AS source FROM g WHERE n >= need GROUP BY 1)
    SELECT DISTINCT region, source, sym FROM m JOIN b USING (region, source)""")
def source_precedence(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("not (c_mktsegment = 'BUILDING' and c_nationkey % 3 = 0)")
    source = F.when(F.col("c_nationkey") % 3 == 0, "listing").when(F.col("c_nationkey") % 3 == 1, "scraped").otherwise("fallback")
    return G.with_source_precedence(c.select(F.col("c_mktsegment").alias("region"), source.alias("source"), F.col("c_custkey").cast("string").alias("sym")), [("listing", 5), ("scraped", 20), ("fallback", 1)])


@query(f"WITH {LISTING} SELECT (SELECT count(*) FROM (SELECT DISTINCT sym FROM l)) AS in_all, (SELECT count(*) FROM (SELECT sym FROM l WHERE region = 'international' EXCEPT SELECT sym FROM l WHERE region <> 'international')) AS only_international, (SELECT count(*) FROM (SELECT sym FROM l WHERE region = 'low' INTERSECT SELECT sym FROM l WHERE region = 'urgent' UNION SELECT sym FROM l WHERE region = 'high' INTERSECT SELECT sym FROM l WHERE region = 'medium')) AS in_both")
def set_operations(spark, sf_dir):
    rows = _listing(spark, sf_dir)
    of = {r: rows.filter(F.col("region") == r).select("sym") for r in ("international", "low", "urgent", "high", "medium")}
    only = of["international"].subtract(rows.filter("region <> 'international'").select("sym")).agg(F.count(F.lit(1)).alias("only_international"))
    both = of["low"].intersect(of["urgent"]).union(of["high"].intersect(of["medium"])).distinct().agg(F.count(F.lit(1)).alias("in_both"))
    return rows.select("sym").distinct().agg(F.count(F.lit(1)).alias("in_all")).crossJoin(only).crossJoin(both)


# ---- options and fundamentals ---------------------------------------------------------------------


def _chain(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    side = F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put")
    return p.select(F.col("p_brand").alias("sym"), side.alias("side"), F.col("p_size").cast("double").alias("strike"), F.floor("p_retailprice").cast("double").alias("oi"), (F.col("p_partkey") % 97).cast("double").alias("volume"))


def _spots(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("sym")).agg((F.avg("p_size") + 3).alias("price"))


CHAIN = """ch AS (SELECT p_brand AS sym, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS side, p_size::DOUBLE AS strike, floor(p_retailprice)::DOUBLE AS oi, (p_partkey % 97)::DOUBLE AS volume FROM part),
    sp AS (SELECT p_brand AS sym, avg(p_size) + 3 AS price FROM part GROUP BY 1),
    bs AS (SELECT sym, strike, coalesce(arg_max(oi, (volume, oi)) FILTER (side = 'call'), 0) AS co, coalesce(arg_max(oi, (volume, oi)) FILTER (side = 'put'), 0) AS po FROM ch GROUP BY ALL)"""


@query(f"""WITH {CHAIN}, pain AS (SELECT k.sym, k.strike, round(sum(greatest(0, k.strike - o.strike) * o.co + greatest(0, o.strike - k.strike) * o.po), 4) AS pain FROM bs k JOIN bs o ON o.sym = k.sym JOIN sp ON sp.sym = k.sym WHERE k.strike BETWEEN 0.1 * price AND 3 * price GROUP BY ALL),
    b AS (SELECT sym, arg_min(strike, (pain, strike)) AS mp FROM pain GROUP BY 1) SELECT sp.sym, round(coalesce(mp, price), 6) AS max_pain FROM sp LEFT JOIN b USING (sym)""")
def max_pain(spark, sf_dir):
    return O.max_pain(_chain(spark, sf_dir), _spots(spark, sf_dir)).select("sym", R("max_pain", 6).alias("max_pain"))


@query(f"""WITH {CHAIN}, g AS (SELECT bs.sym, strike, (co - po) * exp(-0.5 * pow(abs(strike - price) / price * 10, 2)) AS net FROM bs JOIN sp USING (sym) WHERE strike BETWEEN 0.1 * price AND 3 * price),
    r AS (SELECT *, round(sum(net) OVER (PARTITION BY sym ORDER BY strike), 6) AS run FROM g), t AS (SELECT *, round(run + net, 6) AS again FROM r)
    SELECT sym, round(sum(net), 4) AS net_gamma, coalesce(min(strike) FILTER ((run > 0 AND again <= 0) OR (run < 0 AND again >= 0)), 0) AS flip FROM t GROUP BY 1""")
def gamma_exposure(spark, sf_dir):
    return O.gamma_exposure(_chain(spark, sf_dir), _spots(spark, sf_dir)).select("sym", R("net_gamma", 4).alias("net_gamma"), "flip")


@query(f"WITH {CHAIN} SELECT sym, round(coalesce(sum(volume) FILTER (side = 'put') / nullif(sum(volume) FILTER (side = 'call'), 0), 0), 6) AS put_call FROM ch GROUP BY 1")
def put_call(spark, sf_dir):
    return O.put_call(_chain(spark, sf_dir)).select("sym", R("put_call", 6).alias("put_call"))


@query(f"""WITH {CHAIN}, pain AS (SELECT k.sym, k.strike, round(sum(greatest(0, k.strike - o.strike) * o.co + greatest(0, o.strike - k.strike) * o.po), 4) AS pain FROM bs k JOIN bs o ON o.sym = k.sym JOIN sp ON sp.sym = k.sym WHERE k.strike BETWEEN 0.1 * price AND 3 * price GROUP BY ALL),
    b AS (SELECT sym, arg_min(strike, (pain, strike)) AS mp FROM pain GROUP BY 1), g AS (SELECT bs.sym, strike, (co - po) * exp(-0.5 * pow(abs(strike - price) / price * 10, 2)) AS net FROM bs JOIN sp USING (sym) WHERE strike BETWEEN 0.1 * price AND 3 * price),
    r AS (SELECT *, round(sum(net) OVER (PARTITION BY sym ORDER BY strike), 6) AS run FROM g), t AS (SELECT *, round(run + net, 6) AS again FROM r),
    ga AS (SELECT sym, sum(net) AS ng, min(strike) FILTER ((run > 0 AND again <= 0) OR (run < 0 AND again >= 0)) AS flip FROM t GROUP BY 1),
    pc AS (SELECT sym, coalesce(sum(volume) FILTER (side = 'put') / nullif(sum(volume) FILTER (side = 'call'), 0), 0) AS pc FROM ch GROUP BY 1),
    j AS (SELECT sp.sym, price, coalesce(mp, price) AS mp, coalesce(ng, 0) AS ng, flip, pc FROM sp LEFT JOIN b USING (sym) LEFT JOIN ga USING (sym) LEFT JOIN pc USING (sym)), o AS (SELECT *, abs(price - mp) / price * 100 AS off_ FROM j)
    SELECT sym, round(greatest(-1.0, least(1.0, (mp - price) / price * least(off_ / 10, 1.0) * 0.4 + sign(ng) * 0.05 * 0.35 + CASE WHEN pc > 0 THEN (1 - pc) * 0.15 * 0.25 ELSE 0 END))::DOUBLE, 4) AS bias,
      round((CASE WHEN off_ > 0 THEN 0.1 ELSE 0 END + CASE WHEN ng <> 0 THEN 0.1 ELSE 0 END + CASE WHEN pc > 0 THEN 0.1 ELSE 0 END + 0.2)::DOUBLE, 4) AS confidence, round(off_, 4) AS off_max_pain, flip FROM o""")
def options_bias(spark, sf_dir):
    b = O.bias(_chain(spark, sf_dir), _spots(spark, sf_dir), F.lit(5))
    return b.select("sym", R("bias", 4).alias("bias"), R("confidence", 4).alias("confidence"), R("off_max_pain", 4).alias("off_max_pain"), "flip")


@query("""WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS sym, CAST(o_orderdate AS DATE) AS expiration FROM orders), t AS (SELECT *, datediff('day', DATE '1998-01-01', expiration) AS d FROM e),
    g AS (SELECT sym, coalesce(min(expiration) FILTER (d > 0 AND d <= 30 AND dayofweek(expiration) = 5), min(expiration)) AS expiration FROM t GROUP BY 1) SELECT sym, expiration, greatest(0, datediff('day', DATE '1998-01-01', expiration))::INT AS days FROM g""")
def nearest_weekly(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("sym"), F.to_date("o_orderdate").alias("expiration"))
    return O.nearest_weekly(e, F.lit("1998-01-01").cast("date"))


def _bands_sql():
    points, weights = [], []
    for f, (w, low, bounds, pts, valid) in O.BANDS.items():
        cond = f"{f} IS NOT NULL" + ("" if valid == "any" else f" AND {f} {valid}")
        cases = " ".join(f"WHEN {f} {'<' if low else '>'} {b} THEN {p}" for b, p in zip(bounds, pts, strict=False))
        points.append(f"CASE WHEN {cond} THEN CASE {cases} ELSE {pts[-1]} END ELSE 0 END")
        weights.append(f"CASE WHEN {cond} THEN {w} ELSE 0 END")
    return " + ".join(points), " + ".join(weights)


_P, _WT = _bands_sql()
FUND = "CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS pe, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 0.7::DOUBLE END AS roe, (p_partkey % 31) / 100.0::DOUBLE AS growth, (p_partkey % 29) / 100.0::DOUBLE AS margin, (p_partkey % 13) / 10.0::DOUBLE AS debt, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 17) / 10.0::DOUBLE END AS peg"


@query(f"""WITH f AS (SELECT p_partkey, {FUND} FROM part), s AS (SELECT p_partkey, round((({_P}) / nullif({_WT}, 0))::DOUBLE, 6) AS score FROM f)
    SELECT p_partkey, coalesce(score, 0) AS score, CASE WHEN score >= 0.7 THEN 'STRONG' WHEN score >= 0.5 THEN 'GOOD' WHEN score >= 0.3 THEN 'FAIR' ELSE 'WEAK' END AS label FROM s""")
def fundamentals_score(spark, sf_dir):
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", F.when(k % 7 != 0, F.col("p_size").cast("double")).alias("pe"), F.when(k % 5 != 0, F.col("p_size") * 0.7).alias("roe"), ((k % 31) / 100.0).alias("growth"), ((k % 29) / 100.0).alias("margin"), ((k % 13) / 10.0).alias("debt"), F.when(k % 3 != 0, (k % 17) / 10.0).alias("peg"))
    return O.fundamentals(p).select("p_partkey", "score", "label")


@query("""WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS sym, (c_custkey % 100) / 100.0::DOUBLE AS s, (c_custkey % 41)::DOUBLE AS si, (c_custkey % 11)::DOUBLE AS sr, abs(c_acctbal) AS v, (c_nationkey * 100)::DOUBLE AS av FROM customer),
    y AS (SELECT *, v / CASE WHEN av > 0 THEN av WHEN v > 0 THEN v ELSE 1 END AS spike FROM x), z AS (SELECT *, CASE WHEN least(100, greatest(0, s * 100)) > 70 THEN 35 ELSE 0 END + CASE WHEN si > 20 THEN 25 ELSE 0 END + CASE WHEN sr > 5 THEN 20 ELSE 0 END + CASE WHEN spike > 3 THEN 20 ELSE 0 END AS m FROM y)
    SELECT sym, m::DOUBLE AS meme_score, m >= 50 AS is_meme, round(s * 100, 1) AS bull_pct FROM z""")
def meme_score(spark, sf_dir):
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.cast("string").alias("sym"), ((k % 100) / 100.0).alias("sentiment"), (k % 41).cast("double").alias("short_interest"), (k % 11).cast("double").alias("short_ratio"), F.abs("c_acctbal").alias("volume"), (F.col("c_nationkey") * 100).cast("double").alias("avg_volume"))
    return O.meme_score(c).select("sym", "meme_score", "is_meme", "bull_pct")
