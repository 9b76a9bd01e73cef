"""Queries of rosters, registry floors and display."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwright.operators import display as D
from barwright.operators import native
from barwright.operators import registry as G
from barwright.operators import store as S
from barwright.operators import text as X
from barwright.plans import shared, sql
from barwright.plans.upkeep import PRIMARY, _listing
from barwright.sources import bars as B
from barwright.sources import rosters as L

QUERIES, ORACLES = {}, {}


def query(oracle=None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("SELECT DISTINCT trim(s) AS sym FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN ' ' || upper(left(p_name, 3)) || ' ' WHEN 1 THEN p_brand ELSE upper(left(p_type, 6)) END AS s FROM part) WHERE regexp_full_match(trim(s), '[A-Z]{1,5}')")
def listing_parse(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.upper(F.substring("p_name", 1, 3)), F.lit(" "))).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.upper(F.substring("p_type", 1, 6)))
    return L.listed(p.select(s.alias("sym")))


def _roster(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.format_string("%04d", F.col("c_custkey") * 7 % 12000).alias("code"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))


ROSTER = "r AS (SELECT printf('%04d', c_custkey * 7 % 12000) AS code, c_mktsegment AS segment FROM customer), k AS (SELECT *, CASE WHEN NOT regexp_full_match(code, '\\d{4}') THEN 'rejected' WHEN segment NOT IN ('BUILDING', 'MACHINERY') THEN 'other segment' ELSE 'kept' END AS kind FROM r)"


@query(f"WITH {ROSTER} SELECT DISTINCT code || CASE segment WHEN 'BUILDING' THEN '.T' ELSE '.KS' END AS sym, segment, segment = 'BUILDING' AS ok FROM k WHERE kind = 'kept'")
def roster_members(spark, sf_dir):
    m, _ = L.roster_members(_roster(spark, sf_dir), {"BUILDING": ".T", "MACHINERY": ".KS"})
    return m.withColumn("ok", L.member_ok(F.col("sym")))


@query(f"WITH {ROSTER} SELECT kind, count(*) AS rows, kind = 'kept' AND count(*) > 100 AS over_budget FROM k GROUP BY 1")
def roster_counts(spark, sf_dir):
    return L.roster_members(_roster(spark, sf_dir), {"BUILDING": ".T", "MACHINERY": ".KS"}, budget=100)[1]


@query(f"WITH {PRIMARY}, o AS (SELECT count(*) AS members, count(DISTINCT region) AS regions FROM p WHERE region <> 'unchecked') SELECT members, regions, concat_ws(',', CASE WHEN members < 100 THEN 'too few members' END, CASE WHEN regions < 12 THEN 'too few regions' END, CASE WHEN members < 0.8 * 1000000 THEN 'shrunk' END) AS reasons FROM o")
def registry_floors(spark, sf_dir):
    a = G.primary_regions(_listing(spark, sf_dir), ["low", "medium"])
    return L.floor_reasons(a, anchor=1_000_000, least=100).select("members", "regions", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {sql.NATION} SELECT sym, count(DISTINCT year(bar_ts)) AS years, count(DISTINCT year(bar_ts)) >= 7 AS enough FROM bars GROUP BY 1")
def year_coverage(spark, sf_dir):
    return L.year_coverage(B.daily_by_nation(spark, sf_dir), 7)


def _served(spark, sf_dir):
    """Customers who had ordered by some day: a download as far as it came."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(F.to_date("o_orderdate") < F.lit("1993-01-01").cast("date"))
    return o.select(F.col("o_custkey").cast("string").alias("sym")).distinct()


UNSERVED = "c_custkey NOT IN (SELECT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1993-01-01')"


@query(f"SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS sym FROM customer WHERE {UNSERVED}")
def resume_remaining(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("sym"))
    return L.remaining(c, _served(spark, sf_dir))


@query(f"SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS sym FROM customer WHERE {UNSERVED} AND c_nationkey <> 7")
def fileless_purge(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("sym"), "c_nationkey")
    return L.fileless(c, _served(spark, sf_dir), c.filter("c_nationkey = 7"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS sym, CAST(o_orderdate AS DATE) AS day, o_totalprice AS score FROM orders WHERE o_custkey = 7 AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01'")
def scan_history(spark, sf_dir):
    h = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("sym"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("score"))
    return L.scan_history(h, "7", F.lit("1996-01-01").cast("date"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal / 100 >= 70 THEN 'high' WHEN c_acctbal / 100 >= 40 THEN 'mid' ELSE 'low' END AS class, CASE WHEN c_custkey % 5 = 0 THEN '–' ELSE printf('%.1f%%', floor(c_acctbal) / 10) END AS shown,
    replace(replace(replace(replace(replace('<b>' || c_name || '&''"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM customer""")
def display_format(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    value = F.when(F.col("c_custkey") % 5 != 0, D.floored(F.col("c_acctbal")) / 10)
    return c.select("c_custkey", D.score_class(F.col("c_acctbal") / 100).alias("class"), D.shown_number(value, 1, "%").alias("shown"), D.escaped_html(F.concat(F.lit("<b>"), "c_name", F.lit("&'\""))).alias("html"))


@query("""WITH x AS (SELECT p_partkey, p_brand AS indicator, ['strong', 'moderate', 'weak', 'none', 'insufficient', 'error', 'other'][(p_partkey % 7 + 1)::INT] AS weight FROM part) SELECT p_partkey, indicator, weight, p_partkey % 7 AS rank FROM x""")
def evidence_order(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    weight = F.element_at(F.array(*[F.lit(w) for w in [*D.EVIDENCE, "other"]]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return D.evidence_order(p.select("p_partkey", F.col("p_brand").alias("indicator"), weight.alias("weight"))).select("p_partkey", "indicator", "weight", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, CASE WHEN dayofweek(o_orderdate) = 6 THEN 'redraw' WHEN datediff('day', DATE '1997-01-01', CAST(o_orderdate AS DATE)) > 10 THEN 'stale' ELSE 'carry' END AS step FROM orders")
def carry_forward(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", D.carried(F.lit("1997-01-01").cast("date"), F.to_date("o_orderdate")).alias("step"))


# ---- stores and files: what is written is read again ---------------------------------------------------

_DAYS = f"""{sql.NATION}, days AS (SELECT sym, date_trunc('day', bar_ts) AS bar_ts, open, high, low, close, volume FROM bars)"""


def _rounded(bars):
    return bars.select("sym", "bar_ts", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close", "volume")])


_ROUNDED = "sym, bar_ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume"


@query(f"WITH {_DAYS} SELECT {_ROUNDED} FROM days WHERE sym IN ('1', '2')")
def csv_store(spark, sf_dir):
    """A store of a CSV folder a symbol, written twice (the second takes the first's place as a whole) and
    read with numbers and dates as they can be read."""
    at = shared.folder(spark, "csv-store")
    bars = B.daily_by_nation(spark, sf_dir)
    B.write_csv_store(bars.filter("sym = '3'"), at)
    B.write_csv_store(bars.filter("sym in ('1', '2')"), at)
    return _rounded(B.read_csv_folders(spark, at))


@query(f"WITH {_DAYS} SELECT {_ROUNDED} FROM days WHERE sym = '4' AND month(bar_ts) <> 5")
def csv_files(spark, sf_dir):
    """A folder of one CSV a symbol with lines that can't be read: those without a close or a date go."""
    at = shared.folder(spark, "csv-files")
    b = B.daily_by_nation(spark, sf_dir).filter("sym = '4'")
    rows = b.select(F.date_format("bar_ts", "yyyy-MM-dd").alias("date"), "open", "high", "low", F.when(F.month("bar_ts") == 5, "n/a").otherwise(F.col("close").cast("string")).alias("close"), "volume")
    bad = spark.createDataFrame([("no date", 1.0, 1.0, 1.0, "1", 1.0)], rows.schema)
    rows.unionByName(bad).coalesce(1).write.option("header", True).csv(f"{at}/part")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{at}/part")):
        if f.getPath().getName().endswith(".csv"):
            fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{at}/4.csv"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{at}/part"), True)
    return _rounded(B.read_csv_store(spark, f"{at}/4.csv"))


@query(f"WITH {_DAYS}, w AS (SELECT * FROM days WHERE year(bar_ts) <> 1996 UNION ALL SELECT * REPLACE (close + 1 AS close) FROM days WHERE year(bar_ts) = 1996) SELECT {_ROUNDED} FROM w WHERE sym = '7'")
def year_store(spark, sf_dir):
    """A Parquet store by year: all years written, one of them again with other closes; a symbol is read."""
    at = shared.folder(spark, "year-store")
    bars = B.daily_by_nation(spark, sf_dir)
    B.write_store(bars, at)
    B.write_store(bars.filter(F.year("bar_ts") == 1996).withColumn("close", F.col("close") + 1), at)
    return _rounded(B.read_store(spark, at, "7"))


@query(f"WITH {_DAYS} SELECT year(bar_ts)::INT AS year, count(*) AS bars, true AS fresh, true AS in_order FROM days GROUP BY 1")
def store_order(spark, sf_dir):
    """Bars of each year of a store, whether its files are young, and in order of symbol and time."""
    at = shared.folder(spark, "store-order")
    B.write_store(B.daily_by_nation(spark, sf_dir), at)
    rows = spark.read.parquet(at).select("year", "sym", "bar_ts", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    w = Window.partitionBy("file").orderBy("at")
    rows = rows.withColumn("ok", F.coalesce(F.struct("sym", "bar_ts") > F.struct(F.lag("sym").over(w), F.lag("bar_ts").over(w)), F.lit(True)))
    young = B.store_age_days(spark, at).select("file", (F.col("age_days") < 1).alias("young"))
    return rows.join(young, "file").groupBy("year").agg(F.count(F.lit(1)).alias("bars"), F.min("young").alias("fresh"), F.min("ok").alias("in_order"))


@query(f"WITH {sql.HOURLY}, {sql.KERNELS}, {sql.signals_cte(['RSI', 'VWAP'])} SELECT sym, bar_ts, state, round(open, 6) AS open, round(close, 6) AS close, indicator FROM sig WHERE indicator IN ('RSI', 'VWAP')")
def signal_files(spark, sf_dir):
    """Signal streams as gzipped JSON lines, a folder an indicator, written and read again."""
    at = shared.folder(spark, "signals")
    B.write_signals(native.signals(B.hourly(spark, sf_dir), ["RSI", "VWAP"]).select("sym", "bar_ts", "state", "open", "close", "indicator"), at)
    return B.read_signals(spark, at).select("sym", "bar_ts", "state", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), "indicator")


@query("SELECT printf('%04d', c_custkey * 7 % 12000) AS code, c_mktsegment AS segment, c_name AS name FROM customer")
def roster_file(spark, sf_dir):
    """A roster whose comments start with #, as a file."""
    at = shared.folder(spark, "roster")
    lines = _roster(spark, sf_dir).select(F.concat_ws(",", "code", "segment", "name").alias("value"))
    head = spark.createDataFrame([("# codes of a market",), ("code,segment,name",)], "value string")
    head.coalesce(1).unionByName(lines.coalesce(1)).coalesce(1).write.text(at)
    return L.read_roster(spark, at)


@query("""SELECT 'r' || c_nationkey AS region, CASE WHEN c_custkey % 5 = 0 THEN 'bad sym ' || c_custkey ELSE 'C' || c_custkey END AS sym, CASE WHEN c_custkey % 5 = 0 THEN 'symbol' ELSE 'region' END AS reason FROM customer""")
def charset_gate(spark, sf_dir):
    """Entries that no registry may hold: names with blanks, regions with digits."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    sym = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("bad sym "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("C"), F.col("c_custkey").cast("string")))
    rows = c.select(F.lit(2).alias("version"), F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("region"), sym.alias("sym"))
    good = c.select(F.lit(2).alias("version"), F.lit("low_cap").alias("region"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("sym"))
    return G.charset_reasons(rows.unionByName(good)).select("region", "sym", "reason")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) < d - CASE isodow(d) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS stale FROM (SELECT o_orderkey, o_orderdate, DATE '1995-06-01' + (o_orderkey % 14)::INT AS d FROM orders)")
def freshness(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    today = F.date_add(F.lit("1995-06-01").cast("date"), (F.col("o_orderkey") % 14).cast("int"))
    return o.select("o_orderkey", S.is_stale(F.to_date("o_orderdate"), today).alias("stale"))


@query("""SELECT c_custkey, count(*) FILTER (nights >= 2) OVER () AS excluded, count(*) OVER () AS members, count(*) FILTER (nights >= 2) OVER () > 0.005 * count(*) OVER () AS too_many FROM (SELECT c_custkey, c_custkey % 300 AS nights FROM customer) QUALIFY nights = 0""")
def exclusion_cap(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_custkey").cast("string").alias("sym"), (F.col("c_custkey") % 300).cast("int").alias("nights"))
    return c.filter("nights = 0").select("c_custkey").crossJoin(F.broadcast(S.too_many(c, c)))


@query("SELECT CAST(c_custkey AS VARCHAR) AS sym, (c_custkey % 7)::INT AS nights FROM customer WHERE c_custkey % 7 >= 2")
def excluded_list(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return S.excluded(c.select(F.col("c_custkey").cast("string").alias("sym"), (F.col("c_custkey") % 7).cast("int").alias("nights")))


@query("""WITH f AS (SELECT CAST(c_custkey AS VARCHAR) AS sym, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS score, CASE WHEN c_custkey % 4 = 0 THEN 'first failed' END AS error, c_custkey AS k FROM customer),
    b AS (SELECT CAST(c_custkey AS VARCHAR) AS sym, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal + 1 END AS score2, CASE WHEN c_custkey % 3 = 0 THEN 'second failed' END AS error2 FROM customer WHERE c_custkey % 2 = 0)
    SELECT f.sym, coalesce(score2, score) AS score, CASE WHEN score2 IS NOT NULL THEN error2 WHEN error2 IS NOT NULL THEN error2 ELSE error END AS error, score2 IS NOT NULL AS replaced FROM f LEFT JOIN b ON b.sym = f.sym""")
def merged_passes(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, sym = F.col("c_custkey"), F.col("c_custkey").cast("string").alias("sym")
    first = c.select(sym, F.when(k % 4 > 0, F.col("c_acctbal")).alias("score"), F.when(k % 4 == 0, F.lit("first failed")).alias("error"))
    second = c.filter(k % 2 == 0).select(sym, F.when(k % 3 > 0, F.col("c_acctbal") + 1).alias("score"), F.when(k % 3 == 0, F.lit("second failed")).alias("error"))
    return S.merged_passes(first, second)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN (c_custkey * 10)::INT END AS anchor FROM customer""")
def registry_anchor(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    doc = F.when(k % 4 < 2, F.concat(F.lit('{"rows": 3, "registry": {"m_unique": '), (k * 10).cast("string"), F.lit(', "regions": 9}}'))).when(k % 4 == 2, F.lit('{"registry": 5}')).otherwise(F.lit("not json"))
    return c.select("c_custkey", S.anchor(doc).alias("anchor"))


@query("""WITH e AS (SELECT CAST(c_custkey AS VARCHAR) AS sym, 'no rows' AS error FROM customer WHERE c_custkey % 100 = 0) SELECT (SELECT count(*) FROM e) AS errors, (SELECT string_agg(sym || ': ' || error, '; ' ORDER BY sym || ': ' || error) FROM (SELECT * FROM e ORDER BY sym, error LIMIT 10)) AS first, (SELECT count(*) FROM e) > 10 AS truncated""")
def run_summary(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 100 = 0")
    return S.summary(c.select(F.col("c_custkey").cast("string").alias("sym"), F.lit("no rows").alias("error")))


@query("""SELECT n_nationkey, n_name AS company, upper(left(n_name, 3)) AS sym FROM nation UNION ALL SELECT n_nationkey, n_name || ' two', upper(left(n_name, 2)) || 'X' FROM nation WHERE n_nationkey % 2 = 0""")
def trending_table(spark, sf_dir):
    """Companies and symbols of a table written in Markdown."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    one = F.concat(F.lit("|[###### "), "n_name", F.lit("<br><br>"), F.lower(F.substring("n_name", 1, 3)), F.lit("](https://x)|5|"))
    two = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("|[######"), "n_name", F.lit(" two<br><br>"), F.substring("n_name", 1, 2), F.lit("x](y)|3|"))).otherwise(F.lit(""))
    rows = n.select("n_nationkey", F.explode(X.trending_rows(F.concat(one, F.lit("\n"), two))).alias("r"))
    return rows.select("n_nationkey", "r.company", "r.sym")


@query("SELECT CAST(c_custkey AS VARCHAR) AS sym, c_acctbal AS close, c_name AS adj_close FROM customer")
def column_case(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return S.cased(c.select(F.col("c_custkey").cast("string").alias("SYM"), F.col("c_acctbal").alias(" Close"), F.col("c_name").alias("Adj  Close")))
