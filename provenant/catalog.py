"""The registered queries of the library over the driver's tables, and SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import stats
from .operators import assoc, bins, cohort, decompose, profile, sanity, series
from .operators.model import logit, metrics
from .operators.model.tiers import TierPolicy, tier_counts
from .operators.quality import repairs
from .plans import semantic
from .sources.registry import star
from .streaming import rates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (read, spark): ``read(table)`` gives a table. The SQL has columns of the same names."""
    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, places: int = 6, **own: int) -> DataFrame:
    return df.select(*[F.round(F.col(c), own.get(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sales(read) -> DataFrame:
    """lineitem with its part's columns, revenue, cogs and year."""
    part = read("part").select("p_partkey", "p_type", "p_brand", "p_size", "p_retailprice")
    rows = read("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.withColumns({"revenue": F.col("l_extendedprice") * (1 - F.col("l_discount")), "cogs": F.col("l_quantity") * F.col("p_retailprice"), "y": F.year("l_shipdate"), "returned": (F.col("l_returnflag") == "R").cast("int")})


SALES = """WITH f AS (SELECT *, l_extendedprice * (1 - l_discount) AS revenue, l_quantity * p_retailprice AS cogs, CAST(year(l_shipdate) AS INTEGER) AS y,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# ------------------------------------------------------------ decomposition

EFFECTS = SALES + """, b AS (SELECT p_type AS segment, sum(CASE WHEN y = 1996 THEN revenue ELSE 0 END) r1, sum(CASE WHEN y = 1997 THEN revenue ELSE 0 END) r2,
  sum(CASE WHEN y = 1996 THEN cogs ELSE 0 END) c1, sum(CASE WHEN y = 1997 THEN cogs ELSE 0 END) c2 FROM f WHERE y IN (1996, 1997) GROUP BY 1),
w AS (SELECT segment, r1 / sum(r1) OVER () AS share_1, r2 / sum(r2) OVER () AS share_2, coalesce((r1 - c1) / nullif(r1, 0), 0) AS margin_1, coalesce((r2 - c2) / nullif(r2, 0), 0) AS margin_2 FROM b),
e AS (SELECT *, (share_2 - share_1) * margin_1 AS mix, share_1 * (margin_2 - margin_1) AS rate, (share_2 - share_1) * (margin_2 - margin_1) AS interaction FROM w)"""


@query(EFFECTS + """ SELECT segment, round(share_1, 6) AS share_1, round(share_2, 6) AS share_2, round(margin_1, 6) AS margin_1, round(margin_2, 6) AS margin_2,
  round(mix, 6) AS mix, round(rate, 6) AS rate, round(interaction, 6) AS interaction, round(mix + rate + interaction, 6) AS total FROM e""")
def margin_decomposition(read) -> DataFrame:
    return rounded(decompose.decompose_margin(sales(read), "p_type", "y", 1996, 1997))


@query(EFFECTS + """, t AS (SELECT sum(share_1 * margin_1) m1, sum(share_2 * margin_2) m2, sum(mix) x, sum(rate) r, sum(interaction) i FROM e)
SELECT round(m1, 6) AS margin_1, round(m2, 6) AS margin_2, round(x, 6) AS mix, round(r, 6) AS rate, round(i, 6) AS interaction, round(m2 - m1, 6) AS delta,
  CASE WHEN abs(x) >= abs(r) AND abs(x) >= abs(i) THEN 'mix' WHEN abs(r) >= abs(i) THEN 'rate' ELSE 'interaction' END AS dominant FROM t""")
def margin_totals(read) -> DataFrame:
    return rounded(decompose.margin_totals(decompose.decompose_margin(sales(read), "p_type", "y", 1996, 1997)))


@query(SALES + """, b AS (SELECT p_brand AS segment, sum(CASE WHEN y = 1996 THEN revenue ELSE 0 END) v1, sum(CASE WHEN y = 1997 THEN revenue ELSE 0 END) v2 FROM f WHERE y IN (1996, 1997) GROUP BY 1)
SELECT segment, round(v1, 2) AS value_1, round(v2, 2) AS value_2, round(v2 - v1, 2) AS delta, round((v2 - v1) / nullif(sum(v2 - v1) OVER (), 0), 6) AS contribution FROM b""")
def additive_contribution(read) -> DataFrame:
    return rounded(decompose.additive_contribution(sales(read), "p_brand", "y", 1996, 1997, "revenue"), 2, contribution=6)


@query(SALES + """, b AS (SELECT p_brand, sum(CASE WHEN y = 1996 THEN revenue - cogs ELSE 0 END) t1, sum(CASE WHEN y = 1997 THEN revenue - cogs ELSE 0 END) t2,
  sum(CASE WHEN y = 1996 THEN revenue ELSE 0 END) b1, sum(CASE WHEN y = 1997 THEN revenue ELSE 0 END) b2 FROM f WHERE y IN (1996, 1997) GROUP BY 1),
d AS (SELECT *, round(t2 / nullif(b2, 0) - t1 / nullif(b1, 0), 4) AS delta FROM b),
s AS (SELECT sum(t2) / nullif(sum(b2), 0) - sum(t1) / nullif(sum(b1), 0) AS o, count(*) FILTER (WHERE b1 > 0 AND b2 > 0 AND delta > 0) AS u, count(*) FILTER (WHERE b1 > 0 AND b2 > 0 AND delta < 0) AS n FROM d)
SELECT round(o, 6) AS overall_delta, u AS n_up, n AS n_down, (o > 0 AND u = 0 AND n > 0) OR (o < 0 AND n = 0 AND u > 0) AS reversed FROM s""")
def simpson_check(read) -> DataFrame:
    return rounded(decompose.simpsons_check(sales(read).withColumn("profit", F.col("revenue") - F.col("cogs")), "p_brand", "y", 1996, 1997, "profit", "revenue"))


# ------------------------------------------------------------ joins, aggregates, sets

@query("""WITH c AS (SELECT DISTINCT * FROM customer), n AS (SELECT DISTINCT * FROM nation), r AS (SELECT DISTINCT * FROM region)
SELECT r_name, n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN c ON c_custkey = o_custkey LEFT JOIN n ON n_nationkey = c_nationkey LEFT JOIN r ON r_regionkey = n_regionkey GROUP BY 1, 2, 3""")
def star_left_join(read) -> DataFrame:
    """Left joins of deduplicated dimensions to the order grain."""
    rows = star(read("orders"), [(read("customer"), "o_custkey", "c_custkey"), (read("nation"), "c_nationkey", "n_nationkey"), (read("region"), "n_regionkey", "r_regionkey")])
    return rounded(rows.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total")), 2)


@query("""WITH x AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_partkey) AS parts, avg(l_discount) AS mean_discount, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC) AS k FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT o_orderkey, x.lines, x.parts, round(x.mean_discount, 6) AS mean_discount, x.quantity, b.p_brand AS top_brand, CASE WHEN x.l_orderkey IS NOT NULL THEN 1 ELSE 0 END AS has_lines
FROM orders LEFT JOIN x ON x.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey AND b.k = 1""")
def order_grain_attribution(read) -> DataFrame:
    """The many side is summed up to the order before any join; the dominant part comes from an aggregate, and only it is
    looked up."""
    lines = read("lineitem")
    by = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_distinct("l_partkey").alias("parts"), F.avg("l_discount").alias("mean_discount"), F.sum("l_quantity").alias("quantity"), F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("top_part"))
    joined = read("orders").select("o_orderkey").join(by, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    joined = joined.join(read("part").select("p_partkey", F.col("p_brand").alias("top_brand")), F.col("top_part") == F.col("p_partkey"), "left")
    return rounded(joined.select("o_orderkey", "lines", "parts", "mean_discount", "quantity", "top_brand", F.col("l_orderkey").isNotNull().cast("int").alias("has_lines")))


@query("""SELECT event_type, user_id, max(CASE WHEN k = 1 THEN value END) AS value_at_last FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL) GROUP BY 1, 2""")
def value_at_maximum(read) -> DataFrame:
    return C.value_at_maximum(read("events"), ["event_type", "user_id"], "value", ["ts", "event_id"], "value_at_last")


@query("""SELECT y, orders, round(total, 2) AS total FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS orders, sum(o_totalprice) AS total FROM (SELECT * FROM orders WHERE year(o_orderdate) < 1996 UNION ALL SELECT * FROM orders WHERE year(o_orderdate) >= 1996) GROUP BY 1)""")
def union_years(read) -> DataFrame:
    o = read("orders")
    both = C.union_all([o.filter(F.year("o_orderdate") < 1996), o.filter(F.year("o_orderdate") >= 1996)])
    return rounded(both.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def dedup_rows(read) -> DataFrame:
    return C.project(read("customer"), ["c_mktsegment", "c_nationkey"]).distinct()


@query("SELECT * EXCLUDE (o_orderpriority, o_orderstatus), round(o_totalprice / 2, 6) AS half FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL AND o_custkey IS DISTINCT FROM 1")
def project_filter(read) -> DataFrame:
    """Projection with appended and excluded columns; equality, null and null-safe predicates."""
    o = C.equals(read("orders"), {"o_orderstatus": ["F", "O"]}).filter(F.col("o_orderpriority").isNotNull() & C.changed(F.col("o_custkey"), F.lit(1)))
    return C.exclude(C.append(o, {"half": "round(o_totalprice / 2, 6)"}), ["o_orderpriority", "o_orderstatus"])


@query("SELECT CAST(count(*) AS BIGINT) AS row_count, CAST((SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) AS BIGINT) AS distinct_rows, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) AS BIGINT) AS duplicate_rows FROM customer")
def distinct_count_rows(read) -> DataFrame:
    return profile.distinct_rows(read("customer").select("c_nationkey", "c_mktsegment"))


@query("SELECT p_brand AS level, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20")
def top_levels(read) -> DataFrame:
    return C.top_levels(sales(read), "p_brand", 20)


@query("""SELECT c_mktsegment, c_custkey, round(c_acctbal, 2) AS c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k = 1""")
def best_per_key(read) -> DataFrame:
    return rounded(C.best_per_key(read("customer"), ["c_mktsegment"], [-F.col("c_acctbal"), F.col("c_custkey")], ["c_custkey", "c_acctbal"]), 2)


# ------------------------------------------------------------ metrics

@query(SALES + " SELECT y, p_type, round((sum(revenue) - sum(cogs)) / nullif(sum(revenue), 0), 6) AS gross_margin FROM f GROUP BY 1, 2")
def metric_gross_margin(read) -> DataFrame:
    return rounded(semantic.measure(sales(read), "gross margin", ["y", "p_type"]))


@query(SALES + " SELECT y, round(sum(revenue), 2) AS revenue FROM f GROUP BY 1")
def metric_revenue(read) -> DataFrame:
    return rounded(semantic.measure(sales(read), "sales", ["y"]), 2)


@query(SALES + " SELECT y, round(sum(cogs), 2) AS cogs FROM f GROUP BY 1")
def metric_cogs(read) -> DataFrame:
    return rounded(semantic.measure(sales(read), "cost", ["y"]), 2)


@query("SELECT o_orderpriority, round(count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) / nullif(count(DISTINCT o_custkey), 0), 6) AS customer_churn_rate FROM orders GROUP BY 1")
def metric_customer_churn_rate(read) -> DataFrame:
    o = read("orders").withColumn("customer_status", F.when(F.col("o_orderstatus") == "F", "Churned").otherwise("Active"))
    return rounded(semantic.measure(o, "churn", ["o_orderpriority"], {"customer_id": "o_custkey"}))


@query("SELECT l_linestatus, round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS product_quality_return_rate FROM lineitem GROUP BY 1")
def metric_product_quality_return_rate(read) -> DataFrame:
    rows = read("lineitem").withColumn("product_quality_return", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(semantic.measure(rows, "quality returns", ["l_linestatus"]))


@query("SELECT l_linestatus, round(count(*) FILTER (WHERE l_returnflag = 'A') / count(*), 6) AS non_quality_return_rate FROM lineitem GROUP BY 1")
def metric_non_quality_return_rate(read) -> DataFrame:
    rows = read("lineitem").withColumn("non_quality_return", (F.col("l_returnflag") == "A").cast("int"))
    return rounded(semantic.measure(rows, "fit return rate", ["l_linestatus"]))


# ------------------------------------------------------------ profile

def _probe_sql(table: str, names: list[str], tail: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) AS row_count, count({n}) AS non_null, count(DISTINCT {n}) AS \"distinct\", min(CAST({n} AS VARCHAR)) AS min_str, max(CAST({n} AS VARCHAR)) AS max_str FROM {table}" for n in names)
    return f"WITH p AS ({parts}) {tail}"


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(_probe_sql("customer", CUSTOMER, "SELECT * FROM p"))
def column_probe(read) -> DataFrame:
    return profile.probe_columns(read("customer").select(*CUSTOMER))


@query(_probe_sql("customer", CUSTOMER, 'SELECT "column", row_count, non_null, "distinct", round(1 - non_null / row_count, 4) AS null_rate, "distinct" / nullif(non_null, 0) AS cardinality_ratio FROM p'))
def profile_columns(read) -> DataFrame:
    return profile.profile_columns(read("customer").select(*CUSTOMER))


@query("""SELECT c AS "column", count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, quantile_cont(v, 0.5) AS median
FROM (SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY 1""")
def numeric_summaries(read) -> DataFrame:
    return rounded(assoc.numeric_summaries(read("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4)


@query("SELECT CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS freshness FROM orders")
def freshness(read) -> DataFrame:
    o = read("orders")
    name, _ = profile.date_column(o)
    return o.agg(F.max(F.col(name).cast("date")).cast("string").alias("freshness"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE o_orderpriority IS NULL) AS null_priority, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders""")
def quality_counts(read) -> DataFrame:
    return C.condition_counts(read("orders"), {"null_priority": F.col("o_orderpriority").isNull(), "large": F.col("o_totalprice") > 100000})


# ------------------------------------------------------------ repairs on columns made untidy by the same expressions

@query("""SELECT event_id, CASE WHEN lower(trim(t)) IN ('true','t','yes','y','1') THEN true WHEN lower(trim(t)) IN ('false','f','no','n','0') THEN false END AS fixed
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Yes ' WHEN 1 THEN 'n' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'maybe' END AS t FROM events)""")
def repair_boolean(read) -> DataFrame:
    t = F.when(F.col("event_id") % 5 == 0, "Yes ").when(F.col("event_id") % 5 == 1, "n").when(F.col("event_id") % 5 == 2, "TRUE").when(F.col("event_id") % 5 == 3, "0").otherwise("maybe")
    return read("events").select("event_id", repairs.boolean_of(t).alias("fixed"))


@query("SELECT event_id, upper(trim(' ' || event_type || CASE WHEN event_id % 2 = 0 THEN '  ' ELSE '' END)) AS fixed FROM events")
def repair_whitespace_case(read) -> DataFrame:
    """The repair that the case module proposes for a column with several spellings of its values."""
    t = F.concat(F.lit(" "), F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.when(F.col("event_id") % 2 == 0, "  ").otherwise(""))
    rows = read("events").select("event_id", t.alias("t"))
    issue = next(i for i in repairs.detect(rows, ["case_standardisation"]) if i.column == "t")
    return rows.select("event_id", issue.repair.alias("fixed"))


COUNTRY_SQL = """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN ' U.S.' WHEN 1 THEN 'Deutschland' WHEN 2 THEN 'bharat ' WHEN 3 THEN 'Brazil' WHEN 4 THEN 'UK' ELSE 'Elsewhere' END AS t FROM nation"""


def _country(read) -> DataFrame:
    k = F.col("n_nationkey") % 6
    t = F.when(k == 0, " U.S.").when(k == 1, "Deutschland").when(k == 2, "bharat ").when(k == 3, "Brazil").when(k == 4, "UK").otherwise("Elsewhere")
    return read("nation").select("n_nationkey", t.alias("t"))


@query(f"SELECT n_nationkey, CASE lower(trim(t)) WHEN 'u.s.' THEN 'USA' WHEN 'deutschland' THEN 'Germany' WHEN 'bharat' THEN 'India' WHEN 'uk' THEN 'UK' ELSE trim(t) END AS fixed FROM ({COUNTRY_SQL})")
def repair_country(read) -> DataFrame:
    return _country(read).select("n_nationkey", repairs.country_of(F.col("t")).alias("fixed"))


@query(f"SELECT n_nationkey, coalesce(CASE WHEN n_nationkey > 20 THEN 'EMEA' END, CASE lower(trim(t)) WHEN 'brazil' THEN 'LATAM' WHEN 'uk' THEN 'EMEA' END) AS fixed FROM ({COUNTRY_SQL})")
def repair_region(read) -> DataFrame:
    region = F.when(F.col("n_nationkey") > 20, "EMEA")
    return _country(read).select("n_nationkey", repairs.region_of(region, F.col("t")).alias("fixed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fixed FROM orders""")
def repair_date(read) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    t = F.when(F.col("o_orderkey") % 4 == 0, F.year(day).cast("string")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy/MM/dd")).otherwise(F.concat(F.lit(" "), day.cast("string")))
    return read("orders").select("o_orderkey", C.safe_date(t).alias("fixed"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_custkey AS DOUBLE) WHEN 2 THEN -1.5 ELSE 10000000000.0 END AS fixed FROM orders""")
def repair_numeric(read) -> DataFrame:
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, "1d").when(k == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(" "))).when(k == 2, "-1.5").otherwise("1e10")
    return read("orders").select("o_orderkey", C.safe_double(t).alias("fixed"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%b') AS month, 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders")
def repair_period_labels(read) -> DataFrame:
    d = F.col("o_orderdate")
    return read("orders").select("o_orderkey", repairs.month_of(d).alias("month"), repairs.quarter_of(d).alias("quarter"), repairs.year_of(d).alias("year"))


@query("""SELECT count(*) AS compared, count(*) FILTER (WHERE stored <> derived) AS mismatched FROM (SELECT 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS derived, CASE WHEN o_orderkey % 7 = 0 THEN 'Q1' ELSE 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) END AS stored FROM orders)""")
def label_mismatch(read) -> DataFrame:
    derived = repairs.quarter_of(F.col("o_orderdate"))
    o = read("orders").withColumn("stored", F.when(F.col("o_orderkey") % 7 == 0, "Q1").otherwise(derived))
    return repairs.label_mismatch(o, F.col("stored"), derived)


# ------------------------------------------------------------ sanity

@query("SELECT count(*) AS groups, count(*) FILTER (WHERE n > 1) AS duplicate_keys, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def sanity_duplicates(read) -> DataFrame:
    return sanity.duplicate_keys(read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS rows, (SELECT count(DISTINCT o_orderkey) FROM orders) AS keys, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) / (SELECT count(DISTINCT o_orderkey) FROM orders) AS fanout, false AS ok")
def sanity_fanout(read) -> DataFrame:
    o = read("orders").select("o_orderkey")
    return sanity.join_fanout(o, o.join(read("lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")), "o_orderkey")


@query("SELECT CAST(d AS DATE) AS day FROM range(DATE '2023-12-30', DATE '2024-02-03', INTERVAL 1 DAY) t(d) WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)")
def sanity_temporal_coverage(read) -> DataFrame:
    e = read("events").select(F.col("ts").cast("date").alias("day"))
    wanted = e.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit("2023-12-30")), F.to_date(F.lit("2024-02-02")))).alias("day"))
    return sanity.missing_periods(e, "day", wanted)


@query("SELECT round(sum(p), 6) AS total, abs(sum(p) - 100) <= 0.5 AS ok FROM (SELECT 100.0 * count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)")
def sanity_percent_sum(read) -> DataFrame:
    shares = read("events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("p", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))
    return rounded(sanity.percent_sum(shares, "p"))


@query("SELECT min(ts) AS least, max(ts) AS most, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-02' OR ts > TIMESTAMP '2024-01-29') AS outside FROM events")
def sanity_date_bounds(read) -> DataFrame:
    return sanity.date_bounds(read("events"), "ts", F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-29").cast("timestamp_ntz"))


@query("SELECT count(*) AS groups, count(*) FILTER (WHERE n > 1) AS violations, count(*) FILTER (WHERE n > 1) = 0 AS holds FROM (SELECT count(DISTINCT n_regionkey) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey)")
def functional_dependency(read) -> DataFrame:
    rows = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return sanity.functional_dependency(rows, "c_nationkey", "n_regionkey")


@query("SELECT CAST(l_linestatus AS VARCHAR) AS level, count(*) AS n, min(t) AS outcome FROM (SELECT l_linestatus, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS t FROM lineitem) GROUP BY 1 HAVING min(t) = max(t)")
def quasi_separation(read) -> DataFrame:
    return sanity.quasi_separation(read("lineitem").withColumn("t", (F.col("l_returnflag") == "N").cast("int")), "l_linestatus", "t")


# ------------------------------------------------------------ association

@query(SALES + """, g AS (SELECT p_brand AS level, count(*) AS n, CAST(sum(returned) AS BIGINT) AS x FROM f GROUP BY 1), r AS (SELECT *, x / n AS rate, sum(x) OVER () / sum(n) OVER () AS base, 1.959963984540054 AS z FROM g)
SELECT level, n, x, round(rate, 6) AS rate, round(greatest(0, ((rate + z * z / (2 * n)) - z * sqrt(rate * (1 - rate) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS ci_low,
  round(least(1, ((rate + z * z / (2 * n)) + z * sqrt(rate * (1 - rate) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS ci_high, round(rate / base, 6) AS lift, round(100 * (rate - base), 6) AS gap_pp FROM r""")
def group_rates(read) -> DataFrame:
    """Rates with Wilson intervals, lift and gap."""
    return rounded(assoc.group_rates(sales(read), "p_brand", "returned"))


CHI = SALES + """, g AS (SELECT p_type AS level, count(*) AS n, sum(returned) AS x FROM f GROUP BY 1), s AS (SELECT *, sum(x) OVER () / sum(n) OVER () AS p FROM g),
c AS (SELECT sum((x - n * p) * (x - n * p) / (n * p) + (n - x - n * (1 - p)) * (n - x - n * (1 - p)) / (n * (1 - p))) AS stat, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, min(least(n * p, n * (1 - p))) AS e FROM s)"""


@query(CHI + " SELECT n, k AS levels, round(stat, 6) AS statistic, e < 5 AS small_expected, k - 1 AS df, round(sqrt(stat / n), 6) AS cramers_v FROM c")
def chi_square_stat(read) -> DataFrame:
    return rounded(assoc.chi_square(sales(read), "p_type", "returned"))


@query(SALES + """, t AS (SELECT CAST(count(*) FILTER (WHERE l_quantity > 25 AND returned = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE l_quantity > 25 AND returned = 0) AS DOUBLE) AS b,
  CAST(count(*) FILTER (WHERE l_quantity <= 25 AND returned = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE l_quantity <= 25 AND returned = 0) AS DOUBLE) AS d FROM f),
v AS (SELECT *, a * d / (b * c) AS o, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS so, (a / (a + b)) / (c / (c + d)) AS r, sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)) AS sr FROM t)
SELECT a, b, c, d, round(o, 6) AS odds_ratio, round(o * exp(-1.96 * so), 6) AS or_low, round(o * exp(1.96 * so), 6) AS or_high, round(r, 6) AS relative_risk, round(r * exp(-1.96 * sr), 6) AS rr_low, round(r * exp(1.96 * sr), 6) AS rr_high FROM v""")
def odds_and_risk(read) -> DataFrame:
    return rounded(assoc.two_by_two(sales(read), F.col("l_quantity") > 25, "returned"))


@query(SALES + " SELECT 'l_quantity' AS \"column\", count(*) AS n, round(corr(l_quantity, returned), 6) AS r FROM f UNION ALL SELECT 'l_discount', count(*), round(corr(l_discount, returned), 6) FROM f UNION ALL SELECT 'l_tax', count(*), round(corr(l_tax, returned), 6) FROM f")
def point_biserial(read) -> DataFrame:
    return rounded(assoc.point_biserial(sales(read), ["l_quantity", "l_discount", "l_tax"], "returned"))


@query(SALES + " SELECT c AS \"column\", CAST(returned AS BIGINT) AS class, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM (SELECT 'l_quantity' AS c, returned, l_quantity AS v FROM f UNION ALL SELECT 'l_discount', returned, l_discount FROM f) GROUP BY 1, 2")
def class_moments(read) -> DataFrame:
    return rounded(assoc.class_moments(sales(read), ["l_quantity", "l_discount"], "returned"))


@query(SALES + """, g AS (SELECT c AS "column", level, count(*) AS n, sum(returned) AS x FROM (SELECT 'p_brand' AS c, p_brand AS level, returned FROM f UNION ALL SELECT 'p_type', p_type, returned FROM f) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS rank FROM g)
SELECT "column", CAST(least(rank, 11) AS INTEGER) AS rank, CASE WHEN rank <= 10 THEN level ELSE '(other)' END AS level, CAST(sum(n) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS x FROM k GROUP BY 1, 2, 3""")
def categorical_levels(read) -> DataFrame:
    """The ten commonest levels of several columns in one pass, the rest folded into one."""
    return assoc.top_levels(sales(read), ["p_brand", "p_type"], "returned", 10)


# ------------------------------------------------------------ bins

@query(SALES + " SELECT CAST(row_number() OVER (ORDER BY l_linenumber) - 1 AS INTEGER) AS bucket, CAST(l_linenumber AS DOUBLE) AS lo, CAST(l_linenumber AS DOUBLE) AS hi, count(*) AS n, CAST(sum(returned) AS BIGINT) AS x FROM f GROUP BY l_linenumber")
def value_buckets(read) -> DataFrame:
    return bins.value_buckets(sales(read), "l_linenumber", "returned")


@query("""SELECT bucket, count(*) AS n, min(v) AS lo, max(v) AS hi, CAST(sum(t) AS BIGINT) AS x FROM (SELECT c_acctbal AS v, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS t, CAST(ntile(10) OVER (ORDER BY round(c_acctbal / 100), c_custkey) AS INTEGER) AS bucket FROM customer) GROUP BY 1""".replace("c_acctbal AS v", "round(c_acctbal / 100) AS v"))
def ntile_buckets(read) -> DataFrame:
    """NTILE(10) with a tie-break, by counts of values instead of one sorted partition."""
    c = read("customer").withColumns({"v": F.round(F.col("c_acctbal") / 100), "t": (F.col("c_mktsegment") == "BUILDING").cast("int")})
    return bins.ntile_buckets(c, "v", "t", ["c_custkey"])


@query("SELECT CASE WHEN l_quantity IS NULL THEN NULL WHEN l_quantity < 16 THEN '0-15' WHEN l_quantity < 21 THEN '16-20' ELSE '21+' END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def bin_labels(read) -> DataFrame:
    return read("lineitem").groupBy(bins.bin_column(F.col("l_quantity"), [16, 21]).alias("label")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_quantity AS v, count(*) AS n, sum(CASE WHEN l_quantity >= 30 AND l_linenumber % 3 > 0 OR l_linenumber % 10 = 0 THEN 1 ELSE 0 END) AS x FROM lineitem GROUP BY 1),
c AS (SELECT a.v AS cut, sum(b.x) FILTER (WHERE b.v >= a.v) / sum(b.n) FILTER (WHERE b.v >= a.v) AS above, sum(b.x) FILTER (WHERE b.v < a.v) / sum(b.n) FILTER (WHERE b.v < a.v) AS below FROM g a JOIN g b ON true GROUP BY 1)
SELECT cut, round(abs(above - below), 6) AS jump FROM c WHERE below IS NOT NULL ORDER BY abs(above - below) DESC, cut LIMIT 1""")
def threshold_cut(read) -> DataFrame:
    """Where the rate steps, as detect_threshold finds it over the distinct values."""
    rows = read("lineitem").withColumn("t", (((F.col("l_quantity") >= 30) & (F.col("l_linenumber") % 3 > 0)) | (F.col("l_linenumber") % 10 == 0)).cast("int"))
    made = bins.value_buckets(rows, "l_quantity", "t").orderBy("bucket").collect()
    found = bins.detect_threshold([bins.Bucket(r["lo"], r["hi"], r["n"], r["x"]) for r in made])
    return rows.sparkSession.createDataFrame([(c, round(found.jump, 6)) for c in found.cuts], "cut double, jump double")


# ------------------------------------------------------------ cohorts, series

COHORT = """WITH a AS (SELECT user_id, CAST(min(ts) AS DATE) AS cohort FROM events GROUP BY 1), j AS (SELECT e.*, a.cohort, CAST(CAST(ts AS DATE) - a.cohort AS INTEGER) AS "offset" FROM events e JOIN a USING (user_id)),
m AS (SELECT cohort, "offset", count(DISTINCT user_id) AS users FROM j GROUP BY 1, 2), r AS (SELECT *, users / max(CASE WHEN "offset" = 0 THEN users END) OVER (PARTITION BY cohort) AS rate FROM m)"""


def _cohorts(read) -> DataFrame:
    return cohort.assign_cohorts(read("events"), "user_id", "ts")


@query(COHORT + ' SELECT cohort, "offset", users, round(rate, 6) AS rate FROM r')
def retention_matrix(read) -> DataFrame:
    return rounded(cohort.retention_matrix(_cohorts(read), "user_id"))


@query(COHORT + ' SELECT m."offset", round(sum(m.users) / sum(b.users), 6) AS rate FROM m JOIN m b ON b.cohort = m.cohort AND b."offset" = 0 GROUP BY 1')
def retention_overall(read) -> DataFrame:
    return rounded(cohort.overall_rate(cohort.retention_matrix(_cohorts(read), "user_id")))


@query(COHORT + """, v AS (SELECT cohort, "offset", sum(value) AS v FROM j GROUP BY 1, 2), b AS (SELECT cohort, users FROM m WHERE "offset" = 0)
SELECT v.cohort, v."offset", round(round(sum(v) OVER (PARTITION BY v.cohort ORDER BY v."offset" ROWS UNBOUNDED PRECEDING) / greatest(coalesce(b.users, 1), 1), 4), 3) AS ltv FROM v LEFT JOIN b USING (cohort)""")
def cohort_ltv(read) -> DataFrame:
    return rounded(cohort.cohort_ltv(_cohorts(read), "user_id", "value"), 3)


@query(COHORT + ' SELECT cohort, users, round(rate, 6) AS rate FROM r WHERE "offset" = 7')
def vintage_compare(read) -> DataFrame:
    return rounded(cohort.vintage_compare(cohort.retention_matrix(_cohorts(read), "user_id"), 7))


@query("""WITH s(step, stage) AS (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase')), c AS (SELECT step, stage, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = stage) AS users FROM s),
l AS (SELECT *, lag(users) OVER (ORDER BY step) AS b FROM c)
SELECT stage, CAST(step AS INTEGER) AS step, users, users / nullif(b, 0) AS conversion, b - users AS "drop", coalesce(b - users = max(b - users) OVER (), false) AS biggest FROM l""")
def funnel(read) -> DataFrame:
    return cohort.funnel(read("events"), "event_type", "user_id", ["view", "click", "signup", "purchase"])


DAILY = "WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1), s AS (SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS t, v AS y FROM d)"
RESIDUAL = DAILY + ", q AS (SELECT regr_slope(y, t) AS b, avg(y) AS my, avg(t) AS mt FROM s), e AS (SELECT t, y, y - (my + b * (t - mt)) AS r FROM s, q)"


def _daily(read) -> DataFrame:
    days = read("events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    return series.to_series(days, "day", "v")


@query(DAILY + " SELECT count(*) AS n, round(regr_slope(y, t), 4) AS slope, round(regr_intercept(y, t), 4) AS intercept, round(regr_r2(y, t), 6) AS r2, CASE WHEN regr_slope(y, t) > 1e-9 THEN 'up' WHEN regr_slope(y, t) < -1e-9 THEN 'down' ELSE 'flat' END AS direction FROM s")
def trend_fit(read) -> DataFrame:
    return rounded(series.fit_trend(_daily(read)), 4, r2=6)


@query(RESIDUAL + """, x AS (SELECT quantile_cont(r, 0.5) AS m FROM e), w AS (SELECT quantile_cont(abs(r - m), 0.5) AS mad FROM e, x)
SELECT t, round(y, 4) AS y, round(abs(r - m) / nullif(mad * 1.4826, 0), 6) AS score FROM e, x, w WHERE abs(r - m) / nullif(mad * 1.4826, 0) > 1""")
def anomalies_mad(read) -> DataFrame:
    return rounded(series.anomalies(_daily(read), 1.0), 4, score=6)


@query(RESIDUAL + " SELECT CAST(t % 7 AS INTEGER) AS phase, round(avg(r), 4) AS effect FROM e GROUP BY 1")
def seasonal_profile(read) -> DataFrame:
    return rounded(series.seasonal_profile(_daily(read), 7), 4)


@query(RESIDUAL + ", p AS (SELECT t, r, avg(r) OVER (PARTITION BY t % 7) AS s FROM e) SELECT round(greatest(0, 1 - var_pop(r - s) / var_pop(r)), 6) AS strength FROM p")
def seasonality_strength(read) -> DataFrame:
    return rounded(series.seasonality_strength(_daily(read), 7))


@query(RESIDUAL + """, a AS (SELECT count(*) AS n, stddev_samp(r) AS sd FROM e), h AS (SELECT CAST(n + k AS INTEGER) AS t, sd FROM a, range(5) g(k))
SELECT h.t, round(my + b * (h.t - mt), 4) AS forecast, round(my + b * (h.t - mt) - 1.96 * sd, 4) AS low, round(my + b * (h.t - mt) + 1.96 * sd, 4) AS high FROM h, q""")
def forecast_linear(read) -> DataFrame:
    return rounded(series.forecast(_daily(read), 5), 4)


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 8) AS mean FROM events GROUP BY 1, 2")
def windowed_rates(read) -> DataFrame:
    """The batch form of the stream of windowed rates."""
    return rounded(rates.windowed_rates(read("events")), 4, mean=8).withColumn("start", F.col("start").cast("timestamp_ntz"))


# ------------------------------------------------------------ scores

SCORED = SALES + ", s AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, returned AS actual, round(l_quantity / 50 * 0.5 + l_discount * 4 + CASE WHEN returned = 1 THEN 0.05 ELSE 0 END, 2) AS score FROM f)"


def _scored(read) -> DataFrame:
    score = F.round(F.col("l_quantity") / 50 * 0.5 + F.col("l_discount") * 4 + F.when(F.col("returned") == 1, 0.05).otherwise(0.0), 2)
    return sales(read).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.col("returned").alias("actual"), score.alias("score"))


CONFUSED = """, c AS (SELECT th AS threshold, count(*) FILTER (WHERE score >= th AND actual = 1) AS tp, count(*) FILTER (WHERE score >= th AND actual = 0) AS fp, count(*) FILTER (WHERE score < th AND actual = 0) AS tn, count(*) FILTER (WHERE score < th AND actual = 1) AS fn FROM s, (VALUES {}) v(th) GROUP BY 1)
SELECT threshold, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c"""


@query(SCORED + CONFUSED.format("(0.5::DOUBLE)"))
def confusion_matrix(read) -> DataFrame:
    return rounded(metrics.confusion(_scored(read), "actual", "score"))


@query(SCORED + CONFUSED.format("(0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE)"))
def threshold_table(read) -> DataFrame:
    return rounded(metrics.threshold_table(_scored(read), "actual", "score", [0.2, 0.4, 0.6]))


@query(SCORED + ", t AS (SELECT k / 100 AS th FROM range(101) r(k)) SELECT th AS threshold, round(count(*) FILTER (WHERE score >= th AND actual = 1) / count(*) FILTER (WHERE actual = 1), 6) AS tpr, round(count(*) FILTER (WHERE score >= th AND actual = 0) / count(*) FILTER (WHERE actual = 0), 6) AS fpr FROM s, t GROUP BY 1")
def roc_curve(read) -> DataFrame:
    return rounded(metrics.roc_curve(_scored(read), "actual", "score"))


@query(SCORED + ", r AS (SELECT actual, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM s) SELECT round((sum(k) FILTER (WHERE actual = 1) - count(*) FILTER (WHERE actual = 1) * (count(*) FILTER (WHERE actual = 1) + 1) / 2) / (count(*) FILTER (WHERE actual = 1) * count(*) FILTER (WHERE actual = 0)), 6) AS auc FROM r")
def roc_auc(read) -> DataFrame:
    return rounded(metrics.roc_auc(_scored(read), "actual", "score"))


@query(SCORED + ", r AS (SELECT actual, score, least((row_number() OVER (ORDER BY score, l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1) // (SELECT count(*) // 10 FROM s), 9) AS bin FROM s) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(actual), 6) AS rate FROM r GROUP BY 1")
def calibration(read) -> DataFrame:
    return rounded(metrics.calibration(_scored(read), "actual", "score", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]))


@query(SCORED + " SELECT round(avg((score - actual) * (score - actual)), 6) AS brier, round(greatest(avg(actual), 1 - avg(actual)), 6) AS majority, count(*) AS n FROM s")
def brier(read) -> DataFrame:
    return rounded(metrics.brier(_scored(read), "actual", "score"))


@query(SCORED + ", g AS (SELECT score, sum(actual) AS p, count(*) - sum(actual) AS q FROM s GROUP BY 1), c AS (SELECT sum(p) OVER w / sum(p) OVER () AS a, sum(q) OVER w / sum(q) OVER () AS b FROM g WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(a - b)), 6) AS ks FROM c")
def ks_statistic(read) -> DataFrame:
    return rounded(metrics.ks_statistic(_scored(read), "actual", "score"))


@query(SCORED + " SELECT CASE WHEN score < 0.4 THEN 'Low' WHEN score < 0.7 THEN 'Medium' ELSE 'High' END AS tier, count(*) AS n, round(avg(score), 6) AS mean_score FROM s GROUP BY 1")
def tier_table(read) -> DataFrame:
    return rounded(tier_counts(_scored(read), "score", TierPolicy()))


@query("""WITH y AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha256('7:' || c_custkey)) AS k, count(*) OVER (PARTITION BY y) AS n FROM y)
SELECT c_custkey, y, k <= floor(n * 0.25 + 0.5) AS is_test FROM r""")
def stratified_split(read) -> DataFrame:
    c = read("customer").select("c_custkey", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"))
    return logit.stratified_split(c, "y", "c_custkey", 0.25, 7)


@query()
def logit_coefficients(read) -> DataFrame:
    """An iterative fit, so there is no SQL: the score equations of the result are checked in the tests."""
    rows = sales(read).select("returned", "l_quantity", "l_discount", "l_linestatus")
    fit = logit.fit_logit(rows, "returned", logit.build_design(rows, ["l_quantity", "l_discount"], ["l_linestatus"]))
    values = ", ".join(f"('{r['term']}', {r['coef']!r}D, {r['se']!r}D, {r['z']!r}D, {r['p_value']!r}D, {r['odds_ratio']!r}D)" for r in fit.table())
    return rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(term, coef, se, z, p_value, odds_ratio)")


@query(SCORED + """, w AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, score, [['l_partkey', l_partkey % 7], ['l_suppkey', l_suppkey % 5]] AS dummy FROM s)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_partkey % 7 > l_suppkey % 5 OR (l_partkey % 7 = l_suppkey % 5) THEN 'part' ELSE 'supplier' END AS first_factor FROM w""".replace(", [['l_partkey', l_partkey % 7], ['l_suppkey', l_suppkey % 5]] AS dummy", ""))
def top_factor(read) -> DataFrame:
    """The factor of greatest size per row, by sorting an array in the row."""
    parts = F.array(F.struct((F.col("l_partkey") % 7).alias("size"), F.lit(1).alias("first"), F.lit("part").alias("name")), F.struct((F.col("l_suppkey") % 5).alias("size"), F.lit(0).alias("first"), F.lit("supplier").alias("name")))
    return _scored(read).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.sort_array(parts, asc=False)[0]["name"].alias("first_factor"))


# ------------------------------------------------------------ tests and intervals on summaries of a table

def one_row(read, values: dict[str, float | int | str | bool]) -> DataFrame:
    """Results that were worked out from one aggregated row."""
    kinds = {float: "double", int: "bigint", str: "string", bool: "boolean"}
    spark = read("region").sparkSession
    return rounded(spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())))


RATES = "WITH g AS (SELECT count(*) FILTER (WHERE l_linestatus = 'F') AS n1, count(*) FILTER (WHERE l_linestatus = 'F' AND l_quantity > 25) AS x1, count(*) FILTER (WHERE l_linestatus = 'O') AS n2, count(*) FILTER (WHERE l_linestatus = 'O' AND l_quantity > 25) AS x2 FROM lineitem)"


def _rates(read):
    return read("lineitem").agg(*[F.count_if((F.col("l_linestatus") == s) & more).alias(n) for s, k in (("F", 1), ("O", 2)) for n, more in ((f"n{k}", F.lit(True)), (f"x{k}", F.col("l_quantity") > 25))]).first()


@query(RATES + " SELECT round((x1 / n1 - x2 / n2) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) AS z FROM g")
def test_of_two_shares(read) -> DataFrame:
    g = _rates(read)
    return one_row(read, {"z": stats.proportions(g["x1"], g["n1"], g["x2"], g["n2"]).statistic})


@query(RATES + """, w AS (SELECT x1 / n1 AS p, n1 AS n, 1.959963984540054 AS z FROM g)
SELECT round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM w""")
def interval_of_a_share(read) -> DataFrame:
    g = _rates(read)
    return one_row(read, dict(zip(("low", "high"), stats.wilson(g["x1"], g["n1"]))))


MEANS = """WITH g AS (SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS n1, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS m1, stddev_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS s1,
  count(*) FILTER (WHERE l_returnflag = 'N') AS n2, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS m2, stddev_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS s2 FROM lineitem)"""


def _means(read) -> tuple:
    of = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))
    return tuple(read("lineitem").agg(*[f(of(flag)) for flag in "RN" for f in (F.count, F.avg, F.stddev_samp)]).first())


@query(MEANS + " SELECT round((m1 - m2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2), 6) AS t, round(pow(s1 * s1 / n1 + s2 * s2 / n2, 2) / (pow(s1 * s1 / n1, 2) / (n1 - 1) + pow(s2 * s2 / n2, 2) / (n2 - 1)), 3) AS df FROM g")
def test_of_two_means(read) -> DataFrame:
    found = stats.welch(*_means(read))
    return one_row(read, {"t": found.statistic, "df": round(found.df, 3)})


@query(MEANS + """, d AS (SELECT n1, n2, (m1 - m2) / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)) AS d FROM g), e AS (SELECT d, sqrt((n1 + n2) / (n1 * n2) + d * d / (2 * (n1 + n2))) AS se FROM d)
SELECT round(d, 6) AS d, round(se, 6) AS se, round(d - 1.96 * se, 6) AS low, round(d + 1.96 * se, 6) AS high FROM e""")
def standardised_difference(read) -> DataFrame:
    found = stats.cohens_d(*_means(read))
    return one_row(read, {k: found[k] for k in ("d", "se", "low", "high")})


@query("SELECT round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM (SELECT corr(l_extendedprice, l_quantity) AS r, count(*) AS n FROM lineitem)")
def test_of_a_correlation(read) -> DataFrame:
    g = read("lineitem").agg(F.corr("l_extendedprice", "l_quantity").alias("r"), F.count("*").alias("n")).first()
    return one_row(read, {"r": g["r"], "t": round(stats.correlation(g["r"], g["n"]).statistic, 4)})


@query(RATES + """, b AS (SELECT x1 / n1 AS p, n1 AS n, 1.959963984540054 AS za, 0.8416212335729143 AS zb FROM g)
SELECT round((za + zb) * sqrt(2 * p * (1 - p) / n), 6) AS detectable, CAST(ceil(pow((za * sqrt(2 * (p + 0.01) * (1 - p - 0.01)) + zb * sqrt(p * (1 - p) + (p + 0.02) * (1 - p - 0.02))) / 0.02, 2)) AS BIGINT) AS per_arm FROM b""")
def sizes_of_an_experiment(read) -> DataFrame:
    g = _rates(read)
    base = g["x1"] / g["n1"]
    return one_row(read, {"detectable": stats.detectable_effect(g["n1"], base), "per_arm": stats.sample_size(base, 0.02)})


@query("""SELECT n_nationkey, round(CASE n_nationkey % 3 WHEN 0 THEN e / (e + 1) WHEN 1 THEN e / 100 ELSE e END * CASE WHEN n_nationkey % 2 = 0 THEN 1.0 ELSE 0.5 END * least(1.0, 40 * n_nationkey / 384), 6) AS score FROM (SELECT n_nationkey, n_nationkey / 10 AS e FROM nation)""")
def finding_scores(read) -> DataFrame:
    """The score by which findings of different kinds are ranked, for a row per nation."""
    kinds = ("d", "gap_pp", "correlation")
    keys = sorted(r[0] for r in read("nation").select("n_nationkey").collect())
    rows = [(k, float(assoc.rank_score(k / 10, kinds[k % 3], k % 2 == 0, 40 * k))) for k in keys]
    return rounded(read("nation").select("n_nationkey").join(read("nation").sparkSession.createDataFrame(rows, "n_nationkey bigint, score double"), "n_nationkey"))
