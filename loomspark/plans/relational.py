"""Plain relational operators on the star schema: the SQL surface that Spark provides, each with SQL to check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators.relation import Database


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _money(c):
    """Cents as a whole number: sums of it do not depend on order."""
    return F.round(c * 100).cast("long")


def projection(s, d):
    return _t(s, d, "part").select("p_partkey", F.upper("p_brand").alias("brand"), (F.col("p_size") * 2 + 1).cast("long").alias("size2"))


def filters(s, d):
    c = _t(s, d, "customer")
    return c.where(F.col("c_acctbal").between(0, 5000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_name").ilike("%7%")).select("c_custkey", "c_name", "c_acctbal")


def inner_join(s, d):
    o, c = _t(s, d, "orders"), _t(s, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.sum(_money(F.col("o_totalprice"))).alias("cents"))


def left_join(s, d):
    c, o = _t(s, d, "customer"), _t(s, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


def theta_join(s, d):
    """Suppliers of the same nation with a larger balance: a count of what follows in order, not a join of pairs."""
    a = _t(s, d, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("x"))
    w = Window.partitionBy("n").orderBy(F.desc_nulls_last("x"))
    above = F.rank().over(w) - 1
    return a.select("a", F.when(F.col("x").isNotNull(), above).otherwise(0).cast("long").alias("richer"))


def semi_flag(s, d):
    c, o = _t(s, d, "customer"), _t(s, d, "orders").where("o_totalprice > 300000").select("o_custkey").distinct()
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.col("o_custkey").isNotNull().cast("int").alias("large"))


def anti_join(s, d):
    c, o = _t(s, d, "customer"), _t(s, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def latest_per_key(s, d):
    o = _t(s, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


def json_children(s, d):
    n, r = _t(s, d, "nation"), _t(s, d, "region")
    names = n.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("names"))
    return r.join(names, r.r_regionkey == names.n_regionkey, "left").select("r_name", "names")


def grouped(s, d):
    li = _t(s, d, "lineitem")
    return li.groupBy("l_returnflag", F.year("l_shipdate").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.min("l_discount").alias("least"), F.max("l_discount").alias("most"),
        F.count_if(F.col("l_quantity") > 25).alias("large"), F.sum(F.when(F.col("l_tax") > 0.04, 1).otherwise(0)).alias("taxed"),
    )


def having(s, d):
    return _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q")).where("q > 200")


def distinct_rows(s, d):
    return _t(s, d, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("long").alias("line")).distinct()


def joined_text(s, d):
    p = _t(s, d, "part")
    return p.groupBy("p_size").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands")).select(F.col("p_size").cast("long").alias("size"), "brands")


def numbered(s, d):
    w = Window.partitionBy("o_custkey")
    o = _t(s, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return o.where("r <= 2").select("o_custkey", "o_orderkey", F.col("r").cast("long").alias("r"), "n")


def windows(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(s, d, "events").select(
        "event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long").alias("rank"),
        F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long").alias("dense"), F.ntile(4).over(w).cast("long").alias("quarter"), F.count(F.lit(1)).over(w.rowsBetween(-3, 0)).alias("recent"),
    )


def set_operations(s, d):
    a, b = _t(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("k")), _t(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    tag = lambda df, name: df.withColumn("op", F.lit(name))
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "intersect")).unionByName(tag(a.subtract(b), "except"))


def top_k(s, d):
    return _t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


def nulls_order(s, d):
    """Customers by last order, those without one at the end: a distributed sort of all rows."""
    c, o = _t(s, d, "customer"), _t(s, d, "orders")
    x = c.join(o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")), c.c_custkey == F.col("o_custkey"), "left")
    return x.select("c_custkey", F.col("k").alias("last_order")).orderBy(F.asc_nulls_last("last_order"), "c_custkey")


def cube_totals(s, d):
    return _t(s, d, "lineitem").cube("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("g")).select("l_returnflag", F.col("l_linenumber").cast("long").alias("line"), "n", "g")


def pivoted(s, d):
    e = _t(s, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1)))
    return e.na.fill(0)


def scalar_functions(s, d):
    e = _t(s, d, "documents")
    k = F.col("text")
    return e.select(
        "doc_id", F.coalesce(F.nullif(F.col("lang"), F.lit("en")), F.lit("-")).alias("lang"), F.substring(k, -5, 3).alias("tail"), F.sha2(F.lower(k), 256).alias("low"), F.length(k).cast("long").alias("chars"), F.octet_length(k).cast("long").alias("bytes"),
        F.instr(k, "the").cast("long").alias("at"), F.hex(F.col("source")).alias("hexed"), F.concat_ws("|", "source", "lang").alias("both"), F.round(F.col("n_chars") / 7, 2).alias("sevenths"), F.col("source").try_cast("long").alias("none"),
        F.expr("n_chars div 7").alias("whole"), F.sha2("text", 256).alias("sha"), F.regexp_extract("source", "([0-9]+)", 1).try_cast("long").alias("number"),
    )


def dates(s, d):
    o = _t(s, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.weekday("day").cast("long").alias("weekday"), "n")


def json_values(s, d):
    e = _t(s, d, "events")
    return e.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(_money(F.col("value"))).alias("cents"))


def ranges(s, d):
    """How many users' spans of events cover each day that has an event: +1 where a span begins, -1 after its end, and a running sum over days."""
    e = _t(s, d, "events").select("user_id", F.to_date("ts").alias("day"))
    spans = e.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    steps = spans.select(F.explode(F.array(F.struct(F.col("a").alias("day"), F.lit(1).alias("step")), F.struct(F.date_add("b", 1).alias("day"), F.lit(-1).alias("step"))))).select("col.*")
    days = steps.groupBy("day").agg(F.sum("step").alias("step")).unionByName(e.select("day", F.lit(0).cast("long").alias("step")).distinct().withColumn("step", F.lit(0).cast("long")))
    by_day = days.groupBy("day").agg(F.sum("step").alias("step"))  # one row a day from here on
    open_ = by_day.select("day", F.sum("step").over(Window.orderBy("day")).alias("open"))
    return open_.join(e.select("day").distinct(), "day", "left_semi").where("open > 0").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "open")


def sessions_by_gap(s, d):
    """Sessionization: a new visit after six hours without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = _t(s, d, "events").withColumn("new", F.coalesce(micros - F.lag(micros).over(w) > 6 * 3600 * 1000000, F.lit(True)).cast("int"))
    v = e.withColumn("visit", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return v.groupBy("user_id", "visit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"))


def pricing_summary(s, d):
    """The flagship: grouped sums over the largest table."""
    li = _t(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price, disc = _money(F.col("l_extendedprice")), F.round((1 - F.col("l_discount")) * 100).cast("long")
    return li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum(price).alias("price_cents"), F.sum(price * disc).alias("net"), F.avg("l_quantity").alias("avg_quantity"))


def playground(s, d, label: str = "row"):
    """Numbered rows under a label that is a parameter, one for each customer."""
    n = F.col("c_custkey").cast("long")
    return _t(s, d, "customer").select(n.alias("n"), F.concat_ws(" ", F.lit(label), n.cast("string")).alias("label"), (n * n).alias("square"))


def self_count(s, d):
    """How many suppliers share a supplier's nation: a relation counted inside a callback over itself."""
    r = Database(s, {"supplier": _t(s, d, "supplier")}).table("supplier")
    return r.select(lambda t: {"s_suppkey": t.s_suppkey, "peers": r.where(lambda u: u.s_nationkey.eq(t.s_nationkey)).count()}).build()


def declared_source(s, d, least: float = 300000.0):
    """Large orders of a declared source, all of whose rows are checked in the one scan."""
    source = Database(s, {"orders": _t(s, d, "orders")}).sql("SELECT o_orderkey, o_custkey, o_totalprice FROM {orders}", columns={"o_orderkey": "integer", "o_custkey": "integer", "o_totalprice": "number"})
    return source.where(lambda o: o.o_totalprice.gt(least)).select(lambda o: {"o_orderkey": o.o_orderkey, "o_totalprice": o.o_totalprice}).build()


RELATIONAL = {
    "shw_21": (playground, "SELECT CAST(c_custkey AS BIGINT) AS n, 'row ' || c_custkey AS label, CAST(c_custkey AS BIGINT) * CAST(c_custkey AS BIGINT) AS square FROM customer"),
    "rel_07_self_count": (self_count, "SELECT a.s_suppkey, (SELECT count(*) FROM supplier b WHERE b.s_nationkey = a.s_nationkey) AS peers FROM supplier a"),
    "rel_17_declared_source": (declared_source, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000"),
    "sql_01_projection": (projection, "SELECT p_partkey, upper(p_brand) AS brand, CAST(p_size * 2 + 1 AS BIGINT) AS size2 FROM part"),
    "sql_02_filters": (filters, "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name NOT ILIKE '%7%'"),
    "sql_04_inner_join": (inner_join, "SELECT c_mktsegment, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "sql_05_left_join": (left_join, "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "sql_06_theta_join": (theta_join, "SELECT a.s_suppkey AS a, count(b.s_suppkey) AS richer FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal GROUP BY 1"),
    "sql_08_semi_flag": (semi_flag, "SELECT c_custkey, CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS INT) AS large FROM customer"),
    "sql_09_anti_join": (anti_join, "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "sql_10_latest_per_key": (latest_per_key, "SELECT o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1"),
    "sql_11_json_children": (json_children, "SELECT r_name, CAST(to_json(list_sort(list(n_name))) AS VARCHAR) AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "sql_13_grouped": (grouped, "SELECT l_returnflag, year(l_shipdate) AS \"year\", count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, min(l_discount) AS least, max(l_discount) AS most, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) FILTER (WHERE l_tax > 0.04::DOUBLE) AS taxed FROM lineitem GROUP BY 1, 2"),
    "sql_16_having": (having, "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1 HAVING sum(CAST(l_quantity AS BIGINT)) > 200"),
    "sql_17_joined_text": (joined_text, "SELECT CAST(p_size AS BIGINT) AS size, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1"),
    "sql_18_distinct": (distinct_rows, "SELECT DISTINCT l_returnflag, CAST(l_linenumber AS BIGINT) AS line FROM lineitem"),
    "sql_20_numbered": (numbered, "SELECT o_custkey, o_orderkey, r, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) x WHERE r <= 2"),
    "sql_21_windows": (windows, "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rank, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dense, ntile(4) OVER w AS quarter, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "sql_24_set_operations": (set_operations, "WITH a AS (SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer), b AS (SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier) SELECT k, 'union' AS op FROM (SELECT k FROM a UNION SELECT k FROM b) x UNION ALL SELECT k, 'intersect' FROM (SELECT k FROM a INTERSECT SELECT k FROM b) y UNION ALL SELECT k, 'except' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) z"),
    "sql_25_nulls_order": (nulls_order, "SELECT c_custkey, max(o_orderkey) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY last_order NULLS LAST, c_custkey"),
    "sql_26_top_k": (top_k, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5"),
    "sql_cube": (cube_totals, "SELECT l_returnflag, CAST(l_linenumber AS BIGINT) AS line, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linenumber) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linenumber)"),
    "sql_pivot": (pivoted, "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1"),
    "fn_scalar": (scalar_functions, "SELECT doc_id, coalesce(nullif(lang, 'en'), '-') AS lang, substr(text, -5, 3) AS tail, sha256(lower(text)) AS low, length(text) AS chars, CAST(strlen(text) AS BIGINT) AS bytes, CAST(instr(text, 'the') AS BIGINT) AS at, hex(source) AS hexed, concat_ws('|', source, lang) AS both, round(n_chars / 7, 2) AS sevenths, CAST(NULL AS BIGINT) AS none, n_chars // 7 AS whole, sha256(text) AS sha, TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS number FROM documents"),
    "fn_dates": (dates, "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, any_value(CAST(isodow(o_orderdate) - 1 AS BIGINT)) AS weekday, count(*) AS n FROM orders GROUP BY 1"),
    "fn_json": (json_values, "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1"),
    "sql_intervals": (ranges, "WITH s AS (SELECT user_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events GROUP BY 1), d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS open FROM d JOIN s ON day BETWEEN a AND b GROUP BY 1"),
    "sql_sessionize": (sessions_by_gap, "WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS f FROM events), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM a) SELECT user_id, CAST(visit AS BIGINT) AS visit, count(*) AS n, count(DISTINCT event_type) AS kinds FROM b GROUP BY 1, 2"),
    "q1_pricing": (pricing_summary, "SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS price_cents, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS net, avg(l_quantity) AS avg_quantity FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1"),
}
