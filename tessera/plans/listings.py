"""Filters, joins, set operations, sorts and plain aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.relational import cell_changes, keep_first, latest, page
from ..sources.tables import table
from .registry import query


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def daily_event_rollup(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 300000 ORDER BY o_orderkey LIMIT 50 OFFSET 50")
def filtered_page(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'O' and o_totalprice between 1000 and 300000")
    return page(o, [F.col("o_orderkey")], 2, 50).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%00012%' OR lower(c_mktsegment) LIKE '%build%'")
def search_ci(spark, d):
    has = lambda c, x: F.lower(c).contains(x)
    return table(spark, d, "customer").where(has("c_name", "00012") | has("c_mktsegment", "build")).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice > l_quantity * 1000")
def column_predicate(spark, d):
    return table(spark, d, "lineitem").where("l_extendedprice > l_quantity * 1000").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1996-03-01'")
def half_open_month(spark, d):
    return table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'1996-02-01 00:00:00' and o_orderdate < timestamp_ntz'1996-03-01 00:00:00'").select("o_orderkey")


@query("SELECT coalesce(n_name, 'unassigned') AS nation, count(*) AS customers FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey GROUP BY 1")
def lookup_left_unassigned(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 20")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.coalesce("n_name", F.lit("unassigned")).alias("nation")).agg(F.count("*").alias("customers"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def semi_nested(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 1")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-06-01')")
def anti_inactive(spark, d):
    recent = table(spark, d, "orders").where("o_orderdate >= timestamp_ntz'2000-06-01 00:00:00'")
    return table(spark, d, "customer").join(recent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""WITH m AS (SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS m, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, a.q AS before, b.q AS after,
  CASE WHEN a.q IS NULL THEN 'added' WHEN b.q IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM (SELECT * FROM m WHERE m = '1996-01') a FULL JOIN (SELECT * FROM m WHERE m = '1996-02') b ON a.l_partkey = b.l_partkey
WHERE a.q IS DISTINCT FROM b.q""")
def full_outer_cells(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("m")).agg(F.sum("l_quantity").alias("q"))
    return cell_changes(m.where("m = '1996-01'"), m.where("m = '1996-02'"), ["l_partkey"], "q")


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE year(l_shipdate) = 1995), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE year(l_shipdate) = 2001)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'all rows', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def set_ops(spark, d):
    years = table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y")).where("y in (1995, 2001)")
    # One pass: which of the two years has each key.
    has = years.groupBy("l_partkey").agg(F.max((F.col("y") == 1995).cast("int")).alias("a"), F.max((F.col("y") == 2001).cast("int")).alias("b"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sums = has.agg(n((F.col("a") == 1) & (F.col("b") == 1)).alias("x"), n((F.col("a") == 1) & (F.col("b") == 0)).alias("y"), F.count("*").alias("z"), n(F.col("a") + F.col("b")).alias("w"))
    return sums.selectExpr("stack(4, 'both', x, 'first only', y, 'either', z, 'all rows', w) as (part, n)")


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, md5(text) AS text_md5 FROM documents GROUP BY text")
def dedupe_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("text_md5"))
    return keep_first(docs, ["text_md5"], "doc_id").select("doc_id", "source", "text_md5")


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1""")
def summary_buckets(spark, d):
    c = lambda x: F.count_if(F.expr(x))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), c("o_orderstatus = 'F'").alias("filled"), c("o_orderstatus = 'O'").alias("open_"), c("o_totalprice > 200000").alias("large"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def three_way_groupings(spark, d):
    o = table(spark, d, "orders")
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return o.groupingSets(sets, F.col("o_orderstatus"), F.col("o_orderpriority")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(spark, d):
    return latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT round(avg(n), 4) AS mean_orders FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def two_level_avg(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").count().agg(F.round(F.avg("count"), 4).alias("mean_orders"))


@query("""SELECT coalesce(n_name, 'UNASSIGNED') AS nation, round(sum(l_extendedprice), 2) AS gross, round(sum(l_extendedprice * l_discount), 2) AS discount, round(sum(l_extendedprice * (1 - l_discount) * l_tax), 2) AS tax
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def journal_by_group(spark, d):
    # Sums by supplier first, so that the join sees one row for each.
    money = lambda x: F.sum(F.expr(x))
    by = table(spark, d, "lineitem").groupBy("l_suppkey").agg(money("l_extendedprice").alias("g"), money("l_extendedprice * l_discount").alias("x"), money("l_extendedprice * (1 - l_discount) * l_tax").alias("t"))
    j = by.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy(F.coalesce("n_name", F.lit("UNASSIGNED")).alias("nation")).agg(*[F.round(F.sum(a), 2).alias(b) for a, b in (("g", "gross"), ("x", "discount"), ("t", "tax"))])


@query("""SELECT r_name, round(sum(o_totalprice), 2) AS revenue, round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 4) AS share
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def share_of_total(spark, d):
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    j = by.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = j.groupBy("r_name").agg(F.sum("s").alias("s"))
    return g.select("r_name", F.round("s", 2).alias("revenue"), F.round(100 * F.col("s") / F.sum("s").over(Window.partitionBy()), 4).alias("share"))


@query("SELECT quality, toxic, count(*) AS n, count(DISTINCT source) AS sources FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def label_agreement(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
