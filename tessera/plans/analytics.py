"""Snapshots, bands, scores, money and windows over business tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.measure import band, fiscal_quarter, fiscal_year, half_up, haversine, iou, rounded_pay
from ..functions.scoring import z_class
from ..operators.scans import medians
from ..sources.tables import table
from .registry import query


def _monthly(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("revenue"))


@query("SELECT year(o_orderdate - INTERVAL 3 MONTH) AS fy, quarter(o_orderdate - INTERVAL 3 MONTH) AS fq, count(*) AS n FROM orders GROUP BY 1, 2")
def fiscal_quarter_orders(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").groupBy(fiscal_year(day).cast("long").alias("fy"), fiscal_quarter(day).cast("long").alias("fq")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN GROUPING(c_mktsegment) = 0 THEN 'segment' WHEN GROUPING(nation) = 0 THEN 'nation' WHEN GROUPING(b) = 0 THEN 'band' ELSE 'total' END AS dimension, coalesce(c_mktsegment, nation, b, 'all') AS member, count(*) AS headcount, floor(CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) + 0.5) / 100 AS mean
FROM (SELECT c_mktsegment, n_name AS nation, CASE WHEN c_acctbal < 0 THEN '<0' WHEN c_acctbal < 2500 THEN '0-2500' WHEN c_acctbal < 5000 THEN '2500-5000' ELSE '5000+' END AS b, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)
GROUP BY GROUPING SETS ((c_mktsegment), (nation), (b), ())""")
def headcount_snapshot(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_mktsegment", F.col("n_name").alias("nation"), band(F.col("c_acctbal"), [0, 2500, 5000], ["<0", "0-2500", "2500-5000", "5000+"]).alias("b"), "c_acctbal")
    cols = [F.col("c_mktsegment"), F.col("nation"), F.col("b")]
    g = c.groupingSets([[x] for x in cols] + [[]], *cols).agg(F.grouping_id().alias("gid"), F.count("*").alias("headcount"), (F.floor(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).cast("double") / F.count("*") + 0.5) / 100).alias("mean"))
    kind = F.when(F.col("gid") == 3, "segment").when(F.col("gid") == 5, "nation").when(F.col("gid") == 6, "band").otherwise("total")
    return g.select(kind.alias("dimension"), F.coalesce("c_mktsegment", "nation", "b", F.lit("all")).alias("member"), "headcount", "mean")


@query("""SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users, floor(CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / count(*) + 0.5) / 10000 AS mean, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_share FROM events GROUP BY 1""")
def attendance_snapshot(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("users"), (F.floor(F.sum(F.round(F.col("value") * 10000).cast("long")).cast("double") / F.count("*") + 0.5) / 10000).alias("mean"), F.round(100 * F.count_if(F.col("event_type") == "error") / F.count("*"), 4).alias("error_share"))


@query("""SELECT c_mktsegment, round(median(c_acctbal), 2) AS median, round(min(c_acctbal), 2) AS least, round(max(c_acctbal), 2) AS most, count(*) FILTER (WHERE c_acctbal < 3000) AS low, count(*) FILTER (WHERE c_acctbal >= 3000) AS high FROM customer GROUP BY 1""")
def median_bands(spark, d):
    """Exact medians by ranks of a scan in parts, as a segment may hold any share of the rows."""
    b, c = F.col("c_acctbal"), table(spark, d, "customer")
    middle = medians(c, "c_mktsegment", "c_acctbal", "c_custkey").select("c_mktsegment", F.round("median", 2).alias("median"))
    rest = c.groupBy("c_mktsegment").agg(F.round(F.min(b), 2).alias("least"), F.round(F.max(b), 2).alias("most"), F.count_if(b < 3000).alias("low"), F.count_if(b >= 3000).alias("high"))
    return rest.join(middle, "c_mktsegment")


@query("""WITH r AS (SELECT user_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) AS s FROM events GROUP BY 1)
SELECT stage, count(*) FILTER (WHERE s >= stage) AS reached FROM r, (VALUES (1), (2), (3), (4)) t(stage) GROUP BY stage""")
def funnel(spark, d):
    rank = F.expr("case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 when 'purchase' then 4 else 0 end")
    r = table(spark, d, "events").groupBy("user_id").agg(F.max(rank).alias("s")).groupBy("s").count()
    sums = r.agg(*[F.coalesce(F.sum(F.when(F.col("s") >= i, F.col("count"))), F.lit(0)).alias(f"s{i}") for i in range(1, 5)])
    return sums.selectExpr("stack(4, 1, s1, 2, s2, 3, s3, 4, s4) as (stage, reached)")


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE age <= 30) AS current, count(*) FILTER (WHERE age > 30 AND age <= 60) AS d60, count(*) FILTER (WHERE age > 60 AND age <= 90) AS d90, count(*) FILTER (WHERE age > 90) AS older
FROM (SELECT o_orderstatus, date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS age FROM orders) GROUP BY 1""")
def ageing(spark, d):
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))  # one row
    age = F.datediff(F.to_date("last"), F.to_date("o_orderdate"))
    a = o.join(F.broadcast(last)).withColumn("age", age)
    c = lambda x: F.count_if(F.expr(x))
    return a.groupBy("o_orderstatus").agg(c("age <= 30").alias("current"), c("age > 30 and age <= 60").alias("d60"), c("age > 60 and age <= 90").alias("d90"), c("age > 90").alias("older"))


@query("""SELECT c_mktsegment, c_custkey, round(s, 2) AS revenue, r AS place FROM (SELECT c_mktsegment, c_custkey, sum(o_totalprice) AS s, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(sum(o_totalprice), 2) DESC, c_custkey) AS r
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE r <= 5""")
def top_customers(spark, d):
    by = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    j = by.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("revenue"), "c_custkey")
    return j.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("c_mktsegment", "c_custkey", "revenue", "place")


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)
SELECT month, round(revenue, 2) AS revenue, CASE WHEN p > 0 THEN round(100 * (revenue - p) / p, 2) ELSE 0 END AS change, CASE WHEN p IS NULL OR revenue = p THEN 'neutral' WHEN revenue > p THEN 'up' ELSE 'down' END AS direction
FROM (SELECT *, lag(revenue) OVER (ORDER BY month) AS p FROM m)""")
def mom_change(spark, d):
    # One row a month: the window over all of them is small whatever the table's size.
    m = _monthly(spark, d).withColumn("p", F.lag("revenue").over(Window.orderBy("month")))
    r, p = F.col("revenue"), F.col("p")
    return m.select("month", F.round(r, 2).alias("revenue"), F.when(p > 0, F.round(100 * (r - p) / p, 2)).otherwise(0.0).alias("change"), F.when(p.isNull() | (r == p), "neutral").when(r > p, "up").otherwise("down").alias("direction"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1),
w AS (SELECT month, v, avg(v) OVER h AS m, stddev_pop(v) OVER h AS s, count(*) OVER h AS n FROM m WINDOW h AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT month, CASE WHEN n < 3 THEN NULL WHEN s = 0 AND v <> m THEN 'HIGH' WHEN s = 0 THEN 'NORMAL' WHEN abs(v - m) / s > 2 THEN 'HIGH' WHEN abs(v - m) / s > 1.5 THEN 'MEDIUM' ELSE 'NORMAL' END AS anomaly FROM w""")
def rolling_zscore(spark, d):
    w = Window.orderBy("month").rowsBetween(-6, -1)
    m = _monthly(spark, d)
    return m.select("month", z_class(F.col("revenue"), F.avg("revenue").over(w), F.stddev_pop("revenue").over(w), F.count("*").over(w)).alias("anomaly"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS balance FROM events")
def running_balance(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 2).alias("balance"))


@query("SELECT o_orderkey, 'INV-' || year(o_orderdate) || '-' || lpad(CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS VARCHAR))) AS INTEGER), '0') AS invoice FROM orders")
def invoice_numbers(spark, d):
    """Numbered by order of creation within a year: a rank within the day, after the counts of the days before."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"), F.to_date("o_orderdate").alias("day"))
    # One row a day: the running count of the year is small whatever the table's size.
    days = o.groupBy("y", "day").count()
    before = days.select("day", F.coalesce(F.sum("count").over(Window.partitionBy("y").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    n = (F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("o_orderdate", "o_orderkey"))).cast("string")
    return o.join(F.broadcast(before), "day").select("o_orderkey", F.concat(F.lit("INV-"), "y", F.lit("-"), F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0"))).alias("invoice"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 50000 THEN 0.0 WHEN o_totalprice <= 150000 THEN 150.0 WHEN o_totalprice <= 300000 THEN 200.0 ELSE 250.0 END AS slab FROM orders""")
def slab_lookup(spark, d):
    """The first slab whose upper bound isn't exceeded; the few slabs are a chain of conditions, so nothing is joined."""
    p, out = F.col("o_totalprice"), F.lit(250.0)
    for bound, slab in ((300_000, 200.0), (150_000, 150.0), (50_000, 0.0)):
        out = F.when(p <= bound, slab).otherwise(out)
    return table(spark, d, "orders").select("o_orderkey", out.alias("slab"))


@query("""SELECT c_custkey, CASE WHEN 2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) <= 500000 THEN 'INSIDE' ELSE 'OUTSIDE' END AS fence FROM
(SELECT c_custkey, pow(sin(radians(lat - 10) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(lon - 20) / 2), 2) AS h FROM (SELECT c_custkey, c_nationkey * 1.0 AS lat, (c_custkey % 40) * 1.0 AS lon FROM customer))""")
def geofence(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("lat"), (F.col("c_custkey") % 40).cast("double").alias("lon"))
    metres = haversine(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    return c.select("c_custkey", F.when(metres <= 500_000, "INSIDE").otherwise("OUTSIDE").alias("fence"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN w > 0 AND h > 0 THEN w * h / (2 * (0.1 + l_tax) * 0.2 - w * h) ELSE 0 END, 6) AS iou FROM
(SELECT *, 0.1 + l_tax - l_discount * 2 AS w, 0.2 - (l_partkey % 30) / 100.0 AS h FROM lineitem)""")
def bbox_iou(spark, d):
    """Overlap of every line's box with the same box moved right and down."""
    size = {"width": F.lit(0.1) + F.col("l_tax"), "height": F.lit(0.2)}
    box = lambda x, y: F.struct(x.alias("x"), y.alias("y"), *[v.alias(n) for n, v in size.items()])
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box(F.lit(0.0), F.lit(0.0)).alias("a"), box(F.col("l_discount") * 2, (F.col("l_partkey") % 30) / 100.0).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", F.round(iou("a", "b"), 6).alias("iou"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN same THEN floor(half + 0.5) / 100 ELSE 0 END AS cgst, CASE WHEN same THEN floor(half + 0.5) / 100 ELSE 0 END AS sgst, CASE WHEN same THEN 0 ELSE floor(tax + 0.5) / 100 END AS igst, missing
FROM (SELECT *, cents * 9 / 100.0 AS half, cents * 18 / 100.0 AS tax FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, coalesce(c_nationkey = s_nationkey, false) AS same, c_nationkey IS NULL OR s_nationkey IS NULL AS missing
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey))""")
def gst_split(spark, d):
    """Two equal shares within a state, each rounded to 2 digits, else one; without a state on either side the flag is set."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_nationkey")
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    same = F.coalesce(F.col("c_nationkey") == F.col("s_nationkey"), F.lit(False))
    half, whole = F.floor(cents * 9 / 100.0 + 0.5) / 100, F.floor(cents * 18 / 100.0 + 0.5) / 100
    missing = F.col("c_nationkey").isNull() | F.col("s_nationkey").isNull()
    return j.select("l_orderkey", "l_linenumber", F.when(same, half).otherwise(0.0).alias("cgst"), F.when(same, half).otherwise(0.0).alias("sgst"), F.when(same, 0.0).otherwise(whole).alias("igst"), missing.alias("missing"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_retailprice * 2 END, CASE WHEN p_brand = 'Brand#2' THEN p_retailprice * 10 END, p_retailprice) AS price FROM part")
def pricing_cascade(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 40, p * 2), F.when(F.col("p_brand") == "Brand#2", p * 10), p).alias("price"))


@query("""SELECT c_custkey, floor(v + 0.5) AS rupee, floor(v * 2 + 0.5) / 2 AS half, floor(v * 100.0 + 0.5) / 100.0 AS paise FROM (SELECT c_custkey, c_acctbal / 8 AS v FROM customer)""")
def rounding_rules(spark, d):
    """Balances, negative ones too, rounded half up to whole, half and hundredth units."""
    v = F.col("v")
    df = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 8).alias("v"))
    return df.select("c_custkey", *[rounded_pay(v, m).cast("double").alias(m) for m in ("rupee", "half", "paise")])


@query("""WITH s AS (SELECT l_suppkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, avg(l_discount) AS disc FROM lineitem GROUP BY 1)
SELECT l_suppkey, floor(least(100, greatest(0, 60 * (1 - returned / lines) + 40 * (1 - disc * 10))) + 0.5) AS score FROM s""")
def vendor_scorecard(spark, d):
    # A sum of decimals is the same in any order; one of doubles moved scores at a half by the order of the tasks.
    # What no such decimal holds (NaN, infinities, huge numbers) is summed as it is. Lines without a discount don't count in its mean.
    x, usual = F.col("l_discount"), F.abs("l_discount") < 1e15
    sums = [F.sum(F.when(usual, x).cast("decimal(28,12)")).cast("double"), F.sum(F.when(~usual, x))]
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("l_discount").alias("known"), *[v.alias(n) for v, n in zip(sums, ("exact", "other"), strict=True)])
    s = s.withColumn("disc", F.when(F.col("known") > 0, (F.coalesce("exact", F.lit(0.0)) + F.coalesce("other", F.lit(0.0))) / F.col("known")))
    raw = 60 * (1 - F.col("returned") / F.col("lines")) + 40 * (1 - F.col("disc") * 10)
    return s.select("l_suppkey", half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))).alias("score"))
