"""Scores, rates, insights, alerts and calendars over people and their activity."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.measure import half_up
from ..operators.relational import page
from ..sources.tables import table
from .registry import query


def _customers(spark, d):
    """Customers with their numbers of orders, the cents ordered and the day of the last order."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.max("o_orderdate").alias("last"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumns({"n": F.coalesce("n", F.lit(0)), "cents": F.coalesce("cents", F.lit(0))})


_SQL_CUSTOMERS = "(SELECT c.*, coalesce(n, 0) AS n, coalesce(cents, 0) AS cents, last FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON c_custkey = o_custkey)"


@query(f"""SELECT c_custkey, CAST(least(100, CASE WHEN last IS NULL OR last < DATE '2000-01-01' THEN 25 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN 20 ELSE 0 END + CASE WHEN n < 5 THEN 20 ELSE 0 END + CASE WHEN cents < 100000000 THEN 15 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 0 END + CASE WHEN c_nationkey % 5 = 0 THEN 10 ELSE 0 END) AS INTEGER) AS score,
concat_ws(',', CASE WHEN last IS NULL OR last < DATE '2000-01-01' THEN 'inactive' END, CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN n < 5 THEN 'few_orders' END, CASE WHEN cents < 100000000 THEN 'low_value' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END, CASE WHEN c_nationkey % 5 = 0 THEN 'site' END) AS factors FROM {_SQL_CUSTOMERS}""")
def attrition_risk(spark, d):
    """Points of the risk factors that hold, capped at 100, and their names."""
    c = F.col
    points = [(c("last").isNull() | (c("last") < F.lit("2000-01-01").cast("timestamp_ntz")), 25, "inactive"), (c("c_acctbal") < 0, 20, "balance"), (c("n") < 5, 20, "few_orders"), (c("cents") < 100_000_000, 15, "low_value"), (c("c_mktsegment") == "BUILDING", 10, "segment"), (c("c_nationkey") % 5 == 0, 10, "site")]
    score = F.least(F.lit(100), sum((F.when(x, p).otherwise(0) for x, p, _ in points), F.lit(0)))
    return _customers(spark, d).select("c_custkey", score.alias("score"), F.concat_ws(",", *[F.when(x, F.lit(name)) for x, _, name in points]).alias("factors"))


@query(f"""SELECT n_nationkey, CAST(floor(greatest(0, least(100, (30 * active + 25 * solvent + 20 * busy + 15 * CASE WHEN satisfied = 0 THEN 50 ELSE satisfied END + 10 * large) / 100.0)) + 0.5) AS BIGINT) AS score FROM
(SELECT c_nationkey AS n_nationkey, 100 * count(*) FILTER (WHERE n > 0) // count(*) AS active, 100 * count(*) FILTER (WHERE c_acctbal >= 0) // count(*) AS solvent, 100 * count(*) FILTER (WHERE n >= 10) // count(*) AS busy, 100 * count(*) FILTER (WHERE c_acctbal > 9900) // count(*) AS satisfied, 100 * count(*) FILTER (WHERE cents > 200000000) // count(*) AS large FROM {_SQL_CUSTOMERS} GROUP BY 1)""")
def manager_score(spark, d):
    """Five weighted percentages, a missing satisfaction (0) counted as 50, clamped and rounded."""
    share = lambda x, name: F.expr(f"100 * count_if({x}) div count(*)").alias(name)
    g = _customers(spark, d).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(share("n > 0", "active"), share("c_acctbal >= 0", "solvent"), share("n >= 10", "busy"), share("c_acctbal > 9900", "satisfied"), share("cents > 200000000", "large"))
    satisfied = F.when(F.col("satisfied") == 0, 50).otherwise(F.col("satisfied"))
    raw = (30 * F.col("active") + 25 * F.col("solvent") + 20 * F.col("busy") + 15 * satisfied + 10 * F.col("large")) / 100.0
    return g.select("n_nationkey", half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).cast("long").alias("score"))


@query("""SELECT day, floor(CASE WHEN users = 0 THEN 0 ELSE hours / (users * 8.0) END * 100 + 0.5) / 100 AS productivity, CASE WHEN hours / (users * 8.0) < 0.7 THEN 'UNDER' WHEN hours / (users * 8.0) > 1.2 THEN 'OVER' ELSE 'NORMAL' END AS class FROM
(SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(floor(value) AS BIGINT) % 24) AS DOUBLE) AS hours, count(DISTINCT user_id) AS users FROM events GROUP BY 1)""")
def productivity_index(spark, d):
    """Hours against active users times 8; classed before rounding."""
    g = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.floor("value") % 24).cast("double").alias("hours"), F.countDistinct("user_id").alias("users"))
    x = F.coalesce(F.try_divide("hours", F.col("users") * 8.0), F.lit(0.0))
    return g.select("day", half_up(x, 2).alias("productivity"), F.when(x < 0.7, "UNDER").when(x > 1.2, "OVER").otherwise("NORMAL").alias("class"))


@query("""SELECT l_suppkey, CAST(floor((40 * on_time + 20 * CASE WHEN open_ = 0 THEN 100 ELSE closed * 100 // open_ END + 15 * kept + 15 * exact + 10 * CASE WHEN big = 0 THEN 100 ELSE big_ok * 100 // big END) / 100.0 + 0.5) AS BIGINT) AS score FROM
(SELECT l_suppkey, 100 * count(*) FILTER (WHERE l_tax <= 0.04) // count(*) AS on_time, count(*) FILTER (WHERE l_linestatus = 'O') AS open_, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'N') AS closed, 100 * count(*) FILTER (WHERE l_returnflag <> 'R') // count(*) AS kept, 100 * count(*) FILTER (WHERE l_discount <= 0.05) // count(*) AS exact, count(*) FILTER (WHERE l_quantity > 45) AS big, count(*) FILTER (WHERE l_quantity > 45 AND l_returnflag = 'A') AS big_ok FROM lineitem GROUP BY 1)""")
def compliance_score(spark, d):
    """Weights .40, .20, .15, .15, .10; a ratio without anything to count scores 100."""
    n, share = (lambda x, a: F.expr(f"count_if({x})").alias(a)), (lambda x, a: F.expr(f"100 * count_if({x}) div count(*)").alias(a))
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(share("l_tax <= 0.04", "on_time"), n("l_linestatus = 'O'", "open"), n("l_linestatus = 'O' and l_returnflag = 'N'", "closed"), share("l_returnflag <> 'R'", "kept"), share("l_discount <= 0.05", "exact"), n("l_quantity > 45", "big"), n("l_quantity > 45 and l_returnflag = 'A'", "big_ok"))
    guarded = lambda a, b: F.when(F.col(b) == 0, 100).otherwise(F.expr(f"{a} * 100 div {b}"))
    raw = (40 * F.col("on_time") + 20 * guarded("closed", "open") + 15 * F.col("kept") + 15 * F.col("exact") + 10 * guarded("big_ok", "big")) / 100.0
    return g.select("l_suppkey", half_up(raw).cast("long").alias("score"))


@query("""SELECT count(*) FILTER (WHERE today) AS expected, count(*) FILTER (WHERE today AND event_type = 'signup') AS checked_in, count(*) FILTER (WHERE today AND event_type = 'purchase') AS out_, count(*) FILTER (WHERE event_type = 'signup') AS on_site, count(*) FILTER (WHERE today AND event_type = 'error') AS no_show, count(*) FILTER (WHERE today AND event_type = 'view' AND value > 50) AS overstaying
FROM (SELECT *, CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events) AS today FROM events)""")
def today_stats(spark, d):
    """Counts of the last day in one pass over the events; on_site alone ignores the day."""
    e = table(spark, d, "events")
    last = e.agg(F.to_date(F.max("ts")).alias("last"))  # one row
    n = lambda x, a: F.coalesce(F.sum(F.when(F.expr(x), 1).otherwise(0)), F.lit(0)).alias(a)
    t = e.join(F.broadcast(last)).withColumn("today", F.to_date("ts") == F.col("last"))
    return t.agg(n("today", "expected"), n("today and event_type = 'signup'", "checked_in"), n("today and event_type = 'purchase'", "out_"), n("event_type = 'signup'", "on_site"), n("today and event_type = 'error'", "no_show"), n("today and event_type = 'view' and value > 50", "overstaying"))


@query("""SELECT o_orderpriority, CASE WHEN done = 0 THEN 0 ELSE floor(100.0 * good / done + 0.5) END AS completed_rate, CASE WHEN required = 0 THEN 100 ELSE floor(100.0 * met / required + 0.5) END AS required_rate FROM
(SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS good, count(*) FILTER (WHERE o_totalprice > 499000) AS required, count(*) FILTER (WHERE o_totalprice > 499000 AND o_orderstatus = 'O') AS met FROM orders GROUP BY 1)""")
def guarded_rates(spark, d):
    """Whole percents; nothing completed is 0, nothing required is 100."""
    n = lambda x, a: F.count_if(F.expr(x)).alias(a)
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(n("o_orderstatus = 'F'", "done"), n("o_orderstatus = 'F' and o_totalprice > 100000", "good"), n("o_totalprice > 499000", "required"), n("o_totalprice > 499000 and o_orderstatus = 'O'", "met"))
    rate = lambda a, b, none: F.when(F.col(b) == 0, F.lit(float(none))).otherwise(F.floor(100.0 * F.col(a) / F.col(b) + 0.5).cast("double"))
    return g.select("o_orderpriority", rate("good", "done", 0).alias("completed_rate"), rate("met", "required", 100).alias("required_rate"))


@query("""WITH f AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT year(b) AS y, count(*) AS leavers, count(*) FILTER (WHERE date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) < 365) AS early, floor(10000.0 * count(*) / (SELECT count(*) FROM f) + 0.5) / 100 AS rate FROM f WHERE b < DATE '2001-06-01' GROUP BY 1""")
def attrition_snapshot(spark, d):
    """Last orders as exits: by year, those within a year of the first, and the rate against all."""
    f = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    gone = F.col("b") < F.lit("2001-06-01").cast("timestamp_ntz")
    # Those still there are a group of their own, so that the base needs no second pass.
    g = f.groupBy(F.when(gone, F.year("b")).cast("long").alias("y")).agg(F.count("*").alias("leavers"), F.count_if(F.datediff(F.to_date("b"), F.to_date("a")) < 365).alias("early"))
    rate = F.floor(10000.0 * F.col("leavers") / F.sum("leavers").over(Window.partitionBy()) + 0.5) / 100
    return g.select("y", "leavers", "early", rate.alias("rate")).where("y is not null")


def _metrics(spark, d):
    """One row a month of 1996 and later: errors, late events and overtime as shares of all."""
    n = lambda x, a: F.count_if(F.expr(x)).alias(a)
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), n("event_type = 'view'", "present"), n("hour(ts) >= 20", "late"), n("event_type = 'error'", "errors"), n("value > 90", "overtime"))


_SQL_METRICS = "(SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS present, count(*) FILTER (WHERE hour(ts) >= 20) AS late, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 90) AS overtime FROM events GROUP BY 1)"
#: Rules as (name, category, condition, measured change); a rule is a row of data, not code.
INSIGHTS = [("low_attendance", "critical", "100 * present < 70 * total", "present - total"), ("high_late_arrivals", "warning", "100 * late > 15 * total", "late"), ("error_spike", "warning", "100 * errors > 20 * total", "errors"), ("high_overtime", "info", "overtime > 0", "overtime"), ("no_errors", "positive", "errors = 0", "0")]
CATEGORIES = ["critical", "warning", "info", "positive"]


def insights(metrics, rules=INSIGHTS):
    """(day, rule, category, change) of every rule that holds: one pass, the rules as an array of structs."""
    hits = F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(k).alias("category"), F.expr(x).cast("long").alias("change"), F.lit(i).alias("place"))) for i, (n, k, c, x) in enumerate(rules)])
    return metrics.select("day", F.explode(F.array_compact(hits)).alias("h")).select("day", "h.*")


def ranked(hits, keys, most=5):
    """The first insights by category, then by the size of the change (null is 0), then as they come."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    w = Window.partitionBy(*keys).orderBy(rank, F.desc(F.abs(F.coalesce("change", F.lit(0)))), "place")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


_SQL_HITS = " UNION ALL ".join(f"SELECT day, '{n}' AS rule, '{k}' AS category, CAST({x} AS BIGINT) AS change, {i} AS place FROM {_SQL_METRICS} WHERE {c}" for i, (n, k, c, x) in enumerate(INSIGHTS))


@query(f"""SELECT day, rule, category, change, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY list_position(['critical', 'warning', 'info', 'positive'], category), abs(coalesce(change, 0)) DESC, place) AS INTEGER) AS rank FROM ({_SQL_HITS})) WHERE rank <= 5""")
def insight_rank(spark, d):
    return ranked(insights(_metrics(spark, d)), ["day"]).select("day", "rule", "category", "change", "rank")


@query(f"""SELECT day, rule, severity, expires, place FROM (SELECT day, rule, severity, day + CAST(hours // 24 AS INTEGER) AS expires, CAST(row_number() OVER (ORDER BY list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity), day DESC, rule) AS INTEGER) AS place,
lag(day + CAST(hours // 24 AS INTEGER)) OVER (PARTITION BY rule ORDER BY day) AS before FROM (SELECT day, 'error_spike' AS rule, 'HIGH' AS severity, 720 AS hours FROM {_SQL_METRICS} WHERE 100 * errors > 20 * total UNION ALL SELECT day, 'attendance_drop', 'MEDIUM', 24 FROM {_SQL_METRICS} WHERE 100 * present < 40 * total)) WHERE true""")
def alert_rules(spark, d):
    """Alerts with severity and expiry, most severe first (by rank, not by name), newest first."""
    rules = [("error_spike", "HIGH", "100 * errors > 20 * total", "720"), ("attendance_drop", "MEDIUM", "100 * present < 40 * total", "24")]
    hits = insights(_metrics(spark, d), rules)
    severity = F.array_position(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]), F.col("category"))
    # One row a day and rule: an order over all of them is small.
    w = Window.orderBy(severity, F.desc("day"), "rule")
    return hits.select("day", "rule", F.col("category").alias("severity"), F.date_add("day", F.expr("cast(change div 24 as int)")).alias("expires"), F.row_number().over(w).alias("place"))


def in_scope(df, role: str, who: int):
    """Rows that a role may see: its own, its reports' or all."""
    return df.where({"user": F.col("user_id") == who, "manager": F.col("user_id") % 10 == who % 10}.get(role, F.lit(True)))


@query("""SELECT 'user' AS role, count(*) AS rows, count(DISTINCT user_id) AS users FROM events WHERE user_id = 7 UNION ALL SELECT 'manager', count(*), count(DISTINCT user_id) FROM events WHERE user_id % 10 = 7 UNION ALL SELECT 'finance', count(*), count(DISTINCT user_id) FROM events""")
def role_scope(spark, d):
    e = table(spark, d, "events")
    seen = [in_scope(e, r, 7).agg(F.lit(r).alias("role"), F.count("*").alias("rows"), F.countDistinct("user_id").alias("users")) for r in ("user", "manager", "finance")]
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query("""SELECT * FROM (SELECT p_type AS metric, count(*) AS n FROM part GROUP BY 1) WHERE NOT regexp_matches(lower(metric), 'steel|type1')""")
def metric_strip(spark, d):
    """Metrics whose key contains a restricted word, in any case, are left out."""
    restricted = ["steel", "type1"]
    return table(spark, d, "part").groupBy(F.col("p_type").alias("metric")).agg(F.count("*").alias("n")).where(~F.lower("metric").rlike("|".join(restricted)))


@query("""SELECT event_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS company_day, CASE WHEN hour(ts) < 6 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS shift_day, hour(ts) * 60 + minute(ts) BETWEEN 1320 - 60 AND 1320 + least(90, 480) AS in_window FROM events""")
def company_calendar(spark, d):
    """The day in the company's zone, the day that a shift over midnight began, and whether a check-in fits the shift's window."""
    m = F.hour("ts") * 60 + F.minute("ts")
    local = F.to_date(F.col("ts") + F.expr("interval 330 minutes"))
    day = F.to_date("ts")
    return table(spark, d, "events").select("event_id", local.alias("company_day"), F.when(F.hour("ts") < 6, F.date_sub(day, 1)).otherwise(day).alias("shift_day"), m.between(1260, 1410).alias("in_window"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m-%d') = '06-15' AND 2001 - year(o_orderdate) > 0 AS anniversary, CAST(o_orderdate AS DATE) BETWEEN DATE '2001-06-15' AND DATE '2001-07-15' AS upcoming FROM orders""")
def anniversaries(spark, d):
    """Years of service on a given day, and what falls due in the next 30 days."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", ((F.date_format("o_orderdate", "MM-dd") == "06-15") & (2001 - F.year("o_orderdate") > 0)).alias("anniversary"), day.between(F.lit("2001-06-15").cast("date"), F.date_add(F.lit("2001-06-15").cast("date"), 30)).alias("upcoming"))


@query("""SELECT event_id, coalesce(CAST(floor(value) AS BIGINT) > 0 AND ts + to_minutes(CAST(floor(value) AS BIGINT)) < CAST(ts AS DATE) + INTERVAL 12 HOUR, false) AS overstay, CASE WHEN event_type = 'view' AND hour(ts) < 12 THEN 'NO_SHOW' WHEN event_type = 'signup' THEN 'AUTO_CHECKED_OUT' ELSE upper(event_type) END AS status FROM events""")
def overstay_and_sweep(spark, d):
    """Overstay against the planned minutes (0 or null never), and the nightly sweep of statuses."""
    minutes = F.floor("value")
    until = F.col("ts") + F.make_interval(mins=minutes.cast("int"))
    over = F.coalesce((minutes > 0) & (until < F.to_date("ts").cast("timestamp_ntz") + F.expr("interval 12 hours")), F.lit(False))
    status = F.when((F.col("event_type") == "view") & (F.hour("ts") < 12), "NO_SHOW").when(F.col("event_type") == "signup", "AUTO_CHECKED_OUT").otherwise(F.upper("event_type"))
    return table(spark, d, "events").select("event_id", over.alias("overstay"), status.alias("status"))


@query("""SELECT event_id, user_id, late, CAST(greatest(1, ceil((SELECT count(*) FROM events WHERE hour(ts) >= 9 AND event_type = 'signup') / 25.0)) AS BIGINT) AS pages FROM (SELECT event_id, user_id, hour(ts) * 60 + minute(ts) - 540 AS late FROM events WHERE hour(ts) >= 9 AND event_type = 'signup') ORDER BY late DESC, event_id LIMIT 25 OFFSET 25""")
def late_drilldown(spark, d):
    """A page of late arrivals with the number of pages; the count and the page come from one filter."""
    late = table(spark, d, "events").where("hour(ts) >= 9 and event_type = 'signup'").select("event_id", "user_id", (F.hour("ts") * 60 + F.minute("ts") - 540).alias("late"))
    pages = late.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 25.0)).cast("long").alias("pages"))  # one row
    return page(late, [F.desc("late"), F.col("event_id")], 2, 25).join(F.broadcast(pages))


@query("""SELECT n_name AS nation, c_mktsegment AS kind, count(*) AS on_site, string_agg(CAST(c_custkey AS VARCHAR), ' ' ORDER BY c_custkey) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500 GROUP BY 1, 2""")
def muster_list(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 9500").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), " ")
    return c.groupBy(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("on_site"), ids.alias("people"))


def _ordered(kind: Column, names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), kind)


@query("""SELECT user_id, event_id, event_type, p IS NULL OR list_contains(CASE p WHEN 'view' THEN ['click', 'view', 'error'] WHEN 'click' THEN ['signup', 'purchase', 'view'] WHEN 'signup' THEN ['purchase', 'click'] WHEN 'purchase' THEN ['view'] ELSE [] END, event_type) AS allowed
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""")
def status_transitions(spark, d):
    """Whether a status may follow the one before it; a first status always may, and nothing follows an unknown one."""
    allowed = {"view": ["click", "view", "error"], "click": ["signup", "purchase", "view"], "signup": ["purchase", "click"], "purchase": ["view"]}
    p = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("p", p)
    ok = F.lit(False)
    for state, after in allowed.items():
        ok = F.when(F.col("p") == state, F.col("event_type").isin(after)).otherwise(ok)
    return e.select("user_id", "event_id", "event_type", F.when(F.col("p").isNull(), True).otherwise(ok).alias("allowed"))
