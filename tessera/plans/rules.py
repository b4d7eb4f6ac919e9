"""Rules of attendance, hiring, training, settlement, pricing and messages over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import attendance
from ..functions import text as T
from ..functions.measure import band, minute_of_day, rounded_hours
from ..operators.relational import shared_dir
from ..sources.tables import table
from ..streaming.state import daily_rollup, limited
from .registry import query

# A user's day: first and last event as punches; a single one is a missing punch out. Every seventh user has no shift rules of their own.
_SQL_DAYS = """g AS (SELECT user_id, CAST(ts AS DATE) AS day, min(hour(ts) * 60 + minute(ts)) AS a, max(hour(ts) * 60 + minute(ts)) AS b, count(*) AS n FROM events GROUP BY 1, 2),
x AS (SELECT user_id, day, a, CASE WHEN n > 1 THEN b END AS b, CASE user_id % 3 WHEN 0 THEN 480 WHEN 1 THEN 540 ELSE 240 END AS s, CASE user_id % 3 WHEN 0 THEN 1020 WHEN 1 THEN 1080 ELSE 900 END AS e, CASE WHEN dayofweek(day) = 0 THEN 'WEEK_OFF' WHEN day(day) = 26 THEN 'HOLIDAY' WHEN (user_id + day(day)) % 17 = 0 THEN 'LEAVE' ELSE 'WORK' END AS kind, CASE WHEN user_id % 7 > 0 THEN user_id % 40 END AS grace_shift, CASE WHEN user_id % 5 = 0 THEN 25 END AS grace_rule, user_id % 2 = 0 AS lop FROM g),
p AS (SELECT *, coalesce(grace_shift, grace_rule, 15) AS grace, CASE WHEN grace_shift IS NOT NULL THEN 'SHIFT' WHEN grace_rule IS NOT NULL THEN 'ATTENDANCE_RULE' ELSE 'SYSTEM_DEFAULT' END AS grace_source FROM x)"""


def _days(spark, d):
    m, u, day = minute_of_day(F.col("ts")), F.col("user_id"), F.col("day")
    g = table(spark, d, "events").withColumn("day", F.to_date("ts")).groupBy("user_id", "day").agg(F.min(m).alias("a"), F.max(m).alias("last"), F.count("*").alias("n"))
    start = F.when(u % 3 == 0, 480).when(u % 3 == 1, 540).otherwise(240)
    end = F.when(u % 3 == 0, 1020).when(u % 3 == 1, 1080).otherwise(900)
    kind = F.when(F.dayofweek(day) == 1, "WEEK_OFF").when(F.dayofmonth(day) == 26, "HOLIDAY").when((u + F.dayofmonth(day)) % 17 == 0, "LEAVE").otherwise("WORK")
    grace, source = attendance.resolved([("SHIFT", F.when(u % 7 > 0, u % 40)), ("ATTENDANCE_RULE", F.when(u % 5 == 0, F.lit(25).cast("long")))], F.lit(15).cast("long"))
    return g.select("user_id", "day", "a", F.when(F.col("n") > 1, F.col("last")).alias("b"), start.alias("s"), end.alias("e"), kind.alias("kind"), grace.alias("grace"), source.alias("grace_source"))


@query(f"""WITH {_SQL_DAYS} SELECT user_id, day, grace, grace_source FROM p""")
def policy_resolution(spark, d):
    """The first policy layer that sets a value, with its name."""
    return _days(spark, d).select("user_id", "day", "grace", "grace_source")


@query(f"""WITH {_SQL_DAYS},
h AS (SELECT *, b IS NOT NULL AND kind = 'WORK' AS counts, greatest(b - a - 30, 0) / CAST(60 AS DOUBLE) AS w, a - s AS late_by, e - b AS early_by FROM p)
SELECT user_id, day, CASE WHEN b IS NULL THEN 'INCOMPLETE' WHEN counts AND late_by > 240 THEN 'ABSENT' WHEN w >= 8 THEN CASE WHEN counts AND late_by > grace THEN 'LATE' ELSE 'PRESENT' END WHEN w >= 4 THEN 'HALF_DAY' WHEN lop THEN 'LOP' ELSE 'EARLY_EXIT' END AS status,
counts AND late_by > grace AS is_late, CAST(CASE WHEN counts AND late_by > grace THEN late_by ELSE 0 END AS INTEGER) AS late_minutes, counts AND early_by > 15 AS is_early_exit, CAST(CASE WHEN counts AND early_by > 15 THEN early_by ELSE 0 END AS INTEGER) AS early_minutes,
round(CASE WHEN b IS NULL THEN 0 ELSE w END, 6) AS worked_hours, round(CASE WHEN b IS NULL OR (counts AND late_by > 240) THEN 0 ELSE greatest(w - 8, 0) END, 6) AS overtime_hours FROM h""")
def attendance_resolution(spark, d):
    """The twelve steps of a day's status over first and last events as punches."""
    c = {n: F.col(n) for n in ("a", "b", "s", "e", "kind", "grace")}
    out = attendance.day(c["a"], c["b"], c["s"], c["e"], kind=c["kind"], breaks=F.lit(30), grace=c["grace"], early_tolerance=F.lit(15), half_day=F.lit(4.0), full_day=F.lit(8.0), max_late=F.lit(240), lop=F.col("user_id") % 2 == 0)
    figures = [(F.round(out[n], 6) if n.endswith("hours") else out[n].cast("int") if n.endswith("minutes") else out[n]).alias(n) for n in ("status", "is_late", "late_minutes", "is_early_exit", "early_minutes", "worked_hours", "overtime_hours")]
    return _days(spark, d).select("user_id", "day", *figures)


@query("""WITH m AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events) SELECT event_id, CAST(floor(m / 15.0 + 0.5) * 15 / 60 AS DOUBLE) AS nearest_15, CAST(floor(m / 30.0 + 0.5) * 30 / 60 AS DOUBLE) AS nearest_30, CAST(floor(m / 15.0) * 15 / 60 AS DOUBLE) AS floor_15, CAST(ceil(m / 15.0) * 15 / 60 AS DOUBLE) AS ceil_15 FROM m""")
def time_rounding(spark, d):
    """Hours of the day under each of the four roundings."""
    m = minute_of_day(F.col("ts"))
    return table(spark, d, "events").select("event_id", *[rounded_hours(m, s).cast("double").alias(s.lower()) for s in ("NEAREST_15", "NEAREST_30", "FLOOR_15", "CEIL_15")])


@query("""WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_id, hour(ts) * 60 + minute(ts) AS m, CASE user_id % 3 WHEN 0 THEN 480 WHEN 1 THEN 540 END AS s, CASE user_id % 3 WHEN 0 THEN 1020 WHEN 1 THEN 1080 END AS e FROM events)
SELECT user_id, day, CASE WHEN max(s) IS NULL THEN min(m) ELSE arg_min(m, (abs(m - s), m)) END AS punch_in, CASE WHEN count(DISTINCT m) < 2 THEN NULL WHEN max(e) IS NULL THEN max(m) ELSE arg_min(m, (abs(m - e), m)) END AS punch_out FROM m GROUP BY 1, 2""")
def shift_punches(spark, d):
    """The punches closest to the shift's start and end; without a shift the first and the last, with a single time no punch out."""
    m, u = minute_of_day(F.col("ts")), F.col("user_id")
    start, end = F.when(u % 3 == 0, 480).when(u % 3 == 1, 540), F.when(u % 3 == 0, 1020).when(u % 3 == 1, 1080)
    x = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), m.alias("m"), start.alias("s"), end.alias("e"))
    near = lambda at: F.min_by("m", F.struct(F.abs(F.col("m") - F.col(at)), "m"))
    g = x.groupBy("user_id", "day").agg(F.min("m").alias("first"), F.max("m").alias("last"), near("s").alias("in_"), near("e").alias("out_"), F.max("s").alias("s"))
    out = F.when(F.col("first") < F.col("last"), F.when(F.col("s").isNull(), F.col("last")).otherwise(F.col("out_")))
    return g.select("user_id", "day", F.when(F.col("s").isNull(), F.col("first")).otherwise(F.col("in_")).alias("punch_in"), out.alias("punch_out"))


@query("""WITH s AS (SELECT user_id, max(list_position(['view', 'click', 'signup', 'purchase'], event_type)) AS r FROM events GROUP BY 1),
c AS (SELECT i AS rank, ['view', 'click', 'signup', 'purchase'][i] AS stage, count(*) FILTER (r >= i) AS reached FROM s, range(1, 5) t(i) GROUP BY i)
SELECT stage, CAST(rank AS INTEGER) AS rank, reached, round(100.0 * reached / nullif(lag(reached) OVER (ORDER BY rank), 0), 2) AS from_previous, round(100.0 * reached / nullif(first_value(reached) OVER (ORDER BY rank), 0), 2) AS from_first FROM c""")
def hiring_funnel(spark, d):
    """Users who came to each stage or further, with the share of those of the stage before and of the first one."""
    stages = ["view", "click", "signup", "purchase"]
    rank = F.nullif(F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("event_type")), F.lit(0))
    users = table(spark, d, "events").groupBy("user_id").agg(F.max(rank).alias("r"))
    # One row: a count for each stage.
    wide = users.agg(*[F.count_if(F.col("r") >= i).alias(s) for i, s in enumerate(stages, 1)])
    parts = [F.struct(F.lit(s).alias("stage"), F.lit(i).alias("rank"), F.col(s).alias("reached"), (F.col(stages[i - 2]) if i > 1 else F.lit(None).cast("long")).alias("before"), F.col(stages[0]).alias("first")) for i, s in enumerate(stages, 1)]
    share = lambda of: F.round(100.0 * F.col("reached") / F.nullif(of, F.lit(0)), 2)
    return wide.select(F.explode(F.array(*parts)).alias("p")).select("p.*").select("stage", "rank", "reached", share(F.col("before")).alias("from_previous"), share(F.col("first")).alias("from_first"))


@query("""WITH l AS (SELECT l_suppkey, l_partkey, CAST(round(l_discount * 1000) AS BIGINT) AS pre, CAST(round(l_discount * 1000) AS BIGINT) + CAST(round(l_tax * 1000) AS BIGINT) AS post, CAST(round(l_extendedprice * 100) AS BIGINT) AS spent, l_linestatus = 'F' AS done FROM lineitem),
g AS (SELECT l_suppkey AS trainer, count(*) AS trainees, round(sum(pre) / count(*), 6) AS avg_pre, round(sum(post) / count(*), 6) AS avg_post, sum(CASE WHEN done THEN spent ELSE 0 END) AS used, sum(spent) AS budget, count(DISTINCT l_partkey % 50) FILTER (done) AS covered, count(DISTINCT l_partkey % 50) AS needed FROM l GROUP BY 1)
SELECT trainer, trainees, avg_pre, avg_post, round(avg_post - avg_pre, 6) AS gain, round(100.0 * used / nullif(budget, 0), 2) AS budget_used, round(100.0 * covered / nullif(needed, 0), 2) AS coverage, CAST(rank() OVER (ORDER BY avg_post DESC) AS INTEGER) AS place FROM g""")
def training_figures(spark, d):
    """Scores before and after, budget use and covered skills of each trainer, and their place by the score after."""
    whole = lambda c, f: F.round(F.col(c) * f).cast("long")
    done = F.col("l_linestatus") == "F"
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("trainer"), whole("l_discount", 1000).alias("pre"), (whole("l_discount", 1000) + whole("l_tax", 1000)).alias("post"), whole("l_extendedprice", 100).alias("spent"), done.alias("done"), (F.col("l_partkey") % 50).alias("skill"))
    g = l.groupBy("trainer").agg(
        F.count("*").alias("trainees"), F.round(F.sum("pre") / F.count("*"), 6).alias("avg_pre"), F.round(F.sum("post") / F.count("*"), 6).alias("avg_post"), F.sum(F.when(F.col("done"), F.col("spent")).otherwise(0)).alias("used"),
        F.sum("spent").alias("budget"), F.count_distinct(F.when(F.col("done"), F.col("skill"))).alias("covered"), F.count_distinct("skill").alias("needed"),
    )
    # Trainers are ranked by how many scores are above each: one row for each different score crosses to one task.
    scores = g.groupBy("avg_post").agg(F.count("*").alias("n")).withColumn("place", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("avg_post")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    share = lambda a, b: F.round(100.0 * F.col(a) / F.nullif(F.col(b), F.lit(0)), 2)
    return g.join(scores.select("avg_post", "place"), "avg_post").select("trainer", "trainees", "avg_pre", "avg_post", F.round(F.col("avg_post") - F.col("avg_pre"), 6).alias("gain"), share("used", "budget").alias("budget_used"), share("covered", "needed").alias("coverage"), F.col("place").cast("int").alias("place"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS units, count(*) FILTER (l_returnflag <> 'R') AS good, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS scrap, count(*) FILTER (l_returnflag = 'R') AS defects, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(100.0 * good / units, 2) AS first_pass_yield, round(100.0 * scrap / units, 2) AS scrap_rate, round(1000.0 * defects / nullif(quantity, 0), 4) AS defects_per_thousand FROM g""")
def quality_figures(spark, d):
    """First-pass yield, scrap rate and defect density of each supplier."""
    back = F.col("l_returnflag") == "R"
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("units"), F.count_if(~back).alias("good"), F.count_if(back & (F.col("l_linestatus") == "F")).alias("scrap"), F.count_if(back).alias("defects"), F.sum("l_quantity").cast("long").alias("quantity"))
    return g.select("l_suppkey", F.round(100.0 * F.col("good") / F.col("units"), 2).alias("first_pass_yield"), F.round(100.0 * F.col("scrap") / F.col("units"), 2).alias("scrap_rate"), F.round(1000.0 * F.col("defects") / F.nullif("quantity", F.lit(0)), 4).alias("defects_per_thousand"))


@query("""WITH o AS (SELECT o_custkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS late, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus <> 'F')
SELECT o_custkey, sum(cents) FILTER (late <= -7) / 100.0 AS current, sum(cents) FILTER (late > -7 AND late <= 0) / 100.0 AS due_soon, sum(cents) FILTER (late BETWEEN 1 AND 30) / 100.0 AS d1_30, sum(cents) FILTER (late BETWEEN 31 AND 60) / 100.0 AS d31_60, sum(cents) FILTER (late > 60) / 100.0 AS over_60,
sum(cents) FILTER (late <= 0) / 100.0 AS b_current, sum(cents) FILTER (late BETWEEN 1 AND 30) / 100.0 AS b_30, sum(cents) FILTER (late BETWEEN 31 AND 60) / 100.0 AS b_60, sum(cents) FILTER (late > 60) / 100.0 AS b_90 FROM o GROUP BY 1""")
def ageing_schemes(spark, d):
    """Open amounts of customers by age, in both schemes of buckets."""
    late = F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate"))
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_custkey", late.alias("late"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    x = F.col("late")
    buckets = {"current": x <= -7, "due_soon": (x > -7) & (x <= 0), "d1_30": x.between(1, 30), "d31_60": x.between(31, 60), "over_60": x > 60, "b_current": x <= 0, "b_30": x.between(1, 30), "b_60": x.between(31, 60), "b_90": x > 60}
    return o.groupBy("o_custkey").agg(*[(F.sum(F.when(c, F.col("cents"))) / 100.0).alias(n) for n, c in buckets.items()])


@query("""WITH o AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1), w AS (SELECT o.o_custkey, last, count(DISTINCT CAST(x.o_orderdate AS DATE)) FILTER (x.o_orderstatus IN ('F', 'O') AND year(x.o_orderdate) = year(last)) AS days FROM o JOIN orders x ON x.o_custkey = o.o_custkey GROUP BY 1, 2)
SELECT c_custkey, days, CASE WHEN c_mktsegment <> 'MACHINERY' AND c_acctbal <= 7000 AND days >= 2 THEN round(c_acctbal * 8.33 / 100 * least(12, month(last)), 2) ELSE 0 END AS bonus FROM customer JOIN w ON o_custkey = c_custkey""")
def settlement_bonus(spark, d):
    """Bonus pro rata of the year of leaving: below the wage ceiling, after enough days, unless left for cause."""
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    last = o.groupBy("o_custkey").agg(F.max("day").alias("last"))
    counts = F.when(F.col("o_orderstatus").isin("F", "O") & (F.year("day") == F.year("last")), F.col("day"))
    w = o.join(last, "o_custkey").groupBy("o_custkey", "last").agg(F.count_distinct(counts).alias("days"))
    due = (F.col("c_mktsegment") != "MACHINERY") & (F.col("c_acctbal") <= 7000) & (F.col("days") >= 2)
    bonus = F.round(F.col("c_acctbal") * 8.33 / 100 * F.least(F.lit(12), F.month("last")), 2)
    return table(spark, d, "customer").join(w, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "days", F.when(due, bonus).otherwise(0.0).alias("bonus"))


_SLABS = [(1, 10, 100), (11, 25, 300), (26, 1000, 750)]


@query("""WITH r AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS period, count(*) AS units FROM orders GROUP BY 1, 2), i AS (SELECT *, CASE WHEN units <= 10 THEN 100 WHEN units <= 25 THEN 300 WHEN units <= 1000 THEN 750 ELSE 0 END AS amount FROM r WHERE period = (SELECT max(date_trunc('month', o_orderdate)) FROM orders))
SELECT c_custkey, round(c_acctbal + coalesce(amount, 0), 2) AS gross, amount IS NOT NULL AS merged FROM customer LEFT JOIN i ON o_custkey = c_custkey""")
def incentive_merge(spark, d):
    """Incentives by slab, stored by period so that a period that is computed again replaces itself, then added to the pay of the last period."""
    path = f"{shared_dir(spark)}/incentives-{uuid.uuid4().hex}"
    r = table(spark, d, "orders").groupBy("o_custkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).agg(F.count("*").alias("units"))
    amount = F.lit(0)
    for low, high, pay in reversed(_SLABS):
        amount = F.when(F.col("units").between(low, high), pay).otherwise(amount)
    r = r.withColumn("amount", amount)
    for rows in (r, r.where("period = (date'1995-01-01')")):
        rows.write.partitionBy("period").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    last = F.broadcast(stored.agg(F.max("period").alias("period")))  # one row
    mine = stored.join(last, "period").select("o_custkey", "amount")
    c = table(spark, d, "customer").join(mine, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.round(F.col("c_acctbal") + F.coalesce("amount", F.lit(0)), 2).alias("gross"), F.col("amount").isNotNull().alias("merged"))


@query("""WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN list_filter([1, 2, 3, 4, 5], lambda m: (s_suppkey + m) % 2 = 0) END AS own, CASE WHEN s_suppkey % 4 = 0 THEN MAP {1: 950.0, 3: 10.0} END AS custom, ['starter', 'growth', 'custom', 'unknown'][s_suppkey % 4 + 1] AS tier, CASE WHEN s_suppkey % 8 = 2 THEN CAST(s_suppkey AS DOUBLE) END AS tier_price, CASE WHEN s_suppkey % 11 = 0 THEN 5000.0 END AS fee, CASE WHEN s_suppkey % 13 = 0 THEN 18.0 END AS multiplier FROM supplier),
m AS (SELECT *, list_sum(list_transform(coalesce(own, [1, 2]), lambda i: coalesce(coalesce(custom, MAP {2: 777.0})[i], MAP {1: 1000.0, 2: 800.0, 3: 650.0, 4: 400.0}[i], 0.0))) AS modules FROM l),
c AS (SELECT *, coalesce(modules, 0) + CASE tier WHEN 'custom' THEN coalesce(tier_price, 0) WHEN 'starter' THEN 4999 WHEN 'growth' THEN 9999 ELSE 0 END AS monthly FROM m)
SELECT s_suppkey, round(monthly, 2) AS monthly, round(monthly * 10, 2) AS annual, round(coalesce(fee, monthly * coalesce(multiplier, 24)), 2) AS one_time, round(coalesce(fee, monthly * coalesce(multiplier, 24)) * 18 / 100, 2) AS amc FROM c""")
def location_pricing(spark, d):
    """A location's monthly cost from its own or the company's modules and prices and its tier; a year is ten months, one time 24, upkeep 18 %."""
    k = F.col("s_suppkey")
    catalogue = F.create_map(*[F.lit(v) for p in ((1, 1000.0), (2, 800.0), (3, 650.0), (4, 400.0)) for v in p])
    of_company = F.create_map(F.lit(2), F.lit(777.0))
    custom = F.when(k % 4 == 0, F.create_map(F.lit(1), F.lit(950.0), F.lit(3), F.lit(10.0)))
    own = F.when(k % 3 > 0, F.filter(F.array(*[F.lit(i) for i in range(1, 6)]), lambda m: (k + m) % 2 == 0))
    ids = F.coalesce(own, F.array(F.lit(1), F.lit(2)))
    modules = F.aggregate(ids, F.lit(0.0), lambda a, i: a + F.coalesce(F.try_element_at(F.coalesce(custom, of_company), i), F.try_element_at(catalogue, i), F.lit(0.0)))
    tier = k % 4
    monthly = modules + F.when(tier == 2, F.coalesce(F.when(k % 8 == 2, k.cast("double")), F.lit(0.0))).when(tier == 0, 4999.0).when(tier == 1, 9999.0).otherwise(0.0)
    x = table(spark, d, "supplier").select("s_suppkey", monthly.alias("m"))
    once = F.coalesce(F.when(k % 11 == 0, 5000.0), F.col("m") * F.coalesce(F.when(k % 13 == 0, 18.0), F.lit(24.0)))
    return x.select("s_suppkey", F.round("m", 2).alias("monthly"), F.round(F.col("m") * 10, 2).alias("annual"), F.round(once, 2).alias("one_time"), F.round(once * 18 / 100, 2).alias("amc"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, date_diff('day', DATE '1995-01-02', CAST(o_orderdate AS DATE)) AS n, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS months FROM orders)
SELECT o_orderkey, CAST((floor(n / 7.0) % 3 + 3) % 3 AS BIGINT) AS weekly, CAST((floor(floor(n / 7.0) / 2) % 3 + 3) % 3 AS BIGINT) AS fortnightly, CAST(months % 3 AS BIGINT) AS monthly FROM o""")
def rotation_patterns(spark, d):
    """The place in a rotation of three shifts by week, by fortnight and by month since its start."""
    day = F.to_date("o_orderdate")
    weeks = F.floor(F.datediff(day, F.lit("1995-01-02").cast("date")) / 7)
    months = (F.year(day) - 1995) * 12 + F.month(day) - 1
    return table(spark, d, "orders").select("o_orderkey", F.pmod(weeks, F.lit(3)).cast("long").alias("weekly"), F.pmod(F.floor(weeks / 2), F.lit(3)).cast("long").alias("fortnightly"), F.pmod(months, F.lit(3)).cast("long").alias("monthly"))


@query("""WITH o AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') / 365.25 AS tenure, 18 + o_custkey % 45 AS age FROM orders)
SELECT o_orderkey, CASE WHEN age < 25 THEN '20-25' WHEN age < 30 THEN '26-30' WHEN age < 35 THEN '31-35' WHEN age < 40 THEN '36-40' WHEN age < 50 THEN '41-50' ELSE '50+' END AS age_band, CASE WHEN tenure < 1 THEN '0-1yr' WHEN tenure < 3 THEN '1-3yr' WHEN tenure < 5 THEN '3-5yr' ELSE '5+yr' END AS tenure_band FROM o""")
def people_bands(spark, d):
    """Bands of age and tenure; a band's label isn't its bounds (25 is in 26-30), as the rule has it."""
    age = F.lit(18) + F.col("o_custkey") % 45
    tenure = F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate")) / 365.25

    return table(spark, d, "orders").select("o_orderkey", band(age, [25, 30, 35, 40, 50], ["20-25", "26-30", "31-35", "36-40", "41-50", "50+"]).alias("age_band"), band(tenure, [1, 3, 5], ["0-1yr", "1-3yr", "3-5yr", "5+yr"]).alias("tenure_band"))


# identifiers' patterns.
PATTERNS = {"pan": "[A-Z]{5}[0-9]{4}[A-Z]", "aadhaar": "[0-9]{12}", "ifsc": "[A-Z]{4}0[A-Z0-9]{6}", "email": r"[^\s@]+@[^\s@]+\.[^\s@]+"}


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), '{p}') AS has_{n}" for n, p in PATTERNS.items()) + " FROM documents")
def identifier_patterns(spark, d):
    """Whether a whole text holds an identifier of each kind."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", *[text.rlike(p).alias(f"has_{n}") for n, p in PATTERNS.items()])


# Patterns of intents, in order.
INTENTS = [
    ("LEAVE_BALANCE", r"leave\s*balance|how\s*many\s*leaves|remaining\s*leave|leave\s*left"),
    ("PAYSLIP", r"payslip|pay\s*slip|salary\s*slip|download\s*payslip"),
    ("ATTENDANCE", r"my\s*attendance|attendance\s*status|present\s*days"),
    ("HR_CONTACT", r"hr\s*contact|contact\s*hr|hr\s*email|hr\s*phone|speak\s*to\s*hr"),
    ("POLICY", r"policy|leave\s*policy|attendance\s*policy|work\s*from\s*home"),
    ("HOLIDAY", r"holiday|next\s*holiday|upcoming\s*holiday|holiday\s*list"),
    ("GREETING", r"^(hi|hello|hey|good\s*(morning|afternoon|evening))"),
]
_SQL_ASKED = "(SELECT conv_id, turn, CASE (conv_id + turn) % 9 WHEN 0 THEN 'How many  leaves? ' WHEN 1 THEN 'salary slip: ' WHEN 2 THEN 'hello ' WHEN 3 THEN 'Speak to HR ' WHEN 4 THEN 'leave policy ' WHEN 5 THEN 'the next HOLIDAY ' WHEN 6 THEN 'present  days ' ELSE '' END || text AS asked FROM conversations)"


@query(f"SELECT conv_id, turn, CASE {' '.join(f'''WHEN regexp_matches(asked, '(?i){p}') THEN '{n}' ''' for n, p in INTENTS)} ELSE 'UNKNOWN' END AS intent FROM {_SQL_ASKED}")
def seven_intents(spark, d):
    """The first of seven intents one of whose patterns a whole text holds."""
    n = (F.col("conv_id") + F.col("turn")) % 9
    opening = F.lit("")
    for i, t in enumerate(["How many  leaves? ", "salary slip: ", "hello ", "Speak to HR ", "leave policy ", "the next HOLIDAY ", "present  days "]):
        opening = F.when(n == i, t).otherwise(opening)
    asked, out = F.concat(opening, "text"), F.lit("UNKNOWN")
    for name, pattern in reversed(INTENTS):
        out = F.when(asked.rlike(f"(?i){pattern}"), name).otherwise(out)
    return table(spark, d, "conversations").select("conv_id", "turn", out.alias("intent"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5 FROM pages""")
def escaped_pages(spark, d):
    """Texts with the characters of markup escaped."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(T.html_escaped(F.col("html"))).alias("escaped_md5"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, value FROM events)
SELECT event_id, 'Hello ' || CAST(user_id AS VARCHAR) || ', your ' || event_type || ' of {amount} {secret} is ' || CASE WHEN value > 50 THEN 'large' ELSE 'small' END AS message, 'VIS-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS visit_code, right('00000000' || CAST(event_id * 7919 AS VARCHAR), 8) AS suffix FROM e""")
def rendered_templates(spark, d):
    """Templates whose allowed variables are put in and others stay as they stand; codes of visits and suffixes of ids."""
    allowed = {"user": F.col("user_id").cast("string"), "type": F.col("event_type"), "size": F.when(F.col("value") > 50, "large").otherwise("small")}
    message = F.lit("Hello {user}, your {type} of {amount} {secret} is {size}")
    for name, value in allowed.items():
        message = F.replace(message, F.lit("{" + name + "}"), value)
    id_ = F.col("event_id").cast("string")
    return table(spark, d, "events").select("event_id", message.alias("message"), F.concat(F.lit("VIS-"), F.lpad(id_, 6, "0")).alias("visit_code"), F.right(F.concat(F.lit("00000000"), (F.col("event_id") * 7919).cast("string")), F.lit(8)).alias("suffix"))


# Known types and significances; what an unknown or missing one becomes.
_TYPES = ["text_addition", "text_deletion", "text_modification", "table_cell_change", "table_row_addition", "table_row_deletion", "table_structure_change", "annotation_present_in_b", "annotation_removed_from_b", "formatting_change", "section_moved"]
_SIGNIFICANCES = ["material", "substantive", "cosmetic", "uncertain"]


@query("""WITH v AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'text_addition' WHEN 'click' THEN 'nonsense' WHEN 'error' THEN NULL ELSE 'formatting_change' END AS type, CASE WHEN value > 60 THEN 'material' WHEN value > 30 THEN 'odd' END AS significance, CASE WHEN value > 20 THEN round(value / 100, 4) END AS confidence FROM events),
n AS (SELECT event_id, CASE WHEN type IN ('text_addition', 'formatting_change') THEN type ELSE 'text_modification' END AS type, CASE WHEN significance = 'material' THEN significance ELSE 'uncertain' END AS significance, CAST(coalesce(confidence, 0.8) AS DOUBLE) AS confidence FROM v)
SELECT 'visual' AS source, event_id AS number, type, significance, confidence, confidence < 0.75 AS needs_verification, confidence >= 0.95 AND significance <> 'uncertain' AS auto_confirmed FROM n
UNION ALL SELECT 'text', o_orderkey, 'text_modification', 'material', 0.92, false, true FROM orders""")
def visual_differences(spark, d):
    """Differences that an answer in JSON lists, with unknown types and values made known ones, behind those of texts."""
    v = F.col("value")
    kind = F.when(F.col("event_type") == "view", "text_addition").when(F.col("event_type") == "click", "nonsense").when(F.col("event_type") == "error", None).otherwise("formatting_change")
    answer = F.to_json(F.struct(F.array(F.struct(kind.alias("type"), F.when(v > 60, "material").when(v > 30, "odd").alias("significance"), F.when(v > 20, F.round(v / 100, 4)).alias("confidence"))).alias("differences")))
    raw = table(spark, d, "events").select("event_id", F.from_json(answer, "struct<differences: array<struct<type: string, significance: string, confidence: double>>>").alias("a")).select("event_id", F.explode("a.differences").alias("x"))
    known = lambda c, names, other: F.when(F.col(c).isin(names), F.col(c)).otherwise(other)
    seen = raw.select(F.lit("visual").alias("source"), F.col("event_id").alias("number"), known("x.type", _TYPES, "text_modification").alias("type"), known("x.significance", _SIGNIFICANCES, "uncertain").alias("significance"), F.coalesce("x.confidence", F.lit(0.8)).alias("confidence"))
    seen = seen.withColumns({"needs_verification": F.col("confidence") < 0.75, "auto_confirmed": (F.col("confidence") >= 0.95) & (F.col("significance") != "uncertain")})
    text = table(spark, d, "orders").select(F.lit("text").alias("source"), F.col("o_orderkey").alias("number"), F.lit("text_modification").alias("type"), F.lit("material").alias("significance"), F.lit(0.92).alias("confidence"), F.lit(False).alias("needs_verification"), F.lit(True).alias("auto_confirmed"))
    return seen.unionByName(text)


@query("""SELECT source, md5(line) AS line_md5, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages FROM (SELECT source, doc_id % 40 AS page, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT page) > 1""")
def line_pages(spark, d):
    """The pages of a line that stands on several, each once and in order."""
    x = table(spark, d, "documents").select("source", (F.col("doc_id") % 40).cast("string").alias("page"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    g = x.select("source", F.md5("line").alias("line_md5"), "page").distinct().groupBy("source", "line_md5").agg(F.array_sort(F.collect_set("page")).alias("p"))
    return g.where(F.size("p") > 1).select("source", "line_md5", F.array_join("p", ",").alias("pages"))


@query("""WITH s AS (SELECT l_suppkey AS person, l_partkey % 30 AS skill, CAST(max(l_quantity) AS INTEGER) % 5 AS level FROM lineitem GROUP BY 1, 2), t AS (SELECT p_partkey AS training, [p_partkey % 30, p_size % 30] AS linked FROM part WHERE p_brand <> 'Brand#1'),
f AS (SELECT skill, min(training) AS training FROM (SELECT training, unnest(linked) AS skill FROM t) GROUP BY 1)
SELECT person, skill, level, training FROM s JOIN f USING (skill) WHERE level < 3""")
def training_nominations(spark, d):
    """People below the required level of a skill, with the first active training that is linked to it."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("person"), (F.col("l_partkey") % 30).alias("skill")).agg((F.max("l_quantity").cast("int") % 5).alias("level"))
    t = table(spark, d, "part").where("p_brand <> 'Brand#1'").select(F.col("p_partkey").alias("training"), F.explode(F.array(F.col("p_partkey") % 30, (F.col("p_size") % 30).cast("long"))).alias("skill"))
    return s.where("level < 3").join(t.groupBy("skill").agg(F.min("training").alias("training")), "skill").select("person", "skill", "level", "training")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS date_from, CASE WHEN o_orderkey % 4 > 0 THEN DATE '1998-06-15' END AS date_to, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 - 2 END AS page, CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 300) - 20 END AS lim, CASE WHEN o_orderkey % 2 = 0 THEN '  ' || o_orderpriority || '  ' WHEN o_orderkey % 7 = 0 THEN '   ' END AS search, CASE o_orderkey % 3 WHEN 0 THEN 'asc' WHEN 1 THEN 'desc' END AS dir FROM orders),
n AS (SELECT *, coalesce(date_from, DATE '2001-08-01') AS f, coalesce(date_to, DATE '2001-08-20') AS t FROM o)
SELECT o_orderkey, least(f, t) AS date_from, t AS date_to, greatest(coalesce(page, 1), 1) AS page, least(greatest(coalesce(lim, 20), 1), 100) AS page_limit, nullif(left(trim(search), 200), '') AS search, CASE WHEN dir = 'asc' THEN 'asc' ELSE 'desc' END AS sort_order FROM n""")
def normalised_filters(spark, d):
    """Filters of a request with their defaults and bounds: dates in order, pages from 1, limits of 1 to 100, searches stripped."""
    k, today = F.col("o_orderkey"), F.lit("2001-08-20").cast("date")
    start = F.coalesce(F.when(k % 3 > 0, F.to_date("o_orderdate")), F.trunc(today, "month"))
    end = F.coalesce(F.when(k % 4 > 0, F.lit("1998-06-15").cast("date")), today)
    search = F.when(k % 2 == 0, F.concat(F.lit("  "), "o_orderpriority", F.lit("  "))).when(k % 7 == 0, F.lit("   "))
    return table(spark, d, "orders").select("o_orderkey", F.least(start, end).alias("date_from"), end.alias("date_to"), F.greatest(F.coalesce(F.when(k % 5 > 0, k % 7 - 2), F.lit(1)), F.lit(1)).alias("page"), F.least(F.greatest(F.coalesce(F.when(k % 6 > 0, k % 300 - 20), F.lit(20)), F.lit(1)), F.lit(100)).alias("page_limit"), F.nullif(F.left(T.stripped(search), F.lit(200)), F.lit("")).alias("search"), F.when(k % 3 == 0, "asc").otherwise("desc").alias("sort_order"))


@query()
def two_level_limits(spark, d):
    """Notifications within a limit for each user and one for each tenant, both in windows from their first event; critical ones pass and don't count."""
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("tenant"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    critical = e.where("event_type = 'error'").select("event_id", F.lit(True).alias("passed"), F.lit("CRITICAL").alias("by"))
    first = limited(e.where("event_type <> 'error'"), ["user_id"], 6 * 3600, 2)
    second = limited(first.where("passed").drop("passed"), ["tenant"], 3600, 3)
    rest = first.where("not passed").select("event_id", F.lit(False).alias("passed"), F.lit("USER").alias("by"))
    return second.select("event_id", "passed", F.lit("TENANT").alias("by")).unionByName(rest).unionByName(critical)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark, d):
    """The rollup by day that also runs on a stream, here over the table."""
    return daily_rollup(table(spark, d, "events"))


_SQL_WATCH = """v AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 10 > 0 THEN o_custkey % 500 END AS mobile, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 2000 END AS id_number FROM orders),
w AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'BLOCKLIST' ELSE 'WATCHLIST' END AS type, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 % 500 END AS mobile, CASE WHEN s_suppkey % 2 = 1 OR s_suppkey % 5 = 0 THEN s_suppkey * 7 % 2000 END AS id_number, CASE WHEN s_suppkey % 4 = 0 THEN DATE '1997-01-01' + CAST(s_suppkey * 9 AS INTEGER) END AS expiry FROM supplier WHERE s_suppkey % 6 > 0)"""


@query(f"""WITH {_SQL_WATCH} SELECT o_orderkey, CASE WHEN bool_or(type = 'BLOCKLIST') THEN 'DENIED' ELSE 'WATCHED' END AS outcome FROM v JOIN w ON (v.mobile = w.mobile OR v.id_number = w.id_number) AND (expiry IS NULL OR expiry >= day) GROUP BY 1""")
def visitor_matches(spark, d):
    """Visits whose mobile number or identity is on an active list that hasn't expired by then; a block list decides before a watch list."""
    k, n = F.col("o_orderkey"), F.col("s_suppkey")
    v = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.when(k % 10 > 0, F.col("o_custkey") % 500).alias("mobile"), F.when(k % 4 == 1, k % 2000).alias("id_number"))
    w = table(spark, d, "supplier").where("s_suppkey % 6 > 0").select(F.when(n % 3 == 0, 1).otherwise(2).alias("priority"), F.when(n % 2 == 0, n * 3 % 500).alias("mobile"), F.when((n % 2 == 1) | (n % 5 == 0), n * 7 % 2000).alias("id_number"), F.when(n % 4 == 0, F.date_add(F.lit("1997-01-01").cast("date"), (n * 9).cast("int"))).alias("expiry"))
    # Two joins on one key each instead of one on either.
    hits = [v.join(w.select(c, "priority", "expiry"), c).where("expiry is null or expiry >= day").select("o_orderkey", "priority") for c in ("mobile", "id_number")]
    best = hits[0].unionByName(hits[1]).groupBy("o_orderkey").agg(F.min("priority").alias("p"))
    return best.select("o_orderkey", F.when(F.col("p") == 1, "DENIED").otherwise("WATCHED").alias("outcome"))


@query("""WITH a AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 100 AS arrears FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), c AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 1000 AS claims FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '5%' GROUP BY 1)
SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) + coalesce(arrears, 0) + coalesce(claims, 0) AS gross, arrears, claims FROM customer LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN c ON c.o_custkey = c_custkey""")
def pay_additions(spark, d):
    """Unpaid arrears and approved claims, each summed by person first, added to the pay; none stays null."""
    o = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    of = lambda rows, name, by: rows.groupBy(F.col("o_custkey").alias(f"{name}_of")).agg(F.sum("cents").alias("s")).select(f"{name}_of", F.expr(f"s div {by}").alias(name))
    a, c = of(o.where("o_orderstatus = 'P'"), "arrears", 100), of(o.where("o_orderstatus = 'O' and o_orderpriority like '5%'"), "claims", 1000)
    x = table(spark, d, "customer").join(a, F.col("c_custkey") == F.col("arrears_of"), "left").join(c, F.col("c_custkey") == F.col("claims_of"), "left")
    gross = F.round(F.col("c_acctbal") * 100).cast("long") + F.coalesce("arrears", F.lit(0)) + F.coalesce("claims", F.lit(0))
    return x.select("c_custkey", gross.alias("gross"), "arrears", "claims")


@query("""WITH p AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 100 AS BIGINT) AS income, o_custkey % 2 = 0 AS new FROM orders GROUP BY 1),
t AS (SELECT *, CASE WHEN new THEN (least(income, 800000) - least(income, 400000)) * 5 // 100 + (least(income, 1200000) - least(income, 800000)) * 10 // 100 + greatest(income - 1200000, 0) * 20 // 100 ELSE (least(income, 500000) - least(income, 250000)) * 5 // 100 + (least(income, 1000000) - least(income, 500000)) * 20 // 100 + greatest(income - 1000000, 0) * 30 // 100 END AS slabs FROM p),
r AS (SELECT *, CASE WHEN new AND income <= 1200000 THEN least(slabs, 60000) WHEN NOT new AND income <= 500000 THEN least(slabs, 12500) ELSE 0 END AS rebate FROM t),
s AS (SELECT *, CASE WHEN income > 20000000 THEN 25 WHEN income > 10000000 THEN 15 WHEN income > 5000000 THEN 10 ELSE 0 END AS rate FROM r)
SELECT o_custkey, CAST(slabs AS BIGINT) AS slabs, CAST(rebate AS BIGINT) AS rebate, CAST((slabs - rebate) * rate // 100 AS BIGINT) AS surcharge, CAST((slabs - rebate + (slabs - rebate) * rate // 100) * 104 // 100 AS BIGINT) AS tax FROM s""")
def tax_regimes(spark, d):
    """Tax by slabs of either regime, less the rebate below its limit, then the surcharge of high incomes and the cess."""
    p = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("c")).select("o_custkey", F.expr("c div 100").alias("income"))
    new = F.col("o_custkey") % 2 == 0

    def slabs(parts: list[tuple[int, int | None, int]]):
        terms = [f"(least(income, {high}) - least(income, {low})) * {rate} div 100" if high else f"greatest(income - {low}, 0L) * {rate} div 100" for low, high, rate in parts]
        return F.expr(" + ".join(terms))

    # Slabs in whole units with their rates, rebates with their limits.
    x = p.withColumn("slabs", F.when(new, slabs([(400_000, 800_000, 5), (800_000, 1_200_000, 10), (1_200_000, None, 20)])).otherwise(slabs([(250_000, 500_000, 5), (500_000, 1_000_000, 20), (1_000_000, None, 30)])))
    rebate = F.when(new & (F.col("income") <= 1_200_000), F.least("slabs", F.lit(60_000))).when(~new & (F.col("income") <= 500_000), F.least("slabs", F.lit(12_500))).otherwise(0)
    rate = F.when(F.col("income") > 20_000_000, 25).when(F.col("income") > 10_000_000, 15).when(F.col("income") > 5_000_000, 10).otherwise(0)
    x = x.withColumns({"rebate": rebate.cast("long"), "rate": rate}).withColumn("surcharge", F.expr("(slabs - rebate) * rate div 100"))
    return x.select("o_custkey", "slabs", "rebate", "surcharge", F.expr("(slabs - rebate + surcharge) * 104 div 100").alias("tax"))
