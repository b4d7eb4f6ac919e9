"""Event sequences: punches, streaks, gaps, caps, limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.measure import band, in_quiet_hours, minute_of_day, rounded_hours
from ..operators.relational import as_of, islands
from ..sources.tables import table
from ..streaming.state import limited
from .registry import query


def _events(spark, d):
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS first_in, CASE WHEN count(*) > 1 THEN max(ts) END AS last_out FROM events GROUP BY 1, 2""")
def first_last_punch(spark, d):
    return _events(spark, d).groupBy("user_id", "day").agg(F.min("ts").alias("first_in"), F.when(F.count("*") > 1, F.max("ts")).alias("last_out"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, epoch_us(ts) AS t, row_number() OVER w AS n, lead(epoch_us(ts)) OVER w AS nxt, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS c FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id))
SELECT user_id, day, CAST(sum(CASE WHEN n % 2 = 1 AND nxt IS NOT NULL THEN nxt - t ELSE 0 END) // 1000000 AS BIGINT) AS seconds, CASE WHEN max(c) % 2 = 1 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM e GROUP BY 1, 2""")
def pair_durations(spark, d):
    part = Window.partitionBy("user_id", "day")
    w = part.orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = _events(spark, d).withColumns({"t": t, "n": F.row_number().over(w), "nxt": F.lead(t).over(w)})
    odd = F.when((F.col("n") % 2 == 1) & F.col("nxt").isNotNull(), F.col("nxt") - F.col("t")).otherwise(0)
    g = e.groupBy("user_id", "day").agg(F.sum(odd).alias("us"), F.count("*").alias("c"))
    return g.select("user_id", "day", F.expr("us div 1000000").alias("seconds"), F.when(F.col("c") % 2 == 1, "INCOMPLETE").otherwise("COMPLETE").alias("status"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_id, abs(hour(ts) * 60 + minute(ts) - 540) * 1000000000 + event_id) AS event_id FROM events GROUP BY 1, 2""")
def nearest_to_time(spark, d):
    return _events(spark, d).groupBy("user_id", "day").agg(F.min_by("event_id", F.struct(F.abs(minute_of_day(F.col("ts")) - 540), "event_id")).alias("event_id"))


@query("""WITH u AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS k FROM u)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1""")
def streaks(spark, d):
    u = _events(spark, d).select("user_id", "day").distinct()
    g = u.withColumn("k", F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))))
    return g.groupBy("user_id", "k").count().groupBy("user_id").agg(F.max("count").alias("longest"))


@query("""WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, min(event_id) AS first_event, event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY ts, event_id) AS ids FROM i GROUP BY user_id, island, event_type""")
def islands_merge(spark, d):
    i = islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda s: s["event_id"].cast("string")), " ")
    return i.groupBy("user_id", "island", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"), ids.alias("ids")).drop("island")


@query("""SELECT event_type, count(gap) AS n, CAST(sum(gap) // 1000000 AS BIGINT) AS seconds FROM (SELECT event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM events) GROUP BY 1""")
def time_in_stage(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").withColumn("gap", F.lead(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - t)
    return e.groupBy("event_type").agg(F.count("gap").alias("n"), F.expr("sum(gap) div 1000000").alias("seconds"))


@query("""WITH b AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events), u AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY 1)
SELECT user_id, date_diff('day', lo, hi) + 1 - n AS missing FROM u, b WHERE date_diff('day', lo, hi) + 1 > n""")
def date_spine_gaps(spark, d):
    """Days of the table's period on which a user has no event, by a spine of days for each user."""
    e = _events(spark, d).select("user_id", "day").distinct()
    period = e.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))  # one row
    spine = e.select("user_id").distinct().join(F.broadcast(period)).select("user_id", F.explode(F.sequence("lo", "hi")).alias("day"))
    return spine.join(e, ["user_id", "day"], "left_anti").groupBy("user_id").agg(F.count("*").alias("missing"))


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, min(hour(ts) * 60 + minute(ts)) AS a, max(hour(ts) * 60 + minute(ts)) AS b, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, day, CASE WHEN n = 1 THEN 'INCOMPLETE' WHEN b - a < 240 THEN 'HALF_DAY' WHEN a > 555 THEN 'LATE' ELSE 'PRESENT' END AS status, floor((b - a) / 15 + 0.5) * 15 / 60 AS hours FROM g""")
def attendance_status(spark, d):
    m = minute_of_day(F.col("ts"))
    g = _events(spark, d).groupBy("user_id", "day").agg(F.min(m).alias("a"), F.max(m).alias("b"), F.count("*").alias("n"))
    status = F.when(F.col("n") == 1, "INCOMPLETE").when(F.col("b") - F.col("a") < 240, "HALF_DAY").when(F.col("a") > 555, "LATE").otherwise("PRESENT")
    return g.select("user_id", "day", status.alias("status"), rounded_hours(F.col("b") - F.col("a"), "NEAREST_15").alias("hours"))


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, least(sum(CAST(round(value * 100) AS BIGINT)), 5000) AS v FROM events GROUP BY 1, 2),
w AS (SELECT *, greatest(0, least(v, 15000 - coalesce(sum(v) OVER (PARTITION BY user_id, date_trunc('week', day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS a FROM g),
m AS (SELECT *, coalesce(sum(a) OVER (PARTITION BY user_id, date_trunc('month', day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM w)
SELECT user_id, day, CAST(greatest(0, least(a, 40000 - used)) AS BIGINT) AS allowed FROM m""")
def ot_caps(spark, d):
    """Day, ISO week and month caps one after the other: what a day may take is what its periods have left."""
    g = _events(spark, d).groupBy("user_id", "day").agg(F.least(F.sum(F.round(F.col("value") * 100).cast("long")), F.lit(5000)).alias("v"))

    def capped(df, period, cap):
        used = F.coalesce(F.sum("v").over(Window.partitionBy("user_id", F.date_trunc(period, "day")).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.withColumn("v", F.greatest(F.lit(0), F.least(F.col("v"), cap - used)))

    return capped(capped(g, "week", 15000), "month", 40000).select("user_id", "day", F.col("v").cast("long").alias("allowed"))


@query("SELECT event_id FROM events WHERE hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 420")
def quiet_hours(spark, d):
    return table(spark, d, "events").where(in_quiet_hours(minute_of_day(F.col("ts")), 1320, 420)).select("event_id")


@query("SELECT CAST(o_orderdate AS DATE) AS day, CAST((date_diff('day', DATE '1995-01-02', CAST(o_orderdate AS DATE)) + 700) // 7 % 4 AS BIGINT) AS slot, count(*) AS n FROM orders GROUP BY 1, 2")
def rotation_index(spark, d):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-02").cast("date"))
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.pmod(F.floor(days / 7), F.lit(4)).cast("long").alias("slot")).agg(F.count("*").alias("n"))


@query("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN y < 1 THEN '<1' WHEN y < 3 THEN '1-3' WHEN y < 5 THEN '3-5' ELSE '5+' END AS band FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') / 365.25 AS y FROM orders)) GROUP BY 1""")
def age_bands(spark, d):
    years = F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate")) / 365.25
    return table(spark, d, "orders").groupBy(band(years, [1, 3, 5], ["<1", "1-3", "3-5", "5+"]).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, max(p.value_at) AS last_purchase FROM events e LEFT JOIN (SELECT user_id, epoch_us(ts) AS value_at FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.value_at <= epoch_us(e.ts) WHERE e.event_type = 'view' GROUP BY 1""")
def asof_lookup(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    views = e.where("event_type = 'view'").select("user_id", "t", "event_id")
    buys = e.where("event_type = 'purchase'").select("user_id", "t", F.col("t").alias("last_purchase"))
    return as_of(views, buys, ["user_id"], "t", "t", "last_purchase").select("event_id", "last_purchase")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{x}') AS {x}" for x in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def pivot_grid(spark, d):
    types = ["click", "error", "purchase", "signup", "view"]
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", types).agg(F.count(F.lit(1))).fillna(0, types)


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("k"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS n FROM events""")
def sliding_count(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-6 * 3600 * 1_000_000, 0)
    return table(spark, d, "events").withColumn("t", t).select("event_id", F.count("*").over(w).alias("n"))


@query()
def ttl_dedup(spark, d):
    """First event of a user and type within a day from the first one kept; later ones don't extend it."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return limited(e, ["user_id", "event_type"], 86_400, 1).where("passed").select("event_id", "user_id", "event_type")


@query()
def rate_limit(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    return limited(e, ["user_id"], 6 * 3600, 2).select("event_id", "passed")


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'error') WHERE r = 1 GROUP BY 1, 2""")
def alert_dedup(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
