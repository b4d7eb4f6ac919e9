"""Payroll, tax, stock valuation, matching of documents and plant figures. Money is in whole cents until the last step."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.measure import half_up
from ..sources.tables import table
from .registry import query


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def _rupees(x, digits: int = 2):
    return half_up(x / 100, digits)


@query("""WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS upto FROM lineitem WHERE l_returnflag <> 'R'),
i AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT)) AS out_ FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
w AS (SELECT r.*, coalesce(out_, 0) AS out_, greatest(0, least(q, upto - coalesce(out_, 0))) AS kept FROM r LEFT JOIN i USING (l_partkey))
SELECT l_partkey, CAST(sum(kept) AS BIGINT) AS quantity, CAST(sum(c * kept // q) AS BIGINT) AS fifo_cents, CAST(sum(c) * greatest(0, sum(q) - max(out_)) // sum(q) AS BIGINT) AS average_cents, CAST(greatest(0, max(out_) - sum(q)) AS BIGINT) AS short FROM w GROUP BY 1""")
def fifo_valuation(spark, d):
    """Stock left after the oldest receipts are issued first, valued at its own cost and at the weighted average."""
    l = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), _cents("l_extendedprice").alias("c"), (F.col("l_returnflag") == "R").alias("issue"))
    issued = F.sum(F.when(F.col("issue"), F.col("q")).otherwise(0)).over(Window.partitionBy("l_partkey"))
    upto = F.sum("q").over(Window.partitionBy("l_partkey", "issue").orderBy("l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0))
    w = l.withColumns({"out": issued, "upto": upto}).where("not issue").withColumn("kept", F.greatest(F.lit(0), F.least(F.col("q"), F.col("upto") - F.col("out"))))
    return w.groupBy("l_partkey").agg(
        F.sum("kept").alias("quantity"),
        F.sum(F.expr("c * kept div q")).alias("fifo_cents"),
        F.expr("sum(c) * greatest(0, sum(q) - max(out)) div sum(q)").alias("average_cents"),
        F.expr("greatest(0, max(out) - sum(q))").alias("short"),
    )


@query("""WITH po AS (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS BIGINT)) AS q, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem WHERE l_discount < 0.09 GROUP BY 1, 2), grn AS (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS BIGINT) - (CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END)) AS q FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), inv AS (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS BIGINT)) AS q, max(CAST(round(l_extendedprice * 100) AS BIGINT) + (CASE WHEN l_tax = 0 THEN 5 ELSE 0 END)) AS c FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
SELECT coalesce(po.l_orderkey, grn.l_orderkey, inv.l_orderkey) AS l_orderkey, coalesce(po.l_linenumber, grn.l_linenumber, inv.l_linenumber) AS l_linenumber,
CASE WHEN po.q IS NULL THEN 'NO_ORDER' WHEN grn.q IS NULL THEN 'NOT_RECEIVED' WHEN inv.q IS NULL THEN 'NOT_INVOICED' WHEN grn.q <> po.q OR inv.q <> grn.q THEN 'QUANTITY' WHEN inv.c <> po.c THEN 'PRICE' ELSE 'MATCHED' END AS outcome
FROM po FULL JOIN grn ON po.l_orderkey = grn.l_orderkey AND po.l_linenumber = grn.l_linenumber FULL JOIN inv ON coalesce(po.l_orderkey, grn.l_orderkey) = inv.l_orderkey AND coalesce(po.l_linenumber, grn.l_linenumber) = inv.l_linenumber""")
def three_way_match(spark, d):
    """Order, receipt and invoice lines by key, where a side's lines of a key count as their largest; the three sides are one union and one aggregate instead of two outer joins."""
    l = table(spark, d, "lineitem").withColumns({"q": F.col("l_quantity").cast("long"), "c": _cents("l_extendedprice")})
    side = lambda where, name, q, c: l.where(where).select("l_orderkey", "l_linenumber", F.lit(name).alias("side"), q.alias("q"), c.alias("c"))
    q, c = F.col("q"), F.col("c")
    sides = side("l_discount < 0.09", "po", q, c).unionByName(side("l_returnflag <> 'R'", "grn", q - F.when(F.col("l_tax") > 0.07, 1).otherwise(0), c)).unionByName(side("l_linestatus = 'O'", "inv", q, c + F.when(F.col("l_tax") == 0, 5).otherwise(0)))
    of = lambda name, x: F.max(F.when(F.col("side") == name, F.col(x))).alias(f"{name}_{x}")
    g = sides.groupBy("l_orderkey", "l_linenumber").agg(of("po", "q"), of("grn", "q"), of("inv", "q"), of("po", "c"), of("inv", "c"))
    outcome = F.expr("case when po_q is null then 'NO_ORDER' when grn_q is null then 'NOT_RECEIVED' when inv_q is null then 'NOT_INVOICED' when grn_q <> po_q or inv_q <> grn_q then 'QUANTITY' when inv_c <> po_c then 'PRICE' else 'MATCHED' end")
    return g.select("l_orderkey", "l_linenumber", outcome.alias("outcome"))


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CAST(floor(value * 60) AS DOUBLE) AS m FROM events),
a AS (SELECT *, m * least(1.0, 2400 / greatest(sum(m) OVER (PARTITION BY user_id, day), 1)) AS m1 FROM e), b AS (SELECT *, m1 * least(1.0, 7200 / greatest(sum(m1) OVER (PARTITION BY user_id, date_trunc('week', day)), 1)) AS m2 FROM a)
SELECT event_id, round(m2 * least(1.0, 20000 / greatest(sum(m2) OVER (PARTITION BY user_id, date_trunc('month', day)), 1)), 3) AS minutes FROM b""")
def ot_rescale(spark, d):
    """Each row scaled by cap / total, for the day, then the week, then the month."""
    e = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), F.floor(F.col("value") * 60).cast("double").alias("m"))
    for period, cap in ((F.col("day"), 2400.0), (F.date_trunc("week", "day"), 7200.0), (F.date_trunc("month", "day"), 20000.0)):
        total = F.sum("m").over(Window.partitionBy("user_id", period))
        e = e.withColumn("m", F.col("m") * F.least(F.lit(1.0), cap / F.greatest(total, F.lit(1.0))))
    return e.select("event_id", F.round("m", 3).alias("minutes"))


_GROSS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(f"""SELECT o_orderkey, {_GROSS} * (26 - lop) // 26 AS by_26, {_GROSS} * (30 - lop) // 30 AS by_30, {_GROSS} * (days - lop) // days AS by_days FROM (SELECT *, o_custkey % 5 AS lop, day(last_day(o_orderdate)) AS days FROM orders)""")
def lop_proration(spark, d):
    """Pay after days of absence, by the three divisors."""
    o = table(spark, d, "orders").withColumns({"g": _cents("o_totalprice"), "lop": F.col("o_custkey") % 5, "days": F.dayofmonth(F.last_day("o_orderdate"))})
    return o.select("o_orderkey", *[F.expr(f"g * ({n} - lop) div {n}").alias(a) for n, a in (("26", "by_26"), ("30", "by_30"), ("days", "by_days"))])


@query(f"""SELECT o_custkey, CAST(taxable AS BIGINT) AS taxable, CAST(CASE WHEN taxable <= 70000000 THEN 0 ELSE (least(taxable, 100000000) - least(taxable, 30000000)) * 5 // 100 + greatest(0, taxable - 100000000) * 20 // 100 END AS BIGINT) AS tax FROM
(SELECT o_custkey, greatest(0, g - 5000000 - least(15000000, s) - least(h, g * 40 // 100, greatest(0, h * 2 - g // 10))) AS taxable FROM (SELECT o_custkey, sum({_GROSS}) AS g, sum({_GROSS}) FILTER (WHERE o_orderpriority = '1-URGENT') AS s_, coalesce(sum({_GROSS}) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) AS s, coalesce(sum({_GROSS}) FILTER (WHERE o_orderstatus = 'F'), 0) // 4 AS h FROM orders GROUP BY 1))""")
def tax_deductions(spark, d):
    """Standard deduction, a capped one, house rent as the least of three, slabs, and the rebate below a limit."""
    g, s, h = F.sum("g"), F.coalesce(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("g"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("g"))), F.lit(0))
    by = table(spark, d, "orders").withColumn("g", _cents("o_totalprice")).groupBy("o_custkey").agg(g.alias("g"), s.alias("s"), h.alias("f")).withColumn("h", F.expr("f div 4"))
    t = by.withColumn("taxable", F.expr("greatest(0, g - 5000000 - least(15000000, s) - least(h, g * 40 div 100, greatest(0, h * 2 - g div 10)))"))
    tax = F.expr("case when taxable <= 70000000 then 0 else (least(taxable, 100000000) - least(taxable, 30000000)) * 5 div 100 + greatest(0, taxable - 100000000) * 20 div 100 end")
    return t.select("o_custkey", "taxable", tax.alias("tax"))


@query(f"""SELECT o_orderkey, least(g, 1500000) * 12 // 100 AS pf, least(g, 1500000) * 833 // 10000 AS eps, greatest(7500, g * 50 // 10000) AS admin, CASE WHEN g <= 2100000 THEN (g * 75 + 9999) // 10000 ELSE 0 END AS esi, least(g * o_custkey % 13 // 100, g - least(g, 1500000) * 12 // 100) AS vpf, g * 481 // 10000 AS gratuity FROM (SELECT *, {_GROSS} AS g FROM orders)""")
def contributions(spark, d):
    """Provident fund and pension on capped pay, admin charge with a floor, state insurance below its limit (rounded up), voluntary fund, gratuity."""
    o = table(spark, d, "orders").withColumn("g", _cents("o_totalprice"))
    pf = "least(g, 1500000) * 12 div 100"
    parts = {"pf": pf, "eps": "least(g, 1500000) * 833 div 10000", "admin": "greatest(7500, g * 50 div 10000)", "esi": "case when g <= 2100000 then (g * 75 + 9999) div 10000 else 0 end", "vpf": f"least(g * o_custkey % 13 div 100, g - {pf})", "gratuity": "g * 481 div 10000"}
    return o.select("o_orderkey", *[F.expr(x).cast("long").alias(a) for a, x in parts.items()])


@query(f"""SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN g - g * 30 // 100 - g * 10 // 100 ELSE g END + coalesce(arrears, 0) AS BIGINT) AS net, o_orderstatus = 'P' AS held FROM (SELECT *, {_GROSS} AS g FROM orders) LEFT JOIN (SELECT l_orderkey, sum(CAST(round(l_extendedprice * l_tax) AS BIGINT)) AS arrears FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON l_orderkey = o_orderkey""")
def salary_hold(spark, d):
    """A full hold pays nothing, a partial one leaves out the held components of a map; arrears are added to what is paid."""
    o = table(spark, d, "orders").withColumn("g", _cents("o_totalprice"))
    parts = F.create_map(F.lit("allowance"), F.expr("g * 30 div 100"), F.lit("bonus"), F.expr("g * 10 div 100"), F.lit("basic"), F.expr("g - g * 30 div 100 - g * 10 div 100"))
    paid = F.aggregate(F.map_values(F.map_filter(parts, lambda k, v: ~((F.col("o_orderpriority") == "2-HIGH") & k.isin("allowance", "bonus")))), F.lit(0).cast("long"), lambda a, x: a + x)
    extra = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * F.col("l_tax")).cast("long")).alias("arrears"))
    held = F.col("o_orderstatus") == "P"
    return o.join(extra, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", (F.when(held, 0).otherwise(paid) + F.coalesce("arrears", F.lit(0))).cast("long").alias("net"), held.alias("held"))


@query(f"""SELECT month, CASE WHEN p IS NULL THEN false ELSE abs(v - p) * 10 > abs(p) OR v < 0 END AS exception FROM (SELECT month, v, lag(v) OVER (ORDER BY month) AS p FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum({_GROSS}) AS v FROM orders GROUP BY 1))""")
def variance_flag(spark, d):
    """Months whose total moved by over 10 % or is negative; one row a month meets in the window."""
    m = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(_cents("o_totalprice")).alias("v"))
    p = F.lag("v").over(Window.orderBy("month"))
    return m.withColumn("p", p).select("month", F.when(F.col("p").isNull(), False).otherwise((F.abs(F.col("v") - F.col("p")) * 10 > F.abs("p")) | (F.col("v") < 0)).alias("exception"))


@query(f"""SELECT o_custkey, fy, CAST(sum(v) AS BIGINT) AS total, CAST(least(sum(v) // 10, 15000000) AS BIGINT) AS deducted, string_agg(m || ':' || v, ' ' ORDER BY m) AS months FROM (SELECT o_custkey, year(o_orderdate - INTERVAL 3 MONTH) AS fy, strftime(o_orderdate, '%Y-%m') AS m, CAST(sum({_GROSS}) AS BIGINT) AS v FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def annual_statement(spark, d):
    """A person's fiscal year: the sum, a capped deduction and the months (twelve at most) in order."""
    m = table(spark, d, "orders").groupBy("o_custkey", F.year(F.add_months("o_orderdate", -3)).cast("long").alias("fy"), F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.sum(_cents("o_totalprice")).alias("v"))
    months = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", "v"))), lambda x: F.concat(x["m"], F.lit(":"), x["v"].cast("string"))), " ")
    return m.groupBy("o_custkey", "fy").agg(F.sum("v").alias("total"), F.expr("least(sum(v) div 10, 15000000)").alias("deducted"), months.alias("months"))


@query("""SELECT machine, shift, round(availability * performance * quality, 6) AS oee FROM (SELECT l_suppkey AS machine, l_linenumber % 3 AS shift, 1.0 * count(*) FILTER (WHERE l_linestatus = 'O') / count(*) AS availability, least(1.0, sum(l_quantity) / (count(*) * 40.0)) AS performance, 1.0 * count(*) FILTER (WHERE l_returnflag <> 'R') / count(*) AS quality FROM lineitem GROUP BY 1, 2)""")
def oee(spark, d):
    """Availability x performance x quality by machine and shift."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("machine"), (F.col("l_linenumber") % 3).alias("shift")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("up"), F.sum("l_quantity").alias("made"), F.count_if(F.col("l_returnflag") != "R").alias("good"))
    return g.select("machine", "shift", F.round(F.col("up") / F.col("n") * F.least(F.lit(1.0), F.col("made") / (F.col("n") * 40.0)) * (F.col("good") / F.col("n")), 6).alias("oee"))


@query("""WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000000 AS t, epoch_us(lead(ts) OVER w) // 1000000 AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, coalesce(nxt, t)) AS gap FROM e WHERE event_type = 'error')
SELECT user_id, count(*) AS failures, CAST(sum(nxt - t) AS BIGINT) AS repair, CAST(sum(gap) AS BIGINT) AS between_ FROM f GROUP BY 1""")
def repair_times(spark, d):
    """Failures, seconds until the next event (repair), and seconds between failures; their means are MTTR and MTBF."""
    w = Window.partitionBy("user_id")
    t = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    e = table(spark, d, "events").withColumn("t", t).withColumn("nxt", F.lead("t").over(w.orderBy("ts", "event_id"))).where("event_type = 'error'")
    f = e.withColumn("gap", F.col("t") - F.lag("t").over(w.orderBy("t", F.coalesce("nxt", "t"))))
    return f.groupBy("user_id").agg(F.count("*").alias("failures"), F.sum(F.col("nxt") - F.col("t")).alias("repair"), F.sum("gap").alias("between_"))


@query(f"""SELECT o_orderpriority AS stage, strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(g) AS BIGINT) AS value, CAST(sum(g * p // 100) AS BIGINT) AS forecast FROM (SELECT *, {_GROSS} AS g, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 60 ELSE 25 END AS p FROM orders) GROUP BY 1, 2""")
def pipeline_forecast(spark, d):
    o = table(spark, d, "orders").withColumns({"g": _cents("o_totalprice"), "p": F.expr("case o_orderstatus when 'F' then 100 when 'P' then 60 else 25 end")})
    return o.groupBy(F.col("o_orderpriority").alias("stage"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("g").alias("value"), F.sum(F.expr("g * p div 100")).alias("forecast"))


@query("""SELECT user_id, CAST(sum(CASE WHEN hours >= 4 THEN 2 ELSE 1 END) AS BIGINT) AS earned_halves, CAST(sum(CASE WHEN day >= DATE '2024-01-15' THEN CASE WHEN hours >= 4 THEN 2 ELSE 1 END ELSE 0 END) AS BIGINT) AS balance_halves, count(*) >= 20 AS bonus FROM (SELECT user_id, CAST(ts AS DATE) AS day, (max(epoch_us(ts)) - min(epoch_us(ts))) / 3600000000.0 AS hours FROM events GROUP BY 1, 2) GROUP BY 1""")
def comp_off(spark, d):
    """A day earned from 4 hours on, else half a day; what was earned before the cutoff has expired. Bonus from 20 working days on."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    g = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(((F.max(t) - F.min(t)) / 3_600_000_000).alias("hours"))
    half = F.when(F.col("hours") >= 4, 2).otherwise(1)
    return g.groupBy("user_id").agg(F.sum(half).alias("earned_halves"), F.sum(F.when(F.col("day") >= F.lit("2024-01-15").cast("date"), half).otherwise(0)).alias("balance_halves"), (F.count("*") >= 20).alias("bonus"))


@query(f"""SELECT c_custkey, CAST(due AS DATE) AS due, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer, (SELECT unnest(generate_series(DATE '2001-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS due) WHERE c_acctbal > 0 AND (c_custkey % 3 = 0 OR month(due) = 1)""")
def recurring_invoices(spark, d):
    """Monthly invoices for some, a yearly one for the others, from a spine of due dates."""
    c = table(spark, d, "customer").where("c_acctbal > 0").withColumn("due", F.explode(F.expr("sequence(date'2001-01-01', date'2001-12-01', interval 1 month)")))
    return c.where((F.col("c_custkey") % 3 == 0) | (F.month("due") == 1)).select("c_custkey", "due", _cents("c_acctbal").alias("cents"))


@query(f"""SELECT o_custkey, period, CAST(g AS BIGINT) AS gross, CAST(g * CASE WHEN g > 100000000 THEN 3 WHEN g > 30000000 THEN 2 ELSE 1 END // 100 AS BIGINT) AS incentive, CAST(g + g * CASE WHEN g > 100000000 THEN 3 WHEN g > 30000000 THEN 2 ELSE 1 END // 100 AS BIGINT) AS net FROM (SELECT o_custkey, strftime(o_orderdate, '%Y') AS period, sum({_GROSS}) AS g FROM orders GROUP BY 1, 2)""")
def incentive(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy").alias("period")).agg(F.sum(_cents("o_totalprice")).alias("g"))
    i = F.expr("g * case when g > 100000000 then 3 when g > 30000000 then 2 else 1 end div 100")
    return g.select("o_custkey", "period", F.col("g").alias("gross"), i.alias("incentive"), (F.col("g") + i).alias("net"))


@query(f"""SELECT n_name AS nation, c_mktsegment, count(*) AS n, CAST(min(c) AS BIGINT) AS least, CAST(max(c) AS BIGINT) AS most, floor(10000.0 * count(*) / sum(count(*)) OVER () + 0.5) / 100 AS share, CAST(sum(c) FILTER (WHERE c > 0) AS BIGINT) AS register FROM (SELECT n_name, c_mktsegment, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1, 2""")
def pay_distribution(spark, d):
    """Salary report: count, least, most, share of all and the payable total by place and kind."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("c", _cents("c_acctbal"))
    g = c.groupBy(F.col("n_name").alias("nation"), "c_mktsegment").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most"), F.sum(F.when(F.col("c") > 0, F.col("c"))).alias("register"))
    return g.select("nation", "c_mktsegment", "n", "least", "most", (F.floor(10000.0 * F.col("n") / F.sum("n").over(Window.partitionBy()) + 0.5) / 100).alias("share"), "register")


@query("""SELECT CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS y, opening, joiners, leavers, opening + joiners - leavers AS closing FROM (SELECT DATE '1900-01-01' AS o_orderdate, 0 AS opening, 0 AS joiners, 0 AS leavers WHERE false)
UNION ALL SELECT y, CAST(coalesce(sum(j - l) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT), j, l, CAST(sum(j - l) OVER (ORDER BY y) AS BIGINT) FROM (SELECT CAST(y AS INTEGER) AS y, CAST(sum(j) AS BIGINT) AS j, CAST(sum(l) AS BIGINT) AS l FROM (SELECT year(min(o_orderdate)) AS y, 1 AS j, 0 AS l FROM orders GROUP BY o_custkey UNION ALL SELECT year(max(o_orderdate)), 0, 1 FROM orders GROUP BY o_custkey) GROUP BY 1)""")
def headcount_movement(spark, d):
    """Opening + joiners - leavers by year; one row a year meets in the window."""
    f = table(spark, d, "orders").groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("a"), F.year(F.max("o_orderdate")).alias("b"))
    moves = f.select(F.explode(F.array(F.struct(F.col("a").alias("y"), F.lit(1).alias("j"), F.lit(0).alias("l")), F.struct(F.col("b").alias("y"), F.lit(0).alias("j"), F.lit(1).alias("l")))).alias("m")).select("m.*")
    g = moves.groupBy("y").agg(F.sum("j").alias("joiners"), F.sum("l").alias("leavers"))
    w = Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    opening = F.coalesce(F.sum(F.col("joiners") - F.col("leavers")).over(w), F.lit(0))
    return g.withColumn("opening", opening).select("y", "opening", "joiners", "leavers", (F.col("opening") + F.col("joiners") - F.col("leavers")).alias("closing"))


@query("""SELECT o_orderkey, k AS instalment, CAST(CASE WHEN k < n THEN g // n ELSE g - g // n * (n - 1) END AS BIGINT) AS cents, CAST(g - CASE WHEN k < n THEN g // n * k ELSE g END AS BIGINT) AS left_ FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS g, 3 + o_custkey % 4 AS n FROM orders WHERE o_orderstatus = 'P'), (SELECT unnest(range(1, 7)) AS k) WHERE k <= n""")
def loan_schedule(spark, d):
    """Instalments of a loan with the rest in the last one."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", _cents("o_totalprice").alias("g"), (3 + F.col("o_custkey") % 4).alias("n"))
    k = o.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return k.select("o_orderkey", F.col("k").alias("instalment"), F.expr("case when k < n then g div n else g - g div n * (n - 1) end").alias("cents"), F.expr("g - case when k < n then g div n * k else g end").alias("left_"))
