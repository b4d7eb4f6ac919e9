"""Queries on joins by place, trees, scans, alerts, sinks and pages, over tables or what is derived from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import hierarchy, pages, scans, sinks, spatial
from ..operators.relational import shared_dir, stored
from ..sources.tables import table
from ..streaming import alerts
from .registry import query

#: A line's number in its order; line numbers alone may repeat.
_NUMBER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_NUMBER_SQL = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_NUMBER)})"


def numbered_lines(spark, d):
    return table(spark, d, "lineitem").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_NUMBER)))


# Two extractions of an order as a page: every line is a box; the second one's boxes are moved and its texts longer or shorter.
_SQL_BOXES = f"""li AS (SELECT *, {_NUMBER_SQL} AS k FROM lineitem),
l AS (SELECT l_orderkey AS page, k AS id, CASE l_returnflag WHEN 'A' THEN 'annotation' WHEN 'N' THEN 'text' END AS type, l_discount * 5 AS x, l_linenumber / 8.0 AS y, 0.1 + l_tax * 5 AS width, 0.15 AS height, repeat('x', CAST(l_quantity AS INTEGER)) AS text, l_quantity / 60 AS confidence FROM li),
e AS (SELECT l_orderkey AS page, k AS id, l_discount * 5 + (l_partkey % 10) * 0.03 AS x, l_linenumber / 8.0 + (l_suppkey % 10) * 0.01 AS y, 0.1 + l_tax * 5 AS width, 0.15 AS height, repeat('y', CAST(floor(l_quantity * (CAST(0.5 AS DOUBLE) + (l_partkey % 7) * CAST(0.1 AS DOUBLE))) AS INTEGER)) AS text FROM li WHERE l_linenumber <> 3)"""


def _boxes(spark, d):
    # Written once: both extractions read the numbered lines, which are shuffled for their numbers.
    l = stored(numbered_lines(spark, d).select("l_orderkey", "k", "l_returnflag", "l_discount", "l_linenumber", "l_tax", "l_quantity", "l_partkey", "l_suppkey"))
    size = [(F.lit(0.1) + F.col("l_tax") * 5).alias("width"), F.lit(0.15).alias("height")]
    id_ = [F.col("l_orderkey").alias("page"), F.col("k").cast("long").alias("id")]
    kind = F.when(F.col("l_returnflag") == "A", "annotation").when(F.col("l_returnflag") == "N", "text")
    a = l.select(*id_, kind.alias("type"), (F.col("l_discount") * 5).alias("x"), (F.col("l_linenumber") / 8.0).alias("y"), *size, F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"), (F.col("l_quantity") / 60).alias("confidence"))
    longer = F.floor(F.col("l_quantity") * (F.lit(0.5) + (F.col("l_partkey") % 7) * 0.1)).cast("int")
    b = l.where("l_linenumber <> 3").select(*id_, F.lit(None).cast("string").alias("type"), (F.col("l_discount") * 5 + (F.col("l_partkey") % 10) * 0.03).alias("x"), (F.col("l_linenumber") / 8.0 + (F.col("l_suppkey") % 10) * 0.01).alias("y"), *size, F.repeat(F.lit("y"), longer).alias("text"), F.lit(None).cast("double").alias("confidence"))
    return a, b


@query(f"""WITH {_SQL_BOXES},
p AS (SELECT l.page, l.id AS a, e.id AS b, least(l.x + l.width, e.x + e.width) - greatest(l.x, e.x) AS w, least(l.y + l.height, e.y + e.height) - greatest(l.y, e.y) AS h, (l.x + l.width - l.x) * (l.y + l.height - l.y) + (e.x + e.width - e.x) * (e.y + e.height - e.y) AS areas FROM l JOIN e USING (page)),
s AS (SELECT page, a, b, w * h / (areas - w * h) AS iou FROM p WHERE w > 0 AND h > 0)
SELECT page, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(iou, 6) AS iou FROM s QUALIFY row_number() OVER (PARTITION BY page, a ORDER BY iou DESC, b) = 1""")
def box_overlaps(spark, d):
    """For each box of a page the box of the other extraction with the largest overlap."""
    a, b = _boxes(spark, d)
    return spatial.best_overlaps(a, b, ["page"]).withColumn("iou", F.round("iou", 6))


@query(f"""WITH {_SQL_BOXES},
p AS (SELECT l.page, l.id AS a, e.id AS b, e.text, least(l.x + l.width, e.x + e.width) - greatest(l.x, e.x) AS w, least(l.y + l.height, e.y + e.height) - greatest(l.y, e.y) AS h, (l.x + l.width - l.x) * (l.y + l.height - l.y) + (e.x + e.width - e.x) * (e.y + e.height - e.y) AS areas FROM l JOIN e USING (page) WHERE coalesce(l.type, '') <> 'annotation'),
s AS (SELECT page, a, b, text, w * h / (areas - w * h) AS iou FROM p WHERE w > 0 AND h > 0),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page, a ORDER BY iou DESC, b) = 1),
r AS (SELECT l.page, l.id, l.text, m.text AS other, m.iou > CAST(0.3 AS DOUBLE) AND length(m.text) > length(l.text) * CAST(0.8 AS DOUBLE) AS takes, confidence FROM l LEFT JOIN m ON m.page = l.page AND m.a = l.id)
SELECT page, CAST(id AS BIGINT) AS id, CASE WHEN takes THEN other ELSE text END AS text, round(CASE WHEN takes THEN least(1, confidence + 0.1) ELSE confidence END, 6) AS confidence FROM r""")
def merged_extractions(spark, d):
    """Texts of one extraction put into the boxes of the other."""
    a, b = _boxes(spark, d)
    return spatial.merged_extractions(a, b, ["page"]).select("page", "id", "text", F.round("confidence", 6).alias("confidence"))


_SQL_PLACES = """p AS (SELECT c_custkey AS id, c_nationkey * 1.0 + (c_custkey % 13) * 0.01 AS lat, (c_custkey % 40) * 1.0 + (c_custkey % 17) * 0.01 AS lon, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 100 END AS fence_id, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS place_id FROM customer),
f AS (SELECT s_suppkey AS fence_id, CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey END AS place_id, s_nationkey * 1.0 AS lat, (s_suppkey % 40) * 1.0 AS lon, 1000.0 * (s_suppkey % 300) AS radius, s_suppkey % 4 > 0 AS active FROM supplier),
n AS (SELECT n_nationkey AS place_id, n_nationkey * 1.0 AS lat, 20.0 AS lon, 900000.0 AS radius, n_nationkey % 2 = 0 AS enabled FROM nation)"""
_SQL_METRES = "2 * 6371000 * atan2(sqrt({h}), sqrt(1 - {h}))"


def _metres(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    return _SQL_METRES.format(h=h)


@query(f"""WITH {_SQL_PLACES},
own AS (SELECT p.id, {_metres("p", "f")} <= f.radius AS hit FROM p JOIN f USING (fence_id) WHERE active),
loc AS (SELECT p.id, bool_or({_metres("p", "f")} <= f.radius) AS hit FROM p JOIN f ON f.place_id = p.place_id WHERE active GROUP BY p.id),
old AS (SELECT p.id, {_metres("p", "n")} <= n.radius AS hit FROM p JOIN n ON n.place_id = p.place_id WHERE enabled AND n.lat <> 0 AND n.lon <> 0)
SELECT id, coalesce(CASE WHEN coalesce(own.hit, loc.hit, old.hit) THEN 'INSIDE_GEOFENCE' WHEN NOT coalesce(own.hit, loc.hit, old.hit) THEN 'OUTSIDE_GEOFENCE' END, 'NO_LOCATION') AS status FROM p LEFT JOIN own USING (id) LEFT JOIN loc USING (id) LEFT JOIN old USING (id)""")
def fence_status(spark, d):
    """Own fence, else the place's fences, else the place's circle: customers among the fences of suppliers."""
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    k = F.col("c_custkey")
    points = c.select(k.alias("id"), (F.col("c_nationkey") + (k % 13) * 0.01).alias("lat"), (k % 40 + (k % 17) * 0.01).alias("lon"), F.when(k % 5 == 0, k % 100).alias("fence_id"), F.when(k % 7 > 0, F.col("c_nationkey")).alias("place_id"))
    fences = s.select(F.col("s_suppkey").alias("fence_id"), F.when(F.col("s_nationkey") % 3 > 0, F.col("s_nationkey")).alias("place_id"), F.col("s_nationkey").cast("double").alias("lat"), (F.col("s_suppkey") % 40).cast("double").alias("lon"), ((F.col("s_suppkey") % 300) * 1000.0).alias("radius"), (F.col("s_suppkey") % 4 > 0).alias("active"))
    places = n.select(F.col("n_nationkey").alias("place_id"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(20.0).alias("lon"), F.lit(900_000.0).alias("radius"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    return spatial.fence_status(points, fences, places, 0.5)


_SQL_TREE = "t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 0 THEN c_custkey + 100000000 WHEN c_custkey > 50 AND c_custkey % 50 = 0 THEN c_custkey + 1 WHEN c_custkey > 50 AND c_custkey % 50 = 1 THEN c_custkey - 1 WHEN c_custkey > 5 THEN c_custkey // 2 END AS parent FROM customer)"


@query(f"""WITH RECURSIVE {_SQL_TREE},
r(id, root, depth, path) AS (SELECT id, id, 0, CAST(id AS VARCHAR) FROM t WHERE parent IS NULL UNION ALL SELECT t.id, root, depth + 1, path || '/' || CAST(t.id AS VARCHAR) FROM t JOIN r ON t.parent = r.id)
SELECT id, root, depth, path, (SELECT count(*) FROM t k WHERE k.parent = r.id) AS reports FROM r""")
def org_tree(spark, d):
    """Customers as a hierarchy by their keys, with orphans and cycles, which no root reaches: root, depth, path and reports of the others."""
    k = F.col("c_custkey")
    parent = F.when(k % 97 == 0, k + 100_000_000).when((k > 50) & (k % 50 == 0), k + 1).when((k > 50) & (k % 50 == 1), k - 1).when(k > 5, F.expr("c_custkey div 2"))
    nodes = table(spark, d, "customer").select(k.alias("id"), parent.alias("parent"))
    x = hierarchy.tree(nodes)
    below = x.where("parent is not null").groupBy(F.col("parent").alias("boss")).agg(F.count("*").alias("reports"))
    x = x.where("reachable").join(below, F.col("id") == F.col("boss"), "left")
    return x.select("id", "root", "depth", F.array_join("path", "/").alias("path"), F.coalesce("reports", F.lit(0)).alias("reports"))


@query("""SELECT o_orderkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) / 100.0 AS total FROM orders""")
def running_revenue(spark, d):
    """A running total over all orders by date, scanned in parts."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return scans.running_total(o, ["o_orderdate", "o_orderkey"], F.col("cents")).select("o_orderkey", (F.col("total") / 100.0).alias("total"))


@query("""WITH e AS (SELECT event_id AS id, epoch_us(ts) AS t, CASE event_type WHEN 'view' THEN 'LOW' WHEN 'error' THEN 'CRITICAL' WHEN 'signup' THEN 'HIGH' ELSE 'MEDIUM' END AS priority, epoch_us(ts) + CAST(floor(value * 40) AS BIGINT) * 1000000 AS done FROM events),
s AS (SELECT t, 1 AS kind, id, priority, CASE WHEN priority = 'LOW' THEN 1 ELSE 0 END AS low, CASE WHEN priority = 'MEDIUM' THEN 1 ELSE 0 END AS medium FROM e UNION ALL SELECT done, 0, id, priority, CASE WHEN priority = 'LOW' THEN -1 ELSE 0 END, CASE WHEN priority = 'MEDIUM' THEN -1 ELSE 0 END FROM e WHERE priority IN ('LOW', 'MEDIUM')),
w AS (SELECT *, sum(low) OVER o - low AS waiting_low, sum(medium) OVER o - medium AS waiting_default FROM s WINDOW o AS (ORDER BY t, kind, id ROWS UNBOUNDED PRECEDING))
SELECT id, CAST(waiting_low AS BIGINT) AS waiting_low, CAST(waiting_default AS BIGINT) AS waiting_default, CASE WHEN priority = 'LOW' AND (waiting_low > 3 OR waiting_default > 6) THEN 'DROP' ELSE 'ALLOW' END AS decision FROM w WHERE kind = 1""")
def back_pressure(spark, d):
    """Lengths of two queues at every arrival; low priorities are dropped while one of them is over its limit."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    priority = F.when(kind == "view", "LOW").when(kind == "error", "CRITICAL").when(kind == "signup", "HIGH").otherwise("MEDIUM")
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), us.alias("ts"), priority.alias("priority"), (us + F.floor(F.col("value") * 40).cast("long") * 1_000_000).alias("done"))
    return scans.back_pressure(e, "done", {"LOW": 3, "DEFAULT": 6}).select("id", "waiting_low", "waiting_default", "decision")


@query()
def state_machines(spark, d):
    """Requests of users to move through each of the eight machines; which were accepted, and the states left."""
    wanted = lambda name, machine: F.element_at(F.array(*[F.lit(s) for s in machine]), (F.pmod(F.xxhash64("event_id", F.lit(name)), F.lit(len(machine))) + 1).cast("int"))
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    x = scans.several_transitions(e, "user_id", ["ts", "event_id"], {n: (wanted(n, m), m) for n, m in scans.MACHINES.items()})
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("machine"), "event_id", f"{n}.*") for n in scans.MACHINES])).alias("r")
    return x.select(each).select("r.*")


@query()
def alert_lifecycle(spark, d):
    """Alerts of users by type of event: made unless one is active, acknowledged, resolved, expired after six hours."""
    action = F.when(F.col("event_id") % 7 == 3, "ack").when(F.col("event_id") % 7 == 5, "resolve").otherwise("raise")
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", action.alias("action"))
    return alerts.lifecycle(e, ["user_id", "event_type"], 6 * 3600).select("user_id", "event_type", "event_id", "action", "outcome", "alert")


@query()
def deliver_once(spark, d):
    """Deliveries whose user and type weren't served in the 24 hours before."""
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return alerts.once(e, ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def rollup_in_batches(spark, d):
    """A rollup that three batches wrote as shares, one of them twice."""
    path = f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
    e = table(spark, d, "events").withColumn("batch", F.col("event_id") % 3)
    for batch in (0, 1, 2, 1):
        sinks.write_partial(e.where(F.col("batch") == batch).groupBy("event_type", "user_id").agg(F.count("*").alias("n")), path, batch)
    return sinks.rolled_up(spark, path, ["event_type", "user_id"], ["n"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END AS balance FROM customer")
def customer_upsert(spark, d):
    """A table in a folder after an upsert of a third of its keys, done twice."""
    path = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new "), F.col("name")).alias("name"), (-F.col("balance")).alias("balance"))
    for rows in (c, new, new):
        sinks.upsert(rows, path, ["c_custkey"], 16)
    return spark.read.parquet(path).drop("bucket")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey <> 7), o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)), l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)))
SELECT 'customer' AS name, (SELECT count(*) FROM c) AS rows, (SELECT CAST(sum(k) AS BIGINT) FROM c) AS keys UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT CAST(sum(k) AS BIGINT) FROM o) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l), (SELECT CAST(sum(l_orderkey) AS BIGINT) FROM l)""")
def cascade_delete(spark, d):
    """What customers, orders and lines keep after the customers of a nation went with all that hangs on them."""
    tables = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    kept = sinks.without_parents(tables, tables["customer"].where("c_nationkey = 7").select("c_custkey"), [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    out = [kept[n].agg(F.lit(n).alias("name"), F.count("*").alias("rows"), F.sum(k).alias("keys")) for n, k in keys.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(r"""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Sure: ' || props || ' done' WHEN 2 THEN 'Both ' || props || ' and ' || props ELSE 'no ' || replace(props, '}', '') END AS text FROM events),
j AS (SELECT event_id, CASE WHEN event_id % 4 < 2 THEN regexp_extract(text, '(\{.*\})', 1, 's') END AS found FROM t)
SELECT event_id, CAST(json_extract_string(found, '$.k') AS BIGINT) AS k, found IS NULL AS flagged FROM j""")
def json_from_text(spark, d):
    """The JSON that answers hold: fenced, bare, two at once (flagged) or broken (flagged)."""
    n = F.col("event_id") % 4
    text = F.when(n == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done"))).when(n == 2, F.concat(F.lit("Both "), "props", F.lit(" and "), "props")).otherwise(F.concat(F.lit("no "), F.regexp_replace("props", "[}]", "")))
    value, flagged = pages.parsed(text, "struct<k: bigint>")
    return table(spark, d, "events").select("event_id", value["k"].alias("k"), flagged.alias("flagged"))


def _pages(spark, d):
    """Conversations as pages: every turn is a block, all words of every third one also a table."""
    c = table(spark, d, "conversations")
    words = F.split("text", r"\s+")
    cells = F.transform(words, lambda w, i: F.struct(F.floor(i / 4).cast("int").alias("row"), (i % 4).cast("int").alias("col"), F.concat(F.lit(" "), w, F.lit("\t")).alias("text")))
    grid = F.when(F.col("turn") % 3 == 2, F.struct(F.slice(words, 1, 2).alias("headers"), cells.alias("cells")))
    note = F.when(F.col("turn") % 5 == 4, F.struct(F.col("role").alias("transcription")))
    block = F.struct(F.concat(F.lit("b"), (F.col("turn") % 4).cast("string")).alias("id"), F.lit("text").alias("type"), F.col("text").alias("text"), grid.alias("table"), note.alias("annotation"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("r"))
    blocks = F.transform("r", lambda r: r["b"])
    content = F.struct(blocks.alias("blocks"), F.concat(F.reverse(F.transform(blocks, lambda b: b["id"])), F.array(F.lit("gone"))).alias("reading_order")).cast(pages.CONTENT)
    return rows.select("conv_id", F.lit("version_a").alias("role"), (F.col("conv_id") % 1000).cast("int").alias("page"), content.alias("content"))


@query()
def normalised_pages(spark, d):
    """Pages with new block ids, normalised texts, cells and headers, and the reading order in the new ids."""
    return pages.normalised(_pages(spark, d)).select("conv_id", F.to_json("content").alias("content"))


@query("""WITH p AS (SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n, length(html) AS total, (length(html) - length(replace(html, '<', ''))) AS tags FROM pages), c AS (SELECT page_id, n, least(1.0, tags * 20.0 / greatest(total, 1)) AS images, n / greatest(total, 1) AS texts FROM p)
SELECT page_id, CASE WHEN n < 10 THEN 'scanned' WHEN images > 0.7 AND texts < 0.1 THEN 'scanned' WHEN texts > 0.3 AND images < 0.2 THEN 'born_digital' WHEN images > 0.5 AND n > 50 THEN 'mixed' WHEN n > 50 THEN 'born_digital' ELSE 'scanned' END AS type,
CASE WHEN n < 10 THEN 0.95 WHEN images > 0.7 AND texts < 0.1 THEN 0.90 WHEN texts > 0.3 AND images < 0.2 THEN 0.95 WHEN images > 0.5 AND n > 50 THEN 0.75 WHEN n > 50 THEN 0.85 ELSE 0.70 END AS confidence FROM c""")
def page_types(spark, d):
    """Types of web pages by the length of their text and the shares of text and markup."""
    n, total = F.length(F.regexp_replace("html", "<[^>]*>", "")), F.greatest(F.length("html"), F.lit(1))
    tags = F.length("html") - F.length(F.replace("html", F.lit("<"), F.lit("")))
    x = spark.read.parquet(f"{d}/pages.parquet").select("page_id", n.alias("n"), F.least(F.lit(1.0), tags * 20.0 / total).alias("images"), (n / total).alias("texts"))
    return x.select("page_id", pages.page_type(F.col("n"), F.col("images"), F.col("texts")).alias("p")).select("page_id", "p.type", "p.confidence")
