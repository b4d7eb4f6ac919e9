"""Joins by place, trees, scans, alerts, sinks and pages against plain models."""

import math
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import hierarchy, pages, scans, sinks, spatial
from tessera.streaming import alerts


def iou(a, b):
    x1, y1, x2, y2 = max(a[0], b[0]), max(a[1], b[1]), min(a[0] + a[2], b[0] + b[2]), min(a[1] + a[3], b[1] + b[3])
    if x1 >= x2 or y1 >= y2:
        return 0.0
    both = (x2 - x1) * (y2 - y1)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


BOX = "page long, id long, type string, x double, y double, width double, height double, text string, confidence double"


@pytest.mark.parametrize("cell", [0.07, 0.25, 3.0])
def test_merged_extractions(spark, cell):
    r = random.Random(4)
    side = lambda n, p: [(p, i, r.choice(["text", "annotation", None]), r.choice([0.1, 0.2, 0.3]), r.choice([0.0, 0.15, 0.4]) + r.random() * 0.1, r.choice([0.0, 0.3, 0.4]), r.choice([0.3, 0.45]), r.choice([None, "", "short", "a longer text"]), r.choice([None, 0.5, 0.95])) for i in range(n)]
    layout = [b for p in range(6) for b in side(12, p)] + [(7, 1, "text", None, 0.1, 0.2, 0.2, "x", 0.5)]
    exact = [b for p in range(1, 7) for b in side(15, p)] + [(p, 90 + k, "text", 0.5, 0.5, 0.2, 0.2, f"tie {k}", 0.1) for p in (1, 2) for k in (1, 0)] + [(7, 1, "text", 0.0, 0.1, 0.2, 0.2, "xx", 0.5)]
    layout += [(1, 50, "text", 0.5, 0.5, 0.2, 0.2, "tied", 0.95), (2, 51, "text", 0.5, 0.5, 0.2, 0.2, "a text much too long", 0.5)]
    want = []
    for b in layout:
        text, sure = b[7], b[8]
        if b[2] not in ("annotation", "image") and b[3] is not None:
            best = max(((iou(b[3:7], e[3:7]), -e[1], e[7] or "") for e in exact if e[0] == b[0]), default=(0, 0, ""))
            if best[0] > 0.3 and len(best[2]) > len(text or "") * 0.8:
                text, sure = best[2], None if sure is None else min(1.0, sure + 0.1)
        want.append((b[0], b[1], text, sure))
    want += [(e[0], e[1], e[7], e[8]) for e in exact if e[0] not in {b[0] for b in layout}]
    got = spatial.merged_extractions(spark.createDataFrame(layout, BOX), spark.createDataFrame(exact, BOX), ["page"], cell)
    assert Counter((x.page, x.id, x.text, x.confidence) for x in got.collect()) == Counter(want)
    assert sum(w[2] != b[7] for w, b in zip(want, layout, strict=False)) > 5


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_fences(spark):
    r = random.Random(9)
    points = [(i, r.choice([0.02, 60.0, -89.9]) + r.random() * 0.2, r.choice([10.0, 179.9, -179.95]) + r.random() * 0.05, r.choice([None, 1, 2, 3, 99]), r.choice([None, 1, 2, 3, 4])) for i in range(150)]
    fences = [(k, r.choice([1, 2, None]), r.choice([0.1, 60.1, -89.8]), r.choice([10.02, 179.95, -179.99]), r.choice([500.0, 9_000.0, 40_000.0]), k % 4 != 3) for k in range(1, 13)]
    places = [(1, 0.1, 10.0, 1e3, True), (3, 60.1, 179.9, 2e4, True), (4, 0.0, 10.0, 1e9, True), (2, 1.0, 1.0, 1.0, False)]
    got = spatial.fence_status(spark.createDataFrame(points, "id long, lat double, lon double, fence_id long, place_id long"), spark.createDataFrame(fences, "fence_id long, place_id long, lat double, lon double, radius double, active boolean"), spark.createDataFrame(places, "place_id long, lat double, lon double, radius double, enabled boolean"))
    want = {}
    for i, lat, lon, fence, place in points:
        own = [f for f in fences if f[0] == fence and f[5]]
        several = [f for f in fences if place is not None and f[1] == place and f[5]]
        old = [(p[0], None, *p[1:4]) for p in places if p[0] == place and p[4] and p[1] and p[2]]
        tried = own or several or old
        want[i] = "NO_LOCATION" if not tried else "INSIDE_GEOFENCE" if any(metres(lat, lon, f[2], f[3]) <= f[4] for f in tried) else "OUTSIDE_GEOFENCE"
    assert {x.id: x.status for x in got.collect()} == want and len(set(want.values())) == 3


def test_tree(spark):
    r = random.Random(2)
    parent = {i: r.randrange(i) if i % 9 else None for i in range(1, 120)} | {i: i - 1 if i > 200 else None for i in range(200, 260)}
    parent |= {300: 301, 301: 302, 302: 300, 303: 300, 310: 310, 320: 999, 321: 320, 0: None}
    rows = [(i, p) for i, p in parent.items()] + [(5, None), (None, 3)]
    got = {x.id: x for x in hierarchy.tree(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert set(got) == set(parent)
    for i in parent:
        way, at = [i], parent[i]
        while at is not None and at in parent and len(way) < 200:
            way.append(at)
            at = parent[at]
        ok = at is None
        x = got[i]
        assert (x.reachable, x.root, x.depth, x.path) == ((True, way[-1], len(way) - 1, way[::-1]) if ok else (False, None, None, None))
    assert max(x.depth or 0 for x in got.values()) > 50


def test_ways_of_cycles_are_not_kept(spark, monkeypatch):
    """500 nodes below a cycle of 5 (and one of 7 by itself) carry no ways; before, theirs grew to the number of nodes."""
    cycle = [(i, i % 5 + 1) for i in range(1, 6)] + [(600 + i, 600 + (i + 1) % 7) for i in range(7)]
    rows = [*cycle, *[(i, i - 1 if i > 10 else 3) for i in range(10, 510)], (1000, None), (1001, 1000), (1002, 1001), (1003, 1003)]
    longest = []

    def stored(df):
        if "way" in df.columns:
            longest.append(max(len(r.way) for r in df.select("way").collect()))
        return df.localCheckpoint()

    monkeypatch.setattr(hierarchy, "stored", stored)
    got = {r.id: r for r in hierarchy.tree(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert len(got) == len(rows) and max(longest) == 3
    assert {i: r.path for i, r in got.items() if r.reachable} == {1000: [1000], 1001: [1000, 1001], 1002: [1000, 1001, 1002]}


def test_running_total_and_back_pressure(spark):
    r = random.Random(1)
    rows = [(i, r.randint(0, 60), r.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL"]), 0) for i in range(300)]
    rows = [(i, t, p, t + r.randint(0, 20)) for i, t, p, _ in rows]
    df = spark.createDataFrame(rows, "id long, ts long, priority string, done long")
    total, want = 0, {}
    for i, t, *_ in sorted(rows, key=lambda x: (x[1], x[0])):
        total += i
        want[i] = total
    assert {x.id: x.total for x in scans.running_total(df, ["ts", "id"], F.col("id")).collect()} == want
    got = {x.id: x for x in scans.back_pressure(df, "done", {"LOW": 4, "DEFAULT": 7}).collect()}
    for i, t, p, _ in rows:
        before = lambda own: sum((s, j) < (t, i) and e > t for j, s, q, e in rows if q == own)  # noqa: B023, E731
        # An arrival that leaves at once is counted out before it is counted in.
        low = sum((s, j) < (t, i) for j, s, q, e in rows if q == "LOW") - sum(e <= t for j, s, q, e in rows if q == "LOW")
        rest = sum((s, j) < (t, i) for j, s, q, e in rows if q == "MEDIUM") - sum(e <= t for j, s, q, e in rows if q == "MEDIUM")
        assert (got[i].waiting_low, got[i].waiting_default) == (low, rest)
        assert got[i].decision == ("DROP" if p == "LOW" and (low > 4 or rest > 7) else "ALLOW")
    assert Counter(x.decision for x in got.values())["DROP"] > 10


@pytest.mark.parametrize("name", sorted(scans.MACHINES))
def test_machines(spark, name):
    machine = scans.MACHINES[name]
    r = random.Random(name)
    assert all(t in machine for after in machine.values() for t in after)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, None]), i, r.choice([*machine, "UNKNOWN", None])) for i in range(400)]
    got = {x.at: x for x in scans.transitions(spark.createDataFrame(rows, "k long, at long, wanted string"), "k", ["at"], "wanted", machine).collect()}
    state = {}
    for k, i, wanted in rows:
        before = state.setdefault(k, next(iter(machine)))
        after = wanted if wanted in machine[before] else before
        state[k] = after
        assert (got[i].state_before, got[i].accepted, got[i].state_after) == (before, before != after, after)


def _events(n=400):
    r = random.Random(6)
    t, rows = 0, []
    for i in range(n):
        t += r.randint(0, 40)
        rows.append((f"c{r.randint(0, 2)}", r.choice("ab"), pd.Timestamp(1_700_000_000 + t, unit="s").to_pydatetime(), i, r.choice(["raise", "raise", "raise", "ack", "resolve"])))
    return rows


ALERT = "company string, type string, ts timestamp, event_id long, action string"


def alert_model(rows, seconds):
    alerts_of, out = defaultdict(list), {}
    for c, k, ts, i, action in rows:
        mine, t = alerts_of[c, k], ts.timestamp()
        for a in mine:
            if a["status"] == "ACTIVE" and a["expires"] <= t:
                a["status"] = "EXPIRED"
        did = "ignored"
        if action == "raise":
            did = "suppressed" if mine and mine[-1]["status"] == "ACTIVE" else "created"
            if did == "created":
                mine.append({"status": "ACTIVE", "expires": t + seconds})
        elif mine and action == "ack" and mine[-1]["status"] == "ACTIVE":
            mine[-1]["status"], did = "ACKNOWLEDGED", "acknowledged"
        elif mine and action == "resolve" and mine[-1]["status"] in ("ACTIVE", "ACKNOWLEDGED"):
            mine[-1]["status"], did = "RESOLVED", "resolved"
        out[i] = (did, len(mine))
    return out


def test_alert_lifecycle_of_a_table(spark):
    rows = _events()
    got = {x.event_id: (x.outcome, x.alert) for x in alerts.lifecycle(spark.createDataFrame(rows, ALERT), ["company", "type"], 300).collect()}
    want = alert_model(rows, 300)
    assert got == want and {v[0] for v in want.values()} == {"created", "suppressed", "acknowledged", "resolved", "ignored"}


def test_alert_lifecycle_of_a_stream(spark, tmp_path):
    """Several micro-batches: the same outcomes as the table's form, and timers close what has expired."""
    rows = _events(200) + [("zz", "z", pd.Timestamp(1_700_100_000, unit="s").to_pydatetime(), 9_999, "ack")]
    for n, part in enumerate((rows[:90], rows[90:150], rows[150:200], rows[200:])):
        spark.createDataFrame(part, ALERT).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(ALERT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = alerts.lifecycle(stream, ["company", "type"], 300, "0 seconds").writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        got = spark.table("alerts").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {x.event_id: (x.outcome, x.alert) for x in got if x.event_id is not None} == alert_model(rows, 300)
    last = {}
    for c, k, _, i, _ in rows:
        last[c, k] = alert_model(rows, 300)[i]
    expired = Counter((x.company, x.type, x.alert) for x in got if x.outcome == "expired")
    assert expired and max(expired.values()) == 1


def test_deliveries_happen_once(spark, tmp_path):
    hour = 3600
    at = lambda s: pd.Timestamp(1_700_000_000 + s, unit="s").to_pydatetime()
    first = [("n1", "push", at(0), 1), ("n1", "push", at(10), 2), ("n1", "mail", at(20), 3), ("n2", "push", at(30), 4)]
    later = [("n1", "push", at(23 * hour), 5), ("n2", "push", at(20 * hour), 6)]
    # A watermark holds for rows of the batch after next.
    next_, then = [("n3", "push", at(60 * hour), 7)], [("n5", "push", at(60 * hour + 1), 11)]
    late = [("n4", "push", at(2 * hour), 8), ("n1", "push", at(61 * hour), 9), ("n3", "push", at(62 * hour), 10)]
    for n, part in enumerate((first, later, next_, then, late)):
        spark.createDataFrame(part, "notification string, channel string, ts timestamp, event_id long").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    stream = spark.readStream.schema("notification string, channel string, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = alerts.once(stream, ["notification", "channel"]).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    # n4 is later than the watermark and dropped; n1's key has gone after a day, n3's hasn't.
    assert sorted(x.event_id for x in spark.table("once").collect()) == [1, 3, 4, 7, 9, 11]
    table = spark.createDataFrame(first + later + next_ + then + late, "notification string, channel string, ts timestamp, event_id long")
    assert sorted(x.event_id for x in alerts.once(table, ["notification", "channel"]).collect()) == [1, 3, 4, 7, 8, 9, 11]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "rollup")
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, n long")
    b = spark.createDataFrame([("x", 5)], "k string, n long")
    for df, batch in ((a, 0), (b, 1), (b, 1), (a, 0)):
        sinks.write_partial(df, path, batch)
    assert {tuple(r) for r in sinks.rolled_up(spark, path, ["k"], ["n"]).collect()} == {("x", 6), (None, 2)}
    path = str(tmp_path / "upsert")
    one = spark.createDataFrame([(i, None if i == 7 else "a", float(i)) for i in range(50)], "id long, c string, v double")
    two = spark.createDataFrame([(3, "a", 9.0), (7, None, 8.0), (99, "z", None)], "id long, c string, v double")
    for df in (one, two, two):
        sinks.upsert(df, path, ["id", "c"], 8)
    got = {(r.id, r.c): r.v for r in spark.read.parquet(path).collect()}
    assert got == {(i, None if i == 7 else "a"): float(i) for i in range(50)} | {(3, "a"): 9.0, (7, None): 8.0, (99, "z"): None}
    assert spark.read.parquet(path).count() == 51


def test_sink_of_a_stream(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 as k").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("id long, k long").parquet(str(tmp_path / "in"))
        assert sinks.rollup_stream(stream, str(tmp_path / "out"), ["k"], str(tmp_path / "c")).awaitTermination(120)
    assert {tuple(r) for r in sinks.rolled_up(spark, str(tmp_path / "out"), ["k"], ["n"]).collect()} == {(0, 34), (1, 33), (2, 33)}


def test_deletes(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.sql("select id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id * 6) as ts from range(40)").withColumn("day", F.to_date("ts"))
    df.write.partitionBy("day").parquet(path)
    for _ in range(2):
        sinks.delete_before(spark, path, "day", "2024-01-04 07:00:00", "ts")
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(14, 40))
    assert sinks.delete_before(spark, path, "day", "2024-01-06 23:00:00", "ts") == 3
    assert min(r.id for r in spark.read.parquet(path).collect()) == 24
    t = {"a": spark.createDataFrame([(1,), (2,)], "id long"), "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "bid long, aid long"), "c": spark.createDataFrame([(10,), (11,), (None,)], "b long"), "d": spark.createDataFrame([(5,)], "x long")}
    kept = sinks.without_parents(t, spark.createDataFrame([(1,)], "id long"), [("b", "aid", "a", "id"), ("c", "b", "b", "bid")])
    assert {n: sorted(tuple(r) for r in k.collect()) if n != "c" else {r.b for r in k.collect()} for n, k in kept.items()} == {"a": [(2,)], "b": [(11, 2), (12, None)], "c": {11, None}, "d": [(5,)]}


def test_json_out_of_text(spark):
    texts = ['Here:\n```json\n{"a": 1}\n```\nand {"a": 2}', 'x {"a": 3} y', 'x {"a": 4} and {"a": 5}', "none", '```\n{"a": 6\n```', '[{"a": 7}]', "{bad}", None, '``` {"a": 8} ```', 'pre {"a": {"b": [1, 2]}} post']
    value, flagged = pages.parsed(F.col("t"), "struct<a: string>")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(pages.json_text(F.col("t")).alias("j"), value.alias("v"), flagged.alias("f")).collect()
    assert [r.j for r in got] == ['{"a": 1}', '{"a": 3}', '{"a": 4} and {"a": 5}', None, '{"a": 6', '[{"a": 7}]', "{bad}", None, '{"a": 8}', '{"a": {"b": [1, 2]}}']
    assert [r.f for r in got] == [False, False, True, True, True, False, True, True, False, False]
    assert [r.v and r.v.a for r in got][:2] == ["1", "3"] and got[9].v.a == '{"b":[1,2]}'


def test_pages_are_normalised(spark):
    block = lambda i, text, table=None, note=None: (i, "text", text, table, note)
    table = (["Ａ  b", None], [(0, 1, " x\n y "), (1, 0, None), (1, 1, "﹨＂")])
    content = ([block("p", "Ａ  b\n c"), block("q", None, table), block("p", "ﬁ", None, (" n  o ",)), block(None, "z")], ["q", "p", "gone", ""])
    rows = [("version_a", 1, content), ("version_b", 12, None), ("version_a", 3, (None, None))]
    got = [r.content for r in pages.normalised(spark.createDataFrame(rows, f"role string, page int, content {pages.CONTENT}")).collect()]
    c = got[0]
    assert [b.id for b in c.blocks] == [f"version_a_001_blk_000{i}" for i in (1, 2, 3, 4)]
    assert [b.text for b in c.blocks] == ["A b c", None, "fi", "z"]
    assert c.reading_order == ["version_a_001_blk_0002", "version_a_001_blk_0003", "gone", "version_a_001_blk_0004"]
    assert c.blocks[1].table.headers == ["A b", None] and [(x.row, x.col, x.text) for x in c.blocks[1].table.cells] == [(0, 1, "x y"), (1, 0, None), (1, 1, '\\"')]
    assert c.blocks[2].annotation.transcription == "n o" and c.blocks[0].table is None and c.blocks[0].annotation is None
    assert got[1] is None and got[2].blocks == [] and got[2].reading_order is None


def test_page_types_and_roles(spark):
    rows = [(9, 0.0, 0.9, "scanned", 0.95), (10, 0.71, 0.05, "scanned", 0.90), (10, 0.1, 0.31, "born_digital", 0.95), (51, 0.6, 0.2, "mixed", 0.75), (51, 0.3, 0.2, "born_digital", 0.85), (50, 0.3, 0.2, "scanned", 0.70)]
    got = spark.createDataFrame(rows, "n int, i double, t double, k string, c double").select(pages.page_type(F.col("n"), F.col("i"), F.col("t")).alias("p")).collect()
    assert [(r.p.type, r.p.confidence) for r in got] == [r[3:] for r in rows]
    rows = [(20.0, True, 0.07, 0.1, "header"), (20.0, False, 0.5, 0.46, "footer"), (15.0, False, 0.5, 0.1, "heading_1"), (12.0, True, 0.5, 0.1, "heading_2"), (12.0, False, 0.5, 0.1, "text")]
    got = spark.createDataFrame(rows, "s double, b boolean, y double, h double, k string").select(pages.block_role(F.col("s"), F.col("b"), F.col("y"), F.col("h")).alias("k")).collect()
    assert [r.k for r in got] == [r[4] for r in rows]


def test_all_machines_move_in_one_scan(spark, monkeypatch):
    """F16: the requests are sorted and written once for all machines, and only a part's first key has whole maps."""
    from tessera.plans import catalogue

    written, stored = [], scans.stored
    monkeypatch.setattr(scans, "stored", lambda df: written.append(stored(df)) or written[-1])
    got = catalogue.QUERIES["state_machines"](spark, "/root/testdata/sf0.001").collect()
    assert len(written) == 1
    opening = written[0].select("user_id", "_part", "_first", F.length("_after_job").alias("n")).distinct().collect()
    assert {(x._first, x.n) for x in opening} == {(True, len(scans.MACHINES["job"])), (False, 1)}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    wanted = {(x.machine, x.event_id): x for x in got}
    assert len(wanted) == len(got) == len(events) * len(scans.MACHINES)
    for name, machine in scans.MACHINES.items():
        state = {}
        for e in events:
            x, before = wanted[name, e.event_id], state.setdefault(e.user_id, next(iter(machine)))
            state[e.user_id] = x.wanted if x.wanted in machine[before] else before
            assert (x.state_before, x.accepted, x.state_after) == (before, before != state[e.user_id], state[e.user_id])


@pytest.mark.parametrize("name", ["merged_extractions", "box_overlaps"])
def test_lines_are_numbered_once_for_both_extractions(spark, name):
    """the lines' numbers are written, so no side shuffles all lines for them again."""
    from tessera.plans import catalogue

    out = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
