"""Scans over long histories that no single task reads whole: running totals and state machines.

Rows are dealt by range of key and order. Each task scans its own part; what a part does to
the state in front of it (a total to add, a map from states to states) is one row, and the
parts' rows are composed in order and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .relational import stored


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return stored(ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))


def running_total(df: DataFrame, order: list[str], value: Column, name: str = "total") -> DataFrame:
    """Add the sum of `value` over all rows up to each one in `order` (which tells rows apart); nulls add nothing."""
    x = _placed(df.withColumn("_value", F.coalesce(value.cast("long"), F.lit(0))), order)
    sums = x.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    # One row for each part: as many as shuffle partitions.
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sums.select("_part", before.alias("_before")))
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_own", own).join(offsets, "_part").withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def medians(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """(group, median) of the values that aren't null: ranks come from a scan in parts, so a group of any size is spread over tasks.

    `tie` tells rows of one group and value apart. Groups without a value give no row; a null group is one.
    """
    x = running_total(df.where(F.col(value).isNotNull()).select(group, value, tie), [group, value, tie], F.lit(1), "_rank")
    of = x.groupBy(F.col(group).alias("_g")).agg((F.min("_rank") - 1).alias("_base"), F.count("*").alias("_n"))
    at = F.col("_rank") - F.col("_base")
    middle = x.join(of, F.col(group).eqNullSafe(F.col("_g"))).where((at == F.floor((F.col("_n") + 1) / 2)) | (at == F.floor((F.col("_n") + 2) / 2)))
    return middle.groupBy(group).agg(F.avg(value).alias("median"))


def back_pressure(arrivals: DataFrame, served: str, limits: dict[str, int]) -> DataFrame:
    """Add waiting (of each queue) and decision ALLOW or DROP: a LOW arrival is dropped while its own queue or the default one is over its limit.

    arrivals: (id, ts, priority, ...), `served` a column with the time at which an arrival
    leaves its queue. LOW waits in the queue LOW, others in DEFAULT, CRITICAL and HIGH in
    none that counts. The length of a queue is the arrivals before less the departures
    until then, of all events by time; drops aren't fed back, as only queues that are
    served anyway are measured.
    """
    queue = F.when(F.col("priority") == "LOW", "LOW").when(F.col("priority").isin("CRITICAL", "HIGH"), None).otherwise("DEFAULT")
    x = arrivals.withColumn("_queue", queue)
    # At one time departures come before arrivals, and an arrival doesn't see itself.
    steps = x.select(F.col("ts").alias("t"), F.lit(1).alias("kind"), "id", "_queue", F.lit(1).alias("d")).unionByName(x.where("_queue is not null").select(F.col(served).alias("t"), F.lit(0).alias("kind"), "id", "_queue", F.lit(-1).alias("d")))
    order = ["t", "kind", "id"]
    for name in limits:
        steps = running_total(steps, order, F.when(F.col("_queue") == name, F.col("d")).otherwise(0), name)
    seen = steps.where("kind = 1").select("id", *[(F.col(n) - F.when(F.col("_queue") == n, 1).otherwise(0)).alias(f"waiting_{n.lower()}") for n in limits])
    over = F.lit(False)
    for name, most in limits.items():
        over = over | (F.col(f"waiting_{name.lower()}") > most)
    return arrivals.join(seen, "id").withColumn("decision", F.when((F.col("priority") == "LOW") & over, "DROP").otherwise("ALLOW"))


# Which status may follow which.
_STAGES = ["APPLIED", "SHORTLISTED", "HR_ROUND", "TECHNICAL", "FINAL", "ASSESSMENT", "OFFER_SENT"]
MACHINES: dict[str, dict[str, list[str]]] = {
    "requisition": {"DRAFT": ["OPEN", "CANCELLED"], "OPEN": ["INTERVIEWING", "CANCELLED"], "INTERVIEWING": ["OFFERED", "CANCELLED"], "OFFERED": ["FILLED", "INTERVIEWING", "CANCELLED"], "FILLED": [], "CANCELLED": []},
    "candidate": {
        "APPLIED": ["SHORTLISTED", "REJECTED", "ON_HOLD"], "SHORTLISTED": ["HR_ROUND", "REJECTED", "ON_HOLD"], "HR_ROUND": ["TECHNICAL", "REJECTED", "ON_HOLD"], "TECHNICAL": ["FINAL", "REJECTED", "ON_HOLD"],
        "FINAL": ["ASSESSMENT", "OFFER_SENT", "REJECTED", "ON_HOLD"], "ASSESSMENT": ["OFFER_SENT", "REJECTED", "ON_HOLD"], "OFFER_SENT": ["HIRED", "REJECTED", "ON_HOLD"], "ON_HOLD": [*_STAGES, "REJECTED"], "HIRED": [], "REJECTED": [],
    },
    "offer": {"DRAFT": ["SENT", "WITHDRAWN"], "SENT": ["ACCEPTED", "REJECTED", "EXPIRED", "WITHDRAWN"], "ACCEPTED": [], "REJECTED": [], "WITHDRAWN": [], "EXPIRED": []},
    "interview": {"SCHEDULED": ["COMPLETED", "CANCELLED", "NO_SHOW"], "COMPLETED": [], "CANCELLED": [], "NO_SHOW": []},
    "nomination": {"NOMINATED": ["APPROVED", "CANCELLED"], "APPROVED": ["IN_PROGRESS", "CANCELLED"], "IN_PROGRESS": ["COMPLETED", "CANCELLED"], "COMPLETED": [], "CANCELLED": []},
    "session": {"SCHEDULED": ["IN_PROGRESS", "CANCELLED"], "IN_PROGRESS": ["COMPLETED"], "COMPLETED": [], "CANCELLED": []},
    "enrolment": {"ENROLLED": ["IN_PROGRESS", "ABANDONED"], "IN_PROGRESS": ["COMPLETED", "FAILED", "ABANDONED"], "COMPLETED": [], "FAILED": [], "ABANDONED": []},
    "job": {
        "parsing_version_a": ["parsing_version_b", "failed", "cancelled"], "parsing_version_b": ["aligning", "failed", "cancelled"], "aligning": ["diffing", "failed", "cancelled"], "diffing": ["classifying", "failed", "cancelled"],
        "classifying": ["assembling", "failed", "cancelled"], "assembling": ["ready_for_review", "failed", "cancelled"], "ready_for_review": [], "failed": [], "cancelled": [],
    },
}


def transitions(requests: DataFrame, key: str, order: list[str], wanted: str, machine: dict[str, list[str]]) -> DataFrame:
    """Add state_before, accepted and state_after of each request, in order of a key's requests from the machine's first state.

    A request that the machine doesn't allow, or an unknown or null one, leaves the state as it is.
    """
    return several_transitions(requests, key, order, {"_m": (F.col(wanted), machine)}).select(*requests.columns, "_m.state_before", "_m.accepted", "_m.state_after")


def several_transitions(requests: DataFrame, key: str, order: list[str], machines: dict[str, tuple[Column, dict[str, list[str]]]]) -> DataFrame:
    """Add struct(wanted, state_before, accepted, state_after) for each machine, all by one sort; machines: name to (wanted state, machine).

    A key's state is known where its requests begin. Only the first key of a part may have begun in
    an earlier one: there a part is a map from states to states, and the maps of a key are
    composed, so a key with very many requests is spread over tasks. A state is a letter,
    a map the letters of where each state leads, and a known state a map of the first state alone.
    """
    letters = {n: "".join(chr(48 + i) for i in range(len(m))) for n, (_, m) in machines.items()}
    x = requests.repartitionByRange(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, *order).sortWithinPartitions(key, *order)
    # The wanted states come after the sort: they aren't shuffled.
    x = x.withColumns({"_part": F.spark_partition_id()} | {f"_wanted_{n}": w for n, (w, _) in machines.items()})
    states = [f"_{when}_{n}" for n in machines for when in ("before", "after")]
    schema = StructType([*x.schema.fields, StructField("_place", LongType()), StructField("_first", BooleanType()), *[StructField(c, StringType()) for c in states]])
    steps = {n: {(i, t): j for i, s in zip(letters[n], m, strict=True) for t, j in zip(m, letters[n], strict=True) if t in m[s]} for n, (_, m) in machines.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, dict] = {n: {} for n in steps}
        now, last, first, n = {m: "" for m in steps}, object(), None, 0
        for batch in batches:
            keys = batch.column(key).to_pylist()
            starts = []
            for k in keys:
                starts.append(k != last and not (k != k and last != last))
                last = k
            opening = []
            for new in starts:
                first = first is None if new else first
                opening.append(first)
            columns = []
            for m, allowed in steps.items():
                current, known, before, after = now[m], memo[m], [], []
                for new, open_, target in zip(starts, opening, batch.column(f"_wanted_{m}").to_pylist(), strict=True):
                    if new:
                        current = letters[m] if open_ else letters[m][0]
                    before.append(current)
                    step = (current, target)
                    current = known.get(step)
                    if current is None:
                        current = known[step] = "".join(allowed.get((s, target), s) for s in step[0])
                    after.append(current)
                now[m] = current
                columns += [pa.array(before, pa.string()), pa.array(after, pa.string())]
            place = pa.array(range(n, n + len(keys)), pa.int64())
            n += len(keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, place, pa.array(opening, pa.bool_()), *columns], names=schema.names)

    parts = stored(x.mapInArrow(run, schema))
    # One key for each part.
    firsts = parts.where("_first").select(F.col(key).alias("_key")).distinct()
    edges = parts.join(F.broadcast(firsts), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    maps = edges.groupBy(key, "_part").agg(F.max_by(F.struct(*[f"_after_{n}" for n in machines]), "_place").alias("m"))
    # A key's parts: at most as many as shuffle partitions.
    listed = maps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_part", "m"))).alias("l"))
    at = lambda m, start: F.ascii(F.substr(m, start + 1, F.lit(1))) - 48
    empty = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))

    def scan(n: str) -> Column:
        return F.aggregate("l", empty, lambda a, p: F.struct(at(p["m"][f"_after_{n}"], a["s"]).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))["out"].alias(n)

    zipped = listed.select(F.col(key).alias("_key"), "l", *[scan(n) for n in machines]).select("_key", F.explode(F.arrays_zip("l", *machines)).alias("o"))
    starts = zipped.select("_key", F.col("o.l._part").alias("_p"), *[F.col("o")[n].alias(f"_start_{n}") for n in machines])
    both = parts.join(F.broadcast(starts), F.col("_first") & (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")), "left")

    def moved(n: str) -> Column:
        start = F.coalesce(f"_start_{n}", F.lit(0))
        name = lambda when: F.element_at(F.array(*[F.lit(s) for s in machines[n][1]]), at(F.col(f"_{when}_{n}"), start) + 1)
        before, after = name("before"), name("after")
        return F.struct(F.col(f"_wanted_{n}").alias("wanted"), before.alias("state_before"), (before != after).alias("accepted"), after.alias("state_after")).alias(n)

    return both.select(*requests.columns, *[moved(n) for n in machines])
