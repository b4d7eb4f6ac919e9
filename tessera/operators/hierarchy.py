"""Depth, root and path of every node of a forest by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import stored


def tree(nodes: DataFrame) -> DataFrame:
    """(id, parent, root, depth, path array, reachable) of nodes (id, parent); parents are ids or null.

    Every round doubles how far up a node sees, so rounds grow with the logarithm of the
    depth or of a cycle's length. Nodes whose way up ends in a parent that isn't there, and
    nodes of a cycle or below one, aren't reachable from a root: their root, depth and path are
    null. Of rows that repeat an id the one with the smallest parent counts (null last); null ids are left out.
    """
    one = nodes.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    known = one.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    x = one.join(known, "parent", "left")
    lost = F.col("parent").isNotNull() & F.col("there").isNull()
    # First who is lost, without ways: those of a cycle have no end, and all below it would carry them.
    # up: the highest ancestor seen so far (null: the end is reached); low: the smallest of the ancestors up to it.
    state = stored(x.select("id", "parent", F.when(~lost, F.col("parent")).alias("up"), F.when(~lost, F.col("parent")).alias("low"), lost.alias("lost")))
    while not state.where("up is not null").isEmpty():
        # Only those that still look up are joined, with one row for each ancestor.
        open_, done = state.where("up is not null"), state.where("up is null")
        above = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("low").alias("above_low"), F.col("lost").alias("above_lost"))
        more = open_.join(above, "up").select("id", "parent", F.col("further").alias("up"), F.least("low", "above_low").alias("low"), (F.col("lost") | F.col("above_lost")).alias("lost"))
        # The smallest node of a cycle is its own ancestor; whoever has it as its smallest ancestor is on the cycle or below it.
        more = stored(more)
        round_ = more.where("low = id").select("low", F.lit(True).alias("circular"))
        more = more.join(round_, "low", "left").withColumn("circular", F.col("circular").isNotNull())
        more = more.select("id", "parent", F.when(~F.col("circular"), F.col("up")).alias("up"), "low", (F.col("lost") | F.col("circular")).alias("lost"))
        state = stored(done.unionByName(more))
    # Then the ways of those that a root reaches: the nodes from below `up` down to the node. Their lengths are those of the result.
    out = state.where("lost").select("id", "parent", F.lit(False).alias("reachable"))
    state = stored(state.where("not lost").select("id", "parent", F.col("parent").alias("up"), F.array("id").alias("way")))
    while not state.where("up is not null").isEmpty():
        open_, done = state.where("up is not null"), state.where("up is null")
        above = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("way").alias("upper"))
        more = open_.join(above, "up").select("id", "parent", F.col("further").alias("up"), F.concat("upper", "way").alias("way"))
        state = stored(done.unionByName(more))
    out = state.select("id", "parent", "way", F.lit(True).alias("reachable")).unionByName(out.withColumn("way", F.lit(None).cast(state.schema["way"].dataType)))
    return out.select("id", "parent", F.col("way")[0].alias("root"), (F.size("way") - 1).alias("depth"), F.col("way").alias("path"), "reachable")
