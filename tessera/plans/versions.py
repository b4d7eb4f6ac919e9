"""Two versions of a document: from blocks to the report of their differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.alignment import align, differences, merged_changes
from ..operators.cleanup import cleaned, report, scored, verified
from ..operators.relational import stored
from ..sources.tables import table
from .registry import query


def _cells(text):
    """All words of a text as cells of rows of three."""
    words = F.split(text, r"\s+")
    return F.transform(words, lambda w, i: F.struct(F.floor(i / 3).cast("int").alias("row"), (i % 3).cast("int").alias("col"), w.alias("text")))


def _blocks(spark, d):
    """Conversations as jobs: every turn is a block of version a; version b lacks some, gains others, and has words changed."""
    turn = F.col("turn")
    kind = F.when(turn % 6 == 4, "table").when(turn % 7 == 5, "annotation").when(turn % 2 == 0, "heading").otherwise("text")
    place = F.when(turn % 9 == 0, 0.02).when(turn % 9 == 8, 0.92).otherwise(0.4)
    a = table(spark, d, "conversations").select(
        F.col("conv_id").alias("job"), turn.alias("pos"), (F.floor(turn / 3) + 1).alias("page"), kind.alias("type"), F.when(turn % 2 == 0, F.col("role")).alias("section_title"), "text",
        F.slice(F.split("text", " "), 1, 3).alias("headers"), place.alias("y"), F.lit(0.05).alias("height"),
    )
    changed = F.when(turn_of("pos", 3), F.concat("text", F.lit(" anew"))).otherwise(F.regexp_replace("text", r"^\w+", "Now"))
    b = a.where(~turn_of("pos", 5)).withColumn("text", changed)
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    grid = F.col("type") == "table"
    cells = F.when(grid, _cells(F.col("text")))
    return both.withColumns({"cells": cells, "rows": F.when(grid, F.ceil(F.size(_cells(F.col("text"))) / 3).cast("int")), "cols": F.when(grid, F.lit(3))})


def turn_of(column: str, n: int):
    return F.col(column) % n == n - 1


def _differences(spark, d):
    blocks = _blocks(spark, d)
    return differences(blocks, stored(align(blocks)))


@query()
def block_alignment(spark, d):
    return align(_blocks(spark, d)).select("job", "a", "b", F.round("score", 6).alias("score"), "scope")


@query()
def version_differences(spark, d):
    """Differences of two versions with the cells, rows and headers of their tables."""
    return _differences(spark, d).select("job", "number", "a", "b", "page_a", "page_b", "type", "before", "after", "context")


@query()
def clean_differences(spark, d):
    """Scored differences after the five passes of the clean-up."""
    return cleaned(scored(_differences(spark, d))).drop("y_a", "height_a", "y_b", "height_b")


@query()
def difference_report(spark, d):
    """From blocks to the report of each job: alignment, differences, significance, clean-up, figures and verdict."""
    rows = cleaned(scored(_differences(spark, d)))
    return report(rows.withColumn("status", F.when(F.col("auto_confirmed"), "confirmed").otherwise("pending")))


def _reviewed(spark, d):
    rows = cleaned(scored(_differences(spark, d))).withColumn("status", F.when(F.col("auto_confirmed"), "confirmed").otherwise("pending"))
    rows = stored(rows.select("job", "number", "type", "significance", "status", "before", "after"))
    act = lambda at, action, significance, after: F.struct(F.lit(at).alias("at"), F.lit(action).alias("action"), significance.cast("string").alias("significance"), after.cast("string").alias("after"))
    none, odd = F.lit(None), F.col("number") % 2 == 1
    steps = F.array(act(1, "flagged", none, none), act(2, "corrected", F.when(odd, F.lit("material")), F.when(odd, F.concat(F.lit("[checked] "), F.col("after")))), act(3, "confirmed", F.when(F.col("number") % 3 == 0, F.lit("cosmetic")), none))
    actions = rows.where("number % 4 <> 0").select("job", "number", F.explode(F.slice(steps, F.lit(1), F.col("number") % 4)).alias("s")).select("job", "number", "s.*")
    return verified(rows, actions)


@query()
def review_outcome(spark, d):
    """Differences after reviewers' actions; which of them came into a verified status for the first time."""
    return _reviewed(spark, d)[0]


@query()
def correction_log(spark, d):
    """A row for each action that gave another significance, with the one before."""
    return _reviewed(spark, d)[1]


@query()
def merged_differences(spark, d):
    """Differences whose deletions and additions of a page are merged."""
    c = table(spark, d, "conversations")
    gone, page = F.col("turn") % 2 == 0, F.floor(F.col("turn") / 4) + 1
    rows = c.select(F.col("conv_id").alias("job"), F.col("turn").alias("number"), F.when(gone, page).alias("page_a"), F.when(~gone, page).alias("page_b"), F.when(gone, "text_deletion").otherwise("text_addition").alias("type"), F.when(gone, F.col("text")).otherwise("").alias("before"), F.when(gone, "").otherwise(F.col("text")).alias("after"))
    return merged_changes(rows.withColumns({"y_b": F.lit(0.4), "height_b": F.lit(0.1)})).drop("y_b", "height_b")
