"""Scoring of differences, their clean-up in five passes, and the figures of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import is_garbage, is_page_number, stripped, truncated
from .alignment import merged_changes
from .relational import stored

# Header and footer zones, and the words that tell one.
HEADER, FOOTER = 0.08, 0.95
ZONE_WORDS = ["header", "footer", "page number"]


def _quoted(text: Column, n: int) -> Column:
    return F.concat(F.lit('"'), truncated(F.coalesce(text, F.lit("")), n), F.lit('"'))


def summary(kind: Column, before: Column, after: Column) -> Column:
    """One line that says what changed, by type."""
    change = lambda name, n, arrow: F.concat(F.lit(name), _quoted(before, n), F.lit(arrow), _quoted(after, n))
    # Wording and lengths.
    fixed = {
        "table_structure_change": "Table structure changed (columns or dimensions differ)",
        "annotation_present_in_b": "Annotation present in Version B",
        "annotation_removed_from_b": "Annotation removed (present in Version A only)",
        "formatting_change": "Formatting difference detected",
    }
    out = F.concat(kind, F.lit(" detected"))
    for name, text in fixed.items():
        out = F.when(kind == name, F.lit(text)).otherwise(out)
    return (
        F.when(kind == "text_addition", F.concat(F.lit("Text added: "), _quoted(after, 60)))
        .when(kind == "text_deletion", F.concat(F.lit("Text deleted: "), _quoted(before, 60)))
        .when(kind == "text_modification", change("Text changed from ", 40, " to "))
        .when(kind == "table_cell_change", change("Table cell changed: ", 30, " → "))
        .when(kind == "table_row_addition", F.concat(F.lit("Table row added: "), after))
        .when(kind == "table_row_deletion", F.concat(F.lit("Table row deleted: "), before))
        .when(kind == "section_moved", F.concat(F.lit("Section moved: "), _quoted(before, 60)))
        .otherwise(out)
    )


def scored(diffs: DataFrame) -> DataFrame:
    """Add significance, confidence, needs_verification, auto_confirmed and summary."""
    out = diffs.withColumn("_r", scoring.significance(F.col("type"), F.col("before"), F.col("after")))
    needs, auto = scoring.flags(F.col("_r.significance"), F.col("_r.confidence"))
    return out.select(*diffs.columns, "_r.significance", "_r.confidence", needs.alias("needs_verification"), auto.alias("auto_confirmed"), summary(F.col("type"), F.col("before"), F.col("after")).alias("summary"))


def in_margin(y: Column, height: Column) -> Column:
    """Whether a box begins in the header's zone or ends in the footer's; a missing y is the middle, no box isn't in any."""
    top = F.coalesce(y, F.lit(0.5))
    return F.coalesce(y, height).isNotNull() & ((top < HEADER) | (top + F.coalesce(height, F.lit(0.0)) > FOOTER))


def is_marginal(diffs: DataFrame) -> Column:
    words = F.lower(F.concat_ws(" \n", "context", "summary"))
    said = F.lit(False)
    for w in ZONE_WORDS:
        said = said | words.contains(w)
    return in_margin(F.col("y_a"), F.col("height_a")) | in_margin(F.col("y_b"), F.col("height_b")) | said


def cleaned(diffs: DataFrame, chars: int = 200) -> DataFrame:
    """Scored differences of each job after five passes, numbered anew; every pass sees what the one before left.

    1. Garbled values go. 2. Equal changes in headers and footers become the first of them,
    cosmetic, of confidence .98, confirmed, with their number in the summary. 3. Page numbers
    go. 4. Of equal changes on equal pages the first stays; values of a character at most and
    cells all stay. 5. Deletions and additions of a page that are somewhat alike become
    modifications, which come last. Jobs never meet. Null values count as empty.
    """
    before, after = stripped(F.coalesce("before", F.lit(""))), stripped(F.coalesce("after", F.lit("")))
    x = diffs.withColumns({"_x": before, "_y": after}).where(~is_garbage(F.col("_x")) & ~is_garbage(F.col("_y")))
    x = x.withColumn("_zone", is_marginal(x))
    # Changes outside the margins are groups of their own: their number tells them.
    x = x.withColumn("_alone", F.when(~F.col("_zone"), F.col("number")))
    w = Window.partitionBy("job", "_zone", "_x", "_y", "type", "_alone")
    x = x.withColumns({"_n": F.count("*").over(w), "_at": F.row_number().over(w.orderBy("number"))}).where("_at = 1")
    several = F.col("_zone") & (F.col("_n") >= 2)
    note = F.concat(F.coalesce("summary", F.lit("")), F.lit(" (repeated on "), F.col("_n").cast("string"), F.lit(" pages)"))
    values = {"significance": F.lit("cosmetic"), "confidence": F.lit(0.98), "auto_confirmed": F.lit(True), "summary": note}
    x = x.withColumns({c: F.when(several, v).otherwise(F.col(c)) for c, v in values.items()})
    x = x.where(~is_page_number(F.col("_x")) & ~is_page_number(F.col("_y")))
    same = Window.partitionBy("job", "_x", "_y", "page_a", "page_b", "type").orderBy("number")
    every = ((F.length("_x") <= 1) & (F.length("_y") <= 1)) | (F.col("type") == "table_cell_change")
    x = x.withColumn("_at", F.row_number().over(same)).where(every | (F.col("_at") == 1)).select(diffs.columns)
    x = merged_changes(stored(x), chars)
    text = F.concat(F.lit('Text modified: "'), F.left("before", F.lit(50)), F.lit('" → "'), F.left("after", F.lit(50)), F.lit('"'))
    x = x.withColumn("summary", F.when(F.col("merged"), text).otherwise(F.col("summary")))
    order = Window.partitionBy("job").orderBy("merged", "number")
    return x.withColumn("number", F.row_number().over(order)).drop("merged")


#: Statuses that count as verified.
VERIFIED = ["confirmed", "dismissed", "corrected", "flagged"]


def verdict(material: Column, substantive: Column, cosmetic: Column, partial: Column) -> Column:
    """The sentence of the gravest significance that occurs; without any of the three the documents appear identical."""
    # Wording and order.
    n = lambda c: c.cast("string")
    text = (
        F.when(material > 0, F.concat(n(material), F.lit(" material difference(s) found — documents contain substantively different content requiring review.")))
        .when(substantive > 0, F.concat(n(substantive), F.lit(" substantive difference(s) found — documents differ in meaningful ways with no material impact.")))
        .when(cosmetic > 0, F.concat(n(cosmetic), F.lit(" cosmetic difference(s) only — documents are functionally equivalent.")))
        .otherwise("No differences detected — documents appear identical.")
    )
    return F.concat(F.when(partial, "[PARTIAL] ").otherwise(""), text)


def report(diffs: DataFrame) -> DataFrame:
    """Eleven figures and the verdict of each job. diffs: (job, significance, status); an uncertain one counts in the total alone."""
    of = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    g = diffs.groupBy("job").agg(
        F.count("*").alias("total"), *[of("significance", s) for s in ("material", "substantive", "cosmetic")],
        *[of("status", s) for s in ("confirmed", "dismissed", "flagged", "corrected", "pending")], F.count_if(F.col("status").isin(VERIFIED)).alias("verified"),
    )
    partial = (F.col("total") > 0) & (F.col("verified") < F.col("total"))
    return g.withColumn("is_partial", partial).withColumn("verdict", verdict(F.col("material"), F.col("substantive"), F.col("cosmetic"), F.col("is_partial")))


def verified(diffs: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Differences after the reviewers' actions, and the log of corrections.

    diffs: (job, number, significance, status, after, ...); actions: (job, number, at, action,
    significance, after). Actions are applied by time: the last status counts, and the last
    given significance and value. `first_verified` tells whether a difference came from an
    unverified into a verified status (which counts its job up once). The log has a row for
    each action that gave a significance, with the one before it.
    """
    key = ["job", "number"]
    given = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    last = actions.groupBy(*key).agg(F.max_by("action", "at").alias("new_status"), given("significance").alias("new_significance"), given("after").alias("new_after"), F.bool_or(F.col("action").isin(VERIFIED)).alias("touched"))
    out = diffs.join(last, key, "left")
    values = {"status": F.coalesce("new_status", "status"), "significance": F.coalesce("new_significance", "significance"), "after": F.coalesce("new_after", "after")}
    after = out.select(*[values.get(c, F.col(c)).alias(c) for c in diffs.columns], (F.coalesce("touched", F.lit(False)) & ~F.coalesce(F.col("status"), F.lit("")).isin(VERIFIED)).alias("first_verified"))
    upto = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    steps = actions.withColumns({"_last": F.last("significance", ignorenulls=True).over(past), "_after": F.last("after", ignorenulls=True).over(upto)})
    steps = steps.where("significance is not null").select(*key, "at", F.col("significance").alias("corrected_significance"), "_last", "_after")
    base = diffs.select(*key, "type", F.col("before").alias("value_before"), F.col("after").alias("_value"), F.col("significance").alias("_first"))
    log = steps.join(base, key).select(*key, "at", "type", "value_before", F.coalesce("_after", "_value").alias("value_after"), F.coalesce("_last", "_first").alias("original_significance"), "corrected_significance")
    return after, log
