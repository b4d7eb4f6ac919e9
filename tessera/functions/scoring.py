"""Significance rules and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def _rated(significance: str, confidence: float) -> Column:
    return F.struct(F.lit(significance).alias("significance"), F.lit(confidence).alias("confidence"))


def modification(before: Column, after: Column) -> Column:
    """struct(significance, confidence) of a text modification: the first rule that holds decides."""
    a, b = T.stripped(before), T.stripped(after)
    # What holds if it holds on either side is looked for in both at once; no pattern spans the line between.
    both = F.concat(a, F.lit("\n\u0000\n"), b)
    ids = r"[A-Z]{2,4}-\d{3,}"
    bare = lambda c: T.stripped(F.regexp_replace(c, r"[A-Z]{2,4}-[\d-]+[A-Z]?", ""))
    dated = both.rlike(T.DATE)
    close = T.jaccard(a, b)
    # Rule order, significance and confidence.
    rules = [
        (a == b, "cosmetic", 0.99),
        (T.spaced(a) == T.spaced(b), "cosmetic", 0.97),
        (T.without_punctuation(a) == T.without_punctuation(b), "cosmetic", 0.92),
        (F.lower(a) == F.lower(b), "cosmetic", 0.95),
        (both.rlike(T.VERSION), "cosmetic", 0.93),
        (a.rlike(ids) & b.rlike(ids) & (bare(a) == bare(b)), "cosmetic", 0.92),
        (both.rlike(T.NUMBER) & (T.number_set(a) != T.number_set(b)), "material", 0.92),
        (dated & F.lower(both).rlike(T.DATE_WORDS), "cosmetic", 0.88),
        (dated, "substantive", 0.85),
        (both.rlike(T.CURRENCY), "material", 0.93),
        (both.rlike(T.LEGAL), "material", 0.85),
        ((F.length(a) <= 3) & (F.length(b) <= 3), "cosmetic", 0.82),
        (close > 0.85, "cosmetic", 0.78),
        (close < 0.50, "substantive", 0.80),
    ]
    out = _rated("uncertain", 0.65)
    for condition, significance, confidence in reversed(rules):
        out = F.when(condition, _rated(significance, confidence)).otherwise(out)
    return out


def significance(kind: Column, before: Column, after: Column) -> Column:
    """struct(significance, confidence) of a difference of any type."""
    before, after = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    one = F.when(T.stripped(before) != "", T.stripped(before)).otherwise(T.stripped(after))
    # Significance and confidence by type.
    return (
        F.when(kind == "formatting_change", _rated("cosmetic", 0.95))
        .when(kind.isin("annotation_present_in_b", "annotation_removed_from_b"), _rated("substantive", 0.85))
        .when(kind.isin("table_cell_change", "table_row_addition", "table_row_deletion", "table_structure_change"), _rated("material", 0.95))
        .when(kind.isin("text_addition", "text_deletion"), F.when(one == "", _rated("cosmetic", 0.97)).when(T.is_filler(one), _rated("cosmetic", 0.88)).otherwise(_rated("substantive", 0.92)))
        .when(kind == "section_moved", _rated("substantive", 0.80))
        .when(kind == "text_modification", modification(before, after))
        .otherwise(_rated("uncertain", 0.50))
    )


def flags(significance: Column, confidence: Column, threshold: float = 0.90) -> tuple[Column, Column]:
    """(needs verification, confirmed automatically)"""
    return confidence < 0.75, (confidence >= threshold) & (significance != "uncertain")


def z_class(value: Column, mean: Column, deviation: Column, n: Column) -> Column:
    """HIGH beyond 2 deviations, MEDIUM beyond 1.5; needs three points of history; without variance any change is HIGH."""
    z = F.abs(value - mean) / F.nullif(deviation, F.lit(0.0))
    return F.when(n < 3, None).when((deviation == 0) & (value != mean), "HIGH").when(deviation == 0, "NORMAL").when(z > 2, "HIGH").when(z > 1.5, "MEDIUM").otherwise("NORMAL")
