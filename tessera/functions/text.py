"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of the significance rules (matched anywhere in the text).
NUMBER = r"\b\d[\d,._]*\b"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE = rf"(?iu)\b(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}|\d{{1,2}}\s+(?:{MONTHS})[a-z]*\.?\s+\d{{4}}|(?:{MONTHS})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}})\b"
CURRENCY = r"(?iu)[$€£₹¥]|\b(usd|eur|gbp|inr|rs\.?)\b"
LEGAL = r"(?iu)\b(shall|must|will|may not|cannot|liable|obligation|warranty|indemnif|terminat|penalt|forfeit|breach|default|notwithstanding|whereas|herein|thereof)\b"
VERSION = r"(?iu)(?:rev\.?\s*\d|version\s+\d|v\d+|rev\s*\.?\s*\d)"
DATE_WORDS = r"(date:|prepared|report|revision|version|issued)"
FILLERS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been"]
PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?\d+\s*(?:of\s+\d+)?\s*$"
NON_LATIN = r"[^\x00-\x7F\u00C0-\u024F\u1E00-\u1EFF]{3,}"
GARBLED = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f.,;:!?()'\"-]{3,}"
# Numbers as a cell may hold them, without separators.
CELL_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
#: Characters that are stripped, and their runs.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACES = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; there is no built-in for it."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE))


def normalise(text: Column) -> Column:
    """NFKC, then spaced()."""
    return spaced(nfkc(text))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal, one empty text is unlike any other."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), SPACES), lambda w: w != ""))


def set_jaccard(x: Column, y: Column) -> Column:
    """Of two sets; both empty 1, one empty 0."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(both / (F.size(x) + F.size(y) - both))


def jaccard(a: Column, b: Column) -> Column:
    """Of lower-cased token sets."""
    return set_jaccard(token_set(a), token_set(b))


def spaced(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def is_filler(text: Column) -> Column:
    """All words are fillers, and there is one."""
    words = F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(FILLERS))


def without_punctuation(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", ""))


def number_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))))


def truncated(text: Column, n: int) -> Column:
    t = stripped(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def cell_value(text: Column) -> Column:
    """Cell text without white space at its ends; a number in one form, whatever its separators and trailing zeros.

    Equal values of two cells are equal texts. Words like "nan" and "inf", and suffixes, are no numbers.
    """
    t = stripped(text)
    plain = F.regexp_replace(t, "[, ]", "")
    v = F.when(plain.rlike(CELL_NUMBER), F.regexp_replace(plain, "_", "").try_cast("double"))
    whole = (v == F.floor(v)) & (F.abs(v) < 1e18)
    usable = v.isNotNull() & (F.abs(v) < float("inf"))
    return F.when(usable & whole, F.floor(v).cast("string")).when(usable, v.cast("string")).otherwise(t)


def is_page_number(text: Column) -> Column:
    # Texts without a digit, which are most, need no strip.
    return text.rlike("[0-9]") & stripped(text).rlike(PAGE_NUMBER)


def is_garbage(text: Column) -> Column:
    """Clusters of characters that aren't Latin, of symbols, or too few letters, digits and spaces; below 2 characters never."""

    def garbled(t: Column) -> Column:
        plain = F.length(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}\s\x1c-\x1f]", ""))
        return (F.length(t) >= 2) & (t.rlike(NON_LATIN) | ((F.length(t) > 5) & (plain / F.length(t) < 0.4)) | t.rlike(GARBLED))

    # Plain texts are told at once; for the others the transform binds the stripped text to a name, so it is formed once.
    return F.coalesce(~text.rlike(r"\A[A-Za-z0-9 ]*+\z") & F.transform(F.array(stripped(text)), garbled)[0], F.lit(False))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def masked(identifier: Column) -> Column:
    return F.concat(F.lit("ANON-"), F.upper(F.right(identifier, F.lit(6))))
