"""Comparison of cell grids: cells, headers, and rows that moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_value, similarity, stripped


def cell_map(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, text): the last of cells with the same place counts. cells: (keys, pos, row, col, text)."""
    return cells.groupBy(*keys, "row", "col").agg(F.max_by("text", "pos").alias("text"))


def row_texts(cells: DataFrame, keys: list[str], width: str | None = None) -> DataFrame:
    """(keys, row, line): the texts of a row's cells in order of the columns, stripped.

    With `width`, a column that tells a table's number of columns, missing cells are empty texts and cells beyond it don't count.
    """
    parts = F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text"))))
    texts = F.transform(parts, lambda p: p["text"])
    if width:
        at = F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text"))))
        n = F.coalesce(F.max(width), F.lit(0))
        texts = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda c: F.coalesce(F.element_at(at, c), F.lit("")))).otherwise(F.array().cast("array<string>"))
    return cells.groupBy(*keys, "row").agg(stripped(F.array_join(texts, " ")).alias("line"))


def _differ(before: Column, after: Column) -> Column:
    """Whether two cells' values differ; equal texts, most of all cells, need no normal form."""
    return ~before.eqNullSafe(after) & ~cell_value(before).eqNullSafe(cell_value(after))


def grid_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, a, b): the texts of each row of two grids; null where a grid lacks it. The last of rows with the same place counts.

    rows: (keys, side 'a' or 'b', row, pos, texts array). All steps after it that stay within a
    grid keep its partitions: the rows of both grids are shuffled once, by the keys.
    """
    of = lambda s: F.max_by(F.when(F.col("side") == s, F.col("texts")), F.when(F.col("side") == s, F.col("pos"))).alias(s)
    return rows.groupBy(*keys, "row").agg(of("a"), of("b"))


def row_cell_differences(rows: DataFrame, keys: list[str]) -> DataFrame:
    """cell_differences() of the rows that grid_rows() gives; texts beyond the end of a row are missing cells."""
    pairs = F.transform(F.arrays_zip("a", "b"), lambda z, i: F.struct(i.cast("int").alias("col"), z["a"].alias("before"), z["b"].alias("after")))
    j = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("a", "b")}).select(*keys, "row", F.explode(pairs).alias("c")).select(*keys, "row", "c.*")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified")
    return j.where(_differ(F.col("before"), F.col("after"))).select(*keys, "row", "col", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), kind.alias("change"))


def unlike_rows(rows: DataFrame, keys: list[str], own: str, other: str, above: float = 0.8) -> DataFrame:
    """new_rows() of the rows that grid_rows() gives: rows of side `own` that side `other` lacks, with text, and unlike all of its rows."""
    line = lambda side: stripped(F.array_join(side, " ", ""))
    missing = rows.where(F.col(other).isNull()).select(*keys, "row", line(own).alias("line")).where("line <> ''").alias("m")
    t = rows.where(F.col(other).isNotNull()).select(*keys, line(other).alias("seen")).alias("t")
    same = (F.least(F.length("line"), F.length("seen")) > above * F.greatest(F.length("line"), F.length("seen"))) & (similarity(F.col("line"), F.col("seen")) > above)
    for k in keys:
        same = (F.col(f"m.{k}") == F.col(f"t.{k}")) & same
    return missing.join(t, same, "left_anti").select(*keys, "row")


def cell_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, before, after, change) of cells whose normalised values differ."""
    place = [*keys, "row", "col"]
    j = a.select(*place, F.col("text").alias("before")).join(b.select(*place, F.col("text").alias("after")), place, "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified")
    return j.where(_differ(F.col("before"), F.col("after"))).select(*place, F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), kind.alias("change"))


def header_differences(a: Column, b: Column) -> Column:
    """array<struct<col,before,after>> of headers that differ at their place; the shorter list is filled with ''."""
    zipped = F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(x, F.lit("")).alias("before"), F.coalesce(y, F.lit("")).alias("after")))
    placed = F.transform(zipped, lambda z, i: F.struct(i.alias("col"), z["before"].alias("before"), z["after"].alias("after")))
    return F.filter(placed, lambda z: z["before"] != z["after"])


def new_rows(own: DataFrame, other: DataFrame, keys: list[str], above: float = 0.8, width: str | None = None) -> DataFrame:
    """(keys, row): rows of own whose number other lacks, with text, and unlike every row of other.

    Only rows whose lengths allow the similarity meet; a table's rows are what its keys hold.
    """
    mine, theirs = row_texts(own, keys, width), row_texts(other, keys, width)
    missing = mine.where("line <> ''").join(theirs, [*keys, "row"], "left_anti")
    t = theirs.select(*keys, F.col("line").alias("seen"))
    like = (F.least(F.length("line"), F.length("seen")) > above * F.greatest(F.length("line"), F.length("seen"))) & (similarity(F.col("line"), F.col("seen")) > above)
    same = missing.join(t, keys).where(like).select(*keys, "row").distinct()
    return missing.join(same, [*keys, "row"], "left_anti").select(*keys, "row")


def table_similarity(headers_a: Column, headers_b: Column, size_a: Column, size_b: Column) -> Column:
    """0.7 of the headers' similarity and 0.3 of the sizes'; without headers or cells on both sides these are 1."""
    most = F.greatest(size_a, size_b)
    size = F.when(most == 0, 1.0).otherwise(1 - F.abs(size_a - size_b) / most)
    return 0.7 * similarity(F.array_join(headers_a, " "), F.array_join(headers_b, " ")) + 0.3 * size
