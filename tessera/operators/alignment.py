"""Alignment of the blocks of two versions, the differences of aligned pairs, and the merge of deletions with additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spaced, stripped
from .grids import cell_differences, cell_map, header_differences, new_rows, table_similarity
from .matching import favourites, greedy, pair_similarity, settled, word_changes
from .relational import stored

# The least similarity of pages, titles, tables, other blocks, and of a deletion and an addition.
PAGE, TITLE, TABLE, TEXT, MERGE = 0.3, 0.7, 0.5, 0.4, 0.15
TITLED = ["heading", "title", "text"]


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of version a and of version b of one job; the columns of b get the suffix _b."""
    b = rows.where("side = 'b'").drop("side")
    return rows.where("side = 'a'").drop("side"), b.select("job", *[F.col(c).alias(c + "_b") for c in b.columns if c != "job"])


def _meetings(a: DataFrame, b: DataFrame, keys: list[str], per: int) -> DataFrame:
    """Every row of a with every row of b of its keys. The rows of a are dealt to slices of about `per`, so that many tasks share a large group's pairs."""
    slices = a.groupBy(*keys).agg(F.ceil(F.count("*") / per).cast("int").alias("slices"))
    mine = a.join(slices, keys).withColumn("slice", F.pmod(F.xxhash64(*[c for c in a.columns if c not in keys]), F.col("slices")).cast("int")).drop("slices")
    # Few bytes bring much work: the slices are dealt to all partitions, which a size in bytes would put together.
    mine = mine.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "slice")
    theirs = b.join(slices, keys).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return mine.join(theirs.hint("merge"), [*keys, "slice"]).drop("slice")


def page_map(blocks: DataFrame, chars: int = 2000) -> DataFrame:
    """(job, a, b, score): pages of a with their page of b, by the similarity of the first `chars` characters.

    Comparing the start of a page is the rule's own definition. A job is one pair of documents: only its pages meet.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", _text("text").alias("t")))), lambda p: p["t"])
    pages = stored(blocks.groupBy("job", "side", "page").agg(F.left(F.array_join(parts, " "), F.lit(chars)).alias("start")))
    a, b = _sides(pages)
    texts = [F.col("page").alias("a"), F.col("page_b").alias("b"), F.col("start").alias("x"), F.col("start_b").alias("y")]
    found = stored(settled(favourites(_meetings(a, b, ["job"], 16).select("job", *texts), "job", PAGE), "job"))
    sure = found.where("sure").drop("sure")
    # What the favourites don't decide is compared in full.
    a = a.join(found.where("not sure").select("job", F.col("a").alias("page")), ["job", "page"], "left_semi")
    b = b.join(sure.select("job", F.col("b").alias("page_b")), ["job", "page_b"], "left_anti")
    pairs = _meetings(a, b, ["job"], 16).select("job", *texts[:2], pair_similarity("start", "start_b").alias("score"))
    return sure.unionByName(greedy(pairs, "job", PAGE))


def align(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(job, a, b, score): places of aligned blocks; one is null where a block has no partner.

    blocks: (job, side 'a' or 'b', pos, page, type, section_title, text, headers array, rows, cols). Titles come
    first, then tables, then the rest. Blocks of pages without a partner take no part; each such page
    of version a gives one row with `scope` set to its number and no places. Pairs whose lengths don't
    allow the similarity aren't compared.
    """
    # Several branches read the pages; their similarities are computed once.
    pages = stored(page_map(blocks)) if pages is None else pages
    whole = pages.select("job", F.lit("a").alias("side"), F.col("a").alias("page")).union(pages.select("job", F.lit("b").alias("side"), F.col("b").alias("page")))
    needed = ["job", "side", "pos", "type", "section_title", "text", "headers", "rows", "cols"]
    inside = stored(blocks.join(whole, ["job", "side", "page"], "left_semi").select(needed))
    a, b = _sides(inside)
    longer = F.greatest(F.length(_text("text")), F.length(_text("text_b")))
    fits = F.least(F.length(_text("text")), F.length(_text("text_b"))) >= longer * TEXT
    titled = [F.col("type" + s).isin(TITLED) & (_text("section_title" + s) != "") for s in ("", "_b")]
    places = [F.col("pos").alias("a"), F.col("pos_b").alias("b")]

    def left_of(a: DataFrame, b: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(x.join(taken.select("job", F.col(n).alias(c)), ["job", c], "left_anti") for x, n, c in ((a, "a", "pos"), (b, "b", "pos_b")))

    def chosen(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
        met = _meetings(a, b, ["job"], 64).where(fits).select("job", *places, _text("text").alias("x"), _text("text_b").alias("y"))
        return stored(settled(favourites(met, "job", least), "job"))

    # Titles and tables share no block, so neither pass waits for the other.
    titles = chosen(a.where(titled[0]), b.where(titled[1]), TITLE)
    size = [F.coalesce(F.col("rows" + s) * F.col("cols" + s), F.lit(0)) for s in ("", "_b")]
    grids = _meetings(a.where("type = 'table'"), b.where("type_b = 'table'"), ["job"], 64)
    tables = stored(greedy(grids.select("job", *places, table_similarity(F.col("headers"), F.col("headers_b"), *size).alias("score")), "job", TABLE))
    sure = titles.where("sure").drop("sure").unionByName(tables)
    a, b = left_of(a, b, sure)
    # The last pass waits for the titles: it has favourites in jobs whose titles are all settled.
    unsure = titles.where("not sure").select("job").distinct()
    rest = chosen(a.join(unsure, "job", "left_anti"), b.join(unsure, "job", "left_anti"), TEXT)
    last = rest.where("sure").drop("sure")
    sure = sure.unionByName(last)
    # What the favourites don't decide is compared in full.
    undecided = rest.where("not sure").select("job", F.col("a").alias("pos")).unionByName(a.join(unsure, "job", "left_semi").select("job", F.col("pos").cast("long").alias("pos")))
    a, b = left_of(a, b, last)
    # A column of its own: the similarity of a pair is computed once, whatever reads it.
    both = _meetings(a.join(undecided, ["job", "pos"], "left_semi"), b, ["job"], 64).where(fits).withColumn("like", pair_similarity(_text("text"), _text("text_b")))
    rules = [(1, titled[0] & titled[1], TITLE), (3, F.lit(True), TEXT)]
    tries = F.array(*[F.struct(F.lit(n).alias("pass"), F.when(F.coalesce(when, F.lit(False)) & (F.col("like") >= least), F.col("like")).alias("score")) for n, when, least in rules])
    pairs = both.select("job", *places, F.explode(tries).alias("t")).select("job", "a", "b", "t.pass", "t.score").where("score is not null")
    matched = sure.unionByName(greedy(pairs, "job", 0.0))
    left = matched.join(inside.where("side = 'a'").select("job", F.col("pos").alias("a")), ["job", "a"], "right")
    full = left.join(inside.where("side = 'b'").select("job", F.col("pos").alias("b")), ["job", "b"], "full")
    gone = blocks.where("side = 'a'").select("job", F.col("page").alias("scope")).distinct().join(pages.select("job", F.col("a").alias("scope")), ["job", "scope"], "left_anti")
    rows = full.select("job", "a", "b", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(None).cast("long").alias("scope"))
    return rows.union(gone.select("job", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(0.0), F.col("scope").cast("long")))


#: Columns of a block that a caller may leave out.
OPTIONAL = {"cells": "array<struct<row int, col int, text string>>", "y": "double", "height": "double", "block_type": "string"}


def _cells(pairs: DataFrame, suffix: str) -> DataFrame:
    """(job, a, b, row, col, text, cols) of the cells of one side's tables; the last of cells of one place counts."""
    each = pairs.select("job", "a", "b", F.col("cols" + suffix).alias("cols"), F.posexplode("cells" + suffix).alias("pos", "c"))
    cells = cell_map(each.select("job", "a", "b", "pos", F.col("c.row").alias("row"), F.col("c.col").alias("col"), F.coalesce("c.text", F.lit("")).alias("text")), ["job", "a", "b"])
    return cells.join(pairs.select("job", "a", "b", F.col("cols" + suffix).alias("cols")), ["job", "a", "b"])


def differences(blocks: DataFrame, aligned: DataFrame) -> DataFrame:
    """(job, number, a, b, page_a, page_b, type, before, after, context, y_a, height_a, y_b, height_b) of aligned pairs.

    number counts a job's differences from 1 in order of the blocks of a, then of b, then of
    the pages that b lacks. A pair of texts gives one difference: its word changes are
    joined, and several are a modification. A pair of tables gives a change of structure
    (rows, columns or headers), then rows that went and came, then cells. Null texts are
    empty; texts that differ in white space alone, and pairs of empty ones, give none.
    """
    for c, t in OPTIONAL.items():
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, F.lit(None).cast(t))
    blocks = blocks.withColumn("type", F.coalesce(F.nullif("type", F.lit("")), F.nullif("block_type", F.lit("")), F.lit("text")))
    a, b = _sides(blocks)
    x = aligned.join(a.withColumnRenamed("pos", "a"), ["job", "a"], "left").join(b.withColumnRenamed("pos_b", "b"), ["job", "b"], "left")
    scope, only_a, only_b = F.col("scope").isNotNull(), F.col("a").isNotNull() & F.col("b").isNull(), F.col("b").isNotNull() & F.col("a").isNull()
    page = F.concat(F.lit("[Entire page "), F.col("scope").cast("string"), F.lit(" content -- not present in Version B]"))
    kind, kind_b = F.col("type"), F.col("type_b")
    grid = (kind == "table") | (kind_b == "table")
    single = lambda k, table, note, text: F.when(k == "table", table).when(k == "annotation", note).otherwise(text)
    type_ = (
        F.when(scope, "text_deletion")
        .when(only_a, single(kind, "table_row_deletion", "annotation_removed_from_b", "text_deletion"))
        .when(only_b, single(kind_b, "table_row_addition", "annotation_present_in_b", "text_addition"))
        .when(kind_b == "annotation", "annotation_present_in_b")
        .when(kind == "annotation", "annotation_removed_from_b")
    )
    title = lambda s: F.nullif(F.col("section_title" + s), F.lit(""))
    context = (
        F.when(scope, "text")
        .when(only_a, F.coalesce(title(""), kind))
        .when(only_b, F.coalesce(title("_b"), kind_b))
        .otherwise(F.coalesce(F.concat(F.lit("Section: "), F.coalesce(title(""), title("_b"))), F.concat(F.lit("Block type: "), kind)))
    )
    box = [F.when(scope, 0.0).otherwise(F.col("y")).alias("y_a"), F.when(scope, 1.0).otherwise(F.col("height")).alias("height_a"), F.col("y_b"), F.col("height_b")]
    x = x.select(
        "job", "a", "b", "scope", F.coalesce("scope", "page").alias("page_a"), "page_b", type_.alias("type"), context.alias("context"), *box, grid.alias("grid"), "headers", "headers_b", "rows", "rows_b", "cols", "cols_b", "cells", "cells_b",
        F.when(scope, page).when(only_b, "").otherwise(_text("text")).alias("before"), F.when(scope | only_a, "").otherwise(_text("text_b")).alias("after"),
    )
    x = stored(x)
    place = ["job", "a", "b", "scope", "page_a", "page_b", "context", "y_a", "height_a", "y_b", "height_b"]
    none = lambda n: F.lit(None).cast("int").alias(n)
    whole = x.where("type is not null").select(*place, F.lit(0).alias("rank"), none("row"), none("col"), "type", "before", "after")

    pairs = x.where("type is null")
    tables = pairs.where("grid")
    text_of = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("headers", "headers_b")]
    changed = ~F.col("rows").eqNullSafe(F.col("rows_b")) | ~F.col("cols").eqNullSafe(F.col("cols_b")) | (F.size(header_differences(*lists)) > 0)
    shape = tables.where(changed).select(*place, F.lit(0).alias("rank"), none("row"), none("col"), F.lit("table_structure_change").alias("type"), text_of("headers").alias("before"), text_of("headers_b").alias("after"))
    keys = ["job", "a", "b"]
    mine, theirs = stored(_cells(tables, "")), stored(_cells(tables, "_b"))
    line = F.concat(F.lit("Row "), F.col("row").cast("string"))
    gone = new_rows(mine, theirs, keys, width="cols").select(*keys, F.lit(1).alias("rank"), "row", none("col"), F.lit("table_row_deletion").alias("type"), line.alias("before"), F.lit("").alias("after"))
    come = new_rows(theirs, mine, keys, width="cols").select(*keys, F.lit(2).alias("rank"), "row", none("col"), F.lit("table_row_addition").alias("type"), F.lit("").alias("before"), line.alias("after"))
    cells = cell_differences(mine, theirs, keys).select(*keys, F.lit(3).alias("rank"), "row", "col", F.lit("table_cell_change").alias("type"), "before", "after")
    inside = gone.unionByName(come).unionByName(cells).join(tables.select(*place), keys)
    at_cell = F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(", Col "), F.col("col").cast("string"))
    inside = inside.withColumn("context", F.when(F.col("rank") == 3, at_cell).otherwise(F.col("context"))).select(shape.columns)

    texts = pairs.where(~F.col("grid") & (spaced(F.col("before")) != spaced(F.col("after"))))
    words = word_changes(texts.select(*place, "before", "after"), "before", "after").where(F.size("changes") > 0)
    joined = lambda side: F.array_join(F.filter(F.transform("changes", lambda c: c[side]), lambda v: v != ""), " ")
    kind_of = F.concat(F.lit("text_"), F.when(F.size("changes") > 1, "modification").otherwise(F.col("changes")[0]["type"]))
    folded = words.select(*place, F.lit(0).alias("rank"), none("row"), none("col"), kind_of.alias("type"), joined("before").alias("before"), joined("after").alias("after"))

    all_ = whole.unionByName(shape).unionByName(inside).unionByName(folded)
    order = Window.partitionBy("job").orderBy(F.asc_nulls_last("a"), F.asc_nulls_last("b"), F.asc_nulls_last("scope"), "rank", "row", "col")
    return all_.withColumn("number", F.row_number().over(order)).select("job", "number", "a", "b", "page_a", "page_b", "type", "before", "after", "context", "y_a", "height_a", "y_b", "height_b")


def _merges(diffs: DataFrame, chars: int) -> DataFrame:
    """(job, gone, number, later, page_b, y_b, height_b): additions that a deletion of their job and page takes, by the deletions' order."""
    gone_page, new_page = F.coalesce(F.nullif("page_a", F.lit(0)), "page_b"), F.coalesce(F.nullif("page_b", F.lit(0)), "page_a")
    gone = diffs.where("type = 'text_deletion'").select("job", gone_page.alias("page"), F.col("number").alias("a"), stripped(F.col("before")).alias("x")).where("page <> 0 and x <> ''")
    new = diffs.where("type = 'text_addition'").select("job", new_page.alias("page"), F.col("number").alias("b"), stripped(F.col("after")).alias("y")).where("y <> ''")
    place = place_of(F.col("page"))
    # Only pairs whose lengths allow the similarity are compared; a page's differences are few.
    fits = F.least(F.length("x"), F.length("y"), F.lit(chars)) >= MERGE * F.least(F.greatest(F.length("x"), F.length("y")), F.lit(chars))
    scored = gone.join(new, ["job", "page"]).where(fits).select(place.alias("place"), "a", "b", pair_similarity(F.left("x", F.lit(chars)), F.left("y", F.lit(chars))).alias("score"))
    taken = greedy(scored, "place", MERGE).drop("score")
    added = diffs.select("job", place_of(new_page).alias("place"), F.col("number").alias("b"), stripped(F.col("after")).alias("later"), F.col("page_b").alias("new_page_b"), F.col("y_b").alias("new_y_b"), F.col("height_b").alias("new_height_b"))
    return taken.join(added, ["place", "b"]).drop("place")


def place_of(page: Column) -> Column:
    return F.to_json(F.struct(F.col("job"), page.alias("page")))


def merged_changes(diffs: DataFrame, chars: int = 200) -> DataFrame:
    """Deletions and additions of one job and page that are somewhat alike become modifications, in the deletion's row.

    diffs: (job, number, page_a, page_b, type, before, after, y_b, height_b, ...). The page is
    a deletion's page of a and an addition's page of b, or else the other one; page 0 counts
    as none. The merged row has the addition's page and place in b, and `merged` is true.
    Comparing the first `chars` characters is the rule's own definition.
    """
    # Read twice: the similarities are computed once.
    change = stored(_merges(diffs, chars))
    rest = diffs.join(change.select("job", F.col("b").alias("number")), ["job", "number"], "left_anti")
    out = rest.join(change.drop("b").withColumnRenamed("a", "number"), ["job", "number"], "left")
    new = F.col("later").isNotNull()
    cols = {"type": F.when(new, "text_modification").otherwise(F.col("type")), "before": F.when(new, stripped(F.col("before"))).otherwise(F.col("before")), "after": F.coalesce("later", "after")}
    cols |= {c: F.when(new, F.col("new_" + c)).otherwise(F.col(c)) for c in ("page_b", "y_b", "height_b")}
    return out.select(*[cols.get(c, F.col(c)).alias(c) for c in diffs.columns], new.alias("merged"))
