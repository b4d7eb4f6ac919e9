"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of 10 consecutive words (a shorter item is one window).
A window is contained in a document exactly if all its words stand there in order, so
of the words ordered by rarity over all documents the prefix that must match has one
word: the window's rarest. Document positions with such a word are joined with the
windows on it; length and positional bounds (the window must fit around its anchor)
come next, then the exact comparison of the whole window.

Benchmark items are taken in blocks of at most `block` windows, so what is broadcast is
bounded whatever the benchmark's size; every block is one pass over the documents.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .common import ROW, with_rows, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of a block; with 10 short words each a block is a few MB.
BLOCK = 50_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same where no other letter than lower-case ones is beyond ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F\p{Ll}]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Words between separators; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(items: DataFrame, size: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(win array<string>, item string), distinct: the windows of every item."""
    w = items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    each = w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), size).alias("win"))
    return each.distinct()


def _within(w: Column, vocabulary: list[str]) -> Column:
    """The positions (from 1) of words that are in a bounded vocabulary; more than ten literals are looked up in a hash set."""
    marked = F.transform(w, lambda x, i: F.when(x.isin(vocabulary), i + 1))
    return F.filter(marked, lambda x: x.isNotNull())


def contained(docs: DataFrame, items: DataFrame, size: int = 10, block: int = BLOCK, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc, n_words, hits array<struct<start,n>> (1-based word runs) and items array<string>.

    Rows are told by their row keys (a user's column of that name doesn't matter), so
    repeated rows and ids keep their own result. Null or empty text and an empty benchmark
    give no hits; texts of any length are read whole. Items without words are no windows;
    an item with null id counts for hits but is not listed. Other columns don't matter; an
    empty table gives no rows.
    """
    rows = with_rows(docs)
    rows = rows.select(F.col(ROW).alias("row"), *([doc] if doc != ROW else [F.col(ROW)]), F.col(text).alias("text"))
    owned = written(windows(items, size), "windows")
    wins = written(owned.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "ids")
    owners = owned.where("item is not null").join(wins, "win").select("wid", "item")
    total = wins.count()
    n_blocks = max(1, -(-total // block))
    out = None
    for b in range(n_blocks):
        mine = wins if n_blocks == 1 else wins.where(F.pmod(F.xxhash64("win"), F.lit(n_blocks)) == b)
        one = _pass(rows, mine, doc)
        out = one if out is None else out.unionByName(one)
    if n_blocks > 1:
        out = out.groupBy("row", doc).agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    out = written(out, "found")
    # A document's windows, then their items; both are few.
    listed = out.select("row", F.explode("found.wid").alias("wid")).distinct().join(owners, "wid").groupBy("row").agg(F.collect_set("item").alias("items"))
    hits = F.array_distinct(F.transform("found", lambda f: F.struct(f["start"].alias("start"), f["n"].alias("n"))))
    return out.join(listed, "row", "left").select(doc, "n_words", hits.alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _pass(rows: DataFrame, wins: DataFrame, doc: str) -> DataFrame:
    """(row, doc, n_words, found array<struct<start,n,wid>>) for one block of windows."""
    rows = rows.select("row", doc, words(F.col("text")).alias("w"))
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    # How often the block's words stand in all documents: the rarity order. The words of a block are a few MB.
    seen = rows.select(F.explode("w").alias("word")).join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").count()
    counts = vocabulary.join(seen, "word", "left").fillna(0, ["count"])
    each = wins.select("wid", "win", F.posexplode("win").alias("p", "word")).join(counts, "word")
    rarest = F.row_number().over(Window.partitionBy("wid").orderBy("count", "word", "p"))
    prefix = each.withColumn("r", rarest).where("r = 1").select("word", F.col("p").alias("before"), "wid", "win", F.size("win").alias("n"))
    prefix = written(prefix, "prefixes")
    # At most one word a window: the block bounds them.
    anchors = [r[0] for r in prefix.select("word").distinct().toLocalIterator()]
    longest = wins.agg(F.coalesce(F.max(F.size("win")), F.lit(1))).first()[0]

    # A position travels with the words around it, never with its whole text.
    near = lambda i: F.slice("w", F.greatest(i - longest + 1, F.lit(1)), F.lit(2 * longest - 1))
    places = F.transform(_within(F.col("w"), anchors), lambda i: F.struct(i.alias("at"), near(i).alias("near")))
    at = rows.select("row", doc, F.size("w").cast("long").alias("n_words"), F.explode_outer(places).alias("place"))
    at = at.select("row", doc, "n_words", F.col("place.at").alias("at"), F.col("place.near").alias("near"))
    # The anchor's own place among the words around it.
    own = F.least(F.col("at"), F.lit(longest))
    joined = at.withColumn("word", F.get("near", own - 1)).join(F.broadcast(prefix), "word", "left")
    start = F.col("at") - F.col("before")
    fits = F.coalesce((start >= 1) & (start + F.col("n") - 1 <= F.col("n_words")), F.lit(False))
    equal = fits & (F.slice("near", F.when(fits, own - F.col("before")).otherwise(1), F.coalesce("n", F.lit(0))) == F.col("win"))
    hit = joined.select("row", doc, "n_words", F.when(equal, F.struct(start.alias("start"), "n", "wid")).alias("hit"))
    return hit.groupBy("row", doc, "n_words").agg(F.collect_set("hit").alias("found"))


def covered(hits: Column) -> Column:
    """How many words are in any hit."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))).cast("long")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report(contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, len(win) AS n, array_to_string(win, ' ') AS win
       FROM (SELECT item, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: w[i:i + 9])) AS win FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
h AS (SELECT k, s, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM h) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (k) LEFT JOIN its USING (k)
"""
