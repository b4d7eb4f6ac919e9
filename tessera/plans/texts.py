"""Text comparison, normalisation and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as T
from ..operators.matching import components, greedy, near_texts, scored, word_changes
from ..operators.relational import stored
from ..sources.tables import table
from .registry import query


def _turns(spark, d):
    """Consecutive turns of a conversation as before and after."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null").select("conv_id", "turn", "before", F.col("text").alias("after"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS duplicated FROM documents")
def duplicate_flag(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    several = docs.groupBy("h").agg((F.count("*") > 1).alias("duplicated")).withColumnRenamed("h", "g")
    return docs.join(several, F.col("h").eqNullSafe(F.col("g"))).select("doc_id", "duplicated")


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query()
def text_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("normal_md5"))


@query()
def ocr_garbage(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_garbage(F.col("text")).alias("garbage"))


@query(r"SELECT doc_id, count(*) FILTER (WHERE regexp_matches(trim(line), '(?i)^\s*(?:page\s+)?\d+\s*(?:of\s+\d+)?\s*$')) AS page_numbers FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def page_number_lines(spark, d):
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(lines, T.is_page_number)).cast("long").alias("page_numbers"))


@query("""SELECT md5(line) AS line_md5, source, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY line, source HAVING count(DISTINCT doc_id) >= 2""")
def repeat_line_collapse(spark, d):
    lines = table(spark, d, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    # Distinct by hash first: each document's line once, and only 16 bytes a line cross the shuffle.
    each = lines.select("doc_id", "source", F.md5("line").alias("line_md5")).distinct()
    return each.groupBy("line_md5", "source").agg(F.count("*").alias("docs")).where("docs >= 2")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN CAST(n AS VARCHAR) || '.25' WHEN 3 THEN CAST(n AS VARCHAR) || 'd' WHEN 4 THEN '-' || CAST(n AS VARCHAR) ELSE 'n/a ' || o_orderpriority END AS value FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)""")
def cell_normalise(spark, d):
    """Order totals as cells may hold them: with separators, trailing zeros, suffixes and white space."""
    n, k = F.floor("o_totalprice"), F.col("o_orderkey") % 6
    plain = n.cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" \t"), F.format_number(n, 0), F.lit("\n"))).when(k == 1, F.concat(plain, F.lit(".00"))).when(k == 2, F.concat(plain, F.lit(".250"))).when(k == 3, F.concat(plain, F.lit("d"))).when(k == 4, F.concat(F.lit("-"), plain, F.lit(".0"))).otherwise(F.concat(F.lit("\u00a0n/a "), "o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", T.cell_value(raw).alias("value"))


@query(r"""WITH c AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b FROM conversations)
SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(a, '\b\d[\d,._]*\b'))) <> list_sort(list_distinct(regexp_extract_all(b, '\b\d[\d,._]*\b'))) AS changed FROM c WHERE a IS NOT NULL""")
def number_set_change(spark, d):
    return _turns(spark, d).select("conv_id", "turn", (T.number_set(F.col("before")) != T.number_set(F.col("after"))).alias("changed"))


@query(r"""WITH c AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b FROM conversations),
s AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_split_to_array(lower(a), '\s+')), lambda w: w <> '') AS x, list_filter(list_distinct(regexp_split_to_array(lower(b), '\s+')), lambda w: w <> '') AS y FROM c WHERE a IS NOT NULL)
SELECT conv_id, turn, CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) END AS jaccard FROM s""")
def jaccard_turns(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.round(T.jaccard(F.col("before"), F.col("after")), 6).alias("jaccard"))


@query()
def rule_significance(spark, d):
    t = _turns(spark, d).withColumn("r", scoring.modification(F.col("before"), F.col("after")))
    needs, auto = scoring.flags(F.col("r.significance"), F.col("r.confidence"))
    return t.select("conv_id", "turn", "r.significance", "r.confidence", needs.alias("needs_verification"), auto.alias("auto_confirmed"))


def _near(spark, d, **only):
    """Near pairs of different whole texts of one source, one document for equal ones."""
    return near_texts(table(spark, d, "documents").where("length(text) > 0").select("doc_id", "source", "text"), "source", **only)


@query("SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source, text) AS representative FROM documents WHERE text <> ''")
def text_classes(spark, d):
    """The document that stands for each document in the queries on near pairs."""
    docs = table(spark, d, "documents").where("length(text) > 0").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = docs.groupBy(F.col("source").alias("s"), F.col("h").alias("g")).agg(F.min("doc_id").alias("representative"))
    return docs.join(first, (F.col("h") == F.col("g")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "representative")


@query()
def similarity_pairs(spark, d):
    """Pairs of different texts of one source that share three quarters of their shingles and are 0.8 alike by edit distance."""
    return scored(_near(spark, d)).where("score >= 0.8").select("a", "b", F.round("score", 6).alias("score"))


@query()
def near_dup_greedy(spark, d):
    """Near pairs matched one to one, the lower half of a source's range of ids to the upper; every component of candidates by itself."""
    middle = table(spark, d, "documents").groupBy("source").agg(((F.min("doc_id") + F.max("doc_id")) / 2).alias("middle"))
    # The sides are told before texts are fetched and compared.
    across = _near(spark, d, only=lambda pairs: pairs.join(middle, "source").where("a <= middle and b > middle"))
    pairs = stored(scored(across).select("source", "a", "b", "score"))
    placed = pairs.join(components(pairs).withColumnRenamed("id", "a"), "a")
    return greedy(placed, "component", 0.4).drop("score").join(pairs, ["a", "b"]).select("source", "a", "b", "score")


@query()
def word_diff(spark, d):
    pairs = scored(_near(spark, d)).where("score >= 0.8").select("a", "b", "x", "y")
    return word_changes(pairs, "x", "y").select("a", "b", F.size("changes").alias("n_changes"), F.to_json("changes").alias("changes"))
