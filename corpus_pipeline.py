"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Rows are
told by a row key, as a doc_id may be null, repeated or have several texts.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import ROW, dropped, free_name, with_rows, without_rows, written
from tessera.llm.decontaminate import contained
from tessera.llm.minhash import near_duplicates
from tessera.llm.quality import classify, held_out
from tessera.llm.sentencepiece_table import default_model, digests, encode_decode, read_model
from tessera.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good: null and empty texts have a score too, repeated rows and ids each their own.

    Columns besides doc_id and text stay as they are, whatever their names; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = with_rows(docs)
    good = classify(docs, labels, ~held_out()).where("predicted = 1").select(ROW)
    return without_rows(docs.join(good, ROW, "left_semi"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate group: of the smallest id (null comes last) the smallest row key.

    Rows without words (null and empty texts too) are in no group and stay. Columns besides
    doc_id and text stay, whatever their names; an empty table stays empty.
    """
    docs = with_rows(docs)
    near = written(near_duplicates(docs).select(ROW, "group", "doc_id"), "near")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias(ROW)
    kept = near.where("group is not null").groupBy("group").agg(best).select(ROW).union(near.where("group is null").select(ROW))
    return without_rows(docs.join(kept, ROW, "left_semi"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 bytes or more that stand elsewhere too; characters cut in two go whole.

    A document that nothing is left of goes. Rows that the operator doesn't change keep
    their text, null and empty too. n_chars, if there is one, follows the text; other
    columns stay, whatever their names. An empty table stays empty.
    """
    docs = with_rows(docs)
    cut = remove_repeats(docs).where("size(removed) > 0")
    new = free_name(docs, "new_text")

    @F.pandas_udf("string")
    def text_of(kept):
        return kept.map(lambda b: b.decode("utf-8", "ignore"))

    changed = cut.select(ROW, text_of("kept_bytes").alias(new))
    both = without_rows(docs.join(changed, ROW, "left").where(F.col(new).isNull() | (F.col(new) != "")))
    text = F.coalesce(new, "text")
    values = {"text": text, "n_chars": F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long")}
    return both.select([values[c].alias(c) if c in values else F.col(f"`{c}`") for c in both.columns if c != new])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts have none and stay.

    Repeated rows are judged alike. Columns stay, whatever their names; an empty table stays empty.
    """
    docs = with_rows(docs)
    found = contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc=ROW)
    return without_rows(docs.join(found.where("size(hits) > 0").select(ROW), ROW, "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the SentencePiece model (count and digest) and the digest of the decoded text, one row for each document.

    Null text counts as empty: no ids, and the empty text's digests. Repeated rows are encoded
    alike, texts of any length whole; other columns don't matter; an empty table gives no rows.
    """
    return digests(encode_decode(docs.select("doc_id", "text"), read_model(default_model())))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("sentencepiece encoding", encode),
]

#: The classifier and the suffix index can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)
    return docs
