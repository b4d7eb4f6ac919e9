"""Token files against the tokenizers library, and what a reader skips."""

import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import token_files as tf

from .conftest import sample_texts


@pytest.fixture(scope="module")
def vocabulary():
    with open(tf.default_vocabulary(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["a\nb\nc d\n", "a\n\nb c", "\n\n", "\na", "é\n<|endoftext|>\nx y", "a\tb c\td", "a \nb", "a \n", "", " ", "  ", " a", "a ", "a  ", "  a", "a\n b", "a \n\n b", "a\t  b", "a\x1c b", "a　 b", "it's  '  'll", "\n", "x  <|endoftext|>  y", "1 22  3\r\n 4", "a​ b﻿ c᠎ d", "e\x85 f\xa0 g"]


@pytest.mark.parametrize("part, table", [(1 << 20, 400_000), (7, 5)])
def test_chunks_encode_as_whole_texts(vocabulary, library, monkeypatch, part, table):
    monkeypatch.setattr(tf, "PART", part)
    encoder = tf.Encoder(vocabulary, table)
    texts = ODD + [t or "" for t in sample_texts()] + ["é" * 3000 + " b", "word " * 500, "z" * 100 + " z " + "z" * 100]
    for batch in (texts, texts[::-1], texts[:3]):
        ids, offsets = encoder.encode(pa.array(batch, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library(t) for t in batch]


def test_files(spark, clashing, vocabulary, library, tmp_path):
    path = str(tmp_path / "orc")
    tf.write_tokens(clashing, path, vocabulary, files=4)
    got = tf.read_tokens(spark, path).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(got) == clashing.count()
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    want = sorted((r.doc_id or -1, library(r.text)) for r in clashing.collect())
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == want
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in tf.checksums(tf.read_tokens(spark, path)).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) for r in got}
    assert [list(r.ids) for r in tf.lookup(spark, path, [4]).collect()] == [library("Released under the MIT License.")]


def test_empty(spark, clashing, vocabulary, tmp_path):
    path = str(tmp_path / "orc")
    tf.write_tokens(clashing.where("1 = 0"), path, vocabulary)
    assert tf.checksums(tf.read_tokens(spark, path)).count() == 0


def test_readers_prune_and_share_a_file(spark, vocabulary, tmp_path):
    """One file of many stripes: tasks share it, and an id's condition is pushed to the reader, which reads few rows."""
    from pyarrow import orc

    path = str(tmp_path / "orc")
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2((F.col("id") + i).cast("string"), 256) for i in range(4)]).alias("text"))
    tf.write_tokens(docs, path, vocabulary, stripe=1 << 20, rows=1_000, files=1, table_size=1_000)
    file = next((tmp_path / "orc").glob("*.orc"))
    meta = orc.ORCFile(str(file))
    assert meta.nrows == 20_000 and meta.nstripes >= 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        whole = tf.read_tokens(spark, path)
        assert spark.read.orc(path).rdd.getNumPartitions() > 1
        assert whole.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()[0] == whole.agg(F.sum("n_tokens")).first()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # Even ids only: an odd one lies within the files' range, and only the Bloom filters tell that it's absent.
    for wanted, rows, most in ((20_000, 1, 1_000), (20_001, 0, 0), (90_000, 0, 0)):
        found = tf.lookup(spark, path, [wanted])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(doc_id" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in plan
        assert len(found.collect()) == rows
        assert scanned(found) <= most


def scanned(df) -> int:
    """Rows that the scan of df's plan gave."""
    df = df.select("*")
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("Scan"):
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")
