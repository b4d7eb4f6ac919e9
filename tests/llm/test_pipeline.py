"""The pipeline against plain models of its stages; clashing columns and empty tables for every operator and stage."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontaminate, hilbert_shards, minhash, quality, sentencepiece_table, suffix_dedup

CLASHING = "doc_id long, text string, n_chars long, lang string, source string, row_key string, new_text string, hilbert string, piece_ids string, _file string, comp string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_pipeline(rows, items):
    """Rows (doc_id, text) that the stages keep, by plain loops; no labels, so that the classifier keeps all."""
    least, sets = list(range(len(rows))), [shingles(t) for _, t in rows]
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    kept = [r for i, r in enumerate(rows) if not sets[i] or least[i] == i]
    data = [(t or "").encode() for _, t in kept]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    left = []
    for (doc, text), d in zip(kept, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        new = bytes(np.frombuffer(d, np.uint8)[~gone]).decode("utf-8", "ignore")
        if not gone.any() or new:
            left.append((doc, new if gone.any() else text))
    windows = {tuple(w[i : i + 10]) for w in (t.lower().split() for t in items) for i in range(max(1, len(w) - 9))}

    def dirty(text):
        w = (text or "").lower().split()
        return any(tuple(w[i : i + len(x)]) == x for x in windows for i in range(len(w) - len(x) + 1))

    return [r for r in left if not dirty(r[1])]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    word = lambda: bytes(rng.integers(97, 123, 7, dtype=np.uint8)).decode()
    base = [" ".join(word() for _ in range(90)) for _ in range(8)]
    passage = " ".join(word() for _ in range(60))
    texts = [*base, base[0], base[0] + " " + word(), base[1].upper(), f"{word()} {passage} {base[2][:150]}", f"{base[3][:180]} {passage}", "", None, "ab", passage * 2]
    rows = [(i, t) for i, t in enumerate(texts)]
    items = [" ".join(base[4].split()[11:26]), "ab"]
    where = str(tmp_path_factory.mktemp("p"))
    full = [(i, t, len(t or ""), "en", "s", "0", "n", "h", "p", "f", "c") for i, t in rows]
    spark.createDataFrame(full, CLASHING).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, items


def test_whole_pipeline(spark, small):
    where, rows, items = small
    want = plain_pipeline(rows, items)
    assert 5 < len(want) < len(rows) - 4 and any(t != dict(rows)[i] for i, t in want)
    model = sentencepiece_table.read_model(sentencepiece_table.default_model())
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = {i: sp.encode(t or "") for i, t in want}
    got = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in got} == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids.items()}
    assert len(got) == len(want)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_clashing_columns(spark, small, name, stage):
    where, rows, _ = small
    docs = spark.read.parquet(f"{where}/documents.parquet")
    out = stage(spark, docs, where)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = out.collect()
    assert kept and {(r.row_key, r.new_text, r.hilbert, r._file, r.comp) for r in kept} == {("0", "n", "h", "f", "c")}
    assert all(r.n_chars == len(r.text or "") for r in kept)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, small, name, stage):
    where, _, _ = small
    assert stage(spark, spark.read.parquet(f"{where}/documents.parquet").where("doc_id < 0"), where).count() == 0


def test_row_keys(spark, small):
    where, rows, _ = small
    docs = spark.read.parquet(f"{where}/documents.parquet")
    keyed = common.with_rows(docs)
    assert keyed.select(common.ROW).distinct().count() == len(rows) and common.with_rows(keyed) is keyed
    again = common.with_rows(keyed.select(common.ROW, "text").where("text <> ''"))
    assert again.columns == [common.ROW, "text"]
    assert common.without_rows(keyed).columns == docs.columns
    assert sorted(common.without_rows(keyed).collect(), key=str) == sorted(docs.collect(), key=str)


def test_row_keys_of_very_many_files(spark, small, monkeypatch):
    where, rows, _ = small
    monkeypatch.setattr(common, "PATH_BYTES", 10)
    keyed = common.with_rows(spark.read.parquet(f"{where}/documents.parquet"))
    assert keyed.select(common.ROW).distinct().count() == len(rows)
    assert {r[0] for r in common.without_rows(keyed).select("row_key").distinct().collect()} == {"0"}


def test_operators_with_clashing_columns(spark, clashing):
    """A user's row_key of one value tells no rows: results are those without the column."""
    plain = clashing.select("doc_id", "text", "lang")
    items = spark.createDataFrame([(1, "w1 w2"), (2, "a")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, quality int")
    for run in (
        lambda d: minhash.near_duplicates(d).drop(common.ROW, "group"),
        lambda d: suffix_dedup.digests(suffix_dedup.remove_repeats(d)),
        lambda d: decontaminate.report(decontaminate.contained(d, items)),
        lambda d: quality.classify(d, labels, F.col("doc_id") < 9).select("doc_id", F.lit(1)),
        lambda d: sentencepiece_table.digests(sentencepiece_table.encode_decode(d, sentencepiece_table.read_model(sentencepiece_table.default_model()))),
    ):
        assert Counter(run(clashing).collect()) == Counter(run(plain).collect())
    two = clashing.select("doc_id", "text", "row_key")
    assert hilbert_shards.shards(two.drop("text"), ["doc_id"], ["doc_id"]).columns == ["doc_id", "row_key", "hilbert", "shard", "slot"]
    with pytest.raises(ValueError, match="hilbert"):
        hilbert_shards.shards(clashing, ["doc_id"], ["doc_id"])
