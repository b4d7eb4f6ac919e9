import pytest

SCHEMA = "doc_id long, text string, lang string, row_key string, new_text string, hits string, removed string, hilbert string, piece_ids string"
WORDS = [f"w{i * 7919 % 1000}" for i in range(400)]


def sample_texts():
    long = " ".join(WORDS)
    return [None, "", " ", "a", "Released under the MIT License.", long, long, " ".join(WORDS[:-3] + ["x", "y", "z"]), "é b　c ▁ <s>\x00 \n\n  q\n r\x1c s ", "x" * 5000, " ".join(WORDS[100:160]) + " tail of its own", "  a  b ", "Ünï " * 30, "a <|endoftext|> b<|endoftext|>"]


@pytest.fixture(scope="session")
def clashing(spark, tmp_path_factory):
    """Texts with nulls, repeats, and columns that are named like the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, "0", "n", "h", "r", "i", "p") for i, t in enumerate(sample_texts())]
    rows += [rows[5], (None, "no id", None, "0", None, None, None, None, None), (3, "another text of an id", "fr", "0", None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("t") / "docs")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)
