"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has a whitespace marker behind another character, so no merge
crosses the start of a run of markers: a text may be cut before each run, each chunk
segmented alone, and the ids joined back by position. A task keeps a table of the
distinct chunks that it has met, so each is segmented once; the table is emptied when
it reaches `table_size` entries, which bounds memory whatever the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import slices

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str) -> bytes:
    """The model's bytes, read on the driver (about 0.5 MB) and sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


class ChunkTable:
    """Distinct chunks with their ids (in one pool, by start and length) and decoded text."""

    def __init__(self, model: bytes, table_size: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for i in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {i} crosses a whitespace marker; chunks can't be segmented alone")
        self.limit, self.runs = table_size, re.compile(f"{MARK}+[^{MARK}]*")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.pool, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        """The chunks without the first marker of each."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return [x[1:] for x in self.runs.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def add(self, docs: list[list[str]]) -> None:
        if len(self.index) > self.limit:
            self.clear()
        new = list(set().union(*docs).difference(self.index))
        if not new:
            return
        ids = self.sp.encode([x.replace(MARK, " ") for x in new], num_threads=1)
        # A lone marker is the empty string here, which the library wouldn't encode.
        ids = [x if chunk else [self.sp.piece_to_id(MARK)] for chunk, x in zip(new, ids, strict=True)]
        self.text += self.sp.decode(ids, num_threads=1)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in ids for i in x), np.int32, int(length.sum()))])

    def encode(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids, each document's offset among them, and the decoded texts."""
        self.add(docs)
        of, text = self.index.__getitem__, self.text
        where = [list(map(of, d)) for d in docs]
        decoded = [" ".join([text[i] for i in w]) for w in where]
        flat = np.fromiter((i for w in where for i in w), np.int64, sum(map(len, where)))
        n = self.length[flat]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.start[flat] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        counts = np.cumsum([0, *map(len, where)])
        return ids, np.concatenate([[0], ends])[counts], decoded


def encode_decode(docs: DataFrame, model: bytes, table_size: int = 200_000, text: str = "text") -> DataFrame:
    """Add `piece_ids` (array<int>) and `piece_text` (the decoded ids) to every row.

    Null text counts as empty and gives no ids and an empty decoded text. Repeated rows
    are encoded alike; an empty table stays empty. Columns of docs named piece_ids or
    piece_text are replaced.
    """
    keep = docs.drop("piece_ids", "piece_text")
    schema = StructType(
        [*keep.schema.fields, StructField("piece_ids", ArrayType(IntegerType(), False)), StructField("piece_text", StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model, table_size)
        for batch in batches:
            for part in slices(batch, text):
                split = [table.chunks(x or "") for x in part.column(text).to_pylist()]
                ids, offsets, decoded = table.encode(split)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.string())], names=[*part.schema.names, "piece_ids", "piece_text"])

    return keep.mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode_decode(docs, read_model(default_model())))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("piece_ids", ","), 256).alias("ids_sha256"),
        F.sha2("piece_text", 256).alias("decoded_sha256"),
    )
