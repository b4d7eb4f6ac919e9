"""Token ids of documents in ORC files, in ascending order of document ids.

A file has one row per document: its id, its ids (array<int>, run-length encoded by ORC),
how many they are, the file's number and how many ids stand before them in the file.
Row indexes (least and greatest id of every few thousand rows) and Bloom filters on the
document id let a reader skip files, stripes and row groups; the files' ranges of ids
don't overlap, as rows are dealt by range. Readers take stripes in parallel: a place
among all ids is the file's offset plus the stored one, so no task reads another's rows.

Encoding cuts a text before every space that follows a non-space: the vocabulary's
pattern has a space at the start of a token only, so none crosses such a cut. A task
keeps a table of the distinct chunks that it has met and has each encoded once.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .common import ROW, shared_dir, slices, with_rows

#: Columns of the files.
FILE = "doc_id long, n_tokens long, file int, place long, ids array<int>"
#: Id behind every document.
END = 2
#: Chunks of more characters aren't kept in the table; a longer text is read in parts of about PART characters.
LONGEST, PART = 64, 1 << 20
#: Bytes of texts that are split at once, and chunks that are encoded at once.
SLICE, TOGETHER = 8 << 20, 20_000

# White space, and characters that some tables count as such: no cut is made behind them.
_SPACE = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_CUT = re.compile(f"(?<=[^{_SPACE}])(?= )")
_HAS_SPACE = re.compile(f"[{_SPACE}]")
#: Texts that can't be split at every space and line end: white space in the beginning or behind white space.
_UNEVEN = "(^|[S])[S]".replace("S", re.sub(r"\\u(....)", r"\\x{\1}", _SPACE))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces pool[start : start + length] behind each other, and where each begins (and the last ends)."""
    ends = np.concatenate([[0], np.cumsum(length)])
    return pool[np.repeat(start - ends[:-1], length) + np.arange(int(ends[-1]))], ends


class Encoder:
    """The tokenizers library behind a table of distinct chunks.

    At `table_size` chunks it forgets those that the fewest batches had, half of it at least.

    A key of the table is a string that stands for itself behind a space, a string that
    begins with a line end and has no space before it, or a tuple of any other chunk.
    """

    def __init__(self, vocabulary: str, table_size: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_str(vocabulary)
        if t.pre_tokenizer.__class__.__name__ != "ByteLevel" or t.pre_tokenizer.add_prefix_space or t.normalizer is not None:
            raise ValueError("texts may be cut at spaces only for a byte-level vocabulary that adds no space and has no normalizer")
        self.begins = np.zeros(t.get_vocab_size() + 1, bool)
        self.begins[[i for token, i in t.get_vocab().items() if token[0] in "ĠĊ"]] = True
        self.limit, self.long = table_size, []
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.pool, self.start, self.length, self.seen = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def shrink(self) -> None:
        least = np.partition(self.seen, len(self.seen) // 2)[len(self.seen) // 2] if len(self.seen) else 0
        keep = self.seen > least
        place = np.cumsum(keep) - 1
        self.index = {k: int(place[i]) for k, i in self.index.items() if keep[i]}
        self.pool, _ = _gathered(self.pool, self.start[keep], self.length[keep])
        self.length, self.seen = self.length[keep], self.seen[keep]
        self.start = np.cumsum(self.length) - self.length

    @staticmethod
    def chunks(text: str) -> list:
        """Keys of the chunks of an uneven or long text, by parts of about PART characters."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + PART) if len(text) - at > PART else None
            end = cut.start() if cut else len(text)
            out += [x[1:] if x[0] == " " and not x[1:2].isspace() else (x,) for x in _CUT.split(text[at:end])]
            at = end
        return out

    def _add(self, new: list) -> None:
        plain = [k for k in new if k.__class__ is str and k and not _HAS_SPACE.search(k, k[0] == "\n") and k != "\n"]
        other = list(set(new).difference(plain)) if len(plain) < len(new) else []
        pools, lengths = [self.pool], [self.length]
        for i in range(0, len(plain), TOGETHER):
            # Only the first token of a chunk has a space or line end, which tells where a chunk begins.
            some = plain[i : i + TOGETHER]
            text = " " + " ".join(some).replace(" \n", "\n") if some[0][0] != "\n" else " ".join(some).replace(" \n", "\n")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(some):
                raise ValueError("the vocabulary joins chunks")
            pools.append(ids)
            lengths.append(np.diff(np.append(at, len(ids))))
        own = [k[0] if k.__class__ is tuple else k if k[:1] == "\n" else " " + k for k in other]
        for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False):
            pools.append(np.array(e.ids, np.int32))
            lengths.append(np.array([len(e.ids)], np.int64))
        self.index.update(zip(plain + other, range(len(self.start), len(self.start) + len(new)), strict=True))
        self.pool, self.length = np.concatenate(pools), np.concatenate(lengths)
        self.start = np.cumsum(self.length) - self.length
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int32)])
        self.long += [k for k in new if (len(k) if k.__class__ is str else len(k[0])) > LONGEST]

    def rows(self, keys: list) -> np.ndarray:
        """Table rows of distinct keys, which are put in where they are missing."""
        found = list(map(self.index.get, keys))
        new = [k for k, i in zip(keys, found, strict=True) if i is None]
        if new:
            if len(self.start) + len(new) > self.limit and len(self.start):
                self.shrink()
                new = [k for k in keys if k not in self.index]
            self._add(new)
            found = map(self.index.__getitem__, keys)
        out = np.fromiter(found, np.int64, len(keys))
        self.seen[out] += 1
        return out

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of the chunks of texts that may be split at every space and before every line end, and each text's offset among them."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        words, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # A text's first chunk has no space before it.
        begin = [(x,) for x in words.take(pa.array(offsets[:-1])).to_pylist()]
        first = {k: i for i, k in enumerate(dict.fromkeys(begin), len(distinct))}
        of = self.rows([*distinct, *first])
        code = coded.indices.to_numpy().astype(np.int64)
        code[offsets[:-1]] = [first[k] for k in begin]
        return of[code], offsets

    def _uneven(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        docs = [self.chunks(t) for t in texts]
        at = {k: i for i, k in enumerate(set().union(*docs))}
        code = np.fromiter((i for d in docs for i in map(at.__getitem__, d)), np.int64, sum(map(len, docs)))
        return self.rows(list(at))[code], np.cumsum([0, *map(len, docs)])

    def _group(self, group) -> tuple[np.ndarray, np.ndarray]:
        where, offsets = self._even(group) if isinstance(group, pa.Array) else self._uneven(group)
        ids, ends = _gathered(self.pool, self.start[where], self.length[where])
        for k in self.long:
            del self.index[k]
        self.long = []
        return ids, ends[offsets]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with END behind each text, and each text's offset among them; null counts as empty."""
        texts = pc.fill_null(texts, "")
        slow = pc.or_(pc.match_substring_regex(texts, _UNEVEN), pc.or_(pc.greater(pc.utf8_length(texts), PART), pc.equal(texts, "")))
        slow = np.asarray(slow.to_numpy(zero_copy_only=False), bool)
        ids, ends = self._group(texts.filter(pa.array(~slow)))
        if slow.any():
            more, at = self._group(texts.filter(pa.array(slow)).to_pylist())
            starts, lengths = np.zeros(len(slow), np.int64), np.zeros(len(slow), np.int64)
            starts[~slow], lengths[~slow] = ends[:-1], np.diff(ends)
            starts[slow], lengths[slow] = at[:-1] + len(ids), np.diff(at)
            ids, ends = _gathered(np.concatenate([ids, more]), starts, lengths)
        return np.insert(ids, ends[1:], END).astype(np.int32), ends + np.arange(len(ends))


@functools.lru_cache(1)
def _encoder(vocabulary: str, table_size: int) -> Encoder:
    """One for each worker process: later tasks find the chunks of earlier ones."""
    return Encoder(vocabulary, table_size)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, doc: str = "doc_id", text: str = "text", stripe: int = 64 << 20, rows: int = 2_000, files: int | None = None, table_size: int = 600_000) -> None:
    """Write the ids of all rows of docs to ORC files under `path` with stripes of `stripe` bytes and an index entry every `rows` rows.

    Rows stand in ascending order of doc_id (null first); rows that repeat an id stand in
    order of their row keys, so an id with very many rows is split over files. Null and
    empty texts have the end id alone. Texts of any length are read whole, in parts. An
    empty table gives an empty folder of files. Other columns of docs don't matter.
    """
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows_ = with_rows(docs).select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), ROW)
    # Texts are dealt, not ids: they are smaller, and nothing is written before.
    order = [F.asc_nulls_first("doc_id"), F.col(ROW)]
    ranged = rows_.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(vocabulary, table_size), 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, offsets = encoder.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                at = pa.array(before + offsets[:-1], pa.int64())
                before += len(ids)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), part.column("file"), at, lists], names=["doc_id", "n_tokens", "file", "place", "ids"])

    encoded = ranged.select("doc_id", "text", F.spark_partition_id().alias("file")).mapInArrow(run, FILE)
    # Long documents: the writer looks at its buffers after every hundred rows.
    options = {"orc.rows.between.memory.checks": "100", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(rows), "orc.stripe.size": str(stripe), "orc.create.index": "true"}
    encoded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all rows: `start` counts the ids of all documents before."""
    table = spark.read.schema(FILE).orc(path)
    # One row for each file: at most as many as tasks that wrote.
    sizes = table.groupBy("file").agg(F.max(F.col("place") + F.col("n_tokens")).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("file", before.alias("before"))
    return table.join(F.broadcast(starts), "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents: the condition goes to the ORC reader, which skips by index and Bloom filter."""
    return spark.read.orc(path).where(F.col("doc_id").isin([int(i) for i in ids])).select("doc_id", "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_tokens(): crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in the shared folder, as the result is read from them."""
    with open(default_vocabulary(), encoding="utf-8") as f:
        vocabulary = f.read()
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary)
    return checksums(read_tokens(spark, path))
