"""Removal of long repeated byte strings with a run-length index.

A string of `length` bytes that starts at two places has the same minimiser at both: the
k-gram with the smallest hash among those inside it. Every minimiser of a text owns a
run of windows; the bytes that these cover are its span. So:

1. Every text gives its minimisers (k-gram hash, span hash). A k-gram that occurs once
   owns only windows that occur once. A span that occurs twice repeats in all its windows;
   one of its occurrences stands for all in what follows.
2. Different spans that share their k-gram are brought together by the k-gram's hash. A
   bucket builds the run-compressed Burrows-Wheeler transform of its spans with samples at
   both ends of every run; from these it streams the matching statistics (the longest match
   elsewhere of every position) and marks the windows with a match of at least `length`
   bytes. Where a k-gram has more spans than a bucket should hold, its spans are cut into
   blocks of windows, and these are told apart by more context, the bytes that all windows
   of a block share; what still shares it goes to the same index in a bucket of its own.
3. Marked windows are brought to their texts and the bytes they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import BASE, HASH_BYTES, ROW, mix, powers, prefix_hash, range_hash, slices, spread_join, utf8, with_rows, written

LENGTH, GRAM = 200, 64
#: Spans of one k-gram beyond which a bucket is cut by more context.
MOST_SPANS = 500
#: Spans that a bucket holds on average.
BUCKET_SPANS = 1000


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For every start, the first position of the smallest value among `width` values."""
    n = len(values) - width + 1
    best = np.arange(len(values))
    span = 1
    while span * 2 <= width:
        left, right = best[: len(best) - span], best[span:]
        best = np.where(values[left] <= values[right], left, right)
        span *= 2
    left, right = best[:n], best[width - span : width - span + n]
    return np.where(values[left] <= values[right], left, right)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """k-gram hash, span hash, first and last owned window, and the k-gram's place, of each minimiser of one text."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = range_hash(prefix, at, at + gram)
    owner = sliding_argmin(grams, length - gram + 1)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    last = np.r_[first[1:], n] - 1
    where = owner[first]
    # The offset of the k-gram in its span is part of the hash, so equal spans own equal windows.
    span = mix(range_hash(prefix, first, last + length) + (where - first).astype(np.uint64))
    return grams[where].view(np.int64), span.view(np.int64), first, last, where


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling.

    Texts that end with codes of their own are told apart within their length, so this
    takes as many doublings as the longest repeat needs.
    """
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    span = 1
    while rank.max(initial=0) < len(rank) - 1:
        later = np.zeros(len(rank), np.int64)
        later[:-span] = rank[span:] + 1
        rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)[1].astype(np.int64)
        span *= 2
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    return order


class RunIndex:
    """The Burrows-Wheeler transform of texts, by runs of equal codes.

    head and length describe the transform; first and last are the text positions at the
    two ends of every run. Nothing else is kept of the suffix array.
    """

    def __init__(self, codes: np.ndarray):
        order = suffix_array(codes)
        before = codes[order - 1]
        start = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        end = np.r_[start[1:], len(codes)] - 1
        self.head, self.length, self.first, self.last = before[start], end - start + 1, order[start], order[end]


def code_hash(codes: np.ndarray) -> np.ndarray:
    """prefix_hash of integer codes."""
    up, _ = powers(BASE, len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * up[: len(codes)], dtype=np.uint64, out=out[1:])
    return out


def common_prefix(codes: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at i and j, up to `most`, by halving steps over hashes."""
    prefix = code_hash(codes)
    n, out = len(codes), np.zeros(len(i), np.int64)
    step = 1 << max(most.bit_length() - 1, 0)
    while step:
        a, b = i + out, j + out
        ok = np.flatnonzero((a + step <= n) & (b + step <= n))
        same = range_hash(prefix, a[ok], a[ok] + step) == range_hash(prefix, b[ok], b[ok] + step)
        out[ok[same]] += step
        step >>= 1
    return np.minimum(out, most)


def matching_statistics(index: RunIndex, codes: np.ndarray, most: int) -> np.ndarray:
    """For every position, the length (up to `most`) of its longest match elsewhere.

    `codes` ends every text with a code of its own. A position inside a run continues the
    match of the position after it in the text, less one code; so the common prefix with the
    neighbour above (below) in suffix order is computed only for the first (last) position
    of each run, whose neighbour is the last (first) of the run before (after), and
    streamed through the text from there.
    """
    n = len(codes)
    best, places = np.zeros(n, np.int64), np.arange(n)
    for sample, neighbour in ((index.first[1:], index.last[:-1]), (index.last[:-1], index.first[1:])):
        if not len(sample):
            continue
        match = common_prefix(codes, sample, neighbour, n)
        by = np.argsort(sample)
        sample, match = sample[by], match[by]
        at = np.searchsorted(sample, places, "right") - 1
        best = np.maximum(best, np.where(at >= 0, match[at] - (places - sample[at]), 0))
    return np.minimum(best, most)


def _anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, gram, span, first, last, at)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=HASH_BYTES):
                data, offsets = utf8(part.column("text"))
                found = [anchors(data[a:b], length, gram) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                cols = [np.concatenate([f[i] for f in found]).astype(np.int64 if i < 2 else np.int32) for i in range(5)]
                yield pa.RecordBatch.from_arrays([part.column("row").take(take), *map(pa.array, cols)], names=["row", "gram", "span", "first", "last", "at"])

    return rows.mapInArrow(run, "row long, gram long, span long, first int, last int, at int")


def _bucket_windows(length: int):
    """Windows of the spans of a bucket that match elsewhere in the bucket."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(x, np.uint8) for x in frame["bytes"]]
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size + 1)
        codes = np.zeros(int(ends[-1]), np.int64)
        starts = ends - size - 1
        for s, t in zip(starts, texts, strict=True):
            codes[s : s + len(t)] = t
        codes[ends - 1] = 256 + np.arange(len(texts))
        hit = np.flatnonzero(matching_statistics(RunIndex(codes), codes, length) >= length)
        which = np.searchsorted(ends, hit, "right")
        inside = hit - starts[which]
        own = frame["own"].to_numpy()[which] & (inside <= (frame["last"] - frame["first"]).to_numpy()[which])
        which, inside = which[own], inside[own]
        at = frame["first"].to_numpy()[which] + inside
        new = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)][: len(at)])
        end = np.r_[new[1:], len(at)][: len(new)] - 1
        return pd.DataFrame({"row": frame["row"].to_numpy()[which[new]], "first": at[new].astype(np.int32), "last": at[end].astype(np.int32)})

    return run


#: Sizes of the blocks of windows that a bucket is cut into, from turn to turn.
BLOCKS = (32, 8, 2, 1)


def _cut_by_context(large: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Spans of k-grams with very many of them, as (pieces for the index, windows that repeat).

    A window is told by its reach, the number of its bytes before the k-gram. Windows of
    neighbouring reaches form a block. Only blocks that share the bytes common to all their
    windows can hold equal windows, so these bytes tell buckets apart. A bucket of at most
    MOST_SPANS pieces goes to the index. In a larger one, equal pieces are marked and one
    stands for all, and the pieces are cut into smaller blocks, down to single windows,
    where a bucket holds equal windows only.
    """
    free = length - gram
    before = F.col("at") - F.col("first")
    open_ = large.withColumns({"before": before, "low": before - (F.col("last") - F.col("first")), "a": F.lit(0), "b": F.lit(free)})
    pieces, marked = None, None
    for size in BLOCKS:
        block = F.explode(F.sequence(F.floor(F.greatest("a", "low") / size), F.floor(F.least("b", "before") / size)).cast("array<int>")).alias("block")
        cut = open_.select("row", "gram", "first", "own", "bytes", "before", "low", block)
        cut = cut.withColumns({"a": F.col("block") * size, "b": F.least(F.col("block") * size + (size - 1), F.lit(free))}).drop("block")
        core = F.substring("bytes", F.col("before") - F.col("a") + 1, F.col("a") + length - F.col("b"))
        # The part of the span that the block's windows cover; a span need not have all of them.
        top, bottom = F.least("b", "before"), F.greatest("a", "low")
        hull = F.substring("bytes", F.col("before") - top + 1, top + length - bottom)
        cut = cut.withColumns({"c1": F.xxhash64("gram", "a", core), "c2": F.hash(core), "h1": F.xxhash64("gram", "a", top, bottom, hull), "h2": F.hash(hull), "top": top, "bottom": bottom})
        cut = written(cut, "blocks")
        cores = written(cut.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1"), "cores")
        cut = written(spread_join(cut, cores, ["c1", "c2"], "n", F.xxhash64("row", "first")), "shared")
        at = F.col("first") + F.col("before")
        windows = [(at - F.col("top")).cast("int").alias("first"), (at - F.col("bottom")).cast("int").alias("last")]
        if size > 1:
            few = cut.where(F.col("n") <= MOST_SPANS).select("row", F.col("c1").alias("gram"), *windows, "own", F.substring("bytes", F.col("before") - F.col("top") + 1, F.col("top") + length - F.col("bottom")).alias("bytes"))
            pieces = few if pieces is None else pieces.unionByName(few)
            cut = cut.where(F.col("n") > MOST_SPANS).drop("n")
        hulls = cut.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("one")).where("n > 1")
        cut = written(spread_join(cut.drop("n"), written(hulls, "hulls"), ["h1", "h2"], "n", F.xxhash64("row", "first")).unionByName(cut.drop("n").join(hulls, ["h1", "h2"], "left_anti").withColumns({"n": F.lit(1).cast("long"), "one": F.lit(None).cast(hulls.schema["one"].dataType)})), "counted")
        runs = cut.where("own and one is not null").select("row", *windows)
        marked = runs if marked is None else marked.unionByName(runs)
        # One of equal pieces stays, as others may repeat a part of it; its own windows are marked already.
        stays = F.col("one").isNull() | (F.col("one") == F.struct("row", "first"))
        open_ = cut.where(stays).withColumn("own", F.col("own") & F.col("one").isNull())
    return pieces, marked


#: Row ids (8 bytes each) that may be broadcast to pick texts before these are shuffled.
BROADCAST_ROWS = 1_000_000


def _picked(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """rows joined with keyed on row; with few keys only the texts concerned are shuffled."""
    n = keyed.count()
    if n <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(keyed.select("row")), "row", "left_semi")
    return rows.join(keyed, "row")


def repeated_windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, windows array<struct<first,last>>): runs of window starts that occur elsewhere.

    rows: (row, text), where a row's id is the same whenever the rows are read.
    """
    found = written(_anchor_rows(rows, length, gram), "anchors")
    again = written(found.groupBy("gram").agg(F.count("*").alias("total")).where("total > 1"), "again")
    found = spread_join(found, again, ["gram"], "total", F.xxhash64("row", "first"))
    found = written(found.drop("total"), "shared")
    spans = written(found.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min("row").alias("one")), "spans")
    sized = written(spans.groupBy("gram").agg(F.count("*").alias("spans")), "sized")
    spans = written(spread_join(spans, sized, ["gram"], "spans", F.xxhash64("span")), "spans")
    found = written(spread_join(found, spans, ["gram", "span"], "n", F.xxhash64("row", "first")), "repeated")
    whole = found.where("n > 1").select("row", "first", "last")
    # Of each span that isn't alone with its k-gram one occurrence is examined; those that occur once get marks of their own.
    one = found.where("spans > 1 and row = one").withColumns({"own": F.col("n") == 1, "large": F.col("spans") > MOST_SPANS})
    places = one.groupBy("gram", "span", "row", "own", "large").agg(F.min("first").alias("first"), F.min("last").alias("last"), F.min("at").alias("at"))
    # A row's places are fewer than its bytes, so they travel with its text.
    by_row = written(places.groupBy("row").agg(F.collect_list(F.struct("gram", "first", "last", "at", "own", "large")).alias("picks")), "picks")
    each = _picked(rows, by_row).select("row", F.encode("text", "UTF-8").alias("b"), F.explode("picks").alias("p"))
    cut = each.select("row", "p.*", F.substring("b", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + length).alias("bytes"))
    cut = written(cut, "cut")
    pieces = cut.where("not large").select("row", "gram", "first", "last", "own", "bytes")
    if not cut.where("large").isEmpty():
        more, marked = _cut_by_context(cut.where("large"), length, gram)
        pieces, whole = pieces.unionByName(more), whole.unionByName(marked)
    n_buckets = max(1, pieces.count() // BUCKET_SPANS)
    cool = pieces.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(n_buckets)))
    marked = cool.groupBy("bucket").applyInPandas(_bucket_windows(length), "row long, first int, last int")
    return whole.unionByName(marked).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("windows"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: row_key, doc_id, n_bytes, kept_bytes (binary) and removed array<struct<start,end>> (maximal runs, end exclusive).

    Null text is empty. Texts that occur in several rows are removed whole if they have
    `length` bytes. Matches never cross texts; overlapping ones count. kept_bytes is null
    where nothing is removed.
    """
    rows = with_rows(docs).select(F.col(ROW).alias("row"), F.col(doc).cast("long").alias(doc), F.coalesce(text, F.lit("")).alias("text"))
    marks = written(repeated_windows(rows.select("row", "text"), length, gram), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                kept, removed = [], []
                for a, b, w in zip(offsets[:-1], offsets[1:], part.column("windows").to_pylist(), strict=True):
                    own = data[a:b]
                    change = np.zeros(len(own) + 1, np.int64)
                    np.add.at(change, [x["first"] for x in w], 1)
                    np.add.at(change, [x["last"] + length for x in w], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    removed.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                    kept.append(own[~gone].tobytes())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(kept, pa.binary()), pa.array(removed, kind)], names=["row", "kept_bytes", "removed"])

    cut = _picked(rows.select("row", "text"), marks).mapInArrow(run, "row long, kept_bytes binary, removed array<struct<start: long, end: long>>")
    none = F.array().cast("array<struct<start: long, end: long>>")
    whole = rows.select("row", doc, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))
    out = whole.join(cut, "row", "left")
    return out.select(F.col("row").alias(ROW), doc, "n_bytes", "kept_bytes", F.coalesce("removed", none).alias("removed"), "text_sha256")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digests(cut: DataFrame) -> DataFrame:
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.coalesce(F.octet_length("kept_bytes"), "n_bytes")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.coalesce(F.sha2("kept_bytes", 256), "text_sha256").alias("kept_sha256"),
    )


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same figures on one machine, for tests."""
    seen: dict[bytes, int] = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
