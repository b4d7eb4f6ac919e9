"""Helpers shared by the corpus operators: the shared folder, written tables, text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

#: Texts are handed to the vectorised kernels in slices of about this many bytes.
SLICE_BYTES = 4 << 20
#: Texts whose runs are hashed come in smaller ones: a byte there takes some sixty of arrays and powers.
HASH_BYTES = 2 << 20


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only a local master, as in tests, may
    leave that unset; it gets one temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        path = _LOCAL[0]
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return it reread.

    Cuts the lineage: a lost executor costs only the tasks that read the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables made by written() that no later plan reads."""
    for t in tables:
        if t is not None and hasattr(t, "table_path"):
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t.table_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str, salt: Column) -> DataFrame:
    """Inner join of big with small, which has one row for each key and in `rows` how many rows of big have it.

    Keys with more rows than a task should read (at most 5,000 keys by that bound) are
    dealt over several tasks: by `salt`, a hash of big's columns, on the one side, and by
    copies of the row on the other.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    limit = max(10_000, total // 5_000)
    parts = F.greatest(F.ceil(F.col(rows) / limit), F.lit(1)).cast("int")
    hot = small.where(F.col(rows) > limit).select(*keys, parts.alias("_parts"))
    left = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_parts").isNotNull(), F.pmod(salt, F.col("_parts")).cast("int")).otherwise(0)).drop("_parts")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


#: The column that with_rows() adds, and the mark in its metadata that tells it from a user's column of that name.
ROW = "row_key"
_MARK, _NAME = "tessera_row_key", "tessera_own_name"
#: Bytes of file paths that may be broadcast to number a table's files.
PATH_BYTES = 32 << 20


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores behind it if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_rows(docs: DataFrame) -> DataFrame:
    """docs with a long in ROW that tells every row, also repeated ones, and is the same whenever the rows are read.

    The key of a file scan is the file's number and the row's place in it, whatever the
    splits; other tables, and tables of so many files that their paths exceed PATH_BYTES,
    are written once. A table that has such a key stays as it is. A column of the user
    that is named like ROW is set aside under another name; without_rows() gives it back.
    """
    if any(f.name == ROW and f.metadata.get(_MARK) for f in docs.schema):
        return docs
    for c in docs.columns:
        if c.lower() == ROW:
            docs = docs.select(*[F.col(f"`{x}`").alias(free_name(docs, x), metadata={_NAME: x}) if x == c else F.col(f"`{x}`") for x in docs.columns])
    mark = {_MARK: True}
    scan = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in [c.lower() for c in docs.columns]
    paths = docs.inputFiles() if scan else []
    if not paths or sum(map(len, paths)) > PATH_BYTES:
        return written(docs.withColumn(ROW, F.monotonically_increasing_id().alias(ROW, metadata=mark)), "rows")
    file, place, number = (free_name(docs, c) for c in ("_file", "_at", "_number"))
    at = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    files = sorted(r[0] for r in at.select(file).distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"`{file}` string, `{number}` long")
    key = F.shiftleft(number, 40) + F.col(place)
    return at.join(F.broadcast(numbers), file).select(*[f"`{c}`" for c in docs.columns], key.alias(ROW, metadata=mark))


def without_rows(docs: DataFrame) -> DataFrame:
    """docs without the key of with_rows(); a column that was set aside has its own name again."""
    return docs.select(*[F.col(f"`{f.name}`").alias(f.metadata.get(_NAME, f.name), metadata={}) if _NAME in f.metadata else F.col(f"`{f.name}`") for f in docs.schema if not (f.name == ROW and f.metadata.get(_MARK))])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets) without copying it to Python strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each slice have about `limit` bytes (a longer text stays whole)."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A random odd 64-bit code for each byte value."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64), dtype=np.uint64)])
                for x in (base, inverse)
            )
        _POWERS[base] = have
    return have


#: An odd base with good bit mixing for the polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def prefix_hash(data: np.ndarray, seed: int = 7) -> np.ndarray:
    """Prefix sums S with S[j] - S[i] = base**i * hash(data[i:j])."""
    up, _ = powers(BASE, len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes(seed)[data] * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of data[start:end] for each pair; equal strings get equal hashes."""
    _, down = powers(BASE, len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])
