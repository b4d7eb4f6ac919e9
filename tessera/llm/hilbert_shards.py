"""Sharding along a Hilbert curve over quantised metadata.

Each row becomes a cell of a small grid: numbers by equal-count cut points, strings by
cut points of their first six bytes as a number (which keeps their order). Rows are
sorted by the cell's index on the Hilbert curve and the sorted rows are cut into runs of
equal count, so the rows of a shard are close in all dimensions and a reader can prune
shards by their minimum and maximum of each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .common import ROW, with_rows, without_rows, written

#: Grid cells of a dimension are 2**BITS.
BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of cells (n x dims, below 2**bits).

    Follows Skilling, "Programming the Hilbert curve" (2004): undo excess rotations from
    the highest bit down, Gray-encode, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def _number(df: DataFrame, column: str) -> Column:
    """A double in the column's order; null for null."""
    if dict(df.dtypes)[column] == "string":
        first = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(first, 16, 10).cast("double")
    return F.col(column).cast("double")


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Add _cell_0, _cell_1, ...: equal-count bins over all rows; null is in bin 0."""
    df = df.withColumns({f"_num_{i}": _number(df, d) for i, d in enumerate(dims)})
    shares = [i / 2**bits for i in range(1, 2**bits)]
    cuts = df.agg(*[F.percentile_approx(f"_num_{i}", shares, 10_000).alias(f"c{i}") for i in range(len(dims))]).first()
    cells = {}
    for i in range(len(dims)):
        edges = sorted(set(cuts[i] or []))
        number = F.col(f"_num_{i}")
        cell = sum((F.when(number >= e, 1).otherwise(0) for e in edges), F.lit(0))
        cells[f"_cell_{i}"] = F.when(number.isNull(), 0).otherwise(cell).cast("int")
    return df.withColumns(cells).drop(*[f"_num_{i}" for i in range(len(dims))])


def shards(df: DataFrame, dims: list[str], order: list[str], n_shards: int = 8, bits: int = BITS) -> DataFrame:
    """Add hilbert long, shard int (0 to n_shards - 1) and slot long (0, 1, ... in a shard).

    Row counts of shards differ by one at most. `order` breaks ties within a cell, and rows
    that are equal in it too go by their row key, so a cell or value with very many rows is
    split over tasks. Nulls sort first; with fewer rows than shards some shards are empty.
    Texts don't travel unless they are columns of df; an empty table gives no rows. Columns
    of df named hilbert, shard or slot, or like the inner ones (_place and so on), raise.
    """
    names = [f"_cell_{i}" for i in range(len(dims))]
    inner = {"hilbert", "shard", "slot", "_place", "_part", "_before", "_rows", "_position", *names, *(f"_num_{i}" for i in range(len(dims)))}
    if clash := inner & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    if (bits * len(dims)) > 62:
        raise ValueError("bits * dimensions must be at most 62")

    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([c.to_numpy() for c in cells]), bits))

    rows = with_rows(df)
    keyed = quantised(rows, dims, bits).withColumn("hilbert", index(*names))
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The written table fixes which row got which place: the range bounds come from a sample.
    ranged = keyed.repartitionByRange(n, "hilbert", *order, ROW).sortWithinPartitions("hilbert", *order, ROW)
    placed = written(ranged.withColumn("_place", F.monotonically_increasing_id()), "hilbert")
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    sizes = placed.groupBy("_part").count()
    # One row for each task that wrote: at most as many as shuffle partitions.
    total = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", total.alias("_before"), F.sum("count").over(Window.partitionBy()).alias("_rows"))
    rank = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(F.broadcast(starts), "_part").withColumn("_position", rank)
    out = out.withColumn("shard", F.expr(f"cast(_position * {n_shards} div _rows as int)"))
    first = F.expr(f"(shard * _rows + {n_shards - 1}) div {n_shards}")
    return without_rows(out.withColumn("slot", F.col("_position") - first).select(*[f"`{c}`" for c in rows.columns], "hilbert", "shard", "slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order, so that files carry narrow ranges of every dimension."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """law 'rows': counts at most one apart."""
    docs = with_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    keys = docs.select(
        ROW,
        "doc_id",
        "lang",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    out = shards(keys, ["lang", "source", "size"], ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
