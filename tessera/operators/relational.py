"""Operators from DataFrame to DataFrame that the queries share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered listing; the order must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row with the highest version of every key: an aggregate, so partly done before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return first.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def islands(df: DataFrame, keys: list[str], order: list[str], same: str) -> DataFrame:
    """Add `island`: runs of neighbours with equal `same` have one number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((F.lag(same).over(w) != F.col(same)).cast("int"), F.lit(1))
    return df.withColumn("island", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, effective: str, value: str) -> DataFrame:
    """Add the value of the last right row with effective <= at, by a union and one window instead of a range join."""
    rest = [c for c in left.columns if c not in keys + [at]]
    a = left.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(at, *rest).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    b = right.select(*keys, F.col(effective).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*keys, "_row.*", value)


def cell_changes(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Added, deleted and modified cells of two grids (full outer join on the cell)."""
    j = a.select(*keys, F.col(value).alias("before")).join(b.select(*keys, F.col(value).alias("after")), keys, "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified")
    return j.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", kind)


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir; only a local master, as in tests, may leave that unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        path = _LOCAL[0]
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and reread: what several branches of a plan read is computed once."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
