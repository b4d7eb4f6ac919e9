"""Tables in folders that are written so that a repeated batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import stored


def _replace_parts(df: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of `by` that df has; others stay."""
    df.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_partial(df: DataFrame, path: str, batch: int) -> None:
    """A batch's own share of a rollup. The share is a partition of its own, so a batch that is run again replaces itself."""
    _replace_parts(df.withColumn("batch", F.lit(batch).cast("long")), path, "batch")


def rolled_up(spark: SparkSession, path: str, keys: list[str], sums: list[str]) -> DataFrame:
    """The rollup over the shares of all batches; null keys are a key."""
    return spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def rollup_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Start counting a stream's rows by key into shares; a micro-batch that is run again after a failure replaces its share."""

    def put(df: DataFrame, batch: int) -> None:
        write_partial(df.groupBy(*keys).agg(F.count("*").alias("n")), path, batch)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(new: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Put rows in by key, null keys too: a new row replaces the stored one. Of new rows that repeat a key the greatest counts.

    The table is partitioned by a hash of the key; only partitions with new keys are read and
    written again, from a staged copy, so running it twice changes nothing.
    """
    spark = new.sparkSession
    rest = [c for c in new.columns if c not in keys]
    bucket = F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket")
    newest = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r"), F.lit(1).alias("_new")).select(*keys, "r", "_new", bucket)
    if _exists(spark, path):
        old = spark.read.parquet(path)
        touched = newest.select("bucket").distinct()  # at most `buckets` rows
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").select(*keys, F.struct(*rest).alias("r"), F.lit(0).alias("_new"), "bucket")
        newest = kept.unionByName(newest).groupBy(*keys, "bucket").agg(F.max_by("r", "_new").alias("r"))
    staged = stored(newest.select(*keys, "r.*", "bucket"))
    _replace_parts(staged.repartition("bucket"), path, "bucket")


def delete_before(spark: SparkSession, path: str, day: str, cutoff: str, time: str) -> int:
    """Delete the rows whose `time` is before the cutoff from a table partitioned by `day`; says how many days went whole.

    Days before the cutoff's go as folders; the cutoff's own day is written again without its earlier rows.
    """
    table = spark.read.parquet(path)
    limit = F.lit(cutoff).cast("timestamp")
    that_day = F.col(day) == F.to_date(limit)
    left = stored(table.where(that_day & (F.col(time).cast("timestamp") >= limit)))
    partly = not left.isEmpty()
    gone = F.col(day) < F.to_date(limit) if partly else F.col(day) <= F.to_date(limit)
    days = [r[0] for r in table.where(gone & ((F.col(time).cast("timestamp") < limit) | F.col(time).isNull())).select(day).distinct().collect()]  # one row a day
    for d in days:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{day}={d}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if partly:
        _replace_parts(left, path, day)
    return len(days)


def without_parents(tables: dict[str, DataFrame], ids: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables after some rows of the first one and all that hangs on them went, children before parents.

    ids: one column, the keys of the first table that go. links: (table, column, parent table,
    parent's key), parents before children. Returns what each table keeps; a null reference hangs on nothing.
    """
    first = next(iter(tables))
    key = ids.columns[0]
    gone = {first: tables[first].join(ids, key, "left_semi")}
    kept = {first: tables[first].join(ids, key, "left_anti")}
    for name, column, parent, parent_key in links:
        lost = gone[parent].select(F.col(parent_key).alias(column)).where(F.col(column).isNotNull()).distinct()
        before = kept.get(name, tables[name])
        out = before.join(lost, column, "left_semi")
        gone[name] = out if name not in gone else gone[name].unionByName(out, allowMissingColumns=True)
        kept[name] = before.join(lost, column, "left_anti").select(tables[name].columns)
    return {n: kept.get(n, t) for n, t in tables.items()}
