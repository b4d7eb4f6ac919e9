"""Exact top-k inner-product search in three phases with a uniform threshold.

A vector's score against a query is the sum of its scores in `lists` slices of the
dimensions; each slice of each partition is a score list. Phase 1 takes the k best
of every local list, resolves their whole scores and gathers the k best scores of a
partition; the k-th best of all gathered is a safe cutoff t (k rows reach it).
Phase 2 sends t to all partitions and collects the entries with a score of at least
t / lists in any list: a row below that in every list has a sum below t. Phase 3
resolves the collected rows' scores exactly and keeps the k best.

Queries come in blocks of bounded size; each block is one pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .common import written

#: Bytes of the query vectors of one block, which a pass sends to all tasks; far more time goes into a pass's products than into its reading.
BLOCK_BYTES = 16 << 20
#: Rows and queries that are scored against each other at once.
ROWS, QUERIES = 512, 2048


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, vec) with each component floor(scale * x), x as double; unusable rows are left out.

    Left out: a null id, a null vector, or a null, NaN or infinite component.
    """
    x = F.col(vector).cast("array<double>")
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).cast("array<long>").alias("vec"))


def _products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer products; in double where every partial sum is below 2**53. Sums that a long might not hold raise."""
    most = rows.shape[1] * int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0))
    if most < 2**53:
        return (rows.astype(np.float64) @ queries.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("the scores of these vectors may exceed a 64-bit integer")
    return rows @ queries.T


def _blocks(frames: Iterator[pd.DataFrame], by_length: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, rows, query ids, query vectors) of equal vector length."""
    for frame in frames:
        lengths = frame["vec"].map(len).to_numpy()
        for length in np.unique(lengths):
            if length not in by_length:
                continue
            own = frame[lengths == length]
            ids, rows = own["id"].to_numpy(), np.stack([np.asarray(v, np.int64) for v in own["vec"]]).reshape(len(own), length)
            qid, q = by_length[length]
            for at in range(0, len(ids), ROWS):
                for b in range(0, len(qid), QUERIES):
                    yield ids[at : at + ROWS], rows[at : at + ROWS], qid[b : b + QUERIES], q[b : b + QUERIES]


class _Best:
    """The k best (score, id) of each query: higher scores first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        for a, b in zip(first, np.r_[first[1:], len(query)], strict=True):
            s, i = score[a : min(b, a + self.k)], ids[a : min(b, a + self.k)]
            if (have := self.kept.get(query[a])) is not None:
                s, i = np.concatenate([have[0], s]), np.concatenate([have[1], i])
                o = np.lexsort((i, -s))[: self.k]
                s, i = s[o], i[o]
            self.kept[query[a]] = (s, i)


def _phase1(by_length, k, lists):
    def run(frames):
        best = _Best(k)
        for ids, rows, qid, q in _blocks(frames, by_length):
            full_ok = ids[:, None] != qid[None, :]
            chosen = np.zeros(full_ok.shape, bool)
            n = min(k, len(ids))
            for part in np.array_split(np.arange(rows.shape[1]), lists):
                local = np.where(full_ok, _products(rows[:, part], q[:, part]), np.iinfo(np.int64).min + 1)
                np.put_along_axis(chosen, np.argpartition(-local, n - 1, axis=0)[:n], True, axis=0)
            r, c = np.nonzero(chosen & full_ok)
            if len(r):
                best.add(qid[c], ids[r], np.einsum("ij,ij->i", rows[r], q[c]))
        for query, (s, _) in best.kept.items():
            yield pd.DataFrame({"query_id": query, "score": s})

    return run


def _phase23(by_length, cutoffs, k, lists):
    def run(frames):
        best = _Best(k)
        for ids, rows, qid, q in _blocks(frames, by_length):
            cut = np.array([cutoffs.get(int(x), np.iinfo(np.int64).min) for x in qid], np.int64)
            parts = np.array_split(np.arange(rows.shape[1]), lists)
            reached = np.zeros((len(ids), len(qid)), bool)
            for part in parts:
                # Whole numbers: a sum of at least cut has a part of at least its share, rounded down.
                reached |= _products(rows[:, part], q[:, part]) >= (cut // len(parts))[None, :]
            r, c = np.nonzero(reached & (ids[:, None] != qid[None, :]))
            score = np.einsum("ij,ij->i", rows[r], q[c])
            keep = score >= cut[c]
            if keep.any():
                best.add(qid[c][keep], ids[r][keep], score[keep])
        for query, (s, i) in best.kept.items():
            yield pd.DataFrame({"query_id": query, "vec_id": i, "score": s})

    return run


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 4, block: int | None = None) -> DataFrame:
    """The k best rows of `vectors` for each row of `queries`, both (id long, vec array<long>).

    Returns query_id, rank (from 1), vec_id, score. A row with the query's own id is no
    candidate. Vectors of another length than the query's don't take part. Rows that
    repeat an id are separate candidates; of queries that repeat an id the smallest vector counts.
    Empty inputs give an empty result; fewer than k candidates are all returned. `block`
    is the most queries of a pass (by default so many that their vectors have BLOCK_BYTES).
    Vectors whose products may exceed a long raise an error. Other columns don't matter.
    """
    spark = vectors.sparkSession
    queries = written(queries.groupBy("id").agg(F.min("vec").alias("vec")), "topk-queries")
    total, longest = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    block = block or max(1, BLOCK_BYTES // (8 * max(longest, 1)))
    n_blocks = max(1, -(-2 * total // block)) if total > block else 1
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    results = []
    for b in range(n_blocks):
        mine = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)
        by_length: dict[int, list] = {}
        for row in mine.toLocalIterator():
            by_length.setdefault(len(row["vec"]), []).append((row["id"], row["vec"]))
        by_length = {n: (np.array([x[0] for x in v]), np.array([x[1] for x in v], np.int64).reshape(len(v), n)) for n, v in by_length.items()}
        # Each task sends the k best scores of a query; only ranks up to k meet in one task.
        gathered = vectors.mapInPandas(_phase1(by_length, k, lists), "query_id long, score long")
        safe = gathered.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k).groupBy("query_id").agg(F.min("score").alias("cut"), F.count("*").alias("n")).where(F.col("n") == k)
        cutoffs = {row[0]: row[1] for row in safe.toLocalIterator()}
        found = vectors.mapInPandas(_phase23(by_length, cutoffs, k, lists), "query_id long, vec_id long, score long")
        results.append(found if n_blocks == 1 else written(found, "topk-block"))
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return topk(vectors, vectors.where(F.col("id") % 100 == 0), k=10)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
