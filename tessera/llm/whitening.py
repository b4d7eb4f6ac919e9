"""Whitening of embeddings by the principal components of the distinct vectors.

Vectors become whole numbers first, so sums, means and deviations are exact. The fit list
(each distinct vector once) is centred exactly, RowMatrix gives its Gramian (one pass, a
matrix of dimension x dimension on the driver), the eigenvectors are taken there, and a
broadcast matrix of a few columns whitens all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession

from .common import dropped, written

#: Whole numbers below this, so that differences from a mean are exact in double.
LARGEST = 1 << 48
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x) with each component floor(scale * c), c as double; rows without a usable vector are left out.

    Left out: a null vector, a null, NaN or infinite component, or one of 2**48 / scale or more in size.
    """
    x = F.col(vector).cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(float(scale))) < F.lit(float(LARGEST))))
    return df.where(x.isNotNull() & usable).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).cast("array<long>").alias("x"))


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Vectors and exact sums per dimension, by vector length."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for length, own in frame.groupby(frame["x"].map(len))["x"]:
                # A batch has at most some ten thousand rows, so the sums of values below 2**48 fit a long.
                for at in range(0, len(own), 1 << 14):
                    part = np.stack(own.iloc[at : at + (1 << 14)].to_list())
                    yield pd.DataFrame({"length": [length], "n": [len(part)], "total": [part.sum(axis=0)]})

    parts = fit.mapInPandas(partial, "length int, n long, total array<long>")
    by_place = parts.select("length", "n", F.posexplode("total").alias("at", "v")).groupBy("length", "at")
    out: dict[int, tuple[int, list[int]]] = {}
    # One row for each dimension of each length that occurs.
    for length, _, n, total in sorted(by_place.agg(F.sum("n"), F.sum(F.col("v").cast("decimal(38,0)"))).collect()):
        out.setdefault(length, (n, []))[1].append(int(Decimal(total)))
    return out


class Whitening:
    """Mean (whole part and rest) and the projection on the leading components over their spreads."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, most: int):
        self.n = n
        self.whole, self.rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        order = np.argsort(-values, kind="stable")[:most]
        values = np.maximum(values, 0.0)
        trace = values.sum()
        self.explained = values[order] / trace if trace > 0 else np.zeros(len(order))
        self.spread = values[order] > values.max(initial=0.0) * len(sums) * np.finfo(float).eps
        self.matrix = vectors[:, order] / np.sqrt(np.where(self.spread, values[order], np.inf))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.spread, self.centred(x) @ self.matrix, np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)**2; None for what a long can't hold."""
        from_mean = x - self.whole
        largest = int(np.abs(from_mean).max(initial=0)) * self.n + self.n
        if x.shape[1] * largest**2 < 2**63:
            return ((from_mean * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((from_mean.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def fit_length(fit: DataFrame, length: int, n: int, sums: list[int], most: int) -> tuple[Whitening, float]:
    """The whitening of the vectors of one length, and the largest entry of the whitened covariance minus the identity."""
    own = fit.where(F.size("x") == length)
    whole, rest = F.lit([s // n for s in sums]).cast("array<long>"), F.lit([(s % n) / n for s in sums])
    exact = F.zip_with(F.zip_with("x", whole, lambda v, m: (v - m).cast("double")), rest, lambda v, r: v - r)
    rows = MLUtils.convertVectorColumnsFromML(own.select(array_to_vector(exact).alias("row")), "row")
    gram = RowMatrix(rows, n, length).computeGramianMatrix().toArray()
    model = Whitening(n, sums, *np.linalg.eigh(gram / n), most)
    sent = fit.sparkSession.sparkContext.broadcast(model)

    def whitened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                z = sent.value.apply(np.stack(frame["x"].to_list()))[:, sent.value.spread]
                yield pd.DataFrame({"z": list(z)})

    k = int(model.spread.sum())
    if not k:
        return model, 0.0
    z = [F.col("z")[i] for i in range(k)]
    sums_of = [F.sum(a) for a in z] + [F.sum(z[i] * z[j]) for i in range(k) for j in range(i, k)]
    got = np.array(own.mapInPandas(whitened, "z array<double>").agg(*sums_of).first(), float) / n
    mean, cov = got[:k], np.zeros((k, k))
    cov[np.triu_indices(k)] = got[k:]
    cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
    return model, float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = 4) -> DataFrame:
    """Rows of SCHEMA: each row of `vectors` (vec_id long, x array<long>) on the first `most` components.

    The fit counts each distinct vector once, however many rows (or a third of all) have it;
    repeated rows and null ids keep rows of their own. Vectors of different lengths are
    spaces apart, each with a fit of its own; an empty vector has no component and gives no
    row, and neither does an empty table. Components of no spread (fewer distinct vectors
    than dimensions) are explained 0 and whitened null, and identity_error looks at the
    others (0 if there are none). Equal eigenvalues leave their components' order open. A
    deviation that a long can't hold is null. Other columns don't travel.
    """
    spark = vectors.sparkSession
    fit = written(vectors.where(F.size("x") > 0).select("x").distinct(), "distinct-vectors")
    out = spark.createDataFrame([], SCHEMA)
    for length, (n, sums) in _sums(fit).items():
        model, error = fit_length(fit, length, n, sums, most)
        sent = spark.sparkContext.broadcast(model)

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = np.stack(frame["x"].to_list())
                    z = sent.value.apply(x)
                    yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "deviation": pd.array(sent.value.deviations(x), "Int64"), "z": list(z)})

        rows = vectors.where(F.size("x") == length).mapInPandas(run, "vec_id long, deviation long, z array<double>")
        each = rows.select("vec_id", "deviation", F.posexplode("z").alias("at", "w"))
        explained = F.lit([float(e) for e in model.explained])
        out = out.unionByName(
            each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"), explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
        )
    dropped(fit)
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
