"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; all other text is unlabelled. The
share of good documents among the unlabelled (the class prior) is estimated from the two
score distributions. A small network then minimises the non-negative unbiased
risk: pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)); where the second part falls below zero,
its gradient is stepped back.

Labelled rows are few and sent to every task (`max_positives` bounds them); unlabelled
rows stay where they are: in each round every task reads all of its own against random
positives, and the tasks' copies of the network are averaged by their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import HASH_BYTES, ROW, dropped, prefix_hash, range_hash, slices, utf8, with_rows, written

HIDDEN, BATCH = 16, 512
#: Rounds of averaging for the two networks of the prior and for the classifier; a task with few rows reads them again until it has made MIN_STEPS.
PRIOR_ROUNDS, ROUNDS, MIN_STEPS = 2, 8, 375
#: Rows of a task that trains.
TASK_ROWS = 30_000

_KIND = np.full(256, 6, np.int64)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 4
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 5
FEATURES = 20


def features(data: np.ndarray) -> np.ndarray:
    """Shape features of one text: shares of kinds of characters, of words and of repeats."""
    out = np.zeros(FEATURES, np.float32)
    n = len(data)
    if not n:
        return out
    kind = _KIND[data]
    share = np.bincount(kind, minlength=7)[:7] / n
    word = kind != 0
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    w = max(len(start), 1)
    lines = np.count_nonzero(data == 10)
    out[:7] = np.sqrt(share)
    out[7] = np.log1p(n) / 10
    out[8] = n / w / 20
    if len(start):
        h = range_hash(prefix_hash(data), start, end)
        odd = np.concatenate([[0], np.cumsum(kind == 6)])
        upper = np.concatenate([[0], np.cumsum(kind == 2)])
        size = end - start
        out[9] = len(np.unique(h)) / w
        out[10] = np.count_nonzero(h[1:] == h[:-1]) / w
        out[11] = np.count_nonzero(odd[end] - odd[start] == size) / w
        out[12] = np.count_nonzero((odd[end] > odd[start]) & (odd[end] - odd[start] < size)) / w
        out[13] = np.count_nonzero((upper[end] - upper[start] > 1) & (2 * (upper[end] - upper[start]) > size)) / w
        out[14] = np.count_nonzero(size == 1) / w
        out[15] = np.std(size) / 10
        pairs = h[1:] * np.uint64(31) + h[:-1]
        out[16] = len(np.unique(pairs)) / max(len(pairs), 1) if len(pairs) else 1
        out[17] = np.bincount(np.unique(h, return_inverse=True)[1]).max() / w
    out[18] = lines / w
    out[19] = np.count_nonzero(kind == 5) / w
    return out


def featured(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, doc_id, x array<float>) for every row of docs with row keys; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, HASH_BYTES):
                data, at = utf8(part.column(text))
                x = np.array([features(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.float32)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(ROW), part.column(doc), rows], names=[ROW, "doc_id", "x"])

    return docs.select(ROW, F.col(doc).cast("long").alias(doc), text).mapInArrow(run, f"{ROW} long, doc_id long, x array<float>")


class Network:
    """One hidden layer over standardised features."""

    SHAPES = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN,), (1,)]

    def __init__(self, mean, scale, flat: np.ndarray | None = None, seed: int = 1):
        self.mean, self.scale = mean, scale
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.3, s) if i in (0, 2) else np.zeros(s) for i, s in enumerate(self.SHAPES)]
        if flat is not None:
            cuts = np.cumsum([np.prod(s) for s in self.SHAPES])[:-1]
            self.p = [part.reshape(s).copy() for part, s in zip(np.split(flat, cuts), self.SHAPES, strict=True)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.p])

    def forward(self, x):
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.p[0] + self.p[1])
        return z, h, h @ self.p[2] + self.p[3][0]

    def step(self, z, h, slope, rate=0.01, decay=1e-4):
        """Adam on d(loss)/d(score) = slope for each row."""
        back = np.outer(slope, self.p[2]) * (1 - h**2)
        grads = [z.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            g = g + decay * self.p[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x):
        return _sigmoid(self.forward(x)[2])


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _rows(frame: pd.Series) -> np.ndarray:
    return np.array(frame.tolist(), np.float64).reshape(-1, FEATURES)


def _averaged(unl: DataFrame, train, size: int) -> np.ndarray | None:
    """The average of what train(rows, number of the task) returns (`size` floats) over the tasks of unl, weighted by their rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        # The features of a task's rows (160 bytes each); the table is dealt by rows.
        x = [_rows(f["x"]) for f in frames if len(f)]
        if x:
            x = np.concatenate(x)
            yield pd.DataFrame({"at": range(size), "p": train(x, TaskContext.get().partitionId()) * len(x), "n": float(len(x))})

    sums = unl.mapInPandas(run, "at int, p double, n double").groupBy("at").agg((F.sum("p") / F.sum("n")).alias("p")).orderBy("at").collect()
    return np.array([r["p"] for r in sums]) if sums else None


def _batches(x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Batches that go through all rows, again and again until MIN_STEPS are made."""
    made = 0
    while made < MIN_STEPS:
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            made += 1
            yield x[order[at : at + BATCH]]


def _against(pos: np.ndarray, net: Network, x: np.ndarray, seed: int) -> np.ndarray:
    """Steps that tell positives from unlabelled rows, for the prior only."""
    rng = np.random.default_rng(seed)
    for u in _batches(x, rng):
        rows = np.concatenate([pos[rng.integers(0, len(pos), BATCH)], u])
        z, h, f = net.forward(rows)
        weight = np.repeat([0.5 / BATCH, 0.5 / len(u)], [BATCH, len(u)])
        net.step(z, h, (_sigmoid(f) - np.repeat([1.0, 0.0], [BATCH, len(u)])) * weight, decay=3e-3)
    return net.flat()


def _non_negative(pos: np.ndarray, prior: float, net: Network, x: np.ndarray, seed: int, rate: float) -> np.ndarray:
    """Steps on the non-negative risk with the sigmoid loss: l(+) = 1 - s, l(-) = s."""
    rng = np.random.default_rng(seed)
    for u in _batches(x, rng):
        z, h, f = net.forward(np.concatenate([pos[rng.integers(0, len(pos), BATCH)], u]))
        s = _sigmoid(f)
        negative = s[BATCH:].mean() - prior * s[:BATCH].mean()
        dp, du = (s * (1 - s))[:BATCH] / BATCH, (s * (1 - s))[BATCH:] / len(u)
        slope = np.concatenate([-2 * prior * dp, du]) if negative >= 0 else np.concatenate([prior * dp, -du])
        net.step(z, h, slope, rate=rate, decay=1e-3)
    return net.flat()


def class_prior(p: np.ndarray, u: np.ndarray, n_pos: int, n_unl: int) -> float:
    """Share of positives among the unlabelled: the smallest ratio of the two tails above a score.

    p, u: shares of the positives and of the unlabelled rows that reach each of some cuts.
    Where negatives score low, the unlabelled tail holds positives only, thinned by the
    prior. Only tails with a fifth of the positives count, and each ratio is taken one
    standard error up, so that a small sample's luckiest tail doesn't set the prior.
    """
    error = np.sqrt((1 - p) / (p * n_pos) + (1 - u) / np.maximum(u * n_unl, 1))
    return float(np.clip((u / p * (1 + error)).min(), 0.05, 0.95))


def _prior(pos: np.ndarray, unl: DataFrame, mean, scale) -> float:
    """Each half of the rows is scored by a network of the other half."""
    half = lambda x: (np.abs(x.sum(1) * 1e6).astype(np.int64)) % 2
    halves = [pos[half(pos) == i] if len(pos) > 1 and 0 < half(pos).sum() < len(pos) else pos for i in (0, 1)]
    size = sum(int(np.prod(s)) for s in Network.SHAPES)
    flat = np.tile(Network(mean, scale).flat(), 2)
    for turn in range(PRIOR_ROUNDS):

        def train(x, task, flat=flat, turn=turn):
            out = []
            for i in (0, 1):
                own = x[half(x) == i]
                net = Network(mean, scale, flat[i * size : (i + 1) * size])
                out.append(_against(halves[i], net, own if len(own) else x, 1000 * task + turn))
            return np.concatenate(out)

        flat = _averaged(unl, train, 2 * size)
    nets = [Network(mean, scale, flat[i * size : (i + 1) * size]) for i in (0, 1)]
    scored = [nets[1 - i].score(halves[i]) for i in (0, 1)]
    cuts = [np.unique(np.quantile(s, np.linspace(0.0, 0.8, 40))) for s in scored]

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _rows(f["x"])
                for i in (0, 1):
                    s = nets[1 - i].score(x[half(x) == i])
                    yield pd.DataFrame({"half": i, "cut": range(len(cuts[i])), "n": [int((s >= c).sum()) for c in cuts[i]], "rows": len(s)})

    counts = {(r["half"], r["cut"]): (r["n"], r["rows"]) for r in unl.mapInPandas(tails, "half int, cut int, n long, rows long").groupBy("half", "cut").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect()}
    out = []
    for i in (0, 1):
        n, rows = np.array([counts[i, c] for c in range(len(cuts[i]))], np.float64).T
        if rows[0]:
            out.append(class_prior(np.array([(scored[i] >= c).mean() for c in cuts[i]]), n / rows, len(halves[i]), int(rows[0])))
    return float(np.mean(out))


def fit(pos: np.ndarray, unl: DataFrame) -> tuple[Network, float]:
    """A network that minimises the non-negative risk over all rows of unl (x array<float>), and the class prior."""
    of = [(F.avg(F.col("x")[i]), F.coalesce(F.stddev_pop(F.col("x")[i]), F.lit(0.0))) for i in range(FEATURES)]
    stats = np.array(unl.agg(*[c for pair in of for c in pair]).first(), np.float64).reshape(-1, 2)
    mean, scale = stats[:, 0], stats[:, 1] + 1e-3
    prior = _prior(pos, unl, mean, scale)
    flat = Network(mean, scale).flat()
    for turn in range(ROUNDS):
        rate = 0.01 if turn < ROUNDS // 2 else 0.003
        flat = _averaged(unl, lambda x, task, flat=flat, rate=rate, turn=turn: _non_negative(pos, prior, Network(mean, scale, flat), x, 1000 * task + turn, rate), len(flat))
    return Network(mean, scale, flat), prior


def _positives(df: DataFrame, most: int) -> np.ndarray:
    """The features of about `most` rows at most, chosen by the id's hash, the same in every run."""
    n = df.count()
    share = min(1.0, most / max(n, 1))
    rows = df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) <= F.lit(int(share * (1 << 40)))).select("x").toPandas()
    return _rows(rows["x"])


def classify(docs: DataFrame, labels: DataFrame, train: Column, doc: str = "doc_id", text: str = "text", max_positives: int = 15_000) -> DataFrame:
    """(row_key, doc_id, score double, predicted int, prior double) of every row.

    labels: (doc_id, quality); a document is a trusted positive if all its labels are 1, so
    labels that disagree or are null leave it unlabelled. Only rows with `train` (a condition
    on doc_id) are learnt from: all unlabelled ones, and of the labelled ones at most about
    `max_positives`. Without any positive or unlabelled row nothing can be learnt: the score
    is then 0.5. A score of 0.5 counts as good (predicted 1). Null and empty texts have a
    score too, texts of any length are read whole, rows are told by their keys (repeated
    rows and ids keep their own result), other columns don't matter, and an empty table
    gives no rows.
    """
    x = written(featured(with_rows(docs), doc, text), "features")
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1").select("doc_id")
    learn = x.where(train)
    pos = _positives(learn.join(good, "doc_id", "left_semi"), max_positives)
    unl = learn.join(good, "doc_id", "left_anti").select("x")
    n = unl.count()
    if not len(pos) or not n:
        return x.select(ROW, "doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), F.lit(None).cast("double").alias("prior"))
    # Dealt in turn, so that every task trains on a mixture also where files are sorted by source.
    unl = written(unl.repartition(1 + n // TASK_ROWS), "unlabelled")
    net, prior = fit(pos, unl)
    dropped(unl)

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(net.score(_rows(rows)), dtype=float)

    out = x.select(ROW, "doc_id", score("x").alias("score"))
    return out.select(ROW, "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(prior).alias("prior"))


def held_out(doc: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = classify(docs, labels, ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "prior")
