"""Document log-likelihood under a gated recurrent language model.

Tokens are counted over all training documents. The commonest words get slots of the
network's output, dealt into classes by frequency; p(word) = p(class) * p(word | class).
All other tokens are a class of their own, whose probability is divided by their smoothed
counts, so every token has a probability. The network starts at the unigram distribution.
Every training row is read in one of `ROUNDS` rounds: tasks train a copy by truncated
backpropagation on their rows, and the copies are averaged by token count. For scoring, a
document's state is carried from window to window, so its whole text is one sequence.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from .common import dropped, slices, utf8, written

CLASSES, PER_CLASS = 32, 64
EMBED, HIDDEN = 16, 16
#: Steps of a window of truncated backpropagation and of scoring, and lanes that run side by side.
WINDOW, SCORE_WINDOW, LANES = 16, 32, 512
#: Every training row belongs to one round; after each the tasks' copies are averaged.
ROUNDS = 2
#: Words whose counts go to every task (the commonest); the others' counts are joined.
COMMON = 65_536
#: Class 0 holds OTHER alone; END is the first slot of class 1.
OTHER, END = 0, PER_CLASS
BLOCK = 4096
#: Copies that are summed in one group on each level of the averaging.
FAN_IN = 32


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over all rows; the end of a document is counted by rows, not here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
            held.clear()
            return batch

        for batch in batches:
            for t in batch.column(text).to_pylist():
                held.update(tokens(t))
                if len(held) > 400_000:
                    yield out()
        if held:
            yield out()

    return docs.select(text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int = COMMON) -> list[tuple[str, int]]:
    """The words above the smallest count that at most `most` words exceed, by falling count and then by word.

    The cutoff comes from the counts of counts, so that no task sends more rows than are
    kept. Words tied at the cutoff are all left out; their counts are joined instead.
    """
    sizes = counts.groupBy("n").agg(F.count("*").alias("words"))
    # One row for each different count: few even of a very large corpus.
    above = sizes.withColumn("upto", F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    least = above.where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    rows = [] if least is None else counts.where(F.col("n") >= least).collect()
    return sorted(((r["token"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _sig(x):
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    np.add(x, 0.5, out=x)
    return x


def _picked(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log softmax at one column of each row; logits become the softmax times the total, which is returned too."""
    np.minimum(logits, 60, out=logits)
    own = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    return own - np.log(total), total


class Gru:
    """Parameters and the passes over a window of lanes."""

    SHAPES = [("E", (CLASSES * PER_CLASS, EMBED)), ("W", (EMBED, 3 * HIDDEN)), ("b", (3 * HIDDEN,)), ("U", (HIDDEN, 2 * HIDDEN)), ("V", (HIDDEN, HIDDEN)), ("C", (HIDDEN, CLASSES)), ("c", (CLASSES,)), ("O", (CLASSES, HIDDEN, PER_CLASS)), ("o", (CLASSES, PER_CLASS))]

    def __init__(self, flat: np.ndarray):
        at = 0
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape).astype(np.float32))
            at += n

    @classmethod
    def start(cls, slot_counts: np.ndarray) -> np.ndarray:
        """Small random weights; the output biases give the slots' unigram distribution."""
        rng = np.random.default_rng(5)
        n = slot_counts.reshape(CLASSES, PER_CLASS) + 1e-3
        parts = []
        for name, shape in cls.SHAPES:
            if name == "c":
                parts.append(np.log(n.sum(1) / n.sum()))
            elif name == "o":
                parts.append(np.log(n / n.sum(1, keepdims=True)))
            elif name in "CO":
                parts.append(rng.normal(0, 0.02, shape))
            else:
                parts.append(np.zeros(shape) if name == "b" else rng.normal(0, 0.15, shape))
        return np.concatenate([p.ravel() for p in parts]).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n, _ in self.SHAPES])

    def table(self) -> np.ndarray:
        """Input contribution of each slot."""
        return self.E @ self.W + self.b

    def states(self, x, keep, h, held: tuple | None = None):
        """Hidden states (steps, lanes, HIDDEN) from input contributions x; keep is 0 where a lane starts anew."""
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)):
            h = h * keep[t]
            zr = _sig(x[t, :, : 2 * HIDDEN] + h @ self.U)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ self.V)
            if held is not None:
                held[0][t], held[1][t], held[2][t] = h, zr, n
            h = n + z * (h - n)
            out[t] = h
        return out, h

    def output(self, hs, target, grad: dict | None = None, real: np.ndarray | None = None):
        """log p of each target slot; with grad, fills the output's gradients and returns d/dhs too. Rows where `real` is 0 have no gradient."""
        cls, word = (target // PER_CLASS).astype(np.uint8), target % PER_CLASS
        p = hs @ self.C + self.c
        logp, total = _picked(p, cls)
        back = None
        if grad is not None:
            p /= total[:, None]
            p[np.arange(len(cls)), cls] -= 1
            if real is not None:
                p *= real[:, None]
            grad["C"], grad["c"], back = hs.T @ p, p.sum(0), p @ self.C.T
            grad["O"], grad["o"] = np.zeros_like(self.O), np.zeros_like(self.o)
        # Sorted by class, the rows of a class are one piece; class 0 has no words to tell apart.
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        rows, words, own = hs[order], word[order], np.zeros(len(cls), np.float32)
        part = np.zeros_like(rows) if grad is not None else None
        for k in range(1, CLASSES):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                q = rows[a:b] @ self.O[k] + self.o[k]
                own[a:b], total = _picked(q, words[a:b])
                if grad is not None:
                    q /= total[:, None]
                    q[np.arange(b - a), words[a:b]] -= 1
                    if real is not None:
                        q *= real[order[a:b], None]
                    grad["O"][k], grad["o"][k] = rows[a:b].T @ q, q.sum(0)
                    part[a:b] = q @ self.O[k].T
        logp[order] += own
        if grad is not None:
            back[order] += part
        return logp, back

    def learn(self, ids, keep, target, h, adam, real: np.ndarray | None = None):
        """One step of truncated backpropagation over a window (steps x lanes); places where `real` is 0 fill it up."""
        steps, lanes = ids.shape
        held = tuple(np.empty((steps, lanes, n), np.float32) for n in (HIDDEN, 2 * HIDDEN, HIDDEN))
        # The window's distinct slots, and each input's place among them.
        flat_ids = ids.ravel()
        slots = np.flatnonzero(np.bincount(flat_ids, minlength=CLASSES * PER_CLASS))
        place = np.zeros(CLASSES * PER_CLASS, np.uint16)
        place[slots] = np.arange(len(slots))
        at = place[flat_ids]
        x = (self.E[slots] @ self.W + self.b)[at].reshape(steps, lanes, 3 * HIDDEN)
        hs, last = self.states(x, keep, h, held)
        grad: dict = {}
        _, back = self.output(hs.reshape(-1, HIDDEN), target.ravel(), grad, None if real is None else real.ravel())
        back = back.reshape(hs.shape)
        dx = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            h0, n = held[0][t], held[2][t]
            z, r = held[1][t, :, :HIDDEN], held[1][t, :, HIDDEN:]
            dh = dh + back[t]
            dn = dh * (1 - z) * (1 - n * n)
            drh = dn @ self.V.T
            dx[t, :, :HIDDEN] = dh * (h0 - n) * z * (1 - z)
            dx[t, :, HIDDEN : 2 * HIDDEN] = drh * h0 * r * (1 - r)
            dx[t, :, 2 * HIDDEN :] = dn
            dh = (dh * z + drh * r + dx[t, :, : 2 * HIDDEN] @ self.U.T) * keep[t]
        flat = dx.reshape(-1, 3 * HIDDEN)
        h0 = held[0].reshape(-1, HIDDEN)
        grad["U"], grad["V"] = h0.T @ flat[:, : 2 * HIDDEN], (held[1].reshape(-1, 2 * HIDDEN)[:, HIDDEN:] * h0).T @ flat[:, 2 * HIDDEN :]
        # Rows of equal input slots are summed before they meet the weights.
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(flat[order], np.searchsorted(at[order], np.arange(len(slots))), axis=0)
        grad["W"], grad["b"] = self.E[slots].T @ sums, sums.sum(0)
        grad["E"] = np.zeros_like(self.E)
        grad["E"][slots] = sums @ self.W.T
        adam["t"] += 1
        t = adam["t"]
        rate = np.float32(0.008 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t))
        for name, _ in self.SHAPES:
            g = grad[name]
            g *= np.float32(1 / (ids.size if real is None else max(real.sum(), 1)))
            np.clip(g, -0.1, 0.1, out=g)
            m, v = adam.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            v *= np.float32(0.99)
            g *= g
            g *= np.float32(0.01)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= rate
            getattr(self, name)[...] -= g
        return last


def lanes(sizes: np.ndarray, n_lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deal documents to lanes, longest first to the shortest lane: lane of each document, its start, lane lengths.

    Lanes are numbered by falling length, so those still running are always the first ones.
    """
    n_lanes = min(n_lanes, max(len(sizes), 1))
    heap = [(0, i) for i in range(n_lanes)]
    lane, start, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(n_lanes, np.int64)
    for d in np.argsort(-sizes, kind="stable"):
        at, i = heapq.heappop(heap)
        lane[d], start[d] = i, at
        total[i] = at + sizes[d]
        heapq.heappush(heap, (at + int(sizes[d]), i))
    order = np.argsort(-total, kind="stable")
    renamed = np.empty(n_lanes, np.int64)
    renamed[order] = np.arange(n_lanes)
    return renamed[lane], start, total[order]


def _stream(target: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and starts of documents one after the other: the token before, END at a document's start."""
    fresh = np.zeros(len(target), bool)
    fresh[np.cumsum(sizes) - sizes] = True
    before = np.concatenate([[END], target[:-1]]).astype(np.int16)
    before[fresh] = END
    return before, fresh


class Words:
    """The common words with their slots and smoothed log counts, as arrays behind one lookup."""

    def __init__(self, common: list[tuple[str, int]]):
        self.index = {t.encode(): i for i, (t, _) in enumerate(common)}
        n = np.array([c for _, c in common], np.float64)
        self.slot = np.full(len(common) + 1, OTHER, np.int16)
        in_net = min(len(common), (CLASSES - 1) * PER_CLASS - 1)
        self.slot[:in_net] = END + 1 + np.arange(in_net)
        self.log = np.append(np.log10(n + 0.1), 0.0)
        self.in_net = in_net

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word; -1 for words that aren't common."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))


def encoded(docs: DataFrame, words: Words, log_other: float, training: Column, doc: str, text: str) -> DataFrame:
    """Written: row, doc_id, learn, n_tokens, n_common, common_log, other_log, rare array<string>, slots binary (16 bits each).

    Texts are cut into words once; training and scoring read the slots.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, text):
                found = [tokens(t) for t in part.column(text).to_pylist()]
                size = np.array([len(w) for w in found])
                flat = [t for w in found for t in w]
                index = known.find(flat)
                slots, ends = known.slot[index], np.cumsum(size)
                of = np.repeat(np.arange(len(size)), size)
                total = lambda weights: np.bincount(of, weights, len(size)).astype(np.float64)
                logs, rare = known.log[index], index < 0
                at = np.flatnonzero(rare)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(total(rare))]).astype(np.int32)), pa.array([flat[i] for i in at], pa.binary()).cast(pa.string()))
                data = np.insert(slots, ends, END).astype(np.int16)
                cuts = np.concatenate([[0], 2 * (ends + np.arange(1, len(size) + 1))]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in ("row", "doc_id", "learn")], pa.array(size + 1), pa.array(total(~rare).astype(np.int64)), pa.array(total(logs)), pa.array(total(np.where(slots == OTHER, logs - log_other, 0))), lists, binary],
                    names=["row", "doc_id", "learn", "n_tokens", "n_common", "common_log", "other_log", "rare", "slots"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("learn"), text)
    # Written once: the row numbers of later joins are those of the written rows.
    return written(rows.mapInArrow(run, "row long, doc_id long, learn boolean, n_tokens long, n_common long, common_log double, other_log double, rare array<string>, slots binary"), "encoded")


def _sequences(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All slots of a batch, and the number of each row."""
    data, offsets = utf8(part.column("slots"))
    return np.frombuffer(data.tobytes(), np.int16), np.diff(offsets) // 2


def train(rows: DataFrame, slot_counts: np.ndarray) -> np.ndarray:
    """Average the tasks' copies after each round; every row (row, slots) takes part in one round.

    A task joins its documents to one stream and cuts it into equal lanes; documents wait
    until they fill many windows of all lanes, and at the end of the task the rest is read
    in fewer lanes.
    """
    flat = Gru.start(slot_counts)
    sc = rows.sparkSession.sparkContext
    for turn in range(ROUNDS):
        shared = sc.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            net, adam, seen = Gru(shared.value.copy()), {"t": 0}, 0

            def read(parts: list[tuple[np.ndarray, np.ndarray]]) -> int:
                target, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
                before, fresh = _stream(target, sizes)
                n_lanes = min(LANES, max(1, len(target) // WINDOW))
                steps = -(-len(target) // n_lanes)
                # The last lanes are filled up with places that aren't learnt from, so no token is left out.
                fill = steps * n_lanes - len(target)
                shape = lambda a, end: np.ascontiguousarray(np.append(a, np.full(fill, end, a.dtype)).reshape(n_lanes, steps).T)
                goal, ids, keep = shape(target, END), shape(before, END), shape(~fresh, False).astype(np.float32)[:, :, None]
                real = shape(np.ones(len(target), np.float32), 0)
                h = np.zeros((n_lanes, HIDDEN), np.float32)
                for a in range(0, steps, WINDOW):
                    w = slice(a, a + WINDOW)
                    h = net.learn(ids[w], keep[w], goal[w], h, adam, None if real[w].all() else real[w])
                return len(target)

            held, size = [], 0
            for batch in batches:
                for part in slices(batch, "slots", 1 << 20):
                    held.append(_sequences(part))
                    size += len(held[-1][0])
                    if size >= 32 * LANES * WINDOW:
                        seen += read(held)
                        held, size = [], 0
            if held:
                seen += read(held)
            if seen:
                p = net.flat() * np.float32(seen)
                cut = [p[i : i + BLOCK].tolist() for i in range(0, len(p), BLOCK)]
                n = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(cut, pa.list_(pa.float32())), pa.array([float(seen)] * n)], names=["block", "part", "p", "seen"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"block": frame["block"][:1], "part": frame["part"][:1] // FAN_IN, "p": [np.sum(np.stack(frame["p"]), 0)], "seen": [frame["seen"].sum()]})

        schema = "block int, part int, p array<float>, seen double"
        mine = rows.where(F.pmod("row", F.lit(ROUNDS)) == turn).select("slots")
        summed = written(mine.mapInArrow(run, schema), "copies")
        while summed.agg(F.max("part")).first()[0]:
            more = written(summed.groupBy("block", F.expr(f"part div {FAN_IN}").alias("group")).applyInPandas(add, schema), "copies")
            dropped(summed)
            summed = more
        blocks = sorted(summed.collect(), key=lambda r: r["block"])  # one copy of the model, below 1 MB
        dropped(summed)
        if blocks:
            flat = np.concatenate([np.array(r["p"], np.float64) / r["seen"] for r in blocks]).astype(np.float32)
    return flat


class Model:
    """Counts, words, encoded documents and the fitted network."""

    def __init__(self, docs: DataFrame, training: Column, doc: str = "doc_id", text: str = "text"):
        learn = docs.where(training)
        self.counts = written(word_counts(learn, text), "counts")
        self.n_docs = learn.count()
        types, total = self.counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.n = total + self.n_docs
        common = commonest(self.counts)
        self.words = Words(common)
        in_net = self.words.in_net
        slot_counts = np.zeros(CLASSES * PER_CLASS)
        slot_counts[END + 1 : END + 1 + in_net] = [c for _, c in common[:in_net]]
        others = total - sum(c for _, c in common[:in_net])
        slot_counts[OTHER], slot_counts[END] = max(others, 1), max(self.n_docs, 1)
        self.log_other = float(np.log10(others + 0.1 * (types - in_net) + 0.1))
        self.log_base = float(np.log10(self.n + 0.1 * (types + (self.n_docs > 0) + 1)))
        self.log_end = float(np.log10(self.n_docs + 0.1))
        self.rows = encoded(docs, self.words, self.log_other, training, doc, text)
        self.flat = train(self.rows.where("learn").select("row", "slots"), slot_counts)


def log_likelihood(net: Gru, target: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each sequence of slots, its state carried through the whole of it."""
    lane, start, length = lanes(sizes, LANES)
    before, fresh = _stream(target, sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(target)) - np.repeat(np.cumsum(sizes) - sizes - start, sizes)
    shape = (int(length[0]) if len(length) else 0, len(length))
    goal, ids, of, keep = np.zeros(shape, np.int16), np.full(shape, END, np.int16), np.full(shape, -1, np.int32), np.ones(shape, np.float32)
    at = (step, lane[doc])
    goal[at], ids[at], of[at], keep[at] = target, before, doc, ~fresh
    table, sums = net.table(), np.zeros(len(sizes))
    h = np.zeros((shape[1], HIDDEN), np.float32)
    for a in range(0, shape[0], SCORE_WINDOW):
        w, live = slice(a, a + SCORE_WINDOW), int(np.searchsorted(-length, -a, "left"))
        hs, h[:live] = net.states(table[ids[w, :live]], keep[w, :live, None], h[:live])
        own = of[w, :live].ravel()
        used = np.flatnonzero(own >= 0)
        logp, _ = net.output(hs.reshape(-1, HIDDEN)[used], goal[w, :live].ravel()[used])
        sums += np.bincount(own[used], logp, len(sums))
    return sums


def score(docs: DataFrame, training: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Null text is empty: it has the end token only. Rows are never merged, so repeated rows
    and ids keep their own scores; other columns don't matter. Without any training text
    all tokens are unseen and the network is the untrained one. An empty table gives no rows.
    """
    return scored(Model(docs, training, doc, text))


def scored(model: Model) -> DataFrame:
    """The scores of the model's rows."""
    shared = model.rows.sparkSession.sparkContext.broadcast(model.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Gru(shared.value)
        for batch in batches:
            for part in slices(batch, "slots", 3 << 20):
                net_log = log_likelihood(net, *_sequences(part)) / np.log(10)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(net_log)], names=[*keep, "net_log"])

    keep = ["row", "doc_id", "n_tokens", "n_common", "common_log", "other_log"]
    out = model.rows.select(*keep, "slots").mapInArrow(run, "row long, doc_id long, n_tokens long, n_common long, common_log double, other_log double, net_log double")
    rare = model.rows.select("row", F.explode("rare").alias("token")).join(model.counts, "token", "left")
    by_row = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("rare_log"), F.count("n").alias("n_rare"))
    out = out.join(by_row, "row", "left").fillna(0, ["rare_log", "n_rare"])
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("n_common") + F.col("n_rare") + F.lit(1 if model.n_docs else 0)).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("common_log") + F.col("rare_log") + F.lit(model.log_end) - F.col("n_tokens") * F.lit(model.log_base)).alias("base_score"),
        (F.col("net_log") + F.col("other_log") + F.col("rare_log")).alias("score"),
    )


def held_out(doc: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op6_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
