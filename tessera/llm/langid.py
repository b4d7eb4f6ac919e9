"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased and every run of other characters than letters is one space. Each
language has a 4-gram model: the highest order from counts over its training text, the
lower orders from the number of different characters seen before, with a discount for
each order from the counts of counts. A text goes to the language with the lowest
cross-entropy per character; a bound from training rows that the model hasn't read tells
texts that no language explains.

The model is stored as sorted arrays of 64-bit keys: for each order one array of the
n-grams of all languages with a row of log probabilities, and one of the contexts with a
row of backoff weights. A model of more than `MODEL_CELLS` probabilities isn't sent to the
tasks: the same probabilities are then joined to the distinct n-grams of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import ROW, dropped, slices, with_rows, without_rows, written

ORDER = 4
#: Most n-grams x languages of a model that is sent to the tasks; a larger one is joined.
MODEL_CELLS = 20_000_000
#: One training row in so many is kept for calibration.
CALIBRATION = 10

_LETTER = np.array([chr(i).isalpha() for i in range(65536)])


def codes(text: str) -> np.ndarray:
    """Character codes of the normalised text, with a space at both ends.

    Letters beyond the basic plane are folded into its private area, which holds no letters.
    """
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _LETTER[np.minimum(raw, 65535)]
    far = np.flatnonzero(raw > 65535)
    if len(far):
        letter[far] = [chr(c).isalpha() for c in raw[far]]
        raw[far] = 0xE000 + raw[far] % 6400
    x = np.where(letter, raw, 32)
    x = x[letter | np.r_[True, letter[:-1]]] if len(x) else x
    x = x[1:] if len(x) and x[0] == 32 else x
    x = x[:-1] if len(x) and x[-1] == 32 else x
    return np.concatenate([[32], x, [32]]).astype(np.int64)


def padded(text: str) -> np.ndarray:
    """Codes with further spaces in front, so that every character has a full context."""
    return np.concatenate([np.full(ORDER - 2, 32), codes(text)])


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Keys of all n-grams, 16 bits a character, the last character lowest."""
    key = np.zeros(max(len(x) - n + 1, 0), np.int64)
    for i in range(n):
        key = (key << 16) | x[i : i + len(key)]
    return key


def _uint(x):
    return x.view(np.uint64) if x.dtype == np.int64 else x


def counted(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): how often each 4-gram stands in a language's text, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts):
            k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return k, np.bincount(at, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, text):
                own: dict[str, list] = {}
                for t, g in zip(part.column(text).to_pylist(), part.column(lang).to_pylist(), strict=True):
                    if t and g is not None:
                        own.setdefault(g, []).append(grams(padded(t), ORDER))
                for g, keys in own.items():
                    held.setdefault(g, []).append(np.unique(np.concatenate(keys), return_counts=True))
                    if len(held[g]) > 8:
                        held[g] = [merged(held[g])]
            for g in [g for g, parts in held.items() if sum(len(p[0]) for p in parts) > 2_000_000]:
                k, n = merged(held.pop(g))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(k)), pa.array(k), pa.array(n)], names=["lang", "gram", "n"])
        for g, parts in held.items():
            k, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(k)), pa.array(k), pa.array(n)], names=["lang", "gram", "n"])

    rows = docs.select(lang, text).mapInArrow(run, "lang string, gram long, n long")
    total = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return total


def _mask(n: int) -> int:
    return (1 << (16 * n)) - 1


class Model:
    """Counts of all orders, in Spark, and what is small: languages and discounts.

    levels[n] is a written table (lang int, gram, n): raw counts at the top, numbers of
    different characters in front below. discount[n] has one value for each language.
    """

    def __init__(self, counts: DataFrame):
        spark = counts.sparkSession
        named = written(counts, "grams")
        self.langs = sorted(r[0] for r in named.select("lang").distinct().collect())  # one row for each language
        number = F.broadcast(spark.createDataFrame([(g, i) for i, g in enumerate(self.langs)], "lang string, number int"))
        self.levels = {ORDER: named.join(number, "lang").select(F.col("number").alias("lang"), "gram", "n")}
        for n in range(ORDER - 1, 0, -1):
            lower = self.levels[n + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(_mask(n))).alias("gram")).agg(F.count("*").alias("n"))
            self.levels[n] = written(lower, f"grams{n}")
        self.discount, self.rows = {}, 0
        for n, level in self.levels.items():
            once = level.groupBy("lang").agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()
            d = np.full(len(self.langs), 0.5)
            for r in once:
                self.rows += r["rows"]
                if r["one"] and r["two"]:
                    d[r["lang"]] = min(max(r["one"] / (r["one"] + 2 * r["two"]), 0.1), 0.95)
            self.discount[n] = d

    def arrays(self, cells: int | None = None) -> Arrays | None:
        """The sorted arrays; None if they would have more cells than may be sent to the tasks."""
        if self.rows * len(self.langs) > (MODEL_CELLS if cells is None else cells):
            return None
        tables = {}
        for n, level in self.levels.items():
            rows = level.toPandas()
            lang, key, count = rows["lang"].to_numpy(), _uint(rows["gram"].to_numpy()), rows["n"].to_numpy(np.float64)
            by = np.lexsort((key, lang))
            cut = np.searchsorted(lang[by], np.arange(len(self.langs) + 1))
            tables[n] = [(key[by[a:b]], count[by[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return Arrays(len(self.langs), tables, self.discount)


class Arrays:
    """The Kneser-Ney models of all languages in sorted arrays."""

    def __init__(self, n_lang: int, orders: dict, discount: dict):
        self.n_lang = n_lang
        self.keys, self.probs, self.contexts, self.backoff = {}, {}, {}, {}
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([k for k, _ in orders[n]]))
            context = (lambda k: k >> np.uint64(16)) if n > 1 else (lambda k: np.zeros(len(k), np.uint64))
            ctx = np.unique(context(keys))
            prob, weight = np.zeros((len(keys), n_lang)), np.ones((len(ctx), n_lang))
            base = self._lower(keys, n) if n > 1 else np.full((len(keys), n_lang), 1 / 65536)
            back_at = np.searchsorted(ctx, context(keys))
            for j, (k, c) in enumerate(orders[n]):
                at = np.searchsorted(ctx, context(k))
                total, kinds = np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx))
                seen = total > 0
                weight[seen, j] = np.minimum(discount[n][j] * kinds[seen] / total[seen], 1.0)
                own = np.zeros(len(keys))
                own[np.searchsorted(keys, k)] = np.maximum(c - discount[n][j], 0) / total[at]
                prob[:, j] = own + weight[back_at, j] * base[:, j]
            self.keys[n], self.probs[n], self.contexts[n], self.backoff[n] = keys, prob, ctx, weight
        self.logs = {n: np.log2(p).astype(np.float32) for n, p in self.probs.items()}
        self.log_back = {n: np.log2(w).astype(np.float32) for n, w in self.backoff.items()}

    def _lower(self, keys, n):
        """Probabilities of the last character after one character of context less."""
        return self.probs[n - 1][np.searchsorted(self.keys[n - 1], keys & np.uint64(_mask(n - 1)))]

    def __getstate__(self):
        """Tasks need the logarithms only."""
        return {k: v for k, v in self.__dict__.items() if k not in ("probs", "backoff")}

    @staticmethod
    def _find(table, keys):
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def log2(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """log2 probability of each n-gram's last character for every language."""
        at, found = self._find(self.keys[n], keys)
        out = self.logs[n][at]
        miss = np.flatnonzero(~found)
        if len(miss):
            k = keys[miss]
            if n == 1:
                out[miss] = self.log_back[1][0] - 16
            else:
                c, known = self._find(self.contexts[n], k >> np.uint64(16))
                back = np.where(known[:, None], self.log_back[n][c], np.float32(0))
                out[miss] = back + self.log2(k & np.uint64(_mask(n - 1)), n - 1)
        return out

    def entropy(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per character (texts x languages), and the numbers of characters."""
        keys = [_uint(grams(x, ORDER)) for x in texts]
        size = np.array([len(k) for k in keys])
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        sums = np.add.reduceat(self.log2(flat), starts, axis=0) if len(flat) else np.zeros((0, self.n_lang))
        return -sums / size[:, None], size


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The model of all languages in docs; None without any."""
    model = Model(counted(docs, text, lang))
    return model if model.langs else None


def _by_arrays(docs: DataFrame, arrays: Arrays, text: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(arrays)
    keep = [c for c in docs.columns if c != text]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                x = [padded(t or "") for t in part.column(text).to_pylist()]
                ok = np.array([bool(np.any(c != 32)) for c in x], bool)
                h, size = m.entropy([c for c, k in zip(x, ok, strict=True) if k])
                sizes = np.zeros(len(x), np.int64)
                sizes[ok] = size
                at = np.concatenate([[0], np.cumsum(ok)]).astype(np.int32) * np.int32(m.n_lang)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(at), pa.array(h.ravel(), pa.float64())), pa.array(sizes)], names=[*keep, "bits", "size"])

    return docs.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + ["bits array<double>", "size long"]))


def _by_joins(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """The same from the tables of counts: joined to the distinct n-grams of the documents, order by order."""
    rows = with_rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                x = [padded(t or "") for t in part.column(text).to_pylist()]
                found = [np.unique(grams(c, ORDER), return_counts=True) if np.any(c != 32) else (np.zeros(0, np.int64),) * 2 for c in x]
                take = pa.array(np.repeat(np.arange(len(x)), [len(k) for k, _ in found]))
                yield pa.RecordBatch.from_arrays([part.column(ROW).take(take), *[pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)]], names=[ROW, "gram", "m"])

    own = written(rows.select(ROW, text).mapInArrow(run, f"{ROW} long, gram long, m long"), "own-grams")
    n_lang = len(model.langs)
    wide = lambda c, default: F.array(*[F.coalesce(F.max(F.when(F.col("lang") == i, F.col(c))), F.lit(default)) for i in range(n_lang)]).alias(c)
    needed = {ORDER: own.select("gram").distinct()}
    for n in range(ORDER - 1, 0, -1):
        needed[n] = needed[n + 1].select(F.col("gram").bitwiseAND(F.lit(_mask(n))).alias("gram")).distinct()
    lower = None
    for n in range(1, ORDER + 1):
        ctx = (F.shiftrightunsigned("gram", 16) if n > 1 else F.lit(0).cast("long")).alias("ctx")
        level = model.levels[n].withColumn("ctx", ctx)
        d = F.element_at(F.array(*[F.lit(float(x)) for x in model.discount[n]]), F.col("lang") + 1)
        sums = written(level.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.least(F.first(d) * F.count("*") / F.sum("n"), F.lit(1.0)).alias("weight")), "contexts")
        seen = level.join(sums, ["lang", "ctx"]).withColumn("own", F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")).groupBy("gram").agg(wide("own", 0.0))
        weights = sums.groupBy("ctx").agg(wide("weight", 1.0))
        each = needed[n].withColumn("ctx", ctx).join(seen, "gram", "left").join(weights, "ctx", "left")
        if n > 1:
            each = each.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(_mask(n - 1)))).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("base")), "suffix")
        else:
            each = each.withColumn("base", F.array(*[F.lit(1 / 65536)] * n_lang))
        zeros, ones = F.array(*[F.lit(0.0)] * n_lang), F.array(*[F.lit(1.0)] * n_lang)
        back = F.zip_with(F.coalesce("weight", ones), "base", lambda a, b: a * b)
        lower = written(each.select("gram", F.zip_with(F.coalesce("own", zeros), back, lambda a, b: a + b).alias("p")), "probabilities")
    logs = own.join(lower, "gram").groupBy(ROW).agg(F.sum("m").alias("size"), *[F.sum(F.col("m") * F.log2(F.col("p")[i])).alias(f"b{i}") for i in range(n_lang)])
    bits = F.when(F.col("size").isNull(), F.array().cast("array<double>")).otherwise(F.array(*[-F.col(f"b{i}") / F.col("size") for i in range(n_lang)]))
    own = [f"`{c}`" for c in rows.columns if c != text]
    return without_rows(rows.select(*own).join(logs, ROW, "left").select(*own, bits.alias("bits"), F.coalesce("size", F.lit(0)).alias("size")))


def entropies(docs: DataFrame, model: Model, text: str = "text", cells: int | None = None) -> DataFrame:
    """docs without the text, with bits array<double> (by language; empty without letters) and size (characters)."""
    arrays = model.arrays(cells)
    return _by_joins(docs, model, text) if arrays is None else _by_arrays(docs, arrays, text)


def identify(docs: DataFrame, model: Model | None, reject: dict[str, tuple[float, float]] | None = None, doc: str = "doc_id", text: str = "text", cells: int | None = None) -> DataFrame:
    """Per row: doc_id, lang_pred, score, bits (per character), rejected.

    `und` with score 0 for null and for texts without letters (and for all without a
    model); of languages that fit equally well the first by name. The score is the best
    language's posterior from bits per character, weighted by up to 50 characters. A text
    is rejected if its bits exceed its language's bound mean + spread / sqrt(characters); a
    rejected text keeps its nearest language. Texts of any length are read whole; rows are
    never merged, so repeated rows and ids keep their own result; other columns don't
    matter, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(False).alias("rejected"))
    h = entropies(rows, model, "text", cells)
    known = F.col("size") > 0
    least = F.array_min("bits")
    posterior = 1 / F.aggregate("bits", F.lit(0.0), lambda a, b: a + F.pow(F.lit(2.0), (least - b) * F.least(F.col("size"), F.lit(50))))
    best = F.element_at(F.array(*[F.lit(g) for g in model.langs]), F.array_position("bits", least).cast("int"))
    out = h.select("doc_id", F.when(known, best).otherwise("und").alias("lang_pred"), F.when(known, posterior).otherwise(0.0).alias("score"), F.when(known, least).alias("bits"), "size")
    bound = F.lit(None).cast("double")
    for g, (mean, spread) in (reject or {}).items():
        bound = F.when(F.col("lang_pred") == g, F.lit(mean) + F.lit(spread) / F.sqrt("size")).otherwise(bound)
    return out.withColumn("rejected", F.coalesce(F.col("bits") > bound, F.lit(False))).drop("size")


def calibrate(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> dict[str, tuple[float, float]]:
    """Rejection bounds (mean, spread) that 99.5 % of a language's rows in docs stay below; docs weren't trained on."""
    number = F.array_position(F.array(*[F.lit(g) for g in model.langs]), F.col(lang)).cast("int")
    own = entropies(docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")), model).where("size > 0")
    own = written(own.where(number > 0).select("lang", F.element_at("bits", number).alias("bits"), "size"), "calibration")
    means = own.groupBy("lang").agg(F.percentile_approx("bits", 0.5, 10_000).alias("mean"))  # one row for each language
    over = (F.col("bits") - F.col("mean")) * F.sqrt("size")
    rows = own.join(F.broadcast(means), "lang").groupBy("lang", "mean").agg(F.percentile_approx(over, 0.995, 10_000).alias("spread")).collect()
    dropped(own)
    return {r["lang"]: (r["mean"], max(r["spread"], 1.0)) for r in rows}


def fitted(known: DataFrame, text: str = "text", lang: str = "lang") -> tuple[Model | None, dict[str, tuple[float, float]]]:
    """A model and its rejection bounds from rows with text and language.

    One row in CALIBRATION is kept from the model, for the bounds, unless its language has
    no other rows.
    """
    kept = F.pmod(F.xxhash64(text, F.lit(7)), F.lit(CALIBRATION)) == 0
    seen = [r[0] for r in known.where(~kept).select(lang).distinct().collect()]  # one row for each language
    model = train(known.where(~kept | ~F.col(lang).isin(seen)), text, lang)
    return model, calibrate(known.where(kept), model, text, lang) if model else {}


def learnt(doc: str = "doc_id") -> Column:
    return ~F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model, bounds = fitted(docs.where(learnt() & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    out = identify(docs, model, bounds)
    return out.select("doc_id", (~learnt()).alias("held_out"), "lang_pred", "score", "bits", "rejected")
