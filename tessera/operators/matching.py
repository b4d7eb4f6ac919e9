"""Near pairs of whole texts, greedy one-to-one matching of scored pairs, and word differences."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .relational import checkpointed, stored

#: Words of a shingle.
WIDTH = 5


def _trimmed(a, b) -> tuple[int, int]:
    """Lengths of the common start and, in the rest, of the common end of two sequences."""
    most = min(len(a), len(b))

    def longest(same) -> int:
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(mid) else (low, mid - 1)
        return low

    start = longest(lambda n: a[:n] == b[:n])
    most -= start
    return start, longest(lambda n: n == 0 or a[-n:] == b[-n:])


#: Texts of more characters are compared within a band first, of so many edits to begin with.
LONG, BAND = 4096, 256


def _banded(a: str, b: str, most: int) -> int | None:
    """Edit distance if it is at most `most`, else None; a isn't shorter than b, and is longer than `most`.

    As in _distance(), but of each column only the rows within `most` of the diagonal are kept:
    the vectors move down by a row at each step.
    """
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    blocks = len(a) // width + 2
    at: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        if c not in at:
            at[c] = [0] * blocks
        at[c][i // width] |= 1 << i % width
    none = [0] * blocks
    up, down, score = full ^ ((1 << (width - most - 1)) - 1), 0, most
    # The score may still fall in the last row, not before it.
    turn, last = len(a) - most, top >> 1
    worst = most + len(b) - turn
    for j, c in enumerate(b):
        own, begin = at.get(c, none), j + most + 1 - width
        block, bit = divmod(max(begin, 0), width)
        here = own[0] << -begin & full if begin < 0 else (own[block] >> bit | own[block + 1] << (width - bit)) & full
        level = (((here & up) + up) ^ up) & full | here | down
        more, less = down | (full & ~(level | up)), level & up
        if j < turn:
            score += not level & top
        else:
            score += 1 if more & last else -1 if less & last else 0
            last >>= 1
        if score > worst:
            return None
        up, down = less | (full & ~(level >> 1 | more)), level >> 1 & more
    return score if score <= most else None


def _distance(a: str, b: str) -> int:
    """Edit distance; the columns of the table are bit vectors in integers, so memory is linear."""
    start, end = _trimmed(a, b)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    most = BAND
    while len(a) > LONG and 4 * most < len(a):
        near = _banded(a, b, most) if len(a) - len(b) <= most else None
        if near is not None:
            return near
        most *= 4
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        here = at.get(c, 0)
        steps = (((here & up) + up) ^ up) | here
        more, less = down | (full & ~(steps | up)), up & steps
        score += 1 if more & top else -1 if less & top else 0
        more, less = (more << 1) | 1, less << 1
        level = here | down
        up, down = (less | ~(level | more)) & full, more & level & full
    return score


#: Words of bit vectors that are moved side by side, and words of the first texts' masks that are kept at once.
LANES, MASKS = 8192, 4_000_000


def _filled(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of pairs of texts that aren't empty.

    Each pair is a lane and each 64 characters of its first text a word of bits. At a step, a
    word takes the character of the second text after that of the word below it, whose
    carry of the step before it needs: so all words of all lanes move at once.
    """
    code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    place = {t: i for i, t in enumerate(dict.fromkeys(a))}
    firsts = [code(t) for t in place]
    sizes = np.array([len(c) for c in firsts])
    letters, at = np.unique(np.concatenate(firsts), return_inverse=True)
    # One more letter stands for those that no first text has, and for none: its masks are empty.
    width, words, lanes = len(letters) + 1, (int(sizes.max()) + 63) // 64, len(a)
    masks = np.zeros((words, len(firsts) * width), dtype=np.uint64)
    bit = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    np.add.at(masks, (bit >> 6, np.repeat(np.arange(len(firsts)) * width, sizes) + at), np.uint64(1) << (bit & 63).astype(np.uint64))
    base = np.array([place[t] * width for t in a]) + np.arange(words)[:, None] * masks.shape[1]
    masks = masks.ravel()
    lengths, last = np.array([len(t) for t in b]), np.array([len(t) - 1 for t in a])
    steps = int(lengths.max()) + words - 1
    seconds = np.full((steps + words, lanes), width - 1)
    for i, t in enumerate(b):
        c = code(t)
        k = np.minimum(np.searchsorted(letters, c), len(letters) - 1)
        seconds[words : words + len(c), i] = np.where(letters[k] == c, k, width - 1)
    one, top, word = np.uint64(1), np.uint64(63), (last >> 6) * lanes + np.arange(lanes)
    up, down = np.full((words, lanes), ~np.uint64(0)), np.zeros((words, lanes), dtype=np.uint64)
    plus, minus = np.zeros_like(down), np.zeros_like(down)
    plus[0] = 1
    rises, falls = np.empty((2, steps, lanes), dtype=np.uint64)
    for j in range(steps):
        here = masks.take(base + seconds[j + words : j : -1])
        level = here | down
        here |= minus
        add = here & up
        add += up
        add ^= up
        add |= here
        less = up & add
        more = np.invert(np.bitwise_or(add, up, out=add), out=add)
        more |= down
        more.take(word, out=rises[j])
        less.take(word, out=falls[j])
        over, under = more[:-1] >> top, less[:-1] >> top
        more <<= one
        more |= plus
        less <<= one
        less |= minus
        plus[1:], minus[1:] = over, under
        np.bitwise_and(more, level, out=down)
        level |= more
        np.bitwise_or(less, np.invert(level, out=level), out=up)
    low = (last & 63).astype(np.uint64)
    change = ((rises >> low) & one).astype(np.int64) - ((falls >> low) & one).astype(np.int64)
    column = np.arange(steps)[:, None] - (last >> 6)
    return last + 1 + np.where((column >= 0) & (column < lengths), change, 0).sum(axis=0)


def _near_diagonal(a: list[str], b: list[str], words: int) -> np.ndarray:
    """Edit distances of pairs of texts, none longer in b than in a; those above 32 * words - 1 are only told to be more.

    Each pair is a lane. Of each column only the rows within that many of the diagonal are kept, as
    `words` words of bits that move down by a row at each step. The place where a and b
    end is on one diagonal, the same bit at all steps: the distance grows where that bit isn't level.
    """
    most = 32 * words - 1
    code = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    place = {t: i for i, t in enumerate(dict.fromkeys(a))}
    firsts = [code(t) for t in place]
    sizes = np.array([len(c) for c in firsts])
    letters, at = np.unique(np.concatenate(firsts), return_inverse=True)
    # One more letter stands for those that no first text has, and for none: its masks are empty.
    width, lanes = len(letters) + 1, len(a)
    masks = np.zeros((int(sizes.max()) // 64 + 1 + 3 * words, len(firsts) * width), dtype=np.uint64)
    bit = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Blocks before the first row and after the last one are empty.
    np.add.at(masks, ((bit >> 6) + words, np.repeat(np.arange(len(firsts)) * width, sizes) + at), np.uint64(1) << (bit & 63).astype(np.uint64))
    base, lengths = np.array([place[t] * width for t in a]), np.array([len(t) for t in b])
    skew = np.array([len(t) for t in a]) - lengths
    seconds = np.full((int(lengths.max()), lanes), width - 1)
    for i, t in enumerate(b):
        c = code(t)
        k = np.minimum(np.searchsorted(letters, c), len(letters) - 1)
        seconds[: len(c), i] = np.where(letters[k] == c, k, width - 1)
    seconds += base
    one, last = np.uint64(1), most + 1 + skew
    end, low = (last >> 6) * lanes + np.arange(lanes), (last & 63).astype(np.uint64)
    # Rows from the first one on rise by one at the start; it is the bit in the middle.
    up, down = np.zeros((words, lanes), dtype=np.uint64), np.zeros((words, lanes), dtype=np.uint64)
    for i in range(words):
        up[i] = (((1 << 64 * words) - (1 << (most + 1))) >> 64 * i) & ((1 << 64) - 1)
    score, total = skew.copy(), np.empty_like(up)
    for j in range(len(seconds)):
        block, shift = divmod(j - most - 1, 64)
        here = masks[block + words : block + 2 * words + 1].take(seconds[j], axis=1)
        here = here[:-1] >> np.uint64(shift) | here[1:] << np.uint64(64 - shift) if shift else here[:-1]
        add = here & up
        carry = np.zeros(lanes, dtype=np.uint64)
        for i in range(words):
            v = add[i] + up[i]
            over = v < up[i]
            v += carry
            over |= v < carry
            total[i], carry = v, over.astype(np.uint64)
        level = (total ^ up) | here | down
        more, less = down | ~(level | up), level & up
        score += ((level.take(end) >> low) & one == 0) & (j < lengths)
        level[:-1] = level[:-1] >> one | level[1:] << np.uint64(63)
        level[-1] >>= one
        up, down = less | ~(level | more), level & more
    return np.where(score <= most, score, most + 1)


#: Texts of at least so many characters are compared near the diagonal first, in bands of so many words.
MIDDLE, BANDS = 512, (4, 12)


def _distances(a: list[str], b: list[str]) -> list[int]:
    """Edit distances of pairs of texts, as _distance() gives them one by one."""
    out, left = [0] * len(a), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x[:32] == y[:32] or x[-32:] == y[-32:]:
            start, end = _trimmed(x, y)
            x, y = x[start : len(x) - end], y[start : len(y) - end]
        if not x or not y:
            out[i] = len(x) + len(y)
        else:
            left.append((len(x), len(y), i, x, y))
    letters = len(set().union(*(p[3] for p in left), *(p[4] for p in left))) + 1
    for words in BANDS:
        most = 32 * words - 1
        some = [p if p[0] >= p[1] else (p[1], p[0], p[2], p[4], p[3]) for p in left if min(p[:2]) >= max(MIDDLE, 4 * most) and abs(p[0] - p[1]) <= most]
        some.sort(key=lambda p: (p[0], p[1], p[2]))
        done = set()
        while some:
            n = max(1, min(LANES // words, MASKS // ((some[-1][0] // 64 + 1 + 3 * words) * letters)))
            part, some = some[-n:], some[:-n]
            for p, d in zip(part, _near_diagonal([p[3] for p in part], [p[4] for p in part], words), strict=True):
                if d <= most:
                    out[p[2]] = int(d)
                    done.add(p[2])
        left = [p for p in left if p[2] not in done]
    left.sort(key=lambda p: ((p[0] + 63) // 64, p[1], p[2]))
    while left:
        # The last one has the most words: so many fit beside it.
        words = (left[-1][0] + 63) // 64
        n = max(1, min(LANES // words, MASKS // (words * letters)))
        part, left = left[-n:], left[:-n]
        for p, d in zip(part, _filled([p[3] for p in part], [p[4] for p in part]), strict=True):
            out[p[2]] = int(d)
    return out


def _similarities(a: list[str], b: list[str]) -> np.ndarray:
    """1 - edit distance / longer length of pairs of texts; two empty ones are alike, an empty one and another aren't."""
    out = np.array([0.0 if x or y else 1.0 for x, y in zip(a, b, strict=True)])
    full = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y]
    for i, d in zip(full, _distances([a[i] for i in full], [b[i] for i in full]), strict=True):
        out[i] = 1 - d / max(len(a[i]), len(b[i]))
    return out


@F.pandas_udf(DoubleType())
def pair_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """similarity() of many pairs of short texts at once; a pair with a null has none."""
    both = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
    out = np.full(len(a), np.nan)
    out[both] = _similarities([a[i] for i in both], [b[i] for i in both])
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def _most_alike(a: list[str], b: list[str]) -> np.ndarray:
    """Upper bounds of _similarities(): a distance is no less than the letters that one text has more of than the other."""
    place = {t: i for i, t in enumerate(dict.fromkeys([*a, *b]))}
    # Letters of one class count together, which only lowers the distance.
    counts = np.array([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 127, minlength=128) for t in place], dtype=np.int32)
    more = counts[[place[t] for t in a]] - counts[[place[t] for t in b]]
    least = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
    longer = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    return np.where(longer > 0, 1 - least / np.maximum(longer, 1), 1.0)


def favourites(pairs: DataFrame, group: str, least: float) -> DataFrame:
    """(group, a, b, score): for each a its most similar b of at least `least`; ties go to the smaller b.

    pairs: (group, a long, b long, x, y) with the texts. Of an a's pairs in a batch the one with the
    highest bound is compared first, then only those whose bound reaches its similarity: mostly one for each a.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, y, b = f["x"].tolist(), f["y"].tolist(), f["b"].to_numpy()
            if not x:
                continue
            own = f.groupby([group, "a"], dropna=False, sort=False).ngroup().to_numpy()
            most, score, best = _most_alike(x, y), np.full(len(f), -1.0), np.full(own.max() + 1, least)
            order = np.lexsort((b, -most, own))
            first = np.zeros(len(f), dtype=bool)
            first[order[np.unique(own[order], return_index=True)[1]]] = True
            for some in (first, ~first):
                now = np.flatnonzero(some & (most >= best[own]))
                score[now] = _similarities([x[i] for i in now], [y[i] for i in now])
                np.maximum.at(best, own[now], score[now])
            order = np.lexsort((b, -score, own))
            top = order[np.unique(own[order], return_index=True)[1]]
            top = top[score[top] >= least]
            yield f.iloc[top][[group, "a", "b"]].assign(score=score[top])

    schema = f"{group} {dict(pairs.dtypes)[group]}, a long, b long, score double"
    each = pairs.select(group, F.col("a").cast("long"), F.col("b").cast("long"), "x", "y").mapInPandas(run, schema)
    top = F.max_by(F.struct("b", "score"), F.struct("score", -F.col("b")))
    return each.groupBy(group, "a").agg(top.alias("t")).select(group, "a", "t.b", "t.score")


def settled(found: DataFrame, group: str) -> DataFrame:
    """Add `sure` to favourites: whether greedy() gives a its favourite for certain.

    So it does up to a group's first a whose favourite is that of an earlier one too; from there on what is left decides.
    """
    twice = F.row_number().over(Window.partitionBy(group, "b").orderBy("a")) > 1
    from_ = F.min(F.when(F.col("_twice"), F.col("a"))).over(Window.partitionBy(group))
    return found.withColumn("_twice", twice).withColumn("_from", from_).withColumn("sure", F.col("_from").isNull() | (F.col("a") < F.col("_from"))).drop("_twice", "_from")


def _whole_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - edit distance / longer length of whole texts that aren't null or empty."""
    a, b = a.tolist(), b.tolist()
    out, short = np.empty(len(a)), [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if max(len(x), len(y)) <= LONG]
    out[short] = _distances([a[i] for i in short], [b[i] for i in short])
    for i in set(range(len(a))).difference(short):
        out[i] = _distance(a[i], b[i])
    return pd.Series(1 - out / np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)]), dtype="float64")


whole_similarity = F.pandas_udf(_whole_similarity, DoubleType())


def scored(pairs: DataFrame) -> DataFrame:
    """Add score: whole_similarity() of x and y, in a step that no filter on it is moved into, where it would be computed again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(score=_whole_similarity(f["x"], f["y"]).to_numpy())

    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField("score", DoubleType())]))


def distinct_texts(docs: DataFrame, group: str) -> DataFrame:
    """(group, doc_id, text): one row, of the smallest id, for equal texts of a group."""
    return docs.groupBy(group, F.sha2("text", 256).alias("digest")).agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("r")).select(group, "r.doc_id", "r.text")


#: Characters that Java's Unicode white space leaves to words, while str.split() cuts there.
OWN_WORDS = "\x1c\x1d\x1e\x1f"
WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters of texts whose words are hashed at once.
AT_ONCE = 2_000_000
#: Popular shingles are told from one in so many documents, in which they occur more than so many times; so many are known at most.
ONE_IN, RARE, MOST_POPULAR = 32, 3, 200_000


def _words(text: str) -> list[str]:
    return WORDS.findall(text) if any(c in text for c in OWN_WORDS) else text.split()


def _shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Of each text the sorted hashes (62 bits) of its distinct 5-word shingles; fewer words make one shingle, no words none."""
    out: list[np.ndarray] = []
    ends = np.cumsum([len(t) for t in texts]) // AT_ONCE
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
        words = [_words(texts[i]) for i in part]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.array([x for w in words for x in w], dtype=object)
        each = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, dtype=np.uint64)
        starts = np.cumsum(sizes) - sizes
        left = np.repeat(starts + sizes, sizes) - np.arange(len(flat))
        h, padded = np.zeros(len(flat), dtype=np.uint64), np.concatenate([each, np.zeros(WIDTH, dtype=np.uint64)])
        for k in range(WIDTH):
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, padded[k : k + len(flat)], np.uint64(0))
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
        h = (h >> np.uint64(2)).astype(np.int64)
        out += [np.unique(h[a : a + max(n - WIDTH + 1, min(n, 1))]) for a, n in zip(starts, sizes, strict=True)]
    return out


def _popular(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many documents have, told from a part of them: they only set an order, and any order finds the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, dtype=np.int64), *_shingle_sets(t["text"].to_pylist())]))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ONE_IN)) == 0).select("text").mapInArrow(run, "h long")
    often = some.groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") > RARE)
    return np.sort(often.orderBy(F.desc("df"), "h").limit(MOST_POPULAR).toPandas()["h"].to_numpy(dtype=np.int64))


def _prefixes(docs: DataFrame, group: str, least: float) -> DataFrame:
    """(group, doc_id, mark, n, prefix): one row, of the smallest id, for equal texts of a group that have words.

    mark: hash of the text; n: its shingles; prefix: the first n - ceil(least * n) + 1 of them in one
    order for all texts, popular ones last, as ascending numbers.
    """
    popular = _popular(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, prefix = [], []
            for h in _shingle_sets(t["text"].to_pylist()):
                known = np.zeros(len(h), dtype=bool)
                if len(popular):
                    known = popular[np.minimum(np.searchsorted(popular, h), len(popular) - 1)] == h
                n.append(len(h))
                prefix.append(np.concatenate([h[~known], h[known] | 1 << 62])[: len(h) - math.ceil(len(h) * least - 1e-9) + 1])
            ends = np.cumsum([0, *map(len, prefix)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *prefix])))
            yield pa.RecordBatch.from_arrays([*(t[c] for c in (group, "doc_id", "mark", "digest")), pa.array(n, pa.int32()), lists], [*kept, "n", "prefix"])

    kept = [group, "doc_id", "mark", "digest"]
    each = docs.select(group, "doc_id", F.xxhash64("text").alias("mark"), F.sha2("text", 256).alias("digest"), "text")
    types = ", ".join(f"`{c}` {dict(each.dtypes)[c]}" for c in kept)
    made = each.mapInArrow(run, f"{types}, n int, prefix array<long>").where("n > 0")
    first = made.groupBy(group, "digest").agg(F.min_by(F.struct("doc_id", "mark", "n", "prefix"), "doc_id").alias("r"))
    return first.select(group, "r.*")


def _overlap(n: str, m: str, least: float) -> Column:
    """Shingles that sets of n and m have in common at least, if they are similar enough."""
    return F.ceil((F.col(n) + F.col(m)) * (least / (1 + least)) - 1e-9)


def near_texts(docs: DataFrame, group: str, least: float = 0.75, only: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """(group, a, b, x, y): ids a < b and texts of different texts of a group whose shingle sets have at least this Jaccard similarity.

    docs: (group, doc_id, text); equal texts of a group count once, under the smallest id. A pair that is
    similar enough shares one of the n - ceil(least * n) + 1 first shingles of each side in any order
    common to all, so only these are shuffled; where both prefixes are known they may differ no more
    than whole sets may. Only texts of pairs that are left are fetched, and compared in full. Texts
    without words are in no pair. only: a filter of pairs (group, a, b and more), before texts are fetched.
    """
    docs = docs.where(F.col(group).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sets = stored(_prefixes(docs, group, least))
    # Dealt before both sides are named, so that one shuffle serves both.
    each = sets.select("doc_id", "n", group, F.posexplode("prefix").alias("i", "h")).select(F.xxhash64(group, "h").alias("h"), "doc_id", "n", "i").repartition("h")
    x, y = each.withColumnRenamed("doc_id", "a"), each.select("h", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))
    fits = (F.col("a") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * least - 1e-9)
    # What comes before the first common shingle isn't common; all sides grow with the documents, so none is to be broadcast.
    ahead = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= _overlap("n", "m", least)
    met = x.join(y.hint("merge"), "h").where(fits & ahead).select("a", "b").distinct()
    by_id = sets.repartition("doc_id")
    side = lambda a, n, p, mark: by_id.select(group, F.col("doc_id").alias(a), F.col("n").alias(n), F.col("prefix").alias(p), F.col("mark").alias(mark))
    both = met.join(side("a", "n", "p", "mark_a").hint("merge"), "a").join(side("b", "m", "q", "mark_b").withColumnRenamed(group, "_group").hint("merge"), "b").where(F.col(group) == F.col("_group"))
    # Up to the lesser of both ends the prefixes hold all of both sets.
    end = F.least(F.element_at("p", -1), F.element_at("q", -1))
    within = F.size(F.filter("p", lambda v: v <= end)) + F.size(F.filter("q", lambda v: v <= end))
    apart = within - 2 * F.size(F.array_intersect("p", "q"))
    close = both.where(apart <= F.col("n") + F.col("m") - 2 * _overlap("n", "m", least)).select(group, "a", "mark_a", "b", "mark_b")
    pairs = stored(only(close).select(*close.columns))
    ids = pairs.select(group, F.col("a").alias("doc_id"), F.col("mark_a").alias("mark")).union(pairs.select(group, "b", "mark_b")).distinct()
    keys = [group, "doc_id", "mark"]
    # The ids are few, so that Spark may broadcast them and leave the texts where they are.
    texts = stored(docs.withColumn("mark", F.xxhash64("text")).join(stored(ids), keys, "left_semi").groupBy(*keys).agg(F.first("text").alias("text")))
    own = lambda a, t: texts.select(group, F.col("doc_id").alias(a), F.col("mark").alias(f"mark_{a}"), F.col("text").alias(t)).hint("merge")
    found = pairs.join(own("a", "x"), [group, "a", "mark_a"]).join(own("b", "y"), [group, "b", "mark_b"]).select(group, "a", "b", "x", "y")

    def alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            place = {t: i for i, t in enumerate(dict.fromkeys([*f["x"], *f["y"]]))}
            each = _shingle_sets(list(place))
            sides = [(each[place[x]], each[place[y]]) for x, y in zip(f["x"], f["y"], strict=True)]
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sides], dtype=np.int64)
            either = np.array([len(x) + len(y) for x, y in sides], dtype=np.int64) - common
            yield f[common >= either * least - 1e-9]

    return found.mapInPandas(alike, found.schema)


def near_pairs(docs: DataFrame, group: str, least: float = 0.75) -> DataFrame:
    """(group, a, b): the ids of near_texts()."""
    return near_texts(docs, group, least).select(group, "a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach. pairs: (a, b)."""
    edges = checkpointed(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        far = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = checkpointed(labels.join(near, "id").join(far, "component").select("id", F.least("near", "far", "component").alias("component"), F.col("component").alias("old")))
        labels = new.select("id", "component")
        if new.where("component <> old").isEmpty():
            return labels


def greedy(pairs: DataFrame, group: str, least: float) -> DataFrame:
    """(group, a, b, score): every a in order takes its best b not yet taken; ties go to the smaller b.

    pairs: (group, a long, b long, score double), and optionally `pass` int: then all of one pass comes
    before the next, and what is matched stays so. Only scored pairs come to the task of a group, not
    texts, sorted and read in batches; the order within a group makes the matching sequential.
    """
    order = ([F.col("pass")] if "pass" in pairs.columns else []) + [F.col("a"), F.desc("score"), F.col("b")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used_a, used_b = (), set(), set()
        for f in frames:
            keep = []
            for g, a, b in zip(f[group], f["a"], f["b"], strict=True):
                if now != (g,) and not (g is None and now == (None,)):
                    now, used_a, used_b = (g,), set(), set()
                fresh = a not in used_a and b not in used_b
                if fresh:
                    used_a.add(a)
                    used_b.add(b)
                keep.append(fresh)
            yield f[keep]

    schema = f"{group} {dict(pairs.dtypes)[group]}, a long, b long, score double"
    dealt = pairs.where(F.col("score") >= least).repartition(group).sortWithinPartitions(group, *order)
    return dealt.select(group, "a", "b", "score").mapInPandas(run, schema)


#: Cells of paths that are kept at once; beyond it a comparison is cut in two at the middle of a shortest path.
MOST_CELLS = 2_000_000


def _short_steps(a: list[str], b: list[str], most: int) -> list[tuple[int, int]] | None:
    """A shortest edit script by furthest-reaching paths, or None if these take more than `most` cells."""
    n, m = len(a), len(b)
    reach, trail, cells = {1: 0}, [], 0
    for d in range(n + m + 1):
        cells += d + 1
        if cells > most:
            return None
        row = array("q", bytes(8 * (d + 1)))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = row[(k + d) // 2] = x
            if x >= n and x - k >= m:
                break
        trail.append(row)
        if x >= n and x - k >= m:
            break
    out, x, y = [], n, m
    for d in range(len(trail) - 1, 0, -1):
        k, before = x - y, trail[d - 1]
        seen = lambda q: before[(q + d - 1) // 2]  # noqa: B023, E731
        add = k == -d or (k != d and seen(k - 1) < seen(k + 1))
        from_k = k + 1 if add else k - 1
        px = seen(from_k)
        py = px - from_k
        while x > px and y > py and (x > px + (not add) or y > py + add):
            x, y = x - 1, y - 1
            out.append((0, x))
        out.append((1, py) if add else (-1, px))
        x, y = px, py
    out += [(0, i) for i in range(x - 1, -1, -1)]
    return out[::-1]


def _middle(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(x, y, length) of a run of equal tokens, possibly empty, in the middle of a shortest path: paths from both ends meet there."""
    n, m = len(a), len(b)
    skew = n - m
    ahead, behind = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for mine, other, forward in ((ahead, behind, True), (behind, ahead, False)):
            for k in range(-d, d + 1, 2):
                x = mine[k + 1] if k == -d or (k != d and mine[k - 1] < mine[k + 1]) else mine[k - 1] + 1
                y, start = x - k, x
                while x < n and y < m and (a[x] == b[y] if forward else a[n - 1 - x] == b[m - 1 - y]):
                    x, y = x + 1, y + 1
                mine[k] = x
                reach = d - 1 if forward else d
                if (skew % 2 == 1) == forward and abs(skew - k) <= reach and x + other[skew - k] >= n:
                    return (start, start - k, x - start) if forward else (n - x, m - y, x - start)
    raise AssertionError("paths from both ends meet")


def _steps(a: list[str], b: list[str], most: int = MOST_CELLS) -> list[tuple[int, int]]:
    """A shortest edit script: (-1, i) drops a[i], (1, j) puts in b[j], (0, i) keeps a[i].

    Time grows with length times edits, memory with the length: scripts of many edits are
    put together from both sides of a middle.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a[a0:a1] == b[b0:b1]:
            out += [(0, i) for i in range(a0, a1)]
            continue
        if a0 == a1 or b0 == b1:
            out += [(-1, i) for i in range(a0, a1)] + [(1, j) for j in range(b0, b1)]
            continue
        # Up to two edits are always found at once, so that each half has fewer edits than the whole.
        own = _short_steps(a[a0:a1], b[b0:b1], max(most, 6))
        if own is not None:
            out += [(k, i + (b0 if k > 0 else a0)) for k, i in own]
            continue
        x, y, same = _middle(a[a0:a1], b[b0:b1])
        # The run itself is a pair of equal slices; the last one pushed comes first.
        todo += [(a0 + x + same, a1, b0 + y + same, b1), (a0 + x, a0 + x + same, b0 + y, b0 + y + same), (a0, a0 + x, b0, b0 + y)]
    return out


def _script(a: list[str], b: list[str]) -> list[tuple[str, str, str]]:
    """Edits between two token lists: (type, before, after); neighbouring drops and additions are one modification."""
    start, end = _trimmed(a, b)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    out, gone, new = [], [], []
    for kind, i in [*_steps(a, b), (0, -1)]:
        if kind < 0:
            gone.append(a[i])
        elif kind > 0:
            new.append(b[i])
        elif gone or new:
            out.append(("modification" if gone and new else "deletion" if gone else "addition", " ".join(gone), " ".join(new)))
            gone, new = [], []
    return out


def word_changes(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Add changes array<struct<type,before,after>> of the words of two columns; equal rows skip the comparison."""
    change = StructType([StructField(n, StringType()) for n in ("type", "before", "after")])
    schema = StructType([*pairs.schema.fields, StructField("changes", ArrayType(change))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["changes"] = [[] if x == y else [dict(zip(("type", "before", "after"), c, strict=True)) for c in _script((x or "").split(), (y or "").split())] for x, y in zip(f[before], f[after], strict=True)]
            yield f

    return pairs.mapInPandas(run, schema)
