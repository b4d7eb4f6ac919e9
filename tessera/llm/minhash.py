"""Near-duplicate groups by one-permutation MinHash.

One hash of every distinct shingle fills 128 bins (the smallest hash of a bin counts);
empty bins take the value of a full one by optimal densification. Four bins make a band,
its values a bucket. Documents with equal shingle sets are one class, so a group of
copies enters a bucket once. In a bucket, classes are linked to a centre only (a star);
stars are confirmed on the full sets and classes joined. In the few buckets that then
still hold several components, the sweep compares in blocks: classes of different
components that agree in enough bins are confirmed on the full sets inside the task, which
gives out a spanning forest of their links. Every pair that shares a bucket is thus
either in one component or examined, and the pairs given out stay below the entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import HASH_BYTES, ROW, dropped, mix, prefix_hash, range_hash, slices, spread_join, utf8, with_rows, written

WIDTH, BINS, BANDS = 5, 128, 32
MIN_PERCENT = 75

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _probes(bins: int, attempts: int = 64) -> np.ndarray:
    """The bins that an empty bin asks, one after the other (the 2-universal choice of optimal densification)."""
    i = np.arange(bins, dtype=np.uint64)[None, :] + np.arange(1, attempts + 1, dtype=np.uint64)[:, None] * np.uint64(1 << 32)
    return (mix(i) % np.uint64(bins)).astype(np.int64)


PROBES = _probes(BINS)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles of the texts, and each text's offset among them.

    Words are runs of other bytes than ASCII white space, A-Z in lower case. A text with
    fewer words than `width` has its whole sequence as one shingle; without words none.
    """
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & ~space)
    ends_at = np.ones(len(data) + 1, bool)
    ends_at[:-1] = space
    ends_at[offsets] = True
    ends = np.flatnonzero(ends_at)
    ends = ends[np.searchsorted(ends, starts, "right")]
    word = range_hash(prefix_hash(data), starts, ends)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    full = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(full)])
    base = np.repeat(first[:-1] - out_at[:-1], full) + np.arange(out_at[-1])
    length = np.minimum(np.repeat(counts, full), width)
    h = length.astype(np.uint64)
    for i in range(width):
        more = length > i
        at = np.where(more, base + i, 0)
        h = np.where(more, mix(h * np.uint64(0x9E3779B97F4A7C15) + word[at]), h) if len(word) else h
    return h, out_at


def bins_of(distinct: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The densified bins (uint64) of a sorted set of hashes that isn't empty."""
    edges = np.arange(bins, dtype=np.uint64) << np.uint64(64 - bins.bit_length() + 1)
    at = np.searchsorted(distinct, edges)
    full = np.diff(np.append(at, len(distinct))) > 0
    values = distinct[np.minimum(at, len(distinct) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        ok = full[PROBES[:, empty]]
        pick = PROBES[ok.argmax(0), empty]
        none = ~ok.any(0)
        if none.any():
            pick[none] = np.flatnonzero(full)[mix(empty[none].astype(np.uint64)) % np.uint64(full.sum())]
        values[empty] = values[pick]
    return values


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Bucket keys (int64, one for each band)."""
    key = np.arange(bands, dtype=np.uint64)
    for c in values.reshape(bands, -1).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + c)
    return key.view(np.int64)


def _sets(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batch, text, HASH_BYTES):
        h, at = shingle_hashes(*utf8(part.column(text)))
        yield part, [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _list_array(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a set: two sums of differently mixed hashes, mixed with the size. Equal sets, equal digest."""
    sums = np.array([mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64)
    return mix(sums + np.uint64(len(s))).tobytes()


def sketches(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, doc_id, n_shingles, digest binary, keys array<long>) of docs with row keys; digest is null and keys empty without shingles."""

    def run(batches):
        for batch in batches:
            for part, sets in _sets(batch, text):
                digest = [_digest(s) if len(s) else None for s in sets]
                keys = [band_keys(bins_of(s)).view(np.uint64) if len(s) else np.zeros(0, np.uint64) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(ROW), part.column(doc), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), _list_array(keys)], names=[ROW, "doc_id", "n_shingles", "digest", "keys"])

    return docs.select(ROW, F.col(doc).cast("long").alias(doc), text).mapInArrow(run, f"{ROW} long, doc_id long, n_shingles long, digest binary, keys array<long>")


def shingle_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """(class, n, set array<long>, bins binary): the sorted hashes of every row's shingles, and 8 bits of each bin."""

    def run(batches):
        for batch in batches:
            for part, sets in _sets(batch, text):
                bins = [(mix(bins_of(s)) & np.uint64(255)).astype(np.uint8).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.array([len(s) for s in sets], pa.int64()), _list_array(sets), pa.array(bins, pa.binary())], names=["class", "n", "set", "bins"])

    return docs.select("class", text).mapInArrow(run, "class long, n long, set array<long>, bins binary")


#: Stars of a bucket in each turn: in the first around its smallest class, then around others.
STARS = (1, 4)


def _stars(members: DataFrame, orders: list) -> DataFrame:
    """Edges (a, b, na, nb) from a centre to one class of each other component of a bucket.

    members: (key, class, n, comp). Each of `orders` gives one star: it picks the class of
    a component, and the centre is the picked class that it puts first. Pairs whose set
    sizes rule a link out are left out.
    """
    picks = [F.min(F.struct(o.alias("o"), F.col("class"), F.col("n"))).alias(f"m{i}") for i, o in enumerate(orders)]
    one = members.groupBy("key", "comp").agg(*picks)
    centre = one.groupBy("key").agg(*[F.min(f"m{i}").alias(f"c{i}") for i in range(len(orders))], F.count("*").alias("parts")).where("parts > 1")
    pairs = F.explode(F.array(*[F.struct(F.col(f"m{i}").alias("m"), F.col(f"c{i}").alias("c")) for i in range(len(orders))])).alias("p")
    each = one.join(centre, "key").select(pairs).where("p.m.class <> p.c.class")
    sized = each.where(100 * F.least("p.m.n", "p.c.n") >= MIN_PERCENT * F.greatest("p.m.n", "p.c.n"))
    swap = F.col("p.m.class") < F.col("p.c.class")
    return sized.select(
        F.least("p.m.class", "p.c.class").alias("a"),
        F.greatest("p.m.class", "p.c.class").alias("b"),
        F.when(swap, F.col("p.m.n")).otherwise(F.col("p.c.n")).alias("na"),
        F.when(swap, F.col("p.c.n")).otherwise(F.col("p.m.n")).alias("nb"),
    ).distinct()


#: Equal bins that a pair needs to be confirmed: with a similarity of 0.75 fewer of 128 agree with probability 5e-7.
LEAST_BINS = 72
#: Classes of a block of a bucket; a bucket of more is compared block by block.
SWEEP_BLOCK = 1024


def _alike(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of rows of one bucket (two blocks of it, if `left` and `right` differ) that need confirming.

    Of different components, sizes and bins that allow a link, and no bucket shared in an earlier band.
    """
    n, comp = frame["n"].to_numpy(), frame["comp"].to_numpy()
    bins = np.frombuffer(b"".join(frame["bins"]), np.uint8).reshape(len(frame), BINS)
    keys = np.stack(frame["keys"].to_numpy())
    own, left, right, key = frame["own"].to_numpy(), frame["left"].iat[0], frame["right"].iat[0], frame["key"].iat[0]
    rows, cols = np.flatnonzero(own == left), np.flatnonzero(own == right)
    out_i, out_j = [], []
    for i in rows:
        j = cols[cols > i] if left == right else cols
        j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= MIN_PERCENT * np.maximum(n[j], n[i]))]
        j = j[np.count_nonzero(bins[j] == bins[i], axis=1) >= LEAST_BINS] if len(j) else j
        if len(j):
            same = keys[j] == keys[i]
            j = j[keys[i][same.argmax(1)] == key]
            out_i.append(np.full(len(j), i))
            out_j.append(j)
    none = np.zeros(0, np.int64)
    return np.concatenate(out_i or [none]), np.concatenate(out_j or [none])


def _buckets(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, own in frame.groupby(["key", "left", "right"], sort=False):
        if len(own) > 1:
            yield own.reset_index(drop=True)


def _flagged(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of the task's buckets that stand in a pair to confirm."""
    out = []
    for own in _buckets(frame):
        i, j = _alike(own)
        if len(i):
            out.append(own.iloc[np.unique(np.concatenate([i, j]))])
    return pd.concat(out)[frame.columns] if out else frame.iloc[:0]


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) confirmed on full sets that join components; pairs that earlier links have joined need none."""
    out = []
    for own in _buckets(frame):
        pair_i, pair_j = _alike(own)
        comp, cls = own["comp"].to_numpy().copy(), own["class"].to_numpy()
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in own["set"]]
        size = np.array([len(s) for s in sets])
        for i in np.unique(pair_i):
            j = pair_j[(pair_i == i)]
            j = j[comp[j] != comp[i]]
            if not len(j):
                continue
            flat = np.concatenate([sets[x] for x in j])
            at = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[j])[:-1]]))
            for x in j[100 * both >= MIN_PERCENT * (size[i] + size[j] - both)]:
                if comp[x] != comp[i]:
                    comp[comp == comp[x]] = comp[i]
                    out.append((min(cls[i], cls[x]), max(cls[i], cls[x])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _sweep(entries: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): confirmed links that join the components left in the buckets; written.

    A bucket of more than SWEEP_BLOCK classes is cut into blocks, and every two blocks meet
    in a group of their own, so no group grows with the bucket. Bins come first; full sets
    only travel for classes that stand in a pair to confirm.
    """
    left = written(entries.join(comp, "class").select("key", "class", "comp"), "left")
    open_ = left.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    open_ = written(open_.select("key", "size", F.ceil(F.col("size") / SWEEP_BLOCK).cast("int").alias("blocks")), "open")
    each = spread_join(left, open_, ["key"], "size", F.xxhash64("class"))
    each = each.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")}).drop("other", "blocks", "size")
    n = each.count()
    group = F.pmod(F.xxhash64("key", "left", "right"), F.lit(1 + n // 4000)).alias("group")
    columns = "key long, class long, comp long, own int, left int, right int, n long, bins binary, keys array<long>"
    cut = each.join(sets.select("class", "n", "bins", "keys"), "class").select(group, *[c.split()[0] for c in columns.split(", ")])
    flagged = written(cut.groupBy("group").applyInPandas(lambda f: _flagged(f.drop(columns="group")), columns), "flagged")
    full = flagged.join(sets.select("class", "set"), "class")
    links = written(full.select(group, "set", *flagged.columns).groupBy("group").applyInPandas(_linked, "a long, b long").distinct(), "links")
    dropped(left, open_, flagged)
    return links


def _tasks(rows: int) -> int:
    """Tasks that write a narrow table of so many rows."""
    return 4 + rows // 250_000


def components(edges: DataFrame, rows: int) -> DataFrame:
    """(node, comp) of every node of the edges (a, b), with comp the smallest node reachable.

    Every round takes the smallest label of the neighbours, then the label's own label;
    labels are written, so a round depends on no earlier one.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(_tasks(2 * rows)), "links")
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("comp"))
    label = written(label.coalesce(_tasks(rows)), "labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        hooked = label.join(near, label["node"] == near["a"]).select("node", "comp", F.least("comp", "near").alias("new"))
        up = label.select(F.col("node").alias("new"), F.col("comp").alias("up"))
        jumped = written(hooked.join(up, "new", "left").select("node", F.col("comp").alias("old"), F.least("new", "up").alias("comp")).coalesce(_tasks(rows)), "labels")
        dropped(label)
        label = jumped.select("node", "comp")
        label.table_path = jumped.table_path
        if not jumped.where("old <> comp").limit(1).count():
            dropped(both)
            return label


#: Classes whose ids (16 bytes each) may be broadcast to pick their texts; with more the join shuffles.
BROADCAST_CLASSES = 2_000_000


def _joined(comp: DataFrame, links: DataFrame, n_links: int) -> DataFrame:
    """comp (class, comp) after the links (a, b) between classes; written."""
    of_a, of_b = comp.select(F.col("class").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("class").alias("b"), F.col("comp").alias("cb"))
    between = links.join(of_a, "a").join(of_b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    moved = components(between, n_links)
    out = written(comp.join(moved.withColumnRenamed("comp", "to"), comp["comp"] == moved["node"], "left").select("class", F.coalesce("to", "comp").alias("comp")), "comp")
    dropped(comp, moved)
    return out


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: row_key, group, doc_id, n_shingles, component_id (smallest doc_id of its group), kept.

    Links are confirmed with 100 * intersection >= 75 * union on the full sets. Texts
    without words (null, empty) are linked with nothing and kept. Rows that repeat a
    doc_id with the same text are one document in two rows; both are returned. Rows are
    told by their row keys, so a doc_id may have several texts or be null; group is the
    same for all rows of a group and null without words. Texts may be of any length, other
    columns don't matter, and an empty table gives no rows.
    A link of similarity 0.75 is missed with probability 6e-6: it shares no bucket with
    (1 - 0.75**4)**32 = 5e-6, and fewer bins than the sweep asks for with 5e-7.
    """
    docs = with_rows(docs)
    sk = written(sketches(docs, doc, text), "sketches")
    classes = sk.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min(ROW).alias("class"), F.max("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = written(classes, "classes")
    entries = classes.select("class", "n", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    entries = written(entries.join(shared, "key"), "buckets")
    members = written(entries.select("class").distinct(), "members")
    named = classes.select("digest", "class", "doc")
    if members.isEmpty():
        named = named.withColumn("comp", F.col("class"))
    else:
        wanted = classes.join(members, "class", "left_semi").select("class", "keys")
        few = members.count() <= BROADCAST_CLASSES
        mine = docs.select(F.col(ROW).alias("class"), text).join(F.broadcast(members) if few else members, "class")
        # The keys come from the classes, so that a class brings its bins, set and buckets from one row.
        sets = written(shingle_sets(mine, text).join(wanted, "class"), "sets")
        comp, tried = written(members.select("class", F.col("class").alias("comp")), "comp"), None
        for turn, n_stars in enumerate(STARS):
            orders = [F.col("class")] if not turn else [F.xxhash64("key", "class", F.lit(10 * turn + i)) for i in range(n_stars)]
            stars = _stars(entries.join(comp, "class"), orders)
            stars = written(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"), "stars")
            good = (
                stars.join(sets.select(F.col("class").alias("a"), F.col("set").alias("sa")), "a")
                .join(sets.select(F.col("class").alias("b"), F.col("set").alias("sb")), "b")
                .withColumn("i", F.size(F.array_intersect("sa", "sb")))
                .where(100 * F.col("i") >= MIN_PERCENT * (F.col("na") + F.col("nb") - F.col("i")))
                .select("a", "b")
            )
            good = written(good, "good")
            comp = _joined(comp, good, good.count())
            dropped(tried, good)
            tried = stars
        dropped(tried)
        links = _sweep(entries, comp, sets)
        comp = _joined(comp, links, links.count())
        dropped(links, sets, entries, members)
        named = named.join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    least = named.groupBy("comp").agg(F.min("doc").alias("least"))
    ids = named.join(least, "comp").select("digest", "least", F.col("comp").alias("group"))
    out = sk.join(ids, "digest", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select(ROW, "group", "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop(ROW, "group")


OP8_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = doc_id
"""
