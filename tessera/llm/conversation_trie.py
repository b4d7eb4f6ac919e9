"""The prefix trie of conversations, and what sharing prefixes saves.

A turn is the 128-bit digest of its role and text; a conversation is its turns' digests
behind each other, so texts never travel. Equal conversations become one row with a count.
Rows are dealt by the digest of their first turn, and each task builds a trie of pointers
in a dictionary and sums it in postorder, without recursion. A first turn with more turns
below it than a task should hold is cut by the next turn at which its conversations
differ, and so on; the chain of nodes above the cut becomes one row, whose figures are
sums over what hangs below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import IntegerType

from .common import dropped, spread_join, written

#: Turns below one node that a task takes in whole.
MOST_TURNS = 200_000
#: Bytes of a turn's digest.
DIGEST = 16
NO_END = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _prefix(depth: Column | int) -> Column:
    """The key of a conversation's first turns."""
    return F.md5(F.substring(F.col("turns"), F.lit(1), F.lit(depth) * DIGEST if isinstance(depth, int) else depth * DIGEST))


def conversations(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, digests array<string>, lengths array<int>): each conversation's turns by `order`, null first.

    Null role or text becomes empty. Turns of equal order stand by role, then by digest;
    repeated rows are turns of their own. Rows without a conv_id are left out. The digests
    of a conversation (some 40 bytes a turn) are one row, its texts aren't.
    """
    role_, text_ = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(order).alias("o"), role_.alias("r"), digest.alias("d"), F.length(text_).alias("n")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", F.col("t.d").alias("digests"), F.col("t.n").alias("lengths"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """The first h turns of conversation c - c % 100, then the conversation's own turns after its first h; h = crc32(c) % 6."""
    base = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("digests", 1, 5).alias("bd"), F.slice("lengths", 1, 5).alias("bn"))
    own = convs.withColumn("base", F.expr("conv_id - conv_id % 100")).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int"))
    # A base has at most 199 conversations (negative ids included).
    both = own.join(base, "base", "left")

    def joined(mine: str, theirs: str) -> Column:
        none = F.array().cast(dict(convs.dtypes)[mine])
        rest = F.slice(mine, F.col("h") + 1, F.greatest(F.size(mine) - F.col("h"), F.lit(0)))
        return F.concat(F.coalesce(F.slice(theirs, F.lit(1), F.col("h")), none), rest)

    return both.select("conv_id", joined("digests", "bd").alias("digests"), joined("lengths", "bn").alias("lengths"))


def _ends(members: DataFrame) -> DataFrame:
    """(seq, ends_sha256): SHA-256 of the decimal ids of equal conversations, ascending, joined by commas.

    Ids are joined in blocks of 65,536 possible values; a task streams the blocks of its
    conversations, so a conversation of which there are very many copies is never a list.
    """
    blocks = members.groupBy("seq", F.shiftright("conv_id", 16).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, digest = None, None
        for frame in frames:
            done = []
            for s, ids in zip(frame["seq"], frame["ids"], strict=True):
                if s == seq:
                    digest.update(b"," + ids.encode())
                    continue
                if seq is not None:
                    done.append((seq, digest.hexdigest()))
                seq, digest = s, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["seq", "ends_sha256"])
        if seq is not None:
            yield pd.DataFrame({"seq": [seq], "ends_sha256": [digest.hexdigest()]})

    return blocks.repartition("seq").sortWithinPartitions("seq", "block").select("seq", "ids").mapInPandas(run, "seq string, ends_sha256 string")


def _tries(frames: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the subtries of one bucket; rows whose first `cut` turns are equal share a subtrie.

    Nodes are numbered as they are made, parents before children, so the reverse order is
    a postorder.
    """
    child: dict[tuple[int, bytes], int] = {}
    parent, depth, own, count, least, ends, top = [], [], [], [], [], [], []

    def node(above: int, at: int, length: int, row) -> int:
        parent.append(above), depth.append(at), own.append(length), count.append(0), least.append(row.least), ends.append(NO_END), top.append(None)
        return len(parent) - 1

    for row in frames.itertuples(index=False):
        cut, turns, above = row.tops[-1] + 1, row.turns, -1
        for at in range(cut, row.n_turns + 1):
            name = (above, turns[: DIGEST * at] if above < 0 else turns[DIGEST * (at - 1) : DIGEST * at])
            here = child.get(name)
            if here is None:
                here = child[name] = node(above, at, int(row.lengths[at - 1]), row)
                if above < 0:
                    top[here] = [hashlib.md5(turns[: DIGEST * t]).hexdigest() for t in row.tops]
            count[here] += row.n
            least[here] = min(least[here], row.least)
            above = here
        ends[above] = row.ends_sha256
    n = len(parent)
    children, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        leaves[i] += children[i] == 0
        saved[i] += (count[i] - 1) * own[i]
        if parent[i] >= 0:
            children[parent[i]] += 1
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    above = pd.array([least[p] if p >= 0 else None for p in parent], "Int64")
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": count, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "ups": top})


@F.pandas_udf(IntegerType())
def _shared(low: pd.Series, high: pd.Series) -> pd.Series:
    """How many turns the least and the greatest of some conversations share; the others share them too."""
    out = []
    for a, b in zip(low, high, strict=True):
        n = min(len(a), len(b)) // DIGEST
        x, y = (np.frombuffer(v, np.uint8, n * DIGEST).reshape(n, DIGEST) for v in (a, b))
        differ = np.flatnonzero((x != y).any(axis=1))
        out.append(int(differ[0]) if len(differ) else n)
    return pd.Series(out, dtype="int32")


def _cut(classes: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None, DataFrame, list[DataFrame]]:
    """Deal the classes: (classes below their last cut, classes that end at it, the chains above the cuts, scratch).

    `tops` are the depths of the cuts above a class, the root's 0 first. A chain is
    (key, ups, first, last, lengths): the nodes of depth first to last that all conversations
    below share, the last of which is cut; ups are the keys of the cuts up to it.
    """
    spark = classes.sparkSession
    root = spark.createDataFrame([(hashlib.md5(b"").hexdigest(), [hashlib.md5(b"").hexdigest()], 0, 0, [0])], "key string, ups array<string>, first int, last int, lengths array<int>")
    open_ = classes.withColumn("tops", F.array(F.lit(0)))
    closed, ended, chains, scratch = [], [], [root], []
    last = F.element_at("tops", -1)
    while True:
        ended.append(open_.where(F.col("n_turns") == last))
        keyed = open_.where(F.col("n_turns") > last).withColumn("key", _prefix(last + 1))
        sizes = written(keyed.groupBy("key").agg(F.sum("n_turns").alias("turns_below"), F.count("*").alias("rows")), "trie-sizes")
        scratch.append(sizes)
        large = (F.col("turns_below") > most) & (F.col("rows") > 1)
        if sizes.where(large).isEmpty():
            closed.append(keyed)
            break
        dealt = written(spread_join(keyed, sizes, ["key"], "rows", F.xxhash64("seq")), "trie-dealt")
        closed.append(dealt.where(~large).drop("turns_below", "rows"))
        over = dealt.where(large)
        bounds = over.groupBy("key").agg(F.min("turns").alias("turns"), F.max("turns").alias("high"), F.min(F.struct("turns", "lengths", "tops"))["lengths"].alias("lengths"), F.first("tops").alias("tops"))
        bounds = written(bounds.withColumn("last", _shared("turns", "high")), "trie-bounds")
        ups = F.transform(F.concat("tops", F.array("last")), lambda t: F.md5(F.substring(F.col("turns"), F.lit(1), t * DIGEST)))
        chains.append(bounds.select(_prefix(F.col("last")).alias("key"), ups.alias("ups"), (last + 1).alias("first"), "last", F.slice("lengths", last + 1, F.col("last") - last).alias("lengths")))
        shared = bounds.select("key", "last").join(sizes, "key")
        open_ = spread_join(over.drop("turns_below", "rows"), shared.select("key", "last", "rows"), ["key"], "rows", F.xxhash64("seq"))
        open_ = written(open_.withColumn("tops", F.concat("tops", F.array("last"))).drop("key", "last", "rows"), "trie-open")
        scratch += [dealt, bounds, open_]

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    return union([c.drop("key") for c in closed]), union(ended), union(chains), scratch


def trie(convs: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """One row per node of the trie of `convs` (conv_id, digests, lengths), as NODE says.

    The root is depth 0 and has no parent. A conversation without turns is a member of the
    root alone. An empty table has no node. Conversations that repeat whole are one path
    with more members; a repeated conv_id isn't expected here (conversations() gives none).
    """
    spark = convs.sparkSession
    packed = convs.select("conv_id", F.unhex(F.array_join("digests", "")).alias("turns"), "lengths", F.size("lengths").alias("n_turns"))
    members = written(packed.withColumn("seq", F.md5("turns")), "trie-members")
    classes = members.groupBy("seq", "turns", "lengths", "n_turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    classes = written(classes.join(_ends(members), "seq"), "trie-classes")
    below, ended, chains, scratch = _cut(classes, most)
    total = classes.agg(F.coalesce(F.sum("n_turns"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total // most)
    first = _prefix(F.element_at("tops", -1) + 1)
    nodes = below.select("turns", "lengths", "n_turns", "n", "least", "ends_sha256", "tops", F.pmod(F.xxhash64(first), F.lit(buckets)).alias("bucket"))
    nodes = written(nodes.groupBy("bucket").applyInPandas(lambda f: _tries(f.drop(columns="bucket")), NODE + ", ups array<string>"), "trie-nodes")

    # What hangs below each cut: the subtries' top nodes and the conversations that end there.
    tops = nodes.where("ups is not null")
    ends_up = F.transform("tops", lambda t: F.md5(F.substring(F.col("turns"), F.lit(1), t * DIGEST)))
    hanging = tops.select("ups", "conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(1).alias("child"), F.lit(None).cast("string").alias("sha"))
    hanging = hanging.unionByName(ended.select(ends_up.alias("ups"), F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.lit(0).alias("child"), F.col("ends_sha256").alias("sha")))
    each = hanging.select(F.posexplode("ups").alias("at", "key"), F.size("ups").alias("n_ups"), "conv_id", "n_convs", "n_leaves", "saved_tokens", "child", "sha")
    direct = F.col("at") == F.col("n_ups") - 1
    figures = each.groupBy("key").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.sum(F.when(direct, F.col("child")).otherwise(0)).alias("children"), F.max(F.when(direct, F.col("sha"))).alias("sha"),
    )
    chains = written(chains.join(figures, "key"), "trie-chains")
    # A chain's own savings count for all cuts above it, and it is a child of the next one above.
    sums = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    own = chains.select(F.posexplode("ups").alias("at", "key"), F.size("ups").alias("n_ups"), ((F.col("n") - 1) * sums).alias("own"))
    own = own.groupBy("key").agg(F.sum("own").alias("own"), F.sum(F.when(F.col("at") == F.col("n_ups") - 2, 1).otherwise(0)).alias("chains_below"))
    chains = chains.join(own, "key")
    above = chains.select(F.col("key").alias("up"), F.col("least").alias("up_least"), F.greatest("children", F.lit(1)).alias("rows"))
    chains = chains.withColumn("up", F.get("ups", F.size("ups") - 2)).join(above.drop("rows"), "up", "left")
    step = chains.select("*", F.posexplode("lengths").alias("i", "length"), (F.col("last") - F.col("first")).alias("bottom"))
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x)
    at_bottom = F.col("i") == F.col("bottom")
    upper = step.select(
        F.col("least").alias("conv_id"),
        (F.col("first") + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") > 0, F.col("least")).otherwise(F.col("up_least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(at_bottom, F.col("children") + F.col("chains_below")).otherwise(1).cast("long").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.col("saved") + F.col("own") - (F.col("n") - 1) * before).alias("saved_tokens"),
        F.when(at_bottom, F.coalesce("sha", F.lit(NO_END))).otherwise(NO_END).alias("ends_sha256"),
    )
    tops = spread_join(tops.withColumn("up", F.element_at("ups", -1)), above, ["up"], "rows", F.xxhash64("conv_id"))
    tops = tops.withColumn("parent_conv_id", F.col("up_least"))
    names = upper.columns
    out = nodes.where("ups is null").select(names).unionByName(tops.select(names)).unionByName(upper)
    dropped(members, *scratch)
    return out


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP11_SQL = """
WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
         lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: CAST(i AS UBIGINT))),
           lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS UBIGINT)) % 6 AS BIGINT) AS h FROM t),
c AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h), []), list_slice(h.own, h + 1, len(h.own))) AS turns
      FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS path, CASE WHEN d = 0 THEN 0 ELSE length(turns[d].x) END AS len FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM c)),
m AS (SELECT conv_id, n, d, len, min(conv_id) OVER (PARTITION BY path) AS least FROM p),
g AS (SELECT least, d, count(*) AS n_convs, any_value(len) AS len, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends FROM m GROUP BY least, d),
k AS (SELECT a.least AS up, a.d AS ud, b.least, b.d FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.d = b.d - 1 GROUP BY ALL),
kids AS (SELECT up, ud, count(*) AS n_children FROM k GROUP BY up, ud),
sub AS (SELECT DISTINCT a.least AS top, a.d AS td, b.least, b.d FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.d <= b.d),
s AS (SELECT top, td, count(*) FILTER (kids.n_children IS NULL) AS n_leaves, sum((n_convs - 1) * len) AS saved
      FROM sub JOIN g ON g.least = sub.least AND g.d = sub.d LEFT JOIN kids ON kids.up = sub.least AND kids.ud = sub.d GROUP BY top, td)
SELECT g.least AS conv_id, CAST(g.d AS BIGINT) AS depth, k.up AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM g LEFT JOIN k ON k.least = g.least AND k.d = g.d LEFT JOIN kids ON kids.up = g.least AND kids.ud = g.d JOIN s ON s.top = g.least AND s.td = g.d
"""
