"""The conversation trie against a plain trie, with and without cuts."""

import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import conversation_trie as ct
from tessera.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, turns string, n_turns int, key string"


def rebuild(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, order, text))
    own = {c: [(r, x) for _, r, _, x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(int(c - np.fmod(c, 100)), [])[:h] + t[h:]
    return out


def brute(convs):
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def families(rng):
    """Conversations that share deep beginnings, branch late, end at inner nodes and repeat whole; odd rows besides."""
    rows = []
    for c in range(330):
        kind = c % 5
        if kind == 0:
            turns = ["same"] * 3 + [f"a{rng.integers(3)}" for _ in range(rng.integers(0, 6))]
        elif kind == 1:
            turns = ["same"] * 3 + ["deep"] * 12 + [f"b{rng.integers(2)}" for _ in range(rng.integers(0, 4))]
        elif kind == 2:
            turns = ["copy", "of", "one", "é" * 4, "x", "y", "z"]
        elif kind == 3:
            turns = [f"own{c}"] * int(rng.integers(1, 4))
        else:
            turns = ["same"] * int(rng.integers(1, 8))
        rows += [(c, i, "user" if i % 2 else None, t, "t", 1, "k") for i, t in enumerate(turns)]
    rows += [(-5, 1, "user", "minus", None, None, None), (-205, None, "u", None, None, None, None), (-205, None, "u", "tie", None, None, None), (-205, 0, "a", "tie", None, None, None)]
    rows += [(7, 3, "user", "twice", None, None, None)] * 2 + [(None, 1, "user", "nobody", None, None, None), (1 << 40, 5, "user", "far", None, None, None)]
    return rows


@pytest.mark.parametrize("most", [200_000, 60, 5])
def test_trie_against_a_plain_one(spark, most):
    rows = families(np.random.default_rng(5))
    convs = rebuild(rows)
    got = ct.trie(ct.rebuilt(ct.conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))), most).collect()
    want = brute(convs)
    assert sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0])) == want
    assert len({len(t) for t in convs.values()}) > 5 and min(map(len, convs.values())) == 0


def test_cuts_happen_and_jump_over_shared_turns(spark):
    rows = families(np.random.default_rng(5))
    convs = ct.conversations(spark.createDataFrame(rows, SCHEMA))
    packed = convs.selectExpr("conv_id", "unhex(array_join(digests, '')) as turns", "lengths", "size(lengths) as n_turns", "conv_id as least", "1L as n", "'' as ends_sha256").selectExpr("*", "string(conv_id) as seq")
    below, ended, chains, _ = ct._cut(packed, 60)
    lengths = {(r.first, r.last) for r in chains.collect()}
    assert len(lengths) > 3 and any(b - a >= 5 for a, b in lengths) and below.count() + ended.count() == convs.count()


def test_many_copies_stream(spark):
    """Ends of one conversation in several blocks of ids."""
    ids = [*range(0, 400_000, 997), -3, 1 << 45]
    convs = spark.createDataFrame([(i,) for i in ids], "conv_id long").selectExpr("conv_id", "array(md5('a')) as digests", "array(3) as lengths")
    got = {r.depth: r for r in ct.trie(convs).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert got[0].ends_sha256 == ct.NO_END and got[1].n_convs == len(ids) and got[0].saved_tokens == 3 * (len(ids) - 1)


def test_empty_and_turnless(spark):
    assert ct.trie(ct.rebuilt(ct.conversations(spark.createDataFrame([], SCHEMA)))).count() == 0
    none = spark.createDataFrame([(4, [], []), (9, [], [])], "conv_id long, digests array<string>, lengths array<int>")
    (root,) = ct.trie(none).collect()
    assert tuple(root) == (4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,9").hexdigest())


def test_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    cur = con.execute(queries.ORACLES["op11_trie"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r) for r in ct.op11_trie(spark, "/root/testdata/sf0.001").select(names).collect()) == want
