"""Alignment and merging against plain sequential models."""

import random

from tessera.operators.alignment import align, differences, merged_changes

SCHEMA = "job long, side string, pos long, page long, type string, section_title string, text string, headers array<string>, rows int, cols int"


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _like(a, b):
    a, b = a or "", b or ""
    if not a and not b:
        return 1.0
    return 1 - _edits(a, b) / max(len(a), len(b)) if a and b else 0.0


def _best(own, other, score, least, used_a, used_b, out):
    for x in own:
        if x in used_a:
            continue
        found = max(((score(x, y), -n, y) for n, y in enumerate(other) if y not in used_b and score(x, y) >= least), default=None)
        if found:
            used_a.add(x)
            used_b.add(found[2])
            out.append((x, found[2], found[0]))


def _model(rows):
    """Rows (a, b, score, scope) of one job."""
    sides = {s: {r[2]: r for r in rows if r[1] == s} for s in "ab"}
    pages = {s: {} for s in "ab"}
    for s in "ab":
        for p in sorted(sides[s]):
            r = sides[s][p]
            pages[s].setdefault(r[3], []).append(r[6] or "")
    start = {s: {p: " ".join(t)[:2000] for p, t in pages[s].items()} for s in "ab"}
    matched = []
    _best(sorted(start["a"]), sorted(start["b"]), lambda x, y: _like(start["a"][x], start["b"][y]), 0.3, set(), set(), matched)
    inside = {"a": {x for x, _, _ in matched}, "b": {y for _, y, _ in matched}}
    blocks = {s: {p: r for p, r in sides[s].items() if r[3] in inside[s]} for s in "ab"}
    a, b, used_a, used_b, out = blocks["a"], blocks["b"], set(), set(), []
    text = lambda x, y: _like(a[x][6], b[y][6])
    titled = lambda s: [p for p in sorted(blocks[s]) if blocks[s][p][4] in ("heading", "title", "text") and blocks[s][p][5]]
    tables = lambda s: [p for p in sorted(blocks[s]) if blocks[s][p][4] == "table"]

    def of_tables(x, y):
        m, n = a[x][8] * a[x][9], b[y][8] * b[y][9]
        return 0.7 * _like(" ".join(a[x][7]), " ".join(b[y][7])) + 0.3 * (1 if max(m, n) == 0 else 1 - abs(m - n) / max(m, n))

    _best(titled("a"), titled("b"), text, 0.7, used_a, used_b, out)
    _best(tables("a"), tables("b"), of_tables, 0.5, used_a, used_b, out)
    _best(sorted(a), sorted(b), text, 0.4, used_a, used_b, out)
    rows = [(x, y, round(s, 6), None) for x, y, s in out] + [(x, None, 0.0, None) for x in a if x not in used_a] + [(None, y, 0.0, None) for y in b if y not in used_b]
    return rows + [(None, None, 0.0, p) for p in start["a"] if p not in inside["a"]]


def test_alignment_is_that_of_the_sequential_model(spark):
    r, rows = random.Random(5), []
    words = ["alpha", "beta", "gamma", "delta", "rho", ""]
    for job in range(8):
        for side in "ab":
            for pos in range(r.randint(0, 9)):
                kind = r.choice(["text", "heading", "table", "annotation"])
                rows.append((job, side, pos, pos // 3, kind, r.choice([None, "", "T"]), r.choice([None, " ".join(r.choice(words) for _ in range(r.randint(0, 4)))]), [r.choice(words) for _ in range(r.randint(0, 2))], r.randint(0, 2), r.randint(0, 2)))
    blocks = spark.createDataFrame(rows, SCHEMA)
    key = lambda t: tuple(str(v) for v in t)
    got = sorted(((x.job, x.a, x.b, round(x.score, 6), x.scope) for x in align(blocks).collect()), key=key)
    want = sorted(((job, *row) for job in range(8) for row in _model([x for x in rows if x[0] == job])), key=key)
    assert got == want


def test_a_pairs_similarity_is_computed_once_and_shared(spark):
    """one node computes the blocks' similarities, that of the pages is stored, and a large job's pairs are dealt to slices."""
    rows = [("j", s, p, 1, "text", None, f"words of block {p} number {p * 7}", None, None, None) for s in "ab" for p in range(200)]
    blocks = spark.createDataFrame(rows, "job string, side string, pos long, page long, type string, section_title string, text string, headers array<string>, rows int, cols int")
    out = align(blocks)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "slice" in plan
    assert sorted((r.a, r.b) for r in out.collect()) == [(p, p) for p in range(200)]


def test_distances_of_many_pairs_at_once():
    from tessera.operators.matching import _distance, _distances

    rng = random.Random(5)
    text = lambda n, letters="abcde é漢\U0001f600": "".join(rng.choice(letters) for _ in range(n))
    a = [text(n) for n in [1, 2, 63, 64, 65, 127, 128, 129, *(rng.randint(1, 400) for _ in range(200))]]
    b = [text(rng.randint(1, 400), "abcdexyz é漢") if i % 2 else t[: len(t) // 3] + text(i % 4) + t[len(t) // 2 :] for i, t in enumerate(a)]
    assert _distances(a + ["x"], b + ["y" * 300]) == [_distance(x, y) for x, y in zip(a, b, strict=True)] + [300]


def test_favourites_decide_as_all_pairs_do(spark):
    """F2 to F5: few pairs are compared, and what the favourites settle is what the greedy matching of all pairs gives."""
    from tessera.operators.matching import _most_alike, _similarities, favourites, greedy, settled

    r = random.Random(11)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "", "漢\U0001f600"]) for _ in range(r.randint(0, 5)))
    pairs = []
    for job in range(12):
        x, y = [text() for _ in range(7)], [text() for _ in range(6)]
        pairs += [(job, a, b, x[a], y[b]) for a in range(7) for b in range(6)]
    like = _similarities([p[3] for p in pairs], [p[4] for p in pairs])
    most = _most_alike([p[3] for p in pairs], [p[4] for p in pairs])
    assert (most >= like).all() and (most < 0.5).any()
    want = {}
    for (job, a, b, *_), s in zip(pairs, like, strict=True):
        if s >= 0.3 and ((job, a) not in want or (s, -b) > want[job, a]):
            want[job, a] = (s, -b)
    found = settled(favourites(spark.createDataFrame(pairs, "job long, a long, b long, x string, y string"), "job", 0.3), "job").collect()
    assert {(f.job, f.a): (f.score, -f.b) for f in found} == want
    scored = [(*p[:3], float(s)) for p, s in zip(pairs, like, strict=True)]
    whole = {(g.job, g.a): (g.b, g.score) for g in greedy(spark.createDataFrame(scored, "job long, a long, b long, score double"), "job", 0.3).collect()}
    sure = [f for f in found if f.sure]
    assert {len(found) > len(sure) > 0} == {True} and all(whole[f.job, f.a] == (f.b, f.score) for f in sure)


def test_merges_are_computed_once(spark):
    """both readers of the merges read them written; no similarity is left in the plan of the result."""
    from tessera.plans import catalogue

    plan = catalogue.QUERIES["merged_differences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan
