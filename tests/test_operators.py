"""Operators that SQL doesn't express, on small fixtures."""

import random

from tessera.functions import scoring
from tessera.functions import text as T
from tessera.operators.matching import _distance, _script, _steps, components, distinct_texts, greedy, near_pairs, whole_similarity, word_changes
from tessera.streaming.state import _decide, limited


def test_significance_rules(spark):
    from pyspark.sql import functions as F

    rows = [("a b", "a b", "cosmetic", 0.99), ("a \t b", "a b", "cosmetic", 0.97), ("a b c", "ab c d", "substantive", 0.80), ("you will pay", "you may pay", "material", 0.85), ("due 3 Jan 2024", "until 3 Jan 2024", "substantive", 0.85), ("¥ a b c", "¥ a b d", "material", 0.93), ("abc", "abd", "cosmetic", 0.82), ("1.50", "150", "cosmetic", 0.92), ("Total", "TOTAL", "cosmetic", 0.95), ("pay 10 now", "pay 12 now", "material", 0.92), ("it shall be so", "it may be so", "material", 0.85), ("one two three", "four five six", "substantive", 0.80)]
    df = spark.createDataFrame(rows, "a string, b string, s string, c double")
    out = df.withColumn("r", scoring.modification(F.col("a"), F.col("b"))).collect()
    assert [(r["r"]["significance"], r["r"]["confidence"]) for r in out] == [(r[2], r[3]) for r in rows]


def test_greedy_takes_each_once(spark):
    pairs = spark.createDataFrame([("g", 1, 1, 0.9), ("g", 2, 1, 0.95), ("g", 2, 2, 0.5), ("g", 3, 2, 0.9), ("g", 3, 3, 0.2)], "grp string, a long, b long, score double")
    assert sorted((r.a, r.b) for r in greedy(pairs, "grp", 0.4).collect()) == [(1, 1), (2, 2)]


def test_word_script():
    assert _script("a b c".split(), "a x c d".split()) == [("modification", "b", "x"), ("addition", "", "d")]


def test_fixed_window_starts_at_first_event():
    assert _decide([0, 10, 59, 60, 61], 60, 1, None, 0)[0] == [True, False, False, True, False]


def test_stream_and_table_agree(spark, tmp_path):
    rows = spark.sql("select id as event_id, cast(id % 3 as long) as user_id, timestamp_seconds(1000000 + id * 7) as ts from range(60)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = limited(stream, ["user_id"], 60, 2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.event_id, r.passed) for r in spark.table("limited").collect()}
    assert got == {(r.event_id, r.passed) for r in limited(rows, ["user_id"], 60, 2).collect()}


def test_text_functions(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("Ａ  b c",)], "t string").select(T.normalise(F.col("t")).alias("n"), T.similarity(F.lit("abcd"), F.lit("abcf")).alias("s"), T.jaccard(F.lit(""), F.lit("")).alias("j")).first()
    assert (r.n, r.s, r.j) == ("A b c", 0.75, 1.0)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_script():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert _distance(a, b) == _edits(a, b)
        steps = _steps(list(a), list(b))
        assert "".join(b[i] if k > 0 else a[i] for k, i in steps if k >= 0) == b and [i for k, i in steps if k <= 0] == list(range(len(a)))
        # A shortest script without replacements keeps a longest common subsequence.
        assert len([1 for k, _ in steps if k]) == min((len(a) + len(b) - 2 * len(c) for c in _common(a, b)), default=0)
        for most in (0, 3, 10):
            cut = _steps(list(a), list(b), most)
            assert "".join(b[i] if k > 0 else a[i] for k, i in cut if k >= 0) == b and [i for k, i in cut if k <= 0] == list(range(len(a)))
            assert len([1 for k, _ in cut if k]) == len([1 for k, _ in steps if k])


def _common(a, b):
    best = [[""] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + x if x == y else max(best[i][j + 1], best[i + 1][j], key=len)
    return [best[-1][-1]]


def _family(seed):
    """Texts of two sources: families of copies with a few words changed anywhere, repeated rows, short and empty ones."""
    r, rows = random.Random(seed), []
    for family in range(6):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 12, 60, 300]))]
        for _ in range(8):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = f"x{r.randint(0, 9)}"
            rows.append((len(rows), f"s{family % 2}", " ".join(words)))
    return rows + [(len(rows), "s0", ""), (len(rows) + 1, "s0", " \n "), (len(rows) + 2, "s1", "one"), (len(rows) + 3, "s0", None), (len(rows) + 4, "s0", rows[0][2])]


def test_near_pairs_are_those_of_all_pairs(spark):
    rows = _family(3)
    docs = distinct_texts(spark.createDataFrame(rows, "doc_id long, source string, text string").where("text is not null"), "source")
    first = {}
    for i, s, t in rows:
        if t is not None:
            first.setdefault((s, t), i)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    own = sorted((i, s, t, shingles(t)) for (s, t), i in first.items())
    want = {(x[0], y[0]) for n, x in enumerate(own) for y in own[n + 1 :] if x[1] == y[1] and x[3] and y[3] and 4 * len(x[3] & y[3]) >= 3 * len(x[3] | y[3])}
    pairs = near_pairs(docs, "source")
    assert want and {(r.a, r.b) for r in pairs.collect()} == want
    reach = {i: i for p in want for i in p}
    for _ in reach:
        for a, b in want:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert {r.id: r.component for r in components(pairs).collect()} == reach


def test_near_texts_differ_late(spark):
    """Two texts that are equal for their first 5,000 characters are not taken as equal."""
    long = " ".join(f"w{i}" for i in range(2000))
    docs = spark.createDataFrame([(1, "s", long + " end"), (2, "s", long + " stop"), (3, "s", "zz " + long)], "doc_id long, source string, text string")
    assert {(r.a, r.b) for r in near_pairs(docs, "source").collect()} == {(1, 2), (1, 3), (2, 3)}
    pair = docs.where("doc_id < 3").selectExpr("max(if(doc_id = 1, text, null)) as a", "max(if(doc_id = 2, text, null)) as b")
    assert word_changes(pair, "a", "b").first().changes == [("modification", "end", "stop")]
    assert 0.99 < pair.select(whole_similarity("a", "b")).first()[0] < 1


def test_greedy_in_passes(spark):
    pairs = spark.createDataFrame([("g", 1, 1, 1, 0.9), ("g", 2, 1, 2, 1.0), ("g", 2, 2, 1, 1.0), ("g", 2, 2, 2, 0.5)], "grp string, pass int, a long, b long, score double")
    assert sorted((r.a, r.b) for r in greedy(pairs, "grp", 0.4).collect()) == [(1, 1), (2, 2)]


def test_limit_of_a_table_over_batches(spark):
    """The state of a key is carried from one batch to the next; null keys are a key."""
    rows = spark.sql("select id as event_id, if(id % 5 = 0, null, id % 2) as user_id, timestamp_seconds(id * 3) as ts from range(400)")
    want = {}
    for i in range(400):
        want.setdefault(None if i % 5 == 0 else i % 2, []).append((i, i * 3))
    passed = {(i, p) for own in want.values() for (i, _), p in zip(own, _decide([t for _, t in own], 60, 2, None, 0)[0], strict=True)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r.event_id, r.passed) for r in limited(rows, ["user_id"], 60, 2).collect()} == passed
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_medians_are_exact(spark):
    from tessera.operators.scans import medians

    r = random.Random(7)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, 1.5, 2.5, r.random() * 9])) for i in range(301)] + [("one", 999, 4.0), ("none", 1000, None)]
    want = {}
    for g in {x[0] for x in rows}:
        v = sorted(x[2] for x in rows if x[0] == g and x[2] is not None)
        want[g] = None if not v else (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    got = {x.g: x.median for x in medians(spark.createDataFrame(rows, "g string, id long, v double"), "g", "v", "id").collect()}
    assert got == {g: m for g, m in want.items() if m is not None}


def test_rollup_of_a_stream_is_that_of_the_table(spark, tmp_path):
    from tessera.streaming.state import daily_rollup

    rows = spark.sql("select id as event_id, if(id % 3 = 0, 'a', 'b') as event_type, timestamp_seconds(1700000000 + id * 7200) as ts from range(60)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    end = spark.sql("select 99L as event_id, 'end' as event_type, timestamp_seconds(1700000000 + 90 * 86400) as ts")
    end.write.mode("append").parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    q = daily_rollup(stream).writeStream.format("memory").queryName("rollup").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {tuple(x) for x in spark.table("rollup").collect()} == {tuple(x) for x in daily_rollup(rows).collect()}


def test_vendor_scores_do_not_depend_on_the_order_of_lines(spark, tmp_path):
    """F8: the same discounts in two orders; a sum of doubles took scores at a half to either side."""
    import random

    from tessera.plans.analytics import vendor_scorecard

    r = random.Random(3)
    rows = []
    for k in range(300):
        discounts = [r.randrange(11) / 100 for _ in range(8 * (1 + k % 5))]
        rows += [(2 * k, d, "N") for d in discounts] + [(2 * k + 1, d, "N") for d in sorted(discounts)]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {x.l_suppkey: x.score for x in vendor_scorecard(spark, str(tmp_path)).collect()}
    assert [k for k in range(300) if got[2 * k] != got[2 * k + 1]] == []


def test_grids_are_shuffled_once(spark):
    """the rows of both grids cross one shuffle, and give what the operators on cells give."""
    from pyspark.sql import functions as F

    from tessera.operators.grids import cell_differences, cell_map, grid_rows, new_rows, row_cell_differences, unlike_rows

    r = random.Random(4)
    rows = [(i, s, r.randrange(6), p, [r.choice(["10", "10.0", "ab", "abcdefghij", ""]) for _ in range(3)]) for i in range(20) for s in "ab" for p in range(5)]
    df = spark.createDataFrame(rows, "id long, side string, row long, pos long, texts array<string>")
    a, b = [cell_map(df.where(F.col("side") == s).select("id", "pos", "row", F.posexplode("texts").alias("col", "text")), ["id"]) for s in "ab"]
    g = grid_rows(df.repartition("id"), ["id"])
    cells = row_cell_differences(g, ["id"])
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, cell_differences(a, b, ["id"]).collect()))
    assert row_cell_differences(g, ["id"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for own, other, x, y in (("a", "b", a, b), ("b", "a", b, a)):
        assert sorted(map(tuple, unlike_rows(g, ["id"], own, other).collect())) == sorted(map(tuple, new_rows(x, y, ["id"]).collect()))


def test_vendor_scores_of_odd_discounts_are_those_of_the_sql(spark, tmp_path):
    """lines without a discount counted in the mean of discounts, and NaN stopped the query."""
    import duckdb

    from tessera.plans.catalogue import ORACLES, QUERIES

    rows = [(1, 0.1, "N"), (1, None, "N"), (1, 0.04, "R"), (2, None, "N"), (3, float("nan"), "N"), (3, 0.02, "R"), (4, 1e20, "N"), (5, -3.0, "R"), (None, 0.05, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = [tuple(x) for x in QUERIES["vendor_scorecard"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(c.sql(ORACLES["vendor_scorecard"]).fetchall(), key=str)


def test_near_texts_write_prefixes_and_texts_of_near_pairs_only(spark, tmp_path):
    """all texts and all their shingles were written and shuffled, whether or not a text was near another."""
    import random
    from pathlib import Path

    from tessera.operators.relational import shared_dir
    from tessera.plans.catalogue import QUERIES

    r = random.Random(11)
    texts = [" ".join(f"word{r.randrange(10**6)}" for _ in range(400)) for _ in range(300)]
    texts += [texts[0] + " end", texts[0], texts[1].replace(" ", "  ", 1)]
    rows = [(i, t, "en", f"s{i % 2}" if i < 300 else "s0" if i < 302 else "s1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    got = QUERIES["similarity_pairs"](spark, str(tmp_path)).collect()
    assert [(x.a, x.b) for x in sorted(got)] == [(0, 300), (1, 302)]
    written = sum(f.stat().st_size for d in set(shared.iterdir()) - before for f in d.rglob("*.parquet"))
    assert 0 < written < sum(map(len, texts)) / 2


def test_near_pairs_do_not_depend_on_what_is_popular(spark, monkeypatch):
    """shingles of a passage in most texts come last in the order; odd rows pair as they are."""
    import random

    from tessera.operators import matching

    r = random.Random(4)
    passage, rows = [f"p{i}" for i in range(30)], []
    for k in range(40):
        own = [f"w{r.randrange(50)}" for _ in range(r.choice([2, 8, 25, 60]))]
        for _ in range(3):
            words = list(own)
            words[r.randrange(len(words))] = f"x{r.randrange(3)}"
            rows.append((len(rows), f"s{k % 2}", " ".join(words + passage * (k % 4 > 0))))
    rows += [(5, "s0", rows[7][2] + " z"), (5, "s1", rows[7][2]), (6, "s0", rows[5][2]), (None, "s0", rows[8][2] + " z"), (900, None, rows[9][2])]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))}
    first = {}
    for i, s, t in rows:
        if i is not None and s is not None:
            first[s, t] = min(i, first.get((s, t), i))
    own = [(i, s, t, shingles(t)) for (s, t), i in first.items()]
    want = sorted((s, i, j) for i, s, t, x in own for j, q, u, y in own if s == q and i < j and 4 * len(x & y) >= 3 * len(x | y))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for one_in in (1, 10**6):
        monkeypatch.setattr(matching, "ONE_IN", one_in)
        assert len(matching._popular(docs)) > 20 or one_in > 1
        assert sorted(tuple(x) for x in near_pairs(docs, "source").collect()) == want


def test_shingles_of_odd_texts():
    """Words end at Unicode white space, not at the separators from 1C to 1F; few words are one shingle, and sets don't depend on what is hashed beside."""
    from tessera.operators import matching

    odd = ["", " \u2003 ", "a b", "a\x1cb c", "a c\u00a0d\u3000e f g", "a c d e f", "c d e f g", "a b a b a b a b"]
    sets = [set(x.tolist()) for x in matching._shingle_sets(odd)]
    assert matching._words(odd[3]) == ["a\x1cb", "c"] and [len(x) for x in sets] == [0, 0, 1, 1, 2, 1, 1, 2]
    assert sets[4] == sets[5] | sets[6] and len(sets[2] | sets[3]) == 2
    big = [" ".join(f"w{i * k}" for i in range(400)) for k in range(9)]
    alone = [matching._shingle_sets([t])[0].tolist() for t in big]
    old, matching.AT_ONCE = matching.AT_ONCE, 3000
    try:
        assert [x.tolist() for x in matching._shingle_sets(big)] == alone
    finally:
        matching.AT_ONCE = old


def test_distance_within_a_band_is_the_whole_one():
    import random

    from tessera.operators import matching

    r = random.Random(2)
    for _ in range(400):
        a = "".join(r.choice("abc") for _ in range(r.randrange(15, 70)))
        b = list(a)
        for _ in range(r.randrange(9)):
            b[r.randrange(len(b))] = r.choice(["", "ab", "d"])
        b = "".join(b) or "a"
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        whole = _distance(a, b)
        for most in (1, 2, 4, 7, 11):
            if len(a) - len(b) <= most < len(a):
                assert matching._banded(a, b, most) == (whole if whole <= most else None)
    pairs = []
    for k in range(300):
        a = "".join(r.choice("abcd") for _ in range(r.choice([1, 30, 200, 700, 900])))
        b = list(a)
        for _ in range(r.randrange(1 + len(a) // (3 if k % 2 else 12))):
            b[r.randrange(len(b))] = r.choice(["", "ab", "\U0001f600"])
        pairs.append((a, "".join(b) or "d"))
    want = [_distance(a, b) for a, b in pairs]
    assert matching._distances(*map(list, zip(*pairs, strict=True))) == want and max(want) > 127
    held = [((a, b) if len(a) >= len(b) else (b, a)) for a, b in pairs]
    for words in (1, 2, 3):
        own = [(p, d) for p, d in zip(held, want, strict=True) if len(p[0]) - len(p[1]) < 32 * words]
        got = matching._near_diagonal([p[0] for p, _ in own], [p[1] for p, _ in own], words)
        assert got.tolist() == [min(d, 32 * words) for _, d in own]
    long = "".join(r.choice("abcdefgh") for _ in range(9000))
    assert _distance(long, "x" + long[:3000] + "yy" + long[3001:] + "z") == 4
    assert _distance(long, long[::-1]) == _distance(long[::-1], long) > 2048


def test_pairs_left_out_fetch_no_texts(spark):
    """near_dup_greedy fetched and compared the texts of pairs within one half, too."""
    from pathlib import Path

    from tessera.operators.matching import near_texts
    from tessera.operators.relational import shared_dir

    long = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i, "s", f"{long} e{i}") for i in range(4)], "doc_id long, source string, text string")
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    got = near_texts(docs, "source", only=lambda pairs: pairs.where("a = 1"))
    assert sorted((x.a, x.b, x.x, x.y) for x in got.collect()) == [(1, b, f"{long} e1", f"{long} e{b}") for b in (2, 3)]
    new = [spark.read.parquet(str(d)) for d in set(shared.iterdir()) - before]
    assert [sorted(x.doc_id for x in d.collect()) for d in new if "text" in d.columns] == [[1, 2, 3]]
