"""Corpus operators on small fixtures: null, empty, long, repeated and clashing inputs, and brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, gru_lm, hilbert_shards, langid, licenses, minhash, quality, sentencepiece_table, suffix_dedup, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, removed string"
WORDS = [f"w{i * 7919 % 1000}" for i in range(400)]
LONG = " ".join(WORDS)


def _rows():
    texts = [None, "", " ", "a", "Released under the MIT License.", LONG, LONG, " ".join(WORDS[:-3] + ["x", "y", "z"]), "é b　c ▁ <s>\x00", "x" * 5000, " ".join(WORDS[100:160]) + " tail of its own", "  a  b ", "Ünï " * 30]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), None, None) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id", "en", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "docs")
    spark.createDataFrame(_rows(), SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("1 = 0")


def test_sentencepiece(docs, none):
    import sentencepiece

    model = sentencepiece_table.read_model(sentencepiece_table.default_model())
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for r in sentencepiece_table.encode_decode(docs, model, table_size=3).collect():
        ids = sp.encode(r.text or "")
        assert list(r.piece_ids) == ids and r.piece_text == sp.decode(ids)
    assert sentencepiece_table.encode_decode(none, model).count() == 0


def test_suffix_dedup(docs, none, monkeypatch):
    rows = _rows()
    want = Counter(suffix_dedup.brute_force([r[1] for r in rows]))
    for hot in (500, 1):
        monkeypatch.setattr(suffix_dedup, "MOST_SPANS", hot)
        got = suffix_dedup.digests(suffix_dedup.remove_repeats(docs)).collect()
        assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_run_index():
    """Matching statistics streamed from run ends equal those by comparison; runs are fewer than codes in repetitive text."""
    rng = np.random.default_rng(1)
    base = rng.integers(97, 100, 40)
    texts = [np.r_[base, rng.integers(97, 100, 9)], np.r_[rng.integers(97, 100, 5), base], base, base]
    codes = np.concatenate([np.r_[t, 256 + i] for i, t in enumerate(texts)])
    index = suffix_dedup.RunIndex(codes)
    assert index.length.sum() == len(codes) and len(index.head) < 0.7 * len(codes)
    n = len(codes)
    want = [max(next((k for k in range(n) if i + k >= n or j + k >= n or codes[i + k] != codes[j + k]), n) for j in range(n) if j != i) for i in range(n)]
    assert suffix_dedup.matching_statistics(index, codes, 25).tolist() == [min(w, 25) for w in want]


@pytest.mark.parametrize("most", [3, 20])
def test_suffix_dedup_around_a_hot_line(spark, monkeypatch, most):
    """A line of 150 bytes in many texts, whose surroundings repeat in parts of different lengths."""
    monkeypatch.setattr(suffix_dedup, "MOST_SPANS", most)
    rng = np.random.default_rng(3)
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    line, left, right = noise(150), noise(300), noise(300)
    texts = [noise(300) + left[len(left) - int(i) :] + line + right[: int(j)] + noise(300) for i, j in rng.integers(0, 120, (60, 2))]
    texts += [t[250:700] for t in texts[:10]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffix_dedup.digests(suffix_dedup.remove_repeats(docs)).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(suffix_dedup.brute_force(texts))


def test_near_duplicates(docs, none):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    rows = [r for r in _rows()]
    least = {}
    for a in rows:
        x = shingles(a[1])
        linked = [b[0] for b in rows if b[0] is not None and x and 100 * len(x & shingles(b[1])) >= 75 * len(x | shingles(b[1]))]
        least[a[0]] = min([i for i in [a[0], *linked] if i is not None], default=None)
    for i, n, comp, kept in got:
        text = next(r[1] for r in rows if r[0] == i)
        assert n == len(shingles(text)) and comp == least[i]
        assert i is None or kept == (comp == i)
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("stars, block", [((), 7), ((1,), 1024), ((1, 4), 16)])
def test_near_duplicates_of_unlike_families(spark, monkeypatch, stars, block):
    """Large buckets of texts that are mostly unlike: all links are found, whatever the stars leave to the sweep."""
    monkeypatch.setattr(minhash, "STARS", stars)
    monkeypatch.setattr(minhash, "SWEEP_BLOCK", block)
    rng = np.random.default_rng(11)
    texts = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(110)]
        for _ in range(50):
            words = list(base)
            for at in rng.integers(0, 110, rng.integers(1, 5)):
                words[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while any(least[i] != least[j] for i, j in links):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert len(set(least)) > 10 and max(Counter(least).values()) > 5
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == set(enumerate(least))


def test_shingle_hash_agrees_with_sets():
    texts = ["A b c d e f", "a b c d e f g", "", "q", "x  y"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    h, at = minhash.shingle_hashes(data, np.cumsum([0, *map(len, texts)]))
    sets = [set(h[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in sets] == [2, 3, 0, 1, 1] and len(sets[0] & sets[1]) == 2


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(WORDS[110:125])), (2, "A"), (3, None), (4, "!!"), (None, " ".join(WORDS[:10]))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(decontaminate.contained(docs, items)).collect()}
    assert got[10].n_hit == 15 and got[10].n_items == 1 and got[5].n_hit == 25 and got[5].n_items == 1
    assert got[3].n_hit == 1 and got[11].n_hit == 1 and not got[0].contaminated and got[0].n_words == 0
    assert decontaminate.contained(none, items).count() == 0
    assert decontaminate.contained(docs, items.where("1 = 0")).where("size(hits) > 0").count() == 0


def test_decontaminate_in_blocks_and_long_texts(spark):
    """Several blocks of windows give what one gives; a very long text is read whole."""
    rng = np.random.default_rng(4)
    pool = [f"v{i}" for i in range(30)]
    texts = [" ".join(rng.choice(pool, n)) for n in (5, 40, 300, 0)] + [None, " ".join(rng.choice(pool, 60_000))]
    long = texts[-1].split()
    items = [(1, " ".join(long[59_000:59_030])), (2, " ".join(long[7:12])), (3, " ".join(texts[2].split()[100:125])), (3, "zz yy"), (4, " ".join(texts[1].split()[:12]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def brute(text):
        w, hit, found = (text or "").split(), set(), set()
        for item, t in items:
            x = t.split()
            for win in {tuple(x[i : i + 10]) for i in range(max(1, len(x) - 9))}:
                for s in range(len(w) - len(win) + 1):
                    if w[s] == win[0] and tuple(w[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(item)
        return len(w), len(hit), len(found)

    want = {i: brute(t) for i, t in enumerate(texts)}
    for block in (50_000, 7):
        got = decontaminate.report(decontaminate.contained(docs, bench, block=block)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == want


def test_topk_in_blocks_and_bounds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-5, 6, 8).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, vec array<long>").repartition(3)
    one = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.topk(v, v.where("id % 10 = 0")).collect()}
    assert one == {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.topk(v, v.where("id % 10 = 0"), block=7).collect()} and len(one) == 300
    big = np.array([[2**31, 2**31]])
    assert topk._products(big, np.array([[2**20, 3]])).tolist() == [[2**51 + 3 * 2**31]]
    with pytest.raises(ValueError):
        topk._products(big, big)
    # Scores beyond 2**53 are told apart to the last digit.
    large = spark.createDataFrame([(0, [2**30, 1]), *[(i, [2**24, i]) for i in range(1, 30)]], "id long, vec array<long>")
    assert [r.vec_id for r in topk.topk(large, large.where("id = 0"), k=3).orderBy("rank").collect()] == [29, 28, 27]


def test_topk(spark):
    rows = [(i, [float((i * j) % 7) / 7 - 0.5 for j in range(1, 6)]) for i in range(250)] + [(300, None), (301, [None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 5), (None, [1.0] * 5), (400, [1.0]), (7, [0.5] * 5)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.topk(v, v.where("id % 100 = 0"), 10).collect()
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e and all(x is not None and x == x for x in e)]
    for q, e in ints:
        if q % 100 == 0:
            want = sorted(((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in ints if i != q and len(f) == len(e)))[:10]
            assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
    assert topk.topk(v.where("1 = 0"), v.where("1 = 0")).count() == 0


def test_hilbert(docs, none):
    out = hilbert_shards.shards(docs, ["lang", "n_chars"], ["doc_id"], 4).collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == 15 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert hilbert_shards.shards(none, ["lang", "n_chars"], ["doc_id"]).count() == 0
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    order = cells[np.argsort(hilbert_shards.hilbert_index(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_hilbert_places_against_brute_force(spark):
    """Cells by cut points, the curve's index and the exact rank of every row, equal rows included; clashing names raise."""
    rng = np.random.default_rng(9)
    rows = [(i % 70, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 8, (90, 2)))] + [(5, 3, 3)] * 12
    df = spark.createDataFrame(rows, "doc_id long, a long, b long")
    got = hilbert_shards.shards(df, ["a", "b"], ["doc_id"], 4, bits=3).collect()
    cells = {}
    for r in hilbert_shards.quantised(df, ["a", "b"], 3).collect():
        cells[r.a, r.b] = (r["_cell_0"], r["_cell_1"])
    index = {k: int(hilbert_shards.hilbert_index(np.array([v]), 3)[0]) for k, v in cells.items()}
    order = sorted((index[a, b], i, a, b) for i, a, b in rows)
    n = len(order)
    first = [-(-s * n // 4) for s in range(4)]
    want = Counter((i, a, b, p * 4 // n, p - first[p * 4 // n]) for p, (_, i, a, b) in enumerate(order))
    assert Counter((r.doc_id, r.a, r.b, r.shard, r.slot) for r in got) == want
    with pytest.raises(ValueError):
        hilbert_shards.shards(df.withColumnRenamed("b", "slot"), ["a"], ["doc_id"])


def test_licenses(spark, docs):
    assert {tuple(r.licenses) for r in licenses.recognise(docs).collect()} == {(), ("MIT",)}
    two = spark.createDataFrame([("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",)], "text string")
    assert licenses.recognise(two).first().licenses == []  # the rule's other sentences are missing


def test_language(docs, none, spark):
    text = {"en": "the quick brown fox and the lazy dog ", "de": "der schnelle braune fuchs und der faule hund "}
    known = spark.createDataFrame([(i, t * (1 + i % 3), g) for i in range(20) for g, t in text.items()], "doc_id long, text string, lang string")
    model = langid.train(known)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[5].lang_pred in text
    probe = spark.createDataFrame([(1, "the dog and the fox"), (2, "der hund und der fuchs"), (3, "\U0001f600\U0001f600 12"), (4, "\U00020000" * 40), (4, "the " * 50_000), (None, "fuchs")], "doc_id long, text string")
    rows = langid.identify(probe, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in rows if r.doc_id != 4) == [(0, "de"), (1, "en"), (2, "de"), (3, "und")]
    assert sorted(r.lang_pred for r in rows if r.doc_id == 4) in (["de", "en"], ["en", "en"])
    # The joined model gives what the arrays give.
    key = lambda r: (r.doc_id or 0, r.lang_pred, round(r.score, 6), round(r.bits or 0, 4))
    assert sorted(map(key, langid.identify(probe, model, cells=0).collect())) == sorted(map(key, rows))
    assert langid.train(none) is None and langid.identify(none, None).count() == 0 and langid.identify(none, model).count() == 0
    arrays = model.arrays()
    sums = arrays.probs[2][np.isin(arrays.keys[2] >> np.uint64(16), [ord("t")])].sum(0)
    assert (sums <= 1 + 1e-9).all()
    _, bounds = langid.fitted(known.unionByName(spark.createDataFrame([(99, "uno dos tres", "es")], known.schema)))
    assert set(bounds) <= {"en", "de", "es"}


def test_language_counts_are_kneser_ney(spark):
    """Lower orders count different characters in front, and a text's probability is the interpolated one."""
    texts = ["abracadabra", "banana band", "cabana"]
    model = langid.train(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    levels = {4: Counter(tuple(map(int, p[i : i + 4])) for p in map(langid.padded, texts) for i in range(len(p) - 3))}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    for n, level in levels.items():
        unpack = lambda k, n=n: tuple((k >> (16 * (n - 1 - i))) & 0xFFFF for i in range(n))
        assert {unpack(r.gram): r.n for r in model.levels[n].collect()} == dict(level)

    def p(g):
        if not g:
            return 1 / 65536
        d, ctx = model.discount[len(g)][0], [c for k, c in levels[len(g)].items() if k[:-1] == g[:-1]]
        if not ctx:
            return p(g[1:])
        return max(levels[len(g)][g] - d, 0) / sum(ctx) + min(d * len(ctx) / sum(ctx), 1) * p(g[1:])

    probe = langid.padded("bandana xab")
    want = -sum(math.log2(p(tuple(map(int, probe[i : i + 4])))) for i in range(len(probe) - 3)) / (len(probe) - 3)
    got = langid.identify(spark.createDataFrame([(1, "bandana xab")], "doc_id long, text string"), model).first()
    assert got.bits == pytest.approx(want, rel=1e-5)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in langid.op5_langid(spark, "/root/testdata/sf0.001").collect()}
    right = [got[r.doc_id].lang_pred == r.lang for r in docs.collect() if r.lang and r.text and got[r.doc_id].held_out and got[r.doc_id].lang_pred != "und"]
    assert len(right) > 20 and sum(right) >= 0.9 * len(right)


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    got = quality.classify(docs, labels, ~quality.held_out()).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.classify(none, labels, F.lit(True)).count() == 0


def test_quality_learns(spark):
    """Non-negative risk on two clouds of features: the prior is near the truth and held-out rows are told apart."""
    rng = np.random.default_rng(2)
    cloud = lambda n, at: (rng.normal(at, 1, (n, quality.FEATURES))).astype(np.float32)
    pos, unl = cloud(400, 0.7), np.concatenate([cloud(600, 0.7), cloud(1400, -0.7)])
    table = spark.createDataFrame([(x.tolist(),) for x in unl], "x array<float>").repartition(3)
    net, prior = quality.fit(pos.astype(float), table)
    assert 0.2 < prior < 0.45
    assert (net.score(cloud(500, 0.7)) >= 0.5).mean() > 0.9 and (net.score(cloud(500, -0.7)) < 0.5).mean() > 0.9


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(r.predicted, truth[r.doc_id]) for r in quality.op3_quality(spark, d).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(got) > 50 and np.mean([p == t for p, t in got]) >= 0.97


def test_gru(docs, none):
    rows = [r for r in _rows()]
    training = Counter()
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10:
            training.update(gru_lm.tokens(r[1]) + [b"\n"])
    n, v = sum(training.values()), len(training)
    got = gru_lm.score(docs, ~gru_lm.held_out()).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        ts = gru_lm.tokens(text) + [b"\n"]
        assert r.n_tokens == len(ts) and r.train_tokens == n and r.n_known == sum(training[t] > 0 for t in ts)
        assert r.base_score == pytest.approx(sum(math.log10((training[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
        assert r.score < 0
    assert gru_lm.score(none, F.lit(True)).count() == 0


def test_gru_gradient():
    rng = np.random.default_rng(3)
    net = gru_lm.Gru(gru_lm.Gru.start(rng.integers(1, 9, gru_lm.CLASSES * gru_lm.PER_CLASS).astype(float)))
    ids, target = rng.integers(64, 120, (5, 3)), rng.integers(64, 120, (5, 3))
    target[0, 0] = gru_lm.OTHER
    keep = np.ones((5, 3, 1), np.float32)
    keep[2, 1] = 0
    h = np.zeros((3, gru_lm.HIDDEN), np.float32)
    loss = lambda: -net.output(net.states(net.table()[ids], keep, h)[0].reshape(-1, gru_lm.HIDDEN), target.ravel())[0].sum()
    before = loss()
    # Adam's first step goes against the sign of every gradient: it must be the sign of the finite difference.
    old = {n: getattr(net, n).copy() for n, _ in net.SHAPES}
    net.learn(ids, keep, target, h, {"t": 0})
    new = {n: getattr(net, n).copy() for n, _ in net.SHAPES}
    for name in old:
        getattr(net, name)[...] = old[name]
    for name in "WbUVCc":
        moved = new[name] - old[name]
        for at in np.argsort(-np.abs(moved), axis=None)[:3]:
            value = getattr(net, name).reshape(-1)
            slope = []
            for d in (0.02, -0.02):
                value[at] += d
                slope.append(loss())
                value[at] -= d
            assert abs(slope[0] - slope[1]) < 2e-3 or np.sign(slope[0] - slope[1]) == -np.sign(moved.reshape(-1)[at])
    adam = {"t": 0}
    for _ in range(30):
        net.learn(ids, keep, target, h, adam)
    assert loss() < 0.7 * before


def test_gru_scores_against_brute_force(spark, docs):
    """Every token's probability computed alone, one document after the other, from the fitted parameters."""
    model = gru_lm.Model(docs, ~gru_lm.held_out())
    net = gru_lm.Gru(model.flat)
    counts = {r.token.encode(): r.n for r in model.counts.collect()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()

    def brute(text):
        h, last, out, n = np.zeros(gru_lm.HIDDEN), gru_lm.END, 0.0, gru_lm.HIDDEN
        for t in [*gru_lm.tokens(text), None]:
            x = net.E[last] @ net.W + net.b
            zr = sig(x[: 2 * n] + h @ net.U)
            h = (1 - zr[:n]) * np.tanh(x[2 * n :] + (zr[n:] * h) @ net.V) + zr[:n] * h
            i = model.words.index.get(t, -1) if t is not None else None
            last = gru_lm.END if t is None else int(model.words.slot[i])
            out += np.log10(softmax(h @ net.C + net.c)[last // gru_lm.PER_CLASS])
            if last == gru_lm.OTHER:
                out += np.log10(counts.get(t, 0) + 0.1) - model.log_other
            else:
                k = last // gru_lm.PER_CLASS
                out += np.log10(softmax(h @ net.O[k] + net.o[k])[last % gru_lm.PER_CLASS])
        return out

    texts = {r[0]: r[1] for r in _rows()}
    for r in gru_lm.scored(model).collect():
        assert r.score == pytest.approx(brute(texts[r.doc_id]), rel=1e-4)


def test_gru_cutoff_of_common_words(spark):
    """Words tied at the cutoff are left out together, and every row takes part in one round."""
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "token string, n long")
    assert gru_lm.commonest(counts, 2) == [("a", 5)] and gru_lm.commonest(counts, 3) == [("a", 5), ("b", 3), ("c", 3)]
    assert gru_lm.commonest(counts.where("n > 9")) == [] and len(gru_lm.commonest(counts, 4)) == 4


def test_pipeline_small(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    kept = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0 < out.count() <= kept
    empty = hashlib.sha256(b"").hexdigest()
    assert out.where(F.col("ids_sha256") == empty).count() == 0


def test_pipeline_tells_rows(spark, tmp_path):
    """Repeated rows, null ids and ids with two texts: no stage loses or mixes rows."""
    import corpus_pipeline

    rng = np.random.default_rng(5)
    word = lambda: bytes(rng.integers(97, 123, 6, dtype=np.uint8)).decode()
    a, b, c, d, e, f = (" ".join(word() for _ in range(80)) for _ in range(6))
    shared = " ".join(word() for _ in range(40))
    d, e = f"{d} {shared}", f"{shared} {e}"
    # g is like f, and f stands second under its id.
    g = f + " " + word()
    rows = [(1, a), (1, a), (None, b), (None, c), (None, c), (2, d), (2, e), (3, b[::-1]), (3, f), (4, g)]
    where = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, " ".join(c.split()[20:35])), (2, " ".join(d.split()[20:35]))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet")

    def texts(stage, table):
        return Counter((r.doc_id, r.text) for r in stage(spark, table, where).collect())

    assert texts(corpus_pipeline.quality, docs) == Counter(rows)
    one = [(1, a), (None, b), (None, c), (2, d), (2, e), (3, b[::-1]), (3, f)]
    assert texts(corpus_pipeline.near_dedup, docs) == Counter(one)
    few = docs.dropDuplicates()
    cut = texts(corpus_pipeline.suffix_dedup, few.where("doc_id is null or doc_id < 3"))
    assert len(cut) == 5 and cut.total() == 5 and all(shared not in t and len(t) > 400 for _, t in cut)
    assert {t for _, t in cut} >= {a, b, c}
    clean = texts(corpus_pipeline.decontaminate, docs)
    assert clean == Counter([r for r in rows if r[1] not in (c, d)])


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""


BSD3 = BSD + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DAMAGES."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
AGPL = GPL.replace("GNU General Public License as", "GNU Affero General Public License as")
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
GPL3_TEXT = """The GNU General Public License is a free, copyleft license for software and other kinds of works.

4. Conveying Verbatim Copies.

You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices of the absence of any warranty; and give all recipients a copy of this License along with the Program."""


def test_licenses_empty_and_long(spark, none):
    assert licenses.recognise(none).count() == 0
    long = "word " * 300_000 + ".\n\nReleased under the MIT License.\n" + "more " * 10
    got = licenses.recognise(spark.createDataFrame([(long, 1), (None, 2)], "text string, licenses int")).collect()
    assert [r.licenses for r in got] == [["MIT"], []]


def test_licenses_of_real_texts(spark):
    """Whole licence texts: unwrapped, wrapped at several widths, without blank lines, as comments and with CRLF."""
    import textwrap

    rows = []
    for name, text in (("MIT", MIT), ("GPL-3.0-or-later", GPL), ("BSD-2-Clause", BSD), ("BSD-3-Clause", BSD3), ("ISC", ISC), ("Apache-2.0", APACHE), ("MPL-2.0", MPL), ("AGPL-3.0-or-later", AGPL), ("Unlicense", UNLICENSE), ("GPL-3.0", GPL3_TEXT)):
        rows += [(name, text), (name, text.replace("\n\n", "\n"))]
        for width in (60, 70, 72, 78, 80):
            wrapped = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
            rows += [(name, wrapped), (name, "\n".join(" * " + x for x in wrapped.split("\n"))), (name, wrapped.replace("\n", "\r\n"))]
    # A notice of one line stays one between lines without full stops.
    rows += [("MIT", "A title\nReleased under the MIT License\nmore text")]
    got = licenses.recognise(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [(r.name, r.licenses) for r in got] == [(n, [n]) for n, _ in rows]
