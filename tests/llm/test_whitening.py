"""Whitening against numpy on the whole fixture, exact deviations, and odd inputs."""

import numpy as np
import pytest

from tessera.llm import whitening as w


def brute(rows, most=4):
    """(rows by position) of component figures, of the kept rows, all of one length."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], dtype=object)
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    centred = ((n * fit - total) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    z = ((n * x - total) / n).astype(float) @ vectors[:, order] / np.sqrt(values[order])
    return kept, n, [int(v) for v in ((n * x - total) ** 2).sum(axis=1)], z, values[order] / values.sum()


def check(rows, got):
    kept, n, deviation, z, explained = brute(rows)
    assert len(got) == len(kept) * z.shape[1]
    by_row = {}
    for r in got:
        assert r.n == n and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
        by_row.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened))
    sign = None
    for (i, _), d, own in zip(kept, deviation, z, strict=True):
        have = np.array([v for _, v in sorted(by_row[i, d])])[: len(own)] if len(by_row[i, d]) == len(own) else None
        if have is not None and sign is None and np.abs(own).min() > 1e-3:
            sign = np.sign(have / own)
        if have is not None and sign is not None:
            assert np.allclose(have, own * sign, atol=1e-7)
    assert sign is not None


def test_fixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check([(r.vec_id, list(r.embedding)) for r in df.collect()], w.op12_whitening(spark, "/root/testdata/sf0.01").collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=6) * [9, 7, 5, 3, 2, 1]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(None, rows[5][1]), (7, rows[7][1]), (8, None), (9, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (10, [float("nan")] * 6), (11, [float("inf")] + [0.0] * 5), (12, [-0.0] * 6)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, z int")
    got = w.whiten(w.whole_vectors(df)).collect()
    check([r for r in rows if r[0] is not None], [r for r in got if r.vec_id is not None])
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 7 for r in got) == 8


def test_lengths_no_spread_and_large_values(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0]), (4, [3.0]), (5, []), (6, [4e11, 0.0, 1.0]), (7, [-4e11, 0.0, 2.0]), (8, [1e30, 0.0, 0.0])]
    got = w.whiten(w.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    by = {(r.vec_id, r.component): r for r in got}
    assert sorted(by) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (6, 1), (6, 2), (6, 3), (7, 1), (7, 2), (7, 3)]
    assert by[1, 1].whitened is None and by[1, 1].explained == 0.0 and by[1, 1].deviation == 0 and by[1, 1].n == 1
    assert abs(by[3, 1].whitened) == pytest.approx(1) and by[3, 1].deviation == 512**2 and by[3, 1].explained == 1.0
    assert by[6, 1].deviation is None and abs(by[6, 1].whitened) == pytest.approx(1) and by[6, 3].whitened is None


def test_empty(spark):
    assert w.whiten(w.whole_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))).count() == 0
