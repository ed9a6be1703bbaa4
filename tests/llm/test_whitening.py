"""Whitening against eigenvectors of the whole covariance."""

import numpy as np
import pytest

from chronofold.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, x int, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "clash") for i, v in rows], SCHEMA)


def brute(rows, k):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in kept}))
    n, s = len(fit), fit.sum(0)
    cov = np.cov(fit.T.astype(float), bias=True)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(k)])
    return {(i, c + 1): (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)), ((x - s / n) @ v[:, c]) / e[c] ** 0.5, e[c] / np.trace(cov)) for i, x in kept for c in range(k)}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 12)) @ rng.normal(size=(12, 12)) * 0.3 + rng.normal(size=12) * 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, rows[0][1]) for i in range(2000, 2300)]  # a third of all rows are copies
    return rows + [(3000, None), (3001, []), (3002, [None] * 12), (3003, [float("nan")] * 12), (3004, [float("inf")] * 12)]


def test_same_as_the_whole_covariance(spark, rows):
    want = brute(rows, 4)
    for df in (frame(spark, rows).coalesce(1), frame(spark, rows).repartition(23)):
        got = wh.whiten(df).collect()
        assert len(got) == len(want) == len({(r.vec_id, r.component) for r in got})
        for r in got:
            n, deviation, w, share = want[r.vec_id, r.component]
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert abs(r.whitened - w) < 1e-9 and abs(r.explained - share) < 1e-12 and r.identity_error < 1e-9


def test_merging_loses_nothing(spark):
    """States of 40 parts, in three levels, against one decomposition; far from the origin, with a tiny dimension."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(4000, 6)) * [1e6, 1e4, 1e3, 100, 10, 3] + 1e9).astype(np.int64)
    parts = [wh.State.of_rows(p) for p in np.array_split(x, 40)]
    rows = [p.row(i) for i, p in enumerate(parts)]
    wh_in = spark.createDataFrame([tuple(r) for r in rows], wh._STATE)
    found = wh.State.from_row(*wh.merged(wh_in).select("n", "sums", "singular", "vectors").first())
    exact = np.linalg.svd(wh.centre(x, len(x), wh.exact_sums(x)), compute_uv=False)
    assert found.n == 4000 and found.sums == [int(v) for v in x.sum(0)]
    assert np.allclose(found.singular, exact, rtol=1e-9, atol=0)


def test_exact_beyond_64_bits():
    x = np.array([[1 << 61, -(1 << 61)], [5, 7], [-(1 << 60), 3]], np.int64)
    sums = wh.exact_sums(x)
    assert sums == [sum(int(r[i]) for r in x) for i in (0, 1)]
    assert [int(v.as_py()) for v in wh.deviations(np.array([[10**7, 3]]), 10**6, [1, 2])] == [(10**13 - 1) ** 2 + (3 * 10**6 - 2) ** 2]
    assert wh.deviations(x, 3, sums)[0].as_py() == sum((3 * int(a) - b) ** 2 for a, b in zip(x[0], sums))


def test_odd_tables(spark):
    assert wh.whiten(frame(spark, [])).collect() == []
    assert wh.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert wh.whiten(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []
    line = wh.whiten(frame(spark, [(None, [0.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0])])).collect()
    assert sorted((r.vec_id is None, r.component, r.n, round(r.whitened, 9), round(r.explained, 9)) for r in line) == [(False, 1, 2, 1.0, 1.0)] * 2 + [(True, 1, 2, -1.0, 1.0)]
