import numpy as np
import pytest

from plumbline.llm import whitening as H
from plumbline.llm.store import Scratch


def reference(vectors):
    """x, whole deviations, eigenvalues and vectors, all with numpy over all rows."""
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    d = [[n * a - b for a, b in zip(row, s, strict=True)] for row in x]
    c = np.array([[a / n for a in row] for row in d])
    values, basis = np.linalg.eigh(c.T @ c / n)
    return n, [sum(a * a for a in row) for row in d], c, values[::-1], basis[:, ::-1]


def check(rows, got, most=8):
    """rows: (id, vector), ids told apart, all fit."""
    n, dev, c, values, basis = reference([v for _, v in rows])
    kept = int((values > 1e-12 * values.sum()).sum())
    k = min(most, kept)
    assert len(got) == k * n and {r.n for r in got} <= {n}
    w = np.zeros((n, k))
    place = {i: j for j, (i, _) in enumerate(rows)}
    for r in got:
        assert r.deviation == dev[place[r.vec_id]]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        w[place[r.vec_id], r.component - 1] = r.whitened
    want = c @ basis[:, :k] / np.sqrt(values[:k])
    for j in range(k):
        sign = np.sign(w[:, j] @ want[:, j])
        assert np.allclose(w[:, j], sign * want[:, j], atol=1e-6), j
    errors = {r.identity_error for r in got}
    centred = w - w.mean(axis=0)
    assert len(errors) == 1 and max(errors) <= 1e-8
    assert np.abs(centred.T @ centred / n - np.eye(k)).max() <= 1e-8


def run(spark, rows, kind="array<double>", **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding {kind}, component int")
    return H.whiten(df, Scratch(spark), **more).collect()


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in df.collect()], H.whiten(df, Scratch(spark)).collect())


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    for d, n in ((3, 40), (12, 200), (9, 5)):
        v = rng.normal(size=(n, d)) * np.arange(1, d + 1)
        check([(i, x.tolist()) for i, x in enumerate(v)], run(spark, [(i, x.tolist()) for i, x in enumerate(v)]))
    v = rng.normal(size=(60, 4)) * [1, 2, 3, 4]
    check([(i, x.tolist()) for i, x in enumerate(v)], run(spark, [(i, x.tolist()) for i, x in enumerate(v)], components=2), most=2)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (1, [-3.0, 0.5]), (2, [4.0, -1.0]), (3, [1.0, 2.0])]
    odd = [(4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0]), (10, [1.0, 2.0, 3.0])]
    check(good, run(spark, good + odd))
    # repeated and null ids are fitted and returned
    again = run(spark, [*good, (0, [1.0, 2.0]), (None, [7.0, 7.0])])
    assert sorted(repr(r.vec_id) for r in again) == sorted([x for x in ("0", "0", "1", "2", "3", "None") for _ in range(2)])
    assert {r.n for r in again} == {6}
    # no variance, one row, nothing
    assert run(spark, [(i, [2.0, 2.0]) for i in range(5)]) == run(spark, good[:1]) == run(spark, odd[:5]) == []
    # a constant dimension gives one component less
    assert {r.component for r in run(spark, [(i, [float(i * i % 7), 3.0]) for i in range(20)])} == {1}


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (1e12 * x).tolist()) for i, x in enumerate(rng.normal(size=(30, 3)))]
    n, dev, *_ = reference([v for _, v in rows])
    got = run(spark, rows)
    assert all(r.deviation is None for r in got) and min(dev) > 1 << 63
    s = H.Sums(30, [0, 0, 0], 1 << 60)
    assert H.deviations(np.array([[1 << 59, -(1 << 60), 3]]), s).tolist() == [[30 << 59, -(30 << 60), 90]]
    assert H.squared(np.array([[1 << 30, 1]])) == [(1 << 60) + 1] and H.squared(np.array([[1 << 40, 1]], object)) == [None]
    tame = [(i, (1e4 * x).tolist()) for i, x in enumerate(rng.normal(size=(50, 6)))]
    check(tame, run(spark, tame))
    # beyond the bound that entries are held in
    assert len(run(spark, [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 5.0])])) > 0


def test_vectors_of_floats(spark):
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 10)).astype(np.float32))]
    check(rows, run(spark, rows, "array<float>"))
