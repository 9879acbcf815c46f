import numpy as np
import pytest

from plumbline.llm import embedding_dedup as E
from plumbline.llm.store import Scratch


def reference(rows, cosine=0.93):
    """All pairs of each label; rows: (id, vector, label). A list of (id, n_links, component_id, kept)."""
    fit = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    units = [np.array(v, float) / np.abs(v).max() / np.linalg.norm(np.array(v, float) / np.abs(v).max()) if label is not None and fit(v) else None for _, v, label in rows]
    by = {}
    for k, (_, v, label) in enumerate(rows):
        if units[k] is not None:
            by.setdefault((label, len(v)), []).append(k)
    links, part = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while part[x] != x:
            part[x] = x = part[part[x]]
        return x

    for ks in by.values():
        m = np.stack([units[k] for k in ks])
        a, b = np.nonzero(np.triu(m @ m.T >= cosine, 1))
        for i, j in zip(a, b, strict=True):
            links[ks[i]] += 1
            links[ks[j]] += 1
            part[find(ks[i])] = find(ks[j])
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, links[k], least.get(find(k)), i == least.get(find(k))) for k, (i, _, _) in enumerate(rows)]


def same(spark, rows, kind="array<double>", **more):
    got = E.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], f"vec_id long, embedding {kind}, label int, cell int"), Scratch(spark), **more).collect()
    want = reference(rows, more.get("cosine", 0.93))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    return got


def clustered(rng, n, d, groups, noise, labels=2):
    """Vectors around common centres: near copies, chains between them and lone ones."""
    centres = rng.normal(size=(groups, d))
    which = np.minimum(rng.geometric(0.3, n) - 1, groups - 1)
    vectors = centres[which] + noise * rng.normal(size=(n, d)) * rng.uniform(0, 1, (n, 1)) * np.linalg.norm(centres[which], axis=1)[:, None] / np.sqrt(d)
    return [(i, v.tolist(), int(which[i] % labels)) for i, v in enumerate(vectors)]


@pytest.mark.parametrize(("dims", "cell"), [(2, 3), (5, 40), (24, 3), (24, 1000)])
def test_equals_all_pairs(spark, monkeypatch, cell, dims):
    """Cores, shells and several blocks, many and few pivots."""
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(dims * 100 + cell)
    rows = clustered(rng, 500, dims, 12, 0.5)
    got = same(spark, rows, cell=cell)
    assert any(r.n_links > 20 for r in got) and (dims < 5 or any(r.n_links == 0 for r in got))


def test_other_cosines(spark):
    rows = clustered(np.random.default_rng(5), 300, 8, 10, 1.0)
    for cosine in (0.999, 0.5, 0.1):
        same(spark, rows, cosine=cosine, cell=20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.3, -0.4, 0.5]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (1, [9.0, 0.0, 0.0], 1), (2, v, None), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [0.3, None, 0.5], 1), (6, [nan, 1.0, 1.0], 1), (7, [inf, 1.0, 1.0], 1), (8, [], 1)]
    rows += [(9, v, 2), (10, [6e200, -8e200, 1e201], 2), (11, [3e-200, -4e-200, 5e-200], 2), (12, [0.3, -0.4], 1), (13, [0.6, -0.8], 1), (14, [-0.3, 0.4, -0.5], 1), (15, [-0.0, 0.0, 2.0], 3), (16, [0.0, -0.0, 1.0], 3)]
    rows += [(None, v, 1), (None, [1.0, 1.0, 1.0], 4), (None, [1.0, 1.0, 1.0], 4), (None, None, None)]
    same(spark, rows, cell=2)
    same(spark, rows)
    same(spark, [r for r in rows if r[0] is None])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert E.near_duplicates(df.limit(0), Scratch(spark)).count() == 0
    alone = {r.vec_id: r for r in E.near_duplicates(df.where("vec_id in (0, 9, 10)"), Scratch(spark), label=None).collect()}
    assert [alone[i].n_links for i in (0, 9, 10)] == [2, 2, 2] and all(r.component_id == 0 for r in alone.values())


def test_a_hot_group_is_not_compared(spark, monkeypatch):
    """Half of all rows are near copies: members of a core come into no comparison."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.02 * rng.normal(size=16)).tolist(), 0) for i in range(600)] + [(600 + i, rng.normal(size=16).tolist(), 0) for i in range(600)]
    got = same(spark, rows, cell=50)
    assert sum(r.n_links == 599 for r in got) >= 600 - 1
    block = E.Block(np.arange(3), np.eye(3), 0.5, False)
    assert not block.links.any() and not block.edges


def test_equal_rows(spark):
    same(spark, [(i % 50, [1.0, 2.0], 0) for i in range(300)], "array<float>", cell=10)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(map(tuple, E.near_duplicates(df, Scratch(spark), cell=60).collect())) == sorted(reference(rows))
