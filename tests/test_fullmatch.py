"""The one-pass match against plain definitions over the whole heatmap."""

import math

import numpy as np
import pytest

from plumbline.operators import fullmatch as M
from plumbline.operators import match
from plumbline.operators.features import both_scores

STEP = 30.0


def reference(profiles, h, scale):
    """Figures by their definitions, cell by cell."""
    w = np.lib.stride_tricks.sliding_window_view(profiles, len(h), axis=1)
    ncc, msd = both_scores(w, h, scale)
    heat = 0.5 * ncc + 0.5 * msd
    n, m = heat.shape
    row, col = np.unravel_index(int(heat.argmax()), heat.shape)
    peak = heat[row, col]
    way = np.minimum((np.arange(n) - row) % n, (row - np.arange(n)) % n)[:, None] + np.zeros((1, m))
    across = np.abs(np.arange(m) - col)[None] + np.zeros((n, 1))

    def tops(radius):
        out = np.zeros(heat.shape, bool)
        for i, j in np.ndindex(heat.shape):
            rows = np.unique(np.arange(i - radius, i + radius + 1) % n)
            out[i, j] = heat[i, j] == heat[rows, max(0, j - radius) : j + radius + 1].max()
        return out

    near, lobe = (way <= 5) & (across <= 3), (way <= 3) & (across <= 3)
    side = heat[~near]
    rivals = tops(3) & (heat >= peak - max(abs(peak) * 0.2, 1e-9))
    rivals[row, col] = False
    out = {"az": row, "off": col, "score": peak, "ncc": ncc[row, col], "msd": msd[row, col], "n_peaks": int(rivals.sum()) + 1, "to_mean": peak / max(abs(heat.mean()), 1e-9)}
    out["confidence"] = max(peak - side.max(), 0) if side.size else peak
    out["to_side"] = peak / max(side.std() if side.size else 0, 1e-9)
    rest = heat[~lobe]
    out["pslr_db"] = 20 * math.log10(peak / max(abs(rest.max() if rest.size else 1e-10), 1e-10))
    out["isolation_m"] = min((math.hypot((j - col) * STEP, way[i, j] * STEP * m * math.pi / 180) for i, j in np.argwhere(rivals)), default=None)
    cells = sorted((-heat[i, j], i, j) for i, j in np.argwhere(tops(2)))[:8]
    return out, [(i, j) for _, i, j in cells]


@pytest.mark.parametrize(("n", "rows", "fold"), [(300, 32, 3), (257, 256, 512), (33, 32, 2), (40, 8, 2), (7, 256, 512), (3, 256, 512), (1, 4, 2)])
def test_blocks_give_the_whole(spark, monkeypatch, n, rows, fold):
    """Blocks of any size, with a last one shorter than a halo, and fewer azimuths than a halo has."""
    monkeypatch.setattr(M, "ROWS", rows)
    monkeypatch.setattr(M, "FOLD", fold)
    rng = np.random.default_rng(n)
    profiles = np.cumsum(rng.normal(size=(n, 40)), axis=1)
    at = (n - 1, 7) if n % 2 else (0, 0)
    h = profiles[at[0], at[1] : at[1] + 24] + rng.normal(0, 0.05, 24)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(profiles)], "az int, profile array<double>")
    got = M.full_match(df, spark.createDataFrame([(h.tolist(),)], "h array<double>"), 1.0, STEP).collect()
    want, candidates = reference(profiles, h, 1.0)
    assert len(got) == 1
    r = got[0]
    for name, x in want.items():
        # of no side at all the ratio is that to the smallest spread
        assert r[name] == (pytest.approx(x, rel=1e-6, abs=1e-9) if x is not None else None), name
    assert (r.az, r.off) == at and [(c.az, c.off) for c in r.candidates] == candidates
    assert r.ambiguous == (want["pslr_db"] < 3 or want["n_peaks"] > 2)


def test_plateaus_and_nothing(spark):
    """Equal rows: every cell of a plateau is a maximum; the first one is the peak. No row: no result."""
    flat = spark.createDataFrame([(i, [1.0, 3.0, 1.0, 3.0, 1.0, 3.0]) for i in range(20)], "az int, profile array<double>")
    h = spark.createDataFrame([([1.0, 3.0, 1.0],)], "h array<double>")
    r = M.full_match(flat, h, 1.0, STEP).first()
    assert (r.az, r.off) == (0, 0) and r.n_peaks == 40 and len(r.candidates) == 8 and r.confidence == 0 and r.isolation_m == pytest.approx(STEP * 4 * math.pi / 180)
    assert M.full_match(flat.limit(0), h, 1.0, STEP).count() == 0


@pytest.mark.parametrize(("n", "block"), [(40, 16), (40, 256), (33, 8), (7, 3), (2, 256), (1, 256)])
def test_maxima_and_neighbours_in_blocks(spark, monkeypatch, n, block):
    """Blocks of any size give what whole columns of the heatmap give."""
    monkeypatch.setattr(match, "BLOCK", block)
    rng = np.random.default_rng(n)
    heat = np.round(rng.normal(size=(n, 9)), 1)
    cells = spark.createDataFrame([(i, j, None if (i * 9 + j) % 11 == 3 else float(heat[i, j])) for i in range(n) for j in range(9)], "az int, off int, score double")
    heat[np.arange(n * 9).reshape(n, 9) % 11 == 3] = -np.inf
    for radius in (2, 3):
        got = {(r.az, r.off) for r in match.local_maxima(cells, radius, n).collect()}
        want = {(i, j) for i, j in np.ndindex(heat.shape) if np.isfinite(heat[i, j]) and heat[i, j] == heat[np.arange(i - radius, i + radius + 1) % n, max(0, j - radius) : j + radius + 1].max()}
        assert got == want
    value = lambda i, j: None if not 0 <= j < 9 or not np.isfinite(heat[i % n, j]) else heat[i % n, j]
    for r in match.with_neighbours(cells, n).collect():
        assert (r.o0, r.o1, r.a0, r.a1) == (value(r.az, r.off - 1), value(r.az, r.off + 1), value(r.az - 1, r.off), value(r.az + 1, r.off))
