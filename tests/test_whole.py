"""Queries that must answer for every row of a table, against brute force or known counts."""

import numpy as np
import pytest

from plumbline.operators import engine as E
from plumbline.operators import filters, search
from plumbline.plans import decide, estimate, ingest, ordered, streams
from plumbline.plans.base import samples

SMALL = "/root/testdata/sf0.001"


def test_ellipse_of_every_sample(spark):
    """Each sample has its outlines, and they are those of its covariance's eigenvectors."""
    rows = estimate.covariance_ellipse(spark, SMALL).toPandas()
    covs = estimate.covariances(spark, SMALL).toPandas().set_index("event_id")
    assert len(rows) == 160 * len(covs) and set(rows["event_id"]) == set(covs.index)
    for i, g in rows.groupby("event_id"):
        c = covs.loc[i]
        inverse = np.linalg.inv([[c.ee, c.en], [c.en, c.nn]])
        xy = g[["east", "north"]].to_numpy()
        assert np.allclose(np.sqrt(np.einsum("ij,jk,ik->i", xy, inverse, xy)), g["sigma"], atol=1e-3)


def test_every_match_is_searched(spark):
    """Each match has one reacquired centre, and three or four of the bearings 15 degrees apart."""
    ids = set(range(decide.matches(spark, SMALL).count()))
    assert {r.event_id for r in decide.matches(spark, SMALL).select("event_id").collect()} == ids
    centres = [r.event_id for r in decide.local_reacquisition(spark, SMALL).collect()]
    assert len(centres) == len(ids) and set(centres) == ids
    bands = decide.azimuth_band(spark, SMALL).groupBy("event_id").count().collect()
    assert {r.event_id for r in bands} == ids and {r["count"] for r in bands} <= {3, 4}


@pytest.mark.parametrize(("second", "mode", "offset"), [(0.93, "terrain_update_accepted", 0.0), (0.85, "terrain_physical_gate_fallback:speed_jump", 90.0)])
def test_second_peak_is_tried(monkeypatch, second, mode, offset):
    """The best cell is too far from the last fix: the next peak is taken if its score is within 0.08, else none."""

    def heat(w, h, scale):
        x = np.full((len(h), *w.shape[:2]), 0.1)
        x[0, 0, 3], x[0, 0, 0] = 0.95, second
        return x

    monkeypatch.setattr(search, "masked_scores", heat)
    cells = 600 + 100 * np.random.default_rng(3).normal(size=(200, 200))
    before = [0.0, 3000.0, 3000.0 + 19 * 30 - 30, 30.0, 0.0]
    v = E.Vehicle(3000.0, 3000.0, 30.0, 0.0, fixes=[before])
    row = E.Engine(E.Raster(cells, 30.0), E.Settings(dt_s=0.2)).feed(v, [(k, 900.0 + 50 * (k % 2)) for k in range(20)])[0]
    assert (row["mode"], row["azimuth"], row["offset_m"], row["error"]) == (mode, 0.0, offset, None)
    assert [x[1:3] for x in v.fixes] == ([before[1:3], [3000.0, 3570.0]] if second == 0.93 else [before[1:3]])


def test_engine_searches_each_degree_and_two_kilometres():
    """A start 1500 m off the predicted one, on a bearing of 37 degrees, is found by the engine as it is registered."""
    rough = np.random.default_rng(5).normal(size=(400, 400))
    for axis in (0, 1):
        rough = np.apply_along_axis(lambda v: np.convolve(v, np.ones(5) / 5, "same"), axis, rough)
    terrain = E.Raster(600 + 400 * rough, 30.0)
    d = 1500 + 30.0 * np.arange(20)
    h = terrain.sample(3000 + d * np.sin(np.radians(37)), 3000 + d * np.cos(np.radians(37)))
    eng = E.Engine(terrain)
    v = E.Vehicle(3000.0, 3000.0, 30.0, 30.0, frames=[[k, eng.s.baro_m - float(x)] for k, x in enumerate(h)])
    m = eng.choose(v).match
    assert abs(m.azimuth - 37) < 0.5 and abs(m.offset_m - 1500) < 15 and m.peak > 0.999 and not m.ambiguous
    eng = E.Engine(terrain)
    assert list(eng.azimuths) == list(range(360)) and eng.s.offsets * eng.s.spacing_m <= 2000 < (eng.s.offsets + 1) * eng.s.spacing_m


def test_scores_with_gaps():
    """Against the definition, one window at a time."""
    rng = np.random.default_rng(8)
    ray, h = 1250 + 300 * rng.normal(size=(5, 30)), 1250 + 100 * rng.normal(size=8)
    ray[rng.random(ray.shape) < 0.2], h[3], ray[4, :12] = np.nan, np.nan, 1300.0
    w = np.lib.stride_tricks.sliding_window_view(ray, 8, axis=1)
    got = E.masked_scores(w, h, 100.0)
    for i, j in np.ndindex(got.shape):
        ok = np.isfinite(w[i, j]) & np.isfinite(h)
        a, b = w[i, j][ok], h[ok]
        if ok.sum() < 4:
            assert np.isnan(got[i, j])
            continue
        ncc = np.corrcoef(a, b)[0, 1] if a.std() > 0 else 0.0
        assert got[i, j] == pytest.approx(0.5 * ncc + 0.5 / (1 + ((a - b) ** 2).mean() / 100), abs=1e-9)


def test_truth_by_place_in_the_whole_list(spark):
    """Estimate k has the truth of place k, the last one beyond the end."""
    truth, est = ordered.truth_and_estimates(spark, SMALL)
    lat = [r.lat for r in truth.orderBy("idx").collect()]
    got = {r.idx: r.truth_lat for r in ordered.truth_clamped_join(spark, SMALL).collect()}
    assert len(lat) > 100 and got == {r.idx: lat[min(r.idx, len(lat) - 1)] for r in est.collect()}


def test_all_readings_are_merged(spark):
    s = samples(spark, SMALL).toPandas()
    s["w"] = 1 / np.maximum(s["event_id"] % 50, 1e-6)
    want = s.groupby("user_id")[["value", "w"]].apply(lambda g: np.average(g["value"], weights=g["w"]))
    got = {r.user_id: r.px for r in estimate.federated_fusion(spark, SMALL).collect()}
    assert set(got) == set(want.index) and all(got[u] == pytest.approx(x, abs=2e-5) for u, x in want.items())


def test_every_sentence_and_upload(spark):
    s = samples(spark, SMALL)
    valid = {r.event_id for r in s.where("valid").select("event_id").collect()}
    assert {r.event_id for r in streams.stream_sentences(spark, SMALL).collect()} == valid
    names = {r.event_id: r.name for r in ingest.upload_manifest(spark, SMALL).collect()}
    assert names == {r.event_id: f"log_{r.event_id}.nmea" for r in s.select("event_id").collect()}


def test_many_tracks_step_as_single_ones():
    """Vehicles filtered together, in parts of any size, give what each gives alone."""
    rng = np.random.default_rng(2)
    key = np.repeat([3, 5, 9], [40, 1, 17])
    east, north, speed, heading = (rng.normal(size=len(key)) * s for s in (100, 100, 10, 360))
    cov = np.stack([np.diag(rng.uniform(1, 50, 2)) for _ in key])
    want = {name: [] for name in ("east", "north", "speed", "heading", "hdop", "mode")}
    for k in (3, 5, 9):
        mix = filters.ModelMix()
        for i in np.flatnonzero(key == k):
            g = mix.step(east[i], north[i], speed[i], heading[i], cov[i], 2.0)
            for name, v in want.items():
                v.append(g[name])
    for cut in ([58], [10, 30, 41, 50, 58], list(range(1, 59))):
        mixes, got, a = filters.TrackMixes(2.0), {name: [] for name in want}, 0
        for b in cut:
            g = mixes.feed(key[a:b], *(v[a:b] for v in (east, north, speed, heading)), cov[a:b])
            for name, v in got.items():
                v.extend(g[name].tolist())
            a = b
        assert got["mode"] == want["mode"]
        for name in ("east", "north", "speed", "heading", "hdop"):
            assert np.allclose(got[name], want[name], atol=1e-7), name
