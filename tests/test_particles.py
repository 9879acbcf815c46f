"""The particle search of many vehicles at once against one vehicle's filter, window by window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import filters, particles
from plumbline.operators.search import Raster
from plumbline.plans.base import samples
from plumbline.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def alone(key, ids, agl, terrain):
    rng, f, n, heading = np.random.default_rng(key), filters.Inertial(), 200, float(key * 40 % 360)
    centre, b = np.array([900.0, terrain.cells.shape[0] * terrain.cell / 2]), np.radians(heading)
    parts, w = centre + rng.normal(0, 200, (n, 2)), np.full(n, 1 / n)
    for k in range(0, len(agl) - 19, 10):
        f.predict(*filters.level_imu(heading, heading, 10.0), 10.0)
        f.altitude(0.0, 8.0)
        parts = parts + 3.0 * np.array([np.sin(b), np.cos(b)]) + rng.normal(0, 10, (n, 2))
        profile, entropy, agreed, spread = 1500 - agl[k : k + 20], np.log(n), False, None
        ok = np.isfinite(profile)
        if ok.sum() >= 10 and np.nanstd(profile) >= 1e-6:
            d = np.arange(20)[ok] * 3.0
            seen = terrain.sample(parts[:, :1] + d * np.sin(b), parts[:, 1:] + d * np.cos(b))
            w = filters.particle_weights(w, seen - profile[ok], 100.0)
            mean = w @ parts
            cov = np.einsum("i,ij,ik->jk", w, parts - mean, parts - mean) + np.eye(2) * 1e-9
            entropy, spread = float(-(w * np.log(np.maximum(w, 1e-300))).sum()), float(np.trace(cov))
            agreed = spread < 50_000 and entropy < 0.75 * np.log(n)
            if agreed:
                f.position(parts[int(w.argmax())] - centre, cov + np.eye(2))
            if 1 / (w * w).sum() < 0.6 * n:
                parts, w = parts[filters.resampled(w, float(rng.random()))], np.full(n, 1 / n)
        yield key, k // 10, int(ids[k]), int(ids[k + 19]), "terrain_particle_update" if agreed else "inertial_prediction", entropy, spread, *map(float, f.p)


@pytest.mark.parametrize("rows", [10_000, 23])
def test_many_vehicles_are_as_each_alone(spark, rows):
    """Also with batches that end within vehicles, and with vehicles of very unlike lengths."""
    # a steep plane, and a vehicle whose heights are those at its start, so that its particles agree
    north, east = np.mgrid[199:-1:-1, 0:64] * 30.0
    terrain, s = Raster(np.where((north + east) % 1110, 4 * (north + east - 3900.0), np.nan), 30.0), samples(spark, SF)
    s = s.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 3).otherwise(F.col("user_id") + 3)).withColumn("agl", F.when(F.col("user_id") == 1, F.col("agl") / 20 + 1490).otherwise(F.col("agl")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {r[:2]: tuple(r) for r in particles.search(s, terrain).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = []
    for key, group in s.select("user_id", "event_id", "ts", "agl").toPandas().groupby("user_id"):
        h = group.sort_values(["ts", "event_id"])
        wanted += list(alone(int(key), h["event_id"].to_numpy(), h["agl"].to_numpy(float), terrain))
    assert len(got) == len(wanted) > 30 and any(w[4] == "terrain_particle_update" for w in wanted)
    for w in wanted:
        g = got[w[:2]]
        assert g[:5] == w[:5] and (g[6] is None) == (w[6] is None)
        assert np.allclose([x or 0.0 for x in g[5:]], [x or 0.0 for x in w[5:]], rtol=1e-9, atol=2e-6)


def test_windows_of_vehicles_are_stepped_together(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    class Counted(particles.Swarms):
        def step(self, at, agl):
            seen.add(1)
            return super().step(at, agl)

    monkeypatch.setattr(particles, "Swarms", Counted)
    n = QUERIES["eskf_engine"](spark, "/root/testdata/sf0.01").count()
    assert n > 500 and 0 < seen.value < n / 3
