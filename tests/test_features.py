"""Kernels hold a block of reference rows at once, however long a batch is."""

import pytest

from plumbline.operators import features as K
from plumbline.plans.match import SCALE, measured, reference
from plumbline.plans.registry import ORACLES, QUERIES

from .oracle import connection

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.az, r.off, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("heat", [K.feature_heatmap, lambda r, m: K.kernel_heatmap(r, m, SCALE)])
def test_heatmaps_hold_a_block_at_once(spark, monkeypatch, heat):
    ref, h = reference(spark, SF).coalesce(1), measured(spark, SF)
    whole, real, most = rows(heat(ref.repartition(16), h)), K._windows, K.BLOCK

    def counted(column, n):
        assert len(column) <= most
        return real(column, n)

    assert ref.count() > most
    monkeypatch.setattr(K, "_windows", counted)
    assert rows(heat(ref, h)) == whole


def test_many_windows_meet_in_blocks(spark, monkeypatch):
    ref = reference(spark, SF)
    part = ref.where("az % 4 = 1").selectExpr("cast(az as bigint) window_id", "slice(profile, az % 33 + 1, 32) h")
    seen, real = spark.sparkContext.accumulator(0), K._best_of

    def counted(az, profiles, ids, h, scale):
        assert len(h) <= 60 and len(az) <= 240
        seen.add(1)
        return real(az, profiles, ids, h, scale)

    monkeypatch.setattr(K, "MANY", 16)
    monkeypatch.setattr(K, "_best_of", counted)
    got = {r.window_id: (r.az, r.off, round(r.score, 9)) for r in K.kernel_best(ref, part, SCALE).collect()}
    assert got == {i: (i, i % 33, 1.0) for i in range(1, ref.count(), 4)} and seen.value > 8


def test_features_are_those_of_the_sql_to_the_sign_of_zero(spark, tmp_path):
    """Compared as texts, in which -0.0 is not 0.0: rows with zeros of both signs, short and empty ones, nulls, NaN and infinity."""
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0], [1.0, 2.0, 4.0], [1.0, 2.0, 4.0, 9.0], [1.0] * 6, [0.1] * 7, [None] * 6, [1.0, 4.0, 2.0, 8.0, 5.0], [1.0, None, 3.0, 7.0, 5.0, 2.0, 8.0, 1.0, 0.0, 3.0]]
    odd += [[nan, None, 3.0, 7.0, 5.0, 2.0, 8.0, 1.0, 0.0, 3.0], [1.0, nan, 3.0, 7.0, 5.0, 2.0], [1.0, 2.0, inf, 7.0, 5.0, 2.0], [5.0, 8.0, 2.0, 4.0, 1.0, None]]
    # steps that bend a little in the middle: features next to zero, of both signs
    odd += [[x * 1000.0 + (1e-4 if k == x else 0.0) for x in range(-8, 9)] for k in range(-6, 7)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(list(enumerate(odd)), "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    got = QUERIES["terrain_features"](spark, folder).collect()
    found, wanted = ({az: str(f) for az, f in rows} for rows in (got, connection(folder).sql(ORACLES["terrain_features"]).fetchall()))
    assert found == wanted
    assert any("-0.0," in f for f in found.values()) and len(found) == len(odd) - 2


def test_features_round_as_sql_does():
    x = K.np.array([-1e-9, 1e-9, -5e-7, 5e-7, 0.4999999e-6, -1.2345675, 0.3000005])
    wanted = [connection("/root/testdata/sf0.001").execute("SELECT round(?::DOUBLE, 6)", [float(v)]).fetchone()[0] for v in x]
    assert [str(v) for v in K.rounded(x, 6).tolist()] == [str(v) for v in wanted]
