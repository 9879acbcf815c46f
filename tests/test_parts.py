"""Parts without an SQL twin: known values, planted answers, exact round trips."""

import datetime
import math
import socket
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import clock, geo, sentence
from plumbline.operators import engine as E
from plumbline.operators import features, filters, match, raster, simulate
from plumbline.operators import ordered as O
from plumbline.sources import datagrams, grids, logs
from plumbline.streaming import navigation as N
from plumbline.streaming.accounts import Accounts, observed
from plumbline.streaming.run import drained


def test_geodesics_known_values_and_round_trip():
    # Flinders Peak to Buninyong, the usual worked example
    d, b = geo.wgs84_inverse(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777)
    assert abs(d - 54972.271) < 0.01 and abs(b - 306.86816) < 1e-4
    rng = np.random.default_rng(2)
    lat, lon, az, s = rng.uniform(-80, 80, 300), rng.uniform(-170, 170, 300), rng.uniform(0, 360, 300), rng.uniform(1, 4e6, 300)
    lat2, lon2 = geo.wgs84_forward(lat, lon, az, s)
    d, b = geo.wgs84_inverse(lat, lon, lat2, lon2)
    assert np.allclose(d, s, atol=1e-3) and np.abs((b - az + 180) % 360 - 180).max() < 1e-6
    assert geo.wgs84_inverse(10.0, 20.0, 10.0, 20.0)[0] == 0
    assert 1.9e7 < float(geo.wgs84_inverse(0.0, 0.0, 0.1, 179.9)[0]) < 2.1e7


def test_geodesic_columns(spark):
    got = spark.range(1).select(geo.geodesic_forward(F.lit(60.5), F.lit(90.3), F.lit(45.0), F.lit(500.0)).alias("p")).select("p.*").first()
    back = spark.range(1).select(geo.geodesic_inverse(F.lit(60.5), F.lit(90.3), F.lit(got.lat), F.lit(got.lon)).alias("p")).select("p.*").first()
    assert abs(back.distance - 500) < 1e-3 and abs(back.bearing - 45) < 1e-6


def test_sentences(spark):
    lines = [
        "$GPGGA,120000.000,,,,,,,,479.8,M,46.9,M,,*72", "  $GPGGA,120000.000,,,,,,,,479.8,M,46.9,M,,*72\r", "$GPGGA,120000.000,,,,,,,,479.8,M,46.9,M,,*00", "$GPRMC,1*00", "GPGGA,1*00", "$GPGGA", "", None, "$GPGGA,120000.000,,,,,,,,x,M,,,,*00",
    ]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", sentence.parse(F.col("line")).alias("f")).collect()
    got = {r.i: r.f for r in rows}
    assert got[0].valid and got[0].radar_alt_m == 479.8 and got[1].valid and not got[2].valid
    assert all(got[i] is None for i in (3, 4, 5, 6, 7))
    assert got[8].radar_alt_m is None and not got[8].valid
    for unit, ok in (("F", False), ("", True)):
        made = spark.range(1).select(F.lit(f"GPGGA,120000,,,,,,,,10.0,{unit},,").alias("p")).select(sentence.parse(F.concat(F.lit("$"), "p", F.lit("*"), F.lower(sentence.checksum(F.col("p"))))).alias("f")).first()
        assert made.f.valid is ok and made.f.radar_alt_m == 10.0
    t = spark.range(1).select(clock.token(F.lit(86_400_000 + 3_723_004)).alias("t"), clock.seconds(F.lit("010203.004")).alias("s"), clock.seconds(F.lit("42.5")).alias("p")).first()
    assert (t.t, t.s, t.p) == ("010203.004", 3723.004, 42.5)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("America/New_York", zone):
            spark.conf.set("spark.sql.session.timeZone", z)
            at = spark.sql("select timestamp_ntz'2024-07-01 02:30:15.123456' ts union all select timestamp_ntz'1969-12-31 23:59:59.5'").select(clock.micros().alias("us")).collect()
            assert [r.us for r in at] == [1719801015123456, -500000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_logs(spark, tmp_path):
    (tmp_path / "h.txt").write_text("﻿630,5\n\n 12.25 \n", encoding="utf-8")
    h = logs.read_heights(spark, str(tmp_path / "h.txt"))
    assert [(r.line_no, r.height_m) for r in h.orderBy("line_no").collect()] == [(1, 630.5), (3, 12.25)]
    (tmp_path / "bad.txt").write_text("1\nx\n")
    with pytest.raises(Exception, match="line 2"):
        logs.read_heights(spark, str(tmp_path / "bad.txt")).collect()
    logs.write_sentences(logs.heights_to_sentences(h, ["line_no"], 5.0), ["line_no"], str(tmp_path / "out"))
    frames = logs.read_sentences(spark, str(tmp_path / "out")).orderBy("file", "line_no").collect()
    assert [(f.timestamp_utc, f.radar_alt_m, f.valid) for f in frames] == [("000000.000", 630.5, True), ("000000.200", 12.3, True)]
    (tmp_path / "truth.csv").write_text("index,timestamp_s,lat,lon\n0,0,10,20\n1,1,10.001,20\n2,2,10.002,20\n")
    t = logs.read_truth(spark, str(tmp_path / "truth.csv")).orderBy("index").collect()
    assert abs(t[0].speed_mps - t[1].speed_mps) < 1e-6 and 100 < t[1].speed_mps < 120 and t[2].azimuth_deg == 0
    logs.write_csv(logs.trajectory(spark.createDataFrame([(0, 10.001, 20.0, 5.0, 370.0)], "index int, lat double, lon double, speed_mps double, azimuth_deg double"), 10.0, 20.0, 5.0), str(tmp_path / "t"))
    r = logs.read_trajectory(spark, str(tmp_path / "t")).first()
    # a thousandth of a degree of the meridian at 10 degrees, on the ellipsoid
    assert r.azimuth_deg == 10 and abs(r.local_y_m - 110.608) < 0.01


def test_datagrams(spark):
    b = datagrams.LineBuffer()
    assert b.feed(b"$a\r\n$b") == ["$a"] and b.feed(b"c\n") == ["$bc"]
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    reader = datagrams.DatagramReader("127.0.0.1", port)
    assert list(reader.read(reader.initialOffset())[0]) == []
    df = spark.createDataFrame([("$one", 0.0), ("$two", 0.05), ("$three", 1.0)], "line string, t double").coalesce(1)
    datagrams.send_lines(df, "127.0.0.1", port, most_hz=10)
    time.sleep(0.2)
    rows, end = reader.read({"seq": 0})
    assert [x for _, x in rows] == ["$one", "$three"] and end == {"seq": 2}
    assert [x for _, x in reader.readBetweenOffsets({"seq": 1}, end)] == ["$three"]
    reader.commit(end)
    reader.socket.close()
    assert datagrams.DatagramSource({"port": "1"}).schema() == "seq bigint, line string"


def test_count_windows_edges(spark):
    df = spark.createDataFrame([(1, i) for i in range(7)] + [(2, i) for i in range(2)], "k int, i int")
    got = {}
    for r in O.count_windows(df, ["k"], ["i"], 3, 2).collect():
        got.setdefault((r.k, r.window_id), []).append((r.pos, r.i))
    assert {k: sorted(v) for k, v in got.items()} == {(1, w): [(p, 2 * w + p) for p in range(3)] for w in range(3)}
    assert O.count_windows(df, ["k"], ["i"], 3, 9).select("window_id").distinct().count() == 2


def test_planted_match(spark):
    rng = np.random.default_rng(2026)
    ref = np.cumsum(rng.normal(size=(60, 80)), axis=1) * 3 + 200
    h = ref[41, 10:42] + rng.normal(0, 0.03, 32)
    r = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(ref)], "az int, profile array<double>")
    m = spark.createDataFrame([(h.tolist(),)], "h array<double>")
    best = match.best(match.heatmap(r, m)).first()
    assert (best.az, best.off) == (41, 10) and best.score > 0.95
    kernel = match.best(features.kernel_heatmap(r, m, 100.0)).first()
    assert (kernel.az, kernel.off) == (41, 10) and abs(kernel.score - best.score) < 1e-9
    shape = match.best(features.feature_heatmap(r, m)).first()
    assert (shape.az, shape.off) == (41, 10)
    level = spark.createDataFrame([(0, [110.0, 111.0, 112.0, 110.0, 10.0, 11.0, 12.0, 10.0])], "az int, profile array<double>")
    flat = spark.createDataFrame([([10.0, 11.0, 12.0, 10.0],)], "h array<double>")
    assert match.best(match.heatmap(level, flat, metric="hybrid")).first().off == 4
    gaps = spark.createDataFrame([(0, [5.0, None, 10.0, 20.0, 30.0, 40.0, None])], "az int, profile array<double>")
    assert match.best(match.heatmap(gaps, spark.createDataFrame([([10.0, 20.0, 30.0, 40.0],)], "h array<double>"))).first().off == 2
    assert match.heatmap(gaps, spark.createDataFrame([([None, None, None, 40.0],)], "h array<double>")).where("score is not null").count() == 0
    with pytest.raises(ValueError):
        match.combine("other", F.lit(1), F.lit(1))


def test_bilinear_of_repeated_and_missing_ids(spark):
    tiles = spark.createDataFrame([(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, None])], "row int, values array<double>")
    rows = [(1, 0.0, 0.5), (1, 0.0, 0.5), (1, 0.5, 0.0), (None, 0.0, 1.0), (2, 1.5, 0.5), (3, 5.0, 0.0), (4, None, 0.0), (5, float("nan"), 0.0)]
    got = raster.bilinear(spark.createDataFrame(rows, "id long, r double, c double"), tiles).collect()
    assert sorted((r.id or 0, r.elev if r.elev is not None else -1.0) for r in got) == [(0, 1.0), (1, 0.5), (1, 0.5), (1, 1.0), (2, -1.0), (3, -1.0), (4, -1.0), (5, -1.0)]
    assert raster.bilinear(spark.createDataFrame(rows, "id long, r double, c double"), tiles.limit(0)).where("elev is null").count() == len(rows)


def test_local_frame_on_the_ellipsoid(spark):
    from plumbline.plans.registry import QUERIES

    d, b = geo.wgs84_inverse([20.0], [55.0], [20.3], [55.2])
    p = spark.range(1).select(geo.geodesic_to_local(F.lit(20.0), F.lit(55.0), F.lit(20.3), F.lit(55.2)).alias("p")).first().p
    assert abs(np.hypot(p.east, p.north) - d[0]) < 1e-6 and abs(np.degrees(np.arctan2(p.east, p.north)) % 360 - b[0]) < 1e-9
    # a degree of the meridian at the equator and of the equator itself
    q = spark.range(1).select(geo.geodesic_to_local(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("n"), geo.geodesic_to_local(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("e")).first()
    assert abs(q.n.north - 110574.389) < 0.01 and abs(q.e.east - 111319.491) < 0.01
    rows = QUERIES["local_frame_geodesic"](spark, "/root/testdata/sf0.001").collect()
    lat, lon = np.array([r.lat for r in rows]), np.array([r.lon for r in rows])
    for o, e, n in ((20.0, "east", "north"), (21.0, "east_rebased", "north_rebased")):
        d, b = geo.wgs84_inverse(np.full(len(rows), o), np.full(len(rows), o + 35), lat, lon)
        assert np.abs(d * np.sin(np.radians(b)) - [r[e] for r in rows]).max() < 0.2
        assert np.abs(d * np.cos(np.radians(b)) - [r[n] for r in rows]).max() < 0.2


def test_bilinear_on_a_plane(spark):
    tiles = spark.range(100).select(F.col("id").cast("int").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda x: 100 + F.col("id") * 2.0 + x * 3.0).alias("values"))
    pts = spark.createDataFrame([(1, 3.25, 7.5), (2, 99.0, 99.0), (3, -0.1, 5.0), (4, 0.0, 99.01)], "id int, r double, c double")
    got = {r.id: r.elev for r in raster.bilinear(pts, tiles).collect()}
    assert got[1] == pytest.approx(129.0) and got[2] == pytest.approx(595.0) and got[3] is None and got[4] is None


def test_smoothing_keeps_parabolas():
    x = np.arange(12.0)
    y = 3 + 2 * x - 0.5 * x**2
    assert np.allclose(features.smoothed(y), y)
    assert features.feature_vectors(np.ones(9)).tolist() == [0.0] * 27


def test_three_model_filter():
    mix = filters.ModelMix()
    for k in range(6):
        g = mix.step(k * 100.0, k * 100.0, 70.7, 45.0, np.eye(2) * 25, 2.0)
    assert g["mode"] == "cruise" and g["weights"][1] > 0.7 and np.linalg.eigvalsh(g["cov"]).min() > 0
    mix = filters.ModelMix()
    for k in range(6):
        a = k * 20.0
        g = mix.step(k * 60.0, k * 30.0, 40.0, a, np.eye(2) * 25, 2.0)
    assert g["weights"][2] > 0.45
    with pytest.raises(ValueError):
        mix.step(0, 0, 0, 0, np.eye(2), 0)


def test_inertial_filter():
    f = filters.Inertial()
    for _ in range(50):
        f.predict(*filters.level_imu(10.0, 10.0, 0.1), 0.1)
        f.altitude(100.0, 1.0)
        f.position(np.array([5.0, -3.0]), np.eye(2))
        f.velocity(np.array([0.0, 0.0]), np.eye(2))
    assert abs(f.p[0] - 5) < 0.5 and abs(f.p[2] - 100) < 5 and np.linalg.eigvalsh(f.cov).min() > 0
    for _ in range(30):
        f.heading(30.0, 1.0)
    assert abs((90 - math.degrees(filters.yaw(f.q)) - 30 + 180) % 360 - 180) < 1
    assert not filters.gate(np.array([200.0]), np.eye(1) * 64, 6.63) and filters.gate(np.array([5.0]), np.eye(1) * 64, 6.63)


def test_particles():
    w = filters.particle_weights(np.full(3, 1 / 3), np.array([[0.0, 0.0], [3.0, np.nan], [9.0, 9.0]]), 3.0)
    assert w.argmax() == 0 and abs(w.sum() - 1) < 1e-12
    assert filters.resampled(np.array([0.5, 0.25, 0.25]), 0.5).tolist() == [0, 0, 2]
    assert filters.resampled(np.array([1.0, 0.0, 0.0, 0.0]), 0.1).tolist() == [0, 0, 0, 0]


def test_routes(spark):
    assert simulate.points(spark, simulate.route(3, 100.0), 5.0).agg(F.max("alt")).first()[0] == 600.0
    with pytest.raises(ValueError):
        simulate.route(None, 0.0)


def test_engine_finds_the_track():
    """A flight over known terrain: the engine's accepted fixes lie near the truth."""
    rough = np.random.default_rng(5).normal(size=(400, 400))
    for axis in (0, 1):
        rough = np.apply_along_axis(lambda v: np.convolve(v, np.ones(5) / 5, "same"), axis, rough)
    terrain = E.Raster(600 + 400 * rough, 30.0)
    s = E.Settings(dt_s=1.0, offsets=20)
    eng = E.Engine(terrain, s)
    truth = [(3000 + 30 * k * math.sin(math.radians(45)), 3000 + 30 * k * math.cos(math.radians(45))) for k in range(120)]
    agl = [1500 - float(terrain.sample(np.array(e), np.array(n))) for e, n in truth]
    v = E.Vehicle(3000.0, 3000.0, 30.0, 45.0)
    rows = eng.feed(v, list(enumerate(agl)))
    assert len(rows) == (120 - 20) // 5 + 1 and all(r["error"] is None for r in rows)
    good = [r for r in rows if r["mode"] == "terrain_update_accepted"]
    assert len(good) > 15
    for r in good:
        e, n = truth[r["last_id"]]
        assert math.hypot(r["fix_east"] - e, r["fix_north"] - n) < 60
    # the state survives storage
    a, b = E.Vehicle(3000.0, 3000.0, 30.0, 45.0), E.Vehicle(3000.0, 3000.0, 30.0, 45.0)
    whole = eng.feed(a, list(enumerate(agl)))
    parts = []
    for k in range(0, 120, 7):
        b = E.Vehicle.load(b.dump())
        parts += eng.feed(b, list(enumerate(agl))[k : k + 7])
    assert [r["mode"] for r in parts] == [r["mode"] for r in whole] and parts[-1]["imm_east"] == pytest.approx(whole[-1]["imm_east"])
    flat = E.Engine(E.Raster(np.full((400, 400), 600.0), 30.0), s).feed(E.Vehicle(3000.0, 3000.0, 30.0, 45.0), [(k, 900.0) for k in range(20)])
    assert flat[0]["mode"] == "terrain_flat_fallback" and flat[0]["used_prediction_only"]


def test_stream_equals_batch(spark, tmp_path):
    """Frames in shuffled files, one a batch, some later than those of other files: the stream gives the rows of the batch twin, and idle vehicles leave the state."""
    rng = np.random.default_rng(1)
    cells = 600 + np.cumsum(np.cumsum(rng.normal(size=(200, 200)), axis=0), axis=1)
    terrain = N.terrain_of(spark, E.Raster(cells, 30.0))
    begin = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC)
    at = lambda i: begin + datetime.timedelta(seconds=i)
    rows = [(k, at(i), i, None if i % 13 == 5 else 700 + 40 * math.sin(i / 3 + k)) for i in range(90) for k in range(3)]
    # vehicle 3 ends early; the last rows of 0 move the watermark past all others
    rows = [r for r in rows if r[0] != 2 or r[2] < 40] + [(0, at(90 + i), 90 + i, 700.0) for i in range(60)]
    order = sorted(range(len(rows)), key=lambda j: rows[j][2] + rng.uniform(0, 25))
    schema = "key long, ts timestamp, id long, agl double"
    for part in range(4):
        spark.createDataFrame([rows[j] for j in order[part * len(rows) // 4 : (part + 1) * len(rows) // 4]], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    frames = spark.read.parquet(*[str(tmp_path / "in" / f"p{p}") for p in range(4)])
    # a frame that comes far too late
    spark.createDataFrame([(0, at(2), 1000, 700.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "p4"))
    released = frames.where(F.col("ts") <= F.lit(at(149 - 30)))
    want = sorted(map(tuple, N.navigate(released, terrain).collect()), key=repr)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    accounts = Accounts()
    spark.streams.addListener(accounts)
    try:
        got = drained(observed(N.navigate_stream(stream, terrain, "30 seconds", idle_ms=20_000), "windows"))
        assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 30
        assert accounts.wait(spark) and accounts.total("windows", "rows") == len(want)
    finally:
        spark.streams.removeListener(accounts)
    batches = accounts.batches
    assert len(batches) >= 5 and sum(b.late for b in batches) == 1 and sum(b.rows_in for b in batches) == len(rows) + 1
    assert [b.integrity for b in batches if b.late] == ["DEGRADED"] and batches[0].integrity == "OK"
    # vehicles 1 and 2 have left, as their last frames are 20 seconds and more behind the last watermark; of 0 there are its state and what waits
    assert batches[-1].state_rows == 2 and max(b.state_rows for b in batches) >= 6
    assert accounts.percentiles("batch_ms", [0.5, 0.99])[0] > 0
    screen: dict = {}
    N.keep_latest(screen)(N.navigate(frames, terrain), 0)
    assert set(screen) == {0, 1, 2} and [screen[k].window_id for k in (0, 1, 2)] == [26, 14, 4]


def test_text_grids(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10.0\nyllcorner 50.0\ncellsize 0.5\nNODATA_value -9999\n1 2.5 -9999\n 4 5 6 \n")
    tiles, grid = grids.read_text_grid(spark, str(tmp_path / "g.asc"))
    assert grid == grids.Grid(10.0, 51.0, 0.5, 2, 3)
    grids.write_tiles(tiles, str(tmp_path / "t"))
    assert [(r.row, r["values"]) for r in spark.read.parquet(str(tmp_path / "t")).orderBy("row").collect()] == [(0, [1.0, 2.5, None]), (1, [4.0, 5.0, 6.0])]
