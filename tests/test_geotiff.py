"""Rasters in TIFF files: planted cells come back, a window reads its own blocks only, places by known values and round trips."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.sources import geotiff as G


def write(path, cells, order="<", big=False, compress=True, predictor=1, tile=None, strip=4, epsg=4326, no_data=None, place=True, spoil=()):
    """A TIFF file with one directory. spoil: numbers of blocks that are filled with what can't be decoded."""
    n, m = cells.shape
    cells = cells.astype(cells.dtype.newbyteorder(order))
    wide, blocks = cells.dtype.itemsize, []
    if tile:
        for r in range(0, n, tile):
            for c in range(0, m, tile):
                part = np.zeros((tile, tile), cells.dtype)
                got = cells[r : r + tile, c : c + tile]
                part[: got.shape[0], : got.shape[1]] = got
                blocks.append(part)
    else:
        blocks = [cells[r : r + strip] for r in range(0, n, strip)]

    def packed(x):
        if predictor == 2:
            u = np.ascontiguousarray(x).view(f"{order}u{wide}").astype(f"=u{wide}")
            x = np.concatenate([u[:, :1], u[:, 1:] - u[:, :-1]], axis=1).astype(f"{order}u{wide}")
        if predictor == 3:
            planes = np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">"))).view(np.uint8).reshape(*x.shape, wide).transpose(0, 2, 1).reshape(len(x), -1)
            x = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1)
        return zlib.compress(x.tobytes()) if compress else x.tobytes()

    data = [b"\xff" * 9 if k in spoil else packed(x) for k, x in enumerate(blocks)]
    at, offsets = 16, []
    for d in data:
        offsets.append(at)
        at += len(d)
    kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
    tags = {256: ("I", [m]), 257: ("I", [n]), 258: ("H", [8 * wide]), 259: ("H", [8 if compress else 1]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [kind])}
    tags |= {322: ("I", [tile]), 323: ("I", [tile]), 324: ("I", offsets), 325: ("I", [len(d) for d in data])} if tile else {273: ("I", offsets), 278: ("I", [strip]), 279: ("I", [len(d) for d in data])}
    if place:
        tags |= {33550: ("d", [0.5, 0.25, 0.0]), 33922: ("d", [0, 0, 0, 10.0, 50.0, 0])}
    if epsg:
        tags[34735] = ("H", [1, 1, 0, 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg])
    if no_data is not None:
        tags[42113] = ("s", f"{no_data}\0".encode())
    number = {"H": 3, "I": 4, "d": 12, "s": 2}
    entry, inline, word = (20, 8, "Q") if big else (12, 4, "I")
    table, rest, after = b"", b"", at + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    for tag, (k, v) in sorted(tags.items()):
        raw = v if k == "s" else struct.pack(f"{order}{k * len(v)}", *v)
        if len(raw) > inline:
            field = struct.pack(f"{order}{word}", after + len(rest))
            rest += raw
        else:
            field = raw.ljust(inline, b"\0")
        table += struct.pack(f"{order}HH{word}", tag, number[k], len(v)) + field
    mark = b"II" if order == "<" else b"MM"
    head = mark + struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else (mark + struct.pack(f"{order}HI", 42, at)).ljust(16, b"\0")
    count = struct.pack(f"{order}{'Q' if big else 'H'}", len(tags))
    path.write_bytes(head + b"".join(data) + count + table + b"\0" * (8 if big else 4) + rest)


def rows_of(df):
    return {r.row: r["values"] for r in df.collect()}


@pytest.mark.parametrize("how", [
    {}, {"compress": False}, {"order": ">", "predictor": 2}, {"tile": 16, "predictor": 3}, {"big": True, "tile": 16, "predictor": 2, "order": ">"}, {"predictor": 3, "order": ">", "strip": 30},
])
@pytest.mark.parametrize("kind", ["i2", "f4"])
def test_planted_cells(spark, tmp_path, how, kind):
    if kind == "i2" and how.get("predictor") == 3:
        how = how | {"predictor": 1}
    rng = np.random.default_rng(1)
    cells = (1000 * rng.normal(size=(30, 37))).astype(kind)
    cells[3, 5] = cells[29, 36] = -9999
    write(tmp_path / "g.tif", cells, no_data=-9999, **how)
    df, grid = G.read_geotiff(spark, str(tmp_path / "g.tif"))
    assert (grid.n_rows, grid.n_cols, grid.west, grid.north, grid.cell_x, grid.cell_y, grid.zone) == (30, 37, 10.0, 50.0, 0.5, 0.25, None)
    got = rows_of(df)
    assert sorted(got) == list(range(30))
    for r, values in got.items():
        assert values == [None if x == -9999 else float(x) for x in cells[r]]


@pytest.mark.parametrize("tile", [None, 8])
def test_a_window_reads_its_own_blocks(spark, tmp_path, tile):
    cells = np.arange(40 * 32, dtype="f8").reshape(40, 32)
    hold = {k for k in range(20) if not (5 <= k // 4 * 8 + 7 and k // 4 * 8 <= 13 and k % 4 * 8 <= 20 and k % 4 * 8 + 7 >= 10)} if tile else {k for k in range(10) if k not in (1, 2, 3)}
    write(tmp_path / "g.tif", cells, tile=tile, spoil=hold)
    df, _ = G.read_geotiff(spark, str(tmp_path / "g.tif"), (5, 13), (10, 20))
    got = rows_of(df)
    assert sorted(got) == list(range(5, 14))
    for r, values in got.items():
        assert values == [float(x) if 10 <= c <= 20 else None for c, x in enumerate(cells[r])]
    assert G.read_geotiff(spark, str(tmp_path / "g.tif"), (90, 99))[0].count() == 0
    with pytest.raises(Exception, match="zlib|decompress|header"):
        G.read_geotiff(spark, str(tmp_path / "g.tif"))[0].collect()


def test_what_is_not_known_is_refused(spark, tmp_path):
    cells = np.zeros((4, 4), "f4")
    for more, why in (({"epsg": None}, "no coordinate system"), ({"epsg": 2154}, "2154"), ({"place": False}, "no place")):
        write(tmp_path / "g.tif", cells, **more)
        with pytest.raises(ValueError, match=why):
            G.read_header(str(tmp_path / "g.tif"))
    (tmp_path / "t.txt").write_text("no raster at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        G.read_header(str(tmp_path / "t.txt"))


def test_utm_known_values_and_round_trip(spark):
    """The meridian from the equator to 45 degrees is 4 984 944.378 m long; off it the projection keeps angles and scale by definition."""
    rng = np.random.default_rng(2)
    rows = [(0.0, 3.0), (45.0, 3.0), *((float(a), float(b)) for a, b in zip(rng.uniform(-79, 83, 200), rng.uniform(-1, 7, 200), strict=True))]
    df = spark.createDataFrame(rows, "lat double, lon double")
    for south in (False, True):
        e, n = geo.utm_forward(F.col("lat"), F.col("lon"), 31, south)
        got = df.select("lat", "lon", e.alias("e"), n.alias("n"))
        back = geo.utm_inverse(F.col("e"), F.col("n"), 31, south)
        near = got.select("*", back[0].alias("lat2"), back[1].alias("lon2")).collect()
        assert all(abs(r.lat - r.lat2) < 1e-10 and abs(r.lon - r.lon2) < 1e-10 for r in near)
        plus = 10_000_000.0 if south else 0.0
        assert (near[0].e, near[0].n) == pytest.approx((500_000.0, plus), abs=1e-6)
        assert (near[1].e, near[1].n) == pytest.approx((500_000.0, 0.9996 * 4_984_944.378 + plus), abs=1e-3)
    # steps of a metre on the ellipsoid, north and east, are turned alike and scaled alike
    steps = [(a, b, *(float(x) for x in geo.wgs84_forward(*(np.array([v]) for v in (a, b, way, 1.0))))) for a, b in rows[2:60] for way in (0.0, 90.0)]
    df = spark.createDataFrame(steps, "lat double, lon double, lat1 double, lon1 double")
    e0, n0 = geo.utm_forward(F.col("lat"), F.col("lon"), 31)
    e1, n1 = geo.utm_forward(F.col("lat1"), F.col("lon1"), 31)
    moved = [(r.e, r.n) for r in df.select((e1 - e0).alias("e"), (n1 - n0).alias("n")).collect()]
    for (de, dn), (fe, fn) in zip(moved[::2], moved[1::2], strict=True):
        assert (fe, fn) == pytest.approx((dn, -de), abs=2e-6) and 0.9995 < np.hypot(de, dn) < 1.003


def test_places_of_a_projected_raster(spark):
    grid = G.GeoGrid(400_000.0, 5_500_000.0, 30.0, 30.0, 3000, 4000, 31)
    df = spark.createDataFrame([(float(r), float(c)) for r in (0, 10.5, 2999) for c in (0, 7.25, 3999)], "r double, c double")
    lat, lon = grid.point(F.col("r"), F.col("c"))
    got = df.select("r", "c", lat.alias("lat"), lon.alias("lon"))
    r, c = grid.place(F.col("lat"), F.col("lon"))
    assert all(abs(x.r - x.r2) < 1e-6 and abs(x.c - x.c2) < 1e-6 for x in got.select("r", "c", r.alias("r2"), c.alias("c2")).collect())
