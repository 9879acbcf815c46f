"""Height rasters in TIFF files with a coordinate system: strips or tiles decoded by the tasks that need them, as rows of a grid.

The directory of a file, which has an entry for each strip or tile, is read once; tasks then read and decode theirs by offset, so a
window of rows and columns reads only the strips or tiles that hold it. Files are opened through pyarrow, on any file system that it
knows. Known: one sample a cell of 8 to 64 bits, plain or deflate, all three predictors, classic and big files; longitude and latitude
on WGS84, and its UTM zones, whose cells are found by inverting the transverse Mercator projection by series.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geo

#: Bytes and codes of a directory entry's kinds of numbers.
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Numbers of the tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
#: Numbers of the keys that name a coordinate system, and the code of longitude and latitude on WGS84.
GEOGRAPHIC_KEY, PROJECTED_KEY, WGS84 = 2048, 3072, 4326
PLAIN, DEFLATE = 1, (8, 32946)


@dataclass(frozen=True)
class GeoGrid:
    """Upper left corner and cell sizes in units of the coordinate system: degrees, or metres of a UTM zone (1 to 60; south of the equator negative)."""

    west: float
    north: float
    cell_x: float
    cell_y: float
    n_rows: int
    n_cols: int
    zone: int | None

    def place(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """(row, column) of a point, as fractions: 0, 0 is the upper left corner's cell."""
        x, y = (lon, lat) if self.zone is None else geo.utm_forward(lat, lon, abs(self.zone), self.zone < 0)
        return (F.lit(self.north) - y) / self.cell_y, (x - self.west) / self.cell_x

    def point(self, row: Column, col: Column) -> tuple[Column, Column]:
        """(lat, lon) of a place."""
        x, y = col * self.cell_x + self.west, F.lit(self.north) - row * self.cell_y
        return (y, x) if self.zone is None else geo.utm_inverse(x, y, abs(self.zone), self.zone < 0)


@dataclass(frozen=True)
class _Layout:
    order: str
    kind: str
    compression: int
    predictor: int
    rows: int
    cols: int
    no_data: float | None


def _opened(path: str) -> pa.NativeFile:
    where = path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)
    system, name = fs.FileSystem.from_uri(where)
    return system.open_input_file(name)


def _directory(f: pa.NativeFile) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of a file's first directory."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}{'Q' if big else 'I'}", head[8:16] if big else head[4:8])[0]
    wide, entry, word = (8, 20, "Q") if big else (2, 12, "I")
    count = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read_at(wide, at))[0]
    table, inline, tags = f.read_at(count * entry, at + wide), 8 if big else 4, {}
    for k in range(count):
        tag, kind, n = struct.unpack(f"{order}HH{word}", table[k * entry : k * entry + entry - inline])
        if kind not in _KINDS:
            continue
        size = struct.calcsize(f"={_KINDS[kind]}") * n
        raw = table[(k + 1) * entry - inline : (k + 1) * entry]
        if size > inline:
            raw = f.read_at(size, struct.unpack(f"{order}{word}", raw)[0])
        tags[tag] = (raw[:size],) if kind == 2 else struct.unpack(f"{order}{_KINDS[kind] * n}", raw[:size])
    return order, tags


def _zone(tags: dict[int, tuple]) -> int | None:
    """The UTM zone of the coordinate system, None for longitude and latitude."""
    keys = tags.get(GEO_KEYS, ())
    named = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = named.get(PROJECTED_KEY, named.get(GEOGRAPHIC_KEY))
    if code is None:
        raise ValueError("the raster names no coordinate system")
    if code == WGS84:
        return None
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return code - 32600 if code < 32700 else -(code - 32700)
    raise ValueError(f"coordinate system {code} is not known")


def read_header(path: str) -> tuple[GeoGrid, _Layout, list[tuple[int, int, int, int]]]:
    """Grid, layout and blocks (first row, first column, offset, bytes) of a file."""
    with _opened(path) as f:
        order, tags = _directory(f)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    bits, form, compression = one(BITS, 1), one(FORMAT, 1), one(COMPRESSION, PLAIN)
    if one(SAMPLES, 1) != 1 or bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or (form == 3 and bits < 32) or compression not in (PLAIN, *DEFLATE):
        raise ValueError(f"{one(SAMPLES, 1)} samples of {bits} bits, format {form}, compression {compression} are not known")
    if PIXEL_SCALE not in tags or TIEPOINT not in tags:
        raise ValueError("the raster has no place")
    n_rows, n_cols = one(HEIGHT), one(WIDTH)
    i, j, _, x, y, _ = tags[TIEPOINT][:6]
    sx, sy = tags[PIXEL_SCALE][:2]
    grid = GeoGrid(x - i * sx, y + j * sy, sx, sy, n_rows, n_cols, _zone(tags))
    tiled = TILES in tags
    rows, cols = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, n_rows), n_rows), n_cols)
    text = tags[NO_DATA][0].rstrip(b"\0 ").decode() if NO_DATA in tags else ""
    layout = _Layout(order, "uif"[form - 1] + str(bits // 8), compression, one(PREDICTOR, 1), rows, cols, float(text) if text else None)
    across = -(-n_cols // cols)
    places, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    return grid, layout, [(k // across * rows, k % across * cols, at, n) for k, (at, n) in enumerate(zip(places, sizes, strict=True))]


def decoded(raw: bytes, rows: int, cols: int, layout: _Layout) -> np.ndarray:
    """The cells of one strip or tile."""
    data = raw if layout.compression == PLAIN else zlib.decompress(raw)
    wide = int(layout.kind[1:])
    data = data[: rows * cols * wide]
    if layout.predictor == 3:
        # bytes of a row as planes, the highest first, each less the one before it
        planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, cols * wide), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(rows, wide, cols).transpose(0, 2, 1)).view(f">{layout.kind}").reshape(rows, cols)
    cells = np.frombuffer(data, f"{layout.order}{layout.kind}").reshape(rows, cols)
    if layout.predictor == 2:
        whole = cells.astype(f"=u{wide}") if layout.kind[0] != "f" else cells.view(f"{layout.order}u{wide}").astype(f"=u{wide}")
        return np.cumsum(whole, axis=1, dtype=f"=u{wide}").view(f"={layout.kind}")
    return cells


def read_geotiff(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, parts: int | None = None) -> tuple[DataFrame, GeoGrid]:
    """Rows (row, values) of a raster, first row in the north, and its grid; cells without data are null.

    rows, cols: first and last of a window; other strips or tiles are not read, cells outside the window within those that are read
    are null, and rows outside are left out. Values of a row are those of all columns. A window beside the raster gives no row. A file
    without a place or a known coordinate system, and cells of a kind that is not known, are refused.
    """
    grid, layout, blocks = read_header(path)
    (r0, r1), (c0, c1) = rows or (0, grid.n_rows - 1), cols or (0, grid.n_cols - 1)
    wanted = [b for b in blocks if b[0] <= r1 and b[0] + layout.rows > r0 and b[1] <= c1 and b[1] + layout.cols > c0]
    tiled = layout.cols != grid.n_cols or any(b[1] for b in blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _opened(path) as f:
            for batch in batches:
                for row, col, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    # a last strip is cut, a last tile is not
                    high = layout.rows if tiled else min(layout.rows, grid.n_rows - row)
                    cells = decoded(f.read_at(n, at), high, layout.cols, layout).astype(float)
                    lost = ~np.isfinite(cells) if layout.no_data is None else ~np.isfinite(cells) | np.isclose(cells, layout.no_data)
                    y, x = row + np.arange(high), col + np.arange(layout.cols)
                    lost |= ((x < c0) | (x > c1))[None]
                    keep, width = np.flatnonzero((y >= max(r0, 0)) & (y <= min(r1, grid.n_rows - 1))), min(layout.cols, grid.n_cols - col)
                    flat, mask = cells[keep, :width].ravel(), lost[keep, :width].ravel()
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * width, pa.int32()), pa.array(flat, mask=mask))
                    yield pa.RecordBatch.from_arrays([pa.array(y[keep], pa.int32()), pa.array(np.full(len(keep), col), pa.int32()), values], ["row", "col", "values"])

    listed = spark.createDataFrame(wanted, "row int, col int, at bigint, n bigint")
    pieces = listed.repartition(parts or max(1, min(len(wanted), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(run, "row int, col int, values array<double>")
    if not tiled:
        return pieces.select("row", "values"), grid
    # a row's pieces in order; tiles of a window that were not read are filled up
    held = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "values"))).alias("p"))
    whole = F.flatten(F.transform("p", lambda x: x["values"]))
    blank = lambda n: F.array_repeat(F.lit(None).cast("double"), n.cast("int"))
    before = F.element_at("p", 1)["col"]
    return held.select("row", F.concat(blank(before), whole, blank(F.lit(grid.n_cols) - before - F.size(whole))).alias("values")), grid
