"""Rasters as tiles of a whole row each (row, values): point samples, rays, patches, previews, beam footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape(tiles: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols."""
    return tiles.agg((F.max("row") + 1).cast("int").alias("n_rows"), F.max(F.size("values")).alias("n_cols"))


def bilinear(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """The raster at fractional pixels: points id, r, c; returns id, elev for each row, rows that repeat an id each with their own.

    Weights of the four neighbours by distance; null outside [0, n - 1], or where a neighbour is null. Each point meets the tiles of
    its two rows in an equi-join for either, which keeps one number of it; a small raster is sent along and nothing is shuffled.
    """
    p = points.select("id", "r", "c").crossJoin(F.broadcast(shape(tiles)))
    p = p.withColumn("ok", F.coalesce(F.col("r").between(0, F.col("n_rows") - 1) & F.col("c").between(0, F.col("n_cols") - 1), F.lit(False)))
    # points outside meet any row, so that they don't all meet one
    r0 = F.when(F.col("ok"), F.floor("r")).otherwise(F.pmod(F.xxhash64("id", "r", "c"), F.col("n_rows"))).cast("int")
    c0 = F.when(F.col("ok"), F.floor("c")).cast("int")
    p = p.select("id", "ok", r0.alias("r0"), F.least(r0 + 1, F.col("n_rows") - 1).alias("r1"), (F.col("r") - F.floor("r")).alias("dr"), c0.alias("c0"), F.least(c0 + 1, F.col("n_cols") - 1).alias("c1"), (F.col("c") - F.floor("c")).alias("dc"))
    value = F.get("values", F.col("c0")) * (1 - F.col("dc")) + F.get("values", F.col("c1")) * F.col("dc")
    rows = tiles.select("row", "values")
    for k in ("0", "1"):
        p = p.join(rows, F.col(f"r{k}") == F.col("row"), "left").withColumn(f"v{k}", value).drop("row", "values")
    return p.select("id", F.when(F.col("ok"), (1 - F.col("dr")) * F.col("v0") + F.col("dr") * F.col("v1")).alias("elev"))


def patch(tiles: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells of a rectangle, ends included; the row range reaches the scan as a filter."""
    part = tiles.where(F.col("row").between(*rows)).select("row", F.posexplode(F.slice("values", cols[0] + 1, cols[1] - cols[0] + 1)).alias("k", "elev"))
    return part.select("row", (F.col("k") + cols[0]).alias("col"), "elev")


def downsample(tiles: DataFrame, factor: int) -> DataFrame:
    """Means over blocks of factor by factor cells; nulls are left out."""
    cells = tiles.select(F.floor(F.col("row") / factor).cast("int").alias("block_row"), F.posexplode("values").alias("k", "elev"))
    return cells.groupBy("block_row", F.floor(F.col("k") / factor).cast("int").alias("block_col")).agg(F.avg("elev").alias("elev"))


def to_pixel(lat: Column, lon: Column, north: float, west: float, cell: float) -> tuple[Column, Column]:
    """Fractional (row, column) of a place, by an upright affine; no shift by half a cell."""
    return (F.lit(north) - lat) / cell, (lon - west) / cell


def along_route(tiles: DataFrame, points: DataFrame, radius: int) -> DataFrame:
    """The tiles within radius rows of any point (r): what a route needs, to be kept or cached before it is flown."""
    rows = points.select(F.explode(F.sequence(F.floor("r") - radius, F.floor("r") + radius)).alias("row")).distinct()
    return tiles.join(rows, "row", "left_semi")
