"""Height grids in and out: text grids with a header of six lines, and tiles (a row each) in Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import lines


@dataclass(frozen=True)
class Grid:
    """Upper left corner and cell size, in the units of the file."""

    west: float
    north: float
    cell: float
    n_rows: int
    n_cols: int


def read_text_grid(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """Tiles (row, values) of one ASCII grid file, first row in the north; missing cells are null.

    The header's six lines (ncols, nrows, xllcorner, yllcorner, cellsize, NODATA_value) are read by themselves; rows go to tiles
    where they are.
    """
    text = lines(spark, path)
    head = {k.lower(): float(v) for k, v in (r.line.split() for r in text.where("line_no <= 6").orderBy("line_no").collect())}
    grid = Grid(head["xllcorner"], head["yllcorner"] + head["nrows"] * head["cellsize"], head["cellsize"], int(head["nrows"]), int(head["ncols"]))
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    nodata = F.lit(head["nodata_value"])
    tiles = text.where("line_no > 6").select((F.col("line_no") - 7).alias("row"), F.transform(numbers, lambda v: F.when(F.abs(v - nodata) > 1e-8 * F.abs(nodata), v)).alias("values"))
    return tiles, grid


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles in ranges of rows, so that a patch reads few files."""
    tiles.repartitionByRange("row").sortWithinPartitions("row").write.parquet(path)
