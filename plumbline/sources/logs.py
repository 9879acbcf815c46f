"""Text logs and tables in and out. Schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import clock, geo, sentence

_D, _I = T.DoubleType(), T.IntegerType()
TRUTH = T.StructType([T.StructField("index", _I), T.StructField("timestamp_s", _D), T.StructField("lat", _D), T.StructField("lon", _D)])
TRAJECTORY = T.StructType([T.StructField("index", _I), *(T.StructField(n, _D) for n in ("timestamp_s", "local_x_m", "local_y_m", "lat", "lon", "speed_mps", "azimuth_deg"))])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in order: file, line_no (from 1 in each file), line.

    A file is read in splits, and each is numbered by itself: what comes before it in its file is known from the counts of the
    splits, one row each. So a log of any length is numbered by as many tasks as read it.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    raw = spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    counts = spark.read.text(path).select(*meta).groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("file", "split", (F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = raw.withColumn("i", F.row_number().over(W.partitionBy("file", "split").orderBy("at")))
    return within.join(before, ["file", "split"]).select("file", (F.col("before") + F.col("i")).cast("int").alias("line_no"), "line")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Frames of a sentence log; other lines are dropped, invalid frames stay with valid false."""
    return lines(spark, path).select("file", "line_no", sentence.parsed_rows(F.col("line")))


def read_heights(spark: SparkSession, path: str) -> DataFrame:
    """One number for each line that is not empty, with a point or a comma; a byte-order mark is skipped. A line that is no number fails the query and is named."""
    text = F.trim(F.regexp_replace("line", "^﻿", ""))
    number = F.regexp_replace(text, ",", ".").try_cast("double")
    got = lines(spark, path).where(text != "").select("file", "line_no", F.coalesce(number, F.raise_error(F.concat(F.lit("not a number in line "), F.col("line_no").cast("string"))).cast("double")).alias("height_m"))
    return got


def read_truth(spark: SparkSession, path: str, fallback_dt_s: float = 0.2) -> DataFrame:
    """Truth tables, a track in each file, with speed and bearing derived from the neighbours (the first row has those of the second)."""
    t = spark.read.option("header", True).schema(TRUTH).csv(path).withColumn("file", F.col("_metadata.file_path"))
    t = t.withColumn("timestamp_s", F.coalesce("timestamp_s", F.col("index") * fallback_dt_s))
    w = W.partitionBy("file").orderBy("index")
    d, b = geo.sphere_inverse(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    v = d / F.greatest(F.col("timestamp_s") - F.lag("timestamp_s").over(w), F.lit(1e-6))  # null for the first row, as d is
    m = t.withColumn("_v", v).withColumn("_b", b)
    return m.select("file", "index", "timestamp_s", "lat", "lon", F.coalesce("_v", F.lead("_v").over(w), F.lit(0.0)).alias("speed_mps"), F.coalesce("_b", F.lead("_b").over(w), F.lit(0.0)).alias("azimuth_deg"))


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("header", True).schema(TRAJECTORY).csv(path)
    return t.withColumn("azimuth_deg", F.pmod("azimuth_deg", F.lit(360.0))).withColumn("mode", F.lit("recorded"))


def heights_to_sentences(heights: DataFrame, by: list[str], hz: float, start_ms: int = 0, terrain: bool = False, baro_m: float = 1500.0) -> DataFrame:
    """A sentence for each height of a file in the order of by; terrain heights become baro - height."""
    i = F.row_number().over(W.partitionBy("file").orderBy(*by)) - 1
    h = F.lit(baro_m) - F.col("height_m") if terrain else F.col("height_m")
    return heights.select("file", *by, sentence.build(clock.token((F.round(i * (1000.0 / hz)) + start_ms).cast("bigint")), h).alias("line"))


def write_sentences(df: DataFrame, by: list[str], path: str) -> None:
    """Text files of the column line, in order of by over the parts."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).select("line").write.option("lineSep", "\r\n").text(path)


def trajectory(fixes: DataFrame, lat0: float, lon0: float, hz: float) -> DataFrame:
    """Output rows of a track: index, seconds, place from the start (east and north on the ellipsoid), place, motion."""
    r: Column = F.round
    east, north = F.col("local.east"), F.col("local.north")
    return fixes.withColumn("local", geo.geodesic_to_local(F.lit(lat0), F.lit(lon0), F.col("lat"), F.col("lon"))).select("index", r(F.col("index") / hz, 3).alias("timestamp_s"), r(east, 3).alias("local_x_m"), r(north, 3).alias("local_y_m"), r("lat", 8).alias("lat"), r("lon", 8).alias("lon"), r("speed_mps", 3).alias("speed_mps"), r("azimuth_deg", 3).alias("azimuth_deg"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
