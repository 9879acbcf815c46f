"""Simulated routes and readings as column arithmetic; chance comes in as columns, so that runs can be repeated."""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, radians, sin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.angles import turn

G = 9.80665


@dataclass(frozen=True)
class Segment:
    azimuth: float
    distance_m: float
    speed: float
    alt_start: float
    alt_end: float


#: The preset routes by number, for a base altitude of 0.
PRESETS = {
    1: [Segment(45.0, 10_000.0, 50.0, 0.0, 0.0)],
    2: [Segment(0.0, 5_000.0, 50.0, 0.0, 0.0), Segment(45.0, 5_000.0, 50.0, 0.0, 0.0)],
    3: [Segment(45.0, 5_000.0, 50.0, 0.0, 500.0)],
}


def route(preset: int | None, base_alt: float, length_m: float | None = None, speed: float = 50.0, azimuth: float = 0.0) -> list[Segment]:
    if preset is not None:
        return [Segment(s.azimuth, s.distance_m, s.speed, s.alt_start + base_alt, s.alt_end + base_alt) for s in PRESETS[preset]]
    if length_m is None:
        raise ValueError("a preset or a length is needed")
    return [Segment(azimuth, length_m, speed, base_alt, base_alt)]


def points(spark: SparkSession, segments: list[Segment], hz: float) -> DataFrame:
    """A row for each 1 / hz seconds of flight: index, timestamp_s, segment, east, north, alt, azimuth, speed, bank."""
    rows, e0, n0, i0, before = [], 0.0, 0.0, 0, None
    for k, s in enumerate(segments):
        steps = max(1, int(s.distance_m / s.speed * hz))
        bank = 0.0 if before is None else min(abs((s.azimuth - before + 180) % 360 - 180) * 0.5, 25.0)
        rows.append((k, s.azimuth, s.distance_m, s.speed, s.alt_start, s.alt_end, steps, i0, e0, n0, bank))
        e0, n0, i0, before = e0 + s.distance_m * sin(radians(s.azimuth)), n0 + s.distance_m * cos(radians(s.azimuth)), i0 + steps, s.azimuth
    segs = spark.createDataFrame(rows, "segment int, azimuth double, distance double, speed double, alt0 double, alt1 double, steps int, i0 int, e0 double, n0 double, bank double")
    p = segs.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    d = F.col("j") * F.col("speed") / hz
    return p.select(
        (F.col("i0") + F.col("j")).alias("index"), ((F.col("i0") + F.col("j")) / hz).alias("timestamp_s"), "segment",
        (F.col("e0") + d * F.sin(F.radians("azimuth"))).alias("east"), (F.col("n0") + d * F.cos(F.radians("azimuth"))).alias("north"),
        (F.col("alt0") + (F.col("alt1") - F.col("alt0")) * F.col("j") / F.greatest(F.col("steps") - 1, F.lit(1))).alias("alt"), "azimuth", "speed", "bank",
    )


def imu(track: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Readings that a level vehicle would give: change of velocity in its own axes (forward, right, up with gravity) and rate of yaw. track: t, v_east, v_north, v_up, heading."""
    w = W.partitionBy(*by).orderBy(*order)
    dt = F.greatest(F.col("t") - F.lag("t").over(w), F.lit(1e-6))
    rate = lambda c: F.coalesce((F.col(c) - F.lag(c).over(w)) / dt, F.lit(0.0))
    a = track.withColumns({"_e": rate("v_east"), "_n": rate("v_north"), "_u": rate("v_up"), "_r": F.coalesce(F.radians(turn(F.lag("heading").over(w), F.col("heading"))) / dt, F.lit(0.0))})
    sin, cos = F.sin(F.radians("heading")), F.cos(F.radians("heading"))
    return a.select(*by, *order, (F.col("_e") * sin + F.col("_n") * cos).alias("accel_x"), (F.col("_e") * cos - F.col("_n") * sin).alias("accel_y"), (F.col("_u") + G).alias("accel_z"), F.lit(0.0).alias("gyro_x"), F.lit(0.0).alias("gyro_y"), F.col("_r").alias("gyro_z"))


def reading(alt: Column, ground: Column, surface_bias: Column, bank: Column, sigma: Column, normal: Column, spike: Column, spike_normal: Column, dropout: Column, spike_share: float, spike_sigma: float, dropout_share: float) -> Column:
    """A radar height with the errors of its beam's ground, bias of the surface, bank, noise, spikes and dropouts (null). normal: standard normal draws; spike, dropout: uniform ones."""
    cos = F.cos(F.radians(bank))
    seen = alt - (ground + surface_bias)
    seen = F.when(F.abs(cos) > 1e-6, seen / cos).otherwise(seen) + normal * sigma
    seen = seen + F.when(spike < spike_share, spike_normal * spike_sigma).otherwise(0.0)
    return F.when(dropout >= dropout_share, seen)


def surface_bias(mode: Column, metres: float, mask: Column) -> Column:
    """Canopy or snow add it everywhere, a mask where it is over a half."""
    return F.when(mode == "none", 0.0).when(mode.isin("forest", "snow"), metres).when(mode == "mask", F.when(mask > 0.5, metres).otherwise(0.0)).otherwise(F.raise_error(F.lit("unknown surface mode")).cast("double"))
