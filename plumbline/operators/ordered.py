"""Ordered tracks: count windows, gaps, as-of interpolation, motion, durations, monitors, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order(keys: list[str], by: list[str]):
    return W.partitionBy(*keys).orderBy(*by)


def count_windows(df: DataFrame, keys: list[str], by: list[str], size: int, step: int) -> DataFrame:
    """Rows of each count-based window: window k covers positions [k * step, k * step + size) of its track; windows that never fill are left out; a step over size acts as size.

    Adds window_id and pos (place within the window). A row in several windows appears once for each.
    """
    step = min(step, size)
    w = order(keys, by)
    placed = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    first = F.greatest(F.ceil((F.col("_i") - size + 1) / step), F.lit(0)).cast("int")
    last = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - size) / step)).cast("int")
    in_some = placed.where(F.col("_n") >= size).withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    dealt = in_some.withColumn("window_id", F.explode(F.sequence("_first", "_last")))
    return dealt.withColumn("pos", (F.col("_i") - F.col("window_id") * step).cast("int")).drop("_i", "_n", "_first", "_last")


def gap_fill(value: Column, place: Column, w) -> Column:
    """Linear between the neighbours that are not null; before the first and after the last, these; null where all are."""
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(value.isNotNull(), place)
    v0, v1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    p0, p1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    return F.coalesce(value, F.when(v0.isNotNull() & v1.isNotNull(), v0 + (v1 - v0) * (place - p0) / (p1 - p0)), v0, v1)


def interpolate_at(points: DataFrame, track: DataFrame, keys: list[str], default: float) -> DataFrame:
    """The value of a sparser track at each point's time, by one sort of both: linear between brackets, held at the ends, default where the key has no track.

    points: keys, id, t; track: keys, t, v (of equal times the last by v). Returns points with v.
    """
    knots = track.groupBy(*keys, "t").agg(F.max("v").alias("v"))
    both = points.select(*keys, "id", "t", F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind")).unionByName(knots.select(*keys, F.lit(None).cast("bigint").alias("id"), "t", "v", F.lit(0).alias("kind")))
    back = W.partitionBy(*keys).orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy("t", "kind").rowsBetween(0, W.unboundedFollowing)
    knot = F.when(F.col("kind") == 0, F.struct("t", "v"))
    found = both.withColumn("a", F.last(knot, True).over(back)).withColumn("b", F.first(knot, True).over(ahead)).where("kind = 1")
    gap = F.col("b.t") - F.col("a.t")
    inside = F.when(gap <= 1e-12, F.col("b.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / gap)
    return found.select(*keys, "id", "t", F.coalesce(inside, F.col("a.v"), F.col("b.v"), F.lit(default)).alias("v"))


def window_duration(first: Column, last: Column, n: Column, hz: float) -> Column:
    """Seconds from a window's first to its last time of day, over midnight too; where that is no use, as many steps at hz."""
    spare = (n - 1) / F.lit(hz)
    span = F.when(last < first, last - first + 86_400).otherwise(last - first)
    return F.when(span.isNull() | (span <= 0) | (span > F.greatest(spare * 3, spare + 5)), spare).otherwise(span)


def fold_mean(ordered: Column, start: float, gain: float) -> Column:
    """b = (1 - gain) * b + gain * x over an ordered array; nulls are left out."""
    return F.aggregate(F.filter(ordered, lambda x: x.isNotNull()), F.lit(start), lambda b, x: b * (1 - gain) + x * gain)


def position_solve(matches: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Fixes of matched windows, with motion from the fix before.

    matches: start_east, start_north (metres), azimuth, offset_m, span_m, duration_s, dt_s (from the fix before), one for each window of
    a track. Adds fix_east, fix_north (from the start by offset and span along the azimuth), fix_t (seconds from the track's first
    fix) and fix_speed, fix_heading: from the last fix to this one, and for the first one the span's and the azimuth. A match without
    azimuth or offset, or that lasts no time, gives no fix and is passed over by the next one. dt_s of passed ones counts.
    """
    w = order(keys, by)
    b, way = F.radians("azimuth"), F.col("offset_m") + F.col("span_m")
    can = F.col("azimuth").isNotNull() & F.col("offset_m").isNotNull() & (F.col("duration_s") > 0)
    placed = matches.withColumns({"fix_east": F.when(can, F.col("start_east") + way * F.sin(b)), "fix_north": F.when(can, F.col("start_north") + way * F.cos(b)), "_t": F.sum("dt_s").over(w.rowsBetween(W.unboundedPreceding, 0))})
    fix = F.when(F.col("fix_east").isNotNull(), F.struct(F.col("fix_east").alias("east"), F.col("fix_north").alias("north"), F.col("_t").alias("t")))
    before = F.last(fix, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    start = F.first(fix, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    moved = placed.withColumns({"_before": before, "_start": start})
    east, north, dt = F.col("fix_east") - F.col("_before.east"), F.col("fix_north") - F.col("_before.north"), F.col("_t") - F.col("_before.t")
    first = F.col("_before").isNull()
    speed = F.when(first, F.col("span_m") / F.col("duration_s")).when(dt > 0, F.hypot(east, north) / dt)
    heading = F.pmod(F.when(first, F.col("azimuth")).otherwise(F.degrees(F.atan2(east, north))), F.lit(360.0))
    has = F.col("fix_east").isNotNull()
    return moved.withColumns({"fix_t": F.when(has, F.col("_t") - F.col("_start.t")), "fix_speed": F.when(has, speed), "fix_heading": F.when(has, heading)}).drop("_t", "_before", "_start")
