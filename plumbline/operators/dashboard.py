"""What a screen shows of each vehicle, as tables of a bounded number of rows: its track's outline, cards of its last state, the course of its matches' quality, and sums over all its windows.

Everything is an aggregate whose parts can be merged in any order, so neither a vehicle's history nor its latest states are ever held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points of an outline come from so many spans of a track's time, three of each at most.
SPANS = 64
#: What a card says of where a position comes from, by the state that gave it.
SOURCES = (("predicted", "prediction"), ("gnss_assisted", "GNSS and terrain"), ("terrain_only", "terrain without GNSS"))


def outline(fixes: DataFrame, keys: list[str], at: str, id: str, spans: int = SPANS) -> DataFrame:
    """Of each track the rows that its shape needs: of each of `spans` equal spans of its time the first, and the two farthest to
    either side of the straight line from its first to its last row; and the last row.

    fixes: keys, at (a number), id (tells rows of equal time apart), east, north. Rows without a time or a place are left out. 3 * spans + 1
    rows of a track at most; a track of fewer may lose some too. Columns as they are.
    """
    own = fixes.where(F.col(at).isNotNull() & F.col("east").isNotNull() & F.col("north").isNotNull())
    row = F.struct(F.col(at).alias("at"), F.col(id).alias("id"), F.col("east").alias("east"), F.col("north").alias("north"))
    ends = own.groupBy(*keys).agg(F.min(row).alias("_a"), F.max(row).alias("_z"))
    far = (F.col("_z.east") - F.col("_a.east")) * (F.col("north") - F.col("_a.north")) - (F.col("_z.north") - F.col("_a.north")) * (F.col("east") - F.col("_a.east"))
    # a loop ends where it began: then distance from there tells its shape
    closed = (F.col("_z.east") == F.col("_a.east")) & (F.col("_z.north") == F.col("_a.north"))
    away = F.when(closed, F.hypot(F.col("east") - F.col("_a.east"), F.col("north") - F.col("_a.north"))).otherwise(far)
    length = F.col("_z.at") - F.col("_a.at")
    span = F.when(length <= 0, F.lit(0)).otherwise(F.least(F.floor((F.col(at) - F.col("_a.at")) / length * spans), F.lit(spans - 1)))
    # equal distances go by the earlier row
    placed = own.join(ends, keys).withColumns({"_span": span.cast("int"), "_far": F.round(away, 6)})
    order = F.struct(F.col(at).alias("at"), F.col(id).alias("id"))
    low, high = F.struct(F.col("_far").alias("far"), order.alias("o")), F.struct((-F.col("_far")).alias("far"), order.alias("o"))
    kept = placed.groupBy(*keys, "_span").agg(F.min(order).alias("first"), F.min(low)["o"].alias("low"), F.min(high)["o"].alias("high"), F.max(F.struct(F.col("_z.at").alias("at"), F.col("_z.id").alias("id"))).alias("last"))
    points = kept.select(*keys, F.explode(F.array_distinct(F.array("first", "low", "high", "last"))).alias("p")).distinct()
    return own.join(points.select(*keys, F.col("p.at").alias(at), F.col("p.id").alias(id)), [*keys, at, id]).select(*fixes.columns)


def source(mode: Column, predicted: Column) -> Column:
    """Where a position comes from, in words."""
    (_, first), *others = SOURCES
    said = F.when(predicted, first)
    for start, words in others:
        said = said.when(mode.startswith(start), words)
    return said.otherwise("terrain")


def cards(states: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last state of each vehicle as its cards: source, mode, reliable and ambiguous (waiting, as long as no figure is there; else yes or no), integrity, and the figures.

    states: mode, used_prediction_only, peak, confidence, pslr_db, n_peaks, reliable, ambiguous, azimuth, speed, dropped (frames lost so
    far, null for none). Of a vehicle's states the one of greatest `by` counts.
    """
    fields = ["mode", "used_prediction_only", "peak", "confidence", "pslr_db", "n_peaks", "reliable", "ambiguous", "azimuth", "speed", "dropped"]
    last = states.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*by)).alias("s"), F.max(F.coalesce("dropped", F.lit(0))).alias("lost"))
    s = lambda c: F.col(f"s.{c}")
    ready = F.greatest(*(F.coalesce(s(c).cast("double"), F.lit(0.0)) for c in ("peak", "confidence", "pslr_db", "n_peaks"))) > 0
    said = lambda flag: F.when(~ready, "waiting").when(flag, "yes").otherwise("no")
    return last.select(*keys, source(s("mode"), s("used_prediction_only")).alias("source"), s("mode").alias("mode"), said(s("reliable")).alias("reliable"), said(s("ambiguous")).alias("ambiguous"), F.when(F.col("lost") > 0, "DEGRADED").otherwise("OK").alias("integrity"), s("peak").alias("peak"), s("pslr_db").alias("pslr_db"), s("azimuth").alias("azimuth"), s("speed").alias("speed"))


def quality_history(states: DataFrame, keys: list[str], by: list[str], last: int = 50) -> DataFrame:
    """Peak, confidence and side lobe of each vehicle's last windows, oldest first; a row for each vehicle."""
    back = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in by)))
    some = states.withColumn("_back", back).where(F.col("_back") <= last)
    held = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("back"), "peak", "confidence", "pslr_db"))).alias("q"))
    figure = lambda c: F.transform("q", lambda x: x[c]).alias(c)
    return held.select(*keys, *map(figure, ("peak", "confidence", "pslr_db")))


def summary(states: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over all windows of each vehicle: their number, the shares that were predicted, reliable and ambiguous, mean and greatest peak, and how often each kind of mode (what stands before a colon) came, as a map."""
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    kind = F.substring_index("mode", ":", 1)
    modes = states.groupBy(*keys, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("modes"))
    sums = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), share("used_prediction_only").alias("predicted"), share("reliable").alias("reliable"), share("ambiguous").alias("ambiguous"), F.avg("peak").alias("mean_peak"), F.max("peak").alias("best_peak"))
    return sums.join(modes, keys)
