"""What a screen shows, over states made from event numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import dashboard as B

from .base import Plans, r6
from .decide import MATCH_SQL, matches

plans = Plans()

_STATES = f"""WITH {MATCH_SQL}, st AS (SELECT event_id, user_id, ts, event_id // 7 * 7 AS t, (event_id * 37 % 400)::DOUBLE AS east, (event_id * 53 % 300)::DOUBLE AS north, CASE WHEN flat THEN 'terrain_flat_fallback' WHEN event_id % 4 = 0 THEN 'gnss_assisted:uploaded' WHEN event_id % 4 = 1 THEN 'terrain_only_uploaded' ELSE 'terrain_update_accepted' END AS mode,
  flat AS used_prediction_only, CASE WHEN event_id % 9 <> 0 THEN peak ELSE 0 END AS peak, CASE WHEN event_id % 9 <> 0 THEN conf ELSE 0 END AS confidence, CASE WHEN event_id % 9 <> 0 THEN pslr ELSE 0 END AS pslr_db, CASE WHEN event_id % 9 <> 0 THEN peaks ELSE 0 END AS n_peaks, reliable, ambiguous, az AS azimuth, new_speed AS speed, CASE WHEN event_id % 97 = 5 THEN event_id % 3 END AS dropped FROM m)"""


def states(spark, sf_dir):
    i = F.col("event_id")
    some = lambda c: F.when(i % 9 != 0, F.col(c)).otherwise(F.lit(0).cast("double"))
    mode = F.when(F.col("flat"), "terrain_flat_fallback").when(i % 4 == 0, "gnss_assisted:uploaded").when(i % 4 == 1, "terrain_only_uploaded").otherwise("terrain_update_accepted")
    return matches(spark, sf_dir).select(
        "event_id", "user_id", "ts", (F.floor(i / 7) * 7).alias("t"), (i * 37 % 400).cast("double").alias("east"), (i * 53 % 300).cast("double").alias("north"), mode.alias("mode"), F.col("flat").alias("used_prediction_only"),
        some("peak").alias("peak"), some("conf").alias("confidence"), some("pslr").alias("pslr_db"), F.when(i % 9 != 0, F.col("peaks")).otherwise(0).alias("n_peaks"), "reliable", "ambiguous", F.col("az").alias("azimuth"), F.col("new_speed").alias("speed"), F.when(i % 97 == 5, i % 3).alias("dropped"),
    )


@plans.add("dashboard_outline", f"""{_STATES}, e AS (SELECT user_id, arg_min(struct_pack(t := t, id := event_id, east := east, north := north), (t, event_id)) AS a, arg_max(struct_pack(t := t, id := event_id, east := east, north := north), (t, event_id)) AS z FROM st GROUP BY user_id),
p AS (SELECT st.*, z, CASE WHEN z.t <= a.t THEN 0 ELSE least(floor((st.t - a.t)::DOUBLE / (z.t - a.t) * 8), 7) END AS span, round(CASE WHEN z.east = a.east AND z.north = a.north THEN sqrt(power(st.east - a.east, 2) + power(st.north - a.north, 2)) ELSE (z.east - a.east) * (st.north - a.north) - (z.north - a.north) * (st.east - a.east) END, 6) AS far FROM st JOIN e USING (user_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, span ORDER BY t, event_id) AS i, row_number() OVER (PARTITION BY user_id, span ORDER BY far, t, event_id) AS l, row_number() OVER (PARTITION BY user_id, span ORDER BY far DESC, t, event_id) AS h FROM p)
SELECT user_id, event_id, t, east, north FROM k WHERE i = 1 OR l = 1 OR h = 1 OR event_id = z.id""")
def dashboard_outline(spark, sf_dir):
    """Outlines of all tracks by eight spans of their time."""
    return B.outline(states(spark, sf_dir), ["user_id"], "t", "event_id", 8).select("user_id", "event_id", "t", "east", "north")


_READY = "greatest(s.peak, s.confidence, s.pslr_db, s.n_peaks::DOUBLE) > 0"


@plans.add("dashboard_cards", f"""{_STATES}, l AS (SELECT user_id, arg_max(st, (ts, event_id)) AS s, max(coalesce(dropped, 0)) AS lost FROM st GROUP BY user_id)
SELECT user_id, CASE WHEN s.used_prediction_only THEN 'prediction' WHEN starts_with(s.mode, 'gnss_assisted') THEN 'GNSS and terrain' WHEN starts_with(s.mode, 'terrain_only') THEN 'terrain without GNSS' ELSE 'terrain' END AS source, s.mode AS mode,
  CASE WHEN NOT {_READY} THEN 'waiting' WHEN s.reliable THEN 'yes' ELSE 'no' END AS reliable, CASE WHEN NOT {_READY} THEN 'waiting' WHEN s.ambiguous THEN 'yes' ELSE 'no' END AS ambiguous, CASE WHEN lost > 0 THEN 'DEGRADED' ELSE 'OK' END AS integrity, s.peak AS peak, s.pslr_db AS pslr_db, s.azimuth AS azimuth, s.speed AS speed FROM l""")
def dashboard_cards(spark, sf_dir):
    """The cards of every vehicle's last state."""
    return B.cards(states(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@plans.add("dashboard_quality", f"{_STATES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM st) SELECT user_id, list(peak ORDER BY back DESC) AS peak, list(confidence ORDER BY back DESC) AS confidence, list(pslr_db ORDER BY back DESC) AS pslr_db FROM k WHERE back <= 20 GROUP BY user_id")
def dashboard_quality(spark, sf_dir):
    """The course of the last twenty windows' figures."""
    return B.quality_history(states(spark, sf_dir), ["user_id"], ["ts", "event_id"], 20)


@plans.add("dashboard_summary", f"""{_STATES}, c AS (SELECT user_id, split_part(mode, ':', 1) AS kind, count(*) AS n FROM st GROUP BY ALL), g AS (SELECT user_id, list(kind || '=' || n::VARCHAR ORDER BY kind) AS modes FROM c GROUP BY user_id),
a AS (SELECT user_id, count(*)::BIGINT AS windows, round(avg(used_prediction_only::INT), 6) AS predicted, round(avg(reliable::INT), 6) AS reliable, round(avg(ambiguous::INT), 6) AS ambiguous, round(avg(peak), 6) AS mean_peak, max(peak) AS best_peak FROM st GROUP BY user_id) SELECT a.*, modes FROM a JOIN g USING (user_id)""")
def dashboard_summary(spark, sf_dir):
    """Sums over all windows of every vehicle."""
    got = B.summary(states(spark, sf_dir), ["user_id"])
    modes = F.transform(F.array_sort(F.map_entries("modes")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return got.select("user_id", "windows", *(r6(c).alias(c) for c in ("predicted", "reliable", "ambiguous", "mean_peak")), "best_peak", modes.alias("modes"))
