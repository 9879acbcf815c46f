"""Smaller operators: clamps, axes, frames moved to another origin, output rows, histories, the inertial engine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.operators import decide, inertial, particles
from plumbline.streaming.navigation import raster_of

from .base import SAMPLES_SQL, track_order, Plans, r6, samples
from .decide import MATCH_SQL, matches
from .ordered import _BEARING, _INVERSE, _sql
from .raster import CELL, NORTH, WEST, tiles

plans = Plans()


@plans.add("runtime_clamp", f"WITH {SAMPLES_SQL}, r AS (SELECT event_id, (event_id % 90)::INT AS n, 64 AS w, (event_id % 40 - 3)::INT AS s FROM samples) SELECT event_id, greatest(2, least(w, n))::INT AS window_size, greatest(1, least(s, greatest(2, least(w, n))))::INT AS step FROM r")
def runtime_clamp(spark, sf_dir, window: int = 64):
    """A window that fits the samples there are, and a step that fits the window."""
    size = F.greatest(F.lit(2), F.least(F.lit(window), (F.col("event_id") % 90).cast("int")))
    return samples(spark, sf_dir).select("event_id", size.alias("window_size"), F.greatest(F.lit(1), F.least((F.col("event_id") % 40 - 3).cast("int"), size)).alias("step"))


@plans.add("patch_axes", f"SELECT 'lat' AS axis, i::INT AS i, round({NORTH} - (40 + i + 0.5)::DOUBLE * {CELL}::DOUBLE, 9) AS at FROM generate_series(0, 21) g(i) UNION ALL SELECT 'lon', i::INT, round({WEST} + (10 + i + 0.5)::DOUBLE * {CELL}::DOUBLE, 9) FROM generate_series(0, 23) g(i)")
def patch_axes(spark, sf_dir):
    """Cell centres of a patch of 22 rows from row 40 and 24 columns from column 10."""
    axis = lambda name, n, at: spark.range(n).select(F.lit(name).alias("axis"), F.col("id").cast("int").alias("i"), F.round(at, 9).alias("at"))
    return axis("lat", 22, F.lit(NORTH) - (F.col("id") + 40.5) * CELL).union(axis("lon", 24, F.lit(WEST) + (F.col("id") + 10.5) * CELL))


_REBASE = f"""{SAMPLES_SQL}, p AS (SELECT event_id, 1000 + value * 3 AS e, 500 - value * 2 AS n FROM samples), d AS (SELECT event_id, radians(20) AS la, sqrt(e * e + n * n) / {geo.RADIUS_M} AS d, atan2(e, n) AS b FROM p),
g AS (SELECT event_id, degrees(asin(sin(la) * cos(d) + cos(la) * sin(d) * cos(b))) AS lat, 55 + degrees(atan2(sin(b) * sin(d) * cos(la), cos(d) - sin(la) * (sin(la) * cos(d) + cos(la) * sin(d) * cos(b)))) AS lon FROM d),
l AS (SELECT event_id, {_sql(_INVERSE, '20.01', '55.02', 'lat', 'lon')} AS d, radians({_sql(_BEARING, '20.01', '55.02', 'lat', 'lon')}) AS b FROM g)"""


@plans.add("rebase_frame", f"WITH {_REBASE} SELECT event_id, round(d * sin(b), 3) AS east, round(d * cos(b), 3) AS north FROM l")
def rebase_frame(spark, sf_dir):
    """Local points of the frame at (20, 55) in the frame at (20.01, 55.02)."""
    p = samples(spark, sf_dir).select("event_id", (F.col("value") * 3 + 1000).alias("e"), (500 - F.col("value") * 2).alias("n"))
    lat, lon = geo.from_local(F.lit(20.0), F.lit(55.0), F.col("e"), F.col("n"))
    east, north = geo.to_local(F.lit(20.01), F.lit(55.02), F.col("lat"), F.col("lon"))
    return p.select("event_id", lat.alias("lat"), lon.alias("lon")).select("event_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@plans.add("matched_offset", f"WITH {MATCH_SQL}, s AS (SELECT event_id, off, CASE WHEN event_id % 3 <> 0 THEN off + (event_id % 10)::DOUBLE - 5 END AS sub FROM m) SELECT event_id, coalesce(sub, off) AS matched, CASE WHEN sub IS NOT NULL AND (off = 0 OR sub > 0) THEN sub ELSE off END AS solved FROM s")
def matched_offset(spark, sf_dir):
    """The offset between steps where it is known; a solver takes it only if it is ahead, or the step is the first."""
    i = F.col("event_id")
    s = matches(spark, sf_dir).select("event_id", "off", F.when(i % 3 != 0, F.col("off") + (i % 10).cast("double") - 5).alias("sub"))
    solved = F.when(F.col("sub").isNotNull() & ((F.col("off") == 0) | (F.col("sub") > 0)), F.col("sub")).otherwise(F.col("off"))
    return s.select("event_id", decide.matched_offset(F.col("sub"), F.col("off")).alias("matched"), solved.alias("solved"))


@plans.add("truth_rows", f"WITH {SAMPLES_SQL} SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT - 1 AS index, user_id, round(ms::DOUBLE / 1000, 3) AS timestamp_s, round(lat, 8) AS lat, round(lon, 8) AS lon, 1500.0::DOUBLE AS alt_msl, round(1500 - agl, 3) AS terrain_h, round(agl, 3) AS radar_alt_measured FROM samples")
def truth_rows(spark, sf_dir):
    """Rows of a truth table as it is written: fixed decimals, an index for each track."""
    s = samples(spark, sf_dir)
    return s.select((F.row_number().over(track_order()) - 1).alias("index"), "user_id", F.round(F.col("ms") / 1000, 3).alias("timestamp_s"), F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.lit(1500.0).alias("alt_msl"), F.round(1500 - F.col("agl"), 3).alias("terrain_h"), F.round("agl", 3).alias("radar_alt_measured"))


@plans.add("route_history", f"""WITH {SAMPLES_SQL}, s AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS any_reset FROM samples),
l AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS last FROM s) SELECT user_id, count(*)::BIGINT AS n, arg_max(event_type, (ts, event_id)) AS state, list(event_id ORDER BY ts DESC, event_id DESC)[1:5] AS latest FROM l WHERE run = last AND event_type <> 'signup' GROUP BY user_id""")
def route_history(spark, sf_dir):
    """What a screen holds of each vehicle: states since the last reset (a signup), their number, the latest five."""
    run = F.sum((F.col("event_type") == "signup").cast("int")).over(track_order().rowsBetween(W.unboundedPreceding, 0))
    s = samples(spark, sf_dir).withColumn("run", run)
    last = s.groupBy("user_id").agg(F.max("run").alias("last"))
    now = s.join(last, "user_id").where("run = last and event_type <> 'signup'").withColumn("back", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    got = now.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("back") == 1, F.col("event_type"))).alias("state"), F.array_sort(F.collect_list(F.when(F.col("back") <= 5, F.struct("back", "event_id")))).alias("five"))
    return got.select("user_id", "n", "state", F.transform("five", lambda x: x["event_id"]).alias("latest"))


@plans.add("heading_arrow", f"WITH {SAMPLES_SQL} SELECT event_id, round(lat + 500 * cos(radians(heading)) / 111320, 8) AS tip_lat, round(lon + 500 * sin(radians(heading)) / (111320 * greatest(cos(radians(lat)), 1e-6)), 8) AS tip_lon FROM samples")
def heading_arrow(spark, sf_dir, metres: float = 500.0):
    h = F.radians("heading")
    return samples(spark, sf_dir).select("event_id", F.round(F.col("lat") + F.cos(h) * metres / geo.DEGREE_M, 8).alias("tip_lat"), F.round(F.col("lon") + F.sin(h) * metres / (F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)) * geo.DEGREE_M), 8).alias("tip_lon"))


@plans.add("east_north_leg", f"WITH {SAMPLES_SQL}, a AS (SELECT event_id, radians(lat) AS p, lon, value / {geo.RADIUS_M} AS d, (value + 50) / {geo.RADIUS_M} AS k FROM samples), e AS (SELECT event_id, asin(sin(p) * cos(d)) AS p2, lon + degrees(atan2(sin(d) * cos(p), cos(d) - sin(p) * sin(p) * cos(d))) AS lon2, k FROM a) SELECT event_id, round(degrees(asin(sin(p2) * cos(k) + cos(p2) * sin(k))), 9) AS lat, round(lon2, 9) AS lon FROM e")
def east_north_leg(spark, sf_dir):
    """A place moved east, then north, along two great circles."""
    lat, lon = geo.sphere_forward(F.col("lat"), F.col("lon"), F.lit(90.0), F.col("value"))
    a = samples(spark, sf_dir).select("event_id", "value", lat.alias("lat"), lon.alias("lon"))
    lat, lon = geo.sphere_forward(F.col("lat"), F.col("lon"), F.lit(0.0), F.col("value") + 50)
    return a.select("event_id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@plans.add("sensor_gate_updates")
def sensor_gate_updates(spark, sf_dir):
    """Readings of one vehicle's altitude and velocity sensors, each gated and then taken into its inertial filter."""

    def step(f: inertial.Inertials, at: np.ndarray, r: pd.DataFrame) -> dict:
        f.level(at, r["heading"].to_numpy(), 1.0, turning=False)
        value, view = r["value"].to_numpy(float), (r["event_type"] == "view").to_numpy()
        cov = np.diag([2.25, 2.25, 4.0])
        moved = np.stack([value / 100, -value / 200, np.zeros(len(at))], axis=1) - f.v[at]
        risen = (value / 10 - f.p[at, 2])[:, None]
        took = np.where(view, inertial.quadratic(moved, f.cov[at, 3:6, 3:6] + cov) <= 1e5, inertial.quadratic(risen, f.cov[at, 2:3, 2:3] + 64.0) <= 1e4)
        by_view, by_height = took & view, took & ~view
        f.correct(at[by_view], slice(3, 6), moved[by_view], cov)
        f.correct(at[by_height], slice(2, 3), risen[by_height], np.array([[64.0]]))
        return {"user_id": r["user_id"].to_numpy(), "event_id": r["event_id"].to_numpy(), "accepted": took, "up": f.p[at, 2], "v_east": f.v[at, 0], "v_north": f.v[at, 1]}

    readings = samples(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "heading", "value")
    return inertial.in_step(readings, "user_id", ["ts", "event_id"], step, "user_id bigint, event_id bigint, accepted boolean, up double, v_east double, v_north double")


@plans.add("eskf_engine")
def eskf_engine(spark, sf_dir):
    """Windows of a vehicle through the inertial filter with a particle search: predict, altitude, particles moved and weighed by the window's terrain, position update if they agree.

    Particles are drawn by a generator seeded with the vehicle's key, so runs repeat; agreement is judged before they are drawn anew.
    """
    terrain = raster_of(tiles(spark, sf_dir).withColumn("values", F.transform("values", lambda v: v + 1250)), 30.0)
    return particles.search(samples(spark, sf_dir), terrain)


@plans.add("probe_union", f"WITH {SAMPLES_SQL}, b AS (SELECT event_id, event_id % 60 AS n FROM samples) SELECT event_id, 50::INT AS size FROM b WHERE n >= 50 UNION SELECT event_id, s::INT FROM b, (VALUES (20), (30), (40), (50)) v(s) WHERE s <= n")
def probe_union(spark, sf_dir):
    """Primary and probe window sizes of each buffer, once each."""
    b = samples(spark, sf_dir).select("event_id", (F.col("event_id") % 60).cast("int").alias("n"))
    first = b.where("n >= 50").select("event_id", F.lit(50).alias("size"))
    return first.union(b.withColumn("size", F.explode(F.array(*map(F.lit, (20, 30, 40, 50))))).where("size <= n").select("event_id", "size")).distinct()


@plans.add("result_from_candidate", f"WITH {MATCH_SQL} SELECT event_id, coalesce(rival, az) AS az, CASE WHEN rival IS NOT NULL THEN peak - 0.05 ELSE peak END AS peak, 'terrain:' || upper(CASE WHEN ambiguous THEN 'a' ELSE 'c' END) AS label FROM m WHERE az IS NOT NULL")
def result_from_candidate(spark, sf_dir):
    """A match's figures replaced by those of its candidate where it has one."""
    m = matches(spark, sf_dir).where("az is not null")
    return m.select("event_id", F.coalesce("rival", "az").alias("az"), F.when(F.col("rival").isNotNull(), F.col("peak") - 0.05).otherwise(F.col("peak")).alias("peak"), F.concat(F.lit("terrain:"), F.upper(F.when(F.col("ambiguous"), "a").otherwise("c"))).alias("label"))


@plans.add("state_to_row", f"WITH {SAMPLES_SQL}, v AS (SELECT event_id, (event_id % 9)::DOUBLE - 4 AS e, (event_id % 7)::DOUBLE - 3 AS n FROM samples) SELECT event_id, round(sqrt(e * e + n * n), 6) AS speed, round(CASE WHEN sqrt(e * e + n * n) <= 1e-6 THEN 0 ELSE (degrees(atan2(e, n)) + 360) % 360 END, 6) AS azimuth, round(greatest(0.15 * sqrt(e * e + n * n), 2), 6) AS sigma_v FROM v")
def state_to_row(spark, sf_dir):
    """Velocity as speed, bearing (0 when standing) and spread."""
    i = F.col("event_id")
    v = samples(spark, sf_dir).select("event_id", ((i % 9).cast("double") - 4).alias("e"), ((i % 7).cast("double") - 3).alias("n"))
    speed = F.sqrt(F.col("e") * F.col("e") + F.col("n") * F.col("n"))
    return v.select("event_id", r6(speed).alias("speed"), r6(F.when(speed <= 1e-6, 0.0).otherwise(F.pmod(F.degrees(F.atan2("e", "n")), F.lit(360.0)))).alias("azimuth"), r6(F.greatest(speed * 0.15, F.lit(2.0))).alias("sigma_v"))
