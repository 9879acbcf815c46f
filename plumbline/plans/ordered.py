"""Windows over tracks, interpolation, motion, metrics against truth."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import angles, geo
from plumbline.operators import ordered as O

from .base import SAMPLES_SQL, track_order, Plans, r6, samples

plans = Plans()
R = geo.RADIUS_M
SIZE, STEP = 20, 5

WINDOWS_SQL = f"""{SAMPLES_SQL}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM samples
), windows AS (
  SELECT p.*, k AS window_id, i - k * {STEP} AS pos FROM placed p, generate_series(0, 10000) g(k)
  WHERE k * {STEP} <= i AND i < k * {STEP} + {SIZE} AND k * {STEP} + {SIZE} <= n AND k <= n
)"""


def windows(spark, sf_dir, size: int = SIZE, step: int = STEP):
    return O.count_windows(samples(spark, sf_dir), ["user_id"], ["ts", "event_id"], size, step)


@plans.add("count_windows", f"WITH {WINDOWS_SQL} SELECT user_id, window_id::INT AS window_id, count(*)::BIGINT AS n, min(event_id) AS first_id, max(event_id) AS last_id, round(sum(value), 6) AS total FROM windows GROUP BY user_id, window_id")
def count_windows(spark, sf_dir):
    return windows(spark, sf_dir).groupBy("user_id", "window_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), r6(F.sum("value")).alias("total"))


@plans.add("window_tail_slices", f"""WITH {WINDOWS_SQL} SELECT user_id, window_id::INT AS window_id, list(event_id ORDER BY pos) FILTER (pos >= {SIZE} - 5) AS tail5, count(*) FILTER (pos >= {SIZE} - 12)::BIGINT AS n12,
  round(avg(value) FILTER (pos >= {SIZE} - 12), 6) AS mean12 FROM windows GROUP BY user_id, window_id""")
def window_tail_slices(spark, sf_dir):
    got = windows(spark, sf_dir).groupBy("user_id", "window_id").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id", "value"))).alias("rows"))
    tail = lambda k: F.slice("rows", -k, k)
    mean = F.aggregate(tail(12), F.lit(0.0), lambda a, x: a + x["value"]) / 12
    return got.select("user_id", "window_id", F.transform(tail(5), lambda x: x["event_id"]).alias("tail5"), F.size(tail(12)).cast("bigint").alias("n12"), r6(mean).alias("mean12"))


@plans.add("window_duration", f"""WITH {WINDOWS_SQL}, w AS (SELECT user_id, window_id, count(*) AS n, min_by(us, pos) AS us0, max_by(us, pos) AS us1 FROM windows GROUP BY ALL),
d AS (SELECT user_id, window_id, n, (us0 % 86400000000)::DOUBLE / 1000000 AS a, (us1 % 86400000000)::DOUBLE / 1000000 AS b FROM w), s AS (SELECT *, CASE WHEN b < a THEN b - a + 86400 ELSE b - a END AS span, (n - 1)::DOUBLE / 0.01 AS spare FROM d)
SELECT user_id, window_id::INT AS window_id, round(CASE WHEN span <= 0 OR span > greatest(spare * 3, spare + 5) THEN spare ELSE span END, 6) AS seconds FROM s""")
def window_duration(spark, sf_dir, hz: float = 0.01):
    day = F.pmod(F.col("us"), F.lit(86_400_000_000)).cast("double") / 1_000_000
    got = windows(spark, sf_dir).groupBy("user_id", "window_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(day, "pos").alias("a"), F.max_by(day, "pos").alias("b"))
    return got.select("user_id", "window_id", r6(O.window_duration(F.col("a"), F.col("b"), F.col("n"), hz)).alias("seconds"))


@plans.add("window_quality_stats", f"""WITH {WINDOWS_SQL}, r AS (SELECT *, 1500 - agl AS h, 1490 - value * 0.9 AS ref FROM windows)
SELECT user_id, window_id::INT AS window_id, round(min(h), 6) AS low, round(max(h), 6) AS high, round(avg(h), 6) AS mean, round(sqrt(avg(power(h - ref, 2))), 6) AS rmse, round(median(h - ref), 6) AS bias FROM r GROUP BY user_id, window_id""")
def window_quality_stats(spark, sf_dir):
    r = windows(spark, sf_dir).withColumn("h", 1500 - F.col("agl")).withColumn("ref", 1490 - F.col("value") * 0.9)
    gap = F.col("h") - F.col("ref")
    return r.groupBy("user_id", "window_id").agg(r6(F.min("h")).alias("low"), r6(F.max("h")).alias("high"), r6(F.avg("h")).alias("mean"), r6(F.sqrt(F.avg(F.pow(gap, F.lit(2.0))))).alias("rmse"), r6(F.median(gap)).alias("bias"))


@plans.add("profile_zscore_flat", f"""WITH {WINDOWS_SQL}, s AS (SELECT user_id, window_id, pos, agl, avg(agl) OVER w AS m, stddev_pop(agl) OVER w AS sd, count(agl) OVER w AS k FROM windows WINDOW w AS (PARTITION BY user_id, window_id))
SELECT user_id, window_id::INT AS window_id, pos::INT AS pos, round(CASE WHEN agl IS NULL THEN NULL WHEN sd > 1e-9 THEN (agl - m) / sd ELSE 0 END, 6) AS z, coalesce(sd < 150, true) AS flat, k >= {SIZE} * 0.5 AND coalesce(sd >= 1e-6, false) AS informative FROM s""")
def profile_zscore_flat(spark, sf_dir, flat_below: float = 150.0):
    w = W.partitionBy("user_id", "window_id")
    s = windows(spark, sf_dir).select("user_id", "window_id", "pos", "agl", F.avg("agl").over(w).alias("m"), F.stddev_pop("agl").over(w).alias("sd"), F.count("agl").over(w).alias("k"))
    z = F.when(F.col("agl").isNull(), None).when(F.col("sd") > 1e-9, (F.col("agl") - F.col("m")) / F.col("sd")).otherwise(F.lit(0.0))
    return s.select("user_id", "window_id", "pos", r6(z).alias("z"), F.coalesce(F.col("sd") < flat_below, F.lit(True)).alias("flat"), ((F.col("k") >= SIZE * 0.5) & F.coalesce(F.col("sd") >= 1e-6, F.lit(False))).alias("informative"))


@plans.add("baro_asof_interp", f"""WITH {SAMPLES_SQL}, knots AS (SELECT user_id, t, max(1500 + value / 100) AS v FROM samples WHERE event_type = 'view' GROUP BY user_id, t), pts AS (SELECT user_id, event_id, t FROM samples WHERE event_type <> 'view'),
a AS (SELECT p.*, k.t AS t0, k.v AS v0 FROM pts p ASOF LEFT JOIN knots k ON p.user_id = k.user_id AND p.t >= k.t), b AS (SELECT a.*, k.t AS t1, k.v AS v1 FROM a ASOF LEFT JOIN knots k ON a.user_id = k.user_id AND a.t <= k.t)
SELECT user_id, event_id, round(coalesce(CASE WHEN t1 - t0 <= 1e-12 THEN v1 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, v0, v1, 1500), 6) AS baro FROM b""")
def baro_asof_interp(spark, sf_dir):
    s = samples(spark, sf_dir)
    points = s.where("event_type <> 'view'").select("user_id", F.col("event_id").alias("id"), "t")
    got = O.interpolate_at(points, s.where("event_type = 'view'").select("user_id", "t", (1500 + F.col("value") / 100).alias("v")), ["user_id"], 1500.0)
    return got.select("user_id", F.col("id").alias("event_id"), r6("v").alias("baro"))


@plans.add("gap_fill_linear", f"""WITH {SAMPLES_SQL}, p AS (SELECT user_id, event_id, agl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM samples), k AS (SELECT user_id, i, agl FROM p WHERE agl IS NOT NULL),
a AS (SELECT p.*, k.i AS i0, k.agl AS v0 FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.i >= k.i), b AS (SELECT a.*, k.i AS i1, k.agl AS v1 FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.i <= k.i)
SELECT event_id, round(coalesce(agl, v0 + (v1 - v0) * (i - i0)::DOUBLE / (i1 - i0), v0, v1), 6) AS filled FROM b""")
def gap_fill_linear(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("i", F.row_number().over(track_order())).select("event_id", r6(O.gap_fill(F.col("agl"), F.col("i"), track_order())).alias("filled"))


_INVERSE = """CASE WHEN {0} IS NOT NULL THEN 2 * {R} * asin(least(sqrt(power(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin(radians({3} - {1}) / 2), 2)), 1)) END"""
_BEARING = """(degrees(atan2(sin(radians({3} - {1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3} - {1})))) + 360) % 360"""


def _sql(form: str, *args: str) -> str:
    return form.format(*args, R=R)


_MOTION = f"""{SAMPLES_SQL}, n AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(t) OVER w AS t0 FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
step AS (SELECT *, {_sql(_INVERSE, 'lat0', 'lon0', 'lat', 'lon')} AS d, {_sql(_BEARING, 'lat0', 'lon0', 'lat', 'lon')} AS b FROM n),
motion AS (SELECT event_id, user_id, ts, d, d / greatest(t - t0, 0.000001) AS v, b FROM step)"""


@plans.add("consecutive_motion", f"""WITH {_MOTION} SELECT event_id, round(coalesce(v, lead(v) OVER w), 4) AS speed, round(coalesce(b, lead(b) OVER w), 6) AS bearing FROM motion WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def consecutive_motion(spark, sf_dir):
    """Speed and bearing since the sample before; the first sample has those of the second."""
    d, b = geo.sphere_inverse(F.lag("lat").over(track_order()), F.lag("lon").over(track_order()), F.col("lat"), F.col("lon"))
    v = d / F.greatest(F.col("t") - F.lag("t").over(track_order()), F.lit(0.000001))
    m = samples(spark, sf_dir).select("event_id", "user_id", "ts", v.alias("v"), b.alias("b"))
    return m.select("event_id", F.round(F.coalesce("v", F.lead("v").over(track_order())), 4).alias("speed"), r6(F.coalesce("b", F.lead("b").over(track_order()))).alias("bearing"))


@plans.add("route_length", f"WITH {_MOTION} SELECT user_id, round(coalesce(sum(d), 0), 3) AS metres, count(*)::BIGINT AS n FROM motion GROUP BY user_id")
def route_length(spark, sf_dir):
    d, _ = geo.sphere_inverse(F.lag("lat").over(track_order()), F.lag("lon").over(track_order()), F.col("lat"), F.col("lon"))
    return samples(spark, sf_dir).select("user_id", d.alias("d")).groupBy("user_id").agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 3).alias("metres"), F.count(F.lit(1)).alias("n"))


@plans.add("dead_reckoning", f"""WITH {SAMPLES_SQL}, s AS (SELECT *, lag(t) OVER w AS t0, lag(speed) OVER w AS v0, lag(heading) OVER w AS h0 FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT *, CASE WHEN t - t0 <= 0 OR t - t0 > 3 / 0.001 THEN 1 / 0.001 ELSE t - t0 END AS dt, (v0 + speed) / 2 AS v, radians(h0 + ((((heading - h0 + 180) % 360) + 360) % 360 - 180) / 2) AS h FROM s)
SELECT event_id, round(coalesce(sum(v * sin(h) * dt) OVER w, 0), 3) AS east, round(coalesce(sum(v * cos(h) * dt) OVER w, 0), 3) AS north FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def dead_reckoning(spark, sf_dir, hz: float = 0.001):
    """Planar path from speeds and headings: trapezoid speed, mid heading, steps that can't be at their rate replaced by 1 / hz."""
    gap, h0 = F.col("t") - F.lag("t").over(track_order()), F.lag("heading").over(track_order())
    dt = F.when((gap <= 0) | (gap > 3 / hz), F.lit(1 / hz)).otherwise(gap)
    v = (F.lag("speed").over(track_order()) + F.col("speed")) / 2
    h = F.radians(h0 + angles.turn(h0, F.col("heading")) / 2)
    d = samples(spark, sf_dir).select("event_id", "user_id", "ts", (v * F.sin(h) * dt).alias("e"), (v * F.cos(h) * dt).alias("n"))
    path = track_order().rowsBetween(W.unboundedPreceding, 0)
    return d.select("event_id", F.round(F.coalesce(F.sum("e").over(path), F.lit(0.0)), 3).alias("east"), F.round(F.coalesce(F.sum("n").over(path), F.lit(0.0)), 3).alias("north"))


#: Semi-axes and flattening of WGS84.
_A, _F = 6378137.0, 1 / 298.257223563
_B = _A * (1 - _F)


def _forward_sql(source: str, rounds: int = 6) -> str:
    """Tables that end in fwd (event_id, lat, lon): the ends of lines of s metres at bearing az from lat, lon on the ellipsoid, by the direct series, its angle set right in rounds."""
    fix = "first + b * sin(sg) * (cos(2 * s1 + sg) + b / 4 * (cos(sg) * (2 * power(cos(2 * s1 + sg), 2) - 1) - b / 6 * cos(2 * s1 + sg) * (4 * power(sin(sg), 2) - 3) * (4 * power(cos(2 * s1 + sg), 2) - 3)))"
    steps = "".join(f"w{k} AS (SELECT * EXCLUDE (sg), {fix} AS sg FROM w{k - 1}),\n" for k in range(1, rounds + 1))
    return f"""wa AS (SELECT event_id, lon, radians(az) AS al, s, atan({1 - _F!r} * tan(radians(lat))) AS u FROM {source}),
wb AS (SELECT *, atan2(tan(u), cos(al)) AS s1, cos(u) * sin(al) AS sa, (1 - power(cos(u) * sin(al), 2)) * {(_A**2 - _B**2) / _B**2!r} AS u2 FROM wa),
w0 AS (SELECT *, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) AS b, s / ({_B!r} * (1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))))) AS first, s / ({_B!r} * (1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))))) AS sg FROM wb),
{steps}we AS (SELECT *, {_F!r} / 16 * (1 - sa * sa) * (4 + {_F!r} * (4 - 3 * (1 - sa * sa))) AS c, cos(2 * s1 + sg) AS m, atan2(sin(sg) * sin(al), cos(u) * cos(sg) - sin(u) * sin(sg) * cos(al)) AS lam FROM w{rounds}),
fwd AS (SELECT event_id, degrees(atan2(sin(u) * cos(sg) + cos(u) * sin(sg) * cos(al), {1 - _F!r} * sqrt(sa * sa + power(sin(u) * sin(sg) - cos(u) * cos(sg) * cos(al), 2)))) AS lat, lon + degrees(lam - (1 - c) * {_F!r} * sa * (sg + c * sin(sg) * (m + c * cos(sg) * (2 * m * m - 1)))) AS lon FROM we)"""


def _inverse_sql(name: str, source: str, lat0: float, lon0: float, rounds: int = 14) -> str:
    """Tables that end in name (event_id, east, north): places of a source (event_id, lat, lon) from an origin on the ellipsoid, by the inverse series, its longitude set right in rounds."""
    t = lambda k: f"{name}_{k}"

    def angles_of(source: str) -> str:
        return f"""(SELECT *, CASE WHEN ca > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / ca ELSE 0 END AS m, {_F!r} / 16 * ca * (4 + {_F!r} * (4 - 3 * ca)) AS c FROM (SELECT *, 1 - sa * sa AS ca FROM (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa
  FROM (SELECT event_id, u1, u2, big, lam, sqrt(power(cos(u2) * sin(lam), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM {source}))))"""

    steps = "".join(f"{t(k)} AS (SELECT event_id, u1, u2, big, big + (1 - c) * {_F!r} * sa * (sg + c * ss * (m + c * cs * (2 * m * m - 1))) AS lam FROM {angles_of(t(k - 1))}),\n" for k in range(1, rounds + 1))
    return f"""{t(0)} AS (SELECT event_id, atan({1 - _F!r} * tan(radians({lat0}))) AS u1, atan({1 - _F!r} * tan(radians(lat))) AS u2, radians(lon - {lon0}) AS big, radians(lon - {lon0}) AS lam FROM {source}),
{steps}{t('z')} AS (SELECT *, ca * {(_A**2 - _B**2) / _B**2!r} AS v FROM {angles_of(t(rounds))}),
{t('y')} AS (SELECT *, 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v))) AS a, v / 1024 * (256 + v * (-128 + v * (74 - 47 * v))) AS b, atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) AS az FROM {t('z')}),
{t('x')} AS (SELECT *, {_B!r} * a * (sg - b * ss * (m + b / 4 * (cs * (2 * m * m - 1) - b / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))) AS d FROM {t('y')}),
{name} AS (SELECT event_id, d * sin(az) AS east, d * cos(az) AS north FROM {t('x')})"""


@plans.add("dead_reckoning_geodesic", f"WITH {SAMPLES_SQL}, lines AS (SELECT event_id, lat, lon, heading AS az, speed * 60 AS s FROM samples), {_forward_sql('lines')} SELECT event_id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM fwd")
def dead_reckoning_geodesic(spark, sf_dir):
    """Each sample's place after a minute at its speed and heading, on the ellipsoid."""
    s = samples(spark, sf_dir)
    return s.select("event_id", geo.geodesic_forward("lat", "lon", "heading", F.col("speed") * 60).alias("p")).select("event_id", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


@plans.add("local_frame_roundtrip", f"""WITH {SAMPLES_SQL}, l AS (SELECT event_id, lat, lon, {_sql(_INVERSE, '20', '55', 'lat', 'lon')} AS d, radians({_sql(_BEARING, '20', '55', 'lat', 'lon')}) AS b, value - 100 AS up FROM samples),
p AS (SELECT *, d * sin(b) AS east, d * cos(b) AS north FROM l)
SELECT event_id, round(east, 3) AS east, round(north, 3) AS north, round(up, 6) AS up, round(lat, 6) AS lat, round(lon, 6) AS lon FROM p""")
def local_frame_roundtrip(spark, sf_dir):
    """Into the local frame of (20, 55) and back; the way back has to give the place again."""
    east, north = geo.to_local(F.lit(20.0), F.lit(55.0), F.col("lat"), F.col("lon"))
    s = samples(spark, sf_dir).select("event_id", "value", east.alias("e"), north.alias("n"))
    lat, lon = geo.from_local(F.lit(20.0), F.lit(55.0), F.col("e"), F.col("n"))
    return s.select("event_id", F.round("e", 3).alias("east"), F.round("n", 3).alias("north"), r6(F.col("value") - 100).alias("up"), r6(lat).alias("lat"), r6(lon).alias("lon"))


@plans.add("local_frame_geodesic", f"""WITH {SAMPLES_SQL}, {_inverse_sql('p', 'samples', 20.0, 55.0)}, lines AS (SELECT event_id, 20.0::DOUBLE AS lat, 55.0::DOUBLE AS lon, degrees(atan2(east, north)) AS az, sqrt(east * east + north * north) AS s FROM p), {_forward_sql('lines', 20)}, {_inverse_sql('q', 'fwd', 21.0, 56.0)}
SELECT event_id, round(p.east, 2) AS east, round(p.north, 2) AS north, round(q.east, 2) AS east_rebased, round(q.north, 2) AS north_rebased, round(lat, 6) AS lat, round(lon, 6) AS lon FROM fwd JOIN p USING (event_id) JOIN q USING (event_id)""")
def local_frame_geodesic(spark, sf_dir):
    """Into the local frame of (20, 55) on the ellipsoid, on into the frame of (21, 56), and each frame's way back; to centimetres, as the series leaves about a millionth of a metre open."""
    s = samples(spark, sf_dir).select("event_id", "lat", "lon", geo.geodesic_to_local(F.lit(20.0), F.lit(55.0), "lat", "lon").alias("p"))
    s = s.withColumn("back", geo.geodesic_from_local(F.lit(20.0), F.lit(55.0), "p.east", "p.north"))
    s = s.withColumn("q", geo.geodesic_to_local(F.lit(21.0), F.lit(56.0), "back.lat", "back.lon"))
    return s.select("event_id", *(F.round(f"p.{x}", 2).alias(x) for x in ("east", "north")), *(F.round(f"q.{x}", 2).alias(f"{x}_rebased") for x in ("east", "north")), r6("back.lat").alias("lat"), r6("back.lon").alias("lon"))


_TRUTH = f"""{SAMPLES_SQL}, truth AS (SELECT event_id AS idx, lat, lon, speed, heading FROM samples WHERE event_id % 7 <> 0),
est AS (SELECT event_id AS idx, lat + 0.0001 * (event_id % 5) AS lat, lon - 0.0002 * (event_id % 3) AS lon, speed + event_id % 4 AS speed, (heading + 3 * (event_id % 5)) % 360 AS heading, user_id FROM samples WHERE event_id % 5 <> 0)"""


def truth_and_estimates(spark, sf_dir):
    s = samples(spark, sf_dir)
    i = F.col("event_id")
    truth = s.where("event_id % 7 <> 0").select(i.alias("idx"), "lat", "lon", "speed", "heading")
    est = s.where("event_id % 5 <> 0").select(i.alias("idx"), "user_id", (F.col("lat") + (i % 5) * 0.0001).alias("e_lat"), (F.col("lon") - (i % 3) * 0.0002).alias("e_lon"), (F.col("speed") + i % 4).alias("e_speed"), F.pmod(F.col("heading") + (i % 5) * 3, F.lit(360.0)).alias("e_heading"))
    return truth, est


@plans.add("replay_metrics", f"""WITH {_TRUTH}, j AS (SELECT e.user_id, {_sql(_INVERSE, 't.lat', 't.lon', 'e.lat', 'e.lon')} AS d, abs(e.speed - t.speed) AS dv, abs((((e.heading - t.heading + 180) % 360 + 360) % 360) - 180) AS da FROM est e JOIN truth t USING (idx))
SELECT user_id, count(*)::BIGINT AS n, round(avg(d), 4) AS mean_m, round(max(d), 4) AS max_m, round(sqrt(avg(d * d)), 4) AS rmse_m, round(avg(dv), 6) AS speed_err, round(avg(da), 6) AS azimuth_err FROM j GROUP BY user_id""")
def replay_metrics(spark, sf_dir):
    truth, est = truth_and_estimates(spark, sf_dir)
    d, _ = geo.sphere_inverse(F.col("lat"), F.col("lon"), F.col("e_lat"), F.col("e_lon"))
    j = est.join(truth, "idx").select("user_id", d.alias("d"), F.abs(F.col("e_speed") - F.col("speed")).alias("dv"), F.abs(angles.turn(F.col("heading"), F.col("e_heading"))).alias("da"))
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 4).alias("mean_m"), F.round(F.max("d"), 4).alias("max_m"), F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 4).alias("rmse_m"), r6(F.avg("dv")).alias("speed_err"), r6(F.avg("da")).alias("azimuth_err"))


@plans.add("truth_left_join", f"WITH {_TRUTH} SELECT e.idx, t.lat AS truth_lat, t.heading AS truth_heading, t.idx IS NOT NULL AS known FROM est e LEFT JOIN truth t USING (idx)")
def truth_left_join(spark, sf_dir):
    truth, est = truth_and_estimates(spark, sf_dir)
    t = truth.select("idx", F.col("lat").alias("truth_lat"), F.col("heading").alias("truth_heading"), F.lit(True).alias("k"))
    return est.join(t, "idx", "left").select("idx", "truth_lat", "truth_heading", F.coalesce("k", F.lit(False)).alias("known"))


@plans.add("truth_clamped_join", f"WITH {_TRUTH}, o AS (SELECT lat, row_number() OVER (ORDER BY idx) - 1 AS i FROM truth), k AS (SELECT count(*) AS n FROM o) SELECT e.idx, o.lat AS truth_lat FROM est e, k, o WHERE o.i = least(e.idx, k.n - 1)")
def truth_clamped_join(spark, sf_dir):
    """Truth by its place in the list of all truth rows. Ranges of idx are numbered each by itself; their starts are sums of their counts, a row for each range."""
    truth, est = truth_and_estimates(spark, sf_dir)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = truth.agg(F.min("idx").alias("low"), (F.max("idx") - F.min("idx") + 1).alias("span"), F.count(F.lit(1)).alias("n"))
    ranged = truth.select("idx", "lat").crossJoin(F.broadcast(bounds)).withColumn("p", F.floor((F.col("idx") - F.col("low")) * parts / F.col("span")))
    starts = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("m")).select("p", (F.sum("m").over(W.orderBy("p")) - F.col("m")).alias("start"))
    placed = ranged.join(F.broadcast(starts), "p").select((F.col("start") + F.row_number().over(W.partitionBy("p").orderBy("idx")) - 1).alias("i"), F.col("lat").alias("truth_lat"))
    i = F.least(F.col("idx"), F.col("n") - 1)
    return est.select("idx").crossJoin(F.broadcast(bounds.select("n"))).withColumn("i", i).join(placed, "i").select("idx", "truth_lat")


@plans.add("last_ten_fixes", f"WITH {SAMPLES_SQL}, k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM samples) SELECT user_id, event_id, back::INT AS back FROM k WHERE back <= 10")
def last_ten_fixes(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return samples(spark, sf_dir).select("user_id", "event_id", F.row_number().over(w).alias("back")).where("back <= 10")


@plans.add("first_mode_event", f"WITH {SAMPLES_SQL} SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (event_type = 'error') AS first_loss, arg_min(event_id, (ts, event_id)) FILTER (event_type LIKE 'p%') AS first_p FROM samples GROUP BY user_id")
def first_mode_event(spark, sf_dir):
    at = F.struct("ts", "event_id")
    first = lambda cond: F.min(F.when(cond, at))["event_id"]
    return samples(spark, sf_dir).groupBy("user_id").agg(first(F.col("event_type") == "error").alias("first_loss"), first(F.col("event_type").startswith("p")).alias("first_p"))


@plans.add("bias_ema", f"""WITH {SAMPLES_SQL} SELECT user_id, round(list_reduce(list_prepend(0::DOUBLE, coalesce(list(agl - 250 ORDER BY ts, event_id) FILTER (agl IS NOT NULL), [])), lambda b, x: b * (1 - 0.1) + x * 0.1), 6) AS bias FROM samples GROUP BY user_id""")
def bias_ema(spark, sf_dir):
    got = samples(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("agl") - 250).alias("r")))).alias("rows"))
    return got.select("user_id", r6(O.fold_mean(F.transform("rows", lambda x: x["r"]), 0.0, 0.1)).alias("bias"))


@plans.add("path_offsets", f"WITH {SAMPLES_SQL} SELECT event_id, i::INT AS i, round(i * 2 * speed * sin(radians(heading)), 6) AS east, round(i * 2 * speed * cos(radians(heading)), 6) AS north FROM samples, generate_series(0, 3) g(i)")
def path_offsets(spark, sf_dir):
    s = samples(spark, sf_dir).select("event_id", "speed", F.radians("heading").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return s.select("event_id", "i", r6(F.col("i") * 2 * F.col("speed") * F.sin("h")).alias("east"), r6(F.col("i") * 2 * F.col("speed") * F.cos("h")).alias("north"))


@plans.add("benchmark_stats", f"WITH {SAMPLES_SQL} SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM samples GROUP BY event_type")
def benchmark_stats(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("event_type").agg(r6(F.avg("value")).alias("mean"), r6(F.expr("percentile(value, 0.95)")).alias("p95"))


@plans.add("track_error_planar", f"""WITH {_TRUTH} SELECT e.idx, round(sqrt(power((e.lat - t.lat) * 111320, 2) + power((e.lon - t.lon) * 111320 * cos(radians(t.lat)), 2)), 4) AS metres FROM est e JOIN truth t USING (idx)""")
def track_error_planar(spark, sf_dir):
    truth, est = truth_and_estimates(spark, sf_dir)
    north, east = (F.col("e_lat") - F.col("lat")) * geo.DEGREE_M, (F.col("e_lon") - F.col("lon")) * geo.DEGREE_M * F.cos(F.radians("lat"))
    return est.join(truth, "idx").select("idx", F.round(F.hypot(north, east), 4).alias("metres"))
