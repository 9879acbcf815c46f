"""Simulated routes, inertial readings and sensor errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import angles
from plumbline.operators import simulate as S

from .base import SAMPLES_SQL, track_order, Plans, r6, samples

plans = Plans()


@plans.add("sim_trajectory", """WITH seg(segment, azimuth, e0, n0, i0, bank) AS (VALUES (0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0, 0::DOUBLE), (1, 45::DOUBLE, 0::DOUBLE, 5000::DOUBLE, 500, 22.5::DOUBLE))
SELECT (i0 + j)::INT AS index, (i0 + j)::DOUBLE / 5 AS timestamp_s, segment, round(e0 + j * 10 * sin(radians(azimuth)), 4) AS east, round(n0 + j * 10 * cos(radians(azimuth)), 4) AS north, 1500::DOUBLE AS alt, azimuth, 50::DOUBLE AS speed, bank FROM seg, generate_series(0, 499) g(j)""")
def sim_trajectory(spark, sf_dir):
    p = S.points(spark, S.route(2, 1500.0), 5.0)
    return p.withColumns({c: F.round(c, 4) for c in ("east", "north")})


_V = f"""{SAMPLES_SQL}, v AS (SELECT event_id, user_id, ts, t / 100 AS t, heading, speed * sin(radians(heading)) AS ve, speed * cos(radians(heading)) AS vn, value / 10 AS vu FROM samples),
d AS (SELECT *, greatest(t - lag(t) OVER w, 0.000001) AS dt, ve - lag(ve) OVER w AS de, vn - lag(vn) OVER w AS dn, vu - lag(vu) OVER w AS du, ((((heading - lag(heading) OVER w + 180) % 360) + 360) % 360) - 180 AS dh FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@plans.add("sim_imu", f"""WITH {_V} SELECT event_id, round(coalesce(de / dt, 0) * sin(radians(heading)) + coalesce(dn / dt, 0) * cos(radians(heading)), 5) AS accel_x, round(coalesce(de / dt, 0) * cos(radians(heading)) - coalesce(dn / dt, 0) * sin(radians(heading)), 5) AS accel_y,
  round(coalesce(du / dt, 0) + 9.80665, 5) AS accel_z, round(coalesce(radians(dh) / dt, 0), 6) AS gyro_z FROM d""")
def sim_imu(spark, sf_dir):
    h = F.radians("heading")
    track = samples(spark, sf_dir).select("event_id", "user_id", "ts", (F.col("t") / 100).alias("t"), "heading", (F.col("speed") * F.sin(h)).alias("v_east"), (F.col("speed") * F.cos(h)).alias("v_north"), (F.col("value") / 10).alias("v_up"))
    got = S.imu(track, ["user_id"], ["ts", "event_id"])
    return got.select("event_id", *(F.round(c, 5).alias(c) for c in ("accel_x", "accel_y", "accel_z")), r6("gyro_z").alias("gyro_z"))


_READ = f"""{SAMPLES_SQL}, r AS (SELECT event_id, 1500 - value AS ground, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'forest' WHEN 2 THEN 'snow' ELSE 'mask' END AS mode, (event_id % 10)::DOUBLE / 10 AS mask, least(coalesce(abs(((((heading - lag(heading) OVER w + 180) % 360) + 360) % 360) - 180), 0) * 0.5, 25) AS bank,
  ((event_id * 17) % 200)::DOUBLE / 100 - 1 AS z, ((event_id * 31) % 100)::DOUBLE / 100 AS u1, ((event_id * 47) % 100)::DOUBLE / 100 AS u2 FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CASE mode WHEN 'none' THEN 0 WHEN 'mask' THEN CASE WHEN mask > 0.5 THEN 4 ELSE 0 END ELSE 4 END AS bias FROM r)"""


@plans.add("sim_sensor_model", f"WITH {_READ} SELECT event_id, CASE WHEN u2 >= 0.05 THEN round((1500 - (ground + bias)) / cos(radians(bank)) + z * 2.5 + CASE WHEN u1 < 0.03 THEN z * 40 ELSE 0 END, 5) END AS agl FROM b")
def sim_sensor_model(spark, sf_dir):
    i = F.col("event_id")
    part = lambda k, n: (i * k % n).cast("double")
    bank = F.least(F.coalesce(F.abs(angles.turn(F.lag("heading").over(track_order()), F.col("heading"))), F.lit(0.0)) * 0.5, F.lit(25.0))
    mode = F.element_at(F.array(*map(F.lit, ("none", "forest", "snow", "mask"))), (i % 4 + 1).cast("int"))
    r = samples(spark, sf_dir).select("event_id", (1500 - F.col("value")).alias("ground"), mode.alias("mode"), ((i % 10).cast("double") / 10).alias("mask"), bank.alias("bank"), (part(17, 200) / 100 - 1).alias("z"), (part(31, 100) / 100).alias("u1"), (part(47, 100) / 100).alias("u2"))
    z = F.col("z")
    agl = S.reading(F.lit(1500.0), F.col("ground"), S.surface_bias(F.col("mode"), 4.0, F.col("mask")), F.col("bank"), F.lit(2.5), z, F.col("u1"), z, F.col("u2"), 0.03, 40.0, 0.05)
    return r.select("event_id", F.round(agl, 5).alias("agl"))
