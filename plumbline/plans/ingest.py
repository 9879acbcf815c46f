"""Sentences, validation, time tokens and scalar conversions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import angles, clock, sentence

from .base import SAMPLES_SQL, track_order, Plans, r6, samples, table

plans = Plans()

_TOKEN = "printf('%02d%02d%02d.%03d', (ms // 3600000) % 24, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000)"
_TENTHS = "CASE WHEN agl IS NULL THEN '' ELSE (floor(agl * 10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor(agl * 10 + 0.5)::BIGINT % 10)::VARCHAR END"
_XOR = "printf('%02X', list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)), lambda a, b: xor(a, b)))"
SENTENCES_SQL = f"""{SAMPLES_SQL}, payloads AS (
  SELECT *, CASE WHEN event_id % 23 = 0 THEN 'GPRMC' WHEN event_id % 5 = 0 THEN 'GNGGA' ELSE 'GPGGA' END || ',' || {_TOKEN} || ',,,,,1,08,1.0,' || {_TENTHS} || ',M,0.0,M,,' AS payload FROM samples
), sentences AS (
  SELECT *, '$' || payload || '*' || CASE WHEN event_id % 17 = 0 THEN 'ZZ' ELSE {_XOR.format('payload')} END AS line FROM payloads)"""


def sentences(spark, sf_dir):
    """A log: a sentence for each sample, some of another kind, some with a wrong checksum."""
    s = samples(spark, sf_dir)
    token = clock.token(F.col("ms"))
    kind = lambda k: sentence.build(token, F.col("agl"), k)
    line = F.when(F.col("event_id") % 23 == 0, kind("GPRMC")).when(F.col("event_id") % 5 == 0, kind("GNGGA")).otherwise(kind("GPGGA"))
    return s.withColumn("line", F.when(F.col("event_id") % 17 == 0, F.concat(F.substring_index(line, "*", 1), F.lit("*ZZ"))).otherwise(line))


@plans.add("nmea_encode", f"WITH {SENTENCES_SQL} SELECT event_id, line FROM sentences")
def nmea_encode(spark, sf_dir):
    return sentences(spark, sf_dir).select("event_id", "line")


_PARSED = f"""{SENTENCES_SQL}, parsed AS (
  SELECT event_id, user_id, ts, split_part(payload, ',', 2) AS timestamp_utc, TRY_CAST(nullif(split_part(payload, ',', 10), '') AS DOUBLE) AS radar_alt_m,
         line AS raw, event_id % 17 <> 0 AS valid
  FROM sentences WHERE event_id % 23 <> 0)"""


def frames(spark, sf_dir):
    return sentences(spark, sf_dir).select("event_id", "user_id", "ts", sentence.parsed_rows(F.col("line")))


@plans.add("nmea_parse_roundtrip", f"WITH {_PARSED} SELECT event_id, timestamp_utc, radar_alt_m, raw, valid, round(substr(timestamp_utc, 1, 2)::DOUBLE * 3600 + substr(timestamp_utc, 3, 2)::DOUBLE * 60 + substr(timestamp_utc, 5)::DOUBLE, 6) AS seconds FROM parsed")
def nmea_parse_roundtrip(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", "timestamp_utc", "radar_alt_m", "raw", "valid", r6(clock.seconds(F.col("timestamp_utc"))).alias("seconds"))


@plans.add("nmea_invalid_filter", f"WITH {_PARSED} SELECT event_id, radar_alt_m FROM parsed WHERE valid AND radar_alt_m IS NOT NULL")
def nmea_invalid_filter(spark, sf_dir):
    return frames(spark, sf_dir).where("valid and radar_alt_m is not null").select("event_id", "radar_alt_m")


@plans.add("read_window_limit", f"WITH {_PARSED} SELECT event_id, timestamp_utc, radar_alt_m FROM parsed WHERE valid ORDER BY ts, event_id LIMIT 50")
def read_window_limit(spark, sf_dir):
    return frames(spark, sf_dir).where("valid").orderBy("ts", "event_id").limit(50).select("event_id", "timestamp_utc", "radar_alt_m")


@plans.add("valid_frame_index", f"WITH {_PARSED} SELECT event_id, valid, coalesce(sum(valid::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS frame_index FROM parsed")
def valid_frame_index(spark, sf_dir):
    before = track_order().rowsBetween(W.unboundedPreceding, -1)
    return frames(spark, sf_dir).select("event_id", "valid", F.coalesce(F.sum(F.col("valid").cast("bigint")).over(before), F.lit(0)).cast("bigint").alias("frame_index"))


@plans.add("infer_frequency", f"""WITH {_PARSED}, steps AS (
  SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))::DOUBLE / 1000000 AS dt FROM parsed WHERE valid AND radar_alt_m IS NOT NULL
) SELECT user_id, count(*)::BIGINT + 1 AS n_valid, round(1 / median(dt), 9) AS hz FROM steps WHERE dt > 0.000001 GROUP BY user_id""")
def infer_frequency(spark, sf_dir):
    dt = (clock.micros() - F.lag(clock.micros()).over(track_order())).cast("double") / 1_000_000
    return frames(spark, sf_dir).where("valid and radar_alt_m is not null").select("user_id", dt.alias("dt")).where("dt > 0.000001").groupBy("user_id").agg((F.count(F.lit(1)) + 1).alias("n_valid"), F.round(1 / F.median("dt"), 9).alias("hz"))


@plans.add("frequency_check", f"""WITH {_PARSED}, steps AS (
  SELECT user_id, valid AND radar_alt_m IS NOT NULL AS good, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, valid AND radar_alt_m IS NOT NULL ORDER BY ts, event_id))::DOUBLE / 1000000 AS dt FROM parsed
), k AS (SELECT user_id, count(*) FILTER (good)::BIGINT AS n_valid, 1 / median(dt) FILTER (good AND dt > 0.000001) AS hz FROM steps GROUP BY user_id)
SELECT user_id, n_valid, round(hz, 9) AS hz, CASE WHEN n_valid = 0 THEN 'no_valid_frames' WHEN hz < 1 - 0.000001 OR hz > 10 + 0.000001 THEN 'frequency_out_of_range' ELSE 'ok' END AS verdict FROM k""")
def frequency_check(spark, sf_dir, low: float = 1.0, high: float = 10.0):
    """Each track's rate, from the median step between valid frames, and whether it is one to be taken; a rate that can't be told is."""
    good = F.coalesce(F.col("valid") & F.col("radar_alt_m").isNotNull(), F.lit(False))
    f = frames(spark, sf_dir).withColumn("good", good)
    dt = (clock.micros() - F.lag(clock.micros()).over(W.partitionBy("user_id", "good").orderBy("ts", "event_id"))).cast("double") / 1_000_000
    steps = f.select("user_id", "good", dt.alias("dt"))
    k = steps.groupBy("user_id").agg(F.count_if("good").alias("n_valid"), (1 / F.median(F.when(F.col("good") & (F.col("dt") > 0.000001), F.col("dt")))).alias("hz"))
    outside = (F.col("hz") < low - 0.000001) | (F.col("hz") > high + 0.000001)
    return k.select("user_id", "n_valid", F.round("hz", 9).alias("hz"), F.when(F.col("n_valid") == 0, "no_valid_frames").when(outside, "frequency_out_of_range").otherwise("ok").alias("verdict"))


@plans.add("invalid_ratio_monitor", f"""WITH {SAMPLES_SQL}, seen AS (
  SELECT event_id, count(*) OVER w AS n, avg((NOT valid)::INT) OVER w AS ratio FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
) SELECT event_id, round(ratio, 6) AS ratio, ratio > 0.05 AS warn FROM seen WHERE n = 20""")
def invalid_ratio_monitor(spark, sf_dir, size: int = 20, most: float = 0.05):
    """The share of invalid samples among the last size ones, once so many are seen."""
    last = track_order().rowsBetween(1 - size, 0)
    seen = samples(spark, sf_dir).select("event_id", F.count(F.lit(1)).over(last).alias("n"), F.avg((~F.col("valid")).cast("int")).over(last).alias("ratio"))
    return seen.where(F.col("n") == size).select("event_id", r6("ratio").alias("ratio"), (F.col("ratio") > most).alias("warn"))


@plans.add("agl_to_terrain", f"WITH {SAMPLES_SQL} SELECT event_id, round((1500 - 2.5) - agl - 1.25, 6) AS terrain_m FROM samples")
def agl_to_terrain(spark, sf_dir, baro: float = 1500.0, baro_bias: float = 2.5, terrain_bias: float = 1.25):
    return samples(spark, sf_dir).select("event_id", r6((F.lit(baro) - baro_bias) - F.col("agl") - terrain_bias).alias("terrain_m"))


@plans.add("angle_wrap_delta", f"""WITH {SAMPLES_SQL}, a AS (SELECT event_id, heading * 3 - 500 AS a, heading AS b FROM samples)
SELECT event_id, round(((a % 360) + 360) % 360, 6) AS wrapped, round(((((b - a + 180) % 360) + 360) % 360) - 180, 6) AS delta FROM a""")
def angle_wrap_delta(spark, sf_dir):
    a, b = F.col("heading") * 3 - 500, F.col("heading")
    return samples(spark, sf_dir).select("event_id", r6(angles.wrap360(a)).alias("wrapped"), r6(angles.turn(a, b)).alias("delta"))


@plans.add("time_token_seconds", f"""WITH {SAMPLES_SQL}, k AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN (event_id % 9000)::VARCHAR WHEN 2 THEN 'x1y2z3' ELSE {_TOKEN} END AS token FROM samples)
SELECT event_id, CASE WHEN token = '' THEN NULL WHEN length(replace(token, '.', '')) < 6 THEN TRY_CAST(token AS DOUBLE)
  ELSE round(TRY_CAST(substr(token, 1, 2) AS DOUBLE) * 3600 + TRY_CAST(substr(token, 3, 2) AS DOUBLE) * 60 + TRY_CAST(substr(token, 5) AS DOUBLE), 6) END AS seconds FROM k""")
def time_token_seconds(spark, sf_dir):
    n = F.col("event_id") % 5
    token = F.when(n == 0, "").when(n == 1, (F.col("event_id") % 9000).cast("string")).when(n == 2, "x1y2z3").otherwise(clock.token(F.col("ms")))
    return samples(spark, sf_dir).select("event_id", r6(clock.seconds(token)).alias("seconds"))


@plans.add("meters_to_degrees", f"WITH {SAMPLES_SQL} SELECT event_id, round(value / 111320, 9) AS d_lat, round(value / (111320 * cos(radians(lat))), 9) AS d_lon FROM samples")
def meters_to_degrees(spark, sf_dir):
    from plumbline.functions.geo import metres_to_degrees

    d_lat, d_lon = metres_to_degrees(F.col("lat"), F.col("value"), F.col("value"))
    return samples(spark, sf_dir).select("event_id", F.round(d_lat, 9).alias("d_lat"), F.round(d_lon, 9).alias("d_lon"))


@plans.add("format_metric", f"WITH {SAMPLES_SQL} SELECT event_id, CASE WHEN agl IS NULL THEN 'n/a' ELSE (floor(agl * 10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor(agl * 10 + 0.5)::BIGINT % 10)::VARCHAR || ' m' END AS label, upper(event_type) || ' ' || user_id::VARCHAR AS note FROM samples")
def format_metric(spark, sf_dir):
    text = sentence.altitude_tenths(F.col("agl"))
    return samples(spark, sf_dir).select("event_id", F.when(text == "", "n/a").otherwise(F.concat(text, F.lit(" m"))).alias("label"), F.concat_ws(" ", F.upper("event_type"), F.col("user_id").cast("string")).alias("note"))


@plans.add("upload_manifest", f"""WITH {SAMPLES_SQL} SELECT event_id, 'log_' || event_id::VARCHAR || '.nmea' AS name, (8 + length(event_type))::INT AS n_bytes FROM samples""")
def upload_manifest(spark, sf_dir):
    """Uploads as base64 text: decoded size, and a safe base name of the given path."""
    up = samples(spark, sf_dir).select("event_id", F.base64(F.concat(F.lit("content:"), "event_type").cast("binary")).alias("body"), F.concat(F.lit("../x/log:"), F.col("event_id").cast("string"), F.lit(".nmea")).alias("path"))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]", "_")
    return up.select("event_id", name.alias("name"), F.octet_length(F.unbase64("body")).alias("n_bytes"))
