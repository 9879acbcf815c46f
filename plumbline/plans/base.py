"""Tables as the domain's objects: samples of tracks, the reference grid, a measured profile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import clock

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Plans:
    """Queries of one module and their SQL; sql() with BASE prepended where it is named."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(c: Column, digits: int) -> Column:
    """Halves away from zero, by the nearest multiple in floating point, as SQL engines do it; F.round goes through decimal numbers, which takes most of the time where rows are many."""
    whole = F.when(c < 0, -F.floor(c * -(10.0**digits) + 0.5)).otherwise(F.floor(c * 10.0**digits + 0.5))
    return F.when(F.abs(c) < 2.0**52 / 10**digits, whole / F.lit(10.0**digits)).otherwise(c)


def track_order():
    """Order of one vehicle's samples; event_id breaks ties."""
    return W.partitionBy("user_id").orderBy("ts", "event_id")


#: Of each sample: when within its day, whether it is valid, its height over ground, and a place and motion made from its numbers.
SAMPLES_SQL = """samples AS (
  SELECT event_id, user_id, ts, event_type, value, epoch_us(ts) AS us, (epoch_us(ts) // 1000) % 86400000 AS ms,
         epoch_us(ts)::DOUBLE / 1000000 AS t, event_type <> 'error' AS valid, CASE WHEN event_type <> 'error' THEN value END AS agl,
         10 + ((event_id * 37) % 2000)::DOUBLE / 100 AS lat, 40 + ((event_id * 91 + user_id) % 3000)::DOUBLE / 100 AS lon,
         ((event_id * 53) % 3600)::DOUBLE / 10 AS heading, 20 + ((event_id * 29) % 600)::DOUBLE / 10 AS speed
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    scaled = lambda expr, div: (F.expr(expr) / F.lit(div)).cast("double")
    return e.select(
        "event_id", "user_id", "ts", "event_type", "value",
        clock.micros().alias("us"),
        clock.day_ms().alias("ms"),
        (clock.micros().cast("double") / 1_000_000).alias("t"),
        (F.col("event_type") != "error").alias("valid"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("agl"),
        (10 + scaled("(event_id * 37) % 2000", 100.0)).alias("lat"),
        (40 + scaled("(event_id * 91 + user_id) % 3000", 100.0)).alias("lon"),
        scaled("(event_id * 53) % 3600", 10.0).alias("heading"),
        (20 + scaled("(event_id * 29) % 600", 10.0)).alias("speed"),
    )
