"""Kernels that fail on some rows, and what is set aside."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators.quarantine import guarded, refuse
from plumbline.streaming.run import stored

from .base import SAMPLES_SQL, Plans, r6, samples

plans = Plans()


def _height(rows: pd.DataFrame) -> pd.DataFrame:
    """Terrain heights of valid samples; a strict kernel, which refuses what it can't work on."""
    refuse(rows["valid"].ne(True), ValueError("no valid height"))
    refuse(rows["value"] >= 450, OverflowError("beyond the sensor's range"))
    return pd.DataFrame({"event_id": rows["event_id"], "height": 1500.0 - rows["value"]})


def _strict(spark, sf_dir):
    s = samples(spark, sf_dir).select("event_id", "user_id", "valid", "value")
    return guarded(s, _height, "event_id bigint, height double", lambda df: stored(df, "guarded"))


@plans.add("quarantined_rows", f"WITH {SAMPLES_SQL} SELECT event_id, CASE WHEN valid AND value < 450 THEN round(1500 - value, 6) END AS height, CASE WHEN NOT valid THEN 'ValueError: no valid height' WHEN value >= 450 THEN 'OverflowError: beyond the sensor''s range' END AS cause FROM samples")
def quarantined_rows(spark, sf_dir):
    """Every sample: its height, or why it was set aside."""
    got = _strict(spark, sf_dir)
    good = got.good.select("event_id", r6("height").alias("height"), F.lit(None).cast("string").alias("cause"))
    return good.union(got.bad.select("event_id", F.lit(None).cast("double"), "cause"))
