"""Columns in the form for many rows give what the plain forms give."""

import math

from pyspark.sql import functions as F

from plumbline.plans.base import rounded


def test_rounding(spark):
    values = [0.0, -0.0, 0.00005, -0.00005, 1.00004999, -1.00005001, 123.45675, 1e15, -1e300, float("inf"), None]
    for x, y in spark.createDataFrame([(v,) for v in values], "x double").select("x", rounded(F.col("x"), 4).alias("y")).collect():
        if x is None or abs(x) > 1e14:
            assert y == x
        else:
            assert y == math.copysign(math.floor(abs(x) * 1e4 + 0.5) / 1e4, x) and str(y) != "-0.0"
