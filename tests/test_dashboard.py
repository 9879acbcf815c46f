"""Tables for a screen: bounded, whatever a track's length, and blind to the order of rows."""

import math

from pyspark.sql import functions as F

from plumbline.operators import dashboard as B


def test_an_outline_is_bounded_and_keeps_the_shape(spark):
    rows = [(k, float(i), i, 10.0 * i, 300 * math.sin(i / (40 + k))) for k in range(3) for i in range(3000)]
    df = spark.createDataFrame(rows, "key int, t double, id int, east double, north double")
    got = B.outline(df, ["key"], "t", "id", 32)
    again = B.outline(df.orderBy(F.rand(5)).repartition(7), ["key"], "t", "id", 32)
    kept = sorted(map(tuple, got.collect()))
    assert kept == sorted(map(tuple, again.collect())) and got.columns == df.columns
    for k in range(3):
        own = [r for r in kept if r[0] == k]
        assert len(own) <= 3 * 32 + 1 and own[0][2] == 0 and own[-1][2] == 2999
        # every point lies near the line through the points kept
        for _, _, i, east, north in rows[k * 3000 : (k + 1) * 3000]:
            a, b = max(r for r in own if r[2] <= i), min(r for r in own if r[2] >= i)
            line = a[4] if a == b else a[4] + (b[4] - a[4]) * (east - a[3]) / (b[3] - a[3])
            assert abs(line - north) < 150


def test_odd_tracks(spark):
    rows = [(1, 5.0, 1, 0.0, 0.0), (2, 5.0, 1, 0.0, 0.0), (2, 5.0, 2, 3.0, 4.0), (3, None, 1, 0.0, 0.0), (4, 1.0, 1, None, 0.0), (5, 0.0, 1, 0.0, 0.0), (5, 1.0, 2, 9.0, 0.0), (5, 2.0, 3, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "key int, t double, id int, east double, north double")
    got = sorted((r.key, r.id) for r in B.outline(df, ["key"], "t", "id", 1).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (5, 1), (5, 2), (5, 3)]
    assert B.outline(df.limit(0), ["key"], "t", "id").count() == 0
