"""Connected components by alternating large-star and small-star rounds; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "star") -> DataFrame:
    """edges: columns a, b (bigint, a <> b; repeats and both directions allowed). Returns node, component (the least node reachable) for every node of an edge. No edge: no row."""
    held, before = scratch.write(small_star(edges), f"{name}-0"), None
    n = 0
    while True:
        now = held.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, n = now, n + 1
        fresh = scratch.write(small_star(large_star(held)), f"{name}-{n}")
        scratch.drop(f"{name}-{n - 1}")
        held = fresh
