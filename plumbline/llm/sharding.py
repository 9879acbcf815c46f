"""Shards of near-equal bytes by longest-processing-time scheduling of groups that must stay together.

Groups of equal size are alike to the scheduler, so it is given how many groups there are of each size, largest first, and tells how
many of them each shard takes: what a heap of loads would do one group at a time. Its input has a row for each size of a group, so
it grows with the sizes that occur, not with the groups. Groups find their shard by their rank within their size.

Ranks and places within a shard are counted in splits of about SPLIT_ROWS rows, so a size, shard or group of any number of rows is
numbered by many tasks.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch

SPLIT_ROWS = 50_000


def deal(loads: list[int], size: int, groups: int) -> list[int]:
    """How many of that many groups of one size each shard takes, if each in turn goes to the least load (the lowest number of equals)."""
    n = len(loads)
    taken = [0] * n
    if groups > 4 * n:
        # as many as fit under a level are taken at once: the highest level that takes no more than there are
        below = lambda level: [max(0, -((x - level) // size)) for x in loads]
        low, high = min(loads), max(loads) + size * groups
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if sum(below(mid)) <= groups else (low, mid - 1)
        taken = below(low)
    heap = [(x + size * t, s) for s, (x, t) in enumerate(zip(loads, taken, strict=True))]
    heapq.heapify(heap)
    for _ in range(groups - sum(taken)):
        load, s = heap[0]
        taken[s] += 1
        heapq.heapreplace(heap, (load + size, s))
    return taken


def longest_first(sizes: dict[int, int], shards: int) -> dict[int, list[int]]:
    """sizes: size of a group to how many there are. For each size how many groups each shard takes, largest first."""
    loads, out = [0] * shards, {}
    for size in sorted(sizes, reverse=True):
        out[size] = deal(loads, size, sizes[size])
        loads = [x + size * t for x, t in zip(loads, out[size], strict=True)]
    return out


def _ranked(rows: DataFrame, scratch: Scratch, by: str, counts: dict[int, int], name: str) -> DataFrame:
    """rows with rank, from 0 among rows of one value of by. counts: of each value, rows. A window holds one split."""
    splits = rows.sparkSession.createDataFrame([(x, -(-n // SPLIT_ROWS)) for x, n in counts.items()], f"{by} bigint, splits int")
    # without splits of large values there is nothing to join
    many = max(counts.values(), default=0) > SPLIT_ROWS
    split: Column = F.pmod(F.xxhash64("row"), F.col("splits")).cast("int") if many else F.lit(0)
    dealt = (rows.join(splits, by) if many else rows).withColumn("split", split)
    dealt = scratch.write(dealt.drop("splits"), name)
    starts = dealt.groupBy(by, "split").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(by, "split", (F.sum("n").over(W.partitionBy(by).orderBy("split").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    within = dealt.withColumn("within", F.row_number().over(W.partitionBy(by, "split").orderBy("row")))
    return within.join(starts, [by, "split"]).withColumn("rank", F.col("start") + F.col("within") - 1).drop("split", "start", "within")


def shard(docs: DataFrame, scratch: Scratch, shards: int = 40) -> DataFrame:
    """Puts every row of docs (doc_id, text) into a shard; rows of equal text share one.

    Size: UTF-8 bytes of the text plus 16; a null text has none and goes with empty texts. Shards are near equal in bytes as far as
    whole groups allow: the schedule of longest processing time over all groups, exactly.

    Returns doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard). Repeated and null doc_ids each
    get a row and a slot. An empty table gives no row. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("k"))
    rows = scratch.write(rows, "rows")
    groups = rows.groupBy("k").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = scratch.write(groups.withColumn("row", F.monotonically_increasing_id()), "groups")
    sizes = {r.bytes: r.n for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = longest_first(sizes, shards)
    # ranks below the first end go to the first shard that takes any, and so on
    takes = [(size, [s for s in range(shards) if t[s]], [sum(t[: s + 1]) for s in range(shards) if t[s]]) for size, t in plan.items()]
    table = spark.createDataFrame(takes, "bytes bigint, shards array<int>, ends array<bigint>")
    ranked = _ranked(groups.select("row", "k", "bytes", "n"), scratch, "bytes", sizes, "ranks").join(table, "bytes")
    homes = ranked.select("k", "n", F.element_at("shards", F.size(F.filter("ends", lambda e: e <= F.col("rank"))) + 1).alias("shard"))
    homes = scratch.write(homes, "homes")
    counts = {r.shard: r.n for r in homes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    placed = rows.join(homes.select("k", F.col("shard").cast("bigint").alias("shard")), "k").select("row", "doc_id", "size", "text_crc32", "shard")
    placed = _ranked(placed, scratch, "shard", counts, "places")
    scratch.drop("rows", "groups", "ranks", "homes")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("rank").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
