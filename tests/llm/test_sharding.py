import random
import zlib
from collections import Counter, defaultdict

from plumbline.llm import sharding as S
from plumbline.llm.store import Scratch


def laws(rows, texts, shards):
    """Every row once, equal texts together, slots gapless; gives the bytes of each shard."""
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in enumerate(texts))
    slots, load, home = defaultdict(list), [0] * shards, {}
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert home.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return load


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").select("text").collect()]
    load = laws(S.shard(docs, Scratch(spark)).collect(), texts, 40)
    assert max(load) < 1.005 * min(load)


def test_hot_group_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "SPLIT_ROWS", 7)
    rng = random.Random(2)
    texts = ["hot " * 20] * 300 + [None, "", "é" * 50_000] + ["x" * rng.randrange(400) + str(i) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    load = laws(S.shard(docs, Scratch(spark), 7).collect(), texts, 7)
    hot, rest = 300 * 96, sorted(load)[:-2]
    assert max(load) >= hot and max(rest) - min(rest) < 600
    assert S.shard(docs.limit(0), Scratch(spark), 7).count() == 0
    again = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, "b")], "doc_id long, text string")
    assert S.shard(again, Scratch(spark), 2).count() == 4


def brute(sizes, shards):
    """Longest first, one group at a time: the loads, and how many of each size each shard takes."""
    loads, out = [0] * shards, defaultdict(lambda: [0] * shards)
    for x in sorted(sizes, reverse=True):
        s = min(range(shards), key=lambda k: (loads[k], k))
        loads[s] += x
        out[x][s] += 1
    return loads, dict(out)


def test_longest_first():
    rng = random.Random(5)
    for _ in range(200):
        shards = rng.randrange(1, 9)
        sizes = [rng.choice([rng.randrange(16, 40), 17, rng.randrange(16, 3000)]) for _ in range(rng.randrange(300))]
        assert S.longest_first(Counter(sizes), shards) == brute(sizes, shards)[1]


def test_equals_brute_force_over_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    texts = [t for _, t in sorted((r.doc_id, r.text) for r in rows)]
    groups = Counter(t or "" for t in texts)
    load = laws(S.shard(docs, Scratch(spark)).collect(), texts, 40)
    assert load == brute([(len(t.encode()) + 16) * n for t, n in groups.items()], 40)[0]
