import hashlib
import random
import time
from collections import Counter

import xxhash

from plumbline.llm import order_minhash as O


def hashed(*values):
    """Spark's xxhash64: each value is hashed with what came before as seed, longs as eight bytes."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v if isinstance(v, bytes) else (v & (2**64 - 1)).to_bytes(8, "little"), seed=seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def reference(text):
    """The fingerprint by brute force: all numbered k-mers in every one of the orders."""
    n = len(text)
    grams = [text[i : i + O.K].encode("utf-32-be") for i in range(max(n - O.K + 1, 1 if n else 0))]
    seen, numbered = Counter(), []
    for place, g in enumerate(grams):
        h = hashed(g)
        # hashes are told apart by all but PLACE bits
        numbered.append((h >> O.PLACE, place, (h >> 32) & 31, seen[h >> O.PLACE], g))
        seen[h >> O.PLACE] += 1
    bins = [[] for _ in range(O.ORDERS)]
    for x in sorted(numbered)[: O.MOST]:
        bins[x[2] ^ (x[3] & 31)].append(x)
    out = []
    for j in range(O.ORDERS if numbered else 0):
        order = [x for k in range(O.ORDERS) for x in bins[(j + k) % O.ORDERS][: O.L]][: O.L]
        h = 42
        for _, _, _, number, g in sorted(order, key=lambda x: x[1]):
            h = hashed(h, g, number)
        out.append((h & (2**64 - 1)) >> 32)
    return out


def alike(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else sum(x == y for x, y in zip(a, b, strict=True)) / O.ORDERS


def check(rows, got):
    """rows: (doc_id, text). The edited texts, counts and likenesses that the contract fixes."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, own = {}, {t: reference(t) for t in {t or "" for _, t in rows}}
    text = lambda slots: "".join(f"{x:08x}" for x in slots)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        slots = reference(edited)
        want.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), text(own[t]), text(slots), alike(own[t], slots), alike(own[t], own[after])))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    seen = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(texts[r.doc_id]) == 1:
            t = next(iter(texts[r.doc_id]))
            assert seen.setdefault(t, r.fingerprint) == r.fingerprint
    return seen


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = O.edited_fingerprints(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = df.collect()
    seen = check(rows, got)
    assert len(set(seen.values())) > 0.98 * len(seen)
    long = [r for r in got if r.n_chars > 500]
    # 3 of 5 numbered k-mers are shared, so about a fifth of the tuples of three
    assert sum(r.near_edited for r in long) / len(long) > 0.2
    assert sum(r.near_next for r in long) / len(long) < 0.01
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_odd_rows(spark, buckets="3"):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "one", "one two", "one two three", "é" * 9, "日本 語の", "日本語の文章です。" * 3 + "終", "😀 x" * 5, "ab", "a " * 4000, " ".join(rng.choices(words, k=3000)), "one two three"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "no id"), (None, None)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pairs int")
        check(rows, O.edited_fingerprints(docs).collect())
        assert O.edited_fingerprints(docs.limit(0)).count() == 0
        one = O.edited_fingerprints(docs.where("doc_id = 12")).collect()
        assert len(one) == 1 and one[0].near_next == 1.0
        lone = docs.where("doc_id is null")
        check([r for r in rows if r[0] is None], O.edited_fingerprints(lone).collect())
        assert O.fingerprints(docs).where("fingerprint = ''").count() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_a_filter_on_fingerprints_ends(spark):
    """A filter stays above the expressions that make the slots."""
    rows = [(i, t) for i, t in enumerate([None, "", "one two three", "x" * 400, "the same words again and again " * 40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    for df in (O.fingerprints(docs), O.edited_fingerprints(docs)):
        some = df.where("fingerprint = '' or fingerprint > '8'")
        assert len(some._jdf.queryExecution().optimizedPlan().toString()) < 2 * len(df._jdf.queryExecution().optimizedPlan().toString())
        want = [r.doc_id for r in df.collect() if r.fingerprint == "" or r.fingerprint > "8"]
        assert sorted(r.doc_id for r in some.collect()) == sorted(want) and {0, 1} <= set(want)
    assert O.with_slots(docs.na.fill(""), "text").where("size(slots) = 32 and slots[0] > 0").count() == 3
    assert time.time() - began < 60


def test_occurrences_and_order_count(spark):
    """The same k-mers in another order, or more often, give another fingerprint."""
    a, b = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(200))
    rows = [(0, f"{a} {b}"), (1, f"{b} {a}"), (2, "x y z " * 3), (3, "x y z " * 4), (4, "z" * 9000)]
    got = {r.doc_id: r.fingerprint for r in O.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "".join(f"{x:08x}" for x in reference(t)) for i, t in rows}
    assert got[0] != got[1] and got[2] != got[3]
    slots = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
    assert 0 < sum(x == y for x, y in zip(slots(got[0]), slots(got[1]), strict=True)) < O.ORDERS


def test_likeness_follows_edits_of_unspaced_text(spark):
    """A text without spaces loses likeness with each edit, not all of it with the first."""
    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(460))
    steps = [0, 1, 4, 16, 64]
    rows = []
    for k in steps:
        t = list(text)
        for i in rng.sample(range(460), k):
            t[i] = "あ"
        rows.append((k, "".join(t)))
    df = O.with_slots(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    first = df.where("doc_id = 0").select(df.slots.alias("first"))
    near = {r.doc_id: r.near for r in df.crossJoin(first).select("doc_id", O.likeness(df["slots"], first["first"]).alias("near")).collect()}
    assert near[0] == 1.0 and near[1] > 0.7 and near[4] > 0.3, near
    assert [near[k] for k in steps] == sorted(near.values(), reverse=True) and near[64] < 0.2
