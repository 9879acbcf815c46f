import hashlib
import random
import re

from pyspark.sql import functions as F

from plumbline.llm import fill_middle as M


def reference(doc_id, text, seed=1, turned=90, suffix_first=20):
    """By making all units."""
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= turned:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < suffix_first else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_units_are_placed_as_by_a_regular_expression():
    rng, a = random.Random(1), M.automaton()
    for _ in range(5000):
        text = "".join(rng.choices("aBz P<>SM.é日😀\n1", k=rng.randrange(14)))
        found, units = M.Units(text, a), re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert found.n == len(units) and found.marked == any(s in text for s in ("<P>", "<S>", "<M>"))
        assert [found.place(r) for r in range(len(units) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]


def test_odd_rows_and_round_trip(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "é", "\n", "word", "two words", "<P", "<P>", "x<M>y", "S><M", "<<<", "ab<", ">P>", "日本 語 abc", "😀😀 é", "\x00 z", "a" * 100_000, "é" * 50_000, "ab 1é" * 30_000, "<S" * 20_000]
    texts += ["".join(rng.choices("ab <>PSM.é😀\n", k=rng.randrange(40))) for _ in range(400)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id here", "x"), (None, None, "x"), (3, "same id", "x"), (3, "same id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = M.transform(docs).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *reference(i, t)) for i, t, _ in rows), key=key)
    assert sorted((repr(r.doc_id), r.back) for r in got) == sorted((repr(i), t or "") for i, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.digests(docs.limit(0)).count() == 0


def test_shares_follow_the_parameters(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two, three. four five").alias("text"))
    counts = {r.form: r["count"] for r in M.transform(docs, seed=7, turned=50, suffix_first=70).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 2000) < 150 and abs(counts["spm"] - 1400) < 150
    assert {r.form for r in M.transform(docs, turned=0).select("form").distinct().collect()} == {"plain"}


def test_filter_on_restored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = M.digests(docs)
    texts = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("own"))
    assert got.join(texts, "doc_id").where("own = restored_sha256").count() == docs.count() == got.count()
