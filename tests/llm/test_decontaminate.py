import hashlib
import re

from pyspark.sql import functions as F

from plumbline.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert any(x[5] for x in want)
    assert got(D.contamination(docs, items)) == want
    assert D.without_contaminated(docs, items).count() == sum(not x[5] for x in want)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short ITEM"), (10, "a b c d e f g h i j"), (11, "a a"), (3, None), (4, "!!"), (2, "short item"), (None, "no id item"), (5, "é ü ß")]
DOCS = [(1, "x ONE, two-three four five six seven eight nine ten eleven twelve y"), (2, "a short item; shortitem short items"), (3, "a a a a"), (4, None), (5, ""), (6, "..."), (7, "a b c d e f g h i"), (8, "q " * 30_000 + "a b c d e f g h i j"), (None, "No id item"), (2, "É ü ß é ü ß"), (9, "short")]


def test_odd_rows(spark, monkeypatch):
    for most in (16_000_000, 150):
        monkeypatch.setattr(D, "BLOCK_BYTES", most)
        docs = spark.createDataFrame([(*x, 1) for x in DOCS], "doc_id long, text string, items int")
        items = spark.createDataFrame(ITEMS, "item_id long, text string")
        assert got(D.contamination(docs, items)) == brute(DOCS, ITEMS)
        assert D.contamination(docs.limit(0), items).count() == 0
        assert not any(r.contaminated for r in D.contamination(docs, items.limit(0)).collect())
        assert D.without_contaminated(docs, items).columns == ["doc_id", "text", "items"]
        ranges = {r.doc_id: [tuple(x) for x in r.word_ranges] for r in D.contamination(docs, items).collect() if r.doc_id in (1, 3)}
        assert ranges == {1: [(1, 12)], 3: [(0, 3)]}
        assert (len(D.blocks(items)) > 1) == (most == 150)
        seen = 0
        for r in D.contamination(docs.select("text", F.struct("doc_id", "text").alias("doc_id")), items).collect():
            text = r.doc_id.text
            for w, c in zip(r.word_ranges, r.char_ranges, strict=True):
                part = text[c.begin : c.end]
                assert words(part) == words(text)[w.first : w.last + 1] and words(part[0]) and words(part[-1])
                seen += 1
        assert seen >= 5
