import math
import random
import re

import numpy as np

from plumbline.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return [tuple(w[i : i + L.WORDS]) for i in range(max(1, len(w) - L.WORDS + 1))] if w else []


def brute(texts, templates):
    """The best containment over all windows, without retrieval: for templates of up to hi = 2 ** k distinct shingles windows of 2 * hi begin every hi + 1."""
    out = []
    own = {n: set(shingles(t)) for n, t in templates.items()}
    for t in texts:
        s, found = shingles(t), {}
        for name, x in own.items():
            if x & set(s):
                hi = 1
                while hi < len(x):
                    hi *= 2
                starts = [i for i in range(0, len(s), hi + 1) if i == 0 or i + hi - 1 < len(s)]
                inside = max(len(x & set(s[i : i + 2 * hi])) / len(x) for i in starts)
                if inside >= L.LEAST - 1e-9:
                    found[name] = inside
        out.append((",".join(sorted(found)), max(found.values(), default=0.0)))
    return out


def check(spark, texts, templates=L.TEMPLATES):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, licenses int")
    got = {r.doc_id: (r.licenses, r.containment) for r in L.scan(docs, templates).collect()}
    want = brute(texts, templates)
    assert {k: v[0] for k, v in got.items()} == {i: x[0] for i, x in enumerate(want)}
    assert np.allclose([got[i][1] for i in range(len(texts))], [x[1] for x in want])
    return got


def test_whole_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = check(spark, texts)
    assert {"MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"} <= {n for x, _ in got.values() for n in x.split(",")}


def test_planted_and_odd_rows(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"q{rng.randrange(500)}" for _ in range(n))
    texts = [None, "", "...", "Released under", "released\nUNDER the mit-license", filler(50_000) + " Released under the MIT License. " + filler(20)]
    for t in L.TEMPLATES.values():
        w = t.split()
        for k in range(12):
            x = list(w)
            if k % 3 == 1:
                x[rng.randrange(len(x))] = "changed"
            if k % 3 == 2:
                x.insert(rng.randrange(len(x)), "added")
            texts.append(f"{filler(rng.randrange(40))} {' '.join(x)} {filler(rng.randrange(40))}")
    got = check(spark, texts)
    for i, name in enumerate(L.TEMPLATES):
        assert name in got[6 + 12 * i][0].split(",")
    assert check(spark, ["a b c d e"], {"x": None, "y": "", "z": "a b"})[0] == ("", 0.0)
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert L.scan(spark.createDataFrame([(None, "x"), (None, "x")], "doc_id long, text string"), {}).count() == 2


def test_bands_keep_the_promise():
    for c in L.classes(L.TEMPLATES):
        for s in map(len, c.sets):
            need = math.ceil(L.LEAST * s - 1e-9)
            assert (1 - need / (c.window + s - need)) ** len(c.bands) <= L.MISS * 1.01
        assert c.step <= c.window - max(map(len, c.sets)) + 1
