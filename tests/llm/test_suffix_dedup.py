import hashlib
import random

import numpy as np

from plumbline.llm import suffix_dedup as S
from plumbline.llm.store import Scratch


def brute(texts):
    """[n_bytes, n_removed, n_spans, kept_sha256] of each text, over a dictionary of all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, t in enumerate(raw):
        for a in range(len(t) - S.LENGTH + 1):
            seen[t[a : a + S.LENGTH]] = (a, i) if t[a : a + S.LENGTH] not in seen else None
    out = []
    for t in raw:
        mark = np.zeros(len(t) + 2, bool)
        for a in range(len(t) - S.LENGTH + 1):
            if seen[t[a : a + S.LENGTH]] is None:
                mark[a + 1 : a + 1 + S.LENGTH] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~mark[1:-1]]) if t else b""
        out.append((len(t), int(mark.sum()), int((mark[1:] & ~mark[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in S.digests(docs, Scratch(spark)).collect()}
    assert got == dict(enumerate(brute(texts)))


def words(rng, n):
    return " ".join("".join(rng.choice("aàbcdeioußst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_small_corpus(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    check(spark, [r.text for r in rows])


def test_planted(spark):
    rng = random.Random(3)
    long = words(rng, 300)
    raw = [None, "", "x", long, long, long[:150], words(rng, 80) + long[77:410] + words(rng, 50), long[300:900], "ab" * 400, "a" * 1000, "a" * 199, "a" * 200, words(rng, 2000), "é" * 150, "é" * 99]
    base = words(rng, 120)
    for _ in range(40):
        c = list(base)
        for _ in range(rng.randrange(1, 4)):
            c[rng.randrange(len(c))] = rng.choice("xyz")
        raw.append("".join(c))
    check(spark, raw)


def test_wide_anchors_and_long_texts(spark, monkeypatch):
    """Chunks, pieces and parts at sizes that small texts reach. The workers get the patched values only through fragments made here, so the plain functions are tried too."""
    rng = random.Random(9)
    base = words(rng, 70)
    texts = [(words(rng, 30) + base[:-k] + words(rng, 25)).encode() for k in range(1, 40)]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([np.arange(len(t) - S.LENGTH + 1) + sum(map(len, texts[:i])) for i, t in enumerate(texts)])
    dup, head = S.repeated(buf, at, np.zeros(len(at), np.int64))
    seen = {}
    for p in at:
        seen.setdefault(buf[p : p + S.LENGTH].tobytes(), []).append(p)
    assert dup.tolist() == [len(seen[buf[p : p + S.LENGTH].tobytes()]) > 1 for p in at]
    assert head.sum() == len(seen)
    monkeypatch.setattr(S, "CHUNK", 4)
    docs = [t.decode(errors="ignore") for t in texts]
    check(spark, docs)


def test_hash_collisions_are_caught():
    """With hashes that are all equal every comparison is wrong; the byte comparison puts it right."""

    class Blind(S.PrefixHash):
        def __init__(self, buf, seed):
            super().__init__(buf, seed)
            self.sums = np.zeros_like(self.sums)

    buf = np.frombuffer(bytes(range(256)) * 2 + bytes(300), np.uint8)
    at = np.array([0, 1, 256, 257, 520, 530])
    dup, _ = S.repeated(buf, at, np.zeros(6, np.int64), Blind(buf, 31))
    assert dup.tolist() == [True, True, True, True, True, True]
    dup, _ = S.repeated(buf, at[[0, 1, 4]], np.zeros(3, np.int64), Blind(buf, 31))
    assert not dup.any()


def test_texts_without_repeats(spark):
    rng = random.Random(4)
    one, two, passage = words(rng, 60), words(rng, 60), words(rng, 80)
    rows = [(1, one + passage, 5, "a"), (2, passage + two, 6, "b"), (3, None, None, "c"), (4, "short", 5, "d"), (None, "short", 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, rest string")
    got = {r.rest: r for r in S.without_repeats(docs, Scratch(spark)).collect()}
    assert (got["a"].text, got["b"].text, got["c"].text, got["d"].text, got["e"].text) == (one, two, None, "short", "short")
    assert got["a"].n_chars == len(one) and got["c"].n_chars is None
    assert S.without_repeats(docs.limit(0), Scratch(spark)).count() == 0
    assert S.digests(docs.limit(0), Scratch(spark)).count() == 0
