import json
import pathlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from plumbline.llm import packing as P
from plumbline.llm.store import Scratch


def laws(rows, texts):
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in enumerate(texts):
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, s in enumerate(starts):
            own = ids[s : s + (1024 if k else first)]
            want.append((i, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins), bound([r.length for r in rows])


def bound(lengths, c=1024):
    """A lower bound on bins (Martello and Toth's second)."""
    best = -(-sum(lengths) // c)
    for k in {n for n in lengths if n <= c // 2}:
        alone = sum(n > c - k for n in lengths)
        half = [n for n in lengths if c // 2 < n <= c - k]
        best = max(best, alone + len(half) + max(0, -(-(sum(n for n in lengths if k <= n <= c // 2) - len(half) * c + sum(half)) // c)))
    return best


def test_whole_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bins, least = laws(P.pack(docs, Scratch(spark)).collect(), texts)
    print(bins, least)
    assert bins <= 1.005 * least + 1


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "SPLIT_ROWS", 5)
    rng = random.Random(1)
    texts = [None, "", " ", "<|endoftext|> x", "日本語 текст <|endof", "word " * 5000, "a" * 3000, "same"] + ["same"] * 40 + ["w " * rng.randrange(300) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    laws(P.pack(docs, Scratch(spark)).collect(), texts)
    assert P.pack(docs.limit(0), Scratch(spark)).count() == 0
    again = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    rows = P.pack(again, Scratch(spark), with_ids=True).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3 and all(r.ids[-1] == 2 for r in rows)


def test_ids_are_those_of_whole_texts(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens, rng = Tokenizer.from_file(path), random.Random(8)
    monkeypatch.setattr(P, "WORDS", 500)
    e = P.Encoder(path)
    letters = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]]
    texts = ["".join(rng.choices(letters, k=n % 60)) if n % 3 else "".join(rng.choices(" \n\t'sabtv1.é", k=n % 80)) for n in range(3000)]
    texts += ["".join(rng.choices([*letters, "日", "😀", "½", "ⅷ", "ʰ", "\u0301"], k=50)) for _ in range(300)]
    texts += ["", "x" * 70_000, "word and " * 150_000, "<|endoftext|> a", "a b" * 400_000 + "é"]
    texts += [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    for t in texts:
        assert e.ids(t).tolist() == tokens.encode(t, add_special_tokens=False).ids, t[:80]
    assert len(e) <= 501


def best_fill(lengths, first, capacity):
    sums = {first}
    rest = list(lengths)
    rest.remove(first)
    for n in rest:
        sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


def test_fullest_and_plan():
    rng = random.Random(6)
    for _ in range(200):
        lengths = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 14))]
        counts = [0] * 41
        for n in lengths:
            counts[n] += 1
        used = P.fullest(counts, max(lengths), 40)
        assert sum(n * k for n, k in used.items()) == best_fill(lengths, max(lengths), 40)
        assert all(k <= counts[n] for n, k in used.items())
    total = {}
    counts = {n: rng.randrange(1, 500) for n in range(1, 1025) if rng.random() < 0.7}
    for bins, used in P.plan(counts):
        assert sum(n * k for n, k in used.items()) <= 1024
        for n, k in used.items():
            total[n] = total.get(n, 0) + bins * k
    assert total == counts
    assert sum(b for b, _ in P.plan(counts)) <= 1.006 * bound([n for n, c in counts.items() for _ in range(c)])


def test_other_tokenizer_files_are_followed(tmp_path):
    """Files that change texts first, or part them in another way, give the ids that the library gives."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    given = json.loads(pathlib.Path(path).read_text())
    texts = ["Hello World, it's 12 o'clock", " leading and  double spaces\n", "", "é Ünï 日本", "A" * 50, "mixed CASE Words 3.14"]
    changes = {
        "as it is": {}, "lower case": {"normalizer": {"type": "Lowercase"}}, "prefix": {"pre_tokenizer": given["pre_tokenizer"] | {"add_prefix_space": True}}, "no pattern": {"pre_tokenizer": given["pre_tokenizer"] | {"use_regex": False}},
        "cut": {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
    }
    for name, change in changes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(given | change))
        mine, theirs = P.Encoder(str(tmp_path / f"{name}.json")), Tokenizer.from_file(str(tmp_path / f"{name}.json"))
        assert mine.parted == (name == "as it is")
        for t in texts:
            assert mine.ids(t).tolist() == theirs.encode(t, add_special_tokens=False).ids, (name, t)
