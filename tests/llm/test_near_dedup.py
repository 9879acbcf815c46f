import random
import re

from plumbline.llm.components import components
from plumbline.llm.near_dedup import chunks_for, keep_first, near_duplicates
from plumbline.llm.store import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t, n):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    """rows: (doc_id, text) -> {doc_id: (size, component)}."""
    sets = {d: shingles(t, n) for d, t in rows}
    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        shared = {}
        for x in s:
            for e in index[x]:
                if e < d:
                    shared[e] = shared.get(e, 0) + 1
        for e, i in shared.items():
            if 100 * i >= percent * (len(s) + len(sets[e]) - i):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for n, percent in ((3, 85), (5, 80)):
        want = brute(rows, n, percent)
        assert len({c for _, c in want.values()}) < len(want)
        assert got(near_duplicates(docs, Scratch(spark), n, percent)) == want


def test_strays_are_linked(spark):
    """A ring in which the least document is linked with its neighbours only: the others are strays of its group."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        for _ in range(6):
            words[rng.randrange(400)] = f"x{rng.random()}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(docs, Scratch(spark), 3, 85)) == brute(rows, 3, 85)


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t\n", 9), (4, "One two", 9), (5, "one\ttwo", 9), (6, "one two three four", 9), (6, "one two three four", 9), (7, "ONE two three four", 9), (None, "one two three four", 9), (8, "z" * 300_000, 9), (9, "z" * 300_000, 9), (10, "two one", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    out = near_duplicates(docs, Scratch(spark), 3, 85)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in out.collect()) == [
        (False, 1, 0, 1, True), (False, 2, 0, 2, True), (False, 3, 0, 3, True), (False, 4, 1, 4, True), (False, 5, 1, 4, False), (False, 6, 2, 6, True), (False, 6, 2, 6, True),
        (False, 7, 2, 6, False), (False, 8, 1, 8, True), (False, 9, 1, 8, False), (False, 10, 1, 10, True), (True, 0, 2, None, True),
    ]
    assert near_duplicates(docs.limit(0), Scratch(spark), 3, 85).count() == 0
    assert sorted(x.doc_id or 0 for x in keep_first(docs, Scratch(spark), 3, 85).collect()) == [0, 1, 2, 3, 4, 6, 8, 10]


def test_repeated_ids_of_other_texts(spark):
    """Rows are told apart by their texts, not by their doc_ids: all that brute force over rows links is linked, and no lone text goes."""
    rng = random.Random(9)
    base = [" ".join(f"{n}{i}" for i in range(60)) for n in "abcdef"]
    rows = [(5, base[0] + " x"), (5, base[1]), (9, base[1]), (7, base[1] + " more"), (3, base[2]), (5, base[2] + " near"), (5, base[3]), (None, base[3]), (8, base[0])]
    rows += [(rng.choice([1, 2, 5, 40]), base[rng.randrange(6)] + f" {rng.randrange(4)} tail" * rng.randrange(2)) for _ in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [i for i, (d, _) in enumerate(rows) if d is not None]
    root = {i: c for i, (_, c) in brute([(i, rows[i][1]) for i in known], 3, 85).items()}
    least = {}
    for i in known:
        least[root[i]] = min(least.get(root[i], 99), rows[i][0])
    want = sorted((rows[i][0], least[root[i]]) for i in known)
    groups = [{rows[i] for i in known if root[i] == c} for c in set(root.values())]
    for parts in ("8", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = near_duplicates(docs.repartition(int(parts)), Scratch(spark), 3, 85).where("doc_id is not null")
        assert sorted((r.doc_id, r.component_id) for r in got.collect()) == want
        kept = [(r.doc_id, r.text) for r in keep_first(docs.repartition(int(parts)), Scratch(spark), 3, 85).collect()]
        assert (None, base[3]) in kept and len(kept) == len(groups) + 1
        for g in groups:
            (one,) = [r for r in kept if r in g]
            assert one[0] == min(d for d, _ in g)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    lone = spark.createDataFrame([(3, base[0]), (5, base[0] + " x"), (5, base[4])], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in keep_first(lone, Scratch(spark), 3, 85).collect()) == [(3, base[0]), (5, base[4])]


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 102), (102, 101), (200, 201)]
    out = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
    assert dict(map(tuple, out.collect())) == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_chunks():
    assert chunks_for(85) == 8
    assert chunks_for(80) > 8
