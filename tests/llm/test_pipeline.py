"""Each stage of the pipeline on its own input against brute force, and all of them on odd rows."""

import corpus_pipeline as C
from plumbline.llm import toxicity

from .test_decontaminate import brute as leaks
from .test_near_dedup import brute as groups
from .test_packing import laws
from .test_suffix_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]

    def step(name, df):
        stages[name](spark, df, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def texts(df):
        return sorted((r.doc_id, r.text) for r in df.collect())

    one = step("toxicity", docs)
    chain = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), C.Scratch(spark))
    bad = {r.doc_id for r in toxicity.score(docs, chain).where("toxic").collect()}
    assert one.columns == columns and {d for d, _ in texts(one)} == {d for d, _ in texts(docs)} - bad
    two = step("near_dedup", one)
    want = groups(texts(one), 5, 80)
    assert two.columns == columns and texts(two) == [x for x in texts(one) if want[x[0]][1] == x[0]]
    three = step("suffix_dedup", two)
    before, after = texts(two), texts(three)
    found = repeats([t for _, t in before])
    assert three.columns == columns and [d for d, _ in after] == [d for d, _ in before]
    for (_, t), (_, u), (n, removed, spans, _) in zip(before, after, found, strict=True):
        # characters that a cut would split go as a whole, so a span costs a few bytes more at most
        assert n - removed - 6 * spans <= len(u.encode()) <= n - removed
        assert removed or u == t
    assert all(r.n_chars == len(r.text) for r in three.collect())
    four = step("decontamination", three)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {x[0] for x in leaks(after, items) if x[5]}
    assert four.columns == columns and texts(four) == [x for x in after if x[0] not in hit]
    kept = dict(texts(four))
    rows = step("packing", four).collect()
    place = {d: i for i, d in enumerate(sorted(kept))}
    renamed = [r.asDict() | {"doc_id": place[r.doc_id]} for r in rows]
    bins, least = laws([type("R", (), x) for x in renamed], [kept[d] for d in sorted(kept)])
    assert bins <= 1.01 * least + 1


def test_run(spark):
    got = C.run(spark, SF)
    assert got.count() > 100 and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_rows(spark):
    long = "word " * 60_000
    rows = [(1, None, None, "a", None, 0), (2, "", "en", None, 0, 0), (3, "same text of some words here", "en", "a", 28, 0), (3, "same text of some words here", "en", "a", 28, 0), (None, "same text of some words here", None, None, None, 0), (4, long, "en", "a", len(long), 0), (5, "é" * 500, "fr", "a", 500, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        docs = stage(spark, docs, SF)
        docs.count()
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} >= {1, 2, 3, None}
