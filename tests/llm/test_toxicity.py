import random

import numpy as np

from plumbline.llm import toxicity as T
from plumbline.llm.store import Scratch


def test_held_out(spark):
    """Trains on labels of even ids, tries the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = T.fit(docs, labels.where("doc_id % 2 = 0"), Scratch(spark))
    got = {r.doc_id: r for r in T.score(docs, chain).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    toxic = [got[r.doc_id].toxic for r in rest if r.toxic]
    clean = [got[r.doc_id].toxic for r in rest if not r.toxic]
    print("recall", np.mean(toxic), "false alarms", np.mean(clean))
    assert np.mean(toxic) > 0.88 and np.mean(clean) < 0.01
    assert T.without_toxic(docs, chain).count() == sum(not r.toxic for r in got.values())
    # the chain against its last model alone, on the same labels
    alone = T.fit(docs, labels.where("doc_id % 2 = 0").select("doc_id", "toxic"), Scratch(spark))
    single = {r.doc_id: r.toxic for r in T.score(docs, alone).collect()}
    print("last model alone: recall", np.mean([single[r.doc_id] for r in rest if r.toxic]), "false alarms", np.mean([single[r.doc_id] for r in rest if not r.toxic]))
    poor = {r.doc_id: r.quality == 0 for r in rest}
    right = np.mean([(got[i].p_poor > 0.5) == p for i, p in poor.items()])
    print("poor told right", right, "share of poor", np.mean(list(poor.values())))


def test_odd_rows(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=40)) + (" you idiot" if i % 5 == 0 else ""), 1) for i in range(300)]
    rows += [(300, None, 1), (301, "", 1), (None, "x", 1), (5, "idiot", 1), (5, "idiot", 1), (302, "word " * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(250)] + [(None, 1), (3, None), (300, 0), (999, 1)], "doc_id long, toxic int")
    chain = T.fit(docs, labels, Scratch(spark))
    got = {r.doc_id: r.toxic for r in T.score(docs, chain).collect()}
    assert len(T.score(docs, chain).collect()) == len(rows)
    assert all(got[i] == (i % 5 == 0) for i in range(300)) and not got[300] and not got[301] and not got[302]
    assert T.without_toxic(docs, chain).columns == docs.columns
    assert T.score(docs.limit(0), chain).count() == 0
    assert T.fit(docs, labels.limit(0), Scratch(spark)) is None and T.without_toxic(docs, None).count() == len(rows)


def test_sample_is_bounded(spark, monkeypatch):
    """One doc_id with many texts, and many labels of it, stay under the bound."""
    monkeypatch.setattr(T, "TOXIC_ROWS", 50)
    monkeypatch.setattr(T, "OTHER_ROWS", 60)
    seen = []
    monkeypatch.setattr(T.Chain, "fit", classmethod(lambda cls, v, found, y, fold, allowed: seen.append(y["toxic"])))
    docs = spark.range(5000).selectExpr("if(id < 3000, 1L, id) as doc_id", "concat('some words ', id) as text")
    labels = spark.range(5000).selectExpr("if(id < 3000, 1L, id) as doc_id", "cast(id < 3500 as int) as toxic")
    T.fit(docs, labels, Scratch(spark))
    assert (seen[0] == 1).sum() <= 50 and 20 < (seen[0] == 0).sum() <= 60


def test_chain_uses_earlier_categories():
    """The second category is the first one's; its own words say nothing, so the earlier probability has to carry it."""
    rng = np.random.default_rng(3)
    first = rng.random(600) < 0.5
    docs = [{f"a{rng.integers(3)}" if x else f"b{rng.integers(3)}", f"n{rng.integers(20)}"} for x in first]
    vocabulary = {f: k for k, f in enumerate(sorted({f for d in docs for f in d}))}
    chain = T.Chain.fit(vocabulary, [T.columns(vocabulary, d) for d in docs], {"one": first.astype(float), "two": first.astype(float)}, rng.integers(0, T.FOLDS, 600))
    assert chain.models[1].weights[len(chain.vocabulary)] > 0.5
    assert ((chain.predict(docs)[:, 1] > 0.5) == first).all()
