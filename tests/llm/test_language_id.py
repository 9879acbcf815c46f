import zlib

import numpy as np

from plumbline.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = L.identify(docs).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    tried = [r for r in got if r.held_out and r.lang_pred != "und"]
    right = sum(r.lang_pred == lang[r.doc_id] for r in tried) / len(tried)
    print("held-out accuracy", right, "of", len(tried))
    assert right > 0.97


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog of the house " * 9, "en", 1), (2, "der hund und die katze von dem haus " * 9, "de", 2), (3, None, "en", 3), (4, "123 !?", "de", 4), (5, "", None, 5), (None, "the house of the cat", None, 6), (5, "das haus und die katze", None, 7), (8, "die " * 200_000, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in L.identify(docs).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= got and len(got) == 8
    assert L.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(docs.where("doc_id = 3")).collect()} == {"und"}


def test_sample_is_bounded_and_letters_are_of_category_l(spark, monkeypatch):
    """Null and repeated ids don't lift the bound; numerals such as fractions are no letters."""
    monkeypatch.setattr(L, "PER_LANGUAGE", 100)
    seen = []
    monkeypatch.setattr(L, "train", lambda x, y, labels: seen.append((len(x), sorted(np.bincount(y).tolist()), labels)))
    ids = spark.range(20_000).selectExpr("cast(null as bigint) as doc_id", "concat('text ', id) as text", "if(id % 4 = 0, 'de', 'en') as lang")
    L.fit(ids)
    same = spark.range(20_000).selectExpr("7L as doc_id", "if(id % 2 = 0, 'one text', concat('text ', id)) as text", "'en' as lang")
    L.fit(same)
    for n, per, labels in seen:
        assert n <= 100 * len(labels) and min(per) > 50, per
    assert L.has_letter("½ a") and L.has_letter("ª") and L.has_letter("日")
    odd = spark.createDataFrame([(1, "½ ² ③ 4", "en"), (2, "Ⅷ", "en"), (3, "a house", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in L.predict(odd, L.Network(["en"])).where("lang_pred = 'und'").collect()} == {1, 2}


def test_a_language_of_few_texts_that_come_often_stays(spark, monkeypatch):
    """The sample is drawn from distinct texts, whatever their rows."""
    monkeypatch.setattr(L, "PER_LANGUAGE", 100)
    seen = []
    monkeypatch.setattr(L, "train", lambda x, y, labels: seen.append(dict(zip(labels, np.bincount(y).tolist(), strict=True))))
    often = spark.range(30_000).selectExpr("id as doc_id", "concat('text ', id % 120) as text", "'en' as lang")
    rare = spark.range(100_000, 100_300).selectExpr("id as doc_id", "concat('wort ', id) as text", "'de' as lang")
    L.fit(often.union(rare))
    assert min(seen[0].values()) > 60, seen


def test_gradients_and_tables():
    rng = np.random.default_rng(1)
    net = L.Network(["a", "b", "c"])
    x, y = rng.integers(0, 256, (6, L.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        return -np.log(net.probabilities(x, net.tables())[np.arange(6), y]).mean()

    g = net.step(x, y)
    for name, k in (("v", 5), ("c", 1), ("b", 4), ("w", 40), ("e", int(x[0, 0]) * L.EMBEDDED)):
        flat, near = net.p[name].reshape(-1), []
        for i in np.argsort(-abs(g[name].reshape(-1)))[:3]:
            held = flat[i]
            flat[i] = held + 1e-2
            up = loss()
            flat[i] = held - 1e-2
            near.append((up - loss()) / 2e-2 - g[name].reshape(-1)[i])
            flat[i] = held
        assert max(map(abs, near)) < 5e-3, name


def test_windows_cover_the_text():
    t = bytes(range(97, 123)) * 50
    assert L.windows(t).tobytes().rstrip(b"\0") == t
    assert L.windows(b"").shape == (1, L.LENGTH)
