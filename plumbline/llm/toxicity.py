"""Toxic documents by a classifier chain.

Categories are predicted one after another by logistic models over the words of a document and the probabilities of the categories
before. The categories are what the labels tell: poor (quality 0), then toxic. Later models are trained on out-of-fold probabilities,
each from a model and a vocabulary that have not seen the document's fold, so they meet the earlier ones as they will be when applied.

Features are the distinct lower-cased words of a whole text, their beginnings of 4 to 8 characters, and how much it repeats and how
many signs and capitals it holds. Those with evidence for a category make up its vocabulary; there are none against it, so that the length of a text does not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch, parts, short_batches
from .textops import as_bytes

#: Labelled documents that training takes at most, of those with and those without the label toxic: those of least hash.
TOXIC_ROWS, OTHER_ROWS = 2500, 5000
#: Features of one category and fold at most, least evidence in standard errors, folds, steps of a fit.
FEATURES, EVIDENCE, FOLDS, STEPS = 3000, 3.5, 3, 300
STARTS = (4, 5, 6, 7, 8)
CHAIN = ["poor", "toxic"]
_WORD, _BLANK, _LETTERS, _CAPITALS = (re.compile(p) for p in (r"[^\W_]+", r"\s", r"[^\W\d_]", r"[A-Z]"))


def tokens(text: str) -> set[str]:
    """Distinct lower-cased words, and in angle brackets how a text looks: tenths of words that repeat, of characters that are signs, and of letters that are capital."""
    words = _WORD.findall(text.lower())
    found, letters = set(words), len(_LETTERS.findall(text))
    tenth = lambda part, whole: round(10 * part / max(1, whole))
    signs = len(text) - sum(map(len, words)) - len(_BLANK.findall(text))
    return found | {f"<again{tenth(len(words) - len(found), len(words))}>", f"<signs{tenth(signs, len(text))}>", f"<capitals{tenth(len(_CAPITALS.findall(text)), letters)}>"}


def features(found: set[str]) -> set[str]:
    """Tokens, and the beginnings of words marked with *."""
    return found | {w[:n] + "*" for w in found if w[0] != "<" for n in STARTS if len(w) > n}


class Logistic:
    """A linear model with a bias, fitted by Adam on the whole sample, with a square penalty; classes count alike up to the fourth root."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float = 2e-5) -> Logistic:
        w, b, n = np.zeros(width), 0.0, len(y)
        if not n or y.min() == y.max():
            return cls(w, -12.0 if not n or not y.max() else 12.0)
        each = np.where(y == 1, ((n - y.sum()) / y.sum()) ** 0.25, 1.0) / n
        m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
        for t in range(1, STEPS + 1):
            z = np.bincount(rows, values * w[cols], n) + b
            d = (1 / (1 + np.exp(-z)) - y) * each
            g = np.bincount(cols, values * d[rows], width) + penalty * w
            gb = d.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
        return cls(w, b)

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


class Chain:
    """vocabulary: feature to column; models: one per category, whose columns after the vocabulary are the earlier probabilities."""

    def __init__(self, vocabulary: dict[str, int], names: list[str], models: list[Logistic]):
        self.vocabulary, self.names, self.models = vocabulary, names, models

    @classmethod
    def fit(cls, vocabulary: dict[str, int], found: list[list[int]], y: dict[str, np.ndarray], fold: np.ndarray, allowed: dict[tuple[str, int], np.ndarray] | None = None) -> Chain:
        """found: columns of each document; y: 0/1 for each category (NaN where it is not known), in the order of the chain; fold: of
        each document; allowed: the columns that a category's model may read, by category and the fold it does not see (-1: none)."""
        names, n, width = list(y), len(found), len(vocabulary)
        cols = np.array([c for x in found for c in sorted(x)], np.int64)
        rows = np.repeat(np.arange(n), [len(x) for x in found])
        values, models = np.ones(len(cols)), []

        def part(name: str, k: int, out: int) -> Logistic:
            seen = (fold != out) & ~np.isnan(y[name])
            used = seen[rows]
            if allowed is not None:
                used &= np.concatenate((allowed[name, out], np.ones(k, bool)))[cols]
            number = np.cumsum(seen) - 1
            return Logistic.fit(number[rows[used]], cols[used], values[used], y[name][seen], width + k)

        for k, name in enumerate(names):
            models.append(part(name, k, -1))
            if k + 1 == len(names):
                break
            unseen = np.zeros(n)
            for f in range(FOLDS):
                model = part(name, k, f)
                unseen[fold == f] = model.probability(np.bincount(rows, values * model.weights[cols], n))[fold == f]
            rows, cols, values = np.concatenate((rows, np.arange(n))), np.concatenate((cols, np.full(n, width + k))), np.concatenate((values, unseen))
        return cls(vocabulary, names, models)

    def predict(self, docs: list[set[str]]) -> np.ndarray:
        """Probabilities: a row for each document, a column for each category."""
        out, width = np.zeros((len(docs), len(self.models))), len(self.vocabulary)
        found = [columns(self.vocabulary, d) for d in docs]
        cols = np.array([c for x in found for c in sorted(x)], np.int64)
        rows = np.repeat(np.arange(len(docs)), [len(x) for x in found])
        for k, model in enumerate(self.models):
            z = np.bincount(rows, model.weights[cols], len(docs)) + out[:, :k] @ model.weights[width:]
            out[:, k] = model.probability(z)
        return out


def columns(vocabulary: dict[str, int], found: set[str]) -> list[int]:
    return [vocabulary[f] for f in found if f in vocabulary]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each feature of each document."""
    for batch in batches:
        for fold, poor, toxic, words in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            f = sorted(features(set(words.split(" "))))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), *(pa.array([x] * len(f), pa.int32()) for x in (fold, poor, toxic))], ["feature", "fold", "poor", "toxic"])


def select(sample: DataFrame) -> dict[tuple[str, int], list[str]]:
    """Features that speak for a category, by category and the fold left out (-1: none): in three of its documents or more, with a log
    of the ratio of smoothed shares of EVIDENCE standard errors or more; the FEATURES of most evidence."""
    tasks = [(name, out) for name in CHAIN for out in range(-1, FOLDS)]
    sums = []
    for k, (name, out) in enumerate(tasks):
        seen = F.col(name).isNotNull() & (F.col("fold") != out)
        sums += [F.coalesce(F.sum(F.when(seen, F.col(name))), F.lit(0)).alias(f"b{k}"), F.count_if(seen).alias(f"c{k}")]
    size = sample.agg(*sums).first()
    counts = sample.select("fold", *CHAIN, "words").mapInArrow(_counted, "feature string, fold int, poor int, toxic int").groupBy("feature").agg(*sums)
    each = []
    for k in range(len(tasks)):
        n1, n = size[f"b{k}"], size[f"c{k}"]
        a, b = F.col(f"c{k}") - F.col(f"b{k}") + 0.5, F.col(f"b{k}") + 0.5
        z = (F.log(b / (n1 + 1)) - F.log(a / (n - n1 + 1))) / F.sqrt(1 / a + 1 / b)
        each.append(F.struct(F.lit(k).alias("task"), F.when(F.col(f"b{k}") >= 3, z).alias("z")))
    strong = counts.select("feature", F.inline(F.array(*each))).where(F.col("z") >= EVIDENCE)
    got = strong.withColumn("i", F.row_number().over(W.partitionBy("task").orderBy(F.desc("z"), "feature"))).where(F.col("i") <= FEATURES).select("task", "i", "feature").collect()
    out: dict[tuple[str, int], list[str]] = {t: [] for t in tasks}
    for r in sorted(got):
        out[tasks[r.task]].append(r.feature)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its tokens, joined by spaces."""
    for batch in batches:
        words = [" ".join(sorted(tokens(t.decode(errors="ignore")))) for t in as_bytes(batch.column(3))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(words, pa.string())], ["h", *CHAIN, "words"])


def _rows(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(columns(vocabulary, features(set(w.split(" "))))) for w in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(found, pa.list_(pa.int32()))], ["h", "fold", *CHAIN, "found"])

    return run


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Chain | None:
    """Trains on labelled documents: docs doc_id, text; labels doc_id, toxic 0/1 and, where there is such a column, quality 0/1.

    Rows without a doc_id or toxic are left out; a null quality leaves a document out of the first category's model only. At most
    TOXIC_ROWS and OTHER_ROWS distinct texts are taken, whatever repeats: labels by a hash of doc_id, then texts by rank of their hash.
    None without any.
    """
    poor = 1 - F.col("quality").cast("int") if "quality" in labels.columns else F.lit(None).cast("int")
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.when(poor.isin(0, 1), poor).alias("poor"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("poor").alias("poor"), F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = lambda k, most: -(-most * 1_000_000 // max(1, counts.get(k, 0)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, F.lit(share(1, TOXIC_ROWS))).otherwise(F.lit(share(0, OTHER_ROWS))))
    # distinct ids, about TOXIC_ROWS + OTHER_ROWS of them, so they can be sent everywhere
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("text").alias("h"), *CHAIN, "text")
    order = W.partitionBy("toxic").orderBy("h", F.col("poor").asc_nulls_last())
    with short_batches(docs.sparkSession):
        words = own.mapInArrow(_texts, "h bigint, poor int, toxic int, words string").dropDuplicates(["h", *CHAIN])
        ranked = words.withColumn("i", F.row_number().over(order)).where(F.col("i") <= F.when(F.col("toxic") == 1, TOXIC_ROWS).otherwise(OTHER_ROWS))
        fold = F.pmod(F.xxhash64(F.lit("fold"), "h"), F.lit(FOLDS)).cast("int")
        sample = scratch.write(ranked.select("h", fold.alias("fold"), *CHAIN, "words").repartition(parts(docs.sparkSession)), "labelled")
        by_task = select(sample)
        vocabulary = {f: k for k, f in enumerate(sorted({f for own in by_task.values() for f in own}))}
        got = sample.mapInArrow(_rows(vocabulary), "h bigint, fold int, poor int, toxic int, found array<int>").orderBy("h", *CHAIN).toArrow()
    scratch.drop("labelled")
    if not got.num_rows:
        return None
    allowed = {task: np.isin(np.arange(len(vocabulary)), [vocabulary[f] for f in own]) for task, own in by_task.items()}
    y = {name: got[name].to_pandas().to_numpy(float) for name in CHAIN}
    return Chain.fit(vocabulary, got["found"].to_pylist(), y, got["fold"].to_numpy(), allowed)


def _scored(chain: Chain | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a in range(0, len(texts), 100):
                part = [features(tokens(t.decode(errors="ignore"))) for t in texts[a : a + 100]]
                p = chain.predict(part) if chain else np.zeros((len(part), len(CHAIN)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), *(pa.array(p[:, k]) for k in range(len(CHAIN)))], ["doc_id", *(f"p_{c}" for c in CHAIN)])

    return run


def score(docs: DataFrame, chain: Chain | None, least: float = 0.5) -> DataFrame:
    """doc_id, a probability p_... for each category of the chain, and toxic (the last one is at least least) for each row of docs (doc_id, text).

    Whole texts are read. Null texts have no words, and so what the bias gives; without a chain all probabilities are 0. Repeated
    and null doc_ids each get their row, judged by its own text; an empty table gives no row. No other column is read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with short_batches(docs.sparkSession):
        got = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scored(chain), f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in CHAIN))
    return got.withColumn("toxic", F.col("p_toxic") >= least)


def _passed(chain: Chain, place: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(place))
            for a in range(0, len(texts), 100):
                p = chain.predict([features(tokens(t.decode(errors="ignore"))) for t in texts[a : a + 100]])
                yield batch.slice(a, min(100, len(texts) - a)).filter(pa.array(p[:, -1] < least))

    return run


def without_toxic(docs: DataFrame, chain: Chain | None, least: float = 0.5) -> DataFrame:
    """docs without the rows that score() calls toxic; rows and columns are else as they are."""
    if chain is None:
        return docs
    with short_batches(docs.sparkSession):
        return docs.mapInArrow(_passed(chain, docs.columns.index("text"), least), docs.schema)
