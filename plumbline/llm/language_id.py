"""Language of a text by a byte convolutional network that is trained and run in numpy.

Bytes are embedded; filters of several widths slide over a window of fixed length, their responses are rectified, the maximum over
the window is pooled, and a softmax layer gives probabilities. A text is cut into windows over its whole length; its probabilities
are the mean over windows, weighted by the bytes they hold.

When trained, the filters and the embedding are multiplied out: a filter's response is a sum of table rows picked by two-byte codes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import short_batches
from .textops import LOWER, as_bytes, slices

#: Bytes of a window.
LENGTH = 256
#: Widths of filters, filters of each, and numbers that stand for a byte.
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 10, 8
#: Documents of each language, windows of each document and languages (the most frequent) that training takes at most, and runs over them.
PER_LANGUAGE, WINDOWS, LANGUAGES, EPOCHS = 1200, 3, 500, 6
_BATCH = 512
#: Letters, and numerals beyond the decimal digits, which has_letter tells apart.
_LETTER = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character is of the Unicode category L."""
    return any(c.isalpha() for m in _LETTER.finditer(text) for c in m.group())


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, the last one filled with zeros; one of zeros for an empty text."""
    text = text.translate(LOWER)
    out = np.zeros(max(1, -(-len(text) // LENGTH)) * LENGTH, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(-1, LENGTH)


class Network:
    """Weights of the network: embedding e, filters w (position, embedded, filter) and their bias b, classes v and c."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, n, most = labels, FILTERS * len(WIDTHS), max(WIDTHS)
        # filters of every width in one block; a narrow one has zeros at its last positions
        self.mask = np.zeros((most, 1, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        f = np.float32
        self.p = {
            "e": rng.normal(0, 0.5, (256, EMBEDDED)).astype(f),
            "w": (rng.normal(0, 0.3, (most, EMBEDDED, n)) * self.mask).astype(f),
            "b": np.zeros(n, f),
            "v": rng.normal(0, 0.2, (n, len(labels))).astype(f),
            "c": np.zeros(len(labels), f),
        }

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to the first and the second two bytes of four, for all pairs of bytes."""
        t = np.einsum("be,jef->jbf", self.p["e"], self.p["w"]).astype(np.float32)
        pair = lambda a, b: (t[a][:, None] + t[b][None]).reshape(65536, -1)
        return pair(0, 1) + self.p["b"], pair(2, 3)

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = np.zeros((len(x), len(self.labels)), np.float32)
        for k in range(0, len(x), _BATCH):
            part = np.pad(x[k : k + _BATCH], ((0, 0), (0, max(WIDTHS) - 1))).astype(np.int32)
            code = (part[:, :-1] << 8) | part[:, 1:]
            r = tables[0][code[:, :LENGTH]]
            r += tables[1][code[:, 2 : LENGTH + 2]]
            z = np.maximum(r.max(axis=1), 0) @ self.p["v"] + self.p["c"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[k : k + len(z)] = z / z.sum(axis=1, keepdims=True)
        return out

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the cross entropy for windows x with classes y."""
        p, most, n = self.p, max(WIDTHS), len(x)
        part = np.pad(x, ((0, 0), (0, most - 1))).astype(np.int64)
        emb = p["e"][part]
        r = p["b"] + sum(emb[:, j : j + LENGTH] @ p["w"][j] for j in range(most))
        at = r.argmax(axis=1)
        top = np.take_along_axis(r, at[:, None], axis=1)[:, 0]
        h = np.maximum(top, 0)
        z = h @ p["v"] + p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"v": h.T @ d, "c": d.sum(0), "w": np.zeros_like(p["w"]), "e": np.zeros_like(p["e"])}
        back = (d @ p["v"].T) * (top > 0)
        g["b"] = back.sum(0)
        rows = np.arange(n)[:, None]
        for j in range(most):
            # only the pooled place of each filter has a gradient
            seen = emb[rows, at + j]
            g["w"][j] = np.einsum("nf,nfe->ef", back, seen)
            np.add.at(g["e"], part[rows, at + j], back[:, :, None] * p["w"][j].T[None])
        g["w"] *= self.mask
        return g


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over shuffled batches of windows x (uint8) with class numbers y."""
    net, rng = Network(labels, seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 128):
            part = order[k : k + 128]
            t += 1
            for name, g in net.step(x[part], y[part]).items():
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.001 * (g * g - v[name])
                net.p[name] -= (0.004 * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some windows spread over each whole text that has letters, end to end."""
    for batch in batches:
        kept, out = [], []
        for i, text in enumerate(as_bytes(batch.column(2))):
            if has_letter(text.decode(errors="ignore")):
                own = windows(text)
                kept.append(i)
                out.append(b"".join(own[k].tobytes() for k in sorted({int(i * (len(own) - 1) / max(1, WINDOWS - 1)) for i in range(WINDOWS)})))
        at = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.binary())], ["lang", "h", "windows"])


def fit(docs: DataFrame) -> Network | None:
    """Trains on rows of docs (doc_id, text, lang) that are not held out and have a language: PER_LANGUAGE texts at most of each of the
    LANGUAGES languages of most distinct texts, those of least hash, WINDOWS windows of each. None without such rows. Rows with a null doc_id
    count as not held out; rows that repeat a text and its language count once, so the bound holds whatever the rows hold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False))).select("lang", F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    # distinct texts, as the sample takes each of them once: by rows a language of few texts that come often would be left with none
    counts = {r.lang: r.n for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    # a threshold on the hash leaves about as many as are asked for; ranks cut the rest
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, PER_LANGUAGE / n))])
    near = rows.where(F.col("h") / F.lit(2.0**64) + 0.5 < share[F.col("lang")])
    with short_batches(docs.sparkSession):
        cut = near.mapInArrow(_sample, "lang string, h bigint, windows binary").dropDuplicates(["lang", "h"])
    ranked = cut.withColumn("i", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("i") <= PER_LANGUAGE)
    got = ranked.select("lang", "h", "windows").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    labels = sorted(set(got["lang"].to_pylist()))
    if not labels:
        return None
    number, texts = {lang: k for k, lang in enumerate(labels)}, got["windows"].to_pylist()
    x = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, LENGTH)
    return train(x, np.repeat([number[a] for a in got["lang"].to_pylist()], [len(w) // LENGTH for w in texts]), labels)


def _predicted(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in slices(texts):
                langs, scores = ["und"] * (b - a), [0.0] * (b - a)
                known = [i for i in range(a, b) if net and has_letter(texts[i].decode(errors="ignore"))]
                if known:
                    own = [windows(texts[i]) for i in known]
                    p = net.probabilities(np.concatenate(own), tables)
                    weight = np.concatenate([np.minimum(LENGTH, len(texts[i]) - LENGTH * np.arange(len(o))) for i, o in zip(known, own, strict=True)])
                    first = np.concatenate(([0], np.cumsum([len(o) for o in own])[:-1]))
                    mean = np.add.reduceat(p * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
                    for i, q in zip(known, mean, strict=True):
                        langs[i - a], scores[i - a] = net.labels[int(q.argmax())], min(1.0, float(q.max()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the probability of lang_pred) for each row of docs (doc_id, text).

    und with score 0 for a null text, a text without letters, and everything if there is no network. held_out is false for a null
    doc_id. Repeated and null doc_ids each get their row; an empty table gives no row. No other column is read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with short_batches(docs.sparkSession):
        rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(_predicted(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """fit() and predict() on one table."""
    return predict(docs, fit(docs))
