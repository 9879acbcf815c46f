"""Benchmark passages in documents: one Aho-Corasick automaton over all item windows, run once over each normalised text.

Normalising works on UTF-8 bytes: A-Z are lower-cased and all ASCII bytes but 0-9 and a-z become spaces, runs of which become one.
Words keep their order, so an offset in the normalised text is a word number, and that a range of code points in the original.

Patterns are made and counted by Spark. Those of a benchmark whose windows take at most BLOCK_BYTES are sent to the executors as
one automaton. Those of a larger one are dealt into blocks by a hash, which are sent one at a time: the texts pass once for each
block, and what a pass found is written before the next.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, short_batches
from .textops import NORMAL, as_bytes, slices

WINDOW = 10
#: Bytes of patterns, and of the names of their items, in one automaton.
BLOCK_BYTES = 16_000_000
_built: dict = {}


def normal(text: bytes) -> bytes:
    """Words with one space before, between and after; empty without words."""
    words = text.translate(NORMAL).split()
    return b" " + b" ".join(words) + b" " if words else b""


def windows(text: bytes) -> list[bytes]:
    """Each window of an item, with spaces around; the whole item where it has fewer words, but not none."""
    words = text.translate(NORMAL).split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(max(1, len(words) - WINDOW + 1))] if words else []


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            own = windows(text)
            for a in range(0, len(own), 10_000):
                part = own[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], ["pattern", "item"])


def blocks(items: DataFrame) -> list[DataFrame]:
    """Frames of pattern and item, each of about BLOCK_BYTES: a pattern's items may be in several, so a very common one is parted too."""
    spark = items.sparkSession
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item"), F.col("text").cast("string").alias("text"))
    with short_batches(spark):
        pairs = own.mapInArrow(_windows, "pattern binary, item string").distinct()
    size = pairs.agg(F.sum(F.octet_length("pattern") + F.octet_length("item"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    if n == 1:
        return [pairs]
    pairs = Scratch(spark).write(pairs.withColumn("block", F.pmod(F.xxhash64("pattern", "item"), F.lit(n))), "patterns")
    return [pairs.where(F.col("block") == k).select("pattern", "item") for k in range(n)]


def automaton(patterns: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, ids in patterns:
        # bytes as characters of one byte each
        a.add_word(w.decode("latin-1"), (len(w), tuple(ids)))
    a.make_automaton()
    return a


def scan(text: bytes, a: ahocorasick.Automaton, hits: list[tuple[int, int]], items: set[str]) -> None:
    """Adds the byte ranges of all occurrences in a normalised text, and their items."""
    if text and len(a):
        for end, (length, ids) in a.iter(text.decode("latin-1")):
            hits.append((end - length + 1, end))
            items.update(ids)


def words_hit(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of occurrences, each from a space to a space, as merged ranges of word numbers."""
    if not hits:
        return []
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    out: list[list[int]] = []
    for a, b in sorted(set(hits)):
        first, last = np.searchsorted(spaces, (a, b)).tolist()
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def places(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where ranges of word numbers begin and end in the original text, in code points."""
    if not ranges:
        return []
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    out, byte, point = [], 0, 0
    for x, y in ranges:
        begin, end = int(edges[2 * x]), int(edges[2 * y - 1])
        first = point + int(leads[byte:begin].sum())
        byte, point = end, first + int(leads[begin:end].sum())
        out.append((first, point))
    return out


def _sent(block: DataFrame) -> tuple[str, Broadcast]:
    """A block's patterns on all executors, under a name of their own."""
    of: dict[bytes, list[str]] = {}
    for r in block.collect():
        of.setdefault(bytes(r.pattern), []).append(r.item)
    return uuid.uuid4().hex, block.sparkSession.sparkContext.broadcast(sorted(of.items()))


def _automaton(sent: tuple[str, Broadcast]) -> ahocorasick.Automaton:
    """The block's automaton, built once in a worker; it takes the place of the block's before."""
    name, part = sent
    if name not in _built:
        _built.clear()
        _built[name] = automaton(part.value)
    return _built[name]


_PAIR = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_DIGEST = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, word_ranges array<struct<first: bigint, last: bigint>>, char_ranges array<struct<begin: bigint, end: bigint>>"


def _hits(sent: tuple[str, Broadcast]):
    """Adds to doc_id, text, hits, items what a block's automaton finds; hits are byte ranges in the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(sent)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            hits = [[(x["first"], x["last"]) for x in h] for h in batch.column(2).to_pylist()]
            items = [set(x) for x in batch.column(3).to_pylist()]
            for k, t in enumerate(texts):
                scan(normal(t), a, hits[k], items[k])
            found = [pa.array([[{"first": x, "last": y} for x, y in sorted(set(h))] for h in hits], _PAIR), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["doc_id", "text", "hits", "items"])

    return run


def _digests(sent: tuple[str, Broadcast]):
    """The last block's pass: doc_id, text and, after other passes, hits, items in; the result's rows out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automat = _automaton(sent)
        for batch in batches:
            column = as_bytes(batch.column(1))
            for a, b in slices(column, 1 << 22):
                hits: list[list[tuple[int, int]]] = [[] for _ in range(a, b)]
                items: list[set[str]] = [set() for _ in range(a, b)]
                if batch.num_columns > 2:
                    hits = [[(x["first"], x["last"]) for x in h] for h in batch.column(2).slice(a, b - a).to_pylist()]
                    items = [set(x) for x in batch.column(3).slice(a, b - a).to_pylist()]
                texts = [normal(t) for t in column[a:b]]
                for k, t in enumerate(texts):
                    scan(t, automat, hits[k], items[k])
                ranges = [words_hit(t, h) for t, h in zip(texts, hits, strict=True)]
                names = [sorted(x) for x in items]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([max(0, t.count(b" ") - 1) for t in texts], pa.int64()),
                        pa.array([sum(y - x for x, y in r) for r in ranges], pa.int64()),
                        pa.array([len(x) for x in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                        pa.array([bool(r) for r in ranges]),
                        pa.array(names, pa.list_(pa.string())),
                        pa.array([[{"first": x, "last": y - 1} for x, y in r] for r in ranges], _PAIR),
                        pa.array([[{"begin": x, "end": y} for x, y in places(t, r)] for t, r in zip(column[a:b], ranges, strict=True)], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "word_ranges", "char_ranges"],
                )

    return run


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    docs: doc_id, text. items: item_id, text, a benchmark. Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.
    A window is WINDOW consecutive words of an item, or all of a shorter one.

    Returns doc_id, n_words, n_hit (words inside any occurrence), n_items (items with occurring windows), items_sha256 (of their
    ids, sorted as strings, comma-joined), contaminated (n_hit > 0), items, word_ranges (first and last word number of each
    maximal hit run), char_ranges (the same runs in the text as it is: begin and end in code points, the end not included).
    Null texts have no words. Null or wordless items have no windows; repeated items count once; a null item_id is named None.
    Repeated and null doc_ids each get their row. An empty table gives no row; an empty benchmark hits nothing. Other columns are
    not read.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    *others, last = blocks(items)
    if others:
        scratch, held = Scratch(spark), f"doc_id {kind}, text string, hits array<struct<first: bigint, last: bigint>>, items array<string>"
        found = found.withColumns({"hits": F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)"), "items": F.expr("cast(array() as array<string>)")})
        for k, block in enumerate(others):
            sent = _sent(block)
            with short_batches(spark):
                found = scratch.write(found.mapInArrow(_hits(sent), held), f"pass-{k}")
            sent[1].unpersist()
            if k:
                scratch.drop(f"pass-{k - 1}")
    with short_batches(spark):
        return found.mapInArrow(_digests(_sent(last)), f"doc_id {kind}, {_DIGEST}")


def _clean(sent: tuple[str, Broadcast], place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(sent)
        for batch in batches:
            if batch.num_rows:
                clean = [next(a.iter(normal(t).decode("latin-1")), None) is None if t and len(a) else True for t in as_bytes(batch.column(place))]
                yield batch.filter(pa.array(clean))

    return run


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark window; rows and columns are else as they are."""
    spark: SparkSession = docs.sparkSession
    place, scratch, own = docs.columns.index("text"), Scratch(spark), docs.schema
    parts = blocks(items)
    for k, block in enumerate(parts):
        with short_batches(spark):
            docs = docs.mapInArrow(_clean(_sent(block), place), own)
        if k + 1 < len(parts):
            docs = scratch.write(docs, f"pass-{k}")
    return docs


#: The digest columns of contamination(documents, benchmark) as SQL: an equi-join of all windows of each length that items have.
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w FROM iw, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, unnest(generate_series(1, len(ws) - n + 1)) AS p, ws FROM dw, sizes WHERE len(ws) >= n),
found AS (SELECT doc_id, p, x.n, item_id FROM places q JOIN windows x ON x.n = q.n AND x.w = array_to_string(q.ws[q.p:q.p + q.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS k FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
