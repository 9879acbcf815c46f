"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A signature has chunks * WIDTH symbols of eight bits. Two signatures that differ in at most 2 * chunks - 1 symbols agree, by
pigeonhole, in all but at most one symbol of some chunk. Every chunk is therefore indexed under each choice of the one symbol
that may be wrong (WIDTH keys a chunk), which finds all pairs under that distance without comparing others.

Groups are not expanded into pairs. Equal sets collapse first. In each bucket every member is compared with the least member
only; members that fail this comparison ("strays") are then compared, in blocks, with all others of the pivot's group, so that
no link between classes is lost. A bucket of g members of which s are strays costs g + s * g set comparisons and g + s rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, parts, short_batches
from .textops import U, as_bytes, mix, multipliers, shingle_hashes, slices, word_hashes

#: Symbols of a chunk, of eight bits each.
WIDTH = 6
#: A pair at the threshold is missed with at most this probability; more chunks are taken until that holds.
MISS = 1e-5
#: Rows and shingles of one block of strays or members.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000


def chunks_for(percent: int) -> int:
    """As many chunks as keep the chance that all have two wrong symbols or more, at that similarity, under MISS."""
    p = percent / 100
    lost = 1 - p**WIDTH - WIDTH * (1 - p) * p ** (WIDTH - 1)
    return max(2, int(np.ceil(np.log(MISS) / np.log(max(lost, 1e-9)))))


def signatures(values: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k symbols of eight bits for each text; texts without shingles get zeros."""
    out = np.zeros((len(bounds) - 1, k), np.uint8)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        at = bounds[:-1][some]
        for j, m in enumerate(multipliers(k, 101)):
            out[some, j] = (mix(np.minimum.reduceat(values * m, at)) >> U(56)).astype(np.uint8)
    return out


def distinct(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def named(sets: list[np.ndarray]) -> tuple[list, list]:
    """Two independent sums over each set, which name it."""
    return [x.sum(dtype=U) + U(len(x)) for x in sets], [mix(x + U(0x5851F42D4C957F2D)).sum(dtype=U) for x in sets]


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x, U).view(np.int64), pa.int64())


def _signed(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in slices(texts):
                hashes, bounds = shingle_hashes(*word_hashes(texts[a:b]), words)
                sig = signatures(hashes, bounds, k)
                sets = distinct(hashes, bounds)
                k1, k2 = named(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), _long(k1), _long(k2), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "h", "n_shingles", "k1", "k2", "sig"])

    return run


def _keyed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, k // WIDTH, WIDTH).astype(U)
            for c in range(k // WIDTH):
                for wrong in range(WIDTH):
                    key = np.full(len(ids), c * WIDTH + wrong, U)
                    for j in range(WIDTH):
                        if j != wrong:
                            key = (key << U(8)) | sig[:, c, j]
                    yield pa.RecordBatch.from_arrays([_long(key), pa.array(ids, pa.int64())], ["key", "id"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(3))
            ids, given = batch.column(0), np.stack([batch.column(c).to_numpy().view(U) for c in (1, 2)], axis=1) if batch.num_rows else None
            for a, b in slices(texts):
                sets = distinct(*shingle_hashes(*word_hashes(texts[a:b]), words))
                # a text that only shares the hash of its class's text is not of the class
                own = np.flatnonzero((np.array(named(sets), U).T == given[a:b]).all(axis=1))
                sets = [sets[i] for i in own]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own + a)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _long(flat))], ["id", "s"])

    return run


def _block(percent: int):
    """Strays of one block against members of one block; emits a spanning set of the links found."""

    def run(table: pa.Table) -> pa.Table:
        side, ok = table["stray"].to_numpy(), table["ok"].to_numpy()
        ids = table["id"].to_numpy()
        column = table["s"].combine_chunks()
        lens = np.diff(column.offsets.to_numpy())
        flat, offs = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lens)))
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            vocabulary, where = np.unique(np.concatenate([flat[offs[i] : offs[i + 1]] for i in right]), return_inverse=True)
            starts = np.concatenate(([0], np.cumsum(lens[right])[:-1]))
            root = {int(i): int(i) for i in ids}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            of_pivot = [int(ids[i]) for i in right if ok[i]]
            for x in of_pivot[1:]:
                root[find(x)] = find(of_pivot[0])
            for i in left:
                own = flat[offs[i] : offs[i + 1]]
                at = np.searchsorted(vocabulary, own)
                at[at == len(vocabulary)] = 0
                mark = np.zeros(len(vocabulary), np.int64)
                mark[at[vocabulary[at] == own]] = 1
                both = np.add.reduceat(mark[where], starts)
                for j in np.flatnonzero(100 * both >= percent * (lens[i] + lens[right] - both)):
                    a, b = int(ids[i]), int(ids[right[j]])
                    if find(a) != find(b):
                        root[find(a)] = find(b)
                        found.append((max(a, b), min(a, b)))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return run


def _classes(docs: DataFrame, scratch: Scratch, words: int, percent: int, chunks: int | None) -> DataFrame:
    """A row for each row of docs: doc_id, h (a hash of its text), n_shingles, and for rows that can be linked the number of their
    group of linked classes and its least doc_id. Rows with equal sets are of one class, whatever their doc_ids; doc_ids name nothing here."""
    spark: SparkSession = docs.sparkSession
    k = WIDTH * (chunks or chunks_for(percent))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text")
    with short_batches(spark):
        signed = scratch.write(rows.mapInArrow(_signed(words, k), "doc_id bigint, h bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary"), "signed")
    linkable = F.expr("doc_id is not null and n_shingles > 0")
    reps = signed.where(linkable).groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h", "sig")).alias("r"))
    reps = scratch.write(reps.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "r.*"), "reps")
    keys = reps.select("id", "sig").mapInArrow(_keyed(k), "key bigint, id bigint")
    shared = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("key", "pivot")
    pairs = scratch.write(keys.join(shared, "key").where("id <> pivot").select("pivot", "id").distinct(), "pairs")
    involved = reps.join(pairs.select("id").union(pairs.select("pivot")).distinct(), "id").select("id", "k1", "k2", "doc_id", "h")
    with short_batches(spark):
        # hashed on the short side at every size: as a broadcast it would grow with the input
        texts = rows.join(involved.hint("shuffle_hash"), ["doc_id", "h"]).select("id", "k1", "k2", "text")
        sets = scratch.write(texts.mapInArrow(_sets(words), "id bigint, s array<bigint>").dropDuplicates(["id"]), "sets")
    one = pairs.join(sets, "id").select("pivot", "id", F.col("s").alias("s1"))
    both = F.size(F.array_intersect("s1", "s")).cast("bigint")
    tried = one.join(sets.select(F.col("id").alias("pivot"), "s"), "pivot").select("pivot", "id", F.size("s1").cast("bigint").alias("n"), (100 * both >= percent * (F.size("s1") + F.size("s") - both)).alias("ok"))
    tried = scratch.write(tried, "tried")
    groups = tried.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all"), F.count_if(~F.col("ok")).alias("out"), F.sum(F.when(~F.col("ok"), F.col("n"))).alias("out_all")).where("out > 0 and rows > 1")
    # a table, so that the join on the pivot can split the rows of a large group
    groups = scratch.write(groups, "groups")
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("int")
    members = tried.join(groups.select("pivot", blocks("rows", "all").alias("mb"), blocks("out", "out_all").alias("sb")), "pivot")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    sides = members.where("not ok").select("pivot", "id", "ok", own("sb").alias("i"), upto("mb").alias("j"), F.lit(True).alias("stray")).union(members.select("pivot", "id", "ok", upto("sb").alias("i"), own("mb").alias("j"), F.lit(False).alias("stray")).select("pivot", "id", "ok", "i", "j", "stray"))
    late = sides.join(sets, "id").groupBy("pivot", "i", "j").applyInArrow(_block(percent), "a bigint, b bigint")
    links = scratch.write(late.union(tried.where("ok").select(F.col("id").alias("a"), F.col("pivot").alias("b"))).distinct(), "links")
    scratch.drop("pairs", "sets", "tried", "groups")
    linked = reps.select("id", "k1", "k2", "doc_id").join(components(links, scratch).withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", "doc_id", F.coalesce("component", "id").alias("group"))
    linked = scratch.write(linked, "classes")
    least = linked.groupBy("group").agg(F.min("doc_id").alias("least"))
    at = linked.select("k1", "k2", "group").join(least, "group")
    joined = signed.withColumns({c: F.when(linkable, F.col(c)) for c in ("k1", "k2")}).join(at, ["k1", "k2"], "left")
    return joined.select("doc_id", "h", "n_shingles", "group", "least")


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80, chunks: int | None = None) -> DataFrame:
    """Classes of near-duplicate documents.

    docs: doc_id, text. Words: A-Z lower-cased, parted by space and \\x09-\\x0D. Sets: distinct shingles of that many words; a text
    of fewer words has its whole sequence as one. Two documents are linked if 100 * intersection >= percent * union.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable over links, itself included), kept (doc_id = component_id).
    Null or empty texts, and texts without words: n_shingles 0, linked with nothing. Null doc_id: linked with nothing, component_id
    null, kept true. Rows that repeat a doc_id are documents of their own: each gets a row with what its own text is linked with, so
    two of them may name the same component_id without a link. An empty table gives no row. Other columns are not read.
    """
    found = _classes(docs, scratch, words, percent, chunks).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each group of linked documents one row, of least doc_id (of its texts the one of least hash); columns as they are.

    Rows that repeat a doc_id are judged by their own texts: one that is linked with nothing stays, whatever other rows bear its
    doc_id. Of rows that repeat a doc_id and its text one stays. Rows with a null doc_id stay. An empty table gives no row.
    """
    found = _classes(docs, scratch, words, percent, None).where("doc_id is not null")
    # texts by doc_id and hash; those that are linked with nothing have no group and compete with none
    texts = scratch.write(found.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"), F.max("group").alias("group")), "rows")
    first = texts.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    out = texts.join(first, "group").where("first.doc_id <> doc_id or first.h <> h").select("doc_id", "h")
    out = scratch.write(out, "out")
    twice = scratch.write(texts.where("n > 1").join(out, ["doc_id", "h"], "left_anti").select("doc_id", "h"), "twice")
    hashed = docs.withColumns({"_id_": F.col("doc_id").cast("bigint"), "_h_": F.xxhash64(F.col("text").cast("string"))})
    same = lambda other: (F.col("_id_") == other["doc_id"]) & (F.col("_h_") == other["h"])
    drop = out.union(twice)
    kept = hashed.join(drop, same(drop), "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return kept
    return kept.unionByName(hashed.join(twice, same(twice), "left_semi").dropDuplicates(["_id_", "_h_"]).select(*docs.columns))


#: near_duplicates(documents, words=3, percent=85) as SQL: all pairs that share a shingle, and reachability over links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 2], ' ')) END)) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id > b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN least l USING (doc_id)
"""
