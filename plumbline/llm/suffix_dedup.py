"""Repeated passages: a hash-compared suffix sort over the parts of the corpus that can hold one.

A passage is LENGTH bytes. Every LENGTH-byte window of a text is assigned to its anchor, the k-gram of least hash within it (the
leftmost of equals), so equal windows have equal anchors at equal places. Runs of windows with one anchor form a fragment. Anchors
that occur once hold no repeat. Equal fragments collapse to one row with a count: all their windows repeat. The distinct fragments
of an anchor are suffix-sorted: prefix polynomial hashes and a binary search give the common extension of two suffixes, so a
comparison takes log2(LENGTH) steps; runs are merged bottom-up, all pairs of runs at once. Neighbours that extend over LENGTH bytes
are compared byte by byte; a class in which a hash was wrong is sorted again on its bytes.

Anchors with more than CHUNK distinct fragments are sorted in chunks; the distinct windows of the chunks then meet by two 64-bit
hashes, so that no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, parts, short_batches
from .textops import U, as_bytes, mix, multipliers, slices

LENGTH = 200
#: Bytes of a k-gram; a window holds LENGTH - GRAM + 1 of them.
GRAM = 32
#: Distinct fragments of an anchor that one group of the suffix sort takes.
CHUNK = 4096
#: Window starts of one piece of a very long text.
PIECE = 1 << 21
#: Bytes of fragments that are sorted at once.
SORT_BYTES = 1 << 19
_POSITION = U((1 << 24) - 1)


class PrefixHash:
    """Polynomial hashes of all substrings of a buffer, modulo 2**64, over random byte values."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, seed: int):
        n = len(buf) + 1
        held = self._powers.get(seed)
        if held is None or len(held[0]) < n:
            base = int(multipliers(1, seed)[0])
            most = max(n, SORT_BYTES * 2)
            up, down = (np.cumprod(np.concatenate(([U(1)], np.full(most, x, U)))) for x in (U(base), U(pow(base, -1, 1 << 64))))
            held = self._powers[seed] = (up, down, multipliers(256, seed + 1))
        self.inverse = held[1]
        self.sums = np.zeros(n, U)
        np.cumsum(held[2][buf] * held[0][: n - 1], out=self.sums[1:])

    def of(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[at]) * self.inverse[at]


def extension(prefix: PrefixHash, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The common extension of the suffixes at p and q, LENGTH at most, by binary search over hashes."""
    s, sp, sq, ip, iq = prefix.sums, prefix.sums[p], prefix.sums[q], prefix.inverse[p], prefix.inverse[q]
    got = np.zeros(len(p), np.int64)
    step = 1 << (LENGTH.bit_length() - 1)
    while step:
        to = got + step
        fits = to <= LENGTH
        np.minimum(to, LENGTH, out=to)
        same = ((s[p + to] - sp) * ip == (s[q + to] - sq) * iq) & fits
        got[same] += step
        step >>= 1
    return got


def before(buf: np.ndarray, prefix: PrefixHash, p: np.ndarray, q: np.ndarray, or_same: np.ndarray) -> np.ndarray:
    """Whether the suffix at p sorts before that at q; where they agree over LENGTH bytes, or_same."""
    n = extension(prefix, p, q)
    last = np.minimum(n, LENGTH - 1)
    return np.where(n >= LENGTH, or_same, buf[p + last] < buf[q + last])


def merge_sort(buf: np.ndarray, prefix: PrefixHash, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sorts the suffixes at[...] within each class, bottom-up. first, size: of its class, for each entry."""
    at, place, width = at.copy(), np.arange(len(at)) - first, 1
    while width < size.max(initial=0):
        rank = place % (2 * width)
        right = rank >= width
        block = first + place - rank
        sibling = np.where(right, block, block + width)
        length = np.clip(first + size - sibling, 0, width)
        low, high = np.zeros(len(at), np.int64), np.where(right, width, length)
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            # how many of the sibling run come first: those before it, and for the right run those equal to it too
            ahead = before(buf, prefix, at[sibling[live] + mid], at[live], right[live])
            low[live[ahead]] = mid[ahead] + 1
            high[live[~ahead]] = mid[~ahead]
            live = live[low[live] < high[live]]
        to = block + np.where(right, rank - width, rank) + low
        moved = np.empty_like(at)
        moved[to] = at
        at, width = moved, 2 * width
    return at


def repeated(buf: np.ndarray, at: np.ndarray, group: np.ndarray, prefix: PrefixHash | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Window starts at[...] in groups: which windows equal another of their group, and which are the first of their content."""
    dup, head = np.zeros(len(at), bool), np.ones(len(at), bool)
    order = np.argsort(group, kind="stable")
    g = group[order]
    cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((cut, [len(g)])))
    wide = np.repeat(sizes > 1, sizes)
    order = order[wide]
    if not len(order):
        return dup, head
    sizes = sizes[sizes > 1]
    first = np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    size = np.repeat(sizes, sizes)
    prefix = prefix or PrefixHash(buf, 31)
    # positions are distinct, so a sorted position names its entry
    spots = at[order]
    name = np.argsort(spots, kind="stable")
    ordered = merge_sort(buf, prefix, spots, first, size)
    windows = np.lib.stride_tricks.sliding_window_view(buf, LENGTH)
    pair = np.flatnonzero(first[1:] == first[:-1])
    same = np.zeros(len(ordered), bool)
    same[pair + 1] = extension(prefix, ordered[pair], ordered[pair + 1]) >= LENGTH
    check, wrong = np.flatnonzero(same), []
    for k in range(0, len(check), 1 << 15):
        part = check[k : k + (1 << 15)]
        wrong.append(part[(windows[ordered[part - 1]] != windows[ordered[part]]).any(axis=1)])
    for f in np.unique(first[np.concatenate(wrong)]) if wrong else ():
        members = sorted(ordered[f : f + size[f]], key=lambda x: buf[x : x + LENGTH].tobytes())
        ordered[f : f + size[f]] = members
        same[f + 1 : f + size[f]] = [buf[a : a + LENGTH].tobytes() == buf[b : b + LENGTH].tobytes() for a, b in zip(members, members[1:], strict=False)]
    entry = order[name[np.searchsorted(spots[name], ordered)]]
    dup[entry[same]] = True
    dup[entry[np.flatnonzero(same) - 1]] = True
    head[entry[same]] = False
    return dup, head


def fragments_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: text index, start, anchor offset, length, anchor hash, fragment hash of all fragments."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate(([0], np.cumsum(lens)))
    w = LENGTH - GRAM + 1
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U), np.zeros(0, U))
    if len(buf) < LENGTH or not (lens >= LENGTH).any():
        return empty
    prefix = PrefixHash(buf, 41)
    n = len(buf) - GRAM + 1
    grams = mix((prefix.sums[GRAM:] - prefix.sums[:n]) * prefix.inverse[:n])
    packed = np.full(-(-(n + w) // w) * w, ~U(0))
    packed[:n] = (grams & ~_POSITION) | np.arange(n, dtype=U)
    rows = packed.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    some = np.flatnonzero(lens >= LENGTH)
    counts = lens[some] - LENGTH + 1
    text = np.repeat(some, counts)
    starts = np.arange(counts.sum()) + np.repeat(base[some] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    anchor = (np.minimum(behind[starts], ahead[starts + w - 1]) & _POSITION).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    fs, fe = starts[cut], starts[np.concatenate((cut[1:], [len(starts)])) - 1] + LENGTH
    whole = PrefixHash(buf, 43)
    return text[cut], fs - base[text[cut]], anchor[cut] - fs, fe - fs, grams[anchor[cut]], mix(whole.of(fs, fe) + (fe - fs).astype(U))


def _pieces(ids: list[int], texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    for i, t in zip(ids, texts, strict=True):
        for a in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            yield i, a, t[a : a + PIECE + LENGTH - 1] if len(t) > PIECE else t


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = list(_pieces(batch.column(0).to_pylist(), as_bytes(batch.column(1))))
        for a, b in slices([t for _, _, t in pieces]):
            text, start, offset, length, anchor, whole = fragments_of([t for _, _, t in pieces[a:b]])
            ids, shift = (np.array([x[k] for x in pieces[a:b]], np.int64) for k in (0, 1))
            at = ((start + shift[text]) << 18) | (offset << 9) | length
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ids[text]), pa.array(at)], ["anchor", "whole", "rid", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the listed fragments out of their texts."""
    for batch in batches:
        for rid, text, cuts in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2), strict=True):
            rows = cuts.values
            at = rows.field("at").to_numpy()
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                yield pa.RecordBatch.from_arrays(
                    [rows.field("anchor")[k : k + 4096], rows.field("salt")[k : k + 4096], rows.field("many")[k : k + 4096], rows.field("single")[k : k + 4096], pa.array(np.full(len(part), rid), pa.int64()), pa.array(part), pa.array([text[x >> 18 : (x >> 18) + (x & 511)] for x in part.tolist()], pa.binary())],
                    ["anchor", "salt", "many", "single", "rid", "at", "piece"],
                )


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix-sorts the fragments of whole groups (rows come sorted by anchor and salt)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(table: pa.Table, cut: int):
        return _sort_groups(table.slice(0, cut)), table.slice(cut)

    for batch in batches:
        held.append(batch)
        size += batch.column(6).nbytes
        if size >= SORT_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            a, s = table["anchor"].to_numpy(), table["salt"].to_numpy()
            edge = np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1])) + 1
            if len(edge):
                out, rest = flush(table, int(edge[-1]))
                yield from out
                held = rest.to_batches()
                size = rest["piece"].nbytes
            else:
                held = table.to_batches()
    if held:
        yield from _sort_groups(pa.Table.from_batches(held))


def _sort_groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Cuts at group ends into parts of about SORT_BYTES and sorts each."""
    a, s = table["anchor"].to_numpy(), table["salt"].to_numpy()
    group = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (s[1:] != s[:-1])))) if len(a) else np.zeros(0, np.int64)
    length = table["at"].to_numpy() & 511
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(a) else np.zeros(0, np.int64)
    total, start = np.concatenate(([0], np.cumsum(length))), 0
    for k, b in enumerate(begin):
        end = int(begin[k + 1]) if k + 1 < len(begin) else len(a)
        if total[end] - total[start] >= SORT_BYTES or end == len(a):
            yield from _sort_part(table.slice(start, end - start), group[start:end])
            start = end


def _sort_part(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    at, rid = table["at"].to_numpy(), table["rid"].to_numpy()
    single, many = table["single"].to_numpy(), table["many"].to_numpy()
    buf = np.frombuffer(b"".join(table["piece"].to_pylist()), np.uint8)
    length, offset, start = at & 511, (at >> 9) & 511, at >> 18
    base = np.concatenate(([0], np.cumsum(length)))[:-1]
    n = length - LENGTH + 1
    piece = np.repeat(np.arange(len(at)), n)
    t = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    prefix = PrefixHash(buf, 31)
    spots = base[piece] + t
    dup, head = repeated(buf, spots, group[piece] * 1024 + (t - offset[piece] + 512), prefix)
    hit = np.flatnonzero(dup & single[piece])
    if len(hit):
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(piece[hit]) != 0))))
        lo, hi = hit[cut], hit[np.concatenate((cut[1:], [len(hit)])) - 1]
        yield _rows(rid[piece[lo]], start[piece[lo]] + t[lo], start[piece[lo]] + t[hi] + LENGTH, np.zeros(len(lo), U), np.zeros(len(lo), U), np.zeros(len(lo), bool))
    open_ = np.flatnonzero(many[piece] & head)
    if len(open_):
        p = spots[open_]
        w1, w2 = mix(prefix.of(p, p + LENGTH)), mix(PrefixHash(buf, 47).of(p, p + LENGTH))
        a = start[piece[open_]] + t[open_]
        yield _rows(rid[piece[open_]], a, a + np.where(single[piece[open_]] & ~dup[open_], LENGTH, 0), w1, w2, np.ones(len(p), bool))


def _rows(rid, a, b, w1, w2, window) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(window)], ["rid", "a", "b", "w1", "w2", "window"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Repeats:
    """texts: rid, k (SHA-256), n (rows with that text), text, of all distinct texts, null as empty. covered: rid, spans (array of a, b) of texts that occur once and hold repeated passages; spans may overlap. A text of LENGTH bytes or more that occurs more than once is covered as a whole and not listed."""

    def __init__(self, texts: DataFrame, covered: DataFrame):
        self.texts, self.covered = texts, covered

    def strip(self, each: Callable[[bytes, list[tuple[int, int]]], tuple], names: str, types: list[pa.DataType]) -> DataFrame:
        """each(text, merged spans) for all listed texts, as rows rid, ..."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fields = ["rid", *(x.split()[0] for x in names.split(", "))]
            for batch in batches:
                texts = as_bytes(batch.column(1))
                for a, b in slices(texts):
                    spans = [merged([(x["a"], x["b"]) for x in s]) for s in batch.column(2).slice(a, b - a).to_pylist()]
                    got = [each(t, s) for t, s in zip(texts[a:b], spans, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([x[k] for x in got], kind) for k, kind in enumerate(types))], fields)

        with short_batches(self.texts.sparkSession):
            return self.texts.where(f"n = 1 or octet_length(text) < {LENGTH}").select("rid", "text").join(self.covered, "rid").select("rid", "text", "spans").mapInArrow(run, f"rid bigint, {names}")


def repeats(docs: DataFrame, scratch: Scratch) -> Repeats:
    """Finds every byte covered by a LENGTH-byte string that also starts anywhere else in the column text of docs, the same text included. Matches do not cross texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("k"), text.alias("text")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    texts = scratch.write(texts.select(F.monotonically_increasing_id().alias("rid"), "k", "n", "text"), "texts")
    with short_batches(docs.sparkSession):
        found = scratch.write(texts.select("rid", "text").mapInArrow(_fragments, "anchor bigint, whole bigint, rid bigint, at bigint"), "fragments")
        again = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
        # both sides of the join are tables, so that a partition with a very common anchor can be split
        found = scratch.write(found.join(scratch.write(again, "again"), "anchor"), "repeated")
        scratch.drop("fragments", "again")
        length = F.col("at").bitwiseAND(511)
        found = found.withColumn("length", length)
        same = found.groupBy("anchor", "whole", "length").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "at")).alias("r"), F.bool_and("mixed").alias("mixed"))
        same = scratch.write(same.select("anchor", "whole", "length", "c", "r.rid", "r.at", "mixed"), "distinct")
        start = F.shiftright("at", 18)
        equal = found.join(same.where("c > 1").select("anchor", "whole", "length"), ["anchor", "whole", "length"]).select("rid", start.alias("a"), (start + F.col("length")).alias("b"))
        mixed = same.where("mixed")
        wide = mixed.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
        cuts = mixed.join(wide, "anchor").select("rid", F.struct("anchor", F.pmod(F.xxhash64("rid", "at"), F.col("chunks")).cast("int").alias("salt"), (F.col("chunks") > 1).alias("many"), (F.col("c") == 1).alias("single"), "at").alias("cut"))
        pieces = texts.select("rid", "text").join(cuts.groupBy("rid").agg(F.collect_list("cut").alias("cuts")), "rid").select("rid", "text", "cuts").mapInArrow(_cut, "anchor bigint, salt int, many boolean, single boolean, rid bigint, at bigint, piece binary")
        spans = pieces.repartition(parts(docs.sparkSession), "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_sorted, "rid bigint, a bigint, b bigint, w1 bigint, w2 bigint, window boolean")
        spans = scratch.write(spans, "spans")
    windows = spans.where("window")
    across = windows.join(windows.groupBy("w1", "w2").count().where("count > 1"), ["w1", "w2"]).where("b > a").select("rid", "a", "b")
    covered = spans.where("not window").select("rid", "a", "b").union(across).union(equal)
    covered = scratch.write(covered.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "covered")
    scratch.drop("repeated", "distinct", "spans")
    return Repeats(texts, covered)


def _digest(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    kept, last = hashlib.sha256(), 0
    for a, b in spans:
        kept.update(text[last:a])
        last = b
    kept.update(text[last:])
    return sum(b - a for a, b in spans), len(spans), kept.hexdigest()


def digests(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing every repeated byte.

    Null texts count as empty; texts under LENGTH bytes lose nothing. Rows that repeat a text of LENGTH bytes or more lose all of
    it. Repeated or null doc_ids each get their row. An empty table gives no row. Other columns are not read.
    """
    found = repeats(docs, scratch)
    cut = scratch.write(found.strip(_digest, "n_removed bigint, n_spans bigint, kept_sha256 string", [pa.int64(), pa.int64(), pa.string()]), "cut")
    size = F.octet_length("text").cast("bigint")
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= LENGTH)
    by_text = found.texts.select("rid", "k", "n", size.alias("n_bytes")).join(cut, "rid", "left").select(
        "k",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("k")))).alias("kept_sha256"),
    )
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("k"))
    return rows.join(by_text, "k").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _rest(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:a])
        last = b
    out.append(text[last:])
    # a span may begin or end within a character, of which the rest goes too
    return ("".join(x.decode(errors="ignore") for x in out),)


def without_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with every repeated passage cut from text (n_chars, where there is such a column, is set anew). All rows and columns stay; a null text stays null. Characters that a cut would split go as a whole."""
    found = repeats(docs, scratch)
    cut = scratch.write(found.strip(_rest, "rest string", [pa.string()]), "cut")
    whole = f"n > 1 and octet_length(text) >= {LENGTH}"
    by_text = found.texts.where(whole).select("k", F.lit("").alias("_rest_")).union(found.texts.select("rid", "k").join(cut, "rid").select("k", "rest"))
    key = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    changed = docs.withColumn("_key_", key).join(by_text.withColumnRenamed("k", "_key_"), "_key_", "left")
    changed = changed.withColumn("text", F.when(F.col("text").isNotNull(), F.coalesce("_rest_", F.col("text").cast("string"))))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col("_rest_").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


#: digests(documents) as SQL over all windows, in hexadecimal text.
SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, x, unnest(generate_series(0, len(x) // 2 - 1)) AS p FROM h WHERE x <> ''),
bytes AS (SELECT doc_id, p, substr(x, p * 2 + 1, 2) AS byte, CASE WHEN p * 2 + 400 <= len(x) THEN md5(substr(x, p * 2 + 1, 400)) END AS m FROM starts),
again AS (SELECT m FROM bytes WHERE m IS NOT NULL GROUP BY m HAVING count(*) > 1),
marked AS (SELECT doc_id, p, byte, count(a.m) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) > 0 AS gone FROM bytes b LEFT JOIN again a ON a.m = b.m),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM marked),
summed AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, count(*) FILTER (begins) AS k, coalesce(string_agg(byte, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM edges GROUP BY doc_id)
SELECT h.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN summed USING (doc_id)
"""
