"""Order MinHash fingerprints with DataFrame functions alone.

A text's k-mers are runs of K code points, each numbered by its occurrence in the text (so the second "the same " differs from the
first). ORDERS orders of the numbered k-mers are taken; of each the L least are put back into text order and hashed as a tuple. Two
texts agree in a slot if they share its tuple, so a moved passage counts even where the set of k-mers stays, and the share of equal
slots follows the edit distance.

The orders come from one hash. Five bits of it, turned by the occurrence's number, deal the numbered k-mers to ORDERS bins; order j
begins with bin j by the rest of the hash, and goes on with the next bins where a bin holds fewer than L. Only numbered k-mers of
small hash can be among the least of a bin, so SHORT of them are tried first, MOST if some bin then holds fewer than L; MOST leave a
bin short with a chance below 1e-40.

Everything happens within a row, as expressions over arrays of longs: a hash and its place share one long, so plain sorts of longs
order them. Texts are turned to four bytes a code point, where a k-mer is found without a walk, so the work is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import parts

#: Code points of a k-mer, k-mers of a tuple, slots.
K, L, ORDERS = 8, 3, 32
SHORT, MOST = 384, 4096
#: Low bits of a long that hold a place: of texts of fewer than 2**PLACE k-mers, and of longer ones.
PLACE, PLACE_LONG = 20, 31
#: Bytes of text in one range of doc_ids; a task takes about four ranges.
RANGE_BYTES = 2 << 20


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value. A lambda that names a binary or a computed column itself would copy or make it for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _packed(wide: str, first: str, last: str, bits: str) -> str:
    """Hashes of the k-mers at places first to last of a wide text, their low bits replaced by the place."""
    gram = f"xxhash64(substring(w, i * 4 + 1, {4 * K}))"
    hashes = _let("w", wide, f"transform(sequence({first}, {last}), i -> shiftleft(shiftright({gram}, {bits}), {bits}) | i)")
    return f"if({last} < {first}, cast(array() as array<bigint>), {hashes})"


def _counted(chars: str) -> str:
    """K-mers of a text; one of fewer code points than K, but not none, has all of them as its one k-mer."""
    return f"greatest({chars} - {K - 1}, if({chars} > 0, 1, 0))"


def _bits(count: str) -> str:
    return f"if({count} < {1 << PLACE}, {PLACE}, {PLACE_LONG})"


def _binned(least: str, bits: str) -> str:
    """For sorted packed k-mers: bin, index and number in one long each. Equal hashes stand together in text order, which numbers them."""
    again = f"if(i < 2 or shiftright(x ^ c[i - 2], {bits}) <> 0, 1, size(filter(slice(c, 1, i), y -> shiftright(x ^ y, {bits}) = 0)))"
    first = "shiftleft(shiftright(x, 32) & 31, 24) | shiftleft(i, 12)"
    turned = _let("n", again, "shiftleft((shiftright(x, 32) & 31) ^ (n & 31), 24) | shiftleft(i, 12) | n")
    return _let("c", least, f"transform(c, (x, i) -> if(i < 1 or shiftright(x ^ c[i - 1], {bits}) <> 0, {first}, {turned}))")


def _starts(zs: str, most: int) -> str:
    """Where each bin begins in the sorted bins, and where the last one ends, by binary search."""
    halves = ", ".join(str(1 << i) for i in range(most.bit_length() - 1, -1, -1))
    return _let("z", zs, f"transform(sequence(0, {ORDERS}), j -> aggregate(array({halves}), 0, (at, h) -> if(at + h <= size(z) and z[at + h - 1] < shiftleft(cast(j as bigint), 24), at + h, at)))")


def _slots(df: DataFrame, wide: str, packed: str, bits: str, out: str) -> DataFrame:
    """Adds the slots (longs below 2**32; none without k-mers) of a text of which wide and packed are columns. A column that a lambda reads is named twice at least, so that the planner doesn't move its making into the lambda."""
    a, z, s, z2, s2 = (f"_{out}_{x}" for x in ("a", "z", "s", "z2", "s2"))
    none = "cast(array() as array<bigint>)"
    least = lambda n: f"if(size({a}) = 0, {none}, {_binned(f'slice({a}, 1, {n})', bits)})"
    few = f"size({a}) > {SHORT} and exists(sequence(0, {ORDERS - 1}), j -> {s}[j + 1] - {s}[j] < {L})"
    df = df.withColumn(a, F.sort_array(packed))
    df = df.withColumn(z, F.sort_array(F.expr(least(SHORT)))).withColumn(s, F.expr(_starts(z, SHORT)))
    df = df.withColumn(z2, F.expr(f"if({few}, sort_array({least(MOST)}), {z})")).withColumn(s2, F.expr(f"if(size({z2}) = size({z}), {s}, {_starts(z2, MOST)})"))
    place = f"shiftleft({a}[cast(shiftright(x, 12) & 4095 as int)] & (shiftleft(1L, {bits}) - 1), 12) | (x & 4095)"
    picked = f"transform(sequence(0, least({L}, size(z)) - 1), t -> {_let('x', 'z[(s[j] + t) % size(z)]', place)})"
    tuple_ = f"aggregate(sort_array({picked}), 42L, (h, v) -> xxhash64(h, substring(w, cast(shiftright(v, 12) * 4 + 1 as int), {4 * K}), v & 4095))"
    slots = f"transform(sequence(0, {ORDERS - 1}), j -> shiftrightunsigned({tuple_}, 32))"
    slots = f"if(size({z2}) = 0, {none}, {_let('w', wide, _let('z', z2, _let('s', s2, slots)))})"
    # a row's number makes the column one of its own: a filter on it can't be pushed below, where it would hold the whole expression again and again
    return df.withColumn(out, F.when(F.monotonically_increasing_id() >= 0, F.expr(f"if(octet_length({wide}) = 0, {none}, {slots})"))).drop(a, z, s, z2, s2)


def with_slots(df: DataFrame, text: str, out: str = "slots") -> DataFrame:
    """df with the slots of its column text, which holds no null."""
    wide, packed, bits = f"_{out}_wide", f"_{out}_packed", f"_{out}_bits"
    count = _counted(f"cast(octet_length({wide}) / 4 as int)")
    df = df.withColumn(wide, F.encode(F.col(text), "UTF-32")).withColumn(bits, F.expr(_bits(count)))
    df = df.withColumn(packed, F.expr(_packed(wide, "0", f"{count} - 1", bits)))
    return _slots(df, wide, packed, bits, out).drop(wide, packed, bits)


def as_string(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal slots, 0 to 1; two texts without k-mers are alike, one without and one with are not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same / F.lit(float(ORDERS)))


def _bounds(rows: DataFrame) -> tuple[list[int], bool]:
    """doc_ids that part the rows evenly into ranges of about RANGE_BYTES, the least among them, and whether a doc_id is null."""
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = max(8 * parts(rows.sparkSession), -(-size // RANGE_BYTES))
    asked = F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)
    got = rows.agg(asked.alias("p"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    return (sorted({got.least, *(got.p or [])}) if got.least is not None else []), bool(got.nulls)


def _bucket(bounds: list[int]) -> Column:
    """How many bounds are not over doc_id, looked up in two steps; 0 for a null doc_id."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    upto = lambda a: F.size(F.filter(a, lambda b: b <= F.col("doc_id")))
    # of text, which the planner turns into one literal
    fixed = lambda a: F.split(F.lit(",".join(map(str, a))), ",").cast("array<bigint>")
    below = F.greatest(upto(fixed(bounds[::step])) - 1, F.lit(0)) * step
    return F.coalesce(below + upto(F.slice(fixed(bounds), below + 1, F.lit(step))), F.lit(0))


def _dealt(rows: DataFrame) -> tuple[DataFrame, W]:
    """Rows (doc_id, text) dealt to ranges of doc_id, whose number grows with the bytes, and the order within a range.

    The row at the lower end of a range also stands, marked as not real, at the end of the range before it, and the first row of all
    at the end of the last one, so that every row finds its successor in its own range. Equal doc_ids are ordered by text; null
    doc_ids come first, in a range of their own.
    """
    bounds, nulls = _bounds(rows)
    bucket, last = _bucket(bounds), len(bounds)
    place = lambda b, real, wrap: F.struct(b.cast("int").alias("bucket"), F.lit(real).alias("real"), F.lit(wrap).alias("wrap"))
    is_bound = F.array_contains(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), F.col("doc_id")) if bounds else F.lit(False)
    is_first = F.col("doc_id").isNull() if nulls or not bounds else F.col("doc_id") == bounds[0]
    places = F.filter(F.array(place(bucket, True, False), F.when(is_bound, place(bucket - 1, False, False)), F.when(is_first, place(F.lit(last), False, True))), lambda x: x.isNotNull())
    dealt = rows.withColumn("at", F.explode(places)).select("doc_id", "text", "at.*").repartition(max(parts(rows.sparkSession), -(-last // 4)), "bucket")
    return dealt, W.partitionBy("bucket").orderBy("wrap", F.col("doc_id").asc_nulls_first(), "text", F.col("real").desc())


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of the texts of docs (doc_id, text): doc_id, fingerprint (the slots, eight hexadecimal digits each). Null texts count as empty, and have an empty fingerprint. Every row gets a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return with_slots(docs.select("doc_id", text.alias("text")), "text").select("doc_id", as_string(F.col("slots")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and that of the next document.

    Edited: the last floor(n_chars / 4) code points give way to the first as many (or all) of the next document by doc_id (after the
    last: the first). Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts
    count as empty, with an empty fingerprint, which is wholly like another empty one; a text of fewer than K code points has all of
    them as its one k-mer. Repeated doc_ids follow each other by text; null ones come first. One row is its own next; an empty table
    gives no row. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dealt, order = _dealt(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")))
    found = dealt.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    found = found.withColumns({"n": n, "cut": cut, "edited": F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))})
    found = found.withColumns({"wide": F.encode("text", "UTF-32"), "wide_edited": F.encode("edited", "UTF-32"), "m": F.expr(_counted("n")), "sha": F.sha2("edited", 256)})
    found = found.withColumns({"bits": F.expr(_bits("m")), "me": F.expr(_counted("cast(octet_length(wide_edited) / 4 as int)"))})
    found = found.withColumns({"bits_edited": F.expr(_bits("me")), "packed": F.expr(_packed("wide", "0", "m - 1", "bits"))})
    # k-mers that end before the cut are those of the text itself
    found = found.withColumn("keep", F.expr(f"if(bits = bits_edited, greatest(least(n - cut - {K - 1}, me), 0), 0)"))
    found = found.withColumn("packed_edited", F.concat(F.slice("packed", F.lit(1), F.col("keep")), F.expr(_packed("wide_edited", "keep", "me - 1", "bits_edited"))))
    found = _slots(_slots(found, "wide", "packed", "bits", "slots"), "wide_edited", "packed_edited", "bits_edited", "slots_edited")
    # the text orders equal doc_ids, so it stays until each row has seen the next one's slots
    found = found.withColumn("next_slots", F.lead("slots").over(order)).where("real")
    return found.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_string(F.col("slots")).alias("fingerprint"),
        as_string(F.col("slots_edited")).alias("edited_fingerprint"),
        likeness(F.col("slots"), F.col("slots_edited")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )
