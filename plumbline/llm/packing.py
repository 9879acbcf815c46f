"""Packs token pieces into sequences by minimum bin slack.

A document's ids, with an end id, are cut into pieces of at most CAPACITY. Lengths of pieces take at most CAPACITY values, so the
bins are planned over counts by length: for the bin that holds the longest piece left, a bitset subset-sum over the available
lengths finds the fullest feasible combination; it is taken as often as the counts allow and removed. The plan has a few thousand
patterns whatever the corpus is. Pieces find their place by their rank within their length; ranks are counted in splits.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch, short_batches

CAPACITY = 1024
END_ID = 2
#: Rows of one split of a length.
SPLIT_ROWS = 50_000
_encoders: dict = {}


#: Characters whose classes are the same in every Unicode version of the last decades: for these all libraries part texts alike.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧‰-⁞]*")
#: Words and ids that a worker keeps; the longest word kept; letters of a text from which on its words are taken in runs; words of a run.
WORDS, IDS, LONG_WORD, LONG_TEXT, RUN = 500_000, 5_000_000, 100, 1_000_000, 100_000


def _word_pattern() -> re.Pattern:
    """public_tokenizers.PATTERN for plain characters, with its classes spelled out, so that the faster re can run it."""
    low = [chr(c) for c in range(0x250)]
    letters, numbers = ("".join(c for c in low if unicodedata.category(c)[0] == kind) for kind in "LN")
    space = r" \t-\r\x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def _parts_alike(file: dict) -> bool:
    """Whether a tokenizer's file parts texts by the pattern that is spelled out here, changes nothing before, and gives each word its ids by itself."""
    parts, model = file["pre_tokenizer"] or {}, file["model"]
    plain = not any(file[k] for k in ("normalizer", "truncation", "padding"))
    bytes_ = parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")
    return plain and bytes_ and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "ignore_merges"))


class Encoder(dict):
    """Ids by a byte-level BPE file of the library tokenizers. The file's pattern parts a text into words and each word has ids of its
    own, so the ids of words that come again are kept; texts of other than plain characters, or with a special token, are encoded whole.

    The dict gives each kept word a number; the ids of word k are flat[starts[k] : starts[k + 1]]. A file that parts or changes texts in
    another way encodes them whole."""

    def __init__(self, path: str):
        # a task has one core; the library's own threads would take others'
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.full, self.words = Tokenizer.from_file(path), _word_pattern()
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.model, self.parted = self.full.model, _parts_alike(json.loads(self.full.to_str()))
        self.flat, self.starts = array("I"), array("q", [0])
        if not self.parted:
            return
        # the signs that the file's pre-tokenizer puts for a character's bytes; the model takes a word in these
        self.signs = {k: self.full.pre_tokenizer.pre_tokenize_str(chr(k))[0][0] for k in range(0x2060) if _PLAIN.fullmatch(chr(k))}

    def __missing__(self, word: str) -> int:
        self.flat.extend([t.id for t in self.model.tokenize(word.translate(self.signs))])
        self.starts.append(len(self.flat))
        number = len(self.starts) - 2
        if len(word) <= LONG_WORD:
            self[word] = number
        return number

    def _joined(self, words: list[str]) -> np.ndarray:
        if len(self.starts) > WORDS or len(self.flat) > IDS:
            self.clear()
            self.flat, self.starts = array("I"), array("q", [0])
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        starts = np.frombuffer(self.starts, np.int64)
        sizes = starts[at + 1] - starts[at]
        ends = np.cumsum(sizes)
        return np.frombuffer(self.flat, np.uint32)[np.repeat(starts[at] - ends + sizes, sizes) + np.arange(ends[-1])]

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not self.parted or not _PLAIN.fullmatch(text) or any(x in text for x in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) < LONG_TEXT:
            return self._joined(self.words.findall(text))
        found = (m.group() for m in self.words.finditer(text))
        return np.concatenate([self._joined(run) for run in iter(lambda: list(islice(found, RUN)), [])])


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all but the first are CAPACITY long."""
    first = n % CAPACITY or CAPACITY
    return [(0, first), *((s, CAPACITY) for s in range(first, n, CAPACITY))]


def _pieces(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(tokens.ids(text or ""), np.uint32(END_ID))
                for k, (s, n) in enumerate(cut(len(ids))):
                    own = ids[s : s + n].astype("<u4")
                    rows.append((doc, k, s, n, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
            names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"], [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[k : k + 4096]], kind) for j, kind in enumerate(kinds[: 5 + with_ids])], names[: 5 + with_ids])

    return run


def fullest(counts: list[int], first: int, capacity: int) -> dict[int, int]:
    """The fullest combination that holds a piece of length first, by lengths and how many of each. counts[n]: pieces of length n left."""
    room = capacity - first
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for n in range(min(room, len(counts) - 1), 0, -1):
        have = min(counts[n] - (n == first), room // n)
        k = 1
        while have > 0:
            take = min(k, have)
            steps.append((reach, n, take))
            reach |= (reach << (n * take)) & mask
            have -= take
            k *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = {first: 1}
    for held, n, take in reversed(steps):
        if not held >> at & 1:
            at -= n * take
            used[n] = used.get(n, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(bins, lengths and how many of each in every such bin); all pieces are placed."""
    left = [0] * (capacity + 1)
    for n, c in counts.items():
        left[n] = c
    out = []
    for first in range(capacity, 0, -1):
        while left[first]:
            used = fullest(left, first, capacity)
            bins = min(left[n] // k for n, k in used.items())
            for n, k in used.items():
                left[n] -= bins * k
            out.append((bins, used))
    return out


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Packs the texts of docs (doc_id, text) into sequences of at most CAPACITY ids.

    A text's ids are followed by END_ID; a null text has END_ID alone. Only documents over CAPACITY are cut; the first piece may be
    shorter than CAPACITY. tokenizer: path of a tokenizers file on every executor.

    Returns doc_id, piece (from 0), start, length, ids_crc32 (unsigned, of little-endian unsigned 32-bit ids), sequence_id, offset
    (gapless from 0 in each sequence), and ids where with_ids is set. Repeated and null doc_ids each get their pieces. An empty
    table gives no row. Other columns are not read.
    """
    import public_tokenizers

    spark: SparkSession = docs.sparkSession
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    with short_batches(spark, 500):
        pieces = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(path, with_ids), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
        # each row gets a number, by which rows that are alike in everything are parted too
        pieces = scratch.write(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    # within a length, a split's rows are ranked after those of the splits before it
    splits = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    table = plan({r.length: r.n for r in splits})
    pieces = pieces.join(F.broadcast(spark.createDataFrame([(r.length, -(-r.n // SPLIT_ROWS)) for r in splits], "length bigint, splits int")), "length").withColumn("split", F.pmod(F.xxhash64("row"), F.col("splits")).cast("int"))
    starts = pieces.groupBy("length", "split").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("length", "split", (F.sum("n").over(W.partitionBy("length").orderBy("split").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("within", F.row_number().over(W.partitionBy("length", "split").orderBy("doc_id", "piece", "ids_crc32", "row"))).join(starts, ["length", "split"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within") - 1)
    # each length's ranks are dealt to its patterns in order; a pattern that holds k of a length takes bins * k ranks of it
    dealt: dict[int, list[tuple[int, int, int, int]]] = {}
    used_up: dict[int, int] = {}
    bin0 = 0
    for bins, used in table:
        offset = 0
        for n in sorted(used, reverse=True):
            begin = used_up.get(n, 0)
            dealt.setdefault(n, []).append((begin, bin0, used[n], offset))
            used_up[n] = begin + bins * used[n]
            offset += n * used[n]
        bin0 += bins
    rows = [(n, [x[0] for x in sorted(v)], sorted(v)) for n, v in dealt.items()]
    places = F.broadcast(spark.createDataFrame(rows, "length bigint, begins array<bigint>, ranges array<struct<begin: bigint, bin: bigint, each: bigint, offset: bigint>>"))
    # ranges begin in order, so the last one not over the rank is found by its count
    return _placed(ranked.join(places, "length"), with_ids)


def _placed(ranked: DataFrame, with_ids: bool) -> DataFrame:
    at = F.element_at("ranges", F.size(F.filter("begins", lambda b: b <= F.col("rank"))))
    with_range = ranked.withColumn("at", at)
    k = F.col("rank") - F.col("at.begin")
    inside = F.pmod(k, F.col("at.each"))
    return with_range.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at.bin") + (k - inside).cast("bigint") / F.col("at.each")).cast("bigint").alias("sequence_id"), (F.col("at.offset") + inside * F.col("length")).cast("bigint").alias("offset"), *(["ids"] if with_ids else []))
