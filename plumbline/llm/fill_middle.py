"""Fill-in-the-middle transformation: a document's prefix, middle and suffix, cut at unit borders, are put into another order.

Units are runs of ASCII letters and single other code points. One Aho-Corasick automaton scans a text for the places where letters
begin or end and for the sentinels. Every code point is folded to a symbol of its class first, so that the automaton has few
patterns and its offsets are code points. Between two events a run of letters is one unit and a run of others has as many units as
code points, so the place of a unit of any rank follows from the events, and no unit is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import short_batches
from .textops import as_bytes, slices

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_KEPT = frozenset((PREFIX + SUFFIX + MIDDLE).encode())
#: One symbol for each class, save for the characters of sentinels.
FOLD = bytes(c if c in _KEPT else ord("a") if c in _LETTERS else ord(".") for c in range(256))


def automaton() -> ahocorasick.Automaton:
    """Finds pairs of folded symbols of unlike classes (value 0) and sentinels (value 1)."""
    a = ahocorasick.Automaton()
    letters, others = ({chr(FOLD[c]) for c in range(256) if (c in _LETTERS) == own} for own in (True, False))
    for x, y in product(letters, others):
        a.add_word(x + y, 0)
        a.add_word(y + x, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        a.add_word(s, 1)
    a.make_automaton()
    return a


class Units:
    """The units of a text, counted and placed by the events that the automaton finds."""

    def __init__(self, text: str, a: ahocorasick.Automaton):
        # each code point beyond ASCII becomes one question mark
        folded = text.encode("ascii", "replace").translate(FOLD).decode("ascii")
        starts, self.marked = [0], False
        for end, mark in a.iter(folded):
            if mark:
                self.marked = True
            else:
                starts.append(end)
        self.length, self.starts = len(text), np.array(starts, np.int64)
        #: Whether each gap between events is a run of letters; gaps of the two classes take turns.
        self.letters = (np.arange(len(starts)) % 2 == 0) == folded[:1].isalpha()
        lens = np.diff(self.starts, append=self.length)
        self.before = np.concatenate(([0], np.cumsum(np.where(self.letters, 1, lens))))
        self.n = int(self.before[-1])

    def place(self, rank: int) -> int:
        """Where the unit of that rank begins, in code points; the end for rank n."""
        if rank >= self.n:
            return self.length
        gap = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.starts[gap]) + (0 if self.letters[gap] else rank - int(self.before[gap]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 that depend on the seed and the document's id alone; a null id counts as an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def turn(text: str, doc_id: int | None, a: ahocorasick.Automaton, seed: int, turned: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and the output of one text."""
    units, h = Units(text, a), draws(doc_id, seed)
    if not text or units.marked or h[2] % 100 >= turned:
        return units.n, "plain", None, None, text
    first, last = sorted((units.place(h[0] % (units.n + 1)), units.place(h[1] % (units.n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h[3] % 100 < suffix_first:
        return units.n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _turned(seed: int, turned: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i, j in slices(texts):
                ids = batch.column(0).slice(i, j - i)
                got = [turn(t.decode(), d, a, seed, turned, suffix_first) for t, d in zip(texts[i:j], ids.to_pylist(), strict=True)]
                n, form, before, middle, output = zip(*got, strict=True)
                columns = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, seed: int = 1, turned: int = 90, suffix_first: int = 20) -> DataFrame:
    """Turns the texts of docs (doc_id, a whole number, and text) for training on filling in a middle.

    A text is cut into n units (`[A-Za-z]+|[^A-Za-z]`). Two draws by the document's id place the cuts, each border of units as
    likely as any other. Of a hundred documents `turned` are turned, and of a hundred of these `suffix_first` begin with the suffix.

    Returns doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output: plain, the text;
    psm, <P>prefix<S>suffix<M>middle; spm, <S>suffix<P>prefix<M>middle. Texts that hold a sentinel stay plain, so that `restored` gives
    every text back. Null and empty texts are empty and plain. Parts may be empty. Equal doc_ids are cut by the same draws, and null
    ones as if their digits were empty; each row gets a row. An empty table gives no row. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    with short_batches(docs.sparkSession):
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(_turned(seed, turned, suffix_first), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that transform turned into output. Sentinels stand once each in a turned text, as none is in the text itself and none can arise where parts meet."""
    middle, rest = F.substring_index(output, MIDDLE, -1), F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(rest, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(rest, SUFFIX, -1))
    spm = F.concat(F.substring_index(rest, PREFIX, -1), middle, F.substring_index(F.substring_index(rest, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """transform with digests in place of texts: output_sha256 of the output, restored_sha256 of the text rebuilt from output and form."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = transform(docs)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: digests(documents) as SQL: all units are made, and the parts are joined from them.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
