"""Vectorised word and shingle hashing over Arrow batches of texts (numpy, no object per word)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Space and \x09-\x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: UTF-8 bytes with A-Z lower-cased and all other ASCII bytes but 0-9 and a-z as spaces.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _WORD else 0x20 for c in range(256))
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on seed alone."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_weights = multipliers(4096, 11)


def weights(n: int) -> np.ndarray:
    global _weights
    if n > len(_weights):
        _weights = multipliers(max(n, 2 * len(_weights)), 11)
    return _weights


def as_bytes(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of at most so many bytes; a longer text is a range of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all white-space words of lower-cased texts, one after another, and where each text's words begin (one more entry than texts)."""
    buf = np.frombuffer(b"\n".join(texts).translate(LOWER) + b"\n", np.uint8)
    inside = ~SPACE[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    lens = ends - starts
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, U), bounds
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    place = np.arange(lens.sum()) - np.repeat(first, lens)
    each = weights(int(lens.max()))[place]
    each *= buf[inside].astype(U) + U(1)
    return mix(np.add.reduceat(each, first) + lens.astype(U) * U(0x9E3779B97F4A7C15)), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, text after text, and where each text's begin. A text of fewer words, but not none, has its whole sequence as one."""
    counts = np.diff(bounds)
    each = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out = np.concatenate(([0], np.cumsum(each)))
    m = multipliers(n, 23)
    if len(words) >= n:
        rolled = words[: len(words) - n + 1] * m[0]
        for j in range(1, n):
            rolled += words[j : len(words) - n + 1 + j] * m[j]
    else:
        rolled = np.zeros(0, U)
    got = np.zeros(out[-1], U)
    full = counts >= n
    if full.any():
        lens = each[full]
        src = np.arange(lens.sum()) + np.repeat(bounds[:-1][full] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
        dst = np.arange(lens.sum()) + np.repeat(out[:-1][full] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
        got[dst] = rolled[src]
    for i in np.flatnonzero((counts > 0) & ~full):
        w = words[bounds[i] : bounds[i + 1]]
        got[out[i]] = (w * m[: len(w)]).sum(dtype=U) + U(len(w))
    return mix(got), out
