"""One full match: peak, quality, ambiguity and candidates of a measured profile from one pass over its reference rows.

Reference rows are dealt to blocks of neighbouring azimuths, each with a halo of HALO rows from both sides, around in azimuth. A block
scores its rows and keeps what could matter for the whole: the best cell and the cells around it, moments of all its scores, its highest
cells, its strongest local maxima with their neighbours, and the maxima that could rival the peak. What blocks keep is folded in two
steps, so no step holds more than FOLD blocks. Tasks grow with the azimuths, and the heatmap is never written or named twice.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import both_scores
from .search import _spread

#: Rows of a block without its halo; blocks folded at once.
ROWS, FOLD = 256, 512
#: What lies so near the peak (azimuths, offsets) is left out of side statistics: for quality and for the side lobe. The halo covers the wider.
QUALITY, LOBE = (5, 3), (3, 3)
HALO = 5
#: Radii of local maxima: of candidates and of rivals; candidates kept.
CANDIDATE, RIVAL, TOP = 2, 3, 8
#: Cells within QUALITY of a peak at most: so many and one more of a block's highest hold the highest outside.
_NEAR = (2 * QUALITY[0] + 1) * (2 * QUALITY[1] + 1)

_CELL = "struct<az: int, off: int, score: double, ncc: double, msd: double, a0: double, a1: double, o0: double, o1: double>"
_PLACE = "struct<az: int, off: int, score: double>"
_PART = f"part bigint, n_az bigint, cells bigint, total double, squares double, best {_CELL}, around array<{_PLACE}>, highest array<{_PLACE}>, candidates array<{_CELL}>, rivals array<{_PLACE}>"
_NAMES = ["part", "n_az", "cells", "total", "squares", "best", "around", "highest", "candidates", "rivals"]
RESULT = "az int, off int, score double, ncc double, msd double, az_sub double, off_sub double, curve_off double, curve_az double, confidence double, to_side double, to_mean double, reliable boolean, pslr_db double, n_peaks bigint, isolation_m double, ambiguous boolean, candidates array<struct<az: int, off: int, score: double, ncc: double, msd: double, az_sub: double, off_sub: double>>"


def vertex(before: float | None, at: float, after: float | None) -> tuple[float, float]:
    """(shift of the peak of a parabola through three values, half a step at most; second difference); zeros for a straight line or a missing neighbour."""
    if before is None or after is None:
        return 0.0, 0.0
    d = before - 2 * at + after
    if not math.isfinite(d) or abs(d) < 1e-12:
        return 0.0, 0.0
    return min(max(0.5 * (before - after) / d, -0.5), 0.5), d


def _way(a: np.ndarray | int, b: int, n: int) -> np.ndarray | int:
    return np.minimum((a - b) % n, (b - a) % n)


def _first(score: np.ndarray, az: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """Indexes of the best scores; of equals the least az, then off."""
    if len(score) > 4 * most:
        # all that reach the last score kept, equals included
        some = np.flatnonzero(score >= np.partition(score, len(score) - most)[len(score) - most])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((off[some], az[some], -score[some]))][:most]


def _places(az: np.ndarray, off: np.ndarray, score: np.ndarray) -> list[dict]:
    return [{"az": int(a), "off": int(o), "score": float(s)} for a, o, s in zip(az, off, score, strict=True)]


def _block(az: np.ndarray, place: np.ndarray, own: np.ndarray, w: np.ndarray, h: np.ndarray, scale: float, n_az: int) -> dict | None:
    """What a block keeps. az, place: of its rows in order of place, halo included; own: which are not of the halo; w: their windows (row, offset, sample)."""
    ncc, msd = both_scores(w, h, scale)
    score = 0.5 * ncc + 0.5 * msd
    offs = score.shape[1]
    flat = np.where(np.isfinite(score), score, -np.inf)
    some = np.isfinite(flat) & own[:, None]
    if not some.any():
        return None
    row, off = np.nonzero(some)
    value = flat[row, off]
    # rows that stand next to each other only where no azimuth is missing between them; a halo cut by few rows is filled with nothing
    dense = np.full((ROWS + 2 * HALO, offs), -np.inf)
    dense[place + HALO] = flat

    def tops(radius: int) -> np.ndarray:
        edge = np.full((radius, len(dense)), -np.inf)
        wide = _spread(np.concatenate([np.full((radius, offs), -np.inf), dense, np.full((radius, offs), -np.inf)]), radius)
        wide = _spread(np.concatenate([edge, wide.T, edge]), radius).T
        return flat == wide[place + HALO]

    def cell(i: int, o: int) -> dict:
        p = place[i] + HALO
        beside = lambda q, c: float(dense[q, c]) if 0 <= q < len(dense) and 0 <= c < offs and np.isfinite(dense[q, c]) else float("nan")
        return {"az": int(az[i]), "off": int(o), "score": float(flat[i, o]), "ncc": float(ncc[i, o]), "msd": float(msd[i, o]), "a0": beside(p - 1, o), "a1": beside(p + 1, o), "o0": beside(p, o - 1), "o1": beside(p, o + 1)}

    at = _first(value, az[row], off, 1)[0]
    best, peak = cell(row[at], off[at]), float(value[at])
    near = (np.abs(place - place[row[at]]) <= QUALITY[0])[:, None] & (np.abs(np.arange(offs) - off[at]) <= QUALITY[1])[None] & np.isfinite(flat)
    ni, no = np.nonzero(near)
    # with few azimuths a halo holds a row twice
    _, once = np.unique(az[ni].astype(np.int64) * offs + no, return_index=True)
    ni, no = ni[once], no[once]
    high = _first(value, az[row], off, _NEAR + 1)
    maxima = np.nonzero(tops(CANDIDATE) & some)
    ci = _first(flat[maxima], az[maxima[0]], maxima[1], TOP)
    ri, ro = np.nonzero(tops(RIVAL) & some & (flat >= peak - max(abs(peak) * 0.2, 1e-9)))
    return {
        "n_az": n_az, "cells": len(value), "total": float(value.sum()), "squares": float((value * value).sum()), "best": best, "around": _places(az[ni], no, flat[ni, no]), "highest": _places(az[row[high]], off[high], value[high]),
        "candidates": [cell(maxima[0][i], maxima[1][i]) for i in ci], "rivals": _places(az[ri], ro, flat[ri, ro]),
    }


def _rank(c: dict) -> tuple:
    return -c["score"], c["az"], c["off"]


def _folded(parts: list[dict]) -> dict:
    """What several blocks keep, as of one."""
    first = min(parts, key=lambda p: _rank(p["best"]))
    peak = first["best"]["score"]
    least = peak - max(abs(peak) * 0.2, 1e-9)
    join = lambda name, most: sorted((c for p in parts for c in p[name]), key=_rank)[:most]
    return {
        "n_az": first["n_az"], "cells": sum(p["cells"] for p in parts), "total": math.fsum(p["total"] for p in parts), "squares": math.fsum(p["squares"] for p in parts), "best": first["best"], "around": list(first["around"]),
        "highest": join("highest", _NEAR + 1), "candidates": join("candidates", TOP), "rivals": [c for p in parts for c in p["rivals"] if c["score"] >= least],
    }


def _result(p: dict, offs: int, step_m: float) -> dict:
    """The match's figures."""
    b, n = p["best"], p["n_az"]
    near = lambda c, zone: _way(c["az"], b["az"], n) <= zone[0] and abs(c["off"] - b["off"]) <= zone[1]
    peak = b["score"]
    outside = lambda zone: next((c["score"] for c in p["highest"] if not near(c, zone)), None)
    inside = [c["score"] for c in p["around"]]
    count = p["cells"] - len(inside)
    mean = (p["total"] - math.fsum(inside)) / count if count else 0.0
    sd = math.sqrt(max((p["squares"] - math.fsum(x * x for x in inside)) / count - mean * mean, 0.0)) if count else 0.0
    to_side = peak / max(sd, 1e-9)
    side, lobe = outside(QUALITY), outside(LOBE)
    pslr = 0.0 if peak <= 0 else 20 * math.log10(max(peak, 1e-10) / max(abs(1e-10 if lobe is None else lobe), 1e-10))
    others = [c for c in p["rivals"] if (c["az"], c["off"]) != (b["az"], b["off"])]
    far = [math.hypot((c["off"] - b["off"]) * step_m, float(_way(c["az"], b["az"], n)) * (step_m * offs * math.pi / 180)) for c in others]
    ambiguous = pslr < 3 or len(others) + 1 > 2

    def placed(c: dict) -> dict:
        return {"az_sub": (c["az"] + vertex(c["a0"], c["score"], c["a1"])[0]) % n, "off_sub": min(max(c["off"] + vertex(c["o0"], c["score"], c["o1"])[0], 0.0), offs - 1.0)}

    figures = ("az", "off", "score", "ncc", "msd")
    return {
        **{k: b[k] for k in figures}, **placed(b), "curve_off": vertex(b["o0"], peak, b["o1"])[1], "curve_az": vertex(b["a0"], peak, b["a1"])[1], "confidence": peak if side is None else max(peak - side, 0.0), "to_side": to_side, "to_mean": peak / max(abs(p["total"] / p["cells"]), 1e-9),
        "reliable": peak >= 0.5 and to_side >= 1.3 and not ambiguous, "pslr_db": pslr, "n_peaks": len(others) + 1, "isolation_m": min(far, default=None), "ambiguous": ambiguous, "candidates": [{k: c[k] for k in figures} | placed(c) for c in p["candidates"]],
    }


def full_match(reference: DataFrame, measured: DataFrame, scale: float, step_m: float) -> DataFrame:
    """One row (RESULT): the match of a measured profile h (one row, complete) with reference rows (az: 0, 1, ... once each, around; profile: complete, of one length).

    Of equal cells the least az, then off, is the peak. Confidence and to_side compare the peak with what lies more than 5 azimuths or 3
    offsets from it, pslr_db with what lies more than 3 from it. Rivals are 7 by 7 maxima within a fifth of the peak, candidates the eight
    strongest 5 by 5 maxima. curve_off and curve_az are second differences (0: unknown). No reference row gives no result.
    """
    parts = int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.broadcast(reference.agg(F.count(F.lit(1)).alias("n_az")))
    az, home = F.col("az").cast("bigint"), F.floor(F.col("az") / ROWS)
    last = F.floor((F.col("n_az") - 1) / ROWS)

    def visits(d: int) -> list[Column]:
        """The places before the first and after the last row of the d-th block from a row's own, around the end; null where they are beyond the halo."""
        there = F.pmod(home + d, last + 1)
        first = there * ROWS
        length = F.least(F.lit(ROWS).cast("bigint"), F.col("n_az") - first)
        back, ahead = F.pmod(first - 1 - az, F.col("n_az")) + 1, F.pmod(az - (first + length), F.col("n_az"))
        at = lambda place: F.struct(there.alias("block"), place.cast("int").alias("place"))
        return [F.when(back <= HALO, at(-back)), F.when(ahead < HALO, at(length + ahead))]

    # blocks next but one count too, as the last block may be shorter than a halo
    every = F.array(F.struct(home.alias("block"), (az - home * ROWS).cast("int").alias("place")), *(v for d in range(-2, 3) for v in visits(d)))
    dealt = reference.select("az", "profile").crossJoin(n).withColumn("at", F.explode(F.array_distinct(F.filter(every, lambda x: x.isNotNull())))).select("at.*", "az", "n_az", "profile")
    given = dealt.crossJoin(F.broadcast(measured.select("h")))

    def keep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        h = np.asarray(rows["h"].iloc[0], float)
        profiles = np.stack([np.asarray(x, float) for x in rows["profile"]])
        w = np.lib.stride_tricks.sliding_window_view(profiles, len(h), axis=1)
        az, place = rows["az"].to_numpy(), rows["place"].to_numpy()
        got = _block(az, place, (place >= 0) & (place < ROWS) & (az == int(key[0]) * ROWS + place), w, h, scale, int(rows["n_az"].iloc[0]))
        return pd.DataFrame([{"part": int(key[0]) // FOLD, **got}] if got else [], columns=_NAMES)

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"part": 0, **_folded([_plain(r) for r in rows.to_dict("records")])}], columns=_NAMES)

    offs = measured.select(F.size("h").alias("k"))
    kept = given.repartition(parts, "block").groupBy("block").applyInPandas(keep, _PART)
    folded = kept.groupBy("part").applyInPandas(fold, _PART)

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p = _folded([_plain(r) for r in rows.to_dict("records")])
        return pd.DataFrame([_result(p, int(rows["offs"].iloc[0]), step_m)])

    length = reference.agg(F.max(F.size("profile")).alias("m")).crossJoin(offs).select((F.col("m") - F.col("k") + 1).alias("offs"))
    return folded.crossJoin(F.broadcast(length)).groupBy("part").applyInPandas(finish, RESULT)


def _plain(row: dict) -> dict:
    """A row of parts with its arrays as lists of dicts."""
    return {k: [dict(x) for x in v] if isinstance(v, np.ndarray | list) else v for k, v in row.items()}
