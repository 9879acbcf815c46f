"""Kernels that may fail: rows that can't be worked on are set aside with the cause, and the others go on.

A batch is tried as a whole; only one that fails is halved until the rows that fail stand alone. So a table without bad rows costs
nothing more, and each bad row some calls more by the logarithm of its batch. Where bad rows are many, a kernel tells them by refuse:
then all that it refuses for one cause cost one call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a cause that are kept.
CAUSE = 500


class Guarded(NamedTuple):
    """What a kernel gave, and the rows that it failed on: as they were, with cause."""

    good: DataFrame
    bad: DataFrame


class Refused(Exception):
    """What a kernel tells of rows that it can't work on: which of its rows, and why."""

    def __init__(self, rows: np.ndarray, why: Exception):
        super().__init__(str(why))
        self.rows, self.why = rows, why


def refuse(rows: pd.Series, why: Exception) -> None:
    """Ends a kernel's call if any of its rows is marked; the marked ones are set aside with the cause, the others tried again."""
    marked = rows.to_numpy(bool)
    if marked.any():
        raise Refused(marked, why)


def _cause(e: Exception) -> str:
    e = e.why if isinstance(e, Refused) else e
    return f"{type(e).__name__}: {e}"[:CAUSE]


def _tried(rows: pd.DataFrame, each: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, str | None]]:
    """(result, None) of parts of rows in their order, (rows, cause) of those that were refused, (row, cause) of those that fail alone."""
    try:
        yield each(rows.reset_index(drop=True)), None
    except Exception as e:  # noqa: BLE001  whatever it is, it is told beside the row
        if len(rows) == 1:
            yield rows, _cause(e)
        elif isinstance(e, Refused) and len(e.rows) == len(rows) and e.rows.any():
            yield rows[e.rows], _cause(e)
            if not e.rows.all():
                yield from _tried(rows[~e.rows], each)
        else:
            half = len(rows) // 2
            yield from _tried(rows.iloc[:half], each)
            yield from _tried(rows.iloc[half:], each)


def guarded(df: DataFrame, each: Callable[[pd.DataFrame], pd.DataFrame], schema: str, written: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> Guarded:
    """each(rows) over batches of df, or over whole groups of equal keys; a result has the columns of schema.

    Without keys each row stands for itself: each must give for rows what it gives for them one by one. With keys a group fails as a
    whole, and all its rows are set aside with its cause. Nothing is lost: every row of df went into good or is in bad. An empty table
    gives two empty ones. written(frame) stores a frame where all executors find it and returns it as read again (as a scratch table
    does), so that each row is worked on once however often the two results are read.
    """
    names, own = [x.split()[0].rstrip(":").strip("`") for x in schema.split(", ")], df.columns
    kinds = [x.split(None, 1)[1] for x in schema.split(", ")]
    # both results side by side, flat: columns of a batch move as they are
    table = ", ".join([*(f"`good {c}` {t}" for c, t in zip(names, kinds, strict=True)), *(f"`bad {c}` {t}" for c, t in df.dtypes), "cause string"])

    def beside(good: pd.DataFrame | None, bad: pd.DataFrame | None, cause: list | None) -> pd.DataFrame:
        n = len(bad if good is None else good)
        column = lambda x, c: pd.Series([None] * n, dtype=object) if x is None else x[c].reset_index(drop=True)
        return pd.DataFrame({**{f"good {c}": column(good, c) for c in names}, **{f"bad {c}": column(bad, c) for c in own}, "cause": pd.Series([None] * n if cause is None else cause, dtype=object)})

    def told(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        good: dict[tuple, list[pd.DataFrame]] = {}
        bad, causes = [], []
        for got, cause in [(rows, None)] if rows.empty else (_group(rows) if keys else _tried(rows, each)):
            if got.empty:
                continue
            if cause is None:
                # parts of other types are not put together: whole numbers would become floating ones
                good.setdefault(tuple(map(str, got[names].dtypes)), []).append(got[names])
            else:
                bad.append(got)
                causes += [cause] * len(got)
        for parts in good.values():
            yield beside(pd.concat(parts), None, None)
        if bad:
            yield beside(None, pd.concat(bad), causes)

    def _group(rows: pd.DataFrame) -> list[tuple[pd.DataFrame, str | None]]:
        try:
            return [(each(rows.reset_index(drop=True)), None)]
        except Exception as e:  # noqa: BLE001
            return [(rows, _cause(e))]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield from told(rows)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        # a group is good or bad as a whole
        return next(told(rows), beside(rows.iloc[:0].reindex(columns=names), None, None))

    both = written(df.groupBy(*keys).applyInPandas(group, table) if keys else df.mapInPandas(batches, table))
    return Guarded(both.where("cause is null").select(*(F.col(f"`good {c}`").alias(c) for c in names)), both.where("cause is not null").select(*(F.col(f"`bad {c}`").alias(c) for c in own), F.col("cause")))
