"""Whitening of vectors by the eigenvectors of their covariance.

Vectors become whole numbers, so sums and deviations are exact: a row is centred as n * x - S, a whole number, before anything is
rounded. The covariance is the Gramian matrix of the centred rows over n, of Spark's RowMatrix; it has one row and column for each
dimension, whatever the rows, and its eigenvectors are found on the driver and sent to the tasks, which project the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, short_batches

#: An entry c becomes floor(SCALE * c) + SHIFT; so many components at most.
SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
#: Entries are held within this bound, far from where longs end.
_MOST = float(1 << 61)
#: Directions whose share of all variance is below this have none but rounding's.
LEAST_SHARE = 1e-12


class Sums(NamedTuple):
    n: int
    #: Of each dimension, and the greatest absolute entry.
    totals: list[int]
    most: int


class Basis(NamedTuple):
    #: Falling eigenvalues and their unit eigenvectors as columns; the sum of all eigenvalues.
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """id and x (array<bigint>) of the rows that can be whitened: those of the most frequent length among vectors without nulls, NaN or infinite entries."""
    entries = F.col(vector).cast("array<double>")
    fit = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled: Column = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(_MOST)), F.lit(-_MOST))) + SHIFT)
    rows = vectors.where(fit & (F.size(vector) > 0)).select(F.col(id).alias("id"), scaled.alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (length.d if length else 0))


def sums(rows: DataFrame) -> Sums:
    """Exact sums of x by dimension: the high and the low 32 bits are added apart, so that no sum overflows."""
    each = rows.select(F.posexplode("x").alias("k", "x"))
    got = each.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("x", 32)).alias("high"), F.sum(F.col("x").bitwiseAND((1 << 32) - 1)).alias("low"), F.max(F.abs("x")).alias("most")).orderBy("k").collect()
    return Sums(got[0].n if got else 0, [(r.high << 32) + r.low for r in got], max((r.most for r in got), default=0))


def deviations(x: np.ndarray, s: Sums) -> np.ndarray:
    """n * x - S of the rows of x, exactly: as longs where they can't overflow, else as Python's whole numbers."""
    wide = s.n * s.most + max(map(abs, s.totals)) >= 1 << 62
    if wide:
        return x.astype(object) * s.n - np.array(s.totals, object)
    return x * s.n - np.array(s.totals, np.int64)


def squared(d: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows of d, exactly; None for one that no long holds."""
    most = int(np.abs(d).max(initial=0))
    if most**2 * d.shape[1] < 1 << 63:
        return (d.astype(np.int64) ** 2).sum(axis=1).tolist()
    exact = (d.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def centred(d: np.ndarray, n: int) -> np.ndarray:
    """d / n, each entry rounded once."""
    return d.astype(float) / n if d.dtype != object else np.array([[int(v) / n for v in row] for row in d])


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The Gramian matrix of a column of array<double>, all of one length."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def basis(rows: DataFrame, s: Sums) -> Basis:
    """The eigenvectors of the covariance of rows (id, x); those without variance are left out."""

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"c": list(centred(deviations(_stacked(batch["x"]), s), s.n))})

    covariance = gramian(rows.select("x").mapInPandas(centre, "c array<double>"), "c") / s.n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    kept = values > LEAST_SHARE * trace
    return Basis(values[kept], vectors[:, kept], trace)


def project(rows: DataFrame, s: Sums, b: Basis, most: int = COMPONENTS) -> DataFrame:
    """rows (id, x) as id, deviation (the sum over dimensions of (n * x - S)**2; null where no long holds it) and w (array<double>, the whitened components)."""
    spark: SparkSession = rows.sparkSession
    sent = spark.sparkContext.broadcast((s, b.vectors[:, :most] / np.sqrt(b.values[:most])))
    id_type = rows.schema["id"].dataType.simpleString()

    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, weights = sent.value
        for batch in batches:
            if len(batch):
                d = deviations(_stacked(batch["x"]), s)
                yield pd.DataFrame({"id": batch["id"], "deviation": pd.array(squared(d), "Int64"), "w": list(centred(d, s.n) @ weights)})

    return rows.mapInPandas(whiten, f"id {id_type}, deviation bigint, w array<double>")


def identity_error(whitened: DataFrame, n: int) -> float:
    """The largest absolute entry of the covariance of w, centred before multiplying, minus the identity."""
    means = [r.mean for r in whitened.select(F.posexplode("w").alias("k", "w")).groupBy("k").agg((F.sum("w") / n).alias("mean")).orderBy("k").collect()]
    mean = F.array(*map(F.lit, means))
    covariance = gramian(whitened.select(F.zip_with("w", mean, lambda x, m: x - m).alias("c")), "c") / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(vectors: DataFrame, scratch: Scratch, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The components of the rows of vectors whose covariance is the identity, for each row up to `components` of largest variance.

    Entries c become whole numbers x = floor(1024 * c) + 100000 (held within 2**61). Rows whose vector is null or empty or holds a
    null, NaN or infinite entry are dropped, and so are those of another length than most. All others, repeated rows and ids
    included, are fitted and returned; null ids stay null.

    Returns id, component (from 1, by falling variance), n (rows fitted), deviation (the sum over dimensions of (n * x - S)**2, S the
    sums by dimension; null where no long holds it), whitened (the centred row on the component over the root of its variance), explained
    (the component's share of all variance), identity_error (of the whitened rows' covariance). Components without variance are
    left out, so one row, or rows that are all alike, give none; nor does an empty table. Components of equal variance are any basis
    of their space. Signs are the same for all rows. Other columns are not read.
    """
    columns = f"{id} {vectors.schema[id].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    none = vectors.sparkSession.createDataFrame([], columns)
    with short_batches(vectors.sparkSession, 4096):
        rows = whole(vectors, id, vector)
        s = sums(rows)
        if not s.n:
            return none
        b = basis(rows, s)
        if not len(b.values):
            return none
        whitened = scratch.write(project(rows, s, b, components), "whitened")
    error = identity_error(whitened, s.n)
    shares = F.array(*(F.lit(float(v / b.trace)) for v in b.values[:components]))
    found = whitened.select(F.col("id").alias(id), "deviation", F.posexplode("w").alias("k", "whitened"))
    return found.select(id, (F.col("k") + 1).cast("int").alias("component"), F.lit(s.n).cast("bigint").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))
