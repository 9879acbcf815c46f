"""Template matching: a measured profile against every reference row and offset, and what the heatmap says.

References are rows (az, profile); a heatmap is rows (az, off, score, ...). Scores are made within a reference row by array
functions, so matching moves no data: the measured windows, whose number the caller bounds, are sent along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("ncc", "msd", "hybrid")


def combine(metric: str, ncc: Column, msd: Column, alpha: float = 0.5, beta: float = 0.5) -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if metric != "hybrid":
        return ncc if metric == "ncc" else msd
    total = alpha + beta
    return (ncc + msd) / 2 if total <= 1e-12 else (ncc * alpha + msd * beta) / total


def heatmap(reference: DataFrame, measured: DataFrame, scale: float = 100.0, max_offset: int | None = None, least_valid: float = 0.5, metric: str = "hybrid", alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """Scores of all offsets of a measured profile h along each reference profile.

    reference: az, profile (array, null for no data); measured: h, and any columns that name it (kept). Only pairs where both are
    there count: ncc is their correlation (0 for under two pairs or a flat side), msd 1 / (1 + mean square / scale); the score
    combines them and is null where the share of pairs is under least_valid.
    """
    keep = [c for c in measured.columns if c != "h"]
    both = reference.crossJoin(F.broadcast(measured)).withColumn("n", F.size("h"))
    top = F.size("profile") - F.col("n")
    if max_offset is not None:
        top = F.least(top, F.lit(max_offset))
    cells = both.where(top >= 0).withColumn("off", F.explode(F.sequence(F.lit(0), top)))
    pairs = F.filter(F.arrays_zip(F.slice("profile", F.col("off") + 1, F.col("n")).alias("r"), F.col("h").alias("m")), lambda x: x["r"].isNotNull() & x["m"].isNotNull())

    def scores(p: Column) -> Column:
        k = F.size(p)
        mean = lambda f: F.aggregate(p, F.lit(0.0), lambda a, x: a + x[f]) / k
        return let(F.struct(k.alias("k"), F.when(k > 0, mean("r")).alias("r"), F.when(k > 0, mean("m")).alias("m")), lambda c: let(sums(p, c), lambda s: result(c["k"], s)))

    def sums(p: Column, c: Column) -> Column:
        zero = F.struct(*(F.lit(0.0).alias(f) for f in ("rm", "rr", "mm", "d")))

        def add(a: Column, x: Column) -> Column:
            r, m, d = x["r"] - c["r"], x["m"] - c["m"], x["r"] - x["m"]
            return F.struct((a["rm"] + r * m).alias("rm"), (a["rr"] + r * r).alias("rr"), (a["mm"] + m * m).alias("mm"), (a["d"] + d * d).alias("d"))

        return F.aggregate(p, zero, add)

    def result(k: Column, s: Column) -> Column:
        spread = F.sqrt(s["rr"] / k) * F.sqrt(s["mm"] / k)
        ncc = F.when((k < 2) | (spread <= 1e-12), 0.0).otherwise(s["rm"] / k / spread)
        msd = F.when(k < 2, 0.0).otherwise(1 / (1 + s["d"] / k / scale))
        return F.struct(ncc.alias("ncc"), msd.alias("msd"), (k / F.col("n")).alias("valid_fraction"))

    cells = cells.select("az", "off", *keep, let(pairs, scores).alias("x")).select("az", "off", *keep, "x.*")
    return cells.withColumn("score", F.when(F.col("valid_fraction") >= least_valid, combine(metric, F.col("ncc"), F.col("msd"), alpha, beta)))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it and wherever the planner moves it."""
    return F.transform(F.array(value), body)[0]


def best(cells: DataFrame, n: int = 1) -> DataFrame:
    """The n cells of best score; of equals the least az, then off."""
    # the filter comes after the limit: before it, it would be moved below and score everything twice
    return cells.orderBy(F.desc_nulls_last("score"), "az", "off").limit(n).where("score is not null")


#: Azimuths of one block of a heatmap: windows around the axis are cut into blocks, so that tasks grow with the azimuths.
BLOCK = 256


def _blocks(cells: DataFrame, radius: int, n_az: int) -> DataFrame:
    """Cells dealt to blocks of azimuths: _b, _z (the azimuth, continued beyond the ends for cells of a halo) and _own. Each block also has the cells of radius azimuths on both sides, around the ends."""
    az = F.col("az").cast("int")
    # the first and last rows are repeated beyond the other end
    shifts = F.filter(F.array(F.lit(0), F.when(az < radius, F.lit(n_az)), F.when(az >= n_az - radius, F.lit(-n_az))), lambda x: x.isNotNull())
    homes = lambda z: F.array_distinct(F.array(F.floor((z - radius) / BLOCK), F.floor(z / BLOCK), F.floor((z + radius) / BLOCK)))
    at = F.flatten(F.transform(shifts, lambda s: F.transform(homes(az + s), lambda b: F.struct((az + s).alias("_z"), b.cast("int").alias("_b"), ((s == 0) & (b == F.floor(az / BLOCK))).alias("_own")))))
    return cells.withColumn("_at", F.explode(at)).select("*", "_at.*").drop("_at")


def local_maxima(cells: DataFrame, radius: int, n_az: int) -> DataFrame:
    """Cells that no cell within radius tops, az around in n_az steps, off cut at the ends; plateaus count as a whole. Two window passes, one along each axis, the second within blocks of azimuths."""
    along = W.partitionBy("az").orderBy("off").rowsBetween(-radius, radius)
    rows = cells.withColumn("_m", F.max("score").over(along))
    around = W.partitionBy("_b", "off").orderBy("_z").rangeBetween(-radius, radius)
    return _blocks(rows, radius, n_az).withColumn("_top", F.max("_m").over(around)).where("_own and score is not null and score = _top").drop("_m", "_z", "_b", "_own", "_top")


def vertex(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """(shift of the peak of a parabola through three values, at most half a step; second difference). No shift for a straight line or a missing neighbour."""
    d = a - b * 2 + c
    shift = F.greatest(F.least((a - c) * 0.5 / d, F.lit(0.5)), F.lit(-0.5))
    return F.coalesce(F.when(F.abs(d) >= 1e-12, shift), F.lit(0.0)), F.coalesce(F.when(F.abs(d) >= 1e-12, d), F.lit(0.0))


def with_neighbours(cells: DataFrame, n_az: int) -> DataFrame:
    """Adds the scores before and after each cell along off (null at the ends) as o0, o1 and around az as a0, a1 (within blocks of azimuths)."""
    along, around = W.partitionBy("az").orderBy("off"), W.partitionBy("_b", "off").orderBy("_z")
    rows = cells.withColumns({"o0": F.lag("score").over(along), "o1": F.lead("score").over(along)})
    dealt = _blocks(rows, 1, n_az).withColumns({"a0": F.lag("score").over(around), "a1": F.lead("score").over(around)})
    return dealt.where("_own").drop("_z", "_b", "_own")


def sigma(curvature: Column) -> Column:
    """A spread from the peak's curvature; null (unknown) where it does not curve down."""
    return F.when(curvature < -1e-12, 0.5 / F.sqrt(-curvature))


def similarity(a: Column, b: Column, n: int) -> Column:
    """Cosine of two arrays of n values under a raised-cosine window; 0 if one has no length."""
    hann = lambda i: 0.5 - 0.5 * F.cos(i * (2 * 3.141592653589793 / (n - 1)))
    dot = lambda x, y: F.aggregate(F.zip_with(F.transform(x, lambda v, i: v * hann(i)), F.transform(y, lambda v, i: v * hann(i)), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length <= 1e-12, 0.0).otherwise(dot(a, b) / length)
