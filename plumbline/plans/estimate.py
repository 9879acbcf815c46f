"""Covariances, fusion, filters and particles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import angles
from plumbline.operators import filters, inertial, raster

from .base import SAMPLES_SQL, track_order, Plans, r6, rounded, samples, table
from .raster import BILINEAR_SQL, GRID_SQL, tiles

plans = Plans()

_COV = f"""{SAMPLES_SQL}, raw AS (SELECT event_id, user_id, ts, heading, CASE WHEN event_id % 4 <> 0 THEN 5 + (event_id % 50)::DOUBLE END AS sa, CASE WHEN event_id % 3 <> 0 THEN 20 + (event_id % 70)::DOUBLE END AS sx, (event_id * 7 % 100)::DOUBLE / 100 AS peak, event_id % 6 <> 0 AS informative FROM samples),
s AS (SELECT *, coalesce(sa, greatest(150 * (1 - peak), 1)) * CASE WHEN informative THEN 1 ELSE 5 END AS a, coalesce(sx, greatest(coalesce(sa, greatest(150 * (1 - peak), 1)), 25)) * CASE WHEN informative THEN 1 ELSE 5 END AS x FROM raw),
c AS (SELECT *, power(sin(radians(heading)) * a, 2) + power(cos(radians(heading)) * x, 2) AS ee, sin(radians(heading)) * cos(radians(heading)) * (a * a - x * x) AS en, power(cos(radians(heading)) * a, 2) + power(sin(radians(heading)) * x, 2) AS nn FROM s)"""


def covariances(spark, sf_dir):
    """East-north covariance of a fix from its spreads along and across its bearing, with stand-ins where these are unknown."""
    i, s = F.col("event_id"), samples(spark, sf_dir)
    sa = F.when(i % 4 != 0, (i % 50 + 5).cast("double"))
    sx = F.when(i % 3 != 0, (i % 70 + 20).cast("double"))
    wide = F.when(i % 6 != 0, 1.0).otherwise(5.0)
    along = F.coalesce(sa, F.greatest((1 - (i * 7 % 100).cast("double") / 100) * 150, F.lit(1.0)))
    s = s.select("event_id", "user_id", "ts", "heading", "speed", (along * wide).alias("a"), (F.coalesce(sx, F.greatest(along, F.lit(25.0))) * wide).alias("x"))
    sin, cos, a2, x2 = F.sin(F.radians("heading")), F.cos(F.radians("heading")), F.col("a") * F.col("a"), F.col("x") * F.col("x")
    return s.withColumns({"ee": sin * sin * a2 + cos * cos * x2, "en": sin * cos * (a2 - x2), "nn": cos * cos * a2 + sin * sin * x2})


@plans.add("position_covariance", f"WITH {_COV} SELECT event_id, round(ee, 4) AS ee, round(en, 4) AS en, round(nn, 4) AS nn, round(sqrt(greatest(ee + nn, 0)), 5) AS hdop FROM c")
def position_covariance(spark, sf_dir):
    return covariances(spark, sf_dir).select("event_id", *(F.round(c, 4).alias(c) for c in ("ee", "en", "nn")), F.round(F.sqrt(F.greatest(F.col("ee") + F.col("nn"), F.lit(0.0))), 5).alias("hdop"))


@plans.add("covariance_ellipse", f"""WITH {_COV}, e AS (SELECT event_id, greatest((ee + nn) / 2 + sqrt(power((ee - nn) / 2, 2) + en * en), 1e-6) AS l1, greatest((ee + nn) / 2 - sqrt(power((ee - nn) / 2, 2) + en * en), 1e-6) AS l2, CASE WHEN sqrt(power(ee - nn, 2) + power(2 * en, 2)) <= 1e-9 * (ee + nn) THEN 0 ELSE 0.5 * atan2(2 * en, ee - nn) END AS th FROM c)
SELECT event_id, s::INT AS sigma, k::INT AS k, round(s * (sqrt(l1) * cos(2 * pi() * k / 79) * cos(th) - sqrt(l2) * sin(2 * pi() * k / 79) * sin(th)), 4) AS east, round(s * (sqrt(l1) * cos(2 * pi() * k / 79) * sin(th) + sqrt(l2) * sin(2 * pi() * k / 79) * cos(th)), 4) AS north
FROM e, generate_series(1, 2) a(s), generate_series(0, 79) b(k)""")
def covariance_ellipse(spark, sf_dir, points: int = 80):
    """Outlines of every sample at one and two sigma, from the closed form of a two by two eigenproblem."""
    mid, half = (F.col("ee") + F.col("nn")) / 2, F.sqrt(F.pow((F.col("ee") - F.col("nn")) / 2, F.lit(2.0)) + F.col("en") * F.col("en"))
    # a circle up to rounding has no long axis: its outline begins in the east
    angle = F.when(F.hypot(F.col("ee") - F.col("nn"), F.col("en") * 2) <= (F.col("ee") + F.col("nn")) * 1e-9, 0.0).otherwise(F.atan2(F.col("en") * 2, F.col("ee") - F.col("nn")) * 0.5)
    e = covariances(spark, sf_dir).select("event_id", F.greatest(mid + half, F.lit(1e-6)).alias("l1"), F.greatest(mid - half, F.lit(1e-6)).alias("l2"), angle.alias("th"))
    # what doesn't change along an outline is worked out once for a sample, and the steps around it are constants
    e = e.select("event_id", F.sqrt("l1").alias("long"), F.sqrt("l2").alias("short"), F.cos("th").alias("cos"), F.sin("th").alias("sin"))
    steps = [F.struct(F.lit(sigma).alias("sigma"), F.lit(k).alias("k"), F.lit(math.cos(2 * math.pi * k / (points - 1))).alias("c"), F.lit(math.sin(2 * math.pi * k / (points - 1))).alias("s")) for sigma in (1, 2) for k in range(points)]
    e = e.select("*", F.inline(F.array(*steps)))
    u, v = F.col("long") * F.col("c"), F.col("short") * F.col("s")
    return e.select("event_id", "sigma", "k", rounded(F.col("sigma") * (u * F.col("cos") - v * F.col("sin")), 4).alias("east"), rounded(F.col("sigma") * (u * F.col("sin") + v * F.col("cos")), 4).alias("north"))


_KIND = "CASE event_type WHEN 'view' THEN 'lidar' WHEN 'click' THEN 'radar_alt' WHEN 'error' THEN 'radar' WHEN 'purchase' THEN 'baro' ELSE 'doppler' END"
_NOISE = f"""{SAMPLES_SQL}, k AS (SELECT event_id, value, {_KIND} AS kind, greatest(least((event_id % 120)::DOUBLE / 100, 1), 0.001) AS q, 1 + abs((event_id % 61) - 30)::DOUBLE / 30 AS roll, event_id % 7 IN (0, 1, 2) AS wet FROM samples),
n AS (SELECT *, CASE kind WHEN 'lidar' THEN CASE WHEN wet THEN 8 ELSE 1 END * roll / q WHEN 'radar_alt' THEN 3 * roll / q WHEN 'radar' THEN 5 * roll / q WHEN 'baro' THEN 8 / q WHEN 'doppler' THEN 1.5 * roll / q END AS sigma FROM k)"""


def noise(spark, sf_dir):
    """The spread of a reading by the kind of its sensor, its quality, the roll, and what lies below."""
    i = F.col("event_id")
    kind = F.col("event_type")
    k = samples(spark, sf_dir).select("event_id", "value", F.when(kind == "view", "lidar").when(kind == "click", "radar_alt").when(kind == "error", "radar").when(kind == "purchase", "baro").otherwise("doppler").alias("kind"), F.greatest(F.least((i % 120).cast("double") / 100, F.lit(1.0)), F.lit(0.001)).alias("q"), (F.abs(i % 61 - 30).cast("double") / 30 + 1).alias("roll"), (i % 7).isin(0, 1, 2).alias("wet"))
    #: Metres of spread of a good reading.
    base = {"lidar": F.when(F.col("wet"), 8.0).otherwise(1.0) * F.col("roll"), "radar_alt": F.col("roll") * 3.0, "radar": F.col("roll") * 5.0, "baro": F.lit(8.0), "doppler": F.col("roll") * 1.5}
    sigma = F.coalesce(*(F.when(F.col("kind") == name, v / F.col("q")) for name, v in base.items()))
    return k.withColumn("sigma", sigma)


@plans.add("adaptive_noise", f"WITH {_NOISE} SELECT event_id, kind, round(sigma, 5) AS sigma, CASE WHEN kind = 'doppler' THEN 2.0::DOUBLE END AS sigma_up FROM n")
def adaptive_noise(spark, sf_dir):
    return noise(spark, sf_dir).select("event_id", "kind", F.round("sigma", 5).alias("sigma"), F.when(F.col("kind") == "doppler", 2.0).alias("sigma_up"))


_DET = "(a * b * c + 2 * d * e * f - a * f * f - b * e * e - c * d * d)"
_QUAD = f"((b * c - f * f) * x * x + (a * c - e * e) * y * y + (a * b - d * d) * z * z + 2 * ((e * f - d * c) * x * y + (d * f - b * e) * x * z + (d * e - a * f) * y * z)) / {_DET}"
_GATE = f"""{_NOISE}, g AS (SELECT event_id, kind, value / 50 AS x, (event_id % 13)::DOUBLE - 6 AS y, (event_id % 9)::DOUBLE - 4 AS z, sigma * sigma + 1 + 1e-9 AS a, sigma * sigma + 2 + 1e-9 AS b, 4 + 1 + 1e-9 AS c, 0.3::DOUBLE AS d, 0.2::DOUBLE AS e, 0.1::DOUBLE AS f FROM n),
t AS (SELECT event_id, kind, CASE WHEN kind = 'doppler' THEN {_QUAD} ELSE x * x / a END AS metric FROM g)"""


@plans.add("chi2_gate", f"WITH {_GATE} SELECT event_id, round(metric, 5) AS metric, metric <= CASE WHEN kind = 'doppler' THEN 11.34 ELSE 6.63 END AS accepted FROM t")
def chi2_gate(spark, sf_dir, one: float = 6.63, three: float = 11.34):
    """Innovations against their spread: one component, or three by the adjugate of a symmetric matrix."""
    i, s2 = F.col("event_id"), F.col("sigma") * F.col("sigma")
    g = noise(spark, sf_dir).select("event_id", "kind", (F.col("value") / 50).alias("x"), ((i % 13).cast("double") - 6).alias("y"), ((i % 9).cast("double") - 4).alias("z"), (s2 + 1 + 1e-9).alias("a"), (s2 + 2 + 1e-9).alias("b"), F.lit(4 + 1 + 1e-9).alias("c"), F.lit(0.3).alias("d"), F.lit(0.2).alias("e"), F.lit(0.1).alias("f"))
    metric = F.when(F.col("kind") == "doppler", F.expr(_QUAD)).otherwise(F.col("x") * F.col("x") / F.col("a"))
    return g.select("event_id", "kind", metric.alias("m")).select("event_id", F.round("m", 5).alias("metric"), (F.col("m") <= F.when(F.col("kind") == "doppler", three).otherwise(one)).alias("accepted"))


_FUSE = f"""{SAMPLES_SQL}, f AS (SELECT user_id, value AS px, lat AS vx, lon AS vy, 1.0::DOUBLE AS q0, (event_id % 7)::DOUBLE / 10 AS q1, (event_id % 5)::DOUBLE / 10 AS q2, (event_id % 3)::DOUBLE / 10 AS q3, 1 / greatest((event_id % 50)::DOUBLE, 1e-6) AS w FROM samples),
u AS (SELECT user_id, px, vx, vy, w, q0 / n AS q0, q1 / n AS q1, q2 / n AS q2, q3 / n AS q3 FROM (SELECT *, sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) AS n FROM f)),
s AS (SELECT user_id, sum(w * px) / sum(w) AS px, sum(w * vx) / sum(w) AS vx, sum(w * vy) / sum(w) AS vy, sum(w * q0) / sum(w) AS q0, sum(w * q1) / sum(w) AS q1, sum(w * q2) / sum(w) AS q2, sum(w * q3) / sum(w) AS q3 FROM u GROUP BY user_id)"""


@plans.add("federated_fusion", f"WITH {_FUSE} SELECT user_id, round(px, 5) AS px, round(vx, 5) AS vx, round(vy, 5) AS vy, " + ", ".join(f"round(q{k} / sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3), 6) AS q{k}" for k in range(4)) + " FROM s")
def federated_fusion(spark, sf_dir):
    """All readings of each vehicle."""
    return _fused(samples(spark, sf_dir))


def _fused(f):
    """Local filters merged by inverse spread; attitudes by the normalised mean of unit quaternions."""
    i = F.col("event_id")
    tenth = lambda n: (i % n).cast("double") / 10
    f = f.select("user_id", F.col("value").alias("px"), F.col("lat").alias("vx"), F.col("lon").alias("vy"), F.lit(1.0).alias("q0"), tenth(7).alias("q1"), tenth(5).alias("q2"), tenth(3).alias("q3"), (1 / F.greatest((i % 50).cast("double"), F.lit(1e-6))).alias("w"))
    qs = ["q0", "q1", "q2", "q3"]
    norm = F.sqrt(sum((F.col(q) * F.col(q) for q in qs[1:]), F.col("q0") * F.col("q0")))
    u = f.withColumn("n", norm).withColumns({q: F.col(q) / F.col("n") for q in qs})
    s = u.groupBy("user_id").agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in ("px", "vx", "vy", *qs)))
    return s.select("user_id", *(F.round(c, 5).alias(c) for c in ("px", "vx", "vy")), *(r6(F.col(q) / norm).alias(q) for q in qs))


_COMPAT = f"""{SAMPLES_SQL}, p AS (SELECT event_id, (event_id % 40)::DOUBLE / 2 AS v, coalesce(abs(((((heading - lag(heading) OVER w + 180) % 360) + 360) % 360) - 180) / 20, 0) AS r FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@plans.add("mode_compatibility", f"WITH {_COMPAT} SELECT event_id, round(greatest(exp(-power(v / 3, 2)), 1e-6), 6) AS hover, round(greatest((1 - exp(-power(v / 8, 2))) * exp(-power(r / 2.5, 2)), 1e-6), 6) AS cruise, round(greatest((1 - exp(-power(v / 6, 2))) * (1 - exp(-power(r / 3, 2))) * (1 + least(r / 10, 3)), 1e-6), 6) AS turn FROM p")
def mode_compatibility(spark, sf_dir):
    turn = F.abs(angles.turn(F.lag("heading").over(track_order()), F.col("heading"))) / 20
    p = samples(spark, sf_dir).select("event_id", ((F.col("event_id") % 40).cast("double") / 2).alias("v"), F.coalesce(turn, F.lit(0.0)).alias("r"))
    fade = lambda c, s: F.exp(-F.pow(F.col(c) / s, F.lit(2.0)))
    fits = {"hover": fade("v", 3), "cruise": (1 - fade("v", 8)) * fade("r", 2.5), "turn": (1 - fade("v", 6)) * (1 - fade("r", 3)) * (F.least(F.col("r") / 10, F.lit(3.0)) + 1)}
    return p.select("event_id", *(r6(F.greatest(f, F.lit(1e-6))).alias(n) for n, f in fits.items()))


def _tracks(spark, sf_dir):
    """Fixes of each vehicle: a planar path with its motion and covariance."""
    c = covariances(spark, sf_dir)
    t = F.row_number().over(track_order()).cast("double") * 2
    return c.select("user_id", "event_id", t.alias("t"), (t * 10 + F.col("event_id") % 7).alias("east"), (t * 5 - F.col("event_id") % 5).alias("north"), F.lit(11.0).alias("speed"), F.lit(63.4).alias("heading"), "ee", "en", "nn")


@plans.add("imm_filter")
def imm_filter(spark, sf_dir):
    """Each vehicle's fixes through the three-model filter, in order; both the raw fix and the filtered place come out."""
    kind = "user_id bigint, event_id bigint, fix_east double, fix_north double, imm_east double, imm_north double, speed double, heading double, w_hover double, w_cruise double, w_turn double, mode string, hdop double"
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches):
        mixes = filters.TrackMixes(2.0)
        for rows in batches:
            if len(rows):
                cov = rows[["ee", "en", "en", "nn"]].to_numpy().reshape(-1, 2, 2)
                g = mixes.feed(rows["user_id"].to_numpy(), *(rows[c].to_numpy() for c in ("east", "north", "speed", "heading")), cov)
                columns = [rows["user_id"], rows["event_id"], rows["east"], rows["north"], g["east"], g["north"], g["speed"], g["heading"], *g["weights"].T, g["mode"], g["hdop"]]
                yield pd.DataFrame(dict(zip(names, map(np.asarray, columns), strict=True))).round(6)

    # vehicles are dealt whole and stand together in order, so each batch steps through many at once
    return _tracks(spark, sf_dir).repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInPandas(run, kind)


@plans.add("eskf_track")
def eskf_track(spark, sf_dir):
    """Each vehicle's fixes through the inertial error filter with level flight between them."""

    def step(f: inertial.Inertials, at: np.ndarray, r: pd.DataFrame) -> dict:
        f.level(at, r["heading"].to_numpy(), 2.0)
        f.correct(at, slice(2, 3), -f.p[at, 2:3], np.array([[25.0]]))
        cov, seen = r[["ee", "en", "en", "nn"]].to_numpy().reshape(-1, 2, 2), r[["east", "north"]].to_numpy(float)
        gap = seen - f.p[at, :2]
        took = inertial.quadratic(gap, f.cov[at, :2, :2] + cov) <= 1e6
        f.correct(at[took], slice(0, 2), gap[took], cov[took])
        places = {n: x for k, n in enumerate(("east", "north", "up")) for n, x in ((n, f.p[at, k]), (f"v_{n}", f.v[at, k]))}
        return {"user_id": r["user_id"].to_numpy(), "event_id": r["event_id"].to_numpy(), **places, "hdop": np.sqrt(f.cov[at, 0, 0] + f.cov[at, 1, 1])}

    return inertial.in_step(_tracks(spark, sf_dir), "user_id", ["t", "event_id"], step, "user_id bigint, event_id bigint, east double, north double, up double, v_east double, v_north double, v_up double, hdop double")


_PART = """raw AS (SELECT vec_id AS id, vec_id % 5 AS pf, embedding[1]::DOUBLE * 1000 AS e, embedding[2]::DOUBLE * 1000 AS n, exp(embedding[3]::DOUBLE * 8) AS u FROM embeddings), parts AS (SELECT *, u / sum(u) OVER (PARTITION BY pf) AS w FROM raw)"""


def particles(spark, sf_dir):
    at = lambda k: F.element_at("embedding", k).cast("double")
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).alias("pf"), (at(1) * 1000).alias("e"), (at(2) * 1000).alias("n"), F.exp(at(3) * 8).alias("u"))
    return raw.join(raw.groupBy("pf").agg(F.sum("u").alias("all")), "pf").select("pf", "id", "e", "n", (F.col("u") / F.col("all")).alias("w"))


@plans.add("particle_estimate", f"""WITH {_PART}, m AS (SELECT pf, sum(w * e) AS me, sum(w * n) AS mn, count(*) AS k, -sum(w * ln(greatest(w, 1e-300))) AS entropy, 1 / sum(w * w) AS ess, arg_max(id, (w, -id)) AS best FROM parts GROUP BY pf),
c AS (SELECT pf, sum(w * (e - me) * (e - me)) + 1e-9 AS ee, sum(w * (e - me) * (n - mn)) AS en, sum(w * (n - mn) * (n - mn)) + 1e-9 AS nn FROM parts JOIN m USING (pf) GROUP BY pf)
SELECT pf, round(me, 4) AS e, round(mn, 4) AS n, round(ee, 3) AS ee, round(en, 3) AS en, round(nn, 3) AS nn, round(entropy, 6) AS entropy, round(ess, 5) AS ess, best, ee + nn < 50000 AND entropy < ln(greatest(k, 2)) * 0.75 AS converged FROM m JOIN c USING (pf)""")
def particle_estimate(spark, sf_dir):
    p = particles(spark, sf_dir)
    m = p.groupBy("pf").agg(F.sum(F.col("w") * F.col("e")).alias("me"), F.sum(F.col("w") * F.col("n")).alias("mn"), F.count(F.lit(1)).alias("k"), (-F.sum(F.col("w") * F.ln(F.greatest("w", F.lit(1e-300))))).alias("entropy"), (1 / F.sum(F.col("w") * F.col("w"))).alias("ess"), F.max_by("id", F.struct("w", (-F.col("id")).alias("x"))).alias("best"))
    de, dn = F.col("e") - F.col("me"), F.col("n") - F.col("mn")
    c = p.join(m, "pf").groupBy("pf").agg((F.sum(F.col("w") * de * de) + 1e-9).alias("ee"), F.sum(F.col("w") * de * dn).alias("en"), (F.sum(F.col("w") * dn * dn) + 1e-9).alias("nn"))
    done = (F.col("ee") + F.col("nn") < 50_000) & (F.col("entropy") < F.ln(F.greatest("k", F.lit(2))) * 0.75)
    return m.join(c, "pf").select("pf", F.round("me", 4).alias("e"), F.round("mn", 4).alias("n"), *(F.round(x, 3).alias(x) for x in ("ee", "en", "nn")), r6("entropy").alias("entropy"), F.round("ess", 5).alias("ess"), "best", done.alias("converged"))


@plans.add("systematic_resample", f"""WITH {_PART}, c AS (SELECT pf, id, sum(w) OVER (PARTITION BY pf ORDER BY id ROWS UNBOUNDED PRECEDING) AS hi, count(*) OVER (PARTITION BY pf) AS k FROM parts), b AS (SELECT *, lag(hi) OVER (PARTITION BY pf ORDER BY id) AS lo FROM c),
n AS (SELECT pf, id, least(greatest(floor(hi * k - 0.5) + 1, 0), k) - least(greatest(floor(coalesce(lo, 0) * k - 0.5) + 1, 0), k) AS copies FROM b) SELECT pf, id, copies::BIGINT AS copies FROM n WHERE copies > 0""")
def systematic_resample(spark, sf_dir, start: float = 0.5):
    """How often each particle is drawn at even steps: targets (start + i) / n that fall into its part of the running sum, counted in closed form."""
    w = W.partitionBy("pf").orderBy("id")
    c = particles(spark, sf_dir).select("pf", "id", F.sum("w").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("hi"), F.count(F.lit(1)).over(W.partitionBy("pf")).alias("k"))
    upto = lambda x: F.least(F.greatest(F.floor(x * F.col("k") - start) + 1, F.lit(0)), F.col("k"))
    n = c.select("pf", "id", (upto(F.col("hi")) - upto(F.coalesce(F.lag("hi").over(w), F.lit(0.0)))).alias("copies"))
    return n.where("copies > 0")


_UPDATE = f"""{_PART}, {GRID_SQL}, path AS (SELECT p.*, k, p.id * 10 + k AS qid, 100 + p.n / 10 + k AS r, 20 + p.e / 40 + k * 2 AS c FROM parts p, generate_series(0, 4) g(k)), pts AS (SELECT qid AS id, r, c FROM path), {BILINEAR_SQL},
res AS (SELECT path.pf, path.id, any_value(w) AS w, avg(power(coalesce(elev - (k - 2) * 10, 5 * 60), 2)) AS mse FROM path JOIN sampled s ON s.id = path.qid GROUP BY path.pf, path.id),
l AS (SELECT pf, id, ln(greatest(w, 1e-300)) - 0.5 * mse / 3600 AS lw FROM res), x AS (SELECT pf, id, exp(lw - max(lw) OVER (PARTITION BY pf)) AS u FROM l)"""


@plans.add("particle_update", f"WITH {_UPDATE} SELECT pf, id, round(u / sum(u) OVER (PARTITION BY pf), 9) AS w FROM x")
def particle_update(spark, sf_dir, sigma: float = 60.0):
    """New weights from terrain along a path moved to each particle; unseen samples count as five sigma."""
    k = F.col("k")
    path = particles(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("qid", F.col("id") * 10 + k)
    pts = path.select(F.col("qid").alias("id"), (F.col("n") / 10 + 100 + k).alias("r"), (F.col("e") / 40 + 20 + k * 2).alias("c"))
    seen = raster.bilinear(pts, tiles(spark, sf_dir)).withColumnRenamed("id", "qid")
    miss = F.coalesce(F.col("elev") - (k - 2) * 10, F.lit(5 * sigma))
    res = path.join(seen, "qid").groupBy("pf", "id").agg(F.first("w").alias("w"), F.avg(miss * miss).alias("mse"))
    lw = res.select("pf", "id", (F.ln(F.greatest("w", F.lit(1e-300))) - F.col("mse") * 0.5 / (sigma * sigma)).alias("lw"))
    u = lw.join(lw.groupBy("pf").agg(F.max("lw").alias("top")), "pf").select("pf", "id", F.exp(F.col("lw") - F.col("top")).alias("u"))
    return u.join(u.groupBy("pf").agg(F.sum("u").alias("all")), "pf").select("pf", "id", F.round(F.col("u") / F.col("all"), 9).alias("w"))


@plans.add("gnss_availability", f"""WITH {SAMPLES_SQL}, s AS (SELECT event_id, t - min(t) OVER (PARTITION BY user_id) AS el, CASE event_id % 10 WHEN 0 THEN true WHEN 1 THEN false END AS forced FROM samples) SELECT event_id, coalesce(forced, el < 100000 OR el >= 500000) AS available FROM s""")
def gnss_availability(spark, sf_dir, drop: float = 100_000.0, recover: float = 500_000.0):
    """A command decides; else the signal is gone from drop until recover seconds after the start."""
    i = F.col("event_id")
    el = F.col("t") - F.min("t").over(W.partitionBy("user_id"))
    s = samples(spark, sf_dir).select("event_id", el.alias("el"), F.when(i % 10 == 0, True).when(i % 10 == 1, False).alias("forced"))
    return s.select("event_id", F.coalesce("forced", (F.col("el") < drop) | (F.col("el") >= recover)).alias("available"))


_SITL = f"""{SAMPLES_SQL}, msg AS (SELECT *, event_id % 3 AS kind FROM samples), f AS (SELECT *, CASE WHEN kind = 0 THEN floor(lat * 1e7) / 1e7 END AS la, CASE WHEN kind = 0 THEN floor(lon * 1e7) / 1e7 END AS lo,
  CASE WHEN kind = 0 THEN sqrt(power(floor(speed * 60) / 100, 2) + power(floor(speed * 80) / 100, 2)) WHEN kind = 1 THEN speed END AS sp, CASE WHEN kind = 0 AND event_id % 4 <> 0 THEN floor(heading * 100) / 100 WHEN kind = 1 THEN heading END AS hd, CASE WHEN kind = 2 THEN heading END AS yaw FROM msg),
m AS (SELECT event_id, last_value(la IGNORE NULLS) OVER w AS lat, last_value(lo IGNORE NULLS) OVER w AS lon, last_value(sp IGNORE NULLS) OVER w AS speed, last_value(hd IGNORE NULLS) OVER w AS h, first_value(yaw IGNORE NULLS) OVER w AS y FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


@plans.add("sitl_state_merge", f"WITH {_SITL} SELECT event_id, round(lat, 7) AS lat, round(lon, 7) AS lon, round(coalesce(speed, 0), 5) AS speed, round(coalesce(h, y, 0), 5) AS heading, 1500.0::DOUBLE AS alt_msl FROM m WHERE lat IS NOT NULL")
def sitl_state_merge(spark, sf_dir):
    """Autopilot messages of three kinds merged into a state: the last value of each field, attitude only while no heading is known."""
    kind = F.col("event_id") % 3
    s = samples(spark, sf_dir)
    when = lambda k, c: F.when(kind == k, c)
    unit = lambda c, n: F.floor(c * n) / n
    speed = when(0, F.sqrt(F.pow(F.floor(F.col("speed") * 60) / 100, F.lit(2.0)) + F.pow(F.floor(F.col("speed") * 80) / 100, F.lit(2.0)))).when(kind == 1, F.col("speed"))
    head = F.when((kind == 0) & (F.col("event_id") % 4 != 0), unit(F.col("heading"), 100)).when(kind == 1, F.col("heading"))
    w = track_order().rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.last(c, True).over(w)
    m = s.select("event_id", last(when(0, unit(F.col("lat"), 1e7))).alias("lat"), last(when(0, unit(F.col("lon"), 1e7))).alias("lon"), last(speed).alias("speed"), last(head).alias("h"), F.first(when(2, F.col("heading")), True).over(w).alias("y"))
    return m.where("lat is not null").select("event_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round(F.coalesce("speed", F.lit(0.0)), 5).alias("speed"), F.round(F.coalesce("h", "y", F.lit(0.0)), 5).alias("heading"), F.lit(1500.0).alias("alt_msl"))


@plans.add("control_latest", f"WITH {SAMPLES_SQL} SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id % 2 = 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS enabled FROM samples")
def control_latest(spark, sf_dir):
    """The latest command before each sample."""
    w = track_order().rowsBetween(W.unboundedPreceding, 0)
    return samples(spark, sf_dir).select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id") % 2 == 0), True).over(w).alias("enabled"))


@plans.add("latest_state", f"WITH {SAMPLES_SQL} SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS state FROM samples GROUP BY user_id")
def latest_state(spark, sf_dir):
    best = F.max(F.struct("ts", "event_id", "event_type"))
    return samples(spark, sf_dir).groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", F.col("b.event_type").alias("state"))
