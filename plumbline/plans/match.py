"""Matching queries: embeddings as reference rows, a slice of one of them with a known disturbance as the measured profile."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import angles
from plumbline.operators import features, fullmatch
from plumbline.operators import match as M

from .base import Plans, r6, table

plans = Plans()
#: The planted answer, samples of the measured profile, and a scale that fits rows of unit length.
ROW, OFFSET, N, SCALE, STEP_M = 45, 10, 32, 0.005, 30.0

REF_SQL = "ref AS (SELECT vec_id AS az, unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"
MEAS_SQL = f"meas AS (SELECT pos - {OFFSET} AS i, v + 0.01::DOUBLE * (((pos - {OFFSET}) * 7) % 5 - 2) AS h FROM ref WHERE az = {ROW} AND pos BETWEEN {OFFSET} AND {OFFSET + N - 1})"


def heat_sql(ref: str = "ref", meas: str = "meas", name: str = "heat") -> str:
    return f"""{name}_pairs AS (SELECT r.az, r.pos - m.i AS off, r.v, m.h FROM {ref} r JOIN {meas} m ON r.pos - m.i BETWEEN 0 AND 64 - {N}),
{name}_sums AS (SELECT az, off, count(v + h) AS k, covar_pop(v, h) FILTER (v IS NOT NULL AND h IS NOT NULL) AS cov, stddev_pop(v) FILTER (h IS NOT NULL) AS sv, stddev_pop(h) FILTER (v IS NOT NULL) AS sh, avg(power(v - h, 2)) AS d FROM {name}_pairs GROUP BY az, off),
{name}_scores AS (SELECT az, off, k::DOUBLE / {N} AS valid_fraction, CASE WHEN k < 2 OR sv * sh <= 1e-12 THEN 0 ELSE cov / (sv * sh) END AS ncc, CASE WHEN k < 2 THEN 0 ELSE 1 / (1 + d / {SCALE}) END AS msd FROM {name}_sums),
{name} AS (SELECT *, CASE WHEN valid_fraction >= 0.5 THEN (ncc * 0.5 + msd * 0.5) / 1.0 END AS score FROM {name}_scores)"""


HEAT_SQL = f"{REF_SQL}, {MEAS_SQL}, {heat_sql()}"


def reference(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("az"), F.transform("embedding", lambda v: v.cast("double")).alias("profile"))


def measured(spark, sf_dir):
    row = reference(spark, sf_dir).where(F.col("az") == ROW)
    return row.select(F.transform(F.slice("profile", OFFSET + 1, N), lambda v, i: v + ((i * 7) % 5 - 2) * 0.01).alias("h"))


def heat(spark, sf_dir):
    """The heatmap of complete profiles, by matrix products within batches of reference rows."""
    return features.kernel_heatmap(reference(spark, sf_dir), measured(spark, sf_dir), SCALE)


def n_az(spark, sf_dir) -> int:
    """Reference rows, a number that the planner needs for the way around."""
    return table(spark, sf_dir, "embeddings").count()


@plans.add("match_argmax", f"WITH {HEAT_SQL} SELECT az::INT AS az, off::INT AS off, round(score, 6) AS score, round(ncc, 6) AS ncc, round(msd, 6) AS msd FROM heat ORDER BY heat.score DESC, heat.az, heat.off LIMIT 1")
def match_argmax(spark, sf_dir):
    return M.best(heat(spark, sf_dir)).select("az", "off", r6("score").alias("score"), r6("ncc").alias("ncc"), r6("msd").alias("msd"))


@plans.add("match_heatmap", f"WITH {HEAT_SQL} SELECT az::INT AS az, off::INT AS off, round(score, 6) AS score FROM heat")
def match_heatmap(spark, sf_dir):
    """By array functions alone."""
    return M.heatmap(reference(spark, sf_dir), measured(spark, sf_dir), scale=SCALE).select("az", "off", r6("score").alias("score"))


@plans.add("match_metric_modes", f"WITH {HEAT_SQL}, m AS (SELECT 'ncc' AS metric, az, off, ncc AS s FROM heat UNION ALL SELECT 'msd', az, off, msd FROM heat UNION ALL SELECT 'hybrid', az, off, score FROM heat), k AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY s DESC, az, off) AS i FROM m) SELECT metric, az::INT AS az, off::INT AS off, round(s, 6) AS score FROM k WHERE i = 1")
def match_metric_modes(spark, sf_dir):
    cells = heat(spark, sf_dir)
    each = cells.select("az", "off", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), M.combine(m, F.col("ncc"), F.col("msd")).alias("s")) for m in M.METRICS))))
    top = each.groupBy("metric").agg(F.max(F.struct("s", (-F.col("az")).alias("az"), (-F.col("off")).alias("off"))).alias("b"))
    return top.select("metric", (-F.col("b.az")).alias("az"), (-F.col("b.off")).alias("off"), r6("b.s").alias("score"))


_MASKED = f"{REF_SQL}, {MEAS_SQL}, gaps AS (SELECT az, pos, CASE WHEN (az * 3 + pos) % 7 <> 0 AND NOT (az % 50 = 3 AND pos > 20) THEN v END AS v FROM ref), holes AS (SELECT i, CASE WHEN i % 9 <> 4 THEN h END AS h FROM meas), {heat_sql('gaps', 'holes')}"


@plans.add("match_masked", f"WITH {_MASKED} SELECT az::INT AS az, off::INT AS off, round(score, 6) AS score, round(valid_fraction, 6) AS valid_fraction FROM heat")
def match_masked(spark, sf_dir):
    """With missing values on both sides; cells with too few pairs have no score."""
    ref = reference(spark, sf_dir)
    holes = F.transform("profile", lambda v, p: F.when(((F.col("az") * 3 + p) % 7 != 0) & ~((F.col("az") % 50 == 3) & (p > 20)), v))
    m = measured(spark, sf_dir).select(F.transform("h", lambda v, i: F.when(i % 9 != 4, v)).alias("h"))
    return M.heatmap(ref.withColumn("profile", holes), m, scale=SCALE).select("az", "off", r6("score").alias("score"), r6("valid_fraction").alias("valid_fraction"))


_TURNED = f"{REF_SQL}, {MEAS_SQL}, turned AS (SELECT {N - 1} - i AS i, h FROM meas), {heat_sql()}, {heat_sql('ref', 'turned', 'back')}"


def orientation_sql() -> str:
    """The measured profile of this query is the disturbed slice in reverse, so the reversed match has to win."""
    return f"""WITH {_TURNED}, f AS (SELECT * FROM back ORDER BY score DESC, az, off LIMIT 1), r AS (SELECT * FROM heat ORDER BY score DESC, az, off LIMIT 1)
SELECT CASE WHEN r.score > f.score + 0.05 THEN 'reversed' ELSE 'forward' END AS orientation, (CASE WHEN r.score > f.score + 0.05 THEN r.az ELSE f.az END)::INT AS az, (CASE WHEN r.score > f.score + 0.05 THEN r.off ELSE f.off END)::INT AS off, round(CASE WHEN r.score > f.score + 0.05 THEN r.score ELSE f.score END, 6) AS score FROM f, r"""


@plans.add("match_orientation", orientation_sql())
def match_orientation(spark, sf_dir, lead: float = 0.05):
    """The profile and its reverse; the reverse is taken only if its peak leads by more than lead."""
    given = measured(spark, sf_dir).select(F.reverse("h").alias("h"))
    ways = given.select(F.inline(F.array(F.struct(F.lit("forward").alias("orientation"), F.col("h").alias("h")), F.struct(F.lit("reversed").alias("orientation"), F.reverse("h").alias("h")))))
    cells = M.heatmap(reference(spark, sf_dir), ways, scale=SCALE)
    tops = cells.groupBy("orientation").agg(F.max(F.struct("score", (-F.col("az")).alias("az"), (-F.col("off")).alias("off"))).alias("b"))
    both = tops.groupBy().agg(*(F.max(F.when(F.col("orientation") == o, F.col("b"))).alias(o) for o in ("forward", "reversed")))
    turned = F.col("reversed.score") > F.col("forward.score") + lead
    b = F.when(turned, F.col("reversed")).otherwise(F.col("forward"))
    return both.select(F.when(turned, "reversed").otherwise("forward").alias("orientation"), (-b["az"]).alias("az"), (-b["off"]).alias("off"), r6(b["score"]).alias("score"))


def _sub(a: str, b: str, c: str) -> str:
    return f"coalesce(CASE WHEN abs({a} - 2 * {b} + {c}) >= 1e-12 THEN greatest(least(0.5 * ({a} - {c}) / ({a} - 2 * {b} + {c}), 0.5), -0.5) END, 0)"


_AROUND = """cells AS (SELECT h.*, (SELECT count(*) FROM embeddings) AS n_az, lag(score) OVER o AS o0, lead(score) OVER o AS o1, coalesce(lag(score) OVER a, last_value(score) OVER e) AS a0, coalesce(lead(score) OVER a, first_value(score) OVER e) AS a1
  FROM heat h WINDOW o AS (PARTITION BY az ORDER BY off), a AS (PARTITION BY off ORDER BY az), e AS (PARTITION BY off ORDER BY az ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def _maxima_sql(radius: int) -> str:
    return f"""rowmax AS (SELECT az, off, score, max(score) OVER (PARTITION BY az ORDER BY off ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS m FROM heat),
nearby AS (SELECT c.az, c.off, max(r.m) AS top FROM rowmax c, generate_series(-{radius}, {radius}) g(d), (SELECT count(*) AS n FROM embeddings) z JOIN rowmax r ON r.off = c.off AND r.az = (c.az + d + z.n) % z.n GROUP BY c.az, c.off)"""


@plans.add("match_topk_candidates", f"""WITH {HEAT_SQL}, {_AROUND}, {_maxima_sql(2)} SELECT c.az::INT AS az, c.off::INT AS off, round(score, 6) AS score,
  round((c.az + {_sub('a0', 'score', 'a1')} + n_az) % n_az, 5) AS az_sub, round(greatest(least(c.off + {_sub('o0', 'score', 'o1')}, 64 - {N}), 0), 5) AS off_sub
FROM cells c JOIN nearby n USING (az, off) WHERE c.score = n.top ORDER BY c.score DESC, c.az, c.off LIMIT 8""")
def match_topk_candidates(spark, sf_dir):
    """The eight strongest local maxima (5 by 5) with places between steps."""
    n = n_az(spark, sf_dir)
    cells = M.best(M.local_maxima(M.with_neighbours(heat(spark, sf_dir), n), 2, n), 8)
    az, off = M.vertex(F.col("a0"), F.col("score"), F.col("a1"))[0], M.vertex(F.col("o0"), F.col("score"), F.col("o1"))[0]
    return cells.select("az", "off", r6("score").alias("score"), F.round(F.pmod(F.col("az") + az, F.lit(float(n))), 5).alias("az_sub"), F.round(F.greatest(F.least(F.col("off") + off, F.lit(64.0 - N)), F.lit(0.0)), 5).alias("off_sub"))


@plans.add("peak_subsample_sigma", f"""WITH {HEAT_SQL}, {_AROUND}, k AS (SELECT *, row_number() OVER (PARTITION BY az ORDER BY score DESC, off) AS i FROM cells)
SELECT az::INT AS az, off::INT AS off, round({_sub('o0', 'score', 'o1')}, 5) AS shift, CASE WHEN o0 IS NOT NULL AND o1 IS NOT NULL AND o0 - 2 * score + o1 < -1e-12 THEN round(0.5 / sqrt(-(o0 - 2 * score + o1)) * {STEP_M}, 4) END AS sigma_m FROM k WHERE i = 1""")
def peak_subsample_sigma(spark, sf_dir):
    """The best offset of each reference row, its place between steps and its spread."""
    w = W.partitionBy("az").orderBy("off")
    cells = heat(spark, sf_dir).withColumns({"o0": F.lag("score").over(w), "o1": F.lead("score").over(w)})
    top = cells.withColumn("i", F.row_number().over(W.partitionBy("az").orderBy(F.desc("score"), "off"))).where("i = 1")
    shift, curve = M.vertex(F.col("o0"), F.col("score"), F.col("o1"))
    return top.select("az", "off", F.round(shift, 5).alias("shift"), F.round(M.sigma(curve) * STEP_M, 4).alias("sigma_m"))


_HANN = f"(0.5 - 0.5 * cos(i * 2 * pi() / {N - 1}))"


@plans.add("match_topk_refine", f"""WITH {HEAT_SQL}, top AS (SELECT * FROM heat ORDER BY heat.score DESC, heat.az, heat.off LIMIT 20),
s AS (SELECT t.az, t.off, sum(r.v * m.h * power({_HANN}, 2)) / (sqrt(sum(power(r.v * {_HANN}, 2))) * sqrt(sum(power(m.h * {_HANN}, 2)))) AS sim FROM top t JOIN ref r USING (az) JOIN meas m ON r.pos = t.off + m.i GROUP BY t.az, t.off)
SELECT az::INT AS az, off::INT AS off, round(score * 0.7 + sim * 0.3, 6) AS refined FROM top JOIN s USING (az, off)""")
def match_topk_refine(spark, sf_dir, k: int = 20, weight: float = 0.3):
    """The k best cells scored anew with the likeness of their shapes."""
    top = M.best(heat(spark, sf_dir), k).join(reference(spark, sf_dir), "az").crossJoin(F.broadcast(measured(spark, sf_dir)))
    like = M.similarity(F.slice("profile", F.col("off") + 1, N), F.col("h"), N)
    return top.select("az", "off", r6(F.col("score") * (1 - weight) + like * weight).alias("refined"))


@plans.add("heatmap_normalized", f"WITH {HEAT_SQL} SELECT az::INT AS az, off::INT AS off, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS level FROM heat")
def heatmap_normalized(spark, sf_dir):
    """Scores on a scale from 0 to 1; 0 if all are the same. The two ends come from an aggregate, not from one window over everything."""
    cells = heat(spark, sf_dir)
    ends = cells.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    level = F.when(F.col("hi") == F.col("lo"), F.when(F.col("score").isNotNull(), 0.0)).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return cells.crossJoin(F.broadcast(ends)).select("az", "off", r6(level).alias("level"))


_PEAK = "peak AS (SELECT az AS paz, off AS poff, score AS p, (SELECT count(*) FROM embeddings) AS n_az FROM heat ORDER BY heat.score DESC, heat.az, heat.off LIMIT 1)"
_WAY = "least((az - paz + n_az) % n_az, (paz - az + n_az) % n_az)"


@plans.add("peak_quality", f"""WITH {HEAT_SQL}, {_PEAK}, c AS (SELECT *, {_WAY} <= 5 AND abs(off - poff) <= 3 AS near FROM heat, peak)
SELECT round(greatest(min(p) - max(score) FILTER (NOT near), 0), 6) AS confidence, round(min(p) / greatest(stddev_pop(score) FILTER (NOT near), 1e-9), 5) AS to_side, round(min(p) / greatest(abs(avg(score)), 1e-9), 5) AS to_mean,
  min(p) >= 0.5 AND min(p) / greatest(stddev_pop(score) FILTER (NOT near), 1e-9) >= 1.3 AS reliable FROM c""")
def peak_quality(spark, sf_dir):
    """How far the peak stands out of what lies more than 5 rows or 3 offsets from it."""
    cells, n = heat(spark, sf_dir), n_az(spark, sf_dir)
    top = M.best(cells).select(F.col("az").alias("paz"), F.col("off").alias("poff"), F.col("score").alias("p"))
    near = (angles.cyclic_steps(F.col("az"), F.col("paz"), n) <= 5) & (F.abs(F.col("off") - F.col("poff")) <= 3)
    side = F.when(~near, F.col("score"))
    got = cells.crossJoin(F.broadcast(top)).agg(F.first("p").alias("p"), F.max(side).alias("most"), F.stddev_pop(side).alias("sd"), F.avg("score").alias("mean"))
    p, to_side = F.col("p"), F.coalesce(F.col("p") / F.greatest("sd", F.lit(1e-9)), F.col("p") / 1e-9)
    return got.select(r6(F.when(F.col("most").isNull(), p).otherwise(F.greatest(p - F.col("most"), F.lit(0.0)))).alias("confidence"), F.round(to_side, 5).alias("to_side"), F.round(p / F.greatest(F.abs("mean"), F.lit(1e-9)), 5).alias("to_mean"), ((p >= 0.5) & (to_side >= 1.3)).alias("reliable"))


@plans.add("ambiguity_metrics", f"""WITH {HEAT_SQL}, {_PEAK}, {_maxima_sql(3)}, c AS (SELECT h.*, peak.*, {_WAY} AS way, n.top FROM heat h JOIN nearby n USING (az, off), peak),
k AS (SELECT *, score = top AND score >= p - greatest(abs(p) * 0.2, 1e-9) AS rival, way <= 3 AND abs(off - poff) <= 3 AS near, az = paz AND off = poff AS is_peak FROM c),
a AS (SELECT min(p) AS p, max(score) FILTER (NOT near) AS side, count(*) FILTER (rival OR is_peak) AS n_peaks, min(sqrt(power((off - poff) * {STEP_M}, 2) + power(way * ({STEP_M} * {65 - N} * pi() / 180), 2))) FILTER (rival AND NOT is_peak) AS isolation FROM k),
d AS (SELECT *, CASE WHEN p <= 0 THEN 0 ELSE 20 * log10(greatest(p, 1e-10) / greatest(abs(coalesce(side, 1e-10)), 1e-10)) END AS pslr FROM a)
SELECT round(pslr, 5) AS pslr_db, n_peaks::BIGINT AS n_peaks, round(isolation, 4) AS isolation_m, pslr < 3 OR n_peaks > 2 AS ambiguous FROM d""")
def ambiguity_metrics(spark, sf_dir):
    """Rival peaks (7 by 7, within a fifth of the best), the strongest side lobe in decibels, and how far the nearest rival is (null without any)."""
    cells, n = heat(spark, sf_dir), n_az(spark, sf_dir)
    top = M.best(cells).select(F.col("az").alias("paz"), F.col("off").alias("poff"), F.col("score").alias("p"))
    tops = M.local_maxima(cells, 3, n).select("az", "off", F.lit(True).alias("top"))
    c = cells.join(tops, ["az", "off"], "left").crossJoin(F.broadcast(top)).withColumn("way", angles.cyclic_steps(F.col("az"), F.col("paz"), n))
    is_peak = (F.col("az") == F.col("paz")) & (F.col("off") == F.col("poff"))
    rival = F.coalesce("top", F.lit(False)) & (F.col("score") >= F.col("p") - F.greatest(F.abs("p") * 0.2, F.lit(1e-9)))
    near = (F.col("way") <= 3) & (F.abs(F.col("off") - F.col("poff")) <= 3)
    far = F.hypot((F.col("off") - F.col("poff")) * STEP_M, F.col("way") * (STEP_M * (65 - N) * 3.141592653589793 / 180))
    a = c.agg(F.first("p").alias("p"), F.max(F.when(~near, F.col("score"))).alias("side"), F.count_if(rival | is_peak).alias("n_peaks"), F.min(F.when(rival & ~is_peak, far)).alias("isolation"))
    side = F.greatest(F.abs(F.coalesce("side", F.lit(1e-10))), F.lit(1e-10))
    pslr = F.when(F.col("p") <= 0, 0.0).otherwise(F.log10(F.greatest("p", F.lit(1e-10)) / side) * 20)
    return a.select(F.round(pslr, 5).alias("pslr_db"), "n_peaks", F.round("isolation", 4).alias("isolation_m"), ((pslr < 3) | (F.col("n_peaks") > 2)).alias("ambiguous"))


@plans.add("observability", f"""WITH {REF_SQL}, s AS (SELECT *, lag(v) OVER w AS v0, lead(v) OVER w AS v1 FROM ref WINDOW w AS (PARTITION BY az ORDER BY pos)),
g AS (SELECT az, sum(power(CASE WHEN v0 IS NULL THEN v1 - v WHEN v1 IS NULL THEN v - v0 ELSE (v1 - v0) / 2 END * 1000 / {STEP_M}, 2)) AS energy FROM s GROUP BY az), c AS (SELECT *, CASE WHEN energy / 9 > 1e-12 THEN 1 / sqrt(energy / 9) END AS crlb FROM g)
SELECT az::INT AS az, round(energy, 4) AS energy, round(crlb, 6) AS crlb_m, round(coalesce(1 / (1 + crlb / {STEP_M}), 0), 6) AS hint, coalesce(crlb <= 250 AND energy > 0.05, false) AS informative FROM c""")
def observability(spark, sf_dir, noise_m: float = 3.0):
    """What each reference row tells about its offset: energy of its slope and the bound that follows; no shuffle, a row at a time."""
    ref, last = reference(spark, sf_dir), F.size("profile") - 1
    slope = F.transform("profile", lambda v, i: F.when(i == 0, F.get("profile", F.lit(1)) - v).when(i == last, v - F.get("profile", i - 1)).otherwise((F.get("profile", i + 1) - F.get("profile", i - 1)) / 2) * 1000 / STEP_M)
    g = ref.select("az", F.aggregate(slope, F.lit(0.0), lambda a, x: a + x * x).alias("energy"))
    info = F.col("energy") / (noise_m * noise_m)
    crlb = F.when(info > 1e-12, 1 / F.sqrt(info))
    return g.select("az", F.round("energy", 4).alias("energy"), r6(crlb).alias("crlb_m"), r6(F.coalesce(1 / (1 + crlb / STEP_M), F.lit(0.0))).alias("hint"), F.coalesce((crlb <= 250) & (F.col("energy") > 0.05), F.lit(False)).alias("informative"))


def _gradient_sql(value: str, source: str, out: str) -> str:
    return f"SELECT az, off, pos, n, {value}, CASE WHEN pos = 0 THEN lead({value}) OVER w - {value} WHEN pos = n - 1 THEN {value} - lag({value}) OVER w ELSE (lead({value}) OVER w - lag({value}) OVER w) / 2 END AS {out} FROM {source} WINDOW w AS (PARTITION BY az, off ORDER BY pos)"


def _features_sql(lists: str, name: str) -> str:
    """Tables that end in name (az, off, part, pos, n, f) of the features of lists l, of n values each. Parabolas over five samples are weights; the first two and last two samples lie on the end parabola."""
    t = lambda k: f"{name}_{k}"
    return f"""{t('q')} AS (SELECT *, unnest(generate_series(0, n - 1)) AS pos FROM ({lists})),
{t('h')} AS (SELECT az, off, pos, n, CASE WHEN pos = 0 THEN 31 * l[1] + 9 * l[2] - 3 * l[3] - 5 * l[4] + 3 * l[5] WHEN pos = 1 THEN 9 * l[1] + 13 * l[2] + 12 * l[3] + 6 * l[4] - 5 * l[5] WHEN pos = n - 2 THEN -5 * l[n - 4] + 6 * l[n - 3] + 12 * l[n - 2] + 13 * l[n - 1] + 9 * l[n]
  WHEN pos = n - 1 THEN 3 * l[n - 4] - 5 * l[n - 3] - 3 * l[n - 2] + 9 * l[n - 1] + 31 * l[n] ELSE -3 * l[pos - 1] + 12 * l[pos] + 17 * l[pos + 1] + 12 * l[pos + 2] - 3 * l[pos + 3] END / 35 AS x FROM {t('q')}),
{t('s')} AS ({_gradient_sql('x', t('h'), 'g')}), {t('c')} AS ({_gradient_sql('g', t('s'), 'k')}),
{t('a')} AS (SELECT az, off, pos, n, 1 AS part, 0.5::DOUBLE AS w, x FROM {t('h')} UNION ALL SELECT az, off, pos, n, 2, 0.3, g FROM {t('s')} UNION ALL SELECT az, off, pos, n, 3, 0.2, k FROM {t('c')}),
{t('m')} AS (SELECT *, avg(x) OVER p AS mean, stddev_pop(x) OVER p AS sd FROM {t('a')} WINDOW p AS (PARTITION BY az, off, part)),
{name} AS (SELECT az, off, part, pos, n, CASE WHEN sd > 1e-12 * greatest(abs(mean), 1) THEN w * (x - mean) / sd ELSE 0 END AS f FROM {t('m')})"""


_FEATURES = f"WITH {_features_sql('SELECT vec_id AS az, 0 AS off, embedding::DOUBLE[] AS l, len(embedding) AS n FROM embeddings', 'f')} SELECT az::INT AS az, list(round(f, 6) ORDER BY part, pos) AS features FROM f GROUP BY az"
_FEATURE_METRIC = f"""WITH {REF_SQL}, {MEAS_SQL}, {_features_sql(f"SELECT vec_id AS az, o AS off, embedding[o + 1:o + {N}]::DOUBLE[] AS l, {N} AS n FROM embeddings, generate_series(0, 64 - {N}) g(o)", 'f')},
{_features_sql(f"SELECT 0 AS az, 0 AS off, list(h ORDER BY i) AS l, {N} AS n FROM meas", 'own')},
s AS (SELECT f.az, f.off, sum(f.f * own.f * power({_HANN.replace('i *', 'f.pos *')}, 2)) AS d, sqrt(sum(power(f.f * {_HANN.replace('i *', 'f.pos *')}, 2))) AS a, sqrt(sum(power(own.f * {_HANN.replace('i *', 'f.pos *')}, 2))) AS b FROM f JOIN own USING (part, pos) GROUP BY f.az, f.off)
SELECT az::INT AS az, off::INT AS off, round(CASE WHEN a * b > 1e-12 THEN d / (a * b) ELSE 0 END, 6) AS score FROM s"""


@plans.add("terrain_features", _FEATURES)
def terrain_features(spark, sf_dir):
    """Smoothed height, slope and curvature of each reference row, standardised and weighted, end to end."""
    return features.terrain_features(reference(spark, sf_dir), 6)


@plans.add("match_feature_metric", _FEATURE_METRIC)
def match_feature_metric(spark, sf_dir):
    """Cells scored by the likeness of their features instead of their heights."""
    return features.feature_heatmap(reference(spark, sf_dir), measured(spark, sf_dir)).select("az", "off", r6("score").alias("score"))


@plans.add("match_argmax_kernel", f"WITH {HEAT_SQL} SELECT az::INT AS az, off::INT AS off, round(score, 6) AS score FROM heat ORDER BY heat.score DESC, heat.az, heat.off LIMIT 1")
def match_argmax_kernel(spark, sf_dir):
    """match_argmax by the numpy kernel: the form for many windows."""
    return M.best(features.kernel_heatmap(reference(spark, sf_dir), measured(spark, sf_dir), SCALE)).select("az", "off", r6("score").alias("score"))


_MANY = f"""{REF_SQL}, meas AS (SELECT az AS window_id, pos - az % 33 AS i, v + 0.01::DOUBLE * (((pos - az % 33) * 7) % 5 - 2) AS h FROM ref WHERE az % 25 = 3 AND pos BETWEEN az % 33 AND az % 33 + {N - 1}),
sums AS (SELECT window_id, az, r.pos - i AS off, covar_pop(v, h) AS cov, stddev_pop(v) AS sv, stddev_pop(h) AS sh, avg(power(v - h, 2)) AS d FROM ref r JOIN meas m ON r.pos - m.i BETWEEN 0 AND 64 - {N} GROUP BY ALL),
scores AS (SELECT window_id, az, off, 0.5 * CASE WHEN sv * sh > 1e-12 THEN cov / (sv * sh) ELSE 0 END + 0.5 / (1 + d / {SCALE}) AS score FROM sums)"""


@plans.add("match_many_windows", f"WITH {_MANY}, k AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, az, off) AS i FROM scores) SELECT window_id, az::INT AS az, off::INT AS off, round(score, 6) AS score FROM k WHERE i = 1")
def match_many_windows(spark, sf_dir):
    """A window out of every 25th row against all rows and offsets; each has to find where it was taken from."""
    ref = reference(spark, sf_dir)
    part = F.slice("profile", F.col("az") % 33 + 1, N)
    windows = ref.where("az % 25 = 3").select(F.col("az").cast("bigint").alias("window_id"), F.transform(part, lambda v, i: v + ((i * 7) % 5 - 2) * 0.01).alias("h"))
    return features.kernel_best(ref, windows, SCALE).select("window_id", "az", "off", r6("score").alias("score"))


_FULL = f"""WITH {HEAT_SQL}, {_AROUND}, {_PEAK}, {_maxima_sql(3)}, pair AS (SELECT az, off, max(score) OVER (PARTITION BY az ORDER BY off ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM heat),
near5 AS (SELECT c.az, c.off, max(r.m) AS top FROM pair c, generate_series(-2, 2) g(d), (SELECT count(*) AS n FROM embeddings) z JOIN pair r ON r.off = c.off AND r.az = (c.az + d + z.n) % z.n GROUP BY c.az, c.off),
k AS (SELECT c.*, p, paz, poff, {_WAY.replace('n_az', 'c.n_az')} AS way, n.top AS top7, t.top AS top5 FROM cells c JOIN nearby n USING (az, off) JOIN near5 t USING (az, off), peak),
f AS (SELECT *, way <= 5 AND abs(off - poff) <= 3 AS near, way <= 3 AND abs(off - poff) <= 3 AS lobe, az = paz AND off = poff AS is_peak, score = top7 AND score >= p - greatest(abs(p) * 0.2, 1e-9) AS rival FROM k),
a AS (SELECT min(p) AS p, max(score) FILTER (NOT near) AS side, stddev_pop(score) FILTER (NOT near) AS sd, avg(score) AS mean, max(score) FILTER (NOT lobe) AS most, count(*) FILTER (rival OR is_peak) AS n_peaks,
  min(sqrt(power((off - poff) * {STEP_M}, 2) + power(way * ({STEP_M} * {65 - N} * pi() / 180), 2))) FILTER (rival AND NOT is_peak) AS isolation FROM f),
d AS (SELECT *, CASE WHEN p <= 0 THEN 0 ELSE 20 * log10(greatest(p, 1e-10) / greatest(abs(coalesce(most, 1e-10)), 1e-10)) END AS pslr, p / greatest(sd, 1e-9) AS to_side FROM a),
c AS (SELECT list(az::INT ORDER BY score DESC, az, off) AS cand_az, list(off::INT ORDER BY score DESC, az, off) AS cand_off, list(round(score, 6) ORDER BY score DESC, az, off) AS cand_score FROM (SELECT * FROM f WHERE score = top5 ORDER BY score DESC, az, off LIMIT 8))
SELECT f.az::INT AS az, f.off::INT AS off, round(f.score, 6) AS score, round(f.ncc, 6) AS ncc, round(f.msd, 6) AS msd, round((f.az + {_sub('a0', 'f.score', 'a1')} + f.n_az) % f.n_az, 5) AS az_sub, round(greatest(least(f.off + {_sub('o0', 'f.score', 'o1')}, 64 - {N}), 0), 5) AS off_sub,
  round(greatest(d.p - side, 0), 6) AS confidence, round(to_side, 5) AS to_side, round(d.p / greatest(abs(mean), 1e-9), 5) AS to_mean, d.p >= 0.5 AND to_side >= 1.3 AND NOT (pslr < 3 OR n_peaks > 2) AS reliable,
  round(pslr, 5) AS pslr_db, n_peaks::BIGINT AS n_peaks, round(isolation, 4) AS isolation_m, pslr < 3 OR n_peaks > 2 AS ambiguous, cand_az, cand_off, cand_score FROM f, d, c WHERE f.is_peak"""


@plans.add("full_match", _FULL)
def full_match(spark, sf_dir):
    """Peak, quality, ambiguity and candidates from one pass over the reference rows."""
    got = fullmatch.full_match(reference(spark, sf_dir), measured(spark, sf_dir), SCALE, STEP_M)
    digits = {"score": 6, "ncc": 6, "msd": 6, "az_sub": 5, "off_sub": 5, "confidence": 6, "to_side": 5, "to_mean": 5, "pslr_db": 5, "isolation_m": 4}
    plain = [F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in ("az", "off", *digits, "reliable", "n_peaks", "ambiguous")]
    each = lambda name: F.transform("candidates", lambda c: c[name])
    return got.select(*plain, each("az").alias("cand_az"), each("off").alias("cand_off"), F.transform("candidates", lambda c: F.round(c["score"], 6)).alias("cand_score"))
