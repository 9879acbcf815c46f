"""Decisions over matches whose figures are made from event numbers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import angles
from plumbline.operators import decide as D
from plumbline.operators import ordered as O

from .base import SAMPLES_SQL, Plans, r6, samples

plans = Plans()
COLD = 3

MATCH_SQL = f"""{SAMPLES_SQL}, raw AS (
  SELECT event_id, user_id, ts, heading, speed, (event_id * 7 % 100)::DOUBLE / 100 AS peak, (event_id * 13 % 80)::DOUBLE / 10 AS pslr, (event_id * 11 % 30)::DOUBLE / 100 AS conf,
    (event_id * 17 % 2000)::DOUBLE - 500 AS off, CASE WHEN event_id % 29 <> 0 THEN ((event_id * 19 + 3) % 3600)::DOUBLE / 10 END AS az, event_id % 4 AS peaks, event_id % 6 <> 0 AS informative, event_id % 11 = 0 AS flat,
    event_id % 5 AS win, (10 * (2 + (event_id // 3) % 4))::INT AS size, (event_id * 31 % 1200)::DOUBLE / 10 AS new_speed, 0.5 + event_id % 3 AS dt, (event_id * 5 % 40)::DOUBLE / 40 AS hint,
    CASE WHEN event_id % 3 = 0 THEN (event_id * 23 % 3600)::DOUBLE / 10 END AS rival FROM samples),
m AS (SELECT *, pslr < 3 OR peaks > 2 AS ambiguous, peak >= 0.5 AND NOT (pslr < 3 OR peaks > 2) AS reliable FROM raw)"""
_TURN = "((((({1}) - ({0}) + 180) % 360) + 360) % 360 - 180)"
_TENTHS = "((floor(abs({0}) * 10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor(abs({0}) * 10 + 0.5)::BIGINT % 10)::VARCHAR)"


def matches(spark, sf_dir):
    i, s = F.col("event_id"), samples(spark, sf_dir)
    part = lambda f, n, d: (i * f % n).cast("double") / d
    m = s.select(
        "event_id", "user_id", "ts", "heading", "speed", part(7, 100, 100).alias("peak"), part(13, 80, 10).alias("pslr"), part(11, 30, 100).alias("conf"),
        (part(17, 2000, 1) - 500).alias("off"), F.when(i % 29 != 0, ((i * 19 + 3) % 3600).cast("double") / 10).alias("az"), (i % 4).alias("peaks"), (i % 6 != 0).alias("informative"), (i % 11 == 0).alias("flat"),
        (i % 5).alias("win"), ((F.floor(i / 3) % 4 + 2) * 10).cast("int").alias("size"), part(31, 1200, 10).alias("new_speed"), (i % 3 + 0.5).alias("dt"), part(5, 40, 40).alias("hint"),
        F.when(i % 3 == 0, part(23, 3600, 10)).alias("rival"),
    )
    ambiguous = (F.col("pslr") < 3) | (F.col("peaks") > 2)
    return m.withColumn("ambiguous", ambiguous).withColumn("reliable", (F.col("peak") >= 0.5) & ~ambiguous)


_LIMIT, _ACCEL, _MOST = "greatest(speed * 2.5, speed + 35, 80)", "abs(new_speed - speed) / greatest(dt, 1e-6)", "least(120, greatest(45, 20 + 35 * dt))"
_REASON = f"""CASE WHEN new_speed > {_LIMIT} THEN 'speed_jump:' || {_TENTHS.format('new_speed')} || '>' || {_TENTHS.format(_LIMIT)} WHEN {_ACCEL} > 25 THEN 'accel_jump:' || {_TENTHS.format(_ACCEL)} || '>25.0'
  WHEN abs({_TURN.format('heading', 'az')}) > {_MOST} THEN 'turn_jump:' || {_TENTHS.format(_TURN.format('heading', 'az'))} || '>' || {_TENTHS.format(_MOST)} END"""


def _reason():
    return D.implausible(F.col("new_speed"), F.col("az"), F.col("speed"), F.col("heading"), F.col("dt"))


@plans.add("plausibility_reason", f"WITH {MATCH_SQL} SELECT event_id, {_REASON} AS reason FROM m")
def plausibility_reason(spark, sf_dir):
    return matches(spark, sf_dir).select("event_id", _reason().alias("reason"))


@plans.add("decision_mode", f"""WITH {MATCH_SQL}, r AS (SELECT *, {_REASON} AS reason FROM m) SELECT event_id, CASE WHEN flat THEN 'terrain_flat_fallback' WHEN NOT informative THEN 'terrain_uninformative_fallback' WHEN ambiguous THEN 'terrain_ambiguous_fallback'
  WHEN NOT reliable AND win < {COLD} THEN 'cold_start_prediction' WHEN NOT reliable THEN 'terrain_low_confidence_fallback' WHEN reason IS NOT NULL THEN 'terrain_physical_gate_fallback:' || reason ELSE 'terrain_update_accepted' END AS mode FROM r""")
def decision_mode(spark, sf_dir):
    mode = D.mode(F.col("flat"), F.col("informative"), F.col("ambiguous"), F.col("reliable"), F.col("win"), F.col("reason"), COLD)
    return matches(spark, sf_dir).withColumn("reason", _reason()).select("event_id", mode.alias("mode"))


_CAND = f"""{MATCH_SQL}, cands AS (SELECT event_id, k, CASE WHEN k = 0 THEN peak ELSE peak - 0.03 * k END AS score, ((event_id * 41 + k * 77) % 3600)::DOUBLE / 10 AS caz, CASE WHEN k = 0 THEN new_speed ELSE speed + k * 3 END AS cspeed, speed, heading, dt FROM m, generate_series(0, 4) g(k)),
tried AS (SELECT *, cspeed <= greatest(speed * 2.5, speed + 35, 80) AND abs(cspeed - speed) / dt <= 25 AND abs({_TURN.format('heading', 'caz')}) <= {_MOST} AS ok FROM cands WHERE score >= (SELECT 0) - 1 AND k * 0.03 <= 0.08)"""


@plans.add("candidate_selection", f"WITH {_CAND} SELECT event_id, min(k) FILTER (ok)::INT AS chosen FROM tried GROUP BY event_id")
def candidate_selection(spark, sf_dir, within: float = 0.08):
    """The first of a match's candidates, in order and within 0.08 of its peak, that is physically plausible; null if none is."""
    k = F.col("k")
    c = matches(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).where(k * 0.03 <= within)
    c = c.select("event_id", "k", "speed", "heading", "dt", F.when(k == 0, F.col("new_speed")).otherwise(F.col("speed") + k * 3).alias("cspeed"), (((F.col("event_id") * 41 + k * 77) % 3600).cast("double") / 10).alias("caz"))
    why = D.implausible(F.col("cspeed"), F.col("caz"), F.col("speed"), F.col("heading"), F.col("dt"))
    return c.groupBy("event_id").agg(F.min(F.when(why.isNull(), k)).alias("chosen"))


_W = lambda a: f"((({a}) % 360) + 360) % 360"
_CLIP = lambda d: f"greatest(least({d}, CASE WHEN size >= 30 THEN 8 ELSE 12 END), -(CASE WHEN size >= 30 THEN 8 ELSE 12 END))"


@plans.add("heading_cue", f"""WITH {MATCH_SQL}, h AS (SELECT *, {_TURN.format('heading', 'rival')} AS dr, {_TURN.format('heading', 'az')} AS da, off / 4 AS o, least(peak + 0.4, 1) AS p FROM m)
SELECT event_id, round(CASE WHEN az IS NULL OR abs(o) > 400 OR p < 0.9 THEN {_W('heading')} WHEN NOT ambiguous THEN {_W('az')}
  WHEN rival IS NOT NULL AND p >= 0.92 THEN CASE WHEN abs(dr) < 20 THEN {_W('heading')} ELSE {_W('heading + ' + _CLIP('dr'))} END
  WHEN pslr < 1.5 OR peaks > 1 OR conf < 0.1 THEN {_W('heading')} ELSE {_W('heading + ' + _CLIP('da'))} END, 6) AS heading FROM h""")
def heading_cue(spark, sf_dir):
    m = matches(spark, sf_dir)
    cue = D.heading_cue(F.col("heading"), F.col("az"), F.col("off") / 4, F.least(F.col("peak") + 0.4, F.lit(1.0)), F.col("ambiguous"), F.col("pslr"), F.col("peaks"), F.col("conf"), F.col("size"), F.col("rival"), 2000.0)
    return m.select("event_id", r6(cue).alias("heading"))


@plans.add("window_sizes", f"""WITH {SAMPLES_SQL}, b AS (SELECT event_id, (event_id % 71)::INT AS n, event_id % 2 = 0 AS adaptive FROM samples),
g AS (SELECT event_id, least(60, n) AS s FROM b WHERE adaptive AND n > 0 UNION SELECT event_id, v FROM b, generate_series(20, 60, 10) k(v) WHERE adaptive AND v <= least(60, n) UNION SELECT event_id, 50 FROM b WHERE NOT adaptive AND n >= 50),
a AS (SELECT event_id, list(s::INT ORDER BY s) AS sizes FROM g GROUP BY event_id)
SELECT b.event_id, coalesce(a.sizes, []::INT[]) AS sizes, CASE WHEN n >= 50 THEN [20, 30, 40]::INT[] ELSE []::INT[] END AS probes FROM b LEFT JOIN a USING (event_id)""")
def window_sizes(spark, sf_dir):
    n = (F.col("event_id") % 71).cast("int")
    sizes = D.window_sizes(50, n, F.col("event_id") % 2 == 0, 20, 60, 10)
    return samples(spark, sf_dir).select("event_id", sizes.alias("sizes"), D.probe_sizes(50, 10, n).alias("probes"))


_RANK = "3 * informative::INT + 2 * reliable::INT - ambiguous::INT - flat::INT"


@plans.add("best_window", f"WITH {MATCH_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_RANK} DESC, round(peak + conf + hint, 9) DESC, size, event_id) AS i FROM m) SELECT user_id, event_id, size FROM k WHERE i = 1")
def best_window(spark, sf_dir):
    b = lambda c: F.col(c).cast("int")
    rank = b("informative") * 3 + b("reliable") * 2 - b("ambiguous") - b("flat")
    key = F.struct(rank.alias("a"), F.round(F.col("peak") + F.col("conf") + F.col("hint"), 9).alias("b"), (-F.col("size")).alias("c"), (-F.col("event_id")).alias("d"))
    return matches(spark, sf_dir).groupBy("user_id").agg(F.max(key).alias("k")).select("user_id", (-F.col("k.d")).alias("event_id"), (-F.col("k.c")).alias("size"))


_OVERRIDE = f"""WITH {MATCH_SQL}, e AS (SELECT * FROM m WHERE az IS NOT NULL),
base AS (SELECT user_id, min_by(struct_pack(peak := peak, conf := conf, pslr := pslr, az := az, ambiguous := ambiguous, reliable := reliable, ok := NOT flat AND informative, delta := abs({_TURN.format('heading', 'az')})), event_id) AS b FROM e WHERE size = 50 GROUP BY user_id),
turning AS (SELECT * FROM base WHERE b.ok AND b.reliable AND (b.delta BETWEEN 5 AND 45 AND (b.ambiguous OR b.pslr < 4 OR b.conf < 0.03) OR NOT b.ambiguous AND b.delta BETWEEN 5 AND 35)),
c AS (SELECT e.*, b FROM e JOIN turning USING (user_id) WHERE e.size < 50 AND e.informative AND e.reliable AND NOT e.ambiguous AND NOT e.flat AND e.peak >= greatest(b.peak - 0.05, 0) AND e.conf >= greatest(b.conf * 0.75, 0.02)
  AND (abs({_TURN.format('b.az', 'e.az')}) >= 10 OR e.pslr >= b.pslr + 0.75 OR e.conf >= greatest(b.conf * 1.5, 0.05))),
best AS (SELECT *, max(struct_pack(a := pslr, b := peak, c := conf)) OVER (PARTITION BY user_id) AS s FROM c),
near AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN b.pslr < 2 THEN size END, CASE WHEN b.pslr < 2 THEN 0 ELSE -pslr END, CASE WHEN b.pslr < 2 THEN 0 ELSE -peak END, CASE WHEN b.pslr < 2 THEN 0 ELSE -conf END, size, event_id) AS i
  FROM best WHERE b.pslr >= 2 OR (pslr >= s.a - 0.75 AND peak >= s.b - 0.03 AND conf >= greatest(s.c * 0.75, 0.02)))
SELECT user_id, event_id, size FROM near WHERE i = 1"""


@plans.add("turn_override", _OVERRIDE)
def turn_override(spark, sf_dir):
    """A shorter window in place of the full one that seems to straddle a turn."""
    e = matches(spark, sf_dir).where("az is not null")
    base = e.where("size = 50").groupBy("user_id").agg(F.min_by(F.struct("peak", "conf", "pslr", "az", "ambiguous", "reliable", (~F.col("flat") & F.col("informative")).alias("ok"), F.abs(angles.turn(F.col("heading"), F.col("az"))).alias("delta")), "event_id").alias("b"))
    b = lambda n: F.col(f"b.{n}")
    unsure = b("delta").between(5, 45) & (b("ambiguous") | (b("pslr") < 4) | (b("conf") < 0.03))
    turning = base.where(b("ok") & b("reliable") & (unsure | (~b("ambiguous") & b("delta").between(5, 35))))
    tells = (F.abs(angles.turn(b("az"), F.col("az"))) >= 10) | (F.col("pslr") >= b("pslr") + 0.75) | (F.col("conf") >= F.greatest(b("conf") * 1.5, F.lit(0.05)))
    c = e.join(turning, "user_id").where((F.col("size") < 50) & F.col("informative") & F.col("reliable") & ~F.col("ambiguous") & ~F.col("flat") & (F.col("peak") >= F.greatest(b("peak") - 0.05, F.lit(0.0))) & (F.col("conf") >= F.greatest(b("conf") * 0.75, F.lit(0.02))) & tells)
    s = F.max(F.struct("pslr", "peak", "conf")).over(W.partitionBy("user_id"))
    weak = b("pslr") < 2
    near = c.withColumn("s", s).where(~weak | ((F.col("pslr") >= F.col("s.pslr") - 0.75) & (F.col("peak") >= F.col("s.peak") - 0.03) & (F.col("conf") >= F.greatest(F.col("s.conf") * 0.75, F.lit(0.02)))))
    strong = lambda x: F.when(weak, 0.0).otherwise(-F.col(x))
    order = W.partitionBy("user_id").orderBy(F.when(weak, F.col("size")).asc_nulls_last(), strong("pslr"), strong("peak"), strong("conf"), "size", "event_id")
    return near.withColumn("i", F.row_number().over(order)).where("i = 1").select("user_id", "event_id", "size")


@plans.add("tail_trim", f"WITH {MATCH_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pslr DESC, peak DESC, size, event_id) AS i FROM m WHERE size IN (20, 30) AND informative AND reliable AND NOT flat) SELECT user_id, event_id, size FROM k WHERE i = 1")
def tail_trim(spark, sf_dir):
    """Of the matches of a window's last 20 or 30 samples the clearest."""
    key = F.struct("pslr", "peak", (-F.col("size")).alias("size"), (-F.col("event_id")).alias("id"))
    k = matches(spark, sf_dir).where("size in (20, 30) and informative and reliable and not flat").groupBy("user_id").agg(F.max(key).alias("k"))
    return k.select("user_id", (-F.col("k.id")).alias("event_id"), (-F.col("k.size")).alias("size"))


_NEARBY = f"""{MATCH_SQL}, around AS (SELECT event_id, heading, i * 180 AS east, j * 180 AS north, (event_id * 7 + i * 31 + j * 17 + 100) % 100 AS q, ((event_id * 19 + i * 400 + j * 900 + 3600) % 3600)::DOUBLE / 10 AS az2, abs(off) AS aoff FROM m, generate_series(-1, 1) a(i), generate_series(-1, 1) b(j)),
scored AS (SELECT *, q >= 40 AS rel, q % 3 <> 0 AS inf, round(q::DOUBLE / 100 + 0.05 * greatest(q % 7 - 2, 0) - 0.35 * least(abs({_TURN.format('heading', 'az2')}) / 90, 1), 9) AS s FROM around)"""


@plans.add("local_reacquisition", f"WITH {_NEARBY}, k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rel DESC, inf DESC, s DESC, aoff, east, north) AS i FROM scored) SELECT event_id, east::INT AS east, north::INT AS north, s AS score FROM k WHERE i = 1")
def local_reacquisition(spark, sf_dir):
    """Nine centres around the predicted place of every match; the best by reliability, information, score and offset."""
    grid = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = matches(spark, sf_dir).select("event_id", "heading", F.abs("off").alias("aoff"), F.inline(grid))
    q = (F.col("event_id") * 7 + F.col("i") * 31 + F.col("j") * 17 + 100) % 100
    az = ((F.col("event_id") * 19 + F.col("i") * 400 + F.col("j") * 900 + 3600) % 3600).cast("double") / 10
    a = a.withColumn("q", q)
    s = F.round(F.col("q").cast("double") / 100 + F.greatest(F.col("q") % 7 - 2, F.lit(0)) * 0.05 - F.least(F.abs(angles.turn(F.col("heading"), az)) / 90, F.lit(1.0)) * 0.35, 9)
    key = F.struct((F.col("q") >= 40).alias("rel"), (F.col("q") % 3 != 0).alias("inf"), s.alias("s"), (-F.col("aoff")).alias("o"), (F.col("i") * -180).alias("east"), (F.col("j") * -180).alias("north"))
    return a.groupBy("event_id").agg(F.max(key).alias("k")).select("event_id", (-F.col("k.east")).alias("east"), (-F.col("k.north")).alias("north"), F.col("k.s").alias("score"))


_CLEAN = "informative AND NOT flat AND reliable AND az IS NOT NULL AND abs(off) <= 1500 AND pslr >= 3 AND peak >= 0.85 AND conf >= 0.05"
_STATE = "struct_pack(ambiguous := false, clean := false, az := {2}, off := {3}, pending := {0}, stable := {1}, holds := {4})"


def _tracker_sql() -> str:
    null = "NULL::DOUBLE"
    held, same = "s.holds + 1", "s.holds"
    agrees = f"s.stable > 0 AND abs({_TURN.format('s.az', 'w.az')}) <= 12 AND abs(s.off - w.off) <= 180"
    step = f"""CASE WHEN w.ambiguous THEN {_STATE.format('true', '0', null, null, same)} WHEN NOT s.pending THEN s WHEN NOT w.clean THEN {_STATE.format('true', '0', null, null, held)}
      WHEN coalesce({agrees}, false) AND s.stable + 1 >= 2 THEN {_STATE.format('false', '0', null, null, same)} ELSE {_STATE.format('true', '1', 'w.az', 'w.off', held)} END"""
    return f"""WITH {MATCH_SQL}, smooth AS (SELECT *, az - event_id % 5 * 2 AS saz FROM m), l AS (SELECT user_id, list(struct_pack(ambiguous := event_id % 4 = 0, clean := event_id % 3 <> 0, az := (user_id * 10 + event_id % 4 * 5)::DOUBLE, off := (event_id % 3 * 60)::DOUBLE, pending := false, stable := 0, holds := 0) ORDER BY ts, event_id) AS ws FROM smooth GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_prepend({_STATE.format('false', '0', null, null, '0')}, ws), lambda s, w: {step}) AS f FROM l)
SELECT user_id, f.pending AS pending, f.stable::INT AS stable, round(f.az, 6) AS az, round(f.off, 6) AS off, f.holds::INT AS holds FROM r"""


@plans.add("reacquisition_tracker", _tracker_sql())
def reacquisition_tracker(spark, sf_dir):
    """The state of each vehicle's tracker after all its windows, folded in order."""
    i = F.col("event_id")
    w = F.struct("ts", "event_id", (i % 4 == 0).alias("ambiguous"), (i % 3 != 0).alias("clean"), (F.col("user_id") * 10 + i % 4 * 5).cast("double").alias("az"), (i % 3 * 60).cast("double").alias("off"))
    f = matches(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(w)).alias("ws")).select("user_id", D.track_reacquisition(F.col("ws")).alias("f"))
    return f.select("user_id", "f.pending", "f.stable", r6("f.az").alias("az"), r6("f.off").alias("off"), "f.holds")


@plans.add("azimuth_band", f"WITH {MATCH_SQL}, b AS (SELECT event_id, a, abs({_TURN.format('heading', 'a')}) <= 25 AS near FROM m, generate_series(0, 345, 15) g(a)) SELECT event_id, a::INT AS azimuth FROM b WHERE near")
def azimuth_band(spark, sf_dir, half: float = 25.0):
    """Reference bearings within 25 degrees of the expected heading, for every match."""
    a = F.explode(F.sequence(F.lit(0), F.lit(345), F.lit(15)))
    return matches(spark, sf_dir).select("event_id", "heading", a.alias("azimuth")).where(F.abs(angles.turn(F.col("heading"), F.col("azimuth"))) <= half).select("event_id", "azimuth")


@plans.add("distinct_candidates", f"WITH {MATCH_SQL} SELECT DISTINCT user_id, round(az, 0) AS az_key, round(off / 100, 0) AS off_key FROM m WHERE peak >= 0.5 AND az IS NOT NULL")
def distinct_candidates(spark, sf_dir):
    """Candidates once for each rounded bearing and offset."""
    return matches(spark, sf_dir).where("peak >= 0.5 and az is not null").select("user_id", F.round("az", 0).alias("az_key"), F.round(F.col("off") / 100, 0).alias("off_key")).distinct()


@plans.add("motion_state_update", f"WITH {MATCH_SQL} SELECT event_id, CASE WHEN reliable THEN new_speed ELSE speed END AS speed, coalesce(az, heading) AS heading FROM m")
def motion_state_update(spark, sf_dir):
    """Speed and heading for the next window: an accepted fix gives both, a predicted one its heading only."""
    return matches(spark, sf_dir).select("event_id", F.when(F.col("reliable"), F.col("new_speed")).otherwise(F.col("speed")).alias("speed"), F.coalesce("az", "heading").alias("heading"))


_SOLVE = f"""WITH {MATCH_SQL}, s AS (SELECT event_id, user_id, ts, (event_id % 50)::DOUBLE * 100 AS se, (event_id % 70)::DOUBLE * 90 AS sn, az, abs(off) AS o, speed * 19 AS span, CASE WHEN event_id % 31 = 0 THEN 0.0::DOUBLE ELSE 19.0::DOUBLE END AS dur, dt FROM m),
p AS (SELECT *, az IS NOT NULL AND dur > 0 AS has, se + (o + span) * sin(radians(az)) AS fe, sn + (o + span) * cos(radians(az)) AS fn, sum(dt) OVER w AS t FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, lag(fe) OVER w AS be, lag(fn) OVER w AS bn, lag(t) OVER w AS bt, first_value(t) OVER w AS t0 FROM p WHERE has WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT p.event_id, round(l.fe, 5) AS fix_east, round(l.fn, 5) AS fix_north, round(l.t - l.t0, 6) AS fix_t, round(CASE WHEN l.bt IS NULL THEN l.span / l.dur ELSE sqrt(power(l.fe - l.be, 2) + power(l.fn - l.bn, 2)) / (l.t - l.bt) END, 5) AS fix_speed,
  round(((CASE WHEN l.bt IS NULL THEN l.az ELSE degrees(atan2(l.fe - l.be, l.fn - l.bn)) END % 360) + 360) % 360, 5) AS fix_heading FROM p LEFT JOIN l USING (event_id)"""


@plans.add("position_solve", _SOLVE)
def position_solve(spark, sf_dir):
    """Fixes of every match from its start, bearing and offset, with speed and heading from the fix before."""
    i = F.col("event_id")
    m = matches(spark, sf_dir).select("event_id", "user_id", "ts", ((i % 50).cast("double") * 100).alias("start_east"), ((i % 70).cast("double") * 90).alias("start_north"), F.col("az").alias("azimuth"), F.abs("off").alias("offset_m"), (F.col("speed") * 19).alias("span_m"), F.when(i % 31 == 0, 0.0).otherwise(19.0).alias("duration_s"), F.col("dt").alias("dt_s"))
    f = O.position_solve(m, ["user_id"], ["ts", "event_id"])
    return f.select("event_id", F.round("fix_east", 5).alias("fix_east"), F.round("fix_north", 5).alias("fix_north"), r6("fix_t").alias("fix_t"), F.round("fix_speed", 5).alias("fix_speed"), F.round("fix_heading", 5).alias("fix_heading"))
