"""Queries: islands, smoothing and other ordered operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ordered import keep_spaced
from ..operators import windows as op
from .joins import BEATS_SQL, beats
from .registry import query

LAGS = 'SELECT *, lag(speaker) OVER w AS ps, lag("end") OVER w AS pe FROM segments WINDOW w AS (PARTITION BY job_id ORDER BY seg_idx)'


def samples(v, value="value"):
    """Readings as a generic sampled series."""
    return v.readings.select("job_id", "t", F.col("event_id").alias("sample_id"), F.expr(value).alias("value"))


def path(v):
    return v.readings.select("job_id", "t", F.col("event_id").alias("sample_id"), (F.col("value") % 50).alias("x"), (F.col("value") * 3 % 50).alias("y"))


def kept_sql(src, gap, cond=None):
    """Greedy spacing as recursive SQL over src(job_id, t, id)."""
    far = cond or f"o.t - k.last >= {gap}"
    return f"""o AS (SELECT job_id, t, id, row_number() OVER (PARTITION BY job_id ORDER BY t, id) AS rn FROM {src}),
k AS (SELECT job_id, t, id, rn, t AS last, true AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.job_id, o.t, o.id, o.rn, CASE WHEN {far} THEN o.t ELSE k.last END, {far} FROM k JOIN o ON o.job_id = k.job_id AND o.rn = k.rn + 1)"""


@query("win1_natural_boundaries", f"""WITH l AS ({LAGS}) SELECT job_id, seg_idx, start FROM l WHERE ps <> speaker OR start - pe > 1.5""")
def _(v):
    return op.natural_boundaries(v.segments)


ENERGY = [
    ("emphasis", "contains(tx, '!')"), ("question", "contains(tx, '?')"),
    ("raised_voice", r"len(list_filter(ws, lambda w: w = upper(w) AND length(w) > 2 AND regexp_full_match(w, '\pL+'))) > 0"),
    ("rapid_exchange", "start - pe < 0.5 AND len(ws) < 15"), ("speaker_change", "speaker <> ps"), ("extended_speech", "len(ws) > 50"),
] + [(k, " OR ".join("contains(lower(tx), '%s')" % p.replace("'", "''") for p in op.SIGNAL_PHRASES[k])) for k in ("reaction", "disagreement", "personal_story", "reveal")] + [
    ("ranking", "regexp_matches(lower(tx), 'number [1-9]|#[1-9]')"), ("hot_take", " OR ".join(f"contains(lower(tx), '{p}')" for p in op.SIGNAL_PHRASES["hot_take"])),
    ("low_confidence", "confidence < 0.4"),
]


@query("win2_energy_signals", f"""
WITH l AS ({LAGS}), w AS (SELECT *, trim(text) AS tx, toks AS ws FROM l),
s AS (SELECT job_id, seg_idx, start, concat_ws(', ', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in ENERGY)}) AS signals FROM w WHERE tx <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seg_idx) AS n FROM s WHERE signals <> '') SELECT job_id, seg_idx, start, signals FROM r WHERE n <= 30""")
def _(v):
    return op.energy_signals(v.segments)


FILLERS = ("the", "der", "le", "of", "to")


@query("win3_filler_events", f"""
WITH l AS ({LAGS}), w AS (SELECT *, list_transform(toks, lambda x: lower(x)) AS lw FROM segments),
r AS (SELECT job_id, seg_idx, start, "end", list_filter(list_zip(lw[1:-2], lw[2:]), lambda p: p[1] = p[2] AND length(p[1]) > 1) AS tw FROM w WHERE len(lw) > 1 AND lower(trim(text)) NOT IN {FILLERS})
SELECT job_id, seg_idx, start, "end", 'filler' AS type, trim(text) AS text FROM segments WHERE lower(trim(text)) IN {FILLERS}
UNION ALL SELECT job_id, seg_idx, start, "end", 'filler', word FROM words WHERE rtrim(lower(word), '.,!?') IN ('um', 'uh', 'hmm', 'huh')
UNION ALL SELECT job_id, seg_idx, start, "end", 'repetition', tw[1][1] || ' ' || tw[1][2] FROM r WHERE len(tw) > 0
UNION ALL SELECT job_id, seg_idx, pe, start, 'dead_air', printf('%.1fs silence', start - pe) FROM l WHERE start - pe > 1.5""")
def _(v):
    return op.filler_events(v.segments, v.words, FILLERS)


RUNS = """c AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS ch FROM segments WINDOW w AS (PARTITION BY job_id ORDER BY seg_idx)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY job_id ORDER BY seg_idx) AS run FROM c)"""


@query("win4_speaker_hold_boundaries", f"""
WITH {RUNS}, g AS (SELECT job_id, run, min(start) AS s FROM r GROUP BY 1, 2), l AS (SELECT *, lag(s) OVER (PARTITION BY job_id ORDER BY run) AS ps FROM g)
SELECT job_id, round(s, 1) AS t FROM l WHERE s - ps >= 20""")
def _(v):
    return op.speaker_hold_boundaries(v.segments)


@query("win5_merged_turns", f"""
WITH {RUNS.replace("FROM segments", "FROM (SELECT * REPLACE (CASE WHEN seg_idx % 3 = 0 THEN 'user' ELSE 'assistant' END AS speaker) FROM segments)")},
n AS (SELECT *, row_number() OVER (PARTITION BY job_id, run ORDER BY seg_idx) AS n, count(*) OVER (PARTITION BY job_id, run) AS k, CASE WHEN confidence = 0 THEN 1.0 ELSE confidence END AS cf FROM r)
SELECT job_id, speaker, min(start) AS start, max("end") AS "end", string_agg(text, ' ' ORDER BY seg_idx) AS text,
  round(CASE WHEN count(*) = 1 THEN max(cf) ELSE list_reduce(list(cf ORDER BY seg_idx), lambda a, b: (a + b) / 2) END, 6) AS confidence FROM n GROUP BY job_id, run, speaker""")
def _(v):
    d = op.merged_turns(v.segments.withColumn("speaker", F.when(F.col("seg_idx") % 3 == 0, "user").otherwise("assistant")))
    return d.drop("run").withColumn("confidence", F.round("confidence", 6))


SLOTTED = "(SELECT job_id, seg_idx AS event_id, start, \"end\", CAST(CASE WHEN seg_idx % 3 = 0 THEN 0 WHEN seg_idx % 7 = 6 THEN -1 ELSE 1 END AS BIGINT) AS slot_id, confidence FROM segments)"
MERGED = f"""e AS (SELECT *, lag(slot_id) OVER w AS ps, lag("end") OVER w AS pe FROM {SLOTTED} WINDOW w AS (PARTITION BY job_id ORDER BY start, event_id)),
er AS (SELECT *, sum(CASE WHEN ps IS NULL OR (ps = slot_id AND start - pe < {{gap}}) THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY start, event_id) AS run FROM e),
mg AS (SELECT job_id, run, slot_id, min(start) AS start, max("end") AS "end", max(confidence) AS confidence FROM er GROUP BY 1, 2, 3)"""


def slotted(v):
    slot = F.when(F.col("seg_idx") % 3 == 0, 0).when(F.col("seg_idx") % 7 == 6, -1).otherwise(1).cast("long")
    return v.segments.select("job_id", F.col("seg_idx").alias("event_id"), "start", "end", slot.alias("slot_id"), "confidence")


@query("win6_merge_slot_events", f"WITH {MERGED.format(gap=3)} SELECT job_id, slot_id, start, \"end\", confidence FROM mg")
def _(v):
    return op.merge_slot_events(slotted(v), 3.0).drop("run")


@query("win6_hysteresis", f"""
WITH RECURSIVE {MERGED.format(gap=3)}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start, run) AS rn FROM mg),
h AS (SELECT job_id, rn, 1 AS grp, start, "end", slot_id, confidence FROM o WHERE rn = 1
UNION ALL SELECT o.job_id, o.rn, CASE WHEN a THEN h.grp + 1 ELSE h.grp END, CASE WHEN a THEN o.start ELSE h.start END, o."end", CASE WHEN a THEN o.slot_id ELSE h.slot_id END,
  CASE WHEN a THEN o.confidence WHEN o.slot_id = h.slot_id THEN greatest(h.confidence, o.confidence) ELSE h.confidence * 0.95 END
FROM h JOIN o ON o.job_id = h.job_id AND o.rn = h.rn + 1, LATERAL (SELECT o.slot_id <> h.slot_id AND (o.slot_id < 0 OR o.confidence >= 0.7 OR h.confidence < 0.3) AS a) x)
SELECT job_id, start, "end", slot_id, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY job_id, grp ORDER BY rn DESC) AS z FROM h) WHERE z = 1""")
def _(v):
    return op.hysteresis(op.merge_slot_events(slotted(v), 3.0)).withColumn("confidence", F.round("confidence", 6))


@query("win7_collapse_short_runs")
def _(v):
    return op.collapse_short_runs(slotted(v), dwell=12.0)


OKRUN = """a AS (SELECT job_id, t, event_id AS id, {value} AS value, coalesce({ok}, false) AS ok FROM {src}),
b AS (SELECT *, lag(ok) OVER w AS pk, lag(t) OVER w AS pt FROM a WINDOW w AS (PARTITION BY job_id ORDER BY t, id)),
c AS (SELECT *, sum(CASE WHEN pk IS NULL OR (pk = ok {gap}) THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY t, id) AS run FROM b),
g AS (SELECT job_id, run, min(t) AS start, max(t) AS "end", min(value) AS low, avg(value) AS mean, count(*) AS n FROM c WHERE ok GROUP BY 1, 2)"""


@query("win8_ambiguous_windows", f"""
WITH {OKRUN.format(value="value / 100", ok="value / 100 < 0.4", src="readings", gap="AND t - pt <= 1.0")}
SELECT job_id, start, "end", low, (start + "end") / 2 AS midpoint FROM g WHERE "end" - start >= 0.5""")
def _(v):
    return op.ambiguous_windows(samples(v, "value / 100"), 0.4).drop("run")


@query("win9_tiebreak", """
WITH d AS (SELECT event_id, event_id % 3 AS h, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 5 END AS det, CASE WHEN event_id % 7 < 3 THEN NULL ELSE event_id % 11 END AS m, value / 100 AS c FROM readings)
SELECT event_id, CASE WHEN det = h THEN h WHEN m IS NOT NULL THEN m ELSE h END AS choice, CASE WHEN det = h THEN 'lightasd_agrees' WHEN m IS NOT NULL THEN 'vlm_tiebreak' ELSE 'heuristic' END AS source,
  round(CASE WHEN det = h THEN least(1.0, c + 0.6) WHEN m IS NOT NULL AND det IS NOT NULL THEN 0.8 WHEN m IS NOT NULL THEN 0.7 ELSE c END, 6) AS confidence FROM d""")
def _(v):
    e = F.col("event_id")
    pick = op.tiebreak(e % 3, F.when(e % 4 != 0, e % 5), F.when(e % 7 >= 3, e % 11), F.col("value") / 100)
    return v.readings.select("event_id", pick.alias("p")).select("event_id", "p.choice", "p.source", F.round("p.confidence", 6).alias("confidence"))


@query("win10_difference_spikes", f"""
WITH RECURSIVE s AS (SELECT job_id, t, event_id AS id FROM readings), {kept_sql("s", 1.0)},
z AS (SELECT k.job_id, k.t, k.id AS event_id, abs(r.value - lag(r.value) OVER (PARTITION BY k.job_id ORDER BY k.t, k.id)) AS value FROM k JOIN readings r ON r.event_id = k.id WHERE kept),
zz AS (SELECT * FROM z WHERE value IS NOT NULL), {OKRUN.format(value="value", ok="value >= 20", src="zz", gap="")}
SELECT job_id, start, "end" FROM g WHERE "end" - start >= 1.5""")
def _(v):
    return op.difference_spikes(samples(v), 20.0, 1.5, 1.0)


@query("win11_low_score_windows", f"""
WITH q AS (SELECT * FROM readings WHERE value % 10 < 6), {OKRUN.format(value="value % 10", ok="true", src="q", gap="AND t - pt <= 1.5")}
SELECT job_id, start, "end", round(mean, 6) AS mean, CASE WHEN mean < 3 THEN 'blur_fill' WHEN mean < 4.5 THEN 'widen' WHEN mean < 5.5 THEN 'more_padding' ELSE 'hold' END AS action FROM g""")
def _(v):
    return op.low_score_windows(samples(v, "value % 10"), 6.0, 1.5).withColumn("mean", F.round("mean", 6))


PATH = """p AS (SELECT job_id, t, event_id AS id, value % 50 AS x, value * 3 % 50 AS y FROM readings),
v AS (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY job_id ORDER BY t, id)),
sp AS (SELECT *, sqrt(power(x - px, 2) + power(y - py, 2)) / greatest(t - pt, 1e-6) AS speed, abs(x - px) / greatest(t - pt, 1e-6) AS x_speed FROM v WHERE pt IS NOT NULL)"""


@query("win12_still_windows", f"""
WITH {PATH}, a AS (SELECT *, speed <= 15 AS slow FROM sp), b AS (SELECT *, lag(slow) OVER (PARTITION BY job_id ORDER BY t, id) AS pk FROM a),
c AS (SELECT *, sum(CASE WHEN pk = slow OR pk IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY t, id) AS run FROM b)
SELECT job_id, min(pt) AS start, max(t) AS "end" FROM c WHERE slow GROUP BY job_id, run HAVING max(t) - min(pt) >= 0.5""")
def _(v):
    return op.still_windows(path(v), 15.0).select("job_id", "start", "end")


@query("win12_lock_events")
def _(v):
    env = v.readings.select("job_id", "t", F.col("value").alias("energy"))
    return op.lock_events(path(v), env, still=15.0)


@query("win12_swing_filter", """
WITH e AS (SELECT job_id, event_id, t, CASE WHEN event_id % 2 = 0 THEN 'kill' ELSE 'ult' END AS kind FROM readings WHERE kind = 'click'),
p AS (SELECT job_id, t, max(struct_pack(x := value % 50, y := value * 3 % 50)) AS p FROM readings WHERE kind = 'view' GROUP BY 1, 2),
b AS (SELECT e.*, (SELECT struct_pack(t := p.t, p := p.p) FROM p WHERE p.job_id = e.job_id AND p.t <= e.t ORDER BY p.t DESC LIMIT 1) AS bf, (SELECT struct_pack(t := p.t, p := p.p) FROM p WHERE p.job_id = e.job_id AND p.t > e.t ORDER BY p.t LIMIT 1) AS af FROM e)
SELECT event_id, kind FROM b WHERE kind <> 'kill' OR bf IS NULL OR af IS NULL OR sqrt(power(af.p.x - bf.p.x, 2) + power(af.p.y - bf.p.y, 2)) / greatest(af.t - bf.t, 1e-6) <= 20""")
def _(v):
    e = v.readings.where("kind = 'click'").select("job_id", "event_id", "t", F.when(F.col("event_id") % 2 == 0, "kill").otherwise("ult").alias("kind"))
    p = v.readings.where("kind = 'view'").select("job_id", "t", (F.col("value") % 50).alias("x"), (F.col("value") * 3 % 50).alias("y"))
    return op.without_swing_kills(e, p).select("event_id", "kind")


@query("win12_top_speed", f"WITH {PATH} SELECT job_id, round(max(x_speed), 4) AS top FROM sp GROUP BY 1")
def _(v):
    return op.speeds(path(v)).groupBy("job_id").agg(F.round(F.max("x_speed"), 4).alias("top"))


@query("win13_merge_close", f"""
WITH RECURSIVE s AS (SELECT job_id, t, event_id AS id FROM readings), {kept_sql("s", 0, "o.t - k.last > 1.5")},
a AS (SELECT k.*, sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY k.job_id ORDER BY k.rn) AS grp, r.kind, r.value / 100 AS conf, r.event_id % 5 * 0.25 AS len FROM k JOIN readings r ON r.event_id = k.id)
SELECT job_id, arg_min(id, rn) AS event_id, count(*) AS n, min(t) AS t, CASE WHEN count(*) = 1 THEN min(len) ELSE greatest(max(t + len) - min(t), 0.8) END AS event_len,
  CASE WHEN count(*) = 1 THEN min(kind) ELSE 'chaos' END AS kind, max(conf) AS confidence, CASE WHEN count(*) > 1 THEN 'merged:' || array_to_string(list_sort(list(DISTINCT kind)), '+') END AS source FROM a GROUP BY job_id, grp""")
def _(v):
    e = v.readings.select("job_id", "event_id", "t", "kind", (F.col("value") / 100).alias("confidence"), (F.col("event_id") % 5 * 0.25).alias("event_len"))
    return op.merge_close(e)


@query("win14_adjacent_overlaps", """
WITH l AS (SELECT *, lead(start) OVER (PARTITION BY job_id ORDER BY start, seg_key) AS ns FROM crop_segments) SELECT seg_key, round("end" - ns, 6) AS overlap FROM l WHERE "end" > ns + 1e-9""")
def _(v):
    return op.adjacent_overlaps(v.crop_segments, ["job_id"], ["start", "seg_key"]).select("seg_key", F.round("overlap", 6).alias("overlap"))


@query("win15_smoothness", """
WITH l AS (SELECT job_id, value AS x, lag(value) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS c FROM readings WINDOW w AS (PARTITION BY job_id ORDER BY t, event_id))
SELECT job_id, round(coalesce(max(abs(x - 2 * a + b)), 0), 6) AS max_acceleration, round(coalesce(max(abs(x - 3 * a + 3 * b - c)), 0), 6) AS max_jerk FROM l GROUP BY 1""")
def _(v):
    d = op.smoothness(samples(v).withColumnRenamed("value", "x"))
    return d.select("job_id", F.round("max_acceleration", 6).alias("max_acceleration"), F.round("max_jerk", 6).alias("max_jerk"))


@query("win16_switch_times", """
WITH l AS (SELECT *, lag(active_slot) OVER w AS ps, row_number() OVER w AS rn FROM crop_segments WINDOW w AS (PARTITION BY job_id ORDER BY start, seg_key)) SELECT seg_key, start AS t FROM l WHERE rn > 1 AND ps IS DISTINCT FROM active_slot""")
def _(v):
    return op.switch_times(v.crop_segments, "seg_key").select("seg_key", "t")


@query("win16_boundaries", "SELECT seg_key, start AS t FROM crop_segments WHERE start > 0")
def _(v):
    return op.boundaries(v.crop_segments, "seg_key").select("seg_key", "t")


@query("win16_jump_cuts", f"WITH {PATH} SELECT id AS sample_id, t FROM v WHERE sqrt(power(x / 100 - px / 100, 2) + power(y / 100 - py / 100, 2)) > 0.3")
def _(v):
    p = path(v).withColumns({"x": F.col("x") / 100, "y": F.col("y") / 100})
    return op.jump_cuts(p, 0.3).select("sample_id", "t")


def _pacing_inputs(v):
    jobs = v.moments.select("job_id").distinct().withColumn("duration", F.lit(60.0) + F.col("job_id") % 9 * 0.5)
    grid = op.second_grid(jobs)
    ev = v.readings.select("job_id", F.col("t").alias("start"), "event_id", (F.col("event_id") % 3).alias("slot_id"))
    rms = v.readings.select("job_id", F.floor(F.col("t") * 4).alias("bucket"), F.col("value").alias("rms"))
    signals = [op.cuts_per_second(v.readings.where("kind = 'view'")), op.turns_per_second(ev),
               op.motion_per_second(v.faces, grid.select("job_id", "n_sec").distinct()), op.audio_per_second(rms)]
    return grid, signals


PACING_SQL = """
jb AS (SELECT DISTINCT job_id, greatest(1, CAST(round_even(60.0 + job_id % 9 * 0.5, 0) AS BIGINT)) AS n FROM moments),
gr AS (SELECT job_id, n, unnest(range(n)) AS sec FROM jb),
s1 AS (SELECT job_id, CAST(floor(t) AS BIGINT) AS sec, count(*) AS cuts FROM readings WHERE kind = 'view' GROUP BY 1, 2),
s2 AS (SELECT job_id, CAST(floor(t) AS BIGINT) AS sec, count(*) AS turns FROM (SELECT job_id, t, event_id % 3 AS s, lag(event_id % 3) OVER (PARTITION BY job_id ORDER BY t, event_id) AS p FROM readings) WHERE s <> p GROUP BY 1, 2),
mx AS (SELECT f.job_id, CAST(f.t AS BIGINT) AS sec, avg(x) AS x FROM faces f JOIN jb USING (job_id) WHERE f.t < n GROUP BY 1, 2),
md AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY job_id ORDER BY sec)) AS d FROM mx),
mq AS (SELECT job_id, quantile_cont(d, 0.95) AS q FROM md WHERE d > 0 GROUP BY 1),
s3 AS (SELECT job_id, sec, CASE WHEN q > 0 THEN least(1.0, coalesce(d, 0) / q) ELSE 0.0 END AS motion FROM md LEFT JOIN mq USING (job_id)),
s4 AS (SELECT job_id, CAST(floor(floor(t * 4) / 4) AS BIGINT) AS sec, CASE WHEN avg(value) > 1e-6 THEN stddev_pop(value) / avg(value) ELSE 0.0 END AS audio FROM readings GROUP BY 1, 2)"""


@query("win18_second_signals", f"""
WITH {PACING_SQL} SELECT job_id, sec, coalesce(cuts, 0)::DOUBLE AS cuts, coalesce(turns, 0)::DOUBLE AS turns, round(coalesce(audio, 0), 6) AS audio
FROM gr LEFT JOIN s1 USING (job_id, sec) LEFT JOIN s2 USING (job_id, sec) LEFT JOIN s4 USING (job_id, sec)""")
def _(v):
    grid, (cuts, turns, _, audio) = _pacing_inputs(v)
    d = grid.join(cuts, ["job_id", "sec"], "left").join(turns, ["job_id", "sec"], "left").join(audio, ["job_id", "sec"], "left").fillna(0.0)
    return d.select("job_id", "sec", "cuts", "turns", F.round("audio", 6).alias("audio"))


@query("agg39_motion_per_second", f"WITH {PACING_SQL} SELECT job_id, sec, round(motion, 6) AS motion FROM s3")
def _(v):
    return _pacing_inputs(v)[1][2].withColumn("motion", F.round("motion", 6))


PACED = f"""{PACING_SQL},
al AS (SELECT job_id, n, sec, coalesce(cuts, 0) AS cuts, coalesce(turns, 0) AS turns, coalesce(motion, 0) AS motion, coalesce(audio, 0) AS audio FROM gr LEFT JOIN s1 USING (job_id, sec) LEFT JOIN s2 USING (job_id, sec) LEFT JOIN s3 USING (job_id, sec) LEFT JOIN s4 USING (job_id, sec)),
mn AS (SELECT job_id, sec, 0.15 * least(1.0, avg(cuts) OVER w / 2) + 0.25 * least(1.0, avg(turns) OVER w) + 0.35 * least(1.0, avg(motion) OVER w) + 0.25 * least(1.0, avg(audio) OVER w) AS raw
  FROM al WINDOW w AS (PARTITION BY job_id ORDER BY sec ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
md3 AS (SELECT job_id, sec, raw, lag(raw) OVER w AS a, lead(raw) OVER w AS b FROM mn WINDOW w AS (PARTITION BY job_id ORDER BY sec)),
pc AS (SELECT job_id, sec, CASE WHEN a IS NULL OR b IS NULL THEN raw ELSE list_sort([a, raw, b])[2] END AS pacing FROM md3)"""


@query("win17_pacing", f"WITH {PACED} SELECT job_id, sec, round(pacing, 9) AS pacing FROM pc")
def _(v):
    grid, signals = _pacing_inputs(v)
    return op.pacing(grid, signals, op.PACING_WEIGHTS["vlog"]).withColumn("pacing", F.round("pacing", 9))


@query("win19_hold_and_lead", f"WITH {PACED} SELECT job_id, sec, round(2.0 - power(greatest(0, least(1, pacing)), 0.75) * 1.75, 5) AS min_hold, CAST(round_even(400 - round(pacing, 6) * 280, 0) AS BIGINT) AS lead_ms FROM pc")
def _(v):
    grid, signals = _pacing_inputs(v)
    p = op.pacing(grid, signals, op.PACING_WEIGHTS["vlog"])
    return p.select("job_id", "sec", F.round(op.min_hold(F.col("pacing")), 5).alias("min_hold"), op.anticipation_ms(F.round("pacing", 6)).alias("lead_ms"))


LOUD = """bl AS (SELECT job_id, list_sort(list(rms_db))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS base FROM rms WHERE rms_db > -60 GROUP BY 1),
ld AS (SELECT r.*, lag(rms_db) OVER (PARTITION BY r.job_id ORDER BY t, rms_id) AS p FROM rms r),
lm AS (SELECT l.job_id, rms_id, t, 0 AS o, CAST(rms_db AS DOUBLE) AS loudness_db, CAST(rms_db - base AS DOUBLE) AS delta_db, CASE WHEN rms_db - base > 12 THEN 'extreme_spike' ELSE 'volume_spike' END AS type FROM ld l JOIN bl USING (job_id) WHERE rms_db - base > 6
 UNION ALL SELECT l.job_id, rms_id, t, 1, rms_db, rms_db - p, 'silence_to_loud' FROM ld l JOIN bl USING (job_id) WHERE p < base - 10 AND rms_db > base + 6),
lr AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY delta_db DESC, o, t, rms_id) AS rank FROM lm),
lx AS (SELECT job_id, rms_id, t, loudness_db, delta_db, type, rank, CASE WHEN type = 'silence_to_loud' THEN 'applause' WHEN type = 'extreme_spike' AND loudness_db > -8 THEN 'shouting' WHEN type = 'extreme_spike' THEN 'cheering'
  WHEN delta_db > 12 THEN 'cheering' WHEN delta_db > 8 THEN 'laughter' ELSE 'neutral' END AS sentiment FROM lr WHERE rank <= 25)"""


@query("win20_loudness_moments", f"WITH {LOUD} SELECT * FROM lx")
def _(v):
    return op.loudness_moments(v.rms.withColumn("rms_db", F.col("rms_db").cast("double"))).withColumn("rank", F.col("rank").cast("long"))


@query("fn12_sentiment", """
SELECT moment_id, CASE WHEN kind = 'silence_to_loud' THEN 'applause' WHEN kind = 'extreme_spike' AND loudness_db > -8 THEN 'shouting' WHEN kind = 'extreme_spike' THEN 'cheering'
  WHEN kind = 'volume_spike' AND delta_db > 12 THEN 'cheering' WHEN kind = 'volume_spike' AND delta_db > 8 THEN 'laughter' ELSE 'neutral' END AS sentiment
FROM (SELECT moment_id, loudness_db, delta_db, CASE kind WHEN 'spike' THEN 'extreme_spike' WHEN 'loud_moment' THEN 'volume_spike' ELSE kind END AS kind FROM audio_moments)""")
def _(v):
    kind = F.expr("CASE kind WHEN 'spike' THEN 'extreme_spike' WHEN 'loud_moment' THEN 'volume_spike' ELSE kind END")
    return v.audio_moments.select("moment_id", op.sentiment(F.col("loudness_db"), F.col("delta_db"), kind).alias("sentiment"))


@query("win21_rolling_peaks", """
WITH a AS (SELECT job_id, event_id, t, value, CAST(round(t * 1000) AS BIGINT) AS ms FROM readings),
b AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM a WINDOW w AS (PARTITION BY job_id ORDER BY ms RANGE BETWEEN 5000 PRECEDING AND 1 PRECEDING))
SELECT event_id AS sample_id, t FROM b WHERE n >= 3 AND value >= least(CASE WHEN sd > 1e-9 THEN m + 1.2 * sd ELSE 'inf'::DOUBLE END, greatest(m * 2, m + 0.5))""")
def _(v):
    return op.rolling_peaks(samples(v), 5.0, 1.2).select("sample_id", "t")


@query("win22_scene_cut_boundaries", f"""
WITH RECURSIVE s AS (SELECT job_id, t, scene_id AS id FROM scenes WHERE importance >= 6), {kept_sql("s", 120)} SELECT job_id, round(t, 1) AS t FROM k WHERE kept""")
def _(v):
    return op.scene_cut_boundaries(v.scenes, 120.0)


@query("win22_merge_boundaries", f"""
WITH RECURSIVE s AS (SELECT DISTINCT job_id, round(t, 1) AS t, 0 AS id FROM moments), {kept_sql("s", 45)} SELECT job_id, t FROM k WHERE kept""")
def _(v):
    return op.merge_boundaries(v.moments, 45.0)


@query("win22_metric_cuts", f"""
WITH RECURSIVE s AS (SELECT job_id, t, event_id AS id FROM readings WHERE value % 10 / 10 < 0.55 OR value % 7 / 10 > 0.3), {kept_sql("s", 0.3)} SELECT id AS pair_id, t FROM k WHERE kept""")
def _(v):
    p = v.readings.select("job_id", "t", F.col("event_id").alias("pair_id"), (F.col("value") % 10 / 10).alias("hist_corr"), (F.col("value") % 7 / 10).alias("edge_delta"))
    return op.metric_cuts(p).select("pair_id", "t")


EMA = """a AS (SELECT job_id, event_id AS sample_id, value AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY job_id) AS n FROM readings WINDOW w AS (PARTITION BY job_id ORDER BY t, event_id)),
f AS (SELECT y.job_id, y.sample_id, sum(CASE WHEN x.i = 1 THEN 1.0 ELSE 0.3 END * power(0.7, y.i - x.i) * x.v) AS fwd FROM a y JOIN a x ON x.job_id = y.job_id AND x.i <= y.i GROUP BY 1, 2),
r AS (SELECT y.job_id, y.sample_id, sum(CASE WHEN x.i = x.n THEN 1.0 ELSE 0.3 END * power(0.7, x.i - y.i) * x.v) AS bwd FROM a y JOIN a x ON x.job_id = y.job_id AND x.i >= y.i GROUP BY 1, 2)"""


@query("win23_smooth_path", f"WITH {EMA} SELECT sample_id, round(fwd, 6) AS smooth FROM f")
def _(v):
    return op.smooth_path(samples(v), ["value"]).select("sample_id", F.round("value_s", 6).alias("smooth"))


@query("win23_smooth_both_ways", f"WITH {EMA} SELECT f.sample_id, round((fwd + bwd) / 2, 6) AS smooth FROM f JOIN r USING (sample_id)")
def _(v):
    return op.smooth_both_ways(samples(v), "value").select("sample_id", F.round("smooth", 6).alias("smooth"))


@query("win24_resample", """
WITH p AS (SELECT job_id, t, max(struct_pack(v := value, k := kind)) AS p FROM readings WHERE kind <> 'view' GROUP BY 1, 2), g AS (SELECT job_id, event_id, t FROM readings WHERE kind = 'view'),
b AS (SELECT g.*, (SELECT struct_pack(t := p.t, v := p.p.v, k := p.p.k) FROM p WHERE p.job_id = g.job_id AND p.t <= g.t ORDER BY p.t DESC LIMIT 1) AS bf, (SELECT struct_pack(t := p.t, v := p.p.v, k := p.p.k) FROM p WHERE p.job_id = g.job_id AND p.t > g.t ORDER BY p.t LIMIT 1) AS af FROM g),
c AS (SELECT event_id, t, coalesce(bf, af) AS a, coalesce(af, bf) AS z FROM b), d AS (SELECT *, CASE WHEN z.t - a.t <= 1e-9 THEN 0.0 ELSE (t - a.t) / (z.t - a.t) END AS u FROM c WHERE a IS NOT NULL)
SELECT event_id, round((1 - u) * a.v + u * z.v, 6) AS value, CASE WHEN u < 0.5 THEN a.k ELSE z.k END AS kind FROM d""")
def _(v):
    p = v.readings.where("kind <> 'view'").select("job_id", "t", "value", "kind")
    d = op.resample(p, v.readings.where("kind = 'view'").select("job_id", "event_id", "t"), ["value"], ["kind"])
    return d.select("event_id", F.round("value", 6).alias("value"), "kind")


@query("win25_hold_track")
def _(v):
    seen = F.col("event_id") % 3 != 0
    g = v.readings.dropDuplicates(["job_id", "t"]).select("job_id", "t", F.when(seen, F.col("value") % 101).alias("x"), F.when(seen, F.lit(50.0)).alias("y"), F.when(seen, F.lit(0.8)).alias("conf"), F.when(seen, F.lit("face")).alias("source"))
    return op.hold_track(g)


@query("win26_snap_boundaries", f"""
WITH RECURSIVE {BEATS_SQL}, s AS (SELECT job_id, seg_idx AS sid, start, "end", coalesce((SELECT b.beat FROM beats b WHERE b.job_id = segments.job_id AND abs(b.beat - segments.start) <= 2 + 1e-6 ORDER BY abs(b.beat - segments.start), b.beat LIMIT 1), start) AS tt FROM segments WHERE job_id IN (SELECT job_id FROM beats)),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start, sid) AS rn FROM s),
h AS (SELECT job_id, rn, sid, start AS ns, "end", false AS moved FROM o WHERE rn = 1
UNION ALL SELECT o.job_id, o.rn, o.sid, CASE WHEN m THEN tt ELSE o.start END, o."end", m FROM h JOIN o ON o.job_id = h.job_id AND o.rn = h.rn + 1,
 LATERAL (SELECT o.start > 0 AND tt <> o.start AND abs(tt - o.start) < 0.5 * greatest(o."end" - o.start, 0.0001) AND tt - h.ns >= 0.3 AND o."end" - tt >= 0.3 AS m) x)
SELECT job_id, sid AS seg_idx, round(ns, 4) AS start, round(CASE WHEN lead(moved) OVER w THEN lead(ns) OVER w ELSE "end" END, 4) AS "end", moved FROM h WINDOW w AS (PARTITION BY job_id ORDER BY rn)""")
def _(v):
    have = beats(v).select("job_id").distinct()
    d = op.snap_boundaries(v.segments.join(have, "job_id", "left_semi"), beats(v), "seg_idx", 2.0)
    return d.select("job_id", "seg_idx", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "moved")


def merged_modes_sql(source, name):
    """Adjacent segments of one mode as one."""
    return f"""{name}_p AS (SELECT *, lag(mode) OVER (PARTITION BY job_id ORDER BY start) AS pm FROM {source}),
{name}_g AS (SELECT *, sum(CASE WHEN pm = mode THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY start) AS g FROM {name}_p),
{name} AS (SELECT job_id, mode, min(start) AS start, max("end") AS "end" FROM {name}_g GROUP BY job_id, g, mode)"""


@query("win27_stable_layout", f"""
WITH vt AS (SELECT job_id, t AS start, min(CASE WHEN event_id % 4 < 2 THEN 'single' WHEN event_id % 4 = 2 THEN 'split' ELSE 'triple' END) AS mode FROM readings GROUP BY 1, 2),
vs AS (SELECT job_id, mode, start, start AS "end" FROM vt), {merged_modes_sql("vs", "rn")},
sg AS (SELECT job_id, mode, start, coalesce(lead(start) OVER (PARTITION BY job_id ORDER BY start), "end" + 0.5) AS "end" FROM rn),
fg AS (SELECT *, sum(CASE WHEN "end" - start >= 6 OR first THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY start) AS h FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start) = 1 AS first FROM sg)),
fw AS (SELECT job_id, arg_min(mode, start) AS mode, min(start) AS start, max("end") AS "end" FROM fg GROUP BY job_id, h), {merged_modes_sql("fw", "fm")},
bg AS (SELECT *, coalesce(sum(CASE WHEN "end" - start >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM fm),
bw AS (SELECT job_id, arg_max(mode, start) AS mode, min(start) AS start, max("end") AS "end" FROM bg GROUP BY job_id, h), {merged_modes_sql("bw", "bm")}
SELECT job_id, start, "end", mode FROM bm""")
def _(v):
    votes = v.readings.groupBy("job_id", "t").agg(F.min(F.expr("CASE WHEN event_id % 4 < 2 THEN 'single' WHEN event_id % 4 = 2 THEN 'split' ELSE 'triple' END")).alias("mode"))
    return op.stable_layout(votes, 6.0).select("job_id", "start", "end", "mode")


def intent_candidates(v):
    frame = F.floor(F.col("t") / 2)
    d = v.readings.groupBy("job_id", frame.alias("frame"), (F.col("event_id") % 3).alias("subject_id")).agg((F.sum("value") / 200).alias("confidence"))
    last = v.readings.groupBy("job_id").agg(F.max(frame).alias("last_frame"))
    return d.join(last, "job_id")


INTENT = """c AS (SELECT job_id, CAST(floor(t / 2) AS BIGINT) AS frame, event_id % 3 AS subject_id, least(1.0, sum(value) / 200) AS c FROM readings GROUP BY 1, 2, 3),
l AS (SELECT job_id, max(frame) AS last FROM c GROUP BY 1),
h AS (SELECT l.job_id, last, s AS subject_id, CAST(-1 AS BIGINT) AS frame, 0.0::DOUBLE AS v FROM l, range(3) AS r(s)
UNION ALL SELECT h.job_id, last, h.subject_id, h.frame + 1, CASE WHEN x.nv > 0.05 THEN x.nv ELSE 0.0 END FROM h LEFT JOIN c ON c.job_id = h.job_id AND c.subject_id = h.subject_id AND c.frame = h.frame + 1,
 LATERAL (SELECT h.v * 0.6 + coalesce(c.c, 0.0) * 0.4 AS nv) x WHERE h.frame < last)"""


def _intent_sources(v):
    scene_t = F.floor("t").cast("double")
    no = F.row_number().over(Window.partitionBy("job_id", scene_t).orderBy("scene_id")) - 1
    spots = v.scenes.select("job_id", scene_t.alias("t"), no.alias("region_no"), (F.col("importance") / 10).alias("score"))
    times = v.faces.select("job_id", F.col("t").cast("double").alias("t")).unionByName(spots.select("job_id", "t")).distinct()
    tracks = v.crop_segments.select("job_id", "start", "end", F.col("active_slot").alias("slot_id"), (F.col("seg_key") % 5).alias("persistent_id"), "confidence")
    return times, v.speaker_events, v.faces, tracks, spots


@query("win29_intent_signal", """
WITH sp AS (SELECT job_id, floor(t) AS t, row_number() OVER (PARTITION BY job_id, floor(t) ORDER BY scene_id) - 1 AS k, importance / 10 AS s FROM scenes),
ti AS (SELECT job_id, CAST(t AS DOUBLE) AS t FROM faces UNION SELECT job_id, t FROM sp),
co AS (SELECT ti.job_id, ti.t, e.slot_id AS sid, e.confidence * 0.6::DOUBLE AS c FROM ti JOIN speaker_events e ON e.job_id = ti.job_id AND ti.t BETWEEN e.start AND e."end" WHERE e.slot_id >= 0
 UNION ALL SELECT job_id, CAST(t AS DOUBLE), slot_id, lip * 0.5::DOUBLE * confidence FROM faces
 UNION ALL SELECT ti.job_id, ti.t, coalesce(c.active_slot, -(c.seg_key % 5 + 1)), c.confidence * 0.2::DOUBLE FROM ti JOIN crop_segments c ON c.job_id = ti.job_id AND ti.t BETWEEN c.start AND c."end"),
al AS (SELECT * FROM co UNION ALL SELECT job_id, t, -(1000 + k), s * 0.4::DOUBLE FROM sp ANTI JOIN co USING (job_id, t))
SELECT job_id, t, CAST(sid AS BIGINT) AS subject_id, round(least(1.0::DOUBLE, sum(c)), 9) AS confidence FROM al GROUP BY job_id, t, sid""")
def _(v):
    return op.intent_signal(*_intent_sources(v)).withColumn("confidence", F.round("confidence", 9))


@query("win29_smooth_intent", f"WITH RECURSIVE {INTENT} SELECT job_id, subject_id, frame, round(v, 6) AS smooth FROM h WHERE v > 0")
def _(v):
    return op.smooth_intent(intent_candidates(v)).withColumn("smooth", F.round("smooth", 6))


@query("win29_intent_switches")
def _(v):
    return op.intent_switches(op.smooth_intent(intent_candidates(v)))


@query("win31_confident_runs", f"""WITH {OKRUN.format(value="value", ok="value >= 10", src="readings", gap="")} SELECT job_id, start, "end", n FROM g WHERE n >= 8""")
def _(v):
    return op.confident_runs(samples(v), 10.0)


@query("win32_impact_leads", """
WITH l AS (SELECT job_id, event_id, t, value AS v, lag(value) OVER w AS a, lag(value, 2) OVER w AS b, lead(value) OVER w AS z, lead(value, 2) OVER w AS zz FROM readings WINDOW w AS (PARTITION BY job_id ORDER BY t, event_id)),
p AS (SELECT *, coalesce(v > 0.35 AND v > a AND a > b AND v > z AND zz IS NOT NULL, false) AS pk FROM l), q AS (SELECT *, lead(pk) OVER (PARTITION BY job_id ORDER BY t, event_id) AS ld FROM p) SELECT event_id AS sample_id, t FROM q WHERE ld""")
def _(v):
    return op.impact_leads(samples(v)).select("sample_id", "t")


@query("win33_output_duration", """
WITH p AS (SELECT o_orderkey AS clip_id, l_linenumber AS no, (o_orderkey * 37) % 240 + l_linenumber * 8 + l_partkey % 3 AS ps, (o_orderkey * 37) % 240 + l_linenumber * 8 + l_quantity / 10 + l_partkey % 3 AS pe,
   CASE WHEN l_linenumber % 2 = 0 THEN 2.0 ELSE 1.0 END AS sp, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS u FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
odd AS (SELECT clip_id FROM p GROUP BY 1 HAVING bool_or(sp <> 1)),
x AS (SELECT p.*, c.speed, c."end" - c.start AS len, greatest(0, ps - c.start) AS s, least(c."end" - c.start, pe - c.start) AS e FROM p JOIN clips c USING (clip_id) WHERE clip_id IN (SELECT clip_id FROM odd)),
y AS (SELECT *, coalesce(lag(e) OVER w, 0) AS pp, lead(e) OVER w IS NULL AS fin FROM x WHERE e > s WINDOW w AS (PARTITION BY clip_id ORDER BY ps, no, u)),
g AS (SELECT clip_id, sum(CASE WHEN s > pp + 0.01 THEN (s - pp) / speed ELSE 0 END + (e - s) / sp + CASE WHEN fin AND e < len - 0.01 THEN (len - e) / speed ELSE 0 END) AS o FROM y GROUP BY 1)
SELECT clip_id, round(coalesce(o, ("end" - start) / speed), 5) AS output FROM clips LEFT JOIN g USING (clip_id)""")
def _(v):
    base = (F.col("l_orderkey") * 37) % 240 + F.col("l_linenumber") * 8 + F.col("l_partkey") % 3
    w = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p = v.lineitem.select(F.col("l_orderkey").alias("clip_id"), w.alias("part_no"), base.cast("double").alias("p_start"), (base + F.col("l_quantity") / 10).alias("p_end"),
                          F.when(F.col("l_linenumber") % 2 == 0, 2.0).otherwise(1.0).alias("p_speed"))
    return op.output_duration(v.clips, p).withColumn("output", F.round("output", 5))
