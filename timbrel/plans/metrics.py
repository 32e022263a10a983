"""Queries: quality metrics, face aggregates and the job catalog."""

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import faces as fop
from ..operators import metrics as op
from .joins import BEATS_SQL, SLOTS_SQL, beats, slots
from .registry import query
from .windows import samples


@query("agg1_clip_diagnostics", """
WITH j AS (SELECT DISTINCT job_no AS job_id FROM jobs) SELECT job_id, count(*) FILTER (hook_score > 0) AS hook, count(*) FILTER (flow_score > 0) AS flow, count(*) FILTER (value_score > 0) AS "value",
 count(*) FILTER (trend_score > 0) AS trend, count(*) FILTER (hook_score = flow_score) AS legacy_fill_count, count(clip_id) AS total FROM j LEFT JOIN clips USING (job_id) GROUP BY 1""")
def _(v):
    return cat.clip_diagnostics(v.jobs.select(F.col("job_no").alias("job_id")), v.clips.withColumn("legacy_fill", F.col("hook_score") == F.col("flow_score")))


QA_JOBS = """j AS (SELECT job_no AS job_id, status, CASE WHEN job_no % 3 = 0 THEN 120.0 ELSE 0.0 END AS dur, job_no % 4 <> 0 AS has_summary, repeat('x', CAST(job_no % 40 AS INTEGER)) AS overview, job_no % 5 AS topics,
  CASE provider WHEN 'hosted' THEN 'none' ELSE provider END AS provider, job_no % 2 AS seconds FROM jobs),
t AS (SELECT job_id, count(*) AS n_seg, sum(n_words) AS n_words, count(*) FILTER (seg_idx % 2 = 0) AS n_timed FROM segments GROUP BY 1),
s AS (SELECT job_id, count(*) AS n_scene, bool_and(subject_x = 50) AS centred FROM scenes GROUP BY 1),
c AS (SELECT job_id, count(*) AS n_clip, count(*) FILTER (clips.duration < 14 OR clips.duration > 600) AS n_odd0, count(*) FILTER (clips.duration < 5 OR clips.duration > 600) AS n_odd, count(*) FILTER (clips.start < 0 OR (dur > 0 AND clips."end" > dur + 1) OR clips."end" <= clips.start) AS n_out,
  count(*) FILTER (coalesce(clip_focus, '') <> '') AS n_focus, count(*) FILTER (coalesce(clip_focus, '') <> '' AND focus_relevance IS NOT NULL) AS n_rated FROM clips JOIN j USING (job_id) GROUP BY 1),
o AS (SELECT job_id, count(*) AS n_overlap FROM (SELECT *, "end" - lead(start) OVER (PARTITION BY job_id ORDER BY start, clip_id) AS ov FROM clips) WHERE ov > 0 AND ov > duration * 0.5 GROUP BY 1),
d AS (SELECT j.*, coalesce(n_seg, 0) AS n_seg, coalesce(n_words, 0) AS n_words, coalesce(n_timed, 0) AS n_timed, coalesce(n_scene, 0) AS n_scene, centred, coalesce(n_clip, 0) AS n_clip, coalesce(n_odd, 0) AS n_odd, coalesce(n_out, 0) AS n_out,
  coalesce(n_focus, 0) AS n_focus, coalesce(n_rated, 0) AS n_rated, coalesce(n_overlap, 0) AS n_overlap FROM j LEFT JOIN t USING (job_id) LEFT JOIN s USING (job_id) LEFT JOIN c USING (job_id) LEFT JOIN o USING (job_id)),
k AS (SELECT job_id, 'Job Status' AS name, CASE WHEN status = 'complete' THEN 'pass' ELSE 'fail' END AS status FROM d
UNION ALL SELECT job_id, 'Transcript', CASE WHEN n_seg = 0 THEN 'fail' WHEN n_words > 10 THEN 'pass' ELSE 'warn' END FROM d
UNION ALL SELECT job_id, 'Word Timestamps', CASE WHEN n_timed > 0 THEN 'pass' ELSE 'warn' END FROM d WHERE n_seg > 0
UNION ALL SELECT job_id, 'Scene Analysis', CASE WHEN n_scene > 0 THEN 'pass' ELSE 'fail' END FROM d
UNION ALL SELECT job_id, 'Subject Tracking', CASE WHEN NOT centred THEN 'pass' ELSE 'warn' END FROM d WHERE n_scene > 0
UNION ALL SELECT job_id, 'Clip Detection', CASE WHEN n_clip > 0 THEN 'pass' WHEN status = 'complete' THEN 'fail' ELSE 'info' END FROM d
UNION ALL SELECT job_id, 'Clip Durations', CASE WHEN n_odd = 0 THEN 'pass' ELSE 'warn' END FROM d WHERE n_clip > 0
UNION ALL SELECT job_id, 'Clip Boundaries', CASE WHEN n_out = 0 THEN 'pass' ELSE 'fail' END FROM d WHERE n_clip > 0
UNION ALL SELECT job_id, 'Clip Overlap', CASE WHEN n_overlap = 0 THEN 'pass' ELSE 'warn' END FROM d WHERE n_clip > 0
UNION ALL SELECT job_id, 'Focus Metadata', CASE WHEN n_rated = n_focus THEN 'pass' ELSE 'warn' END FROM d WHERE n_focus > 0
UNION ALL SELECT job_id, 'Video Summary', CASE WHEN has_summary AND length(overview) > 20 AND topics >= 2 THEN 'pass' ELSE 'warn' END FROM d
UNION ALL SELECT job_id, 'AI Providers', CASE WHEN provider IS NULL THEN 'info' WHEN provider = 'none' THEN 'warn' ELSE 'pass' END FROM d
UNION ALL SELECT job_id, 'Pipeline Duration', 'pass' FROM d WHERE seconds > 0)"""


def _qa_jobs(v):
    p = F.when(F.col("provider") == "hosted", "none").otherwise(F.col("provider"))
    return v.jobs.select(F.col("job_no").alias("job_id"), "status", F.when(F.col("job_no") % 3 == 0, 120.0).otherwise(0.0).alias("duration"), (F.col("job_no") % 4 != 0).alias("has_summary"),
                      F.expr("repeat('x', CAST(job_no % 40 AS INT))").alias("overview"), (F.col("job_no") % 5).alias("topics"), F.when(p.isNotNull(), F.create_map(F.lit("text"), p)).alias("providers"), (F.col("job_no") % 2).alias("seconds"))


def _qa(v):
    return cat.job_checks(_qa_jobs(v), v.segments.withColumn("has_words", F.col("seg_idx") % 2 == 0), v.scenes, v.clips)


@query("agg2_job_checks", f"WITH {QA_JOBS} SELECT * FROM k")
def _(v):
    return _qa(v)


#: Clips with some lengths, starts and ends made odd, so that each finding occurs.
ODD_CLIPS = {
    "start": 'CASE WHEN clip_id % 43 = 0 THEN start - 300 WHEN clip_id % 47 = 0 THEN "end" ELSE start END', "end": 'CASE WHEN clip_id % 47 = 0 THEN start ELSE "end" END',
    "duration": "CASE WHEN clip_id % 37 = 0 THEN duration / 10 WHEN clip_id % 41 = 0 THEN duration * 20 ELSE duration END",
}


@query("agg2_job_findings", f"""
WITH {QA_JOBS}, oc AS (SELECT job_id, clip_id, dur, {', '.join(f'{e} AS "{n}"' for n, e in ODD_CLIPS.items())} FROM clips JOIN j USING (job_id)),
os AS (SELECT job_id, seg_idx, CASE WHEN seg_idx % 9 = 4 THEN '  ' ELSE text END AS text FROM segments), nx AS (SELECT *, lead(start) OVER w AS ns, lead(clip_id) OVER w AS ni FROM oc WINDOW w AS (PARTITION BY job_id ORDER BY start, clip_id))
SELECT job_id, clip_id, 'warning' AS level, 'Clip ' || clip_id || ': too ' || CASE WHEN duration < 5 THEN 'short' ELSE 'long' END || printf(' (%.1fs)', duration) AS finding FROM oc WHERE duration < 5 OR duration > 600
UNION ALL SELECT job_id, clip_id, 'error', 'Clip ' || clip_id || printf(': negative start (%.1fs)', start) FROM oc WHERE start < 0
UNION ALL SELECT job_id, clip_id, 'error', 'Clip ' || clip_id || printf(': end (%.1fs) exceeds video duration (%.1fs)', "end", dur::DOUBLE) FROM oc WHERE dur > 0 AND "end" > dur + 1
UNION ALL SELECT job_id, clip_id, 'error', 'Clip ' || clip_id || printf(': end <= start (%.1f-%.1f)', start, "end") FROM oc WHERE "end" <= start
UNION ALL SELECT job_id, clip_id, 'warning', 'Clips ' || clip_id || ' and ' || ni || printf(': %.1fs overlap (>', "end" - ns) || CAST(round_even(duration * 0.5::DOUBLE, 0) AS BIGINT) || 's)' FROM nx WHERE "end" - ns > duration * 0.5
UNION ALL SELECT job_id, NULL, 'warning', count(*) || ' empty transcript segments detected' FROM os JOIN j USING (job_id) WHERE trim(text) = '' GROUP BY 1
UNION ALL SELECT job_id, NULL, 'error', '{cat.NO_TRANSCRIPT}' FROM j ANTI JOIN segments USING (job_id)
UNION ALL SELECT job_id, NULL, 'error', '{cat.NO_SCENES}' FROM j ANTI JOIN scenes USING (job_id)
UNION ALL SELECT job_id, NULL, 'error', '{cat.NO_CLIPS}' FROM (SELECT * FROM j WHERE status = 'complete') q ANTI JOIN clips USING (job_id)
UNION ALL SELECT job_id, NULL, 'warning', '{cat.NO_PROVIDER}' FROM j WHERE provider = 'none'""")
def _(v):
    odd = v.clips.select("job_id", "clip_id", *[F.expr(e.replace('"', "`")).alias(n) for n, e in ODD_CLIPS.items()])
    said = v.segments.withColumn("text", F.when(F.col("seg_idx") % 9 == 4, "  ").otherwise(F.col("text")))
    return cat.job_findings(_qa_jobs(v), said, v.scenes, odd)


@query("agg2_job_verdict", f"""WITH {QA_JOBS} SELECT job_id, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (status = 'warn') > 0 THEN 'warn' ELSE 'pass' END AS overall,
 count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'fail') AS failed FROM k GROUP BY 1""")
def _(v):
    return cat.job_verdict(_qa(v))


@query("agg3_dashboard_totals", "SELECT CAST(sum(clips_count) AS BIGINT) AS total_clips, count(*) FILTER (status NOT IN ('complete', 'failed', 'queued', 'cancelled')) AS processing FROM jobs")
def _(v):
    return cat.dashboard_totals(v.jobs)


@query("agg4_cost_totals", "SELECT sum(coalesce(cost, 0)) AS total_cost, count(*) FILTER (status = 'complete') AS completed, bool_or(coalesce(contains(provider, 'free') OR provider = 'ollama', false)) AS has_free_tier FROM jobs")
def _(v):
    return cat.cost_totals(v.jobs.withColumns({"provider_used": F.when(F.col("provider").isNotNull(), F.create_map(F.lit("text"), F.col("provider"))), "estimated_cost_usd": F.col("cost")}))


@query("agg5_mean_score", "SELECT CAST(floor(avg(viral_score) + 0.5) AS BIGINT) AS mean_score FROM clips")
def _(v):
    return cat.mean_score(v.clips)


@query("agg6_filler_density", """
WITH e AS (SELECT job_id, t AS s, t + event_id % 5 AS e FROM moments WHERE kind = 'click'), n AS (SELECT c.clip_id, count(*) AS n FROM clips c JOIN e ON c.job_id = e.job_id AND e.s >= c.start AND e.e <= c."end" GROUP BY 1)
SELECT clip_id, round(coalesce(n, 0) / greatest(("end" - start) / 60, 0.01), 6) AS density FROM clips LEFT JOIN n USING (clip_id)""")
def _(v):
    e = v.moments.where("kind = 'click'").select("job_id", F.col("t").alias("start"), (F.col("t") + F.col("event_id") % 5).alias("end"))
    return op.filler_density(v.clips, e, "clip_id").select("clip_id", F.round("density", 6).alias("density"))


@query("agg7_tracking_debug", """
WITH s AS (SELECT job_id, CASE WHEN scene_id % 3 = 0 THEN '[dense face tracking]' ELSE description END AS d, subject_x, CASE WHEN scene_id % 2 = 0 THEN subject_x END AS ax FROM scenes)
SELECT job_id, count(*) AS total_scenes, count(*) FILTER (d = '[dense face tracking]') AS dense_scenes, count(*) FILTER (d <> '[dense face tracking]') AS vision_scenes, min(subject_x) AS min_x, max(subject_x) AS max_x,
 count(ax) AS speaker_x_count, count(DISTINCT subject_x) AS unique_x FROM s GROUP BY 1""")
def _(v):
    s = v.scenes.withColumns({"description": F.when(F.col("scene_id") % 3 == 0, cat.DENSE_MARK).otherwise(F.col("description")), "active_speaker_x": F.when(F.col("scene_id") % 2 == 0, F.col("subject_x"))})
    return cat.tracking_debug(s)


def frame_events(v):
    return v.moments.select("job_id", "t", F.col("event_id").alias("frame"), (F.col("value") % 100).alias("x"), ((F.col("kind") == "view") & (F.col("job_id") % 10 != 3)).alias("scene_change"))


HOLDS = """fe AS (SELECT job_id, t, event_id AS frame, kind = 'view' AND job_id % 10 <> 3 AS sc FROM moments), en AS (SELECT job_id, min(t) AS f, max(t) AS l, bool_or(sc) AS a FROM fe GROUP BY 1),
st AS (SELECT job_id, t, frame FROM fe WHERE sc UNION ALL SELECT job_id, f, -1 FROM en WHERE NOT a),
ho AS (SELECT s.job_id, coalesce(lead(t) OVER (PARTITION BY s.job_id ORDER BY t, frame), l) - t AS h FROM st s JOIN en USING (job_id)),
hq AS (SELECT job_id, count(*) AS n, list_sort(list(h)) AS v, round(avg(CASE WHEN h < 1 THEN 1.0 ELSE 0.0 END), 3) AS u1, round(avg(CASE WHEN h > 8 THEN 1.0 ELSE 0.0 END), 3) AS o8 FROM ho WHERE h > 0 GROUP BY 1),
hd AS (SELECT en.job_id, coalesce(n, 0) AS n_segments, round((v[CAST(floor((n - 1) / 2) AS BIGINT) + 1] + v[CAST(floor(n / 2) AS BIGINT) + 1]) / 2, 3) AS median_hold, round(v[CAST(least(n - 1, floor(n * 0.25)) AS BIGINT) + 1], 3) AS p25,
  round(v[CAST(least(n - 1, floor(n * 0.75)) AS BIGINT) + 1], 3) AS p75, round(v[CAST(least(n - 1, floor(n * 0.95)) AS BIGINT) + 1], 3) AS p95, u1 AS under_1s, o8 AS over_8s FROM en LEFT JOIN hq USING (job_id))"""


@query("agg8_hold_distribution", f"WITH {HOLDS} SELECT * FROM hd")
def _(v):
    return op.hold_distribution(frame_events(v), "job_id")


FRAMES = "fr AS (SELECT job_id, CAST(t AS BIGINT) AS frame, avg(x) AS cx FROM faces GROUP BY 1, 2)"


def frames(v):
    return v.faces.groupBy("job_id", F.col("t").cast("long").alias("frame")).agg(F.avg("x").alias("cx"))


def regions(v):
    return v.faces.where("slot_id <= 2").select("job_id", F.col("t").cast("long").alias("frame"), (F.col("x") - F.col("w") / 2).alias("left"), (F.col("x") + F.col("w") / 2).alias("right"))


REGIONS = "rg AS (SELECT job_id, CAST(t AS BIGINT) AS frame, x - w / 2 AS l, x + w / 2 AS r FROM faces WHERE slot_id <= 2)"


@query("agg9_region_miss_rate", f"""
WITH {FRAMES}, {REGIONS}, m AS (SELECT job_id, frame, bool_or(l < cx - 40.01 OR r > cx + 40.01) AS m FROM rg JOIN fr USING (job_id, frame) GROUP BY 1, 2)
SELECT job_id, round(coalesce(avg(CASE WHEN m THEN 1.0 ELSE 0.0 END), 0), 6) AS miss_rate FROM (SELECT DISTINCT job_id FROM fr) LEFT JOIN m USING (job_id) GROUP BY 1""")
def _(v):
    return op.region_miss_rate(frames(v), regions(v), 80.0).withColumn("miss_rate", F.round("miss_rate", 6))


@query("agg10_zone_preservation", f"""
WITH {FRAMES} SELECT job_id, round(avg(CASE WHEN greatest(0, least(cx + 30, 30) - greatest(cx - 30, 10)) / 20 >= 0.8 AND greatest(0, least(cx + 30, 80) - greatest(cx - 30, 65)) / 15 >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS preserved FROM fr GROUP BY 1""")
def _(v):
    return op.zone_preservation(frames(v), ((10.0, 20.0), (65.0, 15.0)), 60.0).withColumn("preserved", F.round("preserved", 6))


@query("agg11_thirds_rate", "SELECT job_id, round(avg(CASE WHEN abs(y / 100 - 1.0 / 3) <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS thirds_rate FROM faces GROUP BY 1")
def _(v):
    return op.thirds_rate(v.faces.withColumn("yy", F.col("y") / 100), "yy").withColumn("thirds_rate", F.round("thirds_rate", 6))


@query("agg12_downbeat_error", f"""
WITH {BEATS_SQL}, s AS (SELECT job_id, event_id, t FROM readings WHERE kind = 'click'), d AS (SELECT s.job_id, s.event_id, min(abs(b.beat - s.t)) * 1000 AS ms FROM s JOIN beats b USING (job_id) GROUP BY 1, 2)
SELECT job_id, round(avg(ms), 2) AS mean_error_ms, round(max(ms), 2) AS max_error_ms, round(avg(CASE WHEN ms <= 200 THEN 1.0 ELSE 0.0 END), 4) AS snap_rate, count(*) AS count, count(*) FILTER (ms <= 200) AS snapped FROM d GROUP BY 1""")
def _(v):
    return op.downbeat_error(v.readings.where("kind = 'click'"), beats(v))


TRAJ = """(SELECT job_id, t, value / 100 AS x, value * 3 % 100 / 100 AS y, value * 7 % 100 / 100 AS w, 0.9 AS h, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 11 % 100 / 100 END AS sx, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 13 % 100 / 100 END AS sy,
 1 + event_id % 2 AS subjects, event_id % 6 = 0 AS split FROM (SELECT *, row_number() OVER (PARTITION BY job_id, t ORDER BY event_id) AS u FROM readings WHERE {where}) WHERE u = 1)"""


def trajectory(v, where):
    d = v.readings.where(where).groupBy("job_id", "t").agg(F.min_by(F.struct("value", "event_id"), "event_id").alias("r")).select("job_id", "t", "r.*")
    val = F.col("value")
    cut = F.col("event_id") % 5 != 0
    return d.select("job_id", "t", (val / 100).alias("x"), (val * 3 % 100 / 100).alias("y"), (val * 7 % 100 / 100).alias("w"), F.lit(0.9).alias("h"), F.when(cut, val * 11 % 100 / 100).alias("sx"),
                    F.when(cut, val * 13 % 100 / 100).alias("sy"), (1 + F.col("event_id") % 2).alias("subjects"), (F.col("event_id") % 6 == 0).alias("split"))


def _label(w, n, s):
    return f"CASE WHEN {s} THEN 'SPLIT' WHEN {n} >= 2 THEN '2SHOT' WHEN {w} < 0.25 THEN 'CU' WHEN {w} < 0.45 THEN 'MS' ELSE 'WS' END"


PAIRS = f"""pa AS (SELECT a.job_id, a.x AS ox, b.x AS hx, a.y AS oy, b.y AS hy, {_label('a.w', 'a.subjects', 'a.split')} AS ol, {_label('b.w', 'b.subjects', 'b.split')} AS hl, a.sx AS osx, b.sx AS hsx
 FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t) AS i FROM {TRAJ.format(where="kind IN ('view', 'click')")}) a JOIN (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t) AS i FROM {TRAJ.format(where="kind IN ('error', 'signup')")}) b USING (job_id, i))"""


def _pairs(v):
    from ..functions.ordered import numbered, time_block

    a = numbered(trajectory(v, "kind IN ('view', 'click')"), ["job_id"], ["t"], time_block("t"), "i")
    b = numbered(trajectory(v, "kind IN ('error', 'signup')"), ["job_id"], ["t"], time_block("t"), "i")
    b = b.select("job_id", "i", *[F.col(c).alias(f"h_{c}") for c in ("x", "y", "w", "sx", "sy", "subjects", "split")])
    return a.join(b, ["job_id", "i"])


F1 = "CASE WHEN count(*) FILTER (ol = '{l}' OR hl = '{l}') = 0 THEN 1.0 ELSE 2.0 * count(*) FILTER (ol = '{l}' AND hl = '{l}') / (count(*) FILTER (ol = '{l}') + count(*) FILTER (hl = '{l}')) END"


@query("agg13_framing_f1", f"WITH {PAIRS} SELECT job_id, round(({' + '.join(F1.format(l=x) for x in op.LABELS)}) / 5, 6) AS framing_macro_f1, {', '.join(f'round({F1.format(l=x)}, 6) AS \"f1_{x}\"' for x in op.LABELS)} FROM pa GROUP BY 1")
def _(v):
    from ..operators.filters import framing_label

    d = op.framing_f1(_pairs(v), "job_id", framing_label(F.col("w"), F.col("subjects"), F.col("split")), framing_label(F.col("h_w"), F.col("h_subjects"), F.col("h_split")))
    return d.select("job_id", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


@query("agg14_centre_error", f"WITH {PAIRS} SELECT job_id, round(avg(abs(ox - hx)), 6) AS mae_cx, round(avg(abs(oy - hy)), 6) AS mae_cy FROM pa GROUP BY 1")
def _(v):
    return _pairs(v).groupBy("job_id").agg(F.round(F.avg(F.abs(F.col("x") - F.col("h_x"))), 6).alias("mae_cx"), F.round(F.avg(F.abs(F.col("y") - F.col("h_y"))), 6).alias("mae_cy"))


@query("agg15_lead_room_corr", f"""WITH {PAIRS}, q AS (SELECT job_id, corr(ox - osx, hx - hsx) AS c FROM pa WHERE osx IS NOT NULL AND hsx IS NOT NULL GROUP BY 1)
SELECT job_id, round(CASE WHEN c IS NULL OR isnan(c) THEN 0.0 ELSE c END, 5) AS lead_room FROM q""")
def _(v):
    d = _pairs(v).where("sx IS NOT NULL AND h_sx IS NOT NULL")
    return d.groupBy("job_id").agg(F.round(op.safe_corr(F.col("x") - F.col("sx"), F.col("h_x") - F.col("h_sx")), 5).alias("lead_room"))


@query("agg16_parity_report", f"""
WITH o AS {TRAJ.format(where="kind IN ('view', 'click', 'purchase')")}, h AS {TRAJ.format(where="kind IN ('error', 'signup')")},
sp AS (SELECT job_id, greatest(a.f, b.f) AS t0, least(a.l, b.l) AS t1 FROM (SELECT job_id, min(t) AS f, max(t) AS l FROM o GROUP BY 1) a JOIN (SELECT job_id, min(t) AS f, max(t) AS l FROM h GROUP BY 1) b USING (job_id)),
g AS (SELECT job_id, i, t0 + i * 0.5 AS t FROM (SELECT *, unnest(range(CAST(floor((t1 - t0) / 0.5) AS BIGINT) + 1)) AS i FROM sp WHERE t1 > t0)),
{{}}
SELECT job_id, count(*) AS n_frames, round(avg(abs(ox - hx)), 5) AS mae_cx, round(avg(abs(oy - hy)), 5) AS mae_cy FROM (SELECT job_id, i, oo.x AS ox, hh.x AS hx, oo.y AS oy, hh.y AS hy FROM ro oo JOIN rh hh USING (job_id, i)) GROUP BY 1""".format(
    ",\n".join(f"""b{s} AS (SELECT g.*, p.t AS bt, p.x AS bx, p.y AS by_ FROM g ASOF LEFT JOIN {s} p ON g.job_id = p.job_id AND g.t >= p.t),
f{s} AS (SELECT b{s}.*, p.t AS ft, p.x AS fx, p.y AS fy FROM b{s} ASOF LEFT JOIN {s} p ON b{s}.job_id = p.job_id AND b{s}.t < p.t),
u{s} AS (SELECT job_id, i, coalesce(bx, fx) AS ax, coalesce(fx, bx) AS zx, coalesce(by_, fy) AS ay, coalesce(fy, by_) AS zy, CASE WHEN bt IS NULL OR ft IS NULL OR ft - bt <= 1e-9 THEN 0.0 ELSE (t - bt) / (ft - bt) END AS u FROM f{s}),
r{s} AS (SELECT job_id, i, (1 - u) * ax + u * zx AS x, (1 - u) * ay + u * zy AS y FROM u{s})""" for s in ("o", "h"))))
def _(v):
    d = op.parity_report(op.parity_grid(trajectory(v, "kind IN ('view', 'click', 'purchase')"), trajectory(v, "kind IN ('error', 'signup')"), 0.5))
    return d.select("job_id", "n_frames", F.round("mae_cx", 5).alias("mae_cx"), F.round("mae_cy", 5).alias("mae_cy"))


@query("agg17_crop_quality", "SELECT job_id, slot_id AS segment_index, count(*) AS n, round(avg(confidence * 10), 6) AS score, bool_or(x < 3) AS off_frame, bool_or(y < 3) AS awkward FROM faces GROUP BY 1, 2")
def _(v):
    s = v.faces.select("job_id", F.col("slot_id").alias("segment_index"), (F.col("confidence") * 10).alias("quality_score"), (F.col("x") < 3).alias("off_frame"), (F.col("y") < 3).alias("awkward"))
    return op.crop_quality(s, ["job_id", "segment_index"]).withColumn("score", F.round("score", 6))


@query("agg18_metric_bundle", f"""
WITH {HOLDS}, l AS (SELECT job_id, value % 100 AS x, lag(value % 100) OVER w AS a, lag(value % 100, 2) OVER w AS b, lag(value % 100, 3) OVER w AS c FROM moments WINDOW w AS (PARTITION BY job_id ORDER BY t, event_id)),
s AS (SELECT job_id, round(max(abs(x - 2 * a + b)), 5) AS max_acceleration, round(max(abs(x - 3 * a + 3 * b - c)), 5) AS max_jerk FROM l GROUP BY 1) SELECT hd.*, max_acceleration, max_jerk FROM hd LEFT JOIN s USING (job_id)""")
def _(v):
    d = op.metric_bundle(frame_events(v))
    return d.withColumns({c: F.round(c, 5) for c in ("max_acceleration", "max_jerk")})


@query("agg18_fixture_scores", f"""
WITH {FRAMES}, {REGIONS}, {BEATS_SQL}, sw AS (SELECT job_id, start AS t FROM (SELECT *, lag(active_slot) OVER w AS ps, row_number() OVER w AS rn FROM crop_segments WINDOW w AS (PARTITION BY job_id ORDER BY start, seg_key)) WHERE rn > 1 AND ps IS DISTINCT FROM active_slot),
ex AS (SELECT job_id, event_id, t FROM readings WHERE kind = 'click'), eh AS (SELECT ex.job_id, event_id, coalesce(bool_or(abs(sw.t - ex.t) <= 0.5), false) AS hit FROM ex LEFT JOIN sw USING (job_id) GROUP BY 1, 2),
re AS (SELECT job_id, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS recall FROM eh GROUP BY 1),
ov AS (SELECT job_id, count(*) FILTER ("end" > n + 1e-9) AS n_over FROM (SELECT job_id, "end", lead(start) OVER (PARTITION BY job_id ORDER BY start, seg_key) AS n FROM crop_segments) GROUP BY 1),
l AS (SELECT job_id, cx AS x, lag(cx) OVER w AS a, lag(cx, 2) OVER w AS b, lag(cx, 3) OVER w AS c FROM fr WINDOW w AS (PARTITION BY job_id ORDER BY frame)),
sm AS (SELECT job_id, max(abs(x - 2 * a + b)) AS acc, max(abs(x - 3 * a + 3 * b - c)) AS jerk FROM l GROUP BY 1),
m AS (SELECT job_id, frame, bool_or(l < cx - 40.01 OR r > cx + 40.01) AS m FROM rg JOIN fr USING (job_id, frame) GROUP BY 1, 2), mi AS (SELECT job_id, avg(CASE WHEN m THEN 1.0 ELSE 0.0 END) AS miss FROM m GROUP BY 1),
d AS (SELECT s.job_id, seg_key, min(abs(b.beat - s.start)) * 1000 AS ms FROM crop_segments s LEFT JOIN beats b USING (job_id) WHERE s.start > 0 GROUP BY 1, 2),
be AS (SELECT job_id, round(avg(ms), 2) AS mean_ms, round(max(ms), 2) AS max_ms, avg(CASE WHEN ms <= 200 THEN 1.0 ELSE 0.0 END) AS snap, count(*) AS n_cuts, count(*) FILTER (ms <= 200) AS n_snap FROM d GROUP BY 1),
zo AS (SELECT job_id, avg(CASE WHEN greatest(0, least(cx + 40, 30) - greatest(cx - 40, 10)) / 20 >= 0.8 AND greatest(0, least(cx + 40, 80) - greatest(cx - 40, 65)) / 15 >= 0.8 THEN 1.0 ELSE 0.0 END) AS kept FROM fr GROUP BY 1),
th AS (SELECT job_id, avg(CASE WHEN abs(y / 100 - 1.0 / 3) <= 0.1 THEN 1.0 ELSE 0.0 END) AS thirds FROM faces GROUP BY 1)
SELECT j.job_no AS job_id, round(coalesce(recall, 1.0), 5) AS switch_recall, coalesce(n_over, 0) AS overlap_count, round(coalesce(acc, 0.0), 5) AS max_acceleration, round(coalesce(jerk, 0.0), 5) AS max_jerk, round(coalesce(miss, 0.0), 5) AS miss_rate,
 mean_ms AS mean_error_ms, max_ms AS max_error_ms, round(coalesce(snap, 0.0), 4) AS snap_rate, coalesce(n_cuts, 0) AS cuts, coalesce(n_snap, 0) AS snapped, round(coalesce(kept, 0.0), 5) AS preserved, round(coalesce(thirds, 0.0), 5) AS thirds_rate
FROM jobs j LEFT JOIN re ON re.job_id = job_no LEFT JOIN ov ON ov.job_id = job_no LEFT JOIN sm ON sm.job_id = job_no LEFT JOIN mi ON mi.job_id = job_no LEFT JOIN be ON be.job_id = job_no LEFT JOIN zo ON zo.job_id = job_no LEFT JOIN th ON th.job_id = job_no""")
def _(v):
    spans = v.crop_segments.withColumnRenamed("seg_key", "span_id")
    y = v.faces.select("job_id", (F.col("y") / 100).alias("y"))
    d = op.fixture_scores(v.jobs.select(F.col("job_no").alias("job_id")), spans, v.readings.where("kind = 'click'"), frames(v), regions(v), beats(v), y, 80.0, ((10.0, 20.0), (65.0, 15.0)))
    return d.withColumns({c: F.round(c, 5) for c in ("switch_recall", "max_acceleration", "max_jerk", "miss_rate", "preserved", "thirds_rate")})


KINDS = "CASE job_id % 5 WHEN 0 THEN 'music_video' WHEN 1 THEN 'animation' WHEN 2 THEN 'sports' WHEN 3 THEN 'multi_speaker_panel' ELSE 'other' END"
SUBS = "CASE job_id % 3 WHEN 0 THEN 'performance' WHEN 1 THEN 'other' END"


@query("agg19_hold_verdict", f"""
WITH {HOLDS}, z AS (SELECT *, {KINDS} AS tt, {SUBS} AS sub FROM hd),
q AS (SELECT *, CASE WHEN tt = 'music_video' AND sub = 'performance' THEN [1.0, 2.5, 0.15] WHEN tt = 'music_video' THEN [1.0, 4.5, 0.15] WHEN tt = 'animation' THEN [0.8, 2.0, 0.1] WHEN tt = 'sports' THEN [2.0, 4.5, 0.08] WHEN tt = 'multi_speaker_panel' THEN [3.0, 6.0, 0.05] END AS zz FROM z)
SELECT job_id, CASE WHEN n_segments = 0 OR zz IS NULL THEN 'UNKNOWN' WHEN median_hold / 100 BETWEEN zz[1] AND zz[2] AND under_1s <= zz[3] THEN 'PASS' WHEN median_hold / 100 BETWEEN zz[1] AND zz[2] OR under_1s <= zz[3] THEN 'MARGINAL' ELSE 'MISS' END AS verdict FROM q""")
def _(v):
    d = op.hold_distribution(frame_events(v), "job_id").withColumns({"median_hold": F.col("median_hold") / 100, "target_type": F.expr(KINDS), "subtype": F.expr(SUBS)})
    return op.hold_verdict(d).select("job_id", "verdict")


@query("agg21_sport_subtype", """
WITH f AS (SELECT job_id, round(t, 2) AS t, bool_or(class_name = 'sports ball') AS b, bool_or(class_name IN ('car', 'truck', 'motorcycle') AND w * h * 3 >= 500) AS v FROM faces GROUP BY 1, 2),
g AS (SELECT job_id, avg(CASE WHEN b THEN 1.0 ELSE 0.0 END) AS ball, avg(CASE WHEN v THEN 1.0 ELSE 0.0 END) AS vehicle FROM f GROUP BY 1)
SELECT job_id, round(ball, 6) AS ball, round(vehicle, 6) AS vehicle, CASE WHEN ball >= 0.15 AND ball > vehicle THEN 'basketball' WHEN vehicle >= 0.1 AND vehicle > ball THEN 'racing' END AS subtype FROM g""")
def _(v):
    d = fop.sport_subtype(v.faces.withColumn("w", F.col("w") * 3))
    return d.select("job_id", F.round("ball", 6).alias("ball"), F.round("vehicle", 6).alias("vehicle"), "subtype")


@query("agg22_music_subtype", """
WITH f AS (SELECT job_id, t, count(*) >= 3 AND max(x) - min(x) >= 55 AS g FROM faces GROUP BY 1, 2), h AS (SELECT job_id, avg(CASE WHEN g THEN 1.0 ELSE 0.0 END) AS f FROM f GROUP BY 1)
SELECT job_id, round(f, 6) AS formation, CASE WHEN f >= 0.08 AND (job_id % 10) / 10.0 >= 0.6 THEN 'performance' END AS subtype FROM h""")
def _(v):
    b = v.faces.select("job_id").distinct().withColumn("beat_confidence", F.col("job_id") % 10 / 10.0)
    return fop.music_subtype(v.faces, b).select("job_id", F.round("formation", 6).alias("formation"), "subtype")


@query("agg23_panel_flags", """
WITH f AS (SELECT job_id, t, count(*) AS n, count(*) FILTER ((x < 20 OR x > 80) AND (y < 25 OR y > 75)) AS c FROM faces GROUP BY 1, 2)
SELECT job_id, count(*) AS frames, count(*) >= 10 AND avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) >= 0.25 AND avg(n) >= 1.5 AS is_panel, round(sum(c) / sum(n), 6) AS corner_share FROM f GROUP BY 1""")
def _(v):
    return fop.panel_flags(v.faces).withColumn("corner_share", F.round("corner_share", 6))


INTERVAL = """hf AS (SELECT DISTINCT c.seg_key, f.t, f.slot_id FROM crop_segments c JOIN faces f ON f.job_id = c.job_id AND f.t BETWEEN c.start AND c."end"),
ht AS (SELECT seg_key, count(DISTINCT t) AS total FROM hf GROUP BY 1), hs AS (SELECT seg_key, slot_id, count(*) AS n FROM hf GROUP BY 1, 2)"""


@query("agg23_crowd_flags", f"""
WITH {INTERVAL}, g AS (SELECT seg_key, count(*) AS slots, count(*) FILTER (n / total >= 0.2) AS a FROM hs JOIN ht USING (seg_key) GROUP BY 1)
SELECT seg_key, coalesce(slots, 0) AS slots, coalesce(a, 0) >= 3 AS is_crowd FROM crop_segments LEFT JOIN g USING (seg_key)""")
def _(v):
    return fop.crowd_flags(v.crop_segments, v.faces, "seg_key").select("seg_key", "slots", "is_crowd")


WIDE_SLOTS = """ws AS (SELECT job_id, slot_id, slot_id * 13.0 + job_id % 7 AS xc, slot_id * 13.0 + job_id % 7 - (slot_id * 3) AS x0, slot_id * 13.0 + job_id % 7 + (slot_id * 2) AS x1, count(*) AS fc, avg(w) AS aw, avg(h) AS ah FROM faces GROUP BY 1, 2)"""


def wide_slots(v):
    xc = F.col("slot_id") * 13.0 + F.col("job_id") % 7
    g = v.faces.groupBy("job_id", "slot_id").agg(F.count("*").alias("frame_count"), F.avg("w").alias("avg_width"), F.avg("h").alias("avg_height"))
    return g.withColumns({"x_center": xc, "x_min": xc - F.col("slot_id") * 3, "x_max": xc + F.col("slot_id") * 2})


@query("agg24_corner_region", f"""
WITH {WIDE_SLOTS}, y AS (SELECT job_id, slot_id, avg(yy) AS y, stddev_pop(yy) AS sd FROM (SELECT job_id, slot_id, (y / 10 + CASE WHEN slot_id % 2 = 0 THEN 85 ELSE 5 END) / 100 AS yy FROM faces) GROUP BY 1, 2),
d AS (SELECT *, xc / 100 AS x, CASE WHEN xc / 100 < 0.35 AND y > 0.6 THEN 'bottom_left' WHEN xc / 100 > 0.65 AND y > 0.6 THEN 'bottom_right' WHEN xc / 100 < 0.35 AND y < 0.4 THEN 'top_left' WHEN xc / 100 > 0.65 AND y < 0.4 THEN 'top_right' END AS corner
 FROM ws JOIN y USING (job_id, slot_id)), e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY slot_id) AS n FROM d WHERE aw <= 15 AND fc >= 80 * 0.4 AND x1 - x0 <= 20 AND sd <= 0.1 AND corner IS NOT NULL)
SELECT job_id, slot_id, corner, round(greatest(0, x - aw / 200 - 0.02), 6) AS rx, round(least(1.0, fc / 80), 6) AS confidence FROM e WHERE n = 1""")
def _(v):
    f = v.faces.withColumn("y", F.col("y") / 10 + F.when(F.col("slot_id") % 2 == 0, 85).otherwise(5))
    t = f.select("job_id").distinct().withColumn("total_frames", F.lit(80))
    return fop.corner_region(wide_slots(v), f, t).select("job_id", "slot_id", "corner", F.round("rx", 6).alias("rx"), F.round("confidence", 6).alias("confidence"))


@query("agg26_slot_motion", f"""
WITH {WIDE_SLOTS}, g AS (SELECT job_id, count(*) AS n, sum(fc) AS t, avg(x1 - x0) AS a, first(x1 - x0 ORDER BY fc DESC, slot_id) AS ds, max(fc) AS dc FROM ws WHERE slot_id <= 1 + job_id % 5 GROUP BY 1)
SELECT job_id, CASE WHEN n = 1 THEN a > 15 WHEN dc / t > 0.6 AND ds > 20 THEN true ELSE a > 15 END AS continuous_motion FROM g""")
def _(v):
    return fop.slot_motion(wide_slots(v).where("slot_id <= 1 + job_id % 5"))


@query("agg28_token_cost", """
SELECT job_id, round(sum(n_words / 1000.0 * CASE speaker WHEN 'user' THEN 0.003 WHEN 'assistant' THEN 0.015 ELSE 0.001 END), 6) AS cost, CAST(sum(n_words) AS BIGINT) AS tokens FROM segments GROUP BY 1""")
def _(v):
    return cat.token_cost(v.segments.select("job_id", F.col("speaker").alias("provider"), F.col("n_words").alias("tokens")), {"user": 0.003, "assistant": 0.015})


@query("agg29_stage_times", "SELECT user_id AS job_id, event_type AS stage, round(sum(value), 2) AS seconds FROM events GROUP BY 1, 2")
def _(v):
    return cat.stage_times(v.events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("value").alias("seconds")))


@query("agg29_warnings", "SELECT user_id AS job_id, list_sort(list(DISTINCT props)) AS warnings FROM events WHERE event_type = 'error' AND props <> '' GROUP BY 1")
def _(v):
    return cat.warnings_per_job(v.events.where("event_type = 'error'").select(F.col("user_id").alias("job_id"), F.col("props").alias("message")))


@query("agg30_speaker_counts", "SELECT job_id, speaker, count(*) AS segments, min(seg_idx) AS first_idx FROM segments GROUP BY 1, 2")
def _(v):
    return cat.speaker_counts(v.segments)


@query("agg31_default_layout", """
WITH p AS (SELECT job_id, layout AS mode, sum("end" - start) AS s, count(*) AS n, min(start) AS ord FROM crop_segments GROUP BY 1, 2)
SELECT job_id, first(mode ORDER BY s DESC, ord) AS default_mode, CAST(sum(n) - 1 AS BIGINT) AS changes FROM p GROUP BY 1""")
def _(v):
    return fop.default_layout(v.crop_segments.withColumnRenamed("layout", "mode"))


@query("agg33_switch_lag", """
WITH t AS (SELECT job_id, event_id, t, event_id % 3 AS s FROM readings WHERE kind = 'click'), c AS (SELECT job_id, t, event_id % 3 AS s FROM readings WHERE kind = 'view'),
p AS (SELECT t.job_id, t.event_id, abs(round_even((c.t - t.t) * 30, 0)) AS lag, row_number() OVER (PARTITION BY t.event_id ORDER BY abs(c.t - t.t), c.t) AS n FROM t JOIN c ON c.job_id = t.job_id AND c.s = t.s AND abs(c.t - t.t) <= 1),
d AS (SELECT t.job_id, t.event_id, lag FROM t LEFT JOIN p ON p.event_id = t.event_id AND n = 1)
SELECT job_id, count(lag) AS detected, count(*) - count(lag) AS missed, round(avg(lag), 2) AS avg_lag_frames, CAST(max(lag) AS BIGINT) AS max_lag_frames, CAST(min(lag) AS BIGINT) AS min_lag_frames FROM d GROUP BY 1""")
def _(v):
    def sw(kind):
        return v.readings.where(F.col("kind") == kind).select("job_id", "t", (F.col("event_id") % 3).alias("to_slot"))
    return op.switch_lag(sw("click"), sw("view"))


@query("agg36_position_spread", """
WITH p AS (SELECT job_id, t, event_id, value % 100 AS x FROM readings), s AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY job_id ORDER BY t, event_id)) AS d FROM p),
n AS (SELECT job_id, count(*) AS n, count(*) FILTER (d > 8) / greatest(count(d), 1) AS big FROM s GROUP BY 1), b AS (SELECT job_id, CAST(least(floor(x / 10), 9) AS BIGINT) AS bin, count(*) AS k FROM p GROUP BY 1, 2),
k AS (SELECT b.job_id, count(*) AS peaks, list_sort(list(bin * 10.0 + 5)) AS centers FROM b JOIN n USING (job_id) WHERE n >= 10 AND k > greatest(3, floor(n * 0.1)) GROUP BY 1)
SELECT n.job_id, coalesce(peaks, 0) > 4 AND big > 0.6 AS is_motion, coalesce(centers, []) AS peak_centers FROM n LEFT JOIN k USING (job_id)""")
def _(v):
    return fop.position_spread(samples(v, "value % 100").withColumnRenamed("value", "x"))


@query("agg40_shot_motion", """
WITH h AS (SELECT c.seg_key, f.t, arg_min(f.x, f.face_key) AS x FROM crop_segments c JOIN faces f ON f.job_id = c.job_id AND f.t >= c.start AND f.t < c."end" AND (c.active_slot IS NULL OR c.active_slot = f.slot_id) GROUP BY 1, 2),
g AS (SELECT seg_key, CASE WHEN count(*) >= 2 THEN max(x) - min(x) ELSE 0 END AS travel FROM h GROUP BY 1)
SELECT seg_key, coalesce(travel, 0.0) AS travel, "end" - start >= 1 AND coalesce(travel, 0) > 6 AS force_tracking FROM crop_segments LEFT JOIN g USING (seg_key)""")
def _(v):
    return fop.shot_motion(v.crop_segments, v.faces, "seg_key").select("seg_key", "travel", "force_tracking")


@query("agg43_layout_votes", """
WITH f AS (SELECT job_id, t, CASE WHEN slot_id <= 2 THEN slot_id WHEN slot_id = 3 AND job_id % 2 = 0 THEN 3 ELSE -1 END AS slot_id, w, face_key FROM faces WHERE face_key % 5 = 0),
k AS (SELECT job_id, t, slot_id, max(w) AS w FROM f WHERE slot_id >= 0 GROUP BY 1, 2, 3), i AS (SELECT job_id, t, count(*) AS ids, list_sort(list(w), 'DESC')[2] AS w2 FROM k GROUP BY 1, 2),
a AS (SELECT job_id, t, list_sort(list(w), 'DESC')[2] AS w2 FROM f GROUP BY 1, 2)
SELECT a.job_id, a.t, CASE WHEN a.t % 10 = 0 THEN 'screenshare' WHEN ids >= 3 THEN 'triple' WHEN ids = 2 THEN CASE WHEN i.w2 > 5 THEN 'split' ELSE 'single' END WHEN a.w2 > 5 THEN 'split' ELSE 'single' END AS mode FROM a LEFT JOIN i USING (job_id, t)""")
def _(v):
    slot = F.when(F.col("slot_id") <= 2, F.col("slot_id")).when((F.col("slot_id") == 3) & (F.col("job_id") % 2 == 0), F.lit(3)).otherwise(F.lit(-1))
    f = v.faces.where("face_key % 5 = 0").withColumn("slot_id", slot)
    return fop.layout_votes(f, f.where("t % 10 = 0").select("job_id", "t"))


@query("agg44_batch_progress", """
SELECT owner_user_id AS batch_id, count(*) AS total, count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('complete', 'failed')) AS pending FROM jobs GROUP BY 1""")
def _(v):
    return cat.batch_progress(v.jobs.withColumnRenamed("owner_user_id", "batch_id"))


@query("agg45_frame_bounds", f"""
WITH {REGIONS}, g AS (SELECT job_id, frame, greatest(20, max(r - 20)) AS lo, least(80, min(l + 20)) AS hi FROM rg GROUP BY 1, 2)
SELECT job_id, frame, CASE WHEN lo > hi + 1e-6 THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN lo > hi + 1e-6 THEN (lo + hi) / 2 ELSE hi END AS hi, lo > hi + 1e-6 AS infeasible FROM g""")
def _(v):
    return op.frame_bounds(regions(v), 20.0, 100.0)


@query("agg49_plan_coverage", """
WITH o AS (SELECT job_id, seg_idx, start, CASE WHEN seg_idx = 3 THEN start ELSE "end" + CASE WHEN seg_idx % 4 = 0 THEN 0.2 WHEN seg_idx % 4 = 1 THEN 1.0 ELSE 0 END END AS e, confidence * 1.05 AS x FROM segments),
l AS (SELECT *, lag(start) OVER w AS p, lead(start) OVER w AS n FROM o WINDOW w AS (PARTITION BY job_id ORDER BY start, seg_idx)),
g AS (SELECT job_id, count(*) AS n_ops, round(sum(e - start), 4) AS covered, sum(CASE WHEN p IS NULL AND start > 0.001 THEN 1 ELSE 0 END + CASE WHEN n - e > 0.001 THEN 1 ELSE 0 END + CASE WHEN n IS NULL AND 200 - e > 0.05 THEN 1 ELSE 0 END) AS gaps,
 count(*) FILTER (n - e < -0.001) AS "overlaps", sum(CASE WHEN x < -0.001 OR x > 1.001 THEN 1 ELSE 0 END) AS out_of_range, count(*) FILTER (e - start < 1e-3) AS zero_length FROM l GROUP BY 1)
SELECT job_id, n_ops, covered, CAST(gaps AS BIGINT) AS gaps, "overlaps", CAST(out_of_range AS BIGINT) AS out_of_range, zero_length, gaps + "overlaps" + out_of_range + zero_length = 0 AS ok FROM g""")
def _(v):
    pad = F.expr("CASE WHEN seg_idx % 4 = 0 THEN 0.2D WHEN seg_idx % 4 = 1 THEN 1.0D ELSE 0.0D END")
    o = v.segments.select("job_id", F.col("seg_idx").alias("op_id"), "start", F.when(F.col("seg_idx") == 3, F.col("start")).otherwise(F.col("end") + pad).alias("end"),
                          (F.col("confidence") * 1.05).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    t = v.conversations.select(F.col("conv_id").alias("job_id"), F.lit(200.0).alias("total")).distinct()
    return op.plan_coverage(o, t).withColumn("covered", F.round("covered", 4))
