"""Queries: content profiles, crop confidence, summaries and identities."""

from pyspark.sql import functions as F

from ..operators import profiles as op
from .joins import mapping
from .metrics import wide_slots
from .registry import query
from .windows import path


def face_frames(v):
    """Frames of each job; every fifth second has no face."""
    f = v.faces.groupBy("job_id", "t").agg(F.count("*").alias("n_faces"), F.avg("x").alias("mean_x"))
    none = F.col("t") % 5 == 0
    return f.select("job_id", "t", F.when(none, 0).otherwise(F.col("n_faces")).alias("n_faces"), F.when(~none, F.col("mean_x")).alias("mean_x"))


def topic_scenes(v):
    """Scenes whose descriptions use the topic words."""
    words = F.array(*[F.lit(w) for ws in op.TOPIC_WORDS.values() for w in ws])
    pick = F.element_at(words, (F.pmod(F.col("scene_id") * 7 + F.col("job_id"), F.size(words)) + 1).cast("int"))
    return v.scenes.withColumn("description", F.when(F.col("job_id") % 3 == 0, F.concat(F.lit("A "), pick)).otherwise(F.col("description")))


def features(v):
    j = v.faces.select("job_id").distinct().select("job_id", (60.0 + F.col("job_id") % 4 * 300).alias("duration"), F.when(F.col("job_id") % 5 == 0, 2390).otherwise(1920).alias("width"), F.lit(1000).alias("height"), F.lit(500).alias("total_frames"))
    return op.content_features(j, v.moments.where("job_id % 2 = 0"), face_frames(v), wide_slots(v).where("slot_id <= 1 + job_id % 4"), topic_scenes(v), v.segments)


WORD_LIST = "[" + ", ".join("'%s'" % w for ws in op.TOPIC_WORDS.values() for w in ws) + "]"
HITS = ", ".join("(" + " + ".join(f"CAST(bool_or(contains(d, '{w}')) AS INTEGER)" for w in ws) + f") AS {k}_hits" for k, ws in op.TOPIC_WORDS.items())
FEATURES = f"""
j AS (SELECT DISTINCT job_id, 60.0 + job_id % 4 * 300 AS dur, CASE WHEN job_id % 5 = 0 THEN 2.39 ELSE 1.92 END AS ratio FROM faces),
c AS (SELECT job_id, count(*) AS n_cuts FROM moments WHERE job_id % 2 = 0 GROUP BY 1),
fr AS (SELECT job_id, t, CASE WHEN t % 5 = 0 THEN 0 ELSE count(*) END AS n, CASE WHEN t % 5 <> 0 THEN avg(x) END AS mx FROM faces GROUP BY 1, 2),
f AS (SELECT job_id, count(*) AS nf, avg(n) FILTER (n > 0) AS af, avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END) AS zp, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) FILTER (n > 0) AS ms, count(mx) AS nx, stddev_pop(mx) AS xs FROM fr GROUP BY 1),
sl AS (SELECT job_id, slot_id, slot_id * 5.0 AS span, count(*) AS fc FROM faces WHERE slot_id <= 1 + job_id % 4 GROUP BY 1, 2),
s AS (SELECT job_id, count(*) AS ns, max(fc) AS tf, sum(fc) AS sf, avg(span) AS ar, first(span ORDER BY fc DESC, slot_id) AS ds FROM sl GROUP BY 1),
sc AS (SELECT job_id, lower(CASE WHEN job_id % 3 = 0 THEN 'A ' || {WORD_LIST}[(scene_id * 7 + job_id) % len({WORD_LIST}) + 1] ELSE description END) AS d, row_number() OVER (PARTITION BY job_id ORDER BY t, scene_id) AS r FROM scenes),
h AS (SELECT job_id, {HITS} FROM sc WHERE r <= 50 GROUP BY 1), sp AS (SELECT job_id, sum(greatest(0, least("end", 120) - start)) AS speech FROM segments WHERE start < 120 GROUP BY 1),
ft AS (SELECT j.*, coalesce(n_cuts, 0) / (dur / 60) AS rate, coalesce(af, 0) AS af, CASE WHEN af IS NULL THEN 0 ELSE zp END AS zp, ms, CASE WHEN nf >= 10 AND nx >= 5 THEN xs END AS xs, coalesce(ns, 0) AS ns, tf / 500.0 AS top, tf, sf, ar,
 CASE WHEN ns = 1 THEN ar > 15 WHEN tf / sf > 0.6 AND ds > 20 THEN true ELSE ar > 15 END AS cm, coalesce(narrative_hits, 0) AS nh, coalesce(gaming_hits, 0) AS gh, coalesce(sports_hits, 0) AS sh, coalesce(music_hits, 0) AS mh, coalesce(anime_hits, 0) AS ah, coalesce(speech, 0) AS speech
 FROM j LEFT JOIN c USING (job_id) LEFT JOIN f USING (job_id) LEFT JOIN s USING (job_id) LEFT JOIN h USING (job_id) LEFT JOIN sp USING (job_id))"""


def _sum(rules):
    return " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in rules)


SEATS, SINGLE = "(ns >= 2 AND top < 0.8 AND ar < 15)", "(ns = 1 AND ar < 10)"
DRIFT = f"(ns > 0 AND NOT {SEATS} AND NOT {SINGLE} AND cm)"
SCORES = f"""sx AS (SELECT *, {_sum([("rate <= 2", 3.0), ("af >= 2", 2.5), (SEATS, 3.0), ("xs < 3", 1.0)])} AS podcast,
 {_sum([("rate >= 10", 2.0), ("rate > 2 AND rate < 10", 1.0), ("af >= 2", 1.0), ("af >= 1 AND af < 2", 0.5), (DRIFT, 1.0), ("ratio >= 2.2", 3.0), ("nh >= 3", 2.0)])} AS narrative,
 {_sum([("ah >= 2 AND ah >= 5 AND af < 1.5", 5.0), ("ah >= 2 AND NOT (ah >= 5 AND af < 1.5)", 1.0)])} AS anime,
 {_sum([("rate >= 10", 2.5), ("rate > 2 AND rate < 10", 1.0), ("zp > 0.5", 1.5), ("sh >= 2", 2.5), ("xs >= 15", 0.5), ("zp > 0.4 AND xs > 12 AND rate >= 8", 3.0)])} AS sports,
 {_sum([("rate > 2 AND rate < 10", 1.5), ("af >= 1 AND af < 2", 1.5), (SINGLE, 1.5), (DRIFT, 1.0), ("xs >= 8 AND xs < 15", 0.5)])} AS vlog,
 {_sum([("rate <= 2", 2.0), ("zp > 0.5", 2.0), ("gh >= 2", 3.0)])} AS gaming, {_sum([("rate >= 40", 3.0), ("rate >= 20 AND rate < 40", 1.5), ("mh >= 2", 3.0)])} AS music_video FROM ft),
lg AS (SELECT job_id, unnest([{", ".join(f"struct_pack(t := '{t}', s := CAST({t} AS DOUBLE), o := {i})" for i, t in enumerate(op.TYPES))}]) AS v FROM sx),
wn AS (SELECT job_id, first(v.t ORDER BY v.s DESC, v.o) AS wt, max(v.s) AS ws, first(v.t ORDER BY v.s DESC, v.o) FILTER (v.t NOT IN ('anime', 'music_video')) AS gt, max(v.s) FILTER (v.t NOT IN ('anime', 'music_video')) AS gs, sum(v.s) AS total,
 first(v.t ORDER BY v.s + CASE WHEN v.t = 'podcast' THEN 4 ELSE 0 END DESC, v.o) AS pt, max(v.s + CASE WHEN v.t = 'podcast' THEN 4 ELSE 0 END) AS ps FROM lg GROUP BY 1),
fx AS (SELECT *, wt IN ('anime', 'music_video') AND NOT (ah >= 5 AND af < 1.5) AND ws - gs < 1 AS yields, ns BETWEEN 2 AND 5 AND af >= 1.5 AND ms >= 0.25 AND ar < 20 AND tf / sf < 0.6 AS panel FROM sx JOIN wn USING (job_id)),
gx AS (SELECT *, CASE WHEN yields THEN gt ELSE wt END AS bt, CASE WHEN yields THEN gs ELSE ws END AS bs FROM fx),
hx AS (SELECT *, CASE WHEN bs / total < 0.25 OR bs < 2 THEN 'unknown' ELSE bt END AS ct, least(1, bs / total) AS cf FROM gx)"""


@query("agg20_content_profile", f"""
WITH {FEATURES}, {SCORES} SELECT job_id, CASE WHEN coalesce(panel, false) AND ps / (total + 4) >= 0.25 AND ps >= 2 THEN pt ELSE ct END AS content_type, round(CASE WHEN coalesce(panel, false) AND ps / (total + 4) >= 0.25 AND ps >= 2 THEN least(1, ps / (total + 4)) ELSE cf END, 6) AS confidence,
 ct = 'narrative' AND ns >= 2 AND speech >= 30 AS is_dialogue, ct = 'anime' OR ah >= 3 AS is_animated, coalesce(panel, false) AS is_panel FROM hx""")
def _(v):
    return op.classify_content(features(v)).select("job_id", "content_type", F.round("confidence", 6).alias("confidence"), "is_dialogue", "is_animated", "is_panel")


@query("agg32_centre_lock", """
WITH p AS (SELECT job_id, value % 50 + 25 AS x, event_id % 10 / 10.0 AS c FROM readings)
SELECT job_id, round(count(*) FILTER (c < 0.6 AND abs(x - 50) <= 5) / count(*) FILTER (c < 0.6), 3) AS center_lock, count(*) FILTER (c < 0.6 AND abs(x - 50) > 10) AS drift_events, count(*) FILTER (c < 0.6) AS n_uncertain FROM p GROUP BY 1""")
def _(v):
    return op.centre_lock(path(v).withColumns({"x": F.col("x") + 25, "confidence": F.col("sample_id") % 10 / 10.0}))


@query("agg32_layout_shares", "SELECT job_id, layout, round(count(*) / sum(count(*)) OVER (PARTITION BY job_id), 3) AS share FROM crop_segments GROUP BY 1, 2")
def _(v):
    return op.layout_shares(v.crop_segments)


@query("agg32_metric_means", "SELECT kind AS run, CASE event_id % 3 WHEN 0 THEN 'switch_recall' WHEN 1 THEN 'mean_lag_frames' ELSE 'p95_center_err_pct' END AS metric, round(avg(value), 6) AS mean FROM moments WHERE event_id % 7 <> 0 GROUP BY 1, 2")
def _(v):
    name = F.expr("CASE event_id % 3 WHEN 0 THEN 'switch_recall' WHEN 1 THEN 'mean_lag_frames' ELSE 'p95_center_err_pct' END")
    m = v.moments.select(F.col("kind").alias("run"), name.alias("metric"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return op.metric_means(m).withColumn("mean", F.round("mean", 6))


@query("agg32_animated_summary", """
WITH fr AS (SELECT job_id, t, CASE WHEN t % 5 = 0 THEN 0 ELSE count(*) END AS n FROM faces GROUP BY 1, 2), d AS (SELECT job_id, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 3) AS dense_ratio FROM fr GROUP BY 1),
m AS (SELECT job_id, round(avg(CASE WHEN strategy IN ('tracking', 'panning') THEN 1.0 ELSE 0.0 END), 3) AS tracking_pct FROM crop_segments GROUP BY 1), f AS (SELECT job_id, t, arg_min(x, face_key) AS fx FROM faces GROUP BY 1, 2),
o AS (SELECT f.job_id, f.t, fx, arg_min(struct_pack(k := c.seg_key, x := c.subject_x), struct_pack(a := c.start, b := c.seg_key)) AS r FROM f JOIN crop_segments c ON c.job_id = f.job_id AND f.t >= c.start AND f.t < c."end" GROUP BY 1, 2, 3),
e AS (SELECT job_id, abs(fx - (r.x - avg(r.x - fx) OVER (PARTITION BY job_id, r.k))) AS err FROM o), g AS (SELECT job_id, round(avg(err), 3) AS mean_err, round(list_sort(list(err))[CAST(floor((count(*) - 1) * 0.95) AS BIGINT) + 1], 3) AS p95_err FROM e GROUP BY 1)
SELECT m.job_id, tracking_pct, dense_ratio, coalesce(mean_err, 0) AS mean_err, coalesce(p95_err, 0) AS p95_err FROM m LEFT JOIN d USING (job_id) LEFT JOIN g USING (job_id)""")
def _(v):
    return op.animated_summary(v.crop_segments, v.faces, face_frames(v), "seg_key")


@query("agg34_crop_confidence", """
WITH m AS (SELECT DISTINCT job_id, speaker FROM segments), i AS (SELECT *, greatest(0, least(subject_x - 15.82, 68.36)) AS l FROM crop_segments),
f AS (SELECT i.seg_key, sum(CASE WHEN f.x BETWEEN l AND l + 31.64 THEN wt ELSE 0 END) / sum(wt) AS ratio, bool_or(f.slot_id = i.active_slot AND f.x BETWEEN l AND l + 31.64) AS mi, count(*) FILTER (f.slot_id = i.active_slot) AS n, stddev_pop(f.x) FILTER (f.slot_id = i.active_slot) AS sd
 FROM i JOIN (SELECT *, greatest(0.25, least(2, w * h / 100)) AS wt FROM faces) f ON f.job_id = i.job_id AND f.t BETWEEN i.start AND i."end" GROUP BY 1),
e AS (SELECT i.seg_key, sum(CASE WHEN s.slot_id = i.active_slot THEN least(s."end", i."end") - greatest(s.start, i.start) ELSE 0 END) / sum(least(s."end", i."end") - greatest(s.start, i.start)) AS lip, bool_or(s.slot_id = i.active_slot) AS any_ FROM i JOIN speaker_events s ON s.job_id = i.job_id AND s.start < i."end" AND s."end" > i.start GROUP BY 1),
c AS (SELECT i.seg_key, sum(least(s."end", i."end") - greatest(s.start, i.start)) AS cov FROM i JOIN segments s ON s.job_id = i.job_id AND s.start < i."end" AND s."end" > i.start GROUP BY 1),
d AS (SELECT i.*, coalesce((any_ AND mi) OR ratio >= 0.3, false) AS ok, CASE WHEN active_slot IS NULL THEN 0 WHEN coalesce(n, 0) < 2 THEN 0.5 ELSE greatest(0, 1 - sd / 30) END AS st, lip, cov FROM i LEFT JOIN f USING (seg_key) LEFT JOIN e USING (seg_key) LEFT JOIN c USING (seg_key))
SELECT seg_key, round(CASE WHEN ok THEN greatest(0, least(1, 0.4 + CASE WHEN active_slot IS NOT NULL AND lip >= 0.5 THEN 0.2 ELSE 0 END + 0.2 * st + CASE WHEN cov / ("end" - start) >= 0.3 THEN 0.2 ELSE 0 END)) ELSE 0 END, 6) AS confidence, ok AS face_in_crop FROM d""")
def _(v):
    return op.crop_confidence(v.crop_segments, v.faces, v.speaker_events, v.segments, mapping(v), "seg_key", 31.64).select("seg_key", F.round("confidence", 6).alias("confidence"), "face_in_crop")


@query("agg42_text_summary")
def _(v):
    return op.text_summary(v.segments, v.scenes)


@query("join19_persistent_ids", """
WITH RECURSIVE q AS (SELECT vec_id % 20 AS job_id, vec_id AS track_id, list_transform(embedding, lambda x: CAST(x * x AS DOUBLE)) AS w FROM embeddings),
g AS (SELECT job_id, track_id, list_transform(w, lambda x: sqrt(x / list_sum(w))) AS s FROM q),
d AS (SELECT b.job_id, b.track_id, a.track_id AS up, sqrt(greatest(0, 1 - list_sum(list_transform(range(1, 65), lambda i: a.s[i] * b.s[i])))) AS far FROM g a JOIN g b ON a.job_id = b.job_id AND a.track_id < b.track_id),
u AS (SELECT job_id, track_id, up FROM d WHERE far < 0.35 QUALIFY row_number() OVER (PARTITION BY job_id, track_id ORDER BY far, up) = 1),
r AS (SELECT job_id, track_id, track_id AS root, row_number() OVER (PARTITION BY job_id ORDER BY track_id) - 1 AS persistent_id FROM g ANTI JOIN u USING (job_id, track_id)
UNION ALL SELECT u.job_id, u.track_id, r.root, r.persistent_id FROM r JOIN u ON u.job_id = r.job_id AND u.up = r.track_id)
SELECT job_id, track_id, persistent_id FROM r""")
def _(v):
    t = v.embeddings.select((F.col("vec_id") % 20).alias("job_id"), F.col("vec_id").alias("track_id"), F.transform("embedding", lambda x: x * x).alias("signature"))
    return op.persistent_ids(t)


