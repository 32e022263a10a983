"""Queries: interval, nearest, band and matching joins."""

from pyspark.sql import functions as F

from ..functions.ordered import time_block
from ..functions.ranges import nearest
from ..operators import joins as op
from .filters import TRACK_TYPE, tracks
from .registry import query

SLOT_OF = "CASE speaker WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END"
MAPPING_SQL = f"mapping AS (SELECT DISTINCT job_id, speaker, {SLOT_OF} AS slot_id FROM segments)"
SLOTS_SQL = "slots AS (SELECT job_id, slot_id, slot_id * 13.0 + job_id % 7 AS x_center, count(*) AS frame_count FROM faces GROUP BY ALL)"


def mapping(v):
    return v.conversations.select(F.col("conv_id").alias("job_id"), F.col("role").alias("speaker")).distinct().withColumn("slot_id", F.expr(SLOT_OF).cast("long"))


def slots(v):
    return v.faces.groupBy("job_id", "slot_id").agg(F.count("*").alias("frame_count")).withColumn("x_center", F.col("slot_id") * 13.0 + F.col("job_id") % 7)


def beats(v):
    """Downbeats every two seconds of a job, with small offsets."""
    return v.moments.select("job_id", (F.floor(F.col("t") / 4) * 4 + (F.col("event_id") % 5) * 0.1).alias("beat")).distinct()


BEATS_SQL = "beats AS (SELECT DISTINCT job_id, floor(t / 4) * 4 + (event_id % 5) * 0.1 AS beat FROM moments)"


@query("join1_speakers_by_overlap", """
WITH f AS (SELECT job_id, cluster_id, min(struct_pack(s := t_start, i := turn_id)) AS first FROM turns GROUP BY 1, 2),
n AS (SELECT job_id, cluster_id, 'Speaker ' || row_number() OVER (PARTITION BY job_id ORDER BY first) AS label FROM f),
p AS (SELECT s.job_id, s.seg_idx, t.cluster_id, row_number() OVER (PARTITION BY s.job_id, s.seg_idx ORDER BY least(s."end", t.t_end) - greatest(s.start, t.t_start) DESC, t.t_start, t.turn_id) AS rn
  FROM segments s JOIN turns t ON s.job_id = t.job_id AND t.t_start < s."end" AND t.t_end > s.start)
SELECT s.job_id, s.seg_idx, coalesce(n.label, 'Speaker 1') AS speaker_label FROM segments s LEFT JOIN p ON s.job_id = p.job_id AND s.seg_idx = p.seg_idx AND rn = 1
LEFT JOIN n ON n.job_id = p.job_id AND n.cluster_id = p.cluster_id""")
def _(v):
    return op.speakers_by_overlap(v.segments, v.turns).select("job_id", "seg_idx", "speaker_label")


@query("join2_visual_peaks", """
WITH p AS (SELECT c.job_id, c.scene_id, c.t, c.importance, s.seg_idx, s.speaker, left(s.text, 50) AS text FROM scenes c JOIN segments s ON c.job_id = s.job_id AND abs(s.start - c.t) < 10 WHERE c.importance >= 7),
w AS (SELECT job_id, scene_id, t, importance, speaker, min(seg_idx) AS a FROM p GROUP BY ALL),
s AS (SELECT job_id, scene_id, t, importance, string_agg(speaker, ', ' ORDER BY a) AS speakers FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, scene_id ORDER BY seg_idx) AS n FROM p),
x AS (SELECT job_id, scene_id, string_agg(text, ' ' ORDER BY n) AS preview FROM r WHERE n <= 2 GROUP BY 1, 2),
k AS (SELECT s.*, preview, row_number() OVER (PARTITION BY s.job_id ORDER BY t, s.scene_id) AS rank FROM s JOIN x USING (job_id, scene_id))
SELECT job_id, scene_id, speakers, preview, rank FROM k WHERE rank <= 20""")
def _(v):
    return op.visual_peaks(v.scenes, v.segments).select("job_id", "scene_id", "speakers", "preview", "rank")


NEAR = """
WITH c AS (SELECT job_id, event_id, t FROM {table} WHERE kind = 'click'), s AS (SELECT job_id, max(event_id) AS rid, t AS rt FROM {table} WHERE kind = 'view' GROUP BY job_id, t),
p AS (SELECT c.job_id, c.event_id, s.rid, row_number() OVER (PARTITION BY c.job_id, c.event_id ORDER BY abs(s.rt - c.t), s.rt {tie}) AS n FROM c JOIN s ON c.job_id = s.job_id AND abs(s.rt - c.t) <= {tol})
SELECT c.job_id, c.event_id, p.rid AS near_id FROM c LEFT JOIN p ON c.job_id = p.job_id AND c.event_id = p.event_id AND n = 1"""


def _near(df, tol, later):
    views = df.where("kind = 'view'").select("job_id", F.col("t").alias("rt"), F.col("event_id").alias("rid"))
    d = nearest(df.where("kind = 'click'").select("job_id", "event_id", "t"), views, ["job_id"], "t", "rt", ["rid"], tolerance=tol, later_wins=later)
    return d.select("job_id", "event_id", F.col("near.rid").alias("near_id"))


@query("join3_nearest_later_wins", NEAR.format(table="moments", tie="DESC", tol=120))
def _(v):
    return _near(v.moments, 120.0, True)


@query("join4_nearest_slot", f"""
WITH {SLOTS_SQL}, c AS (SELECT *, lag(x_center) OVER w AS px, lead(x_center) OVER w AS nx FROM slots WINDOW w AS (PARTITION BY job_id ORDER BY x_center))
SELECT f.face_key, c.slot_id AS near_slot FROM faces f JOIN c ON f.job_id = c.job_id AND f.x > coalesce((px + x_center) / 2, -1e9) AND f.x <= coalesce((nx + x_center) / 2, 1e9)""")
def _(v):
    return op.nearest_slot(v.faces, slots(v)).select("face_key", "near_slot")


@query("join5_slot_at_time", """
WITH q AS (SELECT job_id, event_id AS q_id, t FROM moments),
a AS (SELECT q.job_id, q.q_id, arg_min(e.slot_id, struct_pack(s := e.start, i := e.event_id)) AS s FROM q JOIN speaker_events e ON q.job_id = e.job_id AND q.t BETWEEN e.start AND e."end" GROUP BY 1, 2),
b AS (SELECT q.job_id, q.q_id, arg_max(e.slot_id, struct_pack(s := e.start, i := e.event_id)) AS s FROM q JOIN speaker_events e ON q.job_id = e.job_id AND e."end" <= q.t GROUP BY 1, 2),
c AS (SELECT job_id, arg_min(slot_id, struct_pack(s := start, i := event_id)) AS s FROM speaker_events GROUP BY 1)
SELECT q.job_id, q.q_id, CAST(coalesce(a.s, b.s, c.s, -1) AS INTEGER) AS slot_id FROM q LEFT JOIN a USING (job_id, q_id) LEFT JOIN b USING (job_id, q_id) LEFT JOIN c ON c.job_id = q.job_id""")
def _(v):
    return op.slot_at_time(v.moments.select("job_id", F.col("event_id").alias("q_id"), "t"), v.speaker_events, "q_id").select("job_id", "q_id", "slot_id")


CLUSTER_SQL = """
tt AS (SELECT job_id, cluster_id, sum(t_end - t_start) AS total FROM turns WHERE t_end > t_start GROUP BY 1, 2),
cp AS (SELECT t.job_id, t.cluster_id, e.slot_id, sum(least(e."end", t.t_end) - greatest(e.start, t.t_start)) AS s, min(struct_pack(a := t.turn_id, b := e.event_id)) AS ord
  FROM turns t JOIN speaker_events e ON t.job_id = e.job_id AND e.slot_id >= 0 AND t.t_start < e."end" AND t.t_end > e.start GROUP BY 1, 2, 3),
cb AS (SELECT *, row_number() OVER (PARTITION BY job_id, cluster_id ORDER BY s DESC, ord) AS n FROM cp),
cm AS (SELECT tt.job_id, tt.cluster_id, CASE WHEN cb.s / tt.total >= 0.6 THEN cb.slot_id ELSE -1 END AS mapped_slot FROM tt LEFT JOIN cb ON tt.job_id = cb.job_id AND tt.cluster_id = cb.cluster_id AND n = 1)"""
VOTE_SQL = """
vp AS (SELECT e.job_id, e.event_id, m.mapped_slot, sum(least(e."end", t.t_end) - greatest(e.start, t.t_start)) AS s, max(t.turn_conf) AS c, min(t.turn_id) AS ord
  FROM speaker_events e JOIN turns t ON t.job_id = e.job_id AND t.t_start < e."end" AND t.t_end > e.start JOIN cm m ON m.job_id = t.job_id AND m.cluster_id = t.cluster_id AND m.mapped_slot >= 0 GROUP BY 1, 2, 3),
vb AS (SELECT *, row_number() OVER (PARTITION BY job_id, event_id ORDER BY s DESC, ord) AS n FROM vp)"""


@query("join6_cluster_slots", f"WITH {CLUSTER_SQL} SELECT * FROM cm")
def _(v):
    return op.cluster_slots(v.turns, v.speaker_events)


@query("join7_slot_votes", f"WITH {CLUSTER_SQL}, {VOTE_SQL} SELECT job_id, event_id, mapped_slot AS vote_slot, c AS vote_conf FROM vb WHERE n = 1")
def _(v):
    return op.slot_votes(v.speaker_events, v.turns, op.cluster_slots(v.turns, v.speaker_events), "event_id")


@query("join8_fuse_voice", f"""
WITH {CLUSTER_SQL}, {VOTE_SQL}, d AS (SELECT e.*, vb.mapped_slot AS vs, vb.c AS vc FROM speaker_events e LEFT JOIN vb ON vb.job_id = e.job_id AND vb.event_id = e.event_id AND n = 1),
f AS (SELECT *, CASE WHEN vs IS NULL THEN 'pass' WHEN vs = slot_id THEN 'agree' WHEN confidence < 0.4 AND vc >= 0.6 THEN 'override' ELSE 'disagree' END AS branch FROM d)
SELECT job_id, event_id, branch, CASE branch WHEN 'override' THEN vs ELSE slot_id END AS slot_id,
  round(CASE branch WHEN 'agree' THEN least(0.95, confidence + 0.25) WHEN 'override' THEN 0.6 WHEN 'disagree' THEN least(confidence, 0.5) ELSE confidence END, 6) AS confidence FROM f""")
def _(v):
    return op.fuse_voice(v.speaker_events, v.turns).select("job_id", "event_id", "branch", "slot_id", F.round("confidence", 6).alias("confidence"))


def _timed(v):
    return v.moments.select("job_id", "t", "kind", (F.col("event_id") % 4 * 2.0).alias("event_len"))


@query("join9_event_layouts", """
WITH e AS (SELECT job_id, t, kind, event_id % 4 * 2.0 AS len FROM moments),
f AS (SELECT c.seg_key, bool_or(kind = 'error') AS sb, bool_or(kind = 'view') AS ch FROM crop_segments c JOIN e ON c.job_id = e.job_id AND t + len >= c.start AND t < c."end" GROUP BY 1)
SELECT seg_key, CASE WHEN seg_key % 5 = 0 THEN 'manual' WHEN coalesce(sb, false) THEN 'blurfill' WHEN coalesce(ch, false) OR subject_x > 30 THEN 'wide_zoom' WHEN "end" - start >= 4 THEN 'blurfill' ELSE 'composite' END AS mode
FROM crop_segments LEFT JOIN f USING (seg_key)""")
def _(v):
    from ..operators.filters import layout_choice

    d = op.event_flags(v.crop_segments, _timed(v), "seg_key", ("error", "view"))
    pick = layout_choice(F.col("has_error"), F.col("has_view"), F.col("subject_x"), F.lit("moba"), F.col("end") - F.col("start"))
    return d.select("seg_key", F.coalesce(F.when(F.col("seg_key") % 5 == 0, "manual"), pick).alias("mode"))


SNAP_SQL = """(SELECT b.beat FROM beats b WHERE b.job_id = {a}.job_id AND abs(b.beat - {a}.{c}) <= 0.2 + 1e-6 ORDER BY abs(b.beat - {a}.{c}), b.beat LIMIT 1)"""


@query("join10_snap_to_grid", f"""
WITH {BEATS_SQL}, c AS (SELECT * FROM clips WHERE job_id IN (SELECT job_id FROM beats)) SELECT clip_id, coalesce({SNAP_SQL.format(a="c", c="start")}, start) AS snapped FROM c
UNION ALL SELECT clip_id, start FROM clips WHERE job_id NOT IN (SELECT job_id FROM beats)""")
def _(v):
    return op.snap_to_grid(v.clips, beats(v), "start", "snapped").select("clip_id", "snapped")


def with_words(v):
    """Segments with their word times as an array."""
    return v.segments.withColumn("words", F.transform("toks", lambda w, i: F.struct(
        ((F.round(F.col("start") * 10).cast("long") + 4 * i) / 10.0).alias("start"), ((F.round(F.col("start") * 10).cast("long") + 4 * i + 4) / 10.0).alias("end"), w.alias("word"))))


@query("join11_snap_to_words", """
WITH p AS (SELECT c.clip_id, c.start AS cs, c."end" AS ce, w.start AS ws, w."end" AS we FROM clips c JOIN segments s ON c.job_id = s.job_id AND s."end" >= c.start - 2 AND s.start <= c."end" + 2
  JOIN words w ON w.job_id = s.job_id AND w.seg_idx = s.seg_idx),
b AS (SELECT clip_id, greatest(0, arg_min(ws, struct_pack(d := abs(ws - cs), s := ws)) - 0.3) AS ns, arg_min(we, struct_pack(d := abs(we - ce), s := ws)) + 0.5 AS ne FROM p GROUP BY 1)
SELECT c.clip_id, CASE WHEN ns < ne AND ne - ns >= 15 THEN round(ns, 3) ELSE start END AS start, CASE WHEN ns < ne AND ne - ns >= 15 THEN round(ne, 3) ELSE "end" END AS "end",
  CASE WHEN ns < ne AND ne - ns >= 15 THEN round(round(ne, 3) - round(ns, 3), 1) ELSE duration END AS duration FROM clips c LEFT JOIN b USING (clip_id)""")
def _(v):
    return op.snap_to_words(v.clips, with_words(v)).select("clip_id", "start", "end", "duration")


@query("join12_snap_clips", f"""
WITH {BEATS_SQL}, h AS (SELECT DISTINCT job_id FROM beats),
c AS (SELECT c.*, h.job_id IS NOT NULL AS has FROM clips c LEFT JOIN h USING (job_id)),
m AS (SELECT c.*, coalesce({SNAP_SQL.format(a="c", c="start")}, start) AS ns, coalesce({SNAP_SQL.format(a="c", c='"end"')}, "end") AS ne FROM c WHERE has)
SELECT clip_id, CASE WHEN ne - ns >= 15 AND (ns <> start OR ne <> "end") THEN round(ns, 3) ELSE start END AS start, CASE WHEN ne - ns >= 15 AND (ns <> start OR ne <> "end") THEN round(ne, 3) ELSE "end" END AS "end" FROM m WHERE clip_type = 'story'
UNION ALL SELECT clip_id, start, "end" FROM c WHERE clip_type = 'story' AND NOT has""")
def _(v):
    c = v.clips.where("clip_type = 'story'").withColumn("content_type", F.lit("music_video"))
    none = with_words(v).where("n_words < 0")
    return op.snap_clips(c, none, beats(v)).select("clip_id", "start", "end")


@query("join13_snap_to_speech", """
WITH a AS (SELECT c.clip_id, arg_min(s.start, struct_pack(d := abs(s.start - c.start), i := s.seg_idx)) AS ns FROM clips c JOIN segments s ON c.job_id = s.job_id AND abs(s.start - c.start) <= 3 AND s.start <= c.start + 0.5 GROUP BY 1),
b AS (SELECT c.clip_id, arg_min(s."end", struct_pack(d := abs(s."end" - c."end"), i := s.seg_idx)) AS ne FROM clips c JOIN segments s ON c.job_id = s.job_id AND abs(s."end" - c."end") <= 3 AND s."end" >= c."end" - 0.5 GROUP BY 1)
SELECT c.clip_id, coalesce(ns, start) AS start, coalesce(ne, "end") AS "end", CASE WHEN ns <> start OR ne <> "end" THEN round(coalesce(ne, "end") - coalesce(ns, start), 1) ELSE duration END AS duration
FROM clips c LEFT JOIN a USING (clip_id) LEFT JOIN b USING (clip_id)""")
def _(v):
    return op.snap_to_speech(v.clips, v.segments).select("clip_id", "start", "end", "duration")


@query("join14_switch_recall", """
WITH j AS (SELECT DISTINCT job_id FROM clips), e AS (SELECT job_id, event_id, t FROM moments WHERE kind = 'click'), a AS (SELECT job_id, t FROM moments WHERE kind = 'view'),
m AS (SELECT job_id, avg(CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.job_id = e.job_id AND abs(a.t - e.t) <= 30) THEN 1.0 ELSE 0.0 END) AS r FROM e GROUP BY 1)
SELECT job_id, round(coalesce(r, 1.0), 6) AS recall FROM j LEFT JOIN m USING (job_id)""")
def _(v):
    d = op.switch_recall(v.clips.select("job_id").distinct(), v.moments.where("kind = 'click'"), v.moments.where("kind = 'view'"), 30.0)
    return d.select("job_id", F.round("recall", 6).alias("recall"))


@query("join15_cut_deviation", """
WITH h AS (SELECT job_id, event_id, t FROM readings WHERE kind = 'click'), o AS (SELECT job_id, t FROM readings WHERE kind = 'view'),
d AS (SELECT h.job_id, h.event_id, min(abs(o.t - h.t)) * 1000.0 AS ms FROM h LEFT JOIN o ON o.job_id = h.job_id AND abs(o.t - h.t) <= 0.5 GROUP BY 1, 2),
g AS (SELECT job_id, avg(ms) AS m, count(ms) AS n, list_sort(list(ms) FILTER (ms IS NOT NULL)) AS l FROM d GROUP BY 1)
SELECT job_id, round(coalesce(m, 0.0), 4) AS mean_ms, n AS pairs, round(coalesce(l[CAST(greatest(0, floor(0.9 * n) - 1) AS BIGINT) + 1], 0.0), 4) AS p90_ms FROM g""")
def _(v):
    d = op.cut_deviation(v.readings.where("kind = 'view'"), v.readings.where("kind = 'click'"))
    return d.select("job_id", F.round("mean_ms", 4).alias("mean_ms"), "pairs", F.round("p90_ms", 4).alias("p90_ms"))


def captions(v):
    """Captions near the segments, some shifted too far, some edited."""
    s = v.segments.where("seg_idx % 4 <> 3")
    shift = (F.col("seg_idx") * 7 + F.col("job_id")) % 5 * 0.1 - 0.15
    return s.select("job_id", (F.col("job_id") * 1000 + F.col("seg_idx")).alias("item_id"), (F.col("start") + shift).alias("start"), (F.col("end") + shift / 2).alias("end"),
                    F.when(F.col("seg_idx") % 3 == 0, "edited").otherwise(F.col("text")).alias("caption"), F.when(F.col("job_id") % 2 == 0, "user").otherwise(F.col("speaker")).alias("speaker"))


CAPTION_SQL = """
cap AS (SELECT job_id, job_id * 1000 + seg_idx AS item_id, start + ((seg_idx * 7 + job_id) % 5 * 0.1 - 0.15) AS cs, "end" + ((seg_idx * 7 + job_id) % 5 * 0.1 - 0.15) / 2 AS ce,
  CASE WHEN seg_idx % 3 = 0 THEN 'edited' ELSE text END AS ct, CASE WHEN job_id % 2 = 0 THEN 'user' ELSE speaker END AS csp FROM segments WHERE seg_idx % 4 <> 3),
m AS (SELECT coalesce(c.job_id, s.job_id) AS job_id, c.item_id, s.seg_idx, ct, csp, s.text, s.speaker FROM cap c FULL OUTER JOIN segments s ON c.job_id = s.job_id AND abs(cs - s.start) < 0.3 AND abs(ce - s."end") < 0.3)"""


@query("join16_match_captions", f"WITH {CAPTION_SQL} SELECT job_id, item_id, seg_idx FROM m")
def _(v):
    return op.match_captions(captions(v), v.segments)


@query("join16_sync_report", f"""
WITH {CAPTION_SQL} SELECT job_id, count(*) FILTER (item_id IS NOT NULL AND seg_idx IS NOT NULL) AS matched, count(*) FILTER (ct <> text) AS text_mismatches, count(*) FILTER (csp <> speaker) AS speaker_mismatches,
 count(*) FILTER (seg_idx IS NULL) AS unmatched_captions, count(*) FILTER (item_id IS NULL) AS unmatched_segments FROM m GROUP BY 1""")
def _(v):
    c = captions(v)
    return op.sync_report(op.match_captions(c, v.segments), c, v.segments)


@query("join17_track_checks", f"""
WITH tr AS (SELECT l_suppkey AS project_id, l_linenumber AS track_no, {TRACK_TYPE} AS tt FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL)
SELECT item_id, CASE WHEN tt IS NULL THEN 'orphaned_item' ELSE 'incompatible_track' END AS problem FROM items LEFT JOIN tr USING (project_id, track_no)
WHERE tt IS NULL OR (tt = 'video' AND type <> 'video') OR (tt = 'overlay' AND type NOT IN ('text', 'shape', 'image', 'overlay')) OR (tt = 'audio' AND type <> 'audio') OR (tt = 'subtitle' AND type <> 'subtitle')""")
def _(v):
    return op.track_checks(v.items, tracks(v).where("track_no <> 3")).select("item_id", "problem")


def identity_faces(v):
    return v.embeddings.select((F.col("vec_id") % 20).alias("job_id"), F.col("vec_id").alias("face_id"), "embedding",
                               F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise(-1).cast("long").alias("identity_id"), (F.col("vec_id") * 7 % 101).cast("double").alias("x"))


@query("join18_assign_identities", """
WITH f AS (SELECT vec_id % 20 AS job_id, vec_id AS face_id, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN vec_id % 3 = 0 THEN label ELSE -1 END AS id, CAST(vec_id * 7 % 101 AS DOUBLE) AS x FROM embeddings),
u AS (SELECT job_id, id, i, avg(e[i]) AS m FROM (SELECT job_id, id, e, unnest(range(1, 65)) AS i FROM f WHERE id >= 0) GROUP BY 1, 2, 3),
c AS (SELECT job_id, id, list(m ORDER BY i) AS c FROM u GROUP BY 1, 2),
p AS (SELECT f.face_id, c.id, list_cosine_similarity(f.e, c.c) AS sim, row_number() OVER (PARTITION BY f.face_id ORDER BY list_cosine_similarity(f.e, c.c) DESC, c.id) AS n FROM f JOIN c USING (job_id)),
s AS (SELECT DISTINCT job_id, CAST(k AS DOUBLE) AS k FROM f, range(8) AS r(k)),
q AS (SELECT f.face_id, CAST(k AS BIGINT) AS slot, row_number() OVER (PARTITION BY f.face_id ORDER BY abs(f.x - k * 13), k) AS n FROM f JOIN s USING (job_id))
SELECT q.face_id, CASE WHEN sim > 0.4 THEN p.id ELSE q.slot END AS assigned_id FROM q JOIN p ON p.face_id = q.face_id AND p.n = 1 WHERE q.n = 1""")
def _(v):
    f = identity_faces(v)
    s = f.select("job_id").distinct().select("job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("slot_id")).withColumn("x_center", F.col("slot_id") * 13.0)
    return op.assign_identities(f, s).select("face_id", "assigned_id")


def frame_regions(v):
    src = F.expr("CASE WHEN slot_id <= 3 THEN 'saliency' WHEN slot_id <= 5 THEN 'face' ELSE 'object' END")
    return v.faces.select("job_id", "t", F.col("face_key").alias("region_id"), "x", "y", (F.col("w") * 3).alias("w"), (F.col("h") * 3).alias("h"), F.col("confidence").alias("score"), src.alias("source"))


@query("join20_absorb_saliency", """
WITH r AS (SELECT job_id, t, face_key AS id, x, y, w * 3 AS w, h * 3 AS h, confidence AS score, slot_id <= 3 AS sal FROM faces),
o AS (SELECT a.job_id, a.t, a.id, a.score, b.id AS o, least(a.x + a.w / 2, b.x + b.w / 2) - greatest(a.x - a.w / 2, b.x - b.w / 2) AS ix, least(a.y + a.h / 2, b.y + b.h / 2) - greatest(a.y - a.h / 2, b.y - b.h / 2) AS iy,
  a.w * a.h + b.w * b.h AS areas FROM r a JOIN r b ON a.job_id = b.job_id AND a.t = b.t AND a.sal AND NOT b.sal),
k AS (SELECT job_id, t, id, score, min(o) AS o FROM o WHERE ix > 0 AND iy > 0 AND ix * iy / (areas - ix * iy) > 0.3 GROUP BY ALL),
g AS (SELECT o AS id, sum(score) AS gain FROM k GROUP BY 1)
SELECT r.id AS region_id, round(CASE WHEN gain IS NULL THEN score ELSE least(1.0, score + gain) END, 6) AS score FROM r LEFT JOIN g USING (id) WHERE r.id NOT IN (SELECT id FROM k)""")
def _(v):
    return op.absorb_saliency(frame_regions(v)).select("region_id", F.round("score", 6).alias("score"))


VOTES_SQL = """
pf AS (SELECT s.job_id, s.seg_idx, s.speaker, s."end" - s.start AS dur, f.slot_id, sum(f.lip * least(2.0, f.w / 8)) AS lip, sum(f.w * f.h) AS size, min(struct_pack(t := f.t, k := f.face_key)) AS ord
  FROM segments s JOIN faces f ON f.job_id = s.job_id AND f.t BETWEEN s.start - 0.5 AND s."end" + 0.5 GROUP BY ALL),
bs AS (SELECT job_id, seg_idx, speaker, dur, CASE WHEN max(round(lip, 9)) > 0.01 THEN first(slot_id ORDER BY round(lip, 9) DESC, ord) ELSE first(slot_id ORDER BY size DESC, ord) END AS slot_id FROM pf GROUP BY 1, 2, 3, 4),
vt AS (SELECT job_id, speaker, slot_id, sum(greatest(dur, 0.1)) AS seconds, min(seg_idx) AS first_seg FROM bs GROUP BY 1, 2, 3)"""


@query("join21_speaker_slot_votes", f"WITH {VOTES_SQL} SELECT job_id, speaker, slot_id, round(seconds, 6) AS seconds FROM vt")
def _(v):
    return op.speaker_slot_votes(v.segments, v.faces).select("job_id", "speaker", "slot_id", F.round("seconds", 6).alias("seconds"))


@query("join21_speaker_slots")
def _(v):
    return op.speaker_slots(op.speaker_slot_votes(v.segments, v.faces))


@query("join22_transcript_timeline", f"""
WITH {MAPPING_SQL}, e AS (SELECT s.job_id, s.seg_idx, s.start, s."end" AS e, m.slot_id % 2 AS slot, lag(s."end") OVER w AS pe, lead(s.start) OVER w AS ns, lag(m.slot_id % 2) OVER w AS ps
  FROM segments s JOIN mapping m USING (job_id, speaker) WINDOW w AS (PARTITION BY s.job_id ORDER BY s.start, s.seg_idx)),
r AS (SELECT *, coalesce(sum(CASE WHEN pe IS NULL OR (ps = slot AND start - pe < 3) THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY start, seg_idx), 0) AS run FROM e),
g AS (SELECT job_id, run, slot, min(start) AS s, first(pe ORDER BY seg_idx) AS pe, last(e ORDER BY seg_idx) AS e, last(ns ORDER BY seg_idx) AS ns FROM r GROUP BY 1, 2, 3)
SELECT job_id, CAST(run AS BIGINT) AS run, slot AS slot_id, round(CASE WHEN s - pe < 1.5 THEN pe + (s - pe) / 2 ELSE s END, 4) AS start, round(CASE WHEN ns - e < 1.5 THEN e + (ns - e) / 2 ELSE e END, 4) AS "end" FROM g""")
def _(v):
    m = mapping(v).withColumn("slot_id", (F.col("slot_id") % 2).cast("int"))
    return op.transcript_timeline(v.segments, m).select("job_id", "run", "slot_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query("join23_same_content", """
WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), f AS (SELECT sha, min(doc_id) AS same_as FROM h GROUP BY 1) SELECT doc_id, sha, same_as FROM h JOIN f USING (sha) WHERE doc_id <> same_as""")
def _(v):
    return op.earlier_same_content(v.documents, "doc_id", "text")


@query("join24_speaker_positions", """
WITH p AS (SELECT c.job_id, c.scene_id, c.subject_x, arg_min(s.speaker, s.seg_idx) AS speaker FROM scenes c JOIN segments s ON c.job_id = s.job_id AND c.t BETWEEN s.start - 0.5 AND s."end" + 0.5 GROUP BY 1, 2, 3)
SELECT job_id, speaker, CAST(floor(avg(subject_x) + 0.5) AS BIGINT) AS x FROM p GROUP BY 1, 2""")
def _(v):
    return op.speaker_positions(v.scenes, v.segments)


@query("join26_concurrent_speech", """
WITH ev AS (SELECT job_id, turn_id AS event_id, t_start AS rs, t_end AS re, cluster_id AS slot FROM turns UNION ALL SELECT job_id, event_id + 100, start, "end", slot_id + 1 FROM speaker_events),
c AS (SELECT w.clip_id, e.event_id, e.slot, greatest(w.start, e.rs) AS f, least(w."end", e.re) AS t FROM clips w JOIN ev e ON w.job_id = e.job_id AND e.rs < w."end" AND e.re > w.start),
b AS (SELECT clip_id, slot, row_number() OVER (PARTITION BY clip_id ORDER BY round(sum(t - f), 6) DESC, min(event_id)) AS n FROM c GROUP BY 1, 2),
x AS (SELECT c.*, n FROM c JOIN b USING (clip_id, slot) WHERE n <= 2),
o AS (SELECT a.clip_id, sum(greatest(0, least(a.t, b.t) - greatest(a.f, b.f))) AS s FROM x a JOIN x b ON a.clip_id = b.clip_id AND a.n = 1 AND b.n = 2 GROUP BY 1)
SELECT clip_id, round(coalesce(s, 0), 4) AS overlap FROM clips LEFT JOIN o USING (clip_id)""")
def _(v):
    ev = v.turns.select("job_id", F.col("turn_id").alias("event_id"), F.col("t_start").alias("start"), F.col("t_end").alias("end"), F.col("cluster_id").alias("slot_id")).unionByName(
        v.speaker_events.select("job_id", (F.col("event_id") + 100).alias("event_id"), "start", "end", (F.col("slot_id") + 1).cast("long").alias("slot_id")))
    return op.concurrent_speech(v.clips, ev, "clip_id").select("clip_id", F.round("overlap", 4).alias("overlap"))


@query("join27_pulse_cuts", f"""WITH {BEATS_SQL} SELECT c.job_id, c.seg_key, b.beat AS t FROM crop_segments c JOIN beats b ON b.job_id = c.job_id AND b.beat > c.start + 0.1 AND b.beat < c."end" - 0.1""")
def _(v):
    return op.pulse_cuts(v.crop_segments, beats(v), "seg_key")


@query("join28_spikes_at", """
WITH q AS (SELECT job_id, event_id, t FROM readings WHERE kind = 'view'), e AS (SELECT job_id, t, value FROM readings),
g AS (SELECT q.event_id, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, max(CASE WHEN abs(e.t - q.t) <= 0.2 THEN value END) AS pk FROM q JOIN e ON q.job_id = e.job_id AND abs(e.t - q.t) <= 2 GROUP BY 1)
SELECT q.event_id, coalesce(n >= 3 AND sd > 1e-9 AND pk - m >= 1.5 * sd, false) AS spike FROM q LEFT JOIN g USING (event_id)""")
def _(v):
    env = v.readings.select("job_id", "t", F.col("value").alias("energy"))
    return op.spikes_at(v.readings.where("kind = 'view'"), env, "event_id", sigma=1.5).select("event_id", "spike")


def voiced(v):
    return v.turns.select("job_id", (F.col("t_end") + 0.4 * (F.col("turn_id") % 3)).alias("v_start"), (F.col("t_end") + 0.4 * (F.col("turn_id") % 3) + 1.1).alias("v_end"))


@query("join29_bridge_voice")
def _(v):
    d = op.bridge_voice(v.speaker_events, voiced(v))
    return d.select("job_id", "event_id", "start", F.round("end", 4).alias("end"))


@query("join30_off_screen", """
WITH c AS (SELECT DISTINCT job_id, t FROM moments), l AS (SELECT job_id, t FROM audio_moments),
s AS (SELECT c.job_id, c.t, arg_min(g."end", g.seg_idx) AS se FROM c JOIN segments g ON g.job_id = c.job_id AND c.t BETWEEN g.start AND g."end" GROUP BY 1, 2),
o AS (SELECT DISTINCT e.job_id, e.event_id FROM speaker_events e JOIN s ON e.job_id = s.job_id AND e.slot_id >= 0 AND s.t > e.start AND s.t < e."end" AND s.se > s.t + 0.05
  WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.job_id = e.job_id AND l.t >= s.t AND l.t <= least(e."end", s.se)))
SELECT e.job_id, e.event_id, o.event_id IS NULL AS on_screen FROM speaker_events e LEFT JOIN o USING (job_id, event_id)""")
def _(v):
    return op.off_screen(v.speaker_events, v.segments, v.moments.select("job_id", "t").distinct(), v.audio_moments).select("job_id", "event_id", "on_screen")


METRIC_SQL = """
bm AS (SELECT o_custkey AS slug, CASE o_orderkey % 4 WHEN 0 THEN 'mae_cx' WHEN 1 THEN 'framing_macro_f1' WHEN 2 THEN 'aesthetic_score_mean' ELSE 'other' END AS metric, avg(o_totalprice) / 100000 AS value FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2),
cm AS (SELECT o_custkey AS slug, CASE o_orderkey % 4 WHEN 0 THEN 'mae_cx' WHEN 1 THEN 'framing_macro_f1' WHEN 2 THEN 'aesthetic_score_mean' ELSE 'other' END AS metric, avg(o_totalprice) / 100000 AS value FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)"""


def _metrics(v, where):
    name = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'mae_cx' WHEN 1 THEN 'framing_macro_f1' WHEN 2 THEN 'aesthetic_score_mean' ELSE 'other' END")
    return v.orders.where(where).groupBy(F.col("o_custkey").alias("slug"), name.alias("metric")).agg((F.avg("o_totalprice") / 100000).alias("value"))


@query("join31_gate", f"""
WITH {METRIC_SQL}, d AS (SELECT slug, metric, CASE WHEN metric = 'mae_cx' THEN cm.value - bm.value ELSE bm.value - cm.value END AS harm, CASE metric WHEN 'mae_cx' THEN 0.02 WHEN 'framing_macro_f1' THEN 0.05 WHEN 'aesthetic_score_mean' THEN 0.5 END AS lim
  FROM bm JOIN cm USING (slug, metric)) SELECT slug, metric, round(harm, 6) AS harm FROM d WHERE harm > lim""")
def _(v):
    return op.gate(_metrics(v, "o_orderkey % 3 <> 0"), _metrics(v, "o_orderkey % 3 = 0")).select("slug", "metric", F.round("harm", 6).alias("harm"))


@query("join31_metric_deltas", f"WITH {METRIC_SQL} SELECT slug, metric, round(cm.value - bm.value, 6) AS delta FROM bm JOIN cm USING (slug, metric)")
def _(v):
    return op.metric_deltas(_metrics(v, "o_orderkey % 3 <> 0"), _metrics(v, "o_orderkey % 3 = 0")).withColumn("delta", F.round("delta", 6))


def _truth(v):
    kinds = F.expr("CASE kind WHEN 'view' THEN 'kill' WHEN 'click' THEN 'ult' ELSE 'scoreboard' END")
    return v.readings.where("kind IN ('view', 'click', 'signup')").select("job_id", F.col("event_id").alias("truth_id"), "t", kinds.alias("kind"))


def _detected(v):
    kinds = F.expr("CASE WHEN kind = 'error' THEN 'chaos' WHEN event_id % 2 = 0 THEN 'kill' ELSE 'scoreboard' END")
    return v.readings.where("kind IN ('error', 'purchase')").select("job_id", F.col("event_id").alias("det_id"), "t", kinds.alias("kind"))


EVENT_MATCH_SQL = """
tr AS (SELECT job_id, event_id AS truth_id, t, CASE kind WHEN 'view' THEN 'kill' WHEN 'click' THEN 'ult' ELSE 'scoreboard' END AS k FROM readings WHERE kind IN ('view', 'click', 'signup')),
dt AS (SELECT job_id, event_id AS det_id, t, CASE WHEN kind = 'error' THEN 'chaos' WHEN event_id % 2 = 0 THEN 'kill' ELSE 'scoreboard' END AS k FROM readings WHERE kind IN ('error', 'purchase')),
nr AS (SELECT dt.job_id, det_id, list(truth_id ORDER BY truth_id) AS near, row_number() OVER (PARTITION BY dt.job_id ORDER BY det_id) AS rn
  FROM dt JOIN tr ON tr.job_id = dt.job_id AND abs(dt.t - tr.t) <= 1.0 AND (dt.k = tr.k OR (dt.k = 'chaos' AND tr.k IN ('kill', 'ult'))) GROUP BY 1, 2),
mt AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS BIGINT) AS truth_id, CAST([] AS BIGINT[]) AS taken FROM nr
UNION ALL SELECT job_id, rn, det_id, hit, CASE WHEN hit IS NULL THEN taken ELSE list_append(taken, hit) END
  FROM (SELECT nr.job_id, nr.rn, nr.det_id, taken, list_filter(near, lambda x: NOT list_contains(taken, x))[1] AS hit FROM mt JOIN nr ON nr.job_id = mt.job_id AND nr.rn = mt.rn + 1) q)"""


@query("join32_match_events", f"WITH RECURSIVE {EVENT_MATCH_SQL} SELECT job_id, det_id, truth_id FROM mt WHERE truth_id IS NOT NULL")
def _(v):
    return op.match_events(_truth(v), _detected(v))


@query("join32_match_scores", f"""
WITH RECURSIVE {EVENT_MATCH_SQL}, c AS (SELECT job_id, (SELECT count(*) FROM tr WHERE tr.job_id = j.job_id) AS n_truth, (SELECT count(*) FROM dt WHERE dt.job_id = j.job_id) AS n_detected,
  (SELECT count(*) FROM mt WHERE mt.job_id = j.job_id AND truth_id IS NOT NULL) AS m FROM (SELECT DISTINCT job_id FROM readings) j)
SELECT job_id, CASE WHEN n_truth > 0 THEN round(m / n_truth, 3) ELSE 1.0 END AS recall, CASE WHEN n_detected > 0 THEN round(m / n_detected, 3) ELSE 1.0 END AS "precision", n_truth, n_detected FROM c""")
def _(v):
    t, d = _truth(v), _detected(v)
    return op.match_scores(v.readings.select("job_id").distinct(), t, d, op.match_events(t, d))


@query("join33_tracking_error", """
WITH a AS (SELECT job_id, event_id, t, value % 100 AS x, value / 2 AS y FROM readings WHERE kind = 'click'), b AS (SELECT job_id, t, max(struct_pack(x := value % 100, y := value / 3)) AS p FROM readings WHERE kind = 'view' GROUP BY 1, 2),
p AS (SELECT a.job_id, a.event_id, sqrt(power(b.p.x - a.x, 2) + power(b.p.y - a.y, 2)) AS err, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.t - a.t), b.t) AS n FROM a JOIN b ON a.job_id = b.job_id AND abs(a.t - b.t) <= 0.5),
g AS (SELECT job_id, round(avg(err), 3) AS mean, count(*) AS n_compared, list_sort(list(err)) AS l FROM p WHERE n = 1 GROUP BY 1)
SELECT job_id, mean, n_compared, round(l[CAST(floor((n_compared - 1) * 0.95) AS BIGINT) + 1], 3) AS p95 FROM g""")
def _(v):
    a = v.readings.where("kind = 'click'").select("job_id", "event_id", "t", (F.col("value") % 100).alias("x"), (F.col("value") / 2).alias("y"))
    b = v.readings.where("kind = 'view'").select("job_id", "t", (F.col("value") % 100).alias("x"), (F.col("value") / 3).alias("y"))
    return op.tracking_error(a, b)


@query("join34_crop_pass_rate", """
WITH s AS (SELECT *, greatest(0, least(subject_x - 15.82, 100 - 31.64)) AS l FROM crop_segments),
f AS (SELECT s.seg_key, f.t, bool_or(f.slot_id <> 4 AND f.x BETWEEN l AND l + 31.64) AS ok FROM s JOIN faces f ON f.job_id = s.job_id AND f.t BETWEEN s.start AND s."end" GROUP BY 1, 2),
r AS (SELECT seg_key, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS r FROM f GROUP BY 1) SELECT seg_key, round(coalesce(r, 0.0), 6) AS pass_rate FROM s LEFT JOIN r USING (seg_key)""")
def _(v):
    f = v.faces.withColumn("slot_id", F.when(F.col("slot_id") == 4, -1).otherwise(F.col("slot_id")))
    return op.crop_pass_rate(v.crop_segments, f, "seg_key", 31.64).select("seg_key", F.round("pass_rate", 6).alias("pass_rate"))


@query("join35_speech_led_cuts", f"""
WITH {MAPPING_SQL}, d AS (SELECT job_id, seg_key, start, active_slot % 3 AS slot, lag(active_slot % 3) OVER w AS ps, row_number() OVER w AS rn FROM crop_segments WINDOW w AS (PARTITION BY job_id ORDER BY start, seg_key)),
c AS (SELECT * FROM d WHERE rn > 1 AND slot IS NOT NULL AND ps IS DISTINCT FROM slot),
t AS (SELECT s.job_id, m.slot_id, s.start FROM segments s JOIN mapping m USING (job_id, speaker)),
p AS (SELECT c.job_id, c.seg_key, c.slot, t.start + 0.2 - c.start AS delta, row_number() OVER (PARTITION BY c.seg_key ORDER BY abs(t.start - c.start), t.start) AS n FROM c JOIN t ON t.job_id = c.job_id AND t.slot_id = c.slot AND abs(t.start - c.start) <= 4)
SELECT seg_key, slot AS active_slot, round(delta, 4) AS delta FROM p WHERE n = 1 AND abs(delta) >= 0.01""")
def _(v):
    shots = v.crop_segments.withColumn("active_slot", F.col("active_slot") % 3)
    return op.speech_led_cuts(shots, v.segments, mapping(v), "seg_key", reach=4.0).select("seg_key", "active_slot", F.round("delta", 4).alias("delta"))


@query("join36_listener_holds", f"""
WITH {MAPPING_SQL}, k AS (SELECT job_id FROM faces GROUP BY 1 HAVING count(DISTINCT slot_id) >= 2),
n AS (SELECT *, lead(speaker) OVER w AS nsp, lead(start) OVER w - "end" AS gap FROM segments WINDOW w AS (PARTITION BY job_id ORDER BY seg_idx)),
d AS (SELECT n.job_id, n.seg_idx, n."end" AS t, least(gap, 0.8) AS hold, m.slot_id AS listener FROM n JOIN mapping m ON m.job_id = n.job_id AND m.speaker = n.nsp
  WHERE regexp_matches(rtrim(text), '[.!?][''"]?$') AND nsp <> n.speaker AND gap >= 0.4 AND n.job_id IN (SELECT job_id FROM k)),
h AS (SELECT d.job_id, d.seg_idx, d.listener, round(d.hold, 4) AS hold, arg_min(c.seg_key, struct_pack(s := c.start, k := c.seg_key)) AS seg_key FROM d JOIN crop_segments c ON c.job_id = d.job_id AND d.t >= c.start AND d.t < c."end" GROUP BY ALL)
SELECT * FROM h""")
def _(v):
    return op.listener_holds(v.crop_segments, v.segments, mapping(v), slots(v), "seg_key").withColumn("hold", F.round("hold", 4))


@query("join36_reaction_beats", """
WITH h AS (SELECT m.moment_id, arg_min(struct_pack(k := c.seg_key, a := c.active_slot), struct_pack(s := c.start, k := c.seg_key)) AS r FROM audio_moments m JOIN crop_segments c ON c.job_id = m.job_id AND m.t >= c.start AND m.t < c."end" WHERE m.kind IN ('spike', 'silence_to_loud') GROUP BY 1)
SELECT moment_id, r.k AS seg_key, CASE WHEN r.a = 1 THEN 2 ELSE 1 END AS reactor, 0.8 AS seconds FROM h WHERE r.a IS NOT NULL""", doubles=("seconds",))
def _(v):
    return op.reaction_beats(v.crop_segments, v.audio_moments, slots(v), "seg_key", ("spike", "silence_to_loud")).select("moment_id", "seg_key", "reactor", "seconds")


@query("join37_best_anchors", """
WITH h AS (SELECT c.seg_key, first(struct_pack(x := f.x, s := f.class_name) ORDER BY f.confidence DESC, f.t, f.face_key) AS b FROM crop_segments c JOIN faces f ON f.job_id = c.job_id AND f.t BETWEEN c.start AND c."end" WHERE f.confidence >= 0.3 GROUP BY 1)
SELECT seg_key, coalesce(b.x, 50.0) AS x, coalesce(b.s, 'fallback') AS source FROM crop_segments LEFT JOIN h USING (seg_key)""")
def _(v):
    a = v.faces.select("job_id", F.col("face_key").alias("anchor_id"), "t", F.col("confidence").alias("score"), "x", F.col("class_name").alias("source"))
    return op.best_anchors(v.crop_segments, a, "seg_key").select("seg_key", "x", "source")


@query("join39_shot_focus", """
WITH f AS (SELECT *, slot_id <= 4 AS req, slot_id = 2 AS exc, confidence + 0.01 AS wt FROM faces),
g AS (SELECT c.seg_key, max(x + w / 2) FILTER (req) - min(x - w / 2) FILTER (req) AS width, max(y + h / 2) FILTER (req) - min(y - h / 2) FILTER (req) AS height, count(*) FILTER (req) AS nr, count(*) FILTER (NOT req) AS no,
  sum(x * wt) FILTER (req AND NOT exc) / sum(wt) FILTER (req AND NOT exc) AS cx, sum(y * wt) FILTER (req AND NOT exc) / sum(wt) FILTER (req AND NOT exc) AS cy
  FROM crop_segments c JOIN f ON f.job_id = c.job_id AND f.t >= c.start AND f.t < c."end" GROUP BY 1),
d AS (SELECT seg_key, coalesce(nr, 0) AS n_required, coalesce(no, 0) AS n_optional, coalesce(width, 0.0) AS width, coalesce(height, 0.0) AS height, cx, cy, (coalesce(nr, 0) = 0 OR (width <= 80 AND height <= 100)) AS fits FROM crop_segments LEFT JOIN g USING (seg_key))
SELECT seg_key, n_required, n_optional, width, height, fits, round(CASE WHEN cx IS NULL THEN 50.0 WHEN fits THEN greatest(40, least(60, cx)) ELSE cx END, 6) AS cx, round(CASE WHEN cy IS NULL THEN 50.0 WHEN fits THEN greatest(0, least(100, cy)) ELSE cy END, 6) AS cy FROM d""")
def _(v):
    f = v.faces.select("job_id", "t", "x", "y", "w", "h", (F.col("confidence") + 0.01).alias("weight"), (F.col("slot_id") <= 4).alias("required"), (F.col("slot_id") == 2).alias("excluded"))
    return op.shot_focus(v.crop_segments, f, "seg_key", 80.0).drop("job_id").withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query("join41_slot_roles", """
WITH s AS (SELECT DISTINCT job_id, slot_id FROM speaker_events WHERE slot_id >= 0),
a AS (SELECT c.clip_id, e.slot_id, max(least(e."end", c."end")) AS last, max(e.confidence) AS conf FROM clips c JOIN speaker_events e ON e.job_id = c.job_id AND e.slot_id >= 0 AND e."end" >= c.start AND e.start <= c."end" GROUP BY 1, 2)
SELECT c.clip_id, s.slot_id, CASE WHEN conf >= 0.7 AND c."end" - last BETWEEN 0 AND 2 THEN 'required' ELSE 'optional' END AS role FROM clips c JOIN s USING (job_id) LEFT JOIN a ON a.clip_id = c.clip_id AND a.slot_id = s.slot_id""")
def _(v):
    s = v.speaker_events.where("slot_id >= 0").select("job_id", "slot_id").distinct()
    return op.slot_roles(v.clips, s, v.speaker_events, "clip_id").select("clip_id", "slot_id", "role")
