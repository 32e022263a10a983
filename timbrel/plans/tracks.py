"""Queries: tracks, slots, sampling, speaker timelines and answer parsing."""

from pyspark.sql import functions as F

from ..operators import speakers as sp
from ..operators import tracks as op
from ..operators.fingerprints import match_to_slots
from ..operators.windows import difference_spikes, merged_turns
from .clips import JOBS, jobs
from .filters import catalog
from .joins import identity_faces, mapping, slots
from .registry import query
from .windows import kept_sql, path, samples



@query("topk1_page", """
SELECT job_id, status FROM (SELECT *, row_number() OVER (ORDER BY created_s DESC, job_id) AS n FROM jobs WHERE status = 'complete') WHERE n > 5 AND n <= 15""")
def _(v):
    return op.page(catalog(v), 10, 5, "complete")[0].select("job_id", "status")


def regions(v):
    return v.faces.select("job_id", "t", F.col("face_key").alias("region_id"), "x", "y", (F.col("w") * 2).alias("w"), (F.col("h") * 2.5).alias("h"), F.col("confidence").alias("score"))


@query("topk4_top_regions", """
WITH r AS (SELECT *, w * 2 AS ww, row_number() OVER (PARTITION BY job_id, t ORDER BY confidence DESC, face_key) AS rank FROM faces)
SELECT face_key AS region_id, rank, greatest(0, x / 100 - ww / 200) AS "left", round(avg(confidence) OVER (PARTITION BY job_id, t), 6) AS mean_score FROM r WHERE rank <= 3""")
def _(v):
    return op.top_regions(regions(v)).select("region_id", F.col("rank").cast("long").alias("rank"), "left", F.round("mean_score", 6).alias("mean_score"))


@query("topk4_best_region", "SELECT job_id, t, first(face_key ORDER BY confidence DESC, face_key) AS region_id FROM faces GROUP BY 1, 2")
def _(v):
    return op.best_region(regions(v)).select("job_id", "t", "region_id")


@query("topk5_trim_even", """
WITH RECURSIVE p AS (SELECT DISTINCT job_id, t FROM moments), n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY job_id) AS n, 20 + job_id % 7 * 20 AS cap FROM p),
q AS (SELECT DISTINCT job_id, CAST(round_even(c * n::DOUBLE / cap, 0) AS BIGINT) AS i FROM (SELECT DISTINCT job_id, n, cap, unnest(range(cap)) AS c FROM n WHERE n > cap)),
s AS (SELECT n.job_id, n.t, 0 AS id FROM n JOIN q USING (job_id, i)), """ + kept_sql("s", 0.05) + " SELECT job_id, t FROM k WHERE kept UNION ALL SELECT job_id, t FROM n WHERE n <= cap")
def _(v):
    caps = v.moments.select("job_id").distinct().withColumn("cap", 20 + F.col("job_id") % 7 * 20)
    return op.trim_even(v.moments.select("job_id", "t").distinct(), caps)


@query("topk6_sentiment_lines", """
WITH m AS (SELECT job_id, moment_id, t, delta_db, CASE moment_id % 4 WHEN 0 THEN 'neutral' WHEN 1 THEN 'laughter' ELSE 'cheering' END AS s FROM audio_moments), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY delta_db DESC, t, moment_id) AS n FROM m WHERE s <> 'neutral')
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY t, moment_id) AS line_no, s || ' (+' || delta_db || 'dB)' AS line FROM r WHERE n <= 20""")
def _(v):
    m = v.audio_moments.withColumn("sentiment", F.expr("CASE moment_id % 4 WHEN 0 THEN 'neutral' WHEN 1 THEN 'laughter' ELSE 'cheering' END"))
    # the printed time is left out of the comparison: engines round it differently
    return op.sentiment_lines(m).withColumn("line", F.regexp_extract("line", r"\] (.*)", 1))


@query("topk6_energy_lines", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY delta_db DESC, t, moment_id) AS n FROM audio_moments)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY t, moment_id) AS line_no, '[' || CAST(round_even(t, 0) AS BIGINT) || 's] ' || CASE kind WHEN 'silence_to_loud' THEN 'SILENCE->LOUD' ELSE 'SPIKE' END || ' (+' || delta_db || 'dB)' AS line FROM r WHERE n <= 25""")
def _(v):
    return op.energy_lines(v.audio_moments.withColumnRenamed("kind", "type"))


@query("topk6_zone_lines")
def _(v):
    from ..operators.clips import hot_zones

    return op.zone_lines(hot_zones(jobs(v), v.segments))


@query("topk7_condense")
def _(v):
    z = jobs(v).select("job_id", F.lit(60.0).alias("start"), F.lit(90.0).alias("end"))
    return op.condense(merged_turns(v.segments), z, 1500).select("job_id", "run", "bucket", "line")


@query("topk7_condense_hot")
def _(v):
    z = jobs(v).select("job_id", F.explode(F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("composite")) for a, b, c in ((0.0, 40.0, 10.0), (30.0, 90.0, 60.0), (80.0, 150.0, 30.0))])).alias("z")).select("job_id", "z.*")
    return op.condense_hot(v.segments, z, 4000)


@query("topk8_promote_regions", """
WITH r AS (SELECT job_id, CAST(t AS BIGINT) AS frame, face_key, confidence, CASE WHEN slot_id = 7 AND job_id % 2 = 0 THEN 'required' WHEN slot_id <= 3 THEN 'preferred' ELSE 'optional' END AS tier FROM faces WHERE face_key % 3 = 0),
b AS (SELECT job_id, frame, bool_or(tier = 'required') AS h, first(face_key ORDER BY confidence DESC, face_key) FILTER (tier = 'preferred' AND confidence >= 0.6) AS best FROM r GROUP BY 1, 2)
SELECT face_key AS region_id, CASE WHEN NOT h AND face_key = best THEN 'required' ELSE tier END AS tier FROM r JOIN b USING (job_id, frame)""")
def _(v):
    tier = F.when((F.col("slot_id") == 7) & (F.col("job_id") % 2 == 0), "required").when(F.col("slot_id") <= 3, "preferred").otherwise("optional")
    r = v.faces.where("face_key % 3 = 0").select("job_id", F.col("t").cast("long").alias("frame"), F.col("face_key").alias("region_id"), F.col("confidence").alias("score"), tier.alias("tier"))
    return op.promote_regions(r, dialogue=True).select("region_id", "tier")


@query("set1_sample_times")
def _(v):
    j = v.moments.groupBy("job_id").agg(F.max("t").alias("duration"))
    w = v.scenes.select("job_id", F.col("t").alias("start"), (F.col("t") + 3).alias("end"))
    return op.sample_times(j, v.audio_moments, w, v.moments.where("kind = 'signup'"))


@query("set11_voiced_intervals", """
WITH f AS (SELECT DISTINCT job_id, CAST(floor(t * 20) AS BIGINT) AS f FROM readings), g AS (SELECT *, (f - lag(f) OVER (PARTITION BY job_id ORDER BY f) - 1) * 0.05 AS gap FROM f),
r AS (SELECT *, sum(CASE WHEN gap >= 0.6 - 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY f) AS run FROM g) SELECT job_id, round(min(f) * 0.05, 4) AS start, round((max(f) + 1) * 0.05, 4) AS "end" FROM r GROUP BY job_id, run""", doubles=("start", "end"))
def _(v):
    f = v.readings.select("job_id", F.floor(F.col("t") * 20).alias("frame"), F.lit(True).alias("voiced")).distinct()
    return op.voiced_intervals(f, 0.05, 0.6).select("job_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query("set12_analysis_windows", """
WITH j AS (SELECT job_no AS job_id, 60.0 + job_no * 97 % 20000 AS d FROM jobs), w AS (SELECT *, unnest(range(CAST(ceil(d / 480) AS BIGINT))) AS win FROM j), n AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n, CASE WHEN d <= 7200 THEN 8 WHEN d <= 14400 THEN 10 ELSE 12 END AS cap FROM w),
s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY win) AS r FROM n WHERE n <= cap OR win % greatest(1, n // cap) = 0 OR win = n - 1) SELECT job_id, win, win * 480.0 AS start, least(win * 480.0 + 600, d) AS "end" FROM s WHERE n <= cap OR r <= cap""", doubles=("start", "end"))
def _(v):
    j = v.jobs.select(F.col("job_no").alias("job_id"), (60.0 + F.col("job_no") * 97 % 20000).alias("duration"))
    return op.analysis_windows(j, sequential=True)


@query("set13_summary_chunks", f"""
WITH {JOBS}, c AS (SELECT job_id, duration, unnest(range(CAST(ceil(duration / 120) AS BIGINT))) AS chunk FROM jb) SELECT c.job_id, chunk, s.seg_idx FROM c JOIN segments s ON s.job_id = c.job_id AND s.start >= chunk * 120 - 30 AND s."end" <= least((chunk + 1) * 120, duration) + 30""")
def _(v):
    return op.summary_chunks(jobs(v), v.segments, 120.0)


def histograms(v):
    from ..functions.text import unit_mass

    return v.embeddings.select((F.col("vec_id") % 20).alias("job_id"), F.col("vec_id").alias("print_id"), unit_mass(F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")))).alias("histogram"))


@query("set14_fingerprint_clusters", """
WITH RECURSIVE a AS (SELECT vec_id % 20 AS job_id, vec_id AS print_id, list_transform(embedding[1:8], lambda x: abs(CAST(x AS DOUBLE))) AS w FROM embeddings),
h AS (SELECT job_id, print_id, list_transform(w, lambda x: x / list_sum(w)) AS v, row_number() OVER (PARTITION BY job_id ORDER BY print_id) AS rn FROM a),
r AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS print_id, CAST(NULL AS BIGINT) AS cluster, CAST([] AS STRUCT(c DOUBLE[], n BIGINT)[]) AS cs FROM h
UNION ALL SELECT job_id, rn, print_id, slot, CASE WHEN slot = len(cs) THEN list_append(cs, {'c': v, 'n': CAST(1 AS BIGINT)})
  ELSE list_transform(cs, lambda s, i: CASE WHEN i = slot + 1 THEN {'c': list_transform(range(1, 9), lambda k: (s.c[k] * s.n + v[k]) / (s.n + 1)), 'n': s.n + 1} ELSE s END) END
  FROM (SELECT *, CASE WHEN list_min(ds) <= 0.3 THEN CAST(list_position(ds, list_min(ds)) - 1 AS BIGINT) ELSE CAST(len(cs) AS BIGINT) END AS slot
    FROM (SELECT h.job_id, h.rn, h.print_id, h.v, cs, list_transform(cs, lambda s: list_sum(list_transform(range(1, 9), lambda k: (v[k] - s.c[k]) ** 2 / (v[k] + s.c[k] + 1e-9)))) AS ds
      FROM r JOIN h ON h.job_id = r.job_id AND h.rn = r.rn + 1)))
SELECT job_id, print_id, cluster FROM r WHERE print_id IS NOT NULL""")
def _(v):
    return op.fingerprint_clusters(histograms(v))


def whole_histograms(v):
    from ..functions.text import unit_mass

    return v.embeddings.select((F.col("vec_id") % 20).alias("job_id"), F.col("vec_id").alias("print_id"), unit_mass(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("histogram"))


def known_slots(prints):
    """Slots 0, 5 and 10 of every second job: the mean histogram of each third of its fingerprints."""
    entry = prints.where("job_id % 2 = 0").select("job_id", (F.floor(F.col("print_id") / 20) % 3 * 5).alias("slot_id"), F.posexplode("histogram").alias("i", "x"))
    mean = entry.groupBy("job_id", "slot_id", "i").agg(F.round(F.avg("x"), 9).alias("x"))
    return mean.groupBy("job_id", "slot_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


@query("set14_match_to_slots", """
WITH RECURSIVE a AS (SELECT vec_id % 20 AS job_id, vec_id AS print_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS w FROM embeddings),
h AS (SELECT job_id, print_id, list_transform(w, lambda x: x / list_sum(w)) AS v FROM a),
e AS (SELECT job_id, print_id // 20 % 3 * 5 AS slot_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM h WHERE job_id % 2 = 0),
s AS (SELECT job_id, slot_id, list(x ORDER BY i) AS v FROM (SELECT job_id, slot_id, i, round(avg(x), 9) AS x FROM e GROUP BY ALL) GROUP BY ALL),
m AS (SELECT job_id, slot_id AS slot, CAST(NULL AS BIGINT) AS born, v FROM s UNION ALL SELECT job_id, NULL, print_id, v FROM h),
d AS (SELECT h.job_id, print_id, slot, born, list_sum(list_transform(range(1, 65), lambda i: (h.v[i] - m.v[i]) ** 2 / (h.v[i] + m.v[i] + 1e-9))) AS far FROM h JOIN m ON m.job_id = h.job_id AND (born IS NULL OR born <= print_id)),
n AS (SELECT job_id, print_id, bool_or(slot IS NOT NULL) AS known, list(born) FILTER (born < print_id) AS near, row_number() OVER (PARTITION BY job_id ORDER BY print_id) AS rn FROM d WHERE far <= 0.36 GROUP BY 1, 2),
r AS (SELECT job_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS made FROM (SELECT DISTINCT job_id FROM n)
UNION ALL SELECT r.job_id, n.rn, CASE WHEN known OR coalesce(list_has_any(near, made), false) THEN made ELSE list_append(made, print_id) END FROM r JOIN n ON n.job_id = r.job_id AND n.rn = r.rn + 1),
l AS (SELECT job_id, unnest(made) AS born, unnest(range(len(made))) AS k FROM (SELECT job_id, max_by(made, rn) AS made FROM r GROUP BY 1)),
t AS (SELECT job_id, max(slot_id) AS top FROM s GROUP BY 1),
c AS (SELECT d.job_id, print_id, far, CAST(coalesce(slot, coalesce(top, -1) + 1 + k) AS BIGINT) AS slot_id FROM d LEFT JOIN l ON l.job_id = d.job_id AND l.born = d.born LEFT JOIN t ON t.job_id = d.job_id WHERE far <= 0.36 AND (slot IS NOT NULL OR k IS NOT NULL))
SELECT job_id, print_id, slot_id FROM c QUALIFY row_number() OVER (PARTITION BY job_id, print_id ORDER BY far, slot_id) = 1""")
def _(v):
    prints = whole_histograms(v)
    return match_to_slots(prints, known_slots(prints), 0.36)[0]


@query("set15_position_clusters")
def _(v):
    x = F.col("value") % 9 + F.when(F.col("event_id") % 3 == 0, 10).when(F.col("event_id") % 3 == 1, 45).otherwise(80)
    return op.position_clusters(v.readings.select("job_id", F.col("event_id").alias("sample_id"), x.alias("x")))


@query("set16_vector_clusters")
def _(v):
    return op.vector_clusters(v.embeddings.select("vec_id", "embedding"), 5)[0].select("vec_id", "prediction")


@query("win30_region_clusters")
def _(v):
    return op.region_clusters(regions(v).withColumn("t", F.col("t") / 4), v.moments.where("kind = 'view'").select("job_id", (F.col("t") / 100).alias("t"))).select("job_id", "region_id", "cluster_id")


@query("win30_promoted_clusters")
def _(v):
    r = regions(v).withColumn("t", F.col("t") / 4)
    c = op.region_clusters(r, v.moments.where("kind = 'view'").select("job_id", (F.col("t") / 100).alias("t")), iou=0.1)
    return op.promoted_clusters(c, 2)


@query("agg25_slot_registry")
def _(v):
    return op.slot_registry(v.faces.where("slot_id <= 3").withColumn("x", F.col("slot_id") * 25 + F.col("x") / 10))


@query("agg27_merge_twin_slots")
def _(v):
    f = identity_faces(v).withColumn("slot_id", (F.col("face_id") % 6).cast("long"))
    s = f.groupBy("job_id", "slot_id").agg(F.count("*").alias("frame_count")).withColumns({"x_center": F.col("slot_id") * 5.0, "x_min": F.col("slot_id") * 4.0, "x_max": F.col("slot_id") * 6.0, "avg_width": F.lit(8.0), "avg_height": F.lit(9.0)})
    return op.merge_twin_slots(s, f, alike=0.05)


@query("agg41_timeline_summary", "SELECT job_id, count(*) AS n_samples, count(*) FILTER (event_id % 3 = 0) AS n_anchors, count(*) FILTER (event_id % 11 = 0) AS n_resets, max(t) AS duration FROM readings GROUP BY 1")
def _(v):
    return op.timeline_summary(v.readings.withColumns({"is_anchor": F.col("event_id") % 3 == 0, "had_reset": F.col("event_id") % 11 == 0}))


@query("agg46_fallback_position")
def _(v):
    return op.fallback_position(v.crop_segments, regions(v), v.faces, v.speaker_events, slots(v), "seg_key", op.FALLBACK_ORDER["vlog"])


@query("agg48_clip_position", """
WITH i AS (SELECT c.clip_id, avg(s.subject_x) AS x FROM clips c JOIN scenes s ON s.job_id = c.job_id AND s.t BETWEEN c.start AND c."end" GROUP BY 1),
n AS (SELECT c.clip_id, c.start, c."end" AS e, (SELECT struct_pack(t := s.t, x := s.subject_x) FROM scenes s WHERE s.job_id = c.job_id AND s.t < c.start ORDER BY s.t DESC, scene_id DESC LIMIT 1) AS b, (SELECT struct_pack(t := s.t, x := s.subject_x) FROM scenes s WHERE s.job_id = c.job_id AND s.t > c."end" ORDER BY s.t, scene_id DESC LIMIT 1) AS a FROM clips c),
p AS (SELECT n.clip_id, coalesce(i.x, CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN b.x + (a.x - b.x) * ((start + e) / 2 - b.t) / (a.t - b.t) END, b.x, a.x) AS x FROM n LEFT JOIN i USING (clip_id)) SELECT clip_id, coalesce(CAST(greatest(10, least(90, floor(x + 0.5))) AS BIGINT), 50) AS x FROM p""")
def _(v):
    return op.clip_position(v.clips, v.scenes).select("clip_id", F.col("x").cast("long").alias("x"))


@query("agg48_face_height", """
WITH h AS (SELECT job_id, CAST(t AS DOUBLE) AS t, arg_min(y, CASE WHEN lip >= 0.04 THEN 0 ELSE 100000000000000000 END + face_key) AS y FROM faces GROUP BY 1, 2),
i AS (SELECT c.clip_id, avg(h.y) AS y FROM clips c JOIN h ON h.job_id = c.job_id AND h.t BETWEEN c.start AND c."end" GROUP BY 1) SELECT clip_id, round(coalesce(i.y, 50.0), 5) AS y FROM clips LEFT JOIN i USING (clip_id)""")
def _(v):
    t = F.col("t").cast("double")
    faces = v.faces.select("job_id", t.cast("long").alias("scene_id"), t.alias("t"), F.col("face_key").alias("face_no"), (F.col("lip") >= 0.04).alias("is_speaking"), "y")
    return op.clip_face_height(v.clips, faces).select("clip_id", F.round("y", 5).alias("y"))


@query("join25_interval_slot")
def _(v):
    return op.interval_slot(v.crop_segments, v.segments, mapping(v), v.speaker_events, v.faces.where("confidence > 0.5"), slots(v), "seg_key", 31.64)


@query("join38_subject_track")
def _(v):
    j = v.faces.groupBy("job_id").agg(F.max("t").alias("duration"))
    sal = v.readings.where("kind = 'click'").select("job_id", "t", (F.col("value") % 101).alias("x"), F.lit(50.0).alias("y"), F.lit(0.5).alias("conf"))
    sc = v.scenes.select("job_id", F.col("t"), F.col("subject_x").cast("double").alias("x"), F.lit(50.0).alias("y"), F.lit(0.4).alias("conf"))
    return op.subject_track(j, {"face": op.frame_faces(v.faces.where("t % 7 = 0")), "saliency": sal.groupBy("job_id", "t").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("conf").alias("conf")), "scene": sc})


@query("join40_key_scenes")
def _(v):
    return op.key_scenes(jobs(v), v.scenes.where("job_id % 3 = 0"), v.segments.where("job_id % 3 <> 2"))


@query("fn17_anchor_score", """
WITH p AS (SELECT face_key, 0.4::DOUBLE * confidence AS f, 0.4::DOUBLE * least(1, lip * 20) AS m, 0.1::DOUBLE * least(1, w / 20) AS c, 0.1::DOUBLE * least(1, h / 16) AS s, x, y FROM faces)
SELECT face_key, round(least(1, f + m + c + s), 6) AS score, CASE WHEN greatest(f, m, c, s) <= 1e-9 THEN 'fallback' WHEN f >= greatest(m, c, s) THEN 'face' WHEN m >= greatest(c, s) THEN 'motion' WHEN c >= s THEN 'contrast' ELSE 'saturation' END AS source FROM p""")
def _(v):
    d = v.faces.select("face_key", F.col("confidence").alias("face_score"), (F.col("lip") * 20).alias("motion_energy"), (F.col("w") / 20).alias("contrast"), (F.col("h") / 16).alias("saturation"), F.col("x").alias("face_x"), F.col("y").alias("face_y"), F.col("x").alias("motion_x"), F.col("x").alias("contrast_x"))
    return d.select("face_key", op.anchor_score("action").alias("a")).select("face_key", F.round("a.score", 6).alias("score"), "a.source")


def clip_raw(v):
    """Model answers with three clips each, some cut off in the middle of the last clip."""
    one = lambda i: F.format_string('{"id": %d, "title": "Clip {%d}", "start_time": %d, "end_time": "%d", "hook_score": %d, "viral_score": %s}', F.lit(i), F.col("o_orderkey"), F.col("o_orderkey") % 200, F.col("o_orderkey") % 200 + 5 + 20 * i, F.col("o_orderkey") % 130, F.when(F.col("o_orderkey") % 2 == 0, '"88"').otherwise("null"))
    full = F.concat(F.lit('<think>plan "clips": [</think>{"clips": ['), one(0), F.lit(", "), one(1), F.lit(", "), one(2), F.lit("]}"))
    return v.orders.select(F.col("o_orderkey").alias("answer_id"), F.when(F.col("o_orderkey") % 3 == 0, F.substr(full, F.lit(1), F.length(full) - 12)).otherwise(full).alias("raw"))


@query("fn14_clip_answers", """
SELECT o_orderkey AS answer_id, i AS pos, CAST(o_orderkey % 200 AS DOUBLE) AS start, 5.0 + 20 * i AS duration, CASE WHEN o_orderkey % 2 = 0 THEN 88 WHEN least(100, o_orderkey % 130) > 0 THEN least(100, o_orderkey % 130) ELSE 50 END AS viral_score,
 CASE WHEN o_orderkey % 130 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 88 ELSE 50 END ELSE least(100, o_orderkey % 130) END AS hook_score FROM orders, range(3) AS r(i) WHERE i >= 1 AND NOT (o_orderkey % 3 = 0 AND i = 2)""", doubles=("duration",))
def _(v):
    return op.clip_answers(clip_raw(v)).select("answer_id", F.col("pos").cast("long").alias("pos"), "start", "duration", "viral_score", "hook_score")


@query("fn15_scene_answers", """
WITH d AS (SELECT o_orderkey AS k, o_orderkey % 140 / 100.0::DOUBLE - 0.2 AS a, o_orderkey % 90 / 100.0::DOUBLE AS b FROM orders), e AS (SELECT *, greatest(0, least(1, least(a, b))) AS l, greatest(0, least(1, greatest(a, b))) AS r FROM d),
f AS (SELECT *, CASE WHEN k % 3 = 0 AND r - l >= 1e-6 THEN (l + r) / 2 * 100 WHEN k % 3 = 1 THEN CAST(k % 100 AS DOUBLE) END AS x, k % 3 = 0 AND r - l >= 1e-6 AS boxed FROM e)
SELECT k AS answer_id, CAST(1 + k % 10 AS BIGINT) AS importance, round(CASE WHEN boxed THEN (k % 101) / CASE WHEN k % 101 > 1 THEN 100.0 ELSE 1 END WHEN x IS NOT NULL THEN 0.5 ELSE 0 END, 6) AS confidence, x IS NULL AS empty FROM f""")
def _(v):
    k = F.col("o_orderkey")
    box = F.format_string('{"subject_box": [%.2f, 0.1, %.2f, 0.9], "subject_confidence": "%d", "importance_score": %d}', k % 140 / 100.0 - 0.2, k % 90 / 100.0, k % 101, 1 + k % 10)
    old = F.format_string('Answer: {"subject_x": "%d%%", "importance_score": "%d"}', k % 100, 1 + k % 10)
    raw = F.when(k % 3 == 0, box).when(k % 3 == 1, old).otherwise(F.format_string('{"importance_score": %d}', 1 + k % 10))
    d = op.scene_answers(v.orders.select(k.alias("answer_id"), raw.alias("raw"), F.lit(0.0).alias("frame_t")))
    return d.select("answer_id", "importance", F.round("confidence", 6).alias("confidence"), F.col("subject_box").isNull().alias("empty"))


def lips(v):
    return v.faces.withColumn("slot_id", F.col("slot_id") % 3)


@query("score10_lip_scores")
def _(v):
    return sp.lip_scores(v.segments, lips(v), v.words)


@query("score10_lip_timeline")
def _(v):
    return sp.lip_timeline(v.segments, lips(v), v.words)


@query("score11_game_events")
def _(v):
    s = difference_spikes(samples(v), 15.0, 0.5, 2.0).withColumn("spike_id", F.round(F.col("start") * 1000).cast("long"))
    s = s.withColumn("zone", F.expr("CASE spike_id % 3 WHEN 0 THEN 'killfeed' WHEN 1 THEN 'ability' ELSE 'minimap' END"))
    return sp.game_events(s, v.readings.select("job_id", "t", F.col("value").alias("energy")), path(v))


@query("score12_identity_timeline")
def _(v):
    return sp.identity_timeline(v.segments, lips(v), v.words)


@query("score13_probability_events", """
WITH f AS (SELECT job_id, t, slot_id % 3 AS slot_id, (CAST(l AS BIGINT) % 100) / 100.0 AS p FROM (SELECT *, face_key // 100000000 AS l FROM faces)),
g AS (SELECT s.job_id, s.seg_idx, f.slot_id, max(p) AS top, avg(p) AS a FROM segments s JOIN f ON f.job_id = s.job_id AND f.t BETWEEN s.start - 0.5 AND s."end" + 0.5 GROUP BY 1, 2, 3)
SELECT s.job_id, s.seg_idx, coalesce(g.slot_id, -1) AS slot_id, round(coalesce(a, 0), 6) AS confidence FROM segments s LEFT JOIN g ON g.job_id = s.job_id AND g.seg_idx = s.seg_idx AND top >= 0.97""")
def _(v):
    f = v.faces.withColumn("face_idx", F.col("face_key"))
    p = f.select("job_id", "t", "face_idx", ((F.floor(F.col("face_key") / 100000000)) % 100 / 100.0).alias("p"))
    d = sp.probability_events(v.segments, f.withColumn("slot_id", F.col("slot_id") % 3), p, floor=0.97)
    return d.select("job_id", "seg_idx", "slot_id", F.round("confidence", 6).alias("confidence"))


@query("score13_probability_timeline")
def _(v):
    f = v.faces.withColumn("face_idx", F.col("face_key"))
    p = f.select("job_id", "t", "face_idx", (F.floor(F.col("face_key") / 100000000) % 100 / 100.0).alias("p"))
    return sp.probability_timeline(v.segments, f.withColumn("slot_id", F.col("slot_id") % 3), p)
