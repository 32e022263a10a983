"""Queries: filters, projections and checks."""

from pyspark.sql import functions as F

from ..functions.ordered import scan, time_block
from ..operators import filters as op
from .registry import query

JOBS_TS = "strftime(make_timestamp(created_s * 1000000), '%Y-%m-%dT%H:%M:%S')"


def catalog(v):
    """Job rows with ISO creation times."""
    return v.jobs.withColumn("created_at", F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd'T'HH:mm:ss"))


@query("flt1_clip_filter", "SELECT job_id, clip_id, viral_score, duration FROM clips WHERE viral_score >= 40 AND duration >= 20 AND duration <= 60")
def _(v):
    return op.clip_filter(v.clips, 40, 20, 60).select("job_id", "clip_id", "viral_score", "duration")


@query("flt2_candidate_filter", """
SELECT job_id, clip_id, duration, viral_score, composite, focus_relevance FROM clips
WHERE duration BETWEEN 15 AND 70 AND coalesce(composite, viral_score) BETWEEN 30 AND 95 AND coalesce(focus_relevance, viral_score) >= 25""")
def _(v):
    d = op.candidate_filter(v.clips, 15, 70, 30, 95, focus_mode=True, min_relevance=25)
    return d.select("job_id", "clip_id", "duration", "viral_score", "composite", "focus_relevance")


@query("flt3_job_search", f"""
SELECT job_id, filename, status, {JOBS_TS} AS created_at FROM jobs
WHERE (lower(filename) LIKE '%7%' OR lower(progress_message) LIKE '%7%' OR lower(job_id) LIKE '%7%')
  AND status NOT IN ('complete', 'failed', 'queued', 'cancelled')""")
def _(v):
    return op.job_search(catalog(v), "7", "processing", "oldest").select("job_id", "filename", "status", "created_at")


@query("flt4_clip_search", """
SELECT job_id, clip_id, title, viral_score FROM clips
WHERE viral_score >= 20 AND platform IN ('reels', 'both') AND clip_type = 'story'
  AND (contains(lower(title), 'high') OR contains(clip_type, 'high') OR contains(CAST(clip_id AS VARCHAR), 'high') OR contains(coalesce(clip_focus, ''), 'high'))""")
def _(v):
    d = op.clip_search(v.clips, "High", ["title", "clip_type", "clip_id", "clip_focus"], min_score=20, platform="reels", clip_type="story")
    return d.select("job_id", "clip_id", "title", "viral_score")


@query("flt5_export_search", """
SELECT job_id, clip_id, coalesce(CASE WHEN clip_id % 4 = 0 THEN NULL ELSE duration END, "end" - start) AS seconds FROM clips
WHERE platform = 'shorts' AND contains(lower(title), 'urgent')""")
def _(v):
    d = v.clips.withColumns({
        "duration": F.when(F.col("clip_id") % 4 != 0, F.col("duration")), "filename": F.lit("out.mp4"),
        "source_filename": F.col("platform"), "exported_at": F.col("clip_id").cast("string"),
    })
    d = op.export_search(d, "shorts", "urgent", "duration_long")
    return d.select("job_id", "clip_id", F.coalesce("duration", F.col("end") - F.col("start")).alias("seconds"))


@query("flt6_log_filter", "SELECT event_id, event_type, props FROM events WHERE event_type = 'error' AND contains(lower(props), '7')")
def _(v):
    logs = v.events.select("event_id", F.col("event_type").alias("level"), F.col("props").alias("message"))
    return op.log_filter(logs, "error", "7").select("event_id", F.col("level").alias("event_type"), F.col("message").alias("props"))


@query("flt7_transcript_filter", """
SELECT job_id, seg_idx, speaker, start FROM segments WHERE start < 90 AND "end" > 20 AND (contains(lower(text), 'the') OR contains(lower(speaker), 'the'))""")
def _(v):
    return op.transcript_filter(v.segments, 20, 90, "THE").select("job_id", "seg_idx", "speaker", "start")


@query("flt8_media_filter", "SELECT page_id, url FROM pages WHERE url LIKE 'https%' AND contains(lower(url), 'example.net')")
def _(v):
    m = v.pages.select("page_id", F.col("url").alias("filename"), F.when(F.col("url").startswith("https"), "video").otherwise("audio").alias("type"))
    return op.media_filter(m, "video", "Example.NET").select("page_id", F.col("filename").alias("url"))


@query("flt9_placeholder_scenes", """
SELECT job_id, scene_id, (trim(description) = '' OR starts_with(lower(trim(description)), 'frame at ')
  OR contains(lower(description), 'model returned no response')) AS placeholder FROM scenes""")
def _(v):
    return v.scenes.select("job_id", "scene_id", op.is_placeholder_scene().alias("placeholder"))


@query("flt10_job_summary", f"""
SELECT job_id, filename, duration, status, 50.0 AS progress, progress_message, {JOBS_TS} AS created_at, clips_count,
       provider AS provider_used, file_size_mb, cost AS estimated_cost_usd, owner_user_id FROM jobs""", doubles=("progress",))
def _(v):
    return op.job_summary(catalog(v).withColumns({
        "progress": F.lit(50.0), "provider_used": F.col("provider"), "estimated_cost_usd": F.col("cost")}))


@query("flt11_active_jobs", f"""
SELECT job_id, status, CAST(1735689600 - created_s AS BIGINT) AS elapsed_seconds FROM jobs WHERE status NOT IN ('complete', 'failed', 'cancelled')""")
def _(v):
    return op.active_jobs(catalog(v), F.timestamp_seconds(F.lit(1735689600))).select("job_id", "status", "elapsed_seconds")


def _links(v):
    j = catalog(v)
    expires = F.when(F.col("job_no") % 10 == 0, "never").otherwise(
        F.date_format(F.timestamp_seconds(F.col("created_s") + F.col("job_no") % 30 * 86400), "yyyy-MM-dd'T'HH:mm:ss"))
    return j.select(F.concat(F.lit("tok"), F.col("job_no").cast("string")).alias("token"), "job_id", "created_at",
                    F.col("owner_user_id").alias("created_by"), expires.alias("expires_at"))


@query("flt12_live_links", """
SELECT 'tok' || job_no AS token, job_id FROM jobs WHERE job_no % 10 <> 0 AND created_s + job_no % 30 * 86400 > 1706000000 AND owner_user_id = 'u3'""")
def _(v):
    return op.live_links(_links(v), F.timestamp_seconds(F.lit(1706000000)), owner="u3").select("token", "job_id")


@query("flt13_live_sessions", """
SELECT 'tok' || job_no AS token FROM jobs WHERE job_no % 10 <> 0 AND created_s + job_no % 30 * 86400 > 1706000000""")
def _(v):
    return op.unexpired(_links(v), F.timestamp_seconds(F.lit(1706000000))).select("token")


@query("flt14_confidence_floor", """
WITH d AS (SELECT *, strategy IN ('stationary', 'tracking', 'panning') AND confidence < 0.5 AS low FROM crop_segments)
SELECT seg_key, CASE WHEN low THEN 'blur_fill' ELSE strategy END AS strategy, CASE WHEN low THEN 'blur_fill' ELSE layout END AS layout,
       CASE WHEN low THEN 50.0 ELSE subject_x END AS subject_x, CASE WHEN low THEN NULL ELSE active_slot END AS active_slot,
       CASE WHEN low THEN 'forced_downgrade_from_' || strategy || '_at_conf_' || printf('%.2f', confidence) END AS fallback_reason FROM d""")
def _(v):
    return op.confidence_floor(v.crop_segments).select("seg_key", "strategy", "layout", "subject_x", "active_slot", "fallback_reason")


@query("flt15_framing_label", """
SELECT face_key, CASE WHEN slot_id = 7 THEN 'SPLIT' WHEN slot_id >= 5 THEN '2SHOT' WHEN w / 20 < 0.25 THEN 'CU' WHEN w / 20 < 0.45 THEN 'MS' ELSE 'WS' END AS framing
FROM faces""")
def _(v):
    n = F.when(F.col("slot_id") >= 5, 2).otherwise(1)
    return v.faces.select("face_key", op.framing_label(F.col("w") / 20, n, F.col("slot_id") == 7).alias("framing"))


@query("flt16_position_fusion", """
WITH a AS (SELECT face_key, CASE WHEN slot_id = 1 THEN NULL ELSE x END AS fx, confidence AS fc, CASE WHEN slot_id = 2 THEN NULL ELSE y END AS mx, w / 18 AS mc FROM faces),
b AS (SELECT face_key, coalesce(fx, 0.0) AS fx, CASE WHEN fx IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, fc)) END AS fc,
             coalesce(mx, 50.0) AS mx, CASE WHEN mx IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, mc)) END AS mc FROM a),
c AS (SELECT *, (fc - 0.4) / 0.4 AS wf, mc * (1 - (fc - 0.4) / 0.4) AS wm FROM b)
SELECT face_key,
  round(CASE WHEN fc >= 0.8 OR (fc >= 0.4 AND wf + wm < 1e-6) THEN fx WHEN fc >= 0.4 THEN (fx * wf + mx * wm) / (wf + wm) WHEN mc >= 0.3 THEN mx ELSE 50.0 END, 6) AS x,
  CASE WHEN fc >= 0.8 OR (fc >= 0.4 AND wf + wm < 1e-6) THEN fc WHEN fc >= 0.4 THEN greatest(fc, mc) WHEN mc >= 0.3 THEN mc ELSE 0.0 END AS confidence,
  CASE WHEN fc >= 0.8 OR (fc >= 0.4 AND wf + wm < 1e-6) THEN 'face_high_conf' WHEN fc >= 0.4 THEN 'blended' WHEN mc >= 0.3 THEN 'vlm_only' ELSE 'fallback_center' END AS source FROM c""")
def _(v):
    f = op.fuse_positions(F.when(F.col("slot_id") != 1, F.col("x")), F.col("confidence"), F.when(F.col("slot_id") != 2, F.col("y")), F.col("w") / 18)
    return v.faces.select("face_key", f.alias("f")).select("face_key", F.round("f.x", 6).alias("x"), "f.confidence", "f.source")


@query("flt17_rename_speakers", """
SELECT job_id, seg_idx, CASE speaker WHEN 'user' THEN 'Ann' WHEN 'system' THEN 'Host' ELSE speaker END AS speaker FROM segments""")
def _(v):
    return op.rename_speakers(v.segments, {"user": "Ann", "system": "Host"}).select("job_id", "seg_idx", "speaker")


@query("flt18_delete_speaker", "SELECT job_id, seg_idx, speaker FROM segments WHERE speaker <> 'user'")
def _(v):
    return op.delete_speaker(v.segments, "user").select("job_id", "seg_idx", "speaker")


@query("flt19_bulk_relabel", """
SELECT job_id, seg_idx, CASE WHEN (job_id + seg_idx) % 3 = 0 THEN 'guest' ELSE speaker END AS speaker FROM segments""")
def _(v):
    edits = v.conversations.where((F.col("conv_id") + F.col("turn")) % 3 == 0).select(
        F.col("conv_id").alias("job_id"), (F.col("turn")).alias("seg_idx"), F.lit("guest").alias("new_speaker"), F.lit(1).alias("edit_no"))
    edits = edits.unionByName(edits.withColumn("seg_idx", F.col("seg_idx") + 1_000_000))
    return op.relabel_rows(v.segments, edits).select("job_id", "seg_idx", "speaker")


@query("flt21_recovery_verdict", """
WITH g AS (SELECT job_id, CAST(t AS BIGINT) AS sec, count(*) AS n, avg(confidence * 10) AS score, bool_or(x < 3) AS off_frame, bool_or(y < 3) AS awkward FROM faces GROUP BY ALL)
SELECT job_id, sec, CASE WHEN score < 5 THEN 'safety_center' WHEN score < 7 AND off_frame THEN 'loose_dead_zone' WHEN score < 7 AND awkward THEN 'padding'
  WHEN score < 7 THEN 'loose_dead_zone' END AS verdict FROM g""")
def _(v):
    g = v.faces.groupBy("job_id", F.col("t").cast("long").alias("sec")).agg(
        F.count("*").alias("n"), F.avg(F.col("confidence") * 10).alias("score"), F.bool_or(F.col("x") < 3).alias("off"), F.bool_or(F.col("y") < 3).alias("awk"))
    return g.select("job_id", "sec", op.recovery_verdict(F.col("n"), F.col("score"), F.col("off"), F.col("awk")).alias("verdict"))


def _rules(table, ids, rules, where="true"):
    """UNION ALL of one SELECT per rule, as check SQL."""
    return "\nUNION ALL\n".join(
        f"SELECT {ids}, '{k}' AS type, '{s}' AS severity, '{m}' AS message FROM {table} WHERE ({where}) AND ({c})" for c, k, s, m in rules)


ITEM_RULES = [
    ("start < 0", "invalid_timing", "error", "negative start"), ('"end" <= start', "invalid_timing", "error", "end not after start"),
    ('"end" - start > 86400', "invalid_timing", "warning", "longer than 24 hours"),
    ("opacity < 0 OR opacity > 1", "invalid_property", "warning", "opacity out of range"),
    ("volume < 0 OR volume > 5", "invalid_property", "warning", "volume out of range"),
    ("speed <= 0 OR speed > 100", "invalid_property", "warning", "speed out of range"),
]
CAPTION_RULES = [
    ("caption IS NULL", "caption", "error", "missing text"), ('start >= "end"', "caption", "error", "start not before end"),
    ("pos_x < 0 OR pos_x > 100", "caption", "warning", "x out of range"), ("pos_y < 0 OR pos_y > 100", "caption", "warning", "y out of range"),
    ('"end" - start < 0.1', "caption", "warning", "very short"), ('"end" - start > 30', "caption", "warning", "very long"),
]


@query("flt22_item_checks", _rules("items", "project_id, item_id", ITEM_RULES))
def _(v):
    return op.item_checks(v.items)


TRACK_TYPE = "CASE WHEN l_linenumber <= 2 THEN 'video' WHEN l_linenumber <= 4 THEN 'overlay' WHEN l_linenumber <= 6 THEN 'subtitle' ELSE 'audio' END"


def tracks(v):
    """One track per project and line number; stacking order from the part sizes."""
    return v.lineitem.groupBy(F.col("l_suppkey").alias("project_id"), F.col("l_linenumber").cast("long").alias("track_no")).agg(
        F.min(F.expr(TRACK_TYPE)).alias("type"), (F.min("l_partkey") % 9).alias("order"))


@query("flt22_layer_order", f"""
WITH tr AS (SELECT l_suppkey AS project_id, l_linenumber, {TRACK_TYPE} AS type, min(l_partkey) % 9 AS ord FROM lineitem GROUP BY ALL),
g AS (SELECT project_id, max(CASE WHEN type = 'video' THEN ord END) AS vt, min(CASE WHEN type = 'overlay' THEN ord END) AS ol,
  max(CASE WHEN type = 'overlay' THEN ord END) AS ot, min(CASE WHEN type = 'subtitle' THEN ord END) AS sl FROM tr GROUP BY 1)
SELECT project_id, 'layer_order' AS type, 'warning' AS severity, 'video not below overlay' AS message FROM g WHERE vt >= ol
UNION ALL SELECT project_id, 'layer_order', 'warning', 'overlay not below subtitle' FROM g WHERE ot >= sl""")
def _(v):
    return op.layer_order_checks(tracks(v))


@query("flt23_caption_checks", _rules("items", "project_id, item_id", CAPTION_RULES, "type = 'subtitle'"))
def _(v):
    return op.caption_checks(v.items)


@query("flt23_word_pace", r"""
WITH d AS (SELECT project_id, item_id, "end" - start AS dur, len(list_filter(regexp_split_to_array(coalesce(caption, ''), '\s+'), lambda x: x <> '')) AS n
  FROM items WHERE type = 'subtitle'), e AS (SELECT *, dur / n * 30 AS per_word FROM d WHERE n > 1)
SELECT project_id, item_id, 'word_pace' AS type, 'error' AS severity, 'words will skip' AS message FROM e WHERE per_word < 2
UNION ALL SELECT project_id, item_id, 'word_pace', 'warning', 'fast words' FROM e WHERE per_word >= 2 AND per_word < 3
UNION ALL SELECT project_id, item_id, 'word_pace', 'warning', 'too short for words' FROM e WHERE dur < 0.3 AND n > 2""")
def _(v):
    return op.word_pace_checks(v.items)


@query("flt24_layout_choice", """
SELECT seg_key, CASE WHEN active_slot = 1 THEN 'blurfill' WHEN active_slot = 2 OR subject_x > 30 THEN 'wide_zoom'
  WHEN layout = 'single' AND "end" - start >= 4 THEN 'blurfill' WHEN layout = 'single' THEN 'composite'
  WHEN layout = 'split' AND subject_x < 20 THEN 'composite' ELSE 'fullscreen' END AS gaming_layout FROM crop_segments""")
def _(v):
    genre = F.when(F.col("layout") == "single", "moba").when(F.col("layout") == "split", "racing").otherwise("fps")
    slot = F.coalesce("active_slot", F.lit(0))
    pick = op.layout_choice(slot == 1, slot == 2, F.col("subject_x"), genre, F.col("end") - F.col("start"))
    return v.crop_segments.select("seg_key", pick.alias("gaming_layout"))


@query("flt25_title_hint", r"""
WITH n AS (SELECT job_id, lower(trim(regexp_replace(regexp_replace(filename, '[_.\-:]', ' ', 'g'), '\s+', ' ', 'g'))) AS f FROM jobs)
SELECT job_id, CASE WHEN regexp_matches(f, '\bapex legends?\b') OR regexp_matches(f, '\bapex\b') THEN 'apex_legends' WHEN regexp_matches(f, '\bminecraft\b') THEN 'minecraft'
  WHEN regexp_matches(f, '\bdota\s?2?\b') THEN 'dota_2' WHEN regexp_matches(f, '\brocket league\b') THEN 'rocket_league' END AS slug,
  CASE WHEN regexp_matches(f, '\bapex\b') THEN 'fps' WHEN regexp_matches(f, '\bminecraft\b') THEN 'sandbox'
  WHEN regexp_matches(f, '\bdota\s?2?\b') THEN 'moba' WHEN regexp_matches(f, '\brocket league\b') THEN 'racing' END AS genre FROM n""")
def _(v):
    return v.jobs.select("job_id", op.title_hint(F.col("filename")).alias("h")).select("job_id", "h.slug", "h.genre")


PROFILE = """SELECT job_id, job_no, CASE job_no % 7 WHEN 0 THEN 'podcast' WHEN 1 THEN 'anime' WHEN 2 THEN 'gaming' WHEN 3 THEN 'sports' WHEN 4 THEN 'narrative' WHEN 5 THEN 'music_video' ELSE 'vlog' END AS content_type,
 CASE job_no % 11 WHEN 0 THEN 'moba' WHEN 1 THEN 'fps' WHEN 2 THEN 'stream' END AS gameplay_subtype, CASE job_no % 3 WHEN 0 THEN 'basketball' WHEN 1 THEN 'racing' END AS sports_subtype,
 job_no % 13 = 0 AS is_panel, job_no % 8 = 0 AS is_dialogue, job_no % 5 = 0 AS is_animated, CASE job_no % 4 WHEN 0 THEN 'action' WHEN 1 THEN 'dialogue' END AS anime_subtype,
 job_no % 6 = 0 AS has_facecam, (job_no % 10) / 10.0 AS corner_share FROM {jobs}"""


@query("flt26_clip_route", f"""
WITH p AS ({PROFILE.format(jobs="jobs")}),
a AS (SELECT *, CASE gameplay_subtype WHEN 'moba' THEN 'gameplay_moba' WHEN 'fps' THEN 'gameplay' WHEN 'stream' THEN 'stream' ELSE
  CASE content_type WHEN 'podcast' THEN 'talking_head' WHEN 'vlog' THEN 'talking_head' WHEN 'anime' THEN 'animation' WHEN 'gaming' THEN 'gameplay' WHEN 'sports' THEN 'sports'
  WHEN 'music_video' THEN 'music_video' ELSE 'generic' END END AS b0 FROM p),
b AS (SELECT *, CASE WHEN b0 = 'sports' AND sports_subtype = 'basketball' THEN 'sports_basketball' WHEN b0 = 'sports' AND sports_subtype = 'racing' THEN 'sports_racing' ELSE b0 END AS b1 FROM a),
c AS (SELECT *, CASE WHEN is_panel THEN 'multi_speaker_panel' WHEN is_dialogue THEN 'cinematic_dialogue' ELSE b1 END AS b2 FROM b),
d AS (SELECT *, CASE WHEN is_animated AND anime_subtype = 'action' THEN 'animation' WHEN is_animated AND anime_subtype = 'dialogue' THEN 'animation_dialogue'
  WHEN is_animated AND b2 IN ('generic', 'cinematic_dialogue', 'talking_head') THEN 'animation_dialogue' ELSE b2 END AS b3 FROM c)
SELECT job_id, CASE WHEN has_facecam AND (b3 = 'gameplay' OR corner_share > 0.7) THEN 'stream' ELSE b3 END AS clip_type FROM d""")
def _(v):
    p = v.spark.sql(PROFILE.format(jobs="{jobs}"), jobs=v.jobs)
    return op.clip_route(p).select("job_id", "clip_type")


@query("flt27_crop_checks", """
WITH a AS (SELECT face_key, 3840.0 * greatest(10, least(90, floor(x + 0.5))) / 100 AS px, 405.0 AS cw, 3435.0 AS mo FROM faces),
b AS (SELECT *, floor(greatest(0, least(mo, px - cw / 2)) + 0.5) AS off FROM a)
SELECT face_key, 'tracking' AS type, 'error' AS severity, 'subject outside crop' AS message FROM b WHERE px - off < 0 OR px - off > cw
UNION ALL SELECT face_key, 'tracking', 'warning', 'off centre' FROM b WHERE off > 0 AND off < mo AND abs(px - off - cw / 2) / cw * 100 > 15
UNION ALL SELECT face_key, 'tracking', 'warning', 'extreme aspect' FROM b""")
def _(v):
    return op.crop_checks(v.faces.withColumnRenamed("x", "subject_x"), ["face_key"], 3840, 720, "9:16")


@query("flt27_tracking_checks", """
WITH d AS (SELECT job_id, scene_id, t, subject_x AS x, lag(t) OVER w AS pt, lag(subject_x) OVER w AS px FROM scenes WINDOW w AS (PARTITION BY job_id ORDER BY t, scene_id))
SELECT scene_id, 'tracking' AS type, 'warning' AS severity, 'near edge' AS message FROM d WHERE x < 5 OR x > 95
UNION ALL SELECT scene_id, 'tracking', 'warning', 'rapid jump' FROM d WHERE t - pt > 0 AND t - pt < 0.5 AND abs(x - px) > 30""")
def _(v):
    d = scan(v.scenes, ["job_id"], ["t", "scene_id"], time_block("t"), prev={"prev_t": F.col("t"), "prev_x": F.col("subject_x")})
    return op.tracking_checks(d, ["scene_id"])


@query("flt27_centering", """
SELECT face_key, round((x / 100 - ((3.16049 * x - 50) / 2.16049) / 100 * (1 - 1 / 3.16049)) * 3.16049, 5) AS share FROM faces""")
def _(v):
    share = op.face_share_in_crop(F.col("x"), 3.16049, 1.0)
    return v.faces.select("face_key", F.round(share, 5).alias("share"))


@query("flt28_caption_consistency", """
WITH p AS (SELECT s_suppkey AS project_id, s_suppkey % 2 = 0 AS on_, s_suppkey % 3 <> 0 AS shown, s_suppkey % 4 AS son, s_suppkey % 5 AS soff FROM supplier),
c AS (SELECT project_id, count(*) AS n, count(*) FILTER (trim(coalesce(caption, '')) = '') AS e FROM items WHERE type = 'subtitle' GROUP BY 1),
d AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(e, 0) AS e FROM p LEFT JOIN c USING (project_id))
SELECT project_id, 'subtitle_missing_items' AS type, 'warning' AS severity, 'no caption items' AS message FROM d WHERE on_ AND n = 0
UNION ALL SELECT project_id, 'subtitle_track_hidden', 'error', 'caption track hidden' FROM d WHERE on_ AND NOT shown
UNION ALL SELECT project_id, 'subtitle_settings_off', 'warning', 'captions disabled' FROM d WHERE shown AND n > 0 AND NOT on_
UNION ALL SELECT project_id, 'subtitle_empty_text', 'warning', e || ' empty captions' FROM d WHERE e > 0
UNION ALL SELECT project_id, 'subtitle_mixed_segments', 'info', 'mixed visibility' FROM d WHERE NOT on_ AND son > 0 AND soff > 0""")
def _(v):
    return op.caption_consistency(_projects(v), v.items)


def _projects(v):
    k = F.col("s_suppkey")
    return v.supplier.select(k.alias("project_id"), (k % 2 == 0).alias("settings_on"), (k % 3 != 0).alias("track_visible"),
                             (k % 4).alias("segments_on"), (k % 5).alias("segments_off"))


@query("flt28_check_rollup", f"""
WITH f AS ({_rules("items", "project_id, item_id", ITEM_RULES)})
SELECT project_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'error') = 0 AS valid, count(*) FILTER (severity = 'error') || ' errors, ' || count(*) FILTER (severity = 'warning') || ' warnings' AS summary
FROM f GROUP BY 1""")
def _(v):
    return op.check_rollup(op.item_checks(v.items))
