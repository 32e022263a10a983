"""Queries: sources, exports and change sets."""

from pyspark.sql import functions as F

from ..sources import readers, sinks
from .filters import JOBS_TS, catalog
from .registry import query


@query("src1_job_catalog", f"""
SELECT job_id, owner_user_id, {JOBS_TS} AS created_at FROM jobs
WHERE (owner_user_id <> '' AND owner_user_id = 'u4') OR lower(owner_username) = 'user9' OR owner_user_id = ''""")
def _(v):
    return readers.owned_jobs(catalog(v), "u4", " USER9", include_unowned=True).select("job_id", "owner_user_id", "created_at")


def _versions(v):
    d = v.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return d.where("version % 2 = 0"), d.where("version % 2 = 1")


@query("src2_latest_versions", """
SELECT o_custkey AS job_id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""")
def _(v):
    return sinks.latest_versions(*_versions(v), "job_id", "version")


@query("src3_apply_updates", """
SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 = 0 THEN 'complete' ELSE c_mktsegment END AS status,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS progress, CASE WHEN c_custkey % 3 = 0 THEN 'now' ELSE 'old' END AS updated_at FROM customer""")
def _(v):
    base = v.customer.select(F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("progress"), F.lit("old").alias("updated_at"))
    upd = v.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("job_id"), F.lit("complete").alias("status"),
                                                      F.when(F.col("c_custkey") % 2 == 0, 0.0).alias("progress"), F.lit(1).alias("unknown_column"))
    return sinks.apply_updates(base, upd, "job_id", F.lit("now"))


@query("src4_delete_keys", "SELECT job_id, status FROM jobs WHERE job_no % 4 <> 1 OR job_id = 'job-5'")
def _(v):
    doomed = v.jobs.where("job_no % 4 = 1").select("job_id")
    return sinks.delete_keys(v.jobs.select("job_id", "status"), doomed, "job_id", protected=("_library", "job-5"))


@query("src5_lexicon_rows", """
SELECT lower(p_name) AS phrase, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 0.25 ELSE p_size / 100.0 END, 0.5) AS hotness, p_type AS genre
FROM part WHERE p_partkey % 5 <> 0""")
def _(v):
    hot = F.when(F.col("p_partkey") % 5 == 0, "hot").when(F.col("p_partkey") % 3 == 1, "0.25").when(F.col("p_partkey") % 3 == 2, (F.col("p_size") / 100).cast("string"))
    raw = v.part.select(F.array(F.struct(F.lower("p_name").alias("phrase"), F.array("p_type").alias("genres"),
                                         F.lit(None).cast("array<string>").alias("platforms"), hot.alias("hotness"))).alias("entries"))
    return readers.lexicon_rows(raw).select("phrase", "hotness", F.col("genres")[0].alias("genre"))


@query("src9_media_listing", r"""
WITH f AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS job_id, CASE page_id % 5 WHEN 0 THEN '_meta' || page_id || '.json' WHEN 1 THEN 'v' || page_id || '.MP4'
  WHEN 2 THEN 'a' || page_id || '.ogg' WHEN 3 THEN 'i' || page_id || '.jpeg' ELSE 'doc' || page_id || '.pdf' END AS name, length(html) AS size FROM pages)
SELECT job_id, regexp_replace(name, '\.[^.]*$', '') AS id, CASE WHEN page_id % 2 = 0 THEN 'original ' || page_id ELSE name END AS filename,
  CASE page_id % 5 WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'image' END AS type, CAST(size AS BIGINT) AS size, '/api/files/' || job_id || '/media/' || name AS url
FROM f WHERE page_id % 5 IN (1, 2, 3)""")
def _(v):
    k = F.col("page_id")
    name = F.expr("""CASE page_id % 5 WHEN 0 THEN concat('_meta', page_id, '.json') WHEN 1 THEN concat('v', page_id, '.MP4')
        WHEN 2 THEN concat('a', page_id, '.ogg') WHEN 3 THEN concat('i', page_id, '.jpeg') ELSE concat('doc', page_id, '.pdf') END""")
    f = v.pages.select(k, F.regexp_extract("url", "^https?://([^/]+)", 1).alias("job_id"), name.alias("name"), F.length("html").cast("long").alias("size"))
    names = f.where(k % 2 == 0).select("job_id", F.regexp_replace("name", r"\.[^.]*$", "").alias("media_id"), F.concat(F.lit("original "), k.cast("string")).alias("original_filename"))
    return readers.media_listing(f, names)


SRT = """printf('%02d:%02d:%02d,%03d', CAST(floor({c} / 3600) AS BIGINT), CAST(floor({c} % 3600 / 60) AS BIGINT), CAST(floor({c} % 60) AS BIGINT), CAST(floor(({c} % 1) * 1000) AS BIGINT))"""


@query("src10_srt_rows", f"""
SELECT job_id, seg_idx + 1 AS number, {SRT.format(c="start")} || ' --> ' || {SRT.format(c='"end"')} AS span, '[' || speaker || '] ' || trim(text) AS text
FROM (SELECT job_id, seg_idx, start, "end", speaker, CASE WHEN seg_idx = 2 THEN '  ' ELSE text END AS text FROM segments) WHERE trim(text) <> ''""")
def _(v):
    return sinks.srt_rows(v.segments.withColumn("text", F.when(F.col("seg_idx") == 2, "  ").otherwise(F.col("text"))))


VTT = """printf('%02d:%02d:%06.3f', CAST(floor({c} / 3600) AS BIGINT), CAST(floor({c} % 3600 / 60) AS BIGINT), {c} % 60)"""


@query("src11_transcript_lines", f"""
SELECT job_id, seg_idx, {VTT.format(c="start")} || ' --> ' || {VTT.format(c='"end"')} || chr(10) || speaker || ': ' || text || chr(10) AS line FROM segments""")
def _(v):
    return sinks.transcript_lines(v.segments, "vtt")


@query("src12_usage_rows", """
SELECT job_id, filename, CASE WHEN provider IS NULL THEN '{}' ELSE '{"text":"' || provider || '"}' END AS provider, status, coalesce(cost, 0.0) AS cost_usd FROM jobs""")
def _(v):
    used = F.when(F.col("provider").isNotNull(), F.create_map(F.lit("text"), F.col("provider")))
    return sinks.usage_rows(v.jobs.withColumns({"provider_used": used, "estimated_cost_usd": F.col("cost")}))


@query("src14_plan_events", """
WITH d AS (SELECT job_id, seg_idx, CAST(round_even(start * 5, 0) AS BIGINT) AS f, CAST(round_even("end" * 5, 0) AS BIGINT) AS l, confidence FROM segments),
e AS (SELECT *, unnest(range(f, l)) AS frame FROM d WHERE l > f)
SELECT job_id, seg_idx, frame, frame / 5.0 AS t, frame = f AS scene_change, confidence / 2 + 0.28125 AS crop_cx, 0.5 AS crop_cy, 0.5625 AS crop_w, 1.0 AS crop_h FROM e""", doubles=("crop_cy", "crop_w", "crop_h"))
def _(v):
    none = F.lit(None).cast("double")
    ops = v.segments.withColumns({"x": F.col("confidence") / 2, "y": none, "w": none, "h": none})
    return sinks.plan_events(ops, 5.0, ["job_id", "seg_idx"])


@query("src15_segment_events", """
WITH d AS (SELECT seg_key, CAST(round_even(start * 2, 0) AS BIGINT) AS f, CAST(round_even("end" * 2, 0) AS BIGINT) AS l, subject_x FROM crop_segments),
e AS (SELECT *, unnest(range(f, l)) AS frame FROM d WHERE l > f)
SELECT seg_key, frame, frame / 2.0 AS t, frame = f AS scene_change, CASE WHEN subject_x = 0 THEN 0.5 ELSE subject_x / 1920 END AS crop_cx, 0.5 AS crop_cy,
  0.31640625 AS crop_w, 1.0 AS crop_h FROM e""", doubles=("crop_cy", "crop_w", "crop_h"))
def _(v):
    return sinks.segment_events(v.crop_segments.withColumn("subject_y", F.lit(None).cast("double")), 2.0, ["seg_key"], 1920, 1080)


@query("src16_report_rows", """
WITH c AS (SELECT p_partkey AS slug, CASE p_partkey % 4 WHEN 0 THEN 'music_video' WHEN 1 THEN 'sports_racing' WHEN 2 THEN 'animation' ELSE 'generic' END AS tt FROM part),
t AS (SELECT * FROM (VALUES (0, 'baseline'), (1, 'candidate'), (2, 'ground_truth')) AS x(tool_no, tool)),
m AS (SELECT l_partkey AS slug, CASE l_linenumber % 3 WHEN 0 THEN 'baseline' ELSE 'candidate' END AS tool, round(min(l_quantity) / 4, 2) AS q FROM lineitem GROUP BY 1, 2)
SELECT CASE p WHEN 3 THEN 'music' WHEN 2 THEN 'sports' ELSE 'anime' END AS "group", CAST(p AS INTEGER) AS group_no, slug, tool_no, tool,
  coalesce(printf('%.2f', q), '-') AS median, CASE WHEN q IS NULL THEN 'SKIPPED' WHEN q > 1 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM (SELECT slug, CASE tt WHEN 'music_video' THEN 3 WHEN 'sports_racing' THEN 2 ELSE 1 END AS p FROM c WHERE tt <> 'generic') CROSS JOIN t LEFT JOIN m USING (slug, tool)""")
def _(v):
    kinds = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'music_video' WHEN 1 THEN 'sports_racing' WHEN 2 THEN 'animation' ELSE 'generic' END")
    clips = v.part.select(F.col("p_partkey").alias("slug"), kinds.alias("target_type"))
    tool = F.when(F.col("l_linenumber") % 3 == 0, "baseline").otherwise("candidate")
    m = v.lineitem.groupBy(F.col("l_partkey").alias("slug"), tool.alias("tool")).agg(F.round(F.min("l_quantity") / 4, 2).alias("median_hold"))
    m = m.withColumn("verdict", F.when(F.col("median_hold") > 1, "PASS").otherwise("FAIL"))
    return sinks.report_rows(clips, m)


@query("flt20_edit_segments", """
WITH u AS (SELECT job_id, seg_idx, start, "end", CASE WHEN seg_idx % 3 = 0 THEN 'edited' ELSE text END AS text, speaker FROM segments WHERE seg_idx % 5 <> 1),
i AS (SELECT conv_id AS job_id, 10 + conv_id % 40 AS start, 12 + conv_id % 40 AS "end", 'inserted' AS text, 'guest' AS speaker FROM conversations WHERE turn = 0),
b AS (SELECT job_id, start, "end", text, speaker, seg_idx AS o FROM u UNION ALL SELECT job_id, start, "end", text, speaker, 1000000 FROM i)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start, o) - 1 AS seg_idx, CAST(start AS DOUBLE) AS start, CAST("end" AS DOUBLE) AS "end", text, speaker FROM b""")
def _(v):
    s = v.segments
    none = F.lit(None)
    upd = s.where("seg_idx % 3 = 0").select("job_id", "seg_idx", none.cast("double").alias("start"), none.cast("double").alias("end"), F.lit("edited").alias("text"), none.cast("string").alias("speaker"))
    ins = v.conversations.where("turn = 0").select(F.col("conv_id").alias("job_id"), F.lit(0).alias("insert_no"), (10.0 + F.col("conv_id") % 40).alias("start"),
                                                  (12.0 + F.col("conv_id") % 40).alias("end"), F.lit("inserted").alias("text"), F.lit("guest").alias("speaker"))
    return sinks.edit_segments(s, upd, s.where("seg_idx % 5 = 1"), ins)
