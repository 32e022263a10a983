"""Queries: clip suppression, selection and scoring, scalar text functions."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import clips as op
from .registry import query

LEXICON = [("the", [], 0.8), ("of on", [], 0.4), ("der", ["vlog"], 0.6), ("er st", ["podcast"], 0.9), ("high low", [], 0.7)]


def jobs(v):
    """Transcript length per job."""
    return v.segments.groupBy("job_id").agg(F.max("end").alias("duration"))


JOBS = 'jb AS (SELECT job_id, max("end") AS duration FROM segments GROUP BY 1)'


def ranked(v):
    return v.clips.withColumn("position", F.col("clip_id"))


@query("set2_append_clips", """
WITH e AS (SELECT job_id, clip_id FROM clips WHERE clip_id % 3 = 0), n AS (SELECT job_id, clip_id AS pos FROM clips WHERE clip_id % 3 = 1), t AS (SELECT job_id, max(clip_id) AS top FROM e GROUP BY 1)
SELECT job_id, clip_id FROM e UNION ALL SELECT n.job_id, coalesce(top, 0) + row_number() OVER (PARTITION BY n.job_id ORDER BY pos) FROM n LEFT JOIN t USING (job_id)""")
def _(v):
    e = v.clips.where("clip_id % 3 = 0").select("job_id", "clip_id")
    return op.append_or_replace(e, v.clips.where("clip_id % 3 = 1").select("job_id", F.col("clip_id").alias("position")))


GREEDY = """c AS (SELECT job_id, {focus} AS f, clip_id, start, "end" AS e, {dur} AS d, row_number() OVER (PARTITION BY job_id, {focus} ORDER BY {rank} DESC, clip_id) AS rn FROM {src}),
g AS (SELECT job_id, f, rn, [struct_pack(id := clip_id, s := start, e := e, d := d)] AS kept FROM c WHERE rn = 1
 UNION ALL SELECT c.job_id, c.f, c.rn, CASE WHEN len(list_filter(g.kept, lambda k: {clash})) = 0 THEN list_append(g.kept, struct_pack(id := c.clip_id, s := c.start, e := c.e, d := c.d)) ELSE g.kept END
 FROM g JOIN c ON c.job_id = g.job_id AND c.f = g.f AND c.rn = g.rn + 1),
kp AS (SELECT unnest(list_transform(kept, lambda k: k.id)) AS clip_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, f ORDER BY rn DESC) AS z FROM g) WHERE z = 1)"""
IOU = "least(c.e, k.e) > greatest(c.start, k.s) AND (least(c.e, k.e) - greatest(c.start, k.s)) / (greatest(c.e, k.e) - least(c.start, k.s)) >= 0.6"
SHORT = """((least(c.d, k.d) > 0 AND greatest(0, least(c.e, k.e) - greatest(c.start, k.s)) / least(c.d, k.d) > {lim}) OR (least(abs(c.start - k.e), abs(k.s - c.e)) < 5 AND c.d + k.d > 0 AND (greatest(c.e, k.e) - least(c.start, k.s)) / (c.d + k.d) < 1.15))"""


@query("set3_drop_time_duplicates", f"""WITH RECURSIVE {GREEDY.format(focus="coalesce(clip_focus, '')", dur="duration", rank="coalesce(focus_relevance, viral_score)", src="clips", clash=IOU)} SELECT clip_id FROM kp""")
def _(v):
    return op.drop_time_duplicates(ranked(v)).select("clip_id")


@query("set4_drop_overlapping", f"""WITH RECURSIVE s AS (SELECT job_id, clip_id, viral_score, CASE WHEN clip_id % 7 = 0 THEN "end" ELSE start END AS a, CASE WHEN clip_id % 7 = 0 THEN start ELSE "end" END AS b, duration FROM clips),
t AS (SELECT job_id, clip_id, viral_score, least(a, b) AS start, greatest(a, b) AS "end", duration FROM s), {GREEDY.format(focus="0", dur="duration", rank="viral_score", src="t", clash=SHORT.format(lim=0.5))} SELECT clip_id FROM kp""")
def _(v):
    flip = F.col("clip_id") % 7 == 0
    d = ranked(v).withColumns({"_a": F.when(flip, F.col("end")).otherwise(F.col("start")), "_b": F.when(flip, F.col("start")).otherwise(F.col("end"))})
    return op.drop_overlapping(d.withColumns({"start": F.col("_a"), "end": F.col("_b")}).drop("_a", "_b")).select("clip_id")


@query("set5_limit_themes", r"""
WITH RECURSIVE c AS (SELECT job_id, clip_id, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(title), '\s+'), lambda w: regexp_replace(w, '[^\pL\pN]', '', 'g')), lambda w: length(w) > 2))) AS w,
  row_number() OVER (PARTITION BY job_id ORDER BY viral_score DESC, clip_id) AS rn FROM clips),
g AS (SELECT job_id, rn, [struct_pack(id := clip_id, w := w)] AS kept FROM c WHERE rn = 1
UNION ALL SELECT c.job_id, c.rn, CASE WHEN len(list_filter(g.kept, lambda k: len(list_intersect(c.w, k.w)) / len(list_distinct(list_concat(c.w, k.w))) > 0.75)) < 2 THEN list_append(g.kept, struct_pack(id := c.clip_id, w := c.w)) ELSE g.kept END
 FROM g JOIN c ON c.job_id = g.job_id AND c.rn = g.rn + 1)
SELECT unnest(list_transform(kept, lambda k: k.id)) AS clip_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) AS z FROM g) WHERE z = 1""")
def _(v):
    return op.limit_themes(ranked(v), 2).select("clip_id")


@query("set10_coverage_gaps", """
WITH j AS (SELECT job_no AS job_id, CASE WHEN job_no % 3 = 0 THEN 900.0 ELSE 400.0 END AS dur FROM jobs), n AS (SELECT job_id, dur, unnest(range(CAST(floor(dur + 1) AS BIGINT))) AS sec FROM j),
c AS (SELECT * FROM clips WHERE clip_id % 3 = 0), cov AS (SELECT DISTINCT job_id, sec FROM (SELECT c.job_id, unnest(range(CAST(floor(start) AS BIGINT), CAST(floor("end") AS BIGINT) + 1)) AS sec FROM c)),
f AS (SELECT n.job_id, n.sec, n.sec - row_number() OVER (PARTITION BY n.job_id ORDER BY n.sec) AS grp FROM n LEFT JOIN cov ON cov.job_id = n.job_id AND cov.sec = n.sec WHERE cov.sec IS NULL AND n.job_id IN (SELECT job_id FROM c)),
g AS (SELECT job_id, CAST(min(sec) AS DOUBLE) AS s, CAST(max(sec) + 1 AS DOUBLE) AS e FROM f GROUP BY job_id, grp HAVING count(*) >= 60),
z AS (SELECT job_id, start AS zs, "end" AS ze FROM clips WHERE clip_id % 3 = 1 AND viral_score > 20),
h AS (SELECT * FROM g WHERE job_id NOT IN (SELECT job_id FROM z) OR EXISTS (SELECT 1 FROM z WHERE z.job_id = g.job_id AND z.zs < g.e AND z.ze > g.s)),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s) AS n FROM h)
SELECT job_id, s AS start, e AS "end" FROM r WHERE n <= 4 UNION ALL SELECT job_id, 0.0, dur FROM j WHERE job_id NOT IN (SELECT job_id FROM c)""")
def _(v):
    j = v.jobs.select(F.col("job_no").alias("job_id"), F.when(F.col("job_no") % 3 == 0, 900.0).otherwise(400.0).alias("duration"))
    z = v.clips.where("clip_id % 3 = 1").select("job_id", "start", "end", F.col("viral_score").alias("composite"))
    return op.coverage_gaps(j, v.clips.where("clip_id % 3 = 0"), z)


@query("topk2_best_zones", """
WITH w AS (SELECT DISTINCT job_id, w * 120.0 AS s, w * 120.0 + 240 AS e, w AS win FROM clips, range(2) AS r(w)),
r AS (SELECT w.job_id, w.win, c.start AS z_start, c."end" AS z_end, c.viral_score AS composite, row_number() OVER (PARTITION BY w.job_id, w.win ORDER BY viral_score DESC, c.start) AS rank FROM w JOIN clips c ON c.job_id = w.job_id AND c.start >= w.s AND c."end" <= w.e)
SELECT job_id, win, composite, rank FROM r WHERE rank <= 3""")
def _(v):
    w = v.clips.select("job_id").distinct().select("job_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("win")).select("job_id", F.col("win").cast("long").alias("win"), (F.col("win") * 120.0).alias("start"), (F.col("win") * 120.0 + 240).alias("end"))
    return op.best_zones(w, v.clips.withColumn("composite", F.col("viral_score")), "win", 3).select("job_id", "win", "composite", "rank")


@query("topk3_stratified_top", """
WITH j AS (SELECT job_no AS job_id, 250.0 + job_no % 5 * 300 AS dur FROM jobs), k AS (SELECT job_id, dur, least(5, CASE WHEN dur < 900 THEN 4 WHEN dur < 3600 THEN 5 ELSE 6 END) AS k FROM j),
c AS (SELECT c.*, dur, k, count(*) OVER (PARTITION BY c.job_id) AS size, least(k - 1, greatest(0, CAST(floor(start / (dur / k)) AS BIGINT))) AS b FROM clips c JOIN k USING (job_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, b ORDER BY viral_score DESC, clip_id) - 1 AS r FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN size > 5 AND r < greatest(2, 5 // greatest(1, k - 1)) THEN r ELSE 99 END, CASE WHEN size > 5 AND r < greatest(2, 5 // greatest(1, k - 1)) THEN b ELSE 0 END, viral_score DESC, clip_id) AS n FROM r)
SELECT job_id, clip_id, row_number() OVER (PARTITION BY job_id ORDER BY viral_score DESC, clip_id) AS rank FROM o WHERE n <= 5""")
def _(v):
    j = v.jobs.select(F.col("job_no").alias("job_id"), (250.0 + F.col("job_no") % 5 * 300).alias("duration"))
    return op.stratified_top(ranked(v), j, 5).select("job_id", "clip_id", "rank")


SIGNAL = """sg AS (SELECT job_id, seg_idx, speaker, start, "end" AS e, CASE WHEN contains(text, '!') THEN 8 ELSE 0 END + CASE WHEN contains(text, '?') THEN 6 ELSE 0 END
 + CASE WHEN len(list_filter(toks, lambda w: w = upper(w) AND length(w) > 2 AND regexp_full_match(w, '\\pL+'))) > 0 THEN 10 ELSE 0 END
 + CASE WHEN {excited} THEN 12 ELSE 0 END + CASE WHEN n_words > 3 AND "end" - start < 3 THEN 5 ELSE 0 END AS p FROM segments)""".format(excited=" OR ".join(f"contains(lower(text), '{w}')" for w in op.EXCITED))
ZONES = f"""{JOBS}, {SIGNAL}, gr AS (SELECT job_id, win, win * 20.0 AS ws, least(win * 20.0 + 30, duration) AS we FROM (SELECT *, unnest(range(CAST(ceil(duration / 20) AS BIGINT))) AS win FROM jb)),
hw AS (SELECT g.job_id, g.win, s.*, g.we - g.ws AS len, lag(speaker) OVER (PARTITION BY g.job_id, g.win ORDER BY seg_idx) AS ps FROM gr g JOIN sg s ON s.job_id = g.job_id AND s.start >= g.ws AND s.e <= g.we),
ha AS (SELECT job_id, win, CAST(least(100, sum(p) + CASE WHEN count(*) / greatest(1, max(len) / 10) > 2 THEN 10 ELSE 0 END) AS DOUBLE) AS transcript,
  CAST(CASE WHEN count(DISTINCT speaker) >= 2 THEN 20 ELSE 0 END + CASE WHEN count(*) FILTER (ps <> speaker) >= 3 THEN 25 WHEN count(*) FILTER (ps <> speaker) >= 1 THEN 10 ELSE 0 END AS DOUBLE) AS speaker FROM hw GROUP BY 1, 2),
hz AS (SELECT gr.job_id, gr.win, ws AS start, we AS "end", coalesce(transcript, 0.0) AS transcript, coalesce(speaker, 0.0) AS speaker FROM gr LEFT JOIN ha USING (job_id, win))"""


@query("score1_transcript_hot_zones", f"WITH {ZONES} SELECT job_id, win, start, \"end\", transcript, speaker, round(transcript * 0.65 + speaker * 0.35, 1) AS composite FROM hz", doubles=("start",))
def _(v):
    return op.hot_zones(jobs(v), v.segments).select("job_id", "win", "start", "end", "transcript", "speaker", "composite")


KIND = "CASE kind WHEN 'spike' THEN 'extreme_spike' WHEN 'loud_moment' THEN 'volume_spike' ELSE kind END"
MOOD = "CASE moment_id % 5 WHEN 0 THEN 'laughter' WHEN 1 THEN 'applause' WHEN 2 THEN 'shouting' ELSE 'neutral' END"


def sounds(v):
    return v.audio_moments.select("job_id", "moment_id", "t", F.expr(KIND).alias("kind"), F.expr(MOOD).alias("sentiment"))


@query("score1_full_hot_zones", f"""
WITH {ZONES}, a0 AS (SELECT job_id, t, {KIND} AS k, {MOOD} AS m FROM audio_moments),
a AS (SELECT g.job_id, g.win, CAST(least(100, sum(CASE k WHEN 'extreme_spike' THEN 30 WHEN 'silence_to_loud' THEN 25 ELSE 15 END + CASE m WHEN 'laughter' THEN 15 WHEN 'applause' THEN 10 WHEN 'shouting' THEN 8 ELSE 0 END)) AS DOUBLE) AS audio FROM gr g JOIN a0 ON a0.job_id = g.job_id AND a0.t BETWEEN g.ws AND g.we GROUP BY 1, 2),
s AS (SELECT g.job_id, g.win, least(100.0, max(importance) * 6 + avg(importance) * 4 + CASE WHEN max(importance) >= 9 THEN 20 ELSE 0 END) AS scene FROM gr g JOIN scenes c ON c.job_id = g.job_id AND c.t BETWEEN g.ws AND g.we GROUP BY 1, 2),
f AS (SELECT g.job_id, g.win, count(*) / greatest((max(g.we) - max(g.ws)) / 60, 0.01) AS rate FROM gr g JOIN words w ON w.job_id = g.job_id AND w.start >= g.ws AND w."end" <= g.we WHERE w.word_idx % 19 = 0 GROUP BY 1, 2)
SELECT job_id, win, coalesce(audio, 0.0) AS audio, round(coalesce(scene, 0.0), 6) AS scene, round(coalesce(audio, 0) * 0.25 + transcript * 0.35 + coalesce(scene, 0) * 0.25 + speaker * 0.15 - CASE WHEN coalesce(rate, 0) > 6 THEN 15 WHEN coalesce(rate, 0) > 3 THEN 8 ELSE 0 END, 1) AS composite
FROM hz LEFT JOIN a USING (job_id, win) LEFT JOIN s USING (job_id, win) LEFT JOIN f USING (job_id, win)""")
def _(v):
    d = op.hot_zones(jobs(v), v.segments, v.scenes, sounds(v), v.words.where("word_idx % 19 = 0"))
    return d.select("job_id", "win", "audio", F.round("scene", 6).alias("scene"), "composite")


WEIGHTED = """CASE WHEN hook_score + flow_score + value_score + trend_score = 0 THEN CASE WHEN viral_score = 0 THEN 50 ELSE viral_score END ELSE round_even(hook_score * {w[0]}::DOUBLE + flow_score * {w[1]}::DOUBLE + value_score * {w[2]}::DOUBLE + trend_score * {w[3]}::DOUBLE, 0) END"""


@query("score2_final_scores", "SELECT clip_id, CAST(greatest(1, least(100, CASE clip_type WHEN 'story' THEN " + WEIGHTED.format(w=op.AXIS_WEIGHTS["talking_head"]) + " WHEN 'tip' THEN " + WEIGHTED.format(w=op.AXIS_WEIGHTS["sports"]) + " ELSE "
       + WEIGHTED.format(w=op.DEFAULT_WEIGHTS) + " END)) AS BIGINT) AS viral_score, hook_score + flow_score + value_score + trend_score = 0 AS legacy_fill FROM clips")
def _(v):
    kind = F.when(F.col("clip_type") == "story", "talking_head").when(F.col("clip_type") == "tip", "sports")
    return op.final_scores(v.clips, kind).select("clip_id", "viral_score", F.col("score_diagnostics.legacy_fill").alias("legacy_fill"))


@query("score2_fill_axes", """
SELECT clip_id, CASE WHEN hook_score = 0 THEN viral_score ELSE hook_score END AS hook_score, CASE WHEN trend_score = 0 THEN 50 ELSE trend_score END AS trend_score, hook_score = 0 OR flow_score = 0 OR value_score = 0 OR trend_score = 0 AS legacy_fill FROM clips""")
def _(v):
    return op.fill_axes(v.clips).select("clip_id", "hook_score", F.col("trend_score").cast("long").alias("trend_score"), "legacy_fill")


@query("score3_rescore_focus", "SELECT clip_id, viral_score, CAST(greatest(1, least(100, " + WEIGHTED.format(w=op.AXIS_WEIGHTS["music_video"]) + ")) AS BIGINT) AS composite FROM clips")
def _(v):
    return op.final_scores(v.clips, F.lit("music_video"), focus_mode=True).select("clip_id", "viral_score", "composite")


TREND = """lx AS (SELECT * FROM (VALUES (0, 'the', 0.8, NULL), (1, 'of on', 0.4, NULL), (2, 'der', 0.6, 'vlog'), (3, 'er st', 0.9, 'podcast'), (4, 'high low', 0.7, NULL)) AS x(i, p, h, g)),
sx AS (SELECT job_id, seg_idx, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9''-]{1,}')) AS tk FROM segments),
ex AS (SELECT job_id, seg_idx, h, row_number() OVER (PARTITION BY job_id, seg_idx ORDER BY i) AS n FROM sx, lx WHERE contains(t, p) AND (g IS NULL OR g = 'vlog')),
lo AS (SELECT job_id, seg_idx, h, row_number() OVER (PARTITION BY job_id, seg_idx ORDER BY i) AS n FROM sx, lx, LATERAL (SELECT list_distinct(regexp_extract_all(p, '[a-z][a-z0-9''-]{1,}')) AS pt) q WHERE len(pt) > 0 AND len(list_intersect(pt, tk)) >= greatest(1, len(pt) - 1) AND (g IS NULL OR g = 'vlog')),
es AS (SELECT job_id, seg_idx, sum(30 * h) AS s FROM ex WHERE n <= 3 GROUP BY 1, 2), ls AS (SELECT job_id, seg_idx, sum(15 * h) AS s FROM lo WHERE n <= 3 GROUP BY 1, 2)"""


@query("score4_trend_score", f"""
WITH {TREND} SELECT job_id, seg_idx, CASE WHEN trim(t) = '' THEN 50 ELSE CAST(round_even(round(greatest(20, least(100, 50 + coalesce(es.s, ls.s, 0) + least(25, 10 * ((CASE WHEN contains(t, 'ing') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'eau') THEN 1 ELSE 0 END)))
 + CASE WHEN len(list_intersect(tk, ['the', 'and', 'of', 'der'])) >= 2 THEN 10 ELSE 0 END)), 9), 0) AS BIGINT) END AS score FROM sx LEFT JOIN es USING (job_id, seg_idx) LEFT JOIN ls USING (job_id, seg_idx)""")
def _(v):
    t = op.trend_score(F.col("text"), F.lit("vlog"), LEXICON, ("ing", "eau"), "the and of der")
    return v.segments.select("job_id", "seg_idx", t["score"].alias("score"))


#: Trend score and reason of the joined texts of each window.
WINDOW_TREND = "wt AS (SELECT g.job_id, g.win AS seg_idx, string_agg(s.text, ' ' ORDER BY s.seg_idx) AS text FROM gr g JOIN segments s ON s.job_id = g.job_id AND s.start >= g.ws AND s.\"end\" <= g.we GROUP BY 1, 2),\n" + (
    TREND.replace("FROM segments", "FROM wt").replace("seg_idx, h, row", "seg_idx, h, p, row").replace("sum(30 * h) AS s", "sum(30 * h) AS s, string_agg(p, ', ' ORDER BY n) AS rs").replace("sum(15 * h) AS s", "sum(15 * h) AS s, string_agg('~' || p, ', ' ORDER BY n) AS rs")) + """,
hi AS (SELECT *, (CASE WHEN contains(t, 'ing') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'eau') THEN 1 ELSE 0 END) AS hits FROM sx),
tr AS (SELECT job_id, seg_idx AS win, CASE WHEN trim(t) = '' THEN 50 ELSE CAST(round_even(round(greatest(20, least(100, 50 + coalesce(es.s, ls.s, 0) + least(25, 10 * hits))), 9), 0) AS BIGINT) END AS trend,
  CASE WHEN trim(t) <> '' THEN concat_ws(', ', coalesce(es.rs, ls.rs), CASE WHEN hits > 0 THEN hits || ' emphasized' END) END AS reason FROM hi LEFT JOIN es USING (job_id, seg_idx) LEFT JOIN ls USING (job_id, seg_idx))"""


def _window_trend(v):
    return op.window_trend(jobs(v), v.segments, LEXICON, F.lit("vlog"), ("ing", "eau"))


@query("score1_trend_hot_zones", f"""
WITH {ZONES}, {WINDOW_TREND}, s AS (SELECT g.job_id, g.win, least(100.0, max(importance) * 6 + avg(importance) * 4 + CASE WHEN max(importance) >= 9 THEN 20 ELSE 0 END) AS scene FROM gr g JOIN scenes c ON c.job_id = g.job_id AND c.t BETWEEN g.ws AND g.we GROUP BY 1, 2),
a0 AS (SELECT job_id, t, {KIND} AS k, {MOOD} AS m FROM audio_moments),
a AS (SELECT g.job_id, g.win, least(100, sum(CASE k WHEN 'extreme_spike' THEN 30 WHEN 'silence_to_loud' THEN 25 ELSE 15 END + CASE m WHEN 'laughter' THEN 15 WHEN 'applause' THEN 10 WHEN 'shouting' THEN 8 ELSE 0 END)) AS audio FROM gr g JOIN a0 ON a0.job_id = g.job_id AND a0.t BETWEEN g.ws AND g.we GROUP BY 1, 2)
SELECT job_id, win, round(coalesce(audio, 0) * 0.2::DOUBLE + transcript * 0.3 + coalesce(scene, 0) * 0.2 + speaker * 0.15 + coalesce(trend, 50) * 0.15, 1) AS composite FROM hz LEFT JOIN a USING (job_id, win) LEFT JOIN s USING (job_id, win) LEFT JOIN tr USING (job_id, win)""")
def _(v):
    d = op.hot_zones(jobs(v), v.segments, v.scenes, sounds(v), trend=_window_trend(v).select("job_id", "win", "trend"))
    return d.select("job_id", "win", "composite")


@query("score1_zone_signals", f"""
WITH {JOBS}, gr AS (SELECT job_id, win, win * 20.0 AS ws, least(win * 20.0 + 30, duration) AS we FROM (SELECT *, unnest(range(CAST(ceil(duration / 20) AS BIGINT))) AS win FROM jb)), {WINDOW_TREND},
q AS (SELECT g.job_id, g.win, s.seg_idx, s.speaker, g.we - g.ws AS len, lag(s.speaker) OVER (PARTITION BY g.job_id, g.win ORDER BY s.seg_idx) AS ps, len(list_filter(toks, lambda w: w = upper(w) AND length(w) > 2 AND regexp_full_match(w, '\\pL+'))) > 0 AS raised,
  {" OR ".join(f"contains(lower(text), '{w}')" for w in op.EXCITED)} AS excited FROM gr g JOIN segments s ON s.job_id = g.job_id AND s.start >= g.ws AND s."end" <= g.we),
sp AS (SELECT job_id, win, min(seg_idx) FILTER (raised) AS r, min(seg_idx) FILTER (excited) AS x, count(*) / greatest(1, max(len) / 10) > 2 AS dense, count(DISTINCT speaker) AS n, count(*) FILTER (ps <> speaker) AS ch FROM q GROUP BY 1, 2),
m0 AS (SELECT job_id, moment_id, t, {KIND} AS k, {MOOD} AS m FROM audio_moments),
m1 AS (SELECT job_id, moment_id, t, 0 AS pos, CASE k WHEN 'extreme_spike' THEN 'extreme audio spike' ELSE 'silence->loud' END AS s FROM m0 WHERE k IN ('extreme_spike', 'silence_to_loud') UNION ALL SELECT job_id, moment_id, t, 1, m FROM m0 WHERE m = 'laughter'),
m2 AS (SELECT g.job_id, g.win, s || ' at ' || CAST(round_even(t, 0) AS BIGINT) || 's' AS s, row_number() OVER (PARTITION BY g.job_id, g.win ORDER BY t, moment_id, pos) AS n FROM gr g JOIN m1 ON m1.job_id = g.job_id AND m1.t BETWEEN g.ws AND g.we),
au AS (SELECT job_id, win, string_agg(s, ' | ' ORDER BY n) AS au FROM m2 WHERE n <= 3 GROUP BY 1, 2),
sc AS (SELECT g.job_id, g.win, max(importance) AS mx FROM gr g JOIN scenes c ON c.job_id = g.job_id AND c.t BETWEEN g.ws AND g.we GROUP BY 1, 2),
fi AS (SELECT g.job_id, g.win, count(*) / greatest((max(g.we) - max(g.ws)) / 60, 0.01) AS rate FROM gr g JOIN words w ON w.job_id = g.job_id AND w.start >= g.ws AND w."end" <= g.we WHERE length(w.word) <= 2 GROUP BY 1, 2)
SELECT gr.job_id, gr.win, concat_ws(' | ', au, CASE WHEN rate > 6 THEN 'high filler density' END, CASE WHEN r IS NOT NULL AND (x IS NULL OR r <= x) THEN 'raised voice' END, CASE WHEN x IS NOT NULL THEN 'emotional reaction' END, CASE WHEN r > x THEN 'raised voice' END,
 CASE WHEN dense THEN 'dense dialogue' END, CASE WHEN mx >= 8 THEN 'visual peak (' || mx || '/10)' END, CASE WHEN sp.n >= 2 THEN sp.n || ' speakers' END, CASE WHEN ch >= 3 THEN 'rapid exchange' END, CASE WHEN trend >= 60 AND reason <> '' THEN 'trend match: ' || reason END) AS signals
FROM gr LEFT JOIN au USING (job_id, win) LEFT JOIN fi USING (job_id, win) LEFT JOIN sp USING (job_id, win) LEFT JOIN sc USING (job_id, win) LEFT JOIN tr USING (job_id, win)""")
def _(v):
    fillers = v.words.where(F.length("word") <= 2)
    d = op.zone_signals(jobs(v), v.segments, v.scenes, sounds(v), fillers, _window_trend(v))
    return d.select("job_id", "win", F.concat_ws(" | ", "signals").alias("signals"))


@query("agg38_matched_phrases", """
WITH t AS (SELECT job_id, lower(string_agg(text, ' ' ORDER BY seg_idx)) AS t FROM segments GROUP BY 1), h AS (SELECT job_id, p AS phrase, row_number() OVER (PARTITION BY job_id ORDER BY i) AS rank FROM t, (VALUES (0, 'the'), (1, 'of on'), (2, 'der'), (3, 'er st'), (4, '. the')) AS x(i, p) WHERE contains(t, p))
SELECT * FROM h WHERE rank <= 3""")
def _(v):
    return op.matched_phrases(v.segments, ["the", "of on", "der", "er st", ". the"], 3).withColumn("rank", F.col("rank").cast("long"))


RETAIN = """oh AS (SELECT c.clip_id, bool_or(contains(text, '?')) AS q, bool_or(contains(text, '!')) AS x, sum(n_words) AS w, bool_or({curious}) AS cu FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.start < c.start + 3 AND s."end" > c.start GROUP BY 1),
en AS (SELECT c.clip_id, s.seg_idx, s.speaker, CASE WHEN s."end" > s.start THEN n_words / ((s."end" - s.start) / 60) END AS wpm, lower(text) AS lt,
 least(1.0, 0.5 + CASE WHEN contains(text, '!') THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '?') THEN 0.1 ELSE 0 END + CASE WHEN len(list_filter(toks, lambda w: w = upper(w) AND length(w) > 2 AND regexp_full_match(w, '\\pL+'))) > 0 THEN 0.15 ELSE 0 END + CASE WHEN {bright} THEN 0.2 ELSE 0 END + CASE WHEN {dark} THEN 0.1 ELSE 0 END) AS e,
 row_number() OVER (PARTITION BY c.clip_id ORDER BY s.seg_idx) - 1 AS i, count(*) OVER (PARTITION BY c.clip_id) AS n FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.start >= c.start AND s."end" <= c."end"),
eg AS (SELECT clip_id, max(n) AS n, avg(wpm) AS m, stddev_pop(wpm) AS sd, avg(e) FILTER (i < n // 2) AS e1, avg(e) FILTER (i >= n // 2) AS e2, count(DISTINCT speaker) AS sp, first(lt ORDER BY seg_idx) AS ft FROM en GROUP BY 1),
sc AS (SELECT c.clip_id, count(*) AS sc, count(*) FILTER (importance >= 7) AS hi FROM clips c JOIN scenes s ON s.job_id = c.job_id AND s.t BETWEEN c.start AND c."end" GROUP BY 1),
fa AS (SELECT c.clip_id, CASE WHEN oh.w IS NULL THEN 0.3 ELSE least(1.0, 0.5 + CASE WHEN q THEN 0.15 ELSE 0 END + CASE WHEN x THEN 0.1 ELSE 0 END + CASE WHEN w BETWEEN 3 AND 15 THEN 0.1 ELSE 0 END + CASE WHEN cu THEN 0.15 ELSE 0 END) END AS hook,
 CASE WHEN coalesce(n, 0) < 3 OR m IS NULL THEN 0.5 WHEN m = 0 THEN 0.3 WHEN sd / m BETWEEN 0.2 AND 0.5 THEN 0.8 WHEN sd / m < 0.1 THEN 0.4 WHEN sd / m > 0.8 THEN 0.5 ELSE 0.6 END AS pacing,
 CASE WHEN sc IS NULL THEN 0.5 ELSE least(1.0, CASE WHEN sc / (duration / 60) BETWEEN 3 AND 8 THEN 0.8 WHEN sc / (duration / 60) < 1 THEN 0.3 WHEN sc / (duration / 60) > 15 THEN 0.5 ELSE 0.6 END + CASE WHEN hi > 0 THEN least(0.15, hi * 0.05) ELSE 0 END) END AS visual,
 CASE WHEN coalesce(n, 0) < 2 THEN 0.5 WHEN e2 > e1 + 0.1 THEN 0.8 WHEN abs(e2 - e1) < 0.05 THEN 0.4 ELSE 0.6 END AS arc,
 CASE WHEN n IS NULL THEN 0.5 ELSE greatest(0, least(1, 0.6 - CASE WHEN regexp_matches(ft, '^(he|she|they|it|that|this) ') THEN 0.15 ELSE 0 END - CASE WHEN regexp_matches(ft, '^(and|but|so|because|then) ') THEN 0.1 ELSE 0 END + CASE WHEN sp >= 2 THEN 0.1 ELSE 0 END + CASE WHEN duration >= 60 THEN 0.1 ELSE 0 END)) END AS standalone
 FROM clips c LEFT JOIN oh USING (clip_id) LEFT JOIN eg USING (clip_id) LEFT JOIN sc USING (clip_id))""".format(
    curious=" OR ".join(f"contains(lower(text), '{w}')" for w in op.CURIOUS), bright=" OR ".join(f"contains(lower(text), '{w}')" for w in op.BRIGHT), dark=" OR ".join(f"contains(lower(text), '{w}')" for w in op.DARK))


@query("score5_retention", f"WITH {RETAIN} SELECT clip_id, round(hook, 6) AS hook, pacing, round(visual, 6) AS visual, arc, round(standalone, 6) AS standalone FROM fa", doubles=("hook", "pacing", "visual", "arc", "standalone"))
def _(v):
    d = op.retention(v.clips, v.segments, v.scenes)
    return d.select("clip_id", F.round("hook", 6).alias("hook"), "pacing", F.round("visual", 6).alias("visual"), "arc", F.round("standalone", 6).alias("standalone"))


@query("score5_retention_curve", f"""
WITH {RETAIN}, p AS (SELECT *, unnest(range(20)) AS i FROM fa), q AS (SELECT *, i / 19.0 * 100 AS t, (1 - hook) * 25 AS lost, (1 - (pacing + visual) / 2) * 20 AS mid, CASE WHEN arc > 0.6 THEN (arc - 0.6) * 10 ELSE -(1 - arc) * 10 END AS tail FROM p)
SELECT clip_id, round(t, 3) AS time_pct, round(greatest(20, least(100, CASE WHEN t <= 5 THEN 100 WHEN t <= 15 THEN 100 - lost * (t - 5) / 10 WHEN t <= 80 THEN 100 - lost - mid * (t - 15) / 65 ELSE 100 - lost - mid + tail * (t - 80) / 20 END)), 0) AS retention FROM q WHERE i % 6 = 3""")
def _(v):
    d = op.retention(v.clips, v.segments, v.scenes).select("clip_id", F.posexplode("curve").alias("i", "p")).where("i % 6 = 3")
    return d.select("clip_id", F.round(F.col("i") / 19.0 * 100, 3).alias("time_pct"), F.round("p.retention_pct", 0).alias("retention"))


OPEN = r"""of0 AS (SELECT c.clip_id, c.start, arg_min(struct_pack(s := s.start, t := trim(s.text), p := s.speaker), struct_pack(a := s.start, b := s.seg_idx)) AS f FROM clips c JOIN segments s ON s.job_id = c.job_id AND s.start < c.start + 3 AND s."end" > c.start GROUP BY 1, 2),
bf AS (SELECT c.clip_id, first(s.speaker ORDER BY s."end" DESC, s.seg_idx) AS prev FROM clips c JOIN segments s ON s.job_id = c.job_id AND s."end" > c.start - 2 AND s."end" <= c.start + 0.5 GROUP BY 1),
im AS (SELECT c.clip_id, first(importance ORDER BY t, scene_id) AS imp FROM clips c JOIN scenes s ON s.job_id = c.job_id AND s.t BETWEEN c.start AND c.start + 1 GROUP BY 1),
am AS (SELECT c.clip_id, bool_or(t <= c.start + 0.5) AS attack, first({mood} ORDER BY t, moment_id) FILTER ({mood} <> 'neutral') AS mood FROM clips c JOIN audio_moments m ON m.job_id = c.job_id AND m.t BETWEEN c.start AND c.start + 1.5 GROUP BY 1),
ow AS (SELECT c.clip_id, c.start, f, prev, imp, coalesce(attack, false) AS attack, mood, list_filter(regexp_split_to_array(f.t, '\s+'), lambda x: x <> '')[1:6] AS w FROM clips c LEFT JOIN of0 USING (clip_id) LEFT JOIN bf USING (clip_id) LEFT JOIN im USING (clip_id) LEFT JOIN am USING (clip_id)),
ox AS (SELECT *, rtrim(lower(coalesce(w[1], '')), '.,!?') AS a, rtrim(lower(coalesce(w[2], '')), '.,!?') AS b FROM ow)""".format(mood=MOOD)


@query("score6_opening_score", f"""
WITH {OPEN} SELECT clip_id, CAST(CASE WHEN f IS NULL THEN least(100, 15 + CASE WHEN attack THEN 30 ELSE 0 END + CASE WHEN imp >= 8 THEN 20 ELSE 0 END) ELSE greatest(0, least(100, 50 + CASE WHEN f.s < start - 0.5 THEN -25 ELSE 0 END
 + CASE WHEN a IN ('um', 'uh', 'like', 'so', 'and', 'but', 'well', 'yeah') THEN -20 ELSE 0 END + CASE WHEN a IN ('that', 'this', 'it', 'they', 'he', 'she', 'those', 'these') AND b IN ('is', 'was', 'were', 'are', '''s', 'thing') THEN -15 ELSE 0 END
 + CASE WHEN contains(array_to_string(w, ' '), '?') THEN 25 ELSE 0 END + CASE WHEN a IN ('wow', 'oh', 'wait', 'no', 'what', 'holy', 'damn', 'yo', 'bro') THEN 20 ELSE 0 END + CASE WHEN prev <> f.p THEN 15 ELSE 0 END + CASE WHEN contains(f.t, '!') THEN 10 ELSE 0 END
 + CASE WHEN {" OR ".join("contains(lower(f.t), '%s')" % b.replace("'", "''") for b in op.BOLD)} THEN 15 ELSE 0 END + CASE WHEN attack THEN 10 ELSE 0 END + CASE WHEN mood IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN imp >= 8 THEN 8 WHEN imp <= 3 THEN -8 ELSE 0 END)) END AS BIGINT) AS opening FROM ox""")
def _(v):
    return op.opening_score(v.clips, v.segments, v.scenes, sounds(v)).select("clip_id", "opening")


@query("score6_better_opening", r"""
WITH s AS (SELECT job_id, seg_idx, start, trim(text) AS t, rtrim(lower(coalesce(toks[1], '')), '.,!?') AS a FROM segments), p AS (SELECT *, CASE WHEN contains(left(t, 60), '?') THEN 3 ELSE 0 END + CASE WHEN contains(left(t, 60), '!') THEN 2 ELSE 0 END + CASE WHEN a IN ('wow', 'oh', 'wait', 'no', 'what', 'holy') THEN 3 ELSE 0 END AS p FROM s
 WHERE a NOT IN ('um', 'uh', 'like', 'so', 'and', 'but', 'well'))
SELECT c.clip_id, first(p.start ORDER BY p DESC, seg_idx) AS better_start FROM clips c JOIN p ON p.job_id = c.job_id AND p.start BETWEEN c.start AND c.start + 5 AND p > 0 GROUP BY 1""")
def _(v):
    return op.better_opening(v.clips, v.segments).select("clip_id", "better_start")


@query("score7_thirds_score", """
WITH p AS (SELECT job_id, clip_id, part, start + part * ("end" - start) / 3 AS ps, CASE WHEN part = 2 THEN "end" ELSE start + (part + 1) * (("end" - start) / 3) END AS pe FROM clips, range(3) AS r(part) WHERE "end" - start >= 10),
g AS (SELECT p.clip_id, part, sum(n_words) AS w, sum(least(s."end", pe) - greatest(s.start, ps)) AS d, sum(CASE WHEN contains(text, '!') THEN 8 ELSE 0 END + CASE WHEN contains(text, '?') THEN 6 ELSE 0 END) AS m, count(DISTINCT speaker) AS sp FROM p JOIN segments s ON s.job_id = p.job_id AND s.start < pe AND s."end" > ps GROUP BY 1, 2),
s AS (SELECT clip_id, part, least(100, CASE WHEN d > 0 THEN least(40, floor(round(w / d * 12, 9))) ELSE 0 END + m + CASE WHEN sp >= 2 THEN 10 ELSE 0 END) AS s FROM g),
t AS (SELECT c.clip_id, "end" - start < 10 AS sh, coalesce(max(s) FILTER (part = 0), 0) AS o, coalesce(max(s) FILTER (part = 1), 0) AS m, coalesce(max(s) FILTER (part = 2), 0) AS c FROM clips c LEFT JOIN s USING (clip_id) GROUP BY 1, 2),
u AS (SELECT *, CASE WHEN sh THEN 'too_short_to_measure' WHEN m < 20 AND o > 40 THEN 'energy_valley' WHEN o < 25 THEN 'slow_start' WHEN c < 20 AND o > 40 THEN 'fizzle_ending' WHEN o > 50 AND m > 30 AND c > 40 THEN 'sustained_energy' ELSE 'moderate' END AS shape FROM t)
SELECT clip_id, shape, CAST(CASE shape WHEN 'too_short_to_measure' THEN 50 WHEN 'energy_valley' THEN floor(round((o * 0.4 + m * 0.3 + c * 0.3) * 0.7, 9)) WHEN 'slow_start' THEN floor(round((o * 0.4 + m * 0.3 + c * 0.3) * 0.8, 9)) WHEN 'fizzle_ending' THEN floor(round((o * 0.4 + m * 0.3 + c * 0.3) * 0.75, 9))
 ELSE floor(round(o * 0.35 + m * 0.3 + c * 0.35, 9)) END AS BIGINT) AS thirds FROM u""")
def _(v):
    return op.thirds_score(v.clips, v.segments).select("clip_id", "shape", "thirds")


@query("score8_post_process")
def _(v):
    j = v.jobs.select(F.col("job_no").alias("job_id"), (600.0 + F.col("job_no") % 5 * 900).alias("duration"))
    c = ranked(v).withColumn("platform", F.when(F.col("platform") == "reels", "tiktok").otherwise(F.col("platform")))
    return op.post_process(c, v.segments, v.scenes, j, 5).select("job_id", "clip_id", "start", "end", "duration", "viral_score", "hook_score", "shape", "platform", "rank")


@query("fn1_keywords", f"""
WITH s AS (SELECT job_id, seg_idx, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9''-]{{1,}}'), lambda t: length(t) > 2 AND NOT list_contains({list(tx.STOP_WORDS)}, t)) AS k FROM segments) SELECT job_id, seg_idx, k AS words, len(k) AS n FROM s""")
def _(v):
    return v.segments.select("job_id", "seg_idx", tx.keywords(F.col("text")).alias("words")).withColumn("n", F.size("words").cast("long"))


@query("fn3_title_jaccard", r"""
WITH t AS (SELECT job_id, clip_id, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(title), '\s+'), lambda w: regexp_replace(w, '[^\pL\pN]', '', 'g')), lambda w: length(w) > 2))) AS a FROM clips)
SELECT clip_id, round(len(list_intersect(a, ['urgent', 'high', 'not'])) / len(list_distinct(list_concat(a, ['urgent', 'high', 'not']))), 6) AS similarity FROM t""")
def _(v):
    ref = F.array(F.lit("urgent"), F.lit("high"), F.lit("not"))
    a = tx.title_words(F.col("title"))
    return v.clips.select("clip_id", F.round(tx.jaccard(a, ref), 6).alias("similarity"))


@query("fn4_looping_text", """
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM d), n AS (SELECT doc_id, w, len(w) AS n FROM w),
g AS (SELECT doc_id, n, unnest(list_transform(range(1, n - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM n WHERE n >= 9), c AS (SELECT doc_id, n, g, count(*) AS k FROM g GROUP BY 1, 2, 3),
l AS (SELECT doc_id, max(k) >= 3 AND max(k) / (max(n) - 2) > 0.4 AS looping FROM c GROUP BY 1) SELECT doc_id, coalesce(looping, false) AS looping FROM d LEFT JOIN l USING (doc_id) WHERE NOT regexp_matches(left(t, 50), '[\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}\\x{ac00}-\\x{d7af}]')""")
def _(v):
    return v.documents.where(~tx.looks_cjk(F.col("text"))).select("doc_id", tx.is_looping(F.col("text")).alias("looping"))


@query("fn5_scripts", r"""
SELECT doc_id, regexp_matches(left(text, 50), '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]') AS cjk,
 CASE WHEN len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]')) / greatest(length(text), 1) > 0.3 THEN CASE WHEN regexp_matches(text, '[\x{3040}-\x{30ff}]') THEN 'ja' ELSE 'zh' END WHEN regexp_matches(text, '[\x{0600}-\x{06ff}]') THEN 'ar' ELSE 'en' END AS guess FROM documents""")
def _(v):
    return v.documents.select("doc_id", tx.looks_cjk(F.col("text")).alias("cjk"), tx.sample_language(F.col("text")).alias("guess"))


@query("fn8_proportional_words", r"""
WITH w AS (SELECT job_id, seg_idx, start, "end" - start AS span, unnest(toks) AS word, generate_subscripts(toks, 1) AS i FROM segments),
c AS (SELECT *, sum(length(word)) OVER (PARTITION BY job_id, seg_idx ORDER BY i) AS upto, sum(length(word)) OVER (PARTITION BY job_id, seg_idx) AS total FROM w)
SELECT job_id, seg_idx, i - 1 AS word_idx, word, start + span * (upto - length(word)) / total AS start, start + span * upto / total AS "end" FROM c""")
def _(v):
    w = tx.proportional_words(F.array_join("toks", " "), F.col("start"), F.col("end"), digits=None)
    return v.segments.select("job_id", "seg_idx", F.posexplode(w).alias("word_idx", "w")).select("job_id", "seg_idx", F.col("word_idx").cast("long").alias("word_idx"), "w.word", "w.start", "w.end")


@query("fn9_spoken_window", """SELECT job_id, seg_idx, CASE WHEN seg_idx % 3 = 0 THEN start ELSE greatest(start - 0.02, start + 0.1) END AS start, round(CASE WHEN seg_idx % 3 = 0 THEN "end" + 0.1 ELSE greatest("end", "end" + 0.3) + 0.1 END, 6) AS "end" FROM segments""")
def _(v):
    words = F.when(F.col("seg_idx") % 3 != 0, F.array(F.struct((F.col("start") + 0.1).alias("start"), (F.col("start") + 0.2).alias("end")), F.struct(F.col("end").alias("start"), (F.col("end") + 0.3).alias("end"))))
    w = tx.spoken_window(F.col("start"), F.col("end"), words)
    return v.segments.select("job_id", "seg_idx", w.alias("w")).select("job_id", "seg_idx", "w.start", F.round("w.end", 6).alias("end"))


@query("fn10_box_iou", """
WITH b AS (SELECT face_key, greatest(0, least(x + w / 2, 60) - greatest(x - w / 2, 40)) * greatest(0, least(y + h / 2, 70) - greatest(y - h / 2, 30)) AS i, w * h + 800 AS a FROM faces) SELECT face_key, round(i / (a - i), 6) AS iou FROM b""")
def _(v):
    from ..operators.joins import region_iou

    d = v.faces.withColumns({"bx": F.lit(50.0), "by": F.lit(50.0), "bw": F.lit(20.0), "bh": F.lit(40.0)})
    return d.select("face_key", F.round(region_iou(("x", "y", "w", "h"), ("bx", "by", "bw", "bh")), 6).alias("iou"))


@query("fn11_histogram_distance", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS h FROM e)
SELECT vec_id, round(list_sum(list_transform(h, lambda x: power(x - 1.0 / 64, 2) / (x + 1.0 / 64 + 1e-9))), 6) AS distance FROM n""")
def _(v):
    h = tx.unit_mass(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    flat = F.array_repeat(F.lit(1.0 / 64), 64)
    return v.embeddings.select("vec_id", F.round(tx.chi_squared(h, flat), 6).alias("distance"))


@query("fn13_safe_x", "SELECT face_key, CAST(greatest(20, least(80, floor(x + 0.5))) AS BIGINT) AS safe, CAST(greatest(10, least(90, floor(x + 0.5))) AS BIGINT) AS plain FROM faces")
def _(v):
    return v.faces.select("face_key", tx.safe_x(F.col("x"), 16 / 9, 9 / 16).cast("long").alias("safe"), tx.safe_x(F.col("x")).cast("long").alias("plain"))


@query("fn16_guidance", "SELECT doc_id, CASE " + " ".join("WHEN regexp_matches(lower(text), '%s') THEN '%s'" % ("|".join(w), n) for n, w in tx.GUIDANCE) + " ELSE 'General' END AS guidance FROM documents")
def _(v):
    return v.documents.select("doc_id", tx.guidance(F.col("text")).alias("guidance"))
