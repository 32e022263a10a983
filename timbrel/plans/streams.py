"""Queries: streaming operators, as streams over the event files and in batch form."""

from pyspark.sql import functions as F

from ..streaming import streams as st
from .registry import query

HEALTH = """
WITH r AS (SELECT *, sum(CASE WHEN failed IS DISTINCT FROM pf THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY t, call_id) AS run FROM (SELECT *, lag(failed) OVER (PARTITION BY provider ORDER BY t, call_id) AS pf FROM calls)),
m AS (SELECT *, failed AND lag(run, 2) OVER w = run AND t - lag(t, 2) OVER w < 600 AS third FROM r WINDOW w AS (PARTITION BY provider ORDER BY t, call_id)),
l AS (SELECT *, max(CASE WHEN third THEN t END) OVER (PARTITION BY provider, run ORDER BY t, call_id) AS last FROM m)
SELECT provider, call_id, coalesce(failed AND t < last + 900, false) AS degraded FROM l"""


@query("str1_provider_health", HEALTH)
def _(v):
    return st.provider_health(v.calls).select("provider", "call_id", "degraded")


def call_stream(v):
    d = st.read_events(v.spark, v.sf_dir, "events")
    return d.select((F.col("user_id") % 5).alias("provider"), F.col("event_id").alias("call_id"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1000000).alias("t"), (F.col("event_type") == "error").alias("failed"))


@query("str1_provider_health_stream", HEALTH)
def _(v):
    return st.run_available(st.provider_health_stream(call_stream(v)), "health").select("provider", "call_id", "degraded")


@query("str2_latest_status", """
SELECT user_id AS job_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS status, arg_max(value, struct_pack(t := ts, i := event_id)) AS progress FROM events GROUP BY 1""")
def _(v):
    u = v.events.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("update_id"), F.col("event_type").alias("status"), F.col("value").alias("progress"), F.col("props").alias("message"))
    return st.latest_status(u).select("job_id", "status", "progress")


def sensors(v):
    return v.readings.select("job_id", (F.col("event_id") % 3).alias("sensor"), F.col("event_id").alias("sample_id"), "t", "value")


BASELINE = """
WITH a AS (SELECT job_id, event_id % 3 AS sensor, event_id, value AS v, row_number() OVER w AS i FROM readings WINDOW w AS (PARTITION BY job_id, event_id % 3 ORDER BY t, event_id)),
m AS (SELECT y.job_id, y.sensor, y.event_id, y.v, sum(CASE WHEN x.i = 1 THEN 1.0 ELSE 0.1 END * power(0.9, y.i - 1 - x.i) * x.v) AS mean FROM a y JOIN a x ON x.job_id = y.job_id AND x.sensor = y.sensor AND x.i < y.i GROUP BY 1, 2, 3, 4)
SELECT job_id, sensor, event_id AS sample_id, round(least(1.0, abs(v - mean) / 60), 6) AS confidence FROM m WHERE abs(v - mean) >= 60"""


@query("str3_baseline_triggers", BASELINE)
def _(v):
    return st.baseline_triggers(sensors(v), 60.0).select("job_id", "sensor", "sample_id", F.round("confidence", 6).alias("confidence"))


@query("str3_baseline_triggers_stream", BASELINE)
def _(v):
    from .rules import ORIGIN
    from .rules import arriving as readings

    r = readings(v).withColumn("sensor", F.col("sample_id") % 3)
    d = r.select("job_id", "sensor", "sample_id", ((F.unix_millis("ts") - ORIGIN) / 1000).alias("t"), "value")
    got = st.run_available(st.baseline_triggers_stream(d, 60.0), "baseline")
    return got.select("job_id", "sensor", "sample_id", F.round("confidence", 6).alias("confidence"))


def half_second_frames(v, fields):
    """Sensor readings of each half second as one frame."""
    r = sensors(v).withColumn("t", F.floor(F.col("t") * 2) / 2).groupBy("job_id", "t", "sensor").agg(F.avg("value").alias("value"))
    r = r.withColumns({"confidence": (F.col("sensor") + 1) / 4.0, "hint": F.when(F.col("sensor") == 0, "health").otherwise("map")})
    return r.groupBy("job_id", "t").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("sensors"))


@query("str4_idle_glances")
def _(v):
    f = half_second_frames(v, ("sensor", "confidence", "value"))
    fired = F.transform(F.filter("sensors", lambda s: s["value"] > 200), lambda s: s["sensor"])
    return st.idle_glances(f.withColumn("fired", fired), 5.0)


@query("str5_near_peaks", """
WITH f AS (SELECT DISTINCT job_id, floor(t * 2) / 2 AS t FROM readings) SELECT job_id, t, EXISTS (SELECT 1 FROM readings r WHERE r.job_id = f.job_id AND r.kind = 'purchase' AND abs(r.t - f.t) <= 0.5) AS near_peak FROM f""")
def _(v):
    f = v.readings.select("job_id", (F.floor(F.col("t") * 2) / 2).alias("t")).distinct()
    return st.near_peaks(f, v.readings.where("kind = 'purchase'"), 1.0)


LIVE = """
WITH s AS (SELECT job_id, start, "end" AS e, CASE WHEN contains(text, '!') THEN 8 ELSE 0 END + CASE WHEN contains(text, '?') THEN 6 ELSE 0 END + 1 AS p FROM segments), w AS (SELECT s.*, unnest([floor(start / 20), floor(start / 20) - 1]) * 20 AS ws FROM s)
SELECT job_id, CAST(ws AS BIGINT) AS w_start, CAST(least(100, sum(p)) AS BIGINT) AS transcript, count(*) AS n FROM w WHERE start < ws + 30 AND e <= ws + 30 GROUP BY 1, 2"""


def arriving(v):
    return v.segments.select("job_id", F.timestamp_micros(F.round(F.col("start") * 1000000).cast("long")).alias("ts"), F.timestamp_micros(F.round(F.col("end") * 1000000).cast("long")).alias("end_ts"), st.points_of(F.col("text")).alias("points"))


@query("str6_live_zones", LIVE)
def _(v):
    d = st.live_zones(arriving(v))
    return d.select("job_id", F.unix_seconds("w_start").alias("w_start"), F.col("transcript").cast("long").alias("transcript"), "n")


def _decay_frames(v):
    return v.readings.groupBy("job_id", (F.col("event_id") % 2).alias("sensor"), F.floor(F.col("t") * 5).alias("frame")).agg(F.max(F.when(F.col("kind") == "click", 1.2)).alias("peak"))


@query("str7_decaying_weights", """
WITH RECURSIVE f AS (SELECT job_id, event_id % 2 AS sensor, CAST(floor(t * 5) AS BIGINT) AS frame, max(CASE WHEN kind = 'click' THEN 1.2::DOUBLE END) AS peak FROM readings GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY job_id, sensor ORDER BY frame) AS rn FROM f),
h AS (SELECT job_id, sensor, frame, rn, coalesce(peak, 0.0::DOUBLE) AS w, CASE WHEN peak IS NULL THEN 0 ELSE frame END AS last FROM o WHERE rn = 1
UNION ALL SELECT o.job_id, o.sensor, o.frame, o.rn, CASE WHEN o.frame - l2 > 9 THEN w2 * exp(-(o.frame - l2 - 9) / 30.0::DOUBLE) ELSE w2 END, l2 FROM h JOIN o ON o.job_id = h.job_id AND o.sensor = h.sensor AND o.rn = h.rn + 1,
 LATERAL (SELECT CASE WHEN o.peak IS NULL THEN h.w ELSE greatest(h.w, o.peak) END AS w2, CASE WHEN o.peak IS NULL THEN h.last ELSE o.frame END AS l2) x)
SELECT job_id, sensor, frame, round(w, 6) AS weight FROM h WHERE w >= 0.05""")
def _(v):
    return st.decaying_weights(_decay_frames(v)).withColumn("weight", F.round("weight", 6))
