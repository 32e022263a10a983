"""Queries: rules over event time, as streams over the event files and in batch form."""

from pyspark.sql import functions as F

from ..streaming import rules as ru
from ..streaming import streams as st
from ..streaming.timers import run_closed
from .registry import query

DELAY = "1 minute"
#: Media time 0 in the streams; a watermark starts at 1970, so rows there would be late.
ORIGIN = 1_704_067_200_000


def arriving(v):
    """The readings as a stream; time as in the view of that name."""
    d = st.read_events(v.spark, v.sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000)
    ms = F.floor(F.col("us") / 20000000)
    return d.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("sample_id"), F.timestamp_millis(ms + ORIGIN).alias("ts"), F.col("event_type").alias("kind"), "value")


#: A job that no table has; its row must pass the filters and joins before a watermark is taken.
NO_JOB = -(1 << 62)


def closed(rows, closing, **values):
    """Rows of a stream and, at the end of time, one row of a job that is dropped; the watermark follows both."""
    values = {"ts": F.col("closing"), "job_id": F.lit(NO_JOB)} | {c: F.lit(x) for c, x in values.items()}
    end = closing.select(*[values.get(c, F.lit(None)).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return rows.unionByName(end).withWatermark("ts", DELAY)


# --- idle fallback ---

IDLE = """
WITH RECURSIVE m AS (SELECT job_id, CAST(round(t * 1000) AS BIGINT) AS t, bool_or(event_id % 3 = 0 AND value > 200) AS f0, bool_or(event_id % 3 = 1 AND value > 200) AS f1, bool_or(event_id % 3 = 2 AND value > 200) AS f2 FROM readings GROUP BY 1, 2),
p AS (SELECT *, sum(CASE WHEN t - before > 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY t) AS part FROM (SELECT *, lag(t) OVER (PARTITION BY job_id ORDER BY t) AS before FROM m)),
g AS (SELECT *, lead(t) OVER (PARTITION BY job_id, part ORDER BY t) AS next FROM (SELECT *, min(t) OVER (PARTITION BY job_id, part) AS first, max(t) OVER (PARTITION BY job_id, part) + 30000 AS until FROM p) WHERE t = first OR f0 OR f1 OR f2),
e AS (SELECT job_id, part, t, f0, f1, f2, false AS due FROM g UNION ALL SELECT job_id, part, unnest(range(t + 5000, least(coalesce(next - 1, until), until) + 1, 5000)), false, false, false, true FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id, part ORDER BY t) AS rn FROM e),
s AS (SELECT job_id, part, rn, t, t AS s0, t AS s1, t AS s2, CAST(NULL AS BIGINT) AS pick FROM o WHERE rn = 1
UNION ALL SELECT job_id, part, rn, t, CASE WHEN f0 OR k = 0 THEN t ELSE s0 END, CASE WHEN f1 OR k = 1 THEN t ELSE s1 END, CASE WHEN f2 OR k = 2 THEN t ELSE s2 END, k FROM (
 SELECT *, CASE WHEN due THEN CAST(CASE greatest(x0, x1, x2) WHEN x0 THEN 0 WHEN x1 THEN 1 ELSE 2 END AS BIGINT) END AS k FROM (
  SELECT o.*, s0, s1, s2, 0.25 * least((o.t - s0) / 5000::DOUBLE, 3) AS x0, 0.5 * least((o.t - s1) / 5000::DOUBLE, 3) AS x1, 0.75 * least((o.t - s2) / 5000::DOUBLE, 3) AS x2
  FROM s JOIN o ON o.job_id = s.job_id AND o.part = s.part AND o.rn = s.rn + 1)))
SELECT job_id, t, pick AS sensor FROM s WHERE pick IS NOT NULL"""


def signs(readings):
    sensor = F.col("sample_id") % 3
    known = F.array(*[F.struct(F.lit(k).cast("long").alias("sensor"), F.lit((k + 1) / 4.0).alias("confidence")) for k in range(3)])
    fired = F.when(F.col("value") > 200, F.array(sensor)).otherwise(F.array().cast("array<bigint>"))
    return readings.withColumns({"fired": fired, "sensors": known})


@query("str4_timed_glances", IDLE)
def _(v):
    r = v.readings.select("job_id", F.col("event_id").alias("sample_id"), F.round(F.col("t") * 1000).cast("long").alias("t"), "value")
    return ru.timed_glances(signs(r), 5_000, 30_000)


@query("str4_timed_glances_stream", IDLE)
def _(v):
    return run_closed(v.spark, lambda closing: ru.timed_glances(closed(signs(arriving(v)).drop("kind"), closing), 5_000, 30_000), "idle").where(F.col("job_id") != NO_JOB).withColumn("t", F.col("t") - ORIGIN)


# --- trigger bus ---


def bus_sql(frames, scale):
    """Combined triggers of frames f(job_id, t, near, v0, v1, v2), one step a frame."""
    def each(text, glue=", "):
        return glue.join(text.replace("#", str(k)).replace("CONF", f"{(k + 1) / 4}").replace("LIMIT", "(CASE WHEN near THEN 30.0 ELSE 60.0 END)" if k == 0 else "60.0") for k in range(3))

    return f"""
WITH RECURSIVE {frames}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t) AS rn FROM f),
s AS (SELECT job_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS t, {each("CAST(NULL AS DOUBLE) AS m#, CAST(0 AS DOUBLE) AS s#, CAST(-1e18 AS DOUBLE) AS r#, false AS out#")}, CAST(0 AS DOUBLE) AS last, false AS delta FROM (SELECT DISTINCT job_id FROM f)
UNION ALL SELECT job_id, rn, t, {each("CASE WHEN v# IS NULL THEN m# WHEN m# IS NULL THEN v# ELSE 0.9 * m# + 0.1 * v# END, CASE WHEN pick = # THEN t ELSE s# END, CASE WHEN h# OR pick = # AND t - r# >= 2 THEN t ELSE r# END, h# OR pick = # AND t - r# >= 2")},
  CASE WHEN pick >= 0 THEN t ELSE last END, hit FROM (
  SELECT *, CASE WHEN hit OR t - last < 10 THEN -1 ELSE CASE greatest({each("x#")}, -1) WHEN -1 THEN -1 WHEN x0 THEN 0 WHEN x1 THEN 1 ELSE 2 END END AS pick FROM (
   SELECT *, {each("CASE WHEN v# IS NOT NULL AND t - s# >= 5 THEN CONF * least((t - s#) / 10, 3) ELSE -1 END AS x#")} FROM (
    SELECT * REPLACE ({each("CASE WHEN h# THEN t ELSE s# END AS s#")}, CASE WHEN hit THEN t ELSE last END AS last) FROM (
     SELECT *, {each("h#", " OR ")} AS hit FROM (
      SELECT o.job_id, o.rn, CAST(o.t AS DOUBLE) AS t, {each("o.v#, s.m#, s.s#, s.r#")}, s.last, {each("coalesce(abs(o.v# - s.m#) >= LIMIT AND o.t - s.r# >= 2, false) AS h#").replace("near", "o.near")}
      FROM s JOIN o ON o.job_id = s.job_id AND o.rn = s.rn + 1))))))
SELECT job_id, {scale} AS t, sensor, CASE WHEN delta THEN 'delta' ELSE 'scheduled' END AS source FROM (SELECT job_id, t, delta, unnest([{each("CAST(# AS BIGINT)")}]) AS sensor, unnest([{each("out#")}]) AS fired FROM s WHERE rn > 0) WHERE fired"""


def frames_sql(t):
    near = "EXISTS (SELECT 1 FROM readings r WHERE r.job_id = q.job_id AND r.kind = 'purchase' AND abs(round(r.t * 1000) - round(q.t * 1000)) <= 500)"
    values = ", ".join(f"avg(value) FILTER (WHERE event_id % 3 = {k}) AS v{k}" for k in range(3))
    return f"q AS (SELECT job_id, {t} AS t, {values} FROM readings GROUP BY 1, 2), f AS (SELECT q.*, {near} AS near FROM q)"


@query("str5_trigger_bus", bus_sql(frames_sql("floor(t * 2) / 2"), "t"))
def _(v):
    from .streams import half_second_frames

    f = half_second_frames(v, ("sensor", "value", "confidence", "hint"))
    return st.trigger_bus(st.near_peaks(f, v.readings.where("kind = 'purchase'"), 1.0), 60.0)


@query("str5_trigger_bus_stream", bus_sql(frames_sql("t"), "CAST(round(t * 1000) AS BIGINT)"))
def _(v):
    def build(closing):
        r = arriving(v)
        sensor = F.col("sample_id") % 3
        frames = r.drop("kind").withColumns({"sensor": sensor, "confidence": (sensor + 1) / 4.0, "hint": F.when(sensor == 0, "health").otherwise("map")})
        peaks = r.where("kind = 'purchase'").select("job_id", "ts")
        return ru.trigger_bus_stream(closed(frames, closing), closed(peaks, closing), 60.0, window_ms=1_000, origin=ORIGIN)

    return run_closed(v.spark, build, "bus").where(F.col("job_id") != NO_JOB).withColumn("t", F.col("t") - ORIGIN)


# --- job progress ---


@query("str2_progress_feed", """
SELECT user_id AS job_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS status, arg_max(value, struct_pack(t := ts, i := event_id)) AS progress FROM events GROUP BY 1""")
def _(v):
    d = st.read_events(v.spark, v.sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)
    d = d.select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("update_id"), F.col("event_type").alias("status"), F.col("value").alias("progress"), F.col("props").alias("message"))
    path = f"{st.shared_folder(v.spark, 'progress')}/table"
    ru.progress_feed(d, path).awaitTermination()
    return v.spark.read.parquet(path).select("job_id", "status", "progress")


# --- hold and decay ---

DECAY = """
WITH RECURSIVE p AS (SELECT job_id, event_id % 2 AS sensor, CAST(round(t * 1000) AS BIGINT) // 200 AS frame, max(0.02 + (event_id % 16) / 10.0::DOUBLE) AS peak FROM readings WHERE kind = 'click' GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id, sensor ORDER BY frame) AS rn, lead(frame) OVER (PARTITION BY job_id, sensor ORDER BY frame) AS next FROM p),
w AS (SELECT job_id, sensor, rn, frame, next, peak AS w FROM o WHERE rn = 1 UNION ALL SELECT o.job_id, o.sensor, o.rn, o.frame, o.next, greatest(o.peak, w.w * exp(0 - (greatest(o.frame - 1 - w.frame - 9, 0) * (greatest(o.frame - 1 - w.frame - 9, 0) + 1) / 2) / 30.0::DOUBLE)) FROM w JOIN o ON o.job_id = w.job_id AND o.sensor = w.sensor AND o.rn = w.rn + 1),
f AS (SELECT job_id, sensor, frame AS begun, w, unnest(range(frame, least(coalesce(next, frame + 50), frame + 50))) AS frame FROM w),
x AS (SELECT job_id, sensor, frame, w * exp(0 - (greatest(frame - begun - 9, 0) * (greatest(frame - begun - 9, 0) + 1) / 2) / 30.0::DOUBLE) AS weight FROM f)
SELECT job_id, sensor, frame, round(weight, 6) AS weight FROM x WHERE weight >= 0.05"""


def peak_of(sample):
    return 0.02 + (sample % 16) / F.lit(10.0)


@query("str7_frame_weights", DECAY)
def _(v):
    frame = F.floor(F.round(F.col("t") * 1000).cast("long") / 200)
    p = v.readings.where("kind = 'click'").select("job_id", (F.col("event_id") % 2).alias("sensor"), frame.alias("frame"), peak_of(F.col("event_id")).alias("peak"))
    return ru.frame_weights(p).withColumn("weight", F.round("weight", 6))


@query("str7_frame_weights_stream", DECAY)
def _(v):
    def build(closing):
        r = arriving(v).where("kind = 'click'")
        p = r.select("job_id", (F.col("sample_id") % 2).alias("sensor"), F.timestamp_millis(F.floor((F.unix_millis("ts") - ORIGIN) / 200) + ORIGIN).alias("ts"), peak_of(F.col("sample_id")).alias("peak"))
        return ru.frame_weights(closed(p, closing, peak=0.0))

    return run_closed(v.spark, build, "weights").where(F.col("job_id") != NO_JOB).withColumns({"frame": F.col("frame") - ORIGIN, "weight": F.round("weight", 6)})
