"""Input views derived from the provided star-schema tables.

The operators work on timed-media tables (segments, words, scenes, faces,
clips, ...).  Each view maps one provided table to that shape with row-wise
expressions, so a view grows with its table and costs one column-pruned scan.
The expressions are plain SQL shared with the check queries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import index_block, scan

ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z, first day of the events table


@dataclass(frozen=True)
class View:
    """A row-wise view: source table or view, output columns, row filter."""

    source: str
    columns: dict[str, str]
    where: str = "true"


# events run over 30 days; times are compressed so that one job spans about 72
# minutes (moments) or about two minutes (readings) of media time.
_T = "CAST(floor((EPOCH_US(ts) - 1704067200000000) / 600000) AS DOUBLE) / 1000"
_FAST = "CAST(floor((EPOCH_US(ts) - 1704067200000000) / 20000000) AS DOUBLE) / 1000"

VIEWS: dict[str, View] = {
    "moments": View("events", {
        "job_id": "user_id", "event_id": "event_id", "t": _T, "kind": "event_type", "value": "value",
    }),
    "readings": View("events", {
        "job_id": "user_id", "event_id": "event_id", "t": _FAST, "kind": "event_type", "value": "value",
    }),
    "scenes": View("moments", {
        "job_id": "job_id", "scene_id": "event_id", "t": "t",
        "importance": "1 + CAST(floor(value) AS BIGINT) % 10",
        "subject_x": "CAST(floor(value * 7) AS BIGINT) % 101",
        "description": "CASE event_id % 7 WHEN 0 THEN 'Frame at ' || CAST(event_id AS STRING) WHEN 1 THEN '  ' "
                       "WHEN 2 THEN 'Model returned no response' ELSE 'View ' || CAST(event_id % 11 AS STRING) END",
    }, "kind = 'view'"),
    "audio_moments": View("moments", {
        "job_id": "job_id", "moment_id": "event_id", "t": "t",
        "loudness_db": "-60 + CAST(floor(value) AS BIGINT) % 60",
        "delta_db": "CAST(floor(value * 3) AS BIGINT) % 31 - 10",
        "kind": "CASE kind WHEN 'click' THEN 'spike' WHEN 'error' THEN 'loud_moment' ELSE 'silence_to_loud' END",
    }, "kind IN ('click', 'error', 'purchase')"),
    "rms": View("readings", {
        "job_id": "job_id", "rms_id": "event_id", "t": "t",
        "rms_db": "-70 + CAST(floor(value * 2) AS BIGINT) % 70",
    }),
    "faces": View("lineitem", {
        "job_id": "l_suppkey", "t": "l_quantity", "slot_id": "CAST(l_linenumber AS BIGINT)",
        "face_key": "(l_orderkey * 100 + l_linenumber) * 100000000 + CAST(floor(l_extendedprice) AS BIGINT)",
        "x": "CAST(l_partkey % 101 AS DOUBLE)", "y": "CAST(l_orderkey % 101 AS DOUBLE)",
        "w": "2.0 + CAST(l_orderkey % 17 AS DOUBLE)", "h": "3.0 + CAST(l_partkey % 13 AS DOUBLE)",
        "confidence": "CAST(l_orderkey % 100 AS DOUBLE) / 100.0",
        "lip": "CAST(l_partkey % 50 AS DOUBLE) / 1000.0",
        "class_name": "CASE l_orderkey % 9 WHEN 0 THEN 'sports ball' WHEN 1 THEN 'car' WHEN 2 THEN 'truck' ELSE 'person' END",
    }),
    "clips": View("orders", {
        "job_id": "o_custkey", "clip_id": "o_orderkey",
        "title": "o_orderpriority || ' ' || o_orderstatus",
        "start": "CAST((o_orderkey * 37) % 240 AS DOUBLE)",
        "end": "CAST((o_orderkey * 37) % 240 + 12 + CAST(floor(o_totalprice) AS BIGINT) % 70 AS DOUBLE)",
        "duration": "CAST(12 + CAST(floor(o_totalprice) AS BIGINT) % 70 AS DOUBLE)",
        "viral_score": "1 + CAST(floor(o_totalprice) AS BIGINT) % 100",
        "hook_score": "CAST(floor(o_totalprice / 3) AS BIGINT) % 101 * (CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END)",
        "flow_score": "CAST(floor(o_totalprice / 7) AS BIGINT) % 101 * (CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END)",
        "value_score": "CAST(floor(o_totalprice / 11) AS BIGINT) % 101 * (CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END)",
        "trend_score": "CAST(floor(o_totalprice / 13) AS BIGINT) % 101 * (CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END)",
        "platform": "CASE o_orderkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'reels' ELSE 'shorts' END",
        "clip_type": "CASE o_orderkey % 4 WHEN 0 THEN 'story' WHEN 1 THEN 'tip' WHEN 2 THEN 'joke' ELSE 'quote' END",
        "clip_focus": "CASE WHEN o_orderkey % 5 < 2 THEN NULL WHEN o_orderkey % 5 = 2 THEN 'music' ELSE 'talk' END",
        "focus_relevance": "CASE WHEN o_orderkey % 5 < 2 OR o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey * 13) % 101 END",
        "composite": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey * 29) % 101 END",
        "speed": "CASE o_orderkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 ELSE 2.0 END",
    }),
    "jobs": View("customer", {
        "job_id": "'job-' || CAST(c_custkey AS STRING)",
        "job_no": "c_custkey",
        "filename": "c_name || CASE c_custkey % 8 WHEN 0 THEN '_apex_legends.mp4' WHEN 1 THEN '-minecraft.day.mov' "
                    "WHEN 2 THEN ' rocket league.mkv' WHEN 3 THEN ' DOTA2 final.mp4' ELSE '.mp4' END",
        "status": "CASE c_custkey % 6 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' "
                  "WHEN 3 THEN 'cancelled' WHEN 4 THEN 'transcribing' ELSE 'analyzing' END",
        "progress_message": "'Stage ' || c_mktsegment",
        "created_s": "1704067200 + c_custkey * 2220",
        "owner_user_id": "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'u' || CAST(c_nationkey AS STRING) END",
        "owner_username": "CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'User' || CAST(c_nationkey AS STRING) "
                          "ELSE 'USER' || CAST(c_nationkey AS STRING) END",
        "duration": "CAST(60 + c_custkey % 3600 AS DOUBLE)",
        "file_size_mb": "CAST(c_custkey % 500 AS DOUBLE)",
        "cost": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 40 AS DOUBLE) / 8 END",
        "provider": "CASE c_custkey % 4 WHEN 0 THEN 'ollama' WHEN 1 THEN 'hosted:free' WHEN 2 THEN 'hosted' ELSE NULL END",
        "clips_count": "c_custkey % 12",
    }),
    "calls": View("events", {
        "provider": "user_id % 5", "call_id": "event_id", "t": "CAST(EPOCH_US(ts) - 1704067200000000 AS DOUBLE) / 1000000",
        "failed": "event_type = 'error'",
    }),
    "items": View("lineitem", {
        "project_id": "l_suppkey", "item_id": "(l_orderkey * 100 + l_linenumber) * 100000000 + CAST(floor(l_extendedprice) AS BIGINT)",
        "track_no": "CAST(l_linenumber AS BIGINT)",
        "type": "CASE l_orderkey % 4 WHEN 0 THEN 'subtitle' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'text' END",
        "start": "CAST(l_partkey % 200 AS DOUBLE) - CASE WHEN l_orderkey % 50 = 0 THEN 300 ELSE 0 END",
        "end": "CAST(l_partkey % 200 AS DOUBLE) - CASE WHEN l_orderkey % 50 = 0 THEN 300 ELSE 0 END + (l_quantity - 3) / 4",
        "opacity": "l_discount * 12", "volume": "l_tax * 80", "speed": "(l_discount - 0.01) * 200",
        "caption": "CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 11 = 1 THEN '  ' "
                   "ELSE 'caption ' || l_returnflag || ' of ' || l_linestatus END",
        "pos_x": "l_discount * 1500", "pos_y": "l_tax * 1500",
    }),
    "turns": View("segments", {
        "job_id": "job_id", "turn_id": "seg_idx",
        "t_start": "start + 0.5 * (seg_idx % 3)", "t_end": "\"end\" + 0.3 * (seg_idx % 2)",
        "cluster_id": "(seg_idx * 7) % 3", "turn_conf": "CAST((n_words * 11 + seg_idx * 5) % 100 AS DOUBLE) / 100.0",
    }),
    "speaker_events": View("segments", {
        "job_id": "job_id", "event_id": "seg_idx", "start": "start", "end": "\"end\"",
        "slot_id": "CASE speaker WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END",
        "confidence": "CAST((n_words * 7 + seg_idx * 13) % 100 AS DOUBLE) / 100.0",
    }),
    "crop_segments": View("lineitem", {
        "job_id": "l_suppkey", "seg_key": "(l_orderkey * 100 + l_linenumber) * 100000000 + CAST(floor(l_extendedprice) AS BIGINT)",
        "start": "CAST((l_partkey * 13) % 600 AS DOUBLE)", "end": "CAST((l_partkey * 13) % 600 AS DOUBLE) + l_quantity / 8",
        "subject_x": "CAST(l_partkey % 101 AS DOUBLE)", "active_slot": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END",
        "strategy": "CASE l_orderkey % 4 WHEN 0 THEN 'stationary' WHEN 1 THEN 'tracking' WHEN 2 THEN 'panning' ELSE 'blur_fill' END",
        "layout": "CASE l_orderkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'split' ELSE 'wide' END",
        "confidence": "CAST(l_orderkey % 100 AS DOUBLE) / 100.0",
    }),
}

SEGMENT_GAPS = (0.2, 0.8, 2.0, 6.0)  # silence after a turn, by turn number modulo 4

SEGMENTS_SQL = r"""
SELECT job_id, seg_idx, speaker, text, n_words, start10 / 10.0 AS start, (start10 + 4 * n_words) / 10.0 AS "end",
       CAST((n_words * 3 + seg_idx * 17) % 100 AS DOUBLE) / 100.0 AS confidence, toks
FROM (SELECT *, CAST(coalesce(sum(4 * n_words + CASE seg_idx % 4 WHEN 0 THEN 2 WHEN 1 THEN 8 WHEN 2 THEN 20 ELSE 60 END)
        OVER (PARTITION BY job_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start10
      FROM (SELECT conv_id AS job_id, turn AS seg_idx, role AS speaker, text,
                   list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS toks,
                   CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words
            FROM conversations))
"""

WORDS_SQL = """
SELECT job_id, seg_idx, speaker, word_idx, toks[word_idx + 1] AS word,
       (CAST(round(start * 10) AS BIGINT) + 4 * word_idx) / 10.0 AS start,
       (CAST(round(start * 10) AS BIGINT) + 4 * word_idx + 4) / 10.0 AS "end"
FROM (SELECT *, unnest(range(n_words)) AS word_idx FROM segments)
"""


class Inputs:
    """The provided tables and the derived views as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "events":
            df = df.withColumn("ts", F.col("ts").cast("timestamp"))
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        spec = VIEWS.get(name)
        if spec is None:
            return self.table(name)
        cols = [f"{e} AS `{n}`" for n, e in spec.columns.items()]
        return getattr(self, spec.source).where(spec.where).selectExpr(*[_spark_sql(c) for c in cols])

    @cached_property
    def segments(self) -> DataFrame:
        """Turns as timed segments: 0.4 s per token, then a pause by turn number."""
        return segments_from_turns(self.table("conversations"))

    @cached_property
    def words(self) -> DataFrame:
        return words_of(self.segments)


def _spark_sql(expr: str) -> str:
    return expr.replace("EPOCH_US(ts)", "unix_micros(ts)").replace('"end"', "`end`")


def segments_from_turns(turns: DataFrame) -> DataFrame:
    d = turns.select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text",
        F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("toks"),
    ).withColumn("n_words", F.size("toks").cast("long"))
    pause = F.element_at(F.array(*[F.lit(round(g * 10)) for g in SEGMENT_GAPS]), (F.col("seg_idx") % 4 + 1).cast("int"))
    d = d.withColumn("_len", 4 * F.col("n_words") + pause)
    d = scan(d, ["job_id"], ["seg_idx"], index_block("seg_idx"), total={"_upto": F.col("_len")})
    start10 = F.col("_upto") - F.col("_len")
    return d.select(
        "job_id", "seg_idx", "speaker", "text", "n_words",
        (start10 / 10.0).alias("start"), ((start10 + 4 * F.col("n_words")) / 10.0).alias("end"),
        (((F.col("n_words") * 3 + F.col("seg_idx") * 17) % 100).cast("double") / 100.0).alias("confidence"), "toks",
    )


def words_of(segments: DataFrame) -> DataFrame:
    d = segments.select("job_id", "seg_idx", "speaker", "start", F.posexplode("toks").alias("word_idx", "word"))
    at = F.round(F.col("start") * 10).cast("long") + 4 * F.col("word_idx")
    return d.select(
        "job_id", "seg_idx", "speaker", F.col("word_idx").cast("long").alias("word_idx"), "word",
        (at / 10.0).alias("start"), ((at + 4) / 10.0).alias("end"),
    )
