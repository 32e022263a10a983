"""Export shapes and writers: captions, usage, frame events, job-table change sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import index_block, numbered


def _part(seconds: Column, unit: int) -> Column:
    return F.floor(seconds / unit)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm with truncated milliseconds."""
    ms = F.floor((seconds % 1) * 1000)
    return F.format_string("%02d:%02d:%02d,%03d", _part(seconds, 3600), _part(seconds % 3600, 60), F.floor(seconds % 60), ms)


def vtt_time(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%06.3f", _part(seconds, 3600), _part(seconds % 3600, 60), seconds % 60)


def srt_rows(segments: DataFrame, include_speakers: bool = True) -> DataFrame:
    """Caption blocks; blank segments use up a number but are not printed."""
    d = numbered(segments, ["job_id"], ["seg_idx"], index_block("seg_idx"), "number")
    text = F.trim("text")
    if include_speakers:
        text = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("["), "speaker", F.lit("] "), F.trim("text"))).otherwise(text)
    span = F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")))
    return d.where(F.trim("text") != "").select("job_id", "number", span.alias("span"), text.alias("text"))


def transcript_lines(segments: DataFrame, fmt: str) -> DataFrame:
    """One printable value per segment for vtt, txt or json."""
    if fmt == "vtt":
        line = F.concat(vtt_time(F.col("start")), F.lit(" --> "), vtt_time(F.col("end")), F.lit("\n"), "speaker", F.lit(": "), "text", F.lit("\n"))
    elif fmt == "txt":
        line = F.concat(F.lit("["), "speaker", F.lit("] "), "text")
    elif fmt == "json":
        line = F.to_json(F.struct("start", "end", "text", "speaker"))
    else:
        raise ValueError(f"unknown format: {fmt}")
    return segments.select("job_id", "seg_idx", line.alias("line"))


def write_text(lines: DataFrame, path: str, order: str) -> None:
    """One directory per job, lines in order; rows are range-partitioned so a long job is split over files."""
    cols = ["job_id", order]
    lines.repartitionByRange(*cols).sortWithinPartitions(*cols).select("job_id", "line").write.mode("overwrite").partitionBy("job_id").text(path)


def usage_rows(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "filename", F.to_json(F.coalesce("provider_used", F.create_map().cast("map<string,string>"))).alias("provider"),
                       "status", F.coalesce("estimated_cost_usd", F.lit(0.0)).alias("cost_usd"))


def write_usage(jobs: DataFrame, path: str) -> None:
    usage_rows(jobs).write.mode("overwrite").option("header", True).csv(path)


def frame_rows(ops: DataFrame, fps: float, carry: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """One row per frame of each interval; the first frame of an interval is a scene change."""
    first = F.bround(F.col(start) * fps).cast("long")
    last = F.bround(F.col(end) * fps).cast("long")
    d = ops.withColumns({"_first": first, "_last": last}).where("_last > _first")
    d = d.withColumn("frame", F.explode(F.sequence(F.col("_first"), F.col("_last") - 1)))
    return d.select(*carry, "frame", (F.col("frame") / fps).alias("t"), (F.col("frame") == F.col("_first")).alias("scene_change"))


def plan_events(ops: DataFrame, fps: float, ids: list[str]) -> DataFrame:
    """Frame events of a render plan whose boxes are 0-1 with the corner as origin."""
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    w, h = F.coalesce("w", F.lit(9 / 16)), F.coalesce("h", F.lit(1.0))
    d = ops.withColumns({"crop_cx": x + w / 2, "crop_cy": y + h / 2, "crop_w": w, "crop_h": h})
    return frame_rows(d, fps, [*ids, "crop_cx", "crop_cy", "crop_w", "crop_h"])


def segment_events(segments: DataFrame, fps: float, ids: list[str], width: int, height: int, aspect: float = 9 / 16) -> DataFrame:
    """Frame events of reframe segments whose subject is in source pixels; 0 and null mean the centre."""

    def unit(c: str, size: int) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, size / 2).otherwise(F.col(c)) / size

    d = segments.withColumns({"crop_cx": unit("subject_x", width), "crop_cy": unit("subject_y", height),
                              "crop_w": F.lit(height * aspect / width), "crop_h": F.lit(1.0)})
    return frame_rows(d, fps, [*ids, "crop_cx", "crop_cy", "crop_w", "crop_h"])


# Report groups by target clip type, in print order.
REPORT_GROUPS = (
    ("panels", ("multi_speaker_panel",)), ("anime", ("animation", "animation_dialogue")),
    ("sports", ("sports", "sports_basketball", "sports_racing")), ("music", ("music_video",)),
)
REPORT_TOOLS = ("baseline", "candidate", "ground_truth")


def report_rows(clips: DataFrame, metrics: DataFrame, tools: tuple[str, ...] = REPORT_TOOLS) -> DataFrame:
    """Report lines: every grouped clip times every tool, SKIPPED where a tool has no result."""
    group = F.lit(None).cast("string")
    rank = F.lit(None).cast("int")
    for i, (name, kinds) in enumerate(REPORT_GROUPS):
        hit = F.col("target_type").isin(*kinds)
        group, rank = F.when(hit, name).otherwise(group), F.when(hit, i).otherwise(rank)
    d = clips.select("slug", group.alias("group"), rank.alias("group_no"), F.posexplode(F.array(*map(F.lit, tools))).alias("tool_no", "tool"))
    d = d.where("group IS NOT NULL").join(metrics, ["slug", "tool"], "left")
    text = F.coalesce(F.format_number("median_hold", 2), F.lit("-"))
    return d.select("group", "group_no", "slug", "tool_no", "tool", text.alias("median"), F.coalesce("verdict", F.lit("SKIPPED")).alias("verdict"))


def latest_versions(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert of whole rows: the newest version per key wins, changes beat the base on a tie."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    cols = [c for c in base.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(version), F.col("_new"))).alias("r"))
    return best.select(key, "r.*").select(*base.columns)


def apply_updates(base: DataFrame, updates: DataFrame, key: str, stamp: Column, stamp_col: str = "updated_at") -> DataFrame:
    """Column-wise update: known, non-null columns of ``updates`` replace those of ``base``."""
    cols = [c for c in updates.columns if c in base.columns and c != key]
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols], F.lit(True).alias("_hit"))
    d = base.join(u, key, "left")
    d = d.withColumns({c: F.coalesce(f"_u_{c}", c) for c in cols})
    d = d.withColumn(stamp_col, F.when(F.col("_hit"), stamp).otherwise(F.col(stamp_col)))
    return d.select(*base.columns)


def delete_keys(base: DataFrame, doomed: DataFrame, key: str, protected: tuple[str, ...] = ("_library",)) -> DataFrame:
    return base.join(doomed.where(~F.col(key).isin(*protected)).select(key).distinct(), key, "left_anti")


def edit_segments(segments: DataFrame, updates: DataFrame, deletes: DataFrame, inserts: DataFrame) -> DataFrame:
    """Change set over transcripts: update, delete, insert by start time, renumber.

    An inserted row goes after rows with an equal start, as do later inserts.
    """
    keys = ["job_id", "seg_idx"]
    fields = ["start", "end", "text", "speaker"]
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in fields])
    d = segments.select(*keys, *fields).join(u, keys, "left")
    d = d.select(*keys, *[F.coalesce(f"_u_{c}", c).alias(c) for c in fields]).join(deletes.select(*keys), keys, "left_anti")
    new = inserts.select("job_id", (F.lit(1 << 40) + F.col("insert_no")).alias("seg_idx"), *fields)
    both = d.unionByName(new)
    out = numbered(both, ["job_id"], ["start", "seg_idx"], F.floor(F.col("start") / 60), "_n")
    return out.select("job_id", (F.col("_n") - 1).alias("seg_idx"), *fields)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_partitions(changes: DataFrame, path: str, key: str, version: str, buckets: int = 64) -> None:
    """Merge changed rows into a table partitioned by key hash; only touched partitions are rewritten.

    The list of touched partitions is at most ``buckets`` numbers.
    """
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = changes.withColumn("bucket", bucket)
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]
    if not touched:
        return
    try:
        base = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
    except Exception as e:  # the analysis error of a table that does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        base = new.limit(0)
    merged = latest_versions(base.select(new.columns), new, key, version)
    overwrite_partitions(merged, path, "bucket")
