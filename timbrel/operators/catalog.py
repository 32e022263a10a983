"""Job catalog aggregates: totals, costs, diagnostics, quality checks, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import scan, time_block
from .filters import SETTLED
from .windows import adjacent_overlaps

AXES = ("hook", "flow", "value", "trend")


def clip_diagnostics(jobs: DataFrame, clips: DataFrame) -> DataFrame:
    """How many clips of a job have a positive score per axis, legacy fills and the total."""
    g = clips.groupBy("job_id").agg(*[F.count_if(F.col(f"{a}_score") > 0).alias(a) for a in AXES], F.count_if("legacy_fill").alias("legacy_fill_count"), F.count("*").alias("total"))
    return jobs.select("job_id").join(g, "job_id", "left").fillna(0)


def dashboard_totals(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.sum(F.coalesce("clips_count", F.lit(0))).alias("total_clips"), F.count_if(~F.col("status").isin(*SETTLED)).alias("processing"))


def cost_totals(jobs: DataFrame) -> DataFrame:
    """Total cost, completed jobs and whether any provider was a free one."""
    free = F.exists(F.map_values("provider_used"), lambda p: p.contains("free") | (p == "ollama"))
    return jobs.agg(F.sum(F.coalesce("estimated_cost_usd", F.lit(0.0))).alias("total_cost"), F.count_if(F.col("status") == "complete").alias("completed"),
                    F.bool_or(F.coalesce(free, F.lit(False))).alias("has_free_tier"))


def mean_score(clips: DataFrame) -> DataFrame:
    return clips.agg(F.floor(F.coalesce(F.avg("viral_score"), F.lit(0.0)) + 0.5).alias("mean_score"))


DENSE_MARK = "[dense face tracking]"


def tracking_debug(scenes: DataFrame) -> DataFrame:
    dense = F.col("description") == DENSE_MARK
    return scenes.groupBy("job_id").agg(F.count("*").alias("total_scenes"), F.count_if(dense).alias("dense_scenes"), F.count_if(~dense).alias("vision_scenes"), F.min("subject_x").alias("min_x"),
                                        F.max("subject_x").alias("max_x"), F.count("active_speaker_x").alias("speaker_x_count"), F.countDistinct("subject_x").alias("unique_x"))


def token_cost(usage: DataFrame, rates: dict[str, float], default: float = 0.001) -> DataFrame:
    """Cost per job from tokens per provider; unknown providers use the default rate per 1000."""
    table = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    rate = F.coalesce(F.element_at(table, F.col("provider")), F.lit(default))
    return usage.groupBy("job_id").agg(F.round(F.sum(F.col("tokens") / 1000 * rate), 6).alias("cost"), F.sum("tokens").alias("tokens"))


def stage_times(runs: DataFrame) -> DataFrame:
    """Cumulative seconds per job and stage."""
    return runs.groupBy("job_id", "stage").agg(F.round(F.sum("seconds"), 2).alias("seconds"))


def warnings_per_job(notes: DataFrame) -> DataFrame:
    return notes.where(F.coalesce("message", F.lit("")) != "").groupBy("job_id").agg(F.array_sort(F.collect_set("message")).alias("warnings"))


def speaker_counts(segments: DataFrame) -> DataFrame:
    """Segments per speaker with the first position, which gives the order of appearance."""
    return segments.groupBy("job_id", "speaker").agg(F.count("*").alias("segments"), F.min("seg_idx").alias("first_idx"))


def batch_progress(exports: DataFrame) -> DataFrame:
    done, failed = F.count_if(F.col("status") == "complete"), F.count_if(F.col("status") == "failed")
    return exports.groupBy("batch_id").agg(F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"), (F.count("*") - done - failed).alias("pending"))


def _check(name: str, status: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), status.alias("status"))


def job_checks(jobs: DataFrame, segments: DataFrame, scenes: DataFrame, clips: DataFrame) -> DataFrame:
    """Quality checks of a job as rows (name, status); one aggregate per child table.

    ``jobs``: job_id, status, duration, overview, topics (count), has_summary, providers (map), seconds.
    """
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    t = segments.groupBy("job_id").agg(F.count("*").alias("n_seg"), F.sum(words).alias("n_words"), F.count_if("has_words").alias("n_timed"))
    s = scenes.groupBy("job_id").agg(F.count("*").alias("n_scene"), F.count("subject_x").alias("n_tracked"), F.bool_and(F.coalesce(F.col("subject_x") == 50, F.lit(True))).alias("centred"))
    c = clips.join(jobs.select("job_id", F.col("duration").alias("_dur")), "job_id", "left")
    bad = (F.col("start") < 0) | ((F.col("_dur") > 0) & (F.col("end") > F.col("_dur") + 1)) | (F.col("end") <= F.col("start"))
    focus = F.coalesce("clip_focus", F.lit("")) != ""
    c = c.groupBy("job_id").agg(F.count("*").alias("n_clip"), F.count_if((F.col("duration") < 5) | (F.col("duration") > 600)).alias("n_odd"), F.count_if(bad).alias("n_out"),
                                F.count_if(focus).alias("n_focus"), F.count_if(focus & F.col("focus_relevance").isNotNull()).alias("n_rated"))
    o = adjacent_overlaps(clips, ["job_id"], ["start", "clip_id"], 0.0).where(F.col("overlap") > F.col("duration") * 0.5).groupBy("job_id").agg(F.count("*").alias("n_overlap"))
    d = jobs
    for part in (t, s, c, o):
        d = d.join(part, "job_id", "left")
    d = d.fillna(0, ["n_seg", "n_words", "n_timed", "n_scene", "n_tracked", "n_clip", "n_odd", "n_out", "n_focus", "n_rated", "n_overlap"])

    def has(n: str) -> Column:
        return F.col(n) > 0

    def good(cond: Column, other: str = "warn") -> Column:
        return F.when(cond, "pass").otherwise(other)

    none = F.exists(F.map_values("providers"), lambda p: p == "none")
    complete = F.col("status") == "complete"
    found = F.array(
        _check("Job Status", good(complete, "fail")),
        _check("Transcript", F.when(~has("n_seg"), "fail").otherwise(good(F.col("n_words") > 10))),
        F.when(has("n_seg"), _check("Word Timestamps", good(has("n_timed")))),
        _check("Scene Analysis", good(has("n_scene"), "fail")),
        F.when(has("n_scene"), _check("Subject Tracking", good(has("n_tracked") & ~F.col("centred")))),
        _check("Clip Detection", F.when(has("n_clip"), "pass").when(complete, "fail").otherwise("info")),
        F.when(has("n_clip"), _check("Clip Durations", good(~has("n_odd")))),
        F.when(has("n_clip"), _check("Clip Boundaries", good(~has("n_out"), "fail"))),
        F.when(has("n_clip"), _check("Clip Overlap", good(~has("n_overlap")))),
        F.when(has("n_focus"), _check("Focus Metadata", good(F.col("n_rated") == F.col("n_focus")))),
        _check("Video Summary", good(F.col("has_summary") & (F.length(F.coalesce("overview", F.lit(""))) > 20) & (F.col("topics") >= 2))),
        _check("AI Providers", F.when(F.col("providers").isNull() | (F.size("providers") == 0), "info").otherwise(good(~none))),
        F.when(F.col("seconds") > 0, _check("Pipeline Duration", F.lit("pass"))),
    )
    return d.select("job_id", F.explode(F.array_compact(found)).alias("c")).select("job_id", "c.name", "c.status")


# Messages of the job checks.
NO_TRANSCRIPT = "No transcript — AI clip detection relies on transcript data"
NO_SCENES = "No scene analysis — visual moment detection unavailable"
NO_CLIPS = "Analysis completed but no clips found — check AI provider configuration"
NO_PROVIDER = "Some pipeline stages used no AI provider (fallback/timeout)"


def job_findings(jobs: DataFrame, segments: DataFrame, scenes: DataFrame, clips: DataFrame) -> DataFrame:
    """Warnings and errors behind the checks of job_checks(): job_id, clip_id (null: of the whole job), level, finding.

    One row per finding, so a job with many bad clips is no long row.  Rows of unknown jobs are left out.
    """
    def say(level: str, *parts: Column | str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("finding"))

    def tenths(c: Column) -> Column:
        return F.format_string("%.1f", c)

    name, start, end, length = F.concat(F.lit("Clip "), F.col("clip_id").cast("string")), F.col("start"), F.col("end"), F.col("duration")
    known = clips.join(jobs.select("job_id", F.col("duration").alias("_dur")), "job_id")
    order = ["start", "clip_id"]
    known = scan(known, ["job_id"], order, time_block("start"), nxt={"_n": F.struct("start", "clip_id")})
    shared = end - F.col("_n.start")
    found = F.array_compact(F.array(
        F.when(length < 5, say("warning", name, ": too short (", tenths(length), "s)")).when(length > 600, say("warning", name, ": too long (", tenths(length), "s)")),
        F.when(start < 0, say("error", name, ": negative start (", tenths(start), "s)")),
        F.when((F.col("_dur") > 0) & (end > F.col("_dur") + 1), say("error", name, ": end (", tenths(end), "s) exceeds video duration (", tenths(F.col("_dur")), "s)")),
        F.when(end <= start, say("error", name, ": end <= start (", tenths(start), "-", tenths(end), ")")),
        F.when(shared > length * 0.5, say("warning", "Clips ", F.col("clip_id").cast("string"), " and ", F.col("_n.clip_id").cast("string"), ": ", tenths(shared), "s overlap (>",
                                          F.bround(length * 0.5).cast("long").cast("string"), "s)")),
    ))
    of_clips = known.select("job_id", "clip_id", F.explode(found).alias("f"))

    blank = ~F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    said = segments.groupBy("job_id").agg(F.count("*").alias("_said"), F.count_if(blank).alias("_blank"))
    seen = scenes.groupBy("job_id").agg(F.count("*").alias("_seen"))
    cut = clips.groupBy("job_id").agg(F.count("*").alias("_cut"))
    d = jobs
    for part in (said, seen, cut):
        d = d.join(part, "job_id", "left")
    none = F.exists(F.map_values("providers"), lambda p: p == "none")
    found = F.array_compact(F.array(
        F.when(F.col("_blank") > 0, say("warning", F.col("_blank").cast("string"), " empty transcript segments detected")),
        F.when(F.col("_said").isNull(), say("error", NO_TRANSCRIPT)),
        F.when(F.col("_seen").isNull(), say("error", NO_SCENES)),
        F.when(F.col("_cut").isNull() & (F.col("status") == "complete"), say("error", NO_CLIPS)),
        F.when(none, say("warning", NO_PROVIDER)),
    ))
    of_jobs = d.select("job_id", F.lit(None).cast(clips.schema["clip_id"].dataType).alias("clip_id"), F.explode(found).alias("f"))
    return of_clips.unionByName(of_jobs).select("job_id", "clip_id", "f.level", "f.finding")


def job_verdict(checks: DataFrame) -> DataFrame:
    """Overall verdict and counts of a job's checks."""
    n = {s: F.count_if(F.col("status") == s) for s in ("pass", "warn", "fail")}
    overall = F.when(n["fail"] > 0, "fail").when(n["warn"] > 0, "warn").otherwise("pass")
    return checks.groupBy("job_id").agg(overall.alias("overall"), n["pass"].alias("passed"), n["warn"].alias("warned"), n["fail"].alias("failed"))
