"""Row-wise filters, projections and checks.  None of these shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETTLED = ("complete", "failed", "queued", "cancelled")
FINISHED = ("complete", "failed", "cancelled")


def any_contains(cols: Sequence[str], needle: str) -> Column:
    """Case-insensitive substring test over several text columns; null is empty."""
    q = needle.strip().lower()
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(q) for c in cols])


def clip_filter(clips: DataFrame, min_score: float = 0, min_duration: float = 0, max_duration: float = 9999) -> DataFrame:
    """Score and duration bounds; 0, 0 and 9999 switch a bound off."""
    if min_score > 0:
        clips = clips.where(F.col("viral_score") >= min_score)
    if min_duration > 0:
        clips = clips.where(F.col("duration") >= min_duration)
    if max_duration < 9999:
        clips = clips.where(F.col("duration") <= max_duration)
    return clips


def candidate_filter(clips: DataFrame, min_duration: float, max_duration: float, score_min: float = 0, score_max: float = 100,
                     focus_mode: bool = False, min_relevance: float = 0) -> DataFrame:
    """Duration window, score range and, in focus mode, a relevance floor."""
    clips = clips.where(F.col("duration").between(min_duration, max_duration))
    if score_min > 0 or score_max < 100:
        score = F.coalesce("composite", "viral_score") if focus_mode else F.col("viral_score")
        clips = clips.where(score.between(score_min, score_max))
    if focus_mode and min_relevance > 0:
        clips = clips.where(F.coalesce("focus_relevance", "viral_score") >= min_relevance)
    return clips


JOB_ORDER = {
    "newest": lambda: F.desc("created_at"), "oldest": lambda: F.asc("created_at"),
    "name": lambda: F.asc("filename"), "clips": lambda: F.desc("clips_count"),
}


def job_search(jobs: DataFrame, text: str = "", status: str = "all", sort: str = "newest") -> DataFrame:
    if text.strip():
        jobs = jobs.where(any_contains(["filename", "progress_message", "job_id"], text))
    if status == "processing":
        jobs = jobs.where(~F.col("status").isin(*SETTLED))
    elif status != "all":
        jobs = jobs.where(F.col("status") == status)
    return jobs.orderBy(JOB_ORDER[sort](), "job_id")


CLIP_ORDER = {
    "score": lambda: F.desc("viral_score"), "score_low": lambda: F.asc("viral_score"),
    "duration": lambda: F.desc("duration"), "duration_short": lambda: F.asc("duration"),
    "timestamp": lambda: F.asc("start"), "title_az": lambda: F.asc(F.coalesce("title", F.lit(""))),
}


def clip_search(clips: DataFrame, text: str = "", text_cols: Sequence[str] = ("title",), hashtags: str | None = None,
                min_score: float = 0, platform: str = "all", clip_type: str = "all", source: str = "all", sort: str = "score") -> DataFrame:
    """Library search; ``hashtags`` names an optional array column searched with any-match."""
    if min_score > 0:
        clips = clips.where(F.col("viral_score") >= min_score)
    if platform != "all":
        clips = clips.where(F.col("platform").isin(platform, "both"))
    if clip_type != "all":
        clips = clips.where(F.col("clip_type") == clip_type)
    if source != "all":
        clips = clips.where(F.col("filename") == source)
    if text.strip():
        hit = any_contains(text_cols, text)
        if hashtags:
            hit = hit | F.exists(F.coalesce(hashtags, F.array()), lambda h: F.lower(h).contains(text.strip().lower()))
        clips = clips.where(hit)
    return clips.orderBy(CLIP_ORDER[sort](), "clip_id")


def export_search(exports: DataFrame, source: str = "all", text: str = "", sort: str = "recent") -> DataFrame:
    if source != "all":
        exports = exports.where(F.col("source_filename") == source)
    if text.strip():
        exports = exports.where(any_contains(["filename", "title", "source_filename"], text))
    length = F.coalesce("duration", F.col("end") - F.col("start"), F.lit(0.0))
    title = F.coalesce("title", "filename", F.lit(""))
    order = {
        "recent": F.desc("exported_at"), "oldest": F.asc("exported_at"), "duration_long": length.desc(),
        "duration_short": length.asc(), "title_az": title.asc(), "title_za": title.desc(), "source_az": F.asc("source_filename"),
    }
    return exports.orderBy(order[sort], "clip_id") if sort in order else exports


def log_filter(logs: DataFrame, level: str = "all", text: str = "") -> DataFrame:
    if level != "all":
        logs = logs.where(F.col("level") == level)
    return logs.where(any_contains(["message"], text)) if text.strip() else logs


def transcript_filter(segments: DataFrame, start: float | None = None, end: float | None = None, text: str = "") -> DataFrame:
    """Segments overlapping a time range whose text or speaker holds the needle."""
    if start is not None and end is not None:
        segments = segments.where((F.col("start") < end) & (F.col("end") > start))
    return segments.where(any_contains(["text", "speaker"], text)) if text.strip() else segments


def media_filter(media: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    if kind not in ("all", "font"):
        media = media.where(F.col("type") == kind)
    return media.where(any_contains(["filename"], text)) if text.strip() else media


# Phrases that mark a scene description as an error placeholder.
PLACEHOLDER_PHRASES = (
    "vision skipped", "vision unavailable", "vision model crashed", "analysis skipped", "analysis failed",
    "frame analysis unavailable", "frame analysis failed", "frame not analyzed", "api key limit exceeded",
    "no description", "no analysis", "model returned no response", "model returned empty",
)


def is_placeholder_scene(description: str = "description") -> Column:
    low = F.lower(F.trim(F.coalesce(F.col(description), F.lit(""))))
    return (low == "") | low.startswith("frame at ") | low.rlike("|".join(PLACEHOLDER_PHRASES))


def job_summary(jobs: DataFrame) -> DataFrame:
    """Twelve catalog columns; the clip array is reduced to its size."""
    clips = F.size("clips").alias("clips_count") if "clips" in jobs.columns else F.col("clips_count")
    return jobs.select(
        "job_id", "filename", "duration", "status", "progress", "progress_message", "created_at", clips,
        "provider_used", "file_size_mb", "estimated_cost_usd", F.coalesce("owner_user_id", F.lit("")).alias("owner_user_id"),
    )


def active_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Unfinished jobs with whole seconds since creation; unreadable times give null."""
    made = F.try_to_timestamp(F.col("created_at").cast("string"))
    age = (F.unix_micros(now) - F.unix_micros(made)) / 1_000_000
    return jobs.where(~F.col("status").isin(*FINISHED)).withColumn("elapsed_seconds", age.cast("long"))


def unexpired(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows whose ISO expiry lies after ``now``; unreadable or missing expiry is expired."""
    return rows.where(F.try_to_timestamp(F.col(expires)) > now)


def live_links(links: DataFrame, now: Column, owner: str | None = None, job_id: str | None = None) -> DataFrame:
    live = unexpired(links, now)
    if owner is not None:
        live = live.where(F.col("created_by") == owner)
    if job_id is not None:
        live = live.where(F.col("job_id") == job_id)
    return live.orderBy(F.desc("created_at"), "token")


CROP_STRATEGIES = ("stationary", "tracking", "panning")


def confidence_floor(segments: DataFrame, floor: float = 0.50) -> DataFrame:
    """Crop strategies under the confidence floor fall back to a blurred fill."""
    low = F.col("strategy").isin(*CROP_STRATEGIES) & (F.col("confidence") < floor)
    reason = F.format_string("forced_downgrade_from_%s_at_conf_%.2f", "strategy", "confidence")
    return segments.withColumns({
        "fallback_reason": F.when(low, reason),
        "subject_x": F.when(low, 50.0).otherwise(F.col("subject_x")),
        "active_slot": F.when(~low, F.col("active_slot")),
        "layout": F.when(low, "blur_fill").otherwise(F.col("layout")),
        "strategy": F.when(low, "blur_fill").otherwise(F.col("strategy")),
    })


def framing_label(width: Column, subjects: Column, split: Column) -> Column:
    return (
        F.when(split, "SPLIT").when(subjects >= 2, "2SHOT").when(width < 0.25, "CU").when(width < 0.45, "MS").otherwise("WS")
    )


def fuse_positions(face_x: Column, face_conf: Column, model_x: Column, model_conf: Column) -> Column:
    """Blend two position estimates by confidence; returns struct(x, confidence, source)."""

    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    def pct(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))

    fc = unit(F.when(face_x.isNull(), 0.0).otherwise(face_conf))
    mc = unit(F.when(model_x.isNull(), 0.0).otherwise(model_conf))
    fx, mx = pct(F.coalesce(face_x, F.lit(0.0))), pct(F.coalesce(model_x, F.lit(50.0)))
    wf = (fc - 0.40) / 0.40
    wm = mc * (1.0 - wf)

    def out(x: Column, conf: Column, source: str) -> Column:
        return F.struct(x.alias("x"), conf.alias("confidence"), F.lit(source).alias("source"))

    return (
        F.when(fc >= 0.80, out(fx, fc, "face_high_conf"))
        .when((fc >= 0.40) & (wf + wm < 1e-6), out(fx, fc, "face_high_conf"))
        .when(fc >= 0.40, out((fx * wf + mx * wm) / (wf + wm), F.greatest(fc, mc), "blended"))
        .when(mc >= 0.30, out(mx, mc, "vlm_only"))
        .otherwise(out(F.lit(50.0), F.lit(0.0), "fallback_center"))
    )


def rename_speakers(segments: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Rewrite speaker labels by a small map given by the caller."""
    pairs = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    return segments.withColumn("speaker", F.coalesce(F.element_at(pairs, F.col("speaker")), F.col("speaker")))


def merged_names(old: Column, new: Column) -> Column:
    """Name map after a rename: new entries win."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def delete_speaker(segments: DataFrame, speaker: str, reassign_to: str | None = None) -> DataFrame:
    if reassign_to == speaker:
        raise ValueError("cannot reassign a speaker to itself")
    if reassign_to:
        return segments.withColumn("speaker", F.when(F.col("speaker") == speaker, reassign_to).otherwise(F.col("speaker")))
    return segments.where(~F.col("speaker").eqNullSafe(F.lit(speaker)))


def names_without(names: Column, speaker: str) -> Column:
    return F.map_filter(names, lambda k, v: (k != speaker) & (v != speaker))


def relabel_rows(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Set the speaker of listed (job_id, seg_idx) rows; unknown indices have no effect."""
    e = edits.groupBy("job_id", "seg_idx").agg(F.max_by("new_speaker", "edit_no").alias("new_speaker"))
    return segments.join(e, ["job_id", "seg_idx"], "left").withColumn("speaker", F.coalesce("new_speaker", "speaker")).drop("new_speaker")


def recovery_verdict(samples: Column, score: Column, off_frame: Column, awkward: Column) -> Column:
    """Crop quality verdict; null accepts the crop."""
    return (
        F.when(samples == 0, F.lit(None).cast("string"))
        .when(score < 5.0, "safety_center")
        .when((score < 7.0) & off_frame, "loose_dead_zone")
        .when((score < 7.0) & awkward, "padding")
        .when(score < 7.0, "loose_dead_zone")
    )


def violations(df: DataFrame, ids: Sequence[str], rules: Sequence[tuple[Column, str, str, Column]]) -> DataFrame:
    """One row per broken rule; a rule is (condition, type, severity, message)."""
    found = F.array(*[
        F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(level).alias("severity"), msg.alias("message")))
        for cond, kind, level, msg in rules
    ])
    return df.select(*ids, F.explode(F.array_compact(found)).alias("v")).select(*ids, "v.*")


def item_checks(items: DataFrame, ids: Sequence[str] = ("project_id", "item_id")) -> DataFrame:
    """Timing and property checks of timeline items."""
    s, e = F.col("start"), F.col("end")

    def note(text: str) -> Column:
        return F.lit(text)

    return violations(items, ids, [
        (s < 0, "invalid_timing", "error", note("negative start")),
        (e <= s, "invalid_timing", "error", note("end not after start")),
        (e - s > 86400, "invalid_timing", "warning", note("longer than 24 hours")),
        ((F.col("opacity") < 0) | (F.col("opacity") > 1), "invalid_property", "warning", note("opacity out of range")),
        ((F.col("volume") < 0) | (F.col("volume") > 5), "invalid_property", "warning", note("volume out of range")),
        ((F.col("speed") <= 0) | (F.col("speed") > 100), "invalid_property", "warning", note("speed out of range")),
    ])


def layer_order_checks(tracks: DataFrame) -> DataFrame:
    """Video tracks below overlays, overlays below subtitles, per project."""
    def edge(fn, kind):
        return fn(F.when(F.col("type") == kind, F.col("order")))

    g = tracks.groupBy("project_id").agg(
        edge(F.max, "video").alias("video_top"), edge(F.min, "overlay").alias("overlay_low"),
        edge(F.max, "overlay").alias("overlay_top"), edge(F.min, "subtitle").alias("subtitle_low"),
    )
    return violations(g, ["project_id"], [
        (F.col("video_top") >= F.col("overlay_low"), "layer_order", "warning", F.lit("video not below overlay")),
        (F.col("overlay_top") >= F.col("subtitle_low"), "layer_order", "warning", F.lit("overlay not below subtitle")),
    ])


def caption_checks(items: DataFrame, ids: Sequence[str] = ("project_id", "item_id")) -> DataFrame:
    """Caption rows: text, times, position and duration."""
    dur = F.col("end") - F.col("start")

    def outside(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 100)

    return violations(items.where(F.col("type") == "subtitle"), ids, [
        (F.col("caption").isNull(), "caption", "error", F.lit("missing text")),
        (F.col("start").isNull() | F.isnan("start"), "caption", "error", F.lit("invalid start")),
        (F.col("end").isNull() | F.isnan("end"), "caption", "error", F.lit("invalid end")),
        (F.col("start") >= F.col("end"), "caption", "error", F.lit("start not before end")),
        (outside("pos_x"), "caption", "warning", F.lit("x out of range")),
        (outside("pos_y"), "caption", "warning", F.lit("y out of range")),
        (dur < 0.1, "caption", "warning", F.lit("very short")),
        (dur > 30, "caption", "warning", F.lit("very long")),
    ])


def word_pace_checks(items: DataFrame, fps: float = 30, ids: Sequence[str] = ("project_id", "item_id")) -> DataFrame:
    """Frames available per highlighted word, and captions too short for their words."""
    words = F.size(F.filter(F.split(F.coalesce("caption", F.lit("")), r"\s+"), lambda w: w != ""))
    d = items.where(F.col("type") == "subtitle").withColumn("_n", words).where("_n > 1")
    dur = F.col("end") - F.col("start")
    per_word = dur / F.col("_n") * fps
    return violations(d, ids, [
        (per_word < 2, "word_pace", "error", F.lit("words will skip")),
        ((per_word >= 2) & (per_word < 3), "word_pace", "warning", F.lit("fast words")),
        ((dur < 0.3) & (F.col("_n") > 2), "word_pace", "warning", F.lit("too short for words")),
    ])


def caption_consistency(projects: DataFrame, items: DataFrame) -> DataFrame:
    """Project-level caption rules; ``projects`` carries settings_on, track_visible,
    segments_on and segments_off."""
    caps = items.where(F.col("type") == "subtitle").groupBy("project_id").agg(
        F.count("*").alias("_n"), F.count_if(F.trim(F.coalesce("caption", F.lit(""))) == "").alias("_empty"))
    d = projects.join(caps, "project_id", "left").fillna(0, ["_n", "_empty"])
    on, shown = F.col("settings_on"), F.col("track_visible")
    return violations(d, ["project_id"], [
        (on & (F.col("_n") == 0), "subtitle_missing_items", "warning", F.lit("no caption items")),
        (on & ~shown, "subtitle_track_hidden", "error", F.lit("caption track hidden")),
        (shown & (F.col("_n") > 0) & ~on, "subtitle_settings_off", "warning", F.lit("captions disabled")),
        (F.col("_empty") > 0, "subtitle_empty_text", "warning", F.format_string("%d empty captions", "_empty")),
        (~on & (F.col("segments_on") > 0) & (F.col("segments_off") > 0), "subtitle_mixed_segments", "info", F.lit("mixed visibility")),
    ])


def check_rollup(found: DataFrame) -> DataFrame:
    """Errors and warnings per project; valid means no error."""
    errors = F.count_if(F.col("severity") == "error")
    warnings = F.count_if(F.col("severity") == "warning")
    return found.groupBy("project_id").agg(
        errors.alias("errors"), warnings.alias("warnings"), (errors == 0).alias("valid"),
        F.format_string("%d errors, %d warnings", errors, warnings).alias("summary"))


LONG_SEGMENT, BUSY_MOTION, RACING_MOTION = 4.0, 30.0, 20.0


def layout_choice(scoreboard: Column, chaos: Column, motion: Column, genre: Column, duration: Column,
                  long_segment: float = LONG_SEGMENT, busy: float = BUSY_MOTION, racing: float = RACING_MOTION) -> Column:
    slow = genre.isin("moba", "rts")
    return (
        F.when(scoreboard, "blurfill").when(chaos | (motion > busy), "wide_zoom")
        .when(slow & (duration >= long_segment), "blurfill").when(slow, "composite")
        .when((genre == "racing") & (motion < racing), "composite").otherwise("fullscreen")
    )


# Game title patterns in match order, with short name and genre.
GAME_TITLES = (
    (r"\bteam[\s_\-\.]?fortress[\s_\-\.]?2\b", "team_fortress_2", "fps"), (r"\btf\s?2\b", "team_fortress_2", "fps"),
    (r"\bvalorant\b", "valorant", "fps"), (r"\bapex[\s_\-\.]?legends?\b", "apex_legends", "fps"), (r"\bapex\b", "apex_legends", "fps"),
    (r"\bcs\s?go\b", "cs_go", "fps"), (r"\bcs\s?2\b", "cs_2", "fps"), (r"\bcounter[\s_\-]?strike\b", "cs_go", "fps"),
    (r"\bcall[\s_\-]of[\s_\-]duty\b", "call_of_duty", "fps"), (r"\bwarzone\b", "warzone", "fps"),
    (r"\bmodern[\s_\-]warfare\b", "modern_warfare", "fps"), (r"\bovervatch\b|\boverwatch\b", "overwatch", "hero_shooter"),
    (r"\bmarvel[\s_\-]?rivals\b", "marvel_rivals", "hero_shooter"), (r"\brainbow[\s_\-]?six\b", "rainbow_six", "fps"),
    (r"\br6[\s_\-]?siege\b", "rainbow_six", "fps"), (r"\btitanfall\b", "titanfall", "fps"),
    (r"\bhalo\s?(infinite|reach|mcc|\d)?\b", "halo", "fps"), (r"\bdestiny\s?2?\b", "destiny", "fps"),
    (r"\bdoom[\s_\-]?(eternal|2016)?\b", "doom", "fps"), (r"\bbattlefield\s?\d*\b", "battlefield", "fps"),
    (r"\bescape[\s_\-]from[\s_\-]tarkov\b", "tarkov", "fps"), (r"\bfortnite\b", "fortnite", "fps"), (r"\bpubg\b", "pubg", "fps"),
    (r"\bminecraft\b", "minecraft", "sandbox"), (r"\broblox\b", "roblox", "sandbox"),
    (r"\bleague[\s_\-]of[\s_\-]legends\b", "league_of_legends", "moba"), (r"\blol\b", "league_of_legends", "moba"),
    (r"\bdota\s?2?\b", "dota_2", "moba"), (r"\brocket[\s_\-]?league\b", "rocket_league", "racing"), (r"\bforza\b", "forza", "racing"),
    (r"\bgran[\s_\-]?turismo\b", "gran_turismo", "racing"), (r"\belden[\s_\-]?ring\b", "elden_ring", "tps"),
    (r"\bdark[\s_\-]?souls\b", "dark_souls", "tps"), (r"\bgta\s?[v5]?\b", "gta_v", "tps"), (r"\bred[\s_\-]?dead\b", "red_dead", "tps"),
    (r"\bgears[\s_\-]of[\s_\-]war\b", "gears_of_war", "tps"), (r"\bsplit[\s_\-]?gate\b", "splitgate", "fps"),
)


def title_hint(filename: Column) -> Column:
    """First matching game title in a file name as struct(slug, genre); null on a miss."""
    base = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), "[_.\\-：:]", " ")
    name = F.lower(F.trim(F.regexp_replace(base, r"\s+", " ")))
    return F.coalesce(*[
        F.when(name.rlike(p), F.struct(F.lit(slug).alias("slug"), F.lit(genre).alias("genre"))) for p, slug, genre in GAME_TITLES
    ])


# Routing of content types and sub-types to clip types.
CONTENT_ROUTES = {
    "podcast": "talking_head", "vlog": "talking_head", "anime": "animation", "music_video": "music_video",
    "gaming": "gameplay", "narrative": "generic", "sports": "sports", "unknown": "generic",
}
GAME_ROUTES = {"moba": "gameplay_moba", "tps": "gameplay_tps", "racing": "gameplay_racing", "stream": "stream", "fps": "gameplay"}
SPORT_ROUTES = {"basketball": "sports_basketball", "racing": "sports_racing"}


def clip_route(profile: DataFrame) -> DataFrame:
    """Clip type of a profile by precedence: game sub-type, sport, panel or
    dialogue, animation, then stream when a face camera sits in a corner."""

    def look(table: dict[str, str], c: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c))

    base = F.coalesce(look(GAME_ROUTES, "gameplay_subtype"), look(CONTENT_ROUTES, "content_type"), F.lit("generic"))
    base = F.when((base == "sports") & F.col("sports_subtype").isNotNull(), F.coalesce(look(SPORT_ROUTES, "sports_subtype"), base)).otherwise(base)
    base = F.when(F.col("is_panel"), "multi_speaker_panel").when(F.col("is_dialogue"), "cinematic_dialogue").otherwise(base)
    animated = F.col("is_animated")
    base = (
        F.when(animated & (F.col("anime_subtype") == "action"), "animation")
        .when(animated & F.col("anime_subtype").isin("dialogue", "slice_of_life"), "animation_dialogue")
        .when(animated & base.isin("generic", "cinematic_dialogue", "talking_head"), "animation_dialogue")
        .otherwise(base)
    )
    corner = F.col("has_facecam") & ((base == "gameplay") | (F.coalesce("corner_share", F.lit(0.0)) > 0.7))
    return profile.withColumn("clip_type", F.when(corner, "stream").otherwise(base))


ASPECTS = {"16:9": 16 / 9, "9:16": 9 / 16, "1:1": 1.0, "4:5": 4 / 5}


def _crop_width(width: int, height: int, aspect: str) -> int | None:
    """Pixels of a horizontal crop, or None when the target needs none."""
    ratio = ASPECTS.get(aspect)
    if ratio is None or not width or not height or width / height - ratio <= 0.01:
        return None
    crop = int(height * ratio + 0.5)
    return crop if crop < width else None


def crop_checks(clips: DataFrame, ids: Sequence[str], width: int, height: int, aspect: str) -> DataFrame:
    """Static crop of a clip around ``subject_x`` percent (null is the centre)."""
    crop = _crop_width(width, height, aspect)
    if crop is None:
        return violations(clips.where(F.lit(False)), ids, [(F.lit(True), "tracking", "error", F.lit(""))])
    limit = width - crop
    x = F.coalesce(F.col("subject_x"), F.lit(50.0))
    pixel = F.greatest(F.lit(10.0), F.least(F.lit(90.0), F.floor(x + 0.5).cast("double"))) * float(width) / 100.0
    offset = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(limit)), pixel - crop / 2)) + 0.5)
    inside = pixel - offset
    return violations(clips, ids, [
        ((inside < 0) | (inside > crop), "tracking", "error", F.lit("subject outside crop")),
        ((offset > 0) & (offset < limit) & (F.abs(inside - crop / 2) / crop * 100 > 15), "tracking", "warning", F.lit("off centre")),
        (F.lit(ASPECTS[aspect] * height / width * 100 < 25), "tracking", "warning", F.lit("extreme aspect")),
    ])


def tracking_checks(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Range, edge and jump rules; rows carry ``prev_t`` and ``prev_x`` of the row before."""
    x = F.coalesce(F.col("subject_x"), F.lit(50.0))
    dt, dx = F.col("t") - F.col("prev_t"), F.abs(x - F.coalesce(F.col("prev_x"), F.lit(50.0)))
    return violations(rows, ids, [
        ((x < 0) | (x > 100), "tracking", "error", F.lit("x out of range")),
        ((x < 5) | (x > 95), "tracking", "warning", F.lit("near edge")),
        ((dt > 0) & (dt < 0.5) & (dx > 30), "tracking", "warning", F.lit("rapid jump")),
    ])


def face_share_in_crop(x: Column, source_ratio: float, target_ratio: float) -> Column:
    """Position of the face across the crop, 0-1; rows outside 0.2-0.8 are off centre."""
    r = source_ratio / target_ratio
    start = ((r * x - 50) / (r - 1)) / 100 * (1 - 1 / r)
    return (x / 100 - start) * r
