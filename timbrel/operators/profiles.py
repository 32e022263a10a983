"""Content profile of a job, crop confidence, bench summaries and text summary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import cut_lineage, fold_sorted, index_block, numbered, pick_ranks, scan
from ..functions.ranges import overlap_pairs, points_in
from .faces import slot_motion
from .fingerprints import met_blocks, unpacked
from .joins import crop_pass_rate
from .metrics import share

# Content types in tie order, and description words by topic.
TYPES = ("narrative", "podcast", "gaming", "vlog", "sports", "music_video", "anime")
TOPIC_WORDS = {
    "narrative": ("character", "scene", "dialogue", "close-up", "wide shot", "reaction", "emotion", "dramatic", "cinematic"),
    "gaming": ("gameplay", "hud", "health", "ammo", "minimap", "crosshair", "score", "kill", "game", "level"),
    "sports": ("field", "court", "goal", "score", "referee", "player", "stadium", "match", "team"),
    "music": ("music", "concert", "performance", "stage", "dancing", "singer", "band", "microphone", "audience"),
    "anime": ("anime", "animation", "animated", "cartoon", "manga", "subtitles", "japanese"),
}


def content_features(jobs: DataFrame, cuts: DataFrame, frames: DataFrame, slots: DataFrame, scenes: DataFrame, segments: DataFrame) -> DataFrame:
    """One feature row per job; every source is one aggregate.

    ``jobs``: job_id, duration, width, height, total_frames; ``frames``: job_id, t,
    n_faces, mean_x (null without faces); words are looked up in the first 50 scenes.
    """
    c = cuts.groupBy("job_id").agg(F.count("*").alias("n_cuts"))
    has = F.col("n_faces") > 0
    f = frames.groupBy("job_id").agg(F.count("*").alias("n_frames"), F.avg(F.when(has, F.col("n_faces"))).alias("avg_faces"), share(~has).alias("zero_share"),
                                     F.avg(F.when(has, (F.col("n_faces") >= 2).cast("double"))).alias("multi_share"), F.count("mean_x").alias("n_x"), F.stddev_pop("mean_x").alias("x_std"))
    s = slots.groupBy("job_id").agg(F.count("*").alias("n_slots"), F.max("frame_count").alias("top_frames"), F.sum("frame_count").alias("slot_frames"), F.avg(F.col("x_max") - F.col("x_min")).alias("avg_range"))
    s = s.join(slot_motion(slots), "job_id")
    head = scenes.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy("t", "scene_id"))).where("_r <= 50").withColumn("_d", F.lower(F.coalesce("description", F.lit(""))))
    hits = {k: reduce(lambda a, b: a + b, [F.max(F.col("_d").contains(w).cast("int")) for w in ws]).alias(f"{k}_hits") for k, ws in TOPIC_WORDS.items()}
    d = head.groupBy("job_id").agg(*hits.values())
    talk = segments.where("start < 120").groupBy("job_id").agg(F.sum(F.greatest(F.lit(0.0), F.least("end", F.lit(120.0)) - F.col("start"))).alias("speech"))
    out = jobs
    for part in (c, f, s, d, talk):
        out = out.join(part, "job_id", "left")
    return out.fillna(0, ["n_cuts", "n_frames", "n_x", "n_slots", *[f"{k}_hits" for k in TOPIC_WORDS]]).fillna(0.0, ["speech"])


def classify_content(features: DataFrame) -> DataFrame:
    """Content type, confidence and flags from additive scores per type.

    A text-driven winner yields to a geometry-driven one less than a point
    behind; weak winners are unknown; a seated panel adds to podcast and the
    winner is taken again.
    """
    rate = F.col("n_cuts") / (F.col("duration") / 60.0)
    faces = F.coalesce("avg_faces", F.lit(0.0))
    zero = F.when(F.col("avg_faces").isNotNull(), F.col("zero_share")).otherwise(0.0)
    std = F.when((F.col("n_frames") >= 10) & (F.col("n_x") >= 5), F.col("x_std"))
    top = F.col("top_frames") / F.greatest(F.lit(1), F.col("total_frames"))
    seats = (F.col("n_slots") >= 2) & (top < 0.8) & (F.col("avg_range") < 15)
    single = ~seats & (F.col("n_slots") == 1) & (F.col("avg_range") < 10)
    drifting = (F.col("n_slots") > 0) & ~seats & ~single & F.coalesce("continuous_motion", F.lit(False))
    strong = (F.col("anime_hits") >= 5) & (faces < 1.5)
    add = {
        "podcast": [(rate <= 2, 3.0), (faces >= 2.0, 2.5), (seats, 3.0), (std < 3, 1.0)],
        "narrative": [(rate >= 10, 2.0), ((rate > 2) & (rate < 10), 1.0), (faces >= 2.0, 1.0), ((faces >= 1.0) & (faces < 2.0), 0.5), (drifting, 1.0),
                      ((F.col("height") > 0) & (F.col("width") > 0) & (F.col("width") / F.col("height") >= 2.2), 3.0), (F.col("narrative_hits") >= 3, 2.0)],
        "anime": [((F.col("anime_hits") >= 2) & strong, 5.0), ((F.col("anime_hits") >= 2) & ~strong, 1.0)],
        "sports": [(rate >= 10, 2.5), ((rate > 2) & (rate < 10), 1.0), (zero > 0.5, 1.5), (F.col("sports_hits") >= 2, 2.5), (std >= 15, 0.5), ((zero > 0.40) & (std > 12) & (rate >= 8), 3.0)],
        "vlog": [((rate > 2) & (rate < 10), 1.5), ((faces >= 1.0) & (faces < 2.0), 1.5), (single, 1.5), (drifting, 1.0), ((std >= 8) & (std < 15), 0.5)],
        "gaming": [(rate <= 2, 2.0), (zero > 0.5, 2.0), (F.col("gaming_hits") >= 2, 3.0)],
        "music_video": [(rate >= 40, 3.0), ((rate >= 20) & (rate < 40), 1.5), (F.col("music_hits") >= 2, 3.0)],
    }
    d = features.withColumns({f"s_{t}": reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, w in rules]) for t, rules in add.items()})
    d = d.withColumns({"cut_rate": rate, "_strong": strong & (F.col("anime_hits") >= 2), "x_spread": std})

    def winner(names: tuple[str, ...], bonus: Column | None = None) -> Column:
        return F.array_max(F.array(*[F.struct((F.col(f"s_{t}") + (bonus if bonus is not None and t == "podcast" else F.lit(0.0))).alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(names)]))

    total = reduce(lambda a, b: a + b, [F.col(f"s_{t}") for t in TYPES])
    d = d.withColumns({"_w": winner(TYPES), "_g": winner(tuple(t for t in TYPES if t not in ("anime", "music_video"))), "_total": total})
    yields = F.col("_w.t").isin("anime", "music_video") & ~F.col("_strong") & (F.col("_w.s") - F.col("_g.s") < 1.0)
    d = d.withColumn("_b", F.when(yields, F.col("_g")).otherwise(F.col("_w")))
    conf = F.when(F.col("_total") > 0, F.col("_b.s") / F.col("_total")).otherwise(0.0)
    weak = (conf < 0.25) | (F.col("_b.s") < 2.0)
    d = d.withColumns({"content_type": F.when(weak, "unknown").otherwise(F.col("_b.t")), "confidence": F.when(weak, conf).otherwise(F.least(F.lit(1.0), conf))})
    d = d.withColumns({
        "is_dialogue": (F.col("content_type") == "narrative") & (F.col("n_slots") >= 2) & (F.col("speech") >= 30.0),
        "is_animated": (F.col("content_type") == "anime") | (F.col("anime_hits") >= 3),
        "is_panel": F.coalesce(F.col("n_slots").between(2, 5) & (faces >= 1.5) & (F.col("multi_share") >= 0.25) & (F.col("slot_frames") > 0) & (F.col("avg_range") < 20) & (F.col("top_frames") / F.col("slot_frames") < 0.6), F.lit(False)),
    })
    d = d.withColumn("_p", winner(TYPES, F.lit(4.0)))
    again = F.col("_p.s") / (F.col("_total") + 4.0)
    take = F.col("is_panel") & (again >= 0.25) & (F.col("_p.s") >= 2.0)
    known = F.col("duration") > 0
    return d.select(
        "job_id", F.when(~known, "unknown").when(take, F.col("_p.t")).otherwise(F.col("content_type")).alias("content_type"), F.when(~known, 0.0).when(take, F.least(F.lit(1.0), again)).otherwise(F.col("confidence")).alias("confidence"),
        "cut_rate", "is_dialogue", "is_animated", "is_panel", *[f"s_{t}" for t in TYPES])


# Weights of lip and voice agreement when voice turns exist, by content type.
VOTE_WEIGHTS = {
    "multi_speaker_panel": (0.12, 0.13), "podcast": (0.14, 0.11), "narrative": (0.17, 0.08), "vlog": (0.18, 0.07), "anime": (0.12, 0.13), "animation_dialogue": (0.12, 0.13),
    "gaming": (0.15, 0.10), "music_video": (0.18, 0.07), "sports": (0.15, 0.10), "sports_basketball": (0.15, 0.10), "sports_racing": (0.15, 0.10), "unknown": (0.15, 0.10),
}


def crop_confidence(shots: DataFrame, faces: DataFrame, events: DataFrame, segments: DataFrame, mapping: DataFrame, shot_id: str, crop_pct: float,
                    turns: DataFrame | None = None, content_type: str = "unknown") -> DataFrame:
    """Confidence that a crop around ``subject_x`` holds the subject: faces in the crop, speaker
    agreement, voice agreement, stability and transcript coverage.

    ``turns`` (job_id, r_start, r_end, slot_id) are voice turns already mapped to slots.
    """
    key = ["job_id", shot_id]
    left = F.greatest(F.lit(0.0), F.least(F.col("subject_x") - crop_pct / 2, F.lit(100.0 - crop_pct)))
    iv = shots.select(*key, "start", "end", F.col("active_slot").alias("_slot"), left.alias("_left"))
    inside = F.col("x").between(F.col("_left"), F.col("_left") + crop_pct)
    weight = F.when(F.col("slot_id") >= 0, 1.0).otherwise(0.2) * F.greatest(F.lit(0.25), F.least(F.lit(2.0), F.col("w") * F.col("h") / 100))
    mine = F.col("slot_id") == F.col("_slot")
    f = points_in(faces.select("job_id", "t", "x", "w", "h", "slot_id"), iv, ["job_id"], 10.0).groupBy(*key).agg(
        (F.sum(F.when(inside, weight).otherwise(0.0)) / F.sum(weight)).alias("_ratio"), F.bool_or(mine & inside).alias("_mine_in"), F.count_if(mine).alias("_n"), F.stddev_pop(F.when(mine, F.col("x"))).alias("_sd"))

    def agreed(spans: DataFrame, name: str) -> DataFrame:
        length = F.least("end", "r_end") - F.greatest("start", "r_start")
        g = overlap_pairs(iv, spans, ["job_id"], 30.0).groupBy(*key)
        return g.agg((F.sum(F.when(F.col("slot_id") == F.col("_slot"), length).otherwise(0.0)) / F.sum(length)).alias(name), F.bool_or(F.col("slot_id") == F.col("_slot")).alias(f"{name}_any"))

    ev = agreed(events.select("job_id", F.col("slot_id").cast("long").alias("slot_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end")), "_lip")
    seg = segments.join(mapping.select("job_id", "speaker"), ["job_id", "speaker"], "left_semi").select("job_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    cover = overlap_pairs(iv, seg, ["job_id"], 30.0).groupBy(*key).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("_cov"))
    d = iv.join(f, key, "left").join(ev, key, "left").join(cover, key, "left")
    lip, voice = VOTE_WEIGHTS.get(content_type, VOTE_WEIGHTS["unknown"]) if turns is not None else (0.20, 0.0)
    if turns is not None:
        d = d.join(agreed(turns, "_voice"), key, "left")
    fits = F.coalesce((F.col("_lip_any") & F.col("_mine_in")) | (F.col("_ratio") >= 0.30), F.lit(False))
    known = F.col("_slot").isNotNull()
    steady = F.when(~known, 0.0).when(F.coalesce("_n", F.lit(0)) < 2, 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("_sd") / 30.0))
    flag = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    total = F.lit(0.40) + flag(known & (F.col("_lip") >= 0.5), lip) + 0.20 * steady + flag(F.col("_cov") / (F.col("end") - F.col("start")) >= 0.3, 0.20)
    if turns is not None:
        total = total + flag(known & (F.col("_voice") >= 0.5), voice)
    return d.select(*key, F.when(fits, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).otherwise(0.0).alias("confidence"), fits.alias("face_in_crop"), steady.alias("stability"))


def centre_lock(path: DataFrame, sure: float = 0.6, lock: float = 5.0, drift: float = 10.0) -> DataFrame:
    """Share of unsure samples near the centre and the number far from it."""
    d = path.withColumn("_u", F.col("confidence") < sure).withColumn("_off", F.abs(F.coalesce("x", F.lit(0.0)) - 50.0))
    near, n = F.count_if(F.col("_u") & (F.col("_off") <= lock)), F.count_if("_u")
    return d.groupBy("job_id").agg(F.round(F.when(n > 0, near / n).otherwise(1.0), 3).alias("center_lock"), F.count_if(F.col("_u") & (F.col("_off") > drift)).alias("drift_events"), n.alias("n_uncertain"))


def layout_shares(segments: DataFrame) -> DataFrame:
    """Share of segments per layout; an empty layout is "unset"."""
    mode = F.when(F.coalesce("layout", F.lit("")) == "", "unset").otherwise(F.col("layout"))
    n = segments.groupBy("job_id", mode.alias("layout")).agg(F.count("*").alias("_n"))
    total = n.groupBy("job_id").agg(F.sum("_n").alias("_t"))
    return n.join(total, "job_id").select("job_id", "layout", F.round(F.col("_n") / F.col("_t"), 3).alias("share"))


def metric_means(metrics: DataFrame) -> DataFrame:
    """Mean of every metric over the fixtures of a run that have it."""
    return metrics.where("value IS NOT NULL").groupBy("run", "metric").agg(F.avg("value").alias("mean"))


def animated_summary(shots: DataFrame, faces: DataFrame, frames: DataFrame, shot_id: str) -> DataFrame:
    """Share of frames with faces, of tracking shots, and the face-to-crop error after the
    mean offset of each shot is taken out (mean and p95 by index)."""
    key = ["job_id", shot_id]
    dense = frames.groupBy("job_id").agg(F.round(share(F.col("n_faces") > 0), 3).alias("dense_ratio"))
    moving = shots.groupBy("job_id").agg(F.round(share(F.col("strategy").isin("tracking", "panning")), 3).alias("tracking_pct"))
    first = faces.groupBy("job_id", "t").agg(F.min_by("x", "face_key").alias("_fx"))
    hit = points_in(first, shots.select(*key, "start", "end", "subject_x"), ["job_id"], 10.0, ends="[)")
    own = hit.groupBy("job_id", "t", "_fx").agg(F.min_by(F.struct(shot_id, "subject_x"), F.struct("start", shot_id)).alias("r")).select("job_id", "t", "_fx", f"r.{shot_id}", "r.subject_x")
    offset = own.groupBy(*key).agg(F.avg(F.col("subject_x") - F.col("_fx")).alias("_o"))
    err = own.join(offset, key).withColumn("err", F.abs(F.col("_fx") - (F.col("subject_x") - F.col("_o"))))
    mean = err.groupBy("job_id").agg(F.round(F.avg("err"), 3).alias("mean_err"))
    p95 = pick_ranks(err, ["job_id"], "err", {"_p": lambda n: F.floor((n - 1) * 0.95)}, F.floor(F.col("err") / 5)).select("job_id", F.round("_p", 3).alias("p95_err"))
    return moving.join(dense, "job_id", "left").join(mean, "job_id", "left").join(p95, "job_id", "left").fillna(0.0)


def text_summary(segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """Extractive summary of a job: opening text, speakers, minutes, up to five scene topics and tone.

    The opening ends with the segment that passes 600 characters.  Topics are
    taken from the most important scenes; one sharing more than two words with
    earlier topics is skipped, so that part is an ordered pass that stops at five.
    """
    d = scan(segments, ["job_id"], ["seg_idx"], index_block("seg_idx"), total={"_upto": F.length("text")}).withColumn("_before", F.col("_upto") - F.length("text"))
    head = d.where("_before <= 600").groupBy("job_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda r: r["text"]), " ").alias("_t"), F.countDistinct("speaker").alias("speakers"))
    length = segments.groupBy("job_id").agg(F.bround((F.max_by("end", "seg_idx") - F.min_by("start", "seg_idx")) / 60).cast("long").alias("minutes"))
    cut = F.substring("_t", 1, 300)
    opening = F.when(F.length("_t") > 300, F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("..."))).otherwise(F.col("_t"))
    text = F.trim(F.coalesce("description", F.lit("")))
    topic = F.trim(F.element_at(F.split(text, r"\."), 1))
    topic = F.when(F.length(topic) > 60, F.regexp_replace(F.substring(topic, 1, 60), r" [^ ]*$", "")).otherwise(topic)
    skip = (text == "") | text.startswith("Frame at ") | text.startswith("Video frame at ") | text.startswith("Continuation of video") | F.lower(text).contains("unavailable") | F.lower(text).contains("analysis")
    s = scenes.where(~skip).select("job_id", (-F.col("importance")).alias("_rank"), "t", "scene_id", topic.alias("topic")).where(F.length("topic") >= 5)

    def step(state, row):
        words, n = state
        mine = set(row[4].lower().split())
        if n >= 5 or len(mine & words) > 2:
            return state, []
        return (words | mine, n + 1), [(row[0], n + 1, row[4])]

    job_type = segments.schema["job_id"].dataType.simpleString()
    top = fold_sorted(s, ["job_id"], ["_rank", "t", "scene_id"], f"job_id {job_type}, n int, topic string", lambda: (set(), 0), step)
    top = top.groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "topic"))), lambda r: r["topic"]).alias("topics"))  # at most five
    mean = scenes.groupBy("job_id").agg(F.avg("importance").alias("_m"))
    tone = F.when(F.col("_m").isNull(), "conversational").when(F.col("_m") >= 7, "engaging and dynamic").when(F.col("_m") >= 5, "conversational").otherwise("casual")
    d = head.join(length, "job_id").join(top, "job_id", "left").join(mean, "job_id", "left")
    return d.select("job_id", "speakers", "minutes", opening.alias("opening"), F.coalesce("topics", F.array(F.lit("video content"))).alias("topics"), tone.alias("tone"))


#: Products of a matrix and sums entry by entry differ by less than this.
ROUNDING = 1e-9


def _closest_earlier(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """Closest earlier track of each track of a block in another block, if within the limit.

    A matrix product leaves the pairs that can be the closest; theirs are summed entry by entry, so
    that blocks don't change the distances.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            later, a, earlier, b = unpacked(batch, i)
            alike = a @ b.T
            alike[(earlier[None, :] >= later[:, None]) | np.isnan(alike)] = -np.inf
            top = alike.max(axis=1)
            x, y = np.nonzero((alike >= np.minimum(top, 1.0)[:, None] - ROUNDING) & (alike > 1.0 - limit**2 - ROUNDING))
            exact = np.zeros(len(x))
            for k in range(a.shape[1]):
                exact += a[x, k] * b[y, k]
            far = np.sqrt(np.maximum(1.0 - exact, 0.0))
            order = np.lexsort((earlier[y], far, x))
            order = order[far[order] < limit]
            first = order[np.unique(x[order], return_index=True)[1]]
            job = batch.column("job_id").take(pa.array(np.full(len(first), i)))
            yield pa.RecordBatch.from_arrays([job, pa.array(later[x[first]]), pa.array(far[first]), pa.array(earlier[y[first]])], ["job_id", "later", "dist", "earlier"])


def persistent_ids(tracks: DataFrame, limit: float = 0.35) -> DataFrame:
    """Identity of each track (job_id, track_id, signature): that of the closest earlier track of
    the job within the limit, else a new one, numbered in track order.

    The distance is that of square-root histograms.  Two such vectors within the
    limit also lie close in any projection, so tracks meet only in neighbouring
    cells of two projections, there in blocks.  Signatures of another length never match.  Links point to earlier tracks and are followed by
    doubling.
    """
    total = F.aggregate("signature", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    root = F.transform("signature", lambda x: F.sqrt(x.cast("double") / F.col("_m")))
    d = tracks.withColumn("_m", total).withColumn("_v", F.when(F.col("_m") > 0, root)).select("job_id", "track_id", "_v")
    n = F.size("_v")
    flat = F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x) / F.sqrt(n)
    half = F.aggregate(F.slice("_v", F.lit(1), F.floor(n / 2).cast("int")), F.lit(0.0), lambda acc, x: acc + x) / F.sqrt(n / 2)
    reach = (2 * limit**2) ** 0.5
    d = cut_lineage(d.withColumns({"_a": F.floor(flat / reach), "_b": F.floor(half / reach)}))
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    own = d.where("_v IS NOT NULL").select("job_id", "_a", "_b", F.col("track_id").cast("long").alias("_id"), F.col("_v").alias("v"))
    later = own.withColumn("_a", near("_a")).withColumn("_b", near("_b"))
    kind = d.schema["job_id"].dataType.simpleString()
    found = met_blocks(later, own, ["job_id", "_a", "_b"]).drop("_a", "_b").mapInArrow(partial(_closest_earlier, limit=limit), f"job_id {kind}, later long, dist double, earlier long")
    best = found.groupBy("job_id", "later").agg(F.min(F.struct("dist", "earlier")).alias("_best")).select("job_id", "later", F.col("_best.earlier").alias("up"))
    link = cut_lineage(d.select("job_id", "track_id").join(best.withColumnRenamed("later", "track_id"), ["job_id", "track_id"], "left").withColumn("up", F.coalesce("up", "track_id")))
    while True:
        hop = link.select("job_id", F.col("track_id").alias("up"), F.col("up").alias("_u2"))
        new = cut_lineage(link.join(hop, ["job_id", "up"]))
        moved = not new.where("_u2 <> up").isEmpty()
        link = new.select("job_id", "track_id", F.col("_u2").alias("up"))
        if not moved:
            break
    roots = numbered(link.where("up = track_id").select("job_id", "track_id"), ["job_id"], ["track_id"], index_block("track_id"), "_n")
    return link.join(roots.select("job_id", F.col("track_id").alias("up"), (F.col("_n") - 1).alias("persistent_id")), ["job_id", "up"]).drop("up")
