"""Aggregates over face and object detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import islands, pick_ranks, scan, time_block
from ..functions.ranges import points_in
from .metrics import share


def sport_subtype(objects: DataFrame, ball_share: float = 0.15, vehicle_share: float = 0.10, min_area: float = 500.0) -> DataFrame:
    """Basketball or racing by the share of frames with a ball or a large vehicle; null otherwise."""
    big = F.col("class_name").isin("car", "truck", "motorcycle") & (F.col("w") * F.col("h") >= min_area)
    f = objects.groupBy("job_id", F.round("t", 2).alias("_t")).agg(F.bool_or(F.col("class_name") == "sports ball").alias("_b"), F.bool_or(big).alias("_v"))
    g = f.groupBy("job_id").agg(share(F.col("_b")).alias("ball"), share(F.col("_v")).alias("vehicle"))
    kind = F.when((F.col("ball") >= ball_share) & (F.col("ball") > F.col("vehicle")), "basketball").when((F.col("vehicle") >= vehicle_share) & (F.col("vehicle") > F.col("ball")), "racing")
    return g.withColumn("subtype", kind)


def music_subtype(faces: DataFrame, beat_confidence: DataFrame, formation: float = 0.08, confidence: float = 0.6) -> DataFrame:
    """Performance when enough frames show a wide group and the beat is clear."""
    f = faces.groupBy("job_id", "t").agg(((F.count("*") >= 3) & (F.max("x") - F.min("x") >= 55.0)).alias("_g"))
    g = f.groupBy("job_id").agg(share(F.col("_g")).alias("formation")).join(beat_confidence, "job_id", "left").fillna(0.0, ["beat_confidence"])
    return g.withColumn("subtype", F.when((F.col("formation") >= formation) & (F.col("beat_confidence") >= confidence), "performance"))


def panel_flags(faces: DataFrame) -> DataFrame:
    """Seated-panel test and corner share per job."""
    f = faces.groupBy("job_id", "t").agg(F.count("*").alias("_n"), F.count_if(((F.col("x") < 20) | (F.col("x") > 80)) & ((F.col("y") < 25) | (F.col("y") > 75))).alias("_c"))
    g = f.groupBy("job_id").agg(F.count("*").alias("frames"), share(F.col("_n") >= 2).alias("_multi"), F.avg("_n").alias("_avg"), (F.sum("_c") / F.sum("_n")).alias("corner_share"))
    panel = (F.col("frames") >= 10) & (F.col("_multi") >= 0.25) & (F.col("_avg") >= 1.5)
    return g.select("job_id", "frames", panel.alias("is_panel"), "corner_share")


def interval_slots(intervals: DataFrame, faces: DataFrame, interval_id: str) -> DataFrame:
    """Frames of each slot inside each interval and the interval's frame total."""
    key = ["job_id", interval_id]
    # faces become one row per time of a job before they meet the intervals
    frames = faces.groupBy("job_id", "t").agg(F.collect_set(F.when(F.col("slot_id") >= 0, F.col("slot_id"))).alias("_slots"))
    hit = points_in(frames, intervals.select(*key, "start", "end"), ["job_id"], 10.0).select(*key, "t", "_slots").repartition(*key)
    once = hit.groupBy(*key, "t").agg(F.first("_slots").alias("_slots"))
    total = once.groupBy(*key).agg(F.count("*").alias("total"))
    per = once.select(*key, "t", F.explode("_slots").alias("slot_id")).groupBy(*key, "slot_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))
    return per.join(total, key)


def crowd_flags(intervals: DataFrame, faces: DataFrame, interval_id: str, floor: float = 0.20) -> DataFrame:
    """Active slot count and the crowd test (three slots in a fifth of the frames)."""
    g = interval_slots(intervals, faces, interval_id).groupBy("job_id", interval_id).agg(F.count("*").alias("slots"), F.count_if(F.col("n") / F.col("total") >= floor).alias("_a"))
    d = intervals.select("job_id", interval_id).join(g, ["job_id", interval_id], "left")
    return d.select("job_id", interval_id, F.coalesce("slots", F.lit(0)).alias("slots"), (F.coalesce("_a", F.lit(0)) >= 3).alias("is_crowd"))


def corner_region(slots: DataFrame, faces: DataFrame, totals: DataFrame) -> DataFrame:
    """First small, frequent, still slot that sits in a corner.

    ``slots``: x_center, x_min, x_max, frame_count, avg_width, avg_height; ``totals``: total_frames.
    """
    y = faces.groupBy("job_id", "slot_id").agg(F.avg(F.col("y") / 100).alias("_y"), F.stddev_pop(F.col("y") / 100).alias("_sd"))
    x = F.col("x_center") / 100
    corner = (
        F.when((x < 0.35) & (F.col("_y") > 0.6), "bottom_left").when((x > 0.65) & (F.col("_y") > 0.6), "bottom_right")
        .when((x < 0.35) & (F.col("_y") < 0.4), "top_left").when((x > 0.65) & (F.col("_y") < 0.4), "top_right")
    )
    d = slots.join(totals, "job_id").join(y, ["job_id", "slot_id"]).withColumn("corner", corner)
    d = d.where((F.col("avg_width") <= 15) & (F.col("frame_count") >= F.col("total_frames") * 0.4) & (F.col("x_max") - F.col("x_min") <= 20) & (F.col("_sd") <= 0.1) & F.col("corner").isNotNull())
    fw = F.col("avg_width") / 100
    fh = F.when(F.col("avg_height") > 0, F.col("avg_height") / 100).otherwise(fw * 1.3)
    d = d.select("job_id", "slot_id", "corner", F.greatest(F.lit(0.0), x - fw / 2 - 0.02).alias("rx"), F.greatest(F.lit(0.0), F.col("_y") - fh / 2 - 0.02).alias("ry"),
                 F.least(F.lit(1.0), fw + 0.04).alias("rw"), F.least(F.lit(1.0), fh + 0.04).alias("rh"), F.least(F.lit(1.0), F.col("frame_count") / F.col("total_frames")).alias("confidence"))
    best = d.groupBy("job_id").agg(F.min_by(F.struct(*d.columns[1:]), "slot_id").alias("r"))
    return best.select("job_id", "r.*")


def slot_motion(slots: DataFrame) -> DataFrame:
    """Whether faces of a job move freely instead of sitting in fixed places."""
    span = F.col("x_max") - F.col("x_min")
    g = slots.groupBy("job_id").agg(F.count("*").alias("_n"), F.sum("frame_count").alias("_t"), F.avg(span).alias("_avg"),
                                    F.max_by(F.struct(span.alias("s"), F.col("frame_count").alias("c")), F.struct("frame_count", -F.col("slot_id"))).alias("_d"))
    moving = (
        F.when(F.col("_n") == 1, F.col("_avg") > 15).when(F.col("_t") == 0, True)
        .when((F.col("_d.c") / F.col("_t") > 0.6) & (F.col("_d.s") > 20), True).otherwise(F.col("_avg") > 15)
    )
    return g.select("job_id", moving.alias("continuous_motion"))


def position_spread(points: DataFrame) -> DataFrame:
    """Histogram test on subject positions: many peaks and mostly large steps mean motion.

    Ten bins of ten percent; a job needs ten points, otherwise it is not motion.
    """
    bins = points.where("x >= 0 AND x <= 100").groupBy("job_id", F.least(F.floor(F.col("x") / 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("_k"))
    steps = scan(points, ["job_id"], ["t", "sample_id"], time_block("t"), prev={"_p": F.col("x")})
    n = steps.groupBy("job_id").agg(F.count("*").alias("n"), share_of_steps(F.abs(F.col("x") - F.col("_p"))).alias("_big"))
    limit = F.greatest(F.lit(3), F.floor(F.col("n") * 0.1))
    peaks = bins.join(n.where("n >= 10"), "job_id").where(F.col("_k") > limit).groupBy("job_id").agg(F.count("*").alias("_peaks"), F.sort_array(F.collect_list(F.col("bin") * 10.0 + 5.0)).alias("peak_centers"))
    d = n.join(peaks, "job_id", "left")
    return d.select("job_id", ((F.coalesce("_peaks", F.lit(0)) > 4) & (F.col("_big") > 0.6)).alias("is_motion"), F.coalesce("peak_centers", F.array().cast("array<double>")).alias("peak_centers"))


def share_of_steps(step: Column, limit: float = 8.0) -> Column:
    return F.count_if(step > limit) / F.greatest(F.count(step), F.lit(1))


def shot_motion(shots: DataFrame, faces: DataFrame, shot_id: str, limit: float = 6.0, least: float = 1.0) -> DataFrame:
    """Travel of the active face inside a shot (first face per frame), and whether it forces tracking."""
    key = ["job_id", shot_id]
    hit = points_in(faces.select("job_id", "t", "slot_id", "x", "face_key"), shots.select(*key, "start", "end", "active_slot"), ["job_id"], 10.0, ends="[)")
    hit = hit.where(F.col("active_slot").isNull() | (F.col("slot_id") == F.col("active_slot")))
    per = hit.groupBy(*key, "t").agg(F.min_by("x", "face_key").alias("_x")).groupBy(*key).agg(F.when(F.count("*") >= 2, F.max("_x") - F.min("_x")).otherwise(0.0).alias("travel"))
    d = shots.select(*key, "start", "end").join(per, key, "left").fillna(0.0, ["travel"])
    return d.select(*key, "travel", ((F.col("end") - F.col("start") >= least) & (F.col("travel") > limit)).alias("force_tracking"))


def layout_votes(faces: DataFrame, screens: DataFrame | None = None) -> DataFrame:
    """Layout vote per frame: screen share, triple, split (second face wider than 5 percent), single."""
    key = ["job_id", "t"]
    known = faces.where("slot_id >= 0").groupBy(*key, "slot_id").agg(F.max("w").alias("_w"))
    w = Window.partitionBy(*key).orderBy(F.desc("_w"))
    second = known.withColumn("_n", F.row_number().over(w)).groupBy(*key).agg(F.count("*").alias("ids"), F.max(F.when(F.col("_n") == 2, F.col("_w"))).alias("_second_id"))
    wide = faces.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("w")))).where("_n <= 2")
    allf = wide.groupBy(*key).agg(F.max(F.when(F.col("_n") == 2, F.col("w"))).alias("_second"))
    d = allf.join(second, key, "left").fillna(0, ["ids"])
    if screens is not None:
        d = d.withColumn("_r", F.round("t", 1)).join(screens.select("job_id", F.round("t", 1).alias("_r"), F.lit(True).alias("_screen")).distinct(), ["job_id", "_r"], "left")
    else:
        d = d.withColumn("_screen", F.lit(None).cast("boolean"))
    mode = (
        F.when(F.col("_screen"), "screenshare").when(F.col("ids") >= 3, "triple").when(F.col("ids") == 2, F.when(F.col("_second_id") > 5.0, "split").otherwise("single"))
        .when(F.col("_second") > 5.0, "split").otherwise("single")
    )
    return d.select(*key, mode.alias("mode"))


def default_layout(segments: DataFrame) -> DataFrame:
    """Layout with the longest total time (first seen on a tie) and the number of changes."""
    per = segments.groupBy("job_id", "mode").agg(F.sum(F.col("end") - F.col("start")).alias("_s"), F.count("*").alias("_n"), F.min("start").alias("_at"))
    return per.groupBy("job_id").agg(F.max_by("mode", F.struct("_s", -F.col("_at"))).alias("default_mode"), (F.sum("_n") - 1).alias("changes"))


def face_slots(faces: DataFrame, least: int, gap: float) -> DataFrame:
    """One-dimensional gap clustering of face positions into slots, left to right."""
    d = islands(faces.select("job_id", "x", "face_key", "w", "h"), ["job_id"], ["x", "face_key"], F.floor(F.col("x") / 2), ["x"], lambda p, c: c["x"] - p["x"] > gap, "cluster")
    g = d.groupBy("job_id", "cluster").agg(F.count("*").alias("frame_count"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.avg("w").alias("avg_width"), F.avg("h").alias("avg_height"))
    mid = pick_ranks(d, ["job_id", "cluster"], "x", {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)}, F.floor(F.col("x") / 2))
    g = g.where(F.col("frame_count") >= least).join(mid.select("job_id", "cluster", ((F.col("_lo") + F.col("_hi")) / 2).alias("x_center")), ["job_id", "cluster"])
    return g.withColumn("slot_id", F.row_number().over(Window.partitionBy("job_id").orderBy("x_center")) - 1).drop("cluster")
