"""Subject tracks, slots, sampling grids and model-answer parsing."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.ordered import cut_lineage, fold_sorted, islands, keep_spaced, numbered, pick_ranks, scan, time_block
from ..functions.ranges import as_of, nearest, overlap_pairs, points_in
from ..functions.text import safe_x
from .faces import interval_slots
from .joins import centroids, concurrent_speech, dot, nearest_slot
from .windows import hold_track


def _job_type(df: DataFrame) -> str:
    return df.schema["job_id"].dataType.simpleString()


# --- pages, top-k and thinning ---------------------------------------------------------------------

def page(jobs: DataFrame, limit: int, offset: int = 0, status: str | None = None, ascending: bool = False) -> tuple[DataFrame, DataFrame]:
    """One page of the catalog and the total count."""
    d = jobs.where(F.col("status") == status) if status else jobs
    order = F.asc("created_at") if ascending else F.desc("created_at")
    return d.orderBy(order, "job_id").offset(offset).limit(limit), d.agg(F.count("*").alias("total"))


def top_regions(regions: DataFrame, k: int = 3) -> DataFrame:
    """Best ``k`` regions per frame (time to 10 ms) as corner boxes in 0-1, with the frame mean."""
    d = regions.withColumn("frame_t", F.round("t", 2))
    rank = F.row_number().over(Window.partitionBy("job_id", "frame_t").orderBy(F.desc("score"), "region_id"))
    d = d.withColumn("rank", rank).where(F.col("rank") <= k)
    w, h = F.col("w") / 100, F.col("h") / 100
    mean = F.avg("score").over(Window.partitionBy("job_id", "frame_t"))  # at most k rows
    return d.select("job_id", "frame_t", "region_id", "rank", F.greatest(F.lit(0.0), F.col("x") / 100 - w / 2).alias("left"), F.greatest(F.lit(0.0), F.col("y") / 100 - h / 2).alias("top"),
                    w.alias("width"), h.alias("height"), mean.alias("mean_score"))


def best_region(regions: DataFrame) -> DataFrame:
    """Highest-scoring region per time, first one on a tie."""
    return regions.groupBy("job_id", "t").agg(F.max_by(F.struct("region_id", "x", "score"), F.struct("score", -F.col("region_id"))).alias("r")).select("job_id", "t", "r.*")


def sample_cap(duration: Column) -> Column:
    return F.greatest(F.lit(60), F.floor(duration / 60.0 * 4))


def trim_even(points: DataFrame, caps: DataFrame) -> DataFrame:
    """Thin a job's times to its cap at even positions round(i * n / cap), then 50 ms apart.

    ``caps``: job_id, cap.
    """
    d = numbered(points, ["job_id"], ["t"], time_block("t"), "_n")
    size = d.groupBy("job_id").agg(F.count("*").alias("_size")).join(caps, "job_id")
    few = d.join(size.where("_size <= cap"), "job_id", "left_semi").select("job_id", "t")
    pick = size.where("_size > cap AND cap >= 2").select("job_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("cap") - 1), lambda i: F.bround(i * F.col("_size") / F.col("cap")).cast("long") + 1)).alias("_n"))
    many = d.join(pick.distinct(), ["job_id", "_n"]).select("job_id", "t")
    tiny = d.join(size.where("_size > cap AND cap < 2"), "job_id").where(F.col("_n") <= F.col("cap")).select("job_id", "t")
    return few.unionByName(keep_spaced(many, ["job_id"], "t", 0.05, ["t"])).unionByName(tiny)


def promote_regions(regions: DataFrame, dialogue: bool = False, floor: float = 0.6) -> DataFrame:
    """Where a frame has no required region, its best preferred one becomes required
    (in dialogue only above the floor)."""
    preferred = (F.col("tier") == "preferred") & ((F.col("score") >= floor) if dialogue else F.lit(True))
    best = regions.groupBy("job_id", "frame").agg(F.bool_or(F.col("tier") == "required").alias("_has"), F.max_by("region_id", F.when(preferred, F.struct("score", -F.col("region_id")))).alias("_best"))
    d = regions.join(best, ["job_id", "frame"])
    up = ~F.col("_has") & (F.col("region_id") == F.col("_best"))
    return d.withColumn("tier", F.when(up, "required").otherwise(F.col("tier"))).drop("_has", "_best")


def top_by(rows: DataFrame, value: str, order: list[str], k: int) -> DataFrame:
    """The ``k`` largest rows per job, first in ``order`` on ties."""
    w = Window.partitionBy("job_id").orderBy(F.desc(value), *order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _listed(rows: DataFrame, order: list[str], line: Column) -> DataFrame:
    no = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))  # at most k rows per job
    return rows.select("job_id", no.cast("long").alias("line_no"), line.alias("line"))


def sentiment_lines(moments: DataFrame, k: int = 20) -> DataFrame:
    """Tagged sound moments, the ``k`` loudest per job in time order."""
    top = top_by(moments.where(F.coalesce("sentiment", F.lit("neutral")) != "neutral"), "delta_db", ["t", "moment_id"], k)
    return _listed(top, ["t", "moment_id"], F.format_string("  [%.1fs] %s (+%ddB)", F.col("t"), F.col("sentiment"), F.bround("delta_db").cast("long")))


def energy_lines(moments: DataFrame, k: int = 25) -> DataFrame:
    """Loud moments of a job as prompt lines, in time order."""
    label = F.when(F.col("type") == "volume_spike", "LOUD").when(F.col("type") == "extreme_spike", "VERY LOUD").when(F.col("type") == "silence_to_loud", "SILENCE->LOUD").otherwise("SPIKE")
    top = top_by(moments, "delta_db", ["t", "moment_id"], k)
    return _listed(top, ["t", "moment_id"], F.format_string("[%ds] %s (+%ddB)", F.bround("t").cast("long"), label, F.bround("delta_db").cast("long")))


def zone_lines(zones: DataFrame, k: int = 15) -> DataFrame:
    """Best highlight windows of a job as prompt lines, best first."""
    top = top_by(zones, "composite", ["start"], k)
    whole = lambda c: F.bround(c).cast("long")
    line = F.format_string("[%d-%ds] score=%d (audio=%d, transcript=%d, visual=%d)", whole("start"), whole("end"), whole("composite"), whole("audio"), whole("transcript"), whole("scene"))
    return _listed(top, [F.desc("composite"), "start"], line)


def line_text(start: Column, end: Column, speaker: Column, text: Column, confidence: Column | None = None) -> Column:
    head = F.concat(F.lit("["), F.bround(start).cast("long").cast("string"), F.lit("-"), F.bround(end).cast("long").cast("string"), F.lit("] "), speaker, F.lit(": "), text)
    return head if confidence is None else F.concat(head, F.when(confidence < 0.4, " [LOW_CONF]").otherwise(""))


def condense(turns: DataFrame, zones: DataFrame, max_chars: int = 12000, size: float = 60.0) -> DataFrame:
    """Transcript lines within a character budget, shared over 60 s buckets; buckets touched by
    a hot zone weigh double, the first and last have a minimum.

    ``turns``: job_id, run, start, end, speaker, text, confidence (merged turns).
    """
    d = turns.withColumn("line", line_text(F.col("start"), F.col("end"), F.col("speaker"), F.col("text"), F.col("confidence"))).withColumn("_len", F.length("line"))
    job = d.groupBy("job_id").agg(F.sum("_len").alias("_sum"), F.count("*").alias("_k"), F.max_by("end", "run").alias("_end"))
    job = job.select("job_id", (F.col("_sum") + F.col("_k") - 1 <= max_chars).alias("_fits"), F.greatest(F.lit(1), F.floor(F.col("_end") / size) + 1).cast("long").alias("_n"))
    hot = zones.select("job_id", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("start") / size)), F.floor(F.col("end") / size))).alias("bucket")).distinct()
    hot = hot.join(job, "job_id").where(F.col("bucket") < F.col("_n")).select("job_id", "bucket", F.lit(True).alias("_hot"))
    weight = job.join(hot.groupBy("job_id").agg(F.count("*").alias("_h")), "job_id", "left").withColumn("_total", F.col("_n") + F.coalesce("_h", F.lit(0))).drop("_h")
    d = d.join(weight, "job_id").withColumn("bucket", F.least(F.floor(F.col("start") / size), F.col("_n") - 1)).join(hot, ["job_id", "bucket"], "left")
    share = F.lit(max_chars) * F.when(F.col("_hot"), 2.0).otherwise(1.0) / F.col("_total")
    edge = F.when((F.col("_n") >= 2) & (F.col("bucket") == 0), max_chars * 0.08).when((F.col("_n") >= 2) & (F.col("bucket") == F.col("_n") - 1), max_chars * 0.05).otherwise(0.0)
    d = d.withColumn("_budget", F.greatest(share, edge))
    d = scan(d, ["job_id", "bucket"], ["run"], F.floor(F.col("run") / 4096), total={"_used": F.col("_len") + 1}, prev={"_p": F.lit(True)})
    keep = F.col("_fits") | (F.col("_used") <= F.col("_budget")) | F.col("_p").isNull()
    cut = ~F.col("_fits") & (F.col("_used") > F.col("_budget"))
    short = F.concat(F.substr("line", F.lit(1), F.greatest(F.lit(50), F.floor("_budget").cast("int")).cast("int")), F.lit("..."))
    return d.where(keep).select("job_id", "run", "bucket", F.when(cut, short).otherwise(F.col("line")).alias("line"))


def condense_hot(segments: DataFrame, zones: DataFrame, max_chars: int = 12000, hot: float = 50.0, warm: float = 20.0) -> DataFrame:
    """Hot-zone-first form: full lines of hot segments, shortened lines of warm ones, and one
    line per cold stretch (ten at most), each tier within its share of the characters.

    A line that does not fit is skipped and later ones may still fit, so each
    tier is an ordered pass over lengths with the used count as state.
    ``zones``: job_id, start, end, composite.
    """
    z = zones.select("job_id", F.col("composite"), F.expr("CAST(start AS BIGINT)").cast("double").alias("_from"), F.expr("CAST(`end` AS BIGINT)").cast("double").alias("_to"))
    s = segments.select("job_id", "seg_idx", "start", "end", "speaker", "text", F.expr("CAST(start AS BIGINT)").cast("double").alias("_sec"))
    best = points_in(s.select("job_id", "seg_idx", "_sec"), z, ["job_id"], 60.0, t="_sec", span=("_from", "_to")).groupBy("job_id", "seg_idx").agg(F.max("composite").alias("_c"))
    tier = F.when(F.col("_c") >= hot, 0).when(F.col("_c") >= warm, 1).otherwise(2)
    s = cut_lineage(s.join(best, ["job_id", "seg_idx"], "left").withColumn("tier", tier))
    line = F.when(F.col("tier") == 0, line_text(F.col("start"), F.col("end"), F.col("speaker"), F.col("text"))).otherwise(line_text(F.col("start"), F.col("end"), F.col("speaker"), F.substring("text", 1, 100)))
    lines = s.where("tier < 2").select("job_id", "tier", "seg_idx", line.alias("line"))
    budget = (int(max_chars * 0.60), int(max_chars * 0.30))

    def step(used, row):
        size = len(row[3]) + 1
        return (used + size, [row]) if used + size <= budget[row[1]] else (used, [])

    kept = fold_sorted(lines, ["job_id", "tier"], ["seg_idx"], f"job_id {_job_type(segments)}, tier int, seg_idx bigint, line string", lambda: 0, step)
    d = islands(s.select("job_id", "seg_idx", "start", "end", (F.col("tier") == 2).alias("_cold")), ["job_id"], ["seg_idx"], F.floor(F.col("seg_idx") / 4096), ["_cold"], lambda p, c: p["_cold"] != c["_cold"], "run")
    runs = d.groupBy("job_id", "run", "_cold").agg(F.min_by("start", "seg_idx").alias("a"), F.min("seg_idx").alias("seg_idx"))
    end = segments.groupBy("job_id").agg(F.max("end").alias("_all"))
    runs = scan(runs, ["job_id"], ["run"], F.floor(F.col("run") / 4096), nxt={"_n": F.col("a")}).join(end, "job_id").where("_cold").withColumn("b", F.coalesce("_n", "_all"))
    first = runs.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy("run"))).where("_r <= 10")
    whole = lambda c: F.bround(c).cast("long").cast("string")
    cold = F.concat(F.lit("["), whole(F.col("a")), F.lit("-"), whole(F.col("b")), F.lit("s] (low-engagement region — "), whole(F.col("b") - F.col("a")), F.lit("s of content condensed)"))
    return kept.unionByName(first.select("job_id", F.lit(2).alias("tier"), "seg_idx", cold.alias("line")))


# --- sampling grids --------------------------------------------------------------------------------

def sample_times(jobs: DataFrame, cuts: DataFrame, windows: DataFrame, starts: DataFrame) -> DataFrame:
    """Frame times to analyse: cuts and one second after, midpoints of doubtful windows, clip
    openings, and one sample per 30 s without any; 0.2 s apart and capped per job.

    ``jobs``: job_id, duration; ``cuts``/``starts``: job_id, t; ``windows``: job_id, start, end.
    """
    j = jobs.select("job_id", F.greatest(F.lit(0.0), "duration").alias("_dur"))
    a = cuts.select("job_id", F.explode(F.array("t", F.col("t") + 1.0)).alias("t"))
    b = windows.select("job_id", ((F.col("start") + F.col("end")) / 2).alias("t"))
    c = starts.select("job_id", F.explode(F.array(*[F.col("t") + x for x in (0.5, 1.5, 2.5)])).alias("t"))
    ac = a.unionByName(c).join(j, "job_id").where("t >= 0 AND t <= _dur").select("job_id", "t")
    first = cut_lineage(keep_spaced(ac.unionByName(b).distinct(), ["job_id"], "t", 0.2, ["t"]))
    grid = j.where("_dur > 0").select("job_id", "_dur", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_dur") / 30) - 1)).alias("_w"))
    used = first.select("job_id", F.floor(F.col("t") / 30).alias("_w")).distinct()
    # a window is half-open, so a time at its end counts for the next one
    empty = grid.join(used, ["job_id", "_w"], "left_anti").select("job_id", ((F.col("_w") * 30 + F.least(F.col("_w") * 30 + 30, F.col("_dur"))) / 2).alias("t"))
    both = cut_lineage(keep_spaced(first.unionByName(empty).distinct(), ["job_id"], "t", 0.2, ["t"]))
    return trim_even(both, j.select("job_id", sample_cap(F.col("_dur")).alias("cap")))


def voiced_intervals(frames: DataFrame, frame_s: float, gap: float = 0.15) -> DataFrame:
    """Voiced stretches from per-frame flags (job_id, frame, voiced), joined over short gaps."""
    v = frames.where("voiced").select("job_id", "frame")
    d = islands(v, ["job_id"], ["frame"], F.floor(F.col("frame") / 8192), ["frame"], lambda p, c: (c["frame"] - p["frame"] - 1) * frame_s >= gap - 1e-9, "run")
    return d.groupBy("job_id", "run").agg((F.min("frame") * frame_s).alias("start"), ((F.max("frame") + 1) * frame_s).alias("end"))


def analysis_windows(jobs: DataFrame, size: float = 600.0, overlap: float = 120.0, sequential: bool = False) -> DataFrame:
    """Overlapping windows over each job; in sequential mode long jobs are sampled down to a cap."""
    step = size - overlap if size > overlap else size
    n = F.ceil(F.col("duration") / step).cast("long")
    d = jobs.where("duration > 0").withColumn("_n", n).withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    if sequential:
        cap = F.when(F.col("duration") <= 7200, 8).when(F.col("duration") <= 14400, 10).otherwise(12)
        each = F.greatest(F.lit(1), F.floor(F.col("_n") / cap))
        on = F.col("win") % each == 0
        place = F.when(on, F.floor(F.col("win") / each)).otherwise(F.ceil(F.col("_n") / each))
        d = d.where((F.col("_n") <= cap) | ((on | (F.col("win") == F.col("_n") - 1)) & (place < cap)))
    start = F.col("win") * step
    return d.select("job_id", "win", start.alias("start"), F.least(start + size, F.col("duration")).alias("end"))


def summary_chunks(jobs: DataFrame, segments: DataFrame, size: float, margin: float = 30.0) -> DataFrame:
    """Segments of each summary chunk, with a margin on both sides."""
    d = jobs.select("job_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration") / size).cast("long") - 1)).alias("chunk"))
    d = d.select("job_id", "chunk", (F.col("chunk") * size - margin).alias("_from"), (F.least((F.col("chunk") + 1) * size, F.col("duration")) + margin).alias("_to"))
    s = segments.select("job_id", "seg_idx", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return points_in(s, d, ["job_id"], size, t="s_start", span=("_from", "_to")).where("s_end <= _to").select("job_id", "chunk", "seg_idx")


# --- clusters --------------------------------------------------------------------------------------

def fingerprint_clusters(prints: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Sequential clustering of histograms by chi-squared distance to running mean centroids.

    A job has few clusters; only their centroids are carried from row to row.
    """
    import numpy as np

    def step(state, row):
        job, idx, values = row
        v = np.asarray(values, dtype=float)
        best, at = None, -1
        for i, (c, _) in enumerate(state):
            dist = float(((v - c) ** 2 / (v + c + 1e-9)).sum())
            if best is None or dist < best:
                best, at = dist, i
        if best is not None and best <= threshold:
            c, n = state[at]
            state[at] = ((c * n + v) / (n + 1), n + 1)
        else:
            state.append((v, 1))
            at = len(state) - 1
        return state, [(job, idx, at)]

    return fold_sorted(prints.select("job_id", "print_id", "histogram"), ["job_id"], ["print_id"], f"job_id {_job_type(prints)}, print_id bigint, cluster bigint", list, step)


@F.pandas_udf(ArrayType(LongType()))
def _split_ranks(n: pd.Series, cuts: pd.Series, least: pd.Series) -> pd.Series:
    """Accepted cut positions: the largest gap of a part splits it when both sides are big enough."""

    def solve(lo, hi, gaps, m):
        inside = [g for g in gaps if lo < g["at"] < hi]
        if hi - lo < 2 * m or not inside:
            return []
        top = max(inside, key=lambda g: (g["gap"], -g["at"]))
        if top["at"] - lo < m or hi - top["at"] < m:
            return []
        return solve(lo, top["at"], gaps, m) + [top["at"]] + solve(top["at"], hi, gaps, m)

    return pd.Series([solve(0, int(a), list(c), int(m)) for a, c, m in zip(n, cuts, least)])


def position_clusters(points: DataFrame, gap: float = 10.0, least: int = 2) -> DataFrame:
    """Position clusters of a job; where many points sit in the centre strip and others on both
    sides, clusters without the strip compete and the fewest clusters win, the plain ones first."""
    base = _gap_clusters(points, gap, least).withColumn("_v", F.lit(0))
    parts = [base]
    for v, (low, high, floor) in enumerate(((47, 53, 0.10), (44, 56, 0.15)), 1):
        off = (F.col("x") < low) | (F.col("x") > high)
        ok = points.groupBy("job_id").agg(F.count("*").alias("_n"), F.count_if(off).alias("_o"), F.bool_or(F.col("x") < low).alias("_l"), F.bool_or(F.col("x") > high).alias("_h"))
        ok = ok.where((F.col("_n") >= 4) & (F.col("_n") - F.col("_o") > F.col("_n") * floor) & (F.col("_o") >= 2 * least) & F.col("_l") & F.col("_h")).select("job_id")
        parts.append(_gap_clusters(points.where(off).join(ok, "job_id", "left_semi"), gap, least, 1).withColumn("_v", F.lit(v)))
    every = cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))
    size = every.groupBy("job_id", "_v").agg(F.count("*").alias("_k")).groupBy("job_id").agg(F.min_by("_v", F.struct("_k", "_v")).alias("_v"))
    return every.join(size, ["job_id", "_v"]).drop("_v")


def _gap_clusters(points: DataFrame, gap: float, least: int, fewest: int = 4) -> DataFrame:
    """Clusters of subject positions by recursive splits at the largest gap.

    Only gaps of at least ``gap`` can split, so a job of positions in percent
    sends at most 100 / gap of them to the small recursive step.  Centres are
    trimmed means; a job with centres under 8 apart has no clusters, and a weak
    middle cluster between two others is dropped.
    """
    order = ["x", "sample_id"]
    d = numbered(points.select("job_id", *order), ["job_id"], order, F.floor(F.col("x") / 2), "_rn")
    d = scan(d, ["job_id"], order, F.floor(F.col("x") / 2), prev={"_px": F.col("x")})
    wide = d.where(F.col("x") - F.col("_px") >= gap)
    cuts = wide.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct((F.col("_rn") - 1).alias("at"), (F.col("x") - F.col("_px")).alias("gap")))).alias("_cuts"))
    job = d.groupBy("job_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= fewest).join(cuts, "job_id")
    job = cut_lineage(job.select("job_id", "_n", _split_ranks("_n", "_cuts", F.lit(least)).alias("_at"))).where(F.size("_at") > 0)
    d = d.select("job_id", "x", "_rn").join(job, "job_id").withColumn("_c", F.size(F.filter("_at", lambda a: a < F.col("_rn"))))
    lo = F.when(F.col("_c") == 0, 0).otherwise(F.get("_at", (F.col("_c") - 1).cast("int")))
    hi = F.coalesce(F.get("_at", F.col("_c")), F.col("_n"))
    d = d.withColumns({"_lo": lo, "_size": hi - lo})
    trim = F.greatest(F.lit(1), F.floor(F.col("_size") * 0.1))
    place = F.col("_rn") - F.col("_lo")
    inner = (F.col("_size") <= 2) | ((place > trim) & (place <= F.col("_size") - trim))
    c = d.groupBy("job_id", "_c", "_size").agg(F.floor(F.avg(F.when(inner, F.col("x"))) + 0.5).alias("center"))
    rows = c.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("center", F.col("_size").alias("count")))).alias("_r"))  # at most 100 / gap clusters
    near = F.exists(F.sequence(F.lit(1), F.size("_r") - 1), lambda i: F.get("_r", i)["center"] - F.get("_r", i - 1)["center"] < 8)
    rows = rows.where((F.size("_r") >= 2) & ~near).withColumn("_total", F.aggregate("_r", F.lit(0).cast("long"), lambda acc, x: acc + x["count"]))
    n = F.size("_r")

    def weak(i: Column) -> Column:
        me, left, right = F.get("_r", i), F.get("_r", i - 1), F.get("_r", i + 1)
        span = right["center"] - left["center"]
        return (F.abs(me["center"] - (left["center"] + right["center"]) / 2) < span * 0.3) & (me["count"] < F.greatest(left["count"], right["count"])) & (me["count"] < F.col("_total") * 0.2)

    kept = F.filter("_r", lambda x, i: ~((i > 0) & (i < n - 1) & F.coalesce(weak(i), F.lit(False))))
    return rows.select("job_id", F.explode(kept).alias("k")).select("job_id", "k.*")


def vector_clusters(vectors: DataFrame, k: int, seed: int = 7) -> tuple[DataFrame, float]:
    """K-means labels and the silhouette value."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    d = vectors.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    out = KMeans(k=k, seed=seed).fit(d).transform(d)
    return out.drop("features"), ClusteringEvaluator().evaluate(out)


def region_clusters(regions: DataFrame, cuts: DataFrame, iou: float = 0.3, gap: float = 0.5) -> DataFrame:
    """Group overlapping regions over time; groups do not cross cuts or pauses over ``gap``.

    Only groups seen within ``gap`` seconds can grow, so the pass carries just those
    and is cut at longer pauses.
    """
    c = cuts.select("job_id", F.col("t").alias("_ct")).distinct()
    boxes = regions.select("job_id", "t", "region_id", "x", "y", "w", "h")
    d = as_of(boxes, c, ["job_id"], "t", "_ct", [], sides=("before",)).withColumn("_shot", F.coalesce("before.t", F.lit(-1.0))).drop("before")
    d = islands(d, ["job_id", "_shot"], ["t", "region_id"], time_block("t"), ["t"], lambda p, q: q["t"] - p["t"] > gap, "_run")
    d = d.select("job_id", "_shot", "_run", "t", "region_id", "x", "y", "w", "h")

    def step(live, row):
        job, _, _, t, me, x, y, w, h = row
        left, right, top, bottom, area = x - w / 2, x + w / 2, y - h / 2, y + h / 2, w * h
        at, late = -1, False
        for i, (_, seen, l, r, u, b, size) in enumerate(live):
            if not t - seen <= gap:
                late = True
                continue
            ix = (right if right < r else r) - (left if left > l else l)
            if ix <= 0:
                continue
            iy = (bottom if bottom < b else b) - (top if top > u else u)
            if iy <= 0:
                continue
            union = size + area - ix * iy
            if (ix * iy / union if union > 0 else 0.0) > iou:
                at = i
                break
        group = live[at][0] if at >= 0 else me
        mine = (group, t, left, right, top, bottom, area)
        if at >= 0:
            live[at] = mine
        else:
            live.append(mine)
        if late:
            live[:] = [g for g in live if t - g[1] <= gap]
        return live, [(job, me, group)]

    got = fold_sorted(d, ["job_id", "_shot", "_run"], ["t", "region_id"], f"job_id {_job_type(regions)}, region_id bigint, cluster_id bigint", list, step)
    return regions.join(got, ["job_id", "region_id"])


def promoted_clusters(clustered: DataFrame, least: int = 5, aspect: tuple[float, float] = (1.0, 1.8), area: tuple[float, float] = (0.005, 0.15)) -> DataFrame:
    """Clusters that last long enough and look like a face by median shape and size."""
    g = clustered.groupBy("job_id", "cluster_id").agg(F.count("*").alias("n"), F.median(F.when(F.col("w") > 0, F.col("h") / F.col("w")).otherwise(0.0)).alias("aspect"), F.median(F.col("w") * F.col("h") / 10000).alias("area"))
    return g.where((F.col("n") >= least) & F.col("aspect").between(*aspect) & F.col("area").between(*area))


# --- slots -----------------------------------------------------------------------------------------

def slot_registry(faces: DataFrame, least: int = 3, gap: float = 15.0) -> DataFrame:
    """Stable face slots of a job, left to right, from face positions over all frames.

    Outliers by quartile are trimmed, crowded jobs use a smaller gap, faces in
    the middle zone of sparse jobs join the nearest outer cluster, and each slot
    gets its trimmed median centre.  ``faces``: job_id, t, face_key, x, w, h.
    """
    block = F.floor(F.col("x") / 2)
    quart = {"_q1": lambda n: F.floor(n / 4), "_q3": lambda n: F.floor(n * 3 / 4)}
    q = pick_ranks(faces, ["job_id"], "x", quart, block)
    iqr = F.col("_q3") - F.col("_q1")
    d = faces.join(q, "job_id").where((F.col("n") < 20) | F.col("x").between(F.greatest(F.lit(5.0), F.col("_q1") - 2 * iqr), F.least(F.lit(95.0), F.col("_q3") + 2 * iqr)))
    d = cut_lineage(d.select("job_id", "t", "face_key", "x", "w", "h"))
    per = d.groupBy("job_id", "t").agg(F.count("*").alias("_k"))
    crowd = per.groupBy("job_id").agg(F.max("_k").alias("_most"), F.avg((F.col("_k") >= 3).cast("double")).alias("_share"))
    w = Window.partitionBy("job_id", "t").orderBy("x", "face_key")  # the faces of one frame
    gaps = d.withColumn("_g", F.col("x") - F.lag("x").over(w)).where("_g IS NOT NULL")
    mid = pick_ranks(gaps, ["job_id"], "_g", {"_mid": lambda n: F.floor(n / 2)}, F.floor(F.col("_g") / 2)).drop("n")
    small = F.greatest(F.lit(5.0), F.least(F.lit(float(gap)), F.col("_mid") * F.when(F.col("_most") >= 5, 0.4).otherwise(0.5)))
    crowd = crowd.join(mid, "job_id", "left").select("job_id", "_most", F.when(((F.col("_most") >= 3) | (F.col("_share") > 0.05)) & F.col("_mid").isNotNull(), small).otherwise(gap).alias("_gap"))
    d = d.join(crowd, "job_id").withColumn("_outer", (F.col("_most") >= 3) | ~F.col("x").between(40, 60))
    has = d.groupBy("job_id").agg(F.bool_or("_outer").alias("_any"))
    # a job with only central faces splits at its largest gap when both sides are seen often enough
    lone = d.join(has.where("NOT _any"), "job_id").select("job_id", "t", "x", "face_key")
    step = scan(lone, ["job_id"], ["x", "face_key"], block, prev={"_px": F.col("x")}).withColumn("_g", F.col("x") - F.col("_px"))
    wide = step.groupBy("job_id").agg(F.count("*").alias("_k"), F.max_by(F.struct("_px", "x", "_g"), F.struct("_g", -F.col("x"))).alias("_m")).where((F.col("_k") >= 6) & (F.col("_m._g") >= 8))
    sides = lone.join(wide, "job_id").groupBy("job_id").agg(F.countDistinct(F.when(F.col("x") <= F.col("_m._px"), F.col("t"))).alias("_a"), F.countDistinct(F.when(F.col("x") >= F.col("_m.x"), F.col("t"))).alias("_b"), F.max("_m._g").alias("_split"))
    sides = sides.where((F.col("_a") >= least) & (F.col("_b") >= least)).select("job_id", (F.col("_split") * 0.8).alias("_split"))
    d = d.join(has, "job_id").join(sides, "job_id", "left").withColumns({"_outer": F.col("_outer") | ~F.col("_any"), "_gap": F.coalesce("_split", "_gap")}).drop("_split")
    d = cut_lineage(d)
    outer = islands(d.where("_outer"), ["job_id"], ["x", "face_key"], block, ["x", "_gap"], lambda p, c: c["x"] - p["x"] > c["_gap"], "cluster")
    means = outer.groupBy("job_id", "cluster").agg(F.avg("x").alias("x_center"))
    inner = nearest_slot(d.where("NOT _outer"), means.withColumnRenamed("cluster", "slot_id")).withColumnRenamed("near_slot", "cluster")
    inner = inner.join(means, ["job_id", "cluster"]).where(F.abs(F.col("x") - F.col("x_center")) <= 15)
    cols = ["job_id", "cluster", "t", "face_key", "x", "w", "h"]
    m = cut_lineage(outer.select(*cols).unionByName(inner.select(*cols)))
    keys = ["job_id", "cluster"]
    size = m.groupBy(*keys).agg(F.countDistinct("t").alias("frame_count"), F.avg("w").alias("avg_width"), F.avg("h").alias("avg_height")).where(F.col("frame_count") >= least)
    q = pick_ranks(m, keys, "x", quart, block)
    iqr = F.col("_q3") - F.col("_q1")
    t = m.join(q, keys).withColumn("_in", F.col("x").between(F.col("_q1") - 1.5 * iqr, F.col("_q3") + 1.5 * iqr))
    enough = t.groupBy(*keys).agg((F.count_if("_in") >= least).alias("_trim"))
    t = t.join(enough, keys).where((F.col("n") < 5) | ~F.col("_trim") | F.col("_in"))
    med = pick_ranks(t.select(*keys, "x"), keys, "x", {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)}, block)
    ends = t.groupBy(*keys).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    s = size.join(med, keys).join(ends, keys)
    r1 = lambda c: F.bround(c, 1)
    s = s.select("job_id", "cluster", r1((F.col("_lo") + F.col("_hi")) / 2).alias("x_center"), r1(F.col("x_min")).alias("x_min"), r1(F.col("x_max")).alias("x_max"), "frame_count", r1(F.col("avg_width")).alias("avg_width"), r1(F.col("avg_height")).alias("avg_height"))
    s = cut_lineage(s)
    peaks = _peak_slots(d, s, least)
    s = s.join(peaks.select("job_id").distinct(), "job_id", "left_anti").unionByName(peaks)
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("x_center", "cluster")) - 1  # one row per slot
    return s.withColumn("slot_id", number.cast("long")).drop("cluster")


def _peak_slots(faces: DataFrame, slots: DataFrame, least: int) -> DataFrame:
    """Slots from histogram peaks (5 percent bins) for jobs that gap clustering left with one
    slot although many faces spread over a quarter of the frame."""
    n = slots.groupBy("job_id").agg(F.count("*").alias("_slots"))
    job = faces.groupBy("job_id").agg(F.count("*").alias("_n"), (F.max("x") - F.min("x")).alias("_range"), F.max("_most").alias("_top")).join(n, "job_id", "left")
    job = job.where((F.coalesce("_slots", F.lit(0)) <= 1) & (F.col("_n") >= 30) & (F.col("_top") >= 2) & (F.col("_range") > 25)).select("job_id", "_n")
    bins = faces.select("job_id", "t", "face_key", "x", "w", "h", F.least(F.lit(19), F.greatest(F.lit(0), F.floor(F.col("x") / 5))).cast("long").alias("_bin")).join(job, "job_id")
    count = bins.groupBy("job_id", "_n", "_bin").agg(F.count("*").alias("_k"))
    w = Window.partitionBy("job_id").orderBy("_bin").rangeBetween(-1, 1)  # twenty bins
    top = count.withColumn("_around", F.max("_k").over(w)).where((F.col("_k") == F.col("_around")) & (F.col("_k") >= F.greatest(F.lit(5.0), F.col("_n") * 0.02))).select("job_id", F.col("_bin").alias("cluster"))
    near = top.select("job_id", "cluster", F.explode(F.array(F.col("cluster") - 1, F.col("cluster"), F.col("cluster") + 1)).alias("_bin"))
    m = cut_lineage(bins.join(near, ["job_id", "_bin"]).select("job_id", "cluster", "t", "x", "w", "h"))
    keys = ["job_id", "cluster"]
    mid = pick_ranks(m, keys, "x", {"_m": lambda k: F.floor(k / 2)}, F.floor(F.col("x") / 2)).drop("n")
    g = m.groupBy(*keys).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.countDistinct("t").alias("frame_count"), F.avg("w").alias("avg_width"), F.avg("h").alias("avg_height"))
    g = g.where(F.col("frame_count") >= least).join(mid, keys)
    kept = keep_spaced_abs(g.select("job_id", "cluster", "_m"), 10.0)
    g = g.join(kept, keys, "left_semi")
    many = g.groupBy("job_id").agg(F.count("*").alias("_k")).where("_k >= 2").select("job_id")
    r1 = lambda c: F.bround(c, 1).alias(c)
    return g.join(many, "job_id", "left_semi").select("job_id", "cluster", F.bround("_m", 1).alias("x_center"), r1("x_min"), r1("x_max"), "frame_count", r1("avg_width"), r1("avg_height"))


def keep_spaced_abs(peaks: DataFrame, gap: float) -> DataFrame:
    """Peaks in bin order that lie ``gap`` away from every kept one; a job has at most twenty."""

    def step(kept, row):
        if any(abs(row[2] - k) < gap for k in kept):
            return kept, []
        return kept + [row[2]], [(row[0], row[1])]

    return fold_sorted(peaks, ["job_id"], ["cluster"], f"job_id {_job_type(peaks)}, cluster bigint", list, step)


def linked_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node of the component of every node in an edge list (keys, a, b).

    Labels flow along edges in rounds; each round is written out and rounds end
    when no label changes.
    """
    both = cut_lineage(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(both.select(*keys, F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("_m"))
        new = cut_lineage(label.join(near, [*keys, "node"]).withColumn("_n", F.least("label", "_m")))
        moved = not new.where(F.col("_n") < F.col("label")).isEmpty()
        label = new.select(*keys, "node", F.col("_n").alias("label"))
        if not moved:
            return label


def merge_twin_slots(slots: DataFrame, faces: DataFrame, reach: float = 8.0, alike: float = 0.70) -> DataFrame:
    """Merge slots of one job that sit within ``reach`` and whose mean embeddings are alike;
    merged slots take frame-weighted means and are numbered left to right again."""
    cents = centroids(faces.drop("identity_id").withColumnRenamed("slot_id", "identity_id")).withColumnRenamed("identity_id", "slot_id")
    s = slots.join(cents, ["job_id", "slot_id"], "left").withColumn("_b", F.floor(F.col("x_center") / reach))
    a = s.select("job_id", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"), F.col("slot_id").alias("a"), F.col("x_center").alias("xa"), F.col("centroid").alias("ca"))
    b = s.select("job_id", "_b", F.col("slot_id").alias("b"), F.col("x_center").alias("xb"), F.col("centroid").alias("cb"))
    edges = a.join(b, ["job_id", "_b"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("xa") - F.col("xb")) < reach) & F.col("ca").isNotNull() & F.col("cb").isNotNull())
    edges = edges.where(dot(F.col("ca"), F.col("cb")) > alike)
    label = linked_components(edges, ["job_id"]).withColumnRenamed("node", "slot_id")
    d = slots.join(label, ["job_id", "slot_id"], "left").withColumn("_root", F.coalesce("label", "slot_id"))
    n = F.sum("frame_count")
    mean = lambda c: F.bround(F.sum(F.col(c) * F.col("frame_count")) / F.greatest(n, F.lit(1)), 1)
    one = F.count("*") == 1
    g = d.groupBy("job_id", "_root").agg(*[F.when(one, F.first(c)).otherwise(mean(c)).alias(c) for c in ("x_center", "avg_width", "avg_height")], F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), n.alias("frame_count"))
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("x_center", "_root")) - 1
    return g.withColumn("slot_id", number.cast("long")).drop("_root")


def interval_slot(intervals: DataFrame, segments: DataFrame, mapping: DataFrame, events: DataFrame, faces: DataFrame, slots: DataFrame, interval_id: str, crop_pct: float) -> DataFrame:
    """Active slot of each interval by priority: transcript coverage, speaker majority, face
    dominance, several faces, wide shot.  Each source is one join and aggregate."""
    key = ["job_id", interval_id]
    iv = intervals.select(*key, "start", "end", (F.col("end") - F.col("start")).alias("_len"))

    def covered(spans: DataFrame, order: str) -> DataFrame:
        pairs = overlap_pairs(iv, spans, ["job_id"], 30.0)
        per = pairs.groupBy(*key, "_len", "slot_id").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("_s"), F.min(order).alias("_o"))
        return per.groupBy(*key).agg(F.max_by(F.struct("slot_id", (F.col("_s") / F.col("_len")).alias("cover")), F.struct("_s", -F.col("_o"))).alias("b"))

    talk = segments.where(F.coalesce("confidence", F.lit(1.0)) >= 0.6).join(mapping, ["job_id", "speaker"]).select("job_id", "slot_id", "seg_idx", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    ev = events.select("job_id", F.col("slot_id").cast("long").alias("slot_id"), "event_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    said = covered(talk, "seg_idx").select(*key, F.col("b.slot_id").alias("_ts"), F.col("b.cover").alias("_tc"))
    major = covered(ev, "event_id").select(*key, F.col("b.slot_id").alias("_es"), F.col("b.cover").alias("_ec"))
    per = cut_lineage(interval_slots(intervals, faces, interval_id).withColumn("_p", F.col("n") / F.col("total")))
    top = F.max_by(F.struct("slot_id", "_p"), F.struct("n", -F.col("first_t"), -F.col("slot_id")))
    dom = per.groupBy(*key).agg(top.alias("b"), F.count_if(F.col("_p") >= 0.30).alias("_strong"))
    dom = dom.select(*key, F.when((F.col("b._p") >= 0.70) & (F.col("_strong") == 1), F.col("b.slot_id")).alias("_ds"))
    sure = per.where(F.col("_p") >= 0.20).join(slots.select("job_id", "slot_id", "x_center"), ["job_id", "slot_id"])
    sure = sure.groupBy(*key).agg(F.count("*").alias("_k"), F.avg("x_center").alias("_cx"), (F.max("x_center") - F.min("x_center")).alias("_spread"), F.collect_set("slot_id").alias("_ids"),
                                  F.max_by("slot_id", F.struct("n", -F.col("first_t"), -F.col("slot_id"))).alias("_best"), F.sort_array(F.collect_list(F.struct("x_center", "slot_id"))).alias("_xs")).where("_k >= 2")
    mid = F.array_min(F.transform("_xs", lambda s: F.struct(F.abs(s["x_center"] - F.col("_cx")).alias("d"), s["slot_id"].alias("i"))))["i"]
    sure = sure.withColumn("_mid", mid)
    both = concurrent_speech(iv, events, interval_id)
    d = iv.join(said, key, "left").join(major, key, "left").join(dom, key, "left").join(sure, key, "left").join(both, key, "left")

    def out(slot, conf, layout, source):
        return F.struct(slot.cast("long").alias("slot"), conf.alias("confidence"), F.lit(layout).alias("layout"), F.lit(source).alias("source"))

    none, many = F.lit(None).cast("long"), F.col("_k").isNotNull()
    pick = (
        F.when(F.col("_tc") >= 0.60, out(F.col("_ts"), F.least(F.lit(1.0), "_tc"), "single", "active_speaker_slot"))
        .when(F.col("_ec") >= 0.5, out(F.col("_es"), F.least(F.lit(1.0), "_ec"), "single", "active_speaker_slot"))
        .when(F.col("_ds").isNotNull(), out(F.col("_ds"), F.lit(0.7), "single", "dense_face_dominant"))
        .when(many & (F.col("_spread") < crop_pct * 0.85), out(F.col("_mid"), F.lit(0.75), "single", "dense_face_dominant"))
        .when(many & F.array_contains("_ids", F.col("_es")), out(F.col("_es"), F.least(F.lit(1.0), F.greatest(F.lit(0.6), "_ec")), "single", "active_speaker_slot"))
        .when(many & (F.col("overlap") / F.col("_len") > 0.30), out(none, F.lit(0.8), "split", "multi_face_split"))
        .when(many, out(F.col("_best"), F.lit(0.55), "single", "dense_face_dominant")).otherwise(out(none, F.lit(0.3), "wide_master", "hardcoded_center"))
    )
    return d.withColumn("r", F.when(F.col("_len") <= 0, out(none, F.lit(0.0), "wide_master", "hardcoded_center")).otherwise(pick)).select(*key, "r.*")


# --- tracks ----------------------------------------------------------------------------------------

SOURCES = (("face", 0.6), ("saliency", 2.5), ("object", 2.5), ("scene", 4.0))


def frame_faces(faces: DataFrame) -> DataFrame:
    """One position per frame: the widest-open mouth over 0.03, else the widest face."""
    open_ = F.col("lip") > 0.03
    best = F.coalesce(F.max_by(F.struct("x", "y", F.least(F.lit(1.0), F.col("confidence") + 0.1).alias("conf")), F.when(open_, F.struct("lip", -F.col("face_key")))),
                      F.max_by(F.struct("x", "y", F.least(F.lit(1.0), F.col("confidence")).alias("conf")), F.struct("w", -F.col("face_key"))))
    return faces.groupBy("job_id", "t").agg(best.alias("r")).select("job_id", "t", "r.*")


def subject_track(jobs: DataFrame, sources: dict[str, DataFrame], rate: float = 2.0) -> DataFrame:
    """Subject position on a regular grid: the nearest face, else saliency, object or scene within
    the source's reach, then hold, back fill and smoothing.

    ``sources`` maps a source name to rows (job_id, t, x, y, conf).
    """
    step = 1.0 / max(0.5, rate)
    d = jobs.where("duration > 0").select("job_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("duration") + 1e-3) / step))).alias("_i")).select("job_id", (F.col("_i") * step).alias("t"))
    found = []
    for name, reach in SOURCES:
        if name not in sources:
            continue
        s = sources[name].select("job_id", F.col("t").alias("_st"), "x", "y", "conf")
        d = cut_lineage(nearest(d, s, ["job_id"], "t", "_st", ["x", "y", "conf"], tolerance=reach, later_wins=True, name=f"_{name}"))
        found.append(F.when(F.col(f"_{name}").isNotNull(), F.struct(F.col(f"_{name}.x").alias("x"), F.col(f"_{name}.y").alias("y"), F.col(f"_{name}.conf").alias("conf"), F.lit(name).alias("source"))))
    return hold_track(d.withColumn("_b", F.coalesce(*found)).select("job_id", "t", "_b.x", "_b.y", "_b.conf", "_b.source"))


def key_scenes(jobs: DataFrame, cuts: DataFrame, segments: DataFrame, n: int = 12) -> DataFrame:
    """Key moments from cuts, else every n-th segment, else even times, with an excerpt of the
    speech within 4 s (up to 140 characters)."""
    j = jobs.where("duration > 0").select("job_id", "duration")
    c = cuts.select("job_id", "t").distinct().join(j, "job_id").where("t > 0 AND t < duration").select("job_id", "t")
    c = numbered(c, ["job_id"], ["t"], time_block("t"), "_n")
    size = c.groupBy("job_id").agg(F.count("*").alias("_k"))
    every = size.where(F.col("_k") > n).select("job_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_k") / n)) + 1)).alias("_n"))
    picked = c.join(size.where(F.col("_k") <= n), "job_id", "left_semi").select("job_id", "t").unionByName(c.join(every.distinct(), ["job_id", "_n"]).select("job_id", "t"))
    rest = j.join(size, "job_id", "left_anti")
    s = numbered(segments.select("job_id", "seg_idx", "start").join(rest, "job_id"), ["job_id"], ["seg_idx"], F.floor(F.col("seg_idx") / 4096), "_n")
    total = s.groupBy("job_id").agg(F.count("*").alias("_k"))
    s = s.join(total, "job_id").where(((F.col("_n") - 1) % F.greatest(F.lit(1), F.floor(F.col("_k") / n)) == 0) & (F.col("start") > 0) & (F.col("start") < F.col("duration")))
    s = s.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy("seg_idx"))).where(F.col("_r") <= n).select("job_id", F.col("start").alias("t"))
    bare = rest.join(s, "job_id", "left_anti").select("job_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.col("duration") * i / (n + 1))).alias("t"))
    t = picked.unionByName(s).unionByName(bare).select("job_id", F.round("t", 2).alias("t")).distinct()
    t = cut_lineage(t.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy("t"))))  # at most n rows
    near = overlap_pairs(t.select("job_id", "t", F.greatest(F.lit(0.0), F.col("t") - 4).alias("_from"), (F.col("t") + 4).alias("_to")),
                         segments.where(F.trim("text") != "").select("job_id", "seg_idx", F.trim("text").alias("text"), F.col("start").alias("r_start"), F.col("end").alias("r_end")), ["job_id"], 30.0, l_span=("_from", "_to"), closed=True)
    w = Window.partitionBy("job_id", "t").orderBy("seg_idx")  # speech around one moment
    near = near.withColumn("_before", F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_before < 140")
    x = near.groupBy("job_id", "t").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda r: r["text"]), " ").alias("_x"))
    x = x.withColumn("excerpt", F.when(F.length("_x") > 140, F.concat(F.rtrim(F.substring("_x", 1, 139)), F.lit("…"))).otherwise(F.col("_x"))).drop("_x")
    d = t.join(x, ["job_id", "t"], "left")
    text = F.concat(F.lit("Key moment "), F.col("rank").cast("string"), F.coalesce(F.concat(F.lit(": "), "excerpt"), F.format_string(" at %.1fs", "t")))
    return d.select("job_id", "rank", "t", text.alias("description"))


def clip_position(clips: DataFrame, scenes: DataFrame, source: float | None = None, target: float | None = None) -> DataFrame:
    """Subject position of a clip: mean of the scenes inside, else between the neighbours, else 50."""
    key = ["job_id", "clip_id"]
    x = F.coalesce(F.col("subject_x"), F.lit(50)).cast("double")
    sc = scenes.select("job_id", "scene_id", "t", x.alias("_x"))
    inside = points_in(sc, clips.select(*key, "start", "end"), ["job_id"], 30.0).groupBy(*key).agg(F.avg("_x").alias("_in"))
    s = sc.select("job_id", F.col("t").alias("_st"), "_x", "scene_id")
    d = as_of(clips.select(*key, "start", "end"), s, ["job_id"], "start", "_st", ["_x"], tie=("scene_id",)).withColumnRenamed("before", "_nb").drop("after")
    d = as_of(d, s, ["job_id"], "end", "_st", ["_x"], tie=("scene_id",)).withColumnRenamed("after", "_na").drop("before").join(inside, key, "left")
    frac = ((F.col("start") + F.col("end")) / 2 - F.col("_nb.t")) / (F.col("_na.t") - F.col("_nb.t"))
    between = F.when(F.col("_nb").isNotNull() & F.col("_na").isNotNull(), F.col("_nb._x") + (F.col("_na._x") - F.col("_nb._x")) * frac)
    pick = F.coalesce("_in", between, "_nb._x", "_na._x")
    return d.select(*key, F.coalesce(safe_x(pick, source, target).cast("long"), F.lit(50)).alias("x"))


def clip_face_height(clips: DataFrame, faces: DataFrame) -> DataFrame:
    """Face height of a clip: mean over the scenes inside it (both ends count), else 50.

    ``faces``: job_id, scene_id, t, face_no, is_speaking, y.  A scene gives the height of its first speaking
    face, else of its first face; a scene whose chosen face has no height gives nothing.
    """
    key = ["job_id", "clip_id"]
    first = F.struct((~F.coalesce("is_speaking", F.lit(False))).alias("silent"), "face_no")
    heights = faces.groupBy("job_id", "scene_id", "t").agg(F.min_by(F.struct("y"), first).alias("_f")).select("job_id", "t", F.col("_f.y").cast("double").alias("_y"))
    inside = points_in(heights.where("_y IS NOT NULL"), clips.select(*key, "start", "end"), ["job_id"], 30.0).groupBy(*key).agg(F.avg("_y").alias("_y"))
    return clips.select(*key).join(inside, key, "left").select(*key, F.coalesce("_y", F.lit(50.0)).alias("y"))


# Order of fallback positions by content type.
FALLBACK_ORDER = {
    "multi_speaker_panel": ("active_speaker_slot", "prev_crop_continuity", "saliency_peak", "face_centroid", "prev_anywhere", "hardcoded_center"),
    "podcast": ("active_speaker_slot", "prev_crop_continuity", "saliency_peak", "face_centroid", "prev_anywhere", "hardcoded_center"),
    "talking_head": ("face_centroid", "prev_crop_continuity", "saliency_peak", "prev_anywhere", "hardcoded_center"),
    "vlog": ("face_centroid", "saliency_peak", "motion_proxy", "prev_crop_continuity", "prev_anywhere", "hardcoded_center"),
    "anime": ("face_centroid", "saliency_peak", "motion_proxy", "prev_crop_continuity", "prev_anywhere", "hardcoded_center"),
    "narrative": ("face_centroid", "saliency_peak", "motion_proxy", "prev_crop_continuity", "prev_anywhere", "hardcoded_center"),
    "music_video": ("face_centroid", "motion_proxy", "saliency_peak", "prev_crop_continuity", "prev_anywhere", "hardcoded_center"),
    "sports": ("motion_proxy", "saliency_peak", "face_centroid", "prev_crop_continuity", "prev_anywhere", "hardcoded_center"),
    "gaming": ("persistent_hud_region", "motion_proxy", "saliency_peak", "prev_crop_continuity", "prev_anywhere", "hardcoded_center"),
    "unknown": ("prev_crop_continuity", "saliency_peak", "face_centroid", "motion_proxy", "prev_anywhere", "hardcoded_center"),
}


def fallback_position(shots: DataFrame, regions: DataFrame, faces: DataFrame, events: DataFrame, slots: DataFrame, shot_id: str, order: tuple[str, ...] = FALLBACK_ORDER["unknown"], untracked: float = 0.2) -> DataFrame:
    """Position of a low-confidence shot: the first tier of the order that has one.

    Each tier is one join and aggregate; "previous" tiers look at the shot before.
    """
    key = ["job_id", shot_id]
    iv = shots.select(*key, "start", "end")
    d = scan(shots, ["job_id"], ["start", shot_id], time_block("start"), prev={"_p": F.struct("end", "subject_x", "confidence")})
    # the best region and the moves are found once for a time of a job, before they meet the shots
    best = F.max_by(F.struct("x", "y", "_s", "region_id"), F.struct("_s", -F.col("region_id"))).alias("r")
    tops = regions.where("score >= 0.40").select("job_id", "t", "region_id", "x", "y", (F.col("score") * F.col("w") * F.col("h")).alias("_s")).groupBy("job_id", "t").agg(best).select("job_id", "t", "r.*")
    peak = points_in(tops, iv, ["job_id"], 10.0)
    peak = peak.groupBy(*key).agg(F.max_by(F.struct("x", "y"), F.struct("_s", -F.col("t"), -F.col("region_id"))).alias("_peak"))
    f = faces.select("job_id", "t", "x", "y", "slot_id", "face_key", F.greatest(F.lit(0.1), F.when(F.col("slot_id") >= 0, 1.0).otherwise(untracked) * F.col("w") * F.col("h") / 100).alias("_w"))
    # the mean of a shot's faces stays a sum over single faces: sums of sums would round otherwise where it is half a percent
    mass = points_in(f.select("job_id", "t", "x", "y", "_w"), iv, ["job_id"], 10.0)
    mass = mass.groupBy(*key).agg((F.sum(F.col("x") * F.col("_w")) / F.sum("_w")).alias("_fx"), (F.sum(F.col("y") * F.col("_w")) / F.sum("_w")).alias("_fy"))
    # a time's previous one within a shot is that of the job, if the shot holds it
    frames = cut_lineage(scan(f.select("job_id", "t").distinct(), ["job_id"], ["t"], time_block("t"), prev={"_pt": F.col("t")}))
    one = f.where("slot_id >= 0").groupBy("job_id", "t", "slot_id").agg(F.max_by(F.struct("x", "y"), "face_key").alias("r"))
    move = one.join(frames.where("_pt IS NOT NULL"), ["job_id", "t"]).join(one.select("job_id", F.col("t").alias("_pt"), "slot_id", F.col("r").alias("q")), ["job_id", "_pt", "slot_id"])
    dx, dy = F.col("r.x") - F.col("q.x"), F.col("r.y") - F.col("q.y")
    move = move.where(dx * dx + dy * dy > 4.0).groupBy("job_id", "t", "_pt").agg(F.sum("r.x").alias("_sx"), F.sum("r.y").alias("_sy"), F.count("r.x").alias("_nx"), F.count("r.y").alias("_ny"))
    move = points_in(move, iv, ["job_id"], 10.0).where(F.col("_pt") >= F.col("start"))
    move = move.groupBy(*key).agg((F.sum("_sx") / F.sum("_nx")).alias("_mx"), (F.sum("_sy") / F.sum("_ny")).alias("_my"))
    ev = events.where("slot_id >= 0").select("job_id", F.col("slot_id").cast("long").alias("slot_id"), "event_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    talk = overlap_pairs(iv, ev, ["job_id"], 30.0).groupBy(*key, "slot_id").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("_s"), F.min("event_id").alias("_o"))
    talk = talk.groupBy(*key).agg(F.max_by("slot_id", F.struct("_s", -F.col("_o"))).alias("slot_id")).join(slots.select("job_id", "slot_id", "x_center"), ["job_id", "slot_id"]).select(*key, "x_center")
    d = d.join(peak, key, "left").join(mass, key, "left").join(move, key, "left").join(talk, key, "left")
    gap = F.col("start") - F.col("_p.end")
    at = lambda x, y, name: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(name).alias("source"))
    tiers = {
        "prev_crop_continuity": F.when(gap.between(0.0, 2.0) & (F.col("_p.confidence") >= 0.5), at(F.col("_p.subject_x"), F.lit(50.0), "prev_crop_continuity")),
        "saliency_peak": F.when(F.col("_peak").isNotNull(), at(F.col("_peak.x"), F.col("_peak.y"), "saliency_peak")),
        "face_centroid": F.when(F.col("_fx").isNotNull(), at(F.col("_fx"), F.col("_fy"), "face_centroid")),
        "motion_proxy": F.when(F.col("_mx").isNotNull(), at(F.col("_mx"), F.col("_my"), "motion_proxy")),
        "active_speaker_slot": F.when(F.col("x_center").isNotNull(), at(F.col("x_center"), F.lit(50.0), "active_speaker_slot")),
        "prev_anywhere": F.when(F.col("_p").isNotNull(), at(F.col("_p.subject_x"), F.lit(50.0), "prev_anywhere")),
        "hardcoded_center": at(F.lit(50.0), F.lit(50.0), "hardcoded_center"),
    }
    pick = F.coalesce(*[tiers[t] for t in order if t in tiers], at(F.lit(50.0), F.lit(50.0), "hardcoded_center_default"))
    pct = lambda c: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))).cast("long")
    return d.withColumn("r", pick).select(*key, pct(F.col("r.x")).alias("x"), pct(F.col("r.y")).alias("y"), F.col("r.source").alias("source"))


def timeline_summary(samples: DataFrame) -> DataFrame:
    """Sample, anchor and reset counts and the end time of each job."""
    return samples.groupBy("job_id").agg(F.count("*").alias("n_samples"), F.count_if("is_anchor").alias("n_anchors"), F.count_if("had_reset").alias("n_resets"), F.max("t").alias("duration"))


# --- anchors and model answers ---------------------------------------------------------------------

# Anchor signal weights (face, motion, contrast, saturation) by sub-type.
ANCHOR_WEIGHTS = {None: (0.50, 0.25, 0.15, 0.10), "action": (0.40, 0.40, 0.10, 0.10), "dialogue": (0.65, 0.10, 0.15, 0.10), "slice_of_life": (0.55, 0.20, 0.15, 0.10)}


def anchor_score(subtype: str | None = None) -> Column:
    """Weighted frame score and the position of its strongest signal, as struct(x, y, score, source).

    Reads face_score, motion_energy, contrast, saturation and the signals' x (and the face's y).
    """
    names = ("face", "motion", "contrast", "saturation")
    cols = ("face_score", "motion_energy", "contrast", "saturation")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    part = [w * unit(c) for w, c in zip(ANCHOR_WEIGHTS.get(subtype, ANCHOR_WEIGHTS[None]), cols)]
    xs = (F.col("face_x"), F.col("motion_x"), F.col("contrast_x"), F.lit(50.0))
    ys = (F.col("face_y"), F.lit(50.0), F.lit(50.0), F.lit(50.0))
    total = reduce(lambda a, b: a + b, part)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    best = F.array_max(F.array(*[F.struct(p.alias("c"), F.lit(-i).alias("o"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(n).alias("n")) for i, (p, x, y, n) in enumerate(zip(part, xs, ys, names))]))
    out = F.struct(best["x"].alias("x"), best["y"].alias("y"), score.alias("score"), best["n"].alias("source"))
    return F.when(best["c"] <= 1e-9, F.struct(F.lit(50.0).alias("x"), F.lit(50.0).alias("y"), F.lit(0.0).alias("score"), F.lit("fallback").alias("source"))).otherwise(out)


CLIP_FIELDS = ("id", "title", "start_time", "end_time", "duration", "viral_score", "hook_score", "flow_score", "value_score", "trend_score", "clip_type", "platform", "focus_relevance", "focus_tier")
FLAT_OBJECT = r"(\{(?:[^{}\"]|\"(?:\\.|[^\"\\])*\")*\})"


def axis_value(raw: Column, default: int = 0) -> Column:
    """Score field as an integer 0-100; missing or unreadable gives the default."""
    number = raw.try_cast("double")
    return F.when(number.isNull(), default).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)))).cast("long")


def clip_answers(answers: DataFrame, min_length: float = 15.0, max_length: float = 600.0) -> DataFrame:
    """Clip rows from raw model answers (answer_id, raw): thinking tags removed, every complete
    object after ``"clips": [`` read on its own, so truncated answers keep their whole clips.

    Fields are coerced and clamped; clips outside the length limits are dropped.
    """
    text = F.regexp_replace("raw", r"(?s)<(?:think|reasoning)>.*?</(?:think|reasoning)>", "")
    tail = F.regexp_extract(text, r"(?s)\"clips\"\s*:\s*\[(.*)", 1)
    d = answers.select("answer_id", F.posexplode(F.regexp_extract_all(tail, F.lit(FLAT_OBJECT), F.lit(1))).alias("pos", "obj"))
    obj = F.replace(F.replace("obj", F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    d = d.withColumn("j", F.from_json(obj, "map<string,string>")).where("j IS NOT NULL")
    get = lambda n: F.element_at("j", F.lit(n))
    num = lambda n: get(n).try_cast("double")
    start, end = F.coalesce(num("start_time"), F.lit(0.0)), F.coalesce(num("end_time"), F.lit(0.0))
    length = F.when(end - start <= 0, F.coalesce(num("duration"), F.lit(0.0))).otherwise(end - start)
    bad = (get("start_time").isNotNull() & num("start_time").isNull()) | (get("end_time").isNotNull() & num("end_time").isNull())
    axes = {a: axis_value(get(f"{a}_score")) for a in ("hook", "flow", "value", "trend")}
    some = F.filter(F.array(*axes.values()), lambda s: s > 0)
    mean = F.when(F.size(some) > 0, F.floor(F.aggregate(some, F.lit(0).cast("long"), lambda acc, s: acc + s) / F.size(some))).otherwise(50)
    viral = F.when(get("viral_score").isNotNull(), axis_value(get("viral_score"), 50)).otherwise(mean)
    d = d.where(~bad).select("answer_id", "pos", F.coalesce(get("title"), F.lit("Untitled")).alias("title"), start.alias("start"), end.alias("end"), length.alias("_len"), viral.cast("long").alias("viral_score"),
                             *[c.alias(f"{a}_score") for a, c in axes.items()], F.coalesce(get("clip_type"), F.lit("highlight")).alias("clip_type"), F.coalesce(get("platform"), F.lit("both")).alias("platform"),
                             F.when(get("focus_tier").isin("strong", "moderate", "weak"), get("focus_tier")).alias("focus_tier"),
                             F.when(num("focus_relevance").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(100), F.expr("CAST(try_cast(element_at(j, 'focus_relevance') AS double) AS bigint)")))).alias("focus_relevance"))
    none = (F.col("hook_score") + F.col("flow_score") + F.col("value_score") + F.col("trend_score")) == 0
    one = F.greatest(F.lit(1), F.least(F.lit(100), F.col("viral_score")))
    d = d.where(F.col("_len").between(min_length, max_length)).withColumns({"duration": F.round("_len", 1), "_none": none})
    filled = {f"{a}_score": F.when(F.col("_none"), F.lit(50) if a == "trend" else one).otherwise(F.col(f"{a}_score")) for a in axes}
    return d.withColumns(filled).drop("_len", "_none")


def clamp_box(box: Column) -> Column:
    """Box as ordered corners in 0-1, null when unusable or empty."""
    x1, x2 = F.least(box[0], box[2]), F.greatest(box[0], box[2])
    y1, y2 = F.least(box[1], box[3]), F.greatest(box[1], box[3])
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    ok = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull()) & (unit(x2) - unit(x1) >= 1e-6) & (unit(y2) - unit(y1) >= 1e-6)
    return F.when(ok, F.array(unit(x1), unit(y1), unit(x2), unit(y2)))


def confidence_value(raw: Column, default: float = 0.0) -> Column:
    """Confidence in 0-1; percentages are scaled."""
    v = raw.try_cast("double")
    v = F.when((v > 1.0) & (v <= 100.0), v / 100).otherwise(v)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), F.lit(default))


NO_SUBJECT = ("empty_frame", "abstract", "transition", "occluded")


def scene_answers(answers: DataFrame) -> DataFrame:
    """Typed scene rows from raw model answers (answer_id, raw, frame_t): a grounded box wins,
    else a box is made from the old horizontal position, else the centre."""
    schema = "timestamp string, description string, importance_score string, subject_box array<double>, subject_confidence string, subject_x string, no_subject_reason string, active_speaker_x string"
    d = answers.withColumn("j", F.from_json(F.regexp_extract("raw", r"(?s)(\{.*\})", 1), schema)).where("j IS NOT NULL")
    box = clamp_box(F.col("j.subject_box"))
    raw_x = F.regexp_replace(F.trim("j.subject_x"), "%$", "").try_cast("double")
    old = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(raw_x > 100, raw_x / 1024 * 100).otherwise(raw_x))), F.lit(50.0))
    d = d.withColumns({"_box": box, "_old": F.when(F.col("j.subject_x").isNotNull(), old)})
    strip = F.array(F.greatest(F.lit(0.0), F.col("_old") / 100 - 0.05), F.lit(0.0), F.least(F.lit(1.0), F.col("_old") / 100 + 0.05), F.lit(1.0))
    cx = (F.col("_box")[0] + F.col("_box")[2]) / 2 * 100
    importance = F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce(F.floor(F.col("j.importance_score").try_cast("double")), F.lit(5))))
    reason = F.when(F.col("j.no_subject_reason").isin(*NO_SUBJECT), F.col("j.no_subject_reason"))
    speaker = F.trim("j.active_speaker_x").try_cast("double")
    return d.select(
        "answer_id", F.coalesce(F.col("j.timestamp").try_cast("double"), "frame_t", F.lit(0.0)).alias("t"), F.coalesce("j.description", F.lit("")).alias("description"), importance.cast("long").alias("importance"),
        F.bround(F.coalesce(cx, "_old", F.lit(50.0))).cast("long").alias("subject_x"), F.coalesce("_box", F.when(F.col("_old").isNotNull(), strip)).alias("subject_box"),
        F.when(F.col("_box").isNotNull(), confidence_value(F.col("j.subject_confidence"))).when(F.col("_old").isNotNull(), 0.5).otherwise(0.0).alias("confidence"),
        F.when(F.col("_box").isNull(), F.when(F.col("_old").isNotNull(), reason).otherwise(F.coalesce(reason, F.lit("empty_frame")))).alias("no_subject_reason"),
        F.greatest(F.lit(0), F.least(F.lit(100), speaker.cast("long"))).alias("active_speaker_x"))


def tag_list(tags: Column, hashtags: Column) -> Column:
    """Tags with a leading #, plus hashtags not already among them."""
    bare = lambda t: F.lower(F.regexp_replace(t, "^#+", ""))
    have = F.transform(tags, bare)
    more = F.filter(hashtags, lambda h: ~F.array_contains(have, bare(h)))
    return F.transform(F.concat(tags, more), lambda t: F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t)))


