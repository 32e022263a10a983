"""Speaker timelines from lips, identities and speaking probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import cut_lineage, fold_sorted, islands, scan, time_block
from ..functions.ranges import points_in
from .joins import bridge_voice, off_screen, spikes_at
from .windows import collapse_short_runs, hysteresis, lock_events, merge_close, merge_slot_events, without_swing_kills

SEG = ["job_id", "seg_idx"]
SPEAKING, CONTINUITY = 0.025, 0.04


def lip_scores(segments: DataFrame, faces: DataFrame, words: DataFrame, window: float = 2.0) -> DataFrame:
    """Speaking score of each slot seen near a segment: lip motion times word sync.

    ``faces``: job_id, t, face_key, slot_id, w, lip; one face per slot and frame
    counts.  Words meet lip samples on time buckets; the samples outside a word
    are the slot's total minus those inside.
    """
    f = cut_lineage(faces.groupBy("job_id", "t", "slot_id").agg(F.min_by(F.struct("lip", "w"), "face_key").alias("r")).select("job_id", "t", "slot_id", "r.*"))
    span = lambda pad: segments.select(*SEG, F.col("start").alias("g_start"), F.col("end").alias("g_end"), (F.col("start") - pad).alias("_from"), (F.col("end") + pad).alias("_to"))
    seen = points_in(f, span(window), ["job_id"], 10.0, span=("_from", "_to")).groupBy(*SEG, "slot_id").agg(F.min("t").alias("first_t"))
    key = [*SEG, "slot_id"]
    near = points_in(f, span(0.5), ["job_id"], 10.0, span=("_from", "_to")).select(*key, "t", "lip", "w")
    near = scan(near, key, ["t"], time_block("t"), prev={"_p": F.struct("t", "lip")})
    speed = F.abs(F.col("lip") - F.col("_p.lip")) / (F.col("t") - F.col("_p.t"))
    m = near.groupBy(*key).agg(F.count("*").alias("_n"), F.avg("lip").alias("_a"), F.avg("w").alias("_w"), (F.max("t") - F.min("t")).alias("_dt"), F.avg(speed).alias("_v"))
    rate = F.when(F.col("_dt") > 0, (F.col("_n") - 1) / F.greatest(F.col("_dt"), F.lit(0.01))).otherwise(0.0)
    slow = F.least(F.lit(1.0), F.col("_a") * F.least(F.lit(2.0), F.col("_w") / 8) / 0.04)
    fast = F.least(F.lit(1.0), F.col("_v") / 0.08) * 0.6 + F.least(F.lit(1.0), F.col("_a") / 0.04) * 0.4
    m = m.select(*key, F.when(F.col("_n") < 2, F.col("_a")).when(rate < 4.0, slow).otherwise(F.coalesce(fast, F.lit(0.0))).alias("motion"))
    tight = points_in(f, span(0.2), ["job_id"], 10.0, span=("_from", "_to")).select(*key, "t", "lip")
    total = tight.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("lip").alias("_sum")).where("_n >= 3")
    long = words.groupBy(*SEG).agg(F.count("*").alias("_k")).where("_k >= 2").select(*SEG)
    w = words.join(long, SEG, "left_semi").select(*SEG, "word_idx", (F.col("start") - 0.1).alias("_from"), (F.col("end") + 0.1).alias("_to"))
    during = points_in(tight, w, ["job_id", "seg_idx"], 2.0, span=("_from", "_to")).groupBy(*key, "word_idx").agg(F.count("*").alias("_dn"), F.sum("lip").alias("_ds"))
    d = during.join(total, key).where(F.col("_n") > F.col("_dn"))
    inside, outside = F.col("_ds") / F.col("_dn"), (F.col("_sum") - F.col("_ds")) / (F.col("_n") - F.col("_dn"))
    score = F.when(outside > 1e-12, F.least(F.lit(1.0), inside / outside / 2)).otherwise((inside > 0.02).cast("double"))
    sync = d.groupBy(*key).agg(F.avg(score).alias("sync"))
    d = seen.join(m, key, "left").join(sync, key, "left").fillna({"motion": 0.0, "sync": 0.5})
    return d.select(*key, "first_t", (F.col("motion") * (0.7 + 0.6 * F.col("sync"))).alias("score"))


def best_slots(segments: DataFrame, scores: DataFrame, floor: float | None = SPEAKING, bonus: float = CONTINUITY) -> DataFrame:
    """Event per segment: the best slot, with a bonus for the slot of the event before; under
    the floor the slot is -1.

    The bonus depends on the previous choice, so segments are taken in order; a
    segment has a handful of slots, which travel as one array.
    """
    s = scores.groupBy(*SEG).agg(F.sort_array(F.collect_list(F.struct("first_t", "slot_id", "score"))).alias("s"))
    d = segments.select(*SEG, "start", "end").join(s, SEG, "left")
    d = d.select(*SEG, "start", "end", F.transform("s", lambda r: r["slot_id"]).alias("ids"), F.transform("s", lambda r: r["score"]).alias("vals"))

    def step(last, row):
        job, idx, start, end, ids, vals = row
        if ids is None or len(ids) == 0:
            return -1, [(job, idx, start, end, -1, 0.0)]
        score = dict(zip(ids, vals))
        if last >= 0 and last in score:
            score[last] += bonus
        best = max(score, key=score.get)
        slot = best if floor is None or score[best] >= floor else -1
        return slot, [(job, idx, start, end, slot, min(1.0, score[best] / 0.05))]

    job_type = segments.schema["job_id"].dataType.simpleString()
    return fold_sorted(d, ["job_id"], ["seg_idx"], f"job_id {job_type}, event_id bigint, start double, end double, slot_id bigint, confidence double", lambda: -1, step)


def _finish(events: DataFrame, segments: DataFrame, cuts: DataFrame | None, lips: DataFrame | None, voiced: DataFrame | None) -> DataFrame:
    """Shared tail of all timelines: short runs, off-screen flags, voice bridging."""
    d = collapse_short_runs(cut_lineage(events)).withColumn("event_id", F.col("run")).drop("run")
    d = off_screen(d, segments, cuts, lips) if cuts is not None and lips is not None else d.withColumn("on_screen", F.lit(True))
    return bridge_voice(d, voiced) if voiced is not None else d


def lip_timeline(segments: DataFrame, faces: DataFrame, words: DataFrame, cuts=None, voiced=None) -> DataFrame:
    """Active speaker events from lip activity alone, with switch suppression."""
    ev = best_slots(segments, lip_scores(segments, faces, words, 2.0))
    ev = hysteresis(merge_slot_events(cut_lineage(ev), 1.0)).withColumn("event_id", F.round(F.col("start") * 1000).cast("long"))
    return _finish(ev, segments, cuts, faces.where("lip > 0.03") if cuts is not None else None, voiced)


def revert_to_dominant(events: DataFrame) -> DataFrame:
    """Give low-confidence switches away from a dominant speaker back to that speaker.

    A reverted stretch follows an event of the dominant slot without a break, so
    the last event that stays decides and each further one loses a tenth.
    """
    time = events.where("slot_id >= 0").groupBy("job_id", "slot_id").agg(F.sum(F.col("end") - F.col("start")).alias("_s"), F.min("start").alias("_at"))
    job = time.groupBy("job_id").agg(F.max_by(F.struct("slot_id", "_s"), F.struct("_s", -F.col("_at"))).alias("_d"), F.sum("_s").alias("_t"), F.count_if(F.col("_s") > 5.0).alias("_k"))
    part = F.col("_d._s") / F.greatest(F.col("_t"), F.lit(0.1))
    job = job.select("job_id", F.col("_d.slot_id").alias("_dom"), F.when(F.col("_k") >= 4, F.when(part > 0.70, 0.3)).when(part > 0.4, 0.5).alias("_limit"))
    d = events.join(job, "job_id", "left").withColumn("_weak", F.coalesce((F.col("slot_id") != F.col("_dom")) & (F.col("confidence") < F.col("_limit")), F.lit(False)))
    order = ["start", "run"]
    d = scan(d, ["job_id"], order, time_block("start"), total={"_n": F.lit(1).cast("long")})
    keep = F.when(~F.col("_weak"), F.struct("slot_id", "confidence", "_n"))
    d = scan(d, ["job_id"], order, time_block("start"), fill={"_last": keep})
    back = F.col("_weak") & (F.col("_last.slot_id") == F.col("_dom"))
    conf = F.col("_last.confidence") * F.pow(F.lit(0.9), F.col("_n") - F.col("_last._n"))
    return d.withColumns({"confidence": F.when(back, conf).otherwise(F.col("confidence")), "slot_id": F.when(back, F.col("_dom")).otherwise(F.col("slot_id"))}).drop("_dom", "_limit", "_weak", "_n", "_last")


def identity_timeline(segments: DataFrame, faces: DataFrame, words: DataFrame, cuts=None, voiced=None) -> DataFrame:
    """Active speaker events keyed by face identity, with dominant-speaker reversion."""
    known = faces.where("slot_id >= 0")
    ev = cut_lineage(best_slots(segments, lip_scores(segments, known, words, 1.0), floor=None))
    ev = revert_to_dominant(merge_slot_events(ev, 1.0)).withColumn("event_id", F.col("run")).drop("run")
    ev = merge_slot_events(cut_lineage(ev), 1.0).withColumn("event_id", F.col("run")).drop("run")
    return _finish(ev, segments, cuts, known.where("lip > 0.03") if cuts is not None else None, voiced)


def probability_events(segments: DataFrame, faces: DataFrame, scores: DataFrame, window: float = 0.5, floor: float = 0.5) -> DataFrame:
    """Events of every identity whose speaking probability reaches the floor near a segment,
    several at once where speech overlaps; a segment without one is an off-screen event.

    ``faces``: job_id, t, face_idx, slot_id; ``scores``: job_id, t, face_idx, p.
    """
    f = faces.where("slot_id >= 0").select("job_id", F.round("t", 3).alias("t"), "face_idx", "slot_id")
    p = scores.select("job_id", F.round("t", 3).alias("t"), "face_idx", "p")
    f = f.join(p, ["job_id", "t", "face_idx"], "left").fillna(0.0, ["p"])
    wide = segments.select(*SEG, "start", "end", (F.col("start") - window).alias("_from"), (F.col("end") + window).alias("_to"))
    per = points_in(f, wide, ["job_id"], 10.0, span=("_from", "_to")).groupBy(*SEG, "slot_id").agg(F.max("p").alias("_top"), F.avg("p").alias("_avg")).where(F.col("_top") >= floor)
    d = segments.select(*SEG, "start", "end").join(per, SEG, "left")
    return d.select("job_id", "seg_idx", "start", "end", F.coalesce("slot_id", F.lit(-1)).alias("slot_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_avg", F.lit(0.0)))).alias("confidence"))


def probability_timeline(segments: DataFrame, faces: DataFrame, scores: DataFrame, cuts=None, lips=None, voiced=None) -> DataFrame:
    """Probability events merged per slot over gaps under 1 s, then the shared tail."""
    ev = probability_events(segments, faces, scores).withColumn("event_id", F.col("seg_idx"))
    lanes = merge_lanes(cut_lineage(ev), 1.0)
    ev = lanes.withColumn("event_id", F.col("slot_id") + 1 + F.col("run") * 1000)
    return _finish(ev.drop("run"), segments, cuts, lips, voiced)


def merge_lanes(events: DataFrame, gap: float) -> DataFrame:
    """Events of each slot on its own, joined over gaps under ``gap``."""
    d = islands(events, ["job_id", "slot_id"], ["start", "event_id"], time_block("start"), ["start", "end"], lambda p, c: c["start"] - p["end"] >= gap, "run")
    at = F.struct("start", "event_id")
    return d.groupBy("job_id", "slot_id", "run").agg(F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.max("confidence").alias("confidence"))


def game_events(spikes: DataFrame, envelope: DataFrame, path: DataFrame | None = None) -> DataFrame:
    """Game events from difference spikes of screen zones, confirmed by sound, plus aim locks.

    ``spikes``: job_id, zone (killfeed, ability, minimap), spike_id, start, end.
    Ability spikes need a sound spike, kill spikes gain confidence from one, and
    kills during a fast aim swing are dropped.  Close events merge.
    """
    s = spikes.withColumn("t", (F.col("start") + F.col("end")) / 2)
    s = spikes_at(s, envelope, "spike_id").where((F.col("zone") != "ability") | F.col("spike"))
    kind = F.when(F.col("zone") == "killfeed", "kill").when(F.col("zone") == "ability", "ult").otherwise("rotation")
    conf = F.when(F.col("zone") == "killfeed", F.when(F.col("spike"), 0.75).otherwise(0.55)).when(F.col("zone") == "ability", 0.7).otherwise(0.55)
    least = F.when(F.col("zone") == "minimap", 1.2).otherwise(0.8)
    ev = s.select("job_id", F.col("spike_id").alias("event_id"), "t", kind.alias("kind"), conf.alias("confidence"), F.greatest(F.col("end") - F.col("start"), least).alias("event_len"))
    if path is not None:
        lock = lock_events(path, envelope).select("job_id", (-F.round(F.col("t") * 1000)).cast("long").alias("event_id"), "t", F.lit("locked_on").alias("kind"), F.lit(0.65).alias("confidence"), F.lit(0.8).alias("event_len"))
        ev = without_swing_kills(cut_lineage(ev.unionByName(lock)), path)
    return merge_close(cut_lineage(ev))
