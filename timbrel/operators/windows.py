"""Gaps and islands, smoothing and other ordered operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import cut_lineage, ema, fold_sorted, index_block, islands, keep_spaced, numbered, pick_ranks, scan, time_block, with_halo
from ..functions.ranges import as_of, points_in
from .joins import snap_to_grid, spikes_at

SEG_BLOCK = "seg_idx"


def _by_index(segments: DataFrame, **kw) -> DataFrame:
    return scan(segments, ["job_id"], ["seg_idx"], index_block("seg_idx"), **kw)


def natural_boundaries(segments: DataFrame, pause: float = 1.5) -> DataFrame:
    """Starts of segments that follow another speaker or a long pause."""
    d = _by_index(segments, prev={"_p": F.struct("speaker", "end")})
    turn = F.col("speaker") != F.col("_p.speaker")
    return d.where(turn | (F.col("start") - F.col("_p.end") > pause)).select("job_id", "seg_idx", "start")


# Phrases of each transcript signal, matched as substrings.
SIGNAL_PHRASES = {
    "reaction": ("haha", "lol", "laugh", "[laughter]", "wow", "oh my", "oh no", "omg", "damn", "holy"),
    "disagreement": ("i disagree", "that's not true", "no way", "absolutely not", "you're wrong", "that's not right", "i don't think so",
                     "but actually", "hold on", "wait a minute"),
    "personal_story": ("when i was", "i remember", "true story", "this happened to me", "i've never told", "for the first time", "i was so",
                       "i couldn't believe"),
    "reveal": ("the truth is", "turns out", "plot twist", "nobody knows", "secret", "finally", "breaking", "just found out", "guess what",
               "you won't believe"),
    "hot_take": ("the best", "the worst", "overrated", "underrated", "goat", "mid", "trash", "fire", "elite", "nobody can"),
}


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def energy_signals(segments: DataFrame, limit: int = 30) -> DataFrame:
    """Engagement signals of each segment in a fixed order; the first ``limit`` rows per job."""
    d = _by_index(segments, prev={"_p": F.struct("speaker", "end")})
    text = F.trim("text")
    low = F.lower(text)
    words = split_words(text)
    tests = {
        "emphasis": text.contains("!"), "question": text.contains("?"),
        "raised_voice": F.exists(words, lambda w: (w == F.upper(w)) & (F.length(w) > 2) & w.rlike(r"^\p{L}+$")),
        "rapid_exchange": (F.col("start") - F.col("_p.end") < 0.5) & (F.size(words) < 15),
        "speaker_change": F.col("speaker") != F.col("_p.speaker"), "extended_speech": F.size(words) > 50,
        "reaction": has_any(low, SIGNAL_PHRASES["reaction"]), "disagreement": has_any(low, SIGNAL_PHRASES["disagreement"]),
        "personal_story": has_any(low, SIGNAL_PHRASES["personal_story"]), "reveal": has_any(low, SIGNAL_PHRASES["reveal"]),
        "ranking": low.rlike("number [1-9]|#[1-9]"), "hot_take": has_any(low, SIGNAL_PHRASES["hot_take"]), "low_confidence": F.col("confidence") < 0.4,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))
    d = d.where(text != "").withColumn("signals", found).where(F.size("signals") > 0)
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("seg_idx"))
    return d.withColumn("rank", rank).where(F.col("rank") <= limit).select("job_id", "seg_idx", "start", F.array_join("signals", ", ").alias("signals"))


# Whole-segment fillers, single filler words.
FILLER_PHRASES = ("um", "uh", "uh huh", "you know", "i mean", "like", "basically", "literally", "actually", "right", "so yeah", "kind of", "sort of")
FILLER_WORDS = ("um", "uh", "hmm", "huh")


def filler_events(segments: DataFrame, words: DataFrame, phrases: tuple[str, ...] = FILLER_PHRASES, pause: float = 1.5) -> DataFrame:
    """Fillers, immediate repetitions and silences with their times."""
    low = F.lower(F.trim("text"))
    key = ["job_id", "seg_idx", "start", "end"]
    whole = segments.where(low.isin(*phrases)).select(*key, F.lit("filler").alias("type"), F.trim("text").alias("text"))
    rest = segments.where(~low.isin(*phrases))
    spoken = F.rtrim(F.lower(F.trim("word")), F.lit(".,!?"))
    single = words.where(spoken.isin(*FILLER_WORDS)).select(*key, F.lit("filler").alias("type"), F.trim("word").alias("text"))
    single = single.join(rest.select("job_id", "seg_idx"), ["job_id", "seg_idx"], "left_semi")
    ws = split_words(low)
    twice = F.filter(F.arrays_zip(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))).alias("a"), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))).alias("b")),
                     lambda p: (p["a"] == p["b"]) & (F.length(p["a"]) > 1))
    again = rest.where(F.size(ws) > 1).withColumn("_r", F.get(twice, F.lit(0))).where("_r IS NOT NULL")
    again = again.select(*key, F.lit("repetition").alias("type"), F.concat_ws(" ", "_r.a", "_r.b").alias("text"))
    gaps = _by_index(segments, prev={"_pe": F.col("end")}).where(F.col("start") - F.col("_pe") > pause)
    gaps = gaps.select("job_id", "seg_idx", F.col("_pe").alias("start"), F.col("start").alias("end"), F.lit("dead_air").alias("type"),
                       F.format_string("%.1fs silence", F.col("start") - F.col("_pe")).alias("text"))
    return whole.unionByName(single).unionByName(again).unionByName(gaps)


def speaker_runs(segments: DataFrame) -> DataFrame:
    return islands(segments, ["job_id"], ["seg_idx"], index_block("seg_idx"), ["speaker"], lambda p, c: ~p["speaker"].eqNullSafe(c["speaker"]), "run")


def speaker_hold_boundaries(segments: DataFrame, hold: float = 20.0) -> DataFrame:
    """Speaker changes after the previous speaker held the floor long enough."""
    runs = speaker_runs(segments).groupBy("job_id", "run").agg(F.min_by("start", "seg_idx").alias("start"))
    d = scan(runs, ["job_id"], ["run"], index_block("run"), prev={"_ps": F.col("start")})
    return d.where(F.col("start") - F.col("_ps") >= hold).select("job_id", F.round("start", 1).alias("t"))


def merged_turns(segments: DataFrame) -> DataFrame:
    """Consecutive rows of one speaker as one turn.

    Confidence is the running mean (old + new) / 2, which is a weighted sum with
    weights halving away from the end of the run.
    """
    runs = numbered(speaker_runs(segments), ["job_id", "run"], ["seg_idx"], index_block("seg_idx"), "_n")
    size = runs.groupBy("job_id", "run").agg(F.max("_n").alias("_size"))
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    weight = F.pow(F.lit(0.5), F.when(F.col("_n") == 1, F.col("_size") - 1).otherwise(F.col("_size") - F.col("_n") + 1))
    return runs.join(size, ["job_id", "run"]).groupBy("job_id", "run", "speaker").agg(
        F.min_by("start", "seg_idx").alias("start"), F.max_by("end", "seg_idx").alias("end"), F.sum(conf * weight).alias("confidence"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), " ").alias("text"))


EVENT_ORDER = ["start", "event_id"]


def merge_slot_events(events: DataFrame, gap: float | None = 1.0) -> DataFrame:
    """Adjacent events of one slot (closer than ``gap``, or at any distance) as one, with the top confidence."""
    def breaks(p: Column, c: Column) -> Column:
        other = p["slot_id"] != c["slot_id"]
        return other if gap is None else other | (c["start"] - p["end"] >= gap)

    d = islands(events, ["job_id"], EVENT_ORDER, time_block("start"), ["slot_id", "start", "end"], breaks, "run")
    at = F.struct(*EVENT_ORDER)
    return d.groupBy("job_id", "run", "slot_id").agg(F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.max("confidence").alias("confidence"))


#: Events of a job that one block of the switch rule holds.
SWITCH_ROWS = 512


class SwitchRule:
    """What a block of ordered events does to the event that is current when it begins.

    A current event stays until a switch, and a switch forgets it.  So a block sends the entry to one
    of its own events that start afresh, or keeps it; and what each own start leads to is the same
    for every entry.  While an entry is kept, its confidence is its own one, decayed some times, or a
    value known from the block, whichever is larger: decay and maximum keep the order of numbers, so
    the two can be followed apart, in floating point too.
    """

    def __init__(self, slots, confs, attack: float, release: float, decay: float, top: float = float("inf")):
        self.slots, self.confs, self.n = list(slots), list(confs), len(slots)
        self.attack, self.release, self.decay, self.top = attack, release, decay, top

    def hold(self, i: int, slot: int, conf: float) -> tuple[int, float]:
        """First event from ``i`` on that replaces the current one, and its confidence until then."""
        for at in range(i, self.n):
            if self.slots[at] == slot:
                conf = max(conf, self.confs[at])
            elif self.slots[at] < 0 or self.confs[at] >= self.attack or conf < self.release:
                return at, conf
            else:
                conf *= self.decay
        return self.n, conf

    def map_of(self) -> list[tuple]:
        """Rows (slot, decays, floor, at) for entries of this slot (null: any other), in order.

        Where floor is null, the entry is replaced at ``at`` if its confidence is below the release
        after so many decays.  The last row of a slot is for what is left: it is replaced at ``at``, or, where
        that is null, kept to the end with its decayed confidence, but at least ``floor``.  As no entry
        is above ``top``, a slot has some dozens of rows at most with the usual limits.
        """
        out = []
        for slot in [*dict.fromkeys(self.slots), None]:
            decays, floor, most, gone = 0, float("-inf"), self.top, None
            for at in range(self.n):
                if self.slots[at] == slot:
                    floor = max(floor, self.confs[at])
                elif self.slots[at] < 0 or self.confs[at] >= self.attack or max(most, floor) < self.release:
                    gone = at
                    break
                else:
                    if floor < self.release:
                        out.append((slot, decays, None, at))
                    decays, floor, most = decays + 1, floor * self.decay, most * self.decay
            out.append((slot, decays, floor, gone))
        return out

    def exits(self, starts: list[int]) -> dict[int, tuple[int, float]]:
        """Last start and its confidence at the end of the block, for every start in question."""
        known: dict[int, tuple[int, float]] = {}
        for first in starts:
            way, at = [], first
            while at not in known:
                way.append(at)
                then, conf = self.hold(at + 1, self.slots[at], self.confs[at])
                if then == self.n:
                    known[at] = (at, conf)
                else:
                    at = then
            for w in way:
                known[w] = known[at]
        return known


def _after(entry: tuple, rules: list, decay: float, release: float) -> tuple[int | None, float]:
    """Where an entry (slot, confidence) is replaced in a block, or null and its confidence at the end."""
    slot, conf = entry
    own = any(r[0] == slot for r in rules)
    done = 0
    for s, decays, floor, at in rules:
        if s != (slot if own else None):
            continue
        while done < decays:
            conf, done = conf * decay, done + 1
        if floor is None:
            if conf < release:
                return at, conf
        else:
            return at, max(conf, floor)
    raise ValueError("a block without a rule for its entry")


def hysteresis(events: DataFrame, attack: float = 0.7, release: float = 0.3, decay: float = 0.95, rows: int = SWITCH_ROWS) -> DataFrame:
    """Suppress low-confidence slot switches: a switch needs a strong new event or a weak
    current one; a suppressed event extends the current one and decays it.

    Blocks of a job's events turn into maps from the current event before them to the one after them
    side by side, one pass over the maps gives each block its entry, and the blocks then make their
    part of the result side by side.  Events have start, run, end, slot_id and confidence, none of
    them null, and go by start, then run.
    """
    job_type = events.schema["job_id"].dataType.simpleString()
    d = events.select("job_id", F.col("start").cast("double").alias("start"), F.col("run").cast("long").alias("run"), F.col("end").cast("double").alias("end"),
                      F.col("slot_id").cast("long").alias("slot_id"), F.col("confidence").cast("double").alias("confidence"))
    d = cut_lineage(d)
    top = d.agg(F.max("confidence")).first()[0] if decay <= 1 else None
    top = float("inf") if top is None else top
    d = numbered(d, ["job_id"], ["start", "run"], time_block("start"), "_at")
    event = F.struct("_at", "start", "end", "slot_id", "confidence")
    blocks = cut_lineage(d.groupBy("job_id", F.floor((F.col("_at") - 1) / rows).alias("_b")).agg(F.sort_array(F.collect_list(event)).alias("_e")))

    def rule_of(e) -> SwitchRule:
        return SwitchRule([x["slot_id"] for x in e], [x["confidence"] for x in e], attack, release, decay, top)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for job, b, e in zip(pdf["job_id"], pdf["_b"], pdf["_e"]):
                rule = rule_of(e)
                rules = rule.map_of()
                ends = rule.exits(sorted({0, *(r[3] for r in rules if r[3] is not None)}))
                out.append((job, b, [dict(zip(("slot", "decays", "floor", "at"), r)) for r in rules],
                            [{"at": at, "last": last, "slot": rule.slots[last], "conf": conf} for at, (last, conf) in ends.items()]))
            yield pd.DataFrame(out, columns=["job_id", "_b", "_rules", "_ends"])

    maps = blocks.mapInPandas(make, f"job_id {job_type}, _b long, _rules array<struct<slot:long,decays:int,floor:double,at:int>>, _ends array<struct<at:int,last:int,slot:long,conf:double>>")

    def step(entry, row):
        job, b, rules, ends = row
        at, conf = (0, 0.0) if entry is None else _after(entry[:2], [(r["slot"], r["decays"], r["floor"], r["at"]) for r in rules], decay, release)
        given = (job, b, *(entry or (None, None, None)))
        if at is None:
            return (entry[0], conf, entry[2]), [given]
        end = next(x for x in ends if x["at"] == at)
        return (end["slot"], end["conf"], b * rows + end["last"] + 1), [given]

    entries = fold_sorted(maps, ["job_id"], ["_b"], f"job_id {job_type}, _b long, _slot long, _conf double, _from long", lambda: None, step)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for job, e, slot, conf, since in zip(pdf["job_id"], pdf["_e"], pdf["_slot"], pdf["_conf"], pdf["_from"]):
                rule, at = rule_of(e), 0
                if since == since and since is not None:
                    at, conf = rule.hold(0, slot, conf)
                    if at > 0:
                        out.append((job, int(since), e[at - 1]["_at"], None, e[at - 1]["end"], int(slot), conf))
                while at < rule.n:
                    then, conf = rule.hold(at + 1, rule.slots[at], rule.confs[at])
                    out.append((job, e[at]["_at"], e[then - 1]["_at"], e[at]["start"], e[then - 1]["end"], rule.slots[at], conf))
                    at = then
            yield pd.DataFrame(out, columns=["job_id", "_from", "_to", "start", "end", "slot_id", "confidence"]).astype(object)

    same = F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("_b") == F.col("_block"))
    entered = entries.select(F.col("job_id").alias("_job"), F.col("_b").alias("_block"), "_slot", "_conf", "_from")
    parts = blocks.join(entered, same).select("job_id", "_e", "_slot", "_conf", "_from").mapInPandas(
        settle, f"job_id {job_type}, _from long, _to long, start double, end double, slot_id long, confidence double")
    return parts.groupBy("job_id", "_from").agg(
        F.max("start").alias("start"), F.max_by("end", "_to").alias("end"), F.first("slot_id").alias("slot_id"), F.max_by("confidence", "_to").alias("confidence")).drop("_from")


def collapse_short_runs(events: DataFrame, dwell: float = 0.6, margin: float = 0.08) -> DataFrame:
    """Give runs shorter than ``dwell`` to the more confident neighbour, unless they
    beat both neighbours by ``margin``.

    Runs of at least ``dwell`` and the outer runs never move, so each stretch of
    short runs between two of them is settled on its own.
    """
    runs = merge_slot_events(events, None)
    d = scan(cut_lineage(runs), ["job_id"], ["run"], index_block("run"), prev={"_p": F.lit(True)}, nxt={"_n": F.lit(True)})
    fixed = (F.col("end") - F.col("start") >= dwell) | F.col("_p").isNull() | F.col("_n").isNull()
    d = d.withColumn("_fixed", fixed)
    d = scan(d, ["job_id"], ["run"], index_block("run"), total={"_grp": F.col("_fixed").cast("long")})
    tails = d.where("_fixed AND _grp > 1").withColumn("_grp", F.col("_grp") - 1)
    d = d.unionByName(tails).select("job_id", "_grp", "run", "start", "end", "slot_id", "confidence", "_fixed")

    def settle(rows):
        i = 1
        while i < len(rows) - 1:
            r, p, n = rows[i], rows[i - 1], rows[i + 1]
            stays = r[4] - r[3] >= dwell or (r[6] - p[6] >= margin and r[6] - n[6] >= margin)
            if stays or r[7]:
                i += 1
                continue
            if p[6] >= n[6]:
                p[4] = r[4]
            else:
                n[3] = r[3]
            del rows[i]
            i = max(1, i - 1)
        return [(r[0], r[2], r[3], r[4], r[5], r[6]) for r in rows]

    job_type = events.schema["job_id"].dataType.simpleString()
    schema = f"job_id {job_type}, run bigint, start double, end double, slot_id bigint, confidence double"
    out = fold_sorted(d, ["job_id", "_grp"], ["run"], schema, list, lambda rows, row: (rows + [list(row)], []), settle)
    out = out.groupBy("job_id", "run", "slot_id", "confidence").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("event_id", F.col("run")).drop("run")
    return merge_slot_events(out, None)


def runs_where(samples: DataFrame, ok: Column, keys: list[str], order: list[str], max_gap: float | None = 1.0, min_length: float = 0.5, value: str = "value") -> DataFrame:
    """Maximal runs of consecutive samples that satisfy ``ok``; a gap over ``max_gap`` also breaks."""
    t = order[0]
    d = samples.withColumn("_ok", F.coalesce(ok, F.lit(False)))

    def breaks(p: Column, c: Column) -> Column:
        flip = p["_ok"] != c["_ok"]
        return flip if max_gap is None else flip | (c[t] - p[t] > max_gap)

    runs = islands(d, keys, order, time_block(t), ["_ok", t], breaks, "run").where("_ok")
    g = runs.groupBy(*keys, "run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.min(value).alias("low"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    return g.where(F.col("end") - F.col("start") >= min_length)


def ambiguous_windows(margins: DataFrame, limit: float = 0.3, min_length: float = 0.5) -> DataFrame:
    """Stretches where the margin between candidates is small, with the smallest margin and midpoint."""
    w = runs_where(margins, F.col("value") < limit, ["job_id"], ["t", "sample_id"], 1.0, min_length)
    return w.select("job_id", "run", "start", "end", F.least(F.col("low"), F.lit(1.0)).alias("low"), ((F.col("start") + F.col("end")) / 2).alias("midpoint"))


def tiebreak(heuristic: Column, detector: Column, model: Column, confidence: Column) -> Column:
    """Final choice of an ambiguous window as struct(choice, source, confidence)."""
    def out(choice, source, conf):
        return F.struct(choice.alias("choice"), F.lit(source).alias("source"), conf.alias("confidence"))

    return (
        F.when(detector.isNotNull() & (detector == heuristic), out(heuristic, "lightasd_agrees", F.least(F.lit(1.0), confidence + 0.6)))
        .when(detector.isNotNull() & model.isNotNull(), out(model, "vlm_tiebreak", F.lit(0.8)))
        .when(model.isNotNull() & detector.isNull(), out(model, "vlm_tiebreak", F.lit(0.7)))
        .otherwise(out(heuristic, "heuristic", confidence))
    )


def difference_spikes(readings: DataFrame, threshold: float, min_length: float, rate: float) -> DataFrame:
    """Runs of large changes between readings taken at most ``rate`` times a second."""
    kept = keep_spaced(readings.select("job_id", "t", "sample_id", "value"), ["job_id"], "t", 1.0 / max(rate, 0.1), ["t", "sample_id"])
    d = scan(kept, ["job_id"], ["t", "sample_id"], time_block("t"), prev={"_pv": F.col("value")}).where("_pv IS NOT NULL")
    d = d.withColumn("value", F.abs(F.col("value") - F.col("_pv")))
    return runs_where(d, F.col("value") >= threshold, ["job_id"], ["t", "sample_id"], None, min_length).select("job_id", "start", "end")


def low_score_windows(scores: DataFrame, threshold: float, max_gap: float = 0.5) -> DataFrame:
    """Low-scoring frames joined over gaps up to ``max_gap``, with mean score and advice."""
    low = scores.where(F.col("value") < threshold)
    d = runs_where(low, F.lit(True), ["job_id"], ["t", "sample_id"], max_gap, 0.0)
    advice = F.when(F.col("mean") < 3.0, "blur_fill").when(F.col("mean") < 4.5, "widen").when(F.col("mean") < 5.5, "more_padding").otherwise("hold")
    return d.select("job_id", "start", "end", "mean", advice.alias("action"))


def speeds(path: DataFrame) -> DataFrame:
    """Speed between consecutive path samples."""
    d = scan(path, ["job_id"], ["t", "sample_id"], time_block("t"), prev={"_p": F.struct("t", "x", "y")})
    dt = F.greatest(F.col("t") - F.col("_p.t"), F.lit(1e-6))
    return d.where("_p IS NOT NULL").withColumns({
        "prev_t": F.col("_p.t"), "speed": F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")) / dt, "x_speed": F.abs(F.col("x") - F.col("_p.x")) / dt}).drop("_p")


def still_windows(path: DataFrame, still: float = 2.0, min_length: float = 0.5) -> DataFrame:
    """Stretches whose sample-to-sample speed stays at or under ``still``."""
    d = speeds(path).withColumn("_slow", F.col("speed") <= still)
    runs = islands(d, ["job_id"], ["t", "sample_id"], time_block("t"), ["_slow"], lambda p, c: p["_slow"] != c["_slow"], "run").where("_slow")
    g = runs.groupBy("job_id", "run").agg(F.min("prev_t").alias("start"), F.max("t").alias("end")).where(F.col("end") - F.col("start") >= min_length)
    return g.withColumn("t", (F.col("start") + F.col("end")) / 2)


def lock_events(path: DataFrame, envelope: DataFrame, **limits) -> DataFrame:
    """Still windows whose middle coincides with an audio spike."""
    return spikes_at(still_windows(path, **limits), envelope, "run").where("spike").select("job_id", "start", "end", "t")


def without_swing_kills(events: DataFrame, path: DataFrame, limit: float = 20.0) -> DataFrame:
    """Drop kill events during a fast swing between the surrounding path samples."""
    got = as_of(events, path.select("job_id", F.col("t").alias("_pt"), "x", "y"), ["job_id"], "t", "_pt", ["x", "y"])
    dt = F.greatest(F.col("after.t") - F.col("before.t"), F.lit(1e-6))
    speed = F.hypot(F.col("after.x") - F.col("before.x"), F.col("after.y") - F.col("before.y")) / dt
    return got.where((F.col("kind") != "kill") | speed.isNull() | (speed <= limit)).drop("before", "after")


def merge_close(events: DataFrame, window: float = 1.5, least: float = 0.8) -> DataFrame:
    """Events within ``window`` of the FIRST event of their group become one "chaos" event.

    The first events are those that greedy thinning keeps, and each event belongs to the last of
    them up to it, so both steps run on blocks of a job.
    """
    order = ["t", "event_id"]
    first = keep_spaced(events.select("job_id", *order), ["job_id"], "t", window, order, strict=True)
    d = events.join(first.select("job_id", F.col("event_id"), F.lit(True).alias("_first")), ["job_id", "event_id"], "left")
    d = scan(d, ["job_id"], order, time_block("t"), fill={"_anchor": F.when(F.col("_first"), F.col("event_id"))})
    g = d.groupBy("job_id", "_anchor").agg(
        F.count("*").alias("n"), F.min("t").alias("t"), F.max(F.col("t") + F.col("event_len")).alias("_to"), F.min("kind").alias("_kind"), F.min("event_len").alias("_len"),
        F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("_kinds"))
    one = F.col("n") == 1
    return g.select("job_id", F.col("_anchor").alias("event_id"), "n", "t", F.when(one, F.col("_len")).otherwise(F.greatest(F.col("_to") - F.col("t"), F.lit(least))).alias("event_len"),
                    F.when(one, F.col("_kind")).otherwise("chaos").alias("kind"), "confidence", F.when(~one, F.concat(F.lit("merged:"), "_kinds")).alias("source"))


def adjacent_overlaps(rows: DataFrame, keys: list[str], order: list[str], slack: float = 1e-9) -> DataFrame:
    """Rows that end after the next row starts, with the overlap in seconds."""
    d = scan(rows, keys, order, time_block(order[0]), nxt={"_n": F.struct("start")})
    return d.where(F.col("end") > F.col("_n.start") + slack).withColumn("overlap", F.col("end") - F.col("_n.start")).drop("_n")


def smoothness(path: DataFrame) -> DataFrame:
    """Largest absolute second and third difference of x per job; short paths give 0."""
    order = ["t", "sample_id"]
    d = path
    for name, src in (("_d1", "x"), ("_d2", "_d1"), ("_d3", "_d2")):
        d = scan(d, ["job_id"], order, time_block("t"), prev={"_prev": F.col(src)}).withColumn(name, F.col(src) - F.col("_prev")).drop("_prev")
    return d.groupBy("job_id").agg(F.coalesce(F.max(F.abs("_d2")), F.lit(0.0)).alias("max_acceleration"), F.coalesce(F.max(F.abs("_d3")), F.lit(0.0)).alias("max_jerk"))


def switch_times(shots: DataFrame, shot_id: str) -> DataFrame:
    """Starts of shots whose slot differs from the shot before; two nulls are equal."""
    d = scan(shots, ["job_id"], ["start", shot_id], time_block("start"), prev={"_p": F.struct("active_slot")})
    return d.where(F.col("_p").isNotNull() & ~F.col("_p.active_slot").eqNullSafe(F.col("active_slot"))).select("job_id", shot_id, F.col("start").alias("t"))


def boundaries(shots: DataFrame, shot_id: str, skip_zero: bool = True) -> DataFrame:
    d = shots.where("start IS NOT NULL")
    return (d.where("start > 0") if skip_zero else d).select("job_id", shot_id, F.col("start").alias("t"))


def jump_cuts(path: DataFrame, least: float = 0.05) -> DataFrame:
    """Samples that moved further than ``least`` from the sample before."""
    d = scan(path, ["job_id"], ["t", "sample_id"], time_block("t"), prev={"_p": F.struct("x", "y")})
    return d.where(F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")) > least).select("job_id", "sample_id", "t")


# Signal weights (cuts, speakers, motion, audio) by content type.
PACING_WEIGHTS = {
    "narrative": (0.45, 0.10, 0.25, 0.20), "podcast": (0.05, 0.55, 0.05, 0.35), "gaming": (0.05, 0.00, 0.60, 0.35), "vlog": (0.15, 0.25, 0.35, 0.25),
    "sports": (0.20, 0.05, 0.55, 0.20), "music_video": (0.40, 0.00, 0.45, 0.15), "anime": (0.35, 0.15, 0.30, 0.20),
    "animation_dialogue": (0.30, 0.30, 0.20, 0.20), "unknown": (0.25, 0.25, 0.25, 0.25),
}


def second_grid(jobs: DataFrame) -> DataFrame:
    """One row per job and second; ``duration`` is rounded, at least one second."""
    n = F.greatest(F.lit(1), F.bround("duration").cast("long"))
    return jobs.withColumn("n_sec", n).select("job_id", "n_sec", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("sec"))


def cuts_per_second(cuts: DataFrame) -> DataFrame:
    return cuts.where("t > -1").groupBy("job_id", F.expr("CAST(t AS BIGINT)").alias("sec")).agg(F.count("*").cast("double").alias("cuts"))


def turns_per_second(events: DataFrame) -> DataFrame:
    d = scan(events, ["job_id"], EVENT_ORDER, time_block("start"), prev={"_p": F.col("slot_id")})
    return d.where(F.col("_p") != F.col("slot_id")).groupBy("job_id", F.expr("CAST(start AS BIGINT)").alias("sec")).agg(F.count("*").cast("double").alias("turns"))


def audio_per_second(buckets: DataFrame, per_second: int = 4) -> DataFrame:
    """Peakiness of the loudness buckets of each second: population std over mean."""
    g = buckets.groupBy("job_id", F.floor(F.col("bucket") / per_second).alias("sec")).agg(F.avg("rms").alias("_m"), F.stddev_pop("rms").alias("_s"))
    return g.select("job_id", "sec", F.when(F.col("_m") > 1e-6, F.col("_s") / F.col("_m")).otherwise(0.0).alias("audio"))


def motion_per_second(faces: DataFrame, n_jobs: DataFrame) -> DataFrame:
    """Change of the mean face position to the last second with faces, over the 95th
    percentile (linear) of the positive changes, clipped to 1.

    ``n_jobs`` gives n_sec per job; later faces are ignored.
    """
    sec = F.expr("CAST(t AS BIGINT)")
    m = faces.where("slot_id >= 0").groupBy("job_id", sec.alias("sec"), "t").agg(F.avg("x").alias("_x"))
    m = m.groupBy("job_id", "sec").agg(F.max_by("_x", "t").alias("_x")).join(n_jobs, "job_id").where("sec >= 0 AND sec < n_sec")
    m = cut_lineage(m)
    d = scan(m, ["job_id"], ["sec"], F.floor(F.col("sec") / 60), prev={"_px": F.col("_x")}).withColumn("_d", F.abs(F.col("_x") - F.col("_px")))
    pos = d.where("_d > 0")
    at = 0.95
    q = pick_ranks(pos, ["job_id"], "_d", {"_lo": lambda n: F.floor((n - 1) * at), "_hi": lambda n: F.ceil((n - 1) * at)}, F.floor(F.col("_d") / 5))
    part = (F.col("n") - 1) * at - F.floor((F.col("n") - 1) * at)
    q = q.select("job_id", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part).alias("_q"))
    return d.join(q, "job_id", "left").select("job_id", "sec", F.when(F.col("_q") > 0, F.least(F.lit(1.0), F.coalesce("_d", F.lit(0.0)) / F.col("_q"))).otherwise(0.0).alias("motion"))


def pacing(grid: DataFrame, signals: list[DataFrame], weights: tuple[float, float, float, float], reach: int = 4) -> DataFrame:
    """Pacing per second: +-4 s means of cuts, turns, motion and audio, each capped at 1,
    weighted, then a 3-tap median that leaves both ends as they are.

    Every second adds itself to its neighbours' sums with a partial aggregate,
    so a long job needs no ordered pass for the sliding mean.
    """
    names = ["cuts", "turns", "motion", "audio"]
    d = grid
    for s in signals:
        d = d.join(s, ["job_id", "sec"], "left")
    d = d.fillna(0.0, names)
    spread = d.select("job_id", "n_sec", *names, F.explode(F.sequence(F.greatest(F.lit(0), F.col("sec") - reach), F.least(F.col("n_sec") - 1, F.col("sec") + reach))).alias("sec"))
    s = spread.groupBy("job_id", "n_sec", "sec").agg(*[F.sum(n).alias(n) for n in names])
    size = F.least(F.col("n_sec"), F.col("sec") + reach + 1) - F.greatest(F.lit(0), F.col("sec") - reach)
    ref = {"cuts": 2.0, "turns": 1.0, "motion": 1.0, "audio": 1.0}
    raw = reduce(lambda a, b: a + b, [F.lit(w) * F.least(F.lit(1.0), F.col(n) / size / ref[n]) for n, w in zip(names, weights)])
    s = cut_lineage(s.select("job_id", "n_sec", "sec", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("raw")))
    m = scan(s, ["job_id"], ["sec"], F.floor(F.col("sec") / 60), prev={"_a": F.col("raw")}, nxt={"_b": F.col("raw")})
    three = F.sort_array(F.array("_a", "raw", "_b"))[1]
    return m.select("job_id", "sec", F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.col("raw")).otherwise(three).alias("pacing"))


def min_hold(score: Column, floor: float = 0.25, ceiling: float = 2.0, power: float = 0.75) -> Column:
    """Shortest hold in seconds for a pacing score."""
    return F.lit(ceiling) - F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), F.lit(power)) * (ceiling - floor)


def anticipation_ms(score: Column, low: int = 120, high: int = 400) -> Column:
    return F.bround(high - score * (high - low)).cast("long")


def sentiment(loudness: Column, delta: Column, kind: Column) -> Column:
    """Coarse sound label of a loudness moment."""
    return (
        F.when(kind == "silence_to_loud", "applause").when((kind == "extreme_spike") & (loudness > -8), "shouting").when(kind == "extreme_spike", "cheering")
        .when((kind == "volume_spike") & (delta > 12), "cheering").when((kind == "volume_spike") & (delta > 8), "laughter").otherwise("neutral")
    )


def loudness_moments(rms: DataFrame, spike: float = 6.0, cap: int = 25) -> DataFrame:
    """Loud moments against the upper-median baseline of audible rows, and jumps from
    silence; the ``cap`` largest per job."""
    base = pick_ranks(rms.where("rms_db > -60"), ["job_id"], "rms_db", {"_base": lambda n: F.floor(n / 2)}, F.floor(F.col("rms_db") / 5)).drop("n")
    d = scan(rms, ["job_id"], ["t", "rms_id"], time_block("t"), prev={"_p": F.col("rms_db")}).join(base, "job_id")
    over = F.col("rms_db") - F.col("_base")
    kind = F.when(over > spike * 2, "extreme_spike").otherwise("volume_spike")
    a = d.where(over > spike).select("job_id", "t", "rms_id", F.lit(0).alias("_o"), F.round("rms_db", 1).alias("loudness_db"), F.round(over, 1).alias("delta_db"),
                                     kind.alias("type"), sentiment(F.col("rms_db"), over, kind).alias("sentiment"))
    b = d.where((F.col("_p") < F.col("_base") - 10) & (over > spike)).select(
        "job_id", "t", "rms_id", F.lit(1).alias("_o"), F.round("rms_db", 1).alias("loudness_db"), F.round(F.col("rms_db") - F.col("_p"), 1).alias("delta_db"),
        F.lit("silence_to_loud").alias("type"), F.lit("applause").alias("sentiment"))
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("delta_db"), "_o", "t", "rms_id"))
    return a.unionByName(b).withColumn("rank", rank).where(F.col("rank") <= cap).drop("_o")


def rolling_peaks(envelope: DataFrame, window: float = 2.0, sigma: float = 2.0) -> DataFrame:
    """Samples far above the last ``window`` seconds before them (at least three samples).

    Sample times are distinct milliseconds; rows are copied into the next time
    block where its history reaches, so no window spans a whole job.
    """
    d = with_halo(envelope, "t", max(60.0, 4 * window), behind=window).withColumn("_ms", F.round(F.col("t") * 1000).cast("long"))
    w = Window.partitionBy("job_id", "_blk").orderBy("_ms").rangeBetween(-int(window * 1000), -1)
    d = d.withColumns({"_n": F.count("value").over(w), "_m": F.avg("value").over(w), "_sd": F.stddev_pop("value").over(w)}).where("_own")
    by_sigma = F.when(F.col("_sd") > 1e-9, F.col("_m") + sigma * F.col("_sd")).otherwise(F.lit(float("inf")))
    by_mean = F.greatest(F.col("_m") * 2.0, F.col("_m") + 0.5)
    return d.where((F.col("_n") >= 3) & (F.col("value") >= F.least(by_sigma, by_mean))).select("job_id", "sample_id", "t")


def scene_cut_boundaries(scenes: DataFrame, gap: float = 30.0) -> DataFrame:
    """Important scenes at least ``gap`` seconds after the last one kept."""
    d = keep_spaced(scenes.where("importance >= 6").select("job_id", "t", "scene_id"), ["job_id"], "t", gap, ["t", "scene_id"])
    return d.select("job_id", F.round("t", 1).alias("t"))


def merge_boundaries(points: DataFrame, gap: float) -> DataFrame:
    """Distinct times (one decimal) at least ``gap`` apart."""
    d = points.select("job_id", F.round("t", 1).alias("t")).distinct()
    return keep_spaced(d, ["job_id"], "t", gap, ["t"])


def metric_cuts(pairs: DataFrame, correlation: float = 0.55, edge: float = 0.30, gap: float = 0.30) -> DataFrame:
    """Frame pairs that differ enough, thinned to one per ``gap`` seconds."""
    cut = pairs.where((F.col("hist_corr") < correlation) | (F.col("edge_delta") > edge))
    return keep_spaced(cut.select("job_id", "t", "pair_id"), ["job_id"], "t", gap, ["t", "pair_id"])


def smooth_path(path: DataFrame, cols: list[str], alpha: float = 0.3) -> DataFrame:
    """One-way moving average of the box columns."""
    return ema(path, ["job_id"], ["t", "sample_id"], time_block("t"), {f"{c}_s": c for c in cols}, alpha)


def smooth_both_ways(path: DataFrame, col: str, alpha: float = 0.3) -> DataFrame:
    """Mean of a forward and a backward moving average; no time shift."""
    d = ema(path, ["job_id"], ["t", "sample_id"], time_block("t"), {"_f": col}, alpha)
    d = ema(d, ["job_id"], ["t", "sample_id"], time_block("t"), {"_r": col}, alpha, reverse=True)
    return d.withColumn("smooth", (F.col("_f") + F.col("_r")) / 2).drop("_f", "_r")


def blend(before: Column, after: Column, t: Column, numbers: list[str], labels: list[str]) -> dict[str, Column]:
    """Linear values and nearest labels at a time between two points (structs with t); a missing point is like the other."""
    a, b = F.coalesce(before, after), F.coalesce(after, before)
    dt = b["t"] - a["t"]
    u = F.when(dt <= 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - a["t"]) / dt)))
    out = {c: F.coalesce((1 - u) * a[c] + u * b[c], a[c], b[c]) for c in numbers}
    return out | {c: F.when(u < 0.5, a[c]).otherwise(b[c]) for c in labels}


def resample(path: DataFrame, grid: DataFrame, numbers: list[str], labels: list[str]) -> DataFrame:
    """Linear values and nearest labels of a path at the grid times; ends are held."""
    p = path.select("job_id", F.col("t").alias("_pt"), *[F.col(c).alias(f"p_{c}") for c in (*numbers, *labels)])
    got = as_of(grid, p, ["job_id"], "t", "_pt", [f"p_{c}" for c in (*numbers, *labels)])
    mixed = blend(F.col("before"), F.col("after"), F.col("t"), [f"p_{c}" for c in numbers], [f"p_{c}" for c in labels])
    return got.where("before IS NOT NULL OR after IS NOT NULL").withColumns({c.removeprefix("p_"): x for c, x in mixed.items()}).drop("before", "after")


def hold_track(grid: DataFrame, alpha: float = 0.45, jump: float = 20.0) -> DataFrame:
    """Fill and smooth a sampled subject track (job_id, t, x, y, conf, source; x null where unseen).

    Gaps hold the last point with confidence decaying by 0.9 (floor 0.1), the
    head takes the first seen point, then a causal average rounded at every step
    skips jumps.  The rounding makes each point depend on the rounded point before.
    """
    seen = grid.where("x IS NOT NULL").groupBy("job_id").agg(F.min_by(F.struct("t", "x", "y", "conf"), "t").alias("_f"))
    size = grid.groupBy("job_id").agg(F.count("*").alias("_n"))
    d = grid.join(seen, "job_id", "left").join(size, "job_id").select("job_id", "t", "x", "y", "conf", "source", "_n", F.col("_f.t").alias("ft"), F.col("_f.x").alias("fx"), F.col("_f.y").alias("fy"), F.col("_f.conf").alias("fc"))

    def step(state, row):
        job, t, x, y, conf, source, n, ft, fx, fy, fc = row
        last, shown = state
        if x is not None and x == x:
            point = (round(x, 2), round(y, 2), round(conf, 3), source)
        elif last is not None:
            point = (last[0], last[1], round(max(0.1, last[2] * 0.9), 3), "hold")
        else:
            point = (50.0, 50.0, 0.1, "none")
        px, py, pc, ps = point
        if ft is not None and ft == ft and t < ft:
            px, py, pc, ps = round(fx, 2), round(fy, 2), max(0.15, round(fc, 3) * 0.6), "hold_back"
        if shown is not None and n >= 3 and abs(px - shown[0]) <= jump:
            px, py = round(alpha * px + (1 - alpha) * shown[0], 2), round(alpha * py + (1 - alpha) * shown[1], 2)
        return (point, (px, py)), [(job, round(t, 3), px, py, pc, ps)]

    job_type = grid.schema["job_id"].dataType.simpleString()
    return fold_sorted(d, ["job_id"], ["t"], f"job_id {job_type}, t double, x double, y double, conf double, source string", lambda: (None, None), step)


def snap_boundaries(shots: DataFrame, grid: DataFrame, shot_id: str, reach: float = 0.20, least: float = 0.30) -> DataFrame:
    """Snap shot starts to downbeats and move the previous end along, keeping both
    neighbours at least ``least`` seconds and the move under half the shot."""
    d = snap_to_grid(shots, grid, "start", "_to", reach).select("job_id", "start", shot_id, "end", "_to")

    def step(prev, row):
        job, start, sid, end, to = row
        if prev is None:
            return [job, sid, start, end, False], []
        moved = (
            start > 0 and to != start and abs(to - start) < 0.5 * max(end - start, 0.0001)
            and to - prev[2] >= least and end - to >= least
        )
        if moved:
            prev[3] = to
        return [job, sid, to if moved else start, end, moved], [tuple(prev)]

    job_type = shots.schema["job_id"].dataType.simpleString()
    return fold_sorted(d, ["job_id"], ["start", shot_id], f"job_id {job_type}, {shot_id} bigint, start double, end double, moved boolean", lambda: None, step, lambda p: [tuple(p)])


def _merge_modes(rows: DataFrame) -> DataFrame:
    runs = islands(rows, ["job_id"], ["start"], time_block("start"), ["mode"], lambda p, c: p["mode"] != c["mode"], "run")
    return runs.groupBy("job_id", "run", "mode").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def stable_layout(votes: DataFrame, least: float = 2.0) -> DataFrame:
    """Layout segments from per-frame votes: short segments join the one before, then
    those still short join the one after.

    Whether a segment is short is known before each pass, so both passes are
    group numbers, not row-by-row decisions.
    """
    runs = islands(votes, ["job_id"], ["t"], time_block("t"), ["mode"], lambda p, c: p["mode"] != c["mode"], "run")
    segs = runs.groupBy("job_id", "run", "mode").agg(F.min("t").alias("start"), F.max("t").alias("_last"))
    segs = scan(segs, ["job_id"], ["run"], index_block("run"), nxt={"_n": F.col("start")})
    segs = segs.select("job_id", "mode", "start", F.coalesce("_n", F.col("_last") + 0.5).alias("end"))
    segs = cut_lineage(segs)
    long = (F.col("end") - F.col("start") >= least).cast("long")
    fwd = scan(segs, ["job_id"], ["start"], time_block("start"), total={"_g": long}, prev={"_p": F.lit(True)})
    first = F.when(F.col("_p").isNull(), 1 - long).otherwise(0)
    fwd = scan(fwd.withColumn("_first", first), ["job_id"], ["start"], time_block("start"), total={"_h": F.col("_first")})
    fwd = fwd.groupBy("job_id", (F.col("_g") + F.col("_h")).alias("_g")).agg(F.min_by("mode", "start").alias("mode"), F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")
    fwd = cut_lineage(_merge_modes(fwd))
    keep = F.when((F.col("end") - F.col("start") >= least) | F.col("_n").isNull(), 1).otherwise(0).cast("long")
    back = scan(fwd, ["job_id"], ["start"], time_block("start"), nxt={"_n": F.lit(True)}).withColumn("_k", keep)
    back = scan(back, ["job_id"], ["start"], time_block("start"), total={"_g": F.col("_k")})
    back = back.groupBy("job_id", (F.col("_g") - F.col("_k")).alias("_g")).agg(F.max_by("mode", "start").alias("mode"), F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")
    return _merge_modes(back)


# Weight of each source of the intent signal; strength taken where a row has none.
INTENT_WEIGHTS = {"speaker": 0.6, "lip": 0.5, "track": 0.2, "region": 0.4}
INTENT_DEFAULTS = {"speaker": 0.7, "face": 0.9, "region": 0.4}


def intent_signal(times: DataFrame, events: DataFrame, faces: DataFrame, tracks: DataFrame, regions: DataFrame) -> DataFrame:
    """Raw confidence (at most 1) of every subject at each of ``times`` (distinct job_id, t).

    ``events``: job_id, start, end, slot_id, confidence; ``faces``: job_id, t, slot_id, lip, confidence, looked up
    at the exact time; ``tracks``: job_id, start, end, slot_id (null: unnamed), persistent_id, confidence;
    ``regions``: job_id, t, region_no (from 0), score.  Spans hold both ends.  Rows with a null or negative
    slot give nothing but for tracks, whose unnamed subjects count down from -1; regions count down from
    -1000 and speak only where no other source does.  The sources are added up in one aggregate.
    """
    w, default = INTENT_WEIGHTS, INTENT_DEFAULTS
    times = times.select("job_id", F.col("t").cast("double").alias("t"))

    def at_times(spans: DataFrame) -> DataFrame:
        return points_in(times, spans, ["job_id"], 30.0).select("job_id", "t", "subject_id", "part")

    spoken = events.where("slot_id >= 0").select("job_id", "start", "end", F.col("slot_id").cast("long").alias("subject_id"), (F.coalesce("confidence", F.lit(default["speaker"])) * w["speaker"]).alias("part"))
    lips = F.coalesce("lip", F.lit(0.0)) * w["lip"] * F.coalesce("confidence", F.lit(default["face"]))
    seen = faces.where("slot_id >= 0").select("job_id", F.col("t").cast("double").alias("t"), F.col("slot_id").cast("long").alias("subject_id"), lips.alias("part"))
    name = F.coalesce(F.col("slot_id"), -(F.col("persistent_id") + 1)).cast("long")
    present = tracks.select("job_id", "start", "end", name.alias("subject_id"), (F.col("confidence") * w["track"]).alias("part"))
    found = at_times(spoken).unionByName(seen.join(times, ["job_id", "t"], "left_semi")).unionByName(at_times(present))
    strength = F.coalesce("score", F.lit(default["region"])) * w["region"]
    spots = regions.select("job_id", F.col("t").cast("double").alias("t"), (-(F.col("region_no") + 1000)).cast("long").alias("subject_id"), strength.alias("part"))
    spots = spots.join(times, ["job_id", "t"], "left_semi")
    both = found.withColumn("_spot", F.lit(False)).unionByName(spots.withColumn("_spot", F.lit(True)))
    d = both.groupBy("job_id", "t", "subject_id", "_spot").agg(F.least(F.lit(1.0), F.sum("part")).alias("confidence"))
    only = F.min(F.col("_spot")).over(Window.partitionBy("job_id", "t"))  # the subjects of one moment
    return d.withColumn("_only", only).where("_spot = _only").drop("_spot", "_only")


def smooth_intent(candidates: DataFrame, alpha: float = 0.4, floor: float = 0.05) -> DataFrame:
    """Smoothed confidence per subject and frame; absent subjects fade and are dropped at the floor.

    Subjects do not influence each other, so the fold runs per (job, subject);
    a subject fades out in a few frames, which bounds the rows added per gap.
    ``candidates``: job_id, frame, subject_id, confidence, last_frame.
    """
    d = candidates.select("job_id", "subject_id", "frame", F.least(F.lit(1.0), "confidence").alias("c"), "last_frame")

    def fade(state, until):
        out = []
        frame, value, job, sid = state
        while frame + 1 < until:
            value *= 1 - alpha
            frame += 1
            if not value > floor:
                return 0.0, out
            out.append((job, sid, frame, value))
        return value, out

    def step(state, row):
        job, sid, frame, c, last = row
        value, out = fade(state[0], frame) if state and state[0] else (0.0, [])
        value = value * (1 - alpha) + c * alpha
        if value > floor:
            return ((frame, value, job, sid), last), out + [(job, sid, frame, value)]
        return (None, last), out

    def finish(state):
        return fade(state[0], state[1] + 1)[1] if state and state[0] else []

    job_type = candidates.schema["job_id"].dataType.simpleString()
    return fold_sorted(d, ["job_id", "subject_id"], ["frame"], f"job_id {job_type}, subject_id bigint, frame bigint, smooth double", lambda: None, step, finish)


def intent_switches(smooth: DataFrame, margin: float = 0.15, least: float = 0.35) -> DataFrame:
    """Frames where another subject overtakes the current one by ``margin``.

    A frame has a handful of live subjects, which travel as one map.
    """
    frames = smooth.groupBy("job_id", "frame").agg(F.sort_array(F.collect_list(F.struct("subject_id", "smooth"))).alias("s"))
    frames = frames.select("job_id", "frame", F.transform("s", lambda r: r["subject_id"]).alias("ids"), F.transform("s", lambda r: r["smooth"]).alias("vals"))

    def step(cur, row):
        job, frame, ids, vals = row
        conf = dict(zip(ids, vals))
        best = max(conf, key=conf.get)
        if cur is None:
            return (best, [(job, frame, None, best)]) if conf[best] >= least else (None, [])
        if best != cur and conf[best] - conf.get(cur, 0.0) >= margin and conf[best] >= least:
            return best, [(job, frame, cur, best)]
        return cur, []

    job_type = smooth.schema["job_id"].dataType.simpleString()
    return fold_sorted(frames, ["job_id"], ["frame"], f"job_id {job_type}, frame bigint, from_id bigint, to_id bigint", lambda: None, step)


def confident_runs(detections: DataFrame, floor: float = 0.5, least: int = 8) -> DataFrame:
    """At least ``least`` consecutive detections with enough confidence."""
    d = runs_where(detections, F.col("value") >= floor, ["job_id"], ["t", "sample_id"], None, 0.0)
    return d.where(F.col("n") >= least).select("job_id", "start", "end", "n")


def impact_leads(frames: DataFrame, least: float = 0.35) -> DataFrame:
    """Frames just before a motion peak: two rises, then a drop, away from both ends."""
    order = ["t", "sample_id"]
    d = scan(frames, ["job_id"], order, time_block("t"), prev={"_a": F.col("value")}, nxt={"_z": F.col("value")})
    d = scan(d, ["job_id"], order, time_block("t"), prev={"_aa": F.col("_a")}, nxt={"_zz": F.col("_z")})
    v = F.col("value")
    peak = (v > least) & (v > F.col("_a")) & (F.col("_a") > F.col("_aa")) & (v > F.col("_z")) & F.col("_zz").isNotNull()
    d = scan(d.withColumn("_peak", F.coalesce(peak, F.lit(False))), ["job_id"], order, time_block("t"), nxt={"_lead": F.col("_peak")})
    return d.where("_lead").select("job_id", "sample_id", "t")


def output_duration(clips: DataFrame, parts: DataFrame) -> DataFrame:
    """Seconds of an exported clip when its parts have their own speed; gaps and
    clips without speed changes run at the clip's speed.

    ``parts``: clip_id, part_no, p_start, p_end, p_speed.
    """
    c = clips.select("clip_id", "start", "end", F.when(F.coalesce("speed", F.lit(0.0)) == 0, 1.0).otherwise(F.col("speed")).alias("speed"))
    odd = parts.groupBy("clip_id").agg(F.bool_or(F.abs(F.coalesce("p_speed", F.lit(1.0)) - 1.0) > 0.001).alias("_odd")).where("_odd")
    p = parts.join(c, "clip_id").join(odd, "clip_id", "left_semi")
    length = F.col("end") - F.col("start")
    p = p.withColumns({"_s": F.greatest(F.lit(0.0), F.col("p_start") - F.col("start")), "_e": F.least(length, F.col("p_end") - F.col("start"))}).where("_e > _s")
    d = scan(p, ["clip_id"], ["p_start", "part_no"], time_block("p_start"), prev={"_pe": F.col("_e")}, nxt={"_n": F.lit(True)})
    before = F.coalesce("_pe", F.lit(0.0))
    gap = F.when(F.col("_s") > before + 0.01, (F.col("_s") - before) / F.col("speed")).otherwise(0.0)
    tail = F.when(F.col("_n").isNull() & (F.col("_e") < length - 0.01), (length - F.col("_e")) / F.col("speed")).otherwise(0.0)
    own = F.coalesce("p_speed", "speed")
    g = d.groupBy("clip_id").agg(F.sum(gap + (F.col("_e") - F.col("_s")) / own + tail).alias("output"))
    return c.join(g, "clip_id", "left").select("clip_id", F.coalesce("output", length / F.col("speed")).alias("output"))
