"""Rules over event time, each as a stream and in batch: idle fallback, trigger bus, hold and decay; the progress feed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import index_block, scan
from ..sources.sinks import upsert_partitions
from .streams import NEVER, shared_folder, stalest
from .timers import Rule, by_event_time, in_batch

# --- idle fallback ---------------------------------------------------------------------------------


class Idle(Rule):
    """A glance at the stalest sensor whenever nothing was glanced at for the interval."""

    def __init__(self, interval: int, linger: int):
        self.interval, self.linger = interval, linger

    def start(self, t: int) -> dict:
        return {"from": t, "last": t, "seen": {}, "sensors": [], "until": t}

    def take(self, state: dict, t: int, rows: list[dict]) -> list[tuple]:
        state["until"] = t + self.linger
        known = dict((int(s["sensor"]), float(s["confidence"])) for r in rows for s in r["sensors"] or [])
        state["sensors"] = [[c, s] for s, c in sorted(known.items())] or state["sensors"]
        for sid in known:
            state["seen"].setdefault(str(sid), state["from"])
        for sid in (s for r in rows for s in r["fired"] or []):
            state["seen"][str(sid)] = state["last"] = t
        return []

    def run(self, state: dict, upto: int) -> list[tuple]:
        out = []
        while (due := state["last"] + self.interval) <= upto:
            pick = stalest([(sid, c) for c, sid in state["sensors"]], state["seen"], due, self.interval)
            state["last"] = due
            if pick is not None:
                state["seen"][str(pick)] = due
                out.append((due, pick))
        return out


IDLE = "job_id bigint, t bigint, sensor bigint"


def timed_glances(rows: DataFrame, interval: int = 10_000, linger: int = 60_000) -> DataFrame:
    """Fallback glances at the moment they fall due, with or without a row there.

    rows: job_id, t (ms), fired array<sensor>, sensors array<struct<sensor, confidence>> (the job's, as
    known then).  A stream has a timestamp column ts with a watermark in place of t.  The clock of a
    job starts with its first row; a glance is due each time the interval has passed since the
    last firing or glance, and falls away where a sensor fires at that very moment.  A job without
    rows for ``linger`` has ended: its state is freed, and a later row starts it anew.
    """
    if rows.isStreaming:
        return by_event_time(rows.select("job_id", "ts", "fired", "sensors"), ["job_id"], "ts", Idle(interval, linger), IDLE)
    return in_batch(rows.select("job_id", "t", "fired", "sensors"), ["job_id"], Idle(interval, linger), IDLE, linger)


# --- trigger bus -----------------------------------------------------------------------------------


class Bus(Rule):
    """Crossings of the sensors' running means, their quiet times, and the fallback of the same sensors."""

    def __init__(self, threshold: float, alpha: float, interval: int, quiet: int, boost: float, linger: int, origin: int = 0):
        self.threshold, self.alpha, self.interval, self.quiet, self.boost, self.linger, self.origin = threshold, alpha, interval, quiet, boost, linger, origin

    def start(self, t: int) -> dict:
        return {"mean": {}, "seen": {}, "fired": {}, "last": self.origin, "until": t}

    def take(self, state: dict, t: int, rows: list[dict]) -> list[tuple]:
        state["until"] = t + self.linger
        near = any(r["near_peak"] for r in rows)
        read = {int(r["sample_id"]): r for r in rows}  # a frame near two peaks comes twice
        own: dict[int, list[dict]] = {}
        for r in read.values():
            own.setdefault(int(r["sensor"]), []).append(r)
        hits, sensors = [], []
        for sid in sorted(own):
            value = sum(r["value"] for r in own[sid]) / len(own[sid])
            first = own[sid][0]
            limit = self.threshold / self.boost if near and first["hint"] in ("health", "killfeed") else self.threshold
            mean = state["mean"].get(str(sid))
            sensors.append((sid, first["confidence"]))
            state["seen"].setdefault(str(sid), self.origin)
            if mean is not None and abs(value - mean) >= limit and self.rested(state, sid, t):
                hits.append(sid)
            state["mean"][str(sid)] = value if mean is None else (1 - self.alpha) * mean + self.alpha * value
        for sid in hits:
            state["seen"][str(sid)] = state["last"] = t
        source = "delta"
        if not hits and t - state["last"] >= self.interval:
            source, pick = "scheduled", stalest(sensors, state["seen"], t, self.interval)
            if pick is not None:
                state["seen"][str(pick)] = state["last"] = t  # even where the quiet time holds it back
                hits = [pick] if self.rested(state, pick, t) else []
        state["fired"].update({str(sid): t for sid in hits})
        return [(t, sid, source) for sid in hits]

    def rested(self, state: dict, sid: int, t: int) -> bool:
        return t - state["fired"].get(str(sid), NEVER) >= self.quiet


#: Windows that a slot of time holds.
SLOT = 4


def flag_near_peaks(frames: DataFrame, peaks: DataFrame, window_ms: int = 200) -> DataFrame:
    """Streams of frames (job_id, ts, ...) and peaks (job_id, ts), both with watermarks: adds near_peak.

    An outer interval join: a frame waits until no peak within half a window can come any more, and
    its state is freed then, as is a peak's.  A frame near several peaks comes out several times.
    The join is on a slot of time too, that of a frame and each one that a peak reaches into, so a frame
    looks through the peaks around it and not through all of its job.
    """
    half = F.expr(f"INTERVAL {window_ms // 2} MILLISECONDS")
    ms, reach = F.unix_millis("ts"), window_ms // 2

    def slot(t):
        return F.floor(t / max(1, SLOT * window_ms))

    p = peaks.select(F.col("job_id").alias("_job"), F.col("ts").alias("_peak"), F.explode(F.sequence(slot(ms - reach), slot(ms + reach))).alias("_reached"))
    near = (F.col("_peak") >= F.col("ts") - half) & (F.col("_peak") <= F.col("ts") + half)
    meets = (F.col("job_id") == F.col("_job")) & (F.col("_slot") == F.col("_reached")) & near
    d = frames.withColumn("_slot", slot(ms)).join(p, meets, "leftOuter")
    return d.withColumn("near_peak", F.col("_peak").isNotNull()).drop("_job", "_peak", "_slot", "_reached")


def trigger_bus_stream(
    frames: DataFrame, peaks: DataFrame, threshold: float = 8.0, alpha: float = 0.1, interval: int = 10_000, quiet: int = 2_000, boost: float = 2.0,
    window_ms: int = 200, linger: int = 3_600_000, origin: int = 0,
) -> DataFrame:
    """Combined triggers of two streams with watermarks, equal to the batch form on complete input.

    frames: job_id, ts, sample_id, sensor, value, confidence, hint; the samples of one moment are one
    frame (a sensor's samples are averaged).  peaks: job_id, ts.  Rows that come late but within the
    watermark change nothing; a job without frames for ``linger`` is forgotten.  Time 0 of the media is
    at ``origin``, after 1970, as a watermark starts there.
    """
    rule = Bus(threshold, alpha, interval, quiet, boost, linger, origin)
    d = flag_near_peaks(frames.select("job_id", "ts", "sample_id", "sensor", "value", "confidence", "hint"), peaks, window_ms)
    return by_event_time(d, ["job_id"], "ts", rule, "job_id bigint, t bigint, sensor bigint, source string")


# --- hold and decay --------------------------------------------------------------------------------


def _steps(n):
    """Decay steps summed up over n frames past the hold: frame k past it takes off k."""
    return n * (n + 1) / 2


class Decay(Rule):
    """Weight of one sensor at every frame, with or without a row; forgotten below the floor."""

    def __init__(self, hold: int, tau: float, floor: float):
        self.hold, self.tau, self.floor = hold, tau, floor

    def lasting(self, weight: float) -> int:
        """Frames past the hold at which the weight is still at the floor."""
        left = self.tau * math.log(weight / self.floor)
        n = int((math.sqrt(1 + 8 * left) - 1) / 2)
        return n + 1 if _steps(n + 1) <= left else n

    def start(self, t: int) -> dict:
        return {"weight": 0.0, "last": t, "next": t, "until": t}

    def at(self, state: dict, t: int) -> float:
        return state["weight"] * math.exp(-_steps(max(0, t - state["last"] - self.hold)) / self.tau)

    def take(self, state: dict, t: int, rows: list[dict]) -> list[tuple]:
        weight = max([self.at(state, t - 1) if t > state["last"] else state["weight"], *(r["peak"] for r in rows if r["peak"] is not None)])
        # a peak at the frame after the last one still meets its weight
        until = t + self.hold + self.lasting(weight) + 1 if weight >= self.floor else t
        state |= {"weight": weight, "last": t, "next": t, "until": until}
        return []

    def run(self, state: dict, upto: int) -> list[tuple]:
        frames = range(state["next"], upto + 1)
        state["next"] = max(state["next"], upto + 1)
        return [(t, w) for t in frames if (w := self.at(state, t)) >= self.floor]


def frame_weights(peaks: DataFrame, hold: int = 9, tau: float = 30.0, floor: float = 0.05) -> DataFrame:
    """Weight of each sensor at every frame from a peak until it is below the floor; batch or stream.

    peaks: job_id, sensor, frame, peak; a null peak is no peak.  A stream has a watermark on ts, and
    frame is its milliseconds.  Frames need no row: between peaks the weight decays at each frame
    from the already decayed value, which sums up to a triangular number of steps.  In batch the
    weight after a peak is the greatest of all earlier peaks, each less the steps since: a running
    sum and a running maximum, without an ordered pass.
    """
    keys = ["job_id", "sensor"]
    schema = "job_id bigint, sensor bigint, frame bigint, weight double"
    if peaks.isStreaming:
        return by_event_time(peaks.where("peak IS NOT NULL").select(*keys, "ts", "peak"), keys, "ts", Decay(hold, tau, floor), schema)
    d = peaks.where("peak > 0").groupBy(*keys, "frame").agg(F.max("peak").alias("peak"))
    block = index_block("frame", 1024)
    d = scan(d, keys, ["frame"], block, prev={"_last": F.col("frame")}, nxt={"_next": F.col("frame")})
    past = F.greatest(F.col("frame") - 1 - F.col("_last") - hold, F.lit(0))
    # a weight that was divided by e so many times is zero as a double
    d = d.withColumn("_down", F.least(F.coalesce(_steps(past) / tau, F.lit(0.0)), F.lit(750.0)))
    d = scan(d, keys, ["frame"], block, total={"_sum": F.col("_down")})
    d = scan(d, keys, ["frame"], block, peak={"_top": F.struct((F.ln("peak") + F.col("_sum")).alias("rank"), F.col("peak").alias("peak"), F.col("_sum").alias("sum"))})
    d = d.withColumn("_w", F.col("_top.peak") * F.exp(F.col("_top.sum") - F.col("_sum")))
    left = tau * F.ln(F.col("_w") / floor)
    n = F.floor((F.sqrt(1 + 8 * left) - 1) / 2) + 1  # one more than fits; what is below the floor goes below
    last = F.least(F.col("frame") + hold + n, F.coalesce(F.col("_next") - 1, F.lit(2**62)))
    d = d.where(F.col("_w") >= floor).select(*keys, "_w", F.col("frame").alias("_at"), F.explode(F.sequence(F.col("frame"), last)).alias("frame"))
    weight = F.col("_w") * F.exp(-_steps(F.greatest(F.col("frame") - F.col("_at") - hold, F.lit(0))) / tau)
    return d.select(*keys, "frame", weight.alias("weight")).where(F.col("weight") >= floor)


# --- job progress ----------------------------------------------------------------------------------


def progress_feed(updates: DataFrame, path: str, checkpoint: str | None = None, buckets: int = 16):
    """Keep a table of the newest status per job up to date from a stream of updates.

    updates: job_id, ts (with a watermark), update_id, status, progress, message.  An update that is
    sent again within the watermark is dropped; each micro-batch is reduced to the newest update per
    job and merged by (ts, update_id), so that a batch which is replayed, or an old update,
    changes nothing.  Returns the started query; the table is at ``path``.
    """
    d = updates.dropDuplicatesWithinWatermark(["update_id"])
    fields = ("ts", "update_id", "status", "progress", "message")

    def merge(batch: DataFrame, _id: int) -> None:
        newest = batch.groupBy("job_id").agg(F.max_by(F.struct(*fields), F.struct("ts", "update_id")).alias("r"))
        newest = newest.select("job_id", "r.*", F.struct("r.ts", "r.update_id").alias("version"))
        upsert_partitions(newest, path, "job_id", "version", buckets)

    root = checkpoint or f"{shared_folder(updates.sparkSession, 'progress')}/checkpoint"
    return d.writeStream.trigger(availableNow=True).option("checkpointLocation", root).foreachBatch(merge).start()
