"""Streaming queries and their batch forms.

Ordered rules are written once as a step function.  In batch it runs over sorted
partitions; in a stream the same step runs with keyed state, so both give the
same rows for input that arrives in order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.ordered import checkpoint_folder, ema, fold_sorted, islands, scan, time_block


#: Rows of a key that are Python objects at a time, in and out.
ROWS = 10_000


def rows_in_order(pdfs: Iterable[pd.DataFrame], cols: list[str], order: list[str], rows: int = ROWS) -> Iterator[list[tuple]]:
    """All rows of the frames in order, some at a time; the rest stays in arrays of plain numbers."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in cols}
    for pdf in pdfs:
        for c in cols:
            parts[c].append(pdf[c].to_numpy())
    whole = {}
    for c in cols:
        # a column that is numbers in one frame and has gaps in another keeps the values of each
        own = parts.pop(c)
        if len({a.dtype for a in own}) > 1:
            own = [np.array([*a.tolist(), None], object)[:-1] for a in own]
        whole[c] = np.concatenate(own) if own else np.empty(0, object)
    at = np.lexsort([whole[c] for c in reversed(order)])
    for a in range(0, len(at), rows):
        yield list(zip(*(whole[c][at[a : a + rows]].tolist() for c in cols)))


def keyed_stream(stream: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable, step: Callable) -> DataFrame:
    """Run a fold step with state per key; the rows of one micro-batch are put in order first.

    The state is a small value of lists, numbers and texts, kept as JSON, so a key costs
    a few numbers however many rows it has seen and no class name is part of a checkpoint.
    """
    cols = stream.columns
    names = StructType.fromDDL(schema).names

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = json.loads(state.get[0]) if state.exists else start()
        for rows in rows_in_order(pdfs, cols, order):
            out: list[tuple] = []
            for row in rows:
                value, emitted = step(value, row)
                out.extend(emitted)
            yield pd.DataFrame(out, columns=names).astype(object)
        state.update((json.dumps(value),))

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "s string", "append", GroupStateTimeout.NoTimeout)


def _fold(df: DataFrame, keys, order, schema, start, step) -> DataFrame:
    run = keyed_stream if df.isStreaming else fold_sorted
    return run(df, keys, order, schema, start, step)


def shared_folder(spark: SparkSession, name: str) -> str:
    """New folder under the session's shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available into a Parquet table and read it back."""
    spark = stream.sparkSession
    root = shared_folder(spark, name)
    out = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    out.format("parquet").option("path", f"{root}/data").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def read_events(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Stream over one table's files; the schema comes from the file footer."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


# --- provider health -------------------------------------------------------------------------------

WINDOW_S, LIMIT, PENALTY_S = 600.0, 3, 900.0


def health_step(state, row):
    """Three failures within ten minutes degrade a provider for 15 minutes; success clears."""
    provider, call_id, t, failed = row
    recent, until = state
    if failed:
        recent = [x for x in recent if t - x < WINDOW_S] + [t]
        if len(recent) >= LIMIT:
            until = t + PENALTY_S
            recent = recent[-LIMIT:]
    else:
        recent, until = [], None
    return (recent, until), [(provider, call_id, t, until is not None and t < until)]


def provider_health_stream(calls: DataFrame) -> DataFrame:
    """Degraded flag after each call, with state per provider."""
    d = calls.select("provider", "call_id", "t", "failed")
    return _fold(d, ["provider"], ["t", "call_id"], "provider bigint, call_id bigint, t double, degraded boolean", lambda: ([], None), health_step)


def provider_health(calls: DataFrame) -> DataFrame:
    """Batch form without a row-by-row pass: the third failure of a run of failures within the
    window marks the provider until the penalty ends or a call succeeds."""
    order = ["t", "call_id"]
    d = islands(calls, ["provider"], order, time_block("t", 3600), ["failed"], lambda p, c: p["failed"] != c["failed"], "run")
    d = scan(d, ["provider"], order, time_block("t", 3600), prev={"_p": F.struct("t", "run")})
    d = scan(d, ["provider"], order, time_block("t", 3600), prev={"_pp": F.col("_p")})
    third = F.col("failed") & (F.col("_pp.run") == F.col("run")) & (F.col("t") - F.col("_pp.t") < WINDOW_S)
    d = d.withColumn("_mark", F.when(third, F.struct(F.col("t").alias("t"), F.col("run").alias("run"))))
    d = scan(d, ["provider"], order, time_block("t", 3600), fill={"_last": F.col("_mark")})
    bad = F.col("failed") & (F.col("_last.run") == F.col("run")) & (F.col("t") < F.col("_last.t") + PENALTY_S)
    return d.select("provider", "call_id", "t", F.coalesce(bad, F.lit(False)).alias("degraded"))


# --- job progress ----------------------------------------------------------------------------------

def latest_status(updates: DataFrame) -> DataFrame:
    """Newest status per job; batch or stream (update mode)."""
    return updates.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "message"), F.struct("ts", "update_id")).alias("r"), F.max("ts").alias("ts")).select("job_id", "ts", "r.*")


# --- adaptive baseline -----------------------------------------------------------------------------

def baseline_step_of(threshold: float, alpha: float):
    def step(mean, row):
        job, sensor, sample_id, t, value = row
        if mean is None:
            return value, []
        gap = abs(value - mean)
        fired = [(job, sensor, sample_id, t, min(1.0, gap / max(threshold, 1e-6)))] if gap >= threshold else []
        return (1 - alpha) * mean + alpha * value, fired
    return step


def baseline_triggers_stream(readings: DataFrame, threshold: float = 8.0, alpha: float = 0.1) -> DataFrame:
    """Readings far from the running mean of their sensor."""
    d = readings.select("job_id", "sensor", "sample_id", "t", "value")
    return _fold(d, ["job_id", "sensor"], ["t", "sample_id"], "job_id bigint, sensor bigint, sample_id bigint, t double, confidence double", lambda: None, baseline_step_of(threshold, alpha))


def baseline_triggers(readings: DataFrame, threshold: float = 8.0, alpha: float = 0.1) -> DataFrame:
    """Batch form on the blocked moving average."""
    keys, order = ["job_id", "sensor"], ["t", "sample_id"]
    d = ema(readings.select(*keys, *order, "value"), keys, order, time_block("t"), {"_mean": "value"}, alpha)
    d = scan(d, keys, order, time_block("t"), prev={"_before": F.col("_mean")}).withColumn("_gap", F.abs(F.col("value") - F.col("_before")))
    return d.where(F.col("_gap") >= threshold).select(*keys, "sample_id", "t", F.least(F.lit(1.0), F.col("_gap") / threshold).alias("confidence"))


# --- idle fallback and trigger bus -----------------------------------------------------------------

NEVER = -1e18


def stalest(sensors: list, seen: dict[str, float], t: float, interval: float) -> int | None:
    """The sensor of highest confidence times age, the first of equals.

    Ages are in intervals and count up to three; a sensor seen within half an interval is out.
    """
    ages = [(conf, sid, t - seen.get(str(sid), 0.0)) for sid, conf in sensors]
    ranked = [(conf * min(age / interval, 3.0), -i, sid) for i, (conf, sid, age) in enumerate(ages) if age >= interval / 2]
    return max(ranked)[2] if ranked else None


def _quiet_start() -> dict:
    """Times per sensor of the last glance and of the last firing, and the time of the last glance at all."""
    return {"seen": {}, "fired": {}, "last": 0.0}


def _glance(state: dict, sid: int, t: float) -> None:
    state["seen"][str(sid)] = state["last"] = t


def idle_glances(frames: DataFrame, interval: float = 10.0) -> DataFrame:
    """Fallback choices of quiet stretches; batch or stream.

    ``frames``: job_id, t, fired array<bigint>, sensors array<struct<sensor, confidence>>;
    a job has a handful of sensors.  Each choice is a glance itself and so delays the next one.
    """

    def step(state, row):
        job, t, fired, sensors = row
        due = not len(fired) and t - state["last"] >= interval
        pick = stalest([(s["sensor"], s["confidence"]) for s in sensors], state["seen"], t, interval) if due else None
        glances = list(fired) if pick is None else [pick]
        for sid in glances:
            _glance(state, sid, t)
        return state, [] if pick is None else [(job, t, pick)]

    d = frames.select("job_id", "t", "fired", "sensors")
    return _fold(d, ["job_id"], ["t"], "job_id bigint, t double, sensor bigint", _quiet_start, step)


def near_peaks(frames: DataFrame, peaks: DataFrame, window: float = 0.2) -> DataFrame:
    """Flag frames within half a window of an audio peak.  In a stream both sides need
    watermarks; the join is on a time bucket with a bounded interval."""
    half = window / 2
    f = frames.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("t") - half) / window), F.floor((F.col("t") + half) / window))))
    p = peaks.select("job_id", F.col("t").alias("peak_t"), F.floor(F.col("t") / window).alias("_bucket"))
    hit = f.join(p, ["job_id", "_bucket"]).where(F.abs(F.col("t") - F.col("peak_t")) <= half).select("job_id", "t").distinct()
    return frames.join(hit.withColumn("near_peak", F.lit(True)), ["job_id", "t"], "left").fillna(False, ["near_peak"])


def _limit(threshold: float, boost: float, near: Column, hint: Column) -> Column:
    """Health and kill-feed sensors are more sensitive near an audio peak."""
    return F.when(near & hint.isin("health", "killfeed"), threshold / boost).otherwise(F.lit(threshold))


def crossings(frames: DataFrame, threshold: float, alpha: float, boost: float) -> DataFrame:
    """job_id, t, crossed (sensors far from their running mean before this frame, in order), sensors.

    Column form: the mean of each sensor is a blocked moving average.
    """
    keys = ["job_id", "sensor"]
    d = frames.select("job_id", "t", "near_peak", F.posexplode("sensors").alias("at", "s")).select("job_id", "t", "near_peak", "at", "s.*")
    d = ema(d, keys, ["t"], time_block("t"), {"_mean": "value"}, alpha)
    d = scan(d, keys, ["t"], time_block("t"), prev={"_before": F.col("_mean")})
    far = F.abs(F.col("value") - F.col("_before")) >= _limit(threshold, boost, F.col("near_peak"), F.col("hint"))
    d = d.withColumn("s", F.struct("at", "sensor", "confidence", F.coalesce(far, F.lit(False)).alias("far")))
    d = d.groupBy("job_id", "t").agg(F.sort_array(F.collect_list("s")).alias("s"))  # a frame has a handful of sensors
    crossed = F.transform(F.filter("s", lambda x: x["far"]), lambda x: x["sensor"])
    return d.select("job_id", "t", crossed.alias("crossed"), F.transform("s", lambda x: F.struct(x["sensor"].alias("sensor"), x["confidence"].alias("confidence"))).alias("sensors"))


def trigger_bus(frames: DataFrame, threshold: float = 8.0, alpha: float = 0.1, interval: float = 10.0, quiet: float = 2.0, boost: float = 2.0) -> DataFrame:
    """Combined triggers per job; batch or stream.

    ``frames``: job_id, t (unique in a job), near_peak, sensors array<struct<sensor, value, confidence, hint>>.
    Crossings are found first, by columns in batch and with a mean per sensor in a stream.  Only the
    quiet time and the fallback, which depend on earlier firings, go through the ordered pass.
    """

    def rested(state, sid, t):
        return t - state["fired"].get(str(sid), NEVER) >= quiet

    def fire(state, row):
        job, t, crossed, sensors = row
        hits = [sid for sid in crossed if rested(state, sid, t)]
        for sid in hits:
            _glance(state, sid, t)
        source = "delta"
        if not hits and t - state["last"] >= interval:
            source, pick = "scheduled", stalest([(s["sensor"], s["confidence"]) for s in sensors], state["seen"], t, interval)
            if pick is not None:
                _glance(state, pick, t)  # even where the quiet time holds it back
                hits = [pick] if rested(state, pick, t) else []
        state["fired"].update({str(sid): t for sid in hits})
        return state, [(job, t, sid, source) for sid in hits]

    def follow(state, row):
        """Stream form of the crossings: the means are part of the state."""
        job, t, sensors = row
        before = state.setdefault("mean", {})
        crossed = [s["sensor"] for s in sensors if abs(s["value"] - before.get(str(s["sensor"]), s["value"])) >= s["limit"]]
        before |= {k: (1 - alpha) * before.get(k, v) + alpha * v for k, v in ((str(s["sensor"]), s["value"]) for s in sensors)}
        return fire(state, (job, t, crossed, sensors))

    schema = "job_id bigint, t double, sensor bigint, source string"
    if not frames.isStreaming:
        return fold_sorted(crossings(frames, threshold, alpha, boost), ["job_id"], ["t"], schema, _quiet_start, fire)
    own = F.transform("sensors", lambda s: F.struct(*(s[c].alias(c) for c in ("sensor", "value", "confidence")), _limit(threshold, boost, F.col("near_peak"), s["hint"]).alias("limit")))
    return keyed_stream(frames.select("job_id", "t", own.alias("sensors")), ["job_id"], ["t"], schema, _quiet_start, follow)


# --- live highlights -------------------------------------------------------------------------------

def live_zones(segments: DataFrame, late: str = "2 minutes", size: str = "30 seconds", step: str = "20 seconds") -> DataFrame:
    """Speech points and counts per 30 s window (20 s step) as segments arrive.

    Rows later than the watermark are dropped; a window closes when the
    watermark passes it.  ``segments``: job_id, ts, end_ts, points.
    """
    d = segments.withWatermark("ts", late) if segments.isStreaming else segments
    d = d.withColumn("w", F.window("ts", size, step)).where(F.col("end_ts") <= F.col("w.end"))
    g = d.groupBy("job_id", "w").agg(F.sum("points").alias("points"), F.count("*").alias("n"))
    return g.select("job_id", F.col("w.start").alias("w_start"), F.least(F.lit(100), F.col("points")).alias("transcript"), "n")


# --- hold and decay --------------------------------------------------------------------------------

#: A weight that was divided by e so many times is zero as a double.
GONE = 750.0


def decaying_weights(frames: DataFrame, hold: int = 9, tau: float = 30.0, floor: float = 0.05) -> DataFrame:
    """Weight of each sensor per frame: held after a trigger, then decayed again at every frame
    from the already decayed value; batch or stream.

    With the decay summed up over the frames, the weight of a frame is the greatest of the earlier
    peaks, each less what was summed since: a fill, a running sum and a running maximum.
    """
    keys = ["job_id", "sensor"]
    d = frames.select(*keys, "frame", F.nanvl("peak", F.lit(None).cast("double")).alias("peak"))
    if d.isStreaming:
        return d.groupBy(*keys).applyInPandasWithState(_decay_batch(hold, tau, floor), "job_id bigint, sensor bigint, frame bigint, weight double", "weight double, last bigint", "append", GroupStateTimeout.NoTimeout)
    block = F.floor(F.col("frame") / 1024)
    d = scan(d, keys, ["frame"], block, fill={"_last": F.when(F.col("peak").isNotNull(), F.col("frame"))})
    past = F.greatest(F.col("frame") - F.coalesce("_last", F.lit(0)) - hold, F.lit(0)) / F.lit(float(tau))
    d = scan(d.withColumn("_down", F.least(past, F.lit(GONE))), keys, ["frame"], block, total={"_sum": F.col("_down")})
    since = F.col("_sum") - F.col("_down")
    d = scan(d, keys, ["frame"], block, peak={"_top": F.when(F.col("peak") > 0, F.struct((F.ln("peak") + since).alias("rank"), F.col("peak").alias("peak"), since.alias("since")))})
    weight = F.col("_top.peak") * F.exp(F.col("_top.since") - F.col("_sum"))
    return d.select(*keys, "frame", weight.alias("weight")).where(F.col("weight") >= floor)


def _decay_batch(hold: int, tau: float, floor: float) -> Callable:
    """The same for one micro-batch of a key; the state is the last weight and the frame of the last peak."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, last = state.get if state.exists else (0.0, 0)
        d = pd.concat(list(pdfs)).sort_values("frame")
        frame, peak = d.frame.to_numpy(), d.peak.to_numpy(float)
        last_peak = d.frame.where(d.peak.notna()).ffill().fillna(last).to_numpy()
        down = np.minimum(np.maximum(frame - last_peak - hold, 0) / tau, GONE)
        summed = np.cumsum(down)
        with np.errstate(divide="ignore", invalid="ignore"):
            rank = np.where(peak > 0, np.log(peak) + summed - down, -np.inf)
            weights = np.exp(np.maximum.accumulate(np.maximum(rank, np.log(weight))) - summed)
        state.update((float(weights[-1]), int(last_peak[-1])))
        out = pd.DataFrame({"job_id": key[0], "sensor": key[1], "frame": frame, "weight": weights})
        yield out[out.weight >= floor]

    return run


def points_of(text: Column) -> Column:
    """Speech points of a segment text for live windows."""
    return F.when(text.contains("!"), 8).otherwise(0) + F.when(text.contains("?"), 6).otherwise(0) + F.lit(1)


# --- table upsert ----------------------------------------------------------------------------------

def upsert_stream(changes: DataFrame, path: str, key: str, version: str, buckets: int = 64):
    """Keep a table of the newest version per key up to date from a change stream.

    Every micro-batch rewrites the touched partitions; repeating a batch gives the
    same table, since the newest version wins.
    """
    from ..sources.sinks import upsert_partitions

    root = shared_folder(changes.sparkSession, "upsert")

    def merge(batch: DataFrame, _epoch: int) -> None:
        upsert_partitions(batch, path, key, version, buckets)

    return changes.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(merge).start()
