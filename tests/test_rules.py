"""Rules over event time: streams of several micro-batches against the batch form and plain loops."""

import glob
import math
import random
from itertools import groupby

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timbrel.streaming import rules as ru
from timbrel.streaming import timers
from timbrel.streaming.timers import advance, run_closed

FAR = -99


def rows_of(df):
    return sorted(map(tuple, df.where(F.col("job_id") != FAR).collect()))


def replayed(spark, tmp_path, rows, schema, name, parts=4):
    """Stream of rows (the last column is the file they come in), one file a micro-batch."""
    path = str(tmp_path / name)
    d = spark.createDataFrame(rows, schema + ", part int")
    for i in range(parts):
        d.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(d.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def closed(stream, closing, delay, **values):
    """The rows of a stream with a timestamp made of t, and the closing row."""
    d = stream.withColumn("ts", F.timestamp_millis("t")).drop("t")
    values = {"ts": F.col("closing"), "job_id": F.lit(FAR)} | {c: F.lit(x) for c, x in values.items()}
    end = closing.select(*[values.get(c, F.lit(None)).cast(d.schema[c].dataType).alias(c) for c in d.columns])
    return d.unionByName(end).withWatermark("ts", delay)


@pytest.mark.parametrize("rule", [ru.Idle(10, 40), ru.Decay(2, 6.0, 0.05)])
def test_rules_do_not_depend_on_the_batches(rule):
    rng = random.Random(1)
    for _ in range(60):
        t, rows = 0, []
        for _ in range(rng.randrange(1, 25)):
            t += rng.choice([0, 1, 3, 12, 30, 70])
            rows.append({"t": t, "fired": [rng.randrange(3)] if rng.random() < 0.3 else [], "sensors": [{"sensor": k, "confidence": 0.3 + k / 5} for k in range(3)], "peak": rng.random()})
        _, want = advance(rule, None, rows, None)
        state, got, upto = None, [], 0
        while upto < t + 200:
            new = upto + rng.randrange(1, 40)
            state, out = advance(rule, state, [r for r in rows if upto < r["t"] <= new or not upto and not r["t"]], new)
            state = eval(repr(state))
            got += out
            upto = new
        assert got == want and state is None


SENSORS = [(1, 0.9), (2, 0.5)]
IDLE = "job_id long, t long, fired array<long>, sensors array<struct<sensor:long,confidence:double>>"


def idle_rows():
    rng, rows = random.Random(2), []
    for job in (1, 2):
        t = 0
        for _ in range(60):
            t += rng.choice([500, 2000, 9000, 10000, 25000, 70000])  # gaps that no row closes, and ends
            rows.append((job, t, [rng.choice([1, 2])] if rng.random() < 0.3 else [], SENSORS))
    return rows


def brute_glances(rows, interval, linger):
    out = []
    for job in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == job)
        begin, last, seen, k = None, 0, {}, 0
        for now in range(own[0][1], own[-1][1] + linger + 1):
            fired, row = False, False
            while k < len(own) and own[k][1] == now:
                if begin is None or now - before > linger:
                    begin = last = now
                    seen = {}
                for s in own[k][2]:
                    seen[s] = last = now
                    fired = True
                before, row, k = now, True, k + 1
            if now - before <= linger and now - last >= interval and not fired:
                best = max(SENSORS, key=lambda s: (s[1] * min((now - seen.get(s[0], begin)) / interval, 3.0), -s[0]))
                seen[best[0]] = last = now
                out.append((job, now, best[0]))
    return sorted(out)


def test_timed_glances(spark, tmp_path):
    rows = idle_rows()
    batch = rows_of(ru.timed_glances(spark.createDataFrame(rows, IDLE), 10_000, 60_000))
    assert batch == brute_glances(rows, 10_000, 60_000)
    have = {(r[0], r[1]) for r in rows}
    assert any(x[:2] not in have for x in batch)  # no row came at that moment
    order = sorted(rows, key=lambda r: r[1] + 20000 * math.sin(r[1]))  # up to 40 s late
    parted = [(*r, i * 5 // len(order)) for i, r in enumerate(order)]
    stream = replayed(spark, tmp_path, parted, IDLE, "idle", 5)
    assert rows_of(run_closed(spark, lambda c: ru.timed_glances(closed(stream, c, "3 minutes"), 10_000, 60_000), "idle")) == batch


def test_timed_glances_of_no_rows(spark):
    assert ru.timed_glances(spark.createDataFrame([], IDLE)).collect() == []


def brute_weights(rows, hold, tau, floor, lasting=400):
    """Frame by frame, each decayed from the weight before."""
    out = []
    for key in {r[:2] for r in rows}:
        peaks = {}
        for r in rows:
            if r[:2] == key and r[3] is not None:
                peaks[r[2]] = max(peaks.get(r[2], 0.0), r[3])
        if not peaks:
            continue
        weight, last = 0.0, None
        for frame in range(min(peaks), max(peaks) + lasting):
            if frame in peaks:
                weight, last = max(weight, peaks[frame]), frame
            if frame - last > hold:
                weight *= math.exp(-(frame - last - hold) / tau)
            if weight >= floor:
                out.append((*key, frame, weight))
    return sorted(out)


def same(a, b):
    assert [x[:-1] for x in a] == [x[:-1] for x in b]
    assert all(abs(x[-1] - y[-1]) < 1e-9 for x, y in zip(a, b))


PEAKS = "job_id long, sensor long, t long, peak double"


def test_frame_weights(spark, tmp_path):
    rng, rows = random.Random(3), []
    for job, sensor in ((1, 1), (1, 2), (2, 1)):
        t = 0
        for _ in range(70):
            t += rng.choice([1, 4, 11, 14, 20, 300])
            rows.append((job, sensor, t, rng.choice([None, 0.01, 0.06, 0.5, 1.2, 0.9])))
    want = brute_weights(rows, 9, 30.0, 0.05)
    same(rows_of(ru.frame_weights(spark.createDataFrame(rows, PEAKS).withColumnRenamed("t", "frame"))), want)
    parted = [(*r, min(3, r[2] // 1500)) for r in rows]
    stream = replayed(spark, tmp_path, parted, PEAKS, "peaks")
    same(rows_of(run_closed(spark, lambda c: ru.frame_weights(closed(stream, c, "10 milliseconds", peak=0.0)), "weights")), want)
    assert ru.frame_weights(spark.createDataFrame([], PEAKS).withColumnRenamed("t", "frame")).collect() == []


FRAMES = "job_id long, t long, sample_id long, sensor long, value double, confidence double, hint string"


def test_bus_with_late_peaks(spark, tmp_path):
    rng = random.Random(4)
    rows, peaks = [], []
    for job in (1, 2):
        for i in range(120):
            t = 1000 + i * 700
            rows += [(job, t, (job * 1000 + i) * 10 + s, s, rng.uniform(0, 12), 0.3 + s / 10, "health" if s == 0 else "map") for s in range(3)]
            if rng.random() < 0.3:
                peaks += [(job, t + 90), (job, t - 80)]
    want = []
    for job in (1, 2):
        frames = {}
        for r in (r for r in rows if r[0] == job):
            near = any(p[0] == job and abs(p[1] - r[1]) <= 100 for p in peaks)
            frames.setdefault(r[1], []).append({"t": r[1], "sample_id": r[2], "sensor": r[3], "value": r[4], "confidence": r[5], "hint": r[6], "near_peak": near})
        rule = ru.Bus(6.0, 0.1, 4000, 3000, 2.0, 10**9)
        want += [(job, *x) for x in advance(rule, None, [r for f in frames.values() for r in f], None)[1]]
    assert {w[3] for w in want} == {"delta", "scheduled"}
    part = lambda t: min(3, t // 22000)
    f = replayed(spark, tmp_path, [(*r, part(r[1])) for r in rows], FRAMES, "frames")
    # every peak comes in a later file than its frame; the last ones come with their frames
    p = replayed(spark, tmp_path, [(*x, min(3, part(x[1]) + 1)) for x in peaks], "job_id long, t long", "peaks")
    got = run_closed(spark, lambda c: ru.trigger_bus_stream(closed(f, c, "1 minute"), closed(p, c, "1 minute"), 6.0, interval=4000, quiet=3000), "bus")
    assert rows_of(got) == sorted(want)


def test_progress_is_merged_once(spark, tmp_path):
    schema = "job_id string, t long, update_id long, status string, progress double, message string"
    rows = [(f"j{i % 5}", 1000 * i, i, f"s{i}", float(i), "m", i // 10) for i in range(40)]
    rows += [(*rows[7][:6], 2), ("j1", 500, 99, "old", 0.0, "m", 3)]  # sent again, and an old one
    stream = replayed(spark, tmp_path, rows, schema, "updates").withColumn("ts", F.timestamp_millis("t")).drop("t").withWatermark("ts", "1 hour")
    table = str(tmp_path / "table")
    ru.progress_feed(stream, table, str(tmp_path / "first"), 4).awaitTermination()

    def held():
        return sorted((r.job_id, r.update_id, r.status) for r in spark.read.parquet(table).collect())

    want = sorted((f"j{i % 5}", i, f"s{i}") for i in range(35, 40))
    assert held() == want
    ru.progress_feed(stream, table, str(tmp_path / "second"), 4).awaitTermination()  # everything once more
    assert held() == want


def idle_of(spark, tmp_path, jobs, name):
    """A stream of one file with rows of many jobs."""
    rows = [(job, 1000 * (i + 1) + job, [], SENSORS, 0) for job in range(jobs) for i in range(6)]
    return replayed(spark, tmp_path, rows, IDLE, name, 1), rows


def test_keys_share_buckets_and_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(timers, "BUCKETS", 4, raising=False)
    stream, rows = idle_of(spark, tmp_path, 60, "many")
    started = []
    build = lambda c: ru.timed_glances(closed(stream, c, "1 second"), 2000, 5000)
    monkeypatch.setattr("timbrel.streaming.streams.shared_folder", lambda _, name: started.append(str(tmp_path / name)) or started[-1])
    got = run_closed(spark, build, "shared")
    assert rows_of(got) == brute_glances([r[:4] for r in rows], 2000, 5000)
    # all rows, the closing row, the end of time: nothing of the first run has a batch of its own
    assert len(glob.glob(f"{started[0]}/checkpoint/commits/[0-9]*")) == 3
    state = spark.read.format("statestore").option("path", f"{started[0]}/checkpoint").option("batchId", 0).option("stateVarName", "waiting").load()
    assert 0 < state.select("key").distinct().count() <= 4


def test_moments_of_a_bucket():
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice("ab"), rng.randrange(8), i, rng.choice([None, float(i)])) for i in range(200)]
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(["job", "part", "t", "i", "x"])})
    want = {}
    for r in rows:
        want.setdefault(((r[0], r[1]), r[2]), []).append({"t": r[2], "i": r[3], "x": r[4]})
    for size in (1, 7, 10_000):
        timers.ROWS, held = size, timers.ROWS
        try:
            got = [(own, t, now) for own, t, now in timers._moments(table, ["job", "part"], ["t", "i", "x"])]
        finally:
            timers.ROWS = held
        assert len({own for own, _, _ in got}) == len(list(groupby(got, key=lambda m: m[0])))  # a key is in one piece
        assert sorted((own, t) for own, t, _ in got) == sorted(want)
        assert all(x[1] < y[1] for x, y in zip(got, got[1:]) if x[0] == y[0])
        assert all(now == want[own, t] for own, t, now in got)
    assert list(timers._moments(table.slice(0, 0), ["job", "part"], ["t", "i", "x"])) == []


def test_peaks_across_slots(spark, tmp_path):
    # 200 ms windows: frames and peaks at, just inside and just outside the reach of each other and of a slot
    edges = [800 * k + d for k in range(3, 6) for d in (-101, -100, -99, -1, 0, 1, 99, 100, 101)]
    frames = [(job, t, 100 * job + i, 0, 1.0, 0.5, "map", 0) for job in (1, 2) for i, t in enumerate(edges)]
    peaks = [(1, t, 0) for t in edges[::2]] + [(2, 800 * 4, 0), (2, 800 * 4, 0)]
    f, p = replayed(spark, tmp_path, frames, FRAMES, "edge_frames", 1), replayed(spark, tmp_path, peaks, "job_id long, t long", "edge_peaks", 1)
    build = lambda c: ru.flag_near_peaks(closed(f, c, "1 second"), closed(p, c, "1 second"))
    got = run_closed(spark, lambda c: build(c).select("job_id", "sample_id", "near_peak"), "edges")
    want = []
    for r in frames:
        near = sum(q[0] == r[0] and abs(q[1] - r[1]) <= 100 for q in peaks)
        want += [(r[0], r[2], near > 0)] * max(1, near)
    assert rows_of(got) == sorted(want)
    # a frame meets the peaks of its slot, not all of its job
    join = next(x for x in build(spark.readStream.schema("closing timestamp").parquet(str(tmp_path)))._jdf.queryExecution().analyzed().toString().splitlines() if "Join LeftOuter" in x)
    assert join.count(" = ") == 2
