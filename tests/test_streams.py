"""Streams against their batch forms over a file source in several micro-batches."""

import math
import random

from pyspark.sql import functions as F

from timbrel.streaming import streams as st


def replay(spark, tmp_path, df, name):
    """Write rows as files in time order and stream them one file at a time."""
    path = str(tmp_path / name)
    for i in range(4):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def close(a, b):
    return len(a) == len(b) and all(x[:-1] == y[:-1] and abs(x[-1] - y[-1]) < 1e-9 for x, y in zip(a, b))


def test_provider_health(spark, tmp_path):
    rnd = random.Random(1)
    t, rows = 0.0, []
    for i in range(120):
        t += rnd.choice([30.0, 200.0, 700.0])
        rows.append((rnd.randint(0, 1), i, t, rnd.random() < 0.7, i // 30))
    calls = spark.createDataFrame(rows, "provider long, call_id long, t double, failed boolean, part int")
    batch = rows_of(st.provider_health(calls.drop("part")))
    assert batch == rows_of(st.provider_health_stream(calls.drop("part")))
    assert batch == rows_of(st.run_available(st.provider_health_stream(replay(spark, tmp_path, calls, "calls")), "health"))
    recent, until, want = {}, {}, []
    for p, i, at, failed, _ in rows:
        if failed:
            recent[p] = [x for x in recent.get(p, []) if at - x < 600] + [at]
            if len(recent[p]) >= 3:
                until[p] = at + 900
        else:
            recent[p], until[p] = [], None
        want.append((p, i, at, bool(until.get(p) and at < until[p])))
    assert batch == sorted(want)


def sensor_rows(spark, n=160):
    rnd = random.Random(2)
    rows = [(i % 2, i % 3, i, float(i // 3), rnd.uniform(0, 40), i // (n // 4)) for i in range(n)]
    return spark.createDataFrame(rows, "job_id long, sensor long, sample_id long, t double, value double, part int")


def test_baseline_triggers(spark, tmp_path):
    d = sensor_rows(spark)
    batch = rows_of(st.baseline_triggers(d.drop("part"), 8.0))
    assert batch and close(batch, rows_of(st.baseline_triggers_stream(d.drop("part"), 8.0)))
    assert close(batch, rows_of(st.run_available(st.baseline_triggers_stream(replay(spark, tmp_path, d, "sensors"), 8.0), "baseline")))


def frames_of(spark, n=80):
    rnd = random.Random(3)
    rows = [(i % 2, i / 2, [(s, rnd.uniform(0, 12), 0.3 + s / 10, "health" if s == 0 else "map") for s in range(3)], rnd.random() < 0.2, i // (n // 4)) for i in range(n)]
    return spark.createDataFrame(rows, "job_id long, t double, sensors array<struct<sensor:long,value:double,confidence:double,hint:string>>, near_peak boolean, part int")


def test_trigger_bus(spark, tmp_path):
    f = frames_of(spark)
    batch = rows_of(st.trigger_bus(f.drop("part"), 6.0, quiet=3.0, interval=4.0))
    assert {r[3] for r in batch} == {"delta", "scheduled"}
    assert batch == rows_of(st.run_available(st.trigger_bus(replay(spark, tmp_path, f, "bus"), 6.0, quiet=3.0, interval=4.0), "bus"))
    last = {}
    for job, t, sensor, _ in sorted(batch, key=lambda r: r[1]):
        assert t - last.get((job, sensor), -9) >= 3.0
        last[(job, sensor)] = t


def test_idle_glances(spark):
    sensors = [(1, 0.9), (2, 0.5)]
    rows = [(1, float(t), [1] if t == 3 else [], sensors) for t in range(40)]
    d = spark.createDataFrame(rows, "job_id long, t double, fired array<long>, sensors array<struct<sensor:long,confidence:double>>")
    got = [(r.t, r.sensor) for r in st.idle_glances(d, 10.0).orderBy("t").collect()]
    assert got == [(13.0, 1), (23.0, 2), (33.0, 1)]


def test_decaying_weights(spark, tmp_path):
    rows = [(1, 1, i, 1.2 if i in (0, 30) else None, i // 20) for i in range(80)]
    d = spark.createDataFrame(rows, "job_id long, sensor long, frame long, peak double, part int")
    batch = rows_of(st.decaying_weights(d.drop("part")))
    assert batch[9][3] == 1.2 and batch[10][3] < 1.2 and batch[-1][2] < 79
    assert close(batch, rows_of(st.run_available(st.decaying_weights(replay(spark, tmp_path, d, "decay")), "decay")))


def test_decaying_weights_with_gaps_and_odd_peaks(spark, tmp_path):
    rnd = random.Random(4)
    odd = [0.0, -1.0, float("nan"), 0.4, 1.2, 0.9]
    rows = [(1, s, i + 2000 * (i // 150), rnd.choice(odd) if rnd.random() < 0.08 else None, i // 75) for s in (1, 2) for i in range(300)]
    d = spark.createDataFrame(rows, "job_id long, sensor long, frame long, peak double, part int")
    want = []
    for s in (1, 2):
        peaks: dict[int, float] = {}  # the part of each peak that is left
        last = 0
        for _, _, frame, peak, _ in (r for r in rows if r[1] == s):
            if peak is not None and peak == peak:
                last = frame
                peaks[frame] = max(peak, 0.0)
            peaks = {k: v * math.exp(-max(0, frame - last - 9) / 30.0) for k, v in peaks.items()}
            if max(peaks.values(), default=0.0) >= 0.05:
                want.append((1, s, frame, max(peaks.values())))
    batch = rows_of(st.decaying_weights(d.drop("part")))
    assert close(batch, sorted(want))
    assert close(batch, rows_of(st.run_available(st.decaying_weights(replay(spark, tmp_path, d, "odd")), "odd")))
    assert st.decaying_weights(d.drop("part").limit(0)).count() == 0


def test_live_zones_drop_late_rows(spark, tmp_path):
    rows = [(1, float(s), float(s) + 2.0, 5, s // 100) for s in range(0, 400, 10)]
    d = spark.createDataFrame(rows, "job_id long, s double, e double, points int, part int")
    d = d.select("job_id", F.timestamp_seconds("s").alias("ts"), F.timestamp_seconds("e").alias("end_ts"), "points", "part")
    batch = {r[1]: r[2:] for r in st.live_zones(d.drop("part")).collect()}
    live = {r[1]: r[2:] for r in st.run_available(st.live_zones(replay(spark, tmp_path, d, "live"), "30 seconds"), "live").collect()}
    assert live and all(batch[k] == v for k, v in live.items())


def test_latest_status(spark):
    d = spark.createDataFrame([(1, 10, 1, "run", 5.0, "a"), (1, 20, 2, "done", 100.0, "b"), (2, 5, 3, "run", 1.0, "c")], "job_id long, s long, update_id long, status string, progress double, message string").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.job_id: r.status for r in st.latest_status(d).collect()} == {1: "done", 2: "run"}


def test_upsert_stream(spark, tmp_path):
    rows = [(f"j{i % 5}", i, f"s{i}", i // 5) for i in range(20)] + [("j1", 2, "late", 3)]
    d = spark.createDataFrame(rows, "job_id string, version int, status string, part int")
    table = str(tmp_path / "table")
    st.upsert_stream(replay(spark, tmp_path, d, "changes"), table, "job_id", "version", 4).awaitTermination()
    got = sorted((r.job_id, r.version, r.status) for r in spark.read.parquet(table).collect())
    assert got == [(f"j{i}", 15 + i, f"s{15 + i}") for i in range(5)]


def test_fold_of_a_key_keeps_few_rows_as_objects():
    """The rows of a key come in order, some at a time, with their values as they were; the others stay plain numbers."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    rnd = np.random.default_rng(5)
    big = [pd.DataFrame({"k": np.ones(10_000, np.int64), "id": rnd.permutation(10_000), "t": rnd.integers(0, 500, 10_000) / 10}) for _ in range(20)]
    tracemalloc.start()
    seen, last = 0, (-1.0, -1)
    for rows in st.rows_in_order(iter(big), ["k", "id", "t"], ["t", "id"]):
        seen += len(rows)
        for _, i, t in rows:
            assert last <= (t, i)
            last = (t, i)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 200_000 and peak < 100 * seen  # as rows of objects they are twice that
    mixed = [pd.DataFrame({"id": [2**60 + 1], "t": [1.0]}), pd.DataFrame({"id": [None, 3.0], "t": [0.5, 2.0]})]
    rows = [r for part in st.rows_in_order(mixed, ["id", "t"], ["t"], 2) for r in part]
    assert rows[1:] == [(2**60 + 1, 1.0), (3.0, 2.0)] and math.isnan(rows[0][0])
