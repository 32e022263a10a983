"""Suppressed switches decided by block maps, against a plain loop."""

import random

import pytest

from timbrel.operators import windows

EVENTS = "job_id long, start double, run long, end double, slot_id long, confidence double"


def looped(rows, attack=0.7, release=0.3, decay=0.95):
    out, jobs = [], {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        job, start, _, end, slot, conf = r
        cur = jobs.get(job)
        if cur is not None and slot == cur[3]:
            cur[2], cur[4] = end, max(cur[4], conf)
        elif cur is None or slot < 0 or conf >= attack or cur[4] < release:
            jobs[job] = [job, start, end, slot, conf]
            out.append(jobs[job])
            cur = None
        else:
            cur[2], cur[4] = end, cur[4] * decay
    return sorted(map(tuple, out), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize(("rows", "slots", "top"), [(1, 3, 1.0), (4, 2, 0.69), (7, 6, 0.69), (16, 4, 0.8), (512, 5, 0.72), (64, 40, 0.69)])
def test_hysteresis_splits_a_job(spark, rows, slots, top):
    rng = random.Random(rows * 100 + slots)
    events, t = [], 0.0
    for i in range(2500):  # one job holds nearly all events; many share a start
        t += rng.choice([0.0, 0.5, 1.0])
        low = rng.choice([0.0, 0.3, 0.5])
        events.append((1, t, i, t + 1, rng.randrange(slots) if rng.random() < 0.99 else -1, rng.uniform(low, top)))
    events += [(k, float(i // 2), i, i + 1.0, rng.randrange(3), rng.random()) for i in range(30) for k in (2, None)]
    got = windows.hysteresis(spark.createDataFrame(rng.sample(events, len(events)), EVENTS), rows=rows)
    assert sorted((tuple(r) for r in got.select("job_id", "start", "end", "slot_id", "confidence").collect()), key=lambda r: (r[0] is not None, r)) == looped(events)


def test_hysteresis_holds_a_whole_job(spark):
    # the first event is refreshed again and again, so no block ever replaces it
    events = [(1, float(i), i, i + 1.0, i % 2, 0.6 if i % 2 == 0 else 0.5) for i in range(1000)]
    got = windows.hysteresis(spark.createDataFrame(events, EVENTS), rows=32).collect()
    assert [(r.start, r.end, r.slot_id) for r in got] == [(0.0, 1000.0, 0)]
    assert windows.hysteresis(spark.createDataFrame([], EVENTS)).collect() == []
