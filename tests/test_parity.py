"""Two trajectories on one time grid: against plain loops, and no grid time is sorted or joined."""

import math
import random

from pyspark.sql import functions as F

from timbrel.functions.ordered import scan, time_block
from timbrel.operators import metrics as op

ROW = "job_id long, t double, x double, y double, w double, h double, sx double, sy double, subjects long, split boolean"


def paths(seed):
    rng = random.Random(seed)

    def path(job, times):
        return [(job, t, *[round(rng.random(), 3) for _ in range(4)], *[rng.choice([None, round(rng.random(), 3)]) for _ in range(2)], rng.randrange(1, 3), rng.random() < 0.3) for t in times]

    ours, truth = [], []
    for job in range(12):
        grid = [i * 0.25 for i in range(800)] + [0.1 + i * 0.3 for i in range(40)]
        ours += path(job, sorted(rng.choice(grid) for _ in range(rng.choice([1, 2, 30]))))  # with equal times
        truth += path(job, sorted(rng.choice(grid) for _ in range(rng.choice([1, 2, 30]))))
    ours += path(50, [1.0, 2.0]) + path(51, [3.0, 4.0]) + path(52, [0.0, None, 5.0, 5.0]) + path(53, [2.0, 9.0])
    truth += path(51, [5.0, 6.0]) + path(52, [0.0, 2.5, 5.0]) + path(53, [0.0, 2.0, 9.0])
    return ours, truth


def at(path, t):
    last = {}
    for row in path:
        if row[1] is not None:
            key = tuple((v is not None, v if v is not None else 0) for v in row[2:])
            if row[1] not in last or key > last[row[1]][0]:
                last[row[1]] = (key, row)
    rows = [last[k][1] for k in sorted(last)]
    a = max((r for r in rows if r[1] <= t), key=lambda r: r[1], default=None)
    b = min((r for r in rows if r[1] > t), key=lambda r: r[1], default=None)
    a, b = a or b, b or a
    u = 0.0 if b[1] - a[1] <= 1e-9 else max(0.0, min(1.0, (t - a[1]) / (b[1] - a[1])))
    mixed = [q if p is None else p if q is None else (1 - u) * p + u * q for p, q in zip(a[2:8], b[2:8], strict=True)]
    return (*mixed, *(a if u < 0.5 else b)[8:])


def test_parity_grid(spark):
    for dt in (0.5, 0.1, 1 / 30):
        ours, truth = paths(7)
        want = {}
        for job in {r[0] for r in ours} & {r[0] for r in truth}:
            o, h = [r for r in ours if r[0] == job], [r for r in truth if r[0] == job]
            t0, t1 = (pick(agg(r[1] for r in p if r[1] is not None) for p in (o, h)) for pick, agg in ((max, min), (min, max)))
            if t1 > t0:
                for i in range(math.floor((t1 - t0) / dt) + 1):
                    want[job, i] = (t0 + i * dt, *at(o, t0 + i * dt), *at(h, t0 + i * dt))
        got = op.parity_grid(spark.createDataFrame(ours, ROW), spark.createDataFrame(truth, ROW), dt).collect()
        assert len(got) == len(want) > 500
        assert {(r.job_id, r.i): tuple(r)[2:] for r in got} == want


def test_grid_times_are_made_last(spark):
    ours, truth = (spark.createDataFrame(p, ROW) for p in paths(8))
    plan = op.parity_grid(ours, truth, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1
    assert plan.index("Generate") < min(plan.index(x) for x in ("Sort", "Join", "Exchange", "Window"))


def test_ahead_is_filled_from_later_rows_only(spark):
    rng = random.Random(1)
    rows = [(i % 3, float(i), rng.choice([None, i])) for i in range(400)]
    d = scan(spark.createDataFrame(rows, "k long, t double, v long"), ["k"], ["t"], time_block("t"), back={"b": F.col("v")}, ahead={"a": F.col("v")})
    for r in d.collect():
        later = [v for k, t, v in rows if k == r.k and t > r.t and v is not None]
        assert r.a == (later[0] if later else None) and r.b == (r.v if r.v is not None else r.a)
