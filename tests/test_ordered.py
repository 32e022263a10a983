"""Ordered helpers against plain loops, with blocks far smaller than a job and one busy job."""

import bisect
import random

from pyspark.sql import functions as F

from timbrel.functions.ordered import ema, islands, keep_spaced, pick_ranks, scan, time_block
from timbrel.functions.ranges import as_of, near_pairs, nearest, overlap_pairs, points_in


def series(n=300, seed=1):
    """Job 0 holds a third of all rows."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        job = 0 if rnd.random() < 0.33 else rnd.randint(1, 5)
        rows.append((job, round(rnd.uniform(0, 60), 1), i, rnd.choice([None, *range(10)])))
    return rows


def by_job(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_scan_crosses_blocks(spark):
    rows = series()
    df = spark.createDataFrame(rows, "job_id int, t double, id int, v int")
    v = F.col("v")
    got = scan(df, ["job_id"], ["t", "id"], time_block("t", 3), prev={"p": v}, nxt={"n": v}, total={"s": F.coalesce(v, F.lit(0))}, peak={"m": v}, fill={"f": v}, back={"b": v})
    got = {(r.job_id, r.id): (r.p, r.n, r.s, r.m, r.f, r.b) for r in got.collect()}
    for job, rs in by_job(rows).items():
        vals = [r[3] for r in rs]
        for i, r in enumerate(rs):
            seen = [x for x in vals[: i + 1] if x is not None]
            later = [x for x in vals[i:] if x is not None]
            want = (vals[i - 1] if i else None, vals[i + 1] if i + 1 < len(vals) else None, sum(seen), max(seen, default=None), seen[-1] if seen else None, later[0] if later else None)
            assert got[(job, r[2])] == want


def test_islands_cross_blocks(spark):
    rows = series(seed=2)
    df = spark.createDataFrame(rows, "job_id int, t double, id int, v int")
    got = islands(df, ["job_id"], ["t", "id"], time_block("t", 2), ["t"], lambda p, c: c["t"] - p["t"] > 0.7)
    got = {(r.job_id, r.id): r.island for r in got.collect()}
    for job, rs in by_job(rows).items():
        run = 0
        for i, r in enumerate(rs):
            run += bool(i and r[1] - rs[i - 1][1] > 0.7)
            assert got[(job, r[2])] == run


def test_keep_spaced_is_greedy(spark):
    rows = series(seed=3)
    df = spark.createDataFrame(rows, "job_id int, t double, id int, v int")
    got = {(r.job_id, r.id) for r in keep_spaced(df, ["job_id"], "t", 1.0, ["t", "id"], seconds=4).collect()}
    want = set()
    for job, rs in by_job(rows).items():
        last = None
        for r in rs:
            if last is None or r[1] - last >= 1.0:
                want.add((job, r[2]))
                last = r[1]
    assert got == want


def test_pick_ranks(spark):
    rows = series(seed=4)
    df = spark.createDataFrame(rows, "job_id int, t double, id int, v int")
    got = {r.job_id: (r.n, r.mid, r.top) for r in pick_ranks(df, ["job_id"], "t", {"mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}, time_block("t", 5)).collect()}
    for job, rs in by_job(rows).items():
        ts = sorted(r[1] for r in rs)
        assert got[job] == (len(ts), ts[len(ts) // 2], ts[-1])


def test_ema_both_ways(spark):
    rows = [(j, float(i), i, random.Random(i).uniform(0, 50)) for j, n in ((0, 900), (1, 3), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "job_id int, t double, id int, v double")
    for reverse in (False, True):
        got = {(r.job_id, r.id): r.s for r in ema(df, ["job_id"], ["t", "id"], time_block("t", 40), {"s": "v"}, 0.3, reverse).collect()}
        for job, rs in by_job(rows).items():
            s = None
            for r in reversed(rs) if reverse else rs:
                s = r[3] if s is None else 0.3 * r[3] + 0.7 * s
                assert abs(got[(job, r[2])] - s) < 1e-9


def spans(seed, n=120):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = round(rnd.uniform(0, 100), 1)
        out.append((0 if rnd.random() < 0.33 else rnd.randint(1, 4), i, s, round(s + rnd.choice([0.0, 0.5, 3.0, 25.0]), 1)))
    return out


def test_interval_joins(spark):
    a, b = spans(5), spans(6)
    left = spark.createDataFrame(a, "job_id int, a int, start double, end double")
    right = spark.createDataFrame(b, "job_id int, b int, r_start double, r_end double")
    for closed in (False, True):
        got = sorted((r.a, r.b) for r in overlap_pairs(left, right, ["job_id"], 4.0, closed=closed).collect())
        meets = (lambda x, y: y[2] <= x[3] and y[3] >= x[2]) if closed else (lambda x, y: y[2] < x[3] and y[3] > x[2])
        assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and meets(x, y))
    pts = spark.createDataFrame([(x[0], x[1], x[2]) for x in b], "job_id int, b int, t double")
    for ends in ("[]", "[)", "()", "(]"):
        got = sorted((r.a, r.b) for r in points_in(pts, left, ["job_id"], 4.0, ends=ends).collect())
        lo = (lambda p, s: p >= s) if ends[0] == "[" else (lambda p, s: p > s)
        hi = (lambda p, e: p <= e) if ends[1] == "]" else (lambda p, e: p < e)
        assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and lo(y[2], x[2]) and hi(y[2], x[3]))
    got = sorted((r.a, r.b) for r in near_pairs(left.withColumnRenamed("start", "t"), pts.withColumnRenamed("t", "r_t"), ["job_id"], 1.5).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and abs(x[2] - y[2]) <= 1.5)


def test_nearest_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 1, 5.0), (1, 2, 0.0), (1, 3, 9.0), (2, 4, 1.0)], "job_id int, id int, t double")
    right = spark.createDataFrame([(1, 4.0, 10), (1, 6.0, 20), (1, 6.0, 21)], "job_id int, rt double, rid int")
    pick = lambda **kw: {r.id: r.near.rid if r.near else None for r in nearest(left, right, ["job_id"], "t", "rt", ["rid"], seconds=1, **kw).collect()}
    assert pick() == {1: 10, 2: 10, 3: 21, 4: None}
    assert pick(later_wins=True)[1] == 21
    assert pick(tolerance=3.0) == {1: 10, 2: None, 3: 21, 4: None}


def test_as_of_many(spark):
    rnd = random.Random(9)
    right = sorted({(rnd.randint(0, 2), round(rnd.uniform(0, 30), 1)) for _ in range(80)})
    left = [(rnd.randint(0, 2), i, round(rnd.uniform(0, 30), 1)) for i in range(80)]
    got = as_of(spark.createDataFrame(left, "job_id int, id int, t double"), spark.createDataFrame(right, "job_id int, rt double"), ["job_id"], "t", "rt", [], seconds=2)
    for r in got.collect():
        ts = [t for j, t in right if j == r.job_id]
        i = bisect.bisect_right(ts, r.t)
        assert (r.before.t if r.before else None) == (ts[i - 1] if i else None)
        assert (r.after.t if r.after else None) == (ts[i] if i < len(ts) else None)


def test_scan_reads_no_frame_to_the_end(spark):
    """A frame from each row to the end is read anew for every row, which is quadratic in a block."""
    df = spark.createDataFrame(series(), "job_id int, t double, id int, v int")
    got = scan(df, ["job_id"], ["t", "id"], time_block("t", 3), back={"b": F.col("v")})
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()


def test_scan_low_is_the_least_from_here_on(spark):
    rows = series(seed=9)
    df = spark.createDataFrame(rows, "job_id int, t double, id int, v int")
    got = {(r.job_id, r.id): r.b for r in scan(df, ["job_id"], ["t", "id"], time_block("t", 3), low={"b": F.col("v")}).collect()}
    for job, rs in by_job(rows).items():
        for i, r in enumerate(rs):
            assert got[(job, r[2])] == min((x[3] for x in rs[i:] if x[3] is not None), default=None)


def test_as_of_times_alone(spark):
    """Without further columns the times aggregate by hashing, no rows are sorted for it; a side that is not asked for is left out."""
    left, right = series(seed=10), series(seed=11)
    l = spark.createDataFrame(left, "job_id int, t double, id int, v int")
    r = spark.createDataFrame([(j, t) for j, t, _, _ in right] + [(1, None), (1, float("nan"))], "job_id int, rt double")
    got = as_of(l, r, ["job_id"], "t", "rt", [], seconds=3)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    times = {j: [x[1] for x in rs] for j, rs in by_job(right).items()}
    for x in got.collect():
        before = [t for t in times.get(x.job_id, []) if t <= x.t]
        after = [t for t in times.get(x.job_id, []) if t > x.t]
        assert (x.before and x.before.t, x.after and x.after.t) == (max(before, default=None), min(after, default=None))
    assert as_of(l, r, ["job_id"], "t", "rt", [], sides=("before",)).columns == ["job_id", "t", "id", "v", "before"]


def test_blocks_of_greedy_thinning_are_plain_lists():
    """Most blocks hold one or two times, for which arrays cost far more than the times; the map of a block agrees with the choice."""
    from timbrel.functions.ordered import _kept, _last_kept

    rnd = random.Random(12)
    for _ in range(300):
        x = sorted({round(rnd.uniform(10, 14), 2) for _ in range(rnd.randint(1, 30))})
        gap, strict = rnd.choice([0.0, 0.1, 0.3, 1.0]), rnd.random() < 0.5
        entry = rnd.choice([None, round(rnd.uniform(8, 10), 2)])
        last, want = entry, []
        for i, t in enumerate(x):
            if last is None or (t - last > gap if strict else t - last >= gap):
                want.append(i)
                last = t
        assert _kept(x, entry, gap, strict) == want
        heads, tails = _last_kept(x, 10.0, gap, strict)
        first = next((i for i, h in enumerate(heads) if entry is None or (h - entry > gap if strict else h - entry >= gap)), None)
        assert (entry if first is None else tails[first]) == last
