"""Choices that depend on earlier ones, decided in parallel: thinning by block maps, suppression by rounds of local winners."""

import random

import pytest

from timbrel.functions import ordered
from timbrel.operators import clips as cl
from timbrel.operators import joins, windows


def thinned(rows, gap, strict=False):
    out, last = [], {}
    for key, t, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if key not in last or ((t - last[key]) > gap if strict else (t - last[key]) >= gap):
            last[key] = t
            out.append((key, t, i))
    return out


@pytest.mark.parametrize(("gap", "strict"), [(0.3, False), (1.0, True), (0.05, False), (5.0, False), (1000.0, False)])
def test_keep_spaced_splits_a_dense_job(spark, gap, strict):
    rng = random.Random(1)
    rows, t = [], 0.0
    for i in range(12000):  # one job without any gap holds nearly all rows, and many times twice
        t = round(t + rng.choice([0.0, 0.01, 0.05, 0.1, 0.2]), 2)
        rows.append((1, t, i))
    rows += [(k, round(rng.uniform(-20, 20), 1), 20000 + 40 * i + (k or 0)) for i in range(30) for k in (2, 3, None)]
    d = spark.createDataFrame(rows, "job long, t double, i long")
    got = sorted(((r.job, r.t, r.i) for r in ordered.keep_spaced(d, ["job"], "t", gap, ["t", "i"], strict=strict).collect()), key=lambda r: (r[0] is not None, r))
    assert got == sorted(thinned(rows, gap, strict), key=lambda r: (r[0] is not None, r))


def test_keep_spaced_without_rows_and_gap(spark):
    d = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 2.5), (1, None)], "job long, t double")
    assert sorted(ordered.keep_spaced(d, ["job"], "t", 0.0, ["t"]).collect()) == [(1, 2.0), (1, 2.5)]
    assert ordered.keep_spaced(d.limit(0), ["job"], "t", 1.0, ["t"]).collect() == []


def clip_rows(seed, n, focus):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = round(rng.uniform(0, n / 4), 1)
        end = round(start + rng.choice([1.0, 4.0, 12.0, 30.0, 90.0, 0.0]) + rng.random(), 1)
        rows.append((rng.choice([1, 1, 1, 2]), i, start, end, round(end - start, 1), rng.choice(focus), None, rng.randrange(1, 40), i))
    return rows


CLIPS = "job_id long, clip_id long, start double, end double, duration double, clip_focus string, focus_relevance long, viral_score long, position long"


def greedy(rows, clash, group):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[7], r[8])):
        if not any(group(r) == group(k) and clash(r, k) for k in kept):
            kept.append(r)
    return sorted(r[1] for r in kept)


def iou(a, b):
    inter, union = min(a[3], b[3]) - max(a[2], b[2]), max(a[3], b[3]) - min(a[2], b[2])
    return inter > 0 and union > 0 and inter / union >= 0.6


def shorter(a, b):
    inter, short = max(0.0, min(a[3], b[3]) - max(a[2], b[2])), min(a[4], b[4])
    if short > 0 and inter / short > 0.5:
        return True
    gap, total = min(abs(a[2] - b[3]), abs(b[2] - a[3])), a[4] + b[4]
    return gap < 5 and total > 0 and (max(a[3], b[3]) - min(a[2], b[2])) / total < 1.15


@pytest.mark.parametrize("dense", [0, 30, 10**6])
def test_suppression_in_rounds_is_the_greedy_choice(spark, dense):
    rows = clip_rows(2, 250, [None, "", "talk"])
    d = spark.createDataFrame(rows, CLIPS)
    want = greedy(rows, iou, lambda r: (r[0], r[5] or ""))
    assert sorted(r.clip_id for r in cl.drop_time_duplicates(d, dense=dense).select("clip_id").collect()) == want
    want = greedy(rows, shorter, lambda r: r[0])
    assert sorted(r.clip_id for r in cl.drop_overlapping(d, dense=dense).select("clip_id").collect()) == want


def test_rounds_leave_a_rest_for_the_ordered_pass(spark, monkeypatch):
    monkeypatch.setattr(cl, "ROUNDS", 1)
    rows = [(1, i, 2.0 * i, 2.0 * i + 9.0, 9.0, None, None, 1 + i % 100, i) for i in range(300)]
    got = cl.drop_time_duplicates(spark.createDataFrame(rows, CLIPS), dense=0)
    assert sorted(r.clip_id for r in got.collect()) == greedy(rows, iou, lambda r: r[0])


def test_spikes_against_all_pairs(spark):
    rng = random.Random(5)
    samples = [(j, round(rng.uniform(0, 60), 3), rng.choice([1.0, 2.0, 2.5, 40.0]) if j < 3 else 55.3) for j in (1, 2, 3) for _ in range(400)]
    samples += [(4, float(t), 1.0 + (t == 7) * 50) for t in range(20)] + [(5, 0.0, 1.0), (5, 1.0, None)]
    targets = [(j, 1000 * j + i, float(i) if j >= 4 else round(rng.uniform(-3, 63), 3)) for j in (1, 2, 3, 4, 5, 6) for i in range(40)]
    env = spark.createDataFrame(samples, "job_id long, t double, energy double")
    got = joins.spikes_at(spark.createDataFrame(targets, "job_id long, target long, t double"), env, "target", sigma=1.5)
    want = []
    for j, i, t in targets:
        at = round(t * 1e6)
        own = [(round(s * 1e6), e) for k, s, e in samples if k == j and e is not None and abs(round(s * 1e6) - at) <= 2_000_000]
        near = [e for s, e in own if abs(s - at) <= 200_000]
        spike = False
        if len(own) >= 3 and near:
            mean = sum(e for _, e in own) / len(own)
            spread = (sum((e - mean) ** 2 for _, e in own) / len(own)) ** 0.5
            spike = spread > 1e-9 and max(near) - mean >= 1.5 * spread
        want.append((i, spike))
    assert sorted((r.target, r.spike) for r in got.collect()) == sorted(want) and any(s for _, s in want)
    around = joins.around(spark.createDataFrame(targets, "job_id long, target long, t double"), env, "target", "energy", {"a": 2.0})
    assert "Join" not in around._jdf.queryExecution().executedPlan().toString()


def test_merge_close_in_a_dense_job(spark):
    rng = random.Random(6)
    rows = [(1, i, round(i * 0.3 + rng.random() * 0.2, 2), rng.choice(["kill", "hud"]), rng.random(), 0.25) for i in range(3000)]
    rows += [(1, 5000, rows[7][2], "kill", 0.5, 0.0), (2, 6000, 1.0, "hud", 0.5, 0.5)]
    d = spark.createDataFrame(rows, "job_id long, event_id long, t double, kind string, confidence double, event_len double")
    got = sorted((r.job_id, r.event_id, r.n, r.kind) for r in windows.merge_close(d).collect())
    want, group = [], []
    for r in [*sorted(rows, key=lambda r: (r[0], r[2], r[1])), (9, 0, 0.0, "", 0, 0)]:
        if group and (r[0] != group[0][0] or r[2] - group[0][2] > 1.5):
            want.append((group[0][0], group[0][1], len(group), "chaos" if len(group) > 1 else group[0][3]))
            group = []
        group.append(r)
    assert got == sorted(want)
