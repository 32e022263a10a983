"""Fingerprints matched to slots, against a plain loop."""

import random

import pytest

from timbrel.operators import fingerprints as fp

PRINTS, SLOTS = "job_id long, print_id long, histogram array<double>", "job_id long, slot_id long, centroid array<double>"


def distance(a, b):
    return sum((x - y) ** 2 / (x + y + 1e-9) for x, y in zip(a, b)) if len(a) == len(b) else float("inf")


def looped(prints, slots, threshold):
    known, out = {}, {}
    for job, slot, v in slots:
        known.setdefault(job, {})[slot] = v
    for job, i, v in sorted(prints):
        mine = known.setdefault(job, {})
        far, slot = min(((distance(v, c), s) for s, c in mine.items()), default=(float("inf"), None))
        if far > threshold:
            slot = max(mine, default=-1) + 1
            mine[slot] = v
        out[job, i] = slot
    return out, {(job, s): v for job, m in known.items() for s, v in m.items()}


@pytest.mark.parametrize(("heads", "block", "spread"), [(3, 4, 0.2), (512, 256, 0.2), (5, 8, 0.6)])
def test_match_to_slots(spark, monkeypatch, heads, block, spread):
    monkeypatch.setattr(fp, "HEADS", heads)
    monkeypatch.setattr(fp, "BLOCK_ROWS", block)
    rng = random.Random(heads)

    def histogram(kinds):
        base = [1.0 if k == rng.randrange(kinds) else 0.1 for k in range(6)]
        v = [b + spread * rng.random() for b in base]
        return [x / sum(v) for x in v]

    prints = [(rng.choice([1, 1, 1, 2]), i, histogram(4)) for i in range(120)]
    prints += [(1, 200 + i, prints[i][2]) for i in range(10)] + [(3, 7, [0.5, 0.5]), (3, 9, [0.5, 0.25, 0.25]), (3, 11, []), (3, 12, [])]
    slots = [(1, 4, histogram(4)), (1, 2, histogram(4)), (2, 0, [1.0]), (5, 0, [1.0])]
    want, centres = looped(prints, slots, 0.1)
    got, after = fp.match_to_slots(spark.createDataFrame(prints, PRINTS), spark.createDataFrame(slots, SLOTS), 0.1)
    assert {(r.job_id, r.print_id): r.slot_id for r in got.collect()} == want
    assert {(r.job_id, r.slot_id): r.centroid for r in after.collect()} == centres


def test_match_to_slots_at_the_edges(spark):
    no_slots, no_prints = spark.createDataFrame([], SLOTS), spark.createDataFrame([], PRINTS)
    assert [d.count() for d in fp.match_to_slots(no_prints, no_slots)] == [0, 0]
    prints = spark.createDataFrame([(1, 1, None), (1, 2, [0.5, None]), (1, 3, [0.5, 0.5]), (None, 4, [1.0, 0.0])], PRINTS)
    got, after = fp.match_to_slots(prints, spark.createDataFrame([(1, 8, None)], SLOTS))
    assert {r.print_id: r.slot_id for r in got.collect()} == {1: None, 2: None, 3: 9, 4: None}
    assert sorted((r.slot_id, r.centroid) for r in after.where("job_id = 1").collect() if r.centroid) == [(9, [0.5, 0.5])]


def test_blocks_of_sparse_ids_and_no_broadcast_of_copies(spark):
    prints = spark.range(512).selectExpr("1L AS job_id", "id * 20 AS print_id", "array(1.0D, double(id)) AS v")
    assert fp._blocks(prints.selectExpr("*", "print_id AS _id"), ["job_id"], "_b").select("_b").distinct().count() == 2
    centroids = prints.selectExpr("job_id", "print_id AS slot_id", "0L AS born", "v")
    plan = fp._within(prints, centroids, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "_salt" in line and "SortMergeJoin" in line]
    assert not [line for line in plan.splitlines() if "_salt" in line and "BroadcastHashJoin" in line]


def test_persistent_ids_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK_ROWS", 8)
    from timbrel.operators.profiles import persistent_ids

    rng = random.Random(4)
    base = [[rng.random() ** 3 for _ in range(8)] for _ in range(12)]
    rows = [(i % 2, i * 5, [max(0.0, x + rng.uniform(-0.1, 0.1)) for x in base[rng.randrange(12)]]) for i in range(90)]
    rows += [(0, 1000 + i, rows[4][2]) for i in range(5)]
    d = persistent_ids(spark.createDataFrame(rows, "job_id long, track_id long, signature array<double>"))
    got = {(r.job_id, r.track_id): r.persistent_id for r in d.collect()}
    for job in (0, 1):
        seen, ids = [], {}
        for _, i, v in sorted(r for r in rows if r[0] == job):
            root = [(x / sum(v)) ** 0.5 for x in v]
            near = min(((max(0.0, 1.0 - sum(a * b for a, b in zip(root, other))) ** 0.5, k) for k, other in seen), default=(1.0, None))
            ids[i] = ids[near[1]] if near[0] < 0.35 else len(set(ids.values()))
            seen.append((i, root))
        assert {k: v for (j, k), v in got.items() if j == job} == ids


def test_persistent_ids_makes_no_rows_of_pairs(spark):
    from timbrel.operators.profiles import persistent_ids

    rows = spark.range(600).selectExpr("0L AS job_id", "id AS track_id", "array(id % 7 + 1.0D, id % 11 + 1.0D, 3.0D) AS signature")
    own = fp.met_blocks(*[rows.selectExpr("job_id", "track_id AS _id", "signature AS v")] * 2, ["job_id"])
    assert own.count() == 9
    assert persistent_ids(rows).count() == 600
