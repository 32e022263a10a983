"""Post-processing of clips: segments are made once, and jobs of all lengths go through one pass over themes."""

import random

from pyspark.sql import functions as F

from timbrel.operators import clips as op

TITLES = ["red house by the sea", "red house near the sea", "red house", "two dogs run", "two dogs", "", "a b"]


def tables(spark):
    rng = random.Random(4)
    jobs = [(1, 600.0), (2, 2000.0), (3, 6000.0), (4, None)]
    clips = []
    for job, _ in jobs:
        for i in range(60):
            s = i * 40.0 + rng.randrange(20)
            clips.append((job, job * 100 + i, rng.choice(TITLES), s, s + 15.0, 15.0, rng.randrange(1, 100), rng.randrange(100), "tiktok", i))
    segments = [(job, i, f"s{i % 2}", rng.choice(["Wait, what?", "So it goes!", "plain words here"]), i * 5.0, i * 5.0 + 4.0) for job, _ in jobs for i in range(400)]
    scenes = [(job, i, i * 7.0, i % 10) for job, _ in jobs for i in range(200)]
    return (spark.createDataFrame(clips, "job_id long, clip_id long, title string, start double, end double, duration double, viral_score long, hook_score long, platform string, position long"),
            spark.createDataFrame(segments, "job_id long, seg_idx long, speaker string, text string, start double, end double"),
            spark.createDataFrame(scenes, "job_id long, scene_id long, t double, importance long"), spark.createDataFrame(jobs, "job_id long, duration double"))


def test_themes_of_each_job_have_their_own_limit(spark):
    clips, _, _, jobs = tables(spark)
    d = clips.join(jobs.select("job_id", F.col("duration").alias("_dur")), "job_id")
    most = F.when(F.col("_dur") < 1800, 3).when(F.col("_dur") < 5400, 4).otherwise(5)
    got = {(r.job_id, r.clip_id) for r in op.limit_themes(d, most).collect()}
    for job, k in ((1, 3), (2, 4), (3, 5)):
        want = {(r.job_id, r.clip_id) for r in op.limit_themes(clips.where(F.col("job_id") == job), k).collect()}
        assert {x for x in got if x[0] == job} == want and len(want) < 60


def test_segments_are_made_once(spark, monkeypatch):
    clips, segments, scenes, jobs = tables(spark)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    passes = []
    fold = op.fold_sorted
    monkeypatch.setattr(op, "fold_sorted", lambda *a, **k: (passes.append(a[1]), fold(*a, **k))[1])
    out = op.post_process(clips, segments.withColumn("text", counted.asNondeterministic()("text")), scenes, jobs, 5).collect()
    assert sorted({r.job_id for r in out}) == [1, 2, 3]
    assert made.value == segments.count()
    assert passes.count(["job_id"]) == 1
