"""Metric bundle, raw intent signal and face height on small hand-made rows."""

from pyspark.sql import functions as F

from timbrel.operators import catalog, clips, metrics, tracks, windows

SPAN = "job_id long, span_id long, start double, `end` double, active_slot long"


def test_fixture_scores(spark):
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id long")
    spans = spark.createDataFrame([(1, 1, 0.0, 4.0, 1), (1, 2, 4.0, 8.5, 2), (1, 3, 8.0, 9.0, 2), (1, 4, 9.0, 12.0, None), (2, 1, 0.0, 5.0, 1), (2, 2, 5.0, 6.0, 1)], SPAN)
    expected = spark.createDataFrame([(1, 4.5), (1, 4.51), (1, 8.0), (1, 8.5), (2, 5.0)], "job_id long, t double")
    frames = spark.createDataFrame([(1, 0, 50.0), (1, 1, 52.0), (1, 2, 60.0), (1, 3, 50.0)], "job_id long, frame long, cx double")
    regions = spark.createDataFrame([(1, 0, 30.0, 70.0), (1, 2, 30.0, 70.0), (1, 2, 55.0, 60.0)], "job_id long, frame long, left double, right double")
    grid = spark.createDataFrame([(1, 4.1), (1, 8.3)], "job_id long, beat double")
    faces = spark.createDataFrame([(1, 0.3), (1, 0.5)], "job_id long, y double")
    d = metrics.fixture_scores(jobs, spans, expected, frames, regions, grid, faces, 50.0, ((30.0, 10.0),))
    rows = {r.job_id: r.asDict() for r in d.collect()}
    one = rows[1]
    assert one["switch_recall"] == 0.5  # switches at 4 and 9
    assert one["overlap_count"] == 1
    assert one["max_acceleration"] == 18.0 and one["max_jerk"] == 24.0
    assert one["miss_rate"] == 0.5  # of the two frames with regions
    assert (one["cuts"], one["snapped"], one["snap_rate"]) == (3, 1, 0.3333)
    assert (one["mean_error_ms"], one["max_error_ms"]) == (366.67, 700.0)
    assert one["preserved"] == 0.75 and one["thirds_rate"] == 0.5
    two = rows[2]
    assert two["switch_recall"] == 0.0 and (two["cuts"], two["snap_rate"], two["mean_error_ms"]) == (1, 0.0, None)
    three = rows[3]
    assert three["switch_recall"] == 1.0 and three["cuts"] == 0 and three["preserved"] == 0.0 and three["max_jerk"] == 0.0
    bare = metrics.fixture_scores(jobs, spans, expected, frames, regions, grid, faces, 50.0)
    assert {r.job_id: r.preserved for r in bare.collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_intent_signal(spark):
    times = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0)], "job_id long, t double")
    events = spark.createDataFrame([(1, 0.0, 1.0, 4, 0.5), (1, 0.5, 1.5, 4, None), (1, 0.0, 9.0, -1, 0.9)], "job_id long, start double, `end` double, slot_id long, confidence double")
    faces = spark.createDataFrame([(1, 1.0, 4, 0.8, None), (1, 1.0, -1, 0.8, 0.9), (1, 1.5, 4, 0.9, 0.9), (1, 1.0, 6, None, 0.5)], "job_id long, t double, slot_id long, lip double, confidence double")
    tracks_ = spark.createDataFrame([(1, 0.0, 2.0, None, 2, 0.5), (1, 2.0, 2.5, 4, 0, 1.0)], "job_id long, start double, `end` double, slot_id long, persistent_id long, confidence double")
    regions = spark.createDataFrame([(1, 2.0, 0, 0.9), (1, 3.0, 0, 0.5), (1, 3.0, 1, None), (1, 7.0, 0, 1.0)], "job_id long, t double, region_no long, score double")
    got = {(r.t, r.subject_id): round(r.confidence, 9) for r in windows.intent_signal(times, events, faces, tracks_, regions).collect()}
    assert got == {(1.0, 4): 1.0, (1.0, 6): 0.0, (1.0, -3): 0.1, (2.0, -3): 0.1, (2.0, 4): 0.2, (3.0, -1000): 0.2, (3.0, -1001): 0.16}


def test_face_height(spark):
    clips = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 20.0, 30.0), (2, 3, 0.0, 10.0)], "job_id long, clip_id long, start double, `end` double")
    faces = spark.createDataFrame([
        (1, 1, 0.0, 0, False, 10.0), (1, 1, 0.0, 1, True, 20.0), (1, 1, 0.0, 2, True, 90.0), (1, 2, 10.0, 1, None, 99.0), (1, 2, 10.0, 0, None, 40.0),
        (1, 3, 5.0, 0, True, None), (1, 3, 5.0, 1, False, 77.0), (1, 4, 10.5, 0, True, 1.0)],
        "job_id long, scene_id long, t double, face_no long, is_speaking boolean, y double")
    got = {r.clip_id: r.y for r in tracks.clip_face_height(clips, faces).collect()}
    assert got == {1: 30.0, 2: 50.0, 3: 50.0}


def test_zone_signals(spark):
    jobs = spark.createDataFrame([(1, 50.0), (2, 0.0)], "job_id long, duration double")
    said = [(1, 0, "a", 0.0, 2.0, "that was insane"), (1, 1, "b", 2.0, 4.0, "NOW look"), (1, 2, "a", 4.0, 6.0, "right"), (1, 3, "b", 6.0, 8.0, "yes"), (1, 4, "a", 8.0, 9.0, "so"),
            (1, 5, "b", 9.0, 10.0, "ok"), (1, 6, "a", 10.0, 11.0, "hm"), (1, 7, "b", 41.0, 51.0, "WOW outside")]
    segments = spark.createDataFrame(said, "job_id long, seg_idx long, speaker string, start double, `end` double, text string")
    scenes = spark.createDataFrame([(1, 5.0, 8), (1, 45.0, 7)], "job_id long, t double, importance long")
    loud = [(1, 1, 2.5, "extreme_spike", "laughter"), (1, 2, 2.5, "volume_spike", "applause"), (1, 3, 3.5, "silence_to_loud", None), (1, 4, 3.6, "extreme_spike", None), (1, 5, 45.0, None, "cheering")]
    moments = spark.createDataFrame(loud, "job_id long, moment_id long, t double, kind string, sentiment string")
    fillers = spark.createDataFrame([(1, float(i), float(i) + 1) for i in range(4)], "job_id long, start double, `end` double")
    trend = clips.window_trend(jobs, segments, [("insane", [], 1.0)], F.lit(None).cast("string"))
    assert {r.win: (r.trend, r.reason) for r in trend.collect()} == {0: (80, "insane")}
    got = {(r.job_id, r.win): r.signals for r in clips.zone_signals(jobs, segments, scenes, moments, fillers, trend).collect()}
    assert got == {
        (1, 0): ["extreme audio spike at 2s", "laughter at 2s", "silence->loud at 4s", "high filler density", "emotional reaction", "raised voice", "dense dialogue", "visual peak (8/10)",
                 "2 speakers", "rapid exchange", "trend match: insane"],
        (1, 1): ["cheering at 45s"], (1, 2): ["cheering at 45s"]}
    quiet = clips.zone_signals(jobs, segments.limit(0), scenes.limit(0), moments.limit(0))
    assert {(r.job_id, r.win): r.signals for r in quiet.collect()} == {(1, 0): [], (1, 1): [], (1, 2): []}


def test_job_findings(spark):
    jobs = spark.createDataFrame([(1, 100.0, "complete", {"text": "none"}), (2, 0.0, "complete", None), (3, 0.0, "queued", {})], "job_id long, duration double, status string, providers map<string,string>")
    cuts = [(1, 1, -1.0, 9.0, 4.0), (1, 2, 3.0, 3.0, 601.0), (1, 3, 50.0, 101.5, 20.0), (1, 4, 60.0, 80.0, 20.0), (9, 5, -1.0, 9.0, 4.0)]
    made = spark.createDataFrame(cuts, "job_id long, clip_id long, start double, `end` double, duration double")
    segments = spark.createDataFrame([(1, "a"), (1, " \u3000"), (1, None)], "job_id long, text string")
    scenes = spark.createDataFrame([(1,), (3,)], "job_id long")
    got = {tuple(r) for r in catalog.job_findings(jobs, segments, scenes, made).collect()}
    assert got == {
        (1, 1, "warning", "Clip 1: too short (4.0s)"), (1, 1, "error", "Clip 1: negative start (-1.0s)"), (1, 1, "warning", "Clips 1 and 2: 6.0s overlap (>2s)"),
        (1, 2, "warning", "Clip 2: too long (601.0s)"), (1, 2, "error", "Clip 2: end <= start (3.0-3.0)"), (1, 3, "error", "Clip 3: end (101.5s) exceeds video duration (100.0s)"),
        (1, 3, "warning", "Clips 3 and 4: 41.5s overlap (>10s)"), (1, None, "warning", "2 empty transcript segments detected"), (1, None, "warning", catalog.NO_PROVIDER),
        (2, None, "error", catalog.NO_TRANSCRIPT), (2, None, "error", catalog.NO_SCENES), (2, None, "error", catalog.NO_CLIPS), (3, None, "error", catalog.NO_TRANSCRIPT)}
