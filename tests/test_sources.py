"""File sources and sinks on small files."""

import json

from pyspark.sql import functions as F

from timbrel.sources import readers, sinks


def test_job_documents(spark, tmp_path):
    for i, doc in enumerate([
        {"job_id": "a", "created_at": "2024-01-02", "owner_user_id": "u1", "clips": [{"id": 1, "title": "x"}], "timings": {"s": 1.5}},
        {"job_id": "b", "created_at": "2024-01-03", "owner_user_id": "", "owner_username": ""},
        {"job_id": "c", "created_at": "2024-01-01", "owner_user_id": "u9", "owner_username": "ANN"},
    ]):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "job.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "job.json").write_text("{broken")
    jobs = readers.read_jobs(spark, f"{tmp_path}/*/job.json")
    assert [r.job_id for r in readers.owned_jobs(jobs).collect()] == ["b", "a", "c"]
    assert [r.job_id for r in readers.owned_jobs(jobs, "u1", "ann").collect()] == ["a", "c"]
    assert [r.job_id for r in readers.owned_jobs(jobs, "u1", include_unowned=True).collect()] == ["b", "a"]
    assert readers.child_rows(jobs, "clips", "pos").select("job_id", "title").collect() == [("a", "x")]


def test_lexicon(spark, tmp_path):
    path = tmp_path / "lex.json"
    path.write_text(json.dumps({"version": "1", "entries": [{"phrase": "go viral", "genres": ["vlog"], "hotness": 0.9}, {"phrase": "plain"}, {"genres": []}, {"phrase": "bad", "hotness": "x"}]}))
    got = {r.phrase: (r.hotness, list(r.genres)) for r in readers.read_lexicon(spark, str(path)).collect()}
    assert got == {"go viral": (0.9, ["vlog"]), "plain": (0.5, [])}
    assert readers.read_lexicon(spark, str(tmp_path / "none.json")).count() == 0


def test_trajectories_and_timelines(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "clip-a.jsonl").write_text('{"t":0,"cx":0.5,"cy":0.5,"w":0.3,"h":1}\n{"t":1,"cx":0.6,"cy":0.5,"w":0.3,"h":1,"n_subjects_in_crop":2,"is_split_screen":true}\n')
    rows = readers.read_trajectories(spark, f"{tmp_path}/t").orderBy("t").collect()
    assert [(r.slug, r.n_subjects_in_crop, r.is_split_screen) for r in rows] == [("clip-a", 1, False), ("clip-a", 2, True)]
    (tmp_path / "m.json").write_text(json.dumps({"clips": [{"slug": "a", "duration_sec": 3}, {"slug": "b"}, {"slug": "c"}]}))
    manifest = readers.read_manifest(spark, f"{tmp_path}/m.json")
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.json").write_text(json.dumps({"events": [{"frame": 0, "t": 0.0, "scene_change": True}, {"frame": 1, "t": 0.1, "scene_change": False}]}))
    (tmp_path / "e" / "b.json").write_text("{nope")
    got = readers.read_timelines(spark, manifest, f"{tmp_path}/e").groupBy("slug").agg(F.count("frame").alias("n")).orderBy("slug").collect()
    assert [(r.slug, r.n) for r in got] == [("a", 2), ("b", 0), ("c", 0)]


def test_logs_oldest_first(spark, tmp_path):
    for name, text in (("app.log", "now\n"), ("app.log.1", "before\n"), ("app.log.2", "first\nsecond\n")):
        (tmp_path / name).write_text(text)
    assert [r.line for r in readers.read_logs(spark, f"{tmp_path}/app.log*").collect()] == ["first", "second", "before", "now"]


def test_media_listing_from_files(spark, tmp_path):
    d = tmp_path / "job1" / "media"
    d.mkdir(parents=True)
    for n in ("a.MP4", "_meta.json", "b.txt", "c.png"):
        (d / n).write_bytes(b"x")
    names = spark.createDataFrame([("job1", "a", "Holiday.mp4")], "job_id string, media_id string, original_filename string")
    got = readers.media_listing(readers.list_files(spark, str(tmp_path)), names).orderBy("id").collect()
    assert [(r.id, r.filename, r.type, r.size) for r in got] == [("a", "Holiday.mp4", "video", 1), ("c", "c.png", "image", 1)]


def test_sinks_write_and_overwrite(spark, tmp_path):
    segs = spark.createDataFrame([("j1", 0, 0.0, 1.5, "Hi", "A"), ("j1", 1, 1.5, 3661.25, "there", "B"), ("j2", 0, 0.0, 1.0, "x", "")], "job_id string, seg_idx long, start double, end double, text string, speaker string")
    sinks.write_text(sinks.transcript_lines(segs, "txt"), str(tmp_path / "txt"), "seg_idx")
    assert spark.read.text(str(tmp_path / "txt")).where("job_id = 'j1'").orderBy("value").collect()[0].value == "[A] Hi"
    rows = sinks.srt_rows(segs).orderBy("job_id", "number").collect()
    assert rows[1].span == "00:00:01,500 --> 01:01:01,250" and rows[2].text == "x"
    sinks.overwrite_partitions(segs, str(tmp_path / "p"), "job_id")
    sinks.overwrite_partitions(segs.where("job_id = 'j2'").withColumn("text", F.lit("new")), str(tmp_path / "p"), "job_id")
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "p")).collect()) == ["Hi", "new", "there"]
    jobs = spark.createDataFrame([("a", "f.mp4", None, "complete", None)], "job_id string, filename string, provider_used map<string,string>, status string, estimated_cost_usd double")
    sinks.write_usage(jobs, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0].cost_usd == "0.0"
