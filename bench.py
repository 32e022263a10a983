"""Benchmark of the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
data and the local cores.  Results are written to the no-op sink, so every row
is computed and none is collected.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from timbrel.plans import load_all

HEADLINE = (
    "score1_transcript_hot_zones", "score1_full_hot_zones", "score2_final_scores", "score4_trend_score", "score5_retention", "score6_opening_score", "score7_thirds_score",
    "set3_drop_time_duplicates", "set5_limit_themes", "topk3_stratified_top", "join1_speakers_by_overlap", "join3_nearest_later_wins", "join8_fuse_voice", "join11_snap_to_words",
    "join34_crop_pass_rate", "join39_shot_focus", "win3_filler_events", "win13_merge_close", "win17_pacing", "win20_loudness_moments", "win22_metric_cuts", "win23_smooth_both_ways",
    "agg2_job_verdict", "agg8_hold_distribution", "agg13_framing_f1", "agg16_parity_report", "agg40_shot_motion", "fn4_looping_text", "fn2_bucket_similarity", "src14_plan_events",
    "str1_provider_health", "str3_baseline_triggers",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.default.parallelism", cpus)
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    queries["flt1_clip_filter"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the engine
    took = {}
    for name in HEADLINE:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


main()
