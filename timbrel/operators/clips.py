"""Clip candidates: suppression, selection, scoring and post-processing."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import cut_lineage, fold_sorted, islands, scan, time_block, written
from ..functions.ranges import near_pairs, overlap_pairs, points_in
from ..functions.text import title_words, tokens
from .joins import snap_to_speech
from .windows import has_any, split_words

KEY = ["job_id", "clip_id"]


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def append_or_replace(existing: DataFrame, new: DataFrame, append: bool = True) -> DataFrame:
    """Add clips after the highest id of their job, or replace with ids from 1, in ``position`` order."""
    rank = scan(new, ["job_id"], ["position"], F.floor(F.col("position") / 4096), total={"_n": F.lit(1).cast("long")})
    if not append:
        return rank.withColumn("clip_id", F.col("_n")).drop("_n", "position")
    top = existing.groupBy("job_id").agg(F.max("clip_id").alias("_top"))
    d = rank.join(top, "job_id", "left").withColumn("clip_id", F.coalesce("_top", F.lit(0)) + F.col("_n")).drop("_n", "_top", "position")
    return existing.unionByName(d)


def _time_clusters(clips: DataFrame, keys: list[str], slack: float) -> DataFrame:
    """Number the groups of clips that can touch each other: a clip starting ``slack`` or
    more after everything before it ended opens a new group."""
    order = ["start", "end", "clip_id"]
    d = scan(clips, keys, order, time_block("start"), peak={"_peak": F.col("end")})
    return islands(d, keys, order, time_block("start"), ["start", "_peak"], lambda p, c: c["start"] - p["_peak"] >= slack, "_cluster").drop("_peak")


#: Groups of more touching clips are decided in rounds; at most so many rounds before the ordered pass takes the rest.
DENSE, ROUNDS = 20_000, 24


def _suppress(d: DataFrame, keys: list[str], order: list[str], clash, slack: float, meets, dense: int = DENSE) -> DataFrame:
    """Greedy suppression in rank order; returns the kept clips' keys.

    Clips that can touch each other are a group, and small groups go through an ordered pass
    each.  Of larger ones, those are decided first that no undecided better clip clashes with,
    in rounds; what they leave falls into smaller groups.  Both give the clips that are kept in
    rank order one by one: a clip is kept when no better kept clip clashes with it.
    """
    order = [*order, "clip_id"]
    groups = cut_lineage(_time_clusters(d, keys, slack))
    large = groups.groupBy(*keys, "_cluster").agg(F.count("*").alias("_n")).where(F.col("_n") > dense).drop("_n")
    if large.isEmpty():
        return _in_order(groups, keys, order, clash, slack)
    named = large.select(*[F.col(c).alias(f"_l_{c}") for c in large.columns])
    same = F.lit(True)
    for c in large.columns:
        same &= F.col(c).eqNullSafe(F.col(f"_l_{c}"))
    kept, rest = _in_rounds(groups.join(named, same, "left_semi").drop("_cluster"), keys, order, meets, slack)
    few = _in_order(groups.join(named, same, "left_anti"), keys, order, clash, slack)
    left = _in_order(_time_clusters(rest, keys, slack), keys, order, clash, slack)
    return few.unionByName(kept).unionByName(left)


def _in_rounds(clips: DataFrame, keys: list[str], order: list[str], meets, reach: float, width: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Clips kept by rounds of local winners, and the clips that are still undecided then.

    The best undecided clip of a cell (a stretch of time) wins when no better undecided clip that it
    clashes with is anywhere; what clashes with a winner is out.  Every clip meets the best ones of
    the cells near it only, so a round costs a few comparisons a clip however many share a cell.
    """
    own = ["start", "end", "duration"]
    rank = F.struct(*order).alias("rank")
    todo = cut_lineage(clips.select(*keys, "clip_id", *own, rank, *order[:-1]))
    kept = todo.select("job_id", "clip_id").limit(0)
    cells = F.explode(F.sequence(F.floor((F.col("start") - reach) / width), F.floor((F.col("end") + reach) / width))).alias("cell")
    for _ in range(ROUNDS):
        best = todo.groupBy(*keys, F.floor(F.col("start") / width)).agg(F.min_by(F.struct("clip_id", *own, "rank"), "rank").alias("b")).select(*keys, "b")
        best = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "b", cells_of("b", reach, width))
        near = todo.select(*keys, F.struct("clip_id", *own, "rank").alias("a"), cells)
        same = F.col("cell") == F.col("_cell")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        pairs = near.join(best, same).where((F.col("a.clip_id") != F.col("b.clip_id")) & meets(F.col("a"), F.col("b")))
        pairs = cut_lineage(pairs.select("job_id", F.col("a.clip_id").alias("clip_id"), F.col("b.clip_id").alias("best"), (F.col("a.rank") < F.col("b.rank")).alias("over")).distinct())
        beaten = pairs.where("over").select("job_id", F.col("best").alias("clip_id")).distinct()
        won = best.select(F.col("_job_id").alias("job_id"), F.col("b.clip_id").alias("clip_id")).distinct().join(beaten, KEY, "left_anti")
        won = cut_lineage(won)
        out = pairs.join(won.withColumnRenamed("clip_id", "best"), ["job_id", "best"], "left_semi").select("job_id", "clip_id").distinct()
        kept = kept.unionByName(won)
        todo = cut_lineage(todo.join(won, KEY, "left_anti").join(out, KEY, "left_anti"))
        if todo.isEmpty():
            break
    return kept, todo.select(*keys, "clip_id", *own, *order[:-1])


def cells_of(clip: str, reach: float, width: float) -> Column:
    """Cells of time in which a clip can meet others."""
    return F.explode(F.sequence(F.floor((F.col(f"{clip}.start") - reach) / width), F.floor((F.col(f"{clip}.end") + reach) / width))).alias("_cell")


def _in_order(d: DataFrame, keys: list[str], order: list[str], clash, reach: float) -> DataFrame:
    """Greedy pass in rank order per time cluster.

    Kept clips are indexed by 30 s cells, so a candidate is compared only with kept clips near it.
    """
    cols = d.columns
    j, c, s, e, n = (cols.index(x) for x in ("job_id", "clip_id", "start", "end", "duration"))

    def cells(a, b):
        return range(int((a - reach) // 30), int((b + reach) // 30) + 1)

    def step(kept, row):
        me = (row[s], row[e], row[n])
        for cell in cells(row[s], row[e]):
            if any(clash(me, other) for other in kept[cell]):
                return kept, []
        for cell in cells(row[s], row[e]):
            kept[cell].append(me)
        return kept, [(row[j], row[c])]

    job_type = d.schema["job_id"].dataType.simpleString()
    return fold_sorted(d, [*keys, "_cluster"], order, f"job_id {job_type}, clip_id bigint", lambda: defaultdict(list), step)


def drop_time_duplicates(clips: DataFrame, limit: float = 0.6, dense: int = DENSE) -> DataFrame:
    """Drop clips whose time IoU with a better kept clip of the same focus reaches the limit.

    Of exact copies only the best can survive, so copies are reduced before the choice.  Clips clash
    only where they overlap, so groups of overlapping clips are decided apart.
    """
    rank = F.coalesce("focus_relevance", "viral_score", F.lit(0)).cast("long")
    d = clips.select(*KEY, "start", "end", "duration", F.coalesce("clip_focus", F.lit("")).alias("_focus"), (-rank).alias("_rank"), "position")
    best = d.groupBy("job_id", "_focus", "start", "end").agg(F.min_by(F.struct("clip_id", "duration", "_rank", "position"), F.struct("_rank", "position")).alias("r"))
    best = best.select("job_id", "_focus", "start", "end", "r.*")

    def clash(a, b):
        inter = min(a[1], b[1]) - max(a[0], b[0])
        union = max(a[1], b[1]) - min(a[0], b[0])
        return inter > 0 and union > 0 and inter / union >= limit

    def meets(a: Column, b: Column) -> Column:
        inter = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
        union = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
        return (inter > 0) & (inter / F.when(union > 0, union) >= limit)

    keep = _suppress(best, ["job_id", "_focus"], ["_rank", "position"], clash, 0.0, meets, dense)
    return clips.join(keep, KEY, "left_semi")


def drop_overlapping(clips: DataFrame, limit: float = 0.5, dense: int = DENSE) -> DataFrame:
    """Drop clips covering more than ``limit`` of the shorter one of a better kept clip, or
    sitting next to it (gap under 5 s) with hardly any extra span.

    Inverted times are swapped first; an empty duration is then filled in.
    """
    flip = F.col("end") < F.col("start")
    d = clips.withColumns({"_s": F.least("start", "end"), "_e": F.greatest("start", "end")})
    d = d.withColumn("duration", F.when(flip & (F.col("duration") <= 0), F.round(F.col("_e") - F.col("_s"), 1)).otherwise(F.col("duration")))
    d = d.drop("start", "end").withColumnsRenamed({"_s": "start", "_e": "end"})

    def clash(a, b):
        inter = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
        short = min(a[2], b[2])
        if short > 0 and inter / short > limit:
            return True
        gap = min(abs(a[0] - b[1]), abs(b[0] - a[1]))
        total = a[2] + b[2]
        return gap < 5 and total > 0 and (max(a[1], b[1]) - min(a[0], b[0])) / total < 1.15

    def meets(a: Column, b: Column) -> Column:
        inter = F.greatest(F.lit(0.0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
        short = F.least(a["duration"], b["duration"])
        gap = F.least(F.abs(a["start"] - b["end"]), F.abs(b["start"] - a["end"]))
        total = a["duration"] + b["duration"]
        span = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
        covers = F.coalesce(inter / F.when(short > 0, short) > limit, F.lit(False))
        return covers | ((gap < 5) & F.coalesce(span / F.when(total > 0, total) < 1.15, F.lit(False)))

    slim = d.select(*KEY, "start", "end", "duration", (-F.col("viral_score")).alias("_rank"), "position")
    keep = _suppress(slim, ["job_id"], ["_rank", "position"], clash, 5.0, meets, dense)
    return d.join(keep, KEY, "left_semi").select(*clips.columns)


def limit_themes(clips: DataFrame, most: int | Column, similar: float = 0.75) -> DataFrame:
    """At most ``most`` kept clips per theme, by Jaccard similarity of title words.

    ``most`` is a number or a column that is the same in all rows of a job.
    Only the best ``most`` clips of identical word sets can matter (a later one
    meets at least as many similar kept clips), so the rest go before the pass.
    Clips without title words are always kept.
    """
    d = clips.select(*KEY, "viral_score", "position", title_words(F.col("title")).alias("_w"), (F.lit(most) if isinstance(most, int) else most).alias("_most"))
    plain = d.where(F.size("_w") == 0).select(*KEY)
    w = Window.partitionBy("job_id", "_w").orderBy(F.desc("viral_score"), "position")
    d = d.where(F.size("_w") > 0).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("_most"))
    d = d.select("job_id", (-F.col("viral_score")).alias("_rank"), "position", "clip_id", "_w", "_most")

    def step(state, row):
        kept, by_word = state
        mine = frozenset(row[4])
        near = {i for word in mine for i in by_word[word]}
        alike = sum(len(mine & kept[i]) / len(mine | kept[i]) > similar for i in near)
        if alike >= row[5]:
            return state, []
        for word in mine:
            by_word[word].append(len(kept))
        kept.append(mine)
        return state, [(row[0], row[3])]

    job_type = clips.schema["job_id"].dataType.simpleString()
    kept = fold_sorted(d, ["job_id"], ["_rank", "position"], f"job_id {job_type}, clip_id bigint", lambda: ([], defaultdict(list)), step)
    return clips.join(kept.unionByName(plain), KEY, "left_semi")


def coverage_gaps(jobs: DataFrame, clips: DataFrame, zones: DataFrame, least: float = 60.0, cap: int = 4) -> DataFrame:
    """Stretches of at least ``least`` whole seconds without a clip, in time order.

    A job without clips is one gap.  Where a job has zones scoring over 20, gaps
    must touch one of them.  ``jobs``: job_id, duration.
    """
    size = F.floor(F.col("duration") + 1).cast("long")
    j = jobs.select("job_id", "duration", size.alias("_n"))
    c = clips.select("job_id", "clip_id", F.expr("CAST(start AS BIGINT)").alias("_s"), F.expr("CAST(`end` AS BIGINT)").alias("_e")).join(j.where("duration > 0"), "job_id")
    c = c.withColumn("_e", F.least("_e", F.col("_n") - 1)).where("_e >= _s")
    order = ["_s", "_e", "clip_id"]
    d = scan(c, ["job_id"], order, F.floor(F.col("_s") / 60), peak={"_peak": F.col("_e")})
    d = scan(d, ["job_id"], order, F.floor(F.col("_s") / 60), prev={"_before": F.col("_peak")})
    inner = d.select("job_id", F.coalesce(F.col("_before") + 1, F.lit(0)).alias("start"), F.col("_s").alias("end"))
    tail = d.groupBy("job_id", "_n").agg(F.max("_e").alias("_m")).select("job_id", (F.col("_m") + 1).alias("start"), F.col("_n").alias("end"))
    gaps = inner.unionByName(tail).where(F.col("end") - F.col("start") >= least).select("job_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    good = zones.where("composite > 20").select("job_id", F.col("start").alias("z_start"), F.col("end").alias("z_end"))
    touching = overlap_pairs(gaps, good, ["job_id"], 60.0, r_span=("z_start", "z_end")).select("job_id", "start", "end").distinct()
    free = gaps.join(good.select("job_id").distinct(), "job_id", "left_anti")
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("start"))
    some = touching.unionByName(free).withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")
    covered = clips.join(j.where("duration > 0"), "job_id", "left_semi").select("job_id").distinct()
    none = j.join(covered, "job_id", "left_anti").select("job_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    return some.unionByName(none)


def best_zones(windows: DataFrame, zones: DataFrame, window_id: str, cap: int = 8) -> DataFrame:
    """Best zones that lie inside each window."""
    z = zones.select("job_id", F.col("start").alias("z_start"), F.col("end").alias("z_end"), "composite")
    hit = points_in(z, windows.select("job_id", window_id, "start", "end"), ["job_id"], 60.0, t="z_start").where("z_end <= `end`")
    rank = F.row_number().over(Window.partitionBy("job_id", window_id).orderBy(F.desc("composite"), "z_start"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= cap).select("job_id", window_id, "z_start", "z_end", "composite", "rank")


def stratified_top(clips: DataFrame, jobs: DataFrame, n: int) -> DataFrame:
    """Top ``n`` clips per job spread over 4-6 time slices.

    The best of each slice come first, then further rounds up to a soft cap,
    then the rest by score; that order is a sort key, so no round robin runs.
    """
    d = clips.join(jobs.select("job_id", F.col("duration").alias("_dur")), "job_id")
    slices = F.least(F.when(F.col("_dur") < 900, 4).when(F.col("_dur") < 3600, 5).otherwise(6), F.lit(n))
    size = clips.groupBy("job_id").agg(F.count("*").alias("_size"))
    d = d.join(size, "job_id").withColumns({"_k": slices, "_flat": (F.col("_size") <= n) | (F.col("_dur") <= 0) | F.lit(n <= 1)})
    slot = F.least(F.col("_k") - 1, F.greatest(F.lit(0), F.expr("CAST(start / (_dur / _k) AS BIGINT)")))
    d = d.withColumn("_b", F.when(F.col("_flat"), 0).otherwise(slot))
    by_score = [F.desc("viral_score"), F.asc("position")]
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("job_id", "_b").orderBy(*by_score))).where(F.col("_r") <= n).withColumn("_r", F.col("_r") - 1)
    soft = F.greatest(F.lit(2), F.floor(F.lit(n) / F.greatest(F.lit(1), F.col("_k") - 1)))
    early = ~F.col("_flat") & (F.col("_r") < soft)
    keys = [F.when(early, F.col("_r")).otherwise(n), F.when(early, F.col("_b")).otherwise(0), *by_score]
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy(*keys))).where(F.col("_n") <= n)
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(*by_score)))
    return d.drop("_dur", "_size", "_k", "_flat", "_b", "_r", "_n")


# Axis weights (hook, flow, value, trend) by content type.
AXES = ("hook", "flow", "value", "trend")
AXIS_WEIGHTS = {
    "talking_head": (0.30, 0.25, 0.30, 0.15), "multi_speaker_panel": (0.25, 0.30, 0.30, 0.15), "cinematic_dialogue": (0.25, 0.35, 0.30, 0.10),
    "gameplay": (0.40, 0.15, 0.30, 0.15), "gameplay_moba": (0.40, 0.15, 0.30, 0.15), "gameplay_tps": (0.40, 0.15, 0.30, 0.15), "gameplay_racing": (0.40, 0.15, 0.30, 0.15),
    "stream": (0.35, 0.20, 0.30, 0.15), "sports": (0.45, 0.10, 0.30, 0.15), "sports_basketball": (0.45, 0.10, 0.30, 0.15), "sports_racing": (0.45, 0.10, 0.30, 0.15),
    "music_video": (0.40, 0.20, 0.15, 0.25), "animation": (0.35, 0.25, 0.25, 0.15), "animation_dialogue": (0.30, 0.30, 0.25, 0.15),
}
DEFAULT_WEIGHTS = (0.30, 0.25, 0.35, 0.10)


def weights_of(content_type: Column) -> Column:
    table = F.create_map(*[x for k, w in AXIS_WEIGHTS.items() for x in (F.lit(k), F.array(*map(F.lit, w)))])
    return F.coalesce(F.element_at(table, content_type), F.array(*map(F.lit, DEFAULT_WEIGHTS)))


def final_scores(clips: DataFrame, content_type: Column, focus_mode: bool = False) -> DataFrame:
    """Axis composite per clip: weighted mean of the four axes, 1-100; clips without axis
    scores keep theirs (50 when empty).  In focus mode the stored score is relevance and stays."""
    w = weights_of(content_type)
    axes = [F.coalesce(F.col(f"{a}_score"), F.lit(0)) for a in AXES]
    empty = reduce(lambda a, b: a & b, [a == 0 for a in axes])
    raw = reduce(lambda a, b: a + b, [a * w[i] for i, a in enumerate(axes)])
    kept = F.when(F.coalesce("viral_score", F.lit(0)) == 0, 50).otherwise(F.col("viral_score"))
    score = clamp(F.when(empty, kept).otherwise(F.bround(raw)), 1, 100).cast("long")
    diag = F.struct(F.struct(*[a.alias(n) for a, n in zip(axes, AXES)]).alias("axis_scores"), w.alias("weights"), F.col("viral_score").alias("composite_before"),
                    score.alias("composite_after"), empty.alias("legacy_fill"), F.lit(focus_mode).alias("focus_mode"))
    d = clips.withColumns({"composite": score, "score_diagnostics": diag})
    return d if focus_mode else d.withColumn("viral_score", F.col("composite"))


def fill_axes(clips: DataFrame) -> DataFrame:
    """Fill missing axes from the single score; the trend axis becomes neutral 50."""
    score = clamp(F.coalesce("viral_score", F.lit(0)), 1, 100)
    cols = {f"{a}_score": F.when(F.col(f"{a}_score") == 0, F.lit(50) if a == "trend" else score).otherwise(F.col(f"{a}_score")) for a in AXES}
    filled = reduce(lambda a, b: a | b, [F.col(f"{a}_score") == 0 for a in AXES])
    return clips.withColumn("legacy_fill", filled).withColumns(cols)


def trend_score(text: Column, genre: Column, lexicon: list[tuple[str, list[str], float]], emphasis: tuple[str, ...] = (), web: str = "") -> Column:
    """Trend alignment of a text as struct(score, phrases, reason).

    The lexicon is a short list kept by the caller; it becomes an array literal,
    so texts are scored in place.
    """
    import re

    token = re.compile(r"[a-z][a-z0-9'-]{1,}")
    low = F.lower(F.coalesce(text, F.lit("")))
    seen = F.array_distinct(tokens(low))

    def entry(phrase, genres, hot):
        toks = sorted(set(token.findall(phrase.lower().strip())))
        return F.struct(F.lit(phrase).alias("p"), F.lit(phrase.lower().strip()).alias("n"), F.array(*map(F.lit, genres)).cast("array<string>").alias("g"),
                        F.lit(float(hot)).alias("h"), F.array(*map(F.lit, toks)).cast("array<string>").alias("t"))

    table = F.array(*[entry(*e) for e in lexicon])
    fits = lambda e: genre.isNull() | (F.size(e["g"]) == 0) | F.array_contains(e["g"], genre)
    exact = F.slice(F.filter(table, lambda e: low.contains(e["n"]) & fits(e)), 1, 3)
    loose = F.slice(F.filter(table, lambda e: (F.size(e["t"]) > 0) & (F.size(F.array_intersect(e["t"], seen)) >= F.greatest(F.lit(1), F.size(e["t"]) - 1)) & fits(e)), 1, 3)
    heat = lambda hits, each: F.aggregate(hits, F.lit(0.0), lambda acc, e: acc + each * e["h"])
    phrase = F.when(F.size(exact) > 0, heat(exact, 30.0)).otherwise(heat(loose, 15.0))
    hits = reduce(lambda a, b: a + b, [low.contains(k.lower()).cast("int") for k in emphasis if k], F.lit(0))
    web_words = sorted(set(token.findall(web.lower())))
    shared = F.size(F.array_intersect(F.array(*map(F.lit, web_words)).cast("array<string>"), seen)) >= 2 if web_words else F.lit(False)
    score = F.lit(50.0) + phrase + F.when(hits > 0, F.least(F.lit(25), hits * 10)).otherwise(0) + F.when(shared, 10).otherwise(0)
    names = F.when(F.size(exact) > 0, F.transform(exact, lambda e: e["p"])).otherwise(F.transform(loose, lambda e: F.concat(F.lit("~"), e["p"])))
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.struct(F.when(blank, 50).otherwise(F.bround(clamp(score, 20, 100))).cast("long").alias("score"),
                    F.when(blank, F.array().cast("array<string>")).otherwise(names).alias("phrases"),
                    F.when(~blank, F.concat_ws(", ", names, F.when(hits > 0, F.concat(hits.cast("string"), F.lit(" emphasized"))), F.when(shared, "web trend overlap"))).alias("reason"))


def matched_phrases(segments: DataFrame, lexicon: list[str], cap: int = 6) -> DataFrame:
    """Lexicon phrases that occur anywhere in a job's transcript, in lexicon order.

    A phrase may span two segments, so each segment is searched together with
    the start of the next one instead of joining a whole transcript.
    """
    longest = max((len(p) for p in lexicon), default=1)
    d = scan(segments, ["job_id"], ["seg_idx"], F.floor(F.col("seg_idx") / 4096), nxt={"_next": F.substring("text", 1, longest)})
    low = F.lower(F.concat_ws(" ", "text", "_next"))
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p.lower().strip()).alias("p")) for i, p in enumerate(dict.fromkeys(lexicon))])
    hit = d.select("job_id", F.explode(F.filter(table, lambda e: low.contains(e["p"]))).alias("e")).select("job_id", "e.*").distinct()
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("i"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= cap).select("job_id", F.col("p").alias("phrase"), "rank")


RAISED = lambda words: F.exists(words, lambda w: (w == F.upper(w)) & (F.length(w) > 2) & w.rlike(r"^\p{L}+$"))

# Phrases used by the highlight and retention scores.
EXCITED = ("haha", "lol", "wow", "oh my", "oh no", "omg", "damn", "holy", "crazy", "insane", "unbelievable", "incredible", "amazing")
CURIOUS = ("secret", "never", "always", "worst", "best", "crazy", "insane", "shocking", "truth", "actually", "honestly", "literally", "imagine")
BRIGHT = ("wow", "oh my", "amazing", "incredible", "unbelievable")
DARK = ("sad", "unfortunately", "terrible", "awful")
BOLD = ("never", "always", "the truth", "the real", "actually", "honestly", "people don't", "nobody", "everybody", "the best", "the worst")


def _windows_of(rows: DataFrame, first: Column, last: Column, jobs: DataFrame, size: float, step: float) -> DataFrame:
    """Copy rows to the sliding windows that may hold them and attach the window bounds."""
    lo = F.greatest(F.lit(0), F.ceil((last - size) / step)).cast("long")
    hi = F.floor(first / step).cast("long")
    d = rows.withColumn("_hi", hi).withColumn("_lo", lo).where("_hi >= 0 AND _hi >= _lo").withColumn("win", F.explode(F.sequence(F.col("_lo"), F.col("_hi"))))
    d = d.join(jobs.select("job_id", F.col("duration").alias("_dur")), "job_id").drop("_hi", "_lo")
    start = F.col("win") * step
    return d.withColumns({"w_start": start, "w_end": F.least(start + size, F.col("_dur"))}).where(F.col("w_start") < F.col("_dur")).drop("_dur")


def hot_zones(jobs: DataFrame, segments: DataFrame, scenes: DataFrame | None = None, moments: DataFrame | None = None, fillers: DataFrame | None = None,
              trend: DataFrame | None = None, size: float = 30.0, overlap: float = 10.0) -> DataFrame:
    """Highlight score of every 30 s window (20 s step) of a job from speech, scenes and sound.

    Rows find their windows by arithmetic and each signal is one aggregate on
    (job, window), so a long job is split over its windows.  With only a
    transcript the weights are 0.65 speech and 0.35 speakers.  ``jobs``:
    job_id, duration; ``trend``: job_id, win, trend.
    """
    step = size - overlap
    grid = jobs.where("duration > 0").select("job_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration") / step) - 1)).alias("win"))
    grid = grid.select("job_id", "win", (F.col("win") * step).alias("start"), F.least(F.col("win") * step + size, F.col("duration")).alias("end"))
    key = ["job_id", "win"]

    text = F.trim("text")
    low, words = F.lower(text), split_words(text)
    points = (
        F.when(text.contains("!"), 8).otherwise(0) + F.when(text.contains("?"), 6).otherwise(0) + F.when(RAISED(words), 10).otherwise(0)
        + F.when(has_any(low, EXCITED), 12).otherwise(0) + F.when((F.size(words) > 3) & (F.col("end") - F.col("start") < 3), 5).otherwise(0)
    )
    seg = segments.select("job_id", "seg_idx", "speaker", "start", "end", points.alias("_p"))
    seg = _windows_of(seg, F.col("start"), F.col("end"), jobs, size, step).where((F.col("start") >= F.col("w_start")) & (F.col("end") <= F.col("w_end")))
    changed = F.col("speaker") != F.lag("speaker").over(Window.partitionBy(*key).orderBy("seg_idx"))  # one window's rows
    g = seg.withColumn("_ch", F.coalesce(changed, F.lit(False)).cast("int")).groupBy(*key).agg(
        F.sum("_p").alias("_p"), F.count("*").alias("_n"), F.countDistinct("speaker").alias("_sp"), F.sum("_ch").alias("_ch"), F.max(F.col("w_end") - F.col("w_start")).alias("_len"))
    dense = F.col("_n") / F.greatest(F.lit(1.0), F.col("_len") / 10) > 2
    g = g.select(*key, F.least(F.lit(100), F.col("_p") + F.when(dense, 10).otherwise(0)).cast("double").alias("transcript"),
                 (F.when(F.col("_sp") >= 2, 20).otherwise(0) + F.when(F.col("_ch") >= 3, 25).when(F.col("_ch") >= 1, 10).otherwise(0)).cast("double").alias("speaker"))
    d = grid.join(g, key, "left").fillna(0.0, ["transcript", "speaker"])
    if scenes is None and moments is None:
        total = F.col("transcript") * 0.65 + F.col("speaker") * 0.35
        return d.withColumns({"audio": F.lit(0.0), "scene": F.lit(0.0), "composite": F.round(total, 1)})

    inside = (F.col("t") >= F.col("w_start")) & (F.col("t") <= F.col("w_end"))
    s = _windows_of(scenes.select("job_id", "t", "importance"), F.col("t"), F.col("t"), jobs, size, step).where(inside)
    s = s.groupBy(*key).agg(F.max("importance").alias("_mx"), F.avg("importance").alias("_av"))
    s = s.select(*key, F.least(F.lit(100.0), F.col("_mx") * 6 + F.col("_av") * 4 + F.when(F.col("_mx") >= 9, 20).otherwise(0)).alias("scene"))
    loud = F.when(F.col("kind") == "extreme_spike", 30).when(F.col("kind") == "silence_to_loud", 25).when(F.col("kind") == "volume_spike", 15).otherwise(0)
    mood = F.when(F.col("sentiment").isin("laughter", "cheering"), 15).when(F.col("sentiment") == "applause", 10).when(F.col("sentiment") == "shouting", 8).otherwise(0)
    a = _windows_of(moments.select("job_id", "t", (loud + mood).alias("_p")), F.col("t"), F.col("t"), jobs, size, step).where(inside)
    a = a.groupBy(*key).agg(F.least(F.lit(100), F.sum("_p")).cast("double").alias("audio"))
    d = d.join(s, key, "left").join(a, key, "left").fillna(0.0, ["scene", "audio"])
    penalty = F.lit(0)
    if fillers is not None:
        f = fillers.select("job_id", F.col("start").alias("f_start"), F.col("end").alias("f_end"))
        f = _windows_of(f, F.col("f_start"), F.col("f_end"), jobs, size, step).where((F.col("f_start") >= F.col("w_start")) & (F.col("f_end") <= F.col("w_end")))
        d = d.join(f.groupBy(*key).agg(F.count("*").alias("_f")), key, "left")
        rate = F.coalesce("_f", F.lit(0)) / F.greatest((F.col("end") - F.col("start")) / 60.0, F.lit(0.01))
        penalty = F.when(rate > 6, 15).when(rate > 3, 8).otherwise(0)
    if trend is None:
        total = F.col("audio") * 0.25 + F.col("transcript") * 0.35 + F.col("scene") * 0.25 + F.col("speaker") * 0.15 - penalty
    else:
        d = d.join(trend, key, "left").fillna(50, ["trend"])
        total = F.col("audio") * 0.20 + F.col("transcript") * 0.30 + F.col("scene") * 0.20 + F.col("speaker") * 0.15 + F.col("trend") * 0.15 - penalty
    return d.withColumn("composite", F.round(total, 1)).drop("_f", "trend")


def window_trend(jobs: DataFrame, segments: DataFrame, lexicon: list[tuple[str, list[str], float]], genre: Column, emphasis: tuple[str, ...] = (), web: str = "", size: float = 30.0,
                 overlap: float = 10.0) -> DataFrame:
    """Trend score and its reason (job_id, win, trend, reason) of the segments inside each window, joined in order.

    A window's text is bounded by what is said in ``size`` seconds.
    """
    seg = _windows_of(segments.select("job_id", "seg_idx", "text", "start", "end"), F.col("start"), F.col("end"), jobs, size, size - overlap)
    seg = seg.where((F.col("start") >= F.col("w_start")) & (F.col("end") <= F.col("w_end")))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"])
    d = seg.groupBy("job_id", "win").agg(F.concat_ws(" ", texts).alias("text"))
    score = trend_score(F.col("text"), genre, lexicon, emphasis, web)
    return d.select("job_id", "win", score.alias("_s")).select("job_id", "win", F.col("_s.score").alias("trend"), F.col("_s.reason").alias("reason"))


def zone_signals(jobs: DataFrame, segments: DataFrame, scenes: DataFrame, moments: DataFrame, fillers: DataFrame | None = None, trend: DataFrame | None = None, size: float = 30.0,
                 overlap: float = 10.0, loud_most: int = 3) -> DataFrame:
    """What made each hot zone stand out: job_id, win, signals (array, empty where nothing did).

    In order: the first ``loud_most`` sounds of the window (the published rule), filler density over 6 a minute,
    raised voice and emotional reaction as they first occur, dense dialogue, visual peak from importance 8,
    speakers, rapid exchange, and a trend match from 60.  Inputs as in hot_zones(), moments with moment_id,
    trend as window_trend() gives it.  Every source is one aggregate by window.
    """
    step, key = size - overlap, ["job_id", "win"]
    inside = (F.col("t") >= F.col("w_start")) & (F.col("t") <= F.col("w_end"))
    held = (F.col("start") >= F.col("w_start")) & (F.col("end") <= F.col("w_end"))
    d = jobs.where("duration > 0").select("job_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration") / step) - 1)).alias("win"))
    minutes = F.greatest((F.least(F.col("win") * step + size, F.col("duration")) - F.col("win") * step) / 60.0, F.lit(0.01))
    d = d.select("job_id", "win", minutes.alias("_minutes"))

    spike = F.when(F.col("kind") == "extreme_spike", "extreme audio spike").when(F.col("kind") == "silence_to_loud", "silence->loud")
    mood = F.when(F.col("sentiment").isin("laughter", "cheering"), F.col("sentiment"))
    said = F.transform(F.array_compact(F.array(spike, mood)), lambda x: F.concat(x, F.lit(" at "), F.bround("t").cast("long").cast("string"), F.lit("s")))
    m = moments.select("job_id", "moment_id", "t", F.posexplode(said).alias("pos", "signal"))
    m = _windows_of(m, F.col("t"), F.col("t"), jobs, size, step).where(inside)
    m = m.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("t", "moment_id", "pos"))).where(F.col("_n") <= loud_most)
    audio = m.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "signal"))), lambda x: x["signal"]).alias("_audio"))

    text = F.trim("text")
    seg = segments.select("job_id", "seg_idx", "speaker", "start", "end", RAISED(split_words(text)).alias("_r"), has_any(F.lower(text), EXCITED).alias("_x"))
    seg = _windows_of(seg, F.col("start"), F.col("end"), jobs, size, step).where(held)
    changed = F.col("speaker") != F.lag("speaker").over(Window.partitionBy(*key).orderBy("seg_idx"))  # one window's rows
    g = seg.withColumn("_ch", changed).groupBy(*key).agg(
        F.min(F.when(F.col("_r"), F.col("seg_idx"))).alias("_r"), F.min(F.when(F.col("_x"), F.col("seg_idx"))).alias("_x"), F.countDistinct("speaker").alias("_sp"), F.count_if("_ch").alias("_ch"),
        (F.count("*") / F.greatest(F.lit(1.0), F.max(F.col("w_end") - F.col("w_start")) / 10) > 2).alias("_dense"))
    moods = F.array(F.when(F.col("_r").isNotNull(), F.struct(F.col("_r").alias("i"), F.lit("a"), F.lit("raised voice").alias("s"))), F.when(F.col("_x").isNotNull(), F.struct(F.col("_x").alias("i"), F.lit("b"), F.lit("emotional reaction").alias("s"))))
    spoken = F.transform(F.sort_array(F.array_compact(moods)), lambda x: x["s"])
    people = F.array(F.when(F.col("_sp") >= 2, F.concat(F.col("_sp").cast("string"), F.lit(" speakers"))), F.when(F.col("_ch") >= 3, "rapid exchange"))
    g = g.select(*key, F.concat(spoken, F.array(F.when(F.col("_dense"), "dense dialogue"))).alias("_spoken"), people.alias("_people"))

    s = _windows_of(scenes.select("job_id", "t", "importance"), F.col("t"), F.col("t"), jobs, size, step).where(inside).groupBy(*key).agg(F.max("importance").alias("_mx"))
    d = d.join(audio, key, "left").join(g, key, "left").join(s, key, "left")
    parts = [F.col("_audio")]
    if fillers is not None:
        f = _windows_of(fillers.select("job_id", "start", "end"), F.col("start"), F.col("end"), jobs, size, step).where(held)
        d = d.join(f.groupBy(*key).agg(F.count("*").alias("_f")), key, "left")
        parts.append(F.array(F.when(F.col("_f") / F.col("_minutes") > 6, "high filler density")))
    parts += [F.col("_spoken"), F.array(F.when(F.col("_mx") >= 8, F.concat(F.lit("visual peak ("), F.col("_mx").cast("string"), F.lit("/10)")))), F.col("_people")]
    if trend is not None:
        d = d.join(trend.select(*key, "trend", "reason"), key, "left")
        parts.append(F.array(F.when((F.col("trend") >= 60) & (F.col("reason") != ""), F.concat(F.lit("trend match: "), "reason"))))
    none = F.array().cast("array<string>")
    return d.select(*key, F.array_compact(F.concat(*[F.coalesce(x, none) for x in parts])).alias("signals"))


def _held(clips: DataFrame, segments: DataFrame, extra: list) -> DataFrame:
    """Segments that lie inside each clip."""
    s = segments.select("job_id", "seg_idx", "speaker", F.col("start").alias("s_start"), F.col("end").alias("s_end"), *extra)
    return points_in(s, clips.select(*KEY, "start", "end"), ["job_id"], 30.0, t="s_start").where("s_end <= `end`")


def retention(clips: DataFrame, segments: DataFrame, scenes: DataFrame, points: int = 20) -> DataFrame:
    """Predicted audience retention: five factors, overall score and a curve."""
    n_words = F.size(split_words(F.col("text")))
    low = F.lower("text")
    text = F.col("text")
    opening = overlap_pairs(clips.select(*KEY, "start", (F.col("start") + 3.0).alias("_to")), segments.select(
        "job_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"), text.contains("?").alias("_q"), text.contains("!").alias("_x"), n_words.alias("_w"), has_any(low, CURIOUS).alias("_c")),
        ["job_id"], 30.0, l_span=("start", "_to"))
    hook = opening.groupBy(*KEY).agg(F.bool_or("_q").alias("_q"), F.bool_or("_x").alias("_x"), F.sum("_w").alias("_w"), F.bool_or("_c").alias("_c"))
    hook = hook.select(*KEY, F.least(F.lit(1.0), F.lit(0.5) + F.when(F.col("_q"), 0.15).otherwise(0.0) + F.when(F.col("_x"), 0.1).otherwise(0.0)
                                     + F.when(F.col("_w").between(3, 15), 0.1).otherwise(0.0) + F.when(F.col("_c"), 0.15).otherwise(0.0)).alias("hook"))
    energy = F.least(F.lit(1.0), F.lit(0.5) + F.when(text.contains("!"), 0.2).otherwise(0.0) + F.when(text.contains("?"), 0.1).otherwise(0.0) + F.when(RAISED(split_words(text)), 0.15).otherwise(0.0)
                     + F.when(has_any(low, BRIGHT), 0.2).otherwise(0.0) + F.when(has_any(low, DARK), 0.1).otherwise(0.0))
    length = F.col("end") - F.col("start")
    pron = reduce(lambda a, b: a | b, [low.startswith(p) for p in ("he ", "she ", "they ", "it ", "that ", "this ")])
    conj = reduce(lambda a, b: a | b, [low.startswith(p) for p in ("and ", "but ", "so ", "because ", "then ")])
    held = _held(clips, segments, [F.when(length > 0, n_words / (length / 60)).alias("_wpm"), energy.alias("_e"), pron.alias("_pron"), conj.alias("_conj")])
    order = Window.partitionBy(*KEY).orderBy("seg_idx")  # the rows of one clip
    held = held.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(*KEY))})
    half = F.floor(F.col("_n") / 2)
    g = held.groupBy(*KEY).agg(
        F.count("*").alias("_n"), F.avg("_wpm").alias("_m"), F.stddev_pop("_wpm").alias("_sd"), F.avg(F.when(F.col("_i") < half, F.col("_e"))).alias("_e1"), F.avg(F.when(F.col("_i") >= half, F.col("_e"))).alias("_e2"),
        F.min_by(F.struct("_pron", "_conj"), "seg_idx").alias("_f"), F.countDistinct("speaker").alias("_sp"))
    sc = points_in(scenes.select("job_id", "t", "importance"), clips.select(*KEY, "start", "end"), ["job_id"], 30.0).groupBy(*KEY).agg(F.count("*").alias("_sc"), F.count_if(F.col("importance") >= 7).alias("_hi"))
    d = clips.select(*KEY, "duration").join(hook, KEY, "left").join(g, KEY, "left").join(sc, KEY, "left").fillna(0, ["_n", "_sc", "_hi", "_sp"])
    cv = F.col("_sd") / F.col("_m")
    pacing = (
        F.when(F.col("_n") < 3, 0.5).when(F.col("_m").isNull(), 0.5).when(F.col("_m") == 0, 0.3).when(cv.between(0.2, 0.5), 0.8).when(cv < 0.1, 0.4).when(cv > 0.8, 0.5).otherwise(0.6)
    )
    rate = F.col("_sc") / (F.col("duration") / 60)
    base = F.when(rate.between(3, 8), 0.8).when(rate < 1, 0.3).when(rate > 15, 0.5).otherwise(0.6)
    visual = F.when((F.col("_sc") == 0) | (F.col("duration") == 0), 0.5).when(F.col("_hi") > 0, F.least(F.lit(1.0), base + F.least(F.lit(0.15), F.col("_hi") * 0.05))).otherwise(base)
    arc = F.when(F.col("_n") < 2, 0.5).when(F.col("_e2") > F.col("_e1") + 0.1, 0.8).when(F.abs(F.col("_e2") - F.col("_e1")) < 0.05, 0.4).otherwise(0.6)
    alone = F.lit(0.6) - F.when(F.col("_f._pron"), 0.15).otherwise(0.0) - F.when(F.col("_f._conj"), 0.1).otherwise(0.0) + F.when(F.col("_sp") >= 2, 0.1).otherwise(0.0) + F.when(F.col("duration") >= 60, 0.1).otherwise(0.0)
    d = d.select(*KEY, F.coalesce("hook", F.lit(0.3)).alias("hook"), pacing.alias("pacing"), visual.alias("visual"), arc.alias("arc"), F.when(F.col("_n") == 0, 0.5).otherwise(clamp(alone, 0.0, 1.0)).alias("standalone"))
    overall = F.col("hook") * 0.25 + F.col("pacing") * 0.15 + F.col("visual") * 0.15 + F.col("arc") * 0.25 + F.col("standalone") * 0.20
    lost = (1 - F.col("hook")) * 25
    middle = (1 - (F.col("pacing") + F.col("visual")) / 2) * 20
    tail = F.when(F.col("arc") > 0.6, (F.col("arc") - 0.6) * 10).otherwise(-(1 - F.col("arc")) * 10)

    def at(i: Column) -> Column:
        t = i / (points - 1) * 100
        r = F.when(t <= 5, 100.0).when(t <= 15, 100 - lost * (t - 5) / 10).when(t <= 80, 100 - lost - middle * (t - 15) / 65).otherwise(100 - lost - middle + tail * (t - 80) / 20)
        return F.struct(F.round(t, 1).alias("time_pct"), F.round(clamp(r, 20.0, 100.0), 1).alias("retention_pct"))

    return d.withColumns({"overall_score": F.bround(overall * 100).cast("long"), "curve": F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)})


def opening_score(clips: DataFrame, segments: DataFrame, scenes: DataFrame | None = None, moments: DataFrame | None = None) -> DataFrame:
    """Score and reasons of the first three seconds of each clip.

    ``moments``: job_id, moment_id, t, sentiment; ``scenes``: job_id, scene_id, t, importance.
    """
    c = clips.select(*KEY, "start", (F.col("start") + 3.0).alias("_to"), (F.col("start") - 2.0).alias("_pre"), (F.col("start") + 0.5).alias("_near"))
    s = segments.select("job_id", "seg_idx", "speaker", "text", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    first = overlap_pairs(c.select(*KEY, "start", "_to"), s, ["job_id"], 30.0, l_span=("start", "_to")).groupBy(*KEY).agg(
        F.min_by(F.struct("r_start", "text", "speaker"), F.struct("r_start", "seg_idx")).alias("_f"))
    before = points_in(s.select("job_id", "seg_idx", "speaker", "r_end"), c.select(*KEY, "_pre", "_near"), ["job_id"], 30.0, t="r_end", span=("_pre", "_near"), ends="(]")
    before = before.groupBy(*KEY).agg(F.max_by("speaker", F.struct("r_end", -F.col("seg_idx"))).alias("_prev"))
    d = c.join(first, KEY, "left").join(before, KEY, "left")
    if scenes is not None:
        op = points_in(scenes.select("job_id", "scene_id", "t", "importance"), c.select(*KEY, "start", (F.col("start") + 1.0).alias("_sec")), ["job_id"], 30.0, span=("start", "_sec"))
        d = d.join(op.groupBy(*KEY).agg(F.min_by("importance", F.struct("t", "scene_id")).alias("_imp")), KEY, "left")
    else:
        d = d.withColumn("_imp", F.lit(None).cast("long"))
    if moments is not None:
        m = points_in(moments.select("job_id", "moment_id", "t", "sentiment"), c.select(*KEY, "start", (F.col("start") + 1.5).alias("_end")), ["job_id"], 30.0, span=("start", "_end"))
        tagged = F.col("sentiment").isin("laughter", "cheering", "shouting", "applause")
        m = m.groupBy(*KEY).agg(F.bool_or(F.col("t") <= F.col("start") + 0.5).alias("_attack"), F.min_by("sentiment", F.when(tagged, F.struct("t", "moment_id"))).alias("_mood"))
        d = d.join(m, KEY, "left")
    else:
        d = d.withColumns({"_attack": F.lit(None).cast("boolean"), "_mood": F.lit(None).cast("string")})
    d = d.withColumn("_attack", F.coalesce("_attack", F.lit(False)))
    text = F.trim("_f.text")
    words = F.slice(split_words(text), 1, 6)
    bare = lambda i: F.rtrim(F.lower(F.coalesce(F.get(words, F.lit(i)), F.lit(""))), F.lit(".,!?"))
    one, two = bare(0), bare(1)
    rules = [
        (F.col("_f.r_start") < F.col("start") - 0.5, -25, F.lit("mid_sentence_start")),
        (one.isin("um", "uh", "like", "so", "and", "but", "well", "yeah"), -20, F.concat(F.lit("filler_opener_"), one)),
        (one.isin("that", "this", "it", "they", "he", "she", "those", "these") & two.isin("is", "was", "were", "are", "'s", "thing"), -15, F.lit("context_dependent_opener")),
        (F.array_join(words, " ").contains("?"), 25, F.lit("question_hook")),
        (one.isin("wow", "oh", "wait", "no", "what", "holy", "damn", "yo", "bro"), 20, F.lit("reaction_hook")),
        (F.col("_prev") != F.col("_f.speaker"), 15, F.lit("speaker_change_hook")), (text.contains("!"), 10, F.lit("emphasis_hook")),
        (has_any(F.lower(text), BOLD), 15, F.lit("bold_claim_hook")), (F.col("_attack"), 10, F.lit("audio_attack_hook")),
        (F.col("_mood").isNotNull(), 12, F.concat(F.lit("sentiment_"), "_mood", F.lit("_hook"))), (F.col("_imp") >= 8, 8, F.lit("visual_peak_hook")), (F.col("_imp") <= 3, -8, F.lit("visual_dead_hook")),
    ]
    total = reduce(lambda a, b: a + b, [F.when(c_, p).otherwise(0) for c_, p, _ in rules], F.lit(50))
    why = F.array_join(F.array_compact(F.array(*[F.when(c_, r) for c_, _, r in rules])), "+")
    silent = F.lit(15) + F.when(F.col("_attack"), 30).otherwise(0) + F.when(F.col("_imp") >= 8, 20).otherwise(0)
    none = F.col("_f").isNull()
    return d.select(*KEY, F.when(none, F.least(F.lit(100), silent)).otherwise(clamp(total, 0, 100)).cast("long").alias("opening"),
                    F.when(none, "dead_air_opening").when(why == "", "neutral").otherwise(why).alias("reason"))


def better_opening(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """Start of the strongest segment beginning within 5 s, where one has a positive score."""
    text = F.trim("text")
    one = F.rtrim(F.lower(F.coalesce(F.get(split_words(text), F.lit(0)), F.lit(""))), F.lit(".,!?"))
    head = F.substring(text, 1, 60)
    pts = F.when(head.contains("?"), 3).otherwise(0) + F.when(head.contains("!"), 2).otherwise(0) + F.when(one.isin("wow", "oh", "wait", "no", "what", "holy"), 3).otherwise(0)
    s = segments.where(~one.isin("um", "uh", "like", "so", "and", "but", "well")).select("job_id", "seg_idx", F.col("start").alias("t"), pts.alias("_p")).where("_p > 0")
    hit = points_in(s, clips.select(*KEY, "start", (F.col("start") + 5.0).alias("_to")), ["job_id"], 30.0, span=("start", "_to"))
    return hit.groupBy(*KEY).agg(F.max_by("t", F.struct("_p", -F.col("seg_idx"))).alias("better_start"))


def thirds_score(clips: DataFrame, segments: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Score and shape of a clip from the speech in its three thirds."""
    third = (F.col("end") - F.col("start")) / 3
    parts = clips.where(F.col("end") - F.col("start") >= 10).select(*KEY, "start", third.alias("_t"), "end", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part"))
    parts = parts.select(*KEY, "part", (F.col("start") + F.col("part") * F.col("_t")).alias("p_start"), F.when(F.col("part") == 2, F.col("end")).otherwise(F.col("start") + (F.col("part") + 1) * F.col("_t")).alias("p_end"))
    s = segments.select("job_id", "speaker", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.size(split_words(F.col("text"))).alias("_w"),
                        (F.when(F.col("text").contains("!"), 8).otherwise(0) + F.when(F.col("text").contains("?"), 6).otherwise(0)).alias("_m"))
    pairs = overlap_pairs(parts, s, ["job_id"], 30.0, l_span=("p_start", "p_end"))
    g = pairs.groupBy(*KEY, "part").agg(F.sum("_w").alias("_w"), F.sum(F.least("r_end", "p_end") - F.greatest("r_start", "p_start")).alias("_d"), F.sum("_m").alias("_m"), F.countDistinct("speaker").alias("_sp"))
    speed = F.when(F.col("_d") > 0, F.least(F.lit(40), F.floor(F.round(F.col("_w") / F.col("_d") * 12, 9)))).otherwise(0)
    g = g.select(*KEY, "part", (speed + F.col("_m") + F.when(F.col("_sp") >= 2, 10).otherwise(0)).alias("_s"))
    if moments is not None:
        m = points_in(moments.select("job_id", "t"), parts, ["job_id"], 30.0, span=("p_start", "p_end")).groupBy(*KEY, "part").agg((F.count("*") * 8).alias("_s"))
        g = g.unionByName(m).groupBy(*KEY, "part").agg(F.sum("_s").alias("_s"))
    g = g.groupBy(*KEY).pivot("part", [0, 1, 2]).agg(F.first(F.least(F.lit(100), F.col("_s"))))
    d = clips.select(*KEY, (F.col("end") - F.col("start") < 10).alias("_short")).join(g, KEY, "left").fillna(0, ["0", "1", "2"])
    o, m_, c = F.col("0"), F.col("1"), F.col("2")
    shape = (
        F.when(F.col("_short"), "too_short_to_measure").when((m_ < 20) & (o > 40), "energy_valley").when(o < 25, "slow_start").when((c < 20) & (o > 40), "fizzle_ending")
        .when((o > 50) & (m_ > 30) & (c > 40), "sustained_energy").otherwise("moderate")
    )
    weak = F.round(o * 0.4 + m_ * 0.3 + c * 0.3, 9)
    even = F.round(o * 0.35 + m_ * 0.30 + c * 0.35, 9)
    d = d.withColumn("shape", shape)
    rate = F.when(F.col("shape") == "energy_valley", 0.7).when(F.col("shape") == "slow_start", 0.8).when(F.col("shape") == "fizzle_ending", 0.75)
    return d.select(*KEY, F.when(F.col("_short"), 50).when(rate.isNotNull(), F.floor(F.round(weak * rate, 9))).otherwise(F.floor(even)).cast("long").alias("thirds"), "shape")


def post_process(clips: DataFrame, segments: DataFrame, scenes: DataFrame, jobs: DataFrame, n: int) -> DataFrame:
    """Candidate post-processing: overlap and theme suppression, speech snap, opening and
    retention adjustments, platform rules and the spread top ``n``.

    The kept set is written out between stages, so later stages do not repeat
    the suppression passes, and so are the segments, which four of them read.
    """
    segments = written(segments.select("job_id", "seg_idx", "speaker", "text", "start", "end"))
    d = drop_overlapping(clips, 0.7).join(jobs.select("job_id", F.col("duration").alias("_dur")), "job_id").where("_dur IS NOT NULL")
    d = cut_lineage(d)
    d = limit_themes(d, F.when(F.col("_dur") < 1800, 3).when(F.col("_dur") < 5400, 4).otherwise(5)).drop("_dur")
    d = cut_lineage(snap_to_speech(d, segments))
    d = d.join(opening_score(d, segments, scenes), KEY).join(better_opening(d, segments), KEY, "left")
    own = F.col("hook_score")
    blend = F.bround(F.col("opening") * 0.6 + own * 0.4)
    hook = F.when((own > 0) & (F.abs(F.col("opening") - own) > 25), clamp(blend, 0, 100)).when(own == 0, F.col("opening")).otherwise(own).cast("long")
    shift = F.expr("CAST((opening - 50) * 0.2D AS BIGINT)")
    slide = (F.col("opening") < 30) & (F.col("better_start") > F.col("start"))
    d = d.withColumns({"hook_score": hook, "viral_score": clamp(F.col("viral_score") + shift, 1, 100), "_slide": F.coalesce(slide, F.lit(False))})
    d = d.withColumn("start", F.when(F.col("_slide"), F.col("better_start")).otherwise(F.col("start")))
    d = cut_lineage(d.withColumn("duration", F.when(F.col("_slide"), F.round(F.col("end") - F.col("start"), 1)).otherwise(F.col("duration"))).drop("_slide", "better_start"))
    d = d.join(thirds_score(d, segments), KEY)
    d = d.withColumn("viral_score", clamp(F.col("viral_score") + F.expr("CAST((thirds - 50) * 0.15D AS BIGINT)"), 1, 100))
    where = F.lower(F.when(F.coalesce("platform", F.lit("")) == "", "both").otherwise(F.col("platform")))
    short = (where == "tiktok") & (F.col("duration") < 15)
    d = d.withColumns({"viral_score": F.when(short, F.greatest(F.lit(1), F.col("viral_score") - 10)).otherwise(F.col("viral_score")),
                       "platform": F.when((where == "tiktok") & (F.col("duration") > 60), "youtube_shorts").otherwise(F.col("platform"))})
    return stratified_top(d, jobs, n)
