"""Queries: transcript cleaning, speakers and chapters."""

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import transcript as op
from .joins import with_words
from .registry import query


def loops(v):
    """Segments rewritten over a nine-word vocabulary, so that lines repeat and resemble each other."""
    n = F.col("n_words") % 13
    word = lambda i: F.concat(F.lit("w"), ((F.col("seg_idx") % 3 * 2 + i * (1 + F.col("job_id") % 3) + F.col("n_words") % 2) % 9).cast("string"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n), word), " ")
    return v.segments.withColumns({"text": text, "no_speech_prob": F.col("confidence") / 2})


@query("set6_drop_repeats")
def _(v):
    return op.drop_repeats(loops(v)).select("job_id", "seg_idx", "repeat")


@query("set7_drop_noise")
def _(v):
    return op.drop_noise(loops(v), boilerplate=("w0 w1", "w2")).select("job_id", "seg_idx")


@query("set8_consolidate")
def _(v):
    return op.consolidate(loops(v).withColumn("end", F.col("start") + F.col("n_words") % 5 * 0.3))


def chunked(v):
    """Segments cut into chunks of three rows, each repeating the last row of the one before."""
    s = v.segments.select("job_id", (F.floor(F.col("seg_idx") / 3)).alias("chunk"), "seg_idx", "start", "end", "confidence")
    again = s.where("seg_idx % 3 = 2").select("job_id", (F.col("chunk") + 1).alias("chunk"), "seg_idx", (F.col("start") - 0.3).alias("start"), (F.col("end") - 0.2).alias("end"), (1 - F.col("confidence")).alias("confidence"))
    return s.unionByName(again)


@query("set9_merge_chunks")
def _(v):
    return op.merge_chunks(chunked(v))


@query("fn6_split_sentences")
def _(v):
    return op.split_sentences(with_words(v)).select("job_id", "seg_idx", "part", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "text")


@query("fn7_split_captions", """
WITH p AS (SELECT *, unnest(range(greatest(1, CAST(ceil(n_words / 7) AS BIGINT)))) AS part FROM segments),
e AS (SELECT *, CASE WHEN part = 0 THEN start ELSE start + part * 7 * 0.4 + 0.02 END AS s, CASE WHEN part >= ceil(n_words / 7) - 1 THEN "end" ELSE start + (part + 1) * 7 * 0.4 + 0.02 END AS f FROM p)
SELECT job_id, seg_idx, part, round(least(s, "end"), 4) AS start, round(least(f, "end"), 4) AS "end", CASE WHEN n_words <= 7 THEN text ELSE array_to_string(toks[part * 7 + 1:part * 7 + 7], ' ') END AS text FROM e WHERE n_words <= 7 OR f - s >= 0.1""")
def _(v):
    d = op.split_captions(with_words(v), 7)
    return d.select("job_id", "seg_idx", "part", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "text")


@query("win28_guess_speakers")
def _(v):
    removed = v.segments.where("seg_idx % 4 = 3").select("job_id", F.col("end").alias("r_start"), (F.col("end") + 2.5).alias("r_end"))
    return op.guess_speakers(v.segments, removed).select("job_id", "seg_idx", "speaker_label")


KW = f"""kw AS (SELECT job_id, seg_idx, start, "end", list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9''-]{{1,}}'), lambda t: length(t) > 2 AND NOT list_contains({list(STOP_WORDS)}, t)) AS k FROM segments)"""


@query("fn2_bucket_similarity", f"""
WITH {KW}, b AS (SELECT job_id, unnest(range(CAST(ceil(max("end") / 60) AS BIGINT) + 1)) AS bucket FROM segments GROUP BY 1),
t AS (SELECT b.job_id, b.bucket, unnest(k) AS tok FROM b JOIN kw ON kw.job_id = b.job_id AND kw."end" > b.bucket * 60 AND kw.start < (b.bucket + 1) * 60), n AS (SELECT job_id, bucket, tok, count(*) AS n FROM t GROUP BY 1, 2, 3),
m AS (SELECT job_id, bucket, sqrt(sum(n * n)) AS norm FROM n GROUP BY 1, 2), l AS (SELECT *, lag(bucket) OVER w AS pb, lag(norm) OVER w AS pn FROM m WINDOW w AS (PARTITION BY job_id ORDER BY bucket)),
d AS (SELECT l.job_id, l.bucket, sum(a.n * c.n) AS dot FROM l JOIN n a ON a.job_id = l.job_id AND a.bucket = l.bucket JOIN n c ON c.job_id = l.job_id AND c.bucket = l.pb AND c.tok = a.tok GROUP BY 1, 2)
SELECT job_id, bucket, round(coalesce(dot, 0) / (norm * pn), 6) AS similarity FROM l LEFT JOIN d USING (job_id, bucket) WHERE pb IS NOT NULL""")
def _(v):
    return op.bucket_similarity(v.segments).withColumn("similarity", F.round("similarity", 6))


@query("agg37_top_keywords", f"""
WITH {KW}, t AS (SELECT c.clip_id, kw.seg_idx, unnest(k) AS w, generate_subscripts(k, 1) AS i FROM clips c JOIN kw ON kw.job_id = c.job_id AND kw.start < c."end" AND kw."end" > c.start),
g AS (SELECT clip_id, w, count(*) AS n, min(struct_pack(a := seg_idx, b := i)) AS p FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, p) AS r FROM g)
SELECT clip_id, list(w ORDER BY r) AS words FROM r WHERE r <= 4 GROUP BY 1""")
def _(v):
    return op.top_keywords(v.clips, v.segments, "clip_id").select("clip_id", "words")


@query("agg35_emphasis_words", r"""
WITH w AS (SELECT job_id, seg_idx, unnest(toks) AS w, generate_subscripts(toks, 1) - 1 AS i FROM segments), c AS (SELECT *, trim(w, '.,!?"''()[]') AS c FROM w),
f AS (SELECT job_id, lower(c) AS word, seg_idx, i FROM c WHERE c <> '' AND ((c = upper(c) AND length(c) > 2 AND regexp_full_match(c, '\pL+')) OR (regexp_matches(c, '\d') AND length(c) <= 10) OR (i > 0 AND regexp_matches(c, '^\p{Lu}') AND length(c) > 2 AND regexp_full_match(c, '\pL+')))
 UNION ALL SELECT job_id, k, seg_idx, 1073741824 FROM segments, (SELECT unnest(['never', 'always', 'best', 'worst', 'only', 'first', 'last', 'million', 'billion', 'percent', 'secret', 'truth', 'real']) AS k) WHERE contains(lower(text), k)),
g AS (SELECT job_id, word, min(struct_pack(a := seg_idx, b := i)) AS p FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY p, word) AS rank FROM g) SELECT job_id, word, rank FROM r WHERE rank <= 20""")
def _(v):
    return op.emphasis_words(v.segments).withColumn("rank", F.col("rank").cast("long"))


@query("score9_chapters")
def _(v):
    return op.chapters(v.segments, v.scenes.where("job_id % 2 = 0"))
