"""Queries: word times after an edit."""

from pyspark.sql import functions as F

from ..operators import word_times as wt
from .registry import query

EDITED = """
flatten(list_transform(toks, lambda w, i: CASE (seg_idx * 3 + i - 1) % 13 WHEN 0 THEN [] WHEN 4 THEN [w, 'indeed'] WHEN 7 THEN [w || ','] WHEN 9 THEN ['changed'] WHEN 10 THEN ['quite', 'changed'] ELSE [w] END))"""


def edited(v):
    """Segments with timed words and an edited text: words removed, inserted, replaced and given a comma."""
    at = F.round(F.col("start") * 10).cast("long")
    words = F.transform("toks", lambda w, i: F.struct(((at + 4 * i) / 10.0).alias("start"), ((at + 4 * i + 4) / 10.0).alias("end"), w.alias("word")))

    def change(w, i):
        k = (F.col("seg_idx") * 3 + i) % 13
        return (
            F.when(k == 0, F.array().cast("array<string>")).when(k == 4, F.array(w, F.lit("indeed"))).when(k == 7, F.array(F.concat(w, F.lit(","))))
            .when(k == 9, F.array(F.lit("changed"))).when(k == 10, F.array(F.lit("quite"), F.lit("changed"))).otherwise(F.array(w))
        )

    return v.segments.select("job_id", "seg_idx", words.alias("words"), F.flatten(F.transform("toks", change)).alias("target"))


def listed(d, col):
    w = d.select("job_id", "seg_idx", F.posexplode(col).alias("word_idx", "w"))
    return w.select("job_id", "seg_idx", F.col("word_idx").cast("long").alias("word_idx"), "w.word", "w.start", "w.end")


@query("fn8_words_by_count", f"""
WITH RECURSIVE s AS (SELECT job_id, seg_idx, list_transform(range(len(toks)), lambda i: {{'start': (round(start * 10) + 4 * i) / 10, 'end': (round(start * 10) + 4 * i + 4) / 10, 'word': toks[i + 1]}}) AS words, len({EDITED})::BIGINT AS m FROM segments),
f AS (SELECT job_id, seg_idx, words, m FROM s WHERE len(words) BETWEEN m - 3 AND m AND len(words) > 0
UNION ALL SELECT job_id, seg_idx, list_concat(words[:p - 1], [{{'start': words[p].start, 'end': (words[p].start + words[p].end) / 2, 'word': words[p].word}}, {{'start': (words[p].start + words[p].end) / 2, 'end': words[p].end, 'word': ''}}], words[p + 1:]), m
FROM (SELECT *, list_position(list_transform(words, lambda x: x.end - x.start), list_max(list_transform(words, lambda x: x.end - x.start))) AS p FROM f WHERE len(words) < m)),
a AS (SELECT * FROM f WHERE len(words) = m UNION ALL SELECT job_id, seg_idx, list_transform(range(m), lambda i: words[least(CAST(floor(i * (len(words) / m)) AS BIGINT), len(words) - 1) + 1]), m FROM s WHERE len(words) BETWEEN m + 1 AND m + 3 AND m > 0)
SELECT job_id, seg_idx, i - 1 AS word_idx, words[i].word AS word, words[i].start AS start, words[i].end AS "end" FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM a)""")
def _(v):
    return listed(edited(v).select("job_id", "seg_idx", wt.spaced_by_count(F.col("words"), F.col("target")).alias("w")), "w")


@query("fn8_realigned_words", rf"""
WITH RECURSIVE s AS (SELECT job_id, seg_idx, round(start * 10) AS t, toks AS old, {EDITED} AS new FROM segments),
o AS (SELECT job_id, seg_idx, unnest(range(len(old))) AS i, regexp_replace(lower(unnest(old)), '^[.,!?;:]+|[.,!?;:]+$', '', 'g') AS w FROM s),
n AS (SELECT job_id, seg_idx, unnest(range(len(new))) AS j, regexp_replace(lower(unnest(new)), '^[.,!?;:]+|[.,!?;:]+$', '', 'g') AS w FROM s),
m AS (SELECT job_id, seg_idx, i, i - j AS d, i - row_number() OVER (PARTITION BY job_id, seg_idx, i - j ORDER BY i) AS g FROM o JOIN n USING (job_id, seg_idx, w)),
runs AS (SELECT job_id, seg_idx, d, min(i) AS i1, max(i) + 1 AS i2 FROM m GROUP BY job_id, seg_idx, d, g),
parts AS (SELECT job_id, seg_idx, CAST(0 AS BIGINT) AS a1, CAST(len(old) AS BIGINT) AS a2, CAST(0 AS BIGINT) AS b1, CAST(len(new) AS BIGINT) AS b2 FROM s
UNION ALL SELECT job_id, seg_idx, u.a1, u.a2, u.b1, u.b2 FROM (SELECT job_id, seg_idx, unnest([{{'a1': a1, 'a2': b.i, 'b1': b1, 'b2': b.j}}, {{'a1': b.i + b.n, 'a2': a2, 'b1': b.j + b.n, 'b2': b2}}]) AS u
FROM (SELECT p.job_id, p.seg_idx, a1, a2, b1, b2, arg_min({{'i': greatest(i1, a1, b1 + d), 'j': greatest(i1, a1, b1 + d) - d, 'n': least(i2, a2, b2 + d) - greatest(i1, a1, b1 + d)}},
  {{'n': greatest(i1, a1, b1 + d) - least(i2, a2, b2 + d), 'i': greatest(i1, a1, b1 + d), 'j': -d}}) AS b
  FROM parts p JOIN runs r ON p.job_id = r.job_id AND p.seg_idx = r.seg_idx AND least(i2, a2, b2 + d) > greatest(i1, a1, b1 + d) GROUP BY ALL)) WHERE u.a1 < u.a2 AND u.b1 < u.b2),
blocks AS (SELECT job_id, seg_idx, b.i, b.j, b.n FROM (SELECT p.job_id, p.seg_idx, a1, a2, b1, b2, arg_min({{'i': greatest(i1, a1, b1 + d), 'j': greatest(i1, a1, b1 + d) - d, 'n': least(i2, a2, b2 + d) - greatest(i1, a1, b1 + d)}},
  {{'n': greatest(i1, a1, b1 + d) - least(i2, a2, b2 + d), 'i': greatest(i1, a1, b1 + d), 'j': -d}}) AS b
  FROM parts p JOIN runs r ON p.job_id = r.job_id AND p.seg_idx = r.seg_idx AND least(i2, a2, b2 + d) > greatest(i1, a1, b1 + d) GROUP BY ALL)
  UNION ALL SELECT job_id, seg_idx, len(old), len(new), 0 FROM s),
gaps AS (SELECT job_id, seg_idx, coalesce(lag(i + n) OVER q, 0) AS i1, i AS i2, coalesce(lag(j + n) OVER q, 0) AS j1, j AS j2 FROM blocks WINDOW q AS (PARTITION BY job_id, seg_idx ORDER BY i, j)),
spans AS (SELECT g.*, old, new, t, (t + 4 * i1) / 10 AS x, CASE WHEN i2 > i1 THEN (t + 4 * i2) / 10 WHEN i1 < len(old) THEN (t + 4 * i1) / 10 ELSE (t + 4 * i1) / 10 + 0.1::DOUBLE END AS y
  FROM gaps g JOIN s USING (job_id, seg_idx) WHERE j2 > j1 AND (i2 > i1 OR i1 > 0)),
found AS (SELECT job_id, seg_idx, j + k AS j, new[j + k + 1] AS word, (t + 4 * (i + k)) / 10 AS start, (t + 4 * (i + k) + 4) / 10 AS "end" FROM (SELECT b.*, unnest(range(n)) AS k FROM blocks b) JOIN s USING (job_id, seg_idx)
  UNION ALL SELECT job_id, seg_idx, j1 + k, new[j1 + k + 1], x + k * ((y - x) / (j2 - j1)), x + (k + 1) * ((y - x) / (j2 - j1)) FROM (SELECT *, unnest(range(j2 - j1)) AS k FROM spans)),
kept AS (SELECT * FROM found UNION ALL SELECT job_id, seg_idx, i, old[i + 1], (t + 4 * i) / 10, (t + 4 * i + 4) / 10 FROM (SELECT *, unnest(range(len(old))) AS i FROM s) WHERE (job_id, seg_idx) NOT IN (SELECT (job_id, seg_idx) FROM found))
SELECT job_id, seg_idx, row_number() OVER (PARTITION BY job_id, seg_idx ORDER BY j) - 1 AS word_idx, word, start, "end" FROM kept""")
def _(v):
    d = edited(v).withColumn("text", F.array_join("target", " "))
    return listed(wt.realigned(d, "words", "text", digits=None), "words")
