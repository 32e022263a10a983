"""Word times after an edit: pinned cases, and alignments against the definition of the longest common run."""

import random

import pytest
from pyspark.sql import functions as F

from timbrel.operators import word_times as wt

WORDS = [(0.0, 0.4, "Hello,"), (0.5, 0.9, "big"), (1.0, 1.6, "wide"), (2.0, 2.5, "world.")]


def run(spark, words, text, fn):
    d = spark.createDataFrame([(words, text)], "words array<struct<start:double,end:double,word:string>>, text string")
    got = d.select(fn(F.col("words"), F.col("text")).alias("w")).first().w
    return None if got is None else [tuple(x) for x in got]


def by_words(spark, words, text):
    d = spark.createDataFrame([(words, text)], "words array<struct<start:double,end:double,word:string>>, text string")
    got = wt.realigned(d, "words", "text").first().words
    return None if got is None else [tuple(x) for x in got]


@pytest.mark.parametrize(("text", "want"), [
    ("hello big wide World!", [(0.0, 0.4, "hello"), (0.5, 0.9, "big"), (1.0, 1.6, "wide"), (2.0, 2.5, "World!")]),
    ("Hello wide world", [(0.0, 0.4, "Hello"), (1.0, 1.6, "wide"), (2.0, 2.5, "world")]),  # shorter
    ("Hello big and very wide world", [(0.0, 0.4, "Hello"), (0.5, 0.9, "big"), (0.9, 0.95, "and"), (0.95, 1.0, "very"), (1.0, 1.6, "wide"), (2.0, 2.5, "world")]),  # longer
    ("Hello one two three world", [(0.0, 0.4, "Hello"), (0.5, 0.867, "one"), (0.867, 1.233, "two"), (1.233, 1.6, "three"), (2.0, 2.5, "world")]),  # replaced
    ("Hello big wide world again now", [(0.0, 0.4, "Hello"), (0.5, 0.9, "big"), (1.0, 1.6, "wide"), (2.0, 2.5, "world"), (2.5, 2.55, "again"), (2.55, 2.6, "now")]),  # at the end
    ("Well hello big wide world", [(0.0, 0.4, "hello"), (0.5, 0.9, "big"), (1.0, 1.6, "wide"), (2.0, 2.5, "world")]),  # at the start
    ("nothing is left", [(0.0, 0.833, "nothing"), (0.833, 1.667, "is"), (1.667, 2.5, "left")]),
    (" hello　big ", [(0.0, 0.4, "hello"), (0.5, 0.9, "big")]),  # other blanks
    ("", WORDS), (None, WORDS), ("   ", WORDS),
])
def test_realigned(spark, text, want):
    assert by_words(spark, WORDS, text) == want


def test_realigned_without_words(spark):
    assert by_words(spark, [], "some text") == []
    assert by_words(spark, None, "some text") is None


@pytest.mark.parametrize(("text", "want"), [
    ("a b c d", WORDS),
    ("a b c", [WORDS[0], WORDS[1], WORDS[2]]),
    ("a b", [WORDS[0], WORDS[2]]),
    ("a b c d e", [(0.0, 0.4, "Hello,"), (0.5, 0.9, "big"), (1.0, 1.3, "wide"), (1.3, 1.6, ""), (2.0, 2.5, "world.")]),
    ("a b c d e f g", [(0.0, 0.2, "Hello,"), (0.2, 0.4, ""), (0.5, 0.9, "big"), (1.0, 1.3, "wide"), (1.3, 1.6, ""), (2.0, 2.25, "world."), (2.25, 2.5, "")]),
    ("a b c d e f g h", None),
])
def test_spaced_by_count(spark, text, want):
    got = run(spark, WORDS, text, lambda w, t: wt.spaced_by_count(w, wt.split_words(t)))
    assert got is want or [x[2] for x in got] == [x[2] for x in want] and all(abs(a - b) < 1e-9 for x, y in zip(got, want) for a, b in zip(x[:2], y[:2]))


def brute_runs(old, new, i1, i2, j1, j2):
    best = (0, 0, 0)
    for i in range(i1, i2):
        for j in range(j1, j2):
            n = 0
            while i + n < i2 and j + n < j2 and old[i + n] == new[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    i, j, n = best
    return [*brute_runs(old, new, i1, i, j1, j), best, *brute_runs(old, new, i + n, i2, j + n, j2)] if n else []


def test_common_runs_are_the_longest_first():
    rng = random.Random(1)
    for _ in range(300):
        old = [rng.choice("abcdefg"[: rng.randrange(1, 8)]) for _ in range(rng.randrange(0, 25))]
        new = [w for w in old if rng.random() < 0.8] + [rng.choice("abcdxyz") for _ in range(rng.randrange(0, 6))]
        assert wt.common_runs(old, new) == brute_runs(old, new, 0, len(old), 0, len(new))


def test_long_texts_are_cut_at_unique_words():
    rng = random.Random(2)
    old = [rng.choice([f"u{i}", "the", "of", "and"]) for i in range(60000)]
    new = [w for w in old if rng.random() < 0.97]
    runs = wt.common_runs(old, new)
    assert all(old[i : i + n] == new[j : j + n] for i, j, n in runs)
    assert all(a + n <= c and b + n <= d for (a, b, n), (c, d, _) in zip(runs, runs[1:]))
    assert sum(n for *_, n in runs) > 0.99 * len(new)
    kept = [(k, i1, i2, j1, j2) for k, i1, i2, j1, j2 in wt.edits(old, new)]
    assert [j for _, _, _, j, _ in kept] == [0, *[j for *_, j in kept[:-1]]] and kept[-1][4] == len(new)
