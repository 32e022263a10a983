"""Word times after a text was edited: by number of words, or by aligning old and new words."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Segments of more words are cut at words that are unique on both sides before they are aligned.
CUT_OVER = 1000
_MARKS = r"^[.,!?;:]+|[.,!?;:]+$"
_OPS = "array<struct<kind:string,i1:int,i2:int,j1:int,j2:int>>"


def split_words(text: Column) -> Column:
    """Words between blanks of any script; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def spaced_by_count(words: Column, target: Column, reach: int = 3) -> Column:
    """Times for the words of ``target`` by position, where an edit changed their number by at most ``reach``.

    ``words`` is array<struct<start, end, word>>.  Too many times are sampled evenly; where times
    are missing, the longest entry (the first of equals) is halved until there are enough, the
    second half without a word.  Null where the numbers are further apart or a side is null; no
    words at all give an empty array.
    """
    m, n = F.size(target), F.size(words)
    step = n / m
    sampled = F.transform(target, lambda _, k: F.get(words, F.least(F.floor(k * step).cast("int"), n - 1)))

    def halved(entries: Column) -> Column:
        spans = F.transform(entries, lambda x: x["end"] - x["start"])
        at = F.array_position(spans, F.array_max(spans)).cast("int")
        long = F.element_at(entries, at)
        mid = (long["start"] + long["end"]) / 2
        first = F.struct(long["start"].alias("start"), mid.alias("end"), long["word"].alias("word"))
        second = F.struct(mid.alias("start"), long["end"].alias("end"), F.lit("").alias("word"))
        return F.concat(F.slice(entries, 1, at - 1), F.array(first, second), F.slice(entries, at + 1, F.size(entries)))

    # one step for each missing entry; a fold keeps the expression small
    filled = F.aggregate(F.sequence(F.lit(1), F.greatest(m - n, F.lit(1))), words, lambda entries, _: F.when(F.size(entries) < m, halved(entries)).otherwise(entries))
    return F.when(n == m, words).when(F.abs(n - m) > reach, F.lit(None)).when(n > m, F.when(m == 0, F.slice(words, 1, 0)).otherwise(sampled)).when(n > 0, filled)


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs (ascending by the first) that ascends in the second too."""
    tails: list[int] = []
    held: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
        held[at : at + 1] = [k]
        back.append(held[at - 1] if at else -1)
    out, k = [], held[-1] if held else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _fixed_points(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Words that occur once on both sides, in an order that both share."""
    def once(words: list[str]) -> dict[str, int]:
        at: dict[str, int] = {}
        for i, w in enumerate(words):
            at[w] = -1 if w in at else i
        return {w: i for w, i in at.items() if i >= 0}

    there = once(new)
    return _ascending([(i, there[w]) for w, i in once(old).items() if w in there])


def _longest(old: list[str], places: dict[str, list[int]], part: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """Start, start and length of the longest common run of a part; the first one in old, then in new, of equals."""
    i1, i2, j1, j2 = part
    best, upto = (i1, j1, 0), {}
    for i in range(i1, i2):
        here = places.get(old[i], [])
        upto = {j: upto.get(j - 1, 0) + 1 for j in here[bisect_left(here, j1) : bisect_left(here, j2)]}
        for j, n in upto.items():
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
    return best


def common_runs(old: list[str], new: list[str], cut_over: int = CUT_OVER) -> list[tuple[int, int, int]]:
    """Common runs of two word lists in order: the longest run first, then those on either side of it.

    A text of more than ``cut_over`` words is first cut at words that are unique on both sides, so
    that the search is among few words at a time.
    """
    places: dict[str, list[int]] = {}
    for j, w in enumerate(new):
        places.setdefault(w, []).append(j)
    fixed = _fixed_points(old, new) if max(len(old), len(new)) > cut_over else []
    runs = [(i, j, 1) for i, j in fixed]
    ends = [(-1, -1), *fixed, (len(old), len(new))]
    todo = [(a + 1, b, c + 1, d) for (a, c), (b, d) in zip(ends, ends[1:])]
    while todo:
        i1, i2, j1, j2 = part = todo.pop()
        if i1 < i2 and j1 < j2:
            i, j, n = _longest(old, places, part)
            if n:
                runs.append((i, j, n))
                todo += [(i1, i, j1, j), (i + n, i2, j + n, j2)]
    return sorted(runs)


def edits(old: list[str], new: list[str], cut_over: int = CUT_OVER) -> list[tuple[str, int, int, int, int]]:
    """What gives each new word its time: same, replaced or inserted, with the places on both sides."""
    out, i, j = [], 0, 0
    for a, b, n in [*common_runs(old, new, cut_over), (len(old), len(new), 0)]:
        if b > j:
            out.append(("replaced" if a > i else "inserted", i, a, j, b))
        if n:
            out.append(("same", a, a + n, b, b + n))
        i, j = a + n, b + n
    return out


def realigned(segments: DataFrame, words: str, text: str, name: str = "words", digits: int | None = 3, cut_over: int = CUT_OVER) -> DataFrame:
    """Add the words of an edited text with the times of the words that survived.

    ``words`` is array<struct<start, end, word>> of the text before the edit.  Words are compared
    without case and outer punctuation.  A run of replaced words shares the time of what it
    replaces, an inserted run the gap before the next old word (0.1 s at the end), words inserted
    before everything else get no entry, deleted words leave none.  Where the old words, the new
    text or all times are missing, the old words stay.  Times made here are rounded to ``digits``.
    """
    @F.pandas_udf(_OPS)
    def align(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([edits(list(a), list(b), cut_over) if a is not None else [] for a, b in zip(old, new)])

    # a filter on the result (an explode makes one) would repeat all steps below for each row if it could pass the alignment
    align = align.asNondeterministic()
    plain = lambda w: F.regexp_replace(F.lower(w), _MARKS, "")
    at = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    own, target = F.col(words), F.col("_target")

    def entry(start: Column, end: Column, word: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), word.alias("word"))

    def timed(op: Column) -> Column:
        n = op["j2"] - op["j1"]
        before = F.get(own, op["i1"] - 1)["end"]
        replaced = op["kind"] == "replaced"
        start = F.when(replaced, F.get(own, op["i1"])["start"]).otherwise(before)
        end = F.when(replaced, F.get(own, op["i2"] - 1)["end"]).otherwise(F.coalesce(F.get(own, op["i1"])["start"], before + 0.1))

        def word(w: Column, k: Column) -> Column:
            old = F.get(own, op["i1"] + k)
            each = (end - start) / n
            return F.when(op["kind"] == "same", entry(old["start"], old["end"], w)).otherwise(entry(at(start + k * each), at(start + (k + 1) * each), w))

        return F.transform(F.slice(target, op["j1"] + 1, n), word)

    d = segments.withColumn("_target", split_words(F.col(text)))
    d = d.withColumn("_ops", align(F.transform(own, lambda w: plain(w["word"])), F.transform(target, plain)))
    known = F.filter("_ops", lambda op: (op["kind"] != "inserted") | (op["i1"] > 0))
    d = d.withColumn("_found", F.flatten(F.transform(known, timed)))
    kept = F.when((F.size(own) == 0) | (F.size("_found") == 0), own).otherwise(F.col("_found"))
    return d.withColumn(name, kept).drop("_target", "_ops", "_found")
