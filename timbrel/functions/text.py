"""Text and scalar expressions used by several operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Words left out of chapter keywords.
STOP_WORDS = tuple("""
a an and are as at be been being but by can could did do does doing down for from had has have having he her here hers him his how i if
in into is it its just like me my no nor not of off on once only or other our ours out over own same she should so some such than that
the their them then there these they this those through to too under until up very was we were what when where which while who whom why
will with would you your yours yeah okay ok um uh well really actually maybe right kind sort think going get got
""".split())

TOKEN = r"[a-z][a-z0-9'-]{1,}"


def tokens(text: Column) -> Column:
    """Lower-case word tokens of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def keywords(text: Column) -> Column:
    """Tokens longer than two characters that are not stop words, repeats kept."""
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint distinct elements; an empty side gives 0."""
    joint = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / joint)


def title_words(title: Column) -> Column:
    """Distinct alphanumeric words longer than two characters, sorted."""
    words = F.transform(F.split(F.lower(title), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)))


CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"


def looks_cjk(text: Column) -> Column:
    return F.substring(text, 1, 50).rlike(CJK)


def sample_language(sample: Column) -> Column:
    """ja, zh, ar or en from the characters of a text sample."""
    n = F.length(sample)
    cjk = n - F.length(F.regexp_replace(sample, CJK, ""))
    return (
        F.when((cjk / F.greatest(n, F.lit(1)) > 0.3) & sample.rlike(r"[\x{3040}-\x{30ff}]"), "ja").when(cjk / F.greatest(n, F.lit(1)) > 0.3, "zh")
        .when(sample.rlike(r"[\x{0600}-\x{06ff}]"), "ar").otherwise("en")
    )


def most_repeated(grams: Column) -> Column:
    """Largest number of times one element occurs in an array.

    Sorting puts equal elements together, so one pass over the sorted array counts runs.
    """
    start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("n"), F.lit(0).alias("top"))

    def step(acc, g):
        n = F.when(acc["g"] == g, acc["n"] + 1).otherwise(1)
        return F.struct(g.alias("g"), n.alias("n"), F.greatest(acc["top"], n).alias("top"))

    return F.aggregate(F.array_sort(grams), start, step, lambda acc: acc["top"])


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and pass it on; inside a lambda a plain expression would
    be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeats(grams: Column, n: Column, limit: float) -> Column:
    return bind(most_repeated(grams), lambda top: (top >= 3) & (top / n > limit))


def is_looping(text: Column) -> Column:
    """Repetition test: word trigrams, or six-character grams for CJK text."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def by_word(ws: Column) -> Column:
        n = F.size(ws) - 2
        tri = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(ws, i, 3), " "))
        return F.when(n >= 7, _repeats(tri, n, 0.4)).otherwise(False)

    def by_char(cs: Column) -> Column:
        n = F.length(cs) - 5
        six = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(cs, i, F.lit(6)))
        return F.when(n >= 13, _repeats(six, n, 0.3)).otherwise(False)

    return F.when(looks_cjk(text), bind(F.regexp_replace(text, " ", ""), by_char)).otherwise(bind(words, by_word))


# Guidance label by keyword group, first match wins.
GUIDANCE = (
    ("Conversational/Interview", ("podcast", "interview", "conversation", "discussion")), ("Tutorial/Educational", ("tutorial", "how-to", "guide", "lesson", "teach")),
    ("Gaming/Stream", ("game", "gaming", "stream", "gameplay", "play")), ("Vlog/Lifestyle", ("vlog", "travel", "daily", "routine", "life")),
    ("Review/Product", ("review", "unbox", "product", "comparison")), ("Music/Performance", ("music", "song", "concert", "perform")),
    ("Comedy/Entertainment", ("comedy", "standup", "joke", "funny", "humor")), ("News/Commentary", ("news", "report", "breaking", "politics")),
)


def guidance(summary: Column) -> Column:
    """Content label of a summary text."""
    low = F.lower(F.coalesce(summary, F.lit("")))
    hits = [F.when(low.rlike("|".join(words)), label) for label, words in GUIDANCE]
    return F.coalesce(*hits, F.lit("General"))


def spoken_window(start: Column, end: Column, words: Column, head: float = 0.0, tail: float = 0.10) -> Column:
    """Time a segment is audible, from its first and last word when plausible."""
    ws, we = F.get(words, F.lit(0))["start"], F.element_at(words, -1)["end"]
    s, e = F.greatest(start - 0.02, ws - head), F.greatest(end, we) + tail
    ok = (F.size(words) > 0) & (we > ws) & (e > s)
    return F.when(ok, F.struct(s.alias("start"), e.alias("end"))).otherwise(F.struct(start.alias("start"), (end + tail).alias("end")))


def chi_squared(a: Column, b: Column) -> Column:
    """Symmetric chi-squared distance; infinite for different lengths."""
    parts = F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + 1e-9))
    return F.when(F.size(a) != F.size(b), F.lit(float("inf"))).otherwise(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p))


def unit_mass(values: Column) -> Column:
    """Histogram scaled to sum 1; an empty mass becomes uniform."""
    def scaled(xs: Column) -> Column:
        total = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda mass: F.transform(xs, lambda x: F.when(mass <= 0, 1.0 / F.greatest(F.size(xs), F.lit(1))).otherwise(x / mass)))

    return bind(values, scaled)


def safe_range(source: float, target: float, buffer: float = 3) -> tuple[int, int]:
    """Subject range in percent whose crop stays inside the frame."""
    import math

    r = source / target
    if r <= 1.01:
        return 5, 95
    pad = min(15, math.floor(buffer + (r - 1) * 1.5 + 0.5))
    return math.ceil(max(5, (pad * (r - 1) + 50) / r)), math.floor(min(95, ((100 - pad) * (r - 1) + 50) / r))


def safe_x(x: Column, source: float | None = None, target: float | None = None, margin: int = 10) -> Column:
    low, high = safe_range(source, target) if source and target else (margin, 100 - margin)
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(x + 0.5)))


@F.pandas_udf(ArrayType(IntegerType()))
def _running(sizes: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else np.cumsum(n).tolist() for n in sizes], dtype=object)


def proportional_words(text: Column, start: Column, end: Column, digits: int | None = 3) -> Column:
    """Words with times shared out by length.

    Characters up to each word are summed in one pass over the words of a text.
    """
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.split(clean, " ")
    upto = _running(F.transform(words, lambda w: F.length(w)))
    # a Python function can't stand inside a lambda, so its sums go along with the words
    sums = F.zip_with(upto, F.array_repeat(F.element_at(upto, -1), F.size(upto)), lambda c, n: F.struct(c.alias("upto"), n.alias("total")))
    share = lambda c, n: start + (end - start) * c / n
    at = lambda c, n: F.round(share(c, n), digits) if digits is not None else share(c, n)
    timed = F.zip_with(words, sums, lambda w, c: F.struct(at(c["upto"] - F.length(w), c["total"]).alias("start"), at(c["upto"], c["total"]).alias("end"), w.alias("word")))
    return F.when(clean != "", timed)
