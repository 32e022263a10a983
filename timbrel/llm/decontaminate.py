"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

Every item is cut into windows of ten consecutive words (a shorter item is one window).  A window
occurs in a document only where its rarest shingle of three words occurs, so that shingle alone, with
its place in the window, is the window's prefix: shingles are ordered by how often the documents hold
them, documents are joined on the prefixes, the place and the document's length bound where a window
can lie, and what is left is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 10
SHINGLE = 3
#: Rows of benchmark shingles up to which they are broadcast (about 16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Characters between words: all of ASCII but digits and letters; fixed by the definition of a word.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in order, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, BETWEEN), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _shingle(at: Column, w: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(w, at + i) for i in range(size)))


def _all_shingles(size: int) -> Column:
    """Place and hash of every shingle of a number of words of a document's words w."""
    places = F.sequence(F.lit(0), F.size("w") - size)
    return F.when(F.size("w") >= size, F.transform(places, lambda i: F.struct(i.alias("at"), _shingle(i, F.col("w"), size).alias("h")))).otherwise(
        F.array().cast("array<struct<at:int,h:bigint>>")
    )


def _windows(items: DataFrame, window: int) -> DataFrame:
    """One row per different window: window (number), w (its words), n, item_ids."""
    own = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = own.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, window))).alias("w")).distinct()
    return stored(cut.select(F.xxhash64("w").alias("window"), "w", F.size("w").alias("n"), "item_id"), "windows")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, _text (hash), spans: where windows of items occur in whole documents.

    spans holds (start, n, item_id) of every occurrence, in words.  One row per different document
    with an occurrence.  Items without words have no window.
    """
    windows = _windows(items, window)
    size = F.least(F.col("n"), F.lit(SHINGLE))
    parts = windows.select("window", "w", "n").distinct().select(
        "window", "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - size), lambda i: F.struct(i.alias("at"), _sized(i, F.col("w"), F.col("n")).alias("h")))).alias("p")
    ).select("window", "n", "p.at", "p.h")
    parts = stored(parts, "window-shingles")
    sizes = sorted(r[0] for r in parts.select(F.least("n", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE numbers
    known = parts.select("h").distinct()
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    found_in = [_all_shingles(s) for s in sizes]
    if not sizes:
        return keyed.where("false").select("doc_id", "_text", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("item_id"))).alias("spans"))
    exploded = keyed.select("doc_id", "_text", F.size("w").alias("length"), F.explode(F.concat(*found_in)).alias("p")).select("doc_id", "_text", "length", "p.at", "p.h")
    matched = stored(exploded.join(known, "h"), "matches")
    counts = matched.groupBy("h").agg(F.count("*").alias("c"))
    prefix = (
        parts.join(counts, "h").groupBy("window", "n").agg(F.min(F.struct("c", "at", "h")).alias("p"), F.count("*").alias("present"))
        # a window that lacks one of its shingles in all documents occurs in none
        .where(F.col("present") == F.col("n") - F.least(F.col("n"), F.lit(SHINGLE)) + 1)
        .select("window", "n", F.col("p.h").alias("h"), F.col("p.at").alias("place"))
    )
    near = matched.join(prefix, "h").select("doc_id", "_text", "length", (F.col("at") - F.col("place")).alias("start"), "window", "n")
    near = near.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("length"))).distinct()
    wanted = near.join(windows.select("window", "w").distinct(), "window").groupBy("doc_id", "_text").agg(F.collect_list(F.struct("start", "n", "window", "w")).alias("c"))
    verified = (
        keyed.join(wanted.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "c"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")))
        .dropDuplicates(["_d", "_t"])
        .select("doc_id", "_text", F.filter("c", lambda x: F.slice(F.col("w"), x["start"] + 1, x["n"]) == x["w"]).alias("c"))
        .select("doc_id", "_text", F.explode("c").alias("c")).select("doc_id", "_text", "c.start", "c.n", "c.window")
    )
    items_of = windows.select("window", "item_id")
    return verified.join(items_of, "window").groupBy("doc_id", "_text").agg(F.collect_set(F.struct("start", "n", "item_id")).alias("spans"))


def _sized(at: Column, w: Column, n: Column) -> Column:
    """Shingle of min(n, SHINGLE) words at a place of a window."""
    out = _shingle(at, w, SHINGLE)
    for s in range(SHINGLE - 1, 0, -1):
        out = F.when(n == s, _shingle(at, w, s)).otherwise(out)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Columns of docs with _n_words, _n_hit, _n_items and _items_sha256.

    A word inside any occurrence of a window is hit.  Null text has no words.  Repeated rows get equal
    results; columns of these names are replaced.
    """
    found = hits(docs, items, window)
    starts = F.array_sort(F.array_distinct(F.transform("spans", lambda s: F.struct(s["start"].alias("s"), (s["start"] + s["n"]).alias("e")))))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("till"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["till"], s["e"]).alias("till"), (a["n"] + F.greatest(s["e"] - F.greatest(a["till"], s["s"]), F.lit(0))).cast("long").alias("n")),
    )["n"]
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"].cast("string"))))
    per = found.select(
        F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), covered.alias("_n_hit"), F.size(ids).cast("long").alias("_n_items"), F.array_join(ids, ",").alias("_items")
    )
    new = ["_n_words", "_n_hit", "_n_items", "_items_sha256", "_h"]
    own = docs.drop(*new).withColumn("_h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_n_words", n_words(F.col("text")))
    joined = own.join(per, own["doc_id"].eqNullSafe(per["_d"]) & (own["_h"] == per["_t"]), "left")
    return joined.select(
        *(own[f"`{c}`"] for c in own.columns if c != "_h"), F.coalesce("_n_hit", F.lit(0)).cast("long").alias("_n_hit"), F.coalesce("_n_items", F.lit(0)).cast("long").alias("_n_items"),
        F.sha2(F.coalesce("_items", F.lit("")).cast("binary"), 256).alias("_items_sha256"),
    )


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = contamination(docs.select("doc_id", "text"), items)
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.col("_n_items").alias("n_items"), F.col("_items_sha256").alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window of an item occurs, with their columns."""
    found = hits(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"))
    own = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(found, own["doc_id"].eqNullSafe(found["_d"]) & (own["_h"] == found["_t"]), "left_anti").drop("_h")
