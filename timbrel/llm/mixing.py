"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .prefix import BEFORE, TOTAL, prefix_sums

#: Weights of the sources in code point order, repeating; the mix's share of all sizes; copies of a source at most.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), Fraction(3, 2), 2
_BLANK = " \t\n\u000b\f\r"


def word_count(text: Column) -> Column:
    """Words between blanks (space and U+0009 to U+000D), 0 for null; each word is first made one letter."""
    letters = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "a"), _BLANK, "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Add each source's target (double) to source keys and sizes (_source, source_size; one row a source).

    The mix is share times all sizes. A source's part goes by its weight, but ends at epochs times
    its size, and what is over goes to the others by weight until none is above. That is a level
    that all sources rise to in proportion to their weights: sources are sorted by the level at
    which they are full, prefix sums of what the full ones hold give the level of the rest, and the
    lowest level that leaves the next source unfilled holds. Sums are whole numbers; one number
    goes to the driver. With a share above epochs all sources are full.
    """
    up, down = share.numerator, share.denominator
    named = sizes.withColumns({"_all": F.lit(""), "_one": F.lit(1).cast("long")})
    named = prefix_sums(named, "_all", ["_source"], "_one", "mix-order").withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col(BEFORE) % len(weights) + 1).cast("int")).cast("long"))
    named = named.select("_all", "_source", "source_size", "_w", (F.col("source_size") / F.col("_w")).alias("_full"))
    named = prefix_sums(named, "_all", ["_full", "_source"], "source_size", "mix-full").withColumnsRenamed({BEFORE: "_held", TOTAL: "_sizes"})
    named = prefix_sums(named, "_all", ["_full", "_source"], "_w", "mix-weight")
    # with the sources before it full: rest / weights is the level, epochs * size / weight where this one is full
    rest = F.col("_sizes") * up - F.col("_held") * (epochs * down)
    named = named.withColumns({"_rest": rest, "_weights": F.col(TOTAL) - F.col(BEFORE)})
    named = stored(named, "mix-levels")
    wide = "decimal(19,0)"
    filled = (F.col("source_size") * (epochs * down)).cast(wide) * F.col("_weights").cast(wide)
    open_ = F.col("_rest").cast(wide) * F.col("_w").cast(wide) <= filled
    level = named.where(open_).orderBy("_full", "_source").select("_rest", "_weights", "_full", "_source").first()
    full = F.col("source_size") * float(epochs)
    if level is None:
        return named.select("_source", "source_size", full.alias("target"))
    part = (F.col("_w") * level["_rest"]).cast("double") / float(level["_weights"] * down)
    before = F.struct("_full", "_source") < F.struct(F.lit(level["_full"]), F.lit(level["_source"]))
    return named.select("_source", "source_size", F.when(before, full).otherwise(part).alias("target"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """Add source_size, target, copies and rest to rows of doc_id, source and size (long, not negative).

    The mix takes a row `copies` times in whole and then its first `rest` words. Every source's
    rows are put in the order of the digest of seed and doc_id, its whole budget (the target without
    its fraction) is cut into whole epochs and a rest, and the rows before the rest's end are taken
    once more; the row at the cut is taken in part, so a source gives exactly its budget, and no
    row more than epochs times. Sources go by code point, a null source is one of its own and last;
    an empty source has target 0. Rows of one doc_id (or none, taken as empty) are rows of their
    own, by size; equal rows may stand for each other, and reruns agree. More columns pass through,
    but for names that start with an underscore and the four added ones. No rows give no rows.
    """
    source = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source")))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
    keyed = rows.select("doc_id", "size", source.alias("_source"), key.alias("_key"), own)
    placed = prefix_sums(keyed, "_source", ["_key", "doc_id", "size"], "size", "mix")
    sizes = placed.groupBy("_source").agg(F.sum("size").alias("source_size"))
    goal = stored(targets(sizes, weights, share, epochs), "mix-targets")
    out = placed.join(goal, "_source")
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    left = budget - whole * F.col("source_size")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col(BEFORE))).cast("long")
    added = {"source_size": F.col("source_size"), "target": F.col("target"), "copies": whole, "rest": rest}
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in rows.columns if c not in added], *[c.alias(k) for k, c in added.items()])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: one row per copy, with the columns of docs, epoch (long, from 0) and the text that is taken.

    docs has doc_id, source and text. Only the row at a source's cut has a shorter text, which ends
    with its last word taken. Null texts and texts without words give no rows; a column epoch of
    docs is replaced.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = mix(named, **options)
    last = F.col("copies") - F.when(F.col("rest") > 0, 0).otherwise(1)
    copies = taken.where((F.col("copies") > 0) | (F.col("rest") > 0)).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = (F.col("epoch") == F.col("copies")) & (F.col("rest") < F.col("size"))
    text = F.when(cut, F.array_join(F.slice(words, 1, F.col("rest").cast("int")), "")).otherwise(F.col("row.text"))
    copies = copies.where(F.col("size") > 0)
    return copies.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "epoch"], "epoch")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, copies counted) of every row; null texts have size 0."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mix(slim, **options)
    taken = F.col("copies") * F.col("size") + F.col("rest")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
