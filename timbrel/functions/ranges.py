"""Interval, point and nearest-in-time joins built on equi keys.

Intervals are spread over time buckets so that the join key is
``(job, bucket)``: one busy job is split over its buckets, and only rows that
share a bucket meet.  A pair is kept in its first shared bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import scan, time_block


def _first_bucket(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width)))


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    width: float,
    l_span: tuple[str, str] = ("start", "end"),
    r_span: tuple[str, str] = ("r_start", "r_end"),
    closed: bool = False,
) -> DataFrame:
    """Inner join of intervals that overlap: strictly, or touching when ``closed``."""
    ls, le, rs, re_ = (F.col(c) for c in (*l_span, *r_span))
    lb = left.withColumn("_bucket", F.explode(F.sequence(_first_bucket(ls, width), F.greatest(_first_bucket(ls, width), _first_bucket(le, width)))))
    rb = right.withColumn("_bucket", F.explode(F.sequence(_first_bucket(rs, width), F.greatest(_first_bucket(rs, width), _first_bucket(re_, width)))))
    meets = ((rs <= le) & (re_ >= ls)) if closed else ((rs < le) & (re_ > ls))
    once = F.col("_bucket") == F.greatest(_first_bucket(ls, width), _first_bucket(rs, width))
    return lb.join(rb, [*keys, "_bucket"]).where(meets & once).drop("_bucket")


def points_in(
    points: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    width: float,
    t: str = "t",
    span: tuple[str, str] = ("start", "end"),
    ends: str = "[]",
) -> DataFrame:
    """Inner join of points with the intervals that hold them; ``ends`` names the closed sides."""
    s, e, p = F.col(span[0]), F.col(span[1]), F.col(t)
    pb = points.withColumn("_bucket", _first_bucket(p, width))
    sb = spans.withColumn("_bucket", F.explode(F.sequence(_first_bucket(s, width), F.greatest(_first_bucket(s, width), _first_bucket(e, width)))))
    low = p >= s if ends[0] == "[" else p > s
    high = p <= e if ends[1] == "]" else p < e
    return pb.join(sb, [*keys, "_bucket"]).where(low & high).drop("_bucket")


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    reach: float,
    l_t: str = "t",
    r_t: str = "r_t",
    strict: bool = False,
) -> DataFrame:
    """Band join: pairs whose times differ by at most (or less than) ``reach``."""
    lt, rt = F.col(l_t), F.col(r_t)
    lb = left.withColumn("_bucket", F.explode(F.sequence(_first_bucket(lt - reach, reach), _first_bucket(lt + reach, reach))))
    rb = right.withColumn("_bucket", _first_bucket(rt, reach))
    d = F.abs(lt - rt)
    return lb.join(rb, [*keys, "_bucket"]).where(d < reach if strict else d <= reach).drop("_bucket")


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t: str,
    right_t: str,
    right_cols: Sequence[str],
    seconds: float = 60.0,
    tie: Sequence[str] = (),
    sides: Sequence[str] = ("before", "after"),
) -> DataFrame:
    """Attach to every left row the closest right row at or before it (``before``)
    and after it (``after``), as structs of ``t`` and ``right_cols``.

    Right rows at the same time are reduced to one first, the last by ``tie``.
    Both tables go through one ordered pass, so no pairs are produced.  ``sides``
    names the ones that are needed.
    """
    keys = list(keys)
    if not right_cols:
        return _as_of_times(left, right, keys, t, right_t, seconds, sides)
    payload = F.struct(F.col(right_t).alias("t"), *right_cols)
    rank = F.struct(*tie) if tie else F.struct(*right_cols)
    r = right.groupBy(*keys, right_t).agg(F.max_by(payload, rank).alias("_r"))
    lcols = [c for c in left.columns if c not in keys]
    ll = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    ll = ll.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType))
    rr = r.select(*keys, F.col(right_t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(ll.schema["_l"].dataType).alias("_l"), "_r")
    both = ll.unionByName(rr)
    # left rows at one time see the same right rows, so their order among each other does not matter
    fill = {"before": F.col("_r")} if "before" in sides else {}
    back = {"after": F.col("_r")} if "after" in sides else {}
    got = scan(both, keys, ["_t", "_side"], time_block("_t", seconds), fill=fill, back=back)
    return got.where(F.col("_side") == 1).select(*keys, "_l.*", *sides)


def _as_of_times(left: DataFrame, right: DataFrame, keys: list[str], t: str, right_t: str, seconds: float, sides: Sequence[str]) -> DataFrame:
    """as_of without further columns: the time before is a running maximum, the one after a running minimum from the end.

    Both are numbers, which aggregate by hashing where rows as a whole are sorted first.
    """
    when = F.col(right_t).alias("_r")
    lcols = [c for c in left.columns if c not in keys]
    ll = left.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    ll = ll.withColumn("_r", F.lit(None).cast(right.schema[right_t].dataType))
    # a time that is missing or no number lies neither before nor after anything
    rr = right.select(*keys, when).where(F.col("_r").isNotNull() & ~F.isnan(F.col("_r").cast("double"))).distinct()
    rr = rr.select(*keys, F.col("_r").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(ll.schema["_l"].dataType).alias("_l"), "_r")
    peak = {"_before": F.col("_r")} if "before" in sides else {}
    low = {"_after": F.col("_r")} if "after" in sides else {}
    got = scan(ll.unionByName(rr), keys, ["_t", "_side"], time_block("_t", seconds), peak=peak, low=low)
    found = [F.when(F.col(f"_{s}").isNotNull(), F.struct(F.col(f"_{s}").alias("t"))).alias(s) for s in sides]
    return got.where(F.col("_side") == 1).select(*keys, "_l.*", *found)


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t: str,
    right_t: str,
    right_cols: Sequence[str],
    tolerance: float | None = None,
    later_wins: bool = False,
    name: str = "near",
    seconds: float = 60.0,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Closest right row in time as struct ``name``; null beyond ``tolerance``."""
    got = as_of(left, right, keys, t, right_t, right_cols, seconds, tie)
    back_d = F.col(t) - F.col("before.t")
    fwd_d = F.col("after.t") - F.col(t)
    forward = F.col("before").isNull() | (fwd_d <= back_d if later_wins else fwd_d < back_d)
    pick = F.when(F.col("after").isNotNull() & forward, F.col("after")).otherwise(F.col("before"))
    got = got.withColumn(name, pick).drop("before", "after")
    if tolerance is not None:
        got = got.withColumn(name, F.when(F.abs(F.col(t) - F.col(f"{name}.t")) <= tolerance, F.col(name)))
    return got


def shared_seconds(s1: str, e1: str, s2: str, e2: str) -> Column:
    """Length of the common part of two intervals, 0 when apart."""
    return F.greatest(F.lit(0.0), F.least(F.col(e1), F.col(e2)) - F.greatest(F.col(s1), F.col(s2)))
