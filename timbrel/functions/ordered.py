"""Ordered computations that stay safe when one key holds a large share of the rows.

A plain ``Window.partitionBy(job)`` sends a whole job to one task.  Everything
here partitions by ``(key, block)`` instead, where a block is a slice of the
ordering column.  Each block is reduced to one summary row with a partial
aggregate, only the summaries are ordered per key, and the carried value is
joined back.  A key with N rows costs its busiest task N / rows-per-block.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = "_blk"


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which driver and executors share.

    A local session without one gets a temporary folder; on a cluster that is an
    error, since executors could not read each other's files.
    """
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and go on from there.

    A scan reads its input twice, so long chains of scans are cut between steps,
    preferably after the rows were reduced.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder as a table and read it again.

    For long loops: a checkpoint keeps what the optimizer has derived about its columns, which can
    double with every round, and a table starts anew, with its size known.
    """
    import uuid

    path = f"{checkpoint_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def time_block(t: str, seconds: float = 60.0) -> Column:
    """Block number of a time column; a minute keeps blocks small in dense jobs."""
    return F.floor(F.col(t) / F.lit(float(seconds)))


def index_block(idx: str, rows: int = 4096) -> Column:
    """Block number of a dense row index."""
    return F.floor(F.col(idx) / F.lit(rows))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    prev: dict[str, Column] | None = None,
    nxt: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    peak: dict[str, Column] | None = None,
    fill: dict[str, Column] | None = None,
    back: dict[str, Column] | None = None,
    low: dict[str, Column] | None = None,
    ahead: dict[str, Column] | None = None,
) -> DataFrame:
    """Add lag (prev), lead (nxt), running sum/max (total, peak), running min from
    the end (low) and forward or backward fill (fill, back) columns, all in one pass.
    ``ahead`` is a backward fill from later rows only, without the row itself.

    ``order`` must be ascending, unique within a key, and monotone in ``block``.
    """
    prev, nxt, total = prev or {}, nxt or {}, total or {}
    peak, fill, back, low, ahead = peak or {}, fill or {}, back or {}, low or {}, ahead or {}
    keys = list(keys)
    d = df.withColumn(BLOCK, block)
    pos = F.struct(*order)
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # a frame from each row to the end would be read anew for every row; from the end on it is a running one
    since = Window.partitionBy(*keys, BLOCK).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    wb = Window.partitionBy(*keys).orderBy(BLOCK)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)

    inside: dict[str, Column] = {}
    reduced: list[Column] = []
    carried: dict[str, Column] = {}
    final: dict[str, Column] = {}
    for name, x in prev.items():
        inside[f"_i_{name}"] = F.lag(F.struct(x.alias("v"))).over(w)
        reduced.append(F.max_by(F.struct(x.alias("v")), pos).alias(f"_s_{name}"))
        carried[f"_c_{name}"] = F.lag(f"_s_{name}").over(wb)
        final[name] = F.coalesce(F.col(f"_i_{name}"), F.col(f"_c_{name}"))["v"]
    for name, x in nxt.items():
        inside[f"_i_{name}"] = F.lead(F.struct(x.alias("v"))).over(w)
        reduced.append(F.min_by(F.struct(x.alias("v")), pos).alias(f"_s_{name}"))
        carried[f"_c_{name}"] = F.lead(f"_s_{name}").over(wb)
        final[name] = F.coalesce(F.col(f"_i_{name}"), F.col(f"_c_{name}"))["v"]
    for name, x in total.items():
        inside[f"_i_{name}"] = F.sum(x).over(upto)
        reduced.append(F.sum(x).alias(f"_s_{name}"))
        carried[f"_c_{name}"] = F.sum(f"_s_{name}").over(before)
        final[name] = F.coalesce(F.col(f"_c_{name}") + F.col(f"_i_{name}"), f"_i_{name}", f"_c_{name}")
    for name, x in peak.items():
        inside[f"_i_{name}"] = F.max(x).over(upto)
        reduced.append(F.max(x).alias(f"_s_{name}"))
        carried[f"_c_{name}"] = F.max(f"_s_{name}").over(before)
        final[name] = F.greatest(f"_i_{name}", f"_c_{name}")
    for name, x in low.items():
        inside[f"_i_{name}"] = F.min(x).over(since)
        reduced.append(F.min(x).alias(f"_s_{name}"))
        carried[f"_c_{name}"] = F.min(f"_s_{name}").over(after)
        final[name] = F.least(f"_i_{name}", f"_c_{name}")
    for name, x in fill.items():
        inside[f"_i_{name}"] = F.last(x, ignorenulls=True).over(upto)
        reduced.append(F.max_by(x, F.when(x.isNotNull(), pos)).alias(f"_s_{name}"))
        carried[f"_c_{name}"] = F.last(f"_s_{name}", ignorenulls=True).over(before)
        final[name] = F.coalesce(f"_i_{name}", f"_c_{name}")
    for name, x in {**back, **ahead}.items():
        inside[f"_i_{name}"] = F.last(x, ignorenulls=True).over(since if name in back else since.rowsBetween(Window.unboundedPreceding, -1))
        reduced.append(F.min_by(x, F.when(x.isNotNull(), pos)).alias(f"_s_{name}"))
        carried[f"_c_{name}"] = F.last(f"_s_{name}", ignorenulls=True).over(after)
        final[name] = F.coalesce(f"_i_{name}", f"_c_{name}")

    summary = d.groupBy(*keys, BLOCK).agg(*reduced)
    summary = summary.select(*keys, BLOCK, *[c.alias(n) for n, c in carried.items()])
    out = d.withColumns(inside).join(summary, [*keys, BLOCK], "left").withColumns(final)
    return out.drop(BLOCK, *inside, *carried)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "rn") -> DataFrame:
    """1-based position of each row within its key."""
    return scan(df, keys, order, block, total={name: F.lit(1).cast("long")})


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    state: Sequence[str],
    breaks: Callable[[Column, Column], Column],
    name: str = "island",
) -> DataFrame:
    """Number the runs of consecutive rows; ``breaks(prev, cur)`` starts a new run.

    ``prev`` and ``cur`` are structs of the ``state`` columns.  The first row of
    a key belongs to run 0.
    """
    keys = list(keys)
    d = df.withColumn(BLOCK, block).withColumn("_cur", F.struct(*state))
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    flag = F.when(F.col("_prev").isNull(), 0).when(breaks(F.col("_prev"), F.col("_cur")), 1).otherwise(0)
    d = d.withColumn("_prev", F.lag("_cur").over(w)).withColumn("_flag", flag.cast("long"))
    pos = F.struct(*order)
    wb = Window.partitionBy(*keys).orderBy(BLOCK)
    joined = F.when(F.col("_left").isNull(), 0).when(breaks(F.col("_left"), F.col("_head")), 1).otherwise(0)
    summary = (
        d.groupBy(*keys, BLOCK)
        .agg(
            F.min_by("_cur", pos).alias("_head"),
            F.max_by("_cur", pos).alias("_tail"),
            F.sum("_flag").alias("_inner"),
        )
        .withColumn("_left", F.lag("_tail").over(wb))
        .withColumn("_edge", joined.cast("long"))
        .withColumn(
            "_base",
            F.col("_edge")
            + F.coalesce(
                F.sum(F.col("_edge") + F.col("_inner")).over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select(*keys, BLOCK, "_base")
    )
    out = d.withColumn("_in_block", F.sum("_flag").over(upto)).join(summary, [*keys, BLOCK], "left")
    return out.withColumn(name, F.col("_in_block") + F.col("_base")).drop(BLOCK, "_cur", "_prev", "_flag", "_in_block", "_base")


def with_halo(df: DataFrame, t: str, width: float, behind: float = 0.0, ahead: float = 0.0) -> DataFrame:
    """Copy each row into every block that needs it for a bounded time frame.

    ``behind`` seconds of history and ``ahead`` seconds of look-ahead are made
    visible inside block ``_blk``; rows with ``_own`` false are context only and
    must be dropped after the window is evaluated.
    """
    first = F.floor((F.col(t) - F.lit(float(ahead))) / width)
    last = F.floor((F.col(t) + F.lit(float(behind))) / width)
    return (
        df.withColumn(BLOCK, F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col(BLOCK) == F.floor(F.col(t) / width))
    )


def pick_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: dict[str, Callable[[Column], Column]],
    block: Column,
) -> DataFrame:
    """Exact order statistics: ``picks[name](n)`` is the 0-based index in the sorted values.

    Works on value counts, so repeated values are reduced before the shuffle and
    no key's values are gathered in one place.  Adds ``n``, the row count.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    ranked = scan(counts, keys, [value], block, total={"_upto": F.col("_k")})
    sizes = counts.groupBy(*keys).agg(F.sum("_k").alias("n"))
    joined = ranked.join(sizes, keys)
    hit = {
        name: F.max(F.when((F.col("_upto") > idx(F.col("n"))) & (F.col("_upto") - F.col("_k") <= idx(F.col("n"))), F.col(value)))
        for name, idx in picks.items()
    }
    return joined.groupBy(*keys).agg(F.max("n").alias("n"), *[c.alias(n) for n, c in hit.items()])


Step = Callable[[object, tuple], tuple[object, Iterable[tuple]]]


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    schema: str,
    start: Callable[[], object],
    step: Step,
    finish: Callable[[object], Iterable[tuple]] | None = None,
) -> DataFrame:
    """Ordered fold with state, streamed one Arrow batch at a time.

    Rows are hashed on ``keys`` and sorted, then one pass carries the state from
    row to row and from batch to batch; nothing is gathered per key.  Use only
    where the rule truly depends on earlier decisions, and pass natural breaks
    (an island id) among ``keys`` so that a long job is cut into independent runs.
    ``step(state, row)`` returns the new state and output tuples.
    """
    keys = list(keys)
    cols = df.columns
    at = [cols.index(k) for k in keys]
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            for row in zip(*(pdf[c].tolist() for c in cols)):
                # pandas shows a missing key as NaN, which differs from itself
                key = tuple(None if row[i] != row[i] else row[i] for i in at)
                if key != current:
                    if current is not None and finish is not None:
                        out.extend(finish(state))
                    current, state = key, start()
                state, emitted = step(state, row)
                out.extend(emitted)
            yield pd.DataFrame(out, columns=names).astype(object)
        if current is not None and finish is not None:
            yield pd.DataFrame(list(finish(state)), columns=names).astype(object)

    return (
        df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
    )


#: A block of greedy thinning is this many gaps long, so that it holds some times also where they lie far apart.
GAPS = 512


def _last_kept(x: list[float], start: float, gap: float, strict: bool) -> tuple[list[float], list[float]]:
    """What a block does to the last kept time: its times that can be the first one kept, and the last one kept then."""
    size = far = len(x)
    last = list(x)
    for i in range(size - 1, -1, -1):  # far: the first time that is far enough from time i
        while far - 1 > i and (x[far - 1] - x[i] > gap if strict else x[far - 1] - x[i] >= gap):
            far -= 1
        if far < size:
            last[i] = last[far]
    n = min(size, bisect_right(x, start + gap) + 1)
    return x[:n], last[:n]


def _kept(x: list[float], entry: float | None, gap: float, strict: bool) -> list[int]:
    """Indexes of the times of a block that are kept, given the last time kept before it."""
    last = None if entry is None or entry != entry else entry
    out = []
    for i, t in enumerate(x):
        if last is None or (t - last > gap if strict else t - last >= gap):
            out.append(i)
            last = t
    return out


def keep_spaced(df: DataFrame, keys: Sequence[str], t: str, gap: float, order: Sequence[str], seconds: float = 60.0, strict: bool = False) -> DataFrame:
    """Greedy thinning: keep a row when it is ``gap`` away from the last KEPT row.

    A row is followed by the first one that is far enough from it, so a block of a key is a map
    from the last time kept before it to the last time kept in it, which the few rows in its first
    gap describe.  Blocks make their maps side by side, one pass over the maps of a key (one
    for GAPS gaps) gives each block its entry, and blocks choose
    their rows side by side.  Of rows at one time the first by ``order`` stands for all.  Rows
    without a time are left out.  A gap of 0 keeps one row of each time.
    """
    keys, cols = list(keys), df.columns
    width = max(GAPS * float(gap), 1e-3)
    rest = [c for c in cols if c not in keys and c != t]
    timed = df.where(F.col(t).isNotNull())
    if rest:
        first = timed.groupBy(*keys, t).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    else:  # rows at one time are equal, which needs no sorting
        first = timed.select(*keys, t).distinct().withColumn("_row", F.lit(None).cast("boolean"))
    cells = first.groupBy(*keys, F.floor(F.col(t) / width).alias(BLOCK)).agg(F.sort_array(F.collect_list(F.struct(F.col(t).cast("double").alias("at"), F.col(t).alias("t"), "_row"))).alias("_rows"))
    cells = cut_lineage(cells)
    times = F.col("_rows.at")

    @F.pandas_udf("struct<first:array<double>,last:array<double>>")
    def mapped(x: pd.Series, start: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_last_kept(v.tolist(), s, gap, strict) for v, s in zip(x, start.tolist())], columns=["first", "last"])

    @F.pandas_udf("array<int>")
    def chosen(x: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([_kept(v.tolist(), e, gap, strict) for v, e in zip(x, entry.tolist())])

    maps = cells.select(*keys, BLOCK, mapped(times, F.col(BLOCK) * width).alias("_map")).select(*keys, BLOCK, "_map.first", "_map.last")
    own = [maps.columns.index(k) for k in keys]

    def step(entry, row):
        after = entry
        for head, tail in zip(row[-2], row[-1]):
            if entry is None or (head - entry > gap if strict else head - entry >= gap):
                after = float(tail)
                break
        return after, [(*(row[i] for i in own), row[-3], entry)]

    kinds = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    entries = fold_sorted(maps, keys, [BLOCK], ", ".join([*kinds, f"{BLOCK} long", "_entry double"]), lambda: None, step)
    named = entries.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(BLOCK).alias("_k_blk"), "_entry")
    same = F.col(BLOCK) == F.col("_k_blk")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    hit = cells.join(named, same).withColumn("_at", chosen.asNondeterministic()(times, F.col("_entry")))
    out = hit.select(*keys, F.explode(F.transform("_at", lambda i: F.get("_rows", i))).alias("_r"))
    return out.select(*[F.col(c) if c in keys else F.col("_r.t").alias(c) if c == t else F.col(f"_r._row.`{c}`").alias(c) for c in cols])


def ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, cols: dict[str, str], alpha: float, reverse: bool = False) -> DataFrame:
    """Exponential moving average of ``cols`` (output name -> input column).

    Blocks are long enough that the weight of anything before the previous
    block is below 1e-40, so the running value equals the in-block weighted sum
    plus the previous block's last value; no row-by-row pass is needed.
    """
    import math

    keys = list(keys)
    keep = 1.0 - alpha
    rows = max(8, math.ceil(92.2 / -math.log(keep)))
    d = numbered(df, keys, order, block, "_pos")
    if reverse:
        sizes = d.groupBy(*keys).agg(F.max("_pos").alias("_n"))
        d = d.join(sizes, keys).withColumn("_pos", F.col("_n") + 1 - F.col("_pos")).drop("_n")
    d = d.withColumns({"_b": F.floor((F.col("_pos") - 1) / rows), "_j": (F.col("_pos") - 1) % rows})
    w = Window.partitionBy(*keys, "_b").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(F.col("_pos") == 1, 1.0).otherwise(alpha)
    for out, c in cols.items():
        d = d.withColumn(f"_e_{out}", F.sum(first * F.col(c) * F.pow(F.lit(1.0 / keep), F.col("_j"))).over(w) * F.pow(F.lit(keep), F.col("_j")))
    tails = d.where(F.col("_j") == rows - 1).select(*keys, (F.col("_b") + 1).alias("_b"), *[F.col(f"_e_{o}").alias(f"_t_{o}") for o in cols])
    d = d.join(tails, [*keys, "_b"], "left")
    d = d.withColumns({o: F.col(f"_e_{o}") + F.coalesce(F.col(f"_t_{o}"), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_j") + 1) for o in cols})
    return d.drop("_pos", "_b", "_j", *[f"_e_{o}" for o in cols], *[f"_t_{o}" for o in cols])
