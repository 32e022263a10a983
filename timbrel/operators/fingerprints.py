"""Fingerprints (histograms) of detections matched to the slots they were seen in before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import cut_lineage, fold_sorted, index_block, numbered, written

#: Fingerprints and centroids meet in blocks of this many.
BLOCK_ROWS = 256
#: The blocks of a job are spread over this many join keys.
SALTS = 64
#: First undecided fingerprints of a job that one round settles in order.
HEADS = 512


def chi_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of every row of ``a`` to every row of ``b``, summed entry by entry so that blocks don't change them."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        apart, both = x[:, None] - y[None, :], x[:, None] + y[None, :]
        both += 1e-9
        apart *= apart
        apart /= both
        out += apart
    return out


def _blocks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with ``name``, the number of one of the key's blocks of about ``BLOCK_ROWS`` rows."""
    many = rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_many"))
    return rows.join(many, keys).withColumn(name, F.expr("pmod(xxhash64(_id), _many)")).drop("_many")


def met_blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``left`` with all of ``right`` of the same keys and size, in blocks: keys, left_id, left_v, right_id, right_v.

    Both have keys, _id and v; a block is an array of ids, ascending, and its vectors end to end.  The
    blocks of ``left`` are dealt over salted keys to which those of ``right`` are copied.  The sizes
    of the arrays are unknown to the planner, so the join is told to shuffle: the copies must not be
    gathered in the driver for a broadcast.
    """
    own = [*keys, "_size"]
    left, right = (d.select(*keys, F.size("v").alias("_size"), "_id", "v") for d in (left, right))
    packed = lambda d, name: d.groupBy(*own, name).agg(F.sort_array(F.collect_list(F.struct("_id", "v"))).alias("_rows"))
    salts = left.groupBy(*own).agg(F.least(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(SALTS)).alias("_salts"))
    a = packed(_blocks(left, own, "_block"), "_block").withColumn("_salt", F.pmod("_block", F.lit(SALTS)))
    a = a.select(*own, "_salt", F.col("_rows._id").alias("left_id"), F.flatten("_rows.v").alias("left_v"))
    b = packed(_blocks(right, own, "_block"), "_block").join(salts, own).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
    b = b.select(*own, "_salt", F.col("_rows._id").alias("right_id"), F.flatten("_rows.v").alias("right_v"))
    # a number of partitions of their own, as few bytes are much work here
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(parts, *own, "_salt").join(b.repartition(parts, *own, "_salt").hint("merge"), [*own, "_salt"]).drop("_size", "_salt")


def unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors of both blocks of a row."""
    left, a, right, b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("left_id", "left_v", "right_id", "right_v"))
    return left, a.reshape(len(left), -1), right, b.reshape(len(right), -1)


def _within(prints: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """Nearest centroid within the threshold of each print that has one: job_id, print_id, slot_id.

    ``prints``: job_id, print_id, v; ``centroids``: job_id, slot_id, born, v.  A centroid takes part
    for prints that are not before ``born``.  Ties go to the smaller slot_id.  Both sides meet in
    blocks; what a print found in each of them is reduced by a partial aggregate.
    """
    kind = prints.schema["job_id"].dataType.simpleString()
    met = met_blocks(prints.withColumn("_id", F.col("print_id")), centroids.withColumn("_id", F.struct("slot_id", "born")), ["job_id"])
    met = met.select("job_id", "left_id", "left_v", F.col("right_id.slot_id").alias("right_id"), "right_v", F.col("right_id.born").alias("_born"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, p, slots, s = unpacked(batch, i)
                far = chi_squared(p, s)
                far[batch.column("_born")[i].values.to_numpy()[None, :] > ids[:, None]] = np.inf
                at = far.argmin(axis=1)
                best = far[np.arange(len(ids)), at]
                hit = np.flatnonzero(best <= threshold)
                job = batch.column("job_id").take(pa.array(np.full(len(hit), i)))
                yield pa.RecordBatch.from_arrays([job, pa.array(ids[hit]), pa.array(best[hit]), pa.array(slots[at[hit]])], ["job_id", "print_id", "dist", "slot_id"])

    found = met.mapInArrow(nearest, f"job_id {kind}, print_id long, dist double, slot_id long")
    best = F.min(F.struct("dist", "slot_id")).alias("_best")
    return found.groupBy("job_id", "print_id").agg(best).select("job_id", "print_id", "_best.slot_id")


def _first_of_their_kind(prints: DataFrame, threshold: float) -> DataFrame:
    """Prints that no earlier print of this kind is within the threshold of: job_id, print_id, v.

    The first ``HEADS`` open prints of a job are settled in order, for all prints before them are
    settled already; then the new ones are compared with the rest in blocks, which closes what is
    near them.  Every round is written out.
    """
    job = prints.schema["job_id"].dataType.simpleString()
    # of equal histograms only the first can be new: the others are as near to what it is near to
    first = prints.groupBy("job_id", "v").agg(F.min("print_id").alias("print_id"))
    todo = written(first.select("job_id", "print_id", "v"))
    new = todo.limit(0)

    def step(kept, row):
        key, print_id, v = row
        v = np.asarray(v, dtype=float).reshape(1, -1)
        same = [k for k in kept if k.shape == v.shape]
        if same and chi_squared(v, np.vstack(same)).min() <= threshold:
            return kept, []
        return [*kept, v], [(key, print_id, v[0].tolist())]

    rank = F.row_number().over(Window.partitionBy("job_id").orderBy("print_id"))
    while not todo.isEmpty():
        heads = written(todo.withColumn("_n", rank).where(F.col("_n") <= HEADS).drop("_n"))
        won = written(fold_sorted(heads, ["job_id"], ["print_id"], f"job_id {job}, print_id long, v array<double>", list, step))
        new = new.unionByName(won)
        rest = todo.join(heads.select("job_id", "print_id"), ["job_id", "print_id"], "left_anti")
        near = _within(rest, won.select("job_id", F.col("print_id").alias("slot_id"), F.lit(-(2**63)).alias("born"), "v"), threshold)
        todo = written(rest.join(near, ["job_id", "print_id"], "left_anti"))
    return new


def match_to_slots(prints: DataFrame, slots: DataFrame, threshold: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """Slot of every fingerprint, taken in order, and the slots with the new ones added.

    ``prints``: job_id, print_id (unique in a job), histogram; ``slots``: job_id, slot_id, centroid.
    A fingerprint takes the nearest slot within the threshold among the given ones and those made by
    earlier fingerprints (ties: the smaller slot_id), else it makes a slot of its own, numbered
    after the job's largest slot_id (from 0 in a job without slots).  Given centroids stay as they
    are.  Histograms of another length never match; two empty ones do.  A fingerprint without a
    histogram, without a job or with a missing entry gets a null slot; such slots match nothing.
    """
    vector = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c).cast("array<double>"))
    p = cut_lineage(prints.select("job_id", F.col("print_id").cast("long").alias("print_id"), vector("histogram").alias("v")))
    s = slots.select("job_id", F.col("slot_id").cast("long").alias("slot_id"), F.lit(-(2**63)).alias("born"), vector("centroid").alias("v"))
    s = cut_lineage(s)
    known, seen = s.where("v IS NOT NULL"), p.where("v IS NOT NULL AND job_id IS NOT NULL")
    unmatched = seen.join(_within(seen, known, threshold), ["job_id", "print_id"], "left_anti")
    made = _first_of_their_kind(unmatched, threshold)
    made = numbered(made, ["job_id"], ["print_id"], index_block("print_id"), "_n")
    last = s.groupBy("job_id").agg(F.max("slot_id").alias("_last"))
    slot = (F.coalesce("_last", F.lit(-1).cast("long")) + F.col("_n")).alias("slot_id")
    made = cut_lineage(made.join(last, "job_id", "left").select("job_id", slot, F.col("print_id").alias("born"), "v"))
    got = _within(seen, known.unionByName(made), threshold)
    matches = p.select("job_id", "print_id").join(got, ["job_id", "print_id"], "left")
    return matches, slots.select("job_id", "slot_id", "centroid").unionByName(made.select("job_id", "slot_id", F.col("v").alias("centroid")))
