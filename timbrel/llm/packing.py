"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Large-item matching: pieces over one third of the capacity pair at most twice per sequence, largest
with the largest that fits; smaller pieces then go, largest first, to the sequence whose gap they
fill best.  All pieces of one length are alike, so the plan is made on the histogram of lengths (at
most ``capacity`` rows, whatever the corpus) and each piece takes its place by its rank among the
pieces of its length.  No task and no driver holds more than the histogram and the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import public_tokenizer, steps, stored
from .tokens import encoder

CAPACITY = 1024
END_ID = 2


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), block, rank.

    With ``digest`` their CRC-32 (ids_crc32) stands in place of the ids, so that no ids are stored.

    Null text counts as empty (one piece, the end id alone); a null doc_id stays null; repeated rows
    are documents of their own.  Other columns of docs are ignored.  Documents longer than the
    capacity are cut into full pieces, the first one takes the remainder.  ``rank`` numbers the
    pieces of one length within their task's ``block``.  The table is stored once, so both are fixed.
    """
    path = vocabulary or public_tokenizer("byte_bpe_50k.json")
    content, kind = ("ids_crc32", "long") if digest else ("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        enc = encoder(path, True)
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in steps(texts):
                rows = []
                for doc_id, ids in zip(doc_ids[a:b], enc.encode(texts[a:b]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for piece in range(len(cuts) - 1):
                        start, stop = cuts[piece], cuts[piece + 1]
                        own = ids[4 * start : 4 * stop]
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(own) if digest else own, block, int(seen[stop - start])))
                        seen[stop - start] += 1
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary(), pa.int32(), pa.int64())
                names = ["doc_id", "piece", "start", "length", content, "block", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, piece int, start long, length long, {content} {kind}, block int, rank long"), "pieces")


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, pieces, first sequence, pieces per sequence, first offset).

    Segments of one length are taken in order of rank.  Works on counts alone: time and size depend
    on the capacity, not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, how many)
    order: list[int] = []  # gaps in use, ascending
    fresh = 0

    def open_gap(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        top = large[-1]
        have = left[top]
        at = bisect.bisect_right(large, capacity - top) - 1
        mate = large[at] if at >= 0 else 0
        if mate == top and have == 1:
            mate = large[at - 1] if at >= 1 else 0
        many = have if not mate else have // 2 if mate == top else min(have, left[mate])
        out.append((top, many, fresh, 1, 0))
        if mate:
            out.append((mate, many, fresh, 1, top))
        open_gap(capacity - top - mate, fresh, many)
        fresh += many
        for n in (top, mate):
            if n:
                left[n] -= many
        large = [n for n in large if left[n]]

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[n]
        while rest:
            at = bisect.bisect_left(order, n)
            if at < len(order):
                gap = order[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, first, many = capacity, fresh, -(-rest // (capacity // n))
                fresh += many
            each = gap // n
            full = min(many, rest // each)
            if full:
                out.append((n, full * each, first, each, capacity - gap))
                open_gap(gap - each * n, first, full)
                rest -= full * each
            if full < many and rest:
                out.append((n, rest, first + full, rest, capacity - gap))
                open_gap(gap - rest * n, first + full, 1)
                full, rest = full + 1, 0
            open_gap(gap, first + full, many - full)
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the pieces of tokenized_pieces(); other columns are carried along.

    Ranks of a length are made global by adding the number of its pieces in earlier blocks, a table
    of at most capacity rows per block.
    """
    per = pieces.groupBy("block", "length").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("_n")).collect()}  # at most capacity rows
    segments = pd.DataFrame(plan_sequences(histogram, capacity), columns=["length", "n", "first", "each", "offset"], dtype=np.int64)
    segments["till"] = segments.groupby("length").n.cumsum()
    by_length = {int(n): g[["till", "n", "first", "each", "offset"]].to_numpy(np.int64) for n, g in segments.groupby("length")}
    plan = pieces.sparkSession.sparkContext.broadcast(by_length)  # bounded by the capacity
    base = per.select("block", "length", (F.sum("_n").over(Window.partitionBy("length").orderBy("block")) - F.col("_n")).alias("_base"))
    keep = [c for c in pieces.columns if c not in ("block", "rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = plan.value
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths):
                own = np.flatnonzero(lengths == n)
                seg = by[int(n)]
                at = seg[np.searchsorted(seg[:, 0], ranks[own], side="right")]
                inside = ranks[own] - (at[:, 0] - at[:, 1])
                sequence[own] = at[:, 2] + inside // at[:, 3]
                offset[own] = at[:, 4] + inside % at[:, 3] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    ranked = pieces.join(base, ["block", "length"]).select(*keep, (F.col("rank") + F.col("_base")).alias("_rank"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in keep)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (binary, the pieces in order of offset), n_tokens, and the pieces' lengths.

    A sequence holds at most its capacity of tokens, so its group is bounded.
    """
    part = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("_p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(part.alias("_p"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", joined.alias("ids"), "n_tokens", F.col("_p.length").alias("lengths")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Nulls, empty texts and repeated rows as in tokenized_pieces(); other columns are left out, whatever
    their names; no rows give no rows.
    """
    placed = place(tokenized_pieces(docs, capacity, digest=True), capacity)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


