"""Approximate nearest neighbours by balanced posting lists.

A bounded sample of the vectors is split into balanced clusters; their centroids form a graph that a
best-first search walks in memory.  Every vector is put into the list of its nearest centroid and, if
it lies near the boundary, of others about as near.  A query visits the lists whose centroids are not
much farther than its nearest.  Lists are cut into blocks of bounded size, and queries meet lists
block by block, so a hot list is spread over tasks.

Nearness is the inner product.  Vectors get one more component that makes all norms equal to the
largest, after which the largest inner product is the smallest distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors that the centroids are fitted on, about; the index itself holds every vector.
SAMPLE = 20_000
#: Sampled vectors of a cluster.
CLUSTER = 80
#: A vector goes to each centroid whose distance is at most this many times its least, of the nearest REPLICAS.
BOUNDARY, REPLICAS = 1.15, 4
#: A query visits each list whose centroid's distance is at most this many times its least, of the BEAM found by the graph.
PRUNE, BEAM = 1.13, 256
#: Neighbours of a centroid in the graph.
DEGREE = 24
#: Vectors of a block of a list, and queries of a block.
BLOCK = 2048


def balanced_centroids(x: np.ndarray, size: int = CLUSTER) -> np.ndarray:
    """Centroids by halving: each part is split by 2-means at the median of its margin, so the parts differ by one at most."""
    parts, done = [np.arange(len(x))], []
    rng = np.random.default_rng(5)
    while parts:
        own = parts.pop()
        if len(own) <= size:
            done.append(own)
            continue
        v = x[own]
        a, b = v[rng.integers(len(own))], None
        b = v[((v - a) ** 2).sum(1).argmax()]
        for _ in range(6):
            margin = v @ (b - a) - (b @ b - a @ a) / 2
            right = margin > np.median(margin)
            if right.all() or not right.any():
                break
            a, b = v[~right].mean(0), v[right].mean(0)
        order = np.argsort(v @ (b - a), kind="stable")
        half = len(own) // 2
        parts += [own[order[:half]], own[order[half:]]]
    return np.stack([x[own].mean(0) for own in done]) if len(x) else x


@dataclass
class Graph:
    """Centroids and for each the numbers of its near ones; entries are where a search begins."""

    centroids: np.ndarray
    near: np.ndarray
    entries: np.ndarray

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest centroids found for each row and their distances, nearest first (infinite where none)."""
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        squares = (self.centroids**2).sum(1)
        own = (x**2).sum(1)[:, None]

        def distance(at: np.ndarray) -> np.ndarray:
            return own + squares[at] - 2 * np.einsum("ij,ikj->ik", x, self.centroids[at])

        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k), bool)
        at = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        seen[rows, at] = True
        dist, open_ = distance(at), np.ones(at.shape, bool)
        width = 4
        while True:
            keep = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            at, dist, open_ = at[rows, keep], dist[rows, keep], open_[rows, keep]
            if not open_.any():
                return at, np.sqrt(np.maximum(dist, 0))
            first = np.argsort(~open_, axis=1, kind="stable")[:, :width]
            live = open_[rows, first] & np.isfinite(dist[rows, first])
            open_[rows, first] = False
            more = self.near[at[rows, first]].reshape(n, -1)
            fresh = ~seen[rows, more] & np.repeat(live, self.near.shape[1], axis=1)
            order = np.argsort(more, axis=1, kind="stable")
            ranked = more[rows, order]
            same = np.zeros_like(fresh)
            same[rows, order[:, 1:]] = (ranked[:, 1:] == ranked[:, :-1])
            fresh &= ~same
            row, place = np.nonzero(fresh)
            seen[row, more[row, place]] = True
            gap = np.where(fresh, distance(more), np.inf)
            at, dist, open_ = np.concatenate([at, more], 1), np.concatenate([dist, gap], 1), np.concatenate([open_, fresh], 1)


def build_graph(centroids: np.ndarray) -> Graph:
    """Each centroid linked to its nearest ones and, so that all are reached, to its follower in a ring."""
    k = len(centroids)
    degree = min(DEGREE, max(1, k - 1))
    near = np.zeros((k, degree + 1), np.int64)
    for a in range(0, k, 1024):
        d = ((centroids[a : a + 1024, None, :] - centroids[None, :, :]) ** 2).sum(2) if k <= 512 else -2 * centroids[a : a + 1024] @ centroids.T + (centroids**2).sum(1)
        near[a : a + 1024, :degree] = np.argsort(d, axis=1, kind="stable")[:, 1 : degree + 1] if k > 1 else 0
    near[:, degree] = (np.arange(k) + 1) % k
    return Graph(centroids, near, np.unique(np.linspace(0, k - 1, min(k, 16)).astype(np.int64)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def _usable(v: Column) -> Column:
    """Not null, not zero, and all components finite."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where queries holds, its k nearest other rows found.

    Nearest first by inner product in double precision, ties to the smaller id.  Vectors that are null,
    zero, of another length than the most frequent one, or hold null or non-finite components take no
    part, nor do rows without an id; repeated rows of one id and vector count once.  Equal vectors are
    searched once, for the k + 1 smallest ids can be the only ones in a result.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    width = widths[0][0]
    rows = stored(rows.where(F.size("v") == width).groupBy("vec_id", "v").agg(F.max(F.coalesce("asks", F.lit(False))).alias("asks")), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    copies = rows.select("vec_id", "v").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    # a different vector by its smallest id; the ids of its copies that can be in a result
    kept = stored(copies.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("u"), "ids", "v"), "different")
    asked = rows.where("asks").select("vec_id", "v").join(kept.select("u", F.col("v").alias("_v")), F.col("v") == F.col("_v")).select("vec_id", "u")
    asked = stored(asked, "asked")

    n = kept.count()
    norm = kept.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    held = kept.sample(min(1.0, SAMPLE / n), seed=3).select("v").toPandas()
    sample = np.stack(held.v.to_list()) if len(held) else np.zeros((0, width))
    if not len(sample):
        sample = np.array([kept.first()["v"]])

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))])

    graph = spark.sparkContext.broadcast(build_graph(balanced_centroids(lifted(sample))))  # at most 2 * SAMPLE / CLUSTER centroids

    def lists(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 1024):
                    batch = whole.slice(a, 1024)
                    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    raised = np.column_stack([x, np.zeros(len(x))]) if query else lifted(x)
                    at, d = graph.value.search(raised, BEAM)
                    if query:  # distance to centroids of the raised space, up to the query's own length
                        ok = d <= PRUNE * d[:, :1] + 1e-12
                    else:
                        ok = d <= BOUNDARY * d[:, :1] + 1e-12
                        ok[:, REPLICAS:] = False
                    row, place = np.nonzero(ok)
                    data = np.ascontiguousarray(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at[row, place]), batch.column("u").take(pa.array(row)), pa.array([data[i].tobytes() for i in row.tolist()], pa.binary())], ["list", "u", "v"]
                    )
        return run

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(x, "<f8").tobytes() for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("list").cast(pa.int64()), batch.column("u"), pa.array(data, pa.binary())], ["list", "u", "v"])

    kinds = "list long, u long, v binary"
    posting = kept.select("u", "v").mapInArrow(lists(False), kinds)
    seeking = asked.select("u").distinct().join(kept.select("u", "v"), "u").mapInArrow(lists(True), kinds)

    def blocks(table: DataFrame, name: str) -> DataFrame:
        """Blocks of at most about BLOCK vectors: hashed parts of a list, as many as its size asks for."""
        table = stored(table, name)
        sizes = table.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
        dealt = table.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")))
        return dealt.groupBy("list", "part").agg(F.collect_list(F.struct("u", "v")).alias("b")).select("list", F.col("b.u").alias("u"), F.col("b.v").alias("v"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qu, u = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("qu", "u"))
                q, x = (_matrix(batch.column(c)[i].values, width) for c in ("qv", "v"))
                for a in range(0, len(q), 256):
                    s = q[a : a + 256] @ x.T
                    m = min(k + 1, len(u))
                    cut = np.partition(s, len(u) - m, axis=1)[:, len(u) - m]
                    row, place = np.nonzero(s >= cut[:, None] - 1e-12 * np.abs(cut[:, None]))
                    exact = np.einsum("ij,ij->i", q[a + row], x[place])  # one way of summing, whatever the block
                    yield pa.RecordBatch.from_arrays([pa.array(qu[a + row]), pa.array(u[place]), pa.array(exact)], ["qu", "u", "score"])

    held_lists = blocks(posting, "posting")

    def top(seeking_: DataFrame) -> DataFrame:
        """The k + 1 best different vectors of each different query; they are enough, as each stands for one id at least."""
        met = blocks(seeking_, "seeking").select("list", F.col("u").alias("qu"), F.col("v").alias("qv")).join(held_lists, "list")
        found = met.mapInArrow(best, "qu long, u long, score double").groupBy("qu", "u").agg(F.max("score").alias("score"))
        order = Window.partitionBy("qu").orderBy(F.desc("score"), "u")
        return stored(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n"), "top")

    def by_id(best_: DataFrame) -> DataFrame:
        """The k + 1 nearest ids of each different query, in order."""
        opened = best_.join(kept.select("u", "ids"), "u").select("qu", "score", F.explode("ids").alias("vec_id"))
        order = Window.partitionBy("qu").orderBy(F.desc("score"), "vec_id")
        short = opened.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
        return short.groupBy("qu").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("f"))

    listed = stored(by_id(top(seeking)), "listed")
    # queries whose lists held too few vectors visit every list
    few = listed.where(F.size("f") <= k)
    if not few.isEmpty():
        everywhere = F.explode(F.array(*map(F.lit, range(len(graph.value.centroids)))))
        again = few.select(F.col("qu").alias("u")).join(kept.select("u", "v"), "u").select(everywhere.alias("list"), "u", "v").mapInArrow(as_bytes, kinds)
        listed = listed.where(F.size("f") > k).unionByName(by_id(top(again)))
    own = asked.join(listed, asked["u"] == listed["qu"]).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("f", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("f"))
    out = own.select("query_id", F.posexplode("f").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def report(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
