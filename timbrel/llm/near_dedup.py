"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of five-word shingles: occurrences times a smoothed inverse document
frequency.  Consistent weighted samples agree between two texts with probability equal to their
weighted Jaccard similarity; bands of samples bring candidates together, and every candidate pair is
verified by the exact weighted Jaccard similarity of the whole texts.

Copies are first reduced to their text.  In a bucket each text is compared with the bucket's first
one, so a bucket of m alike texts costs m comparisons.  Buckets whose texts are then still in several
classes are compared in full, block by block: all similarities of a few hundred texts are one matrix
product, and a block gives at most one link per text, so no rows of pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, steps, stored
from .shingles import shingles

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
#: Document frequencies are counted in this many hashed buckets (2 to the power), as hashing TF-IDF does.
DF_BITS = 18
#: A block of a bucket holds about this many texts, and shingles.
BLOCK, BLOCK_WEIGHT = 512, 1_000_000
#: Columns of a block's matrix that are multiplied at a time.
COLUMNS = 2048
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SCALE = np.float32(2.0**-32)


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of each hashed bucket of shingles: 1 if all documents have it, 2 if one has.

    Counted over all documents.  The result is an array of 2 ** DF_BITS numbers whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in steps(texts):
                own = [h for h, _ in shingles(texts[a:b], SHINGLE)]
                found += np.bincount((np.concatenate(own) >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=1 << DF_BITS)
            n += len(texts)
        if n:
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = float(counted.n[counted.bucket == -1].sum())
    out = np.full(1 << DF_BITS, 2.0)
    own = counted[counted.bucket >= 0]
    if n > 1:
        out[own.bucket.to_numpy()] = 1 + np.log(n / np.minimum(own.n.to_numpy(), n)) / np.log(n)
    return out.astype(np.float32)


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts.astype(np.float32) * idf[(hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)]


def samples(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Consistent weighted samples of a weighted set, 32 bits each; equal with the probability of the weighted Jaccard similarity."""
    best = np.full(len(_SEEDS), np.inf, np.float32)
    out = np.zeros(len(_SEEDS), np.uint64)
    lanes = np.arange(len(_SEEDS))
    for a in range(0, len(hashes), 1024):
        h, log_w = hashes[a : a + 1024], np.log(weight[a : a + 1024])[:, None]
        x = mix(h[:, None] ^ _SEEDS)
        low = np.uint64(0xFFFFFFFF)

        def uniform(bits: np.ndarray) -> np.ndarray:
            return (bits.astype(np.float32) + np.float32(0.5)) * _SCALE

        r = -np.log(uniform(x >> np.uint64(32)) * uniform(x & low))
        np.maximum(r, np.float32(1e-6), out=r)
        x = mix(x + np.uint64(1))
        c = -np.log(uniform(x >> np.uint64(32)) * uniform(x & low))
        np.maximum(c, np.float32(1e-12), out=c)
        shift = uniform(mix(x + np.uint64(1)) >> np.uint64(32))
        step = np.floor(log_w / r + shift)
        key = np.log(c) - r * (step - shift) - r
        at = key.argmin(axis=0)
        value = key[at, lanes]
        better = value < best
        best[better] = value[better]
        won = mix(h[at] ^ (step[at, lanes].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        out[better] = won[better]
    return (out & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, id (digest of the text), weight, bands (keys of the samples; none for a text without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # 2 ** DF_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in steps(texts):
                total, keys = [], []
                for h, n in shingles(texts[a:b], SHINGLE):
                    w = weights(h, n, shared.value)
                    total.append(float(w.sum(dtype=np.float64)))
                    if len(h):
                        s = samples(h, w)
                        k = np.arange(BANDS, dtype=np.uint64)
                        for row in range(ROWS):
                            k = mix(k + s[row::ROWS].astype(np.uint64))
                        keys.append(k.view(np.int64).tolist())
                    else:
                        keys.append([])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("id"), pa.array(total, pa.float64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "id", "weight", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text", _text_key(F.col("text")).alias("id"))
    return rows.mapInArrow(run, "doc_id long, id binary, weight double, bands array<long>")


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Similarity of two weighted sets of ascending hashes."""
    _, i1, i2 = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    common = float(np.minimum(w1[i1], w2[i2]).sum(dtype=np.float64))
    return common / (float(w1.sum(dtype=np.float64)) + float(w2.sum(dtype=np.float64)) - common)


def texts_of(needed: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """id and text of the needed ids."""
    needed = needed.join(texts.select("id", "doc_id"), "id")
    # one row of each text: the one with the smallest doc_id; copies go to other partitions and fall out
    own = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"), _text_key(F.col("text")).alias("_id"))
    found = own.join(needed, (own._id == needed.id) & own._doc.eqNullSafe(needed.doc_id))
    return found.groupBy("id", "doc_id").agg(F.first("text").alias("text")).select("id", "text")


def similar(pairs: DataFrame, docs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Those pairs (a, b of text digests) whose weighted Jaccard similarity is SIMILARITY or more, with it."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # 2 ** DF_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            both = [batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()]
            value = []
            for i in range(len(a)):
                vectors = []
                for key, text in ((a[i], both[0][i]), (b[i], both[1][i])):
                    if key not in known:
                        if len(known) > 64:
                            known.clear()
                        h, n = shingles([text], SHINGLE)[0]
                        known[key] = h, weights(h, n, shared.value)
                    vectors.append(known[key])
                value.append(weighted_jaccard(*vectors[0], *vectors[1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value, pa.float64())], ["a", "b", "similarity"])

    found = stored(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, texts), "texts")
    with_b = pairs.join(found.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(found.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double").where(F.col("similarity") >= SIMILARITY)


def block_links(hashes: list[np.ndarray], counts: list[np.ndarray], roots: list[bytes], idf: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links (a, b) of roots that connect all texts of similarity SIMILARITY or more; at most one per text.

    The n-th occurrence of a shingle in a text is an element of its own with the shingle's weight, so
    the common weight of two texts is the sum over their common elements: a product of matrices.
    """
    size = len(hashes)
    label = np.unique(np.array(roots, dtype=object), return_inverse=True)[1] if size > 2 else np.array([0, int(roots[0] != roots[1])]) if size == 2 else np.zeros(1, int)
    if not label.any():
        return []
    lengths = [int(n.sum()) for n in counts]
    n = np.concatenate(counts)
    element = np.repeat(np.concatenate(hashes), n)
    value = idf[(element >> np.uint64(64 - DF_BITS)).astype(np.int64)].astype(np.float64)
    occurrence = (np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    again = occurrence > 0
    element[again] = mix(element[again] + mix(occurrence[again]))
    row = np.repeat(np.arange(size), lengths)
    total = np.bincount(row, value, size)
    _, first, column, found = np.unique(element, return_index=True, return_inverse=True, return_counts=True)
    # an element of a single text is common to no pair
    place = np.cumsum(found > 1) - 1
    shared = found[column] > 1
    row, column, value = row[shared], place[column[shared]], value[first][found > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((size, size))
    for a in range(0, len(value), COLUMNS):
        i, j = np.searchsorted(column, (a, a + COLUMNS))
        part = np.zeros((size, min(COLUMNS, len(value) - a)))
        part[row[i:j], column[i:j] - a] = 1
        common += (part * value[a : a + COLUMNS]) @ part.T
    similarity = common / (total[:, None] + total - common)
    linked = similarity >= SIMILARITY
    # rounding decides as it does for a single pair
    for x, y in zip(*np.nonzero(np.triu(np.abs(similarity - SIMILARITY) < 1e-6, 1)), strict=True):
        w = [weights(hashes[k], counts[k], idf) for k in (x, y)]
        linked[x, y] = linked[y, x] = weighted_jaccard(hashes[x], w[0], hashes[y], w[1]) >= SIMILARITY
    out = []
    # components of the block: texts of one root, or linked, share the smallest label
    now = label
    while True:
        least = np.where(linked, now, size).min(axis=1)
        new = np.minimum(now, least)
        by_root = np.full(size, size)
        np.minimum.at(by_root, label, new)
        new = by_root[label]
        if (new == now).all():
            break
        now = new
    name = dict(zip(label.tolist(), roots, strict=True))
    for old, to in {(o, t) for o, t in zip(label.tolist(), now.tolist(), strict=True) if o != t}:
        out.append((name[old], name[to]))
    return out


def compared(rows: DataFrame, docs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Links (a, b) between roots whose texts are similar, of all texts in one bucket.

    rows: band, key, id, weight, root.  Texts of a bucket's most frequent root need not meet each
    other; its blocks meet those of the other texts, and the latter meet among themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # 2 ** DF_BITS numbers
    schema = "id binary, hashes binary, counts binary"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = batch.column("text").to_pylist()
            for a, b in steps(all_texts):
                found = shingles(all_texts[a:b], SHINGLE)
                yield pa.RecordBatch.from_arrays(
                    [batch.slice(a, b - a).column("id"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary())], ["id", "hashes", "counts"]
                )

    def links(block: list[tuple]) -> list[tuple[bytes, bytes]]:
        return block_links([np.frombuffer(r[1], np.uint64) for r in block], [np.frombuffer(r[2], "<i4") for r in block], [r[0] for r in block], shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = None, []
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for key, row in zip(zip(*columns[:4], strict=True), zip(*columns[4:], strict=True), strict=True):
                if key != own:
                    if block:
                        out += links(block)
                    own, block = key, []
                block.append(row)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})
        if block:
            out = links(block)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    found = texts_of(rows.select("id").distinct(), docs, texts).mapInArrow(vectors, schema)
    sized = rows.groupBy("band", "key", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_WEIGHT)).cast("int")
    most = F.max(F.struct("n", "root", "w"))
    plan = sized.groupBy("band", "key").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w")).select(
        "band", "key", F.col("most.root").alias("most"), blocks(F.col("most.n"), F.col("most.w")).alias("n_most"), blocks(F.col("n") - F.col("most.n"), F.greatest(F.col("w") - F.col("most.w"), F.lit(1.0))).alias("n_rest"))
    is_most, chance = F.col("root") == F.col("most"), F.xxhash64("id")
    rest = F.pmod(chance, F.col("n_rest")).cast("int")
    at = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    # blocks of the most frequent root have negative numbers
    each_rest = F.sequence(F.lit(0), F.col("n_rest") - 1)
    meets = F.when(is_most, F.transform(each_rest, lambda i: at(i, -1 - F.pmod(chance, F.col("n_most"))))).otherwise(
        F.concat(F.transform(F.sequence(F.lit(1), F.col("n_most")), lambda j: at(rest, -j)), F.transform(F.filter(each_rest, lambda k: k != rest), lambda k: at(F.least(rest, k), F.greatest(rest, k)))))
    dealt = rows.join(plan, ["band", "key"]).select("band", "key", F.explode(meets).alias("m"), "id", "root").select("band", "key", "m.i", "m.j", "id", "root")
    keys = ["band", "key", "i", "j"]
    whole = dealt.join(found, "id").select(*keys, "root", "hashes", "counts")
    return whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """id and root, the smallest member of its connected component, for every end of links (a, b).

    Alternates the two star operations, each a minimum per node and a join; every round is stored.
    """
    edges = stored(links.where("a <> b").select("a", "b").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def text_classes(docs: DataFrame) -> DataFrame:
    """One row per different text: id, doc_id (its smallest), class_id (the smallest doc_id of its class)."""
    idf = inverse_frequencies(docs)
    sketched = stored(sketches(docs, idf), "sketches")
    texts = stored(sketched.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "texts")
    member = texts.select("id", "weight", F.posexplode("bands").alias("band", "key"))
    bucket = member.groupBy("band", "key").agg(F.min(F.struct("id", "weight")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    near = stored(member.join(bucket, ["band", "key"]).where(F.col("id") != F.col("hub.id")).select("band", "key", "id", "weight", "hub"), "members")

    # the smaller total over the larger one bounds the similarity
    alike = F.least("weight", "hub.weight") >= SIMILARITY * F.greatest("weight", "hub.weight")
    first = stored(near.where(alike).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    roots = stored(components(similar(first, docs, texts, idf)), "roots")
    # all have met the first text of their bucket; what is left in several classes is compared in full
    with_root = near.join(roots, "id", "left").select("band", "key", "id", "weight", F.coalesce("root", "id").alias("root"))
    several = with_root.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "key")
    rest = stored(with_root.join(several, ["band", "key"]), "open")
    more = stored(compared(rest, docs, texts, idf), "links")
    if not more.isEmpty():
        merged = components(more)
        # roots that were joined lead to their new root; texts without a class so far are their own
        moved = roots.join(merged.toDF("root", "new"), "root", "left").select("id", F.coalesce("new", "root").alias("root"))
        alone = merged.join(roots, "id", "left_anti")
        roots = stored(moved.unionByName(alone), "roots")
    grouped = texts.join(roots, "id", "left").select("id", "doc_id", F.coalesce("root", "id").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return stored(grouped.join(lowest, "root").select("id", "doc_id", "class_id"), "classes")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every document; near duplicates, copies and their chains share a class.

    The class_id is the smallest doc_id of the class (null if it has none).  Null text counts as
    empty; texts without words are alike only if they are equal.  Repeated rows share a class.
    Other columns are ignored; no documents give no rows.
    """
    # one row per text and doc_id on the right side, so the hot key of many copies is spread by doc_id
    found = text_classes(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(F.col("text")).alias("id"))
    return own.join(found.select("id", "class_id"), "id").select("doc_id", "class_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay: one row of each class, the one with the smallest doc_id; all columns as they were."""
    found = text_classes(docs)
    # a class without any doc_id keeps the text of smallest digest
    kept = found.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("id")).alias("_own")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("_k")).select("_k.doc_id", "_k.id")
    kept = kept.select(F.col("doc_id").alias("_doc"), F.col("id").alias("_id"))
    keyed = docs.withColumn("_key", _text_key(F.col("text")))
    joined = keyed.join(kept, (keyed["_key"] == kept["_id"]) & keyed["doc_id"].cast("long").eqNullSafe(kept["_doc"]))
    return joined.dropDuplicates(["_id", "_doc"]).select(*(F.col(f"`{c}`") for c in docs.columns))
