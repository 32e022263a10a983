"""Merkle manifest of a dataset as a postorder append log, with proofs addressed in closed form.

The leaves of a tree are numbered in order. A log that appends each node as soon as its last leaf
has come holds the node of height h whose last leaf is j at position 2j - popcount(j) + h, as
j leaves complete 2j - popcount(j) nodes. Builders therefore work apart: each takes an aligned
block of 2^ALIGNED nodes of one height, writes the nodes above them in completion order, and its
top nodes are the input of the next tier. A proof needs no search: the place of each sibling
follows from the sizes of the subtrees before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .prefix import BEFORE, TOTAL, prefix_sums

#: An aligned builder takes 2^ALIGNED nodes.
ALIGNED = 8


def position(last: int, height: int) -> int:
    """Place in the append log of the node of that height that leaf `last` completes."""
    return 2 * last - last.bit_count() + height


def _place(items: int, height: int, index: int) -> int:
    """Place of node `index` of a height among the nodes that a builder of so many items writes."""
    return position(min((index + 1) << height, items) - 1, height)


def _heights(items: int) -> int:
    return max(0, (items - 1).bit_length())


def _digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _build(items: list[str], heights: int) -> list[str]:
    """Nodes over some items in completion order; every two neighbours make one node, a last one alone makes one of itself."""
    out = [""] * (_place(len(items), heights, 0) + 1)
    level = items
    for h in range(heights + 1):
        for i, node in enumerate(level):
            out[_place(len(items), h, i)] = node
        level = [_digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return out


def _siblings(nodes: list[str], items: int, heights: int) -> list[list[str]]:
    """For each item the siblings on its way up: L or R and the digest, or nothing where the node is alone."""
    widths = [-(-items >> h) for h in range(heights)]
    out = []
    for i in range(items):
        own = []
        for h, width in enumerate(widths):
            at = (i >> h) ^ 1
            own.append(("RL"[at < i >> h] + nodes[_place(items, h, at)]) if at < width else "")
        out.append(own)
    return out


def _writer(names: list[str], tier: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                width = -(-row.column("n")[0].as_py() >> ALIGNED * tier)
                heights = min(ALIGNED, _heights(width))
                nodes = _build(row.column("items")[0].as_py(), heights)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([heights], pa.int32()), pa.array([nodes], pa.list_(pa.string()))], names=names)

    return run


def append_log(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Write the log of each tree: one stored table a tier, the leaves' tier first.

    leaves: tree (string, not null), i (long, place from 0), n (long, leaves of the tree), digest,
    row (any struct, kept with the leaf). A row of a tier is a builder's segment: tree, block, n,
    heights, items, rows (first tier) and nodes, the digests in completion order. A builder holds
    2^ALIGNED items whatever the size of a tree. No leaves give one tier without rows.
    """
    tiers: list[DataFrame] = []
    level, size = leaves, 1 << ALIGNED
    while True:
        parts = [F.col("i").alias("i"), F.col("digest").alias("digest"), *([F.col("row").alias("row")] if not tiers else [])]
        run = F.sort_array(F.collect_list(F.struct(*parts)))
        found = level.groupBy("tree", F.floor(F.col("i") / size).alias("block")).agg(F.max("n").alias("n"), run.alias("_run"))
        found = found.select("tree", "block", "n", F.col("_run.digest").alias("items"), *([F.col("_run.row").alias("rows")] if not tiers else []))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields) + ", heights int, nodes array<string>"
        tier = stored(found.mapInArrow(_writer([*found.columns, "heights", "nodes"], len(tiers)), schema), f"{name}-tier{len(tiers)}")
        tiers.append(tier)
        if tier.where(F.col("block") > 0).isEmpty():
            return tiers
        tops = tier.where(F.col("n") > 1 << ALIGNED * len(tiers))
        level = tops.select("tree", F.col("block").alias("i"), "n", F.element_at("nodes", -1).alias("digest"))


def roots(tiers: list[DataFrame]) -> DataFrame:
    """tree, n and root of each tree of a log."""
    found = [t.where(F.col("n") <= 1 << ALIGNED * (k + 1)) for k, t in enumerate(tiers)]
    found = [t if not k else t.where(F.col("n") > 1 << ALIGNED * k) for k, t in enumerate(found)]
    out = [t.select("tree", "n", F.element_at("nodes", -1).alias("root")) for t in found]
    for t in out[1:]:
        out[0] = out[0].unionByName(t)
    return out[0]


def log_entries(tiers: list[DataFrame]) -> DataFrame:
    """The log as rows: tree, position, height and digest of every node, each once."""

    def run(tier: int):
        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    at, m = r["block"] << ALIGNED, len(r["items"])
                    out = []
                    for h in range(bool(tier), r["heights"] + 1):
                        for i in range(-(-m >> h)):
                            top = tier * ALIGNED
                            last = min((at + min((i + 1) << h, m)) << top, r["n"]) - 1
                            out.append((r["tree"], position(last, top + h), top + h, r["nodes"][_place(m, h, i)]))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())], names=["tree", "position", "height", "digest"])

        return entries

    out = None
    for k, t in enumerate(tiers):
        d = t.select("tree", "block", "n", "heights", "items", "nodes").mapInArrow(run(k), "tree string, position long, height long, digest string")
        out = d if out is None else out.unionByName(d)
    return out


def _prover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.list_(pa.string()))
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            items = len(row.column("items")[0])
            found = _siblings(row.column("nodes")[0].as_py(), items, row.column("heights")[0].as_py())
            keep = [c for c in row.schema.names if c not in ("items", "nodes", "heights")]
            yield pa.RecordBatch.from_arrays([*[row.column(c) for c in keep], pa.array([found], kind)], names=[*keep, "proofs"])


def proofs(tiers: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """tree, row and siblings (from the leaf up) of every leaf; above (tree, siblings) continues each tree's proof.

    A sibling is L or R (its side) and its digest, or empty where the node had none. Every segment
    answers for its own items, and the way above it is joined once a segment, not once a leaf.
    """
    way = above.select("tree", F.col("siblings").alias("_above")) if above is not None else None
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        keep = ["tree", "block", "rows"] if not k else ["tree", "block"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tier.schema.fields if f.name in keep) + ", proofs array<array<string>>"
        own = tier.select(*keep, "heights", "items", "nodes").mapInArrow(_prover, schema)
        if k < len(tiers) - 1:
            own = own.join(higher, ["tree", "block"], "left")
        else:
            own = own.withColumn("_higher", F.lit(None).cast("array<string>"))
        if way is not None:
            own = own.join(way, "tree", "left")
            own = own.withColumn("_higher", F.coalesce("_higher", "_above")).drop("_above")
        rest = F.coalesce("_higher", F.array().cast("array<string>"))
        if not k:
            got = own.select("tree", F.explode(F.arrays_zip("rows", "proofs")).alias("p"), rest.alias("_rest"))
            return got.select("tree", F.col("p.rows").alias("row"), F.concat("p.proofs", "_rest").alias("siblings"))
        got = own.select("tree", F.col("block").alias("_up"), F.posexplode("proofs").alias("_j", "_own"), rest.alias("_rest"))
        higher = got.select("tree", (F.col("_up") * (1 << ALIGNED) + F.col("_j")).alias("block"), F.concat("_own", "_rest").alias("_higher"))
    raise ValueError("a log has at least one tier")


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def up(node: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(F.startswith(s, F.lit("L")), F.concat(other, node)).when(F.startswith(s, F.lit("R")), F.concat(node, other)).otherwise(node), 256)

    return F.aggregate(siblings, leaf, up)


def _sized(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of one document: each value with its byte count before it, a null as a single sign."""
    return F.sha2(F.concat(*[_sized(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def _root(spark: SparkSession, tree: DataFrame) -> str | None:
    found = tree.select("root").first()
    return found["root"] if found else None


def manifest(docs: DataFrame, kept: dict[str, Column] | None = None) -> tuple[list[DataFrame], list[DataFrame], str | None]:
    """Logs of the language trees and of the tree over their roots, and the root of all (null for no rows).

    Columns used: doc_id, source, lang, n_chars, text; kept names more values to carry with a leaf.
    A null lang is the first tree, languages go by their bytes; in a tree a null doc_id comes
    first, and rows of one doc_id go by their digest (equal rows are leaves of their own). Nulls
    and empty texts have digests of their own kind. Other columns of docs are not read.
    """
    lang = F.col("lang")
    one = docs.select(
        F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang)).alias("tree"), F.col("doc_id"),
        leaf_digest(F.col("doc_id"), F.col("source"), lang, F.col("n_chars"), F.col("text")).alias("digest"),
        *[c.alias(k) for k, c in (kept or {}).items()], F.lit(1).cast("long").alias("_one"),
    )
    placed = prefix_sums(one, "tree", ["doc_id", "digest"], "_one", "merkle")
    row = F.struct("doc_id", F.col("digest").alias("leaf"), *(kept or {}))
    tiers = append_log(placed.select("tree", F.col(BEFORE).alias("i"), F.col(TOTAL).alias("n"), "digest", row.alias("row")), "merkle")
    subs = roots(tiers).select(F.lit("").alias("_all"), F.col("tree").alias("_lang"), F.col("root").alias("digest"), F.lit(1).cast("long").alias("_one"))
    ranked = prefix_sums(subs, "_all", ["_lang"], "_one", "merkle-top")
    top = append_log(ranked.select(F.lit("").alias("tree"), F.col(BEFORE).alias("i"), F.col(TOTAL).alias("n"), "digest", F.struct("_lang", "digest").alias("row")), "merkle-top")
    return tiers, top, _root(docs.sparkSession, roots(top))


def report(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """The proof of every document, and its check where n_chars of some documents was tampered with.

    Tampered are documents with a doc_id whose unsigned crc32 of the decimal form is divisible by
    modulus: their leaf is made again with n_chars + 1 (a null stays null, and a doc_id of null is
    never tampered with). One row per row of docs, equal rows included; no rows give no rows.
    """
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    changed = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0)
    tampered = F.when(changed, leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars + 1, F.col("text")))
    tiers, top, root = manifest(docs, {"tampered": tampered})
    over = proofs(top).select(F.col("row._lang").alias("tree"), F.col("row.digest").alias("subroot"), "siblings")
    over = stored(over, "merkle-over")
    found = proofs(tiers, over).join(over.select("tree", "subroot"), "tree")
    siblings = F.filter("siblings", lambda s: s != "")
    out = found.select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.leaf").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        F.sha2(F.array_join(F.transform(siblings, lambda s: F.substring(s, 2, 64)), ""), 256).alias("proof_sha256"),
        folded(F.coalesce("row.tampered", "row.leaf"), F.col("siblings")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
