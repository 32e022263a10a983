"""Trie of conversation prefixes: union-find over the common prefixes of sorted neighbours.

Conversations are sorted by their turns (a digest a turn), so that those with a common prefix are
neighbours. Edges between neighbours are taken by the length of their common prefix, deepest first;
every merge of two components makes a branching node, and a component is closed when it becomes a
child. A batch of sorted rows gives a forest in which only the nodes on its first and last row's
way to the root can have members beyond the batch. The rest is written out, the two open ways are
all that is kept, and forests are merged across their boundary, first within a partition as its
batches go by, then those of the partitions, one row each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .mixing import word_count

#: A head is taken from the conversation whose id is a multiple of this; bytes of a turn's digest.
HEADS, WIDTH = 20, 16
#: Sorted rows that make one forest at a time.
STEP_ROWS = 4096
#: Names of open nodes (a few for each partition) that are broadcast; more are joined by a shuffle.
BROADCAST_NAMES = 1 << 16
#: Rows that leave a task: nodes, names of nodes, digits of ends, and the open ways of a partition.
_COLUMNS = {
    "conv_id": "long", "depth": "long", "parent_conv_id": "long", "parent": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long",
    "ends_sha256": "string", "ends_key": "binary", "kind": "string", "name": "long", "first": "long", "digits": "string", "part": "long", "forest": "string",
}
_NAMES = list(_COLUMNS)
_ROWS = ", ".join(f"{name} {kind}" for name, kind in _COLUMNS.items())
_ARROW = pa.schema([(name, {"string": pa.string(), "binary": pa.binary()}.get(kind, pa.int64())) for name, kind in _COLUMNS.items()])


_EMPTY = hashlib.sha256(b"").hexdigest()


class Component:
    """Conversations that share their first `depth` turns, with the sums over its closed children."""

    __slots__ = ("depth", "seq", "words", "left", "right", "n", "least", "kids", "leaves", "saved", "ends", "ends_key", "open", "waiting", "names")

    def __init__(self, depth: int, seq: bytes, words, left: bool, right: bool):
        self.depth, self.seq, self.words, self.left, self.right = depth, seq, words, left, right
        self.n = self.kids = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.ends_key: bytes | None = None
        self.open: list[Component] = []
        self.waiting: list[list] = []  # rows of children that lack the name of this node
        self.names: list[int] = []  # numbers under which rows already written know this node

    def count(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def absorb(self, other: Component) -> None:
        """The same node, seen from the rows after this one's."""
        self.count(other.n, other.least)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends += other.ends
        self.ends_key = self.ends_key or other.ends_key
        self.open += other.open
        self.waiting += other.waiting
        self.names += other.names


def common_turns(a: bytes, b: bytes) -> int:
    """Number of turns that two sequences of digests share from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """Open ways of a stretch of sorted rows, and what leaves it: node rows, names of nodes, digits of ends."""

    def __init__(self, number: int = 0):
        self.root: Component | None = None
        self.first = self.last = b""
        self.nodes: list[list] = []
        self.names: list[tuple[int, int]] = []
        self.ends: list[tuple[bytes, int, str]] = []
        self.next_name = number << 40

    def close(self, c: Component, parent: Component | None) -> None:
        """Write the nodes of a whole component, from its own depth up to below its parent's."""
        digest = None
        if c.ends_key is None:
            digest = hashlib.sha256(",".join(map(str, c.ends)).encode()).hexdigest()
        elif c.ends:
            self.write_ends(c)
        leaves, saved, kids, key = c.leaves if c.kids else 1, c.saved, c.kids, c.ends_key
        for row in c.waiting:
            row[2] = c.least
        self.nodes += c.waiting
        self.names += [(name, c.least) for name in c.names]
        top = parent.depth + 1 if parent else 0
        for depth in range(c.depth, top - 1, -1):
            if depth:
                saved += (c.n - 1) * int(c.words[depth - 1])
            row = [c.least, depth, c.least if depth > top else None, None, c.n, kids, leaves, saved, digest, key]
            kids, digest, key = 1, _EMPTY, None
            if depth > top or not parent:
                self.nodes.append(row)
        if parent:
            parent.count(c.n, c.least)
            parent.kids += 1
            parent.leaves += leaves
            parent.saved += saved
            parent.waiting.append(row)

    def write_ends(self, c: Component) -> None:
        if c.ends_key is None:
            c.ends_key = hashlib.md5(c.seq[: c.depth * WIDTH] + b"%d" % c.depth).digest()
        self.ends.append((c.ends_key, c.ends[0], ",".join(map(str, c.ends))))
        c.ends = []

    def add(self, seqs: list[bytes], words: list, ids: list[int]) -> None:
        """Take in the next sorted rows: deepest edges first, then the boundary to the rows before."""
        n = len(ids)
        shared = [common_turns(seqs[i], seqs[i + 1]) for i in range(n - 1)]
        of = list(range(n))
        comps = []
        for i in range(n):
            c = Component(len(seqs[i]) // WIDTH, seqs[i], words[i], not i, i == n - 1)
            c.count(1, ids[i])
            c.ends = [ids[i]]
            comps.append(c)

        def find(i: int) -> int:
            while of[i] != i:
                of[i] = of[of[i]]
                i = of[i]
            return i

        for i in np.argsort(-np.asarray(shared, np.int64), kind="stable").tolist():
            # rows are sorted, so a component is a stretch of rows; its root is the first of them
            a, b = find(i), find(i + 1)
            comps[a] = self.merged(comps[a], comps[b], shared[i])
            comps[b] = None
            of[b] = a
        self.join(self.rooted(comps[0]), seqs[0], seqs[-1])

    def merged(self, a: Component, b: Component, depth: int) -> Component:
        if a.depth == depth == b.depth:
            a.left, a.right = a.left or b.left, a.right or b.right
            a.absorb(b)
            return a
        if a.depth > depth and b.depth > depth:
            up = Component(depth, a.seq, a.words, a.left, b.right)
            self.attach(a, up)
            self.attach(b, up)
            return up
        up, child = (a, b) if a.depth == depth else (b, a)
        self.attach(child, up)
        up.left, up.right = a.left or b.left, a.right or b.right
        return up

    def attach(self, child: Component, parent: Component) -> None:
        if child.left or child.right:
            parent.open.append(child)
        else:
            self.close(child, parent)

    @staticmethod
    def rooted(c: Component) -> Component:
        return c if not c.depth else Forest.above(c, 0)

    @staticmethod
    def above(c: Component, depth: int) -> Component:
        """A node on the way from c to the root, with c as its open child."""
        up = Component(depth, c.seq, c.words, c.left, c.right)
        up.open = [c]
        return up

    def join(self, root: Component, first: bytes, last: bytes) -> None:
        """Merge the forest of the rows that follow, which is rooted at depth 0."""
        if self.root is None:
            self.root, self.first, self.last = root, first, last
            return
        shared = common_turns(self.last, first)
        f, g, way = self.root, root, []
        while True:
            below_f = next((c for c in f.open if c.right), None)
            below_g = next((c for c in g.open if c.left), None)
            f.open = [c for c in f.open if c is not below_f]
            g.open = [c for c in g.open if c is not below_g]
            f.absorb(g)
            f.right = g.right
            way.append(f)
            if f.depth == shared:
                break
            depth = min(shared, below_f.depth, below_g.depth)
            f = below_f if below_f.depth == depth else self.above(below_f, depth)
            g = below_g if below_g.depth == depth else self.above(below_g, depth)
        for child, side in ((below_f, "right"), (below_g, "left")):
            if child is not None:
                self.retire(child, side)
                self.attach(child, f)
        for child, parent in zip(way[:0:-1], way[-2::-1]):
            self.attach(child, parent)
        self.last = last

    def retire(self, c: Component, side: str) -> None:
        """Nothing can join this side of a component any more: close what is whole below it."""
        way = [c]
        while (below := next((x for x in way[-1].open if getattr(x, side)), None)) is not None:
            way.append(below)
        for x in way:
            setattr(x, side, False)
        for child, parent in zip(way[:0:-1], way[-2::-1]):
            if not (child.left or child.right):
                parent.open.remove(child)
                self.close(child, parent)

    def spread(self) -> list[Component]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            c = todo.pop()
            out.append(c)
            todo += c.open
        return out

    def settle(self) -> None:
        """Let go of what an open node holds for others: rows of its children, ids of its ends."""
        for c in self.spread():
            if c.waiting:
                if not c.names:
                    c.names.append(self.next_name)
                    self.next_name += 1
                for row in c.waiting:
                    row[3] = c.names[0]
                self.nodes += c.waiting
                c.waiting = []
            if c.ends:
                self.write_ends(c)

    def finish(self) -> None:
        if self.root is not None:
            self.retire(self.root, "left")
            self.retire(self.root, "right")
            self.close(self.root, None)
            self.root = None

    def packed(self) -> str:
        """The open ways as lists and numbers: every open node is a prefix of the first or the last row."""
        everything = self.spread()
        at = {id(c): i for i, c in enumerate(everything)}
        deep = {side: max((c for c in everything if getattr(c, side)), key=lambda c: c.depth) for side in ("left", "right")}
        ways = {side: [int(w) for w in c.words[: c.depth]] for side, c in deep.items()}
        rows = [[c.depth, c.left, c.right, c.n, c.least, c.kids, c.leaves, c.saved, c.ends_key and c.ends_key.hex(), c.names, [at[id(x)] for x in c.open]] for c in everything]
        return json.dumps([self.first.hex(), self.last.hex(), ways["left"], ways["right"], rows])

    def join_packed(self, data: str) -> None:
        """Merge the open ways of the next partition."""
        first, last, left_words, right_words, rows = json.loads(data)
        first, last = bytes.fromhex(first), bytes.fromhex(last)
        out = []
        for depth, left, right, n, least, kids, leaves, saved, key, names, _ in rows:
            c = Component(depth, first if left else last, left_words if left else right_words, left, right)
            c.n, c.least, c.kids, c.leaves, c.saved, c.names = n, least, kids, leaves, saved, names
            c.ends_key = bytes.fromhex(key) if key else None
            out.append(c)
        for c, row in zip(out, rows):
            c.open = [out[i] for i in row[-1]]
        self.join(out[0], first, last)


def _written(forest: Forest, part: int | None = None) -> pa.RecordBatch:
    """Rows of what has left a forest, and of the forest itself where it is done."""
    rows = [dict(zip(_NAMES, r), kind="node") for r in forest.nodes]
    rows += [{"kind": "name", "name": name, "conv_id": least} for name, least in forest.names]
    rows += [{"kind": "ends", "ends_key": key, "first": first, "digits": digits} for key, first, digits in forest.ends]
    forest.nodes, forest.names, forest.ends = [], [], []
    if part is not None and forest.root is not None:
        rows.append({"kind": "forest", "part": part, "forest": forest.packed()})
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a partition of sorted rows, and its open ways."""
    part = TaskContext.get().partitionId()
    forest = Forest(part)
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            some = batch.slice(at, STEP_ROWS)
            forest.add(some.column("seq").to_pylist(), some.column("words").to_pylist(), some.column("conv_id").to_pylist())
            forest.settle()
            yield _written(forest)
    yield _written(forest, part)


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that cross partitions, from the open ways of the partitions in order."""
    forest = Forest(1 << 22)
    for batch in batches:
        for data in batch.column("forest").to_pylist():
            forest.join_packed(data)
            forest.settle()
            yield _written(forest)
    forest.finish()
    yield _written(forest)


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each key's digits in order, as they stream by."""
    schema = pa.schema([("ends_key", pa.binary()), ("ends_sha256", pa.string())])
    key, held = None, hashlib.sha256()
    for batch in batches:
        out = []
        for k, digits in zip(batch.column("ends_key").to_pylist(), batch.column("digits").to_pylist()):
            if k != key:
                if key is not None:
                    out.append({"ends_key": key, "ends_sha256": held.hexdigest()})
                key, held = k, hashlib.sha256(digits.encode())
            else:
                held.update(b"," + digits.encode())
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"ends_key": key, "ends_sha256": held.hexdigest()}], schema=schema)


def rebuilt(conversations: DataFrame, every: int = HEADS, most: int = 3) -> DataFrame:
    """conv_id, seq (digests of its turns, one after the other) and words (of each turn) of rebuilt conversations.

    Rows of conv_id, turn, role and text; rows are ordered by turn, a null turn first, rows of one
    turn by the digest of role and text (equal rows stay turns of their own); a null role or text
    is empty; rows without conv_id are left out. The first h turns (h: crc32 of the id, modulo
    most + 1) come from the conversation whose id is the next multiple of `every` towards 0. Texts
    leave the first task only as digests of 16 bytes, and a conversation's digests are one row.
    Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", digest.alias("digest"), word_count(text).alias("words")).alias("t"))
    own = stored(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")), "trie-conversations")
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_head"), F.slice("own", 1, most).alias("head"))
    joined = own.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("_head"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    head = F.when(F.col("head").isNull(), F.slice("own", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    turn = F.concat(head, F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0))))
    out = joined.select("conv_id", turn.alias("t"))
    return out.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("seq"), F.col("t.words").alias("words"))


def trie(sequences: DataFrame) -> DataFrame:
    """Every node of the trie over rows of conv_id (long, each once), seq (16 bytes a turn) and words (array of long).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 as the registered query has them. The root has no parent; a
    conversation without turns ends there; repeated conversations share all their nodes. No rows
    give no nodes.
    """
    kept = stored(sequences.select("conv_id", "seq", "words"), "trie-rebuilt")
    ordered = kept.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    parts = stored(ordered.mapInArrow(_grow, _ROWS), "trie-parts")
    # one row for each partition
    ways = parts.where("kind = 'forest'").select("part", "forest").repartition(1).sortWithinPartitions("part")
    across = stored(ways.mapInArrow(_join_parts, _ROWS), "trie-across")
    rows = parts.where("kind <> 'forest'").unionByName(across)
    node = rows.where("kind = 'node'").select(*_NAMES[:10])
    names = rows.where("kind = 'name'").select(F.col("name").alias("parent"), F.col("conv_id").alias("_parent"))
    ends = rows.where("kind = 'ends'").select("ends_key", "first", "digits").repartition("ends_key").sortWithinPartitions("ends_key", "first")
    digests = ends.mapInArrow(_digest_ends, "ends_key binary, ends_sha256 string")
    if names.count() <= BROADCAST_NAMES:
        names = F.broadcast(names)
    named = node.where(F.col("parent").isNotNull()).join(names, "parent").withColumn("parent_conv_id", F.col("_parent")).drop("_parent")
    whole = node.where(F.col("parent").isNull()).unionByName(named)
    late = whole.where(F.col("ends_key").isNotNull()).drop("ends_sha256").join(digests, "ends_key")
    return whole.where(F.col("ends_key").isNull()).unionByName(late).drop("ends_key", "parent")


def report(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations; see `rebuilt` for nulls, ties and repeated rows."""
    return trie(rebuilt(conversations))
