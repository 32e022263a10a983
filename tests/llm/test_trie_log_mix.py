"""Prefix trie, Merkle log and mixing against brute force, on edge cases and on no rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.compare import compare, connect
from timbrel.llm import merkle, mixing, prefix_trie
from timbrel.llm.prefix import prefix_sums
from timbrel.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, row string, size long, target string, _key long, epoch int"
TURNS = "conv_id long, turn long, role string, text string, seq string, words string, part long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_merkle_manifest", "op13_source_mixing"])
def test_queries_against_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


# prefix sums


def test_prefix_sums_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.choice([None, *range(500)]), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, i long, v long").repartition(7)
    got = {r.i: (r._before, r._total) for r in prefix_sums(df, "g", ["k", "i"], "v", "test").collect()}
    held, total = Counter(), Counter()
    for g, _, _, v in rows:
        total[g] += v
    for g, k, i, v in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        assert got[i] == (held[g], total[g])
        held[g] += v


# prefix trie


def brute_trie(sequences):
    """Nodes by prefix, each computed on its own."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(t for t, _ in turns[:d])].append(c)
    words = {tuple(t for t, _ in turns[:d]): turns[d - 1][1] for turns in sequences.values() for d in range(1, len(turns) + 1)}
    out = set()
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r != q and r[: len(q)] == q for r in below)]
        ends = sorted(c for c in own if len(sequences[c]) == len(p))
        saved = sum((len(members[q]) - 1) * words.get(q, 0) for q in below)
        out.add((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children), len(leaves), saved, h(",".join(map(str, ends)))))
    return out


def sequences_of(seed, n, kinds, longest):
    rng = random.Random(seed)
    ids = rng.sample(range(-50, 10 * n), n)
    return {c: [(rng.randrange(kinds), 0) for _ in range(rng.randrange(longest + 1))] for c in ids}


def with_words(sequences):
    return {c: [(t, (t * 7 + d) % 5) for d, (t, _) in enumerate(turns)] for c, turns in sequences.items()}


def encoded(turns):
    return b"".join(hashlib.md5(b"%d" % t).digest() for t, _ in turns)


def tuples(df):
    rows = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("seed", "n", "kinds", "longest"), [(1, 60, 2, 4), (2, 40, 1, 6), (3, 80, 3, 3), (4, 1, 2, 3), (5, 50, 2, 0), (6, 90, 2, 9)])
def test_forests_joined_at_any_cut(seed, n, kinds, longest):
    """The same nodes however the sorted rows are cut into partitions and batches."""
    sequences = with_words(sequences_of(seed, n, kinds, longest))
    rows = sorted((encoded(t), c) for c, t in sequences.items())
    want = brute_trie(sequences)
    rng = random.Random(seed)
    for _ in range(12):
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(0, 8))))
        top, written, parts = prefix_trie.Forest(1 << 22), [], []
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, n])):
            forest = prefix_trie.Forest(k)
            at = a
            while at < b:
                some = rows[at : min(b, at + rng.randrange(1, 9))]
                forest.add([s for s, _ in some], [[w for _, w in sequences[c]] for _, c in some], [c for _, c in some])
                forest.settle()
                at += len(some)
            parts.append(forest.packed())
            written.append(forest)
        for p in parts:
            top.join_packed(p)
            top.settle()
        top.finish()
        written.append(top)
        names = {name: least for f in written for name, least in f.names}
        ends = defaultdict(list)
        for f in written:
            for key, first, digits in f.ends:
                ends[key].append((first, digits))
        got = []
        for f in written:
            for conv, depth, parent, name, n_convs, kids, leaves, saved, digest, key in f.nodes:
                parent = parent if name is None else names[name]
                digest = digest if key is None else h(",".join(d for _, d in sorted(ends[key])))
                got.append((conv, depth, parent, n_convs, kids, leaves, saved, digest))
        assert len(got) == len(set(got))
        assert set(got) == want


@pytest.mark.parametrize("limit", [0, 1 << 16])
def test_trie_over_partitions(spark, monkeypatch, limit):
    monkeypatch.setattr(prefix_trie, "STEP_ROWS", 16)
    monkeypatch.setattr(prefix_trie, "BROADCAST_NAMES", limit)
    sequences = sequences_of(7, 400, 2, 6)
    for c in list(sequences)[:150]:
        sequences[c] = [(0, 0)] * 3  # one conversation makes a third of all
    sequences[-99] = [(1, 0)] * 3000  # a very long one
    sequences = with_words(sequences)
    rows = [(c, bytearray(encoded(t)), [w for _, w in t]) for c, t in sequences.items()]
    df = spark.createDataFrame(rows, "conv_id long, seq binary, words array<long>").repartition(5)
    short = {c: t for c, t in sequences.items() if c != -99}
    got = tuples(prefix_trie.trie(df.where("conv_id <> -99")))
    assert got == brute_trie(short)
    deep = tuples(prefix_trie.trie(df))
    assert sum(1 for r in deep if r[0] == -99 and r[1] > 6) == 2994


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), len([w for w in text.replace("\u000b", " ").split(" ") if w])))
    own = {c: [(d, w) for _, d, w in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        k = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])
        out[c] = base[:k] + turns[k:]
    return out


def test_trie_of_odd_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 45), 63, 64, -3, -20, 10**12]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["ja", "nein  doch", "", None]), "s", "w", 1))
    rows += [(7, None, None, None, "s", "w", 1), (7, None, None, None, "s", "w", 1), (8, 1, "user", "a b  c", "s", "w", 1), (None, 0, "user", "lost", "s", "w", 1), (40, 2, "user", "x " * 30000, "s", "w", 1)]
    got = tuples(prefix_trie.report(spark.createDataFrame(rows, TURNS).repartition(3)))
    assert got == brute_trie(brute_rebuilt(rows))


def test_trie_of_no_rows(spark):
    assert prefix_trie.report(spark.createDataFrame([], TURNS)).collect() == []


# Merkle log


def brute_root(level):
    while len(level) > 1:
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def brute_proof(level, i):
    out = []
    while len(level) > 1:
        if i ^ 1 < len(level):
            out.append(("L" if i & 1 else "R") + level[i ^ 1])
        else:
            out.append("")
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
        i >>= 1
    return out


def brute_log(leaves):
    """A log that appends each node when its last leaf has come."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    out = []
    for j in range(len(leaves)):
        for height, level in enumerate(levels):
            if (j + 1) % (1 << height) == 0 or j == len(leaves) - 1:
                out.append((height, level[j >> height]))
    return out


@pytest.mark.parametrize("aligned", [1, 2, 8])
def test_log_and_proofs(spark, monkeypatch, aligned):
    monkeypatch.setattr(merkle, "ALIGNED", aligned)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 16, "e": 37, "f": 300}
    trees = {t: [h(t, str(i)) for i in range(n)] for t, n in sizes.items()}
    rows = [(t, i, len(own), x, (i,)) for t, own in trees.items() for i, x in enumerate(own)]
    leaves = spark.createDataFrame(rows, "tree string, i long, n long, digest string, row struct<i:long>").repartition(4)
    tiers = merkle.append_log(leaves, "test")
    assert {r.tree: (r.n, r.root) for r in merkle.roots(tiers).collect()} == {t: (len(own), brute_root(own)) for t, own in trees.items()}
    log = defaultdict(dict)
    for r in merkle.log_entries(tiers).collect():
        assert r.position not in log[r.tree]
        log[r.tree][r.position] = (r.height, r.digest)
    for t, own in trees.items():
        assert [log[t][i] for i in range(len(log[t]))] == brute_log(own)
    for r in merkle.proofs(tiers).withColumn("root", merkle.folded(F.lit("x"), F.col("siblings"))).collect():
        assert r.siblings == brute_proof(trees[r.tree], r.row.i)
        node = "x"
        for s in r.siblings:
            node = h(s[1:], node) if s[:1] == "L" else h(node, s[1:]) if s else h(node)
        assert r.root == node


def sized(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def test_manifest_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ALIGNED", 2)
    rng = random.Random(5)
    rows = [(i, rng.choice(["é😀", "", None, "x" * 200000, "t"]), rng.choice([None, "", "de", "en", "ü", "=", "en"]), rng.choice([None, "s", ""]), rng.choice([None, 5, -1, 2**63 - 1]), *["x"] * 3, 1, "t", 1, 1) for i in [*range(120), None, None, 5, -7]]
    rows += [rows[3]]
    got = merkle.report(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0], h(*map(sized, (r[0], r[3], r[2], r[4], r[1]))), h(*map(sized, (r[0], r[3], r[2], None if r[4] is None else r[4] + 1, r[1])))))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = [brute_root([x[1] for x in by[lang]]) for lang in langs]
    root = brute_root(subs)
    want = Counter()
    for k, lang in enumerate(langs):
        for i, (doc_id, leaf, changed) in enumerate(by[lang]):
            way = brute_proof([x[1] for x in by[lang]], i) + brute_proof(subs, k)
            node = changed if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else leaf
            for s in way:
                node = h(s[1:], node) if s[:1] == "L" else h(node, s[1:]) if s else h(node)
            want[doc_id, leaf, subs[k], root, h("".join(s[1:] for s in way)), node, node == root] += 1
    assert Counter(tuple(r) for r in got) == want
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_manifest_of_one_row_and_none(spark):
    one = merkle.report(spark.createDataFrame([(1, "t", "en", "s", 1, "x", "x", "x", 1, "t", 1, 1)], DOCS)).collect()
    assert one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].verified and one[0].proof_sha256 == h()
    assert merkle.report(spark.createDataFrame([], DOCS)).collect() == []


# mixing


def brute_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), epochs=2):
    """Excess reshared round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = {}
    rest, left = share * sum(sizes.values()), set(order)
    while left:
        part = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if part[s] > epochs * sizes[s]]
        if not over:
            return target | part
        for s in over:
            target[s] = Fraction(epochs * sizes[s])
            rest -= target[s]
            left.remove(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_against_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:03d}": rng.choice([0, 1, rng.randrange(100), rng.randrange(100000)]) for i in range([1, 2, 40, 300][seed])}
    df = spark.createDataFrame([("0" + s, n) for s, n in sizes.items()], "_source string, source_size long")
    got = {r._source[1:]: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - float(want[s])) <= 1e-9 * max(1, float(want[s])) for s in want)


def mix_rows():
    rng = random.Random(8)
    rows = [(i, " ".join(["wort x"] * rng.randrange(30)) + rng.choice(["", "\n", "\u000b"]), "en", rng.choice(["a", "a", "a", "b", "ü", None, ""]), 1, "x", "x", "x", 1, "t", 1, 1) for i in range(400)]
    rows += [(500, None, "en", "a", *rows[0][4:]), (501, "", "en", "empty", *rows[0][4:]), (502, "w " * 40000, "en", "b", *rows[0][4:]), (None, "a b", "en", "a", *rows[0][4:]), rows[7], rows[7]]
    return rows


def words(text):
    for c in "\t\n\u000b\f\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def test_mix_against_loop(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.report(docs.repartition(5)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    goal, want = brute_targets(sizes), Counter()
    for s in sizes:
        own = sorted(((hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, len(words(r[1])), r[0]) for r in rows if r[3] == s))
        budget = int(goal[s])
        for _ in range(3):
            for k, row in enumerate(own):
                took = min(row[3], budget)
                budget -= took
                own[k] = (*row[:5], (row[5] if len(row) > 5 else 0) + took)
        for *_, size, doc_id, took in own:
            want[doc_id, size, sizes[s], round(float(goal[s]), 6), took] += 1
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
    again = mixing.report(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_texts_hold_what_is_taken(spark):
    docs = spark.createDataFrame(mix_rows(), DOCS)
    got = mixing.mixed(docs)
    assert set(got.columns) == set(docs.columns)
    taken = Counter()
    for r in got.collect():
        taken[r.doc_id] += len(words(r.text))
    want = Counter()
    for r in mixing.report(docs).collect():
        want[r.doc_id] += r.taken
    assert +taken == +want


def test_mix_of_no_rows_and_no_words(spark):
    assert mixing.report(spark.createDataFrame([], DOCS)).collect() == []
    one = mixing.report(spark.createDataFrame([(1, None, "en", None, 1, "x", "x", "x", 1, "t", 1, 1)], DOCS)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in one] == [(0, 0, 0.0, 0)]
    few = mixing.report(spark.createDataFrame([(1, "a b c", "en", None, 1, "x", "x", "x", 1, "t", 1, 1)], DOCS)).collect()
    assert [(r.target, r.taken) for r in few] == [(4.5, 4)]
