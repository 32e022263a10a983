"""Personal data: fixed kinds by pattern, and unseen identifiers by bootstrapped contextual extraction.

The matches of the four fixed kinds are the seeds.  The words before and after each identifier-like
token are its lexical pattern.  Spark scores the graph of patterns and instances in rounds: a pattern
is as good as the known share of the different instances it surrounds, an instance is as good as the
patterns that surround it.  Instances of high confidence are added as spans of their kind; the base
spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps, stored

#: The kinds in the order of the digest; fixed values.
KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; each lets patterns learn from the instances found before.
ROUNDS = 3
#: Least number of different known instances of a pattern, and least score of a pattern and an instance.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 4, 0.7, 0.75

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A token that may be an identifier: no blank inside and a digit or an at sign.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_ANY = re.compile("[0-9@]")
_WORD_BEFORE = re.compile(r"(\S+)\s*\Z")
_WORD_AFTER = re.compile(r"\s*(\S+)")
_EDGE = "\"'()[]{}<>,.;:!?"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap; looks outwards from every at sign, so long runs cost linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
            last = found.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed kinds, by kind and start; a match that fails its test is dropped, without another try."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _context(text: str, begin: int, end: int) -> str:
    """The word before and the word after, lower-cased, digits as 0; '^' and '$' at the ends of the text."""
    before = _WORD_BEFORE.search(text[max(0, begin - 40) : begin])
    after = _WORD_AFTER.match(text[end : end + 40])
    words = (before[1] if before else "^").strip(_EDGE).lower(), (after[1] if after else "$").strip(_EDGE).lower()
    return re.sub("[0-9]", "0", " _ ".join(words))


def _candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int | None, str]]:
    """(start, end, kind or None, pattern) of the seeds and of the identifier-like tokens that overlap no seed."""
    taken = sorted((a, b) for _, a, b in spans)
    for kind, a, b in spans:
        yield a, b, kind, _context(text, a, b)
    at = 0
    for m in _TOKEN.finditer(text):
        token = m[0]
        a = m.start() + len(token) - len(token.lstrip(_EDGE))
        b = m.end() - (len(token) - len(token.rstrip(_EDGE)))
        if b - a < 4:
            continue
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            yield a, b, None, _context(text, a, b)


FOUND = "array<struct<kind:int,start:int,end:int,pattern:string,value:string>>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("value", pa.string())])
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in steps(texts):
            found = []
            for text in texts[a:b]:
                own = []
                if _ANY.search(text):
                    for begin, end, kind, pattern in _candidates(text, base_spans(text)):
                        own.append({"kind": kind, "start": begin, "end": end, "pattern": pattern, "value": text[begin:end].lower()})
                found.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "_text")), pa.array(found, pa.list_(part))], ["doc_id", "_text", "found"])


def bootstrap(found: DataFrame) -> DataFrame | None:
    """value and kind of the instances that the scored graph adds; None if there are none.

    found: pattern, value and kind (null: not known) of every candidate.  A pattern's score for a kind
    is the known share of its different instances, times 1 - 1 / (1 + known), so few instances count
    for little.  An instance's score is 1 minus the product of what its patterns leave open.
    """
    graph = stored(found.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "graph")
    seeds = graph.where("kind IS NOT NULL").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    unseen = graph.where("kind IS NULL").select("pattern", "value").join(seeds.select("value").distinct(), "value", "left_anti")
    total = graph.groupBy("pattern").agg(F.count("*").alias("total"))
    known, added = seeds, None
    for _ in range(ROUNDS):
        share = graph.select("pattern", "value").join(known, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("known"))
        scored = share.join(total, "pattern").select("pattern", "kind", "known", (F.col("known") / F.col("total") * (1 - 1 / (1 + F.col("known")))).alias("p"))
        good = scored.where((F.col("known") >= SUPPORT) & (F.col("p") >= PATTERN_SCORE))
        per = unseen.join(good, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("score"))
        best = per.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).select("value", "b.kind", "b.score").where(F.col("score") >= INSTANCE_SCORE)
        found_now = stored(best, "instances")
        if found_now.isEmpty():
            break
        added, known = found_now, seeds.unionByName(found_now)
    return added


def find(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the text) and spans of every document: (kind, start, end, added), by kind and start, in code points.

    Null text counts as empty and has no spans; repeated rows get equal results; other columns are
    ignored.  ``added`` marks the spans of the method, which overlap no base span.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_text", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(rows.mapInArrow(_extract, f"doc_id {kind}, _text long, found {FOUND}"), "found")
    added = bootstrap(found.select(F.explode("found").alias("f")).select("f.pattern", "f.value", "f.kind"))
    span = F.transform(F.filter("found", lambda f: f["kind"].isNotNull()), lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"), F.lit(False).alias("added")))
    if added is None:
        return found.select("doc_id", "_text", F.array_sort(span).alias("spans"))
    open_ = found.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), F.explode("found").alias("f")).where("f.kind IS NULL").select("_d", "_t", "f.start", "f.end", "f.value")
    more = open_.join(added.select("value", "kind"), "value").groupBy("_d", "_t").agg(F.collect_set(F.struct("kind", "start", "end", F.lit(True).alias("added"))).alias("_more"))
    joined = found.join(more, found["doc_id"].eqNullSafe(more["_d"]) & (found["_text"] == more["_t"]), "left")
    return joined.select("doc_id", "_text", F.array_sort(F.concat(span, F.coalesce("_more", F.array().cast("array<struct<kind:int,start:int,end:int,added:boolean>>")))).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, number of base spans of each kind, base_sha256, spans, and n_added of every document."""
    base = F.filter("spans", lambda s: ~s["added"])
    counts = [_count(i).alias(f"n_{name}") for i, name in enumerate(KINDS)]
    return find(docs).select(
        "doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"),
    )


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & ~s["added"])).cast("long")


def redact(docs: DataFrame) -> DataFrame:
    """Columns of docs with every span of the text replaced by its kind in brackets, and n_chars (if there) made to fit.

    Of overlapping spans the first takes the place of all.  A null text stays null.
    """
    found = find(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), F.col("spans").alias("_spans")).dropDuplicates(["_d", "_t"])
    own = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = own.join(found, own["doc_id"].eqNullSafe(found["_d"]) & (own["_h"] == found["_t"]), "left")
    order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*map(F.lit, KINDS))
    # code points of the text are counted from 1; what lies between two spans is kept
    walked = F.aggregate(
        order, F.struct(F.lit(0).alias("till"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["till"], F.struct(F.greatest(a["till"], s["end"]).alias("till"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("till"), F.concat(a["out"], F.substring(F.col("text"), a["till"] + 1, s["start"] - a["till"]), F.lit("["), F.get(names, s["kind"]), F.lit("]")).alias("out"))
        ),
    )
    walked_text = F.concat(walked["out"], F.substring(F.col("text"), walked["till"] + 1, F.length("text")))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(walked_text)
    columns = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length(walked_text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return joined.select(*(columns.get(c, F.col(f"`{c}`")) for c in docs.columns))
