"""Language identification by interpolated Kneser-Ney character models, one per language.

Training counts n-grams of four characters over all training texts; continuation counts, context
totals and interpolated probabilities are Spark aggregates and joins.  The model is a few sorted
arrays of packed n-grams with one log-probability per language, searched by bisection; a large one
lies in shards of the shared folder that a task searches one by one.  A text gets
the language of lowest cross-entropy per character.  The language is rejected where that entropy is
far above what texts of the same length have in the training data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_CHARS, code_points, shared_folder, steps, stored

UNKNOWN = "und"
#: Kneser-Ney discount.
DISCOUNT = 0.75
#: N-grams of one table that a task holds at once, about.  A table of up to so many is broadcast, a larger
#: one is searched shard by shard; all n-grams are in the model at any size.
MODEL_NGRAMS = 1 << 20
#: Characters of a step where tables lie in shards, so that reading a shard serves many texts.
SHARDED_STEP_CHARS = 4 * STEP_CHARS
#: Without effect, as rejection limits are fitted on all texts; the name stays for callers that set it.
CALIBRATION_TEXTS = 4000
#: A language with fewer rightly predicted ones takes the limit of all languages together.
LEAST_CALIBRATED = 8
#: Standard deviations above the expected entropy from which a text is rejected.
REJECT_AT = 6.0
START, GAP = 0, 32


def _letters() -> np.ndarray:
    """Code of the lower-case letter for every code point, GAP for what is no letter; 16 bits each."""
    points = [chr(i) for i in range(0x110000)]
    table = np.full(0x110000, GAP, dtype=np.uint64)
    for i, c in enumerate(points):
        if c.isalpha():
            low = c.lower()
            code = ord(low) if len(low) == 1 else i
            table[i] = code if code < 0x10000 else 0xE000 + code % 0x1900
    return table


_TABLE: list[np.ndarray] = []


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of texts, one after the other, and where each begins.

    Each text begins with three START marks and a GAP; runs of other characters are one GAP.
    """
    if not _TABLE:
        _TABLE.append(_letters())
    lead = "\x00\x00\x00 "
    codes = _TABLE[0][code_points("".join([lead + t for t in texts]))]
    begin = np.cumsum([0, *(len(t) + len(lead) for t in texts)])[:-1]
    for i in range(3):
        codes[begin + i] = START
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != GAP) | (codes[:-1] != GAP)
    return codes[keep], (np.cumsum(keep) - 1)[begin]


def packed(codes: np.ndarray) -> np.ndarray:
    """The four characters that end at each place, as one 64-bit number; START before the first."""
    out = codes.copy()
    for back in (1, 2, 3):
        out[back:] |= codes[:-back] << np.uint64(16 * back)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams per language of a task's texts, summed once per step."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        by: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts, strict=True):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            for a, b in steps(own):
                codes, begin = characters(own[a:b])
                grams = packed(codes)[codes != START]
                found, many = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.view(np.int64)), pa.array(many)], ["lang", "k4", "c"])


def _ending(column: str, characters: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << (16 * characters)) - 1))


def _before(column: str) -> Column:
    return F.shiftrightunsigned(column, 16)


def _searched(own: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the keys in a sorted array (any row where it lacks the key), and which keys it holds."""
    if not len(own):
        return np.zeros((len(keys), values.shape[1]), np.float32), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    return values[at], own[at] == keys


@dataclass
class Table:
    """All n-grams of a table as signed numbers in ascending order, with a row of values each."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _searched(self.keys, self.values, keys.view(np.int64))


@dataclass
class ShardedTable:
    """The same in files of the shared folder; a file has the n-grams from its first one up to the first one of the next file."""

    folder: str
    first: np.ndarray
    names: list[str]
    width: int

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from pyarrow import fs

        different, back = np.unique(keys.view(np.int64), return_inverse=True)
        values, known = np.zeros((len(different), self.width), np.float32), np.zeros(len(different), bool)
        cuts = [0, *np.searchsorted(different, self.first[1:]).tolist(), len(different)]
        store, top = fs.FileSystem.from_uri(self.folder)
        for name, a, b in zip(self.names, cuts[:-1], cuts[1:], strict=True):
            if a < b:
                with store.open_input_file(f"{top}/{name}") as source:
                    values[a:b], known[a:b] = _searched(*_arrays(pa.ipc.open_file(source).read_all(), self.width), different[a:b])
        return values[back], known[back]


def _arrays(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    return table.column("k").to_numpy(), np.stack([table.column(f"v{i}").to_numpy() for i in range(width)], axis=1)


@dataclass
class Model:
    """N-grams of each order with log-probabilities (rows) per language (columns), and of each
    context the log-weight that goes to the shorter one."""

    langs: list[str]
    grams: dict[int, Table | ShardedTable]
    weights: dict[int, Table | ShardedTable]
    floor: float
    limits: dict[str, tuple[float, float, float]] | None = None

    @property
    def step_chars(self) -> int:
        sharded = any(isinstance(t, ShardedTable) for t in (*self.grams.values(), *self.weights.values()))
        return SHARDED_STEP_CHARS if sharded else STEP_CHARS

    def log_probabilities(self, keys: np.ndarray, order: int = 4) -> np.ndarray:
        """Of the last character of each n-gram after the others, per language."""
        out, known = self.grams[order].find(keys)
        if not known.all():
            rest = keys[~known]
            if order == 1:
                out[~known] = self.floor
            else:
                shorter = self.log_probabilities(rest & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)
                weight, held = self.weights[order].find(rest >> np.uint64(16))
                shorter[held] += weight[held]
                out[~known] = shorter
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and the number of its characters (0: no letter)."""
        codes, begin = characters(texts)
        real = codes != START
        sums = np.zeros((len(codes), len(self.langs)), np.float32)
        sums[real] = self.log_probabilities(packed(codes)[real])
        total = np.add.reduceat(sums, begin, axis=0, dtype=np.float64) if len(begin) else np.zeros((0, len(self.langs)))
        letters = np.add.reduceat((real & (codes != GAP)).astype(np.int64), begin) if len(begin) else begin
        n = np.add.reduceat(real.astype(np.int64), begin) if len(begin) else begin
        return -total / np.maximum(n, 1)[:, None], np.where(letters > 0, n, 0)

    def predict(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        out = []
        entropy, n = self.entropies(texts)
        for row, many in zip(entropy, n.tolist(), strict=True):
            if not many:
                out.append((UNKNOWN, 0.0, None, True))
                continue
            best = int(row.argmin())
            # neighbouring characters depend on each other, so the evidence counts by its square root
            score = 1.0 / float(np.exp(-(row - row[best]) * np.sqrt(many)).sum())
            lang, value = self.langs[best], float(row[best])
            rejected = False
            if self.limits and lang in self.limits:
                mean, spread, each = self.limits[lang]
                rejected = value > mean + REJECT_AT * float(np.sqrt(spread + each / many))
            out.append((lang, score, value, rejected))
        return out


def train(labelled: DataFrame) -> Model:
    """Fit the models on all rows of labelled (text, lang); rows with a null in either are left out.

    No rows at all give a model without languages, which calls every text unknown.
    """
    spark = labelled.sparkSession
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    grams = stored(rows.mapInArrow(_counted, "lang string, k4 long, c long").groupBy("lang", "k4").agg(F.sum("c").alias("n")), "grams")
    langs = sorted(r[0] for r in grams.select("lang").distinct().collect())
    tables = {4: grams.withColumnRenamed("k4", "k")}
    for order in (3, 2, 1):  # continuation counts: how many different characters stand before
        tables[order] = tables[order + 1].groupBy("lang", _ending("k", order).alias("k")).agg(F.count("*").alias("n"))
    every = F.explode(F.array(*map(F.lit, langs))) if langs else F.lit(None).cast("string")
    alphabet = tables[1].select("k").distinct().count() + 1
    probability, arrays, weights = None, {}, {}
    for order in (1, 2, 3, 4):
        own = tables[order]
        context = own.groupBy("lang", _before("k").alias("h")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        seen = own.select("k").distinct().withColumn("lang", every)
        held = (
            seen.withColumn("h", _before("k")).join(own, ["lang", "k"], "left").join(context, ["lang", "h"], "left")
            .withColumn("own", F.greatest(F.coalesce("n", F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col("total"))
            .withColumn("left", DISCOUNT * F.col("kinds") / F.col("total"))
        )
        if order == 1:
            shorter = held.withColumn("p_", F.lit(1.0 / alphabet))
        else:
            shorter = held.withColumn("s", _ending("k", order - 1)).join(probability.select("lang", F.col("k").alias("s"), F.col("p").alias("p_")), ["lang", "s"])
        p = F.when(F.col("total").isNull(), F.col("p_")).otherwise(F.col("own") + F.col("left") * F.col("p_"))
        probability = stored(shorter.select("lang", "k", p.alias("p")), f"probability{order}")
        arrays[order] = _sorted(probability, F.ln("p"), langs)
        if order > 1:
            weights[order] = _sorted(context.select("lang", F.col("h").alias("k"), (DISCOUNT * F.col("kinds") / F.col("total")).alias("p")), F.ln("p"), langs)
    model = Model(langs, arrays, weights, float(np.log(1.0 / alphabet)))
    model.limits = _limits(spark, rows, model)
    return model


def _sorted(table: DataFrame, value: Column, langs: list[str]) -> Table | ShardedTable:
    """All n-grams of a table in order, with the values of the languages in columns."""
    if not langs:
        return Table(np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    columns = [F.coalesce(F.max(F.when(F.col("lang") == lang, value)), F.lit(0.0)).cast("float").alias(f"v{i}") for i, lang in enumerate(langs)]
    rows = stored(table.groupBy("k").agg(*columns), "ngrams")
    many = rows.count()
    if many > MODEL_NGRAMS:
        return _sharded(rows, -(-many // MODEL_NGRAMS), len(langs))
    keys, values = _arrays(rows.toArrow(), len(langs))
    order = np.argsort(keys)
    return Table(keys[order], np.ascontiguousarray(values[order]))


def _sharded(rows: DataFrame, shards: int, width: int) -> ShardedTable:
    """Ranges of n-grams, each written by one task to a file of its own name, so a repeated task is harmless."""
    folder = f"{shared_folder(rows.sparkSession)}/ngram-shards-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        name, first, file = f"{uuid.uuid4().hex}.arrow", None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                store.create_dir(top, recursive=True)
                sink = store.open_output_stream(f"{top}/{name}")
                first, file = batch.column("k")[0].as_py(), pa.ipc.new_file(sink, batch.schema)
            file.write_batch(batch)
        if file is not None:
            file.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"first": [first], "name": [name]})

    dealt = rows.repartitionByRange(shards, "k").sortWithinPartitions("k")
    files = sorted((r["first"], r["name"]) for r in stored(dealt.mapInArrow(run, "first long, name string"), "shards").collect())  # one row per shard
    return ShardedTable(folder, np.array([f for f, _ in files], np.int64), [n for _, n in files], width)


def _limits(spark: SparkSession, rows: DataFrame, model: Model) -> dict[str, tuple[float, float, float]]:
    """Per language mean entropy, and variance as a constant plus a share per character, from all of its rightly predicted training texts.

    Languages with few such texts get the limit of all languages together; there is none where all
    together have too few.  Sums are made by Spark, one row per language reaches the driver.
    """
    if not model.langs:
        return {}
    scored = rows.mapInArrow(_scorer(spark, model, ["lang"]), "lang string, lang_pred string, score double, entropy double, n_letters long, rejected boolean")
    right = stored(scored.where("lang = lang_pred AND entropy IS NOT NULL").select("lang", "entropy", "n_letters"), "entropies")
    together = _fitted(right.withColumn("lang", F.lit(UNKNOWN))).get(UNKNOWN)
    return {} if together is None else dict.fromkeys(model.langs, together) | _fitted(right)


def _fitted(right: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Limit of every language with at least ``LEAST_CALIBRATED`` rows (lang, entropy, n_letters)."""
    share = 1.0 / F.col("n_letters")
    means = right.groupBy("lang").agg((F.sum(F.col("entropy") * F.col("n_letters")) / F.sum("n_letters")).alias("mean"), F.count("*").alias("many"))
    squares = right.join(F.broadcast(means.where(F.col("many") >= LEAST_CALIBRATED)), "lang").withColumn("sq", F.pow(F.col("entropy") - F.col("mean"), F.lit(2.0)))
    each = squares.groupBy("lang").agg(F.greatest(F.lit(0.0), F.sum(F.col("sq") * share) / F.sum(share * share)).alias("each"))
    over = F.greatest(F.col("sq") - F.col("each") * share, F.lit(0.0))
    spread = squares.join(F.broadcast(each), "lang").groupBy("lang").agg(F.first("mean").alias("mean"), F.greatest(F.avg(over), F.lit(0.01)).alias("spread"), F.first("each").alias("each"))
    return {r["lang"]: (r["mean"], r["spread"], r["each"] + 4.0) for r in spread.collect()}


def _scorer(spark: SparkSession, model: Model, keep: list[str]):
    shared = spark.sparkContext.broadcast(model)  # tables beyond MODEL_NGRAMS are names of files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in steps(texts, own.step_chars):
                some = texts[a:b]
                found = own.predict(some) if own.langs else [(UNKNOWN, 0.0, None, True)] * len(some)
                lang, score, entropy, rejected = zip(*found, strict=True)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(list(map(len, some)), pa.int64()), pa.array(rejected, pa.bool_())],
                    [*keep, "lang_pred", "score", "entropy", "n_letters", "rejected"],
                )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Columns of docs with lang_pred, lang_score and lang_rejected.

    Text that is null or has no letter gets ``und``, score 0 and is rejected.  Ties go to the language
    first in the alphabet.  Columns of these names in docs are replaced.
    """
    new = ["lang_pred", "lang_score", "lang_rejected"]
    keep = [c for c in docs.columns if c not in new]
    inner = {c: f"c{i}" for i, c in enumerate(keep)}
    text = inner["text"]
    kinds = ", ".join(f"{inner[c]} {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in inner.items())).withColumn("text", F.col(text))
    run = _scorer(docs.sparkSession, model, list(inner.values()))
    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, entropy double, n_letters long, rejected boolean")
    return out.select(*(F.col(i).alias(c) for c, i in inner.items()), "lang_pred", F.col("score").alias("lang_score"), F.col("rejected").alias("lang_rejected"))


def held_out(parts: int, part: int, id_column: str = "doc_id") -> Column:
    """Whether a row belongs to the held-out part, by CRC-32 of its id as text; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the four fifths of the labelled rows that are not held out."""
    model = train(docs.where(~held_out(5, 0)))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
