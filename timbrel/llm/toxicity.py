"""Toxicity by a learned lexicon, matched through Levenshtein automata, with context-window scores.

The lexicon holds the words whose share of toxic documents is far above the rest; it is counted over
all labelled training rows.  Its trie is intersected with the Levenshtein automata of its terms into one
deterministic automaton that accepts every word within one edit of a term: a letter changed, added, left
out, or swapped with the next.  The words of a step of texts run through it side by side, one character
at a time; most leave it after three.  A digit or sign between two letters may be the edit, so two words
with one such character between them also run as one; in scripts without spaces so does every window of
two to four characters.  Each match is
weighted by its exactness and by its context window: quotation and talk about a word count for less,
other matches near by for more.  A logistic curve, fitted on a bounded sample, gives the score.
"""

from __future__ import annotations

import pickle
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, shared_folder, steps, stored
from .language import held_out

#: Terms of one automaton, about, and its letters at most; a larger lexicon is held in several, which a task
#: reads from the shared folder and runs one by one. All terms are kept at any size.
LEXICON_TERMS, LEXICON_LETTERS = 2000, 40_000
#: Least number of toxic documents with a term, least log-ratio of its shares in toxic and other documents, and
#: least log-likelihood statistic, so that rare words don't become terms by chance.
LEAST_DOCS, LEAST_RATIO, LEAST_EVIDENCE = 3, 2.0, 18.0
#: Terms from this length on also match with one edit in an automaton of its own.
FUZZY_LENGTH = 5
#: The same in the automaton of the model, which also takes two swapped letters as one edit.
MODEL_FUZZY_LENGTH = 4
#: Characters of the windows in scripts without spaces.
WINDOWS = (2, 3, 4)
#: Code points of the scripts without spaces: Thai to Lao, Myanmar, Khmer, kana, Han and its extensions; fixed values.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: Labelled rows that the logistic curve is fitted on, about.
FITTED_ROWS = 20_000
#: Words on each side of a match that are its context.
CONTEXT = 5
#: Weight of a match one edit away, of one in quotation, of one that is spoken about.
EDITED, QUOTED, MENTIONED = 0.6, 0.3, 0.5
#: Weight of the logarithm of a term's matches in one text.
REPEATED = 0.3
#: Words that mark talk about a word; fixed values.
MENTIONS = ("word", "term", "phrase", "called", "said", "says", "quote", "quoted", "insult", "slur", "wort", "begriff", "sagte", "mot", "terme", "palabra")
QUOTES = "\"'“”„«»‘’‚‹›`"

_FOLD: list[np.ndarray] = []


def _folded() -> np.ndarray:
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
        elif unicodedata.category(c) in ("Mn", "Mc"):  # vowel signs and accents
            out[i] = i
    return out


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded codes of all texts, begin and end of every word (a run of letters and their marks), and the number of words of each text."""
    if not _FOLD:
        _FOLD.append(_folded())
    codes = _FOLD[0][code_points("\n".join(texts) + "\n")]
    within = codes != 0
    change = np.flatnonzero(np.diff(within.astype(np.int8), prepend=0))
    begin, end = change[::2], change[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return codes, begin, end, np.diff(np.searchsorted(begin, ends), prepend=0)


def joined_words(texts: list[str], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Places of the words that only one character, no white space, parts from the next word."""
    close = np.flatnonzero(begin[1:] - end[:-1] == 1)
    between = code_points("\n".join(texts) + "\n")[end[close]]
    kinds, back = np.unique(between, return_inverse=True)
    return close[~np.array([chr(c).isspace() for c in kinds.tolist()], bool)[back]]


def windows(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and word of every window of a script without spaces that is shorter than its word."""
    unspaced = np.zeros(len(codes), bool)
    for low, high in UNSPACED:
        unspaced |= (codes >= low) & (codes <= high)
    places = np.flatnonzero(unspaced)
    word = np.searchsorted(begin, places, side="right") - 1
    found = []
    for n in WINDOWS:
        ok = (places + n <= end[word]) & (end[word] - begin[word] > n)
        ok[ok] = np.logical_and.reduce([unspaced[places[ok] + i] for i in range(n)])
        found.append((places[ok], places[ok] + n, word[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Automaton:
    """Transitions (state, letter class) and what each state accepts: term number and whether with an edit."""

    letters: np.ndarray  # sorted codes; class of a letter is its place plus one, 0 for all others
    next: np.ndarray
    term: np.ndarray
    edited: np.ndarray

    def run(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that are accepted (by place in begin), their terms, and whether with an edit."""
        if not len(self.letters) or not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        kind = np.where(self.letters[at] == codes, at + 1, 0).astype(np.int32)
        alive, place, state = np.arange(len(begin)), begin.astype(np.int64), np.zeros(len(begin), np.int32)
        found = []
        while len(alive):
            state = self.next[state, kind[place]]
            place = place + 1
            ok = state >= 0
            alive, place, state = alive[ok], place[ok], state[ok]
            done = place == end[alive]
            if done.any():
                found.append((alive[done], state[done]))
                alive, place, state = alive[~done], place[~done], state[~done]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        word, last = (np.concatenate(x) for x in zip(*found, strict=True))
        ok = self.term[last] >= 0
        order = np.argsort(word[ok])
        return word[ok][order], self.term[last[ok]][order], self.edited[last[ok]][order]


def build_automaton(terms: list[str], fuzzy: int = FUZZY_LENGTH, swaps: bool = False) -> Automaton:
    """One deterministic automaton of the trie of terms and the automata of one edit.

    A state is the set of trie places that the letters read so far can stand for, each with the
    edits spent.  Of several terms one without an edit is accepted first, then the first in the list.
    Terms of at least fuzzy letters match with one edit; with swaps two swapped letters are one.  A place
    after the first of two swapped letters has 2 plus the code of the letter that must follow as its edits.
    """
    children: list[dict[int, int]] = [{}]
    ending: list[int] = [-1]
    reach: list[bool] = [False]  # a term of fuzzy letters or more lies below
    for number, term in enumerate(terms):
        node = 0
        reach[0] |= len(term) >= fuzzy
        for c in map(ord, term):
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ending.append(-1)
                reach.append(False)
            node = children[node][c]
            reach[node] |= len(term) >= fuzzy
        if ending[node] < 0:
            ending[node] = number
    letters = sorted({c for kids in children for c in kids})
    short = {n for n, t in enumerate(terms) if len(t) < fuzzy}

    def closed(places: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With the places that leaving out one letter of a term gives."""
        more = {(kid, 1) for node, spent in places if not spent for kid in children[node].values() if reach[kid]}
        return frozenset(places | {p for p in more if (p[0], 0) not in places})

    first = closed({(0, 0)})
    numbers, queue, rows, term, edited = {first: 0}, [first], [], [], []
    while len(rows) < len(queue):
        state = queue[len(rows)]
        row = np.full(len(letters) + 1, -1, np.int32)
        useful = {c for node, spent in state for c in (children[node] if spent < 2 else (spent - 2,))}
        swapped: dict[int, set[tuple[int, int]]] = {}
        if swaps:
            for node, spent in state:
                for x, kid in children[node].items() if not spent and reach[node] else ():
                    for c, end in children[kid].items():
                        if c != x and reach[end]:
                            swapped.setdefault(c, set()).add((end, 2 + x))
        other = {p for node, spent in state if not spent and reach[node] for p in [(node, 1), *((kid, 1) for kid in children[node].values() if reach[kid])]}

        def number(places: set[tuple[int, int]]) -> int:
            if not places:
                return -1
            key = closed(places)
            if key not in numbers:
                numbers[key] = len(queue)
                queue.append(key)
            return numbers[key]

        row[:] = number(other)
        for i, c in enumerate(letters):
            if c in useful or c in swapped:
                step = {(children[node][c], spent) for node, spent in state if spent < 2 and c in children[node] and (not spent or reach[children[node][c]])}
                step |= {(node, 1) for node, spent in state if spent == 2 + c and (node, 0) not in step} | swapped.get(c, set())
                row[i + 1] = number(step | {p for p in other if (p[0], 0) not in step})
        rows.append(row)
        exact = [ending[node] for node, spent in state if not spent and ending[node] >= 0]
        near = [ending[node] for node, spent in state if spent == 1 and ending[node] >= 0 and ending[node] not in short]
        term.append(min(exact) if exact else min(near) if near else -1)
        edited.append(not exact)
    return Automaton(np.array(letters, np.uint32), np.array(rows, np.int32), np.array(term, np.int32), np.array(edited, bool))


@dataclass
class Lexicon:
    """Terms in order of strength, their weights and their automaton."""

    terms: list[str]
    weight: np.ndarray
    automaton: Automaton


def _lexicon(table: pa.Table) -> Lexicon:
    terms, ratio, toxic = table.column("word").to_pylist(), table.column("ratio").to_numpy(), table.column("toxic").to_numpy()
    return Lexicon(terms, ratio * np.minimum(1.0, np.log2(1 + toxic) / 4), build_automaton(terms, MODEL_FUZZY_LENGTH, swaps=True))


def _chunks(words: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of at most LEXICON_TERMS words and LEXICON_LETTERS letters, or one word."""
    begin = letters = 0
    for i, word in enumerate(words):
        if i > begin and (i - begin >= LEXICON_TERMS or letters + len(word) > LEXICON_LETTERS):
            yield begin, i
            begin, letters = i, 0
        letters += len(word)
    if begin < len(words):
        yield begin, len(words)


def _lexicon_files(spark: SparkSession, top: DataFrame, many: int) -> tuple[str, list[str]]:
    """Folder and files of the lexicon in order of strength, each written by a task under a name of its own."""
    folder = f"{shared_folder(spark)}/lexicon-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            words = batch.column("word").to_pylist()
            for a, b in _chunks(words):
                name = f"{uuid.uuid4().hex}.pickle"
                store.create_dir(path, recursive=True)
                with store.open_output_stream(f"{path}/{name}") as sink:
                    sink.write(pickle.dumps(_lexicon(pa.Table.from_batches([batch.slice(a, b - a)]))))
                yield pa.RecordBatch.from_pydict({"rank": [batch.column("rank")[a].as_py()], "word": [words[a]], "name": [name]})

    order = [F.desc("rank"), F.asc("word")]
    dealt = top.repartitionByRange(-(-many // LEXICON_TERMS), *order).sortWithinPartitions(*order)
    return folder, [r["name"] for r in stored(dealt.mapInArrow(run, "rank double, word string, name string"), "lexicons").orderBy(*order).collect()]  # one row per file


@dataclass
class Model:
    """A lexicon, or the folder and files of a large one in order of strength; and the logistic curve."""

    lexicon: Lexicon | None
    folder: str = ""
    files: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def lexicons(self) -> Iterator[Lexicon]:
        if self.lexicon is not None:
            yield self.lexicon
        if self.files:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.folder)
            for name in self.files:
                with store.open_input_file(f"{path}/{name}") as source:
                    yield pickle.loads(source.read())

    @property
    def terms(self) -> list[str]:
        return [t for x in self.lexicons() for t in x.terms]

    def _run(self, codes: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each list of (begin, end): accepted places, numbers of their terms, weights, and whether with an edit.

        As with one automaton, a term without an edit is accepted first, then the strongest.
        """
        base, found = 0, [[(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))] for _ in spans]
        for x in self.lexicons():
            for own, (begin, end) in zip(found, spans, strict=True):
                at, term, edited = x.automaton.run(codes, begin, end)
                own.append((at, term.astype(np.int64) + base, x.weight[term], edited))
            base += len(x.terms)
        out = []
        for own in found:
            at, term, weight, edited = (np.concatenate(c) for c in zip(*own, strict=True))
            order = np.lexsort((term, edited, at))
            order = order[np.diff(at[order], prepend=-1) != 0]
            out.append((at[order], term[order], weight[order], edited[order]))
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: weighted sum of its matches, and that sum per square root of hundred words."""
        codes, begin, end, counts = split_words(texts)
        out = np.zeros((len(texts), 2))
        if not len(begin):
            return out
        first_word, last_word, lo_, hi_, term, weight, edited = self._matches(texts, codes, begin, end)
        if not len(term):
            return out
        raw = "\n".join(texts) + "\n"
        owner = np.searchsorted(np.cumsum(counts), first_word, side="right")
        first = np.cumsum(counts) - counts
        spoken = set(MENTIONS)
        held: dict[tuple[int, int], tuple[float, int]] = {}  # per text and term: best value, matches
        for i in range(len(term)):
            w, v, t, own, till = int(first_word[i]), int(last_word[i]), int(owner[i]), int(lo_[i]), int(hi_[i])
            lo, hi = max(int(first[t]), w - CONTEXT), min(int(first[t] + counts[t]), v + CONTEXT + 1)
            value = float(weight[i]) * (EDITED if edited[i] else 1.0)
            before, after = raw[max(0, own - 1) : own], raw[till : till + 1]
            if before and after and before in QUOTES and after in QUOTES or _inside_quotes(raw[begin[lo] : own], raw[till : end[hi - 1]]):
                value *= QUOTED
            elif any(raw[begin[k] : end[k]].lower() in spoken for k in range(lo, hi) if not w <= k <= v):
                value *= MENTIONED
            best, many = held.get((t, int(term[i])), (0.0, 0))
            held[t, int(term[i])] = max(best, value), many + 1
        for (t, _), (best, many) in held.items():  # repeats of a term add little
            out[t, 0] += best * (1 + REPEATED * np.log(many))
        out[:, 1] = out[:, 0] / np.sqrt(1 + counts / 100.0)
        return out

    def _matches(self, texts: list[str], codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and last word, begin and end, term, weight and whether with an edit of every match, in order of the text.

        Joined words count only where neither of the two matches by itself, windows only without an edit.
        """
        pair = joined_words(texts, begin, end)
        lo, hi, within = windows(codes, begin, end)
        alone, joined, windowed = self._run(codes, [(begin, end), (begin[pair], end[pair + 1]), (lo, hi)])
        word, term, weight, edited = alone
        found = [(word, word, begin[word], end[word], term, weight, edited)]
        at, term, weight, edited = joined
        ok = ~np.isin(pair[at], word) & ~np.isin(pair[at] + 1, word)
        first = pair[at][ok]
        found.append((first, first + 1, begin[first], end[first + 1], term[ok], weight[ok], edited[ok]))
        at, term, weight, edited = (c[~windowed[3]] for c in windowed)
        found.append((within[at], within[at], lo[at], hi[at], term, weight, edited))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.lexsort((columns[3], columns[2]))
        return tuple(c[order] for c in columns)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.log1p(self.features(texts))
        base, a, b = self.curve
        return 1 / (1 + np.exp(-(base + a * x[:, 0] + b * x[:, 1])))


def _inside_quotes(before: str, after: str) -> bool:
    """Whether the context has an opening quotation mark before the match and a closing one after it."""
    for opens, closes in (("“„", "”“"), ("«", "»"), ("‹", "›"), ("\"", "\"")):
        if any(before.count(o) % 2 if o == "\"" else before.rfind(o) > max(before.rfind(c) for c in closes if c != o) for o in opens) and any(c in after for c in closes):
            return True
    return False


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents of a step hold each word."""
    for batch in batches:
        texts, toxic = [t or "" for t in batch.column("text").to_pylist()], batch.column("toxic").to_pylist()
        for a, b in steps(texts):
            found: dict[str, list[int]] = {}
            for text, label in zip(texts[a:b], toxic[a:b], strict=True):
                lowered = text.lower()
                codes, begin, end, _ = split_words([lowered])
                lo, hi, _ = windows(codes, begin, end)
                for w in {lowered[i:j] for i, j in zip([*begin.tolist(), *lo.tolist()], [*end.tolist(), *hi.tolist()], strict=True)}:
                    found.setdefault(w, [0, 0])[label] += 1
            words = list(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found[w][1] for w in words], pa.int64()), pa.array([found[w][0] for w in words], pa.int64())], ["word", "toxic", "other"])


def train(labelled: DataFrame) -> Model:
    """Lexicon, weights and curve from labelled rows (text, toxic of 0 or 1; others are left out).

    Documents are counted over all rows.  Without toxic or without other rows the lexicon is empty and
    every score is the same low one.
    """
    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_other = totals.get(1, 0), totals.get(0, 0)
    counted = rows.mapInArrow(_document_words, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    ratio = F.log((F.col("toxic") + 0.1) / F.lit(n_toxic + 0.2)) - F.log((F.col("other") + 0.1 * n_other / max(1, n_toxic)) / F.lit(n_other + 0.2 * n_other / max(1, n_toxic) or 1.0))
    share = n_toxic / max(1, n_toxic + n_other)
    many = F.col("toxic") + F.col("other")
    rest = F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / (many * max(1 - share, 1e-9)))).otherwise(0.0)
    evidence = 2 * (F.col("toxic") * F.log(F.col("toxic") / (many * max(share, 1e-9))) + rest)
    top = counted.where(F.col("toxic") >= LEAST_DOCS).withColumn("ratio", ratio).where((F.col("ratio") >= LEAST_RATIO) & (evidence >= LEAST_EVIDENCE))
    top = stored(top.select("word", "ratio", "toxic", (F.col("ratio") * F.sqrt("toxic")).alias("rank")), "terms")
    sizes = top.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    if sizes[0] <= LEXICON_TERMS and sizes[1] <= LEXICON_LETTERS:
        model = Model(_lexicon(top.orderBy(F.desc("rank"), "word").toArrow()))
    else:
        folder, files = _lexicon_files(rows.sparkSession, top, sizes[0])
        model = Model(None, folder, tuple(files))
    sample = rows.sample(min(1.0, FITTED_ROWS / max(1, n_toxic + n_other)), seed=11)
    shared = sample.sparkSession.sparkContext.broadcast(model)  # a lexicon beyond LEXICON_TERMS is names of files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in steps(texts):
                x = shared.value.features(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("toxic").slice(a, b - a)], ["sum", "share", "toxic"])

    model.curve = _fitted(sample.mapInArrow(run, "sum double, share double, toxic int").toPandas())
    return model


def _fitted(sample: pd.DataFrame) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    y = sample.toxic.to_numpy(float)
    if not len(y) or y.min() == y.max():
        return (-4.0, 1.0, 1.0)
    x = np.column_stack([np.ones(len(y)), np.log1p(sample[["sum", "share"]].to_numpy())])
    beta = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-3, 0.05, 0.05])
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += change
        if np.abs(change).max() < 1e-8:
            break
    return tuple(map(float, beta))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every document; null text counts as empty and gets the lowest score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon beyond LEXICON_TERMS is names of files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in steps(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(shared.value.scores(texts[a:b]), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from the labelled rows that are not held out."""
    own = labels.select(F.col("doc_id").alias("_l"), "toxic")
    # joined by a shuffle whatever the size of labels, and stored, as counting and fitting both read it
    training = docs.select("doc_id", "text").where(~held_out(3, 1)).join(own.hint("merge"), F.col("doc_id") == F.col("_l")).select("text", "toxic")
    training = stored(training, "labelled")
    return score(docs, train(training)).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
