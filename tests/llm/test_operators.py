"""Every operator on a small table with nulls, empty and repeated rows, clashing columns, and on no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbrel.llm import arrow_output, chat, decontaminate, language, licenses, near_dedup, neighbours, packing, personal, toxicity
from timbrel.llm.common import public_tokenizer
from timbrel.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, w long, spans string, lang_pred string"


def words_of(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = words_of(1, 200)
    near = base.split()
    near[100] = "changed"
    texts = [base, base, " ".join(near), words_of(2, 150), None, "", "...", "x", words_of(3, 3000), "écoute «ça» 😀 " * 5]
    out = [(i, t, "en", "s", len(t or ""), "a", 1, "b", "c") for i, t in enumerate(texts)]
    return [*out, out[3], (None, words_of(4, 40), None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def whole_ids(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer(name))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_is_gapless_and_whole(docs, rows):
    got = packing.pack(docs).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = whole_ids("byte_bpe_50k.json", text, 2)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((doc_id, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in got) // 1024) + 1


def test_packing_of_no_rows(none):
    assert packing.pack(none).collect() == []


def test_packing_plan_against_items():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = Counter(rng.integers(1, 1025, 400).tolist())
        used, placed = {}, Counter()
        for length, n, first, each, offset in packing.plan_sequences(counts):
            placed[length] += n
            for i in range(n):
                used.setdefault(first + i // each, []).append((offset + i % each * length, length))
        assert placed == counts
        for own in used.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 1024
        assert len(used) <= 1.1 * sum(n * c for n, c in counts.items()) / 1024 + 2


def test_packed_sequences_hold_their_pieces(docs):
    pieces = packing.tokenized_pieces(docs)
    out = packing.sequences(packing.place(pieces)).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 4096 and sum(r.lengths) == r.n_tokens for r in out)
    assert sum(r.n_tokens for r in out) == pieces.groupBy().sum("length").first()[0]


def test_arrow_files_round_trip(docs, rows, tmp_path):
    folder = f"file://{tmp_path}"
    shards = arrow_output.write_shards(docs, folder, length=64)
    got = arrow_output.read_documents(shards, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got) == Counter((d, len(i), crc(i)) for d, t, *_ in rows for i in [whole_ids("word_bpe_49k.json", t, 1)])
    at = 0
    for r in sorted(got, key=lambda r: (r.start,)):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    first, mask = arrow_output.sequence(shards.first()["path"], 0)
    assert len(first) == len(mask) == 64 and mask.all()


def test_language_rules(docs, none):
    model = language.train(docs)
    got = language.identify(docs, model)
    assert got.columns == [c for c in docs.columns if c != "lang_pred"] + ["lang_pred", "lang_score", "lang_rejected"]
    for r in got.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.lang_score <= 1
    assert language.identify(docs, language.train(none)).where("lang_pred <> 'und'").count() == 0


def test_language_model_is_kneser_ney(spark):
    texts = ["abab abba", "baab"]
    model = language.train(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"))
    codes, _ = language.characters(texts)
    grams = [tuple(map(int, codes[i - 3 : i + 1])) for i in range(3, len(codes)) if codes[i] != 0]
    counts = {4: Counter(grams)}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    v = len(counts[1]) + 1

    def p(g):
        n = len(g)
        own = {k: c for k, c in counts[n].items() if k[:-1] == g[:-1]} if n else {}
        below = p(g[1:]) if n > 1 else 1 / v
        if not own:
            return below
        total = sum(own.values())
        return max(own.get(g, 0) - 0.75, 0) / total + 0.75 * len(own) / total * below

    for g in [*set(grams), (97, 97, 97, 97), (120, 97, 98, 98)]:
        key = np.array([sum(c << (16 * (3 - i)) for i, c in enumerate(g))], np.uint64)
        assert abs(float(model.log_probabilities(key)[0, 0]) - np.log(p(g))) < 1e-5


def test_language_model_keeps_all_ngrams(spark, monkeypatch):
    rng = np.random.default_rng(5)

    def text(letters):
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(30))

    rows = [(text("abcdefghij"), "hot") for _ in range(60)] + [(text("αβγδε龍鼠abc"), "rare") for _ in range(3)]
    table = spark.createDataFrame(rows, "text string, lang string")
    texts = [t for t, _ in rows[::7]] + [text("αβγδε龍鼠abc"), text("xyzα"), "", "..."]
    whole = language.train(table)
    monkeypatch.setattr(language, "MODEL_NGRAMS", 50)
    small = language.train(table)
    for a, b in zip(whole.entropies(texts), small.entropies(texts), strict=True):
        assert np.allclose(a, b, atol=1e-5)
    assert small.predict(texts)[-4][0] == "rare" and whole.limits.keys() == small.limits.keys()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.lang_pred for r in language.identify(docs, small).collect()] == [p[0] for p in whole.predict(texts)]


def test_language_limits_of_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "CALIBRATION_TEXTS", 40)
    rows = [(words_of(i, 30) + " " + "".join(chr(0x4E00 + 5 * i + j) for j in range(5)), "common") for i in range(400)]  # many letters, so that the unseen ones are unlikely
    rows += [(words_of(1000 + i, 30).translate(str.maketrans("abcdefghij", "αβγδεζηθικ")), "rare") for i in range(20)]
    rows += [(words_of(2000 + i, 30).translate(str.maketrans("abcdefghij", "бвгджзклмн")), "few") for i in range(3)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.limits) == {"common", "rare", "few"}
    garbage = "ωщ" + "".join(chr(0x0531 + i * 7 % 38) + chr(0x10D0 + i * 5 % 33) for i in range(200))
    for own, lang in (("αβγδ ", "rare"), ("бвгд ", "few")):
        found = model.predict([own + garbage, rows[0][0]])
        assert found[0][0] == lang and found[0][3] and not found[1][3]


def test_language_limits_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "CALIBRATION_TEXTS", 20)
    rng = random.Random(3)
    rows = [(" ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(3 + i % 30)), lang) for lang, letters in (("a", "abcde"), ("b", "defgh")) for i in range(150)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    for lang in "ab":
        texts = [t for t, own in rows if own == lang]
        known = [(value, len(t)) for t, (got, _, value, _) in zip(texts, model.predict(texts), strict=True) if got == lang]
        value, n = (np.array(x, dtype=float) for x in zip(*known, strict=True))
        mean = np.average(value, weights=n)
        squares = (value - mean) ** 2
        each = max(0.0, np.sum(squares / n) / np.sum(1 / n**2))
        want = (mean, max(np.mean(np.maximum(squares - each / n, 0)), 0.01), each + 4.0)
        assert model.limits[lang] == pytest.approx(want, rel=1e-6)


def test_language_held_out(spark, sf_dir):
    got = QUERIES["op6_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_near_duplicates(docs, none, rows):
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert near_dedup.classes(docs).count() == len(rows)
    assert got[0] == got[1] == got[2] == 0 and got[4] == got[5] == 4 and got[3] == 3 and got[6] == 6 and got[8] == 8
    kept = near_dedup.first_of_each(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 0), (False, 3), (False, 4), (False, 6), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert near_dedup.classes(none).count() == 0


def test_words_are_encoded_between_bars():
    """New words go to the vocabulary with bars between them, not special marks, and have the ids they have alone."""
    from timbrel.llm.tokens import Encoder

    enc = Encoder(public_tokenizer("word_bpe_49k.json"), False)
    calls = []
    tabulate = enc._tabulate
    enc._tabulate = lambda keys, joined, *more: (calls.append((keys, joined)), tabulate(keys, joined, *more))
    texts = ["plain words don't | split a|b || |", "\u0301accent e\u0301 \u1100\u1161 12,5% <|endoftext|> x<y", "", "  two  blanks\tand \u2028 lines\n", "\u00a0|\u00a0 \ud55c\uae00 \U0001f600|\U0001f600 I'LL \u0130"]
    assert enc.encode(texts) == [enc.whole(t) for t in texts]
    assert enc.encode(texts) == [enc.whole(t) for t in texts]
    marked = [k for keys, joined in calls for k in keys if any(enc.mark in j for j in joined)]
    assert "plain" not in marked and "words" not in marked and enc.known["plain"] == enc.whole("plain")


def test_words_are_encoded_once_in_any_case_and_with_any_marks():
    """A word in other case or before other marks is not encoded anew, and every text has the ids it has as a whole."""
    from timbrel.llm import tokens

    enc = tokens.Encoder(public_tokenizer("word_bpe_49k.json"), False)
    calls = []
    tabulate = enc._tabulate
    enc._tabulate = lambda keys, joined, *more: (calls.extend(keys), tabulate(keys, joined, *more))
    texts = ["Word word, WORD. word!! (word) wOrD%%%\nword,", ""]
    assert enc.encode(texts) == [enc.whole(t) for t in texts]
    assert sorted(k for k in calls if k) == ["!!", "%%%", "(word", ")", ",", ".", "word"] and calls.count("word") == 1
    odd = ["J\u030c J\u030c, \u01f0. \u0130, \u0130stanbul! I\u0307. \u212a, \u00c9t\u00e9, \u00c9T\u00c9. \u00b2, 5\u00b2. x\u0301, E\u0301? \u03a3\u03a3, \u03a3.", "dogs'. 's. 'S, \"'s don't, DON'T! we'LL'd'm. a'. \u2019s, \u2014, a\u2014. \u00d7, \u00f7.",
           "<|endoftext|>, <|endoftext|! word<|endoftext|. <|startoftext|>? ___ a_b_ _ , . 12,5. 3.14, 1e5!", "w" * 70 + ", " + "W" * 70 + ". " + "w" + "!" * 80 + " ", "\u0661, \u4e09. \ud55c\uae00, \U0001f600, a\U0001f600! \ufb01, \u1e9e. \u00df,", "\n\n  , \t. \u00a0,\u2028. \x01, \x00."]
    assert enc.encode(odd) == [enc.whole(t) for t in odd] == enc.encode(odd) and enc.encode([]) == []
    assert not any(len(k) > tokens.LONG_PIECE for k in enc.known)


def test_vocabulary_with_case_keeps_whole_pieces(tmp_path):
    """Pieces are cut and folded only where the vocabulary's own rules do it."""
    import json

    from timbrel.llm import tokens

    spec = json.loads(open(public_tokenizer("word_bpe_49k.json"), encoding="utf-8").read())
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    (tmp_path / "cased.json").write_text(json.dumps(spec), encoding="utf-8")
    enc = tokens.Encoder(str(tmp_path / "cased.json"), False)
    texts = ["Word word, WORD. (Word) don't, DON'T!", " \u0130, x"]
    assert enc.encode(texts) == [enc.whole(t) for t in texts] and enc.whole("Word") != enc.whole("word")


def test_full_table_of_words_is_emptied(monkeypatch):
    """A table without room for new words keeps those of the texts at hand, and the ids stay right."""
    from timbrel.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 20)
    enc = tokens.Encoder(public_tokenizer("word_bpe_49k.json"), False)
    rng = random.Random(3)
    for _ in range(30):
        texts = [" ".join(rng.choice(["the ", "of", f"word{rng.randrange(200)}", f"Name{rng.randrange(50)}."]) for _ in range(12)) for _ in range(3)]
        assert enc.encode(texts) == [enc.whole(t) for t in texts]
    assert len(enc.known) < 120


def test_near_copies_meet_in_blocks(spark, monkeypatch):
    """A bucket of near copies around the limit gives the components of all pairs, and no more links than texts in blocks."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(150), rng.choice([1, 2, 3, 4, 6])):
            words[j] = f"x{i}y{j}"
        texts.append(" ".join(words + words[:7] * (i % 2)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = near_dedup.inverse_frequencies(docs)
    sets = [(h, n, near_dedup.weights(h, n, idf)) for h, n in near_dedup.shingles(texts, near_dedup.SHINGLE)]
    smallest = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if near_dedup.weighted_jaccard(sets[a][0], sets[a][2], sets[b][0], sets[b][2]) >= near_dedup.SIMILARITY:
                x, y = sorted((smallest[a], smallest[b]))
                smallest = [x if v == y else v for v in smallest]
    names = [bytes([i]) for i in range(len(texts))]
    links = near_dedup.block_links([h for h, _, _ in sets], [n for _, n, _ in sets], names, idf)
    assert len(links) < len(texts) and {b[0] for _, b in links} <= set(smallest)
    assert all(smallest[a[0]] == smallest[b[0]] for a, b in links) and len(links) == len(texts) - len(set(smallest))
    assert 2 < len(set(smallest)) < len(texts) - 2
    for size in (512, 5):
        monkeypatch.setattr(near_dedup, "BLOCK", size)
        got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
        assert [got[i] for i in range(len(texts))] == smallest
    ids = docs.select(F.lit(0).alias("band"), F.lit(7).cast("long").alias("key"), near_dedup._text_key(F.col("text")).alias("id"), F.lit(150.0).alias("weight"), near_dedup._text_key(F.col("text")).alias("root"), "doc_id")
    blocks = -(-(len(texts) - 1) // 5) + 1
    assert near_dedup.compared(ids.drop("doc_id"), docs, ids.select("id", "doc_id"), idf).count() <= len(texts) * blocks


def test_samples_agree_like_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 600).astype(np.uint64)
    w = rng.uniform(1, 3, 600).astype(np.float32)
    agree = []
    for i in range(30):
        a, b = np.arange(0, 500), np.arange(100, 600)
        other = w.copy()
        agree.append((near_dedup.samples(h[a] ^ np.uint64(i), w[a]) == near_dedup.samples(h[b] ^ np.uint64(i), other[b])).mean())
    true = w[100:500].sum() / w.sum()
    assert abs(np.mean(agree) - true) < 0.05


def test_components(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(1, 30)] + [(b"z", b"y")], "a binary, b binary")
    got = {bytes(r.id): bytes(r.root) for r in near_dedup.components(links).collect()}
    assert all(got[bytes([i])] == b"\x01" for i in range(1, 31)) and got[b"z"] == got[b"y"] == b"y"


def expected_contamination(texts, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for x, own in windows.items():
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    ids |= own
        yield len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


def test_contamination_against_brute_force(spark, docs, rows, none):
    long = rows[8][1].split()
    items = [(1, " ".join(long[50:75])), (2, "X"), (3, None), (4, "é é"), (5, " ".join(long[60:70]).upper()), (6, "a a a a a a a a a a a a"), (7, "b c")]
    more = spark.createDataFrame([(100, "a " * 30 + "b c b c É é é é"), (100, "a a"), (101, "b  C!x")], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(more)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(table, benchmark).collect())
    plain = [(r.doc_id, r.text) for r in table.collect()]
    want = Counter((d, *e) for (d, _), e in zip(plain, expected_contamination([t for _, t in plain], items)))
    assert got == want
    assert decontaminate.clean(table, benchmark).count() == sum(not e[-1] for e in want.elements())
    assert decontaminate.report(none, benchmark).count() == 0
    assert decontaminate.report(docs, benchmark.where("false")).where("contaminated").count() == 0


def test_personal_base_spans():
    rx = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    keep = [lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")), lambda m: 16 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m)), lambda m: 8 <= len(re.sub(r"\D", "", m)) <= 15]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("a1.@- +()9é"), 40)) for _ in range(3000)] + ["4041894974608795 4041-8949-7460-8795", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "1" * 20000, "a" * 20000 + "@", "+1" + "(" * 20000]
    for t in texts:
        assert personal.base_spans(t) == [(k, m.start(), m.end()) for k in range(4) for m in (re.finditer(rx[k], t) if len(t) < 1000 else []) if keep[k](m[0])]


def test_personal_bootstrap_and_redaction(spark):
    rows = [(i, f"please mail to u{i}@x{i}.com now", 1) for i in range(20)] + [(100 + i, f"please mail to user{i}_at_host{i} now", 1) for i in range(3)] + [(200, None, 1), (201, "", 1), (0, rows0 := "please mail to u0@x0.com now", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in personal.report(docs).collect()}
    assert got[5].n_email == 1 and got[5].n_added == 0 and got[101].n_added == 1 and got[101].spans == "email:15:29" and got[200].spans == "" and rows0
    red = {r.doc_id: r for r in personal.redact(docs).collect()}
    assert red[5].text == "please mail to [email] now" and red[101].text == "please mail to [email] now" and red[5].n_chars == 26 and red[200].text is None
    assert personal.redact(docs).count() == len(rows)


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\<|", "\\n\\|\\\\", "<<||>\n", "", None]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "a\nb\\n", None, "assistant", "user"], nasty))] + [(None, 0, "user", "x"), (2, None, None, None)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id")
    chunks = chat.format_turns(turns, "conv_id")
    back = {(r.conv_id, r.turn): r for r in chat.parse_turns(chunks, "conv_id").collect()}
    for c, i, role, text in rows:
        r = back[c, i]
        assert (r.role, r.text, r.learned) == (role or "", text or "", (text or "") if role == "assistant" else "")
    for r in chat.conversations(chunks, "conv_id").collect():
        assert len(r.loss) == sum(c == r.conv_id and role == "assistant" and bool(t) for c, _, role, t in rows)
    assert chat.report(turns.drop("layout").where("false")).count() == 0


def test_chat_layouts(spark):
    rows = [("1", "p", "c", None, None), ("2", None, None, "do", None), ("3", None, None, None, [("human", "hi"), ("gpt", "yo")])]
    table = spark.createDataFrame(rows, "conv_id string, prompt string, completion string, instruction string, conversations array<struct<from:string,value:string>>")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(table, "conv_id").where("turn IS NOT NULL").collect())
    assert got == [("1", 0, "user", "p"), ("1", 1, "assistant", "c"), ("3", 0, "user", "hi"), ("3", 1, "assistant", "yo")]
    assert chat.canonical_turns(table, "conv_id").where("turn IS NULL").count() == 1


def test_neighbours_small(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8))
    v[50:120] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0]), (0, v[0].tolist())]
    got = {}
    for r in neighbours.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 300, 20):
        s = v @ v[q]
        best = [i for i in np.lexsort((np.arange(300), -np.round(s, 12))) if i != q][:20]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(abs(s[i] - x) < 1e-9 for _, i, x in own)
        hits += len({i for _, i, _ in own} & set(best))
    assert hits >= 0.9 * 20 * 15 and set(got) == set(range(0, 300, 20))


def test_neighbours_recall_with_hundreds_of_lists(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(20_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in neighbours.report(spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 20_000, 20):
        x = v @ v[q]
        x[q] = -2
        hits += len(got[q] & set(np.argpartition(-x, 20)[:20].tolist()))
    assert len(got) == 1000 and hits >= 0.9 * 20 * 1000, hits / 20_000


def test_licenses_inherit(spark):
    text = licenses.TEMPLATES["MIT"]
    rows = [("a/LICENSE", text), ("a/b/c/x.py", "code"), ("a/b/LICENSE", licenses.TEMPLATES["GPL-3.0"]), ("a/y.py", None), ("z/q.py", "nothing"), ("z/h.py", licenses.TEMPLATES["Apache-2.0"] + "\n" + words_of(5, 400)), (None, "x"), ("a/y.py", None)]
    got = sorted(((r.path or "", r.license, r.origin) for r in licenses.inherit(licenses.scan(spark.createDataFrame(rows, "path string, text string"))).collect()), key=str)
    assert got == sorted([("a/LICENSE", "MIT", "own"), ("a/b/c/x.py", "GPL-3.0", "inherited"), ("a/b/LICENSE", "GPL-3.0", "own"), ("a/y.py", "MIT", "inherited"), ("a/y.py", "MIT", "inherited"), ("z/q.py", None, None), ("z/h.py", "Apache-2.0", "own"), ("", None, None)], key=str)


def test_license_statements(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software " + words_of(8, 150)
    bsd = "Copyright X.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted. "
    gnu = "it under the terms of the GNU {}General Public License as published by\n# the Free Software Foundation, either version {} of the License"
    want = [
        ("// SPDX-License-Identifier: BSD-2-Clause\ncode", "BSD-2-Clause"), (gnu.format("", "2"), "GPL-2.0"), (gnu.format("Lesser ", "2.1"), "LGPL-2.1"), (gnu.format("Affero ", "3"), "AGPL-3.0"),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n" + words_of(9, 300), "GPL-3.0"), ("GNU General Public License, version 2", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Copyright 2020 John Smith. Released under the MIT License.", "MIT"), (mit, "MIT"), (bsd, "BSD-2-Clause"), (bsd + "Neither the name of X", "BSD-3-Clause"), ("Mozilla Public License Version 2.0\n" + words_of(7, 90), "MPL-2.0"),
        ("Apache License\n  Version 2.0, January 2004", "Apache-2.0"), ("ISC License\n", "ISC"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), (licenses.TEMPLATES["CC-BY-NC-4.0"], "CC-BY-NC-4.0"), ("the general public, version 2", None), ("He had no license.", None),
    ]
    rows = [(f"f{i}/f", t) for i, (t, _) in enumerate(want)] + [("d/LICENSE", mit), ("d/x.py", "code")]
    got = {r.path: r.license for r in licenses.inherit(licenses.scan(spark.createDataFrame(rows, "path string, text string"))).collect()}
    assert {f"f{i}/f": got[f"f{i}/f"] for i in range(len(want))} == {f"f{i}/f": n for i, (_, n) in enumerate(want)} and got["d/x.py"] == "MIT"


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_automaton_accepts_one_edit():
    rng = np.random.default_rng(6)
    terms = sorted({"".join(rng.choice(list("abc"), rng.integers(2, 8))) for _ in range(30)})
    words = ["".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(2000)]
    codes, begin, end, _ = toxicity.split_words([" ".join(words)])
    word, term, edited = toxicity.build_automaton(terms).run(codes, begin, end)
    got = {int(w): (int(t), bool(e)) for w, t, e in zip(word, term, edited)}
    for i, w in enumerate(words):
        exact = [n for n, t in enumerate(terms) if t == w]
        near = [n for n, t in enumerate(terms) if len(t) >= 5 and distance(t, w) == 1]
        assert got.get(i) == ((exact[0], False) if exact else (near[0], True) if near else None)


def test_automaton_with_swaps():
    rng = np.random.default_rng(7)
    terms = sorted({"".join(rng.choice(list("abc"), rng.integers(2, 8))) for _ in range(30)})
    words = ["".join(rng.choice(list("abcd"), rng.integers(1, 9))) for _ in range(2000)]
    codes, begin, end, _ = toxicity.split_words([" ".join(words)])
    word, term, edited = toxicity.build_automaton(terms, 4, swaps=True).run(codes, begin, end)
    got = {int(w): (int(t), bool(e)) for w, t, e in zip(word, term, edited)}

    def close(t, w):
        return distance(t, w) == 1 or any(t[:i] + t[i + 1] + t[i] + t[i + 2 :] == w for i in range(len(t) - 1))

    for i, w in enumerate(words):
        exact = [n for n, t in enumerate(terms) if t == w]
        near = [n for n, t in enumerate(terms) if len(t) >= 4 and close(t, w)]
        assert got.get(i) == ((exact[0], False) if exact else (near[0], True) if near else None)


def test_toxicity_disguised_terms(spark):
    rows = [(i, words_of(i, 40) + (" you idiot and stupid scum 他是个笨蛋吗 मूर्ख" if i % 4 == 0 else " 他是个好人吗"), int(i % 4 == 0)) for i in range(300)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert set(model.terms) >= {"idiot", "stupid", "scum", "笨蛋", "मूर्ख"}
    texts = ["an id1ot here", "so st*pid", "(st*pid)", "it,id1ot,it", "idoit", "scvm", "sc*m", "那笨蛋走了", "मूर्ख"]
    assert (model.features(texts)[:, 0] > 0).all()
    assert (model.features(["an id 1ot here", "", "id  ot", "那好人走了"])[:, 0] == 0).all()
    assert np.allclose(model.features(["idiot-like", "idiot5"])[:, 0], model.features(["idiot like", "idiot"])[:, 0])


def test_toxicity_keeps_all_terms(spark, monkeypatch):
    terms = sorted({w for w in words_of(9, 90).split() if len(w) > 3})
    rows = [(i, words_of(i, 40).upper().translate(str.maketrans("ABCDEFGHIJ", "klmnopqrst")) + (" " + " ".join(terms[i % 7 :: 3]) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts = [t for _, t, _ in rows[:40]] + terms + [t[:-1] + "z" for t in terms]
    whole = toxicity.train(table)
    monkeypatch.setattr(toxicity, "LEXICON_TERMS", 5)
    small = toxicity.train(table)
    assert len(whole.terms) > 20 and small.terms == whole.terms and len(small.files) > 3
    assert np.allclose(small.features(texts), whole.features(texts)) and np.allclose(small.curve, whole.curve)
    assert np.allclose([r.score for r in toxicity.score(table, small).orderBy("doc_id").collect()], whole.scores([t for _, t, _ in rows]))


def test_toxicity_scores(spark, none):
    rows = [(i, words_of(i, 40) + (" you idiot and stupid moron" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table)
    assert set(model.terms) >= {"idiot", "stupid", "moron"}
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows)
    quoted, plain, misspelled, clean = model.scores(['he called it "idiot" in the report', "what an idiot in the report", "what an idiott stupid in the report", ""])
    assert clean <= quoted < plain < misspelled
    assert toxicity.train(table.where("false")).terms == []
    assert toxicity.score(none, model).count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n not in ("op6_language_id",)])
def test_query_covers_its_table(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    if name.startswith("op2_"):
        assert got.count() == 20 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 20 = 0").count()
    else:
        assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_chat_against_sql(spark, sf_dir):
    from tests.compare import compare, connect

    assert compare(QUERIES["op5_chat_format"](spark, sf_dir), connect(sf_dir), ORACLES["op5_chat_format"]) == []


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = corpus_pipeline.run(spark, sf_dir)
    kept = packed.select("doc_id").distinct().count()
    assert 0.5 * docs.count() < kept < docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), sf_dir).columns == docs.columns
