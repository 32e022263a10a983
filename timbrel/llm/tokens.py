"""Token ids of whole texts by public vocabularies, through a bounded table of encoded pieces.

Both vocabularies split a text at white space before they merge anything, so the ids of a text are
the ids of its pieces in order.  Pieces repeat (words), so each is encoded once and looked up after.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space characters, as the vocabularies' patterns know them; fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Pieces kept in memory by one worker; the table is emptied when full.
KEPT_PIECES = 800_000
#: A piece of more characters is encoded each time and not kept.
LONG_PIECE = 64
#: Pieces encoded by one call, with the vocabulary's end mark between them.
JOINED = 60
#: Marks the first piece of a text, which has no blank before it.
FIRST = "\x01"
#: A short piece without white space and marks: independent of its neighbours and kept.
SIMPLE = re.compile(rf"[^\s<{FIRST}]{{1,{LONG_PIECE}}}")
#: Stands as a piece of its own between pieces without it, where white space only separates.
BAR = "|"
#: Vocabularies with these rules know lower case only and end a token between a letter or digit and a mark, so
#: the ids of a piece are those of its word in lower case and of the marks behind it.
FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that are cut off the end of a piece, and the characters behind which that is done (not İ: in lower case it
#: ends in a dot that joins the marks).
TAIL = "!\"#$%&()*+,-./:;=?@[]^_`{|}~"
BEFORE_TAIL = frozenset(c for c in map(chr, [*range(128), *range(0xC0, 0x250)]) if c.isdigit() or c.lower().isalpha())
#: Whether a piece is cut behind two bytes.
BORDER = np.zeros((256, 256), bool)
for _c in (c.encode() for c in BEFORE_TAIL):
    BORDER[_c[0] if len(_c) > 1 else slice(None), _c[-1]] = True
#: Words that those rules leave as they are, each one token before merges.
PLAIN = re.compile(rf"[a-zß-öø-ÿ]{{1,{LONG_PIECE}}}")


def _strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def words_and_marks(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each piece (large_string) without the marks that end it, in lower case if that is ASCII, and those marks."""
    if not len(pieces):
        return pieces, pieces
    at = np.frombuffer(pieces.buffers()[1], "<i8")[: len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[: at[-1]]
    kept = pc.binary_length(pc.ascii_rtrim(pieces, TAIL)).to_numpy()
    end = at[:-1] + kept
    padded = np.concatenate([np.zeros(2, np.uint8), data])  # an end at 0 has no bytes before it
    kept = np.where((kept > 0) & BORDER[padded[end], padded[end + 1]], kept, np.diff(at))
    cut = np.diff(at) - kept
    own = np.repeat(np.tile([True, False], len(pieces)), np.column_stack([kept, cut]).ravel())
    words = data[own]
    wide = np.concatenate([[0], np.cumsum(words >= 128)])
    upto = np.cumsum(kept)
    low = np.repeat(wide[upto] == wide[upto - kept], kept) & (words >= ord("A")) & (words <= ord("Z"))
    return _strings(kept, words + low.astype(np.uint8) * np.uint8(32)), _strings(cut, data[~own])


class Encoder:
    """Ids of texts by one vocabulary file; control strings in a text count as ordinary text.

    joins_blank: a piece takes the blank before it along (byte-level vocabulary); otherwise white
    space only separates.
    """

    def __init__(self, path: str, joins_blank: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.marked = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.marked.token_to_id(self.mark)
        self.controls = [t.content for t in self.marked.get_added_tokens_decoder().values()]
        self.joins_blank = joins_blank
        # the byte of the bar is part of no other character, so its id marks the ends of pieces
        bar = [] if joins_blank else self.plain.encode(BAR, add_special_tokens=False).ids
        self.bar_id = bar[0] if len(bar) == 1 else None
        # words without anything to fold or split need only the blanks and the merges
        self.cuts_marks, self.merges = not joins_blank and self._folds(), None
        if self.cuts_marks and self.bar_id is not None:
            self.merges = Tokenizer.from_file(path)
            self.merges.normalizer = None
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}

    def _folds(self) -> bool:
        folding, split = self.plain.normalizer, self.plain.pre_tokenizer
        if folding is None or split is None or json.loads(folding.__getstate__()) != FOLDING:
            return False
        first, *rest = json.loads(split.__getstate__()).get("pretokenizers", [None])
        wanted = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        return first == wanted and [(r["type"], r.get("use_regex"), r.get("add_prefix_space")) for r in rest] == [("ByteLevel", False, False)]

    def pieces(self, text: str) -> list[str] | None:
        """Keys of the pieces, or None where blanks are laid so that pieces depend on each other."""
        if not self.joins_blank:
            return text.replace("\n", " ").split(" ")
        if FIRST in text:
            return None
        return (FIRST + text.replace("\n", " \n")).split(" ")

    def as_text(self, key: str) -> str | None:
        """What a key stands for in the text; None for a piece that isn't independent of its neighbours."""
        if not self.joins_blank:
            return key
        body = key[1:] if key[:1] in (FIRST, "\n") else key
        if not body or body[0] in WHITE or body[-1] in WHITE:
            return None
        return body if key[0] == FIRST else key if key[0] == "\n" else " " + key

    def whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, keys: Iterable[str]) -> tuple[set[str], set[str]]:
        """Encode new pieces; returns the keys that aren't independent, and those not to be kept."""
        bad, long, some, barred, odd, odd_texts = set(), set(), [], [], [], []
        simple, bars = SIMPLE.fullmatch, self.bar_id is not None
        between = f" {BAR} "
        if self.merges is not None:
            keys = set(keys)
            merged = list(filter(PLAIN.fullmatch, keys))
            keys.difference_update(merged)
            self._tabulate(merged, [between.join(merged[i : i + JOINED]) for i in range(0, len(merged), JOINED)], self.merges, self.bar_id)
        for key in keys:
            if simple(key):
                (barred if bars and BAR not in key else some).append(key)
                continue
            text = self.as_text(key)
            if text is None:
                bad.add(key)
            elif len(key) > LONG_PIECE or any(c in key for c in self.controls):
                self.known[key] = self.whole(text)
                long.add(key)
            else:
                odd.append(key)
                odd_texts.append(text)
        lead = " " if self.joins_blank else ""
        self._tabulate(barred, [between.join(barred[i : i + JOINED]) for i in range(0, len(barred), JOINED)], self.plain, self.bar_id)
        self._tabulate(some, [lead + (self.mark + lead).join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)])
        self._tabulate(odd, [self.mark.join(odd_texts[i : i + JOINED]) for i in range(0, len(odd), JOINED)])
        return bad, long

    def _tabulate(self, keys: list[str], joined: list[str], vocabulary=None, mark_id: int | None = None) -> None:
        """Enter the ids of keys; each joined text holds JOINED of them, with marks between."""
        mark_id = self.mark_id if mark_id is None else mark_id
        for i, found in enumerate((vocabulary or self.marked).encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            marks = np.flatnonzero(ids == mark_id) * 4
            data = ids.tobytes()
            cuts = zip([0, *(marks + 4).tolist()], [*marks.tolist(), len(data)], strict=True)
            self.known.update(zip(keys[i * JOINED : (i + 1) * JOINED], [data[a:b] for a, b in cuts], strict=True))

    def encode_words(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (large_string) where white space only separates: Arrow finds the different pieces and lays out their ids."""
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        parts = words_and_marks(coded.dictionary) if self.cuts_marks else (coded.dictionary,)
        parts = [p.dictionary_encode() for p in parts]
        names = [p.dictionary.to_numpy(zero_copy_only=False).tolist() for p in parts]
        ids = [list(map(self.known.get, own)) for own in names]
        new = {k for own, found in zip(names, ids, strict=True) for k, x in zip(own, found, strict=True) if x is None}
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known = {k: x for own, found in zip(names, ids, strict=True) for k, x in zip(own, found, strict=True) if x is not None}
        _, long = self.learn(new)
        known = self.known
        ids = [[known[k] if x is None else x for k, x in zip(own, found, strict=True)] for own, found in zip(names, ids, strict=True)]
        laid = [pa.array(own, pa.large_binary()).take(p.indices) for own, p in zip(ids, parts, strict=True)]
        whole = pc.binary_join_element_wise(*laid, pa.scalar(b"", pa.large_binary())).take(coded.indices)
        for key in long:
            del known[key]
        at = np.frombuffer(whole.buffers()[1], "<i8")[pieces.offsets.to_numpy()].tolist()
        data = memoryview(whole.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.joins_blank:
            return self.encode_words(pa.array(texts, pa.large_string())) if texts else []
        parts = [self.pieces(t) for t in texts]
        all_keys = set().union(*(p for p in parts if p is not None))
        new = all_keys.difference(self.known)
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known = {}
            new = all_keys
        bad, long = self.learn(new)
        get = self.known.__getitem__
        out = [
            self.whole(t) if p is None or (bad and not bad.isdisjoint(p)) else b"".join(map(get, p))
            for t, p in zip(texts, parts, strict=True)
        ]
        for key in long:
            del self.known[key]
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, joins_blank: bool) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if (path, joins_blank) not in _ENCODERS:
        _ENCODERS[path, joins_blank] = Encoder(path, joins_blank)
    return _ENCODERS[path, joins_blank]
