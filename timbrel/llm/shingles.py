"""Hashed word shingles of whole texts, as arrays."""

from __future__ import annotations

import numpy as np

from .common import code_points, mix

_FOLD: list[np.ndarray] = []
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _folded() -> np.ndarray:
    """Code of the lower-case character for letters and digits, 0 for all others."""
    out = np.zeros(0x110000, dtype=np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, case ignored) of texts, and the number of words of each."""
    if not _FOLD:
        _FOLD.append(_folded())
    codes = _FOLD[0][code_points("\n".join(texts) + "\n")]
    within = codes != 0
    begins = within.copy()
    begins[1:] &= ~within[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.arange(len(codes)) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
    place[~within] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE))
    words = mix(np.add.reduceat(codes * powers[place], starts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def shingles(texts: list[str], size: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Different shingles of each text, ascending, and how often each occurs; a text of fewer words is one shingle, one without words has none."""
    words, counts = word_hashes(texts)
    if not len(words):
        return [(words, np.zeros(0, np.int64))] * len(texts)
    run = np.zeros(len(words), np.uint64)
    for i in range(min(size, len(words))):
        run[: len(words) - i] = mix(run[: len(words) - i] + words[i:] + np.uint64(i + 1))
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            own = run[at : at + n - size + 1]
        elif n:
            one = np.zeros(1, np.uint64)
            for i in range(n):
                one = mix(one + words[at + i : at + i + 1] + np.uint64(i + 1))
            own = mix(one + np.uint64(n))
        else:
            own = words[:0]
        out.append(np.unique(own, return_counts=True))
        at += n
    return out
