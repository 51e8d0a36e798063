"""Hashed n-gram features of whole texts, for the linear classifiers.

Families: word unigrams and bigrams, word-shape n-grams, and byte n-grams (a character n-gram of ASCII text). A word's
shape is its case pattern, the marks it holds besides letters and digits, and whether it equals the word before; shapes
let a model see junk whose words it never met.
"""

from __future__ import annotations

import numpy as np

from tokenledger.llm import words as W

BITS = 18
FAMILIES = ("word", "bigram", "shape", "shape2", "shape3", "bytes")
BYTES_N = 4

_SALT = {name: np.uint64(0xA24BAED4963EE407 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF) for i, name in enumerate(FAMILIES)}
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)
_MARK[_UPPER | _LOWER | _DIGIT] = 0


def _slot(hashes: np.ndarray, family: str, bits: int) -> np.ndarray:
    return ((hashes * _SALT[family]) >> np.uint64(64 - bits)).astype(np.int32)


def _between(total: np.ndarray, words: W.Words) -> np.ndarray:
    return total[words.ends] - total[words.starts]


def shapes(words: W.Words, hashes: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    data = words.data

    def summed(table, kind):
        total = np.zeros(len(data) + 1, kind)
        np.cumsum(table[data], out=total[1:])
        return _between(total, words)

    upper, lower = summed(_UPPER, np.int32), summed(_LOWER, np.int32)
    marks = summed(_MARK, np.uint64)  # which marks and how many, in any order
    case = (upper > 0) + 2 * (lower > 0) + 4 * (upper > 1) + 8 * (summed(_DIGIT, np.int32) > 0)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    first = words.bounds[:-1][words.counts > 0]
    same[first] = False
    return W.mix(case.astype(np.uint64) + np.uint64(16) * same.astype(np.uint64) + marks * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def extract(words: W.Words, bits: int = BITS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """``(family, slots, bounds)``: the slots of row ``i`` are ``slots[bounds[i]:bounds[i + 1]]``, repeats included."""
    hashes = words.hashes()
    shape = shapes(words, hashes)
    out = [("word", _slot(hashes, "word", bits), words.bounds), ("shape", _slot(shape, "shape", bits), words.bounds)]
    for family, source, n in (("bigram", hashes, 2), ("shape2", shape, 2), ("shape3", shape, 3)):
        grams, _, _ = W.windows(source, words.bounds, n)
        per_row = np.maximum(words.counts - n + 1, 0)
        out.append((family, _slot(grams, family, bits), np.concatenate([[0], np.cumsum(per_row)])))
    data = words.data
    if len(data) >= BYTES_N:
        code = data[: len(data) - BYTES_N + 1].astype(np.uint32)
        for k in range(1, BYTES_N):
            code |= data[k : len(data) - BYTES_N + 1 + k].astype(np.uint32) << np.uint32(8 * k)
        slots = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32)
    else:
        slots = np.zeros(0, np.int32)
    # Grams that begin in a row and end in the next are left out.
    lengths = np.diff(words.offsets)
    per_row = np.maximum(lengths - BYTES_N + 1, 0)
    keep = np.ones(len(slots), bool)
    for k in range(1, BYTES_N):
        at = words.offsets[1:-1] - k
        at = at[(at >= 0) & (at < len(slots))]
        keep[at] = False
    out.append(("bytes", slots[keep], np.concatenate([[0], np.cumsum(per_row)])))
    return out
