"""Token ids of whole texts.

The tokenizer is a file of the ``tokenizers`` library, named by its path; nothing is trained or copied. Its files are
opened once per Python worker. For a tokenizer that drops white space before it merges (``word_bpe_49k.json``), the ids of
a text are the ids of its words in turn, so each different word is encoded once per worker and looked up by its 64-bit
hash after that; the cache is bounded, and a word that has left it is simply encoded again. Where the tokenizer parts
punctuation from the letters before it, the punctuation at a word's end is a word of its own, and where it lower-cases,
words of ASCII letters alone are looked up in lower case; both are tried on the tokenizer when it is opened.
``by_word=False`` encodes each text as it is.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tokenledger.llm import words as W

#: Different words a worker remembers.
CACHE_WORDS = 600_000
#: New words are kept apart up to this many, so that the large table is not written again with each chunk.
RECENT_WORDS = 1 << 16
#: Words that are joined and encoded in one call.
CALL_WORDS = 200

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, by_word: bool = True) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


class _Table:
    """Known words by their sorted hashes: where their ids begin, how many they are, and whether they were asked for."""

    def __init__(self):
        self.keys, self.starts, self.counts, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and the places of these."""
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        return known, place[known]

    def add(self, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, used: np.ndarray) -> None:
        place = np.searchsorted(self.keys, keys)
        self.keys, self.starts = np.insert(self.keys, place, keys), np.insert(self.starts, place, starts)
        self.counts, self.used = np.insert(self.counts, place, counts), np.insert(self.used, place, used)

    def keep(self, which: np.ndarray) -> None:
        self.keys, self.starts, self.counts, self.used = self.keys[which], self.starts[which], self.counts[which], np.zeros(int(which.sum()), bool)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, one after another."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _capitals(data: np.ndarray) -> np.ndarray:
    return data - np.uint8(ord("A")) < 26


def _letters(data: np.ndarray) -> np.ndarray:
    return (data | np.uint8(0x20)) - np.uint8(ord("a")) < 26


class Encoder:
    def __init__(self, path: str, by_word: bool = True, cache_words: int = CACHE_WORDS, recent_words: int = RECENT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.by_word, self.cache_words, self.recent_words = by_word, cache_words, min(recent_words, cache_words)
        self.marks, self.folds = self._parted_marks() if by_word else np.zeros(256, bool), by_word and self._lowers()
        self.ends = self._word_ends() if by_word else None
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _added(self) -> list[str]:
        return [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _parted_marks(self) -> np.ndarray:
        """Which punctuation may be cut from the letter before it, alone or followed by other such punctuation.

        An apostrophe begins contractions, and what stands in an added token may be part of one.
        """
        inside = "'" + "".join(self._added())
        alone = {x: self._ids(x) for x in string.ascii_letters}
        parted = [m for m in string.punctuation if m not in inside and all(self._ids(x + m) == alone[x] + self._ids(m) for x in alone)]
        parted = [m for m in parted if all(self._ids("a" + m + n) == alone["a"] + self._ids(m + n) for n in parted)]
        return np.isin(np.arange(256), np.frombuffer("".join(parted).encode(), np.uint8))

    def _lowers(self) -> bool:
        """True if the ids of a word of ASCII letters are those of it in lower case, and no added token is such a word."""
        normal = self.tokenizer.normalizer
        same = normal is not None and normal.normalize_str(string.ascii_letters) == normal.normalize_str(string.ascii_lowercase * 2)
        return same and not any(t.isascii() and t.isalpha() for t in self._added())

    def _word_ends(self) -> np.ndarray | None:
        """Which ids end a piece, if the tokenizer marks them and every byte has such an id."""
        from tokenizers.pre_tokenizers import ByteLevel

        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix or not all(x + suffix in vocab for x in ByteLevel.alphabet()):
            return None
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        return ends

    def _clear(self) -> None:
        self.known, self.recent = _Table(), _Table()
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0

    def _store(self, ids: np.ndarray) -> int:
        """Add ids to the store, which doubles when it is full; returns where they begin."""
        start, self.n_ids = self.n_ids, self.n_ids + len(ids)
        if self.n_ids > len(self.ids):
            grown = np.empty(max(self.n_ids, 2 * len(self.ids)), np.uint32)
            grown[:start] = self.ids[:start]
            self.ids = grown
        self.ids[start : self.n_ids] = ids
        return start

    def _make_room(self, n: int) -> None:
        """Before ``n`` new words: recent words move to the table; a full table keeps the words asked for since it last was full."""
        if len(self.recent) + n <= self.recent_words:
            return
        self.known.add(self.recent.keys, self.recent.starts, self.recent.counts, self.recent.used)
        self.recent = _Table()
        if len(self.known) + n > self.cache_words:
            if self.known.used.sum() + n > self.cache_words:
                return self._clear()
            self.known.keep(self.known.used)
            kept = self.ids[_spread(self.known.starts, self.known.counts)]
            self.known.starts, self.n_ids = np.cumsum(self.known.counts) - self.known.counts, 0
            self._store(kept)

    def _encode_words(self, found: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has; ``letters``: no word has anything else."""
        calls = [found[at : at + CALL_WORDS] for at in range(0, len(found), CALL_WORDS)]
        ids, counts = [], []
        if letters and self.ends is not None:
            # Each piece that the library merges ends in an id of the suffix. A word of letters has a piece at least, so as
            # many pieces as words mean that each word is one.
            for part, encoded in zip(calls, self.tokenizer.encode_batch_fast([" ".join(x) for x in calls], add_special_tokens=False), strict=True):
                x = np.array(encoded.ids, np.uint32)
                last = np.flatnonzero(self.ends[x])
                one = (x, np.diff(last, prepend=-1)) if len(last) == len(part) and last[-1] == len(x) - 1 else self._encode_words(part, False)
                ids.append(one[0])
                counts.append(one[1])
            return np.concatenate(ids), np.concatenate(counts)
        for part in calls:
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.array([b for b, _ in encoded.offsets], np.int64)
            ends = np.cumsum([len(x) + 1 for x in part])
            counts.append(np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(part)))
            ids.append(np.array(encoded.ids, np.uint32))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, chunk: W.Words, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode new words; where their ids begin in the store, and how many they are."""
        found = [x.decode("utf-8", "replace") for x in chunk.gather(at)]
        letters = np.fromiter((x.isalpha() for x in found), bool, len(found))
        begins, counts = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for kind in (True, False):
            these = np.flatnonzero(letters == kind)
            if len(these):
                ids, n = self._encode_words([found[i] for i in these.tolist()], kind)
                begins[these], counts[these] = self._store(ids) + np.cumsum(n) - n, n
        self.recent.add(keys, begins, counts, np.zeros(len(keys), bool))
        return begins, counts

    def _looked_up(self, chunk: W.Words) -> W.Words:
        """The chunk with punctuation cut off and capitals lowered, as far as the tokenizer allows it."""
        data, starts, ends = chunk.data, chunk.starts, chunk.ends
        marked = np.flatnonzero(self.marks[data[ends - 1]])
        if len(marked):
            solid = np.flatnonzero(~self.marks[data])
            before = np.searchsorted(solid, ends[marked]) - 1
            body = np.where(before >= 0, solid[before], -1) + 1 if len(solid) else np.zeros(len(marked), np.int64)
            cut = (body > starts[marked]) & _letters(data[body - 1])
            marked, body = marked[cut], body[cut]
            starts, ends = np.insert(starts, marked + 1, body), np.insert(ends, marked, body)
        if self.folds:
            other = np.zeros(len(data) + 1, np.int32)
            np.cumsum(~_letters(data), out=other[1:])
            capitals = np.flatnonzero(_capitals(data))
            word = np.searchsorted(starts, capitals, "right") - 1
            capitals = capitals[other[ends[word]] == other[starts[word]]]
            data = data.copy()
            data[capitals] |= 0x20
        return W.Words(data, chunk.offsets, starts, ends, np.searchsorted(starts, chunk.offsets), chunk.first)

    def encode_chunk(self, chunk: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunk's rows, one after another, and the bounds of each row."""
        if not self.by_word:
            raw = chunk.data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)]
            lists = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            return np.concatenate([np.array(x, np.uint32) for x in lists]), bounds
        if not len(chunk.starts):
            return np.zeros(0, np.uint32), np.zeros(chunk.rows + 1, np.int64)
        chunk = self._looked_up(chunk)
        unique, at, inverse = np.unique(chunk.hashes(), return_index=True, return_inverse=True)
        self._make_room(len(unique))
        starts, counts, missing = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64), np.arange(len(unique))
        for table in (self.known, self.recent):
            found, place = table.find(unique[missing])
            starts[missing[found]], counts[missing[found]] = table.starts[place], table.counts[place]
            table.used[place] = True
            missing = missing[~found]
        if len(missing):
            starts[missing], counts[missing] = self._learn(chunk, unique[missing], at[missing])
        starts, counts = starts[inverse], counts[inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[_spread(starts, counts)], total[chunk.bounds]

    def rows(self, column: pa.Array, end: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text of a column, with ``end`` appended. A null text has the end alone."""
        tail = [] if end is None else [np.array([end], np.uint32)]
        for chunk in W.each_chunk(column):
            ids, bounds = self.encode_chunk(chunk)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield np.concatenate([ids[a:b], *tail])
