"""Words of whole texts as arrays, for use inside Arrow tasks.

A word is a run of bytes other than the ASCII white space 0x20 and 0x09-0x0D, which is the pattern
``[^\\x20\\x09-\\x0D]+``. Words are cut out of the raw UTF-8 buffer of an Arrow column and hashed to 64 bits, without a
Python object for each word. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone. It bounds the memory of a task, not the work.
CHUNK_BYTES = 256 << 10

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.default_rng(20240229)
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[s:e]`` for each start and end, equal for equal runs wherever they stand."""
    up, down = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of some consecutive rows; ``bounds[i]:bounds[i + 1]`` are the words of row ``i``."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # bytes of row i are data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    first: int  # index of the first row in the column

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return _run_hashes(_LETTER[self.data], self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def gather(self, picked: np.ndarray) -> list[bytes]:
        """The bytes of the words at the given places."""
        raw = self.data.tobytes()
        return [raw[s:e] for s, e in zip(self.starts[picked].tolist(), self.ends[picked].tolist(), strict=True)]


def windows(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``n`` consecutive words within a row, the place of each window's first word, and its row."""
    counts = np.diff(bounds)
    per_row = np.maximum(counts - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), per_row)
    skipped = np.cumsum(counts - per_row) - (counts - per_row)
    at = np.arange(len(row)) + skipped[row]
    return _run_hashes(hashes, at, at + n), at, row


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def split(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Words:
    """Cut texts into words."""
    solid = ~WHITE[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), first)


def each_chunk(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a column's rows, in chunks of whole rows."""
    data, offsets = string_buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, "right")) - 1)
        yield split(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], row)
        row = stop


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the values of each row."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "iu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
