"""Best-fit packing with certified bin counts.

Documents become token ids; only those longer than a sequence are cut. Pieces are dealt to partitions by a hash and each
partition is packed best-fit decreasing. Dual feasible functions give a lower bound on the bins any packing of the
partition needs; where the count meets the bound, the partition is certified. Partitions with a gap, and the one worst
filled bin of each certified partition, give their loosely filled bins to a pool, whose bins are dealt to fewer partitions
and packed again. Bins move whole, so a partition of the pool knows how many bins its pieces had and keeps the old packing
when the new one is no better.

Edge cases: a null or blank text is the end id alone. Repeated rows are separate pieces with the same doc_id and piece.
A null doc_id stays null. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.tables import size_of, stage
from tokenledger.llm.tokens import encoder

CAPACITY = 4096
END = 1
#: Pieces in a partition, which bounds the memory and time of a task.
PARTITION_PIECES = 20_000
#: Bins filled to less than this share are given up by a partition with a gap.
LOOSE = 0.995
ROUNDS = 4

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = _PIECE.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64())).append(pa.field("loose", pa.bool_()))
PLACED = f"{PIECE}, sequence_id long, offset long, loose boolean"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of whole texts. No shuffle; texts stay in their task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode.rows(batch.column("text"), end)):
                raw = memoryview(ids.astype("<u4").tobytes())
                for k, at in enumerate(range(0, len(ids), capacity)):
                    n = min(capacity, len(ids) - at)
                    row.append(i), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
            ids_of = batch.column("doc_id").take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [ids_of.cast(pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], schema=_PIECE
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, by best-fit decreasing; ties go to the bin opened last."""
    bins = np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}
    mask = opened = 0  # bit r of the mask: some bin has room r
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = mask >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            stack = room[left]
            b = stack.pop()
            if not stack:
                mask ^= 1 << left
        else:
            b, left, opened = opened, capacity, opened + 1
        bins[i] = b
        left -= n
        if left:
            room.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the area, the threshold and the rounding dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    above = np.cumsum(count[::-1])[::-1]  # lengths of at least i
    area = np.concatenate([[0], np.cumsum(count * size)])
    for t in range(1, capacity // 2 + 1):  # lengths over capacity - t count as whole bins, those under t as nothing
        whole = int(above[capacity - t + 1])
        middle = int(area[capacity - t + 1] - area[t])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 21):  # lengths are rounded down to k-ths of a bin, in k + 1 steps; exact multiples stay
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, capacity * (scaled // capacity))  # in 1 / (k * capacity) bins
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _offsets(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    begins = ends - lengths[order]
    sorted_bins = bins[order]
    first = np.concatenate([[True], sorted_bins[1:] != sorted_bins[:-1]])
    base = np.repeat(begins[first], np.diff(np.concatenate([np.flatnonzero(first), [len(order)]])))
    out = np.zeros(len(lengths), np.int64)
    out[order] = begins - base
    return out


def _pack(table: pa.Table, capacity: int, round_: int) -> pa.Table:
    """Pack one partition: new sequence ids and offsets, or the old ones where they are as good."""
    lengths = table.column("length").to_numpy().astype(np.int64)
    part = table.column("part")[0].as_py()
    # The order of rows in a group is not fixed; sort, so that reruns agree.
    order = np.lexsort((table.column("ids_crc32").to_numpy(), table.column("piece").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), -lengths))
    table, lengths = table.take(pa.array(order)), lengths[order]
    bins = best_fit(lengths, capacity)
    used, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
    offsets, sequence = _offsets(lengths, bins), (round_ << 56) + (part << 24) + bins
    if round_:
        old = table.column("sequence_id").to_numpy()
        seen, group = np.unique(old, return_inverse=True)
        if len(seen) <= used:
            bins, used, sequence, offsets = group, len(seen), old, table.column("offset").to_numpy()
    fill = np.bincount(bins, lengths, minlength=used)
    loose = fill < LOOSE * capacity if used > bound else np.arange(used) == np.argmin(fill)
    if used == bound and fill.min() == capacity:
        loose[:] = False
    columns = [table.column(f.name) for f in _PIECE] + [pa.array(sequence), pa.array(offsets), pa.array(loose[bins])]
    return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=_PLACED)


def _packer(capacity: int, round_: int):
    def packed(table: pa.Table) -> pa.Table:
        return _pack(table, capacity, round_)

    return packed


def pack(pieces_: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Place each piece: ``sequence_id`` and gapless ``offset``.

    Each round writes its table to the shared folder, so a lost executor costs one round at most. Only narrow rows move.
    """
    open_ = stage(pieces_, "pack-pieces")
    done: list[DataFrame] = []
    for r in range(rounds):
        rows = size_of(open_)
        if not rows:
            break
        parts = -(-rows // partition_pieces)
        key = F.hash(F.col("sequence_id")) if r else F.hash("doc_id", "piece", "ids_crc32")
        dealt = open_.withColumn("part", F.pmod(key, F.lit(parts)).cast("long"))
        placed = stage(dealt.groupBy("part").applyInArrow(_packer(capacity, r), PLACED), f"pack-{r}")
        if parts == 1 or r == rounds - 1:
            done.append(placed)
            break
        done.append(placed.filter("not loose"))
        open_ = placed.filter("loose").drop("loose")
    if not done:
        return open_.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("loose")
