"""Token ids in files, coded by a static range asymmetric numeral system.

``write`` lays out a folder:

* ``table``: one row, the frequency of every id, summing to ``2**SCALE``; all blocks share it. It is made from counts over
  the whole corpus and its size is bounded by the vocabulary.
* ``blocks``: one row per block of whole documents (at least ``BLOCK_IDS`` ids, unless the partition ends). A block is
  coded on its own, in interleaved lanes: id ``i`` belongs to lane ``i % lanes``, and each step codes one id of every lane.
  It holds the ids and lengths of its documents, the coded 32-bit words, and checkpoints: every ``CHECKPOINT_STEPS`` steps
  the lanes' states and the place in the words, so that several readers can decode parts of one block. Each checkpointed
  part has a checksum of its ids.
* ``parts``: for each partition, the ids in the partitions before it.

Blocks are records of Parquet files, so they are committed like any Spark output, lie in any store Spark reaches, and are
decoded in parallel. Partitions are ranges of doc_id in ascending order (null first), and ``start`` counts the ids of all
documents before, from one total per partition.

Edge cases: a null or blank text is the end id alone; repeated doc_ids stay separate, in the order of their ids; a null
doc_id stays null; an empty table gives an empty folder and no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.llm.tables import stage
from tokenledger.llm.tokens import encoder

END = 2
#: Frequencies sum to 2**SCALE; states stay in [2**31, 2**63) and give off 32-bit words.
SCALE = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
LANES = 512
BLOCK_IDS = 1 << 17
CHECKPOINT_STEPS = 128

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_BLOCK = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("lanes", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
        ("words", pa.binary()), ("states", pa.binary()), ("word_at", pa.list_(pa.int64())), ("checksums", pa.list_(pa.int64())),
    ]
)
BLOCK = (
    "part int, block int, start_in_part long, n_ids long, lanes int, doc_ids array<long>, doc_lengths array<long>, "
    "words binary, states binary, word_at array<long>, checksums array<long>"
)
_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to ``2**scale``, at least 1 for each id that occurs."""
    total, goal = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.uint64)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * goal // total), 0).astype(np.int64)
    excess = int(freq.sum()) - goal
    if excess < 0:
        freq[np.argmax(freq)] -= excess
    while excess > 0:  # rare ids were rounded up to 1; take it from the most frequent
        order = np.argsort(-freq)[: max(1, min(excess, int((freq > 1).sum())))]
        take = np.minimum(freq[order] - 1, np.maximum(1, excess // len(order)))
        take = np.where(np.cumsum(take) <= excess, take, 0)
        freq[order] -= take
        excess -= int(take.sum())
    return freq.astype(np.uint64)


def lanes_for(n: int, most: int = LANES) -> int:
    """Lanes of a block of ``n`` ids: a power of two, fewer for short blocks so that states do not outweigh words."""
    lanes = 1
    while lanes < most and lanes * 2 * 64 <= n:
        lanes *= 2
    return lanes


def encode_block(ids: np.ndarray, freq: np.ndarray, base: np.ndarray, lanes: int, scale: int = SCALE) -> dict:
    """Code one block. Steps run backwards, so that decoding runs forwards."""
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW)
    up = np.uint64(scale)
    limit = freq << np.uint64(63 - scale)
    given, states, word_at, written = [], [], [], 0
    for t in range(steps - 1, -1, -1):
        symbol = ids[t * lanes : (t + 1) * lanes]
        x, f = state[: len(symbol)], freq[symbol]
        over = x >= limit[symbol]
        if over.any():
            out = (x[over] & np.uint64(0xFFFFFFFF)).astype("<u4")
            given.append(out)
            written += len(out)
            x = np.where(over, x >> WORD, x)
        quotient = x // f
        state[: len(symbol)] = (quotient << up) + (x - quotient * f) + base[symbol]
        if t % CHECKPOINT_STEPS == 0:
            states.append(state.copy())
            word_at.append(written)
    words = np.concatenate(given[::-1]) if given else np.zeros(0, "<u4")
    checks = [zlib.crc32(ids[a : a + CHECKPOINT_STEPS * lanes].astype("<u4").tobytes()) for a in range(0, len(ids), CHECKPOINT_STEPS * lanes)]
    return {
        "words": words.tobytes(),
        "states": np.concatenate(states[::-1]).astype("<u8").tobytes() if states else b"",
        "word_at": [written - w for w in word_at[::-1]],
        "checksums": checks,
    }


def decode_block(block: dict, freq: np.ndarray, base: np.ndarray, symbols: np.ndarray, scale: int = SCALE, parts: range | None = None) -> np.ndarray:
    """The ids of a block, or of some of its checkpointed parts; a wrong checksum is an error."""
    n, lanes = block["n_ids"], block["lanes"]
    words = np.frombuffer(block["words"], "<u4").astype(np.uint64)
    states = np.frombuffer(block["states"], "<u8").reshape(-1, lanes)
    mask, up, size = np.uint64((1 << scale) - 1), np.uint64(scale), CHECKPOINT_STEPS * lanes
    out = []
    for k in range(len(states)) if parts is None else parts:
        state, at = states[k].copy(), block["word_at"][k]
        ids = np.empty(min(size, n - k * size), np.uint32)
        for a in range(0, len(ids), lanes):
            width = min(lanes, len(ids) - a)
            x = state[:width]
            slot = x & mask
            symbol = symbols[slot]
            ids[a : a + width] = symbol
            x = freq[symbol] * (x >> up) + slot - base[symbol]
            under = np.flatnonzero(x < LOW)
            if len(under):
                x[under] = (x[under] << WORD) | words[at : at + len(under)]
                at += len(under)
            state[:width] = x
        if zlib.crc32(ids.astype("<u4").tobytes()) != block["checksums"][k]:
            raise ValueError(f"part {k} of block {block.get('part')}/{block.get('block')} does not match its checksum")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids on their way to a file: a byte for the width, then 2 or 4 bytes for each id."""
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if narrow else b"\4") + ids.astype("<u2" if narrow else "<u4").tobytes()


def unpack_ids(raw: pa.Scalar) -> np.ndarray:
    buffer = raw.as_buffer()
    return np.frombuffer(buffer, "<u2" if buffer[0] == 2 else "<u4", offset=1).astype(np.uint32)


def encode_ids(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """``(doc_id, ids)``: the ids of whole texts with ``end`` appended, as ``pack_ids`` writes them. No shuffle."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            ids = pa.array((pack_ids(x) for x in encode.rows(batch.column("text"), end)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), ids], schema=_IDS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, "doc_id long, ids binary")


def count_ids(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole corpus; one number per id reaches the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                found = np.bincount(unpack_ids(raw), minlength=len(counts))
                found[: len(counts)] += counts
                counts = found
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    total = ids.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(total["id"].max()) + 1 if len(total) else 0, np.int64)
    counts[total["id"].to_numpy(np.int64)] = total["n"].to_numpy(np.int64)
    return counts


def write(ids: DataFrame, path: str) -> None:
    """Write ``(doc_id, ids)`` in ascending order of doc_id to ``path``. ``ids`` is read twice, so pass a stored table."""
    spark = ids.sparkSession
    freq = frequencies(count_ids(ids))
    base = np.cumsum(freq, dtype=np.uint64) - freq
    row = pa.table({"scale": pa.array([SCALE], pa.int32()), "freq": pa.array([freq.astype("<u4").tobytes()], pa.binary())})
    spark.createDataFrame(row).coalesce(1).write.mode("overwrite").parquet(f"{path}/table")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def close() -> pa.RecordBatch:
            block = np.concatenate(held)
            lanes = lanes_for(len(block))
            row = {"part": part, "block": number, "start_in_part": start, "n_ids": len(block), "lanes": lanes, "doc_ids": list(names), "doc_lengths": [len(x) for x in held]}
            return pa.RecordBatch.from_pylist([row | encode_block(block, freq, base, lanes)], schema=_BLOCK)

        size = 0
        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                held.append(unpack_ids(raw))
                names.append(name)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield close()
                    number, start, size, held, names = number + 1, start + size, 0, [], []
        if held:
            yield close()

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(coded, BLOCK).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    totals = spark.read.schema(BLOCK).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("ids_of_part"))
    running = F.sum("ids_of_part").over(Window.orderBy("part")) - F.col("ids_of_part")
    totals.select("part", running.alias("before")).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")


def _table(spark: SparkSession, path: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    row = spark.read.parquet(f"{path}/table").first()
    freq = np.frombuffer(row["freq"], "<u4").astype(np.uint64)
    return row["scale"], freq, np.cumsum(freq, dtype=np.uint64) - freq, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def _placed_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks and ``before``, the ids in earlier partitions. The table of partitions is small and read from its file,
    so Spark sees its size and leaves the blocks where they are."""
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks").join(spark.read.schema("part int, before long").parquet(f"{path}/parts"), "part")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document, from the files alone."""
    return _read(spark, path, "doc_id long, start long, ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone."""
    return _read(spark, path, "doc_id long, start long, ids_crc32 long, n_tokens long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64()).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


def _read(spark: SparkSession, path: str, schema: str, result, kind: pa.DataType) -> DataFrame:
    scale, freq, base, symbols = _table(spark, path)
    column = schema.split(",")[2].split()[0]
    counted = "n_tokens" in schema

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                ids = decode_block(block, freq, base, symbols, scale)
                lengths = np.array(block["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                values = [result(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                fields = {"doc_id": pa.array(block["doc_ids"], pa.int64()), "start": pa.array(begins + block["start_in_part"] + block["before"]), column: pa.array(values, kind)}
                yield pa.RecordBatch.from_pydict(fields | ({"n_tokens": pa.array(lengths)} if counted else {}))

    return _placed_blocks(spark, path).mapInArrow(decoded, schema)


def store(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode the texts and write their files to ``path``; texts are tokenized once."""
    write(stage(encode_ids(docs, tokenizer, end), "token-ids"), path)
