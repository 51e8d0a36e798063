"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target set of documents and of all documents, have the same order, smoothing, cut-off and
vocabulary. A text's score is its loss per token under the target model less that under the background model; lower is
more like the target.

Counts are exact and cover all documents: every word and pair seen at least ``LEAST`` times counts, at every size; all other
words are one unknown word, and other pairs count as unseen in both models. No model is gathered: texts are stored as blocks
of word numbers, each block asks for the counts of its different words, then of its different pairs, and the answers come
back to the block. Requests are cut by ranges of the hash, so a task gets about as many keys at every size and a frequent key
is one entry a block. The blocks are stored in buckets and do not move again; only requests and answers do.

p(w) = (c(w) + 1) / (N + V), p(w | v) = (c(v, w) + MASS p(w)) / (c(v) + MASS); the first word of a text follows a start mark.

Edge cases: a null or blank text has no tokens and losses and score 0. Without target documents the target model is
uniform over the vocabulary. Repeated rows count and score each time. An empty table gives an empty table; only ``doc_id``
and ``text`` are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import words as W
from tokenledger.llm.tables import join_checked, stage
from tokenledger.session import bucketed

LEAST = 2
MASS = 10.0
#: Tokens of a block (and one text more), and keys that a task counts at once.
BLOCK_TOKENS = 750_000
SLICE_KEYS = 1_000_000


def marked(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``(doc_id, text, target)``: whether a document's id is one of the target's."""
    ids = target_ids.select(F.col("doc_id").cast("long").alias("target_id")).filter("target_id is not null").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = join_checked(rows, ids, rows["doc_id"] == ids["target_id"], "left")
    return joined.select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))


_BLOCK = "block long, doc_ids array<long>, n_tokens long, n_target long, s_all long, s_target long, n_words long, counts binary, target binary, words binary, seen binary, tokens binary"
_ANSWER = "block long, slice long, in_target binary, in_all binary, size long, sum_target long, sum_all long"
_UNKNOWN, _START = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all of them, compressed."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b"")


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(raw[8:], 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(n)


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _blocks(rows: DataFrame) -> DataFrame:
    """The texts as blocks of word numbers, in buckets by block; a block's words are numbered by falling frequency."""

    def made(number: int, ids: list, counts: list, target: list, hashes: list) -> pa.RecordBatch:
        counts_, target_ = np.concatenate(counts), np.concatenate(target)
        words, inverse, seen = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        rank = np.empty(len(words), np.int32)
        rank[np.argsort(-seen, kind="stable")] = np.arange(len(words), dtype=np.int32)
        used = counts_ > 0
        one = {
            "block": TaskContext.get().partitionId() << 32 | number, "doc_ids": pa.concat_arrays(ids).to_pylist(), "n_tokens": int(counts_.sum()), "n_target": int(counts_[target_].sum()),
            "s_all": int(used.sum()), "s_target": int((used & target_).sum()), "n_words": len(words), "counts": _packed(counts_), "target": _packed(target_),
            "words": _packed(_gaps(words)), "seen": _packed(seen), "tokens": _packed(rank[inverse]),
        }
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.list_(pa.int64()) if k == "doc_ids" else pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in one.items()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, ([], [], [], [])
        for batch in batches:
            for part in W.each_chunk(batch.column("text")):
                flags = batch.column("target").slice(part.first, part.rows).to_numpy(zero_copy_only=False).astype(bool)
                for parts, x in zip(held, (batch.column("doc_id").slice(part.first, part.rows), part.counts, flags, part.hashes()), strict=True):
                    parts.append(x)
                if sum(map(len, held[3])) >= BLOCK_TOKENS:
                    yield made(number, *held)
                    number, held = number + 1, ([], [], [], [])
        if held[0]:
            yield made(number, *held)

    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(rows.mapInArrow(cut, _BLOCK), "lm-blocks", ["block"], buckets)


@dataclass
class _Block:
    """A stored block: words sorted by hash, the place among them of each token, and what the texts are."""

    counts: np.ndarray
    target: np.ndarray  # of each token
    words: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Block:
        counts = _unpacked(row["counts"]).astype(np.int64)
        order = np.argsort(-_unpacked(row["seen"]).astype(np.int64), kind="stable").astype(np.int32)
        target = np.repeat(_unpacked(row["target"]).astype(bool), counts)
        return cls(counts, target, np.cumsum(_unpacked(row["words"]), dtype=np.uint64), order[_unpacked(row["tokens"]).astype(np.int32)])

    def pairs(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of each token and of the one before it (words, then the unknown word, then the start mark), the
        hashes of the different pairs, sorted, and each token's place among them."""
        n = len(self.words)
        number = np.where(known, np.arange(n, dtype=np.int32), np.int32(n))[self.tokens]
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = n + 1
        codes, inverse = np.unique(before.astype(np.int64) * (n + 2) + number, return_inverse=True)
        hashes = np.concatenate([self.words, [_UNKNOWN, _START]])
        keys = W.mix(W.mix(hashes[codes // (n + 2)]) + hashes[codes % (n + 2)])
        order = np.argsort(keys, kind="stable").astype(np.int32)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return number, before, keys[order], place[inverse]


_REQUEST = "slice long, block long, keys binary, in_target binary, in_all binary"


def _requests(block: _Block, number: int, keys: np.ndarray, at: np.ndarray, slices: int) -> pa.Table:
    """``_REQUEST``: a block's different keys and their counts there, cut by ranges."""
    borders = np.array([-(-(i << 64) // slices) for i in range(1, slices)], np.uint64)
    seen, target = (np.bincount(x, minlength=len(keys)).astype(np.int32) for x in (at, at[block.target]))
    cuts = [0, *np.searchsorted(keys, borders).tolist(), len(keys)]
    out = [(s, number, _packed(_gaps(keys[a:b])), _packed(target[a:b]), _packed(seen[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
    kinds = {"slice": pa.int64(), "block": pa.int64(), "keys": pa.binary(), "in_target": pa.binary(), "in_all": pa.binary()}
    return pa.table({k: pa.array([x[i] for x in out], kind) for i, (k, kind) in enumerate(kinds.items())})


def _answers(asked: DataFrame, least: int, name: str) -> DataFrame:
    """For each request the counts of its keys in the corpus, 0 for those seen less than ``least`` times. Under no block:
    how many keys a slice keeps, and their counts."""

    def counted(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.cumsum(_unpacked(r["keys"]), dtype=np.uint64) for r in rows]
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        inverse = inverse.astype(np.int32)
        sums = []
        for c in ("in_target", "in_all"):
            total, at = np.zeros(len(unique), np.int64), 0
            for row, own in zip(rows, keys, strict=True):
                total[inverse[at : at + len(own)]] += _unpacked(row[c]).astype(np.int64)  # a request's keys differ
                at += len(own)
            sums.append(total)
        kept = sums[1] >= least
        out = [(None, rows[0]["slice"], None, None, int(kept.sum()), int(sums[0][kept].sum()), int(sums[1][kept].sum()))]
        sums = [np.where(kept, x, 0) for x in sums]
        at = 0
        for row, own in zip(rows, keys, strict=True):
            places = inverse[at : at + len(own)]
            out.append((row["block"], row["slice"], *[_packed(x[places]) for x in sums], None, None, None))
            at += len(own)
        kinds = {"block": pa.int64(), "slice": pa.int64(), "in_target": pa.binary(), "in_all": pa.binary(), "size": pa.int64(), "sum_target": pa.int64(), "sum_all": pa.int64()}
        return pa.table({k: pa.array([x[i] for x in out], kind) for i, (k, kind) in enumerate(kinds.items())})

    return stage(asked.groupBy("slice").applyInArrow(counted, _ANSWER), name)


def _joined(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's answers in the order of its keys."""
    rows = answers.sort_by("slice").select(["in_target", "in_all"]).to_pylist()
    return tuple(np.concatenate([np.zeros(0, np.int64), *[_unpacked(r[c]).astype(np.int64) for r in rows]]) for c in ("in_target", "in_all"))


def _given(answers: DataFrame, of_pairs: bool) -> DataFrame:
    return answers.filter("block is not null").select("block", "slice", "in_target", "in_all", F.lit(of_pairs).alias("of_pairs"))


def losses(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)`` of whole texts, under models of all words and pairs seen
    at least ``LEAST`` times."""
    blocks = _blocks(marked(docs, target_ids))
    facts = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_target", "n_tokens", "s_target", "s_all", "n_words")]).first()
    slices_of_words, slices_of_pairs = (max(1, -(-facts[c] // SLICE_KEYS)) for c in ("n_words", "n_tokens"))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _Block.of(row)
                yield from _requests(block, row["block"], block.words, block.tokens, slices_of_words).to_batches()

    content = ["counts", "target", "words", "seen", "tokens"]
    words = _answers(blocks.select("block", *content).mapInArrow(ask_words, _REQUEST), LEAST, "lm-words")
    known = words.filter("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "sum_target", "sum_all")]).first()

    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = _Block.of(row)
        keys, at = block.pairs(_joined(right)[1] > 0)[2:]
        return _requests(block, row["block"], keys, at, slices_of_pairs)

    asked = blocks.select("block", *content).groupBy("block").cogroup(_given(words, False).groupBy("block")).applyInArrow(ask_pairs, _REQUEST)
    pairs = _answers(asked, LEAST, "lm-pairs")
    size, totals = known["size"], (facts["n_target"], facts["n_tokens"])
    unknown = (totals[0] - known["sum_target"], totals[1] - known["sum_all"])
    starts = (facts["s_target"], facts["s_all"])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        own, found = (_joined(right.filter(x)) for x in (pc.invert(right.column("of_pairs")), right.column("of_pairs")))
        block = _Block.of(row)
        number, before, _, place = block.pairs(own[1] > 0)
        filled, out = block.counts > 0, np.zeros((2, len(block.counts)))
        for k in range(2):
            count = np.append(own[k], [unknown[k], starts[k]])
            word = (count[number] + 1) / (totals[k] + size + 1)
            loss = -np.log((found[k][place] + MASS * word) / (count[before] + MASS))
            if len(loss):
                out[k, filled] = np.add.reduceat(loss, (np.cumsum(block.counts) - block.counts)[filled]) / block.counts[filled]
        return pa.table(
            {"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": pa.array(block.counts), "target_loss": pa.array(out[0]), "background_loss": pa.array(out[1]), "score": pa.array(out[0] - out[1])}
        )

    answers = _given(words, False).unionByName(_given(pairs, True))
    both = blocks.select("block", "doc_ids", *content).groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(scored, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
