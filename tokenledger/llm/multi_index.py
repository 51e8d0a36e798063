"""Hard negatives by an inverted multi-index.

A vector is cut in two halves. Each half has a codebook, and a row belongs to the cell of its two nearest codewords. For an
anchor ``q``, a half of a row near codeword ``c`` adds at most ``q c + |q| r``, with ``r`` the radius of the codeword's rows;
the bound of a cell is the sum of its halves' bounds. The multi-sequence walk takes cells by falling bound: both halves'
codewords are sorted by their bounds, and a heap holds the pairs that may come next. It stops when the next bound, and so
every cell not seen, lies below what a window still needs: below its lower end, or below the worst of its ``k`` best rows
so far. Answers are exact; a codebook decides speed only.

Codebooks are fitted by k-means on at most ``SAMPLE`` rows (those of least hash); every row is in the index. Rows are cut
into shards where they lie, and each shard has the cells and radii of its own rows. Anchors are cut into blocks. Each task
meets the shards of a group with the anchors of a block and carries the best rows from shard to shard. There are two
rounds: the positives of an anchor (best other rows of its label), then the rows of other labels whose score ``n`` lies
in ``low * p <= 100 n <= 100 p`` for the score ``p`` of each positive. Rounds are merged by rank, which keeps ``k`` rows
a task.

Scores are inner products of the whole numbers ``floor(256 x)``, x as double, exact at every size; a score beyond 64 bits
is ranked as it is and shown as the nearest long.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part. Null ids are no anchors,
rank after others in ties, and are not relabelled. An empty or shorter vector counts as filled up with zeros. Rows that
share the anchor's id are none of its positives; a repeated anchor row is an anchor of its own and gives its rows again. An
anchor without positives, and a positive without negatives, gives no row; a negative positive score has an empty window. An
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.llm import vectors as V
from tokenledger.llm.tables import stage

K = 5
LOW = 80
CODEWORDS = 16
SAMPLE = 2048
STEPS = 8
#: Rows of a shard, rows of cells scored at once.
SHARD = 4096
BATCH = 512
_NO_ID = -(2**63)
_BEST = "anchor_block long, anchor_row int, anchor_id long, window int, place int, vec_id long, score string"


def halves(matrix: np.ndarray, width: int) -> list[np.ndarray]:
    """The two halves of rows filled up (or cut) to ``width`` components; none is lost, as ``width`` is the greatest."""
    full = np.zeros((len(matrix), width))
    full[:, : matrix.shape[1]] = matrix
    return [full[:, : width // 2], full[:, width // 2 :]]


def _nearest(part: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.argmin(np.nan_to_num((words * words).sum(axis=1) - 2 * part @ words.T, nan=np.inf), axis=1)


def fit(sample: np.ndarray, width: int, codewords: int = CODEWORDS, steps: int = STEPS) -> list[np.ndarray]:
    """The two codebooks: k-means of the sample's halves, from rows spread over it."""
    books = []
    for part in halves(sample, width):
        different = np.unique(part, axis=0)
        words = different[np.linspace(0, max(len(different) - 1, 0), min(codewords, len(different)), dtype=np.int64)] if len(different) else np.zeros((1, part.shape[1]))
        for _ in range(steps):
            near = _nearest(part, words)
            counts = np.bincount(near, minlength=len(words))
            sums = np.zeros_like(words)
            np.add.at(sums, near, part)
            words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
        books.append(words)
    return books


@dataclass
class Best:
    """The ``k`` first rows ``(-score, no id, id)`` found so far, of scores between ``low`` and ``high``."""

    k: int
    low: int | None = None
    high: int | None = None

    def __post_init__(self):
        self.rows: list[tuple[int, bool, int]] = []

    def needs(self) -> float:
        """The least score that may still matter."""
        worst = -self.rows[-1][0] if len(self.rows) >= self.k else -np.inf
        return worst if self.low is None else max(worst, self.low)

    def add(self, scores: np.ndarray, ids: list[int | None], at: np.ndarray) -> None:
        """Take rows ``at`` (places in ``ids``) with their scores."""
        least = self.needs()
        picked = np.ones(len(scores), bool) if least == -np.inf else scores >= least
        if self.high is not None:
            picked &= scores <= self.high
        near, at = scores[picked], at[picked]
        if len(near) > self.k:
            worst = np.sort(near)[-self.k]
            near, at = near[near >= worst], at[near >= worst]
        found = [(-int(s), ids[i] is None, ids[i] or 0) for s, i in zip(near.tolist(), at.tolist(), strict=True)]
        if found:
            self.rows = sorted(self.rows + found)[: self.k]


class Shard:
    """The rows of one block by cell, with the radii of its codewords."""

    def __init__(self, ids: list[int | None], labels: np.ndarray, matrix: np.ndarray, books: list[np.ndarray], width: int):
        self.width, self.books, parts = width, books, halves(matrix, width)
        codes = [_nearest(part, book) for part, book in zip(parts, books, strict=True)]
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        self.ids, self.labels, self.matrix = [ids[i] for i in order], labels[order], np.hstack(parts)[order]
        self.known = np.array([_NO_ID if i is None else i for i in self.ids], np.int64)
        self.ends = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        self.most = float(np.abs(matrix).max(initial=0))
        self.radii = []
        for part, book, code in zip(parts, books, codes, strict=True):
            radius = np.full(len(book), -1.0)  # no row
            with np.errstate(all="ignore"):
                np.maximum.at(radius, code, np.nan_to_num(np.sqrt(((part - book[code]) ** 2).sum(axis=1)), nan=np.inf))
            self.radii.append(radius)

    def bounds(self, query: np.ndarray) -> list[np.ndarray]:
        """The most that a row of each codeword can add, with room for rounding; -inf for codewords without rows."""
        out = []
        for part, book, radius in zip(halves(query[None], self.width), self.books, self.radii, strict=True):
            q = part[0]
            with np.errstate(all="ignore"):
                length = np.sqrt((q * q).sum())
                spread = length * (np.sqrt((book * book).sum(axis=1)) + np.maximum(radius, 0))
                bound = np.nan_to_num(book @ q + length * np.maximum(radius, 0) + 1e-9 * spread + 1, nan=np.inf)
            out.append(np.where(radius < 0, -np.inf, bound))
        return out

    def cells(self, query: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """``(bound, start, end)`` of the cells with rows, by falling bound."""
        bounds = self.bounds(query)
        first, second = (np.argsort(-b, kind="stable") for b in bounds)
        first, second = first[bounds[0][first] > -np.inf].tolist(), second[bounds[1][second] > -np.inf].tolist()
        if not first or not second:
            return
        one, two = bounds[0].tolist(), bounds[1].tolist()
        heap = [(-(one[first[0]] + two[second[0]]), 0, 0)]
        reached = [0] * len(first)  # of each row of pairs, how many were taken
        while heap:
            bound, i, j = heapq.heappop(heap)
            reached[i] = j + 1
            cell = first[i] * len(self.books[1]) + second[j]
            if self.ends[cell] < self.ends[cell + 1]:
                yield -bound, int(self.ends[cell]), int(self.ends[cell + 1])
            # A pair may come once the pairs before it in both halves were taken.
            if i + 1 < len(first) and reached[i + 1] == j:
                heapq.heappush(heap, (-(one[first[i + 1]] + two[second[j]]), i + 1, j))
            if j + 1 < len(second) and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (-(one[first[i]] + two[second[j + 1]]), i, j + 1))

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products, as Python's numbers where doubles would round."""
        q = np.hstack(halves(query[None], self.width))[0]
        with np.errstate(over="ignore"):
            exact = float(np.abs(q).max(initial=0)) * self.most * self.width < 1 << 53
        if exact:
            return (self.matrix[at] @ q).astype(np.int64)
        whole = [int(x) for x in q.tolist()]
        out = np.empty(len(at), object)
        out[:] = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in self.matrix[at].tolist()]
        return out

    def search(self, anchor_id: int | None, label: int, query: np.ndarray, windows: list[Best], same: bool) -> None:
        """Add this shard's rows to the windows: other rows of the same label, or rows of other labels."""

        def taken() -> float:
            at = np.concatenate(held)
            fits = (self.labels[at] == label) & (self.known[at] != anchor_id) if same else self.labels[at] != label
            if fits.any():
                at = at[fits]
                scores = self.scores(query, at)
                for window in windows:
                    window.add(scores, self.ids, at)
            held.clear()
            return min(w.needs() for w in windows)

        held: list[np.ndarray] = []
        needs, count = min((w.needs() for w in windows), default=np.inf), 0
        for bound, start, end in self.cells(query):
            if bound < needs:
                break
            held.append(np.arange(start, end))
            count += end - start
            if count >= BATCH:
                needs, count = taken(), 0
        if held:
            taken()


def _rows(found: list[tuple]) -> pa.Table:
    kinds = (("anchor_block", pa.int64()), ("anchor_row", pa.int32()), ("anchor_id", pa.int64()), ("window", pa.int32()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.string()))
    return pa.table({name: pa.array([row[i] for row in found], kind) for i, (name, kind) in enumerate(kinds)})


def ceil_share(score: int, low: int) -> int:
    """The least ``n`` with ``low * score <= 100 n``."""
    return -(-low * score // 100)


def _search(shards: pa.Table, anchors: pa.Table, books: list[np.ndarray], width: int, k: int, low: int | None) -> pa.Table:
    """The best rows of these shards for each anchor and window. Without ``low``: its positives; else the rows of other
    labels in the window of each positive, whose scores are in the column ``positives``."""
    loaded = [Shard(s["ids"], np.array(s["labels"], np.int64), V.matrix_of(s), books, width) for s in shards.sort_by("block").to_pylist()]
    out = []
    for block in anchors.to_pylist():
        matrix = V.matrix_of(block)
        for row, (anchor_id, label, query) in enumerate(zip(block["ids"], block["labels"], matrix, strict=True)):
            if low is None:
                windows = [Best(k)]
            else:
                windows = [Best(k, ceil_share(int(p), low), int(p)) for p in block["positives"][row]]
            for shard in loaded:
                shard.search(anchor_id, label, query, windows, low is None)
            for number, window in enumerate(windows):
                for place, (score, none, vec_id) in enumerate(window.rows):
                    out.append((block["block"], row, anchor_id, number, place, None if none else vec_id, str(-score)))
    return _rows(out)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, column: str = "embedding", k: int = K, low: int = LOW, shard: int = SHARD, codewords: int = CODEWORDS, **limits: int) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``. ``limits`` are those of ``vectors.meet``."""
    rows = V.whole(vectors, column, where=label.isNotNull(), label=label.cast("long"))
    shards = stage(V.blocks(rows, shard), "multi-index-shards")
    anchors = stage(V.blocks(rows.filter(is_anchor).repartition(F.xxhash64("vec_id", "vector")), min(limits.get("most_asking", V.ASKING), 1024)), "multi-index-anchors")
    width = shards.agg(F.max("width")).first()[0] or 1
    sample = V.blocks(rows.orderBy(F.xxhash64("vector"), F.xxhash64("vec_id")).limit(SAMPLE).coalesce(1), SAMPLE).collect()
    books = fit(np.vstack([np.zeros((0, width)), *(np.hstack(halves(V.matrix_of(r.asDict()), width)) for r in sample)]), width, codewords)

    def best(asked: DataFrame, low: int | None) -> DataFrame:
        def searched(left: pa.Table, right: pa.Table) -> pa.Table:
            return _search(left, right, books, width, k, low)

        found = V.meet(shards, asked, searched, _BEST, **limits)
        first = Window.partitionBy("anchor_block", "anchor_row", "window").orderBy(*V.falling(F.col("score")), F.col("vec_id").asc_nulls_last(), "place")
        return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)

    positives = stage(best(anchors, None).select("anchor_block", "anchor_row", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "multi-index-positives")
    # The scores of each anchor's positives, in the order of the block's rows: at most k a row.
    scores = positives.groupBy("anchor_block", "anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("positive", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    of_rows = scores.groupBy("anchor_block").agg(F.map_from_entries(F.collect_list(F.struct("anchor_row", "scores"))).alias("by_row"))
    each = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.coalesce(F.try_element_at("by_row", i), F.array().cast("array<string>")))
    asked = stage(anchors.join(of_rows, anchors["block"] == of_rows["anchor_block"]).select(anchors["*"], each.alias("positives")), "multi-index-asked")
    negatives = best(asked, low).select("anchor_block", "anchor_row", "anchor_id", (F.col("window") + 1).alias("positive"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    both = negatives.join(positives, ["anchor_block", "anchor_row", "positive"])
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", V.shown(F.col("positive_score")).alias("positive_score"), V.shown(F.col("negative_score")).alias("negative_score"))
