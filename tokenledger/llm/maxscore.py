"""Exact top-k search by inner product, with MaxScore.

Vectors are cut into shards. A shard keeps a postings list for each term (component) of a query: the values of all its
vectors in that component, with the least and the greatest, so that a query knows the most each term can add there. For a
query and a shard, terms are ordered by that bound. The terms of least bound whose bounds together cannot lift a vector
over the query's current threshold are non-essential: the postings of the others, the essential ones, are traversed for
all vectors, and vectors that could still reach the threshold with everything left are probed in the remaining terms,
largest bound first, dropping out as soon as they cannot. The threshold is the k-th best score so far. Each task meets
blocks of queries with one group of shards; the groups' best are merged by rank.

Scores are whole numbers: every component x becomes floor(256 * x), x as double. They are exact at every size; a score
beyond 64 bits is ranked as it is and shown as the nearest long.

Edge cases: a vector that is null or holds a null or non-finite component takes no part. Shorter vectors count as filled up with zeros. Rows with the same vec_id are not candidates of each other;
each is a query of its own if the id is one. Null ids are no queries, and rank after others in ties. Ties go to the
smaller vec_id. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.llm import vectors as V
from tokenledger.llm.tables import stage

K = 5
SHARD = 4096
QUERIES = 1024

FOUND = "query_block long, query_row int, query_id long, vec_id long, score string, place int"
_FOUND = pa.schema([("query_block", pa.int64()), ("query_row", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.string()), ("place", pa.int32())])


class Shard:
    """The postings of one block: a row of values for each term, and the bounds of the row."""

    def __init__(self, ids: list[int | None], matrix: np.ndarray):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))  # ties go to the smaller id
        self.ids = [ids[i] for i in order]
        self.known = np.array([-(2**63) if i is None else i for i in self.ids], np.int64)
        self.most = float(np.abs(matrix).max(initial=0))
        self.postings = np.ascontiguousarray(matrix[order].T.astype(np.float64))
        self.low, self.high = (self.postings.min(axis=1), self.postings.max(axis=1)) if len(ids) else (None, None)

    def search(self, query_id: int, query: np.ndarray, best: list[tuple[int, bool, int, int]], k: int) -> list[tuple[int, bool, int, int]]:
        """Merge this shard's best ``(-score, no id, id, place)`` into ``best``."""
        width = min(len(query), len(self.postings))
        q = query[:width].astype(np.float64)
        with np.errstate(over="ignore"):
            large = float(np.abs(query).max(initial=0)) * self.most * len(self.postings) >= 1 << 53
        if large:  # beyond the whole numbers of a double
            return self._search_large(query_id, query[:width], best, k)
        bound = np.maximum(q * self.low[:width], q * self.high[:width])  # most that a term can add; may be below 0
        # This shard's scores are below 2^53, so a threshold beyond 2^60 may stand for all greater ones.
        threshold = float(min(max(-best[k - 1][0], -(1 << 60)), 1 << 60)) if len(best) >= k else -np.inf
        order = np.argsort(bound)
        rest = np.concatenate([[0.0], np.cumsum(bound[order])])  # most that the first i terms can add together
        # Non-essential: terms that help, taken from the least bound, that stay under the threshold together.
        split = int(np.searchsorted(np.maximum.accumulate(rest[1:]), threshold, "left")) if np.isfinite(threshold) and threshold > 0 else 0
        essential = order[split:]
        score = q[essential] @ self.postings[essential] if len(essential) else np.zeros(len(self.ids))
        at = np.flatnonzero((score + rest[split] >= threshold) & (self.known != query_id))
        score = score[at]
        if split == 0 and len(at) > k and np.isinf(threshold):
            least = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= least], score[score >= least]
        for left in range(split - 1, -1, -1):
            score = score + q[order[left]] * self.postings[order[left]][at]
            keep = score + rest[left] >= threshold
            if not keep.all():
                at, score = at[keep], score[keep]
        if len(at) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= least], score[score >= least]
        found = [(-int(s), self.ids[i] is None, self.ids[i] or 0, 0) for i, s in zip(at.tolist(), score.tolist(), strict=True)]
        return sorted(best + found)[:k]


    def _search_large(self, query_id: int, query: np.ndarray, best: list[tuple[int, bool, int, int]], k: int) -> list[tuple[int, bool, int, int]]:
        """The same for numbers so large that only Python's are exact."""
        found, whole = [], [int(x) for x in query.tolist()]
        for i, values in enumerate(self.postings.T[:, : len(query)].tolist()):
            if self.known[i] != query_id:
                score = sum(int(a) * b for a, b in zip(values, whole, strict=True))
                found.append((-score, self.ids[i] is None, self.ids[i] or 0, 0))
        return sorted(best + found)[:k]


def _search(shards: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    rows: list[tuple] = []
    loaded = [Shard(s["ids"], V.matrix_of(s)) for s in shards.sort_by("block").to_pylist()]
    for block in queries.to_pylist():
        for row, (query_id, query) in enumerate(zip(block["ids"], V.matrix_of(block), strict=True)):
            best: list[tuple[int, bool, int, int]] = []
            for shard in loaded:
                best = shard.search(query_id, query, best, k)
            rows += [(block["block"], row, query_id, None if none else i, str(-score), place) for place, (score, none, i, _) in enumerate(best)]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_FOUND)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def search(vectors: DataFrame, is_query: Column, k: int = K, column: str = "embedding", shard: int = SHARD, **limits: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of all other vectors for each query row. ``limits`` are those of
    ``vectors.meet``."""
    rows = V.whole(vectors, column)
    shards = stage(V.blocks(rows, shard), "maxscore-shards")
    queries = stage(V.blocks(rows.filter(is_query).repartition(F.xxhash64("vec_id", "vector")), QUERIES), "maxscore-queries")

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, k)

    found = V.meet(shards, queries, searched, FOUND, **limits)
    best = Window.partitionBy("query_block", "query_row").orderBy(*V.falling(F.col("score")), F.col("vec_id").asc_nulls_last(), "place")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", V.shown(F.col("score")).alias("score"))
