"""Near-duplicate documents by DartMinHash.

A text is the set of its runs of five words (all its words, if fewer); weights other than 1 can be given. Darts of rate 1
fall on the region of each element: one axis is weight, the other rank. Those a set of weights catches below a rank bound
chosen from its total weight number about ``k ln k + 2 k``; each dart has a coordinate, and the dart of lowest rank in each
of ``k`` coordinates is the signature. Two sets agree in a coordinate with probability equal to their (weighted) Jaccard
similarity.

Texts with the same set are one node. Signatures are cut into bands; nodes that agree in a band share a bucket. Listing
all pairs of a bucket is out of the question, so each bucket gives a spanning forest: at most one pair per node, the pairs
of highest estimated similarity first. These pairs are checked exactly on their sets and joined into components. Then all
pairs of a bucket that lie in different components and whose sizes allow a link are compared exactly on their sets; the
links that join components complete the classes. Signatures decide who meets in a bucket and what is checked first, never
that a pair is left out. A hot bucket is cut into blocks, and pairs of blocks are handled apart. Classes are the connected
components of links of at least the threshold, named by their least doc_id.

Edge cases: a null or blank text has no set; it is a class of its own under its doc_id. Texts of fewer than five words are
alike only if equal word for word. Repeated rows fall into one class. A null doc_id counts as the greatest; a class of
such rows has a null class_id. An empty table gives an empty table. Other columns are not read, and ``keep_one`` carries
them along whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import words as W
from tokenledger.llm.components import components
from tokenledger.llm.tables import join_checked, packed, stage

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
#: Pairs of a forest whose signatures agree less than this are left to ``_across``, which checks all that are not joined.
MAYBE = 0.65
#: Nodes of a bucket that one task compares with as many others.
BLOCK = 2000
#: Elements of the sets of such a block, and elements that are compared with a set at once.
BLOCK_ELEMENTS = 1_000_000
RUN_ELEMENTS = 100_000


def shingles(rows: W.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different ``n``-word runs of each row, sorted, one row after another, and their bounds."""
    hashes = rows.hashes()
    grams, _, row = W.windows(hashes, rows.bounds, n)
    short = np.flatnonzero((rows.counts > 0) & (rows.counts < n))
    if len(short):
        whole = W._run_hashes(hashes, rows.bounds[short], rows.bounds[short + 1])
        grams, row = np.concatenate([grams, whole]), np.concatenate([row, short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(rows.rows + 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from the upper bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(elements: np.ndarray, bounds: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """``(rows, k)``: the dart of lowest rank in each coordinate. A row without weight has zeros."""
    rows = len(bounds) - 1
    out = np.zeros((rows, k), np.uint64)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    if weights is None:
        cell, cell_row, cell_weight = elements, row, None
        total = np.diff(bounds).astype(np.float64)
    else:  # the region of an element is cut into cells of weight 1; the last one is caught in part
        keep = weights > 0
        cells = np.ceil(weights[keep]).astype(np.int64)
        number = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        cell = W.mix(np.repeat(elements[keep], cells) + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        cell_row, cell_weight = np.repeat(row[keep], cells), np.minimum(np.repeat(weights[keep], cells) - number, 1.0)
        total = np.bincount(row[keep], weights[keep], rows)
    todo, darts = total > 0, k * math.log(k) + 2 * k
    while todo.any():
        bound = np.where(todo, darts / np.maximum(total, 1e-300), 0.0)
        best_rank, best = np.full(rows * k, np.inf), np.zeros(rows * k, np.uint64)
        at = np.flatnonzero(todo[cell_row])
        rank, n = np.zeros(len(at)), 0
        places, ranks, names = [], [], []
        while len(at):
            # The next dart of each cell: ranks of a process of rate 1 are sums of exponential gaps.
            dart = W.mix(cell[at] + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % 2**64))
            rank = rank - np.log(_unit(dart))
            inside = rank <= bound[cell_row[at]]
            at, rank, dart = at[inside], rank[inside], dart[inside]
            name = W.mix(dart ^ np.uint64(0x5851F42D4C957F2D))
            caught = np.ones(len(at), bool) if cell_weight is None else _unit(W.mix(name)) <= cell_weight[at]
            places.append((cell_row[at] * k + (name % np.uint64(k)).astype(np.int64))[caught])
            ranks.append(rank[caught]), names.append(name[caught])
            n += 1
        place, rank, name = np.concatenate(places), np.concatenate(ranks), np.concatenate(names)
        order = np.lexsort((name, rank))[::-1]
        best[place[order]] = name[order]  # the last written, of lowest rank, stays
        best_rank[place] = 0
        full = (best_rank == 0).reshape(rows, k).all(axis=1) & todo
        out[full] = best.reshape(rows, k)[full]
        todo &= ~full
        darts *= 2  # rows with an empty coordinate throw more
    return out


def _node_keys(elements: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set, whatever its order; a row without elements has none."""
    one = W.row_sums(W.mix(elements ^ np.uint64(0x2545F4914F6CDD1D)), bounds)
    two = W.row_sums(W.mix(elements + np.uint64(0x9E3779B97F4A7C15)), bounds)
    raw = np.column_stack([one, two]).astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if n else None for i, n in enumerate(np.diff(bounds).tolist())]


def sketch(docs: DataFrame) -> DataFrame:
    """``(doc_id, node, n, signature)``: the name and size of each text's set, and 16 bits of each signature coordinate."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.each_chunk(batch.column("text")):
                elements, bounds = shingles(rows)
                raw = signatures(elements, bounds, BANDS * ROWS).astype("<u2").tobytes()
                size, nodes = 2 * BANDS * ROWS, _node_keys(elements, bounds)
                ids = batch.column("doc_id").slice(rows.first, rows.rows)
                marks = [raw[i * size : (i + 1) * size] if nodes[i] else None for i in range(rows.rows)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": ids, "node": pa.array(nodes, pa.binary()), "n": pa.array(np.diff(bounds)), "signature": pa.array(marks, pa.binary())}
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(sketched, "doc_id long, node binary, n long, signature binary")


def _agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return (many == one).mean(axis=1)


def _forest(table: pa.Table) -> pa.Table:
    """The spanning forest of one bucket by highest estimated similarity, grown from node to node (Prim)."""
    table = table.sort_by("node")
    nodes, sizes = table.column("node").to_pylist(), table.column("n").to_numpy()
    marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(nodes), -1)
    best, parent = np.full(len(nodes), -1.0), np.zeros(len(nodes), np.int64)
    left = np.ones(len(nodes), bool)
    pairs: list[tuple[bytes, bytes]] = []
    at = 0
    for _ in range(len(nodes) - 1):
        left[at] = False
        open_ = np.flatnonzero(left)
        like = _agreement(marks[at], marks[open_])
        like[np.minimum(sizes[open_], sizes[at]) < THRESHOLD * np.maximum(sizes[open_], sizes[at])] = 0.0
        nearer = like > best[open_]
        best[open_[nearer]], parent[open_[nearer]] = like[nearer], at
        at = int(open_[np.argmax(best[open_])])
        if best[at] >= MAYBE:
            a, b = sorted((nodes[at], nodes[parent[at]]))
            pairs.append((a, b))
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})


def _across(table: pa.Table) -> pa.Table:
    """Links of one bucket between different components, checked exactly; nodes that links of the bucket have joined are
    not compared any more. A pair that shares several bands is looked at in the first."""
    table = table.sort_by("node")
    nodes, sizes, band = table.column("node").to_pylist(), table.column("n").to_numpy(), table.column("band")[0].as_py()
    marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(nodes), -1)
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("elements")]
    block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    _, part = np.unique(np.array([c.hex() for c in table.column("component").to_pylist()]), return_inverse=True)
    outside = np.flatnonzero(part != np.argmax(np.bincount(part)))
    rank = np.full(len(nodes), -1)
    rank[outside] = np.arange(len(outside))
    links: list[tuple[bytes, bytes]] = []
    for k in outside.tolist():
        # Each pair once: with nodes of the largest component, and with outside nodes that come later.
        other = (part != part[k]) & ((rank < 0) | (rank > rank[k]))
        if i != j:
            other &= block != block[k]
        other &= np.minimum(sizes, sizes[k]) >= THRESHOLD * np.maximum(sizes, sizes[k])
        at = np.flatnonzero(other)
        first = np.argmax((marks[at] == marks[k]).reshape(len(at), BANDS, ROWS).all(axis=2), axis=1)
        at = at[first == band]
        if not len(at):
            continue
        both = np.concatenate([_shared(sets[k], [sets[m] for m in run]) for run in _runs(at, sizes[at])])
        for m in at[_linked(both, sizes[at], sizes[k])].tolist():
            if part[m] != part[k]:
                links.append((min(nodes[k], nodes[m]), max(nodes[k], nodes[m])))
                part[part == part[m]] = part[k]
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


def _runs(at: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``at`` in runs of about ``RUN_ELEMENTS`` elements."""
    before = np.cumsum(sizes) - sizes
    return np.split(at, np.flatnonzero(np.diff(before // RUN_ELEMENTS)) + 1)


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the others shares with ``one``; all are sorted and not empty."""
    sizes = np.array([len(x) for x in others])
    elements = np.concatenate(others)
    found = np.searchsorted(one, elements)
    found[found == len(one)] = 0
    return np.add.reduceat((one[found] == elements).astype(np.int64), np.cumsum(sizes) - sizes)


def _linked(both: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether sets of so many elements, ``both`` of them shared, reach the threshold; in whole numbers, so that a
    similarity of exactly the threshold is a link."""
    return both * 1000 >= round(THRESHOLD * 1000) * (one + two - both)


def _blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """Groups ``(bucket, i, j)`` of two blocks at most: all pairs of the blocks that a bucket is cut into."""
    cut = members.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    one = F.col("blocks") == 1
    other = F.explode(F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = cut.withColumn("other", other)
    return paired.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(node, elements)`` of the chosen ``(doc_id, node)``: texts are read again, and none but the chosen ones are moved."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in W.each_chunk(batch.column("text")):
                elements, bounds = shingles(rows)
                found = [elements[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"node": pa.array(_node_keys(elements, bounds), pa.binary()), "elements": pa.array(found, pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = chosen.select("doc_id").distinct()
    found = join_checked(texts, wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text").mapInArrow(cut, "node binary, elements binary")
    # An id given to several texts brings sets that nobody asked for.
    nodes = chosen.select("node").distinct()
    return join_checked(found, nodes, found["node"] == nodes["node"], "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have at least the threshold's Jaccard similarity."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), "<u8"), np.frombuffer(two.as_buffer(), "<u8")
                keep.append(bool(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("left")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(checked, "a binary, b binary")


def node_classes(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes with links; ``sketches`` is a stored ``sketch(docs)``."""
    named = sketches.filter("node is not null")
    nodes = stage(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "darts-nodes")
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.substring(F.col("signature"), b * width + 1, F.lit(width)).alias("key")))
    banded = nodes.select("node", F.explode(keys).alias("at")).select("node", F.col("at.band").alias("band"), F.xxhash64("at.band", "at.key").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("low"), F.max("node").alias("high")).filter("members > 1")
    buckets = stage(buckets, "darts-buckets")
    couples = buckets.filter("members = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    crowds = buckets.filter("members > 2").select(F.col("bucket").alias("crowd"), "members")
    inside = join_checked(banded, crowds, banded["bucket"] == crowds["crowd"], "inner").drop("crowd")
    members = stage(inside.join(nodes.select("node", "n", "signature"), "node"), "darts-members")

    grouped = _blocks(members, F.ceil(F.col("members") / F.lit(BLOCK))).groupBy("bucket", "i", "j")
    pairs = stage(grouped.applyInArrow(_forest, "a binary, b binary").unionByName(couples).distinct(), "darts-pairs")
    wanted = members.select("node").unionByName(couples.select(F.col("a").alias("node"))).unionByName(couples.select(F.col("b").alias("node"))).distinct()
    sets = stage(_sets(docs, nodes.select("node", "doc_id").join(wanted, "node")), "darts-sets")
    links = stage(_verified(pairs, sets), "darts-links")
    parts = components(links)

    placed = members.join(parts.withColumnRenamed("component", "found"), "node", "left").withColumn("component", F.coalesce("found", "node")).drop("found")
    facts = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.sum("n").alias("elements_of_all"))
    split = facts.filter("least <> most").select(F.col("bucket").alias("crowd"), "elements_of_all")
    mixed = join_checked(placed, split, placed["bucket"] == split["crowd"], "inner").join(sets, "node")
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(BLOCK), F.col("elements_of_all") / F.lit(BLOCK_ELEMENTS)))
    late = stage(_blocks(mixed, blocks).groupBy("bucket", "i", "j").applyInArrow(_across, "a binary, b binary").distinct(), "darts-late")
    return components(links.unionByName(late))


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id)`` of every row of ``docs``, with ``node`` and the class's first ``(doc_id, node)`` beside them."""
    sketches = stage(sketch(docs).select("doc_id", "node", "n", "signature"), "darts-sketch")
    parts = node_classes(docs, sketches)
    last = F.lit(2**63 - 1)
    rows = sketches.select("doc_id", "node")
    least = rows.filter("node is not null").groupBy("node").agg(F.min(F.coalesce("doc_id", last)).alias("least_id"))
    joined = least.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = joined.groupBy("component").agg(F.min(F.struct("least_id", "node")).alias("first"))
    named = joined.join(firsts, "component").select("node", F.nullif(F.col("first.least_id"), last).alias("first_id"), F.col("first.node").alias("first_node"))
    out = rows.join(named, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("class_id"), "node", "first_node")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but the first of each class; all columns. Rows without words stay.

    Ids decide where they are unique. Rows whose id is null or given more than once are told apart by their sets.
    """
    found = stage(classes(docs), "darts-classes")
    unclear = found.filter("node is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 or doc_id is null").select("doc_id")
    unclear = stage(unclear, "darts-unclear")
    gone = found.filter("node is not null and not (doc_id <=> class_id and node = first_node)").select("doc_id")
    gone = stage(gone.join(unclear, gone["doc_id"].eqNullSafe(unclear["doc_id"]), "left_anti").distinct(), "darts-gone")
    rows = packed(docs, F.col("doc_id").cast("long").alias("key"))
    clear = join_checked(rows, unclear, rows["key"].eqNullSafe(unclear["doc_id"]), "left_anti")
    kept = join_checked(clear, gone, clear["key"] == gone["doc_id"], "left_anti").select("input_row.*")
    if unclear.isEmpty():
        return kept

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.each_chunk(batch.column("input_row").field("text")):
                elements, bounds = shingles(part)
                yield pa.RecordBatch.from_pydict(
                    {c: batch.column(c).slice(part.first, part.rows) for c in ("input_row", "key")} | {"name": pa.array(_node_keys(elements, bounds), pa.binary())}
                )

    doubtful = join_checked(rows, unclear, rows["key"].eqNullSafe(unclear["doc_id"]), "left_semi")
    told = doubtful.mapInArrow(named, f"input_row {rows.schema['input_row'].dataType.simpleString()}, key long, name binary")
    firsts = found.filter("doc_id <=> class_id and node = first_node").select("doc_id", "node").distinct()
    stays = told.filter("name is not null").join(firsts, told["key"].eqNullSafe(firsts["doc_id"]) & (told["name"] == firsts["node"]), "left_semi").dropDuplicates(["key", "name"])
    return kept.unionByName(stays.unionByName(told.filter("name is null")).select("input_row.*"))
