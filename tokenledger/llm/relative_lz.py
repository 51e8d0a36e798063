"""Substring duplicates by relative Lempel-Ziv parsing.

Documents are factored greedily against reference blocks that hold the corpus, and factors of ``WINDOW`` words or more are
duplicate spans. Which block can hold a match is told by content: among the runs of ``ANCHOR`` words in a window of
``WINDOW`` words, the one of least hash is the window's anchor, and the consecutive windows with one anchor make up a
passage. Equal windows have equal anchors, so a passage finds all its matches in the block of its anchor, and no document
has to meet blocks with which it shares nothing.

1. The dictionary: passages of all texts by anchor. Only anchors that occur again can belong to a duplicate. A passage that
   stands earlier as a whole is one factor; it needs no parse, and a task that holds both reports it at once. Only the first
   of equal passages enters a reference block, so a passage with many copies is there once.
2. Reference blocks (``_block_factors``): the different passages of some anchors, about ``BLOCK_PASSAGES``, in the order of
   the corpus. The block's suffixes are put into classes by their first ``WINDOW`` words and the classes split word by word,
   as one descends a suffix tree; this gives each suffix its longest match that starts earlier. The greedy parse then takes
   at each place the longest match, or one word where there is none, and goes on behind it.
3. Borders: the windows that cross the end of a factor lie in no factor. Each is looked up in the block by itself.

An anchor with more than ``CROWD`` different passages is too much for one block. Its windows are matched one by one by a
least position per window, which tasks gather in part before they send; the rows are the same.

A window is a duplicate if its word sequence starts earlier: in a smaller doc_id, or earlier in the same text. All windows
are judged on the input. Anchors are compared by 64-bit, passages and windows by 128-bit hashes, words in a block by 64.

Edge cases: a null or blank text has no words; texts shorter than a window lose nothing. Repeated doc_ids are told apart
by a hash of their text, also where lists of spans are sent to texts; rows with the same id and text are one document given
twice, and each keeps what it keeps. A null doc_id counts as the smallest. An empty table gives an empty table. Other
columns are not read, and ``remove`` carries them along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import words as W
from tokenledger.llm.tables import ROW, packed, stage

WINDOW = 20
ANCHOR = 6
#: Passages in a reference block, on average, and different passages of one anchor up to which it stands in a block.
BLOCK_PASSAGES = 40_000
CROWD = 8_000
_LEAST = -(2**63)
_FACTOR = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("windows", pa.int32()), ("sure", pa.bool_())])
FACTOR = "key long, run long, doc long, at long, windows int, sure boolean"


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of its least one, the leftmost of equals."""
    at, covered = np.arange(len(values)), 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        covered += step
    return at


def factors(rows: W.Words, window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """The factors of each row: ``row``, ``key`` of the anchor, ``run`` (a hash of the factor's words and of where the
    anchor stands in it), ``start`` of the first window in its text, and how many ``windows`` there are."""
    hashes = rows.hashes()
    grams, _, _ = W.windows(hashes, rows.bounds, anchor)
    n_grams = np.maximum(rows.counts - anchor + 1, 0)
    n_windows = np.maximum(rows.counts - window + 1, 0)
    if not n_windows.sum():
        none = np.zeros(0, np.int64)
        return {"row": none, "key": none.astype(np.uint64), "run": none.astype(np.uint64), "start": none, "windows": none}
    row = np.repeat(np.arange(rows.rows), n_windows)
    start = np.arange(len(row)) - (np.cumsum(n_windows) - n_windows)[row]
    base = np.cumsum(n_grams) - n_grams
    least = _sliding_argmin(grams, window - anchor + 1)[base[row] + start]
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])]))
    count = np.diff(np.concatenate([first, [len(row)]]))
    row, start, least = row[first], start[first], least[first]
    place = rows.bounds[row] + start
    inside = (least - base[row] - start).astype(np.uint64)
    run = W.mix(W._run_hashes(hashes, place, place + count + window - 1) + inside)
    return {"row": row, "key": grams[least], "run": run, "start": start, "windows": count}


#: Seed of Spark's ``xxhash64``; marks made in tasks and in column expressions agree.
_SEED = 42


def _text_marks(rows: W.Words) -> np.ndarray:
    """31 bits that tell texts with one doc_id apart."""
    raw, ends = rows.data.tobytes(), rows.offsets.tolist()
    return np.array([xxhash.xxh64_intdigest(raw[s:e], _SEED) >> 33 for s, e in zip(ends, ends[1:], strict=False)], np.int64)


def _mark(text: Column) -> Column:
    """:func:`_text_marks` as a column."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 33)


def _ids(batch: pa.RecordBatch, rows: W.Words) -> np.ndarray:
    return batch.column("doc_id").slice(rows.first, rows.rows).fill_null(_LEAST).to_numpy()


def _parsed(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """All factors of all texts, each with its place ``(doc, at)``; ``at`` is the text's mark and the first window's start.
    ``sure``: an equal factor stands earlier in the same batch."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for rows in W.each_chunk(batch.column("text")):
                f = factors(rows, window, anchor)
                at = (_text_marks(rows)[f["row"]] << 32) | f["start"]
                parts.append((f["key"].view(np.int64), f["run"].view(np.int64), _ids(batch, rows)[f["row"]], at, f["windows"]))
            if not parts:
                continue
            key, run, doc, at, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, doc, run, key))
            key, run, doc, at, count = key[order], run[order], doc[order], at[order], count[order]
            equal = np.zeros(len(key), bool)
            equal[1:] = (key[1:] == key[:-1]) & (run[1:] == run[:-1])
            again = equal.copy()  # the same row given twice
            again[1:] &= (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
            head = np.flatnonzero(~equal)
            of = np.cumsum(~equal) - 1
            sure = equal & ((doc != doc[head][of]) | (at != at[head][of])) if len(key) else equal
            keep = ~again
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, run, doc, at, count.astype(np.int32), sure)], schema=_FACTOR)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(parse, FACTOR)


def _passages(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words, as 64-bit hashes, of the passages ``wanted (doc, at, words, key, block)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wanted")
            for rows in W.each_chunk(batch.column("text")):
                ids, hashes, picked, owner = _ids(batch, rows), rows.hashes(), [], []
                for i in range(rows.rows):
                    found = lists[rows.first + i].as_py()
                    picked += found
                    owner += [i] * len(found)
                if not picked:
                    continue
                at, n, key, block = (np.array([f[c] for f in picked], np.int64) for c in ("at", "words", "key", "block"))
                place = rows.bounds[np.array(owner)] + (at & 0xFFFFFFFF)
                words = [hashes[p:e].tobytes() for p, e in zip(place.tolist(), (place + n).tolist(), strict=True)]
                arrays = [pa.array(block), pa.array(key), pa.array(ids[np.array(owner)]), pa.array(at), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "key", "doc", "at", "words"])

    listed = wanted.groupBy("doc", F.shiftright("at", 32).alias("mark")).agg(F.collect_list(F.struct("at", "words", "key", "block")).alias("wanted"))
    listed = stage(listed, "lz-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = (F.coalesce(texts["doc_id"], F.lit(_LEAST)) == listed["doc"]) & (_mark(texts["text"]) == listed["mark"])
    cuts = texts.join(listed, own).select("doc_id", "text", "wanted").mapInArrow(cut, "block long, key long, doc long, at long, words binary")
    return cuts.dropDuplicates(["block", "key", "doc", "at"])  # rows given twice


def longest_earlier(words: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """For each suffix ``words[start:end]``, given in the order of the corpus, the length of its longest match with an
    earlier one of the same ``key``; 0 where it is shorter than a window.

    Suffixes are split into classes by their first ``window`` words and then by one word more at a time. The first of a
    class has no earlier match of that length, all others have. Classes of one are left.
    """
    length = np.zeros(len(start), np.int64)
    left = np.arange(len(start))
    parts, depth = (W._run_hashes(words, start, start + window), key), window
    while len(left):
        order = np.lexsort((left, *parts))
        left, parts = left[order], [p[order] for p in parts]
        new = np.ones(len(left), bool)
        new[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in parts])
        of = np.cumsum(new) - 1
        length[left[~new]] = depth
        longer = (np.bincount(of)[of] > 1) & (start[left] + depth < end[left])
        left, of = left[longer], of[longer]
        parts, depth = (words[start[left] + depth], of), depth + 1
    return length


def greedy_factors(longest: np.ndarray, first: np.ndarray, windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parse of passages, of which passage ``i`` owns the suffixes ``first[i]`` to ``first[i] + windows[i]``: spans as
    passage, place in it, and number of windows. The windows that cross a factor's end follow as spans of one."""
    passage, place = np.arange(len(first)), np.zeros(len(first), np.int64)
    spans = [(passage[:0], place[:0], place[:0])]
    while len(passage):
        match = longest[first[passage] + place]
        whole = match >= window
        spans.append((passage[whole], place[whole], match[whole] - window + 1))
        behind = place + np.maximum(match, 1)
        for back in range(1, window):
            at = behind - back
            inside = np.flatnonzero(whole & (at < windows[passage]))
            inside = inside[longest[first[passage[inside]] + at[inside]] >= window]
            spans.append((passage[inside], at[inside], np.ones(len(inside), np.int64)))
        more = behind < windows[passage]
        passage, place = passage[more], behind[more]
    return tuple(np.concatenate(x) for x in zip(*spans, strict=True))


def _block_factors(passages: DataFrame, window: int) -> DataFrame:
    """``(doc, at, windows)``: the duplicate spans of passages, each factored against the earlier ones of its block."""

    def factor(block: pa.Table) -> pa.Table:
        doc, at, key = (block.column(c).to_numpy() for c in ("doc", "at", "key"))
        order = np.lexsort((at, doc))
        doc, at, key = doc[order], at[order], key[order]
        raw = block.column("words").combine_chunks()
        raw = raw.take(pa.array(order))
        data, ends = W.string_buffers(raw)
        words, ends = data.view(np.uint64), ends // 8
        windows = np.diff(ends) - window + 1
        first = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(doc)), windows)
        start = ends[owner] + np.arange(len(owner)) - first[owner]
        longest = longest_earlier(words, start, ends[owner + 1], key[owner], window)
        passage, place, count = greedy_factors(longest, first, windows, window)
        return pa.table({"doc": doc[passage], "at": at[passage] + place, "windows": pa.array(count, pa.int32())})

    return passages.groupBy("block").applyInArrow(factor, "doc long, at long, windows int")


def _single_windows(passages: DataFrame, window: int) -> DataFrame:
    """``(doc, at, windows)``: the duplicate windows of passages, by a least position for each window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = W.string_buffers(batch.column("words"))
            words, ends = data.view(np.uint64), ends // 8
            h1, place, row = W.windows(words, ends, window)
            h2 = W._run_hashes(W.mix(words ^ np.uint64(0x6A09E667F3BCC909)), place, place + window)
            doc, at = (batch.column(c).to_numpy()[row] for c in ("doc", "at"))
            yield pa.RecordBatch.from_pydict({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "doc": doc, "at": at + place - ends[row]})

    rows = stage(passages.select("doc", "at", "words").mapInArrow(cut, "h1 long, h2 long, doc long, at long"), "lz-windows")
    earliest = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(earliest, ["h1", "h2"]).filter(F.struct("doc", "at") != F.col("first")).select("doc", "at", F.lit(1).alias("windows"))


def duplicate_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_passages: int = BLOCK_PASSAGES, crowd: int = CROWD) -> DataFrame:
    """``(doc, at, windows)``: runs of windows whose words start earlier in the corpus."""
    parsed = _parsed(docs, window, anchor)
    repeated = parsed.groupBy("key").agg(F.count("*").alias("n"), (F.min("run") != F.max("run")).alias("cut_apart")).filter("n > 1").drop("n")
    # Stored, so that the join's two sides are plain shuffles and adaptive execution can split a hot anchor.
    repeated = stage(repeated, "lz-anchors")
    hits = stage(parsed.join(repeated, "key"), "lz-hits")
    open_ = hits.filter("not sure")
    first = open_.groupBy("key", "run").agg(F.min(F.struct("doc", "at")).alias("first"))
    looked_up = open_.join(first, ["key", "run"]).select("key", "doc", "at", "windows", (F.struct("doc", "at") != F.col("first")).alias("later"), "cut_apart")
    looked_up = stage(looked_up, "lz-factors")
    whole = hits.filter("sure").select("doc", "at", "windows").unionByName(looked_up.filter("later").select("doc", "at", "windows"))

    different = looked_up.filter("cut_apart and not later").select("key", "doc", "at", "windows").distinct()
    sizes = stage(different.groupBy("key").agg(F.count("*").alias("n")), "lz-sizes")
    blocks = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // block_passages))
    block = F.when(F.col("n") > crowd, F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.lit(blocks)))
    wanted = different.join(sizes.filter("n > 1"), "key").select("doc", "at", (F.col("windows") + window - 1).alias("words"), "key", block.cast("long").alias("block"))
    passages = stage(_passages(docs, wanted), "lz-passages")
    return whole.unionByName(_block_factors(passages.filter("block >= 0"), window)).unionByName(_single_windows(passages.filter("block < 0"), window))


def _kept_words(text: bytes, found: list[dict], window: int) -> tuple[list[bytes], int]:
    words = text.split()
    gone = np.zeros(len(words) + 1, np.int64)
    for f in found:
        start = f["at"] & 0xFFFFFFFF
        gone[start] += 1
        gone[start + f["windows"] + window - 1] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c], len(words)


def cleaned(docs: DataFrame, *columns: str, whole_rows: bool = False, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The named columns of ``docs`` and ``kept_text``, ``n_words``, ``n_removed``; with ``whole_rows``, the packed row in
    place of columns. ``kept_text`` joins the kept words with one space; it is null where nothing is removed, as the text then stays.
    """
    spans = duplicate_windows(docs, window, anchor)
    listed = stage(spans.groupBy("doc", F.shiftright("at", 32).alias("mark")).agg(F.collect_list(F.struct("at", "windows")).alias("spans")), "lz-spans")
    rows = packed(docs) if whole_rows else docs
    columns = (ROW,) if whole_rows else columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, kept, total, removed = batch.column("text"), [], [], []
            found = batch.column("spans")
            for rows in W.each_chunk(column):
                for i in range(rows.rows):
                    spans = found[rows.first + i]
                    n, words = int(rows.counts[i]), None
                    if spans.is_valid:
                        words, n = _kept_words(rows.data[rows.offsets[i] : rows.offsets[i + 1]].tobytes(), spans.as_py(), window)
                    kept.append(None if words is None or len(words) == n else b" ".join(words).decode("utf-8", "replace"))
                    total.append(n)
                    removed.append(0 if words is None else n - len(words))
            made = {"kept_text": pa.array(kept, pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | made)

    text, doc_id = (F.col(f"{ROW}.`{c}`" if whole_rows else c) for c in ("text", "doc_id"))
    rows = rows.select(*columns, *([] if "text" in columns else [text.alias("text")]), F.coalesce(doc_id.cast("long"), F.lit(_LEAST)).alias("doc_key"), _mark(text).alias("doc_mark"))
    joined = rows.join(listed, (rows["doc_key"] == listed["doc"]) & (rows["doc_mark"] == listed["mark"]), "left")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return joined.select(*columns, *([] if "text" in columns else ["text"]), "spans").mapInArrow(clean, f"{kinds}, kept_text string, n_words long, n_removed long")


def remove(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` without its duplicate words: all columns, ``text`` as it was where nothing is removed. ``n_chars``, if
    there is one, follows the text."""
    found = cleaned(docs, whole_rows=True, window=window, anchor=anchor)
    text = F.coalesce(F.col("kept_text"), F.col(f"{ROW}.`text`"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        length = F.when(F.col("kept_text").isNotNull(), F.length("kept_text")).otherwise(F.col(f"{ROW}.`n_chars`"))
        changed["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col(f"{ROW}.`{c}`")).alias(c) for c in docs.columns])
