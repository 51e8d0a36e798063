"""Quality rules: counting rules, then a hashed n-gram logistic regression held to a fixed threshold.

Fixed counting rules fail a text with few words or much repetition. The rest is up to a logistic regression over the
hashed word, word-shape and byte n-grams of ``features``, fitted on a bounded sample of labelled rows (``per_class`` of
each label), calibrated on a fifth of that sample, and applied to whole texts in Arrow batches.

Edge cases: a null or blank text has 0 words and fails the counting rules. Without labelled rows of both kinds the model
is neutral (probability 0.5) and keeps. Repeated rows are judged alike. An empty table gives an empty table. ``filter``
carries other columns along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import features, labelled
from tokenledger.llm import words as W
from tokenledger.llm.tables import ROW, packed, stage

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WORDS = 8
SYMBOLS = b"#*$%&|<>"
#: Kept if the calibrated probability of good quality is at least this.
KEEP = 0.5
#: Labelled rows of each class that the model is fitted on.
PER_CLASS = 1000
#: Slots of all their texts together that reach the driver; texts are taken by falling hash of their id until then.
SAMPLE_SLOTS = 12_000_000
#: Sampled texts whose gradient is summed at once.
BATCH = 100
STEPS = 120

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass
class Model:
    weights: np.ndarray  # one per slot
    bias: float
    scale: float
    shift: float

    def raw(self, rows: W.Words) -> np.ndarray:
        """Per row: the bias and, for each family, the mean weight of its n-grams."""
        z = np.full(rows.rows, self.bias)
        for _, slots, bounds in features.extract(rows):
            z += W.row_sums(self.weights[slots], bounds) / np.maximum(np.diff(bounds), 1)
        return z

    def probability(self, rows: W.Words) -> np.ndarray:
        return labelled.sigmoid(self.scale * self.raw(rows) + self.shift)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per sampled text: its slots and, for each, the share of its family's n-grams, summed over families."""
    for batch in batches:
        slots, shares = [], []
        for rows in W.each_chunk(batch.column("text")):
            found = features.extract(rows)
            for i in range(rows.rows):
                at = [s[b[i] : b[i + 1]] for _, s, b in found]
                part = [np.full(len(a), 1 / max(len(a), 1), np.float32) for a in at]
                unique, inverse = np.unique(np.concatenate(at), return_inverse=True)
                slots.append(unique.astype("<i4").tobytes())
                shares.append(np.bincount(inverse, np.concatenate(part), len(unique)).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "slots": pa.array(slots, pa.binary()), "shares": pa.array(shares, pa.binary())})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, steps: int = STEPS, ridge: float = 1e-5) -> Model:
    """Fit on a bounded sample; what reaches the driver is the sample's n-gram shares."""
    size = 1 << features.BITS
    found = stage(labelled.sample(docs, labels, label, per_class).mapInArrow(_sample_features, "doc_id long, label int, slots binary, shares binary"), "rules-sample")
    sizes = found.select("doc_id", F.xxhash64("doc_id").alias("hash"), (F.length("slots") / 4).alias("slots")).toPandas().sort_values("hash", ascending=False)
    taken = sizes["doc_id"][sizes["slots"].cumsum() <= SAMPLE_SLOTS].tolist()
    rows = (found if len(taken) == len(sizes) else found.filter(F.col("doc_id").isin(taken))).toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    y = rows["label"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size, np.float32), 0.0, 0.0, 0.0)
    slots = [np.frombuffer(s, "<i4") for s in rows["slots"]]
    shares = [np.frombuffer(s, "<f4") for s in rows["shares"]]
    held = np.arange(len(y)) % 5 == 0

    picked = np.flatnonzero(~held)
    column, value = np.concatenate([slots[i] for i in picked]), np.concatenate([shares[i] for i in picked])
    ends = np.concatenate([[0], np.cumsum([len(slots[i]) for i in picked])])
    batches = [(i, min(i + BATCH, len(picked))) for i in range(0, len(picked), BATCH)]
    target = y[picked]
    weight = np.where(target > 0, 0.5 / max(target.mean(), 1e-9), 0.5 / max(1 - target.mean(), 1e-9)) / len(target)
    # Rare shares move little by themselves: scale each slot by its root mean square, within bounds.
    squares = sum(np.bincount(column[ends[a] : ends[b]], value[ends[a] : ends[b]] ** 2, size) for a, b in batches)
    scale = 1 / np.maximum(np.sqrt(squares / len(picked)), 1e-2)
    w, bias, m, v = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):  # Adam on the whole sample
        g, scaled = np.append(ridge * w, 0.0), w * scale
        for a, b in batches:
            at, share = column[ends[a] : ends[b]], value[ends[a] : ends[b]]
            row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
            error = (labelled.sigmoid(np.bincount(row, share * scaled[at], b - a) + bias) - target[a:b]) * weight[a:b]
            g[:-1] += scale * np.bincount(at, share * error[row], size)
            g[-1] += error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    w = w * scale
    model = Model(w.astype(np.float32), float(bias), 1.0, 0.0)
    scores = np.array([float((w[slots[i]] * shares[i]).sum()) + bias for i in np.flatnonzero(held)])
    model.scale, model.shift = labelled.platt(scores, y[held])
    return model


def _in_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One key for a value and its row."""
    return W.mix(values ^ W.mix(row.astype(np.uint64) + np.uint64(1)))


def _line_duplicates(rows: W.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    data, offsets = rows.data, rows.offsets
    breaks = np.flatnonzero(data == 10)
    if not len(breaks):
        return np.zeros(rows.rows, np.int64)
    filled = np.diff(offsets) > 0
    starts = np.sort(np.concatenate([offsets[:-1][filled], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:][filled]]))
    row = np.searchsorted(offsets, ends, "left") - 1  # a line's end lies in its own text, or at the end of it
    worded = np.searchsorted(rows.starts, ends) > np.searchsorted(rows.starts, starts)
    starts, ends, row = starts[worded], ends[worded], row[worded]
    key = _in_row(W._run_hashes(W._LETTER[data], starts, ends), row)
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(row[again], minlength=rows.rows)


def _repeated_words(rows: W.Words, n: int = REPEAT_WORDS) -> np.ndarray:
    """Words inside windows of ``n`` words that occur at least twice in their text."""
    grams, at, row = W.windows(rows.hashes(), rows.bounds, n)
    if not len(grams):
        return np.zeros(rows.rows, np.int64)
    key = _in_row(grams, row)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(rows.starts) + 1, np.int64)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + n, -1)
    return W.row_sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), rows.bounds)


def base_counts(rows: W.Words) -> dict[str, np.ndarray]:
    """The counting rules' figures for each row."""
    data = rows.data
    letters = ((data & 0xC0) != 0x80) & ~W.WHITE[data]
    n_words, repeated = rows.counts.astype(np.int64), _repeated_words(rows)
    return {
        "n_words": n_words,
        "word_chars": W.row_sums(letters.astype(np.int64), rows.offsets),
        "n_symbols": W.row_sums(_SYMBOL[data].astype(np.int64), rows.offsets),
        "n_dup_lines": _line_duplicates(rows),
        "n_repeat_words": repeated,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words),
    }


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def judge(docs: DataFrame, model: Model, keep: float = KEEP, *columns: str, whole_rows: bool = False) -> DataFrame:
    """The named columns of ``docs`` and, per row, the counts, the model's ``probability`` and ``kept``. No shuffle.

    With ``whole_rows``, the packed row in place of columns.
    """
    rows = packed(docs) if whole_rows else docs.select(*dict.fromkeys([*columns, "text"]))
    columns = (ROW,) if whole_rows else columns

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[dict[str, np.ndarray]] = []
            for rows in W.each_chunk(batch.column(ROW).field("text") if whole_rows else batch.column("text")):
                found = base_counts(rows)
                p = model.probability(rows)
                parts.append(found | {"probability": p, "kept": ~found["base_failed"] & (p >= keep)})
            if parts:
                made = {k: pa.array(np.concatenate([x[k] for x in parts])) for k in parts[0]}
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | made)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in columns]
    return rows.mapInArrow(judged, ", ".join([*kinds, COUNTS, "probability double", "kept boolean"]))


def filter(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns."""
    return judge(docs, model, keep, whole_rows=True).filter("kept").select(f"{ROW}.*")
