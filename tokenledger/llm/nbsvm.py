"""Quality classifier: naive Bayes support vectors.

Each text becomes the set of its hashed word, word-shape and byte n-grams. An indicator is scaled by the log-count ratio
of its n-gram between the classes, each text to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent. The weights are pulled towards their mean size, as in the published method. Probabilities come from a sigmoid
fitted to held-back rows of the sample.

The fit uses a bounded sample (``per_class`` labelled rows of each label); scoring reads whole texts of all rows, without
a shuffle. Edge cases: a null or empty text has no n-grams and gets the score of the bias; without rows of both labels
every score is 0.5; repeated rows score alike; an empty table gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import features, labelled
from tokenledger.llm import words as W

PER_CLASS = 1500
ALPHA = 1.0  # smoothing of the counts
BETA = 0.25  # share of the fitted weight; the rest is the mean size
COST = 1.0
EPOCHS = 15


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each slot
    weights: np.ndarray  # weight times ratio
    bias: float
    scale: float
    shift: float

    def raw(self, slots: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(slots), self.bias)
        for i, s in enumerate(slots):
            if len(s):
                out[i] += self.weights[s].sum() / (np.sqrt(np.square(self.ratio[s]).sum()) or 1.0)
        return out

    def probability(self, slots: list[np.ndarray]) -> np.ndarray:
        return labelled.sigmoid(self.scale * self.raw(slots) + self.shift)


def indicators(rows: W.Words) -> list[np.ndarray]:
    """The different slots of each row."""
    found, out = features.extract(rows), []
    place = np.zeros(1 << features.BITS, np.int32)
    for i in range(rows.rows):
        slots = np.concatenate([s[b[i] : b[i + 1]] for _, s, b in found])
        number = np.arange(len(slots), dtype=np.int32)
        place[slots] = number  # the last one of equal slots stays
        out.append(slots[place[slots] == number])
    return out


def _sample_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [s.astype("<i4").tobytes() for rows in W.each_chunk(batch.column("text")) for s in indicators(rows)]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "slots": pa.array(slots, pa.binary())})


def log_count_ratio(slots: list[np.ndarray], y: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    size = 1 << features.BITS
    counts = [alpha + np.bincount(np.concatenate([s for s, c in zip(slots, y, strict=True) if c == k]), minlength=size) for k in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(values: list[np.ndarray], slots: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear support vector machine (Hsieh and others, 2008); ``y`` is -1 or 1."""
    w, bias, alpha = np.zeros(1 << features.BITS), 0.0, np.zeros(len(y))
    # The bias is a constant feature; a class that is rarer in the sample costs more.
    costs = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y < 0).sum(), 1)))
    square = np.array([float(np.square(v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (float(values[i] @ w[slots[i]]) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), costs[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[slots[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit(slots: list[np.ndarray], y: np.ndarray) -> Model:
    """``y`` is 0 or 1. A fifth of the rows is held back for the probabilities."""
    if not len(y) or y.min() == y.max():
        zero = np.zeros(1 << features.BITS, np.float32)
        return Model(zero, zero, 0.0, 0.0, 0.0)
    held = np.arange(len(y)) % 5 == 0
    if y[~held].min() == y[~held].max() or y[held].min() == y[held].max():
        held[:] = False
    used = [s for s, h in zip(slots, held, strict=True) if not h]
    sign = np.where(y[~held] > 0, 1.0, -1.0)
    ratio = log_count_ratio(used, y[~held])
    values = []
    for s in used:
        v = ratio[s]
        values.append(v / (np.sqrt(np.square(v).sum()) or 1.0))
    w, bias = dual_coordinate_descent(values, used, sign)
    w = (1 - BETA) * np.abs(w).mean() + BETA * w
    model = Model(ratio.astype(np.float32), (w * ratio).astype(np.float32), BETA * bias, 1.0, 0.0)
    back = held if held.any() else ~held
    model.scale, model.shift = labelled.platt(model.raw([s for s, h in zip(slots, back, strict=True) if h]), y[back])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, where: Column | None = None) -> Model:
    """Fit on a bounded sample; what reaches the driver is the sample's sets of slots."""
    chosen = labelled.sample(docs, labels, label, per_class, where)
    rows = chosen.mapInArrow(_sample_slots, "doc_id long, label int, slots binary").toPandas().sort_values("doc_id", ignore_index=True)
    return fit([np.frombuffer(s, "<i4") for s in rows["slots"]], rows["label"].to_numpy(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of whole texts; no shuffle."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.probability(indicators(rows)) for rows in W.each_chunk(batch.column("text"))]
            if made:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(np.concatenate(made))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
