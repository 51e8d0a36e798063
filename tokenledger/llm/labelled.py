"""A bounded sample of labelled texts, and the calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id written as text; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int | tuple[int, int], where: Column | None = None, seed: str = "sample") -> DataFrame:
    """``(doc_id, text, label)``: of each class, the ``per_class`` labelled ids of lowest hash, and their texts.

    The sample of ids is chosen before texts are touched; its size being bounded so, it is broadcast, and no text moves
    but those chosen. ``per_class`` may be two numbers, for labels 0 and 1. An id labelled twice counts once (its greatest label), as does a document given twice.
    Rows with a null id or label are not used.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("sample_id"), F.col(label).cast("int").alias("label"))
    marks = marks.filter("sample_id is not null and label in (0, 1)")
    if where is not None:
        marks = marks.filter(where)
    zeros, ones = per_class if isinstance(per_class, tuple) else (per_class, per_class)
    order = (F.md5(F.concat(F.lit(seed), F.col("sample_id").cast("string"))), F.col("sample_id"))
    marks = marks.groupBy("sample_id").agg(F.max("label").alias("label"))
    chosen = marks.filter("label = 0").orderBy(*order).limit(zeros).unionByName(marks.filter("label = 1").orderBy(*order).limit(ones))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["sample_id"])
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def platt(scores: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """``(a, b)`` so that ``sigmoid(a * score + b)`` is the probability of label 1, with smoothed targets (Platt, 1999)."""
    if not len(scores) or labels.min() == labels.max():
        return 1.0, 0.0
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    spread = scores.std() or 1.0
    x, a, b = scores / spread, 1.0, 0.0
    for _ in range(steps):  # Newton
        p = sigmoid(a * x + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a / spread), float(b)
