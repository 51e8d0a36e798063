"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Input is a word's vector (hashed, letters folded to lower case, marks at its ends left out) plus the mean of its character
n-gram vectors. Two gated recurrent units read a window of words in both directions, attention pools their states, and a
logistic unit scores the window. All overlapping windows of a whole text are scored; a text has the score of its worst
window, calibrated on held-back rows. The network is trained here, in numpy, on a bounded sample of labelled rows: each
step takes one window of each text, the worst or one drawn by its odds, as labels are of texts.

The bound of the sample: ``per_class`` labelled ids of each class, of which those of at most ``TRAIN_WORDS`` words are
used. Scoring reads every word of every text and shuffles nothing. Edge cases: a null or blank text gets the score of a
window without words; without usable rows of both labels every score is 0.5; repeated rows score alike; an empty table
gives an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.llm import labelled
from tokenledger.llm import words as W

WINDOW = 64
STRIDE = 32
WORD_BITS = 18
CHAR_BITS = 14
CHAR_N = 3
SIZE = 16  # of an input vector
HIDDEN = 8  # of each direction
PER_CLASS = (1600, 700)  # of labels 0 and 1
TRAIN_WORDS = 512
STEPS = 450
BATCH = 32  # half of either label

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MARKS = np.zeros(256, bool)
_MARKS[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def _folded(rows: W.Words) -> W.Words:
    """The words in lower-case ASCII letters, without up to two marks at either end; a word of marks stays as it is."""
    data = _FOLD[rows.data]
    starts, ends = rows.starts.copy(), rows.ends.copy()
    for _ in range(2):
        starts += _MARKS[data[starts]] & (ends - starts > 1)
        ends -= _MARKS[data[ends - 1]] & (ends - starts > 1)
    return W.Words(data, rows.offsets, starts, ends, rows.bounds, rows.first)


@dataclass
class Inputs:
    """The different words of some texts and, for each text, its words' numbers."""

    word: np.ndarray  # slot of each different word
    chars: np.ndarray  # slots of character n-grams, one word after another
    char_bounds: np.ndarray
    number: np.ndarray  # of each word of the texts
    bounds: np.ndarray


def inputs(rows: W.Words) -> Inputs:
    folded = _folded(rows)
    hashes = folded.hashes()
    unique, at, number = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = folded.ends[at] - folded.starts[at]
    # Each word stands between two boundary bytes; its n-grams are taken over them.
    padded = lengths + 2
    bounds = np.concatenate([[0], np.cumsum(padded)])
    inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text = np.zeros(bounds[-1], np.uint32)
    text[np.repeat(bounds[:-1] + 1, lengths) + inner] = folded.data[np.repeat(folded.starts[at], lengths) + inner]
    text[bounds[:-1]] = 1
    text[bounds[1:] - 1] = 2
    code = np.zeros(max(len(text) - CHAR_N + 1, 0), np.uint32)
    for k in range(CHAR_N):
        code |= text[k : len(text) - CHAR_N + 1 + k] << np.uint32(8 * k)
    slots = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64)
    grams = padded - CHAR_N + 1
    char_bounds = np.concatenate([[0], np.cumsum(grams)])
    picked = np.repeat(bounds[:-1], grams) + np.arange(grams.sum()) - np.repeat(char_bounds[:-1], grams)
    return Inputs((unique >> np.uint64(64 - WORD_BITS)).astype(np.int64), slots[picked], char_bounds, number, rows.bounds)


def window_table(bounds: np.ndarray, number: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all overlapping windows, ``(windows, WINDOW)`` filled up with ``pad``, and the row of each window.
    A row without words has one empty window."""
    counts = np.diff(bounds)
    per_row = 1 + np.maximum(-(-(counts - WINDOW) // STRIDE), 0)
    row = np.repeat(np.arange(len(counts)), per_row)
    start = (np.arange(len(row)) - (np.cumsum(per_row) - per_row)[row]) * STRIDE
    at = start[:, None] + np.arange(WINDOW)
    inside = at < counts[row][:, None]
    table = np.full(at.shape, pad, np.int64)
    table[inside] = number[(bounds[:-1][row][:, None] + at)[inside]]
    return table, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters by name; ``scale`` and ``shift`` turn a logit into a probability."""

    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    slots: np.ndarray | None = field(default=None, repr=False)

    @staticmethod
    def new(seed: int = 11) -> "Network":
        rng = np.random.default_rng(seed)

        def draw(*shape: int, size: float = 0.3) -> np.ndarray:
            return (rng.standard_normal(shape) * size).astype(np.float32)

        p = {"words": np.zeros((1 << WORD_BITS, SIZE), np.float32), "chars": draw(1 << CHAR_BITS, SIZE, size=0.3)}
        for way in ("f", "b"):
            p |= {f"wx_{way}": draw(SIZE, 3 * HIDDEN), f"bias_{way}": np.zeros(3 * HIDDEN, np.float32), f"u_{way}": draw(HIDDEN, 2 * HIDDEN), f"un_{way}": draw(HIDDEN, HIDDEN)}
        p |= {"att": draw(2 * HIDDEN, 2 * HIDDEN), "att_bias": np.zeros(2 * HIDDEN, np.float32), "att_out": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "out_bias": np.zeros(1, np.float32)}
        return Network(p)

    def embed(self, x: Inputs, drop: np.ndarray | None = None) -> np.ndarray:
        """A vector for each different word, and one of zeros for padding."""
        grams = np.zeros((len(x.word) + 1, SIZE), np.float32)
        if len(x.word):
            sums = np.add.reduceat(self.p["chars"][x.chars], x.char_bounds[:-1], axis=0)
            grams[:-1] = sums / np.diff(x.char_bounds)[:, None].astype(np.float32)
            known = self.p["words"][x.word]
            grams[:-1] += known if drop is None else known * drop[:, None]
        return grams

    def run(self, vectors: np.ndarray, table: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The logit of each window; ``keep`` takes what the backward pass needs."""
        p, n, pad = self.p, len(table), len(vectors) - 1
        states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        for k, way in enumerate("fb"):
            gates = vectors @ p[f"wx_{way}"] + p[f"bias_{way}"]
            gates[pad, :HIDDEN] = 30.0  # padding leaves the state as it is
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
                g = gates[table[:, t]]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ p[f"u_{way}"])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ p[f"un_{way}"])
                if keep is not None:
                    keep.append((way, t, h, z, r, new))
                h = new + z * (h - new)
                states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
        hidden = np.tanh(states.reshape(-1, 2 * HIDDEN) @ p["att"] + p["att_bias"])
        energy = (hidden @ p["att_out"]).reshape(WINDOW, n)
        masked = (table == pad).T
        energy[masked] = -30.0
        energy -= energy.max(axis=0)
        weight = np.exp(energy)
        weight[masked] = 0.0
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep.append((states, hidden, weight, pooled))
        return pooled @ p["out"] + p["out_bias"][0]

    def gradients(self, vectors: np.ndarray, table: np.ndarray, kept: list, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters past the inputs, and of the words' vectors."""
        p, n = self.p, len(table)
        states, hidden, weight, pooled = kept[-1]
        g = {"out": pooled.T @ d_logit, "out_bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnh,nh->tn", states, d_pooled)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_hidden = d_energy.reshape(-1, 1) * p["att_out"] * (1 - hidden**2)
        g |= {"att_out": hidden.T @ d_energy.reshape(-1), "att": states.reshape(-1, 2 * HIDDEN).T @ d_hidden, "att_bias": d_hidden.sum(axis=0)}
        d_states += (d_hidden @ p["att"].T).reshape(states.shape)
        d_vectors = np.zeros_like(vectors)
        pad = len(vectors) - 1
        for k, way in enumerate("fb"):
            steps = [x for x in kept[:-1] if x[0] == way]
            g[f"u_{way}"], g[f"un_{way}"] = np.zeros_like(p[f"u_{way}"]), np.zeros_like(p[f"un_{way}"])
            d_gates = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
            d_h = np.zeros((n, HIDDEN), np.float32)
            for _, t, h, z, r, new in reversed(steps):
                d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d_z = d_h * (h - new) * z * (1 - z)
                d_new = d_h * (1 - z) * (1 - new**2)
                d_rh = d_new @ p[f"un_{way}"].T
                d_zr = np.concatenate([d_z, d_rh * h * r * (1 - r)], axis=1)
                g[f"u_{way}"] += h.T @ d_zr
                g[f"un_{way}"] += (r * h).T @ d_new
                np.add.at(d_gates, table[:, t], np.concatenate([d_zr, d_new], axis=1))
                d_h = d_h * z + d_rh * r + d_zr @ p[f"u_{way}"].T
            d_gates[pad] = 0.0
            g[f"wx_{way}"], g[f"bias_{way}"] = vectors.T @ d_gates, d_gates.sum(axis=0)
            d_vectors += d_gates @ p[f"wx_{way}"].T
        return g, d_vectors

    def logits(self, rows: W.Words, windows: int = 4096) -> np.ndarray:
        """The worst window's logit of each row."""
        x = inputs(rows)
        vectors = self.embed(x)
        out = np.full(rows.rows, -np.inf)
        table, row = window_table(x.bounds, x.number, len(vectors) - 1)
        for at in range(0, len(table), windows):
            np.maximum.at(out, row[at : at + windows], self.run(vectors, table[at : at + windows]))
        return out

    def probability(self, rows: W.Words) -> np.ndarray:
        return labelled.sigmoid(self.scale * self.logits(rows) + self.shift)

    def slim(self) -> "Network":
        """The same with only the word vectors that training has touched, to be sent to tasks."""
        used = np.flatnonzero(self.p["words"].any(axis=1))
        return Network(self.p | {"words": self.p["words"][used]}, self.scale, self.shift, used)

    def whole(self) -> "Network":
        if self.slots is None:
            return self
        words = np.zeros((1 << WORD_BITS, SIZE), np.float32)
        words[self.slots] = self.p["words"]
        return Network(self.p | {"words": words}, self.scale, self.shift)


def fit(texts: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 3) -> Network:
    """Train on whole short texts, ``y`` 0 or 1; a fifth is held back for the probabilities."""
    net = Network.new(seed)
    if not len(y) or y.min() == y.max():
        return Network(net.p, 0.0, 0.0)

    def rows(which: np.ndarray) -> W.Words:
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in which])])
        return W.split(np.frombuffer(b"".join(texts[i] for i in which), np.uint8), offsets)

    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 0
    used = np.flatnonzero(~held)
    m, v = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}
    queues: list[list[int]] = [[], []]

    def draw() -> np.ndarray:
        picked = []
        for label, queue in enumerate(queues):
            while len(queue) < batch // 2:
                queue.extend(rng.permutation(used[y[used] == label]).tolist())
            picked += [queue.pop(0) for _ in range(batch // 2)]
        return np.array(picked)

    if y[used].min() < y[used].max():
        for step in range(1, steps + 1):
            picked = draw()
            x = inputs(rows(picked))
            drop = (rng.random(len(x.word)) > 0.3).astype(np.float32)
            vectors = net.embed(x, drop)
            table, row = window_table(x.bounds, x.number, len(vectors) - 1)
            logit = net.run(vectors, table)
            # Of a text of label 1 a window is drawn by its odds, so that all are tried at first; else the worst is taken.
            drawn = logit + np.where(y[picked][row] > 0, rng.gumbel(size=len(row)), 0.0)
            worst = np.lexsort((-drawn, row))[np.searchsorted(row, np.arange(len(picked)))]
            kept: list = []
            logit = net.run(vectors, table[worst], kept)
            d_logit = ((_sigmoid(logit) - y[picked]) / len(picked)).astype(np.float32)
            g, d_vectors = net.gradients(vectors, table[worst], kept, d_logit)
            d_chars = np.repeat(d_vectors[:-1] / np.maximum(np.diff(x.char_bounds), 1)[:, None], np.diff(x.char_bounds), axis=0)
            g["words"], g["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
            np.add.at(g["words"], x.word, d_vectors[:-1] * drop[:, None])
            np.add.at(g["chars"], x.chars, d_chars)
            pace = rate * (0.3 if step > steps * 3 // 4 else 1.0)
            for k, a in net.p.items():  # Adam; vectors that this step does not touch stay
                at_ = np.flatnonzero(g[k].any(axis=1)) if k in ("words", "chars") else slice(None)
                d = g[k][at_]
                m[k][at_] = 0.9 * m[k][at_] + 0.1 * d
                v[k][at_] = 0.999 * v[k][at_] + 0.001 * d * d
                a[at_] -= pace * (m[k][at_] / (1 - 0.9**step)) / (np.sqrt(v[k][at_] / (1 - 0.999**step)) + 1e-8)
    # Too few rows of a label held back say nothing about the other rows; then all take part.
    back = np.flatnonzero(held) if min(y[held].sum(), (1 - y[held]).sum()) >= 20 else np.arange(len(y))
    net.scale, net.shift = labelled.platt(net.logits(rows(back)), y[back])
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS, where: Column | None = None) -> Network:
    """Fit on a bounded sample; what reaches the driver is texts of at most ``TRAIN_WORDS`` words."""
    chosen = labelled.sample(docs, labels, label, per_class, where)
    short = chosen.filter(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) <= TRAIN_WORDS)
    found = short.toPandas().sort_values("doc_id", ignore_index=True)
    return fit([t.encode() for t in found["text"]], found["label"].to_numpy(np.int64))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """``(doc_id, score)`` of whole texts; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(net.slim())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.whole()
        for batch in batches:
            made = [own.probability(rows) for rows in W.each_chunk(batch.column("text"))]
            if made:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(np.concatenate(made).astype(np.float64))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
