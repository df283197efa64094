"""Quality classifier: attention-based multiple-instance learning over passages.

Method: a text is a bag of passages (``PASSAGE`` consecutive words each, the
whole text, no prefix).  A passage is encoded by statistics of its bytes and
words (case, digits, punctuation, hashed symbol classes, repeats, word length)
through a learned tanh layer; gated attention gives each passage a weight
a_i ~ exp(w . (tanh(V h_i) * sigmoid(U h_i))), and the weighted passage
representation sum a_i h_i is scored by a logistic output.  All weights are
learned together from document labels only (Adam on the log loss).

Bounds: training reads at most about ``TRAIN_ROWS`` labelled rows (chosen by
id hash; near copies once), so the fit itself is small; scoring is one narrow
map over all texts.

Defined cases: a null or empty text is one passage without words; null labels
are ignored, and of several labels of one doc_id the larger counts; without
labelled rows of both kinds every score is the share of label 1 (0 without
labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import text as T
from churnlens.llm.common import crc_fold
from churnlens.llm.toxicity import labelled_sample, score, without_copies

TRAIN_ROWS = 4_000
FOLDS, HELD_OUT = 4, 2
PASSAGE = 64
HIDDEN, GATE = 16, 8
STEPS, RATE = 250, 0.03
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.int64)  # 0 space, 1 lower, 2 upper, 3 digit, 4 common punctuation, 5 non-ASCII, 6.. symbols
_CLASS[[*range(0x61, 0x7B)]] = 1
_CLASS[[*range(0x41, 0x5B)]] = 2
_CLASS[[*range(0x30, 0x3A)]] = 3
_CLASS[list(b".,;:'-\"()?")] = 4
_CLASS[0x80:] = 5
_SYMBOLS = [b for b in range(0x21, 0x7F) if _CLASS[b] == 0]
for _i, _b in enumerate(_SYMBOLS):
    _CLASS[_b] = 6 + _i % 8
N_CLASSES = 14
N_IN = N_CLASSES + 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages and the n + 1 offsets of the documents' passages."""
    x = T.words_of(data, offsets)
    h = x.hashes()
    counts = np.diff(x.first)
    n_pass = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate(([0], np.cumsum(n_pass)))
    total = first[-1]
    out = np.zeros((total, N_IN))
    if len(h):
        doc = x.doc
        at = first[doc] + (np.arange(len(h)) - x.first[doc]) // PASSAGE  # passage of each word
        n = np.bincount(at, minlength=total).astype(float)
        some = np.maximum(n, 1)
        length = (x.end - x.start).astype(float)
        size = np.bincount(at, length, total)
        for c in range(1, N_CLASSES):
            cum = np.concatenate(([0], np.cumsum(_CLASS[data] == c)))
            out[:, c] = np.bincount(at, cum[x.end] - cum[x.start], total) / np.maximum(size, 1)
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((h, at))
        fresh = np.ones(len(h))
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1])
        out[:, N_CLASSES] = np.bincount(at, again, total) / some
        out[:, N_CLASSES + 1] = np.bincount(at[order], fresh, total) / some
        out[:, N_CLASSES + 2] = np.log1p(size / some)
        out[:, N_CLASSES + 3] = np.bincount(at, length == 1, total) / some
        out[:, N_CLASSES + 4] = np.log1p(n) / np.log1p(PASSAGE)
        last_class = _CLASS[data[x.end - 1]]
        out[:, N_CLASSES + 5] = np.bincount(at, last_class >= 6, total) / some
    return out, first


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Trained network, or a constant where there was nothing to learn from."""

    def __init__(self, constant: float = 0.0, mean=None, scale=None, params=None):
        self.constant, self.mean, self.scale, self.params = constant, mean, scale, params

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.params
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        at = first[:-1]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), np.diff(first)))
        a = e / np.repeat(np.add.reduceat(e, at), np.diff(first))
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        return h, t, g, a, z, _sigmoid(z @ p["c"] + p["d"][0])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.params is None:
            return np.full(len(offsets) - 1, self.constant)
        x, first = passages(data, offsets)
        return self.forward((x - self.mean) / self.scale, first)[-1]


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = 3) -> Model:
    """Full-batch Adam on the log loss of the bags ``x[first[i]:first[i+1]]``."""
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) + 0.02
    model = Model(0.0, x.mean(axis=0), scale, {})
    xs = (x - model.mean) / scale
    shapes = {"W": (N_IN, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = model.params = {k: rng.normal(0, 0.3, s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in shapes.items()}
    m1, m2 = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}
    sizes, at, n = np.diff(first), first[:-1], len(y)
    for step in range(1, steps + 1):
        h, t, g, a, z, out = model.forward(xs, first)
        dz = (out - y) / n
        grad = {"c": z.T @ dz, "d": np.array([dz.sum()])}
        dzh = np.repeat(dz, sizes)[:, None] * p["c"]
        da = (dzh * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, at), sizes))
        dgate = de[:, None] * p["w"]
        grad["w"] = (t * g).T @ de
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        grad["V"], grad["U"] = h.T @ dt, h.T @ dg
        dh = a[:, None] * dzh + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - h * h)
        grad["W"], grad["b"] = xs.T @ dpre, dpre.sum(axis=0)
        for k in p:
            gk = grad[k] + 1e-4 * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * gk
            m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
            p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows whose crc32 fold is not ``held_out``."""
    sample = without_copies(labelled_sample(docs, labels, "quality", crc_fold("doc_id", folds) != held_out, rows))

    def run(batches):
        for b in batches:
            for i, j, data, offsets in T.text_chunks(b.column("text")):
                x, first = passages(data, offsets)
                bags = pa.ListArray.from_arrays(pa.array(first * N_IN, pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("y").slice(i, j - i), bags], names=["doc_id", "y", "x"])

    bags = sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>").toPandas()
    if not len(bags):
        return Model(0.0)
    bags = bags.sort_values("doc_id", kind="stable")
    rows_x = [np.asarray(v, float).reshape(-1, N_IN) for v in bags["x"]]
    first = np.concatenate(([0], np.cumsum([len(v) for v in rows_x])))
    return train(np.concatenate(rows_x), first, (bags["y"].to_numpy() > 0).astype(float))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = fit(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
