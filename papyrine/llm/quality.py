"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words (split at ASCII white space). Every passage is encoded from shares of
character kinds, word shapes, repetition and its words, by hash in BUCKETS; a gated attention network learns from
document labels which passages matter, and the document's score is the classifier's answer on the attention-weighted
passage representation. Model and gradients are written out here; fitting runs on the driver on a sample bounded by
``sample`` documents per label and ``most`` passages, spread evenly, of each.

Defined cases: null or empty text is one passage of zeros; very long texts are scored whole, passage by passage;
repeated rows and equal texts score alike, so equal scores are no ties to break; a document with several labels takes
the largest; without labels of both kinds the score is the share of label 1 (1 without any); other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyrine.llm.common import bounded, labelled_sample, map_columns, slices, tidy

PASSAGE = 64
KINDS = 12
SHAPES = 19
BUCKETS = 64
FEATURES = SHAPES + BUCKETS
_KIND: np.ndarray | None = None


def _kinds() -> np.ndarray:
    """The kind of each UTF-8 byte."""
    global _KIND
    if _KIND is None:
        k = np.full(256, 11, np.uint8)
        for chars, kind in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" ", 3), ("\n", 4), (".,;:'", 5), ("!?", 6), ("|/\\_-+=~", 7), ("#$%&*@^", 8), ("()[]{}<>\"`", 9)):
            k[[ord(c) for c in chars]] = kind
        k[128:] = 10
        _KIND = k
    return _KIND


def passages(text: str | None, words_each: int = PASSAGE) -> np.ndarray:
    """One row of FEATURES numbers for each passage of the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros((1, FEATURES), np.float32)
    octets = np.frombuffer(raw, np.uint8)
    kind = _kinds()[octets]
    blank = (octets == 32) | ((octets >= 9) & (octets <= 13))  # where bytes.split() splits
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))  # where words begin
    cuts = first[::words_each].copy() if len(first) else np.zeros(1, np.int64)
    cuts[0] = 0
    counts = np.stack([np.add.reduceat((kind == k).astype(np.int32), cuts) for k in range(KINDS)], 1).astype(np.float32)
    size = counts.sum(1, keepdims=True)
    share = counts / size
    words = raw.split()
    out = np.zeros((len(cuts), FEATURES), np.float32)
    out[:, :KINDS] = np.sqrt(share)
    for k in range(len(cuts)):
        w = words[k * words_each : (k + 1) * words_each]
        n = max(1, len(w))
        out[k, 12] = len(set(w)) / n
        out[k, 13] = sum(map(bytes.__eq__, w, w[1:])) / n
    if words:
        place = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS + np.arange(len(words)) // words_each * BUCKETS
        out[:, SHAPES:] = np.sqrt(np.bincount(place, minlength=len(cuts) * BUCKETS).reshape(len(cuts), BUCKETS) / words_each)
    n_words = np.maximum(1, np.diff(np.append(np.arange(0, max(1, len(first)), words_each), max(1, len(first)))))[: len(cuts)]
    out[:, 14] = np.log1p(size[:, 0] / n_words) / 3
    out[:, 15] = counts[:, 1] / np.maximum(1, counts[:, 0] + counts[:, 1])
    out[:, 16] = np.minimum(1, (counts[:, 6] + counts[:, 8]) / n_words)
    out[:, 17] = np.minimum(1, counts[:, 7] / n_words)
    out[:, 18] = np.log1p(n_words) / 5
    return out


@dataclass
class Model:
    """p = sigmoid(c . sum_k a_k h_k + d), h = tanh(W x + b), a = softmax(w . (tanh(V h) * sigmoid(U h)))."""

    mean: np.ndarray
    spread: np.ndarray
    parts: dict[str, np.ndarray]
    constant: float | None = None

    def encode(self, x: np.ndarray, bag: np.ndarray, n: int) -> tuple:
        p = self.parts
        z = (x - self.mean) / self.spread
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * s) @ p["w"]
        starts = np.searchsorted(bag, np.arange(n))  # every bag has a passage
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = a / np.add.reduceat(a, starts)[bag]
        pooled = np.add.reduceat(a[:, None] * h, starts)
        return z, h, t, s, a, pooled, pooled @ p["c"] + p["d"][0]

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not bags:
            return np.full(len(bags), self.constant or 0.0)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return 1 / (1 + np.exp(-np.clip(self.encode(np.vstack(bags), bag, len(bags))[-1], -30, 30)))


def fit(bags: list[np.ndarray], labels: list[int], prior: float, width: int = 16, gates: int = 8, epochs: int = 60, batch: int = 64, rate: float = 0.01) -> Model:
    """Minibatch Adam on the log loss, with labels weighted to the share ``prior`` of label 1."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(y.mean()) if len(y) else 1.0)
    every = np.vstack(bags)
    rng = np.random.default_rng(11)
    p = {"W": rng.normal(0, 0.3, (FEATURES, width)), "b": np.zeros(width), "V": rng.normal(0, 0.3, (width, gates)), "U": rng.normal(0, 0.3, (width, gates)), "w": rng.normal(0, 0.3, gates), "c": rng.normal(0, 0.3, width), "d": np.zeros(1)}
    model = Model(every.mean(0), every.std(0) + 0.02, p)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            z, h, th, sg, a, pooled, out = model.encode(np.vstack([bags[i] for i in pick]), bag, len(pick))
            d_out = (1 / (1 + np.exp(-out)) - y[pick]) * weight[pick] / len(pick)
            g = {"c": pooled.T @ d_out, "d": np.array([d_out.sum()])}
            d_pool = d_out[:, None] * p["c"]
            towards = (d_pool[bag] * h).sum(1)
            d_e = a * (towards - np.bincount(bag, a * towards, len(pick))[bag])
            g["w"] = (th * sg).T @ d_e
            d_t, d_s = d_e[:, None] * p["w"] * sg * (1 - th**2), d_e[:, None] * p["w"] * th * sg * (1 - sg)
            g["V"], g["U"] = h.T @ d_t, h.T @ d_s
            d_h = (a[:, None] * d_pool[bag] + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h**2)
            g["W"], g["b"] = z.T @ d_h, d_h.sum(0)
            t += 1
            step = rate * (1 - epoch / epochs)
            for n in p:
                grad = g[n] + 1e-4 * p[n]
                m[n], v[n] = 0.9 * m[n] + 0.1 * grad, 0.999 * v[n] + 0.001 * grad**2
                p[n] -= step * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, sample: int = 1500, most: int = 48) -> Model:
    """Fits on about ``sample`` documents of each label value, of those not held out, at even odds.

    Passage features are made on the executors; the driver gets FEATURES numbers for each of at most ``most`` passages
    of a sampled document.
    """
    picked = labelled_sample(docs, labels, label, modulus, held, sample)

    def bags(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            every = [passages(t) for t in b["text"]]
            some = [x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(int)] for x in every]
            yield {"doc_id": b["doc_id"], "label": b["label"], "bag": [x.astype(np.float32).tobytes() for x in some]}

    rows = sorted(map_columns(picked, bags, "doc_id long, label int, bag binary").collect(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    return fit([np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, FEATURES) for r in rows], [int(r["label"] > 0) for r in rows], prior=0.7)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row of docs(doc_id, text)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": model.score([passages(t) for t in b["text"]]).tolist()}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for part in slices(batches):
                good = model.score([passages(t) for t in part.column("text").to_pylist()]) >= least
                yield part.filter(pa.array(good))
        finally:
            tidy()

    bounded(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
