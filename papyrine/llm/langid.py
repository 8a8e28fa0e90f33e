"""Language identification by error-correcting output codes over character n-grams.

Every learned language has a codeword of bits. One binary logistic classifier per bit reads hashed counts of letter
1-, 2- and 3-grams of the whole text (square roots of shares, so length does not matter). Decoding adds up each
classifier's logistic loss against each codeword, weighted by the classifier's training accuracy, and takes the
codeword of least loss; where the two best lie close together the text is flagged ambiguous.

The classifiers are fitted on the driver on a sample bounded by ``sample`` documents; everything else is one pass
over the texts.

Where codewords lie equally far the first language by name is taken; equal texts are judged alike.

Defined cases: null text, or text without a letter, is ``und`` with score 0; no learned language makes every text
``und``; one learned language is predicted with score 1; repeated rows are judged alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import hash_sample, map_columns, remainder, written

DIMS = 1 << 12
PIECE = 1 << 20  # code points worked on at once
_TABLE: np.ndarray | None = None


def _letters(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters' code points; 32 for all else."""
    global _TABLE
    if _TABLE is None:
        chars = [chr(i) for i in range(1 << 16)]
        _TABLE = np.array([ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in chars], np.uint32)
    out = _TABLE[np.minimum(codes, 0xFFFF)]
    if len(codes) and codes.max() > 0xFFFF:
        high = codes > 0xFFFF
        kinds, place = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([k if chr(k).isalpha() else 32 for k in kinds.tolist()], np.uint32)[place]
    return out


def features(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """The n-gram vector of a whole text, of length 1; None without a letter."""
    total, tail = np.zeros(dims), np.array([32, 32], np.uint32)
    if not text:
        return None
    shift = np.uint32(32 - dims.bit_length() + 1)
    any_letter = False
    for k in range(0, len(text), PIECE):
        new = _letters(np.frombuffer(text[k : k + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32))
        any_letter = any_letter or bool((new != 32).any())
        if k + PIECE >= len(text):
            new = np.append(new, np.uint32(32))
        a = np.concatenate([tail, new])
        tail = a[-2:]
        x, y, z = a[:-2], a[1:-1], a[2:]
        letter = (y != 32) | (z != 32)
        one, two = z * np.uint32(0x9E3779B1), y * np.uint32(0x85EBCA6B)
        grams = np.concatenate([one[z != 32], ((one ^ two) * np.uint32(0x27D4EB2F))[letter], ((one ^ two) + x * np.uint32(0xC2B2AE35) ^ np.uint32(0x165667B1))[letter] * np.uint32(0x9E3779B1)])
        total += np.bincount(grams >> shift, minlength=dims)
    if not any_letter:
        return None
    v = np.sqrt(total)
    return v / np.linalg.norm(v)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all distinct splits for up to 6 languages, else the best spread of seeded random codes."""
    if n <= 6:
        return np.array([[1 if k == 0 or not (m >> (k - 1)) & 1 else -1 for m in range(1, 1 << (n - 1))] for k in range(n)])
    bits, best, spread = int(np.ceil(12 * np.log2(n))), None, (-1, -1)
    for seed in range(60):
        m = np.random.default_rng(seed).choice([-1, 1], (n, bits))
        apart = (bits - m @ m.T) // 2 + bits * np.eye(n, dtype=int)
        mixed = np.minimum((m > 0).sum(0), (m < 0).sum(0)).min()  # a bit that is the same for all teaches nothing
        if (apart.min(), mixed) > spread:
            best, spread = m, (apart.min(), mixed)
    return best


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray  # dims + 1 by bits, the last row is the bias
    trust: np.ndarray  # of each bit

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Rows of x against languages."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        return (np.logaddexp(0, -margin[:, None, :] * self.codes[None]) * self.trust).sum(2) / self.trust.sum()

    def predict(self, texts: list[str | None], close: float = 0.15) -> list[tuple[str, float, bool]]:
        found = [features(t) if self.langs else None for t in texts]
        known = [k for k, f in enumerate(found) if f is not None]
        out: list[tuple[str, float, bool]] = [("und", 0.0, False)] * len(texts)
        if len(self.langs) == 1:
            for k in known:
                out[k] = (self.langs[0], 1.0, False)
        elif known:
            loss = self.losses(np.array([found[k] for k in known]))
            share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
            share /= share.sum(1, keepdims=True)
            least = np.sort(loss, 1)
            for k, row, s, l in zip(known, loss, share, least):
                out[k] = (self.langs[int(row.argmin())], float(s.max()), bool(l[1] - l[0] < close))
        return out


def fit(x: np.ndarray, langs: list[str], steps: int = 300, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Logistic classifiers for all bits at once, by full-batch Adam steps; languages weigh alike."""
    names = sorted(set(langs))
    if len(names) < 2:
        return Model(names, np.zeros((len(names), 1)), np.zeros((DIMS + 1, 1)), np.ones(1))
    codes, place = codewords(len(names)), np.array([names.index(a) for a in langs])
    y = codes[place].astype(np.float32)
    weight = (1 / np.bincount(place))[place].astype(np.float32)[:, None] / len(names)
    x = np.hstack([x.astype(np.float32), np.ones((len(x), 1), np.float32)])
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w
        g = x.T @ (-y * weight / (1 + np.exp(np.clip(y * z, -30, 30)))) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    right = (((x @ w) * y > 0) * weight).sum(0)
    return Model(names, codes, w.astype(np.float64), np.clip(2 * right - 1, 0.01, 1).astype(np.float64))


def train(docs: DataFrame, modulus: int = 3, held: int = 1, sample: int = 2000) -> Model:
    """Fits on about ``sample`` documents, spread evenly over the languages, of those not held out."""
    fit_for = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), modulus) != held)
    known = docs.filter(fit_for).select("doc_id", "lang")
    n = max(1, known.select("lang").distinct().count())
    ids = written(hash_sample(known, "doc_id", "lang", max(10, sample // n)).distinct(), "sample")
    picked = docs.filter(fit_for).select("doc_id", "text", "lang").join(ids, ["doc_id", "lang"])

    def vectors(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = [(f, lang) for t, lang in zip(b["text"], b["lang"]) if (f := features(t)) is not None]
            yield {"lang": [r[1] for r in rows], "v": [r[0].astype(np.float32).tobytes() for r in rows]}

    rows = sorted((r["lang"], bytes(r["v"])) for r in map_columns(picked.select("text", "lang"), vectors, "lang string, v binary").collect())
    x = np.array([np.frombuffer(v, np.float32) for _, v in rows]) if rows else np.zeros((0, DIMS), np.float32)
    return fit(x, [a for a, _ in rows])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs(doc_id, text)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = model.predict(b["text"])
            yield {"doc_id": b["doc_id"], "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "ambiguous": [r[2] for r in rows]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, ambiguous boolean")
