"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled documents: words and word stems that occur in toxic documents, in many different
surroundings, and hardly ever in clean ones. It is kept as a trie. The Levenshtein automata of all terms are run
together, intersected with the trie: a state is a set of (trie node, edits so far), made deterministic on demand, so
a word costs one look-up per character and most words die after two or three. A hit is exact or misspelled, and its
context window tells whether it is quoted or reported ("the word ...") or stands as abuse. A logistic model over the
counts of the kinds of hits gives the score.

Defined cases: null or empty text has no hits and gets the score of a text without hits; whole texts are read,
whatever their length; repeated rows score alike; without toxic training documents the lexicon is empty and every
score is that of a text without hits; equal texts score alike, so equal scores are no ties to break; a document with
several labels takes the largest; other columns are not read. Counts of hits of one kind enter up to 7, which tells
few from many and keeps a very long text from outweighing its kind; all hits are counted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import CACHES, labelled_sample, map_columns

# Marks and words by which a text quotes or reports a term instead of using it.
QUOTES = "\"'`“”„«»‹›‘’"
REPORTING = frozenset("word words term terms called calling said says saying quote quoted quoting slur insult mot terme dit palabra término dicho wort begriff sagte genannt".split())

TOKEN = re.compile(r"[^\W_]+(?:[@$*0-9][^\W_]+)*", re.UNICODE)
WINDOW = 3
KINDS = ("word", "stem", "near_word", "near_stem")
PRIOR = np.array([-3.0, 4.5, 4.5, 2.0, 1.5, 0.5, 0.5, 0.2, 0.2, 0.5])  # bias, kinds in abuse, kinds quoted, density


@dataclass
class Trie:
    """Nodes by number: children by character; terms that end there."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[tuple[str, bool] | None] = field(default_factory=lambda: [None])

    def add(self, term: str, stem: bool) -> None:
        at = 0
        for c in term:
            if c not in self.children[at]:
                self.children[at][c] = len(self.children)
                self.children.append({})
                self.ends.append(None)
            at = self.children[at][c]
        if self.ends[at] is None or stem:
            self.ends[at] = (term, stem)


class Automaton:
    """The trie's terms within their allowed edits (insert, drop, change, swap of neighbours counts as two)."""

    def __init__(self, terms: list[tuple[str, bool]], short: int = 5, long: int = 9) -> None:
        self.trie = Trie()
        for term, stem in sorted(terms):
            self.trie.add(term, stem)
        self.short, self.long = short, long
        self.most = 2 if any(len(t) >= long for t, _ in terms) else 1
        self.moves: list[dict[str, int]] = []
        self.keys: list[tuple] = []
        self.found: list[tuple | None] = []
        self.numbers: dict[tuple, int] = {}
        self.dead = self._state({})
        self.start = self._state(self._closed({0: 0}))

    def allowed(self, term: str) -> int:
        return 0 if len(term) < self.short else 1 if len(term) < self.long else 2

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes reached by leaving out characters of a term."""
        todo = list(state.items())
        while todo:
            node, edits = todo.pop()
            if edits < self.most:
                for child in self.trie.children[node].values():
                    if state.get(child, 9) > edits + 1:
                        state[child] = edits + 1
                        todo.append((child, edits + 1))
        return state

    def _state(self, state: dict[int, int]) -> int:
        key = tuple(sorted(state.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.moves)
            self.moves.append({})
            self.keys.append(key)
            ends = [(edits, not end[1], end[0]) for node, edits in key if (end := self.trie.ends[node]) and edits <= self.allowed(end[0])]
            self.found.append(min(((e, "word" if w else "stem", t) for e, w, t in ends), default=None))
        return self.numbers[key]

    def _step(self, at: int, c: str) -> int:
        key = self.keys[at]
        new: dict[int, int] = {}
        for node, edits in key:
            for ch, child in self.trie.children[node].items():
                cost = edits + (ch != c)
                if cost <= self.most and cost < new.get(child, 9):
                    new[child] = cost
            if edits < self.most and edits + 1 < new.get(node, 9):
                new[node] = edits + 1  # c is one too many
        return self._state(self._closed(new))

    def match(self, word: str) -> tuple[int, str, str] | None:
        """(edits, kind, term) of the best term that the word is, or, for stems, begins with; None if there is none."""
        at, moves, best = self.start, self.moves, None
        for c in word:
            to = moves[at].get(c)
            if to is None:
                to = moves[at][c] = self._step(at, c)
            at = to
            if at == self.dead:
                break
            f = self.found[at]
            if f is not None and f[1] == "stem" and (best is None or f < best):
                best = f
        else:
            f = self.found[at]
            if f is not None and (best is None or f < best):
                best = f
        return best


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    known: frozenset[str]  # spellings near a term that clean texts use
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.automaton = Automaton(self.terms)
        self.memory: dict[str, int] = {}
        CACHES.append(self.memory.clear)

    def __reduce__(self):
        return Model, (self.terms, self.known, self.weights)

    def kind(self, word: str) -> int:
        """Index into KINDS, or -1."""
        low = word.lower()
        m = self.automaton.match(low)
        if m is None or (m[0] and low in self.known):
            return -1
        return (2 if m[0] else 0) + (m[1] == "stem")

    def hits(self, text: str) -> list[tuple[str, int, bool, int]]:
        """(spelling, kind, quoted, number of other hits within the window) for every hit of the whole text."""
        memory, found, where, starts = self.memory, [], [], []
        words = TOKEN.findall(text)
        for k, w in enumerate(words):
            try:
                kind = memory[w]
            except KeyError:
                if len(memory) > 100_000:
                    memory.clear()
                kind = memory[w] = self.kind(w)
            if kind >= 0:
                where.append((k, w, kind))
        if not where:
            return found
        starts = [m.span() for m in TOKEN.finditer(text)]
        places = [k for k, _, _ in where]
        for i, (k, w, kind) in enumerate(where):
            a, b = starts[k]
            marked = bool(a and text[a - 1] in QUOTES and b < len(text) and text[b : b + 1] in QUOTES)
            reported = any(x.lower() in REPORTING for x in words[max(0, k - WINDOW) : k])
            near = sum(1 for p in places[max(0, i - WINDOW) : i + WINDOW + 1] if p != k and abs(p - k) <= WINDOW)
            found.append((w, kind, marked or reported, near))
        return found

    def features(self, text: str | None) -> np.ndarray:
        x = np.zeros(len(PRIOR))
        x[0] = 1
        for _, kind, quoted, near in self.hits(text or ""):
            x[1 + kind + 4 * quoted] += 1
            x[9] += near > 0 and not quoted
        x[1:] = np.log2(1 + np.minimum(x[1:], 7))
        return x

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.features(text) @ self.weights)))))


def learn_terms(texts: list[str], toxic: list[int], share: float = 0.01) -> list[tuple[str, bool]]:
    """(term, is a stem): frequent in toxic texts, in many surroundings, rare in clean ones.

    Surroundings (the words before and after) and groups of near copies are counted instead of texts, so that words of
    one text and its many copies do not count as frequent. A prefix is a stem where words branch: it has many more surroundings than any of
    its continuations.
    """
    n_toxic = sum(toxic)
    least = max(3, math.ceil(share * n_toxic))
    around, within, clean, n_clean = defaultdict(set), defaultdict(set), Counter(), len(texts) - n_toxic
    groups = copy_groups([t for t, y in zip(texts, toxic) if y])
    at = iter(groups)
    for text, t in zip(texts, toxic):
        words = [w.lower() for w in TOKEN.findall(text)]
        if t:
            group = next(at)
            for w in set(words):
                within[w].add(group)
            for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                around[w].add(zlib.crc32(f"{before} {after}".encode()))
        else:
            clean.update(set(words))
    clean_prefix: Counter = Counter()
    for w, n in clean.items():
        for k in range(4, min(len(w), 10)):
            clean_prefix[w[:k]] += n
    branches: dict[str, Counter] = defaultdict(Counter)
    held: dict[str, set] = defaultdict(set)
    for w, s in around.items():
        for k in range(4, min(len(w), 9) + 1):
            held[w[:k]] |= within[w]
        for k in range(4, min(len(w), 10)):
            branches[w[:k]][w[k]] += len(s)
        if 4 <= len(w) < 10:
            branches[w][""] += len(s)
    doubt = 2 * math.log(len(around) + 10) + 8  # the likelihood ratio that chance reaches for no candidate of so many

    def pure(n: int, c: int) -> bool:
        odds = n / max(1, n_toxic) / ((n + c) / max(1, len(texts)))
        return c <= 0.02 * n + 0.001 * n_clean and odds > 1 and 2 * n * math.log(odds) >= doubt

    stems = []
    for p in sorted(branches, key=len):
        total, forms = sum(branches[p].values()), len(branches[p])
        if total >= 2 * least and len(held[p]) >= least and forms >= 4 and max(branches[p].values()) <= 0.6 * total and pure(len(held[p]), clean_prefix[p] + clean[p]) and not any(p.startswith(s) for s in stems):
            stems.append(p)
    words = [w for w, s in around.items() if len(w) >= 3 and min(len(s), len(within[w])) >= least and pure(len(within[w]), clean[w]) and not any(w.startswith(p) for p in stems)]
    return sorted([(w, False) for w in words] + [(p, True) for p in stems])


def copy_groups(texts: list[str], bands: int = 8, rows: int = 4) -> list[int]:
    """A number for each text; texts that share a band of min-hashes of their word pairs have the same."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[tuple[int, ...], int] = {}
    for i, text in enumerate(texts):
        words = TOKEN.findall(text.lower())
        pairs = np.array([zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])] or [i], np.uint64)
        low = [int((pairs * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE5AB) >> np.uint64(16)).min()) for k in range(bands * rows)]
        for k in range(bands):
            parent[root(i)] = root(first.setdefault((k, *low[k * rows : k * rows + rows]), i))
    return [root(i) for i in range(len(texts))]


def fit(texts: list[str], toxic: list[int], prior: float = 0.3) -> Model:
    """Lexicon from all texts; weights from them by Newton steps towards the most likely, with PRIOR as the prior mean.

    Spellings near a term are taken as known words if clean texts of one half use them; misspelling weights are
    learned on the other half, where those spellings are what a new text would bring.
    """
    texts = [t or "" for t in texts]
    terms = learn_terms(texts, toxic) if any(toxic) else []
    bare = Model(terms, frozenset(), PRIOR)

    def near(chosen: Iterator[str]) -> frozenset[str]:
        seen: set[str] = set()
        for t in chosen:
            seen.update(x[0].lower() for x in bare.hits(t) if x[1] >= 2)
        return frozenset(seen)

    clean = [t for t, y in zip(texts, toxic) if not y]
    half = Model(terms, near(clean[::2]), PRIOR)
    rows = [(half.features(t), 0) for t in clean[1::2]] + [(half.features(t), 1) for t, y in zip(texts, toxic) if y]
    if not rows or not terms:
        return Model(terms, near(clean), PRIOR)
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    weight = np.where(y == 1, prior / max(1e-9, y.mean()), (1 - prior) / max(1e-9, 1 - y.mean()))
    w, hold = PRIOR.copy(), np.diag([0.05, *[0.5] * (len(PRIOR) - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + hold @ (w - PRIOR)
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + hold, g)
        w = w - step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-6:
            break
    w[1:3] = np.maximum(w[1:3], 0.4 - w[0])  # one exact term used as abuse is enough
    return Model(terms, near(clean), w)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0, sample: int = 2000, longest: int = 20_000) -> Model:
    """Fits on the driver on about ``sample`` documents of each label value, of those not held out and of at most
    ``longest`` characters, so on 2 * sample * longest characters at most."""
    picked = labelled_sample(docs, labels, label, modulus, held, sample).filter(F.length("text") <= longest)
    rows = sorted((r["doc_id"], r["text"], int(r["label"] > 0)) for r in picked.collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for every row of docs(doc_id, text)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": [model.score(t) for t in b["text"]]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """Every hit as a row: doc_id, spelling, kind, quoted."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = [(d, w, KINDS[k], q) for d, t in zip(b["doc_id"], b["text"]) for w, k, q, _ in model.hits(t or "")]
            yield {n: [r[i] for r in rows] for i, n in enumerate(("doc_id", "spelling", "kind", "quoted"))}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, spelling string, kind string, quoted boolean")
