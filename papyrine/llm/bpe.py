"""Byte-level BPE encoding and decoding with a sentencepiece model made from the vocabulary.

The vocabulary's tokens are byte strings with ranks. Each byte is mapped to one printable character, each token to a
piece of such characters with score ``-rank``; normalisation is the identity. The sentencepiece library then merges,
in every pre-token, the pair of highest score (lowest rank), leftmost first, as byte-level BPE does. Pre-tokens that
are tokens themselves are taken whole, as the tiktoken library does. Decoding maps ids back to bytes.

The model is serialised here, field by field, by the public protobuf schema of the library; nothing is trained.

Defined cases: null text counts as empty; an empty text has 0 tokens and the digests of the empty string; rows are
independent, so repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import regex
import sentencepiece
from pyspark.sql import DataFrame

from papyrine.llm.common import map_columns

CACHED = 300_000
LONGEST = 32


def byte_characters() -> list[str]:
    """A printable character for each byte: Latin-1's own where it is printable and not a blank, else from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token to rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}


def model_proto(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The serialised model, and for each piece id the rank (-1 for the unknown piece, id 0)."""
    chars = byte_characters()
    order = sorted(ranks.items(), key=lambda x: x[1])
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    out += [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for token, rank in order]
    trainer = _field(3, 2) + _field(4, len(out)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)  # BPE; no sentence marks
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer), [-1, *(rank for _, rank in order)]


class Codec:
    """Encoder and decoder; keeps what it has worked out for pre-tokens, up to ``cached`` of them.

    A worker keeps its codec from task to task: about 30 MB for the vocabulary and up to 100 MB for the pre-tokens.

    In ``pattern``, white space is spelled out as the Unicode property, which is what \\s means to the tiktoken library.
    """

    def __init__(self, lines: bytes, pattern: str, cached: int = CACHED) -> None:
        self.ranks = read_ranks(lines)
        proto, self.rank_of = model_proto(self.ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.chars = byte_characters()
        self.token_of = {rank: token for token, rank in self.ranks.items()}  # the ranks' own objects
        spelled = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(spelled).findall
        self.cached, self.known = cached, {}

    def pieces(self, words: list[str]) -> list[list[int]]:
        """Ranks for each pre-token."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        found = [[self.ranks[r]] if r in self.ranks else None for r in raw]
        rest = [k for k, f in enumerate(found) if f is None]
        if rest:
            for k, ids in zip(rest, self.model.encode(["".join(map(self.chars.__getitem__, raw[k])) for k in rest], num_threads=1)):
                found[k] = [self.rank_of[i] for i in ids]
        return found

    def learn(self, words: set[str]) -> None:
        """Works out those of the distinct ``words`` that are not known yet: ids joined by commas, decoded bytes."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.cached:
            known.clear()
            new = list(words)
        for w, ids in zip(new, self.pieces(new)):
            known[w] = ",".join(map(str, ids)), self.decode(ids)

    def forget(self, words: set[str]) -> None:
        """Long pre-tokens, which hardly come again."""
        for w in [w for w in words if len(w) > LONGEST]:
            del self.known[w]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.pieces(self.split(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, sha256 of the ids, sha256 of the decoded bytes, for each text."""
        out = []
        split = [self.split(t) for t in texts]
        words = set().union(*split)
        self.learn(words)
        known = self.known
        for each in split:
            got = [known[w] for w in each]
            ids = ",".join([x for x, _ in got])
            out.append((ids.count(",") + 1 if each else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([x for _, x in got])).hexdigest()))
        self.forget(words)
        return out


@lru_cache(2)
def codec(lines: bytes, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(lines, pattern)


def encode(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """doc_id and ids array<int> for every row of docs(doc_id, text)."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(vocabulary, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": [c.encode(t or "") for t in b["text"]]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """doc_id and text for every row of encoded(doc_id, ids); bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(vocabulary, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "text": [c.decode(x or []).decode("utf-8", "replace") for x in b["ids"]]}

    return map_columns(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encode_digests(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row: encoding and decoding in one pass over the texts."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        c = codec(vocabulary, pattern)
        for b in batches:
            rows = c.digests([t or "" for t in b["text"]])
            yield {"doc_id": b["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
