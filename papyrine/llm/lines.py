"""Line dedup by content-defined chunks of lines.

Lines are hashed; a rolling hash over the last WINDOW line hashes puts a chunk boundary after a line where it is 0
modulo DIVISOR, so boundaries move with the text, not with positions. A line of LONG words or more is a chunk of its
own. A chunk that occurs more than once in the corpus is repeated, except where it comes first (smallest doc_id, then
position). Neighbouring repeated chunks make a run; runs of several lines and at least LEAST words, or of one line of
LONG words, are removed, after the bytes of their chunks have been compared. So a passage of many short lines goes as
well as one of a few long lines, while a short line that is common by itself stays. Chunks without words have no
bytes to compare: one inside or after a run goes with it.

The first and last chunk of a passage take in lines of its surroundings and then match nowhere. ``dedup_passages`` (the
query and the pipeline) therefore looks at pairs of neighbouring lines with words as well, where one at least has under
LONG words: all lines of repeated chunks and pairs are repeated, and runs of them with several such lines and LEAST
words, or one of LONG, go too. Every pair of lines of a passage is repeated wherever it stands, so a passage of whole
lines over LONG words goes completely. A line's first place in the corpus is in no repeated chunk or pair, so each line
stays somewhere. ``dedup`` looks at chunks alone.

Hashes of all chunks (and pairs), made from those of their lines, find the repeated ones; a bitmap, sized by their number, tells the second pass which
chunks' bytes to send; bytes then meet by value. False hits of the bitmap are harmless, since equal bytes decide. Chunks
that are in no run are compared as well: they may stand first for chunks of runs elsewhere. The places are found by an
aggregation that folds copies before it shuffles; places and first places meet in a join of two tables, whose very
common keys Spark splits.

Defined cases: a document is a (doc_id, text): rows that repeat both are one, rows that repeat a doc_id with another
text are documents of their own, ordered by a hash of the text; a null doc_id comes after all others; null text stays
null and empty text empty; texts of any length are read whole; an empty table stays empty; all columns of the input are
returned, and n_lines and removed_lines after them, with an underscore more where a column has that name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from xxhash import xxh3_64_digest, xxh3_64_intdigest

from papyrine.llm.common import bitmap, bits_for, bounded, fresh, map_columns, marked_at, slices, tidy, written

WINDOW, DIVISOR, LONG, LEAST = 2, 2, 40, 25
MASK = (1 << 64) - 1


class Text:
    """A text's lines, their words (counted up to LONG + 1), and their hashes."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.words = [len(ln.split(None, LONG)) for ln in self.lines]
        self.marks = [xxh3_64_digest(ln.encode("utf-8", "surrogatepass")) for ln in self.lines]

    def chunks(self) -> list[tuple[int, int]]:
        """(first line, line after the last) of the chunks of the whole text, in order."""
        words, hashes = self.words, [int.from_bytes(m, "big") for m in self.marks]
        last, out, begin = len(words) - 1, [], 0
        for i, h in enumerate(hashes):
            before = hashes[i - WINDOW + 1] if i >= WINDOW - 1 else 0
            if i == last or words[i] >= LONG or words[i + 1] >= LONG or (((before * 0x9E3779B97F4A7C15 + h) & MASK) >> 33) % DIVISOR == 0:
                out.append((begin, i + 1))
                begin = i + 1
        return out

    def pairs(self) -> list[tuple[int, int]]:
        """The same of neighbouring lines with words, and the blank lines between; not of two long ones."""
        at = [i for i, n in enumerate(self.words) if n]
        return [(a, b + 1) for a, b in zip(at, at[1:]) if self.words[a] < LONG or self.words[b] < LONG]

    def pieces(self, pairs: bool) -> list[tuple[int, int]]:
        """Lines of the chunks, and then of the pairs; their numbers are their places here."""
        return self.chunks() + (self.pairs() if pairs else [])

    def body(self, a: int, b: int) -> str:
        return "\n".join(self.lines[a:b])

    def mark(self, a: int, b: int) -> int:
        """64 bits, signed; equal for equal bodies."""
        return xxh3_64_intdigest(b"".join(self.marks[a:b])) - (1 << 63)

    def mark_of(self, pairs: bool) -> dict[int, tuple[int, int, int]]:
        """By mark the number and lines of the first such piece with words."""
        out: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(self.pieces(pairs)):
            if b - a > 1 or self.words[a]:
                if any(self.words[a:b]):
                    out.setdefault(self.mark(a, b), (k, a, b))
        return out


def chunks(text: str) -> list[tuple[str, int, int]]:
    """(body, lines, words) of the chunks of the whole text, in order; a line's words count up to LONG + 1."""
    t = Text(text)
    return [(t.body(a, b), b - a, sum(t.words[a:b])) for a, b in t.chunks()]


def in_runs(parts: list[tuple[str, int, int]], repeated: Callable[[int, str], bool]) -> list[bool]:
    """For each chunk whether it is in a run to remove; chunks that stood earlier in the text are repeated too."""
    out, seen, run = [False] * len(parts), set(), []

    def close() -> None:
        lines, words = sum(parts[j][1] for j in run), sum(parts[j][2] for j in run)
        if words >= LONG or (words >= LEAST and lines > 1):
            for j in run:
                out[j] = True
        run.clear()

    for k, (body, _, words) in enumerate(parts):
        if (words == 0 and run) or (words and (body in seen or repeated(k, body))):
            run.append(k)
        else:
            close()
        seen.add(body)
    close()
    return out


def untouched(text: str, gone: frozenset[int]) -> bool:
    """Whether nothing of the text can go: no piece is repeated elsewhere, no line within."""
    if gone:
        return False
    said = [ln for ln in text.split("\n") if ln and not ln.isspace()]
    return len(set(said)) == len(said)


def cut(text: str, gone: frozenset[int]) -> tuple[str, int]:
    """The text without the runs of chunks that are numbered in ``gone`` or repeat earlier ones of the text; lines removed."""
    if untouched(text, gone):
        return text, 0
    parts = chunks(text)
    out = in_runs(parts, lambda k, body: k in gone)
    return "\n".join(p[0] for p, o in zip(parts, out) if not o), sum(p[1] for p, o in zip(parts, out) if o)


def cut_passages(text: str, gone: frozenset[int]) -> tuple[str, int]:
    """As ``cut``, with runs of lines of repeated chunks and pairs; ``gone`` numbers both."""
    if untouched(text, gone):
        return text, 0
    t = Text(text)
    at, two, lines, words = t.chunks(), t.pairs(), t.lines, t.words
    parts = [(t.body(a, b), b - a, sum(words[a:b])) for a, b in at]
    bodies = [p[0] for p in parts] + [t.body(a, b) for a, b in two]
    repeated = {bodies[k] for k in gone if k < len(bodies)}
    marked, out = [False] * len(lines), []
    for (_, n, _), whole in zip(parts, in_runs(parts, lambda k, body: body in repeated)):
        out += [whole] * n
    spans = [(p[0], a, b) for p, (a, b) in zip(parts, at) if p[2]] + [(body, a, b) for body, (a, b) in zip(bodies[len(parts) :], two)]
    seen: dict[str, int] = {}
    for body, a, b in sorted(spans, key=lambda s: s[1]):
        if body in repeated or seen.setdefault(body, a) < a:
            marked[a:b] = [True] * (b - a)
    k = 0
    while k < len(lines):
        end = k
        while end < len(lines) and (marked[end] or (end > k and words[end] == 0)):
            end += 1
        count, several = sum(words[k:end]), sum(w > 0 for w in words[k:end]) > 1
        if count >= LONG or (count >= LEAST and several):
            out[k:end] = [True] * (end - k)
        k = max(end, k + 1)
    return "\n".join(ln for ln, o in zip(lines, out) if not o), sum(out)


def _keyed(docs: DataFrame) -> DataFrame:
    """(d, h, text): the document's key, in order, and its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MASK >> 1)).alias("d"), F.xxhash64("text").alias("h"), "text")


def repeated_chunks(docs: DataFrame, pairs: bool = False) -> DataFrame:
    """(d, h, chunk): the numbers of the chunks (and pairs) of each document that stand first in another one."""

    def hashes(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"c": [c for t in b["text"] if t for c in Text(t).mark_of(pairs)]}

    twice = written(map_columns(docs.select("text"), hashes, "c long").groupBy("c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c"), "line-hashes")
    bits = bits_for(twice.count())
    on = bitmap(twice.select(F.shiftrightunsigned("c", 64 - bits).alias("place")), bits)

    def bodies(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            rows = []
            for d, h, t in zip(b["d"], b["h"], b["text"]):
                if t:
                    whole = Text(t)
                    first = whole.mark_of(pairs)
                    places = np.fromiter(first, np.int64, len(first)).view(np.uint64) >> np.uint64(64 - bits)
                    rows += [(d, h, k, whole.body(x, y)) for (k, x, y), sent in zip(first.values(), marked_at(on, places.astype(np.int64))) if sent]
            yield {"d": [r[0] for r in rows], "h": [r[1] for r in rows], "chunk": [r[2] for r in rows], "body": [r[3] for r in rows]}

    sent = written(map_columns(_keyed(docs), bodies, "d long, h long, chunk int, body string"), "line-bodies")
    first = sent.groupBy("body").agg(F.min(F.struct("d", "h")).alias("first"), F.max(F.struct("d", "h")).alias("last")).filter("first != last").select("body", "first")
    return sent.join(written(first, "line-first"), "body").filter("struct(d, h) != first").select("d", "h", "chunk")


def dedup_passages(docs: DataFrame) -> DataFrame:
    """docs with ``text`` without repeated passages of whole lines, and n_lines, removed_lines."""
    return dedup(docs, pairs=True)


def dedup(docs: DataFrame, pairs: bool = False) -> DataFrame:
    """docs with ``text`` without repeated chunks, and n_lines, removed_lines."""
    without = cut_passages if pairs else cut
    d, h, gone = (fresh(docs.columns, n) for n in ("d", "h", "gone"))
    found = repeated_chunks(docs, pairs).groupBy(F.col("d").alias(d), F.col("h").alias(h)).agg(F.collect_set("chunk").alias(gone))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(MASK >> 1)) == F.col(d)) & (F.xxhash64("text") == F.col(h))
    keyed = docs.join(found, same, "left").select(*columns, gone)
    text = docs.columns.index("text")
    extra = []
    for name in ("n_lines", "removed_lines"):
        extra.append(fresh([*docs.columns, *extra], name))
    schema = StructType([*docs.schema.fields, *[StructField(n, IntegerType()) for n in extra]])
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in slices(batches):
                texts, n, removed = b.column(text).to_pylist(), [], []
                for k, (t, g) in enumerate(zip(texts, b.column(b.num_columns - 1).to_pylist())):
                    n.append(t.count("\n") + 1 if t else 0)
                    removed.append(0)
                    if t:
                        texts[k], removed[-1] = without(t, frozenset(g or ()))
                new = [pa.array(texts, b.column(text).type) if k == text else c for k, c in enumerate(b.columns[:-1])]
                yield pa.RecordBatch.from_arrays([*new, pa.array(n, pa.int32()), pa.array(removed, pa.int32())], [*b.schema.names[:-1], *extra])
        finally:
            tidy()

    return keyed.mapInArrow(run, schema)
