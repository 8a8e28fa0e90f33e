"""Near duplicates by an exact n-gram Jaccard join with prefix trees.

Sets are a document's distinct WORDS-word shingles as 64-bit hashes. Documents with equal sets form a class and are
handled once. Shingles have one global order: by the count in their bucket of a count table of fixed size (rare ones
first, counts by their logarithm), then by hash. Two sets with Jaccard similarity of at least 4/5 share a shingle among
the first fifth of each, and the first one they share stands so early in both that what comes after it can still make a
link. Classes that share a shingle so form a candidate group around one of them, the hub. How many of its first
shingles a class shares with any other is counted too (in arrays by class, a number for each of them at most): a link
between sets of n and m needs 4/9 (n + m) - 4/5 max(n, m) + 1, so classes that share a few by chance go before any text
is moved.

The texts of the other classes travel once to each task that has a group of theirs. In each group the sets stand in a
path-compressed trie in global order; a probe walks it once, partial overlaps are shared by all sets below a node,
subtrees are pruned where even the remaining lengths can't make a link, and where all sets below are already connected
with the probe. Large groups are split into blocks; a second round joins the blocks of those groups in which more than
one component is left. Links are contracted to components by rounds of hooking each vertex to its least neighbour, on
written tables.

Nothing unbounded meets in one task: prefix shingles travel as arrays by bucket, those that occur more than ``hot``
times are grouped by an aggregation and a join that Spark can split, groups by blocks of BLOCK sets and MOST shingles.

Defined cases: null text, or text without words, has an empty set and is linked with nothing; fewer than WORDS words
make one shingle; repeated rows are copies of each other; rows that repeat a doc_id with another text are documents of
their own with that id; a null doc_id stands for no number: its row gets the smallest doc_id of its component, null if
there is none; very long texts are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from papyrine.llm.common import BLOCK_ROWS, CACHES, bitmap, bits_for, block_rows, bounded, dropped, map_columns, marked_at, merged_blocks, tidy, written

WORDS = 5
TABLE_BITS, TABLE_BLOCK = 20, 1 << 12
BLOCK, MOST = 512, 1_000_000
HOT = 2_000_000
KNOWN, SEEN = 150_000, 100_000
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h


_words = _Hashes()
CACHES.append(_words.clear)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The set, as sorted hashes. Bytes are lower-cased A-Z and split at the six ASCII blanks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += h[k : k + n] * MULT[k]
        total = (total << np.uint64(17)) | (total >> np.uint64(47))
    return np.unique(_mix(total))


def identity(s: np.ndarray) -> int:
    """The class of a set, as a signed number."""
    return xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_overlap(n: int, m: int) -> int:
    """The smallest o with 100 * o >= 80 * (n + m - o)."""
    return -(-4 * (n + m) // 9)


def least_shared(n: Column, m: Column) -> Column:
    """How many of their first fifths' shingles sets of n and m share at least, if they link.

    Of the o shared shingles, o - (n - p) are among the first p of n; p is n - ceil(4/5 n) + 1.
    """
    up = lambda x, y: -F.floor(-x / F.lit(y))
    return up(4 * (n + m), 9) + 1 - up(4 * F.greatest(n, m), 5)


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """In global order."""
    return s[np.argsort(levels[s >> np.uint64(64 - TABLE_BITS)], kind="stable")]


class Trie:
    """A path-compressed trie over sets of ranks in lexicographic order; node arrays by number.

    ``lo`` and ``hi`` bound the sets below a node, ``depth`` counts the ranks above and in its segment.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        n = len(self.sets)
        shared = [0] * n  # ranks shared with the set before
        for i in range(1, n):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[i] = int(differ[0]) if len(differ) else m
        self.nodes: list[tuple[int, int, int, int, list[int]]] = []  # lo, hi, depth above, depth below, children
        self.root = self._grow(0, n, 0, shared)

    def _grow(self, lo: int, hi: int, above: int, shared: list[int]) -> int:
        """The node over sets lo..hi, which agree up to ``above`` and further."""
        todo, made = [(lo, hi, above, -1)], -1
        while todo:
            lo, hi, above, parent = todo.pop()
            below = min(shared[lo + 1 : hi], default=len(self.sets[lo]))
            number = len(self.nodes)
            self.nodes.append((lo, hi, above, below, []))
            if parent >= 0:
                self.nodes[parent][4].append(number)
            else:
                made = number
            if hi - lo > 1:
                starts = [lo, *(i for i in range(lo + 1, hi) if shared[i] == below), hi]
                todo += [(a, b, below, number) for a, b in zip(starts, starts[1:])]
        return made

    def links(self, x: np.ndarray, universe: int, mine: int, labels: np.ndarray) -> Iterator[int]:
        """Positions (in trie order) of sets that link with x and are labelled otherwise; labels may change meanwhile."""
        has = np.zeros(universe + 1, bool)
        has[x] = True
        left = len(x) - np.cumsum(has)  # ranks of x after each rank
        n = len(x)
        todo = [(self.root, 0)]
        while todo:
            number, overlap = todo.pop()
            lo, hi, above, below, children = self.nodes[number]
            if (labels[lo:hi] == labels[mine]).all():
                continue
            segment = self.sets[lo][above:below]
            overlap += int(has[segment].sum())
            sizes = self.sizes[lo:hi]
            rest = min(int(left[segment[-1]]) if len(segment) else n - overlap, int(sizes.max()) - below)
            if 9 * (overlap + rest) < 4 * (n + int(sizes.min())):
                continue
            if children:
                todo += [(c, overlap) for c in children]
            else:
                for i in range(lo, hi):  # equal sets end in one leaf
                    if labels[i] != labels[mine] and overlap >= least_overlap(n, len(self.sets[i])):
                        yield i


def connect(raw: list[np.ndarray], labels: list[int], probes: list[bool], levels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions in ``raw`` (a group's sets) that link, enough to connect all that links connect; between a
    probe and any set. ``labels`` say what is connected already."""
    every = np.unique(np.concatenate(raw))
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(levels[every >> np.uint64(64 - TABLE_BITS)], kind="stable")] = np.arange(len(every))
    coded = [np.sort(rank[np.searchsorted(every, s)]) for s in raw]
    trie = Trie(coded)
    place = {i: k for k, i in enumerate(trie.order)}
    now = np.array([labels[i] for i in trie.order])
    out = []
    for i, probe in enumerate(probes):
        if not probe:
            continue
        k = place[i]
        if (now == now[k]).all():
            continue
        for other in trie.links(coded[i], len(every), k, now):
            out.append((i, trie.order[other]))
            now[now == now[other]] = now[k]
    return out


def profile(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, h, n_shingles, class) as a written table, h a hash of the text, and the count table of the distinct
    shingles of every document, from one pass over the texts."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        total, held, n = np.zeros(1 << TABLE_BITS, np.int32), [], 0
        none = {"doc_id": [], "h": [], "n_shingles": [], "class": []}
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            for s in sets:
                held.append((s >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
                n += len(s)
            if n > 1 << 19:
                total += np.bincount(np.concatenate(held), minlength=1 << TABLE_BITS).astype(np.int32)
                held, n = [], 0
            nulls = [None] * len(sets)
            yield {"doc_id": b["doc_id"], "h": b["h"], "n_shingles": [len(s) for s in sets], "class": [identity(s) if len(s) else None for s in sets], "k": nulls, "near": nulls, "part": nulls}
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << TABLE_BITS).astype(np.int32)
        blocks = block_rows(total, TABLE_BLOCK)
        yield {**{c: [None] * len(blocks["k"]) for c in none}, **blocks}

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    both = written(map_columns(read, rows, f"doc_id long, h long, n_shingles long, class long, {BLOCK_ROWS}"), "sets")
    counts = merged_blocks(both.filter("k is not null").select("k", "near", F.col("part")).transform(_wide), 1 << TABLE_BITS, np.int64, TABLE_BLOCK)
    return both.filter("k is null").select("doc_id", "h", "n_shingles", "class"), counts


def _wide(rows: DataFrame) -> DataFrame:
    """Blocks of 32-bit counts as 64-bit ones, which sums of many tasks need."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {**b, "part": [np.frombuffer(p, np.int32).astype(np.int64).tobytes() for p in b["part"]]}

    return map_columns(rows, run, BLOCK_ROWS)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The counts' logarithms in 255 steps, one byte each: what the order needs, and all that tasks get of the table."""
    return np.minimum(255, np.round(6 * np.log2(1 + counts.astype(np.float64)))).astype(np.uint8)


def _prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    n = len(s)
    return ordered(s, levels)[: n - (4 * n + 4) // 5 + 1]


# What travels of a first shingle: 48 bits of it, its class, the set's size, and its place in steps of a fifth of the size.
RECORD = np.dtype([("token", "<u2", 3), ("class", "<i8"), ("n", "<u4"), ("step", "<u2")])
STEPS = 60_000


def _prefixes(levels: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[Callable, Callable]:
    """(cool, hot) map functions over texts: arrays of RECORD by bucket; rows of shingles in hot places of the table."""

    def each(batches: Iterator[dict]) -> Iterator[tuple[np.ndarray, int, int]]:
        seen: set[int] = set()
        for b in batches:
            for t in b["text"]:
                s = shingles(t)
                if len(s):
                    c = identity(s)
                    if c not in seen:  # copies within a task; others go where their bucket meets
                        if len(seen) < SEEN:
                            seen.add(c)
                        yield _prefix(s, levels), c, len(s)

    def records(first: np.ndarray, c: int, n: int) -> np.ndarray:
        out = np.empty(len(first), RECORD)
        out["token"] = first.view("<u2").reshape(-1, 4)[:, 1:]
        out["class"], out["n"] = c, min(n, (1 << 32) - 1)
        out["step"] = np.minimum(65535, np.arange(len(first)) * (5 * STEPS) // n)
        return out

    def parts(tokens: np.ndarray, rows: np.ndarray) -> dict:
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        return {"bucket": bucket[cuts].tolist(), "part": [rows[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(bucket)))]}

    def cool_rows(batches: Iterator[dict]) -> Iterator[dict]:
        tokens, rows, size = [], [], 0
        for first, c, n in each(batches):
            cool = ~hot[first >> np.uint64(64 - TABLE_BITS)]
            tokens.append(first[cool])
            rows.append(records(first, c, n)[cool])
            size += len(tokens[-1])
            if size > 1_000_000:
                yield parts(np.concatenate(tokens), np.concatenate(rows))
                tokens, rows, size = [], [], 0
        if size:
            yield parts(np.concatenate(tokens), np.concatenate(rows))

    def hot_rows(batches: Iterator[dict]) -> Iterator[dict]:
        for first, c, n in each(batches):
            t = first[hot[first >> np.uint64(64 - TABLE_BITS)]].astype(np.int64)
            yield {"token": t.tolist(), "class": [c] * len(t), "n": [n] * len(t)}

    return cool_rows, hot_rows


def _summed(classes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct classes, in order, and the sums of their numbers."""
    if not len(classes):
        return classes, numbers
    order = np.argsort(classes, kind="stable")
    classes, numbers = classes[order], numbers[order]
    new = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
    return classes[new], np.add.reduceat(numbers, new)


def _viable(n: np.ndarray, step: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a run's set may have this shingle as the first that it shares with another one it links with.

    With a = n - place shingles from this one on, sets link only if 4 (n + m) <= 9 a for both. Asked for of the
    smallest other set and of the other set that allows the largest; runs are sorted by size.
    """
    most = 9 * (n - step.astype(np.int64) * n // (5 * STEPS)) // 4 - n  # the largest partner's size
    run = np.repeat(np.arange(len(starts)), size)
    head = np.zeros(len(n), bool)
    head[starts] = True
    least_other = np.where(head, n[np.minimum(np.repeat(starts, size) + 1, len(n) - 1)], n[np.repeat(starts, size)])
    top = np.maximum.reduceat(most, starts)
    at = np.flatnonzero(most == top[run])
    at = at[np.append(True, run[at][1:] != run[at][:-1])]  # one place of the largest in each run
    rest = most.copy()
    rest[at] = -1
    most_other = top[run]
    most_other[at] = np.maximum.reduceat(rest, starts)[run[at]]
    return (np.repeat(size, size) > 1) & (least_other <= most) & (n <= most_other)


def _runs(slots: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Of one bucket's first shingles: rows (hub, class, n) for every run of at least two classes that share one, have
    sizes near enough and are viable; and for each of ``slots`` slots of classes how many shingles they share."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        every = np.concatenate([np.frombuffer(x.as_buffer(), RECORD) for x in rows.column("part")])
        wide = np.zeros((len(every), 4), "<u2")
        wide[:, 1:] = every["token"]
        t = wide.view("<u8").ravel()
        order = np.argsort(t, kind="stable")
        t = t[order]
        same = t[1:] == t[:-1]
        shared = np.append(same, False) | np.append(False, same)
        every, t = every[order[shared]], t[shared]
        hub = cls = size = np.zeros(0, np.int64)
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        if len(t):
            order = np.lexsort((every["class"], every["n"], t))
            every, t = every[order], t[order]
            first = np.append(True, (t[1:] != t[:-1]) | (every["class"][1:] != every["class"][:-1]))
            every, t = every[first], t[first]
            n = every["n"].astype(np.int64)
            starts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (5 * n[:-1] < 4 * n[1:])))
            lengths = np.diff(np.append(starts, len(t)))
            counts.append(_summed(every["class"][np.repeat(lengths, lengths) > 1], np.ones(int(lengths[lengths > 1].sum()), np.int64)))
            good = _viable(n, every["step"], starts, lengths)
            run_of = np.repeat(np.arange(len(starts)), lengths)[good]
            cls, size = every["class"][good], n[good]
            if len(cls):
                begins = np.flatnonzero(np.append(True, run_of[1:] != run_of[:-1]))
                many = np.diff(np.append(begins, len(cls)))
                hub = np.repeat(np.minimum.reduceat(cls, begins), many)
                pairs = np.unique(np.stack([hub, cls, size], 1)[np.repeat(many > 1, many)], axis=0)
                hub, cls, size = pairs.T
        known, numbers = counts[0] if counts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        slot = (known.astype(np.uint64) >> np.uint64(32)).astype(np.int64) % slots
        used = np.unique(slot)
        nulls, more = [None] * len(used), [None] * len(cls)
        return pa.table({
            "hub": pa.array([*hub.tolist(), *nulls], pa.int64()), "class": pa.array([*cls.tolist(), *nulls], pa.int64()), "n": pa.array([*size.tolist(), *nulls], pa.int64()),
            "slot": pa.array([*more, *used.tolist()], pa.int64()), "part": pa.array([*more, *(np.stack([known[slot == k], numbers[slot == k]]).tobytes() for k in used)], pa.binary()),
        })

    return run


def _totals(key: tuple, rows: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for x in rows.column("part")]
    classes, numbers = _summed(*(np.concatenate([p[k] for p in parts]) for k in range(2)))
    return pa.table({"class": pa.array(classes, pa.int64()), "shared": pa.array(numbers, pa.int64())})


def candidate_groups(docs: DataFrame, counts: np.ndarray, hot: int | None = None, per_bucket: int = 300_000, each: int = 16) -> DataFrame:
    """(hub, class, n): every two classes that link are together in some hub's group.

    ``hot`` bounds how often a shingle that stays in a bucket can occur; a place of the count table also holds others,
    so places count as hot from ``hot`` above what chance brings them. Each shuffle partition gets ``each`` buckets or
    more, which evens out what tasks read.
    """
    total, mean = int(counts.sum()), float(counts.mean())
    often = counts > (hot if hot is not None else HOT + mean + 6 * mean**0.5)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cool, hot_rows = _prefixes(levels_of(counts), often, max(each * parts, total // 5 // per_bucket + 1))
    bucketed = map_columns(docs.select("text"), cool, "bucket long, part binary").groupBy("bucket").applyInArrow(_runs(max(parts, total // 100_000_000 + 1)), "hub long, class long, n long, slot long, part binary")
    runs = written(bucketed, "runs")
    shared = runs.filter("slot is not null").select("slot", "part").groupBy("slot").applyInArrow(_totals, "class long, shared long")
    pairs = runs.filter("slot is null").select("hub", "class", "n")
    if often.any():
        rows = map_columns(docs.select("text"), hot_rows, "token long, class long, n long")
        hubs = rows.groupBy("token").agg(F.min("class").alias("hub"), F.max("class").alias("top")).filter("hub != top").select("token", "hub")
        pairs = pairs.unionByName(rows.join(hubs, "token").select("hub", "class", "n"))
        shared = shared.unionByName(rows.groupBy("class").agg(F.count(F.lit(1)).alias("shared"))).groupBy("class").agg(F.sum("shared").alias("shared"))
    groups = written(pairs.distinct(), "groups")
    return _pruned(groups, written(shared, "shared"))


def _pruned(groups: DataFrame, shared: DataFrame, rounds: int = 2) -> DataFrame:
    """Without classes that share fewer first shingles than a link with the farthest size in their groups needs; that
    leaves other groups with one class, so it is done again. What is known of hubs is written, so that joins are of two
    tables, and Spark splits a very large group."""
    for _ in range(rounds):
        span = written(groups.groupBy("hub").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members"), "spans")
        near = lambda m: least_shared(F.col("n"), m)
        need = groups.join(span, "hub").groupBy("class").agg(F.min(F.least(near(F.col("lo")), near(F.col("hi")))).alias("need"))
        keep = need.join(shared, "class").filter("shared >= need").select("class")
        groups = written(groups.join(keep, "class", "left_semi"), "groups")
    together = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("hub")
    return groups.join(written(together, "hubs"), "hub", "left_semi")


def _links(docs: DataFrame, members: DataFrame, reps: DataFrame, levels: np.ndarray, per_task: int = 1_500_000) -> DataFrame:
    """(a, b) links of members(hub, block, class, n, label, probe); reps(class, h) names a text of each class.

    A task gets its groups' rows and each of their classes' texts once; of copies of a text one a map task travels.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(members.agg(F.sum("n")).first()[0] or 0) // per_task + 1)
    placed = members.withColumn("task", F.pmod(F.xxhash64("hub", "block"), F.lit(tasks)).cast("int"))
    wanted = written(placed.select("class", "task").distinct().join(reps, "class"), "wanted")
    full = _texts(docs, wanted.select("h").distinct()).join(wanted, "h").select("task", "class", "z")
    bounded(spark)

    def run(key: tuple, groups: pa.Table, texts: pa.Table) -> pa.Table:
        groups = groups.sort_by([("hub", "ascending"), ("block", "ascending"), ("class", "ascending")])
        z = dict(zip(texts.column("class").to_pylist(), texts.column("z").to_pylist()))
        hub, block, classes, labels, probes = (groups.column(c).to_pylist() for c in ("hub", "block", "class", "label", "probe"))
        a, b, lo = [], [], 0
        for hi in range(1, len(hub) + 1):
            if hi == len(hub) or (hub[hi], block[hi]) != (hub[lo], block[lo]):
                raw = [shingles(zlib.decompress(z[c]).decode("utf-8", "surrogatepass")) for c in classes[lo:hi]]
                for x, y in connect(raw, labels[lo:hi], probes[lo:hi], levels):
                    a.append(classes[lo + x])
                    b.append(classes[lo + y])
                lo = hi
        tidy()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return written(placed.groupBy("task").cogroup(full.groupBy("task")).applyInArrow(run, "a long, b long"), "links")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, z): compressed texts, each once, of the wanted hashes, and a few more: a bitmap selects them."""
    bits = bits_for(wanted.count())
    at = lambda h: F.shiftrightunsigned(h, 64 - bits)
    on = bitmap(wanted.select(at(F.col("h")).alias("place")), bits)

    def pick(batches: Iterator[dict]) -> Iterator[dict]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for h, t, k in zip(b["h"], b["text"], marked_at(on, np.array(b["place"], np.int64))):
                if k and t and h not in seen:
                    if len(seen) < SEEN:
                        seen.add(h)
                    rows.append((h, zlib.compress(t.encode("utf-8", "surrogatepass"), 3)))
            yield {"h": [r[0] for r in rows], "z": [r[1] for r in rows]}

    h = F.xxhash64("text")
    return map_columns(docs.select(h.alias("h"), at(h).alias("place"), "text"), pick, "h long, z binary").dropDuplicates(["h"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) for the vertices of edges(a, b): the least vertex of each one's component.

    Each round hooks every vertex to its least neighbour (if smaller), follows the hooks to their ends, and contracts
    the edges; at least half of the vertices of each component go in a round, so ``max_rounds`` are enough for 2**60.
    """
    edges = written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        hooks = edges.select(F.col("b").alias("v"), F.col("a").alias("to")).groupBy("v").agg(F.min("to").alias("root"))
        hooks = written(hooks, "hooks")
        while True:  # jumps double the way, and trees are as deep as chains of hooks
            up = hooks.select(F.col("v").alias("root"), F.col("root").alias("up"))
            jumped = written(hooks.join(up, "root", "left").select("v", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "hooks")
            dropped(hooks)
            hooks = jumped.select("v", "root")
            if jumped.filter("moved").isEmpty():
                break
        maps.append(hooks)
        a, b = hooks.select(F.col("v").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x != y")
        old, edges = edges, written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        dropped(old)
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    if not maps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = maps[-1]
    for m in reversed(maps[:-1]):  # later rounds moved the roots of earlier ones
        later = out.select(F.col("v").alias("root"), F.col("root").alias("top"))
        out = m.join(later, "root", "left").select("v", F.coalesce("top", "root").alias("root")).unionByName(out)
    return out


def near_duplicates(docs: DataFrame, hot: int | None = None, block: int = BLOCK, keep: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text); with ``keep`` also h, the xxhash64 of the
    text, and root, a number of the component (null without words)."""
    sets, counts = profile(docs)
    levels = levels_of(counts)
    groups = written(candidate_groups(docs, counts, hot), "groups")
    sized = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all"))
    sized = sized.select("hub", F.greatest(F.ceil(F.col("members") / F.lit(block)), F.ceil(F.col("all") / F.lit(MOST))).cast("int").alias("blocks"))
    members = groups.join(written(sized, "sizes"), "hub").select("hub", "class", "n", "blocks", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
    members = written(members, "members")
    reps = written(sets.filter("class is not null").groupBy("class").agg(F.min("h").alias("h"), F.min("doc_id").alias("rep")), "reps")
    named = reps.select("class", "h")
    first = members.withColumn("block", F.explode(F.when(F.col("class") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    first = first.select("hub", "block", "class", "n", F.col("class").alias("label"), F.lit(True).alias("probe"))
    links = _links(docs, first, named, levels)
    roots = components(links)
    if not members.filter("blocks > 1").isEmpty():
        more = _between_blocks(members, roots, block)
        if more is not None:
            roots = components(links.unionByName(_links(docs, more, named, levels)))
    roots = written(roots, "roots")
    vertices = roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
    least = vertices.join(reps.select(F.col("class").alias("v"), "rep"), "v").groupBy("root").agg(F.min("rep").alias("least"))
    label = vertices.join(least, "root").select(F.col("v").alias("class"), "root", "least")
    label = reps.select("class", "rep").join(label, "class", "left").select(F.col("class").alias("class_"), F.coalesce("root", "class").alias("root"), F.coalesce("least", "rep").alias("component"))
    label = written(label, "labels")  # a table, so that Spark can split a class with very many copies
    return sets.join(label, F.col("class") == F.col("class_"), "left").select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), *(("h", "root") if keep else ()))


def _between_blocks(members: DataFrame, roots: DataFrame, block: int) -> DataFrame | None:
    """What is left to compare: of those groups whose blocks hold more than one component; None if there are no such groups.

    All outside a group's largest component are probes, in blocks of their own, against every block of the group.
    """
    spread = members.filter("blocks > 1").join(roots, F.col("class") == F.col("v"), "left").select("hub", "class", "n", "block", "blocks", F.coalesce("root", "class").alias("label"))
    spread = written(spread, "spread")
    per = spread.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("hub").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")).filter("all > m.n").select("hub", F.col("m.label").alias("main"), (F.col("all") - F.col("m.n")).alias("fringe"))
    main = written(main, "fringe")
    if main.isEmpty():
        return None
    both = spread.join(main.withColumn("sides", F.ceil(F.col("fringe") / F.lit(block)).cast("int")), "hub")
    side = F.pmod(F.xxhash64("class", F.lit(2)), F.col("sides")).cast("int")
    key = (F.col("i") * F.col("blocks") + F.col("j")).cast("int").alias("block")
    probes = both.filter("label != main").withColumn("i", side).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("hub", key, "class", "n", "label", F.lit(True).alias("probe"))
    others = both.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).select("hub", key, "class", "n", "label", F.lit(False).alias("probe"))
    return written(probes.unionByName(others).groupBy("hub", "block", "class", "n", "label").agg(F.max("probe").alias("probe")), "sides")
