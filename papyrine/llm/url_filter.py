"""URL filters by a Bloom filter cascade (DataFrame functions only).

A list of rules ``host/path`` is looked up for every url. The keys that a url could match are its host's suffixes at
dots joined with prefixes of its path, for the host depths and path lengths that occur in the list. A cascade answers
exactly, without a join, which of them are listed: level 1 holds the listed keys, level 2 those keys of the corpus's
whole key universe that level 1 lets through wrongly, level 3 the listed keys that level 2 lets through, and so on
until a level lets nothing through wrongly. A key is listed iff the first level that refuses it is an even one.

Defined cases: a null url, or one without ``://``, has an empty host and path and matches no rule; an empty list gives
a cascade that refuses everything; repeated rows are judged each; other columns of the table are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import LOWER, UPPER, written


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its words of 64 bits (a power of two of them), the number of hash functions, and the seed that is its own."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def lets(self, key: Column) -> Column:
        """Tried hash by hash until one refuses. The words are one literal: text that Spark reads once, when it plans."""
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        one, two = _pair(key, self.seed)
        on = lambda i: F.getbit(F.get(words, F.shiftright(_place(one, two, i, len(self.words)), 6)), F.pmod(_place(one, two, i, len(self.words)), F.lit(64)).cast("int")) == 1
        return F.forall(F.sequence(F.lit(0), F.lit(self.hashes - 1)), on)


def _pair(key: Column, seed: int) -> tuple[Column, Column]:
    """Two hashes of a key below 2**40; the second is odd, so that its multiples meet every place."""
    one, two = (F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * seed + i)), 24) for i in range(2))
    return one, two.bitwiseOR(F.lit(1))


def _place(one: Column, two: Column, i: Column, words: int) -> Column:
    """The i-th place: h1 + i * h2 + i * i."""
    return F.pmod(one + i * two + i * i, F.lit(64 * words)).cast("int")


def encode(keys: DataFrame, n: int, seed: int, false_rate: float) -> Level:
    """The level that holds all of the n ``keys`` (column key). Only its words reach the driver: at least 16, and for
    each key twice the bits of the usual formula at most."""
    bits = max(1024, 1 << math.ceil(math.log2(n * -math.log(false_rate) / math.log(2) ** 2)))
    hashes = max(1, math.ceil(-math.log2(false_rate)))
    one, two = _pair(F.col("key"), seed)
    set_bits = (
        keys.select(one.alias("one"), two.alias("two")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: _place(F.col("one"), F.col("two"), i, bits // 64))).alias("place"))
        .select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(place, 64) as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    words = [0] * (bits // 64)
    for r in set_bits.collect():
        words[r["word"]] = r["bits"]
    return Level(tuple(words), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)  # passed by every level: decided by what the last one holds
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[k].lets(key), F.lit(k % 2 == 1)).otherwise(answer)
        return answer


def cascade(listed: DataFrame, universe: DataFrame, false_rate: float = 0.01, max_levels: int = 64) -> Cascade:
    """Levels for ``listed`` over ``universe`` (both with a column key, distinct rows; tables, as they are read for each level).

    The levels alternate between listed keys and false positives, each set filtered by the level before; it ends
    when a set is empty, so the answer is exact for every key of the universe. The first level's rate is such that it
    lets through about as many other keys as are listed, however large the universe is: all levels together grow with
    the list, and with the universe by a logarithm.
    """
    inside, outside = listed.select("key").distinct(), universe.select("key").join(listed.select("key"), "key", "left_anti")
    sizes = [inside.count(), outside.count()]
    levels: list[Level] = []
    keys, other = inside, outside
    while len(levels) < max_levels:
        n = sizes[0] if not levels else keys.count()
        if not n:
            return Cascade(tuple(levels))
        rate = min(false_rate, max(1, sizes[0]) / max(1, sizes[1])) if not levels else false_rate
        level = encode(keys, n, len(levels), rate)
        levels.append(level)
        keys, other = other.filter(level.lets(F.col("key"))), keys
    raise RuntimeError(f"no exact cascade within {max_levels} levels")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) by the first ://; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*(/[^?#]*)", 1)
    return host, path


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Keys that could be listed: host suffixes of the rules' depths, each with path prefixes of the rules' lengths."""
    depths, lengths = sorted({r.host.count(".") + 1 for r in rules}), sorted({len(r.path) for r in rules})
    none = F.lit(None).cast("string")
    keys = []
    for d in depths:
        suffix = F.substring_index(host, ".", -d)
        whole = F.size(F.split(host, r"\.", -1)) >= d
        for n in lengths:
            keys.append(F.when(whole & (F.length(path) >= n), F.concat(suffix, F.substring(path, 1, n))).otherwise(none))
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def _hits(c: Cascade, verdict: str) -> Column:
    return F.transform(F.filter("keys", lambda k: c.holds(k)), lambda k: F.struct(F.length(k).alias("len"), k.alias("key"), F.lit(verdict).alias("verdict")))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", false_rate: float = 0.01) -> DataFrame:
    """page_id, host, path, rule, verdict and n_levels for every row of pages(page_id, url).

    ``rules`` is a list on the driver, and so are the levels, which grow with it. The longest listed key wins, of equal
    ones the verdict last by name; a url without one gets ``default``, since the cascade has refused all its keys. The
    universe of keys is worked out once and written.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = written(keyed.select(F.explode("keys").alias("key")).distinct(), "keys")
    best = F.lit(None).cast("struct<len:int,key:string,verdict:string>")
    depth, found = 0, []
    for verdict in sorted({r.verdict for r in rules}):
        listed = spark.createDataFrame(sorted({(r.key,) for r in rules if r.verdict == verdict}), "key string")
        c = cascade(listed, universe, false_rate)
        depth = max(depth, len(c.levels))
        found.append(_hits(c, verdict))
    if found:
        best = F.array_max(F.concat(*found))
    return keyed.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.lit(depth).alias("n_levels")
    )
