"""Approximate nearest neighbours with vantage-point trees over shards.

The top of the trees is learned from a bounded sample: vantage points and median distances lead each vector to a cell,
and each cell gets bounds on the distances of all its vectors to the vantage points on its way. Cells are dealt to
shards of a bounded size, each with a vantage-point tree of its own: a node keeps one vector, the median distance to it,
and splits the rest into inside and outside. Blocks of queries walk a tree together; a subtree is pruned when its least
possible distance, times ``factor``, exceeds the k-th distance found so far. Queries are asked in their own cell first,
then, with the k-th distance found there, in those other cells that the same rule does not prune. With factor 1 the
triangle inequality makes that exact; larger factors prune more. How much is pruned depends on the data: vectors that lie
about equally far from each other leave all cells to be asked, in tasks of bounded size.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate;
a query's own row (same id) is no candidate; equal distances go to the smaller id; with fewer candidates than k all are
returned; repeated query ids are asked once (repeated candidates count each); an empty table gives an empty result;
vectors of another dimension than a query's are no candidates of it; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.common import bounded, map_columns, tidy, written

SHARD, BLOCK, LEAF = 8192, 16384, 128
SAMPLE, CELLS, SLACK = 20_000, 1024, 1e-9


class Tree:
    """Arrays in tree order; nodes as (vantage, median, inside, outside) or leaf slices."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.argsort(ids, kind="stable")
        self.v, self.ids, self.leaf = vectors[order], ids[order], leaf
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= self.leaf:
            return (rows,)
        at, rest = rows[len(rows) // 2], np.delete(rows, len(rows) // 2)
        d = np.sqrt(((self.v[rest] - self.v[at]) ** 2).sum(1))
        middle = np.median(d)
        inside = d <= middle
        if inside.all():  # all equally far: halves by position, both with the same bounds
            inside = np.arange(len(rest)) < len(rest) // 2
        near, far = d[inside], d[~inside]
        return at, (near.min(), near.max(), self._build(rest[inside])), (far.min(), far.max(), self._build(rest[~inside]))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, reach: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) below ``reach``, rows by query, nearest first, padded with it and -1."""
        self.q, self.own, self.k, self.factor = queries, own, k, factor
        self.best, self.who = np.tile(np.broadcast_to(reach, len(queries))[:, None], k).astype(float), np.full((len(queries), k), -1, np.int64)
        if len(queries) and len(self.ids):
            self._visit(self.root, np.arange(len(queries)))
        return self.best, self.who

    def _meet(self, ask: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        d = np.where(self.ids[rows][None, :] == self.own[ask][:, None], np.inf, d)
        all_d, all_i = np.hstack([self.best[ask], d]), np.hstack([self.who[ask], np.broadcast_to(self.ids[rows], d.shape)])
        pick = np.lexsort((all_i, all_d), axis=1)[:, : self.k]
        self.best[ask], self.who[ask] = np.take_along_axis(all_d, pick, 1), np.take_along_axis(all_i, pick, 1)

    def _distances(self, ask: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(ask), len(rows)))
        for a in range(0, len(ask), 64):
            out[a : a + 64] = np.sqrt(((self.q[ask[a : a + 64], None, :] - self.v[rows][None]) ** 2).sum(2))
        return out

    def _visit(self, node: tuple, ask: np.ndarray) -> None:
        if len(node) == 1:
            self._meet(ask, node[0], self._distances(ask, node[0]))
            return
        at, *children = node
        d = self._distances(ask, np.array([at]))
        self._meet(ask, np.array([at]), d)
        d = d[:, 0]
        bounds = [np.maximum(0, np.maximum(low - d, d - high)) for low, high, _ in children]
        first = bounds[1] < bounds[0]  # True: outside first
        for turn in (0, 1):
            for c in (0, 1):
                mine = np.flatnonzero((first == bool(c)) if turn == 0 else (first != bool(c)))
                mine = mine[bounds[c][mine] * self.factor <= self.best[ask[mine], -1]]
                if len(mine):
                    self._visit(children[c][2], ask[mine])


class Router:
    """The top of the trees: vantage points and medians learned from a sample, down to cells, for vectors of one dimension.

    A cell is known by bounds on the distances to the vantage points on its way; they come from all vectors in it.
    """

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.points: list[np.ndarray] = []
        self.medians: list[float] = []
        self.kids: list[list[int]] = []  # of each point, inside and outside: a point, or -1 - cell
        self.ways: list[list[int]] = []  # of each cell, its points from the top
        self.top = self._split(sample, cells, [])

    def _split(self, rows: np.ndarray, cells: int, way: list[int]) -> int:
        d = np.zeros(0)
        if cells > 1 and len(rows) > 2:
            at = rows[len(rows) // 2]
            d = _apart(rows, at)
        if not len(d) or d.min() == d.max():
            self.ways.append(way)
            return -len(self.ways)
        me = len(self.points)
        self.points.append(at)
        self.medians.append(float(np.median(d)) if np.median(d) < d.max() else float(d.min()))
        self.kids.append([])
        inside = d <= self.medians[me]
        self.kids[me] = [self._split(rows[side], half, [*way, me]) for side, half in ((inside, (cells + 1) // 2), (~inside, cells // 2))]
        return me

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """Each row's cell and its distances on the way there."""
        cell, way = np.zeros(len(rows), np.int64), [[] for _ in range(len(rows))]
        todo = [(self.top, np.arange(len(rows)))]
        while todo:
            node, some = todo.pop()
            if node < 0:
                cell[some] = -1 - node
                continue
            d = _apart(rows[some], self.points[node])
            for i, x in zip(some.tolist(), d.tolist()):
                way[i].append(x)
            inside = d <= self.medians[node]
            todo += [(kid, part) for kid, part in zip(self.kids[node], (some[inside], some[~inside])) if len(part)]
        return cell, way

    def least(self, rows: np.ndarray, bounds: dict[int, list[tuple[float, float]]]) -> np.ndarray:
        """Rows by cells: no vector of the cell lies nearer than this."""
        to = np.stack([_apart(rows, p) for p in self.points], 1) if self.points else np.zeros((len(rows), 0))
        out = np.full((len(rows), len(self.ways)), np.inf)
        for cell, spans in bounds.items():
            out[:, cell] = 0
            for point, (lo, hi) in zip(self.ways[cell], spans):
                out[:, cell] = np.maximum(out[:, cell], np.maximum(lo - to[:, point], to[:, point] - hi))
        return out


def _apart(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(1))


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & fine)


def _by_size(vectors: list[list[float]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions, matrix) of lists of numbers."""
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, np.array([vectors[i] for i in at])


def _nearest(vectors: DataFrame, asked: DataFrame, subs: dict[tuple[int, int], int], k: int, factor: float, block: int) -> DataFrame:
    """(query_id, vec_id, score) of asked(id, v, dim, cell, reach) among vectors(id, v, dim, cell): up to k below ``reach``
    from each shard of the cell. A cell's shards and blocks of queries are dealt by hash; each meets in a task of its own."""
    rows = {(r["dim"], r["cell"]): -(-r["count"] // block) for r in asked.groupBy("dim", "cell").count().collect()}
    spark = vectors.sparkSession
    deal = spark.createDataFrame([(d, c, subs.get((d, c), 1), b) for (d, c), b in sorted(rows.items())], "dim int, cell int, subs int, blocks int")
    left = vectors.join(deal, ["dim", "cell"]).select("id", "v", "dim", "cell", F.pmod(F.xxhash64("id", F.lit(3)), F.col("subs")).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = asked.join(deal, ["dim", "cell"]).select("id", "v", "reach", "dim", "cell", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(t.num_rows, -1)

    def run(key: tuple, have: pa.Table, want: pa.Table) -> pa.Table:
        q, i, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if have.num_rows and want.num_rows:
            own = want.column("id").to_numpy()
            d, i = Tree(matrix(have), have.column("id").to_numpy()).search(matrix(want), own, k, factor, want.column("reach").to_numpy())
            there = (i >= 0) & np.isfinite(d)
            q, i, d = np.repeat(own, k).reshape(d.shape)[there], i[there], d[there]
        tidy()
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(d, pa.float64())})

    key = ["dim", "cell", "sub", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard: int = SHARD, block: int = BLOCK, sample: int = SAMPLE, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` (id, v) its k nearest of ``vectors`` (id, v).

    A task holds one shard and one block of queries, both of bounded size, however many rows there are. The driver holds
    ``sample`` vectors and, for each of at most ``cells`` cells, its size and bounds.
    """
    queries = queries.dropDuplicates(["id"])
    bounded(vectors.sparkSession)
    n = vectors.count()
    share = min(1.0, sample / max(1, n))
    some = vectors.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * sample).collect()
    some = [r["v"] for r in sorted(some, key=lambda r: r["id"])]
    routers = {size: Router(rows, min(cells, -(-n // shard))) for size, _, rows in (_by_size(some) if some else ())}

    def routed(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            dim, cell, way = np.zeros(len(b["id"]), np.int64), np.zeros(len(b["id"]), np.int64), [[] for _ in b["id"]]
            for size, at, rows in _by_size(b["v"]):
                dim[at] = size
                if size in routers:
                    cell[at], ways = routers[size].route(rows)
                    for i, w in zip(at, ways):
                        way[i] = w
            yield {"id": b["id"], "v": b["v"], "dim": dim.tolist(), "cell": cell.tolist(), "way": way}

    shape = "id long, v array<double>, dim int, cell int, way array<double>"
    placed = written(map_columns(vectors, routed, shape), "vectors")
    counts = placed.groupBy("dim", "cell").count().collect()
    spans = placed.select("dim", "cell", F.posexplode("way").alias("at", "d")).groupBy("dim", "cell", "at").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
    bounds: dict[int, dict[int, list]] = {}
    for r in counts:
        bounds.setdefault(r["dim"], {})[r["cell"]] = []
    for r in sorted(spans, key=lambda r: r["at"]):
        bounds[r["dim"]][r["cell"]].append((r["lo"] - SLACK, r["hi"] + SLACK))
    subs = {(r["dim"], r["cell"]): -(-r["count"] // shard) for r in counts}
    vectors = placed.select("id", "v", "dim", "cell")

    home = written(map_columns(queries, routed, shape).select("id", "v", "dim", "cell", F.lit(float("inf")).alias("reach")), "queries")
    first = written(_nearest(vectors, home, subs, k, factor, block), "home")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    tenth = first.withColumn("place", place).filter(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("score").alias("far"))

    def others(batches: Iterator[dict]) -> Iterator[dict]:
        """Each query once for every other cell that may hold a nearer vector."""
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("id", "v", "dim", "cell", "reach")}
            reach = np.array([np.inf if x is None else np.nextafter(x, np.inf) for x in b["far"]])
            for size, at, rows in _by_size(b["v"]):
                if size in routers:
                    may = routers[size].least(rows, bounds.get(size, {})) * factor <= reach[at][:, None]
                    may[np.arange(len(at)), np.array(b["cell"])[at]] = False
                    for i, c in zip(*np.nonzero(may)):
                        for name, x in zip(out, (b["id"][at[i]], b["v"][at[i]], size, int(c), float(reach[at[i]]))):
                            out[name].append(x)
            yield out

    more = written(map_columns(home.join(tenth, "id", "left").select("id", "v", "cell", "far"), others, "id long, v array<double>, dim int, cell int, reach double"), "asked")
    found = first.unionByName(_nearest(vectors, more, subs, k, factor, block))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
