"""Exact top-k inner products by best-first search in M-trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import materialise

#: Entries of a page; vectors of a tree and queries of a task, about; and the multiple that makes a row a query.
PAGE, BLOCK, QUERY_EVERY = 512, 8192, 20
#: At most so many vectors are pivots by which all vectors are dealt into trees, chosen far from one another among so many
#: times their number, those of the least hash. Which they are decides how much is pruned, never what is found.
PIVOTS, AMONG = 1024, 4
#: Products of components up to this one are exact in doubles; larger ones are taken in whole numbers.
LARGEST = 1 << 22
#: What rounding may add to a distance, as a share of the lengths involved.
SLACK = 1e-6
_LONGEST = (1 << 63) - 1


class MTree:
    """Paged metric tree over integer vectors, searched for the largest inner products.

    With M the largest norm, each vector gets one more component sqrt(M² - |x|²); a query gets zero. Then all
    vectors have norm M and d(q, x)² = |q|² + M² - 2<q, x>: the largest products are the nearest vectors. A page
    holds entries of one node: a routing entry has its pivot, the covering radius of its subtree and its
    distance from the pivot of the page; a leaf entry its vector and the same distance.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], (ids if rows is None else rows)[order]
        self.v = vectors[order].astype(np.int64)
        self.x = self.v.astype(np.float64)
        self.wide = bool(len(ids)) and bool(np.abs(self.x).max(initial=0) > LARGEST)
        norm2 = np.einsum("ij,ij->i", self.x, self.x)
        self.m2 = float(norm2.max(initial=0))
        self.hat = np.hstack([self.x, np.sqrt(np.maximum(self.m2 - norm2, 0))[:, None]])
        self.page = page
        self.nodes: list[tuple] = []
        every = np.arange(len(ids))
        self.pivot = self.hat.mean(axis=0) if len(ids) else np.zeros(self.hat.shape[1])
        self.radius = float(self._far(every, self.pivot).max(initial=0))
        self.root = self._build(every, self.pivot)
        self.hat = None  # pages have what a search needs

    def __getstate__(self):
        small = self.v if self.wide else self.v.astype(np.int32)
        return self.__dict__ | {"x": None, "v": small}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.x = self.v.astype(np.float64)

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products; those that no long holds are the nearest that one does."""
        if not self.wide and np.abs(q).max(initial=0) <= LARGEST:
            return (self.x[rows] @ q.astype(np.float64)).astype(np.int64)
        exact = (self.v[rows].astype(object) * q.astype(object)).sum(axis=1)
        return np.array([max(-_LONGEST, min(_LONGEST, int(s))) for s in exact], np.int64)

    def _far(self, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        d = self.hat[rows] - pivot
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> int:
        """Bulk load: pivots far from one another share out the rows; equal rows are cut by count."""
        if len(rows) <= self.page:
            self.nodes.append((True, rows, self._far(rows, pivot)))
            return len(self.nodes) - 1
        fan = min(16, -(-len(rows) // self.page))
        near = self._far(rows, pivot)
        owner, chosen = np.zeros(len(rows), int), []
        best = np.full(len(rows), np.inf)
        at = int(near.argmax())
        for k in range(fan):
            chosen.append(at)
            d = self._far(rows, self.hat[rows[at]])
            owner[d < best] = k
            best = np.minimum(best, d)
            at = int(best.argmax())
            if best[at] == 0:
                break
        parts = [rows[owner == k] for k in range(len(chosen))]
        parts = [p for p in parts if len(p)]
        if len(parts) < 2:
            parts = np.array_split(rows, fan)
        pivots, radii, children = [], [], []
        for p in parts:
            c = self.hat[p].mean(axis=0)
            pivots.append(c)
            radii.append(self._far(p, c).max())
            children.append(self._build(p, c))
        pivots = np.array(pivots)
        gap = pivots - pivot
        self.nodes.append((False, pivots, np.array(radii), np.sqrt(np.einsum("ij,ij->i", gap, gap)), children))
        return len(self.nodes) - 1

    def search(self, q: np.ndarray, k: int, own: int | None = None, least: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k largest (score, id), ties to the smaller id, without the row ``own``; and the distances computed.

        Nodes are opened by their least possible distance, until that exceeds the k-th best, or that of score ``least``,
        under which nothing is wanted. Before a distance is computed, |d(q, parent) - d(entry, parent)| - radius, from
        stored distances, may already rule it out.
        """
        exact, q = q, q.astype(np.float64)
        total = float(q @ q) + self.m2
        slack = SLACK * (1 + total**0.5)
        qhat = np.append(q, 0.0)
        top_s, top_i, top_r = (np.empty(0, np.int64) for _ in range(3))
        bound, computed = np.inf if least is None else max(total - 2.0 * least, 0.0) ** 0.5, 0
        heap: list[tuple[float, int, float]] = [(0.0, self.root, np.nan)]
        while heap:
            low, node, dq = heappop(heap)
            if low > bound + slack:
                break
            entry = self.nodes[node]
            if entry[0]:
                rows = entry[1]
                if bound < np.inf and dq == dq:
                    rows = rows[np.abs(entry[2] - dq) <= bound + slack]
                if own is not None:
                    rows = rows[self.rows[rows] != own]
                if not len(rows):
                    continue
                computed += len(rows)
                s = np.concatenate([top_s, self._scores(rows, exact)])
                i, r = np.concatenate([top_i, self.ids[rows]]), np.concatenate([top_r, self.rows[rows]])
                best = np.lexsort((r, i, -s))[:k]
                top_s, top_i, top_r = s[best], i[best], r[best]
                if len(top_s) == k:
                    bound = min(bound, max(total - 2.0 * float(top_s[-1]), 0.0) ** 0.5)
            else:
                _, pivots, radii, far, children = entry
                may = np.arange(len(children))
                if bound < np.inf and dq == dq:
                    may = may[np.abs(far - dq) - radii <= bound + slack]
                if len(may):
                    gap = pivots[may] - qhat
                    computed += len(may)
                    d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                    nearest = np.maximum(d - radii[may], 0.0)
                    for c, lo, dd in zip(may.tolist(), nearest.tolist(), d.tolist()):
                        if lo <= bound + slack:
                            heappush(heap, (lo, children[c], dd))
        return [(int(s), int(i)) for s, i in zip(top_s, top_i)], computed

    def _leaves(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
        """The leaf pages' rows and distances from their pivots; each query's least possible distance to each page, and that to its pivot."""
        rows, far, low, to = [], [], [], []
        q2 = np.einsum("ij,ij->i", q, q)
        waiting = [(self.root, np.zeros(len(q)), np.full(len(q), np.nan))]
        while waiting:
            node, lo, dq = waiting.pop()
            entry = self.nodes[node]
            if entry[0]:
                rows.append(entry[1])
                far.append(entry[2])
                low.append(lo)
                to.append(dq)
                continue
            _, pivots, radii, _, children = entry
            d = np.sqrt(np.maximum(q2[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * q @ pivots[:, :-1].T, 0))
            waiting += [(c, np.maximum(lo, d[:, j] - radii[j]), d[:, j]) for j, c in enumerate(children)]
        return rows, far, np.array(low).T, np.array(to).T

    def search_many(self, exact: np.ndarray, k: int, own: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``search`` for a block of queries: number of the query, score and id of its k largest.

        Every query opens the leaf pages by their least possible distance until that exceeds its bound, as alone; those that are
        at the same page at the same turn share one product of matrices. ``least`` is -inf where there is none.
        """
        if not len(self.ids) or self.wide or np.abs(exact).max(initial=0) > LARGEST:
            got = [(j, *hit) for j, q in enumerate(exact) for hit in self.search(q, k, int(own[j]), None if least[j] == -np.inf else int(least[j]))[0]]
            return tuple(np.array(got, np.int64).reshape(-1, 3).T)
        q = exact.astype(np.float64)
        total = np.einsum("ij,ij->i", q, q) + self.m2
        rows, far, low, to = self._leaves(q)
        pages = [self.x[r] for r in rows]
        leaf_of, column = np.empty(len(self.ids), np.int64), np.empty(len(self.ids), np.int64)
        for j, r in enumerate(rows):
            leaf_of[r], column[r] = j, np.arange(len(r))
        by_row = np.argsort(self.rows)
        spot = by_row[np.minimum(np.searchsorted(self.rows[by_row], own), len(by_row) - 1)]
        mine = np.where(self.rows[spot] == own, leaf_of[spot], -1)
        # A distance from a sum of squares is off by up to the root of the sum's rounding, so by more than one from differences.
        slack = SLACK * (1 + np.sqrt(total)) * 10
        kth, top = np.asarray(least, np.float64).copy(), (np.zeros(0, np.int64),) * 3
        bound = np.where(np.isinf(kth), np.inf, np.sqrt(np.maximum(total - 2 * kth, 0)))
        order = np.argsort(low, axis=1, kind="stable")
        every = np.arange(len(q))
        for turn in range(len(rows)):
            page = order[:, turn]
            live = low[every, page] <= bound + slack
            if not live.any():
                break
            found = []
            for leaf in np.unique(page[live]).tolist():
                asks = np.flatnonzero(live & (page == leaf))
                near = np.abs(far[leaf][None, :] - to[asks, leaf][:, None]) <= (bound + slack)[asks][:, None]
                may = np.flatnonzero(near.any(axis=0)) if not np.isnan(to[asks, leaf]).any() else np.arange(len(rows[leaf]))
                if not len(may):
                    continue
                s = q[asks] @ pages[leaf][may].T
                at_home = np.flatnonzero(mine[asks] == leaf)
                place = np.searchsorted(may, column[spot[asks[at_home]]])
                at_home, place = at_home[place < len(may)], place[place < len(may)]
                hit = may[place] == column[spot[asks[at_home]]]
                s[at_home[hit], place[hit]] = -np.inf
                floor = kth[asks]
                if len(may) > k:
                    empty = np.flatnonzero(floor == -np.inf)
                    floor[empty] = np.partition(s[empty], -k, axis=1)[:, -k]
                i, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
                found.append((asks[i], s[i, j].astype(np.int64), rows[leaf][may[j]]))
            if not found:
                continue
            who, score, at = (np.concatenate([x, *y]) for x, y in zip(top, zip(*found)))
            best = np.lexsort((self.rows[at], self.ids[at], -score, who))
            who, score, at = who[best], score[best], at[best]
            starts = np.searchsorted(who, every)
            kept = np.arange(len(who)) - starts[who] < k
            top = who, score, at = who[kept], score[kept], at[kept]
            held = np.bincount(who, minlength=len(q))
            full = np.flatnonzero(held == k)
            last = score[np.cumsum(held)[full] - 1]
            kth[full] = np.maximum(kth[full], last)
            bound[full] = np.minimum(bound[full], np.sqrt(np.maximum(total[full] - 2.0 * last, 0)))
        return top[0], top[1], self.ids[top[2]]


def score_bounds(q: np.ndarray, pivots: np.ndarray, radii: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """The largest product that each query (row) may have with any vector of each tree (column)."""
    q = q.astype(np.float64)
    q2, p2 = np.einsum("ij,ij->i", q, q)[:, None], np.einsum("ij,ij->i", pivots, pivots)[None, :]
    d = np.sqrt(np.maximum(q2 + p2 - 2 * q @ pivots[:, :-1].T, 0))
    total = q2 + m2[None, :]
    gap = np.maximum(d - radii[None, :] - SLACK * (1 + np.sqrt(total + p2)), 0)
    return (total - gap * gap) / 2 + SLACK * (1 + total)


def scaled_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v (floor of scale times each component, as double in between), dim and h (a hash) of the usable rows."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = table.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    v = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("v", "vec_id"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _apart(x: np.ndarray, n: int) -> np.ndarray:
    """The first row and n - 1 more, each the farthest from those before it."""
    at, far = [0], np.full(len(x), np.inf)
    while len(at) < min(n, len(x)):
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
        at.append(int(far.argmax()))
    return x[at]


def _cells(pivots: dict[int, np.ndarray]):
    """Deals vectors to the nearest pivot of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for dim in np.unique(t.column("dim").to_numpy()).tolist():
                part = t.filter(pa.compute.equal(t.column("dim"), dim)).combine_chunks()
                x, p = _matrix(part.column("v")).astype(np.float64), pivots[dim]
                cell = (np.einsum("ij,ij->i", p, p)[None, :] - 2 * x @ p.T).argmin(axis=1)
                yield from part.append_column("cell", pa.array(cell, pa.int64())).to_batches()

    return run


_TREE = "dim int, cell long, block long, tree binary, pivot array<double>, radius double, m2 double, first long"


def _plant(t: pa.Table) -> pa.Table:
    tree = MTree(t.column("vec_id").to_numpy(), _matrix(t.column("v")), rows=t.column("row").to_numpy())
    one = {c: t.column(c)[:1] for c in ("dim", "cell", "block")}
    return pa.table(one | {"tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary()), "pivot": pa.array([tree.pivot.tolist()], pa.list_(pa.float64())), "radius": pa.array([tree.radius]), "m2": pa.array([tree.m2]), "first": pa.array([int(tree.rows.min())], pa.int64())})


def _routed(home: bool):
    """Trees to search: of every query the one with the best mean score, or all others that may hold a score of ``least``."""

    def run(tops: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_row", "tree_no", "bound"]
        if not tops.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        q, pivots = _matrix(queries.column("q")), _matrix(tops.column("pivot"))
        bounds = q.astype(np.float64) @ pivots[:, :-1].T if home else score_bounds(q, pivots, tops.column("radius").to_numpy(), tops.column("m2").to_numpy())
        rows, trees = queries.column("query_row").to_numpy(), tops.column("tree_no").to_numpy()
        if home:
            i, j = np.arange(len(rows)), bounds.argmax(axis=1)
        else:
            least = np.array([-np.inf if x is None else float(x) for x in queries.column("least").to_pylist()])
            i, j = np.nonzero((bounds >= least[:, None] - SLACK * np.abs(least)[:, None]) & (trees[None, :] != queries.column("home").to_numpy()[:, None]))
        return pa.table([pa.array(rows[i]), pa.array(trees[j]), pa.array(bounds[i, j])], names)

    return run


def _searched(k: int):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64),) * 4]
        if queries.num_rows:
            row, ident, q = queries.column("query_row").to_numpy(), queries.column("query_id").to_numpy(), _matrix(queries.column("q"))
            least = np.array([-np.inf if x is None else x for x in queries.column("least").to_pylist()], np.float64)
            for blob in trees.column("tree"):
                tree = pickle.loads(blob.as_py())
                for at in range(0, len(row), BLOCK):
                    who, score, vec = tree.search_many(q[at : at + BLOCK], k, row[at : at + BLOCK], least[at : at + BLOCK])
                    parts.append((row[at + who], ident[at + who], vec, score))
        return pa.table({n: pa.array(np.concatenate(v), pa.int64()) for n, v in zip(("query_row", "query_id", "vec_id", "score"), zip(*parts))})

    return run


def _route(tops: DataFrame, queries: DataFrame, n_trees: int, parts: int, home: bool) -> DataFrame:
    """Blocks of queries against blocks of tree roots."""
    blocks = -(-n_trees // BLOCK) or 1
    whole = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = tops.withColumn("tops", F.pmod(F.xxhash64("tree_no"), F.lit(blocks))).withColumn("part", whole(parts))
    b = queries.withColumn("tops", whole(blocks))
    key = ["dim", "tops", "part"]
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInArrow(_routed(home), "query_row long, tree_no long, bound double")


def _search(trees: DataFrame, queries: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """Search the trees that queries are routed to: a task is a tree with a block of queries."""
    asked = materialise(queries.join(routed.select("query_row", "tree_no"), "query_row").select("query_row", "query_id", "q", "least", "tree_no", "part"), "asked")
    key = ["tree_no", "part"]
    held = trees.select("tree_no", "tree").join(asked.select(F.col("tree_no").alias("to"), F.col("part").alias("to_part")).distinct(), F.col("tree_no") == F.col("to")).select("tree_no", "tree", F.col("to_part").alias("part"))
    return held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_searched(k), "query_row long, query_id long, vec_id long, score long")


def top_products(table: DataFrame, k: int = 20, every: int = QUERY_EVERY) -> DataFrame:
    """The k largest integer inner products of every query with all other rows.

    Vectors are scaled and floored. Queries are rows whose vec_id is divisible by ``every``. Returns query_id, rank
    (from 1), vec_id, score; ties go to the smaller vec_id; a query with fewer than k others gets all. Vectors that
    are null or hold nulls or non-finite components, and rows without vec_id, take no part; rows that share a vec_id are
    rows of their own, each a query with the others among its candidates; vectors are compared with those of their own
    length; products beyond a long are its least or greatest value; other columns are ignored; an empty table gives an
    empty result.

    Vectors are dealt by the nearest of some pivots, and large cells cut by hash, into trees of about BLOCK. Each query
    searches the tree of the best mean score; the score of its k-th best then rules out trees by their roots' covering
    radii, and the rest are searched from that bound on. All tasks are blocks of bounded size.
    """
    vectors = materialise(scaled_vectors(table).where("dim > 0").withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = {r[0]: r[1] for r in vectors.groupBy("dim").count().collect()}
    n = sum(sizes.values())
    if not n:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score")).where("false")
    wanted = {d: max(1, min(PIVOTS, -(-n // BLOCK)) * c // n) for d, c in sizes.items()}
    chosen = vectors.withColumn("nth", F.row_number().over(W.partitionBy("dim").orderBy("h", "row"))).where(F.col("nth") <= AMONG * max(wanted.values()))
    sample: dict[int, list] = {}
    for r in chosen.orderBy("h", "row").select("dim", "v").collect():
        sample.setdefault(r[0], []).append(r[1])
    packed = {d: _apart(np.array(v, np.float64), wanted[d]) for d, v in sample.items()}
    dealt = vectors.mapInArrow(_cells(packed), "vec_id long, v array<long>, dim int, h long, row long, cell long")
    dealt = materialise(dealt, "cells")
    count = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = dealt.join(F.broadcast(count), ["dim", "cell"]).withColumn("block", F.pmod("h", F.col("blocks")))
    trees = materialise(dealt.groupBy("dim", "cell", "block").applyInArrow(_plant, _TREE).withColumnRenamed("first", "tree_no"), "trees")
    tops = trees.select("tree_no", "dim", "pivot", "radius", "m2")
    n_trees = trees.count()
    parts = -(-n // (every * BLOCK)) or 1
    none = F.lit(None).cast("long")
    queries = materialise(
        vectors.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "dim", F.col("v").alias("q"), F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(parts)).alias("part"), none.alias("least"), none.alias("home")),
        "queries",
    )
    home = _route(tops, queries, n_trees, parts, True).groupBy("query_row").agg(F.max_by("tree_no", F.struct("bound", "tree_no")).alias("tree_no"))
    home = materialise(home, "home")
    first = materialise(_search(trees, queries, home, k), "first")
    bounds = first.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    bounded = queries.drop("least", "home").join(home.withColumnRenamed("tree_no", "home"), "query_row").join(bounds, "query_row", "left")
    bounded = materialise(bounded.select("query_row", "query_id", "dim", "q", "part", "least", "home"), "bounded")
    others = materialise(_route(tops, bounded, n_trees, parts, False), "others")
    found = first.unionByName(_search(trees, bounded, others, k))
    best = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
