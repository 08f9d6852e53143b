"""A navigable small-world index: a layered proximity graph in each part of the vectors, stored as a table and searched by beams.

The table has one row a vector: part, node (from 0 in its part), chunk_id, embedding (unit length), and links, an array of neighbour
nodes for each layer that the node is in. Parts hold about PART_ROWS vectors whatever the corpus size, so that a part is built and
searched within one task's memory; queries meet each part once, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

#: Vectors of a part, about; links of a node in an upper layer (twice as many in the lowest); queries of one batch of beams.
PART_ROWS, M, BATCH = 4096, 16, 256
_GRAPH = "part int, node int, chunk_id long, embedding array<float>, links array<array<int>>"


def _near(x: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """For each of the nodes its ``most`` nearest others, best first, by blocks of a matrix product; short rows end in -1."""
    out = np.full((len(nodes), most), -1, np.int64)
    take = min(most, len(nodes) - 1)
    for lo in range(0, len(nodes) if take > 0 else 0, 1024):
        s = x[nodes[lo : lo + 1024]] @ x[nodes].T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        top = np.argpartition(-s, take - 1, axis=1)[:, :take]
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[lo : lo + len(s), :take] = nodes[np.take_along_axis(top, order, 1)]
    return out


def _diverse(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each node's near ones those that are nearer to it than to any kept before, then the nearest of the rest, up to ``most``."""
    out = np.full((len(nodes), most), -1, np.int64)
    for i, (node, row) in enumerate(zip(nodes, near)):
        row = row[row >= 0]
        to_node, among = x[row] @ x[node], x[row] @ x[row].T
        kept: list[int] = []
        for j in range(len(row)):
            if len(kept) < most and all(among[j, h] < to_node[j] for h in kept):
                kept.append(j)
        kept += [j for j in range(len(row)) if j not in set(kept)][: most - len(kept)]
        out[i, : len(kept)] = row[kept]
    return out


def _with_reverse(nodes: np.ndarray, links: np.ndarray, most: int) -> list[list[int]]:
    """Links of each node and, as far as there is room up to ``most``, the nodes that link to it."""
    at = {int(n): [int(j) for j in row if j >= 0] for n, row in zip(nodes, links)}
    for n, row in zip(nodes.tolist(), links.tolist()):
        for j in row:
            if j >= 0 and len(at[j]) < most and n not in at[j]:
                at[j].append(n)
    return [at[int(n)] for n in nodes]


def build_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """The graph of one part. A node's layers follow from the hash of its id, so that a build can be repeated."""
    pdf = pdf.sort_values("chunk_id").reset_index(drop=True)
    x = np.vstack(pdf["embedding"].to_numpy()).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    level = pdf["level"].to_numpy()
    links: list[list[list[int]]] = [[] for _ in range(len(x))]
    for layer in range(int(level.max()) + 1):
        nodes = np.flatnonzero(level >= layer)
        most = 2 * M if layer == 0 else M
        for n, row in zip(nodes, _with_reverse(nodes, _diverse(x, nodes, _near(x, nodes, 2 * most), most), most)):
            links[n].append(row)
    return pd.DataFrame({"part": pdf["part"], "node": np.arange(len(x), dtype=np.int32), "chunk_id": pdf["chunk_id"], "embedding": list(x), "links": links})


def build_graph(vectors: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """Write the index of ``chunk_id`` (unique) and ``embedding`` (one dimension, not zero) as a Parquet table at ``path``."""
    parts = max(1, -(-vectors.count() // part_rows))
    dealt = F.xxhash64("chunk_id")
    # A node is in layer l and below with probability M^-l, by other bits of its hash than those that choose its part.
    drawn = (F.pmod(F.xxhash64("chunk_id", F.lit("level")), F.lit(1 << 30)) + 1) / (1 << 30)
    rows = vectors.select(F.pmod(dealt, F.lit(parts)).cast("int").alias("part"), F.col("chunk_id").cast("long"), "embedding", F.floor(-F.log(drawn) / float(np.log(M))).cast("int").alias("level"))
    rows.groupBy("part").applyInPandas(build_part, _GRAPH).write.mode("overwrite").parquet(path)


class Part:
    """One part's graph in memory: unit vectors and padded links by layer."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["node"])
        self.ids = np.array([r["chunk_id"] for r in rows])
        self.x = np.array([r["embedding"] for r in rows], np.float32)
        self.allowed = np.array([r["allowed"] for r in rows], bool)
        depth = max(len(r["links"]) for r in rows)
        self.layers = []
        for layer in range(depth):
            width = max((len(r["links"][layer]) for r in rows if len(r["links"]) > layer), default=0)
            a = np.full((len(rows), max(width, 1)), -1, np.int64)
            for r in rows:
                if len(r["links"]) > layer:
                    a[r["node"], : len(r["links"][layer])] = r["links"][layer]
            self.layers.append(a)
        self.entry = next(r["node"] for r in rows if len(r["links"]) == depth)

    def _scores(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        s = np.einsum("qmd,qd->qm", self.x[nodes], q)
        s[nodes < 0] = -np.inf
        return s

    def search(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and scores (Q x k, best first, -1 where there are fewer) and distances computed, for unit vectors q.

        Greedy descent through the upper layers, then a beam of ``ef`` in the lowest. Only allowed nodes are results, while beams pass
        through all. Where fewer than k allowed nodes were met, those queries start again with a beam of twice the width, and
        once more when they have k. Where a beam would hold a quarter of the part, or would meet
        more nodes (about M for each of its places) than are allowed, the allowed ones are scanned.
        """
        n, most = len(self.x), min(k, int(self.allowed.sum()))
        cost = np.zeros(len(q), np.int64)
        cur = np.full(len(q), self.entry)
        score = self._scores(q, cur[:, None])[:, 0]
        for layer in self.layers[:0:-1]:
            moving = np.arange(len(q))
            while len(moving):
                nodes = layer[cur[moving]]
                s = self._scores(q[moving], nodes)
                cost[moving] += (nodes >= 0).sum(1)
                at = s.argmax(1)
                better = s[np.arange(len(s)), at] > score[moving]
                cur[moving[better]], score[moving[better]] = nodes[better, at[better]], s[better, at[better]]
                moving = moving[better]
        ids, out = np.full((len(q), k), -1), np.full((len(q), k), -np.inf, np.float32)
        left, settled = np.arange(len(q)), np.zeros(len(q), bool)
        while len(left):
            if 4 * ef >= n or self.allowed.sum() <= M * ef:
                i, s, c = self._scan(q[left], k)
                ids[left], out[left] = i, s
                cost[left] += c
                break
            i, s, c = self._beam(q[left], cur[left], score[left], k, ef)
            ids[left], out[left] = i, s
            cost[left] += c
            met = (i >= 0).sum(1) >= most
            again = ~met | (met & ~settled[left] & ~self.allowed.all())
            settled[left] = met
            left = left[again]
            ef *= 2
        return ids, out, cost

    def _scan(self, q, k):
        nodes = np.flatnonzero(self.allowed)
        s = q @ self.x[nodes].T
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        ids, out = np.full((len(q), k), -1), np.full((len(q), k), -np.inf, np.float32)
        ids[:, : order.shape[1]], out[:, : order.shape[1]] = nodes[order], np.take_along_axis(s, order, 1)
        return ids, out, np.full(len(q), len(nodes))

    def _beam(self, q, start, score, k, ef):
        rows = np.arange(len(q))
        ids, s, open_ = np.full((len(q), ef), -1), np.full((len(q), ef), -np.inf, np.float32), np.zeros((len(q), ef), bool)
        ids[:, 0], s[:, 0], open_[:, 0] = start, score, True
        seen = np.zeros((len(q), len(self.x)), bool)
        seen[rows, start] = True
        best_id, best = np.full((len(q), k), -1), np.full((len(q), k), -np.inf, np.float32)
        ok = self.allowed[start]
        best_id[ok, 0], best[ok, 0] = start[ok], score[ok]
        cost = np.ones(len(q), np.int64)
        live = rows
        while len(live):
            at = np.where(open_[live], s[live], -np.inf).argmax(1)
            going = open_[live, at]
            live, at = live[going], at[going]
            open_[live, at] = False
            nodes = self.layers[0][ids[live, at]]
            nodes = np.where((nodes >= 0) & ~seen[live[:, None], nodes], nodes, -1)
            r, c = np.nonzero(nodes >= 0)
            seen[live[r], nodes[r, c]] = True
            cost[live] += (nodes >= 0).sum(1)
            new = self._scores(q[live], nodes)
            for held, value, extra, width in ((ids, s, open_, ef), (best_id, best, None, k)):
                ok = new if extra is not None else np.where(self.allowed[nodes] & (nodes >= 0), new, -np.inf)
                both_s, both_i = np.hstack((value[live], ok)), np.hstack((held[live], nodes))
                pick = np.argpartition(-both_s, width - 1, axis=1)[:, :width]
                value[live] = np.take_along_axis(both_s, pick, 1)
                held[live] = np.where(np.isfinite(value[live]), np.take_along_axis(both_i, pick, 1), -1)
                if extra is not None:
                    flags = np.hstack((extra[live], np.isfinite(new)))
                    extra[live] = np.take_along_axis(flags, pick, 1) & np.isfinite(value[live])
        order = np.argsort(-best, axis=1, kind="stable")
        return np.take_along_axis(best_id, order, 1), np.take_along_axis(best, order, 1), cost


def graph_search(graph: DataFrame, queries: DataFrame, k: int, ef: int = 64, allowed: DataFrame | None = None, counts: bool = False) -> DataFrame:
    """The k nearest vectors of each query by cosine, approximately: query_id, rank, chunk_id, score.

    ``graph`` is what ``build_graph`` wrote; ``queries`` has query_id and embedding; ``allowed`` (chunk_id) filters the results. Graph rows and
    queries are dealt to the parts and sorted, so that a task holds one part and a batch of queries at a time. With ``counts``: query_id,
    distances (computed in all parts).
    """
    rows = graph if allowed is None else graph.join(allowed.select("chunk_id", F.lit(True).alias("ok")).distinct(), "chunk_id", "left")
    ok = F.lit(True) if allowed is None else F.coalesce("ok", F.lit(False))
    rows = rows.select("part", F.lit(0).alias("kind"), "node", "chunk_id", F.col("embedding").cast("array<float>"), "links", ok.alias("allowed"))
    parts = graph.select("part").distinct().select("part")
    asked = queries.select(F.col("query_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<float>"))
    asked = asked.join(F.broadcast(parts.groupBy().agg(F.collect_list("part").alias("parts"))), how="inner").select(F.explode("parts").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("node"), "chunk_id", "embedding", F.lit(None).cast("array<array<int>>").alias("links"), F.lit(None).cast("boolean").alias("allowed"))
    out = "query_id long, distances long" if counts else "query_id long, chunk_id long, score double"

    def answer(part: Part, asked: list[dict]) -> pa.RecordBatch:
        q = np.array([r["embedding"] for r in asked], np.float32)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
        nodes, scores, cost = part.search(q, k, ef)
        name = np.array([r["chunk_id"] for r in asked])
        if counts:
            return pa.RecordBatch.from_pydict({"query_id": name, "distances": cost})
        hit = nodes >= 0
        return pa.RecordBatch.from_pydict({"query_id": np.repeat(name, hit.sum(1)), "chunk_id": part.ids[nodes[hit]], "score": scores[hit].astype(float)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, part, waiting = None, [], None, []
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != at:
                    if waiting:
                        yield answer(part, waiting)
                    at, held, part, waiting = r["part"], [], None, []
                if r["kind"] == 0:
                    held.append(r)
                    continue
                if part is None:
                    part, held = Part(held), []
                waiting.append(r)
                if len(waiting) == BATCH:
                    yield answer(part, waiting)
                    waiting = []
        if waiting:
            yield answer(part, waiting)

    found = rows.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind").mapInArrow(run, out)
    if counts:
        return found.groupBy("query_id").agg(F.sum("distances").alias("distances"))
    found = found.withColumn("score", F.round("score", 6))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_GRAPH).parquet(path)
