"""Dense retrieval: exact cosine search, an inverted-file index, and index bookkeeping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import materialise

#: Vectors of one matrix product, so that a task holds few scores at once.
BATCH = 1024


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", out: str = "embedding") -> DataFrame:
    """Unit vectors of texts by an injected encoder (a batch of strings to a matrix)."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            m = np.asarray(encoder(s.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)))

    return texts.withColumn(out, run(F.col(text)))


def hash_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: hashed bag of words."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 1 << 20 else -1
        return out

    return run


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dimension_check(vectors: DataFrame, dim: int) -> DataFrame:
    """The frame, whose evaluation fails at a vector of another dimension."""
    bad = F.raise_error(F.concat(F.lit("dimension "), F.size("embedding").cast("string"), F.lit(f" is not {dim}")))
    return vectors.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(bad.cast("array<float>")))


def cosine_exact(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, block: int = 4096) -> DataFrame:
    """The k nearest vectors of each query by cosine: query_id, rank, chunk_id, score.

    ``vectors`` has chunk_id and embedding, ``queries`` query_id and embedding. Queries are dealt by a hash into blocks
    of about ``block``, and a block is broadcast as one matrix against which all vectors are multiplied; there is no
    limit on their number, and the driver holds one block at a time. Products are at most ``block`` by BATCH scores.
    A task keeps k of each query, so little is shuffled. Ties go to the smaller chunk_id.
    """
    return _by_blocks(vectors, queries, k, block, exclude_self)


def _by_blocks(vectors: DataFrame, queries: DataFrame, k: int, block: int, exclude_self: bool = False, centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    spark = queries.sparkSession
    q = queries.select("query_id", "embedding")
    n = q.count()
    blocks = -(-n // block)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, chunk_id long, score double")
    if blocks > 1:
        q = materialise(q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).repartition(blocks, "block"), "queries")
    found = None
    for b in range(blocks):
        rows = (q.where(F.col("block") == b) if blocks > 1 else q).toPandas()
        for at in range(0, len(rows), 2 * block):  # a hash fills some blocks more than others
            part = _block_products(vectors, rows[at : at + 2 * block], k, exclude_self, centres, probes)
            found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


class _Best:
    """The k best scores of each of n queries so far, equal ones by the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, which: np.ndarray, qid: np.ndarray, ids: np.ndarray, s: np.ndarray, exclude_self: bool) -> None:
        """Scores s of the queries ``which`` (with their ids) by vectors; only what may be among the k best is rounded and sorted."""
        k = self.k + exclude_self
        # rounding to six digits moves a score by half a unit of the last at most
        least = self.score[which, -1] - 1e-6
        near = s >= least[:, None]
        if s.shape[1] > k and near.sum() > 4 * k * len(which):
            near &= s >= np.partition(s, -k, axis=1)[:, -k, None] - 1e-6
        q, x = np.nonzero(near)
        score, ids = np.round(s[q, x], 6), ids[x]
        if exclude_self:
            other = qid[q] != ids
            q, ids, score = q[other], ids[other], score[other]
        if not len(q):
            return
        touched, q = np.unique(q, return_inverse=True)
        at = which[touched]
        q = np.concatenate([np.repeat(np.arange(len(at)), self.k), q])
        score, ids = np.concatenate([self.score[at].ravel(), score]), np.concatenate([self.id[at].ravel(), ids])
        order = np.lexsort((ids, -score, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(len(at)))
        best = order[first[:, None] + np.arange(self.k)]
        self.score[at], self.id[at] = score[best], ids[best]


def _block_products(vectors: DataFrame, rows: pd.DataFrame, k: int, exclude_self: bool, centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """The k best of each task's vectors for each of a block of queries; with ``centres``, of those in the query's lists alone."""
    raw = np.vstack(rows["embedding"].to_numpy()).astype(float)
    m = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-300)
    sent = vectors.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), m, None if centres is None else _nearest_lists(raw, centres, probes)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, m, lists = sent.value
        every = np.arange(len(qid))
        asking = None if lists is None else [np.flatnonzero((lists == j).any(1)) for j in range(len(centres))]
        best = _Best(len(qid), k)
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                pdf = whole[at : at + BATCH]
                ids, raw = pdf["chunk_id"].to_numpy(), np.vstack(pdf["embedding"].to_numpy()).astype(float)
                x = (raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-300)).T
                if asking is None:
                    best.offer(every, qid, ids, m @ x, exclude_self)
                    continue
                own = _nearest_lists(raw, centres, 1)[:, 0]
                for j in np.unique(own).tolist():
                    q, mine = asking[j], own == j
                    if len(q):
                        best.offer(q, qid[q], ids[mine], m[q] @ x[:, mine], exclude_self)
        found = pd.DataFrame({"query_id": np.repeat(qid, k), "chunk_id": best.id.ravel(), "score": best.score.ravel()})
        yield found[np.isfinite(found["score"])]

    return vectors.select("chunk_id", "embedding").mapInPandas(run, "query_id long, chunk_id long, score double")


def _nearest_lists(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(x @ centres.T), axis=1)[:, :n]


def nearest(vectors: DataFrame, ids: list[int], k: int) -> DataFrame:
    """The k nearest other vectors of given ones."""
    q = vectors.where(F.col("chunk_id").isin(*ids)).select(F.col("chunk_id").alias("query_id"), "embedding")
    return cosine_exact(vectors, q, k, exclude_self=True)


def ivf_build(vectors: DataFrame, lists: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Centres of an inverted-file index: spherical k-means on at most ``sample`` vectors (least hash of id)."""
    rows = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toPandas()
    x = np.vstack(rows["embedding"].to_numpy()).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(rounds):
        owner = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (owner == j).any():
                c[j] = x[owner == j].mean(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def ann_search(vectors: DataFrame, queries: DataFrame, k: int, centres: np.ndarray, probes: int, block: int = 4096) -> DataFrame:
    """Approximate search: every vector is in the list of its nearest centre, a query looks into ``probes`` lists.

    As in ``cosine_exact``, blocks of queries are multiplied with batches of vectors, here list by list and by the queries alone that look there.
    """
    return _by_blocks(vectors, queries, k, block, centres=centres, probes=probes)


def path_choice(allowed: int, limit: int = 5000) -> str:
    """Exact search over few vectors, the index over many."""
    return "exact" if allowed <= limit else "ann"


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of each query's exact results that were found."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def register_model(registry: DataFrame, model: str, dim: int) -> DataFrame:
    """The registry with a model; a model that is there with another dimension is an error."""
    held = registry.where(F.col("model") == model).select("dim").first()
    if held and held[0] != dim:
        raise ValueError(f"{model} has dimension {held[0]}, not {dim}")
    return registry if held else registry.unionByName(registry.sparkSession.createDataFrame([(model, dim)], registry.select("model", "dim").schema))


def prewarm(vectors: DataFrame) -> DataFrame:
    """Persist a model's vectors in memory and disk before a batch of searches."""
    return vectors.persist()
