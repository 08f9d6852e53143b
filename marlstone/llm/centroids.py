"""Centroid clustering of whole-number vectors: exact distances from float64 matrix products, exact sums by treeAggregate."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import spread

DIM, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Rows of one matrix product.
ROWS = 4096
#: Components up to this magnitude keep every term and partial sum of |x|^2 - 2x.c + |c|^2 within DIM * (2 * SMALL)^2 = 2^52.
SMALL = 1 << 22
#: Components of both sides up to this magnitude keep a squared distance within 64-bit integers; larger ones go to Python's.
WIDE = 1 << 27
_MOST = 2**63 - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles: float64 where that is exact for all, else Python integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * SCALE)
    if np.isfinite(v).all():
        return v
    return np.array([[math.floor(a) * SCALE if abs(a) > 2.0**53 else math.floor(a * SCALE) for a in row] for row in x.tolist()], object).reshape(x.shape)


def _exact(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of few or large rows by integers: 64-bit ones within WIDE, else Python's."""
    top = max(int(abs(v).max(initial=0)), int(abs(c).max(initial=0)))
    if top <= WIDE:
        v, c = v.astype(np.int64), c.astype(np.int64)
        return np.stack([np.square(v - c[j]).sum(1) for j in range(len(c))], axis=1)
    v = [[int(a) for a in row] for row in v.tolist()]
    c = [[int(a) for a in row] for row in c.tolist()]
    out = np.empty((len(v), len(c)), object)
    for i, a in enumerate(v):
        for j, b in enumerate(c):
            out[i, j] = sum((p - q) ** 2 for p, q in zip(a, b))
    return out


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; ties go to the smaller number; exact.

    Rows and centroids within SMALL meet in one float64 product. A centroid beyond it is compared by integers, and only
    with rows to which its largest component does not already prove it farther than that product's best; rows
    beyond it are compared by integers throughout.
    """
    c = np.array(centroids, object).reshape(len(centroids), -1)
    size = np.array([max(map(abs, row), default=0) for row in centroids], object)
    near = np.flatnonzero(size <= SMALL)
    tops = abs(v).max(1, initial=0)
    plain = np.asarray(tops <= SMALL, bool) if len(near) else np.zeros(len(v), bool)
    simple = plain.all() and len(near) == len(c)
    best, dist = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64 if simple else object)
    if plain.any():
        x, y = v[plain].astype(np.float64), c[near].astype(np.float64)
        d = np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ y.T) + np.einsum("ij,ij->i", y, y)
        at = d.argmin(1)
        best[plain], found = near[at], d[np.arange(len(d)), at].astype(np.int64)
        dist[plain] = found
        rows = np.flatnonzero(plain)
        for j in np.flatnonzero(size > SMALL).tolist():
            reach = size[j] - SMALL  # the least distance to a row within SMALL
            left = rows if reach * reach <= DIM * (2 * SMALL) ** 2 else rows[:0]
            if len(left):
                e = _exact(v[left], c[j : j + 1])[:, 0]
                win = np.array([(a, j) < (b, k) for a, b, k in zip(e.tolist(), dist[left].tolist(), best[left].tolist())], bool)
                best[left[win]], dist[left[win]] = j, e[win]
    rest = np.flatnonzero(~plain)
    for lo in range(0, len(rest), 256):
        part = rest[lo : lo + 256]
        d = _exact(v[part], c)
        best[part] = [min(range(len(c)), key=row.__getitem__) for row in d.tolist()]
        dist[part] = d[np.arange(len(part)), best[part]]
    return best, dist


def _sums(v: np.ndarray, best: np.ndarray, k: int) -> list[list[int]]:
    """Componentwise sums by cluster, as Python integers: a product with the membership matrix while that is exact."""
    if len(v) * int(abs(v).max(initial=0)) < 2**53:
        member = np.zeros((k, len(v)))
        member[best, np.arange(len(v))] = 1
        return (member @ v.astype(np.float64)).astype(np.int64).tolist()
    out = [[0] * v.shape[1] for _ in range(k)]
    for j, row in zip(best.tolist(), v.tolist()):
        out[j] = [a + int(b) for a, b in zip(out[j], row)]
    return out


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole-number vectors) by blocks of a batch whose second column holds vectors of one length."""
    for lo in range(0, batch.num_rows, ROWS):
        part = batch.column(1)[lo : lo + ROWS]
        x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield lo, whole(x.reshape(len(part), -1))


class Totals:
    """Counts, sums and summed distances by cluster: whole numbers of any size."""

    def __init__(self, k: int, dim: int):
        self.n, self.sums, self.inertia = [0] * k, [[0] * dim for _ in range(k)], [0] * k

    def add(self, v: np.ndarray, best: np.ndarray, dist: np.ndarray) -> None:
        k = len(self.n)
        self.n = [a + int(b) for a, b in zip(self.n, np.bincount(best, minlength=k))]
        self.sums = [[a + b for a, b in zip(p, q)] for p, q in zip(self.sums, _sums(v, best, k))]
        if dist.dtype == object:
            for j, d in zip(best.tolist(), dist.tolist()):
                self.inertia[j] += int(d)
        else:  # halves of 26 bits keep every sum of a block exact in float64
            high, low = (np.bincount(best, x, k) for x in (dist >> 26, dist & (1 << 26) - 1))
            self.inertia = [a + (int(h) << 26) + int(e) for a, h, e in zip(self.inertia, high, low)]

    def merge(self, other: Totals) -> Totals:
        self.n = [a + b for a, b in zip(self.n, other.n)]
        self.sums = [[a + b for a, b in zip(p, q)] for p, q in zip(self.sums, other.sums)]
        self.inertia = [a + b for a, b in zip(self.inertia, other.inertia)]
        return self


def totals(vectors: DataFrame, centroids: list[list[int]]) -> Totals:
    """Totals of all vectors under their nearest centroids: one partial a partition, combined by treeAggregate."""
    k, dim = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Totals(k, dim)
        for b in batches:
            for _, v in _vectors(b):
                out.add(v, *nearest(v, centroids))
        yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(out)], pa.binary())})

    merged = lambda a, b: b if a is None else a if b is None else a.merge(b)
    parts = vectors.mapInArrow(run, "part binary").rdd
    return parts.treeAggregate(None, lambda a, r: merged(a, pickle.loads(bytes(r[0]))), merged, 2) or Totals(k, dim)


def kept_vectors(df: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    e = F.col("embedding")
    good = (F.size(e) == dim) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long"), "embedding")


def _first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    text = F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = vectors.orderBy(F.sha2(text, 256), "embedding").limit(k).select("embedding").collect()
    return [[int(a) for a in whole(np.array([r[0]], np.float64))[0]] for r in rows]


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after the rounds: a non-empty cluster's is the floor of its exact mean, an empty one's stays."""
    cur = _first_centroids(vectors, k)
    for _ in range(rounds if cur else 0):
        t = totals(vectors, cur)
        new = [[s // n for s in sums] if n else old for old, n, sums in zip(cur, t.n, t.sums)]
        if new == cur:  # all further rounds would be the same
            break
        cur = new
    return cur


def centroid_clusters(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """Cluster of every vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of ``dim`` components, none null or non-finite, become whole numbers floor(256 * x). The first centroids are those
    whose ``2:<vec_id>`` has the least sha256 (a null vec_id reads ``null``; rows that share one are in order of
    their components), so there are fewer than ``k`` where fewer vectors are kept. What reaches the driver is k sums of
    ``dim`` numbers from each round. Repeated rows count each; other columns are ignored; nothing kept gives an empty
    result. Distances and their sums are exact; a column shows at most 2^63 - 1 of them.
    """
    vectors = spread(kept_vectors(df, dim))
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = fit(vectors, k, rounds)
    if not centroids:
        return df.sparkSession.createDataFrame([], schema)
    sums = totals(vectors, centroids).inertia
    own, all_ = np.array([min(s, _MOST) for s in sums], np.int64), min(sum(sums), _MOST)
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, v in _vectors(b):
                best, dist = nearest(v, centroids)
                d = dist if dist.dtype != object else np.array([min(int(x), _MOST) for x in dist.tolist()], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": b.column(0)[lo : lo + len(v)],
                        "cluster": pa.array(best.astype(np.int32)),
                        "distance": pa.array(d),
                        "cluster_inertia": pa.array(own[best]),
                        "inertia": pa.array(np.full(len(v), all_, np.int64)),
                        "centroid_sha256": pa.array(names[best], pa.string()),
                    }
                )

    return vectors.mapInArrow(run, schema)


def _oracle() -> str:
    """The same in DuckDB: components as rows, one pair of assignment and centroid steps for each round."""
    parts = [
        f"""WITH kept AS (SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
v AS MATERIALIZED (SELECT i, p, CAST(floor({SCALE} * e[p]) AS HUGEINT) AS x FROM (SELECT i, e, unnest(range(1, {DIM + 1})) AS p FROM kept)),
f AS (SELECT i, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), e) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, p, x AS m FROM f JOIN v USING (i) WHERE c < {CLUSTERS})"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT i, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT i, c, sum((x - m) * (x - m)) AS d FROM v JOIN c{r} USING (p) GROUP BY i, c) GROUP BY i)")
        if r < ROUNDS:
            floor = "CASE WHEN s >= 0 OR s % n = 0 THEN s // n ELSE s // n - 1 END"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.p, coalesce(t.m, o.m) AS m FROM c{r} o LEFT JOIN (SELECT c, p, {floor} AS m FROM (SELECT c, p, sum(x)::HUGEINT AS s, count(*) AS n FROM a{r} JOIN v USING (i) GROUP BY c, p)) t ON o.c = t.c AND o.p = t.p)")
    h = f"h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY p)) AS h FROM c{ROUNDS} GROUP BY c)"
    return ",\n".join([*parts, h]) + f"\nSELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN kept USING (i) JOIN h USING (c)"


ORACLE_SQL = _oracle()
