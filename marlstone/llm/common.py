"""Pieces that several operators of this folder share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import BATCH_BYTES, BATCH_ROWS, discard, materialise, release, text_batches  # noqa: F401

#: Fixed by the query contracts: what separates words (space and the five ASCII controls 9 to 13).
SPACES = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of complete groups from batches that are sorted by ``keys``; no more than a batch and one group is held."""
    held: list[pa.RecordBatch] = []

    def key(b, at):
        return [b.column(k)[at] for k in keys]

    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if len(cuts):
            last = int(cuts[-1])
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = [b.slice(last)]
        elif held and key(held[-1], held[-1].num_rows - 1) != key(b, 0):
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def vocabulary_path(name: str) -> str:
    """A public tokenizer file, by the environment's folder or the installed package; never copied."""
    folder = os.environ.get("MARLSTONE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Edges (16 bytes each) that one task may finish: no more than an ordinary partition holds.
LOCAL_EDGES = 1 << 18


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Lowest index reachable from each of n nodes (pointer jumping)."""
    label = np.arange(n)
    if not len(pairs):
        return label
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label


def _starred(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A task's edges u > v as stars to the lowest node of each component among them; rows go on early while over ``most`` are held."""

    def stars(rows):
        u, v = (np.concatenate(c) for c in zip(*rows))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = nodes[forest(len(nodes), at.reshape(2, -1).T)]
        return nodes[nodes != root], root[nodes != root]

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(tuple(b.column(c).to_numpy() for c in ("u", "v")))
            n += b.num_rows
        if n > 2 * most:
            held = [stars(held)]
            n = len(held[0][0])
            if n > most:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["u", "v"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in stars(held)], names=["u", "v"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", label: str = "cc") -> DataFrame:
    """Smallest reachable node for every node of an undirected edge list of longs.

    Every task first makes stars of its own edges. While over LOCAL_EDGES are left, alternating large-star and small-star rounds
    (public MapReduce algorithm) follow, each a min-aggregate and a join back, so no neighbourhood is gathered in one row; every
    round is written to the shared folder. Rounds end when the edge set stops changing, or when what is left fits one task,
    which makes stars of it. Self-loops and null ends are ignored; repeated edges are harmless. Returns ``node, component``
    for nodes that have an edge to another node.
    """
    most = LOCAL_EDGES
    starred = lambda df: materialise(df.mapInArrow(lambda b: _starred(b, most), "u long, v long"), label)
    cur = starred(edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).where("u <> v"))

    def signature(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    sig, ended = signature(cur), False
    while sig[0] > most and not ended:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = materialise(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), label)
        new = signature(nxt)
        discard(cur)
        cur, ended, sig = nxt, new == sig, new
    if sig[0] and not ended:
        nxt = starred(cur.coalesce(1))
        discard(cur)
        cur = nxt
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
