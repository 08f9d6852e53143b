"""SimHash near-duplicates by a binary-trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialise, spread
from .common import connected_components, forest, text_batches, whole_groups

#: Widths of the three blocks of a 64-bit fingerprint. Two differing bits leave one block untouched.
BLOCKS = (22, 21, 21)
#: A trie root with more leaves than this is split into tasks of node pairs one byte further down.
HOT_LEAVES = 2048


def majority_bits(h: np.ndarray) -> int:
    """The bits that over half of the unsigned 64-bit hashes have set (none for no hashes)."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def shingle_fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text (null or wordless: 0)."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z fold, only ASCII spaces split
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    parts = zip(*(words[i:] for i in range(width)))
    h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in map(b" ".join, parts)), np.uint64, len(words) - width + 1)
    return majority_bits(h)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((shingle_fingerprint(x.as_py(), width, seed) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text_batches(spread(src)).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(keys: np.ndarray, roots: list[tuple[int, int, int, int]] | np.ndarray, bits: int, budget: int):
    """Pairs of leaves of a binary trie that differ in at most ``budget`` bits.

    ``keys`` are sorted unsigned integers whose lowest ``bits`` bits are still to compare; ``roots`` are node
    pairs as rows (lo_a, hi_a, lo_b, hi_b) of index ranges, each range sorted and sharing its upper bits.
    All node pairs go down one bit at a time together. A pair's differing bits accumulate; a pair over the
    budget is pruned. A single leaf against a single leaf is settled by its remaining bits at once.
    """
    nodes = np.asarray(roots, np.int64).reshape(-1, 4)
    err = np.zeros(len(nodes), np.int64)
    found = []
    for bit in range(bits - 1, -2, -1):
        single = (nodes[:, 1] - nodes[:, 0] == 1) & (nodes[:, 3] - nodes[:, 2] == 1)
        if single.any():
            a, b, e = nodes[single, 0], nodes[single, 2], err[single]
            rest = np.uint64((1 << (bit + 1)) - 1)
            ok = (a != b) & (e + np.bitwise_count((keys[a] ^ keys[b]) & rest) <= budget)
            found.append(np.stack([a[ok], b[ok]], axis=1))
            nodes, err = nodes[~single], err[~single]
        if bit < 0 or not len(nodes):
            break
        one = ((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(one)])  # zeros come first in a sorted node
        mid_a = nodes[:, 1] - (ones[nodes[:, 1]] - ones[nodes[:, 0]])
        mid_b = nodes[:, 3] - (ones[nodes[:, 3]] - ones[nodes[:, 2]])
        a0, a1 = (nodes[:, 0], mid_a), (mid_a, nodes[:, 1])
        b0, b1 = (nodes[:, 2], mid_b), (mid_b, nodes[:, 3])
        same = (nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] == nodes[:, 3])
        new, errs = [], []
        for x, y, more in ((a0, b0, 0), (a1, b1, 0), (a0, b1, 1), (a1, b0, 1)):
            keep = (x[1] > x[0]) & (y[1] > y[0]) & (err + more <= budget)
            if more and y is b0:
                keep &= ~same  # of a node with itself, one mixed pair is enough
            new.append(np.stack([x[0], x[1], y[0], y[1]], axis=1)[keep])
            errs.append((err + more)[keep])
        nodes, err = np.concatenate(new), np.concatenate(errs)
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _join_tasks(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Trie self-joins of tasks that come sorted; a star to its lowest document for every local component."""
    for t in whole_groups(batches, "task"):
        col = {c: t.column(c).to_numpy() for c in ("task", "side", "rest", "doc")}
        col["rest"] = col["rest"].astype(np.int64).view(np.uint64)
        order = np.lexsort((col["rest"], col["side"], col["task"]))
        task, side, rest, doc = (col[c][order] for c in ("task", "side", "rest", "doc"))
        starts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        ends = np.r_[starts[1:], len(task)]
        many = ends - starts > 1
        starts, ends = starts[many], ends[many]
        at = 0
        while at < len(starts):  # a bounded number of leaves at a time
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + 4 * HOT_LEAVES, side="right")))
            s, e = starts[at:to], ends[at:to]
            lo, hi = int(s[0]), int(e[-1])
            crossed = np.concatenate([[0], np.cumsum(side[lo:hi])])
            split = e - (crossed[e - lo] - crossed[s - lo])  # side 1 of a node-pair task
            own = split == e
            roots = np.stack([s, np.where(own, e, split), np.where(own, s, split), e], axis=1) - lo
            roots = roots[(roots[:, 1] > roots[:, 0]) & (roots[:, 3] > roots[:, 2])]
            label = forest(hi - lo, trie_pairs(rest[lo:hi], roots, 64, budget))
            linked = np.flatnonzero(label != np.arange(hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][linked]), pa.array(doc[lo:hi][label[linked]])], names=["src", "dst"])
            at = to


def near_links(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """Spanning links between distinct fingerprints (columns doc, fp) at ``budget`` or fewer differing bits.

    For each of the three blocks, fingerprints that agree on the block are the leaves of one trie over the
    other bits; budgets over 2 would need more blocks and are refused. Roots with over HOT_LEAVES leaves are
    split: their leaves are dealt by one more byte, and each pair of such nodes within the budget is a task
    of its own, so that no task holds a large root. Tasks return stars, not all pairs.
    """
    if not 0 <= budget <= 2:
        raise ValueError("three blocks serve budgets 0 to 2")
    n0, n1, n2 = BLOCKS
    fp = F.col("fp")
    rotated = F.array(
        fp,
        F.shiftleft(fp, n0).bitwiseOR(F.shiftrightunsigned(fp, 64 - n0)),
        F.shiftleft(fp, n0 + n1).bitwiseOR(F.shiftrightunsigned(fp, 64 - n0 - n1)),
    )
    rows = distinct.select("doc", F.posexplode(rotated).alias("rot", "bits"))
    width = F.when(F.col("rot") == 0, n0).otherwise(n1)
    block = F.when(F.col("rot") == 0, F.shiftrightunsigned("bits", 64 - n0)).otherwise(F.shiftrightunsigned("bits", 64 - n1))
    rows = rows.select("doc", "bits", (F.col("rot").cast("long") * (1 << 24) + block).alias("root"), width.alias("width"))
    hot = rows.groupBy("root").count().where(F.col("count") > HOT_LEAVES).select("root", F.lit(True).alias("hot"))
    rows = rows.join(hot, "root", "left")
    byte = F.expr("shiftrightunsigned(bits << width, 56)")
    masks = [0] + [1 << i for i in range(8)] + [(1 << i) | (1 << j) for i in range(8) for j in range(i)]
    masks = [m for m in masks if bin(m).count("1") <= budget]
    other = F.col("node").bitwiseXOR(F.col("mask"))
    cold = rows.where("hot is null").select(F.struct("root", F.lit(-1).cast("long").alias("pair")).alias("k"), F.lit(0).alias("side"), "bits", "doc")
    warm = (
        rows.where("hot")
        .select("root", "bits", "doc", byte.alias("node"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
        .select(
            F.struct("root", (F.least("node", other) * 256 + F.greatest("node", other)).alias("pair")).alias("k"),
            F.when(F.col("node") > other, 1).otherwise(0).alias("side"),
            "bits",
            "doc",
        )
    )
    tasks = cold.unionByName(warm).select(
        (F.col("k.root") * 65536 + F.col("k.pair") + 1).alias("task"), F.col("side").cast("long"), F.col("bits").alias("rest"), "doc"
    )
    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(lambda b: _join_tasks(b, budget), "src long, dst long")


def simhash_components(docs: DataFrame, width: int = 3, seed: int = 42, budget: int = 2) -> DataFrame:
    """Near-duplicate class of every document.

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable through
    fingerprints at ``budget`` or fewer differing bits. Null and wordless texts have fingerprint zero and link
    like others; equal fingerprints are one class whatever their number; repeated doc_ids keep all their rows;
    rows without doc_id keep their fingerprint and have component null; empty tables give an empty result;
    other columns are ignored.
    """
    fps = materialise(fingerprints(docs, width, seed), "fingerprints")
    distinct = materialise(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct")
    part = connected_components(near_links(distinct, budget), label="simhash")
    named = distinct.join(part, distinct.doc == part.node, "left").select(
        "fp", F.coalesce("component", "doc").alias("component_id")
    )
    return fps.join(named, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one_per_class(docs: DataFrame, **how) -> DataFrame:
    """The documents whose doc_id names their near-duplicate class, with all their columns; null ids stay."""
    heads = simhash_components(docs, **how).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is null").unionByName(docs.where("doc_id is not null").join(heads, "doc_id", "left_semi").select(docs.columns))
