"""Best-two-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import materialise, spread
from .common import text_batches, vocabulary_path

CAPACITY = 2048
#: Rows of one length that get their numbers in one window task, about.
RANKED_AT_ONCE = 50_000
_SPECIAL = "<|endoftext|>"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full pieces, and a first one that may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


class ByteTokenizer:
    """ids of a byte-level BPE vocabulary: those of the tokenizers library, computed by tiktoken from the same ranks.

    The library itself takes the texts that tiktoken refuses.
    """

    def __init__(self, path: str | None = None):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path = path or vocabulary_path("byte_bpe_50k.json")
        with open(self.path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: len(ranks)})
        self.slow = None

    def library(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all") if _SPECIAL in text else self.fast.encode_ordinary(text)
        except BaseException as e:  # its pattern gives up on very long runs of white space, by an error or by a panic
            if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                raise
            return self.library(text)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for the pieces of every document's ids with end_id appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ByteTokenizer(path)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = array("I", encode(text.as_py() or ""))
                raw.append(end_id)
                raw = memoryview(raw.tobytes())
                for k, (s, n) in enumerate(cut(len(raw) // 4, capacity)):
                    rows.append((doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text_batches(spread(src)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Bins for ``counts[n]`` documents of each length n, as (lengths in the bin, number of such bins).

    A bin is filled greedily with the longest unpacked document that fits. Its smallest document then makes
    way for two unpacked ones if two fit the expanded gap and leave less of it. While the counts last, the next
    bins would come out the same, so they are made at once; the work depends on the lengths, not the documents.
    """
    left = np.asarray(counts, np.int64).copy()
    cap = len(left) - 1
    lengths = np.arange(cap + 1)
    bins = []
    while left.any():
        largest = np.maximum.accumulate(np.where(left > 0, lengths, 0))
        used: dict[int, int] = {}
        gap = cap
        while gap and (n := int(largest[gap])):
            take = min(gap // n, int(left[n]) - used.get(n, 0))
            if take:
                used[n] = used.get(n, 0) + take
                gap -= n * take
            if left[n] == used[n]:  # none of this length is left: look below it
                largest = np.maximum.accumulate(np.where((left > 0) & ~np.isin(lengths, [k for k, u in used.items() if u == left[k]]), lengths, 0))
        if gap:
            small = min(used)
            room = gap + small
            free = left.copy()
            for n, u in used.items():
                free[n] -= u
            first = np.flatnonzero(free[: room + 1] > 0)
            if len(first):
                below = np.maximum.accumulate(np.where(free > 0, lengths, 0))
                second = below[np.minimum(first, room - first)]
                alone = (second == first) & (free[first] < 2)
                second = np.where(alone, below[np.maximum(np.minimum(first, room - first) - 1, 0)], second)
                total = np.where(second > 0, first + second, 0)
                best = int(total.argmax())
                if total[best] > small:
                    used[small] -= 1
                    for n in (int(first[best]), int(second[best])):
                        used[n] = used.get(n, 0) + 1
                    used = {n: u for n, u in used.items() if u}
        times = min(int(left[n]) // u for n, u in used.items())
        for n, u in used.items():
            left[n] -= u * times
        bins.append(([n for n in sorted(used, reverse=True) for _ in range(used[n])], times))
    return bins


def slots(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, documents of that length in a bin, offset of the first) by ranges of slots."""
    rows, filled, seq = [], {}, 0
    for members, times in bins:
        offset = 0
        for n in sorted(set(members), reverse=True):
            k = members.count(n)
            lo = filled.get(n, 0)
            filled[n] = lo + k * times
            rows.append((n, lo, lo + k * times, seq, k, offset))
            offset += n * k
        seq += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Place of every piece of every document in sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents of more than ``capacity``
    ids are cut. The plan is made for the counts of the ``capacity`` possible lengths, which is all that reaches the
    driver; pieces of a length are numbered in salted windows and take that length's slots in order. Null
    and empty texts are the end id alone; repeated rows and null doc_ids are documents of their own; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, capacity, path), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():
        counts[n] = c
    plan = spark.createDataFrame(slots(best_two_fit(counts)), "length long, lo long, hi long, seq long, per long, base long")
    salts = int(counts.sum() // RANKED_AT_ONCE) + 1
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    nth = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("nth", nth).join(before, ["length", "salt"]).withColumn("slot", F.col("nth") + F.col("before"))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "plan_length")), (F.col("length") == F.col("plan_length")) & (F.col("slot") >= F.col("lo")) & (F.col("slot") < F.col("hi")))
    k = F.col("slot") - F.col("lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("seq") + F.floor(k / F.col("per"))).alias("sequence_id"),
        (F.col("base") + F.pmod(k, F.col("per")) * F.col("length")).alias("offset"),
    )
