"""Fuzzy repeated passages: shared k-mer seeds, collinear chains through a Fenwick tree, alignment of chains."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from ..session import bounded, discard, materialise, spread
from .common import fresh, text_batches, whole_groups

#: Words of a seed; seeds of a window of WINDOW neighbours of which the least hash is kept. Any stretch of
#: K + WINDOW - 1 equal words shares a kept seed, any of MIN_WORDS at least five.
K, WINDOW = 5, 8
#: A passage has so many words and so large a share of aligned words; a chain has so many seeds.
MIN_WORDS, SIMILARITY, MIN_SEEDS = 50, 0.8, 2
#: Cost of a word of distance between chained seeds, longest distance, and how far a passage grows past its seeds.
GAP_COST, MAX_GAP, MARGIN = 0.1, 64, 64
#: Of a window of MIN_WORDS equal words, the kept seeds at these offsets are the same wherever it stands: so far from
#: its ends, all neighbours that decide on them lie within it.
INNER = (WINDOW - 1, MIN_WORDS - K - WINDOW + 1)
#: So many documents that copy another are known to all tasks; more are joined.
COPIES = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def seeds_of(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """16-bit word codes of a whole text, and the hashes and word positions of its kept seeds.

    A seed that stands again in the text is given once more under its number there, so that runs of one word or
    line can match place by place, not only all with one place.
    """
    words = (text or "").encode().split()
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    codes = (h & np.uint64(0xFFFF)).astype("<u2").tobytes()
    if n < MIN_WORDS:
        return codes, np.empty(0, np.int64), np.empty(0, np.int32)
    g = h[: n - K + 1].copy()
    for j in range(1, K):
        g = g * _MIX + h[j : n - K + 1 + j]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    view = sliding_window_view(g, WINDOW)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    kept = g[at]
    order = np.argsort(kept, kind="stable")
    new = np.r_[True, np.diff(kept[order]) != 0]
    nth = np.arange(len(kept)) - np.maximum.accumulate(np.where(new, np.arange(len(kept)), 0))
    again = nth > 0
    numbered = kept[order][again] + nth[again].astype(np.uint64) * _MIX
    return codes, np.concatenate([kept, numbered]).view(np.int64), np.concatenate([at, at[order][again]]).astype(np.int32)


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [seeds_of(x) for x in texts]
            whole = [xxhash.xxh3_128_hexdigest(b" ".join((x or "").encode().split())) for x in texts]
            offsets = pa.array(np.cumsum([0] + [len(s) for _, s, _ in got]), pa.int32())
            seeds = pa.array(np.concatenate([s for _, s, _ in got] or [np.empty(0, np.int64)]))
            pos = pa.array(np.concatenate([p for *_, p in got] or [np.empty(0, np.int32)]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(whole, pa.string()), pa.array([c for c, *_ in got], pa.binary()), pa.ListArray.from_arrays(offsets, seeds), pa.ListArray.from_arrays(offsets, pos)],
                names=["doc", "whole", "codes", "seeds", "places"],
            )

    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    return text_batches(spread(src)).mapInArrow(run, "doc long, whole string, codes binary, seeds array<long>, places array<int>")


def chain_seeds(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of seed matches (sorted by x, then y), as index arrays; x and y rise strictly along a chain.

    The score of a chain is K for each seed less GAP_COST for each word of distance in either text. The best
    predecessor of a match, among those before it in both texts, is a prefix maximum over the ranks of y in a Fenwick
    tree. Chains are taken from the best end down, each match once, and parted where MAX_GAP is exceeded.
    """
    n = len(x)
    rank = np.unique(y, return_inverse=True)[1].tolist()
    size = max(rank) + 1
    tree_v, tree_i = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, prev = [0.0] * n, [-1] * n
    span = (GAP_COST * (x.astype(np.int64) + y)).tolist()
    xs, entered = x.tolist(), 0
    for i in range(n):
        while xs[entered] < xs[i]:  # matches further left may now be predecessors
            v, r = score[entered] + span[entered], rank[entered] + 1
            while r <= size:
                if v > tree_v[r]:
                    tree_v[r], tree_i[r] = v, entered
                r += r & -r
            entered += 1
        r = rank[i]  # ranks 0 .. r-1 lie before
        best, arg = float("-inf"), -1
        while r > 0:
            if tree_v[r] > best:
                best, arg = tree_v[r], tree_i[r]
            r &= r - 1
        gain = best - span[i]
        if gain > 0:
            score[i], prev[i] = K + gain, arg
        else:
            score[i] = K
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = prev[i]
        if len(path) >= MIN_SEEDS:
            path = np.array(path[::-1])
            far = np.flatnonzero((np.diff(x[path]) > MAX_GAP) | (np.diff(y[path]) > MAX_GAP)) + 1
            out += [p for p in np.split(path, far) if len(p) >= MIN_SEEDS]
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the seed matches of every document pair; rows come sorted by the pair."""
    rows = []
    for t in whole_groups(batches, "doc", "src"):
        doc, src, x, y = (t.column(c).to_numpy() for c in ("doc", "src", "x", "y"))
        order = np.lexsort((y, x, src, doc))
        doc, src, x, y = doc[order], src[order], x[order], y[order]
        cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(src) != 0)) + 1
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(doc)]):
            if e - s >= MIN_SEEDS:
                px, py = x[s:e], y[s:e]
                keep = np.r_[True, (np.diff(px) > 0) | (np.diff(py) > 0)]
                px, py = px[keep], py[keep]
                if len(px) >= MIN_SEEDS:
                    rows += [(int(doc[s]), int(src[s]), px[c], py[c]) for c in chain_seeds(px, py)]
            if len(rows) > 5000:
                yield _chain_batch(rows)
                rows = []
    if rows:
        yield _chain_batch(rows)


def _chain_batch(rows):
    lists = lambda i: pa.array([r[i] for r in rows], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), lists(2), lists(3)], names=["doc", "src", "xs", "ys"])


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short stretches."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (a == b).all():
        return len(a)
    row = np.zeros(len(b) + 1, np.int32)
    for w in a:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (b == w))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def _grown(eq: np.ndarray) -> tuple[int, int]:
    """How far to grow over equal (+1) and unequal (-2) words, and the equal ones among them."""
    if not len(eq):
        return 0, 0
    s = np.cumsum(np.where(eq, 1, -2))
    best = int(s.argmax())
    return (best + 1, int(eq[: best + 1].sum())) if s[best] > 0 else (0, 0)


def align_chain(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages (a_start, a_end, b_start, b_end, similarity) of a chain of seeds at xs in a and ys in b.

    Stretches between seeds are compared word by word on one diagonal, else by their longest common subsequence; a
    long stretch with few common words parts the chain. Ends grow on their diagonals. Similarity is the number of
    aligned equal words over the longer side.
    """
    parts, part = [], None
    for x, y in zip(xs.tolist(), ys.tolist()):
        if not (a[x : x + K] == b[y : y + K]).all():
            continue
        if part is not None:
            s, t, i, j, m = part
            if x < i or y < j:
                if x - i == y - j:
                    ext = x + K - i
                    if ext > 0:
                        part = [s, t, i + ext, j + ext, m + ext]
                continue
            ga, gb = a[i:x], b[j:y]
            same = int((ga == gb).sum()) if len(ga) == len(gb) else 0
            if len(ga) != len(gb) or 2 * same < len(ga):
                same = common_words(ga, gb)
            longest = max(len(ga), len(gb))
            if longest <= 8 or 2 * same >= longest:
                part = [s, t, x + K, y + K, m + same + K]
                continue
            parts.append(part)
        part = [x, y, x + K, y + K, K]
    if part is not None:
        parts.append(part)
    out = []
    for s, t, i, j, m in parts:
        n = min(s, t, MARGIN)
        left, got = _grown((a[s - n : s] == b[t - n : t])[::-1])
        s, t, m = s - left, t - left, m + got
        n = min(len(a) - i, len(b) - j, MARGIN)
        right, got = _grown(a[i : i + n] == b[j : j + n])
        i, j, m = i + right, j + right, m + got
        sim = m / max(i - s, j - t)
        if i - s >= MIN_WORDS and sim >= SIMILARITY:
            out.append((s, i, t, j, sim))
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        cols = [b.column(i) for i in range(b.num_columns)]
        for doc, src, xs, ys, a0, b0, a, c in zip(*cols):
            a0, b0 = a0.as_py(), b0.as_py()
            xs, ys = xs.values.to_numpy(), ys.values.to_numpy()
            for s, e, t, f, sim in align_chain(np.frombuffer(a.as_buffer(), "<u2"), np.frombuffer(c.as_buffer(), "<u2"), xs - a0, ys - b0):
                rows.append((doc.as_py(), s + a0, e + a0, src.as_py(), t + b0, f + b0, round(sim, 6)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds)], names=_PASSAGE_NAMES)


_PASSAGE_NAMES = ["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "similarity"]
_PASSAGE = "doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, similarity double"


def open_windows(places: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Starts of the windows of MIN_WORDS words that may stand earlier and aren't covered by spans.

    ``places`` are those of the kept seeds that an earlier document has. A window that stands earlier has all its
    inner seeds among them, of which the first WINDOW places hold one, the last too, and no gap is over WINDOW.
    """
    p, (lo, hi) = np.unique(places).astype(np.int64), INNER
    starts = np.unique(p[:, None] - np.arange(lo, lo + WINDOW))
    starts = starts[starts >= 0]
    if not len(starts):
        return starts
    first, last = np.searchsorted(p, starts + lo), np.searchsorted(p, starts + hi, side="right") - 1
    wide = np.concatenate([[0], np.cumsum(np.diff(p) > WINDOW)])
    ok = (first <= last) & (p[np.maximum(last, 0)] >= starts + hi - WINDOW + 1) & (wide[last] == wide[np.minimum(first, len(p) - 1)])
    starts = starts[ok]
    covered = np.zeros(int(p[-1]) + 2 * MIN_WORDS, np.int64)
    for s, e in spans:
        covered[s:e] = 1
    sums = np.concatenate([[0], np.cumsum(covered)])
    return starts[sums[starts + MIN_WORDS] - sums[starts] < MIN_WORDS]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each open window of a document, its start and the seeds at its first inner place."""
    for b in batches:
        rows = []
        for doc, places, seeds, spans in zip(*(b.column(c) for c in ("doc", "places", "seeds", "spans"))):
            p, h = places.values.to_numpy(), seeds.values.to_numpy()
            starts = open_windows(p, [(x["start_word"], x["end_word"]) for x in spans.as_py() or []])
            if len(starts):
                order = np.argsort(p, kind="stable")
                p, h, at = p[order], h[order], np.unique(p)
                first = at[np.searchsorted(at, starts + INNER[0])]
                for s, i, j in zip(starts.tolist(), np.searchsorted(p, first).tolist(), np.searchsorted(p, first, side="right").tolist()):
                    rows += [(doc.as_py(), s, x) for x in h[i:j].tolist()]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, (pa.int64(), pa.int32(), pa.int64()))], names=["doc", "start", "seed"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts and hashes of the windows of a document that have one of the given places as first inner place."""
    size = 2 * MIN_WORDS
    for b in batches:
        docs, at, hashes = [], [], []
        for doc, places, codes in zip(*(b.column(c) for c in ("doc", "places", "codes"))):
            text = codes.as_py()
            starts = np.unique(places.values.to_numpy().astype(np.int64)[:, None] - np.arange(INNER[0], INNER[0] + WINDOW))
            starts = starts[(starts >= 0) & (2 * starts + size <= len(text))].tolist()
            docs += [doc.as_py()] * len(starts)
            at += starts
            hashes += [xxhash.xxh3_128_digest(text[2 * s : 2 * s + size]) for s in starts]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at, pa.int32()), pa.array(hashes, pa.binary())], names=["doc", "start", "window"])


def _window_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the windows that a document shares with another on one diagonal, as far as they overlap; rows come sorted by the pair."""
    for t in whole_groups(batches, "doc", "src"):
        doc, src, x, y = (t.column(c).to_numpy().astype(np.int64) for c in ("doc", "src", "x", "y"))
        order = np.lexsort((x, y - x, src, doc))
        doc, src, x, y = doc[order], src[order], x[order], y[order]
        cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(src) != 0) | (np.diff(y - x) != 0) | (np.diff(x) > MIN_WORDS - K)) + 1
        rows = []
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(doc)]):
            xs = np.unique(np.r_[x[s:e], x[s:e] + MIN_WORDS - K])
            rows.append((int(doc[s]), int(src[s]), xs.astype(np.int32), (xs + y[s] - x[s]).astype(np.int32)))
        yield _chain_batch(rows)


def _align(chains: DataFrame, codes: DataFrame) -> DataFrame:
    def stretch(ends):
        lo = F.greatest(ends[0] - MARGIN, F.lit(0))
        return lo, lambda lo: F.substring("codes", 2 * lo + 1, 2 * (F.element_at(ends, -1) + K + MARGIN - lo))

    lo, piece = stretch(F.col("xs"))
    with_a = chains.join(codes, "doc").withColumn("a0", lo).withColumn("a", piece(F.col("a0"))).drop("codes")
    lo, piece = stretch(F.col("ys"))
    with_b = with_a.join(codes.withColumnRenamed("doc", "src"), "src").withColumn("b0", lo).withColumn("b", piece(F.col("b0")))
    return text_batches(with_b.select("doc", "src", "xs", "ys", "a0", "b0", "a", "b")).mapInArrow(_aligned, _PASSAGE)


def _codes(sketches: DataFrame, docs: DataFrame) -> DataFrame:
    return materialise(sketches.select("doc", "codes").join(docs, "doc", "left_semi").groupBy("doc").agg(F.min("codes").alias("codes")), "codes")


def _composed(sketches: DataFrame, shared: DataFrame, aligned: DataFrame) -> DataFrame | None:
    """Passages whose seeds have other first documents, so that no chain found them; None if nothing is open.

    Windows of MIN_WORDS words that no passage covers, and whose inner seeds all stand earlier, are linked to the first
    document that has the whole window. Where they can stand is known by their first inner seed.
    """
    spans = aligned.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans")).withColumnRenamed("doc_id", "doc")
    owned = shared.where("doc <> src").groupBy("doc").agg(F.collect_list("place").alias("places"), F.collect_list("seed").alias("seeds")).where(F.size("places") >= 4)
    open_ = materialise(text_batches(owned.join(spans, "doc", "left")).mapInArrow(_open, "doc long, start int, seed long"), "open")
    if not open_.limit(1).count():
        return None
    anchors = bounded(open_.select("seed").distinct(), label="anchors")
    hits = materialise(shared.join(anchors, "seed", "left_semi").groupBy("doc").agg(F.collect_set("place").alias("places")), "hits")
    codes = _codes(sketches, hits.select("doc"))
    windows = materialise(text_batches(hits.join(codes, "doc")).mapInArrow(_windows, "doc long, start int, window binary"), "windows")
    first = windows.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"), F.max("doc").alias("last")).where("first.doc < last")
    later = windows.join(open_.select("doc", "start").distinct(), ["doc", "start"], "left_semi")
    links = later.join(first, "window").where("first.doc < doc").select("doc", F.col("first.doc").alias("src"), F.col("start").alias("x"), F.col("first.start").alias("y"))
    chains = materialise(links.repartition("doc").sortWithinPartitions("doc", "src").mapInArrow(_window_chains, "doc long, src long, xs array<int>, ys array<int>"), "window_chains")
    return _align(chains, codes)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of a document that stand, exactly or nearly, in a document with a smaller doc_id.

    Returns doc_id, start_word, end_word (exclusive), source_doc_id, source_start, source_end, similarity:
    passages of MIN_WORDS words or more with a share of SIMILARITY or more aligned words. Each seed match links a
    document to the first document with that seed, so a passage in n documents gives about n rows, not n². Every window of
    MIN_WORDS equal words that stands earlier is covered, also where its seeds have other first documents (``_composed``). A text of
    the same words as an earlier one is one passage from its first word to its last, and its seeds are left out. Rows
    that share a doc_id count as one document (alignment takes the one whose codes sort first); null ids, null
    and short texts have no passages; other columns are ignored; an empty table gives an empty result.
    """
    sketches = materialise(_sketches(docs), "sketches")
    words = F.octet_length("codes") / 2
    texts = sketches.where(words >= MIN_WORDS).select("doc", "whole", words.cast("long").alias("n"))
    first = texts.groupBy("whole").agg(F.min("doc").alias("src"), F.max("doc").alias("last")).where("src < last")
    copies = texts.join(first, "whole").where("doc <> src").distinct()
    zero = F.lit(0).cast("long")
    copies = materialise(copies.select(F.col("doc").alias("doc_id"), zero.alias("start_word"), F.col("n").alias("end_word"), F.col("src").alias("source_doc_id"), zero.alias("source_start"), F.col("n").alias("source_end"), F.lit(1.0).alias("similarity")), "copies")
    fresh = sketches.select("doc", "seeds", "places").join(bounded(copies.select(F.col("doc_id").alias("doc")), COPIES), "doc", "left_anti")
    seeds = fresh.select("doc", F.inline(F.arrays_zip("seeds", "places"))).toDF("doc", "seed", "place")
    firsts = seeds.groupBy("seed").agg(F.min("doc").alias("src"), F.max("doc").alias("last")).where("src < last").select("seed", "src")
    shared = materialise(seeds.join(firsts, "seed"), "shared")
    origin = shared.where("doc = src").groupBy("seed").agg(F.min("place").alias("y"))
    matches = shared.where("doc <> src").join(origin, "seed").select("doc", "src", F.col("place").alias("x"), "y")
    chains = materialise(matches.repartition("doc").sortWithinPartitions("doc", "src").mapInArrow(_chains, "doc long, src long, xs array<int>, ys array<int>"), "chains")
    wanted = chains.select("doc").unionByName(chains.select(F.col("src").alias("doc"))).distinct()
    aligned = materialise(_align(chains, _codes(sketches, wanted)), "aligned")
    composed = _composed(sketches, shared, aligned)
    if composed is not None:
        aligned = aligned.unionByName(materialise(composed, "composed"))
    discard(shared)
    discard(sketches)
    return aligned.unionByName(copies)


_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the given half-open word spans and the white space after them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for s, e in sorted(spans):
        e = min(e, len(starts) - 1)
        if s < e and starts[e] > at:
            out.append(text[at : max(at, starts[s])])
            at = starts[e]
    return "".join(out) + text[at:]


def cut_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of their texts; rows without passages come back as they are."""
    doc, at = fresh(docs, "cut_doc"), fresh(docs, "cut_spans")
    spans = repeated_passages(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias(at)).withColumnRenamed("doc_id", doc)
    here = docs.join(spans, docs["doc_id"].cast("long") == F.col(doc), "left").drop(doc)

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        return pd.Series([without_spans(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(text, spans)], dtype=object)

    touched = text_batches(here.where(F.col(at).isNotNull())).withColumn("text", cut("text", at))
    return touched.unionByName(here.where(F.col(at).isNull())).select(docs.columns)
