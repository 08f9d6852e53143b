"""Near-duplicate documents by exact Jaccard similarity of word shingles: SimHash tries, prefix stars, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialise, spread
from .common import connected_components, release, text_batches, whole_groups
from .simhash_trie import majority_bits, near_links

#: Words of a shingle, and the least similarity of a pair as a fraction (numerator, denominator).
WIDTH, LEAST = 5, (4, 5)
#: Bits of a set's parity bitmap.
BITS = 1024
#: Documents whose shingles are counted for the order, and from how many of them on a shingle comes late in it. The
#: order only decides how many candidates there are, never which pairs are found.
SAMPLE, COMMON = 20_000, 10
#: Rows of a block: a token's rows beyond it are compared by pairs of blocks.
BLOCK_ROWS = 2048
#: Elements that a portion of pairs to verify may always send.
PORTION = 1 << 20
#: Heads up to which they are broadcast.
SENT = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words than a shingle is one, a wordless one none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z fold, only ASCII spaces split
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    n = len(words) - WIDTH + 1
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    g = h[:n].copy()
    for j in range(1, WIDTH):
        g = (g ^ (g >> np.uint64(29))) * _MIX + h[j : n + j]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    return np.unique(g)


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), len(s))).astype(np.int64))


def parity_bitmap(s: np.ndarray) -> bytes:
    """Parities of a set's elements by their lowest bits: two bitmaps differ in no more places than the sets do."""
    odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix(s: np.ndarray, late: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(t n) + 1 elements in the common order; two sets of similarity t or more share one of theirs."""
    if not len(s):
        return s
    p, q = LEAST
    common, counts = late
    rank = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, counts[at], 0)
    return s[np.lexsort((s, rank))][: len(s) + (-p * len(s)) // q + 1]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))


def _late(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are common in a sample of documents, and their numbers there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets or [np.empty(0, np.uint64)]).view(np.int64))], names=["tok"])

    texts = _texts(docs)
    share = min(1.0, SAMPLE / max(1, texts.count()))
    picked = texts.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("text")
    rows = text_batches(spread(picked)).mapInArrow(run, "tok long").groupBy("tok").count().where(F.col("count") >= COMMON).collect()
    tok = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tok)
    return tok[order], np.array([r[1] for r in rows], np.int64)[order]


def _sketches(docs: DataFrame, late) -> DataFrame:
    """doc, sid (which names its set), n, the set's SimHash, its bitmap and its prefix in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py()) for x in b.column(1)]
            first = [prefix(s, late) for s in sets]
            ends = pa.array(np.cumsum([0] + [len(x) for x in first]), pa.int32())
            toks = pa.array(np.concatenate(first or [np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([majority_bits(s) for s in sets], pa.uint64()).cast(pa.int64(), safe=False), pa.array([parity_bitmap(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(ends, toks)],
                names=["doc", "sid", "n", "fp", "bitmap", "toks"],
            )

    return text_batches(spread(_texts(docs))).mapInArrow(run, "doc long, sid long, n long, fp long, bitmap binary, toks array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets that ``wanted`` (sid, head) names, from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "hashes"])

    heads = wanted.select(F.col("head").alias("doc"))
    heads = F.broadcast(heads) if wanted.count() <= SENT else heads
    texts = _texts(docs).join(heads, "doc", "left_semi").select("text")
    found = text_batches(spread(texts)).mapInArrow(run, "sid long, hashes binary")
    return found.join(wanted.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.first("hashes").alias("hashes"))


def _may_match(na, nb, rest):
    """Whether sizes allow the similarity when at most ``rest`` elements are shared."""
    p, q = LEAST
    return (q * F.least(na, nb) >= p * F.greatest(na, nb)) & ((p + q) * rest >= p * (na + nb))


def _stars(marked: DataFrame) -> DataFrame:
    """Candidates sa, sb: for each token its hub with every set of another component.

    The hub is the set with the smallest share of its elements before the token in the common order: of near copies the
    one with the fewest elements of its own, which most others are nearest to.
    """
    hub = F.min(F.struct((F.col("place") / F.col("n")).alias("share"), "sid", "n", "place", "comp")).alias("hub")
    pairs = marked.join(marked.groupBy("tok").agg(hub), "tok").where(F.col("comp") != F.col("hub.comp"))
    # what two sets can still share from their first common token on bounds what they share at all
    rest = F.least(F.col("n") - F.col("place"), F.col("hub.n") - F.col("hub.place"))
    pairs = pairs.where(_may_match(F.col("n"), F.col("hub.n"), rest))
    return pairs.select(F.least("sid", "hub.sid").alias("sa"), F.greatest("sid", "hub.sid").alias("sb")).distinct()


def _dealt(marked: DataFrame) -> DataFrame:
    """The rows of tokens that two components or more share, dealt into tasks of bounded size.

    The rows of a token's largest component need no pairs among themselves. They make blocks, and so do all others; a
    task is a block of others with itself, with another such block, or with a block of the largest component.
    ``side`` parts the two blocks of a task (0 in a task of one block).
    """
    per = marked.groupBy("tok", "comp").count().groupBy("tok").agg(F.max(F.struct("count", "comp")).alias("main"), F.sum("count").alias("m")).where("main.count < m")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_ROWS))
    per = per.select("tok", F.col("main.comp").alias("main"), "m", blocks(F.col("main.count")).alias("mains"), blocks(F.col("m") - F.col("main.count")).alias("others"))
    rows = marked.join(per, "tok").withColumn("in_main", F.col("comp") == F.col("main"))
    count = F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sid"), count))
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("long").alias("side"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    zero, one, block = F.lit(0), F.lit(1), F.col("block")
    tasks = (
        F.when(F.col("m") <= BLOCK_ROWS, F.array(task("all", zero, zero, zero)))
        .when(F.col("in_main"), F.transform(upto(F.col("others")), lambda i: task("main", i, block, one)))
        .otherwise(
            F.concat(
                F.transform(upto(F.col("others")), lambda j: task("others", F.least(block, j), F.greatest(block, j), (block > j).cast("long"))),
                F.transform(upto(F.col("mains")), lambda j: task("main", block, j, zero)),
            )
        )
    )
    out = rows.select("tok", "sid", "comp", "n", "place", F.explode(tasks).alias("t"))
    return out.select(F.xxhash64("tok", "t.kind", "t.i", "t.j").alias("task"), "tok", "t.side", (F.col("t.i") != F.col("t.j")).alias("two") | (F.col("t.kind") == "main"), "sid", "comp", "n", "place").toDF("task", "tok", "side", "two", "sid", "comp", "n", "place")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets of different components that share a token and whose sizes and places allow the similarity."""
    p, q = LEAST
    out, found = [], 0

    def batch():
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["sa", "sb"])

    for t in whole_groups(batches, "task", "tok"):
        task, tok, side, two, sid, comp, n, place = (t.column(c).to_numpy() for c in ("task", "tok", "side", "two", "sid", "comp", "n", "place"))
        cuts = np.flatnonzero((np.diff(task) != 0) | (np.diff(tok) != 0)) + 1
        for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(task)].tolist()):
            for i in range(s, e - 1):
                j = slice(i + 1, e)
                low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                rest = np.minimum(n[i] - place[i], n[j] - place[j])
                ok = (comp[j] != comp[i]) & (q * low >= p * high) & ((p + q) * rest >= p * (n[i] + n[j]))
                if two[i]:
                    ok &= side[j] != side[i]
                to = sid[j][ok]
                if len(to):
                    out.append(np.stack([np.minimum(to, sid[i]), np.maximum(to, sid[i])], axis=1))
                    found += len(to)
                    if found > 100_000:
                        yield batch()
                        out, found = [], 0
    if out:
        yield batch()


def _similar(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sets, those similar enough; of pairs with their bitmaps, those that may be."""
    p, q = LEAST
    for b in batches:
        na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
        xs, ys = b.column("xa"), b.column("xb")
        if whole:
            sets = ((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(xs, ys))
            both = np.fromiter((len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets), np.int64, b.num_rows)
        else:
            bits = [np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in (xs, ys)]
            both = (na + nb - np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)) // 2
        yield b.filter(pa.array((p + q) * both >= p * (na + nb))).select(["sa", "sb", "ha", "hb", "na", "nb"])


_PAIR = "sa long, sb long, ha long, hb long, na long, nb long"


def _verified(docs: DataFrame, pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """src, dst: the heads of those candidate pairs whose similarity is LEAST or more."""
    a = heads.select(F.col("sid").alias("sa"), F.col("head").alias("ha"), F.col("n").alias("na"), F.col("bitmap").alias("xa"))
    b = heads.select(F.col("sid").alias("sb"), F.col("head").alias("hb"), F.col("n").alias("nb"), F.col("bitmap").alias("xb"))
    maybe = materialise(text_batches(pairs.join(a, "sa").join(b, "sb")).mapInArrow(lambda x: _similar(x, False), _PAIR), "maybe")
    ends = maybe.select(F.col("sa").alias("sid"), F.col("ha").alias("head"), F.col("na").alias("n")).unionByName(maybe.select(F.col("sb").alias("sid"), F.col("hb").alias("head"), F.col("nb").alias("n")))
    wanted = materialise(ends.distinct(), "wanted")
    release(docs)
    sets = materialise(_sets(docs, wanted), "sets")
    release(docs)
    links = None
    for part in _portions(maybe, wanted):
        joined = part.join(sets.toDF("sa", "xa"), "sa").join(sets.toDF("sb", "xb"), "sb")
        found = materialise(text_batches(joined).mapInArrow(lambda x: _similar(x, True), _PAIR).select(F.col("ha").alias("src"), F.col("hb").alias("dst")), "links")
        links = found if links is None else links.unionByName(found)
        release(docs)
    for x in (maybe, wanted, sets):
        discard(x)
    return links


def _portions(pairs: DataFrame, wanted: DataFrame) -> list[DataFrame]:
    """The pairs in so many portions, by a hash of one side, that a set sent with each pair makes no more in one of them than all sets once."""
    sent, once = pairs.agg(F.sum("na")).first()[0] or 0, wanted.agg(F.sum("n")).first()[0] or 0
    n = -(-sent // max(once, PORTION))
    if n <= 1:
        return [pairs]
    return [pairs.where(F.pmod(F.xxhash64("sa", "sb"), F.lit(n)) == i) for i in range(n)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows tok, sid, place sorted by tok and sid, those whose token another set has too, once each; one row is held over."""
    held, joined = None, False  # the last row so far, and whether the one before it has its token

    def give(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["tok", "sid", "place"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(i).to_numpy() for i in range(3)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        rows = [c[new] for c in rows]
        same = rows[0][1:] == rows[0][:-1]
        keep = np.append(joined, same) | np.append(same, False)
        yield give([c[:-1][keep[:-1]] for c in rows])
        held, joined = [c[-1:] for c in rows], bool(keep[-1])
    if joined:
        yield give(held)


def _marked(tokens: DataFrame, links: DataFrame) -> DataFrame:
    """Token rows with the component of their set, for what is linked so far."""
    part = materialise(connected_components(links, label="near"), "part")
    rows = tokens.join(part, tokens["head"] == part["node"], "left").select("tok", "sid", "n", "place", F.coalesce("component", "head").alias("comp"))
    out = materialise(rows, "marked")
    discard(part)
    release(out)
    return out


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc and component: every document's near-duplicate class by the smallest doc_id in it.

    Two documents are linked if the Jaccard similarity of their sets of WIDTH-word shingles is LEAST or more; a
    class is what links connect. Candidates come in three steps, and each is verified set by set:

    1. The binary-trie self-join of the sets' SimHash fingerprints (``simhash_trie``).
    2. For each shingle that prefixes share, the star of its hub (``_stars``): n near copies make about n rows.
    3. All pairs that share an element of their prefixes and are not in one class by then (``_dealt``).

    The third step makes the result whole: sets of that similarity differ in about ten bits of 64, and no trie's error
    budget is so wide and still selective. Sizes, places and parity bitmaps (all bounds, no estimates) rule candidates
    out before sets are compared. Equal sets are one whatever their number. Wordless texts are one class; rows without
    doc_id have none; rows that share a doc_id are one document, linked by any of their texts; other columns are
    ignored; an empty table gives an empty result.
    """
    release(docs)  # of the stages before
    sketches = materialise(_sketches(docs, _late(docs)), "near")
    release(docs)
    heads = materialise(sketches.groupBy("sid").agg(F.min("doc").alias("head"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bitmap").alias("bitmap")), "heads")
    same = materialise(sketches.select("doc", "sid").join(heads.select("sid", "head"), "sid").select(F.col("head").alias("src"), F.col("doc").alias("dst")), "same")
    # one row a token and set is dealt, once; sizes and heads are joined to the few tokens that sets share
    firsts = sketches.select("sid", "doc", "toks").join(heads.select("sid", F.col("head").alias("doc")), ["sid", "doc"], "left_semi")
    rows = firsts.select(F.posexplode("toks").alias("place", "tok"), "sid").select("tok", "sid", "place")
    shared = materialise(rows.repartition("tok").sortWithinPartitions("tok", "sid").mapInArrow(_shared, "tok long, sid long, place int"), "shared")
    release(docs)
    tokens = materialise(shared.join(heads.select("sid", "head", "n"), "sid").select("tok", "sid", "head", "n", F.col("place").cast("long").alias("place")), "tokens")
    discard(shared)
    discard(sketches)
    release(docs)
    prints = materialise(heads.groupBy("fp").agg(F.min("sid").alias("doc")), "prints")
    equal = heads.join(prints, "fp").where("sid <> doc").select("sid", "doc")
    trie = near_links(prints).toDF("sid", "doc").unionByName(equal)
    links = same.unionByName(_verified(docs, trie.select(F.least("sid", "doc").alias("sa"), F.greatest("sid", "doc").alias("sb")).distinct(), heads))
    marked = _marked(tokens, links)
    links = links.unionByName(_verified(docs, _stars(marked), heads))
    discard(marked)
    marked = _marked(tokens, links)
    pairs = _dealt(marked).repartition("task").sortWithinPartitions("task", "tok").mapInArrow(_candidates, "sa long, sb long").distinct()
    links = links.unionByName(_verified(docs, pairs, heads))
    part = connected_components(links, label="near")
    for x in (marked, tokens, prints, heads):
        discard(x)
    every = same.select(F.col("dst").alias("doc")).distinct()
    return every.join(part, every["doc"] == part["node"], "left").select("doc", F.coalesce("component", "doc").alias("component"))


def keep_one_per_near_class(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id names their near-duplicate class, with all their columns; null ids stay."""
    heads = near_duplicate_classes(docs).where("doc = component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.where("doc_id is null").unionByName(docs.where("doc_id is not null").join(heads, "doc_id", "left_semi").select(docs.columns))
