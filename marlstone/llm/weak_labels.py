"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache
from math import log
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialise, spread
from .common import text_batches
from .quality_rules import base_stats

#: Votes: 0 abstains, 1 says bad, 2 says good. Each labeller has a bound for either vote on one statistic.
LABELLERS = ("symbols", "repeats", "lines", "length", "capitals", "variety", "endings", "marked")
EM_STEPS = 200
#: The scorer is fitted on at most so many documents, those of the least hash of text (equal texts once), each with its posterior.
TRAIN_DOCS = 20_000
BUCKETS = 1 << 16
EPOCHS, RATE, DECAY = 60, 0.5, 1e-6
#: Distinct words whose features a worker remembers.
MEMO_WORDS = 300_000
KEEP_FROM = 0.5


#: A word with one of the base rules' symbols.
_MARKED = re.compile(r"[^\s#*$%&|<>]*[#*$%&|<>]\S*")


@cache
def _letters() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 more if it is upper case."""
    every = map(chr, range(sys.maxunicode + 1))
    return np.fromiter((c.isalpha() + 2 * c.isupper() for c in every), np.uint8, sys.maxunicode + 1)


def letters_of(text: str) -> tuple[int, int]:
    """Letters and upper-case characters of a whole text."""
    kinds = np.bincount(_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=4)
    return int(kinds[1] + kinds[3]), int(kinds[2] + kinds[3])


def votes(text: str | None) -> int:
    """The votes of all labellers as digits of a number to base 3, the first labeller the lowest."""
    text = text or ""
    n, chars, symbols, dup, repeated, lines = base_stats(text)
    if not n:
        return 1  # an empty text has its first labeller against it
    words = text.split()
    letters, upper = letters_of(text)
    ended = sum(x.rstrip().endswith((".", "!", "?", ":", ";")) for x in text.split("\n"))

    def vote(x, bad, good):
        low = bad < good
        return 1 if (x <= bad if low else x >= bad) else 2 if (x >= good if low else x <= good) else 0

    mean = chars / n
    out = (
        vote(symbols / chars, 0.04, 0.005),
        vote(repeated / n, 0.5, 0.05) if n >= 20 else 0,
        vote(dup / lines, 0.6, 0.05) if lines >= 3 else 0,
        vote(abs(mean - 5.1), 1.6, 0.7) if n >= 20 else 0,
        vote(upper / max(letters, 1), 0.5, 0.15),
        vote(log(len(set(words))) / log(n), 0.7, 0.85) if n >= 50 else 0,
        vote(ended / lines, 0.1, 0.6),
        vote(len(_MARKED.findall(text)) / n if symbols else 0.0, 0.2, 0.03),
    )
    return sum(v * 3**i for i, v in enumerate(out))


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, float, np.ndarray]:
    """Vote probabilities [labeller, class, vote], share of good documents, and the posterior of each pattern.

    Votes are independent given the class (bad 0, good 1); who abstains says nothing (its probability is 1). A
    document that any labeller calls bad starts as bad; each step takes the expected classes and re-estimates
    what every labeller says of either, with one added count so that no probability is zero.
    """
    m = len(LABELLERS)
    v = (patterns[:, None] // 3 ** np.arange(m)) % 3
    post = np.where((v == 1).any(1), 0.1, np.where((v == 2).any(1), 0.9, 0.5))
    theta, good = np.ones((m, 2, 3)), 0.5
    for _ in range(steps):
        before = post
        w = np.stack([counts * (1 - post), counts * post])
        for i in range(m):
            for k in (1, 2):
                theta[i, :, k] = w[:, v[:, i] == k].sum(1) + 1
            theta[i, :, 1:] /= theta[i, :, 1:].sum(1, keepdims=True)
        good = (w[1].sum() + 1) / (counts.sum() + 2)
        log = np.log([1 - good, good])[:, None] + sum(np.log(theta[i][:, v[:, i]]) for i in range(m))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(post - before).max(initial=0) < 1e-9:
            break
    return theta, float(good), post


_SHAPE = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))


def shape(word: str) -> str:
    """A word's case and punctuation: letters become a, A or Aa, digits 0, other characters stay."""
    s = _SHAPE[0].sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a", word)
    return _SHAPE[1].sub("0", s)


class Hasher:
    """Hashed features of a text: its words, their shapes, immediate repeats, and repeats anywhere."""

    def __init__(self):
        self.memo: dict[str, int] = {}  # slots of word and shape in one number
        self.special = [self._slot(f"\x00{n}") for n in ("twice running", "seen before", "always")]

    @staticmethod
    def _slot(s: str) -> int:
        return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) % BUCKETS

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values (square roots of shares, of length one together)."""
        words = (text or "").split()
        n = len(words)
        if not n:
            return np.array([self.special[2]]), np.array([1.0], np.float32)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self._slot(w) * BUCKETS + self._slot("\x00" + shape(w))
        got = np.fromiter(map(memo.__getitem__, words), np.int64, n)
        running = sum(map(eq, words, words[1:]))
        slots, count = np.unique(np.concatenate([got // BUCKETS, got % BUCKETS]), return_counts=True)
        slots = np.r_[slots, self.special]
        count = np.r_[count, running, n - len(set(words)), n]
        value = np.sqrt(count / n).astype(np.float32)
        return slots, value / np.sqrt((value**2).sum())


def fit_scorer(slots: list[np.ndarray], values: list[np.ndarray], soft: np.ndarray) -> np.ndarray:
    """Weights (the last one the intercept) of a logistic model with soft labels, by AdaGrad over the whole sample."""
    w = np.zeros(BUCKETS + 1)
    if not len(soft):
        return w
    col, val = np.concatenate(slots), np.concatenate(values).astype(float)
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    weight = np.where(soft >= 0.5, 0.5 / max((soft >= 0.5).mean(), 1e-3), 0.5 / max((soft < 0.5).mean(), 1e-3))
    grad2 = np.full(BUCKETS + 1, 1e-8)
    for _ in range(EPOCHS):
        z = np.bincount(row, val * w[col], len(soft)) + w[-1]
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) / len(soft)
        g = np.append(np.bincount(col, val * e[row], BUCKETS), e.sum()) + DECAY * w
        grad2 += g * g
        w -= RATE * g / np.sqrt(grad2)
    return w


def classify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Posterior and score of the quality of every document.

    Returns doc_id, votes (number to base 3), posterior (probability of good from the labellers), score (of
    the linear model) and kept (score of KEEP_FROM or more). All documents vote and all votes are in the
    estimate, of which only the counts of the 3^8 possible patterns reach the driver; the linear model is fitted on
    at most ``train_docs`` different texts. Null and empty texts count as bad by the first labeller and have one constant
    feature; repeated rows and null doc_ids are documents of their own; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([votes(x.as_py()) for x in b.column(1)], pa.int64())], names=["doc_id", "votes"])

    voted = materialise(text_batches(spread(src)).mapInArrow(vote, "doc_id long, votes long"), "votes")
    tally = sorted(voted.groupBy("votes").count().collect())
    patterns, counts = np.array([r[0] for r in tally], np.int64), np.array([r[1] for r in tally], float)
    _, _, post = fit_labellers(patterns, counts)
    posterior = dict(zip(patterns.tolist(), post.tolist()))
    total = counts.sum()

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            got = [(hasher(t.as_py()), posterior[votes(t.as_py())]) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s.astype(np.int32) for (s, _), _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for (_, v), _ in got], pa.list_(pa.float32())), pa.array([p for _, p in got], pa.float64())],
                names=["h", "slots", "vals", "soft"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, values, soft, key = [], [], [], []
        for b in batches:
            slots += [x.values.to_numpy() for x in b.column(1)]
            values += [x.values.to_numpy() for x in b.column(2)]
            soft += b.column(3).to_pylist()
            key += b.column(0).to_pylist()
        order = np.argsort(key)  # whatever order the rows came in
        w = fit_scorer([slots[i] for i in order], [values[i] for i in order], np.array([soft[i] for i in order]))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    share = min(1.0, 0.9 * train_docs / max(total, 1))
    hashed = src.select(F.xxhash64("text").alias("h"), "text").where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = text_batches(hashed.dropDuplicates(["h"])).mapInArrow(sample, "h long, slots array<int>, vals array<float>, soft double")
    weights = chosen.limit(train_docs).repartition(1).mapInArrow(fit, "w binary").collect() if total else []
    w = spark.sparkContext.broadcast(np.frombuffer(weights[0][0]) if weights else np.zeros(BUCKETS + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, weight = Hasher(), w.value
        for b in batches:
            z = []
            for x in b.column(1):
                slots, values = hasher(x.as_py())
                z.append(float(weight[slots] @ values) + weight[-1])
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            v = [votes(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(v, pa.int64()), pa.array(np.round([posterior[k] for k in v], 6)), pa.array(np.round(s, 6)), pa.array(s >= KEEP_FROM)],
                names=["doc_id", "votes", "posterior", "score", "kept"],
            )

    return text_batches(spread(src)).mapInArrow(score, "doc_id long, votes long, posterior double, score double, kept boolean")
