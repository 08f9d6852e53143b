"""Quality rules: base word rules, then robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import discard, materialise, spread
from .common import SPACES, text_batches

#: Fixed by the contract of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: The transformed statistics, as thousandths, and the least standard deviation of each: where a group's own is
#: smaller (a feature may be constant in it), this one stands in, so that no small departure makes an outlier.
FEATURES = ("z_words", "z_length", "z_symbols", "z_dup", "z_repeat")
FLOORS = (600.0, 60.0, 700.0, 1300.0, 1000.0)
#: Groups with fewer eligible documents are pooled: sources of one language first, then all that is left; if
#: that is still fewer, it is judged by the estimate of all documents.
MIN_GROUP = 50
#: Share of a group that the minimum-covariance-determinant subset holds.
SUBSET = 0.75
#: Largest condition number of a scatter matrix in units of its own deviations: one beyond it is drawn towards its diagonal.
CONDITION = 100.0
#: Chi-square probability beyond which a document is an outlier.
CONFIDENCE = 0.9999
#: Groups up to which their moments by distance step and their estimates are combined in one task: some hundred rows a group, less than
#: an ordinary partition holds. With more groups they are shuffled by group.
GATHERED = 256
P = len(FEATURES)
#: Directions are whole numbers of this length, so that their sums are exact.
SIGN = 10_000


def base_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) of a whole text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n - 2:
            seen = Counter(windows)
            last = -1  # last word already counted
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 2 - max(last, i - 1)
                    last = i + 2
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([base_stats(x.as_py()) for x in b.column(3)], np.int64).reshape(-1, len(STAT_COLUMNS))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(rows[:, i]) for i in range(rows.shape[1]))], names=["doc_id", "lang", "source", *STAT_COLUMNS])

    src = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return text_batches(spread(src)).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STAT_COLUMNS))


def _features(stats: DataFrame) -> DataFrame:
    c = F.col
    milli = lambda x: F.round(1000 * x).cast("long")
    return stats.withColumns(
        {
            "z_words": milli(F.log1p(c("n_words"))),
            "z_length": milli(F.log1p(c("word_chars") / F.greatest(c("n_words"), F.lit(1)))),
            "z_symbols": milli(F.log1p(1000 * c("n_symbols") / F.greatest(c("word_chars"), F.lit(1)))),
            "z_dup": milli(F.log1p(100 * c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)))),
            "z_repeat": milli(F.log1p(100 * c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)))),
        }
    )


def chi2_cdf(x: float, df: int) -> float:
    """Chi-square distribution function by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= h / k
        total += term
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def estimate(n: float, s1: np.ndarray, s2: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, inverse scatter and log-determinant from the moments of a subset that holds ``share`` of a group.

    Deviations under FLOORS are lifted to them. Then the matrix is drawn towards its diagonal by the least share that brings its
    condition number (in units of its deviations) to CONDITION, as a regularised determinant estimate does, so collinear features
    or few different points leave it positive definite; eigenvalues give the inverse and the determinant alike.
    """
    m = s1 / n
    cov = s2 / n - np.outer(m, m)
    cov *= share / chi2_cdf(chi2_quantile(share, P), P + 2) if share < 1 else 1
    cov += np.diag(np.maximum(np.square(FLOORS) - np.diag(cov), 0))
    scale = np.sqrt(np.diag(cov))
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    values = np.maximum(values, 0)
    over = values[-1] - CONDITION * values[0]
    rho = over / (over + CONDITION - 1) if over > 0 else 0.0
    values = (1 - rho) * values + rho
    inverse = (vectors / values) @ vectors.T / np.outer(scale, scale)
    return m, inverse, float(np.log(values).sum() + 2 * np.log(scale).sum())


def distance(z: list[Column], m: Column, p: Column) -> Column:
    """Squared Mahalanobis distance with centre m (array) and inverse scatter p (row-major array)."""
    d = [z[i] - m[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        total = total + p[i * P + i] * d[i] * d[i]
        for j in range(i):
            total = total + 2 * p[i * P + j] * d[i] * d[j]
    return total


def bucket_of(d2: Column) -> Column:
    """Distances in steps of a 32nd of a power of two; a subset takes whole steps, so its sums are one aggregate."""
    return F.floor(32 * F.log2(d2 + 1e-6)).cast("int")


_PARAM = "grp string, start int, m array<double>, p array<double>, logdet double"


def _solve(share: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = [(i, j) for i in range(P) for j in range(i, P)]
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                s2 = np.zeros((P, P))
                for (i, j), v in zip(upper, r.s2):
                    s2[i, j] = s2[j, i] = float(v)
                m, inv, det = estimate(float(r.n), np.array([float(v) for v in r.s1]), s2, share)
                rows.append((r.grp, r.start, m.tolist(), inv.ravel().tolist(), det))
            yield pd.DataFrame(rows, columns=["grp", "start", "m", "p", "logdet"])

    return run


def _solve_signs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Start 2: the inverse of the sign covariance, in the units of the features, about the medians."""
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            s2 = np.zeros((P, P))
            s2[np.triu_indices(P)] = [float(v) for v in r.s2]
            s2 = (s2 + np.triu(s2, 1).T) / max(r.n, 1) / SIGN**2 + np.eye(P) * 0.05
            scale = np.array(r.scale)
            rows.append((r.grp, 2, list(r.mid), (np.linalg.inv(s2) / np.outer(scale, scale)).ravel().tolist(), 1e308))
        yield pd.DataFrame(rows, columns=["grp", "start", "m", "p", "logdet"])


def _moments(z: list[Column]) -> list[Column]:
    s1 = [F.sum(x).alias(f"a{i}") for i, x in enumerate(z)]
    s2 = [F.sum(z[i] * z[j]).alias(f"b{i}_{j}") for i in range(P) for j in range(i, P)]
    return [F.count("*").alias("n"), *s1, *s2]


def _packed(df: DataFrame, *keys: str) -> DataFrame:
    s1 = F.array(*[f"a{i}" for i in range(P)])
    s2 = F.array(*[f"b{i}_{j}" for i in range(P) for j in range(i, P)])
    return df.select(*keys, "n", s1.alias("s1"), s2.alias("s2"))


def _starts(points: DataFrame, sizes: DataFrame, hint, together) -> DataFrame:
    """Three deterministic starts of every group: medians and quartile ranges, all moments, signs about the medians."""
    z = [F.col(c) for c in FEATURES]
    first = sizes.select("grp", F.lit(0).alias("start"), F.col("mid").alias("m"), F.array(*[1 / (F.col("scale")[i] * F.col("scale")[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]).alias("p"), F.lit(1e308).alias("logdet"))
    whole = _packed(together(points.groupBy("grp").agg(*_moments(z))).withColumn("start", F.lit(1)), "grp", "start").mapInPandas(_solve(1.0), _PARAM)
    unit = [(z[i] - F.col("mid")[i]) / F.col("scale")[i] for i in range(P)]
    length = F.greatest(F.sqrt(sum((u * u for u in unit[1:]), unit[0] * unit[0])), F.lit(1e-9))
    signs = points.join(hint(sizes), "grp").select("grp", *[F.round(SIGN * u / length).cast("long").alias(c) for u, c in zip(unit, FEATURES)])
    signs = together(signs.groupBy("grp").agg(*_moments(z))).join(hint(sizes.select("grp", "mid", "scale")), "grp")
    signs = _packed(signs, "grp", "mid", "scale").mapInPandas(_solve_signs, _PARAM)
    return first.unionByName(whole.withColumn("logdet", F.lit(1e308))).unionByName(signs)


def mcd(points: DataFrame) -> DataFrame:
    """Reweighted minimum-covariance-determinant estimate per group, over all points.

    ``points`` has grp and the integer FEATURES. From each of three starts, concentration steps follow: each takes the
    least distances that make up SUBSET of the group (rounded up to whole distance steps) and re-estimates from them,
    until its log-determinant falls no more; it falls in every other step and is bounded by FLOORS, so the steps end.
    A group keeps its estimate of least determinant. One last step takes all points within the 97.5 % ellipsoid.
    Moments are sums of integers, so the result does not depend on partitioning.
    """
    z = [F.col(c) for c in FEATURES]
    q = points.groupBy("grp").agg(F.count("*").alias("size"), *[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in FEATURES])
    scale = [F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(f)) for c, f in zip(FEATURES, FLOORS)]
    sizes = materialise(q.select("grp", F.ceil(F.col("size") * SUBSET).alias("need"), F.array(*[F.col(c)[1] for c in FEATURES]).alias("mid"), F.array(*scale).alias("scale")), "quartiles")
    groups = sizes.count()
    hint = F.broadcast if groups <= 20_000 else (lambda d: d)
    together = (lambda d: d.coalesce(1)) if groups <= GATHERED else (lambda d: d)
    cur = materialise(together(_starts(points, sizes, hint, together)).withColumn("fell", F.lit(True)), "mcd")
    while cur.where("fell").limit(1).count():
        near = points.join(hint(cur.where("fell").select("grp", "start", "m", "p")), "grp")
        near = together(near.groupBy("grp", "start", bucket_of(distance(z, F.col("m"), F.col("p"))).alias("bucket")).agg(*_moments(z)))
        order = W.partitionBy("grp", "start").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        near = near.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).join(hint(sizes.select("grp", "need")), "grp").where("before < need")
        sums = near.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in near.columns if c == "n" or c[0] in "ab" and c[1:2].isdigit()])
        new = together(_packed(sums, "grp", "start").mapInPandas(_solve(SUBSET), _PARAM)).toDF("grp", "start", "m2", "p2", "det2")
        fell = F.coalesce(F.col("det2") < F.col("logdet") - 1e-9, F.lit(False))
        pick = lambda a, b: F.when(fell, F.col(b)).otherwise(F.col(a)).alias(a)
        nxt = materialise(together(cur).drop("fell").join(new, ["grp", "start"], "left").select("grp", "start", pick("m", "m2"), pick("p", "p2"), pick("logdet", "det2"), fell.alias("fell")), "mcd")
        discard(cur)
        cur = nxt
    best = together(cur).groupBy("grp").agg(F.min_by(F.struct("m", "p"), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    inside = points.join(hint(best), "grp").where(distance(z, F.col("m"), F.col("p")) <= chi2_quantile(0.975, P)).groupBy("grp").agg(*_moments(z))
    out = materialise(_packed(together(inside).withColumn("start", F.lit(0)), "grp", "start").mapInPandas(_solve(0.975), _PARAM).drop("start"), "mcd")
    for x in (cur, sizes):
        discard(x)
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """Statistics and verdict for every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    distance2. A document fails the base rules under MIN_WORDS words or with over half its words in
    repeated 3-word windows; null and empty texts have zero words. The others are grouped by language and
    source (null is a value of its own), small groups pooled, and rejected when their transformed statistics lie
    beyond the CONFIDENCE ellipsoid of the group's robust estimate; where the last pool has fewer than MIN_GROUP
    documents, its estimate is that of all documents. Where even all of them are fewer, none is rejected: so little tells
    no outlier. Groups of few different points or collinear features are judged like any other, by a regularised scatter.
    Repeated rows count each; other columns are ignored; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialise(_features(document_stats(docs)).withColumn("base_failed", failed), "stats")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    fine = stats.select("lang", "source").where("not base_failed").groupBy("lang", "source").count()
    fine = fine.select(F.concat(name("lang"), F.lit("\x1f"), name("source")).alias("fine"), name("lang").alias("lang"), "count")
    own = F.col("count") >= MIN_GROUP
    pooled = F.sum(F.when(~own, F.col("count"))).over(W.partitionBy("lang"))
    levels = fine.withColumn("pooled", pooled).select("fine", F.when(own, F.concat(F.lit("s"), "fine")).when(F.col("pooled") >= MIN_GROUP, F.concat(F.lit("l"), "lang")).otherwise("all").alias("grp"), "count")
    levels = materialise(levels, "levels")
    rest, every = levels.agg(F.coalesce(F.sum(F.when(F.col("grp") == "all", F.col("count"))), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    hint = F.broadcast if levels.count() <= 20_000 else (lambda d: d)
    keyed = stats.withColumn("fine", F.concat(name("lang"), F.lit("\x1f"), name("source"))).join(hint(levels.select("fine", "grp")), "fine", "left")
    judged = keyed.where("not base_failed").select("grp", *FEATURES)
    if 0 < rest < MIN_GROUP:
        judged = judged.where("grp <> 'all'").unionByName(judged.withColumn("grp", F.lit("all")))
    points = materialise(judged, "points")
    fit = mcd(points)
    hint = F.broadcast if fit.count() <= 20_000 else (lambda d: d)
    out = keyed.join(hint(fit), "grp", "left")
    d2 = F.when(~F.col("base_failed"), distance([F.col(c) for c in FEATURES], F.col("m"), F.col("p")))
    out = out.withColumn("distance2", d2)
    kept = ~F.col("base_failed") & (F.lit(every < MIN_GROUP) | F.coalesce(F.col("distance2") <= chi2_quantile(CONFIDENCE, P), F.lit(True)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Rows that share a doc_id are kept when any of them is; rows without doc_id cannot be told apart and are kept.
    """
    good = quality_rules(docs).where("kept").select("doc_id").distinct()
    return docs.where("doc_id is null").unionByName(docs.where("doc_id is not null").join(good, "doc_id", "left_semi").select(docs.columns))
