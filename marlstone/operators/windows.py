"""Ranking, running totals, gaps and islands, top-k, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def rank_hits(hits: DataFrame, by: list[str], score: str = "score", tie: str = "chunk_id") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie)))


def run_bounds(events: DataFrame) -> DataFrame:
    """First and last event of each run: one aggregate, no window."""
    return events.groupBy("run_id").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("type", "seq").alias("first_type"), F.max_by("type", "seq").alias("last_type"), F.min_by("event_id", "seq").alias("first_event"), F.max_by("event_id", "seq").alias("last_event")
    )


def latest_by(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def best_first(rows: DataFrame, keys: list[str], rank: Column, order: str) -> DataFrame:
    """The row of the highest rank per key, the first of equals."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(rank.desc(), order))).where("nth = 1").drop("nth")


def first_occurrence_units(hits: DataFrame) -> DataFrame:
    """Units ranked by where their best chunk ranks."""
    first = hits.groupBy("query_id", "unit").agg(F.min("rank").alias("best"))
    return first.select("query_id", "unit", F.row_number().over(W.partitionBy("query_id").orderBy("best", "unit")).alias("rank"))


def per_document_cap(hits: DataFrame, cap: int, most: int, least: int) -> DataFrame:
    """In rank order at most ``cap`` chunks of a judgment (statutes uncapped), ``most`` in all, rank order kept.

    If fewer than ``least`` are picked, the capped-out chunks fill up to ``least`` in rank order.
    """
    nth = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("rank"))
    marked = hits.withColumn("fits", (F.col("kind") == "statute") | (nth <= cap))
    order = W.partitionBy("query_id").orderBy(F.col("fits").desc(), "rank")
    ranked = marked.withColumn("place", F.row_number().over(order)).withColumn("fitting", F.sum(F.col("fits").cast("int")).over(W.partitionBy("query_id")))
    size = F.least(F.lit(most), F.greatest("fitting", F.lit(least)))
    return ranked.where(F.col("place") <= size).drop("fits", "place", "fitting")


def budget_prefix(terms: DataFrame, budget: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The rarest terms while their running frequency stays in the budget; stops at the first overflow."""
    w = W.partitionBy(*by).orderBy("df", "term").rowsBetween(W.unboundedPreceding, 0)
    return terms.withColumn("running", F.sum("df").over(w)).where(F.col("running") <= budget).drop("running")


def char_budget(rows: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """A prefix of rows whose running size stays within ``most``; the first is always kept."""
    w = W.partitionBy(by).orderBy(order)
    out = rows.withColumn("nth", F.row_number().over(w)).withColumn("running", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.where((F.col("nth") == 1) | (F.col("running") <= most)).drop("nth", "running")


def passage_pack(rows: DataFrame, by: str, priority: str, size: str, place: str, most: int) -> DataFrame:
    """Greedy packing by priority that skips what does not fit, then reading order.

    Which row fits depends on all before it, so it is one fold over a group's (priority, size) array: groups
    are the passages of one document, a bounded set.
    """
    items = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(priority).alias("p"), F.col(place).alias("at"), F.col(size).cast("long").alias("n")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<at:bigint,n:bigint>>").alias("kept"))

    def step(acc, x):
        fits = acc.total + x.n <= most
        kept = F.concat(acc.kept, F.array(F.struct(x.at.cast("long").alias("at"), x.n.alias("n"))))
        return F.struct(F.when(fits, acc.total + x.n).otherwise(acc.total).alias("total"), F.when(fits, kept).otherwise(acc.kept).alias("kept"))

    packed = items.select(by, F.aggregate("items", start, step).alias("acc"))
    return packed.select(by, F.posexplode(F.array_sort("acc.kept")).alias("nth", "k")).select(by, "nth", F.col("k.at").alias(place), F.col("k.n").alias(size))


def islands(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Runs of consecutive integers per group: first, last and length."""
    d = rows.select(by, value).distinct().withColumn("island", F.col(value) - F.row_number().over(W.partitionBy(by).orderBy(value)))
    return d.groupBy(by, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("length")).drop("island")


def longest_sequential_run(rows: DataFrame, by: str, value: str) -> DataFrame:
    return islands(rows, by, value).groupBy(by).agg(F.max("length").alias("longest"))


def event_gap(events: DataFrame, speed: float, cap: float) -> DataFrame:
    """Seconds to wait before each event of a run in a replay: non-negative, divided by the speed, capped; first 0."""
    w = W.partitionBy("run_id").orderBy("seq")
    secs = F.col("ts_us") - F.lag("ts_us").over(w)
    return events.withColumn("delay", F.least(F.lit(cap), F.greatest(F.lit(0.0), F.coalesce(secs, F.lit(0)) / 1e6) / speed))


def neighbours(rows: DataFrame, by: str, order: str, value: str, n: int = 1) -> DataFrame:
    w = W.partitionBy(by).orderBy(order)
    return rows.withColumn("before", F.lag(value, n).over(w)).withColumn("after", F.lead(value, n).over(w))


def dedupe_scan(scan: DataFrame) -> DataFrame:
    """One row per path: the copy whose archive year is the path's year, then the least archive."""
    right = (F.col("archive_year") == F.col("path_year")).cast("int")
    return best_first(scan, ["path"], right, "archive_year")


def wall_clock(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("seconds"))


# ---- order, top-k, samples ----


def topk_score(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "chunk_id").limit(k)


def candidate_cap(hits: DataFrame, cap: int) -> DataFrame:
    """A bounded candidate set, the same at every run."""
    return hits.orderBy("chunk_id").limit(cap)


def nulls_last_order(rows: DataFrame, date: str, tie: str) -> DataFrame:
    return rows.orderBy(F.col(date).desc_nulls_last(), tie)


def max_terms(terms: DataFrame, n: int) -> DataFrame:
    return terms.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("idf"), "term"))).where(F.col("nth") <= n).drop("nth")


def objection_topk(objections: DataFrame, n: int) -> DataFrame:
    """The n most severe objections of a run, ties by issue and position."""
    w = W.partitionBy("run_id").orderBy(F.desc("severity"), "issue_id", "position_id", "objection_id")
    return objections.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def target_strength_sort(claims: DataFrame, answered: DataFrame, side: str) -> DataFrame:
    """Opposing claims that nobody has answered, strongest first."""
    return claims.where(F.col("side") != side).join(answered.select("claim_id"), "claim_id", "left_anti").orderBy(F.desc("strength"), "claim_id")


def hash_order(key: Column, seed: int) -> Column:
    """A stable pseudo-random order: MD5 of the seed and the key (any engine can repeat it)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_sample(pool: DataFrame, selected: int, fraction: float, least: int, key: str, seed: int) -> DataFrame:
    """max(least, round-half-up(fraction * selected)) rows of a pool in seeded order."""
    n = max(least, int(fraction * selected + 0.5))
    return pool.orderBy(hash_order(F.col(key), seed), key).limit(n)


def seeded_shuffle(rows: DataFrame, key: str, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("place", F.row_number().over(w))


def balanced_sample(rows: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """n // 2 rows of each label in seeded order."""
    w = W.partitionBy(label).orderBy(hash_order(F.col(key), seed), key)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n // 2).drop("nth")


def hard_negative_sample(positives: DataFrame, negatives: DataFrame, case: str, key: str, n: int, seed: int) -> DataFrame:
    """n negatives: those of the positives' own cases first, then the rest, in seeded order."""
    own = positives.select(case).distinct().withColumn("own", F.lit(1))
    ranked = negatives.join(own, case, "left")
    return ranked.orderBy(F.col("own").desc_nulls_last(), hash_order(F.col(key), seed), key).limit(n).drop("own")


def size_guard(rows: DataFrame, rules: list, low: int, high: int) -> tuple[DataFrame, int]:
    """Apply rules (frame -> frame) one after another until the count is within bounds; the last rule if none is."""
    out = rows
    for i, rule in enumerate(rules):
        out = rule(rows)
        if low <= out.count() <= high:
            return out, i
    return out, len(rules) - 1


# ---- sets ----


def union_lists(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def set_recall(found: Column, wanted: Column) -> Column:
    """Share of the wanted set that was found; null if nothing is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(found, wanted)) / F.size(F.array_distinct(wanted)))


def ordered_distinct(values: Column) -> Column:
    return F.array_distinct(values)


def merge_evidence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two evidence lists by chunk; the issues of both, the first list's first."""
    j = a.select("chunk_id", F.col("issue_ids").alias("x")).join(b.select("chunk_id", F.col("issue_ids").alias("y")), "chunk_id", "full_outer")
    none = F.array().cast("array<string>")
    return j.select("chunk_id", F.array_union(F.coalesce("x", none), F.coalesce("y", none)).alias("issue_ids"))
