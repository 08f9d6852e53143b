"""Aggregations: document frequencies, linked cases, alias and majority tables, reports, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def lexeme_df(postings: DataFrame) -> DataFrame:
    """Number of chunks with each lexeme; postings have one row for a chunk and lexeme."""
    return postings.groupBy("lexeme").agg(F.count("*").alias("ndoc"))


def chunks_per_doc(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))


def natural_sort(values: Column) -> Column:
    """Sort labels by their first number, then as text; labels without a number come last."""
    key = F.transform(values, lambda v: F.struct(F.coalesce(F.try_element_at(F.regexp_extract_all(v, F.lit(r"(\d+)"), F.lit(1)), F.lit(1)).cast("long"), F.lit((1 << 62))).alias("n"), v.alias("v")))
    return F.transform(F.array_sort(key), lambda s: s.v)


def linked_cases(edges: DataFrame, key: str) -> DataFrame:
    """Per linked document: citations, distinct paragraphs (natural order), treatments and resolutions, nulls dropped."""
    return edges.groupBy(F.col(key).alias("linked")).agg(
        F.count("*").alias("citations"),
        natural_sort(F.collect_set(F.col("source_para").cast("string"))).alias("paragraphs"),
        F.array_sort(F.collect_set("treatment")).alias("treatments"),
        F.array_sort(F.collect_set("resolution")).alias("resolutions"),
    )


def citing_cases(edges: DataFrame, doc) -> DataFrame:
    return linked_cases(edges.where(F.col("target_ref") == doc), "source_doc_id")


def cited_cases(edges: DataFrame, doc) -> DataFrame:
    return linked_cases(edges.where(F.col("source_doc_id") == doc), "target_ref")


def cases_citing_section(edges: DataFrame, section) -> DataFrame:
    return linked_cases(edges.where(F.col("target_section_id") == section), "source_doc_id")


def majority_target(edges: DataFrame) -> DataFrame:
    """Most frequent target of each canonical citation, conflicts excluded, ties to the least target."""
    ok = edges.where(~F.col("resolution").eqNullSafe("conflict") & F.col("target_ref").isNotNull())
    n = ok.groupBy("canonical", "target_ref").agg(F.count("*").alias("n"))
    best = W.partitionBy("canonical").orderBy(F.desc("n"), "target_ref")
    return n.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def alias_table(learnt: DataFrame) -> DataFrame:
    """Aliases with exactly one target, and how often they were seen; ``learnt`` has alias, target_ref."""
    return learnt.groupBy("alias").agg(F.min("target_ref").alias("target_ref"), F.max("target_ref").alias("last"), F.count("*").alias("evidence")).where("target_ref = last").drop("last")


def ambiguous_aliases(learnt: DataFrame) -> DataFrame:
    few = learnt.groupBy("alias").agg(F.min("target_ref").alias("a"), F.max("target_ref").alias("b")).where("a <> b")
    return few.agg(F.count("*").alias("ambiguous"))


def cited_by_count(edges: DataFrame, core: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Core documents that cite each document outside the core, at least ``least``; the ``most`` most cited."""
    pairs = edges.join(core.select(F.col("doc_id").alias("source_doc_id")), "source_doc_id", "left_semi").join(core.select(F.col("doc_id").alias("target_ref")), "target_ref", "left_anti").select("source_doc_id", "target_ref").distinct()
    n = pairs.groupBy("target_ref").agg(F.count("*").alias("cited_by")).where(F.col("cited_by") >= least)
    return n.orderBy(F.desc("cited_by"), "target_ref").limit(most) if most else n


def strict_majority(votes: DataFrame, key: str, value: str) -> DataFrame:
    """The value that more than half the votes of a key have, else null; and whether votes disagree."""
    n = votes.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.sum("n").alias("votes"), F.max(F.struct("n", value)).alias("top"), F.count("*").alias("values")).select(
        key, F.when(F.col("top.n") * 2 > F.col("votes"), F.col(f"top.{value}")).alias(value), "votes", (F.col("values") > 1).alias("disagree")
    )


def resolution_rates(edges: DataFrame, routes: list[str]) -> DataFrame:
    """Per reporter: citations, resolved, in the corpus, and by route."""
    return edges.groupBy("reporter").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("target_ref").isNotNull()).alias("resolved"),
        F.count_if(F.col("target_doc_id").isNotNull()).alias("in_corpus"),
        *[F.count_if(F.col("resolution") == r).alias(f"by_{r}") for r in routes],
    )


def size_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, median, 90th and 99th percentile and maximum."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), q.alias("q"), F.max(value).alias("max")).select(*by, "n", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p99"), "max")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return rows.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def sum_counters(rows: DataFrame, counters: str) -> DataFrame:
    """Totals of a map column of counters over all rows."""
    return rows.select(F.explode(counters).alias("counter", "n")).groupBy("counter").agg(F.sum("n").alias("total"))


def by_era(rows: DataFrame, year: str, *aggs: Column) -> DataFrame:
    """Aggregates by decade."""
    return rows.groupBy((F.floor(F.col(year) / 10) * 10).alias("era")).agg(*aggs)


def coverage(rows: DataFrame, fields: list[str], by: str) -> DataFrame:
    """Share of rows per group in which each field is neither null nor empty, one row for a group and field."""
    shares = [F.avg(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1.0).otherwise(0.0)).alias(f) for f in fields]
    wide = rows.groupBy(by).agg(*shares)
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return wide.selectExpr(by, f"stack({len(fields)}, {pairs}) as (field, share)")


def repeated_edge_lines(lines: DataFrame, share: float = 0.3, least: int = 3) -> DataFrame:
    """Digit-normalised lines that stand on at least max(least, ceil(share * pages)) pages of their document.

    ``lines`` has doc_id, page, line (already the lines at page edges).
    """
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim("line")), r"\d+", "#"), r"\s+", " ")
    keyed = lines.select("doc_id", "page", key.alias("key")).where("key <> ''").distinct()
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    n = keyed.groupBy("doc_id", "key").agg(F.count("*").alias("on_pages"))
    return n.join(pages, "doc_id").where(F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).select("doc_id", "key", "on_pages")


def vocabulary(text: Column) -> Column:
    """Distinct lower-case words of two or more basic letters."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{2,})"), F.lit(1))))


#: Strength of a verification result; the better one wins.
STATUS_RANK = {"verified": 3, "weak": 2, "unsupported": 1, "invalid": 0}


def status_rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in STATUS_RANK.items():
        out = F.when(status == name, F.lit(rank)).otherwise(out)
    return out


def claim_status_best(results: DataFrame, key: str = "claim_id") -> DataFrame:
    """Per claim: verified if any result is, else weak if any is, else unsupported."""
    best = F.max(status_rank(F.col("status")))
    return results.groupBy(key).agg(F.when(best == 3, "verified").when(best == 2, "weak").otherwise("unsupported").alias("status"))


def evidence_support(results: DataFrame) -> DataFrame:
    return results.groupBy("evidence_id").agg(F.max_by("status", status_rank(F.col("status"))).alias("status"))


def claim_status_counts(results: DataFrame) -> DataFrame:
    """Per claim: results by status and a sentence of them."""
    kinds = list(STATUS_RANK)
    n = results.groupBy("claim_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    return n.withColumn("reason", F.format_string("%d of %d citations verified, %d weak", "verified", "total", "weak"))


def jury_aggregate(ballots: DataFrame, criteria: list[str], contested_from: float) -> DataFrame:
    """Mean and spread (max - min) per position and criterion, the overall score included; contested by its spread.

    ``ballots`` has juror_id, issue_id, position_id and the criteria; overall is a juror's mean over them. Means
    are rounded half-even to four places.
    """
    overall = sum((F.col(c) for c in criteria), F.lit(0)) / len(criteria)
    wide = ballots.withColumn("overall", overall)
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in [*criteria, "overall"])
    long = wide.selectExpr("issue_id", "position_id", f"stack({len(criteria) + 1}, {pairs}) as (criterion, score)")
    out = long.groupBy("issue_id", "position_id", "criterion").agg(F.bround(F.avg("score"), 4).alias("mean"), F.bround(F.max("score") - F.min("score"), 4).alias("spread"))
    return out.withColumn("contested", F.bool_or((F.col("criterion") == "overall") & (F.col("spread") >= contested_from)).over(W.partitionBy("issue_id")))


def ledger_totals(calls: DataFrame) -> DataFrame:
    """Per run: calls, cached, tokens and cost of live calls only, and calls without a price."""
    live = ~F.col("cached")
    return calls.groupBy("run_id").agg(
        F.count("*").alias("calls"),
        F.count_if("cached").alias("cached"),
        F.coalesce(F.sum(F.when(live, F.col("input_tokens") + F.col("output_tokens"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(live, F.col("cost_usd"))), F.lit(0.0)).alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced"),
    )


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Tokens at prices a million; null where a price is."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def budget_spend(calls: DataFrame, prices: DataFrame, budget: float) -> DataFrame:
    """Per run: list price of all calls, cached ones too, and what is left of the budget (never below 0)."""
    c = calls.join(prices, "model", "left").withColumn("list", cost_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out")))
    spent = c.groupBy("run_id").agg(F.coalesce(F.sum("list"), F.lit(0.0)).alias("spent"))
    return spent.withColumn("remaining", F.greatest(F.lit(0.0), F.lit(budget) - F.col("spent")))


def per_item_over_seeds(scores: DataFrame) -> DataFrame:
    return scores.groupBy("item", "metric").agg(F.avg("value").alias("value"))


def percentile_nearest_rank(rows: DataFrame, value: str, p: float, rule: str = "round", by: tuple[str, ...] = ()) -> DataFrame:
    """An element of the sorted values, by index: round(p * (n - 1)) half-even, or floor(p * n) at most n - 1.

    Ranked by a window rather than gathered into an array.
    """
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    n = F.count("*").over(w)
    at = F.bround(F.lit(p) * (n - 1)).cast("long") if rule == "round" else F.least(n - 1, F.floor(F.lit(p) * n))
    ranked = rows.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("at", at)
    return ranked.where("i = at").select(*by, F.col(value).alias("percentile"))


def confusion_matrix(pairs: DataFrame, labels: list) -> DataFrame:
    """Counts over all gold x predicted labels, zeros included (the labels are a fixed list)."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(g, p) for g in labels for p in labels], ["gold", "predicted"])
    n = pairs.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    return grid.join(n, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def group_agreement(pairs: DataFrame, by: str) -> DataFrame:
    return pairs.groupBy(by).agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("agreement"), F.count("*").alias("n"))


def authority_summary(authorities: DataFrame) -> DataFrame:
    """Per kind: counts by status and the share that is unverified."""
    return authorities.groupBy("kind").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("corpus", "outside", "mismatch", "unverified")], F.avg((F.col("status") == "unverified").cast("double")).alias("unverified_rate")
    )


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy(F.col("type")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "type", "n")
    b = edges.groupBy(F.col("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "type", "n")
    return a.unionByName(b)
