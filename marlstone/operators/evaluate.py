"""Retrieval and answer metrics, bootstrap intervals, paired tests, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def retrieval_metrics(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """Per query: recall at depths, precision and nDCG at 10, reciprocal rank over the whole list.

    ``run`` has query_id, unit, rank; ``qrels`` query_id, unit. The ideal gain is that of min(relevant, 10) hits.
    Queries of the qrels without hits score 0.
    """
    hits = qrels.join(run, ["query_id", "unit"], "left")
    gain = 1 / F.log2(F.col("rank") + 1)
    g = hits.groupBy("query_id").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("rank") <= d).alias(f"h{d}") for d in depths],
        F.count_if(F.col("rank") <= 10).alias("h10_"),
        F.min("rank").alias("first"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 10, gain)), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return g.select(
        "query_id",
        *[F.round(F.col(f"h{d}") / F.col("n"), 6).alias(f"recall_{d}") for d in depths],
        F.round(F.col("h10_") / 10, 6).alias("precision_10"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.col("dcg") / ideal, 6).alias("ndcg_10"),
    )


def corpus_unit(section_id: Column, doc_id: Column) -> Column:
    return F.coalesce(section_id, doc_id)


def macro_means(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Mean over queries of every metric column."""
    cols = [c for c, t in metrics.dtypes if c not in by and t == "double"]
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


def citation_validity(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per run: share of citations that exist and are quoted exactly, and the two shares apart; null without citations."""
    from ..functions.text import quote_in_text

    j = citations.join(evidence.select("run_id", "evidence_id", "text"), ["run_id", "evidence_id"], "left")
    there, quoted = F.col("text").isNotNull(), F.coalesce(quote_in_text(F.col("quote"), F.col("text")), F.lit(False))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return j.groupBy("run_id").agg(share(there & quoted).alias("citation_validity"), share(there).alias("existence"), share(F.when(there, quoted)).alias("quote_exact"))


def citation_faithfulness(pairs: DataFrame) -> DataFrame:
    """Per run: supporting over judged pairs, the lenient share (partial support counts), unjudged ones aside."""
    judged = F.col("label").isNotNull()
    full = F.col("label") == "supports"
    part = F.col("label").isin("supports", "partially_supports")
    share = lambda c: F.round(F.avg(F.when(judged, c.cast("double"))), 6)
    return pairs.groupBy("run_id").agg(share(full).alias("faithfulness"), share(part).alias("lenient"), F.count_if(~judged).alias("unjudged"))


def unsupported_claim_rate(statements: DataFrame, support: DataFrame) -> DataFrame:
    """Per run: share of statements with no verified or weak reference, and of those with none at all.

    ``statements`` has run_id, place, refs (array); ``support`` run_id, evidence_id, status.
    """
    ok = support.where("status in ('verified', 'weak')").select("run_id", F.col("evidence_id").alias("ref"), F.lit(True).alias("ok"))
    refs = statements.select("run_id", "place", F.size("refs").alias("n"), F.explode_outer("refs").alias("ref")).join(ok, ["run_id", "ref"], "left")
    s = refs.groupBy("run_id", "place").agg(F.coalesce(F.bool_or("ok"), F.lit(False)).alias("held"), F.max("n").alias("n"))
    return s.groupBy("run_id").agg(F.round(F.avg((~F.col("held")).cast("double")), 6).alias("unsupported_claim_rate"), F.round(F.avg((F.col("n") <= 0).cast("double")), 6).alias("uncited"))


def authority_recall(gold: DataFrame, found: DataFrame, kinds: tuple[str, ...] = ("supporting", "contrary", "section")) -> DataFrame:
    """Per item: recall of gold authorities by kind and of all; null where an item has none of a kind."""
    j = gold.distinct().join(found.select("item", "doc_id").distinct().withColumn("hit", F.lit(1)), ["item", "doc_id"], "left")
    one = lambda cond: F.round(F.sum(F.when(cond, F.coalesce("hit", F.lit(0)))) / F.nullif(F.count_if(cond), F.lit(0)), 6)
    return j.groupBy("item").agg(*[one(F.col("kind") == k).alias(f"recall_{k}") for k in kinds], one(F.lit(True)).alias("recall_all"))


def key_point_coverage(grades: DataFrame) -> DataFrame:
    """Per item: mean credit of its key points (covered 1, partly 0.5, missing 0)."""
    credit = F.when(F.col("verdict") == "covered", 1.0).when(F.col("verdict") == "partly", 0.5).otherwise(0.0)
    return grades.groupBy("item").agg(F.round(F.avg(credit), 6).alias("coverage"))


def quality_rubric(scores: DataFrame, criteria: list[str]) -> DataFrame:
    return scores.withColumn("rubric", sum((F.col(c) for c in criteria), F.lit(0)) / len(criteria))


def cost_latency(calls: DataFrame, totals: DataFrame, clock: DataFrame) -> DataFrame:
    """Per run: tokens and cost of its calls, or its recorded totals where there are none; and wall time."""
    c = calls.groupBy("run_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("t"), F.sum("cost_usd").alias("c"))
    out = totals.join(c, "run_id", "left").join(clock, "run_id", "left")
    return out.select("run_id", F.coalesce("t", "total_tokens").alias("tokens"), F.coalesce("c", "total_cost").alias("cost_usd"), "seconds")


def bootstrap_ci(values: DataFrame, by: str, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """Mean and 95 % percentile interval over resamples: the sorted means at indexes 2.5 % and 97.5 % less one.

    Draw j of resample b takes the item numbered md5(seed:b:j) mod n, so any engine draws the same. The draws are
    resamples x items rows of a group, spread over the cluster; nulls are left out.
    """
    v = values.where("value is not null").select(by, "value", (F.row_number().over(W.partitionBy(by).orderBy("item")) - 1).alias("i"))
    n = v.groupBy(by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    draws = n.select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).select(by, "n", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long")
    means = draws.select(by, "b", F.pmod(number, F.col("n")).alias("i")).join(v, [by, "i"]).groupBy(by, "b").agg(F.avg("value").alias("m"))
    ranked = means.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy("m", "b")) - 1)
    lo, hi = int(0.025 * resamples), int(0.975 * resamples) - 1
    ends = ranked.groupBy(by).agg(F.max(F.when(F.col("r") == lo, F.col("m"))).alias("low"), F.max(F.when(F.col("r") == hi, F.col("m"))).alias("high"))
    return n.join(ends, by).select(by, "n", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def sign_flip_p(differences: DataFrame, by: str, exact_to: int = 16, flips: int = 20_000, seed: int = 0) -> DataFrame:
    """Two-sided paired sign-flip p-value of the mean difference: all 2^n sign patterns up to ``exact_to`` pairs,
    else ``flips`` patterns from hashes. A pattern as extreme as the observed one (to 1e-12) counts."""
    d = differences.where("difference is not null").select(by, "difference", (F.row_number().over(W.partitionBy(by).orderBy("item")) - 1).alias("i"))
    n = d.groupBy(by).agg(F.count("*").alias("n"), F.abs(F.sum("difference")).alias("seen"))
    patterns = n.withColumn("patterns", F.when(F.col("n") <= exact_to, F.expr("shiftleft(1L, cast(least(n, 62) as int))")).otherwise(F.lit(flips).cast("long")))
    rows = patterns.select(by, "n", "seen", "patterns", F.explode(F.sequence(F.lit(0).cast("long"), F.col("patterns") - 1)).alias("p")).join(d, by)
    bit = F.expr("shiftright(p, cast(i as int)) & 1")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("p").cast("string"), F.col("i").cast("string"))), 1, 1), 16, 10).cast("long").bitwiseAND(F.lit(1).cast("long"))
    sign = F.when(F.when(F.col("n") <= exact_to, bit).otherwise(drawn) == 1, 1.0).otherwise(-1.0)
    sums = rows.groupBy(by, "n", "seen", "patterns", "p").agg(F.abs(F.sum(sign * F.col("difference"))).alias("s"))
    return sums.groupBy(by, "n").agg((F.count_if(F.col("s") >= F.col("seen") - 1e-12) / F.max("patterns")).alias("p_value"))


def aggregate(values: DataFrame, by: str, resamples: int = 2000) -> DataFrame:
    return bootstrap_ci(values, by, resamples)


def precision_recall_f1(pairs: DataFrame, positive, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of one label; 0 where undefined."""
    g, p = F.col("gold") == positive, F.col("predicted") == positive
    n = pairs.groupBy(*(by or [])).agg(F.count_if(g & p).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(g & ~p).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n = n.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def cohens_kappa(pairs: DataFrame) -> DataFrame:
    """Chance-corrected agreement of all pairs: 1 where chance alone would agree always, 0 without pairs."""
    n = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("same"))
    a = pairs.groupBy(F.col("gold").alias("label")).agg(F.count("*").alias("a"))
    b = pairs.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("b"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    return n.join(F.broadcast(chance)).select(F.round(F.when(F.col("n") == 0, 0.0).when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def coliee_metrics(pairs: DataFrame) -> DataFrame:
    """Binary scores with support read strictly (supports) and leniently (partial support too)."""
    out = None
    for name, labels in (("strict", ("supports",)), ("lenient", ("supports", "partially_supports"))):
        x = precision_recall_f1(pairs.select(F.col("gold"), F.col("predicted").isin(*labels).alias("predicted")), True).withColumn("reading", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


def comparison_table(means: DataFrame, experiments: list[str]) -> DataFrame:
    """Metrics by experiments."""
    return means.groupBy("metric").pivot("experiment", experiments).agg(F.round(F.first("value"), 6))


def summarise(scores: DataFrame) -> DataFrame:
    """Per experiment and metric: mean over items of the mean over seeds, items, and failed runs."""
    item = scores.groupBy("experiment", "metric", "item").agg(F.avg("value").alias("v"), F.count_if("failed").alias("f"))
    return item.groupBy("experiment", "metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("items"), F.sum("f").alias("failed_runs"))


def score_answer(*frames: DataFrame) -> DataFrame:
    """One long table of all metrics of answers: run_id, metric, value."""
    out = None
    for f in frames:
        cols = [c for c, t in f.dtypes if c != "run_id"]
        pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
        x = f.selectExpr("run_id", f"stack({len(cols)}, {pairs}) as (metric, value)")
        out = x if out is None else out.unionByName(x)
    return out


def results_upsert(table: DataFrame, rows: DataFrame, key: str = "experiment") -> DataFrame:
    """The results table with an experiment's rows in place of its old ones."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)
