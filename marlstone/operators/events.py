"""The event log: emission, order, folding into state, lifecycle and verification, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.text import drop_ref, inline_refs, quote_in_text


def emit(rows: DataFrame, order: list[str]) -> DataFrame:
    """Sequence numbers from 1 and event IDs for the rows of each run."""
    seq = F.row_number().over(W.partitionBy("run_id").orderBy(*order))
    return rows.withColumn("seq", seq).withColumn("event_id", F.format_string("evt_%06d", F.col("seq")))


def order_check(events: DataFrame, first_type: str) -> DataFrame:
    """Violations of a log in its arrival order: first event of another type, sequence not rising, another case.

    ``events`` has run_id, case_id, arrival, seq, type.
    """
    w = W.partitionBy("run_id").orderBy("arrival")
    e = events.withColumn("prev_seq", F.lag("seq").over(w)).withColumn("first_case", F.first("case_id").over(w))
    problem = (
        F.when(F.col("prev_seq").isNull() & (F.col("type") != first_type), "first event of another type")
        .when(F.col("seq") <= F.col("prev_seq"), "sequence not rising")
        .when(F.col("case_id") != F.col("first_case"), "another case")
    )
    return e.withColumn("problem", problem).where("problem is not null").select("run_id", "arrival", "seq", "type", "problem")


def idempotent_redelivery(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events once each by (run_id, seq), and the sequence numbers used with two event IDs."""
    once = events.dropDuplicates(["run_id", "seq", "event_id"])
    clash = once.groupBy("run_id", "seq").agg(F.count("*").alias("ids")).where("ids > 1")
    return once, clash


def stage_state(events: DataFrame) -> DataFrame:
    """Last status of each stage of a run."""
    status = F.when(F.col("type") == "stage_started", F.coalesce(F.col("mode"), F.lit("running"))).otherwise(F.col("outcome"))
    s = events.where("type in ('stage_started', 'stage_completed')")
    return s.groupBy("run_id", "stage").agg(F.max_by(status, "seq").alias("status"))


def agent_tokens(events: DataFrame) -> DataFrame:
    """Per run and agent: tokens summed over completions since its last start, the last such cost, whether it has finished."""
    a = events.where("type in ('agent_started', 'agent_completed')")
    start = F.max(F.when(F.col("type") == "agent_started", F.col("seq"))).over(W.partitionBy("run_id", "agent"))
    a = a.withColumn("since", F.coalesce(start, F.lit(0)))
    done = (F.col("type") == "agent_completed") & (F.col("seq") > F.col("since"))
    return a.groupBy("run_id", "agent").agg(
        F.coalesce(F.sum(F.when(done, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(done, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        F.max_by("cost_usd", F.when(done, F.col("seq"))).alias("cost_usd"),
        (F.max_by("type", "seq") == "agent_completed").alias("done"),
    )


#: Fixed: the statuses a claim may take next.
_VERDICTS = ("verified", "weak", "unsupported")
TRANSITIONS = [(a, b) for a in ("proposed", *_VERDICTS) for b in (*_VERDICTS, "contested")] + [("contested", "survives"), ("contested", "falls")]


def claim_lifecycle(changes: DataFrame, first: str = "proposed") -> DataFrame:
    """Illegal status changes of claims: run_id, claim_id, seq, from_status, status."""
    spark = changes.sparkSession
    legal = F.broadcast(spark.createDataFrame(TRANSITIONS, "from_status string, status string"))
    w = W.partitionBy("run_id", "claim_id").orderBy("seq")
    steps = changes.withColumn("from_status", F.coalesce(F.lag("status").over(w), F.lit(first)))
    return steps.join(legal, ["from_status", "status"], "left_anti").select("run_id", "claim_id", "seq", "from_status", "status")


def invariants(citations: DataFrame, evidence: DataFrame, analysis_refs: DataFrame, support: DataFrame, issues: DataFrame, analysed: DataFrame) -> DataFrame:
    """Violations: citations of unknown evidence or of quotes not in it, an analysis citing what isn't citable, issues not analysed."""
    c = citations.join(evidence.select("run_id", "evidence_id", "text"), ["run_id", "evidence_id"], "left")
    unknown = c.where("text is null").select("run_id", F.col("evidence_id").alias("item"), F.lit("unknown evidence").alias("problem"))
    unquoted = c.where(F.col("text").isNotNull() & ~quote_in_text(F.col("quote"), F.col("text"))).select("run_id", F.col("evidence_id").alias("item"), F.lit("quote not in the chunk").alias("problem"))
    ok = support.where("status in ('verified', 'weak')").select("run_id", "evidence_id")
    uncitable = analysis_refs.join(ok, ["run_id", "evidence_id"], "left_anti").select("run_id", F.col("evidence_id").alias("item"), F.lit("not citable").alias("problem"))
    missing = issues.join(analysed, ["run_id", "issue_id"], "left_anti").select("run_id", F.col("issue_id").alias("item"), F.lit("issue not analysed").alias("problem"))
    return unknown.unionByName(unquoted).unionByName(uncitable).unionByName(missing).distinct()


def register_evidence(hits: DataFrame) -> DataFrame:
    """One evidence per chunk of a run, numbered by first registration; issues in order of registration."""
    e = hits.groupBy("run_id", "chunk_id").agg(F.min("seq").alias("first"), F.transform(F.array_sort(F.collect_set(F.struct("seq", "issue_id"))), lambda s: s.issue_id).alias("i"))
    n = F.row_number().over(W.partitionBy("run_id").orderBy("first", "chunk_id"))
    return e.select("run_id", F.format_string("E-%03d", n).alias("evidence_id"), "chunk_id", F.array_distinct("i").alias("issue_ids"))


def pending_citations(citations: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs of claim and evidence without a result, the first citation of each."""
    new = citations.join(results.select("run_id", "claim_id", "evidence_id"), ["run_id", "claim_id", "evidence_id"], "left_anti")
    first = W.partitionBy("run_id", "claim_id", "evidence_id").orderBy("nth")
    return new.withColumn("p", F.row_number().over(first)).where("p = 1").drop("p")


#: Fixed: what a judge's label makes of a citation.
LABEL_STATUS = {"supports": "verified", "partially_supports": "weak", "does_not_support": "unsupported", "contradicts": "unsupported"}


def verify(citations: DataFrame, evidence: DataFrame, judge) -> DataFrame:
    """Status and failed check of citations: existence, then the exact quote, then the judge's label of what is left.

    The cheap checks are joins and expressions; ``judge`` (a pandas UDF of claim text and passage) sees each different
    pair once. An unjudged pair has status null.
    """
    j = citations.join(evidence.select("run_id", "evidence_id", "text"), ["run_id", "evidence_id"], "left")
    checked = j.withColumn("failed", F.when(F.col("text").isNull(), "existence").when(~quote_in_text(F.col("quote"), F.col("text")), "quote"))
    pairs = checked.where("failed is null").select("claim_text", "text").distinct()
    labels = pairs.withColumn("label", judge("claim_text", "text"))
    out = checked.join(labels, ["claim_text", "text"], "left")
    status = F.lit(None).cast("string")
    for label, s in LABEL_STATUS.items():
        status = F.when(F.col("label") == label, s).otherwise(status)
    return out.select("run_id", "claim_id", "evidence_id", "failed", "label", F.when(F.col("failed").isNotNull(), "invalid").otherwise(status).alias("status"))


def sentences(text: Column) -> Column:
    """Sentences; a piece of citations alone belongs to the one before."""
    pieces = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda p: p != "")

    def step(acc, p):
        alone = F.btrim(F.regexp_replace(p, r"(?i)\[\s*E\s*-?\s*\d+\s*\]", ""), F.lit(" .,;")) == ""
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), p)))
        return F.when(alone & (F.size(acc) > 0), joined).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(pieces, F.array().cast("array<string>"), step)


def final_verify(texts: DataFrame, support: DataFrame) -> DataFrame:
    """Texts without the references that don't hold, and the sentences left with none of theirs.

    ``texts`` has run_id, place, text; ``support`` run_id, evidence_id, status. Returns run_id, place, text, flagged.
    """
    ok = support.where("status in ('verified', 'weak')").select("run_id", F.col("evidence_id").alias("ref"), F.lit(True).alias("ok"))
    s = texts.select("run_id", "place", F.posexplode(sentences(F.col("text"))).alias("nth", "sentence"))
    refs = s.select("run_id", "place", "nth", "sentence", F.explode_outer(inline_refs(F.col("sentence"))).alias("ref")).join(ok, ["run_id", "ref"], "left")
    g = refs.groupBy("run_id", "place", "nth", "sentence").agg(F.array_sort(F.collect_list(F.when(F.col("ok").isNull(), F.col("ref")))).alias("bad"), F.count("ref").alias("n"), F.count("ok").alias("good"))
    cleaned = F.aggregate("bad", F.col("sentence"), lambda t, r: drop_ref(t, r))
    g = g.withColumn("clean", cleaned).withColumn("empty", (F.col("n") > 0) & (F.col("good") == 0))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("nth", "clean"))), lambda x: x.clean)
    return g.groupBy("run_id", "place").agg(F.array_join(parts, " ").alias("text"), F.count_if("empty").alias("flagged"))


def contest(claims: DataFrame, objections: DataFrame) -> DataFrame:
    """Open claims that an objection targets become contested."""
    hit = objections.select("run_id", F.col("target_id").alias("claim_id"), F.lit(True).alias("hit")).distinct()
    open_ = F.col("status").isin("proposed", "verified", "weak", "unsupported")
    return claims.join(hit, ["run_id", "claim_id"], "left").withColumn("status", F.when(F.col("hit") & open_, "contested").otherwise(F.col("status"))).drop("hit")


def settle(claims: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contested claims fall if any reply concedes, else survive if all are resolved; the rest are open questions."""
    r = replies.groupBy("run_id", "claim_id").agg(F.bool_or("conceded").alias("conceded"), F.bool_and("resolved").alias("resolved"))
    j = claims.join(r, ["run_id", "claim_id"], "left")
    held = F.col("status") == "contested"
    out = j.withColumn("new", F.when(held & F.col("conceded"), "falls").when(held & F.col("resolved"), "survives").otherwise(F.col("status")))
    questions = out.where(held & (F.col("new") == "contested")).select("run_id", "claim_id")
    return out.select(*[F.col("new").alias("status") if c == "status" else c for c in claims.columns]), questions


def cited_judgments(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per run and judgment: its cited chunks and evidence IDs."""
    j = citations.select("run_id", "evidence_id").distinct().join(evidence.where("kind = 'judgment'"), ["run_id", "evidence_id"])
    return j.groupBy("run_id", "doc_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))


def citable(citations: DataFrame, results: DataFrame) -> DataFrame:
    """Evidence whose best status is verified or weak, and the quote that got it, the first of equals."""
    rank = F.when(F.col("status") == "verified", 2).when(F.col("status") == "weak", 1)
    j = citations.join(results.withColumn("r", rank).where("r is not null"), ["run_id", "claim_id", "evidence_id"])
    return j.groupBy("run_id", "evidence_id").agg(F.max_by("status", "r").alias("status"), F.min_by("quote", F.struct(-F.col("r"), "nth")).alias("quote"))


def replay(events: DataFrame, speed: float, cap: float) -> DataFrame:
    """When each event of a finished run is due in a replay: delays of at most ``cap`` seconds, added up."""
    from .windows import event_gap

    w = W.partitionBy("run_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return event_gap(events, speed, cap).withColumn("due", F.sum("delay").over(w))


TERMINAL = ("run_completed", "run_failed")


def finished(events: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    return events.groupBy("run_id").agg(F.max_by("type", "seq").isin(*terminal).alias("finished"))


def restore(events: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """The log with a failure event behind every run that was interrupted."""
    ends = events.groupBy("run_id").agg(F.max("seq").alias("last"), F.max_by("type", "seq").alias("t")).where(~F.col("t").isin(*terminal))
    closing = ends.select("run_id", (F.col("last") + 1).alias("seq"), F.lit("run_failed").alias("type"))
    return events.select("run_id", F.col("seq").cast("long").alias("seq"), "type").unionByName(closing.select("run_id", F.col("seq").cast("long"), "type"))


def evidence_detail(evidence: DataFrame, citations: DataFrame, results: DataFrame) -> DataFrame:
    """Evidence with its citations and each pair's latest result."""
    latest = results.groupBy("run_id", "claim_id", "evidence_id").agg(F.max_by("status", "seq").alias("status"))
    c = citations.join(latest, ["run_id", "claim_id", "evidence_id"], "left").groupBy("run_id", "evidence_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "quote", "status"))).alias("citations"))
    return evidence.join(c, ["run_id", "evidence_id"], "left")


def drop_keep_best(attempts: DataFrame, bad: DataFrame) -> DataFrame:
    """Of the attempts at an output, the one that keeps most items once failing ones are dropped; the later on ties.

    ``attempts`` has call_id, attempt, items (array); ``bad`` call_id, attempt, item.
    """
    b = bad.groupBy("call_id", "attempt").agg(F.collect_set("item").alias("bad"))
    kept = attempts.join(b, ["call_id", "attempt"], "left").withColumn("items", F.array_except("items", F.coalesce("bad", F.array().cast("array<string>")))).drop("bad")
    return kept.groupBy("call_id").agg(F.max(F.struct(F.size("items").alias("n"), "attempt", "items")).alias("m")).select("call_id", "m.attempt", "m.items")


def response_cache(requests: DataFrame, cache: DataFrame, mode: str = "read-write") -> tuple[DataFrame, DataFrame]:
    """Requests with their cached response, and those to send; ``off`` sends all."""
    if mode == "off":
        return requests.withColumn("response", F.lit(None).cast("string")), requests
    hit = requests.join(cache.select("key", "response"), "key", "left")
    return hit, hit.where("response is null").drop("response")


def payload_json(events: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Payloads parsed by their type's schema; a payload that lacks a field of it is flagged."""
    valid = F.lit(False)
    for kind, schema in schemas.items():
        p = F.from_json("payload", schema)
        ok = p.isNotNull()
        for f in schema.split(","):
            ok = ok & p.getField(f.split()[0]).isNotNull()
        valid = F.when(F.col("type") == kind, F.coalesce(ok, F.lit(False))).otherwise(valid)
    return events.withColumn("valid", valid)
