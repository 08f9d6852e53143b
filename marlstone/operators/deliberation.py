"""Data operators of the deliberation stages: candidates, targets, ballots, answers. Model calls are outside."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from .windows import hash_order


def framing_dedupe(items: DataFrame, most: int) -> DataFrame:
    """Items of a list flagged empty, repeated (case and spaces aside) or surplus, else null: issue_id, nth, text, problem."""
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    k = items.withColumn("key", key)
    k = k.withColumn("again", F.row_number().over(W.partitionBy("issue_id", "key").orderBy("nth")) > 1)
    ok = (F.col("key") != "") & ~F.col("again")
    k = k.withColumn("kept", F.sum(ok.cast("int")).over(W.partitionBy("issue_id").orderBy("nth")))
    problem = F.when(F.col("key") == "", "empty").when(F.col("again"), "repeated").when(F.col("kept") > most, "surplus")
    return k.select("issue_id", "nth", "text", problem.alias("problem"))


def counsel_candidates(evidence: DataFrame, issue: str) -> DataFrame:
    return evidence.where(F.array_contains("issue_ids", issue)).orderBy("evidence_id")


def claim_cap(claims: DataFrame, most: int = 6) -> DataFrame:
    return claims.withColumn("i", F.row_number().over(W.partitionBy("run_id", "position_id").orderBy("nth"))).where(F.col("i") <= most).drop("i")


def by_priority(lists: list[DataFrame], held: DataFrame, by: str, item: str) -> DataFrame:
    """Union of lists (by, item, nth), the earlier list first, each item once, held items alone: by, item, place."""
    out = None
    for i, x in enumerate(lists):
        y = x.select(by, item, F.lit(i).alias("tier"), F.col("nth").cast("long").alias("nth"))
        out = y if out is None else out.unionByName(y)
    first = out.groupBy(by, item).agg(F.min(F.struct("tier", "nth")).alias("o")).join(held.select(item).distinct(), item, "left_semi")
    return first.select(by, item, F.row_number().over(W.partitionBy(by).orderBy("o", item)).alias("place"))


def rebuttal_candidates(found: DataFrame, cited: DataFrame, pool: DataFrame, held: DataFrame) -> DataFrame:
    return by_priority([found, cited, pool], held, "issue_id", "evidence_id")


def shown_evidence(cited: DataFrame, second: DataFrame, rest: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """Cited evidence, then a second search's, then the rest, at most ``most``, in order of ID."""
    return by_priority([cited, second, rest], held, "run_id", "evidence_id").where(F.col("place") <= most).orderBy("run_id", "evidence_id")


def citation_counts(checked: DataFrame, by: str) -> DataFrame:
    """Valid and all citations of outputs (``failed`` null means valid), and their share; null without any."""
    return checked.groupBy(by).agg(F.count_if(F.col("failed").isNull()).alias("valid"), F.count("*").alias("total")).withColumn("validity", F.try_divide("valid", "total"))


def objection_targets(claims: DataFrame, arguments: DataFrame) -> DataFrame:
    """Position of every target: claims, and the arguments that rest on them."""
    c = claims.select("run_id", F.col("claim_id").alias("target_id"), "position_id")
    a = arguments.join(claims.select("run_id", "claim_id", "position_id"), ["run_id", "claim_id"]).select("run_id", F.col("argument_id").alias("target_id"), "position_id")
    return c.unionByName(a).distinct()


def repliers(objections: DataFrame, targets: DataFrame) -> DataFrame:
    """Objections by the position that has to reply, in order."""
    j = objections.join(targets, ["run_id", "target_id"])
    return j.groupBy("run_id", "position_id").agg(F.array_sort(F.collect_set("objection_id")).alias("objections"))


def ballot_checks(ballots: DataFrame, positions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Problems of ballots: two of one juror, unknown positions, unknown evidence. ``ballots`` has cited (array)."""
    twice = ballots.groupBy("run_id", "juror_id", "position_id").count().where("count > 1").select("run_id", "juror_id", F.lit("two ballots").alias("problem"))
    unknown = ballots.join(positions, ["run_id", "position_id"], "left_anti").select("run_id", "juror_id", F.lit("unknown position").alias("problem"))
    lost = ballots.select("run_id", "juror_id", F.explode("cited").alias("evidence_id")).join(evidence, ["run_id", "evidence_id"], "left_anti").select("run_id", "juror_id", F.lit("unknown evidence").alias("problem"))
    return twice.unionByName(unknown).unionByName(lost).distinct()


def precedent_cards(cited: DataFrame, cards: DataFrame) -> DataFrame:
    """One card for each cited judgment: the analyst's, else a fallback of unknown fit whose treatment is unverified."""
    j = cited.join(cards, ["run_id", "doc_id"], "left")
    return j.select("run_id", "doc_id", F.coalesce("fit", F.lit("unknown")).alias("fit"), F.coalesce("treatment_verified", F.lit(False)).alias("treatment_verified"), F.col("fit").isNull().alias("fallback"))


def treatment_signals(edges: DataFrame, labels: list[str]) -> DataFrame:
    """One signal for each later judgment and known treatment of a cited judgment."""
    return edges.where(F.col("treatment").isin(*labels)).select(F.col("target_ref").alias("doc_id"), F.col("source_doc_id").alias("by_doc_id"), "treatment").distinct()


def fit_assessment(citations: DataFrame, results: DataFrame, cards: DataFrame) -> DataFrame:
    """Per citation: the last status of its pair, and the fit of its precedent."""
    last = results.groupBy("run_id", "claim_id", "evidence_id").agg(F.max_by("status", "seq").alias("status"))
    return citations.join(last, ["run_id", "claim_id", "evidence_id"], "left").join(cards.select("run_id", "doc_id", "fit"), ["run_id", "doc_id"], "left").select("run_id", "claim_id", "evidence_id", F.coalesce("status", F.lit("unchecked")).alias("status"), F.coalesce("fit", F.lit("unknown")).alias("fit"))


def judge_resolve(named: DataFrame, arguments: DataFrame, citable: DataFrame) -> DataFrame:
    """Citable evidence that an ID stands for: itself, or what the citations of a claim or argument name.

    ``named`` has run_id, item; ``arguments`` run_id, argument_id, claim_id, evidence_id.
    """
    own = named.select("run_id", "item", F.col("item").alias("evidence_id"))
    via = arguments.select("run_id", F.col("argument_id").alias("item"), "evidence_id").unionByName(arguments.select("run_id", F.col("claim_id").alias("item"), "evidence_id"))
    return own.unionByName(named.join(via, ["run_id", "item"]).select("run_id", "item", "evidence_id")).join(citable, ["run_id", "evidence_id"], "left_semi").select("run_id", "item", "evidence_id").distinct()


def conflict_check(conflicts: DataFrame, evidence: DataFrame, citable: DataFrame) -> DataFrame:
    """What is wrong with named conflicts (run_id, a, b, reason): not citable, one judgment, no reason; null if nothing."""
    side = lambda s: evidence.join(citable, ["run_id", "evidence_id"], "left_semi").select("run_id", F.col("evidence_id").alias(s), F.col("doc_id").alias(f"{s}_doc"))
    j = conflicts.join(side("a"), ["run_id", "a"], "left").join(side("b"), ["run_id", "b"], "left")
    p = F.when(F.col("a_doc").isNull() | F.col("b_doc").isNull(), "not citable").when(F.col("a_doc") == F.col("b_doc"), "one judgment").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no reason")
    return j.select("run_id", "a", "b", p.alias("problem"))


def unresolved_labels(questions: DataFrame) -> DataFrame:
    n = F.row_number().over(W.partitionBy("run_id").orderBy("seq"))
    return questions.withColumn("label", F.concat(F.lit("U"), n.cast("string")))


def build_analysis(issues: DataFrame, positions: DataFrame, answers: DataFrame, refs: DataFrame, citable: DataFrame, words: int = 250) -> DataFrame:
    """Per run and position: summary (gaps filled and marked, cut at ``words`` words), evidence that is citable, authorities.

    ``answers`` has run_id, position_id, summary; ``refs`` run_id, position_id, evidence_id, nth; ``citable`` run_id,
    evidence_id, doc_id. Authorities are judgments in the order of their first citation.
    """
    base = positions.join(issues.select("run_id", "issue_id"), ["run_id", "issue_id"]).join(answers, ["run_id", "position_id"], "left")
    r = refs.join(citable, ["run_id", "evidence_id"]).groupBy("run_id", "position_id").agg(F.array_sort(F.collect_list(F.struct("nth", "evidence_id", "doc_id"))).alias("r"))
    take = lambda f: F.array_distinct(F.transform("r", lambda s: s[f]))
    cut = F.array_join(F.slice(F.split(F.trim("summary"), r"\s+"), 1, words), " ")
    return base.join(r, ["run_id", "position_id"], "left").select("run_id", "issue_id", "position_id", F.coalesce(cut, F.lit("")).alias("summary"), F.col("summary").isNull().alias("gap"), F.coalesce(take("evidence_id"), F.array().cast("array<string>")).alias("evidence"), F.coalesce(take("doc_id"), F.array().cast("array<string>")).alias("authorities"))


def framing_stage(issues: DataFrame, seed: int) -> DataFrame:
    """Positions of issues in seeded order, lettered A, B, ...; ``issues`` has run_id, issue_id, positions (array)."""
    p = issues.select("run_id", "issue_id", F.explode("positions").alias("statement"))
    n = F.row_number().over(W.partitionBy("run_id", "issue_id").orderBy(hash_order(F.concat_ws("/", "run_id", "issue_id", "statement"), seed), "statement"))
    return p.withColumn("position_id", F.concat(F.col("issue_id"), F.lit("."), F.substring(F.lit("ABC"), n, F.lit(1))))


def opening_stage(positions: DataFrame, citations: DataFrame, single_counsel: bool = False) -> DataFrame:
    """Counsel for each issue and position (the first alone on request) with its distinct citations and their validity."""
    p = positions
    if single_counsel:
        p = p.withColumn("n", F.row_number().over(W.partitionBy("run_id", "issue_id").orderBy("position_id"))).where("n = 1").drop("n")
    c = citations.dropDuplicates(["run_id", "position_id", "evidence_id", "quote"]).groupBy("run_id", "position_id").agg(F.count("*").alias("citations"), F.count_if("valid").alias("ok"))
    return p.join(c, ["run_id", "position_id"], "left").select("run_id", "issue_id", "position_id", F.coalesce("citations", F.lit(0)).alias("citations"), F.try_divide("ok", "citations").alias("validity"))


def rounds_within_budget(spend: list[float], budget: float, most: int) -> int:
    """How many rounds run, each estimated at the last one's spend."""
    done, used = 0, 0.0
    for s in spend[:most]:
        if done and used + spend[done - 1] > budget:
            break
        used += s
        done += 1
    return done


def rebuttal_stage(claims: DataFrame, answered: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions that have opposing unanswered claims, and those claims, strongest first."""
    opp = positions.join(claims.withColumnRenamed("position_id", "other"), ["run_id", "issue_id"]).where("position_id <> other")
    left = opp.join(answered, ["run_id", "claim_id"], "left_anti")
    return left.groupBy("run_id", "position_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), "claim_id"))), lambda x: x.claim_id).alias("targets"))


def cross_exam_stage(objections: DataFrame, claims: DataFrame, replies: DataFrame, most: int) -> DataFrame:
    """Counters of a run's cross-examination: raised, kept, contested, conceded, surviving, open."""
    from .events import contest, settle
    from .windows import objection_topk

    kept = objection_topk(objections, most)
    held, questions = settle(contest(claims, kept), replies)
    n = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    out = n(objections, "raised")
    for df, name in ((kept, "kept"), (contest(claims, kept).where("status = 'contested'"), "contested"), (held.where("status = 'falls'"), "conceded"), (held.where("status = 'survives'"), "surviving"), (questions, "open")):
        out = out.join(n(df, name), "run_id", "left")
    return out.na.fill(0)


def jury_stage(jurors: int, exhausted: bool) -> int:
    """Number of jurors: one when the budget is exhausted."""
    return 1 if exhausted else jurors


def judge_stage(analysis: DataFrame, pending: DataFrame) -> DataFrame:
    """Per run: positions analysed, evidence relied on, citations verified first."""
    a = analysis.groupBy("run_id").agg(F.count("*").alias("positions"), F.sum(F.size("evidence")).alias("evidence"))
    return a.join(pending.groupBy("run_id").agg(F.count("*").alias("verified_first")), "run_id", "left").na.fill(0)


def stage_gating(stages: list[tuple[str, str, bool, float]], remaining: float) -> list[tuple[str, str]]:
    """What each stage (name, mode, optional, estimate) does: off is skipped, an optional one the budget forbids too."""
    out = []
    for name, mode, optional, estimate in stages:
        if mode == "off":
            out.append((name, "skipped"))
        elif mode == "passthrough":
            out.append((name, "passthrough"))
        elif optional and estimate > remaining:
            out.append((name, "skipped: budget"))
        else:
            out.append((name, "run"))
            remaining -= estimate
    return out


def authority_resolver(authorities: DataFrame, by_citation: DataFrame, titles: DataFrame, acts: DataFrame) -> DataFrame:
    """Status of named authorities: corpus, outside, mismatch, unverified, unknown act.

    A judgment is found by its canonical citation, else by the most similar title (0.75 or more, joined on shared words);
    one found by citation whose title shares no distinctive word with it is a mismatch.
    """
    from ..functions.text import same_parties, title_words, word_similarity

    j = authorities.where("kind = 'judgment'").join(by_citation.select("canonical", "doc_id", F.col("title").alias("their_title"), "in_corpus"), "canonical", "left")
    word = lambda df, c: df.withColumn("w", F.explode(F.array_except(title_words(F.col(c)), F.array(F.lit("the"), F.lit("and")))))
    need = word(j.where("doc_id is null").select("item", "title"), "title")
    pairs = need.join(word(titles.select(F.col("doc_id").alias("t_doc"), F.col("title").alias("t_title")), "t_title"), "w").select("item", "title", "t_doc", "t_title").distinct()
    near = pairs.withColumn("s", word_similarity(F.col("title"), F.col("t_title"))).where("s >= 0.75").groupBy("item").agg(F.max_by("t_doc", F.struct("s", "t_doc")).alias("t_doc"))
    s = F.when(F.col("doc_id").isNotNull() & F.coalesce(~same_parties(F.col("title"), F.col("their_title")), F.lit(False)), "mismatch").when(F.col("doc_id").isNotNull(), F.when(F.col("in_corpus"), "corpus").otherwise("outside")).when(F.col("t_doc").isNotNull(), "corpus").otherwise("unverified")
    a = j.join(near, "item", "left").select("item", "kind", s.alias("status"))
    b = authorities.where("kind = 'statute'").join(acts.select(F.col("act_id").alias("canonical"), F.lit(True).alias("known")), "canonical", "left").select("item", "kind", F.when(F.col("known"), "corpus").otherwise("unknown act").alias("status"))
    return a.unionByName(b)


def drop_uncited(claims: DataFrame, citations: DataFrame) -> DataFrame:
    return claims.join(citations.select("run_id", "claim_id").distinct(), ["run_id", "claim_id"], "left_semi")


def repair_quotes(citations: DataFrame, fixes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations with the fixed quote where the own one fails and the fixed one holds."""
    from ..functions.text import quote_in_text

    j = citations.join(evidence.select("run_id", "evidence_id", "text"), ["run_id", "evidence_id"], "left").join(fixes.select("run_id", "claim_id", "evidence_id", F.col("quote").alias("fixed")), ["run_id", "claim_id", "evidence_id"], "left")
    holds = lambda q: F.coalesce(quote_in_text(F.col(q), F.col("text")), F.lit(False))
    return j.withColumn("quote", F.when(~holds("quote") & holds("fixed"), F.col("fixed")).otherwise(F.col("quote"))).drop("fixed", "text")


def quote_errors(checked: DataFrame) -> DataFrame:
    """A line for each failing citation."""
    return checked.where("failed is not null").select("run_id", F.format_string("%s cites %s: %s", "claim_id", "evidence_id", "failed").alias("line"))


def best_statute_text(texts: DataFrame) -> DataFrame:
    """Longest central ASCII text of each normalised title, ties to the least ID."""
    ok = texts.where(F.col("central") & ~F.col("text").rlike(r"[^\x00-\x7F]"))
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9 ]", " "), r"\s+", " "))
    return ok.withColumn("key", key).withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(F.desc(F.length("text")), "doc_id"))).where("n = 1").select("key", "doc_id")


def screening(candidates: DataFrame, cap: int) -> DataFrame:
    """Every row examined until ``cap`` are selected: candidates in order, selected if reasoned and core."""
    c = candidates.withColumn("selected", F.col("reasoned") & F.col("core"))
    end = c.where("selected").orderBy("nth").limit(cap).agg(F.count("*").alias("n"), F.max("nth").alias("end"))
    return c.join(F.broadcast(end), (F.col("n") < cap) | (F.col("nth") <= F.col("end"))).drop("n", "end")


def key_point_index_check(grades: DataFrame) -> DataFrame:
    """Items whose grades are not numbered exactly 1 to n."""
    g = grades.groupBy("item").agg(F.array_sort(F.collect_list("nth")).alias("got"))
    return g.where(F.col("got") != F.sequence(F.lit(1), F.size("got"))).select("item", F.size("got").alias("grades"))


def analysis_refs(texts: DataFrame) -> DataFrame:
    """Evidence cited anywhere in a run's texts, in order of first appearance: run_id, refs."""
    from ..functions.text import inline_refs

    r = texts.select("run_id", "place", F.posexplode(inline_refs(F.col("text"))).alias("i", "ref")).groupBy("run_id", "ref").agg(F.min(F.struct("place", "i")).alias("o"))
    return r.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "ref"))), lambda s: s.ref).alias("refs"))


def normalise_refs(texts: DataFrame, arguments: DataFrame) -> DataFrame:
    """Texts (run_id, place, text) with one [E-nnn] for each evidence that a bracket of record IDs stands for.

    A claim or argument (``arguments``: run_id, argument_id, claim_id, evidence_id, nth) stands for what its citations
    name, in their order. A bracket that holds anything else is left alone.
    """
    ids = arguments.select("run_id", F.explode(F.array("argument_id", "claim_id")).alias("item"), "evidence_id", "nth")
    per = ids.groupBy("run_id", "item").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("nth", "evidence_id"))), lambda s: s.evidence_id)).alias("e"))
    table = per.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("item", "e"))).alias("table"))

    def rewrite(text: str, known: dict) -> str:
        def expand(m):
            out = []
            for part in m[1].split(","):
                t = re.fullmatch(r"\s*([ECA])\s*-?\s*(\d+)\s*", part, re.I)
                if not t:
                    return m[0]
                item = f"{t[1].upper()}-{int(t[2]):03d}"
                out += [item] if item[0] == "E" else list(known.get(item, []))
            return " ".join(f"[{e}]" for e in dict.fromkeys(out))

        return re.sub(r"\s+([.,;])", r"\1", re.sub(r"\[([^\[\]]+)\]", expand, text)).strip()

    def run(text: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else rewrite(t, dict(k) if k is not None else {}) for t, k in zip(text, known)], dtype=object)

    udf = F.pandas_udf(run, "string")
    return texts.join(table, "run_id", "left").select("run_id", "place", udf("text", "table").alias("text"))


def analysis_sections(evidence: DataFrame, refs: DataFrame) -> DataFrame:
    """Statute sections that an analysis relies on: those of its references' evidence, once each."""
    return refs.join(evidence.where("section_id is not null"), ["run_id", "evidence_id"]).select("run_id", "section_id").distinct()


def research_stage(hits: DataFrame, confirmed: DataFrame, passthrough: bool, cap: int, most: int, least: int) -> DataFrame:
    """Pools of issues; passed through, the best ``least`` hits of each alone."""
    from .fusion import research_pool

    if passthrough:
        return hits.where(F.col("rank") <= least).select("issue_id", "chunk_id", F.col("rank").alias("place"))
    return research_pool(hits, confirmed, cap, most, least)


def precedent_stage(cited: DataFrame, cards: DataFrame) -> DataFrame:
    """Per run: cards, and how many came from the fallback."""
    c = precedent_cards(cited, cards)
    return c.groupBy("run_id").agg(F.count("*").alias("cards"), F.count_if("fallback").alias("fallbacks"))


def evidence_from_hits(hits: DataFrame, texts: DataFrame, quote_from: int, quote_size: int) -> DataFrame:
    """A baseline's citations: each hit becomes numbered evidence, a claim and an exact quote of it.

    ``hits`` has query_id, rank, chunk_id. Returns run_id, claim_id, evidence_id, claim_text, quote, text.
    """
    j = hits.join(texts, "chunk_id")
    n = F.format_string("%03d", F.col("rank").cast("int"))
    return j.select(F.col("query_id").alias("run_id"), F.concat(F.lit("C-"), n).alias("claim_id"), F.concat(F.lit("E-"), n).alias("evidence_id"), F.concat(F.lit("It is so: "), F.substring("text", 1, 40)).alias("claim_text"), F.substring("text", quote_from, quote_size).alias("quote"), "text")


def held_analysis(checked: DataFrame) -> DataFrame:
    """Per run: claims, those that verified or were weak, and the evidence IDs the answer may use."""
    ok = F.col("status").isin("verified", "weak")
    return checked.groupBy("run_id").agg(F.count("*").alias("claims"), F.count_if(ok).alias("held"), F.array_sort(F.collect_set(F.when(ok, F.col("evidence_id")))).alias("evidence"))
