"""Queries of the event log, streaming and deliberation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deliberation as B, events as E
from ..session import shared_folder
from ..streaming import events as S, typed_fold as T
from .registry import query

c = F.col

# ---- event log in batch ----


@query("SELECT run_id, seq, 'evt_' || lpad(CAST(seq AS VARCHAR), 6, '0') AS event_id, event_id AS source FROM ev")
def emit(t):
    e = t.ev.select("run_id", "ts_us", c("event_id").alias("source"))
    return E.emit(e, ["ts_us", "source"]).select("run_id", "seq", "event_id", "source")


@query(
    """SELECT run_id, arrival, seq, type, CASE WHEN arrival = 1 AND type <> 'view' THEN 'first event of another type' WHEN seq <= prev THEN 'sequence not rising' END AS problem FROM
    (SELECT run_id, seq AS arrival, type, CASE WHEN event_id % 10 = 0 THEN 1 ELSE seq END AS seq, lag(CASE WHEN event_id % 10 = 0 THEN 1 ELSE seq END) OVER (PARTITION BY run_id ORDER BY seq) AS prev FROM ev) WHERE (arrival = 1 AND type <> 'view') OR seq <= prev"""
)
def order_check(t):
    e = t.ev.select("run_id", F.lit(1).alias("case_id"), c("seq").cast("long").alias("arrival"), F.when(c("event_id") % 10 == 0, 1).otherwise(c("seq")).cast("long").alias("seq"), "type")
    return E.order_check(e, "view")


@query("SELECT run_id, seq, event_id FROM ev")
def idempotent_redelivery(t):
    e = t.ev.select("run_id", "seq", "event_id")
    once, _ = E.idempotent_redelivery(e.unionByName(e.where("event_id % 3 = 0")))
    return once


_STAGED = "SELECT run_id, seq, CASE type WHEN 'click' THEN 'stage_started' WHEN 'view' THEN 'stage_completed' END AS type, 'S' || (event_id % 5) AS stage, CASE WHEN event_id % 4 = 0 THEN 'passthrough' END AS mode, CASE WHEN event_id % 3 = 0 THEN 'skipped' ELSE 'completed' END AS outcome FROM ev WHERE type IN ('click', 'view')"


@query(f"SELECT run_id, stage, max_by(CASE WHEN type = 'stage_started' THEN coalesce(mode, 'running') ELSE outcome END, seq) AS status FROM ({_STAGED}) GROUP BY 1, 2")
def stage_state(t):
    return E.stage_state(t.sql(_STAGED))


_AGENT = "SELECT run_id, seq, CASE type WHEN 'click' THEN 'agent_started' ELSE 'agent_completed' END AS type, 'a' || (event_id % 4) AS agent, event_id % 50 AS input_tokens, event_id % 20 AS output_tokens, value AS cost_usd FROM ev WHERE type IN ('click', 'purchase')"


@query(
    f"""SELECT run_id, agent, CAST(coalesce(sum(input_tokens) FILTER (done), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens) FILTER (done), 0) AS BIGINT) AS output_tokens, max_by(cost_usd, seq) FILTER (done) AS cost_usd, max_by(type, seq) = 'agent_completed' AS done
    FROM (SELECT *, type = 'agent_completed' AND seq > coalesce(max(CASE WHEN type = 'agent_started' THEN seq END) OVER (PARTITION BY run_id, agent), 0) AS done FROM ({_AGENT})) GROUP BY 1, 2"""
)
def agent_tokens(t):
    return E.agent_tokens(t.sql(_AGENT))


_CHANGES = "SELECT l_suppkey AS run_id, l_partkey AS claim_id, l_orderkey * 10 + l_linenumber AS seq, CASE CAST(floor(l_quantity) AS BIGINT) % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'contested' WHEN 2 THEN 'falls' WHEN 3 THEN 'survives' ELSE 'weak' END AS status FROM lineitem"


@query(
    f"""SELECT run_id, claim_id, seq, from_status, status FROM (SELECT *, coalesce(lag(status) OVER (PARTITION BY run_id, claim_id ORDER BY seq), 'proposed') AS from_status FROM ({_CHANGES}))
    WHERE NOT ((from_status IN ('proposed', 'verified', 'weak', 'unsupported') AND status IN ('verified', 'weak', 'unsupported', 'contested')) OR (from_status = 'contested' AND status IN ('survives', 'falls')))"""
)
def claim_lifecycle(t):
    return E.claim_lifecycle(t.sql(_CHANGES))


@query("SELECT run_id, evidence_id AS item, 'not citable' AS problem FROM (SELECT DISTINCT run_id, evidence_id FROM results) WHERE (run_id, evidence_id) NOT IN (SELECT run_id, evidence_id FROM results WHERE status IN ('verified', 'weak')) UNION ALL SELECT DISTINCT o_custkey, o_orderkey, 'issue not analysed' FROM orders WHERE o_orderkey % 9 = 0")
def invariants(t):
    r = t.results
    none = t._spark.createDataFrame([], "run_id long, evidence_id long, quote string, text string")
    iss = t.orders.select(c("o_custkey").alias("run_id"), c("o_orderkey").alias("issue_id"))
    return E.invariants(none.drop("text"), none.drop("quote"), r.select("run_id", "evidence_id").distinct(), r, iss, iss.where("issue_id % 9 <> 0"))


@query(
    """WITH h AS (SELECT run_id, claim_id AS chunk_id, seq, 'I-' || (seq % 2) AS issue_id FROM results), e AS (SELECT run_id, chunk_id, min(seq) AS first FROM h GROUP BY 1, 2)
    SELECT run_id, chunk_id, 'E-' || lpad(CAST(row_number() OVER (PARTITION BY run_id ORDER BY first, chunk_id) AS VARCHAR), 3, '0') AS evidence_id FROM e"""
)
def register_evidence(t):
    h = t.results.select("run_id", c("claim_id").alias("chunk_id"), "seq", F.concat(F.lit("I-"), (c("seq") % 2).cast("string")).alias("issue_id"))
    return E.register_evidence(h).select("run_id", "chunk_id", "evidence_id")


@query("SELECT run_id, claim_id, evidence_id FROM (SELECT DISTINCT run_id, claim_id, evidence_id FROM results WHERE seq > 3) WHERE (run_id, claim_id, evidence_id) NOT IN (SELECT run_id, claim_id, evidence_id FROM results WHERE seq <= 3)")
def pending_citations(t):
    r = t.results
    return E.pending_citations(r.where("seq > 3").withColumn("nth", c("seq")), r.where("seq <= 3")).select("run_id", "claim_id", "evidence_id")


def _cited(t):
    """Citations of conversations: some unknown, some misquoted; the passage's length stands for what a judge says."""
    base = t.conversations
    quote = F.when(c("conv_id") % 5 == 0, "@@@").otherwise(c("text"))
    cit = base.select(c("conv_id").alias("run_id"), c("turn").alias("claim_id"), F.concat_ws("/", "conv_id", "turn").alias("evidence_id"), quote.alias("quote"), F.concat(F.lit("claim "), c("turn").cast("string")).alias("claim_text"))
    ev = base.where("turn % 4 <> 3").select(c("conv_id").alias("run_id"), F.concat_ws("/", "conv_id", "turn").alias("evidence_id"), "text")
    return cit, ev


@query(
    """SELECT conv_id AS run_id, turn AS claim_id, CASE WHEN turn % 4 = 3 THEN 'existence' WHEN conv_id % 5 = 0 OR trim(text) = '' THEN 'quote' END AS failed, CASE WHEN turn % 4 = 3 OR conv_id % 5 = 0 OR trim(text) = '' THEN 'invalid' WHEN length(text) % 3 = 0 THEN 'verified' WHEN length(text) % 3 = 1 THEN 'weak' ELSE 'unsupported' END AS status
    FROM conversations"""
)
def verify(t):
    cit, ev = _cited(t)
    label = lambda claim, text: F.get(F.array(F.lit("supports"), F.lit("partially_supports"), F.lit("contradicts")), F.length(text) % 3)
    return E.verify(cit, ev, label).select("run_id", "claim_id", "failed", "status")


@query("SELECT s_suppkey AS run_id, 'p' AS place, 'One held [E-001]. Two fell. Three stood.' AS text, CAST(1 AS BIGINT) AS flagged FROM supplier")
def final_verify(t):
    texts = t.supplier.select(c("s_suppkey").alias("run_id"), F.lit("p").alias("place"), F.lit("One held [E-1]. Two fell [E-2]. Three stood.").alias("text")).withColumn("text", F.replace("text", F.lit("[E-1]"), F.lit("[E-001]")))
    sup = t.supplier.select(c("s_suppkey").alias("run_id"), F.lit("E-001").alias("evidence_id"), F.lit("verified").alias("status"))
    return E.final_verify(texts, sup)


_CLAIMS = "SELECT o_custkey AS run_id, o_orderkey AS claim_id, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'falls' ELSE 'weak' END AS status FROM orders"


@query(f"SELECT run_id, claim_id, CASE WHEN claim_id % 3 = 0 AND status <> 'falls' THEN 'contested' ELSE status END AS status FROM ({_CLAIMS})")
def contest(t):
    k = t.sql(_CLAIMS)
    return E.contest(k, k.where("claim_id % 3 = 0").select("run_id", c("claim_id").alias("target_id")))


@query(f"SELECT run_id, claim_id, CASE WHEN claim_id % 3 > 0 OR status = 'falls' THEN status WHEN claim_id % 2 = 0 THEN 'falls' WHEN claim_id % 5 = 0 THEN 'contested' ELSE 'survives' END AS status FROM ({_CLAIMS})")
def settle(t):
    k = t.sql(_CLAIMS)
    held = E.contest(k, k.where("claim_id % 3 = 0").select("run_id", c("claim_id").alias("target_id")))
    rep = k.select("run_id", "claim_id", (c("claim_id") % 2 == 0).alias("conceded"), (c("claim_id") % 5 != 0).alias("resolved"))
    return E.settle(held, rep)[0]


@query("SELECT run_id, doc_id, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence_ids FROM (SELECT l_orderkey AS run_id, l_suppkey % 10 AS doc_id, 'E-' || l_suppkey AS evidence_id FROM lineitem WHERE l_suppkey % 3 > 0) GROUP BY 1, 2")
def cited_judgments(t):
    e = t.lineitem.select(c("l_orderkey").alias("run_id"), F.concat(F.lit("E-"), c("l_suppkey").cast("string")).alias("evidence_id"), (c("l_suppkey") % 10).alias("doc_id"), c("l_partkey").alias("chunk_id"), F.when(c("l_suppkey") % 3 > 0, "judgment").otherwise("statute").alias("kind"))
    return E.cited_judgments(e.select("run_id", "evidence_id"), e).select("run_id", "doc_id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("SELECT run_id, evidence_id, CASE max(CASE status WHEN 'verified' THEN 2 WHEN 'weak' THEN 1 END) WHEN 2 THEN 'verified' WHEN 1 THEN 'weak' END AS status FROM results WHERE status IN ('verified', 'weak') GROUP BY 1, 2")
def citable(t):
    r = t.results
    cit = r.select("run_id", "claim_id", "evidence_id", c("seq").alias("nth"), F.lit("q").alias("quote"))
    return E.citable(cit, r).select("run_id", "evidence_id", "status")


@query("SELECT run_id, seq, round(sum(d) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 4) AS due FROM (SELECT run_id, seq, least(2.0, greatest(0.0, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY run_id ORDER BY seq), 0) / 1e6) / 5000) AS d FROM ev)")
def replay(t):
    return E.replay(t.ev, 5000, 2.0).select("run_id", "seq", F.round("due", 4).alias("due"))


@query("SELECT run_id, max_by(type, seq) IN ('purchase', 'error') AS finished FROM ev GROUP BY 1")
def finished(t):
    return E.finished(t.ev, ("purchase", "error"))


@query("SELECT run_id, seq, type FROM ev UNION ALL SELECT run_id, max(seq) + 1, 'run_failed' FROM ev GROUP BY run_id HAVING max_by(type, seq) NOT IN ('purchase', 'error')")
def restore(t):
    return E.restore(t.ev, ("purchase", "error"))


@query("SELECT l_suppkey AS run_id, l_partkey AS evidence_id, count(*) AS citations FROM (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey FROM lineitem) GROUP BY 1, 2")
def evidence_detail(t):
    r = t.lineitem.select(c("l_suppkey").alias("run_id"), c("l_partkey").alias("evidence_id"), c("l_orderkey").alias("claim_id"), c("l_linenumber").alias("seq"), c("l_returnflag").alias("status"))
    cit = r.select("run_id", "claim_id", "evidence_id").distinct().withColumn("quote", F.lit("q"))
    return E.evidence_detail(r.select("run_id", "evidence_id").distinct(), cit, r).select("run_id", "evidence_id", F.size("citations").alias("citations"))


@query("SELECT call_id, max_by(attempt, n * 1000 + attempt) AS attempt, max(n) AS kept FROM (SELECT l_orderkey AS call_id, CAST(l_linenumber AS BIGINT) AS attempt, count(DISTINCT l_suppkey) FILTER (l_suppkey % 3 <> 0) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def drop_keep_best(t):
    a = t.lineitem.groupBy(c("l_orderkey").alias("call_id"), c("l_linenumber").cast("long").alias("attempt")).agg(F.collect_set(c("l_suppkey").cast("string")).alias("items"))
    bad = a.select("call_id", "attempt", F.explode("items").alias("item")).where("cast(item as int) % 3 = 0")
    return E.drop_keep_best(a, bad).select("call_id", "attempt", F.size("items").alias("kept"))


@query("SELECT p_partkey, sha256(p_name) AS key, CASE WHEN s.n IS NOT NULL THEN 'r' END AS response FROM part LEFT JOIN (SELECT DISTINCT p_name AS n FROM part WHERE p_partkey % 4 = 0) s ON part.p_name = s.n")
def response_cache(t):
    req = t.part.select("p_partkey", F.sha2("p_name", 256).alias("key"))
    cache = t.part.where("p_partkey % 4 = 0").select(F.sha2("p_name", 256).alias("key")).distinct().withColumn("response", F.lit("r"))
    return E.response_cache(req, cache)[0].select("p_partkey", "key", "response")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type = 'error' THEN false ELSE false END AS valid FROM events")
def payload_validate(t):
    e = t.events.select("event_id", c("event_type").alias("type"), c("props").alias("payload"))
    return E.payload_json(e, {"click": "k int", "view": "k int", "error": "missing int"}).select("event_id", "valid")


# ---- fold and streams ----


def _logs(t):
    """A log of the fold's own types for each user: created, stages, agents, completed."""
    import json

    n = c("seq")
    kind = F.when(n == 1, "case_created").when(n % 4 == 1, "stage_started").when(n % 4 == 2, "agent_started").when(n % 4 == 3, "agent_completed").otherwise("stage_completed")
    payload = F.when(n == 1, json.dumps({"question": "q", "profile": "p", "corpus_snapshot_id": "s"})).when(n % 4 == 3, F.concat(F.lit('{"role":"judge","input_tokens":'), (c("event_id") % 50).cast("string"), F.lit(',"output_tokens":1,"cost_usd":null}'))).when(n % 4 == 0, '{"outcome":"completed"}').otherwise("{}")
    e = t.ev.select(c("run_id").cast("string").alias("run_id"), F.lit("case").alias("case_id"), n.cast("long").alias("seq"), F.format_string("evt_%06d", n).alias("event_id"), c("ts_us").cast("string").alias("ts"), kind.alias("type"), F.concat(F.lit("S"), (n % 3).cast("string")).alias("stage"), F.lit("a").alias("agent"), payload.alias("payload"))
    return e


_FOLD = """SELECT CAST(e.run_id AS VARCHAR) AS run_id, 'running' AS status, max(seq) AS last_seq, count(*) AS events, CAST(coalesce(sum(event_id % 50) FILTER (seq = s.started + 1), 0) AS BIGINT) AS input_tokens
FROM ev e LEFT JOIN (SELECT run_id, max(seq) AS started FROM ev WHERE seq % 4 = 2 GROUP BY 1) s ON e.run_id = s.run_id GROUP BY e.run_id"""


def _folded(df):
    tokens = F.coalesce(F.get_json_object("view", "$.agents.a.input_tokens").cast("long"), F.lit(0).cast("long"))
    return df.select("run_id", "status", "last_seq", "events", tokens.alias("input_tokens"))


@query(_FOLD)
def fold(t):
    return _folded(S.fold(_logs(t)))


def _stream(t, name, df):
    """The frame as a folder of JSON files and as a stream of it, all files in one batch: none is late because of another."""
    import uuid

    base = f"{shared_folder(t._spark)}/stream-{name}-{uuid.uuid4().hex}"
    df.write.json(f"{base}/in")
    return S.stream_of(t._spark, f"{base}/in", df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), "json", None), base


@query(_FOLD)
def incremental_fold(t):
    s, base = _stream(t, "fold", _logs(t).repartition("run_id"))
    with T.typed_state(t._spark):
        changes = S.drain(T.fold_changes(s), "update", f"{base}/checkpoint")
    return _folded(T.assemble(changes))


@query("SELECT run_id, seq, event_id FROM ev")
def live_tail(t):
    e = t.ev.select("run_id", c("seq").cast("long").alias("seq"), "event_id")
    s, base = _stream(t, "tail", e.unionByName(e.where("event_id % 2 = 0")).repartition(2))
    S.live_tail(s, f"{base}/checkpoint", lambda df, i: df.write.mode("append").parquet(f"{base}/out")).awaitTermination()
    return t._spark.read.schema("run_id long, seq long, event_id long").parquet(f"{base}/out")


@query()
def windowed_counts(t):
    e = t.events.select(c("ts").cast("timestamp").cast("string").alias("ts"), c("event_type").alias("type"), "value")
    s, base = _stream(t, "windows", e)
    return S.drain(S.windowed_counts(s, "1 day"), "append", f"{base}/checkpoint").select(c("start").cast("string").alias("start"), "type", "n", F.round("total", 4).alias("total"))


@query()
def sessions(t):
    e = t.events.select(c("ts").cast("timestamp").cast("string").alias("ts"), c("user_id").alias("run_id"))
    s, base = _stream(t, "sessions", e)
    return S.drain(S.sessions(s), "append", f"{base}/checkpoint").select("run_id", c("start").cast("string").alias("start"), c("end").cast("string").alias("end"), "n")


# ---- deliberation ----


@query("SELECT issue_id, nth, CASE WHEN k = '' THEN 'empty' WHEN again THEN 'repeated' WHEN sum(CASE WHEN NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY issue_id ORDER BY nth) > 3 THEN 'surplus' END AS problem FROM (SELECT o_custkey AS issue_id, o_orderkey AS nth, lower(o_orderpriority) AS k, row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderkey) > 1 AS again FROM orders)")
def framing_dedupe(t):
    i = t.orders.select(c("o_custkey").alias("issue_id"), c("o_orderkey").alias("nth"), F.concat(F.lit(" "), F.replace("o_orderpriority", F.lit(" "), F.lit("  "))).alias("text"))
    return B.framing_dedupe(i, 3).select("issue_id", "nth", "problem")


@query("SELECT o_orderkey AS evidence_id FROM orders WHERE o_orderkey % 2 = 0 OR o_orderstatus = 'P'")
def counsel_candidates(t):
    issues = F.array_compact(F.array(F.when(c("o_orderkey") % 2 == 0, "I-1"), F.when(c("o_orderstatus") == "P", "I-1"), F.lit("I-2")))
    return B.counsel_candidates(t.orders.select(c("o_orderkey").alias("evidence_id"), issues.alias("issue_ids")), "I-1").select("evidence_id")


_THREE = "SELECT l_orderkey AS issue_id, l_suppkey AS evidence_id, l_linenumber % 3 AS tier, CAST(l_linenumber AS BIGINT) AS nth FROM lineitem"


@query(f"SELECT issue_id, evidence_id, row_number() OVER (PARTITION BY issue_id ORDER BY o, evidence_id) AS place FROM (SELECT issue_id, evidence_id, min(tier * 100 + nth) AS o FROM ({_THREE}) WHERE evidence_id % 7 > 0 GROUP BY 1, 2)")
def rebuttal_candidates(t):
    x = t.sql(_THREE)
    return B.rebuttal_candidates(*[x.where(c("tier") == i) for i in range(3)], t.supplier.where("s_suppkey % 7 > 0").select(c("s_suppkey").alias("evidence_id")))


@query(f"SELECT issue_id AS run_id, evidence_id FROM (SELECT issue_id, evidence_id, row_number() OVER (PARTITION BY issue_id ORDER BY min(tier * 100 + nth), evidence_id) AS place FROM ({_THREE}) GROUP BY 1, 2) WHERE place <= 3")
def b2_shown(t):
    x = t.sql(_THREE).withColumnRenamed("issue_id", "run_id")
    return B.shown_evidence(*[x.where(c("tier") == i) for i in range(3)], t.supplier.select(c("s_suppkey").alias("evidence_id")), 3).select("run_id", "evidence_id")


@query("SELECT run_id, count(*) FILTER (status <> 'invalid') AS valid, count(*) AS total, round(count(*) FILTER (status <> 'invalid') * 1.0 / count(*), 6) AS validity FROM results GROUP BY 1")
def citation_counts(t):
    r = t.results.withColumn("failed", F.when(c("status") == "invalid", "quote"))
    return B.citation_counts(r, "run_id").withColumn("validity", F.round("validity", 6))


@query("SELECT run_id, claim_id AS target_id, position_id FROM claims UNION SELECT run_id, -claim_id, position_id FROM claims")
def objection_targets(t):
    return B.objection_targets(t.claims, t.claims.select("run_id", (-c("claim_id")).alias("argument_id"), "claim_id"))


@query("SELECT run_id, position_id, string_agg('O' || claim_id, ',' ORDER BY 'O' || claim_id) AS objections FROM claims WHERE status = 'falls' GROUP BY 1, 2")
def repliers(t):
    k = t.claims
    o = k.where("status = 'falls'").select("run_id", F.concat(F.lit("O"), c("claim_id").cast("string")).alias("objection_id"), c("claim_id").alias("target_id"))
    return B.repliers(o, k.select("run_id", c("claim_id").alias("target_id"), "position_id")).withColumn("objections", F.array_join("objections", ","))


@query("SELECT DISTINCT issue_id AS run_id, juror_id, 'two ballots' AS problem FROM ballots GROUP BY issue_id, juror_id, position_id HAVING count(*) > 1 UNION SELECT issue_id, juror_id, 'unknown position' FROM ballots WHERE position_id % 5 = 0")
def ballot_checks(t):
    b = t.ballots.withColumnRenamed("issue_id", "run_id").withColumn("cited", F.array(F.lit(1)))
    ev = b.select("run_id").distinct().withColumn("evidence_id", F.lit(1))
    return B.ballot_checks(b, b.where("position_id % 5 <> 0").select("run_id", "position_id").distinct(), ev)


@query("SELECT DISTINCT l_orderkey AS run_id, l_suppkey AS doc_id, CASE WHEN l_suppkey % 2 = 0 THEN 'contrary' ELSE 'unknown' END AS fit, l_suppkey % 4 = 0 AS treatment_verified, l_suppkey % 2 > 0 AS fallback FROM lineitem")
def precedent_card(t):
    k = t.lineitem.select(c("l_orderkey").alias("run_id"), c("l_suppkey").alias("doc_id")).distinct()
    return B.precedent_cards(k, k.where("doc_id % 2 = 0").select("run_id", "doc_id", F.lit("contrary").alias("fit"), (c("doc_id") % 4 == 0).alias("treatment_verified")))


@query("SELECT run_id, claim_id, evidence_id, status, CASE WHEN evidence_id % 3 = 0 THEN 'contrary' ELSE 'unknown' END AS fit FROM (SELECT run_id, claim_id, evidence_id, max_by(status, seq) AS status FROM results GROUP BY 1, 2, 3)")
def fit_assessment(t):
    r = t.results
    cit = r.select("run_id", "claim_id", "evidence_id", c("evidence_id").alias("doc_id")).distinct()
    return B.fit_assessment(cit, r, cit.where("doc_id % 3 = 0").select("run_id", "doc_id").distinct().withColumn("fit", F.lit("contrary")))


@query("SELECT DISTINCT run_id, claim_id AS item, evidence_id FROM results WHERE status = 'verified' UNION SELECT DISTINCT run_id, evidence_id, evidence_id FROM results WHERE status = 'verified'")
def judge_resolve(t):
    r = t.results.where("status = 'verified'").withColumns({"claim_id": F.concat(F.lit("C-"), c("claim_id").cast("string")), "evidence_id": F.concat(F.lit("E-"), c("evidence_id").cast("string"))})
    named = r.select("run_id", c("claim_id").alias("item")).unionByName(r.select("run_id", c("evidence_id").alias("item"))).distinct()
    out = B.judge_resolve(named, r.select("run_id", F.lit("A-1").alias("argument_id"), "claim_id", "evidence_id"), r.select("run_id", "evidence_id").distinct())
    return out.select("run_id", *[F.substring_index(x, "-", -1).cast("long").alias(x) for x in ("item", "evidence_id")]).distinct()


@query("SELECT o_custkey AS run_id, o_orderkey AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'not citable' WHEN o_orderkey % 6 = 1 THEN 'one judgment' WHEN o_orderkey % 5 = 0 THEN 'no reason' END AS problem FROM orders")
def conflict_check(t):
    o = t.orders.select(c("o_custkey").alias("run_id"), c("o_orderkey").alias("a"), (-c("o_orderkey")).alias("b"), F.when(c("o_orderkey") % 5 > 0, "why").alias("reason"))
    doc = lambda x: F.when(F.abs(c(x)) % 6 == 1, "same").otherwise(c(x).cast("string"))
    ev = o.select("run_id", c("a").alias("evidence_id"), doc("a").alias("doc_id")).unionByName(o.select("run_id", c("b").alias("evidence_id"), doc("b").alias("doc_id")))
    return B.conflict_check(o, ev, ev.where("evidence_id % 4 <> 0").select("run_id", "evidence_id")).select("run_id", "a", "problem")


@query("SELECT run_id, seq, 'U' || seq AS label FROM ev")
def unresolved_labels(t):
    return B.unresolved_labels(t.ev).select("run_id", "seq", "label")


@query(
    """SELECT p.run_id, p.issue_id, p.position_id, CASE WHEN p.position_id = 3 THEN '' ELSE 'one two' END AS summary, p.position_id = 3 AS gap, coalesce(r.evidence, '') AS evidence FROM positions p LEFT JOIN
    (SELECT k.run_id, k.position_id, string_agg(CAST(x.evidence_id AS VARCHAR), ',' ORDER BY x.o, x.evidence_id) AS evidence FROM (SELECT DISTINCT run_id, position_id FROM claims) k JOIN (SELECT c.run_id, c.position_id, e.evidence_id, min(e.claim_id) AS o FROM claims c JOIN cites e ON c.run_id = e.run_id AND c.claim_id = e.claim_id WHERE e.evidence_id % 3 = 0 GROUP BY 1, 2, 3) x ON k.run_id = x.run_id AND k.position_id = x.position_id GROUP BY 1, 2) r ON p.run_id = r.run_id AND p.position_id = r.position_id"""
)
def build_analysis(t):
    refs = t.claims.join(t.cites.select("run_id", "claim_id", "evidence_id"), ["run_id", "claim_id"]).select("run_id", "position_id", c("evidence_id").cast("string").alias("evidence_id"), c("claim_id").alias("nth"), c("evidence_id").alias("e"))
    refs = refs.groupBy("run_id", "position_id", "evidence_id", "e").agg(F.min("nth").alias("nth")).withColumn("nth", F.struct("nth", "e")).drop("e")
    ok = t.cites.where("evidence_id % 3 = 0").select("run_id", c("evidence_id").cast("string").alias("evidence_id")).distinct().withColumn("doc_id", c("evidence_id"))
    ans = t.positions.where("position_id <> 3").select("run_id", "position_id", F.lit(" one two three").alias("summary"))
    a = B.build_analysis(t.issues, t.positions, ans, refs, ok, 2)
    return a.select("run_id", "issue_id", "position_id", "summary", "gap", F.array_join("evidence", ",").alias("evidence"))


@query("SELECT run_id, issue_id, statement, issue_id || '.' || substr('ABC', CAST(row_number() OVER (PARTITION BY run_id, issue_id ORDER BY md5('5:' || run_id || '/' || issue_id || '/' || statement), statement) AS INTEGER), 1) AS position_id FROM (SELECT s_suppkey AS run_id, 'I-1' AS issue_id, unnest(['Yes', 'No']) AS statement FROM supplier)")
def framing_stage(t):
    i = t.supplier.select(c("s_suppkey").alias("run_id"), F.lit("I-1").alias("issue_id"), F.array(F.lit("Yes"), F.lit("No")).alias("positions"))
    return B.framing_stage(i, 5)


@query("SELECT p.run_id, p.issue_id, p.position_id, coalesce(k.n, 0) AS citations, round(k.ok * 1.0 / k.n, 6) AS validity FROM positions p LEFT JOIN (SELECT c.run_id, c.position_id, count(*) AS n, count(*) FILTER (e % 2 = 0) AS ok FROM (SELECT DISTINCT c.run_id, c.position_id, x.evidence_id AS e FROM claims c JOIN cites x ON c.run_id = x.run_id AND c.claim_id = x.claim_id) c GROUP BY 1, 2) k ON p.run_id = k.run_id AND p.position_id = k.position_id")
def opening_stage(t):
    cit = t.claims.join(t.cites, ["run_id", "claim_id"]).select("run_id", "position_id", "evidence_id", F.lit("q").alias("quote"), (c("evidence_id") % 2 == 0).alias("valid"))
    return B.opening_stage(t.positions, cit).withColumn("validity", F.round("validity", 6))


@query("SELECT p.run_id, p.position_id, string_agg(CAST(k.claim_id AS VARCHAR), ',' ORDER BY k.claim_id DESC) AS targets FROM positions p JOIN claims k ON p.run_id = k.run_id AND p.issue_id = k.issue_id AND p.position_id <> k.position_id WHERE k.claim_id % 4 > 0 GROUP BY 1, 2")
def rebuttal_stage(t):
    k = t.claims.withColumn("strength", c("claim_id"))
    a = B.rebuttal_stage(k, k.where("claim_id % 4 = 0").select("run_id", "claim_id"), t.positions)
    return a.withColumn("targets", F.concat_ws(",", F.transform("targets", lambda x: x.cast("string"))))


@query(
    """WITH o AS (SELECT run_id, claim_id, row_number() OVER (PARTITION BY run_id ORDER BY claim_id % 3 DESC, issue_id, position_id, claim_id) AS nth FROM claims WHERE claim_id % 2 = 0), k AS (SELECT o.*, c.status FROM o JOIN claims c ON o.run_id = c.run_id AND o.claim_id = c.claim_id), h AS (SELECT run_id, claim_id FROM k WHERE nth <= 4 AND status <> 'falls')
    SELECT o.run_id, count(*) AS raised, least(count(*), 4) AS kept, (SELECT count(*) FROM h WHERE h.run_id = o.run_id) AS contested, (SELECT count(*) FROM h WHERE h.run_id = o.run_id AND claim_id % 8 = 0) + (SELECT count(*) FROM claims c WHERE c.run_id = o.run_id AND c.status = 'falls') AS conceded, (SELECT count(*) FROM h WHERE h.run_id = o.run_id AND claim_id % 8 > 0 AND claim_id % 5 > 0) AS surviving, (SELECT count(*) FROM h WHERE h.run_id = o.run_id AND claim_id % 8 > 0 AND claim_id % 5 = 0) AS open FROM o GROUP BY o.run_id"""
)
def cross_exam_stage(t):
    k = t.claims
    o = k.where("claim_id % 2 = 0").select("run_id", c("claim_id").alias("objection_id"), c("claim_id").alias("target_id"), "issue_id", "position_id", (c("claim_id") % 3).alias("severity"))
    rep = k.select("run_id", "claim_id", (c("claim_id") % 8 == 0).alias("conceded"), (c("claim_id") % 5 > 0).alias("resolved"))
    return B.cross_exam_stage(o, k, rep, 4)


@query("SELECT l_orderkey % 20 AS run_id, count(DISTINCT l_suppkey) AS positions, count(DISTINCT l_suppkey) * 2 AS evidence, CAST(3 AS BIGINT) AS verified_first FROM lineitem GROUP BY 1")
def judge_stage(t):
    a = t.lineitem.select((c("l_orderkey") % 20).alias("run_id"), "l_suppkey").distinct().withColumn("evidence", F.array(F.lit(1), F.lit(2)))
    p = a.select("run_id").distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return B.judge_stage(a, p)


@query("SELECT p_partkey AS item, CASE p_partkey % 3 WHEN 2 THEN 'statute' ELSE 'judgment' END AS kind, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'corpus' ELSE 'outside' END WHEN 1 THEN 'unverified' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'corpus' ELSE 'unknown act' END END AS status FROM part")
def authority_resolver(t):
    k = c("p_partkey")
    key = k.cast("string")
    a = t.part.select(k.alias("item"), F.when(k % 3 == 2, "statute").otherwise("judgment").alias("kind"), F.when(k % 3 == 2, F.concat(F.lit("act"), (k % 2).cast("string"))).otherwise(key).alias("canonical"), F.concat(F.lit("zzz"), F.translate(key, "0123456789", "abcdefghij")).alias("title"))
    by = a.where("item % 3 = 0").select("canonical", c("item").alias("doc_id"), "title", (c("item") % 2 == 0).alias("in_corpus"))
    titles = t._spark.createDataFrame([(1, "nothing alike")], "doc_id long, title string")
    return B.authority_resolver(a, by, titles, t._spark.createDataFrame([("act0",)], "act_id string"))


@query("SELECT run_id, claim_id FROM claims WHERE (run_id, claim_id) IN (SELECT run_id, claim_id FROM cites)")
def b1_drop_uncited(t):
    return B.drop_uncited(t.claims, t.cites).select("run_id", "claim_id")


@query("SELECT conv_id AS run_id, turn AS claim_id, CASE WHEN conv_id % 5 = 0 AND trim(text) = '' THEN '@@@' ELSE text END AS quote FROM conversations")
def b1_repair(t):
    cit, _ = _cited(t)
    good = t.conversations.select(c("conv_id").alias("run_id"), c("turn").alias("claim_id"), F.concat_ws("/", "conv_id", "turn").alias("evidence_id"), c("text").alias("quote"))
    return B.repair_quotes(cit, good, good.withColumnRenamed("quote", "text")).select("run_id", "claim_id", "quote")


@query("SELECT run_id, claim_id || ' cites ' || evidence_id || ': quote' AS line FROM results WHERE status = 'invalid'")
def quote_errors(t):
    r = t.results.select("run_id", c("claim_id").cast("string").alias("claim_id"), c("evidence_id").cast("string").alias("evidence_id"), F.when(c("status") == "invalid", "quote").alias("failed"))
    return B.quote_errors(r)


@query(r"SELECT key, doc_id FROM (SELECT lang AS key, doc_id, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS n FROM documents WHERE doc_id % 2 = 0 AND NOT regexp_matches(text, '[^\x00-\x7F]')) WHERE n = 1")
def best_statute_text(t):
    d = t.documents.select("doc_id", F.concat(F.upper("lang"), F.lit(".")).alias("title"), (c("doc_id") % 2 == 0).alias("central"), "text")
    return B.best_statute_text(d)


@query("SELECT nth, selected FROM (SELECT o_orderkey AS nth, o_orderkey % 6 = 0 AS selected, coalesce(sum(CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) WHERE b < 40")
def hc_screening(t):
    o = t.orders.select(c("o_orderkey").alias("nth"), (c("o_orderkey") % 2 == 0).alias("reasoned"), (c("o_orderkey") % 3 == 0).alias("core"))
    return B.screening(o, 40).select("nth", "selected")


@query("SELECT l_orderkey AS item, count(*) AS grades FROM lineitem GROUP BY 1 HAVING max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*) OR min(l_linenumber) <> 1")
def key_point_index_check(t):
    return B.key_point_index_check(t.lineitem.select(c("l_orderkey").alias("item"), c("l_linenumber").alias("nth")))


@query("SELECT s_suppkey AS run_id, 'E-002,E-001,E-009' AS refs FROM supplier")
def analysis_refs(t):
    parts = F.array(F.struct(F.lit(0).alias("place"), F.lit("x [E-2] and [E-1]").alias("text")), F.struct(F.lit(1).alias("place"), F.lit("y [E-001] [E-9]").alias("text")))
    return B.analysis_refs(t.supplier.select(c("s_suppkey").alias("run_id"), F.inline(parts))).withColumn("refs", F.array_join("refs", ","))
