"""The event log as a stream: order checks and folding with keyed state, live tail, windows and late data."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "run_id string, case_id string, seq bigint, event_id string, ts string, type string, stage string, agent string, payload string"
TERMINAL = {"run_completed": "completed", "run_failed": "failed"}


class FoldError(ValueError):
    """A log that cannot be folded: out of order, of another run or case, or after its end."""


def _settle(view: dict, section: str, key: str, **fields) -> None:
    view.setdefault(section, {})[key] = {**view.get(section, {}).get(key, {}), **fields}


def _stage_started(view, e, p):
    view["current_stage"] = e["stage"]
    _settle(view, "stages", e["stage"], status="passthrough" if p.get("mode") == "passthrough" else "running", reason=None)


def _agent_completed(view, e, p):
    held = view.get("agents", {}).get(e["agent"], {})
    _settle(view, "agents", e["agent"], role=p.get("role"), status="done", cost_usd=p.get("cost_usd"), **{k: held.get(k, 0) + p.get(k, 0) for k in ("input_tokens", "output_tokens")})


def _framed(view, e, p):
    _settle(view, "issues", p["issue"]["id"], **p["issue"])
    for k in ("facts", "assumptions"):
        view[k] = list(dict.fromkeys([*view.get(k, []), *p.get(k, [])]))


def _registered(view, e, p):
    for section, item in (("documents", "document"), ("chunks", "chunk"), ("evidence", "evidence")):
        _settle(view, section, p[item]["id"], **p[item])


def _record(section: str, item: str, key: str = "id"):
    return lambda view, e, p: _settle(view, section, p[item][key], **p[item])


def _update(section: str, key: str, *fields: str):
    def run(view, e, p):
        if p[key] not in view.get(section, {}):
            raise FoldError(f"unknown {section} {p[key]}")
        _settle(view, section, p[key], **{f: p.get(f) for f in fields})

    return run


def _append(section: str, *fields: str):
    return lambda view, e, p: view.setdefault(section, []).append({**{f: p.get(f) for f in fields}, **{k: e[k] for k in ("stage", "agent") if section in ("queries", "validation_failures")}, **({"seq": e["seq"]} if section == "verifications" else {})})


def _whole(section: str, item: str | None = None):
    return lambda view, e, p: view.__setitem__(section, p[item] if item else p)


#: What each type of event does to the state of its run.
RULES = {
    "stage_started": _stage_started,
    "stage_completed": lambda v, e, p: _settle(v, "stages", e["stage"], status=p.get("outcome"), reason=p.get("reason")),
    "agent_started": lambda v, e, p: v.setdefault("agents", {}).__setitem__(e["agent"], {"role": p.get("role"), "status": "running", "model": p.get("model"), "input_tokens": 0, "output_tokens": 0, "cost_usd": None}),
    "agent_completed": _agent_completed,
    "issue_framed": _framed,
    "query_issued": _append("queries", "query", "issue_ids", "kind"),
    "evidence_registered": _registered,
    "claim_created": _record("claims", "claim"),
    "claim_status_changed": _update("claims", "claim_id", "status"),
    "argument_created": _record("arguments", "argument"),
    "counterargument_created": _record("counterarguments", "counterargument"),
    "precedent_card_created": _record("precedent_cards", "card", "document_id"),
    "verification_result": _append("verifications", "claim_id", "evidence_id", "result"),
    "objection_raised": _record("objections", "objection"),
    "objection_answered": _update("objections", "objection_id", "response", "resolved"),
    "unresolved_question_added": _append("unresolved_questions", "question", "issue_id", "from_objection_id"),
    "jury_ballot_cast": _record("jury_ballots", "ballot", "juror_id"),
    "jury_aggregated": _whole("jury_aggregate"),
    "analysis_ready": _whole("analysis", "analysis"),
    "validation_failed": _append("validation_failures", "errors", "dropped"),
    "budget_warning": lambda v, e, p: v.setdefault("budget_warnings", []).append(p),
    "run_failed": lambda v, e, p: v.update(status="failed", error=p.get("reason")),
    "run_completed": lambda v, e, p: v.update(status="completed", totals=p.get("totals")),
}


def fold_events(events: Iterable[dict], view: dict | None = None) -> dict | None:
    """The state of one run after more events (in their order); a redelivered event is passed over.

    Raises FoldError for a log that does not begin with case_created, whose seq does not rise (numbers may be
    missing), that reuses a seq with another event_id, changes run or case, goes on after its end, or updates what
    is not there.
    """
    for e in events:
        p = json.loads(e["payload"]) if isinstance(e["payload"], str) else (e["payload"] or {})
        if view is None:
            if e["type"] != "case_created":
                raise FoldError(f"a log begins with case_created, not {e['type']}")
            view = {"run_id": e["run_id"], "case_id": e["case_id"], "status": "running", **{k: p.get(k) for k in ("question", "profile", "corpus_snapshot_id")}, "seen": {}, "timeline": []}
        else:
            held = view["seen"].get(str(e["seq"]))
            if held == e["event_id"]:
                continue
            if held:
                raise FoldError(f"seq {e['seq']} is {held}, not {e['event_id']}")
            if (e["run_id"], e["case_id"]) != (view["run_id"], view["case_id"]):
                raise FoldError(f"{e['event_id']} is of another run or case")
            if view["timeline"] and e["seq"] <= view["timeline"][-1]["seq"]:
                raise FoldError(f"{e['event_id']} is out of order")
            if view["status"] != "running":
                raise FoldError(f"{e['event_id']} comes after the end")
            if e["type"] not in RULES:
                raise FoldError(f"no rule for {e['type']}")
            RULES[e["type"]](view, e, p)
        view["seen"][str(e["seq"])] = e["event_id"]
        view["timeline"].append({k: e.get(k) for k in ("seq", "event_id", "ts", "type", "stage", "agent")})
    return view


VIEW_SCHEMA = "run_id string, status string, last_seq bigint, events bigint, error string, view string"


def _row(run: str, view: dict | None, error: str | None) -> pd.DataFrame:
    seqs = [t["seq"] for t in view["timeline"]] if view else []
    public = {k: v for k, v in (view or {}).items() if k != "seen"}
    return pd.DataFrame([(run, view["status"] if view else None, seqs[-1] if seqs else None, len(seqs), error, json.dumps(public, sort_keys=True) if view else None)], columns=["run_id", "status", "last_seq", "events", "error", "view"])


def fold(events: DataFrame) -> DataFrame:
    """State of every run of a batch of events, in arrival order (column ``arrival``, else seq); errors as a column.

    A run is one group: a log of some hundreds of events.
    """
    order = "arrival" if "arrival" in events.columns else "seq"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="stable").astype(object).where(pdf.notna(), None).to_dict("records")
        try:
            return _row(key[0], fold_events(rows), None)
        except FoldError as e:
            return _row(key[0], None, str(e))

    return events.groupBy("run_id").applyInPandas(run, VIEW_SCHEMA)


def fold_stream(events: DataFrame) -> DataFrame:
    """The same as a stream: state is kept by run, each micro-batch emits the runs it changed (update mode)."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        view = json.loads(state.get[0]) if state.exists else None
        rows = [r for pdf in batches for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records")]
        error = None
        try:
            view = fold_events(sorted(rows, key=lambda r: r["seq"]), view)
        except FoldError as e:
            error = str(e)
        if view is not None:
            state.update((json.dumps(view),))
        yield _row(key[0], view, error)

    return events.groupBy("run_id").applyInPandasWithState(run, VIEW_SCHEMA, "view string", "update", GroupStateTimeout.NoTimeout)


def stream_of(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, kind: str = "json", files_per_batch: int | None = 1) -> DataFrame:
    """New files of a folder as a stream, so many to a batch (None: all that are there)."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def drain(stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now and return what it emitted, written beside the checkpoint batch by batch.

    A batch that runs again after a failure overwrites its own folder.
    """
    out = f"{checkpoint}-out"
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def live_tail(stream: DataFrame, checkpoint: str, sink) -> "object":
    """Hand each micro-batch of new events, in order of run and seq and once each, to ``sink(frame, batch_id)``.

    Where it left off is in the checkpoint, so a restart goes on behind the last batch.
    """
    once = stream.dropDuplicates(["run_id", "seq", "event_id"])
    return once.writeStream.foreachBatch(lambda df, i: sink(df.orderBy("run_id", "seq"), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after(events: DataFrame, run_id: str, last_seq: int) -> DataFrame:
    """Events of a run behind the last one a listener saw."""
    return events.where((F.col("run_id") == run_id) & (F.col("seq") > last_seq)).orderBy("seq")


def windowed_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and summed values by tumbling window and type; rows later than the watermark are dropped."""
    t = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return t.groupBy(F.window("at", width).alias("w"), "type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "type", "n", "total")


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    t = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return t.groupBy(F.session_window("at", gap).alias("w"), "run_id").agg(F.count("*").alias("n")).select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedupe_stream(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (run_id, seq) once, with state bounded by the watermark."""
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "seq"])
