import json
import random
import time

import pandas as pd
import pytest

from marlstone.streaming import events as S, typed_fold as T
from test_text_units import GOOD, log


def write(spark, folder, rows):
    spark.createDataFrame(rows, S.EVENT_SCHEMA).coalesce(1).write.mode("append").json(str(folder))


def drain(spark, folder, cp):
    with T.typed_state(spark):
        return S.drain(T.fold_changes(S.stream_of(spark, str(folder), S.EVENT_SCHEMA)), "update", str(cp))


def views(df):
    return {r.run_id: (r.status, r.last_seq, r.events, json.loads(r.view)) for r in df.where("error is null").collect()}


def random_log(run, n, rng, end=True):
    kinds = ["case_created"]
    made = 0
    for _ in range(n):
        c = rng.randint(0, 8)
        if c == 0:
            kinds.append(("claim_created", {"claim": {"id": f"C-{made}", "status": "proposed"}}))
            made += 1
        elif c == 1 and made:
            kinds.append(("claim_status_changed", {"claim_id": f"C-{rng.randrange(made)}", "status": rng.choice(["weak", "verified"])}))
        elif c == 2:
            kinds.append(("query_issued", {"query": f"q{rng.randint(0, 9)}", "issue_ids": ["I"], "kind": "x"}))
        elif c == 3:
            kinds.append(("agent_started", {"role": "r", "model": "m"}))
        elif c == 4:
            kinds.append(("agent_completed", {"role": "r", "input_tokens": rng.randint(0, 9), "output_tokens": 2, "cost_usd": None}))
        elif c == 5:
            kinds.append(("issue_framed", {"issue": {"id": f"I-{rng.randint(0, 3)}"}, "facts": [f"f{rng.randint(0, 5)}"], "assumptions": []}))
        elif c == 6:
            kinds.append(("verification_result", {"claim_id": "C", "evidence_id": "E", "result": "weak"}))
        elif c == 7:
            kinds.append(("jury_aggregated", {"majority": rng.randint(0, 3)}))
        else:
            kinds.append(("budget_warning", {"spent": rng.random()}))
    return log(*kinds, *(["run_completed"] if end else []), run=run)


def test_equals_the_batch_fold_and_goes_on_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    logs = [random_log(f"r{i}", rng.randint(0, 30), rng, i % 3 > 0) for i in range(12)]
    for part in range(3):  # three files, each with a further piece of every log and some events of the last again
        rows = [e for x in logs for e in x[max(0, part * len(x) // 3 - (part > 0) * 2) : (part + 1) * len(x) // 3]]
        rng.shuffle(rows)
        write(spark, tmp_path / "in", rows)
        drain(spark, tmp_path / "in", tmp_path / "cp")
    got = views(T.assemble(drain(spark, tmp_path / "in", tmp_path / "cp")))
    want = views(S.fold(spark.createDataFrame([e for x in logs for e in x], S.EVENT_SCHEMA)))
    assert got == want and len(got) == 12


def test_errors_are_told_and_keep_the_state(spark, tmp_path):
    write(spark, tmp_path / "in", log(*GOOD[:4], run="a") + log("stage_started", run="b"))
    write(spark, tmp_path / "in", log("nonsense", run="a", start=5))
    changes = drain(spark, tmp_path / "in", tmp_path / "cp")
    told = {r.run_id: r.value for r in changes.where("section = 'error'").collect()}
    assert "no rule" in told["a"] and "begins with" in told["b"]
    write(spark, tmp_path / "in", log(GOOD[4], run="a", start=6))
    out = {r.run_id: r for r in T.assemble(drain(spark, tmp_path / "in", tmp_path / "cp")).collect()}
    assert out["a"].last_seq == 6 and "C-001" in out["a"].view and out["a"].error and out["b"].status is None


def updates(spark, folder, cp):
    """State rows written in each batch, and rows held after it."""
    with T.typed_state(spark):
        q = T.fold_changes(S.stream_of(spark, str(folder), S.EVENT_SCHEMA)).writeStream.outputMode("update").format("noop").option("checkpointLocation", str(cp)).trigger(availableNow=True).start()
        q.awaitTermination()
    return [(p.stateOperators[0].numRowsUpdated, p.stateOperators[0].numRowsTotal) for p in q.recentProgress if p.stateOperators]


def test_state_written_grows_with_new_events_only(spark, tmp_path):
    rows = log("case_created", *[("query_issued", {"query": "q", "issue_ids": [], "kind": "k"})] * 400, run="long")
    write(spark, tmp_path / "in", rows[:380])
    first = max(u for u, _ in updates(spark, tmp_path / "in", tmp_path / "cp"))
    write(spark, tmp_path / "in", rows[380:390])
    second = max(u for u, _ in updates(spark, tmp_path / "in", tmp_path / "cp"))
    assert first >= 380 and second <= 3 * 10 + 3


def test_ended_runs_expire(spark, tmp_path):
    write(spark, tmp_path / "in", log(*GOOD, run="done"))
    with T.typed_state(spark):
        q = T.fold_changes(S.stream_of(spark, str(tmp_path / "in"), S.EVENT_SCHEMA), retention=1).writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    held = []
    try:
        until = time.time() + 60
        while time.time() < until and not (held and held[-1] < max(held)):
            time.sleep(0.5)
            held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    finally:
        q.stop()
    assert max(held) >= 5 and held[-1] <= 2


def test_a_new_run_asks_no_state_for_entries():
    """Each question to the state is a round trip; a run that begins in the batch has nothing there."""

    class State:
        def __init__(self):
            self.held = {}

        exists = lambda self: False
        update = appendList = lambda self, value: None

        def updateValue(self, key, value):
            self.held[key] = value

        def containsKey(self, key):
            raise AssertionError("asked")

    p = T.FoldProcessor()
    p.head, p.entries, p.items = State(), State(), State()
    rows = random_log("a", 40, random.Random(4))
    (out,) = p.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=[c.split()[0] for c in S.EVENT_SCHEMA.split(", ")])]), None)
    assert not (out["section"] == "error").any() and ("seen", "0") in p.entries.held


def test_setting_comes_back(spark):
    held = spark.conf.get(T._PROVIDER)
    with pytest.raises(KeyError), T.typed_state(spark):
        raise KeyError
    assert spark.conf.get(T._PROVIDER) == held
