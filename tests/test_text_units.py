"""Hand-computed cases of citations, statutes, cleaning, segmentation, chunks and the fold."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import citations as C, text as X
from marlstone.operators import citation_graph as G, graph as R, structure as T
from marlstone.streaming import events as S


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2023INSC1043", "2023 INSC 1043"),
        ("[1963) 3 S. C. R. 22", "[1963] 3 SCR 22"),
        ("[1963] Supp. 2 SCR 915", "[1963] Supp 2 SCR 915"),
        ("2008 (14) SCR 621", "[2008] 14 SCR 621"),
        ("(1984) 2 sec 112", "(1984) 2 SCC 112"),
        ("1994 Supp (2) SCC 116", "1994 Supp (2) SCC 116"),
        ("(2005) 1 SCC (L & S) 123", "(2005) 1 SCC (L&S) 123"),
        ("A.I.R. (1995) Madras 1", "AIR 1995 Mad 1"),
        ("2021 SCC Online Del 456", "2021 SCC OnLine Del 456"),
        ("(2007) 8 SCALE 110", "(2007) 8 SCALE 110"),
        ("JT2013 (5) SC 142", "JT 2013 (5) SC 142"),
        ("2024 : BHC-OS : 1234", "2024:BHC-OS:1234"),
        ("AIR 1950 Nowhere 3", None),
        ("2021 SCC OnLine Foo 1", None),
        ("page 4 of 9", None),
        (None, None),
    ],
)
def test_citation(raw, want):
    assert C.whole_citation(raw) == want


def test_running_text():
    t = "See [1952] 1 SCR 683 : 1952 INSC 63, AIR 1952 SC 75 and (1999) 2 SCC 3."
    assert [s["canonical"] for s in C.citation_spans(t)] == ["[1952] 1 SCR 683", "1952 INSC 63", "AIR 1952 SC 75", "(1999) 2 SCC 3"]
    assert all(t[s["start"] : s["end"]] == s["raw"] for s in C.citation_spans(t))


def test_cues_and_mentions():
    t = "The rule in AIR 1950 SC 1 was not good law. In AIR 1951 SC 2, which was relied upon, it was so."
    a, b = C.citation_spans(t)
    assert C.cue_near(t, a["start"], a["end"]) == "overruled" and C.cue_near(t, b["start"], b["end"]) == "relied_on"
    m = C.mentioned_sections("under Sections 73(1) and 74 of the Indian Contract Act, 1872 or s. 16 of the Sale of Goods Act")
    assert [(x["section"], x["act"]) for x in m] == [("73", "Indian Contract Act, 1872"), ("74", "Indian Contract Act, 1872"), ("16", "Sale of Goods Act")]


def test_graph_of_a_judgment(spark):
    index = spark.createDataFrame([("1963_1_5_9", "1963  INSC 8"), ("1964_2_7_8", None), ("S_1964_2_7_8", None), ("bad", "x"), ("1963_1_5_9", "1963 INSC 8")], "path string, case_id string")
    docs = spark.createDataFrame(
        [("SC-1964_2_7_8", "[1964] 2 SCR 7 : AIR 1964 SC 70. Following [1963] 1 SCR 5 : AIR 1963 SC 50."), ("D2", "AIR 1963 SC 50 and [1963] 1 SCR 5 = [1964] 2 SCR 7 and AIR 1999 SC 1."), ("D3", None)], "doc_id string, text string"
    ).withColumn("decided", F.to_date(F.lit("1970-01-01")))
    spans, neutral = G.build_index(index)
    assert spans.count() == 3 and neutral.count() == 1
    g = G.direct_targets(G.parallel_groups(G.mentions(docs)), spans, neutral)
    aliases = {r.alias: r.target_ref for r in G.learn_aliases(g).collect()}
    assert aliases == {"AIR 1964 SC 70": "SC-1964_2_7_8", "AIR 1963 SC 50": "SC-1963_1_5_9"}
    e = G.drop_self_citations(G.resolve_edges(g, G.learn_aliases(g)))
    got = {(r.doc_id, r.canonical): (r.target_ref, r.resolution) for r in e.collect()}
    assert got == {
        ("SC-1964_2_7_8", "[1963] 1 SCR 5"): ("SC-1963_1_5_9", "direct"),
        ("SC-1964_2_7_8", "AIR 1963 SC 50"): ("SC-1963_1_5_9", "alias"),
        ("D2", "AIR 1963 SC 50"): ("SC-1963_1_5_9", "alias"),
        ("D2", "[1963] 1 SCR 5"): (None, "conflict"),
        ("D2", "[1964] 2 SCR 7"): (None, "conflict"),
        ("D2", "AIR 1999 SC 1"): (None, None),
    }


def test_legal_text_and_windows(spark):
    one = spark.range(1)
    assert one.select(X.legal_text(F.lit("u/s 55, s. 74, ss. 73-74 and Art. 14"))).first()[0] == "under section 55, section 74, section 73 74 and article 14"
    w = lambda t, n=None: one.select(X.windows(F.lit(t), 3, n)).first()[0]
    assert w("0 1 2 3 4 5 6") == ["0 1 2", "3 4 5", "6"] and len(w("0 1 2 3 4 5 6", 2)) == 2 and w("") == [""]


def test_clean():
    filler = "\n".join(f"Body line {{}} {w} of the page." for w in ("one", "two", "three", "four", "five", "six"))
    pages = [f"REPORTS OF {n}\n" + filler.replace("{}", "abcd"[n - 1]) + f"\nThe con\u00adtract {'abcd'[n - 1]} “was” signed by the plain\u00adtiff.\nA fi xed sum {'wxyz'[n - 1]} of contract money.\n{n}" for n in range(1, 5)]
    r = T.clean_pages(pages, "hc")
    assert r["stats"]["dropped_repeated_header"] + r["stats"].get("dropped_page_number", 0) == 8 and len(r["page_starts"]) == 4
    lines = r["text"].split("\n")
    assert 'The contract a "was" signed by the plaintiff.' in lines and "A fixed sum w of contract money." in lines and not any("REPORTS" in x for x in lines)
    raw = "\f".join(pages)
    back = {x["clean_start"] + k: x["raw_start"] + k for x in r["runs"] for k in range(x["len"])}
    assert len(back) == len(r["text"]) and all(r["text"][i] in (raw[j], "\n", '"') for i, j in back.items())
    sc = T.clean_pages(["1 SUPREME COURT REPORTS [1963]\nA\nHeld so.\nDigitally signed by\nX Y\n17:03:43 IST"], "sc")
    assert sc["text"] == "Held so." and sc["stats"]["dropped_signature"] == 3


def test_segment_and_chunk():
    body = "\n".join(f"{n}. Paragraph number {n} says something of the case." for n in range(1, 13))
    text = "Some court\nA v. B\nJUDGMENT\n" + body
    paras = T.segment_text(text)
    nums = [p["no"] for p in paras if p["numbering"] == "explicit"]
    assert nums == [str(n) for n in range(1, 13)] and paras[0]["section"] == "front"
    assert all(text[p["char_start"] : p["char_end"]] == p["text"] for p in paras)
    chunks = T.chunk_paragraphs("D", text, paras, "A v. B", most=40, tail=5)
    assert all(c["tokens"] <= 40 and text[c["char_start"] : c["char_end"]] == c["text"] for c in chunks) and chunks[-1]["para_end"] == paras[-1]["seq"]


def test_sentences():
    t = "Under s. 10 the Co. Ltd. won. Then A. K. Sen spoke! Done"
    spans = T.sentence_spans(t)
    assert "".join(t[a:b] for a, b in spans) == t and len(spans) == 3
    assert T.split_sentences("He cited X v. Y here. \"Quite so.\" Then it ended.") == ["He cited X v. Y here.", '"Quite so."', "Then it ended."]
    w, hard = T.split_windows("One two three. " * 30, 20, 6)
    assert not hard and all(a < b for a, b in w) and all(x[0] < y[0] for x, y in zip(w, w[1:]))
    assert T.split_windows("word " * 100, 20)[1]


def test_act():
    s = T.split_act_text("1. Short title\n2. Words\n4. Gone [Repealed]\n\n1. Short title.- One.\n2. Words.- Two.\n3. Inserted.- Three.\nSCHEDULE\nx")
    assert [(x["section"], x["repealed"]) for x in s] == [("1", False), ("2", False), ("3", False), ("4", True)]


def log(*types, run="r", start=1):
    out = []
    for i, t in enumerate(types, start):
        kind, payload = t if isinstance(t, tuple) else (t, {})
        out.append({"run_id": run, "case_id": "c", "seq": i, "event_id": f"evt_{i:06d}", "ts": "t", "type": kind, "stage": "S0", "agent": "a", "payload": json.dumps(payload)})
    return out


GOOD = ["case_created", "stage_started", ("agent_started", {"role": "x"}), ("agent_completed", {"role": "x", "input_tokens": 3, "output_tokens": 1, "cost_usd": 0.5}), ("claim_created", {"claim": {"id": "C-001", "status": "proposed"}}), ("claim_status_changed", {"claim_id": "C-001", "status": "verified"}), ("run_completed", {"totals": None})]


def test_fold():
    v = S.fold_events(log(*GOOD))
    assert v["status"] == "completed" and v["claims"]["C-001"]["status"] == "verified" and v["agents"]["a"]["input_tokens"] == 3
    half = S.fold_events(log(*GOOD)[:4])
    assert S.fold_events(log(*GOOD), half) == v  # redelivered events are passed over
    for bad in (log("stage_started"), log("case_created", "run_failed", "stage_started"), log("case_created", ("claim_status_changed", {"claim_id": "C-9", "status": "x"})), log("case_created", "case_created"), log("case_created", "stage_started")[::-1], log("case_created") + log("stage_started", run="s", start=2), log("case_created", "nonsense")):
        with pytest.raises(S.FoldError):
            S.fold_events(bad)


def test_fold_stream_equals_batch(spark, tmp_path):
    rows = log(*GOOD, run="r1") + log(*GOOD[:5], run="r2")
    schema = S.EVENT_SCHEMA
    for i, part in enumerate((rows[:3] + rows[7:9], rows[3:7] + rows[9:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    s = S.stream_of(spark, str(tmp_path / "in"), schema)
    out = S.drain(S.fold_stream(s), "update", str(tmp_path / "cp")).collect()
    last = {}
    for r in out:
        if r.error is None and (r.run_id not in last or r.last_seq > last[r.run_id].last_seq):
            last[r.run_id] = r
    batch = {r.run_id: r for r in S.fold(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (v.status, v.last_seq) for k, v in batch.items()} == {"r1": ("completed", 7), "r2": ("running", 5)}
    assert set(last) == set(batch)


def test_dedupe_stream(spark, tmp_path):
    rows = [("r", 1, "2024-01-01 00:00:00"), ("r", 1, "2024-01-01 00:01:00"), ("r", 2, "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "run_id string, seq long, ts string").coalesce(1).write.json(str(tmp_path / "in"))
    s = S.stream_of(spark, str(tmp_path / "in"), "run_id string, seq long, ts string")
    assert S.drain(S.dedupe_stream(s), "append", str(tmp_path / "cp")).count() == 2


def test_evidence_graph_checks(spark):
    pos = spark.createDataFrame([(1, "I-1", "I-1.A"), (1, "I-1", "I-1.B"), (1, "I-2", "I-2.A"), (1, "I-2", "I-2.B"), (1, "I-2", "I-2.C")], "run_id int, issue_id string, position_id string")
    claims = spark.createDataFrame([(1, "C-1", "I-1.A", "verified"), (1, "C-2", "I-1.B", "weak"), (1, "C-3", "I-1.B", "proposed"), (1, "C-4", "I-2.C", "falls"), (1, "C-5", "I-2.A", "verified"), (1, "C-6", "I-2.B", "survives")], "run_id int, claim_id string, position_id string, status string")
    cites = spark.createDataFrame([(1, "C-1", "verified"), (1, "C-2", "weak"), (1, "C-3", "unsupported"), (1, "C-5", "verified"), (1, "C-6", "verified")], "run_id int, claim_id string, verification string")
    ids = lambda df, k: sorted(r[k] for r in df.collect())
    assert ids(R.orphan_claims(claims, cites), "claim_id") == ["C-3", "C-4"] and ids(R.weak_only_claims(claims, cites), "claim_id") == ["C-2"]
    assert ids(R.unverified_positions(pos, claims, cites), "position_id") == ["I-1.B", "I-2.C"]
    assert ids(R.contested_issues(pos, claims, cites), "issue_id") == ["I-2"]
    assert sorted(r.hint for r in R.hints(pos, claims, cites).collect()) == ["I-1.B has no verified support.", "I-2 is contested: I-2.A, I-2.B rest on verified evidence.", "I-2.C has no verified support."]
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "c", "c"), (1, "d", "a"), (1, "b", "e")], "run_id int, source string, target string")
    assert sorted((r.component, r.node) for r in R.cycles(e).collect()) == [("a", "a"), ("a", "b"), ("c", "c")]
