import random

import pytest

from marlstone.llm import near_duplicates as N

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    """Smallest doc_id that links of similarity 0.8 or more reach."""
    ids, sets = sorted(docs), {d: shingles(t) for d, t in docs.items()}
    comp = {d: d for d in ids}
    for _ in ids:
        before = dict(comp)
        for a in ids:
            for b in ids:
                if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            return comp


def corpus():
    rng = random.Random(5)
    new = lambda: f"v{rng.randint(0, 9999)}"
    docs, at = {}, 0
    for family in range(12):
        base = [new() for _ in range(rng.randint(60, 300))]
        for _ in range(10):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                copy[rng.randrange(len(copy))] = new()
            docs[at] = " ".join(copy)
            at += 1
    return docs


@pytest.mark.parametrize("block", [2, 2048])
def test_stage_equals_brute_force_on_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    docs = corpus()
    want = brute(docs)
    assert 12 < len(set(want.values())) < 100
    rows = [(d, t, "en", "s", len(t)) for d, t in docs.items()] + [(None, docs[0], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert dict(N.near_duplicate_classes(df).collect()) == want
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*want.values(), None}
    assert corpus_pipeline.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def test_pairs_are_verified_in_portions(spark, monkeypatch):
    monkeypatch.setattr(N, "PORTION", 1)
    portions, cut = [], N._portions
    monkeypatch.setattr(N, "_portions", lambda *x: portions.append(cut(*x)) or portions[-1])
    docs = corpus()
    rows = [(d, t) for d, t in docs.items()] + [(1000 + d, t) for d, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(docs)
    assert dict(N.near_duplicate_classes(df).collect()) == want | {1000 + d: c for d, c in want.items()}
    assert max(map(len, portions)) > 1


def test_only_tokens_of_several_sets_stay():
    import pyarrow as pa

    rows = [(1, 5, 0), (1, 5, 0), (2, 5, 1), (2, 6, 0), (3, 5, 2), (4, 5, 3), (4, 7, 1), (4, 7, 1), (4, 8, 2), (5, 9, 9)]
    want = [r for r in dict.fromkeys(rows) if r[0] in (2, 4)]
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names=["tok", "sid", "place"]) for i in range(0, len(rows), size)]
        assert [tuple(r.values()) for b in N._shared(iter(batches)) for r in b.to_pylist()] == want
