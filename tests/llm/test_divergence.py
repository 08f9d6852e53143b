import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import divergence as D


def slow(docs):
    """Term by term, pair by pair, in plain integers."""
    rows = []
    for lang, source, text in docs:
        text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        rows.append((lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)))
    seen, groups = Counter(), defaultdict(Counter)
    for lang, source, words in rows:
        seen.update((lang, w) for w in set(words))
        groups[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), n in seen.items() if x == lang and n >= 30)

        def shares(count):
            below = sum(count[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 1_000_000_000 * (count[w] + 5) // below for w in kept}

        mine = {s: c for (x, s), c in groups.items() if x == lang}
        p = {s: shares(c) for s, c in mine.items()}
        q = shares(sum(mine.values(), Counter()))
        for s in mine:
            pair = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in mine if o != s)
            term = sorted((q[w] - p[s][w], w.encode(), w) for w in kept if mine[s][w] and p[s][w] > q[w])
            out += [(lang, s, "pair", i, -v, r + 1) for r, (v, _, i) in enumerate(pair)]
            out += [(lang, s, "term", i, -v, r + 1) for r, (v, _, i) in enumerate(term[:50])]
    return sorted(out)


def corpus(seed, sources, n):
    rng = random.Random(seed)
    common = ["the", "Zeta", "été", "И", "x1y"]
    docs = []
    for i in range(n):
        s = f"s{int(sources * rng.random() ** 2)}"
        own = [f"w{chr(97 + (hash_ * 7) % 26)}{chr(97 + hash_ % 26)}" for hash_ in (int(s[1:]) % 9, int(s[1:]) // 9)]
        words = [rng.choice(common + own * 2 + ["rare" + chr(97 + rng.randint(0, 25))]) for _ in range(rng.randint(0, 12))]
        docs.append((rng.choice(["en", "de", None]), s, rng.choice([" ", "\n", "-9 "]).join(words)))
    return docs + [("en", None, None), ("en", "silent", ""), ("lone", "one", "word " * 50), ("lone", "two", "few"), (None, None, "THE the"), ("en", "s1", "long" + "the " * 100_000)]


SCHEMA = "lang string, source string, text string, doc_id long, term string, value int"


def frame(spark, docs):
    return spark.createDataFrame([(*d, None, "x", 1) for d in docs], SCHEMA).repartition(6)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("sources, rare", [(5, 16), (40, 16), (90, 3), (90, 60), (90, 0)])
def test_equals_plain_form(spark, sources, rare):
    docs = corpus(sources, sources, 1500)
    assert got(D.divergence(frame(spark, docs), rare)) == slow(docs)


def test_counts_passed_on_early(spark):
    df = frame(spark, corpus(3, 30, 300))
    total = lambda most: sorted(tuple(r) for r in D.term_counts(df, most).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect())
    assert total(5) == total(D.HELD)


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(D, "WIDTH", 4)
    monkeypatch.setattr(D, "SIDE", 7)
    docs = corpus(3, 30, 900)
    assert got(D.divergence(frame(spark, docs))) == slow(docs)


def test_empty_table(spark):
    assert got(D.divergence(frame(spark, corpus(1, 2, 1)).limit(0))) == []


def test_query_equals_duckdb(spark, tmp_path):
    docs = corpus(7, 12, 800)
    df = frame(spark, docs)
    df.write.parquet(str(tmp_path / "d.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet/*.parquet'")
    cur = con.execute(D.ORACLE_SQL)
    assert [d[0] for d in cur.description] == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(cur.fetchall()) == got(D.divergence(df))


def test_terms_are_passed_on_about_once(spark):
    """Documents are dealt by group, so that rows are not groups times tasks."""
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(200)]
    df = frame(spark, [("en", f"s{i % 20}", " ".join(words)) for i in range(400)])
    tasks = max(spark.sparkContext.defaultParallelism, 4)
    counts = D.term_counts(df)
    assert counts.count() <= (20 + tasks) * (len(words) + 1)
    assert counts.where("term = 'aa'").agg(F.sum("n"), F.sum("docs")).first() == (400, 400)
