"""Divergence of sources within a language: exact sums over all kept terms, frequent terms by dense tiles, rare ones by postings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import discard, materialise
from .common import text_batches

#: Documents of a language that a kept term stands in; the smoothing and the scale of p.
LEAST_DOCS, SMOOTH, UNIT = 30, 5, 1_000_000_000
#: Ranks of the part ``term``.
TOP_TERMS = 50
#: A term is rare while it stands in at most so many sources of its language, and in at most a quarter of them.
RARE = 16
#: Sources and terms (about) of a dense tile.
SIDE, WIDTH = 64, 512
#: Distinct (language, source, term) that a task counts before it passes them on.
HELD = 300_000

#: Fixed by the contract: bytes of a term as they are counted; all others part terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters of a whole text, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_BYTES).split()


def term_counts(docs: DataFrame, most: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences), docs; and one row with an empty term for each (lang, source).

    Documents are dealt by ranges of (lang, source, number), so a task has few groups, a large group has many tasks, and a term is
    passed on about once a task. A task passes its counts on when it holds ``most`` of them, so rows may repeat and are to be summed.
    """

    def batch_of(columns) -> pa.RecordBatch:
        lang, source, term, n, df = columns
        arrays = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(df, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    def passed_on(counts) -> Iterator[pa.RecordBatch]:
        columns = [[] for _ in range(5)]
        for (lang, source), (n, d) in counts.items():
            terms = list(n)
            for lo in range(0, len(terms), 20_000):
                part = terms[lo : lo + 20_000]
                for column, more in zip(columns, ([lang] * len(part), [source] * len(part), part, map(n.__getitem__, part), map(d.__getitem__, part))):
                    column += more
                if len(columns[0]) >= 20_000:
                    yield batch_of(columns)
                    columns = [[] for _ in range(5)]
        yield batch_of(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, d = counts.setdefault((lang, source), (Counter({b"": 0}), Counter({b"": 0})))
                words = terms_of(text.as_py())
                was = len(n)
                n.update(words)
                d.update(set(words))
                held += len(n) - was
                if held > most:
                    yield from passed_on(counts)
                    counts, held = {}, 0
        yield from passed_on(counts)

    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    src = docs.select(blank("lang"), blank("source"), blank("text"), F.monotonically_increasing_id().alias("number"))
    # a given count: else AQE would make one task of a small table's texts
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = src.repartitionByRange(tasks, "lang", "source", "number").select("lang", "source", "text")
    return text_batches(dealt).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a term: 1 + floor(UNIT * (count + SMOOTH) / (n + SMOOTH * v)), by exact division of whole numbers; null without kept terms."""
    above = (F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")).cast("decimal(38,0)")
    below = (n + SMOOTH * v).cast("decimal(38,0)")
    whole = F.floor((above - F.pmod(above, below)) / below)
    return F.when(v > 0, 1 + whole.cast("long"))


def _hist_tiles(rows: DataFrame) -> DataFrame:
    """Sum over rare terms of a source a of |p_a - base_b| - |base_a - base_b|, for every source b of the language.

    ``rows`` has lang, a sources' block with its g, base and entries (g, p, times), and another block's g2, base2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                base = dict(zip(r["g"], r["base"]))
                other = np.array(r["base2"], np.int64)
                g2 = np.array(r["g2"], np.int64)
                e = np.array([(x["g"], x["p"], x["times"]) for x in r["entries"]], np.int64)
                for g in np.unique(e[:, 0]).tolist():
                    p, times = e[e[:, 0] == g, 1], e[e[:, 0] == g, 2]
                    d = ((np.abs(p[:, None] - other) - np.abs(base[g] - other)) * times[:, None]).sum(0)
                    out = g2 != g
                    yield _pairs(r["lang"], np.full(out.sum(), g), g2[out], d[out])

    return rows.mapInArrow(run, "lang string, a long, b long, value long")


def _pairs(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(value)], names=["lang", "a", "b", "value"])


def _dense_tiles(rows: DataFrame) -> DataFrame:
    """Sum over a chunk's frequent terms of |p_a - p_b| for all sources a of one block and b of another.

    ``rows`` has lang, width (terms of the chunk), and for both blocks g, base and entries (g, pos, p); a source without a term has its base.
    """

    def tile(g, base, entries, width):
        g = g.values.to_numpy()  # sorted
        m = np.repeat(base.values.to_numpy()[:, None], width, 1)
        if entries.is_valid:
            of, pos, p = (x.to_numpy() for x in entries.values.flatten())
            m[np.searchsorted(g, of), pos] = p
        return g, m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = b.column("block").to_numpy() == b.column("block2").to_numpy()
            of_a, of_b = ([b.column(c + x) for c in ("g", "base", "entries")] for x in ("", "2"))
            for r, (lang, width) in enumerate(zip(b.column("lang").to_pylist(), b.column("width").to_pylist())):
                g, m = tile(*(c[r] for c in of_a), width)
                g2, m2 = (g, m) if same[r] else tile(*(c[r] for c in of_b), width)
                for i in range(len(g)):
                    out = g2 > g[i] if same[r] else np.ones(len(g2), bool)
                    if out.any():
                        yield _pairs(lang, np.full(out.sum(), g[i]), g2[out], np.abs(m2[out] - m[i]).sum(1))

    return rows.mapInArrow(run, "lang string, a long, b long, value long")


def divergence(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """How far the sources of a language use its kept terms differently: lang, source, part, item, value, rank.

    Part ``pair``: for each other source of the language, the sum of |p - q| over all kept terms. Part ``term``: the 50 kept terms
    that a source uses most beyond its language. With V kept terms and base = p of a term that a source lacks,

        sum |p_a - p_b| = dense tiles over frequent terms
                        + for rare terms: V_rare |base_a - base_b|
                        + for a's rare terms: |p_a - base_b| - |base_a - base_b|, and likewise for b's (by their counts of equal p)
                        + for rare terms that both have: |p_a - p_b| - |p_a - base_b| - |p_b - base_a| + |base_a - base_b|,

    and only the last needs pairs of postings, of terms with at most ``rare`` sources each. All are sums of whole numbers. Null text,
    lang and source read ''; repeated rows and null doc_ids are documents of their own; a source without terms, and a language
    without kept ones, have value 0; other columns are ignored; an empty table gives an empty result.
    """
    c = F.col
    # The dealing by (lang, term) serves the sums by source and the document counts by language alike.
    own = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = W.partitionBy("lang", "term")
    own = own.withColumn("df", F.sum("docs").over(by_term)).withColumn("spread", F.count("*").over(by_term)).withColumn("all", F.sum("n").over(by_term))
    kept = materialise(own.where((c("df") >= LEAST_DOCS) | (c("term") == "")), "terms")
    words = kept.where(c("term") != "")
    size = words.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    lang = words.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_distinct("term").alias("v"))
    groups = kept.where(c("term") == "").select("lang", "source").join(size, ["lang", "source"], "left").join(lang, "lang", "left").na.fill(0, ["n_group", "n_lang", "v"])
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("g", number.cast("long")).withColumn("sources", F.count("*").over(W.partitionBy("lang")))
    groups = groups.withColumn("base", share(F.lit(0), c("n_group"), c("v"))).withColumn("block", F.floor(c("g") / SIDE))
    groups = materialise(groups, "groups")

    size_of = groups.select("lang", "source", "g", "block", "n_group", "n_lang", "v", "sources", "base")
    frequent = (c("spread") > rare) | (4 * c("spread") > c("sources"))
    posted = words.join(size_of, ["lang", "source"])
    posted = posted.select("lang", "source", "term", "g", "block", "base", "v", frequent.alias("frequent"), share(c("n"), c("n_group"), c("v")).alias("p"), share(c("all"), c("n_lang"), c("v")).alias("q"))
    posted = materialise(posted, "postings")
    discard(kept)
    sides = groups.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("g", "base"))).alias("s")).select("lang", "block", c("s.g").alias("g"), c("s.base").alias("base"))
    other = sides.toDF("lang", "block2", "g2", "base2")

    # Rare terms: what a source's own postings add for each other source, by equal p; then pairs of postings of one term.
    light = posted.where("not frequent")
    hist = light.groupBy("lang", "block", "g", "p").agg(F.count("*").alias("times"))
    hist = hist.groupBy("lang", "block", F.pmod(F.hash("p"), F.lit(16)).alias("salt")).agg(F.collect_list(F.struct("g", "p", "times")).alias("entries"))
    single = _hist_tiles(hist.drop("salt").join(sides, ["lang", "block"]).join(other, "lang"))
    a, b = (light.select("lang", "term", c("g").alias(f"g_{x}"), c("p").alias(f"p_{x}"), c("base").alias(f"base_{x}")) for x in "ab")
    both = F.abs(c("p_a") - c("p_b")) - F.abs(c("p_a") - c("base_b")) - F.abs(c("p_b") - c("base_a")) + F.abs(c("base_a") - c("base_b"))
    double = a.join(b, ["lang", "term"]).where("g_a < g_b").groupBy("lang", c("g_a").alias("a"), c("g_b").alias("b")).agg(F.sum(both).alias("value"))

    # Frequent terms: tiles of SIDE sources by about WIDTH terms, every block of sources against every later one.
    heavy = posted.where("frequent")
    names = heavy.select("lang", "term").distinct()
    chunks = names.groupBy("lang").agg(F.count("*").alias("n_heavy")).withColumn("chunks", F.floor(c("n_heavy") / WIDTH) + 1)
    pos = F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1
    placed = names.join(chunks, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), c("chunks"))).withColumn("pos", pos).select("lang", "term", "chunk", "pos")
    placed = materialise(placed, "places")
    widths = placed.groupBy("lang", "chunk").agg(F.count("*").alias("width"))
    cells = heavy.join(placed, ["lang", "term"]).groupBy("lang", "chunk", "block").agg(F.collect_list(F.struct("g", "pos", "p")).alias("entries"))
    tiles = materialise(widths.join(sides, "lang").join(cells, ["lang", "chunk", "block"], "left"), "tiles")
    discard(placed)
    later = tiles.select("lang", "chunk", c("block").alias("block2"), c("g").alias("g2"), c("base").alias("base2"), c("entries").alias("entries2"))
    dense = _dense_tiles(tiles.join(later, ["lang", "chunk"]).where("block <= block2"))

    found = single.unionByName(double).unionByName(dense).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    found = found.select("lang", c("a").alias("g"), c("b").alias("g2"), "value").unionByName(found.select("lang", c("b").alias("g"), c("a").alias("g2"), "value"))
    few = groups.select("lang", "source", "g", "base", "v").join(chunks.select("lang", "n_heavy"), "lang", "left").withColumn("v_rare", c("v") - F.coalesce("n_heavy", F.lit(0)))
    peers = groups.select("lang", c("source").alias("item"), c("g").alias("g2"), c("base").alias("base2"))
    pairs = few.join(peers, "lang").where("g <> g2").join(found, ["lang", "g", "g2"], "left")
    baseline = F.coalesce(c("v_rare") * F.abs(c("base") - c("base2")), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (baseline + F.coalesce("value", F.lit(0))).cast("long").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = posted.where("p > q").select("lang", "source", F.lit("term").alias("part"), c("term").alias("item"), (c("p") - c("q")).alias("value"))
    terms = terms.withColumn("rank", rank).where(c("rank") <= TOP_TERMS)
    return pairs.withColumn("rank", rank).unionByName(terms)


ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d), o AS MATERIALIZED (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS n FROM n GROUP BY ALL), l AS (SELECT lang, sum(n) AS n FROM n GROUP BY lang), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(t.n, 0)::HUGEINT + 5 * v.v) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
q AS (SELECT m.lang, m.term, 1 + (1000000000::HUGEINT * (m.n + 5)) // (l.n::HUGEINT + 5 * v.v) AS q FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) m JOIN l USING (lang) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""
