"""Queries of lexical and dense retrieval, fusion, evidence graphs and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dense as D, evaluate as V, fusion as U, graph as G, graph_index as N, inverted_index as I, lexical as L
from ..operators.aggregates import lexeme_df as _lexeme_df
from ..session import discard, materialise, release, shared_folder
from .registry import query

c = F.col

#: Oracle side of the unstemmed tokens: words of letters and digits, stop words aside (a query names the ones it needs).
_STOP = ", ".join(f"('{w}')" for w in L.STOP_WORDS)
_WORDS = rf"(SELECT doc_id AS chunk_id, CAST(p AS BIGINT) AS pos, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents)) WHERE w[p] NOT IN (SELECT * FROM (VALUES {_STOP})))"
_POST = f"(SELECT chunk_id, word AS lexeme, count(*) AS tf FROM {_WORDS} GROUP BY ALL)"


def _chunks(t):
    return t.documents.select(c("doc_id").alias("chunk_id"), "text")


@query(f"SELECT lexeme, count(*) AS ndoc FROM {_POST} GROUP BY lexeme")
def lexeme_df(t):
    return _lexeme_df(L.postings(_chunks(t)))


def _stem_sql(words: str) -> str:
    """Word and stem of a table of words: Snowball English, step by step."""
    end = lambda *x: f"regexp_matches(w, '({'|'.join(x)})$')"
    cut = lambda n, new="": f"left(w, -{n}) || '{new}'"
    short = lambda w: f"regexp_matches({w}, '[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$')"
    suffixes = lambda rules, region: " ".join(f"WHEN {end(old)} THEN CASE WHEN length(w) - {len(old)} >= {region} THEN {cut(len(old), new)} ELSE w END" for old, new in rules)
    known = " ".join(f"WHEN word = '{k}' THEN '{v}'" for k, v in L._EXCEPTIONS.items())
    region = lambda x: f"length(regexp_extract({x}, '^.*?[aeiouy][^aeiouy]'))"
    out = f"SELECT word, CASE WHEN length(word) <= 2 THEN word {known} END AS done, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words}"
    out = f"SELECT word, done, w, coalesce(nullif(length(regexp_extract(w, '^(gener|commun|arsen)')), 0), nullif({region('w')}, 0), length(w)) AS r1 FROM ({out})"
    out = f"SELECT word, done, w, r1, coalesce(r1 + nullif({region('substr(w, r1 + 1)')}, 0), length(w)) AS r2 FROM ({out})"
    plural = f"CASE WHEN {end('sses')} THEN {cut(2)} WHEN {end('ied', 'ies')} THEN CASE WHEN length(w) > 4 THEN {cut(2)} ELSE {cut(1)} END WHEN {end('s')} AND NOT {end('us', 'ss')} AND regexp_matches(left(w, -2), '[aeiouy]') THEN {cut(1)} ELSE w END"
    out = f"SELECT word, done, r1, r2, {plural} AS w FROM ({out})"
    whole = ", ".join(f"'{x}'" for x in "inning outing canning herring earring proceed exceed succeed".split())
    out = f"SELECT word, coalesce(done, CASE WHEN w IN ({whole}) THEN w END) AS done, r1, r2, w, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS s FROM ({out})"
    out = f"SELECT *, left(w, length(w) - length(s)) AS p FROM ({out})"
    tail = f"CASE WHEN regexp_matches(p, '(at|bl|iz)$') THEN p || 'e' WHEN regexp_matches(p, '({'|'.join(L._DOUBLES)})$') THEN left(p, -1) WHEN r1 >= length(p) AND {short('p')} THEN p || 'e' ELSE p END"
    past = f"CASE WHEN s = '' THEN w WHEN s IN ('eed', 'eedly') THEN CASE WHEN length(p) >= r1 THEN p || 'ee' ELSE w END WHEN regexp_matches(p, '[aeiouy]') THEN {tail} ELSE w END"
    for step in (
        past,
        f"CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN {cut(1, 'i')} ELSE w END",
        f"CASE {suffixes(L._STEP2, 'r1')} WHEN {end('logi')} AND length(w) - 3 >= r1 THEN {cut(1)} WHEN {end(f'[{L._LI}]li')} AND length(w) - 2 >= r1 THEN {cut(2)} ELSE w END",
        f"CASE {suffixes(L._STEP3, 'r1')} WHEN {end('ative')} AND length(w) - 5 >= r2 THEN {cut(5)} ELSE w END",
        f"CASE {suffixes([(x, '') for x in L._STEP4], 'r2')} WHEN {end('[st]ion')} AND length(w) - 3 >= r2 THEN {cut(3)} ELSE w END",
        f"CASE WHEN {end('e')} AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT {short('left(w, -1)')}) THEN {cut(1)} WHEN {end('ll')} AND length(w) - 1 >= r2 THEN {cut(1)} ELSE w END",
    ):
        out = f"SELECT word, done, r1, r2, {step} AS w FROM ({out})"
    return f"SELECT word, coalesce(done, lower(w)) AS stem FROM ({out})"


def _legal_sql(column: str) -> str:
    out = f"lower({column})"
    for old, new in L.LEGAL:
        out = f"regexp_replace({out}, '{old}', '{new}', 'g')"
    return out


_PARTS = " UNION ALL ".join(
    rf"SELECT doc_id, '{weight}' AS weight, list_filter(regexp_split_to_array({_legal_sql(column)}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents" for column, weight in (("text", "A"), ("source", "B"))
)


@query(
    f"""WITH v AS (SELECT doc_id, weight, w[p] AS word, CAST(p AS BIGINT) AS pos FROM (SELECT doc_id, weight, w, unnest(range(1, len(w) + 1)) AS p FROM ({_PARTS})) WHERE w[p] NOT IN (SELECT * FROM (VALUES {_STOP}))),
    k AS ({_stem_sql('(SELECT DISTINCT word FROM v)')}) SELECT doc_id AS chunk_id, stem AS lexeme, weight, count(*) AS occurrences, min(pos) AS first FROM v JOIN k ON v.word = k.word GROUP BY ALL"""
)
def tsvector(t):
    v = L.tsvector(t.documents.select(c("doc_id").alias("chunk_id"), "text", c("source").alias("header")))
    return v.select("chunk_id", "lexeme", "weight", F.size("positions").cast("long").alias("occurrences"), F.get("positions", 0).cast("long").alias("first"))


@query()
def tsvector_stemmed(t):
    v = L.tsvector(t.documents.where("lang = 'en'").select(c("doc_id").alias("chunk_id"), "text", c("source").alias("header")))
    return v.groupBy("lexeme").agg(F.count_distinct("chunk_id").alias("ndoc"))


#: Queries of three words each: the words 3, 5 and 9 of every 100th document.
def _queries(t):
    w = L.words_of(c("text"))
    return t.documents.where("doc_id % 100 = 0").select(c("doc_id").alias("query_id"), F.array_join(F.array(F.get(w, 2), F.get(w, 4), F.get(w, 8)), " ").alias("query"))


_Q = rf"(SELECT doc_id AS query_id, unnest(list_distinct([w[3], w[5], w[9]])) AS lexeme FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 100 = 0))"
_TERMS = f"(SELECT q.query_id, q.lexeme, s.ndoc AS df, ln(1 + (n.n - s.ndoc + 0.5) / (s.ndoc + 0.5)) AS idf FROM {_Q} q JOIN (SELECT lexeme, count(*) AS ndoc FROM {_POST} GROUP BY 1) s ON q.lexeme = s.lexeme, (SELECT count(*) AS n FROM documents) n)"


#: Indexes that this process has built, by application, folder and the table's time stamp; their files go with the application.
_INDEXES: dict[tuple, str] = {}


def _index(t) -> I.StoredIndex:
    """The stored index of the documents, built at its first use."""
    spark = t._spark
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{t._dir}/documents.parquet")
    stamp = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = spark.sparkContext.applicationId, t._dir, stamp
    if key not in _INDEXES:
        where = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
        I.build_index(_chunks(t), where)
        _INDEXES[key] = where
    return I.StoredIndex(spark, _INDEXES[key])


_EVERY_WORD = r"(SELECT doc_id AS chunk_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS lexeme FROM documents)"


@query(f"SELECT lexeme, count(DISTINCT chunk_id) AS ndoc, count(*) AS occurrences FROM {_EVERY_WORD} GROUP BY lexeme")
def positional_index(t):
    return _index(t).lexemes


def _terms(t, index):
    return L.analyse_terms(L.query_terms(_queries(t)).where("kind = 'terms'"), index.lexemes, index.chunks).where("df > 0").withColumnRenamed("term", "lexeme")


@query(f"SELECT query_id, lexeme AS term, df, round(idf, 6) AS idf FROM {_TERMS}")
def analyse_terms(t):
    return _terms(t, _index(t)).select("query_id", c("lexeme").alias("term"), "df", F.round("idf", 6).alias("idf"))


_ANY = f"""WITH t AS (SELECT *, sum(df) OVER (PARTITION BY query_id ORDER BY df, lexeme ROWS UNBOUNDED PRECEDING) <= 300 AS rare, sum(idf) OVER (PARTITION BY query_id) AS total, count(*) OVER (PARTITION BY query_id) AS n_terms FROM {_TERMS}),
u AS (SELECT *, bool_or(rare) OVER (PARTITION BY query_id) AS any_rare FROM t),
h AS (SELECT u.query_id, p.chunk_id, sum(idf / total) AS coverage, sum(tf) AS tf, bool_or(rare) AS has_rare, bool_or(any_rare) AS any_rare, count(*) AS matched, max(n_terms) AS n_terms FROM u JOIN {_POST} p ON u.lexeme = p.lexeme GROUP BY 1, 2),
s AS (SELECT query_id, chunk_id, round(coverage + 0.1 * tf / (tf + 1), 6) AS score FROM h WHERE CASE WHEN any_rare THEN has_rare ELSE matched = n_terms END)
SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 20"""


@query(_ANY)
def search_any(t):
    index = _index(t)
    return I.search_any(index, _terms(t, index), 20, max_candidates=300)


@query(f"WITH q AS (SELECT DISTINCT query_id, lexeme FROM {_TERMS}), h AS (SELECT q.query_id, p.chunk_id, count(*) AS m, sum(tf) AS tf FROM q JOIN {_POST} p ON q.lexeme = p.lexeme GROUP BY 1, 2) SELECT query_id, rank, chunk_id, score FROM (SELECT h.query_id, h.chunk_id, round(tf * 1.0 / (tf + 1), 6) AS score, row_number() OVER (PARTITION BY h.query_id ORDER BY round(tf * 1.0 / (tf + 1), 6) DESC, h.chunk_id) AS rank FROM h JOIN (SELECT query_id, count(*) AS n FROM q GROUP BY 1) k ON h.query_id = k.query_id WHERE m = n) WHERE rank <= 20")
def search_all(t):
    index = _index(t)
    return I.search_all(index, _terms(t, index), 20)


@query(rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents), q AS (SELECT doc_id AS query_id, w[3] AS a, w[4] AS b FROM d WHERE doc_id % 100 = 0 AND len(w) > 3),
p AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)), h AS (SELECT query_id, doc_id AS chunk_id, count(*) AS tf FROM q JOIN p ON q.a = p.a AND q.b = p.b GROUP BY 1, 2)
SELECT query_id, rank, chunk_id, score FROM (SELECT query_id, chunk_id, round(tf * 1.0 / (tf + 1), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(tf * 1.0 / (tf + 1), 6) DESC, chunk_id) AS rank FROM h) WHERE rank <= 20""")
def search_phrase(t):
    w = L.words_of(c("text"))
    q = t.documents.where((c("doc_id") % 100 == 0) & (F.size(w) > 3)).select(c("doc_id").alias("query_id"), F.posexplode(F.slice(w, 3, 2)).alias("nth", "word"))
    return I.search_phrase(_index(t), q, 20)


@query(f"WITH bad AS (SELECT chunk_id FROM {_POST} WHERE lexeme = 'est'), hit AS (SELECT DISTINCT chunk_id FROM {_POST} WHERE lexeme = 'une') SELECT chunk_id FROM hit WHERE chunk_id NOT IN (SELECT chunk_id FROM bad)")
def exclude_terms(t):
    post = L.postings(_chunks(t))
    one = t._spark.createDataFrame([(1, "une", 1, 1.0)], "query_id long, lexeme string, df long, idf double")
    bad = t._spark.createDataFrame([(1, "est")], "query_id long, lexeme string")
    return L.search_any(post, one, 1_000_000, excluded=bad).select("chunk_id")


# ---- dense ----

_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6)"


def _near(where: str, same: str) -> str:
    return f"SELECT query_id, rank, chunk_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE {where} AND {same}) WHERE rank <= 10"


def _vectors(t):
    return t.embeddings.select(c("vec_id").alias("chunk_id"), "embedding", c("label").alias("label"))


@query(_near("a.vec_id % 100 = 0", "true"))
def cosine_exact(t):
    v = _vectors(t)
    return D.cosine_exact(v, v.where("chunk_id % 100 = 0").select(c("chunk_id").alias("query_id"), "embedding"), 10)


@query(_near("a.vec_id IN (1, 2, 3)", "a.vec_id <> b.vec_id"))
def nearest(t):
    return D.nearest(_vectors(t), [1, 2, 3], 10)


@query(_near("a.vec_id % 100 = 0", "a.vec_id <> b.vec_id"))
def self_join_vectors(t):
    v = _vectors(t)
    return D.cosine_exact(v, v.where("chunk_id % 100 = 0").select(c("chunk_id").alias("query_id"), "embedding"), 10, exclude_self=True)


@query("SELECT count(*) AS vectors FROM embeddings")
def dimension_check(t):
    return D.dimension_check(_vectors(t), 64).where(F.size("embedding") == 64).agg(F.count("*").alias("vectors"))


@query()
def ann_search(t):
    v = _vectors(t)
    q = v.where("chunk_id % 100 = 0").select(c("chunk_id").alias("query_id"), "embedding")
    return D.ann_search(v, q, 10, D.ivf_build(v, 16), 12)


@query()
def recall_at_k(t):
    v = _vectors(t)
    q = v.where("chunk_id % 100 = 0").select(c("chunk_id").alias("query_id"), "embedding")
    return D.recall_at_k(D.ann_search(v, q, 10, D.ivf_build(v, 16), 12), D.cosine_exact(v, q, 10))


def _proximity(t):
    """The graph of the embeddings, written at its first use."""
    spark = t._spark
    key = spark.sparkContext.applicationId, t._dir, "graph"
    if key not in _INDEXES:
        _INDEXES[key] = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
        N.build_graph(_vectors(t), _INDEXES[key])
    return N.load_graph(spark, _INDEXES[key])


@query()
def graph_search(t):
    v = _vectors(t)
    return N.graph_search(_proximity(t), v.where("chunk_id % 100 = 0").select(c("chunk_id").alias("query_id"), "embedding"), 50)


@query()
def graph_recall(t):
    """Recall at 50 and distances of every query, without a filter and with one that a hundredth of the vectors pass."""
    v = _vectors(t)
    q = v.where("chunk_id % 100 = 0").select(c("chunk_id").alias("query_id"), "embedding")
    few = v.where(F.pmod(F.xxhash64("chunk_id"), F.lit(100)) == 0).select("chunk_id")
    parts = []
    for name, allowed in (("all", None), ("filtered", few)):
        exact = D.cosine_exact(v if allowed is None else v.join(allowed, "chunk_id", "left_semi"), q, 50)
        recall = D.recall_at_k(N.graph_search(_proximity(t), q, 50, allowed=allowed), exact)
        parts.append(recall.join(N.graph_search(_proximity(t), q, 50, allowed=allowed, counts=True), "query_id").withColumn("scope", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query()
def encode(t):
    e = D.encode(_chunks(t), D.hash_encoder(32))
    return e.select("chunk_id", F.size("embedding").alias("dim"), F.round(D.dot(c("embedding"), c("embedding")), 4).alias("norm"))


@query()
def embed_missing(t):
    from ..sources.sinks import embed_missing as op

    have = t.documents.where("doc_id % 3 = 0").select(c("doc_id").alias("chunk_id"), F.lit("m").alias("model"))
    return op(_chunks(t), have, "m", D.hash_encoder(16)).select("chunk_id", "model", F.size("embedding").alias("dim"))


# ---- fusion ----

_BEST = "(SELECT query_id, list_name, chunk_id % 60 AS chunk_id, min(rank) AS r FROM ranked WHERE rank <= 80 GROUP BY 1, 2, 3)"
_RRF = f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS rank, chunk_id, score, best_rank FROM (SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS score, min(r) AS best_rank FROM {_BEST} GROUP BY 1, 2)"


def _lists(t):
    return t.ranked.where("rank <= 80").withColumn("chunk_id", c("chunk_id") % 60)


@query(_RRF)
def rrf(t):
    return U.rrf(_lists(t)).drop("ranks")


@query(_RRF.replace("chunk_id, score, best_rank FROM (", "chunk_id AS unit, score, best_rank FROM ("))
def fuse_units(t):
    return U.fuse_units(_lists(t).withColumnRenamed("chunk_id", "unit"))


@query("SELECT query_id, chunk_id, string_agg(list_name || ':' || r, ',' ORDER BY list_name) AS ranks FROM (SELECT query_id, list_name, chunk_id, min(rank) AS r FROM ranked WHERE rank <= 80 GROUP BY 1, 2, 3) GROUP BY 1, 2")
def rank_map(t):
    r = U.rrf(t.ranked.where("rank <= 80"))
    pairs = F.array_sort(F.transform(F.map_entries("ranks"), lambda e: F.concat_ws(":", e.key, e.value.cast("string"))))
    return r.select("query_id", "chunk_id", F.array_join(pairs, ",").alias("ranks"))


@query("SELECT o_custkey AS search_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY k) - 1 AS BIGINT) AS nth, q AS query FROM (SELECT o_custkey, o_orderpriority AS q, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)")
def multi_query(t):
    g = t.orders.groupBy(c("o_custkey").alias("search_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: F.concat(F.lit(" "), s.o_orderpriority)).alias("queries"))
    return U.multi_query(g)


@query("SELECT query_id, chunk_id, arg_min('q' || list_name, rank * 10 + ascii(list_name) - 97) AS best_query FROM ranked GROUP BY 1, 2")
def best_query(t):
    return U.best_query(t.ranked.withColumn("query", F.concat(F.lit("q"), c("list_name"))))


@query("SELECT query_id, chunk_id, new_rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 15 THEN s END DESC NULLS LAST, rank) AS new_rank FROM (SELECT r.*, CAST(length(d.text) % 17 AS DOUBLE) AS s FROM ranked r JOIN documents d ON r.chunk_id = d.doc_id WHERE r.list_name = 'a' AND r.rank <= 40))")
def rerank(t):
    hits = t.ranked.where("list_name = 'a' and rank <= 40").select("query_id", "query_id", "rank", "chunk_id").toDF("query_id", "query", "rank", "chunk_id")
    return U.rerank(hits, _chunks(t), lambda q, x: [float(len(v) % 17) for v in x], 15).select("query_id", "chunk_id", "new_rank")


@query("SELECT section_id, string_agg(chunk_id, ',' ORDER BY char_start, chunk_id) AS chunk_ids FROM chunks GROUP BY section_id")
def section_hits(t):
    s = t.chunks.select("section_id").distinct()
    return U.section_hits(s, t.chunks).select("section_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("SELECT section_id AS doc_id, chunk_id, row_number() OVER (PARTITION BY section_id ORDER BY char_start, chunk_id) AS place FROM chunks")
def chunk_ids(t):
    return U.chunk_ids(t.chunks.drop("doc_id").withColumnRenamed("section_id", "doc_id"))


@query()
def case_by_title(t):
    return U.case_by_title(t.part.select(c("p_partkey").alias("doc_id"), c("p_name").alias("title")), "red widgets").select("doc_id", "title", "similarity")


@query("SELECT p_partkey AS section_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 3) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3)")
def confirm_provision(t):
    prov = t.part.select(c("p_partkey").alias("section_id"))
    sc = t.lineitem.select(c("l_partkey").alias("section_id"), c("l_suppkey").alias("chunk_id")).distinct()
    edges = t.edges.withColumn("target_section_id", c("target_ref"))
    cand = t.orders.where("o_orderkey % 7 = 0").select(c("o_orderkey").alias("doc_id"))
    return U.confirm_provision(prov, sc, t._spark.createDataFrame([(3,)], "chunk_id long"), edges, cand)


_POOL = "SELECT query_id AS issue_id, chunk_id, chunk_id % 20 AS doc_id, rank, 'judgment' AS kind FROM ranked WHERE list_name = 'a'"


@query(
    f"""WITH h AS ({_POOL}), f AS (SELECT *, row_number() OVER (PARTITION BY issue_id, doc_id ORDER BY rank) <= 2 AS fits FROM h), p AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY fits DESC, rank) AS place, sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY issue_id) AS fitting FROM f),
    k AS (SELECT issue_id, chunk_id, rank FROM p WHERE place <= least(25, greatest(fitting, 10))), s AS (SELECT DISTINCT lang AS issue_id, doc_id AS chunk_id FROM documents WHERE doc_id % 90 = 0)
    SELECT issue_id, chunk_id, row_number() OVER (PARTITION BY issue_id ORDER BY tier, rank, chunk_id) AS place FROM (SELECT issue_id, chunk_id, 0 AS tier, chunk_id AS rank FROM s UNION ALL SELECT issue_id, chunk_id, 1, rank FROM k WHERE (issue_id, chunk_id) NOT IN (SELECT issue_id, chunk_id FROM s))"""
)
def research_pool(t):
    s = t.documents.where("doc_id % 90 = 0").select(c("lang").alias("issue_id"), c("doc_id").alias("chunk_id"), c("doc_id").alias("place"))
    return U.research_pool(t.sql(_POOL), s, 2, 25, 10)


@query("SELECT query_id, chunk_id, place FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM ranked WHERE list_name = 'b' AND chunk_id % 3 <> 0) WHERE place <= 12")
def targeted_search(t):
    new, _ = U.targeted_search(t.ranked.where("list_name = 'b'"), t.documents.where("doc_id % 3 = 0").select(c("doc_id").alias("chunk_id")), 12)
    return new.select("query_id", "chunk_id", "place")


_HYB = f"""WITH t AS (SELECT *, sum(idf) OVER (PARTITION BY query_id) AS total FROM {_TERMS}), h AS (SELECT t.query_id, p.chunk_id, sum(idf / total) AS coverage, sum(tf) AS tf FROM t JOIN {_POST} p ON t.lexeme = p.lexeme GROUP BY 1, 2)
SELECT query_id, rank, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coverage + 0.1 * tf / (tf + 1), 6) DESC, chunk_id) AS rank FROM h) WHERE rank <= 100"""


@query(
    f"""WITH lex AS ({_HYB}), den AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id IN (SELECT doc_id FROM documents)),
    u AS (SELECT query_id, chunk_id, rank FROM lex UNION ALL SELECT query_id, chunk_id, rank FROM den WHERE rank <= 100), s AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM u GROUP BY 1, 2)
    SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, chunk_id) AS rank, chunk_id, score, best_rank FROM s) WHERE rank <= 10"""
)
def hybrid_search(t):
    q = _queries(t).join(t.embeddings.select(c("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    return U.hybrid_search(_index(t), _vectors(t), q, 10)


# ---- evidence graphs ----


@query("SELECT run_id, claim_id, CASE status WHEN 'verified' THEN 1.0::DOUBLE WHEN 'weak' THEN 0.5 ELSE 0.0 END AS weight FROM claims")
def edge_weights(t):
    return G.edge_weights(t.claims).select("run_id", "claim_id", "weight")


_SUP = "sup AS (SELECT c.run_id, c.claim_id, c.position_id, c.status, CASE max(CASE x.verification WHEN 'verified' THEN 2 WHEN 'weak' THEN 1 END) WHEN 2 THEN 'verified' WHEN 1 THEN 'weak' ELSE 'none' END AS support FROM claims c LEFT JOIN cites x ON c.run_id = x.run_id AND c.claim_id = x.claim_id GROUP BY ALL)"
_POS = f"{_SUP}, held AS (SELECT DISTINCT run_id, position_id FROM sup WHERE support = 'verified' AND status NOT IN ('falls', 'unsupported'))"


@query(f"WITH {_SUP} SELECT run_id, claim_id FROM sup WHERE support = 'none'")
def orphan_claims(t):
    return G.orphan_claims(t.claims, t.cites)


@query(f"WITH {_SUP} SELECT run_id, claim_id FROM sup WHERE support = 'weak'")
def weak_only_claims(t):
    return G.weak_only_claims(t.claims, t.cites)


@query(f"WITH {_POS} SELECT p.run_id, p.issue_id, p.position_id FROM positions p WHERE (p.run_id, p.position_id) NOT IN (SELECT run_id, position_id FROM held)")
def unverified_positions(t):
    return G.unverified_positions(t.positions, t.claims, t.cites)


@query(f"WITH {_POS} SELECT p.run_id, p.issue_id, count(DISTINCT p.position_id) AS supported FROM positions p JOIN held h ON p.run_id = h.run_id AND p.position_id = h.position_id GROUP BY 1, 2 HAVING count(DISTINCT p.position_id) >= 2")
def contested_issues(t):
    return G.contested_issues(t.positions, t.claims, t.cites)


@query(
    f"""WITH {_POS} SELECT s.run_id, round(orphan_rate, 6) AS orphan_rate, round(weak_only_rate, 6) AS weak_only_rate, round(unverified_rate, 6) AS unverified_rate, round(contested_rate, 6) AS contested_rate FROM
    (SELECT run_id, avg(CASE WHEN support = 'none' THEN 1.0 ELSE 0 END) AS orphan_rate, avg(CASE WHEN support = 'weak' THEN 1.0 ELSE 0 END) AS weak_only_rate FROM sup GROUP BY 1) s JOIN
    (SELECT p.run_id, avg(CASE WHEN h.run_id IS NULL THEN 1.0 ELSE 0 END) AS unverified_rate FROM positions p LEFT JOIN held h ON p.run_id = h.run_id AND p.position_id = h.position_id GROUP BY 1) p ON s.run_id = p.run_id JOIN
    (SELECT i.run_id, avg(CASE WHEN coalesce(k.n, 0) >= 2 THEN 1.0 ELSE 0 END) AS contested_rate FROM issues i LEFT JOIN (SELECT p.run_id, p.issue_id, count(*) AS n FROM positions p JOIN held h ON p.run_id = h.run_id AND p.position_id = h.position_id GROUP BY 1, 2) k ON i.run_id = k.run_id AND i.issue_id = k.issue_id GROUP BY 1) j ON s.run_id = j.run_id"""
)
def graph_rates(t):
    r = G.graph_rates(t.claims, t.positions, t.issues, t.cites)
    return r.select("run_id", *[F.round(x, 6).alias(x) for x in ("orphan_rate", "weak_only_rate", "unverified_rate", "contested_rate")])


@query()
def hints(t):
    s = lambda df: df.withColumn("position_id", c("position_id").cast("string")).transform(lambda d: d.withColumn("issue_id", c("issue_id").cast("string")) if "issue_id" in d.columns else d)
    return G.hints(s(t.positions), s(t.claims), t.cites)


@query("SELECT run_id, claim_id AS source, position_id AS target FROM claims UNION ALL SELECT run_id, evidence_id, claim_id FROM cites")
def support_relation(t):
    a = t.claims.select("run_id", c("claim_id").alias("source"), c("position_id").alias("target"), F.lit("supports").alias("type"))
    b = t.cites.select("run_id", c("claim_id").alias("source"), c("evidence_id").alias("target"), F.lit("cites").alias("type"))
    return G.support_relation(a.unionByName(b))


@query("SELECT o_custkey AS run_id, 1 AS component, x.n AS node FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 50 = 0) o, (VALUES (1), (2), (3)) x(n)".replace("1 AS component", "CAST(1 AS BIGINT) AS component").replace("x.n AS node", "CAST(x.n AS BIGINT) AS node"))
def cycles(t):
    runs = t.orders.select(c("o_custkey").alias("run_id")).distinct()
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("source"), F.lit(b).cast("long").alias("target")) for a, b in ((1, 2), (2, 3), (3, 4), (4, 5), (6, 1))])
    back = runs.where("run_id % 50 = 0").select("run_id", F.lit(3).cast("long").alias("source"), F.lit(1).cast("long").alias("target"))
    return G.cycles(runs.select("run_id", F.inline(pairs)).unionByName(back))


def _graph(t):
    s = lambda x: c(x).cast("string")
    issues = t.issues.select("run_id", F.concat(F.lit("I-"), s("issue_id")).alias("issue_id"), F.lit("Which?").alias("question"))
    pos = t.positions.select("run_id", F.concat(F.lit("P-"), s("position_id")).alias("position_id"), F.concat(F.lit("I-"), s("issue_id")).alias("issue_id"), F.lit("Yes").alias("statement"))
    claims = t.claims.select("run_id", F.concat(F.lit("C-"), s("claim_id")).alias("claim_id"), F.concat(F.lit("P-"), s("position_id")).alias("position_id"), "status", F.lit("text").alias("text"))
    cites = t.cites.select("run_id", F.concat(F.lit("C-"), s("claim_id")).alias("claim_id"), F.concat(F.lit("E-"), s("evidence_id")).alias("evidence_id"), "verification")
    cites = materialise(cites, "cites")
    ev = cites.select("run_id", "evidence_id").distinct().select("run_id", "evidence_id", F.concat(F.lit("D-"), "evidence_id").alias("document_id"), F.lit(None).cast("string").alias("section_id"), F.lit("I-0").alias("issue_id"))
    args = claims.select("run_id", F.concat(F.lit("A-"), "claim_id").alias("argument_id"), "claim_id")
    obj = claims.where("status = 'falls'").select("run_id", F.concat(F.lit("O-"), "claim_id").alias("objection_id"), c("claim_id").alias("target_id"))
    return issues, pos, ev, claims, args, cites.select("run_id", "claim_id", "evidence_id").distinct(), cites.withColumnRenamed("verification", "status"), obj


@query(
    """WITH k AS (SELECT * FROM claims), x AS (SELECT * FROM cites), e AS (SELECT DISTINCT run_id, evidence_id FROM x)
    SELECT type, sum(n) AS n FROM (SELECT 'supports' AS type, 2 * count(*) AS n FROM k UNION ALL SELECT 'about_issue', count(*) FROM positions UNION ALL SELECT 'about_issue', count(*) FROM e JOIN (SELECT DISTINCT run_id FROM issues WHERE issue_id = 0) i ON e.run_id = i.run_id
    UNION ALL SELECT 'quotes', count(*) FROM e UNION ALL SELECT 'cites', count(*) FROM (SELECT DISTINCT run_id, claim_id, evidence_id FROM x) UNION ALL SELECT 'targets', count(*) FROM k WHERE status = 'falls') GROUP BY type""".replace("sum(n) AS n", "CAST(sum(n) AS BIGINT) AS n")
)
def build_graph(t):
    parts = _graph(t)
    _, edges = G.build_graph(*parts)
    return edges.groupBy("type").agg(F.count("*").alias("n"))


#: Claims and citations whose runs' graphs are checked at a time (all runs in turn), so that the disk that shuffles need does not grow with the tables.
CHECKED = 16_000_000


@query("SELECT 'none' AS problem, CAST(0 AS BIGINT) AS n WHERE false")
def check_graph(t):
    parts = _graph(t)
    n = max(1, -(-(parts[3].count() + parts[6].count()) // CHECKED))
    found = None
    for i in range(n):
        some = _problems([p.where(F.pmod(F.xxhash64("run_id"), F.lit(n)) == i) for p in parts])
        found = some if found is None else found.unionByName(some)
        release(found)
    return found.groupBy("problem").agg(F.sum("n").alias("n"))


def _problems(parts):
    nodes, edges = G.build_graph(*parts)
    found = materialise(G.check_graph(nodes, edges, nodes.select("run_id", "type", "id")).groupBy("problem").agg(F.count("*").alias("n")), "problems")
    discard(nodes)
    return found


# ---- evaluation ----


@query(
    """WITH h AS (SELECT q.query_id, q.unit, r.rank FROM qrels q LEFT JOIN (SELECT query_id, chunk_id, rank FROM ranked WHERE list_name = 'b') r ON q.query_id = r.query_id AND q.unit = r.chunk_id), g AS (SELECT query_id, count(*) AS n, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 25) AS h25, count(*) FILTER (rank <= 50) AS h50, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg FROM h GROUP BY 1)
    SELECT query_id, round(h10 * 1.0 / n, 6) AS recall_10, round(h25 * 1.0 / n, 6) AS recall_25, round(h50 * 1.0 / n, 6) AS recall_50, round(h10 / 10.0, 6) AS precision_10, round(coalesce(1.0 / first, 0), 6) AS mrr, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= n), 6) AS ndcg_10 FROM g"""
)
def retrieval_metrics(t):
    return V.retrieval_metrics(t.ranked.where("list_name = 'b'").withColumnRenamed("chunk_id", "unit"), t.qrels)


@query("SELECT chunk_id, CASE WHEN doc_id % 2 = 0 THEN 's' || section_id ELSE 'd' || doc_id END AS unit FROM chunks")
def corpus_unit(t):
    s = F.when(c("doc_id") % 2 == 0, F.concat(F.lit("s"), c("section_id").cast("string")))
    return t.chunks.select("chunk_id", V.corpus_unit(s, F.concat(F.lit("d"), c("doc_id").cast("string"))).alias("unit"))


@query("SELECT experiment, count(*) AS queries, round(avg(v), 6) AS v FROM (SELECT experiment, item, round(avg(value), 4) AS v FROM scores GROUP BY 1, 2) GROUP BY 1")
def evaluate(t):
    m = t.scores.groupBy("experiment", "item").agg(F.round(F.avg("value"), 4).alias("v"))
    return V.macro_means(m.select("experiment", "v"), ["experiment"])


@query("SELECT run_id, round(avg(CASE WHEN ok AND there THEN 1.0 ELSE 0 END), 6) AS citation_validity, round(avg(CASE WHEN there THEN 1.0 ELSE 0 END), 6) AS existence, round(avg(CASE WHEN there THEN CASE WHEN ok THEN 1.0 ELSE 0 END END), 6) AS quote_exact FROM (SELECT turn AS run_id, conv_id % 5 > 0 AS there, conv_id % 3 > 0 AND trim(text) <> '' AS ok FROM conversations) GROUP BY 1")
def citation_validity(t):
    cit = t.conversations.select(c("turn").alias("run_id"), F.concat_ws("/", "conv_id", "turn").alias("evidence_id"), F.when(c("conv_id") % 3 > 0, c("text")).otherwise("@@@").alias("quote"))
    ev = t.conversations.where("conv_id % 5 > 0").select(c("turn").alias("run_id"), F.concat_ws("/", "conv_id", "turn").alias("evidence_id"), "text")
    return V.citation_validity(cit, ev)


_LABELLED = "SELECT l_orderkey % 30 AS run_id, CASE l_linenumber WHEN 1 THEN 'supports' WHEN 2 THEN 'partially_supports' WHEN 3 THEN 'contradicts' WHEN 4 THEN 'does_not_support' END AS label, l_returnflag = 'A' AS gold FROM lineitem"


@query(f"SELECT run_id, round(avg(CASE WHEN label = 'supports' THEN 1.0 ELSE 0 END) FILTER (label IS NOT NULL), 6) AS faithfulness, round(avg(CASE WHEN label IN ('supports', 'partially_supports') THEN 1.0 ELSE 0 END) FILTER (label IS NOT NULL), 6) AS lenient, count(*) FILTER (label IS NULL) AS unjudged FROM ({_LABELLED}) GROUP BY 1")
def citation_faithfulness(t):
    return V.citation_faithfulness(t.sql(_LABELLED))


@query(
    """WITH s AS (SELECT o_custkey AS run_id, o_orderkey AS place FROM orders), r AS (SELECT o.o_custkey AS run_id, o.o_orderkey AS place, bool_or(l.l_suppkey % 4 = 0) AS held, count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_linenumber <= 2 GROUP BY 1, 2)
    SELECT s.run_id, round(avg(CASE WHEN coalesce(r.held, false) THEN 0.0 ELSE 1 END), 6) AS unsupported_claim_rate, round(avg(CASE WHEN r.n IS NULL THEN 1.0 ELSE 0 END), 6) AS uncited FROM s LEFT JOIN r ON s.run_id = r.run_id AND s.place = r.place GROUP BY 1"""
)
def unsupported_claim_rate(t):
    refs = t.lineitem.where("l_linenumber <= 2").groupBy(c("l_orderkey").alias("place")).agg(F.collect_set("l_suppkey").alias("refs"))
    st = t.orders.select(c("o_custkey").alias("run_id"), c("o_orderkey").alias("place")).join(refs, "place", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<bigint>")))
    sup = st.select("run_id", F.explode("refs").alias("evidence_id")).where("evidence_id % 4 = 0").distinct().withColumn("status", F.lit("weak"))
    return V.unsupported_claim_rate(st, sup)


@query(
    """WITH g AS (SELECT DISTINCT l_orderkey AS item, CASE l_linenumber % 3 WHEN 0 THEN 'supporting' WHEN 1 THEN 'contrary' ELSE 'section' END AS kind, l_suppkey AS doc_id, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS hit FROM lineitem)
    SELECT item, round(avg(hit) FILTER (kind = 'supporting'), 6) AS recall_supporting, round(avg(hit) FILTER (kind = 'contrary'), 6) AS recall_contrary, round(avg(hit) FILTER (kind = 'section'), 6) AS recall_section, round(avg(hit), 6) AS recall_all FROM g GROUP BY item"""
)
def authority_recall(t):
    kind = F.when(c("l_linenumber") % 3 == 0, "supporting").when(c("l_linenumber") % 3 == 1, "contrary").otherwise("section")
    g = t.lineitem.select(c("l_orderkey").alias("item"), kind.alias("kind"), c("l_suppkey").alias("doc_id"))
    return V.authority_recall(g, g.where("doc_id % 2 = 0").select("item", "doc_id"))


@query("SELECT l_orderkey AS item, round(avg(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.5 ELSE 0 END), 6) AS coverage FROM lineitem GROUP BY 1")
def key_point_coverage(t):
    v = F.when(c("l_returnflag") == "A", "covered").when(c("l_returnflag") == "R", "partly").otherwise("missing")
    return V.key_point_coverage(t.lineitem.select(c("l_orderkey").alias("item"), v.alias("verdict")))


@query("SELECT juror_id, issue_id, position_id, c1, c2, (c1 + c2) / 2.0 AS rubric FROM ballots")
def quality_rubric(t):
    return V.quality_rubric(t.ballots, ["c1", "c2"])


@query("SELECT c.c_custkey AS run_id, coalesce(k.t, 5) AS tokens, round(coalesce(k.s, 1.5), 2) AS cost_usd, CAST(NULL AS DOUBLE) AS seconds FROM customer c LEFT JOIN (SELECT run_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS t, sum(cost_usd) AS s FROM calls GROUP BY 1) k ON c.c_custkey = k.run_id")
def cost_latency(t):
    totals = t.customer.select(c("c_custkey").alias("run_id"), F.lit(5).cast("long").alias("total_tokens"), F.lit(1.5).alias("total_cost"))
    clock = t._spark.createDataFrame([], "run_id long, seconds double")
    return V.cost_latency(t.calls, totals, clock).withColumn("cost_usd", F.round("cost_usd", 2))


_ITEMS = "SELECT experiment AS grp, item, round(avg(value), 6) AS value FROM scores GROUP BY 1, 2"


@query(
    f"""WITH v AS (SELECT grp, value, row_number() OVER (PARTITION BY grp ORDER BY item) - 1 AS i FROM ({_ITEMS}) WHERE value IS NOT NULL), n AS (SELECT grp, count(*) AS n, avg(value) AS mean FROM v GROUP BY 1),
    d AS (SELECT grp, b, CAST('0x' || substr(md5('3:' || b || ':' || j), 1, 8) AS BIGINT) % n AS i FROM n, range(200) r(b), range(97) s(j) WHERE j < n), m AS (SELECT d.grp, b, avg(v.value) AS m FROM d JOIN v ON d.grp = v.grp AND d.i = v.i GROUP BY 1, 2), r AS (SELECT grp, m, row_number() OVER (PARTITION BY grp ORDER BY m, b) - 1 AS r FROM m)
    SELECT n.grp, n.n, round(n.mean, 6) AS mean, round(max(m) FILTER (r = 5), 6) AS low, round(max(m) FILTER (r = 194), 6) AS high FROM n JOIN r ON n.grp = r.grp GROUP BY 1, 2, 3"""
)
def bootstrap_ci(t):
    return V.bootstrap_ci(t.sql(_ITEMS), "grp", resamples=200, seed=3)


@query(
    """WITH d AS (SELECT o_custkey || '/' || year(o_orderdate) AS grp, (o_orderkey * 37 % 101) - 45.0 AS difference, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) - 1 AS i FROM orders), n AS (SELECT grp, count(*) AS n, abs(sum(difference)) AS seen FROM d GROUP BY 1),
    p AS (SELECT grp, n, seen, unnest(range(1 << n)) AS p FROM n), s AS (SELECT p.grp, p.p, abs(sum(CASE WHEN (p.p >> i) & 1 = 1 THEN difference ELSE -difference END)) AS s FROM p JOIN d ON p.grp = d.grp GROUP BY 1, 2) SELECT n.grp, n.n, count(*) FILTER (s >= seen - 1e-12) * 1.0 / (1 << n.n) AS p_value FROM n JOIN s ON n.grp = s.grp GROUP BY 1, 2"""
)
def sign_flip_p(t):
    grp = F.concat_ws("/", "o_custkey", F.year("o_orderdate"))
    return V.sign_flip_p(t.orders.select(grp.alias("grp"), c("o_orderkey").alias("item"), (c("o_orderkey") * 37 % 101 - 45.0).alias("difference")), "grp")


@query("SELECT tp, fp, fn, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (gold = 1 AND predicted = 1) AS tp, count(*) FILTER (gold <> 1 AND predicted = 1) AS fp, count(*) FILTER (gold = 1 AND predicted <> 1) AS fn FROM pairs)")
def precision_recall_f1(t):
    return V.precision_recall_f1(t.pairs, 1).withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


@query("WITH n AS (SELECT count(*) * 1.0 AS n, count(*) FILTER (gold = predicted) AS s FROM pairs), e AS (SELECT sum(a.n * b.n) AS ab FROM (SELECT gold AS x, count(*) AS n FROM pairs GROUP BY 1) a JOIN (SELECT predicted AS x, count(*) AS n FROM pairs GROUP BY 1) b ON a.x = b.x) SELECT round((s / n - ab / (n * n)) / (1 - ab / (n * n)), 6) AS kappa FROM n, e")
def cohens_kappa(t):
    return V.cohens_kappa(t.pairs)


@query(f"WITH p AS (SELECT gold, label FROM ({_LABELLED})), k AS (SELECT 'strict' AS reading, gold, coalesce(label = 'supports', false) AS predicted FROM p UNION ALL SELECT 'lenient', gold, coalesce(label IN ('supports', 'partially_supports'), false) FROM p), n AS (SELECT reading, count(*) FILTER (gold AND predicted) AS tp, count(*) FILTER (NOT gold AND predicted) AS fp, count(*) FILTER (gold AND NOT predicted) AS fn FROM k GROUP BY 1) SELECT reading, tp, fp, fn, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n")
def coliee_metrics(t):
    p = t.sql(_LABELLED).select("gold", F.coalesce("label", F.lit("none")).alias("predicted"))
    return V.coliee_metrics(p).withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


@query("SELECT metric, round(max(v) FILTER (experiment = 'x'), 6) AS x, round(max(v) FILTER (experiment = 'y'), 6) AS y FROM (SELECT metric, experiment, round(avg(value), 6) AS v FROM scores GROUP BY 1, 2) GROUP BY 1")
def comparison_table(t):
    m = t.scores.groupBy("metric", "experiment").agg(F.round(F.avg("value"), 6).alias("value"))
    return V.comparison_table(m, ["x", "y"])


@query("SELECT experiment, metric, round(avg(v), 6) AS mean, count(v) AS items, CAST(sum(f) AS BIGINT) AS failed_runs FROM (SELECT experiment, metric, item, avg(value) AS v, count(*) FILTER (failed) AS f FROM scores GROUP BY 1, 2, 3) GROUP BY 1, 2")
def summarise(t):
    return V.summarise(t.scores)


@query("SELECT l_orderkey AS run_id, 'a' AS metric, sum(l_quantity) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'b', CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 1")
def score_answer(t):
    return V.score_answer(t.lineitem.groupBy(c("l_orderkey").alias("run_id")).agg(F.sum("l_quantity").alias("a"), F.count("*").alias("b")))


@query("SELECT experiment, metric, item FROM scores WHERE experiment <> 'y' UNION ALL SELECT 'y', 'new', CAST(1 AS BIGINT)")
def results_csv_upsert(t):
    base = t.scores.select("experiment", "metric", "item")
    return V.results_upsert(base, t._spark.createDataFrame([("y", "new", 1)], base.schema))
