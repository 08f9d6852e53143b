"""Queries of scalar functions, citations and document structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C, metadata as M, text as X
from ..operators import aggregates as A, citation_graph as G, structure as T
from ..session import materialise, spread, text_batches
from .registry import query

c = F.col
_WS = r"regexp_replace({}, '\s+', ' ', 'g')"


@query(r"""SELECT doc_id, trim(regexp_replace(translate('“' || text || '’  ', '‘’‚‛′“”„‟″«»', '''''''''''"""""""'), '[\\s]+', ' ', 'g')) AS quote FROM documents""")
def normalise_quote(t):
    return t.documents.select("doc_id", X.normalise_quote(F.concat(F.lit("“"), c("text"), F.lit("’  "))).alias("quote"))


_STRAIGHT = r"trim(regexp_replace(translate({}, '‘’‚‛′“”„‟″«»', '{}'), '[\s]+', ' ', 'g'))".format("{}", "''" * 5 + '"' * 7)


@query(f"SELECT doc_id, doc_id % 3 > 0 AND {_STRAIGHT.format('substr(text, 20, 30)')} <> '' AND contains({_STRAIGHT.format('text')}, {_STRAIGHT.format('substr(text, 20, 30)')}) AS found FROM documents")
def quote_in_text(t):
    q = F.when(c("doc_id") % 3 > 0, F.substring("text", 20, 30)).otherwise("@@ not there @@")
    return t.documents.select("doc_id", X.quote_in_text(q, c("text")).alias("found"))


@query("SELECT p_partkey, 'under section ' || p_size || ', section ' || p_size || ' and article ' || p_size || ' ' || p_size || ' x' AS legal FROM part")
def legal_text(t):
    n = c("p_size").cast("string")
    return t.part.select("p_partkey", X.legal_text(F.concat(F.lit("u/s "), n, F.lit(", s. "), n, F.lit(" and Art. "), n, F.lit("-"), n, F.lit(" x"))).alias("legal"))


@query("SELECT p_partkey, p_name AS title FROM part")
def header_title(t):
    return t.part.select("p_partkey", X.header_title(F.concat("p_name", F.lit(" — paras 3–4"))).alias("title"))


@query(r"SELECT doc_id, round(CASE WHEN len(regexp_extract_all(text, '\p{L}')) = 0 THEN 0 ELSE len(regexp_extract_all(text, '[A-Za-z]')) * 1.0 / len(regexp_extract_all(text, '\p{L}')) END, 6) AS latin_ratio FROM documents")
def latin_ratio(t):
    return t.documents.select("doc_id", F.round(X.latin_ratio(c("text")), 6).alias("latin_ratio"))


@query(r"""SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]+[!{}|~\\^`@#$%*<>\[\]]+[A-Za-z]+'))) * 1.0 / len(w) END, 6) AS ocr_noise FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS w FROM documents)""")
def ocr_noise(t):
    return t.documents.select("doc_id", F.round(X.ocr_noise(c("text")), 6).alias("ocr_noise"))


@query("SELECT p_partkey, CAST(1 + p_size % 2 AS BIGINT) AS mentions, p_size || ',' || (p_size + 1) AS refs FROM part")
def act_signal(t):
    a, b = c("p_size").cast("string"), (c("p_size") + 1).cast("string")
    text = F.concat(F.lit("under Sections "), a, F.lit(" and "), b, F.lit(" of the Indian Contract Act it was held"), F.when(c("p_size") % 2 == 1, F.lit("; the Contract Act applies")).otherwise(F.lit("")))
    act = r"\b(?:Indian\s+)?Contract\s+Act\b"
    return t.part.select("p_partkey", X.act_mentions(text, "(?i)" + act).alias("mentions"), F.array_join(X.act_section_refs(text, act), ",").alias("refs"))


@query("SELECT p_partkey, '2001/' || p_size || '/7;1999/2/3' AS found FROM part WHERE p_size > 0")
def cited_sc_authorities(t):
    n = c("p_size").cast("string")
    text = F.concat(F.lit("see (2001) "), n, F.lit(" SCC 7, (1999) 2 SCC 3 and (2001) "), n, F.lit(" SCC 7"))
    found = X.cited_authorities(text, "scc")
    return t.part.where("p_size > 0").select("p_partkey", F.array_join(F.reverse(found), ";").alias("found"))


@query("SELECT p_partkey, '(1984) ' || p_size || ' SCC 112' AS canonical FROM part WHERE p_size BETWEEN 1 AND 99")
def normalise_citation(t):
    return t.part.where("p_size between 1 and 99").select("p_partkey", C.normalise_citation(F.concat(F.lit("(1984] "), c("p_size").cast("string"), F.lit(" sec 112."))).alias("canonical"))


@query("SELECT p_partkey, CAST(nth AS BIGINT) AS nth, canonical FROM (SELECT p_partkey, 0 AS nth, '[1963] ' || p_size || ' SCR 22' AS canonical FROM part WHERE p_size BETWEEN 1 AND 99 UNION ALL SELECT p_partkey, 1, 'AIR 1965 SC ' || (p_partkey % 99999 + 1) FROM part WHERE p_size BETWEEN 1 AND 99)")
def find_citations(t):
    text = F.concat(F.lit("as held in [1963) "), c("p_size").cast("string"), F.lit(" S.C.R. 22 and A.I.R. 1965 S.C. "), (c("p_partkey") % 99999 + 1).cast("string"), F.lit(", we agree"))
    f = t.part.where("p_size between 1 and 99").select("p_partkey", F.posexplode(C.find_citations(text)).alias("nth", "s"))
    return f.select("p_partkey", "nth", "s.canonical")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Bom' WHEN 1 THEN 'J&K' END AS court FROM nation")
def air_court(t):
    name = F.get(F.array(F.lit("Bombay"), F.lit("J. & K."), F.lit("Atlantis")), c("n_nationkey") % 3)
    return t.nation.select("n_nationkey", C.air_court(name).alias("court"))


def _acts(t):
    return t._spark.createDataFrame([("contract_act", 1872, ["ICA", "Indian Contract Act, 1872", "Contract Act"], "1872-09-01"), ("specific_relief_act", 1963, ["SRA", "Specific Relief Act"], "1964-03-01")], "act_id string, year int, names array<string>, commencement string").withColumn("commencement", c("commencement").cast("date"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'contract_act' WHEN 1 THEN 'specific_relief_act' END AS act_id FROM part")
def resolve_act(t):
    name = F.get(F.array(F.lit("the Indian Contract Act, 1872"), F.lit("SRA"), F.lit("Specific Relief Act, 1877"), F.lit("Sale Act")), (c("p_partkey") % 4).cast("int"))
    return C.resolve_act(t.part.select("p_partkey", name.alias("act")), _acts(t)).select("p_partkey", "act_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'contract_act' END AS act_id, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS VARCHAR) END AS section, CASE WHEN p_partkey % 3 = 0 THEN '(1)' END AS sub_section FROM part")
def parse_provision(t):
    n = c("p_size").cast("string")
    ref = F.get(F.array(F.concat(F.lit("Section "), n, F.lit(" (1) of the Contract Act")), F.concat(F.lit("ICA s. "), n), F.concat(F.lit("s. "), n, F.lit(" of nothing"))), (c("p_partkey") % 3).cast("int"))
    return C.parse_provision(t.part.select("p_partkey", ref.alias("reference")), _acts(t)).select("p_partkey", "act_id", "section", "sub_section")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS n, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END AS s FROM part")
def section_key(t):
    k = X.natural_key(F.concat(c("p_size").cast("string"), F.when(c("p_partkey") % 2 == 0, "A").otherwise("")))
    return t.part.select("p_partkey", k.alias("k")).select("p_partkey", "k.n", "k.s")


@query("SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN list_transform(range(p_size, p_size + 4), lambda x: CAST(x AS VARCHAR)) ELSE [p_size || 'A'] END) AS section FROM part")
def expand_range(t):
    n = c("p_size")
    spec = F.when(c("p_partkey") % 2 == 0, F.concat_ws("-", n.cast("string"), (n + 3).cast("string"))).otherwise(F.concat(n.cast("string"), F.lit("A")))
    return t.part.select("p_partkey", F.explode(X.expand_range(spec)).alias("section"))


@query("SELECT s_suppkey, 'RFA/' || s_suppkey || '/2016' AS number, s_name AS petitioner, 'State' AS respondent FROM supplier")
def split_title(t):
    number, a, b = M.split_title(F.concat(F.lit("RFA/"), c("s_suppkey").cast("string"), F.lit("/2016 of "), c("s_name"), F.lit("  Vs.  State.")))
    return t.supplier.select("s_suppkey", number.alias("number"), a.alias("petitioner"), b.alias("respondent"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'VALMIKI J. ' || replace(n_name, '_', ' ') AS first, CAST(2 AS BIGINT) AS judges FROM nation")
def split_judges(t):
    name = F.concat(F.lit("HON’BLE MR. JUSTICE VALMIKI J. "), F.replace(c("n_name"), F.lit("_"), F.lit(" ")), F.lit(", J., J.L.KAPUR and J. L. Kapur, JJ."))
    return t.nation.select("n_nationkey", F.get(M.split_judges(name), 0).alias("first"), F.size(M.split_judges(name)).alias("judges"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'A.P. SEN|L.M. SHARMA' AS bench FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT CAST(n_nationkey AS BIGINT), NULL FROM nation WHERE n_nationkey % 2 = 1")
def bench_from_text(t):
    text = F.when(c("n_nationkey") % 2 == 0, "heading\n[A.P. SEN AND L.M. SHARMA, JJ.]\nbody").otherwise("[Per SEN, J.] no bench")
    return t.nation.select("n_nationkey", F.array_join(M.bench_from_text(text), "|").alias("bench"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Supreme Court of India' WHEN 1 THEN 'High Court of Bombay' WHEN 2 THEN 'National Company Law Tribunal' END AS court, CASE n_nationkey % 4 WHEN 0 THEN 'supreme_court' WHEN 1 THEN 'high_court' WHEN 2 THEN 'tribunal' END AS level FROM nation")
def canonical_court(t):
    name = F.get(F.array(F.lit("IN THE SUPREME COURT"), F.lit("Bombay High Court"), F.lit("NCLT, Mumbai"), F.lit("District Judge of Delhi City")), c("n_nationkey") % 4)
    court, level = M.canonical_court(name)
    return t.nation.select("n_nationkey", court.alias("court"), level.alias("level"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'allowed' WHEN 1 THEN 'partly_allowed' WHEN 2 THEN 'dismissed' WHEN 3 THEN 'remanded' END AS disposition FROM orders")
def normalise_disposition(t):
    v = F.get(F.array(F.lit("Appeal(s) allowed"), F.lit("Allowed in part"), F.lit("DISMISSED"), F.lit("Matter remitted"), F.lit("JUDGEMENT")), (c("o_orderkey") % 5).cast("int"))
    return t.orders.select("o_orderkey", M.normalise_disposition(v).alias("disposition"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'A.B. ROY|C. DAS' AS coram, 'C. DAS' AS author, n_name || ' & Co' AS case_number, CAST(2 AS BIGINT) AS bench_size FROM nation")
def parse_sc_card(t):
    html = F.concat(F.lit("<strong>Coram : A.B. ROY, C. DAS<sup>*</sup></strong><span>Case No : </span><font color='x'> "), c("n_name"), F.lit(" &amp; Co</font><span>Bench : </span><font>2 Judges</font>"))
    p = t.nation.select("n_nationkey", M.parse_card(html).alias("p"))
    return p.select("n_nationkey", F.array_join("p.coram", "|").alias("coram"), "p.author", "p.case_number", "p.bench_size")


_W = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{3,}}'))"


@query(f"SELECT p_partkey, round(len(list_intersect({_W.format('p_name')}, {_W.format('p_type || chr(32) || p_name')})) * 1.0 / greatest(1, least(len({_W.format('p_name')}), len({_W.format('p_type || chr(32) || p_name')}))), 6) AS overlap FROM part")
def title_overlap(t):
    return t.part.select("p_partkey", F.round(X.title_overlap(c("p_name"), F.concat_ws(" ", "p_type", "p_name")), 6).alias("overlap"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS same FROM part")
def same_parties(t):
    other = F.when(c("p_partkey") % 2 == 0, F.concat(c("p_name"), F.lit(" Ltd"))).otherwise("State of Union Ltd")
    return t.part.select("p_partkey", X.same_parties(F.concat(F.lit("The State versus "), c("p_name")), other).alias("same"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS comparable FROM customer")
def comparable(t):
    return t.customer.select("c_custkey", X.comparable(c("c_name")).alias("comparable"))


@query()
def word_similarity(t):
    return t.part.select("p_partkey", F.round(X.word_similarity(F.lit("red widget"), c("p_name")), 6).alias("similarity"))


@query("SELECT df, round(ln(1 + (1000 - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT DISTINCT l_suppkey AS df FROM lineitem)")
def idf(t):
    return t.lineitem.select(c("l_suppkey").alias("df")).distinct().select("df", F.round(X.idf(c("df"), F.lit(1000)), 6).alias("idf"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN 'claim ' || s_suppkey ELSE 'E-' || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END END AS id FROM supplier")
def clean_record_id(t):
    n = c("s_suppkey").cast("string")
    raw = F.get(F.array(F.concat(F.lit(" [e-0"), n, F.lit("] ")), F.concat(F.lit("E"), n), F.concat(F.lit("(E - "), n, F.lit(")")), F.concat(F.lit("claim "), n)), (c("s_suppkey") % 4).cast("int"))
    return t.supplier.select("s_suppkey", X.clean_record_id(raw, "E").alias("id"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 's. ' || p_size WHEN 1 THEN 'para ' || p_size WHEN 2 THEN 'pp. ' || p_size || '-' || (p_size + 1) ELSE p_name END AS pinpoint FROM part")
def pinpoint(t):
    n, k = c("p_size"), c("p_partkey") % 4
    return t.part.select("p_partkey", X.pinpoint(F.when(k == 0, n.cast("string")), F.when(k == 1, n), F.when(k == 1, n), F.when(k == 2, n), F.when(k == 2, n + 1), c("p_name")).alias("pinpoint"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN 'E-007' ELSE 'E-007,E-' || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END END AS refs FROM supplier")
def inline_refs(t):
    text = F.concat(F.lit("held [E-7] and [ e"), c("s_suppkey").cast("string"), F.lit("], again [E-007]"))
    return t.supplier.select("s_suppkey", F.array_join(X.inline_refs(text), ",").alias("refs"))


@query("SELECT s_suppkey, 'held and more' AS sentence FROM supplier")
def drop_ref(t):
    s = F.concat(F.lit("held [E-0"), c("s_suppkey").cast("string"), F.lit("] and more"))
    return t.supplier.select("s_suppkey", X.drop_ref(s, F.concat(F.lit("E-"), F.lpad(c("s_suppkey").cast("string"), 6, "0"))).alias("sentence"))


@query(r"SELECT doc_id, trim(regexp_replace(substr(text, greatest(n_chars // 2 - 160, 0) + 1, n_chars // 2 + 5 + 160 - greatest(n_chars // 2 - 160, 0)), '[\s]+', ' ', 'g')) AS context FROM documents")
def context_window(t):
    mid = F.floor(c("n_chars") / 2).cast("int")
    return t.documents.select("doc_id", X.context_window(c("text"), mid, mid + 5).alias("context"))


@query(r"SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(substr(s, 1, 79)) || '…' END AS label FROM (SELECT doc_id, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS s FROM documents)")
def short_label(t):
    return t.documents.select("doc_id", X.short_label(c("text")).alias("label"))


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN instr(text, q) = 0 THEN substr(text, 1, 100) ELSE substr(text, CAST(greatest(0, least(instr(text, q) - 1 + length(q) // 2 - 50, length(text) - 100)) AS INTEGER) + 1, 100) END AS cut FROM (SELECT doc_id, text, substr(text, 100, 10) AS q FROM documents)")
def passage_cut(t):
    return t.documents.select("doc_id", X.passage_cut(c("text"), F.substring("text", 100, 10), 100).alias("cut"))


@query(r"""SELECT doc_id, i AS nth, array_to_string(w[i * 300 + 1:i * 300 + 300], ' ') AS "window" FROM (SELECT doc_id, w, unnest(range(greatest(1, CAST(ceil(len(w) / 300.0) AS BIGINT)))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents))""")
def windows(t):
    return t.documents.select("doc_id", F.posexplode(X.windows(c("text"), 300)).alias("nth", "window"))


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN p_brand || chr(10) ELSE '' END || p_name AS input FROM part")
def embedding_input(t):
    return t.part.select("p_partkey", X.embedding_input(F.when(c("p_size") > 20, c("p_brand")), c("p_name")).alias("input"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}') AS key FROM part")
def cache_key(t):
    return t.part.select("p_partkey", X.cache_key(("size", c("p_size")), ("brand", c("p_brand"))).alias("key"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def parse_date(t):
    d = c("o_orderdate")
    s = F.get(F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "MMM d, yyyy"), F.lit("31-02-2001")), (c("o_orderkey") % 4).cast("int"))
    return t.orders.select("o_orderkey", F.date_format(X.parse_date(s), "yyyy-MM-dd").alias("day"))


@query("SELECT p_partkey, CAST(1950 + p_size AS BIGINT) AS year FROM part")
def path_year(t):
    return t.part.select("p_partkey", X.path_year(F.concat(F.lit("S_"), (1950 + c("p_size")).cast("string"), F.lit("_2_3_4"))).alias("year"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN round((o_custkey * 2.5 + o_orderkey * 10.0) / 1e6, 6) END AS cost FROM orders")
def cost_usd(t):
    cost = A.cost_usd(c("o_custkey"), c("o_orderkey"), F.when(c("o_orderkey") % 3 > 0, 2.5), F.lit(10.0))
    return t.orders.select("o_orderkey", (F.round(cost * 1e6) / 1e6).alias("cost"))  # whole millionths, by the binary value


@query("SELECT l_orderkey, l_linenumber + 0 AS line, CASE WHEN l_linenumber <> 3 THEN round(l_quantity / (l_linenumber - 3), 6) END AS ratio FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem)")
def ratio(t):
    n = c("l_linenumber").cast("long")
    return t.lineitem.select("l_orderkey", n.alias("line"), F.round(X.ratio(c("l_quantity"), n - 3), 6).alias("ratio"))


@query(
    """SELECT h, n, CASE WHEN n > 0 THEN round(greatest(0, (p + z * z / (2 * n)) / d - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d), 6) ELSE 0 END AS low, CASE WHEN n > 0 THEN round(least(1, (p + z * z / (2 * n)) / d + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d), 6) ELSE 1 END AS high
    FROM (SELECT h, n, 1.96 AS z, CASE WHEN n > 0 THEN h * 1.0 / n ELSE 0 END AS p, CASE WHEN n > 0 THEN 1 + 1.96 * 1.96 / n ELSE 1 END AS d FROM (SELECT DISTINCT CAST(p_size % 5 AS BIGINT) AS h, CAST(p_size AS BIGINT) AS n FROM part WHERE p_size % 5 <= p_size))"""
)
def wilson(t):
    p = t.part.where("p_size % 5 <= p_size").select((c("p_size") % 5).cast("long").alias("h"), c("p_size").cast("long").alias("n")).distinct()
    lo, hi = X.wilson(c("h"), c("n"))
    return p.select("h", "n", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '|' || p_type ELSE p_brand END AS items FROM part")
def list_parse(t):
    v = F.get(F.array(F.concat(F.lit('["'), c("p_brand"), F.lit('", "'), c("p_type"), F.lit('"]')), F.concat(F.lit("['"), c("p_brand"), F.lit("']")), c("p_brand")), (c("p_partkey") % 3).cast("int"))
    return t.part.select("p_partkey", F.array_join(X.list_parse(v), "|").alias("items"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, p_brand AS b FROM part")
def json_merge(t):
    m = X.json_merge(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), c("p_brand")), F.create_map(F.lit("a"), c("p_size").cast("string")))
    return t.part.select("p_partkey", m["a"].alias("a"), m["b"].alias("b"))


@query("SELECT l_orderkey FROM (SELECT l_orderkey, list(l_suppkey) AS s FROM lineitem GROUP BY 1) WHERE list_contains(s, 17)")
def array_contains(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("s")).where(F.array_contains("s", 17)).select("l_orderkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def payload_json(t):
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'curated' ELSE o_orderpriority END AS value, CASE WHEN o_orderkey % 4 = 0 THEN 'text' ELSE 'aws' END AS source, CASE WHEN o_orderkey % 4 <> 0 THEN 'text=curated' ELSE '' END AS conflicts FROM orders"""
)
def metadata_merge(t):
    v, s, d = M.metadata_merge([("aws", F.when(c("o_orderkey") % 4 != 0, c("o_orderpriority"))), ("text", F.lit("curated"))])
    return t.orders.select("o_orderkey", v.alias("value"), s.alias("source"), F.array_join(d, ";").alias("conflicts"))


# ---- citation graph ----

#: A part's place in the reports: year, volume and page of one series, year of another with the same page. Pages have at
#: most five digits and volumes two, so the key is divided among them; places are unique up to nine million parts.
_PLACED = "(SELECT p_partkey, 1990 + p_partkey // 8100000 AS y, p_partkey // 90000 % 90 + 2 AS v, p_partkey % 90000 + 1 AS p, 1990 + p_partkey // 90000 % 100 AS a, p_partkey % 50 + 1 AS n FROM part)"
_REF = "y || '_' || v || '_' || p || '_' || p"


def _placed(t):
    key = c("p_partkey")
    lot = F.floor(key / 90000)
    text = lambda x: x.cast("long").cast("string")
    page = text(key % 90000 + 1)
    y, v = text(1990 + F.floor(key / 8100000)), text(lot % 90 + 2)
    return t.part.select(key, y.alias("y"), v.alias("v"), page.alias("p"), text(1990 + lot % 100).alias("a"), text(key % 50 + 1).alias("n"), F.concat_ws("_", y, v, page, page).alias("path"))


#: A judgment for every part: two parallel citations (a path of the index and an alias of it) and its own.
def _judgments(t):
    text = F.concat(F.lit("["), c("y"), F.lit("] "), c("v"), F.lit(" SCR "), c("p"), F.lit(" : AIR "), c("a"), F.lit(" SC "), c("p"), F.lit(". We followed [1963] 1 SCR "), c("n"), F.lit(" : AIR 1963 SC "), c("n"), F.lit(" and AIR 1963 SC "), c("n"), F.lit(" again; under Sections 73 and 74 of the Indian Contract Act, 1872 it fails."))
    return _placed(t).select(F.concat(F.lit("SC-"), c("path")).alias("doc_id"), c("p_partkey"), text.alias("text"), F.to_date(F.lit("1990-01-01")).alias("decided"))


def _index(t):
    own = _placed(t).select("path", F.lit(None).cast("string").alias("case_id"))
    old = t._spark.range(1, 51).select(F.concat(F.lit("1963_1_"), c("id").cast("string"), F.lit("_"), c("id").cast("string")).alias("path"), F.concat(F.lit("1963  INSC "), c("id").cast("string")).alias("case_id"))
    return own.unionByName(old)


@query("SELECT p_partkey, CAST(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS nth, CAST(unnest([1, 1, 2, 2, 3]) AS BIGINT) AS grp FROM part")
def parallel_groups(t):
    j = _judgments(t)
    return G.parallel_groups(G.mentions(j)).join(j.select("doc_id", "p_partkey"), "doc_id").select("p_partkey", "nth", "grp")


@query(f"SELECT 'AIR 1963 SC ' || n AS alias, 'SC-1963_1_' || n || '_' || n AS target_ref, count(*) AS evidence FROM {_PLACED} GROUP BY n UNION ALL SELECT 'AIR ' || a || ' SC ' || p, 'SC-' || {_REF}, 1 FROM {_PLACED}")
def learn_aliases(t):
    spans, neutral = G.build_index(_index(t))
    return G.learn_aliases(materialise(G.direct_targets(G.parallel_groups(G.mentions(_judgments(t))), spans, neutral), "mentions"))


@query(f"SELECT year, supp, volume, count(*) AS reports FROM (SELECT y AS year, false AS supp, v AS volume FROM {_PLACED} UNION ALL SELECT 1963, false, 1 FROM range(50)) GROUP BY ALL")
def build_index(t):
    return G.build_index(_index(t))[0].groupBy("year", "supp", "volume").agg(F.count("*").alias("reports"))


@query(
    f"""SELECT 'SC-' || {_REF} AS doc_id, x.kind, x.canonical, x.target_ref, x.resolution, x.treatment FROM {_PLACED}, LATERAL (
    SELECT 'case' AS kind, '[1963] 1 SCR ' || n AS canonical, 'SC-1963_1_' || n || '_' || n AS target_ref, 'direct' AS resolution, 'followed' AS treatment
    UNION ALL SELECT 'case', 'AIR 1963 SC ' || n, 'SC-1963_1_' || n || '_' || n, 'alias', 'followed' UNION ALL SELECT 'case', 'AIR 1963 SC ' || n, 'SC-1963_1_' || n || '_' || n, 'alias', 'followed'
    UNION ALL SELECT 'statute', 'contract_act:73', 'ACT-contract_act', 'act', NULL UNION ALL SELECT 'statute', 'contract_act:74', 'ACT-contract_act', 'act', NULL) x"""
)
def document_edges(t):
    j = _judgments(t)
    paras = j.select("doc_id", F.lit(0).cast("long").alias("char_start"), F.lit(0).cast("long").alias("seq"))
    return G.document_edges(j, paras, _index(t), _acts(t)).select("doc_id", "kind", "canonical", "target_ref", "resolution", "treatment")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'overruled' WHEN 1 THEN 'distinguished' END AS treatment FROM part")
def treatment_cue(t):
    text = F.concat(F.get(F.array(F.lit("That view was overruled in "), F.lit("The facts of "), F.lit("Nothing is said of ")), (c("p_partkey") % 3).cast("int")), F.lit("AIR 1965 SC 12"), F.when(c("p_partkey") % 3 == 1, F.lit(" were distinguished. It was reversed.")).otherwise(F.lit(". It was reversed.")))
    return t.part.select("p_partkey", F.get(C.treatment_cues(text, C.find_citations(text)), 0).alias("treatment"))


@query("SELECT p_partkey, unnest([p_size || '', (p_size + 1) || 'A']) AS section, CASE WHEN p_partkey % 2 = 0 THEN 'contract_act' END AS act_id FROM part")
def statute_mentions(t):
    n, m = c("p_size").cast("string"), (c("p_size") + 1).cast("string")
    text = F.concat(F.lit("under Sections "), n, F.lit(" and "), m, F.lit("A of the "), F.when(c("p_partkey") % 2 == 0, "Indian Contract Act, 1872").otherwise("Sale Code"), F.lit(" it lies"))
    m_ = t.part.select("p_partkey", F.inline(C.statute_mentions(text)))
    return C.resolve_act(m_, _acts(t), "act").select("p_partkey", "section", "act_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 'specific_relief_act' END AS act_id FROM part")
def era_rule(t):
    name = F.when(c("p_partkey") % 3 == 0, "Specific Relief Act, 1963").otherwise("Specific Relief Act")
    day = F.to_date(F.when(c("p_partkey") % 2 == 0, "1990-01-01").otherwise("1955-01-01"))
    m = t.part.select("p_partkey", name.alias("act"), day.alias("decided"), F.lit("specific_relief_act").alias("act_id"))
    return G.era_rule(m, _acts(t)).select("p_partkey", "act_id")


@query("SELECT target_ref AS doc_id, source_doc_id AS by_doc_id, treatment FROM edges WHERE treatment IN ('A', 'R') GROUP BY ALL")
def treatment_signals(t):
    from ..operators.deliberation import treatment_signals as op

    return op(t.edges, ["A", "R"])


# ---- structure ----


def _pages(t):
    pages = F.filter(F.split("text", "\n"), lambda x: x != "")
    return t.documents.select("doc_id", F.transform(pages, lambda p, i: F.concat(F.lit("RUNNING HEAD "), i.cast("string"), F.lit("\n"), p, F.lit("\n\n"), (i + 1).cast("string"))).alias("pages"), F.lit("hc").alias("profile"))


@query()
def clean_document(t):
    d = T.clean_document(_pages(t))
    return d.select("doc_id", F.length("clean.text").alias("chars"), F.size("clean.runs").alias("runs"), F.size("clean.page_starts").alias("pages"), c("clean.stats")["dropped_repeated_header"].alias("headers"), F.sha2("clean.text", 256).alias("sha256"))


@query()
def parse_entry(t):
    return T.parse_entry(_pages(t)).select("doc_id", "chars", "page_count", "needs_ocr", "latin_ratio", "language_flag", "ocr_noise")


def _numbered(t):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return t.documents.select("doc_id", c("source").alias("title"), F.concat(F.lit("JUDGMENT\n"), F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")).alias("text"))


@query()
def segment(t):
    return T.segment(_numbered(t)).select("doc_id", "seq", "no", "section", "numbering", "part", "contested", "char_start", "char_end")


@query()
def chunk_judgment(t):
    return T.chunk_judgment(_numbered(t), 120).select("doc_id", "chunk_id", "kind", "char_start", "char_end", "tokens", "para_start", "para_end")


@query("SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY doc_id")
def sentence_spans(t):
    s = text_batches(spread(t.documents)).select("doc_id", "text", T.sentence_spans_udf("text").alias("spans"))
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return s.groupBy("doc_id").agg(F.sum(F.when(c("text").isNotNull(), chars)).alias("chars"))


@query()
def split_sentences(t):
    return text_batches(spread(t.documents)).select("doc_id", F.size(T.split_sentences_udf("text")).alias("sentences"))


@query()
def split_act(t):
    body = F.concat(F.lit("1. Short title\n2. Words\n3. Repealed\n\n1. Short title.- This is part "), c("p_partkey").cast("string"), F.lit(".\n2. Words.- (1) In this Act.\n(2) And so on.\n"))
    return T.split_act(t.part.select(c("p_partkey").alias("act_id"), body.alias("text"))).select("act_id", "section", "title", "char_start", "char_end", "repealed")


@query("SELECT p_partkey, '(1),(2)' AS labels, 'Act 18 of 2018' AS amended, p_partkey % 2 = 0 AS repealed FROM part")
def section_attributes(t):
    text = F.concat(F.when(c("p_partkey") % 2 == 0, "5. [Repealed by Act 1 of 1950]").otherwise("5. Words.— (1) One."), F.lit("\n(1) One\n(2) Two"))
    return t.part.select("p_partkey", F.array_join(T.sub_sections(text), ",").alias("labels"), F.array_join(T.amended_by(F.lit("Subs. by Act 18 of 2018, s. 2; ins. by Act 18 of 2018")), ",").alias("amended"), T.is_repealed(text).alias("repealed"))


@query("SELECT p_partkey FROM part WHERE 1900 + p_size <= 1930 AND (p_partkey % 2 = 0 OR 1910 + p_size > 1930)")
def in_force(t):
    day = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    s = t.part.select("p_partkey", c("p_partkey").cast("string").alias("section"), F.lit("x").alias("act_id"))
    am = t.part.where("p_partkey % 2 = 1").select(F.lit("x").alias("act_id"), c("p_partkey").cast("string").alias("section"), day(1900 + c("p_size")).alias("in_force_from"), day(1910 + c("p_size")).alias("in_force_to"))
    even = t.part.where("p_partkey % 2 = 0").select(F.lit("x").alias("act_id"), c("p_partkey").cast("string").alias("section"), day(1900 + c("p_size")).alias("in_force_from"), F.lit(None).cast("date").alias("in_force_to"))
    acts = t._spark.createDataFrame([("x", None)], "act_id string, commencement date")
    return T.in_force_at(T.in_force(s, acts, am.unionByName(even)), day(F.lit(1930))).select("p_partkey")


@query()
def final_statements(t):
    pos = F.array(F.struct(F.lit("I-1.A").alias("position_id"), F.lit("Held [E-002].").alias("summary"), F.array(F.lit("E-001")).alias("key_evidence")))
    a = t.part.select(c("p_partkey").alias("run_id"), pos.alias("positions"), F.concat(F.lit("First [E-3]. Then Mr. X agreed. "), c("p_name"), F.lit(" too.")).alias("summary"))
    return T.final_statements(a).withColumn("refs", F.array_join("refs", ","))
