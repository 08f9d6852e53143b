"""Driver tables in the roles of the domain tables: the same portable SQL for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

#: name -> SQL that both engines run; {us} is the microseconds of a timestamp, {day} adds days to a date.
STAND_INS = {
    "ev": "SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type AS type, value, {us} AS ts_us FROM events",
    "chunks": "SELECT doc_id AS chunk_id, doc_id, text, lang, source, n_chars, doc_id % 7 AS section_id, doc_id * 10 AS char_start FROM documents",
    "docs": "SELECT doc_id, CASE WHEN source = 'src0' THEN 'statute' ELSE 'judgment' END AS kind, lang AS court, CASE WHEN doc_id % 9 > 0 THEN {day} END AS decision_date, source AS title, CASE WHEN doc_id % 3 = 0 THEN 'high_court' ELSE 'supreme_court' END AS court_level FROM documents",
    "edges": "SELECT l_orderkey AS source_doc_id, l_partkey AS target_ref, CASE WHEN l_linestatus = 'F' THEN l_partkey END AS target_doc_id, l_suppkey AS canonical, l_suppkey AS target_section_id, CAST(l_linenumber AS BIGINT) AS source_para, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS treatment, CASE WHEN l_tax > 0.06 THEN 'conflict' WHEN l_tax > 0.03 THEN 'alias' ELSE 'direct' END AS resolution, l_returnflag AS reporter FROM lineitem",
    "results": "SELECT l_orderkey AS run_id, l_partkey AS claim_id, l_suppkey AS evidence_id, CAST(l_linenumber AS BIGINT) AS seq, CASE CAST(l_quantity AS INTEGER) % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'weak' WHEN 2 THEN 'unsupported' ELSE 'invalid' END AS status FROM lineitem",
    "paras": "SELECT conv_id AS doc_id, turn AS seq, role AS part, text, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM conversations",
    "calls": "SELECT o_custkey AS run_id, o_orderkey AS call_id, o_orderpriority AS model, o_orderkey % 1000 AS input_tokens, o_orderkey % 300 AS output_tokens, o_orderstatus = 'F' AS cached, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS cost_usd FROM orders",
    "pairs": "SELECT doc_id, CAST(quality AS BIGINT) AS gold, CASE WHEN doc_id % 5 = 0 THEN 1 - CAST(quality AS BIGINT) ELSE CAST(quality AS BIGINT) END AS predicted FROM labels",
    "ranked": "SELECT lang AS query_id, 'a' AS list_name, doc_id AS chunk_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents UNION ALL SELECT lang AS query_id, 'b' AS list_name, doc_id AS chunk_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 101, doc_id) AS rank FROM documents",
    "qrels": "SELECT d.lang AS query_id, d.doc_id AS unit FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1",
    "scores": "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS experiment, l_returnflag AS metric, l_orderkey % 97 AS item, CASE WHEN l_tax > 0.01 THEN round(l_discount * 10, 4) END AS value, l_tax > 0.07 AS failed FROM lineitem",
    "ballots": "SELECT CAST(l_linenumber AS BIGINT) AS juror_id, l_orderkey % 50 AS issue_id, l_orderkey % 150 AS position_id, CAST(floor(l_quantity) AS BIGINT) % 5 + 1 AS c1, CAST(floor(l_extendedprice) AS BIGINT) % 5 + 1 AS c2 FROM lineitem",
    "claims": "SELECT o_custkey AS run_id, o_orderkey AS claim_id, o_orderkey % 4 AS position_id, o_orderkey % 2 AS issue_id, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'falls' ELSE 'weak' END AS status FROM orders",
    "cites": "SELECT o.o_custkey AS run_id, l.l_orderkey AS claim_id, l.l_partkey AS evidence_id, CASE CAST(l.l_quantity AS INTEGER) % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'weak' ELSE 'unsupported' END AS verification FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_linenumber < 4",
    "positions": "SELECT DISTINCT o_custkey AS run_id, o_orderkey % 4 AS position_id, o_orderkey % 2 AS issue_id FROM orders",
    "issues": "SELECT DISTINCT o_custkey AS run_id, o_orderkey % 2 AS issue_id FROM orders",
}
_SPARK = {"us": "unix_micros(cast(ts as timestamp))", "day": "date_add(date'2000-01-01', cast(doc_id * 7 % 9000 as int))"}
_DUCK = {"us": "epoch_us(ts)", "day": "date '2000-01-01' + cast(doc_id * 7 % 9000 as integer)"}
DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """Driver tables and stand-ins of one directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER:
            return table(self._spark, self._dir, name)
        if name in STAND_INS:
            return self.sql(STAND_INS[name])
        raise AttributeError(name)

    def sql(self, query: str) -> DataFrame:
        """Portable SQL over driver tables, without leaving views behind."""
        import re

        for n in STAND_INS:
            query = re.sub(rf"((?:FROM|JOIN)\s+){n}\b", rf"\1({STAND_INS[n]}) {n}", query)
        for k, v in _SPARK.items():
            query = query.replace("{" + k + "}", v)
        used = {t for t in DRIVER if re.search(rf"(?:FROM|JOIN)\s+{t}\b", query)}
        for t in used:
            query = re.sub(rf"((?:FROM|JOIN)\s+){t}\b", rf"\1{{{t}}}", query)
        return self._spark.sql(query, **{t: table(self._spark, self._dir, t) for t in used})


def duck(query: str) -> str:
    """An oracle with the stand-ins it names in front, as common table expressions."""
    import re

    needed = [n for n in STAND_INS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", query)]
    head = ", ".join(f"{n} AS ({STAND_INS[n]})" for n in needed)
    for k, v in _DUCK.items():
        head = head.replace("{" + k + "}", v)
    if not head:
        return query
    body = query.strip()
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
