"""Queries with an oracle on tables with blank, null and repeated rows, against DuckDB."""

import duckdb
import pytest

from marlstone.plans import catalog
from tests.test_oracles import plain

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, "One. Two.", "en", "a", 9), (2, "", "en", "b", 0), (3, None, "de", "a", None), (4, "  \n\t ", "en", "b", 5), (50, "x", "fr", "a", 1), (100, "No end", "en", "a", 6), (100, "Twice. Here", "en", "a", 11), (7, "\n", "en", "b", 1)]


def equal(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    cur = con.execute(catalog.ORACLES[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted(([plain(r[i]) for i in at] for r in cur.fetchall()), key=repr)
    assert sorted(([plain(v) for v in r] for r in df.select(*cols).collect()), key=repr) == want and want


@pytest.mark.parametrize("labels", [[1, 50, 50, 100, 9, 2], [1, 50, None]])
def test_dataset_validate(spark, tmp_path, labels):
    equal(spark, tmp_path, "dataset_validate", documents=(DOCUMENTS, [*ROWS, (None, "x", "en", "a", 1)]), labels=("doc_id long, quality int, toxic int", [(i, 1, 0) for i in labels]))


def test_sentence_spans(spark, tmp_path):
    equal(spark, tmp_path, "sentence_spans", documents=(DOCUMENTS, ROWS))


def test_tsvector(spark, tmp_path):
    """Words are stemmed after legal shorthand is written out, in the query as in its SQL."""
    texts = ["u/s 55, s. 74, ss. 73-74 and Art. 14", "Agreed damages; the parties were hopping, sayings 1-2-3-4", "Sec.5 secs 7 us. 9 carts. 3", None, "", "eyyy ayy Generously élysées"]
    rows = [(i, t, "en", f"Cited {i}-{i}", 1) for i, t in enumerate(texts)]
    equal(spark, tmp_path, "tsvector", documents=(DOCUMENTS, rows))
    got = {(r.lexeme, r["first"]) for r in catalog.QUERIES["tsvector"](spark, str(tmp_path)).where("chunk_id < 2 and weight = 'A'").collect()}
    # Positions count stop words; "section" is first in "under section 55".
    assert got >= {("section", 2), ("55", 3), ("74", 5), ("73", 7), ("articl", 10), ("14", 11), ("agre", 1), ("damag", 2), ("parti", 4), ("hop", 6), ("say", 7), ("4", 11)}
