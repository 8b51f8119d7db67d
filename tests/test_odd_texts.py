"""Texts that are empty, blank, with white space at their ends or with characters that XML forbids give what the SQL gives."""

import duckdb
import pytest

from biblio_spark.plans import registry

registry.load()
BODY = "A title of some words. Then the rest of it, long enough to be an abstract"
ODD = ("", " ", f" {BODY}", f"{BODY}\n", f"Title with a space . {BODY}", f"Title\n. {BODY}", f"Title \x85. {BODY}", f"Title\x0b. {BODY}", f"A \x01 b \x00 c. {BODY}", f"b64:x. {BODY} ￿", f"{BODY}\r\n", f". {BODY}", BODY)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Each text under ids of many remainders; a further word tells the copies of long ones apart."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, ODD[i % len(ODD)].replace("rest", f"rest{i}"), "en") for i in range(84 * len(ODD))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path


def _same_as_sql(spark, path, name):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
        found = con.execute(registry.ORACLE_SQL[name])
        columns, want = [c[0] for c in found.description], found.fetchall()
    key = lambda row: [str(v) for v in row]
    assert sorted((tuple(r) for r in registry.QUERIES[name](spark, path).select(*columns).collect()), key=key) == sorted(want, key=key)


def test_wos_texts_stay_whole(spark, odd):
    _same_as_sql(spark, odd, "s5_from_wos")


def test_pubmed_sections_stay_whole(spark, odd):
    _same_as_sql(spark, odd, "l4_pubmed_details")


def test_landed_texts_stay_whole(spark, odd):
    _same_as_sql(spark, odd, "p1_landed_to_export")
