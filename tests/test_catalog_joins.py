"""The load finds the first record of an article on keys: records are not shuffled for it."""

from biblio_spark.operators import catalog
from test_dedup_merge import record, records


def test_records_are_not_shuffled_to_find_the_first(spark):
    rows = [record(k, title=f"title {k}", authors=["A b"], ids=[("doi", f"10.1000/{k % 990}")], primary_doi=f"10.1000/{k % 990}", publication_year=2000) for k in range(1000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # ten later records fit, a thousand keys do not
    try:
        tables = catalog.load_catalog(records(spark, rows), 2024)
        assert "SortMergeJoin" not in tables["articles"]._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["title"] for r in tables["articles"].collect()) == sorted(f"title {k}" for k in range(990))
        assert tables["article_authors"].count() == 990 and tables["article_identifiers"].count() == 990
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
