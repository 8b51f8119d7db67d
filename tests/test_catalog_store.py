"""The stored catalogue: layout, further batches, updates; sources read each by itself."""

import gzip
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_dedup_merge import record, records

from biblio_spark.operators import analytics, catalog
from biblio_spark.sources import isolated, landed


def batch(spark, first, n, years=(2001, 2002), title="T"):
    rows = [record(k, f"{title} {k}", [f"Author {k % 3}"], [("doi", f"10.1000/{k}")], publication_year=years[k % len(years)], source="wos") for k in range(first, first + n)]
    return records(spark, rows).withColumn("article", F.col("article").withField("primary_doi", F.concat(F.lit("10.1000/"), F.col("record_id"))))


def files(path, name):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path, name).rglob("*.parquet")}


def rows_of(spark, path):
    return {name: sorted(map(str, spark.read.parquet(f"{path}/{name}").select(*sorted(spark.read.parquet(f"{path}/{name}").columns)).collect())) for name in catalog.TABLE_KEYS}


def test_two_batches_equal_one(spark, tmp_path):
    """Records of the second batch that are known, that share identifiers with known ones under another title, and new ones."""
    one = batch(spark, 0, 12)
    two = batch(spark, 8, 10, years=(2003, 2004), title="Other").withColumn("ord", F.col("ord") + 100)
    for name, parts in (("both", [one.unionByName(two)]), ("each", [one, two]), ("thrice", [one, two, two])):
        for part in parts:
            added = catalog.add_to_catalog(spark, f"{tmp_path}/{name}", part, 2024)
        if name == "thrice":
            assert not any(added.values())
    assert rows_of(spark, f"{tmp_path}/both") == rows_of(spark, f"{tmp_path}/each") == rows_of(spark, f"{tmp_path}/thrice")
    assert spark.read.parquet(f"{tmp_path}/each/articles").where("title LIKE 'Other%'").count() == 6


def test_other_years_keep_their_files(spark, tmp_path):
    catalog.add_to_catalog(spark, str(tmp_path), batch(spark, 0, 20), 2024)
    before = files(tmp_path, "articles")
    catalog.add_to_catalog(spark, str(tmp_path), batch(spark, 50, 5, years=(2002, 2009)), 2024)
    after = files(tmp_path, "articles")
    assert before.items() <= after.items() and {"publication_year=2009", "publication_year=2002"} == {Path(f).parts[1] for f in after.keys() - before.keys()}
    ids = spark.read.parquet(f"{tmp_path}/articles").where("publication_year = 2009").select("article_id")
    updates = spark.createDataFrame([(r[0], "New") for r in ids.collect()] + [("unknown", "New")], "article_id string, title string")
    assert catalog.write_updates(spark, str(tmp_path), updates) == [2009]
    last = files(tmp_path, "articles")
    assert {f: t for f, t in after.items() if "2009" not in f}.items() <= last.items()
    found = spark.read.parquet(f"{tmp_path}/articles")
    assert found.count() == 25 and {r["title"] for r in found.where("publication_year = 2009").collect()} == {"New"}


def test_a_year_that_is_left_is_gone(spark, tmp_path):
    catalog.add_to_catalog(spark, str(tmp_path), batch(spark, 0, 9, years=(2001, 2002, 2003)), 2024)
    found = spark.read.parquet(f"{tmp_path}/articles")
    updates = spark.createDataFrame([(r["article_id"], 2005) for r in found.where("publication_year = 2002").collect()], "article_id string, publication_year int")
    assert catalog.write_updates(spark, str(tmp_path), updates) == [2002, 2005]
    counts = {r["publication_year"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/articles").groupBy("publication_year").count().collect()}
    assert counts == {2001: 3, 2003: 3, 2005: 3}


def test_a_frequent_year_is_split_and_a_rare_one_is_not(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        year = F.when(F.col("id") % 100 == 0, 1999).otherwise(2020)
        articles = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("article_id"), year.alias("publication_year"))
        catalog.write_catalog({"articles": articles.repartition(8)}, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    written = [Path(f).parts[1] for f in files(tmp_path, "articles")]
    assert written.count("publication_year=2020") >= 3 and written.count("publication_year=1999") == 1


def test_buckets_and_years_spare_work(spark, tmp_path):
    """Joins and aggregations by article of bucketed tables have no exchange below them; a year's filter reads its partition only."""
    loaded = catalog.load_catalog(batch(spark, 0, 40), 2024)
    spark.sql("CREATE DATABASE IF NOT EXISTS library")
    tables = catalog.save_bucketed({k: loaded[k] for k in ("articles", "article_sources", "article_identifiers", "data_sources")}, "library", f"file://{tmp_path}", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        has = tables["article_identifiers"].where("identifier_type = 'doi'").select("article_id").distinct()
        joined = tables["articles"].join(tables["article_sources"], "article_id").join(has, "article_id").groupBy("article_id").agg(F.count("*").alias("n"))
        assert joined.count() == 40
        plan = joined._jdf.queryExecution().executedPlan().toString()
        year = tables["articles"].where("publication_year = 2001")
        scan = year._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert year.count() == 20 and "PartitionFilters: [isnotnull(publication_year" in scan


def test_ties_at_the_limit_are_ranked(spark):
    rows = [("a", 5, 1), ("b", 4, 7), ("c", 4, 7), ("d", 4, 7), ("e", 4, None), ("f", 1, 9)]
    df = spark.createDataFrame(rows, "name string, articles long, citations long")
    assert {(r["name"], r["rank"]) for r in analytics._ranked(df, "name", 2).collect()} == {("a", 1), ("b", 2), ("c", 2), ("d", 2)}
    assert analytics._ranked(df, "name", 50).count() == 6


@pytest.fixture
def sources(tmp_path):
    """Lines of two sources, one with broken files among others, one with broken ones only, one without any, one that is empty."""
    line = '{"title": "%s", "doi": "10.1/%d"}\n'
    made = {}
    for name, good, bad in (("arxiv", 3, 0), ("wos", 5, 2), ("biorxiv", 0, 2), ("pubmed", 0, 0)):
        folder = tmp_path / name
        folder.mkdir()
        for k in range(good):
            (folder / f"{k}.json.gz").write_bytes(gzip.compress((line % (f"{name} {k}", k) * 4).encode()))
        for k in range(bad):
            whole = gzip.compress("".join(line % (f"{name} cut {n * 7919}", n) for n in range(3000)).encode())
            (folder / f"x{k}.json.gz").write_bytes(whole[: len(whole) // 2] if k else b"no gzip at all")
        made[name] = f"file://{folder}"
    return made | {"none": f"file://{tmp_path}/none"}


def test_broken_sources_do_not_end_the_run(spark, sources):
    read = lambda files: landed.from_arxiv(spark.read.schema(landed.ARXIV_DDL).json(files))
    rows, state, bad = isolated.read_isolated(spark, {name: (path, read) for name, path in sources.items()})
    found = {r["source_name"]: r for r in state.collect()}
    assert {n: (r["ok"], r["records"], r["bad_files"]) for n, r in found.items()} == {
        "arxiv": (True, 12, 0), "wos": (True, 20, 2), "biorxiv": (False, 0, 2), "pubmed": (True, 0, 0), "none": (False, 0, 0)
    }
    assert found["none"]["error"] and found["biorxiv"]["error"] and found["wos"]["error"] is None
    assert {r["source_name"]: r["count"] for r in rows.groupBy("source_name").count().collect()} == {"arxiv": 12, "wos": 20}
    listed = bad.collect()
    assert sorted(r["file"].rsplit("/", 1)[1] for r in listed) == ["x0.json.gz"] * 2 + ["x1.json.gz"] * 2 and all(r["error"] for r in listed)
