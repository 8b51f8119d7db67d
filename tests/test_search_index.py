"""Search by the index of 3-grams against the scan; classes of titles against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_dedup_merge import record, records

from biblio_spark.operators import links, search, search_index

WORDS = ["Deep", "protein", "étude", "CELL", "graph", "x", "ab", "日本語", "neural-net", "100%"]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for o in range(160):
        title = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4)))
        abstract = None if o % 9 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 30, 200)))) + (" needle" if o == 77 else "")
        rows.append(record(o, title, rng.sample(["Ann Lee", "Bob Ray", "Dora Xu"], rng.randint(0, 2)), abstract=abstract))
    lit = records(spark, rows)
    path = str(tmp_path_factory.mktemp("index")) + "/one"
    search_index.build_index(lit, path, parts=8)
    return lit, path


def ords(df):
    return sorted(r["ord"] for r in df.collect())


def test_the_index_finds_what_the_scan_finds(spark, library):
    lit, path = library
    rng = random.Random(4)
    terms = [*WORDS, "needle", "Ann L", "ein", "e", "", "nothing like it", "rotein cell", "日本", "lee b", "100% x"]
    for _ in range(14):
        must, should, no = (rng.sample(terms, rng.randint(0, n)) for n in (2, 2, 1))
        fields = rng.choice((search.FIELDS, ("title",), ("abstract", "author")))
        want = search.search(lit, must, should, no, fields)
        got = search_index.search_indexed(spark, path, must, should, no, fields)
        assert ords(got) == ords(want) and set(got.columns) == set(lit.columns)


def test_only_some_parts_are_read(spark, library):
    """A rare term leads to one record: only its part of the records is read, and of the postings those of its grams."""
    lit, path = library
    found = search_index.search_indexed(spark, path, ["needle"])
    assert ords(found) == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan) and len({r[0] for r in lit.select(F.pmod(F.xxhash64("ord"), F.lit(8))).distinct().collect()}) == 8
    chosen = search_index.candidates(spark, path, "needle")
    scan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in scan and "PushedFilters: [In(gram" in scan
    assert chosen.count() == 1


def test_an_empty_index(spark, tmp_path):
    lit = records(spark, [])
    search_index.build_index(lit, f"{tmp_path}/none", parts=2)
    assert search_index.search_indexed(spark, f"{tmp_path}/none", ["abc"]).count() == 0


def tokens_of(spark, titles):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(titles)], "k int, t string").select("k", links.title_tokens("t").alias("w"))
    return {r["k"]: frozenset(r["w"]) for r in df.collect()}


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 1.0])
def test_classes_are_all_pairs(spark, threshold):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(14)]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(110)]
    titles += titles[:25]
    years = [rng.choice((2000, 2001, None)) for _ in titles]
    articles = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(titles, years, strict=True))], "article_id long, title string, publication_year int")
    members, linked = links.candidate_classes(articles, threshold)
    token = tokens_of(spark, titles)
    want = {}
    for k in range(len(titles)):
        if token[k]:
            want[k] = min(j for j in range(len(titles)) if token[j] == token[k] and years[j] == years[k])
    assert {r["article_id"]: r["class_id"] for r in members.collect()} == want
    pairs = {(a, b): len(token[a] & token[b]) / len(token[a] | token[b]) for a in set(want.values()) for b in set(want.values()) if a < b and years[a] == years[b]}
    assert {(r["class1"], r["class2"]): r["overlap"] for r in linked.collect()} == pytest.approx({p: o for p, o in pairs.items() if o >= threshold})
    none = spark.createDataFrame([], "article_id long, identifier_type string, identifier_value string")
    spelled = {(r["id1"], r["id2"]) for r in links.candidate_duplicates(articles, none, threshold).collect()}
    assert spelled == {(a, b) for a in want for b in want if a < b and years[a] == years[b] and len(token[a] & token[b]) / len(token[a] | token[b]) >= threshold}


def test_many_copies_are_one_class(spark):
    articles = spark.range(10_000).select(F.col("id").alias("article_id"), F.when(F.col("id") % 2 == 0, "One Title of all").otherwise("all one title").alias("title"), F.lit(2000).alias("publication_year"))
    members, linked = links.candidate_classes(articles)
    assert members.select("class_id").distinct().count() == 1 and members.count() == 10_000 and linked.count() == 0
