"""Functions over columns against plain Python and hand-computed answers."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from biblio_spark.functions import dates, identifiers, similarity, text
from biblio_spark.schema import IDENTIFIER, struct_of


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", expression.alias("out")).collect()
    return [r["out"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    ("kind", "value", "normal"),
    [
        ("doi", " DOI:10.1000/ABC/ ", "10.1000/abc"), ("doi", "https://dx.doi.org/10.1/x", "10.1/x"), ("doi", "http://doi.org//10.1/x//", "10.1/x"),
        ("pmid", "PMID 123", "123"), ("pmid", "none", ""), ("arxiv_id", "arXiv:2301.00001v12", "2301.00001"), ("wos_uid", " WOS:1 ", "wos:1"), ("doi", None, ""),
    ],
)
def test_normalize_identifier(spark, kind, value, normal):
    assert column(spark, [value], identifiers.normalize_identifier(F.lit(kind), "v")) == [normal]


def test_titles_and_names(spark):
    titles = ["The Étude, of a  Thing!", "a an the", "x_y-z 2", None, "  By\tNight\n"]
    stop = set(text.STOP_WORDS)
    plain = lambda t: " ".join(w for w in re.sub(r"[^\w\s]", " ", (t or "").lower()).split() if w not in stop)
    assert column(spark, titles, text.normalize_title("v")) == [plain(t) for t in titles]
    names = [" Jean-Luc  O'Neil, Jr. ", "É. Müller", None]
    assert column(spark, names, text.normalize_author("v")) == ["jean-luc o neil jr", "é müller", ""]


def test_identifier_patterns(spark):
    good = ["10.1000/test", "10.1038/nature12373", "10.1016/j.cell.2023.01.001"]
    bad = ["invalid-doi", "10.", "not-a-doi", "", None]
    assert column(spark, good + bad, identifiers.is_valid_identifier(F.lit("doi"), "v")) == [True] * 3 + [False] * 5
    assert column(spark, ["2301.00001v2", "math.GT/0309136", "2301.1"], identifiers.is_valid_identifier(F.lit("arxiv_id"), "v")) == [True, True, False]


def ids(*pairs):
    return F.array(*(struct_of(IDENTIFIER, identifier_type=F.lit(k), identifier_value=F.lit(v), is_primary=F.lit(p)) for k, v, p in pairs))


def test_identifier_lists(spark):
    one = spark.range(1)
    listed = ids(("doi", "a", True), ("doi", "b", False), ("pmid", "1", False))
    row = one.select(
        identifiers.extract_identifiers(listed, F.lit('{"pmid": 7, "paperId": "s"}')).alias("m"), identifiers.get_identifier(listed, "doi").alias("d"),
        identifiers.get_identifier(listed, "pmid", True).alias("p"), F.size(identifiers.add_identifier(listed, "doi", F.lit(" a "))).alias("same"),
        F.size(identifiers.add_identifier(listed, "pii", F.lit(" x "))).alias("new"), F.size(identifiers.add_identifier(listed, "pii", F.lit("  "))).alias("blank"),
    ).first()
    assert row["m"] == {"doi": "b", "pmid": "7", "semantic_scholar_id": "s"}
    assert (row["d"], row["p"], row["same"], row["new"], row["blank"]) == ("a", None, 3, 4, 3)


def test_dates(spark):
    values = ["2023-1-5", "2023-02-30", "2023-13", "20231", "2023-05", "2023", "", None, "x"]
    found = [None if d is None else str(d) for d in column(spark, values, dates.parse_partial_date("v"))]
    assert found == ["2023-01-05", None, None, None, "2023-05-01", "2023-01-01", None, None, None]
    row = spark.range(1).select(
        dates.iso_date(F.lit("2023"), F.lit("Feb"), F.lit("3"), F.lit("4"), F.lit("5")).alias("a"), dates.iso_date(F.lit("2023"), F.lit("11")).alias("b"),
        dates.iso_date(F.lit("2023")).alias("c"), dates.iso_date(F.lit(None).cast("string"), F.lit("1")).alias("d"), dates.wos_pub_date(F.lit(2021), F.lit("NOV-DEC")).alias("e"),
        dates.wos_pub_date(F.lit(2021), F.lit("11")).alias("f"), dates.wos_pub_date(F.lit(2021), F.lit("FAL")).alias("g"),
    ).first()
    assert tuple(row) == ("2023-02-03T04:05:00", "2023-11", "2023", None, "2021-11-01", "2021-11-01", None)


def test_year_ranges(spark):
    good = {"2020": (2020, 2020), "2020-2023": (2020, 2023), "2020-": (2020, 2024), "-2023": (1900, 2023)}
    bad = ["", "invalid", "2020-2019", "800", "3000", "-", None]
    out = column(spark, [*good, *bad], dates.year_range("v", 2024))
    assert [(r["start"], r["end"]) for r in out] == [*good.values(), *[(None, None)] * len(bad)]
    assert [dates.parse_year_range(t, 2024) for t in good] == list(good.values())
    for t in bad[:-1]:
        with pytest.raises(ValueError):
            dates.parse_year_range(t, 2024)


def test_small_functions(spark):
    html = '<a href="//x.org/a.pdf"><a href="https://y.org/b.pdf">'
    assert column(spark, [html], text.extract_pdf_links("v")) == [["https://x.org/a.pdf", "https://y.org/b.pdf"]]
    assert column(spark, ["JournalArticle", "Other", None], text.map_document_type("v")) == ["Article", "Other", None]
    assert column(spark, ["Article", "all", "", "x"], text.map_document_type("v", "to_semantic")) == ["JournalArticle", "", "", None]
    uuids = ["550e8400-e29b-41d4-a716-446655440000", "{550e8400e29b41d4a716446655440000}", "x", None, "00000000-0000-0000-0000-000000000000"]
    assert column(spark, uuids, text.is_valid_uuid("v")) == [True, True, False, False, True]
    assert column(spark, uuids, text.is_nil_uuid("v")) == [False, False, False, False, True]


def test_similarity(spark):
    rows = [("abcd efgh", "abce efgh"), ("", ""), ("x", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(similarity.sequence_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [SequenceMatcher(None, *rows[0]).ratio(), 1.0, None]
    assert similarity.author_ratio(["ann lee", "bob ray"], ["ann lee", "bob rays"]) == 1.0
    assert similarity.author_ratio(["ann lee", "ann lee"], ["ann lee"]) == 0.5
    assert similarity.author_ratio([], ["x"]) == 0.0
