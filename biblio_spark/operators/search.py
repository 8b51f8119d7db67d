"""Search, filters, order and lookups over unified records and the catalogue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biblio_spark.functions.dates import parse_year_range
from biblio_spark.functions.identifiers import normalize_identifier
from biblio_spark.functions.text import filled, nonblank

MAX_RESULTS = 10_000
SOURCES = ("pubmed", "arxiv", "biorxiv", "semantic_scholar", "wos")
FIELDS = ("title", "abstract", "author", "venue")


def _holds(term: str, field: str) -> Column:
    word = term.lower()
    if field == "author":
        return F.coalesce(F.exists("authors", lambda a: F.lower(a["full_name"]).contains(word)), F.lit(False))
    path = {"title": "article.title", "abstract": "article.abstract", "venue": "venue.venue_name"}[field]
    return F.coalesce(F.lower(F.col(path)).contains(word), F.lit(False))


def _anywhere(term: str, fields: Iterable[str]) -> Column:
    found = F.lit(False)
    for field in fields:
        found = found | _holds(term, field)
    return found


def search(lit: DataFrame, must=(), should=(), must_not=(), fields=FIELDS) -> DataFrame:
    """Records with all terms of ``must``, any of ``should`` (if given) and none of ``must_not``, each in any of ``fields``, without
    regard to case."""
    if unknown := set(fields) - set(FIELDS):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    keep = F.lit(True)
    for term in must:
        keep = keep & _anywhere(term, fields)
    if should:
        some = F.lit(False)
        for term in should:
            some = some | _anywhere(term, fields)
        keep = keep & some
    for term in must_not:
        keep = keep & ~_anywhere(term, fields)
    return lit.where(keep)


def filter_years(lit: DataFrame, years: str, current_year: int, column: str = "article.publication_year") -> DataFrame:
    start, end = parse_year_range(years, current_year)
    return lit.where(F.col(column).between(start, end))


def filter_types(lit: DataFrame, names: Iterable[str]) -> DataFrame:
    return lit.where(F.exists("publication_types", lambda t: t["type_name"].isin(*names)))


def filter_fields_of_study(lit: DataFrame, names: Iterable[str]) -> DataFrame:
    return lit.where(F.exists("categories", lambda c: c["category_name"].isin(*names)))


def filter_has_abstract(lit: DataFrame) -> DataFrame:
    return lit.where(nonblank("article.abstract"))


def filter_sources(lit: DataFrame, sources: Iterable[str]) -> DataFrame:
    """Records of the chosen sources; unknown names are ignored, ValueError if none is left."""
    known = [s for s in sources if s in SOURCES]
    if not known:
        raise ValueError("no known source")
    return lit.where(F.col("source_specific.source").isin(*known))


_SORTS = {
    "date": "article.publication_date", "year": "article.publication_year", "citations": "article.citation_count",
    "author": None, "journal": "venue.venue_name",
}


def top_results(lit: DataFrame, by: str = "date", order: str = "desc", n: int = 100) -> DataFrame:
    """The first ``n`` (1 to 10,000) by a key, ties by ``ord``; records without the key come last."""
    if by not in _SORTS or order not in ("asc", "desc"):
        raise ValueError(f"cannot sort by {by!r} {order!r}")
    if not 1 <= n <= MAX_RESULTS:
        raise ValueError(f"n must be 1 to {MAX_RESULTS}")
    key = F.get("authors", F.lit(0))["full_name"] if by == "author" else F.col(_SORTS[by])
    return lit.orderBy(key.asc_nulls_last() if order == "asc" else key.desc_nulls_last(), "ord").limit(n)


def page(df: DataFrame, keys: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order of ``keys``, which must be unique to make pages disjoint."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    return df.orderBy(*keys).offset(offset).limit(limit)


def find_by_title(articles: DataFrame, text: str, column: str = "title") -> DataFrame:
    return articles.where(F.lower(column).contains(text.lower()))


find_by_author_name = find_by_title


def lookup(identifiers: DataFrame, kind: str, values: DataFrame) -> DataFrame:
    """Rows of the identifier table (identifier_type, identifier_value, ...) of a type whose normal form is among ``values``
    (column ``value``). Spark broadcasts the list if it is small."""
    wanted = values.select(normalize_identifier(F.lit(kind), "value").alias("_key")).where(filled("_key")).distinct()
    own = identifiers.where(F.col("identifier_type") == kind).withColumn("_key", normalize_identifier("identifier_type", "identifier_value"))
    return own.join(wanted, "_key", "left_semi").drop("_key")


def rank_pdf_urls(locations: DataFrame, links: DataFrame) -> DataFrame:
    """(doi, url, rank): where to fetch a paper from, best first.

    ``locations`` (doi, pos, url_for_pdf, url_for_landing_page): open-access places; PMC links come first, the latest of them
    first, then the others in order. ``links`` (doi, pos, content_type, url): PDF links of the publisher, then the landing
    page (content_type null).
    """
    pdf, landing = F.col("url_for_pdf"), F.col("url_for_landing_page")
    pmc = F.when(filled(pdf), F.lower(pdf).contains("pmc")).otherwise(landing.contains("ncbi") & landing.contains("PMC"))
    places = locations.select(
        "doi",
        F.when(filled(pdf), pdf).otherwise(landing).alias("url"),
        F.when(pmc, 0).otherwise(1).alias("class"),
        F.when(pmc, -F.col("pos")).otherwise(F.col("pos")).alias("place"),
    )
    publisher = links.where((F.col("content_type") == "application/pdf") | F.col("content_type").isNull()).select(
        "doi", "url", F.when(F.col("content_type").isNull(), 3).otherwise(2).alias("class"), F.col("pos").alias("place")
    )
    every = places.unionByName(publisher).where(filled("url"))
    return every.select("doi", "url", F.row_number().over(W.partitionBy("doi").orderBy("class", "place", "url")).alias("rank"))
