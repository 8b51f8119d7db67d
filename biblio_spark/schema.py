"""The unified record: one nested row for each publication."""

from __future__ import annotations

ARTICLE = (
    "struct<primary_doi: string, title: string, abstract: string, language: string, publication_year: int, "
    "publication_date: string, updated_date: string, citation_count: int, reference_count: int, "
    "influential_citation_count: int, is_open_access: boolean, open_access_url: string>"
)
AUTHOR = (
    "struct<full_name: string, last_name: string, fore_name: string, initials: string, orcid: string, "
    "semantic_scholar_id: string, affiliation: string, is_corresponding: boolean, author_order: int>"
)
VENUE = (
    "struct<venue_name: string, venue_type: string, iso_abbreviation: string, issn_print: string, issn_electronic: string, "
    "publisher: string, country: string>"
)
PUBLICATION = "struct<volume: string, issue: string, start_page: string, end_page: string, page_range: string, article_number: string>"
IDENTIFIER = "struct<identifier_type: string, identifier_value: string, is_primary: boolean>"
CATEGORY = "struct<category_name: string, category_code: string, category_type: string, is_major_topic: boolean, confidence_score: double>"
PUBLICATION_TYPE = "struct<type_name: string, type_code: string, source_type: string>"
SOURCE = "struct<source: string, raw: string>"

#: ``ord`` is the input order, which decides every tie and every "first"; it comes from the data.
RECORD = {
    "ord": "long",
    "record_id": "string",
    "article": ARTICLE,
    "authors": f"array<{AUTHOR}>",
    "venue": VENUE,
    "publication": PUBLICATION,
    "identifiers": f"array<{IDENTIFIER}>",
    "categories": f"array<{CATEGORY}>",
    "publication_types": f"array<{PUBLICATION_TYPE}>",
    "source_specific": SOURCE,
}
RECORD_DDL = ", ".join(f"{name} {kind}" for name, kind in RECORD.items())

# Members of the enumerations.
IDENTIFIER_TYPES = ("doi", "pmid", "arxiv_id", "semantic_scholar_id", "wos_uid", "pii", "pmc_id", "corpus_id")
VENUE_TYPES = ("journal", "conference", "preprint_server", "book", "other")
CATEGORY_TYPES = ("mesh_descriptor", "arxiv_category", "field_of_study", "wos_category", "other")
PUBLICATION_TYPE_SOURCES = ("pubmed", "semantic_scholar", "wos", "general")


def field_names(kind: str) -> list[str]:
    """Names of the fields of a struct type given as text."""
    return [part.split(":")[0].strip() for part in kind[kind.index("<") + 1 : kind.rindex(">")].split(",")]


def struct_of(kind: str, **values):
    """A struct of the given type: the named fields as given, all others null."""
    from pyspark.sql import functions as F

    missing = set(values) - set(field_names(kind))
    if missing:
        raise ValueError(f"no such field: {sorted(missing)}")
    null = F.lit(None)
    return F.struct(*(values.get(name, null).alias(name) for name in field_names(kind))).cast(kind)


def with_ord(records):
    """``records``, of which none may lack ``ord``: a null would silently drop out of joins on it."""
    from pyspark.sql import functions as F

    known = F.when(F.col("ord").isNotNull(), F.col("ord")).otherwise(F.raise_error(F.lit("a record without ord: number the records first")).cast("long"))
    return records.withColumn("ord", known)
