"""Validation of unified records as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblio_spark.functions.dates import is_valid_date
from biblio_spark.functions.identifiers import is_valid_identifier
from biblio_spark.functions.scores import completeness_pct, quality_score
from biblio_spark.functions.text import col, filled, nonblank, strip
from biblio_spark.schema import VENUE_TYPES

# Lengths in characters, and what the validator knows as identifier types.
LIMITS = {"title": (10, 500), "abstract": (50, 5000), "doi": (10, 100), "pmid": (1, 20)}
KNOWN_IDS = ("doi", "pmid", "arxiv_id", "semantic_scholar_id", "wos_uid", "pii", "pmc_id")
YEARS, GATE_YEARS = (1900, 1), (1000, 5)

_ISSUE = "struct<message: string, field: string>"


def _issue(when: Column, message: Column | str, field: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    place = F.lit(field) if isinstance(field, str) else field
    return F.when(F.coalesce(when, F.lit(False)), F.struct(text.alias("message"), place.alias("field")).cast(_ISSUE))


def _text(value: Column, *parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _length_issue(name: str, value: Column) -> list[Column]:
    low, high = LIMITS[name]
    n, label = F.length(value), name.capitalize()
    return [
        _issue((n > 0) & (n < low), f"{label} is too short (minimum {low} characters)", name),
        _issue(n > high, f"{label} is too long (maximum {high} characters)", name),
    ]


def article_issues(current_year: int) -> tuple[list[Column], list[Column]]:
    """(errors, warnings) of the article fields."""
    title, abstract = (strip(F.coalesce(F.col(f"article.{f}"), F.lit(""))) for f in ("title", "abstract"))
    year, date = F.col("article.publication_year"), F.col("article.publication_date")
    errors = [
        _issue(title == "", "Title is required", "title"),
        _issue(
            (year != 0) & ~year.between(YEARS[0], current_year + YEARS[1]), F.concat(F.lit("Invalid publication year: "), year.cast("string")), "publication_year"
        ),
        _issue(filled(date) & ~is_valid_date(date), F.concat(F.lit("Invalid publication date format: "), date), "publication_date"),
        _issue(F.col("article.citation_count") < 0, "Citation count must be a non-negative number", "citation_count"),
        _issue(F.col("article.reference_count") < 0, "Reference count must be a non-negative number", "reference_count"),
    ]
    warnings = [*_length_issue("title", title), *_length_issue("abstract", abstract), _issue(abstract == "", "Abstract is missing", "abstract")]
    return errors, warnings


def author_warnings() -> Column:
    """None at all, a blank name, or a name of one character, by place."""
    none = F.coalesce(F.size("authors"), F.lit(0)) == 0

    def one(a: Column, i: Column) -> Column:
        name, place = strip(F.coalesce(a["full_name"], F.lit(""))), F.concat(F.lit("authors["), i.cast("string"), F.lit("].full_name"))
        number = (i + 1).cast("string")
        return F.coalesce(
            _issue(name == "", F.concat(F.lit("Author "), number, F.lit(" missing full name")), place),
            _issue(F.length(name) < 2, F.concat(F.lit("Author "), number, F.lit(" name too short")), place),
        )

    missing = F.array(_issue(none, "No authors specified", "authors"))
    return F.when(none, missing).otherwise(F.array_compact(F.transform("authors", one)))


def identifier_issues() -> tuple[Column, Column]:
    """(errors, warnings): missing parts, formats and lengths; unknown and repeated types."""
    none = F.coalesce(F.size("identifiers"), F.lit(0)) == 0
    ids = F.col("identifiers")
    place = lambda i, f: F.concat(F.lit("identifiers["), i.cast("string"), F.lit(f"].{f}"))
    whole = lambda x: filled(x["identifier_type"]) & filled(x["identifier_value"])
    label = lambda k: F.when(k == "doi", "DOI").when(k == "pmid", "PMID").otherwise("ArXiv ID")

    def errors_of(x: Column, i: Column) -> Column:
        kind, value = x["identifier_type"], strip(x["identifier_value"])
        number, n = (i + 1).cast("string"), F.length(value)
        lengths = [
            _issue(
                whole(x) & (kind == name) & ~n.between(low, high),
                F.concat(F.lit(f"Invalid {name} length: "), n.cast("string"), F.lit(f" (expected {low}-{high})")),
                place(i, "identifier_value"),
            )
            for name, (low, high) in LIMITS.items()
            if name in ("doi", "pmid")
        ]
        return F.array_compact(
            F.array(
                _issue(~filled(kind), F.concat(F.lit("Identifier "), number, F.lit(" missing type")), place(i, "identifier_type")),
                _issue(filled(kind) & ~filled(x["identifier_value"]), F.concat(F.lit("Identifier "), number, F.lit(" missing value")), place(i, "identifier_value")),
                _issue(
                    whole(x) & ~is_valid_identifier(kind, value), F.concat(F.lit("Invalid "), label(kind), F.lit(" format: "), value), place(i, "identifier_value")
                ),
                *lengths,
            )
        )

    def warnings_of(x: Column, i: Column) -> Column:
        kind = x["identifier_type"]
        earlier = F.slice(ids, F.lit(1), i)
        return F.array_compact(
            F.array(
                _issue(whole(x) & ~kind.isin(*KNOWN_IDS), F.concat(F.lit("Unknown identifier type: "), kind), place(i, "identifier_type")),
                _issue(
                    whole(x) & F.exists(earlier, lambda e: (e["identifier_type"] == kind) & filled(e["identifier_value"])),
                    F.concat(F.lit("Duplicate identifier type: "), kind),
                    place(i, "identifier_type"),
                ),
            )
        )

    empty = F.array().cast(f"array<{_ISSUE}>")
    warnings = F.when(none, F.array(_issue(none, "No identifiers specified", "identifiers"))).otherwise(F.flatten(F.transform(ids, warnings_of)))
    return F.when(none, empty).otherwise(F.flatten(F.transform(ids, errors_of))), warnings


def venue_warnings() -> list[Column]:
    name, kind = strip(F.coalesce(F.col("venue.venue_name"), F.lit(""))), F.col("venue.venue_type")
    none = F.col("venue").isNull()
    return [
        _issue(none, "No venue information", "venue"),
        _issue(~none & (name == ""), "Venue name is missing", "venue.venue_name"),
        _issue((name != "") & (F.length(name) < 3), "Venue name is too short", "venue.venue_name"),
        _issue(filled(kind) & ~kind.isin(*VENUE_TYPES), F.concat(F.lit("Unknown venue type: "), kind), "venue.venue_type"),
    ]


def validate(lit: DataFrame, current_year: int) -> DataFrame:
    """``lit`` with is_valid, errors, warnings (arrays of message and field), quality_score and completeness_score. A row that
    the reader could not parse (``_corrupt_record``, if there is such a column) is one error."""
    errors, warnings = article_issues(current_year)
    if "_corrupt_record" in lit.columns:
        errors.append(_issue(F.col("_corrupt_record").isNotNull(), "Record could not be read", "_corrupt_record"))
    id_errors, id_warnings = identifier_issues()
    return lit.select(
        "*",
        F.concat(F.array_compact(F.array(*errors)), id_errors).alias("errors"),
        F.concat(F.array_compact(F.array(*warnings)), author_warnings(), id_warnings, F.array_compact(F.array(*venue_warnings()))).alias("warnings"),
        quality_score().alias("quality_score"),
        completeness_pct().alias("completeness_score"),
    ).withColumn("is_valid", F.size("errors") == 0)


def validation_stats(validated: DataFrame) -> DataFrame:
    """validated, valid, invalid, errors, warnings: one row, zeros for an empty table."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return validated.agg(
        F.count("*").alias("validated"),
        total(F.col("is_valid").cast("int")).alias("valid"),
        total((~F.col("is_valid")).cast("int")).alias("invalid"),
        total(F.size("errors")).alias("errors"),
        total(F.size("warnings")).alias("warnings"),
    )


def passes_load_gate(current_year: int) -> Column:
    """May the record be loaded: a title, a year from 1000 to five years ahead if there is one, names for all authors, values
    for all identifiers, no negative counts."""
    year = col("article.publication_year")
    low, ahead = GATE_YEARS
    return (
        nonblank("article.title")
        & F.coalesce(year.between(low, current_year + ahead), F.lit(True))
        & ~F.coalesce(F.exists("authors", lambda a: ~nonblank(a["full_name"])), F.lit(False))
        & ~F.coalesce(F.exists("identifiers", lambda i: ~nonblank(i["identifier_value"])), F.lit(False))
        & (F.coalesce(col("article.citation_count"), F.lit(0)) >= 0)
        & (F.coalesce(col("article.reference_count"), F.lit(0)) >= 0)
    )
