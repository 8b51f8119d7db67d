"""Text columns: white space, titles, names, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that titles are compared without.
STOP_WORDS = ("a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without spaces, tabs, line and form feeds and carriage returns at both ends, also where another line separator follows."""
    return F.regexp_replace(col(c), r"^[ \t\n\f\r]+|[ \t\n\f\r]+\z", "")


def filled(c: Column | str) -> Column:
    """Neither null nor empty; never null itself."""
    return F.coalesce(col(c) != "", F.lit(False))


def nonblank(c: Column | str) -> Column:
    """Has more than white space; never null itself."""
    return F.coalesce(strip(c) != "", F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    return F.when(nonblank(c), strip(c))


def normalize_title(c: Column | str) -> Column:
    """Lower case, punctuation to spaces, single spaces, no stop words; null becomes empty."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS)), " ")


def normalize_author(c: Column | str) -> Column:
    """Punctuation but hyphens to spaces, single spaces, lower case; null becomes empty."""
    plain = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^\p{L}\p{N}_\s\-]", " ")
    return F.lower(strip(F.regexp_replace(plain, r"\s+", " ")))


def author_names(authors: Column | str) -> Column:
    """Normalised full names of an author array; empty names are left out."""
    names = F.transform(F.filter(col(authors), lambda a: filled(a["full_name"])), lambda a: normalize_author(a["full_name"]))
    return F.coalesce(names, F.array().cast("array<string>"))


def extract_pdf_links(html: Column | str) -> Column:
    """All ``//...pdf`` links of a page, with ``https:`` before them."""
    return F.transform(F.regexp_extract_all(col(html), F.lit(r"""(//[^\s<>"]+\.pdf)"""), 1), lambda u: F.concat(F.lit("https:"), u))


def doi_folder(doi: Column | str) -> Column:
    return F.md5(col(doi))


#: Names of document types here and in the bulk interface.
DOCUMENT_TYPES = {"Review": "Review", "Article": "JournalArticle", "Book": "Book"}


def map_document_type(c: Column | str, direction: str = "to_normal") -> Column:
    """Between the two names of a document type. ``to_normal`` keeps what it does not know; ``to_semantic`` gives an empty
    text for none and for "all", null for what it does not know."""
    c = col(c)
    if direction == "to_normal":
        table = F.create_map(*(F.lit(x) for pair in DOCUMENT_TYPES.items() for x in reversed(pair)))
        return F.coalesce(F.try_element_at(table, c), c)
    table = F.create_map(*(F.lit(x) for pair in DOCUMENT_TYPES.items() for x in pair))
    return F.when(~filled(c) | (F.lower(c) == "all"), F.lit("")).otherwise(F.try_element_at(table, c))


def is_valid_uuid(c: Column | str) -> Column:
    """A UUID as text: 32 hex digits with or without hyphens in their places, braces or a ``urn:uuid:`` before it."""
    digits = F.regexp_replace(F.lower(col(c)), r"^urn:uuid:|[{}]|-", "")
    return F.coalesce(digits.rlike(r"^[0-9a-f]{32}$"), F.lit(False))


def is_nil_uuid(c: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(col(c), "-", "") == "0" * 32, F.lit(False))
