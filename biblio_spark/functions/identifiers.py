"""Identifiers of publications: normal forms, patterns, access."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biblio_spark.functions.text import col, filled, nonblank, strip
from biblio_spark.schema import IDENTIFIER, struct_of

#: Types that link records, most telling first.
PRIORITY = ("doi", "pmid", "arxiv_id", "semantic_scholar_id", "wos_uid")

# Patterns of well-formed identifiers.
DOI_PATTERN = r"^10\.\d{4,}/[^\s]+$"
PMID_PATTERN = r"^\d+$"
ARXIV_PATTERN = r"^(\d{4}\.\d{4,5}|[a-z-]+(\.[A-Z]{2})?/\d{7})(v\d+)?$"


def normalize_identifier(kind: Column | str, value: Column | str) -> Column:
    """Trimmed and in lower case; a DOI without resolver prefix and outer slashes, a PMID as digits only, an arXiv id
    without prefix and version. Null becomes empty."""
    kind, v = col(kind), F.lower(strip(F.coalesce(col(value), F.lit(""))))
    doi = F.regexp_replace(v, r"^(doi:|https?://doi\.org/|https?://dx\.doi\.org/)", "")
    return (
        F.when(kind == "doi", F.regexp_replace(doi, r"^/+|/+$", ""))
        .when(kind == "pmid", F.regexp_replace(v, r"[^0-9]", ""))
        .when(kind == "arxiv_id", F.regexp_replace(F.regexp_replace(v, r"^arxiv:", ""), r"v[0-9]+$", ""))
        .otherwise(v)
    )


def is_valid_identifier(kind: Column | str, value: Column | str) -> Column:
    """Does a trimmed DOI, PMID or arXiv id match its pattern; other types always do. Null does not."""
    kind, v = col(kind), strip(value)
    fits = F.when(kind == "doi", v.rlike(DOI_PATTERN)).when(kind == "pmid", v.rlike(PMID_PATTERN)).when(kind == "arxiv_id", v.rlike(ARXIV_PATTERN))
    return F.coalesce(F.when(kind.isin("doi", "pmid", "arxiv_id"), fits).otherwise(F.lit(True)), F.lit(False))


def extract_identifiers(identifiers: Column | str = "identifiers", raw: Column | str | None = "source_specific.raw") -> Column:
    """type -> value. The last value of a type in the list wins; the ids in the raw payload (JSON) override it."""
    listed = F.filter(F.coalesce(col(identifiers), F.array().cast(f"array<{IDENTIFIER}>")), lambda i: filled(i["identifier_type"]) & filled(i["identifier_value"]))
    pairs = F.transform(listed, lambda i: F.struct(i["identifier_type"].alias("k"), i["identifier_value"].alias("v")))
    if raw is not None:
        known = (("pmid", "$.pmid"), ("arxiv_id", "$.arxiv_id"), ("semantic_scholar_id", "$.paperId"))
        extra = F.array(*(F.struct(F.lit(k).alias("k"), F.get_json_object(col(raw), path).alias("v")) for k, path in known))
        pairs = F.concat(pairs, F.filter(extra, lambda p: p["v"].isNotNull()))
    kinds = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def get_identifier(identifiers: Column | str, kind: str, primary_only: bool = False) -> Column:
    """The first value of a type, or null."""
    found = F.filter(col(identifiers), lambda i: (i["identifier_type"] == kind) & (i["is_primary"] if primary_only else F.lit(True)))
    return F.get(found, F.lit(0))["identifier_value"]


def add_identifier(identifiers: Column | str, kind: str, value: Column | str, primary: bool = False) -> Column:
    """The list with one more identifier, trimmed; blank values and pairs that are there already are not added."""
    ids, v = F.coalesce(col(identifiers), F.array().cast(f"array<{IDENTIFIER}>")), strip(value)
    there = F.exists(ids, lambda i: (i["identifier_type"] == kind) & (i["identifier_value"] == v))
    new = struct_of(IDENTIFIER, identifier_type=F.lit(kind), identifier_value=v, is_primary=F.lit(primary))
    return F.when(nonblank(value) & ~there, F.array_append(ids, new)).otherwise(ids)


def add_named(items: Column | str, kind: str, name: Column | str, field: str, **more: Column) -> Column:
    """The array of structs (``kind``) with one more whose ``field`` is the trimmed name; a blank name is not added."""
    array = F.coalesce(col(items), F.array().cast(f"array<{kind}>"))
    return F.when(nonblank(name), F.array_append(array, struct_of(kind, **{field: strip(name)}, **more))).otherwise(array)
