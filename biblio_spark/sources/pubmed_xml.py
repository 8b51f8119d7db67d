"""PubMed XML files as parsed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblio_spark.functions.dates import iso_date
from biblio_spark.functions.text import strip

_TEXT = "struct<_VALUE: string>"
_DATE = "struct<Year: string, Month: string, Day: string, Hour: string, Minute: string, Season: string, MedlineDate: string>"
_IDS = "struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>"
_ARTICLE = (
    "struct<_PubModel: string, "
    "Journal: struct<ISSN: array<struct<_VALUE: string, _IssnType: string>>, JournalIssue: struct<Volume: string, Issue: string, "
    f"PubDate: {_DATE}>, Title: string, ISOAbbreviation: string>, "
    "ArticleTitle: string, Pagination: struct<StartPage: string, EndPage: string, MedlinePgn: string>, "
    "ELocationID: array<struct<_VALUE: string, _EIdType: string>>, "
    "Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string>>>, "
    "AuthorList: struct<Author: array<struct<_ValidYN: string, LastName: string, ForeName: string, Initials: string, "
    "AffiliationInfo: array<struct<Affiliation: string>>>>>, "
    "Language: array<string>, "
    "GrantList: struct<Grant: array<struct<GrantID: string, Acronym: string, Agency: string, Country: string>>>, "
    "PublicationTypeList: struct<PublicationType: array<struct<_VALUE: string, _UI: string>>>, "
    "ArticleDate: array<struct<_DateType: string, Year: string, Month: string, Day: string, Hour: string, Minute: string>>>"
)
SCHEMA = (
    f"MedlineCitation struct<_Status: string, _Owner: string, _IndexingMethod: string, PMID: {_TEXT}, DateCompleted: {_DATE}, DateRevised: {_DATE}, "
    f"Article: {_ARTICLE}, MeshHeadingList: struct<MeshHeading: array<struct<"
    "DescriptorName: struct<_VALUE: string, _UI: string, _MajorTopicYN: string>, "
    "QualifierName: array<struct<_VALUE: string, _UI: string, _MajorTopicYN: string>>>>>>, "
    "PubmedData struct<History: struct<PubMedPubDate: array<struct<_PubStatus: string, Year: string, Month: string, Day: string, Hour: string, Minute: string>>>, "
    f"ArticleIdList: {_IDS}, ReferenceList: array<struct<Reference: array<struct<Citation: string, ArticleIdList: {_IDS}>>>>>"
)


def _first(array: Column, attribute: str, value: str) -> Column:
    return strip(F.get(F.filter(array, lambda x: x[attribute] == value), F.lit(0))["_VALUE"])


def _date(d: Column) -> Column:
    parts = [strip(d[p]) for p in ("Year", "Month", "Day", "Hour", "Minute")]
    return F.struct(*(p.alias(n) for p, n in zip(parts, ("year", "month", "day", "hour", "minute"), strict=True)), iso_date(*parts).alias("iso_date"))


def _last_id(ids: Column, kind: str) -> Column:
    """The last non-empty id of a type."""
    found = F.filter(ids, lambda x: (x["_IdType"] == kind) & (strip(x["_VALUE"]) != ""))
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1)["_VALUE"]))


def read_pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """A row for each PubmedArticle: pmid, title, journal, authors with affiliations, abstract with labelled sections, dates,
    ids of the article itself (not of its references), MeSH headings, types, grants, references, language, pages.

    The reader splits files at the row tag, so a file is never held whole. Texts keep the white space at their ends; ids and dates do not.
    """
    raw = spark.read.format("xml").options(rowTag="PubmedArticle", ignoreSurroundingSpaces=False).schema(SCHEMA).load(path)
    return parse(raw)


def parse(raw: DataFrame) -> DataFrame:
    m, article, journal = F.col("MedlineCitation"), F.col("MedlineCitation.Article"), F.col("MedlineCitation.Article.Journal")
    texts = article["Abstract"]["AbstractText"]
    ids = F.col("PubmedData.ArticleIdList.ArticleId")
    published = journal["JournalIssue"]["PubDate"]
    year, month, day = (strip(published[p]) for p in ("Year", "Month", "Day"))
    return raw.select(
        strip(m["PMID"]["_VALUE"]).alias("pmid"),
        article["ArticleTitle"].alias("title"),
        m["_Status"].alias("medline_citation_status"),
        m["_Owner"].alias("medline_citation_owner"),
        m["_IndexingMethod"].alias("indexing_method"),
        journal["Title"].alias("journal_title"),
        journal["ISOAbbreviation"].alias("journal_iso_abbreviation"),
        _first(journal["ISSN"], "_IssnType", "Print").alias("issn_print"),
        _first(journal["ISSN"], "_IssnType", "Electronic").alias("issn_electronic"),
        journal["JournalIssue"]["Volume"].alias("volume"),
        journal["JournalIssue"]["Issue"].alias("issue"),
        article["_PubModel"].alias("pub_model"),
        F.struct(
            year.alias("year"), month.alias("month"), day.alias("day"), published["Season"].alias("season"),
            published["MedlineDate"].alias("medline_date"), iso_date(year, month, day).alias("iso_date"),
        ).alias("journal_pub_date"),
        F.transform(
            article["AuthorList"]["Author"],
            lambda a: F.struct(
                a["LastName"].alias("last_name"), a["ForeName"].alias("fore_name"), a["Initials"].alias("initials"), a["_ValidYN"].alias("valid_yn"),
                F.filter(F.transform(a["AffiliationInfo"], lambda x: x["Affiliation"]), lambda x: x != "").alias("affiliations"),
            ),
        ).alias("authors"),
        F.struct(
            F.coalesce(F.get(texts, F.lit(0))["_VALUE"], F.lit("")).alias("text"),
            F.transform(
                F.filter(texts, lambda t: t["_Label"].isNotNull() & (t["_VALUE"] != "")),
                lambda t: F.struct(t["_Label"].alias("label"), t["_VALUE"].alias("text")),
            ).alias("structured"),
        ).alias("abstract"),
        _date(m["DateCompleted"]).alias("date_completed"),
        _date(m["DateRevised"]).alias("date_revised"),
        _date(F.get(F.filter(article["ArticleDate"], lambda d: d["_DateType"] == "Electronic"), F.lit(0))).alias("electronic_pub_date"),
        F.transform(
            F.col("PubmedData.History.PubMedPubDate"), lambda d: F.struct(d["_PubStatus"].alias("pub_status"), _date(d).alias("date"))
        ).alias("pubmed_pub_dates"),
        F.struct(
            *(_last_id(ids, kind).alias(name) for name, kind in (("pubmed", "pubmed"), ("doi", "doi"), ("pii", "pii"), ("pmc", "pmc"))),
            _first(article["ELocationID"], "_EIdType", "doi").alias("elocation_doi"),
        ).alias("identifiers"),
        F.transform(
            F.filter(m["MeshHeadingList"]["MeshHeading"], lambda h: h["DescriptorName"].isNotNull()),
            lambda h: F.struct(
                F.coalesce(h["DescriptorName"]["_VALUE"], F.lit("")).alias("descriptor_name"), h["DescriptorName"]["_UI"].alias("descriptor_ui"),
                F.coalesce(h["DescriptorName"]["_MajorTopicYN"], F.lit("N")).alias("major_topic_yn"),
                F.transform(
                    h["QualifierName"],
                    lambda q: F.struct(
                        q["_VALUE"].alias("qualifier_name"), q["_UI"].alias("qualifier_ui"), F.coalesce(q["_MajorTopicYN"], F.lit("N")).alias("major_topic_yn")
                    ),
                ).alias("qualifiers"),
            ),
        ).alias("mesh_headings"),
        F.transform(
            F.filter(article["PublicationTypeList"]["PublicationType"], lambda t: t["_VALUE"] != ""),
            lambda t: F.struct(t["_VALUE"].alias("type"), t["_UI"].alias("ui")),
        ).alias("publication_types"),
        F.transform(
            article["GrantList"]["Grant"],
            lambda g: F.struct(g["GrantID"].alias("grant_id"), g["Acronym"].alias("acronym"), g["Agency"].alias("agency"), g["Country"].alias("country")),
        ).alias("grants"),
        F.transform(
            F.flatten(F.transform(F.col("PubmedData.ReferenceList"), lambda r: r["Reference"])),
            lambda r: F.struct(
                r["Citation"].alias("citation"),
                *(_last_id(r["ArticleIdList"]["ArticleId"], kind).alias(name) for name, kind in (("pubmed", "pubmed"), ("doi", "doi"), ("pmc", "pmc"))),
            ),
        ).alias("references"),
        F.get(article["Language"], F.lit(0)).alias("language"),
        article["Pagination"]["StartPage"].alias("start_page"),
        article["Pagination"]["EndPage"].alias("end_page"),
        article["Pagination"]["MedlinePgn"].alias("medline_pgn"),
    )
