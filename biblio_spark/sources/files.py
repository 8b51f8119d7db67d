"""Results as files, lists of ids from files, and checks of delivered files."""

from __future__ import annotations

from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblio_spark.functions.identifiers import get_identifier
from biblio_spark.functions.text import filled
from biblio_spark.sources.json_members import read_heads, readable

LEAST_BYTES = 1024


def write_json(lit: DataFrame, path: str) -> None:
    lit.write.json(path)


def flat_records(lit: DataFrame) -> DataFrame:
    """One flat row a record: scalars as they are, lists joined by "; "."""
    return lit.select(
        "record_id",
        F.col("source_specific.source").alias("source"),
        F.col("article.title").alias("title"),
        F.array_join(F.transform("authors", lambda a: a["full_name"]), "; ").alias("authors"),
        F.col("venue.venue_name").alias("venue"),
        F.col("article.publication_year").alias("year"),
        F.col("article.publication_date").alias("date"),
        *(get_identifier("identifiers", kind).alias(kind) for kind in ("doi", "pmid", "arxiv_id")),
        F.col("article.citation_count").alias("citation_count"),
        F.array_join(F.transform("categories", lambda c: c["category_name"]), "; ").alias("categories"),
        F.col("article.abstract").alias("abstract"),
    )


def write_csv(lit: DataFrame, path: str) -> None:
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    flat_records(lit).write.options(**options).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_csv`` wrote, as strings; texts keep their quotes, line feeds and outer spaces."""
    return spark.read.options(header=True, escape='"', multiLine=True, lineSep="\n").csv(path)


def bibtex_entry() -> Column:
    """A record as one BibTeX entry; fields without a value are left out, braces and backslashes are escaped."""

    def field(name: str, value: Column) -> Column:
        safe = F.regexp_replace(value.cast("string"), r"([{}\\])", r"\\$1")
        return F.when(filled(value.cast("string")), F.concat(F.lit(f"  {name} = {{"), safe, F.lit("}")))

    kind = F.when(F.col("venue.venue_type") == "journal", "article").when(F.col("venue.venue_type") == "conference", "inproceedings").otherwise("misc")
    fields = F.array_compact(
        F.array(
            field("title", F.col("article.title")),
            field("author", F.array_join(F.transform("authors", lambda a: a["full_name"]), " and ")),
            field("year", F.col("article.publication_year")),
            field("journal", F.col("venue.venue_name")),
            field("volume", F.col("publication.volume")),
            field("number", F.col("publication.issue")),
            field("doi", get_identifier("identifiers", "doi")),
        )
    )
    return F.concat(F.lit("@"), kind, F.lit("{"), F.concat(F.lit("rec"), F.col("record_id")), F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}\n"))


def write_bibtex(lit: DataFrame, path: str) -> None:
    lit.select(bibtex_entry().alias("value")).write.text(path)


def with_id_columns(df: DataFrame) -> DataFrame:
    """The table with text columns doi, pmid and url; missing ones are null."""
    for name in ("doi", "pmid", "url"):
        df = df.withColumn(name, F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string"))
    return df


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    return with_id_columns(spark.read.option("header", True).csv(path))


def check_pdf_files(spark: SparkSession, path: str, pattern: str = "*", least: int = LEAST_BYTES) -> DataFrame:
    """path, size, valid of files: at least ``least`` bytes, and a name in .pdf needs ``%PDF-`` as its first bytes. No more than these
    are read of a file."""
    if readable(path):
        name = F.substring_index("path", "/", -1)
        files = read_heads(spark, path).where(name.rlike(translate(pattern)))
    else:  # Spark opens what its tasks cannot, and reads it whole
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
        files = files.select("path", F.col("length").alias("size"), F.substring("content", 1, 5).alias("head"))
    pdf = F.lower("path").endswith(".pdf")
    return files.select("path", "size", ((F.col("size") >= least) & (~pdf | (F.col("head") == F.lit(b"%PDF-")))).alias("valid"))
