"""Questions to the catalogue and to search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biblio_spark.functions.identifiers import DOI_PATTERN


def search_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source, found, total, sources_searched, duplicates_removed), a row for each source of the results before de-duplication."""
    source = F.col("source_specific.source").alias("source")
    found = before.groupBy(source).agg(F.count("*").alias("found"))
    kept = after.groupBy(source).agg(F.count("*").alias("kept"))
    # a row for each source: totals over all of them are cheap
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = found.join(kept, "source", "left").withColumns(
        {
            "total": F.coalesce(F.sum("kept").over(every), F.lit(0)),
            "sources_searched": F.count("*").over(every),
            "_before": F.sum("found").over(every),
        }
    )
    return out.select("source", "found", "total", "sources_searched", (F.col("_before") - F.col("total")).alias("duplicates_removed"))


def author_articles(articles, article_authors, authors, article_publications, venues, article_sources, data_sources, identifiers, name: str) -> DataFrame:
    """Articles of authors whose name holds ``name``: title, year, venue, sources and DOIs joined in order, newest first."""
    who = authors.where(F.lower("full_name").contains(name.lower())).select("author_id", "full_name")
    own = article_authors.join(who, "author_id").select("article_id", "full_name")
    ids = own.select("article_id").distinct()
    joined = lambda df, c, out: df.groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(out))
    sources = joined(article_sources.join(ids, "article_id", "left_semi").join(data_sources, "source_id"), "source_name", "sources")
    dois = joined(identifiers.where("identifier_type = 'doi'").join(ids, "article_id", "left_semi"), "identifier_value", "dois")
    places = article_publications.join(venues, "venue_id").select("article_id", "venue_name")
    out = own.join(articles.select("article_id", "title", "publication_year"), "article_id")
    for part in (places, sources, dois):
        out = out.join(part, "article_id", "left")
    return out.select("full_name", "article_id", "title", "publication_year", "venue_name", "sources", "dois").orderBy(F.desc("publication_year"), "article_id", "full_name")


def top_cited(articles, article_categories, categories, article_sources, data_sources, subject: str, least: int = 100, n: int = 50) -> DataFrame:
    """The ``n`` most cited articles of a subject with more than ``least`` citations and their sources. The cut comes before the
    sources are joined."""
    chosen = categories.where(F.col("category_name") == subject).select("category_id")
    ids = article_categories.join(chosen, "category_id", "left_semi").select("article_id").distinct()
    top = articles.where(F.col("citation_count") > least).join(ids, "article_id", "left_semi").orderBy(F.desc("citation_count"), "article_id").limit(n)
    sources = article_sources.join(F.broadcast(top.select("article_id")), "article_id", "left_semi").join(data_sources, "source_id")
    sources = sources.groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("sources"))
    return top.join(sources, "article_id", "left").select("article_id", "title", "publication_year", "citation_count", "sources")


def source_coverage(articles, article_sources, data_sources, identifiers) -> DataFrame:
    """By source: distinct articles, their average citations, and how many have a DOI. Identifiers shrink to a flag for each
    article before the join, so nothing fans out."""
    has = identifiers.where("identifier_type = 'doi'").select("article_id").distinct().withColumn("has_doi", F.lit(1))
    rows = article_sources.select("article_id", "source_id").distinct().join(articles.select("article_id", "citation_count"), "article_id").join(has, "article_id", "left")
    out = rows.groupBy("source_id").agg(
        F.count("*").alias("articles"), F.round(F.avg("citation_count"), 4).alias("avg_citations"), F.count("has_doi").alias("articles_with_doi")
    )
    return out.join(data_sources, "source_id").select("source_name", "articles", "avg_citations", "articles_with_doi")


def year_distribution(articles: DataFrame) -> DataFrame:
    return articles.groupBy("publication_year").agg(F.count("*").alias("articles"))


def _ranked(df: DataFrame, name: str, n: int) -> DataFrame:
    """The rows of rank ``n`` or better, ties at the limit included. The first ``n`` bound them, so only rows that reach the last of these
    are ranked in one task."""
    cited = F.coalesce("citations", F.lit(-1))
    first = df.orderBy(F.desc("articles"), F.desc(cited), name).select("articles", cited.alias("c")).limit(n).collect()
    if len(first) == n:
        df = df.where((F.col("articles") > first[-1]["articles"]) | ((F.col("articles") == first[-1]["articles"]) & (cited >= first[-1]["c"])))
    return df.withColumn("rank", F.rank().over(W.orderBy(F.desc("articles"), F.desc("citations"))))


def venue_ranking(articles, article_publications, venues, n: int = 50) -> DataFrame:
    rows = article_publications.join(articles.select("article_id", "citation_count"), "article_id").join(venues, "venue_id")
    return _ranked(rows.groupBy("venue_name").agg(F.count("*").alias("articles"), F.sum("citation_count").cast("long").alias("citations")), "venue_name", n)


def author_ranking(articles, article_authors, authors, n: int = 50) -> DataFrame:
    rows = article_authors.join(articles.select("article_id", "citation_count"), "article_id")
    stats = rows.groupBy("author_id").agg(F.count("*").alias("articles"), F.sum("citation_count").cast("long").alias("citations"))
    return _ranked(stats.join(authors.select("author_id", "full_name"), "author_id").drop("author_id"), "full_name", n)


def quality_report(articles, article_authors, identifiers) -> DataFrame:
    """(issue, n): articles without identifiers, articles without authors, DOIs that are none."""
    without = lambda child, name: articles.join(child.select("article_id").distinct(), "article_id", "left_anti").agg(F.lit(name).alias("issue"), F.count("*").alias("n"))
    bad = identifiers.where((F.col("identifier_type") == "doi") & ~F.col("identifier_value").rlike(DOI_PATTERN))
    return (
        without(identifiers, "articles without identifiers")
        .unionByName(without(article_authors, "articles without authors"))
        .unionByName(bad.agg(F.lit("bad DOIs").alias("issue"), F.count("*").alias("n")))
    )
