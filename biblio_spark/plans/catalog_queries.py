"""Queries over the catalogue, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblio_spark.operators import analytics, links, search
from biblio_spark.operators import catalog as cat
from biblio_spark.plans.registry import query
from biblio_spark.plans.views import CATALOG, CURRENT_YEAR, LIT, catalog, lit

WITH = "WITH" + CATALOG
LOAD = "WITH" + LIT + """
, good AS (SELECT *, CASE WHEN doi IS NOT NULL THEN regexp_replace(lower(doi), '^(doi:|https?://doi\\.org/|https?://dx\\.doi\\.org/)', '') ELSE 'record ' || record_id END AS art
  FROM lit WHERE trim(title) <> ''),
loaded AS (SELECT * FROM good WHERE ord IN (SELECT min(ord) FROM good GROUP BY art))
"""


@query("q7_page", WITH + "SELECT article_id, title FROM articles ORDER BY article_id LIMIT 100 OFFSET 200")
def q7(spark, d):
    return search.page(catalog(spark, d)["articles"].select("article_id", "title"), ["article_id"], 100, 200)


@query("q8_find_by_text", WITH + """
SELECT 'title' AS kind, article_id AS id FROM articles WHERE title ILIKE '%urgent 1%' UNION ALL SELECT 'author', author_id FROM authors WHERE full_name ILIKE '%#%1%'""")
def q8(spark, d):
    c = catalog(spark, d)
    authors = search.find_by_author_name(search.find_by_author_name(c["authors"], "#", "full_name"), "1", "full_name")
    return (
        search.find_by_title(c["articles"], "URGENT 1").select(F.lit("title").alias("kind"), F.col("article_id").alias("id"))
        .unionByName(authors.select(F.lit("author").alias("kind"), F.col("author_id").alias("id")))
    )


@query("q9_lookup", WITH + """
SELECT article_id, identifier_type, identifier_value FROM article_identifiers WHERE identifier_type = 'doi' AND identifier_value IN (SELECT '10.1000/' || o_orderkey FROM orders)""")
def q9(spark, d):
    c = catalog(spark, d)
    wanted = c["articles"].select(F.concat(F.lit("https://doi.org/10.1000/"), F.col("article_id").cast("string")).alias("value"))
    return search.lookup(c["article_identifiers"], "doi", wanted)


@query("j5_crosswalk", WITH + """
SELECT DISTINCT a.identifier_value AS from_value, b.identifier_value AS to_value FROM article_identifiers a JOIN article_identifiers b USING (article_id)
WHERE a.identifier_type = 'doi' AND b.identifier_type = 'pmid'""")
def j5(spark, d):
    return links.crosswalk(catalog(spark, d)["article_identifiers"], "doi", "pmid")


@query("j6_citing", WITH + """
SELECT cited_article_id, citing_article_id FROM (
  SELECT *, row_number() OVER (PARTITION BY cited_article_id ORDER BY citing_article_id) AS n
  FROM (SELECT DISTINCT cited_article_id, citing_article_id FROM citations WHERE cited_article_id IN (SELECT article_id FROM articles))) WHERE n <= 1000""", also="j6_citing_whole")
def j6(spark, d):
    """All articles, with the operator's own limit."""
    c = catalog(spark, d)
    return links.citing(c["citations"], c["articles"].select(F.col("article_id").alias("id"))).select("cited_article_id", "citing_article_id")


@query("j6_references", WITH + """
SELECT citing_article_id, cited_article_id FROM (
  SELECT *, row_number() OVER (PARTITION BY citing_article_id ORDER BY cited_article_id) AS n
  FROM (SELECT DISTINCT citing_article_id, cited_article_id FROM citations WHERE cited_article_id IS NOT NULL AND citing_article_id IN (SELECT article_id FROM articles))) WHERE n <= 1000""", also="j6_references_whole")
def j6b(spark, d):
    c = catalog(spark, d)
    return links.references(c["citations"], c["articles"].select(F.col("article_id").alias("id"))).select("citing_article_id", "cited_article_id")


@query("j7_assemble", LOAD + """
SELECT title, publication_year, array_to_string(authors, '|') AS authors, venue_name, language AS categories, type_name AS types FROM loaded""")
def j7(spark, d):
    df = cat.assemble_literature(cat.load_catalog(lit(spark, d), CURRENT_YEAR))
    join = lambda a, f: F.coalesce(F.array_join(F.transform(a, lambda x: x[f]), "|"), F.lit("")).alias(a)
    return df.select(
        F.col("article.title").alias("title"), F.col("article.publication_year").alias("publication_year"), join("authors", "full_name"),
        F.col("venue.venue_name").alias("venue_name"), join("categories", "category_name"), F.coalesce(F.array_join(F.transform("publication_types", lambda x: x["type_name"]), "|"), F.lit("")).alias("types"),
    )


@query("j8_candidate_duplicates", "WITH" + LIT + """
, t AS (SELECT ord, publication_year AS y, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'),
    lambda w: w <> '' AND NOT list_contains(['a', 'an', 'the', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by'], w)))) AS w FROM lit)
SELECT a.ord AS id1, b.ord AS id2, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS overlap
FROM t a JOIN t b ON a.y = b.y AND a.ord < b.ord AND len(a.w) > 0 AND len(b.w) > 0
WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.6
AND NOT EXISTS (SELECT 1 FROM keys x JOIN keys z USING (key) WHERE x.ord = a.ord AND z.ord = b.ord)""", also="j8_candidate_duplicates_whole")
def j8(spark, d):
    records = lit(spark, d)
    articles = records.select(F.col("ord").alias("article_id"), "article.publication_year", "article.title")
    ids = records.select(F.col("ord").alias("article_id"), F.explode("identifiers").alias("i")).select("article_id", "i.identifier_type", "i.identifier_value")
    return links.candidate_duplicates(articles, ids, 0.6).withColumn("overlap", F.round("overlap", 6))


@query("j8_candidate_classes", "WITH" + LIT + """
, t AS (SELECT ord, publication_year AS y, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'),
    lambda w: w <> '' AND NOT list_contains(['a', 'an', 'the', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by'], w)))) AS w FROM lit),
c AS (SELECT y, w, min(ord) AS class_id, count(*) AS n FROM t WHERE len(w) > 0 GROUP BY y, w)
SELECT a.class_id AS class1, b.class_id AS class2, a.n AS n1, b.n AS n2, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS overlap
FROM c a JOIN c b ON a.y = b.y AND a.class_id < b.class_id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.6
UNION ALL SELECT class_id, class_id, n, n, 1.0 FROM c WHERE n > 1""")
def j8_classes(spark, d):
    """Linked classes with their sizes, and classes of several articles with themselves."""
    articles = lit(spark, d).select(F.col("ord").alias("article_id"), "article.publication_year", "article.title")
    members, linked = links.candidate_classes(articles, 0.6)
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n"))
    of = lambda k: sizes.select(F.col("class_id").alias(f"class{k}"), F.col("n").alias(f"n{k}"))
    several = sizes.where("n > 1").select(F.col("class_id").alias("class1"), F.col("class_id").alias("class2"), F.col("n").alias("n1"), F.col("n").alias("n2"), F.lit(1.0).alias("overlap"))
    return linked.join(of(1), "class1").join(of(2), "class2").select("class1", "class2", "n1", "n2", F.round("overlap", 6).alias("overlap")).unionByName(several)


@query("j9_delete_articles", WITH + """
SELECT 'articles' AS name, count(*) AS n, sum(article_id)::BIGINT AS s FROM articles WHERE article_id % 7 <> 0
""" + "".join(f"UNION ALL SELECT '{t}', count(*), sum(article_id)::BIGINT FROM {t} WHERE article_id % 7 <> 0\n" for t in ("article_authors", "article_publications", "article_categories", "article_sources", "article_identifiers"))
+ "".join(f"UNION ALL SELECT '{t}', count(*), NULL FROM {t}\n" for t in ("authors", "venues", "subject_categories", "data_sources")) + """
UNION ALL SELECT 'citations', count(*), sum(CASE WHEN cited_article_id % 7 <> 0 OR cited_article_id NOT IN (SELECT article_id FROM articles) THEN cited_article_id END)::BIGINT FROM citations WHERE citing_article_id % 7 <> 0""")
def j9(spark, d):
    """All tables of the catalogue; those without articles stay."""
    c = catalog(spark, d)
    out = cat.delete_articles(c, c["articles"].where("article_id % 7 = 0"))
    key = lambda df: F.col("cited_article_id" if "cited_article_id" in df.columns else "article_id") if {"cited_article_id", "article_id"} & set(df.columns) else F.lit(None)
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key(df).cast("long")).alias("s")) for name, df in out.items()]
    return reduce(DataFrame.unionByName, rows)


@query("j10_update_articles", WITH + """
SELECT article_id, CASE WHEN article_id % 5 = 0 THEN 'New ' || article_id ELSE title END AS title, publication_year,
  CASE WHEN article_id % 5 = 0 AND article_id % 2 = 0 THEN 0 ELSE citation_count END AS citation_count FROM articles""")
def j10(spark, d):
    articles = catalog(spark, d)["articles"]
    updates = articles.where("article_id % 5 = 0").select("article_id", F.concat(F.lit("New "), F.col("article_id").cast("string")).alias("title"), F.when(F.col("article_id") % 2 == 0, 0).cast("long").alias("citation_count"))
    return cat.update_articles(articles, updates)


@query("a4_author_articles", WITH + """
SELECT full_name, article_id, title, publication_year, venue_name,
  (SELECT string_agg(source_name, ', ' ORDER BY source_name) FROM article_sources JOIN data_sources USING (source_id) WHERE article_sources.article_id = articles.article_id) AS sources,
  (SELECT string_agg(identifier_value, ', ') FROM article_identifiers i WHERE i.article_id = articles.article_id AND identifier_type = 'doi') AS dois
FROM articles JOIN article_authors USING (article_id) JOIN authors USING (author_id) LEFT JOIN article_publications USING (article_id) LEFT JOIN venues USING (venue_id)
WHERE full_name ILIKE '%000001%'""")
def a4(spark, d):
    c = catalog(spark, d)
    return analytics.author_articles(
        c["articles"], c["article_authors"], c["authors"], c["article_publications"], c["venues"], c["article_sources"], c["data_sources"], c["article_identifiers"], "000001"
    )


@query("a5_top_cited", WITH + """
SELECT article_id, title, publication_year, citation_count,
  (SELECT string_agg(source_name, ', ' ORDER BY source_name) FROM article_sources JOIN data_sources USING (source_id) WHERE article_sources.article_id = articles.article_id) AS sources
FROM articles WHERE citation_count > 100 AND article_id IN (SELECT article_id FROM article_categories WHERE category_id = (SELECT min(p_type) FROM part))
ORDER BY citation_count DESC, article_id LIMIT 50""")
def a5(spark, d):
    c = catalog(spark, d)
    subject = c["subject_categories"].agg(F.min("category_name")).first()[0]
    return analytics.top_cited(c["articles"], c["article_categories"], c["subject_categories"], c["article_sources"], c["data_sources"], subject)


@query("a6_source_coverage", WITH + """
SELECT source_name, count(*) AS articles, round(avg(citation_count), 4) AS avg_citations, count(*) FILTER (article_id IN (SELECT article_id FROM article_identifiers WHERE identifier_type = 'doi')) AS articles_with_doi
FROM article_sources JOIN articles USING (article_id) JOIN data_sources USING (source_id) GROUP BY source_name""")
def a6(spark, d):
    c = catalog(spark, d)
    return analytics.source_coverage(c["articles"], c["article_sources"], c["data_sources"], c["article_identifiers"])


@query("a7_refresh_article_counts", WITH + """
SELECT article_id, coalesce(c, 0) AS citation_count, coalesce(r, 0) AS reference_count FROM articles
LEFT JOIN (SELECT cited_article_id AS article_id, count(*) AS c FROM citations GROUP BY 1) USING (article_id)
LEFT JOIN (SELECT citing_article_id AS article_id, count(*) AS r FROM citations GROUP BY 1) USING (article_id)""")
def a7(spark, d):
    c = catalog(spark, d)
    return cat.refresh_article_counts(c["articles"], c["citations"]).select("article_id", "citation_count", "reference_count")


@query("a8_refresh_author_stats", WITH + """
SELECT author_id, full_name, country, count(article_id) AS paper_count, coalesce(sum(citation_count), 0)::BIGINT AS citation_count
FROM authors LEFT JOIN (article_authors JOIN articles USING (article_id)) USING (author_id) GROUP BY 1, 2, 3""")
def a8(spark, d):
    c = catalog(spark, d)
    return cat.refresh_author_stats(c["authors"], c["article_authors"], c["articles"])


@query("a9_year_distribution", WITH + "SELECT publication_year, count(*) AS articles FROM articles GROUP BY 1")
def a9(spark, d):
    return analytics.year_distribution(catalog(spark, d)["articles"])


@query("a10_venue_ranking", WITH + """
SELECT venue_name, count(*) AS articles, sum(citation_count)::BIGINT AS citations, (rank() OVER (ORDER BY count(*) DESC, sum(citation_count) DESC))::INTEGER AS rank
FROM article_publications JOIN articles USING (article_id) JOIN venues USING (venue_id) GROUP BY 1""")
def a10(spark, d):
    c = catalog(spark, d)
    return analytics.venue_ranking(c["articles"], c["article_publications"], c["venues"])


@query("a10_author_ranking", WITH + """
SELECT full_name, count(*) AS articles, sum(citation_count)::BIGINT AS citations, (rank() OVER (ORDER BY count(*) DESC, sum(citation_count) DESC))::INTEGER AS rank
FROM article_authors JOIN articles USING (article_id) JOIN authors USING (author_id) GROUP BY author_id, full_name QUALIFY (rank() OVER (ORDER BY count(*) DESC, sum(citation_count) DESC)) <= 50""")
def a10b(spark, d):
    c = catalog(spark, d)
    return analytics.author_ranking(c["articles"], c["article_authors"], c["authors"])


@query("v8_quality_report", WITH + """
SELECT 'articles without identifiers' AS issue, count(*) AS n FROM articles WHERE article_id NOT IN (SELECT article_id FROM article_identifiers)
UNION ALL SELECT 'articles without authors', count(*) FROM articles WHERE article_id NOT IN (SELECT article_id FROM article_authors)
UNION ALL SELECT 'bad DOIs', count(*) FROM article_identifiers WHERE identifier_type = 'doi' AND NOT regexp_matches(identifier_value, '^10\\.\\d{4,}/[^\\s]+$')""")
def v8(spark, d):
    c = catalog(spark, d)
    return analytics.quality_report(c["articles"], c["article_authors"], c["article_identifiers"])


@query("v9_orphans", WITH + "SELECT article_id, author_id FROM article_authors WHERE article_id % 11 = 0")
def v9(spark, d):
    c = catalog(spark, d)
    return cat.drop_orphans(c["article_authors"], c["articles"].where("article_id % 11 <> 0"), listed=True).select("article_id", "author_id")


@query("v10_unique_violations", WITH + "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v10(spark, d):
    from biblio_spark.storage import read_table

    return cat.unique_violations(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("l1_l4_load_catalog", LOAD + """
SELECT 'articles' AS name, count(*) AS n FROM loaded UNION ALL SELECT 'rejects', count(*) FROM lit WHERE trim(title) = ''
UNION ALL SELECT 'article_identifiers', count(*) FROM (SELECT DISTINCT kind, value FROM ids JOIN loaded USING (ord))
UNION ALL SELECT 'authors', count(*) FROM (SELECT DISTINCT unnest(authors) FROM loaded) UNION ALL SELECT 'article_authors', sum(len(authors))::BIGINT FROM loaded
UNION ALL SELECT 'venues', count(DISTINCT venue_name) FROM loaded UNION ALL SELECT 'subject_categories', count(DISTINCT language) FROM loaded
UNION ALL SELECT 'article_categories', count(*) FROM loaded UNION ALL SELECT 'publication_types', count(DISTINCT type_name) FROM loaded
UNION ALL SELECT 'article_publication_types', count(*) FROM loaded UNION ALL SELECT 'article_sources', count(*) FROM (SELECT DISTINCT art, source FROM good)""")
def l1(spark, d):
    tables = cat.load_catalog(lit(spark, d), CURRENT_YEAR)
    wanted = (
        "articles", "rejects", "article_identifiers", "authors", "article_authors", "venues", "subject_categories", "article_categories",
        "publication_types", "article_publication_types", "article_sources",
    )
    out = None
    for name in wanted:
        row = tables[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


_CHECK = "sum(('0x' || substr(md5({}), 1, 8))::BIGINT)::BIGINT"


_STORED = f"""UNION ALL SELECT 'article_identifiers', {_CHECK.format("kind || value")} FROM (SELECT DISTINCT kind, value FROM ids JOIN loaded USING (ord))
UNION ALL SELECT 'authors', {_CHECK.format("a")} FROM (SELECT DISTINCT unnest(authors) AS a FROM loaded)
UNION ALL SELECT 'article_authors', {_CHECK.format("a || n")} FROM (SELECT unnest(authors) AS a, generate_subscripts(authors, 1) AS n FROM loaded)
UNION ALL SELECT 'venues', {_CHECK.format("venue_name")} FROM (SELECT DISTINCT venue_name FROM loaded WHERE venue_name IS NOT NULL)
UNION ALL SELECT 'article_categories', {_CHECK.format("language || (ord % 5 = 0)::VARCHAR")} FROM loaded
UNION ALL SELECT 'publication_types', {_CHECK.format("type_name")} FROM (SELECT DISTINCT type_name FROM loaded)
UNION ALL SELECT 'article_sources', {_CHECK.format("source || title")} FROM (SELECT DISTINCT good.art, good.source, loaded.title FROM good JOIN loaded ON loaded.art = good.art)"""


@query("l1_catalog_contents", LOAD + f"""
SELECT 'articles' AS name, {_CHECK.format("title || publication_year")} AS digest FROM loaded UNION ALL SELECT 'rejects', {_CHECK.format("record_id")} FROM lit WHERE trim(title) = ''
{_STORED}""")
def l1_contents(spark, d):
    """What the tables hold, as sums of digests of their natural values."""
    return _contents(cat.load_catalog(lit(spark, d), CURRENT_YEAR))


def _contents(t):
    text = lambda *parts: F.concat(*(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))
    rows = {
        "articles": t["articles"].select(text("title", "publication_year").alias("v")),
        **({"rejects": t["rejects"].select(F.col("record_id").alias("v"))} if "rejects" in t else {}),
        "article_identifiers": t["article_identifiers"].select(text("identifier_type", "identifier_value").alias("v")),
        "authors": t["authors"].select(F.col("full_name").alias("v")),
        "article_authors": t["article_authors"].join(t["authors"], "author_id").select(text("full_name", "author_order").alias("v")),
        "venues": t["venues"].select(F.col("venue_name").alias("v")),
        "article_categories": t["article_categories"].join(t["subject_categories"], "category_id").select(text("category_name", "is_major_topic").alias("v")),
        "publication_types": t["publication_types"].select(F.col("type_name").alias("v")),
        "article_sources": t["article_sources"].join(t["data_sources"], "source_id").join(t["articles"], "article_id").select(text("source_name", "title").alias("v")),
    }
    digest = F.sum(F.conv(F.substring(F.md5("v"), 1, 8), 16, 10).cast("long"))
    parts = [df.agg(F.lit(name).alias("name"), digest.alias("digest")) for name, df in rows.items()]
    return reduce(DataFrame.unionByName, parts)


@query("l2_resolve_authors", WITH + """
, n AS (SELECT author_id AS row_id, CASE WHEN author_id % 3 = 0 THEN 'Someone ' || author_id ELSE full_name END AS full_name FROM authors)
SELECT row_id, CASE WHEN row_id % 8 = 0 THEN row_id::VARCHAR ELSE (SELECT min(author_id::VARCHAR) FROM authors a WHERE a.full_name = n.full_name) END AS known,
  row_id % 3 = 0 AND row_id % 8 <> 0 AS is_new FROM n""")
def l2(spark, d):
    """By a known ORCID (whatever the name), by name where the ORCID is unknown or missing, else new."""
    authors = catalog(spark, d)["authors"]
    i, name = F.col("author_id"), F.col("author_id").cast("string")
    orcid = F.when(i % 8 == 0, F.concat(F.lit("0000-"), name))
    new = authors.select(
        i.alias("row_id"), F.when(i % 3 == 0, F.concat(F.lit("Someone "), name)).otherwise(F.col("full_name")).alias("full_name"),
        orcid.when(i % 8 == 4, F.concat(F.lit("9999-"), name)).alias("orcid"),
    )
    found = cat.resolve_authors(new, authors.select(name.alias("author_id"), "full_name", orcid.alias("orcid")))
    return found.select("row_id", F.when(~F.col("is_new"), F.col("author_id")).alias("known"), "is_new")


@query("l3_get_or_create", WITH + "SELECT venue_name, venue_name NOT LIKE 'New %' AS existed FROM (SELECT venue_name FROM venues UNION SELECT 'New ' || s_nationkey FROM supplier)")
def l3(spark, d):
    from biblio_spark.storage import read_table

    c = catalog(spark, d)
    names = read_table(spark, d, "supplier").select(F.concat(F.lit(" New "), F.col("s_nationkey").cast("string")).alias("venue_name"))
    names = names.unionByName(c["venues"].select("venue_name"))
    out = cat.get_or_create(c["venues"], names, "venue_name", "venue_id", "venue")
    return out.select("venue_name", (F.length("venue_id") != 64).alias("existed"))


@query("l5_write_catalog", "WITH" + LIT + "SELECT publication_year, count(*) AS n FROM lit WHERE trim(title) <> '' AND ord IN (SELECT min(ord) FROM lit WHERE trim(title) <> '' GROUP BY coalesce(regexp_replace(lower(doi), '^(doi:|https?://doi\\.org/|https?://dx\\.doi\\.org/)', ''), record_id)) GROUP BY 1")
def l5(spark, d):
    from biblio_spark.storage import new_path

    path = new_path(spark, "catalogue")
    cat.write_catalog({"articles": cat.load_catalog(lit(spark, d), CURRENT_YEAR)["articles"]}, path)
    return spark.read.parquet(f"{path}/articles").groupBy("publication_year").agg(F.count("*").alias("n"))


@query("l5_stored_catalog", LOAD + f"""
SELECT 'articles' AS name, {_CHECK.format("title || publication_year")} AS digest FROM loaded
{_STORED}""")
def l5_stored(spark, d):
    """The whole catalogue written, read again and compared by contents."""
    from biblio_spark.storage import new_path

    path = new_path(spark, "catalogue")
    tables = {k: v for k, v in cat.load_catalog(lit(spark, d), CURRENT_YEAR).items() if k != "rejects"}
    cat.write_catalog(tables, path)
    return _contents(cat.read_catalog(spark, path, list(tables)))


@query("l6_two_batches", LOAD.replace("loaded AS (SELECT * FROM good WHERE ord IN (SELECT min(ord) FROM good GROUP BY art))", "loaded AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY art ORDER BY ord % 2, ord) = 1)") + f"""
SELECT 'articles' AS name, {_CHECK.format("title || publication_year")} AS digest FROM loaded
{_STORED}""")
def l6(spark, d):
    """Even records loaded into an empty catalogue, odd ones into what is there then."""
    from biblio_spark.storage import new_path

    path = new_path(spark, "catalogue")
    records = lit(spark, d)
    for rest in (0, 1):
        cat.add_to_catalog(spark, path, records.where(F.col("ord") % 2 == rest), CURRENT_YEAR)
    return _contents(cat.read_catalog(spark, path, list(cat.TABLE_KEYS)))


@query("l6_stored_updates", LOAD + """
SELECT publication_year, count(*) AS n, sum(('0x' || substr(md5(title), 1, 8))::BIGINT)::BIGINT AS digest FROM (
  SELECT CASE WHEN publication_year % 5 = 1 THEN 'New ' || title ELSE title END AS title, CASE WHEN publication_year % 5 = 1 THEN publication_year + 1 ELSE publication_year END AS publication_year FROM loaded)
GROUP BY 1""")
def l6_updates(spark, d):
    """Titles and years of the articles of each fifth year changed in a stored catalogue."""
    from biblio_spark.storage import materialize, new_path

    path = new_path(spark, "catalogue")
    articles = cat.load_catalog(lit(spark, d), CURRENT_YEAR)["articles"]
    cat.write_catalog({"articles": articles}, path)
    changed = spark.read.parquet(f"{path}/articles").where("publication_year % 5 = 1").select("article_id", F.concat(F.lit("New "), "title").alias("title"), (F.col("publication_year") + 1).alias("publication_year"))
    cat.write_updates(spark, path, materialize(changed, "updates"))
    out = spark.read.parquet(f"{path}/articles")
    return out.groupBy("publication_year").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5("title"), 1, 8), 16, 10).cast("long")).alias("digest"))


@query("w1_rank_pdf_urls", """
WITH l AS (
  SELECT l_partkey AS doi, l_linenumber AS pos, l_orderkey AS o, (l_orderkey + l_linenumber) % 4 AS kind, CASE l_suppkey % 3 WHEN 0 THEN '/PMC.pdf' ELSE '/a.pdf' END AS f, l_suppkey % 3 AS s FROM lineitem),
u AS (
  SELECT doi, 'https://x/' || o || '/' || pos || f AS url, CASE WHEN s = 0 THEN 0 ELSE 1 END AS class, CASE WHEN s = 0 THEN -pos ELSE pos END AS place FROM l WHERE kind < 2
  UNION ALL SELECT doi, 'https://pub/' || o || '/' || pos || CASE kind WHEN 2 THEN '.pdf' ELSE '' END, kind, pos FROM l WHERE kind >= 2)
SELECT doi::VARCHAR AS doi, url, row_number() OVER (PARTITION BY doi ORDER BY class, place, url)::INTEGER AS rank FROM u""", also="w1_rank_pdf_urls_whole")
def w1(spark, d):
    """Every lineitem row: two of four as locations, one as PDF link and one as landing page."""
    from biblio_spark.storage import read_table

    o, pos = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    rows = read_table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("doi"), F.col("l_linenumber").alias("pos"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 4).alias("kind"),
        F.concat_ws("/", F.lit("https:/"), F.lit("x"), o, pos, F.when(F.col("l_suppkey") % 3 == 0, "PMC.pdf").otherwise("a.pdf")).alias("place"),
        F.concat_ws("/", F.lit("https:/"), F.lit("pub"), o, pos).alias("page"),
    )
    locations = rows.where("kind < 2").select("doi", "pos", F.col("place").alias("url_for_pdf"), F.lit("").alias("url_for_landing_page"))
    pdf = F.col("kind") == 2
    publisher = rows.where("kind >= 2").select("doi", "pos", F.when(pdf, "application/pdf").alias("content_type"), F.when(pdf, F.concat("page", F.lit(".pdf"))).otherwise(F.col("page")).alias("url"))
    return search.rank_pdf_urls(locations, publisher)
