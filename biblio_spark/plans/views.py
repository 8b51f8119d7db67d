"""Records and a catalogue derived from the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblio_spark.schema import ARTICLE, AUTHOR, CATEGORY, IDENTIFIER, PUBLICATION, PUBLICATION_TYPE, RECORD, SOURCE, VENUE, struct_of
from biblio_spark.storage import read_table

CURRENT_YEAR = 2024
_SOURCES = ("pubmed", "arxiv", "biorxiv", "semantic_scholar", "wos")


def lit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified records, one for each row of ``documents``. The title is the whole first sentence."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = d.withColumn("title", F.substring_index("text", ". ", 1)).withColumn("hash", F.md5("title"))
    i = F.col("doc_id")
    source = F.element_at(F.array(*(F.lit(s) for s in _SOURCES)), (i % 5 + 1).cast("int"))
    year = (1990 + i % 35).cast("int")
    month, day = F.lpad((1 + i % 12).cast("string"), 2, "0"), F.lpad((1 + i % 28).cast("string"), 2, "0")
    date = F.when(i % 3 == 0, year.cast("string")).when(i % 3 == 1, F.concat_ws("-", year, month)).otherwise(F.concat_ws("-", year, month, day))
    code = F.concat(F.lit("10.1000/"), F.md5("text"))
    doi = F.when(i % 7 != 0, F.when(i % 3 == 0, code).when(i % 3 == 1, F.concat(F.lit("doi:"), F.upper(code))).otherwise(F.concat(F.lit("https://doi.org/"), code)))
    pmid = F.when(i % 10 < 2, F.concat(F.lit("PMID"), F.floor(i / 10).cast("string")))
    arxiv = F.when((i % 20).isin(1, 2), F.concat(F.lit("2301."), F.lpad(F.floor(i / 20).cast("string"), 5, "0"), F.lit("v"), (1 + i % 3).cast("string")))
    author = lambda at, n: struct_of(AUTHOR, full_name=F.concat(F.lit("Author "), F.substring("hash", at, 2)), is_corresponding=F.lit(n == 1), author_order=F.lit(n))
    ids = F.array(
        *(struct_of(IDENTIFIER, identifier_type=F.lit(k), identifier_value=v, is_primary=F.lit(k == "doi")) for k, v in (("doi", doi), ("pmid", pmid), ("arxiv_id", arxiv)))
    )
    kind = F.when(i % 4 == 0, "Review").when(i % 2 == 1, "article").otherwise("Article")
    columns = {
        "ord": i,
        "record_id": i.cast("string"),
        "article": struct_of(
            ARTICLE, primary_doi=doi, title=F.col("title"), abstract=F.col("text"), language=F.col("lang"), publication_year=year, publication_date=date,
            citation_count=F.when(i % 11 != 0, (i * 37) % 500).cast("int"), reference_count=(i % 60).cast("int"), is_open_access=i % 2 == 0,
            open_access_url=F.when(i % 2 == 0, F.concat(F.lit("https://oa.example/"), i.cast("string"))),
        ),
        "authors": F.when(i % 17 != 0, F.array(author(1, 1), author(3, 2))).otherwise(F.array()),
        "venue": struct_of(VENUE, venue_name=F.when(i % 13 != 0, F.concat(F.lit("Venue "), (i % 40).cast("string"))), venue_type=F.lit("journal")),
        "publication": struct_of(PUBLICATION, volume=(i % 30).cast("string")),
        "identifiers": F.filter(ids, lambda x: x["identifier_value"].isNotNull()),
        "categories": F.array(struct_of(CATEGORY, category_name=F.col("lang"), category_type=F.lit("field_of_study"), is_major_topic=i % 5 == 0)),
        "publication_types": F.array(struct_of(PUBLICATION_TYPE, type_name=kind, source_type=F.lit("general"))),
        "source_specific": struct_of(SOURCE, source=source),
    }
    return d.select(*(columns[n].cast(k).alias(n) for n, k in RECORD.items()))


#: CTEs ``lit`` (flat), ``ids`` (ord, pos, kind, value, norm) and ``keys`` (ord, key, place).
LIT = """
lit AS (
  SELECT doc_id AS ord, doc_id::VARCHAR AS record_id, doc_id AS i,
    ['pubmed', 'arxiv', 'biorxiv', 'semantic_scholar', 'wos'][doc_id % 5 + 1] AS source,
    split_part(text, '. ', 1) AS title, text AS abstract, lang AS language,
    (1990 + doc_id % 35)::INTEGER AS publication_year,
    CASE doc_id % 3 WHEN 0 THEN (1990 + doc_id % 35)::VARCHAR
      WHEN 1 THEN (1990 + doc_id % 35)::VARCHAR || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0')
      ELSE (1990 + doc_id % 35)::VARCHAR || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') END AS publication_date,
    CASE WHEN doc_id % 11 <> 0 THEN ((doc_id * 37) % 500)::INTEGER END AS citation_count,
    (doc_id % 60)::INTEGER AS reference_count, doc_id % 2 = 0 AS is_open_access,
    CASE WHEN doc_id % 2 = 0 THEN 'https://oa.example/' || doc_id END AS open_access_url,
    CASE WHEN doc_id % 17 = 0 THEN []::VARCHAR[] ELSE
      ['Author ' || substr(md5(split_part(text, '. ', 1)), 1, 2), 'Author ' || substr(md5(split_part(text, '. ', 1)), 3, 2)] END AS authors,
    CASE WHEN doc_id % 13 <> 0 THEN 'Venue ' || doc_id % 40 END AS venue_name,
    CASE WHEN doc_id % 4 = 0 THEN 'Review' WHEN doc_id % 2 = 1 THEN 'article' ELSE 'Article' END AS type_name,
    CASE WHEN doc_id % 7 <> 0 THEN CASE doc_id % 3 WHEN 0 THEN '10.1000/' || md5(text)
      WHEN 1 THEN 'doi:' || upper('10.1000/' || md5(text)) ELSE 'https://doi.org/10.1000/' || md5(text) END END AS doi,
    CASE WHEN doc_id % 10 < 2 THEN 'PMID' || doc_id // 10 END AS pmid,
    CASE WHEN doc_id % 20 IN (1, 2) THEN '2301.' || lpad((doc_id // 20)::VARCHAR, 5, '0') || 'v' || 1 + doc_id % 3 END AS arxiv_id
  FROM documents
),
ids AS (
  SELECT ord, pos, kind, value,
    CASE kind WHEN 'doi' THEN regexp_replace(lower(value), '^(doi:|https?://doi\\.org/|https?://dx\\.doi\\.org/)', '')
      WHEN 'pmid' THEN regexp_replace(lower(value), '[^0-9]', '', 'g')
      ELSE regexp_replace(regexp_replace(lower(value), '^arxiv:', ''), 'v[0-9]+$', '') END AS norm
  FROM (SELECT ord, 0 AS pos, 'doi' AS kind, doi AS value FROM lit UNION ALL SELECT ord, 1, 'pmid', pmid FROM lit
        UNION ALL SELECT ord, 2, 'arxiv_id', arxiv_id FROM lit) WHERE value IS NOT NULL
),
keys AS (SELECT ord, kind || ':' || norm AS key, pos AS place FROM ids)
"""

#: CTE ``first_seen`` (ord, kept, owner_id) after LIT, by going through the records in order. Needs WITH RECURSIVE.
FIRST_SEEN = """
seq AS (SELECT lit.ord, row_number() OVER (ORDER BY lit.ord) AS n, coalesce(k.ks, []::VARCHAR[]) AS ks
        FROM lit LEFT JOIN (SELECT ord, list(key) AS ks FROM keys GROUP BY ord) k ON k.ord = lit.ord),
walk AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS ord, []::VARCHAR[] AS seen, true AS kept
  UNION ALL
  SELECT s.n, s.ord, CASE WHEN list_has_any(w.seen, s.ks) THEN w.seen ELSE list_concat(w.seen, s.ks) END, NOT list_has_any(w.seen, s.ks)
  FROM walk w JOIN seq s ON s.n = w.n + 1
),
first_seen AS (
  SELECT w.ord, w.kept, coalesce(o.owner, w.ord) AS owner_id
  FROM walk w LEFT JOIN (
    SELECT d.ord, arg_min(o.ord, d.place * 1000000000 + o.ord) AS owner
    FROM keys d JOIN walk wd ON wd.ord = d.ord AND NOT wd.kept
    JOIN keys o ON o.key = d.key AND o.ord < d.ord JOIN walk wo ON wo.ord = o.ord AND wo.kept
    GROUP BY d.ord) o ON o.ord = w.ord
  WHERE w.ord IS NOT NULL
)
"""

#: CTE ``grouped``: lit with owner_id, and the completeness score.
GROUPED = """
grouped AS (
  SELECT lit.*, f.owner_id, f.kept,
    10 * (title <> '')::INT + 8 * (abstract <> '')::INT + 5 + least(2 * len(authors), 10)
    + least(3 * (SELECT count(*) FROM ids WHERE ids.ord = lit.ord), 15) + 3 * (coalesce(citation_count, 0) <> 0)::INT + 2 * (reference_count <> 0)::INT AS score
  FROM lit JOIN first_seen f ON f.ord = lit.ord
)
"""


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A catalogue from the star tables: orders as articles, suppliers as authors, and so on."""
    t = lambda name: read_table(spark, sf_dir, name)
    orders, items = t("orders"), t("lineitem")
    c = F.col
    pairs = items.select(c("l_orderkey").alias("article_id"), c("l_suppkey").alias("author_id")).distinct()
    ids = orders.select(c("o_orderkey").alias("article_id"))
    doi = F.concat(F.when(c("article_id") % 50 == 1, "x10.1000/").otherwise("10.1000/"), c("article_id").cast("string"))
    suppliers = t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey"))
    return {
        "articles": orders.select(
            c("o_orderkey").alias("article_id"), F.concat_ws(" ", "o_orderpriority", c("o_orderkey").cast("string")).alias("title"),
            F.year("o_orderdate").alias("publication_year"), F.floor(c("o_totalprice") / 1000).cast("long").alias("citation_count"),
        ),
        "authors": suppliers.select(c("s_suppkey").alias("author_id"), c("s_name").alias("full_name"), c("n_name").alias("country")),
        "article_authors": pairs.withColumn("author_order", F.row_number().over(_by("article_id", "author_id"))),
        "venues": t("customer").select(c("c_mktsegment").alias("venue_id"), c("c_mktsegment").alias("venue_name")).distinct(),
        "article_publications": orders.join(t("customer"), c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("article_id"), c("c_mktsegment").alias("venue_id")),
        "subject_categories": t("part").select(c("p_type").alias("category_id"), c("p_type").alias("category_name")).distinct(),
        "article_categories": items.join(t("part"), c("l_partkey") == c("p_partkey")).select(c("l_orderkey").alias("article_id"), c("p_type").alias("category_id")).distinct(),
        "data_sources": t("region").select(c("r_regionkey").alias("source_id"), c("r_name").alias("source_name")),
        "article_sources": pairs.join(suppliers, c("author_id") == c("s_suppkey")).select("article_id", c("n_regionkey").alias("source_id")).distinct(),
        "article_identifiers": ids.where("article_id % 3 <> 0").select("article_id", F.lit("doi").alias("identifier_type"), doi.alias("identifier_value")).unionByName(
            ids.where("article_id % 2 = 0").select("article_id", F.lit("pmid").alias("identifier_type"), c("article_id").cast("string").alias("identifier_value"))
        ),
        "citations": items.select(c("l_orderkey").alias("citing_article_id"), F.when(c("l_linenumber") != 7, c("l_partkey")).alias("cited_article_id")),
    }


def _by(key: str, order: str):
    from pyspark.sql import Window as W

    return W.partitionBy(key).orderBy(order)


CATALOG = """
articles AS (SELECT o_orderkey AS article_id, o_orderpriority || ' ' || o_orderkey AS title, year(o_orderdate)::INTEGER AS publication_year,
             floor(o_totalprice / 1000)::BIGINT AS citation_count FROM orders),
authors AS (SELECT s_suppkey AS author_id, s_name AS full_name, n_name AS country, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
article_authors AS (SELECT article_id, author_id, row_number() OVER (PARTITION BY article_id ORDER BY author_id)::INTEGER AS author_order
                    FROM (SELECT DISTINCT l_orderkey AS article_id, l_suppkey AS author_id FROM lineitem)),
venues AS (SELECT DISTINCT c_mktsegment AS venue_id, c_mktsegment AS venue_name FROM customer),
article_publications AS (SELECT o_orderkey AS article_id, c_mktsegment AS venue_id FROM orders JOIN customer ON o_custkey = c_custkey),
subject_categories AS (SELECT DISTINCT p_type AS category_id, p_type AS category_name FROM part),
article_categories AS (SELECT DISTINCT l_orderkey AS article_id, p_type AS category_id FROM lineitem JOIN part ON l_partkey = p_partkey),
data_sources AS (SELECT r_regionkey AS source_id, r_name AS source_name FROM region),
article_sources AS (SELECT DISTINCT article_id, n_regionkey AS source_id FROM article_authors JOIN authors USING (author_id)),
article_identifiers AS (
  SELECT o_orderkey AS article_id, 'doi' AS identifier_type, CASE WHEN o_orderkey % 50 = 1 THEN 'x' ELSE '' END || '10.1000/' || o_orderkey AS identifier_value
  FROM orders WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 'pmid', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 2 = 0),
citations AS (SELECT l_orderkey AS citing_article_id, CASE WHEN l_linenumber <> 7 THEN l_partkey END AS cited_article_id FROM lineitem)
"""


def id_list(records: DataFrame) -> DataFrame:
    """Every record as (row_id, doi, arxiv_id, pmid, url), and one unknown id for each."""
    from biblio_spark.functions.identifiers import get_identifier

    known = records.select(
        F.col("ord").alias("row_id"), *(get_identifier("identifiers", k).alias(k) for k in ("doi", "arxiv_id", "pmid")), F.col("article.open_access_url").alias("url")
    )
    none = F.lit(None).cast("string")
    unknown = known.select((-F.col("row_id") - 1).alias("row_id"), F.concat(F.lit("10.9999/"), F.col("row_id").cast("string")).alias("doi"), none.alias("arxiv_id"), none.alias("pmid"), none.alias("url"))
    return known.unionByName(unknown)


ID_LIST = """
id_list AS (
  SELECT ord AS row_id, doi, arxiv_id, pmid, open_access_url AS url FROM lit
  UNION ALL SELECT -ord - 1, '10.9999/' || ord, NULL, NULL, NULL FROM lit
)
"""
