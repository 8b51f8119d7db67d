"""The normalised catalogue: load, upkeep, and the nested record out of it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblio_spark.functions.identifiers import normalize_identifier
from biblio_spark.functions.text import blank_to_null, filled, nonblank, strip
from biblio_spark.operators.validate import passes_load_gate
from biblio_spark.schema import AUTHOR, CATEGORY, IDENTIFIER, PUBLICATION, PUBLICATION_TYPE, VENUE, struct_of, with_ord
from biblio_spark.storage import is_written, materialize


def key_of(kind: str, *parts: Column | str) -> Column:
    """A deterministic key: the same natural key has the same key on every run. Null if any part is."""
    return F.sha2(F.concat(F.lit(kind), *(F.concat(F.lit("\x1f"), F.col(p) if isinstance(p, str) else p) for p in parts)), 256)


def article_key() -> Column:
    """Of the primary DOI in normal form, else of the record id."""
    doi = normalize_identifier(F.lit("doi"), "article.primary_doi")
    return F.when(filled(doi), key_of("article", doi)).otherwise(key_of("record", "record_id"))


#: The data sources.
SOURCES = ("pubmed", "arxiv", "biorxiv", "semantic_scholar", "wos")


def load_catalog(lit: DataFrame, current_year: int) -> dict[str, DataFrame]:
    """All tables of the catalogue from unified records; ``rejects`` has the records that do not pass the gate. Records need an
    ``ord`` (``landed.numbered`` gives it); one without it ends the job.

    The records with their keys are written once, and all tables read them; records of ``materialize`` are written already. The first record of an article key is loaded. Dimensions come from natural keys by aggregation, children by one
    ``posexplode`` each; identifiers are unique by type and value, children by article and order.
    """
    passes = passes_load_gate(current_year)
    marked = with_ord(lit).withColumn("article_id", F.when(passes, article_key()))
    marked = marked if is_written(lit) else materialize(marked, "keyed")
    keyed = marked.where("article_id IS NOT NULL")
    # the few that are not first are left out, found on keys alone: no table shuffles the records to find those that are
    keys = keyed.select("article_id", "ord")
    later = keys.join(keys.groupBy("article_id").agg(F.min("ord").alias("least")), "article_id").where("ord <> least")
    later = materialize(later.select("ord", F.xxhash64("article_id").alias("_key")), "later")
    rows = keyed.withColumn("_key", F.xxhash64("article_id")).join(later, ["ord", "_key"], "left_anti").drop("_key")
    out = {"rejects": marked.where("article_id IS NULL").drop("article_id")}
    out["articles"] = rows.select("article_id", "article.*")
    out["data_sources"] = lit.sparkSession.createDataFrame([(s,) for s in SOURCES], "source_name string").select(key_of("source", "source_name").alias("source_id"), "source_name")
    out["article_sources"] = (
        keyed.where(filled("source_specific.source"))
        .groupBy("article_id", F.col("source_specific.source").alias("source_name"))
        .agg(F.min(F.struct("ord", "source_specific.raw"))["raw"].alias("raw_data"))
        .select("article_id", key_of("source", "source_name").alias("source_id"), "raw_data")
    )
    ids = rows.select("article_id", "ord", F.posexplode("identifiers").alias("pos", "i")).select("article_id", "ord", "pos", "i.*")
    ids = ids.withColumn("identifier_value", strip("identifier_value"))
    best = ids.groupBy("identifier_type", "identifier_value").agg(F.min(F.struct("ord", "pos", "article_id", "is_primary")).alias("b"))
    out["article_identifiers"] = best.select("b.article_id", "identifier_type", "identifier_value", F.coalesce("b.is_primary", F.lit(False)).alias("is_primary"))
    people = rows.select("article_id", "ord", F.posexplode("authors").alias("pos", "a")).select("article_id", "ord", "pos", "a.*")
    people = people.withColumn("author_id", F.coalesce(F.when(filled("orcid"), key_of("orcid", "orcid")), key_of("author", strip("full_name"))))
    known = F.min(F.struct("ord", "pos", "full_name", "last_name", "fore_name", "initials", "orcid", "semantic_scholar_id"))
    out["authors"] = people.groupBy("author_id").agg(known.alias("b")).select("author_id", *(f"b.{c}" for c in ("full_name", "last_name", "fore_name", "initials", "orcid", "semantic_scholar_id")))
    out["affiliations"] = people.select(blank_to_null("affiliation").alias("name")).where("name IS NOT NULL").distinct().select(key_of("affiliation", "name").alias("affiliation_id"), "name")
    out["article_authors"] = people.select(
        "article_id", "author_id", (F.col("pos") + 1).alias("author_order"), F.coalesce("is_corresponding", F.lit(False)).alias("is_corresponding"),
        key_of("affiliation", blank_to_null("affiliation")).alias("affiliation_id"),
    )
    venues = rows.where(nonblank("venue.venue_name"))
    venue_columns = [n for n in _names(VENUE) if n != "venue_name"]
    out["venues"] = (
        venues.groupBy(strip("venue.venue_name").alias("venue_name"))
        .agg(F.min(F.struct("ord", *(F.col(f"venue.{c}") for c in venue_columns))).alias("b"))
        .select(key_of("venue", "venue_name").alias("venue_id"), "venue_name", *(f"b.{c}" for c in venue_columns))
    )
    out["article_publications"] = rows.where(F.col("publication").isNotNull() | nonblank("venue.venue_name")).select(
        "article_id", key_of("venue", blank_to_null("venue.venue_name")).alias("venue_id"), "publication.*"
    )
    kinds = rows.select("article_id", "ord", F.posexplode("categories").alias("pos", "c")).select("article_id", "ord", "pos", "c.*").where(nonblank("category_name"))
    kinds = kinds.withColumn("category_name", strip("category_name"))
    out["subject_categories"] = (
        kinds.groupBy("category_name")
        .agg(F.min(F.struct("ord", "pos", "category_code", "category_type")).alias("b"))
        .select(key_of("category", "category_name").alias("category_id"), "category_name", "b.category_code", "b.category_type")
    )
    out["article_categories"] = (
        kinds.groupBy("article_id", "category_name")
        .agg(F.bool_or(F.coalesce("is_major_topic", F.lit(False))).alias("is_major_topic"), F.max("confidence_score").cast("decimal(3,2)").alias("confidence_score"))
        .select("article_id", key_of("category", "category_name").alias("category_id"), "is_major_topic", "confidence_score")
    )
    types = rows.select("article_id", "ord", F.posexplode("publication_types").alias("pos", "t")).select("article_id", "ord", "pos", "t.*").where(nonblank("type_name"))
    types = types.withColumn("type_name", strip("type_name"))
    out["publication_types"] = (
        types.groupBy("type_name")
        .agg(F.min(F.struct("ord", "pos", "type_code", "source_type")).alias("b"))
        .select(key_of("type", "type_name").alias("publication_type_id"), "type_name", "b.type_code", "b.source_type")
    )
    out["article_publication_types"] = types.select("article_id", key_of("type", "type_name").alias("publication_type_id")).distinct()
    return out


def load_pubmed_details(parsed: DataFrame, articles: DataFrame, identifiers: DataFrame) -> dict[str, DataFrame]:
    """What only parsed PubMed records have: mesh_qualifiers, article_mesh_qualifiers, funding_agencies, article_funding, citations
    (the cited article is null where it is not in the catalogue), abstract_sections. Articles are found by PMID."""
    pmids = identifiers.where("identifier_type = 'pmid'").select("article_id", F.col("identifier_value").alias("pmid"))
    # on keys alone, so that the parsed records are joined once
    rows = parsed.join(materialize(pmids.join(articles.select("article_id"), "article_id"), "pmids"), "pmid")
    out = {}
    mesh = rows.select("article_id", F.explode("mesh_headings").alias("m")).select("article_id", F.col("m.descriptor_name").alias("category_name"), F.explode("m.qualifiers").alias("q"))
    mesh = mesh.select("article_id", key_of("category", strip("category_name")).alias("category_id"), "q.*")
    key = key_of("qualifier", F.coalesce(blank_to_null("qualifier_ui"), F.col("qualifier_name")))
    mesh = mesh.withColumn("mesh_qualifier_id", key)
    out["mesh_qualifiers"] = mesh.groupBy("mesh_qualifier_id").agg(F.min("qualifier_name").alias("qualifier_name"), F.min("qualifier_ui").alias("qualifier_ui"))
    out["article_mesh_qualifiers"] = mesh.groupBy("article_id", "category_id", "mesh_qualifier_id").agg(F.bool_or(F.col("major_topic_yn") == "Y").alias("is_major_topic"))
    grants = rows.select("article_id", F.explode("grants").alias("g")).select("article_id", "g.*")
    agency = key_of("agency", blank_to_null("agency"))
    out["funding_agencies"] = grants.where(nonblank("agency")).groupBy(strip("agency").alias("agency_name")).agg(F.min("country").alias("country")).withColumn("agency_id", key_of("agency", "agency_name"))
    out["article_funding"] = grants.select("article_id", agency.alias("agency_id"), "grant_id", F.col("acronym").alias("award_id")).distinct()
    refs = rows.select("article_id", F.posexplode("references").alias("pos", "r")).select("article_id", "pos", "r.*")
    targets = pmids.select(F.col("article_id").alias("cited_article_id"), F.col("pmid").alias("pubmed"))
    out["citations"] = refs.join(targets, "pubmed", "left").select(
        F.col("article_id").alias("citing_article_id"), "cited_article_id", F.col("citation").alias("cited_text"), F.lit(False).alias("is_influential"), "pos"
    )
    out["abstract_sections"] = rows.select("article_id", F.posexplode("abstract.structured").alias("pos", "s")).select(
        "article_id", (F.col("pos") + 1).alias("section_order"), F.col("s.label").alias("label"), F.col("s.text").alias("content")
    )
    return out


def load_biorxiv_versions(raw: DataFrame) -> DataFrame:
    """article_versions of preprints: (article_id, version_number, version_date), the first of each."""
    doi = normalize_identifier(F.lit("doi"), "doi")
    rows = raw.where(filled(doi)).select(key_of("article", doi).alias("article_id"), F.col("version").try_cast("int").alias("version_number"), F.col("date").alias("version_date"))
    return rows.where("version_number IS NOT NULL").groupBy("article_id", "version_number").agg(F.min("version_date").alias("version_date"))


def _names(kind: str) -> list[str]:
    from biblio_spark.schema import field_names

    return field_names(kind)


def assemble_literature(catalog: dict[str, DataFrame]) -> DataFrame:
    """Nested records out of the catalogue: each child is aggregated by article first, so no join multiplies rows."""
    c = catalog
    ordered = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    people = c["article_authors"].join(c["authors"], "author_id")
    authors = people.groupBy("article_id").agg(
        F.transform(
            ordered("author_order", "full_name", "last_name", "fore_name", "initials", "orcid", "semantic_scholar_id", "is_corresponding"),
            lambda a: struct_of(AUTHOR, **{n: a[n] for n in ("full_name", "last_name", "fore_name", "initials", "orcid", "semantic_scholar_id", "is_corresponding")}, author_order=a["author_order"].cast("int")),
        ).alias("authors")
    )
    ids = c["article_identifiers"].groupBy("article_id").agg(
        F.transform(ordered("identifier_type", "identifier_value", "is_primary"), lambda i: struct_of(IDENTIFIER, **{n: i[n] for n in _names(IDENTIFIER)})).alias("identifiers")
    )
    kinds = c["article_categories"].join(c["subject_categories"], "category_id").groupBy("article_id").agg(
        F.transform(
            ordered("category_name", "category_code", "category_type", "is_major_topic", F.col("confidence_score").cast("double").alias("confidence_score")),
            lambda k: struct_of(CATEGORY, **{n: k[n] for n in _names(CATEGORY)}),
        ).alias("categories")
    )
    types = c["article_publication_types"].join(c["publication_types"], "publication_type_id").groupBy("article_id").agg(
        F.transform(ordered(*_names(PUBLICATION_TYPE)), lambda t: struct_of(PUBLICATION_TYPE, **{n: t[n] for n in _names(PUBLICATION_TYPE)})).alias("publication_types")
    )
    places = c["article_publications"].join(c["venues"], "venue_id", "left").select(
        "article_id",
        struct_of(VENUE, **{n: F.col(n) for n in _names(VENUE)}).alias("venue"),
        struct_of(PUBLICATION, **{n: F.col(n) for n in _names(PUBLICATION)}).alias("publication"),
    )
    article = F.struct(*(n for n in c["articles"].columns if n != "article_id")).alias("article")
    out = c["articles"].select("article_id", article)
    for part in (authors, ids, kinds, types, places):
        out = out.join(part, "article_id", "left")
    return out


def write_catalog(catalog: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """One Parquet table each; articles are partitioned by year. Their rows are dealt by year in parts of bounded size, so a year with
    most of the articles is written by many tasks and a small one by one."""
    for name, df in catalog.items():
        writer = df.hint("rebalance", "publication_year").write.partitionBy("publication_year") if name == "articles" else df.write
        writer.mode(mode).parquet(f"{path}/{name}")


def read_catalog(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def save_bucketed(catalog: dict[str, DataFrame], database: str, path: str, buckets: int) -> dict[str, DataFrame]:
    """The tables as tables of ``database`` under ``path``: those with an article_id in ``buckets`` buckets by it, sorted, articles by year
    besides. Joins and aggregations of them by article need no exchange."""
    spark = next(iter(catalog.values())).sparkSession
    out = {}
    for name, df in catalog.items():
        writer = df.write
        if "article_id" in df.columns:
            writer = df.repartition(buckets, "article_id").write.bucketBy(buckets, "article_id").sortBy("article_id")
            writer = writer.partitionBy("publication_year") if name == "articles" else writer
        writer.option("path", f"{path}/{name}").mode("overwrite").saveAsTable(f"{database}.{name}")
        out[name] = spark.table(f"{database}.{name}")
    return out


#: What tells the rows of a table apart. Children of an article come with it and never later.
TABLE_KEYS = {
    "data_sources": ["source_id"], "authors": ["author_id"], "affiliations": ["affiliation_id"], "venues": ["venue_id"], "subject_categories": ["category_id"],
    "publication_types": ["publication_type_id"], "article_sources": ["article_id", "source_id"], "article_identifiers": ["identifier_type", "identifier_value"],
    "article_authors": [], "article_publications": [], "article_categories": [], "article_publication_types": [], "articles": ["article_id"],
}


def add_to_catalog(spark: SparkSession, path: str, lit: DataFrame, current_year: int) -> dict[str, int]:
    """Load a further batch of records into the catalogue under ``path`` (an empty one for the first batch); rows added by table.

    Two batches after each other give what one load of both gives, the first before the second: keys come from natural keys, known
    articles, identifiers and names stay as they are, and a known article takes no more than new sources. New rows are found by keys
    against the stored keys alone, written aside, and then appended, dimensions first and articles last, so a batch that was broken off
    can be loaded again. Articles go to the partitions of their years; files of other years are not touched.
    """
    new = load_catalog(lit, current_year)
    stored = {}
    for name in TABLE_KEYS:
        try:
            stored[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    # what is known already, found on keys alone and written: its true size decides how the new rows are parted from it
    known = new["articles"].select("article_id")
    known = materialize(known.join(stored["articles"].select("article_id"), "article_id", "left_semi") if "articles" in stored else known.limit(0), "known")
    unknown = lambda df: df.join(known, "article_id", "left_anti") if "articles" in stored else df
    # the dimensions of new articles only, as a joint load has them
    used = {"authors": ("article_authors", "author_id"), "venues": ("article_publications", "venue_id"), "subject_categories": ("article_categories", "category_id"), "publication_types": ("article_publication_types", "publication_type_id"), "affiliations": ("article_authors", "affiliation_id")}
    fresh = {}
    for name, keys in TABLE_KEYS.items():
        df = new[name]
        if name in used:
            child, key = used[name]
            df = df.join(unknown(new[child]).select(key).distinct(), key, "left_semi")
        elif name.startswith("article") and name != "article_sources":
            df = unknown(df)
        if keys and name in stored and name != "articles":
            df = df.join(stored[name].select(*keys), keys, "left_anti")
        fresh[name] = materialize(df.select(*new[name].columns), f"new-{name}")
    write_catalog(fresh, path, "append")
    return {name: df.count() for name, df in fresh.items()}


def write_updates(spark: SparkSession, path: str, updates: DataFrame) -> list[int | None]:
    """``update_articles`` on a stored catalogue; the years whose partitions were written anew. Only those that hold an updated article, or
    get one by a changed year, are read and replaced. ``updates`` must not read the stored articles any more: give a written table."""
    articles = spark.read.parquet(f"{path}/articles")
    hit = articles.join(updates.select("article_id"), "article_id", "left_semi").select("publication_year")
    if "publication_year" in updates.columns:
        moved = updates.join(articles.select("article_id"), "article_id", "left_semi").where("publication_year IS NOT NULL").select("publication_year")
        hit = hit.unionByName(moved)
    years = {r[0] for r in hit.distinct().collect()}  # one row a year
    known = F.col("publication_year").isin(sorted(y for y in years if y is not None))
    touched = articles.where(F.coalesce(known, F.lit(None in years)))
    new = materialize(update_articles(touched, updates), "updated")
    new.hint("rebalance", "publication_year").write.option("partitionOverwriteMode", "dynamic").partitionBy("publication_year").mode("overwrite").parquet(f"{path}/articles")
    # a year whose articles have all moved gets no new files: its old ones go
    for year in years - {r[0] for r in new.select("publication_year").distinct().collect()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/articles/publication_year={'__HIVE_DEFAULT_PARTITION__' if year is None else year}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(years, key=lambda y: (y is None, y or 0))


def resolve_authors(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(row_id, author_id, is_new) for each row of ``new`` (row_id, full_name, orcid): the author with that ORCID, else with exactly
    that name, else a new one under its natural key. Names are aggregated first, so a frequent name joins one row."""
    by_orcid = existing.where(filled("orcid")).groupBy("orcid").agg(F.min("author_id").alias("a1"))
    by_name = existing.groupBy("full_name").agg(F.min("author_id").alias("a2"))
    own = F.coalesce(F.when(filled("orcid"), key_of("orcid", "orcid")), key_of("author", "full_name"))
    found = new.join(by_orcid, "orcid", "left").join(by_name, "full_name", "left")
    known = F.coalesce("a1", "a2")
    return found.select("row_id", F.coalesce(known, own).alias("author_id"), known.isNull().alias("is_new"))


def get_or_create(dimension: DataFrame, names: DataFrame, name: str, key: str, kind: str) -> DataFrame:
    """``dimension`` (key, name) with the names that it lacks under deterministic keys; blank names are left out."""
    new = names.select(strip(name).alias(name)).where(nonblank(name)).distinct().join(dimension, name, "left_anti")
    return dimension.select(key, name).unionByName(new.select(key_of(kind, name).alias(key), name))


def delete_articles(catalog: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The catalogue without the articles in ``ids`` (article_id) and their children; citations from them go, citations of them
    stay with a null target."""
    gone = ids.select("article_id").distinct()
    out = {}
    for name, df in catalog.items():
        if name == "citations":
            kept = df.join(gone.withColumnRenamed("article_id", "citing_article_id"), "citing_article_id", "left_anti")
            marked = kept.join(gone.select(F.col("article_id").alias("cited_article_id"), F.lit(True).alias("_gone")), "cited_article_id", "left")
            out[name] = marked.withColumn("cited_article_id", F.when(F.col("_gone").isNull(), F.col("cited_article_id"))).select(*df.columns)
        elif "article_id" in df.columns:
            out[name] = df.join(gone, "article_id", "left_anti")
        else:
            out[name] = df
    return out


def update_articles(articles: DataFrame, updates: DataFrame, key: str = "article_id") -> DataFrame:
    """``articles`` with the non-null fields of ``updates`` in place of their own; unknown keys are ignored."""
    fields = [c for c in updates.columns if c != key and c in articles.columns]
    new = updates.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    joined = articles.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in articles.columns))


def refresh_article_counts(articles: DataFrame, citations: DataFrame) -> DataFrame:
    """citation_count and reference_count from the edge list, aggregated before the joins."""
    cited = citations.where("cited_article_id IS NOT NULL").groupBy(F.col("cited_article_id").alias("article_id")).agg(F.count("*").alias("_c"))
    citing = citations.groupBy(F.col("citing_article_id").alias("article_id")).agg(F.count("*").alias("_r"))
    out = articles.join(cited, "article_id", "left").join(citing, "article_id", "left")
    return out.withColumn("citation_count", F.coalesce("_c", F.lit(0))).withColumn("reference_count", F.coalesce("_r", F.lit(0))).drop("_c", "_r")


def refresh_author_stats(authors: DataFrame, article_authors: DataFrame, articles: DataFrame) -> DataFrame:
    """paper_count and citation_count of every author."""
    stats = article_authors.join(articles.select("article_id", F.col("citation_count").alias("_n")), "article_id")
    stats = stats.groupBy("author_id").agg(F.count("*").alias("paper_count"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("citation_count"))
    kept = [c for c in authors.columns if c not in ("paper_count", "citation_count")]
    out = authors.select(*kept).join(stats, "author_id", "left")
    return out.select(*kept, F.coalesce("paper_count", F.lit(0)).alias("paper_count"), F.coalesce("citation_count", F.lit(0)).alias("citation_count"))


def drop_orphans(child: DataFrame, parent: DataFrame, key: str = "article_id", listed: bool = False) -> DataFrame:
    """``child`` without rows whose parent is missing, or (``listed``) those rows."""
    return child.join(parent.select(key).distinct(), key, "left_anti" if listed else "left_semi")


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows share, with their number. Keys with a null are not compared."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return df.where(whole).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
