"""Joins between records, id lists, citations and the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biblio_spark.functions.identifiers import normalize_identifier
from biblio_spark.functions.text import filled, nonblank, normalize_title
from biblio_spark.storage import materialize


def combine_sources(sources: dict[str, DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """(union of all that can be read, errors by name). The schema of each is resolved here, so a source that is missing or does
    not fit is recorded and the rest kept."""
    good, failed = [], {}
    for name, df in sources.items():
        try:
            df.schema  # noqa: B018  resolves the plan
            good.append(df if not good else good[0].limit(0).unionByName(df, allowMissingColumns=True))
        except Exception as error:
            failed[name] = str(error).splitlines()[0][:300]
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good) if good else None), failed


def _keys(lit: DataFrame) -> DataFrame:
    ids = lit.select("ord", F.explode("identifiers").alias("i"))
    return ids.select("ord", F.col("i.identifier_type").alias("kind"), normalize_identifier("i.identifier_type", "i.identifier_value").alias("key")).where(filled("key"))


def enrich_ids(ids: DataFrame, lit: DataFrame, kind: str = "doi", need_abstract: bool = False) -> DataFrame:
    """Every id of ``ids`` (column ``input_id``) with the first record that has it: input_id and the record's columns. Unknown ids
    are dropped, so are records without abstract if ``need_abstract``."""
    wanted = ids.select("input_id", normalize_identifier(F.lit(kind), "input_id").alias("key")).where(filled("key")).distinct()
    holders = _keys(lit).where(F.col("kind") == kind).groupBy("key").agg(F.min("ord").alias("ord"))
    found = wanted.join(holders, "key").select("input_id", "ord").join(lit, "ord")
    return found.where(nonblank("article.abstract")) if need_abstract else found


MATCH_ORDER = ("doi", "arxiv_id", "pmid", "url")


def match_by_priority(ids: DataFrame, lit: DataFrame) -> DataFrame:
    """(row_id, matched_by, ord): for each row of ``ids`` (row_id, doi, arxiv_id, pmid, url) the first record by the first kind that
    finds one. A url stands for an open-access url."""
    wanted = ids.select(
        "row_id",
        F.explode(
            F.array(*(F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), normalize_identifier(F.lit(k), k).alias("key")) for i, k in enumerate(MATCH_ORDER)))
        ).alias("w"),
    ).select("row_id", "w.*")
    urls = lit.select("ord", F.lit("url").alias("kind"), normalize_identifier(F.lit("url"), "article.open_access_url").alias("key"))
    holders = _keys(lit).unionByName(urls).where(filled("key")).groupBy("kind", "key").agg(F.min("ord").alias("ord"))
    found = wanted.where(filled("key")).join(holders, ["kind", "key"])
    best = found.groupBy("row_id").agg(F.min(F.struct("place", "kind", "ord")).alias("b"))
    return best.select("row_id", F.col("b.kind").alias("matched_by"), F.col("b.ord").alias("ord"))


def match_titles(titles: DataFrame, lit: DataFrame) -> DataFrame:
    """(row_id, hits, first_ord) for each row of ``titles`` (row_id, title): records with the same normal title."""
    own = lit.select("ord", normalize_title("article.title").alias("key")).where("key <> ''")
    counts = own.groupBy("key").agg(F.count("*").alias("hits"), F.min("ord").alias("first_ord"))
    out = titles.select("row_id", normalize_title("title").alias("key")).join(counts, "key", "left")
    return out.select("row_id", F.coalesce("hits", F.lit(0)).alias("hits"), "first_ord")


def crosswalk(identifiers: DataFrame, from_type: str, to_type: str, key: str = "article_id") -> DataFrame:
    """(from_value, to_value) of ids of two types that the same article has."""
    of = lambda kind, name: identifiers.where(F.col("identifier_type") == kind).select(key, F.col("identifier_value").alias(name))
    return of(from_type, "from_value").join(of(to_type, "to_value"), key).select("from_value", "to_value").distinct()


#: Edges that a task sorts at most, about, and ids that are sent to all tasks at most.
EDGES, FEW = 400_000, 50_000


def _linked(edges: DataFrame, ids: DataFrame, near: str, far: str, limit: int) -> DataFrame:
    """The tasks grow in number with the edges, so a task's memory does not. Edges of one paper are dealt into 16 parts that keep no more than
    ``limit`` each before they come together."""
    rows, ids = edges.where(F.col(far).isNotNull()).select(near, far), ids.select(F.col("id").alias(near))
    few = ids.limit(FEW + 1).count() <= FEW
    rows = rows.join(F.broadcast(ids), near, "left_semi") if few else rows
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // EDGES), 1)
    n = lambda *by: F.row_number().over(W.partitionBy(near, *by).orderBy(far))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(far), F.lit(16))).repartition(parts, near, "_part").distinct()
    dealt = dealt.withColumn("n", n("_part")).where(F.col("n") <= limit).select(near, far)
    found = dealt.repartition(parts, near).withColumn("n", n()).where(F.col("n") <= limit)
    return found if few else found.join(ids.repartition(parts, near), near, "left_semi")


def citing(edges: DataFrame, ids: DataFrame, limit: int = 1000) -> DataFrame:
    """Up to ``limit`` papers, by id, that cite each paper of ``ids`` (column ``id``). The limit is applied before the shuffle too."""
    return _linked(edges, ids, "cited_article_id", "citing_article_id", limit)


def references(edges: DataFrame, ids: DataFrame, limit: int = 1000) -> DataFrame:
    """Up to ``limit`` papers, by id, that each paper of ``ids`` cites."""
    return _linked(edges, ids, "citing_article_id", "cited_article_id", limit)


def title_tokens(title: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_title(title), " "), lambda w: w != ""))


def title_classes(articles: DataFrame) -> DataFrame:
    """(article_id, class_id, publication_year, tokens): articles of one year whose titles have the same tokens are a class, named by its
    least article. Titles without tokens are in none."""
    rows = articles.select("article_id", "publication_year", F.array_sort(title_tokens("title")).alias("tokens")).where(F.size("tokens") > 0)
    classes = rows.groupBy(F.col("publication_year").alias("_year"), F.col("tokens").alias("_tokens")).agg(F.min("article_id").alias("class_id"))
    same = F.col("publication_year").eqNullSafe(F.col("_year")) & (F.col("tokens") == F.col("_tokens"))
    return rows.join(classes, same).select("article_id", "class_id", "publication_year", "tokens")


def class_links(members: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(class1, class2, overlap): different classes of one year with token Jaccard at or above ``threshold``, class1 < class2.

    Tokens are numbered by falling rarity, so a class is a sorted list of numbers. Classes with that overlap share one of their first
    n - ceil(threshold * n) + 1 numbers; they meet there as numbers only, if their lengths fit and enough tokens can follow the places
    where they meet. The lists are fetched for pairs that are left.
    """
    sets = materialize(members.where("article_id = class_id").select("class_id", "publication_year", "tokens"), "sets")
    tokens = sets.select("class_id", "publication_year", F.explode("tokens").alias("t"))
    frequency = tokens.groupBy("t").agg(F.count("*").alias("df"))
    # numbers that grow with the frequency: ranges of it, sorted, lie one after another
    numbers = frequency.repartitionByRange("df", "t").sortWithinPartitions("df", "t").select("t", F.monotonically_increasing_id().alias("k"))
    numbers = materialize(numbers, "numbers")
    lists = tokens.join(numbers, "t").groupBy("class_id", "publication_year").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    lists = materialize(lists.withColumn("n", F.size("ks")), "lists")
    first = F.slice("ks", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    prefix = materialize(lists.select("class_id", "publication_year", "n", F.posexplode(first).alias("at", "k")), "prefix")
    other = prefix.select(F.col("class_id").alias("class2"), F.col("publication_year").alias("year"), F.col("n").alias("m"), F.col("at").alias("there"), F.col("k").alias("same"))
    both = prefix.withColumnRenamed("class_id", "class1").join(other, F.col("publication_year").eqNullSafe(F.col("year")) & (F.col("k") == F.col("same")))
    enough = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9)
    fits = (F.col("class1") < F.col("class2")) & (F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9)
    # the rarest token that both have is in both beginnings; where they meet in it, no more can be common than stand from there on
    follow = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("there"))
    pairs = both.where(fits & (follow >= enough)).select("class1", "class2").distinct()
    one = lists.select(F.col("class_id").alias("class1"), F.col("ks").alias("x"))
    two = lists.select(F.col("class_id").alias("class2"), F.col("ks").alias("y"))
    rated = pairs.join(one, "class1").join(two, "class2")
    common = F.size(F.array_intersect("x", "y"))
    return rated.select("class1", "class2", (common / (F.size("x") + F.size("y") - common)).alias("overlap")).where(F.col("overlap") >= threshold)


def candidate_classes(articles: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links): every article with its class, and pairs of classes. Two articles are alike if they share a class or their classes are
    linked; copies cost a row each, never a pair."""
    members = materialize(title_classes(articles), "members")
    return members.select("article_id", "class_id", "publication_year"), class_links(members, threshold)


def candidate_duplicates(articles: DataFrame, identifiers: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id1, id2, overlap): articles of one year with token Jaccard of their normal titles at or above ``threshold`` and no common
    identifier, id1 < id2.

    The pairs of ``candidate_classes``, each spelled out, which grows with the square of a class: ask for the classes where titles have many
    copies. Identifiers are compared for the pairs found, so one that many articles have makes no pairs.
    """
    members, linked = candidate_classes(articles, threshold)
    linked = materialize(linked, "links")
    same = members.select(F.col("class_id").alias("class1"), F.col("class_id").alias("class2"), F.lit(1.0).alias("overlap")).distinct()
    left, right = (members.select(F.col("article_id").alias(f"m{k}"), F.col("class_id").alias(f"class{k}")) for k in (1, 2))
    found = left.join(linked.unionByName(same), "class1").join(right, "class2").where("m1 <> m2 AND (class1 <> class2 OR m1 < m2)")
    found = found.select(F.least("m1", "m2").alias("id1"), F.greatest("m1", "m2").alias("id2"), "overlap")
    found = materialize(found, "candidates")
    own = identifiers.select("article_id", F.concat_ws(":", "identifier_type", normalize_identifier("identifier_type", "identifier_value")).alias("v"))
    own = own.where("v NOT LIKE '%:'").groupBy("article_id").agg(F.collect_set("v").alias("ids"))
    asked = found.join(own.select(F.col("article_id").alias("id1"), F.col("ids").alias("ids1")), "id1").join(own.select(F.col("article_id").alias("id2"), F.col("ids").alias("ids2")), "id2")
    shared = materialize(asked.where(F.arrays_overlap("ids1", "ids2")).select("id1", "id2"), "shared")
    return found.join(shared, ["id1", "id2"], "left_anti")


def pending_files(ids: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows of ``ids`` whose file is not there."""
    return ids.join(files.select(key).distinct(), key, "left_anti")
