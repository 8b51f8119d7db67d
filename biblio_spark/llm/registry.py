"""Registered queries of the numbered operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from biblio_spark.llm import alignment, clusters, decontaminate, kdtree, license_scan, multiset, packing, quality, repeats, secret_scan, simhash, token_files, warc
from biblio_spark.storage import new_path, read_table


def digest(values) -> object:
    """Lower-case hex SHA-256 of the strings, comma-joined."""
    return F.sha2(F.array_join(values, ","), 256)


def op1_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kdtree.quantized(read_table(spark, sf_dir, "embeddings"))
    return kdtree.top_k(vectors, F.col("vec_id") % 20 == 0)


SQL1 = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    line = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS),
        digest(line(base)).alias("base_sha256"),
        F.array_join(line("spans"), ",").alias("spans"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest(F.transform("items", lambda x: x.cast("string"))).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL4 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m,
         array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)
),
hits AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw USING (m, win)),
words AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits))
  GROUP BY doc_id
),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")}).drop("expressions")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_words")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.convert_pages(read_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url", F.col("date").alias("warc_date")
    )


SQL7 = """
WITH q AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, url FROM pages),
o AS (SELECT payload_digest, max(page_id) AS top FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, q.payload_digest, CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, url, '2000-01-01T00:00:00Z' AS warc_date
FROM q LEFT JOIN o ON o.payload_digest = q.payload_digest AND payload_bytes >= 1000
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path)
    return token_files.read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.centroid_clusters(read_table(spark, sf_dir, "embeddings"))


def _round11(n: int, last: bool = False) -> str:
    """One assignment to the centroids of round ``n`` (c{n}: num, v) and, unless it is the last, the centroids after it."""
    assign = f"""
a{n} AS (
  SELECT vec_id, v, num, dist FROM (
    SELECT vec_id, x.v, num, dist, row_number() OVER (PARTITION BY row ORDER BY dist, num) AS r
    FROM (SELECT row, vec_id, q.v, num, (list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS dist FROM q, c{n} c) x
  ) WHERE r = 1
)"""
    if last:
        return assign
    return assign + f""",
s{n} AS (SELECT num, p, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS k FROM (SELECT num, unnest(v)::BIGINT AS x, unnest(range(64)) AS p FROM a{n}) GROUP BY num, p),
m{n} AS (SELECT num, list(((s - ((s % k) + k) % k) / k)::DOUBLE ORDER BY p) AS v FROM s{n} GROUP BY num),
c{n + 1} AS (SELECT c.num, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m USING (num))"""


SQL11 = f"""
WITH q AS (
  SELECT row_number() OVER () AS row, vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings WHERE len(embedding) = 64 AND len([1 for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64
),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS num, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM q ORDER BY h LIMIT 16)),
{_round11(0)},
{_round11(1)},
{_round11(2)},
{_round11(3, last=True)}
SELECT vec_id, num::INTEGER AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY num))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia,
       sha256((SELECT array_to_string([x::BIGINT for x in c3.v], ',') FROM c3 WHERE c3.num = a3.num)) AS centroid_sha256
FROM a3
"""


def op12_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiset.edited_fingerprints(read_table(spark, sf_dir, "documents"))
    text = {"fingerprint": "fp", "edited_fingerprint": "edited_fp"}
    return found.select("doc_id", "n_chars", "edited_sha256", *(multiset.as_text(F.col(c)).alias(n) for n, c in text.items()), "near_edited", "near_next")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures, _ = alignment.align_documents(read_table(spark, sf_dir, "documents"))
    return measures


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_kdtree_topk": op1_kdtree_topk,
    "op2_secret_scan": op2_secret_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_decontaminate": op4_decontaminate,
    "op5_repeats": op5_repeats,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op9_quality": op9_quality,
    "op8_token_files": op8_token_files,
    "op10_license_scan": op10_license_scan,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_multiset_hash": op12_multiset_hash,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "pipeline": pipeline,
}
ORACLE_SQL = {"op1_kdtree_topk": SQL1, "op4_decontaminate": SQL4, "op7_warc": SQL7, "op11_centroid_clusters": SQL11}
