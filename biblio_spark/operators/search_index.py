"""An inverted index of character 3-grams: term search that reads the postings of a few grams and the records they lead to."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblio_spark.operators.search import FIELDS, search
from biblio_spark.schema import RECORD, RECORD_DDL
from biblio_spark.storage import materialize

GRAM = 3
#: Grams of a term whose postings are read, the rarest ones.
RAREST = 3
#: Parts of the index, by the hash of the gram, and of the records, by their number.
PARTS = 64
#: Characters of texts whose grams are taken at once, about; a longer text by itself.
BLOCK = 2_000_000


def _part(value: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")


def _post(number: np.ndarray, texts: list[list[str | None]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams, offsets, ords) of the texts of some records: the ords of a gram stand from its offset to the next, by growing record, each once."""
    row = np.argsort(number, kind="stable").tolist()
    each = [(k, t) for k, r in enumerate(row) for t in texts[r] if t is not None and len(t) >= GRAM]
    if not each:
        return [], np.zeros(1, np.int32), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(t for _, t in each).encode("utf-32-le"), dtype="<u4")
    size = np.array([len(t) for _, t in each])
    whole = np.ones(len(codes), dtype=bool)  # not where a gram would reach into the next text
    ends = np.cumsum(size)
    for k in range(1, GRAM):
        whole[ends - k] = False
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    kinds = np.flatnonzero(seen)
    rank = np.zeros(0x110000, dtype=np.int64)
    rank[kinds] = np.arange(len(kinds))
    code, at = rank[codes], np.flatnonzero(whole)
    gram = sum(code[at + k] * len(kinds) ** (GRAM - 1 - k) for k in range(GRAM))
    known = None
    if len(kinds) ** GRAM * len(row) >= 1 << 62:
        known, gram = np.unique(gram, return_inverse=True)
    pairs = np.sort(gram * len(row) + np.repeat(np.array([k for k, _ in each]), size)[at])  # many times faster than np.unique
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    gram, of = np.divmod(pairs, len(row))
    begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    gram = gram[begin] if known is None else known[gram[begin]]
    letters = np.stack([kinds[gram // len(kinds) ** (GRAM - 1 - k) % len(kinds)] for k in range(GRAM)], axis=1).astype("<u4")
    text = letters.tobytes().decode("utf-32-le")
    return [text[k : k + GRAM] for k in range(0, len(text), GRAM)], np.append(begin, len(pairs)).astype(np.int32), number[row][of]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, gram, ords) of blocks of records."""
    for batch in batches:
        length = pc.binary_length(batch.column("texts").flatten()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = pc.list_value_length(batch.column("texts")).to_numpy(zero_copy_only=False).astype(np.int64)
        after = np.concatenate([[0], np.cumsum(length)])[np.cumsum(number)]  # bytes up to each row
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + BLOCK, side="right")))
            part, at = batch.slice(at, stop - at), stop
            fields = np.array(part.column("field").to_pylist())
            for field in sorted(set(fields.tolist())):
                own = part.filter(pa.array(fields == field))
                grams, offsets, ords = _post(own.column("ord").to_numpy(), own.column("texts").to_pylist())
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array([field] * len(grams)), pa.array(grams), pa.ListArray.from_arrays(offsets, ords)], names=["field", "gram", "ords"])


def build_index(lit: DataFrame, path: str, parts: int = PARTS) -> None:
    """Write under ``path``: postings (field, gram, ords) and counts (gram, n) by part of the gram, and the records by part of ``ord``.

    A task takes the grams of blocks of records, so that a row has a gram with all records of its block: rows grow with the blocks and
    their different grams, not with the grams of every record. They are shuffled once and sorted by gram, so a reader that asks for a
    few of them skips most of a part by the statistics of its row groups. A part with most of the rows is written by many tasks.
    """
    texts = {"title": F.array("article.title"), "abstract": F.array("article.abstract"), "venue": F.array("venue.venue_name"), "author": F.transform("authors", lambda a: a["full_name"])}
    fields = F.array(*(F.struct(F.lit(f).alias("field"), t.alias("texts")) for f, t in texts.items()))
    rows = lit.select("ord", F.inline(fields)).where("texts IS NOT NULL").withColumn("texts", F.transform("texts", F.lower))
    postings = rows.mapInArrow(_blocks, "field string, gram string, ords array<long>").withColumn("part", _part("gram", parts))
    postings.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/postings")
    stored = _table(lit.sparkSession, path, "postings")
    counts = stored.groupBy("part", "gram").agg(F.sum(F.size("ords")).alias("n"))
    counts.hint("rebalance", "part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/counts")
    lit.select(*RECORD).withColumn("part", _part("ord", parts)).hint("rebalance", "part").write.partitionBy("part").parquet(f"{path}/records")
    lit.sparkSession.createDataFrame([(parts,)], "parts int").write.parquet(f"{path}/meta")


_TABLES = {"postings": "field string, gram string, ords array<long>, part int", "counts": "gram string, n long, part int", "records": f"{RECORD_DDL}, part int", "meta": "parts int"}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{path}/{name}")


def _of(df: DataFrame, grams: list[str], parts: int) -> DataFrame:
    """The rows of some grams: their parts of the table only, filters on the gram reach the scan."""
    numbers = df.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(_part("gram", parts)).distinct().collect()
    return df.where(F.col("part").isin([r[0] for r in numbers]) & F.col("gram").isin(grams))


def candidates(spark: SparkSession, path: str, term: str, fields=FIELDS, rarest: int = RAREST) -> DataFrame | None:
    """(ord) of the records that have the rarest grams of a term all in one of the fields; none is lost. Null for a term shorter than a gram,
    which the index cannot tell."""
    word = term.lower()
    grams = sorted({word[k : k + GRAM] for k in range(len(word) - GRAM + 1)})
    if not grams:
        return None
    parts = _table(spark, path, "meta").first()["parts"]
    known = {r["gram"]: r["n"] for r in _of(_table(spark, path, "counts"), grams, parts).collect()}  # as many as the term has
    postings = _table(spark, path, "postings")
    if len(known) < len(grams):
        return spark.createDataFrame([], "ord long")
    chosen = sorted(grams, key=lambda g: (known[g], g))[:rarest]
    found = _of(postings, chosen, parts).where(F.col("field").isin(*fields)).select("field", F.explode("ords").alias("ord")).groupBy("ord", "field").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(chosen)).select("ord").distinct()


def search_indexed(spark: SparkSession, path: str, must=(), should=(), must_not=(), fields=FIELDS) -> DataFrame:
    """The records of ``search`` on those that ``build_index`` got, each checked by its texts.

    Candidates of all terms of ``must`` are intersected, with those of any of ``should``; only the parts of the records that
    hold one are read. Terms that the index cannot tell, and
    ``must_not``, are left to the check; without any other term all records are read.
    """
    records = _table(spark, path, "records")
    some = [c for c in (candidates(spark, path, t, fields) for t in must) if c is not None]
    either = [candidates(spark, path, t, fields) for t in should]
    if either and all(c is not None for c in either):
        some.append(reduce(DataFrame.unionByName, either).distinct())
    if some:
        parts = _table(spark, path, "meta").first()["parts"]
        ids = reduce(lambda a, b: a.join(b, "ord", "left_semi"), some)
        # written, so that its true size decides how the records are found
        ids = materialize(ids.select("ord", _part("ord", parts).alias("part")), "candidates")
        held = [r[0] for r in ids.select("part").distinct().collect()]  # at most all parts
        records = records.where(F.col("part").isin(held)).join(ids, ["part", "ord"], "left_semi")
    return search(records.drop("part"), must, should, must_not, fields)
