"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblio_spark.llm.bytescan import chunks, free_prefix
from biblio_spark.operators.components import connected_components
from biblio_spark.storage import materialize, release

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits or fewer. Two halves of 32 bits then hold one with at most one of them.
DISTANCE = 3
#: A bucket of more different fingerprints takes the way over shared neighbours instead of pairs.
BUCKET = 64

_LOW = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes) -> bytes:
    """XXH64 of all shingles of a text, 8 bytes each, most significant first. A-Z is lower-cased; words are what white
    space (space, tab to carriage return) parts; fewer than three words are one shingle; none gives none."""
    import xxhash

    words = text.lower().split()
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return digest(joined, SEED) if words else b""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - SHINGLE].tolist()
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)])


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each text: bits set in over half of its ``counts`` hashes. Bits are summed eight at a time, as
    bytes of one word, over at most 255 hashes before the sums are widened."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    parts = -(-sizes // 255)
    text_start = np.cumsum(sizes) - sizes
    part_of = np.cumsum(parts) - parts
    begin = np.repeat(text_start, parts) + 255 * (np.arange(parts.sum()) - np.repeat(part_of, parts))
    found = np.zeros(len(full), dtype=np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LOW, begin)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), part_of, axis=0)
        over = 2 * sums > sizes[:, None]
        for byte in range(8):
            found |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = found
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, h, fp) of every row; fp is the fingerprint as a signed 64-bit number, h a hash of the text. Null texts have no words:
    fingerprint 0. Texts are read whole, other columns are left aside."""
    text = docs[text_column].cast("string")
    source = docs.select(docs[id_column].alias("id"), F.xxhash64(F.lit("text"), text).alias("h"), text.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch, "text"):
                raw = data.tobytes()
                each = [shingle_hashes(raw[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                counts = np.array([len(x) // 8 for x in each], dtype=np.int64)
                hashes = np.frombuffer(b"".join(each), dtype=">u8").astype(np.uint64)
                own = [batch.column(c).slice(first, end - first) for c in ("id", "h")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(majority(hashes, counts).view(np.int64))], names=["id", "h", "fp"])

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(scan, f"id {id_type}, h long, fp long")


_HALF = 0xFFFFFFFF


def _ball(radius: int) -> list[int]:
    """Masks that flip exactly ``radius`` of 32 bits."""
    if radius == 0:
        return [0]
    ones = [1 << i for i in range(32)]
    return ones if radius == 1 else [a | b for i, a in enumerate(ones) for b in ones[:i]]


def _flip(df: DataFrame, column: str, masks: list[int], to: str) -> DataFrame:
    """A row for each mask with ``column`` under it, by a small constant array."""
    mask = F.explode(F.lit(masks).cast("array<bigint>"))
    return df.withColumn("_mask", mask).withColumn(to, F.col(column).bitwiseXOR(F.col("_mask"))).drop("_mask")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints ``fp`` such that two are connected exactly if a chain of distances
    of 3 or fewer bits joins them.

    Multi-index hashing: of two such fingerprints one half differs in at most one bit. The table holds each
    fingerprint under either half; each looks up the Hamming ball of radius 1 around its own halves and the full
    distance is checked. In a bucket with more than ``bucket`` fingerprints pairs would grow with the square, so there the
    links run over common neighbours in the other half: a fingerprint within 1 bit of such a point and all others
    within 1 bit (or within 2, if they agree in the whole first half) are linked by one edge each, which is linear in
    the bucket and loses no link.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(_HALF))
    table = distinct.select(
        "fp",
        F.inline(
            F.array(
                F.struct(high.alias("key"), low.alias("other")),
                F.struct((low + F.lit(_HALF + 1)).alias("key"), high.alias("other")),
            )
        ),
    )
    probes = _flip(table, "key", _ball(0) + _ball(1), "at")
    heavy = materialize(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"), "heavy")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE
    some = not heavy.isEmpty()
    light = table.join(heavy, "key", "left_anti") if some else table
    # Spark takes an exploded table for as small as the table before it: without the hints it would broadcast the balls
    pairs = (
        probes.select(F.col("fp").alias("a"), F.col("at").alias("key"))
        .hint("merge")
        .join(light.select(F.col("fp").alias("b"), "key"), "key")
        .where((F.col("a") < F.col("b")) & near("a", "b"))
        .select("a", "b")
    )
    if some:
        exact = materialize(table.join(heavy, "key", "left_semi"), "exact")
        beside = probes.where("at <> key").select("fp", F.col("at").alias("key"), "other").hint("merge").join(heavy, "key", "left_semi")
        ring1 = _flip(exact, "other", _ball(0) + _ball(1), "hub")
        anchors = materialize(ring1.groupBy("key", "hub").agg(F.min("fp").alias("b")), "anchors")
        around = ring1.unionByName(_flip(exact, "other", _ball(2), "hub")).unionByName(_flip(beside, "other", _ball(0) + _ball(1), "hub"))
        over = around.hint("merge").join(anchors, ["key", "hub"]).where((F.col("fp") != F.col("b")) & near("fp", "b"))
        pairs = pairs.unionByName(over.select(F.col("fp").alias("a"), "b").distinct())
    return pairs.distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, fp and component_id, the smallest id that links reach, itself included.

    Equal fingerprints are one node of the graph, so copies cost one row each and never a pair. Documents without words
    have fingerprint 0 and link like others; texts of any length are read whole. Null ids take part and never become a
    component's id unless it has no other; repeated rows give repeated results; other columns are left aside; an empty table
    gives an empty one. The table of (id, fp) is written once; all later steps work on different fingerprints.
    """
    found, ids = _components(docs, id_column, text_column)
    return found.join(ids, "fp").select(F.col("id").alias(id_column), "fp", "component_id")


def _components(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of all rows, (fp, component, component_id) of different ones), both written."""
    found = materialize(fingerprints(docs, id_column, text_column), "fingerprints")
    distinct = materialize(found.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    parts = connected_components(links(distinct.select("fp")))
    labelled = distinct.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left")
    labelled = materialize(labelled.withColumn("component", F.coalesce("component", "fp")), "labelled")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = materialize(labelled.join(least, "component").select("fp", "component", "component_id"), "components")
    release(distinct, labelled)
    return found, ids


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component, all columns as they are: that with the smallest id (null ids last), of rows with one id that
    with the least hash of its text, of rows that agree in both any one.

    Rows are told apart by id and text, so neither null nor repeated ids let a copy stay or a text vanish. Only ids and
    hashes of the rows that go are joined; texts are shuffled only where these outgrow a broadcast, or rows agree in both.
    """
    found, ids = _components(docs, id_column, text_column)
    keeper = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h")).alias("k")
    rows = found.join(ids, "fp").groupBy("component", "id", "h").agg(F.count("*").alias("copies"))
    rows = materialize(rows, "rows")
    # written, so that the join below has exchanges of its own, which Spark splits where a component is hot
    keepers = materialize(rows.groupBy("component").agg(keeper).select("component", F.col("k.id").alias("kid"), F.col("k.h").alias("kh")), "keepers")
    marked = rows.join(keepers, "component").withColumn("stays", F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh")))
    gone = materialize(marked.where("NOT stays OR copies > 1").select("id", F.col("h").alias("_h"), "stays"), "gone")
    release(rows, keepers, found, ids)
    mark = free_prefix(*docs.columns) + "text_hash"
    own = docs.withColumn(mark, F.xxhash64(F.lit("text"), docs[text_column].cast("string")))
    same = own[f"`{id_column}`"].eqNullSafe(gone["id"]) & (own[mark] == gone["_h"])
    kept = own.join(gone, same, "left_anti")
    twins = gone.where("stays")
    if not twins.isEmpty():
        repeated = own.join(twins, own[f"`{id_column}`"].eqNullSafe(twins["id"]) & (own[mark] == twins["_h"]), "left_semi")
        kept = kept.unionByName(repeated.dropDuplicates([id_column, mark]))
    return kept.select(*(F.col(f"`{n}`") for n in docs.columns))
