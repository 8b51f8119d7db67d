"""Token ids in length-delimited binary files with masked checksums and a separate offset index.

A record of a data file: length of the payload (unsigned 64 bits), masked checksum of these 8 bytes (32 bits), payload,
masked checksum of the payload (32 bits), one line feed. All numbers are little-endian. The payload begins with a head: flags
(8 bits: 1 if the document has an id, 2 if its token ids have 32 bits and not 16), the id (signed 64 bits), the number of the
document in its writer's task (unsigned 64 bits), part and number of parts (32 bits each); the token ids follow. A
document with more than PART_BYTES of token ids is a record for each part, one after another. A checksum c is zlib's CRC-32,
masked as ((c >> 15 | c << 17) + 0xA282EAD8) modulo 2^32, so that data that hold checksums stay safe.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biblio_spark.llm.bytescan import chunks
from biblio_spark.llm.tokenizing import default_tokenizer, encoder

#: Fixed value of the mask.
MASK_DELTA = 0xA282EAD8

#: Bytes of token ids in one record, bytes of records that the writer gets as one row, such rows in a file: a file stays
#: under about PART_BYTES x ROWS, so that a reader can hold it whatever the lengths of the texts.
PART_BYTES, ROWS = 1_000_000, 64

_FRAME = struct.Struct("<QI")
_HEAD = struct.Struct("<BqQII")
_KNOWN, _WIDE = 1, 2


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The record without the line feed that ends it."""
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))])


def read_frame(view: memoryview, at: int) -> memoryview:
    """The payload of the record at ``at``; ValueError where a length or checksum is wrong."""
    if at + _FRAME.size > len(view):
        raise ValueError(f"record at {at} is cut off")
    size, check = _FRAME.unpack_from(view, at)
    if masked_crc(view[at : at + 8]) != check:
        raise ValueError(f"wrong checksum of the length at {at}")
    start, end = at + _FRAME.size, at + _FRAME.size + size
    if end + 5 > len(view) or view[end + 4] != 10:
        raise ValueError(f"record at {at} is cut off")
    if masked_crc(view[start:end]) != struct.unpack_from("<I", view, end)[0]:
        raise ValueError(f"wrong checksum of the payload at {at}")
    return view[start:end]


def read_frames(content: bytes) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of every record, one after another."""
    view, at = memoryview(content), 0
    while at < len(view):
        payload = read_frame(view, at)
        yield at, payload
        at += _FRAME.size + len(payload) + 5


def unpack_payload(payload: memoryview) -> tuple[int | None, int, int, int, np.ndarray]:
    """(document, number in its task, part, parts, token ids)."""
    flags, doc, serial, part, parts = _HEAD.unpack_from(payload)
    tokens = np.frombuffer(payload[_HEAD.size :], dtype="<u4" if flags & _WIDE else "<u2")
    return doc if flags & _KNOWN else None, serial, part, parts, tokens


def pack_document(doc: int | None, serial: int, tokens: np.ndarray, wide: bool) -> list[bytes]:
    """The payloads of a document; ValueError if an id does not fit."""
    if len(tokens) and not wide and int(tokens.max()) > 0xFFFF:
        raise ValueError("token ids beyond 65,535 need 32 bits: write with wide=True")
    raw = tokens.astype("<u4" if wide else "<u2").tobytes()
    flags = (_KNOWN if doc is not None else 0) | (_WIDE if wide else 0)
    parts = max(1, -(-len(raw) // PART_BYTES))
    return [_HEAD.pack(flags, doc or 0, serial, k, parts) + raw[k * PART_BYTES : (k + 1) * PART_BYTES] for k in range(parts)]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, the highest bit for the power 0."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1
    return out


def crc_join(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings after one another, from theirs and the second one's size."""
    power, base, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            power = _times(power, base)
        base = _times(base, base)
        n >>= 1
    return _times(power, first) ^ second


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 0,
    wide: bool | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write the ids of every text, each followed by ``end_id``, under ``path``/data in ascending order of the ids of
    documents, and the index under ``path``/index.

    One range shuffle brings the texts in order (repeated ids in order of a hash of their texts, null ids first; a null
    text is empty); the driver samples ids and hashes for it, no texts; each task encodes and frames its stretch. ``wide``
    stores 32 bits an id and not 16 (None: where the vocabulary asks for it). Ids of documents are stored as signed 64 bits.
    Texts of any length are whole, in several records if need be; other columns are left aside; an empty table gives files
    without records.
    """
    tokenizer = tokenizer or default_tokenizer()
    ordered = docs.select(docs[id_column].cast("long").alias("id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    ordered = ordered.withColumn("hash", F.xxhash64("text")).repartitionByRange("id", "hash").sortWithinPartitions("id", "hash")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        broad = words.tokenizer.get_vocab_size() > 0x10000 if wide is None else wide
        serial, out, size = 0, [], 0
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, _, data, offsets in chunks(batch, "text"):
                found, at = words.encode_flat(data, offsets)
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    for payload in pack_document(ids[first + k], serial, np.append(found[a:b], np.uint32(end_id)), broad):
                        if out and size + len(payload) > PART_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(out)], type=pa.binary())], names=["record"])
                            out, size = [], 0
                        out.append(frame(payload))
                        size += len(out[-1])
                    serial += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(out)], type=pa.binary())], names=["record"])

    framed = ordered.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    framed.write.option("lineSep", "\n").option("maxRecordsPerFile", ROWS).text(f"{path}/data")
    _index(docs.sparkSession, path).write.parquet(f"{path}/index")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """The data files whole, with their place in the order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        name.alias("file"),
        F.regexp_extract(name, r"^part-(\d+)", 1).cast("long").alias("task"),
        F.regexp_extract(name, r"-c(\d+)\.", 1).cast("long").alias("piece"),
        "content",
    )


_INDEX_NAMES = ["doc_id", "file", "task", "piece", "serial", "part", "parts", "offset", "size", "before_in_file", "n_tokens", "ids_crc32"]
_INDEX_TYPES = [pa.int64(), pa.string(), *[pa.int64()] * 10]
_INDEX_DDL = ", ".join(f"{n} {'string' if n == 'file' else 'long'}" for n in _INDEX_NAMES)


def _index(spark: SparkSession, path: str) -> DataFrame:
    """Read the data files back: a row for each record with its place, and what is known of its ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = batch.column("content")[k].as_buffer()
                name, task, piece = (batch.column(c)[k].as_py() for c in ("file", "task", "piece"))
                out, before = [], 0
                for offset, payload in read_frames(content):
                    doc, serial, part, parts, ids = unpack_payload(payload)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    out.append((doc, name, task, piece, serial, part, parts, offset, len(payload), before, len(ids), crc))
                    before += len(ids)
                if out:
                    columns = [pa.array(list(c), type=t) for c, t in zip(zip(*out, strict=True), _INDEX_TYPES, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=_INDEX_NAMES)

    return _parts(spark, path).mapInArrow(rows, _INDEX_DDL)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The index: a row for each record with _INDEX_NAMES and ``start``, the number of ids in all records before it. Running
    totals are taken over the files of a task, and over one number for each task of the writer."""
    index = spark.read.schema(_INDEX_DDL).parquet(f"{path}/index")
    files = index.groupBy("task", "piece").agg(F.sum("n_tokens").alias("ids"))
    earlier = W.partitionBy("task").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    files = files.withColumn("in_task", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
    tasks = files.groupBy("task").agg(F.sum("ids").alias("ids"))
    order = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before"))
    places = files.join(tasks, "task").select("task", "piece", (F.col("before") + F.col("in_task")).cast("long").alias("before"))
    return index.join(places, ["task", "piece"]).select(*_INDEX_NAMES, (F.col("before") + F.col("before_in_file")).alias("start"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, offset, size, start, n_tokens, ids_crc32 of every document, the place being that of its first record.
    Only documents of several records are grouped; their checksums follow from those of the parts."""
    records = read_records(spark, path)
    columns = ("doc_id", "file", "offset", "size", "start", "n_tokens", "ids_crc32")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                crc, n = 0, 0
                for part in sorted(row.pop("of"), key=lambda x: x["part"]):
                    if part["part"] == 0:
                        row |= {c: part[c] for c in columns if c in part}
                    crc = crc_join(crc, part["ids_crc32"], 4 * part["n_tokens"])
                    n += part["n_tokens"]
                row |= {"n_tokens": n, "ids_crc32": crc}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=pa.string() if c == "file" else pa.int64()) for c in columns], names=list(columns))

    single = records.where("parts = 1").select(*columns)
    several = records.where("parts > 1").groupBy("task", "serial", "doc_id").agg(
        F.collect_list(F.struct("part", "file", "offset", "size", "start", "n_tokens", "ids_crc32")).alias("of")
    )
    several = several.select("doc_id", "of").mapInArrow(joined, ", ".join(f"{c} {'string' if c == 'file' else 'long'}" for c in columns))
    return single.unionByName(several)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, serial, task, part, parts and ids of every record, from the data files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                task = batch.column("task")[k].as_py()
                yield _tokens([(task, 0, payload) for _, payload in read_frames(batch.column("content")[k].as_buffer())])

    return _parts(spark, path).mapInArrow(rows, _TOKENS_DDL).drop("position")


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, wanted: DataFrame | None = None) -> DataFrame:
    """The records in a random order that depends on ``seed`` alone: position (its order), doc_id, serial, task, part,
    parts, ids. ``wanted`` (file, offset), for instance a part of ``read_records``, reads these records alone.

    The index tells each file's records; a record is taken from its offset, checked, and sent on by one shuffle on its
    position, a hash, by which each partition is sorted. Records at other offsets are not looked at.
    """
    wanted = (read_records(spark, path) if wanted is None else wanted).select("file", "offset").distinct()
    places = wanted.withColumn("position", F.xxhash64(F.lit(seed), "file", "offset"))
    places = places.groupBy("file").agg(F.collect_list(F.struct("offset", "position")).alias("at"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                view = memoryview(batch.column("content")[k].as_buffer())
                task = batch.column("task")[k].as_py()
                yield _tokens([(task, a["position"], read_frame(view, a["offset"])) for a in batch.column("at")[k].as_py()])

    found = _parts(spark, path).join(places, "file").select("task", "content", "at").mapInArrow(rows, _TOKENS_DDL)
    return found.repartition("position").sortWithinPartitions("position")


_TOKENS_DDL = "position long, doc_id long, serial long, task long, part long, parts long, ids array<long>"


def _tokens(records: list[tuple[int, int, memoryview]]) -> pa.RecordBatch:
    rows = [(position, doc, serial, task, part, parts, ids.astype(np.int64)) for task, position, payload in records for doc, serial, part, parts, ids in [unpack_payload(payload)]]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    arrays = [pa.array(list(c), type=pa.int64()) for c in columns[:6]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(list(columns[6]), type=pa.list_(pa.int64()))], names=[x.split()[0] for x in _TOKENS_DDL.split(", ")])
