"""Web archives: ARC records (versions 1 and 2) to WARC records with equivalent headers, written and read back.

Files hold one gzip member for each record, as is usual for both formats. Spark's text writer adds the same separator
after every row; here it is the gzip member of an empty text, so a file is a plain chain of gzip members.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblio_spark.storage import materialize

#: Payloads of at least so many bytes may be replaced by a revisit.
REVISIT_BYTES = 1000
#: Bytes of records that make one file, so that a reader can hold it; a larger record is a file by itself.
FILE_BYTES = 32_000_000

#: Fixed values of the formats.
ARC_V1_HEADER = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
ARC_V2_HEADER = (
    "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length",
)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


EMPTY_MEMBER = gzip_member(b"")


def gunzip_members(content: bytes) -> Iterator[bytes]:
    """The non-empty members of a chain, one at a time; a broken one raises zlib.error or ValueError."""
    view, at = memoryview(content), 0
    while at < len(view):
        reader = zlib.decompressobj(31)
        # a bounded window first: most members are small, and unused_data copies what follows
        step, size, parts = 65536, len(view), []
        while not reader.eof:
            if at >= size:
                raise ValueError("an archive member is cut off")
            parts.append(reader.decompress(view[at : at + step]))
            at += step
        at = min(at, size) - len(reader.unused_data)
        if data := b"".join(parts):
            yield data


def arc_version_block(version: int = 1, name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    """The first record of an ARC file, which names the version and the fields of the header lines that follow."""
    fields = ARC_V1_HEADER if version == 1 else ARC_V2_HEADER
    body = f"{version} 0 pages\n{' '.join(fields)}\n".encode()
    if version == 1:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n"
    else:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n"
    return line.encode() + body + b"\n"


def _url(url: str | None) -> str:
    """A URL without white space or control characters, as header lines need it; none is ``about:blank``."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "%%%02X" % ord(c) for c in url or "") or "about:blank"


def arc_record(url: str | None, payload: bytes, version: int = 1, date: str = "20000101000000") -> bytes:
    """A header line, the block (an HTTP response) with its declared length, and a line feed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    if version == 1:
        line = f"{_url(url)} 0.0.0.0 {date} text/html {len(http)}\n"
    else:
        digest = hashlib.md5(http, usedforsecurity=False).hexdigest()
        line = f"{_url(url)} 0.0.0.0 {date} text/html 200 {digest} - 0 pages.arc {len(http)}\n"
    return line.encode() + http + b"\n"


def parse_arc(content: bytes, version: int | None = None) -> Iterator[dict]:
    """The records of an ARC stream as dicts: offset (of the header line), url, ip, date, mime, status (None in version 1), block.

    A version block sets how the header lines after it are read; ``version`` is for streams without one. The block is
    as long as the line declares; a line with other fields or a block that ends early raises ValueError.
    """
    at = 0
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at {at}")
        line = content[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:
            at = end + 1
            continue
        fields = line.split(" ")
        if fields[0].startswith("filedesc://"):
            length = int(fields[-1])
            block = content[end + 1 : end + 1 + length]
            if len(block) < length:
                raise ValueError(f"version block of {length} bytes is cut off")
            version = int(block.split(b" ", 1)[0])
            at = end + 1 + length
            continue
        names = {1: ARC_V1_HEADER, 2: ARC_V2_HEADER}.get(version)
        if names is None or len(fields) != len(names):
            raise ValueError(f"not a header line of version {version}: {line[:100]}")
        row = dict(zip(names, fields, strict=True))
        length = int(row["Archive-length"])
        block = content[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"block of {length} bytes is cut off")
        status = row.get("Result-code", "-")
        yield {
            "offset": at,
            "url": row["URL"],
            "ip": row["IP-address"],
            "date": row["Archive-date"],
            "mime": row["Content-type"],
            "status": int(status) if status.isdigit() else None,
            "block": block,
        }
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with the empty line, payload) of a block; a block without HTTP is all payload."""
    if block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
        return block[: end + 4], block[end + 4 :]
    return b"", block


def warc_date(arc_date: str) -> str:
    """14 digits (or fewer, filled up) as WARC writes times; anything else is the epoch."""
    digits = arc_date if arc_date.isdigit() and 4 <= len(arc_date) <= 14 else "19700101000000"
    digits += "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


#: Upper 32 bits of record ids that hold the key of the source row.
_KEYED = 0x70616765


def _uuid(value: int) -> str:
    h = f"{value:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record_id(key: int) -> str:
    """A UUID (version 8, free form) that holds the row's key: the same key always has the same id, and the key can be
    read back."""
    low = key & 0xFFFFFFFFFFFFFFFF
    return _uuid(_KEYED << 96 | (low >> 56) << 80 | 8 << 76 | ((low >> 44) & 0xFFF) << 64 | 2 << 62 | (low & 0xFFFFFFFFFFF))


def place_id(stream: str, offset: int, url: str, date: str) -> str:
    """A UUID (version 8) of a record without a key, from where it stands and what its header line says."""
    value = int.from_bytes(hashlib.sha1("\n".join((stream, str(offset), url, date)).encode(), usedforsecurity=False).digest()[:16], "big")
    value = value & ~(0xF << 76) & ~(0x3 << 62) | 8 << 76 | 2 << 62
    if value >> 96 == _KEYED:
        value ^= 1 << 127
    return _uuid(value)


def record_key(text: str) -> int | None:
    """The key in a record id of ``record_id``, else None."""
    value = int(text.strip("<>").removeprefix("urn:uuid:").replace("-", ""), 16)
    if value >> 96 != _KEYED:
        return None
    low = ((value >> 80) & 0xFF) << 56 | ((value >> 64) & 0xFFF) << 44 | (value & 0xFFFFFFFFFFF)
    return low - (1 << 64) if low >> 63 else low


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def warc_record(identity: str, url: str, ip: str, date: str, head: bytes, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A response with the whole block, or a revisit with the HTTP head alone that refers to the record with the payload."""
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {identity}",
        f"WARC-Date: {warc_date(date)}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(digest)}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response" if head else "Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one WARC record; lengths, ends and block digests are checked."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        raise ValueError("not a WARC record")
    headers = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.lower()] = value.strip()
    length = int(headers["content-length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) < length or data[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError("wrong length of a WARC record")
    if digest := headers.get("warc-block-digest"):
        if digest != "sha1:" + base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode():
            raise ValueError("wrong digest of a WARC record")
    return headers, block


def pages_to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", version: int = 2) -> DataFrame:
    """(key, arc): each row as an ARC stream of its own, a version block and one record. A null html is empty."""
    source = pages.select(
        pages[key].cast("long").alias("key"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html")
    )

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = arc_version_block(version)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                bodies = part.column("html").cast(pa.binary()).to_pylist()
                out = [head + arc_record(u, b, version) for u, b in zip(part.column("url").to_pylist(), bodies, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, type=pa.binary())], names=["key", "arc"])

    return source.mapInArrow(convert, "key long, arc binary")


_RECORD = "key long, record_id string, url string, ip string, date string, head binary, payload binary, digest string"
_RECORD_TYPES = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.string()]
#: Bytes of payloads that a task hands on at once.
_BATCH_BYTES = 4_000_000


def _record_rows(stream: str, key: int | None, content: bytes) -> Iterator[tuple]:
    """Rows of _RECORD of one ARC stream. The first record of a stream with a key has the key and its id."""
    for n, r in enumerate(parse_arc(content)):
        head, payload = split_http(r["block"])
        digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
        own = key if n == 0 else None
        identity = record_id(own) if own is not None else place_id(stream, r["offset"], r["url"], r["date"])
        yield own, identity, r["url"], r["ip"], r["date"], head, payload, digest


def _record_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[6]) + 500
        if size > _BATCH_BYTES:
            yield _batch(out, _RECORD, _RECORD_TYPES)
            out, size = [], 0
    if out:
        yield _batch(out, _RECORD, _RECORD_TYPES)


def _batch(rows: list[tuple], ddl: str, types: list) -> pa.RecordBatch:
    columns = [pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ddl.split(", ")])


def read_arc(arcs: DataFrame) -> DataFrame:
    """A row for each record in the ARC streams of (key, arc): the columns of _RECORD. Of a stream of several records the first
    has the key; the ids of the others come from the stream's hash, their offsets, addresses and dates."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("key"), batch.column("arc"), strict=True)
            streams = ((key.as_py(), arc.as_py()) for key, arc in pairs)
            yield from _record_batches(row for key, arc in streams for row in _record_rows(hashlib.sha1(arc, usedforsecurity=False).hexdigest(), key, arc))

    return arcs.mapInArrow(parse, _RECORD)


def read_arc_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the ``.arc`` and ``.arc.gz`` files under ``path`` (a gzip member for each record, or one for all): the
    columns of _RECORD without keys. A file is read by one task, as ARC files (100 MB by custom) cannot be split."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{arc,arc.gz}").option("recursiveFileLookup", True).load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                raw = content.as_buffer()
                data = b"".join(gunzip_members(raw)) if bytes(memoryview(raw)[:2]) == b"\x1f\x8b" else memoryview(raw).tobytes()
                yield from _record_batches(_record_rows(name.as_py().rsplit("/", 1)[-1], None, data))

    return files.mapInArrow(parse, _RECORD)


def mark_revisits(records: DataFrame, originals: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``records`` with refers_to: the record with the largest key (of those without, the largest id) among records with an
    equal payload of at least ``least`` bytes, null for that record itself and for payloads that are smaller or stand alone.
    ``originals``: (digest, original), a struct of k, key and record_id."""
    joined = records.join(originals, "digest", "left")
    o = F.col("original")
    same = F.when(o["k"], F.col("key").eqNullSafe(o["key"])).otherwise(F.col("record_id").eqNullSafe(o["record_id"]))
    other = (F.length("payload") >= least) & o.isNotNull() & ~same
    return joined.withColumns({"refers_key": F.when(other, o["key"]), "refers_id": F.when(other, o["record_id"])}).drop("original")


def repeated_payloads(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(digest, original) of payloads that several rows hold, at least one of them with a key; only ids and digests are shuffled."""
    body = F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[key].cast("long").alias("key"), F.lit(None).cast("string").alias("record_id"), F.length(body).alias("n"), F.sha1(body).alias("digest"))
    return _repeated(rows.where(F.col("n") >= least)).where("original.k")


def _repeated(rows: DataFrame) -> DataFrame:
    largest = F.struct(F.col("key").isNotNull().alias("k"), "key", "record_id")
    return rows.groupBy("digest").agg(F.max(largest).alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")


def write_warc(records: DataFrame, path: str) -> None:
    """Write (_RECORD with refers_key or refers_id) as WARC files, one gzip member a record, in files of about FILE_BYTES."""

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "url", "ip", "date", "head", "payload", "digest", "refers_key", "refers_id"]
        one = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], type=pa.binary())], names=["record"])
        out, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                columns = [batch.column(n).slice(at, 500).to_pylist() for n in names]
                for *row, key, identity in zip(*columns, strict=True):
                    refers = record_id(key) if key is not None else identity
                    member = gzip_member(warc_record(*row, refers))
                    if out and size + len(member) > FILE_BYTES:
                        yield one(out)
                        out, size = [], 0
                    out.append(member)
                    size += len(member)
        if out:
            yield one(out)

    framed = records.mapInArrow(serialise, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = framed.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
    writer.option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files under ``path``: key, record_id, url, date, record_type, payload_bytes,
    payload_digest (hex), refers_to (key), refers_to_id, block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for data in gunzip_members(content.as_buffer()):
                    headers, block = parse_warc(data)
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = headers["warc-type"]
                    if kind == "response":
                        payload = split_http(block)[1]
                        if hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest:
                            raise ValueError("wrong payload digest of a WARC record")
                        length = len(payload)
                    else:
                        length = int(headers["x-payload-length"])
                    refers, identity = headers.get("warc-refers-to"), headers["warc-record-id"]
                    rows.append(
                        (record_key(identity), identity, headers["warc-target-uri"], headers["warc-date"], kind, length, digest, refers and record_key(refers), refers, block)
                    )
                    size += len(block)
                    if size > _BATCH_BYTES:
                        yield _batch(rows, _READ, _READ_TYPES)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _READ, _READ_TYPES)

    return files.mapInArrow(parse, _READ)


_READ = (
    "key long, record_id string, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "refers_to_id string, block binary"
)
_READ_TYPES = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def convert_pages(pages: DataFrame, path: str, version: int = 2, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Pages as ARC streams, converted to WARC files under ``path``.

    Of equal payloads of at least REVISIT_BYTES the record with the largest key is a response and the others revisit
    it; rows that repeat that key are responses too, and so are all smaller payloads. Null keys get an id from the stream;
    among copies they revisit the largest key, if there is one. Pages of any length are kept whole, other columns are left
    aside, an empty table gives no records.
    """
    originals = materialize(repeated_payloads(pages, key, html), "originals")
    records = read_arc(pages_to_arc(pages, key, url, html, version))
    write_warc(mark_revisits(records, originals), path)


def convert_arc_files(spark: SparkSession, source: str, path: str) -> None:
    """The ARC files under ``source`` as WARC files under ``path``. Of equal payloads of at least REVISIT_BYTES one record is a
    response and the others revisit it; only digests and ids are shuffled for that, and the files are read twice."""
    records = read_arc_files(spark, source)
    rows = records.where(F.length("payload") >= REVISIT_BYTES).select("key", "record_id", "digest")
    write_warc(mark_revisits(records, materialize(_repeated(rows), "originals")), path)
