"""Best-fit packing by minimum bin slack: bitset subset sums over available lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biblio_spark.llm.bytescan import chunks, free_prefix
from biblio_spark.llm.tokenizing import default_tokenizer, encoder
from biblio_spark.storage import materialize

CAPACITY = 2048
#: Pieces of one length are numbered in so many shares, and one more for each SHARE_ROWS of them.
SALTS, SHARE_ROWS = 64, 1_000_000


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill a bin as far as they can, the longest available length among them.

    Subset sums as bits of one integer; a length with count c enters in shares of 1, 2, 4, ... pieces, short lengths
    first. The highest reachable sum is traced back from the longest length on, each taken where the shorter ones can
    still make up the rest: of equally full combinations the one with the longest pieces, so that short pieces stay
    for bins that nothing else fills.
    """
    order = sorted(counts)
    longest = order[-1]
    room = capacity - longest
    bits, mask, history = 1, (1 << (room + 1)) - 1, []
    for length in order:
        left, share = min(counts[length] - (length == longest), room // length), 1
        if length > room:
            break
        while left > 0:
            take = min(share, left)
            history.append((length, take, bits))
            bits |= bits << (length * take) & mask
            left -= take
            share *= 2
    total, used = bits.bit_length() - 1, {longest: 1}
    for length, take, before in reversed(history):
        if total >= length * take and before >> (total - length * take) & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(bin content by length, number of such bins) until no piece is left.

    Each fullest combination is removed as often as the counts allow, so the work depends on the number of different
    lengths, at most ``capacity``, and not on the number of pieces.
    """
    counts = {length: n for length, n in histogram.items() if n}
    plan = []
    while counts:
        used = fullest(counts, capacity)
        times = min(counts[length] // n for length, n in used.items())
        plan.append((used, times))
        for length, n in used.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
    return plan


def _layout(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, sorted by rank: first rank, pieces in a bin, first bin, offset of the first such piece in the bin."""
    taken: dict[int, int] = {}
    rows: dict[int, list] = {}
    bins = 0
    for used, times in plan:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.setdefault(length, []).append((taken.get(length, 0), n, bins, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        bins += times
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for length, r in rows.items()}


def token_pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32. A text (null: empty) is its ids and ``end_id``; only one
    longer than ``capacity`` is cut, into pieces of that length with a shorter one first where it does not divide."""
    tokenizer = tokenizer or default_tokenizer()
    source = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        end_bytes = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for first, _, data, offsets in chunks(batch, "text"):
                ids, at = words.encode_flat(data, offsets)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                row, out = [], []
                for k, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    total, start, piece = high - low + 1, 0, 0
                    stop = (total - 1) % capacity + 1
                    while start < total:
                        crc = zlib.crc32(raw[4 * (low + start) : 4 * (low + min(stop, total - 1))])
                        row.append(first + k)
                        out.append((piece, start, stop - start, zlib.crc32(end_bytes, crc) if stop == total else crc))
                        start, stop, piece = stop, stop + capacity, piece + 1
                columns = [pa.array(list(c), type=t) for c, t in zip(zip(*out, strict=True), _PIECE_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, type=pa.int64())), *columns], names=["id", *_PIECE])

    id_type = source.schema["id"].dataType.simpleString()
    pieces = source.mapInArrow(cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long")
    return pieces.withColumnRenamed("id", id_column)


_PIECE = ["piece", "start", "length", "ids_crc32"]
_PIECE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """``pieces`` (with ``length`` up to ``capacity``, at least 1) with sequence_id and offset.

    A piece of ``capacity`` is a sequence by itself, with a negative number. Of the others only counts by length and share
    come to the driver (at most ``capacity`` x SALTS rows and one for each SHARE_ROWS pieces), where the bins are planned. A
    piece finds its place by its rank among the pieces of its length: its number in its share, ordered by id and
    piece, plus the pieces of the shares before. Shares grow in number with the pieces of a length, so a frequent length is
    not one task's work. ``pieces`` is read three times: give a written table. An empty table gives an empty result; null ids
    and repeated rows are packed one by one, equal rows in any order; other columns are
    carried along, but for a sequence_id and an offset, which are replaced.
    """
    spark = pieces.sparkSession
    names = [n for n in pieces.columns if n.lower() not in ("sequence_id", "offset")]
    pieces = pieces.select(*(F.col(f"`{n}`") for n in names))
    mark = free_prefix(*names)
    own_share, own_number = f"{mark}share", f"{mark}number"
    single = pieces.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    rest = pieces.where(F.col("length") < capacity)
    histogram = {r["length"]: r["count"] for r in rest.groupBy("length").count().collect()}
    if not histogram:
        return single
    wide = {length: min(n, SALTS + n // SHARE_ROWS) for length, n in histogram.items()}
    shares_of = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in sorted(wide.items()) for x in pair)), F.col("length").cast("long"))
    salted = rest.withColumn(own_share, F.pmod(F.xxhash64(id_column, "piece", "start", "ids_crc32"), shares_of))
    sizes = sorted(tuple(r) for r in salted.groupBy("length", own_share).count().collect())
    before: dict[tuple[int, int], int] = {}
    so_far = dict.fromkeys(histogram, 0)
    for length, share, n in sizes:
        before[length, share] = so_far[length]
        so_far[length] += n
    plan = spark.sparkContext.broadcast((_layout(plan_bins(histogram, capacity)), before))
    number = F.row_number().over(W.partitionBy("length", own_share).orderBy(id_column, "piece", "start", "ids_crc32")) - 1
    numbered = salted.withColumn(own_number, number.cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, earlier = plan.value
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            share = batch.column(own_share).to_numpy()
            rank = batch.column(own_number).to_numpy().copy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.lexsort((share, lengths))
            keys = np.stack([lengths[order], share[order]])
            cuts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                length = int(lengths[rows[0]])
                firsts, per_bin, bins, offsets = layout[length]
                r = rank[rows] + earlier[length, int(share[rows[0]])]
                at = np.searchsorted(firsts, r, side="right") - 1
                r = r - firsts[at]
                sequence[rows] = bins[at] + r // per_bin[at]
                offset[rows] = offsets[at] + r % per_bin[at] * length
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long").unionByName(single)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end id; a text of any length is encoded whole and cut into pieces. Null and
    repeated ids are kept row by row, other columns of ``docs`` are left aside, an empty table gives an empty result. The
    pieces, a few numbers each, are written once and read again; texts are read once and never shuffled.
    """
    return pack(materialize(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)
