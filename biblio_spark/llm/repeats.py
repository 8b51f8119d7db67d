"""Exact removal of long repeated strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases at places that depend on the symbols around them alone, so equal strings
are cut alike wherever they stand. The dictionary of phrases with their contexts then decides nearly everything: a string
that holds a core found once is unique, and one whose whole context is found twice is repeated. Where equal cores stand in
different contexts, at the rims of repeats, the same is asked of shorter stretches, and only where these differ too are
single strings compared. Suffix arrays would give the order of all suffixes; equality of strings of one length is all that is
asked, so hashes take the place of ranks (README tells what the arrays would cost).

Symbols are the bytes of a text, or its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblio_spark.llm.bytescan import LOWER, WORD, flat, texts_of, word_bounds
from biblio_spark.llm.decontaminate import word_hashes
from biblio_spark.storage import materialize, release


@dataclass(frozen=True)
class Unit:
    """``length``: symbols of a repeated string. ``reach``: starts that may share a mark; the core, common to all strings with a
    mark, has length - reach + 1 symbols. ``step``: starts of the shorter stretches. ``gram``: symbols under the rolling hash,
    one in ``trigger`` of its values ends a phrase. ``apart``: copies count only in different rows."""

    words: bool
    length: int
    reach: int
    step: int
    gram: int
    trigger: int
    apart: bool

    @property
    def counts(self) -> tuple[str, ...]:
        """What is summed of copies: their number, or the least and greatest row that has one."""
        return ("lo", "hi") if self.apart else ("copies",)

    @property
    def repeated(self) -> str:
        return "lo <> hi" if self.apart else "copies > 1"


BYTES = Unit(words=False, length=400, reach=336, step=16, gram=32, trigger=512, apart=False)
WORDS = Unit(words=True, length=50, reach=42, step=8, gram=3, trigger=256, apart=True)

#: Symbols handled at once.
CHUNK = 1_000_000

#: Texts are filtered before a join by so many shares of their hashes; a list of shares is never longer.
SHARES = 1 << 20

_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""

    def row(base: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return row(base), row(pow(base, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class _Sums:
    def __init__(self, values: np.ndarray, base: int):
        power, self.inverse = _powers(base, 1 << max(20, (len(values) + 1).bit_length()))
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


class RollingHash:
    """Two independent hashes of any stretches of ``data`` from running sums: ``of`` sums the symbols, ``other`` a hash of every
    eight bytes (or of every word), with another base."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.wide = 8 if data.dtype == np.uint8 else 1
        values = data.astype(np.uint64) + np.uint64(1)
        self.first = _Sums(values, _BASES[0])
        self.of = self.first.of

    @property
    def second(self) -> _Sums:
        if not hasattr(self, "_second"):
            if self.wide == 8:
                padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
                values = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))[: max(0, len(self.data) - 7)]
            else:
                values = self.data
            values = values * np.uint64(_BASES[1])
            self._second = _Sums(values ^ (values >> np.uint64(29)), _BASES[1])
        return self._second

    def other(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.second.of(start, end - self.wide + 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    forth = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forth[width - 1 : n])


def phrase_marks(hashes: RollingHash, n: int, unit: Unit) -> np.ndarray:
    """For every start i, the place of the mark of the string of unit.length there: the first place in i .. i + reach - 1
    where the rolling hash triggers, else the first one with the least hash. It depends on that string alone."""
    last = n - unit.gram + 1
    sums = hashes.first
    h = mix((sums.sums[unit.gram : unit.gram + last] - sums.sums[:last]) * sums.inverse[:last]) >> np.uint64(24)
    h[(h & np.uint64(unit.trigger - 1)) == 0] = 0
    h <<= np.uint64(24)
    h |= np.arange(last, dtype=np.uint64)
    return (sliding_least(h, unit.reach) & _PLACE).astype(np.int64)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, offsets of the texts in them) of consecutive texts; the words are those of decontamination. Few bytes are
    handled at once, cut where no word is."""
    out, counts = [], np.zeros(len(offsets), dtype=np.int64)
    at = 0
    while at < len(data):
        end = min(len(data), at + 4 * CHUNK)
        while end < len(data) and WORD[data[end - 1]]:
            end += 1
        part = data[at:end]
        bounds = np.clip(offsets - at, 0, len(part))
        starts, ends, before = word_bounds(part, bounds)
        out.append(word_hashes(LOWER[part], starts, ends) if len(starts) else np.zeros(0, np.uint64))
        counts += before
        at = end
    return np.concatenate([np.zeros(0, np.uint64), *out]), counts


def pieces(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, rows, bounds, shift): stretches of consecutive texts of about CHUNK bytes. ``rows`` are row numbers, ``bounds``
    their offsets in the symbols, ``shift`` what to add for a place in the text. A longer text comes in parts that share
    length - 1 symbols, so that each string lies in exactly one of them."""
    data, offsets = flat(texts_of(batch.column("text")))
    row = 0
    while row < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        part, bounds = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        if unit.words:
            part, bounds = _words(part, bounds)
        if end == row + 1 and len(part) > CHUNK:
            for at in range(0, len(part) - unit.length + 1, CHUNK):
                some = part[at : at + CHUNK + unit.length - 1]
                yield some, np.array([row]), np.array([0, len(some)]), np.array([at])
        else:
            yield part, np.arange(row, end), bounds, np.zeros(end - row, np.int64)
        row = end


def phrases(part: np.ndarray, bounds: np.ndarray, hashes: RollingHash, unit: Unit) -> tuple[np.ndarray, ...]:
    """(text number, first start, number of starts, mark) of the maximal runs of starts with one mark."""
    none = (np.zeros(0, np.int64),) * 4
    if len(part) < unit.length:
        return none
    marks = phrase_marks(hashes, len(part), unit)
    starts = len(part) - unit.length + 1
    marks = marks[:starts]
    room = np.maximum(np.diff(bounds) - unit.length + 1, 0)
    valid = np.zeros(starts + 1, dtype=np.int64)
    some = room > 0
    np.add.at(valid, bounds[:-1][some], 1)
    np.add.at(valid, bounds[:-1][some] + room[some], -1)
    inside = np.cumsum(valid[:-1]) > 0
    first = np.zeros(starts, dtype=bool)
    first[bounds[:-1][some]] = True
    begin = inside.copy()
    begin[1:] &= first[1:] | (marks[1:] != marks[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(begin)
    if not len(begin):
        return none
    text = np.searchsorted(bounds, begin, side="right") - 1
    limit = bounds[text] + room[text]
    end = np.minimum(np.concatenate([begin[1:], [starts]]), limit)
    return text, begin, end - begin, marks[begin]


def context_hash(hashes: RollingHash, begin: np.ndarray, count: np.ndarray, back: np.ndarray, unit: Unit) -> np.ndarray:
    """Of all symbols of the strings of a run of starts, with the mark's distance from its first one."""
    return mix(hashes.other(begin, begin + count - 1 + unit.length) ^ mix((back << 16 | count).astype(np.uint64)))


def _ddl(fields: str, unit: Unit) -> str:
    return ", ".join([fields, *(f"{c} long" for c in unit.counts)])


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_RUN = "t1 long, t2 int, d long, start long, n int, back int, core long, context long"


def _run_scan(unit: Unit):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(t1, t2, d, text) to a row for each run of starts with one mark."""
        for batch in batches:
            for part, rows, bounds, shift in pieces(batch, unit):
                hashes = RollingHash(part)
                text, begin, count, mark = phrases(part, bounds, hashes, unit)
                if len(text):
                    row = pa.array(rows[text])
                    columns = [batch.column(c).take(row) for c in ("t1", "t2", "d")]
                    columns += [
                        pa.array(begin - bounds[text] + shift[text]),
                        pa.array(count.astype(np.int32)),
                        pa.array((mark - begin).astype(np.int32)),
                        _signed(hashes.of(mark, mark + unit.length - unit.reach + 1)),
                        _signed(context_hash(hashes, begin, count, mark - begin, unit)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=_names(_RUN))

    return runs


def _listed(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]]:
    """(rows, symbols, fields, shift) of the listed runs: many texts at once, or a long text a stretch at a time. ``rows`` are row
    numbers, the starts among the fields are places in the symbols, ``shift`` is what to add for those in the text."""
    lists = batch.column("runs")
    fields = {f.name: v.to_numpy() for f, v in zip(lists.type.value_type, lists.flatten().flatten(), strict=True)}
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
    order = np.lexsort((fields["start"], row))
    fields, row = {name: v[order] for name, v in fields.items()}, row[order]
    data, offsets = flat(texts_of(batch.column("text")))
    first = 0
    while first < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        end = min(max(end, first + 1), batch.num_rows)
        part, bounds = data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        if unit.words:
            part, bounds = _words(part, bounds)
        low, high = np.searchsorted(row, [first, end])
        shift = -bounds[row[low:high] - first]
        start, n = fields["start"][low:high] - shift, fields["n"][low:high]
        at = 0
        while at < len(start):
            begin, stop = 0, len(start)
            if len(part) > 2 * CHUNK:
                begin = int(start[at])
                stop = max(int(np.searchsorted(start, begin + CHUNK, side="left")), at + 1)
            some = slice(at, stop)
            of = {name: v[low:high][some] for name, v in fields.items()} | {"start": start[some] - begin}
            last = int((start[some] + n[some]).max()) + unit.length - 1
            yield row[low:high][some], part[begin:last], of, shift[some] + begin
            at = stop
        first = end


def _spread(times: np.ndarray) -> np.ndarray:
    """0 .. times - 1 for each of ``times``."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


_STRETCH = "t1 long, t2 int, start long, n int, at int, core long, context long, block long, inner long"


def _stretch_scan(unit: Unit):
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Listed runs to a row for each stretch of starts whose distances from the mark agree but for the remainder by
        unit.step. ``block`` names what all strings of such a stretch hold, ``inner`` all that this one holds."""
        for batch in batches:
            for row, data, of, shift in _listed(batch, unit):
                hashes = RollingHash(data)
                n, back = of["n"].astype(np.int64), of["back"].astype(np.int64)
                mark = of["start"] + back
                top = back // unit.step
                times = top - (back - n + 1) // unit.step + 1
                j = np.repeat(top, times) - _spread(times)
                rep = lambda x: np.repeat(x, times)
                far = np.minimum(rep(back), (j + 1) * unit.step - 1)
                near = np.maximum(rep(back - n + 1), j * unit.step)
                begin, count = rep(mark) - far, far - near + 1
                block_start = rep(mark) - j * unit.step
                block = hashes.of(block_start, block_start - unit.step + 1 + unit.length)
                block = mix(block ^ mix(rep(of["core"]).view(np.uint64) ^ j.astype(np.uint64)))
                text = pa.array(rep(row))
                columns = [
                    batch.column("t1").take(text),
                    batch.column("t2").take(text),
                    pa.array(begin + rep(shift)),
                    pa.array(count.astype(np.int32)),
                    pa.array((begin - rep(of["start"])).astype(np.int32)),
                    pa.array(rep(of["core"])),
                    pa.array(rep(of["context"])),
                    _signed(block),
                    _signed(context_hash(hashes, begin, count, far, unit)),
                    *(pa.array(rep(of[c])) for c in unit.counts),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_names(_ddl(_STRETCH, unit)))

    return stretches


_STRING = "block long, inner long, k int, a long, b long"


def _string_scan(unit: Unit):
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Listed stretches to a row for each string, with two hashes."""
        for batch in batches:
            for _, data, of, _ in _listed(batch, unit):
                hashes = RollingHash(data)
                times = of["n"].astype(np.int64)
                k = _spread(times)
                place = np.repeat(of["start"], times) + k
                rep = lambda x: pa.array(np.repeat(x, times))
                columns = [rep(of["block"]), rep(of["inner"]), pa.array(k.astype(np.int32))]
                columns += [_signed(hashes.of(place, place + unit.length)), _signed(hashes.other(place, place + unit.length))]
                columns += [rep(of[c]) for c in unit.counts]
                yield pa.RecordBatch.from_arrays(columns, names=_names(_ddl(_STRING, unit)))

    return strings


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans, numbers of passages) to the id, sizes, numbers and the bytes that stay; touching spans are one."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4 * CHUNK, side="right")))
            part = batch.slice(at, end - at)
            data, offsets = flat(part.column("text"))
            lists = part.column("spans")
            row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            start, stop = (v.to_numpy() + offsets[row] for v in lists.flatten().flatten())
            marks = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(marks, start, 1)
            np.add.at(marks, stop, -1)
            gone = np.cumsum(marks[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edges = offsets[:-1][offsets[:-1] < len(data)]
            begins[edges] = gone[edges]  # a text begins a span of its own
            spans = np.concatenate([[0], np.cumsum(begins)])
            left = offsets - before[offsets]
            kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[~gone])])
            columns = [pa.array(np.diff(x)) for x in (offsets, before[offsets], spans[offsets])]
            columns = [part.column("id"), *columns, kept, part.column("n_passages"), part.column("passage_words")]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages", "passage_words"])
            at = end


def _possible(texts: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """``texts`` that may (left_semi) or cannot (left_anti) have a key in ``keys``, by SHARES shares of the hashes: the broadcast
    list has at most SHARES numbers whatever the size of the tables."""
    share = F.pmod("t1", F.lit(SHARES)).alias("share")
    listed = keys.select(share).distinct()
    return texts.withColumn("share", F.pmod("t1", F.lit(SHARES))).join(F.broadcast(listed), "share", kind).drop("share")


def _texts(docs: DataFrame, id_column: str, text_column: str, unit: Unit) -> DataFrame:
    """t1, t2 (two hashes of the text), text and d (the row: its id and text; 0 where copies in one row count)."""
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    row = F.xxhash64(docs[id_column].cast("string"), text) if unit.apart else F.lit(0).cast("long")
    return docs.select(F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), row.alias("d"), text.alias("text"))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: Unit = BYTES) -> DataFrame:
    """(t1, t2, spans): for every different text with a repeated string, the spans (symbols, end exclusive, unmerged) of all
    runs of repeated strings. t1, t2 are two hashes of the text; equal texts have equal spans, so each is listed once.

    1. Runs of starts with the same mark, from one pass over the texts, are counted by the hash of the phrase core at
       the mark. A core found once settles its run: nothing there is repeated.
    2. A core whose contexts are all equal settles its runs too: all strings there are repeated.
    3. Of the other runs each different context is taken once, from one text, and cut into stretches of unit.step starts. The
       same two rules settle most of them.
    4. Of the other stretches each different one is taken once; its strings are hashed one by one, and a string is
       repeated if stretches with two or more copies in total hold it. The answers go back to all runs with that context.
    Hot cores and copies meet only in map-side aggregates and in joins of written tables, which Spark splits. Single
    strings are compared by two independent hashes of 64 bits, all else by one for the core and the other for the context.
    """
    shortest = unit.length * (2 if unit.words else 1) - unit.words
    texts = _texts(docs, id_column, text_column, unit).where(F.octet_length("text") >= shortest)
    how = {"copies": F.sum, "lo": F.min, "hi": F.max}
    sums = [how[c](c).alias(c) for c in unit.counts]
    first = {"copies": F.lit(1).cast("long"), "lo": F.col("d"), "hi": F.col("d")}
    runs = materialize(texts.mapInArrow(_run_scan(unit), _RUN), "all-runs")
    once = runs.select("core", "context", *(first[c].alias(c) for c in unit.counts))
    cores = once.groupBy("core").agg(*sums, F.min("context").alias("a"), F.max("context").alias("b"))
    cores = materialize(cores.where(unit.repeated).select("core", (F.col("a") != F.col("b")).alias("mixed")), "cores")
    found = materialize(runs.join(cores, "core"), "runs")
    release(runs, cores)

    place = F.min(F.struct("t1", "t2", "start", "n", "back")).alias("at")
    contexts = found.where("mixed").groupBy("core", "context").agg(*(how[c](first[c]).alias(c) for c in unit.counts), place)
    run = F.struct("at.start", "at.n", "at.back", "core", "context", *unit.counts)
    wanted = materialize(contexts.groupBy("at.t1", "at.t2").agg(F.collect_list(run).alias("runs")), "wanted")
    one = materialize(_possible(texts, wanted, "left_semi").select("t1", "t2", "text").dropDuplicates(["t1", "t2"]).join(wanted, ["t1", "t2"]), "texts")
    stretches = materialize(one.select("t1", "t2", "text", "runs").mapInArrow(_stretch_scan(unit), _ddl(_STRETCH, unit)), "stretches")
    release(wanted)
    blocks = stretches.groupBy("block").agg(*sums, F.min("inner").alias("a"), F.max("inner").alias("b"))
    blocks = materialize(blocks.where(unit.repeated).select("block", (F.col("a") != F.col("b")).alias("open")), "blocks")
    listed = materialize(stretches.join(blocks, "block"), "listed")
    release(stretches, blocks)

    inner = listed.where("open").groupBy("block", "inner").agg(*sums, F.min(F.struct("t1", "t2", "start", "n")).alias("at"))
    stretch = F.struct("at.start", "at.n", "block", "inner", *unit.counts)
    wanted = materialize(inner.groupBy("at.t1", "at.t2").agg(F.collect_list(stretch).alias("runs")), "wanted")
    strings = one.select("t1", "t2", "text").join(wanted, ["t1", "t2"]).select("text", "runs").mapInArrow(_string_scan(unit), _ddl(_STRING, unit))
    strings = materialize(strings, "strings")
    release(wanted, one)
    names = materialize(strings.groupBy("a", "b").agg(*sums).where(unit.repeated).select("a", "b"), "names")
    again = strings.join(names, ["a", "b"]).groupBy("block", "inner").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    # numbers in a row as (first, number of them)
    ranges = F.expr(
        "transform(filter(sequence(0, size(ks) - 1), i -> i = 0 OR ks[i] <> ks[i - 1] + 1), "
        "i -> struct(ks[i] AS k, aggregate(slice(ks, i + 1, size(ks)), 0, (c, x) -> IF(x = ks[i] + c, c + 1, c)) AS m))"
    )
    again = materialize(again.select("block", "inner", ranges.alias("ranges")), "ranges")
    release(strings, names)

    rims = listed.where("open").join(again, ["block", "inner"]).select("core", "context", "at", F.inline("ranges"))
    parts = listed.where("NOT open").select("core", "context", "at", F.lit(0).alias("k"), F.col("n").alias("m")).unionByName(rims)
    parts = parts.groupBy("core", "context").agg(F.collect_list(F.struct((F.col("at") + F.col("k")).alias("k"), "m")).alias("parts"))
    parts = materialize(parts, "parts")
    release(listed, again)
    rims = found.where("mixed").join(parts, ["core", "context"]).select("t1", "t2", "start", F.inline("parts"))
    end = F.lit(unit.length - 1)
    rims = rims.select("t1", "t2", (F.col("start") + F.col("k")).alias("start"), (F.col("start") + F.col("k") + F.col("m") + end).alias("end"))
    whole = found.where("NOT mixed").select("t1", "t2", "start", (F.col("start") + F.col("n") + end).alias("end"))
    spans = whole.unionByName(rims).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = materialize(spans, "spans")
    release(found, parts)
    return spans


def passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", unit: Unit = WORDS) -> DataFrame:
    """(t1, t2, n_passages, passage_words): for every different text with ``unit.length`` consecutive words that another row holds
    too, the maximal stretches of such words and how many words they have."""
    spans = repeated_spans(docs, id_column, text_column, unit)
    sums = F.expr(
        "aggregate(array_sort(spans), struct(0L AS n, 0L AS words, 0L AS reach), (x, s) -> struct("
        "x.n + IF(s.start > x.reach OR x.n = 0, 1, 0) AS n, x.words + s.end - LEAST(s.end, GREATEST(s.start, x.reach)) AS words, GREATEST(x.reach, s.end) AS reach))"
    )
    return materialize(spans.select("t1", "t2", sums.alias("s")).select("t1", "t2", F.col("s.n").alias("n_passages"), F.col("s.words").alias("passage_words")), "passages")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, ``kept`` (the bytes that stay), n_passages, passage_words.

    A byte goes if a string of 400 bytes that covers it starts anywhere else, in the same or another text, as judged on
    the input; the first copy goes like all others. Shorter passages stay in the text but are told: n_passages stretches
    of passage_words words in all lie in some 50 consecutive words (lower-cased runs of letters and digits) that another
    row holds too.

    Null texts are empty, shorter texts stay whole, repeated rows are copies of each other (rows with equal ids and texts
    count as one for passages), texts may be of any length, other columns are left aside, an empty table gives an empty
    result. Texts whose hash falls into no share of a text with repeats are not shuffled; there are SHARES shares, so from
    some millions of texts with repeats on all texts are.
    """
    spans = repeated_spans(docs, id_column, text_column)
    listed = passages(docs, id_column, text_column)
    marks = materialize(spans.join(listed, ["t1", "t2"], "full"), "marks")
    release(spans, listed)
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    texts = docs.select(docs[id_column].alias("id"), F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), text.cast("binary").alias("text"))
    none = F.lit(0).cast("long")
    clean = _possible(texts, marks, "left_anti").select(
        "id", F.length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").alias("kept"),
        none.alias("n_passages"), none.alias("passage_words"),
    )
    touched = _possible(texts, marks, "left_semi").join(marks, ["t1", "t2"], "left")
    touched = touched.select("id", "text", "spans", F.coalesce("n_passages", none).alias("n_passages"), F.coalesce("passage_words", none).alias("passage_words"))
    id_type = texts.schema["id"].dataType.simpleString()
    cut = touched.mapInArrow(_kept, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, n_passages long, passage_words long")
    return clean.unionByName(cut).withColumnRenamed("id", id_column)
