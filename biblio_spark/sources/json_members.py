"""Parts of files that Spark's readers take whole: members of one large JSON text, and the first bytes of files.

Files are opened in the tasks through pyarrow, at the places that are asked for. Where pyarrow does not know a file system, callers
take the readers of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from biblio_spark.storage import materialize

#: Bytes of a JSON text that one task scans.
RANGE = 8_000_000
#: Bytes that are read at once where a member goes on after its range.
MORE = 1_000_000

_QUOTE, _SLASH = 0x22, 0x5C


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def readable(uri: str) -> bool:
    """Can tasks open files under this address by themselves?"""
    try:
        _system(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


class _Text:
    """One file, read by places."""

    def __init__(self, uri: str):
        system, path = _system(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, stop: int) -> np.ndarray:
        stop = min(stop, self.size)
        return np.frombuffer(self.file.read_at(stop - start, start), dtype=np.uint8) if stop > start else np.zeros(0, np.uint8)

    def quotes(self, data: np.ndarray, start: int) -> np.ndarray:
        """Where quotes stand in ``data``, which begins at ``start``, that no backslash takes away."""
        found = np.flatnonzero(data == _QUOTE)
        keep = np.ones(len(found), dtype=bool)
        for n in np.flatnonzero((found == 0) | (data[found - 1] == _SLASH)).tolist():
            at, run = int(found[n]), 0
            while at - run > 0 and data[at - run - 1] == _SLASH:
                run += 1
            if run == at:  # the backslashes may have begun before
                place = start - 1
                while place >= 0 and self.read(place, place + 1)[0] == _SLASH:
                    run, place = run + 1, place - 1
            keep[n] = run % 2 == 0
        return found[keep]


def _brackets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, +1 or -1) of all brackets and braces."""
    kind = data & 0xDF  # [ and {, ] and } differ in one bit
    at = np.flatnonzero((kind == 0x5B) | (kind == 0x5D))
    return at, np.where(kind[at] == 0x5B, 1, -1)


def _scan(ranges: DataFrame, field: str) -> DataFrame:
    """Of each range: quotes, and the change of depth if it begins outside or inside a string; ``lists``: places behind ``"field": [`` with
    the depth before the bracket in either case (null where it is inside a string); ``first``: the first byte of the file that is no space."""
    key = f'"{field}"'.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
                text = _Text(path)
                data = text.read(start, stop)
                quotes = text.quotes(data, start)
                at, step = _brackets(data)
                odd = np.searchsorted(quotes, at) % 2
                depth = [np.cumsum(np.where(odd == inside, step, 0)) for inside in (0, 1)]
                lists = []
                opened = at[data[at] == 0x5B]
                # what stands before a bracket: its key, perhaps from the range before
                for place in opened.tolist():
                    low = max(0, start + place - len(key) - 64)
                    before = data[low - start : place] if low >= start else text.read(low, start + place)
                    if before.tobytes().rstrip().removesuffix(b":").rstrip().endswith(key):
                        k = int(np.searchsorted(at, place))
                        lists.append([start + place] + [int(depth[h][k]) - 1 if odd[k] == h else None for h in (0, 1)])
                head = data.tobytes().lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1") if start == 0 else None
                total = [int(d[-1]) if len(d) else 0 for d in depth]
                named = [dict(zip(("at", "outside", "inside"), x, strict=True)) for x in lists]
                yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "stop": stop, "quotes": len(quotes), "outside": total[0], "inside": total[1], "lists": named, "first": head}], schema=schema)

    mark = pa.struct([("at", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())])
    schema = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("start", "stop", "quotes", "outside", "inside")), ("lists", pa.list_(mark)), ("first", pa.string())])
    return ranges.mapInArrow(run, "path string, start long, stop long, quotes long, outside long, inside long, lists array<struct<at long, outside long, inside long>>, first string")


def _members(placed: DataFrame) -> DataFrame:
    """(path, at, text) of the members that begin in each range, read to their ends; text is null where a list of that depth ends. Members
    leave the task some MB at a time."""
    names, kinds = ["path", "at", "text"], (pa.string(), pa.int64(), pa.string())
    made = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], type=t) for k, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                text = _Text(r["path"])
                start, stop = max(r["start"], r["begin"]), r["stop"]
                data = text.read(r["start"], stop)
                opened, out, held = None, [], 0  # where the member begins that is not closed yet
                depth, parity, base = r["depth"], r["parity"], r["start"]
                while len(data):
                    quotes = text.quotes(data, base)
                    at, step = _brackets(data)
                    outside = (np.searchsorted(quotes, at) + parity) % 2 == 0
                    at, step = at[outside], step[outside]
                    after = depth + np.cumsum(step)
                    for place, up, now in zip((at + base).tolist(), step.tolist(), after.tolist(), strict=True):
                        if up == 1 and now == r["level"] + 1 and opened is None and start <= place < stop:
                            opened = place
                        elif up == -1 and now == r["level"] and opened is not None:
                            out.append((r["path"], opened, text.read(opened, place + 1).tobytes().decode("utf-8", "replace")))
                            held += place + 1 - opened
                            opened = None
                            if held >= MORE:
                                yield made(out)
                                out, held = [], 0
                        elif up == -1 and now == r["level"] - 1 and start <= place < stop:
                            out.append((r["path"], place, None))
                        if opened is None and place >= stop:
                            break
                    if opened is None:
                        break
                    depth, parity = int(after[-1]) if len(after) else depth, (parity + len(quotes)) % 2
                    base += len(data)
                    data = text.read(base, base + MORE)
                yield made(out)

    return placed.mapInArrow(run, "path string, at long, text string")


def read_members(spark: SparkSession, path: str, field: str = "", size: int = RANGE) -> DataFrame:
    """(path, at, text): the objects of a list in JSON files, each as text, with its place in the file: the list under ``field`` of the root
    object, or the root itself where it is a list. Any number of tasks read one file.

    A task cannot tell from the middle of a text whether it stands in a string. So each range of ``size`` bytes is scanned for both cases
    first; running sums over the ranges of a file (a row for each) tell the depth and the case in which each begins, and a second
    scan cuts out the members. One that goes on after its range is read to its end by the task in which it begins.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start")
    ranges = files.select("path", "length", starts).select("path", "start", F.least(F.col("start") + size, "length").alias("stop"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    scanned = materialize(_scan(ranges.repartition(parts, "path", "start"), field), "ranges")
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    placed = scanned.withColumn("parity", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int"))
    placed = placed.withColumn("own", F.when(F.col("parity") == 0, F.col("outside")).otherwise(F.col("inside")))
    placed = placed.withColumn("depth", F.coalesce(F.sum("own").over(before), F.lit(0)))
    mark = lambda m: F.when(F.col("parity") == 0, m["outside"]).otherwise(m["inside"]) + F.col("depth")
    found = F.array_min(F.transform(F.filter("lists", lambda m: F.coalesce(mark(m) == 1, F.lit(False))), lambda m: m["at"]))
    whole = W.partitionBy("path")
    root = F.max("first").over(whole) == "["
    placed = placed.withColumns({"root": root, "named": F.min(found).over(whole)})
    placed = placed.withColumn("level", F.when(F.col("root"), 1).otherwise(2)).withColumn("begin", F.when(F.col("root"), F.lit(0)).otherwise(F.col("named")))
    placed = materialize(placed.where("begin IS NOT NULL AND stop > begin").select("path", "start", "stop", "begin", "parity", "depth", "level"), "placed")
    rows = materialize(_members(placed.repartition(parts, "path", "start")), "members")
    ends = rows.where("text IS NULL").groupBy("path").agg(F.min("at").alias("end"))
    return rows.where("text IS NOT NULL").join(ends, "path", "left").where("end IS NULL OR at < end").select("path", "at", "text")


class _Heads(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.bytes, self.parts = options["path"], int(options.get("bytes", 5)), int(options.get("parts", 64))

    def partitions(self) -> list[InputPartition]:
        system, path = _system(self.root)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        scheme = self.root.split(":/", 1)[0] + "://" if ":/" in self.root else ""
        files = sorted((f.path, f.size) for f in found if not f.base_name.startswith((".", "_")))
        return [InputPartition((scheme, files[k :: self.parts])) for k in range(min(self.parts, len(files)))] or [InputPartition((scheme, []))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        scheme, files = partition.value
        system, _ = _system(self.root)
        for path, size in files:
            with system.open_input_file(path) as file:
                yield f"{scheme}{path}", size, bytes(file.read(self.bytes))


class FileHeads(DataSource):
    """``spark.read.format("file_heads").option("bytes", 5).load(path)``: path, size and first bytes of all files under a path, nothing more of
    them read."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, size long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _Heads(dict(self.options))


def read_heads(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("bytes", n).load(path)
