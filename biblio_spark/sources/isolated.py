"""Sources read each by itself, so that one that fails while it is read, or a broken file, does not end the run."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblio_spark.storage import materialize

#: Sources that are read at the same time.
AT_ONCE = 4

Read = Callable[[list[str]], DataFrame]


def _text(error: Exception) -> str:
    """What a failure says first, with its deepest cause where Spark names one."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    causes = [x for x in lines if x.startswith("Caused by:")]
    return " ".join([*lines[:1], *causes[-1:]])[:500]


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files under a path: names only, contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return sorted(r["path"] for r in listed.collect())


def _sound(read: Read, name: str, files: list[str]) -> tuple[list[DataFrame], list[tuple[str, str]]]:
    """(written parts, (file, error) of those that cannot be read): files are read together, and in halves where that fails, so few bad
    files among n take some log n jobs each."""
    try:
        return [materialize(read(files), f"{name}-rows")], []
    except Exception as error:
        if len(files) == 1:
            return [], [(files[0], _text(error))]
    parts, bad = [], []
    for half in (files[: len(files) // 2], files[len(files) // 2 :]):
        more, worse = _sound(read, name, half)
        parts += more
        bad += worse
    return parts, bad


def _read_one(spark: SparkSession, name: str, path: str, read: Read) -> tuple[list[DataFrame], list[tuple[str, str]], str | None]:
    """(written parts, bad files, error that ended the source)."""
    try:
        return [materialize(read([path]), f"{name}-rows")], [], None
    except Exception as error:
        whole = _text(error)
    try:
        parts, bad = _sound(read, name, _files(spark, path))
    except Exception as error:
        return [], [], _text(error)
    return parts, bad, None if parts else whole


def read_isolated(spark: SparkSession, sources: dict[str, tuple[str, Read]]) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(rows of all sources that can be read, state, quarantine) for sources by name as (path, reader of a list of paths).

    Each source is read and written by a job of its own, some at the same time, so its failures show while it is read and not later. Where
    it fails, its files are halved until the broken ones stand alone; the others are kept. Rows have a column ``source_name``.

    state: (source_name, ok, records, bad_files, error), a row for each source; error is what ended one of which nothing could be read.
    quarantine: (source_name, file, error). Sources of nothing but broken files, or without any, have no records.
    """
    names = list(sources)
    with ThreadPoolExecutor(max_workers=max(1, min(AT_ONCE, len(names)))) as pool:
        found = dict(zip(names, pool.map(lambda n: _read_one(spark, n, *sources[n]), names), strict=True))
    rows, state, bad_rows = None, [], []
    for name, (parts, bad, error) in found.items():
        records = 0
        for part in parts:
            records += part.count()
            named = part.withColumn("source_name", F.lit(name))
            rows = named if rows is None else rows.unionByName(named, allowMissingColumns=True)
        state.append((name, error is None, records, len(bad), error))
        bad_rows += [(name, file, text) for file, text in bad]
    return (
        rows,
        spark.createDataFrame(state, "source_name string, ok boolean, records long, bad_files long, error string"),
        spark.createDataFrame(bad_rows, "source_name string, file string, error string"),
    )
