"""Benchmark decontamination by a generalised suffix automaton of normalised test items."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblio_spark.llm.bytescan import LOWER, WORD, chunks, flat, free_prefix, offsets_in_characters, word_bounds
from biblio_spark.storage import materialize, release

#: Words of a window; an item with fewer is one window.
WINDOW = 13
#: Words of items in one automaton (about 60 MB in Python), and automata that a pass over the documents holds at once.
MAX_WORDS, MACHINES = 100_000, 4
#: A document is contaminated if it has hits on at least one word in COVERAGE.
COVERAGE = 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 200_000


def split_words(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    if not text:
        return []
    data, offsets = flat(pa.array([text], type=pa.string()))
    starts, ends, _ = word_bounds(data, offsets)
    raw = LOWER[data].tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _BASE, np.uint64)]))[:n]


def word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray = WORD) -> np.ndarray:
    """A 64-bit hash of every word, a slice of words at a time; ``inside`` tells which bytes belong to words."""
    out = np.empty(len(starts), dtype=np.uint64)
    for i in range(0, len(starts), _SLICE):
        s, e = starts[i : i + _SLICE], ends[i : i + _SLICE]
        size = e - s
        lo = int(s[0])
        index = np.flatnonzero(inside[lowered[lo : int(e[-1])]])
        within = np.arange(len(index)) - np.repeat(np.cumsum(size) - size, size)
        product = (lowered[lo + index].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[within]
        out[i : i + _SLICE] = np.add.reduceat(product, np.cumsum(size) - size)
    return out


class SuffixAutomaton:
    """Of the word sequences of all items. States as parallel lists: transitions, suffix link, longest length."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        kept = []
        for item, words in items:
            if words:
                kept.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, word_ids in kept:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        order = sorted(range(1, len(self.go)), key=self.length.__getitem__)
        #: the state of the last ``window`` words of what a state matches, if it matches as many
        self.of_window = [-1] * len(self.go)
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.of_window[v] = self.of_window[up] if self.length[up] >= window else v
        self.items: dict[int, set] = {}
        whole: dict[int, list] = {}
        for item, word_ids in kept:
            v = 0
            for k, c in enumerate(word_ids):
                v = self.go[v][c]
                if k + 1 >= window:
                    self.items.setdefault(self.of_window[v], set()).add(item)
            if len(word_ids) < window:
                whole.setdefault(v, []).append(item)
        #: whole short items that end where a state ends: (length, items), down the suffix links
        self.short: list[tuple] = [()] * len(self.go)
        for v in order:
            own = ((self.length[v], tuple(whole[v])),) if v in whole else ()
            self.short[v] = self.short[self.link[v]] + own
        self.least = min([window, *(len(w) for _, w in kept)]) if kept else 0

    def _extend(self, last: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        if c in go[last]:
            q = go[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p != -1:
            q = go[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        go, link, length = self.go, self.link, self.length
        copy = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and go[p].get(c) == q:
            go[p][c] = copy
            p = link[p]
        return copy

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(word spans of occurring windows, merged; their items) of a word sequence, by longest matching lengths."""
        go, link, length = self.go, self.link, self.length
        spans: list[list[int]] = []
        items: set = set()
        v = matched = 0
        for i, word in enumerate(words):
            c = self.vocabulary.get(word, -1)
            while v and c not in go[v]:
                v = link[v]
                matched = length[v]
            if c not in go[v]:
                v = matched = 0
                continue
            v = go[v][c]
            matched += 1
            start = i + 1
            if matched >= self.window:
                start = i + 1 - self.window
                items |= self.items[self.of_window[v]]
            for size, whole in self.short[v]:
                if matched >= size:
                    start = min(start, i + 1 - size)
                    items.update(whole)
            if start <= i:
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [tuple(s) for s in spans], items


def _shards(items: DataFrame, id_column: str, text_column: str, window: int, max_words: int) -> Iterator[list]:
    """Items in lists of at most ``max_words`` words, one list in the driver at a time; a longer item is cut into parts
    that share window - 1 words, so no window is lost."""
    shard, size = [], 0
    for row in items.select(id_column, text_column).toLocalIterator():
        words = split_words(row[1])
        step = max(1, max_words - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + max_words]
            if shard and size + len(part) > max_words:
                yield shard
                shard, size = [], 0
            shard.append((row[0], part))
            size += len(part)
    yield shard


def _merge(spans: list[tuple]) -> list[tuple]:
    out: list[list] = []
    for first, end, start, stop in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], end), max(out[-1][3], stop)
        else:
            out.append([first, end, start, stop])
    return [tuple(s) for s in out]


_SPAN = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "start", "end")]))
_SPAN_DDL = "array<struct<first_word: long, end_word: long, start: long, end: long>>"


#: Automata of this Python worker by the place of their items, those of the last pass.
_MACHINES: dict[tuple, SuffixAutomaton] = {}


def _machines(label: str, shards: list[list], window: int) -> list[tuple[SuffixAutomaton, np.ndarray]]:
    """The automata of a pass with the sorted hashes of their words; each worker builds them once."""
    keys = [(label, k) for k in range(len(shards))]
    if any(key not in _MACHINES for key in keys):
        _MACHINES.clear()
        for key, shard in zip(keys, shards, strict=True):
            machine = SuffixAutomaton(shard, window)
            known = np.zeros(0, np.uint64)
            if machine.vocabulary:
                data, offsets = flat(pa.array(list(machine.vocabulary), type=pa.binary()))
                known = np.sort(word_hashes(data, offsets[:-1], offsets[1:]))
            _MACHINES[key] = machine, known
    return [_MACHINES[key] for key in keys]


def _found(machines: list, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list], list[set]]:
    """(words before each text, merged spans of each, items of each) of consecutive texts."""
    rows = len(offsets) - 1
    starts, ends, before = word_bounds(data, offsets)
    spans: list[list] = [[] for _ in range(rows)]
    items: list[set] = [set() for _ in range(rows)]
    if not len(starts):
        return before, spans, items
    lowered = LOWER[data]
    hashes = word_hashes(lowered, starts, ends)
    cut = np.zeros(len(starts) + 1, dtype=bool)
    cut[before] = True
    for machine, known in machines:
        if not len(known):
            continue
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        inside = known[at] == hashes
        # runs of known words that are long enough, cut at the ends of texts
        begin = np.flatnonzero(inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]])))
        finish = np.flatnonzero(inside & (cut[1:] | np.concatenate([~inside[1:], [True]]))) + 1
        long = finish - begin >= machine.least
        for a, b in zip(begin[long].tolist(), finish[long].tolist(), strict=True):
            found, of = machine.stream([lowered[starts[i] : ends[i]].tobytes() for i in range(a, b)])
            if found:
                k = int(np.searchsorted(before, a, side="right")) - 1
                items[k] |= of
                low = offsets[k]
                bounds = np.array([[starts[a + s] - low, ends[a + e - 1] - low] for s, e in found]).ravel()
                places = offsets_in_characters(data[low : offsets[k + 1]], bounds).tolist()
                first = int(before[k])
                spans[k] += [(a + s - first, a + e - first, places[2 * n], places[2 * n + 1]) for n, (s, e) in enumerate(found)]
    return before, [_merge(s) for s in spans], items


def _by_text(items: set) -> list:
    return sorted(items, key=lambda v: (v is None, str(v)))


def _structs(spans: list[list]) -> pa.Array:
    names = ("first_word", "end_word", "start", "end")
    return pa.array([[dict(zip(names, s, strict=True)) for s in x] for x in spans], type=_SPAN)


def _marked(docs: DataFrame, items: DataFrame, id_column: str, text_column: str, item_id: str, item_text: str, window: int, max_words: int) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_hit, items and spans after them, each under ``free_prefix`` of its columns."""
    spark = docs.sparkSession
    own = free_prefix(*docs.columns)
    kind, ddl = (pa.string(), "string") if items.schema[item_id].dataType.simpleString() == "string" else (pa.int64(), "long")
    names = docs.columns
    at = names.index(text_column)
    label = uuid.uuid4().hex
    extra = f"{own}n_words long, {own}n_hit long, {own}items array<{ddl}>, {own}spans {_SPAN_DDL}"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + extra

    def matcher(shards, tag: str):
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines = _machines(tag, shards.value, window)
            for batch in batches:
                texts = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], names=["text"])
                for first, end, data, offsets in chunks(texts, "text"):
                    before, spans, of = _found(machines, data, offsets)
                    found = [
                        pa.array(np.diff(before)),
                        pa.array([sum(e - s for s, e, _, _ in x) for x in spans], type=pa.int64()),
                        pa.array([_by_text(x) for x in of], type=pa.list_(kind)),
                        _structs(spans),
                    ]
                    columns = [c.slice(first, end - first) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*columns, *found], names=[*names, f"{own}n_words", f"{own}n_hit", f"{own}items", f"{own}spans"])

        return match

    wanted = items.select(items[item_id].cast(ddl).alias(item_id), item_text)
    groups = _groups(_shards(wanted, item_id, item_text, window, max_words), MACHINES)
    first = next(groups)
    second = next(groups, None)
    if second is None:
        return docs.mapInArrow(matcher(spark.sparkContext.broadcast(first), label), schema)

    # several passes: only rows with hits are written, and joined by id and text
    key = [F.xxhash64(F.col(f"`{text_column}`").cast("string")).alias(f"{own}k1"), F.md5(F.col(f"`{text_column}`").cast("string").cast("binary")).alias(f"{own}k2")]
    hits = []
    for n, group in enumerate(chain([first, second], groups)):
        shards = spark.sparkContext.broadcast(group)
        marked = docs.mapInArrow(matcher(shards, f"{label}-{n}"), schema).where(f"{own}n_hit > 0")
        hits.append(materialize(marked.select(F.col(f"`{id_column}`").alias(f"{own}id"), *key, f"{own}items", f"{own}spans").distinct(), "hits"))
        shards.unpersist()
    found = reduce(DataFrame.unionByName, hits).groupBy(f"{own}id", f"{own}k1", f"{own}k2").agg(F.flatten(F.collect_list(f"{own}items")).alias("i"), F.flatten(F.collect_list(f"{own}spans")).alias("s"))
    id_type = docs.schema[id_column].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merge([(s["first_word"], s["end_word"], s["start"], s["end"]) for s in x]) for x in batch.column("s").to_pylist()]
            of = [_by_text(set(x)) for x in batch.column("i").to_pylist()]
            counts = pa.array([sum(s[1] - s[0] for s in x) for x in spans], type=pa.int64())
            columns = [*(batch.column(c) for c in (f"{own}id", f"{own}k1", f"{own}k2")), counts, pa.array(of, type=pa.list_(kind)), _structs(spans)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"{own}id", f"{own}k1", f"{own}k2", f"{own}n_hit", f"{own}items", f"{own}spans"])

    found = materialize(found.mapInArrow(merge, f"{own}id {id_type}, {own}k1 long, {own}k2 string, {own}n_hit long, {own}items array<{ddl}>, {own}spans {_SPAN_DDL}"), "hits")
    release(*hits)
    nothing = spark.sparkContext.broadcast([[]])
    counted = docs.mapInArrow(matcher(nothing, f"{label}-none"), schema).drop(f"{own}n_hit", f"{own}items", f"{own}spans").withColumns({f"{own}k1": key[0], f"{own}k2": key[1]})
    same = counted[f"`{id_column}`"].eqNullSafe(found[f"{own}id"]) & counted[f"{own}k1"].eqNullSafe(found[f"{own}k1"]) & counted[f"{own}k2"].eqNullSafe(found[f"{own}k2"])
    out = counted.join(found, same, "left")
    none = {f"{own}n_hit": F.coalesce(f"{own}n_hit", F.lit(0).cast("long")), f"{own}items": F.coalesce(f"{own}items", F.array().cast(f"array<{ddl}>")), f"{own}spans": F.coalesce(f"{own}spans", F.array().cast(_SPAN_DDL))}
    return out.select(*(counted[f"`{n}`"] for n in names), f"{own}n_words", *(v.alias(k) for k, v in none.items()))


def _groups(shards: Iterator[list], size: int) -> Iterator[list]:
    while group := list(islice(shards, size)):
        yield group


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items, spans.

    The words of both sides are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is
    ``window`` consecutive words of an item; an item with fewer, but some, is one window. A suffix automaton of the
    items reads each document; where the longest match reaches a window, its words are hit. ``spans`` are the merged
    hits, in words and in code points; ``items`` the ids of items with an occurring window, sorted as strings.

    Null texts have no words, items without words never match, repeated ids count as one item, an empty item table
    hits nothing, and other columns of ``docs`` are left aside. Up to MACHINES automata of ``max_words`` words are built in
    the tasks and read each document in one pass without a shuffle; a larger benchmark takes a pass for each so many, of
    which only rows with hits are written and then joined. Items go through the driver, so much of them at a time.
    """
    source = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    found = _marked(source, items, "id", "text", item_id, item_text, window, max_words)
    return found.select(F.col("id").alias(id_column), *(F.col(f"_{c}").alias(c) for c in ("n_words", "n_hit", "items", "spans")))


def is_contaminated(coverage: int = COVERAGE, prefix: str = ""):
    """Hits on at least one word in ``coverage``."""
    hit, words = F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words")
    return (hit > 0) & (coverage * hit >= words)


def keep_clean(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, texts and all columns as they are. Each row is judged by its own text, with or
    without an id and whether its id is repeated or not; null and empty texts stay."""
    found = _marked(docs, items, id_column, text_column, "item_id", "text", WINDOW, MAX_WORDS)
    return found.where(~is_contaminated(prefix=free_prefix(*docs.columns))).select(*(F.col(f"`{n}`") for n in docs.columns))


def remove_contamination(
    docs: DataFrame, items: DataFrame, least_words: int = WINDOW, coverage: float = 0.0, mark: str = "", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``docs`` with the contaminated spans of ``text_column`` replaced by ``mark``; all other columns and rows as they are.

    A merged span goes if it has at least ``least_words`` words, the limit of length, and if all hits of its text are at least
    the share ``coverage`` of its words, the limit of coverage. Null texts stay null.
    """
    found = _marked(docs, items, id_column, text_column, "item_id", "text", WINDOW, MAX_WORDS)
    text, own = F.col(f"`{text_column}`").cast("string"), free_prefix(*docs.columns)
    long = F.filter(f"{own}spans", lambda s: s["end_word"] - s["first_word"] >= least_words)
    # what stays lies between the end of a span and the start of the next
    left = F.concat(F.array(F.lit(0).cast("long")), F.transform(long, lambda s: s["end"]))
    right = F.concat(F.transform(long, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.transform(F.arrays_zip(left.alias("a"), right.alias("b")), lambda p: F.substring(text, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    cut = (F.size(long) > 0) & (F.col(f"{own}n_hit") >= coverage * F.col(f"{own}n_words"))
    new = F.when(cut, F.array_join(kept, mark)).otherwise(text)
    return found.select(*((new if n == text_column else F.col(f"`{n}`")).alias(n) for n in docs.columns))
