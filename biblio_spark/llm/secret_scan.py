"""Secret scan: fixed patterns plus sliding-window Shannon entropy of candidate strings, with an allow-list."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from biblio_spark.llm.bytescan import texts_of

#: The base patterns in the order in which kinds are listed, and least lengths of what is kept.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

#: Texts without one of these, in lower case, cannot match ASSIGN.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: The same matches as HEX with LEAST_HEX, found faster: both take maximal runs.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

#: Candidate strings of the entropy scan, as maximal runs.
LEAST_CANDIDATE = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: Character classes from the narrowest: name, members, least bits a character in a window.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+\Z"), 2.9),
    ("alnum", re.compile(r"[0-9A-Za-z]+\Z"), 3.6),
    ("base64", re.compile(r"[0-9A-Za-z+/_=-]+\Z"), 3.8),
)
WINDOW = 20

#: Suppressed candidates: plain words and word lists, numbers, paths, identifiers of public things, rulers.
ALLOW = (
    re.compile(r"(?:[A-Z]*[a-z]{2,})+[A-Z]*\Z|[A-Z]+\Z"),
    re.compile(r"[A-Z]?[a-z]+(?:[-_/=+][A-Z]?[a-z]+)*\Z"),
    re.compile(r"[0-9]+(?:[-_/=+][0-9]+)*\Z"),
    re.compile(r"(?:/?[A-Za-z_-]{1,15}[0-9]{0,4}/)+[A-Za-z_-]*[0-9]{0,4}\Z"),
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z"),
    re.compile(r"(.)\1+\Z"),
)
#: Words that mark the part of a candidate in which they stand as made up; parts end at these signs.
MARKERS = re.compile(r"example|sample|dummy|placeholder|xxxx", re.IGNORECASE)
PART = re.compile(r"[^=/]+")


def entropy_span(text: str, window: int, least: float) -> tuple[int, int] | None:
    """The smallest span that holds every window of ``window`` characters with at least ``least`` bits a character.

    Counts move with the window: one character in, one out, and the sum of c * log2(c) is corrected for these two.
    """
    size = min(window, len(text))
    logs = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    counts: dict[str, int] = {}
    total, first, last = 0.0, None, None
    for i, char in enumerate(text):
        c = counts.get(char, 0)
        total += logs[min(c + 1, size)] - logs[c] if c < size else 0.0
        counts[char] = c + 1
        if i >= size:
            old = text[i - size]
            c = counts[old]
            total += logs[c - 1] - logs[min(c, size)]
            counts[old] = c - 1
        if i >= size - 1 and math.log2(size) - total / size >= least:
            first = i - size + 1 if first is None else first
            last = i + 1
    return None if first is None else (first, last)


def candidate_spans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of high entropy in the candidates that no rule allows; a part with a marker word parts the candidate."""
    for match in CANDIDATE.finditer(text):
        run = match.group(0)
        pieces, at = [], 0
        if MARKERS.search(run):
            for part in PART.finditer(run):
                if MARKERS.search(part.group(0)):
                    pieces.append((at, part.start()))
                    at = part.end()
        pieces.append((at, len(run)))
        for a, b in pieces:
            word = run[a:b]
            word, a = word.lstrip("=/"), a + len(word) - len(word.lstrip("=/")) if at else a
            word = word.rstrip("=-_/+") or word
            if len(word) < LEAST_CANDIDATE or any(rule.match(word) for rule in ALLOW):
                continue
            for _, members, least in CLASSES:
                if members.match(word):
                    if span := entropy_span(word, WINDOW, least):
                        yield match.start() + a + span[0], match.start() + a + span[1]
                    break


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed. Base kinds are leftmost, non-overlapping per kind; entropy spans are
    found by themselves and may overlap base spans, which confirms them."""
    found: list[tuple[int, int, int]] = []
    lowered = text.lower()
    if any(hint in lowered for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    found += [(start, 3, end) for start, end in candidate_spans(text)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, an array of (kind, start, end) in code points, end exclusive.

    Kinds: assign, access, hex (fixed patterns) and entropy (windows of WINDOW characters in a candidate string whose
    Shannon entropy reaches the limit of its character class; allow-listed strings are left out). A null text is empty; texts
    of any length are scanned whole; repeated rows give repeated results; an empty table gives an empty one; other columns are
    left aside. No shuffle.
    """
    source = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(text.as_py())] for text in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, type=SPANS)], names=["id", "spans"])

    id_type = source.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, spans array<struct<kind: string, start: long, end: long>>"
    return source.mapInArrow(scan, schema).withColumnRenamed("id", id_column)


def redact_secrets(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text_column`` replaced by ``mark``; overlapping spans become one mark. Null
    texts stay null, texts without secrets and all other columns stay as they are."""
    names = docs.columns

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            out = []
            for value in batch.column(at):
                text = value.as_py()
                spans = find_secrets(text) if text else []
                parts, done = [], 0
                for _, start, end in spans:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                out.append("".join([*parts, text[done:]]) if spans else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, type=pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(redact, docs.schema)
