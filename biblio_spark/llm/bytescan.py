"""Whole texts as flat UTF-8 bytes: numpy views of Arrow columns and vectorised word boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 2_000_000

#: A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, all beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True


def free_prefix(*names: str) -> str:
    """Underscores with which none of the names begins: columns of an operator's own under it never meet those of the caller."""
    prefix = "_"
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


def texts_of(column: pa.Array) -> pa.Array:
    """The column as strings; null is the empty text."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array without nulls."""
    wide = pa.types.is_large_string(texts.type)
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32) if len(texts) else np.zeros(1, np.int64)
    offsets = raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else raw
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most ``limit`` bytes, a longer row alone."""
    data, offsets = flat(texts_of(batch.column(column)))
    first, rows = 0, batch.num_rows
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words in ``data``: first[i] is the number of words before text i; a word never
    runs from one text into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = WORD[data]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = mask[edges]
    finish = mask.copy()
    finish[:-1] &= ~mask[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    finish[lasts] = mask[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, words before each text) of every text as `` word word word `` in lower case (one space before,
    between and after; a text without words is one space)."""
    starts, ends, first = word_bounds(data, offsets)
    sizes = ends - starts
    counts = np.diff(first)
    # each word brings its leading space; one more space closes each text
    word_out = np.concatenate([[0], np.cumsum(sizes + 1)])
    text_out = word_out[first] + np.arange(len(first))
    out = np.full(int(text_out[-1]), 0x20, dtype=np.uint8)
    if len(starts):
        shift = np.repeat(word_out[:-1] + 1 + np.repeat(np.arange(len(counts)), counts) - starts, sizes)
        mask = WORD[data]
        source = np.flatnonzero(mask)
        out[source + shift] = LOWER[data[source]]
    return out, text_out, first


def offsets_in_characters(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Byte positions within one text as code point positions."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return starts[positions]
