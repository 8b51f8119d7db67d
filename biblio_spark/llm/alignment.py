"""Two tokenizers on the same bytes: each distinct text is tokenised and aligned once, pairs of ids are counted over the corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblio_spark.llm.bytescan import chunks, flat
from biblio_spark.llm.tokenizing import WordEncoder
from biblio_spark.storage import materialize, release

#: Bytes of texts that are aligned together and share one list of pairs; a longer text is aligned alone.
BLOCK_BYTES = 2_000_000
#: Pieces that each tokenizer of a worker remembers.
REMEMBERED = 1 << 19
#: U+2581, which stands for a space in the pieces.
SPACE_PIECE = "▁"
_MARK = SPACE_PIECE.encode()


class _Spelling:
    """The bytes of every id of a vocabulary, and its decimal number before each separator of the group strings."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        #: "id,", "id|" and "id;" in turn
        self.names = [f"{k}{end}" for end in ",|;" for k in range(len(tokens))]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        return self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[ids] - (ends - size), size)]


def _byte_level() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, reversed: printable Latin characters stand for
    themselves, all other bytes for those from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class PieceEncoder(WordEncoder):
    """ids of texts, each with the space before it that the model adds by itself, by a sentencepiece model.

    Where no piece of the vocabulary has a space after another character, no token crosses such a place, so the stretches from there
    to the next are encoded by themselves, each different one once while it is remembered. Other models, and such as change white space,
    take whole texts.
    """

    def __init__(self, path: str, limit: int = REMEMBERED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        self.lone = self.model.piece_to_id(SPACE_PIECE)
        kept = "  a   b "
        self.by_words = (
            not any(re.search(f"[^{SPACE_PIECE}]{SPACE_PIECE}", p) for p in self.pieces)
            and self.model.id_to_piece(self.lone) == SPACE_PIECE and "".join(self.model.encode(kept, out_type=str)) == f" {kept}".replace(" ", SPACE_PIECE)
        )
        self._forget(limit)

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = data == 0x20
        start[1:] &= data[:-1] != 0x20
        # the mark itself in a text is a space to the model: no stretch begins right after it
        start[3:] &= ~((data[:-3] == _MARK[0]) & (data[1:-2] == _MARK[1]) & (data[2:-1] == _MARK[2]))
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        return starts, np.zeros(len(starts), dtype=bool)

    def _library(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Each piece begins with the space that the model adds."""
        texts = [p[1:].decode("utf-8", "replace") for p in pieces]
        found = self.model.encode(texts, num_threads=1) if texts else []
        return [np.array(ids if t or not p else [self.lone], dtype=np.uint32) for ids, t, p in zip(found, texts, pieces, strict=True)]

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = self._library(pieces)
        count = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return np.concatenate(each), np.cumsum(count) - count, count


class Aligner:
    """Both tokenizers of a Python worker: ``a`` a byte-level BPE file of the tokenizers library, ``b`` a sentencepiece model."""

    def __init__(self, a: str, b: str):
        self.a, self.b = WordEncoder(a, REMEMBERED, plain=True), PieceEncoder(b)
        vocabulary = self.a.tokenizer.get_vocab()
        byte_of = _byte_level()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            tokens[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.spell_a = _Spelling(tokens)
        is_byte = self.b.model.is_byte
        self.spell_b = _Spelling([bytes([int(p[3:5], 16)]) if is_byte(k) else p.replace(SPACE_PIECE, " ").encode() for k, p in enumerate(self.b.pieces)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """(ids of a, n + 1 offsets in them, the same of b) of n texts in ``data``, each with the space before it."""
        (ids_a, at_a), (ids_b, at_b) = self.a.encode_flat(data, offsets), self.b.encode_flat(data, offsets)
        return ids_a.astype(np.int64), at_a, ids_b.astype(np.int64), at_b


def _spelled(spelling: _Spelling, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: do its ids spell its bytes?"""
    before = np.concatenate([[0], np.cumsum(spelling.sizes[ids])])[at]
    right = np.diff(before) == np.diff(offsets)
    for k in np.flatnonzero(right & (np.diff(offsets) > 0)) if not right.all() else ():
        right[k] = np.array_equal(spelling.joined(ids[at[k] : at[k + 1]]), data[offsets[k] : offsets[k + 1]])
    if right.all() and len(data):
        wrong = np.flatnonzero(spelling.joined(ids) != data)
        right[np.searchsorted(offsets, wrong, side="right") - 1] = False
    return right


def _kept(ids: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts to keep; the others have none."""
    size = np.where(keep, np.diff(at), 0)
    return ids[np.repeat(keep, np.diff(at))], np.concatenate([[0], np.cumsum(size)])


def _group_strings(aligner: Aligner, ids_a, ends_a, text_a, ids_b, ends_b, text_b, texts: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text: groups end where both tokens end."""
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)]
    last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
    many_a, many_b = len(aligner.spell_a.sizes), len(aligner.spell_b.sizes)
    code = np.concatenate([ids_a + np.where(last_a, many_a, 0), ids_b + np.where(last_b, 2 * many_b, 0) + 3 * many_a])
    # a's tokens of a group before b's, in their order
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    names = aligner.spell_a.names + aligner.spell_b.names
    cuts = np.searchsorted(np.concatenate([text_a, text_b])[order], np.arange(texts + 1)).tolist()
    words = [names[k] for k in code[order].tolist()]
    return ["".join(words[s:e])[:-1] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def align_block(aligner: Aligner, data: np.ndarray, offsets: np.ndarray, copies: np.ndarray) -> tuple[dict, dict, dict]:
    """(measures of each text, (a, b, count) of each different pair of ids, links) of texts that follow each other in ``data``, each
    with a space before it. ``count`` adds ``copies`` of the texts that hold the pair. ``links``: of each text its different pairs, by
    number, and how often it has each."""
    texts = len(offsets) - 1
    ids_a, at_a, ids_b, at_b = aligner.encode(data, offsets)
    keep = (np.diff(offsets) > 1) & _spelled(aligner.spell_a, ids_a, at_a, data, offsets) & _spelled(aligner.spell_b, ids_b, at_b, data, offsets)
    ids_a, at_a = _kept(ids_a, at_a, keep)
    ids_b, at_b = _kept(ids_b, at_b, keep)
    text_a, text_b = np.repeat(np.arange(texts), np.diff(at_a)), np.repeat(np.arange(texts), np.diff(at_b))
    ends_a, ends_b = np.cumsum(aligner.spell_a.sizes[ids_a]), np.cumsum(aligner.spell_b.sizes[ids_b])
    # one link for each stretch between ends: it lies in one token of either side, and two tokens share at most one
    cuts = np.union1d(ends_a, ends_b)
    in_a, in_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    n_links = np.bincount(text_a[in_a], minlength=texts)
    n_a, n_b = np.diff(at_a), np.diff(at_b)
    strings = _group_strings(aligner, ids_a, ends_a, text_a, ids_b, ends_b, text_b, texts)
    measures = {
        "n_a": n_a, "n_b": n_b, "n_groups": n_a + n_b - n_links, "n_links": n_links,
        "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if k else "" for s, k in zip(strings, keep.tolist(), strict=True)],
    }
    pair = ids_a[in_a] << 32 | ids_b[in_b]
    different, number = np.unique(pair, return_inverse=True)
    held, times = np.unique(text_a[in_a] * max(len(different), 1) + number, return_counts=True)
    text, number = held // max(len(different), 1), held % max(len(different), 1)
    count = np.zeros(len(different), dtype=np.int64)
    np.add.at(count, number, copies[text])
    links = {"first": np.searchsorted(text, np.arange(texts + 1)), "number": number.astype(np.int32), "times": times.astype(np.int32)}
    return measures, {"a": different >> 32, "b": different & 0xFFFFFFFF, "count": count}, links


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """The aligner of this Python worker; it outlives single tasks."""
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


_MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BLOCKS = f"block string, texts array<struct<digest string, {_MEASURES}>>, pairs array<struct<a int, b int, count long>>, first array<int>, number array<int>, times array<int>"


def _blocks(distinct: DataFrame, a: str, b: str, block_bytes: int) -> DataFrame:
    """Blocks of texts (digest, text, copies): their measures, pairs and links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        block = 0
        for batch in batches:
            for first, end, data, offsets in chunks(batch, "text", block_bytes):
                copies = batch.column("copies").slice(first, end - first).to_numpy()
                measures, pairs, links = align_block(both, data, offsets, copies)
                names = ["digest", *measures]
                texts = pa.StructArray.from_arrays([batch.column("digest").slice(first, end - first), *map(pa.array, measures.values())], names=names)
                found = pa.StructArray.from_arrays([pa.array(pairs["a"].astype(np.int32)), pa.array(pairs["b"].astype(np.int32)), pa.array(pairs["count"])], names=["a", "b", "count"])
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                arrays = [one(x) for x in (texts, found, *(pa.array(links[k].astype(np.int32)) for k in ("first", "number", "times")))]
                name = pa.array([f"{TaskContext.get().partitionId()}-{block}"])
                yield pa.RecordBatch.from_arrays([name, *arrays], names=["block", "texts", "pairs", "first", "number", "times"])
                block += 1

    return distinct.select("digest", F.concat(F.lit(" "), "text").alias("text"), "copies").mapInArrow(run, _BLOCKS)


def _measured(blocks: DataFrame) -> DataFrame:
    """(digest, measures, n_best, count_sum) of every text of blocks with ``known``: (place of the pair, count, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                texts = batch.column("texts")[k].values
                first, number, times = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in ("first", "number", "times"))
                known = batch.column("known")[k]
                count, best = np.zeros(len(number) + 1, dtype=np.int64), np.zeros(len(number) + 1, dtype=np.int64)
                if known.is_valid and len(known):
                    place, counts, bests = (x.to_numpy(zero_copy_only=False) for x in known.values.flatten())
                    count[place], best[place] = counts, bests
                total = [np.concatenate([[0], np.cumsum(times * values[number])]) for values in (best, count)]
                own = texts.flatten()
                columns = [*own, *(pa.array(t[first[1:]] - t[first[:-1]]) for t in total)]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", *[f.name for f in texts.type][1:], "n_best", "count_sum"])

    return blocks.mapInArrow(run, f"digest string, {_MEASURES}, n_best long, count_sum long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents an A token with id ``a`` and a B token with id ``b`` share a byte, and whether no other
    pair of ``a`` has more. Each block sends its different pairs once."""
    each = blocks.select(F.explode("pairs").alias("p")).select("p.*")
    counted = materialize(each.groupBy("a", "b").agg(F.sum("count").alias("count")), "counted")
    top = counted.groupBy("a").agg(F.max("count").alias("top"))
    return counted.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, a: str | None = None, b: str | None = None, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(measures of every row of ``docs``, pair counts over the corpus) for the tokenizers ``a`` (byte-level BPE file) and ``b``
    (sentencepiece model).

    Measures: the id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the commonest of its A id, ties included), count_sum
    (counts of the pairs of all links), groups_sha256. Texts that are null, empty or not spelled byte by byte by either
    tokenizer have no tokens: zeros and ''. Null ids stay, every row gives a row and counts as a document; other columns are left
    aside; an empty table gives empty tables.

    Rows are grouped by their full text, with the number of copies taken before the shuffle, so a text that a third of the rows
    have is one row. Each distinct text is tokenised and aligned once, in blocks; a block's different pairs, not its links, are counted
    with the weight of their copies and looked up again, so neither frequent pairs nor the table of pairs weigh on one task or on
    the driver. Digests lead from the distinct texts back to the rows.
    """
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    text = docs[text_column].cast("string")
    rows = docs.select(docs[id_column].alias("id"), F.when(text != "", text).alias("text"))
    distinct = rows.where(F.col("text").isNotNull()).groupBy("text").agg(F.count("*").alias("copies"))
    distinct = distinct.select(F.sha2("text", 256).alias("digest"), "text", "copies")
    blocks = materialize(_blocks(distinct, a, b, block_bytes), "blocks")
    pairs = materialize(pair_counts(blocks), "pairs")
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "p")).select("block", "place", "p.a", "p.b")
    known = asked.join(pairs, ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("place", "count", F.col("best").cast("int").alias("best"))).alias("known"))
    texts = materialize(_measured(blocks.drop("pairs").join(known, "block", "left")), "measured")
    release(blocks)
    # written, so that the join has exchanges of its own, which Spark splits where one text has very many rows
    keyed = materialize(rows.select("id", F.sha2("text", 256).alias("digest")), "keyed")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    out = keyed.join(texts, "digest", "left").select(F.col("id").alias(id_column), *map(zero, numbers), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return out, pairs
