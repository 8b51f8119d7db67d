"""Tokens, token files and packing against the library itself."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from biblio_spark.llm import packing, token_files
from biblio_spark.llm.tokenizing import WordEncoder, default_tokenizer
from biblio_spark.storage import new_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts(library):
    rng = random.Random(3)
    parts = ["a", "é", "ß", "  ", " ", "\n", "\t", "'s", "'", "1", ".", ",", "<|endoftext|>", "Ab", "ñ", "!", "\x85", "\x1c", " \n", "日本", "#", "́", "ª"]
    encoder = WordEncoder(default_tokenizer(), limit=200)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for at in range(0, len(texts), 300):
        for text, got in zip(texts[at : at + 300], encoder.encode(texts[at : at + 300]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == ids_of(library, text), repr(text)


def test_long_texts_are_cut_where_the_tokenizer_cuts(library, monkeypatch):
    monkeypatch.setattr("biblio_spark.llm.tokenizing._PART", 50)
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice(["the ", "ing,", "\n", "  ", "x" * 70, " é"]) for _ in range(60))
        assert np.frombuffer(WordEncoder(default_tokenizer()).encode([text])[0], "<u4").tolist() == ids_of(library, text)


def test_token_files_round_trip(spark, clashing, empty, library):
    path = new_path(spark, "tokens")
    token_files.write_token_files(clashing, path)
    rows = [(r["doc_id"], ids_of(library, r["text"]) + [0]) for r in clashing.select("doc_id", "text").collect()]
    back = token_files.read_tokens(spark, path).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, len(r[1]))
    assert sorted(((r["doc_id"], r["ids"]) for r in back), key=key) == sorted(rows, key=key)
    index = sorted(token_files.read_index(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    for r in index:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in index] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    assert sorted(r["ids_crc32"] for r in index) == sorted(zlib.crc32(np.array(i, "<u4").tobytes()) for _, i in rows)
    other = new_path(spark, "tokens")
    token_files.write_token_files(empty, other)
    assert token_files.read_index(spark, other).count() == 0


def test_long_documents_are_several_records(spark, library, monkeypatch):
    """Written in the driver's way with small parts: checksums of parts join to those of whole documents."""
    monkeypatch.setattr(token_files, "PART_BYTES", 40)
    rng = np.random.default_rng(5)
    for n in (0, 1, 19, 20, 21, 40, 333):
        tokens = rng.integers(0, 60_000, n).astype("<u4")
        payloads = token_files.pack_document(7, 3, tokens, False)
        assert len(payloads) == max(1, -(-2 * n // 40))
        found, crc = [], 0
        for k, payload in enumerate(payloads):
            doc, serial, part, parts, ids = token_files.unpack_payload(memoryview(payload))
            assert (doc, serial, part, parts) == (7, 3, k, len(payloads))
            crc = token_files.crc_join(crc, zlib.crc32(ids.astype("<u4").tobytes()), 4 * len(ids))
            found += ids.tolist()
        assert found == tokens.tolist() and crc == zlib.crc32(tokens.tobytes())


def test_very_long_text_in_token_files(spark, library):
    text = " ".join(f"w{k % 977} 日" for k in range(250_000))
    docs = spark.createDataFrame([(1, "a"), (2, text), (3, "b c")], "doc_id long, text string")
    path = new_path(spark, "tokens")
    token_files.write_token_files(docs, path)
    assert token_files.read_records(spark, path).where("doc_id = 2").count() > 1
    expected = np.array([*ids_of(library, text), 0], "<u4")
    index = {r["doc_id"]: r for r in token_files.read_index(spark, path).collect()}
    assert index[2]["n_tokens"] == len(expected) and index[2]["ids_crc32"] == zlib.crc32(expected.tobytes())
    assert [index[k]["start"] for k in (1, 2, 3)] == [0, index[1]["n_tokens"], index[1]["n_tokens"] + len(expected)]
    parts = sorted(token_files.read_tokens(spark, path).where("doc_id = 2").collect(), key=lambda r: r["part"])
    assert sum((r["ids"] for r in parts), []) == expected.tolist()


def test_shuffled_reads_by_the_index(spark, clashing):
    path = new_path(spark, "tokens")
    token_files.write_token_files(clashing, path)
    plain = sorted((r["doc_id"] or -1, r["ids"]) for r in token_files.read_tokens(spark, path).collect())
    one = [(r["doc_id"] or -1, r["ids"]) for r in token_files.read_shuffled(spark, path, 1).collect()]
    assert sorted(one) == plain
    assert one == [(r["doc_id"] or -1, r["ids"]) for r in token_files.read_shuffled(spark, path, 1).collect()]
    assert one != [(r["doc_id"] or -1, r["ids"]) for r in token_files.read_shuffled(spark, path, 2).collect()]
    some = token_files.read_records(spark, path).where("doc_id in (4, 9)")
    assert sorted(r["doc_id"] for r in token_files.read_shuffled(spark, path, 3, some).collect()) == [4, 9]


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        token_files.pack_document(1, 0, np.array([70_000], "<u4"), False)
    payload = token_files.pack_document(None, 0, np.array([70_000], "<u4"), True)[0]
    assert token_files.unpack_payload(memoryview(payload))[4].tolist() == [70_000]


def test_damaged_records_are_refused():
    content = token_files.frame(b"payload") + b"\n"
    assert [bytes(p) for _, p in token_files.read_frames(content)] == [b"payload"]
    for place in range(len(content)):
        broken = bytearray(content)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            list(token_files.read_frames(bytes(broken)))
    with pytest.raises(ValueError):
        list(token_files.read_frames(content[:-3]))


def brute_fill(lengths, capacity):
    best = 0
    for mask in range(1 << len(lengths)):
        total = sum(x for k, x in enumerate(lengths) if mask >> k & 1)
        best = max(best, total if total <= capacity else 0)
    return best


def test_fullest_combination_is_the_fullest():
    rng = random.Random(6)
    for _ in range(300):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        used = packing.fullest(dict(counts), 40)
        assert all(n <= counts[x] for x, n in used.items()) and used[max(lengths)] >= 1
        rest = list(lengths)
        rest.remove(max(lengths))
        assert sum(x * n for x, n in used.items()) == max(lengths) + brute_fill(rest, 40 - max(lengths))


def check_packing(pieces, capacity):
    bins = {}
    for r in pieces:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_odd_documents(spark, clashing, empty, library):
    rows = packing.pack_documents(clashing).collect()
    bins = check_packing(rows, packing.CAPACITY)
    total = 0
    for r in clashing.select("text").collect():
        total += len(ids_of(library, r["text"])) + 1
    assert sum(r["length"] for r in rows) == total
    assert bins <= -(-total // packing.CAPACITY) + 2
    assert packing.pack_documents(empty).count() == 0
    for r in rows:
        assert r["piece"] == 0 or r["length"] == packing.CAPACITY


def test_pieces_join_to_the_ids(spark, library):
    text = " ".join(f"wörd{k % 311} ing" for k in range(2000))
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    rows = sorted(packing.token_pieces(docs, capacity=64).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    ids = {1: ids_of(library, text) + [0], 2: ids_of(library, "a b") + [0]}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    lengths = [r["length"] for r in rows if r["doc_id"] == 1]
    assert sum(lengths) == len(ids[1]) and all(x == 64 for x in lengths[1:])


def test_ties_and_repeated_pieces_keep_their_rows(spark):
    pieces = spark.createDataFrame([(k % 3 or None, 0, 0, n, 9) for k in range(40) for n in (5, 5, 2048, 1024)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces).collect()
    assert len(rows) == 160 and sum(r["length"] == 2048 for r in rows) == 40
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 160
    assert check_packing(rows, packing.CAPACITY) <= 40 + 20 + 1
    assert dict(packing.pack(pieces).dtypes)["piece"] == "int"


def test_frequent_length_is_packed_whole(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0L AS piece", "0L AS start", "IF(id % 3 = 0, 700L, id % 900 + 1) AS length", "id AS ids_crc32")
    rows = packing.pack(pieces).collect()
    assert len(rows) == 3000 and len({r["doc_id"] for r in rows}) == 3000
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, packing.CAPACITY) <= -(-total // packing.CAPACITY) + 2
