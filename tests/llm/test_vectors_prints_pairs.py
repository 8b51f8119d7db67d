"""Clusters, multiset fingerprints and tokenizer alignment against plain computations."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from conftest import prose
from pyspark.sql import functions as F

from biblio_spark.llm import alignment, clusters, multiset, registry

DATA = Path("/root/testdata/sf0.001")


# Centroid clusters


def brute_clusters(rows, k, rounds, seed="1"):
    """Plain k-means over integers: (labels and distances by row, centroids)."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, hashlib.sha256(f"{seed}:{rows[n][0]}".encode()).hexdigest() if rows[n][0] is not None else "", rows[n][1]))
    centroids = [list(rows[n][1]) for n in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in rows]
        for j in range(len(centroids)):
            own = [v for (_, v), o in zip(rows, owners, strict=True) if o == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [nearest(v) for _, v in rows], centroids


@pytest.mark.parametrize(("seed", "spread"), [(1, 3), (2, 1000), (3, 1 << 28)])
def test_clusters_are_exact(spark, seed, spread):
    """Small components make many ties, large ones leave 64 bits."""
    rng = random.Random(seed)
    rows = [(rng.choice([n, None]) if n % 9 == 0 else n, [rng.randint(-spread, spread) for _ in range(3)]) for n in range(120)]
    rows += rows[:7]  # repeated rows
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    labelled, centroids = clusters.cluster(table, 5, 3, dim=3)
    want, final = brute_clusters(rows, 5, 3)
    assert centroids == final
    got = Counter((r["vec_id"], r["cluster"], r["distance"]) for r in labelled.collect())
    assert got == Counter((i, j, d) for (i, _), (d, j) in zip(rows, want, strict=True))


def test_points_on_a_plane_go_to_the_smaller_number():
    planes = clusters.Bisectors([[0, 0], [2, 0], [0, 0], [0, 2]])
    best, distance = planes.assign(np.array([[1, 0], [0, 0], [1, 1], [2, 2], [1, 9]]))
    assert best.tolist() == [0, 0, 0, 1, 3] and distance.tolist() == [1, 0, 2, 4, 50]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 64, "x"), (2, None, "x"), (3, [0.5] * 63, "x"), (4, [nan] + [0.0] * 63, "x"), (5, [None] + [0.0] * 63, "x"), (6, [inf] + [0.0] * 63, "x"), (7, [], None), (None, [-0.01] * 64, "x"), (8, [0.5] * 64, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string").withColumn("v", F.lit(1)).withColumn("distance", F.lit("x"))
    got = {r["vec_id"]: r for r in clusters.centroid_clusters(table).collect()}
    assert set(got) == {1, 8, None}
    assert got[1]["cluster"] == got[8]["cluster"] != got[None]["cluster"] and got[1]["inertia"] == 0
    assert got[None]["centroid_sha256"] == hashlib.sha256(",".join(["-1"] * 64).encode()).hexdigest()
    none = clusters.centroid_clusters(table.limit(0))
    assert none.collect() == [] and [f.dataType.simpleString() for f in none.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]


# Multiset fingerprints


def brute_print(text):
    """(wide numbers, sign sums) of a text, both reduced."""
    wide, signs = [0] * 16, [0] * 64
    for paragraph in (text or "").split("\n"):
        if paragraph:
            for i in range(8):
                h = xxhash.xxh64_intdigest(paragraph.encode(), seed_of(i))
                wide[2 * i] += h & 0xFFFFFFFF
                wide[2 * i + 1] += h >> 32
        words = [w for w in paragraph.split(" ") if w]
        for k in range(max(len(words) - 2, 1)) if words else ():
            h = 42
            for w in words[k : k + 3]:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            for i in range(32):
                signs[i] += 2 * (h >> i & 1) - 1
                signs[32 + i] += 2 * (h >> (32 + i) & 1) - 1
    return [x % 2**32 for x in wide], [x % 2**20 for x in signs]


def seed_of(i):
    """The library's hash of several values starts a value's hash with that of the one before: here a 32-bit integer."""
    mask, p1, p2, p3, p5 = 2**64 - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    h = (42 + p5 + 4) & mask
    h ^= (i * p1) & mask
    h = ((h << 23 | h >> 41) & mask) * p2 + p3 & mask
    h = (h ^ h >> 33) * p2 & mask
    h = (h ^ h >> 29) * p3 & mask
    return h ^ h >> 32


def as_text(print_):
    return "".join(f"{x:08x}" for x in print_[0]) + "".join(f"{x:05x}" for x in print_[1])


def brute_likeness(a, b):
    centre = lambda x: (x + 2**19) % 2**20 - 2**19
    if a == b:
        return 1.0
    both = sum(centre(x) ** 2 for x in a[1]) + sum(centre(x) ** 2 for x in b[1])
    return max(0.0, 1 - sum(centre(x - y) ** 2 for x, y in zip(a[1], b[1], strict=True)) / both) if both else 0.0


def brute_edited(rows):
    """Of each different (id, text), from the greatest id on, null ids last: what the operator returns, by whole texts."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), int(np.int64(np.uint64(xxhash.xxh64_intdigest(r[1].encode(), xxhash.xxh64_intdigest(b"text", 42)))))))
    out = {}
    for row, after in zip(order, order[1:] + order[:1], strict=True):
        text, n = row[1], len(row[1])
        edited = text[: n - n // 3] + after[1][: n // 3]
        own, other, following = brute_print(text), brute_print(edited), brute_print(after[1])
        out[row] = (n, hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other), brute_likeness(own, other), brute_likeness(own, following))
    return out


def check_edited(rows, found):
    want = brute_edited([(i, t or "") for i, t in rows])
    expected = Counter((i, *want[i, t or ""]) for i, t in rows)
    got = found.select("doc_id", "n_chars", "edited_sha256", multiset.as_text(F.col("fp")), multiset.as_text(F.col("edited_fp")), "near_edited", "near_next").collect()
    key = lambda r: (*r[:5], round(r[5], 9), round(r[6], 9))
    assert Counter(key(r) for r in got) == Counter(key(r) for r in expected.elements())


def test_edited_fingerprints(spark, odd, clashing, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_edited(rows, multiset.edited_fingerprints(odd))
    named = clashing.withColumns({n: F.lit("x") for n in ("_id", "_none", "_hash", "_n", "_text", "part", "_w0", "own", "edited")})
    check_edited(rows, multiset.edited_fingerprints(named))
    assert multiset.edited_fingerprints(empty).collect() == []
    check_edited([(7, "a b c d e f")], multiset.edited_fingerprints(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")))


def test_edited_fingerprints_in_many_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(-40, 40)]), "\n".join(rng.choice(["", "é a b", "one two", "x", " ", prose(k, 12)]) for k in range(rng.randint(0, 6)))) for _ in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check_edited(rows, multiset.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_are_a_homomorphism(spark):
    """Order does not matter; insertion and deletion equal the fingerprint of the text that they lead to."""
    parts = ["one two three four", "é ß", "", "one two three four", "  ", "last words of all here"]
    texts = [(1, "\n".join(parts)), (2, "\n".join(reversed(parts))), (3, "\n".join(parts[:3])), (4, "\n".join(parts[3:])), (5, "\n".join(parts[1:])), (6, None), (7, "")]
    fp = {r["n"]: r["fp"] for r in multiset.fingerprints(spark.createDataFrame(texts, "n long, text string"), ["n"]).collect()}
    assert fp[1] == fp[2] != fp[5] and fp[6] == fp[7] and not any(fp[6]["wide"]) and not any(fp[6]["signs"])
    row = spark.createDataFrame([(fp[1], fp[3], fp[4])], "a struct<wide:array<long>,signs:array<int>>, b struct<wide:array<long>,signs:array<int>>, c struct<wide:array<long>,signs:array<int>>")
    got = row.select(multiset.insert(F.col("b"), F.col("c")).alias("sum"), multiset.delete(F.col("a"), F.col("c")).alias("rest")).first()
    assert (got["sum"], got["rest"]) == (fp[1], fp[3])
    # a group of rows is one multiset
    both = multiset.fingerprints(spark.createDataFrame([(1, t) for n, t in texts[2:4]], "n long, text string"), ["n"]).first()
    assert both["fp"] == fp[1]


def test_likeness_follows_what_texts_share(spark):
    a = prose(11, 900).replace("\n", " ")
    words = a.split(" ")
    texts = [(k, " ".join(words[: len(words) - k * len(words) // 10]) + " " + prose(50 + k, k * 90)) for k in range(11)]
    fp = {r["n"]: r["fp"] for r in multiset.fingerprints(spark.createDataFrame(texts, "n long, text string"), ["n"]).collect()}
    near = [brute_likeness(fp[0], fp[k]) for k in range(11)]
    assert near[0] == 1 and all(abs(near[k] - (1 - k / 10)) < 0.25 for k in range(11))


# Tokenizer alignment


def brute_alignment(texts):
    """Measures by text, by walking through both token lists; ``texts`` with repeats."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces, pairs = {}, {}
    for t in set(texts):
        if not t:
            continue
        enc = library.encode(" " + t, add_special_tokens=False)
        spelled = "".join(library.id_to_token(i) for i in enc.ids)
        sizes_a = [len(library.id_to_token(i)) for i in enc.ids]
        ids_b = model.encode(t)
        spell_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in ids_b)]
        raw = (" " + t).encode()
        if b"".join(spell_b) != raw or len(spelled) != len(raw):
            continue
        a, b = list(zip(enc.ids, sizes_a, strict=True)), [(i, len(s)) for i, s in zip(ids_b, spell_b, strict=True)]
        spans = lambda tokens: [(i, sum(n for _, n in tokens[:k]), sum(n for _, n in tokens[: k + 1])) for k, (i, n) in enumerate(tokens)]
        a, b = spans(a), spans(b)
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        for low, high in zip([0, *ends], ends, strict=False):
            inside = lambda tokens: ",".join(str(i) for i, s, e in tokens if low <= s and e <= high)  # noqa: B023, E731
            groups.append(f"{inside(a)}|{inside(b)}")
        pieces[t] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
        pairs[t] = set(links)
    count = Counter()
    for t, many in Counter(texts).items():
        for p in pairs.get(t, ()):
            count[p] += many
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    out = {}
    for t in set(texts):
        if t in pieces:
            a, b, g, links, sha = pieces[t]
            out[t] = (a, b, g, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), sha)
        else:
            out[t] = (0, 0, 0, 0, 0, 0, "")
    return out, count


_COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def alignment_texts():
    rng = random.Random(6)
    odd = ["", None, " ", "a", "a▁b", "<|endoftext|> x", "<s> y </s>", "tab\tand\nline", "日本語 text", "naïve café — “q”", "  two  spaces ", "\x00\x01", "🙂 smile", "don't we'll 12345"]
    return odd + [prose(k, rng.randint(1, 60)) for k in range(12)] + [prose(3, 30)] * 4 + ["a"] * 3


def test_pieces_equal_whole_texts():
    """Stretches between spaces give the ids of whole texts, also where few are remembered."""
    import public_tokenizers
    import pyarrow as pa

    from biblio_spark.llm.bytescan import flat

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["", " ", "  ", "a ", " a", "a  b   c    ", "\n \n", "▁ ▁▁ a▁b", "x" * 60 + " y", "<s> </s> <0x41> <unk>"] + [t for t in alignment_texts() if t]
    for limit in (1 << 12, 40):
        pieces = alignment.PieceEncoder(path, limit)
        assert pieces.by_words
        for some in (texts, texts[::-1], texts[:1], [prose(5, 3000)]):
            ids, at = pieces.encode_flat(*flat(pa.array([f" {t}" for t in some])))
            want = [pieces.model.encode(t) if t else [pieces.lone] for t in some]
            assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == want


@pytest.mark.parametrize("block", [4_000_000, 150])
def test_alignment(spark, block):
    texts = alignment_texts()
    rows = [(k if k % 7 else None, t, "x", "x", "x") for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string, id string, copies string")
    found, pairs = alignment.align_documents(table, block_bytes=block)
    want, count = brute_alignment(texts)
    got = Counter(tuple(r[c] for c in ("doc_id", *_COLUMNS)) for r in found.collect())
    assert got == Counter((i, *want[t]) for i, t, *_ in rows)
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == count


def test_alignment_of_odd_tables(spark, odd, empty):
    found, pairs = alignment.align_documents(empty)
    assert found.collect() == [] and pairs.collect() == []
    nulls, none = alignment.align_documents(odd.where("text IS NULL OR text = ''"))
    assert [tuple(r[c] for c in _COLUMNS) for r in nulls.collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2 and none.collect() == []
    whole, _ = alignment.align_documents(odd)
    got = {r["doc_id"]: r for r in whole.collect()}
    assert whole.count() == 12 and got[4]["groups_sha256"] == got[5]["groups_sha256"] and got[6]["n_a"] > 60_000


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_queries(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r[c] for c in ("doc_id", *_COLUMNS)) for r in registry.QUERIES["op13_tokenizer_alignment"](spark, str(DATA)).collect())
    short = {t for _, t in docs if len(t or "") < 1500}
    want, _ = brute_alignment([t for _, t in docs if t in short])
    first = Counter((i, *want[t][:4], want[t][6]) for i, t in docs if t in short)
    ids = {i for i, t in docs if t in short}
    assert Counter((*r[:5], r[7]) for r in got.elements() if r[0] in ids) == first
    want = brute_edited([(i, t or "") for i, t in docs])
    rows = registry.QUERIES["op12_multiset_hash"](spark, str(DATA)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        exact, near = want[r["doc_id"], dict(docs)[r["doc_id"]] or ""][:4], want[r["doc_id"], dict(docs)[r["doc_id"]] or ""][4:]
        assert tuple(r[c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")) == exact
        assert (r["near_edited"], r["near_next"]) == pytest.approx(near)
