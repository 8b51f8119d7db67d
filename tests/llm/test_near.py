"""SimHash, repeats, top-k and archives against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from biblio_spark.llm import kdtree, repeats, simhash, warc
from biblio_spark.storage import new_path


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, odd, clashing, empty):
    for df in (odd, clashing):
        want = Counter((r["doc_id"], fingerprint(r["text"])) for r in df.select("doc_id", "text").collect())
        assert Counter((r["id"], r["fp"] % 2**64) for r in simhash.fingerprints(df).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_is_sparks_hash(spark):
    from pyspark.sql import functions as F

    value = spark.range(1).select(F.xxhash64(F.lit("a bé c"))).first()[0] % 2**64
    assert int.from_bytes(simhash.shingle_hashes("a bé c".encode()), "big") == value


def components(values):
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_join_what_chains_of_small_distances_join(spark, bucket):
    from biblio_spark.operators.components import connected_components

    rng = random.Random(bucket)
    values = set()
    for _ in range(8):
        center = rng.getrandbits(64)
        for _ in range(12):
            v = center
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << bit
            values.add(v)
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r["node"]: r["component"] for r in connected_components(simhash.links(df, bucket)).collect()}
    want = components(values)
    groups = {}
    for i, root in enumerate(want):
        groups.setdefault(root, set()).add(signed[i])
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_one_document_of_each_group_stays(spark, clashing):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    marked = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(clashing).collect()}
    assert marked[5] == 4 and marked[2] == marked[3] == 1
    assert (False, 5) not in ids and (False, 4) in ids and (False, 2) not in ids and (True, 0) in ids


def test_keeper_is_chosen_by_row(spark):
    """Copies without ids, one id with two texts, and rows that agree in id and text."""
    a, b = "one two three four five six", "other words stand in this text here"
    rows = [(None, a, 1), (None, a, 2), (7, b, 3), (7, a, 4), (7, a, 5), (9, b, 6), (None, "alone it is and short", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h int")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([(7, a), (7, b), (0, "alone it is and short")])
    assert simhash.keep_one(docs).columns == docs.columns


def brute_repeats(texts, length=400):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        out.append((len(t), sum(mark), (b"\0" + bytes(mark)).count(b"\0\1"), bytes(c for c, m in zip(t, mark, strict=True) if not m)))
    return out


def repeat_texts():
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdeé fgh\n") for _ in range(n))
    passage, other = fresh(900), fresh(401)
    near = list(passage)
    near[450] = "#"
    return [
        fresh(700) + passage + fresh(300), passage, fresh(100) + "".join(near), other, "x" + other, other[:399], fresh(50) + passage[200:650] + fresh(50),
        "a" * 1500, "ab" * 500, "b" + "ab" * 210, "", None, passage, fresh(600) * 2, "line of text\n" * 200, fresh(400), passage[:430] + passage[:430],
    ]


@pytest.mark.parametrize("chunk", [1_000_000, 700])
def test_repeats_match_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    texts = repeat_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(docs).collect()}
    want = brute_repeats([(t or "").encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("unit", [repeats.BYTES, repeats.WORDS])
def test_runs_are_the_same_in_any_chunks(unit, monkeypatch):
    import pyarrow as pa

    def marks(chunk):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        batch = pa.RecordBatch.from_pydict({"text": [t or "" for t in repeat_texts()]})
        out = set()
        for part, rows, bounds, shift in repeats.pieces(batch, unit):
            hashes = repeats.RollingHash(part)
            text, begin, count, mark = repeats.phrases(part, bounds, hashes, unit)
            for t, b, n, m in zip(text, begin, count, mark, strict=True):
                place = b - bounds[t] + shift[t]
                out |= {(rows[t], place + k, m - b - k) for k in range(n)}
        return out

    assert marks(1_000_000) == marks(300)


def brute_passages(rows, length=50):
    """(passages, words in them) of each (id, text): words in windows that a row with another id or text holds."""
    import re

    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    holders = {}
    for row, w in zip(rows, words, strict=True):
        for k in range(len(w) - length + 1):
            holders.setdefault(tuple(w[k : k + length]), set()).add(row)
    out = []
    for w in words:
        mark = bytearray(len(w))
        for k in range(len(w) - length + 1):
            if len(holders[tuple(w[k : k + length])]) > 1:
                mark[k : k + length] = b"\1" * length
        out.append(((b"\0" + bytes(mark)).count(b"\0\1"), sum(mark)))
    return out


@pytest.mark.parametrize("chunk", [1_000_000, 90])
def test_passages_match_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = random.Random(12)
    fresh = lambda n: [rng.choice(["of", "Tion", "é", "the", "ing", "x1", "an", "ou", "re"]) + rng.choice(["", "a", "ed", "er"]) for _ in range(n)]
    passage = fresh(120)
    edited = list(passage)
    edited[60] = "other"
    some = [
        fresh(70) + passage + fresh(30), fresh(9) + edited, passage[:51] + fresh(20), passage[:50], passage[:49] + fresh(60), fresh(40) + passage[20:75],
        ["a"] * 200, ["a"] * 60, ["b"] * 300, fresh(55) * 2, fresh(30), [], fresh(25) + [w.upper() for w in passage if w.isascii()] + fresh(9),
    ]
    rows = [(k, rng.choice([" ", ", ", "\n"]).join(w)) for k, w in enumerate(some)]
    rows += [(3, rows[3][1]), (50, None), (51, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.remove_repeats(docs).select("doc_id", "n_passages", "passage_words").collect()
    assert sorted(tuple(r) for r in out) == sorted((i, *found) for (i, _), found in zip(rows, brute_passages(rows), strict=True))


def test_repeats_edges(spark, clashing, empty):
    out = repeats.remove_repeats(clashing).collect()
    assert len(out) == clashing.count()
    assert repeats.remove_repeats(empty).count() == 0
    by_id = {r["doc_id"]: r for r in out}
    want = brute_repeats([(r["text"] or "").encode() if r["doc_id"] != 6 else b"" for r in clashing.select("doc_id", "text").collect()])
    ids = [r["doc_id"] for r in clashing.select("doc_id").collect()]
    for i, w in zip(ids, want, strict=True):
        if i not in (6, None):
            assert by_id[i]["n_removed"] == w[1] and by_id[i]["n_spans"] == w[2]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(180)]
    vectors += [(i, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(180, 230)]
    odd = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("nan")] * 5), (303, [float("inf")] * 5), (304, []), (None, [1.0] * 5), (320, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS dim", "1 AS rows")
    from pyspark.sql import functions as F

    found = kdtree.top_k(kdtree.quantized(df), F.col("vec_id") % 20 == 0, k=7, shard=40, block=4).collect()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    whole = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors}
    want = []
    for q in whole:
        if q % 20 == 0:
            scored = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:7]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    for rounds in (1, 2):
        found = kdtree.top_k(kdtree.quantized(df), F.col("vec_id") % 20 == 0, k=7, shard=40, block=4, rounds=rounds).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == sorted(want)
    none = kdtree.quantized(spark.createDataFrame(odd[:5], "vec_id long, embedding array<double>"))
    assert kdtree.top_k(none.where("size(v) > 0"), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<double>")
    assert kdtree.top_k(kdtree.quantized(few), F.col("vec_id") % 20 == 0).count() == 2
    assert kdtree.top_k(kdtree.quantized(few.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_search_prunes_and_stays_exact():
    rng = np.random.default_rng(7)
    centres = rng.integers(-60, 60, (12, 8))
    vectors = centres[rng.integers(0, 12, 3000)] + rng.integers(-3, 4, (3000, 8))
    ids = rng.permutation(10_000)[:3000].astype(np.int64)
    tree = kdtree.KDTree(ids, vectors, leaf=32)
    assert (np.diff(tree.starts) <= 32).all() and sorted(tree.ids) == sorted(ids)
    own, queries = ids[:50], vectors[:50]
    q, others, scores = tree.search(own, queries, 5, np.full(50, -(2**62)))
    for n in range(50):
        want = sorted((-int(queries[n] @ v), int(i)) for v, i in zip(vectors, ids, strict=True) if i != own[n])[:5]
        assert [(-s, i) for s, i in zip(scores[q == n].tolist(), others[q == n].tolist(), strict=True)] == want
    huge = vectors.astype(np.int64) * 2**22
    q2, others2, _ = kdtree.KDTree(ids, huge, leaf=32).search(own, huge[:50], 5, np.full(50, -(2**62)))
    assert (q2 == q).all() and (others2 == others).all()


def pages_rows():
    big, small = "é" * 600, "x" * 999
    return [
        (1, "http://a/", big), (2, "http://b/ c", big), (9, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "u", "y\r\n\r\nWARC/1.1\r\n" + "z" * 2000),
        (8, "u", "<p>" * 5000), (8, "u", "<p>" * 5000), (-4, "u", "<p>" * 5000), (None, "u", big), (10, "a\nb", "\x00\x1f\x8b" + "q" * 1500),
    ]


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    rows = pages_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "'d' AS digest")
    path = new_path(spark, "warc")
    warc.convert_pages(pages, path, version)
    back = warc.read_warc(spark, path).collect()
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    last = {}
    for i, b in bodies:
        if i is not None and len(b) >= 1000:
            last[b] = max(i, last.get(b, i))
    several = Counter(b for _, b in bodies)
    want = Counter()
    for i, b in bodies:
        top = last.get(b) if several[b] > 1 else None
        revisit = top is not None and i != top
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    assert Counter((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back) == want
    blocks = {r["key"]: bytes(r["block"]) for r in back if r["record_type"] == "response"}
    assert warc.split_http(blocks[7])[1] == bodies[7][1]


def test_files_are_plain_gzip_chains(spark):
    import glob
    import gzip

    pages = spark.createDataFrame([(1, "u", "a" * 10), (2, "u", "b" * 20)], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.convert_pages(pages.coalesce(1), path)
    content = b"".join(gzip.decompress(open(f, "rb").read()) for f in sorted(glob.glob(path.removeprefix("file://").removeprefix("file:") + "/part-*")))
    assert content.count(b"WARC/1.1\r\n") == 2 and content.endswith(b"\r\n\r\n")
    empty = new_path(spark, "warc")
    warc.convert_pages(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_arc_headers_of_both_versions():
    for version in (1, 2):
        stream = warc.arc_version_block(version) + warc.arc_record("http://a b/", b"one\ntwo", version) + b"\n" + warc.arc_record(None, b"", version)
        first, second = warc.parse_arc(stream)
        assert first["url"] == "http://a%20b/" and warc.split_http(first["block"])[1] == b"one\ntwo" and second["url"] == "about:blank"
        assert (first["status"] == 200) is (version == 2)
        with pytest.raises(ValueError):
            list(warc.parse_arc(stream[:-4]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a 0.0.0.0 2000 text/html 5\nabc"))
    assert warc.warc_date("19991231235959") == "1999-12-31T23:59:59Z" and warc.warc_date("199912") == "1999-12-01T00:00:00Z"
    assert warc.warc_date("x") == warc.warc_date("20009999000000") == "1970-01-01T00:00:00Z"


def test_record_ids_hold_keys():
    for key in (0, 1, -1, 2**63 - 1, -(2**63), 123456789012345):
        assert warc.record_key(warc.record_id(key)) == key
    assert warc.record_key(warc.place_id("a.arc", 0, "u", "2000")) is None


@pytest.mark.parametrize("zipped", [False, True])
def test_arc_files_of_many_records(spark, tmp_path, zipped):
    """Streams with a version block and several records, equal payloads within a file and over files."""
    same, small = b"<p>" * 800, b"short"
    pack = warc.gzip_member if zipped else bytes
    for name, version, bodies in (("a", 1, [same, small, same, b"x" * 1500]), ("b", 2, [same, small, b""])):
        parts = [warc.arc_version_block(version), *(warc.arc_record(f"http://{name}/{n % 2}", body, version, f"2001010100000{n % 2}") for n, body in enumerate(bodies))]
        (tmp_path / f"{name}.arc{'.gz' if zipped else ''}").write_bytes(b"".join(pack(p) for p in parts))
    path = new_path(spark, "warc")
    warc.convert_arc_files(spark, f"file://{tmp_path}", path)
    back = warc.read_warc(spark, path).collect()
    assert len(back) == 7 and len({r["record_id"] for r in back}) == 7
    copies = [r for r in back if r["payload_digest"] == hashlib.sha1(same).hexdigest()]
    original = [r for r in copies if r["record_type"] == "response"]
    assert len(copies) == 3 and len(original) == 1
    assert {r["refers_to_id"] for r in copies if r["record_type"] == "revisit"} == {original[0]["record_id"]}
    assert all(r["record_type"] == "response" for r in back if r not in copies)
    again = new_path(spark, "warc")
    warc.convert_arc_files(spark, f"file://{tmp_path}", again)
    assert {r["record_id"] for r in warc.read_warc(spark, again).collect()} == {r["record_id"] for r in back}


def test_long_pages_and_files_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh<>") for _ in range(3_000_000))
    pages = spark.createDataFrame([(1, "u", long), *((k, "u", str(k) * 500) for k in range(2, 30))], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.convert_pages(pages, path)
    back = {r["key"]: r["payload_bytes"] for r in warc.read_warc(spark, path).collect()}
    assert len(back) == 29 and back[1] == 3_000_000


def test_cut_version_block_is_refused():
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_version_block(1)[:-20]))


def test_trees_visit_few_leaves_of_clustered_vectors():
    """Boxes bound their nodes tightly from the root down; on clusters a query opens a few leaves of many and finds what all vectors give."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (64, 64))
    vectors = np.concatenate([c + rng.integers(-3, 4, (200, 64)) for c in centres])
    ids = rng.permutation(len(vectors))
    tree = kdtree.KDTree(ids, vectors)
    for n in np.flatnonzero(tree.left >= 0):
        for child in (tree.left[n], tree.right[n]):
            assert (tree.low[child] >= tree.low[n]).all() and (tree.high[child] <= tree.high[n]).all()
    leaves = np.flatnonzero(tree.left < 0)
    assert sorted((tree.first[n], tree.last[n]) for n in leaves)[0][0] == 0 and sum(tree.last[n] - tree.first[n] for n in leaves) == len(ids)
    asked = np.arange(0, len(ids), 100)
    q, others, scores = tree.search(ids[asked], vectors[asked], 20, np.full(len(asked), -(2**62)))
    for n, row in enumerate(asked):
        exact = sorted((-int(s), int(i)) for i, s in zip(ids, vectors @ vectors[row], strict=True) if i != ids[row])[:20]
        assert [(-s, i) for s, i in zip(scores[q == n].tolist(), others[q == n].tolist(), strict=True)] == exact
    assert tree.visited / len(asked) < len(leaves) / 5
