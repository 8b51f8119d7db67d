"""Every registered query of the numbered operators on the smallest tables, against SQL or a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_near import brute_passages, brute_repeats, components, fingerprint
from test_scans import brute_secrets, words_of
from test_tokens import check_packing

from biblio_spark.llm import quality, registry, secret_scan

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return registry.QUERIES[name](spark, str(DATA)).collect()


def duck(sql):
    con = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    return con.sql(sql)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    df = registry.QUERIES[name](spark, str(DATA))
    want = duck(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*want.columns).collect()) == Counter(want.fetchall())


def test_op2(spark, texts):
    rows = run(spark, "op2_secret_scan")
    assert len(rows) == len(texts)
    entropy = secrets = 0
    for r in rows:
        base = brute_secrets(texts[r["doc_id"]])
        line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if not x.startswith("entropy")] == [x for x in line(base).split(",") if x]
        assert r["spans"] == line(secret_scan.find_secrets(texts[r["doc_id"]]))
        entropy += len(spans) - len(base)
        secrets += len(base)
    assert (entropy > 0) is (secrets > 0)


def token_ids(texts):
    from tokenizers import Tokenizer

    from biblio_spark.llm.tokenizing import default_tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    return {i: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}


def test_op3_and_op8(spark, texts):
    ids = token_ids(texts)
    rows = run(spark, "op3_best_fit_packing")
    total = 0
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] <= 2048 and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["piece"] == 0 or r["length"] == 2048
        total += r["length"]
    assert total == sum(map(len, ids.values())) and check_packing(rows, 2048) <= -(-total // 2048) + 1
    at = 0
    for r in sorted(run(spark, "op8_token_files"), key=lambda r: r["doc_id"]):
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert at == total


def test_op5(spark, texts):
    order = sorted(texts)
    got = {r["doc_id"]: r for r in run(spark, "op5_repeats")}
    assert len(got) == len(order)
    for i, (n, removed, spans, kept), found in zip(
        order, brute_repeats([texts[i].encode() for i in order]), brute_passages([(i, texts[i]) for i in order]), strict=True
    ):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
        assert (r["n_passages"], r["passage_words"]) == found


def test_op6(spark, texts):
    order = sorted(texts)
    prints = [fingerprint(texts[i]) for i in order]
    roots = components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op6_simhash")}
    assert got == {i: (f"{p:016x}", order[root]) for i, p, root in zip(order, prints, roots, strict=True)}


def plain_statistics(text):
    data = text.encode()
    n = max(len(data), 1)
    share = lambda signs: sum(data.count(c.encode()) for c in signs) / n
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", data) if w]
    many = max(len(words), 1)
    return {
        "log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(words)), "mean_word": sum(map(len, words)) / many, "longest_word": math.log1p(max(map(len, words), default=0)),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": share("0123456789"), "symbol": share("#$%&*@^~<>=+\\{}[]_/"), "bar": share("|"), "bang": share("!?"),
        "stop": share(".,;:"), "line": share("\n"), "space": share(" \t\r"), "wide": sum(c >= 0x80 for c in data) / n,
        "repeat_next": sum(a == b for a, b in zip(words, words[1:], strict=False)) / many, "repeat_share": (len(words) - len(set(words))) / many,
    }


def test_op9(spark, texts):
    """Statistics, rules, scores and the held-out rule computed again in plain Python; the fit is the code's own."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.statistics(docs)
    model = quality.fit_sample(found.join(quality.fit_labels(labels), "doc_id"))
    assert model.rules
    rows = run(spark, "op9_quality")
    assert len(rows) == len(texts)
    for r in rows:
        s = plain_statistics(texts[r["doc_id"]])
        total = model.intercept + sum(w for rule, w in model.rules if all((s[n] <= limit) is below for n, below, limit in rule))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert r["held_out"] is (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)


def test_long_words_are_told_apart():
    """Words with equal ends and length that differ in the middle."""
    from biblio_spark.llm.bytescan import flat
    from biblio_spark.llm.quality import text_statistics

    text = "abcdefgh" + "1" * 9 + "ijklmnop abcdefgh" + "2" * 9 + "ijklmnop"
    import pyarrow as pa

    assert text_statistics(*flat(pa.array([text])))["repeat_share"][0] == 0


def test_ties_at_the_limit_are_good(spark):
    model = quality.RuleModel(math.log(0.3 / 0.7), ())
    row = spark.range(1).select(model.score().alias("s"), (model.score() >= quality.THRESHOLD - 1e-15).alias("good")).first()
    assert row["s"] == pytest.approx(0.3) and row["good"]


def test_op10(spark, texts):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    decided = 0
    for r in run(spark, "op10_license_scan"):
        w = words_of(texts[r["doc_id"]])
        places = [(k, label) for phrase, label in phrases.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        decided += r["permissive"] is not None
    assert decided > 0


def test_pipeline_query(spark):
    rows = run(spark, "pipeline")
    assert rows and check_packing(rows, 2048)
