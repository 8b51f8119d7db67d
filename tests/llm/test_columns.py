"""Columns of the caller come through every filtering operator, whatever their names."""

import pytest
from conftest import prose
from pyspark.sql import functions as F

from biblio_spark.llm import decontaminate, license_scan, packing, quality, secret_scan, simhash
from biblio_spark.llm.bytescan import free_prefix


def test_free_prefix():
    assert free_prefix("a", "b_") == "_" and free_prefix("_a", "__b") == "___" and free_prefix() == "_"


@pytest.mark.parametrize("passes", [1, 3])
def test_columns_stay(spark, clashing, monkeypatch, passes):
    if passes > 1:
        monkeypatch.setattr(decontaminate, "MAX_WORDS", 30)
        monkeypatch.setattr(decontaminate, "MACHINES", 1)
    items = spark.createDataFrame([(1, prose(1, 20)), (2, prose(99, 20)), (3, prose(98, 20))], "item_id long, text string")
    labels = spark.createDataFrame([(n, 1) for n in range(1, 11)], "doc_id long, quality int")
    named = [n for n in clashing.columns if n not in ("doc_id", "text", "lang", "source", "n_chars")]
    every = {
        "clean": decontaminate.keep_clean(clashing, items),
        "cut": decontaminate.remove_contamination(clashing, items),
        "one": simhash.keep_one(clashing),
        "good": quality.keep_good(clashing, labels),
        "redacted": secret_scan.redact_secrets(clashing),
    }
    for out in every.values():
        assert out.columns == clashing.columns
        rows = out.collect()
        assert rows and all(r[n] == "x" for r in rows for n in named)
    assert every["clean"].count() < clashing.count() == every["cut"].count()


def test_columns_of_pieces_stay(spark):
    names = ("_share", "_number", "__share", "sequence_id", "offset", "share")
    pieces = spark.createDataFrame([(n, 0, 0, 1 + n % 7, n) for n in range(60)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(pieces.withColumns({n: F.lit("x") for n in names}), 7)
    assert sorted(out.columns) == sorted([*pieces.columns, *names])
    rows = out.collect()
    assert len(rows) == 60 and all(r[n] == "x" for r in rows for n in names if n not in ("sequence_id", "offset"))
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 7


def labels_of(spark, text):
    return license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


@pytest.mark.parametrize("words", [60, 700, 5000])
def test_notices_have_no_limit(spark, words):
    """The name stands after very many fillers, or at the end of a very long list."""
    found = labels_of(spark, "Licensed under " + "the terms of " * words + "MIT license.")
    assert "mit" in found["labels"] and found["permissive"] is True and found["expressions"] == ["mit"]
    kinds = ["gpl 3", "lgpl 3", "agpl 3", "apache software license 1.1", "mpl 1.1", "isc license", "epl 2"]
    named = [kinds[k % 7] for k in range(words)] + ["bsd license"]
    found = labels_of(spark, "Released under " + " or ".join(named) + " and so on")
    assert found["expressions"][0].split().count("or") == words and "bsd" in found["labels"] and found["permissive"] is True


def test_notices_end_where_the_next_begins(spark):
    text = "licensed under the " * 400 + "mit"
    found = labels_of(spark, text)
    assert found["expressions"] == ["mit"] and "x" * 3000 not in found["labels"]
    assert labels_of(spark, "licensed under " + "x" * 3000 + " mit")["expressions"] == []


def plain_evaluation(tokens):
    """Names and permissive value of an infix expression by recursive descent: or below and below with."""
    tokens = list(tokens)

    def part():
        if tokens[0] == "(":
            tokens.pop(0)
            value = alternative()
            tokens.pop(0)
            return value
        name = tokens.pop(0)
        return {name}, name.startswith(license_scan.PERMISSIVE)

    def excepted():
        names, free = part()
        while tokens and tokens[0] == "with":
            tokens.pop(0)
            more, _ = part()
            names = {f"{a} with {b}" for a in names for b in more}
        return names, free

    def both():
        names, free = excepted()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            more, other = excepted()
            names, free = names | more, free and other
        return names, free

    def alternative():
        names, free = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            more, other = both()
            names, free = names | more, free or other
        return names, free

    return alternative()


@pytest.mark.parametrize(
    "line",
    ["MIT", "GPL-2.0-only OR MIT AND Apache-2.0", "(GPL-2.0-only OR MIT) AND Apache-2.0", "GPL-2.0-or-later WITH Classpath-exception-2.0 OR BSD-3-Clause", "MIT AND (GPL-3.0-only OR (ISC AND LGPL-2.1-only))"],
)
def test_labels_and_score_by_recursive_descent(spark, line):
    """Labels, permissive value and score of a tag, with a base phrase beside it, computed again."""
    found = labels_of(spark, f"This uses the Apache License.\n# SPDX-License-Identifier: {line}\nend")
    names, free = plain_evaluation(line.replace("(", " ( ").replace(")", " ) ").lower().split())
    assert set(found["labels"]) == names | {"apache"} and found["permissive"] is free
    assert found["score"] == pytest.approx(1 - (1 - license_scan.BASE_WEIGHT) * (1 - license_scan.TAG_WEIGHT))
