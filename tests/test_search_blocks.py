"""Postings of blocks of records against plain sets of grams."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_dedup_merge import record, records

from biblio_spark.operators import search_index


@pytest.mark.parametrize("block", [1, 300, 2_000_000])
def test_blocks_hold_every_gram_once(monkeypatch, block):
    monkeypatch.setattr(search_index, "BLOCK", block)
    rng = random.Random(block)
    made = lambda: "".join(rng.choice("abc dé\U0001f600日\0") for _ in range(rng.choice((0, 1, 2, 3, 40, 400))))
    rows = [{"ord": o, "field": f, "texts": [rng.choice((None, made(), made())) for _ in range(rng.randint(0, 3))]} for o in rng.sample(range(-50, 50), 60) for f in ("title", "author")]
    rows.append({"ord": 1000, "field": "title", "texts": ["".join(map(chr, range(0x4E00, 0x9000)))]})
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("ord", pa.int64()), ("field", pa.string()), ("texts", pa.list_(pa.string()))]))
    got = [(r["field"], r["gram"], o) for b in search_index._blocks(iter([batch.slice(0, 50), batch.slice(50)])) for r in b.to_pylist() for o in r["ords"]]
    want = {(r["field"], t[k : k + 3], r["ord"]) for r in rows for t in r["texts"] if t for k in range(len(t) - 2)}
    assert len(got) == len(set(got)) and set(got) == want


def test_many_kinds_of_characters():
    """So many that a number of a gram and a record would not fit."""
    text = "".join(chr(c) for c in range(0x10000, 0x10FFFF))
    grams, offsets, ords = search_index._post(np.arange(9), [[text]] + [[text[k : k + 5]] for k in range(8)])
    assert len(grams) == len(text) - 2 and offsets[-1] == len(ords) == len(text) - 2 + 8 * 3
    assert dict(zip(grams, np.split(ords, offsets[1:-1]), strict=True))[text[4:7]].tolist() == [0, 3, 4, 5]


def test_rows_grow_with_grams_and_not_with_records(spark, tmp_path):
    rows = records(spark, [record(k, title="the same words in every title", abstract="and every text") for k in range(400)]).coalesce(2)
    search_index.build_index(rows, f"{tmp_path}/index", parts=4)
    stored = spark.read.parquet(f"{tmp_path}/index/postings")
    assert stored.count() < 200  # a row for every gram and record would be over 10,000
    assert stored.agg(F.sum(F.size("ords"))).first()[0] > 10_000
    assert search_index.search_indexed(spark, f"{tmp_path}/index", ["ry text"]).count() == 400
