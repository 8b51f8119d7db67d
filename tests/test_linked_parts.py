"""Citation links: tasks grow in number with the edges, a hot paper is cut to the limit before its edges come together."""

import random

import pytest

from biblio_spark.operators import links


@pytest.mark.parametrize("few", [0, 1000])
def test_links_in_parts(spark, monkeypatch, few):
    monkeypatch.setattr(links, "EDGES", 100)
    monkeypatch.setattr(links, "FEW", few)
    rng = random.Random(5)
    edges = [(rng.randrange(60), 7 if k % 2 else rng.randrange(40)) for k in range(2000)] + [(3, None)] * 5
    df = spark.createDataFrame(edges, "citing_article_id long, cited_article_id long")
    ids = spark.createDataFrame([(k,) for k in (*range(0, 40, 3), 7, 7, 99)], "id long")
    out = links.citing(df, ids, 10)
    want = []
    for near in sorted({r[0] for r in ids.collect()}):
        want += [(near, far, k + 1) for k, far in enumerate(sorted({a for a, b in edges if b == near})[:10])]
    assert sorted((r["cited_article_id"], r["citing_article_id"], r["n"]) for r in out.collect()) == want
    assert out.rdd.getNumPartitions() >= 10
