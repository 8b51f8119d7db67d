"""The classifier on held-out rows, and the pipeline stage by stage."""

import random

import numpy as np
import pytest

from biblio_spark.llm import decontaminate, quality, secret_scan


def labelled(n=600):
    rng = random.Random(11)
    words = ["the", "of", "thing", "anea", "er", "tion", "ould", "ble"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 80)))
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randint(0, 2)
            text = [text.replace(" ", "### "), (rng.choice(words) + " ") * 60, text.upper().replace(" ", "!! ")][kind]
        rows.append((i, text, "en", "s", len(text)))
        if rng.random() < 0.8:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    scored = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(scored) > 60 and (scored.predicted == scored.quality).mean() > 0.93
    assert scored.score.between(0, 1).all()


def test_held_out_labels_are_never_used(spark, corpus):
    docs, labels = corpus
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, turned).collect()}
    assert a == b


def test_scores_of_odd_documents(spark, clashing, empty, corpus):
    labels = corpus[1]
    none = labels.limit(0)
    out = quality.score_documents(clashing, none).collect()
    assert len(out) == clashing.count() and {r["score"] for r in out} == {0.5}
    one = spark.createDataFrame([(4, 1, 0), (8, 1, 0), (8, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.5 for r in quality.score_documents(clashing, one).collect())
    assert quality.score_documents(empty, labels).count() == 0
    kept = quality.keep_good(clashing, one)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()


def test_statistics_do_not_depend_on_neighbours():
    import pyarrow as pa

    from biblio_spark.llm.bytescan import flat

    texts = ["", "a", "the the the", "é|é | x", " lead", "trail \n", "#### 12"]
    together = quality.text_statistics(*flat(pa.array(texts)))
    for k, text in enumerate(texts):
        alone = quality.text_statistics(*flat(pa.array([text])))
        for name in quality.STATISTICS:
            assert np.isclose(together[name][k], alone[name][0]), (name, text)
    assert together["repeat_next"][2] == pytest.approx(2 / 3) and together["bar"][3] > 0


def test_rules_come_from_tree_paths():
    debug = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 4 <= 0.5)
   If (feature 0 <= 1.5)
    Predict: 0.0
   Else (feature 0 > 1.5)
    Predict: 1.0
  Else (feature 4 > 0.5)
   Predict: 1.0
"""
    a, b = quality.STATISTICS[4], quality.STATISTICS[0]
    assert quality.tree_rules(debug) == [((a, True, 0.5),), ((a, True, 0.5), (b, True, 1.5)), ((a, True, 0.5), (b, False, 1.5)), ((a, False, 0.5),)]


def test_pipeline_stages_against_brute_force(spark, tmp_path, corpus):
    import corpus_pipeline
    from tests_brute import contaminated, near_keepers

    docs, labels = corpus
    rng = random.Random(99)
    passage = " ".join(rng.choice(["the", "of", "thing", "anea", "er", "tion", "ould", "ble"]) for _ in range(40))
    extra = [
        (1000, labelled()[0][0][1] + " x", "en", "s", 5), (1001, passage, "en", "s", 5), (1002, "the of thing token = abcdef123 anea er tion " * 3, "en", "s", 5),
        (1003, None, "en", "s", None), (1004, "", "en", "s", 0), (1005, labelled()[0][1][1], "en", "s", 5),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    state = spark.read.parquet(f"{folder}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        before, state = state, spark.read.parquet(f"{folder}/{name}")
        was = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        now = {r["doc_id"]: r["text"] for r in state.select("doc_id", "text").collect()} if name != "packing" else None
        if name == "quality":
            scored = {r["doc_id"]: r["predicted"] for r in quality.score_documents(before, labels).collect()}
            assert set(now) == {i for i, p in scored.items() if p == 1}
        elif name == "near_duplicates":
            assert set(now) == near_keepers(was)
        elif name == "decontamination":
            assert set(now) == {i for i, t in was.items() if not contaminated(t, passage)}
            assert 1001 in was and 1001 not in now
        elif name == "secrets":
            assert set(now) == set(was)
            for i, t in was.items():
                spans = secret_scan.find_secrets(t) if t else []
                assert (now[i] == t) is (not spans)
        else:
            assert {r["doc_id"] for r in state.select("doc_id").collect()} == set(was)
        if now:
            assert all(now[i] == was[i] for i in now if name != "secrets")
    assert decontaminate.COVERAGE == 20
    assert corpus_pipeline.run(spark, folder).count() == state.count()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_take_odd_rows(spark, tmp_path, clashing, corpus, empty):
    """Null and repeated ids, null, empty and very long texts, equal rows, columns with names that operators use inside."""
    import corpus_pipeline

    docs, labels = corpus
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2 w3"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    state = clashing.limit(0) if empty else clashing
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, str(tmp_path))
        if name != "packing":
            assert out.columns == clashing.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        state = spark.read.parquet(path)
        assert (state.count() == 0) is empty
