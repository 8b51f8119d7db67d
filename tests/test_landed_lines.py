"""Landed lines are numbered, grouped and loaded without moving or writing the records again."""

import json

import pyspark.sql.dataframe
import pytest
from pyspark.sql import functions as F
from test_dedup_merge import record, records

from biblio_spark.operators import catalog, merge
from biblio_spark.sources import landed
from biblio_spark.storage import materialize


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_keep_their_order_and_are_not_shuffled(spark, tmp_path, monkeypatch, small_parts):
    def refuse(*_):
        raise AssertionError("records are shuffled to be numbered")

    for kind in (pyspark.sql.dataframe.DataFrame, type(spark.range(0))):
        monkeypatch.setattr(kind, "repartitionByRange", refuse)
    want = []
    for n, rows in enumerate((200, 0, 1, 77)):
        uids = [f"U{n}-{k}" for k in range(rows)]
        lines = [json.dumps({"uid": u, "title": "x" * (i % 90)}) for i, u in enumerate(uids)]
        (tmp_path / f"{n}.json").write_text("".join(f"{x}\n\n" if i % 9 == 0 else f"{x}\n" for i, x in enumerate(lines)))
        want += uids
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    read = landed.read_wos(spark, str(tmp_path), lines=True, first=5).orderBy("ord").collect()
    assert [r["uid"] for r in read] == want and [r["ord"] for r in read] == list(range(5, 5 + len(want)))
    assert read[0]["record_id"] == "wos:uid:U0-0"


def test_written_records_are_not_written_again(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(catalog, "materialize", lambda df, label: labels.append(label) or materialize(df, label))
    rows = records(spark, [record(k, title=f"Title {k}", authors=["Ann Lee"]) for k in range(9)])
    first = catalog.load_catalog(rows, 2024)
    assert "keyed" in labels
    labels.clear()
    again = catalog.load_catalog(materialize(rows, "records"), 2024)
    assert "keyed" not in labels
    for name in first:
        assert sorted(map(repr, first[name].collect())) == sorted(map(repr, again[name].collect()))


def test_few_groups_of_several_leave_the_records_in_place(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # the records are larger than that, the groups of several are not
    rows = records(spark, [record(k, title=f"Title {k}", authors=["Ann Lee"]) for k in range(40)])
    marked = materialize(rows.withColumn("owner_id", F.when(F.col("ord") == 3, 2).otherwise(F.col("ord"))), "marked")
    try:
        alone, several = merge._singles(marked, "owner_id")
        plan = alone._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["ord"] for r in several.collect()) == [2, 3] and alone.count() == 38
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
