from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import executed_plan
from helpers import tuples
from mercato.operators.upsert import insert_if_absent
from mercato.session import written
from mercato.sources.key_index import KeyIndex, located
from mercato.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), key_buckets=16)


def numbered(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("k"), "id").alias("key"), "id", (F.col("id") % 7).alias("v"))


def rows_read(df):
    """Rows that the scans of a plan gave out, as its metrics say."""
    df.collect()
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
            continue
        if "Scan" in plan.nodeName():
            total += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        plans += [children.apply(n) for n in range(children.size())]
    return total


def test_a_small_batch_reads_a_small_part_of_the_keys(spark, store):
    insert_if_absent(numbered(spark, 0, 4000), store, "t", ["key"])
    index = store.key_index("t", ["key"])
    one = rows_read(index.keys_near(written(numbered(spark, 17, 18), "one")))
    assert 100 < one < 500
    two = rows_read(index.keys_near(written(numbered(spark, 17, 19), "two")))
    assert one <= two <= 2.5 * one
    assert rows_read(index.keys_near(written(numbered(spark, 0, 4000), "all"))) == 4000
    # A bucket is a folder; the files hold the key alone.
    near = index.keys_near(written(numbered(spark, 17, 18), "again"))
    filters = next(line for line in executed_plan(near).splitlines() if "PartitionFilters" in line)
    assert "key_bucket" in filters.split("PartitionFilters")[1].split("]")[0] and near.columns == ["key"]


def test_the_index_follows_the_table(spark, store):
    assert insert_if_absent(numbered(spark, 0, 50), store, "t", ["key"], [["id"]]) == 50
    assert insert_if_absent(numbered(spark, 40, 60), store, "t", ["key"], [["id"]]) == 10
    for columns in (["key"], ["id"]):
        index = store.key_index("t", columns)
        stored = spark.read.parquet(index.folder).select(*columns)
        assert sorted(tuples(stored)) == sorted(tuples(store["t"].select(*columns)))
    # Another key, but a value of the second one that is taken.
    clash = numbered(spark, 5, 6).withColumn("key", F.lit("new"))
    assert insert_if_absent(clash, store, "t", ["key"], [["id"]]) == 0


def test_a_write_that_did_not_end_makes_the_index_anew(spark, store):
    insert_if_absent(numbered(spark, 0, 10), store, "t", ["key"])
    # Rows reached the table, their keys did not reach the index.
    store.key_index("t", ["key"]).begin()
    store.append(numbered(spark, 10, 20), "t")
    assert insert_if_absent(numbered(spark, 0, 25), store, "t", ["key"]) == 5
    assert store["t"].count() == store["t"].select("key").distinct().count() == 25


def test_a_store_without_an_index_gets_one(spark, store):
    store.append(numbered(spark, 0, 10), "t")
    assert insert_if_absent(numbered(spark, 5, 12), store, "t", ["key"]) == 2
    index = store.key_index("t", ["key"])
    assert index.is_whole()
    store.drop("t")
    assert not index.is_whole() and "t" not in store
    files, folder = located(spark, index.folder)
    assert not files.exists(folder)


def test_a_batch_that_is_stored_costs_its_keys(spark, store):
    rows = numbered(spark, 0, 30)
    insert_if_absent(rows, store, "t", ["key"])
    worked = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def touched(v):
        worked.add(1)
        return v

    assert insert_if_absent(rows.withColumn("v", touched("v")), store, "t", ["key"]) == 0
    assert worked.value == 0


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        index = KeyIndex(spark, str(tmp_path / "keys"), ["id"], 2)
        index.add(spark.range(0, 40000, 1, 8))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = spark.read.parquet(index.folder)
    assert stored.count() == 40000
    assert stored.where("key_bucket = 0").select(F.input_file_name()).distinct().count() > 1
