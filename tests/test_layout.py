from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import SMALL, executed_plan
from helpers import tuples
from mercato.plans.analytics import seller_footprint
from mercato.plans.marts import fct_orders
from mercato.sources import layout
from mercato.sources.layout import bucket_by_order, write_buckets, write_by_month


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_fact_has_no_shuffle(spark, lake, tmp_path, shuffled_joins):
    bucketed = bucket_by_order(lake, str(tmp_path), 4, "t1_")
    fact = fct_orders(bucketed)
    assert "Exchange" not in executed_plan(fact)
    assert fact.exceptAll(lake["fct_orders"]).isEmpty() and fact.count() == lake["fct_orders"].count()


def test_bucketed_reach_shuffles_no_lines(spark, lake, tmp_path, shuffled_joins):
    bucketed = bucket_by_order(lake, str(tmp_path), 4, "t2_")
    plan = executed_plan(seller_footprint(bucketed))
    assert not re.search(r"Exchange hashpartitioning\(order_id", plan)
    assert sorted(tuples(seller_footprint(bucketed))) == sorted(tuples(seller_footprint(lake)))


def test_a_table_is_always_bucketed_as_asked(spark, tmp_path):
    df = spark.range(90).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("order_id"))
    stored = write_buckets(df, "t3", str(tmp_path / "t3"), "order_id", 4)
    assert stored.count() == 90
    described = {row["col_name"]: row["data_type"] for row in spark.sql("describe extended t3").collect()}
    assert described["Num Buckets"] == "4"


def test_buckets_follow_the_size(spark, monkeypatch, tmp_path):
    spark.range(10_000).write.parquet(str(tmp_path / "n"))
    stored = spark.read.parquet(str(tmp_path / "n"))
    assert layout.buckets_for(stored) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(layout, "BUCKET_BYTES", 1_000)
    assert layout.buckets_for(stored) > 10


def test_months_and_statuses_are_skipped(spark, lake, tmp_path):
    stored = write_by_month(lake["fct_orders"], str(tmp_path / "fact"), "purchased_at", "order_status")
    assert stored.count() == lake["fct_orders"].count()
    some = stored.where("purchase_month between '1996-01' and '1996-03' and order_status = 'delivered'")
    plan = executed_plan(some)
    assert re.search(r"PartitionFilters: \[[^\]]*purchase_month", plan)
    assert "EqualTo(order_status,delivered)" in plan
    want = lake["fct_orders"].where(
        "purchased_at >= '1996-01-01' and purchased_at < '1996-04-01' and order_status = 'delivered'"
    )
    assert some.count() == want.count() > 0


def test_buckets_and_files_grow_with_the_table(spark):
    rows = spark.range(20_000_000)
    assert layout.buckets_for(rows) > spark.sparkContext.defaultParallelism
    assert layout.files_for(rows, least=4) == 10 and layout.files_for(spark.range(10), least=4) == 4


def test_deletes_start_from_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(layout, "FILE_BYTES", 500)
    monkeypatch.setattr(contract, "_AFTER_DELETE", {})
    assert contract._after_delete("orders", "order_status = 'shipped'", "payments")(spark, SMALL).count() > 0
    (store,) = contract._AFTER_DELETE.values()
    assert len(store.files("customers")) > 4


def test_tasks_whose_rows_can_be_sorted_in_memory(spark):
    contract._raw(spark, SMALL)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") in ("16m", str(16 << 20), f"{16 << 20}b")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("32m", str(32 << 20), f"{32 << 20}b")
