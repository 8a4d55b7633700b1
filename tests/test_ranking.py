from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import executed_plan
from helpers import tuples
from mercato.operators.ranking import counted_ranks, rank_in_ranges

SLOW = settings(max_examples=50, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(
    values=st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=0, max_size=80), slices=st.integers(1, 9)
)
def test_ranges_give_the_rank(spark, values, slices):
    df = spark.createDataFrame(list(enumerate(values)), "n int, v int")
    expected = df.select("n", F.rank().over(Window.orderBy(F.col("v").desc_nulls_first())))
    ranked = rank_in_ranges(df, {"r": "v"}, slices)
    assert ranked.columns == ["n", "v", "r"]
    assert sorted(tuples(ranked.select("n", "r"))) == sorted(tuples(expected))


pairs = st.lists(st.tuples(st.one_of(st.none(), st.integers(-9, 9)), st.one_of(st.none(), st.integers(0, 3))), max_size=40)


@SLOW
@given(values=pairs, top=st.integers(0, 8))
def test_counting_gives_the_rank_of_the_rows_shown(spark, values, top):
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(values)], "n int, a int, b int")
    by = {c: F.rank().over(Window.orderBy(F.col(c).desc_nulls_first())) for c in "ab"}
    every = {r["n"]: tuple(r) for r in df.select("n", "a", "b", by["a"], by["b"]).collect()}
    shown = df.orderBy(F.desc("b"), "n").limit(top)
    ranked = counted_ranks(df, shown, {"rank_a": "a", "rank_b": "b"})
    assert ranked.columns == ["n", "a", "b", "rank_a", "rank_b"]
    assert sorted(tuples(ranked)) == sorted(every[r["n"]] for r in shown.collect())


def test_counting_runs_nothing_while_the_plan_is_built(spark, lake):
    from mercato.plans.analytics import seller_geographic_reach

    tables = {name: lake[name] for name in ("orders", "order_items", "customers", "sellers")}
    spark.sparkContext.setJobGroup("planning", "planning")
    report = seller_geographic_reach(tables)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("done", "done")
    report.collect()
    plan = executed_plan(report)
    assert "Window" not in plan and "rangepartitioning" not in plan.replace("rangepartitioning(geo_rank", "")


def test_one_value_holding_a_third_of_all_rows(spark):
    df = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1_000).cast("decimal(10,2)").alias("v")
    )
    expected = df.select("id", F.rank().over(Window.orderBy(F.desc("v"))).alias("r"))
    ranked = rank_in_ranges(df, {"r": "v"}).select("id", "r")
    assert ranked.exceptAll(expected.select("id", F.col("r").cast("bigint"))).isEmpty()


def test_only_range_totals_meet_in_one_task(spark):
    df = spark.range(1_000).withColumn("v", F.rand(1))
    lines = executed_plan(rank_in_ranges(df, {"r": "v"})).splitlines()
    single = [n for n, line in enumerate(lines) if "SinglePartition" in line]
    assert len(single) == 1
    below = next(line for line in lines[single[0] :] if "HashAggregate" in line)
    assert "_slice" in below


def test_a_value_of_nearly_all_rows_leaves_ranges_even(spark):
    """The cuts lie between distinct values, however many rows one of them has."""
    df = spark.range(200_000).select(F.when(F.col("id") % 100 > 0, 7).otherwise(F.col("id")).cast("bigint").alias("v"))
    counted = df.groupBy("v").count().repartitionByRange(16, F.desc("v"))
    sizes = [r["n"] for r in counted.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 4 * min(sizes)
    ranked = rank_in_ranges(df.where("v >= 190000 or v = 7"), {"r": "v"}, 16)
    assert ranked.where("v = 7").select("r").distinct().first()["r"] == 101
    assert ranked.agg(F.max("r")).first()[0] == 101
