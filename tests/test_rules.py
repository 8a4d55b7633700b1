from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import executed_plan
from helpers import column, tuples
from mercato.operators.keys import anti_filter, drop_null, in_domain, keep_first, null_orphans, semi_filter
from mercato.operators.rules import FirstOf, HasParent, Keep, apply_rules, count_rejects, required

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SLOW
@given(keys=st.lists(st.integers(0, 6), min_size=1, max_size=60), parts=st.integers(1, 7))
def test_keep_first_does_not_depend_on_partitions(spark, keys, parts):
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k int, _arrival_0 int").repartition(parts)
    first = {k: n for n, k in reversed(list(enumerate(keys)))}
    assert dict(tuples(keep_first(df, ["k"]))) == first


def test_keep_first_without_an_order_is_refused(spark):
    with pytest.raises(ValueError):
        keep_first(spark.range(3), ["id"])


def test_copies_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("_arrival_0"))
    lines = executed_plan(keep_first(df, ["k"])).splitlines()
    at = {part: n for n, line in enumerate(lines) for part in ("Partial", "Exchange", "Final") if part in line}
    assert at["Final"] < at["Exchange"] < at["Partial"]


def test_membership(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, k string")
    parents = spark.createDataFrame([("a",), ("z",)], "key string")
    assert tuples(semi_filter(df, "k", parents, "key")) == [(1, "a")]
    assert sorted(tuples(null_orphans(df, "k", parents, "key"))) == [(1, "a"), (2, None), (3, None)]
    stored = spark.createDataFrame([(2, "other")], "n int, k string")
    assert sorted(column(anti_filter(df, ["n"], stored), "n")) == [1, 3]
    assert column(drop_null(df, ["k"]), "n") == [1, 2]
    assert column(df.where(in_domain("k", ("b", "c"))), "n") == [2]


def rules(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    return [
        required("k"),
        FirstOf("repeated", ("k",)),
        HasParent("orphan", "p", parents, "id"),
        Keep("too small", F.col("v") > 0),
        FirstOf("second of its parent", ("p",)),
    ]


def test_losses_add_up(spark):
    data = [
        (None, 1, 5),
        ("a", 1, 0),
        ("a", 1, 9),
        ("b", 7, 5),
        ("c", 2, 5),
        ("d", 2, 6),
        ("e", 1, None),
        ("f", None, 1),
    ]
    df = spark.createDataFrame([(*row, n) for n, row in enumerate(data)], "k string, p int, v int, _arrival_0 int")
    assert column(apply_rules(df, rules(spark)), "k") == ["c"]
    report = count_rejects(df, "t", rules(spark)).orderBy("step")
    assert tuples(report.select("step", "rule", "rows_left", "rows_dropped")) == [
        (0, "input", 8, 0),
        (1, "missing k", 7, 1),
        (2, "repeated", 6, 1),
        (3, "orphan", 4, 2),
        (4, "too small", 2, 2),
        (5, "second of its parent", 1, 1),
    ]


def test_report_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, p int, v int, _arrival_0 int")
    assert column(count_rejects(df, "t", rules(spark)), "rows_left") == [0] * 6
