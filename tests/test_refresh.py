from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from conftest import executed_plan
from helpers import tuples, typed
from mercato.plans.marts import fct_orders
from mercato.plans.refresh import build_fact, changed_orders, refresh_fact, snapshot
from mercato.plans.removal import delete_rows
from mercato.schemas import LOAD_ORDER
from mercato.sources.store import Store

MOMENTS = ["2018-01-31 23:59:59", "2018-02-01 00:00:00", "2018-02-28 10:00:00", "2018-03-01 00:00:00", None]


def orders(spark, *numbers):
    rows = [
        {"order_id": f"o{n}", "customer_id": "c", "order_status": "shipped", "order_purchase_timestamp": MOMENTS[n % 5]}
        for n in numbers
    ]
    return typed(spark, "orders", rows)


def payments(spark, *keys):
    rows = [
        {"order_id": o, "payment_sequential": n, "payment_type": "boleto", "payment_installments": 1, "payment_value": 5}
        for o, n in keys
    ]
    return typed(spark, "payments", rows)


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    given = {"orders": orders(spark, 0, 1, 2, 3, 4), "payments": payments(spark, ("o0", 1), ("o3", 1))}
    for t in LOAD_ORDER:
        store.append(given.get(t.name, typed(spark, t.name, [])), t.name)
    return store


def same(spark, store, path):
    stored = spark.read.parquet(path).drop("purchase_month")
    whole = fct_orders(store).select(*stored.columns)
    return sorted(tuples(stored), key=repr) == sorted(tuples(whole), key=repr)


def files(path):
    return {folder: sorted(os.listdir(f"{path}/{folder}")) for folder in os.listdir(path) if "=" in folder}


def test_only_touched_months_are_written(spark, store, tmp_path):
    path = str(tmp_path / "fact")
    build_fact(store, path)
    assert same(spark, store, path)
    before, old = snapshot(store), files(path)
    assert refresh_fact(store, path, changed_orders(store, before)) == []
    # A new order in February, a late payment of one in March, one without a moment.
    store.append(orders(spark, 6, 9), "orders")
    store.append(payments(spark, ("o3", 2)), "payments")
    assert refresh_fact(store, path, changed_orders(store, before)) == [None, "2018-02", "2018-03"]
    assert same(spark, store, path)
    assert files(path)["purchase_month=2018-01"] == old["purchase_month=2018-01"]
    assert all(files(path)[m] != old[m] for m in old if m != "purchase_month=2018-01")
    # Once more gives the same.
    assert len(refresh_fact(store, path, changed_orders(store, before))) == 3
    assert same(spark, store, path)


def test_a_month_that_loses_its_orders_goes(spark, store, tmp_path):
    path = str(tmp_path / "fact")
    build_fact(store, path)
    gone = spark.createDataFrame([("o3",), ("o4",)], "order_id string")
    delete_rows(store, "orders", gone)
    assert refresh_fact(store, path, gone) == [None, "2018-03"]
    assert sorted(files(path)) == ["purchase_month=2018-01", "purchase_month=2018-02"]
    assert same(spark, store, path)


def test_months_are_ranges_of_the_scan(spark, store):
    from mercato.plans.refresh import _within

    plan = executed_plan(store["orders"].where(_within("order_purchase_timestamp", ["2018-02"])))
    # Plain comparisons of the column, which the scan takes over.
    assert "order_purchase_timestamp" in plan.split("PushedFilters")[1]
    assert ">= 2018-02-01 00:00:00" in plan and "< 2018-03-01 00:00:00" in plan
    got = store["orders"].where(_within("order_purchase_timestamp", ["2018-02", None])).orderBy("order_id")
    assert [r["order_id"] for r in got.select(F.col("order_id")).collect()] == ["o1", "o2", "o4"]
