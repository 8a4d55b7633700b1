"""The order fact by month, brought up to date by the months that a load or a delete touched."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.plans.marts import fct_orders
from mercato.sources.key_index import located
from mercato.sources.layout import ORDER_TABLES, write_by_month
from mercato.sources.store import Store

MONTH, MOMENT, SORT = "purchase_month", "purchased_at", "order_status"
Snapshot = Mapping[str, set[str]]


def snapshot(store: Store) -> Snapshot:
    """The files of the tables that the fact is made of, to be taken before a load."""
    return {name: store.files(name) for name in ORDER_TABLES}


def changed_orders(store: Store, before: Snapshot) -> DataFrame:
    """The orders that have rows in files written since: new ones, and old ones with new lines, payments or reviews."""
    found = []
    for name in ORDER_TABLES:
        new = sorted(store.files(name) - before[name])
        if new:
            found.append(store.spark.read.schema(store[name].schema).parquet(*new).select("order_id"))
    if not found:
        return store["orders"].select("order_id").limit(0)
    return reduce(DataFrame.union, found).distinct()


def build_fact(store: Store, path: str) -> DataFrame:
    """The whole fact, one folder for each month of purchase."""
    return write_by_month(fct_orders(store), path, MOMENT, SORT, MONTH)


def refresh_fact(store: Store, path: str, changed: DataFrame) -> list[str | None]:
    """Write the months of the changed orders anew and return them; no other month is read or written.

    A month is worked out from its orders and their children alone, and replaced as a whole, so a refresh that is broken
    off can be run again. An order that was deleted is looked up in the fact. The list of months comes to the driver.
    """
    spark = store.spark
    month = F.date_format("order_purchase_timestamp", "yyyy-MM")
    fact = spark.read.option("basePath", path).parquet(path)
    now = store["orders"].join(changed, "order_id", "left_semi").select(month.alias(MONTH))
    then = fact.select("order_id", F.col(MONTH).cast("string")).join(changed, "order_id", "left_semi").select(MONTH)
    months = [r[0] for r in now.union(then).distinct().orderBy(MONTH).collect()]
    if not months:
        return []
    orders = store["orders"].where(_within("order_purchase_timestamp", months))
    ids = orders.select("order_id")
    children = {name: store[name].join(ids, "order_id", "left_semi") for name in ORDER_TABLES[1:]}
    fresh = fct_orders({**{name: store[name] for name in store}, "orders": orders, **children})
    write_by_month(fresh, path, MOMENT, SORT, MONTH, only_months=True)
    # A month that has lost its last order is not among those written.
    left = {r[0] for r in orders.select(month).distinct().collect()}
    for gone in [m for m in months if m not in left]:
        name = "__HIVE_DEFAULT_PARTITION__" if gone is None else gone
        system, folder = located(spark, f"{path}/{MONTH}={name}")
        system.delete(folder, True)
    spark.catalog.refreshByPath(path)
    return months


def _within(moment: str, months: list[str | None]) -> Column:
    """Moments of these months, as ranges that the scan can skip row groups by."""
    ranges = [
        (F.col(moment) >= F.lit(f"{m}-01").cast("timestamp"))
        & (F.col(moment) < F.add_months(F.lit(f"{m}-01").cast("date"), 1).cast("timestamp"))
        for m in months
        if m is not None
    ]
    if None in months:
        ranges.append(F.col(moment).isNull())
    return reduce(Column.__or__, ranges)
