from __future__ import annotations

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from conftest import executed_plan
from helpers import column, dec, tuples, typed
from mercato.plans import extensions
from mercato.plans.analytics import (
    monthly_revenue_trend,
    payment_installments_by_state,
    seller_footprint,
    seller_geographic_reach,
)


def cents(value) -> Decimal:
    return Decimal(value).quantize(Decimal("0.01"), ROUND_HALF_UP)


def marketplace(spark, sales, months=None, payments=()):
    """``sales``: (order, state, seller, price). An order is delivered unless its name starts with x."""
    states = {o: s for o, s, _, _ in sales}
    orders = [
        {
            "order_id": o,
            "customer_id": f"c-{o}",
            "order_status": "shipped" if o.startswith("x") else "delivered",
            "order_purchase_timestamp": (months or {}).get(o),
        }
        for o in states
    ]
    customers = [{"customer_id": f"c-{o}", "customer_unique_id": o, "customer_state": s} for o, s in states.items()]
    items = [
        {
            "order_id": o,
            "order_item_id": n + 1,
            "product_id": "p",
            "seller_id": seller,
            "price": price,
            "freight_value": "0.00",
        }
        for n, (o, _, seller, price) in enumerate(sales)
    ]
    names = ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value")
    return {
        "orders": typed(spark, "orders", orders),
        "customers": typed(spark, "customers", customers),
        "order_items": typed(spark, "order_items", items),
        "sellers": typed(spark, "sellers", [{"seller_id": s} for s in {s for _, _, s, _ in sales}]),
        "payments": typed(spark, "payments", [dict(zip(names, p)) for p in payments]),
    }


def sales_to(seller, states, orders, price="1.00"):
    return [(f"{seller}-{n}", f"S{n % states}", seller, price) for n in range(orders)]


def test_reach(spark):
    sales = [
        *sales_to("one", 1, 3, "10.00"),
        *sales_to("two", 2, 3, "5.00"),
        *sales_to("eight", 8, 8, "2.00"),
        *sales_to("nine", 9, 9, "30.00"),
        *sales_to("few", 2, 2, "99.00"),
        *sales_to("tie", 2, 6, "2.50"),
        *[(f"x{o}", s, "two", "500.00") for o, s, _, _ in sales_to("y", 3, 3)],
    ]
    got = seller_geographic_reach(marketplace(spark, sales))
    columns = ["seller_id", "states_reached", "total_orders", "total_revenue", "seller_tier", "geo_rank", "rev_rank"]
    assert tuples(got.select(*columns, "efficiency_gap")) == [
        ("nine", 9, 9, dec("270.00"), "national", 1, 1, 0),
        ("eight", 8, 8, dec("16.00"), "regional", 2, 3, 1),
        ("tie", 2, 6, dec("15.00"), "regional", 3, 4, 1),
        ("two", 2, 3, dec("15.00"), "regional", 3, 4, 1),
        ("one", 1, 3, dec("30.00"), "local", 5, 2, -3),
    ]
    assert got.limit(2).count() == 2
    assert column(seller_geographic_reach(marketplace(spark, sales), top=1), "seller_id") == ["nine"]


def test_reach_counts_an_order_with_several_lines_once(spark):
    sales = [("a", "S", "v", "1.00"), ("a", "S", "v", "2.00"), ("a", "S", "w", "9.00"), ("b", "T", "v", "2.00")]
    got = seller_footprint(marketplace(spark, sales), min_orders=1).orderBy("seller_id")
    assert tuples(got) == [("v", 2, 2, dec("5.00"), dec("1.67")), ("w", 1, 1, dec("9.00"), dec("9.00"))]


def test_footprint_equals_distinct_counts_on_the_sample(lake):
    plain = (
        lake["order_items"]
        .join(lake["orders"].where("order_status = 'delivered'"), "order_id")
        .join(lake["customers"], "customer_id")
        .groupBy("seller_id")
        .agg(
            F.countDistinct("customer_state").alias("states_reached"),
            F.countDistinct("order_id").alias("total_orders"),
            F.sum(F.col("price") + F.col("freight_value")).alias("total_revenue"),
        )
    )
    ours = seller_footprint(lake, 0).drop("avg_order_value")
    assert sorted(tuples(plain)) == sorted(tuples(ours))
    assert "Expand" in executed_plan(plain) and "Expand" not in executed_plan(ours)


def test_installments(spark):
    def paid(order, n, installments, value, kind="credit_card"):
        return (order, n, kind, installments, value)

    sales = [(f"{s}{n}", s, "v", "1.00") for s in ("A", "B", "C", "D", "E") for n in range(3)] + [("F0", "F", "v", "1")]
    payments = [paid(o, 1, 2, "10.00") for o, s, _, _ in sales if s in "AB"]
    payments += [paid(o, 1, 1, "20.00") for o, s, _, _ in sales if s in "CD"]
    payments += [paid("E0", 1, 3, "1.00"), paid("E0", 2, 4, "2.00"), paid("E1", 1, 1, "4.00"), paid("E2", 1, 9, "1")]
    payments += [paid("F0", 1, 9, "1.00"), paid("C0", 2, 9, "1.00", "voucher")]
    payments = [p if p[0] != "E2" else paid("E2", 1, 1, "1.01") for p in payments]
    got = payment_installments_by_state(marketplace(spark, sales, payments=payments), min_orders=3)
    # State means are 2.25, 2, 2, 1, 1; the mean of these is 1.65.
    assert tuples(got) == [
        ("E", 3, dec("2.25"), dec("2.00"), dec("8.01"), dec("50.00"), "high installment state", 1, 5, dec("0.60")),
        ("A", 3, dec("2.00"), dec("10.00"), dec("30.00"), dec("100.00"), "high installment state", 2, 3, dec("0.35")),
        ("B", 3, dec("2.00"), dec("10.00"), dec("30.00"), dec("100.00"), "above average", 2, 3, dec("0.35")),
        ("C", 3, dec("1.00"), dec("20.00"), dec("60.00"), dec("0.00"), "below average", 4, 1, dec("-0.65")),
        ("D", 3, dec("1.00"), dec("20.00"), dec("60.00"), dec("0.00"), "low installment state", 4, 1, dec("-0.65")),
    ]
    assert payment_installments_by_state(marketplace(spark, sales, payments=payments), min_orders=4).count() == 0


def test_trend(spark):
    # No orders in March; April hardly differs; nothing earned in May.
    plan = {"01": "100000.00", "02": "50000.00", "04": "50002.00", "05": "0.00", "06": "10.00"}
    sales = [(f"o{m}", "S", "v", price) for m, price in plan.items()] + [("o01", "S", "w", "0.00")]
    months = {f"o{m}": f"2017-{m}-15 10:00:00" for m in plan}
    got = monthly_revenue_trend(marketplace(spark, sales, months)).drop("monthly_revenue")
    assert tuples(got) == [
        ("2017-01", 1, 2, dec("100000.00"), None, None, "first month"),
        ("2017-02", 1, 1, dec("150000.00"), dec("100000.00"), dec("-50.00"), "decline"),
        ("2017-04", 1, 1, dec("200002.00"), dec("50000.00"), dec("0.00"), "flat"),
        ("2017-05", 1, 1, dec("200002.00"), dec("50002.00"), dec("-100.00"), "decline"),
        ("2017-06", 1, 1, dec("200012.00"), dec("0.00"), None, "first month"),
    ]


def test_running_total_ends_at_the_sum(lake):
    rows = monthly_revenue_trend(lake).collect()
    assert len(rows) == 80
    assert rows[-1]["cumulative_revenue"] == sum(r["monthly_revenue"] for r in rows)
    assert [r["month"] for r in rows] == sorted(r["month"] for r in rows)


def test_category_revenue_against_plain_python(lake):
    english = dict(tuples(lake["product_category_name_translation"]))
    category = {r["product_id"]: r["product_category_name"] for r in lake["products"].collect()}
    revenue, orders = defaultdict(Decimal), defaultdict(set)
    for line in lake["order_items"].collect():
        name = english.get(category[line["product_id"]], "no category")
        revenue[name] += line["price"] + line["freight_value"]
        orders[name].add(line["order_id"])
    got = extensions.revenue_by_category(lake).select("category", "total_orders", "total_revenue")
    assert sorted(tuples(got)) == sorted((n, len(orders[n]), revenue[n]) for n in revenue)


def test_returning_shoppers(spark):
    tables = {
        "customers": typed(
            spark,
            "customers",
            [{"customer_id": f"c{n}", "customer_unique_id": u} for n, u in enumerate(["u", "u", "v", "w"])],
        ),
        "orders": typed(
            spark,
            "orders",
            [{"order_id": f"o{n}", "customer_id": f"c{n % 4}", "order_status": "shipped"} for n in range(4)],
        ),
    }
    assert sorted(tuples(extensions.returning_shoppers(tables))) == [(1, 2, dec("66.67")), (2, 1, dec("33.33"))]


def test_delay_buckets(spark):
    fact = spark.createDataFrame(
        [(None, 1), (-2.0, 5), (0.0, 4), (0.5, 3), (3.0, 3), (6.0, None), (8.0, 1), (9.0, 2)],
        "delivery_delay_days double, review_score int",
    ).withColumn(
        "sentiment",
        F.when(F.col("review_score") >= 4, "positive")
        .when(F.col("review_score") == 3, "neutral")
        .when(F.col("review_score").isNotNull(), "negative"),
    )
    got = extensions.delay_impact_on_reviews(fact).select(
        "delay_bucket", "total_orders", "reviewed_orders", "avg_review_score", "pct_negative"
    )
    assert sorted(tuples(got)) == [
        ("not delivered", 1, 1, dec("1.00"), dec("100.00")),
        ("on time", 2, 2, dec("4.50"), dec("0.00")),
        ("over 7 days late", 2, 2, dec("1.50"), dec("100.00")),
        ("up to 3 days late", 2, 2, dec("3.00"), dec("0.00")),
        ("up to 7 days late", 1, 0, None, None),
    ]


def test_delays_of_a_large_group_do_not_overflow(spark):
    """Four million orders of one month and state, each 35 days late."""
    from mercato.plans.extensions import delivery_delay_summary

    orders = spark.range(4_000_000).selectExpr(
        "cast(id as string) as order_id", "'c' as customer_id", "'delivered' as order_status",
        "timestamp'2018-01-02' as order_purchase_timestamp", "timestamp'2018-01-02' as order_approved_at",
        "timestamp'2018-01-03' as order_delivered_carrier_date",
        "timestamp'2018-03-08' as order_delivered_customer_date",
        "timestamp'2018-02-01' as order_estimated_delivery_date",
    )
    customers = spark.sql(
        "select 'c' as customer_id, 'u' as customer_unique_id, '00001' as customer_zip_code_prefix,"
        " 'x' as customer_city, 'SP' as customer_state"
    )
    row = delivery_delay_summary({"orders": orders, "customers": customers}).first()
    assert row["delivered_orders"] == 4_000_000 and float(row["avg_delay_days"]) == 35.0


def test_months_are_counted_without_expanding_lines(lake):
    from conftest import executed_plan
    from mercato.plans.analytics import monthly_revenue_trend

    assert "Expand" not in executed_plan(monthly_revenue_trend(lake))
