"""Reports over the clean tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.numbers import exact_ratio, percent
from mercato.operators.ranking import counted_ranks

Tables = Mapping[str, DataFrame]

# The most states a local and a regional seller ships to.
LOCAL_STATES, REGIONAL_STATES = 1, 8
# Names of the quarters of states, from most instalments to fewest.
INSTALLMENT_PROFILES = ("high installment state", "above average", "below average", "low installment state")


def _delivered(tables: Tables) -> DataFrame:
    return tables["orders"].where("order_status = 'delivered'").select("order_id", "customer_id")


def _states(tables: Tables) -> DataFrame:
    return tables["customers"].select("customer_id", "customer_state")


def seller_footprint(tables: Tables, min_orders: int = 3) -> DataFrame:
    """Per seller: states reached, orders, revenue and mean line amount, delivered orders only.

    Lines shrink to one row per order and seller right after the join on the order, whose
    partitioning they still have. Orders are then counted as rows, so the only distinct aggregate
    is the one over states, of which a seller has few.
    """
    per_order = (
        tables["order_items"]
        .selectExpr("order_id", "seller_id", "price + freight_value as amount")
        .join(_delivered(tables), "order_id")
        .groupBy("order_id", "customer_id", "seller_id")
        .agg(F.sum("amount").alias("amount"), F.count("amount").alias("lines"))
    )
    return (
        per_order.join(_states(tables), "customer_id")
        .groupBy("seller_id")
        .agg(
            F.countDistinct("customer_state").alias("states_reached"),
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("amount").alias("amount"),
            F.sum("lines").alias("lines"),
        )
        .where(F.col("total_orders") >= min_orders)
        .select(
            "seller_id",
            "states_reached",
            "total_orders",
            # Null without a line that has an amount, as the sum is. Said by the number of lines, so that every reader
            # of the footprint needs the same columns and Spark shuffles for all of them once.
            F.when(F.col("lines") > 0, F.round("amount", 2)).alias("total_revenue"),
            F.round(exact_ratio(F.col("amount"), F.col("lines")), 2).alias("avg_order_value"),
        )
    )


def seller_geographic_reach(tables: Tables, min_orders: int = 3, top: int = 50) -> DataFrame:
    """The sellers that ship to most states, against their rank by revenue.

    A positive gap is a wide reach with little revenue. Ties at the cut go by seller id. Only the sellers shown are
    ranked, by counting those above them.
    """
    sellers = tables["sellers"].select("seller_id", "seller_city", "seller_state")
    footprint = seller_footprint(tables, min_orders)
    widest = [F.col("states_reached").desc_nulls_first(), F.col("seller_id")]
    shown = footprint.join(sellers, "seller_id").orderBy(*widest).limit(top)
    ranked = counted_ranks(footprint, shown, {"geo_rank": "states_reached", "rev_rank": "total_revenue"})
    states = F.col("states_reached")
    tier = (
        F.when(states > REGIONAL_STATES, "national")
        .when(states > LOCAL_STATES, "regional")
        .when(states == LOCAL_STATES, "local")
    )
    return ranked.select(
        "seller_id",
        "seller_city",
        "seller_state",
        "states_reached",
        "total_orders",
        "total_revenue",
        "avg_order_value",
        tier.alias("seller_tier"),
        "geo_rank",
        "rev_rank",
        (F.col("rev_rank") - F.col("geo_rank")).alias("efficiency_gap"),
    ).orderBy("geo_rank", "seller_id")


def payment_installments_by_state(tables: Tables, min_orders: int = 100) -> DataFrame:
    """How far customers of each state spread credit card payments over instalments.

    Payments are reduced per order before the join. There are as many rows as states from the
    second aggregate on, so the windows over all of them are small.
    """
    per_order = (
        tables["payments"]
        .where("payment_type = 'credit_card'")
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("payments"),
            F.count_if(F.col("payment_installments") > 1).alias("split_payments"),
            F.sum("payment_installments").alias("installments"),
            F.sum("payment_value").alias("value"),
        )
    )
    states = (
        per_order.join(_delivered(tables), "order_id")
        .join(_states(tables), "customer_id")
        .groupBy("customer_state")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.round(exact_ratio(F.sum("installments"), F.sum("payments")), 2).alias("avg_installments"),
            F.round(exact_ratio(F.sum("value"), F.sum("payments")), 2).alias("avg_payment_value"),
            F.round(F.sum("value"), 2).alias("total_revenue"),
            percent(F.sum("split_payments"), F.sum("payments")).alias("pct_installment_orders"),
        )
        .where(F.col("total_orders") >= min_orders)
    )
    by_installments = Window.orderBy(F.col("avg_installments").desc_nulls_first())
    by_value = Window.orderBy(F.col("avg_payment_value").desc_nulls_first())
    quarters = Window.orderBy(F.col("avg_installments").desc_nulls_first(), "customer_state")
    overall = exact_ratio(
        F.sum("avg_installments").over(Window.partitionBy()), F.count("avg_installments").over(Window.partitionBy())
    )
    return (
        states.withColumns(
            {
                "quarter": F.ntile(4).over(quarters),
                "installment_rank": F.rank().over(by_installments),
                "spending_rank": F.rank().over(by_value),
                "diff_from_avg": F.round(F.col("avg_installments") - overall, 2),
            }
        )
        .select(
            "customer_state",
            "total_orders",
            "avg_installments",
            "avg_payment_value",
            "total_revenue",
            "pct_installment_orders",
            F.element_at(F.array(*map(F.lit, INSTALLMENT_PROFILES)), F.col("quarter")).alias("installment_profile"),
            "installment_rank",
            "spending_rank",
            "diff_from_avg",
        )
        .orderBy("installment_rank", "customer_state")
    )


def monthly_revenue_trend(tables: Tables) -> DataFrame:
    """Orders, revenue and sellers per month of purchase, with running total and growth.

    The previous month is the last one with orders. From the aggregate on there is one row per
    month, so the windows over all months are small.
    """
    orders = (
        tables["orders"]
        .where("order_status = 'delivered' and order_purchase_timestamp is not null")
        .select("order_id", F.trunc("order_purchase_timestamp", "month").alias("order_month"))
    )
    lines = tables["order_items"].select(
        "order_id", "seller_id", (F.col("price") + F.col("freight_value")).alias("amount")
    )
    # One row per order and seller where the join has put them; one of an order's rows counts the order. Sellers are
    # then one row per month, and nothing is left to count as distinct.
    per_seller = (
        orders.join(lines, "order_id")
        .groupBy("order_id", "order_month", "seller_id")
        .agg(F.sum("amount").alias("amount"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("order_id").orderBy("seller_id")))
        .groupBy("order_month", "seller_id")
        .agg(F.sum("amount").alias("amount"), F.count_if(F.col("nth") == 1).alias("orders"))
    )
    months = per_seller.groupBy("order_month").agg(
        F.sum("orders").alias("total_orders"),
        F.round(F.sum("amount"), 2).alias("monthly_revenue"),
        F.count("seller_id").alias("active_sellers"),
    )
    by_month = Window.orderBy("order_month")
    revenue, previous, growth = F.col("monthly_revenue"), F.col("prev_month_revenue"), F.col("mom_growth_pct")
    return (
        months.withColumns(
            {
                "cumulative_revenue": F.sum(revenue).over(
                    by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
                ),
                "prev_month_revenue": F.lag(revenue, 1).over(by_month),
            }
        )
        .withColumn("mom_growth_pct", percent(revenue - previous, previous))
        .orderBy("order_month")
        .select(
            F.date_format("order_month", "yyyy-MM").alias("month"),
            "total_orders",
            "monthly_revenue",
            "active_sellers",
            "cumulative_revenue",
            "prev_month_revenue",
            "mom_growth_pct",
            # No growth figure: the first month, or nothing sold in the month before.
            F.when(growth > 0, "growth")
            .when(growth < 0, "decline")
            .when(growth == 0, "flat")
            .otherwise("first month")
            .alias("trend"),
        )
    )
