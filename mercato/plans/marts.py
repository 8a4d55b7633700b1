"""Gold: one wide order fact and four dimensions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.times import day_name, day_of_week, month_name
from mercato.plans.staging import (
    stg_customers,
    stg_order_items,
    stg_order_reviews,
    stg_orders,
    stg_payments,
    stg_products,
    stg_sellers,
)

Tables = Mapping[str, DataFrame]


def fct_orders(tables: Tables) -> DataFrame:
    """One row per order.

    The children are aggregated per order before the joins: lines and payments of an order do not
    multiply each other, a hot order shrinks before it is shuffled, and the joins reuse the
    partitioning of the aggregates.
    """
    items = (
        stg_order_items(tables)
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("item_count"),
            F.sum("price").alias("total_price"),
            F.sum("freight_value").alias("total_freight"),
            F.sum("total_amount").alias("total_order_value"),
        )
    )
    payments = (
        stg_payments(tables)
        .groupBy("order_id")
        .agg(
            F.sum("payment_value").alias("total_payment"),
            F.count(F.lit(1)).alias("payment_count"),
            # The alphabetically last type, whatever its share.
            F.max("payment_type").alias("primary_payment_type"),
        )
    )
    reviews = stg_order_reviews(tables).select("order_id", "review_score", "sentiment")
    return (
        stg_orders(tables)
        .join(items, "order_id", "left")
        .join(payments, "order_id", "left")
        .join(reviews, "order_id", "left")
    )


def dim_customers(tables: Tables) -> DataFrame:
    return stg_customers(tables).select("customer_id", "customer_unique_id", "zip_code", "city", "state")


def dim_sellers(tables: Tables) -> DataFrame:
    return stg_sellers(tables).select("seller_id", "zip_code", "city", "state")


def dim_products(tables: Tables) -> DataFrame:
    return stg_products(tables).select(
        "product_id",
        "product_category_name",
        "category_name_english",
        "product_photos_qty",
        "weight_g",
        "length_cm",
        "height_cm",
        "width_cm",
    )


def dim_dates(tables: Tables) -> DataFrame:
    """The days with a purchase. All attributes follow from the day, so only days are deduplicated."""
    day = F.col("date_day")
    return (
        stg_orders(tables)
        .where("purchased_at is not null")
        .select(F.to_date("purchased_at").alias("date_day"))
        .distinct()
        .select(
            "date_day",
            F.year(day).alias("year_num"),
            F.month(day).alias("month_num"),
            F.dayofmonth(day).alias("day_num"),
            day_of_week(day).alias("day_of_week"),
            month_name(day).alias("month_name"),
            day_name(day).alias("day_name"),
            F.coalesce(day_of_week(day).isin(0, 6), F.lit(False)).alias("is_weekend"),
        )
        .orderBy("date_day")
    )


MARTS: dict[str, Callable[[Tables], DataFrame]] = {
    f.__name__: f for f in (fct_orders, dim_customers, dim_sellers, dim_products, dim_dates)
}


def save_marts(spark: SparkSession, tables: Tables, database: str = "marts", folder: str | None = None) -> None:
    """Rebuild every mart as a catalog table, below ``folder`` or in the warehouse."""
    spark.sql(f"create database if not exists {database}")
    for name, model in MARTS.items():
        writer = model(tables).write.mode("overwrite")
        if folder:
            writer = writer.option("path", f"{folder.rstrip('/')}/{name}")
        writer.saveAsTable(f"{database}.{name}")
