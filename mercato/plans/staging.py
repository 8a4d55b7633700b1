"""Silver: renamed and derived columns, one lazily composed view per clean table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.times import days_between

Tables = Mapping[str, DataFrame]


def stg_orders(tables: Tables) -> DataFrame:
    delivered, estimated = F.col("delivered_at"), F.col("estimated_delivery_at")
    return (
        tables["orders"]
        .where("order_id is not null")
        .select(
            "order_id",
            "customer_id",
            "order_status",
            F.col("order_purchase_timestamp").alias("purchased_at"),
            F.col("order_approved_at").alias("approved_at"),
            F.col("order_delivered_carrier_date").alias("shipped_at"),
            F.col("order_delivered_customer_date").alias("delivered_at"),
            F.col("order_estimated_delivery_date").alias("estimated_delivery_at"),
        )
        .withColumns(
            {
                # Positive is late, negative is early.
                "delivery_delay_days": days_between(delivered, estimated),
                "is_on_time": F.coalesce(delivered <= estimated, F.lit(False)),
            }
        )
    )


def stg_customers(tables: Tables) -> DataFrame:
    return (
        tables["customers"]
        .where("customer_id is not null")
        .select(
            "customer_id",
            "customer_unique_id",
            F.col("customer_zip_code_prefix").alias("zip_code"),
            F.col("customer_city").alias("city"),
            F.col("customer_state").alias("state"),
        )
    )


def stg_sellers(tables: Tables) -> DataFrame:
    return (
        tables["sellers"]
        .where("seller_id is not null")
        .select(
            "seller_id",
            F.col("seller_zip_code_prefix").alias("zip_code"),
            F.col("seller_city").alias("city"),
            F.col("seller_state").alias("state"),
        )
    )


def stg_products(tables: Tables) -> DataFrame:
    return (
        tables["products"]
        .where("product_id is not null")
        .join(tables["product_category_name_translation"], "product_category_name", "left")
        .select(
            "product_id",
            "product_category_name",
            F.col("product_category_name_english").alias("category_name_english"),
            F.col("product_name_lenght").alias("product_name_length"),
            F.col("product_description_lenght").alias("product_description_length"),
            "product_photos_qty",
            F.col("product_weight_g").alias("weight_g"),
            F.col("product_length_cm").alias("length_cm"),
            F.col("product_height_cm").alias("height_cm"),
            F.col("product_width_cm").alias("width_cm"),
        )
    )


def stg_order_items(tables: Tables) -> DataFrame:
    return (
        tables["order_items"]
        .where("order_id is not null")
        .select(
            "order_id",
            "order_item_id",
            "product_id",
            "seller_id",
            "shipping_limit_date",
            "price",
            "freight_value",
            (F.col("price") + F.col("freight_value")).alias("total_amount"),
        )
    )


def stg_payments(tables: Tables) -> DataFrame:
    return (
        tables["payments"]
        .where("order_id is not null")
        .select("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value")
    )


def stg_order_reviews(tables: Tables) -> DataFrame:
    score = F.col("review_score")
    return (
        tables["order_reviews"]
        .where("review_id is not null")
        .select(
            "review_id",
            "order_id",
            "review_score",
            "review_comment_title",
            "review_comment_message",
            "review_creation_date",
            "review_answer_timestamp",
            # A missing score counts as negative.
            F.when(score >= 4, "positive").when(score == 3, "neutral").otherwise("negative").alias("sentiment"),
        )
    )


STAGING = {
    f.__name__: f
    for f in (
        stg_orders,
        stg_customers,
        stg_sellers,
        stg_products,
        stg_order_items,
        stg_payments,
        stg_order_reviews,
    )
}


def create_views(tables: Tables) -> None:
    """Register every staging model as a temporary view: nothing is computed."""
    for name, model in STAGING.items():
        model(tables).createOrReplaceTempView(name)
