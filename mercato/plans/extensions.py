"""Reports that the schema is prepared for, beyond the three main ones."""

from __future__ import annotations

import math
from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.numbers import exact_average, exact_ratio, percent
from mercato.plans.staging import stg_customers, stg_order_items, stg_orders, stg_products, stg_sellers
from mercato.session import written

Tables = Mapping[str, DataFrame]


def delay_impact_on_reviews(fct_orders: DataFrame) -> DataFrame:
    """Review score and sentiment by how late the order came."""
    delay = F.col("delivery_delay_days")
    bucket = (
        F.when(delay.isNull(), "not delivered")
        .when(delay <= 0, "on time")
        .when(delay <= 3, "up to 3 days late")
        .when(delay <= 7, "up to 7 days late")
        .otherwise("over 7 days late")
    )
    sentiment = F.col("sentiment")
    return (
        fct_orders.groupBy(bucket.alias("delay_bucket"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.count("review_score").alias("reviewed_orders"),
            F.round(exact_average(F.col("review_score").cast("bigint")), 2).alias("avg_review_score"),
            F.count_if(sentiment == "positive").alias("positive_reviews"),
            F.count_if(sentiment == "neutral").alias("neutral_reviews"),
            F.count_if(sentiment == "negative").alias("negative_reviews"),
        )
        .withColumn("pct_negative", percent(F.col("negative_reviews"), F.col("reviewed_orders")))
    )


def revenue_by_category(tables: Tables) -> DataFrame:
    """Lines, orders and revenue per English category name."""
    products = stg_products(tables).select("product_id", "category_name_english")
    return (
        stg_order_items(tables)
        .select("order_id", "product_id", "total_amount")
        .join(products, "product_id")
        .groupBy(F.coalesce("category_name_english", F.lit("no category")).alias("category"))
        .agg(
            F.count(F.lit(1)).alias("total_items"),
            F.countDistinct("order_id").alias("total_orders"),
            F.sum("total_amount").alias("total_revenue"),
        )
    )


def review_score_distribution(tables: Tables) -> DataFrame:
    """Reviews per score and their share."""
    scores = tables["order_reviews"].groupBy("review_score").agg(F.count(F.lit(1)).alias("reviews"))
    return scores.withColumn("pct_reviews", percent(F.col("reviews"), F.sum("reviews").over(Window.partitionBy())))


def seller_performance(tables: Tables) -> DataFrame:
    """Per seller: lines, orders, revenue, and the share of delivered orders that came late."""
    orders = stg_orders(tables).select("order_id", "delivered_at", "is_on_time")
    per_order = (
        stg_order_items(tables)
        .select("order_id", "seller_id", "total_amount")
        .join(orders, "order_id")
        .groupBy("order_id", "seller_id", "delivered_at", "is_on_time")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("total_amount").alias("amount"))
    )
    delivered = F.col("delivered_at").isNotNull()
    return (
        per_order.groupBy("seller_id")
        .agg(
            F.sum("items").alias("total_items"),
            F.count(F.lit(1)).alias("total_orders"),
            F.sum("amount").alias("total_revenue"),
            F.count_if(delivered).alias("delivered_orders"),
            F.count_if(delivered & ~F.col("is_on_time")).alias("late_orders"),
        )
        .withColumn("pct_late", percent(F.col("late_orders"), F.col("delivered_orders")))
    )


def delivery_delay_summary(tables: Tables) -> DataFrame:
    """Delivered orders per purchase month and customer state: mean delay and share of late ones."""
    # Whole microseconds as decimals: they add up exactly and do not overflow.
    delay = (F.unix_micros("delivered_at") - F.unix_micros("estimated_delivery_at")).cast("decimal(18,0)")
    orders = (
        stg_orders(tables)
        .where("delivered_at is not null")
        .select(
            "customer_id",
            F.date_format("purchased_at", "yyyy-MM").alias("month"),
            delay.alias("delay"),
            "is_on_time",
        )
    )
    customers = stg_customers(tables).select("customer_id", "state")
    return (
        orders.join(customers, "customer_id")
        .groupBy("month", "state")
        .agg(
            F.count(F.lit(1)).alias("delivered_orders"),
            F.round(
                exact_ratio(F.sum("delay") * F.lit(Decimal("0.000001")), F.count("delay")) / F.lit(86_400), 2
            ).alias("avg_delay_days"),
            F.count_if(~F.col("is_on_time")).alias("late_orders"),
        )
        .withColumn("pct_late", percent(F.col("late_orders"), F.col("delivered_orders")))
    )


def with_location(people: DataFrame, geolocation: DataFrame) -> DataFrame:
    """Customers or sellers (staging form) with the position of their postal prefix."""
    places = geolocation.select(
        F.col("geolocation_zip_code_prefix").alias("zip_code"),
        F.col("geolocation_lat").alias("latitude"),
        F.col("geolocation_lng").alias("longitude"),
    )
    return people.join(places, "zip_code", "left").select(*people.columns, "latitude", "longitude")


def geo_customers(tables: Tables) -> DataFrame:
    return with_location(stg_customers(tables), tables["geolocation"])


def geo_sellers(tables: Tables) -> DataFrame:
    return with_location(stg_sellers(tables), tables["geolocation"])


def trade_between_states(tables: Tables) -> DataFrame:
    """Lines and revenue from each seller state to each customer state."""
    buyers = (
        stg_orders(tables)
        .select("order_id", "customer_id")
        .join(stg_customers(tables).select("customer_id", F.col("state").alias("customer_state")), "customer_id")
        .select("order_id", "customer_state")
    )
    origins = stg_sellers(tables).select("seller_id", F.col("state").alias("seller_state"))
    return (
        stg_order_items(tables)
        .select("order_id", "seller_id", "total_amount")
        .join(buyers, "order_id")
        # Lines shrink to (seller, state) before they meet the sellers.
        .groupBy("seller_id", "customer_state")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("total_amount").alias("amount"))
        .join(origins, "seller_id")
        .groupBy("seller_state", "customer_state")
        .agg(F.sum("items").alias("total_items"), F.sum("amount").alias("total_revenue"))
    )


def returning_shoppers(tables: Tables) -> DataFrame:
    """How many persons placed one order, two orders and so on."""
    people = stg_customers(tables).select("customer_id", "customer_unique_id")
    orders = stg_orders(tables).groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"))
    per_person = (
        orders.join(people, "customer_id").groupBy("customer_unique_id").agg(F.sum("orders").alias("orders_placed"))
    )
    groups = per_person.groupBy("orders_placed").agg(F.count(F.lit(1)).alias("shoppers"))
    return groups.withColumn("pct_shoppers", percent(F.col("shoppers"), F.sum("shoppers").over(Window.partitionBy())))


def first_purchases(tables: Tables, known: DataFrame | None = None) -> DataFrame:
    """Month of the first order of each shopper (customer_unique_id, cohort_month).

    With ``known``, an earlier result, ``tables`` need only hold the orders since: a first month can only move to an
    earlier one, so the running state is the lesser of both. Orders shrink to one row for each shopper in every task.
    """
    people = stg_customers(tables).select("customer_id", "customer_unique_id")
    orders = stg_orders(tables).where("purchased_at is not null")
    months = orders.select("customer_id", F.trunc("purchased_at", "month").alias("cohort_month"))
    seen = months.join(people, "customer_id").select("customer_unique_id", "cohort_month")
    if known is not None:
        seen = seen.unionByName(known.select("customer_unique_id", "cohort_month"))
    return seen.groupBy("customer_unique_id").agg(F.min("cohort_month").alias("cohort_month"))


def cohorts(tables: Tables, first: DataFrame | None = None) -> DataFrame:
    """For each month of first purchase and each number of months since: shoppers, their orders, share of the cohort.

    ``first`` is the running state of ``first_purchases``; without it the state is worked out here.
    """
    first = first_purchases(tables) if first is None else first
    people = stg_customers(tables).select("customer_id", "customer_unique_id")
    orders = stg_orders(tables).where("purchased_at is not null")
    months = orders.select("customer_id", F.trunc("purchased_at", "month").alias("month"))
    # One row for each shopper and month before the state is joined.
    active = (
        months.join(people, "customer_id")
        .groupBy("customer_unique_id", "month")
        .agg(F.count(F.lit(1)).alias("orders"))
        .join(first, "customer_unique_id")
    )
    since = F.months_between("month", "cohort_month").cast("int")
    matrix = active.groupBy("cohort_month", since.alias("months_since")).agg(
        F.count(F.lit(1)).alias("shoppers"), F.sum("orders").alias("orders")
    )
    # A row for each cohort and month from here on.
    size = F.max(F.when(F.col("months_since") == 0, F.col("shoppers"))).over(Window.partitionBy("cohort_month"))
    return matrix.select(
        F.date_format("cohort_month", "yyyy-MM").alias("cohort_month"),
        "months_since",
        "shoppers",
        "orders",
        percent(F.col("shoppers"), size).alias("pct_of_cohort"),
    )


# Fixed value: mean radius of the earth in metres.
EARTH = 6_371_000


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Great-circle distance in whole metres between two (latitude, longitude) in degrees."""
    (lat_a, lng_a), (lat_b, lng_b) = ([F.radians(c.cast("double")) for c in point] for point in (a, b))
    half = F.pow(F.sin((lat_b - lat_a) / 2), 2) + F.cos(lat_a) * F.cos(lat_b) * F.pow(F.sin((lng_b - lng_a) / 2), 2)
    return F.round(2 * EARTH * F.asin(F.sqrt(F.least(half, F.lit(1.0))))).cast("bigint")


def _place(prefix: str) -> tuple[Column, Column]:
    return F.col(f"{prefix}_lat"), F.col(f"{prefix}_lng")


def distance_by_state_pair(tables: Tables) -> DataFrame:
    """How far lines travel from each seller state to each customer state, in whole metres.

    Lines shrink to pairs of prefixes before any distance is worked out: a distance is computed once for a pair.
    """
    buyers = (
        stg_orders(tables)
        .select("order_id", "customer_id")
        .join(stg_customers(tables).selectExpr("customer_id", "zip_code as to_zip", "state as customer_state"), "customer_id")
        .select("order_id", "to_zip", "customer_state")
    )
    origins = stg_sellers(tables).selectExpr("seller_id", "zip_code as from_zip", "state as seller_state")
    zips = (
        stg_order_items(tables)
        .select("order_id", "seller_id")
        .join(buyers, "order_id")
        .groupBy("seller_id", "to_zip", "customer_state")
        .agg(F.count(F.lit(1)).alias("items"))
        .join(origins, "seller_id")
        .groupBy("from_zip", "to_zip", "seller_state", "customer_state")
        .agg(F.sum("items").alias("items"))
    )
    for side in ("from", "to"):
        places = tables["geolocation"].selectExpr(
            f"geolocation_zip_code_prefix as {side}_zip", f"geolocation_lat as {side}_lat", f"geolocation_lng as {side}_lng"
        )
        zips = zips.join(places, f"{side}_zip")
    metres = F.col("metres")
    return (
        zips.withColumn("metres", distance(_place("from"), _place("to")))
        .groupBy("seller_state", "customer_state")
        .agg(
            F.sum("items").alias("total_items"),
            F.sum(metres * F.col("items")).alias("_metres"),
            F.min(metres).alias("min_metres"),
            F.max(metres).alias("max_metres"),
        )
        .withColumn("avg_metres", F.expr("_metres div total_items"))
        .drop("_metres")
    )


def nearest_places(of: DataFrame, among: DataFrame, cell: float = 0.25) -> DataFrame:
    """The nearest place of ``among`` for each place of ``of`` (both zip_code, lat, lng): zip_code, nearest_zip, metres.

    Places lie in cells of a grid over the sphere, as points in space: a straight line of length d through the earth
    spans at most one cell more in each of three directions than d / cell. So a nearest place found in the 27 cells
    around a place is the nearest of all if it is no further than one cell's width; places without one go on to a grid twice
    as wide. Each round is written; their number grows with the logarithm of the earth's width. Of places equally far
    the least zip_code counts. Nothing is compared with everything unless it lies in the same few cells.
    """

    def in_space(df: DataFrame) -> DataFrame:
        lat, lng = F.radians(F.col("lat").cast("double")), F.radians(F.col("lng").cast("double"))
        point = {"x": F.cos(lat) * F.cos(lng), "y": F.cos(lat) * F.sin(lng), "z": F.sin(lat)}
        return df.select("zip_code", "lat", "lng").withColumns({k: v * EARTH for k, v in point.items()})

    left, targets, found = written(in_space(of), "places"), written(in_space(among), "targets"), []
    width = EARTH * math.radians(cell)
    while not left.isEmpty():
        cells = [F.floor(F.col(axis) / width).cast("bigint") for axis in "xyz"]
        homes = targets.select(
            F.col("zip_code").alias("nearest_zip"),
            F.col("lat").alias("to_lat"),
            F.col("lng").alias("to_lng"),
            *[c.alias(f"c{axis}") for c, axis in zip(cells, "xyz")],
        )
        around = left.withColumnsRenamed({"lat": "from_lat", "lng": "from_lng"})
        for c, axis in zip(cells, "xyz"):
            around = around.withColumn(f"c{axis}", F.explode(F.array(c - 1, c, c + 1)))
        metres = distance(_place("from"), _place("to"))
        best = around.join(homes, ["cx", "cy", "cz"]).groupBy("zip_code").agg(
            F.min(F.struct(metres.alias("metres"), "nearest_zip")).alias("best")
        )
        best = best.select("zip_code", "best.nearest_zip", "best.metres")
        # A chord is shorter than the arc: what lies within the width by arc can be in no other cell.
        last = width > 2 * EARTH
        best = written(best if last else best.where(F.col("metres") < math.floor(width)), "nearest")
        found.append(best)
        left = written(left.join(best.select("zip_code"), "zip_code", "left_anti"), "places")
        if last:
            break
        width *= 2
    if not found:
        none = left.select("zip_code", F.col("zip_code").alias("nearest_zip"))
        return none.withColumn("metres", F.lit(0).cast("bigint"))
    return reduce(DataFrame.unionByName, found)


def nearest_sellers(tables: Tables) -> DataFrame:
    """For each known prefix, the nearest prefix that has a seller."""
    places = tables["geolocation"].selectExpr(
        "geolocation_zip_code_prefix as zip_code", "geolocation_lat as lat", "geolocation_lng as lng"
    )
    sellers = stg_sellers(tables).select("zip_code").distinct()
    return nearest_places(places, places.join(sellers, "zip_code", "left_semi"))
