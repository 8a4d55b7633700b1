"""The raw marketplace tables, derived from a TPC-H-like set of Parquet tables.

Ids keep their numeric type. Money becomes decimal before any arithmetic. Each table carries its
arrival order. Every row of the given tables is read; bad rows come from values changed on some of
them: repeated keys, unknown parents, missing values, unknown statuses and types, values out of range.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators.keys import arrival, arrival_columns
from mercato.schemas import LOAD_ORDER


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _plus(moment: Column, days: Column | int = 0, hours: Column | int = 0) -> Column:
    def whole(n: Column | int) -> Column:
        return F.lit(n).cast("int") if isinstance(n, int) else n.cast("int")

    return moment + F.make_dt_interval(whole(days), whole(hours))


def _state(nation: str) -> Column:
    return F.lpad(F.col(nation).cast("string"), 2, "0")


def _city(nation: str) -> Column:
    return F.concat(F.lit("CITY_"), F.col(nation).cast("string"))


#: A zip that no place has.
UNKNOWN_ZIP = "777"
#: An amount that no amount column holds.
TOO_LARGE = Decimal("123456789.00")


def _key(column: str) -> Column:
    """The key, but one row in 200 takes that of the row before it: a key comes twice, the next has no row."""
    return F.when(F.col(column) % 200 == 3, F.col(column) - 1).otherwise(F.col(column))


def geolocation(spark: SparkSession, folder: str) -> DataFrame:
    place, balance = F.col("c_custkey"), F.col("c_acctbal").cast("decimal(12,2)") / 1000
    # The positions of one prefix are no degrees.
    latitude = F.when(F.col("c_nationkey") == 7, balance + 5000).otherwise(balance)
    return _read(spark, folder, "customer").select(
        F.when(place % 50 != 9, F.col("c_nationkey").cast("string")).alias("geolocation_zip_code_prefix"),
        F.when(place % 5 != 4, latitude.cast("decimal(12,6)")).alias("geolocation_lat"),
        (-balance).cast("decimal(12,6)").alias("geolocation_lng"),
        F.when(place % 6 != 1, _city("c_nationkey")).alias("geolocation_city"),
        _state("c_nationkey").alias("geolocation_state"),
        *arrival("c_custkey"),
    )


def product_category_name_translation(spark: SparkSession, folder: str) -> DataFrame:
    name, other = F.col("p_type"), F.when(F.col("p_size") % 2 == 0, "").otherwise(" goods")
    pairs = _read(spark, folder, "part").select(
        name.alias("product_category_name"),
        F.when(name != "ECONOMY", F.concat(F.lower(name), other)).alias("product_category_name_english"),
    )
    order = arrival("product_category_name", "product_category_name_english")
    return pairs.distinct().select("*", *order)


def customers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return _read(spark, folder, "customer").select(
        _key("c_custkey").alias("customer_id"),
        F.when(key % 50 != 0, F.col("c_name")).alias("customer_unique_id"),
        F.when(key % 10 == 4, UNKNOWN_ZIP)
        .when(key % 50 != 9, F.col("c_nationkey").cast("string"))
        .alias("customer_zip_code_prefix"),
        _city("c_nationkey").alias("customer_city"),
        _state("c_nationkey").alias("customer_state"),
        *arrival("c_custkey"),
    )


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    return _read(spark, folder, "supplier").select(
        F.when(key % 100 != 9, _key("s_suppkey")).alias("seller_id"),
        F.when(key % 10 == 5, UNKNOWN_ZIP).otherwise(F.col("s_nationkey").cast("string")).alias("seller_zip_code_prefix"),
        _city("s_nationkey").alias("seller_city"),
        _state("s_nationkey").alias("seller_state"),
        *arrival("s_suppkey"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    key, kind = F.col("p_partkey"), F.col("p_partkey") % 200
    height = (F.col("p_size") % 20 + 1).cast("decimal(8,2)")
    return _read(spark, folder, "part").select(
        F.when(key % 100 != 29, _key("p_partkey")).alias("product_id"),
        F.when(key % 9 == 4, "UNLISTED").when(key % 9 != 5, F.col("p_type")).alias("product_category_name"),
        F.when(kind == 38, 0).when(kind == 39, 40000).otherwise(F.length("p_name")).alias("product_name_lenght"),
        F.when(kind == 35, -10).otherwise(F.length("p_name") * 10).alias("product_description_lenght"),
        F.when(kind == 37, -1).otherwise(F.col("p_size") % 5).alias("product_photos_qty"),
        (F.col("p_size") - 1).cast("decimal(12,2)").alias("product_weight_g"),
        F.when(kind == 34, 0).otherwise(F.col("p_size")).cast("decimal(8,2)").alias("product_length_cm"),
        F.when(kind == 36, -height).otherwise(height).alias("product_height_cm"),
        F.when(kind == 33, 0).otherwise(F.col("p_size") % 30 + 1).cast("decimal(8,2)").alias("product_width_cm"),
        *arrival("p_partkey"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    day = F.col("o_orderdate").cast("timestamp")
    purchase = _plus(day, hours=key % 24)
    return _read(spark, folder, "orders").select(
        _key("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(key % 200 == 17, None)
        .when(status == "F", "delivered")
        .when(status == "O", "shipped")
        .when(key % 10 == 0, "bogus")
        .otherwise("processing")
        .alias("order_status"),
        purchase.alias("order_purchase_timestamp"),
        _plus(purchase, hours=key % 48).alias("order_approved_at"),
        F.when(status.isin("F", "O"), _plus(purchase, days=2)).alias("order_delivered_carrier_date"),
        F.when(status == "F", _plus(day, days=key * 7919 % 60, hours=key % 24)).alias("order_delivered_customer_date"),
        _plus(day, days=30).alias("order_estimated_delivery_date"),
        *arrival("o_orderkey"),
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    kind, price = F.col("l_partkey") % 200, F.col("l_extendedprice").cast("decimal(12,2)")
    freight = F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(12,2)")
    return _read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.when(kind != 14, F.col("l_partkey")).alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").cast("timestamp").alias("shipping_limit_date"),
        F.when(kind == 10, TOO_LARGE).when(kind == 13, -price).when(kind != 11, price).alias("price"),
        F.when(kind == 19, -freight - 1).when(kind != 12, freight).alias("freight_value"),
        *_line_arrival(),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    kind, flag, value = F.col("l_partkey") % 200, F.col("l_returnflag"), F.col("l_extendedprice").cast("decimal(12,2)")
    return _read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.when(kind == 15, "cheque")
        .when(flag == "R", "credit_card")
        .when(flag == "A", "boleto")
        .otherwise("voucher")
        .alias("payment_type"),
        (F.col("l_quantity").cast("int") % 11).alias("payment_installments"),
        F.when(kind == 18, TOO_LARGE).when(kind == 17, -value).when(kind != 16, value).alias("payment_value"),
        *_line_arrival(),
    )


def _line_arrival() -> list[Column]:
    """A total order of the lines with the same order and line number."""
    return arrival(
        "l_shipdate",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    )


def order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    key, written = F.col("event_id"), F.col("ts").cast("timestamp")
    return _read(spark, folder, "events").select(
        F.when(key % 40 == 9, key - 1).otherwise(key).alias("review_id"),
        (key - key % 3).alias("order_id"),
        F.when(key % 40 != 7, F.floor("value").cast("int") % 6).alias("review_score"),
        F.col("event_type").alias("review_comment_title"),
        F.col("props").alias("review_comment_message"),
        written.alias("review_creation_date"),
        _plus(written, days=1).alias("review_answer_timestamp"),
        *arrival("ts", "event_id"),
    )


READERS = {
    "geolocation": geolocation,
    "product_category_name_translation": product_category_name_translation,
    "customers": customers,
    "sellers": sellers,
    "products": products,
    "orders": orders,
    "order_items": order_items,
    "payments": payments,
    "order_reviews": order_reviews,
}


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read(spark, folder) for name, read in READERS.items()}


def _cents(column: str) -> Column:
    return (F.col(column) * 100).cast("bigint")


def _messy_numbers(column: str, kind: Column) -> Column:
    """The number as text, spoilt for kinds 0 to 3 and written in an unusual way for 4 and 5."""
    text = F.col(column).cast("string")
    return (
        F.when(kind == 0, "-1e-12")
        .when(kind == 1, "12f")
        .when(kind == 2, "NA")
        .when(kind == 3, "1e40")
        .when(kind == 4, F.concat(F.lit("\t"), text, F.lit(" ")))
        .when(kind == 5, F.concat(F.lit("+"), text))
        .otherwise(text)
    )


def _messy_columns() -> dict[str, dict[str, Column]]:
    """For each table, the columns whose text is not simply the value."""
    place, customer, seller = F.col("_arrival_0"), F.col("customer_id"), F.col("seller_id")
    product, order, review = F.col("product_id"), F.col("order_id"), F.col("review_id")
    latitude, wholes = F.col("geolocation_lat").cast("string"), F.col("product_name_lenght").cast("string")
    score, title = F.col("review_score").cast("string"), F.col("review_comment_title")
    approved = F.date_format("order_approved_at", "yyyy-MM-dd HH:mm:ss")
    paid = _cents("payment_value") % 40
    return {
        "geolocation": {
            "geolocation_lat": F.when(place % 7 == 0, "NA")
            .when(place % 7 == 1, F.concat(F.lit(" "), latitude, F.lit("\t")))
            .otherwise(latitude),
            "geolocation_city": F.when(place % 11 == 0, "null").otherwise(F.col("geolocation_city")),
        },
        "product_category_name_translation": {
            "product_category_name_english": F.when(F.col("product_category_name").startswith("S"), "N/A").otherwise(
                F.col("product_category_name_english")
            )
        },
        "customers": {"customer_city": F.when(customer % 9 == 0, "None").otherwise(F.col("customer_city"))},
        "sellers": {
            "seller_zip_code_prefix": F.concat(F.lit(" "), F.col("seller_zip_code_prefix"), F.lit("\u00a0"))
        },
        "products": {
            "product_id": F.concat(F.lit(" "), product.cast("string"), F.lit("\t")),
            "product_name_lenght": F.when(product % 10 == 0, "40000")
            .when(product % 10 == 4, F.concat(wholes, F.lit(".4")))
            .otherwise(wholes),
            "product_length_cm": F.when(product % 10 == 2, "12345").otherwise(F.col("product_length_cm").cast("string")),
            "product_photos_qty": F.when(product % 10 == 3, "abc").otherwise(
                F.col("product_photos_qty").cast("string")
            ),
            "product_weight_g": F.when(product % 20 == 5, "123456789")
            .when(product % 20 == 15, "1e40")
            .otherwise(F.col("product_weight_g").cast("string")),
        },
        "orders": {"order_approved_at": F.when(order % 10 == 1, "on monday").otherwise(approved)},
        "order_items": {
            "order_item_id": F.concat(
                F.col("order_item_id").cast("string"), F.when(order % 3 == 0, ".0").otherwise("")
            ),
            "seller_id": F.when(product % 40 == 6, "nobody").otherwise(seller.cast("string")),
            "price": _messy_numbers("price", product % 40),
            "freight_value": F.when(seller % 30 != 0, F.col("freight_value").cast("string")),
        },
        "payments": {
            "payment_type": F.when(paid == 7, "cheque").otherwise(F.col("payment_type")),
            "payment_installments": F.when(paid == 8, "2.5").otherwise(F.col("payment_installments").cast("string")),
            "payment_value": _messy_numbers("payment_value", paid),
        },
        "order_reviews": {
            "review_score": F.concat(
                score, F.when(review % 4 == 0, ".0").when(review % 4 == 1, ".5").otherwise("")
            ),
            "review_comment_title": F.when(title == "error", "n/a").otherwise(title),
            "review_comment_message": F.concat(
                F.lit('He said "'), title, F.lit('",\n'), F.col("review_comment_message")
            ),
            "review_creation_date": F.when(review % 10 == 3, "00:00").otherwise(
                F.date_format("review_creation_date", "yyyy-MM-dd HH:mm:ss")
            ),
        },
    }


#: Tables whose every 20th row comes again at the end, with another text in the named column.
_REPEATED = {
    "customers": ("customer_id", "customer_city"),
    "sellers": ("seller_id", "seller_city"),
    "products": ("product_id", "product_category_name"),
    "orders": ("order_id", "order_status"),
}


#: Rows of a CSV file.
FILE_ROWS = 250_000


def write_messy_csv(raw: dict[str, DataFrame], folder: str) -> None:
    """The raw tables as CSV files in their order of arrival: signs, blanks, missing tokens, fractions, texts where
    numbers or dates are due, values that do not fit, line breaks and quotes, unknown parents, repeated keys."""
    messy = _messy_columns()
    for table in LOAD_ORDER:
        rows, order = raw[table.name].withColumn("_again", F.lit(0)), arrival_columns(raw[table.name])
        if table.name in _REPEATED:
            key, changed = _REPEATED[table.name]
            again = rows.where(F.col(key) % 20 == 0).withColumn("_again", F.lit(1))
            rows = rows.unionByName(again.withColumn(changed, F.lit("canceled")))
        kinds = dict(rows.dtypes)
        plain = {
            c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kinds[c] == "timestamp" else F.col(c).cast("string")
            for c in table.columns
        }
        texts = [text.alias(c) for c, text in (plain | messy[table.name]).items()]
        writer = rows.orderBy("_again", *order).select(*texts).write.option("header", True).option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        # Packed files cannot be split, so each has as many rows as a task may sort in memory.
        writer = writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        writer.option("maxRecordsPerFile", FILE_ROWS).csv(f"{folder}/{table.file.replace('*', 'shop_').replace('__', '_')}")
