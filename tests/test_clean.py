from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helpers import PARENT_ORDERS, column, dec, raw_text, tuples, typed
from mercato.plans.clean import clean, rejects
from mercato.schemas import LOAD_ORDER, TABLES
from mercato.sources.store import Store


def test_geolocation(spark):
    raw = raw_text(
        spark,
        "geolocation",
        [
            {"geolocation_zip_code_prefix": "1037", "geolocation_lat": None, "geolocation_lng": "-46.6"},
            {"geolocation_zip_code_prefix": "1037", "geolocation_lat": "-23.5", "geolocation_lng": "-46.6"},
            {"geolocation_zip_code_prefix": "01037", "geolocation_lat": "9", "geolocation_lng": "9"},
            {"geolocation_zip_code_prefix": None, "geolocation_lat": "9", "geolocation_lng": "9"},
        ],
    )
    raw = raw.fillna("x", ["geolocation_city", "geolocation_state"])
    got = clean("geolocation", raw, {}).select("geolocation_zip_code_prefix", "geolocation_lat")
    assert tuples(got) == [("01037", dec("-23.500000"))]


def test_translation(spark):
    names = ("product_category_name", "product_category_name_english")
    rows = [("a", None), ("a", "A"), ("a", "AA"), (None, "B")]
    raw = raw_text(spark, "product_category_name_translation", [dict(zip(names, r)) for r in rows])
    assert tuples(clean("product_category_name_translation", raw, {})) == [("a", "A")]


def test_rows_that_the_schema_forbids_stay_out(spark):
    place = {"geolocation_zip_code_prefix": "1", "geolocation_lat": "1", "geolocation_lng": "1"}
    assert clean("geolocation", raw_text(spark, "geolocation", [place]), {}).isEmpty()
    names = spark.createDataFrame([], TABLES["product_category_name_translation"].schema)
    rows = [{"product_id": "p", "product_height_cm": "0"}, {"product_id": "q", "product_height_cm": "0.5"}]
    kept = clean("products", raw_text(spark, "products", rows), {"product_category_name_translation": names})
    assert column(kept, "product_id") == ["q"]


def test_comments_go_along_with_the_columns(spark, tmp_path):
    raw = raw_text(spark, "orders", [])
    parents = {"customers": typed(spark, "customers", [])}
    store = Store(spark, str(tmp_path))
    store.append(clean("orders", raw, parents), "orders")
    for source in (store, Store(spark, str(tmp_path))):
        assert source["orders"].schema["order_status"].metadata == TABLES["orders"].schema["order_status"].metadata


def places(spark):
    return {"geolocation": spark.createDataFrame([("01037",)], "geolocation_zip_code_prefix string")}


def test_customers(spark):
    names = ("customer_id", "customer_unique_id", "customer_zip_code_prefix")
    rows = [("c1", None, "1037"), ("c1", "u", "1037"), ("c1", "v", "9"), ("c2", "u", "9"), ("c3", "u", None)]
    raw = raw_text(spark, "customers", [dict(zip(names, r)) for r in rows])
    got = clean("customers", raw, places(spark)).select(*names)
    assert sorted(tuples(got)) == [("c1", "u", "01037"), ("c2", "u", None), ("c3", "u", None)]


def test_sellers_strip_the_zip_customers_do_not(spark):
    sellers = raw_text(spark, "sellers", [{"seller_id": "s", "seller_zip_code_prefix": " 1037 "}])
    customers = raw_text(
        spark, "customers", [{"customer_id": "c", "customer_unique_id": "u", "customer_zip_code_prefix": "1037 "}]
    )
    assert column(clean("sellers", sellers, places(spark)), "seller_zip_code_prefix") == ["01037"]
    assert column(clean("customers", customers, places(spark)), "customer_zip_code_prefix") == [None]


def test_products_and_their_lines(spark):
    names = ("product_id", "product_category_name", "product_weight_g", "product_name_lenght")
    rows = [
        ("p0", "known", "0", "1"),
        ("p1", "known", "-1", "1"),
        ("p2", " known ", None, "58.0"),
        (" p3 ", "other", "5", "x"),
        ("p4", None, "0", "1"),
        ("p4", None, "7", "1"),
    ]
    raw = raw_text(spark, "products", [dict(zip(names, r)) for r in rows])
    known = spark.createDataFrame([("known", "k")], TABLES["product_category_name_translation"].schema)
    products = clean("products", raw, {"product_category_name_translation": known})
    assert sorted(tuples(products.select(*names))) == [
        ("p2", "known", None, 58),
        ("p3", None, dec("5.00"), None),
        ("p4", None, dec("7.00"), 1),
    ]
    lines = [
        {"order_id": "o1", "order_item_id": str(n), "product_id": f"p{n}", "seller_id": "s", "price": "1"}
        for n in range(4)
    ]
    items = raw_text(spark, "order_items", [{**line, "freight_value": "0"} for line in lines])
    parents = {
        "orders": typed(spark, "orders", PARENT_ORDERS),
        "products": products,
        "sellers": typed(spark, "sellers", [{"seller_id": "s"}]),
    }
    assert sorted(column(clean("order_items", items, parents), "product_id")) == ["p2", "p3"]


def test_orders_lose_a_key_whose_first_copy_is_invalid(spark):
    names = ("order_id", "customer_id", "order_status", "order_purchase_timestamp")
    rows = [
        ("a", "c1", "bogus", None),
        ("a", "c1", "delivered", None),
        ("b", None, "delivered", None),
        ("b", "c1", "shipped", "2017-10-02 10:56:33"),
        ("c", "nobody", "shipped", None),
        ("d", "c1", "canceled", "soon"),
    ]
    raw = raw_text(spark, "orders", [dict(zip(names, r)) for r in rows])
    parents = {"customers": typed(spark, "customers", [{"customer_id": "c1", "customer_unique_id": "u"}])}
    got = clean("orders", raw, parents).withColumn(
        "order_purchase_timestamp", F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")
    )
    assert sorted(tuples(got.select(*names))) == [
        ("b", "c1", "shipped", "2017-10-02 10:56:33"),
        ("d", "c1", "canceled", None),
    ]


def test_items_lose_a_key_whose_first_copy_is_invalid(spark):
    names = ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
    rows = [
        ("o1", "1", "p", "s", "-1", "0"),
        ("o1", "1", "p", "s", "5", "0"),
        ("o1", "2", "p", "s", "x", "0"),
        ("o1", "3", "p", "s", "2.5", "0.25"),
        ("o1", "4", "p", "nobody", "2", "0"),
        ("o1", "5", "nothing", "s", "2", "0"),
        ("zz", "1", "p", "s", "2", "0"),
    ]
    parents = {
        "orders": typed(spark, "orders", PARENT_ORDERS),
        "products": typed(spark, "products", [{"product_id": "p"}]),
        "sellers": typed(spark, "sellers", [{"seller_id": "s"}]),
    }
    raw = raw_text(spark, "order_items", [dict(zip(names, r)) for r in rows])
    assert tuples(clean("order_items", raw, parents).select(*names)) == [
        ("o1", 3, "p", "s", dec("2.50"), dec("0.25"))
    ]


def test_payments_keep_the_first_valid_copy(spark):
    names = ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value")
    rows = [
        ("o1", "1", "voucher", "0", "5"),
        ("o1", "1", "voucher", "2", "6"),
        ("o1", "1", "boleto", "1", "7"),
        ("o1", "2", "cash", "1", "7"),
        ("o1", "3", "boleto", "1.5", "7"),
        ("o1", "4", "boleto", "1", "-7"),
        ("zz", "1", "boleto", "1", "7"),
    ]
    raw = raw_text(spark, "payments", [dict(zip(names, r)) for r in rows])
    got = clean("payments", raw, {"orders": typed(spark, "orders", PARENT_ORDERS)})
    assert tuples(got) == [("o1", 1, "voucher", 2, dec("6.00"))]


def test_reviews_are_unique_by_review_and_then_by_order(spark):
    names = ("review_id", "order_id", "review_score", "review_creation_date")
    rows = [
        ("r0", "o1", "0", None),
        ("r1", "o1", "5", "2018-01-18"),
        ("r1", "o2", "4", None),
        ("r2", "o1", "3", None),
        ("r3", "o2", "6", None),
        ("r4", "o2", "4.5", None),
        ("r5", "o2", "2.0", None),
        ("r6", "zz", "2", None),
    ]
    raw = raw_text(spark, "order_reviews", [dict(zip(names, r)) for r in rows])
    got = clean("order_reviews", raw, {"orders": typed(spark, "orders", PARENT_ORDERS)})
    assert sorted(tuples(got.select("review_id", "order_id", "review_score"))) == [("r1", "o1", 5), ("r5", "o2", 2)]


# Worked out in SQL over the smallest test tables.
EXPECTED = {
    "geolocation": 20,
    "product_category_name_translation": 5,
    "customers": 146,
    "sellers": 8,
    "products": 183,
    "orders": 1_400,
    "order_items": 3_021,
    "payments": 3_996,
    "order_reviews": 307,
}


@pytest.mark.parametrize("table", [t.name for t in LOAD_ORDER])
def test_sample_counts_and_report_agree(raw, lake, table):
    assert clean(table, raw[table], lake).count() == EXPECTED[table]
    report = rejects(table, raw[table], lake).orderBy("step").collect()
    assert report[-1]["rows_left"] == EXPECTED[table]
    assert report[0]["rows_left"] - sum(r["rows_dropped"] for r in report) == EXPECTED[table]
    assert all(r["rows_dropped"] > 0 for r in report[1:]), "the sample breaks every rule"


@pytest.mark.parametrize("table", ["products", "payments", "order_reviews"])
def test_the_reject_report_reads_a_table_once(spark, raw, table):
    report = rejects(table, raw[table], {"orders": typed(spark, "orders", PARENT_ORDERS)})
    assert report._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


def test_amounts_are_judged_before_they_are_rounded(spark):
    """A small negative amount is negative, a value that is too large is refused and not stored as null."""
    good = {"payment_type": "credit_card", "payment_installments": "1"}
    given = {"1": "-0.004", "2": "123456789123", "3": "0.004", "4": "10"}
    rows = [{"order_id": "o1", "payment_sequential": k, "payment_value": v, **good} for k, v in given.items()]
    raw = raw_text(spark, "payments", rows)
    parents = {"orders": typed(spark, "orders", PARENT_ORDERS)}
    stored = clean("payments", raw, parents).select("payment_sequential", "payment_value").collect()
    assert sorted((r[0], str(r[1])) for r in stored) == [(3, "0.00"), (4, "10.00")]
    dropped = {r["rule"]: r["rows_dropped"] for r in rejects("payments", raw, parents).collect()}
    assert dropped["out of range"] == 1 and dropped["does not fit its column"] == 1


def test_products_that_do_not_fit_are_refused(spark):
    rows = [
        {"product_id": "small", "product_weight_g": "0.001"},
        {"product_id": "long", "product_length_cm": "12345678"},
        {"product_id": "name", "product_name_lenght": "9999999999"},
        {"product_id": "heavy", "product_weight_g": "12345678901"},
        {"product_id": "good", "product_weight_g": "12.5", "product_name_lenght": "40"},
    ]
    raw = raw_text(spark, "products", rows)
    parents = {"product_category_name_translation": typed(spark, "product_category_name_translation", [])}
    assert {r["product_id"] for r in clean("products", raw, parents).collect()} == {"small", "good"}
    dropped = {r["rule"]: r["rows_dropped"] for r in rejects("products", raw, parents).collect()}
    assert dropped["does not fit its column"] == 3


def test_whole_numbers_that_do_not_fit_are_refused_whatever_their_type(spark):
    schema = "product_id string, product_category_name string, product_name_lenght bigint, product_photos_qty double"
    raw = spark.createDataFrame([("a", None, 40_000, 1.0), ("b", None, 40, 1e9), ("c", None, 40, 1.0)], schema)
    for column in ("description_lenght", "weight_g", "length_cm", "height_cm", "width_cm"):
        raw = raw.withColumn(f"product_{column}", F.lit(None).cast("int"))
    raw = raw.withColumn("_arrival_0", F.col("product_id"))
    parents = {"product_category_name_translation": typed(spark, "product_category_name_translation", [])}
    stored = clean("products", raw, parents)
    assert [(r["product_id"], r["product_name_lenght"]) for r in stored.collect()] == [("c", 40)]
    assert dict(stored.dtypes)["product_name_lenght"] == "smallint"
