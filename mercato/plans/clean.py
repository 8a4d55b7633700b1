"""Bronze: how each raw table is coerced and which of its rows are kept.

The order of the rules is part of their meaning. Where the first copy is chosen before a filter,
an invalid first copy takes its key with it; where it is chosen after, the next valid copy wins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StructField

from mercato.functions.numbers import WIDE, rounded_to_whole, to_whole, to_wide
from mercato.functions.text import strip, zero_fill
from mercato.functions.times import to_utc
from mercato.operators.keys import null_orphans
from mercato.operators.rules import (
    FirstOf,
    HasParent,
    Keep,
    Losses,
    Rule,
    apply_rules,
    count_rejects,
    readable,
    required,
    waiting_rows,
)
from mercato.schemas import (
    CATEGORY_TRANSLATION,
    CUSTOMERS,
    GEOLOCATION,
    LOAD_ORDER,
    ORDER_ITEMS,
    ORDER_REVIEWS,
    ORDER_STATUSES,
    ORDERS,
    PAYMENT_TYPES,
    PAYMENTS,
    PRODUCTS,
    SELLERS,
    Table,
)

Parents = Mapping[str, DataFrame]
ZIP_WIDTH = 5
#: What whole numbers are read as before they are judged: in text or floating point, and as whole numbers.
WIDE_WHOLE, WIDE_INTEGER = "decimal(38,0)", "bigint"


@dataclass(frozen=True)
class Cleaner:
    table: Table
    coerce: Callable[[DataFrame], DataFrame]
    rules: Callable[[Parents], list[Rule]]


def _coerced(df: DataFrame, table: Table, how: Callable, *columns: str) -> DataFrame:
    changes: dict[str, Column] = {}
    for name in columns:
        given = df.schema[name].dataType
        if how in (to_utc, to_wide):
            changes[name] = how(F.col(name), given)
            continue
        # Wide, so that the rules see the value that was given and not what fits the column.
        changes[name] = how(F.col(name), given, WIDE_INTEGER if isinstance(given, IntegralType) else WIDE_WHOLE)
    return df.withColumns(changes)


def _fits(table: Table, *columns: str) -> Keep:
    """No value is too large for the declared type of its column."""
    fits = [F.col(c).isNull() | F.col(c).try_cast(table.type_of(c)).isNotNull() for c in columns]
    return Keep("does not fit its column", reduce(and_, fits))


def _narrowed(df: DataFrame, table: Table) -> DataFrame:
    """Wide columns in their declared types, once the rules have passed."""
    numbers = [field.name for field in table.schema.fields if isinstance(field.dataType, NumericType)]
    wide = [name for name, kind in df.dtypes if kind in (WIDE, WIDE_WHOLE, WIDE_INTEGER) and name in numbers]
    return df.withColumns({name: F.col(name).try_cast(table.type_of(name)) for name in wide})


def _is_child(table: Table, column: str, parents: Parents) -> HasParent:
    fk = next(fk for fk in table.references if fk.column == column)
    return HasParent(f"unknown {column}", column, parents[fk.parent], fk.parent_column)


def _geolocation(df: DataFrame) -> DataFrame:
    df = df.withColumn("geolocation_zip_code_prefix", zero_fill(F.col("geolocation_zip_code_prefix"), ZIP_WIDTH))
    return _coerced(df, GEOLOCATION, to_wide, "geolocation_lat", "geolocation_lng")


def _geolocation_rules(parents: Parents) -> list[Rule]:
    return [
        required("geolocation_zip_code_prefix"),
        required("geolocation_lat", "geolocation_lng"),
        FirstOf("repeated zip", GEOLOCATION.key),
        required("geolocation_city", "geolocation_state"),
        _fits(GEOLOCATION, "geolocation_lat", "geolocation_lng"),
    ]


def _category_rules(parents: Parents) -> list[Rule]:
    return [
        required("product_category_name", "product_category_name_english"),
        FirstOf("repeated category", CATEGORY_TRANSLATION.key),
    ]


def _customers(df: DataFrame) -> DataFrame:
    return df.withColumn("customer_zip_code_prefix", zero_fill(F.col("customer_zip_code_prefix"), ZIP_WIDTH))


def _customer_rules(parents: Parents) -> list[Rule]:
    return [required("customer_id", "customer_unique_id"), FirstOf("repeated customer", CUSTOMERS.key)]


def _sellers(df: DataFrame) -> DataFrame:
    return df.withColumn("seller_zip_code_prefix", zero_fill(strip(F.col("seller_zip_code_prefix")), ZIP_WIDTH))


def _seller_rules(parents: Parents) -> list[Rule]:
    return [required("seller_id"), FirstOf("repeated seller", SELLERS.key)]


PRODUCT_WHOLES = ("product_name_lenght", "product_description_lenght", "product_photos_qty")
PRODUCT_NUMBERS = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")


def _products(df: DataFrame) -> DataFrame:
    if dict(df.dtypes)["product_id"] == "string":
        df = df.withColumn("product_id", strip(F.col("product_id")))
    df = df.withColumn("product_category_name", strip(F.col("product_category_name")))
    df = _coerced(df, PRODUCTS, rounded_to_whole, *PRODUCT_WHOLES)
    return _coerced(df, PRODUCTS, to_wide, *PRODUCT_NUMBERS)


def _product_rules(parents: Parents) -> list[Rule]:
    weight = F.col("product_weight_g")
    checks = [F.coalesce(F.expr(check), F.lit(True)) for check in PRODUCTS.checks.values()]
    return [
        required("product_id"),
        Keep("weight not positive", weight.isNull() | (weight > 0)),
        FirstOf("repeated product", PRODUCTS.key),
        # Such a row would fail the whole load at its insert; here only the row stays out.
        Keep("breaks a check", reduce(and_, checks)),
        _fits(PRODUCTS, *PRODUCT_WHOLES, *PRODUCT_NUMBERS),
    ]


def _orders(df: DataFrame) -> DataFrame:
    return _coerced(
        df,
        ORDERS,
        to_utc,
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )


def _order_rules(parents: Parents) -> list[Rule]:
    return [
        required("order_id", "customer_id", "order_status"),
        FirstOf("repeated order", ORDERS.key),
        _is_child(ORDERS, "customer_id", parents),
        Keep("unknown status", F.col("order_status").isin(*ORDER_STATUSES)),
    ]


def _order_items(df: DataFrame) -> DataFrame:
    df = _coerced(df, ORDER_ITEMS, to_whole, "order_item_id")
    df = _coerced(df, ORDER_ITEMS, to_wide, "price", "freight_value")
    return _coerced(df, ORDER_ITEMS, to_utc, "shipping_limit_date")


def _order_item_rules(parents: Parents) -> list[Rule]:
    return [
        required("order_id", "order_item_id", "product_id", "seller_id"),
        FirstOf("repeated line", ORDER_ITEMS.key),
        _is_child(ORDER_ITEMS, "order_id", parents),
        _is_child(ORDER_ITEMS, "product_id", parents),
        _is_child(ORDER_ITEMS, "seller_id", parents),
        required("price", "freight_value"),
        Keep("negative amount", (F.col("price") >= 0) & (F.col("freight_value") >= 0)),
        _fits(ORDER_ITEMS, "order_item_id", "price", "freight_value"),
    ]


def _payments(df: DataFrame) -> DataFrame:
    df = _coerced(df, PAYMENTS, to_whole, "payment_sequential", "payment_installments")
    return _coerced(df, PAYMENTS, to_wide, "payment_value")


def _payment_rules(parents: Parents) -> list[Rule]:
    return [
        required("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"),
        Keep("unknown type", F.col("payment_type").isin(*PAYMENT_TYPES)),
        Keep("out of range", (F.col("payment_installments") >= 1) & (F.col("payment_value") >= 0)),
        _fits(PAYMENTS, "payment_sequential", "payment_installments", "payment_value"),
        # The order is part of the key: all copies of a payment pass this or none does. It comes before the choice
        # of the first copy, which then finds its rows where the join on the order has put them.
        _is_child(PAYMENTS, "order_id", parents),
        FirstOf("repeated payment", PAYMENTS.key),
    ]


def _reviews(df: DataFrame) -> DataFrame:
    df = _coerced(df, ORDER_REVIEWS, to_whole, "review_score")
    return _coerced(df, ORDER_REVIEWS, to_utc, "review_creation_date", "review_answer_timestamp")


def _review_rules(parents: Parents) -> list[Rule]:
    return [
        required("review_id", "order_id", "review_score"),
        _is_child(ORDER_REVIEWS, "order_id", parents),
        Keep("score out of range", F.col("review_score").between(1, 5)),
        FirstOf("repeated review", ORDER_REVIEWS.key),
        FirstOf("second review of an order", ORDER_REVIEWS.unique[0]),
    ]


CLEANERS = {
    c.table.name: c
    for c in (
        Cleaner(GEOLOCATION, _geolocation, _geolocation_rules),
        Cleaner(CATEGORY_TRANSLATION, lambda df: df, _category_rules),
        Cleaner(CUSTOMERS, _customers, _customer_rules),
        Cleaner(SELLERS, _sellers, _seller_rules),
        Cleaner(PRODUCTS, _products, _product_rules),
        Cleaner(ORDERS, _orders, _order_rules),
        Cleaner(ORDER_ITEMS, _order_items, _order_item_rules),
        Cleaner(PAYMENTS, _payments, _payment_rules),
        Cleaner(ORDER_REVIEWS, _reviews, _review_rules),
    )
}


def clean(
    name: str,
    raw: DataFrame,
    parents: Parents,
    losses: Losses | None = None,
    staged: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The clean form of a raw table. ``parents`` holds the clean tables it refers to; ``staged``: see ``apply_rules``."""
    cleaner = CLEANERS[name]
    df = losses.after("input", raw) if losses else raw
    kept = apply_rules(cleaner.coerce(df), _rules(cleaner, raw, parents), losses, staged)
    return _shaped(kept, cleaner.table, parents)


def clean_and_waiting(name: str, raw: DataFrame, parents: Parents) -> tuple[DataFrame, DataFrame | None]:
    """The clean form of a raw table, and its raw rows that only lack a parent."""
    cleaner = CLEANERS[name]
    waiting = waiting_rows(
        cleaner.coerce(raw.withColumn("_raw", F.struct(*raw.columns))), _rules(cleaner, raw, parents)
    )
    return clean(name, raw, parents), waiting.select("_raw.*") if waiting is not None else None


def _rules(cleaner: Cleaner, raw: DataFrame, parents: Parents) -> list[Rule]:
    return [*readable(raw), *cleaner.rules(parents)]


def _shaped(df: DataFrame, table: Table, parents: Parents) -> DataFrame:
    """Rows that passed the rules as the table declares them."""
    for fk in table.references:
        if fk.on_delete == "set null":
            df = null_orphans(df, fk.column, parents[fk.parent], fk.parent_column)
    return _narrowed(df, table).select(*[_described(field) for field in table.schema.fields])


def _described(field: StructField) -> Column:
    """The column along with its comment, which goes into the stored files."""
    return F.col(field.name).alias(field.name, metadata=field.metadata) if field.metadata else F.col(field.name)


def rejects(name: str, raw: DataFrame, parents: Parents) -> DataFrame:
    """How many rows each rule of a table drops."""
    cleaner = CLEANERS[name]
    return count_rejects(cleaner.coerce(raw), name, _rules(cleaner, raw, parents))


def builders(raw: Mapping[str, DataFrame]) -> dict[str, Callable[[Parents], DataFrame]]:
    """For each table, a function from its clean parents to its clean rows."""
    return {t.name: (lambda parents, name=t.name: clean(name, raw[name], parents)) for t in LOAD_ORDER}
