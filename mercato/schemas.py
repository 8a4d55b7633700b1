"""The nine marketplace tables: types, keys, references, checks and comments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The domains the source system guarantees.
ORDER_STATUSES = (
    "created",
    "approved",
    "invoiced",
    "processing",
    "shipped",
    "delivered",
    "unavailable",
    "canceled",
)
PAYMENT_TYPES = ("credit_card", "boleto", "voucher", "debit_card", "not_defined")
REVIEW_SCORES = (1, 2, 3, 4, 5)

SET_NULL, RESTRICT, CASCADE = "set null", "restrict", "cascade"


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    on_delete: str


@dataclass(frozen=True)
class Table:
    name: str
    file: str
    schema: T.StructType
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[ForeignKey, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    comment: str = ""
    multiline: bool = False

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]

    def type_of(self, column: str) -> str:
        return self.schema[column].dataType.simpleString()


def _col(name: str, kind: T.DataType, required: bool = False, comment: str = "") -> T.StructField:
    return T.StructField(name, kind, not required, {"comment": comment} if comment else None)


_TEXT, _INT, _SMALL, _TIME = T.StringType(), T.IntegerType(), T.ShortType(), T.TimestampType()
_MONEY, _SIZE, _DEGREES = T.DecimalType(10, 2), T.DecimalType(6, 2), T.DecimalType(9, 6)


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


GEOLOCATION = Table(
    name="geolocation",
    file="*geolocation_dataset.csv",
    schema=T.StructType(
        [
            _col("geolocation_zip_code_prefix", _TEXT, True, "Five-digit postal prefix; the key once deduplicated."),
            _col("geolocation_lat", _DEGREES, True),
            _col("geolocation_lng", _DEGREES, True),
            _col("geolocation_city", _TEXT, True),
            _col("geolocation_state", _TEXT, True),
        ]
    ),
    key=("geolocation_zip_code_prefix",),
    comment="One representative position per postal prefix.",
)

CATEGORY_TRANSLATION = Table(
    name="product_category_name_translation",
    file="product_category_name_translation.csv",
    schema=T.StructType(
        [
            _col("product_category_name", _TEXT, True),
            _col("product_category_name_english", _TEXT, True),
        ]
    ),
    key=("product_category_name",),
    comment="English names of the product categories.",
)

CUSTOMERS = Table(
    name="customers",
    file="*customers_dataset.csv",
    schema=T.StructType(
        [
            _col("customer_id", _TEXT, True),
            _col("customer_unique_id", _TEXT, True, "The person; stays the same over all of their orders."),
            _col("customer_zip_code_prefix", _TEXT),
            _col("customer_city", _TEXT),
            _col("customer_state", _TEXT),
        ]
    ),
    key=("customer_id",),
    references=(
        ForeignKey("customer_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix", SET_NULL),
    ),
    comment="One row per customer record; a person may hold several.",
)

SELLERS = Table(
    name="sellers",
    file="*sellers_dataset.csv",
    schema=T.StructType(
        [
            _col("seller_id", _TEXT, True),
            _col("seller_zip_code_prefix", _TEXT),
            _col("seller_city", _TEXT),
            _col("seller_state", _TEXT),
        ]
    ),
    key=("seller_id",),
    references=(
        ForeignKey("seller_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix", SET_NULL),
    ),
    comment="Sellers of the marketplace, each at one postal prefix.",
)

PRODUCTS = Table(
    name="products",
    file="*products_dataset.csv",
    schema=T.StructType(
        [
            _col("product_id", _TEXT, True),
            _col("product_category_name", _TEXT, False, "Category; its English name is in the translation table."),
            _col("product_name_lenght", _SMALL),
            _col("product_description_lenght", _INT),
            _col("product_photos_qty", _SMALL),
            _col("product_weight_g", _MONEY),
            _col("product_length_cm", _SIZE),
            _col("product_height_cm", _SIZE),
            _col("product_width_cm", _SIZE),
        ]
    ),
    key=("product_id",),
    references=(
        ForeignKey("product_category_name", "product_category_name_translation", "product_category_name", SET_NULL),
    ),
    checks={
        "name_length_positive": "product_name_lenght > 0",
        "description_length_not_negative": "product_description_lenght >= 0",
        "photos_not_negative": "product_photos_qty >= 0",
        "weight_positive": "product_weight_g > 0",
        "length_positive": "product_length_cm > 0",
        "height_positive": "product_height_cm > 0",
        "width_positive": "product_width_cm > 0",
    },
    comment="Product catalogue with the physical dimensions.",
)

ORDERS = Table(
    name="orders",
    file="*_orders_dataset.csv",
    schema=T.StructType(
        [
            _col("order_id", _TEXT, True),
            _col("customer_id", _TEXT, True),
            _col("order_status", _TEXT, True, "One of eight known statuses."),
            _col("order_purchase_timestamp", _TIME),
            _col("order_approved_at", _TIME),
            _col("order_delivered_carrier_date", _TIME),
            _col("order_delivered_customer_date", _TIME),
            _col("order_estimated_delivery_date", _TIME),
        ]
    ),
    key=("order_id",),
    references=(ForeignKey("customer_id", "customers", "customer_id", RESTRICT),),
    checks={"status_known": _in("order_status", ORDER_STATUSES)},
    comment="Life of an order; the delay is the delivered date minus the estimated date.",
)

ORDER_ITEMS = Table(
    name="order_items",
    file="*order_items_dataset.csv",
    schema=T.StructType(
        [
            _col("order_id", _TEXT, True),
            _col("order_item_id", _SMALL, True, "Line number in the order, from 1."),
            _col("product_id", _TEXT, True),
            _col("seller_id", _TEXT, True),
            _col("shipping_limit_date", _TIME),
            _col("price", _MONEY, True),
            _col("freight_value", _MONEY, True),
        ]
    ),
    key=("order_id", "order_item_id"),
    references=(
        ForeignKey("order_id", "orders", "order_id", CASCADE),
        ForeignKey("product_id", "products", "product_id", RESTRICT),
        ForeignKey("seller_id", "sellers", "seller_id", RESTRICT),
    ),
    checks={"price_not_negative": "price >= 0", "freight_not_negative": "freight_value >= 0"},
    comment="Product lines of the orders.",
)

PAYMENTS = Table(
    name="payments",
    file="*order_payments_dataset.csv",
    schema=T.StructType(
        [
            _col("order_id", _TEXT, True),
            _col("payment_sequential", _SMALL, True, "Position among the payments of the order."),
            _col("payment_type", _TEXT, True),
            _col("payment_installments", _SMALL, True),
            _col("payment_value", _MONEY, True),
        ]
    ),
    key=("order_id", "payment_sequential"),
    references=(ForeignKey("order_id", "orders", "order_id", CASCADE),),
    checks={
        "type_known": _in("payment_type", PAYMENT_TYPES),
        "installments_at_least_one": "payment_installments >= 1",
        "value_not_negative": "payment_value >= 0",
    },
    comment="Payments; an order may be split over several.",
)

ORDER_REVIEWS = Table(
    name="order_reviews",
    file="*order_reviews_dataset.csv",
    schema=T.StructType(
        [
            _col("review_id", _TEXT, True),
            _col("order_id", _TEXT, True),
            _col("review_score", _SMALL, True, "Stars, 1 to 5."),
            _col("review_comment_title", _TEXT),
            _col("review_comment_message", _TEXT),
            _col("review_creation_date", _TIME),
            _col("review_answer_timestamp", _TIME),
        ]
    ),
    key=("review_id",),
    unique=(("order_id",),),
    references=(ForeignKey("order_id", "orders", "order_id", CASCADE),),
    checks={"score_in_range": "review_score between 1 and 5"},
    comment="Customer reviews, at most one per order.",
    multiline=True,
)

# Parents come before children.
LOAD_ORDER = (
    GEOLOCATION,
    CATEGORY_TRANSLATION,
    CUSTOMERS,
    SELLERS,
    PRODUCTS,
    ORDERS,
    ORDER_ITEMS,
    PAYMENTS,
    ORDER_REVIEWS,
)
TABLES = {t.name: t for t in LOAD_ORDER}
