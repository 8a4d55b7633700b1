
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.numbers import exact_average, to_number, to_whole
from mercato.functions.text import strip, without_missing_tokens, zero_fill
from mercato.functions.times import day_name, day_of_week, month_name, to_utc
from mercato.operators.deletes import propagate_deletes
from mercato.operators.keys import anti_filter, keep_first, null_orphans, semi_filter
from mercato.operators.ranking import rank_in_ranges
from mercato.operators.upsert import insert_if_absent
from mercato.plans import analytics, extensions, quality
from mercato.plans.clean import builders, clean, rejects
from mercato.plans.catalog import register
from mercato.plans.ingest import ingest, ingest_folder, load
from mercato.plans.marts import MARTS, fct_orders
from mercato.plans.refresh import build_fact, changed_orders, refresh_fact, snapshot
from mercato.plans.removal import delete_rows
from mercato.plans.staging import STAGING
from mercato.schemas import CUSTOMERS, LOAD_ORDER, ORDER_REVIEWS, ORDER_STATUSES, PAYMENTS, TABLES
from mercato.session import configure_tables, fresh_path, remove, shuffles_removed, written
from mercato.sources.csv import read_csv
from mercato.sources.layout import bucket_by_order, files_for, write_by_month
from mercato.sources.sample import raw_tables, write_messy_csv
from mercato.sources.store import DerivedStore, Store
from mercato.streaming.ingest import stream_into
from oracle_queries import oracle

Query = Callable[[SparkSession, str], DataFrame]

_LAKES: dict[tuple[str, str], DerivedStore] = {}
_FROM_CSV: dict[tuple[str, str], Store] = {}
_AFTER_DELETE: dict[tuple[str, str, str], Store] = {}
_BUCKETED: dict[str, dict[str, DataFrame]] = {}
_LOCK = Lock()


def _lake(spark: SparkSession, sf_dir: str) -> DerivedStore:
    """Clean tables and marts of a data folder, each written when first read in this application."""
    configure_tables(spark)
    with _LOCK:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _LAKES:
            tables = {**builders(raw_tables(spark, sf_dir)), **MARTS}
            _LAKES[key] = DerivedStore(spark, fresh_path(spark, "lake"), tables)
        return _LAKES[key]


def _portable(df: DataFrame) -> DataFrame:
    """Types that compare alike in any engine: doubles, longs, and times as text."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    configure_tables(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    configure_tables(spark)
    return raw_tables(spark, sf_dir)


# Expressions, each over a whole table.


def _missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    lines = _parquet(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(flag == "N", "NA").when(flag == "A", "#N/A").otherwise(flag).alias("flag"),
        F.when(status == "O", "null").otherwise(status).alias("status"),
    )
    return without_missing_tokens(lines)


def _coerce_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits, line = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    text = (
        F.when(line == 1, digits)
        .when(line == 2, F.concat(F.lit(" "), digits, F.lit("\t")))
        .when(line == 3, F.concat(digits, F.lit(".5")))
        .when(line == 4, F.concat(digits, F.lit("f")))
        .when(line == 5, "NaN")
        .when(line == 6, F.concat(digits, F.lit("e1")))
        .otherwise("")
    )
    number, whole = to_number(F.col("text"), T.StringType(), "decimal(20,2)"), to_whole(F.col("text"), T.StringType())
    return (
        _parquet(spark, sf_dir, "lineitem")
        .select("l_linenumber", text.alias("text"))
        .groupBy("l_linenumber")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count(number).alias("numbers"),
            F.sum(number).alias("number_total"),
            F.count(whole).alias("wholes"),
            F.sum(whole).alias("whole_total"),
        )
    )


def _coerce_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, moment = F.col("o_orderstatus"), F.col("o_orderdate").cast("timestamp")
    hour = F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    text = (
        F.when(status == "F", F.date_format(moment + hour, "yyyy-MM-dd HH:mm:ss"))
        .when(status == "O", F.date_format(moment, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("on "), F.date_format(moment, "yyyy-MM-dd")))
    )
    orders = _parquet(spark, sf_dir, "orders")
    return orders.select("o_orderkey", to_utc(text, T.StringType()).alias("moment"))


def _zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parquet(spark, sf_dir, "customer").select(
        "c_custkey",
        zero_fill(F.col("c_custkey").cast("string"), 3).alias("padded"),
        strip(F.concat(F.lit(" \t"), "c_name", F.lit(" \n"))).alias("stripped"),
    )


def _exact_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _raw(spark, sf_dir)["order_items"]
    return items.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(exact_average("price"), 2).alias("avg_price")
    )


def _day_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _parquet(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    day = F.col("day")
    return days.select(
        "day",
        day_of_week(day).alias("day_of_week"),
        month_name(day).alias("month_name"),
        day_name(day).alias("day_name"),
    )


# Operators, each over a whole raw table.


def _csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, message = F.col("review_comment_title"), F.col("review_comment_message")
    reviews = _raw(spark, sf_dir)["order_reviews"].withColumns(
        {
            "review_comment_title": F.when(title == "error", "N/A").otherwise(title),
            "review_comment_message": F.concat(F.lit('He said "'), title, F.lit('",\n'), message),
            "review_creation_date": F.date_format("review_creation_date", "yyyy-MM-dd HH:mm:ss"),
            "review_answer_timestamp": F.date_format("review_answer_timestamp", "yyyy-MM-dd HH:mm:ss"),
        }
    )
    path = fresh_path(spark, "reviews_csv")
    reviews.select(*ORDER_REVIEWS.columns).write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path, ORDER_REVIEWS).select(*ORDER_REVIEWS.columns)


def _keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = keep_first(_raw(spark, sf_dir)["order_items"], ["order_id", "order_item_id"])
    return first.select("order_id", "order_item_id", "product_id", "seller_id", "price")


def _semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _raw(spark, sf_dir)["order_items"].select("order_id", "order_item_id", "price")
    return semi_filter(items, "order_id", _lake(spark, sf_dir)["orders"], "order_id")


def _anti_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _raw(spark, sf_dir)["orders"].select("order_id", "customer_id")
    return anti_filter(orders, ["order_id"], _lake(spark, sf_dir)["orders"])


def _null_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = _raw(spark, sf_dir)["customers"].select(
        "customer_id", zero_fill(F.col("customer_zip_code_prefix"), 5).alias("customer_zip_code_prefix")
    )
    places = _lake(spark, sf_dir)["geolocation"]
    return null_orphans(zipped, "customer_zip_code_prefix", places, "geolocation_zip_code_prefix")


def _rank_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _parquet(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"
    )
    return rank_in_ranges(lines, {"price_rank": "l_extendedprice", "quantity_rank": "l_quantity"}).drop("l_quantity")


def _insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credit card payments first, then all payments with another value: stored rows stay."""
    payments = _lake(spark, sf_dir)["payments"]
    store = Store(spark, fresh_path(spark, "insert_if_absent"))
    insert_if_absent(payments.where("payment_type = 'credit_card'"), store, "payments", PAYMENTS.key)
    changed = payments.withColumn("payment_value", (F.col("payment_value") + 1).cast("decimal(12,2)"))
    insert_if_absent(changed, store, "payments", PAYMENTS.key)
    return store["payments"]


def _ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, fresh_path(spark, "ingest_twice"))
    raw = _raw(spark, sf_dir)
    first, again = ingest(raw, store), ingest(raw, store)
    rows = [
        store[t.name].agg(
            F.lit(t.name).alias("table_name"),
            F.lit(first[t.name]).cast("bigint").alias("inserted_first"),
            F.lit(again[t.name]).cast("bigint").alias("inserted_again"),
            F.count(F.lit(1)).alias("stored"),
        )
        for t in LOAD_ORDER
    ]
    return reduce(DataFrame.unionByName, rows)


def _ingest_csv(table: str) -> Query:
    """A stored table after a load of nine CSV files with messy text; the load runs once in an application."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = _raw(spark, sf_dir)
        with _LOCK:
            key = (spark.sparkContext.applicationId, sf_dir)
            if key not in _FROM_CSV:
                folder, root = fresh_path(spark, "messy_csv"), fresh_path(spark, "from_csv")
                with shuffles_removed(spark):
                    write_messy_csv(raw, folder)
                ingest_folder(spark, folder, root)
                remove(spark, folder)
                _FROM_CSV[key] = Store(spark, root)
        return _FROM_CSV[key][table]

    return query


def _catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, comment and rows of the clean tables, read back from the catalog."""
    lake = _lake(spark, sf_dir)
    database = lake.root.rsplit("/", 1)[1].replace("-", "_")
    names = [t.name for t in LOAD_ORDER]
    register(lake, database, names)
    rows = [
        spark.table(f"{database}.{name}").agg(
            F.lit(name).alias("table_name"),
            F.lit(spark.catalog.getTable(f"{database}.{name}").description).alias("table_comment"),
            F.count(F.lit(1)).alias("stored"),
        )
        for name in names
    ]
    return reduce(DataFrame.unionByName, rows)


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payments as arriving files, streamed in twice with separate progress records."""
    raw, folder = _raw(spark, sf_dir)["payments"], fresh_path(spark, "arriving_payments")
    raw.write.parquet(folder)
    parents = {"orders": _lake(spark, sf_dir)["orders"]}
    store = Store(spark, fresh_path(spark, "stream_ingest"))
    for _ in range(2):
        files = spark.readStream.schema(raw.schema).parquet(folder)
        stream_into(files, "payments", parents, store, fresh_path(spark, "progress")).awaitTermination()
    return store["payments"]


def _load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule dropped, counted while the raw tables were loaded."""
    loaded = load(_raw(spark, sf_dir), Store(spark, fresh_path(spark, "load_report")))
    return loaded.report(spark)


def _csv_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV lines, some with 1 field, with 12, or with a quote that is not closed; what each rule drops."""
    key, columns = F.col("customer_id"), CUSTOMERS.columns
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    line = F.concat_ws(",", *texts)
    broken = (
        F.when(key % 10 == 1, texts[0])
        .when(key % 10 == 3, F.concat(line, F.lit("," * (12 - len(columns)))))
        .when(key % 10 == 6, F.concat(texts[0], F.lit(',"'), F.concat_ws(",", *texts[1:])))
        .otherwise(line)
    )
    # Two files, each with the header first.
    folder, lines = fresh_path(spark, "broken_csv"), _raw(spark, sf_dir)["customers"].select(broken, "_arrival_0")
    for part in range(2):
        header = spark.createDataFrame([(",".join(columns), -1)], "line string, n bigint")
        whole = header.union(lines.where(F.col("_arrival_0") % 2 == part)).coalesce(1).sortWithinPartitions("n")
        whole.select("line").write.mode("append").text(folder)
    return rejects("customers", read_csv(spark, folder, CUSTOMERS), {})


def _stream_children_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payments streamed in before the orders that they belong to: they wait, and are stored as orders arrive."""
    raw, lake = _raw(spark, sf_dir), _lake(spark, sf_dir)
    store = Store(spark, fresh_path(spark, "children_first"))
    store.append(lake["customers"], "customers")
    for table in ("payments", "orders"):
        folder = fresh_path(spark, f"arriving_{table}")
        raw[table].write.parquet(folder)
        files = spark.readStream.schema(raw[table].schema).parquet(folder)
        stream_into(files, table, None, store, fresh_path(spark, "progress")).awaitTermination()
        remove(spark, folder)
    return store["payments"]


def _reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, lake = _raw(spark, sf_dir), _lake(spark, sf_dir)
    return reduce(DataFrame.unionByName, [rejects(t.name, raw[t.name], lake) for t in LOAD_ORDER])


def _clean(table: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return clean(table, _raw(spark, sf_dir)[table], _lake(spark, sf_dir))

    return query


def _over_lake(plan: Callable[..., DataFrame], **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(_lake(spark, sf_dir), **options)

    return query


def _over_raw(plan: Callable[..., DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(_raw(spark, sf_dir))

    return query


# Layouts.


def _bucketed(plan: Callable[..., DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lake = _lake(spark, sf_dir)
        with _LOCK:
            if lake.root not in _BUCKETED:
                clean_tables = {t.name: lake[t.name] for t in LOAD_ORDER}
                # Named after the lake, whose name nothing else has.
                prefix = lake.root.rsplit("/", 1)[1].replace("-", "_") + "_"
                _BUCKETED[lake.root] = bucket_by_order(clean_tables, f"{lake.root}/by_order", prefix=prefix)
        return plan(_BUCKETED[lake.root])

    return query


def _orders_by_month_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = _lake(spark, sf_dir)["fct_orders"]
    stored = write_by_month(fact, fresh_path(spark, "by_month"), "purchased_at", "order_status")
    return stored.groupBy(F.col("purchase_month").cast("string").alias("purchase_month"), "order_status").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_order_value").alias("total_value")
    )


# Quality.


def _test_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failing_unique(_raw(spark, sf_dir)["order_items"], ["order_id", "order_item_id"])


def _test_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = quality.failing_not_null(_raw(spark, sf_dir)["customers"], "customer_unique_id")
    return customers.select("customer_id", "customer_city", "customer_state")


def _test_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failing_accepted_values(_raw(spark, sf_dir)["orders"], "order_status", ORDER_STATUSES)


def _test_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    products = raw["products"].select("product_id", "product_category_name")
    names = raw["product_category_name_translation"]
    return quality.failing_relationships(products, "product_category_name", names, "product_category_name")


def _quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _lake(spark, sf_dir)
    return quality.quality_report(lake, lake)


def _delete_shipped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _lake(spark, sf_dir)
    shipped = lake["orders"].where("order_status = 'shipped'").select("order_id")
    changed = propagate_deletes(lake, "orders", shipped)
    rows = [df.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows_left")) for t, df in changed.items()]
    return reduce(DataFrame.unionByName, rows)


def _delete_southern_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _lake(spark, sf_dir)
    south = lake["geolocation"].where("geolocation_lat < 0").select("geolocation_zip_code_prefix")
    changed = propagate_deletes(lake, "geolocation", south)
    zips = {
        "customers": "customer_zip_code_prefix",
        "sellers": "seller_zip_code_prefix",
        "geolocation": "geolocation_zip_code_prefix",
    }
    rows = [
        changed[t].agg(
            F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows_left"), F.count(c).alias("zips_left")
        )
        for t, c in zips.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def _after_delete(parent: str, doomed: str, table: str) -> Query:
    """A stored table after a delete was applied to its store; each delete runs once in an application."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lake = _lake(spark, sf_dir)
        with _LOCK:
            key = (spark.sparkContext.applicationId, sf_dir, parent)
            if key not in _AFTER_DELETE:
                store = Store(spark, fresh_path(spark, "deletes"))
                for t in LOAD_ORDER:
                    # Several files, of which a delete need not touch all.
                    rows = lake[t.name]
                    store.append(rows.repartitionByRange(files_for(rows, least=4), *t.key), t.name)
                delete_rows(store, parent, store[parent].where(doomed))
                _AFTER_DELETE[key] = store
        return _AFTER_DELETE[key][table]

    return query


def _fct_orders_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact by month, built without the last year's orders and half of an earlier month's payments, then refreshed."""
    lake = _lake(spark, sf_dir)
    store, path = Store(spark, fresh_path(spark, "refreshed")), fresh_path(spark, "fact_by_month")
    late = F.col("order_purchase_timestamp") >= "1998-01-01"
    early = F.col("order_purchase_timestamp").between("1995-03-01", "1995-03-20")
    orders = lake["orders"]
    held = orders.where(late | early).select("order_id")
    payments = (lake["payments"], F.col("payment_sequential") == 2)
    store.append(orders.where(~late | late.isNull()), "orders")
    for name, (rows, also) in {
        "payments": payments,
        "order_items": (lake["order_items"], F.lit(True)),
        "order_reviews": (lake["order_reviews"], F.lit(True)),
    }.items():
        store.append(rows.join(held, "order_id", "left_anti"), name)
        store.append(rows.join(held, "order_id", "left_semi").where(~also), name)
    build_fact(store, path)
    before = snapshot(store)
    store.append(orders.where(late), "orders")
    for name in ("payments", "order_items", "order_reviews"):
        insert_if_absent(lake[name], store, name, TABLES[name].key, TABLES[name].unique)
    refresh_fact(store, path, changed_orders(store, before))
    return spark.read.parquet(path).drop("purchase_month")


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix over all orders, its state carried over two loads of which the second brings the earlier orders."""
    lake = _lake(spark, sf_dir)
    tables = {name: lake[name] for name in ("orders", "customers", "geolocation")}
    late = F.col("order_purchase_timestamp") >= "1995-01-01"
    state = written(extensions.first_purchases({**tables, "orders": tables["orders"].where(late)}), "cohort_state")
    state = extensions.first_purchases({**tables, "orders": tables["orders"].where(~late)}, state)
    return extensions.cohorts(tables, written(state, "cohort_state"))


_QUERIES: dict[str, Query] = {
    # Expressions.
    "missing_tokens": _missing_tokens,
    "coerce_numbers": _coerce_numbers,
    "coerce_timestamps": _coerce_timestamps,
    "zero_fill": _zero_fill,
    "exact_average": _exact_average,
    "day_attributes": _day_attributes,
    # Operators.
    "csv_scan": _csv_scan,
    "keep_first": _keep_first,
    "semi_filter": _semi_filter,
    "anti_filter": _anti_filter,
    "null_orphans": _null_orphans,
    "rank_in_ranges": _rank_in_ranges,
    "insert_if_absent": _insert_if_absent,
    "ingest_twice": _ingest_twice,
    **{f"ingest_csv_{t.name}": _ingest_csv(t.name) for t in LOAD_ORDER},
    "catalog_tables": _catalog_tables,
    "stream_ingest": _stream_ingest,
    "stream_children_first": _stream_children_first,
    "load_report": _load_report,
    "csv_unreadable": _csv_unreadable,
    "reject_report": _reject_report,
    # Clean tables.
    "clean_geolocation": _clean("geolocation"),
    "clean_category_translation": _clean("product_category_name_translation"),
    "clean_customers": _clean("customers"),
    "clean_sellers": _clean("sellers"),
    "clean_products": _clean("products"),
    "clean_orders": _clean("orders"),
    "clean_order_items": _clean("order_items"),
    "clean_payments": _clean("payments"),
    "clean_reviews": _clean("order_reviews"),
    # Models.
    **{name: _over_lake(model) for name, model in STAGING.items()},
    **{name: _over_lake(model) for name, model in MARTS.items()},
    "fct_orders_bucketed": _bucketed(fct_orders),
    "fct_orders_refreshed": _fct_orders_refreshed,
    # Reports.
    "seller_geographic_reach": _over_lake(analytics.seller_geographic_reach),
    "seller_geographic_reach_bucketed": _bucketed(analytics.seller_geographic_reach),
    "payment_installments_by_state": _over_lake(analytics.payment_installments_by_state),
    "monthly_revenue_trend": _over_lake(analytics.monthly_revenue_trend),
    "orders_by_month_layout": _orders_by_month_layout,
    # Quality.
    "test_unique": _test_unique,
    "test_not_null": _test_not_null,
    "test_accepted_values": _test_accepted_values,
    "test_relationships": _test_relationships,
    "quality_report": _quality_report,
    "audit_primary_keys": _over_raw(quality.audit_keys),
    "audit_foreign_keys": _over_raw(quality.audit_foreign_keys),
    "audit_checks": _over_raw(quality.audit_checks),
    "audit_not_null": _over_raw(quality.audit_not_null),
    "propagate_deletes_cascade": _delete_shipped_orders,
    "propagate_deletes_set_null": _delete_southern_places,
    **{
        f"after_delete_{name}": _after_delete("orders", "order_status = 'shipped'", name)
        for name in ("orders", "order_items", "payments", "order_reviews")
    },
    **{
        f"after_delete_{name}": _after_delete("geolocation", "geolocation_lat < 0", name)
        for name in ("geolocation", "customers", "sellers")
    },
    # Further reports.
    "delay_impact_on_reviews": _over_lake(lambda lake: extensions.delay_impact_on_reviews(lake["fct_orders"])),
    "revenue_by_category": _over_lake(extensions.revenue_by_category),
    "review_score_distribution": _over_lake(extensions.review_score_distribution),
    "seller_performance": _over_lake(extensions.seller_performance),
    "delivery_delay_summary": _over_lake(extensions.delivery_delay_summary),
    "geo_customers": _over_lake(extensions.geo_customers),
    "geo_sellers": _over_lake(extensions.geo_sellers),
    "trade_between_states": _over_lake(extensions.trade_between_states),
    "returning_shoppers": _over_lake(extensions.returning_shoppers),
    "cohorts": _cohorts,
    "distance_by_state_pair": _over_lake(extensions.distance_by_state_pair),
    "nearest_sellers": _over_lake(extensions.nearest_sellers),
}


def _corpus_queries() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries of the corpus operators and their SQL; nothing where that subpackage is not there."""
    found, sql = {}, {}
    try:
        from mercato.llm import queries as corpus
    except ImportError as missing:
        if missing.name not in ("mercato.llm", "mercato.llm.queries"):
            raise
        return found, sql
    found, sql = dict(corpus.QUERIES), dict(corpus.SQL)
    try:
        import corpus_pipeline
    except ImportError as missing:
        if missing.name != "corpus_pipeline":
            raise
        return found, sql
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def entry(spark: SparkSession) -> DataFrame:
    """Seller geographic reach on the smallest data set."""
    return queries()["seller_geographic_reach"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """Every query: (session, data folder) to DataFrame."""

    def registered(query: Query) -> Query:
        return lambda spark, sf_dir: _portable(query(spark, sf_dir))

    return {name: registered(query) for name, query in _QUERIES.items()} | _corpus_queries()[0]


def oracle_sql() -> dict[str, str]:
    """For each query that SQL can express, the SQL that gives the same rows."""
    return oracle() | _corpus_queries()[1]
