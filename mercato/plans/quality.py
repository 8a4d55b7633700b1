"""Data tests on the models and constraint audits on the tables.

A test gives the rows that fail it. Nulls do not fail uniqueness, accepted values, references or
checks; that is what the not-null test is for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.plans.marts import MARTS
from mercato.plans.staging import STAGING
from mercato.schemas import LOAD_ORDER, ORDER_STATUSES, REVIEW_SCORES, Table

Tables = Mapping[str, DataFrame]


def failing_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, and how often."""
    return df.na.drop(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def failing_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def failing_accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list, and how often they occur."""
    return df.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("copies"))


def failing_relationships(df: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Rows with a reference that no parent has."""
    # Copies of a parent key go before the shuffle: an anti join cannot split them.
    keys = parents.select(F.col(parent_column).alias("_parent")).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


@dataclass(frozen=True)
class ModelTests:
    """The data tests of one model."""

    model: str
    unique: str | None = None
    not_null: tuple[str, ...] = ()
    accepted_values: dict[str, tuple] = field(default_factory=dict)
    relationships: dict[str, tuple[str, str]] = field(default_factory=dict)


MODEL_TESTS = (
    ModelTests("stg_orders", "order_id", ("order_id", "customer_id"), {"order_status": ORDER_STATUSES}),
    ModelTests("stg_customers", "customer_id", ("customer_id", "customer_unique_id")),
    ModelTests("stg_sellers", "seller_id", ("seller_id",)),
    ModelTests("stg_products", "product_id", ("product_id",)),
    ModelTests("stg_order_items", None, ("order_id", "product_id", "seller_id")),
    ModelTests("stg_payments", None, ("order_id", "payment_value")),
    ModelTests("stg_order_reviews", "review_id", ("review_id",), {"review_score": REVIEW_SCORES}),
    ModelTests(
        "fct_orders",
        "order_id",
        ("order_id", "customer_id"),
        relationships={"customer_id": ("dim_customers", "customer_id")},
    ),
    ModelTests("dim_customers", "customer_id", ("customer_id",)),
    ModelTests("dim_sellers", "seller_id", ("seller_id",)),
    ModelTests("dim_products", "product_id", ("product_id",)),
    ModelTests("dim_dates", "date_day", ("date_day",)),
)


def _rows(counts: DataFrame, labels: Sequence[tuple[str, ...]], names: Sequence[str]) -> DataFrame:
    """Turn one row of counts ``c0, c1, …`` into one row per count, with its labels."""
    entries = [
        F.struct(*[F.lit(text).alias(name) for text, name in zip(label, names)], F.col(f"c{n}").alias("failures"))
        for n, label in enumerate(labels)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*")


def _test_results(tests: ModelTests, models: Mapping[str, DataFrame]) -> list[DataFrame]:
    df, names = models[tests.model], ("model", "column_name", "test")
    nulls = [F.count_if(F.col(c).isNull()) for c in tests.not_null]
    labels = [(tests.model, c, "not_null") for c in tests.not_null]
    if tests.unique:
        # Nulls and copies come out of one aggregation per key.
        per_key = df.groupBy(tests.unique).agg(
            F.count(F.lit(1)).alias("_copies"), *[c.alias(f"n{n}") for n, c in enumerate(nulls)]
        )
        repeated = F.count_if(F.col(tests.unique).isNotNull() & (F.col("_copies") > 1))
        totals = [F.coalesce(F.sum(f"n{n}"), F.lit(0)) for n in range(len(nulls))]
        counts, labels = [repeated, *totals], [(tests.model, tests.unique, "unique"), *labels]
        df_counts = per_key.agg(*[c.alias(f"c{n}") for n, c in enumerate(counts)])
    else:
        df_counts = df.agg(*[c.alias(f"c{n}") for n, c in enumerate(nulls)])
    results = [_rows(df_counts, labels, names)]
    for column, values in tests.accepted_values.items():
        bad = failing_accepted_values(df, column, values)
        results.append(
            _rows(bad.agg(F.count(F.lit(1)).alias("c0")), [(tests.model, column, "accepted_values")], names)
        )
    for column, (parent, parent_column) in tests.relationships.items():
        bad = failing_relationships(df, column, models[parent], parent_column)
        results.append(_rows(bad.agg(F.count(F.lit(1)).alias("c0")), [(tests.model, column, "relationships")], names))
    return results


def quality_report(tables: Tables, marts: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """All 31 data tests: (model, column_name, test, failures, status).

    ``marts`` are the materialized gold tables; without them they are worked out on the way.
    """
    models = {name: model(tables) for name, model in STAGING.items()}
    models.update({name: marts[name] if marts is not None else model(tables) for name, model in MARTS.items()})
    results = [r for tests in MODEL_TESTS for r in _test_results(tests, models)]
    status = F.when(F.col("failures") == 0, "PASS").otherwise("FAIL").alias("status")
    return reduce(DataFrame.unionByName, results).select("*", status)


def _audit(
    tables: Tables, names: Sequence[str], per_table: Callable[[Table, DataFrame], list[DataFrame]]
) -> DataFrame:
    results = [r for t in LOAD_ORDER for r in per_table(t, tables[t.name])]
    return reduce(DataFrame.unionByName, results).select(*names, F.col("failures").alias("violations"))


def audit_keys(tables: Tables) -> DataFrame:
    """Primary and unique keys: key values held by more than one row."""
    names = ("table_name", "kind", "key_columns")

    def per_table(table: Table, df: DataFrame) -> list[DataFrame]:
        keys = [("primary key", table.key), *[("unique", columns) for columns in table.unique]]
        return [
            _rows(
                failing_unique(df, columns).agg(F.count(F.lit(1)).alias("c0")),
                [(table.name, kind, ", ".join(columns))],
                names,
            )
            for kind, columns in keys
        ]

    return _audit(tables, names, per_table)


def audit_foreign_keys(tables: Tables) -> DataFrame:
    """Rows with a reference that no parent has."""
    names = ("table_name", "column_name", "parent_table")

    def per_table(table: Table, df: DataFrame) -> list[DataFrame]:
        return [
            _rows(
                failing_relationships(df, fk.column, tables[fk.parent], fk.parent_column).agg(
                    F.count(F.lit(1)).alias("c0")
                ),
                [(table.name, fk.column, fk.parent)],
                names,
            )
            for fk in table.references
        ]

    return _audit(tables, names, per_table)


def audit_checks(tables: Tables) -> DataFrame:
    """Rows that break a check, all checks of a table in one aggregation."""
    names = ("table_name", "check_name")

    def per_table(table: Table, df: DataFrame) -> list[DataFrame]:
        if not table.checks:
            return []
        broken = [F.count_if(~F.coalesce(F.expr(text), F.lit(True))) for text in table.checks.values()]
        counts = df.agg(*[c.alias(f"c{n}") for n, c in enumerate(broken)])
        return [_rows(counts, [(table.name, check) for check in table.checks], names)]

    return _audit(tables, names, per_table)


def audit_not_null(tables: Tables) -> DataFrame:
    """Nulls in required columns, all columns of a table in one aggregation."""
    names = ("table_name", "column_name")

    def per_table(table: Table, df: DataFrame) -> list[DataFrame]:
        nulls = [F.count_if(F.col(c).isNull()).alias(f"c{n}") for n, c in enumerate(table.required)]
        return [_rows(df.agg(*nulls), [(table.name, c) for c in table.required], names)]

    return _audit(tables, names, per_table)
