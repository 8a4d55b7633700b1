"""Stored tables in the catalog, so that they can be queried by name."""

from __future__ import annotations

from collections.abc import Iterable

from mercato.schemas import TABLES
from mercato.sources.store import Store


def register(store: Store, database: str, tables: Iterable[str]) -> None:
    """Make catalog tables of stored ones, with their comments. The files stay where they are.

    A table that is registered already gets its present place and columns.
    """
    spark = store.spark
    spark.sql(f"create database if not exists {database}")
    for name in tables:
        store[name]  # A derived table is built when it is first asked for.
        spark.sql(f"drop table if exists {database}.{name}")
        comment = TABLES[name].comment if name in TABLES else ""
        spark.catalog.createTable(
            f"{database}.{name}", path=store.path(name), source="parquet", description=comment
        )
