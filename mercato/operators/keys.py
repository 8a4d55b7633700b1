"""Operators on keys: first row per key, membership, dangling references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Raw tables carry their arrival order in columns with this prefix, the most significant first.
ARRIVAL = "_arrival_"


def arrival(*columns: str | Column) -> list[Column]:
    """The columns, to be selected along with a raw table, that say in which order its rows came."""
    return [(F.col(c) if isinstance(c, str) else c).alias(f"{ARRIVAL}{n}") for n, c in enumerate(columns)]


def arrival_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(ARRIVAL)]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """The first row of each key under a total order, by default that of arrival.

    The filter on ``row_number`` makes Spark cut each task's rows to one per key before the
    shuffle, so a key with many copies never meets in one place.
    """
    order = list(order) or arrival_columns(df)
    if not order:
        raise ValueError("no order: which row comes first would be left to chance")
    copies = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") == 1).drop("_copy")


def drop_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def in_domain(column: str, values: Sequence) -> Column:
    return F.col(column).isin(*values)


def semi_filter(df: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose ``column`` is one of the parent keys."""
    keys = parents.select(F.col(parent_column).alias("_parent"))
    return df.join(keys, df[column] == keys["_parent"], "left_semi")


def anti_filter(df: DataFrame, columns: Sequence[str], stored: DataFrame) -> DataFrame:
    """Rows whose key is not among the stored keys."""
    return df.join(stored.select(*columns), list(columns), "left_anti")


def null_orphans(df: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """Keep every row, but null a reference that has no parent. Parent keys are unique."""
    keys = parents.select(F.col(parent_column).alias("_parent"))
    joined = df.join(keys, df[column] == keys["_parent"], "left")
    return joined.withColumn(column, F.col("_parent")).drop("_parent")
