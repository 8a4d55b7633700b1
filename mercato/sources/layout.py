"""Physical layouts: what secondary indexes are for, as files that need no shuffle or get skipped."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tables that all joins on an order touch.
ORDER_TABLES = ("orders", "order_items", "payments", "order_reviews")


#: Bytes of a table that a bucket should hold at most, by Spark's estimate.
BUCKET_BYTES = 16 << 20
#: Bytes of a table that a file should hold about.
FILE_BYTES = 16 << 20


def _bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def files_for(df: DataFrame, least: int) -> int:
    """A file for each ``FILE_BYTES`` of the table by its files' size."""
    return max(least, -(-_bytes(df) // FILE_BYTES))


def buckets_for(df: DataFrame) -> int:
    """A bucket for each ``BUCKET_BYTES`` of the table by its files' size, and one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-_bytes(df) // BUCKET_BYTES))


def write_buckets(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Save as an external table hashed and sorted by ``key``: joins and groups on it need no shuffle.

    One task reads a bucket, which the optimizer cannot split later: the layout is for keys that have few rows each,
    such as orders. For other keys leave a table as it is.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def bucket_by_order(
    tables: Mapping[str, DataFrame], root: str, buckets: int | None = None, prefix: str = "by_order_"
) -> dict[str, DataFrame]:
    """All tables, with those that carry an order id bucketed alike by it: as the largest of them needs."""
    others = {name: tables[name] for name in tables if name not in ORDER_TABLES}
    buckets = buckets or max(buckets_for(tables[name]) for name in ORDER_TABLES)
    bucketed = {
        name: write_buckets(tables[name], f"{prefix}{name}", f"{root}/{name}", "order_id", buckets)
        for name in ORDER_TABLES
    }
    return {**others, **bucketed}


def write_by_month(
    df: DataFrame, path: str, moment: str, sort: str, month: str = "purchase_month", only_months: bool = False
) -> DataFrame:
    """Save with one folder per month, sorted by ``sort`` within files; ``only_months``: other months stay.

    A range of months reads only its folders, a value of ``sort`` only its row groups. The
    rebalance hint gives each month a few full files and splits a month that is too large.
    """
    spark = df.sparkSession
    by_month = df.withColumn(month, F.date_format(moment, "yyyy-MM")).hint("rebalance", F.col(month))
    writer = by_month.sortWithinPartitions(month, sort).write.mode("overwrite").partitionBy(month)
    writer.option("partitionOverwriteMode", "dynamic" if only_months else "static").parquet(path)
    return spark.read.option("basePath", path).parquet(path)
