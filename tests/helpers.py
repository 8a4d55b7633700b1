"""Small hand-made tables."""

from __future__ import annotations

import os
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators.keys import ARRIVAL
from mercato.schemas import TABLES
from mercato.session import work_dir


def raw_text(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """A raw table as read from CSV: text columns, missing ones null, arrival in list order."""
    columns = TABLES[table].columns
    schema = ", ".join(f"{c} string" for c in columns) + f", {ARRIVAL}0 bigint"
    data = [tuple(row.get(c) for c in columns) + (n,) for n, row in enumerate(rows)]
    return spark.createDataFrame(data, schema)


def typed(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """A clean table with its declared types."""
    df = raw_text(spark, table, [{k: None if v is None else str(v) for k, v in row.items()} for row in rows])
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].schema.fields])


def tuples(df: DataFrame) -> list[tuple]:
    return [tuple(row) for row in df.collect()]


def column(df: DataFrame, name: str | None = None) -> list:
    return [row[name or df.columns[0]] for row in df.collect()]


def dec(text: str | None) -> Decimal | None:
    return None if text is None else Decimal(text)


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


PARENT_ORDERS = [
    {"order_id": f"o{n}", "customer_id": f"c{n}", "order_status": "delivered"} for n in range(1, 10)
]


def shuffled(spark: SparkSession) -> set[str]:
    """The shuffle files that this machine holds."""
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(n).getName() for n in range(files.size())]
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def scratch(spark: SparkSession) -> set[str]:
    """The folders below the work folder."""
    folder = work_dir(spark)
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()
