"""Sharding along a Hilbert curve over language, source and size.

Each dimension is cut into 32 cells: languages and sources by their share of rows, in code point order; sizes by
powers of two. Rows are sorted by the curve index of their cell and cut into runs of equal counts, so that each
shard holds a compact region of all three dimensions and files can be skipped on any of them. Law ``rows``: shard
counts differ by one at most. Rows of a cell follow by text, so equal texts stay together where their metadata agree.

Ranges of the whole sort key are dealt to tasks; a cell with a third of all rows is cut by what follows it in the key.

Defined results: null text has no bytes and checksum 0; null language and source are values of their own, after all
others. Rows that agree in every sort column are interchangeable. With fewer rows than shards the last are empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mercato.llm.common import keyed, partitions, ranked, whole_rows
from mercato.session import written

SHARDS = 24
#: Bits of each dimension.
BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n, dimensions), each cell from 0 up to 2 ** bits."""
    x = np.array(cells, dtype=np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for axis in range(len(x)):
            up = (x[axis] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[axis] ^= swap
        q >>= 1
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            index = (index << 1) | ((x[axis] >> bit) & 1)
    return index


@F.pandas_udf(T.LongType())
def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a, b, c], axis=1), BITS))


def shares(docs: DataFrame, name: str) -> DataFrame:
    """The cell of each value of a column: the share of rows before the middle of the value, times the cells."""
    cells = 1 << BITS
    order = Window.orderBy(F.col(name).asc_nulls_last())
    every = Window.partitionBy()
    rows = docs.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    middle = (F.sum("n").over(order) - F.col("n") / 2) / F.sum("n").over(every)
    cell = F.least(F.floor(middle * cells), F.lit(cells - 1)).cast("int")
    return rows.select(F.col(name).alias("of"), cell.alias(f"{name}_cell"))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


ADDED = ("curve_index", "shard", "slot")


def place(docs: DataFrame, keep: tuple[str, ...], shards: int = SHARDS) -> DataFrame:
    """The columns ``keep`` of ``docs`` with curve_index, shard and slot. Only these are sorted, not the texts."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*keep).alias("row"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        size_of(text).alias("size"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("print"),
        F.col("doc_id").cast("bigint").alias("id"),
    )
    keys = docs.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    for name in ("lang", "source"):
        # Written, so that Spark knows its size and broadcasts it only if it is small.
        cells = written(shares(keys, name), "shard-cells")
        rows = rows.join(cells, rows[name].eqNullSafe(cells["of"]), "left").drop("of")
    # Sizes from 2^4 to 2^20 bytes in half powers; smaller and larger ones take the outer cells.
    level = F.floor((F.log2(F.col("size")) - 4) * 2).cast("int")
    level = F.greatest(F.least(level, F.lit((1 << BITS) - 1)), F.lit(0))
    rows = rows.withColumn("curve_index", curve(F.col("lang_cell"), F.col("source_cell"), level))
    order = [F.col("curve_index"), F.col("print"), F.col("id").asc_nulls_last()]
    places = ranked(rows.select("row", "curve_index", "print", "id"), order, "shard")
    # The first `more` shards hold one row more.
    small, more = F.expr(f"_rows div {shards}"), F.expr(f"_rows % {shards}")
    edge, rank = more * (small + 1), F.col("_rank")
    few = F.greatest(small, F.lit(1))
    early = rank < edge
    number = F.when(early, F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - edge) / few))
    slot = F.when(early, rank % (small + 1)).otherwise((rank - edge) % few)
    return places.select("row.*", "curve_index", number.cast("int").alias("shard"), slot.cast("bigint").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with curve_index, shard and slot; columns of these names are replaced."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ADDED])
    places = place(keyed(docs).select("doc_id", "lang", "source", "text", "_k1", "_k2"), ("_k1", "_k2"), shards)
    return whole_rows(docs, places).select("_doc.*", *ADDED)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """One folder for each shard, rows in the order of the curve."""
    placed = shard(docs, shards)
    n = max(shards, partitions(docs.sparkSession))
    placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
