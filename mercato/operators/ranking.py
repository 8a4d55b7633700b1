"""Ranks over a whole table that do not sort the table in one task.

``counted_ranks`` is for the few rows that a report shows, ``rank_in_ranges`` for the rank of every row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.session import written


def counted_ranks(df: DataFrame, shown: DataFrame, ranks: Mapping[str, str]) -> DataFrame:
    """Add ``name: rank of value in df, highest first`` columns to ``shown``, a few rows of ``df``.

    The values shown are thresholds. One pass over ``df`` counts its rows between them, after partial sums one row for
    each pair of thresholds and task; the rows above a threshold, and so its rank, are sums over those counts. Nothing
    is sorted, written, or run before the result is asked for. The rows shown, their thresholds and the counts are
    single rows that grow with ``shown`` alone. A null value ranks above all others.
    """
    values, places = list(ranks.values()), [f"_place_{n}" for n in range(len(ranks))]
    limits = [F.sort_array(F.collect_set(v)).alias(p) for v, p in zip(values, places)]
    known = shown.agg(F.struct(F.collect_list(F.struct(*shown.columns)).alias("rows"), *limits)).scalar()

    def place(value: Column, mine: Column) -> Column:
        """How many of the thresholds lie below the value."""
        return F.when(value.isNull(), F.size(mine)).otherwise(F.size(F.filter(mine, lambda limit: limit < value)))

    # Spark takes a subquery's value into a lambda function only as a column.
    limited = df.select(*values, known.alias("_known"))
    mine = [place(F.col(v), F.col("_known")[p]).alias(p) for v, p in zip(values, places)]
    counted = limited.groupBy(*mine).agg(F.count(F.lit(1)).alias("_n"))
    bars = counted.agg(F.collect_list(F.struct(*places, "_n")).alias("_bars")).withColumn("_known", known)

    def rank(value: Column, p: str) -> Column:
        above = F.filter("_bars", lambda bar: bar[p] > place(value, F.col("_known")[p]))
        rows = F.aggregate(above, F.lit(0).cast("bigint"), lambda total, bar: total + bar["_n"])
        return F.when(value.isNull(), F.lit(1).cast("bigint")).otherwise(rows + 1)

    found = bars.select("_bars", "_known", F.explode("_known.rows").alias("_row"))
    return found.select("_row.*", *[rank(F.col("_row")[v], p).alias(name) for (name, v), p in zip(ranks.items(), places)])


def ranks_of_values(df: DataFrame, value: str, name: str, slices: int | None = None) -> DataFrame:
    """Each distinct value with its ``rank() over (order by value desc nulls first)``.

    Equal values are counted first, so a value that many rows share is one row from then on. Spark cuts the counted
    values into ranges of about equal numbers of values, as many as there are shuffle partitions; they are written
    once with the number of their range. A rank is the rows in higher ranges plus the rows above it in its own range
    plus one, so it is exact wherever the cuts lie. Runs a job while the plan is built.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    column = F.col(value)
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranges = counted.repartitionByRange(slices, column.desc_nulls_first())
    placed = written(ranges.withColumn("_slice", F.spark_partition_id()), "ranges")

    # One row per range; Spark sees from the plan that this is broadcast only if it is small.
    higher = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_slice").agg(F.sum("_n").alias("_rows"))
    starts = sizes.select("_slice", F.coalesce(F.sum("_rows").over(higher), F.lit(0)).alias("_start"))

    inside = Window.partitionBy("_slice").orderBy(column.desc_nulls_first())
    before = F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(starts, "_slice").select(
        column.alias(f"_{value}"), (F.col("_start") + before + 1).cast("bigint").alias(name)
    )


def rank_in_ranges(df: DataFrame, ranks: Mapping[str, str], slices: int | None = None) -> DataFrame:
    """Add ``name: rank of value, highest first`` columns without sorting the table in one task.

    The table is read once per rank and once more: write it first if it is costly. Each rank comes from the table
    itself, not from a table that has other ranks joined to it already.
    """
    ranked = df
    for name, value in ranks.items():
        values = ranks_of_values(df, value, name, slices)
        ranked = ranked.join(values, ranked[value].eqNullSafe(values[f"_{value}"])).drop(f"_{value}")
    return ranked
