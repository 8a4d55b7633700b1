"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.session import configure, written

#: ASCII white space: blank and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the named types; columns that the operator does not use can have any name."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in types.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, other letters left. Text that is all ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fingerprint(text: Column) -> Column:
    """With the doc_id it tells rows apart; rows that agree in both have equal results in every operator here."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The runs of anything but ASCII white space; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.array_remove(F.split(trimmed, r"[\x20\x09-\x0D]+"), "")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``_rank``, the 0-based place of each row in the given order over the whole table, and ``_rows``, their number.

    Rows are dealt into ranges of the order and sorted there, so a value that many rows share is cut by the
    columns that follow it. The ranges are written once; a row's rank is its place in its range plus the rows
    of earlier ranges. The broadcast side has one row for each range.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = written(ranges.withColumn("_at", F.monotonically_increasing_id()), name)
    span = F.shiftright("_at", 33)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(span.alias("_range")).agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select(
        "_range",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
        F.sum("n").over(Window.partitionBy()).alias("_rows"),
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("_range", span).join(F.broadcast(starts), "_range")
    return joined.withColumn("_rank", F.col("_before") + within).drop("_range", "_before", "_at")


def small_batches(df: DataFrame) -> DataFrame:
    """Batches sent to Python hold a few hundred documents, so that long ones do not fill a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return df


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``remainder``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % of == remainder, F.lit(False))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _k1 and _k2, a 128-bit hash of the whole row. Rows that agree in it are interchangeable."""
    columns = [F.col(c) for c in docs.columns]
    nulls = F.concat(*[c.isNull().cast("string") for c in columns])
    return docs.withColumns({"_k1": F.xxhash64(nulls, *columns), "_k2": F.xxhash64(F.lit(1), nulls, *columns)})


def whole_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``decided`` (rows with _k1 and _k2) with the row of ``docs`` that has the key, as a struct ``_doc``.

    Texts are dealt by key, which is even whatever the decisions were sorted by. Equal rows are one before they are
    shuffled; decisions stand on the left, so those of one row that is repeated very often can be split.
    """
    rows = keyed(docs).select(F.struct(*docs.columns).alias("_doc"), "_k1", "_k2")
    single = rows.groupBy("_k1", "_k2").agg(F.first("_doc").alias("_doc"))
    return decided.join(single, ["_k1", "_k2"]).drop("_k1", "_k2")
