"""The nine raw CSV files of a data folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mercato.functions.text import without_missing_tokens
from mercato.operators.keys import arrival
from mercato.operators.rules import UNREADABLE
from mercato.schemas import LOAD_ORDER, Table


def file_order() -> list[Column]:
    """Position of a row in its files. Only valid right at the scan, before any shuffle."""
    return arrival("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())


#: Where the reader puts the text of a row that it cannot parse.
_TEXT = "_unparsed"


def _text_columns(names: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in [*names, _TEXT]])


def _rows(reader, path: str, table: Table, order: list[Column]) -> DataFrame:
    """The rows, each marked whether it has too few or too many fields, as a quote that is not closed also gives.

    In the last field of a line such a quote ends with the line and loses nothing. In a table whose texts may hold line
    breaks it takes in what follows, up to the next quote.
    """
    reader = reader.option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", _TEXT)
    # A row's fields are counted whatever columns a query needs in the end.
    reader = reader.option("columnPruning", False)
    rows = reader.option("escape", '"').option("multiLine", table.multiline).csv(path)
    unreadable = F.col(_TEXT).isNotNull().alias(UNREADABLE)
    return without_missing_tokens(rows.select(*table.columns, unreadable, *order))


def read_csv(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """One raw table, every column as text, with its arrival order and a mark on rows that cannot be parsed.

    Columns are found by their names in the first file's header; a file with another header is an error. Texts that
    may hold line breaks make a file unsplittable: such a table should come as many files, or be read once into the
    store.
    """
    header = spark.read.option("header", True).option("escape", '"').option("multiLine", table.multiline).csv(path)
    return _rows(spark.read.schema(_text_columns(header.columns)), path, table, file_order())


def stream_csv(spark: SparkSession, folder: str, table: Table) -> DataFrame:
    """The files of one raw table as they arrive, in the order of their arrival.

    A stream needs its columns beforehand: a file whose header is not the declared one is an error.
    """
    order = arrival("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    return _rows(spark.readStream.schema(_text_columns(table.columns)), folder, table, order)


def read_csv_folder(spark: SparkSession, folder: str, files: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """All raw tables of a folder; ``files`` overrides the file (or file pattern) of a table."""
    files = files or {}
    return {t.name: read_csv(spark, f"{folder.rstrip('/')}/{files.get(t.name, t.file)}", t) for t in LOAD_ORDER}
