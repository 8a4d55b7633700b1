"""The keys of stored tables, kept apart from them and dealt into buckets, so that a batch reads only the buckets it hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets that the keys of a table are dealt into by their hash; a larger store takes more.
BUCKETS = 16
_BUCKET = "key_bucket"


def located(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


class KeyIndex:
    """Keys in ``columns`` of the rows stored in one table, below ``folder``.

    A folder for each bucket holds Parquet files with the key columns alone. A mark is set before rows are appended to
    the table and taken away once their keys are here as well: where it is found, a write did not end, and the
    index is made anew from the table.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.columns, self.buckets = spark, list(columns), buckets
        self.folder = f"{folder}/{'-'.join(columns)}-{buckets}"
        self.mark = f"{self.folder}.writing"

    def _bucket(self) -> Column:
        # Text of the key, so that its type in a batch does not matter.
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.columns]), F.lit(self.buckets)).cast("int")

    def begin(self) -> None:
        files, mark = located(self.spark, self.mark)
        files.create(mark, True).close()

    def is_whole(self) -> bool:
        files, mark = located(self.spark, self.mark)
        return files.exists(located(self.spark, f"{self.folder}/_SUCCESS")[1]) and not files.exists(mark)

    def add(self, keys: DataFrame, mode: str = "append") -> None:
        """Store the keys of rows that the table has by now."""
        dealt = keys.select(*self.columns).withColumn(_BUCKET, self._bucket())
        # One file for each bucket, or several where its keys are too many for a task.
        dealt.hint("rebalance", F.col(_BUCKET)).write.mode(mode).partitionBy(_BUCKET).parquet(self.folder)
        files, mark = located(self.spark, self.mark)
        files.delete(mark, False)

    def rebuild(self, stored: DataFrame) -> None:
        self.begin()
        self.add(stored, mode="overwrite")

    def keys_near(self, batch: DataFrame) -> DataFrame:
        """Stored keys in the buckets that the keys of ``batch``, a written table, fall in.

        The list of buckets is bounded by their number.
        """
        hit = sorted(r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect())
        kinds = ", ".join(f"{c} {kind}" for c, kind in batch.select(*self.columns).dtypes)
        stored = self.spark.read.schema(f"{kinds}, {_BUCKET} int").parquet(self.folder)
        return stored.where(F.col(_BUCKET).isin(hit)).select(*self.columns)
