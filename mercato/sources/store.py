"""Tables kept as Parquet folders below one root."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from mercato.sources.key_index import BUCKETS, KeyIndex, located


class Store(Mapping):
    """A folder of Parquet tables, used like a dictionary of DataFrames."""

    def __init__(self, spark: SparkSession, root: str, key_buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.key_buckets = key_buckets
        # Schemas of the tables seen so far: a reader that is told the schema opens no file for it.
        self._known: dict[str, StructType] = {}

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self:
            raise KeyError(table)
        return self.spark.read.schema(self._known[table]).parquet(self.path(table))

    def __contains__(self, table: object) -> bool:
        if table not in self._known and self._is_written(str(table)):
            self._known[table] = self.spark.read.parquet(self.path(table)).schema
        return table in self._known

    def _is_written(self, table: str) -> bool:
        """Whether the table's folder holds data: one that a failed write left empty is no table."""
        files, path = located(self.spark, self.path(table))
        if not files.exists(path):
            return False
        names = [status.getPath().getName() for status in files.listStatus(path)]
        return any(not name.startswith(("_", ".")) for name in names)

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._known))

    def __len__(self) -> int:
        return len(self._known)

    def files(self, table: str) -> set[str]:
        """The data files of a table; none if it is not there."""
        files, path = located(self.spark, self.path(table))
        if not files.exists(path):
            return set()
        names = [status.getPath() for status in files.listStatus(path)]
        return {str(name.toString()) for name in names if not name.getName().startswith(("_", "."))}

    def append(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").parquet(self.path(table))
        self._known.setdefault(table, df.schema)

    def overwrite(self, df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").parquet(self.path(table))
        self._known[table] = df.schema

    def drop(self, table: str) -> None:
        """Remove a table with its files and keys, if it is there."""
        for folder in (self.path(table), self._index_folder(table)):
            files, path = located(self.spark, folder)
            files.delete(path, True)
        self._known.pop(table, None)

    def _index_folder(self, table: str) -> str:
        return f"{self.root}/key_index/{table}"

    def key_index(self, table: str, columns: Sequence[str]) -> KeyIndex:
        """The index of the table's keys, made from the table where it is missing or not whole."""
        index = KeyIndex(self.spark, self._index_folder(table), columns, self.key_buckets)
        if table in self and not index.is_whole():
            index.rebuild(self[table])
        return index


class DerivedStore(Store):
    """A store that builds a table, from the others, when it is first asked for."""

    def __init__(self, spark: SparkSession, root: str, builders: Mapping[str, Callable[[Mapping], DataFrame]]):
        super().__init__(spark, root)
        self.builders = builders
        self._locks: dict[str, RLock] = {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.builders:
            raise KeyError(table)
        with self._locks.setdefault(table, RLock()):
            if table not in self._known:
                self.overwrite(self.builders[table](self), table)
        return self.spark.read.schema(self._known[table]).parquet(self.path(table))

    def __contains__(self, table: object) -> bool:
        return table in self.builders

    def __iter__(self) -> Iterator[str]:
        return iter(self.builders)

    def __len__(self) -> int:
        return len(self.builders)
