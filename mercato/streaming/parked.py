"""Rows that came before their parents: they wait in the store and are tried again when parents arrive."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators.upsert import insert_if_absent
from mercato.plans.clean import clean_and_waiting
from mercato.schemas import LOAD_ORDER, TABLES
from mercato.session import written_meanwhile
from mercato.sources.key_index import located
from mercato.sources.store import Store


class Parked:
    """The waiting raw rows of one table, in numbered versions of which the last complete one counts."""

    def __init__(self, store: Store, table: str):
        self.store, self.folder = store, f"{store.root}/parked/{table}"

    def _versions(self) -> list[int]:
        files, path = located(self.store.spark, self.folder)
        if not files.exists(path):
            return []
        names = [int(status.getPath().getName()) for status in files.listStatus(path)]
        return sorted(n for n in names if files.exists(located(self.store.spark, f"{self.folder}/{n}/_SUCCESS")[1]))

    def rows(self) -> DataFrame | None:
        versions = self._versions()
        return self.store.spark.read.parquet(f"{self.folder}/{versions[-1]}") if versions else None

    def replace(self, rows: DataFrame) -> None:
        """Store a new version. The one before it stays, for those who read it now; older ones go."""
        versions = self._versions()
        writer = rows.write.mode("overwrite").option("compression", "zstd")
        writer.parquet(f"{self.folder}/{versions[-1] + 1 if versions else 0}")
        for old in versions[:-1]:
            files, path = located(self.store.spark, f"{self.folder}/{old}")
            files.delete(path, True)


def insert_or_park(batch: DataFrame | None, table: str, store: Store) -> int:
    """Clean a batch with the rows that wait, insert what has its parents, park what lacks one; the rows inserted.

    Then the children that wait for rows of this table are tried again, and theirs. Rows are inserted before the
    waiting ones are replaced: a batch that is repeated after a failure finds its keys stored and parks equal rows
    once. A row that another rule drops does not wait, nor does a reference that a missing parent only empties.
    ``batch`` carries an order of arrival that tells its rows apart.
    """
    declared, parked = TABLES[table], Parked(store, table)
    before, inserted = parked.rows(), 0
    rows = [df for df in (batch, before) if df is not None]
    if rows:
        with ExitStack() as meanwhile:
            both = rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0]
            if batch is not None:
                # Read by the cleaning, the insert and the parking. Rows that wait alone are files already.
                both = meanwhile.enter_context(written_meanwhile(both, f"arrived_{table}"))
            parents = {fk.parent: _stored(store, fk.parent) for fk in declared.references}
            # A row that is there twice, as after a batch that came again, is cut by the choice of each key's first row.
            good, waiting = clean_and_waiting(table, both, parents)
            inserted = insert_if_absent(good, store, table, declared.key, declared.unique)
            if waiting is not None:
                # The rows of one batch differ, by their place at least.
                parked.replace(waiting if before is None else waiting.distinct())
    for child in LOAD_ORDER:
        if any(fk.parent == table for fk in child.references) and Parked(store, child.name).rows() is not None:
            insert_or_park(None, child.name, store)
    return inserted


def _stored(store: Store, table: str) -> DataFrame:
    if table in store:
        return store[table]
    # A plan knows from the filter that nothing is there, and joins nothing.
    return store.spark.createDataFrame([], TABLES[table].schema).where(F.lit(False))
