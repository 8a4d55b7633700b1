"""Loading: clean the raw tables and insert what the store does not hold yet."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mercato.operators.rules import Losses
from mercato.operators.upsert import insert_if_absent
from mercato.plans.clean import clean, rejects
from mercato.schemas import LOAD_ORDER, Table
from mercato.session import Stages, shuffles_removed, written
from mercato.sources.csv import read_csv_folder
from mercato.sources.store import Store

BATCH, BATCH_AND_STORED = "batch", "batch+stored"
_PARENTS = {fk.parent for t in LOAD_ORDER for fk in t.references}


@dataclass(frozen=True)
class Load:
    """What a load did: rows gained by each table, and (table_name, step, rule, rows_left, rows_dropped) of its rules."""

    inserted: dict[str, int]
    losses: list[tuple[str, int, str, int, int]]

    def report(self, spark: SparkSession) -> DataFrame:
        """The losses in the form of the reject report; one row for each rule."""
        schema = "table_name string, step int, rule string, rows_left bigint, rows_dropped bigint"
        return spark.createDataFrame(self.losses, schema)


def load(raw: Mapping[str, DataFrame], store: Store, parents: str = BATCH) -> Load:
    """Load all tables, parents first, and count on the way what each rule drops.

    ``parents="batch"`` accepts a child only if its parent is part of the same batch, even when
    the store holds the parent. ``"batch+stored"`` looks at both.
    """
    if parents not in (BATCH, BATCH_AND_STORED):
        raise ValueError(f"parents must be {BATCH!r} or {BATCH_AND_STORED!r}, not {parents!r}")
    ready: dict[str, Future[DataFrame]] = {t.name: Future() for t in LOAD_ORDER}

    def load_table(table: Table) -> tuple[int, list[tuple]]:
        with closing(Stages(f"cleaned_{table.name}")) as staged:
            return load_staged(table, staged)

    def load_staged(table: Table, staged: Stages) -> tuple[int, list[tuple]]:
        # Parents come first in the pool, which has a thread for each table.
        known = {fk.parent: ready[fk.parent].result() for fk in table.references}
        counted = Losses(table.name)
        rows, keys = clean(table.name, raw[table.name], known, counted, staged), None
        is_new = table.name not in store
        if table.name in _PARENTS and not is_new and parents == BATCH:
            # Looked up by the insert and by every child.
            keys = written(rows.select(*table.key), f"batch_{table.name}")
            ready[table.name].set_result(keys)

        def stored() -> None:
            """By now the store holds this batch. It holds nothing else if the table is new."""
            if keys is None:
                ready[table.name].set_result(store[table.name])

        inserted = insert_if_absent(rows, store, table.name, table.key, table.unique, keys, stored)
        found = counted.rows()
        if found is None:
            found = [tuple(r) for r in rejects(table.name, raw[table.name], known).orderBy("step").collect()]
        return inserted, found

    def guarded(table: Table) -> tuple[int, list[tuple]]:
        try:
            return load_table(table)
        except BaseException as failure:
            if not ready[table.name].done():
                ready[table.name].set_exception(failure)
            raise

    # A table starts when its parents' rows are there; tables that do not refer to each other share the cluster.
    with shuffles_removed(store.spark), ThreadPoolExecutor(len(LOAD_ORDER)) as pool:
        done = dict(zip([t.name for t in LOAD_ORDER], pool.map(guarded, LOAD_ORDER)))
    inserted = {name: rows for name, (rows, _) in done.items()}
    return Load(inserted, [row for _, losses in done.values() for row in losses])


def ingest(raw: Mapping[str, DataFrame], store: Store, parents: str = BATCH) -> dict[str, int]:
    """Load all tables; return how many rows each one gained."""
    return load(raw, store, parents).inserted


def reset(store: Store) -> None:
    """Remove all tables, children before parents, for a load from scratch."""
    for table in reversed(LOAD_ORDER):
        store.drop(table.name)


def load_folder(spark: SparkSession, folder: str, store_root: str, parents: str = BATCH) -> Load:
    """Load the raw CSV files of a folder into the store at ``store_root``."""
    return load(read_csv_folder(spark, folder), Store(spark, store_root), parents)


def ingest_folder(spark: SparkSession, folder: str, store_root: str, parents: str = BATCH) -> dict[str, int]:
    """Load a folder; return how many rows each table gained."""
    return load_folder(spark, folder, store_root, parents).inserted
