"""Deletes applied to a store: only the files that hold a row that changes are written anew."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators.deletes import propagate_deletes, rows_that_change
from mercato.schemas import LOAD_ORDER, TABLES
from mercato.sources.key_index import located
from mercato.sources.store import Store

_JOURNAL = "journal.json"


def delete_rows(store: Store, parent: str, keys: DataFrame) -> dict[str, int]:
    """Delete the rows of ``parent`` with these keys and what the references say; the files replaced in each table.

    A delete that a reference forbids changes nothing. Otherwise the new content of the files concerned is
    written beside the tables; then a journal names the old and the new files, and from there on the delete takes place:
    ``finish_deletes`` does what is left of it, however often it was broken off. Until it ends a reader may miss rows of the
    files concerned. All other files stay as they are. The list of files is what comes to the driver.
    """
    spark = store.spark
    finish_deletes(store)
    whole = {t.name: store[t.name] for t in LOAD_ORDER if t.name in store}
    # Looks at the references that forbid the delete.
    propagate_deletes(whole, parent, keys)
    named = {name: df.select("*", F.col("_metadata.file_path").alias("_file")) for name, df in whole.items()}
    changing = rows_that_change(named, parent, keys)
    files = {name: sorted(r[0] for r in df.select("_file").distinct().collect()) for name, df in changing.items()}
    files = {name: paths for name, paths in files.items() if paths}
    if not files:
        return {}
    parts = {name: spark.read.schema(whole[name].schema).parquet(*paths) for name, paths in files.items()}
    after = propagate_deletes({**whole, **parts}, parent, keys)

    folder = f"{store.root}/deletes/{uuid.uuid4().hex[:12]}"
    journal = []
    # Children first, so that no reader finds one without its parent for long.
    for name in [t.name for t in reversed(LOAD_ORDER) if t.name in files]:
        staged = f"{folder}/{name}"
        after[name].write.parquet(staged)
        system, path = located(spark, staged)
        new = [status.getPath().toString() for status in system.listStatus(path)]
        journal.append({"table": name, "old": files[name], "new": [f for f in new if f.endswith(".parquet")]})
    system, path = located(spark, f"{folder}/{_JOURNAL}.part")
    stream = system.create(path, True)
    stream.write(bytearray(json.dumps(journal).encode()))
    stream.close()
    system.rename(path, located(spark, f"{folder}/{_JOURNAL}")[1])
    finish_deletes(store)
    return {name: len(paths) for name, paths in files.items()}


def finish_deletes(store: Store) -> None:
    """Do what is left of deletes that were broken off; drop what never came as far as a journal."""
    spark = store.spark
    system, root = located(spark, f"{store.root}/deletes")
    if not system.exists(root):
        return
    for status in system.listStatus(root):
        folder = status.getPath().toString()
        _, journal = located(spark, f"{folder}/{_JOURNAL}")
        if system.exists(journal):
            lines = spark.read.text(journal.toString()).collect()
            for entry in json.loads("".join(r[0] for r in lines)):
                _replace(store, entry["table"], entry["old"], entry["new"])
        system.delete(status.getPath(), True)


def _replace(store: Store, table: str, old: list[str], new: list[str]) -> None:
    """Each step can be done again: a file that is gone already, or moved already, is passed over."""
    declared = TABLES[table]
    for columns in (declared.key, *declared.unique):
        # The keys of rows that went are in the index until it is made anew.
        store.key_index(table, columns).begin()
    for path in old:
        system, file = located(store.spark, path)
        system.delete(file, False)
    for path in new:
        system, file = located(store.spark, path)
        if system.exists(file):
            system.rename(file, located(store.spark, f"{store.path(table)}/{file.getName()}")[1])
    store.spark.catalog.refreshByPath(store.path(table))
