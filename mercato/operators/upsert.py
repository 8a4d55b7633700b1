"""Insert-if-absent loading."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import ExitStack

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mercato.operators.keys import anti_filter
from mercato.session import written_meanwhile
from mercato.sources.store import Store


def insert_if_absent(
    new: DataFrame,
    store: Store,
    table: str,
    key: Sequence[str],
    unique: Sequence[Sequence[str]] = (),
    keys: DataFrame | None = None,
    stored: Callable[[], None] = lambda: None,
) -> int:
    """Append the rows whose key is not stored yet and return how many there were.

    Stored rows are never changed. ``new`` holds each key once and has no null keys. ``unique`` lists further column
    sets that must stay unique in the store.

    Where the table exists already, the keys of ``new`` are written first and looked up in the buckets of the key index
    that they fall in, so a small batch reads a small part of the stored keys. Rows are worked out only if a key is
    absent: a batch that is stored already costs its keys. ``keys``: these keys, if they are written already. ``stored`` is
    called once the table holds the rows, before the index has their keys.
    """
    indexes = [store.key_index(table, columns) for columns in (key, *unique)]
    with ExitStack() as meanwhile:
        if table in store:
            if keys is None:
                columns = dict.fromkeys(c for index in indexes for c in index.columns)
                keys = meanwhile.enter_context(written_meanwhile(new.select(*columns), f"keys_{table}"))
            absent = keys
            for index in indexes:
                absent = anti_filter(absent, index.columns, index.keys_near(keys))
            count = Observation()
            absent = absent.observe(count, F.count(F.lit(1)).alias("rows"))
            absent = meanwhile.enter_context(written_meanwhile(absent, f"absent_{table}"))
            rows = count.get["rows"]
            if not rows:
                stored()
                return 0
            # Each row has a key of its own: where no key is stored, all rows are new and need not be shuffled for it.
            if rows < keys.count():
                new = new.join(absent.select(*key), list(key), "left_semi").select(*new.columns)
        else:
            absent = None
        for index in indexes:
            index.begin()
        inserted = Observation()
        store.append(new.observe(inserted, F.count(F.lit(1)).alias("rows")), table)
        stored()
        for index in indexes:
            index.add(store[table] if absent is None else absent)
        return inserted.get["rows"]
