"""Deletes that follow the declared references."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.schemas import CASCADE, LOAD_ORDER, RESTRICT, TABLES, ForeignKey


class RestrictedDelete(RuntimeError):
    """A row to delete is still referenced."""


def _references(parent: str) -> list[tuple[str, ForeignKey]]:
    return [(t.name, fk) for t in LOAD_ORDER for fk in t.references if fk.parent == parent]


def propagate_deletes(tables: Mapping[str, DataFrame], parent: str, keys: DataFrame) -> dict[str, DataFrame]:
    """All tables that change when the rows of ``parent`` with these keys go.

    ``keys`` holds the parent's key columns. Referencing rows go too, lose the reference, or
    forbid the delete, as declared. The tables passed in stay as they are.
    """
    key = list(TABLES[parent].key)
    keys = keys.select(*key).distinct()
    # A delete that is forbidden changes nothing, so those references are looked at first.
    for child, fk in _references(parent):
        if fk.on_delete == RESTRICT:
            doomed = keys.select(F.col(fk.parent_column).alias(fk.column))
            if not tables[child].join(doomed, fk.column, "left_semi").isEmpty():
                raise RestrictedDelete(f"{child}.{fk.column} refers to rows of {parent}")

    changed = {parent: tables[parent].join(keys, key, "left_anti")}
    for child, fk in _references(parent):
        doomed = keys.select(F.col(fk.parent_column).alias("_gone"))
        rows = changed.get(child, tables[child])
        if fk.on_delete == CASCADE and not _references(child):
            changed[child] = rows.join(doomed, rows[fk.column] == doomed["_gone"], "left_anti")
        elif fk.on_delete == CASCADE:
            gone = rows.join(doomed, rows[fk.column] == doomed["_gone"], "left_semi")
            changed.update(propagate_deletes({**tables, **changed, child: rows}, child, gone))
        elif fk.on_delete != RESTRICT:
            joined = rows.join(doomed, rows[fk.column] == doomed["_gone"], "left")
            kept = F.when(F.col("_gone").isNull(), F.col(fk.column))
            changed[child] = joined.withColumn(fk.column, kept).select(*rows.columns)
    return changed


def rows_that_change(tables: Mapping[str, DataFrame], parent: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table that go or lose a reference with the rows of ``parent`` that have these keys."""
    key = list(TABLES[parent].key)
    keys = keys.select(*key).distinct()
    found = {parent: tables[parent].join(keys, key, "left_semi")}
    for child, fk in _references(parent):
        if fk.on_delete == RESTRICT:
            continue
        doomed = keys.select(F.col(fk.parent_column).alias("_gone"))
        rows = tables[child].join(doomed, tables[child][fk.column] == doomed["_gone"], "left_semi")
        below = rows_that_change(tables, child, rows) if fk.on_delete == CASCADE and _references(child) else {child: rows}
        for name, more in below.items():
            found[name] = found[name].unionByName(more) if name in found else more
    return found
