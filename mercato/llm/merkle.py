"""Merkle manifest of a dataset: one tree of hashes for each language, one over the languages, and a proof for each row.

A leaf is the hash of a row's columns. The leaves of a tree stand in order; while a level has more than one node,
each run of ``FANOUT`` consecutive nodes becomes the hash of its digests. The roots of the trees, in order of the
language, are the leaves of one more tree; its root names the whole dataset.

Each level is a table (tree, place, n, digest). Over a window along a run, lag and lead columns at the offsets 1 to
``FANOUT - 1``, masked by the node's slot and the length of its run, hold the siblings; the rows in slot 0 hash them into
the next level. A level is dealt by (tree, run), so a language that holds most rows is cut like any other, no window
is larger than a run, and the join with the level above needs no further shuffle. Places come from ranges of (language,
doc_id, leaf), so no table is sorted in one task. Every level is written to the shared folder.

Bounded: only the greatest number of leaves of a tree and the root come to the driver. A table of languages is ranked in
ranges too.

Defined results: a null in a column is hashed as ``-``, which no text gives. A null doc_id comes before all others of its
language; rows that share a doc_id stand in the order of their leaves; equal rows have one leaf each and places of
their own. A null language is a tree of its own, the first one. A very long text is hashed whole, one row at a time. An
empty table has no root and no rows. Columns that are not hashed are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import ranked
from mercato.session import written

#: Nodes that become one node of the next level.
FANOUT = 8
#: Columns of a leaf with the types they are hashed as.
COLUMNS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}

_PATH = "array<struct<before:string,after:string>>"


def hash_of(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_of(values: Mapping[str, Column] | None = None) -> Column:
    """Hash of a row; ``values`` replaces columns."""

    def part(name: str) -> Column:
        text = (values or {}).get(name, F.col(name)).cast(COLUMNS[name]).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return hash_of(*[part(name) for name in COLUMNS])


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (doc_id, leaf, other columns asked for, tree, place, n), the levels above them, and the root."""

    leaves: DataFrame
    levels: list[DataFrame]
    trees: DataFrame
    upper: list[DataFrame]
    root: str | None

    def proofs(self) -> DataFrame:
        """The leaves with subroot and path: the siblings before and after each node, level by level up to the root."""
        *below, top = self.upper
        above = top.select("place", F.array().cast(_PATH).alias("path"))
        for level in reversed(below):
            above = _upper_paths(level, above)
        roots = self.trees.select("tree", F.col("place").alias("_place"), F.col("digest").alias("subroot"))
        tops = roots.join(above.select(F.col("place").alias("_place"), "path"), "_place").drop("_place")
        found = None
        for level in reversed([self.leaves, *self.levels]):
            single = level.where("n = 1").join(tops, "tree")
            if found is None:
                found = single
                continue
            runs = found.select("tree", F.col("place").alias("run"), F.col("path").alias("_above"), "subroot")
            inner = _siblings(level.where("n > 1")).join(runs, ["tree", "run"])
            inner = inner.withColumn("path", F.concat(F.array(F.struct("before", "after")), "_above"))
            found = inner.drop("run", "before", "after", "_above").unionByName(single)
        return found


def build(docs: DataFrame, keep: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``keep`` names further columns that each leaf carries."""
    columns = [F.col(name).cast(kind).alias(name) for name, kind in COLUMNS.items()]
    extra = {f"_kept_{name}": value for name, value in (keep or {}).items()}
    rows = docs.select(*columns, *[value.alias(name) for name, value in extra.items()])
    rows = rows.select("doc_id", "lang", leaf_of().alias("digest"), *extra, F.monotonically_increasing_id().alias("_tie"))
    order = [F.col(c).asc_nulls_first() for c in ("lang", "doc_id", "digest", "_tie")]
    # Written first: dealing by range reads its input twice, and texts are hashed once.
    ordered = ranked(written(rows, "merkle-rows"), order, "merkle-order")
    trees = ordered.groupBy("lang").agg(F.min("_rank").alias("tree"), F.count(F.lit(1)).alias("n"))
    trees = written(trees, "merkle-trees")
    mine = trees.withColumnRenamed("lang", "_lang")
    leaves = ordered.join(mine, ordered["lang"].eqNullSafe(mine["_lang"]))
    leaves = leaves.withColumn("place", F.col("_rank") - F.col("tree"))
    leaves = written(leaves.drop("lang", "_lang", "_rank", "_rows", "_tie"), "merkle-leaves")
    levels = _levels(leaves)

    # A tree's root is its node on the level where no other is left.
    alone = [level.where("n = 1").select("tree", "digest") for level in [leaves, *levels]]
    tops = ranked(written(reduce(DataFrame.union, alone), "merkle-roots"), [F.col("tree")], "merkle-root-order")
    tops = tops.select("tree", "digest", F.col("_rank").alias("place"), F.col("_rows").alias("n"))
    tops = written(tops, "merkle-tops")
    first = tops.select(F.lit(0).cast("bigint").alias("tree"), "place", "n", "digest")
    upper = _levels(first)
    top = (upper[-1] if upper else first).select("digest").first()
    named = {name: name.removeprefix("_kept_") for name in extra}
    return Manifest(leaves.withColumnsRenamed(named), levels, tops, [first, *upper], top["digest"] if top else None)


def differences(docs: DataFrame, manifest: Manifest) -> DataFrame:
    """Rows of ``docs`` that the manifest does not hold (change 1, 2, ... times more) and the reverse (-1, -2, ...).

    A changed row is there twice: its old leaf is missing and its new one is more. Equal rows are counted before
    they are shuffled.
    """
    now = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), leaf_of().alias("leaf"), F.lit(1).alias("change"))
    then = manifest.leaves.select("doc_id", F.col("digest").alias("leaf"), F.lit(-1).alias("change"))
    found = now.unionByName(then).groupBy("doc_id", "leaf").agg(F.sum("change").alias("change"))
    return found.where("change <> 0")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its path give."""
    return F.aggregate(path, leaf, lambda node, step: hash_of(step["before"], node, step["after"]))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def _siblings(level: DataFrame) -> DataFrame:
    """``level`` with run and the digests before and after each node in its run, joined."""
    slot = F.col("place") % FANOUT
    length = F.least(F.lit(FANOUT), F.col("n") - F.col("place") + slot)
    run = F.floor(F.col("place") / FANOUT).cast("bigint")
    along = Window.partitionBy("tree", "run").orderBy("place")

    def masked(there: Column, digest: Column) -> Column:
        return F.when(there, digest).otherwise("")

    before = [masked(slot >= k, F.lag("digest", k).over(along)) for k in range(FANOUT - 1, 0, -1)]
    after = [masked(slot + k < length, F.lead("digest", k).over(along)) for k in range(1, FANOUT)]
    return level.withColumn("run", run).withColumns({"before": F.concat(*before), "after": F.concat(*after)})


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels above ``nodes``, each written, up to the one where each tree has a single node."""
    most, out = nodes.agg(F.max("n")).first()[0] or 0, []
    while most > 1:
        first = _siblings(nodes.where("n > 1")).where(F.col("place") % FANOUT == 0)
        above = first.select(
            "tree",
            F.col("run").alias("place"),
            F.ceil(F.col("n") / FANOUT).cast("bigint").alias("n"),
            hash_of(F.col("digest"), F.col("after")).alias("digest"),
        )
        nodes = written(above, "merkle-level")
        out.append(nodes)
        most = -(-most // FANOUT)
    return out


def _upper_paths(level: DataFrame, above: DataFrame) -> DataFrame:
    """place and path of each node of the tree of trees, given those of the level above."""
    runs = above.select(F.col("place").alias("run"), F.col("path").alias("_above"))
    step = F.array(F.struct("before", "after"))
    return _siblings(level).join(runs, "run").select("place", F.concat(step, "_above").alias("path"))
