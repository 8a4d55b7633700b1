"""Mixing sources to target weights by systematic sampling.

Within each source the documents stand in one order, largest first; the expected copies of the documents are
summed along it, one offset is added, and a document is emitted once for each whole number that its stretch of the
sum crosses. Order and offset depend on the rows only, so a rerun takes the same documents. Since sizes fall along
the order, the words taken are within one document of the target.

Ranks come from ranges of (source, size, doc_id), so a source with a third of all rows is spread over many tasks.

Defined results: null text has size 0; the null source is a source of its own and comes last. Rows that agree in
source, size, doc_id and text are interchangeable. A table without words has targets of 0 and takes nothing.
Clashing columns: the added ones replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import fingerprint, keyed, ranked, whole_rows, words
from mercato.session import written

WEIGHTS = (1.0, 2.0, 3.0)
#: No source is taken more than so many times.
MOST_COPIES = 3.0


def offset(source: Column) -> Column:
    """The source's random offset from 0 up to 1."""
    digest = F.md5(F.encode(F.concat(F.lit("mix:"), F.coalesce(source, F.lit("\x00"))), "UTF-8"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size, source_rows) with the target of each source and the rows of earlier sources.

    A source gets its weight's share of all sizes but never over ``most`` times its own; what is over goes to the
    others by weight, again and again. The fixed point is min(cap, level * weight), so sources are taken by cap
    over weight and the level is that of the first one under its cap, the highest of those. Windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.select(
        "*",
        F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1).alias("weight"),
        (F.sum("source_rows").over(by_name) - F.col("source_rows")).alias("first_row"),
        F.sum("source_size").over(every).cast("double").alias("total"),
        (F.col("source_size") * most).alias("cap"),
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.select("*", (left / F.sum("weight").over(onward)).alias("level"))
    # Up to the first source whose cap is above the level, sources are full; that level holds for all others.
    full = F.col("cap") <= F.col("level") * F.col("weight")
    rows = rows.select("*", F.max(F.when(~full, F.col("level"))).over(every).alias("final"))
    target = F.when(full | F.col("final").isNull(), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return rows.select("source", "source_size", "first_row", target.alias("target"))


def copies(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST_COPIES,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs``, or the columns of it in ``keep``, with size, source_size, target and copies."""
    size = F.size(words(F.col("text").cast("string"))).cast("bigint")
    added = ("size", "source_size", "target", "copies")
    row = [F.col(c) for c in keep or docs.columns if c.lower() not in added]
    sized = docs.select(
        F.struct(*row).alias("row"),
        F.col("source").cast("string").alias("source"),
        size.alias("size"),
        F.col("doc_id").cast("bigint").alias("id"),
        fingerprint(F.col("text").cast("string")).alias("print"),
    )
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("id").asc_nulls_first(), F.col("print")]
    rows = ranked(sized, order, "mix")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    # Written, so that Spark knows its size and broadcasts it only if it is small.
    plan = written(targets(sources, weights, most).withColumnRenamed("source", "of"), "mix-targets")
    both = rows.join(plan, rows["source"].eqNullSafe(plan["of"]), "left")
    each = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    nth = F.col("_rank") - F.col("first_row")
    crossed = F.floor((nth + 1) * each + offset(F.col("source"))) - F.floor(nth * each + offset(F.col("source")))
    return both.select("row.*", "size", "source_size", "target", crossed.cast("bigint").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it; the columns stay."""
    light = keyed(docs).select("doc_id", "text", "source", "_k1", "_k2")
    rows = copies(light, weights, most, keep=("_k1", "_k2")).where("copies > 0")
    taken = whole_rows(docs, rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))))
    return taken.select("_doc.*")
