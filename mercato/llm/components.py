"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.session import written


def _large(links: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest of its neighbours and itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the smallest of them. Links point from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root, its smallest reachable node, for every node of ``links`` (a, b) that is not a root itself.

    Minima are taken by partial aggregation and joined back with the links on the left, so a node with very many
    links is split like any other skewed key. Each round is written to the shared folder; the number of rounds
    grows with the logarithm of the longest chain.
    """
    oriented = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())

    state = written(oriented, "links")
    before = mark(state)
    while before[0]:
        state = written(_small(_large(state)), "links")
        after = mark(state)
        if after == before:
            break
        before = after
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
