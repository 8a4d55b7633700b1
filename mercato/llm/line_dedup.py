"""Line dedup: a line that many documents share stays in one of them only.

Lines are hashed to 128 bits. In a pass over the hashes, sorted by document and position, the first occurrences
are streamed: each task keeps three documents of a hash before anything is shuffled, so a line that a third of
all documents hold costs each task three rows. Lines of the repeated hashes become one bitmap for each document,
in which a bit is set for each dropped line; documents without a bitmap keep all lines. No text is shuffled
until the bitmaps are applied.

Hashes are dealt by hash and not by ranges of themselves: a range would bring all rows of a very common line to
one task, and a hash is as even as any range of it. The join that follows splits such a line by the size of its
partition, since the lines are on its left.

Defined results: null or empty text is one empty line. A document is a doc_id; rows that share one count as one
document when a line is counted, and keep or drop their lines alike. A null doc_id is lower than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import SPACES, ascii_lower, fingerprint, need
from mercato.session import written

#: Bits of one bitmap; a document with more lines has several.
BITS = 32768


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, fingerprint and position of every line that must go."""
    docs = need(docs, doc_id="bigint", text="string")
    lines = docs.select("doc_id", fingerprint(F.col("text")).alias("print"), F.posexplode(_lines(F.col("text"))))
    key = ascii_lower(F.btrim("col", F.lit(SPACES)))
    lines = lines.select("doc_id", "print", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    lines = lines.select(
        "doc_id", "print", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )
    latest = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc_nulls_last())
    first = lines.select("h1", "h2", "doc_id", F.dense_rank().over(latest).alias("nth")).where(
        F.col("nth") <= min_docs
    )
    repeated = (
        first.groupBy("h1", "h2")
        .agg(F.max("doc_id").alias("last_doc"), F.max("nth").alias("docs"))
        .where(F.col("docs") == min_docs)
    )
    # Written, so that the join below stands alone: Spark broadcasts it if it is small and else splits skewed lines.
    repeated = written(repeated.select("h1", "h2", "last_doc"), "repeated-lines")
    found = lines.join(repeated, ["h1", "h2"])
    return found.where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).select("doc_id", "print", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """For each document that loses lines: doc_id, fingerprint, n_dropped and the bitmaps by block of lines.

    A bitmap ends with its last byte that has a bit set.
    """
    drops = dropped_lines(docs, min_chars, min_docs)
    key = ["doc_id", "print"]
    blocks = (
        drops.repartition(*key)
        .groupBy(*key, F.expr(f"pos div {BITS}").cast("int").alias("block"))
        .agg(
            F.bitmap_construct_agg(F.expr(f"cast(pos % {BITS} as bigint)")).alias("bitmap"),
            F.max(F.expr(f"pos % {BITS}")).alias("last"),
            F.count_distinct("pos").alias("n"),
        )
    )
    cut = F.expr("substring(bitmap, 1, cast(last div 8 as int) + 1)")
    return blocks.groupBy(*key).agg(
        F.sum("n").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("block", cut.alias("bitmap")))).alias("bitmaps"),
    )


def _dropped(bitmaps: Column, at: Column) -> Column:
    """Whether the bit of line ``at`` is set."""
    bit = at % BITS
    byte = F.substring(bitmaps[(at / BITS).cast("int")], (bit / 8).cast("int") + 1, F.lit(1))
    value = F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int"), F.lit(0))
    return (value / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left."""
    bitmaps = drop_bitmaps(docs, min_chars, min_docs)
    docs = need(docs, doc_id="bigint", text="string").withColumn("print", fingerprint(F.col("text")))
    same = docs["doc_id"].eqNullSafe(bitmaps["doc_id"]) & (docs["print"] == bitmaps["print"])
    both = docs.join(bitmaps, same, "left").select(docs["doc_id"], "text", "n_dropped", "bitmaps")
    kept = F.filter(_lines(F.col("text")), lambda line, at: ~_dropped(F.col("bitmaps"), at))
    return both.select(
        "doc_id",
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("breaks"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("bitmaps").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(kept, "\n"))
        .alias("text"),
    ).select("doc_id", (F.coalesce("breaks", F.lit(0)) + 1).cast("bigint").alias("n_lines"), "n_dropped", "text")
