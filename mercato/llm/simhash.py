"""SimHash near-dedup: tiles of fingerprints compared exactly with exclusive-or and bit counts.

A fingerprint has 64 bits. Its tile is the list of the bit counts of its pieces (4, 8 or 16 pieces of equal width).
The bit counts of two fingerprints within the radius differ by no more than the radius in sum, so each tile is
compared with itself and with the tiles that close; all other pairs of tiles are skipped. No link is lost. More
fingerprints get more pieces, hence smaller tiles. A tile with more than ``CHUNK`` members is cut into chunks that
are compared two by two in tasks of their own, so no task holds more than two chunks.

Equal fingerprints are one member, however many documents have it. A task returns a star for each component that it
finds, not its pairs, so a group of near copies returns one link for each member.

Defined results: null and empty texts have no words and fingerprint zero, which links like any other. A null doc_id
is never a component's id unless no member has one. Repeated rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from mercato.llm.common import fingerprint, need, partitions, small_batches
from mercato.llm.components import components
from mercato.session import written

SEED = 42
RADIUS = 2
#: Members of a tile that one task takes at most, and the side of a block that is compared at once.
CHUNK, BLOCK = 16384, 1024
#: Shingles of a long text that are hashed at once.
STRETCH = 1 << 16


def simhash(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = max(len(words) - 2, min(len(words), 1))
    counts = np.zeros(64, np.int64)
    for start in range(0, shingles, STRETCH):
        part = words[start : start + STRETCH + 2]
        joined = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) > 2 else [b" ".join(words)]
        hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > shingles, bitorder="little")
    return int(packed.view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash_of(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def pieces_for(n: int) -> int:
    """Pieces that a tile's key counts: few fingerprints are sent to few neighbours, many meet in small tiles."""
    return 4 if n < 1_000_000 else 8 if n < 100_000_000 else 16


@cache
def _steps(pieces: int, radius: int) -> np.ndarray:
    """Half of the ways in which the bit counts of pieces can differ by ``radius`` in sum, the first one up."""
    found = {tuple([0] * pieces)}
    for size in range(1, radius + 1):
        for places in combinations([p for p in range(pieces) for _ in range(size)], size):
            for signs in range(1 << size):
                step = np.zeros(pieces, np.int64)
                for k, p in enumerate(places):
                    step[p] += 1 if signs >> k & 1 else -1
                found.add(tuple(step))
    return np.array(sorted(s for s in found if s >= tuple([0] * pieces)))


def tiles(prints: np.ndarray, pieces: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in ``prints``, tile key and whether it is the tile of the fingerprint itself, for all tiles to visit."""
    width = 64 // pieces
    shifts = np.arange(pieces, dtype=np.uint64) * np.uint64(width)
    mask = np.uint64((1 << width) - 1)
    counts = np.bitwise_count((prints.view(np.uint64)[:, None] >> shifts) & mask).astype(np.int64)
    steps = _steps(pieces, radius)
    base = (width + 1) ** np.arange(pieces, dtype=object)
    base = np.array([int(b) for b in base], dtype=np.int64)
    places, keys, home = [], [], []
    for step in steps:
        to = counts + step
        valid = np.flatnonzero(((to >= 0) & (to <= width)).all(axis=1))
        places.append(valid)
        keys.append(to[valid] @ base)
        home.append(np.full(len(valid), not step.any()))
    return np.concatenate(places), np.concatenate(keys), np.concatenate(home)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of ``n`` members."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def stars(prints: np.ndarray, home: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Links (n, 2) that join what the compared pairs join; ``left`` and ``right`` are places to compare."""
    seen = np.empty((0, 2), np.int64)
    for i in range(0, len(left), BLOCK):
        for j in range(i if left is right else 0, len(right), BLOCK):
            p, q = left[i : i + BLOCK], right[j : j + BLOCK]
            near = np.bitwise_count(prints[p][:, None] ^ prints[q][None, :]) <= radius
            near &= home[p][:, None] | home[q][None, :]
            x, y = np.nonzero(near)
            pairs = np.stack([p[x], q[y]], axis=1)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            if len(pairs):
                seen = np.concatenate([seen, pairs])
            if len(seen) > 1 << 20:
                seen = _star(len(prints), seen)
    return _star(len(prints), seen)


def _star(n: int, pairs: np.ndarray) -> np.ndarray:
    root = _roots(n, pairs[:, 0], pairs[:, 1])
    tied = np.flatnonzero(root != np.arange(n))
    return np.stack([tied, root[tied]], axis=1)


def _compare(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links between the members of the units (tile, low, high) of one group of rows."""
    rows = rows.sort_values(["tile", "low", "high"], kind="stable")
    prints, home = rows["print"].to_numpy().view(np.uint64), rows["home"].to_numpy()
    chunk, low, high = (rows[c].to_numpy() for c in ("chunk", "low", "high"))
    unit = np.stack([rows["tile"].to_numpy(), low, high])
    edges = np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1
    out = []
    for start, end in zip([0, *edges], [*edges, len(rows)]):
        if end - start < 2 or not home[start:end].any():
            continue
        here = slice(start, end)
        all_here = np.arange(end - start)
        if low[start] == high[start]:
            left = right = all_here
        else:
            left, right = (all_here[chunk[here] == c[start]] for c in (low, high))
        found = stars(prints[here], home[here], left, right, radius)
        out.append(prints[here].view(np.int64)[found])
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links a, b that join all fingerprints within the radius. ``prints`` holds each fingerprint once, in ``print``."""
    spark = prints.sparkSession
    n = prints.count()
    pieces = pieces_for(n)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["print"].to_numpy()
            place, key, home = tiles(values, pieces, radius)
            yield pd.DataFrame({"print": values[place], "tile": key, "home": home})

    members = prints.select("print").mapInPandas(visits, "print bigint, tile bigint, home boolean")
    large = members.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    large = written(large.select("tile", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "large-tiles")
    cut = members.join(large, "tile", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"))
    units = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "print",
        "tile",
        "home",
        "chunk",
        F.least("chunk", "other").alias("low"),
        F.greatest("chunk", "other").alias("high"),
    )
    # Several units share a group, so that a group is worth a call; its rows stay near a chunk's or two.
    groups = max(partitions(spark), n * len(_steps(pieces, radius)) // (2 * chunk))
    group = F.pmod(F.xxhash64("tile", "low", "high"), F.lit(groups))
    return units.groupBy(group.alias("group")).applyInPandas(
        lambda rows: _compare(rows, radius), "a bigint, b bigint"
    )


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, row (tells rows apart) and print, one row for each document, written once."""
    docs = need(small_batches(docs), doc_id="bigint", text="string")
    prints = docs.select(
        "doc_id", fingerprint(F.col("text")).alias("row"), simhash_of("text").alias("print")
    )
    return written(prints, "simhash")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (as from ``hashed``) with component_id."""
    members = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-members")
    tied = components(links(members, radius))
    rooted = members.join(tied, members["print"] == tied["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = rooted.join(ids, "root").select("print", "component_id", "root")
    return prints.join(classed, "print")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each document."""
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return classes(hashed(docs), radius).select("doc_id", digits.alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, then the smallest row hash."""
    return first_of_each(docs, classes(hashed(docs), radius))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the first row of each component. ``found`` holds doc_id, row and root of all rows."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    keep = found.groupBy("root").agg(F.min(first).alias("k")).select("k.none", "k.doc_id", "k.row")
    rows = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.col("doc_id").cast("bigint").alias("_id"),
        fingerprint(F.col("text").cast("string")).alias("_print"),
    )
    # Rows that agree in doc_id and text are one before anything is shuffled for the join.
    single = rows.groupBy("_id", "_print").agg(F.first("_doc").alias("_doc"))
    same = single["_id"].eqNullSafe(keep["doc_id"]) & (single["_print"] == keep["row"])
    return single.join(keep, same, "left_semi").select("_doc.*")
