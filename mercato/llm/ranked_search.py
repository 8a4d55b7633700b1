"""Ranked lexical search: impact vectors in buckets by length, pruned by Cauchy-Schwarz and by coordinates.

A document is the vector of its terms' impacts, a query the vector of its terms' counts; a score is their product, in
integers throughout. Only coordinates that some query has are kept. Vectors are dealt into ranges of their Euclidean
length, the longest first, and each range is cut into buckets of ``BUCKET`` vectors. Against a bucket a query

1. is skipped if its length times the greatest length in the bucket, or the sum of its counts times the greatest
   impacts in the bucket, is below the score that it needs;
2. otherwise reads the postings of as few coordinates, the ones with the greatest bounds first, as leave the
   others unable to reach that score together, and keeps the vectors that their sum here, plus the lesser of both bounds
   on the other coordinates, lifts to it;
3. scores those again over all coordinates, exactly.

The score needed is that of the k-th best so far, at first from the longest range, which is searched on its own. A task
returns its k best of each query; the best of those are ranked. A bound never decides a tie: equality stays.

Queries are dealt into blocks of about ``BLOCK_BYTES`` of text; a block goes to all tasks, so what is broadcast has that
bound (and one query's text above it), and documents are read once for each block. Equal texts are one query.

Defined results: null and empty texts, and those without a term, find nothing and count for nothing. Benchmark rows
that agree in item_id and text are one item; an item_id with several texts has the results of each. Repeated documents
are ranked each. Equal scores go by doc_id, a null one last, then by the text's hash. Of very long texts all terms count.
An empty table on either side gives no rows. Only the id and the text of a table are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import fingerprint, need, partitions
from mercato.session import written

TOP = 20
#: Vectors compared at once, and the text that queries of one block have together.
BUCKET, BLOCK_BYTES = 4096, 1 << 22
# Bytes of a term stay, A-Z lowered; all others end it. A byte above 127 is part of a character above 127.
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TERMS = bytes(b if b in _KEEP else ord(" ") for b in bytes(range(256)).lower())
#: Bounds are doubles; scores beyond 2**53 would need more than this.
_SLACK = 1 + 1e-9

_POSTINGS = "doc_id bigint, none boolean, row bigint, n bigint, terms array<int>, counts array<int>"
_FOUND = "query int, score bigint, doc_id bigint, none boolean, row bigint"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


class Queries:
    """The queries of one block: term ids and counts of each, one after the other."""

    def __init__(self, texts: list[str]):
        self.vocabulary: dict[bytes, int] = {}
        ids, counts, ends = [], [], []
        for text in texts:
            for term, count in Counter(terms_of(text)).items():
                ids.append(self.vocabulary.setdefault(term, len(self.vocabulary)))
                counts.append(count)
            ends.append(len(ids))
        self.ids, self.counts = np.array(ids, np.int64), np.array(counts, np.int64)
        self.starts, self.ends = np.array([0, *ends[:-1]], np.int64), np.array(ends, np.int64)
        self.lengths = np.sqrt(np.add.reduceat(self.counts.astype(float) ** 2, self.starts)) if ids else np.zeros(0)

    def __len__(self) -> int:
        return len(self.ends)


class Weights:
    """What turns the counts of a document into impacts: a weight for each term id, documents and terms in all."""

    def __init__(self, frequency: np.ndarray, documents: int, terms: int):
        self.of_term = np.floor(1000 * np.log((2 * documents + 2) / (2 * frequency + 1))).astype(np.int64)
        self.documents, self.terms = documents, terms

    def impacts(self, ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``lengths``: for each count, the number of terms of its document."""
        m = 75 + 25 * lengths * self.documents // self.terms
        return self.of_term[ids] * (1_000_000_000 * counts // (1000 * counts + 12 * m))


class Bucket:
    """Some vectors by row and by coordinate."""

    def __init__(self, rows: pd.DataFrame, weights: Weights):
        sizes = rows["terms"].map(len).to_numpy()
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.doc_id, self.none = rows["doc_id"].to_numpy(), rows["none"].to_numpy()
        self.row, self.length = rows["row"].to_numpy(), rows["length"].to_numpy()
        self.ids = np.concatenate(rows["terms"].to_list()).astype(np.int64)
        counts = np.concatenate(rows["counts"].to_list()).astype(np.int64)
        self.impacts = weights.impacts(self.ids, counts, np.repeat(rows["n"].to_numpy(), sizes))
        order = np.argsort(self.ids, kind="stable")
        self.members = np.repeat(np.arange(len(rows)), sizes)[order]
        self.member_impacts = self.impacts[order]
        self.present, self.from_ = np.unique(self.ids[order], return_index=True)
        self.to = np.append(self.from_[1:], len(order))
        self.greatest = np.maximum.reduceat(self.member_impacts, self.from_)
        self.coordinate = np.searchsorted(self.present, self.ids)

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Where coordinates are among those present; -1 for absent ones."""
        at = np.minimum(np.searchsorted(self.present, ids), len(self.present) - 1)
        return np.where(self.present[at] == ids, at, -1)


class Best:
    """The k best of each query so far, and the score that is needed to join them."""

    def __init__(self, queries: int, k: int, needed: np.ndarray):
        self.k, self.needed = k, needed.copy()
        self.found: list[tuple[np.ndarray, ...] | None] = [None] * queries

    def add(self, query: int, *new: np.ndarray) -> None:
        old = self.found[query]
        both = new if old is None else tuple(np.concatenate(pair) for pair in zip(old, new))
        score, doc_id, none, row = both
        order = np.lexsort((row, doc_id, none, -score))[: self.k]
        self.found[query] = tuple(column[order] for column in both)
        if len(order) == self.k:
            self.needed[query] = max(self.needed[query], score[order[-1]])

    def frame(self) -> pd.DataFrame:
        kept = [(n, found) for n, found in enumerate(self.found) if found is not None]
        columns = [np.concatenate([found[c] for _, found in kept]) if kept else [] for c in range(4)]
        query = np.concatenate([np.full(len(found[0]), n) for n, found in kept]) if kept else []
        return pd.DataFrame(dict(zip(("query", "score", "doc_id", "none", "row"), (query, *columns))))


def search_bucket(queries: Queries, bucket: Bucket, best: Best) -> int:
    """Take the bucket's vectors into ``best``; the number of vectors that were scored exactly."""
    place, scored = bucket.place(queries.ids), 0
    bounds = np.where(place >= 0, bucket.greatest[place], 0) * queries.counts
    by_coordinate = np.add.reduceat(bounds, queries.starts)
    by_coordinate[queries.starts == queries.ends] = 0
    by_length = queries.lengths * bucket.length.max()
    possible = np.minimum(by_coordinate, by_length) * _SLACK >= best.needed
    whole = np.zeros(len(bucket.present), np.int64)
    for query in np.flatnonzero(possible & (by_coordinate > 0)):
        here = slice(queries.starts[query], queries.ends[query])
        at, counts, bound = place[here], queries.counts[here], bounds[here]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        at, counts, bound = at[order], counts[order], bound[order]
        # What the coordinates from each one on can add, by coordinate.
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)
        needed = best.needed[query]
        read = max(int(np.searchsorted(-rest, -needed, "right")), 1) if needed > 0 else len(at)
        read = min(read, len(at))
        sums = np.zeros(len(bucket.ends), np.int64)
        for k in range(read):
            part = slice(bucket.from_[at[k]], bucket.to[at[k]])
            sums[bucket.members[part]] += counts[k] * bucket.member_impacts[part]
        others = np.minimum(rest[read], np.sqrt(float((counts[read:] ** 2).sum())) * bucket.length)
        near = np.flatnonzero((sums > 0) & ((sums + others) * _SLACK >= needed))
        if not len(near):
            continue
        scored += len(near)
        if read < len(at):
            whole[at] = counts
            sizes = bucket.ends[near] - bucket.starts[near]
            firsts = np.cumsum(sizes) - sizes
            cells = np.arange(sizes.sum()) + np.repeat(bucket.starts[near] - firsts, sizes)
            exact = np.add.reduceat(bucket.impacts[cells] * whole[bucket.coordinate[cells]], firsts)
            whole[at] = 0
        else:
            exact = sums[near]
        good = (exact > 0) & (exact >= needed)
        near = near[good]
        if len(near):
            best.add(query, exact[good], bucket.doc_id[near], bucket.none[near], bucket.row[near])
    return scored


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    texts = items.where("text is not null").select("text", F.xxhash64("text").alias("hash")).distinct()
    texts = written(texts, "search-queries")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    answers = []
    for block in range(blocks):
        mine = texts.where(F.pmod(F.col("hash"), F.lit(blocks)) == block)
        # About block_bytes of text, however many queries there are.
        asked = sorted(r["text"] for r in mine.select("text").collect())
        asked = [text for text in asked if terms_of(text)]
        if asked:
            answers.append(_search_block(docs, asked, k))
    if not answers:
        schema = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id bigint, score bigint"
        return spark.createDataFrame([], schema)
    found = reduce(DataFrame.unionByName, answers)
    return items.join(found, "text").select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, asked: list[str], k: int) -> DataFrame:
    """text, rank, doc_id and score of the k best documents of each text."""
    spark, queries = docs.sparkSession, Queries(asked)
    postings = written(_postings(docs, queries), "search-postings")
    totals = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    frequency = np.zeros(len(queries.vocabulary), np.int64)
    holding = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    for term, n in holding.collect():  # one row for each term of the block
        frequency[term] = n
    weights = Weights(frequency, totals["documents"] or 0, totals["terms"] or 0)
    ranges = written(_by_length(postings, weights), "search-ranges")

    first = written(_best(ranges.where("part = 0"), queries, weights, k, np.zeros(len(queries), np.int64)), "search-first")
    kth = Window.partitionBy("query").orderBy(F.desc("score"))
    needed = np.zeros(len(queries), np.int64)
    for query, score in first.withColumn("_n", F.row_number().over(kth)).where(F.col("_n") == k).select(
        "query", "score"
    ).collect():  # one row for each query of the block
        needed[query] = score
    others = _best(ranges.where("part > 0"), queries, weights, k, needed)
    order = [F.desc("score"), F.col("none"), F.col("doc_id"), F.col("row")]
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    found = first.unionByName(others).withColumn("rank", place).where(F.col("rank") <= k)
    texts = spark.createDataFrame(list(enumerate(asked)), "query int, text string")
    doc_id = F.when(~F.col("none"), F.col("doc_id")).alias("doc_id")
    return found.join(texts, "query").select("text", "rank", doc_id, "score")


def _postings(docs: DataFrame, queries: Queries) -> DataFrame:
    """For each document its number of terms, and the queries' terms in it with their counts."""
    known, doc_id = queries.vocabulary, F.col("doc_id")
    rows = need(docs, doc_id="bigint", text="string").select(
        F.coalesce(doc_id, F.lit(0)).alias("doc_id"),
        doc_id.isNull().alias("none"),
        fingerprint(F.col("text")).alias("row"),
        "text",
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch["text"]:
                words = terms_of(text)
                both = sorted((known[t], c) for t, c in Counter(words).items() if t in known)
                n.append(len(words))
                terms.append([t for t, _ in both])
                counts.append([c for _, c in both])
            yield batch[["doc_id", "none", "row"]].assign(n=n, terms=terms, counts=counts)

    return rows.mapInPandas(count, _POSTINGS)


def _by_length(postings: DataFrame, weights: Weights) -> DataFrame:
    """Vectors with a coordinate, with their Euclidean length, in ranges (``part``) and order of it, the longest first."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sizes = rows["terms"].map(len).to_numpy()
            ids = np.concatenate(rows["terms"].to_list()).astype(np.int64)
            counts = np.concatenate(rows["counts"].to_list()).astype(np.int64)
            impacts = weights.impacts(ids, counts, np.repeat(rows["n"].to_numpy(), sizes)).astype(float)
            squares = np.add.reduceat(impacts**2, np.cumsum(sizes) - sizes)
            yield rows.assign(length=np.sqrt(squares))

    schema = _POSTINGS + ", length double"
    vectors = postings.where(F.size("terms") > 0).mapInPandas(measure, schema)
    vectors = written(vectors, "search-vectors")
    order = [F.desc("length"), F.col("doc_id"), F.col("row")]
    ranges = vectors.repartitionByRange(partitions(postings.sparkSession), *order).sortWithinPartitions(*order)
    return ranges.withColumn("part", F.spark_partition_id())


def _best(vectors: DataFrame, queries: Queries, weights: Weights, k: int, needed: np.ndarray) -> DataFrame:
    """The k best of each query in each task, among those that reach the score needed."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(len(queries), k, needed)
        for batch in batches:
            for start in range(0, len(batch), BUCKET):
                search_bucket(queries, Bucket(batch.iloc[start : start + BUCKET], weights), best)
        yield best.frame()

    return vectors.mapInPandas(look, _FOUND)
