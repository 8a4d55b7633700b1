"""Benchmark decontamination by winnowing.

Of every six neighbouring five-word hashes the least is kept as a fingerprint, in documents and benchmark alike. Any
shared span of ten words holds six five-word windows, so both sides keep the same least one of them: no span of ten
words is missed. A fingerprint carries the five words on either side of it, so a joined pair is extended to its exact
span without going back to the texts, and spans of ten words or more count. Equal hashes alone never count: the words
are compared, as 64-bit hashes of single words.

Items of fewer than ten words are windows of their own length and are looked up by the hash of all their words.

Document fingerprints first pass a bitmap of the benchmark's, of a fixed 1 MB, so only those that can join are
shuffled. A larger benchmark sets more bits and sends more rows; the result is the same. A passage that very many
documents share is a skewed key of the join with the documents on its left, which Spark splits.

Defined results: null text has no words; an item without words has no window; a null item_id marks words as hit but
is not listed. Rows that share a doc_id are judged each by its own text. Repeated items are listed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from mercato.llm.common import fingerprint, need, small_batches
from mercato.session import written

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
SIDE = SPAN - GRAM
#: Bits of the bitmap; 2 ** 23 bits are 1 MB.
SLOTS = 1 << 23
#: Words remembered by a worker.
REMEMBERED = 1 << 20

_WORD = bytes(
    c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


def word_hashes(text: str | None, known: _Hashes) -> np.ndarray:
    split = (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()
    return np.fromiter(map(known.__getitem__, split), np.uint64, len(split))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` neighbouring words; different lengths give different hashes."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out + words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that are least in some window of neighbours; all of several equal ones."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.empty(0, np.int64)
    least = hashes[:n].copy()
    for i in range(1, window):
        np.minimum(least, hashes[i : i + n], out=least)
    chosen = np.zeros(len(hashes), bool)
    for i in range(window):
        chosen[i : i + n] |= hashes[i : i + n] == least
    return np.flatnonzero(chosen)


def contexts(words: np.ndarray, at: np.ndarray, before: int, length: int, pad: int) -> np.ndarray:
    """The words from ``before`` ahead of each place on; ``pad`` stands outside the text."""
    room = np.full(before + length, pad, np.uint64)
    padded = np.concatenate([room, words, room])
    return padded[(at + len(room) - before)[:, None] + np.arange(length)]


#: kind 0: a fingerprint; 1 to 9: all words of an item of that length.
FOUND = "hash bigint, pos int, kind int, context binary"


def _found(words: np.ndarray, lengths: tuple[int, ...], slots: np.ndarray | None, pad: int):
    """hash, pos, kind and context of a text's fingerprints and of its windows of the given short lengths."""
    parts = []
    for kind in (0, *lengths):
        hashes = gram_hashes(words, kind or GRAM)
        at = np.arange(len(hashes)) if kind else winnow(hashes, WINDOW)
        if slots is not None and len(at):
            slot = hashes[at] & np.uint64(SLOTS - 1)
            at = at[slots[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0]
        if len(at):
            around = contexts(words, at, 0 if kind else SIDE, GRAM + 2 * SIDE, pad)
            parts.append((hashes[at].view(np.int64), at, kind, around))
    return parts


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, hash, kind and context of every fingerprint or short item, written once."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            out = []
            for item, text in zip(batch["item_id"], batch["text"]):
                words = word_hashes(text, known)
                short = 0 < len(words) < SPAN
                for hashes, _, kind, around in _found(words, (len(words),) if short else (), None, 1):
                    if bool(kind) == short:
                        out += [(item, h, kind, c.tobytes()) for h, c in zip(hashes, around)]
            yield pd.DataFrame(out, columns=["item_id", "hash", "kind", "context"])

    items = need(small_batches(benchmark), item_id="string", text="string")
    schema = "item_id string, hash bigint, kind int, context binary"
    return written(items.mapInPandas(rows, schema).distinct(), "benchmark-windows")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The slots that the benchmark's hashes take. What comes to the driver is at most the bitmap itself."""
    slot = F.col("hash").bitwiseAND(F.lit(SLOTS - 1))
    bit = F.expr(f"shiftleft(1L, cast(hash & {SLOTS - 1} as int) & 63)")
    taken = windows.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(SLOTS // 64, np.int64)
    for row in taken:
        out[row["word"]] = row["bits"]
    return out.astype("<i8").view(np.uint8)


def fingerprints(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """row, doc_id, print, n_words and the list of what can join, one row for each document, written once."""
    lengths = tuple(sorted(r["kind"] for r in windows.where("kind > 0").select("kind").distinct().collect()))
    slots = docs.sparkSession.sparkContext.broadcast(_bitmap(windows))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            counts, found = [], []
            for text in batch["text"]:
                words = word_hashes(text, known)
                counts.append(len(words))
                parts = _found(words, lengths, slots.value, 0)
                found.append(
                    [
                        {"hash": int(h), "pos": int(p), "kind": kind, "context": c.tobytes()}
                        for hashes, at, kind, around in parts
                        for h, p, c in zip(hashes, at, around)
                    ]
                )
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "print": batch["print"], "n_words": counts, "found": found}
            ).astype({"doc_id": "Int64"})

    texts = need(small_batches(docs), doc_id="bigint", text="string").withColumn("print", fingerprint(F.col("text")))
    schema = f"doc_id bigint, print bigint, n_words bigint, found array<struct<{FOUND.replace(' ', ':')}>>"
    schema = schema.replace(",:", ", ")
    out = texts.mapInPandas(rows, schema)
    return written(out.withColumn("row", F.monotonically_increasing_id()), "document-windows")


def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The span from start up to end that a pair of equal hashes shares, where it is long enough."""
    width = GRAM + 2 * SIDE
    for batch in batches:
        if not len(batch):
            continue
        ours, theirs = (
            np.frombuffer(b"".join(batch[c]), np.uint64).reshape(-1, width) for c in ("context", "their_context")
        )
        same, pos, kind = ours == theirs, batch["pos"].to_numpy(), batch["kind"].to_numpy()
        left = np.logical_and.accumulate(same[:, SIDE - 1 :: -1], axis=1).sum(axis=1)
        right = np.logical_and.accumulate(same[:, SIDE + GRAM :], axis=1).sum(axis=1)
        whole = np.logical_and.accumulate(same, axis=1).sum(axis=1)
        long = (kind == 0) & same[:, SIDE : SIDE + GRAM].all(axis=1) & (left + GRAM + right >= SPAN)
        short = (kind > 0) & (whole >= kind)
        start = np.where(kind == 0, pos - left, pos)
        end = np.where(kind == 0, pos + GRAM + right, pos + kind)
        hit = long | short
        yield pd.DataFrame({"row": batch["row"], "item_id": batch["item_id"], "start": start, "end": end})[hit]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, print, n_words, n_hit and the ids of the items found, for every document."""
    windows = benchmark_windows(benchmark)
    known = fingerprints(docs, windows)
    ours = known.select("row", F.explode("found").alias("f")).select("row", "f.*")
    theirs = windows.select("item_id", "hash", "kind", F.col("context").alias("their_context"))
    pairs = ours.join(theirs, ["hash", "kind"]).select("row", "pos", "kind", "context", "their_context", "item_id")
    spans = pairs.mapInPandas(extend, "row bigint, item_id string, start int, end int").distinct()
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    hits = (
        spans.groupBy("row")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.collect_set("item_id").alias("items"))
        .select("row", F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"), F.sort_array("items").alias("items"))
    )
    return known.select("row", "doc_id", "print", "n_words").join(hits, "row", "left").select(
        "doc_id",
        "print",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark."""
    marked = contamination(docs, benchmark).where("n_hit > 0").select("doc_id", "print").distinct()
    # Written, so that Spark knows its size and broadcasts it only if it is small.
    marked = written(marked, "contaminated")
    rows = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.col("doc_id").cast("bigint").alias("_id"),
        fingerprint(F.col("text").cast("string")).alias("_print"),
    )
    same = rows["_id"].eqNullSafe(marked["doc_id"]) & (rows["_print"] == marked["print"])
    return rows.join(marked, same, "left_anti").select("_doc.*")
