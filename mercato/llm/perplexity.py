"""LM scoring with a hierarchical Pitman-Yor model.

A token is drawn in the restaurant of the token before it. Every token that the corpus brings has one. Those of the
``CONTEXTS`` most frequent tokens and of the start of a text are children of the root; those of all others are children of
the restaurant of their class (told by a word's last bytes), which is a child of the root. Their dishes are the
``DISHES`` most frequent tokens, the end, and the classes of rare words. A rare word is then drawn in the restaurant of its
class and of the upper restaurant that the token before belongs to; its parent is the restaurant of the class alone, whose
base puts half on an unknown word and half on the known ones. So the upper restaurants have a fixed size and
can be broadcast. Those of the single words ("steps" from a word to a dish) and the rare words, as many as the corpus
brings, stay dealt out by their hash. Which tokens are frequent decides only where they are modelled.

Seating is sampled by Gibbs sweeps: the customers of a dish leave and sit down again one by one, at a new table with
probability proportional to the restaurant's new-table mass times the parent's probability of the dish. Every new
table sends a customer to the parent. Within a sweep the restaurants use the table totals and the parent of the sweep
before, so they are independent and run in parallel. To the restaurant of its class a word's restaurant sends one customer
for each dish, as if it had one table for it; its own sweeps then have the class's averaged probabilities as their base,
and a discount that the counts of its bucket of words suggest. Customers beyond the first 16 of a dish sit down in growing groups
that share one probability. Predictive probabilities are averaged over the kept sweeps.

Work is dealt out by text once for each of three readings (frequent tokens, counts, scores) and by word hash for the
rare words and for the steps. A task packs the rare words of a few million tokens, and the steps, with the documents that
hold them into one row for each bucket of hashes, so a word or step is shuffled once for each such stretch, however often it
occurs there; the frequent words and what follows the most frequent, which any skew would come from, are not shuffled at
all. Counts cover all training documents. Steps tell words apart by 42 bits of hash and the class.

Defined results: a null text is empty and has the end as its only token. A null doc_id is not held out. Rows that share
doc_id and text get the same score and each of them trains. Without training documents all known counts are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from mercato.llm.common import fingerprint, held_out, need, partitions, small_batches
from mercato.session import shuffles_removed, written, written_meanwhile

CONTEXTS, DISHES, CLASSES = 127, 16384, 64
#: Distinct tokens that a task counts before it passes their counts on.
HELD = 1 << 19
#: Sweeps that are thrown away and that are kept.
BURN, KEEP = 2, 3
STRENGTH = 1.0
#: Tokens and documents of a stretch, and words remembered by a worker.
STRETCH, STRETCH_DOCS, REMEMBERED = 1 << 22, 1 << 16, 1 << 19
#: The base measure's share of the unknown word of a class.
UNKNOWN = 0.5
BUCKETS = 64

_RARE = np.uint64(1 << 63)
_CLASS = np.uint64(CLASSES - 1)
_END = CONTEXTS + CLASSES
#: The low bits of a step's code: the dish, and above it the class of the word before.
_DISH_BITS = 15
_DISH, _LOW = np.uint64((1 << _DISH_BITS) - 1), np.uint64((1 << _DISH_BITS) * CLASSES - 1)
ROWS = "kind string, key bigint, chunk bigint, a binary, b binary, c binary, d binary, e binary"


def code_of(word: bytes) -> int:
    """57 bits of hash above the 6 bits of the class."""
    tail = (word[-1] * 31 + (word[-2] if len(word) > 1 else 0)) % CLASSES
    return xxh64_intdigest(word) >> 7 << 6 | tail


def _stepped(contexts: np.ndarray) -> np.ndarray:
    return (contexts >= CONTEXTS) & (contexts < _END)


class _Values(dict):
    """A frequent word's number, else its code with the top bit set."""

    def __init__(self, frequent: dict[int, int]):
        super().__init__()
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = code_of(word)
        self[word] = value = self.frequent.get(code, code | 1 << 63)
        return value


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass(frozen=True)
class Vocabulary:
    """The frequent tokens: number by code, and the context that each one is."""

    numbers: dict[int, int]
    contexts: np.ndarray

    @property
    def end(self) -> int:
        return len(self.numbers)

    @property
    def dishes(self) -> int:
        return len(self.numbers) + 1 + CLASSES

    @cached_property
    def codes(self) -> np.ndarray:
        return np.array([*self.numbers, 0], np.uint64)

    def steps(self, values: np.ndarray, before: np.ndarray, dish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of tokens that were read: the places of those that come after a word without an upper restaurant, and the
        code of the step, which is that word's with its low bits taken by its class and the dish."""
        at = np.flatnonzero(_stepped(before))
        word = values[at - 1]
        rare = word >= _RARE
        code = np.where(rare, word & ~_RARE, self.codes[np.where(rare, np.uint64(0), word).astype(np.int64)])
        return at, code & ~_LOW | (code & _CLASS) << np.uint64(_DISH_BITS) | dish[at].astype(np.uint64)

    def read(self, texts, known: _Values) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens of some texts, ends included: value, document, context, dish, whether it is rare."""
        parts, lengths = [], []
        for text in texts:
            split = tokens(text)
            parts.append(np.fromiter(map(known.__getitem__, split), np.uint64, len(split)))
            parts.append(np.array([self.end], np.uint64))
            lengths.append(len(split) + 1)
        values, lengths = np.concatenate(parts), np.array(lengths)
        docs = np.repeat(np.arange(len(lengths)), lengths)
        rare = values >= _RARE
        group = (values & _CLASS).astype(np.int64)
        numbers = np.where(rare, np.uint64(0), values).astype(np.int64)
        own = np.where(rare, CONTEXTS + group, self.contexts[numbers])
        before = np.empty(len(values), np.int64)
        before[1:] = own[:-1]
        before[np.cumsum(lengths) - lengths] = _END
        return values, docs, before, np.where(rare, self.end + 1 + group, numbers), rare


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The most frequent tokens of all training texts, by the counts of all tokens, equal ones by their code."""

    def reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counter()

        def report() -> pd.DataFrame:
            codes = np.fromiter(map(code_of, counts), np.int64, len(counts))
            return pd.DataFrame({"code": codes, "n": np.fromiter(counts.values(), np.int64, len(counts))})

        for batch in batches:
            for text in batch["text"]:
                counts.update(tokens(text))
                if len(counts) >= HELD:
                    yield report()
                    counts.clear()
        yield report()

    found = docs.where("not held_out").select("text").mapInPandas(reports, "code bigint, n bigint")
    with written_meanwhile(found.groupBy("code").agg(F.sum("n").alias("n")), "token-sums") as sums:
        # The count of the last token chosen, so that few others come near the driver; there are few different counts.
        running = F.sum("count").over(Window.orderBy(F.desc("n")))
        chosen = sums.groupBy("n").count().withColumn("before", running - F.col("count")).where(F.col("before") < DISHES)
        least = chosen.agg(F.min("n")).first()[0] or 0
        top = sums.where(F.col("n") >= least).orderBy(F.desc("n"), "code").limit(DISHES).collect()
    codes = [row["code"] for row in top]
    contexts = [k if k < CONTEXTS else CONTEXTS + code % CLASSES for k, code in enumerate(codes)]
    return Vocabulary({code: k for k, code in enumerate(codes)}, np.array([*contexts, _END], np.int64))


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the leading bits, so that sorted codes are sorted by bucket."""
    return (((codes & ~_RARE) >> np.uint64(31)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, those of one weight side by side, so that they can be compressed."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(packed: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _stretch(
    kind: str, chunk: int, buckets: int, train: np.ndarray, values: list, holders: list, contexts: list | None = None
) -> Iterator[tuple]:
    """A row for each bucket: codes, their training counts, how many occurrences, the document of each, and the contexts, if
    there are any: then a code is there once for each of its contexts."""
    codes, docs = np.concatenate(values), np.concatenate(holders)
    shared = np.zeros(len(codes), np.uint8) if contexts is None else np.concatenate(contexts)
    for parts in (values, holders, contexts or []):
        parts.clear()
    order = np.argsort(codes) if contexts is None else np.lexsort((shared, codes))
    codes, docs, shared = codes[order], docs[order], shared[order]
    del order
    other = (codes[1:] != codes[:-1]) | (shared[1:] != shared[:-1])
    starts = np.flatnonzero(np.concatenate([[True], other])) if len(codes) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(codes)))
    counts = np.add.reduceat(train[docs].astype(np.int32), starts) if len(starts) else np.empty(0, np.int32)
    distinct = codes[starts]
    at = _bucket(distinct, buckets)
    for bucket in np.unique(at):
        a, b = np.searchsorted(at, [bucket, bucket + 1])
        first, last = starts[a], starts[b] if b < len(starts) else len(codes)
        steps = np.diff(distinct[a:b], prepend=np.uint64(0))
        parts = [_planes(x) for x in (steps, counts[a:b].astype(np.int32), sizes[a:b].astype(np.int32))]
        within = b"" if contexts is None else shared[starts[a:b]].tobytes()
        yield kind, int(bucket), chunk, *parts, docs[first:last].tobytes(), within


def _sparse(table: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """Number, places and values of the rows that are not all zero."""
    out = []
    for k in np.flatnonzero(table.any(axis=1)):
        places = np.flatnonzero(table[k])
        out.append((int(k), places.astype(np.int32).tobytes(), table[k, places].astype(np.int64).tobytes()))
    return out


def counted(docs: DataFrame, vocab: Vocabulary, buckets: int) -> DataFrame:
    """Pairs of context and dish by context, counts of dishes, rare words and steps by bucket, and the documents of each
    stretch; written once."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = shared.value
        known, cells = _Values(vocab.numbers), (_END + 1) * vocab.dishes
        pairs, dishes = np.zeros(cells, np.int64), np.zeros(vocab.dishes, np.int64)
        chunk = TaskContext.get().partitionId() << 24
        waiting, steps, held, size, n_docs = ([], [], []), ([], []), [], 0, 0

        found: list[np.ndarray] = []

        def flush() -> Iterator[tuple]:
            np.add(pairs, np.bincount(np.concatenate(found), minlength=cells), out=pairs)
            found.clear()
            every = pd.concat(held)
            train = ~every["held_out"].to_numpy()
            ids = every["doc_id"]
            texts = (ids.fillna(0).to_numpy(np.int64), every["print"].to_numpy(np.int64), ids.isna().to_numpy())
            yield "docs", chunk, chunk, *[x.tobytes() for x in texts], b"", b""
            yield from _stretch("words", chunk, buckets, train, *waiting)
            yield from _stretch("steps", chunk, buckets, train, *steps)

        columns = [c.split()[0] for c in ROWS.split(", ")]

        def frames(found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
            """A few rows at a time, which are large."""
            while part := list(islice(found, 8)):
                yield pd.DataFrame(part, columns=columns)
        for batch in batches:
            values, at, context, dish, rare = vocab.read(batch["text"], known)
            train = ~batch["held_out"].to_numpy()[at]
            stepped, codes = vocab.steps(values, context, dish)
            dishes += np.bincount(dish[train], minlength=vocab.dishes)
            own = train.copy()
            own[stepped] = False
            found.append((context[own] * vocab.dishes + dish[own]).astype(np.int32))
            if n_docs + len(batch) > STRETCH_DOCS or size > STRETCH:
                yield from frames(flush())
                chunk += 1
                waiting, steps, held, size, n_docs = ([], [], []), ([], []), [], 0, 0
            waiting[0].append(values[rare])
            waiting[1].append((at[rare] + n_docs).astype(np.uint16))
            waiting[2].append(context[rare].astype(np.uint8))
            steps[0].append(codes)
            steps[1].append((at[stepped] + n_docs).astype(np.uint16))
            held.append(batch[["doc_id", "print", "held_out"]])
            size, n_docs = size + len(values), n_docs + len(batch)
        if held:
            yield from frames(flush())
        out = [("pairs", k, 0, a, b, b"", b"", b"") for k, a, b in _sparse(pairs.reshape(_END + 1, -1))]
        out += [("dishes", k, 0, a, b, b"", b"", b"") for k, a, b in _sparse(dishes.reshape(1, -1))]
        yield from frames(iter(out))

    texts = docs.select("doc_id", "print", "held_out", "text")
    # Rows are large, and a reader takes many rows of a file at once.
    return written(texts.mapInPandas(rows, ROWS), "token-counts", compression="zstd", maxRecordsPerFile=32)


def seat(counts: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after all its customers have sat down. ``mass``: that of a new table of the dish."""
    tables = (counts > 0).astype(np.int64)
    active, seated = np.flatnonzero(counts > 1), 1
    while len(active):
        group = np.minimum(max(1, seated // 16), counts[active] - seated)
        new = mass[active] / (mass[active] + seated - discount * tables[active])
        tables[active] += rng.binomial(group, np.clip(new, 0, 1))
        seated += max(1, seated // 16)
        active = active[counts[active] > seated]
    return tables


def discount_of(once: int, twice: int) -> float:
    """The discount that counts of one and two suggest."""
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))


@dataclass(frozen=True)
class Rare:
    """The restaurants of rare words: words, customers and discount, and the table totals before and after each sweep."""

    words: np.ndarray
    customers: np.ndarray
    discount: float
    tables: tuple[np.ndarray, ...]

    def seated(self, counts: np.ndarray, group: np.ndarray, bucket: int, sweep: int) -> np.ndarray:
        """Tables of each word in a sweep; the same whenever it is called."""
        share = (1 - UNKNOWN) / np.maximum(self.words, 1)
        mass = (STRENGTH + self.discount * self.tables[sweep]) * share
        return seat(counts, mass[group], self.discount, np.random.default_rng([bucket, sweep]))

    def predictive(self, counts: np.ndarray, group: np.ndarray, bucket: int) -> np.ndarray:
        """Probability of each word in its class, averaged over the kept sweeps; count 0: the unknown word."""
        total = np.zeros(len(counts))
        base = np.where(counts > 0, ((1 - UNKNOWN) / np.maximum(self.words, 1))[group], UNKNOWN)
        # A class without known words has the unknown one only.
        base = np.where((self.words == 0)[group], 1.0, base)
        for sweep in range(BURN, BURN + KEEP):
            tables = self.seated(counts, group, bucket, sweep)
            new = (STRENGTH + self.discount * self.tables[sweep + 1])[group] * base
            total += (np.maximum(counts - self.discount * tables, 0) + new) / (STRENGTH + self.customers[group])
        return total / KEEP


def _words(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a bucket, their training counts, and for each entry of each row its place among the codes."""
    codes = np.concatenate([np.cumsum(_from_planes(a, np.uint64), dtype=np.uint64) for a in rows["a"]])
    distinct, place = np.unique(codes, return_inverse=True)
    trained = np.concatenate([_from_planes(b, np.int32) for b in rows["b"]])
    counts = np.bincount(place, weights=trained, minlength=len(distinct))
    return distinct, counts.astype(np.int64), place


@dataclass(frozen=True)
class Following:
    """The restaurants of rare words by context and class: customers and discount, and the table totals before and after
    each sweep. ``base``: a word's probability in its class."""

    customers: np.ndarray
    discount: float
    tables: tuple[np.ndarray, ...]

    def seated(self, counts: np.ndarray, base: np.ndarray, at: np.ndarray, bucket: int, sweep: int) -> np.ndarray:
        """Tables of each word in a sweep; ``at``: its restaurant."""
        mass = (STRENGTH + self.discount * self.tables[sweep])[at] * base
        return seat(counts, mass, self.discount, np.random.default_rng([bucket, sweep, 1]))

    def predictive(self, counts: np.ndarray, base: np.ndarray, at: np.ndarray, bucket: int) -> np.ndarray:
        """Probability of each word in its restaurant, averaged over the kept sweeps."""
        total = np.zeros(len(counts))
        for sweep in range(BURN, BURN + KEEP):
            tables = self.seated(counts, base, at, bucket, sweep)
            new = (STRENGTH + self.discount * self.tables[sweep + 1])[at] * base
            total += (np.maximum(counts - self.discount * tables, 0) + new) / (STRENGTH + self.customers[at])
        return total / KEEP


def _in_contexts(rows: pd.DataFrame, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each pair of word and context of a bucket: the word's place, the restaurant, the training count; and for each entry
    of each row its place among the pairs."""
    context = np.frombuffer(b"".join(rows["e"]), np.uint8)
    trained = np.concatenate([_from_planes(b, np.int32) for b in rows["b"]])
    pairs, entry = np.unique(place * 256 + context, return_inverse=True)
    counts = np.bincount(entry, weights=trained, minlength=len(pairs)).astype(np.int64)
    word = pairs >> 8
    return word, (pairs & 255) * CLASSES + (codes[word] & _CLASS).astype(np.int64), counts, entry


def _gathered(rows: pd.DataFrame) -> pd.DataFrame:
    """The counts of a bucket's words, by class, and those of its pairs of word and context that training has."""
    codes, counts, place = _words(rows)
    group = (codes & _CLASS).astype(np.uint8)
    word, at, pairs, _ = _in_contexts(rows, codes, place)
    seen = pairs > 0
    kinds = {"counts": counts, "group": group, "word": word[seen].astype(np.int32), "at": at[seen].astype(np.int16), "pairs": pairs[seen]}
    return pd.DataFrame({"key": [rows["key"].iloc[0]]} | {name: [x.tobytes()] for name, x in kinds.items()})


def _per_restaurant(bags: DataFrame, columns: dict[str, type], size: int, measure: Callable, names: list[str]) -> np.ndarray:
    """Sums by restaurant over all buckets of what ``measure`` gives for a bucket: a table of fixed size."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bag in batch.itertuples():
                found = measure(bag.key, *[np.frombuffer(getattr(bag, c), kind) for c, kind in columns.items()])
                here = np.flatnonzero(np.any(found, axis=0))
                yield pd.DataFrame({"at": here} | {n: x[here] for n, x in zip(names, found)})

    schema = "at bigint, " + ", ".join(f"{n} bigint" for n in names)
    found = bags.select("key", *columns).mapInPandas(rows, schema)
    out = np.zeros((len(names), size), np.int64)
    for row in found.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[:, row["at"]] = [row[n] for n in names]
    return out


def _totals(at: np.ndarray, size: int, *values: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(at, weights=x, minlength=size).astype(np.int64) for x in values]


def _shape(size: int) -> Callable:
    """A measure: customers' dishes, customers, dishes with one and with two."""
    return lambda _, counts, at: _totals(at, size, counts > 0, counts, counts == 1, counts == 2)


_SHAPE = ["known", "customers", "once", "twice"]


def rare_model(words: DataFrame) -> tuple[Rare, Following, int]:
    """The restaurants of rare words after all sweeps, by class and by context and class, and the number of distinct words."""
    schema = "key bigint, counts binary, group binary, word binary, at binary, pairs binary"
    bags = words.select("key", "a", "b", "e").groupBy("key").applyInPandas(_gathered, schema)
    with written_meanwhile(bags, "rare-words") as bags:
        columns = {"counts": np.int64, "group": np.uint8}
        known, customers, once, twice = _per_restaurant(bags, columns, CLASSES, _shape(CLASSES), _SHAPE)
        model = Rare(known, customers, discount_of(once.sum(), twice.sum()), (known,))
        for sweep in range(BURN + KEEP):
            now = model
            tables = lambda key, counts, group: _totals(group, CLASSES, now.seated(counts, group, key, sweep))  # noqa: B023, E731
            found = _per_restaurant(bags, columns, CLASSES, tables, ["tables"])[0]
            model = Rare(known, customers, model.discount, (*model.tables, found))

        def with_base(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                base = []
                for bag in batch.itertuples():
                    counts, group = np.frombuffer(bag.counts, np.int64), np.frombuffer(bag.group, np.uint8)
                    base.append(model.predictive(counts, group, bag.key)[np.frombuffer(bag.word, np.int32)].tobytes())
                yield pd.DataFrame({"key": batch["key"], "pairs": batch["pairs"], "base": base, "at": batch["at"]})

        based = bags.mapInPandas(with_base, "key bigint, pairs binary, base binary, at binary")
        with written_meanwhile(based, "rare-pairs") as pairs:
            return model, _following(pairs), int(known.sum())


def _following(pairs: DataFrame) -> Following:
    size = (_END + 1) * CLASSES
    columns = {"pairs": np.int64, "at": np.int16}
    known, customers, once, twice = _per_restaurant(pairs, columns, size, _shape(size), _SHAPE)
    model = Following(customers, discount_of(once.sum(), twice.sum()), (known,))
    columns = {"pairs": np.int64, "base": np.float64, "at": np.int16}
    for sweep in range(BURN + KEEP):
        now = model
        tables = lambda key, n, base, at: _totals(at, size, now.seated(n, base, at, key, sweep))  # noqa: B023, E731
        found = _per_restaurant(pairs, columns, size, tables, ["tables"])[0]
        model = Following(customers, model.discount, (*model.tables, found))
    return model


def step_chances(codes: np.ndarray, counts: np.ndarray, logs: np.ndarray, bucket: int) -> np.ndarray:
    """Averaged probability of each step of a bucket, whose codes are sorted: the dish in the restaurant of the word before.

    ``logs``: those of the dishes in the restaurants above.
    """
    above = codes >> np.uint64(_DISH_BITS)
    base = 10.0 ** logs[CONTEXTS + (above & _CLASS).astype(np.int64), (codes & _DISH).astype(np.int64)].astype(np.float64)
    starts = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
    at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    discount = discount_of((counts == 1).sum(), (counts == 2).sum())
    customers, tables = np.add.reduceat(counts, starts), np.add.reduceat((counts > 0).astype(np.int64), starts)
    total = np.zeros(len(codes))
    for sweep in range(BURN + KEEP):
        mass = (STRENGTH + discount * tables)[at] * base
        own = seat(counts, mass, discount, np.random.default_rng([bucket, sweep]))
        tables = np.add.reduceat(own, starts)
        if sweep >= BURN:
            new = (STRENGTH + discount * tables)[at] * base
            total += (np.maximum(counts - discount * own, 0) + new) / (STRENGTH + customers)[at]
    return total / KEEP


def sent(steps: DataFrame, dishes: int) -> DataFrame:
    """The customers of the classes' restaurants: one for each dish of each word of the class. By context, places, counts."""

    def customers(rows: pd.DataFrame) -> pd.DataFrame:
        codes, counts, _ = _words(rows)
        codes = codes[counts > 0]
        group = (codes >> np.uint64(_DISH_BITS) & _CLASS).astype(np.int64)
        cells = np.bincount(group * dishes + (codes & _DISH).astype(np.int64), minlength=CLASSES * dishes)
        found = [(CONTEXTS + k, a, b) for k, a, b in _sparse(cells.reshape(CLASSES, -1))]
        return pd.DataFrame(found, columns=["key", "a", "b"])

    return steps.select("key", "a", "b").groupBy("key").applyInPandas(customers, "key bigint, a binary, b binary")


def dish_counts(rows: DataFrame, dishes: int) -> np.ndarray:
    """The training count of each dish."""
    counts = np.zeros(dishes, np.int64)
    for row in rows.groupBy("key").applyInPandas(_summed, "key bigint, places binary, counts binary").collect():
        counts[np.frombuffer(row["places"], np.int32)] = np.frombuffer(row["counts"], np.int64)
    return counts


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    places = np.frombuffer(b"".join(rows["a"]), np.int32)
    counts = np.frombuffer(b"".join(rows["b"]), np.int64)
    distinct, at = np.unique(places, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    return pd.DataFrame({"key": [rows["key"].iloc[0]], "places": [distinct.tobytes()], "counts": [total.tobytes()]})


def context_model(pairs: DataFrame, dishes: int) -> tuple[np.ndarray, np.ndarray]:
    """Averaged probability of each dish in each context, and the training count of each dish. Of fixed size."""
    summed = pairs.groupBy("key").applyInPandas(_summed, "key bigint, places binary, counts binary")
    contexts = written(summed, "contexts").cache()
    spark = pairs.sparkSession
    counts = np.zeros((_END + 1, dishes), np.int64)
    for row in contexts.collect():
        counts[row["key"], np.frombuffer(row["places"], np.int32)] = np.frombuffer(row["counts"], np.int64)
    discount = discount_of((counts == 1).sum(), (counts == 2).sum())
    customers = counts.sum(axis=1, keepdims=True)
    tables = (counts > 0).astype(np.int64)
    root_tables, total = 0, np.zeros((_END + 1, dishes))
    rng = np.random.default_rng(11)

    def root(tables: np.ndarray, before: int) -> tuple[np.ndarray, int]:
        sent = tables.sum(axis=0)
        own = seat(sent, np.full(dishes, (STRENGTH + discount * before) / dishes), discount, rng)
        new = (STRENGTH + discount * own.sum()) / dishes
        return (np.maximum(sent - discount * own, 0) + new) / (STRENGTH + sent.sum()), int(own.sum())

    parent, root_tables = root(tables, root_tables)
    for sweep in range(BURN + KEEP):
        state = spark.sparkContext.broadcast((parent, tables.sum(axis=1), discount, sweep))

        def seated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parent, totals, discount, sweep = state.value  # noqa: B023
            for batch in batches:
                found = []
                for key, places, n in zip(batch["key"], batch["places"], batch["counts"]):
                    mass = (STRENGTH + discount * totals[key]) * parent[np.frombuffer(places, np.int32)]
                    own = seat(np.frombuffer(n, np.int64), mass, discount, np.random.default_rng([key, sweep]))
                    found.append(own.astype(np.int32).tobytes())
                yield pd.DataFrame({"key": batch["key"], "places": batch["places"], "tables": found})

        tables = np.zeros_like(counts)
        for row in contexts.mapInPandas(seated, "key bigint, places binary, tables binary").collect():
            tables[row["key"], np.frombuffer(row["places"], np.int32)] = np.frombuffer(row["tables"], np.int32)
        if sweep >= BURN:
            new = (STRENGTH + discount * tables.sum(axis=1, keepdims=True)) * parent
            total += (np.maximum(counts - discount * tables, 0) + new) / (STRENGTH + customers)
        parent, root_tables = root(tables, root_tables)
    contexts.unpersist()
    return total / KEEP, counts.sum(axis=0)


def score(docs: DataFrame, of: int = 10, remainder: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each document."""
    spark = docs.sparkSession
    docs = need(small_batches(docs), doc_id="bigint", text="string")
    docs = docs.withColumns({"print": fingerprint(F.col("text")), "held_out": held_out(F.col("doc_id"), of, remainder)})
    buckets = max(BUCKETS, partitions(spark))
    # What training has shuffled is not needed any more when the scores are worked out.
    with shuffles_removed(spark):
        vocab = vocabulary(docs)
        rows = counted(docs, vocab, buckets)
        words, steps = rows.where("kind = 'words'"), rows.where("kind = 'steps'")
        counts = dish_counts(rows.where("kind = 'dishes'").select("key", "a", "b"), vocab.dishes)
        pairs = rows.where("kind = 'pairs'").select("key", "a", "b")
        chances, _ = context_model(pairs.union(sent(steps, vocab.dishes)), vocab.dishes)
        rare, following, rare_words = rare_model(words)
    n = int(counts.sum())
    types = rare_words + int((counts[: vocab.end + 1] > 0).sum())
    known, total = counts[: vocab.end + 1], n + 0.1 * (types + 1)
    shared = spark.sparkContext.broadcast((vocab, np.log10(chances).astype(np.float32), known, rare, following, total))

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a text's frequent tokens and the classes of its rare ones add."""
        vocab, logs, known, _, _, total = shared.value
        base, values_of = np.log10((known + 0.1) / total), _Values(vocab.numbers)
        for batch in batches:
            _, at, context, dish, rare = vocab.read(batch["text"], values_of)
            number = np.where(rare, 0, dish)
            size = len(batch)
            chance = logs[context, dish].astype(np.float64)
            # What comes after a word that has no upper restaurant is worked out where its own is.
            chance[_stepped(context)] = 0
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "print": batch["print"],
                    "held_out": batch["held_out"],
                    "n_tokens": np.bincount(at, minlength=size),
                    "own_known": np.bincount(at[~rare & (known[number] > 0)], minlength=size),
                    "own_base": np.bincount(at[~rare], weights=base[number[~rare]], minlength=size),
                    "own_score": np.bincount(at, weights=chance, minlength=size),
                }
            ).astype({"doc_id": "Int64"})

    def added(rows: pd.DataFrame, place: np.ndarray, measures: list[tuple[np.ndarray, type]]) -> pd.DataFrame:
        """Sums of measures of a bucket's codes over the documents of each stretch; what is not measured stays empty."""
        out, first = [], 0
        for chunk, sizes, docs in zip(rows["chunk"], rows["c"], rows["d"]):
            sizes, docs = _from_planes(sizes, np.int32), np.frombuffer(docs, np.uint16)
            at = np.repeat(place[first : first + len(sizes)], sizes)
            first += len(sizes)
            sums = [np.bincount(docs, weights=x[at]).astype(kind).tobytes() for x, kind in measures]
            out.append((chunk, *sums, *[b""] * (3 - len(sums))))
        return pd.DataFrame(out, columns=["chunk", "a", "b", "c"])

    def by_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        """What a bucket's words or steps add to the documents of each stretch."""
        _, above, _, rare, following, total = shared.value
        codes, counts, place = _words(rows)
        bucket = int(rows["key"].iloc[0])
        if rows["kind"].iloc[0] == "steps":
            return added(rows, place, [(np.log10(step_chances(codes, counts, above, bucket)), np.float64)])
        group = (codes & _CLASS).astype(np.int64)
        word, at, pairs, place = _in_contexts(rows, codes, place)
        logs = np.log10(following.predictive(pairs, rare.predictive(counts, group, bucket)[word], at, bucket))
        base = np.log10((counts + 0.1) / total)
        return added(rows, place, [(logs, np.float64), (base[word], np.float64), ((counts > 0)[word], np.int32)])

    def by_stretch(rows: pd.DataFrame) -> pd.DataFrame:
        docs = rows[rows["kind"] == "docs"].iloc[0]
        ids, prints = np.frombuffer(docs["a"], np.int64), np.frombuffer(docs["b"], np.int64)
        sums = np.zeros((3, len(ids)))
        for row in rows[rows["kind"] == "sums"].itertuples():
            for total, packed, kind in zip(sums, (row.a, row.b, row.c), (np.float64, np.float64, np.int32)):
                found = np.frombuffer(packed, kind)
                total[: len(found)] += found
        found = pd.DataFrame({"id": ids, "own_print": prints, "more_score": sums[0], "more_base": sums[1], "more_known": sums[2]})
        found["id"] = found["id"].astype("Int64").mask(np.frombuffer(docs["c"], bool))
        return found

    dealt = rows.where("kind in ('words', 'steps')").groupBy("kind", "key")
    sums = dealt.applyInPandas(by_bucket, "chunk bigint, a binary, b binary, c binary")
    both = sums.select(F.lit("sums").alias("kind"), "chunk", "a", "b", "c").union(
        rows.where("kind = 'docs'").select("kind", "chunk", "a", "b", "c")
    )
    schema = "id bigint, own_print bigint, more_score double, more_base double, more_known double"
    more = both.groupBy("chunk").applyInPandas(by_stretch, schema)
    # Rows that share doc_id and text have the same sums.
    more = more.groupBy("id", "own_print").agg(*[F.max(c).alias(c) for c in ("more_score", "more_base", "more_known")])
    schema = (
        "doc_id bigint, print bigint, held_out boolean, n_tokens bigint, own_known bigint, own_base double, own_score double"
    )
    own = docs.select("doc_id", "print", "held_out", "text").mapInPandas(frequent, schema)
    whole = own.join(more, own["doc_id"].eqNullSafe(more["id"]) & (own["print"] == more["own_print"]), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("own_known", "more_known").cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        plus("own_base", "more_base").alias("base_score"),
        plus("own_score", "more_score").alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
