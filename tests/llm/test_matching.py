"""SimHash near-dedup, components and decontamination, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import BENCHMARK, ROWS, benchmark, clashing, documents, rows_of
from cases import SMALL
from mercato.llm import components, decontamination, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[j : j + 3]) for j in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(prints, radius=2):
    """Fingerprints by root, for a list of fingerprints."""
    values = sorted(set(prints))
    array = np.array(values, dtype=np.uint64)
    links = [
        (a, values[j])
        for i, a in enumerate(values)
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= radius)
    ]
    return brute_roots(links, values)


def near_rows(rng, n, groups):
    """Fingerprints in chains of small steps."""
    out = []
    for _ in range(groups):
        at = rng.getrandbits(64)
        for _ in range(n):
            out.append(at)
            for _ in range(rng.randint(0, 4)):
                at ^= 1 << rng.randrange(64)
    return out


@pytest.mark.parametrize("pieces", [4, 8, 16])
@pytest.mark.parametrize("chunk", [8, 16384])
def test_tiles_lose_no_link(spark, monkeypatch, pieces, chunk):
    rng = random.Random(pieces)
    prints = sorted(set(near_rows(rng, 40, 8) + [0, 1, 3, 2**64 - 1] + [rng.getrandbits(64) for _ in range(50)]))
    monkeypatch.setattr(simhash, "pieces_for", lambda n: pieces)
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print bigint")
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(table, chunk=chunk).collect()]
    assert all(bin(a ^ b).count("1") > 0 for a, b in links)
    found, expected = brute_roots(links, prints), brute_components(prints)
    assert found == expected


def test_components(spark):
    rng = random.Random(1)
    links = [(n, n + 1) for n in range(200)] + [(1000, n) for n in range(1001, 1300)]
    links += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (7, 6), (6, 7)]
    rng.shuffle(links)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for link in links for n in link}
    assert {n: found.get(n, n) for n in nodes} == brute_roots(links, nodes)


@pytest.mark.parametrize("shape", [lambda d: d, clashing], ids=["plain", "clashing"])
def test_near_duplicates(spark, shape):
    found = rows_of(simhash.near_duplicates(shape(documents(spark))))
    root = brute_components([brute_print(t) for _, t, *_ in ROWS])
    least = defaultdict(list)
    for i, t, *_ in ROWS:
        least[root[brute_print(t)]].append(i)
    expected = [
        (i, f"{brute_print(t):016x}", min((x for x in least[root[brute_print(t)]] if x is not None), default=None))
        for i, t, *_ in ROWS
    ]
    assert found == sorted(expected, key=repr)


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute_components([brute_print(t) for _, t, *_ in ROWS]).values()))
    assert {r["doc_id"] for r in kept.where("doc_id in (15, 16)").collect()} == {15}


def test_fingerprints_of_long_text_in_stretches(monkeypatch):
    text = " ".join(f"w{n * n % 1009}" for n in range(1000))
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert simhash.simhash(text) % 2**64 == brute_print(text)


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        n = min(len(words), 10)
        for j in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[j : j + n])].add(item)
    out = []
    for i, text, *_ in rows:
        words, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(w) for w in windows}:
            for j in range(len(words) - n + 1):
                if (w := tuple(words[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[w]
        out.append((i, len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shape", [lambda d: d, clashing], ids=["plain", "clashing"])
def test_contamination(spark, shape):
    found = decontamination.contamination(shape(documents(spark)), benchmark(spark))
    assert rows_of(found, ["doc_id", "n_words", "n_hit", "items"]) == brute_contamination(ROWS, BENCHMARK)


def test_contamination_of_random_texts(spark):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(6)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(n, text(rng.randint(0, 30))) for n in range(30)]
    rows = [(n, text(rng.randint(0, 300)), None, None, None) for n in range(30)]
    rows += [(100 + n, f"{text(3)} {items[n][1]} {text(3)}", None, None, None) for n in range(30)]
    found = decontamination.contamination(documents(spark, rows), benchmark(spark, items))
    assert rows_of(found, ["doc_id", "n_words", "n_hit", "items"]) == brute_contamination(rows, items)


def test_query_against_brute_force(spark):
    from mercato.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    expected = [
        (i, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)
        for i, n, hit, ids in brute_contamination([(r["doc_id"], r["text"]) for r in docs], items)
    ]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows_of(QUERIES["op2_decontamination"](spark, SMALL), names) == sorted(expected, key=repr)
    root = brute_components([brute_print(r["text"]) for r in docs])
    least = {}
    for r in docs:
        at = root[brute_print(r["text"])]
        least[at] = min(least.get(at, r["doc_id"]), r["doc_id"])
    expected = [(r["doc_id"], f"{brute_print(r['text']):016x}", least[root[brute_print(r["text"])]]) for r in docs]
    assert rows_of(QUERIES["op6_simhash"](spark, SMALL)) == sorted(expected, key=repr)


def test_decontaminated_rows(spark):
    docs = documents(spark)
    clean = decontamination.decontaminate(docs, benchmark(spark))
    hit = {i for i, _, n, _ in brute_contamination(ROWS, BENCHMARK) if n}
    assert hit and clean.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == sorted(i or 0 for i, *_ in ROWS if i not in hit)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert simhash.near_duplicates(none).collect() == simhash.dedup(none).collect() == []
    assert decontamination.contamination(none, benchmark(spark)).collect() == []
    free = decontamination.contamination(documents(spark), benchmark(spark, []))
    assert free.agg(F.sum("n_hit")).first()[0] == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 5, 400).astype(np.uint64)
    chosen = set(decontamination.winnow(decontamination.gram_hashes(words, 5), 6))
    assert all(chosen & set(range(n, n + 6)) for n in range(len(words) - 9))
