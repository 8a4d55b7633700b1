"""Ranked search against scores of every document, in plain Python and in SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from cases import BENCHMARK, ROWS, benchmark, clashing, documents, rows_of, sql
from mercato.llm import ranked_search
from mercato.llm.sql import OP13

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    bags = [(doc_id, Counter(terms(text)), len(terms(text))) for doc_id, text in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    frequency = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for doc_id, bag, n in bags:
            score = 0
            for t in terms(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                    m = 100 - 25 + 25 * n * n_docs // n_terms
                    score += w * (1000000000 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(scores)[:k], 1):
            out.append((item_id, rank, None if none else doc_id, -score))
    return sorted(out, key=repr)


def made(seed, n_docs, n_items):
    """Texts over a vocabulary with very common and rare words, many of them equal, so that scores tie."""
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(300)]
    weights = [1 / (n + 1) for n in range(300)]
    draw = lambda most: " ".join(rng.choices(words, weights, k=rng.randint(1, most)))
    docs = [(n, draw(60)) for n in range(n_docs)]
    docs += [(n_docs + n, rng.choice(docs)[1]) for n in range(n_docs)]
    return docs, [(n, draw(12)) for n in range(n_items)]


@pytest.mark.parametrize("bucket", [1, 7, 4096])
def test_against_all_scores(spark, monkeypatch, bucket):
    monkeypatch.setattr(ranked_search, "BUCKET", bucket)
    docs, items = made(bucket, 150, 40)
    rows = documents(spark, [(i, t, "en", "a", 1) for i, t in docs]).repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(ranked_search.search(rows, asked)) == brute(docs, items)
    assert rows_of(ranked_search.search(rows, asked, k=3, block_bytes=100)) == brute(docs, items, 3)


def test_awkward_rows(spark):
    items = [*BENCHMARK, (1, "the other text"), (7, "WORD1 word1 Öl"), (7, "WORD1 word1 Öl")]
    docs = clashing(documents(spark)).repartition(4)
    found = ranked_search.search(docs, clashing(benchmark(spark, items)))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    expected = brute([(r[0], r[1]) for r in ROWS], items)
    assert rows_of(found) == expected
    by_sql = sql(spark, OP13, documents=documents(spark), benchmark=benchmark(spark, items))[0]
    assert sorted(map(tuple, by_sql), key=repr) == expected


def test_empty_tables(spark):
    none, one = documents(spark, []), benchmark(spark, [(1, "a b")])
    assert ranked_search.search(none, one).count() == 0
    assert ranked_search.search(documents(spark), benchmark(spark, [])).count() == 0
    assert ranked_search.search(documents(spark), benchmark(spark, [(1, None), (2, "..."), (3, "nowhere")])).count() == 0


def test_long_vectors_first_spare_work():
    """The bounds leave most of the vectors unscored once a query has its k."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{n}" for n in rng.zipf(1.3, 80) if n < 3000) for _ in range(4000)]
    queries = ranked_search.Queries([" ".join(f"w{n}" for n in rng.integers(1, 2000, 8)) for _ in range(30)])
    bags = [Counter(ranked_search.terms_of(t)) for t in texts]
    known = queries.vocabulary
    vectors = [sorted((known[t], c) for t, c in bag.items() if t in known) for bag in bags]
    frequency = np.bincount([t for v in vectors for t, _ in v], minlength=len(known))
    weights = ranked_search.Weights(frequency, len(texts), sum(sum(b.values()) for b in bags))
    rows = pd.DataFrame(
        {
            "doc_id": range(len(texts)), "none": False, "row": 0, "n": [sum(b.values()) for b in bags],
            "terms": [[t for t, _ in v] for v in vectors], "counts": [[c for _, c in v] for v in vectors],
        }
    )
    rows = rows[rows["terms"].map(len) > 0].reset_index(drop=True)
    whole = ranked_search.Bucket(rows.assign(length=0.0), weights)
    rows["length"] = np.sqrt(np.add.reduceat(whole.impacts.astype(float) ** 2, whole.starts))
    rows = rows.sort_values("length", ascending=False)
    best = ranked_search.Best(len(queries), 20, np.zeros(len(queries), np.int64))
    scored = 0
    for start in range(0, len(rows), 500):
        bucket = ranked_search.Bucket(rows.iloc[start : start + 500], weights)
        scored += ranked_search.search_bucket(queries, bucket, best)
    holding = sum(len(set(v) & set(q)) > 0 for v in ([t for t, _ in x] for x in vectors)
                  for q in (queries.ids[a:b] for a, b in zip(queries.starts, queries.ends)))
    assert scored < holding / 2
