"""The Merkle manifest against a tree built in plain Python, and against its SQL."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from cases import ROWS, clashing, documents, rows_of, sql
from mercato.llm import merkle
from mercato.llm.queries import op11_merkle_manifest
from mercato.llm.sql import OP11

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    text = text.translate(UPPER) if lower and text is not None else text
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def climb(nodes):
    """Root and, for each node, the siblings before and after it on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, place in zip(paths, at):
            run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
            path.append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return nodes[0], paths


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    lower = {lang: climb([leaf(r) for r in trees[lang]]) for lang in langs}
    root, upper = climb([lower[lang][0] for lang in langs])
    out = []
    for n, lang in enumerate(langs):
        subroot, paths = lower[lang]
        for row, path in zip(trees[lang], paths):
            whole = path + upper[n]
            touched = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf(row, touched)
            for before, after in whole:
                node = sha(before + node + after)
            proof = sha("".join(b + a for b, a in whole))
            out.append((row[0], leaf(row), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def many(n, lang):
    """So many rows that a tree has several levels, the last run of each only part full."""
    return [(k, f"Text number {k}", lang, "S", k) for k in range(n)]


def digest(spark, docs, monkeypatch):
    from mercato.llm import queries

    monkeypatch.setattr(queries, "table", lambda *_: docs)
    return op11_merkle_manifest(spark, "")


def test_query_against_plain_python_and_sql(spark, monkeypatch):
    rows = ROWS + many(70, "xx") + many(9, "") + many(8, "a") + [(5, f"T{k}", f"l{k}", None, None) for k in range(70)]
    docs = documents(spark, rows).repartition(5)
    found = digest(spark, docs, monkeypatch)
    assert rows_of(found) == brute(rows)
    expected, names = sql(spark, OP11, documents=docs)
    assert names == found.columns
    assert sorted(map(tuple, expected), key=repr) == brute(rows)


def test_clashing_columns_and_one_row(spark, monkeypatch):
    docs = documents(spark, [(1, "A", None, None, None)])
    names = "tree place n digest run before after path changed subroot _rank _tie"
    more = clashing(docs).withColumns({name: F.lit(1) for name in names.split()})
    assert rows_of(digest(spark, more, monkeypatch)) == brute([(1, "A", None, None, None)])


def test_empty_table(spark, monkeypatch):
    docs = documents(spark, [])
    assert merkle.build(docs).root is None
    assert digest(spark, docs, monkeypatch).count() == 0


def test_one_row_repeated_very_often(spark, monkeypatch):
    rows = [(1, "same", "en", "a", 1)] * 700 + many(20, "en")
    assert rows_of(digest(spark, documents(spark, rows), monkeypatch)) == brute(rows)


def test_differences(spark):
    manifest = merkle.build(documents(spark))
    assert merkle.differences(documents(spark).repartition(3), manifest).count() == 0
    changed = [(r[0], "new" if r[0] == 12 else r[1], *r[2:]) for r in ROWS if r[0] != 13]
    found = {(r["doc_id"], r["leaf"]): r["change"] for r in merkle.differences(documents(spark, changed), manifest).collect()}
    old = {r[0]: leaf(r) for r in ROWS}
    new = leaf((12, "new", "de", "a", 1))
    assert found == {(12, old[12]): -1, (12, new): 1, (13, old[13]): -1}
