"""Line dedup, quality rules, mixing and sharding."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from cases import ROWS, clashing, documents, rows_of, sql
from cases import SMALL
from mercato.llm import line_dedup, mixing, quality, sharding
from mercato.llm import sql as oracle

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACES).translate(LOWER)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shape", [lambda d: d, clashing], ids=["plain", "clashing"])
def test_lines(docs, shape):
    found = line_dedup.dedup_lines(shape(docs))
    assert rows_of(found, ["doc_id", "n_lines", "n_dropped", "text"]) == brute_lines(ROWS)


def test_lines_beyond_one_bitmap(spark):
    text = "\n".join(f"line {n}, long enough to be counted" for n in range(70_000))
    rows = [(n, text, None, None, None) for n in (1, 2)] + [(3, text.split("\n")[65_535], None, None, None)]
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert [found[n]["n_dropped"] for n in (1, 2, 3)] == [1, 1, 0]
    assert found[1]["text"].split("\n") == text.split("\n")[:65_535] + text.split("\n")[65_536:]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeat = {j + k for j, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeat), failed)


def test_quality(docs):
    found = quality.measured(clashing(docs))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(found, names) == sorted(((i, *brute_quality(t)) for i, t, *_ in ROWS), key=repr)


def test_cascade_agrees_with_the_verdict_in_any_order(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r["doc_id"] for r in quality.measured(docs).where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept
    back = docs.where(quality.verdict(F.col("text"), list(reversed(quality.RULES))).isNull())
    assert {r["doc_id"] for r in back.collect()} == kept
    assert quality.keep_good(docs).columns == docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert not bad & kept


def test_rules_have_one_order_however_the_table_is_cut(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    orders = {tuple(r.name for r in quality.order_rules(docs.repartition(n % 7 + 1))) for n in range(10)}
    assert len(orders) == 1


def test_order_by_what_earlier_rules_left(spark):
    """Of two rules that reject the same documents the second has nothing left to reject and goes last."""
    many, few = (lambda m: m("n_symbols") > 0), (lambda m: m("n_shouts") > 0)
    rules = (
        quality.Rule("few", ("n_shouts",), few),
        quality.Rule("again", ("n_symbols", "n_shouts"), many),
        quality.Rule("many", ("n_symbols",), many),
        quality.Rule("none", ("n_words",), lambda m: m("n_words") < 0),
    )
    texts = ["# sign"] * 30 + ["so!!"] * 10 + ["plain words"] * 60
    docs = documents(spark, [(n, t, "en", "a", 1) for n, t in enumerate(texts)])
    found = quality.estimates(docs, rules)
    assert [(e.rule.name, e.reached, e.rejected) for e in found] == [
        ("many", 100, 30), ("few", 70, 10), ("none", 60, 0), ("again", 60, 0),
    ]
    rejected = {r["doc_id"]: r["rejected_by"] for r in quality.judge(docs, rules).collect()}
    assert rejected == {n: "many" if n < 30 else "few" if n < 40 else None for n in range(100)}


def test_measures_are_worked_out_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = quality.measured(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[#*$%&|<>]") == 1 and plan.count("array_join") == 1 and plan.count("[A-Z]") == 1


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), list(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in open_:
            target[s] += share * weight[s]
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
        open_ = [s for s in open_ if target[s] < most * sizes[s]]
    return target


def test_mixing(docs):
    found = mixing.copies(clashing(docs)).collect()
    sizes = defaultdict(int)
    for _, text, _, source, _ in ROWS:
        sizes[source] += len((text or "").split())
    target = filled(sizes)
    for row in found:
        assert row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(target[row["source"]])
        assert 0 <= row["copies"] <= 3
    for source in sizes:
        own = [r for r in found if r["source"] == source]
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - target[source]) <= max(r["size"] for r in own)
    assert rows_of(mixing.copies(docs)) == rows_of(mixing.copies(docs.repartition(5)))


def test_mix_repeats_rows_and_keeps_columns(docs):
    copies = Counter()
    for row in mixing.copies(docs).collect():
        copies[row["doc_id"], row["text"], row["source"]] += row["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect()) == +copies


def test_hilbert_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    path = cells[np.argsort(sharding.hilbert_index(cells, 3))]
    assert sorted(sharding.hilbert_index(cells, 3)) == list(range(512))
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("shards", [4, 24, 100])
def test_shards(docs, shards):
    found = sharding.shard(clashing(docs), shards).collect()
    assert sorted(r["doc_id"] or 0 for r in found) == sorted(i or 0 for i, *_ in ROWS)
    slots = defaultdict(list)
    for row in found:
        slots[row["shard"]].append(row["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == len(ROWS) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = [r["curve_index"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


def test_empty_tables(spark):
    none = documents(spark, [])
    for found in (
        line_dedup.dedup_lines(none),
        quality.measured(none),
        quality.keep_good(none),
        mixing.copies(none),
        mixing.mix(none),
        sharding.shard(none),
    ):
        assert found.collect() == []


def test_sql_of_small_tables(docs):
    unique = docs.where("doc_id is not null and doc_id < 16")
    for query, found in (
        (oracle.OP1, line_dedup.dedup_lines(unique).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")),
        (oracle.OP8, quality.measured(unique)),
    ):
        rows, names = sql(None, query, documents=unique)
        assert sorted(rows, key=repr) == rows_of(found, names)


def test_kept_text_hash(docs):
    row = line_dedup.dedup_lines(docs).withColumn("h", F.sha2(F.encode("text", "UTF-8"), 256)).where("doc_id = 12").first()
    assert row["h"] == hashlib.sha256(row["text"].encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(n for n in contract.oracle_sql() if n.startswith("op")))
def test_query_agrees_with_its_sql(spark, name):
    import sys

    from cases import ROOT

    sys.path.insert(0, str(ROOT / "tools"))
    from compare import database, differences

    assert differences(spark, database(SMALL), name, SMALL) is None


@pytest.mark.parametrize("name", ["op1_line_dedup", "op7_mixing", "op8_quality_rules"])
def test_native_queries_run_no_python(spark, name):
    plan = contract.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
