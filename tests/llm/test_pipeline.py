"""The corpus pipeline, stage by stage and as a whole."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from cases import documents
from cases import SMALL
from mercato.llm import decontamination, mixing, quality, simhash
from mercato.session import written


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SMALL), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert docs.columns == [*columns, "curve_index", "shard", "slot"]


def test_whole_run_against_its_decisions(spark):
    """Every decision again from the digest of each operator, applied in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r["doc_id"] for r in quality.measured(docs).where("kept").collect()}
    left = docs.where(docs["doc_id"].isin(sorted(good)))
    first = {r["component_id"] for r in simhash.near_duplicates(left).collect()}
    left = left.where(left["doc_id"].isin(sorted(first)))
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontamination.contamination(left, bench).where("n_hit > 0").collect()}
    left = left.where(~left["doc_id"].isin(sorted(hit)))
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.copies(left).collect()})
    found = corpus_pipeline.run(spark, SMALL)
    assert Counter(r["doc_id"] for r in found.collect()) == +copies
    counts = Counter(r["shard"] for r in found.collect())
    assert max(counts.values()) - min(counts.get(n, 0) for n in range(24)) <= 1


def test_empty_documents(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
