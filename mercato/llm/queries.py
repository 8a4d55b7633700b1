"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm import decontamination, extraction, id_files, language, line_dedup, merkle, mixing, perplexity
from mercato.llm import quality, ranked_search, sharding, simhash, url_filter
from mercato.llm import sql
from mercato.llm.common import ascii_lower, table
from mercato.session import fresh_path


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.score(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.col("text").cast("string")
    sums = F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("bigint")
    sized = docs.withColumns({"size": sharding.size_of(text), "text_crc32": sums})
    placed = sharding.place(sized, ("doc_id", "size", "text_crc32"))
    law = {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}
    return placed.withColumns(law)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(table(spark, sf_dir, "documents"), keep=("doc_id", "source"))
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is read from the page itself."""
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge(pages, url_filter.page_outcomes(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extraction.extract(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row carries the leaf it would have after tampering, next to its own, and is checked with that one."""
    docs, text = table(spark, sf_dir, "documents"), F.col("text").cast("string")
    touched = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
    changed = F.when(touched, merkle.leaf_of({"text": ascii_lower(text)}))
    manifest = merkle.build(docs, keep={"changed": changed})
    folded = merkle.fold(F.coalesce("changed", "digest"), F.col("path"))
    return (
        manifest.proofs()
        .select(
            "doc_id",
            F.col("digest").alias("leaf"),
            "subroot",
            F.lit(manifest.root).cast("string").alias("root"),
            merkle.proof_digest(F.col("path")).alias("proof_sha256"),
            folded.alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-ids")
    index = id_files.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    found = id_files.read_ids(spark, folder, index)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filters": op9_url_filters,
    "op10_html_extraction": op10_html_extraction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_ids": op12_token_ids,
    "op13_ranked_search": op13_ranked_search,
}

SQL = {
    "op1_line_dedup": sql.OP1,
    "op2_decontamination": sql.OP2,
    "op7_mixing": sql.OP7,
    "op8_quality_rules": sql.OP8,
    "op9_url_filters": sql.OP9,
    "op11_merkle_manifest": sql.OP11,
    "op13_ranked_search": sql.OP13,
}
