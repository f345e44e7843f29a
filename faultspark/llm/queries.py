"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultspark.functions.exprs import rnd

from . import conversation_trie, exact_topk, fingerprints, line_dedup, mixing, near_join, packing, quality_model, quality_rules, spelling, token_files, toxicity, url_reputation


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the quality label of the document with its number."""
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    out = url_reputation.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).drop("url")
    return out.withColumns({c: rnd(c) for c in ("reputation", "reputation_high")})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).drop("text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.array_join(F.transform("removed_runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return out.withColumn("removed_runs", runs).drop("text")


def op10_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("d", "t", "first")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_fingerprints, op3_toxicity, op4_mix_sources, op5_token_files, op6_quality_model,
    op7_url_reputation, op8_quality_rules, op9_line_dedup, op10_near_join, op11_conversation_trie, op12_exact_topk, op13_spelling_variants)}

ORACLES: dict[str, str] = {"op4_mix_sources": mixing.SQL, "op7_url_reputation": url_reputation.SQL, "op8_quality_rules": quality_rules.SQL, "op9_line_dedup": line_dedup.SQL,
                           "op11_conversation_trie": conversation_trie.SQL, "op12_exact_topk": exact_topk.SQL, "op13_spelling_variants": spelling.SQL}
