"""One query for each operator, over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, decontamination, jaccard, katz, language_id, line_dedup, packing, periodic_runs, quality, secret_scan,
               sharding, substring_dedup, token_counts)
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


def op2_suffix_array_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_lines=2)
    return out.select("doc_id", "n_lines", "n_removed",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), threshold=80, size=5)


def op5_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs, sample=4000))


def op6_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op7_suffix_tree_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), length=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), limit=2048)


def op9_random_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), sample=20_000)


def op10_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op11_periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs.periodic_runs(periodic_runs.with_repeats(table(spark, sf_dir, "documents")), least=6, times=4)
    best = periodic_runs.most_repeated(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (runs.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op12_katz_backoff_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return katz.score_documents(table(spark, sf_dir, "documents"), held_out, order=2, cutoff=5).scores


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))[0]


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_suffix_array_line_dedup, op3_winnowing_decontamination,
                                   op4_ngram_jaccard_join, op5_hierarchical_language_id, op6_lpt_sharding, op7_suffix_tree_substring_dedup, op8_token_counts, op9_random_forest_secret_scan,
                                   op10_weak_supervision_quality, op11_periodic_run_detection,
                                   op12_katz_backoff_scoring, op13_cross_tokenizer_alignment)}
