"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curriculum_mix, edit_counts, filter_audit, hilbert_neighbours, lexicon_toxicity, licence_rules, line_dedup, ngram_jaccard_join, periodic_runs, site_quality, substring_dedup, template_decontam, token_file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_file.write_tokens(table(spark, sf_dir, "documents"), token_file.new_folder(spark))
    return token_file.read_tokens(spark, folder, digests=True).withColumnRenamed("id", "doc_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_neighbours.nearest(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join.link_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = curriculum_mix.readings(table(spark, sf_dir, "documents"))
    same = [F.first(c).alias(c) for c in ("size", "source_size", "target")]
    taken = taken.groupBy(F.col("id").alias("doc_id"), "source", "copy").agg(*same, F.sum("words").alias("taken"), F.min("position").alias("position"))
    return curriculum_mix.in_training_order(taken.drop("source", "copy"), "doc_id")


def op8_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_rules.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edit_counts.redacted_counts(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "tokens_before", "tokens_after", "n_edits", "bytes_encoded", F.size("leaf_tokens").alias("n_leaves"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_fuzzy_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train_on=lexicon_toxicity.fold() != 0)
    return found.select(F.col("id").alias("doc_id"), (lexicon_toxicity.fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("hits").alias("n_hits"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs(table(spark, sf_dir, "documents"), placed=periodic_runs.repeating_ends)
    return periodic_runs.digests(found).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_decontam": op1_template_decontam,
    "op2_token_file": op2_token_file,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_site_quality": op4_site_quality,
    "op5_hilbert_neighbours": op5_hilbert_neighbours,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_curriculum_mix": op7_curriculum_mix,
    "op8_licence_rules": op8_licence_rules,
    "op9_edit_counts": op9_edit_counts,
    "op10_line_dedup": op10_line_dedup,
    "op11_fuzzy_lexicon": op11_fuzzy_lexicon,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op1_template_decontam": template_decontam.ORACLE_SQL,
    "op7_curriculum_mix": curriculum_mix.ORACLE_SQL,
    "op8_licence_rules": licence_rules.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
