"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortide.llm import (conversation_repair, decontaminate, license_scan, line_crf, mixing,
                           ngram_join, periodic_runs, quality_rules, simhash_vp, substring_dedup,
                           token_files, toxicity, url_filter)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark, folder):
    return substring_dedup.digest(substring_dedup.dedup_substrings(
        table(spark, folder, "documents")))


def op2_quality_rules(spark, folder):
    return quality_rules.document_rules(table(spark, folder, "documents")).drop(
        "n_left", "clean_text")


def op3_decontamination(spark, folder):
    return decontaminate.digest(decontaminate.benchmark_hits(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op4_token_files(spark, folder):
    return token_files.token_digest(table(spark, folder, "documents"))


def op5_license_scan(spark, folder):
    return license_scan.digest(license_scan.license_spans(table(spark, folder, "documents")))


def op6_toxicity(spark, folder):
    return toxicity.score_toxicity(table(spark, folder, "documents"),
                                   table(spark, folder, "labels"))


def op7_url_filter(spark, folder):
    return url_filter.judge(table(spark, folder, "pages"))


def op8_line_crf(spark, folder):
    return line_crf.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_ngram_join(spark, folder):
    return ngram_join.similarity_components(table(spark, folder, "documents"))


def op10_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).drop("source", "place")


def op11_periodic_runs(spark, folder):
    return periodic_runs.digest(periodic_runs.periodic_runs(
        table(spark, folder, "documents"), reorder=periodic_runs.planted))


def op12_conversation_repair(spark, folder):
    conversations = table(spark, folder, "conversations")
    return conversation_repair.repair_all(conversations, conversation_repair.damage(conversations))


def op13_simhash_vp(spark, folder):
    return simhash_vp.near_components(table(spark, folder, "documents"))


def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries():
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_decontamination": op3_decontamination,
        "op4_token_files": op4_token_files,
        "op5_license_scan": op5_license_scan,
        "op6_toxicity": op6_toxicity,
        "op7_url_filter": op7_url_filter,
        "op8_line_crf": op8_line_crf,
        "op9_ngram_join": op9_ngram_join,
        "op10_mixing": op10_mixing,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_simhash_vp": op13_simhash_vp,
        "pipeline": pipeline,
    }


def oracle_sql():
    return {"op2_quality_rules": quality_rules.ORACLE}
