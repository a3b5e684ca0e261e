"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_packing, block_max, decontamination, filter_audit, html_main, language_id, line_runs, piece_counts, probminhash, raking, spot_signatures, suffix_dedup, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents"), least=0.8)


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op3_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_packing.pack_corpus(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512).drop("n_parts")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digest(line_runs.dedup_lines(table(spark, sf_dir, "documents"), run=2, lone=50))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op8_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = raking.standard_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.floor(F.col("mix_p") * 1e6 + 0.5137).cast("long").alias("p_micro"), F.col("mix_kept").alias("kept"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.standard_rules(spark))


def op12_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.search(block_max.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_probminhash, op2_spot_signatures, op3_bit_packing, op4_piece_counts, op5_suffix_dedup, op6_line_runs, op7_language_id, op8_raking, op9_decontamination, op10_html_main, op11_url_rules, op12_block_max, op13_filter_audit, pipeline)}
ORACLES: dict[str, str] = {"op6_line_runs": line_runs.SQL, "op8_raking": raking.standard_sql(), "op11_url_rules": url_rules.SQL, "op12_block_max": block_max.SQL, "op13_filter_audit": filter_audit.SQL}
