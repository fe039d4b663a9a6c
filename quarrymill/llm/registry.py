"""Queries of this subpackage, and the SQL that checks them."""

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm import bpe, exact_dedup, language_model, line_dedup, mixing, quality_classifier, quality_rules, simhash, toxicity, url_filter



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op5_quality": quality_classifier.op5_quality,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_lm_scores": language_model.op7_lm_scores,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLE_SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
