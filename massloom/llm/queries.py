"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.minhash import MinHash, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), MinHash(shingle_words=3, percent=85))


def op4_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.substrings import removed_report

    return removed_report(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from massloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.quality import quality

    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(_table(spark, sf_dir, "documents"), good)


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.lines import line_report

    return line_report(_table(spark, sf_dir, "documents"))


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.licenses import known_licenses, license_scan

    return license_scan(_table(spark, sf_dir, "documents"), known_licenses(spark))


def op8_language_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.langid import language

    return language(_table(spark, sf_dir, "documents"))


def op9_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.brown import language_model

    return language_model(_table(spark, sf_dir, "documents"))


def op10_decontaminate_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.decontam import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op11_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from massloom.llm.spelling import corpus_words, spelling_variants

    return spelling_variants(corpus_words(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_minhash_near_dedup, op2_toxicity_nnpu, op3_quality_llr, op4_substring_automata, op5_best_fit_packing, op6_fuzzy_line_dedup, op7_license_digests, op8_language_bigru, op9_brown_scores, op10_decontaminate_index, op11_block_top_k, op12_vector_codes, op13_spelling_variants)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from massloom.llm import sql
    from massloom.llm.licenses import license_sql

    return {
        "op1_minhash_near_dedup": sql.NEAR_DUPLICATES,
        "op4_substring_automata": sql.SUBSTRINGS,
        "op7_license_digests": license_sql(),
        "op10_decontaminate_index": sql.CONTAMINATION,
        "op11_block_top_k": sql.TOP_K,
        "op12_vector_codes": sql.vector_codes(),
        "op13_spelling_variants": sql.spelling_variants(),
    }
