"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, cover_search, decontaminate, html_extract, lm_score, media, near_dedup, sp_sampling, token_align, token_count, token_shards, toxicity, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{text}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{text}'")
    return chat_format.digest(chat_format.format_conversations(rows.unionByName(probe)))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_columns(media.media_columns(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_sampling.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_token_shards": op2_token_shards,
        "op3_near_dedup": op3_near_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_html_extraction": op5_html_extraction,
        "op6_media_columns": op6_media_columns,
        "op7_toxicity": op7_toxicity,
        "op8_lm_score": op8_lm_score,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_token_counts": op10_token_counts,
        "op11_token_alignment": op11_token_alignment,
        "op12_vector_codes": op12_vector_codes,
        "op13_exact_top_k": op13_exact_top_k,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op4_chat_format": chat_format.ORACLE, "op8_lm_score": lm_score.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_exact_top_k": cover_search.ORACLE}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
