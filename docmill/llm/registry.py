"""The queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.chat import format_conversations, format_digests
from docmill.llm.codes import ORACLE_SQL as CODES_SQL
from docmill.llm.codes import code_report
from docmill.llm.decontaminate import benchmark_overlaps
from docmill.llm.divergence import ORACLE_SQL as DIVERGENCE_SQL
from docmill.llm.divergence import source_divergence
from docmill.llm.language import language_report
from docmill.llm.media import media_report
from docmill.llm.mixing import ORACLE_SQL as MIXING_SQL
from docmill.llm.mixing import mix_sources
from docmill.llm.near_dedup import near_duplicate_classes
from docmill.llm.passages import repeated_passages
from docmill.llm.secrets import secret_report
from docmill.llm.sharding import shard_report
from docmill.llm.toxicity import toxicity_report
from docmill.llm.urls import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("host_words"), "score")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = r"(-7L, 0L, 'user', r'\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok')"
    added = spark.sql(f"SELECT * FROM VALUES {extra} AS t(conv_id, turn, role, text)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_digests(format_conversations(rows.union(added)))


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_media_chunks": op10_media_chunks,
        "op11_source_divergence": op11_source_divergence,
        "op12_sharding": op12_sharding,
        "op13_vector_codes": op13_vector_codes,
        "op1_language_id": op1_language_id,
        "op2_url_filter": op2_url_filter,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_mixing": op4_mixing,
        "op5_secret_scan": op5_secret_scan,
        "op6_toxicity": op6_toxicity,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_compact_windows": op8_compact_windows,
        "op9_chat_format": op9_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": MIXING_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op13_vector_codes": CODES_SQL}
