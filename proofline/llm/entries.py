"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, sql
from .decontamination import find_contamination, report
from .lines import dedup_lines
from .near_dups import link
from .packing import pack
from .passages import dedup_passages
from .pii import find_pii
from .quality import quality
from .spelling import group_spellings
from .suffixes import dedup_substrings
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), size=200).drop("ranges")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), bpe(), end_id=0))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, :own AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)", args={"own": own})
    return chat.report(chat.format_chats(turns.unionByName(more)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("n_covered", "longest_repeat")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), bpe(), end_id=1, window=2048)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), bpe(), limit=1024)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents"), size=50).drop("ranges")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), most=16)


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), least=20, least_docs=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_near_dups": op2_near_dups,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_files": op4_token_files,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_passages": op10_passages,
    "op11_whitening": op11_whitening,
    "op12_spellings": op12_spellings,
    "op13_line_dedup": op13_line_dedup,
}
SQL: dict[str, str] = {
    "op1_decontamination": sql.contamination(),
    "op2_near_dups": sql.near_dups(),
    "op5_chat": sql.chats(),
    "op6_quality": sql.quality(),
    "op10_passages": sql.passages(),
    "op12_spellings": sql.spellings(),
    "op13_line_dedup": sql.line_dedup(),
}
