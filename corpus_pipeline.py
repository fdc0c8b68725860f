"""A training corpus from ``documents``: five stages, each on all that the one before kept.

1. quality: documents that the rules reject go.
2. near_dups: of each group of near copies (five-word shingles, similarity 0.8) the one
   with the smallest doc_id stays; of rows with one doc_id, or none, the first.
3. decontaminate: documents that hold a benchmark window go.
4. pii: personal data in the texts is replaced by its kind; ``n_chars`` follows.
5. pack: what is left becomes training sequences of at most 2048 tokens.

Rows are told apart by number, never by doc_id: rows of one id, or of none, stand for
themselves. A null or empty text has no words, so the first stage rejects it; repeated
rows are near copies of each other, and the first stays. An empty table gives no rows,
an empty benchmark contaminates none. Other columns go through untouched up to the last
stage, whatever their names. A long text is held whole by one task in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import numbered, remove, shared_dir, stage, without
from proofline.llm.decontamination import find_contamination
from proofline.llm.entries import bpe, table
from proofline.llm.near_dups import link
from proofline.llm.packing import pack
from proofline.llm.pii import redact
from proofline.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are linked and removed by number, so equal or null ids neither hold nor lose other rows."""
    rows, no = numbered(docs)
    linked = link(rows.select(F.col(no).alias("doc_id"), "text"), size=5, percent=80)
    linked = stage(linked.select(F.col("doc_id").alias("gone"), "component_id"), f"{shared_dir(spark)}/linked")
    named = linked.join(rows.select(F.col(no).alias("gone"), "doc_id"), "gone")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "gone"))
    kept = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.gone").alias("gone"))
    return without(rows, no, linked.select("gone").join(kept, "gone", "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, no = numbered(docs)
    found = find_contamination(rows.select(F.col(no).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, no, found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("gone")))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, bpe(), end_id=1, window=2048)


STAGES = [("quality", quality_rules), ("near_dups", near_dups), ("decontaminate", decontaminate), ("pii", pii), ("pack", packing)]

#: The suffix sorting, the redaction and the packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; between stages the documents are written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, f) in enumerate(STAGES[:-1]):
        docs = stage(f(spark, docs, sf_dir), f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
