"""Columns of the library's tables, and the join of applications and readings."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APPLICATION = (
    "cola_id string, brand_name string, class_type string, alcohol_content_pct double, net_contents string, "
    "bottler_name string, bottler_address string, country_of_origin string"
)
OBSERVATION = (
    "cola_id string, brand_name string, class_type string, class_type_next string, alcohol_statement string, net_contents string, "
    "bottler_name string, bottler_address string, country_of_origin string, warning_text string, warning_unsure array<string>, "
    "warning_prefix_is_bold boolean, warning_small_type boolean, warning_legibility string, field_confidence map<string,double>, "
    "notes array<string>, image_soft boolean, unread_text array<string>, field_boxes map<string,array<array<double>>>"
)
VERDICTS = ("pass", "flag", "fail")
UNSPECIFIED = "UNSPECIFIED"

EXPECTED = {"brand_name": "brand", "class_type": "class", "alcohol_content_pct": "percent", "net_contents": "net", "bottler_name": "bottler", "bottler_address": "address", "country_of_origin": "country"}
OBSERVED = {
    "brand_name": "brand", "class_type": "class", "class_type_next": "class_next", "alcohol_statement": "alcohol", "net_contents": "net",
    "bottler_name": "bottler", "bottler_address": "address", "country_of_origin": "country", "warning_text": "warning", "warning_unsure": "unsure",
    "warning_prefix_is_bold": "bold", "warning_small_type": "small_type", "warning_legibility": "legibility", "field_confidence": "confidence",
    "image_soft": "soft", "unread_text": "unread",
}


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with every column of the schema, missing ones null; others stay behind them."""
    want = df.sparkSession.createDataFrame([], schema).schema
    own = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
    return df.select(*own, *(c for c in df.columns if c not in want.names))


def joined(applications: DataFrame, observations: DataFrame, how: str = "inner", hint: str | None = None) -> DataFrame:
    """One wide row for each reading of an application.

    Rows without an id carry the id UNSPECIFIED: no application is meant by it, so
    such rows are left out before the join and cannot become a hot key. Columns of
    applications named ``exp_*`` come along: what is parsed of an application is parsed
    once, before the join. hint: how Spark is to join them, the applications being the
    smaller side; it decides unless given.
    """
    a = conformed(applications, APPLICATION).filter(F.col("cola_id") != UNSPECIFIED)
    o = conformed(observations, OBSERVATION).filter(F.col("cola_id") != UNSPECIFIED)
    exp = a.select("cola_id", *(F.col(k).alias(f"exp_{v}") for k, v in EXPECTED.items()), *(c for c in a.columns if c.startswith("exp_")))
    extra = [c for c in o.columns if c not in OBSERVED and c not in ("cola_id", "notes", "field_boxes")]
    legible = F.coalesce("warning_legibility", F.when(F.coalesce(F.col("warning_text"), F.lit("")) != "", "read").otherwise("absent"))
    obs = o.withColumn("warning_legibility", legible).select("cola_id", *(F.col(k).alias(f"obs_{v}") for k, v in OBSERVED.items()), *extra)
    return (exp.hint(hint) if hint else exp).join(obs, "cola_id", how)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which executors share.

    Unset, it is an error on a cluster; a session on one machine takes a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, where: str) -> DataFrame:
    """``df`` written and read back: a short lineage for loops."""
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
