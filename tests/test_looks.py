"""Labels counted by what the rules look at: as the whole review gives them, each look worked out once."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators import engine, second_reading
from proofline.plans import cases

PARTS = ("field", "verdict", "code", "softened", "citation", "advisory", "layer", "read_uncertain")


def test_counts_equal_the_review_of_every_label(spark, tmp_path):
    rows = cases.labels(spark, "/root/testdata/sf0.001").limit(200)
    soft = F.col("o_orderkey") % 3 == 0
    rows = rows.withColumns({"obs_soft": soft, "obs_unread": F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("TL"))), "obs_confidence": F.when(soft, F.create_map(F.lit("net_contents"), F.lit(70.0), F.lit("brand_name"), F.lit(90.0)))})
    rows.write.parquet(f"{tmp_path}/labels")
    rows = spark.read.parquet(f"{tmp_path}/labels")
    own = lambda df: df.select("commodity", "verdict", F.transform("checks", lambda c: F.struct(*(c[p] for p in PARTS))).alias("checks"), "n")
    listed = lambda df: sorted((repr(r[:3]), r[3]) for r in own(df).groupBy("commodity", "verdict", "checks").agg(F.sum("n")).collect())
    want = listed(engine.review(rows).withColumn("n", F.lit(1)))
    assert listed(engine.review_counts(rows, f"{tmp_path}/once")) == want
    engine.review_counts(rows.union(rows), f"{tmp_path}/twice")
    looks = [spark.read.parquet(f"{tmp_path}/{n}/looks").count() for n in ("once", "twice")]
    assert looks[0] == looks[1], "the rules run once for labels that are the same to them"


def test_counts_of_second_readings_equal_those_of_every_label(spark, tmp_path):
    rows = cases.labels(spark, "/root/testdata/sf0.001").limit(200)
    soft = F.col("o_orderkey") % 3 == 0
    rows = rows.withColumns({"obs_soft": soft, "obs_confidence": F.create_map(F.lit("net_contents"), F.when(soft, 70.0).otherwise(90.0), F.lit("brand_name"), F.lit(75.0)), "digest": F.col("o_orderkey").cast("string")})
    rows.write.parquet(f"{tmp_path}/labels")
    rows = spark.read.parquet(f"{tmp_path}/labels")
    text = {"brand_name": "exp_brand", "net_contents": "exp_net", "class_type": "obs_brand"}
    again = [rows.select("digest", F.lit(f).alias("field"), F.col(c).alias("value"), F.lit(None).cast("boolean").alias("value_bool")) for f, c in text.items()]
    again.append(rows.select("digest", F.lit("warning_prefix_is_bold").alias("field"), F.lit(None).cast("string").alias("value"), (F.col("o_orderkey") % 2 == 0).alias("value_bool")))
    readings = reduce(DataFrame.unionByName, again).filter("digest % 5 <> 0")
    by = ["was", "verdict", "cleared", "adopted"]
    listed = lambda df: sorted((repr(r[:4]), r[4]) for r in df.groupBy(*by).agg(F.sum("n")).collect())
    reviewed = engine.review(rows).withColumn("was", F.col("verdict"))
    got = listed(second_reading.apply_counts(rows, readings, f"{tmp_path}/counted"))
    assert got == listed(second_reading.apply(reviewed, readings).withColumn("n", F.lit(1)))
    assert any("net_contents" in r for r, _ in got)
    assert not {"obs_warning", "checks"} & set(spark.read.parquet(f"{tmp_path}/counted/asked").columns), "a label goes to its readings without its statement and its checklist"
