"""Forms that keep work in proportion to what differs, and spread it."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from proofline.functions import similarity, text
from proofline.operators import engine, evaluation, rules
from proofline.plans import cases
from proofline.sources import records, sinks


def test_truth_file_may_hold_a_list(spark, tmp_path):
    body = '[{"id": "a", "expected_verdict": "pass"}, {"id": "b", "expected_verdict": "fail"}]'
    files = spark.createDataFrame([("ai/1.truth.json", body.encode()), ("ai/2.truth.json", b'{"id": "c"}')], "name string, body binary")
    folder = sinks.write_files(files, f"file://{tmp_path}")
    got = records.read_truth(spark, f"{folder}/ai").select("id", "fixture_set", "expected_verdict").collect()
    assert sorted(map(tuple, got), key=str) == [("a", "ai", "pass"), ("b", "ai", "fail"), ("c", "ai", None)]


@pytest.mark.parametrize("name,image", [("a.tsv", "a"), ("a.b.tsv", "a.b"), ("plain", "plain")])
def test_image_is_named_by_its_file(spark, tmp_path, name, image):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / name).write_text(head + "5\t1\t1\t1\t1\t1\t0\t0\t1\t1\t90\tgin\n")
    words = records.read_words(spark, str(tmp_path))
    assert [r["image_id"] for r in words.collect()] == [image]
    assert "regexp_extract" not in words._jdf.queryExecution().optimizedPlan().toString()


def test_field_hits_shuffle_a_label_once(spark):
    t = spark.createDataFrame([(1, "a ", None), (2, "b", "x"), (2, "b", "y")], "id int, brand string, net string")
    o = spark.createDataFrame([(1, "a", None), (2, "c", "x"), (3, "d", "z")], "id int, brand string, net string")
    got = evaluation.field_hits(o, t, fields=("brand", "net"))
    assert sorted((r["field"], r["hits"], r["n"]) for r in got.collect()) == [("brand", 1, 3), ("net", 2, 3)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("Join"), "fields are listed from the counts, not from every label"
    assert evaluation.field_hits(o.limit(0), t, fields=("brand", "net")).collect() == []


def test_a_pair_is_scored_once_a_worker():
    for one in similarity.KINDS.values():
        one.cache_clear()
        assert one("old tom", "old tim x") == one("old tom", "old tim x")
        assert (one.cache_info().misses, one.cache_info().hits) == (1, 1)


def test_cases_are_dealt_to_all_cores(spark):
    assert cases.labels(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_softening_by_columns_equals_the_steps(spark):
    codes = {"brand_name": ["brand_missing", "brand_same"], "net_contents": ["net_missing", "net_form", "net_odd_size"], "bottler_address": ["address_missing", "address_same"], "government_warning": ["warning_missing", "warning_exact"]}
    rows = [(*c, unread, legible, conf, soft) for c in product(*codes.values()) for unread in ([], ["x"]) for legible in ("read", "illegible") for conf in (None, {"net_contents": 70.0}) for soft in (True, False)]
    names = [f"c_{f}" for f in codes]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", obs_unread array<string>, obs_legibility string, obs_confidence map<string,double>, obs_soft boolean")
    seen = {f: F.when(~F.col(f"c_{f}").endswith("_missing"), "x") for f in codes}
    of = {f: (f"c_{f}", seen.get(f)) for f in codes}
    for f in engine.ABSENCE:
        of.setdefault(f, ("none", None))
    got = engine.softened(df.withColumn("none", F.lit(None).cast("string")), of)
    checks = F.array(*(engine.check(f, f"c_{f}", None, seen[f]) for f in codes))
    checks = engine.soften_several_missing(checks)
    checks = engine.soften_unconfirmed(checks, F.col("obs_unread"), F.col("obs_legibility") == "illegible")
    checks = engine.soften_unreliable(checks, F.col("obs_confidence"), F.col("obs_soft"))
    for r in got.withColumn("checks", checks).collect():
        assert [r[f"why_{f}"] for f in codes] == [c["softened"] for c in r["checks"]], r


def test_plain_statements_are_left_as_they_are(spark):
    odd = ["a-\nb", "a- b", " a", "a ", "a  b", "a\u00a0b", "be\u00adv", "x - y", "a\n", "", text.STATEMENT, "GOVERNMENT WARNING:  (1) x", "government warning (1)"]
    df = spark.createDataFrame([(t,) for t in odd], "t string").withColumn("u", text.unwrapped(F.col("t")))
    want = ["ab", "ab", "a", "a", "a b", "a b", "bev", "x - y", "a", "", text.STATEMENT, "GOVERNMENT WARNING: (1) x", "government warning (1)"]
    got = df.select("u", text.body_of(F.col("u")).alias("b"), F.array_join(text.letters(F.col("u")), " ").alias("l"), text.lettered(F.col("u")).alias("s"), text.heading_of(F.col("u")).alias("h")).collect()
    assert [r["u"] for r in got] == want
    assert [r["b"] for r in got][-3:] == [text.BODY, "(1) x", "(1)"]
    assert [r["l"] for r in got] == [r["s"] for r in got]
    assert [r["h"] for r in got][-3:] == [text.HEADING, text.HEADING, "government warning"]


def test_application_parts_before_the_join_are_kept(spark):
    a = spark.createDataFrame([("The Old Tom", "Stout", "1 PINT", "Bottled by Old Tom Co.", "Reno, Nevada", "Product of Scotland")], "brand_name string, class_type string, net_contents string, bottler_name string, bottler_address string, country_of_origin string")
    r = rules.application_parts(a, {"brand": "brand_name", "class": "class_type", "net": "net_contents", "bottler": "bottler_name", "address": "bottler_address", "country": "country_of_origin"})
    got = r.first()
    assert (got["exp_f_brand"], got["exp_kind"], got["exp_f_maker"], got["exp_own_maker"], got["exp_f_country"]) == ("old tom", "malt", "old tom co", "old tom", "scotland")
    assert rules.application_parts(r).columns == r.columns
