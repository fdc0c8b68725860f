"""Cases of the field rules, one Spark job for all."""

import pytest
from pyspark.sql import functions as F

from proofline import schemas
from proofline.functions.text import STATEMENT
from proofline.operators import engine, second_reading, triage

GOOD_APP = dict(brand_name="Old Tom Distillery", class_type="Kentucky Straight Bourbon Whiskey", alcohol_content_pct=45.0, net_contents="750 mL", bottler_name="Old Tom Distilling Co.", bottler_address="Bardstown, Kentucky", country_of_origin="Product of the United States")
GOOD_OBS = dict(brand_name="OLD TOM DISTILLERY", class_type="Kentucky Straight Bourbon Whiskey", alcohol_statement="45% Alc./Vol. (90 Proof)", net_contents="750 mL", bottler_name="Old Tom Distilling Co.", bottler_address="Bardstown, KY", country_of_origin="Product of the United States", warning_text=STATEMENT, warning_prefix_is_bold=True)

#: name: (application changes, reading changes, field, code, label verdict)
CASES = {
    "all right": ({}, {}, "brand_name", "brand_same", "pass"),
    "accents": ({"brand_name": "Château Élan"}, {"brand_name": "CHATEAU ELAN"}, "brand_name", "brand_same", "pass"),
    "one letter": ({"brand_name": "Buffalo Trace"}, {"brand_name": "BUFFALO GRACE"}, "brand_name", "brand_similar", "flag"),
    "part of brand": ({}, {"brand_name": "OLD TOM", "class_type": "Bourbon"}, "brand_name", "brand_partial", "flag"),
    "other brand": ({}, {"brand_name": "Copper Ridge"}, "brand_name", "brand_other", "fail"),
    "two lines": ({}, {"brand_name": "OLD TOM", "class_type": "DISTILLERY", "class_type_next": "Kentucky Straight Bourbon Whiskey"}, "brand_name", "brand_same", "pass"),
    "wrapped class": ({}, {"class_type": "Kentucky Straight", "class_type_next": "Bourbon Whiskey"}, "class_type", "class_same", "pass"),
    "class as brand": ({}, {"brand_name": "Kentucky Straight Bourbon Whiskey", "class_type": None}, "brand_name", "brand_unread", "flag"),
    "class contained": ({"class_type": "Dry Gin"}, {"class_type": "Gin"}, "class_type", "class_contains", "flag"),
    "percent differs": ({}, {"alcohol_statement": "40% Alc./Vol."}, "alcohol_content", "alcohol_other", "fail"),
    "not possible": ({}, {"alcohol_statement": "495% Alc./Vol. (90 Proof)"}, "alcohol_content", "alcohol_implausible", "flag"),
    "decimal lost": ({"alcohol_content_pct": 6.5, "class_type": "India Pale Ale", "net_contents": "12 FL OZ"}, {"class_type": "India Pale Ale", "net_contents": "12 FL OZ", "alcohol_statement": "65% Alc./Vol."}, "alcohol_content", "alcohol_decimal", "flag"),
    "comma": ({"alcohol_content_pct": 40.5}, {"alcohol_statement": "40,5% vol alc"}, "alcohol_content", "alcohol_same", "pass"),
    "wrong proof": ({}, {"alcohol_statement": "45% Alc./Vol. (80 Proof)"}, "proof_consistency", "proof_other", "fail"),
    "beer without statement": ({"class_type": "Lager", "net_contents": "12 FL OZ"}, {"class_type": "Lager", "net_contents": "12 FL OZ", "alcohol_statement": None}, "alcohol_content", "alcohol_optional", "flag"),
    "compound": ({"class_type": "Stout", "net_contents": "22 FL OZ"}, {"class_type": "Stout", "net_contents": "1 PINT 6 FL OZ"}, "net_contents", "net_same", "pass"),
    "wrong unit": ({"net_contents": "75 cl"}, {"net_contents": "75 cl"}, "net_contents", "net_form", "flag"),
    "odd size": ({}, {"net_contents": "790 mL"}, "net_contents", "net_odd_size", "flag"),
    "not provided": ({"net_contents": None}, {}, "net_contents", "not_provided", "pass"),
    "bottler generic words": ({"bottler_name": "ABC Distilling Company"}, {"bottler_name": "XYZ Distilling Company"}, "bottler_name", "bottler_other", "fail"),
    "bottler phrase": ({}, {"bottler_name": "Distilled and Bottled by Old Tom Distilling Co."}, "bottler_name", "bottler_same", "pass"),
    "address read as name": ({}, {"bottler_name": "Bardstown, Kentucky"}, "bottler_name", "bottler_is_address", "flag"),
    "import missing": ({"country_of_origin": "Product of Scotland"}, {"country_of_origin": None}, "country_of_origin", "country_missing", "fail"),
    "near country": ({"country_of_origin": "Product of Austria"}, {"country_of_origin": "Product of Australia"}, "country_of_origin", "country_similar", "flag"),
    "misread domestic": ({}, {"country_of_origin": "Product of the United Stafes"}, "country_of_origin", "country_domestic", "pass"),
    "heading case": ({}, {"warning_text": STATEMENT.replace("GOVERNMENT WARNING", "Government Warning")}, "government_warning", "warning_heading_case", "fail"),
    "heading misread": ({}, {"warning_text": STATEMENT.replace("GOVERNMENT", "GOvERNMENT")}, "government_warning", "warning_heading_misread", "flag"),
    "line wrap": ({}, {"warning_text": STATEMENT.replace("beverages during", "bever-\nages during")}, "government_warning", "warning_exact", "pass"),
    "not dropped": ({}, {"warning_text": STATEMENT.replace("should not drink", "should drink")}, "government_warning", "warning_altered", "fail"),
    "near miss": ({}, {"warning_text": STATEMENT.replace("birth", "bnth")}, "government_warning", "warning_misread", "flag"),
    "other word": ({}, {"warning_text": STATEMENT.replace("women", "people everywhere")}, "government_warning", "warning_altered", "fail"),
    "text after": ({}, {"warning_text": STATEMENT + " Please recycle"}, "government_warning", "warning_trailing", "flag"),
    "no warning": ({}, {"warning_text": None}, "government_warning", "warning_missing", "fail"),
    "illegible": ({}, {"warning_text": None, "warning_legibility": "illegible"}, "government_warning", "warning_illegible", "flag"),
    "small type": ({}, {"warning_small_type": True}, "warning_typography", "type_small", "flag"),
    "soft image": ({}, {"net_contents": "500 mL", "image_soft": True}, "net_contents", "net_other", "flag"),
    "low confidence": ({}, {"net_contents": "500 mL", "field_confidence": {"net_contents": 60.0}}, "net_contents", "net_other", "flag"),
    "several missing": ({}, {"net_contents": None, "alcohol_statement": None}, "net_contents", "net_missing", "flag"),
    "unread text": ({}, {"net_contents": None, "unread_text": ["TL"]}, "net_contents", "net_missing", "flag"),
    "one missing": ({}, {"net_contents": None}, "net_contents", "net_missing", "fail"),
}


@pytest.fixture(scope="module")
def reviewed(spark):
    apps, obs = [], []
    for name, (a, o, *_) in CASES.items():
        apps.append({**GOOD_APP, **a, "cola_id": name})
        obs.append({**GOOD_OBS, **o, "cola_id": name})
    make = lambda rows, schema: spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    types = lambda text: spark.createDataFrame([], text).schema
    return engine.review(schemas.joined(make(apps, types(schemas.APPLICATION)), make(obs, types(schemas.OBSERVATION))).withColumn("digest", F.col("cola_id"))).cache()


def test_cases(reviewed):
    got = {r.cola_id: r for r in reviewed.collect()}
    wrong = {}
    for name, (_, _, field, code, verdict) in CASES.items():
        row = next(c for c in got[name].checks if c.field == field)
        if (row.code, got[name].verdict) != (code, verdict):
            wrong[name] = (row.code, got[name].verdict)
    assert not wrong


def test_rows_in_order_with_citations(reviewed):
    row = reviewed.filter("cola_id = 'all right'").first()
    assert [c.field for c in row.checks][:4] == ["brand_name", "class_type", "alcohol_content", "alcohol_format"]
    assert all(c.citation for c in row.checks)
    assert {c.field for c in row.checks if c.layer == "regulation"} == set(engine.REGULATION)


def test_triage_never_changes_a_verdict(reviewed):
    rows = reviewed.select("verdict", triage.chance(F.col("verdict"), F.col("checks")).alias("p")).collect()
    assert all((r.p is not None) == (r.verdict == "flag") for r in rows)
    assert {r.p for r in rows if r.p is not None} <= {0.2, 0.55, 0.85}


def test_second_reading_clears_and_never_rejects(spark, reviewed):
    readings = spark.createDataFrame([("odd size", "net_contents", " 750  mL ", None), ("low confidence", "net_contents", "500 mL", None), ("near miss", "warning_text", STATEMENT, None), ("several missing", "net_contents", "x" * 300, None)], "digest string, field string, value string, value_bool boolean")
    got = {r.cola_id: r for r in second_reading.apply(reviewed, readings).collect()}
    assert len(got) == len(CASES)
    assert got["odd size"].verdict == "pass" and got["odd size"].cleared == ["net_contents"]
    assert got["low confidence"].verdict == "flag" and got["near miss"].verdict == "flag" and got["several missing"].verdict == "flag"
    before = {r.cola_id: r.verdict for r in reviewed.collect()}
    assert all(r.verdict != "fail" or before[k] == "fail" for k, r in got.items())


def test_sanitized_readings_takes_whole_texts(spark, tmp_path):
    """A page whose first 700 characters collapse to under 600 is too long as a whole."""
    from proofline.plans import queries

    page = "a " * 100 + " " * 490 + "b" * 590
    spark.createDataFrame([(0, page), (3, "short  page")], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, "a brand\n" + "x" * 201), (6, "w" * 601 + "\n" + "w" * 600), (9, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.sanitized_readings(spark, str(tmp_path)).collect()
    assert sorted((r.field, r.n, r.chars) for r in got) == [("brand_name", 1, 7), ("warning_text", 2, 610)]
