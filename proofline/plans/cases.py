"""Label cases dealt over ``orders``: every order is one label of a case, so the work grows with the table.

A case is what an application says, what a label shows and, for the check alone,
what the rules make of it. Cases reach what the derived tables do not: misread and
altered statements, likenesses, compound volumes, text beyond ASCII, whole labels as
word boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STATEMENT
from ..operators import rules

GOOD = {
    "exp_brand": "Old Tom Distillery", "exp_class": "Kentucky Straight Bourbon Whiskey", "exp_percent": 45.0, "exp_net": "750 mL",
    "exp_bottler": "Old Tom Distilling Co.", "exp_address": "Bardstown, Kentucky", "exp_country": "Product of the United States",
    "obs_brand": "OLD TOM DISTILLERY", "obs_class": "Kentucky Straight Bourbon Whiskey", "obs_class_next": None, "obs_alcohol": "45% Alc./Vol. (90 Proof)",
    "obs_net": "750 mL", "obs_bottler": "Old Tom Distilling Co.", "obs_address": "Bardstown, Kentucky", "obs_country": "Product of the United States",
    "obs_warning": STATEMENT, "obs_unsure": None,
}
_swap = STATEMENT.replace
BEER = {"exp_class": "Stout", "obs_class": "Stout"}
#: name: (changes, field, its code, verdict of the label, alterations, misreads)
CASES = {
    "all right": ({}, "brand_name", "brand_same", "pass", 0, 0),
    "accents": ({"exp_brand": "Château Élan", "obs_brand": "CHATEAU ELAN"}, "brand_name", "brand_same", "pass", 0, 0),
    "sharp s": ({"exp_brand": "Weißer Stein", "obs_brand": "WEISSER STEIN"}, "brand_name", "brand_same", "pass", 0, 0),
    "leading the": ({"exp_brand": "The Old Tom", "obs_brand": "OLD-TOM"}, "brand_name", "brand_same", "pass", 0, 0),
    "one letter": ({"exp_brand": "Buffalo Trace", "obs_brand": "BUFFALO GRACE"}, "brand_name", "brand_similar", "flag", 0, 0),
    "part of brand": ({"obs_brand": "OLD TOM", "obs_class": "Bourbon"}, "brand_name", "brand_partial", "flag", 0, 0),
    "brand and more": ({"exp_brand": "Ardbeg", "obs_brand": "ARDBEG COMMITTEE RELEASE"}, "brand_name", "brand_contains", "flag", 0, 0),
    "other brand": ({"obs_brand": "Copper Ridge"}, "brand_name", "brand_other", "fail", 0, 0),
    "two lines": ({"obs_brand": "OLD TOM", "obs_class": "DISTILLERY", "obs_class_next": "Kentucky Straight Bourbon Whiskey"}, "brand_name", "brand_same", "pass", 0, 0),
    "wrapped class": ({"obs_class": "Kentucky Straight", "obs_class_next": "Bourbon Whiskey"}, "class_type", "class_same", "pass", 0, 0),
    "class as brand": ({"obs_brand": "Kentucky Straight Bourbon Whiskey", "obs_class": None}, "brand_name", "brand_unread", "flag", 0, 0),
    "class fragment": ({"obs_class": "bourbon whi"}, "class_type", "class_fragment", "flag", 0, 0),
    "class contained": ({"exp_class": "Dry Gin", "obs_class": "Gin"}, "class_type", "class_contains", "flag", 0, 0),
    "class near": ({"obs_class": "Kentucky Straight Bourbom Whisky"}, "class_type", "class_similar", "flag", 0, 0),
    "class other": ({"obs_class": "Napa Valley Merlot"}, "class_type", "class_other", "fail", 0, 0),
    "compound": ({**BEER, "exp_net": "22 FL OZ", "obs_net": "1 PINT 6 FL OZ"}, "net_contents", "net_same", "pass", 0, 0),
    "three units": ({**BEER, "exp_net": "1 GALLON 1 QUART 1 PINT", "obs_net": "5204.7 mL"}, "net_contents", "net_form", "flag", 0, 0),
    "fraction": ({**BEER, "exp_net": "1/2 GALLON", "obs_net": "2 QUARTS"}, "net_contents", "net_same", "pass", 0, 0),
    "rising units": ({**BEER, "exp_net": "1 PINT", "obs_net": "1 PINT 1 QUART"}, "net_contents", "net_same", "pass", 0, 0),
    "generic words": ({"exp_bottler": "ABC Distilling Company", "obs_bottler": "XYZ Distilling Company"}, "bottler_name", "bottler_other", "fail", 0, 0),
    "bottler phrase": ({"obs_bottler": "Distilled and Bottled by Old Tom Distilling Co."}, "bottler_name", "bottler_same", "pass", 0, 0),
    "address as name": ({"obs_bottler": "Bardstown, Kentucky"}, "bottler_name", "bottler_is_address", "flag", 0, 0),
    "address in parts": ({"obs_address": "Kentucky Bardstown 40004"}, "bottler_address", "address_same", "pass", 0, 0),
    "address other": ({"obs_address": "Reno, Nevada"}, "bottler_address", "address_other", "flag", 0, 0),
    "near country": ({"exp_country": "Product of Austria", "obs_country": "Product of Australia"}, "country_of_origin", "country_similar", "flag", 0, 0),
    "misread home": ({"obs_country": "Product of the United Stafes"}, "country_of_origin", "country_domestic", "pass", 0, 0),
    "import missing": ({"exp_country": "Product of Scotland", "obs_country": None}, "country_of_origin", "country_missing", "fail", 0, 0),
    "heading misread": ({"obs_warning": _swap("GOVERNMENT", "GOvERNMENT")}, "government_warning", "warning_heading_misread", "flag", 0, 0),
    "soft hyphen": ({"obs_warning": _swap("beverages during", "bev­erages during")}, "government_warning", "warning_exact", "pass", 0, 0),
    "not dropped": ({"obs_warning": _swap("should not drink", "should drink")}, "government_warning", "warning_altered", "fail", 1, 0),
    "not in doubt": ({"obs_warning": _swap("should not drink", "should drink"), "obs_unsure": "nct"}, "government_warning", "warning_misread", "flag", 0, 1),
    "near miss": ({"obs_warning": _swap("birth", "bnth")}, "government_warning", "warning_misread", "flag", 0, 1),
    "speck": ({"obs_warning": _swap("risk of", "risk ee of")}, "government_warning", "warning_misread", "flag", 0, 1),
    "run together": ({"obs_warning": _swap("not drink", "notdrin")}, "government_warning", "warning_misread", "flag", 0, 1),
    "word in doubt": ({"obs_warning": _swap("risk of", "risk Pax of"), "obs_unsure": "Pax"}, "government_warning", "warning_misread", "flag", 0, 1),
    "word added": ({"obs_warning": _swap("risk of", "great risk of")}, "government_warning", "warning_altered", "fail", 1, 0),
    "word swapped": ({"obs_warning": _swap("women", "people everywhere")}, "government_warning", "warning_altered", "fail", 1, 0),
    "four words lost": ({"obs_warning": _swap("because of the risk ", "")}, "government_warning", "warning_misread", "flag", 0, 1),
    "six words lost": ({"obs_warning": _swap("because of the risk of birth ", "")}, "government_warning", "warning_altered", "fail", 1, 0),
    "text after": ({"obs_warning": _swap("birth", "bnth") + " Please recycle"}, "government_warning", "warning_misread", "flag", 0, 2),
}


def literal(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def rows_sql(rows: list[tuple], names: tuple[str, ...]) -> str:
    """A table of fixed rows, in the SQL that Spark and DuckDB share."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({', '.join(names)}))"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined rows, ready for review: the case of each order."""
    rows = [(k, name, *{**GOOD, **c[0]}.values()) for k, (name, c) in enumerate(CASES.items())]
    cases = spark.sql(f"SELECT * FROM {rows_sql(rows, ('k', 'case_name', *GOOD))}")
    cases = cases.withColumns({
        "exp_percent": F.col("exp_percent").cast("double"), "obs_class_next": F.col("obs_class_next").cast("string"), "obs_unsure": F.when(F.col("obs_unsure").isNotNull(), F.array(F.col("obs_unsure").cast("string"))),
        "obs_bold": F.lit(True), "obs_small_type": F.lit(False), "obs_legibility": F.lit("read"), "obs_confidence": F.lit(None).cast("map<string,double>"),
        "obs_soft": F.lit(False), "obs_unread": F.lit(None).cast("array<string>"),
    })
    cases = rules.application_parts(cases)
    # Two numbers a row, dealt to all cores: a small file of orders would be one task, and the review is the work.
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % len(CASES)).cast("int").alias("k"))
    orders = orders.repartition(8 * spark.sparkContext.defaultParallelism)
    return orders.join(F.broadcast(cases), "k").drop("k")  # a row a case


_EXPECTED = rows_sql([(k, name, *c[1:]) for k, (name, c) in enumerate(CASES.items())], ("k", "case_name", "field", "code", "verdict", "altered", "misread"))
SQL = {
    "review_cases": f"SELECT case_name, field, code, verdict, CAST(altered AS BIGINT) AS altered, CAST(misread AS BIGINT) AS misread, count(*) AS n FROM orders JOIN {_EXPECTED} AS e ON o_orderkey % {len(CASES)} = k GROUP BY ALL",
}
