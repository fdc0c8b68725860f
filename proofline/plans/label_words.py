"""Whole labels as word boxes, dealt over ``orders``, and what is to be read of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STATEMENT
from .cases import rows_sql

_S = STATEMENT.split()
_WARNING = [" ".join(_S[i : i + 9]) for i in range(0, len(_S), 9)]


def _warning(top: int, height: int = 14, conf: float = 92, lines: list[str] = _WARNING) -> list[tuple]:
    return [(t, top + i * (height + 6), height, conf) for i, t in enumerate(lines)]


_TOP = [("OLD TOM", 20, 60, 95), ("Kentucky Straight Bourbon Whiskey", 110, 30, 90)]
_MIDDLE = [("45% Alc./Vol. (90 Proof)", 500, 20, 91), ("750 mL", 540, 20, 90), ("Bottled by Old Tom Distilling Co., Bardstown, Kentucky", 580, 20, 88), ("Product of Scotland", 620, 20, 87)]
#: name: lines (text, top, height, confidence); a word may carry its own confidence behind a bar.
LABELS = {
    "whole": _TOP + _MIDDLE + _warning(660),
    "misread heading": _TOP + _MIDDLE + _warning(660, lines=["GOVERNMEMT WARNIMG: " + _WARNING[0].split(": ")[1], *_WARNING[1:]]),
    "ornament": _TOP + _MIDDLE + _warning(660, lines=["** " + _WARNING[0], *_WARNING[1:]]),
    "text after": _TOP + _MIDDLE + _warning(660) + [("Please recycle this bottle", 790, 14, 90)],
    "tall line after": _TOP + _MIDDLE + _warning(660, lines=_WARNING[:3]) + [("VISIT OUR CELLARS", 725, 40, 90)],
    "small type": _TOP + _MIDDLE + _warning(660, height=10),
    "faint warning": _TOP + _MIDDLE + _warning(660, conf=70),
    "words in doubt": _TOP + _MIDDLE + _warning(660, lines=[_WARNING[0].replace("women", "wcmen|45"), *_WARNING[1:]]),
    "unit in doubt": _TOP + [_MIDDLE[0], ("750 mL|10", 540, 20, 90), *_MIDDLE[2:]] + _warning(660),
    "no dominant line": [("Old Tom", 20, 22, 95), ("Kentucky Straight Bourbon Whiskey", 110, 20, 90)] + _MIDDLE + _warning(660),
    "few words": [("OLD TOM", 20, 60, 95), ("750 mL", 540, 20, 90)],
    "two line brand": [("GREAT", 20, 60, 95), ("NORTHERN", 85, 58, 94), ("Small Batch", 170, 30, 90), ("London Dry Gin", 210, 28, 90)] + _MIDDLE + _warning(660),
    "maker by place": _TOP + _MIDDLE[:2] + [("Old Tom Distilling", 580, 20, 90), ("Bardstown Kentucky", 610, 20, 90), ("Imported from Ireland", 640, 20, 87)] + _warning(680),
    "unread line": _TOP + _MIDDLE + [("qx vv smudged", 645, 12, 40)] + _warning(670),
    "no warning": _TOP + _MIDDLE,
    "warning unread": _TOP + _MIDDLE + [("tiny|5 print|8 below|9", 700, 6, 8)],
    "blank": [("speck|-1", 10, 5, -1)],
}
_COPY = STATEMENT
_FULL = ("OLD TOM", "Kentucky Straight Bourbon Whiskey", None, "45% Alc./Vol. (90 Proof)", "750 mL", "Bottled by Old Tom Distilling Co.", "Bardstown, Kentucky", "Product of Scotland")
#: brand, class, its next line, alcohol, net, bottler, address, country, statement, legibility, small type, degraded, unsure words, unread lines, brand confidence, notes, error
EXPECTED = {
    "whole": (*_FULL, _COPY, "read", False, False, "", "", 95.0, "", None),
    "misread heading": (*_FULL, "GOVERNMEMT WARNIMG: " + _COPY.split(": ", 1)[1], "read", False, False, "", "", 95.0, "", None),
    "ornament": (*_FULL, _COPY, "read", False, False, "", "", 95.0, "", None),
    "text after": (*_FULL, _COPY, "read", False, False, "", "", 95.0, "", None),
    "tall line after": (*_FULL, " ".join(_S[:27]), "read", False, False, "", "", 95.0, "", None),
    "small type": (*_FULL, _COPY, "illegible", True, False, "", "", 95.0, "small_print_unread", None),
    "faint warning": (*_FULL, _COPY, "illegible", False, False, "", "", 95.0, "small_print_unread", None),
    "words in doubt": (*_FULL, _COPY.replace("women", "wcmen"), "read", False, False, "wcmen", "", 95.0, "", None),
    "unit in doubt": (*_FULL, _COPY, "read", False, False, "", "", 95.0, "", None),
    "no dominant line": (None, *_FULL[1:], _COPY, "read", False, True, "", "", 0.0, "no_dominant_brand", None),
    "few words": (None, None, None, None, "750 mL", "OLD TOM", None, None, None, "illegible", False, True, "", "", 0.0, "few_words", None),
    "two line brand": ("GREAT NORTHERN", "Small Batch", "London Dry Gin", *_FULL[3:], _COPY, "read", False, False, "", "", 95.0, "", None),
    "maker by place": (*_FULL[:5], "Old Tom Distilling", "Bardstown Kentucky", "Imported from Ireland", _COPY, "read", False, False, "", "", 95.0, "", None),
    "unread line": (*_FULL, _COPY, "read", False, False, "", "qx vv smudged", 95.0, "", None),
    "no warning": (*_FULL, None, "absent", False, False, "", "", 95.0, "", None),
    "warning unread": (*_FULL, None, "illegible", False, False, "", "", 95.0, "small_print_unread", None),
    "blank": (None,) * 9 + ("absent", False, False, "", "", None, "", "no_words"),
}
COLUMNS = (
    "brand_name", "class_type", "class_type_next", "alcohol_statement", "net_contents", "bottler_name", "bottler_address", "country_of_origin", "warning_text",
    "warning_legibility", "warning_small_type", "degraded", "unsure", "unread", "brand_conf", "notes", "error",
)


def _boxes() -> list[tuple]:
    out = []
    for k, lines in enumerate(LABELS.values()):
        for n, (text, top, height, conf) in enumerate(lines):
            left = 40
            for w in text.split():
                w, _, own = w.partition("|")
                width = 10 * len(w)
                out.append((k, n, w, left, top, width, height, float(own or conf), (8 if w.strip(":").isupper() and len(w) > 6 else 5) * width, 10 * width))
                left += width + 12
    return out


def boxes_sql() -> str:
    """The labels' word boxes as a relation of constants, for both engines."""
    return rows_sql(_boxes(), ("k", "line_num", "text", "left0", "top", "width", "height", "conf", "ink_dark", "ink_area"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word table: the label of each order."""
    boxes = spark.sql(f"SELECT * FROM {boxes_sql()}").withColumnRenamed("left0", "left")
    boxes = boxes.withColumns({"conf": F.col("conf").cast("double"), "block_num": F.lit(1), "par_num": F.lit(1)})
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("image_id"), (F.col("o_orderkey") % len(LABELS)).cast("int").alias("k"))
    return orders.join(F.broadcast(boxes), "k")  # a few hundred rows


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").cast("string").alias("image_id"), F.lit(1000).alias("image_height"), F.lit(80.0).alias("sharpness"))
