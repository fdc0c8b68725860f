"""Ordering of referrals: how likely a referral is a defect of the label itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running

# Weights of a doubtful reading, an advisory finding and any other referral.
READING, ADVISORY, OTHER = 0.2, 0.55, 0.85
FIELD_ORDER = (
    "brand_name", "class_type", "alcohol_content", "alcohol_format", "proof_consistency", "net_contents", "bottler_name",
    "bottler_address", "country_of_origin", "government_warning", "warning_typography",
)


def chance(verdict: Column, checks: Column) -> Column:
    """The weight of the most serious referred row; null unless the label is referred."""
    weight = lambda c: F.when(c["read_uncertain"], READING).when(c["advisory"], ADVISORY).otherwise(OTHER)
    return F.when(verdict == "flag", F.array_max(F.transform(F.filter(checks, lambda c: c["verdict"] == "flag"), weight)))


def findings(checks: Column, misreads: Column, alterations: Column) -> Column:
    """What a ranking model may see of rows that did not pass: numbers and flags, no label text."""
    every = F.concat(F.coalesce(misreads, F.array().cast("array<string>")), F.coalesce(alterations, F.array().cast("array<string>")))
    segments = lambda kind: F.size(F.filter(every, lambda t: t.startswith(kind)))
    wording = lambda c: (c["field"] == "government_warning") & (c["verdict"] != "pass")

    def one(c: Column) -> Column:
        return F.struct(
            c["field"].alias("field"), c["verdict"].alias("verdict"), c["layer"].alias("layer"), c["advisory"].alias("advisory"),
            c["read_uncertain"].alias("read_uncertain"), (c["source"] == "second_reading").alias("cleared_by_second_reading"),
            F.bround(c["similarity"]).cast("int").alias("similarity_pct"), F.when(c["softened"] == "low_confidence", F.bround(c["confidence"]).cast("int")).alias("read_confidence_pct"),
            F.when(wording(c), segments("missing")).alias("words_missing"), F.when(wording(c), segments("unexpected")).alias("words_unexpected"),
            F.when(wording(c), segments("substituted")).alias("words_substituted"),
        )

    return F.transform(F.filter(checks, lambda c: (c["verdict"] != "pass") | (c["source"] == "second_reading")), one)


def ordered_checks(checks: Column) -> Column:
    """A label's rows: by layer, rejections before referrals before passes, then fields in order."""
    place = F.create_map(*(F.lit(x) for i, f in enumerate(FIELD_ORDER) for x in (f, i)))
    layer = lambda c: F.when(c["layer"] == "application", 0).otherwise(1)
    rank = lambda c: F.when(c["verdict"] == "fail", 0).when(c["verdict"] == "flag", 1).otherwise(2)
    keyed = F.transform(checks, lambda c: F.struct(layer(c).alias("a"), rank(c).alias("b"), F.coalesce(F.try_element_at(place, c["field"]), F.lit(99)).alias("d"), c.alias("row")))
    return F.transform(F.array_sort(keyed), lambda k: k["row"])


def queue_rank(verdict: Column) -> Column:
    return F.when(verdict == "fail", 0).when(verdict == "error", 1).when(verdict == "flag", 2).otherwise(3)


def work_queue(results: DataFrame, position: str = "input_pos") -> DataFrame:
    """Results in the order to work them: rank, chance of a genuine defect, input order."""
    return results.orderBy(queue_rank(F.col("verdict")), F.coalesce("triage_p", F.lit(-1.0)).desc(), position)


def queue_positions(results: DataFrame, batch: str, position: str = "input_pos") -> DataFrame:
    """Places in the queue of each batch, however large a batch is."""
    order = [queue_rank(F.col("verdict")), F.coalesce("triage_p", F.lit(-1.0)).desc(), F.col(position)]
    return running(results, order, [batch], queue_pos=F.lit(1))
