"""Verdicts against known truth: accuracy, harm, confusion, latency, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import VERDICTS
from .running import running

SCORED = ("brand_name", "class_type", "alcohol_statement", "net_contents", "warning_text", "warning_prefix_is_bold")


def outcome_class(expected: Column, actual: Column) -> Column:
    """What a verdict costs: nothing, a minute, an unfinished job, or harm."""
    return (
        F.when(expected == actual, "correct").when(actual.isin("pass", "fail"), "unsafe").when((actual == "flag") & (expected == "pass"), "cautious")
        .when((actual == "flag") & (expected == "fail"), "referred").otherwise("unsafe")
    )


def outcomes(truth: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Truth joined with results (verdict, checks, error): one outcome a label."""
    names = lambda test: F.transform(F.filter("checks", test), lambda c: c["field"])
    none = F.array().cast("array<string>")
    df = truth.join(results, key)
    return df.withColumns({
        "expected": F.col("expected_verdict"), "actual": F.coalesce(F.when(F.col("error").isNotNull(), "error"), F.col("verdict")),
        "failing": F.coalesce(names(lambda c: c["verdict"] != "pass"), none),
        "wrong_fails": F.coalesce(F.array_except(names(lambda c: c["verdict"] == "fail"), "expected_failing_fields"), none),
    }).withColumn("right_reason", F.size(F.array_except("expected_failing_fields", "failing")) == 0)


def field_hits(observed: DataFrame, truth: DataFrame, key: str = "id", fields: tuple[str, ...] = SCORED) -> DataFrame:
    """(field, hits, n, accuracy): exact after trimming; two nulls agree."""
    wide = lambda df, side: df.select(key, *(F.trim(F.col(f).cast("string")).alias(f"{side}_{f}") for f in fields))
    both = wide(truth, "want").join(wide(observed, "got"), key)
    one = both.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"want_{f}").eqNullSafe(F.col(f"got_{f}"))).alias(f) for f in fields))
    return one.unpivot(["n"], list(fields), "field", "hits").filter("n > 0").select("field", "hits", "n", (F.col("hits") / F.col("n")).alias("accuracy"))


def _correct() -> Column:
    return (F.col("error").isNull() & (F.col("expected") == F.col("actual"))).cast("int")


def accuracy(df: DataFrame) -> DataFrame:
    """Overall (fixture_set null) and by set."""
    return df.rollup("fixture_set").agg(F.count("*").alias("n"), F.sum(_correct()).alias("n_correct")).withColumn("accuracy", F.col("n_correct") / F.col("n"))


def outcome_counts(df: DataFrame) -> DataFrame:
    """Counts by class; an outcome may be cautious and unsafe at once."""
    kind = outcome_class(F.col("expected"), F.col("actual"))
    n = lambda test: F.sum(test.cast("int"))
    harm = F.col("error").isNotNull() | (F.size("wrong_fails") > 0) | (kind == "unsafe")
    return df.agg(F.count("*").alias("n"), n(kind == "correct").alias("correct"), n(kind == "cautious").alias("cautious"), n(kind == "referred").alias("referred"), n(harm).alias("unsafe"))


def confusion(df: DataFrame) -> DataFrame:
    """Expected against actual with all cells, errors left out."""
    spark = df.sparkSession
    all_ = spark.createDataFrame([(v,) for v in VERDICTS], "expected string")
    cells = df.filter("error IS NULL").groupBy("expected").pivot("actual", list(VERDICTS)).count()
    return all_.join(cells, "expected", "left").na.fill(0, list(VERDICTS))


def latency(df: DataFrame, percents: tuple[int, ...] = (50, 95, 99, 100)) -> DataFrame:
    """Nearest-rank percentiles with half-even rounding, from counts by value."""
    counts = df.filter("error IS NULL").groupBy("total_ms").agg(F.count("*").alias("n"))
    total = F.lit(df.filter("error IS NULL").count())
    ranked = running(counts, [F.col("total_ms")], [], upto=F.col("n")).withColumn("total", total)
    place = lambda p: F.least(F.bround(F.lit(p / 100) * (F.col("total") - 1)), F.col("total") - 1)
    return ranked.agg(*(F.min(F.when(F.col("upto") > place(p), F.col("total_ms"))).alias("p_max" if p == 100 else f"p{p}") for p in percents))


def throughput(df: DataFrame, wall_clock_s: float, batch: int = 300) -> DataFrame:
    rate = F.when(F.lit(wall_clock_s) > 0, F.count("*") / F.lit(wall_clock_s) * 60).otherwise(0.0)
    return df.agg(rate.alias("per_minute"), (F.lit(batch) / rate).alias("batch_minutes"))


def reading_cost(df: DataFrame) -> DataFrame:
    """Second readings: consulted, cleared, cost in total and a consulted label, the slowest."""
    called = F.col("second_reading_called")
    cost = F.when(called, F.col("cost_usd"))
    return df.agg(
        F.sum(called.cast("int")).alias("consulted"), F.sum((F.size("cleared") > 0).cast("int")).alias("with_cleared"), F.sum(cost).alias("cost_total"),
        F.avg(cost).alias("cost_mean"), F.max(F.when(called, F.col("total_ms"))).alias("slowest_ms"),
        F.max_by("id", F.when(called, F.struct("total_ms", "id"))).alias("slowest_id"),
    )


def separation(df: DataFrame) -> DataFrame:
    """Share of (genuine, noise) referral pairs in the right order, and ties.

    Counted from running sums over the distinct scores, not from pairs.
    """
    scored = df.filter((F.col("actual") == "flag") & F.col("triage_p").isNotNull())
    by_p = scored.groupBy("triage_p").agg(F.sum((F.col("expected") != "pass").cast("bigint")).alias("g"), F.sum((F.col("expected") == "pass").cast("bigint")).alias("n"))
    run = running(by_p, [F.col("triage_p")], [], upto=F.col("n")).withColumn("n_below", F.col("upto") - F.col("n"))
    s = lambda c: F.sum(c)
    pairs = (s("g") * s("n")).cast("double")
    lowest, highest = F.min(F.when(F.col("g") > 0, F.col("triage_p"))), F.max(F.when(F.col("n") > 0, F.col("triage_p")))
    return run.agg(s("g").alias("genuine"), s("n").alias("noise"), F.try_divide(s(F.col("g") * F.col("n_below")).cast("double"), pairs).alias("ordered"), F.try_divide(s(F.col("g") * F.col("n")).cast("double"), pairs).alias("tied"), (lowest > highest).alias("separated"))


def stress(df: DataFrame, verdicts: tuple[str, ...] = (*VERDICTS, "unreadable")) -> DataFrame:
    """Degradation against verdict, with a row of totals (degradation null)."""
    n = [F.sum((F.col("verdict") == v).cast("int")).alias(v) for v in verdicts]
    return df.rollup("degradation").agg(*n)


def compliant(truth: DataFrame) -> DataFrame:
    """Labels that should pass and are not photographs already."""
    return truth.filter((F.col("expected_verdict") == "pass") & ~F.col("id").startswith("photo_"))


def gate(df: DataFrame, tuned_set: str, harm_limit: int = 0, floor: float = 0.8) -> DataFrame:
    """One row: harmful outcomes, accuracy on the tuned set, and whether the run is refused."""
    harm = F.col("error").isNotNull() | (F.size("wrong_fails") > 0) | (outcome_class(F.col("expected"), F.col("actual")) == "unsafe")
    tuned = F.col("fixture_set") == tuned_set
    share = F.sum(F.when(tuned, _correct())) / F.sum(tuned.cast("int"))
    one = df.agg(F.sum(harm.cast("int")).alias("harmful"), share.alias("tuned_accuracy"))
    return one.withColumn("refused", (F.col("harmful") > harm_limit) | (F.col("tuned_accuracy") < floor))
