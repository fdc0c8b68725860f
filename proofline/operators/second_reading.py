"""Second readings of referred fields: which to ask for, which to adopt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..schemas import shared_dir, staged
from . import engine
from .rules import type_code

# The observation that each checklist row is computed from; the warning's wording is never read again.
ROW_FIELD = {
    "brand_name": "brand_name", "class_type": "class_type", "alcohol_content": "alcohol_statement", "alcohol_format": "alcohol_statement",
    "proof_consistency": "alcohol_statement", "net_contents": "net_contents", "bottler_name": "bottler_name", "bottler_address": "bottler_address",
    "country_of_origin": "country_of_origin", "warning_typography": "warning_prefix_is_bold",
}
_COLUMN = {"brand_name": "obs_brand", "class_type": "obs_class", "alcohol_statement": "obs_alcohol", "net_contents": "obs_net", "bottler_name": "obs_bottler", "bottler_address": "obs_address", "country_of_origin": "obs_country"}
LONGEST, LONGEST_WARNING = 200, 600


def row_field(field: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in ROW_FIELD.items() for x in kv)), field)


def eligible(checks: Column, verdict: Column) -> Column:
    """Referred rows whose doubt comes from the reading, of referred labels."""
    rows = F.filter(checks, lambda c: (c["verdict"] == "flag") & c["read_uncertain"] & c["field"].isin(*ROW_FIELD))
    return F.when(verdict == "flag", rows).otherwise(F.slice(rows, 1, 0))


def requested_fields(checks: Column, verdict: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(eligible(checks, verdict), lambda c: row_field(c["field"]))))


def sanitized(readings: DataFrame) -> DataFrame:
    """Readings (key, field, value, value_bool) of the right type and a plausible length."""
    value = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    limit = F.when(F.col("field") == "warning_text", LONGEST_WARNING).otherwise(LONGEST)
    bold = F.col("field") == "warning_prefix_is_bold"
    kept = (bold & F.col("value_bool").isNotNull()) | (~bold & trimmed(F.col("value")).isNotNull() & (F.length(value) <= limit))
    return readings.filter(F.coalesce(kept, F.lit(False))).withColumn("value", F.when(~bold, value)).withColumn("value_bool", F.when(bold, F.col("value_bool")))


def rank(verdict: Column) -> Column:
    return F.when(verdict == "pass", 0).when(verdict == "flag", 1).otherwise(2)


def apply(reviewed: DataFrame, readings: DataFrame, key: str = "digest") -> DataFrame:
    """Reviewed rows with adopted readings: checks, verdict, cleared and adopted fields.

    A reading is adopted when all doubtful rows of its field pass on it and no row
    of the field gets worse; a label never becomes rejected by it. Only referred
    labels with a reading go through the rules again.
    """
    clean = _clean(readings, key)
    asked = reviewed.withColumn("asked", requested_fields(F.col("checks"), F.col("verdict")))
    got = F.map_filter(F.coalesce("again", F.create_map().cast("map<string,string>")), lambda k, v: F.array_contains("asked", k))
    # Only rows that ask for something go whole to their readings; of the others the join carries what the caller reads.
    answered = lambda rows, how: rows.join(clean, key, how).withColumn("again", got).withColumn("again_bold", F.when(F.array_contains("asked", "warning_prefix_is_bold"), F.col("again_bold")))
    some = (F.size("again") > 0) | F.col("again_bold").isNotNull()
    own = [c for c in reviewed.columns if c.startswith(("exp_", "obs_"))]
    todo = staged(answered(asked.filter(F.size("asked") > 0), "inner").filter(some), f"{shared_dir(reviewed.sparkSession)}/asked")
    doubtful = F.transform(eligible(F.col("checks"), F.col("verdict")), lambda c: c["field"])
    todo = todo.withColumns({"before": F.col("checks"), "doubtful": doubtful})
    new = {col: F.coalesce(F.try_element_at("again", F.lit(f)), F.col(col)) for f, col in _COLUMN.items()}
    new |= {"obs_bold": F.coalesce("again_bold", "obs_bold"), "obs_confidence": F.map_filter(F.coalesce("obs_confidence", F.create_map().cast("map<string,double>")), lambda k, v: ~F.array_contains("doubtful", k))}
    first = [c for c in reviewed.columns if c not in own]
    kept = todo.select(*(F.col(c) if c in own else F.col(c).alias(f"was_{c}") for c in reviewed.columns), "before", "doubtful", "again", "again_bold")
    again = engine.review(kept.withColumns(new))
    fields = F.concat(F.map_keys("again"), F.when(F.col("again_bold").isNotNull(), F.array(F.lit("warning_prefix_is_bold"))).otherwise(F.array().cast("array<string>")))
    out, cleared = _adopted(again.withColumn("fields", fields))
    back = [F.col(c) if c in own else F.col(f"was_{c}").alias(c) for c in first + own if c not in ("checks", "verdict")]
    changed = out.select(*back, F.col("merged").alias("checks"), engine.verdict_of(F.col("merged")).alias("verdict"), cleared.alias("cleared"), "adopted")
    none = F.array().cast("array<string>")
    same = answered(asked, "left").filter(~some).select(*reviewed.columns, none.alias("cleared"), none.alias("adopted"))
    return changed.unionByName(same)


def _adopted(again: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with ``before``, ``doubtful``, ``fields`` read again and the ``checks`` they give: with ``adopted`` and ``merged``; and the cleared fields."""
    find = lambda rows, f: F.try_element_at(F.filter(rows, lambda c: c["field"] == f), F.lit(1))

    def holds(f: Column) -> Column:
        rows = F.filter("before", lambda b: (row_field(b["field"]) == f) & F.exists("checks", lambda c: c["field"] == b["field"]))
        return F.forall(rows, lambda b: (rank(find("checks", b["field"])["verdict"]) <= rank(b["verdict"])) & (~F.array_contains("doubtful", b["field"]) | (find("checks", b["field"])["verdict"] == "pass")))

    again = engine.settled(again.withColumn("adopted", F.array_sort(F.filter("fields", holds))))

    def merged(b: Column) -> Column:
        new_row = find("checks", b["field"])
        use = new_row.isNotNull() & F.coalesce(F.array_contains("adopted", row_field(b["field"])), F.lit(False))
        return F.when(use, engine.updated(new_row, source=F.lit("second_reading"), read_uncertain=F.lit(False))).otherwise(b)

    out = engine.settled(again.withColumn("merged", F.transform("before", merged)))
    return out, F.transform(F.filter("merged", lambda c: (c["source"] == "second_reading") & (c["verdict"] == "pass") & F.exists("before", lambda b: (b["field"] == c["field"]) & (b["verdict"] != "pass"))), lambda c: c["field"])


def apply_counts(rows: DataFrame, readings: DataFrame, folder: str, key: str = "digest") -> DataFrame:
    """Joined rows (``exp_*``, ``obs_*``) reviewed and read again as ``apply`` does, counted: was, verdict, cleared, adopted, n.

    A rule runs once for labels that are the same to it (``engine.by_looks``). A label's
    checklist follows from what it shares with others, so no row carries one: to its readings
    a label takes what the rules look at, without the statement, which is never read again.
    """
    none = F.array().cast("array<string>")
    texts = [c for name, (columns, _, _) in engine.LOOKS.items() if name != "warning" for c in columns]
    flags = ["code_warning", "seen_warning", "illegible", "soft", "unread"]
    rows = staged(engine.looked_at(rows, key, "obs_bold", "obs_small_type"), f"{folder}/rows")
    first = engine.by_looks(rows, f"{folder}/looks")
    alike = engine.checked_alike(staged(first.groupBy(*engine.ALIKE).agg(F.count("*").alias("n")), f"{folder}/counts"))
    doubtful = F.transform(eligible(F.col("checks"), F.col("verdict")), lambda c: c["field"])
    alike = alike.withColumns({"asked": requested_fields(F.col("checks"), F.col("verdict")), "doubtful": doubtful, "label": F.monotonically_increasing_id()})
    alike = staged(alike.withColumnRenamed("checks", "before"), f"{folder}/alike")
    asks = alike.filter(F.size("asked") > 0).select(*(F.col(c).alias(f"as_{c}") for c in engine.ALIKE), "label", "asked", "doubtful")
    asking = first.join(asks, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"as_{c}")) for c in engine.ALIKE)))
    asking = asking.select(key, "label", "asked", "doubtful", "low", "obs_bold", "obs_small_type", *flags, *texts).join(_clean(readings, key), key)
    again = F.map_filter("again", lambda k, v: F.array_contains("asked", k))
    asking = asking.withColumns({"again": again, "again_bold": F.when(F.array_contains("asked", "warning_prefix_is_bold"), F.col("again_bold"))})
    asking = asking.withColumn("fields", F.array_sort(F.concat(F.map_keys("again"), F.when(F.col("again_bold").isNotNull(), F.array(F.lit("warning_prefix_is_bold"))).otherwise(none)))).filter(F.size("fields") > 0)
    new = {col: F.coalesce(F.try_element_at("again", F.lit(f)), F.col(col)) for f, col in _COLUMN.items()}
    new |= {"obs_bold": F.coalesce("again_bold", "obs_bold"), "low": F.array_join(F.array_except(F.split("low", ","), "doubtful"), ",")}
    second = asking.withColumns(new).withColumn("code_type", type_code()).select("label", "fields", "low", "code_type", *flags, *texts)
    second = engine.by_looks(staged(second, f"{folder}/asked"), f"{folder}/looks_again", but=("warning",))
    second = staged(second.groupBy("label", "fields", *engine.ALIKE).agg(F.count("*").alias("n")), f"{folder}/counts_again")
    known = alike.select("label", F.col("verdict").alias("was"), "before", "doubtful")
    out, cleared = _adopted(engine.checked_alike(second).drop("verdict").join(known, "label"))
    changed = out.select("was", engine.verdict_of(F.col("merged")).alias("verdict"), cleared.alias("cleared"), "adopted", "n")
    left = alike.join(second.groupBy("label").agg(F.sum("n").alias("read")), "label", "left").withColumn("n", F.col("n") - F.coalesce("read", F.lit(0)))
    return changed.unionByName(left.filter("n > 0").select(F.col("verdict").alias("was"), "verdict", none.alias("cleared"), none.alias("adopted"), "n"))


def _clean(readings: DataFrame, key: str) -> DataFrame:
    """One row a key: the readings by field as ``again``, the one of the heading's weight as ``again_bold``."""
    return sanitized(readings).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field", "value")))).alias("again"),
        F.max("value_bool").alias("again_bold"),
    )


def daily_cap(requests: DataFrame, limit: int, paid_before: DataFrame | None = None, spent: DataFrame | None = None) -> DataFrame:
    """Which requests (digest, fields, ts, ok) are paid, cached or refused, in time order.

    A reading that a paid call brought is served again without a call, from then on.
    Of the other requests the first ``limit`` of a day are paid: failed calls count and
    bring nothing. The rest of the day is refused, and a refused request brings nothing
    either. Equal times go by call, then by row.

    What is known on a day depends on what was paid on the days before, so all days are
    worked out at once from a first guess (every success is paid) until nothing changes:
    a day is right once the days before it are. Per day only the first ``limit`` open
    requests of each task are kept, so a busy day is no large group.

    paid_before (key): what is known already; spent (day, n): calls that days have paid.
    """
    key = F.concat_ws("|", "digest", F.array_join(F.array_sort("fields"), ","))
    folder = shared_dir(requests.sparkSession)
    rows = staged(requests.withColumns({"key": key, "day": F.to_date("ts"), "row_id": F.monotonically_increasing_id()}), f"{folder}/rows")
    at = F.struct("ts", "key", "row_id")
    before = Window.partitionBy("key", "day").orderBy("ts", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    given = requests.sparkSession.createDataFrame([], "key string") if paid_before is None else paid_before.select("key").distinct()
    used = requests.sparkSession.createDataFrame([], "day date, n bigint") if spent is None else spent
    rows = rows.join(given.withColumn("given", F.lit(True)), "key", "left").join(used.select("day", F.col("n").alias("used")), "day", "left")
    rows = rows.withColumns({"given": F.coalesce("given", F.lit(False)), "used": F.coalesce("used", F.lit(0))})
    rows = rows.withColumns({"at": at, "again": F.coalesce(F.max(F.col("ok").cast("int")).over(before), F.lit(0)) == 1})
    first_of_day = Window.partitionBy("day").orderBy("ts", "key", "row_id")
    known = staged(rows.filter("ok AND NOT given").groupBy("key").agg(F.min("day").alias("known_day")), f"{folder}/known0")
    step = 0
    while True:
        step += 1
        seen = rows.join(known, "key", "left").withColumn("held", F.col("given") | F.coalesce(F.col("known_day") < F.col("day"), F.lit(False)))
        open_ = seen.filter(~F.col("held") & ~F.col("again")).withColumn("nth", F.row_number().over(first_of_day)).filter(F.col("nth") <= limit - F.col("used"))
        paid = staged(open_.select("row_id", "key", "day", "ok", "at"), f"{folder}/paid{step}")
        new = staged(paid.filter("ok").groupBy("key").agg(F.min("day").alias("known_day")), f"{folder}/known{step}")
        if not new.join(known, ["key", "known_day"], "left_anti").head(1) and not known.join(new, ["key", "known_day"], "left_anti").head(1):
            break
        known = new
    same_day = paid.filter("ok").groupBy("key", "day").agg(F.min("at").alias("brought"))
    done = seen.join(same_day, ["key", "day"], "left").join(paid.select("row_id", F.lit(True).alias("is_paid")), "row_id", "left")
    cached = F.col("held") | F.coalesce(F.col("brought") < F.col("at"), F.lit(False))
    return done.withColumn("outcome", F.when(cached, "cached").when(F.col("is_paid"), "paid").otherwise("refused")).select(*requests.columns, "key", "day", "outcome")
