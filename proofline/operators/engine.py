"""The whole review of joined rows: rules, softening, citations and one verdict.

All steps work on one wide row per label; a label's checklist is an array of
structs until the output edge, so nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import citations, quantities, text
from ..schemas import staged
from . import rules

REGULATION = ("alcohol_format", "proof_consistency", "government_warning", "warning_typography")
ABSENCE = ("brand_name", "class_type", "alcohol_content", "net_contents", "bottler_name", "country_of_origin")
# Confidence below which nothing rejects; missing statements that mean an unread image.
LEAST_CONFIDENCE, SEVERAL = 80.0, 2
CHECK = (
    "struct<field:string,verdict:string,expected:string,observed:string,code:string,similarity:double,confidence:double,"
    "softened:string,citation:string,advisory:boolean,layer:string,read_uncertain:boolean,source:string>"
)


def outcome(code: Column, part: int) -> Column:
    """Verdict (0), doubt of the reading (1) or advisory (2) of a code."""
    if part == 0:
        by = {v: [c for c, o in rules.OUTCOME.items() if o[0] == v] for v in ("pass", "flag")}
        return F.when(code.isin(*by["pass"]), "pass").when(code.isin(*by["flag"]), "flag").when(code.isNotNull(), "fail")
    return code.isin(*(c for c, o in rules.OUTCOME.items() if o[part]))


def check(field: str, code: str, expected: Column | None = None, observed: Column | None = None, similar: Column | None = None) -> Column:
    """One checklist row from the code column; null where the code is null."""
    c, none = F.col(code), F.lit(None).cast("string")
    row = F.struct(
        F.lit(field).alias("field"), outcome(c, 0).alias("verdict"), (none if expected is None else expected.cast("string")).alias("expected"),
        (none if observed is None else observed.cast("string")).alias("observed"), c.alias("code"),
        (F.lit(None).cast("double") if similar is None else similar).alias("similarity"), F.lit(None).cast("double").alias("confidence"),
        none.alias("softened"), none.alias("citation"), outcome(c, 2).alias("advisory"), F.lit("application").alias("layer"),
        outcome(c, 1).alias("read_uncertain"), F.lit("ocr").alias("source"),
    )
    return F.when(c.isNotNull(), row)


def updated(c: Column, **new: Column) -> Column:
    return F.struct(*((new[f] if f in new else c[f]).alias(f) for f in ("field", "verdict", "expected", "observed", "code", "similarity", "confidence", "softened", "citation", "advisory", "layer", "read_uncertain", "source")))


def referred(c: Column, why: Column | str, where: Column) -> Column:
    """The row with a rejection made a referral, and a referral marked as doubt of the reading."""
    why = F.lit(why) if isinstance(why, str) else why
    touched = where & ((c["verdict"] == "fail") | ((c["verdict"] == "flag") & ~c["read_uncertain"]))
    return F.when(touched, updated(c, verdict=F.lit("flag"), read_uncertain=F.lit(True), softened=why)).otherwise(c)


def missing_statements(checks: Column) -> Column:
    """The fields of statements that reject because nothing was read."""
    gone = F.filter(checks, lambda c: (c["verdict"] == "fail") & c["observed"].isNull() & c["field"].isin(*ABSENCE, "government_warning"))
    return F.array_distinct(F.transform(gone, lambda c: c["field"]))


def soften_several_missing(checks: Column, names: Column | None = None) -> Column:
    """Several statements missing at once: the image was not read in full.

    names: ``missing_statements`` as a column, so that it is not worked out for each row again.
    """
    names = missing_statements(checks) if names is None else names
    many = F.size(names) >= SEVERAL
    return F.transform(checks, lambda c: referred(c, "several_missing", many & c["observed"].isNull() & (F.array_contains(names, c["field"]) | (c["field"] == "bottler_address"))))


def soften_unconfirmed(checks: Column, unread: Column, small_print_unread: Column) -> Column:
    """A missing statement may be in the part of the label that was not read."""
    part = rules.yes(F.size(unread) > 0) | rules.yes(small_print_unread)
    return F.transform(checks, lambda c: referred(c, "part_unread", part & c["observed"].isNull() & c["field"].isin(*ABSENCE, "bottler_address")))


def soften_unreliable(checks: Column, confidence: Column, soft: Column) -> Column:
    """Nothing read from a soft image, or below the confidence floor, rejects."""
    known = F.coalesce(confidence, F.create_map().cast("map<string,double>"))

    def one(c: Column) -> Column:
        conf = F.try_element_at(known, c["field"])
        low = rules.yes(conf < LEAST_CONFIDENCE)
        blurred = rules.yes(soft) & (c["verdict"] == "fail")
        out = referred(c, F.when(blurred, "soft_image").otherwise("low_confidence"), blurred | low)
        return updated(out, confidence=conf)

    return F.transform(checks, one)


def cited(checks: Column, commodity: Column) -> Column:
    """Each row's section and the question it answers."""

    def one(c: Column) -> Column:
        warning = F.when(c["code"].isin("warning_heading_misread", "warning_heading_case"), "27 CFR 16.22(a)(2)").when(c["field"] == "government_warning", "27 CFR 16.21")
        small = F.when(c["code"] == "type_small", "27 CFR 16.22(b)").when(c["field"] == "warning_typography", "27 CFR 16.22(a)(2) and (b)")
        return updated(c, citation=F.coalesce(citations.citation(c["field"], commodity), warning, small), layer=F.when(c["field"].isin(*REGULATION), "regulation").otherwise("application"))

    return F.transform(checks, one)


def softened(rows: DataFrame, of: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """Adds ``why_<field>``: what makes a referral of a field's row, as ``soften_several_missing``, ``soften_unconfirmed`` and ``soften_unreliable`` do in turn.

    of: code column and observed value by field. A row that one step touched is closed to
    the later ones, so the first that applies decides and no array is built.
    """
    verdict = {f: outcome(F.col(code), 0) for f, (code, _) in of.items()}
    unseen = {f: F.lit(True) if seen is None else seen.isNull() for f, (_, seen) in of.items()}
    rows = rows.withColumns({f"gone_{f}": rules.yes((verdict[f] == "fail") & unseen[f]) for f in (*ABSENCE, "government_warning")})
    several = reduce(lambda a, b: a + b, (F.col(f"gone_{f}").cast("int") for f in (*ABSENCE, "government_warning"))) >= SEVERAL
    part = rules.yes(F.size("obs_unread") > 0) | rules.yes(F.col("obs_legibility") == "illegible")
    rows = rows.withColumns({"several": several, "part": part})

    def why(f: str) -> Column:
        code = F.col(of[f][0])
        open_ = (verdict[f] == "fail") | ((verdict[f] == "flag") & ~outcome(code, 1))
        low = rules.yes(F.try_element_at("obs_confidence", F.lit(f)) < LEAST_CONFIDENCE)
        step = F.when(rules.yes(F.col("obs_soft")) & (verdict[f] == "fail"), "soft_image").when(low, "low_confidence")
        if f in (*ABSENCE, "bottler_address"):
            step = F.when(F.col("part") & unseen[f], "part_unread").otherwise(step)
        if f == "bottler_address":
            step = F.when(F.col("several") & unseen[f], "several_missing").otherwise(step)
        elif f in (*ABSENCE, "government_warning"):
            step = F.when(F.col("several") & F.col(f"gone_{f}"), "several_missing").otherwise(step)
        return F.when(rules.yes(open_), step)

    return rows.withColumns({f"why_{f}": why(f) for f in of})


def decided_check(field: str, code: str, expected: Column | None, observed: Column | None, similar: Column | None, commodity: Column) -> Column:
    """One checklist row in its last form, from the code column and ``why_<field>``; null where the code is null."""
    c, why, none = F.col(code), F.col(f"why_{field}"), F.lit(None).cast("string")
    section = citations.citation_of(field, commodity)
    if field == "government_warning":
        section = F.when(c.isin("warning_heading_misread", "warning_heading_case"), "27 CFR 16.22(a)(2)").otherwise("27 CFR 16.21")
    elif field == "warning_typography":
        section = F.when(c == "type_small", "27 CFR 16.22(b)").otherwise("27 CFR 16.22(a)(2) and (b)")
    row = F.struct(
        F.lit(field).alias("field"), F.when(why.isNotNull(), "flag").otherwise(outcome(c, 0)).alias("verdict"), (none if expected is None else expected.cast("string")).alias("expected"),
        (none if observed is None else observed.cast("string")).alias("observed"), c.alias("code"), (F.lit(None).cast("double") if similar is None else similar).alias("similarity"),
        F.try_element_at("obs_confidence", F.lit(field)).alias("confidence"), why.alias("softened"), section.alias("citation"), outcome(c, 2).alias("advisory"),
        F.lit("regulation" if field in REGULATION else "application").alias("layer"), (why.isNotNull() | outcome(c, 1)).alias("read_uncertain"), F.lit("ocr").alias("source"),
    )
    return F.when(c.isNotNull(), row)


def verdict_of(checks: Column) -> Column:
    """The worst binding row; advisory rows raise to a referral at most."""
    return F.when(F.exists(checks, lambda c: (c["verdict"] == "fail") & ~c["advisory"]), "fail").when(F.exists(checks, lambda c: c["verdict"] == "flag"), "flag").otherwise("pass")


def verdict_of_codes(codes: dict[str, str], low: dict[str, Column], soft: Column) -> Column:
    """The verdict that ``soften_unreliable`` and ``verdict_of`` give, from code columns by field; no row is built.

    low: of fields with a confidence, whether it is below the floor.
    """
    hard, some = [], []
    for field, code in codes.items():
        verdict = outcome(F.col(code), 0)
        sure = ~rules.yes(low[field]) if field in low else F.lit(True)
        hard.append(rules.yes((verdict == "fail") & ~outcome(F.col(code), 2)) & ~rules.yes(soft) & sure)
        some.append(rules.yes(verdict != "pass"))
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    return F.when(any_of(hard), "fail").when(any_of(some), "flag").otherwise("pass")


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, their columns computed once.

    Spark merges neighbouring projections; an array that a later lambda refers to
    would be built again for each of its elements. A generator of one row keeps them apart.
    """
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("row")).select("row.*")


def coded(rows: DataFrame) -> DataFrame:
    """Joined rows (``exp_*``, ``obs_*``) with brand, klass, how, commodity, scores and the code of each rule."""
    rows = settled(rules.scored(settled(rules.brand_and_class(rules.application_parts(rows)))))
    rows = rows.withColumns({"commodity": F.coalesce("exp_kind", citations.commodity_of(F.col("klass"))), "obs_ml": quantities.volume_ml(F.col("obs_net"))})
    rows = settled(rules.warning_parts(rules.alcohol_parts(settled(rows))))
    codes = {
        "brand": rules.brand_code, "class": rules.class_code, "alcohol": rules.alcohol_code, "format": rules.format_code, "proof": rules.proof_code,
        "net": rules.net_code, "bottler": rules.bottler_code, "address": rules.address_code, "country": rules.country_code,
        "warning": rules.warning_code, "type": rules.type_code,
    }
    return settled(rows.withColumns({f"code_{n}": f() for n, f in codes.items()}))


def observed_values() -> dict[str, Column]:
    """What the checklist row of a code shows as observed."""
    c = F.col
    given = lambda name: F.when(c(name) != "", c(name))
    own = {"brand": F.when(c("how") != "unread", given("brand")), "class": given("klass"), "warning": c("said"), **{n: c("obs_alcohol") for n in ("alcohol", "format", "proof")}}
    return own | {n: given(f"obs_{n}") for n in ("net", "bottler", "address", "country")}


def checked(rows: DataFrame) -> DataFrame:
    """Coded rows with checks and verdict."""
    c, s, seen = F.col, F.col("score"), observed_values()
    percent = F.when(c("exp_percent").isNotNull(), F.concat(c("exp_percent").cast("string"), F.lit("% Alc./Vol.")))
    # Rows for fields the application leaves out come before compared ones.
    rows = rows.withColumns({"code_bottler": F.coalesce("code_bottler", F.lit("not_provided")), "code_address": F.coalesce("code_address", F.lit("not_provided"))})
    swap = (c("code_address") == "not_provided") & (c("code_bottler") != "not_provided")
    #: field: (code, expected, similarity)
    of = {
        "brand_name": ("brand", c("exp_brand"), s["brand"]),
        "class_type": ("class", c("exp_class"), s["klass"]),
        "alcohol_content": ("alcohol", percent, None),
        "alcohol_format": ("format", None, None),
        "proof_consistency": ("proof", None, None),
        "net_contents": ("net", c("exp_net"), None),
        "bottler_name": ("bottler", c("exp_bottler"), s["maker"]),
        "bottler_address": ("address", c("exp_address"), s["address"]),
        "country_of_origin": ("country", c("exp_country"), s["country"]),
        "government_warning": ("warning", F.lit(text.STATEMENT), None),
        "warning_typography": ("type", None, None),
    }
    rows = softened(rows, {f: (f"code_{code}", seen.get(code)) for f, (code, _, _) in of.items()})
    row = {f: decided_check(f, f"code_{code}", want, seen.get(code), similar, c("commodity")) for f, (code, want, similar) in of.items()}
    name, place = row["bottler_name"], row["bottler_address"]
    row |= {"bottler_name": F.when(swap, place).otherwise(name), "bottler_address": F.when(swap, name).otherwise(place)}
    rows = settled(rows.withColumn("checks", F.array_compact(F.array(*row.values()))))
    return rows.withColumn("verdict", verdict_of(c("checks")))


def review(rows: DataFrame) -> DataFrame:
    """Joined rows (``exp_*``, ``obs_*``) with brand, klass, how, commodity, checks and verdict."""
    keep = rows.columns
    rows = checked(coded(rows))
    container = quantities.minimum_type_mm(F.coalesce("exp_ml", "obs_ml"))
    rows = rows.withColumns({"minimum_type_mm": container, "warning_misreads": F.col("differences.misread"), "warning_alterations": F.col("differences.altered")})
    return rows.select(*keep, "brand", "klass", "how", "commodity", "checks", "verdict", "minimum_type_mm", "warning_alterations", "warning_misreads")


#: What codes follow from: the columns that their rules look at, the codes, and whether the commodity counts as well.
LOOKS = {
    "names": (("exp_brand", "exp_class", "obs_brand", "obs_class", "obs_class_next"), ("brand", "class"), False),
    "alcohol": (("exp_percent", "obs_alcohol"), ("alcohol", "format", "proof"), True),
    "net": (("exp_net", "obs_net"), ("net",), True),
    "maker": (("exp_bottler", "exp_address", "obs_bottler", "obs_address"), ("bottler", "address"), False),
    "country": (("exp_country", "obs_country"), ("country",), False),
    "warning": (("obs_warning", "obs_legibility", "obs_unsure"), ("warning",), False),
}
#: All that verdicts, and checklist rows without their texts and numbers, follow from.
ALIKE = (*(f"code_{c}" for _, codes, _ in LOOKS.values() for c in codes), *(f"seen_{c}" for _, codes, _ in LOOKS.values() for c in codes), "code_type", "commodity", "illegible", "soft", "unread", "low")


def looked_at(rows: DataFrame, *keep: str) -> DataFrame:
    """Joined rows with what the rules look at and the columns ``keep``, for ``by_looks``: all else goes."""
    low = F.map_keys(F.map_filter("obs_confidence", lambda k, v: v < LEAST_CONFIDENCE))
    flags = {
        "code_type": rules.type_code(), "illegible": rules.yes(F.col("obs_legibility") == "illegible"), "soft": rules.yes(F.col("obs_soft")),
        "unread": rules.yes(F.size("obs_unread") > 0), "low": F.coalesce(F.array_join(F.array_sort(low), ","), F.lit("")),
    }
    return rows.select(*keep, *(c for columns, _, _ in LOOKS.values() for c in columns), *(c.alias(n) for n, c in flags.items()))


def by_looks(rows: DataFrame, folder: str, but: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``looked_at`` with the columns ``ALIKE``: a rule runs once for all rows that are the same to it.

    rows are read seven times, so they should lie in a table. The different looks are written
    below ``folder``; Spark sends them to the tasks while they are few, else it deals them out.
    but: looks whose codes the rows have already, instead of the columns.
    """
    asked = {name: look for name, look in LOOKS.items() if name not in but}
    any_kind = F.explode(F.array(*(F.lit(k) for k in citations.WORDS), F.lit(None).cast("string")))
    looks = []
    for name, (columns, _, by_kind) in asked.items():
        one = rows.select(*columns).distinct()
        looks.append((one.withColumn("kind", any_kind) if by_kind else one).withColumn("look", F.lit(name)))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), looks)
    kind = F.coalesce("kind", citations.commodity_of(F.col("exp_class")))
    every = every.withColumns({"exp_kind": kind, "obs_small_type": F.lit(None).cast("boolean"), "obs_bold": F.lit(None).cast("boolean")})
    every = every.withColumns({c: F.lit(None).cast("array<string>" if c == "obs_unsure" else "string") for name in but for c in LOOKS[name][0]})
    done = coded(every).withColumns({f"seen_{n}": v.isNotNull() for n, v in observed_values().items()})
    known = done.select("look", "kind", "commodity", *dict.fromkeys(c for columns, _, _ in LOOKS.values() for c in columns), *(a for a in ALIKE if a.startswith(("code_", "seen_")) and a != "code_type"))
    known.write.partitionBy("look").parquet(folder)
    known = rows.sparkSession.read.schema(known.schema).parquet(folder)
    for name, (columns, codes, by_kind) in asked.items():
        new = [*(f"code_{c}" for c in codes), *(f"seen_{c}" for c in codes), *(["commodity"] if name == "names" else [])]
        one = known.filter(F.col("look") == name).select(*(F.col(c).alias(f"look_{c}") for c in columns), *(["kind"] if by_kind else []), *new)
        same = [F.col(c).eqNullSafe(F.col(f"look_{c}")) for c in columns] + ([F.col("commodity").eqNullSafe(F.col("kind"))] if by_kind else [])
        rows = rows.join(one, reduce(lambda a, b: a & b, same)).drop(*(f"look_{c}" for c in columns), "kind")
    return rows


def checked_alike(rows: DataFrame) -> DataFrame:
    """Rows with the columns ``ALIKE`` as ``checked`` makes them; texts, similarities and confidences of checklist rows are not the label's own."""
    none = lambda kind: F.lit(None).cast(kind)
    read = {"brand": "brand", "klass": "class", "said": "warning", **{f"obs_{n}": n for n in ("alcohol", "net", "bottler", "address", "country")}}
    own = {c: F.when(F.col(f"seen_{n}"), "read") for c, n in read.items()}
    low = F.filter(F.split("low", ","), lambda f: f != "")
    own |= {f"exp_{n}": none("double" if n == "percent" else "string") for n in ("brand", "class", "percent", "net", "bottler", "address", "country")}
    own |= {
        "how": F.lit(""), "score": F.struct(*(none("double").alias(n) for n in ("brand", "klass", "maker", "address", "country"))), "obs_soft": F.col("soft"), "obs_unread": F.when(F.col("unread"), F.array(F.lit("read"))),
        "obs_legibility": F.when(F.col("illegible"), "illegible"), "obs_confidence": F.map_from_arrays(low, F.transform(low, lambda f: F.lit(0.0))),
    }
    kept = rows.columns
    return checked(rows.withColumns(own)).select(*kept, "checks", "verdict")


def review_counts(rows: DataFrame, folder: str) -> DataFrame:
    """Joined rows counted by what their review gives: checks (as ``checked_alike``), verdict, commodity, n."""
    rows = staged(looked_at(rows), f"{folder}/rows")
    counts = by_looks(rows, f"{folder}/looks").groupBy(*ALIKE).agg(F.count("*").alias("n"))
    return checked_alike(staged(counts, f"{folder}/counts")).select("commodity", "checks", "verdict", "n")
