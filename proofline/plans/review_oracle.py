"""DuckDB SQL of the whole review over the derived tables: a row a check, softened step by step.

Written from the rules. Similarities of the derived names follow from how the
names are made: a name inside another one shares all its letters with it.
"""

from __future__ import annotations

from .oracle import CODED, _commodity, _in

FAIL = (
    "brand_missing", "brand_other", "class_missing", "class_other", "alcohol_missing", "alcohol_other", "proof_other", "net_missing", "net_other",
    "bottler_missing", "bottler_other", "country_missing", "country_other", "warning_missing", "warning_heading_case", "warning_altered",
)
PASS = (
    "not_provided", "brand_same", "class_same", "alcohol_same", "form_permitted", "proof_same", "net_same", "bottler_same", "address_same",
    "country_domestic", "country_same", "warning_exact", "warning_spacing", "warning_body_case", "type_bold",
)
UNSURE = (
    "brand_partial", "brand_unread", "class_fragment", "class_brand_part", "class_uncertain", "alcohol_implausible", "alcohol_proof_agrees", "alcohol_decimal",
    "alcohol_unparsed", "proof_unchecked", "net_unparsed_label", "net_odd_size", "bottler_unread", "bottler_is_address", "country_unread", "warning_illegible",
    "warning_part_legible", "warning_heading_misread", "warning_punctuation", "warning_misread", "type_unknown",
)
ADVISORY = ("not_provided", "form_permitted", "form_other", "country_domestic", "type_small", "type_unknown", "type_bold", "type_regular")
ABSENCE = ("brand_name", "class_type", "alcohol_content", "net_contents", "bottler_name", "country_of_origin")
NAMES = {
    "brand_name": "brand name", "class_type": "class/type", "alcohol_content": "alcohol content", "alcohol_format": "alcohol wording",
    "proof_consistency": "proof statement", "net_contents": "net contents", "bottler_name": "bottler", "bottler_address": "bottler address",
    "country_of_origin": "country of origin", "government_warning": "government warning", "warning_typography": "warning type",
}
SECTIONS = {
    "brand_name": ("4.33", "5.64", "7.64", "", "brand name"), "class_type": ("4.34 and subpart C", "5.63(a)(2) and subpart I", "7.63(a)(2) and 7.141", "", "class and type"),
    "alcohol_content": ("4.36", "5.65", "7.65", "", "alcohol content"), "alcohol_format": ("4.36", "5.65(b)", "7.65", "", "alcohol content statement"),
    "proof_consistency": ("4.36", "5.65", "7.65", "", "alcohol content"), "net_contents": ("4.37", "5.70", "7.70", "", "net contents"),
    "bottler_name": ("4.35", "5.66-5.68", "7.66-7.68", "", "name and address"), "bottler_address": ("4.35", "5.66-5.68", "7.66-7.68", "", "name and address"),
    "country_of_origin": ("4.35(e)", "5.69", "7.69", " and 19 CFR 134.11", "country of origin"),
}

_LAND = "trim(regexp_replace({0}, '(?i)^(product of|made in)( the)? *', ''))"
_HOME = "regexp_matches({0}, '(?i)united states')"
ROWS = f"""
WITH b AS (SELECT row_number() OVER () AS rid, *, (l_orderkey + l_linenumber) % 13 AS m FROM ({CODED})),
c AS (SELECT *,
    CASE WHEN obs_brand IS NULL THEN 'brand_missing' WHEN lower(obs_brand) = lower(exp_brand) THEN 'brand_same'
         WHEN 200.0 * length(exp_brand) / (length(exp_brand) + length(obs_brand)) >= 80 THEN 'brand_similar' ELSE 'brand_contains' END AS code_brand,
    CASE WHEN obs_class IS NULL THEN 'class_missing' ELSE 'class_same' END AS code_class,
    CASE WHEN exp_country IS NULL THEN 'not_provided'
         WHEN {_HOME.format('exp_country')} THEN CASE WHEN obs_country IS NULL OR {_HOME.format('obs_country')} THEN 'country_domestic' ELSE 'country_conflict' END
         WHEN obs_country IS NULL THEN 'country_missing' WHEN obs_country = 'Product of' THEN 'country_unread'
         WHEN lower({_LAND.format('exp_country')}) = lower({_LAND.format('obs_country')}) THEN 'country_same' ELSE 'country_other' END AS code_country,
    CASE WHEN m = 1 AND legibility = 'illegible' THEN 'warning_illegible' WHEN m = 1 THEN 'warning_missing' WHEN m = 3 THEN 'warning_heading_case'
         WHEN m = 4 THEN 'warning_body_case' WHEN m = 6 THEN 'warning_trailing' WHEN m = 7 THEN 'warning_punctuation' ELSE 'warning_exact' END AS code_warning FROM b),
long_ AS (
    SELECT rid, 1 AS ord, 'brand_name' AS field, code_brand AS code, obs_brand IS NULL AS absent, NULL AS conf, legibility, soft, commodity, exp_net FROM c
    UNION ALL SELECT rid, 2, 'class_type', code_class, obs_class IS NULL, NULL, legibility, soft, commodity, exp_net FROM c
    UNION ALL SELECT rid, 3, 'alcohol_content', code_alcohol, obs_alcohol IS NULL, confidence, legibility, soft, commodity, exp_net FROM c
    UNION ALL SELECT rid, 4, 'alcohol_format', code_format, false, NULL, legibility, soft, commodity, exp_net FROM c WHERE code_format IS NOT NULL
    UNION ALL SELECT rid, 5, 'proof_consistency', code_proof, false, NULL, legibility, soft, commodity, exp_net FROM c WHERE code_proof IS NOT NULL
    UNION ALL SELECT rid, 6, 'net_contents', code_net, obs_net IS NULL, confidence, legibility, soft, commodity, exp_net FROM c
    UNION ALL SELECT rid, 7, 'bottler_name', 'bottler_same', false, NULL, legibility, soft, commodity, exp_net FROM c
    UNION ALL SELECT rid, 8, 'bottler_address', 'address_same', false, NULL, legibility, soft, commodity, exp_net FROM c
    UNION ALL SELECT rid, 9, 'country_of_origin', code_country, obs_country IS NULL, NULL, legibility, soft, commodity, exp_net FROM c
    UNION ALL SELECT rid, 10, 'government_warning', code_warning, m = 1, NULL, legibility, soft, commodity, exp_net FROM c
    UNION ALL SELECT rid, 11, 'warning_typography', code_type, true, NULL, legibility, soft, commodity, exp_net FROM c),
s0 AS (SELECT *, CASE WHEN {_in('code', FAIL)} THEN 'fail' WHEN {_in('code', PASS)} THEN 'pass' ELSE 'flag' END AS v0, {_in('code', UNSURE)} AS u0, {_in('code', ADVISORY)} AS advisory FROM long_),
s1 AS (SELECT *, v0 = 'fail' AND absent AND {_in('field', (*ABSENCE, 'government_warning'))} AS gone FROM s0),
s2 AS (SELECT *, gone AND count(*) FILTER (gone) OVER (PARTITION BY rid) >= 2 AS t1 FROM s1),
s3 AS (SELECT *, CASE WHEN t1 THEN 'flag' ELSE v0 END AS v1, u0 OR t1 AS u1 FROM s2),
s4 AS (SELECT *, legibility = 'illegible' AND absent AND {_in('field', ABSENCE)} AND (v1 = 'fail' OR (v1 = 'flag' AND NOT u1)) AS t2 FROM s3),
s5 AS (SELECT *, CASE WHEN t2 THEN 'flag' ELSE v1 END AS v2, u1 OR t2 AS u2 FROM s4),
s6 AS (SELECT *, ((soft AND v2 = 'fail') OR coalesce(conf < 80, false)) AND (v2 = 'fail' OR (v2 = 'flag' AND NOT u2)) AS t3 FROM s5),
s7 AS (SELECT *, CASE WHEN t3 THEN 'flag' ELSE v2 END AS v, u2 OR t3 AS unsure,
       CASE WHEN t3 THEN CASE WHEN soft AND v2 = 'fail' THEN 'soft_image' ELSE 'low_confidence' END WHEN t2 THEN 'part_unread' WHEN t1 THEN 'several_missing' END AS softened FROM s6),
checks AS (SELECT *, CASE WHEN bool_or(v = 'fail' AND NOT advisory) OVER (PARTITION BY rid) THEN 'fail' WHEN bool_or(v = 'flag') OVER (PARTITION BY rid) THEN 'flag' ELSE 'pass' END AS verdict FROM s7)"""

_NAMED = "CASE field " + " ".join(f"WHEN '{f}' THEN '{n}'" for f, n in NAMES.items()) + " END"
_WEIGHT = "CAST(CASE WHEN unsure THEN 0.2 WHEN advisory THEN 0.55 ELSE 0.85 END AS DOUBLE)"


def _cited() -> str:
    out = []
    for f, (wine, spirits, malt, more, subject) in SECTIONS.items():
        for kind, section in (("wine", wine), ("spirits", spirits), ("malt", malt)):
            out.append(f"WHEN field = '{f}' AND commodity = '{kind}' THEN '27 CFR {section}{more} ({subject})'")
        out.append(f"WHEN field = '{f}' THEN '27 CFR {spirits} (spirits), {wine} (wine) or {malt} (malt beverages){more}: {subject}'")
    out.append("WHEN code IN ('warning_heading_misread', 'warning_heading_case') THEN '27 CFR 16.22(a)(2)' WHEN field = 'government_warning' THEN '27 CFR 16.21'")
    out.append("WHEN code = 'type_small' THEN '27 CFR 16.22(b)' ELSE '27 CFR 16.22(a)(2) and (b)'")
    return f"CASE {' '.join(out)} END"


SQL = {
    "review_full": f"{ROWS} SELECT verdict, field, code, v AS row_verdict, softened, count(*) AS n FROM checks GROUP BY ALL",
    "review_citations": f"""{ROWS} SELECT field, commodity, {_cited()} AS citation,
        CASE WHEN field IN ('alcohol_format', 'proof_consistency', 'government_warning', 'warning_typography') THEN 'regulation' ELSE 'application' END AS layer, count(*) AS n FROM checks GROUP BY ALL""",
    "review_queue": f"""{ROWS}, labels AS (SELECT rid, any_value(verdict) AS verdict, CASE WHEN any_value(verdict) = 'flag' THEN max({_WEIGHT}) FILTER (v = 'flag') END AS triage_p,
        coalesce(string_agg({_NAMED} || CASE WHEN v = 'fail' THEN ' (fail)' ELSE ' (review)' END, ', ' ORDER BY ord) FILTER (v <> 'pass'), 'All checks passed') AS findings FROM checks GROUP BY rid)
        SELECT verdict, triage_p, CASE WHEN triage_p >= 0.6 THEN 'The label' WHEN triage_p <= 0.4 THEN 'The image' WHEN triage_p IS NOT NULL THEN 'Unclear' END AS cause, findings, count(*) AS n FROM labels GROUP BY ALL""",
    "review_ordered": f"""{ROWS}, o AS (SELECT rid, string_agg(field, ',' ORDER BY CASE WHEN field IN ('alcohol_format', 'proof_consistency', 'government_warning', 'warning_typography') THEN 1 ELSE 0 END,
        CASE v WHEN 'fail' THEN 0 WHEN 'flag' THEN 1 ELSE 2 END, ord) AS fields FROM checks GROUP BY rid) SELECT fields, count(*) AS n FROM o GROUP BY fields""",
    "asked_fields": f"""{ROWS}, asked AS (SELECT rid, coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (verdict = 'flag' AND v = 'flag' AND unsure AND source IS NOT NULL), '') AS asked FROM (
        SELECT *, CASE WHEN field IN ('alcohol_content', 'alcohol_format', 'proof_consistency') THEN 'alcohol_statement' WHEN field = 'warning_typography' THEN 'warning_prefix_is_bold'
               WHEN field <> 'government_warning' THEN field END AS source FROM checks) GROUP BY rid) SELECT asked, count(*) AS n FROM asked GROUP BY asked""",
    "second_readings": f"""{ROWS}, x AS (SELECT *, field = 'net_contents' AND verdict = 'flag' AND v = 'flag' AND unsure AND exp_net IS NOT NULL
          AND NOT coalesce(commodity IN ('spirits', 'wine') AND NOT regexp_matches(exp_net, '(?i)[0-9] *(ml|l)$'), false) AND NOT coalesce(commodity = 'malt' AND NOT regexp_matches(exp_net, '(?i)(fl oz|gallon)$'), false) AS cleared FROM checks),
        y AS (SELECT rid, any_value(verdict) AS was, bool_or(cleared) AS cleared, bool_or(v = 'fail' AND NOT advisory) AS hard, bool_or(v = 'flag' AND NOT cleared) AS referred FROM x GROUP BY rid)
        SELECT was, CASE WHEN hard THEN 'fail' WHEN referred THEN 'flag' ELSE 'pass' END AS verdict, CASE WHEN cleared THEN 'net_contents' ELSE '' END AS adopted, CASE WHEN cleared THEN 'net_contents' ELSE '' END AS cleared, count(*) AS n FROM y GROUP BY ALL""",
}
