"""DuckDB SQL of the registered queries, written from the rules, not from the Spark code."""

from __future__ import annotations

from . import derived

# Fixed values, written out a second time so that a wrong list elsewhere shows.
COMMODITY_WORDS = {
    "malt": "beer|ale|lager|stout|porter|pilsner|pilsener|ipa|malt beverage|malt liquor|bock|hefeweizen|weissbier|saison|k[oö]lsch|hard seltzer|barley\\s*wine",
    "wine": "wine|champagne|sparkling|cabernet|sauvignon|chardonnay|merlot|pinot|riesling|zinfandel|syrah|shiraz|malbec|ros[eé]|port|sherry|madeira|vermouth|sake|cider|mead|prosecco|cava|grenache|tempranillo|sangiovese|chianti|moscato|muscat|claret",
    "spirits": "whiskey|whisky|bourbon|scotch|rye|vodka|gin|rum|tequila|mezcal|brandy|cognac|armagnac|liqueur|cordial|schnapps|absinthe|grappa|pisco|spirits?|aquavit|soju|shochu|baijiu",
}
FILLS = {
    "spirits": (3750, 3000, 2000, 1800, 1750, 1000, 945, 900, 750, 720, 710, 700, 570, 500, 475, 375, 355, 350, 331, 250, 200, 187, 100, 50),
    "wine": (3000, 2250, 1800, 1500, 1000, 750, 720, 700, 620, 600, 568, 550, 500, 473, 375, 360, 355, 330, 300, 250, 200, 187, 180, 100, 50),
}
GENERIC = (
    "co", "company", "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "distilling", "distillery", "distilleries",
    "distillers", "brewing", "brewery", "brewers", "winery", "wines", "vineyards", "vineyard", "cellars", "spirits", "imports",
    "importers", "importing", "trading", "group", "the", "and", "of",
)

A, O, R, E = derived.APPLICATIONS, derived.OBSERVATIONS, derived.RAW_RECORDS, derived.OUTCOMES
W = derived.WORDS.format(words=derived.DUCK_WORDS)
W_FROM = "AND word <> ''"


def _commodity(text: str) -> str:
    """The last commodity word of a text, by the largest start of any match."""
    any_ = "|".join(rf"\b(?:{w})\b" for w in COMMODITY_WORDS.values())
    last = f"list_extract(regexp_extract_all(lower({text}), '{any_}'), -1)"
    full = {k: f"regexp_full_match({last}, '(?:{w})')" for k, w in COMMODITY_WORDS.items()}
    return f"CASE WHEN {full['malt']} THEN 'malt' WHEN {full['wine']} THEN 'wine' WHEN {full['spirits']} THEN 'spirits' END"


def _ml(c: str) -> str:
    """Millilitres of the single-unit statements that the derived tables hold."""
    n = rf"replace(regexp_extract({c}, '([0-9]+(?:[.,][0-9]+)*)\s*(?:[A-Za-z])', 1), ',', '.')"
    return (
        f"CASE WHEN {c} = '1,000 mL' THEN 1000.0 WHEN {c} = '1/2 GALLON' THEN 0.5 * 3785.41 WHEN regexp_matches(lower({c}), 'fl\\.?\\s*oz') THEN CAST({n} AS DOUBLE) * 29.5735 "
        f"WHEN regexp_matches(lower({c}), '[0-9]\\s*ml') THEN CAST({n} AS DOUBLE) WHEN regexp_matches(lower({c}), '[0-9]\\s*cl') THEN CAST({n} AS DOUBLE) * 10 "
        f"WHEN regexp_matches(lower({c}), '[0-9]\\s*l$') THEN CAST({n} AS DOUBLE) * 1000 END"
    )


def _standard(ml: str, kind: str) -> str:
    near = lambda k: "(" + " OR ".join(f"abs({ml} - {s}) <= 3" for s in FILLS[k]) + ")"
    return f"CASE WHEN {kind} = 'spirits' THEN {near('spirits')} WHEN {kind} = 'wine' THEN CASE WHEN {ml} >= 4000 THEN abs({ml} / 1000 - round({ml} / 1000)) < 0.001 ELSE {near('wine')} END END"


def _num(c: str, tail: str) -> str:
    return rf"TRY_CAST(replace(nullif(regexp_extract({c}, '(?i)([0-9]+(?:[.,][0-9]+)?)\s*{tail}', 1), ''), ',', '.') AS DOUBLE)"


PCT_TAIL = r"(?:%|percent\b)"

ROWS = f"""
SELECT *, {_ml('exp_net')} AS exp_ml, {_ml('obs_net')} AS obs_ml, coalesce({_commodity('exp_class')}, {_commodity('obs_class')}) AS commodity,
       {_num('obs_alcohol', PCT_TAIL)} AS p, {_num('obs_alcohol', 'proof')} AS proof
FROM (SELECT o.l_orderkey, o.l_linenumber, o.cola_id, a.brand_name AS exp_brand, o.brand_name AS obs_brand, a.class_type AS exp_class, o.class_type AS obs_class,
             a.alcohol_content_pct AS want, o.alcohol_statement AS obs_alcohol, a.net_contents AS exp_net, o.net_contents AS obs_net, a.country_of_origin AS exp_country,
             o.country_of_origin AS obs_country, o.warning_text, o.warning_prefix_is_bold AS bold, o.warning_small_type AS small, o.warning_legibility AS legibility,
             o.confidence, o.image_soft AS soft
      FROM ({A}) AS a JOIN ({O}) AS o USING (cola_id))"""

CODED = f"""
SELECT *, CASE WHEN guard IS NOT NULL THEN guard WHEN obs_alcohol IS NULL AND want IS NULL THEN 'alcohol_unstated'
            WHEN obs_alcohol IS NULL AND (commodity = 'malt' OR (commodity = 'wine' AND want <= 14)) THEN 'alcohol_optional' WHEN obs_alcohol IS NULL THEN 'alcohol_missing'
            WHEN p IS NULL THEN 'alcohol_unparsed' WHEN want IS NULL THEN 'not_provided' WHEN p = want THEN 'alcohol_same' ELSE 'alcohol_other' END AS code_alcohol,
       CASE WHEN p IS NULL THEN NULL WHEN regexp_matches(obs_alcohol, '(?i)\\balc(ohol)?\\b') AND regexp_matches(obs_alcohol, '(?i)\\bv[oa0]l(ume)?\\b')
            AND regexp_matches(obs_alcohol, '(?i)%|\\bpercent\\b') THEN 'form_permitted' ELSE 'form_other' END AS code_format,
       CASE WHEN p IS NULL OR proof IS NULL THEN NULL WHEN guard IS NOT NULL THEN 'proof_unchecked' WHEN abs(proof - 2 * p) < 0.05 THEN 'proof_same' ELSE 'proof_other' END AS code_proof,
       CASE WHEN obs_net IS NULL THEN 'net_missing' WHEN exp_net IS NULL THEN 'not_provided' WHEN obs_ml IS NULL THEN 'net_unparsed_label'
            WHEN abs(exp_ml - obs_ml) <= CASE WHEN lower(exp_net || ' ' || obs_net) LIKE '%oz%' THEN 2.96 ELSE 1.0 END THEN
              CASE WHEN commodity IN ('spirits', 'wine') AND NOT regexp_matches(obs_net, '(?i)[0-9]\\s*(ml|millilit(re|er)s?|l|lit(re|er)s?)\\b') THEN 'net_form'
                   WHEN commodity = 'malt' AND NOT regexp_matches(obs_net, '(?i)\\b(fl\\.?\\s*oz|fluid\\s+ounces?|pints?|quarts?|gallons?)\\b') THEN 'net_form' ELSE 'net_same' END
            WHEN ({_standard('obs_ml', 'commodity')}) = false AND ({_standard('exp_ml', 'commodity')}) THEN 'net_odd_size' ELSE 'net_other' END AS code_net,
       CASE WHEN small THEN 'type_small' WHEN bold IS NULL THEN 'type_unknown' WHEN bold THEN 'type_bold' ELSE 'type_regular' END AS code_type
FROM (SELECT *, CASE WHEN p IS NOT NULL AND NOT (p > 0 AND p <= 96) THEN 'alcohol_implausible' WHEN abs(proof - 2 * want) < 0.1 AND p <> want THEN 'alcohol_proof_agrees'
                     WHEN abs(p - 10 * want) < 0.01 OR abs(10 * p - want) < 0.01 THEN 'alcohol_decimal' END AS guard FROM ({ROWS}))"""

FAILS = ("alcohol_missing", "alcohol_other", "proof_other", "net_missing", "net_other")
FLAGS = ("alcohol_unstated", "alcohol_optional", "alcohol_implausible", "alcohol_proof_agrees", "alcohol_decimal", "alcohol_unparsed", "form_other", "proof_unchecked", "net_unparsed_label", "net_form", "net_odd_size", "type_small", "type_unknown", "type_regular")
UNSURE = ("alcohol_implausible", "alcohol_proof_agrees", "alcohol_decimal", "alcohol_unparsed", "proof_unchecked", "net_unparsed_label", "net_odd_size")


def _in(c: str, codes: tuple[str, ...]) -> str:
    return f"({c} IN (" + ", ".join(f"'{x}'" for x in codes) + "))"


ALL_CODES = ("code_alcohol", "code_format", "code_proof", "code_net", "code_type")
_HARD = " OR ".join(f"coalesce({_in(c, FAILS)} AND NOT soft AND NOT ({low}), false)" for c, low in (("code_alcohol", "confidence < 80"), ("code_proof", "false"), ("code_net", "confidence < 80")))
_ANY = " OR ".join(f"coalesce({_in(c, FAILS + FLAGS)}, false)" for c in ALL_CODES)
_VERDICT = f"CASE WHEN {_HARD} THEN 'fail' WHEN {_ANY} THEN 'flag' ELSE 'pass' END"

_SOFT = f"""
WITH c AS ({CODED}), x AS (
  SELECT *, (CASE WHEN code_alcohol = 'alcohol_missing' THEN 1 ELSE 0 END + CASE WHEN code_net = 'net_missing' THEN 1 ELSE 0 END) >= 2 AS many,
         (l_orderkey % 5 = 0 OR legibility = 'illegible') AS part FROM c),
rows_ AS (SELECT 'alcohol_content' AS field, code_alcohol AS code, obs_alcohol IS NULL AS absent, * FROM x
          UNION ALL SELECT 'net_contents', code_net, obs_net IS NULL, * FROM x),
v AS (SELECT *, CASE WHEN {_in('code', FAILS)} THEN 'fail' WHEN {_in('code', FLAGS)} THEN 'flag' ELSE 'pass' END AS v0, {_in('code', UNSURE)} AS u0 FROM rows_),
s1 AS (SELECT *, many AND absent AND v0 = 'fail' AS t1 FROM v),
s2 AS (SELECT *, CASE WHEN t1 THEN 'flag' ELSE v0 END AS v1, u0 OR t1 AS u1 FROM s1),
s3 AS (SELECT *, part AND absent AND (v1 = 'fail' OR (v1 = 'flag' AND NOT u1)) AS t2 FROM s2),
s4 AS (SELECT *, CASE WHEN t2 THEN 'flag' ELSE v1 END AS v2, u1 OR t2 AS u2 FROM s3),
s5 AS (SELECT *, ((soft AND v2 = 'fail') OR confidence < 80) AND (v2 = 'fail' OR (v2 = 'flag' AND NOT u2)) AS t3 FROM s4)
SELECT field, CASE WHEN t3 THEN 'flag' ELSE v2 END AS verdict, u2 OR t3 AS read_uncertain,
       CASE WHEN t3 THEN CASE WHEN soft AND v2 = 'fail' THEN 'soft_image' ELSE 'low_confidence' END WHEN t2 THEN 'part_unread' WHEN t1 THEN 'several_missing' END AS softened, count(*) AS n
FROM s5 GROUP BY ALL"""

_FOLD = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_ ]', ' ', 'g'), '^the +', ''), ' +', ' ', 'g'))"
_CHECKED = f"""
SELECT row_no, coalesce(nullif(trim(ttb_id), ''), nullif(trim(id), '')) AS cola_id, nullif(trim(brand), '') AS brand_name, CASE WHEN pct > 0 AND pct <= 100 THEN pct END AS alcohol_content_pct,
       CASE WHEN given AND NOT coalesce(pct > 0 AND pct <= 100, false) THEN 'bad_percent' WHEN coalesce(nullif(trim(ttb_id), ''), nullif(trim(id), '')) IS NULL THEN 'no_id'
            WHEN nullif(trim(brand), '') IS NULL THEN 'no_brand' END AS error
FROM (SELECT *, TRY_CAST(trim(replace(replace(abv, '%', ''), ',', '.')) AS DOUBLE) AS pct, trim(replace(abv, '%', '')) <> '' AS given FROM ({R}))"""
_FILES = "SELECT page_id AS file_no, lower(list_extract(string_split(url, '/'), -1)) AS name FROM pages"
_HEAD = r"'^(?i)(government)\s+(warning)\s*(:?)\s*'"
_SAID = r"trim(regexp_replace(warning_text, '\s+', ' ', 'g'))"

_LINES = f"""
SELECT image_id, line_num, string_agg(text, ' ' ORDER BY "left") AS text, min(top) AS top, max(top + height) AS bottom,
       list_extract(list_sort(list(height)), CAST(floor(count(*) / 2) AS INT) + 1) AS height, avg(conf) AS conf, min("left") AS left0
FROM ({W}) WHERE trim(text) <> '' AND conf >= 25 GROUP BY ALL"""
_VOL = r"(?i)(?:\d+\s*/\s*)?\d+(?:[.,]\d+)*\s*(?:fl\.?\s*oz|fluid\s+ounces?|pints?|quarts?|gallons?|millilit(?:re|er)s?|ml|centilit(?:re|er)s?|cl|lit(?:re|er)s?|l)\b"
_PCT = r"(?i)\d+(?:[.,]\d+)?\s*(?:%|percent\b)"
_ALC = r"(?i)\b(?:alc|alcohol|vol|volume|proof|abv)\b"
_FORM = r"(?i)\balc\b\.?\s*/?\s*\bvol\b|\bproof\b"
_STATES = rf"(regexp_matches(text, '{_PCT}') AND (regexp_matches(text, '{_ALC}') OR TRY_CAST(replace(regexp_extract(text, '(?i)(\d+(?:[.,]\d+)?)\s*(?:%|percent\b)', 1), ',', '.') AS DOUBLE) < 100))"
_FIELDS = rf"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY top, left0, line_num) AS no,
             CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) >= 0.6 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) ELSE false END AS caps FROM ({_LINES})),
c AS (SELECT *, top < greatest(max(bottom) OVER (PARTITION BY image_id), 400) * 0.55 AND NOT {_STATES} AND NOT regexp_matches(text, '{_VOL}') AND NOT regexp_matches(text, '{_FORM}') AND conf >= 50 AS cand FROM l),
b AS (SELECT image_id, first(no) AS bno, first(height) AS bh, first(caps) AS bcaps FROM (SELECT * FROM c WHERE cand QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY height DESC, no) = 1) GROUP BY image_id),
j AS (SELECT c.*, bno, bh, abs(height - bh) <= bh * 0.12 AND caps = bcaps AS same, lag(bottom) OVER w AS above, lead(top) OVER w AS next_top FROM c LEFT JOIN b USING (image_id) WINDOW w AS (PARTITION BY image_id ORDER BY no)),
k AS (SELECT *, no > bno AND NOT coalesce(same AND top - above <= bh * 1.2, false) AS cut_down, no < bno AND NOT coalesce(same AND next_top - bottom <= bh * 1.2, false) AS cut_up FROM j),
m AS (SELECT *, bno IS NOT NULL AND NOT coalesce(bool_or(cut_down) OVER (PARTITION BY image_id ORDER BY no), false) AND NOT coalesce(bool_or(cut_up) OVER (PARTITION BY image_id ORDER BY no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), false) AS in_brand FROM k),
q AS (SELECT *, cand AND no > max(CASE WHEN in_brand THEN no END) OVER (PARTITION BY image_id) AND height < bh * 0.92 AS below FROM m)
SELECT image_id, nullif(string_agg(trim(text), ' ' ORDER BY no) FILTER (in_brand), '') AS brand_name, min_by(trim(text), no) FILTER (below) AS class_type,
       coalesce(min_by(trim(text), no) FILTER (regexp_matches(text, '{_PCT}') AND regexp_matches(text, '{_ALC}')), min_by(trim(text), no) FILTER ({_STATES}), min_by(trim(text), no) FILTER (regexp_matches(text, '{_FORM}'))) AS alcohol_statement,
       coalesce(min_by(regexp_extract(text, '{_VOL}(?:.*{_VOL[4:]})?'), no) FILTER (regexp_matches(text, '{_VOL}')), min_by(trim(text), no) FILTER (regexp_matches(trim(text), '^\d+(?:[.,]\d+)?$') OR regexp_matches(trim(text), '^\d+(?:[.,]\d+)?\s*[A-Za-z.]{{1,4}}$'))) AS net_contents,
       round(coalesce(max(bh) / list_extract(list_sort(list(height) FILTER (NOT in_brand)), CAST(floor(count(*) FILTER (NOT in_brand) / 2) AS INT) + 1), 0), 6) AS dominance
FROM q GROUP BY image_id"""

_KIND = "CASE WHEN expected = actual THEN 'correct' WHEN actual IN ('pass', 'fail') THEN 'unsafe' WHEN actual = 'flag' AND expected = 'pass' THEN 'cautious' WHEN actual = 'flag' AND expected = 'fail' THEN 'referred' ELSE 'unsafe' END"
_OK = "(error IS NULL AND expected = actual)"
_HARM = f"(error IS NOT NULL OR wrong OR {_KIND} = 'unsafe')"


def _rank(p: int) -> str:
    return f"min(total_ms) FILTER (upto > least(CASE WHEN ({p} * (total - 1)) % 100 = 50 THEN 2 * round(({p} * (total - 1)) / 200.0) ELSE round({p} * (total - 1) / 100.0) END, total - 1))"


SQL: dict[str, str] = {
    "review_verdicts": f"SELECT verdict, count(*) AS n FROM (SELECT {_VERDICT} AS verdict FROM ({CODED})) GROUP BY verdict",
    "rule_alcohol": f"SELECT code_alcohol, code_format, code_proof, count(*) AS n FROM ({CODED}) GROUP BY ALL",
    "rule_net_contents": f"SELECT code_net, commodity, count(*) AS n, round(sum(obs_ml), 1) AS ml FROM ({CODED}) GROUP BY ALL",
    "rule_typography": f"SELECT code_type, CASE WHEN ml <= 237 THEN 1 WHEN ml <= 3000 THEN 2 WHEN ml IS NOT NULL THEN 3 ELSE 0 END AS mm, count(*) AS n FROM (SELECT *, coalesce(exp_ml, obs_ml) AS ml FROM ({CODED})) GROUP BY ALL",
    "rule_warning": f"""SELECT code, count(*) AS n FROM (SELECT CASE WHEN m = 1 AND warning_legibility = 'illegible' THEN 'warning_illegible' WHEN m = 1 THEN 'warning_missing' WHEN m = 3 THEN 'warning_heading_case'
        WHEN m = 4 THEN 'warning_body_case' WHEN m = 6 THEN 'warning_trailing' WHEN m = 7 THEN 'warning_punctuation' ELSE 'warning_exact' END AS code FROM ({O})) GROUP BY code""",
    "softening": _SOFT,
    "applications_commodity": f"""SELECT commodity, CASE commodity WHEN 'wine' THEN '27 CFR 4.37 (net contents)' WHEN 'spirits' THEN '27 CFR 5.70 (net contents)' WHEN 'malt' THEN '27 CFR 7.70 (net contents)'
        ELSE '27 CFR 5.70 (spirits), 4.37 (wine) or 7.70 (malt beverages): net contents' END AS citation, count(*) AS n FROM (SELECT {_commodity('class_type')} AS commodity FROM ({A})) GROUP BY ALL""",
    "application_volumes": f"SELECT net_contents, count(*) AS n, round(max(ml), 3) AS ml, coalesce(CAST(max({_standard('ml', chr(39) + 'spirits' + chr(39))}) AS VARCHAR), 'none') AS standard FROM (SELECT *, {_ml('net_contents')} AS ml FROM ({A})) GROUP BY net_contents",
    "folded_names": f"""SELECT coalesce(CAST(replace(a, ' ', '') = replace(b, ' ', '') AS VARCHAR), 'none') AS same, coalesce(CAST(CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE len(pa) > 0 AND len(pa) < len(pb) AND len(list_filter(pa, lambda x: NOT list_contains(pb, x))) = 0 END AS VARCHAR), 'none') AS part, count(*) AS n
        FROM (SELECT *, string_split(a, ' ') AS pa, string_split(b, ' ') AS pb FROM (SELECT {_FOLD.format('exp_brand')} AS a, {_FOLD.format('obs_brand')} AS b FROM ({ROWS}))) GROUP BY ALL""",
    "producer_names": f"""SELECT CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE folded END AS name, count(*) AS n FROM (SELECT folded, list_filter(string_split(folded, ' '), lambda x: x NOT IN ({', '.join(f"'{g}'" for g in GENERIC)})) AS kept
        FROM (SELECT {_FOLD.format("regexp_replace(bottler_name, '(?is)^.*?\\bby\\b[\\s:]*', '')")} AS folded FROM ({A}))) GROUP BY ALL""",
    "country_names": f"SELECT trim(regexp_replace(country_of_origin, '(?i)^\\s*(?:product|produce|produced|bottled|distilled|made|imported)\\s+(?:of|in|by|from)\\s*(?:the\\s+)?', ''), ' .,') AS country, count(*) AS n FROM ({A}) GROUP BY ALL",
    "statement_words": rf"""SELECT CASE WHEN regexp_matches(said, '(?i)^government\s+warning') THEN regexp_extract(said, '(?i)^(government\s+warning:?)', 1) END AS heading,
        CASE WHEN said IS NULL THEN -1 ELSE len(list_filter(string_split(regexp_replace(lower(regexp_replace(said, '(?i)^government\s+warning\s*:?\s*', '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) END AS words, coalesce(length(said), -1) AS chars, count(*) AS n
        FROM (SELECT {_SAID} AS said FROM ({O})) GROUP BY ALL""",
    "records_checked": _CHECKED,
    "records_first": f"SELECT cola_id, row_no, brand_name FROM ({_CHECKED}) WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY cola_id ORDER BY row_no) = 1",
    "records_errors": f"""SELECT error, count(*) AS n FROM (SELECT coalesce(error, CASE WHEN nth > 1 THEN 'duplicate_id' END) AS error FROM (SELECT *, CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY error IS NULL, cola_id ORDER BY row_no) END AS nth
        FROM ({_CHECKED}))) WHERE error IS NOT NULL GROUP BY error""",
    "records_limit": "SELECT 'batch-' || CAST(o_custkey % 50 AS VARCHAR) AS source_file, count(*) AS n_records, count(*) > 300 AS over_limit FROM orders GROUP BY 1",
    "match_declared": f"""WITH f AS ({_FILES}), a AS (SELECT cola_id, lower(upper(cola_id) || '?PAGE=2&ref=x') AS name FROM ({A}) WHERE k % 3 = 0),
        one AS (SELECT cola_id, min(file_no) AS file_no FROM a JOIN f USING (name) GROUP BY cola_id) SELECT min(cola_id) AS cola_id, file_no FROM one GROUP BY file_no""",
    "match_contained": f"""WITH f AS ({_FILES}), a AS (SELECT DISTINCT cola_id FROM ({A})),
        best AS (SELECT file_no, cola_id FROM f JOIN a ON contains(name, lower(cola_id)) QUALIFY row_number() OVER (PARTITION BY file_no ORDER BY length(cola_id) DESC, cola_id) = 1)
        SELECT cola_id, min(file_no) AS file_no FROM best GROUP BY cola_id""",
    "read_once": "SELECT doc_id, sha256(text) AS digest, length(text) AS chars FROM documents",
    "recorded_readings": """WITH d AS (SELECT doc_id, lang, sha256(text) AS digest FROM documents) SELECT lang, CASE WHEN digest IN (SELECT digest FROM d WHERE lang = 'en') THEN NULL ELSE 'no_recorded_reading' END AS error, count(*) AS n FROM d GROUP BY ALL""",
    "daily_cap": """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY ts, key, event_id) AS i, * FROM (
          SELECT event_id, ts, CAST(ts AS DATE) AS day, event_type <> 'error' AS ok, CAST(user_id % 40 AS VARCHAR) || '|' || least('net_contents', event_type) || ',' || greatest('net_contents', event_type) AS key FROM events)),
        walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS calls, CAST([] AS VARCHAR[]) AS known, CAST(NULL AS VARCHAR) AS outcome
          UNION ALL
          SELECT i, day, calls + CASE WHEN outcome = 'paid' THEN 1 ELSE 0 END, CASE WHEN outcome = 'paid' AND ok THEN list_append(known, key) ELSE known END, outcome
          FROM (SELECT *, CASE WHEN list_contains(known, key) THEN 'cached' WHEN calls < 20 THEN 'paid' ELSE 'refused' END AS outcome
                FROM (SELECT r.i, r.day, r.key, r.ok, w.known, CASE WHEN r.day IS DISTINCT FROM w.day THEN 0 ELSE w.calls END AS calls FROM walk AS w JOIN r ON r.i = w.i + 1)))
        SELECT strftime(day, '%Y-%m-%d') AS day, outcome, count(*) AS n FROM walk WHERE i > 0 GROUP BY ALL""",
    "export_guard": """SELECT CASE WHEN regexp_matches(c, '^[=+@\\t\\r-]') THEN '''' || c ELSE c END AS cell, count(*) AS n FROM (SELECT list_extract(['=', '+', '-', '@', 'a', chr(9)], CAST(doc_id % 6 + 1 AS INT)) || source AS c FROM documents) GROUP BY 1""",
    "eval_accuracy": f"SELECT fixture_set, count(*) AS n, CAST(sum({_OK}::INT) AS BIGINT) AS n_correct, sum({_OK}::INT) / count(*) AS accuracy FROM ({E}) GROUP BY ROLLUP (fixture_set)",
    "eval_outcomes": f"SELECT count(*) AS n, CAST(sum(({_KIND} = 'correct')::INT) AS BIGINT) AS correct, CAST(sum(({_KIND} = 'cautious')::INT) AS BIGINT) AS cautious, CAST(sum(({_KIND} = 'referred')::INT) AS BIGINT) AS referred, CAST(sum({_HARM}::INT) AS BIGINT) AS unsafe FROM ({E})",
    "eval_confusion": f"""SELECT expected, count(*) FILTER (actual = 'pass') AS pass, count(*) FILTER (actual = 'flag') AS flag, count(*) FILTER (actual = 'fail') AS fail
        FROM (SELECT expected, CASE WHEN error IS NULL THEN actual END AS actual FROM ({E})) GROUP BY expected""",
    "eval_latency": f"""SELECT {_rank(50)} AS p50, {_rank(95)} AS p95, {_rank(99)} AS p99, {_rank(100)} AS p_max FROM (SELECT total_ms, sum(n) OVER (ORDER BY total_ms) AS upto, sum(n) OVER () AS total FROM (SELECT total_ms, count(*) AS n FROM ({E}) WHERE error IS NULL GROUP BY total_ms))""",
    "eval_throughput": f"SELECT count(*) / 48.0 * 60 AS per_minute, 300 / (count(*) / 48.0 * 60) AS batch_minutes FROM ({E})",
    "eval_cost": f"""SELECT CAST(sum(second_reading_called::INT) AS BIGINT) AS consulted, CAST(sum(was_cleared::INT) AS BIGINT) AS with_cleared, sum(cost_usd) FILTER (second_reading_called) AS cost_total, avg(cost_usd) FILTER (second_reading_called) AS cost_mean,
        max(total_ms) FILTER (second_reading_called) AS slowest_ms, (SELECT id FROM ({E}) WHERE second_reading_called ORDER BY total_ms DESC, id DESC LIMIT 1) AS slowest_id FROM ({E})""",
    "eval_separation": f"""WITH s AS (SELECT triage_p, count(*) FILTER (expected <> 'pass') AS g, count(*) FILTER (expected = 'pass') AS n FROM ({E}) WHERE actual = 'flag' AND triage_p IS NOT NULL GROUP BY triage_p)
        SELECT CAST(sum(g) AS BIGINT) AS genuine, CAST(sum(n) AS BIGINT) AS noise, (SELECT sum(x.g * y.n) FROM s x JOIN s y ON x.triage_p > y.triage_p) / (sum(g) * sum(n)) AS ordered, sum(g * n) / (sum(g) * sum(n)) AS tied,
        min(triage_p) FILTER (g > 0) > max(triage_p) FILTER (n > 0) AS separated FROM s""",
    "eval_stress": f"""SELECT degradation, count(*) FILTER (actual = 'pass') AS pass, count(*) FILTER (actual = 'flag') AS flag, count(*) FILTER (actual = 'fail') AS fail, count(*) FILTER (actual = 'error') AS unreadable FROM ({E}) GROUP BY ROLLUP (degradation)""",
    "eval_gate": f"""SELECT harmful, tuned_accuracy, harmful > 3 OR tuned_accuracy < 0.8 AS refused FROM (SELECT CAST(sum({_HARM}::INT) AS BIGINT) AS harmful, sum({_OK}::INT) FILTER (fixture_set = 'rendered') / count(*) FILTER (fixture_set = 'rendered') AS tuned_accuracy FROM ({E}))""",
    "eval_fields": f"""WITH r AS (SELECT * FROM ({ROWS}) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, cola_id) = 1),
        u AS (SELECT 'brand' AS field, exp_brand AS e, obs_brand AS o FROM r UNION ALL SELECT 'class', exp_class, obs_class FROM r UNION ALL SELECT 'net', exp_net, obs_net FROM r UNION ALL SELECT 'country', exp_country, obs_country FROM r)
        SELECT field, CAST(sum((trim(e) IS NOT DISTINCT FROM trim(o))::INT) AS BIGINT) AS hits, count(*) AS n, sum((trim(e) IS NOT DISTINCT FROM trim(o))::INT) / count(*) AS accuracy FROM u GROUP BY field""",
    "windowed_verdicts": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, actual AS verdict, count(*) AS n FROM ({E}) GROUP BY ALL",
    "layout_counts": f"SELECT image_id, count(*) FILTER (conf >= 25) AS words_read, count(*) FILTER (conf < 25) AS weak_words, round(avg(conf) FILTER (conf >= 25), 6) AS mean_conf FROM ({W}) WHERE trim(text) <> '' AND conf >= 0 GROUP BY image_id",
    "layout_lines": f"SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY top, left0, line_num) AS line_no, text, top, bottom, height, round(conf, 6) AS conf FROM ({_LINES})",
    "layout_fields": _FIELDS,
    "ordered_batch": f"SELECT fixture_set, event_id AS input_pos, row_number() OVER (PARTITION BY fixture_set ORDER BY CASE actual WHEN 'fail' THEN 0 WHEN 'error' THEN 1 WHEN 'flag' THEN 2 ELSE 3 END, CASE WHEN actual = 'flag' THEN coalesce(triage_p, -1) ELSE -1 END DESC, event_id) AS queue_pos FROM ({E})",
    "verdict_ranks": f"SELECT worst, count(*) AS n FROM (SELECT max(CASE actual WHEN 'pass' THEN 0 WHEN 'flag' THEN 1 ELSE 2 END) OVER (PARTITION BY user_id ORDER BY event_id) AS worst FROM ({E}) WHERE actual <> 'error') GROUP BY worst",
}
