"""DuckDB SQL of files, joins of truth, listings, likenesses, boxes and admissions; written from the rules."""

from __future__ import annotations

from . import derived
from .cases import CASES, rows_sql
from .label_words import EXPECTED, LABELS
from .oracle import SQL as FIRST

A, R, E = derived.APPLICATIONS, derived.RAW_RECORDS, derived.OUTCOMES


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two short texts: bits of one number, a letter of b a step."""
    full = f"((CAST(1 AS BIGINT) << length({a})) - 1)"
    mask = f"CAST(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substring({a}, CAST(i + 1 AS INT), 1) = ch THEN CAST(1 AS BIGINT) << CAST(i AS INT) ELSE CAST(0 AS BIGINT) END)) AS BIGINT)"
    steps = f"list_prepend({full}, list_transform(string_split({b}, ''), lambda ch: {mask}))"
    return f"(length({a}) - bit_count(list_reduce({steps}, lambda rest, m: ((rest + (rest & m)) | (rest - (rest & m))) & {full})))"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0 * {lcs(a, b)} / (length({a}) + length({b})) END)"


_WORDS = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_SIMILAR = f"""
WITH p AS (SELECT x.p_name, y.p_name AS other, count(*) AS n FROM part AS x JOIN part AS y ON y.p_partkey = x.p_partkey + 1 GROUP BY ALL),
w AS (SELECT *, CASE WHEN length(p_name) <= length(other) THEN p_name ELSE other END AS s, CASE WHEN length(p_name) <= length(other) THEN other ELSE p_name END AS l FROM p),
sides AS (SELECT p_name, other, s, l FROM w UNION ALL SELECT p_name, other, l, s FROM w WHERE length(s) = length(l)),
cut AS (SELECT p_name, other, s, substring(l, CAST(greatest(i, 0) + 1 AS INT), CAST(least(length(l), i + length(s)) - greatest(i, 0) AS INT)) AS part FROM (SELECT *, unnest(range(1 - length(s), length(l))) AS i FROM sides)),
best AS (SELECT p_name, other, max({ratio('s', 'part')}) AS w FROM cut GROUP BY ALL),
sets AS (SELECT *, {_WORDS.format('p_name')} AS sa, {_WORDS.format('other')} AS sb, list_distinct(string_split(p_name, ' ')) AS xa, list_distinct(string_split(other, ' ')) AS xb FROM p),
parts AS (SELECT *, array_to_string(list_sort(list_filter(xa, lambda t: list_contains(xb, t))), ' ') AS head, array_to_string(list_sort(list_filter(xa, lambda t: NOT list_contains(xb, t))), ' ') AS la,
          array_to_string(list_sort(list_filter(xb, lambda t: NOT list_contains(xa, t))), ' ') AS lb FROM sets),
whole AS (SELECT *, trim(head || ' ' || la) AS ha, trim(head || ' ' || lb) AS hb FROM parts)
SELECT p_name, other, n, round({ratio('p_name', 'other')}, 6) AS plain, round(best.w, 6) AS window, round({ratio('sa', 'sb')}, 6) AS by_word,
       round(CASE WHEN head <> '' AND (la = '' OR lb = '') THEN 100.0 ELSE greatest(
         100.0 * (1 - (length(la) + length(lb) - 2 * CASE WHEN la = '' OR lb = '' THEN 0 ELSE {lcs('la', 'lb')} END) / CAST(length(ha) + length(hb) AS DOUBLE)),
         CASE WHEN head <> '' THEN 200.0 * length(head) / (length(head) + length(ha)) ELSE 0 END, CASE WHEN head <> '' THEN 200.0 * length(head) / (length(head) + length(hb)) ELSE 0 END) END, 6) AS by_set
FROM whole JOIN best USING (p_name, other)"""

_RECORD_FILES = f"""
WITH r AS (SELECT *, row_no % 4 AS form, row_number() OVER (PARTITION BY row_no % 4, row_no // 1000 ORDER BY row_no) + 1 AS line FROM ({R})),
c AS (SELECT 'form' || form AS form, line, nullif(trim(ttb_id), '') AS id, CASE WHEN form = 3 THEN nullif(trim(brand), '') ELSE 'É' END AS brand,
      TRY_CAST(trim(replace(replace(abv, '%', ''), ',', '.')) AS DOUBLE) AS x, coalesce(trim(replace(abv, '%', '')), '') <> '' AS given, form <> 3 AS accent FROM r),
e AS (SELECT *, CASE WHEN x > 0 AND x <= 100 THEN x END AS pct FROM c),
rows_ AS (SELECT form, line, id, pct, accent, CASE WHEN given AND pct IS NULL THEN 'bad_percent' WHEN id IS NULL THEN 'no_id' WHEN brand IS NULL THEN 'no_brand' END AS error FROM e
      UNION ALL SELECT 'broken', NULL, NULL, NULL, false, CASE p_size % 10 WHEN 0 THEN 'empty' WHEN 1 THEN 'json_shape' WHEN 2 THEN 'bad_json' ELSE 'no_rows' END FROM part WHERE p_size % 10 < 4)
SELECT form, error, count(*) AS n, CAST(sum(line) AS BIGINT) AS row_numbers, count(id) AS ids, round(sum(pct), 3) AS percents, count(*) FILTER (accent) AS accents FROM rows_ GROUP BY ALL"""

_RAW = rows_sql([
    (0, "Old Tom", "750 mL", True, False, "read", False, "brand_name=91.5", "brand_name", ""), (1, None, None, None, True, "absent", True, "", "", "TL"),
    (2, None, None, None, False, "illegible", False, "class_type=60.0", "", ""), (3, None, None, None, False, "read", False, "", "", ""),
    (4, None, None, None, False, "absent", False, "", "", ""), (5, None, None, None, False, "absent", False, "", "", ""),
], ("k", "brand_name", "net_contents", "warning_prefix_is_bold", "warning_small_type", "warning_legibility", "image_soft", "confidence", "boxes", "unread"))
_CASE = rows_sql([(k, name, c[1], c[2], c[3]) for k, (name, c) in enumerate(CASES.items())], ("k", "case_name", "field", "code", "verdict"))
#: Of cases whose statement did not pass: its verdict, doubt, and segments missing, unexpected, substituted.
_FOUND = rows_sql([(list(CASES).index(name), name, *rest) for name, *rest in (
    ("heading misread", "flag", True, 0, 0, 0), ("not dropped", "fail", False, 1, 0, 0), ("not in doubt", "flag", True, 1, 0, 0), ("near miss", "flag", True, 0, 0, 1),
    ("speck", "flag", True, 0, 1, 0), ("run together", "flag", True, 0, 0, 1), ("word in doubt", "flag", True, 0, 1, 0), ("word added", "fail", False, 0, 1, 0),
    ("word swapped", "fail", False, 0, 0, 1), ("four words lost", "flag", True, 1, 0, 0), ("six words lost", "fail", False, 1, 0, 0), ("text after", "flag", True, 0, 0, 1),
)], ("k", "case_name", "verdict", "read_uncertain", "words_missing", "words_unexpected", "words_substituted"))
_BOLD = rows_sql([(k, EXPECTED[name][9], True if EXPECTED[name][8] and name not in ("small type", "misread heading") else None) for k, name in enumerate(LABELS)], ("k", "warning_legibility", "warning_prefix_is_bold"))
_ID = "(CASE WHEN o_orderkey % 8 = 0 THEN 'photo_' ELSE 'label_' END || o_orderkey)"
_BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _walk(declared: bool) -> str:
    """CTEs up to ``got``: files in order, each the first free id of its list."""
    named = f"SELECT file_no, cola_id, 'declared' AS how, 0 AS kind FROM f JOIN (SELECT DISTINCT cola_id, lower(upper(cola_id) || '?PAGE=2&ref=x') AS declared FROM ({A}) WHERE k % 3 = 0) ON declared = name UNION ALL" if declared else ""
    return f"""f AS (SELECT page_id AS file_no, lower(list_extract(string_split(url, '/'), -1)) AS name FROM pages), ids AS (SELECT DISTINCT cola_id FROM ({A})),
        wishes AS ({named} SELECT file_no, cola_id, 'contained' AS how, 1 AS kind FROM f JOIN ids ON contains(name, lower(cola_id))),
        can AS (SELECT row_number() OVER (ORDER BY file_no) AS i, file_no, list({{'id': cola_id, 'how': how}} ORDER BY kind, CASE WHEN kind = 1 THEN -length(cola_id) ELSE 0 END, cola_id) AS ws FROM wishes GROUP BY file_no),
        steps AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS file_no, CAST(NULL AS STRUCT(id VARCHAR, how VARCHAR)) AS w UNION ALL
          SELECT i, CASE WHEN w IS NULL THEN taken ELSE list_append(taken, w.id) END, file_no, w FROM (SELECT can.i, taken, can.file_no, list_filter(ws, lambda z: NOT list_contains(taken, z.id))[1] AS w FROM steps JOIN can ON can.i = steps.i + 1)),
        got AS (SELECT w.id AS cola_id, file_no, w.how AS how FROM steps WHERE w IS NOT NULL)"""


SQL = {
    "record_files": _RECORD_FILES,
    "truth_files": """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'rendered' ELSE 'ai' END AS fixture_set, CASE WHEN o_orderkey % 3 = 0 THEN 'pass' ELSE 'fail' END AS expected_verdict, count(*) AS n,
        CAST(sum(o_orderkey) AS BIGINT) AS ids, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS failing FROM orders GROUP BY ALL""",
    "compliant_labels": f"SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT {_ID} AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 8 <> 0)",
    "raw_observations": f"SELECT e.* EXCLUDE (k), count(*) AS n FROM orders JOIN {_RAW} AS e ON o_orderkey % 6 = k GROUP BY ALL",
    "word_files": FIRST["layout_counts"],
    "queue_files": f"""SELECT '"' || CASE WHEN event_id % 3 = 0 THEN '''=' ELSE '' END || id || '","' || CASE actual WHEN 'pass' THEN 'Pass' WHEN 'flag' THEN 'Review' ELSE 'Fail' END || '","'
        || CASE WHEN event_id % 7 = 0 THEN 'a ""quoted"" note' ELSE 'All checks passed' END || '","' || printf('%.1f', floor((total_ms + 50) / 100) / 10.0) || '","'
        || CASE WHEN actual = 'flag' AND triage_p IS NOT NULL THEN CAST(floor(triage_p * 100 + 0.5) AS BIGINT) || '%","heuristic"' ELSE '',''' END AS line, count(*) AS n FROM ({E}) WHERE actual <> 'error' GROUP BY 1""".replace("ELSE '','''", "ELSE '\",\"\"'"),
    "payloads": f"""SELECT id AS cola_id, '{{"cola_id":"' || id || '","verdict":"' || actual || '"' || CASE WHEN triage_p IS NULL THEN '' ELSE ',"triage_p":' || CAST(triage_p AS VARCHAR) END || '}}' AS payload FROM ({E})""",
    "reports": f"""SELECT 'accuracy' AS report, coalesce(fixture_set, 'all') AS row, CAST(count(*) FILTER (error IS NULL AND expected = actual) AS BIGINT) AS n FROM ({E}) GROUP BY ROLLUP (fixture_set)
        UNION ALL SELECT 'confusion', expected, count(*) FILTER (error IS NULL AND actual = 'fail') FROM ({E}) GROUP BY expected""",
    "form_records": f"SELECT coalesce(nullif(trim(ttb_id), ''), 'UNSPECIFIED') AS cola_id, count(*) AS n, count(nullif(trim(brand), '')) AS brands FROM ({R}) GROUP BY 1",
    "work_set": f"SELECT cola_id, upper(cola_id) || '?PAGE=2&ref=x' AS image FROM ({FIRST['match_declared']})",
    "truth_and_results": f"""SELECT case_name, CASE WHEN o_orderkey % 2 = 0 THEN 'pass' ELSE 'fail' END AS expected, verdict AS actual,
        CASE WHEN verdict = 'fail' AND NOT (o_orderkey % 2 = 1 AND field = 'government_warning') THEN field ELSE '' END AS wrong_fails,
        o_orderkey % 2 = 0 OR (field = 'government_warning' AND code <> 'warning_exact') AS right_reason, count(*) AS n FROM orders JOIN {_CASE} AS e ON o_orderkey % {len(CASES)} = k GROUP BY ALL""",
    "word_listings": """SELECT p_name, CASE p_partkey % 4 WHEN 0 THEN 'unexpected:|reserve' WHEN 1 THEN 'missing:' || split_part(p_name, ' ', 1) || '|' WHEN 2 THEN 'substituted:' || split_part(p_name, ' ', 2) || '|gin' ELSE '' END AS listing, count(*) AS n FROM part GROUP BY ALL""",
    "triage_findings": f"SELECT e.* EXCLUDE (k), 'regulation' AS layer, false AS advisory, count(*) AS n FROM orders JOIN {_FOUND} AS e ON o_orderkey % {len(CASES)} = k GROUP BY ALL",
    "first_snippets": "SELECT doc_id, array_to_string(list_transform(list_slice(string_split(text, chr(10)), 1, 3), lambda x: '''' || x || ''''), ', ') AS quoted FROM documents",
    "evidence_boxes": f"""SELECT image_id, least(greatest(floor(x0 * 2.5 + 0.5) / 10000, 0), 1) AS x0, least(greatest(floor(y0 * 5 / 9.0 + 0.5) / 10000, 0), 1) AS y0, least(floor(x1 * 2.5 + 0.5) / 10000, 1) AS x1, least(floor(y1 * 5 / 9.0 + 0.5) / 10000, 1) AS y1
        FROM (SELECT image_id, min("left") - 6 AS x0, min(top) - 6 AS y0, max("left" + width) + 6 AS x1, max(top + height) + 6 AS y1 FROM ({derived.WORDS.format(words=derived.DUCK_WORDS)}) WHERE text <> '' GROUP BY image_id)""",
    "bold_headings": f"SELECT warning_legibility, CAST(warning_prefix_is_bold AS BOOLEAN) AS warning_prefix_is_bold, count(*) AS n FROM orders JOIN {_BOLD} AS e ON o_orderkey % {len(LABELS)} = k GROUP BY ALL",
    "similar_words": _SIMILAR,
    "streamed_review": f"SELECT case_name, verdict, count(*) AS n FROM orders JOIN {_CASE} AS e ON o_orderkey % {len(CASES)} = k GROUP BY ALL",
    "streamed_digests": "SELECT sha256(text) AS digest, CAST(1 AS BIGINT) AS n FROM documents GROUP BY 1",
    "similar_names": f"""SELECT exp_brand, obs_brand, n, CASE WHEN obs_brand IS NOT NULL THEN 200.0 * length(exp_brand) / (length(exp_brand) + length(obs_brand)) END AS plain, CASE WHEN obs_brand IS NOT NULL THEN 100.0 END AS window,
        CASE WHEN obs_brand IS NOT NULL THEN 200.0 * length(exp_brand) / (length(exp_brand) + length(obs_brand)) END AS by_word, CASE WHEN obs_brand IS NOT NULL THEN 100.0 END AS by_set
        FROM (SELECT a.brand_name AS exp_brand, o.brand_name AS obs_brand, count(*) AS n FROM ({A}) AS a JOIN ({derived.OBSERVATIONS}) AS o USING (cola_id) GROUP BY ALL)""",
    "sanitized_readings": rf"""WITH r AS (SELECT page_id AS k, html AS value FROM pages UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents),
        f AS (SELECT CASE k % 3 WHEN 0 THEN 'warning_text' WHEN 1 THEN 'brand_name' ELSE 'warning_prefix_is_bold' END AS field, trim(regexp_replace(value, '{_BLANK}+', ' ', 'g')) AS value, k % 2 = 0 AS b FROM r)
        SELECT field, CASE WHEN field = 'warning_prefix_is_bold' THEN b END AS value_bool, count(*) AS n, CAST(sum(CASE WHEN field <> 'warning_prefix_is_bold' THEN length(value) END) AS BIGINT) AS chars
        FROM f WHERE field = 'warning_prefix_is_bold' OR (value <> '' AND length(value) <= CASE WHEN field = 'warning_text' THEN 600 ELSE 200 END) GROUP BY ALL""",
    "admitted_requests": """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS client, list({'t': epoch_us(ts) / 1e6, 'left': 3.0, 'n': 0, 'late': 0} ORDER BY ts, event_id) AS xs FROM events GROUP BY user_id),
        s AS (SELECT client, list_reduce(list_prepend({'t': xs[1].t, 'left': 3.0, 'n': 0, 'late': 0}, xs), lambda a, x: CASE WHEN least(3.0, a.left + greatest(0.0, x.t - a.t) * (0.05 / 60)) >= 1.0
          THEN {'t': x.t, 'left': least(3.0, a.left + greatest(0.0, x.t - a.t) * (0.05 / 60)) - 1.0, 'n': a.n + 1, 'late': a.late}
          ELSE {'t': x.t, 'left': least(3.0, a.left + greatest(0.0, x.t - a.t) * (0.05 / 60)), 'n': a.n, 'late': a.late + 1} END) AS z FROM r)
        SELECT client, CAST(z.n AS BIGINT) AS admitted, CAST(z.late AS BIGINT) AS delayed FROM s""",
    "match_files": f"""WITH RECURSIVE {_walk(True)}, k AS (SELECT how, count(*) AS n FROM got GROUP BY how)
        SELECT how, n FROM k UNION ALL SELECT 'no_image', (SELECT count(DISTINCT cola_id) FROM ({A})) - (SELECT count(*) FROM got) UNION ALL SELECT 'no_record', (SELECT count(*) FROM f) - (SELECT count(*) FROM got)""",
    "match_notes": f"""WITH RECURSIVE {_walk(True)}, lost AS (SELECT page_id AS file_no, list_extract(string_split(url, '/'), -1) AS name FROM pages WHERE page_id NOT IN (SELECT file_no FROM got))
        SELECT (SELECT count(DISTINCT cola_id) FROM ({A})) - (SELECT count(*) FROM got) AS records, count(*) AS images,
               array_to_string(list(name ORDER BY file_no)[1:5], ', ') || CASE WHEN count(*) > 5 THEN '…' ELSE '' END AS first_images FROM lost""",
    "match_walk": f"WITH RECURSIVE {_walk(True)} SELECT cola_id, file_no, how FROM got",
    "match_contained_all": f"WITH RECURSIVE {_walk(False)} SELECT cola_id, file_no FROM got",
}
SQL |= {"streamed_admissions": SQL["admitted_requests"], "streamed_cap": FIRST["daily_cap"]}
