"""DuckDB SQL of the whole extraction from word boxes, by joins and windows, written from the rules."""

from __future__ import annotations

from . import derived
from .label_words import COLUMNS, LABELS, boxes_sql
from .more_oracle import ratio
from .oracle import _ALC, _FORM, _PCT, _STATES, _VOL

_NUMBER = r"^\d+(?:[.,]\d+)?$"
_BARE = rf"regexp_matches(text, '{_NUMBER}') OR regexp_matches(text, '^\d+(?:[.,]\d+)?\s*[A-Za-z.]{{1,4}}$')"
_PRODUCT = r"(?i)\b(?:product|produce)\s+of\b"
_COUNTRY = r"(?i)\b(?:product|produce)\s+of\b|\bimported\s+from\b|\bmade\s+in\b"
_VERB = "(?:bottled|distilled|blended|produced|imported|brewed|canned|packed|packaged|vinted|cellared|made|prepared|manufactured|fermented|rectified|kegged)"
_BY = rf"\b{_VERB}(?:\s*(?:,|and|&)\s*{_VERB})*\s+by\b[\s:]*"
_STATUTE = r"(?i)\b(?:surgeon|pregnancy|defects|consumption|alcoholic|beverages|impairs|machinery)\b"
_LETTERS = r"length(regexp_replace({0}, '[^\p{{L}}]', '', 'g'))"
_UPPERS = r"length(regexp_replace({0}, '[^\p{{Lu}}]', '', 'g'))"


def fuzzy(text: str, target: str, low: int, high: int, least: int) -> str:
    return f"(length({text}) BETWEEN {low} AND {high} AND {ratio(text, chr(39) + target + chr(39))} >= {least})"


def reading(words: str, pages: str) -> str:
    """CTEs up to ``obs``, a row an image, and ``corners``, a row a line.

    words: image_id, block_num, par_num, line_num, text, left, top, width, height, conf.
    pages: image_id, image_height, sharpness, deskew_deg, upscale_factor, width, height.
    """
    key = "image_id, block_num, par_num, line_num"
    near_government = fuzzy("g", "GOVERNMENT", 1, 15, 80)
    return rf"""
w AS MATERIALIZED (SELECT {key}, trim(text) AS t, "left" AS x, top AS y, "left" + width AS r, top + height AS b, height AS h, conf FROM ({words}) WHERE trim(text) <> '' AND conf >= 0),
pages AS MATERIALIZED ({pages}),
r0 AS (SELECT {key}, string_agg(t, ' ' ORDER BY x, y, t) AS text, min(x) AS x0, min(y) AS y0, max(r) AS x1, max(b) AS y1, sum(conf) AS cs, list(h) AS hs, count(*) AS n,
         list({{'t': t, 'c': conf}} ORDER BY x, y, t) AS ws, min(y) AS top0 FROM w WHERE conf >= 25 GROUP BY {key}),
tails AS (SELECT r0.image_id, r0.block_num, r0.par_num, r0.line_num, list({{'t': w.t, 'c': w.conf, 'x': w.x, 'y': w.y, 'r': w.r, 'b': w.b, 'h': w.h}} ORDER BY w.x, w.y, w.t)[1:3] AS tail
          FROM r0 JOIN w USING ({key}) WHERE w.conf < 25 AND w.x >= r0.x1 AND regexp_matches(text, '{_NUMBER}') GROUP BY ALL),
kept AS (SELECT * FROM (SELECT tails.*, text || ' ' || array_to_string(list_transform(tail, lambda z: z.t), ' ') AS longer FROM tails JOIN r0 USING ({key})) WHERE regexp_matches(longer, '{_VOL}')),
r1 AS (SELECT r0.image_id, r0.block_num, r0.par_num, r0.line_num, coalesce(longer, text) AS text, x0, top0, n,
         coalesce(least(y0, list_min(list_transform(tail, lambda z: z.y))), y0) AS top, coalesce(greatest(x1, list_max(list_transform(tail, lambda z: z.r))), x1) AS x1,
         coalesce(greatest(y1, list_max(list_transform(tail, lambda z: z.b))), y1) AS bottom, list_sort(list_concat(hs, coalesce(list_transform(tail, lambda z: z.h), []))) AS hs,
         (cs + coalesce(list_sum(list_transform(tail, lambda z: z.c)), 0)) / (n + coalesce(len(tail), 0)) AS conf, list_concat(ws, coalesce(list_transform(tail, lambda z: {{'t': z.t, 'c': z.c}}), [])) AS ws
       FROM r0 LEFT JOIN kept USING ({key})),
l0 AS MATERIALIZED (SELECT *, hs[CAST(floor(len(hs) / 2) AS INT) + 1] AS height, row_number() OVER (PARTITION BY image_id ORDER BY top0, x0, block_num, par_num, line_num) AS no, upper(text) AS up,
         coalesce({_STATES}, false) AS states, regexp_matches(text, '{_VOL}') AS volume, regexp_matches(text, '{_FORM}') AS form, regexp_matches(text, '{_PCT}') AS pct, regexp_matches(text, '{_ALC}') AS alc,
         {_LETTERS.format("text")} > 0 AND {_UPPERS.format("text")} >= 0.6 * {_LETTERS.format("text")} AS caps, conf < 80 OR length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) <= 3 AS hardly FROM r1),
l1 AS (SELECT *, array_to_string(regexp_split_to_array(up, '\s+')[1:2], ' ') AS head, list_filter(string_split(regexp_replace(up, '[^A-Z]+', ' ', 'g'), ' '), lambda z: z <> '') AS ends FROM l0),
l2 AS (SELECT *, (contains(up, 'GOVERNMENT') AND contains(up, 'WARNING')) OR {fuzzy("head", "GOVERNMENT WARNING", 12, 26, 82)} AS opens, array_to_string(ends[-2:], ' ') AS last2 FROM l1),
l3 AS (SELECT *, contains(up, 'HEALTH PROBLEMS') OR (len(ends) >= 2 AND {fuzzy("last2", "HEALTH PROBLEMS", 11, 20, 85)}) AS closes, min(no) FILTER (opens) OVER (PARTITION BY image_id) AS start FROM l2),
l4 AS (SELECT *, max(CASE WHEN no = start THEN height END) OVER (PARTITION BY image_id) AS base, lag(bottom) OVER o AS above, lag(closes) OVER o AS closed, lead(top) OVER o AS below_top
       FROM l3 WINDOW o AS (PARTITION BY image_id ORDER BY no)),
l5 AS (SELECT *, coalesce(no >= start AND no < coalesce(min(no) FILTER (no > start AND (height > base * 1.8 OR top - above > base * 2.5 OR closed)) OVER (PARTITION BY image_id), 2000000000), false) AS warned FROM l4),
c AS (SELECT l5.*, NOT warned AND top < greatest(max(bottom) OVER (PARTITION BY image_id), coalesce(image_height, 0)) * 0.55 AND NOT states AND NOT volume AND NOT form AND conf >= 50 AS cand FROM l5 JOIN pages USING (image_id)),
b AS (SELECT image_id, no AS bno, height AS bh, caps AS bcaps FROM c WHERE cand QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY height DESC, no) = 1),
j AS (SELECT c.*, bno, bh, NOT warned AND abs(height - bh) <= bh * 0.12 AND caps = bcaps AS same FROM c LEFT JOIN b USING (image_id)),
k AS (SELECT *, max(no) FILTER (no < bno AND NOT coalesce(same AND below_top - bottom <= bh * 1.2, false)) OVER (PARTITION BY image_id) AS cut_up,
        min(no) FILTER (no > bno AND NOT coalesce(same AND top - above <= bh * 1.2, false)) OVER (PARTITION BY image_id) AS cut_down FROM j),
m AS (SELECT *, coalesce(bno IS NOT NULL AND no > coalesce(cut_up, 0) AND no < coalesce(cut_down, 2000000000), false) AS in_brand FROM k),
q AS MATERIALIZED (SELECT *, coalesce(cand AND no > max(no) FILTER (in_brand) OVER (PARTITION BY image_id) AND height < bh * 0.92, false) AS below FROM m),
words_of AS (SELECT image_id, count(*) FILTER (conf >= 25) AS n, count(*) FILTER (conf < 25) AS weak FROM w GROUP BY image_id),
p0 AS (SELECT image_id, nullif(string_agg(text, ' ' ORDER BY no) FILTER (in_brand), '') AS brand, (list(text ORDER BY no) FILTER (below))[1] AS cls, (list(text ORDER BY no) FILTER (below))[2] AS cls2,
         coalesce(min_by(text, no) FILTER (NOT warned AND pct AND alc), min_by(text, no) FILTER (NOT warned AND states), min_by(text, no) FILTER (NOT warned AND form)) AS alcohol,
         coalesce(min_by(regexp_extract(text, '{_VOL}(?:.*{_VOL[4:]})?'), no) FILTER (NOT warned AND volume), min_by(text, no) FILTER (NOT warned AND ({_BARE}))) AS net,
         coalesce(min_by(text, no) FILTER (NOT warned AND regexp_matches(text, '{_PRODUCT}')), min_by(text, no) FILTER (NOT warned AND regexp_matches(text, '{_COUNTRY}'))) AS country,
         coalesce(max(bh) / nullif(list_sort(list(height) FILTER (NOT warned AND NOT in_brand))[CAST(floor(count(*) FILTER (NOT warned AND NOT in_brand) / 2) AS INT) + 1], 0), 0) AS dominance,
         min(start) AS start, min(height) FILTER (warned) AS glyph, avg(conf) FILTER (warned) AS wconf FROM q GROUP BY image_id),
p1 AS (SELECT pages.*, p0.* EXCLUDE (image_id), coalesce(n, 0) AS n, coalesce(weak, 0) AS weak FROM pages LEFT JOIN p0 USING (image_id) LEFT JOIN words_of USING (image_id)),
p2 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN n > 0 AND (dominance < 1.55 OR n < 10) THEN NULL ELSE brand END AS brand), n > 0 AND (dominance < 1.55 OR n < 10) AS degraded FROM p1),
left_over AS MATERIALIZED (SELECT q.*, regexp_extract(text, '(?i)^(.*?{_BY})', 1) AS phrase FROM q JOIN p2 USING (image_id)
         WHERE NOT warned AND text IS DISTINCT FROM brand AND text IS DISTINCT FROM cls AND text IS DISTINCT FROM alcohol AND text IS DISTINCT FROM net),
says AS (SELECT image_id, no, trim(phrase) AS phrase, trim(text[length(phrase) + 1:]) AS rest FROM left_over WHERE regexp_matches(text, '(?i){_BY}') AND NOT regexp_matches(text, '{_STATUTE}') QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY no) = 1),
after AS (SELECT says.image_id, list(text ORDER BY x.no) AS ts FROM says JOIN left_over x ON x.image_id = says.image_id AND x.no IN (says.no + 1, says.no + 2) GROUP BY says.image_id),
said AS (SELECT image_id, phrase, CASE WHEN rest <> '' THEN rest ELSE ts[1] END AS whole, CASE WHEN rest <> '' THEN ts[1] ELSE ts[2] END AS more FROM says LEFT JOIN after USING (image_id)),
ending AS (SELECT image_id, max(no) AS e FROM left_over WHERE states OR volume GROUP BY image_id),
block AS (SELECT image_id, list(text ORDER BY no) AS ts FROM left_over LEFT JOIN ending USING (image_id) WHERE no > coalesce(e, 0) AND no < coalesce(start, 2000000000) AND NOT pct AND NOT volume
          AND NOT regexp_matches(text, '{_COUNTRY}') AND regexp_matches(text, '[A-Za-z]{{2,}}') AND NOT hardly AND NOT regexp_matches(text, '{_STATUTE}') GROUP BY image_id),
bare AS (SELECT image_id, phrase, whole, nullif(regexp_replace(regexp_replace(CASE WHEN contains(whole, ',') THEN whole[instr(whole, ',') + 1:] END, '^[ ,]+', ''), '[ ,]+$', ''), '') AS own,
           nullif(regexp_replace(regexp_replace(CASE WHEN contains(more, ',') THEN more END, '^[ ,]+', ''), '[ ,]+$', ''), '') AS next FROM said),
p3 AS MATERIALIZED (SELECT p2.*, CASE WHEN whole IS NOT NULL THEN trim(phrase || ' ' || trim(split_part(whole, ',', 1))) ELSE ts[1] END AS bottler, CASE WHEN whole IS NOT NULL THEN coalesce(own, next) ELSE ts[2] END AS address
       FROM p2 LEFT JOIN bare USING (image_id) LEFT JOIN block USING (image_id)),
heads AS (SELECT image_id, no, (SELECT min(i) FROM (SELECT unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(ws, lambda z: regexp_replace(regexp_replace(upper(z.t), '^[:;,.]+', ''), '[:;,.]+$', ''))) AS g) WHERE {near_government}) AS i, ws, text FROM q WHERE no = start),
statement AS (SELECT q.image_id, string_agg(CASE WHEN q.no = q.start AND i IS NOT NULL THEN array_to_string(list_transform(q.ws[i:], lambda z: z.t), ' ') ELSE q.text END, ' ' ORDER BY q.no) AS said,
              flatten(list(list_transform(list_filter(q.ws, lambda z: z.c < 60), lambda z: z.t) ORDER BY q.no)) AS doubt, min(q.x0) AS x0, min(q.top) AS y0, max(q.x1) AS x1, max(q.bottom) AS y1
              FROM q LEFT JOIN heads ON heads.image_id = q.image_id AND heads.no = q.no WHERE warned GROUP BY q.image_id),
marks AS (SELECT image_id, list(t ORDER BY y, x, r, b, t) AS ts FROM w JOIN statement s USING (image_id) WHERE conf < 25 AND x >= s.x0 AND r <= s.x1 AND y >= s.y0 AND b <= s.y1 GROUP BY image_id),
vals AS (SELECT image_id, unnest([brand, cls, alcohol, net, country, bottler, address]) AS v FROM p3),
unread AS (SELECT image_id, list(text ORDER BY no)[1:5] AS ts FROM q WHERE NOT warned AND hardly AND NOT EXISTS (SELECT 1 FROM vals WHERE vals.image_id = q.image_id AND v IS NOT NULL AND (contains(text, v) OR (length(text) > 3 AND contains(v, text)))) GROUP BY image_id),
obs AS MATERIALIZED (SELECT p3.*, said, list_concat(coalesce(doubt, []), coalesce(marks.ts, [])) AS unsure, coalesce(unread.ts, []) AS unread,
         CASE WHEN said IS NOT NULL THEN CASE WHEN wconf >= 75 AND glyph >= 12 THEN 'read' ELSE 'illegible' END WHEN weak > 0 OR degraded THEN 'illegible' ELSE 'absent' END AS legibility
       FROM p3 LEFT JOIN statement USING (image_id) LEFT JOIN marks USING (image_id) LEFT JOIN unread USING (image_id))"""


def boxes() -> str:
    """CTEs behind ``reading``: ``corners`` (image_id, field, pixel corners) and ``shown``, with turn and enlargement undone."""
    named = {"class_type": "cls", "alcohol_content": "alcohol", "net_contents": "net", "bottler_name": "bottler", "bottler_address": "address", "country_of_origin": "country"}
    fields = "[" + ", ".join(f"{{'f': '{f}', 'v': {c}}}" for f, c in named.items()) + "]"
    points = ((0, "x0", "y0"), (1, "x1", "y0"), (2, "x1", "y1"), (3, "x0", "y1"))
    px = "(({x} / s - cx) * c - ({y} / s - cy) * z + width / 2) / width"
    py = "(({x} / s - cx) * z + ({y} / s - cy) * c + height / 2) / height"
    clip = lambda e: f"round(least(greatest({e}, 0.0), 1.0), 4)"
    return rf"""
f AS (SELECT image_id, u.f AS field, u.v AS v FROM (SELECT image_id, unnest({fields}) AS u FROM obs) WHERE u.v IS NOT NULL),
parts AS (SELECT q.*, max(q.height) OVER (PARTITION BY image_id) AS tallest FROM q JOIN obs USING (image_id) WHERE contains(brand, text)),
corners AS (
  SELECT image_id, 'brand_name' AS field, min(x0) AS x0, min(top) AS y0, max(x1) AS x1, max(bottom) AS y1 FROM parts WHERE height >= tallest * 0.85 GROUP BY image_id
  UNION ALL SELECT image_id, field, x0, top, x1, bottom FROM (SELECT f.image_id, field, q.* EXCLUDE (image_id) FROM f JOIN q USING (image_id) WHERE contains(text, v) OR contains(v, text) QUALIFY row_number() OVER (PARTITION BY f.image_id, field ORDER BY no) = 1)
  UNION ALL SELECT image_id, 'government_warning', min(x0), min(top), max(x1), max(bottom) FROM q WHERE warned GROUP BY image_id
  UNION ALL SELECT q.image_id, 'warning_typography', min(w.x), min(w.y), max(w.r), max(w.b) FROM q JOIN w ON w.image_id = q.image_id AND w.block_num = q.block_num AND w.par_num = q.par_num AND w.line_num = q.line_num
      WHERE q.no = q.start AND w.conf >= 25 AND upper(trim(regexp_replace(regexp_replace(w.t, '^:+', ''), ':+$', ''))) IN ('GOVERNMENT', 'WARNING') GROUP BY q.image_id),
turns AS (SELECT image_id, width, height, coalesce(upscale_factor, 1) AS s, CASE WHEN abs(deskew_deg) >= 0.5 THEN cos(radians(deskew_deg)) ELSE 1 END AS c, CASE WHEN abs(deskew_deg) >= 0.5 THEN sin(radians(deskew_deg)) ELSE 0 END AS z FROM pages WHERE width IS NOT NULL),
halves AS (SELECT *, (abs(c) * width + abs(z) * height) / 2 AS hw, (abs(z) * width + abs(c) * height) / 2 AS hh FROM turns),
sized AS (SELECT *, (ceil(round(width / 2 + hw, 9)) - floor(round(width / 2 - hw, 9))) / 2 AS cx, (ceil(round(height / 2 + hh, 9)) - floor(round(height / 2 - hh, 9))) / 2 AS cy FROM halves),
padded AS (SELECT corners.image_id, field, x0 - 6 AS x0, y0 - 6 AS y0, x1 + 6 AS x1, y1 + 6 AS y1, sized.* EXCLUDE (image_id) FROM corners JOIN sized USING (image_id)),
shown AS (SELECT image_id, field, {", ".join(f"{clip(e.format(x=x, y=y))} AS {n}{k}" for k, x, y in points for n, e in (("px", px), ("py", py)))} FROM padded)"""


_WORDS = derived.WORDS.format(words=derived.DUCK_WORDS)
DOC_PAGES = "SELECT CAST(doc_id AS VARCHAR) AS image_id, 400 AS image_height, 80.0 AS sharpness, CAST((doc_id % 7 - 3) * 0.9 AS DOUBLE) AS deskew_deg, CAST(1 + doc_id % 3 * 0.5 AS DOUBLE) AS upscale_factor, CAST(900 + doc_id % 5 * 100 AS INT) AS width, CAST(700 + doc_id % 4 * 150 AS INT) AS height FROM documents"
_SEEN = "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS image_id, 400 AS image_height, 80.0 AS sharpness, NULL AS deskew_deg, NULL AS upscale_factor, NULL AS width, NULL AS height FROM documents WHERE regexp_matches(text, '[^ \\n]')"
_LABEL_WORDS = f"SELECT CAST(o_orderkey AS VARCHAR) AS image_id, 1 AS block_num, 1 AS par_num, line_num, text, left0 AS \"left\", top, width, height, conf FROM orders JOIN {boxes_sql()} AS x ON o_orderkey % {len(LABELS)} = k"
_LABEL_PAGES = "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, 1000 AS image_height, 80.0 AS sharpness, CAST(NULL AS DOUBLE) AS deskew_deg, CAST(NULL AS DOUBLE) AS upscale_factor, NULL AS width, NULL AS height FROM orders"
_NAMES = "[" + ", ".join(f"'{n}'" for n in LABELS) + "]"
_SHOWN = {
    "brand_name": "brand", "class_type": "cls", "class_type_next": "cls2", "alcohol_statement": "alcohol", "net_contents": "net", "bottler_name": "bottler", "bottler_address": "address", "country_of_origin": "country",
    "warning_text": "said", "warning_legibility": "legibility", "warning_small_type": "coalesce(glyph < 12, false)", "degraded": "degraded", "unsure": "array_to_string(unsure, ',')", "unread": "array_to_string(unread, ',')",
    "brand_conf": "CASE WHEN degraded THEN 0.0 ELSE (SELECT round(conf, 1) FROM q WHERE q.image_id = obs.image_id AND (contains(text, brand) OR contains(brand, text)) ORDER BY no LIMIT 1) END",
    "notes": "array_to_string(list_filter([CASE WHEN legibility = 'illegible' AND (said IS NOT NULL OR weak > 0) THEN 'small_print_unread' END, CASE WHEN n > 0 AND n < 10 THEN 'few_words' WHEN degraded THEN 'no_dominant_brand' END], lambda z: z IS NOT NULL), ',')",
    "error": "CASE WHEN n = 0 THEN 'no_words' END",
}

SQL = {
    "layout_observations": f"""WITH {reading(_WORDS, _SEEN)}
SELECT image_id, brand AS brand_name, cls AS class_type, alcohol AS alcohol_statement, net AS net_contents, bottler AS bottler_name, country AS country_of_origin, legibility AS warning_legibility,
       CAST(n AS BIGINT) AS words_read, degraded, CAST(len(unread) AS INT) AS n_unread FROM obs""",
    "layout_labels": f"""WITH {reading(_LABEL_WORDS, _LABEL_PAGES)}
SELECT {_NAMES}[CAST(CAST(image_id AS BIGINT) % {len(LABELS)} AS INT) + 1] AS label, {", ".join(f"{_SHOWN[c]} AS {c}" for c in COLUMNS)}, count(*) AS n FROM obs GROUP BY ALL""",
    "field_boxes": f"""WITH {reading(_WORDS, DOC_PAGES)}, {boxes()}
SELECT * FROM shown""",
    "review_payloads": f"""WITH {reading(_WORDS, DOC_PAGES)}, {boxes()}, own AS (SELECT *, CAST(image_id AS BIGINT) AS k FROM obs)
SELECT image_id AS cola_id, CASE WHEN degraded THEN 'flag' ELSE 'pass' END AS verdict, CAST(n AS BIGINT) AS elapsed_ms, 'brand_name' AS field,
       array_to_string(list_filter([CASE WHEN abs(deskew_deg) >= 0.5 THEN 'straightened' END, CASE WHEN upscale_factor > 1.05 THEN 'enlarged' END, CASE WHEN legibility = 'illegible' AND (said IS NOT NULL OR weak > 0) THEN 'small_print_unread' END,
         CASE WHEN n > 0 AND n < 10 THEN 'few_words' WHEN degraded THEN 'no_dominant_brand' END], lambda z: z IS NOT NULL), ',') AS notes,
       (SELECT count(*) FROM shown WHERE shown.image_id = own.image_id) AS n_boxes, (SELECT py2 FROM shown WHERE shown.image_id = own.image_id AND field = 'net_contents') AS net_bottom,
       CASE WHEN k % 4 = 0 THEN true END AS pending, CASE WHEN k % 4 = 1 THEN 'net_contents' END AS cleared, CASE WHEN k % 4 = 1 THEN k % 8 = 1 END AS unavailable, height, deskew_deg, k % 2 = 0 AS cache_hit,
       CASE WHEN k % 4 < 2 THEN 'reader' END AS model FROM own""",
}
