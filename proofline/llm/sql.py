"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


def contamination(docs: str = "documents", items: str = "benchmark", span: int = 10) -> str:
    words = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM {docs}),
b AS (SELECT item_id, w, least(len(w), {span}) AS k FROM (SELECT item_id, {words} AS w FROM {items}) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
             FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)"""


def covered_words(size: str) -> str:
    """Words of each document in windows of ``size`` words that it has twice or more."""
    return f"""
SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + size)) AS p FROM (
    SELECT doc_id, i, size, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
      SELECT doc_id, i, size, hash(w[i:i + size - 1]) AS g FROM (
        SELECT doc_id, w, {size} AS size, unnest(range(1, len(w) - {size} + 2)) AS i FROM t WHERE len(w) >= {size}))) WHERE n > 1) GROUP BY doc_id"""


def quality(docs: str = "documents", min_words: int = 50, min_repeat: int = 8, max_covered: int = 40, max_longest: int = 30) -> str:
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, {BLANK_WORDS} AS w FROM {docs}),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM t)
          WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
three AS ({covered_words("3")}),
many AS ({covered_words(str(min_repeat))}),
longest AS ({covered_words(f"greatest({min_repeat}, ({max_longest} * len(w)) // 100 + 1)")}),
r AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(three.n, 0) AS BIGINT) AS n_repeat_words, coalesce(many.n, 0) AS n_covered, longest.n IS NOT NULL AS too_long
      FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN three USING (doc_id) LEFT JOIN many USING (doc_id) LEFT JOIN longest USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {min_words} OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered <= {max_covered} * n_words AND NOT too_long AS kept
FROM r"""


def chats(turns: str = "conversations", own: str = "<|im_end|><|im_start|>assistant ok") -> str:
    """Of the template ``<|im_start|>role\\ntext<|im_end|>\\n``: 25 characters of its own a turn."""
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {turns}
           UNION ALL SELECT -1, t, r, '{own}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
x AS (SELECT *, replace(replace(text, '~', '~0'), '<|', '~1') AS body, replace(replace(replace(role, '~', '~0'), '<|', '~1'), chr(10), '~2') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 24) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id"""


def passages(docs: str = "documents", size: int = 50) -> str:
    return f"""
WITH t AS (SELECT doc_id, {BLANK_WORDS} AS w FROM {docs}),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {size - 1}], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size} + 2)) AS i FROM t WHERE len(w) >= {size})),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS owner FROM win) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {size})) AS p FROM hit),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS x FROM (
           SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM t LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def near_dups(docs: str = "documents", size: int = 3, percent: int = 85) -> str:
    words = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), [])"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, {words} AS w FROM {docs}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, least(len(w), {size}) AS k, unnest(range(1, len(w) - least(len(w), {size}) + 2)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM t UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, t.doc_id = c AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)"""


#: Checksums (crc32) of UTF-8 texts whose characters are below code point 256: the table by rule, then a fold over bytes.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"


def crc32(text: str, table: str) -> str:
    bytes_ = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] WHEN unicode(c) < 192 THEN [194, unicode(c)] ELSE [195, unicode(c) - 64] END))"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, {table}[CAST(xor(c, b) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def spellings(docs: str = "documents", letters: int = 6, least: int = 5, times: int = 5, one_in: int = 199) -> str:
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM {docs}) WHERE length(run) >= {letters} GROUP BY ALL),
h AS (SELECT run, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run", "t")} AS h FROM runs, crc),
altered AS (SELECT CASE WHEN h % {one_in} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= {letters} GROUP BY word HAVING sum(n) >= {least}),
cut AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT x.word, y.word AS other FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
         UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = cut.rest
         UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = cut.rest),
ranked AS (SELECT near.word, count(*) OVER (PARTITION BY near.word) AS n_near, other, w.n AS other_n,
             row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, encode(other)) AS k FROM near JOIN words w ON w.word = near.other),
found AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {times} * n THEN other END AS form, CASE WHEN other_n >= {times} * n THEN other_n END AS form_n
          FROM words LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON r.word = words.word),
walk AS (SELECT word, word AS last FROM found UNION ALL SELECT walk.word, found.form FROM walk JOIN found ON found.word = walk.last WHERE found.form IS NOT NULL)
SELECT found.word, form, last AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM found JOIN (SELECT walk.word, walk.last FROM walk JOIN found ON found.word = walk.last WHERE found.form IS NULL) e ON e.word = found.word"""


def line_dedup(docs: str = "documents", least: int = 20, least_docs: int = 3) -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH l AS MATERIALIZED (SELECT doc_id, p, line, translate(trim(line, {blanks}), '{UPPER}', '{LOWER}') AS key
           FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}))),
shared AS (SELECT key, max(doc_id) AS owner FROM l WHERE length(key) >= {least} GROUP BY key HAVING count(DISTINCT doc_id) >= {least_docs}),
marked AS (SELECT doc_id, p, line, shared.key IS NOT NULL AND doc_id <> owner AS gone FROM l LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
