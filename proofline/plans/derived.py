"""Label tables derived from the driver's tables.

Each derivation is one SQL text that Spark and DuckDB both run, so a query and its
check start from the same rows. Every row of the source table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import STATEMENT

APPLICATIONS = """
SELECT CAST(p_partkey AS STRING) AS cola_id, p_name AS brand_name, p_size AS size, p_partkey AS k,
       CASE p_partkey % 6 WHEN 0 THEN 'Kentucky Straight Bourbon Whiskey' WHEN 1 THEN 'Table Wine' WHEN 2 THEN 'India Pale Ale'
            WHEN 3 THEN 'London Dry Gin' WHEN 4 THEN 'Special Reserve' ELSE 'Bourbon Barrel Aged Stout' END AS class_type,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(5 + p_size AS DOUBLE) END AS alcohol_content_pct,
       CASE p_partkey % 7 WHEN 0 THEN '750 mL' WHEN 1 THEN '0.75 L' WHEN 2 THEN '75 cl' WHEN 3 THEN '12 FL OZ' WHEN 4 THEN '1/2 GALLON'
            WHEN 5 THEN '1,000 mL' ELSE NULL END AS net_contents,
       CASE p_partkey % 3 WHEN 0 THEN 'Bottled by ' || s_name || ' Distilling Co.' WHEN 1 THEN s_name || ' Spirits' ELSE s_name END AS bottler_name,
       'Town ' || n_name AS bottler_address,
       CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Product of the United States' WHEN 2 THEN 'Product of Scotland' ELSE 'Made in ' || n_name END AS country_of_origin
FROM part JOIN supplier ON s_suppkey = p_partkey % 10 JOIN nation ON n_nationkey = s_nationkey"""

OBSERVATIONS = f"""
SELECT a.cola_id, l_orderkey, l_linenumber, m,
       CASE m WHEN 0 THEN upper(brand_name) WHEN 1 THEN NULL WHEN 2 THEN brand_name || ' reserve' ELSE brand_name END AS brand_name,
       CASE m WHEN 4 THEN upper(class_type) WHEN 7 THEN NULL ELSE class_type END AS class_type,
       CASE m WHEN 3 THEN CAST((5 + size) * 10 AS STRING) || '% Alc./Vol.'
              WHEN 4 THEN CAST(5 + size AS STRING) || '% Alc./Vol. (' || CAST(2 * (5 + size) + 1 AS STRING) || ' Proof)'
              WHEN 5 THEN NULL
              WHEN 6 THEN CAST(6 + size AS STRING) || '% Alc./Vol. (' || CAST(2 * (5 + size) AS STRING) || ' Proof)'
              WHEN 7 THEN CAST(5 + size AS STRING) || ' percent'
              WHEN 8 THEN 'Alc./Vol. unread'
              WHEN 9 THEN CAST(7 + size AS STRING) || '% Alc/Vol'
              ELSE CAST(5 + size AS STRING) || '% Alc./Vol. (' || CAST(2 * (5 + size) AS STRING) || ' Proof)' END AS alcohol_statement,
       CASE m WHEN 10 THEN NULL WHEN 11 THEN '790 mL' WHEN 12 THEN '12 fl. oz.' WHEN 2 THEN '355 mL' WHEN 8 THEN 'about a pinch'
              ELSE coalesce(net_contents, '750 mL') END AS net_contents,
       bottler_name, bottler_address,
       CASE m WHEN 1 THEN NULL WHEN 5 THEN 'Product of' WHEN 6 THEN 'Product of Canada' ELSE country_of_origin END AS country_of_origin,
       CASE m WHEN 1 THEN NULL WHEN 3 THEN 'Government Warning:' || substr('{STATEMENT}', 20) WHEN 4 THEN upper('{STATEMENT}')
              WHEN 5 THEN replace('{STATEMENT}', '. (2)', '.  (2)') WHEN 6 THEN '{STATEMENT}' || ' Please recycle'
              WHEN 7 THEN replace('{STATEMENT}', ', and may', ' and may') ELSE '{STATEMENT}' END AS warning_text,
       CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false ELSE NULL END AS warning_prefix_is_bold,
       l_tax > 0.075 AS warning_small_type,
       CASE WHEN m = 1 AND l_linestatus = 'O' THEN 'illegible' WHEN m = 1 THEN 'absent' ELSE 'read' END AS warning_legibility,
       round(100 - 400 * l_discount) AS confidence,
       l_orderkey % 19 = 0 AS image_soft
FROM (SELECT *, (l_orderkey + l_linenumber) % 13 AS m FROM lineitem) AS l JOIN ({APPLICATIONS}) AS a ON a.k = l_partkey"""

#: Raw record rows, some broken: every part twice, the second time in another file position.
RAW_RECORDS = """
SELECT CAST(row_no AS INT) AS row_no, ttb_id, id, brand, abv FROM (
  SELECT 2 * p_partkey + 1 AS row_no, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE 'T-' || CAST(p_partkey % 1000 AS STRING) END AS ttb_id,
         CASE WHEN p_partkey % 22 = 0 THEN NULL ELSE 'X-' || CAST(p_partkey AS STRING) END AS id,
         CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_name END AS brand,
         CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS STRING) || '%' WHEN 1 THEN CAST(p_size AS STRING) || ',5' WHEN 2 THEN CAST(p_size * 10 AS STRING)
              WHEN 3 THEN 'strong' ELSE '' END AS abv
  FROM part
  UNION ALL
  SELECT 2 * p_partkey + 2, 'T-' || CAST(p_partkey % 1000 AS STRING), NULL, p_brand, '40 %' FROM part) AS r"""

#: Outcomes of an evaluation, from the event stream.
OUTCOMES = """
SELECT CAST(event_id AS STRING) AS id,
       CASE event_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'flag' ELSE 'fail' END AS expected,
       CASE WHEN event_id % 41 = 0 THEN 'error' WHEN event_type = 'click' THEN 'flag'
            WHEN event_type = 'error' THEN 'pass' WHEN event_id % 7 = 0 THEN 'flag'
            ELSE CASE event_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'flag' ELSE 'fail' END END AS actual,
       CASE WHEN event_id % 41 = 0 THEN 'unreadable' END AS error,
       CAST(floor(value * 10) AS BIGINT) AS total_ms, CASE WHEN user_id % 2 = 0 THEN 'rendered' ELSE 'ai' END AS fixture_set,
       CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(event_id % 20 AS DOUBLE) / 20 END AS triage_p,
       event_id % 53 = 0 AS wrong, event_id % 6 = 0 AS second_reading_called,
       CASE WHEN event_id % 12 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 8192 END AS cost_usd, event_id % 24 = 0 AS was_cleared,
       'd' || CAST(event_id % 15 AS STRING) AS degradation, ts, user_id, event_id
FROM events"""

#: Observation documents: whole, blank, wrong types, broken.
RAW_OBSERVATIONS = (
    '{"brand_name": " Old Tom ", "net_contents": "750 mL", "warning_prefix_is_bold": true, "warning_text": "GOVERNMENT WARNING:", "field_confidence": {"brand_name": 91.5}, "field_boxes": {"brand_name": [[0, 0], [1, 0], [1, 1], [0, 1]]}}',
    '{"brand_name": "   ", "net_contents": null, "warning_small_type": true, "unread_text": ["TL", " "], "image_soft": true}',
    '{"brand_name": 17, "warning_prefix_is_bold": "yes", "field_confidence": {"brand_name": "high", "class_type": 60}, "warning_legibility": "illegible"}',
    '{"field_boxes": {"brand_name": [[0, 0], [2, 0], [1, 1], [0, 1]], "net_contents": [[0, 0], [1, 1]]}, "warning_legibility": "odd", "warning_text": "x"}',
    '{"brand_name": "cut',
    '{}',
)

#: A word table, from the documents: the first words of each line, places from their positions.
WORDS = """
SELECT CAST(doc_id AS STRING) AS image_id, 1 AS block_num, 1 AS par_num, CAST(ln AS INT) AS line_num,
       CASE WHEN (ln * 7 + w) % 29 = 0 THEN word || ' 40%' WHEN (ln * 5 + w) % 31 = 0 THEN '750 mL' ELSE word END AS text,
       CAST(w * 50 AS INT) AS "left", CAST(ln * 30 AS INT) AS top, CAST(40 AS INT) AS width, CAST(10 + (doc_id * 13 + ln * 7 + w * 3) % 25 AS INT) AS height,
       CAST((doc_id * 7 + ln * 11 + w * 17) % 102 - 1 AS DOUBLE) AS conf
FROM {words} AS x"""
SPARK_WORDS = "SELECT doc_id, ln, w, word FROM (SELECT doc_id, ln, posexplode(split(line, ' ')) AS (w, word) FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (ln, line) FROM documents)) WHERE word <> ''"
DUCK_WORDS = (
    "(SELECT doc_id, ln, unnest(range(0, len(ws))) AS w, unnest(ws) AS word FROM (SELECT doc_id, ln, string_split(line, ' ') AS ws FROM "
    "(SELECT doc_id, unnest(range(0, len(ls))) AS ln, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))"
)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A derivation over the tables it names."""
    frames = tables(spark, sf_dir, *names)
    for n in names:  # names of tables become references to the frames
        sql = _swap(sql, n)
    return spark.sql(sql, **frames)


def _swap(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, APPLICATIONS, "part", "supplier", "nation")


def observations(spark: SparkSession, sf_dir: str, dealt_by_id: bool = False) -> DataFrame:
    """The derivation, with the applications as a frame, so that the join can be told to hold them and let the line items stream by unsorted.

    dealt_by_id: they meet by ``cola_id``, which is the part's key as text, so a join of the
    readings by it deals out nothing again; both sides' applications are then held at once.
    """
    apps = applications(spark, sf_dir).hint("shuffle_hash")
    lines = tables(spark, sf_dir, "lineitem")["lineitem"]
    sql = _swap(OBSERVATIONS.replace(f"({APPLICATIONS})", "{apps}"), "lineitem")
    if dealt_by_id:
        sql = sql.replace("ON a.k = l_partkey", "ON a.cola_id = CAST(l_partkey AS STRING)")
    return spark.sql(sql, lineitem=lines, apps=apps)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, OUTCOMES, "events")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RAW_RECORDS, "part")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = f"({SPARK_WORDS})"
    return derived(spark, sf_dir, WORDS.format(words=inner).replace('"left"', "`left`"), "documents")
