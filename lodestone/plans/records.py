"""Queries over the general record operators (problems 1, 5 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import hotkeys, nested, packed
from lodestone.sources.tables import load

HEAVY_SHARE = 0.03


def _review_states(spark: SparkSession, d: str) -> DataFrame:
    reviews = load(spark, d, "review").select("review_id", "user_id", "business_id", "stars", "ingested_at")
    return hotkeys.key_states(hotkeys.latest_records(reviews, "review_id", ["user_id", "business_id", "stars"], "ingested_at"), ["business_id", "user_id"], "stars")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_keys(_review_states(spark, d), HEAVY_SHARE).select("field_name", "key_id")


def p1_key_averages(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_averages(_review_states(spark, d)).withColumn("avg_value", F.round("avg_value", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a = packed.unpack(load(spark, d, "business"), "business_id", "categories").select(F.lit("categories").alias("field_name"), "record_id", "pos", "item")
    b = packed.unpack(load(spark, d, "yelp_user"), "user_id", "friends", nothing=("None",), blanks=True).select(F.lit("friends").alias("field_name"), "record_id", "pos", "item")
    return a.unionByName(b)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.flatten(load(spark, d, "business").select("business_id", "attributes"), "business_id", "attributes")
    return nested.node_paths(rows).select(F.col("record_id").alias("business_id"), "node_path")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the flat tables, inlined columns as JSON text; flat_tables gives each table with columns of its own."""
    rows = nested.flatten(load(spark, d, "business").select("business_id", "attributes"), "business_id", "attributes")
    return rows.drop("twins").withColumn("columns", F.to_json("columns")).withColumnRenamed("record_id", "business_id")


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the flat tables' rows, and how many columns each row has."""
    rows = nested.flatten(load(spark, d, "business").select("business_id", "attributes"), "business_id", "attributes")
    return rows.select(F.col("record_id").alias("business_id"), "table_name", "row_path", "parent_table", "parent_path", "ordinal", F.size("columns").alias("n_columns"))


_LATEST = """WITH r AS (SELECT review_id, user_id, business_id, stars FROM review WHERE review_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY ingested_at DESC NULLS LAST, user_id DESC NULLS LAST, business_id DESC NULLS LAST, stars DESC NULLS LAST) = 1),
k AS (SELECT 'business_id' AS field_name, business_id AS key_id, stars FROM r UNION ALL SELECT 'user_id', user_id, stars FROM r) """

#: White space parts friends, whose values have none, and belongs to the values of categories.
_FIELD = r"""'[\s\x{00a0}]*"[^"]*(?:""[^"]*)*"[\s\x{00a0}]*|[^,;|、，\n\r\t]+'"""
_MEMBER = r"""'"[^"\\]*(?:\\.[^"\\]*)*"|''[^''\\]*(?:\\.[^''\\]*)*''|[^,\s][^,]*'"""
_P5 = rf"""WITH t AS (
  SELECT 'categories' AS field_name, business_id AS record_id, regexp_replace(categories, '^\s+|\s+$', '', 'g') AS v FROM business
  UNION ALL SELECT 'friends', user_id, regexp_replace(friends, '^\s+|\s+$', '', 'g') FROM yelp_user),
u AS (SELECT field_name, record_id, v[1] = '[' AS listed,
        CASE WHEN v[1] = '[' THEN regexp_extract_all(regexp_replace(v, '^\[|\]$', '', 'g'), {_MEMBER}) WHEN field_name = 'friends' THEN regexp_extract_all(v, '"[^"]+"|[^\s",;|、，]+') ELSE regexp_extract_all(v, {_FIELD}) END AS raw
      FROM t WHERE v <> '' AND NOT (field_name = 'friends' AND v = 'None')),
w AS (SELECT field_name, record_id, listed, unnest(raw) AS tok, generate_subscripts(raw, 1) AS i FROM u),
x AS (SELECT field_name, record_id, i, listed, regexp_replace(tok, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g') AS tok FROM w),
y AS (SELECT field_name, record_id, i, trim(CASE
        WHEN listed AND tok[1] = '"' THEN json_extract_string('[' || tok || ']', '$[0]')
        WHEN listed AND tok[1] = '''' THEN regexp_replace(tok[2:-2], '\\(.)', '\1', 'g')
        WHEN NOT listed AND length(tok) > 1 AND tok[1] = '"' AND tok[-1] = '"' THEN replace(tok[2:-2], '""', '"')
        ELSE tok END) AS item FROM x)
SELECT field_name, record_id, CAST(row_number() OVER (PARTITION BY field_name, record_id ORDER BY i) - 1 AS INTEGER) AS pos, item FROM y WHERE item <> ''"""

_TOK = r"""'[uUbBrR]?"(?:[^"\\]|\\.)*"|[uUbBrR]?''(?:[^''\\]|\\.)*''|[\[\]{},:]|[^\s\[\]{},:"'']+|["'']'"""
_SINGLE = r"""'"' || replace(replace(replace(regexp_replace(replace(regexp_replace(x, '^[uUbBrR]?''|''$', '', 'g'), '\\', chr(1)), '\\([^"/bfnrtu])', '\1', 'g'), '\"', '"'), '"', '\"'), chr(1), '\\') || '"'"""
#: A text with every token in the notation of JSON; what is damaged stays no JSON.
_LIT = f"""regexp_replace(array_to_string(list_transform(regexp_extract_all(@, {_TOK}), lambda x: CASE
  WHEN x IN ('True', 'False') THEN lower(x) WHEN x = 'None' THEN 'null' WHEN regexp_matches(x, '^[uUbBrR]?''.*''$', 's') THEN {_SINGLE}
  WHEN regexp_matches(x, '^[uUbBrR]".*"$', 's') THEN x[2:] WHEN regexp_matches(x, '^[A-Za-z]') AND x NOT IN ('true', 'false', 'null') THEN '?' ELSE x END), ' '), ', ([]}}])', ' \\1', 'g')"""


def _sql_read(c: str) -> str:
    """NULL for what is absent, JSON text for an object or array, '0' for a scalar."""
    t = f"trim({c})"
    lit = lambda x: _LIT.replace("@", x)
    inner = f"trim(json_extract_string('[' || ({lit(t)}) || ']', '$[0]'))"
    return f"""CASE WHEN {t} IN ('None', 'null') THEN NULL
  WHEN {t}[1] IN ('{{', '[') THEN CASE WHEN json_valid({lit(t)}) THEN {lit(t)} ELSE '0' END
  WHEN regexp_matches({t}, '^[uUbB]?(".*"|''.*'')$', 's') AND len({t}) > 2 AND json_valid({lit(t)}) THEN
    CASE WHEN {inner} IN ('None', 'null') THEN NULL WHEN {inner}[1] IN ('{{', '[') AND json_valid({lit(inner)}) THEN {lit(inner)} ELSE '0' END
  ELSE '0' END"""


#: The nodes: path, value as read, element, the element it is within, place in an array, and (path, element) of it and all above.
_NODES = f"""WITH RECURSIVE a AS (SELECT business_id, unnest(map_entries(attributes)) AS e FROM business),
n(business_id, path, v, element, within, place, chain) AS (SELECT business_id, e.key, {_sql_read("e.value")}, e.key, '@record', CAST(NULL AS INTEGER), [{{'p': e.key, 'e': e.key}}] FROM a WHERE e.value IS NOT NULL
 UNION ALL SELECT business_id, path || s.step, CASE json_type(s.c) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN {_sql_read("(s.c ->> '$')")} ELSE CAST(s.c AS VARCHAR) END,
   s.name, element, s.place, list_append(chain, {{'p': path || s.step, 'e': s.name}})
 FROM (SELECT business_id, path, element, chain, unnest(CASE WHEN v[1] = '{{'
     THEN list_transform(json_keys(v), lambda k: {{'step': '.' || k, 'name': k, 'place': CAST(NULL AS INTEGER), 'c': json_extract(v, '/' || replace(replace(k, '~', '~0'), '/', '~1'))}})
     ELSE list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: {{'step': '[' || i || ']', 'name': element || '[]', 'place': CAST(i AS INTEGER), 'c': json_extract(v, '$[' || i || ']')}}) END) AS s
   FROM n WHERE v[1] IN ('{{', '['))),
nodes AS (SELECT * FROM n WHERE v IS NOT NULL) """
_P6 = _NODES + "SELECT DISTINCT business_id, path AS node_path FROM nodes"
_P6_LINKS = _NODES + """, graph AS (SELECT DISTINCT within, element FROM nodes),
reach(x, y) AS (SELECT within, element FROM graph UNION SELECT reach.x, graph.element FROM reach JOIN graph ON graph.within = reach.y),
tabled AS (SELECT element FROM graph GROUP BY element HAVING element LIKE '%[]' OR count(*) > 1 OR element IN (SELECT x FROM reach WHERE x = y)),
tl AS (SELECT list(element) AS ts FROM tabled),
homed AS (SELECT business_id, path, v, element, place, list_contains(ts, element) AS own, list_filter(chain[:-2], lambda c: list_contains(ts, c.e))[-1] AS home FROM nodes, tl),
inlined AS (SELECT business_id, coalesce(home.p, '') AS row_path, count(*) AS k FROM homed WHERE NOT own GROUP BY 1, 2),
keyed AS (SELECT business_id, element AS table_name, path AS row_path, coalesce(home.e, '@record') AS parent_table, coalesce(home.p, '') AS parent_path, place AS ordinal, CASE WHEN v[1] IN ('{', '[') THEN 0 ELSE 1 END AS own FROM homed WHERE own
  UNION ALL SELECT DISTINCT business_id, '@record', '', NULL, NULL, NULL, 0 FROM nodes)
SELECT business_id, table_name, row_path, parent_table, parent_path, ordinal, CAST(own + coalesce(k, 0) AS INTEGER) AS n_columns FROM keyed LEFT JOIN inlined USING (business_id, row_path)"""

QUERIES = {"p1_found": p1_found, "p1_key_averages": p1_key_averages, "p5_found": p5_found, "p6_found": p6_found, "p6_tables": p6_tables, "p6_links": p6_links}
ORACLES = {
    "p1_found": _LATEST + "SELECT field_name, key_id FROM k WHERE key_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM r)",
    "p1_key_averages": _LATEST + "SELECT field_name, key_id, count(*) AS n_records, round(CAST(avg(stars) AS DOUBLE), 6) AS avg_value FROM k WHERE key_id IS NOT NULL GROUP BY 1, 2",
    "p5_found": _P5,
    "p6_found": _P6,
    "p6_links": _P6_LINKS,
}
