"""Queries over the operators of this subpackage (problems 2 to 4 and 7 to 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.shuffle import stage
from lodestone.llm import canonical, cooccurrence, leaks, overlap, packing, similarsets, textstats
from lodestone.sources.tables import load


def _splits(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, s: load(spark, d, t).select(F.lit(s).alias("split_name"), "rating_id", "user_id", "business_id", "rating_source")
    return one("yelp_val", "val").unionByName(one("yelp_test", "test"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.split_overlaps(load(spark, d, "yelp_train"), _splits(spark, d)).select("split_name", "train_rating_id", "eval_rating_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    evals = _splits(spark, d)
    return overlap.overlap_report(overlap.split_overlaps(load(spark, d, "yelp_train"), evals), evals)


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation records that overlap and how much of their ids is covered."""
    pairs = overlap.split_overlaps(load(spark, d, "yelp_train"), _splits(spark, d))
    return overlap.record_coverage(pairs).withColumn("coverage", F.round("coverage", 6))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.cooccurrences(load(spark, d, "ub_sample_data"), "user_id", "business_id", support=7, lift=4.0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("item_1").alias("business_id_1"), F.col("item_2").alias("business_id_2"))


def p3_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("lift", F.round("lift", 6)).withColumn("llr", F.round("llr", 4))


def _cities(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_to_names(load(spark, d, "business"), "business_id", "city", load(spark, d, "canon_city"), "city_name", "city_id", "state_code")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cities(spark, d).select(F.col("record_id").alias("business_id"), F.col("name_id").alias("city_id"))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry and how many businesses have them."""
    return _cities(spark, d).where(F.col("name_id") == -1).groupBy(F.col("value").alias("city")).agg(F.count("*").alias("n_businesses"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similarsets.similar_sets(load(spark, d, "yelp_train"), "business_id", "user_id", 0.5)
    return pairs.select(F.col("record_1").alias("business_id_1"), F.col("record_2").alias("business_id_2"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(load(spark, d, "documents").select("doc_id", "text"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p8_containers(spark, d)).withColumn("unused_share", F.round("unused_share", 6))


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """Of each document whether its pieces follow each other from token 0 on, and whether any container of it is overfull."""
    placed = packing.containers(load(spark, d, "documents").select("doc_id", "text"))
    placed = stage(placed)
    over = placed.groupBy("container_id").agg((F.sum("n_tokens") > 2_048).alias("over"))
    pieces = placed.join(over, "container_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "token_start", "n_tokens"))).alias("p"), F.max("over").alias("overfull"))
    gapless = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda k: (F.get("p", k)["piece"] == k) & (F.get("p", k)["token_start"] == F.coalesce(F.get("p", k - 1)["token_start"] + F.get("p", k - 1)["n_tokens"], F.lit(0))))
    return pieces.select("doc_id", gapless.alias("gapless"), "overfull")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "eval_items"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(p9_found(spark, d), load(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    types = textstats.text_types(load(spark, d, "documents").select("doc_id", "text"))
    return types.where(F.col("text_type") != "prose").select("doc_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return textstats.text_statistics(load(spark, d, "documents").select("doc_id", "text"))


_NORM = "nullif(lower(regexp_replace({0}, '[^A-Za-z0-9_-]', '', 'g')), '')"
_P2 = f"""WITH t AS (SELECT rating_id, {_NORM.format("user_id")} AS u, {_NORM.format("business_id")} AS b FROM yelp_train),
e AS (SELECT split_name, rating_id, rating_source, {_NORM.format("user_id")} AS u, {_NORM.format("business_id")} AS b FROM (
  SELECT 'val' AS split_name, rating_id, user_id, business_id, rating_source FROM yelp_val UNION ALL SELECT 'test', rating_id, user_id, business_id, rating_source FROM yelp_test)),
mu AS (SELECT a.u AS eu, c.u AS tu, damerau_levenshtein(a.u, c.u) AS s FROM (SELECT DISTINCT u FROM e) a JOIN (SELECT DISTINCT u FROM t) c ON abs(length(a.u) - length(c.u)) <= 2 AND damerau_levenshtein(a.u, c.u) <= 2),
mb AS (SELECT a.b AS eb, c.b AS tb, damerau_levenshtein(a.b, c.b) AS s FROM (SELECT DISTINCT b FROM e) a JOIN (SELECT DISTINCT b FROM t) c ON abs(length(a.b) - length(c.b)) <= 2 AND damerau_levenshtein(a.b, c.b) <= 2),
p AS (SELECT e.split_name, e.rating_id AS eval_rating_id, t.rating_id AS train_rating_id, mu.s + mb.s AS slips FROM e JOIN mu ON e.u = mu.eu JOIN mb ON e.b = mb.eb JOIN t ON t.u = mu.tu AND t.b = mb.tb) """
_CUT = "[{{{{'at': 0, 'n': length({e}) // 3}}}}, {{{{'at': length({e}) // 3 + 1, 'n': (length({e}) - 1 - length({e}) // 3) // 2 - 1}}}}, {{{{'at': length({e}) // 3 + (length({e}) - 1 - length({e}) // 3) // 2 + 1, 'n': length({e}) - length({e}) // 3 - (length({e}) - 1 - length({e}) // 3) // 2 - 1}}}}]"
_CUT = _CUT.replace("{{", "{").replace("}}", "}")
#: The share of an id's characters in pieces that the other id has, at most two places off.
_COVERED = "list_sum(list_transform(" + _CUT + ", lambda x: CASE WHEN x.n > 0 AND len(list_filter([-2, -1, 0, 1, 2], lambda k: x.at + k >= 0 AND substr({t}, x.at + k + 1, x.n) = substr({e}, x.at + 1, x.n))) > 0 THEN x.n ELSE 0 END)) / CAST(length({e}) AS DOUBLE)"
_P3 = """WITH d AS (SELECT DISTINCT user_id AS g, business_id AS i FROM ub_sample_data WHERE trim(user_id) <> '' AND trim(business_id) <> ''),
n AS (SELECT CAST(count(DISTINCT g) AS DOUBLE) AS n FROM d), c AS (SELECT i, count(*) AS k FROM d GROUP BY i),
p AS (SELECT a.i AS item_1, b.i AS item_2, count(*) AS n12 FROM d a JOIN d b ON a.g = b.g AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 7),
q AS (SELECT item_1, item_2, n12, x.k AS n1, y.k AS n2, n FROM p JOIN c x ON x.i = item_1 JOIN c y ON y.i = item_2, n WHERE n12 * n >= 4.0 * x.k * y.k) """
_TERM = "(CASE WHEN {0} > 0 THEN ({0}) * ln(({0}) / ({1})) ELSE 0 END)"
_LLR = "2 * (" + " + ".join(_TERM.format(*x) for x in [("n12", "n1 * n2 / n"), ("n1 - n12", "n1 * (n - n2) / n"), ("n2 - n12", "(n - n1) * n2 / n"), ("n - n1 - n2 + n12", "(n - n1) * (n - n2) / n")]) + ")"
def _sql_fold(c: str) -> str:
    """The words of a text column in plain letters: mis-decoded letters by replacement, accents by strip_accents. The lists of short forms are the operator's parameters."""
    t = c
    for rounds in (2, 1):
        for letter in map(chr, [*range(0xC0, 0x100), 0x160, 0x161, 0x17D, 0x17E]):
            for code in ("cp1252", "latin-1"):
                try:
                    bad = letter
                    for _ in range(rounds):
                        bad = bad.encode().decode(code)
                except UnicodeDecodeError:
                    continue
                t = f"replace({t}, '{bad}', '{letter}')" if "'" not in bad else t
    wide = {chr(0xFF21 + k): chr(0x61 + k) for k in range(26)} | {chr(0xFF41 + k): chr(0x61 + k) for k in range(26)} | {chr(0xFF10 + k): str(k) for k in range(10)}
    alike = wide | canonical.LOOKALIKES | {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ð": "d"}
    t = f"lower({t})"
    t = f"translate({t}, '{''.join(alike)}', '{''.join(alike.values())}')"
    t = f"strip_accents({t})"
    t = f"regexp_replace({t}, '[\\p{{M}}\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}''’`´]', '', 'g')"
    for many, few in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th")):
        t = f"replace({t}, '{many}', '{few}')"
    short = ", ".join(f"'{k}': '{v}'" for k, v in canonical.SHORT_FORMS.items())
    return f"list_transform(string_split(trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: coalesce(list_extract(map_extract(MAP {{{short}}}, w), 1), w))"


_TURNS = "list_transform(range(1, len({0}) + 1), lambda i: array_to_string(list_concat({0}[i:], {0}[1:i - 1]), ''))"
_P4 = f"""WITH s AS (SELECT list(DISTINCT lower(state_code)) AS ss FROM canon_city), r AS (SELECT city_id, array_to_string({_sql_fold("city_name")}, '') AS name FROM canon_city),
v AS (SELECT city, {_sql_fold("city")} AS a FROM (SELECT DISTINCT city FROM business WHERE city IS NOT NULL)), p AS (SELECT city, a, list_filter(a, lambda w: NOT list_contains(ss, w)) AS b FROM v, s),
q AS (SELECT city, a, b, list_filter(b, lambda w: w NOT IN ({", ".join(f"'{w}'" for w in canonical.AROUND)})) AS c FROM p),
f AS (SELECT DISTINCT city, unnest(list_concat({_TURNS.format("a")}, {_TURNS.format("b")}, {_TURNS.format("c")})) AS form FROM q),
m AS (SELECT city, city_id, damerau_levenshtein(form, name) AS d FROM f JOIN r ON abs(length(form) - length(name)) <= 2 AND damerau_levenshtein(form, name) <= 2 WHERE form <> ''),
k AS (SELECT city, city_id FROM m QUALIFY row_number() OVER (PARTITION BY city ORDER BY d, city_id) = 1),
z AS (SELECT business_id, business.city, coalesce(city_id, -1) AS city_id FROM business LEFT JOIN k ON k.city = business.city WHERE regexp_replace(business.city, '[\\s\\x{{a0}}]+', '', 'g') <> '') """
_P7 = """WITH d AS (SELECT DISTINCT business_id AS b, user_id AS u FROM yelp_train WHERE business_id IS NOT NULL AND user_id IS NOT NULL),
c AS (SELECT b, count(*) AS k FROM d GROUP BY b), p AS (SELECT x.b AS b1, y.b AS b2, count(*) AS m FROM d x JOIN d y ON x.u = y.u AND x.b < y.b GROUP BY 1, 2)
SELECT b1 AS business_id_1, b2 AS business_id_2 FROM p JOIN c x ON x.b = b1 JOIN c y ON y.b = b2 WHERE 2 * m >= x.k + y.k - m"""
#: Every item's words as single characters, so that edit distances of words are those of texts; tried are all item windows and document stretches near a shared run of three words.
_P9 = r"""WITH dw AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(regexp_replace(text, '</?[A-Za-z][^<>]*>|&[A-Za-z]{2,8};|&#x?[0-9A-Fa-f]{1,6};', ' ', 'g')), '[\p{M}\x{ad}\x{200b}]', '', 'g'), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
codes AS (SELECT item_id, map_from_entries(list((x, chr(CAST(k AS INTEGER))))) AS m FROM (SELECT item_id, x, row_number() OVER (PARTITION BY item_id ORDER BY x) AS k FROM (SELECT DISTINCT item_id, unnest(w) AS x FROM iw)) GROUP BY item_id),
it AS (SELECT item_id, unnest(range(1, len(w) - 1)) AS i, w FROM iw), ig AS (SELECT item_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM it),
dt AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS j, w FROM dw), dg AS (SELECT doc_id, j, w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] AS g FROM dt),
met AS (SELECT doc_id, item_id, i, j FROM dg JOIN ig USING (g)),
pairs AS (SELECT doc_id, item_id FROM met GROUP BY ALL HAVING count(DISTINCT j) >= 4),
coded AS (SELECT doc_id, item_id, array_to_string(list_transform(dw.w, lambda x: coalesce(m[x], chr(127))), '') AS d, array_to_string(list_transform(iw.w, lambda x: m[x]), '') AS t FROM pairs JOIN dw USING (doc_id) JOIN iw USING (item_id) JOIN codes USING (item_id)),
starts AS (SELECT DISTINCT doc_id, item_id, i - a AS s, j - i AS g FROM (SELECT doc_id, item_id, i, j, unnest(range(0, 13)) AS a FROM met SEMI JOIN pairs USING (doc_id, item_id)) WHERE i > a),
tries AS (SELECT doc_id, item_id, s, s + g + o AS x, n FROM starts, range(-3, 4) r1(o), range(12, 19) r2(n) WHERE s + g + o >= 1)
SELECT DISTINCT doc_id, item_id FROM tries JOIN coded USING (doc_id, item_id) WHERE s + 14 <= length(t) AND levenshtein(substr(t, s, 15), substr(d, x, n)) <= 3"""
_COMMON = ", ".join(f"'{w}'" for w in textstats.COMMON)
_P10 = rf"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
m AS (SELECT doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS letters, len(list_filter(w, lambda x: x IN ({_COMMON}))) AS common,
  length(regexp_replace(text, '[\p{{L}}\p{{N}}\s\x{{0b}}]', '', 'g')) AS symbols, len(regexp_extract_all(text, '[^\n]*\S[^\n]*')) AS lines,
  len(regexp_extract_all(text, '[.!?…]["''”»)]*[ \t\r]*(?:\n|$)')) AS ended FROM w)
SELECT doc_id, length(text) AS n_chars, CAST(n_words AS BIGINT) AS n_words,
  CASE WHEN n_words > 0 THEN round(CAST(letters AS DOUBLE) / n_words, 6) END AS mean_word_length,
  CASE WHEN length(text) > 0 THEN round(CAST(symbols AS DOUBLE) / length(text), 6) END AS symbol_share,
  CASE WHEN lines > 0 THEN round(CAST(least(ended, lines) AS DOUBLE) / lines, 6) END AS punct_line_share,
  CASE WHEN n_words > 0 THEN round(CAST(common AS DOUBLE) / n_words, 6) END AS common_share FROM m"""

QUERIES = {
    "p2_found": p2_found, "p2_report": p2_report, "p2_records": p2_records, "p3_found": p3_found, "p3_cooccurrence": p3_cooccurrence, "p4_found": p4_found, "p4_unmatched": p4_unmatched,
    "p7_found": p7_found, "p8_containers": p8_containers, "p8_report": p8_report, "p8_placed": p8_placed, "p9_found": p9_found, "p9_report": p9_report, "p10_found": p10_found, "p10_statistics": p10_statistics,
}
ORACLES = {
    "p2_found": _P2 + "SELECT split_name, train_rating_id, eval_rating_id FROM p",
    "p2_report": _P2 + """, g AS (SELECT split_name, eval_rating_id, count(*) AS k, min(slips) AS s FROM p GROUP BY 1, 2)
SELECT e.split_name, rating_source, count(*) AS n_records, count(k) AS n_overlapping, count(*) FILTER (WHERE s = 0) AS n_without_slips, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_pairs
FROM e LEFT JOIN g ON e.split_name = g.split_name AND e.rating_id = g.eval_rating_id GROUP BY 1, 2""",
    "p2_records": _P2
    + f""", cu AS (SELECT eu, tu, {_COVERED.format(e="eu", t="tu")} AS c FROM mu), cb AS (SELECT eb, tb, {_COVERED.format(e="eb", t="tb")} AS c FROM mb)
SELECT p.split_name, p.eval_rating_id, count(*) AS n_train, min(p.slips) AS slips, round(max((cu.c + cb.c) / 2), 6) AS coverage
FROM p JOIN e ON e.split_name = p.split_name AND e.rating_id = p.eval_rating_id JOIN t ON t.rating_id = p.train_rating_id JOIN cu ON cu.eu = e.u AND cu.tu = t.u JOIN cb ON cb.eb = e.b AND cb.tb = t.b GROUP BY 1, 2""",
    "p3_found": _P3 + "SELECT item_1 AS business_id_1, item_2 AS business_id_2 FROM q",
    "p3_cooccurrence": _P3 + f"SELECT item_1, item_2, n12, n1, n2, CAST(n AS BIGINT) AS n_baskets, round(n12 * n / (CAST(n1 AS DOUBLE) * n2), 6) AS lift, round({_LLR}, 4) AS llr FROM q",
    "p4_found": _P4 + "SELECT business_id, city_id FROM z",
    "p4_unmatched": _P4 + "SELECT city, count(*) AS n_businesses FROM z WHERE city_id = -1 GROUP BY city",
    "p7_found": _P7,
    "p8_placed": "SELECT doc_id, TRUE AS gapless, FALSE AS overfull FROM documents WHERE doc_id IS NOT NULL",
    "p9_found": _P9,
    "p9_report": f"SELECT item_id, suite, count(doc_id) AS n_docs FROM eval_items LEFT JOIN ({_P9}) USING (item_id) GROUP BY ALL",
    "p10_statistics": _P10,
}
