"""Queries over the exploration, itemset, similarity, graph, sketch and rating operators, and their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.shuffle import stage_dir
from lodestone.operators import exploration, features, graph, itemsets, learning, recommend, similarity, sketches
from lodestone.sinks import writers
from lodestone.sources import readers
from lodestone.sources.tables import load
from lodestone.streaming import micro

SHARE, OVERLAP, BATCH = 0.01, 4, 100


def _reviews(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "review")


def explore_counts(s: SparkSession, d: str) -> DataFrame:
    return exploration.review_counts(_reviews(s, d), "2018")


def explore_top10_users(s: SparkSession, d: str) -> DataFrame:
    return exploration.top_keys(_reviews(s, d), "user_id")


def explore_top10_business(s: SparkSession, d: str) -> DataFrame:
    return exploration.top_keys(_reviews(s, d), "business_id")


def explore_city_avg(s: SparkSession, d: str) -> DataFrame:
    return exploration.by_average(exploration.city_averages(_reviews(s, d), load(s, d, "business"))).withColumn("avg_stars", F.round("avg_stars", 6))


def explore_top10_cities(s: SparkSession, d: str) -> DataFrame:
    return explore_city_avg(s, d).limit(10)


def explore_top10_cities_driver(s: SparkSession, d: str) -> DataFrame:
    """The same by a sort in the driver's program."""
    rows = exploration.top_by_driver(exploration.city_averages(_reviews(s, d), load(s, d, "business")).withColumn("avg_stars", F.round("avg_stars", 6)))
    return readers.local_rows(s, [tuple(r) for r in rows], "city string, avg_stars double")


def explore_partition_counts(s: SparkSession, d: str) -> DataFrame:
    return exploration.partition_report(_reviews(s, d).select("business_id"), "business_id", 8)


def explore_partition_totals(s: SparkSession, d: str) -> DataFrame:
    """The items over all partitions of each layout."""
    return explore_partition_counts(s, d).groupBy("layout").agg(F.sum("n_items").alias("n_items"))


def explore_document(s: SparkSession, d: str) -> DataFrame:
    """The exploration's counts as one JSON text."""
    return writers.json_document(explore_counts(s, d))


def _baskets(s: SparkSession, d: str, larger_than: int = 0) -> DataFrame:
    return itemsets.baskets(load(s, d, "ub_sample_data"), "user_id", "business_id", larger_than)


def basket_build(s: SparkSession, d: str) -> DataFrame:
    return _baskets(s, d).select("basket", F.size("items").alias("n_items"))


def basket_filtered(s: SparkSession, d: str) -> DataFrame:
    return _baskets(s, d, 5).select("basket", F.size("items").alias("n_items"))


def basket_by_business(s: SparkSession, d: str) -> DataFrame:
    return itemsets.baskets(load(s, d, "ub_sample_data"), "business_id", "user_id").select("basket", F.size("items").alias("n_items"))


def _sets(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("items", "|").alias("itemset"), "size", "n")


def itemset_son(s: SparkSession, d: str) -> DataFrame:
    return _sets(itemsets.frequent_itemsets(_baskets(s, d), SHARE))


def itemset_singles(s: SparkSession, d: str) -> DataFrame:
    return _sets(itemsets.frequent_itemsets(_baskets(s, d), SHARE, 1))


def itemset_pairs(s: SparkSession, d: str) -> DataFrame:
    return _sets(itemsets.frequent_itemsets(_baskets(s, d), SHARE, 2)).where(F.col("size") == 2)


def itemset_triples(s: SparkSession, d: str) -> DataFrame:
    return _sets(itemsets.frequent_itemsets(_baskets(s, d), SHARE, 3)).where(F.col("size") == 3)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    b = _baskets(s, d)
    total = b.count()
    return itemsets.candidate_itemsets(b, max(1, math.ceil(SHARE * total)), total)


def itemset_lines(s: SparkSession, d: str) -> DataFrame:
    """The report of the candidates and the frequent itemsets."""
    sized = _candidates(s, d).withColumn("size", F.size("items"))
    return writers.itemset_report(sized, itemsets.frequent_itemsets(_baskets(s, d), SHARE))


def itemset_candidates(s: SparkSession, d: str) -> DataFrame:
    """The itemsets that some part of the baskets holds often enough; which ones depends on the parts, of which 40,000 baskets make one."""
    return _candidates(s, d).select(F.array_join("items", "|").alias("itemset"), F.size("items").alias("size"), "n_parts")


def fpgrowth_itemsets(s: SparkSession, d: str) -> DataFrame:
    return _sets(itemsets.fpgrowth_itemsets(_baskets(s, d), SHARE))


def set_containment(s: SparkSession, d: str) -> DataFrame:
    """In how many baskets each pair of frequent items is contained."""
    b = _baskets(s, d)
    singles = itemsets.frequent_itemsets(b, SHARE, 1).select(F.get("items", F.lit(0)).alias("x"))
    return _sets(itemsets.counted(b, itemsets.pairs_of(singles)))


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.overlap_edges(load(s, d, "ub_sample_data"), "user_id", "business_id", OVERLAP)


def overlap_edges(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d)


def label_propagation(s: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation(_edges(s, d))


def community_lines(s: SparkSession, d: str) -> DataFrame:
    return writers.community_lines(graph.communities(graph.label_propagation(_edges(s, d)))).select("size", "value")


def edge_betweenness(s: SparkSession, d: str) -> DataFrame:
    return graph.edge_betweenness(_edges(s, d)).withColumn("betweenness", F.bround("betweenness", 5))


def betweenness_lines(s: SparkSession, d: str) -> DataFrame:
    return writers.edge_lines(graph.edge_betweenness(_edges(s, d)))


def _train(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "yelp_train")


def jaccard_exact(s: SparkSession, d: str) -> DataFrame:
    """All pairs of businesses whose sets of users have a similarity of at least 0.5."""
    return similarity.similar_pairs(_train(s, d), "business_id", "user_id", 0.5).withColumn("similarity", F.round("similarity", 6))


def jaccard_overlaps(s: SparkSession, d: str) -> DataFrame:
    """All pairs of businesses with a user in common and their similarity."""
    return similarity.overlap_jaccard(_train(s, d), "business_id", "user_id").withColumn("similarity", F.round("similarity", 6))


def ordinal_index(s: SparkSession, d: str) -> DataFrame:
    return similarity.ordinals(_train(s, d), "user_id")


def minhash_signature(s: SparkSession, d: str) -> DataFrame:
    return similarity.signatures(_train(s, d), "business_id", "user_id")


def union_bands(s: SparkSession, d: str) -> DataFrame:
    b = similarity.bands(similarity.signatures(_train(s, d), "business_id", "user_id"))
    return b.groupBy("band").agg(F.count("*").alias("n_records"), F.count_distinct("part").alias("n_parts"))


def lsh_pairs(s: SparkSession, d: str) -> DataFrame:
    return similarity.lsh_pairs(_train(s, d), "business_id", "user_id").withColumn("similarity", F.round("similarity", 6))


def lsh_lines(s: SparkSession, d: str) -> DataFrame:
    """The pairs as sorted lines under a header."""
    return writers.pair_lines(lsh_pairs(s, d))


def _events(s: SparkSession, d: str) -> DataFrame:
    return sketches.numbered(load(s, d, "events"), "ts", "event_id")


def _number() -> object:
    return F.pmod(F.col("event_id") * 31 + F.col("user_id"), F.lit(30_011))


def stream_batches(s: SparkSession, d: str) -> DataFrame:
    return sketches.batches(_events(s, d), BATCH)


def stream_positional(s: SparkSession, d: str) -> DataFrame:
    return sketches.positional_sample(_events(s, d), "user_id")


def bloom_fpr(s: SparkSession, d: str) -> DataFrame:
    return sketches.bloom_rates(_events(s, d), _number(), BATCH)


def bloom_fpr_ids(s: SparkSession, d: str) -> DataFrame:
    """The same over the events' own ids, of which there are as many as events."""
    return sketches.bloom_rates(_events(s, d), F.col("event_id"), BATCH)


def bloom_counters(s: SparkSession, d: str) -> DataFrame:
    """The four outcomes of the filter over the events' own ids."""
    return sketches.filter_counters(bloom_fpr_ids(s, d), _events(s, d), BATCH)


def fm_distinct(s: SparkSession, d: str) -> DataFrame:
    return sketches.distinct_estimates(_events(s, d), F.col("user_id"), BATCH)


def fm_totals(s: SparkSession, d: str) -> DataFrame:
    return sketches.estimate_totals(fm_distinct(s, d))


def hll_distinct(s: SparkSession, d: str) -> DataFrame:
    return sketches.sketched_distinct(_reviews(s, d), "user_id", "business_id")


def hash_cross_params(s: SparkSession, d: str) -> DataFrame:
    x = F.pmod(F.col("user_id"), F.lit(sketches.BLOOM_PRIME))
    ids = load(s, d, "events").select("user_id").distinct()
    one = lambda j, a, b: F.struct(F.lit(j).alias("hash_no"), (((F.lit(a) * x + F.lit(b)) % sketches.BLOOM_PRIME) % sketches.BLOOM_BITS).alias("place"))
    return ids.select("user_id", F.explode(F.array(*[one(j, a, b) for j, (a, b) in enumerate(sketches.parameters(3, sketches.BLOOM_BITS))])).alias("h")).select("user_id", "h.hash_no", "h.place")


def text_id_number(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "yelp_user").select("user_id", sketches.text_number(F.col("user_id"), sketches.BLOOM_PRIME).alias("number"))


def stream_positional_structured(s: SparkSession, d: str) -> DataFrame:
    return micro.drained(micro.stream_positional(micro.as_stream(_events(s, d)), "user_id"), "complete")


def stream_fm_structured(s: SparkSession, d: str) -> DataFrame:
    hashed = micro.drained(micro.stream_zeros(micro.as_stream(_events(s, d)), F.col("user_id"), BATCH), "complete")
    ids = micro.drained(micro.stream_ids(micro.as_stream(_events(s, d)), F.col("user_id"), BATCH), "append")
    return sketches.estimates_of(hashed, ids.groupBy("batch").agg(F.count("*").alias("n_distinct")))


def stream_bloom_structured(s: SparkSession, d: str) -> DataFrame:
    return micro.bloom_rates_of(micro.stream_bloom(micro.as_stream(_events(s, d)), _number(), BATCH))


def stream_bloom_ids_structured(s: SparkSession, d: str) -> DataFrame:
    return micro.bloom_rates_of(micro.stream_bloom(micro.as_stream(_events(s, d)), F.col("event_id"), BATCH))


def stream_window_counts(s: SparkSession, d: str) -> DataFrame:
    return micro.drained(micro.windowed_counts(micro.as_stream(_events(s, d)), "ts", "event_type"), "complete")


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    return micro.sessions(load(s, d, "events"), "ts", "user_id")


def _rated(s: SparkSession, d: str) -> DataFrame:
    return recommend.ratings(_train(s, d))


def _truth(s: SparkSession, d: str) -> DataFrame:
    return recommend.ratings(load(s, d, "yelp_val"))


def user_stats(s: SparkSession, d: str) -> DataFrame:
    return recommend.means(_rated(s, d), "user").withColumn("avg_stars", F.round("avg_stars", 6))


def item_stats(s: SparkSession, d: str) -> DataFrame:
    return recommend.means(_rated(s, d), "item").withColumn("avg_stars", F.round("avg_stars", 6))


def _weights(s: SparkSession, d: str, least: int) -> DataFrame:
    return recommend.pearson_sharing(_rated(s, d), least).withColumn("weight", F.round("weight", 6))


def pearson_pairs(s: SparkSession, d: str) -> DataFrame:
    """Weights of all pairs of businesses with at least two users in common."""
    return _weights(s, d, 2)


def pearson_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Weights of all pairs of businesses with a user in common."""
    return _weights(s, d, 1)


def _cf(s: SparkSession, d: str) -> DataFrame:
    return recommend.predictions(_rated(s, d), load(s, d, "yelp_val").select(F.col("user_id").alias("user"), F.col("business_id").alias("item")))


def cf_predict(s: SparkSession, d: str) -> DataFrame:
    return _cf(s, d).withColumn("prediction", F.round("prediction", 6))


def rmse(s: SparkSession, d: str) -> DataFrame:
    near = _cf(s, d).withColumn("prediction", F.round("prediction", 6))
    return recommend.rmse(recommend.against_truth(near, _truth(s, d))).withColumn("rmse", F.round("rmse", 6))


def error_histogram(s: SparkSession, d: str) -> DataFrame:
    near = _cf(s, d).withColumn("prediction", F.round("prediction", 6))
    return recommend.error_histogram(recommend.against_truth(near, _truth(s, d)))


def anti_unseen_users(s: SparkSession, d: str) -> DataFrame:
    targets = load(s, d, "yelp_val").select(F.col("user_id").alias("user"))
    return recommend.unseen(targets, _rated(s, d), "user")


def attribute_encode(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "business").select("business_id", *features.attribute_columns(F.col("attributes")))


def category_encode(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "business").select("business_id", features.category_code(F.col("categories")).alias("as_written"), features.category_code(F.col("categories"), trim=True).alias("trimmed"))


def user_encode(s: SparkSession, d: str) -> DataFrame:
    return features.user_features(load(s, d, "yelp_user"))


def feature_table(s: SparkSession, d: str) -> DataFrame:
    pairs = _rated(s, d).select("user", "item", "stars")
    f = features.simple_features(pairs, _rated(s, d), load(s, d, "yelp_user"), load(s, d, "business"), training=True)
    return f.select("user", "item", "stars", *[F.round(c, 6).alias(c) for c in learning.SIMPLE])


def feature_table_test(s: SparkSession, d: str) -> DataFrame:
    f = features.simple_features(_truth(s, d), _rated(s, d), load(s, d, "yelp_user"), load(s, d, "business"), training=False)
    return f.select("user", "item", "stars", *[F.round(c, 6).alias(c) for c in learning.SIMPLE])


def business_encode(s: SparkSession, d: str) -> DataFrame:
    return features.business_features(load(s, d, "business")).select("item", *features.BUSINESS_COLUMNS)


def missing_fill(s: SparkSession, d: str) -> DataFrame:
    """The validation rows with the entities' features, the missing ones filled from the training rows."""
    f = features.joined_features(_truth(s, d), load(s, d, "yelp_user"), load(s, d, "business"), _rated(s, d))
    return f.select("user", "item", "stars", *[F.round(c, 6).alias(c) for c in ("u_review_count", "u_fans", "u_avg_stars", "b_stars", "b_review_count", "b_open", "b_category")])


def _model(s: SparkSession, d: str) -> DataFrame:
    users, shops, rated = load(s, d, "yelp_user"), load(s, d, "business"), _rated(s, d)
    train = features.simple_features(rated, rated, users, shops, training=True)
    test = features.simple_features(_truth(s, d), rated, users, shops, training=False)
    at = lambda rows: features.indexed(rows, rated, users)
    return learning.boosted(at(train), at(test), [*learning.INDEXED], trees=100, step=0.05)


def model_predict(s: SparkSession, d: str) -> DataFrame:
    return _model(s, d).select("user", "item", "prediction")


def model_rmse(s: SparkSession, d: str) -> DataFrame:
    return recommend.rmse(_model(s, d))


def hybrid_blend(s: SparkSession, d: str) -> DataFrame:
    return recommend.blended(_cf(s, d), _model(s, d))


def stacking(s: SparkSession, d: str) -> DataFrame:
    users, shops, rated = load(s, d, "yelp_user"), load(s, d, "business"), _rated(s, d)
    train = features.joined_features(rated, users, shops)
    test = features.joined_features(_truth(s, d), users, shops, rated)
    return learning.stacked(train, test, [c for c in train.columns if c[:2] in ("u_", "b_", "a_")], ["user", "item"], trees=200, forest=100)


def _written(s: SparkSession, name: str) -> str:
    return f"{stage_dir(s)}/{name}-{uuid.uuid4().hex}"


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The training ratings, written as CSV and read back."""
    writers.write_csv(_train(s, d).select("user_id", "business_id", "stars"), path := _written(s, "csv"))
    return readers.csv_table(s, path, readers.RATING)


def json_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The businesses, attributes apart, written as JSON lines and read back."""
    writers.write_json(load(s, d, "business").select("business_id", "stars", "review_count", "is_open", "postal_code", "categories"), path := _written(s, "json"))
    return readers.json_lines(s, path, readers.BUSINESS).drop("attributes")


def text_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The basket lines of the events, written as text and counted as read back."""
    writers.write_lines(load(s, d, "events").select(F.concat_ws(",", "event_id", "user_id", "event_type").alias("value")), path := _written(s, "text"))
    return readers.text_lines(s, path)


def transactions_read(s: SparkSession, d: str) -> DataFrame:
    """Baskets of a quoted file of transactions: the events by day, user and kind of event."""
    zeros = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    rows = load(s, d, "events").select(F.date_format("ts", "M/d/yyyy").alias("DAY"), zeros("user_id").alias("CUSTOMER"), F.lit("x, y").alias("A"), F.lit(1).alias("B"), F.lit(2).alias("C"), zeros("event_id").alias("PRODUCT"))
    rows.write.option("header", True).option("quoteAll", True).csv(path := _written(s, "quoted"))
    return readers.transactions(s, path).groupBy("basket").agg(F.count("*").alias("n_items"), F.min(F.col("item").cast("long")).alias("first_item"))


_R = "WITH r AS (SELECT user_id AS \"user\", business_id AS item, stars FROM yelp_train WHERE user_id IS NOT NULL AND business_id IS NOT NULL AND stars IS NOT NULL), v AS (SELECT user_id AS \"user\", business_id AS item, stars FROM yelp_val)"
_ONE = f"""{_R}, o AS (SELECT "user", item, avg(stars) AS stars FROM r GROUP BY 1, 2), im AS (SELECT item, avg(stars) AS m FROM r GROUP BY 1), um AS (SELECT "user", avg(stars) AS m FROM r GROUP BY 1)"""
_WEIGHT = """, co AS (SELECT item_1, item_2, count(*) AS n, sum(x.stars * y.stars) - sum(x.stars) * sum(y.stars) / count(*) AS xy, sum(x.stars * x.stars) - sum(x.stars) * sum(x.stars) / count(*) AS xx, sum(y.stars * y.stars) - sum(y.stars) * sum(y.stars) / count(*) AS yy
  FROM w JOIN o x ON x.item = item_1 JOIN o y ON y.item = item_2 AND y."user" = x."user" GROUP BY 1, 2),
pw AS (SELECT w.item_1, w.item_2, CASE WHEN n IS NULL THEN least(a.m, b.m) / greatest(a.m, b.m) WHEN xx < 1e-9 OR yy < 1e-9 THEN 1.0 ELSE xy / sqrt(xx * yy) END AS weight
  FROM w LEFT JOIN co ON co.item_1 = w.item_1 AND co.item_2 = w.item_2 JOIN im a ON a.item = w.item_1 JOIN im b ON b.item = w.item_2)"""
_CF = (
    _ONE
    + """, t AS (SELECT DISTINCT "user", item FROM v), k AS (SELECT t."user", t.item, um.m AS um, im.m AS im FROM t LEFT JOIN um ON um."user" = t."user" LEFT JOIN im ON im.item = t.item),
nr AS (SELECT k."user", k.item, o.item AS other, o.stars, least(k.item, o.item) AS item_1, greatest(k.item, o.item) AS item_2 FROM k JOIN o ON o."user" = k."user" WHERE um IS NOT NULL AND im IS NOT NULL),
w AS (SELECT DISTINCT item_1, item_2 FROM nr)"""
    + _WEIGHT
    + """, tp AS (SELECT nr."user", nr.item, nr.stars, weight FROM nr JOIN pw ON pw.item_1 = nr.item_1 AND pw.item_2 = nr.item_2 WHERE weight > 1e-9
  QUALIFY row_number() OVER (PARTITION BY nr."user", nr.item ORDER BY round(weight, 9) DESC, other) <= 100),
wm AS (SELECT "user", item, sum(weight * stars) / sum(abs(weight)) AS m FROM tp GROUP BY 1, 2),
p AS (SELECT k."user", k.item, round(coalesce(wm.m, k.um, k.im, 3.0), 6) AS prediction FROM k LEFT JOIN wm ON wm."user" = k."user" AND wm.item = k.item),
j AS (SELECT p.prediction, v.stars FROM p JOIN v ON v."user" = p."user" AND v.item = p.item WHERE v.stars IS NOT NULL) """
)
_B = "WITH d AS (SELECT DISTINCT coalesce(user_id, chr(1)) AS g, business_id AS i FROM ub_sample_data WHERE business_id IS NOT NULL), "
_SETS = (
    _B.replace("WITH", "WITH RECURSIVE", 1)
    + f"""t AS (SELECT ceil({SHARE} * count(DISTINCT g)) AS s FROM d), s1 AS (SELECT i, count(*) AS n FROM d GROUP BY i HAVING count(*) >= (SELECT s FROM t)), f AS (SELECT g, i FROM d WHERE i IN (SELECT i FROM s1)),
fs AS (SELECT g, list(i ORDER BY i) AS held FROM f GROUP BY g),
grow(items, n) AS (SELECT [i], n FROM s1 UNION ALL SELECT items, count(*) FROM (SELECT list_append(grow.items, x.i) AS items FROM grow JOIN fs ON list_has_all(fs.held, grow.items) JOIN f x ON x.g = fs.g AND x.i > grow.items[-1]) GROUP BY items HAVING count(*) >= (SELECT s FROM t)),
sets AS (SELECT array_to_string(items, '|') AS itemset, CAST(len(items) AS INTEGER) AS size, n, items FROM grow) """
)
_LINES = """lines AS (SELECT size, string_agg('(' || chr(39) || array_to_string(items, chr(39) || ', ' || chr(39)) || chr(39) || ')', ',' ORDER BY items) AS v FROM sets GROUP BY size),
sections AS (SELECT 0 AS line_no, {title} AS value UNION ALL SELECT size * 2, v FROM lines UNION ALL SELECT size * 2 + 1, '' FROM lines)"""
_EDGE = """WITH d AS (SELECT DISTINCT user_id AS u, business_id AS b FROM ub_sample_data WHERE user_id IS NOT NULL AND business_id IS NOT NULL),
e AS (SELECT x.u AS src, y.u AS dst, count(*) AS n_shared FROM d x JOIN d y ON x.b = y.b AND x.u < y.u GROUP BY 1, 2 HAVING count(*) >= %d)""" % OVERLAP
_LABELS = _EDGE + ", l AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), l0 AS (SELECT DISTINCT src AS vertex, src AS label FROM l)" + "".join(
    f", l{k} AS (SELECT src AS vertex, label FROM (SELECT l.src, x.label, count(*) AS n FROM l JOIN l{k - 1} x ON x.vertex = l.dst GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, label) = 1)" for k in range(1, 6)
)
_T = "WITH d AS (SELECT DISTINCT business_id AS record, user_id AS u FROM yelp_train WHERE business_id IS NOT NULL AND user_id IS NOT NULL), "
_SIG = (
    _T
    + "ux AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS x FROM (SELECT DISTINCT user_id AS u FROM yelp_train WHERE user_id IS NOT NULL)), m AS (SELECT count(*) AS m FROM ux), sg AS (SELECT record, "
    + ", ".join(f"min((({a} * x + {b}) % {similarity.PRIME}) % m) AS h{i}" for i, (a, b) in enumerate(similarity.hash_parameters(30)))
    + " FROM d JOIN ux ON ux.u = d.u, m GROUP BY record)"
)
_BANDS = _SIG + ", bd AS (" + " UNION ALL ".join(f"SELECT record, {i // 2} AS band, h{i} AS p, h{i + 1} AS q FROM sg" for i in range(0, 30, 2)) + ")"
_JACCARD = """, sz AS (SELECT record, count(*) AS k FROM d GROUP BY record), sh AS (SELECT x.record AS record_1, y.record AS record_2, count(*) AS m FROM d x JOIN d y ON x.u = y.u AND x.record < y.record GROUP BY 1, 2),
jc AS (SELECT record_1, record_2, m, round(CAST(m AS DOUBLE) / (a.k + b.k - m), 6) AS similarity FROM sh JOIN sz a ON a.record = record_1 JOIN sz b ON b.record = record_2) """
_LSH = _BANDS + _JACCARD + "SELECT DISTINCT jc.record_1, jc.record_2, similarity FROM jc JOIN bd x ON x.record = record_1 JOIN bd y ON y.record = record_2 AND y.band = x.band AND y.p = x.p AND y.q = x.q WHERE similarity >= 0.5"
_E = f"WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events), b AS (SELECT *, seq // {BATCH} AS batch, (event_id * 31 + user_id) % 30011 AS id FROM e) "
_BLOOM = (
    _E
    + f", fi AS (SELECT id, min(seq) AS seq FROM b GROUP BY id), pl AS ("
    + " UNION ALL ".join(f"SELECT id, seq, (({a} * (id % {sketches.BLOOM_PRIME}) + {b}) % {sketches.BLOOM_PRIME}) % {sketches.BLOOM_BITS} AS bit FROM fi" for a, b in sketches.parameters(3, sketches.BLOOM_BITS))
    + f"""), st AS (SELECT bit, min(seq) AS since FROM pl GROUP BY bit), kn AS (SELECT id, seq, max(since) AS last_set FROM pl JOIN st USING (bit) GROUP BY 1, 2),
fa AS (SELECT seq // {BATCH} AS batch, count(*) FILTER (WHERE last_set < seq) AS n_false, count(*) AS n_new FROM kn GROUP BY 1), n AS (SELECT batch, count(*) AS n FROM b GROUP BY 1)
SELECT n.batch, coalesce(n_false, 0) AS n_false, coalesce(n_new, 0) AS n_new, CAST(coalesce(n_false, 0) AS DOUBLE) / n AS fpr, CAST(n_false AS DOUBLE) / n_new AS fpr_new FROM n LEFT JOIN fa ON fa.batch = n.batch"""
)
_BLOOM_IDS = _BLOOM.replace("(event_id * 31 + user_id) % 30011 AS id", "event_id AS id")
_PICK = _E + f"SELECT (batch + 1) * 100 AS seqnum, " + ", ".join(f"max(user_id) FILTER (WHERE seq % 100 = {k}) AS id_{k}" for k in (0, 20, 40, 60, 80)) + " FROM b GROUP BY batch"
_FM = (
    _E
    + ", pm AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(sketches.parameters(300, 4_294_967_295)))
    + f""") t(j, a, b)), di AS (SELECT DISTINCT batch, user_id % {sketches.COUNT_PRIME} AS x FROM b),
h AS (SELECT batch, j, CAST((pm.a * x + pm.b) % {sketches.COUNT_PRIME} % {sketches.COUNT_RANGE} AS BIGINT) AS h FROM di, pm),
z AS (SELECT batch, j, max(CASE WHEN h = 0 THEN 0 ELSE bit_count((h & -h) - 1) END) AS r FROM h GROUP BY 1, 2),
g AS (SELECT batch, j // 5 AS k, avg(power(2.0, r)) AS m FROM z GROUP BY 1, 2), md AS (SELECT batch, round_even(median(m), 0) AS estimate FROM g GROUP BY 1), n AS (SELECT batch, count(*) AS n_distinct FROM di GROUP BY 1) """
)
_CODE = "coalesce(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT), 0)"
_ATTR = ", ".join(f"CASE WHEN attributes['{k}'] = 'True' THEN 1 ELSE 0 END AS \"{k}\"" for k in features.TRUE_FLAGS)
_INNER = ", ".join(
    f"""CASE WHEN regexp_matches(lower(attributes['{k}']), '[''"\\\\]{m}[''"\\\\]+\\s*:\\s*true') AND regexp_matches(attributes['{k}'], '\\}}"?\\s*$') THEN 1 ELSE 0 END AS "{k}_{m}\""""
    for k, ms in (("BusinessParking", features.PARKING), ("GoodForMeal", features.MEALS))
    for m in ms
)
_ENCODED = f"""SELECT business_id, {_ATTR}, {_INNER}, {", ".join(f'{_CODE.format(f"attributes['{k}']")} AS "{k}"' for k in features.CODED)},
coalesce(TRY_CAST(attributes['RestaurantsPriceRange2'] AS INTEGER), 0) AS "RestaurantsPriceRange2", CASE WHEN attributes['WiFi'] = 'free' THEN 1 ELSE 0 END AS "WiFi", CASE WHEN attributes['Music'] IS NOT NULL THEN 1 ELSE 0 END AS "Music" FROM business"""
_CATEGORY = "CASE WHEN categories IS NULL OR list_contains({0}, 'Restaurants') OR list_contains({0}, 'Food') THEN 1 WHEN list_contains({0}, 'Health & Medical') THEN 2 ELSE 0 END"
_WIDE = f""", uf AS (SELECT user_id, CAST(review_count AS DOUBLE) AS u_review_count, CAST(fans AS DOUBLE) AS u_fans, average_stars AS u_avg_stars FROM yelp_user),
bf AS (SELECT business_id, stars AS b_stars, CAST(review_count AS DOUBLE) AS b_review_count, CAST(is_open AS DOUBLE) AS b_open, CAST({_CATEGORY.format("string_split(categories, ',')")} AS DOUBLE) AS b_category FROM business),
mm AS (SELECT avg(u_review_count) AS a, avg(u_avg_stars) AS b, avg(b_stars) AS c, avg(b_review_count) AS d FROM r LEFT JOIN uf ON uf.user_id = r."user" LEFT JOIN bf ON bf.business_id = r.item)
SELECT v."user", v.item, v.stars, round(coalesce(u_review_count, a), 6) AS u_review_count, coalesce(u_fans, 0) AS u_fans, round(coalesce(u_avg_stars, b), 6) AS u_avg_stars, round(coalesce(b_stars, c), 6) AS b_stars, round(coalesce(b_review_count, d), 6) AS b_review_count, coalesce(b_open, 0) AS b_open, coalesce(b_category, 1) AS b_category
FROM v LEFT JOIN uf ON uf.user_id = v."user" LEFT JOIN bf ON bf.business_id = v.item, mm WHERE v."user" IS NOT NULL AND v.item IS NOT NULL AND v.stars IS NOT NULL"""
_TABLE = f"""{_R}, ue AS (SELECT user_id, CAST(useful AS DOUBLE) AS useful FROM yelp_user), ur AS (SELECT "user", CAST(count(*) AS DOUBLE) AS n, avg(stars) AS m FROM r GROUP BY 1), br AS (SELECT item, CAST(count(*) AS DOUBLE) AS n, avg(stars) AS m FROM r GROUP BY 1)
SELECT r."user", r.item, r.stars, ur.n AS u_count, round(ur.m, 6) AS u_avg, br.n AS b_count, round(br.m, 6) AS b_avg, coalesce(useful, 0) AS u_useful FROM r JOIN ur ON ur."user" = r."user" JOIN br ON br.item = r.item LEFT JOIN ue ON ue.user_id = r."user\""""

_TEST = f"""{_R}, ue AS (SELECT user_id, CAST(review_count AS DOUBLE) AS n, average_stars AS m, CAST(useful AS DOUBLE) AS useful FROM yelp_user), be AS (SELECT business_id, CAST(review_count AS DOUBLE) AS n, stars AS m FROM business)
SELECT v."user", v.item, v.stars, round(coalesce(ue.n, (SELECT avg(n) FROM ue)), 6) AS u_count, round(coalesce(ue.m, (SELECT avg(m) FROM ue)), 6) AS u_avg, round(coalesce(be.n, (SELECT avg(n) FROM be)), 6) AS b_count, round(coalesce(be.m, (SELECT avg(m) FROM be)), 6) AS b_avg, coalesce(useful, 0) AS u_useful
FROM v LEFT JOIN ue ON ue.user_id = v."user" LEFT JOIN be ON be.business_id = v.item WHERE v."user" IS NOT NULL AND v.item IS NOT NULL AND v.stars IS NOT NULL"""
_BETWEEN = _EDGE.replace("WITH d", "WITH RECURSIVE d", 1) + """, l AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w(r, v, k) AS (SELECT DISTINCT src, src, 0 FROM l UNION SELECT w.r, l.dst, w.k + 1 FROM w JOIN l ON l.src = w.v WHERE w.k < 40), ds AS (SELECT r, v, min(k) AS k FROM w GROUP BY 1, 2),
p(r, v, k) AS (SELECT DISTINCT src, src, 0 FROM l UNION ALL SELECT p.r, l.dst, p.k + 1 FROM p JOIN l ON l.src = p.v JOIN ds ON ds.r = p.r AND ds.v = l.dst AND ds.k = p.k + 1), sg AS (SELECT r, v, min(k) AS k, count(*) AS n FROM p GROUP BY 1, 2)
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round_even(sum(CAST(a.n AS DOUBLE) * b.n / t.n) / 2, 5) AS betweenness
FROM l JOIN sg a ON a.v = l.src JOIN sg b ON b.r = l.dst JOIN sg t ON t.r = a.r AND t.v = b.v AND t.k = a.k + 1 + b.k GROUP BY 1, 2"""
_PLACES = f"""SELECT business_id AS item, CAST({_CODE.format("postal_code")} AS DOUBLE) AS b_postal, stars AS b_stars, CAST(review_count AS DOUBLE) AS b_review_count, CAST(is_open AS DOUBLE) AS b_open, CAST({_CATEGORY.format("string_split(categories, ',')")} AS DOUBLE) AS b_category FROM business"""

ORACLES = {
    "explore_counts": "SELECT count(*) AS n_review, count(*) FILTER (WHERE contains(review_date, '2018')) AS n_review_year, (SELECT count(*) FROM (SELECT DISTINCT user_id FROM review)) AS n_user, (SELECT count(*) FROM (SELECT DISTINCT business_id FROM review)) AS n_business FROM review",
    "explore_top10_users": "SELECT user_id, count(*) AS n FROM review GROUP BY 1 ORDER BY n DESC, user_id NULLS LAST LIMIT 10",
    "explore_top10_business": "SELECT business_id, count(*) AS n FROM review GROUP BY 1 ORDER BY n DESC, business_id NULLS LAST LIMIT 10",
    "explore_city_avg": "SELECT city, round(avg(review.stars), 6) AS avg_stars FROM review LEFT JOIN business USING (business_id) GROUP BY city",
    "explore_top10_cities": "SELECT city, round(avg(review.stars), 6) AS avg_stars FROM review LEFT JOIN business USING (business_id) GROUP BY city ORDER BY avg_stars DESC, city NULLS LAST LIMIT 10",
    "explore_partition_totals": "SELECT 'default' AS layout, count(*) AS n_items FROM review UNION ALL SELECT 'customized', count(*) FROM review",
    "explore_top10_cities_driver": "SELECT city, round(avg(review.stars), 6) AS avg_stars FROM review LEFT JOIN business USING (business_id) GROUP BY city ORDER BY avg_stars DESC, city NULLS LAST LIMIT 10",
    "explore_document": """SELECT '{"n_review":' || count(*) || ',"n_review_year":' || count(*) FILTER (WHERE contains(review_date, '2018')) || ',"n_user":' || (SELECT count(*) FROM (SELECT DISTINCT user_id FROM review)) || ',"n_business":' || (SELECT count(*) FROM (SELECT DISTINCT business_id FROM review)) || '}' AS value FROM review""",
    "csv_round_trip": "SELECT user_id, business_id, stars FROM yelp_train",
    "json_round_trip": "SELECT business_id, stars, review_count, is_open, postal_code, categories FROM business",
    "text_round_trip": "SELECT event_id || ',' || user_id || ',' || event_type AS value FROM events",
    "transactions_read": "SELECT strftime(ts, '%-m/%-d/%Y') || '-' || user_id AS basket, count(*) AS n_items, min(event_id) AS first_item FROM events GROUP BY 1",
    "basket_build": "SELECT user_id AS basket, count(DISTINCT business_id) AS n_items FROM ub_sample_data WHERE business_id IS NOT NULL GROUP BY 1",
    "basket_filtered": "SELECT user_id AS basket, count(DISTINCT business_id) AS n_items FROM ub_sample_data WHERE business_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT business_id) > 5",
    "basket_by_business": "SELECT business_id AS basket, count(DISTINCT user_id) AS n_items FROM ub_sample_data WHERE user_id IS NOT NULL GROUP BY 1",
    "itemset_son": _SETS + "SELECT itemset, size, n FROM sets",
    "itemset_singles": _SETS + "SELECT itemset, size, n FROM sets WHERE size = 1",
    "itemset_pairs": _SETS + "SELECT itemset, size, n FROM sets WHERE size = 2",
    "itemset_triples": _SETS + "SELECT itemset, size, n FROM sets WHERE size = 3",
    "fpgrowth_itemsets": _SETS + "SELECT itemset, size, n FROM sets",
    # Under 40,000 baskets are one part, whose candidates are the frequent itemsets.
    "itemset_candidates": _SETS + "SELECT itemset, size, CAST(1 AS BIGINT) AS n_parts FROM sets",
    "itemset_lines": _SETS + ", " + _LINES.format(title="'Candidates:'") + " SELECT line_no, value FROM sections UNION ALL SELECT line_no + (SELECT max(line_no) + 1 FROM sections), CASE WHEN line_no = 0 THEN 'Frequent Itemsets:' ELSE value END FROM sections",
    "set_containment": _SETS + "SELECT a.i || '|' || b.i AS itemset, 2 AS size, count(*) AS n FROM f a JOIN f b ON a.g = b.g AND a.i < b.i GROUP BY 1",
    "overlap_edges": _EDGE + " SELECT src, dst, n_shared FROM e",
    "label_propagation": _LABELS + " SELECT vertex, label FROM l5",
    "community_lines": _LABELS + ", c AS (SELECT label, list(vertex ORDER BY vertex) AS m FROM l5 GROUP BY 1) SELECT len(m) AS size, '''' || array_to_string(m, ''', ''') || '''' AS value FROM c",
    "jaccard_exact": _T[:-2] + _JACCARD + "SELECT record_1, record_2, similarity FROM jc WHERE similarity >= 0.5",
    "jaccard_overlaps": _T[:-2] + _JACCARD + "SELECT record_1, record_2, similarity FROM jc",
    "ordinal_index": "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS ordinal FROM (SELECT DISTINCT user_id FROM yelp_train WHERE user_id IS NOT NULL)",
    "minhash_signature": _SIG + " SELECT * FROM sg",
    "union_bands": _BANDS + " SELECT band, count(*) AS n_records, count(DISTINCT (p, q)) AS n_parts FROM bd GROUP BY band",
    "lsh_pairs": _LSH,
    "lsh_lines": "SELECT 'business_id_1,business_id_2,similarity' AS value UNION ALL SELECT record_1 || ',' || record_2 || ',' || CAST(similarity AS VARCHAR) FROM (" + _LSH + ")",
    "stream_batches": _E + "SELECT batch, count(*) AS n_events, min(seq) AS first_seq, max(seq) AS last_seq FROM b GROUP BY batch",
    "stream_positional": _PICK,
    "stream_positional_structured": _PICK,
    "bloom_fpr": _BLOOM,
    "stream_bloom_structured": _BLOOM,
    "bloom_fpr_ids": _BLOOM_IDS,
    "bloom_counters": f"SELECT batch, n_events - n_new AS true_positive, n_false AS false_positive, n_new - n_false AS true_negative, CAST(0 AS BIGINT) AS false_negative FROM ({_BLOOM_IDS}) JOIN ({_E} SELECT batch, count(*) AS n_events FROM b GROUP BY batch) USING (batch)",
    "stream_bloom_ids_structured": _BLOOM_IDS,
    "fm_distinct": _FM + "SELECT batch, n_distinct, estimate FROM n JOIN md USING (batch)",
    "stream_fm_structured": _FM + "SELECT batch, n_distinct, estimate FROM n JOIN md USING (batch)",
    "fm_totals": _FM + "SELECT CAST(sum(n_distinct) AS BIGINT) AS n_distinct, sum(estimate) AS estimate FROM n JOIN md USING (batch)",
    "hash_cross_params": " UNION ALL ".join(f"SELECT DISTINCT user_id, {j} AS hash_no, (({a} * (user_id % {sketches.BLOOM_PRIME}) + {b}) % {sketches.BLOOM_PRIME}) % {sketches.BLOOM_BITS} AS place FROM events" for j, (a, b) in enumerate(sketches.parameters(3, sketches.BLOOM_BITS))),
    "text_id_number": f"SELECT user_id, list_reduce(list_transform(string_split(user_id, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: (a * 256 + b) % {sketches.BLOOM_PRIME}) AS number FROM yelp_user",
    "stream_window_counts": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), h AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events FROM h GROUP BY user_id, k""",
    "user_stats": _R + ' SELECT "user", count(*) AS n_ratings, round(avg(stars), 6) AS avg_stars FROM r GROUP BY 1',
    "item_stats": _R + " SELECT item, count(*) AS n_ratings, round(avg(stars), 6) AS avg_stars FROM r GROUP BY 1",
    "pearson_pairs": _ONE + ', w AS (SELECT x.item AS item_1, y.item AS item_2 FROM o x JOIN o y ON x."user" = y."user" AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 2)' + _WEIGHT + " SELECT item_1, item_2, round(weight, 6) AS weight FROM pw",
    "pearson_overlaps": _ONE + ', w AS (SELECT DISTINCT x.item AS item_1, y.item AS item_2 FROM o x JOIN o y ON x."user" = y."user" AND x.item < y.item)' + _WEIGHT + " SELECT item_1, item_2, round(weight, 6) AS weight FROM pw",
    "cf_predict": _CF + 'SELECT "user", item, prediction FROM p',
    "rmse": _CF + "SELECT count(*) AS n, round(sqrt(avg(power(prediction - stars, 2))), 6) AS rmse FROM j",
    "error_histogram": _CF + "SELECT CAST(least(floor(abs(prediction - stars)), 4) AS INTEGER) AS bin, count(*) AS n_rows FROM j GROUP BY 1",
    "anti_unseen_users": _R + ' SELECT DISTINCT "user" FROM v WHERE "user" IS NOT NULL AND "user" NOT IN (SELECT "user" FROM r)',
    "attribute_encode": _ENCODED,
    "category_encode": f"SELECT business_id, {_CATEGORY.format("string_split(categories, ',')")} AS as_written, {_CATEGORY.format("list_transform(string_split(categories, ','), lambda x: trim(x))")} AS trimmed FROM business",
    "user_encode": f"""SELECT user_id AS "user", CAST(review_count AS DOUBLE) AS u_review_count, CAST({_CODE.format("yelping_since")} AS DOUBLE) AS u_since, CAST(CASE WHEN friends IS NULL OR friends = 'None' THEN 0 ELSE len(string_split(friends, ',')) END AS DOUBLE) AS u_friends,
CAST(useful AS DOUBLE) AS u_useful, CAST(funny AS DOUBLE) AS u_funny, CAST(cool AS DOUBLE) AS u_cool, CAST(fans AS DOUBLE) AS u_fans, average_stars AS u_avg_stars, CAST(compliment_photos AS DOUBLE) AS u_photos FROM yelp_user""",
    "feature_table": _TABLE,
    "feature_table_test": _TEST,
    "business_encode": _PLACES,
    "edge_betweenness": _BETWEEN,
    "betweenness_lines": f"SELECT '(' || chr(39) || src || chr(39) || ', ' || chr(39) || dst || chr(39) || '), ' || CAST(betweenness AS VARCHAR) AS value FROM ({_BETWEEN})",
    "missing_fill": _R + _WIDE,
}
_NAMES = [*ORACLES, "explore_partition_counts", "hll_distinct", "model_predict", "model_rmse", "hybrid_blend", "stacking"]
QUERIES = {n: globals()[n] for n in _NAMES}
