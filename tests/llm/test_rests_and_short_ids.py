"""Pools of containers, and short ids with slips."""

from pyspark.sql import functions as F

from lodestone.llm import overlap, packing


def test_pools_follow_the_rests(spark):
    texts = ["a b " * 60] * 20 + ["a b"] * 12  # most tokens lie in full pieces
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    sizes = {r.doc_id: r.n_tokens for r in packing.token_sizes(df, "doc_id", "text").collect()}
    rests = sum(n % 8 for n in sizes.values())
    out = packing.containers(df, capacity=8, pool_bins=rests).collect()
    assert sum(r.n_tokens for r in out) == sum(sizes.values()) > 8 * rests
    assert len({r.container_id // 10_000_000 for r in out if r.container_id >= 0}) == 1


def test_short_ids_with_two_slips(spark):
    ids, train = ["abcde", "abcdef"], ["xbcdy", "abcd", "bcdef", "axcdyf", "bacdfe", "abcdefgh", "aXbcdYef", "zzzdef"]
    e = spark.createDataFrame([(i, "u" * 9, x) for i, x in enumerate(ids)], "rating_id long, user_id string, business_id string").withColumns({"split_name": F.lit("v"), "rating_source": F.lit("s")})
    t = spark.createDataFrame([(i, "u" * 9, x) for i, x in enumerate(train)], "rating_id long, user_id string, business_id string")
    want = {(i, j) for i, x in enumerate(ids) for j, y in enumerate(train) if overlap.slips_between(x, y.lower()) is not None}
    assert {(r.eval_rating_id, r.train_rating_id) for r in overlap.split_overlaps(t, e).collect()} == want
