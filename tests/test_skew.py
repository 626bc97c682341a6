from collections import Counter

from pyspark.sql import functions as F

from lodestrata.operators import skew


def test_tree_aggregate_equals_plain_grouping(spark):
    df = spark.range(0, 20_000, 1, 50).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("k"), "id")
    got = skew.tree_aggregate(df, ["k"], [skew.Measure("n", F.lit(1)), skew.Measure("s", F.col("id")), skew.Measure("lo", F.col("id"), "min"), skew.Measure("hi", F.col("id"), "max")], fan_in=4, chunk_rows=30)
    want = df.groupBy("k").agg(F.count("*"), F.sum("id"), F.min("id"), F.max("id"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def rounds(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")


def test_rounds_follow_the_number_of_chunks(spark):
    df = spark.range(0, 1000, 1, 20).select(F.lit("a").alias("k"))
    tree = lambda rows, fan_in: rounds(skew.tree_aggregate(df, ["k"], [skew.Measure("n", F.lit(1))], fan_in=fan_in, chunk_rows=rows))
    assert tree(50, 2) == 5  # 20 -> 10 -> 5 -> 3 -> 2 -> 1
    assert tree(10, 2) == 7 and tree(10, 10) == 2 and tree(50, 32) == 1 and tree(1, 2) == 10


def test_reducers_get_few_states_of_a_hot_key(spark):
    rows = 40
    df = spark.range(0, 4000, 1, 7).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    chunk = skew._chunk(7, rows)
    states = df.select("k", chunk.alias("c")).groupBy("c").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    assert states.agg(F.max("n")).first()[0] == rows
    per_reducer = df.select("k", chunk.alias("c")).distinct().groupBy("k", F.floor(F.col("c") / 4)).count()
    assert per_reducer.agg(F.max("count")).first()[0] == 4
    got = skew.tree_aggregate(df, ["k"], [skew.Measure("n", F.lit(1))], fan_in=4, chunk_rows=rows)
    assert rounds(got) == 4 and got.where("k = 'hot'").first().n == 3600


def test_heavy_keys_and_edges(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] * 97 + [("c",)] + [(None,)] * 50, "k string")
    assert sorted(map(tuple, skew.heavy_keys(df, "k", 0.02).collect())) == [("a", 2), ("b", 97)]
    empty = spark.createDataFrame([], "k string")
    assert skew.heavy_keys(empty, "k", 0.02).count() == 0
    assert skew.heavy_keys(spark.createDataFrame([(None,)], "k string"), "k", 0.02).count() == 0
    assert skew.tree_aggregate(empty, ["k"], [skew.Measure("n", F.lit(1))]).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "n_rows string, key_value int")
    assert [tuple(r) for r in skew.heavy_keys(df, "n_rows", 0.5).collect()] == [("a", 2)]


def test_distinct_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), (None, 3)], "k string, v int")
    assert {r.k: r.n for r in skew.distinct_counts(df, ["k"], "v", "n").collect()} == {"a": 2, None: 1}
