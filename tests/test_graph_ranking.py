import random

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from turnloom.functions import text as T
from turnloom.operators.graph import connected_components, star_links
from turnloom.ranking import hash_rank, running_before
from turnloom.skew import hot_threshold, join_counted
from turnloom.staging import Stage, shared_dir


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    random_edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    chain = [(1000 + i, 1001 + i) for i in range(40)]
    star = [(5000, 5001 + i) for i in range(300)]
    for edges in (random_edges + chain + star, [(7, 7)], []):
        df = spark.createDataFrame(edges, "u bigint, v bigint")
        got = {r["node"]: r["component"] for r in connected_components(Stage(spark, "t"), df).collect()}
        assert got == union_find([(a, b) for a, b in edges if a != b])


def test_star_links_keys_and_nulls(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "a", None), (5, "a", None), (6, "a", "hot")] + [(i, "a", "hot") for i in range(10, 400)]
    got = {(r["u"], r["v"]) for r in star_links(Stage(spark, "t"), spark.createDataFrame(rows, "id bigint, kind string, key string")).collect()}
    assert got == {(2, 1)} | {(i, 6) for i in range(10, 400)}


def test_salted_join_equals_join(spark):
    left = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 700))
    keyed = left.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    salted = join_counted(left, keyed, ["k"], "n", F.col("id"), hot_threshold(keyed, "n"))
    assert salted.count() == 3000 and salted.exceptAll(left.join(keyed, "k").select(*salted.columns)).count() == 0


def test_ranks_and_running_sums(spark):
    rows = [("a" if i % 3 else None, i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int").withColumn("h", T.hash_order("s", F.col("i")))
    got = hash_rank(df, ["g"], "h", ["i"]).collect()
    for g in ("a", None):
        order = [r["i"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["h"], r["i"]))]
        assert [r["rank"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["h"], r["i"]))] == list(range(1, len(order) + 1))
    run = running_before(df, ["g"], F.floor(F.col("i") / 10), ["i"], F.col("v"), "before").orderBy("i").collect()
    sums = {}
    for r in run:
        assert r["before"] == sums.get(r["g"], 0)
        sums[r["g"]] = sums.get(r["g"], 0) + r["v"]
    assert hash_rank(df.limit(0), ["g"], "h", ["i"]).count() == 0


def test_staging_folder_is_kept_and_cleaned(spark):
    stage = Stage(spark, "t")
    df = stage.write(spark.range(5), "x")
    assert df.count() == 5 and df._stage_path.startswith(shared_dir(spark)) and isinstance(df.schema, ST.StructType)
    stage.drop(df)
    stage.clear()
