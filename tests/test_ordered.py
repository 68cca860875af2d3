"""Blocked operators against plain windows and a sequential walk, with tiny blocks."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueflow.operators import ordered


def table(spark, sizes, seed=3):
    r = random.Random(seed)
    data = [(k, p, r.randint(0, 9)) for k, n in sizes.items() for p in range(1, n + 1)]
    r.shuffle(data)
    return spark.createDataFrame(data, "k int, pos long, v long")


def test_with_window_equals_plain_window(spark, rows):
    df = table(spark, {1: 23, 2: 4, 3: 1})
    w = Window.partitionBy("k").orderBy("pos")
    want = df.select("k", "pos", F.lag("v").over(w).alias("a"), F.lead("v", 2).over(w).alias("b"), F.sum("v").over(w.rowsBetween(-2, 1)).alias("c"))
    got = ordered.with_window(df, ["k"], "pos", {
        "a": lambda x: F.lag("v").over(x), "b": lambda x: F.lead("v", 2).over(x), "c": lambda x: F.sum("v").over(x.rowsBetween(-2, 1)),
    }, before=2, after=2, block=4).select("k", "pos", "a", "b", "c")
    assert rows(got) == rows(want)


def test_running_equals_plain_window(spark, rows):
    df = table(spark, {1: 23, 2: 4, 3: 1})
    w = Window.partitionBy("k").orderBy("pos")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "pos", F.sum("v").over(up).alias("s"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("e"), F.max("v").over(up).alias("m"))
    got = ordered.running(df, ["k"], "pos", {"s": ("sum", F.col("v"), True), "e": ("sum", F.col("v"), False), "m": ("max", F.col("v"), True)}, block=4).select("k", "pos", "s", "e", "m")
    assert rows(got) == rows(want)


def test_dense_pos_of_sparse_order(spark, rows):
    df = table(spark, {1: 40, 2: 7}).filter("v % 3 <> 0")
    w = Window.partitionBy("k").orderBy("pos")
    want = df.select("k", "pos", F.row_number().over(w).cast("long").alias("n"))
    assert rows(ordered.dense_pos(df, ["k"], "pos", "n", block=4).select("k", "pos", "n")) == rows(want)


def test_greedy_starts_equals_walk(spark, rows):
    r = random.Random(5)
    reach = 3
    data = [(k, p, p + r.randint(1, reach)) for k, n in {1: 61, 2: 3, 3: 17}.items() for p in range(1, n + 1)]
    nxt = {(k, p): n for k, p, n in data}
    want = []
    for k in (1, 2, 3):
        p = 1
        while (k, p) in nxt:
            want.append((k, p))
            p = nxt[(k, p)]
    df = spark.createDataFrame(data, "k long, pos long, n long")
    for block, fan in ((4, 2), (5, 3), (100, 4)):
        got = ordered.greedy_starts(df, "k", "pos", "n", reach, block=block, fan=fan)
        assert rows(got) == sorted(want)


def test_ranked_over_many_partitions(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # One file of 200,000 lines beside small ones; ids are sparse and rows come in any order.
        d = spark.range(200_000).selectExpr("7 as file_id", "id * 1000003 % 200003 as seq").unionByName(spark.range(50).selectExpr("id % 3 as file_id", "-id as seq"))
        d = d.unionByName(spark.createDataFrame([(None, 1), (None, 1), (None, None)], "file_id int, seq long").selectExpr("file_id", "seq")).repartition(16)
        got = ordered.ranked(d, ["seq"], "n", ["file_id"])
        w = Window.partitionBy("file_id").orderBy("seq")
        wrong = got.withColumns({"k": F.row_number().over(w), "r": F.rank().over(w)}).filter("n < r or n > r + 1 or (seq <> 1 and n <> k)")
        assert got.count() == 200_053 and wrong.count() == 0
        assert got.groupBy("file_id", "n").count().filter("count > 1").count() == 0
        whole = ordered.ranked(d, ["file_id", "seq"])
        assert sorted(r.pos for r in whole.filter("file_id is null or file_id < 3").collect()) == list(range(1, 54))
        assert ordered.ranked(d.limit(0), ["seq"]).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
