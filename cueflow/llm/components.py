"""Connected components by alternating star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.llm import store

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable, itself included) for edges ``a`` - ``b``.

    Each round hangs every node on the smallest node near it; rounds grow with the logarithm of the
    number of nodes. A node of many edges is a minimum over rows, taken in part before the shuffle.
    """
    e = store.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(ROUNDS):
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(m, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(m, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        e = store.cut(small, "stars")
        # Done once no centre hangs on another node.
        if e.select(F.col("b").alias("a")).distinct().join(e, "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    raise RuntimeError("components did not settle")
