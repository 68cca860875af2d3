"""Translation memory: store with ambiguity, exact and similarity lookup, reverse coverage.

A memory row: hash, source, target, tgt_lang, src_lang, print (settings fingerprint).
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.functions import keys as K
from cueflow.functions import text as T
from cueflow.session import cut, explode_rows

THRESHOLD = 0.85


def store(memory: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """``memory`` after a batch of (hash, source, target, ...) was stored.

    A key with two different targets in the batch is not stored and its old row goes. The
    test needs the smallest and the largest target only, so a key of any number of rows is
    folded by the map side; nothing is collected. Otherwise the last row in ``order`` wins.
    """
    t = F.trim("target")
    fit = K.usable(F.col("source"), F.col("target")) & F.col("source").isNotNull() & F.col("target").isNotNull()
    cols = [c for c in memory.columns if c != "hash"]
    row = F.struct(*[(t if c == "target" else F.trim("source") if c == "source" else F.col(c)).alias(c) for c in cols])
    given = F.col("target").isNotNull() & (F.col("target") != "")
    new = batch.filter(given).select("hash", t.alias("_t"), F.when(fit, row).alias("_n"), F.when(fit, F.struct(*order)).alias("_o"))
    # Old and new rows meet in one shuffle. A row without a key is nobody's old row.
    old = memory.filter("hash is not null").select("hash", F.struct(*cols).alias("_m"))
    g = new.unionByName(old, allowMissingColumns=True).groupBy("hash").agg(
        F.coalesce(F.min("_t") != F.max("_t"), F.lit(False)).alias("_amb"), F.max_by("_n", "_o").alias("_r"), F.collect_list("_m").alias("_m")
    )
    fresh = ~F.col("_amb") & F.col("_r").isNotNull()
    rows = F.when(fresh, F.array("_r")).when(~F.col("_amb"), F.col("_m"))
    out = explode_rows(g, ["hash"], rows).select("hash", "e.*")
    return out.select(*memory.columns).unionByName(memory.filter("hash is null"))


def lookup(sources: DataFrame, memory: DataFrame, text: str, tgt_lang: Column, print_: Column, legacy: bool = False) -> DataFrame:
    """Adds ``hit``: the usable stored target of the same key and line shape.

    ``legacy`` allows a second probe without settings for what the first one did not find;
    it is for settings that hold no schema, language or context.
    """
    m = memory.filter(K.usable(F.col("source"), F.col("target"))).select("hash", K.line_shape(F.col("source")).alias("_shape"), F.col("target").alias("hit"))
    probe = lambda df, p: df.withColumn("hash", K.memory_key(F.col(text), tgt_lang, p)).withColumn("_shape", K.line_shape(F.col(text)))
    first = probe(sources, print_).join(m, ["hash", "_shape"], "left")
    if not legacy:
        return first.drop("hash", "_shape")
    # Rows that have their hit keep a key that matches nothing; a null key would put all of them in one task.
    again = F.when(F.col("hit").isNull(), K.memory_key(F.col(text), tgt_lang, F.lit(""))).otherwise(F.concat(F.lit("-"), "hash"))
    second = first.withColumn("hash", again).join(m.withColumnRenamed("hit", "_hit2"), ["hash", "_shape"], "left")
    return second.withColumn("hit", F.coalesce("hit", "_hit2")).drop("hash", "_shape", "_hit2")


def ratio(a: Column, b: Column) -> Column:
    """Matching-block similarity of two short texts, for joined candidates only."""

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y):
            out.append(None if s is None else difflib.SequenceMatcher(None, t, s, autojunk=False).ratio())
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(score, "double")(a, b)


def similar(sources: DataFrame, memory: DataFrame, text: str, scope: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Best similar entry per distinct normal form of ``text`` (``norm``, scope, target, ratio).

    A similar entry must have the same tokens, inner punctuation and question mark, so the
    candidates come from an equi-join on those. Both sides are reduced to their distinct
    normal forms first: copies, however many, meet once. A form that is stored itself is a
    full hit and needs no pairs at all.
    """
    # A row's keys are a list of one or none: a filter before them would make target and form a second time.
    gate = lambda c: F.md5(K.gate(F.col(c))).alias("gate")
    asked = T.let(K.memory_norm(F.col(text)), lambda n: F.when(F.length(n) >= 6, F.array(F.struct(n.alias("norm"), gate(text)))))
    s = explode_rows(sources, scope, asked).select(*scope, "e.*").groupBy(*scope, "norm", "gate").agg(F.count("*").alias("uses"))
    held = T.let(F.col("target"), lambda t: F.when(F.col("source").rlike(T.TOKEN) & K.usable(F.col("source"), t), F.array(F.struct(K.memory_norm(F.col("source")).alias("cand"), gate("source"), t.alias("target")))))
    m = explode_rows(memory, scope, held).select(*scope, "e.*").groupBy(*scope, "cand", "gate").agg(F.max("target").alias("target"))
    # Both are read more than once below; their keys are costly, so they are made once.
    s, m = cut(s, "forms"), cut(m, "entries")
    full = s.join(m.select(*scope, "gate", F.col("cand").alias("norm"), "target"), [*scope, "gate", "norm"]).withColumn("ratio", F.lit(1.0))
    rest = s.join(full.select(*scope, "gate", "norm"), [*scope, "gate", "norm"], "left_anti")
    near = rest.join(m, [*scope, "gate"]).filter((F.length("cand") * 10 >= F.length("norm") * 6) & (F.length("cand") * 10 <= F.length("norm") * 14))
    # The length gap alone bounds the ratio from above: 2 * min / (a + b).
    a, b = F.length("norm"), F.length("cand")
    bound = 2 * F.least(a, b) / (a + b)
    # If one text holds the other, its whole length matches and the bound is the ratio itself.
    held = F.contains("norm", F.col("cand")) | F.contains("cand", F.col("norm"))
    near = near.filter(bound >= threshold).withColumn("_r", F.when(held, bound))
    near = near.withColumn("ratio", F.coalesce("_r", ratio(*(F.when(F.col("_r").isNull(), F.col(c)) for c in ("norm", "cand"))))).filter(F.col("ratio") >= threshold)
    best = near.groupBy(*scope, "norm", "gate", "uses").agg(F.max_by("target", F.struct("ratio", "cand")).alias("target"), F.max("ratio").alias("ratio"))
    cols = [*scope, "norm", "uses", "target", "ratio"]
    return full.select(*cols).unionByName(best.select(*cols))


def reverse_coverage(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Targets with one source and targets with several, per ``keys``."""
    g = pairs.groupBy(*keys, "target").agg(F.min("source").alias("a"), F.max("source").alias("b"))
    return g.groupBy(*keys).agg(F.count_if(F.col("a") == F.col("b")).alias("unique_targets"), F.count_if(F.col("a") != F.col("b")).alias("ambiguous_targets"))
