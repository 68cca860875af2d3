"""Interval joins on media time through levels of buckets instead of a nested loop.

An interval belongs to the level whose bucket width is the first power of two times ``bucket_ms``
above its length, so it touches at most two buckets there, however long it is. The other side is
listed at the levels that occur under its key, which are few (one per doubling of the length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_MS = 60_000


def _level(start: str, end: str, ms: int) -> Column:
    n = F.expr(f"({end} - {start}) div {ms}")
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def _bucket(col: str, level: str, ms: int) -> Column:
    return F.expr(f"{col} div ({ms} * shiftleft(1L, {level}))")


def _touched(df: DataFrame, start: str, end: str, level: str, ms: int) -> DataFrame:
    """One row per bucket of ``level``: at most two of them at the interval's own level or above."""
    return df.withColumn("_b", F.explode(F.array_distinct(F.array(_bucket(start, level, ms), _bucket(end, level, ms)))))


def _levels(df: DataFrame, key: str, level: str) -> DataFrame:
    return df.groupBy(key).agg(F.collect_set(level).alias("_all"))


def containment(
    points: DataFrame, spans: DataFrame, key: str, p_start: str, p_end: str, s_start: str, s_end: str, bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Rows of ``points`` whose interval lies inside a row of ``spans`` of the same ``key``.

    A point meets a span in the bucket of the point's start at the span's level, so each pair
    meets once. A span that ends before it starts holds nothing; nulls match nothing.
    """
    s = spans.filter(F.col(s_start) <= F.col(s_end)).withColumn("_lev", _level(s_start, s_end, bucket_ms))
    p = points.join(_levels(s, key, "_lev"), key).withColumn("_plev", F.explode("_all")).drop("_all")
    p = p.withColumn("_pb", _bucket(p_start, "_plev", bucket_ms)).withColumnRenamed(key, "_k")
    cond = (
        (F.col(key) == F.col("_k")) & (F.col("_lev") == F.col("_plev")) & (F.col("_b") == F.col("_pb"))
        & (F.col(p_start) >= F.col(s_start)) & (F.col(p_end) <= F.col(s_end))
    )
    return _touched(s, s_start, s_end, "_lev", bucket_ms).join(p, cond).drop("_b", "_pb", "_k", "_lev", "_plev")


def overlaps(
    left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str, bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Pairs whose closed intervals share a point.

    A pair meets at the higher of its two levels, in the bucket of the later start alone, which
    replaces a distinct over the pairs. Intervals that end before they start match nothing.
    """
    def own(df, start, end):
        return df.filter(F.col(start) <= F.col(end)).withColumn("_own", _level(start, end, bucket_ms))

    def listed(df, other, start, end):
        up = df.join(_levels(other, key, "_own"), key).withColumn("_lev", F.explode(F.array_union(F.array("_own"), F.filter("_all", lambda x: x > F.col("_own"))))).drop("_all")
        return _touched(up, start, end, "_lev", bucket_ms)

    a, b = own(left, l_start, l_end), own(right, r_start, r_end)
    l = listed(a, b, l_start, l_end)
    r = listed(b, a, r_start, r_end).withColumnsRenamed({key: "_k", "_b": "_rb", "_lev": "_rlev", "_own": "_rown"})
    cond = (
        (F.col(key) == F.col("_k")) & (F.col("_lev") == F.col("_rlev")) & (F.col("_b") == F.col("_rb"))
        & (F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end))
        & (F.col("_lev") == F.greatest("_own", "_rown"))
        & (F.col("_b") == F.expr(f"greatest({l_start}, {r_start}) div ({bucket_ms} * shiftleft(1L, _lev))"))
    )
    return l.join(r, cond).drop("_b", "_rb", "_k", "_lev", "_rlev", "_own", "_rown")
