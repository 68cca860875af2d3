"""Ordered operators that never put a whole group into one task.

A group (a file, a conversation, a provider route) may hold a third of all rows, so a
plain ``Window.partitionBy(group).orderBy(pos)`` would send that third to one task.
Everything here splits a group into blocks of ``BLOCK`` consecutive positions:

* ``with_window``   lag / lead / sliding frames; rows near a block edge are copied to the
                    neighbouring block, so one shuffle is enough and no block is larger
                    than ``BLOCK`` plus the frame.
* ``running``       cumulative sum / max; blocks are folded first, the per-block totals are
                    accumulated, and the offset is joined back.
* ``dense_pos``     row numbers for a unique, nearly dense integer order.
* ``ranked``        row numbers in any sort order, from a sort by range and counts per task.
* ``greedy_starts`` starts of greedy segments (chunking, bounded merges).

``pos`` is always a dense 1-based position unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cueflow.functions import text as T
from cueflow.session import cut

BLOCK = 1 << 16

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _blk(pos: str, block: int) -> Column:
    return F.expr(f"(`{pos}` - 1) div {block}")


def with_window(
    df: DataFrame,
    keys: list[str],
    pos: str,
    columns: dict[str, Callable[[WindowSpec], Column]],
    before: int = 1,
    after: int = 0,
    block: int | None = None,
    made: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add window columns whose frame reaches at most ``before``/``after`` rows away.

    ``made`` adds columns of one row that the frames read. It runs behind the shuffle, once per row: its columns
    are not moved, and no neighbour makes them again.
    """
    block = block or BLOCK
    if max(before, after) > block:
        raise ValueError("the frame must not be longer than a block")
    home = _blk(pos, block)
    inner = F.expr(f"(`{pos}` - 1) % {block}")
    homes = [home]
    if before:
        homes.append(F.when(inner >= block - before, home + 1))
    if after:
        homes.append(F.when((inner < after) & (home > 0), home - 1))
    copies = F.explode(F.array_compact(F.array(*homes))) if len(homes) > 1 else home
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    spread = df.withColumn("_home", home).withColumn("_blk", copies)
    if made:
        spread = made(spread.repartition(*keys, "_blk").sortWithinPartitions(*keys, "_blk", pos))
    out = spread.select("*", *[fn(w).alias(name) for name, fn in columns.items()])
    return out.filter("_blk = _home").drop("_blk", "_home")


def running(
    df: DataFrame,
    keys: list[str],
    pos: str,
    columns: dict[str, tuple[str, Column, bool]],
    block: int | None = None,
) -> DataFrame:
    """Cumulative aggregates: ``{out: (kind, value, inclusive)}``, kind in sum/max/min.

    ``pos`` needs to be unique within a group but not dense.
    """
    block = block or BLOCK
    b = df.withColumn("_blk", _blk(pos, block))
    for name, (_, value, _) in columns.items():
        b = b.withColumn(f"_v_{name}", value)
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    local = b.select(
        "*",
        *[
            _AGG[kind](f"_v_{name}")
            .over(w.rowsBetween(Window.unboundedPreceding, 0 if incl else -1))
            .alias(f"_l_{name}")
            for name, (kind, _, incl) in columns.items()
        ],
    )
    # Only groups that reach past their first block need offsets from earlier blocks.
    long_groups = b.filter(F.col("_blk") > 0).select(*keys).distinct()
    totals = (
        b.join(long_groups, keys, "left_semi")
        .groupBy(*keys, "_blk")
        .agg(*[_AGG[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _, _) in columns.items()])
    )
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_blk",
        *[_AGG[kind](f"_t_{name}").over(wb).alias(f"_o_{name}") for name, (kind, _, _) in columns.items()],
    ).filter(F.col("_blk") > 0)
    joined = local.join(offsets, [*keys, "_blk"], "left")
    for name, (kind, _, _) in columns.items():
        l, o = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        if kind == "sum":
            joined = joined.withColumn(name, F.coalesce(l, F.lit(0)) + F.coalesce(o, F.lit(0)))
        else:
            joined = joined.withColumn(name, (F.greatest if kind == "max" else F.least)(l, o))
    drop = ["_blk"] + [f"_{p}_{n}" for n in columns for p in "vlo"]
    return joined.drop(*drop)


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Running sums of an array of longs inside its row, by blocks: appending to one array is quadratic in its length."""
    start = F.struct(F.lit(0).cast("long").alias("t"), F.array().cast("array<bigint>").alias("o"))
    step = lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["o"], F.array(acc["t"] + x)).alias("o"))
    scan = lambda a: F.aggregate(a, start, step, lambda acc: acc["o"])
    zero = F.lit(0).cast("long")

    def shifted(blocks: Column, ends: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.when(i == 0, zero).otherwise(F.try_element_at(ends, i)))))

    def summed(a: Column) -> Column:
        last = F.greatest(F.size(a) - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(last / block).cast("int")), lambda k: scan(F.slice(a, k * block + 1, block)))
        return T.let(blocks, lambda bs: T.let(scan(F.transform(bs, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), zero))), lambda ends: shifted(bs, ends)))

    return T.let(values, summed)


def dense_pos(df: DataFrame, keys: list[str], order: str, out: str = "pos", block: int | None = None) -> DataFrame:
    """Row number for a unique integer ``order`` (>= 1) within each group."""
    return running(df, keys, order, {out: ("sum", F.lit(1).cast("long"), True)}, block)


def ranked(df: DataFrame, order: list, out: str = "pos", keys: list[str] | None = None) -> DataFrame:
    """Row numbers from 1 in any sort order, of all rows or within ``keys``; equal rows get different numbers.

    Rows are sorted over all tasks by range. A row's number is its place in its task plus the rows of its
    group in the tasks before, from a table of one count per (group, task). A group of any size
    spans as many tasks as it needs. The sorted rows are written, so that every number comes from one sort.
    """
    keys = keys or []
    by = [*keys, *order, "_same"]
    d = df.withColumn("_same", F.monotonically_increasing_id())
    d = d.repartitionByRange(*by).sortWithinPartitions(*by).drop("_same")
    d = cut(d.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    n = d.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One row per task and group: the list is as long as the list of tasks.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).select(*keys, "_part", "_before")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys] + [F.col("l._part") == F.col("r._part")]
    j = d.alias("l").join(n.alias("r"), reduce(lambda a, b: a & b, same))
    return j.select("l.*", (F.col("l._at") + F.col("r._before")).alias(out)).drop("_part", "_at")


def islands(df: DataFrame, keys: list[str], pos: str, opens: Column, out: str, block: int | None = None) -> DataFrame:
    """Number runs of rows; a row where ``opens`` holds starts a new run."""
    return running(df, keys, pos, {out: ("sum", opens.cast("long"), True)}, block)


# --- greedy segmentation ------------------------------------------------------------


def _compose(first: int, last: int, jump: np.ndarray) -> np.ndarray:
    """For each position in [first, last] the first reached position beyond ``last``."""
    n = last - first + 1
    out = np.empty(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        j = int(jump[i])
        out[i] = j if j > last else out[j - first]
    return out


def greedy_starts(
    df: DataFrame,
    key: str,
    pos: str,
    nxt: str,
    reach: int,
    block: int | None = None,
    fan: int = 1024,
) -> DataFrame:
    """``(key, pos)`` of the segment starts: 1, nxt(1), nxt(nxt(1)), ...

    ``nxt`` is the start of the following segment if a segment starts at this row, at most
    ``reach`` rows ahead; it depends on the row's neighbourhood alone and is computed by
    ``with_window``. The walk itself is sequential, so each block is reduced to a map
    "entry position -> first position after the block" for its ``reach`` possible entries,
    the maps are combined ``fan`` blocks at a time, and the entry of every block is then
    handed down again. No task holds more than a block or ``fan * reach`` map rows.
    """
    block = block or max(BLOCK, reach)
    if reach > block:
        raise ValueError("a segment must not be longer than a block")
    kt = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col(pos).cast("long").alias("p"), F.col(nxt).cast("long").alias("n"))
    rows = rows.withColumn("b", F.expr(f"(p - 1) div {block}"))

    def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        p, n = pdf["p"].to_numpy(), pdf["n"].to_numpy()
        out = _compose(int(p[0]), int(p[-1]), n)
        k = min(reach, len(p))
        return pd.DataFrame({key: pdf[key].iloc[:k].to_numpy(), "b": pdf["b"].iloc[:k].to_numpy(), "entry": p[:k], "leave": out[:k]})

    # Groups of one block start at 1 and need no map.
    long_groups = rows.filter("b > 0").select(key).distinct()
    maps = (
        rows.join(long_groups, key, "left_semi")
        .groupBy(key, "b")
        .applyInPandas(block_map, f"{key} {kt}, b long, entry long, leave long")
    )

    def fold_map(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = {b: dict(zip(g["entry"], g["leave"])) for b, g in pdf.groupby("b")}
        order = sorted(blocks)
        k, s = pdf[key].iloc[0], int(pdf["s"].iloc[0])
        out = []
        for e in sorted(blocks[order[0]]):
            cur = e
            for b in order:
                cur = blocks[b].get(cur, cur)
            out.append((k, s, e, cur))
        return pd.DataFrame(out, columns=[key, "s", "entry", "leave"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entries of the blocks of one super-block, given the entry of the super-block."""
        blocks = {b: dict(zip(g["entry"], g["leave"])) for b, g in pdf.groupby("b")}
        cur, out, k = int(pdf["first"].iloc[0]), [], pdf[key].iloc[0]
        for b in sorted(blocks):
            if cur in blocks[b]:
                out.append((k, b, cur))
                cur = int(blocks[b][cur])
        return pd.DataFrame(out, columns=[key, "b", "first"])

    grouped = maps.withColumn("s", F.expr(f"b div {fan}"))
    supers = grouped.groupBy(key, "s").applyInPandas(fold_map, f"{key} {kt}, s long, entry long, leave long")
    top = supers.withColumn("first", F.lit(1).cast("long")).withColumnRenamed("s", "b")
    top_entry = (
        top.groupBy(key).applyInPandas(walk, f"{key} {kt}, b long, first long").withColumnRenamed("b", "s")
    )
    entries = (
        grouped.join(top_entry, [key, "s"])
        .groupBy(key, "s")
        .applyInPandas(walk, f"{key} {kt}, b long, first long")
    )

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walks the sorted blocks of a task; only the place in the walk is kept from batch to batch."""
        at, cur = None, 0
        for pdf in batches:
            keys, blocks, first = pdf[key].tolist(), pdf["b"].tolist(), pdf["first"].tolist()
            hit = []
            for i, (k, b, p, n) in enumerate(zip(keys, blocks, pdf["p"].tolist(), pdf["n"].tolist(), strict=True)):
                if (k, b) != at:
                    at, cur = (k, b), first[i]
                if p == cur:
                    hit.append(i)
                    cur = n
            yield pdf.iloc[hit][[key, "b", "p"]]

    entered = (
        rows.join(entries.filter("b > 0"), [key, "b"], "left")
        .withColumn("first", F.when(F.col("b") == 0, F.lit(1).cast("long")).otherwise(F.col("first")))
        .filter(F.col("first").isNotNull())
    )
    # One call per task: a call per block costs more than its walk where most groups are short.
    entered = entered.select(key, "b", "p", "n", "first").repartition(key, "b").sortWithinPartitions(key, "b", "p")
    starts = entered.mapInPandas(mark, f"{key} {kt}, b long, p long")
    return starts.select(key, F.col("p").alias(pos))
