"""Exact top-k by inner product: norm buckets, each pruned by length or by coordinates.

Vectors stand in order of length and are cut into buckets. A query first meets the longest bucket;
its k-th score there is a threshold. A bucket whose longest vector can't reach the threshold at any
angle is never paired with the query's block. In every other bucket the threshold over the two
lengths is the cosine that a match needs at least. If that is high, the query's largest coordinates
bound those of a match, and only vectors within the bounds are looked at; if it is low, vectors
that are too short are left out. What remains is verified by exact products.

Blocks of queries meet blocks of vectors on a grid, so no task holds all of either side.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor
do rows without id; of several rows of one id the largest vector (in array order) counts; vectors
meet those of their own dimension only; an empty vector scores 0; scores beyond a long are cut to its
range; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.llm import store
from cueflow.llm.registry import query

K, BUCKET, QUERIES = 20, 4096, 1024
#: Cosine from which coordinates prune better than length does; how many coordinates are looked at.
COORDINATE_COSINE, FOCUS = 0.75, 4
_LONG = np.iinfo(np.int64)
PACKED = "dim int, key long, n int, longest double, ids binary, vectors binary, bytes int"


def whole(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, or null if one is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = df.select(F.col(vec_id).cast("long").alias("id"), whole(F.col(vector)).alias("v")).filter("id is not null and v is not null")
    v = v.groupBy("id").agg(F.max("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def pack(v: DataFrame, rows: int) -> DataFrame:
    """Blocks of ``rows`` vectors of one dimension at most, longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            dim, n = table["dim"][0].as_py(), table.num_rows
            flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
            small = 2 if np.abs(flat.astype(float)).max(initial=0) < 32767 else 8
            ids = table["id"].to_numpy()
            cells = [[dim], [int(ids[0])], [n], [table["norm"][0].as_py()], [ids.astype("<i8").tobytes()], [flat.astype(f"<i{small}").tobytes()], [small]]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["dim", "key", "n", "longest", "ids", "vectors", "bytes"])

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting)
            waiting.clear()
            dims = table["dim"].to_numpy()
            a = 0
            while a < len(dims):
                b = min(a + rows, int(np.searchsorted(dims, dims[a], side="right")))
                if b - a < rows and b == len(dims) and not last:
                    break
                yield block(table.slice(a, b - a))
                a = b
            if a < len(dims):
                waiting.extend(table.slice(a).to_batches())

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                if sum(b.num_rows for b in waiting) >= rows:
                    yield from full(False)
        if waiting:
            yield from full(True)

    n = max(1, math.ceil(v.count() / rows))
    order = [F.col("dim"), F.col("norm").desc(), F.col("id")]
    return v.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, PACKED)


class Block:
    def __init__(self, dim: int, ids: bytes, data: bytes, width: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.v = np.frombuffer(data, f"<i{width}").reshape(len(self.ids), dim)
        self.f = self.v.astype(float)
        self.norm = np.sqrt((self.f**2).sum(1))
        self.most = np.abs(self.f).max(initial=0)
        self.orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def unit(self) -> np.ndarray:
        return self.f / np.maximum(self.norm, 1e-300)[:, None]

    def sorted(self, unit: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors in order of a coordinate of theirs, and that coordinate."""
        if f not in self.orders:
            order = np.argsort(unit[:, f], kind="stable")
            self.orders[f] = order, unit[order, f]
        return self.orders[f]


def products(q: Block, rows: np.ndarray, c: Block, cols) -> np.ndarray:
    """Exact inner products; whole numbers below 2^53 are exact as doubles."""
    if q.most * c.most * max(1, q.f.shape[1]) < 2**52:
        return (q.f[rows] @ c.f[cols].T).astype(np.int64)
    exact = q.v[rows].astype(object) @ c.v[cols].astype(object).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        on = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[on], scores[on]
    order = np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == _LONG.min else -scores))[:k]
    return ids[order], scores[order]


def needed(theta: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """The length from which a vector can reach a query's threshold; -inf if any can."""
    with np.errstate(divide="ignore", invalid="ignore"):
        t = theta / norm
    return np.where((theta > 0) & (norm > 0), t * (1 - 1e-9) - 1e-9, -np.inf)


def search(q: Block, theta: np.ndarray, c: Block, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query of the block, its best of the bucket that reach the threshold."""
    none = np.zeros(0, np.int64)
    out = [(none, none)] * len(q.ids)
    if not len(c.ids):
        return out
    need = needed(theta, q.norm)
    longest = c.norm[0]
    cosine = np.where(need > -np.inf, need / max(longest, 1e-300), -np.inf)
    by_coordinate = np.flatnonzero((cosine >= COORDINATE_COSINE) & (cosine <= 1)) if c.f.shape[1] > FOCUS else np.zeros(0, int)
    by_length = np.setdiff1d(np.flatnonzero(cosine <= 1), by_coordinate)
    # Lengths fall along the bucket: each query reads a prefix of it.
    reach = np.searchsorted(-c.norm, -need, side="right")
    for part in np.array_split(by_length[np.argsort(reach[by_length])], max(1, -(-len(by_length) // 128))):
        if not len(part):
            continue
        s = products(q, part, c, slice(0, int(reach[part].max())))
        for i, row in zip(part, s, strict=True):
            ok = np.flatnonzero(row >= theta[i])
            ok = ok[c.ids[ok] != q.ids[i]]
            out[i] = best(c.ids[ok], row[ok], k)
    if len(by_coordinate):
        unit = c.unit()
    for i in by_coordinate:
        u, t = q.f[i] / q.norm[i], cosine[i]
        focus = np.argsort(-np.abs(u), kind="stable")[:FOCUS]
        slack = np.sqrt(np.maximum(0, (1 - t * t) * (1 - u[focus] ** 2))) + 1e-9
        low, high = u[focus] * t - slack, u[focus] * t + slack
        # Beyond the coordinate's own extreme every larger value is allowed (and every smaller one at the other end).
        high = np.where(u[focus] >= t, 1.0 + 1e-9, high)
        low = np.where(u[focus] <= -t, -1.0 - 1e-9, low)
        order, values = c.sorted(unit, int(focus[0]))
        ok = order[np.searchsorted(values, low[0], side="left") : np.searchsorted(values, high[0], side="right")]
        for f, a, b in zip(focus[1:], low[1:], high[1:], strict=True):
            ok = ok[(unit[ok, f] >= a) & (unit[ok, f] <= b)]
        ok = np.sort(ok[c.ids[ok] != q.ids[i]])
        if len(ok):
            s = products(q, np.array([i]), c, ok)[0]
            on = s >= theta[i]
            out[i] = best(c.ids[ok[on]], s[on], k)
    return out


FOUND = "dim int, key long, ids binary, vectors binary, bytes int, theta binary, need double, hits array<struct<query_id:long,vec_id:long,score:long>>"
_HIT = pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))


def _hits(q: Block, found) -> pa.Array:
    rows = [{"query_id": int(i), "vec_id": int(a), "score": int(b)} for i, (ids, s) in zip(q.ids, found, strict=True) for a, b in zip(ids, s, strict=True)]
    return pa.array([rows], _HIT)


def topk(df: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best of all rows for each row that ``queries`` (on ``id``) picks."""
    v = store.cut(vectors(df, vec_id, vector), "vectors")
    buckets = store.cut(pack(v, BUCKET), "buckets")
    asked = store.cut(pack(v.filter(queries), QUERIES), "queries")
    n_buckets, n_asked = buckets.count(), asked.count()

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, c = Block(r["dim"], r["ids"], r["vectors"], r["bytes"]), Block(r["dim"], r["c_ids"], r["c_vectors"], r["c_bytes"])
                found = search(q, np.full(len(q.ids), float(_LONG.min)), c, k)
                theta = np.array([float(s[-1]) if len(s) == k else float(_LONG.min) for _, s in found])
                theta = np.where(np.abs(theta) < 2**52, theta, float(_LONG.min))
                need = float(needed(theta, q.norm).min()) if len(theta) else 0.0
                cells = [pa.array([r["dim"]], pa.int32()), pa.array([r["key"]], pa.int64()), pa.array([r["ids"]], pa.binary()), pa.array([r["vectors"]], pa.binary()), pa.array([r["bytes"]], pa.int32()), pa.array([theta.tobytes()], pa.binary()), pa.array([need], pa.float64()), _hits(q, found)]
                yield pa.RecordBatch.from_arrays(cells, names=[f.split()[0] for f in ("dim d", "key k", "ids i", "vectors v", "bytes b", "theta t", "need n", "hits h")])

    # The longest bucket of each dimension, once for every few blocks of queries.
    spread = max(1, n_asked // 8)
    side = buckets.select("dim", F.col("key").alias("c_key"), F.col("longest").alias("c_longest"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"), F.col("bytes").alias("c_bytes"))
    first = buckets.groupBy("dim").agg(F.max(F.struct("longest", -F.col("key"))).alias("m")).select("dim", (-F.col("m.col2")).alias("c_key"), F.lit(True).alias("seed"))
    marked = side.join(first, ["dim", "c_key"], "left")
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = marked.filter("seed").withColumn("s", every(spread))
    seeded = store.cut(asked.withColumn("s", salt("key", spread)).join(one, ["dim", "s"]).mapInArrow(seed, FOUND), "seeded")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, c = Block(r["dim"], r["ids"], r["vectors"], r["bytes"]), Block(r["dim"], r["c_ids"], r["c_vectors"], r["c_bytes"])
                yield pa.RecordBatch.from_arrays([_hits(q, search(q, np.frombuffer(r["theta"]), c, k))], names=["hits"])

    rows, cols = max(1, math.ceil(n_asked / 16)), max(1, math.ceil(n_buckets / 4))
    a = seeded.drop("hits").withColumns({"r": salt("key", rows)}).withColumn("c", every(cols))
    b = marked.filter("seed is null").drop("seed").withColumns({"c": salt("c_key", cols)}).withColumn("r", every(rows))
    rest = a.join(b, (a.dim == b.dim) & (a.r == b.r) & (a.c == b.c) & (b.c_longest >= a.need)).select(a.dim, "ids", "vectors", "bytes", "theta", "c_ids", "c_vectors", "c_bytes")
    rest = rest.mapInArrow(probe, "hits array<struct<query_id:long,vec_id:long,score:long>>")
    hits = seeded.select("hits").unionByName(rest).select(F.inline("hits"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (SELECT vec_id, [cast(floor(64 * x::DOUBLE) AS BIGINT) for x in embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)]) AS BIGINT) AS score
    FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op1_norm_bucket_topk", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(store.read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
