"""N-gram Jaccard join in its metric space: pivots, Voronoi cells, windows, exact recursion.

1 - Jaccard is a metric, so of two texts at distance 0.25 at most, the distances to any pivot
differ by 0.25 at most. A region of texts is split by pivots: a text within 0.25 of a pivot
is linked to it; every text belongs to the cell of its nearest pivot, and a cell of radius r also
gets the texts within r + 0.25 of its pivot, its boundary. Cells are joined in the same way until
they are small or linked throughout, and small ones are counted out exactly.

Most texts share no shingle with any other and are at distance 1 from every pivot. The first
regions therefore come from shingles: of a set of n shingles at most n // 4 are missing from a partner,
so any n // 4 + 1 of them, chosen by one order for all texts, hold a shared one. The order is
by rarity, counted over all texts, so passages that many texts share seldom count. Texts that
share such a shingle are in one region; whoever shares none is linked with nothing.

Shingles travel as packed arrays, a row per batch of texts and range of hashes. Regions above
``REGION_ROWS`` texts are split by pivots as Spark jobs in which every task sees a bounded block;
smaller ones are joined inside a task. A set's members are 64-bit hashes.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; with fewer words than ``N`` the whole sequence is the one shingle; equal sets are linked;
repeated rows get the same component; of different texts under one id the one with the largest set
is compared, and all rows of the id get its component; a null id is linked with nothing and its
component is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.llm import store, words
from cueflow.llm.components import components
from cueflow.llm.registry import query

N = 5
#: Hashes below this share of all are counted in full; rarity is known for them.
SAMPLED = 0.36
#: Documents per range of hashes, and per bucket in which documents meet their counts again.
RANGE_DOCS, BUCKET_DOCS = 2000, 10_000
SLICE_BYTES = 4 << 20
REGION_ROWS, REGION_SHINGLES = 10_000, 4_000_000
CHUNK_ROWS, PIVOTS, LEVELS = 1000, 16, 6
LEAF = 48
_T = np.uint64(int(SAMPLED * 2**64))


def sets_of(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The sorted shingle hashes of every text."""
    t = words.Texts(texts, lower=True)
    h = t.hash()
    w, at = words.windows(h, t.doc, n)
    cut = np.searchsorted(at, np.append(t.word_at, len(h)))
    out = []
    for i in range(t.n):
        k = int(t.n_words[i])
        if k >= n:
            out.append(np.unique(w[cut[i] : cut[i + 1]]))
        elif k:
            own = h[t.word_at[i] : t.word_at[i] + k]
            out.append(words.mix(np.sum(own * words.powers(n)[1 : k + 1], keepdims=True) ^ words.mix(np.array([k], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a = np.sum(s * words._C1 + words._C2, dtype=np.uint64)
    b = np.sum(words.mix(s ^ words._C1), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def linked(overlap, a, b):
    """100 * intersection >= 75 * union, in whole numbers."""
    return 100 * overlap >= 75 * (a + b - overlap)


# ---------------------------------------------------------------- first regions

RAW = "r int, base long, h binary, lo binary, hi binary, info binary"
_RAW = pa.schema([("r", pa.int32()), ("base", pa.int64()), ("h", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary()), ("info", pa.binary())])
_INFO = np.dtype([("doc", "<i8"), ("n", "<i4"), ("sampled", "<i4"), ("s1", "<i8"), ("s2", "<i8")])


def _split_ids(ids: np.ndarray) -> tuple[int, bytes, bytes]:
    """Ids as a base and offsets, the low and the high halves apart: the high ones compress away."""
    base = int(ids.min())
    off = (ids - base).astype("<u8")
    return base, (off & np.uint64(0xFFFF)).astype("<u2").tobytes(), (off >> np.uint64(16)).astype("<u8" if off.max() >> np.uint64(48) else "<u4").tobytes()


def _join_ids(base: int, lo: bytes, hi: bytes) -> np.ndarray:
    low = np.frombuffer(lo, "<u2").astype(np.uint64)
    high = np.frombuffer(hi, "<u4" if len(hi) == 2 * len(lo) else "<u8").astype(np.uint64)
    return (low | high << np.uint64(16)).astype(np.int64) + base


def _planes(h: np.ndarray) -> bytes:
    """Sorted hashes byte plane by byte plane: the leading planes compress."""
    return h.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _shingled(ranges: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for a, b, texts in words.slices(batch, "text", SLICE_BYTES):
                ids, sets = all_ids[a:b].astype(np.int64), sets_of(texts)
                info = np.zeros(len(ids), _INFO)
                info["doc"], info["n"] = ids, [len(s) for s in sets]
                info["sampled"] = [int(np.searchsorted(s, _T)) for s in sets]
                sig = [signature(s) for s in sets]
                info["s1"], info["s2"] = [s[0] for s in sig], [s[1] for s in sig]
                used = [s[: max(int(k), len(s) // 4 + 1)] for s, k in zip(sets, info["sampled"], strict=True)]
                h = np.concatenate(used)
                doc = np.repeat(ids, [len(u) for u in used])
                order = np.argsort(h)
                h, doc = h[order], doc[order]
                r = (h % np.uint64(ranges)).astype(np.int32)
                order = np.argsort(r, kind="stable")
                h, doc, r = h[order], doc[order], r[order]
                cut = np.searchsorted(r, np.arange(ranges + 1))
                rows = []
                for k in range(ranges):
                    x, y = cut[k], cut[k + 1]
                    if x < y:
                        rows.append((k, *_split_ids(doc[x:y]), _planes(h[x:y])))
                bucket = ids % buckets
                for k in np.unique(bucket):
                    rows.append((ranges + int(k), 0, b"", b"", b"", info[bucket == k].tobytes()))
                cols = list(zip(*[(x[0], x[1], x[4], x[2], x[3], x[5] if len(x) > 5 else b"") for x in rows], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RAW, strict=True)], schema=_RAW)

    return run


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted hashes: begin of each run and its length."""
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(h)))


SHARED = "b int, docs binary, h binary, df binary, info binary"


def _counted(ranges: int, buckets: int):
    """How many texts hold each shingle of a range; passes on those that two or more hold."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["r"].iloc[0])
        if r >= ranges:
            return pd.DataFrame({"b": pd.Series([r - ranges], dtype="int32"), "docs": [b""], "h": [b""], "df": [b""], "info": [b"".join(pdf["info"])]})
        h = np.concatenate([_unplanes(x) for x in pdf["h"]])
        doc = np.concatenate([_join_ids(*x) for x in zip(pdf["base"], pdf["lo"], pdf["hi"], strict=True)])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[once], doc[once]
        begin, n = _runs(h)
        df = np.repeat(n, n)
        on = df > 1
        h, doc, df = h[on], doc[on], np.minimum(df[on], 2**32 - 1)
        bucket = doc % buckets
        order = np.argsort(bucket, kind="stable")
        h, doc, df, bucket = h[order], doc[order], df[order], bucket[order]
        begin, n = _runs(bucket)
        return pd.DataFrame({
            "b": pd.Series(bucket[begin], dtype="int32"), "docs": [doc[x : x + k].astype("<i8").tobytes() for x, k in zip(begin, n, strict=True)],
            "h": [h[x : x + k].astype("<u8").tobytes() for x, k in zip(begin, n, strict=True)], "df": [df[x : x + k].astype("<u4").tobytes() for x, k in zip(begin, n, strict=True)], "info": [b""] * len(begin),
        })

    return run


CHOSEN = "doc_id long, n long, s1 long, s2 long, compared boolean, keys array<long>"


def _chosen():
    """For each text, those of its first n // 4 + 1 shingles in order of rarity that others hold too."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        info = np.frombuffer(b"".join(pdf["info"]), _INFO)
        info = info[np.lexsort((-info["s2"], -info["s1"], -info["n"].astype(np.int64), info["doc"]))]
        doc = np.frombuffer(b"".join(pdf["docs"]), "<i8")
        h, df = np.frombuffer(b"".join(pdf["h"]), "<u8"), np.frombuffer(b"".join(pdf["df"]), "<u4").astype(np.int64)
        beyond = h >= _T
        order = np.lexsort((h, np.where(beyond, 2**33, df), doc))
        doc, h, beyond = doc[order], h[order], beyond[order]
        compared = np.concatenate([[True], info["doc"][1:] != info["doc"][:-1]])
        a, b = np.searchsorted(doc, info["doc"]), np.searchsorted(doc, info["doc"], side="right")
        keys = []
        for i, x, y, first in zip(info, a, b, compared, strict=True):
            if not first or x == y or not i["n"]:
                keys.append(np.zeros(0, np.int64))
                continue
            need, shared = int(i["n"]) // 4 + 1, int((~beyond[x:y]).sum())
            single = int(i["sampled"]) - shared  # sampled shingles of this text alone: the rarest
            left = need - single
            if i["sampled"] < need:
                left = y - x  # all that was indexed is needed
            keys.append(h[x : x + max(0, left)].astype(np.int64) if left < y - x else h[x:y].astype(np.int64))
        return pd.DataFrame({"doc_id": info["doc"], "n": info["n"].astype(np.int64), "s1": info["s1"], "s2": info["s2"], "compared": compared, "keys": keys})

    return run


def candidates(docs: DataFrame) -> DataFrame:
    """One row per document: size and signature of its set, and the shingles by which it may have links."""
    n = docs.count()
    ranges, buckets = max(1, math.ceil(n / RANGE_DOCS)), max(1, math.ceil(n / BUCKET_DOCS))
    raw = docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(_shingled(ranges, buckets), RAW)
    shared = raw.groupBy("r").applyInPandas(_counted(ranges, buckets), SHARED)
    return shared.groupBy("b").applyInPandas(_chosen(), CHOSEN)


# ---------------------------------------------------------------- joins inside a task


class Links:
    """Union-find over positions; the smaller position is the root."""

    def __init__(self, labels: np.ndarray):
        self.up = np.arange(len(labels))
        first: dict[int, int] = {}
        for i, x in enumerate(labels.tolist()):
            self.up[i] = first.setdefault(x, i)
        self.made: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.made.append((i, j))

    def roots(self, rows: np.ndarray) -> np.ndarray:
        r = self.up[rows]
        while (nxt := self.up[r]).tolist() != r.tolist():
            r = nxt
        return r


def overlaps(sets: list[np.ndarray], rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    size = np.array([len(sets[i]) for i in rows])
    flat = np.concatenate([sets[i] for i in rows])
    at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
    return np.add.reduceat((pivot[at] == flat).astype(np.int64), np.cumsum(size) - size)


class Holders:
    """Who holds each shingle that two or more of some texts share."""

    def __init__(self, flat: np.ndarray, doc: np.ndarray, n_docs: int):
        order = np.argsort(flat, kind="stable")
        begin, n = _runs(flat[order])
        self.begin, self.n = begin[n > 1], n[n > 1]
        self.doc = doc[order]
        run_of = np.repeat(np.arange(len(self.begin)), self.n)
        held = self.doc[self._entries(self.begin, self.n)]
        by_doc = np.argsort(held, kind="stable")
        self.has, self.cut = run_of[by_doc], np.searchsorted(held[by_doc], np.arange(n_docs + 1))

    @staticmethod
    def _entries(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))

    def met(self, i: int) -> np.ndarray:
        """The holders of each of a text's shared shingles, one after the other."""
        own = self.has[self.cut[i] : self.cut[i + 1]]
        return self.doc[self._entries(self.begin[own], self.n[own])]


def count_out(sets: list[np.ndarray], rows: np.ndarray, links: Links) -> None:
    """All links among ``rows``: texts that share one of their rarest n // 4 + 1 shingles are counted out."""
    size = np.array([len(sets[i]) for i in rows])
    flat, doc = np.concatenate([sets[i] for i in rows]), np.repeat(np.arange(len(rows)), size)
    order = np.argsort(flat, kind="stable")
    _, n = _runs(flat[order])
    df = np.empty(len(flat), np.int64)
    df[order] = np.repeat(n, n)
    order = np.lexsort((flat, df, doc))
    rare = order[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(size // 4 + 1, size)]
    few = Holders(flat[rare], doc[rare], len(rows))
    everything: Holders | None = None
    for i in range(len(rows) - 1):
        near = few.met(i)
        near = np.unique(near[near > i])
        if len(near):
            near = near[links.roots(rows[near]) != links.root(int(rows[i]))]
        if not len(near):
            continue
        if len(near) > LEAF:
            everything = everything or Holders(flat, doc, len(rows))
            met = everything.met(i)
            count = np.bincount(met, minlength=len(rows))[near]
        else:
            count = overlaps(sets, rows[near], sets[rows[i]])
        for j in near[linked(count, size[i], size[near])]:
            links.link(int(rows[i]), int(rows[j]))


def join_region(sets: list[np.ndarray], rows: np.ndarray, links: Links) -> None:
    """Link all of ``rows`` that are linked, by pivots and windows."""
    if len(rows) < 2 or len(np.unique(links.roots(rows))) == 1:
        return
    if len(rows) <= LEAF:
        count_out(sets, rows, links)
        return
    # Pivots that aren't linked yet, spread over the region.
    _, at = np.unique(links.roots(rows), return_index=True)
    pivots = rows[at[np.linspace(0, len(at) - 1, min(PIVOTS, len(at))).astype(int)]]
    size = np.array([len(sets[i]) for i in rows])
    d = np.ones((len(pivots), len(rows)))
    for k, p in enumerate(pivots):
        o = overlaps(sets, rows, sets[p])
        for i in rows[linked(o, size, len(sets[p]))]:
            links.link(int(p), int(i))
        d[k] = 1 - o / (size + len(sets[p]) - o)
    nearest, least = d.argmin(0), d.min(0)
    for k in range(len(pivots)):
        core = (nearest == k) & (least < 1)
        if core.any():
            _recurse(sets, rows[core | (d[k] <= d[k][core].max() + 0.25 + 1e-9)], len(rows), links)
    if (least == 1).any():
        _recurse(sets, rows[least >= 0.75 - 1e-9], len(rows), links)


def _recurse(sets: list[np.ndarray], rows: np.ndarray, before: int, links: Links) -> None:
    if len(rows) > 0.6 * before and len(np.unique(links.roots(rows))) > 1:
        count_out(sets, rows, links)
    else:
        join_region(sets, rows, links)


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Consecutive rows of one value of ``column``; sorted input comes in whole groups."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cut, cut[1:], strict=False):
            part = batch.slice(a, b - a)
            if waiting and waiting[0].column(batch.schema.get_field_index(column))[0].as_py() != key[a]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(part)
    if waiting:
        yield pa.Table.from_batches(waiting)


def join_jobs(jobs: DataFrame) -> DataFrame:
    """Edges found in each ``job`` (rows: job long, doc long, label long, h binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in groups(batches, "job"):
            ids, sets = t["doc"].to_pylist(), [np.frombuffer(x, "<u8") for x in t["h"].to_pylist()]
            order = sorted(range(len(ids)), key=ids.__getitem__)
            ids, sets = [ids[i] for i in order], [sets[i] for i in order]
            links = Links(t["label"].to_numpy()[order])
            join_region(sets, np.arange(len(ids)), links)
            a += [ids[i] for i, _ in links.made]
            b += [ids[j] for _, j in links.made]
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return jobs.select("job", "doc", "label", "h").repartition("job").sortWithinPartitions("job").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- regions above a task's size


def split_region(sets: DataFrame) -> DataFrame:
    """Edges of large regions (rows: region, doc, h), by rounds of pivots over bounded blocks."""
    spark, found, rest = sets.sparkSession, [], sets
    for level in range(LEVELS):
        size = rest.groupBy("region").agg(F.count("*").alias("rows"))
        large = size.filter(F.col("rows") > REGION_ROWS).withColumn("chunks", F.ceil(F.col("rows") / CHUNK_ROWS).cast("int"))
        large = store.cut(large, "large")
        small = rest.join(large.select("region"), "region", "left_anti")
        found.append(store.cut(join_jobs(small.select(F.col("region").alias("job"), "doc", F.col("doc").alias("label"), "h")), "links"))
        if large.isEmpty():
            break
        own = store.cut(rest.join(large.select("region", "chunks"), "region"), "own")
        if level == LEVELS - 1:
            found.append(store.cut(join_jobs(_grid(own, own, F.lit(True))), "links"))
            break
        found, rest = _pivot_round(own, large, level, found)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _pivot_round(own: DataFrame, large: DataFrame, level: int, found: list[DataFrame]):
    # One pivot per region and slot: the text of the smallest hash, kept apart before the shuffle.
    h = F.xxhash64("doc", F.lit(level))
    pivots = own.groupBy("region", F.pmod(h, F.lit(PIVOTS)).alias("slot")).agg(F.min_by(F.struct("doc", "h"), h).alias("p"))
    pivots = store.cut(pivots.select("region", F.col("p.doc").alias("doc"), F.col("p.h").alias("h")), "pivots")
    chunk = F.pmod(F.xxhash64("doc", F.lit("chunk")), F.col("chunks")).cast("int")
    left = own.withColumn("chunk", chunk).groupBy("region", "chunk")
    right = pivots.join(large.select("region", F.expr("sequence(0, chunks - 1)").alias("every")), "region").select("region", "doc", "h", F.explode("every").alias("chunk")).groupBy("region", "chunk")

    def measure(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("region", pa.int64()), ("doc", pa.int64()), ("pivot", pa.int64()), ("d", pa.float64()), ("on", pa.bool_()))})
        sets = [np.frombuffer(x, "<u8") for x in rows["h"].to_pylist()]
        size = np.array([len(s) for s in sets])
        docs, out = rows["doc"].to_numpy(), []
        for p, raw in zip(pivots["doc"].to_pylist(), pivots["h"].to_pylist(), strict=True):
            s = np.frombuffer(raw, "<u8")
            o = overlaps(sets, np.arange(len(sets)), s)
            # Beyond 0.5 a text is in no window: a cell's radius is 0.25 at most.
            d, on = 1 - o / (size + len(s) - o), linked(o, size, len(s))
            k = np.flatnonzero((d <= 0.5 + 1e-9) | on)
            out.append((docs[k], np.full(len(k), p), d[k], on[k]))
        doc, pivot, d, on = (np.concatenate(x) for x in zip(*out, strict=True))
        region = np.full(len(doc), rows["region"][0].as_py())
        return pa.table({"region": pa.array(region, pa.int64()), "doc": pa.array(doc, pa.int64()), "pivot": pa.array(pivot, pa.int64()), "d": pa.array(d, pa.float64()), "on": pa.array(on, pa.bool_())})

    near = store.cut(left.cogroup(right).applyInArrow(measure, "region long, doc long, pivot long, d double, on boolean"), "near")
    found = [*found, near.filter("on").select(F.col("doc").alias("a"), F.col("pivot").alias("b"))]
    edges = found[0]
    for f in found[1:]:
        edges = edges.unionByName(f)
    label = components(edges)
    cores = near.filter("on").groupBy("region", "doc").agg(F.min(F.struct("d", "pivot")).alias("m")).select("region", "doc", F.col("m.pivot").alias("pivot"), F.col("m.d").alias("d"))
    radius = cores.groupBy("region", "pivot").agg(F.max("d").alias("r"), F.count("*").alias("rows"))
    named = lambda df, key, name: df.join(label.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    border = named(named(near.join(radius, ["region", "pivot"]).filter(F.col("d") <= F.col("r") + 0.25 + 1e-9), "doc", "label"), "pivot", "cell").filter("label <> cell")
    border = store.cut(border.select("region", "pivot", "doc", "label", F.col("cell")), "border")
    outer = border.groupBy("region", "pivot").agg(F.count("*").alias("others"), F.first("cell").alias("cell"))
    met = outer.join(radius, ["region", "pivot"]).withColumns({"x": F.ceil(F.col("rows") / CHUNK_ROWS).cast("int"), "y": F.ceil(F.col("others") / CHUNK_ROWS).cast("int")})
    at = lambda n: F.pmod(F.xxhash64("doc", F.lit("grid")), F.col(n)).cast("int")
    inner = cores.join(met, ["region", "pivot"]).select("region", "pivot", "doc", F.col("cell").alias("label"), at("x").alias("i"), F.explode(F.expr("sequence(0, y - 1)")).alias("j"))
    outer = border.drop("cell").join(met, ["region", "pivot"]).select("region", "pivot", "doc", "label", F.explode(F.expr("sequence(0, x - 1)")).alias("i"), at("y").alias("j"))
    jobs = inner.unionByName(outer).withColumn("job", F.xxhash64("region", "pivot", "i", "j"))
    jobs = jobs.join(own.select("doc", "h"), "doc")
    found = [*found, store.cut(join_jobs(jobs), "links")]
    rest = own.join(cores.select("doc"), "doc", "left_anti").select("region", "doc", "h")
    return found, store.cut(rest, "rest")


def _grid(a: DataFrame, b: DataFrame, _) -> DataFrame:
    """Every pair of blocks of a region: the exact way for what pivots did not split."""
    at = F.pmod(F.xxhash64("doc", F.lit("grid")), F.col("chunks")).cast("int")
    d = a.withColumn("at", at)
    pairs = F.expr("transform(sequence(0, chunks - 1), x -> struct(least(x, at) as i, greatest(x, at) as j))")
    d = d.select("region", "doc", F.col("doc").alias("label"), "h", F.explode(pairs).alias("p"))
    return d.withColumn("job", F.xxhash64("region", "p.i", "p.j"))


def stars(entry: DataFrame) -> DataFrame:
    """Edges from every holder (rep) of a shared key to the smallest one."""
    least = entry.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    return entry.join(least, "key").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()


def above(members: DataFrame) -> DataFrame:
    """The regions that are too large for one task."""
    size = members.groupBy("region").agg(F.count("*").alias("rows"), F.sum(F.length("h") / 8).alias("all"))
    return size.filter((F.col("rows") > REGION_ROWS) | (F.col("all") > REGION_SHINGLES)).select("region")


def refined(members: DataFrame) -> DataFrame:
    """Regions (region, doc, h) cut anew: shingles by rarity among these texts, without sampling.

    Texts that share passages, but no n // 4 + 1 rarest shingle, part here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, raw = (batch.column(batch.schema.get_field_index(c)) for c in ("doc", "h"))
            for i in range(0, batch.num_rows, 64):
                sets = [np.frombuffer(x, "<i8") for x in raw.slice(i, 64).to_pylist()]
                n = [len(x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(docs.slice(i, 64).to_numpy(), n)), pa.array(np.concatenate(sets)), pa.array(np.repeat(n, n).astype(np.int64))], names=["rep", "key", "n"])

    e = members.select("doc", "h").mapInArrow(run, "rep long, key long, n long")
    df = e.groupBy("key").agg(F.count("*").alias("df"))
    first = F.row_number().over(Window.partitionBy("rep").orderBy("df", "key"))
    keys = e.join(df, "key").withColumn("place", first).filter("place <= n div 4 + 1 and df > 1").select("rep", "key")
    root = components(stars(store.cut(keys, "rare")))
    return members.drop("region").join(root.select(F.col("node").alias("doc"), F.col("root").alias("region")), "doc").select("region", "doc", "h")


# ---------------------------------------------------------------- the join


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    chosen = store.cut(candidates(docs), "shingled")
    mine = chosen.filter("compared and size(keys) > 0")
    # Equal sets count once from here on.
    same = store.cut(mine.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")), "sets")
    star = stars(same.select("rep", F.explode("keys").alias("key")))
    region = store.cut(components(star), "regions")
    wanted = region.join(same.select(F.col("rep").alias("node"), "s1", "s2"), "node")
    full = docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root, s1, s2 = (batch.column(batch.schema.get_field_index(c)) for c in ("node", "root", "s1", "s2"))
            for a, b, texts in words.slices(batch, "text"):
                sets = sets_of(texts)
                want = list(zip(s1.slice(a, b - a).to_pylist(), s2.slice(a, b - a).to_pylist(), strict=True))
                on = [i for i, s in enumerate(sets) if signature(s) == want[i]]
                yield pa.RecordBatch.from_arrays([root.slice(a, b - a).take(on), node.slice(a, b - a).take(on), pa.array([sets[i].astype("<u8").tobytes() for i in on], pa.binary())], names=["region", "doc", "h"])

    sets = store.cut(full.mapInArrow(build, "region long, doc long, h binary").dropDuplicates(["doc"]), "members")
    large = store.cut(above(sets), "large")
    if not large.isEmpty():
        sets = sets.join(large, "region", "left_anti").unionByName(store.cut(refined(sets.join(large, "region")), "refined"))
        large = store.cut(above(sets), "large")
    edges = join_jobs(sets.join(large, "region", "left_anti").select(F.col("region").alias("job"), "doc", F.col("doc").alias("label"), "h"))
    edges = store.cut(edges, "links")
    if not large.isEmpty():
        edges = edges.unionByName(split_region(sets.join(large, "region")))
    root = components(edges)
    # Every text to its set's representative, and that to its component.
    rep = mine.select("doc_id", "s1", "s2", "n").join(same.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"])
    component = rep.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("component_id"))
    out = chosen.select("doc_id", F.col("n").alias("n_shingles")).join(component, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in words.slices(batch, "text"):
                n = [len(s) for s in sets_of(texts)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return out.unionByName(docs.filter("doc_id is null").select("text").mapInArrow(bare, "doc_id long, n_shingles long, component_id long"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, one row per id; rows without an id stay."""
    kept = classes(docs.select("doc_id", "text")).filter("doc_id = component_id").select("doc_id").distinct()
    own, names = store.hidden(docs, "doc_id", "text")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = own.join(kept, "doc_id", "left_semi").withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return one.unionByName(own.filter("doc_id is null")).select(*names)


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(store.read(spark, sf_dir, "documents"))
