"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts word pairs over all rows that are labelled good, but for a fifth that is left out and sets the
thresholds. Words that hold a visible share of all text are the vocabulary (by their share there are at most
``2 / SHARE``); any other word is the class RARE in the pairs, and is drawn within its class from counts
of its own, with the same discounts. Numbers per vocabulary word (context sums, left mass, left neighbours)
are bounded by it and held by tasks; the tables of pairs and of rare words grow with the trusted text, and are
never held by one task or by the driver. They are written, and each text's pairs and rare words, counted per
text, meet them shard by shard; the parts of a text's log probability are then summed. Pairs of a visible share
(again a bounded number) are weighed where the text is read, so only the others travel and no shard is hot.

A text's cross-entropy per word is drawn towards its language's median by ``PRIOR_WORDS`` words, so
that very short texts aren't judged on a few words. A text is kept if it is at most at its language's
threshold: the ``UPPER`` quantile of held-out trusted text, of the same drawn score.

Defined results: a text without words, or null, sits at the median and is kept; null is a language like others;
a language's threshold is drawn to the weight of unknown words by ``PRIOR_ROWS`` rows, so one without trusted rows is not judged; without any trusted row
(counted or held out) everything is kept and the threshold is null; of several labels of a row the lowest counts;
texts of any length are read whole; repeated rows give repeated results; equal scores share a verdict; an empty table
gives no rows. Columns besides those named pass through.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.llm import store, words
from cueflow.llm.registry import query

PRIOR_WORDS, PRIOR_ROWS = 32, 20
UPPER = 0.99
STEP = 1000  # entropies are counted in thousandths of a nat
FOLDS = 5  # one in so many trusted texts is left out of the counts
LEAST = 1e-6  # of what a context leaves to the lower order
SLICE = 4 << 20  # bytes of text whose pairs are counted together,
PIECE = 1 << 20  # and that are cut into words at a time
SHARE, HOT_SHARE = 2.0**-17, 2.0**-19  # of all words; of all trusted pairs
SHARD_BYTES, SHARD_ROWS = 1 << 24, 1 << 19  # of text and of weights
SHIFT = np.uint64(16)  # names of words have 48 bits
RARE_NAME = np.uint64(1 << 47)  # marks names of rare words, those of pairs are below
#: Bits of the filter that keeps untrusted text out of the exchange, 1 MB at every size.
FILTER_BITS = 1 << 23


class Vocabulary(NamedTuple):
    """Sorted hashes of the frequent words; behind them come the symbols RARE, START and END."""

    names: np.ndarray
    total_bytes: int

    @property
    def size(self) -> int:
        return len(self.names) + 3


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, int, Iterator[tuple[int, int, list[bytes]]]]]:
    """(from, to, its pieces of about ``PIECE`` bytes) of every slice of about ``most`` bytes: what a task holds per byte
    of text is held for one piece, and only what is counted or asked for a slice."""
    for a, b, _ in words.slices(batch, "text", most):
        yield a, b, words.slices(batch.slice(a, b - a), "text", min(most, PIECE))


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The words of at least ``SHARE`` of all words, counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, cut in pieces(batch, SLICE):
                size, own = 0, []
                for _, _, texts in cut:
                    size += sum(map(len, texts))
                    own.append(words.Texts(texts, lower=True).hash() >> SHIFT)
                own, n = np.unique(np.concatenate(own), return_counts=True)
                often = n >= n.sum() * SHARE / 2  # a word of the whole share keeps half of its count at least
                yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *own[often].astype(np.int64).tolist()]), pa.array([int(n.sum()), size, *n[often].tolist()], pa.int64())], names=["name", "n"])

    seen = store.cut(docs.select("text").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")), "frequent")
    whole = dict(map(tuple, seen.filter("name < 0").collect()))
    # Shares add up to 1, so these are at most 2 / SHARE rows.
    names = [r["name"] for r in seen.filter("name >= 0").filter(F.col("n") >= whole.get(-1, 0) * SHARE / 2).select("name").collect()]
    return Vocabulary(np.sort(np.array(names, np.uint64)), whole.get(-2, 0))


def places(texts: list[bytes], vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text) of every place, and (name, text) of every rare word: each text that has words is led by START and closed by END."""
    t = words.Texts(texts, lower=True)
    if not len(t.starts):
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    rare, start, end = len(vocab), len(vocab) + 1, len(vocab) + 2
    h = t.hash() >> SHIFT
    at = np.minimum(np.searchsorted(vocab, h), max(0, len(vocab) - 1))
    known = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
    own = np.flatnonzero(t.n_words)
    n = t.n_words[own] + 1
    last = np.cumsum(n) - 1
    word, context = np.full(int(n.sum()), end), np.full(int(n.sum()), start)
    inside = np.ones(len(word), bool)
    inside[last] = False
    word[inside] = np.where(known, at, rare)
    behind = np.ones(len(word), bool)
    behind[last - n + 1] = False
    context[behind] = word[inside]
    return context, word, np.repeat(own, n), RARE_NAME | h[~known] >> np.uint64(1), t.doc[~known]


def trusted(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).filter("_q = 1").select("doc_id")


def held(key: Column) -> Column:
    """Trusted text that only sets the thresholds; all copies of a text are on one side."""
    return F.pmod(key, F.lit(FOLDS)) == 0


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose id is not in ``ids``: a bit map of fixed size, which an exact join follows."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    maps = ids.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    byte = lambda: F.conv(F.hex(F.substring("bits", F.expr("cast(bitmap_bit_position(_bit) div 8 as int) + 1"), 1)), 16, 10).cast("int")
    d = docs.withColumn("_bit", bit).withColumn("bucket", F.bitmap_bucket_number("_bit")).join(F.broadcast(maps), "bucket")
    return d.filter(byte().bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_bit) % 8 as int))")) != 0).drop("_bit", "bucket", "bits")


def counts(docs: DataFrame, labels: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Name and count of every pair (context * size + word) and rare word of trusted text that isn't held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, cut in pieces(batch, SLICE):
                kinds = [[], []]
                for _, _, texts in cut:
                    context, word, _, rare, _ = places(texts, vocab.names)
                    kinds[0].append(context * vocab.size + word)
                    kinds[1].append(rare.astype(np.int64))
                for names in kinds:
                    own, n = np.unique(np.concatenate(names), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["name", "n"])

    good = trusted(labels)
    own = docs.filter("text is not null").filter(~held(F.xxhash64("text"))).select("doc_id", "text")
    # An inner join: a semi-join would be pushed below the filter.
    own = likely(own, good).join(good, "doc_id").select("text")
    return own.mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the counts of counts 1 to 4; index 0 is unused."""
    n = [0, *n]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    return np.array([0.0, *[min(float(k), max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)]])


def _of_counts() -> list[Column]:
    return [F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]


def freed(table: DataFrame) -> DataFrame:
    """``table``, which is written; shuffle files that nothing refers to any more are let go."""
    gc.collect()
    table.sparkSession.sparkContext._jvm.System.gc()
    return table


class Model(NamedTuple):
    vocab: Vocabulary
    left: np.ndarray  # log of what each context leaves to the lower order
    lower: np.ndarray  # log probability of each symbol there
    hot: np.ndarray  # sorted names of the pairs of a visible share,
    hot_weight: np.ndarray  # what each of them pays to its place's cost
    table: DataFrame  # name, weight of the other pairs and of rare words
    unseen: float  # cost of a rare word within its class, if it was never counted

    @property
    def unknown(self) -> float:
        """Cost of an unknown word."""
        return self.unseen - float(self.lower[len(self.vocab.names)])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The score of a text is linear: each place pays -log left(context) - log p(word); a pair that was counted pays the
    difference to its own -log p, a rare word its cost within the class. So no part of a text needs another part's numbers.
    """
    vocab = vocabulary(docs)
    size = vocab.size
    seen = freed(store.cut(counts(docs, labels, vocab), "counts"))
    if seen.isEmpty():
        return None
    rare = F.col("name") >= int(RARE_NAME)
    pairs, single = seen.filter(~rare), seen.filter(rare)
    kinds = [F.count(F.when(F.col("n") >= 3 if k == 3 else F.col("n") == k, 1)).alias(f"t{k}") for k in (1, 2, 3)]
    # Tables of at most one row per symbol.
    contexts = pairs.groupBy(F.expr(f"name div {size}").alias("c")).agg(F.sum("n").alias("all"), *kinds).collect()
    neighbours = pairs.groupBy(F.expr(f"name % {size}").alias("w")).agg(F.count("*").alias("n")).collect()
    d = discounts(list(pairs.agg(*_of_counts()).first()))
    every, left = np.ones(size), np.ones(size)
    for r in contexts:
        every[r["c"]] = r["all"]
        left[r["c"]] = max(LEAST, (d[1] * r["t1"] + d[2] * r["t2"] + d[3] * r["t3"]) / r["all"])
    types = np.zeros(size)
    for r in neighbours:
        types[r["w"]] = r["n"]
    d1 = discounts([int((types == k).sum()) for k in (1, 2, 3, 4)])
    taken = d1[np.minimum(types, 3).astype(int)]
    lower = (types - taken + taken.sum() / size) / types.sum()
    lower = np.log(np.maximum(lower, LEAST / size))
    left_log = np.log(left)
    row = single.agg(F.sum("n").alias("all"), F.count("*").alias("types"), *kinds, *_of_counts()).first()
    dr = discounts([row[f"n{k}"] for k in (1, 2, 3, 4)])
    spare = max(LEAST, (dr[1] * row["t1"] + dr[2] * row["t2"] + dr[3] * row["t3"]) / row["all"]) / (row["types"] + 1) if row["all"] else 0.5

    def weights(name: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.empty(len(name))
        alone = name >= np.int64(RARE_NAME)
        k = np.minimum(n, 3)
        out[alone] = np.log(spare) - np.log((n - dr[k])[alone] / (row["all"] or 1) + spare)
        c, w = name[~alone] // size, name[~alone] % size
        backed = left_log[c] + lower[w]
        out[~alone] = backed - np.log((n - d[k])[~alone] / every[c] + np.exp(backed))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, n = (batch.column(k).to_numpy() for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights(name, n).astype(np.float32))], names=["name", "weight"])

    limit = sum(r["all"] for r in contexts) * HOT_SHARE
    hot = pairs.filter(F.col("n") >= limit).collect()  # at most 1 / HOT_SHARE rows
    names = np.array([r["name"] for r in hot], np.int64)
    order = np.argsort(names)
    names, n = names[order], np.array([r["n"] for r in hot], np.int64)[order]
    table = freed(store.cut(seen.filter(rare | (F.col("n") < limit)).mapInArrow(run, "name long, weight float"), "weights"))
    return Model(vocab, left_log, lower, names, weights(names, n), table, -float(np.log(spare)))


def per_text(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every name of every text once, with the number of its places there."""
    order = np.lexsort((doc, name))
    name, doc = name[order], doc[order]
    new = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))) if len(name) else np.zeros(0, np.int64)
    return name[new], doc[new].astype(np.int32), np.diff(np.append(new, len(name))).astype(np.int32)


def planes(a: np.ndarray, width: int) -> bytes:
    """Numbers byte by byte: all first bytes, all second bytes and so on, which compress well when sorted."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def sums(docs: DataFrame, model: Model) -> DataFrame:
    """One row per distinct text that has words: its key, ``n_words`` (with the end) and ``nats``.

    The rare words and other than hot pairs of a slice of texts are counted per text and go to the shard of their
    name, where the weights lie first; a task holds the weights of one shard and the names of one slice.
    """
    shards = 1 + max(model.vocab.total_bytes // SHARD_BYTES, model.table.count() // SHARD_ROWS)
    vocab, size = model.vocab.names, model.vocab.size
    sent = docs.sparkSession.sparkContext.broadcast((vocab, model.left, model.lower, model.hot, model.hot_weight))
    unseen = model.unseen
    spread = lambda name: (words.mix(name) % np.uint64(shards)).astype(np.int32)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, left, lower, hot, hot_weight = sent.value
        for batch in batches:
            for a, b, cut in pieces(batch, SLICE):
                n, nats, asked = np.zeros(b - a, np.int64), np.zeros(b - a), [(np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * 2)]
                for x, y, texts in cut:
                    context, word, doc, rare, rare_doc = places(texts, vocab)
                    if not len(word):
                        continue
                    pair = context * size + word
                    at = np.minimum(np.searchsorted(hot, pair), max(0, len(hot) - 1))
                    near = hot[at] == pair if len(hot) else np.zeros(len(pair), bool)
                    cost = -left[context] - lower[word]
                    if len(hot):
                        cost = cost + np.where(near, hot_weight[at], 0.0)
                    n[x:y] = np.bincount(doc, minlength=y - x)
                    nats[x:y] = np.bincount(doc, cost, y - x) + np.bincount(rare_doc, minlength=y - x) * unseen
                    asked.append(per_text(np.concatenate([pair[~near].astype(np.uint64), rare]), x + np.concatenate([doc[~near], rare_doc])))
                own = np.flatnonzero(n)
                if not len(own):
                    continue
                keys = batch.column(0).slice(a, b - a).to_numpy()
                # Slices of the same texts have one name; their sums and copies add up alike.
                part = int(words.mix(np.array([np.bitwise_xor.reduce(words.mix(keys.view(np.uint64) + np.arange(len(keys), dtype=np.uint64)))]))[0] >> np.uint64(1))
                rows: dict[str, list] = {"shard": [part % shards], "kind": [2], "name": [part], "weight": [None], "names": [nats[own].tobytes()], "runs": [n[own].tobytes()], "docs": [own.tobytes()], "times": [keys[own].tobytes()]}
                name, doc, times = (np.concatenate(c) for c in zip(*asked, strict=True))
                to = spread(name)
                order = np.lexsort((doc, name, to))
                name, doc, times, to = name[order], doc[order], times[order], to[order]
                cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
                for x, y in zip(cuts, [*cuts[1:], len(name)], strict=False):
                    single, run = np.unique(name[x:y], return_counts=True)
                    for c, v in zip(rows, (int(to[x]), 1, part, None, planes(single, 6), planes(run, 4), planes(doc[x:y], 4), planes(times[x:y], 4)), strict=True):
                        rows[c].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=layout)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, names, weights = None, [], None, None
        for batch in batches:
            which, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, (np.diff(which) != 0) | (np.diff(kind) != 0)))
            for x, y in zip(edges, [*edges[1:], len(which)], strict=True):
                if which[x] != shard:
                    shard, parts, names = which[x], [], None
                if kind[x] == 0:
                    parts.append((batch.column(2).slice(x, y - x).to_numpy(), batch.column(3).slice(x, y - x).to_numpy()))
                    continue
                for i in range(x, y):
                    if kind[i] == 2:
                        yield batch.slice(i, 1)
                        continue
                    own, run, at, n = (batch.column(k)[i].as_py() for k in range(4, 8))
                    if names is None:
                        names, weights = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0))
                        order = np.argsort(names)
                        names, weights, parts = np.append(names[order].astype(np.uint64), np.uint64(1 << 60)), np.append(weights[order], 0.0), []
                    own, run, at, n = unplanes(own, 6), unplanes(run, 4).astype(np.int64), unplanes(at, 4).astype(np.int64), unplanes(n, 4).astype(float)
                    place = np.searchsorted(names, own)
                    w = np.where(names[place] == own, weights[place], 0.0)
                    nats = np.bincount(at, np.repeat(w, run) * n)
                    some = np.flatnonzero(nats)
                    yield pa.RecordBatch.from_pydict({"shard": [shard], "kind": [1], "name": batch.column(2).slice(i, 1), "weight": [None], "names": [nats[some].astype(np.float32).tobytes()], "runs": [None], "docs": [planes(some, 4)], "times": [None]}, schema=layout)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the parts of each slice; its own row, with the keys, comes first."""
        name, base, keys, n, copies, at = None, None, None, None, 0, None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(base[at]), pa.array(n), pa.array(np.full(len(keys), copies))], names=["key", "nats", "n", "copies"])

        for batch in batches:
            for i in range(batch.num_rows):
                part, kind = batch.column(2)[i].as_py(), batch.column(1)[i].as_py()
                if part != name and name is not None:
                    yield flush()
                nats, runs, docs, times = (batch.column(k)[i].as_py() for k in range(4, 8))
                if part != name:
                    name, copies = part, 0
                    keys, at, n = np.frombuffer(times, np.int64), np.frombuffer(docs, np.int64), np.zeros(len(times) // 8, np.int64)
                    base = np.zeros(int(at.max(initial=-1)) + 1)
                if kind == 2:
                    base[at] += np.frombuffer(nats)
                    n = n + np.frombuffer(runs, np.int64)
                    copies += 1
                else:
                    base[unplanes(docs, 4).astype(np.int64)] += np.frombuffer(nats, np.float32)
        if name is not None:
            yield flush()

    layout = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("name", pa.int64()), ("weight", pa.float32()), *[(c, pa.binary()) for c in ("names", "runs", "docs", "times")]])
    ddl = "shard int, kind int, name long, weight float, names binary, runs binary, docs binary, times binary"

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.column(0).to_numpy()
            none = pa.nulls(len(name), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(spread(name.astype(np.uint64))), pa.array(np.zeros(len(name), np.int32)), batch.column(0), batch.column(1), *[none] * 4], schema=layout)

    asked = docs.filter("text is not null").select(F.xxhash64("text").alias("key"), "text").mapInArrow(cast, ddl)
    met = model.table.mapInArrow(address, ddl).unionAll(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    slices = met.mapInArrow(meet, ddl).repartition("name").sortWithinPartitions("name", F.desc("kind"))
    part = slices.mapInArrow(gather, "key long, nats double, n long, copies long")
    # The copies of a text add up alike in all three.
    total = part.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("nats", "n", "copies")])
    return store.cut(total.select("key", (F.col("nats") / F.col("copies")).alias("nats"), F.expr("n div copies").alias("n_words")), "sums")


def _quantile(values: DataFrame, keys: list[str], q: float, name: str) -> DataFrame:
    """A quantile of ``v`` per key, exact from the counts of its values."""
    n = values.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(1))
    n = n.withColumns({"upto": F.sum("n").over(w.orderBy("v")), "all": F.sum("n").over(w)})
    return n.groupBy(*keys).agg((F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("v"))) / STEP).alias(name))


def drawn(median: Column) -> Column:
    """Nats per word, drawn to the median."""
    return (F.coalesce("nats", F.lit(0.0)) + PRIOR_WORDS * median) / (F.coalesce("n_words", F.lit(0)) + PRIOR_WORDS)


def thresholds(docs: DataFrame, labels: DataFrame, scored: DataFrame, unknown: float) -> tuple[DataFrame, tuple]:
    """Per language: median and threshold; and those of a language without rows. From held-out rows alone.

    A language's values weigh as its rows, what they are drawn to as ``PRIOR_ROWS``: the median to that of all
    trusted rows, the threshold to the weight of unknown words. The threshold of all rows would be too low for
    a language that the counts hardly know: most words of its clean texts are unknown.
    """
    mine = docs.select("doc_id", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("none")).alias("_lang"), F.xxhash64("text").alias("key")).filter(held(F.col("key")))
    own = mine.join(trusted(labels), "doc_id", "left_semi").join(scored, "key")
    own = store.cut(own.select("_lang", "n_words", "nats", F.round(F.col("nats") / F.col("n_words") * STEP).cast("long").alias("v")), "entropies")
    middle = _quantile(own, [], 0.5, "median").first()["median"]
    few = lambda c, every: (F.col("rows") * F.col(c) + PRIOR_ROWS * F.lit(every).cast("double")) / (F.col("rows") + PRIOR_ROWS)
    medians = _quantile(own, ["_lang"], 0.5, "median").join(own.groupBy("_lang").agg(F.count("*").alias("rows")), "_lang")
    medians = store.cut(medians.withColumn("median", few("median", middle)), "medians")
    # Rounded up, so that the text at the quantile is not above it.
    v = lambda median: F.ceil(drawn(median) * STEP).alias("v")
    per = _quantile(own.join(medians, "_lang").select("_lang", v(F.col("median"))), ["_lang"], UPPER, "upper")
    return store.cut(medians.join(per, "_lang").select("_lang", "median", few("upper", unknown).alias("upper")), "quantiles"), (middle, unknown if middle is not None else None)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with n_words, perplexity (per word), threshold and kept."""
    model = train(docs, labels)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("*", F.lit(None).cast("long").alias("n_words"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    scored = sums(docs, model)
    per, overall = thresholds(docs, labels, scored, model.unknown)
    named = docs.withColumns({"_key": F.xxhash64("text"), "_lang": F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("none"))})
    # One row per language that has trusted text; of more than a few the join decides by measured size.
    d = named.join(scored.withColumnRenamed("key", "_key"), "_key", "left").join(per, "_lang", "left")
    n = F.coalesce("n_words", F.lit(0))
    median, limit = F.coalesce("median", F.lit(overall[0])), F.coalesce("upper", F.lit(overall[1]))
    mean = drawn(median)
    return d.select(*docs.columns, n.cast("long").alias("n_words"), F.exp(mean).alias("perplexity"), F.exp(limit).alias("threshold"), F.coalesce(mean <= limit, F.lit(True)).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    own, names = store.hidden(docs, "doc_id", "lang", "text")
    return judged(own, labels).filter("kept").select(*names)


@query("op7_kneser_ney")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judged(docs, store.read(spark, sf_dir, "labels")).drop("text")
