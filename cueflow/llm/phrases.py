"""Phrase collocations: only the longest windows are counted; ROLLUP sums them up to all shorter phrases.

Every word begins one window: itself and the next three words of its piece (lead columns), padded with
the empty string behind the piece's end. The windows of a language are counted once. A phrase of n
words is the prefix of length n of the windows that begin with it, so ROLLUP (lang, w0, w1, w2, w3)
gives the count of every phrase and, at its top, the number of words.

Tasks take windows from Arrow batches and send each different one of a slice once, in compressed blocks
per shard of the first two words. A shard pads windows behind the last prefix that reaches ``LEAST``:
what it cuts off is no phrase and no part of one. Word pairs that hold a visible share of
all windows (counted over all texts first; by their share there are at most ``1 / HOT_SHARE``) are dealt
to all shards by the whole window and stay unpadded, so no shard holds a hot pair.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count as
often as they stand; texts of any length are read whole; ties are settled by phrase; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.llm import store, words
from cueflow.llm.registry import query

SIZE = 4
LEAST = 30
TOP = 2000
#: 100 * f(longer) >= ABSORBED * a drops a phrase.
ABSORBED = 80
HOT_SHARE = 1 / 1024
SHARD_WINDOWS = 1_500_000
SLICE = 8 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False

W = [f"w{i}" for i in range(SIZE)]


class Windows:
    """The padded windows of some texts of one language, each different one once: ``code[i]`` points into
    ``words`` (0 is the padding), ``count`` says how often the window stands."""

    def __init__(self, texts: list[bytes], size: int = SIZE):
        t = words.Texts(texts, _WORD, lower=True)
        length = t.ends - t.starts
        offsets = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(t.buf[_WORD[t.buf]])])
        coded = pc.dictionary_encode(flat)
        self.words = coded.dictionary
        own = coded.indices.to_numpy().astype(np.int64) + 1
        n, self.total = len(own), len(own)
        piece = np.cumsum(_BREAK[t.buf])[t.starts]
        columns = [own]
        for k in range(1, size):
            lead = np.zeros(n, np.int64)
            if n > k:
                lead[:-k] = np.where(piece[k:] == piece[:-k], own[k:], 0)
            columns.append(lead)
        first, self.count, self.pair = distinct(columns)
        self.code = [c[first] for c in columns]
        self.pair_count = np.bincount(self.pair, self.count, minlength=int(self.pair.max(initial=-1)) + 1).astype(np.int64)


def distinct(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row and weight of every different row, and the number of its first two columns. Exact: columns that fit into
    64 bits are sorted as one number, others are refined column by column."""
    bits = int(max(c.max(initial=0) for c in columns)).bit_length()
    pair, packed = None, bits * len(columns) <= 64
    if packed:
        key = columns[0].astype(np.uint64)
        for c in columns[1:]:
            key = key << np.uint64(bits) | c.astype(np.uint64)
        key, ids = np.unique(key, return_inverse=True)
        head = key >> np.uint64(bits * max(len(columns) - 2, 0))
        pair = np.cumsum(np.append(np.zeros(min(len(key), 1), bool), head[1:] != head[:-1]))
    else:
        ids = columns[0] if len(columns) > 1 else np.unique(columns[0], return_inverse=True)[1]
        for c in columns[1:]:
            _, ids = np.unique((ids << 32) | c, return_inverse=True)
            pair = ids if pair is None else pair
    first = np.empty(int(ids.max(initial=-1)) + 1, np.int64)
    first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)  # of equal rows the first is written last
    count = np.bincount(ids, weights, minlength=len(first)).astype(np.int64)
    return first, count, pair if packed else (ids if pair is None else pair)[first]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    langs = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
    names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    for a, b, texts in words.slices(batch, "text", SLICE):
        part = code[a:b]
        for k in np.unique(part):
            yield names[k], [texts[i] for i in np.flatnonzero(part == k)]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words of each slice (``w0`` null) and its pairs of at least half a hot share."""
    for batch in batches:
        for lang, texts in _by_lang(batch):
            w = Windows(texts, 2)
            hot = np.flatnonzero((w.pair_count >= w.total * HOT_SHARE / 2) & (w.code[1] > 0))
            names = [None, *w.words.cast(pa.string()).take(pa.array(w.code[0][hot] - 1)).to_pylist()]
            nexts = [None, *w.words.cast(pa.string()).take(pa.array(w.code[1][hot] - 1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(nexts, pa.string()), pa.array([w.total, *w.pair_count[hot].tolist()], pa.int64())], names=["lang", "w0", "w1", "n"])


def _hash(values: pa.Array) -> np.ndarray:
    """A hash per word, and 0 for the padding in front of them."""
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8) if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return np.append(np.zeros(1, np.uint64), words.hashes(data, offsets[:-1], offsets[1:]))


def _hot_codes(w_words: pa.Array, hot: list[tuple[str, str]]) -> set[tuple[int, int]]:
    at = {v: i + 1 for v, i in ((x, w_words.index(pa.scalar(x.encode(), pa.large_binary())).as_py()) for x in {y for p in hot for y in p}) if i >= 0}
    return {(at[a], at[b]) for a, b in hot if a in at and b in at}


def _is_hot(code: list[np.ndarray], hot: set[tuple[int, int]]) -> np.ndarray:
    return np.isin((code[0] << 32) | code[1], np.array([(a << 32) | b for a, b in hot], np.int64))


def pack(values: pa.Array, code: list[np.ndarray], count: np.ndarray) -> bytes:
    """Windows with the words they use, columns one after the other, compressed."""
    used, codes = np.unique(np.concatenate([np.zeros(1, np.int64), *code]), return_inverse=True)
    codes = codes[1:].astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
    text = b"\n".join(values.take(pa.array(used[1:] - 1)).to_pylist())
    head = np.array([len(count), len(code), codes.itemsize, len(text)], np.int64).tobytes()
    return zstandard.compress(head + codes.tobytes() + count.astype(np.int64).tobytes() + text, 1)


def unpack(data: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    raw = zstandard.decompress(data)
    n, k, width, size = np.frombuffer(raw, np.int64, 4)
    codes = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32, n * k, 32).astype(np.int64).reshape(k, n)
    count = np.frombuffer(raw, np.int64, n, 32 + n * k * width)
    return (raw[len(raw) - size :].split(b"\n") if size else []), list(codes), count


def _blocks(shards: int, parts: int, hot: dict[str, list[tuple[str, str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_lang(batch):
                w = Windows(texts)
                if not w.total:
                    continue
                h = _hash(w.words)
                key = words.hashes(np.frombuffer(lang.encode() + b" ", np.uint8), np.zeros(1, np.int64), np.array([len(lang.encode()) + 1]))[0] + h[w.code[0]] * words._C1 + h[w.code[1]] * words._C2
                if pairs := _hot_codes(w.words, hot.get(lang, [])):
                    spread = _is_hot(w.code, pairs)
                    key[spread] += h[w.code[2][spread]] * words._M + words.mix(h[w.code[3][spread]])
                shard = (words.mix(key) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                edge = np.append(np.flatnonzero(np.append(True, np.diff(shard[order]) > 0)), len(order))
                out = [(int(shard[order[a]]), pack(w.words, [c[order[a:b]] for c in w.code], w.count[order[a:b]])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([s % parts for s, _ in out], pa.int32()), pa.array([s for s, _ in out], pa.int32()), pa.array([lang] * len(out), pa.string()), pa.array([x for _, x in out], pa.binary())], names=["part", "shard", "lang", "block"])

    return run


def padded(code: list[np.ndarray], count: np.ndarray, keep: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The windows, each padded behind its last prefix that stands ``least`` times; those in ``keep`` stay whole."""
    out, ids, n = [], code[0], np.arange(len(count))
    for level in range(1, len(code)):
        _, ids = np.unique((ids << 32) | code[level][n], return_inverse=True)
        total = np.bincount(ids, count[n])
        stays = ((total[ids] >= least) & (code[level][n] > 0)) | keep[n]
        out.append((level, n[~stays]))
        n, ids = n[stays], ids[stays]
    out.append((len(code), n))
    rows = [[np.where(k < level, c[at], 0) for level, at in out] for k, c in enumerate(code)]
    columns, weight = [np.concatenate(x) for x in rows], np.concatenate([count[at] for _, at in out])
    first, total, _ = distinct(columns, weight)
    return [c[first] for c in columns], total


def _counts(hot: dict[str, list[tuple[str, str]]], least: int):
    def flush(lang: str, held: list[bytes]) -> pa.RecordBatch:
        parts = [unpack(x) for x in held]
        coded = pc.dictionary_encode(pa.array([w for p in parts for w in p[0]], pa.large_binary()))
        to = np.append(np.zeros(1, np.int64), coded.indices.to_numpy().astype(np.int64) + 1)
        at = np.cumsum([0, *(len(p[0]) for p in parts)])
        code = [np.concatenate([to[np.where(p[1][k] > 0, p[1][k] + at[i], 0)] for i, p in enumerate(parts)]) for k in range(SIZE)]
        count = np.concatenate([p[2] for p in parts])
        pairs = _hot_codes(coded.dictionary, hot.get(lang, []))
        keep = _is_hot(code, pairs) if pairs else np.zeros(len(count), bool)
        code, count = padded(code, count, keep, least)
        names = pa.concat_arrays([pa.array([""]), coded.dictionary.cast(pa.large_string()).cast(pa.string())])
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(count), pa.string()), *(names.take(pa.array(c)) for c in code), pa.array(count)], names=["lang", *W, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            d = batch.to_pydict()
            for k, x in zip(zip(d["lang"], d["shard"], strict=True), d["block"], strict=True):
                if held and k != key:
                    yield flush(key[0], held)
                    held = []
                key = k
                held.append(x)
        if held:
            yield flush(key[0], held)

    return run


def counted(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang``, ``p`` (words of a phrase; empty: all words), ``f`` for every phrase of ``SIZE`` words at most that stands ``least`` times."""
    spark = documents.sparkSession
    d = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    seen = store.cut(d.mapInArrow(_pairs, "lang string, w0 string, w1 string, n long").groupBy("lang", "w0", "w1").agg(F.sum("n").alias("n")), "pairs")
    total = seen.filter("w0 is null").agg(F.sum("n")).first()[0] or 0
    hot: dict[str, list[tuple[str, str]]] = {}
    # At most 2 / HOT_SHARE rows, as their shares add up to no more than 1.
    for r in seen.filter("w0 is not null").filter(F.col("n") >= total * HOT_SHARE / 2).collect():
        hot.setdefault(r["lang"], []).append((r["w0"], r["w1"]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = parts * max(1, -(-total // (parts * SHARD_WINDOWS)))
    blocks = d.mapInArrow(_blocks(shards, parts, hot), "part int, shard int, lang string, block binary")
    windows = blocks.repartitionById(parts, F.col("part")).sortWithinPartitions("lang", "shard").mapInArrow(_counts(hot, least), "lang string, w0 string, w1 string, w2 string, w3 string, n long")
    up = windows.rollup("lang", *W).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # Grouping ids 15, 7, 3, 1, 0 leave 0 to 4 words.
    words_left = F.size(F.array_compact(F.array(*W)))
    p = F.slice(F.array(*W), 1, words_left)
    full = (words_left == 0) | ((F.element_at(p, F.greatest(words_left, F.lit(1))) != "") & (F.col("f") >= least))
    return store.cut(up.filter(F.col("lang").isNotNull() & (F.col("g") < 2**SIZE)).filter(full).select("lang", p.alias("p"), "f"), "phrases")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """The first ``top`` phrases of every language with their weakest cut."""
    f = counted(documents, least)
    n = f.filter(F.size("p") == 0).select("lang", F.col("f").alias("n"))
    grams = f.filter(F.size("p") > 0)
    phrases = grams.filter(F.size("p") > 1).withColumnRenamed("f", "a")
    cuts = phrases.select("lang", "p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("lang", "p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("head"), F.slice("p", F.col("k") + 1, F.lit(SIZE)).alias("tail"))
    cuts = cuts.join(grams.select("lang", F.col("p").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(grams.select("lang", F.col("p").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(cast(a as decimal(28, 0)) * 2000000bd) div (cast(l as decimal(28, 0)) + cast(r as decimal(28, 0)))")
    weakest = cuts.groupBy("lang", "p", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w"))
    # Phrases inside each longer one, with the most frequent longer one of each.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("p") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.size("p") - s + 1), lambda i: F.slice("p", i, s))))
    longer = phrases.filter(F.size("p") > 2).select("lang", F.col("a").alias("longer"), F.explode(inner).alias("p")).groupBy("lang", "p").agg(F.max("longer").alias("longer"))
    left = weakest.join(longer, ["lang", "p"], "left").filter(~F.coalesce(F.col("longer").cast("decimal(28,0)") * 100 >= F.col("a").cast("decimal(28,0)") * absorbed, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("w.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("phrase", F.array_join("p", " ")).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "w.l", "w.r", "n", F.col("w.score").alias("score"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
grams AS (
  SELECT lang, p, count(*)::BIGINT AS f
  FROM (SELECT lang, w[i:i + s - 1] AS p FROM (SELECT lang, w, s, unnest(range(1, greatest(len(w) - s + 2, 1))) AS i FROM ws, (VALUES (1), (2), (3), (4)) t(s)))
  GROUP BY lang, p HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(p))) AS k FROM grams WHERE len(p) > 1) c
  JOIN grams l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN grams r ON r.lang = c.lang AND r.p = c.p[k + 1:]),
weak AS (SELECT lang, p, a, arg_min({'k': k, 'l': l, 'r': r, 'score': score}, (score, k)) AS w FROM cuts GROUP BY lang, p, a),
inner_ AS (
  SELECT lang, p[i:i + s - 1] AS p, max(f) AS longer
  FROM (SELECT *, unnest(range(1, len(p) - s + 2)) AS i FROM grams, (VALUES (2), (3)) t(s) WHERE len(p) > s) GROUP BY ALL),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, w,
         row_number() OVER (PARTITION BY lang ORDER BY w.score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM weak LEFT JOIN inner_ USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, w.l AS l, w.r AS r, n, w.score AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(store.read(spark, sf_dir, "documents").select("lang", "text"))
