"""Substring de-duplication: words under a window of ``WINDOW`` words that stands anywhere else go.

The corpus is indexed by FM-indexes, one per shard. A window's shard follows from its anchor, the
``GRAM``-word sequence of smallest hash inside it: equal windows have equal anchors, so both are in
one index, and each document's stretches are streamed to one index each, not to all. A stretch
("piece") is a run of windows with one anchor. Anchors that stand at one place only are dropped by a
partial count before any text is moved, and equal pieces are indexed once, weighted by their number.
Backward search over the wavelet matrix then gives the runs of windows that begin at two places or more.

An anchor whose different pieces exceed ``ANCHOR_WORDS`` (a passage in very many contexts) is dealt
out anew: its pieces are cut into single windows, those that are counted once are dropped, and each
remaining window's shard is its own hash.

Hashes of 64 bits only route and count equal pieces; what an index compares are the words themselves.

Defined results: a null or empty text has no words; a text below ``WINDOW`` words loses none; repeated
rows are places of their own, so all their windows go; equal ids and null ids are told apart by their
text; texts of any length are read whole; an empty table gives no rows; other columns pass through
under their names, whatever these are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm import store, words
from cueflow.llm.fm_index import FMIndex
from cueflow.llm.registry import query

WINDOW = 35
GRAM = 6
#: Windows of one piece; longer runs are cut.
PIECE = 32
#: Bytes of text in one index, and words of different pieces that one anchor may bring into one.
INDEX_BYTES = 8 << 20
ANCHOR_WORDS = 1 << 21

_KEY = ["_k", "_k2"]
FACT = "m long, c long, _k long, _k2 int, start int, nw int, n int"


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """``_k`` and ``_k2``: the document's id (its text's hash if that is null) and a 32-bit hash of its text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumns({"_k": F.coalesce(F.col(f"`{id_column}`").cast("long"), F.xxhash64(t)), "_k2": F.hash(t)})


def _sliding_min(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value of every ``width`` neighbours and its leftmost place."""
    n = len(h) - width + 1
    v, at, span = h, np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        left = v[:-step] <= v[step:]
        v, at = np.where(left, v[:-step], v[step:]), np.where(left, at[:-step], at[step:])
        span += step
    return v[:n], at[:n]


def cut_pieces(texts: words.Texts, window: int = WINDOW, gram: int = GRAM, most: int = PIECE) -> dict[str, np.ndarray]:
    """anchor ``m``, content hash ``c``, ``doc``, ``start`` word, number of windows ``nw`` and of anchor places ``n`` of every piece.

    Where two windows of one piece repeat each other, their anchors stand at different places of it.
    """
    h, doc = texts.hash(), texts.doc
    n = len(h)
    whole, at = words.windows(h, doc, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return {x: none for x in ("m", "c", "doc", "start", "nw", "n")}
    grams, place = words.windows(h, doc, gram)
    key = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    key[place] = grams
    low, lowest = _sliding_min(key, window - gram + 1)
    low, lowest = low[at], lowest[at]
    new = np.append(True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1))
    run = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % most == 0
    first = np.flatnonzero(new)
    nw = np.diff(np.append(first, len(at)))
    moved = np.append(False, lowest[1:] != lowest[:-1]) & ~new
    # Two windows cover a piece, as it has no more windows than a window has words.
    content = words.mix(whole[first] * words._C1 + whole[first + nw - 1] * words._C2 + nw.astype(np.uint64))
    start = at[first]
    return {"m": low[first].view(np.int64), "c": content.view(np.int64), "doc": doc[start], "start": start - texts.word_at[doc[start]], "nw": nw, "n": 1 + np.add.reduceat(moved, first, dtype=np.int64)}


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k, k2 = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in _KEY)
        for a, _, texts in words.slices(batch, "text", 4 << 20):
            p = cut_pieces(words.Texts(texts))
            d = p["doc"] + a
            yield pa.RecordBatch.from_arrays(
                [pa.array(p["m"]), pa.array(p["c"]), pa.array(k[d]), pa.array(k2[d]), *(pa.array(p[x].astype(np.int32)) for x in ("start", "nw", "n"))],
                names=["m", "c", *_KEY, "start", "nw", "n"],
            )


BODY = "m long, c long, n long, hot boolean, body string"


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the pieces that are asked of each document."""
    for batch in batches:
        asked = batch.column(batch.schema.get_field_index("asked"))
        for a, b, texts in words.slices(batch, "text", 4 << 20):
            t = words.Texts(texts)
            part = asked.slice(a, b - a)
            d = np.repeat(np.arange(b - a), pc.list_value_length(part).to_numpy())
            x = part.flatten()
            get = lambda name: x.field(name).to_numpy(zero_copy_only=False)  # noqa: B023,E731
            begin = t.word_at[d] + get("start")
            end = begin + get("nw") + WINDOW - 2
            at, to = t.starts[begin], t.ends[end]
            raw = t.raw.tobytes()
            body = pa.array([raw[i:j] for i, j in zip(at.tolist(), to.tolist(), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([x.field("m"), x.field("c"), x.field("n"), x.field("hot"), body], names=["m", "c", "n", "hot", "body"])


def _at_changes(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` bytes of sorted rows, cut where ``key`` changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            t = pa.Table.from_batches(held)
            k = t[key].to_numpy()
            other = np.flatnonzero(k != k[-1])
            if len(other):
                yield t.slice(0, int(other[-1]) + 1)
                t = t.slice(int(other[-1]) + 1)
            held = t.to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


RUN = "m long, c long, first int, last int"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds an index of each lot of pieces and streams the pieces through it."""
    for t in _at_changes(batches, "m", INDEX_BYTES):
        m, c, n = (t[x].to_numpy() for x in ("m", "c", "n"))
        # Repeated rows bring their pieces once each; the weight holds all of them.
        one = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (c[1:] != c[:-1])))
        m, c, n = m[one], c[one], n[one]
        parts = pc.ascii_split_whitespace(t["body"].take(pa.array(one)).combine_chunks())
        coded = pc.dictionary_encode(parts.flatten()).indices.to_numpy().astype(np.int64) + 1
        piece, first, last = FMIndex(coded, pc.list_value_length(parts).to_numpy().astype(np.int64), n).repeated(WINDOW)
        yield pa.RecordBatch.from_arrays([pa.array(m[piece]), pa.array(c[piece]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["m", "c", "first", "last"])


SINGLE = "w long, m long, c long, at int, n long"


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a piece by its own hash."""
    for batch in batches:
        m, c, n = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("m", "c", "n"))
        for a, _, texts in words.slices(batch, "body", 1 << 20):
            t = words.Texts(texts)
            w, at = words.windows(t.hash(), t.doc, WINDOW)
            d = t.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(m[d + a]), pa.array(c[d + a]), pa.array((at - t.word_at[d]).astype(np.int32)), pa.array(n[d + a])], names=["w", "m", "c", "at", "n"])


def _hot_runs(hot: DataFrame) -> DataFrame:
    """Runs of the pieces of anchors that are too large for one index: shards by window."""
    single = hot.mapInArrow(_windows_of, SINGLE)
    twice = single.groupBy("w").agg(F.sum("n").alias("n"), F.min(F.struct("m", "c", "at")).alias("p")).filter("n >= 2")
    body = F.array_join(F.slice(F.split("body", "[ \t-\r]+"), F.col("at") + 1, F.lit(WINDOW)), " ")
    asked = twice.select("w", "n", "p.*").join(hot.drop("n"), ["m", "c"]).select(F.col("w").alias("m"), F.col("w").alias("c"), "n", body.alias("body"))
    found = asked.repartition("m").sortWithinPartitions("m", "c").mapInArrow(_search, RUN)
    return single.join(found.select(F.col("m").alias("w")), "w", "left_semi").select("m", "c", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``_k``, ``_k2`` and ``spans``, the [begin, end) word ranges that go, for documents ``_k``, ``_k2``, ``text``."""
    facts = docs.mapInArrow(_facts, FACT)
    anchors = facts.groupBy("m").agg(F.sum("n").alias("all")).filter("all >= 2")
    facts = store.cut(facts.join(anchors, "m", "left_semi"), "anchored")
    pieces = store.cut(facts.groupBy("m", "c").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "start", "nw")).alias("p")).select("m", "c", "n", "p.*"), "pieces")
    large = pieces.groupBy("m").agg(F.sum(F.col("nw") + (WINDOW - 1)).alias("size")).filter(f"size > {ANCHOR_WORDS}").select("m", F.lit(True).alias("hot"))
    asked = pieces.join(large, "m", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    asked = asked.groupBy(*_KEY).agg(F.collect_list(F.struct("m", "c", "n", "hot", "start", "nw")).alias("asked"))
    bodies = store.cut(docs.join(asked, _KEY).select("text", "asked").mapInArrow(_bodies, BODY), "bodies")
    runs = bodies.filter("not hot").drop("hot").repartition("m").sortWithinPartitions("m", "c").mapInArrow(_search, RUN)
    runs = runs.unionByName(_hot_runs(bodies.filter("hot").dropDuplicates(["m", "c"]).drop("hot")))
    runs = store.cut(runs, "runs")
    at = F.struct((F.col("start") + F.col("first")).alias("b"), (F.col("start") + F.col("last") + WINDOW).alias("e"))
    return facts.join(runs, ["m", "c"]).groupBy(*_KEY).agg(F.collect_set(at).alias("spans"))


def _without(text: str, spans_at: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index(spans_at))
            rest = pa.Table.from_batches([batch]).select(keep)
            for a, b, texts in words.slices(batch, text, 4 << 20):
                t = words.Texts(texts)
                part = spans.slice(a, b - a)
                d = np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(part), 0).to_numpy())
                x = part.flatten()
                step = np.zeros(len(t.starts) + 1, np.int64)
                np.add.at(step, t.word_at[d] + x.field("b").to_numpy(zero_copy_only=False), 1)
                np.add.at(step, t.word_at[d] + x.field("e").to_numpy(zero_copy_only=False), -1)
                stays = np.cumsum(step[:-1]) == 0
                gone = np.bincount(t.doc[~stays], minlength=t.n)
                # Kept words with one space behind each, cut out of the buffer in one step.
                at = np.zeros(len(t.raw) + 1, np.int32)
                at[t.starts[stays]] += 1
                at[t.ends[stays]] -= 1
                inside = np.cumsum(at[:-1]) > 0
                buf = t.raw.copy()
                buf[t.ends] = 0x20
                inside[t.ends[stays]] = True
                size = np.add.reduceat(inside, t.first, dtype=np.int64) if t.n else np.zeros(0, np.int64)
                data, to = buf[inside].tobytes(), np.cumsum(size)
                kept = [data[max(e - n, 0) : max(e - 1, 0)] if n else b"" for e, n in zip(to.tolist(), size.tolist(), strict=True)]
                out = rest.slice(a, b - a).combine_chunks()
                for name, col in (("n_words", pa.array(t.n_words.astype(np.int64))), ("n_removed", pa.array(gone.astype(np.int64))), ("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))):
                    out = out.append_column(name, col)
                yield from out.to_batches()

    return run


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``n_removed``, ``kept_text`` (a column that has one of these names already is replaced)."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    d, back = store.hidden(docs, id_column, text)
    d = _keyed(d, id_column, text)
    # Only the key and the text travel to the indexes.
    spans = repeated_spans(d.select(*_KEY, F.col(f"`{text}`").alias("text")))
    own = [c for c in d.columns if c not in _KEY]
    schema = d.drop(*_KEY).select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema
    out = d.join(spans, _KEY, "left").drop(*_KEY).mapInArrow(_without(text, "spans", own), schema)
    return out.select(*back, "n_words", "n_removed", "kept_text")


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS s
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) >= 2),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (s)),
gone AS (SELECT r, list(p) AS ps FROM hit GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""


@query("op11_substring_dedup", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = without_repeats(store.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
