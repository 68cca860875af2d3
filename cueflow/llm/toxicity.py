"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of learned word and stem lexicons, how near their hits stand
to words of the second person, capitals, punctuation and obfuscated words. Lexicons, trees and
calibration are fitted on labelled rows outside the held-out fifth. Each row's own features come
from lexicons of the other folds, and the calibration sees only predictions of trees that were
fitted without the row. Scoring is one pass over whole texts in Arrow batches.

Defined results: a null or empty text has zero features and gets the score of those; repeated rows
give repeated results; a null id is not held out; an empty table gives no rows; without labels
of both classes every score is the share of toxic rows (0 without any). Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm import store, words
from cueflow.llm.registry import query

#: Labelled rows that the fit may see: the bound on what reaches the driver.
SAMPLE_ROWS = 8_000
FOLDS, STEM_BYTES, NEAR = 4, 6, 5
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.15
SECOND_PERSON = "you your yours yourself thou ye u ur du dich dir dein deine ihr euch euer tu te toi ton tes vous votre vos tú ti usted ustedes vosotros vuestro".split()
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def second_person() -> np.ndarray:
    t = words.Texts([w.encode() for w in SECOND_PERSON], words.LETTER)
    return np.sort(t.hash())


def among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    at = np.searchsorted(table, h)
    return table[np.minimum(at, len(table) - 1)] == h


def weights_of(h: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    table, w = lexicon
    if not len(table):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, w[at], 0.0)


def learn_lexicon(sets: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that stand in more toxic texts than chance, with their log odds."""
    pos, neg = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    u, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
    toxic = [s for s, v in zip(sets, y, strict=True) if v]
    v, k = np.unique(np.concatenate(toxic), return_counts=True) if toxic else (u[:0], n[:0])
    a = np.zeros(len(u))
    a[np.searchsorted(u, v)] = k
    b = n - a
    # Discounted by one standard error, so that rare words need a clear case.
    w = np.log((a + 0.5) / (pos + 1)) - np.log((b + 0.5) / (neg + 1)) - np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    on = (a >= 3) & (w > 0.5)
    return u[on], w[on]


def features(t: words.Texts, h: np.ndarray, stem: np.ndarray, lexicons, person: np.ndarray) -> np.ndarray:
    """One row of dense numbers per text."""
    n = np.maximum(t.n_words, 1)
    per = lambda x: np.bincount(t.doc, x, t.n)
    cols = []
    you = among(h, person)
    at_you = np.flatnonzero(you)
    has = t.n_words > 0
    for key, lexicon in ((h, lexicons[0]), (stem, lexicons[1])):
        w = weights_of(key, lexicon)
        best = np.zeros(t.n)
        if has.any():
            best[has] = np.maximum.reduceat(w, t.word_at[has])
        hit = np.flatnonzero(w > 0)
        near = np.zeros(len(hit), bool)
        if len(at_you):
            for at in (np.searchsorted(at_you, hit) - 1, np.searchsorted(at_you, hit)):
                other = at_you[np.clip(at, 0, len(at_you) - 1)]
                near |= (np.abs(other - hit) <= NEAR) & (t.doc[other] == t.doc[hit])
        hits, strong = per(w > 0), per(w > 1.5)
        cols += [best, per(w) / n, hits / n, strong / n, np.log1p(strong), np.bincount(t.doc[hit], near, t.n) / np.maximum(hits, 1)]
    size = np.maximum(t.size, 1)
    begin = t.first
    count = lambda on: np.diff(np.concatenate([[0], np.cumsum(on)])[np.append(begin, len(t.raw))])
    upper = (t.raw >= 65) & (t.raw <= 90)
    up = np.concatenate([[0], np.cumsum(upper)])
    shout = (up[t.ends] - up[t.starts] == t.ends - t.starts) & (t.ends - t.starts > 1)
    # A sign or digit right between two letters.
    letter = words.LETTER[t.raw]
    odd = np.zeros(len(t.raw), bool)
    odd[1:-1] = letter[:-2] & letter[2:] & ~letter[1:-1] & words.WORD[t.raw[1:-1]] & (t.raw[1:-1] != 0x27) & (t.raw[1:-1] != 0x2D)
    cols += [per(you) / n, count(upper) / size, per(shout) / n, count(t.raw == 0x21) / size, count(t.raw == 0x3F) / size, count(odd) / n, np.log1p(t.n_words)]
    return np.stack(cols, 1)


class Trees:
    """Boosted regression trees on binned features, for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.bins(x)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.trees = []
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = self.grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            z += self.walk(tree, b)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A full tree: feature and bin of each inner node, value of each leaf."""
        inner, node = np.zeros((2**DEPTH - 1, 2), int), np.zeros(len(g), int)
        for level in range(DEPTH):
            k, first = 2**level, 2**level - 1
            best = np.full(k, 1e-6)
            inner[first : first + k] = [0, BINS]
            for f in range(b.shape[1]):
                at = node * BINS + b[:, f]
                sg, sh, sn = (np.bincount(at, v, k * BINS).reshape(k, BINS).cumsum(1) for v in (g, h, np.ones_like(g)))
                tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                gain[(sn < 8) | (tn - sn < 8)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(k), top] > best
                best[better] = gain[np.arange(k), top][better]
                inner[first : first + k][better] = np.stack([np.full(k, f), top], 1)[better]
            own = inner[first + node]
            node = node * 2 + (b[np.arange(len(node)), own[:, 0]] > own[:, 1])
        leaf = np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
        return inner, RATE * leaf

    def walk(self, tree, b: np.ndarray) -> np.ndarray:
        inner, leaf = tree
        node = np.zeros(len(b), int)
        for level in range(DEPTH):
            own = inner[2**level - 1 + node]
            node = node * 2 + (b[np.arange(len(b)), own[:, 0]] > own[:, 1])
        return leaf[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.base + sum(self.walk(t, b) for t in self.trees)


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to ``y``, as points between which to interpolate."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of z
    for a, b in zip(z[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(texts: list[bytes], y: np.ndarray) -> dict:
    person = second_person()
    parts, sets = [], ([], [])
    for text in texts:
        t = words.Texts([text], words.LETTER, lower=True)
        h, s = t.hash(), t.hash(STEM_BYTES)
        parts.append((text, h, s))
        sets[0].append(np.unique(h))
        sets[1].append(np.unique(s))
    learn = lambda rows: tuple(learn_lexicon([s[i] for i in rows], y[rows]) for s in sets)

    def table(rows, lexicons):
        return np.concatenate([features(words.Texts([parts[i][0]], words.LETTER, lower=True), parts[i][1], parts[i][2], lexicons, person) for i in rows])

    everything, fold = np.arange(len(y)), np.arange(len(y)) % FOLDS
    x = np.zeros((0, 0))
    for f in range(FOLDS):
        rows = everything[fold == f]
        own = table(rows, learn(everything[fold != f]))
        if not len(x):
            x = np.zeros((len(y), own.shape[1]))
        x[rows] = own
    z = np.zeros(len(y))
    for f in range(FOLDS):
        z[fold == f] = Trees(x[fold != f], y[fold != f]).score(x[fold == f])
    return {"lexicons": learn(everything), "person": person, "trees": Trees(x, y), "calibration": isotonic(z, y)}


def predict(texts: list[bytes], model: dict) -> np.ndarray:
    if "trees" not in model:
        return np.full(len(texts), model["share"])
    t = words.Texts(texts, words.LETTER, lower=True)
    z = model["trees"].score(features(t, t.hash(), t.hash(STEM_BYTES), model["lexicons"], model["person"]))
    return np.interp(z, *model["calibration"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fifth, chosen by a hash of their id."""
    picked = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    y = np.array([float(r["toxic"] > 0) for r in own])
    if len(y) < 40 or not 3 <= y.sum() <= len(y) - 3:
        return {"share": float(y.mean()) if len(y) else 0.0}
    return fit([(r["text"] or "").encode() for r in own], y)


def score(docs: DataFrame, model: dict) -> DataFrame:
    # Lexicons of the bounded sample and 60 small trees, by value: executors need no copy of this package.
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for batch in batches:
            ids, held = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out"))
            for a, b, texts in words.slices(batch, "text"):
                p = predict(texts, model)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), held.slice(a, b - a), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents")
    return score(docs, train(docs, store.read(spark, sf_dir, "labels")))
