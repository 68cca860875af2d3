"""Quality rules: word counters and a calibrated logistic regression over hashed n-grams.

The regression reads hashed word uni- and bigrams and byte four-grams of the whole text. It is
fitted on labelled rows, its probabilities are calibrated on labelled rows that the fit did not
see, and every text is scored in Arrow batches against a fixed threshold.

Defined results: a null or empty text has no words, so it fails the base rules and is not kept;
repeated rows give repeated results; an empty table gives no rows; without labels of both
classes the verdict is the base rules' alone. Columns that a table has besides those named are
neither read nor returned by ``score``; ``filter_documents`` passes them on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm import store, words
from cueflow.llm.registry import query

BITS = 18  # hashed features
#: Rows with labels that the fit may see: the bound on what reaches the driver.
SAMPLE_ROWS = 4000
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)


def counters(t: words.Texts, h: np.ndarray) -> dict[str, np.ndarray]:
    """The rules' counters of every text."""
    lead = np.concatenate([[0], np.cumsum((t.raw & 0xC0) != 0x80)])
    chars = np.bincount(t.doc, lead[t.ends] - lead[t.starts], t.n).astype(np.int64)
    symbol = np.concatenate([[0], np.cumsum(SYMBOLS[t.raw])])
    s, e = words.spans(t.raw, words.LINE)
    # A line counts if a word starts in it.
    worded = np.searchsorted(t.starts, e) > np.searchsorted(t.starts, s)
    s, e = s[worded], e[worded]
    doc = np.searchsorted(t.first, s, side="right") - 1
    key = words.mix(words.hashes(t.raw, s, e) ^ words.mix(doc.astype(np.uint64)))
    _, at = np.unique(key, return_index=True)
    dup = np.bincount(doc, minlength=t.n) - np.bincount(doc[at], minlength=t.n)
    w, at = words.windows(h, t.doc, WINDOW)
    _, inverse, count = np.unique(words.mix(w ^ words.mix(t.doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    cover = np.zeros(len(h) + WINDOW + 1, np.int32)
    hit = at[count[inverse] > 1] if len(at) else at
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    repeated = np.bincount(t.doc, np.cumsum(cover)[: len(h)] > 0, t.n).astype(np.int64)
    n = t.n_words
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbol[t.first + t.size] - symbol[t.first], "n_dup_lines": dup,
        "n_repeat_words": repeated, "base_failed": (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n),
    }


def features(t: words.Texts, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, hashed feature) pairs of the word n-grams and of the byte n-grams."""
    shift = np.uint64(64 - BITS)
    pair, at = words.windows(h, t.doc, 2)
    word = (np.concatenate([t.doc, t.doc[at]]), (np.concatenate([h, pair]) >> shift).astype(np.int32))
    b = t.raw.astype(np.uint64)
    if len(b) < 4:
        return [word, (np.zeros(0, np.int64), np.zeros(0, np.int32))]
    g = b[:-3] | (b[1:-2] << np.uint64(8)) | (b[2:-1] << np.uint64(16)) | (b[3:] << np.uint64(24))
    start = np.repeat(np.arange(t.n), t.size + 1)
    inside = np.flatnonzero(start[:-3] == start[3:])
    return [word, (start[inside], ((g[inside] * words._M) >> shift).astype(np.int32))]


def raw_scores(t: words.Texts, h: np.ndarray, model: dict) -> np.ndarray:
    """Log odds: each family's mean weight, added up."""
    z = np.full(t.n, model["bias"])
    for (doc, f), w in zip(features(t, h), model["weights"], strict=True):
        z += np.bincount(doc, w[f], t.n) / np.maximum(np.bincount(doc, minlength=t.n), 1)
    return z


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.05) -> dict:
    """Weights by Adam on four of five rows, calibration (slope and offset) on the fifth."""
    size = 1 << BITS
    rows = []
    for text in texts:
        t = words.Texts([text])
        rows.append([f for _, f in features(t, t.hash())])
    y = labels.astype(float)
    held = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~held)
    # Both classes weigh the same.
    share = y[train].mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w, m, v = ([np.zeros(size) for _ in range(2)] for _ in range(3))
    bias, step, rng = 0.0, 0, np.random.default_rng(7)

    def score(i: int) -> float:
        return bias + sum(float(w[k][f].mean()) for k, f in enumerate(rows[i]) if len(f))

    for _ in range(epochs):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            z = np.array([score(i) for i in part])
            g = weight[part] * (1 / (1 + np.exp(-z)) - y[part]) / len(part)
            step += 1
            bias -= rate * g.sum()
            for k in range(2):
                own = [(rows[i][k], x / len(rows[i][k])) for i, x in zip(part, g, strict=True) if len(rows[i][k])]
                if not own:
                    continue
                grad = np.bincount(np.concatenate([f for f, _ in own]), np.concatenate([np.full(len(f), x) for f, x in own]), size)
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad**2
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    z = np.array([score(i) for i in np.flatnonzero(held)])
    a, b = calibrate(z, y[held])
    return {"bias": bias, "weights": [x.astype(np.float32) for x in w], "slope": a, "offset": b}


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make scores probabilities (Newton steps on smoothed targets)."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(z).max()), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], 1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * c
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        c -= np.linalg.solve(hess, grad)
    return float(c[0] / scale), float(c[1])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """Fit on at most ``sample_rows`` labelled rows, chosen by a hash of their id."""
    picked = (
        labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    one = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    y = np.array([r["quality"] for r in one])
    if len(set(y.tolist())) < 2 or len(y) < 10:
        return None
    return fit([(r["text"] or "").encode() for r in one], y)


def score(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """Counters, probability and verdict of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2^BITS floats: 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, b, texts in words.slices(batch, "text"):
                t = words.Texts(texts)
                yield verdicts(ids.slice(a, b - a), t, sent.value, threshold)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def verdicts(ids: pa.Array, t: words.Texts, model: dict | None, threshold: float) -> pa.RecordBatch:
    h = t.hash()
    c = counters(t, h)
    p = np.ones(t.n)
    if model:
        p = 1 / (1 + np.exp(-np.clip(model["slope"] * raw_scores(t, h, model) + model["offset"], -50, 50)))
    kept = ~c["base_failed"] & (p >= threshold)
    cols = [ids, *(pa.array(x) for x in c.values()), pa.array(kept), pa.array(p)]
    return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])


def filter_documents(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own, names = store.hidden(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.nulls(batch.num_rows, pa.int64())
            for a, b, texts in words.slices(batch, "text"):
                kept = verdicts(ids.slice(a, b - a), words.Texts(texts), sent.value, threshold).column(7)
                yield batch.slice(a, b - a).filter(kept)

    return own.mapInArrow(run, own.schema).select(*names)


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents")
    return score(docs, train(docs, store.read(spark, sf_dir, "labels")))
