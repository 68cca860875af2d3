"""What a task holds per byte of text is bounded by a piece of it, not by the slice that is counted together."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from cueflow.llm import perplexity, store, words


class Frame:
    """Stands for a DataFrame: keeps the functions that tasks would run."""

    sparkSession = sparkContext = property(lambda self: self)

    def __init__(self):
        self.tasks = []

    def mapInArrow(self, task, schema):
        self.tasks.append(task)
        return self

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def collect(self):
        return []

    def count(self):
        return 0

    def __getattr__(self, name):
        return lambda *a, **k: self


def test_words_of_a_slice_are_cut_by_pieces(spark, monkeypatch):
    held = []

    class Texts(words.Texts):
        def __init__(self, texts, *a, **k):
            held.append(sum(map(len, texts)))
            super().__init__(texts, *a, **k)

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 5000, 4000)) for _ in range(400)]
    size, longest = sum(map(len, texts)), max(map(len, texts))
    assert size > perplexity.SLICE
    batch = pa.RecordBatch.from_pydict({"key": np.arange(len(texts)), "text": texts})
    monkeypatch.setattr(store, "cut", lambda df, name: df)
    monkeypatch.setattr(perplexity, "likely", lambda docs, ids: docs)
    docs, none = Frame(), np.zeros(0)
    vocab = perplexity.vocabulary(docs)
    perplexity.counts(docs, Frame(), vocab)
    model = perplexity.Model(vocab, np.zeros(3), np.zeros(3), none.astype(np.int64), none, Frame(), 1.0)
    perplexity.sums(docs, model)
    monkeypatch.setattr(words, "Texts", Texts)
    frequent, pairs, asked = (pa.Table.from_batches(list(task(iter([batch])))) for task in docs.tasks[:3])
    assert max(held) <= (1 << 20) + longest
    n = 400 * 4000
    assert sum(m.as_py() for k, m in zip(frequent["name"], frequent["n"]) if k.as_py() == -1) == n
    assert sum(m.as_py() for k, m in zip(frequent["name"], frequent["n"]) if k.as_py() == -2) == size
    rare = int(perplexity.RARE_NAME)
    assert sum(m.as_py() for k, m in zip(pairs["name"], pairs["n"]) if k.as_py() >= rare) == n
    assert sum(m.as_py() for k, m in zip(pairs["name"], pairs["n"]) if k.as_py() < rare) == n + 400
    own = [r for r in asked.to_pylist() if r["kind"] == 2]
    assert len(own) == -(-size // perplexity.SLICE)  # one row for each slice, as before
    assert sum(np.frombuffer(r["runs"], np.int64).sum() for r in own) == n + 400
    assert sum(perplexity.unplanes(r["times"], 4).sum() for r in asked.to_pylist() if r["kind"] == 1) == 2 * n + 400
