"""The llm operators on small tables, next to brute force, an exact round trip or the SQL."""

import io
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))
tokenizers = pytest.importorskip("public_tokenizers")

from cueflow.llm import bpe, chat, html_main, jaccard, mixing, packed, perplexity, quality, topk, toxicity, words  # noqa: E402

WORDS = r"[^\x20\x09-\x0D]+"


def near_texts(seed):
    rng = random.Random(seed)
    some = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    texts, passage = [None, "", " \n ", "a b", "A  b", "a"], " ".join(some(60))
    for size, edits in ((12, 1), (12, 3), (9, 2)):
        base = some(80)
        texts.append(" ".join(base))
        for _ in range(size):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(80)] = some(1)[0]
            texts.append(" ".join(copy))
    texts += [passage + " " + " ".join(some(40)) for _ in range(10)] + [texts[8]] * 3
    return list(enumerate(texts))


def brute_classes(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("rows_cap", [10_000, 5])
def test_jaccard_classes(spark, monkeypatch, rows_cap):
    monkeypatch.setattr(jaccard, "REGION_ROWS", rows_cap)
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", min(1000, rows_cap))
    monkeypatch.setattr(jaccard, "LEVELS", 2)
    rows = near_texts(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df).collect()}
    assert got.pop(None) == (2, None)
    assert got == brute_classes(rows)


def test_bpe_equals_the_library():
    import tiktoken

    path, pattern = bpe.vocabulary()
    mine = bpe.load(path, pattern)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=mine.ranks, special_tokens={})
    for t in ["", " ", "the cat's", "aXb" * 2000, "a" * 3000, " " * 999 + "x", "é ñ 漢字 👍🏽\n\n 12", "%%%***"]:
        ids = mine.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert mine.decode(ids) == t.encode()
    assert not any(mine.low)


@pytest.mark.parametrize("width", [1, 5, 13, 16, 17])
def test_packing_round_trip(width):
    rng = np.random.default_rng(width)
    sink, counts = io.BytesIO(), np.array([0, 3, 70, 1, 200])
    ids = rng.integers(0, 2**width, counts.sum()).astype(np.uint32)
    w = packed.Writer(sink, width, block=64)
    w.add([1, 2, None, 4, 5], counts, ids)
    w.close()
    r = packed.Reader(pa.BufferReader(sink.getvalue()))
    cut = np.cumsum([0, *counts])
    for k in range(5):
        assert r.document(k).tolist() == ids[cut[k] : cut[k + 1]].tolist()
    assert r.null.tolist() == [False, False, True, False, False]


def test_packed_words_equal_the_library():
    e = packed.Encoder(tokenizers.path("word_bpe_49k.json"))
    texts = ["", "Don't  STOP 'sub ''s we'll 12 a1!'s", "Éa ñ ¿qué? <|endoftext|> x", "漢字 ΣΑΣ", "it's\tI'm\n%%%"]
    flat, n = e.encode(texts)
    assert flat.tolist() == [i for ids in e.library(texts) for i in ids]
    assert n.sum() == len(flat)


def test_topk_with_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 20)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8)) * rng.exponential(size=(120, 1))
    v[7] = v[9]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (220, [float("nan")] * 8), (None, [1.0] * 8), (3, v[3].tolist())]
    got = topk.topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), topk.F.col("id") % 20 == 0).collect()
    w = np.floor(64 * v).astype(int)
    for q in range(0, 120, 20):
        want = sorted((-int(w[q] @ w[i]), i) for i in range(120) if i != q)[:20]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_quality_counters():
    texts = ["", "a b\na b\n\n x", "w " * 30, "é# <b>", "one two three four five six seven eight nine " * 2]
    t = words.Texts([x.encode() for x in texts])
    c = quality.counters(t, t.hash())
    for k, x in enumerate(texts):
        w, lines = re.findall(WORDS, x), [y for y in x.split("\n") if re.search(WORDS, y)]
        seen = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        cover = {j for i, s in enumerate(seen) if seen.count(s) > 1 for j in range(i, i + 8)}
        assert (c["n_words"][k], c["word_chars"][k], c["n_dup_lines"][k], c["n_repeat_words"][k]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))


def test_main_text():
    page = "<html><body><nav><a>m</a></nav><article><h1>T &amp; u</h1><p>One<br>two<p>x<div class='comments'><p>no</div></article><footer>f</footer></body></html>"
    weights = html_main.weigh([(n, i, c) for (n, i), c in html_main.counts(page).items()])
    assert html_main.main_text(page, weights) == "T & u\nOne two\nx"
    assert html_main.main_text("", weights) == "" == html_main.main_text("<div", weights)


def test_chat_pieces_agree():
    model = {"emit": np.log(np.random.default_rng(0).dirichlet(np.ones(chat.KINDS), 3)), "move": np.log([[0.1, 0.8, 0.1], [0.1, 0.2, 0.7], [0.1, 0.7, 0.2]]), "start": np.log([0.4, 0.4, 0.2])}
    seen = np.random.default_rng(1).integers(0, chat.KINDS, 40)

    def found(size):
        parts = [seen[a : a + size] for a in range(0, 40, size)]
        ends = chat.combine([chat.reduce_piece(p, model) for p in parts], model)
        return np.concatenate([chat.decode_piece(p, a, b, model) for p, (a, b) in zip(parts, ends)]).tolist()

    assert found(40) == found(7) == found(1)


def test_mixing_empty_and_nulls(spark):
    schema = "doc_id long, source string, text string, size string"
    empty = mixing.mixed_documents(spark.createDataFrame([], schema))
    assert empty.columns == ["doc_id", "source", "text", "size"] and empty.count() == 0
    d = spark.createDataFrame([(1, "a", "x y z", "s"), (2, None, "x " * 9, "s"), (3, "b", None, None), (None, "a", "p q", None)], schema)
    got = mixing.mix(d.drop("size")).collect()
    assert sum(r.taken for r in got) == 21 and all(r.taken <= 2 * r["size"] for r in got)


def test_toxicity_and_perplexity_without_labels(spark):
    d = spark.createDataFrame([(1, "en", None), (2, None, "some text")], "doc_id long, lang string, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(d, toxicity.train(d, none)).collect()] == [0.0, 0.0]
    assert perplexity.judged(d, none).filter("kept").count() == 2
    assert quality.score(d, quality.train(d, none)).filter("kept").count() == 0


def brute_nats(counted, text, frequent):
    """Sum of -log p over the words of a text and its end, from plain dictionaries; ``frequent`` words are symbols, others the class <rare>."""
    symbol = lambda w: w if w in frequent else "<rare>"
    size = len(frequent) + 3
    pairs, rare = {}, {}
    for t in counted:
        ws = t.lower().split()
        w = ["<s>", *map(symbol, ws), "</s>"]
        for p in zip(w, w[1:]):
            pairs[p] = pairs.get(p, 0) + 1
        for x in ws:
            if x not in frequent:
                rare[x] = rare.get(x, 0) + 1

    def order(counts):
        n = [0, *[sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        return [min(float(k), max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)]

    follow = {}
    for _, w in pairs:
        follow[w] = follow.get(w, 0) + 1
    d1, d2, d3, total = order(follow), order(pairs), order(rare), len(pairs)
    taken = lambda counts, d: sum(d[min(c, 3) - 1] for c in counts.values())
    spread = taken(follow, d1) / size

    def p(v, w):
        one = max((follow.get(w, 0) - (d1[min(follow[w], 3) - 1] if w in follow else 0) + spread) / total, 1e-6 / size)
        mine = {x: c for x, c in pairs.items() if x[0] == v}
        if not mine:
            return one
        n = sum(mine.values())
        c = mine.get((v, w), 0)
        return (c - d2[min(c, 3) - 1] if c else 0) / n + max(1e-6, taken(mine, d2) / n) * one

    every = sum(rare.values())
    spare = max(1e-6, taken(rare, d3) / every) / (len(rare) + 1) if every else 0.5

    def within(w):
        return spare + ((rare[w] - d3[min(rare[w], 3) - 1]) / every if w in rare else 0)

    ws = text.lower().split()
    w = ["<s>", *map(symbol, ws), "</s>"]
    return sum(-np.log(p(*x)) for x in zip(w, w[1:])) - sum(np.log(within(x)) for x in ws if x not in frequent)


def chained(rng, n):
    """Texts of 40 words in which each word has two possible successors."""
    out = []
    for _ in range(n):
        at, ws = rng.randrange(60), []
        for _ in range(40):
            ws.append(f"w{at}x")
            at = (at * 7 + rng.choice((1, 2))) % 60
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize(("shard_rows", "share", "hot"), [(1 << 20, 2.0**-17, 2.0**-18), (20, 2.0**-17, 1.0), (20, 0.034, 0.01)])
def test_perplexity_is_of_word_pairs(spark, monkeypatch, shard_rows, share, hot):
    monkeypatch.setattr(perplexity, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(perplexity, "SHARE", share)
    monkeypatch.setattr(perplexity, "HOT_SHARE", hot)
    monkeypatch.setattr(perplexity, "PRIOR_ROWS", 0)
    rng = random.Random(4)
    good = chained(rng, 120)
    mixed = [" ".join(rng.sample(t.split(), 40)) for t in chained(rng, 20)]
    new = chained(rng, 20) + ["W1x unseen w8x", "unseen"]
    rows = [(i, "en", t) for i, t in enumerate(good + mixed + new + new[:3])] + [(900, "en", None), (None, "en", " \n ")]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, quality int")
    kept_back = {r.text for r in d.filter(perplexity.held(perplexity.F.xxhash64("text"))).collect()}
    counted = [t for t in good if t not in kept_back]
    assert 0 < len(counted) < 120
    got = {r.key: r for r in perplexity.sums(d, perplexity.train(d, labels)).collect()}
    names = set(perplexity.vocabulary(d).names.tolist())
    own = {w for t in good + mixed + new for w in t.lower().split()}
    frequent = {w for w in own if int((words.Texts([w.encode()]).hash() >> perplexity.SHIFT)[0]) in names}
    assert frequent == own if share < 0.01 else 0 < len(frequent) < len(own)
    keys = d.select("text", perplexity.F.xxhash64("text").alias("key")).distinct().collect()
    for r in keys:
        if r.text and r.text.strip():
            assert got[r.key].n_words == len(r.text.split()) + 1
            assert got[r.key].nats == pytest.approx(brute_nats(counted, r.text, frequent), rel=1e-5)
    if share > 0.01:
        return
    judged = {r.doc_id: r for r in perplexity.judged(d, labels).collect()}
    assert len(judged) == len(rows) and judged[900].kept and judged[None].kept
    assert not any(judged[i].kept for i in range(120, 140))
    assert min(judged[i].perplexity for i in range(120, 140)) > max(judged[i].perplexity for i in range(140, 160))


def test_perplexity_threshold_is_the_quantile_of_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "PRIOR_ROWS", 0)
    rng = random.Random(6)
    good = chained(rng, 400)
    rows = [(i, "en", t if i % 3 else " ".join(t.split()[:4])) for i, t in enumerate(good)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    got = perplexity.judged(d, labels).filter(perplexity.held(perplexity.F.xxhash64("text"))).collect()
    scores = sorted(np.log(r.perplexity) for r in got)
    assert np.log(got[0].threshold) == pytest.approx(scores[int(np.ceil(len(scores) * 0.99)) - 1], abs=0.0011)
    assert sum(not r.kept for r in got) == len(got) - int(np.ceil(len(got) * 0.99))


@pytest.mark.parametrize("k", [0, 1, 4])
def test_perplexity_keeps_clean_texts_of_rare_languages(spark, k):
    rng = random.Random(7)
    new = lambda: " ".join("".join(rng.choice("äöüß") for _ in range(6)) for _ in range(40))
    rows = [(i, "en", t) for i, t in enumerate(chained(rng, 200))] + [(200 + i, "de", new()) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200 + k)], "doc_id long, quality int")
    assert perplexity.judged(d, labels).filter("lang = 'de' and not kept").count() == 0


def test_mixing_draws_whole_texts(spark):
    sizes = [7, 11, 13, 17, 19, 23] * 4
    texts = [" ".join(f"t{i}w{k}" for k in range(n)) for i, n in enumerate(sizes)]
    schema = "doc_id long, source string, text string"
    for ids in ([None] * len(texts), list(range(len(texts)))):
        d = spark.createDataFrame([(i, "abc"[k % 3], t) for k, (i, t) in enumerate(zip(ids, texts))] + [(None, "a", None)], schema)
        got = mixing.mixed_documents(d)
        assert got.dtypes == d.dtypes
        drawn = got.collect()
        assert drawn and {r.text for r in drawn} <= set(texts)
        assert {r.doc_id for r in drawn} <= set(ids)
        target = {r.source: r.target for r in mixing.mix(d).select("source", "target").collect()}
        for source, most in target.items():
            assert abs(sum(len(r.text.split()) for r in drawn if r.source == source) - most) <= max(sizes)


def test_toxicity_model_needs_no_package(tmp_path):
    import pickle
    import subprocess

    from pyspark import cloudpickle

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["good", "day", "tree", "you", "IDIOT", "awful"] if k % 4 == 0 else ["good", "day", "tree", "you", "house"]) for _ in range(30)).encode() for k in range(200)]
    model = toxicity.fit(texts, np.array([float(k % 4 == 0) for k in range(200)]))
    (tmp_path / "model").write_bytes(cloudpickle.dumps((model, toxicity.predict)))
    (tmp_path / "texts").write_bytes(pickle.dumps(texts))
    code = "import pickle; m, p = pickle.load(open('model', 'rb')); print(float(p(pickle.load(open('texts', 'rb')), m).sum()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    assert float(got.stdout) == pytest.approx(float(toxicity.predict(texts, model).sum()))
