"""Short ways through an operator give what its long ways give."""

import random

import numpy as np

import public_tokenizers

from cueflow.llm import bpe, packed, phrases, words


def test_short_pieces_merge_as_long_ones(monkeypatch):
    letters = [bytes([c]) for c in b"abc "]
    words = [a + b for a in letters for b in letters] + [b"aba", b"abc", b"cab", b"abab", b" abc", b"abcabc"]
    rnd = random.Random(5)
    rnd.shuffle(words)
    coder = bpe.Bpe({w: i for i, w in enumerate(letters + words)}, r"\w+|\s+")
    pieces = ["".join(rnd.choice("aabbc ") for _ in range(rnd.randint(1, 60))).encode() for _ in range(400)]
    got = [coder.merge_short(p) for p in pieces]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert got == [coder.merge(p) for p in pieces]


def test_full_table_of_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.Bpe({bytes([c]): i for i, c in enumerate(b"abcdefgh ")}, r"\w|\s")
    assert coder.encode("abcdefgh abc") == [*range(9), 0, 1, 2] and len(coder.known) <= 3
    assert isinstance(coder.known, bpe.Known) and coder.known.old


def test_distinct_rows_packed_and_refined():
    rng = np.random.default_rng(2)
    for top, size in ((3, 4), (1 << 16, 4), (1 << 20, 4), (1 << 20, 2), (5, 2)):
        columns = [rng.integers(0, top, 500) * rng.integers(0, 2, 500) for _ in range(size)]
        first, count, pair = phrases.distinct(columns)
        rows, want, n = np.unique(np.stack(columns, 1), axis=0, return_index=True, return_counts=True)
        assert first.tolist() == want.tolist() and count.tolist() == n.tolist()
        assert pair.tolist() == np.unique(rows[:, :2], axis=0, return_inverse=True)[1].ravel().tolist()
    assert [len(x) for x in phrases.distinct([np.zeros(0, np.int64)] * 4)] == [0, 0, 0]


def test_windows_are_sorted_once(monkeypatch):
    calls, unique = [], np.unique
    monkeypatch.setattr(phrases.np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    phrases.distinct([np.arange(9) % 4] * 4)
    assert len(calls) == 1


def test_hashes_are_sums_of_each_run(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 64)
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 123, 900).astype(np.uint8)
    buf[rng.random(900) < 0.2] = 32
    buf[300:500] = 122  # a run longer than a piece
    s, e = words.spans(buf, words.WORD)
    m, c, full = int(words._M), int(words._C2), 1 << 64
    for most in (None, 3):
        n = [min(y - x, most or y - x) for x, y in zip(s.tolist(), e.tolist(), strict=True)]
        want = [(sum((int(buf[x + i]) + 1) * pow(m, i, full) for i in range(k)) + k * c) % full for x, k in zip(s.tolist(), n, strict=True)]
        assert words.hashes(buf, s, e, most).tolist() == words.mix(np.array(want, np.uint64)).tolist()
    assert len(words.hashes(buf, s[:0], e[:0])) == 0


def test_known_words_are_not_sorted_again(monkeypatch):
    enc = packed.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Ärger im Café, it's 42!", "", "plain\tASCII  words\x7f", "<|endoftext|> Привет", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))]
    sizes, argsort = [], np.argsort
    monkeypatch.setattr(packed.np, "argsort", lambda a, **k: sizes.append(len(a)) or argsort(a, **k))
    for part in (texts[:3], texts[3:], ["one more word"], texts):
        ids, n = enc.encode(part)
        want = enc.library(part)
        assert ids.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]
        assert (enc.known[1:] > enc.known[:-1]).all()
    assert len(enc.known) > 600 and sizes[-1] <= 3
