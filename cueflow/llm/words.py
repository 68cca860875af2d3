"""Words, lines and hashes of whole Arrow batches as numpy arrays.

A batch of texts is laid end to end in one byte buffer with a line feed behind each text. A
byte table says which bytes belong to a word; everything else is arithmetic on arrays, so no
Python object is made per word. Hashes are 64 bits wide: two different words share one with
a probability of about 5e-20.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE  # [^\x20\x09-\x0D]
LINE = np.ones(256, bool)
LINE[0x0A] = False
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE = 1 << 20
_powers = {_M: np.ones(1, np.uint64)}
_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))


def powers(n: int, base: np.uint64 = _M) -> np.ndarray:
    """``base`` to the power of 0 .. n-1, kept from call to call."""
    if len(_powers.get(base, ())) < n:
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, base)]), dtype=np.uint64)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= _C1
    h ^= h >> np.uint64(27)
    h *= _C2
    h ^= h >> np.uint64(31)
    return h


def spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``table`` accepts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = np.zeros(len(buf) + 2, np.int8)
    on[1:-1] = table[buf]
    step = np.diff(on)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int | None = None) -> np.ndarray:
    """A hash for every run; only its first ``most`` bytes count if that is given.

    Works through pieces of up to PIECE bytes, so that the numbers per byte stay small. A run's sum of
    byte * M^place is a difference of running sums of the piece, divided by M^start (M is odd).
    """
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts if most is None else np.minimum(ends - starts, most)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE)))
        s, n = starts[a:b], lengths[a:b]
        low = int(s.min())
        s = s - low
        size = int((s + n).max())
        upto = np.zeros(size + 1, np.uint64)
        v = upto[1:]
        v += buf[low : low + size]
        v += np.uint64(1)
        v *= powers(size)[:size]
        np.cumsum(v, out=v)
        out[a:b] = (upto[s + n] - upto[s]) * powers(size + 1, _INVERSE)[s] + n.astype(np.uint64) * _C2
        a = b
    return mix(out)


class Texts:
    """Some texts in one buffer: ``buf``, the first byte of each text and their number."""

    def __init__(self, texts: list[bytes], table: np.ndarray = WORD, lower: bool = False):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.raw = raw
        self.buf = LOWER[raw] if lower else raw
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.n = len(texts)
        self.size = size - 1
        self.first = np.cumsum(size) - size
        self.starts, self.ends = spans(self.buf, table)
        self.doc = np.searchsorted(self.first, self.starts, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)
        self.word_at = np.cumsum(self.n_words) - self.n_words

    def hash(self, most: int | None = None) -> np.ndarray:
        return hashes(self.buf, self.starts, self.ends, most)


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words inside one text, and its first word's index."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    p = powers(n + 1)
    w = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        w += h[k : len(h) - n + 1 + k] * p[k + 1]
    return mix(w[inside]), inside


def slices(batch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) over an Arrow batch in slices of about ``most`` bytes; null is empty.

    Only the texts of one slice are Python objects at a time.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    a = 0
    while a < len(texts):
        # Up to the text that makes the slice full.
        b = min(len(texts), int(np.searchsorted(size, (size[a - 1] if a else 0) + most)) + 1)
        yield a, b, [t or b"" for t in texts.slice(a, b - a).to_pylist()]
        a = b
