"""Byte-level BPE encoding and decoding with a rank queue over a hierarchical bitmap.

A pre-token is a linked list of byte pieces. Every mergeable neighbour pair waits in the bucket of
its merge rank; two levels of 256-bit words say which buckets hold anything, so the lowest rank
is found by two find-first-set steps. A bucket holds list positions from left to right; an
entry whose pair has changed meanwhile is stale and skipped. The work is linear in the length
of the pre-token, however long it is; short ones (nearly all) keep their pairs in a list. Pieces that were encoded before are looked up.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows give
repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm import store
from cueflow.llm.registry import query

#: Pre-tokens whose ids each Python worker remembers: this many young ones and as many old ones.
REMEMBERED = 400_000
REMEMBERED_BYTES = 64
#: Bytes up to which a pre-token's pairs are kept in a plain list.
SHORT = 48
BIT = [1 << i for i in range(256)]


class Known(dict):
    """The ids of pre-tokens, made by ``merge`` where they are asked for first; a full table of short ones becomes the old one."""

    def __init__(self, merge: Callable[[bytes], list[int]]):
        self.merge = merge
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.old.get(token) or tuple(self.merge(token.encode()))
        if len(token) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[token] = ids
        return ids


class Bpe:
    """Encoder and decoder for ``ranks`` (bytes to id) and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.known = Known(self.merge)
        # The bitmap: a bit per rank in words of 256, and a bit per word. All zero between calls.
        self.low = [0] * ((max(ranks.values(), default=0) >> 8) + 1)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        if len(piece) <= SHORT:
            return self.merge_short(piece)
        low, top, n = self.low, 0, len(piece)
        end, prev = list(range(1, n + 2)), list(range(-1, n - 1))  # of the piece that begins at a position
        buckets: dict[int, list[int]] = {}
        for a in range(n - 1):
            if (r := get(piece[a : a + 2])) is not None:
                if r in buckets:
                    buckets[r].append(a)
                else:
                    buckets[r] = [a]
                    low[r >> 8] |= BIT[r & 255]
                    top |= BIT[r >> 8]
        while top:
            i = (top & -top).bit_length() - 1
            x = low[i]
            r = i << 8 | (x & -x).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                a = heappop(bucket)
            else:
                a = bucket[0]
                del buckets[r]
                low[i] = x = x & (x - 1)
                if not x:
                    top &= top - 1
            # Stale: the piece is gone (its end is 0), or its pair is another one by now.
            b = end[a]
            if not b or b >= n or get(piece[a : end[b]]) != r:
                continue
            c = end[a] = end[b]
            end[b] = 0
            if c < n:
                prev[c] = a
                if (r := get(piece[a : end[c]])) is not None:
                    if r in buckets:
                        heappush(buckets[r], a)
                    else:
                        buckets[r] = [a]
                        low[r >> 8] |= BIT[r & 255]
                        top |= BIT[r >> 8]
            if a:
                a = prev[a]
                if (r := get(piece[a:c])) is not None:
                    if r in buckets:
                        heappush(buckets[r], a)
                    else:
                        buckets[r] = [a]
                        low[r >> 8] |= BIT[r & 255]
                        top |= BIT[r >> 8]
        out, a, ranks = [], 0, self.ranks
        while a < n:
            out.append(ranks[piece[a : end[a]]])
            a = end[a]
        return out

    def merge_short(self, piece: bytes) -> list[int]:
        """The same ids: the leftmost pair of the lowest rank is looked for in the list of pairs, which is faster where it is short."""
        ranks, none = self.ranks, 1 << 62
        get = ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (r := min(pairs)) != none:
            i = pairs.index(r)
            del pairs[i]
            parts[i] += parts.pop(i + 1)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def load(path: str, pattern: str) -> Bpe:
    """From a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


_loaded: dict[tuple[str, str], Bpe] = {}


def shared(path: str, pattern: str) -> Bpe:
    """One encoder per Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = load(path, pattern)
    return _loaded[path, pattern]


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array of ids per row."""
    schema = docs.select("*", F.expr("cast(null as array<int>)").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            for a in range(0, batch.num_rows, 256):
                got = [bpe.encode(t or "") for t in texts.slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, 256).columns, pa.array(got, pa.list_(pa.int32()))], names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that each row's ids stand for; null ids give null."""
    schema = docs.select("*", F.expr("cast(null as binary)").alias(column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path, pattern)
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(ids))
            for a in range(0, batch.num_rows, 256):
                got = [None if x is None else bpe.decode(x) for x in own.slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, 256).columns, pa.array(got, pa.binary())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text in one pass; only counts and digests leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path, pattern)
        sha = hashlib.sha256
        name = [str(i) for i in range(max(bpe.bytes, default=0) + 1)]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            n, a, b = [], [], []
            for i in range(batch.num_rows):
                ids = bpe.encode(texts[i].as_py() or "")
                n.append(len(ids))
                a.append(sha(" ".join(map(name.__getitem__, ids)).encode()).hexdigest())
                b.append(sha(bpe.decode(ids)).hexdigest())
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def tokenised(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, their number, and whether decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for a in range(0, batch.num_rows, 256):
                own = [t or "" for t in texts.slice(a, 256).to_pylist()]
                ids = [bpe.encode(t) for t in own]
                same = [bpe.decode(i) == t.encode() for i, t in zip(ids, own, strict=True)]
                part = batch.slice(a, 256)
                kept = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "lang", "source")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(same)], names=["doc_id", "lang", "source", "ids", "n_tokens", "same"])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, "doc_id long, lang string, source string, ids array<int>, n_tokens long, same boolean")


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store.read(spark, sf_dir, "documents"), *vocabulary())
