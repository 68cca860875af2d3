"""Token ids in fixed-width bit packing, in files with block offsets.

A file holds the documents of one range of ids in ascending order. Its ids are cut into blocks of
``BLOCK``; a block stores each id in the minimum number of bits the vocabulary needs, lowest bit
first, so numpy unpacks it in one step. The footer lists the offset of every block and the first
id of every document: any document is read by seeking to its blocks.

    "CFPACK01" | blocks | doc ids i8[n] | null flags u1[n] | first ids i8[n + 1] | block offsets i8[m + 1]
    | width, block, n documents, n ids, n blocks, footer offset: i8 each | "CFPACK01"

Tasks write under names of their own, and only the files that the written manifest lists count: a
task that is run again after a lost executor leaves at worst an unlisted file.

Defined results: a null or empty text has the end id only; a null id sorts first; rows of one id
stand in the order of their texts; repeated rows are kept; an empty table gives no rows and no
files; other columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.llm import store, words
from cueflow.llm.registry import query

MAGIC = b"CFPACK01"
BLOCK = 1 << 16
END_ID = 2
#: Words whose ids a Python worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Words per line, and what ends the last token of a word.
LINE = 1000
END_MARK = "</w>"
#: Bytes of text that are encoded at a time.
SLICE = 2 << 20

# Texts of these signs only are cut into words here; of others the library gets the whole text.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡¿À-ÖØ-öø-įı-ȳ]|<\\|(?:start|end)oftext\\|>")
_ASCII = bytes([9, 10, 13, *range(32, 127)])
_KIND = np.full(256, 3, np.int8)  # 0 space, 1 letter, 2 digit, 3 sign
_KIND[[9, 10, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(0xC3, 0xC9)]] = 1
_KIND[48:58] = 2


def cut_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's words in lower-case text."""
    kind = _KIND[buf]
    tail = np.flatnonzero((buf & 0xC0) == 0x80)
    kind[tail] = kind[tail - 1]
    new = np.ones(len(buf), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(buf))
    # A lone apostrophe takes the letters of an English short form along.
    k = np.flatnonzero((buf[s] == 0x27) & (e - s == 1) & (e + 1 < len(buf)))
    one, two = buf[e[k]], buf[e[k] + 1]
    more = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)  # s t m d
    pair = one.astype(int) << 8 | two
    more[np.isin(pair, [0x7265, 0x7665, 0x6C6C])] = 2  # re ve ll
    e[k] += more
    s[k[more > 0] + 1] += more[more > 0]
    on = (kind[np.minimum(s, len(buf) - 1)] > 0) & (e > s)
    return s[on], e[on]


class Encoder:
    """The library's ids; words it has seen are looked up by their hash."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        # The same model for words that are cut and lower-cased already.
        plain = json.loads(self.t.to_str()) | {"normalizer": None, "added_tokens": [], "post_processor": None}
        plain["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *[x for x in plain["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel"]]}
        self.words = Tokenizer.from_str(json.dumps(plain))
        self.size = self.t.get_vocab_size()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in self.t.get_vocab().items() if token.endswith(END_MARK)]] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted; the ids of word k are pool[begin[k]:][:len[k]]
        self.begin, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def library(self, texts: list[str], words_only: bool = False) -> list[list[int]]:
        t = self.words if words_only else self.t
        return [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str, raw: bytes) -> bool:
        """Whether ``text`` holds signs only that are cut into words here; its ASCII letters are passed over as bytes."""
        return not _OTHER.search(text if b"<|" in raw else raw.translate(None, _ASCII).decode())

    def _ids_of(self, words_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of separate words in a row and the number of each word's.

        Words go to the library in lines: a word's last token carries the end mark, so the line's ids fall
        apart again. A line whose marks don't match its words is asked word by word.
        """
        ids, n = [], []
        lines = [words_[a : a + LINE] for a in range(0, len(words_), LINE)]
        for line, got in zip(lines, self.library([b" ".join(x).decode() for x in lines], True), strict=True):
            got = np.array(got, np.uint32)
            last = np.flatnonzero(self.ends[got])
            if len(last) == len(line) and (not len(got) or last[-1] == len(got) - 1):
                ids.append(got)
                n.append(np.diff(last, prepend=-1))
            else:
                each = self.library([x.decode() for x in line])
                ids.append(np.array([x for e in each for x in e], np.uint32))
                n.append(np.array([len(e) for e in each], np.int64))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *n])

    def _learn(self, hashes: np.ndarray, words_: list[bytes]) -> None:
        ids, n = self._ids_of(words_)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(n) - n
        self.used += len(ids)
        # The new words go to their places among the sorted old ones; those are not sorted again.
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known, self.begin, self.len = (np.insert(a, at, b[order]) for a, b in ((self.known, hashes), (self.begin, begin), (self.len, n)))

    def _places(self, u: np.ndarray) -> np.ndarray:
        """Where each of the hashes ``u`` is known, -1 if it is not."""
        at = np.searchsorted(self.known, u)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == u[hit]
        return np.where(hit, at, -1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's."""
        raws = [t.encode() for t in texts]
        plain = [i for i, t in enumerate(texts) if self._plain(t, raws[i])]
        own = set(plain)
        rest = [i for i in range(len(texts)) if i not in own]
        count = np.zeros(len(texts), np.int64)
        parts: dict[int, np.ndarray] = {}
        for i, ids in zip(rest, self.library([texts[i] for i in rest]), strict=True):
            parts[i], count[i] = np.array(ids, np.uint32), len(ids)
        flat = np.zeros(0, np.uint32)
        if plain:
            # Bytes of ASCII are lower-cased as such; the same bytes as the text's.
            low = [raws[i].lower() if texts[i].isascii() else texts[i].lower().encode() for i in plain]
            buf = np.frombuffer(b"\n".join([*low, b""]), np.uint8)
            first = np.cumsum([0, *(len(x) + 1 for x in low)])[:-1]
            s, e = cut_words(buf)
            inverse, u = pd.factorize(words.hashes(buf, s, e))
            if len(self.known) + len(u) > REMEMBERED:
                self.clear()
            k = self._places(u)
            new = np.flatnonzero(k < 0)
            if len(new):
                at = np.empty(len(u), np.int64)
                at[inverse] = np.arange(len(s))  # any place of the word
                raw = buf.tobytes()
                self._learn(u[new], [raw[x:y] for x, y in zip(s[at[new]].tolist(), e[at[new]].tolist(), strict=True)])
                k = self._places(u)
            begin, n = self.begin[k][inverse], self.len[k][inverse]
            upto = np.cumsum(n)
            flat = self.pool[np.repeat(begin - upto + n, n) + np.arange(int(upto[-1]) if len(upto) else 0)]
            # Words stand in the order of their texts, so a text's ids are those up to its last word's.
            before = np.concatenate([[0], upto])[np.searchsorted(s, np.append(first, len(buf)))]
            count[plain] = np.diff(before)
        if not rest:
            return flat, count
        at = 0
        out = []
        for i in range(len(texts)):
            if i in parts:
                out.append(parts[i])
            else:
                out.append(flat[at : at + count[i]])
                at += count[i]
        return np.concatenate(out) if out else flat, count


def width_of(n_ids: int) -> int:
    """Bits that the ids 0 .. n_ids - 1 need."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Writes one file; at most one block of ids waits in memory."""

    def __init__(self, sink, width: int, block: int = BLOCK):
        self.sink, self.width, self.block = sink, width, block
        self.docs, self.null, self.first, self.offsets = [], [], [0], [len(MAGIC)]
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0
        sink.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def add(self, docs: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs += [x or 0 for x in docs]
        self.null += [x is None for x in docs]
        self.first += (self.first[-1] + np.cumsum(counts)).tolist()
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            all_ids = np.concatenate(self.waiting)
            whole = len(all_ids) // self.block * self.block
            for a in range(0, whole, self.block):
                self._block(all_ids[a : a + self.block])
            self.waiting, self.n_waiting = [all_ids[whole:]], len(all_ids) - whole

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        footer = self.offsets[-1]
        self.sink.write(np.array(self.docs, "<i8").tobytes() + np.array(self.null, "u1").tobytes() + np.array(self.first, "<i8").tobytes() + np.array(self.offsets, "<i8").tobytes())
        self.sink.write(np.array([self.width, self.block, len(self.docs), self.n_ids, len(self.offsets) - 1, footer], "<i8").tobytes() + MAGIC)


class Reader:
    """Random access to a file's documents."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        head = source.read_at(56, end - 56)
        if head[48:] != MAGIC:
            raise ValueError("not a packed token file")
        self.width, self.block, n, self.n_ids, m, footer = np.frombuffer(head[:48], "<i8").tolist()
        raw = source.read_at(end - 56 - footer, footer)
        self.docs = np.frombuffer(raw, "<i8", n)
        self.null = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.first = np.frombuffer(raw, "<i8", n + 1, 9 * n)
        self.offsets = np.frombuffer(raw, "<i8", m + 1, 17 * n + 8)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a .. b - 1 of the file."""
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, (b - 1) // self.block
        data = self.source.read_at(int(self.offsets[j + 1] - self.offsets[i]), int(self.offsets[i]))
        # Blocks but the last are full; a full block of a width that is no whole number of bytes still ends on one.
        got = unpack(data, self.width, min((j + 1) * self.block, self.n_ids) - i * self.block)
        return got[a - i * self.block : b - i * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files below ``path``; returns their manifest (a written table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, w, first = f"{path}/files/{uuid.uuid4().hex}.ids", None, None
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for a, b, texts in words.slices(batch, "text", SLICE):
                if w is None:
                    files, where = fs.FileSystem.from_uri(name)
                    files.create_dir(where.rpartition("/")[0], recursive=True)
                    enc, sink = encoder(tokenizer), files.open_output_stream(where)
                    w, first = Writer(sink, width_of(max(enc.size, end_id + 1))), ids[0]
                flat, n = enc.encode([t.decode() for t in texts])
                w.add(ids[a:b], n + 1, np.insert(flat, np.cumsum(n), end_id))
        if w is not None:
            w.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([len(w.docs)], pa.int64()), pa.array([w.n_ids], pa.int64())], names=["file", "first_doc", "n_docs", "n_ids"])

    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ranged.mapInArrow(run, "file string, first_doc long, n_docs long, n_ids long").write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema("file string, first_doc long, n_docs long, n_ids long").parquet(f"{path}/manifest")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: its first id's place, number of ids and their checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                files, where = fs.FileSystem.from_uri(row["file"])
                with files.open_input_file(where) as f:
                    r = Reader(f)
                    a = 0
                    while a < len(r.docs):
                        # As many documents as fit some blocks, one at least.
                        b = max(a + 1, int(np.searchsorted(r.first, r.first[a] + 16 * r.block)) - 1)
                        ids = r.ids(int(r.first[a]), int(r.first[b])).astype("<u4")
                        cut = (r.first[a : b + 1] - r.first[a]).tolist()
                        crc = [zlib.crc32(ids[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(r.docs[a:b], pa.int64(), mask=r.null[a:b]), pa.array(r.first[a:b] + row["before"], pa.int64()),
                            pa.array(np.diff(r.first[a : b + 1]), pa.int64()), pa.array(crc, pa.int64()),
                        ], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        a = b

    # One row per file: the running sum is over the list of files, not over documents.
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "file")
    placed = manifest.withColumn("before", F.sum("n_ids").over(order) - F.col("n_ids"))
    n = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return placed.repartition(int(n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op8_packed_ids")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(write(store.read(spark, sf_dir, "documents"), store.fresh(spark, "packed"), public_tokenizers.path("word_bpe_49k.json")))
