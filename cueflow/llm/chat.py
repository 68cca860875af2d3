"""Chat formatting: roles by a hidden Markov model over messages, then canonical turns.

The hidden states are the roles. What is seen of a message is its speaker marker, if it begins with
one, and features of its lines: how many there are, their length, a question, code or list signs.
Start, transition and emission probabilities are counted over all labelled conversations outside a
held-out fifth; Viterbi finds the most likely roles of every conversation. Messages of one role in a
row make one turn; a message is rendered with its turn's header at a turn's first message and the end
mark at its last.

A conversation may be of any length. Messages are sorted by (conversation, turn) over all tasks and
cut into pieces of ``PIECE`` messages; each piece is reduced to the best score from each role at its
entry to each role at its exit, the pieces of a conversation are combined, and every piece is decoded
between the roles that this gave.

Defined results: a null or empty text is a message without lines; a null conversation or turn comes first
and the null conversation is one like others; equal turns stand in the order of their texts; a role
is never read for decoding, and unknown or null roles aren't counted for training; without labelled
messages markers alone decide; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.llm import store
from cueflow.llm.jaccard import groups
from cueflow.llm.registry import query

ROLES = ("system", "user", "assistant")
PIECE = 2048
MARKERS = {"system": 0, "sys": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1, "q": 1, "question": 1, "prompter": 1, "assistant": 2, "ai": 2, "bot": 2, "model": 2, "a": 2, "answer": 2, "gpt": 2}
_MARK = re.compile(r"\s*(?:[#>*\[<|]{0,3}\s*)(" + "|".join(MARKERS) + r")\s*(?:[\]>*|]{0,3})\s*[:：]\s*", re.I)
KINDS = 4 * 4 * 5 * 2 * 2
SCHEMA = "conv_key string, conv_id long, turn long, part int, place long, role int, before int, seen int, body string"


def observe(text: str) -> tuple[int, str]:
    """What the model sees of a message, and its text without the marker."""
    m = _MARK.match(text)
    mark, body = (MARKERS[m[1].lower()] + 1, text[m.end() :]) if m else (0, text)
    lines = [x for x in body.split("\n") if x.strip()]
    n, size = len(lines), len(body)
    seen = mark
    seen = seen * 4 + min(n, 3)
    seen = seen * 5 + sum(size >= k for k in (40, 160, 400, 1200))
    seen = seen * 2 + any(x.rstrip().endswith("?") for x in lines)
    seen = seen * 2 + any(x.lstrip().startswith(("```", "- ", "* ", "1.")) for x in lines)
    return seen, body


def messages(conversations: DataFrame) -> DataFrame:
    """One row per message in order, with what is seen of it; ``before`` is the role of the one before
    (-1 unknown role, -2 the first of a conversation, -3 not in this task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        place = 0
        for batch in batches:
            d = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in batch.schema.names}
            key, seen, body, before, roles = [], [], [], [], []
            for c, role, text in zip(d["conv_id"], d["role"], d["text"], strict=True):
                r = ROLES.index(role) if role in ROLES else -1
                s, b = observe(text or "")
                before.append(-3 if last is None else last[1] if last[0] == c else -2)
                last = (c, r)
                key.append("null" if c is None else str(c))
                roles.append(r)
                seen.append(s)
                body.append(b)
            n = batch.num_rows
            cols = [pa.array(key, pa.string()), pa.array(d["conv_id"], pa.int64()), pa.array(d["turn"], pa.int64()), pa.array(d["part"], pa.int32()), pa.array(range(place, place + n), pa.int64()), *(pa.array(x, pa.int32()) for x in (roles, before, seen)), pa.array(body, pa.string())]
            place += n
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("text").asc_nulls_first()]
    d = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    m = store.cut(d.mapInArrow(run, SCHEMA), "messages")
    # The first message of a task follows the last one of the task before: one row per task.
    ends = m.groupBy("part").agg(F.min(F.struct("place", "conv_key")).alias("first"), F.max(F.struct("place", "conv_key", "role")).alias("last"))
    w = Window.orderBy("part")
    ends = ends.select("part", F.when(F.lag("last.conv_key").over(w) == F.col("first.conv_key"), F.lag("last.role").over(w)).otherwise(-2).alias("_before"))
    first = m.filter("before = -3").join(ends, "part").withColumn("before", F.coalesce("_before", F.lit(-2))).drop("_before")
    return m.filter("before <> -3").unionByName(first)


def held_out() -> F.Column:
    return F.crc32(F.col("conv_key").cast("binary")) % 5 == 0


def train(m: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities, from counts with one added everywhere; a marker counts as its role's as well."""
    own = m.filter(~held_out())
    seen = own.filter("role >= 0").groupBy("role", "seen").count().collect()  # 3 * KINDS rows at most
    steps = own.filter("role >= 0 and before <> -1").groupBy("before", "role").count().collect()
    emit, move, start = np.ones((3, KINDS)), np.ones((3, 3)), np.ones(3)
    mark = np.arange(KINDS) // (KINDS // 4) - 1
    for r in range(3):
        emit[r][mark == r] += 20
    for r in seen:
        emit[r["role"], r["seen"]] += r["count"]
    for r in steps:
        if r["before"] == -2:
            start[r["role"]] += r["count"]
        else:
            move[r["before"], r["role"]] += r["count"]
    return {"emit": np.log(emit / emit.sum(1, keepdims=True)), "move": np.log(move / move.sum(1, keepdims=True)), "start": np.log(start / start.sum())}


def reduce_piece(seen: np.ndarray, model: dict) -> np.ndarray:
    """[i, j]: the best score of roles that begin with i and end with j, without the cost of i's entry."""
    best = np.full((3, 3), -np.inf)
    np.fill_diagonal(best, model["emit"][np.arange(3), seen[0]])
    for s in seen[1:]:
        best = (best[:, :, None] + model["move"][None]).max(1) + model["emit"][:, s]
    return best


def decode_piece(seen: np.ndarray, first: int, last: int, model: dict) -> np.ndarray:
    """The best roles that begin with ``first`` and end with ``last``; ties to the smaller role."""
    n = len(seen)
    back = np.zeros((n, 3), int)
    best = np.full(3, -np.inf)
    best[first] = model["emit"][first, seen[0]]
    for k in range(1, n):
        to = best[:, None] + model["move"]
        back[k] = to.argmax(0)
        best = to.max(0) + model["emit"][:, seen[k]]
    out = np.zeros(n, int)
    out[-1] = last
    for k in range(n - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def combine(pieces: list[np.ndarray], model: dict) -> list[tuple[int, int]]:
    """Entry and exit role of every piece of one conversation."""
    entry, back = model["start"], []
    for m in pieces:
        to = entry[:, None] + m
        back.append(to.argmax(0))
        leave = to.max(0)
        entry = (leave[:, None] + model["move"]).max(0)
        back.append((leave[:, None] + model["move"]).argmax(0))
    out = []
    last = int(leave.argmax())
    for k in range(len(pieces) - 1, -1, -1):
        first = int(back[2 * k][last])
        out.append((first, last))
        if k:
            last = int(back[2 * k - 1][first])
    return out[::-1]


def roles(m: DataFrame, model: dict) -> DataFrame:
    """``m`` with the role that was found for every message."""
    sent = m.sparkSession.sparkContext.broadcast(model)
    m = m.withColumn("piece", F.expr(f"place div {PIECE}"))
    order = ["part", "piece", "place"]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "id"):
            yield pa.RecordBatch.from_arrays([pa.array([t[c][0].as_py()]) for c in ("conv_key", "part", "piece")] + [pa.array([reduce_piece(t["seen"].to_numpy(), sent.value).ravel().tolist()])], schema=pa.schema([("conv_key", pa.string()), ("part", pa.int32()), ("piece", pa.int64()), ("best", pa.list_(pa.float64()))]))

    one = F.concat_ws("|", "conv_key", "part", "piece").alias("id")
    cut = m.select("conv_key", "part", "piece", "place", "seen", one).repartition("conv_key", "part", "piece").sortWithinPartitions("id", "place")
    pieces = cut.mapInArrow(reduce, "conv_key string, part int, piece long, best array<double>")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "conv_key"):
            got = combine([np.array(x).reshape(3, 3) for x in t["best"].to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays([t["conv_key"].combine_chunks(), t["part"].combine_chunks(), t["piece"].combine_chunks(), pa.array([x for x, _ in got], pa.int32()), pa.array([x for _, x in got], pa.int32())], names=["conv_key", "part", "piece", "first", "last"])

    ends = pieces.repartition("conv_key").sortWithinPartitions("conv_key", "part", "piece").mapInArrow(join, "conv_key string, part int, piece long, first int, last int")
    ends = store.cut(ends, "pieces")
    full = m.join(ends, ["conv_key", "part", "piece"]).withColumn("id", one)
    schema = full.select("*", F.lit(0).alias("found")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, "id"):
            got = decode_piece(t["seen"].to_numpy(), t["first"][0].as_py(), t["last"][0].as_py(), sent.value)
            yield from t.append_column("found", pa.array(got, pa.int32())).combine_chunks().to_batches()

    return full.repartition("conv_key", "part", "piece").sortWithinPartitions("id", "place").mapInArrow(decode, schema).drop("id", "first", "last")


def rendered(found: DataFrame) -> DataFrame:
    """conv_id, turn, place in the table's order, role, and the message as it stands in its canonical turn."""
    w = Window.partitionBy("conv_key", "part", "piece").orderBy("place")
    # Neighbours within a piece by a window of at most PIECE rows; across pieces by one row per piece.
    edge = found.groupBy("conv_key", "part", "piece").agg(F.min_by("found", "place").alias("first"), F.max_by("found", "place").alias("last"))
    p = Window.partitionBy("conv_key").orderBy("part", "piece")
    edge = edge.select("conv_key", "part", "piece", F.lag("last").over(p).alias("_prev"), F.lead("first").over(p).alias("_next"))
    d = found.withColumns({"prev": F.lag("found").over(w), "next": F.lead("found").over(w)}).join(edge, ["conv_key", "part", "piece"])
    prev, nxt = F.coalesce("prev", "_prev", F.lit(-1)), F.coalesce("next", "_next", F.lit(-1))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("found") + 1)
    head = F.when(prev != F.col("found"), F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise("")
    tail = F.when(nxt != F.col("found"), "\n<|end|>\n").otherwise("\n")
    body = F.trim(F.regexp_replace(F.regexp_replace("body", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
    return d.select("conv_id", "turn", "part", "place", role.alias("role"), (prev != F.col("found")).alias("starts_turn"), F.concat(head, body, tail).alias("rendered"), held_out().alias("held_out"))


@query("op5_chat_roles")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(store.read(spark, sf_dir, "conversations"))
    return rendered(roles(m, train(m))).drop("part", "place")
