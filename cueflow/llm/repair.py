"""Conversation structure repair: the cheapest edits that make the role initials ``(s?(ua)+)?``.

Edits of a row: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows);
an empty user or assistant row is Inserted anywhere for 5; a truncated row that stays costs 5 more.

A node is (rows read, state of the pattern). The cost DP runs backwards over all nodes; arcs on which it is
tight are the optimal ones. Prefix doubling then ranks nodes by their least audit of 1, 2, 4, ... letters,
a node takes the arc of least (letter, rank behind it), and the doubled pointers spell out the path.
An audit's letters name the path (the state decides which role a letter makes), so ties by audit are none.

A conversation may hold any share of the rows. Rows are sorted by (conversation, turn) over all tasks; a
task reduces its stretch of a conversation to the costs from each state at its entry to each at its
exit, the stretches (one per task at most) are combined, and each is solved between its neighbours' states.
Only the digest of the repaired text is one sequential pass per conversation: rows stream through it.

Defined results: null roles and texts are one space; a null conversation is one like others; null turns
come first; equal turns stand in the order of their role and text before damage; repeated rows are
duplicates; a conversation without rows after damage has zeros and empty texts; texts of any length are
read whole; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.llm import store
from cueflow.llm.registry import query

FAR = 1 << 60
#: Rows whose paths are ranked at once.
RANKED = 1 << 15
LETTERS = "DIKR"
# States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row. An
# inserted or reroled row is an assistant's after a user's and a user's otherwise.
MADE = np.array([2, 2, 3, 2])
#: Initials s, u, a, any other: the state behind a kept row, or -1.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Cost of what is missing at the end of the conversation.
END = np.array([0, 10, 5, 0])

# Symbol of a row: initial * 3 + (0 sound, 1 truncated, 2 must go).
_sym = np.arange(12)
_stay = np.where(_sym % 3 == 2, FAR, np.where(_sym % 3 == 1, 5, 0))
KEEP_COST = np.where(KEPT[_sym // 3] < 0, FAR, _stay[:, None])
KEEP_TO = np.maximum(KEPT[_sym // 3], 0)
REROLE_COST = np.minimum(_stay + 1, FAR)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with the faults that the checksum of (conv_id, turn) calls for, and ``order_by``, the original role and text."""
    d = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = d.withColumn("h", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.struct("role", "text").alias("order_by"), F.explode(copies).alias("copy")).drop("copy")


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Rows in order (``pos`` grows over all tasks, ``part`` is the task) with their faults and symbol."""
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    # Equal rows are told apart by number, so that many of them don't meet in one task.
    d = rows.withColumn("same", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "order_by", "same"]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    d = d.select(name.alias("conv"), "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"), F.spark_partition_id().alias("part"))
    d = d.withColumn("said", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    d = d.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    d = store.cut(d.withColumn("open", ~F.col("blank") & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")), "rows")
    # Partial minima; only what was said more than once goes back to the rows.
    again = d.filter("not blank").groupBy("conv", "said").agg(F.min("pos").alias("said_at"), F.count("*").alias("times")).filter("times > 1").drop("times")
    d = d.join(again, ["conv", "said"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("said_at"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    sym = initial * 3 + F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    return store.cut(d.withColumn("fault", fault).withColumn("sym", sym.cast("int")).drop("said", "blank", "open", "said_at"), "faults")


# --- costs ------------------------------------------------------------------------------


def _step(sym: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs before rows ``sym`` [n] from the costs behind them [n, ..., 4]."""
    wide = (len(sym),) + (1,) * (behind.ndim - 2)
    keep = KEEP_COST[sym].reshape(*wide, 4) + np.take_along_axis(behind, np.broadcast_to(KEEP_TO[sym].reshape(*wide, 4), behind.shape), -1)
    best = np.minimum(np.minimum(2 + behind, keep), REROLE_COST[sym].reshape(*wide, 1) + behind[..., MADE])
    for _ in range(2):  # a user and an assistant row at most are worth inserting
        best = np.minimum(best, 5 + best[..., MADE])
    return np.minimum(best, FAR)


def costs(sym: np.ndarray, start: np.ndarray, size: np.ndarray, leave: np.ndarray, each: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """Costs before every row (if ``each``) and before each stretch, given those behind the stretches; all stretches step by step together."""
    order = np.argsort(-size, kind="stable")
    now = leave[order].copy()
    before = np.full((len(sym), *leave.shape[1:]), FAR, np.int64) if each else None
    longest_first = size[order]
    for t in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-longest_first, -t, side="left"))
        at = (start + size - 1 - t)[order[:live]]
        now[:live] = _step(sym[at], now[:live])
        if before is not None:
            before[at] = now[:live]
    out = np.empty_like(now)
    out[order] = now
    return before, out


# --- paths ------------------------------------------------------------------------------


def least_paths(sym: np.ndarray, before: np.ndarray, behind: np.ndarray, entry: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, letters) of the least optimal path from each entry (row, state) to the end of ``before``'s rows.

    Node 4 * i + q reads row i next in state q; the last four have no arc. ``behind`` has the costs there.
    """
    n = len(sym)
    cost = np.concatenate([before, behind[None]])
    here, nxt = cost[:-1], cost[1:]
    q, row = np.arange(4), np.arange(n)[:, None]
    nodes = 4 * (n + 1)
    arcs = [
        (here == 2 + nxt, 4 * (row + 1) + q),
        (here == 5 + here[:, MADE], 4 * row + MADE),
        (here == KEEP_COST[sym] + np.take_along_axis(nxt, KEEP_TO[sym], 1), 4 * (row + 1) + KEEP_TO[sym]),
        (here == REROLE_COST[sym][:, None] + nxt[:, MADE], 4 * (row + 1) + MADE + 0 * row),
    ]
    tight = np.zeros((4, nodes), bool)
    to = np.tile(np.arange(nodes), (4, 1))
    for k, (ok, target) in enumerate(arcs):
        tight[k, : 4 * n] = (ok & (here < FAR)).ravel()
        to[k, : 4 * n] = np.broadcast_to(target, (n, 4)).ravel()
    letter = np.where(tight.any(0), tight.argmax(0), -1)
    node = np.arange(nodes)
    jump = [np.where(letter < 0, node, to[np.maximum(letter, 0), node])]
    rank = letter + 1  # behind the end stands nothing, which is least
    longest = max(1, 3 * n)
    while 1 << len(jump) <= longest:
        _, rank = np.unique(rank * (nodes + 5) + rank[jump[-1]], return_inverse=True)
        jump.append(jump[-1][jump[-1]])
    # The whole audits are ranked: a node takes the arc of least (letter, rank behind it).
    value = np.where(tight, np.arange(4)[:, None] * (nodes + 1) + rank[to], FAR)
    pick = np.where(tight.any(0), value.argmin(0), -1)
    jump[0] = np.where(pick < 0, node, to[np.maximum(pick, 0), node])
    for k in range(1, len(jump)):
        jump[k] = jump[k - 1][jump[k - 1]]
    out = []
    for i, state in entry:
        path = np.array([4 * i + state])
        for k in range(len(jump)):
            path = np.concatenate([path, jump[k][path]])
        path = path[: int(np.argmax(pick[path] < 0)) + 1]
        out.append((path, pick[path[:-1]]))
    return out


def _solve(sym: np.ndarray, before: np.ndarray, behind: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Per row: letter, state in which it is read, inserts before it and the state they begin in; then the state at the end."""
    n = len(sym)
    act, read, many, begin = (np.zeros(n, np.int32) for _ in range(4))
    for a in range(0, n, RANKED):
        b = min(n, a + RANKED)
        nodes, letters = least_paths(sym[a:b], before[a:b], before[b] if b < n else behind, [(0, state)])[0]
        row, at = nodes[:-1] // 4 + a, nodes[:-1] % 4
        moves = letters != 1
        act[row[moves]], read[row[moves]] = letters[moves], at[moves]
        many[a:b] = np.bincount(row[~moves] - a, minlength=b - a)
        first = np.flatnonzero(~moves)[::-1]
        begin[row[first]] = at[first]
        state = int(nodes[-1] % 4)
    return act, read, many, begin, state


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, starts, sizes) of the stretches of each ordering task, which are whole here."""
    held: list[pa.RecordBatch] = []

    def cut(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        conv = t["conv"].combine_chunks().dictionary_encode().indices.to_numpy()
        part = t["part"].to_numpy()
        first = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (part[1:] != part[:-1])))
        return t, first, np.diff(np.append(first, len(conv)))

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(batch.schema.get_field_index("part")).to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if held and held[-1].column(held[-1].schema.get_field_index("part"))[0].as_py() != int(part[a]):
                yield cut(held)
                held = []
            held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield cut(held)


STRETCH = "conv string, part int, m array<long>, first int, last int, n long, blank long, duplicate long, truncated long, illegal long"
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, start, size in _stretches(batches):
        sym = t["sym"].to_numpy()
        unit = np.where(np.eye(4, dtype=bool), 0, FAR)
        _, m = costs(sym, start, size, np.broadcast_to(unit, (len(start), 4, 4)), each=False)
        fault = np.array(t["fault"].to_pylist(), object)
        total = lambda x: pa.array(np.add.reduceat(x, start, dtype=np.int64))
        first = sym // 3
        wrong = np.append(False, ~_LEGAL[first[:-1], first[1:]])
        wrong[start] = False
        yield pa.RecordBatch.from_arrays(
            [t["conv"].take(pa.array(start)).combine_chunks(), t["part"].take(pa.array(start)).combine_chunks(), pa.array([x.ravel().tolist() for x in m], pa.list_(pa.int64())), pa.array(first[start].astype(np.int32)), pa.array(first[start + size - 1].astype(np.int32)), pa.array(size.astype(np.int64)), *(total(fault == x) for x in ("blank", "duplicate", "truncated")), total(wrong)],
            names=[x.split()[0] for x in STRETCH.split(", ")],
        )


COMBINED = "conv string, parts array<struct<part:int,leave:array<long>>>, cost long, blank long, duplicate long, truncated long, illegal long"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: costs behind each stretch, the whole cost and counts. A stretch is 16 numbers, one per task."""
    for batch in batches:
        out = []
        for conv, ss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ss.sort(key=lambda s: s["part"])
            leave, parts = END, []
            for s in reversed(ss):
                parts.append({"part": s["part"], "leave": leave.tolist()})
                leave = np.minimum((np.array(s["m"]).reshape(4, 4) + leave[:, None]).min(0), FAR)
            edges = sum(not _LEGAL[a["last"], b["first"]] for a, b in zip(ss[:-1], ss[1:], strict=True))
            out.append((conv, parts, int(leave[0]), *(sum(s[x] for s in ss) for x in ("blank", "duplicate", "truncated")), edges + sum(s["illegal"] for s in ss)))
        cols = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.string(), pa.list_(pa.struct([("part", pa.int32()), ("leave", pa.list_(pa.int64()))])), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv", "parts", "cost", "blank", "duplicate", "truncated", "illegal"])


def _leave(t: pa.Table, start: np.ndarray) -> np.ndarray:
    return np.array(t["leave"].take(pa.array(start)).to_pylist(), np.int64).reshape(-1, 4)


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per stretch of a conversation that spans several: the state at its exit for each at its entry."""
    for t, start, size in _stretches(batches):
        sym, leave = t["sym"].to_numpy(), _leave(t, start)
        before, _ = costs(sym, start, size, leave)
        out = [[_solve(sym[s : s + n], before[s : s + n], leave[i], q)[4] if before[s][q] < FAR else 0 for q in range(4)] for i, (s, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True))]
        yield pa.RecordBatch.from_arrays([t["conv"].take(pa.array(start)).combine_chunks(), t["part"].take(pa.array(start)).combine_chunks(), pa.array(out, pa.list_(pa.int32()))], names=["conv", "part", "go"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, ss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            state = 0
            for s in sorted(ss, key=lambda s: s["part"]):
                out.append((conv, s["part"], state))
                state = s["go"][state]
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32()), strict=True)], names=["conv", "part", "entry"])


EDIT = "pos long, act int, read int, many int, begin int, left int"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, start, size in _stretches(batches):
        sym, leave, entry = t["sym"].to_numpy(), _leave(t, start), t["entry"].to_numpy()
        before, _ = costs(sym, start, size, leave)
        got = [_solve(sym[s : s + n], before[s : s + n], leave[i], int(entry[s])) for i, (s, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True))]
        left = np.concatenate([np.full(len(g[0]), g[4], np.int32) for g in got])
        yield pa.RecordBatch.from_arrays([t["pos"].combine_chunks(), *(pa.array(np.concatenate([g[k] for g in got])) for k in range(4)), pa.array(left)], names=[x.split()[0] for x in EDIT.split(", ")])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, totals) for rows ``conv_id``, ``turn``, ``role``, ``text``, ``order_by``.

    Edits: the rows in order (``conv``, ``pos``) with ``act`` (place in ``LETTERS``), the state ``read`` in which the
    row is met, ``many`` inserts before it from state ``begin`` on, and ``left``, the state behind its stretch.
    Totals: per ``conv`` its cost and counts.
    """
    r = ordered_rows(rows)
    # As many tasks as the session has partitions: one row takes more time than its bytes tell.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = r.select("conv", "part", "pos", "sym", "fault")
    parts = s.repartition(tasks, "part").sortWithinPartitions("part", "pos").mapInArrow(_reduce, STRETCH)
    each = F.collect_list(F.struct("part", "m", "first", "last", "blank", "duplicate", "truncated", "illegal")).alias("s")
    totals = store.cut(parts.groupBy("conv").agg(each).mapInArrow(_combine, COMBINED), "combined")
    leave = totals.select("conv", F.explode("parts").alias("p"), (F.size("parts") > 1).alias("split")).select("conv", "p.part", "p.leave", "split")
    s = s.drop("fault").join(leave, ["conv", "part"])
    go = s.filter("split").repartition(tasks, "part").sortWithinPartitions("part", "pos").mapInArrow(_through, "conv string, part int, go array<int>")
    entry = go.groupBy("conv").agg(F.collect_list(F.struct("part", "go")).alias("s")).mapInArrow(_entries, "conv string, part int, entry int")
    s = s.join(entry, ["conv", "part"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    edits = s.repartition(tasks, "part").sortWithinPartitions("part", "pos").mapInArrow(_edits, EDIT)
    return r.join(edits, "pos"), totals.drop("parts")


DIGEST = "conv string, audit string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows; only the audit of the conversation at hand is held."""
    conv, audit, sha, some, left = None, [], hashlib.sha256(), False, 0

    def emit(role: str, text: str) -> None:
        nonlocal some
        sha.update((("\n" if some else "") + role + ":" + text).encode())
        some = True

    def insert(state: int, many: int) -> None:
        for _ in range(many):
            audit.append("I")
            emit("assistant" if state == 2 else "user", "")
            state = int(MADE[state])

    def close():
        insert(left, int(END[left]) // 5)
        return conv, "".join(audit), sha.hexdigest()

    for batch in batches:
        done = []
        d = batch.to_pydict()
        for c, role, text, act, read, many, begin, after in zip(*(d[x] for x in ("conv", "role", "text", "act", "read", "many", "begin", "left")), strict=True):
            if c != conv:
                if conv is not None:
                    done.append(close())
                conv, audit, sha, some = c, [], hashlib.sha256(), False
            insert(begin, many)
            audit.append(LETTERS[act])
            if act == 2:
                emit(role, text)
            elif act == 3:
                emit("assistant" if read == 2 else "user", text)
            left = after
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in range(3)], names=["conv", "audit", "repaired_sha256"])
    if conv is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in close()], names=["conv", "audit", "repaired_sha256"])


def summary(conversations: DataFrame) -> DataFrame:
    """One row per original conversation: gaps, faults, cost, audit and the digest of its repaired rows."""
    rows = damaged(conversations)
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv")
    edits, totals = repair(rows)
    digest = edits.select("conv", "pos", "role", "text", "act", "read", "many", "begin", "left").repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_digest, DIGEST)
    gaps = rows.groupBy(name).agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    all_ = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", name)
    d = all_.join(totals, "conv", "left").join(gaps, "conv", "left").join(digest, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return d.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired_rows(edits: DataFrame) -> DataFrame:
    """The rows that remain or come in, in order: ``conv``, ``pos``, ``step`` (inserts before a row come first), ``role``, ``text``.

    Inserts behind a conversation's last row follow from ``left`` and are not listed here.
    """
    role = lambda state: F.when(state == 2, "assistant").otherwise("user")
    made = F.transform(F.sequence(F.lit(1), F.col("many")), lambda i: F.struct(F.when(i == 1, role(F.col("begin"))).otherwise(F.when((F.col("begin") == 2) == (i % 2 == 1), "assistant").otherwise("user")).alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("act") == 2, F.array(F.struct("role", "text"))).when(F.col("act") == 3, F.array(F.struct(role(F.col("read")).alias("role"), "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return edits.select("conv", "pos", F.posexplode(F.concat(F.when(F.col("many") > 0, made).otherwise(F.array().cast("array<struct<role:string,text:string>>")), own)).alias("step", "x")).select("conv", "pos", "step", "x.role", "x.text")


@query("op12_structure_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(store.read(spark, sf_dir, "conversations"))
