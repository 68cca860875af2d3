"""Long lines, many files and what may move between tasks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cueflow.operators import findings, ordered, sequence
from cueflow.plans import views
from cueflow.session import cut

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_cue_fill_takes_long_lines(spark):
    words = " ".join(["word"] * 600)
    c = spark.createDataFrame([(1, 1, 1000, words), (1, 2, 1000, words)], "file_id long, pos long, dur_ms long, text string")
    assert sequence.rebalance(c, "text").collect() == []


def test_rebreak_long_lines(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab é") for _ in range(n)).strip() for n in (1, 41, 43, 80, 300)] + ["x" * 60, "ab " * 40000 + "c"]

    def plain(v):
        spaces = [i for i, ch in enumerate(v, 1) if ch == " "]
        if len(v) <= 42 or not spaces:
            return v
        _, i = min((max(i - 1, len(v) - i), i) for i in spaces)
        return v[:i - 1] + "\n" + v[i:]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", sequence.rebreak(F.col("t")).alias("b")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_prefix_sums(spark):
    for n in (0, 1, 2, 3, 6, 7, 50):
        a = [(i * 37) % 11 - 3 for i in range(n)]
        got = spark.createDataFrame([(a,)], "a array<bigint>").select(ordered.prefix_sums(F.col("a"), 3)).collect()[0][0]
        assert got == [sum(a[:i + 1]) for i in range(n)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_cues_need_no_shuffle(spark):
    made = views.timed.__wrapped__.__wrapped__(spark, SF)
    assert "hashpartitioning" not in plan(made)[1] and "Window" not in plan(made)[0]


def test_neighbour_rules_move_what_they_read(spark):
    p = spark.createDataFrame([(1, 1, 5, "a", "b"), (1, 2, 5, "c", "d")], "file_id long, pos long, no long, src string, tgt string")
    df = findings.by_neighbour(p, ["non_monotonic_cue"])
    assert [(r["class"], r.pos) for r in df.collect()] == [("non_monotonic_cue", 2)]
    exchange = [x for x in plan(df)[1].split("\n") if "Project" in x or "Scan" in x]
    assert not any("n_src" in x or "p_tgt" in x for x in exchange)


def test_srt_table_has_no_file_per_subtitle(spark, tmp_path):
    from cueflow.sources import subtitles, tables

    rows = [(f, p, p, p * 1000, p * 1000 + 500, f"t{f}.{p}") for f in range(200) for p in range(1, 8)]
    c = spark.createDataFrame(rows, "file_id long, pos long, cue_no long, start_ms long, end_ms long, text string").repartition(4)
    tables.write_srt(c, "file_id", str(tmp_path / "srt"), part=3)
    assert sum(len(f) for _, _, f in os.walk(tmp_path)) < 50
    back = spark.read.parquet(str(tmp_path / "srt"))
    whole = back.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), "").alias("content"))
    got = {(r.file_id, r.pos, r.cue_no, r.start_ms, r.end_ms, r.text) for r in subtitles.parse_srt(whole, "file_id", "content").collect()}
    assert got == set(rows)


def test_arrivals_are_written_by_all_tasks(spark, monkeypatch):
    from cueflow.plans import streams_queries

    paths = []
    monkeypatch.setattr(streams_queries.jobs, "tail_parquet", lambda spark, path: paths.append((path, len(spark.read.parquet(path).inputFiles()))))
    list(streams_queries.arrivals(spark, spark.range(0, 1000, 1, 4), F.col("id") % 2 == 0))
    assert [n for _, n in paths] == [4, 8] and spark.read.parquet(paths[0][0]).count() == 1000


def test_breaker_sets_one_timer_for_a_batch():
    import pandas as pd
    from types import SimpleNamespace

    from cueflow.streaming.jobs import BreakerState

    timers, kept = [], []
    p = BreakerState()
    p.handle, p.waiting = SimpleNamespace(registerTimer=timers.append), SimpleNamespace(appendList=kept.extend)
    frames = [pd.DataFrame({"call_no": [i], "ts_ms": [100 - i], "status": [503]}) for i in range(5)]
    assert list(p.handleInputRows(("r", "m"), iter(frames), None)) == []
    assert timers == [101] and len(kept) == 5


def moved(monkeypatch, module):
    """Columns of the tables that an operator writes on its way."""
    seen, write = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, name="cut": seen.append(df.columns) or write(df, name))
    return seen


CUES = "file_id long, pos long, start_ms long, end_ms long, text string, src string"


def test_chunks_move_no_texts(spark, monkeypatch):
    c = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 900, "Line.", "Line.") for i in range(1, 12)], CUES)
    seen = moved(monkeypatch, sequence)
    got = sequence.chunks(c, "text", target=4, reach=9)
    assert {"text", "src", "frag", "scene", "chunk"} <= set(got.columns) and got.count() == 11
    assert seen and not any("text" in cols for cols in seen)


def test_merges_move_no_texts(spark, monkeypatch):
    c = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 1000, "x" * 30, "open") for i in range(1, 8)], CUES)
    seen = moved(monkeypatch, sequence)
    assert sorted(r.parts for r in sequence.merge_fragments(c, "src", "text").collect()) == [1, 2, 2, 2]
    assert seen and not any("text" in cols for cols in seen)


def test_walks_share_a_call(spark):
    jump = [(k, p, p + 1 + (p * 7 + k) % 3) for k in range(40) for p in range(1, 30)]
    df = spark.createDataFrame(jump, "k long, pos long, n long")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, 7)
    try:
        starts = ordered.greedy_starts(df, "k", "pos", "n", 3, block=16, fan=2)
        got = {(r.k, r.pos) for r in starts.collect()}
    finally:
        spark.conf.unset(size)
    want = set()
    for k in range(40):
        p = 1
        while p < 30:
            want.add((k, p))
            p += 1 + (p * 7 + k) % 3
    assert got == want
    assert "MapInPandas" in plan(starts)[0].split("FlatMapGroupsInPandas")[0]


def test_gaps_move_no_texts(spark, monkeypatch):
    from cueflow.operators import align

    c = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 900, t, "") for i, t in enumerate(["One.", "[MUSIC PLAYING]", "Two."], 1)], CUES)
    seen = moved(monkeypatch, align)
    got = align.dialogue_gaps(c, c.filter("pos > 2"))
    assert sorted((r.pos, r["class"]) for r in got.collect()) == [(1, "missing_dialogue"), (2, "expected_removed")]
    assert len(seen) == 2 and not any("text" in cols for cols in seen)


def test_inflected_misses_try_the_plain_form_first(spark):
    from cueflow.operators import canon

    p = spark.createDataFrame([(1, "the garden", "bahçelerde"), (2, "the garden", "evde")], "i int, src string, tgt string")
    g = spark.createDataFrame([("garden", "bahçe")], "term string, rendering string")
    miss = canon.glossary_misses(p, g, inflected=True)
    assert [r.i for r in miss.collect()] == [2]
    where = next(x for x in plan(miss)[0].split("\n") if "exists" in x)
    assert where.lower().index("contains(") < where.index("exists(")


def test_written_tables_are_packed_tightly(spark):
    d = cut(spark.range(9))
    assert d.count() == 9 and all(p.endswith(".zstd.parquet") for p in d.inputFiles())
