"""The memory's upsert and its table in buckets."""

from pyspark.sql import functions as F

from cueflow.operators import memory
from cueflow.plans import streams_queries
from cueflow.streaming import jobs


def test_store_moves_old_and_new_rows_once(spark):
    schema = "hash string, source string, target string, lang string"
    old = spark.createDataFrame([("a", "s.", "t", "en"), ("b", "s.", "t", "en"), ("c", "s.", "t", "en"), ("c", "s2.", "t2", "en"), (None, "n.", "t", "en")], schema)
    new = spark.createDataFrame([("a", "s.", "neu", "en", 1), ("b", "s.", "x", "en", 1), ("b", "s.", "y", "en", 2), ("d", "s.", " d ", "en", 3), (None, "n.", "v", "en", 4), ("e", "s.", "", "en", 5)], schema + ", n long")
    out = memory.store(old, new, ["n"])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [("a", "s.", "neu", "en"), ("c", "s.", "t", "en"), ("c", "s2.", "t2", "en"), ("d", "s.", "d", "en"), (None, "n.", "t", "en"), (None, "n.", "v", "en")]))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_by_groups_drop_what_no_version_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "SLICE_ROWS", 300)
    schema = "hash string, source string, target string, lang string, n long"
    table = spark.createDataFrame([(f"{i % 900:04d}", f"s{i % 900}.", f"hedef {i}", "en", i) for i in range(1000)], schema)
    empty, root, want = table.drop("n").limit(0), str(tmp_path / "table"), None
    parts = [F.col("n") < 500, F.col("n") < 950]
    for s in streams_queries.arrivals(spark, table, *parts):
        got = jobs.memory_batches(s, empty, ["n"], root)
    want = empty
    for part in ("n < 500", "n >= 500 and n < 950", "n >= 950"):
        want = spark.createDataFrame(memory.store(want, table.filter(part), ["n"]).collect(), empty.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 900
    lists = {k: {tuple(r) for r in spark.read.parquet(f"{root}/list/v={k}").collect()} for k in range(3)}
    held = {(int(f.name[8:]), int(f.parent.name[2:])) for f in (tmp_path / "table" / "data").glob("v=*/_bucket=*")}
    assert held == lists[1] | lists[2] and lists[0] - held
