"""Streams over several triggers, next to the batch form."""

import random

from pyspark.sql import functions as F

from cueflow.operators import journal, memory
from cueflow.streaming import jobs

CALLS = "call_no long, ts_ms long, route long, model string, status long"


def feed(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_breaker_over_triggers(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i * 1000, rng.randrange(3), "m", rng.choice([200, 503, 503, 503, 429, 401])) for i in range(1, 400)]
    # Route 9 fails twice in the first file and for the third time in the second one.
    rows += [(1000, 90_500, 9, "m", 503), (1001, 120_500, 9, "m", 500), (1002, 150_500, 9, "m", 524), (1003, 290_500, 9, "m", 200)]
    rows.sort(key=lambda r: r[1])
    rows = [(i + 1, *r[1:]) for i, r in enumerate(rows)]
    files = [[r for r in rows if r[1] // 134_000 == k] for k in range(3)]
    for f in files:
        rng.shuffle(f)
    end = [(9999, 10**10, -1, "", 200)]
    path = feed(spark, str(tmp_path / "feed"), [*files, end], CALLS)
    stream = jobs.tail_parquet(spark, path, files_per_trigger=1).withColumn("ts", F.timestamp_millis("ts_ms"))
    with jobs.with_state_store(spark):
        out = jobs.run_append(jobs.breaker_stream(stream, "ts", "1 minute"), "breaker", str(tmp_path / "out"))
    got = sorted(tuple(r) for r in spark.read.schema(jobs.BREAKER_EVENTS).parquet(out).collect())
    batch = journal.breaker(spark.createDataFrame(rows, CALLS), ["route", "model"]).filter("event <> ''")
    want = sorted(tuple(r) for r in batch.select("route", "model", "call_no", "event", "open_until").collect())
    assert got == want and any(r[0] == 9 and r[3] == "open" for r in got)
    assert len([f for f in (tmp_path / "out-state" / "commits").iterdir() if f.name.isdigit()]) >= 4


def test_buckets_rewrite_only_what_a_batch_touches(spark, tmp_path):
    rows = [(f"{i:04d}", f"s{i}.", f"hedef {i}", "en", i) for i in range(3000)]
    late = [("0007", "s7.", "yeni hedef", "en", 9001), ("9999", "s.", "son hedef", "en", 9002), ("0008", "s8.", "a", "en", 9003), ("0008", "s8.", "b", "en", 9004)]
    schema = "hash string, source string, target string, lang string, n long"
    path = feed(spark, str(tmp_path / "feed"), [rows[:1500], rows[1500:], late], schema)
    root = str(tmp_path / "table")
    empty = spark.createDataFrame([], "hash string, source string, target string, lang string")
    got = jobs.memory_batches(jobs.tail_parquet(spark, path, files_per_trigger=1), empty, ["n"], root)
    want = empty
    for part in (rows[:1500], rows[1500:], late):
        want = spark.createDataFrame(memory.store(want, spark.createDataFrame(part, schema), ["n"]).collect(), empty.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    parts = [size(tmp_path / "table" / "data" / f"v={k}") for k in range(3)]
    assert 0 < parts[2] < sum(parts) / 5
    # The job goes on from its state and table.
    feed(spark, path, [[("0009", "s9.", "sonra", "en", 9005)]], schema)
    again = jobs.memory_batches(jobs.tail_parquet(spark, path, files_per_trigger=1), empty, ["n"], root)
    assert again.count() == got.count() and again.filter("hash = '0009'").first().target == "sonra"


def test_late_repeats_of_responses_are_dropped(spark, tmp_path):
    batches = [[(f"r{i % 40}", 1000 * i) for i in range(100)], [(f"r{i % 60}", 10_000_000 + 1000 * i) for i in range(100)], [(f"r{i % 70}", 20_000_000 + 1000 * i) for i in range(100)]]
    path = feed(spark, str(tmp_path / "feed"), batches, "k string, ms long")
    stream = jobs.tail_parquet(spark, path, files_per_trigger=1).withColumn("ts", F.timestamp_millis("ms"))
    out = jobs.new_responses(jobs.first_responses(stream, "ts", F.col("k"), "1 minute").select("request"), str(tmp_path / "out"))
    got = [r.request for r in spark.read.schema("request string").option("recursiveFileLookup", "true").parquet(out).collect()]
    assert len(got) == len(set(got)) == 70


def test_windows_close_and_leave_the_state(spark, tmp_path):
    calls = [(i, i * 60_000, i % 3, "m", 200 if i % 4 else 503, True, 5, 7, i % 9) for i in range(200)]
    end = [(999, 10**10, -1, "", 200, True, 0, 0, -1)]
    schema = "call_no long, ts_ms long, route long, model string, status long, ok boolean, dur_cs long, tokens long, user_id long"
    path = feed(spark, str(tmp_path / "feed"), [calls[:70], calls[70:140], calls[140:], end], schema)
    stream = jobs.tail_parquet(spark, path, files_per_trigger=1).withColumn("ts", F.timestamp_millis("ts_ms"))
    health = jobs.route_health(stream, "ts")
    got = spark.read.schema(health.schema).parquet(jobs.run_append(health, "health", str(tmp_path / "health"))).withColumn("w", F.unix_millis("window.start")).drop("window")
    want = journal.route_metrics(spark.createDataFrame(calls, schema).withColumn("w", F.expr("ts_ms div 600000 * 600000")), ["w", "route"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    s = jobs.sessions(stream, "ts", ["user_id"], gap="5 minutes")
    got = spark.read.schema(s.schema).parquet(jobs.run_append(s, "sessions", str(tmp_path / "sessions")))
    assert got.agg(F.sum("n")).first()[0] == 200 and got.count() == 200
