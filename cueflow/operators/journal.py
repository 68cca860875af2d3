"""Run journal: chunk and pass records, history, retention, provider calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.functions import text as T
from cueflow.operators import ordered

# Circuit and cool-down rules of provider calls.
FAILURES_TO_OPEN = 3
OPEN_MS = 60_000
RATE_LIMIT_MS, TRANSIENT_MS = 300_000, 30_000
TRANSIENT = (408, 500, 502, 503, 504, 524, 529)


def chunks_of(chunks: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """Chunks that hold a wanted cue, each once; ``on`` is ``ts`` or ``cue_id``."""
    cues = chunks.select("custom_id", F.explode("cue_zamanlari").alias("c")).select("custom_id", F.trim(f"c.{on}").alias(on))
    hit = cues.join(wanted.select(on).distinct(), on, "left_semi").select("custom_id").distinct()
    return chunks.join(hit, "custom_id", "left_semi")


def compare(chunks: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new text per cue of the chunks, keyed by time; a missing text is empty."""
    c = chunks.select("custom_id", F.explode("cue_zamanlari").alias("c")).select("custom_id", "c.cue_id", "c.ts")
    j = c.join(old.withColumnRenamed("text", "eski"), "cue_id", "left").join(new.withColumnRenamed("text", "yeni"), "cue_id", "left").fillna("", ["eski", "yeni"])
    return j.withColumn("degisti", T.strip(F.col("eski")) != T.strip(F.col("yeni")))


def run_summary(chunks: DataFrame, run: str) -> DataFrame:
    """Counts per run. Sources and models are few names: distinct pairs first, then a sorted list."""
    n = chunks.groupBy(run).agg(
        F.count("*").alias("chunk"), F.sum("cue_sayisi").alias("cue"), F.count_if(F.coalesce("hata", F.lit("")) != "").alias("hatali"),
        F.count_if(F.col("bitis_sebebi") == "length").alias("kesilen"), F.sum("giris_token").alias("giris_token"), F.sum("cikis_token").alias("cikis_token"))
    names = chunks.select(run, F.coalesce("model", F.lit("")).alias("m")).distinct().groupBy(run).agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("modeller"))
    return n.join(names, run)


def pass_summary(passes: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("sonuc") == v)
    return passes.groupBy("pass_adi").agg(F.count("*").alias("toplam"), n("uygulandi").alias("uygulandi"), n("reddedildi").alias("reddedildi"), n("rapor").alias("rapor"))


def retention(runs: DataFrame, scope: str, order: str, size: str, keep: int = 20, cap: int = 100 * 1024 * 1024) -> DataFrame:
    """Adds ``kept``. ``order`` is a unique integer, 1 for the newest run of a scope.

    The newest run always stays; from the first one that exceeds a limit everything goes.
    """
    r = ordered.running(runs, [scope], order, {"_n": ("sum", F.lit(1).cast("bigint"), True), "_b": ("sum", F.col(size), True)})
    over = (F.col("_n") > keep) | ((F.col("_n") > 1) & (F.col("_b") > cap))
    r = ordered.running(r.withColumn("_over", over.cast("int")), [scope], order, {"_m": ("max", F.col("_over"), True)})
    return r.withColumn("kept", F.col("_m") == 0).drop("_n", "_b", "_over", "_m")


def outcome(status: Column) -> Column:
    """ok / rate_limit / transient / permanent of a call status."""
    return F.when(status < 400, "ok").when(status == 429, "rate_limit").when(status.isin(*TRANSIENT), "transient").otherwise("permanent")


def breaker(calls: DataFrame, keys: list[str], block: int | None = None) -> DataFrame:
    """Circuit state after each call: failures in a row, open_until, and the event.

    Success, a rate limit and a permanent error clear the state, so a run of transient
    failures starts at the last clear. Counting needs two cumulative columns: the number of
    transients, and its value at the last clear, which is a running maximum. A route that
    makes a third of all calls is thereby cut into blocks like any other group.
    """
    c = calls.withColumn("outcome", outcome(F.col("status")))
    hit = F.col("outcome") == "transient"
    c = ordered.running(c, keys, "call_no", {"_t": ("sum", hit.cast("bigint"), True)}, block)
    c = ordered.running(c, keys, "call_no", {"_base": ("max", F.when(~hit, F.col("_t")), True), "_prev": ("max", F.when(~hit, F.col("_t")), False)}, block)
    n = F.when(hit, F.col("_t") - F.coalesce("_base", F.lit(0))).otherwise(0)
    before = F.col("_t") - hit.cast("bigint") - F.coalesce("_prev", F.lit(0))
    event = (
        F.when(hit & (n == FAILURES_TO_OPEN), "open").when(hit & (n > FAILURES_TO_OPEN), "reopen")
        .when((F.col("outcome") == "ok") & (before >= FAILURES_TO_OPEN), "recovered").otherwise("")
    )
    return c.withColumn("failures", n.cast("bigint")).withColumn("open_until", F.when(n >= FAILURES_TO_OPEN, F.col("ts_ms") + OPEN_MS)).withColumn("event", event).drop("_t", "_base", "_prev")


def cooldown(calls: DataFrame, keys: list[str], wait_ms: Column) -> DataFrame:
    """``until`` after each call: the latest end of any rate-limit wait so far."""
    c = calls.withColumn("_u", F.when(F.col("status") == 429, F.col("ts_ms") + wait_ms))
    return ordered.running(c, keys, "call_no", {"until": ("max", F.col("_u"), True)}).drop("_u")


def route_metrics(calls: DataFrame, keys: list) -> DataFrame:
    ok = F.col("status") < 400
    wait = F.when(~ok, F.col("ts_ms") + F.when(F.col("status") == 429, RATE_LIMIT_MS).otherwise(TRANSIENT_MS)).otherwise(0)
    g = calls.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.count_if(F.col("status") == 429).alias("rate_limits"),
        F.sum(F.when(ok, F.col("tokens")).otherwise(0)).alias("tokens"), F.sum("dur_cs").alias("duration_cs"), F.max_by(wait, "call_no").cast("bigint").alias("cooldown_until"))
    return g
