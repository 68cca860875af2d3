"""Journal and call log."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueflow.functions.timecode import format_ms
from cueflow.operators import journal, ordered
from cueflow.plans import views as V
from cueflow.plans.registry import query
from cueflow.session import memo, read_table

L1 = F.lit

V.add_view("chunks", ["calls"], """
SELECT event_id AS custom_id, user_id, ts_ms, model, 1 + event_id % 3 AS cue_sayisi, tokens AS giris_token, tokens * 2 AS cikis_token, CASE WHEN event_id % 13 = 0 THEN 'length' ELSE 'stop' END AS bitis_sebebi,
 CASE WHEN ok THEN '' ELSE 'x' END AS hata, md5(event_type) AS istem_sha, [event_id * 3 + j FOR j IN range(0, 1 + event_id % 3)] AS cues, event_type FROM calls""")


@memo
def chunks(spark, sf):
    c, e = V.calls(spark, sf), F.col("event_id")
    cues = F.transform(F.sequence(L1(0).cast("bigint"), e % 3), lambda j: F.struct((e * 3 + j).cast("string").alias("cue_id"), F.concat(L1("t"), (e * 3 + j).cast("string")).alias("ts")))
    return c.select(e.alias("custom_id"), "user_id", "ts_ms", "model", (1 + e % 3).alias("cue_sayisi"), F.col("tokens").alias("giris_token"), (F.col("tokens") * 2).alias("cikis_token"),
                    F.when(e % 13 == 0, "length").otherwise("stop").alias("bitis_sebebi"), F.when(F.col("ok"), "").otherwise("x").alias("hata"), F.md5("event_type").alias("istem_sha"), cues.alias("cue_zamanlari"), "event_type")


@query("J9_cue_to_chunk", V.with_views("chunks", "SELECT DISTINCT custom_id FROM (SELECT custom_id, unnest(cues) AS c FROM chunks) WHERE c % 50 = 0"))
def j9(spark, sf):
    c = chunks(spark, sf)
    wanted = read_table(spark, sf, "events").select(F.explode(F.array(*[F.col("event_id") * 3 + j for j in range(3)])).alias("n")).filter("n % 50 = 0").select(F.concat(L1("t"), F.col("n").cast("string")).alias("ts"))
    return journal.chunks_of(c, wanted, "ts").select("custom_id")


@query("J10_chunk_prompt", V.with_views("chunks", "SELECT custom_id, 'prompt ' || event_type AS istem FROM chunks"))
def j10(spark, sf):
    c = chunks(spark, sf)
    prompts = c.select("istem_sha", F.concat(L1("prompt "), F.col("event_type")).alias("istem")).distinct()
    # The dictionary is joined without a hint: Spark broadcasts it while its measured size allows.
    return c.join(prompts, "istem_sha", "left").select("custom_id", "istem")


@query("J11_old_new", V.with_views("chunks", """
SELECT custom_id, 't' || c AS ts, CASE WHEN c % 2 = 0 THEN 'old ' || c ELSE '' END AS eski, CASE WHEN c % 3 = 0 THEN ' old ' || c WHEN c % 5 = 0 THEN 'new' ELSE '' END AS yeni,
 trim(CASE WHEN c % 2 = 0 THEN 'old ' || c ELSE '' END) <> trim(CASE WHEN c % 3 = 0 THEN ' old ' || c WHEN c % 5 = 0 THEN 'new' ELSE '' END) AS degisti FROM (SELECT custom_id, unnest(cues) AS c FROM chunks)"""))
def j11(spark, sf):
    n = read_table(spark, sf, "events").select(F.explode(F.array(*[F.col("event_id") * 3 + j for j in range(3)])).alias("c"))
    s = F.col("c").cast("string")
    old = n.filter("c % 2 = 0").select(s.alias("cue_id"), F.concat(L1("old "), s).alias("text"))
    new = n.filter("c % 3 = 0 or c % 5 = 0").select(s.alias("cue_id"), F.when(F.col("c") % 3 == 0, F.concat(L1(" old "), s)).otherwise("new").alias("text"))
    return journal.compare(chunks(spark, sf), old, new).select("custom_id", "ts", "eski", "yeni", "degisti")


@query("A4_run_summary", V.with_views("chunks", """
SELECT user_id, count(*) AS chunk, CAST(sum(cue_sayisi) AS BIGINT) AS cue, CAST(sum(CASE WHEN hata <> '' THEN 1 ELSE 0 END) AS BIGINT) AS hatali, CAST(sum(CASE WHEN bitis_sebebi = 'length' THEN 1 ELSE 0 END) AS BIGINT) AS kesilen,
 CAST(sum(giris_token) AS BIGINT) AS giris_token, CAST(sum(cikis_token) AS BIGINT) AS cikis_token, string_agg(DISTINCT model, ',' ORDER BY model) AS modeller FROM chunks GROUP BY 1"""))
def a4(spark, sf):
    return journal.run_summary(chunks(spark, sf), "user_id")


V.add_view("pass_rows", ["calls"], "SELECT event_id, event_type AS pass_adi, event_id * 3 AS cue, ts_ms, tokens, CASE event_id % 4 WHEN 0 THEN 'uygulandi' WHEN 1 THEN 'reddedildi' WHEN 2 THEN 'rapor' ELSE 'belirsiz' END AS sonuc FROM calls WHERE event_id % 2 = 0 OR event_id % 3 = 0")


@memo
def pass_rows(spark, sf):
    c, e = V.calls(spark, sf).filter("event_id % 2 = 0 or event_id % 3 = 0"), F.col("event_id") % 4
    return c.select("event_id", F.col("event_type").alias("pass_adi"), (F.col("event_id") * 3).alias("cue"), "ts_ms", "tokens", F.when(e == 0, "uygulandi").when(e == 1, "reddedildi").when(e == 2, "rapor").otherwise("belirsiz").alias("sonuc"))


_PASS = "SELECT pass_adi, count(*) AS toplam, count(CASE WHEN sonuc = 'uygulandi' THEN 1 END) AS uygulandi, count(CASE WHEN sonuc = 'reddedildi' THEN 1 END) AS reddedildi, count(CASE WHEN sonuc = 'rapor' THEN 1 END) AS rapor FROM pass_rows GROUP BY 1"


@query("A5_pass_summary", V.with_views("pass_rows", _PASS))
def a5(spark, sf):
    return journal.pass_summary(pass_rows(spark, sf))


def efficiency(spark, sf):
    p = pass_rows(spark, sf)
    use = p.groupBy("pass_adi").agg(F.sum("tokens").alias("tokens"))
    j = journal.pass_summary(p).join(use, "pass_adi")
    return j.select("pass_adi", "tokens", F.expr("tokens div nullif(uygulandi, 0)").alias("per_applied"), F.expr("tokens div nullif(toplam, 0)").alias("per_suggestion"), (F.col("uygulandi") == 0).alias("no_effect"))


_EFF = f"SELECT pass_adi, CAST(t AS BIGINT) AS tokens, CAST(t // nullif(uygulandi, 0) AS BIGINT) AS per_applied, CAST(t // nullif(toplam, 0) AS BIGINT) AS per_suggestion, uygulandi = 0 AS no_effect FROM ({_PASS}) JOIN (SELECT pass_adi, sum(tokens) AS t FROM pass_rows GROUP BY 1) USING (pass_adi)"


@query("A30_pass_efficiency", V.with_views("pass_rows", _EFF))
def a30(spark, sf):
    return efficiency(spark, sf)


@query("T5_expensive_passes", V.with_views("pass_rows", f"SELECT pass_adi, tokens FROM ({_EFF}) ORDER BY tokens DESC, pass_adi"))
def t5(spark, sf):
    return efficiency(spark, sf).select("pass_adi", "tokens").orderBy(F.desc("tokens"), "pass_adi")


@query("W15_cue_history", V.with_views(["chunks", "pass_rows"], """
SELECT c AS cue, ts_ms, 'chunk' AS kind, custom_id AS ref FROM (SELECT custom_id, ts_ms, unnest(cues) AS c FROM chunks) UNION ALL SELECT cue, ts_ms, 'pass', event_id FROM pass_rows"""))
def w15(spark, sf):
    c = chunks(spark, sf).select("custom_id", "ts_ms", F.explode("cue_zamanlari").alias("c")).select(F.col("c.cue_id").cast("bigint").alias("cue"), "ts_ms", L1("chunk").alias("kind"), F.col("custom_id").alias("ref"))
    p = pass_rows(spark, sf).select("cue", "ts_ms", L1("pass").alias("kind"), F.col("event_id").alias("ref"))
    return c.unionByName(p).orderBy("cue", "ts_ms", "kind")


_RM = """count(*) AS attempts, count(CASE WHEN status < 400 THEN 1 END) AS successes, count(CASE WHEN status >= 400 THEN 1 END) AS failures, count(CASE WHEN status = 429 THEN 1 END) AS rate_limits,
 CAST(sum(CASE WHEN status < 400 THEN tokens ELSE 0 END) AS BIGINT) AS tokens, CAST(sum(dur_cs) AS BIGINT) AS duration_cs, CAST(arg_max(CASE WHEN status >= 400 THEN ts_ms + CASE WHEN status = 429 THEN 300000 ELSE 30000 END ELSE 0 END, call_no) AS BIGINT) AS cooldown_until"""


@query("A32_route_metrics", V.with_views("calls", f"SELECT route, {_RM} FROM calls GROUP BY 1"))
def a32(spark, sf):
    return journal.route_metrics(V.calls(spark, sf), ["route"])


@query("T9_route_ranking", V.with_views("calls", f"""
SELECT route, CAST(row_number() OVER (ORDER BY CASE WHEN route = (SELECT arg_max(route, call_no) FROM calls WHERE ok) THEN 0 ELSE 1 END, CASE WHEN route = 0 THEN 0 ELSE 1 END, -(successes * 1000000 // greatest(successes + failures, 1)), rate_limits, duration_cs // greatest(successes, 1), route) AS BIGINT) AS place FROM (SELECT route, {_RM} FROM calls GROUP BY 1)"""))
def t9(spark, sf):
    c = V.calls(spark, sf)
    m = journal.route_metrics(c, ["route"])
    last = c.filter("ok").agg(F.max_by("route", "call_no")).first()[0]
    order = [F.when(F.col("route") == L1(last), 0).otherwise(1), F.when(F.col("route") == 0, 0).otherwise(1), F.desc(F.expr("successes * 1000000 div greatest(successes + failures, 1)")), F.col("rate_limits"), F.expr("duration_cs div greatest(successes, 1)"), F.col("route")]
    return ordered.ranked(m, order, "place").select("route", "place")


_P = lambda p: f"min(CASE WHEN cum * 100 >= {p} * n THEN dur_cs END)"


@query("A41_latency_report", V.with_views("calls", f"""
SELECT event_type AS operation, max(n) AS attempts, max(f) AS failures, {_P(50)} AS p50, {_P(95)} AS p95, max(dur_cs) AS slowest FROM (
 SELECT event_type, dur_cs, count(*) OVER (PARTITION BY event_type) AS n, count(CASE WHEN NOT ok THEN 1 END) OVER (PARTITION BY event_type) AS f, count(*) OVER (PARTITION BY event_type ORDER BY dur_cs RANGE UNBOUNDED PRECEDING) AS cum FROM calls) GROUP BY 1"""))
def a41(spark, sf):
    # Exact percentiles from counts per value: a busy operation shrinks to its distinct
    # durations before any ordering, and those are accumulated block by block.
    h = V.calls(spark, sf).groupBy(F.col("event_type").alias("operation"), "dur_cs").agg(F.count("*").alias("c"), F.count_if(~F.col("ok")).alias("f"))
    h = ordered.running(h.withColumn("o", F.col("dur_cs") + 1), ["operation"], "o", {"cum": ("sum", F.col("c"), True)})
    n = h.groupBy("operation").agg(F.sum("c").alias("attempts"), F.sum("f").alias("failures"), F.max("dur_cs").alias("slowest"))
    at = lambda p: F.min(F.when(F.col("cum") * 100 >= p * F.col("attempts"), F.col("dur_cs")))
    return h.select("operation", "dur_cs", "cum").join(n, "operation").groupBy("operation", "attempts", "failures", "slowest").agg(at(50).alias("p50"), at(95).alias("p95"))


@query("A42_ledger_anomalies", V.with_views("calls", """
SELECT route, unnest(list_filter([CASE WHEN f * 100 > n * 20 THEN 'failure_ratio' END, CASE WHEN r * 100 > n * 4 THEN 'retry_pressure' END, CASE WHEN cached > 0 THEN 'cached_over_prompt' END, CASE WHEN total > 0 THEN 'total_mismatch' END, CASE WHEN unknown > 0 THEN 'unknown_price' END, CASE WHEN term > 0 THEN 'terminal_failures' END], lambda x: x IS NOT NULL)) AS issue FROM (
 SELECT route, count(*) AS n, count(CASE WHEN NOT ok THEN 1 END) AS f, count(CASE WHEN status = 429 THEN 1 END) AS r, count(CASE WHEN event_id % 997 = 0 THEN 1 END) AS cached, count(CASE WHEN event_id % 1009 = 5 THEN 1 END) AS total, count(CASE WHEN model = 'm9' THEN 1 END) AS unknown, count(CASE WHEN status = 401 THEN 1 END) AS term FROM calls GROUP BY 1)"""))
def a42(spark, sf):
    e = F.col("event_id")
    c = V.calls(spark, sf).withColumn("cached", F.when(e % 997 == 0, F.col("tokens") + 1).otherwise(0)).withColumn("total", F.col("tokens") * 3 + F.when(e % 1009 == 5, 1).otherwise(0))
    g = c.groupBy("route").agg(
        F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("f"), F.count_if(F.col("status") == 429).alias("r"), F.count_if(F.col("cached") > F.col("tokens")).alias("cp"),
        F.count_if(F.col("total") != F.col("tokens") * 3).alias("tm"), F.count_if(~F.col("model").isin("m0", "m1", "m2")).alias("up"), F.count_if(F.col("status") == 401).alias("tf"))
    rule = lambda cond, name: F.when(F.expr(cond), L1(name))
    issues = F.array(rule("f * 100 > n * 20", "failure_ratio"), rule("r * 100 > n * 4", "retry_pressure"), rule("cp > 0", "cached_over_prompt"), rule("tm > 0", "total_mismatch"), rule("up > 0", "unknown_price"), rule("tf > 0", "terminal_failures"))
    return g.select("route", F.explode(F.array_compact(issues)).alias("issue"))


@query("A43_stage_timing", V.with_views("calls", """
SELECT user_id, event_type AS stage, CAST(sum(nx - ts_ms) AS BIGINT) AS ms FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY user_id ORDER BY call_no) AS nx FROM calls) WHERE nx IS NOT NULL GROUP BY 1, 2"""))
def a43(spark, sf):
    c = ordered.dense_pos(V.calls(spark, sf).select("user_id", "event_type", "ts_ms", "call_no"), ["user_id"], "call_no")
    c = ordered.with_window(c, ["user_id"], "pos", {"nx": lambda w: F.lead("ts_ms").over(w)}, 0, 1).filter("nx is not null")
    return c.groupBy("user_id", F.col("event_type").alias("stage")).agg(F.sum(F.col("nx") - F.col("ts_ms")).alias("ms"))


V.add_view("runs", ["calls"], "SELECT user_id, user_id % 5 AS scope, max(ts_ms) AS mtime, CAST(sum(tokens) * 4000 AS BIGINT) AS bytes FROM calls GROUP BY 1")


def runs(spark, sf):
    return V.calls(spark, sf).groupBy("user_id", (F.col("user_id") % 5).alias("scope")).agg(F.max("ts_ms").alias("mtime"), (F.sum("tokens") * 4000).alias("bytes"))


@query("T2_runs_newest_first", V.with_views("runs", "SELECT user_id, mtime FROM runs ORDER BY mtime DESC, user_id"))
def t2(spark, sf):
    return runs(spark, sf).select("user_id", "mtime").orderBy(F.desc("mtime"), "user_id")


@query("W14_retention", V.with_views("runs", """
SELECT user_id, max(over) OVER (PARTITION BY scope ORDER BY i) = 0 AS kept FROM (SELECT *, CASE WHEN i > 20 OR (i > 1 AND b > 104857600) THEN 1 ELSE 0 END AS over FROM (
 SELECT *, row_number() OVER w AS i, sum(bytes) OVER w AS b FROM runs WINDOW w AS (PARTITION BY scope ORDER BY mtime DESC, user_id)))"""))
def w14(spark, sf):
    r = ordered.ranked(runs(spark, sf), [F.desc("mtime"), "user_id"], "o", ["scope"])
    return journal.retention(r, "scope", "o", "bytes").select("user_id", "kept")
