"""The translation memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueflow.functions import keys as K
from cueflow.operators import memory
from cueflow.plans import views as V
from cueflow.plans.registry import query
from cueflow.plans.registry import quoted as q
from cueflow.plans.text_queries import _NORM, REASON, STRIP
from cueflow.session import memo

L1 = F.lit
_HASH = f"md5('l:' || lang || ':tr:' || {_NORM('source')})"
_USABLE = f"(NOT regexp_matches(target, '(?i)\\[\\s*(?:HATA|ÇEVİRİ\\s+EKSİK)') AND {STRIP('target')} <> '' AND lower({STRIP('source')}) <> lower({STRIP('target')}))"
V.add_view("batch", ["memory_pairs"], f"SELECT *, {_HASH} AS hash FROM memory_pairs")
V.add_view("stored_tm", ["batch"], f"""
SELECT hash, trim(source) AS source, trim(target) AS target, lang FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY file_id DESC, seq DESC) AS r,
  min(trim(target)) OVER (PARTITION BY hash) <> max(trim(target)) OVER (PARTITION BY hash) AS amb FROM batch) WHERE r = 1 AND NOT amb AND {_USABLE}""")
V.add_view("old_tm", ["batch"], "SELECT hash, min(source) AS source, 'old' AS target, min(lang) AS lang FROM batch WHERE file_id % 3 = 0 GROUP BY 1 UNION ALL SELECT 'gone', 'a', 'b', 'en'")


@memo
def batch(spark, sf):
    return V.memory_pairs(spark, sf).withColumn("hash", K.memory_key(F.col("source"), L1("tr"), F.concat(L1("l:"), F.col("lang"))))


@memo
def stored_tm(spark, sf):
    empty = batch(spark, sf).select("hash", "source", "target", "lang").limit(0)
    return memory.store(empty, batch(spark, sf), ["file_id", "seq"])


@query("A10_memory_store", V.with_views(["stored_tm", "old_tm"], """
SELECT * FROM stored_tm UNION ALL SELECT * FROM old_tm o WHERE NOT EXISTS (SELECT 1 FROM stored_tm s WHERE s.hash = o.hash)
 AND o.hash NOT IN (SELECT hash FROM batch GROUP BY 1 HAVING min(trim(target)) <> max(trim(target)))"""))
def a10(spark, sf):
    b = batch(spark, sf)
    old = b.filter("file_id % 3 = 0").groupBy("hash").agg(F.min("source").alias("source"), L1("old").alias("target"), F.min("lang").alias("lang"))
    old = old.unionByName(b.limit(1).select(L1("gone").alias("hash"), L1("a").alias("source"), L1("b").alias("target"), L1("en").alias("lang")))
    return memory.store(old, b, ["file_id", "seq"])


@query("A11_memory_stats", V.with_views("stored_tm", "SELECT lang, count(*) AS n FROM stored_tm GROUP BY 1"))
def a11(spark, sf):
    return stored_tm(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))


# Entries of an even length carry a model fingerprint, the others come from before settings.
_SET = f"CASE WHEN len(source) % 2 = 0 THEN 'm:x:' ELSE '' END"
V.add_view("tm", ["memory_pairs"], f"""
SELECT hash, source, target FROM (SELECT md5({_SET} || 'tr:' || {_NORM('source')}) AS hash, source, target, row_number() OVER (PARTITION BY md5({_SET} || 'tr:' || {_NORM('source')}) ORDER BY file_id DESC, seq DESC) AS r
 FROM memory_pairs) WHERE r = 1""")


@memo
def tm(spark, sf):
    m = V.memory_pairs(spark, sf)
    fp = F.when(F.length("source") % 2 == 0, "m:x").otherwise("")
    h = K.memory_key(F.col("source"), L1("tr"), fp)
    return m.groupBy(h.alias("hash")).agg(F.max_by(F.struct("source", "target"), F.struct("file_id", "seq")).alias("r")).select("hash", "r.source", "r.target")


@query("J6_memory_exact", V.with_views(["tm", "lines"], f"""
SELECT l.file_id, l.seq, coalesce(a.target, b.target) AS hit FROM (SELECT file_id, seq, CASE WHEN seq % 2 = 0 THEN translate(text, '{V.LOWER}', '{V.UPPER}') ELSE text END AS text FROM lines) l
 LEFT JOIN (SELECT * FROM tm WHERE {_USABLE}) a ON a.hash = md5('m:x:tr:' || {_NORM('l.text')}) LEFT JOIN (SELECT * FROM tm WHERE {_USABLE}) b ON b.hash = md5('tr:' || {_NORM('l.text')}) WHERE coalesce(a.target, b.target) IS NOT NULL"""))
def j6(spark, sf):
    s = V.lines(spark, sf).select("file_id", "seq", F.when(F.col("seq") % 2 == 0, V.caps(F.col("text"))).otherwise(F.col("text")).alias("text"))
    return memory.lookup(s, tm(spark, sf), "text", L1("tr"), L1("m:x"), legacy=True).filter("hit is not null").select("file_id", "seq", "hit")


# J7 and T8 ask for every entry, changed at its end; SQL has no matching-block ratio, a test compares them with a plain walk.
@query("J7_memory_similar")
def j7(spark, sf):
    m = V.memory_pairs(spark, sf)
    s = m.select("lang", F.concat("source", L1("!")).alias("text"))
    return memory.similar(s, m, "text", ["lang"]).select("lang", "norm", "uses", F.floor(F.col("ratio") * 1000000).cast("bigint").alias("ratio"))


@query("J8_reverse_coverage", V.with_views("memory_pairs", """
SELECT lang, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_targets, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous_targets FROM (SELECT lang, lower(target) AS t, count(DISTINCT source) AS n FROM memory_pairs GROUP BY 1, 2) GROUP BY 1"""))
def j8(spark, sf):
    return memory.reverse_coverage(V.memory_pairs(spark, sf).withColumn("target", F.lower("target")), ["lang"])


@query("T8_best_candidate")
def t8(spark, sf):
    m = V.memory_pairs(spark, sf)
    s = m.select("lang", F.concat("source", L1("!")).alias("text"))
    return memory.similar(s, m, "text", ["lang"]).select("lang", "norm", "target")
