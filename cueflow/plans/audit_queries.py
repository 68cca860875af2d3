"""Shares, gates and corpus checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueflow.functions import guards as G
from cueflow.functions import keys as K
from cueflow.functions import labels as L
from cueflow.functions import text as T
from cueflow.functions import turkish as TR
from cueflow.operators import audit
from cueflow.plans import views as V
from cueflow.plans.registry import query
from cueflow.plans.registry import quoted as q
from cueflow.plans.sequence_queries import _BUCKET, worded_cues
from cueflow.plans.text_queries import _CHARS, _LET, STRIP, VISIBLE, paths, series, term_pairs
from cueflow.session import read_table

L1 = F.lit
_MOJI = "replace(replace(text, 'é', 'Ã©'), 'ü', 'Ã¼')"


@query("A1_source_precheck", V.with_views("lines", f"""
SELECT file_id, 'noktalama' AS kind, 'uyari' AS level, ends * 100 // n AS measure FROM (SELECT file_id, count(*) AS n, sum(CASE WHEN regexp_matches(p, {q(T.LINE_END)}) THEN 1 ELSE 0 END) AS ends
 FROM (SELECT file_id, CASE WHEN file_id % 2 = 0 THEN regexp_replace(text, '[.!?…:;"''”’)\\]]+\\s*$', '') ELSE text END AS p FROM lines) GROUP BY 1) WHERE n >= 10 AND ends * 100 < 30 * n
UNION ALL SELECT file_id, 'kodlama', 'kritik', CAST(sum(len(regexp_extract_all({_MOJI}, {q(T.MOJIBAKE)}))) AS BIGINT) FROM lines GROUP BY 1 HAVING sum(len(regexp_extract_all({_MOJI}, {q(T.MOJIBAKE)}))) >= 10""").replace("ends * 100 // n AS measure", "CAST(ends * 100 // n AS BIGINT) AS measure"))
def a1(spark, sf):
    c = V.lines(spark, sf)
    p = F.when(F.col("file_id") % 2 == 0, F.regexp_replace("text", r"[.!?…:;\"'”’)\]]+\s*$", "")).otherwise(F.col("text"))
    raw = F.replace(F.replace(F.col("text"), L1("é"), L1("Ã©")), L1("ü"), L1("Ã¼"))
    # The given documents are short: the check starts at 10 cues here, 40 by default.
    return audit.precheck(c.select("file_id", p.alias("text"), raw.alias("raw")), "file_id", "text", "raw", min_cues=10)


@query("A2_caps_gate", V.with_views("caps_files", "SELECT file_id, eligible, caps, eligible >= 8 AND caps * 100 <= eligible * 60 AS allow FROM caps_files"))
def a2(spark, sf):
    return audit.caps_gate(caps_input(spark, sf), "file_id", "s")


def caps_input(spark, sf):
    return V.pairs(spark, sf).select("file_id", F.when(F.col("file_id") % 10 == 0, V.caps(F.col("src"))).otherwise(F.col("src")).alias("s"))


@query("A3_caps_ratio", V.with_views("caps_files", "SELECT caps * 100 >= eligible * 80 AS caps_file, count(*) AS files, CAST(sum(caps) AS BIGINT) AS caps FROM caps_files GROUP BY 1"))
def a3(spark, sf):
    s = audit.caps_share(caps_input(spark, sf), "file_id", "s")
    return s.groupBy((F.col("caps") * 100 >= F.col("eligible") * 80).alias("caps_file")).agg(F.count("*").alias("files"), F.sum("caps").alias("caps"))


V.add_view("two_line", ["pairs"], "SELECT file_id, CASE WHEN seq % 3 = 0 THEN left(tgt, 40) || chr(10) || substr(tgt, 41) || chr(10) || 'x' ELSE tgt END AS t FROM pairs")
_VL = lambda x: f"len({VISIBLE(x)})"


@query("A6_line_metrics", V.with_views("two_line", f"""
SELECT file_id, count(*) AS cues, CAST(sum(CASE WHEN len(l) > 2 THEN 1 ELSE 0 END) AS BIGINT) AS over_2_lines, CAST(sum(len(list_filter(l, lambda x: {_VL('x')} > 42))) AS BIGINT) AS over_42_lines,
 CAST(sum(len(list_filter(l, lambda x: {_VL('x')} = 1))) AS BIGINT) AS one_char_lines, CAST(sum(CASE WHEN regexp_matches(t, '[<{{]') AND len(list_filter(l, lambda x: {_VL('x')} > 42)) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS tagged_over_42,
 CAST(sum(CASE WHEN len(list_filter(l, lambda x: {_VL('x')} > 42 AND NOT regexp_matches(x, '\\S\\s+\\S'))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS long_single_word
FROM (SELECT *, string_split(t, chr(10)) AS l FROM two_line) GROUP BY 1"""))
def a6(spark, sf):
    t = F.col("tgt")
    text = F.when(F.col("seq") % 3 == 0, F.concat(F.substring(t, 1, 40), L1("\n"), F.substring(t, 41, 1 << 30), L1("\nx"))).otherwise(t)
    return audit.line_metrics(V.pairs(spark, sf).select("file_id", text.alias("t")), "file_id", "t")


@query("A7_histograms", V.with_views("cues", f"""
SELECT 'cps' AS measure, {_BUCKET(f'({_CHARS} * 1000000 // dur_ms)', (12000, 17000, 21000, 24000, 30000))} AS bucket, count(*) AS n FROM cues WHERE NOT regexp_matches(tgt, {q(T.FAILURE)}) GROUP BY 2
UNION ALL SELECT 'chars', {_BUCKET('len(text)', (42, 84, 160, 320))}, count(*) FROM cues GROUP BY 2
UNION ALL SELECT 'width', {_BUCKET("list_max(list_transform(string_split(src, chr(10)), lambda x: len(x)))", (42, 60, 84, 160))}, count(*) FROM cues GROUP BY 2"""))
def a7(spark, sf):
    c = V.cues(spark, sf)
    cps = audit.reading_speed(c, "tgt").select(L1("cps").alias("measure"), audit.bucket(F.expr("chars * 1000000 div dur_ms"), (12000, 17000, 21000, 24000, 30000)).alias("bucket"))
    width = F.array_max(F.transform(F.split("src", "\n"), F.length))
    # The two text measures come from one scan, one row per measure.
    two = c.select(F.explode(F.array(
        F.struct(L1("chars").alias("measure"), audit.bucket(F.length("text"), (42, 84, 160, 320)).alias("bucket")),
        F.struct(L1("width").alias("measure"), audit.bucket(width, (42, 60, 84, 160)).alias("bucket")))).alias("m")).select("m.*")
    return cps.unionByName(two).groupBy("measure", "bucket").agg(F.count("*").alias("n"))


_TYPO = "…“”‘’«»–—♪-\"'"


@query("A8_typography_counts", V.with_views("pairs", f"""
SELECT side, ch, count(*) AS n FROM (SELECT 'source' AS side, unnest(regexp_extract_all(src, '[{_TYPO.replace("'", "''")}]')) AS ch FROM pairs UNION ALL SELECT 'target', unnest(regexp_extract_all(tgt, '[{_TYPO.replace("'", "''")}]')) FROM pairs) GROUP BY 1, 2""").replace("–—♪-", "–—♪\\-"))
def a8(spark, sf):
    found = lambda side, c: F.transform(F.regexp_extract_all(F.col(c), L1("[" + _TYPO.replace("-", "\\-") + "]"), L1(0)), lambda ch: F.struct(L1(side).alias("side"), ch.alias("ch")))
    return V.pairs(spark, sf).select(F.explode(F.concat(found("source", "src"), found("target", "tgt"))).alias("c")).groupBy("c.side", "c.ch").agg(F.count("*").alias("n"))


@query("A18_review_scoring", """
SELECT variant, CAST(round(1000 * sum(fidelity) / count(*)) AS BIGINT) AS fidelity_milli, CAST(round(1000 * sum(natural_) / count(*)) AS BIGINT) AS naturalness_milli, CAST(sum(win) AS BIGINT) AS wins FROM (
 SELECT CASE WHEN b = 1 THEN 'enhanced' ELSE 'current' END AS variant, 1 + doc_id % 5 AS fidelity, 1 + doc_id * 3 % 5 AS natural_, quality AS win FROM (SELECT *, ('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 2))::INT % 2 AS b FROM labels)
 UNION ALL SELECT CASE WHEN b = 0 THEN 'enhanced' ELSE 'current' END, 1 + doc_id % 3, 1 + doc_id % 4, 1 - quality FROM (SELECT *, ('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 2))::INT % 2 AS b FROM labels)) GROUP BY 1""")
def a18(spark, sf):
    l = read_table(spark, sf, "labels").withColumn("b", F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2), 16, 10).cast("int") % 2)
    i = F.col("doc_id")
    side = lambda on, fid, nat, win: F.struct(F.when(F.col("b") == on, "enhanced").otherwise("current").alias("variant"), fid.alias("fidelity"), nat.alias("natural"), win.cast("bigint").alias("win"))
    rows = l.select(F.explode(F.array(side(1, 1 + i % 5, 1 + i * 3 % 5, F.col("quality")), side(0, 1 + i % 3, 1 + i % 4, 1 - F.col("quality")))).alias("r")).select("r.*")
    mean = lambda c: F.round(1000 * F.sum(c) / F.count("*")).cast("bigint")
    return rows.groupBy("variant").agg(mean("fidelity").alias("fidelity_milli"), mean("natural").alias("naturalness_milli"), F.sum("win").alias("wins"))


@query("A19_corpus_validation", """
SELECT lang AS kind, count(*) AS n, count(*) - count(DISTINCT doc_id) AS repeated_ids, CAST(sum(CASE WHEN text IS NULL OR trim(text) = '' OR source IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS incomplete FROM documents GROUP BY 1""")
def a19(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.groupBy(F.col("lang").alias("kind")).agg(
        F.count("*").alias("n"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated_ids"),
        F.count_if(F.col("text").isNull() | (F.trim("text") == "") | F.col("source").isNull()).alias("incomplete"))


V.add_view("addressed", ["pairs"], "SELECT file_id, CASE h % 5 WHEN 0 THEN tgt || ' geliyorsun' WHEN 1 THEN tgt || ' geliyorsunuz' WHEN 2 THEN tgt || ' kadın' ELSE tgt END AS t, h FROM pairs")


@query("A21_register_mix", V.with_views("addressed", """
SELECT *, informal + formal >= 4 AND informal > 0 AND formal > 0 AS mixed FROM (SELECT file_id, CAST(sum(CASE WHEN i > 0 THEN 1 ELSE 0 END) AS BIGINT) AS informal, CAST(sum(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS BIGINT) AS formal FROM (
 SELECT file_id, len(list_filter(k, lambda x: regexp_matches(x, '(?:s[ıiuü]n|[dt][ıiuü]n|s[ae]n)[ıiuü]z$|^siz(?:i|e|in|den|de)?$'))) AS f,
  len(list_filter(k, lambda x: regexp_matches(x, '^(?:sen|seni|sana|senin|sende|senden)$') OR (x NOT IN (""" + ", ".join(q(w) for w in TR.FALSE_STEMS) + """) AND regexp_matches(x, """ + q(TR.SECOND_PERSON) + """)))) AS i
 FROM (SELECT file_id, regexp_extract_all(lower(t), '\\p{L}+') AS k FROM addressed)) GROUP BY 1)"""))
def a21(spark, sf):
    p, k = V.pairs(spark, sf), F.col("h") % 5
    word = F.when(k == 0, " geliyorsun").when(k == 1, " geliyorsunuz").when(k == 2, " kadın").otherwise("")
    return audit.register_mix(p.select("file_id", F.concat("tgt", word).alias("t")), "file_id", "t", least=4)


V.add_view("cap_terms", ["lines"], r"""
SELECT file_id, tok AS term, CASE WHEN file_id % 3 = 0 THEN 'Xo' || tok ELSE translate(tok, 'aeiouAEIOU', 'eiouaEIOUA') END AS rendering FROM (SELECT file_id, unnest(regexp_extract_all(text, '\p{Ll}[,]? (\p{Lu}\p{Ll}{3,})', 1)) AS tok FROM lines)""")


@query("A22_mixed_renderings", V.with_views("cap_terms", """
SELECT term, CAST(sum(n) AS BIGINT) AS total, count(*) AS renderings FROM (SELECT term, lower(rendering) AS stem, count(*) AS n FROM cap_terms GROUP BY 1, 2) GROUP BY 1
HAVING sum(n) >= 4 AND count(CASE WHEN n >= 2 THEN 1 END) > 1"""))
def a22(spark, sf):
    cap = r"\p{Ll}[,]? (\p{Lu}\p{Ll}{3,})"
    terms = V.lines(spark, sf).select("file_id", F.explode(F.regexp_extract_all("text", L1(cap), L1(1))).alias("term"))
    rendered = F.when(F.col("file_id") % 3 == 0, F.concat(L1("Xo"), F.col("term"))).otherwise(F.translate("term", V.VOWELS, V.SHIFTED))
    return audit.mixed_renderings(terms.select("term", rendered.alias("rendering")), least=4)


@query("A23_script_ratio", """
SELECT doc_id, nonlatin * 100 // letters AS nonlatin_pct, CASE WHEN cyr_up * 10 > cyr * 9 AND vowels * 100 < cyr * 35 AND cyr >= 5 THEN 'suspect' ELSE 'ok' END AS state FROM (
 SELECT doc_id, len(regexp_extract_all(t, '\\p{L}')) AS letters, len(regexp_extract_all(t, '[\\p{Cyrillic}\\p{Greek}]')) AS nonlatin, len(regexp_extract_all(t, '\\p{Cyrillic}')) AS cyr,
  len(regexp_extract_all(t, '[А-ЯЁ]')) AS cyr_up, len(regexp_extract_all(t, '[АЕИОУЫЭЮЯаеиоуыэюя]')) AS vowels
 FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN repeat('ГДЖЗ', 40) WHEN 1 THEN repeat('мама', 40) ELSE '' END AS t FROM documents)) WHERE letters >= 20""".replace("\\\\p", "\\p"))
def a23(spark, sf):
    k = F.col("doc_id") % 4
    t = F.concat("text", F.when(k == 0, "ГДЖЗ" * 40).when(k == 1, "мама" * 40).otherwise(""))
    return audit.script_ratio(read_table(spark, sf, "documents").select("doc_id", t.alias("t")), "doc_id", "t")


V.add_view("repeats", ["pairs"], "SELECT source AS file_id, pos, src, CASE WHEN file_id % 7 = 0 THEN tgt || '*' ELSE tgt END AS tgt, file_id || ':' || seq AS row_id FROM pairs WHERE len(src) >= 30")


def repeats(spark, sf):
    p = V.pairs(spark, sf).filter("length(src) >= 30")
    return p.select(F.col("source").alias("file_id"), "src", F.when(F.col("file_id") % 7 == 0, F.concat("tgt", L1("*"))).otherwise(F.col("tgt")).alias("tgt"), F.concat_ws(":", "file_id", "seq").alias("row_id"))


@query("A24_inconsistent_repeat", V.with_views("repeats", """
SELECT row_id FROM repeats JOIN (SELECT file_id, src FROM repeats GROUP BY 1, 2 HAVING count(DISTINCT tgt) > 1) USING (file_id, src)"""))
def a24(spark, sf):
    r = repeats(spark, sf)
    return r.join(audit.inconsistent(r, "file_id", "src", "tgt"), ["file_id", "src"], "left_semi").select("row_id")


@query("A40_consistency_sweep", V.with_views("repeats", """
SELECT r.row_id, md5(m.best) AS fixed FROM repeats r JOIN (SELECT file_id, src, sum(n) AS total, arg_max(tgt, (n, tgt)) AS best, max(n) AS top, count(CASE WHEN n = mx THEN 1 END) AS ties FROM (
  SELECT *, max(n) OVER (PARTITION BY file_id, src) AS mx FROM (SELECT file_id, src, tgt, count(*) AS n FROM repeats WHERE len(src) - len(replace(src, ' ', '')) >= 3 GROUP BY 1, 2, 3)) GROUP BY 1, 2 HAVING count(*) > 1) m USING (file_id, src)
JOIN (SELECT file_id, src, tgt, count(*) AS n FROM repeats GROUP BY 1, 2, 3) c USING (file_id, src, tgt) WHERE r.tgt <> m.best AND m.ties = 1 AND c.n * 100 <= 34 * m.total"""))
def a40(spark, sf):
    return audit.sweep(repeats(spark, sf), "file_id", "src", "tgt", min_words=4, minority_pct=34).select("row_id", F.md5("fixed").alias("fixed"))


@query("A25_pattern_hits", V.with_views("pairs", """
SELECT file_id, CAST(sum(len(regexp_extract_all(tgt, '\\[HATA'))) AS BIGINT) AS failed, CAST(sum(len(regexp_extract_all(tgt, '\\}\\s*,\\s*\\{'))) AS BIGINT) AS json, CAST(sum(len(regexp_extract_all(tgt, '♪'))) AS BIGINT) AS notes, CAST(sum(len(regexp_extract_all(tgt, 'Subtitles by'))) AS BIGINT) AS signatures FROM pairs GROUP BY 1"""))
def a25(spark, sf):
    hits = lambda rx: F.sum(F.regexp_count("tgt", L1(rx))).cast("bigint")
    return V.pairs(spark, sf).groupBy("file_id").agg(hits(r"\[HATA").alias("failed"), hits(T.JSON_SEPARATOR).alias("json"), hits("♪").alias("notes"), hits("Subtitles by").alias("signatures"))


@query("A29_outcome_summary", """
SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
 CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 0 THEN 'full' WHEN sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) > 0 THEN 'partial' ELSE 'failure' END AS outcome FROM events GROUP BY 1""")
def a29(spark, sf):
    e = read_table(spark, sf, "events")
    n = lambda t: F.count_if(F.col("event_type") == t)
    g = e.groupBy("user_id").agg(n("purchase").alias("completed"), n("error").alias("failed"), n("view").alias("skipped"))
    return g.withColumn("outcome", F.when(F.col("failed") == 0, "full").when(F.col("completed") > 0, "partial").otherwise("failure"))


# Prices per million tokens in cents, a parameter of the roll-up.
PRICES = {"m0": (15, 60), "m1": (250, 1000), "m2": (300, 1500)}


@query("A33_cost_rollup", V.with_views("calls", """
SELECT model, route, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens * CASE model WHEN 'm0' THEN 15 WHEN 'm1' THEN 250 ELSE 300 END + tokens * 2 * CASE model WHEN 'm0' THEN 60 WHEN 'm1' THEN 1000 ELSE 1500 END) AS BIGINT) AS micro_cents FROM calls WHERE ok GROUP BY 1, 2"""))
def a33(spark, sf):
    prices = spark.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, p_in bigint, p_out bigint")
    c = V.calls(spark, sf).filter("ok").groupBy("model", "route").agg(F.sum("tokens").alias("tokens"))
    # Tokens are summed before the price list is joined.
    return c.join(F.broadcast(prices), "model").select("model", "route", "tokens", (F.col("tokens") * F.col("p_in") + F.col("tokens") * 2 * F.col("p_out")).alias("micro_cents"))


@query("A35_distinct_counts", V.with_views("lines", "SELECT lang, count(DISTINCT text) AS distinct_lines FROM lines GROUP BY 1"))
def a35(spark, sf):
    return distinct_lines(V.lines(spark, sf))


def distinct_lines(lines, approximate=False):
    n = F.approx_count_distinct("text") if approximate else F.count_distinct("text")
    return lines.groupBy("lang").agg(n.alias("distinct_lines"))


@query("A36_preflight_duplicates", V.with_views("series", """
SELECT doc_id, 'content' AS kind FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(regexp_replace(text, '^\\x{FEFF}', ''))) AS n FROM documents) WHERE n > 1
UNION ALL SELECT doc_id, 'path' FROM (SELECT doc_id, count(*) OVER (PARTITION BY path) AS n FROM series) WHERE n > 1
UNION ALL SELECT doc_id, 'title_year' FROM (SELECT doc_id, count(*) OVER (PARTITION BY regexp_extract(path, 'Film (\\d{4})', 1)) AS n FROM series WHERE doc_id % 8 = 6) WHERE n > 1"""))
def a36(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.sha2(F.regexp_replace("text", "^﻿", ""), 256).alias("key"))
    s = series(spark, sf)
    film = s.filter("show_name is null and season is null").select("doc_id", F.regexp_extract("path", r"([^/]*?)[ ._(\[]*((?:19|20)\d{2})", 1).alias("t"), F.regexp_extract("path", r"([^/]*?)[ ._(\[]*((?:19|20)\d{2})", 2).alias("y"))
    titles = film.filter("y <> ''").select("doc_id", F.concat_ws("|", F.lower("t"), "y").alias("key"))
    return audit.duplicates(d, "content").unionByName(audit.duplicates(s.select("doc_id", F.col("path").alias("key")), "path")).unionByName(audit.duplicates(titles, "title_year"))


@query("A37_preflight_unusable", """
SELECT doc_id, unnest(list_filter([CASE WHEN t = '' THEN 'empty' END, CASE WHEN len(regexp_extract_all(t, '[\\x01-\\x08\\x0E-\\x1F]')) > 0 THEN 'binary' END, CASE WHEN t NOT LIKE '%-->%' THEN 'no_cues' END, CASE WHEN doc_id % 50 = 3 THEN 'placeholder' END], lambda x: x IS NOT NULL)) AS issue
FROM (SELECT doc_id, CASE doc_id % 50 WHEN 0 THEN '' WHEN 1 THEN text || chr(2) WHEN 2 THEN 'plain' WHEN 3 THEN '00:00:00,000 --> 05:00:00,000' ELSE '00:00:01,000 --> 00:00:02,000' || text || '00:00:03,000 --> 00:00:04,000' END AS t FROM documents)""")
def a37(spark, sf):
    k = F.col("doc_id") % 50
    t = (F.when(k == 0, "").when(k == 1, F.concat("text", F.chr(L1(2)))).when(k == 2, "plain").when(k == 3, "00:00:00,000 --> 05:00:00,000")
         .otherwise(F.concat(L1("00:00:01,000 --> 00:00:02,000"), "text", L1("00:00:03,000 --> 00:00:04,000"))))
    return audit.unusable(read_table(spark, sf, "documents").select("doc_id", t.alias("t")), "doc_id", "t")


V.add_view("tokens_src", ["lines"], f"SELECT file_id, tok, count(*) AS n FROM (SELECT file_id, unnest(regexp_extract_all(text, {q(T.TOKEN)})) AS tok FROM lines) GROUP BY 1, 2")
_CLOSED = ", ".join(q(w) for w in K.CLOSED_STOP)


@query("A38_name_locks", V.with_views("tokens_src", """
SELECT file_id, name FROM (SELECT file_id, lower(tok) AS k, min(CASE WHEN regexp_matches(tok, '^\\p{Lu}') THEN tok END) AS name, sum(CASE WHEN regexp_matches(tok, '^\\p{Lu}') THEN n ELSE 0 END) AS cap, sum(CASE WHEN regexp_matches(tok, '^\\p{Lu}') THEN 0 ELSE n END) AS low FROM tokens_src GROUP BY 1, 2)
WHERE cap >= 2 AND low = 0 AND len(k) >= 3 AND k NOT IN (%s)""" % _CLOSED))
def a38(spark, sf):
    t = V.lines(spark, sf).select("file_id", F.explode(T.tokens(F.col("text"))).alias("tok"))
    return audit.name_locks(t, "file_id", "tok", stop=K.CLOSED_STOP)


@query("A39_glossary_sanitise", V.with_views("term_pairs", f"""
SELECT src, tgt FROM term_pairs WHERE n >= 5 AND lower(src) <> lower(tgt) AND lower(src) NOT IN ({', '.join(q(w) for w in K.CLOSED_STOP)}) AND len(src) >= 3 AND NOT regexp_matches(tgt, '[()]')"""))
def a39(spark, sf):
    t = term_pairs(spark, sf).filter("n >= 5")
    common = spark.createDataFrame([(w,) for w in K.CLOSED_STOP], "word string")
    t = t.join(F.broadcast(common), F.lower("src") == F.col("word"), "left_anti")  # 15 words
    return t.filter((F.lower("src") != F.lower("tgt")) & (F.length("src") >= 3) & ~F.col("tgt").rlike("[()]")).select("src", "tgt")
