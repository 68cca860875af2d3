"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueflow.functions import timecode as TC
from cueflow.operators import ordered
from cueflow.plans import views as V
from cueflow.plans.registry import query
from cueflow.plans.registry import quoted as q
from cueflow.plans.text_queries import STRIP
from cueflow.plans.text_queries import paths, restricted, streams
from cueflow.session import memo, read_table, read_texts, work_path
from cueflow.sources import discovery, encodings, subtitles, tables

L1 = F.lit

# A listing with generated files beside some of their sources.
V.add_view("listing", ["paths"], """
SELECT DISTINCT path FROM (SELECT path FROM paths
 UNION ALL SELECT replace(path, '.tr.srt', '.srt') FROM paths WHERE doc_id % 16 = 6
 UNION ALL SELECT path || '.srt' FROM paths WHERE doc_id % 8 = 1
 UNION ALL SELECT replace(path, '.vtt', '.ass.srt') FROM paths WHERE doc_id % 8 = 1
 UNION ALL SELECT '/corpus/ÇIKTI/' || doc_id || '.srt' FROM paths WHERE doc_id % 8 = 0
 UNION ALL SELECT replace(path, '.srt', '.ham.srt') FROM paths WHERE doc_id % 8 = 2)""")


@memo
def listing(spark, sf):
    p = paths(spark, sf)
    i, path = F.col("doc_id") % 8, F.col("path")
    rep = lambda a, b: F.replace(path, L1(a), L1(b))
    extra = F.array_compact(F.array(
        path, F.when(F.col("doc_id") % 16 == 6, rep(".tr.srt", ".srt")), F.when(i == 1, F.concat(path, L1(".srt"))),
        F.when(i == 1, rep(".vtt", ".ass.srt")), F.when(i == 0, F.concat(L1("/corpus/ÇIKTI/"), F.col("doc_id").cast("string"), L1(".srt"))),
        F.when(i == 2, rep(".srt", ".ham.srt")),
    ))
    return p.select(F.explode(extra).alias("path")).distinct()


_GEN = """(regexp_matches(path, '\\.ham\\.srt$') OR
 (path LIKE '%.vtt.srt' AND EXISTS (SELECT 1 FROM listing s WHERE s.path = regexp_replace(l.path, '\\.srt$', ''))) OR
 (path LIKE '%.ass.srt' AND EXISTS (SELECT 1 FROM listing s WHERE s.path = regexp_replace(l.path, '\\.srt$', ''))) OR
 (path LIKE '%.tr.srt' AND EXISTS (SELECT 1 FROM listing s WHERE s.path = replace(l.path, '.tr.srt', '.srt'))))"""


@query("S1_discovery", V.with_views("listing", f"SELECT path FROM listing l WHERE regexp_matches(path, '\\.(srt|vtt|ass|ssa)$') AND path NOT LIKE '%/ÇIKTI/%' AND NOT {_GEN}"))
def s1(spark, sf):
    return discovery.discover(listing(spark, sf), "path").select("path")


@query("S2_generated_exclusion", V.with_views("listing", f"SELECT path FROM listing l WHERE NOT {_GEN}"))
def s2(spark, sf):
    return discovery.drop_generated(listing(spark, sf), "path").select("path")


_BYTES = """SELECT doc_id % 7 AS k, text FROM documents WHERE len(text) > 0"""
# Words whose letters above ASCII are Turkish, after each text that is stored by a code page.
_TURKISH = "ğışİŞĞğı"


@query("S3_decode_audit", f"""
SELECT CASE WHEN k = 0 THEN 'utf-8' WHEN k = 1 THEN 'utf-8-sig' WHEN k = 2 THEN 'utf-16' WHEN k = 3 THEN 'utf-16-be' WHEN k = 4 THEN 'utf-16-le' WHEN k = 5 THEN 'utf-32-be' WHEN k = 6 AND NOT fits THEN 'utf-8' ELSE 'cp1254' END AS encoding,
 count(*) AS files, CAST(sum(len(t)) AS BIGINT) AS chars FROM (SELECT k, regexp_replace(replace(CASE WHEN k = 6 THEN text || ' {_TURKISH}' ELSE text END, chr(13) || chr(10), chr(10)), '\r', chr(10), 'g') AS t, NOT regexp_matches(text, '[^\x00-\x7F]') AS fits FROM ({_BYTES})) GROUP BY 1""")
def s3(spark, sf):
    d = read_table(spark, sf, "documents").filter("length(text) > 0").select((F.col("doc_id") % 7).alias("k"), "text")
    t = F.col("text")
    turkish = F.concat(t, L1(" " + _TURKISH))
    # The Turkish page differs from ISO-8859-1 in six letters.
    page = F.encode(F.translate(turkish, "ğışİŞĞ", "ðýþÝÞÐ"), "ISO-8859-1")
    raw = (
        F.when(F.col("k") == 0, F.encode(t, "UTF-8")).when(F.col("k") == 1, F.encode(F.concat(L1("﻿"), t), "UTF-8"))
        .when(F.col("k") == 2, F.encode(t, "UTF-16")).when(F.col("k") == 3, F.encode(t, "UTF-16BE"))
        .when(F.col("k") == 4, F.encode(t, "UTF-16LE")).when(F.col("k") == 5, F.encode(t, "UTF-32"))
        .when(t.rlike(r"[^\x00-\x7F]"), F.encode(turkish, "UTF-8")).otherwise(page)
    )
    return encodings.audit(encodings.decode(d.select(raw.alias("content")), "content")).select("encoding", "files", "chars")


# --- SRT, VTT and ASS texts made from the documents, one row per file ------------------

@memo
def line_docs(spark, sf):
    """(file_id, array of all lines that are not blank)."""
    t = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    return read_texts(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("file_id"), t.alias("l")).filter(F.size("l") > 0)


def _start(i):
    return ((i + 1) * 4000).cast("bigint")


@memo
def srt_docs(spark, sf):
    f = F.col("file_id") % 4
    no = lambda i: (F.when(f == 0, F.concat((i + 1).cast("string"), L1("\n"))).when(f == 1, L1(""))
                    .when(f == 2, L1("5\n")).otherwise(F.concat((i * 2 + 2).cast("string"), L1("\n"))))
    # Some cues open with a number, carry markup and signs, or have blanks at their edges.
    hard = lambda x, i: (F.when(i % 11 == 3, F.concat(L1("1999\n<i>"), x, L1("</i>"))).when(i % 11 == 5, F.concat(L1("  "), x, L1(" \t")))
                         .when(i % 11 == 7, F.concat(L1("{\\an8}"), x, L1(" & co > 1"))).otherwise(x))
    cue = lambda x, i: F.concat(
        no(i), TC.span(_start(i), _start(i) + 2500), L1("\n"), hard(x, i),
        F.when(i % 6 == 0, L1("\n\n  \nsecond")).otherwise(L1("")), F.when(i % 5 == 4, L1("\n")).otherwise(L1("\n\n")))
    empty = F.concat(L1("\n\n"), TC.span(L1(900000000).cast("bigint"), L1(900001000).cast("bigint")), L1("\n\n"))
    return line_docs(spark, sf).select("file_id", F.concat(F.array_join(F.transform("l", cue), ""), F.when(f == 1, empty).otherwise("")).alias("content"))


_SRT = f"""SELECT file_id, pos, CASE WHEN file_id % 4 = 3 THEN pos * 2 WHEN file_id % 4 = 2 AND n = 1 THEN 5 ELSE pos END AS cue_no, pos * 4000 AS start_ms, pos * 4000 + 2500 AS end_ms,
 {STRIP("CASE (pos - 1) % 11 WHEN 3 THEN '1999' || chr(10) || '<i>' || text || '</i>' WHEN 7 THEN '{\\an8}' || text || ' & co > 1' ELSE text END")} || CASE WHEN pos % 6 = 1 THEN chr(10) || 'second' ELSE '' END AS text FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM lines)"""
V.add_view("srt_cues", ["lines"], _SRT)


@query("S4_srt_scan", V.with_views("srt_cues", "SELECT * FROM srt_cues"))
def s4(spark, sf):
    return subtitles.parse_srt(srt_docs(spark, sf), "file_id", "content")


@query("S5_srt_keep_empty", V.with_views("srt_cues", """
SELECT * FROM srt_cues UNION ALL SELECT file_id, max(pos) + 1, max(pos) + 1, 900000000, 900001000, '' FROM srt_cues WHERE file_id % 4 = 1 GROUP BY 1"""))
def s5(spark, sf):
    return subtitles.parse_srt(srt_docs(spark, sf), "file_id", "content", keep_empty=True)


@memo
def vtt_docs(spark, sf):
    dot = lambda c: F.regexp_replace(TC.format_ms(c), ",", ".")
    cue = lambda x, i: F.concat(
        F.when(i % 3 == 0, F.concat(L1("cue-"), i.cast("string"), L1("\n"))).otherwise(L1("")),
        F.when(i % 2 == 0, dot(_start(i))).otherwise(F.regexp_replace(dot(_start(i)), r"^00:", "")), L1(" --> "), dot(_start(i) + 2500), L1(" align:left\n"),
        L1("<v Ann>"), F.when(i % 11 == 3, "&lt;b&gt;").when(i % 11 == 5, "<00:00:01.500>").otherwise(""), x, F.when(i % 11 == 7, "\n77").otherwise(""), L1(" &amp; &eacute;&#33;\n\n"), F.when(i % 4 == 0, L1("NOTE not a cue\nstill not\n\n")).otherwise(L1("")))
    head = F.concat(L1("WEBVTT\nX-TIMESTAMP-MAP=LOCAL:00:00:01.000,MPEGTS:"), ((F.col("file_id") % 10) * 90000).cast("string"), L1("\n\nSTYLE\n::cue { color: red }\n\n"))
    return line_docs(spark, sf).select("file_id", F.concat(head, F.array_join(F.transform("l", cue), "")).alias("content"))


_VTT = """SELECT file_id, pos, pos AS cue_no, pos * 4000 + (file_id % 10) * 1000 - 1000 AS start_ms, pos * 4000 + 2500 + (file_id % 10) * 1000 - 1000 AS end_ms, '<v Ann>' || CASE (pos - 1) % 11 WHEN 3 THEN '<b>' WHEN 5 THEN '<00:00:01.500>' ELSE '' END || text || CASE (pos - 1) % 11 WHEN 7 THEN chr(10) || '77' ELSE '' END || ' & é!' AS text FROM lines"""


@query("S6_vtt_scan", V.with_views("lines", _VTT))
def s6(spark, sf):
    return subtitles.parse_vtt(vtt_docs(spark, sf), "file_id", "content")


HEAD = (
    "[Script Info]\nWrapStyle: 0\nTimer: 100.0\n\n[V4+ Styles]\nFormat: Name, Fontname, PrimaryColour\nStyle: Main, Arial, &H00FFFFFF\n"
    "Style: Ghost, Arial, &HFFFFFFFF\n\n[Events]\nFormat: Layer, Start, End, Style, Name, Effect, Text\n"
)


@memo
def ass_docs(spark, sf):
    cc = lambda c: F.regexp_replace(F.regexp_replace(TC.format_ms(c), "^0", ""), r",(\d\d)\d$", ".$1")
    style = lambda i: F.when(i % 7 == 3, "Ghost").when(i % 7 == 4, "OP-JP").when(i % 7 == 5, "OP-EN").otherwise("Main")
    # Events run backwards in the file and songs in two languages share a time.
    row = lambda x, i: F.concat(
        L1("Dialogue: 0,"), cc(at(i)), L1(","), cc(at(i) + 2500), L1(","), style(i), L1(","),
        F.when(i % 7 == 1, "ANN").when(i % 7 == 2, "Sign 12").otherwise(""), L1(",,{\\an8}"), F.when(i % 11 == 5, "{note: gone}").otherwise(""), x,
        F.when(i % 11 == 3, ", {\\i1}it{\\i0}").when(i % 11 == 7, "\\hhard").otherwise(""), L1("\\Nend"))
    at = lambda i: F.when(i % 7 == 4, _start(i + 1)).otherwise(_start(i))
    lines = F.array_join(F.reverse(F.transform("l", row)), "\n")
    return line_docs(spark, sf).select("file_id", F.concat(L1(HEAD), lines, L1("\n\n[Fonts]\nDialogue: x\n")).alias("content"))


# Both song lines of a pair exist only if the file has the English line as well.
_ASSBASE = """
 SELECT file_id, i, CASE WHEN i % 7 = 4 THEN (i + 2) * 4000 ELSE (i + 1) * 4000 END AS start_ms, n - i AS rank,
  '{\\an8}' || CASE WHEN i % 7 = 1 THEN 'ANN: ' ELSE '' END || text || CASE i % 11 WHEN 3 THEN ', {\\i1}it{\\i0}' WHEN 7 THEN ' hard' ELSE '' END || chr(10) || 'end' AS text, n FROM (SELECT *, pos - 1 AS i, count(*) OVER (PARTITION BY file_id) AS n FROM lines) WHERE (pos - 1) % 7 <> 3"""
V.add_view("ass_events", ["lines"], _ASSBASE)
V.add_view("ass_cues", ["ass_events"], """
SELECT file_id, row_number() OVER w AS pos, row_number() OVER w AS cue_no, start_ms, start_ms + 2500 AS end_ms, text
FROM ass_events WHERE NOT (i % 7 = 4 AND i + 1 < n) WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, rank)""")


@query("S7_ass_scan", V.with_views("ass_cues", "SELECT * FROM ass_cues"))
def s7(spark, sf):
    return subtitles.parse_ass(ass_docs(spark, sf), "file_id", "content")


@query("S8_lyric_dedup", V.with_views("ass_events", "SELECT file_id, start_ms, CASE i % 7 WHEN 4 THEN 'OP-JP' ELSE 'OP-EN' END AS style FROM ass_events WHERE i % 7 = 5 OR (i % 7 = 4 AND i + 1 >= n)"))
def s8(spark, sf):
    e = subtitles.parse_ass_events(ass_docs(spark, sf), "file_id", "content")
    return subtitles.drop_other_lyrics(e, "file_id").filter(F.col("style").startswith("OP")).select("file_id", "start_ms", "style")


# One style per line, named by it; lines of an even length make theirs invisible.
@query("S9_invisible_styles", V.with_views("lines", "SELECT file_id, 'S' || md5(text) || pos AS style FROM lines WHERE len(text) % 2 = 0"))
def s9(spark, sf):
    style = lambda x, i: F.concat(L1("Style: S"), F.md5(x), (i + 1).cast("string"), L1(", Arial,  &H"), F.when(F.length(x) % 2 == 0, "FF").otherwise("7F"), L1("FFFFFF"))
    head = F.concat(L1("[Script Info]\n\n[V4+ Styles]\nFormat: Name, Fontname, PrimaryColour\n"), F.array_join(F.transform("l", style), "\n"), L1("\n\n[Events]\n"))
    return line_docs(spark, sf).select("file_id", head.alias("content")).select("file_id", F.explode(subtitles.invisible_styles(F.col("content"))).alias("style"))


def any_docs(spark, sf):
    parts = [(srt_docs, "srt", 0), (vtt_docs, "vtt", 1), (ass_docs, "ass", 2), (srt_docs, "txt", 3)]
    dfs = [fn(spark, sf).filter(f"file_id % 4 = {k}").withColumn("path", F.concat(L1("/c/"), F.col("file_id").cast("string"), L1("." + ext))) for fn, ext, k in parts]
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


@query("S10_any_scan", V.with_views(["srt_cues", "ass_cues"], f"""
SELECT * FROM srt_cues WHERE file_id % 4 = 0 UNION ALL SELECT * FROM ({_VTT}) WHERE file_id % 4 = 1 UNION ALL SELECT * FROM ass_cues WHERE file_id % 4 = 2"""))
def s10(spark, sf):
    return subtitles.parse_any(any_docs(spark, sf), "file_id", "path", "content")


def journal_lines(spark, sf):
    e = read_table(spark, sf, "events")
    rec = F.to_json(F.struct(
        L1("chunk").alias("tip"), F.concat(L1("f"), F.col("user_id").cast("string")).alias("dosya"), F.col("event_id").cast("string").alias("custom_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("giris_token"), F.array(F.array(F.col("event_id").cast("string"), L1("00:00:01,000"))).alias("cue_zamanlari")))
    line = F.when(F.col("event_id") % 50 == 7, F.substring(rec, 1, 25)).when(F.col("event_id") % 50 == 8, "").otherwise(rec)
    return e.select(line.alias("value"))


@query("S11_journal_scan", """
SELECT 'f' || user_id AS dosya, count(*) AS chunks, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events WHERE event_id % 50 NOT IN (7, 8) GROUP BY 1
UNION ALL SELECT 'corrupt', count(*), 0 FROM events WHERE event_id % 50 = 7""")
def s11(spark, sf):
    path = work_path(spark, "journal")
    journal_lines(spark, sf).write.text(path)
    good, bad = tables.scan_json(spark, path, tables.CHUNK_SCHEMA)
    by_file = good.groupBy("dosya").agg(F.count("*").alias("chunks"), F.sum("giris_token").alias("tokens"))
    return by_file.unionByName(bad.agg(L1("corrupt").alias("dosya"), F.count("*").alias("chunks"), L1(0).cast("bigint").alias("tokens")))


@query("S12_journal_append", "SELECT count(*) * 2 AS n, CAST(2 * sum(user_id) AS BIGINT) AS total FROM events")
def s12(spark, sf):
    path = work_path(spark, "append")
    e = read_table(spark, sf, "events").select("user_id", "event_type", "event_id")
    tables.append_json(e, path)
    tables.append_json(e, path)
    return spark.read.schema("event_id bigint, event_type string, user_id bigint").json(path).agg(F.count("*").alias("n"), F.sum("user_id").alias("total"))


def result_rows(spark, sf):
    """Model results per turn, with the shape of a batch result file."""
    t = read_table(spark, sf, "conversations")
    cid = F.concat(F.col("conv_id").cast("string"), L1("__block"), F.col("turn").cast("string"))
    k = (F.col("conv_id") * 7 + F.col("turn")) % 11
    choice = F.struct(F.when(k == 3, "length").otherwise("stop").alias("finish_reason"), F.struct(F.when(k == 4, "").otherwise(F.concat(L1("tr "), F.col("text"))).alias("content")).alias("message"))
    return t.filter(k != 6).select("conv_id", "turn", cid.alias("custom_id"), F.when(k == 5, "boom").alias("error"), F.struct(F.struct(F.array(choice).alias("choices")).alias("body")).alias("response"))


@query("S13_result_scan", """
SELECT 'stop' AS finish, count(*) AS n FROM conversations WHERE (conv_id * 7 + turn) % 11 NOT IN (3, 6) UNION ALL SELECT 'length', count(*) FROM conversations WHERE (conv_id * 7 + turn) % 11 = 3""")
def s13(spark, sf):
    path = work_path(spark, "results")
    result_rows(spark, sf).drop("conv_id", "turn").write.json(path)
    good, _ = tables.scan_json(spark, path, tables.RESULT_SCHEMA)
    return good.groupBy(F.col("response.body.choices")[0]["finish_reason"].alias("finish")).agg(F.count("*").alias("n"))


@query("S14_request_table", V.with_views("lines", """
SELECT 'doc' || file_id || '_' || left(sha256('/c/doc' || file_id || '.srt'), 16) || '__block' || pos AS custom_id, count(*) AS n FROM lines GROUP BY 1"""))
def s14(spark, sf):
    c = V.lines(spark, sf).withColumn("path", F.concat(L1("/c/doc"), F.col("file_id").cast("string"), L1(".srt")))
    r = tables.request_table(c, "path", "pos", "text")
    return r.groupBy("custom_id").agg(F.count("*").alias("n"))


@query("S15_memory_table", V.with_views("memory_pairs", "SELECT lang AS src_lang, count(*) AS n FROM memory_pairs WHERE lang = 'de' GROUP BY 1"))
def s15(spark, sf):
    path = work_path(spark, "memory")
    tm = V.memory_pairs(spark, sf).select(F.md5("source").alias("hash"), "source", "target", L1("tr").alias("tgt_lang"), F.col("lang").alias("src_lang"))
    tables.write_memory(tm, path)
    return spark.read.parquet(path).filter("src_lang = 'de'").groupBy("src_lang").agg(F.count("*").alias("n"))


@query("S16_srt_sink", V.with_views("cues", """
SELECT file_id, count(*) AS cues, CAST(sum(len(text)) AS BIGINT) AS chars FROM cues GROUP BY 1"""))
def s16(spark, sf):
    path = work_path(spark, "srt")
    c = V.cues(spark, sf).withColumn("cue_no", F.col("pos"))
    tables.write_srt(c, "file_id", path)
    back = spark.read.parquet(path).select(F.struct("file_id", "part").alias("file"), "content")
    parsed = subtitles.parse_srt(back, "file", "content")
    return parsed.groupBy(F.col("file.file_id").alias("file_id")).agg(F.count("*").alias("cues"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def probes(spark, sf):
    s = streams(spark, sf)
    item = F.struct(
        F.when(F.col("idx") % 13 == 0, "bad").otherwise(F.col("idx").cast("string")).alias("index"), L1("SubRip").alias("codec_name"),
        F.struct(F.col("is_default").cast("int").alias("default"), F.col("forced").cast("int").alias("forced")).alias("disposition"),
        F.struct("language", "title").alias("tags"))
    # A container has a handful of streams, so its probe is one small row.
    return s.select("video", F.to_json(F.struct(F.array(item).alias("streams"))).alias("probe"))


@query("S17_stream_catalogue", V.with_views("streams", "SELECT video, idx, 'subrip' AS codec, language, title, is_default, forced FROM streams WHERE idx % 13 <> 0"))
def s17(spark, sf):
    return tables.stream_catalogue(probes(spark, sf), "video", "probe").select("video", "idx", "codec", "language", "title", "is_default", "forced")


@query("S18_findings_sink", V.with_views("pairs", "SELECT CAST(h AS BIGINT) AS h, count(*) AS n, CAST(sum(len(src)) AS BIGINT) AS src_chars, CAST(sum(len(tgt)) AS BIGINT) AS tgt_chars FROM pairs GROUP BY 1"))
def s18(spark, sf):
    path = work_path(spark, "findings")
    V.pairs(spark, sf).select("file_id", "seq", "h", "src", "tgt").write.json(path)
    return spark.read.schema("file_id bigint, seq bigint, h bigint, src string, tgt string").json(path).groupBy("h").agg(F.count("*").alias("n"), F.sum(F.length("src")).alias("src_chars"), F.sum(F.length("tgt")).alias("tgt_chars"))


@query("T3_best_stream", V.with_views("streams", """
SELECT video, idx FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN forced OR title IN ('Forced', 'SDH') THEN 1 ELSE 0 END, CASE WHEN is_default THEN 0 ELSE 1 END, idx) AS r FROM streams) WHERE r = 1"""))
def t3(spark, sf):
    # A minimum of a struct is a partial aggregate: no window over the streams of a video.
    rank = F.struct(F.when(restricted(), 1).otherwise(0).alias("a"), F.when(F.col("is_default"), 0).otherwise(1).alias("b"), F.col("idx").alias("idx"))
    return streams(spark, sf).groupBy("video").agg(F.min(rank).alias("r")).select("video", "r.idx")


@query("J24_origin_lookup", """
SELECT d.doc_id, p.url AS origin FROM documents d LEFT JOIN (SELECT page_id, url, md5(CAST(page_id * 3 AS VARCHAR)) AS fp FROM pages) p ON md5(CAST(d.doc_id AS VARCHAR)) = p.fp""")
def j24(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("fp"))
    p = read_table(spark, sf, "pages").select(F.md5((F.col("page_id") * 3).cast("string")).alias("fp"), F.col("url").alias("origin"))
    return d.join(p, "fp", "left").select("doc_id", "origin")


@query("X4_cue_table_function", V.with_views("srt_cues", "SELECT file_id, pos, start_ms, text FROM srt_cues"))
def x4(spark, sf):
    srt_docs(spark, sf).createOrReplaceTempView("cueflow_srt_docs")
    spark.udtf.register("cues_of", subtitles_udtf())
    return spark.sql("SELECT d.file_id, c.* FROM cueflow_srt_docs d, LATERAL cues_of(d.content) c")


def subtitles_udtf():
    """A convenience for lateral SQL over single files; scans use the column parsers."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos bigint, start_ms bigint, text string")
    class CuesOf:
        def eval(self, content: str):
            import re

            stamp = re.compile(r"(\d+):(\d\d):(\d\d)[,.](\d{3})\s*-->")
            pos = 0
            for block in re.split(r"(?m)^(?=(?:\d+[ \t]*\n)?[ \t]*\d+:\d\d:\d\d[,.]\d{3}[ \t]*-->)", content or ""):
                m = stamp.search(block)
                if not m:
                    continue
                body = [x.rstrip() for x in block[m.end():].split("\n")[1:] if x.strip()]
                if not body or "\n" in block[: m.start()].strip():
                    continue
                pos += 1
                h, mi, s, ms = map(int, m.groups())
                yield pos, ((h * 60 + mi) * 60 + s) * 1000 + ms, "\n".join(body).strip()

    return CuesOf
