"""J1-J5, J12-J18, J22, J26-J30, A9, A12, A13, A26, A31, U1, U2, U4-U6."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueflow.functions import keys as K
from cueflow.functions import labels as L
from cueflow.functions import text as T
from cueflow.operators import align, ordered, payload, ranges, sequence
from cueflow.plans import sequence_queries  # noqa: F401  (registers the scene views)
from cueflow.plans import views as V
from cueflow.plans.registry import query
from cueflow.plans.registry import quoted as q
from cueflow.plans.scans_queries import result_rows
from cueflow.plans.text_queries import STRIP, VISIBLE, named, name_language
from cueflow.session import memo, read_table, stored

L1 = F.lit

# Source side: some stamps are used twice, so that duplicates have to be paired one to one.
V.add_view("src_cues", ["cues"], """
SELECT file_id, pos, pos AS cue_no, CASE WHEN pos % 12 = 0 THEN lag(start_ms) OVER w ELSE start_ms END AS start_ms,
 CASE WHEN pos % 12 = 0 THEN lag(end_ms) OVER w ELSE end_ms END AS end_ms, src AS text, h FROM cues WINDOW w AS (PARTITION BY file_id ORDER BY pos)""")
V.add_view("dlv_cues", ["cues", "delivery"], """
SELECT d.file_id, d.cue_no AS pos, d.cue_no, CASE WHEN d.src_pos % 12 = 0 AND c.start_ms = d.start_ms THEN c.ps ELSE d.start_ms END AS start_ms,
 CASE WHEN d.src_pos % 12 = 0 AND c.start_ms = d.start_ms THEN c.pe ELSE d.end_ms END AS end_ms, d.text
FROM delivery d JOIN (SELECT file_id, pos, start_ms, lag(start_ms) OVER w AS ps, lag(end_ms) OVER w AS pe FROM cues WINDOW w AS (PARTITION BY file_id ORDER BY pos)) c ON c.file_id = d.file_id AND c.pos = d.src_pos""")


@stored("source")
def src_cues(spark, sf):
    c = ordered.with_window(V.cues(spark, sf), ["file_id"], "pos", {"ps": lambda w: F.lag("start_ms").over(w), "pe": lambda w: F.lag("end_ms").over(w)})
    twin = F.col("pos") % 12 == 0
    return c.select("file_id", "pos", F.col("pos").alias("cue_no"), F.when(twin, F.col("ps")).otherwise(F.col("start_ms")).alias("start_ms"),
                    F.when(twin, F.col("pe")).otherwise(F.col("end_ms")).alias("end_ms"), F.col("src").alias("text"), "h", "seq", "tgt")


@stored("delivered")
def dlv_cues(spark, sf):
    d = src_cues(spark, sf).filter("seq % 17 <> 0")
    moved = F.when((F.col("seq") % 23 == 0) & (F.col("pos") % 12 != 0), 700).when(F.col("seq") % 23 == 0, L1(None)).otherwise(0)
    # A shifted cue keeps its own time, so the twin rule applies to unshifted ones alone.
    own = V.cues(spark, sf).filter("seq % 23 = 0 and pos % 12 = 0").select("file_id", F.col("pos"), (F.col("start_ms") + 700).alias("o0"), (F.col("end_ms") + 700).alias("o1"))
    d = d.join(own, ["file_id", "pos"], "left")
    d = d.select("file_id", F.col("pos").alias("src_pos"), F.coalesce("o0", F.col("start_ms") + moved).alias("start_ms"), F.coalesce("o1", F.col("end_ms") + moved).alias("end_ms"),
                 F.when(F.col("seq") % 29 == 0, "").otherwise(F.col("tgt")).alias("text"))
    return ordered.dense_pos(d, ["file_id"], "src_pos", "cue_no").withColumn("pos", F.col("cue_no"))


V.add_view("timed", ["src_cues", "dlv_cues"], """
SELECT s.file_id, s.start_ms, s.end_ms, s.cue_no AS src_no, d.cue_no AS tgt_no, s.pos AS src_pos, d.pos AS tgt_pos FROM
 (SELECT *, row_number() OVER (PARTITION BY file_id, start_ms, end_ms ORDER BY pos) AS k FROM src_cues) s JOIN
 (SELECT *, row_number() OVER (PARTITION BY file_id, start_ms, end_ms ORDER BY pos) AS k FROM dlv_cues) d USING (file_id, start_ms, end_ms, k)""")
V.add_view("aligned", ["timed"], """
SELECT file_id, start_ms, end_ms, src_no, tgt_no, 'time' AS how FROM timed
UNION ALL SELECT coalesce(s.file_id, d.file_id), coalesce(d.start_ms, s.start_ms), coalesce(d.end_ms, s.end_ms), s.cue_no, d.cue_no, CASE WHEN d.pos IS NULL THEN 'source_only' WHEN s.pos IS NULL THEN 'delivery_only' ELSE 'number' END
FROM (SELECT * FROM src_cues s WHERE NOT EXISTS (SELECT 1 FROM timed t WHERE t.file_id = s.file_id AND t.src_pos = s.pos)) s
 FULL OUTER JOIN (SELECT * FROM dlv_cues d WHERE NOT EXISTS (SELECT 1 FROM timed t WHERE t.file_id = d.file_id AND t.tgt_pos = d.pos)) d ON s.file_id = d.file_id AND s.cue_no = d.cue_no""")


@memo
def aligned(spark, sf):
    return align.by_time(src_cues(spark, sf), dlv_cues(spark, sf))


@query("J1_align_ts", V.with_views("aligned", "SELECT * FROM aligned"))
def j1(spark, sf):
    return aligned(spark, sf).select("file_id", "start_ms", "end_ms", "src_no", "tgt_no", "how")


# A delivery whose files with an even number all moved, and of which every sixth lost no cue.
V.add_view("gap_src", ["cues"], "SELECT file_id, pos, start_ms, end_ms, src AS text FROM cues")
V.add_view("gap_dlv", ["cues"], """
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY pos) AS BIGINT) AS pos, start_ms + CASE WHEN file_id % 2 = 0 THEN 700 ELSE 0 END AS start_ms, end_ms + CASE WHEN file_id % 2 = 0 THEN 700 ELSE 0 END AS end_ms, tgt AS text
FROM cues WHERE file_id % 6 = 0 OR seq % 17 <> 0""")


def gap_pair(spark, sf):
    c = V.cues(spark, sf)
    move = F.when(F.col("file_id") % 2 == 0, 700).otherwise(0)
    d = c.filter("file_id % 6 = 0 or seq % 17 <> 0").select("file_id", F.col("pos").alias("o"), (F.col("start_ms") + move).alias("start_ms"), (F.col("end_ms") + move).alias("end_ms"), F.col("tgt").alias("text"))
    return c.select("file_id", "pos", "start_ms", "end_ms", F.col("src").alias("text")), ordered.dense_pos(d, ["file_id"], "o").drop("o")


V.add_view("covered", ["gap_src", "gap_dlv"], """
SELECT file_id, CAST(coalesce(max(sr), 0) AS BIGINT) AS src_rows, CAST(coalesce(max(dr), 0) AS BIGINT) AS tgt_rows, CAST(coalesce(max(ss), 0) AS BIGINT) AS src_stamps, CAST(coalesce(max(ds), 0) AS BIGINT) AS tgt_stamps, CAST(coalesce(max(c), 0) AS BIGINT) AS common FROM (
 SELECT file_id, count(*) AS sr, NULL AS dr, count(DISTINCT (start_ms, end_ms)) AS ss, NULL AS ds, NULL AS c FROM gap_src GROUP BY 1
 UNION ALL SELECT file_id, NULL, count(*), NULL, count(DISTINCT (start_ms, end_ms)), NULL FROM gap_dlv GROUP BY 1
 UNION ALL SELECT file_id, NULL, NULL, NULL, NULL, count(*) FROM (SELECT file_id, start_ms, end_ms FROM gap_src INTERSECT SELECT file_id, start_ms, end_ms FROM gap_dlv) GROUP BY 1) GROUP BY 1""")
_MODE = "CASE WHEN tgt_stamps > 0 AND common * 100 >= 80 * tgt_stamps THEN 'time' WHEN src_rows = tgt_rows THEN 'position' ELSE 'unaligned' END"


@query("J2_gated_alignment", V.with_views("covered", f"""
SELECT d.file_id, d.pos, d.start_ms, md5(s.text) AS src, mode FROM (SELECT *, row_number() OVER (PARTITION BY file_id, start_ms, end_ms ORDER BY pos) AS k FROM gap_dlv) d JOIN (SELECT *, {_MODE} AS mode FROM covered) c USING (file_id) JOIN (SELECT *, row_number() OVER (PARTITION BY file_id, start_ms, end_ms ORDER BY pos) AS k FROM gap_src) s ON s.file_id = d.file_id AND ((mode = 'time' AND s.start_ms = d.start_ms AND s.end_ms = d.end_ms AND s.k = d.k) OR (mode = 'position' AND s.pos = d.pos))"""))
def j2(spark, sf):
    return align.gated(*gap_pair(spark, sf)).select("file_id", "pos", "start_ms", F.md5("src_text").alias("src"), "mode")


@query("A26_stamp_overlap", V.with_views("covered", """
SELECT file_id, src_stamps, tgt_stamps, common, common * 100 // greatest(src_stamps, 1) AS src_pct, common * 100 // greatest(tgt_stamps, 1) AS tgt_pct FROM covered"""))
def a26(spark, sf):
    c = align.coverage(*gap_pair(spark, sf))
    return c.select("file_id", "src_stamps", "tgt_stamps", "common", F.expr("common * 100 div greatest(src_stamps, 1)").alias("src_pct"), F.expr("common * 100 div greatest(tgt_stamps, 1)").alias("tgt_pct"))


@query("U2_stamp_intersection", V.with_views(["gap_src", "gap_dlv"], "SELECT file_id, start_ms, end_ms FROM gap_src INTERSECT SELECT file_id, start_ms, end_ms FROM gap_dlv"))
def u2(spark, sf):
    s, d = gap_pair(spark, sf)
    cols = ["file_id", "start_ms", "end_ms"]
    return s.select(*cols).intersect(d.select(*cols))


# Delivered spans: cues of a sentence pair merged into one.
V.add_view("spans", ["cues"], """
SELECT file_id, (pos - 1) // 2 + 1 AS pos, min(start_ms) + CASE WHEN file_id % 5 = 0 AND ((pos - 1) // 2) % 9 = 0 THEN 1 ELSE 0 END AS start_ms, max(end_ms) AS end_ms FROM cues GROUP BY file_id, (pos - 1) // 2""")


@memo
def spans(spark, sf):
    c = V.cues(spark, sf).withColumn("g", F.expr("(pos - 1) div 2"))
    g = c.groupBy("file_id", "g").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("end_ms"))
    late = F.when((F.col("file_id") % 5 == 0) & (F.col("g") % 9 == 0), 1).otherwise(0)
    return g.select("file_id", (F.col("g") + 1).alias("pos"), (F.col("s") + late).alias("start_ms"), "end_ms", L1("").alias("text"))


@query("J3_containment_join", V.with_views("spans", """
SELECT file_id, d_pos, md5(string_agg(src, chr(10) ORDER BY s_pos)) AS src, count(*) AS parts, 'span' AS how FROM (
 SELECT d.file_id, d.pos AS d_pos, c.pos AS s_pos, c.src FROM spans d JOIN cues c ON c.file_id = d.file_id AND c.start_ms >= d.start_ms AND c.end_ms <= d.end_ms) GROUP BY 1, 2
UNION ALL SELECT d.file_id, d.pos, md5(c.src), 1, 'end' FROM spans d JOIN cues c ON c.file_id = d.file_id AND c.end_ms = d.end_ms WHERE NOT EXISTS (SELECT 1 FROM cues x WHERE x.file_id = d.file_id AND x.start_ms >= d.start_ms AND x.end_ms <= d.end_ms)"""))
def j3(spark, sf):
    s = V.cues(spark, sf).select("file_id", "pos", "start_ms", "end_ms", F.col("src").alias("text"))
    return align.source_in_span(s, spans(spark, sf)).select("file_id", "d_pos", F.md5("src_text").alias("src"), "parts", "how")


@query("J4_span_members", V.with_views("spans", """
SELECT d.file_id, d.pos AS a_pos, count(*) AS members, min(c.pos) AS first_pos, max(c.pos) AS last_pos FROM spans d JOIN cues c ON c.file_id = d.file_id AND c.start_ms >= d.start_ms AND c.end_ms <= d.end_ms GROUP BY 1, 2 HAVING count(*) > 1"""))
def j4(spark, sf):
    return align.span_members(V.cues(spark, sf), spans(spark, sf))


@query("J5_season_alignment", V.with_views(["spans", "scened"], """
SELECT d.file_id, d.pos AS d_pos, CASE WHEN count(DISTINCT c.scene) = 1 THEN string_agg(CAST(c.pos AS VARCHAR), '|' ORDER BY c.pos) END AS src_id FROM spans d LEFT JOIN scened c ON c.file_id = d.file_id AND c.start_ms >= d.start_ms AND c.end_ms <= d.end_ms GROUP BY 1, 2"""))
def j5(spark, sf):
    s = sequence.scenes(V.cues(spark, sf)).withColumn("cue_no", F.col("pos")).withColumn("text", F.col("src"))
    return align.season_spans(s, spans(spark, sf)).select("file_id", "d_pos", "src_id")


_VALID = "NOT coalesce((c.conv_id * 7 + c.turn) % 11 IN (3, 4, 5, 6), false) AND NOT (c.conv_id % 9 = 0 AND c.turn = 1)"


def batch(spark, sf):
    t = read_table(spark, sf, "conversations")
    req = t.select(F.concat(F.col("conv_id").cast("string"), L1("__block"), F.col("turn").cast("string")).alias("custom_id"), "conv_id", F.when((F.col("conv_id") + F.col("turn")) % 6 == 0, "[MUSIC PLAYING]").otherwise(F.col("text")).alias("src"))
    c = F.col("response.body.choices")[0]
    res = result_rows(spark, sf).select("custom_id", "error", c["finish_reason"].alias("finish"), c["message"]["content"].alias("content"), "conv_id", "turn")
    twice = res.filter("conv_id % 9 = 0 and turn = 1")
    stray = res.filter("turn = 0").withColumn("custom_id", F.concat(L1("x"), F.col("custom_id")))
    return req, res.unionByName(twice).unionByName(stray).drop("conv_id", "turn")


@query("J12_result_assembly", f"""
SELECT conv_id, count(*) AS cues, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failed, CASE WHEN bool_and(ok) THEN 'complete' ELSE 'partial' END AS status
FROM (SELECT conv_id, (conv_id + turn) % 6 = 0 AS label, {_VALID} AS ok FROM conversations c) WHERE ok OR NOT label GROUP BY 1""")
def j12(spark, sf):
    return payload.assemble(*batch(spark, sf), "conv_id")[2]


@query("U5_failed_ids", """
SELECT DISTINCT conv_id || '__block' || turn AS custom_id FROM conversations WHERE (conv_id * 7 + turn) % 11 IN (3, 4, 5, 6) OR (conv_id % 9 = 0 AND turn = 1)""")
def u5(spark, sf):
    req, res = batch(spark, sf)
    missing = req.select("custom_id").join(res, "custom_id", "left_anti")
    null = req.select("custom_id").join(res.filter((F.col("error").isNotNull()) | (F.col("finish") == "length") | (F.col("content") == "")).select("custom_id"), "custom_id", "left_semi")
    dup = res.groupBy("custom_id").agg(F.count("*").alias("n")).filter("n > 1").select("custom_id").join(req, "custom_id", "left_semi")
    return missing.union(null).union(dup).distinct()


@query("J13_fingerprint_check", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no_record' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS state FROM documents""")
def j13(spark, sf):
    return fingerprints(spark, sf).select("doc_id", "state")


def fingerprints(spark, sf):
    now = read_table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("now"))
    rec = read_table(spark, sf, "documents").filter("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", L1("x")), 256)).otherwise(F.sha2("text", 256)).alias("then"))
    return now.join(rec, "doc_id", "left").withColumn("state", F.when(F.col("then").isNull(), "no_record").when(F.col("now") == F.col("then"), "same").otherwise("changed"))


V.add_view("passes", ["dlv_cues"], "SELECT file_id, start_ms, end_ms, 'old ' || pos AS before_text, pos % 2 AS nth FROM dlv_cues WHERE pos % 3 = 0 UNION ALL SELECT file_id, start_ms, end_ms, 'older ' || pos, -1 FROM dlv_cues WHERE pos % 6 = 0")


@query("J15_review_record", V.with_views(["passes", "src_cues"], """
SELECT d.file_id, d.cue_no, CASE WHEN s.n = 1 THEN md5(s.t) ELSE '' END AS src, CASE WHEN d.n = 1 AND e.events > 0 THEN e.initial ELSE d.text END AS initial, CASE WHEN d.n = 1 THEN coalesce(e.events, 0) ELSE 0 END AS events FROM
 (SELECT *, count(*) OVER (PARTITION BY file_id, start_ms, end_ms) AS n FROM dlv_cues) d
 LEFT JOIN (SELECT file_id, start_ms, end_ms, count(*) AS n, min(text) AS t FROM src_cues GROUP BY 1, 2, 3) s USING (file_id, start_ms, end_ms)
 LEFT JOIN (SELECT file_id, start_ms, end_ms, count(*) AS events, arg_min(before_text, nth) AS initial FROM passes GROUP BY 1, 2, 3) e USING (file_id, start_ms, end_ms)"""))
def j15(spark, sf):
    d = dlv_cues(spark, sf)
    by = ["file_id", "start_ms", "end_ms"]
    ev = d.filter("pos % 3 = 0").select(*by, F.concat(L1("old "), F.col("pos").cast("string")).alias("b"), (F.col("pos") % 2).alias("nth"))
    ev = ev.unionByName(d.filter("pos % 6 = 0").select(*by, F.concat(L1("older "), F.col("pos").cast("string")).alias("b"), L1(-1).cast("bigint").alias("nth")))
    # Uniqueness on each side comes from aggregates; no stamp is collected.
    e = ev.groupBy(*by).agg(F.count("*").alias("events"), F.min_by("b", "nth").alias("first"))
    s = src_cues(spark, sf).groupBy(*by).agg(F.count("*").alias("sn"), F.min("text").alias("st"))
    n = d.groupBy(*by).agg(F.count("*").alias("dn"))
    j = d.join(n, by).join(s, by, "left").join(e, by, "left")
    alone = F.col("dn") == 1
    return j.select("file_id", "cue_no", F.when(F.col("sn") == 1, F.md5("st")).otherwise("").alias("src"),
                    F.when(alone & (F.col("events") > 0), F.col("first")).otherwise(F.col("text")).alias("initial"),
                    F.when(alone, F.coalesce("events", L1(0))).otherwise(0).cast("bigint").alias("events"))


_NORMW = lambda c: f"trim(regexp_replace(lower({VISIBLE(c)}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
V.add_view("rawn", ["cues"], f"SELECT file_id, pos, start_ms, end_ms, tgt, {_NORMW('tgt')} AS rn FROM cues WHERE regexp_matches({VISIBLE('tgt')}, '\\p{{L}}')")
V.add_view("dlvn", ["delivery"], f"SELECT file_id, start_ms, greatest(start_ms, end_ms) AS end_ms, {_NORMW('text')} AS dn FROM delivery")


@query("J16_lost_cues", V.with_views(["rawn", "dlvn"], """
SELECT r.file_id, r.pos FROM rawn r WHERE NOT EXISTS (SELECT 1 FROM dlvn d WHERE d.file_id = r.file_id AND d.start_ms = r.start_ms)
 AND NOT EXISTS (SELECT 1 FROM dlvn d WHERE d.file_id = r.file_id AND d.start_ms <= r.end_ms + 10000 AND d.end_ms >= greatest(r.start_ms - 10000, 0) AND contains(d.dn, r.rn))"""))
def j16(spark, sf):
    raw = V.cues(spark, sf).select("file_id", "pos", F.col("pos").alias("cue_no"), "start_ms", "end_ms", F.col("tgt").alias("text"))
    return align.lost_cues(raw, V.delivery(spark, sf)).select("file_id", "pos")


# Stamps in whole half minutes: many cues of a file share one, and a lost one has twins.
_COARSE = "start_ms // 30000 * 30000 AS start_ms, start_ms // 30000 * 30000 + 30000 AS end_ms"
V.add_view("twin_cues", ["cues"], f"SELECT file_id, pos, src, tgt, h, {_COARSE} FROM cues")
V.add_view("twin_dlv", ["delivery"], f"SELECT file_id, cue_no AS pos, cue_no, text, {_COARSE} FROM delivery")


def _coarse(df):
    s = F.expr("start_ms div 30000 * 30000")
    return df.withColumn("end_ms", s + 30000).withColumn("start_ms", s)


def twin_cues(spark, sf):
    return _coarse(V.cues(spark, sf).select("file_id", "pos", "src", "tgt", "start_ms", "end_ms"))


def twin_dlv(spark, sf):
    return _coarse(V.delivery(spark, sf).select("file_id", F.col("cue_no").alias("pos"), "cue_no", "text", "start_ms", "end_ms"))


_STAMP = "PARTITION BY file_id, start_ms, end_ms"


def _gap_sql(cues, delivery):
    return f"""
WITH said AS (SELECT *, row_number() OVER ({_STAMP} ORDER BY cue_no) AS k FROM {delivery} WHERE {STRIP('text')} <> ''),
 worded AS (SELECT *, row_number() OVER ({_STAMP} ORDER BY pos) AS k FROM {cues} WHERE regexp_matches({VISIBLE('src')}, '\\p{{L}}'))
SELECT file_id, pos, start_ms, CASE WHEN h = 3 THEN 'expected_removed' ELSE 'missing_dialogue' END AS class FROM worded w
 WHERE k > (SELECT count(*) FROM said d WHERE d.file_id = w.file_id AND d.start_ms = w.start_ms AND d.end_ms = w.end_ms)
UNION ALL SELECT file_id, cue_no, start_ms, 'extra_dialogue' FROM said d
 WHERE k > (SELECT count(*) FROM {cues} c WHERE c.file_id = d.file_id AND c.start_ms = d.start_ms AND c.end_ms = d.end_ms)"""


V.add_view("gaps", ["cues", "delivery"], _gap_sql("cues", "delivery"))
V.add_view("twin_gaps", ["twin_cues", "twin_dlv"], _gap_sql("twin_cues", "twin_dlv"))


@memo
def gaps(spark, sf):
    s = V.cues(spark, sf).select("file_id", "pos", "start_ms", "end_ms", F.col("src").alias("text"))
    return align.dialogue_gaps(s, V.delivery(spark, sf).withColumn("pos", F.col("cue_no")))


@memo
def twin_gaps(spark, sf):
    return align.dialogue_gaps(twin_cues(spark, sf).withColumn("text", F.col("src")), twin_dlv(spark, sf))


@query("J17_missing_extra", V.with_views(["gaps", "twin_gaps"], "SELECT *, false AS shared FROM gaps UNION ALL SELECT *, true FROM twin_gaps"))
def j17(spark, sf):
    return gaps(spark, sf).withColumn("shared", L1(False)).unionByName(twin_gaps(spark, sf).withColumn("shared", L1(True)))


@query("J18_delivery_triples", """
SELECT doc_id, doc_id * 10 + 2 AS raw_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0""")
def j18(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    delivered = d.filter("doc_id % 4 <> 0")
    # Three raw backups per delivery; the newest by (time, name) counts.
    raw = d.filter("doc_id % 3 <> 0").select("doc_id", F.explode(F.array(L1(1), L1(2), L1(3))).alias("v"))
    newest = raw.groupBy("doc_id").agg(F.max_by("v", F.struct((F.col("v") * 7 % 5).alias("mtime"), F.col("v").alias("name"))).alias("v"))
    return d.join(delivered, "doc_id", "left_semi").join(newest, "doc_id").select("doc_id", (F.col("doc_id") * 10 + F.col("v")).alias("raw_id"))


V.add_view("scene_plan", ["scened"], "SELECT file_id, scene, min(pos) AS a, max(pos) AS b FROM scened WHERE scene % 4 <> 0 GROUP BY 1, 2")
V.add_view("chunk_plan", ["cues"], "SELECT file_id, (pos - 1) // 5 + 1 AS chunk, min(pos) AS a, max(pos) AS b FROM cues GROUP BY 1, 2")


@memo
def scene_plan(spark, sf):
    return sequence.scenes(V.cues(spark, sf)).filter("scene % 4 <> 0").groupBy("file_id", "scene").agg(F.min("pos").alias("s_a"), F.max("pos").alias("s_b"))


def chunk_plan(spark, sf):
    return V.cues(spark, sf).groupBy("file_id", F.expr("(pos - 1) div 5 + 1").alias("chunk")).agg(F.min("pos").alias("c_a"), F.max("pos").alias("c_b"))


@query("J22_scene_overlap", V.with_views(["scene_plan", "chunk_plan"], """
SELECT c.file_id, chunk, scene, greatest(c.a, s.a) || '-' || least(c.b, s.b) AS clip FROM chunk_plan c JOIN scene_plan s ON s.file_id = c.file_id AND s.a <= c.b AND s.b >= c.a"""))
def j22(spark, sf):
    j = ranges.overlaps(chunk_plan(spark, sf), scene_plan(spark, sf), "file_id", "c_a", "c_b", "s_a", "s_b", bucket_ms=64)
    return j.select("file_id", "chunk", "scene", F.concat(F.greatest("c_a", "s_a").cast("string"), L1("-"), F.least("c_b", "s_b").cast("string")).alias("clip"))


@query("A31_scene_coverage", V.with_views("scened", """
SELECT file_id, CAST(sum(CASE WHEN scene % 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS covered, count(*) AS cues, CAST(count(DISTINCT CASE WHEN scene % 4 = 0 THEN scene END) AS BIGINT) AS open_ranges FROM scened GROUP BY 1"""))
def a31(spark, sf):
    c = V.cues(spark, sf).select("file_id", "pos")
    p = scene_plan(spark, sf)
    inside = ranges.containment(c.withColumn("p2", F.col("pos")), p, "file_id", "pos", "p2", "s_a", "s_b", bucket_ms=64).select("file_id", "pos").distinct().withColumn("hit", L1(1))
    m = c.join(inside, ["file_id", "pos"], "left").withColumn("open", F.col("hit").isNull())
    m = ordered.with_window(m, ["file_id"], "pos", {"was": lambda w: F.lag("open").over(w)})
    return m.groupBy("file_id").agg(F.count_if(~F.col("open")).alias("covered"), F.count("*").alias("cues"), F.count_if(F.col("open") & ~F.coalesce("was", L1(False))).alias("open_ranges"))


V.add_view("work", ["gaps"], """
SELECT doc_id AS file_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'fingerprint' WHEN EXISTS (SELECT 1 FROM gaps g WHERE g.file_id = doc_id AND class = 'missing_dialogue') THEN 'incomplete' ELSE 'skip' END AS plan FROM documents""")


@query("J26_incremental_plan", V.with_views("work", "SELECT * FROM work"))
def j26(spark, sf):
    f = fingerprints(spark, sf).select(F.col("doc_id").alias("file_id"), "state")
    open_ = gaps(spark, sf).filter("class = 'missing_dialogue'").groupBy("file_id").agg(F.count("*").alias("missing"))
    j = f.join(open_, "file_id", "left")
    return j.select("file_id", F.when(F.col("state") != "same", "fingerprint").when(F.col("missing") > 0, "incomplete").otherwise("skip").alias("plan"))


@query("J27_checkpoint_reuse", """
SELECT user_id, event_type, max(event_id) AS entry FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0 GROUP BY 1, 2""")
def j27(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "user_id", "event_type")
    # Entries by (chunk id, content hash): the last write of a key wins, other hashes coexist.
    store = e.filter("event_id % 2 = 0").groupBy("user_id", F.md5("event_type").alias("hash")).agg(F.max("event_id").alias("entry"))
    wanted = e.filter("user_id % 3 <> 0").select("user_id", "event_type", F.md5("event_type").alias("hash")).distinct()
    return wanted.join(store, ["user_id", "hash"]).select("user_id", "event_type", "entry")


V.add_view("tokens_of", ["pairs"], f"SELECT file_id, tok, count(*) AS n FROM (SELECT file_id, unnest(regexp_extract_all(tgt, {q(T.TOKEN)})) AS tok FROM pairs) GROUP BY 1, 2")


@memo
def tokens_of(spark, sf):
    t = V.pairs(spark, sf).select("file_id", F.explode(T.tokens(F.col("tgt"))).alias("tok"))
    return t.groupBy("file_id", "tok").agg(F.count("*").alias("n"))


@query("J28_exonyms", V.with_views("tokens_of", """
SELECT file_id, g.name, CAST(sum(CASE WHEN tok = g.name THEN n END) AS BIGINT) AS foreign_form, CAST(sum(CASE WHEN tok = g.rendering THEN n END) AS BIGINT) AS canonical_form FROM tokens_of t
 JOIN (SELECT tok AS name, lower(tok) AS rendering FROM tokens_of GROUP BY tok HAVING tok <> lower(tok) AND sum(n) >= 20) g ON t.tok IN (g.name, g.rendering) GROUP BY 1, 2 HAVING count(*) = 2"""))
def j28(spark, sf):
    t = tokens_of(spark, sf)
    names = t.groupBy("tok").agg(F.sum("n").alias("s")).filter("s >= 20").select(F.col("tok").alias("name"), F.lower("tok").alias("rendering")).filter("name <> rendering")
    forms = names.select("name", F.explode(F.array(F.struct(F.col("name").alias("tok"), L1(True).alias("raw")), F.struct(F.col("rendering").alias("tok"), L1(False).alias("raw")))).alias("f")).select("name", "f.*")
    # The map comes from the data and may be large: a plain equi-join, no forced broadcast.
    g = t.join(forms, "tok").groupBy("file_id", "name").agg(F.sum(F.when(F.col("raw"), F.col("n"))).alias("foreign_form"), F.sum(F.when(~F.col("raw"), F.col("n"))).alias("canonical_form"))
    return g.filter("foreign_form > 0 and canonical_form > 0")


@query("J29_repeated_head", V.with_views("tokens_of", """
SELECT DISTINCT a.file_id, a.tok AS typo FROM (SELECT file_id, lower(tok) AS tok FROM tokens_of) a JOIN (SELECT file_id, lower(tok) AS tok FROM tokens_of) b ON a.file_id = b.file_id AND a.tok = left(b.tok, 2) || b.tok WHERE len(b.tok) >= 4 AND regexp_matches(b.tok, '^[a-z]+$')"""))
def j29(spark, sf):
    t = tokens_of(spark, sf).select("file_id", F.lower("tok").alias("tok")).distinct()
    made = t.filter(F.col("tok").rlike("^[a-z]{4,}$")).select("file_id", F.concat(F.substring("tok", 1, 2), F.col("tok")).alias("typo")).distinct()
    return made.join(t.withColumnRenamed("tok", "typo"), ["file_id", "typo"], "left_semi")


@query("J30_name_language_check", V.with_views("named", "SELECT doc_id, 'de' AS named_lang, lang FROM named WHERE name LIKE '%.ger.srt' AND lang = 'en'"))
def j30(spark, sf):
    return named(spark, sf).select("doc_id", name_language(F.col("name")).alias("named_lang"), "lang").filter("named_lang <> lang")


_TK = lambda c: f"list_distinct(regexp_extract_all(lower(replace({c}, '’', '''')), {q(T.TOKEN)}))"


@query("A9_rewrite_diff", V.with_views(["twin_cues", "twin_dlv"], f"""
SELECT coalesce(b.file_id, a.file_id) AS file_id, CAST(sum(CASE WHEN trim(a.text) <> trim(b.tgt) THEN 1 ELSE 0 END) AS BIGINT) AS changed, CAST(sum(CASE WHEN a.file_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS removed,
 CAST(sum(CASE WHEN b.file_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN a.file_id IS NOT NULL AND b.file_id IS NOT NULL THEN len(list_filter({_TK('b.tgt')}, lambda x: NOT list_contains(regexp_extract_all(lower(replace(a.text, '’', '''')), {q(T.TOKEN)}), x))) ELSE 0 END) AS BIGINT) AS tokens_lost
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, start_ms, end_ms ORDER BY pos) AS k FROM twin_cues) b FULL OUTER JOIN (SELECT *, row_number() OVER (PARTITION BY file_id, start_ms, end_ms ORDER BY pos) AS k FROM twin_dlv) a ON a.file_id = b.file_id AND a.start_ms = b.start_ms AND a.end_ms = b.end_ms AND a.k = b.k GROUP BY 1"""))
def a9(spark, sf):
    return align.rewrite_diff(twin_cues(spark, sf).withColumn("text", F.col("tgt")), twin_dlv(spark, sf))


# Responses per conversation with injected faults; every item is a whole text of a turn between signs
# that a reply parser may trip over. Of conversations with id 5 (mod 16) the first text is a number.
_HEAD, _TAIL = "{\\an8}[MUSIC] \"q\" ", " \\ ]} {\"i\""


def responses(spark, sf):
    t = read_table(spark, sf, "conversations")
    i = F.col("turn")
    k = F.col("conv_id") % 8
    item = F.struct(i.cast("string").alias("i"), F.when((k == 5) & (i == 0), "").otherwise(F.concat(L1(_HEAD), F.coalesce("text", L1("")), L1(_TAIL))).alias("t"))
    # A response covers one chunk of a bounded number of cues.
    t = t.withColumn("chunk", F.expr("turn div 50"))
    g = t.filter(~((k == 1) & (i == 0))).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(item)).alias("its"))
    e = t.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(i.cast("string"))).alias("expected"))
    r = e.join(g, ["conv_id", "chunk"], "left").withColumn("its", F.coalesce("its", F.array().cast("array<struct<i:string,t:string>>")))
    j = F.to_json("its")
    raw = (F.when(k == 2, F.concat(L1('{"tr": '), j, L1("}"))).when(k == 3, F.to_json(F.concat("its", F.slice("its", 1, 1))))
           .when(k == 4, F.to_json(F.concat("its", F.array(F.struct(L1("999").alias("i"), L1("x").alias("t")))))).when(k == 6, F.concat(L1("```json\n"), j, L1("\n```")))
           .when(k == 7, F.regexp_replace(j, r"\]$", ', {"i": "9')).when(F.col("conv_id") % 16 == 5, F.replace(j, L1('"t":""'), L1('"t":5'))).otherwise(j))
    return r.select("conv_id", "chunk", raw.alias("raw"), "expected")


@query("A12_payload_integrity", """
SELECT conv_id, CASE WHEN conv_id % 8 = 1 AND n = 1 THEN 'invalid' WHEN conv_id % 8 = 2 THEN 'envelope' WHEN conv_id % 8 = 7 THEN 'salvaged' ELSE 'array' END AS mode,
 CASE conv_id % 8 WHEN 1 THEN CASE WHEN n = 1 THEN 'invalid_json' ELSE '' END WHEN 3 THEN 'duplicate_id' WHEN 4 THEN 'unexpected_id' WHEN 5 THEN 'invalid_text_type' ELSE '' END AS fatal,
 CASE WHEN conv_id % 8 IN (1, 3, 5) THEN '0' ELSE '' END AS missing, CASE conv_id % 8 WHEN 3 THEN '0' ELSE '' END AS duplicate, CASE conv_id % 8 WHEN 4 THEN '999' ELSE '' END AS unexpected,
 CAST(chars AS BIGINT) AS chars
FROM (SELECT conv_id, count(*) AS n, sum(CASE WHEN conv_id % 8 IN (1, 3, 5) AND turn = 0 THEN 0 ELSE len(coalesce(text, '')) + 28 END) AS chars FROM conversations GROUP BY 1)""")
def a12(spark, sf):
    x = payload.integrity(responses(spark, sf), "conv_id", "raw", "expected")
    join = lambda c: F.array_join(c, ",")
    return x.select("conv_id", "mode", "fatal", join("missing_ids").alias("missing"), join("duplicate_ids").alias("duplicate"), join("unexpected_ids").alias("unexpected"),
                    F.aggregate(F.map_values("translations"), L1(0).cast("bigint"), lambda a, t: a + F.length(t)).alias("chars"))


@query("A13_strict_acceptance", "SELECT conv_id FROM conversations GROUP BY 1 HAVING conv_id % 8 IN (0, 2, 5, 6, 7)")
def a13(spark, sf):
    x = responses(spark, sf).withColumn("p", payload.items(F.col("raw")))
    ids = F.transform("p.items", lambda i: i["i"])
    return x.filter(payload.strict_accept(ids, F.col("expected"))).select("conv_id")


@query("U1_missing_unexpected", """
SELECT 'missing' AS kind, conv_id || ':0' AS id FROM conversations WHERE conv_id % 8 = 1 AND turn = 0 UNION ALL SELECT 'unexpected', conv_id || ':999' FROM conversations WHERE conv_id % 8 = 4 AND turn = 0""")
def u1(spark, sf):
    x = responses(spark, sf)
    full = lambda c: F.concat(F.col("conv_id").cast("string"), L1(":"), c)
    want = x.select("conv_id", F.explode("expected").alias("i")).select(full(F.col("i")).alias("id"))
    got = x.select("conv_id", F.explode(payload.items(F.col("raw"))["items"]).alias("x")).select(full(F.col("x.i")).alias("id"))
    return want.exceptAll(got.distinct()).select(L1("missing").alias("kind"), "id").unionByName(got.distinct().exceptAll(want).select(L1("unexpected").alias("kind"), "id"))


@query("U4_ordered_distinct", """
SELECT user_id, event_type, first_id FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2)""")
def u4(spark, sf):
    return ordered_distinct(read_table(spark, sf, "events"), ["user_id"], "event_type", "event_id").withColumnRenamed("first", "first_id")


def ordered_distinct(df, keys, value, order):
    """Distinct values with the place of their first occurrence; the list is ordered by it."""
    return df.groupBy(*keys, value).agg(F.min(order).alias("first"))


@query("U6_sets_equal", "SELECT conv_id, conv_id % 8 NOT IN (1, 4) AS same FROM conversations GROUP BY 1")
def u6(spark, sf):
    x = responses(spark, sf)
    got = F.array_distinct(F.transform(payload.items(F.col("raw"))["items"], lambda i: i["i"]))
    return x.select("conv_id", (F.array_sort(got) == F.array_sort("expected")).alias("same"))
