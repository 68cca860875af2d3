"""The finding catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.functions import guards as G
from cueflow.functions import labels as L
from cueflow.functions import text as T
from cueflow.functions import timecode as TC
from cueflow.operators import align, audit, findings, prune
from cueflow.plans import views as V
from cueflow.plans.joins_queries import gap_pair, gaps
from cueflow.plans.registry import query
from cueflow.plans.registry import quoted as q
from cueflow.plans.sequence_queries import order_audit, quote_chains
from cueflow.plans.text_queries import HMS, STRIP
from cueflow.session import cut, explode_rows, memo

L1 = F.lit

# Pairs with a few more defects than the derived cues already carry.
_NO = "CASE WHEN seq % 43 = 0 THEN seq - 1 WHEN h = 26 AND seq % 2 = 0 THEN seq + 5 ELSE seq END"
_END = "CASE WHEN seq % 37 = 0 THEN start_ms - 30000 WHEN h = 26 THEN end_ms + 6000 ELSE end_ms END"
_TK = lambda c: f"regexp_extract_all(lower(replace({c}, '’', '''')), {q(T.TOKEN)})"
V.add_view("fpairs", ["cues"], f"""
SELECT *, {_TK('src')} AS st, {_TK('tgt')} AS tt FROM (SELECT file_id, pos, seq, {_NO} AS no, CASE WHEN seq % 71 = 0 THEN NULL ELSE start_ms END AS start_ms, {_END} AS end_ms, start_ms AS ts0,
 CASE WHEN h = 27 THEN 'ki ' || src WHEN h = 10 THEN regexp_replace(src, '[.!?…]+\\z', '') ELSE src END AS src,
 CASE WHEN h = 40 THEN tgt || ' de ğil' WHEN h = 41 THEN tgt || ' ' || lower(regexp_extract(text, '[A-Za-z]{{4,}}')) || 'ler' WHEN pos % 27 IN (5, 6) THEN tgt || ' alpha beta gamma'
  WHEN h = 42 THEN coalesce(lag(text) OVER (PARTITION BY file_id ORDER BY pos), tgt) WHEN h = 43 THEN coalesce(lag(tgt) OVER (PARTITION BY file_id ORDER BY pos), tgt) WHEN h = 44 THEN tgt || ' bcdfghjkl' ELSE tgt END AS tgt FROM cues)""")


def _places():
    return ["file_id", "pos", "seq", F.expr(_NO).alias("no"), F.when(F.col("seq") % 71 != 0, F.col("start_ms")).alias("start_ms"), F.expr(_END).alias("end_ms"), F.col("start_ms").alias("ts0")]


@memo
def fplaces(spark, sf):
    """``fpairs`` without texts."""
    return V.timed(spark, sf).select(*_places())


@memo
def fpairs(spark, sf):
    t, h = F.col("tgt"), F.col("h")
    tgt = (F.when(h == 40, F.concat(t, L1(" de ğil"))).when(h == 41, F.concat(t, L1(" "), F.lower(F.regexp_extract("text", "[A-Za-z]{4,}", 0)), L1("ler")))
           .when((F.col("pos") % 27).isin(5, 6), F.concat(t, L1(" alpha beta gamma"))).when(h == 42, F.coalesce("prev_text", t)).when(h == 43, F.coalesce("prev_tgt", t))
           .when(h == 44, F.concat(t, L1(" bcdfghjkl"))).otherwise(t))
    src = F.when(h == 27, F.concat(L1("ki "), "src")).when(h == 10, F.regexp_replace("src", r"[.!?…]+\z", "")).otherwise(F.col("src"))
    # A list of one: rules on the texts would else be moved into their making and make them once for every mention.
    e = explode_rows(V.timed(spark, sf), _places(), F.array(F.struct(src.alias("src"), tgt.alias("tgt"))))
    return e.select("file_id", "pos", "seq", "no", "start_ms", "end_ms", "ts0", "e.src", "e.tgt")


_N = lambda c, rx: f"len(regexp_extract_all({c}, {q(rx)}))"
_WORD = lambda words: q(r"(?:^|[^\p{L}])(?:" + words + r")(?:[^\p{L}]|$)")
_LINES = lambda c: f"len(list_filter(string_split({c}, chr(10)), lambda x: {STRIP('x')} <> ''))"
# Runs of n neighbouring tokens; the views hold the token lists of both texts (st, tt) and of the neighbours.
_ZIP = lambda c, n: f"list_filter(list_zip({', '.join(f'{c}[{i}:]' for i in range(1, n + 1))}), lambda z: z[{n}] IS NOT NULL)"
_TRI = lambda c: f"(len(list_filter({_ZIP(c, 3)}, lambda z: z[1] = z[2] AND z[1] = z[3])) > 0)"
_GR = lambda c, n: f"list_transform({_ZIP(c, n)}, lambda z: concat_ws(' ', {', '.join(f'z[{i}]' for i in range(1, n + 1))}))"
_SH = lambda a, b, n: f"(len(list_intersect({_GR(a, n)}, {_GR(b, n)})) > 0)"
_FS = "'[\\p{Cyrillic}\\p{Greek}\\p{Arabic}\\p{Hebrew}\\p{Han}\\p{Hiragana}\\p{Katakana}]'"
_ENDS = f"regexp_matches(%s, {q(T.SENTENCE_END)})"
_M = lambda c, rx: f"regexp_matches({c}, {q(rx)})"
_GARBLE = findings.GARBLE
_SUF = findings.SUFFIX

ROW_SQL = {
    "broken_italic": f"({_N('tgt', '<i>')} <> {_N('tgt', '</i>')} OR {_M('tgt', '<i>[^<]*<i>')})",
    "cue_id_leak": f"len(list_filter(regexp_extract_all(tgt, {q(findings.LEAK)}, 1), lambda x: abs(CAST(x AS BIGINT) - no) <= 3)) > 0",
    "english_filler": f"(regexp_matches(lower(tgt), {_WORD(findings.FILLERS)}) AND NOT regexp_matches(lower(src), {_WORD(findings.FILLERS)}))",
    "foreign_script": f"(regexp_matches(tgt, {_FS}) AND NOT regexp_matches(src, {_FS}))",
    "format_coverage_lost": f"(src LIKE '<i>%</i>' AND NOT contains(tgt, '<i>') AND {STRIP('tgt')} <> '')",
    "garble": f"({_M('lower(tgt)', _GARBLE)} AND NOT {_M('lower(src)', _GARBLE)})",
    "line_parity_mismatch": f"({_LINES('src')} > 0 AND {_LINES('tgt')} > 0 AND {_LINES('src')} <> {_LINES('tgt')})",
    "midword_space": f"regexp_matches(lower(tgt), {_WORD(findings.SPLIT_WORDS)})",
    "missing_predicate": f"({_ENDS % 'tgt'} AND len(regexp_extract_all(tgt, {q(T.TOKEN)})) >= 4 AND NOT regexp_matches(regexp_replace(lower(tgt), '[^\\p{{L}}]+$', ''), {q(findings.PREDICATE)}))",
    "ocr_artifact": f"({_M('tgt', findings.OCR)} AND NOT {_M('src', findings.OCR)})",
    "repetition_collapse": f"({STRIP('src')} <> '' AND {_TRI('tt')} AND NOT {_TRI('st')})",
    "residual_credit": _M("tgt", L.CREDIT),
    "residual_sdh": "contains(tgt, '[SIGHS]')",
    "residual_speaker_label": _M("tgt", L.SPEAKER_PREFIX),
    "reversed_timestamp": "end_ms < start_ms",
    "invalid_timestamp": "start_ms IS NULL OR end_ms IS NULL",
    "semantic_loss": f"({STRIP('tgt')} <> '' AND regexp_matches(lower(src), {_WORD('not|never|cannot|without')}) AND NOT {_M('lower(tgt)', findings.NEGATED)})",
    "serialized_json_residue": f"({_M('tgt', T.JSON_SEPARATOR)} OR {_M('tgt', T.JSON_ONLY)})",
    "source_residue": f"len(list_filter(list_filter(tt, lambda x: regexp_matches(x, '\\p{{L}}{{4,}}' || {q(_SUF)})), lambda x: list_contains(st, regexp_replace(x, {q(_SUF)}, '')) AND NOT list_contains(st, x))) > 0",
    "stray_line_initial_e": "regexp_matches(tgt, '(?m)^[ \\t]*e[ \\t]')",
    "translator_gloss": f"({STRIP('src')} <> '' AND regexp_matches(tgt, '\\([^)]{{2,}}\\)') AND NOT contains(src, '('))",
    "unbalanced_note": f"({_N('tgt', '♪')} % 2 = 1 AND {_N('src', '♪')} % 2 = 0)",
    "untranslated_fragment": _SH("st", "tt", 5),
}
V.add_view("row_found", ["fpairs"], " UNION ALL ".join(f"SELECT '{c}' AS class, file_id, pos FROM fpairs WHERE {cond}" for c, cond in ROW_SQL.items()))
_BOTH = lambda a, b: f"len(list_intersect({a}, {b}))"
V.add_view("near", ["fpairs"], """
SELECT *, coalesce(lag(src) OVER w, '') AS ps, coalesce(lag(tgt) OVER w, '') AS pt, coalesce(lead(src) OVER w, '') AS ns, coalesce(lead(tgt) OVER w, '') AS nt,
 coalesce(lag(st) OVER w, []) AS pst, coalesce(lag(tt) OVER w, []) AS ptt, coalesce(lead(st) OVER w, []) AS nst, coalesce(lead(tt) OVER w, []) AS ntt, lag(no) OVER w AS pn, lag(pos) OVER w AS pp FROM fpairs WINDOW w AS (PARTITION BY file_id ORDER BY pos)""")
_LONE = "(src = '[MUSIC PLAYING]')"
NEAR_SQL = {
    "duplicate_translation": f"tgt <> '' AND NOT {_LONE} AND regexp_matches(src, '\\p{{L}}{{2}}') AND ((tgt = pt AND src <> ps) OR (tgt = nt AND src <> ns))",
    "delivery_owner_mismatch": f"{_BOTH('tt', 'st')} = 0 AND greatest({_BOTH('tt', 'pst')}, {_BOTH('tt', 'nst')}) >= 3",
    "merged_into_neighbour": f"{STRIP('tgt')} = '' AND NOT {_LONE} AND regexp_matches(src, '^\\p{{Ll}}') AND pp IS NOT NULL AND NOT {_ENDS % 'ps'}",
    "partial_echo": f"({_SH('tt', 'ptt', 3)} AND NOT {_SH('st', 'pst', 3)}) OR ({_SH('tt', 'ntt', 3)} AND NOT {_SH('st', 'nst', 3)})",
    "non_monotonic_cue": "no <= pn",
    "signature_cue_id": f"{_M('tgt', L.CREDIT)} AND no <> CASE WHEN pn IS NULL THEN 0 ELSE pn + 1 END",
}
V.add_view("near_found", ["near"], " UNION ALL ".join(f"SELECT '{c}' AS class, file_id, pos FROM near WHERE {cond}" for c, cond in NEAR_SQL.items()))

_IDS = {
    "F1": "broken_italic", "F2": "cue_id_leak", "F6": "english_filler", "F9": "foreign_script", "F10": "format_coverage_lost", "F11": "garble", "F15": "invalid_timestamp",
    "F16": "line_parity_mismatch", "F18": "midword_space", "F20": "missing_predicate", "F22": "ocr_artifact", "F25": "repetition_collapse", "F26": "residual_credit", "F27": "residual_sdh",
    "F28": "residual_speaker_label", "F29": "reversed_timestamp", "F30": "semantic_loss", "F31": "serialized_json_residue", "F34": "source_residue", "F35": "stray_line_initial_e",
    "F37": "translator_gloss", "F38": "unbalanced_note", "F39": "untranslated_fragment",
    "F3": "delivery_owner_mismatch", "F5": "duplicate_translation", "F17": "merged_into_neighbour", "F21": "non_monotonic_cue", "F23": "partial_echo", "F32": "signature_cue_id",
}
for _id, _c in _IDS.items():
    _row = _c in ROW_SQL
    query(f"{_id}_{_c}", V.with_views("fpairs" if _row else "near", f"SELECT '{_c}' AS class, file_id, pos FROM {'fpairs' if _row else 'near'} WHERE {(ROW_SQL if _row else NEAR_SQL)[_c]}"))(
        lambda spark, sf, _c=_c, _row=_row: (findings.by_row if _row else findings.by_neighbour)(fpairs(spark, sf), [_c]))


@query("F4_duplicate_cue_ids", V.with_views("fpairs", "SELECT 'duplicate_cue_ids' AS class, file_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY file_id, no) AS n FROM fpairs) WHERE n > 1"))
def f4(spark, sf):
    return findings.duplicate_ids(fplaces(spark, sf))


for _id, _c in (("F7", "expected_removed"), ("F8", "extra_dialogue"), ("F19", "missing_dialogue")):
    query(f"{_id}_{_c}", V.with_views("gaps", f"SELECT class, file_id, pos FROM gaps WHERE class = '{_c}'"))(
        lambda spark, sf, _c=_c: gaps(spark, sf).filter(F.col("class") == _c).select("class", "file_id", "pos"))


@query("F12_inconsistent_repeat", V.with_views("fpairs", """
SELECT 'inconsistent_repeat' AS class, file_id, pos FROM fpairs JOIN (SELECT file_id, src FROM fpairs WHERE len(src) >= 30 GROUP BY 1, 2 HAVING count(DISTINCT tgt) > 1) USING (file_id, src)"""))
def f12(spark, sf):
    return repeats(spark, sf).select("class", "file_id", "pos")


def repeats(spark, sf):
    p, n = fpairs(spark, sf), F.xxhash64("file_id", "src")
    bad = cut(audit.inconsistent(p.filter("length(src) >= 30"), "file_id", "src", "tgt").withColumn("_n", n), "repeated")
    return prune.likely(p.withColumn("_n", n), bad, "_n").join(bad.drop("_n"), ["file_id", "src"]).withColumn("class", L1("inconsistent_repeat"))


for _id, _c, _s in (("F13", "inherited_out_of_order", "in_source"), ("F14", "introduced_out_of_order", "NOT in_source")):
    query(f"{_id}_{_c}", V.with_views("order_audit", f"SELECT '{_c}' AS class, file_id, seq FROM order_audit WHERE in_delivery AND {_s}"))(
        lambda spark, sf, _c=_c, _s=_s: order_audit(spark, sf).filter(f"in_delivery and {_s}").select(L1(_c).alias("class"), "file_id", "seq"))


@query("F24_quote_chain", V.with_views("quoted_runs", "SELECT 'quote_chain' AS class, file_id, min(seq) AS seq FROM quoted_runs WHERE q GROUP BY file_id, run HAVING count(*) >= 3"))
def f24(spark, sf):
    return quote_chains(V.cues(spark, sf), "tgt").select(L1("quote_chain").alias("class"), "file_id", "seq")


@query("F33_signature_overlap", V.with_views("fpairs", f"""
SELECT DISTINCT 'signature_overlap' AS class, g.file_id, g.pos FROM fpairs g JOIN fpairs c ON c.file_id = g.file_id AND c.pos <> g.pos AND c.start_ms < g.end_ms AND g.start_ms < c.end_ms AND c.start_ms <= c.end_ms AND g.start_ms <= g.end_ms WHERE {_M('g.tgt', L.CREDIT)}"""))
def f33(spark, sf):
    return findings.signature_overlaps(fpairs(spark, sf))


# Files whose delivery moved as a whole: no stamp is left, so cues are paired by their numbers.
V.add_view("mismatched", ["gap_src", "gap_dlv"], """
SELECT 'timestamp_mismatch' AS class, d.file_id, d.pos AS no, d.start_ms AS ts0 FROM gap_dlv d JOIN gap_src s USING (file_id, pos)
WHERE NOT EXISTS (SELECT 1 FROM gap_src x WHERE x.file_id = d.file_id AND x.start_ms = d.start_ms AND x.end_ms = d.end_ms) AND NOT EXISTS (SELECT 1 FROM gap_dlv x WHERE x.file_id = s.file_id AND x.start_ms = s.start_ms AND x.end_ms = s.end_ms)""")


def mismatched(spark, sf):
    s, d = (x.withColumn("cue_no", F.col("pos")) for x in gap_pair(spark, sf))
    return align.by_time(s, d).filter("how = 'number'").select(L1("timestamp_mismatch").alias("class"), "file_id", F.col("tgt_no").alias("no"), F.col("start_ms").alias("ts0"))


@query("F36_timestamp_mismatch", V.with_views("mismatched", "SELECT class, file_id, no FROM mismatched"))
def f36(spark, sf):
    return mismatched(spark, sf).drop("ts0")


# Assembly over all classes: those of the pairs with number and time of their row, those of the order
# audit and of quote chains with the row of their number, those of the two alignments with their own.
V.add_view("by_pos", ["row_found", "near_found"], f"""
SELECT * FROM row_found UNION ALL SELECT * FROM near_found UNION ALL SELECT 'duplicate_cue_ids', file_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY file_id, no) AS n FROM fpairs) WHERE n > 1
UNION ALL SELECT 'inconsistent_repeat', file_id, pos FROM fpairs JOIN (SELECT file_id, src FROM fpairs WHERE len(src) >= 30 GROUP BY 1, 2 HAVING count(DISTINCT tgt) > 1) USING (file_id, src)
UNION ALL SELECT 'signature_overlap', g.file_id, g.pos FROM fpairs g WHERE {_M('g.tgt', L.CREDIT)} AND g.start_ms <= g.end_ms AND EXISTS (SELECT 1 FROM fpairs c WHERE c.file_id = g.file_id AND c.pos <> g.pos AND c.start_ms < g.end_ms AND g.start_ms < c.end_ms AND c.start_ms <= c.end_ms)""")
V.add_view("by_seq", ["order_audit", "quoted_runs"], """
SELECT CASE WHEN in_source THEN 'inherited_out_of_order' ELSE 'introduced_out_of_order' END AS class, file_id, seq FROM order_audit WHERE in_delivery
UNION ALL SELECT 'quote_chain', file_id, min(seq) FROM quoted_runs WHERE q GROUP BY file_id, run HAVING count(*) >= 3""")
V.add_view("found", ["by_pos", "by_seq", "gaps", "mismatched"], """
SELECT class, file_id, no, ts0 FROM by_pos JOIN fpairs USING (file_id, pos) UNION ALL SELECT class, file_id, no, ts0 FROM by_seq JOIN fpairs USING (file_id, seq)
UNION ALL SELECT class, file_id, pos, start_ms FROM gaps UNION ALL SELECT class, file_id, no, ts0 FROM mismatched""")
_CONF = "CASE class " + " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in findings.CONFIDENCE.items()) + " END"
V.add_view("finding_rows", ["found"], f"""
SELECT left(sha256(class || '|' || stamp || '|' || file_id), 16) AS id, class, {_CONF} AS confidence, file_id, no, stamp FROM (SELECT *, {HMS.format('ts0')} AS stamp FROM found)""")


@memo
def found(spark, sf):
    """All findings, class group by class group: what one shuffles is gone before the next begins."""
    p, bare, cols = fpairs(spark, sf), fplaces(spark, sf), ["class", "file_id", "no", "ts0"]
    place = ["no", "ts0"]
    signed = bare.join(findings.signature_overlaps(p).drop("class"), ["file_id", "pos"], "left_semi").withColumn("class", L1("signature_overlap"))
    order = order_audit(spark, sf).filter("in_delivery").select(F.when(F.col("in_source"), "inherited_out_of_order").otherwise("introduced_out_of_order").alias("class"), "file_id", "seq")
    numbered = order.unionByName(quote_chains(V.cues(spark, sf), "tgt").select(L1("quote_chain").alias("class"), "file_id", "seq")).join(bare, ["file_id", "seq"])
    parts = [findings.by_neighbour(p, carry=place), repeats(spark, sf), gaps(spark, sf).select("class", "file_id", F.col("pos").alias("no"), F.col("start_ms").alias("ts0")),
             mismatched(spark, sf), findings.duplicate_ids(bare, place), signed, numbered, findings.by_row(p, carry=place)]
    return reduce(DataFrame.unionByName, [cut(part.select(*cols), "findings") for part in parts])


@memo
def finding_rows(spark, sf):
    return findings.rows(found(spark, sf), TC.format_ms(F.col("ts0")))


@query("F40_finding_rows", V.with_views("finding_rows", "SELECT * FROM finding_rows"))
def f40(spark, sf):
    return finding_rows(spark, sf)


@query("A27_finding_rollup", V.with_views("finding_rows", """
SELECT coalesce(class, '*') AS class, coalesce(confidence, '*') AS confidence, coalesce(CAST(file_id AS VARCHAR), '*') AS file_id, count(*) AS n FROM finding_rows GROUP BY GROUPING SETS ((class, confidence, file_id), (class, confidence), (confidence), ())"""))
def a27(spark, sf):
    conf = F.create_map(*[L1(x) for kv in findings.CONFIDENCE.items() for x in kv])
    f = found(spark, sf).select("class", F.try_element_at(conf, F.col("class")).alias("confidence"), F.col("file_id").cast("string").alias("file_id"))
    g = f.groupingSets([["class", "confidence", "file_id"], ["class", "confidence"], ["confidence"], []], "class", "confidence", "file_id").agg(F.count("*").alias("n"))
    return g.select(F.coalesce("class", L1("*")).alias("class"), F.coalesce("confidence", L1("*")).alias("confidence"), F.coalesce("file_id", L1("*")).alias("file_id"), "n")


@query("A28_delivery_gate", V.with_views("finding_rows", f"""
SELECT file_id, bool_or(confidence = 'kesin') AS scan_fails, bool_or(class IN ({', '.join(q(c) for c in findings.AUDIT_HARD)})) AS audit_fails, bool_or(confidence = 'kesin' OR class IN ({', '.join(q(c) for c in findings.AUDIT_HARD)})) AS fails FROM finding_rows GROUP BY 1"""))
def a28(spark, sf):
    return findings.gate(found(spark, sf))


@query("J23_decision_suppression", V.with_views("finding_rows", """
SELECT id, class, no FROM finding_rows WHERE no % 4 NOT IN (0, 1)"""))
def j23(spark, sf):
    f = finding_rows(spark, sf)
    k = F.col("no") % 4
    verdict = F.when(k == 0, "yanlis_alarm").when(k == 1, "duzeltildi").when(k == 2, "belki").otherwise("ertelendi")
    return findings.suppress(f, f.select("id", verdict.alias("verdict"))).select("id", "class", "no")


@query("T6_findings_by_tier", V.with_views("finding_rows", f"""
SELECT CAST(CASE confidence WHEN 'kesin' THEN 0 WHEN 'muhtemel' THEN 1 ELSE 2 END AS INTEGER) AS tier, id, class FROM finding_rows"""))
def t6(spark, sf):
    f = finding_rows(spark, sf)
    tier = F.when(F.col("confidence") == "kesin", 0).when(F.col("confidence") == "muhtemel", 1).otherwise(2)
    return f.select(tier.alias("tier"), "id", "class").orderBy("tier", "class", "id")
