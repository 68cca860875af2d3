"""Canon and glossary."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueflow.functions import keys as K
from cueflow.functions import text as T
from cueflow.operators import canon, ordered
from cueflow.plans import views as V
from cueflow.plans.registry import query
from cueflow.plans.registry import quoted as q
from cueflow.plans.text_queries import _FOLD, paths, series
from cueflow.session import memo, read_table, stored

L1 = F.lit

# Decisions: the first word of every line, decided in the episode of its document.
V.add_view("decisions", ["lines", "series"], f"""
SELECT l.lang AS show_name, regexp_extract(l.text, '[A-Za-z]{{4,}}') AS src, translate(regexp_extract(l.text, '[A-Za-z]{{4,}}'), '{V.VOWELS}', CASE WHEN l.file_id % 2 = 0 THEN '{V.SHIFTED}' ELSE '{V.VOWELS}' END) AS tgt,
 s.season, s.episode, row_number() OVER (ORDER BY l.file_id, l.seq) AS merge_seq FROM lines l JOIN series s ON s.doc_id = l.file_id WHERE regexp_matches(l.text, '[A-Za-z]{{4,}}')""")
V.add_view("canon_terms", ["decisions"], """
SELECT show_name, identity, src, tgt, season, episode, merge_seq FROM (SELECT *, row_number() OVER (PARTITION BY show_name, identity ORDER BY merge_seq) AS r FROM (
 SELECT *, CASE WHEN upper(src) = src THEN 'exact:' || src ELSE 'folded:' || lower(src) END AS identity FROM decisions WHERE NOT (lower(src) = lower(tgt) AND lower(src) = src))) WHERE r = 1""")


@memo
def decisions(spark, sf):
    # Order of arrival: a rank over (file, line), whatever the number of lines of a file.
    w = F.regexp_extract("text", "[A-Za-z]{4,}", 0)
    l = V.lines(spark, sf).withColumn("src", w).filter("src <> ''")
    tgt = F.when(F.col("file_id") % 2 == 0, F.translate("src", V.VOWELS, V.SHIFTED)).otherwise(F.col("src"))
    s = series(spark, sf).select(F.col("doc_id").alias("file_id"), "season", "episode")
    d = l.join(s, "file_id").select(F.col("lang").alias("show_name"), "src", tgt.alias("tgt"), "season", "episode", "file_id", "seq")
    return ordered.ranked(d, ["file_id", "seq"], "merge_seq").drop("file_id", "seq")


@stored("canon")
def canon_terms(spark, sf):
    return canon.first_terms(decisions(spark, sf), ["show_name"])


@query("A14_first_decision", V.with_views("canon_terms", "SELECT * FROM canon_terms"))
def a14(spark, sf):
    return canon_terms(spark, sf)


@query("A14b_character_enrichment", V.with_views("decisions", f"""
SELECT show_name, {_FOLD('src')} AS identity, arg_min(src, merge_seq) AS name, coalesce(arg_min(CASE WHEN merge_seq % 3 = 0 THEN 'style ' || merge_seq END, CASE WHEN merge_seq % 3 = 0 THEN merge_seq END), '') AS style FROM decisions GROUP BY 1, 2"""))
def a14b(spark, sf):
    d = decisions(spark, sf).withColumn("style", F.when(F.col("merge_seq") % 3 == 0, F.concat(L1("style "), F.col("merge_seq").cast("string"))).otherwise(""))
    return canon.first_characters(d.withColumnRenamed("src", "name"), ["show_name"]).select("show_name", "identity", "name", "style")


V.add_view("later", ["canon_terms"], "SELECT show_name, identity, tgt || '+' AS tgt FROM canon_terms WHERE merge_seq % 2 = 0 UNION ALL SELECT show_name, 'folded:new' || merge_seq, 'n' FROM canon_terms WHERE merge_seq % 5 = 0")
_MERGED = "SELECT show_name, identity, tgt FROM canon_terms WHERE merge_seq % 3 <> 0 UNION ALL SELECT * FROM later l WHERE NOT EXISTS (SELECT 1 FROM canon_terms c WHERE c.merge_seq % 3 <> 0 AND c.show_name = l.show_name AND c.identity = l.identity)"


def merged(spark, sf):
    c = canon_terms(spark, sf)
    disk = c.filter("merge_seq % 3 <> 0").select("show_name", "identity", "tgt")
    mem = c.filter("merge_seq % 2 = 0").select("show_name", "identity", F.concat("tgt", L1("+")).alias("tgt"))
    new = c.filter("merge_seq % 5 = 0").select("show_name", F.concat(L1("folded:new"), F.col("merge_seq").cast("string")).alias("identity"), L1("n").alias("tgt"))
    return canon.with_priority([disk, mem.unionByName(new)], ["show_name", "identity"])


@query("A15_canon_merge", V.with_views("later", _MERGED))
def a15(spark, sf):
    return merged(spark, sf)


@query("A16_glossary_merge", V.with_views("decisions", """
SELECT show_name, src, arg_min(tgt, merge_seq) AS tgt FROM decisions GROUP BY 1, 2"""))
def a16(spark, sf):
    # Set-default per key: the earliest value stays.
    return decisions(spark, sf).groupBy("show_name", "src").agg(F.min_by("tgt", "merge_seq").alias("tgt"))


@query("A17_address_split", V.with_views("canon_terms", """
SELECT show_name, src || '-' || nx AS pair, fa AS a, fb AS b FROM (SELECT c.show_name, c.src, c.nx, x.name AS fa, y.name AS fb FROM (SELECT show_name, src, lead(src) OVER (PARTITION BY show_name ORDER BY merge_seq) AS nx FROM canon_terms) c
 JOIN (SELECT show_name, lower(src) AS k, min(src) AS name FROM canon_terms GROUP BY 1, 2) x ON x.show_name = c.show_name AND x.k = lower(c.src) JOIN (SELECT show_name, lower(src) AS k, min(src) AS name FROM canon_terms GROUP BY 1, 2) y ON y.show_name = c.show_name AND y.k = lower(c.nx) WHERE lower(c.src) <> lower(c.nx))"""))
def a17(spark, sf):
    names = canon_terms(spark, sf).select("show_name", F.col("src").alias("name"), "merge_seq")
    d = ordered.ranked(names, ["merge_seq"], "n", ["show_name"])
    d = ordered.with_window(d, ["show_name"], "n", {"nx": lambda w: F.lead("name").over(w)}, 0, 1).filter("nx is not null")
    pairs = d.select("show_name", F.concat_ws("-", "name", "nx").alias("pair"), L1("sen").alias("register"))
    return canon.split_pairs(pairs, names, ["show_name"]).select("show_name", "pair", "a", "b")


@query("A34_memory_sections", V.with_views(["canon_terms", "decisions"], f"""
SELECT t.show_name, terms, characters FROM (SELECT show_name, count(*) AS terms FROM canon_terms GROUP BY 1) t JOIN (SELECT show_name, count(DISTINCT {_FOLD('src')}) AS characters FROM decisions GROUP BY 1) c USING (show_name)"""))
def a34(spark, sf):
    t = canon_terms(spark, sf).groupBy("show_name").agg(F.count("*").alias("terms"))
    return t.join(decisions(spark, sf).groupBy("show_name").agg(F.count_distinct(K.identity(F.col("src"))).alias("characters")), "show_name")


@query("W12_canon_as_of", V.with_views("canon_terms", """
SELECT show_name, src, tgt FROM canon_terms WHERE season IS NULL OR season < 2 OR (season = 2 AND episode < 5)"""))
def w12(spark, sf):
    return canon.visible(canon_terms(spark, sf), L1(2), L1(5)).select("show_name", "src", "tgt")


V.add_view("ranked_terms", ["canon_terms"], "SELECT *, row_number() OVER (PARTITION BY show_name ORDER BY merge_seq) AS i, count(*) OVER (PARTITION BY show_name) AS n FROM canon_terms")


@query("W13_core_and_recent", V.with_views("ranked_terms", "SELECT show_name, src FROM ranked_terms WHERE n <= 80 OR i <= 40 OR i > n - 40"))
def w13(spark, sf):
    d = ordered.ranked(canon_terms(spark, sf).select("show_name", "src", "merge_seq"), ["merge_seq"], "i", ["show_name"])
    n = d.groupBy("show_name").agg(F.count("*").alias("n"))
    return canon.core_and_recent(d.join(n, "show_name"), "i", "n", canon.LIMITS["terms"]).select("show_name", "src")


@query("X1_term_filter", V.with_views("canon_terms", "SELECT show_name, src FROM canon_terms WHERE len(src) > 6"))
def x1(spark, sf):
    return filtered(canon_terms(spark, sf), lambda c: F.length(c) > 6).select("show_name", "src")


def filtered(terms, term_filter):
    """A user's ``Column -> Column`` on the terms; a filter that fails leaves no term."""
    try:
        return terms.filter(term_filter(F.col("src")))
    except Exception:
        return terms.limit(0)


V.add_view("prefs", [], "SELECT user_id, event_type AS original, 'series' AS scope, max(event_id) AS preferred FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT user_id, event_type, 'episode', max(event_id) FROM events WHERE event_id % 7 = 0 GROUP BY 1, 2")
_PREF = "SELECT user_id, original, arg_min(preferred, CASE scope WHEN 'episode' THEN 0 ELSE 1 END) AS preferred, arg_min(scope, CASE scope WHEN 'episode' THEN 0 ELSE 1 END) AS scope FROM prefs GROUP BY 1, 2"


def prefs(spark, sf, scope):
    e = read_table(spark, sf, "events").filter("event_id % 2 = 0" if scope == "series" else "event_id % 7 = 0")
    return e.groupBy("user_id", F.col("event_type").alias("original")).agg(F.max("event_id").alias("preferred")).withColumn("scope", L1(scope))


@query("J14_preference_overlay", V.with_views("prefs", _PREF))
def j14(spark, sf):
    return canon.with_priority([prefs(spark, sf, "episode"), prefs(spark, sf, "series")], ["user_id", "original"])


@query("U3_priority_union", V.with_views("prefs", "SELECT scope, count(*) AS n FROM (" + _PREF + ") GROUP BY 1"))
def u3(spark, sf):
    return canon.with_priority([prefs(spark, sf, "episode"), prefs(spark, sf, "series")], ["user_id", "original"]).groupBy("scope").agg(F.count("*").alias("n"))


# Glossary: the longer words of at least 30 places in the corpus, and every four-word line start of at least 3.
V.add_view("gloss", ["lines"], f"""
SELECT term, translate(term, '{V.VOWELS}', '{V.SHIFTED}') AS rendering FROM (
 SELECT lower(tok) AS term FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}')) AS tok FROM lines) GROUP BY 1 HAVING count(*) >= 30
 UNION ALL SELECT lower(start) FROM (SELECT regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ [A-Za-z]{{3,}}') AS start FROM lines) WHERE start <> '' GROUP BY 1 HAVING count(*) >= 3)""")


@memo
def gloss(spark, sf):
    c = V.lines(spark, sf)
    words = c.select(F.explode(F.regexp_extract_all("text", L1("[A-Za-z]{5,}"), L1(0))).alias("tok")).groupBy(F.lower("tok").alias("term")).agg(F.count("*").alias("n")).filter("n >= 30")
    starts = c.select(F.lower(F.regexp_extract("text", "^[A-Za-z]+ [A-Za-z]+ [A-Za-z]+ [A-Za-z]{3,}", 0)).alias("term")).filter("term <> ''").groupBy("term").agg(F.count("*").alias("n")).filter("n >= 3")
    return words.unionByName(starts).select("term", F.translate("term", V.VOWELS, V.SHIFTED).alias("rendering"))


# The SQL side lists every word and every run of four words, and every form of a term.
_TKG = f"list_transform(regexp_extract_all(lower(replace(src, '’', '''')), {q(T.TOKEN)}), lambda x: regexp_replace(x, '''s$', ''))"
V.add_view("grams", ["pairs"], f"""
SELECT file_id, seq, source, tgt, unnest(list_distinct(list_concat(tk, list_transform(range(1, CAST(greatest(len(tk) - 2, 1) AS BIGINT)), lambda i: array_to_string(tk[i:i + 3], ' '))))) AS gram FROM (SELECT *, {_TKG} AS tk FROM pairs)""")
V.add_view("hits", ["grams", "gloss"], """
SELECT DISTINCT p.file_id, p.seq, p.source, g.term, g.rendering, p.tgt FROM grams p JOIN (SELECT *, term AS form FROM gloss UNION ALL SELECT *, term || 's' FROM gloss) g ON p.gram = g.form""")


@query("J19_glossary_match", V.with_views("hits", "SELECT DISTINCT file_id, seq, term FROM hits"))
def j19(spark, sf):
    p = V.pairs(spark, sf).select("file_id", "seq", "src")
    return canon.term_hits(p, gloss(spark, sf), "src").select("file_id", "seq", "term")


_LACK = f"NOT contains(' ' || array_to_string(regexp_extract_all(lower(replace(tgt, '’', '''')), {q(T.TOKEN)}), ' ') || ' ', ' ' || rendering || ' ')"


@query("J20_glossary_miss", V.with_views("hits", f"SELECT DISTINCT file_id, seq, 'GLOSS_MISS:' || term || '=>' || rendering AS miss FROM hits WHERE {_LACK}"))
def j20(spark, sf):
    p = V.pairs(spark, sf).select("file_id", "seq", "src", "tgt")
    return canon.glossary_misses(p, gloss(spark, sf)).select("file_id", "seq", "miss")


V.add_view("done_seasons", ["series"], "SELECT show_name, season FROM series WHERE season IS NOT NULL GROUP BY 1, 2 HAVING bool_and(doc_id % 50 <> 0) AND count(*) > 1")


def done_seasons(spark, sf):
    s = series(spark, sf).filter("season is not null")
    return s.groupBy("show_name", "season").agg(F.bool_and(F.col("doc_id") % 50 != 0).alias("done"), F.count("*").alias("n")).filter("done and n > 1").select("show_name", "season")


@query("J25_season_gate", V.with_views("done_seasons", "SELECT * FROM done_seasons"))
def j25(spark, sf):
    return done_seasons(spark, sf)


@query("J21_season_suspects", V.with_views(["hits", "done_seasons", "series"], """
SELECT DISTINCT s.show_name, s.season, h.file_id, h.seq, h.term FROM hits h JOIN series s ON s.doc_id = h.file_id JOIN done_seasons d ON d.show_name = s.show_name AND d.season = s.season WHERE NOT contains(lower(h.tgt), h.rendering)"""))
def j21(spark, sf):
    ep = series(spark, sf).join(done_seasons(spark, sf), ["show_name", "season"], "left_semi").select(F.col("doc_id").alias("file_id"), "show_name", "season")
    p = V.pairs(spark, sf).select("file_id", "seq", "src", "tgt").join(ep, "file_id")
    return canon.glossary_misses(p, gloss(spark, sf), inflected=True).select("show_name", "season", "file_id", "seq", "term")


@query("T1_files_by_episode", V.with_views("series", """
SELECT doc_id, CASE WHEN doc_id % 8 = 4 THEN 'big-show' ELSE show_name END AS show_name FROM series ORDER BY show_name IS NULL, 2, season, episode, path, doc_id"""))
def t1(spark, sf):
    s = series(spark, sf)
    # A global sort is range-partitioned; no single task holds the list.
    return s.orderBy(F.isnull("show_name"), "show_name", "season", "episode", "path", "doc_id").select("doc_id", "show_name")
