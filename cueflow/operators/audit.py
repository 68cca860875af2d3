"""Per-file shares, gates, histograms and counts over cue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.functions import labels as L
from cueflow.functions import text as T
from cueflow.functions import timecode as TC
from cueflow.functions import turkish as TR
from cueflow.operators import prune
from cueflow.session import cut


def reading_speed(cues: DataFrame, text: str, warn_cps: int = 24, target_cps: int = 21) -> DataFrame:
    """Characters per second as integer comparisons; failed or timeless cues are left out."""
    chars = F.length(F.regexp_replace(T.visible(F.col(text)), "\n", "")).cast("bigint")
    c = cues.filter((F.col("dur_ms") > 0) & ~F.col(text).rlike(T.FAILURE)).withColumn("chars", chars)
    return (
        c.withColumn("fast", F.col("chars") * 1000 > warn_cps * F.col("dur_ms"))
        .withColumn("over_target", F.col("chars") * 1000 > target_cps * F.col("dur_ms"))
        .withColumn("char_budget", F.expr(f"{target_cps} * dur_ms div 1000"))
    )


def caps_share(cues: DataFrame, key: str, text: str) -> DataFrame:
    """Per file: cues with at least four letters, and how many of them are all capitals."""
    letters = F.regexp_replace(F.regexp_replace(F.col(text), T.MARKUP, ""), r"[^\p{L}]", "")
    c = cues.select(key, letters.alias("_l")).filter(F.length("_l") >= 4)
    return c.groupBy(key).agg(F.count("*").alias("eligible"), F.count_if(~F.col("_l").rlike(r"[^\p{Lu}]")).alias("caps"))


def caps_gate(cues: DataFrame, key: str, text: str, share: int = 60, least: int = 8) -> DataFrame:
    """Whether capitals tell a label from speech in this file."""
    s = caps_share(cues, key, text)
    return s.withColumn("allow", (F.col("eligible") >= least) & (F.col("caps") * 100 <= F.col("eligible") * share))


def label_only_allowed(cues: DataFrame, key: str, text: str) -> DataFrame:
    """``only`` narrowed by the caps gate: bracket labels always count, bare capitals only if allowed."""
    gate = caps_gate(cues, key, text).select(key, "allow")
    bracketed = F.col(text).rlike(L.GROUP) | F.col(text).rlike(L.NOTES)
    return cues.join(gate, key, "left").withColumn("label_only", F.col("only") & (bracketed | F.coalesce("allow", F.lit(False))))


def bucket(value: Column, edges: tuple[int, ...]) -> Column:
    """Label of the first edge that holds the value: ``<=12``, ``12-17``, ..., ``>30``."""
    out = F.when(value <= edges[0], f"<={edges[0]}")
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(value <= hi, f"{lo}-{hi}")
    return out.otherwise(f">{edges[-1]}")


def precheck(cues: DataFrame, key: str, text: str, raw: str, warn_pct: int = 30, min_cues: int = 40, mojibake_hits: int = 10) -> DataFrame:
    """Warnings per file: few cues end a sentence, or the text was read in a wrong encoding."""
    full = F.trim(text) != ""
    g = cues.groupBy(key).agg(
        F.count_if(full).alias("n"), F.count_if(full & F.col(text).rlike(T.LINE_END)).alias("ends"),
        F.sum(F.regexp_count(raw, F.lit(T.MOJIBAKE))).cast("bigint").alias("hits"),
    )
    rows = F.array_compact(F.array(
        F.when((F.col("n") >= min_cues) & (F.col("ends") * 100 < warn_pct * F.col("n")),
               F.struct(F.lit("noktalama").alias("kind"), F.lit("uyari").alias("level"), F.expr("ends * 100 div n").alias("measure"))),
        F.when(F.col("hits") >= mojibake_hits, F.struct(F.lit("kodlama").alias("kind"), F.lit("kritik").alias("level"), F.col("hits").alias("measure"))),
    ))
    return g.select(key, F.explode(rows).alias("w")).select(key, "w.*")


def line_metrics(cues: DataFrame, key: str, text: str, width: int = 42) -> DataFrame:
    wide = F.filter("_l", lambda x: F.length(T.visible(x)) > width)
    c = cues.withColumn("_l", F.split(text, "\n"))
    c = c.select(
        key, text, F.size("_l").alias("lines"), F.size(wide).alias("wide"), F.size(F.filter("_l", lambda x: F.length(T.visible(x)) == 1)).alias("ones"),
        F.size(F.filter(wide, lambda x: ~x.rlike(r"\S\s+\S"))).alias("solid"),
    )
    return c.groupBy(key).agg(
        F.count("*").alias("cues"), F.count_if(F.col("lines") > 2).alias("over_2_lines"), F.sum("wide").cast("bigint").alias("over_42_lines"),
        F.sum("ones").cast("bigint").alias("one_char_lines"), F.count_if(F.col(text).rlike(r"[<{]") & (F.col("wide") > 0)).alias("tagged_over_42"),
        F.count_if(F.col("solid") > 0).alias("long_single_word"),
    )


def register_mix(cues: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    """Cues with a singular (informal) and a plural or polite address; plural forms are formal."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    formal = F.exists(toks, lambda t: t.rlike(r"(?:s[ıiuü]n|[dt][ıiuü]n|s[ae]n)[ıiuü]z$") | t.rlike(r"^siz(?:i|e|in|den|de)?$"))
    informal = F.exists(toks, lambda t: TR.second_person(t) | t.rlike(r"^(?:sen|seni|sana|senin|sende|senden)$"))
    g = cues.select(key, informal.alias("i"), formal.alias("f")).groupBy(key).agg(F.count_if("i").alias("informal"), F.count_if("f").alias("formal"))
    return g.withColumn("mixed", (F.col("informal") + F.col("formal") >= least) & (F.col("informal") > 0) & (F.col("formal") > 0))


def stem_classes(forms: DataFrame, keys: list[str], form: str, least: int = 3) -> DataFrame:
    """``keys``, ``form``, ``stem``: forms of one group are in one class if they are suffix forms of a common stem, directly or through others.

    A form's stems are its own beginnings of ``least`` letters or more whose rest splits into known suffixes; so
    their number is bounded by the form's length. Classes are the connected components of forms and stems: both
    take the least name near them until nothing changes.
    """
    cut_at = F.transform(F.sequence(F.least(F.lit(least), F.length(form)), F.length(form)), lambda i: F.substring(form, F.lit(1), i))
    e = forms.select(*keys, form).distinct().withColumn("stem", F.explode(F.filter(cut_at, lambda p: TR.suffix_form(F.col(form), p))))
    e = cut(e.withColumn("name", F.col("stem")), "stems")
    while True:
        by_form = e.groupBy(*keys, form).agg(F.min("name").alias("_f"))
        named = e.join(by_form, [*keys, form])
        by_stem = named.groupBy(*keys, "stem").agg(F.min("_f").alias("_s"))
        new = cut(e.join(by_stem, [*keys, "stem"]).select(*keys, form, "stem", F.col("_s").alias("name"), (F.col("_s") != F.col("name")).alias("_moved")), "stems")
        e = new.drop("_moved")
        if new.filter("_moved").isEmpty():
            return e.groupBy(*keys, form).agg(F.min("name").alias("stem"))


def mixed_renderings(terms: DataFrame, least: int = 4, repeated: int = 2) -> DataFrame:
    """Terms with more than one repeated rendering, inflected forms of one stem taken together. ``terms``: term, rendering."""
    low = F.lower(F.translate("rendering", "İ", "i")).alias("form")
    n = terms.groupBy("term", low).agg(F.count("*").alias("n"))
    n = n.join(stem_classes(n, ["term"], "form"), ["term", "form"]).groupBy("term", "stem").agg(F.sum("n").alias("n"))
    g = n.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("renderings"), F.count_if(F.col("n") >= repeated).alias("_r"))
    return g.filter((F.col("total") >= least) & (F.col("_r") > 1)).drop("_r")


def script_ratio(texts: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    n = lambda rx: F.regexp_count(text, F.lit(rx))
    c = texts.select(
        key, n(r"\p{L}").alias("letters"), n(r"[\p{IsCyrillic}\p{IsGreek}]").alias("nonlatin"), n(r"\p{IsCyrillic}").alias("cyr"),
        n("[А-ЯЁ]").alias("up"), n("[АЕИОУЫЭЮЯаеиоуыэюя]").alias("vowels"),
    ).filter(F.col("letters") >= least)
    bad = F.expr("up * 10 > cyr * 9 and vowels * 100 < cyr * 35 and cyr >= 5")
    return c.select(key, F.expr("cast(nonlatin as bigint) * 100 div letters").alias("nonlatin_pct"), F.when(bad, "suspect").otherwise("ok").alias("state"))


def inconsistent(pairs: DataFrame, key: str, src: str, tgt: str) -> DataFrame:
    """Sources of a file with more than one target; two extremes tell, nothing is collected.

    Most sources stand once, which a number of 64 bits in place of the text tells; the texts of those whose number
    comes again are compared as they are. A number that two sources share costs a comparison and changes no result.
    """
    d = pairs.withColumn("_n", F.xxhash64(key, src))
    again = d.groupBy("_n").agg(F.count("*").alias("_again")).filter("_again > 1").select("_n")
    # A plain join, as "again" has a number once: Spark would move a semi join below the bit map.
    some = prune.likely(d, again, "_n").join(again, "_n")
    return some.groupBy(key, src).agg(F.min(tgt).alias("a"), F.max(tgt).alias("b")).filter("a <> b").select(key, src)


def sweep(pairs: DataFrame, key: str, src: str, tgt: str, min_words: int = 4, minority_pct: int = 34) -> DataFrame:
    """Rows whose rendering is a small minority, with the majority rendering to use instead."""
    n = pairs.groupBy(key, src, tgt).agg(F.count("*").alias("n")).filter(F.size(F.split(src, " ")) >= min_words)
    top = n.groupBy(key, src, "n").agg(F.count("*").alias("ties"), F.max(tgt).alias("best"))
    g = top.groupBy(key, src).agg(F.max(F.struct("n", "ties", "best")).alias("m"), F.sum(F.col("n") * F.col("ties")).alias("total"))
    g = g.filter("m.ties = 1 and m.n < total").select(key, src, F.col("m.best").alias("fixed"), "total")
    small = n.join(g, [key, src]).filter((F.col(tgt) != F.col("fixed")) & (F.col("n") * 100 <= minority_pct * F.col("total"))).select(key, src, tgt, "fixed")
    return pairs.join(small, [key, src, tgt])


def duplicates(keyed: DataFrame, kind: str) -> DataFrame:
    """Rows of ``keyed(doc_id, key)`` whose key is not theirs alone."""
    again = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return keyed.join(again, "key", "left_semi").select("doc_id", F.lit(kind).alias("kind"))


def unusable(files: DataFrame, key: str, text: str, hours: int = 2) -> DataFrame:
    """Issue rows: empty, binary, no cues, one download placeholder that spans hours."""
    t = F.col(text)
    stamp = r"(\d+:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d+:\d{2}:\d{2}[,.]\d{3})"
    span = TC.parse_ms(F.regexp_extract(t, stamp, 2)) - TC.parse_ms(F.regexp_extract(t, stamp, 1))
    issue = lambda cond, name: F.when(cond, F.lit(name))
    issues = F.array_compact(F.array(
        issue(T.strip(t) == "", "empty"), issue(t.rlike("[\u0001-\u0008\u000e-\u001f]"), "binary"), issue(~t.contains("-->"), "no_cues"),
        issue((F.regexp_count(t, F.lit(stamp)) == 1) & (span >= hours * 3_600_000), "placeholder"),
    ))
    return files.select(key, F.explode(issues).alias("issue"))


def name_locks(tokens: DataFrame, key: str, tok: str, stop=(), least: int = 2) -> DataFrame:
    """Words of a file that are capitalised again and again and never in lower case."""
    cap = F.col(tok).rlike(r"^\p{Lu}")
    g = tokens.groupBy(key, F.lower(tok).alias("k")).agg(F.min(F.when(cap, F.col(tok))).alias("name"), F.count_if(cap).alias("cap"), F.count_if(~cap).alias("low"))
    return g.filter((F.col("cap") >= least) & (F.col("low") == 0) & (F.length("k") >= 3) & ~F.col("k").isin(*stop)).select(key, "name")
