"""Subtitle files to cue tables.

A file arrives as one row, so every parser works on that row (split, transform, filter) and
explodes once at the end: no shuffle, and no task sees more than the file it was given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueflow.functions import text as T
from cueflow.functions import timecode as TC
from cueflow.operators import ordered
from cueflow.session import cut, explode_rows

MARK = "\u0001"
SRT_TIME = r"\d+:\d{2}:\d{2}[,.]\d{3}[ \t]*-->[ \t]*\d+:\d{2}:\d{2}[,.]\d{3}"
SRT_HEAD = rf"(?m)^[ \t]*(?:\d+[ \t]*\n[ \t]*)?{SRT_TIME}[^\n]*$"
VTT_STAMP = r"(?:\d+:)?\d{1,2}:\d{2}(?:[.,]\d+)?"
VTT_HEAD = rf"(?m)^(?:(?:(?<=\n\n)[^\n]+|\d+[ \t]*|(?i:cue|note)[-_.:]?\d[^\n]*)\n)?[ \t]*{VTT_STAMP}[ \t]*-->[^\n]*$"
VTT_SKIP = r"(?m)^(?:NOTE|STYLE|REGION)(?:[ \t][^\n]*)?\n(?:(?![^\n]*-->)(?![^\n]+\n[^\n]*-->)[^\n]+\n)*"

# Style and name words of ASS files that are no speech.
SKIPPED_STYLES = r"(?i)^(?:credit|note)$"
TECHNICAL_NAMES = (
    "default def main alt alternate sign signs signtext top bottom left right overlap staff caption captions title "
    "titles text comment note notes credit credits op ed opening ending karaoke song lyrics italics flashback "
    "narration screen onscreen subtitle subtitles dialogue dialog style fx effect effects"
).split()
FX_WORDS = "spark sparks glow glowing flash flare shimmer".split()
ASS_COMMENT = (
    r"(?i)\{=[^}]*\}|\{(?![^}]*\\)\s*(?:tl\s*note|t/n|çn|ç/n|note|not|sfx|scene|sahne|music|müzik|song|şarkı|"
    r"translator|çevirmen|comment|yorum)\b[^}]*\}"
)
ASS_COLUMNS = "marked,start,end,style,name,marginl,marginr,marginv,effect,text"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Subtitle files below ``root`` as (path, content); contents are read only if selected."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{srt,vtt,ass,ssa}").load(root)
    )


def _newlines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "^[﻿\n ]+|[\n ]+$", "")


def _pieces(content: Column, head: str) -> Column:
    """Text from each cue head to the next one."""
    marked = F.regexp_replace(content, head, MARK + "$0")
    return F.slice(F.split(marked, MARK), 2, 1 << 30)


def parse_srt(files: DataFrame, key: str, content: str, keep_empty: bool = False) -> DataFrame:
    """(key, pos, cue_no, start_ms, end_ms, text).

    Ids are kept if every cue has one and they rise strictly; otherwise cues count from 1.
    """
    def cue(p: Column) -> Column:
        head = F.regexp_extract(p, rf"^[ \t]*(?:(\d+)[ \t]*\n[ \t]*)?{SRT_TIME}", 1)
        stamp = lambda i: TC.parse_ms(F.regexp_extract(p, r"(\d+:\d{2}:\d{2}[,.]\d{3})[ \t]*-->[ \t]*(\d+:\d{2}:\d{2}[,.]\d{3})", i))
        body = F.regexp_replace(p, r"^[ \t]*(?:\d+[ \t]*\n[ \t]*)?[^\n]*-->[^\n]*\n?", "")
        lines = F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\S")), lambda x: F.regexp_replace(x, r"\s+$", ""))
        return F.struct(
            head.try_cast("bigint").alias("no"), stamp(1).alias("start_ms"), stamp(2).alias("end_ms"),
            T.strip(F.array_join(lines, "\n")).alias("text"),
        )

    cues = F.transform(_pieces(_newlines(F.col(content)), SRT_HEAD), cue)
    f = files.select(key, cues.alias("c"))
    if not keep_empty:
        f = f.withColumn("c", F.filter("c", lambda x: x["text"] != ""))
    nos = F.transform("c", lambda x: x["no"])
    rising = F.forall(
        F.zip_with(F.slice(nos, 1, F.greatest(F.size(nos) - 1, F.lit(0))), F.slice(nos, 2, F.greatest(F.size(nos) - 1, F.lit(0))), lambda a, b: F.coalesce(a < b, F.lit(False))),
        lambda x: x,
    )
    valid = rising & F.forall(nos, lambda n: n.isNotNull())
    e = explode_rows(f, [key, valid.alias("valid")], F.col("c")).withColumnRenamed("e", "c")
    return e.select(
        key, (F.col("p") + 1).cast("bigint").alias("pos"),
        F.when(F.col("valid"), F.col("c.no")).otherwise((F.col("p") + 1).cast("bigint")).alias("cue_no"),
        "c.start_ms", "c.end_ms", "c.text",
    )


def parse_vtt(files: DataFrame, key: str, content: str) -> DataFrame:
    """Header, NOTE, STYLE and REGION blocks skipped, media offset added, entities decoded."""
    body = F.regexp_replace(_newlines(F.col(content)), VTT_SKIP, "")
    offset = F.round(TC.hls_offset_ms(F.col(content))).cast("bigint")

    def cue(p: Column) -> Column:
        stamp = lambda i: TC.parse_ms(F.regexp_extract(p, rf"({VTT_STAMP})[ \t]*-->[ \t]*({VTT_STAMP})", i))
        rest = F.regexp_replace(p, r"^(?:[^\n]*\n)?[^\n]*-->[^\n]*\n?", "")
        lines = F.transform(F.split(F.regexp_replace(rest, r"(?s)(?:^|\n)[ \t]*\n.*$", ""), "\n"), T.strip)
        return F.struct(stamp(1).alias("start_ms"), stamp(2).alias("end_ms"), T.decode_entities(F.array_join(lines, "\n")).alias("text"))

    bare = lambda t: T.strip(F.regexp_replace(t, r"(?i)<\d+:\d{2}(?::\d{2})?[.,]\d{3}>|</?(?:b|i|u|c|v|lang|ruby|rt)(?:[.\s][^>]*)?>", ""))
    cues = F.filter(F.transform(_pieces(body, VTT_HEAD), cue), lambda x: bare(x["text"]) != "")
    e = explode_rows(files, [key, offset.alias("o")], cues).withColumnRenamed("e", "c")
    zero = F.lit(0).cast("bigint")
    pos = (F.col("p") + 1).cast("bigint")
    return e.select(key, pos.alias("pos"), pos.alias("cue_no"), F.greatest(F.col("c.start_ms") + F.col("o"), zero).alias("start_ms"),
                    F.greatest(F.col("c.end_ms") + F.col("o"), zero).alias("end_ms"), "c.text")


def invisible_styles(content: Column) -> Column:
    """Names of styles whose primary colour has an alpha of FF."""
    def names(section: Column, cols: Column) -> Column:
        lines = F.transform(F.split(section, "\n"), T.strip)
        at = lambda row, name: T.strip(F.coalesce(F.try_element_at(row, F.array_position(cols, name).cast("int")), F.lit("")))
        styles = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("style:")), lambda x: F.split(F.substring(x, 7, 1 << 30), ","))
        has = (F.array_position(cols, "name") > 0) & (F.array_position(cols, "primarycolour") > 0)
        hidden = F.filter(styles, lambda r: at(r, "primarycolour").rlike(r"(?i)^&HFF[0-9a-f]{6}&?$"))
        return F.when(has, F.transform(hidden, lambda r: at(r, "name"))).otherwise(F.array().cast("array<string>"))

    # The section and its columns are found once in the text, not for every style.
    fmt = lambda section: F.regexp_extract(section, r"(?im)^\s*Format\s*:([^\n]*)$", 1)
    cols = lambda section: F.transform(F.split(fmt(section), ","), lambda x: F.lower(T.strip(x)))
    section = F.regexp_extract(content, r"(?is)\[V4\+? Styles\](.*?)(?:\n\s*\[|\z)", 1)
    return T.let(section, lambda sec: T.let(cols(sec), lambda c: names(sec, c)))


def _clean_ass(c: Column, wrap: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, ASS_COMMENT, ""), T.OVERRIDE, "")
    return T.strip(_breaks(c, wrap))


def _breaks(c: Column, wrap: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\\N", "\n"), r"\\[hH]", " ")
    return F.when(wrap == 2, F.regexp_replace(c, r"\\n", "\n")).otherwise(F.regexp_replace(c, r"\\n", " "))


def parse_ass_events(files: DataFrame, key: str, content: str) -> DataFrame:
    """Visible dialogue events in start order: (key, pos, start_ms, end_ms, style, text)."""
    # Line ends and the section of events are found once; each is read several times below.
    files = files.select(key, F.regexp_replace(F.col(content), "\r\n?", "\n").alias("_c"))
    c, section = F.col("_c"), F.regexp_extract("_c", r"(?ims)^\s*\[Events\]\s*$(.*?)(?=^\s*\[[^\n]+\]\s*$|\z)", 1)
    files = files.withColumn("_e", section).withColumn("_e", F.when(F.col("_e") == "", c).otherwise(F.col("_e")))
    events = F.col("_e")
    fmt = F.regexp_extract(events, r"(?im)^\s*Format\s*:\s*([^\n]*?)\s*$", 1)
    cols = F.transform(F.split(F.when(fmt == "", ASS_COLUMNS).otherwise(fmt), ","), lambda x: F.lower(T.strip(x)))
    wrap = F.coalesce(F.regexp_extract(c, r"(?im)^\s*WrapStyle\s*:\s*([0-9]+)\s*$", 1).try_cast("int"), F.lit(0))
    base = files.select(
        key, cols.alias("cols"), wrap.alias("wrap"), TC.timer_scale(c).alias("scale"), invisible_styles(c).alias("hidden"),
        F.filter(F.transform(F.split(events, "\n"), T.strip), lambda x: F.lower(x).startswith("dialogue:")).alias("rows"),
    )
    at = lambda r, name: F.coalesce(F.try_element_at(r, F.array_position(F.col("cols"), name).cast("int")), F.lit(""))

    def event(x: Column, i: Column) -> Column:
        return T.let(F.split(T.strip(F.substring(x, 10, 1 << 30)), ",", F.size("cols")), lambda r: fields(r, i))

    def fields(r: Column, i: Column) -> Column:
        ms = lambda n: F.round(TC.parse_ms(at(r, n)) * F.col("scale")).cast("bigint")
        # Both cleaned forms are made here, once: a filter behind the explode would make them again for every test.
        return T.let(at(r, "text"), lambda raw: F.struct(
            ms("start").alias("start_ms"), i.alias("i"), ms("end").alias("end_ms"), T.strip(at(r, "style")).alias("style"),
            T.strip(at(r, "name")).alias("name"), raw.alias("raw"), (F.size(r) == F.size("cols")).alias("whole"),
            _clean_ass(raw, F.col("wrap")).alias("clean"), T.ass_visible(raw).alias("shown"),
        ))

    found = F.array_sort(F.filter(F.transform("rows", event), lambda x: x["whole"]))
    e = explode_rows(base, [key, "wrap", "hidden"], found).select(key, "wrap", "hidden", (F.col("p") + 1).cast("bigint").alias("pos"), "e.*")
    clean, shown = F.col("clean"), F.col("shown")
    spoken = (F.size(F.filter(F.split(clean, r"\s+"), lambda w: w.rlike(r"\p{L}"))) >= 4) & clean.rlike(r"[.!?…»”\"']\s*$|[,;:]\s")
    fx = (F.lower("style") == "fx") & F.col("raw").rlike(T.OVERRIDE) & F.lower(clean).isin(*FX_WORDS)
    kept = e.filter(
        ~(F.col("style").rlike(SKIPPED_STYLES) & ~spoken) & ~F.array_contains("hidden", F.col("style")) & (shown != "") & (clean != "") & ~fx
    )
    plain = ~F.col("raw").rlike(r"(?i)\\(?:1?a|alpha)\s*&H|\\p[1-9]")
    text = F.when(plain, T.strip(_breaks(F.regexp_replace("raw", ASS_COMMENT, ""), F.col("wrap")))).otherwise(shown)
    tech = F.regexp_replace(F.regexp_replace(F.lower("name"), r"[\s_\-]+", ""), r"\d+$", "").isin(*TECHNICAL_NAMES)
    named = F.col("name").rlike(r"\p{L}") & ~tech & ~F.startswith(F.lower(text), F.concat(F.lower("name"), F.lit(":")))
    lead = F.regexp_extract(text, r"^((?:\{[^}]*\}|</?[a-zA-Z][^>]*>)*)", 1)
    full = F.concat(lead, F.col("name"), F.lit(": "), F.substring(text, F.length(lead) + 1, F.lit(1 << 30)))
    return kept.select(key, "pos", "start_ms", "end_ms", "style", F.when(named, full).otherwise(text).alias("text"))


def lyric_track(style: Column) -> tuple[Column, Column]:
    """(family, language) of an opening or ending song style, NULLs for other styles."""
    s = F.lower(F.regexp_replace(style, r"[\s._-]+", ""))
    family = F.regexp_extract(s, r"^(op|ed)", 1)
    tail = F.substring(s, 3, 64)
    lang = F.when(tail.isin("e", "en", "eng", "english"), "en").when(tail.isin("j", "jp", "jpn", "jap", "japanese", "romaji"), "jp")
    return F.when((family != "") & lang.isNotNull(), family), F.when(family != "", lang)


def drop_other_lyrics(events: DataFrame, key: str, preferred: str = "en") -> DataFrame:
    """Song lines in another language go if the preferred one has the same line times."""
    family, lang = lyric_track(F.col("style"))
    # Parsing is the costly part and the events are read three times below, so they are written once.
    e = cut(events.withColumn("_f", family).withColumn("_l", lang), "events")
    have = e.filter(F.col("_l") == preferred).select(key, "_f", "start_ms", "end_ms").distinct()
    # Only lyric rows of the other language can match; all others pass by the join.
    other = F.coalesce((F.col("_l") != preferred) & F.col("_f").isNotNull(), F.lit(False))
    kept = e.filter(other).join(have, [key, "_f", "start_ms", "end_ms"], "left_anti")
    return e.filter(~other).unionByName(kept.select(*e.columns)).drop("_f", "_l")


def parse_ass(files: DataFrame, key: str, content: str, lyric_language: str = "en") -> DataFrame:
    kept = drop_other_lyrics(parse_ass_events(files, key, content), key, lyric_language).withColumnRenamed("pos", "_ord")
    n = ordered.dense_pos(kept, [key], "_ord", "pos")
    return n.select(key, "pos", F.col("pos").alias("cue_no"), "start_ms", "end_ms", "text")


def parse_any(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """Dispatch by extension; other files give no cues."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    srt = parse_srt(files.filter(ext == "srt"), key, content)
    vtt = parse_vtt(files.filter(ext == "vtt"), key, content)
    return srt.unionByName(vtt).unionByName(parse_ass(files.filter(ext.isin("ass", "ssa")), key, content))
