"""Column expressions over cue text. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markup, marker and punctuation patterns of the subtitle formats.
MARKUP = r"</?[a-zA-Z][^>]*>|\{\s*\\[^{}]*\}"
INVISIBLE = "[\u00ad\u200b-\u200f\u202a-\u202e\u2060\u2066-\u2069\ufeff]"
FAILURE = r"(?i)\[\s*(?:HATA|ÇEVİRİ\s+EKSİK)"
MISSING = "[ÇEVİRİ EKSİK]"
SENTENCE_END = r"[.!?…][)\]}\"'»”’›\s]*$"
LINE_END = r"[.!?…:;\"'”’)\]]\s*$"
MOJIBAKE = (
    "[\u00c3\u00c5\u00c4\u00c2][\u0080-\u00bf\u0178\u017d\u2018\u2019\u201c\u201d\u20ac]"
    "|\u00e2\u20ac[\u0098-\u009d\u2122\u201c\u201d]"
)
RUBY = r"(?is)<\s*rt\b[^>]*>.*?<\s*/\s*rt\s*>|<\s*rp\b[^>]*>.*?<\s*/\s*rp\s*>|<\s*(?:rt|rp)\b[^>]*>"
BREAK_TAG = r"(?i)<\s*br\s*/?\s*>"
INLINE_STAMP = r"<\d{1,2}:\d{2}(?::\d{2})?[.,]\d{1,3}>"
TAG_BUT_VOICE = r"(?i)</?(?:b|i|u|s|em|strong|font|c|lang|ruby|span|div|p|a|h1|h2|ul|li|nav)(?:[.\s][^>]*)?>"
OVERRIDE = r"\{\\[^}]*\}"
JSON_ONLY = r"^[\s,]*[{}\[\]][\s{}\[\],]*$"
JSON_SEPARATOR = r"\}\s*,\s*\{"
ENTITY = r"^(#[xX][0-9a-fA-F]+|#\d+|[A-Za-z][A-Za-z0-9]*);"
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "lrm": "\u200e",
    "rlm": "\u200f", "hellip": "\u2026", "mdash": "\u2014", "ndash": "\u2013", "ldquo": "\u201c",
    "rdquo": "\u201d", "lsquo": "\u2018", "rsquo": "\u2019", "laquo": "\u00ab", "raquo": "\u00bb",
    "deg": "\u00b0", "eacute": "\u00e9",
}
DROPPED = "[\u00ad\u200b\u200e\u200f\u202a-\u202e\u2060\ufeff]"
ODD_SPACE = "[\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
LATIN = "A-Za-z\u00c0-\u024f"
TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"
NUMBER = r"\d+(?:[.,:/-]\d+)*"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    # Single blanks are no match, as nearly all are.
    return strip(F.regexp_replace(c, r"\s{2,}|[^\S ]", " "))


def visible(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, MARKUP, ""), INVISIBLE, ""))


def has_word(c: Column) -> Column:
    return visible(c).rlike(r"\p{L}")


def failure_reason(target: Column, source: Column) -> Column:
    t = F.coalesce(target, F.lit(""))
    return (
        F.when(t.rlike(FAILURE), "hata_isareti")
        # A letter or digit at the start is in no markup and stays visible.
        .when(~t.rlike(r"^[\p{L}\p{N}]") & (visible(t) == ""), "bos_hedef")
        .when(~has_word(t) & has_word(F.coalesce(source, F.lit(""))), "sozcuksuz_hedef")
        .otherwise("")
    )


def ends_sentence(c: Column) -> Column:
    return c.rlike(SENTENCE_END)


def clean_source(c: Column) -> Column:
    """Source text for translation: separators become spaces, voice tags stay."""
    c = F.regexp_replace(c, RUBY, "")
    c = F.regexp_replace(c, BREAK_TAG, " ")
    c = F.regexp_replace(c, rf"(?<=[\p{{L}}\p{{N}}]){INLINE_STAMP}(?=[\p{{L}}\p{{N}}])", " ")
    c = F.regexp_replace(c, INLINE_STAMP, "")
    c = F.regexp_replace(c, TAG_BUT_VOICE, "")
    c = F.regexp_replace(c, r"\{\\[^}]*\}|\{\}", "")
    return strip(F.regexp_replace(c, "  +", " "))


def clean_controls(c: Column) -> Column:
    """Undo NUL+hex escapes, drop invisible marks, turn odd spaces and C0 into spaces.

    Joiners stay unless they stand between two Latin letters; bidi isolates stay.
    """
    byte = lambda p: F.decode(F.unhex(F.concat(F.lit("000000"), F.substring(p, 1, 2))), "UTF-32")
    repaired = F.transform(
        F.split(c, "\u0000"),
        lambda p, i: F.when((i > 0) & p.rlike("^[0-9a-fA-F]{2}"), F.concat(byte(p), F.substring(p, 3, 1 << 30)))
        .when(i > 0, F.concat(F.lit(" "), p)).otherwise(p),
    )
    c = F.when(F.contains(c, F.lit("\u0000")), F.array_join(repaired, "")).otherwise(c)
    c = F.regexp_replace(c, f"(?<=[{LATIN}])[\u200c\u200d](?=[{LATIN}])", "")
    c = F.regexp_replace(c, "^[\u200c\u200d]|[\u200c\u200d]$", "")
    c = F.regexp_replace(c, DROPPED, "")
    c = F.regexp_replace(c, ODD_SPACE, " ")
    return F.regexp_replace(c, "[\u0001-\u0008\u000b\u000c\u000e-\u001f]", " ")


def decode_entities(c: Column) -> Column:
    """Named and numeric references; unknown and invalid ones stay as they are."""
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def point(body: Column) -> Column:
        return (
            F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 12), 16, 10))
            .otherwise(F.substring(body, 2, 12)).try_cast("bigint")
        )

    def valid(n: Column) -> Column:
        return (
            (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF) & ~n.between(0xFDD0, 0xFDEF)
            & (n % 0x10000 < 0xFFFE) & ((n >= 0x20) | n.isin(9, 10, 13)) & ~n.between(0x7F, 0x9F)
        )

    def piece(keep_angle: bool):
        def one(p: Column, i: Column) -> Column:
            body = F.regexp_extract(p, ENTITY, 1)
            rest = F.substring(p, F.length(body) + 2, F.lit(1 << 30))
            name = F.lower(body)
            n = point(body)
            char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
            named = F.try_element_at(names, name)
            ok = named.isNotNull() & (~name.isin("lt", "gt") if keep_angle else F.lit(True))
            return (
                F.when(i == 0, p)
                .when(body.startswith("#") & valid(n), F.concat(char, rest))
                .when((body != "") & ok, F.concat(named, rest))
                .otherwise(F.concat(F.lit("&"), p))
            )
        return one

    parts = F.split(c, "&")
    full = F.array_join(F.transform(parts, piece(False)), "")
    held = F.array_join(F.transform(parts, piece(True)), "")
    tag = r"</?[a-zA-Z][^>]*>"
    return F.when(~F.contains(c, F.lit("&")), c).when(full.rlike(tag) & ~c.rlike(tag), held).otherwise(full)


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), fn)[0]


def ass_visible(c: Column) -> Column:
    """Text outside segments hidden by an alpha of FF or drawn in drawing mode; tags removed.

    ``\\t(`` animations cannot be resolved, so their hidden parts stay.
    """
    pieces = F.split(c, r"(?=\{)")
    last = lambda b, pat: F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(b, F.lit(pat), F.lit(1))), -1)

    def step(acc: Column, p: Column) -> Column:
        def state(b: Column) -> Column:
            alpha = last(b, r"(?i)\\(?:1?a|alpha)\s*&H([0-9A-Fa-f]{1,2})&")
            draw = last(b, r"(?i)\\p(\d+)")
            return F.struct(
                F.when(alpha != "", F.upper(F.lpad(alpha, 2, "0")) == "FF").otherwise(acc["hidden"]).alias("hidden"),
                F.when(draw != "", draw != "0").otherwise(acc["drawing"]).alias("drawing"),
                F.substring(p, F.length(b) + 1, F.lit(1 << 30)).alias("body"),
            )

        return let(
            let(F.regexp_extract(p, r"^(\{[^{}]*\})", 1), state),
            lambda s: F.struct(
                s["hidden"].alias("hidden"), s["drawing"].alias("drawing"),
                F.concat(acc["out"], F.when(s["hidden"] | s["drawing"], "").otherwise(s["body"])).alias("out"),
            ),
        )

    start = F.struct(F.lit(False).alias("hidden"), F.lit(False).alias("drawing"), F.lit("").alias("out"))
    plain = F.regexp_replace(c, OVERRIDE, "")
    steady = ~c.rlike(r"(?i)\\(?:1?a|alpha)\s*&H|\\p\d") | c.rlike(r"\\ *t *\(")
    kept = F.when(steady, plain).otherwise(F.aggregate(pieces, start, step)["out"])
    return strip(F.regexp_replace(kept, r"\\[Nn]", "\n"))


def strip_json(c: Column) -> Column:
    return F.when(c.rlike(JSON_ONLY), "").otherwise(strip(F.regexp_replace(c, JSON_SEPARATOR, " ")))


# Typographic characters and what they become.
TYPOGRAPHY_FROM = "“”„«»‘‚–—\u00a0"
TYPOGRAPHY_TO = "\"\"\"\"\"''-- "


def typography(c: Column) -> Column:
    """Plain quotes, dashes and spaces; a prime after a digit is a measure and stays."""
    c = F.translate(c, TYPOGRAPHY_FROM, TYPOGRAPHY_TO)
    c = F.regexp_replace(c, r"(?<![0-9])[’′]", "'")
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def norm_tokens(c: Column) -> Column:
    return tokens(F.lower(F.replace(F.replace(c, F.lit("â€™"), F.lit("'")), F.lit("’"), F.lit("'"))))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))


def dash_lines(c: Column) -> Column:
    """Lines that open with a dialogue dash, label-only lines left out."""
    return F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*[-–—]") & ~x.rlike(r"^\s*[-–—]\s*[\[(][^\])]*[\])]\s*$"))


def restore_tags(src: Column, tgt: Column) -> Column:
    """Put the position block and the full or prefixed wrap of the source round the target."""
    wrap = r"(?is)^\s*((?:<(?:i|b|u|s|em|strong|font)(?:\s[^>]*)?>)+)(.*?)((?:</(?:i|b|u|s|em|strong|font)\s*>)+)\s*$"
    lead_re = r"^((?:\{\\[^}]*\})+)"
    prefix = r"^(\s*(?:[-–—]\s*)?(?:\[[^\]]*\]\s*)?(?:[♪♫♬♩]+\s*)?)"
    tail = r"((?:\s*[♪♫♬♩]+)?\s*)$"

    def wrapped(line: Column, out: Column) -> Column:
        body = F.regexp_replace(line, lead_re, "")
        core = F.regexp_replace(F.regexp_replace(body, prefix, ""), tail, "")
        def has(b: Column) -> Column:
            return b.rlike(wrap) & ~F.regexp_extract(b, wrap, 2).rlike("</[a-zA-Z]")
        full = F.concat(F.regexp_extract(body, wrap, 1), out, F.regexp_extract(body, wrap, 3))
        inner = F.regexp_replace(F.regexp_replace(out, prefix, ""), tail, "")
        pre = F.concat(
            F.regexp_extract(out, prefix, 1), F.regexp_extract(core, wrap, 1), inner,
            F.regexp_extract(core, wrap, 3), F.regexp_extract(out, tail, 1),
        )
        tagged = out.rlike(r"^\s*(?:\{\\[^}]*\})*\s*<[a-zA-Z]") | (strip(out) == "")
        res = F.when(tagged, out).when(has(body), full).when(has(core), pre).otherwise(out)
        lead = F.regexp_extract(line, lead_re, 1)
        return F.when((lead != "") & ~F.startswith(res, lead), F.concat(lead, res)).otherwise(res)

    s, t = F.split(strip(src), "\n"), F.split(tgt, "\n")
    by_line = F.array_join(F.zip_with(s, t, wrapped), "\n")
    failed = tgt.rlike(r"^\[HATA") | (strip(tgt) == MISSING) | (src == "") | (tgt == "")
    return F.when(failed, tgt).when((F.size(s) == F.size(t)) & (F.size(s) > 1), by_line).otherwise(wrapped(strip(src), tgt))
