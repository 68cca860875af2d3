"""Checks of a rewritten or translated text against its source; first reason wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueflow.functions import keys as K
from cueflow.functions import text as T
from cueflow.functions import turkish as TR

# Turkish number words and their values.
NUMBER_VALUES = {
    "bir": 1, "iki": 2, "üç": 3, "dört": 4, "beş": 5, "altı": 6, "yedi": 7, "sekiz": 8, "dokuz": 9, "on": 10,
    "yirmi": 20, "otuz": 30, "kırk": 40, "elli": 50, "altmış": 60, "yetmiş": 70, "seksen": 80, "doksan": 90,
    "yüz": 100, "bin": 1000,
}
FOREIGN_SCRIPT = r"[\p{IsCyrillic}\p{IsGreek}\p{IsArabic}\p{IsHebrew}\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
DIACRITICS = "[çğışöüÇĞİŞÖÜ]"


# Source unit, target unit, factor and zero of the source scale. Callers extend the table.
UNITS = (
    (r"pounds?|lbs?", r"kilo(?:gram)?|kg", 0.45359237, 0.0), (r"ounces?|oz", r"gram|gr", 28.349523, 0.0),
    (r"feet|foot|ft", r"metre|m", 0.3048, 0.0), (r"inch(?:es)?", r"santim(?:etre)?|cm", 2.54, 0.0),
    (r"yards?", r"metre|m", 0.9144, 0.0), (r"miles?", r"kilometre|km", 1.609344, 0.0),
    (r"degrees?(?: fahrenheit)?|°F", r"derece|santigrat|°C", 1 / 1.8, 32.0), (r"gallons?", r"litre|lt", 3.785412, 0.0),
    (r"acres?", r"hektar|ha", 0.40468564, 0.0),
)
#: A converted quantity may be rounded by this share, or by half a unit.
ROUNDING = 0.05


def _quantities(c: Column, unit: str) -> Column:
    """array<struct<raw, v>> of the numbers before a unit."""
    rx = rf"(?i)(?<![\d.,])(\d+(?:[.,]\d+)?)\s*-?\s*(?:{unit})(?![\p{{L}}\p{{N}}]{{4}})"
    return F.transform(F.regexp_extract_all(c, F.lit(rx), F.lit(1)), lambda n: F.struct(n.alias("raw"), F.replace(n, F.lit(","), F.lit(".")).cast("double").alias("v")))


def converted(src: Column, tgt: Column) -> Column:
    """Numbers of the source whose quantity the target gives in its own unit, each target quantity for one of them.

    Quantities of one unit are matched in order of size, as both lists are sorted by the same scale.
    """
    def kind(unit: str, into: str, factor: float, zero: float) -> Column:
        own = F.array_sort(F.transform(_quantities(src, unit), lambda q: F.struct(((q["v"] - zero) * factor).alias("v"), q["raw"].alias("raw"))))
        there = F.array_sort(F.transform(_quantities(tgt, into), lambda q: q["v"]))
        near = lambda a, b: F.abs(a["v"] - b) <= F.greatest(F.abs(a["v"]) * ROUNDING, F.lit(0.5))
        pairs = F.zip_with(own, there, lambda a, b: F.when(near(a, b), a["raw"]))
        return F.when(src.rlike(r"(?i)\d\s*-?\s*(?:" + unit + ")"), F.array_compact(pairs)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[kind(*u) for u in UNITS]))


def lost_numbers(src: Column, tgt: Column) -> Column:
    """Digits of the source that the target has neither as digits nor as a number word, nor as a quantity in another unit.

    Clock marks are unified, so 8:30 and 08.30 agree; grouping marks of thousands are dropped.
    """
    whole = lambda c: F.regexp_replace(c, r"(\d)[,.](\d{3})(?!\d)", "$1$2")

    def norm(c: Column) -> Column:
        c = F.regexp_replace(whole(c), r"(\d{1,2})[.:](\d{2})(?!\d)", "$1:$2")
        return F.transform(T.numbers(c), lambda n: F.regexp_replace(n, "^0+(?=.)", ""))

    src, tgt = T.visible(src), T.visible(tgt)
    words = F.create_map(*[F.lit(x) for k, v in NUMBER_VALUES.items() for x in (k, str(v))])
    low = F.lower(F.translate(tgt, "İI", "iı"))
    toks = F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0))
    spelled = F.array_compact(F.transform(toks, lambda t: F.try_element_at(words, F.regexp_replace(t, "(?:te|ta|le|la|de|da)$", ""))))
    pair = F.when(F.size(spelled) >= 2, F.array(
        F.aggregate(spelled, F.lit(0).cast("bigint"), lambda a, x: F.when((x == "100") | (x == "1000"), F.greatest(a, F.lit(1).cast("bigint")) * x.cast("bigint")).otherwise(a + x.cast("bigint"))).cast("string")
    )).otherwise(F.array().cast("array<string>"))
    return F.array_except(F.array_except(norm(src), F.concat(norm(tgt), spelled, pair)), converted(whole(src), whole(tgt)))


def missing_replica(src: Column, tgt: Column) -> Column:
    s, t = F.size(T.dash_lines(src)), F.size(T.dash_lines(tgt))
    return (s >= 2) & (t < s)


def negations(c: Column) -> Column:
    return F.size(F.filter(T.norm_tokens(c), lambda x: x.isin(*K.NEGATIONS)))


def rewrite_reason(source: Column, old: Column, new: Column) -> Column:
    """Why a Turkish candidate must not replace ``old``; '' if it may.

    Negation is that of the Turkish versions, set against negation words of the English source.
    """
    tags = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(T.MARKUP), F.lit(0)), "")
    dash = lambda c: F.size(T.dash_lines(c))
    label = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]"), F.lit(0)))
    nums = lambda c: F.array_join(F.array_sort(T.numbers(c)), " ")
    low = lambda c: F.lower(T.strip(c))
    count = lambda c, rx: F.regexp_count(c, F.lit(rx))
    return (
        F.when(T.strip(old) == "", "old_empty")
        .when(old.rlike(T.FAILURE), "missing_placeholder")
        .when(T.strip(new) == "", "new_empty")
        .when(K.line_shape(old) != K.line_shape(new), "linebreak_count")
        .when(tags(old) != tags(new), "format_tags")
        .when(dash(old) != dash(new), "speaker_dash")
        .when(label(old) != label(new), "bracket_label")
        .when(TR.negated(old) & ~TR.negated(new) & (negations(source) > 0), "source_negation")
        .when(TR.negated(new) & ~TR.negated(old) & (negations(source) == 0), "source_negation_addition")
        .when(TR.negated(old) != TR.negated(new), "negation")
        .when(K.is_question(old) != K.is_question(new), "question")
        .when(nums(old) != nums(new), "numbers")
        .when((low(new) == low(source)) & (low(old) != low(source)), "source_echo")
        .when(new.rlike(FOREIGN_SCRIPT) & ~old.rlike(FOREIGN_SCRIPT), "foreign_script")
        .when((count(old, DIACRITICS) >= 2) & (count(new, DIACRITICS) == 0), "diacritic_loss")
        .when(F.length(new) * 2 < F.length(old), "destructive_shortening")
        .otherwise("")
    )


def glued(old: Column, new: Column) -> Column:
    """A token of ``new`` is two adjacent tokens of ``old`` written together."""
    o, n = T.norm_tokens(old), T.norm_tokens(new)
    cut = lambda a, i: F.when(F.size(a) > 1, F.slice(a, i, F.size(a) - 1)).otherwise(F.array().cast("array<string>"))
    joined = F.zip_with(cut(o, 1), cut(o, 2), lambda a, b: F.concat(a, b))
    return F.arrays_overlap(F.array_except(n, o), joined)
