"""Identities and keys: folds, memory keys, series keys, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueflow.functions import text as T

# Accented letters and their base letters (closed list, NFC text).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿğışœæ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyygis"  # œ and æ have no single base letter and are dropped
CLOSED_STOP = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "is", "it", "for", "with", "by")

# Language names and their keys.
LANGUAGES = {
    "turkish": "tr", "türkçe": "tr", "german": "de", "deutsch": "de", "italian": "it",
    "spanish": "es", "french": "fr", "english": "en",
}

# Words whose loss changes a sentence.
NEGATIONS = (
    "not", "no", "never", "neither", "nor", "without", "isn't", "aren't", "wasn't", "weren't", "don't",
    "doesn't", "didn't", "won't", "wouldn't", "can't", "cannot", "couldn't", "shouldn't", "mustn't",
    "hasn't", "haven't", "hadn't",
)
MODALS = ("can", "could", "may", "might", "must", "shall", "should", "will", "would")
PRONOUNS = (
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his",
    "its", "our", "their", "mine", "yours", "hers", "ours", "theirs",
)
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty",
    "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion",
)
TERMINAL = "[.!?\"'“”‘’«»)\\]} ]+$"
SKELETON_FROM, SKELETON_TO = ";[]–—", ",()--"


def identity(c: Column) -> Column:
    """Letters without case and accents: the identity of a character name."""
    return F.translate(F.lower(F.trim(F.translate(c, "İ", "I"))), ACCENTED, PLAIN)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"[._]+", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s-]", "")
    s = F.regexp_replace(T.strip(s), r"\s+", "-")
    return F.when(s == "", "dizi").otherwise(s)


def term_identity(c: Column) -> Column:
    """All-capital terms are exact, others fold their case."""
    t = F.trim(c)
    exact = (F.upper(t) == t) & t.rlike(r"\p{L}")
    return F.when(exact, F.concat(F.lit("exact:"), t)).otherwise(F.concat(F.lit("folded:"), F.lower(t)))


def language_key(c: Column) -> Column:
    raw = F.lower(F.trim(c))
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    key = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_element_at(m, raw), raw), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(key == "", "tr").otherwise(key)


def memory_norm(c: Column) -> Column:
    return T.squeeze(F.lower(c))


def fingerprint(model: str = "", profanity: str = "", schema: str = "", src_lang: str = "", context: str = "") -> Column:
    """Settings that must agree for a stored translation to be reused."""
    import hashlib

    ctx = hashlib.sha256(context.strip().encode("utf-8", "replace")).hexdigest()[:24] if context.strip() else ""
    parts = {"m": model.strip().lower().replace(" ", "-"), "p": profanity.strip().lower(), "s": schema.strip().lower(),
             "l": src_lang.strip().lower(), "c": ctx}
    return F.lit("|".join(f"{k}:{v}" for k, v in parts.items() if v))


def memory_key(source: Column, tgt_lang: Column, print_: Column) -> Column:
    body = F.concat(F.when(tgt_lang != "", F.concat(F.lower(F.trim(tgt_lang)), F.lit(":"))).otherwise(""), memory_norm(source))
    return F.md5(F.when(print_ != "", F.concat(print_, F.lit(":"), body)).otherwise(body))


def line_shape(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def unworded(c: Column) -> Column:
    """Every run of letters, digits and blanks behind them as one letter: what is left to read for marks and end is short."""
    return F.regexp_replace(c, r"[\p{L}\p{N}][\p{L}\p{N} ]*", "a")


def skeleton(c: Column) -> Column:
    """Inner punctuation that carries meaning; end marks are left out, runs count once."""
    body = F.regexp_replace(F.replace(unworded(c), F.lit("…"), F.lit("...")), TERMINAL, "")
    marks = F.translate(F.regexp_replace(body, r"[^,;:?!()\[\]\-–—.]+", ""), SKELETON_FROM, SKELETON_TO)
    return F.regexp_replace(marks, r"(.)\1+", "$1")


def is_question(c: Column) -> Column:
    return c.rlike("\\?[\"'“”‘’«»)\\]} ]*$")


def gate(c: Column) -> Column:
    """Equal gates are needed for a similar entry to mean the same."""
    marks = T.let(unworded(c), lambda u: F.concat_ws("\u0001", skeleton(u), is_question(u).cast("string")))
    return F.concat_ws("\u0001", F.array_join(T.norm_tokens(c), " "), marks)


def usable(source: Column, target: Column) -> Column:
    # The target is bound, so that it is made once for all three tests.
    fit = lambda t: (T.failure_reason(t, F.lit("")) == "") & (F.lower(T.strip(source)) != F.lower(t))
    return T.let(T.strip(F.coalesce(target, F.lit(""))), fit)


def anchors(c: Column) -> dict[str, Column]:
    toks = T.norm_tokens(c)
    pick = lambda words: F.array_join(F.array_sort(F.array_distinct(F.filter(toks, lambda x: x.isin(*words)))), " ")
    return {
        "negations": pick(NEGATIONS), "modals": pick(MODALS), "pronouns": pick(PRONOUNS),
        "number_words": F.array_join(F.filter(toks, lambda x: x.isin(*NUMBER_WORDS)), " "),
        "digits": F.array_join(T.numbers(c), " "),
        "proper": F.array_join(
            F.transform(F.filter(T.tokens(c), lambda x: x.rlike(r"^\p{Lu}") & (F.lower(x) != "i")), lambda x: F.lower(x)), " "
        ),
    }


# File-name patterns for (show, season, episode).
SXXEXX = r"^(.+?)[ ._\-]+[Ss](\d{1,2})[ ._\-]?[Ee](\d{1,3})"
NXNN = r"^(.+?)[ ._\-]+(\d{1,2})x(\d{1,3})(?:\D|$)"
EPISODE_WORD = r"(?i)^(.+?)[ ._\-]+(?:episode|bölüm|bolum|ep\.?)[ ._\-]*(\d{1,3})(?:\D|$)"
ANIME_DASH = r"^(.+?) - (\d{1,3})(?:\s|$|[\[\(_])"
BARE_SXXEXX = r"^[Ss](\d{1,2})[ ._\-]?[Ee](\d{1,3})"
N_OF_TOTAL = r"(?i)^(.+?)[ ._\-]+(\d{1,3})[ ._\-]+of[ ._\-]+\d{1,3}(?:\D|$)"


# Further marks of file and folder names.
TV_ROOT = r"(?i)(?:^|[ ._\-])tv[ ._\-]*s(\d{1,2})(?=$|[ ._\-])"
TV_COMMON_ROOT = r"(?i)(?:^|[ ._\-])tv(?=$|[ ._\-])"
SEASON_DIR = r"(?i)^(?:season[ ._\-]*|s)(\d{1,2})$"
EPISODE_DIR = r"(?i)^episode[ ._\-]*(\d{1,3})$"
PUNTATA = r"(?i)(?:^|[ ._\-])puntata[ ._\-]*(\d{1,3})(?:\D|$)"
COUNTED = r"(?i)(?:^|[ ._\-])(\d{1,3})[ ._\-]+of[ ._\-]+\d{1,3}(?:\D|$)"
GLUED_OF_TOTAL = r"(?i)^(.+?)[ ._\-]+(\d{1,3})of\d{1,3}(?=$|[ ._\-])"
SPLIT_MEDIA = r"(?i)(?:^|[ ._\-])(?:cd|disc|disk|dvd|pt|part|vol)$"
SERIES_NO = r"(?i)[ ._\-]*series[ ._\-]*(\d{1,2})$"
COMPACT = r"^(.+?)[ ._\-]+[Ss](\d{2})(\d{2})(?=$|[ ._\-])"
LEGACY_COMPACT = r"^(.+?)[ ._\-]+([1-9])(\d{2})(?=$|[ ._\-])"
BARE_NXNN = r"^(\d{1,2})x(\d{1,3})(?=$|[ ._\-])"
YEAR_TAIL = r"[ ._\-]*[\(\[]?\d{4}[\)\]]?[ ._\-]*$"
GENERIC_DIRS = ("raporlar", "kaynak", "kurtarma", "son denetim", "çıktı", "cikti", "yüklenecek", "yuklenecek", "yüklenecekler", "yuklenecekler", "yüklendi", "yuklendi")


def _tv_root(dirs: Column) -> Column:
    """``struct(show, season)`` of the nearest folder with a TV mark; ``dirs`` in path order, outermost first."""
    def before(name: Column, mark: str) -> Column:
        return F.regexp_replace(F.regexp_replace(name, mark + r".*$", ""), YEAR_TAIL, "")

    own = F.try_element_at(F.filter(F.reverse(dirs), lambda d: d.rlike(TV_ROOT)), F.lit(1))
    root = F.when(own.isNotNull(), F.struct(before(own, TV_ROOT).alias("show"), F.regexp_extract(own, TV_ROOT, 1).alias("season")))

    def common(i: Column) -> Column:
        """A plain mark, with the season in a folder below."""
        below = F.slice(dirs, i + 1, F.size(dirs))
        at = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(below), F.lit(1))), lambda k: F.try_element_at(below, k).rlike(SEASON_DIR)))
        show = before(F.element_at(dirs, i), TV_COMMON_ROOT)
        named = F.when(F.trim(show) != "", show).otherwise(F.try_element_at(below, F.greatest(at - 1, F.lit(1))))
        fits = at.isNotNull() & ((F.trim(show) != "") | (at > 1))
        return F.when(F.element_at(dirs, i).rlike(TV_COMMON_ROOT) & fits, F.struct(named.alias("show"), F.regexp_extract(F.element_at(below, F.coalesce(at, F.lit(1))), SEASON_DIR, 1).alias("season")))

    marked = F.exists(dirs, lambda d: d.rlike(TV_COMMON_ROOT))
    near = F.try_element_at(F.array_compact(F.transform(F.reverse(F.sequence(F.lit(1), F.size(dirs))), common)), F.lit(1))
    return F.coalesce(root, F.when(marked, near))


def series_key(path: Column) -> Column:
    """``struct(show_name, season, episode)`` of a path, NULL if it is no episode.

    Stem, folders and a TV root are bound once; the first rule that fits gives (show, season, episode), and only
    that show becomes a slug.
    """
    g = F.regexp_extract
    found = lambda show, season, ep: F.struct(show.alias("show"), season.alias("season"), ep.alias("episode"))
    one = F.lit("1")

    def rules(v: Column) -> Column:
        stem, root, dirs, folder = v["stem"], v["root"], v["dirs"], v["folder"]
        show = lambda c: F.coalesce(root["show"], c)
        season = lambda c: F.coalesce(root["season"], c)
        rooted = root.isNotNull()
        marker = lambda d: d.rlike(BARE_SXXEXX + r"(?=$|[ ._\-])") | d.rlike(BARE_NXNN) | d.rlike(EPISODE_DIR) | d.rlike(SEASON_DIR)
        show_dir = F.try_element_at(F.filter(dirs, lambda d: ~marker(d)), F.lit(1))
        near = F.try_element_at(F.filter(F.slice(dirs, 1, 2), lambda d: d.rlike(SXXEXX) | d.rlike(NXNN)), F.lit(1))
        total = g(stem, GLUED_OF_TOTAL, 1)
        return F.coalesce(
            *[F.when(stem.rlike(rx), found(show(g(stem, rx, 1)), g(stem, rx, 2), g(stem, rx, 3))) for rx in (SXXEXX, NXNN)],
            F.when(rooted & (g(stem, LEGACY_COMPACT, 2).try_cast("int") == root["season"].try_cast("int")) & (g(stem, LEGACY_COMPACT, 3) != "00"), found(root["show"], root["season"], g(stem, LEGACY_COMPACT, 3))),
            F.when(rooted & folder.rlike(EPISODE_DIR), found(root["show"], root["season"], g(folder, EPISODE_DIR, 1))),
            *[F.when(rooted & stem.rlike(rx), found(root["show"], root["season"], g(stem, rx, 1))) for rx in (PUNTATA, COUNTED)],
            *[F.when(stem.rlike(rx), found(show(g(stem, rx, 1)), season(one), g(stem, rx, 2))) for rx in (EPISODE_WORD, ANIME_DASH)],
            F.when(stem.rlike(COMPACT), found(show(g(stem, COMPACT, 1)), g(stem, COMPACT, 2), g(stem, COMPACT, 3))),
            F.when(stem.rlike(GLUED_OF_TOTAL) & ~total.rlike(SPLIT_MEDIA), found(
                show(F.regexp_replace(total, SERIES_NO, "")), season(F.when(total.rlike(SERIES_NO), g(total, SERIES_NO, 1)).otherwise(one)), g(stem, GLUED_OF_TOTAL, 2))),
            F.when(stem.rlike(N_OF_TOTAL), found(g(stem, N_OF_TOTAL, 1), one, g(stem, N_OF_TOTAL, 2))),
            *[F.when(stem.rlike(rx) & show_dir.isNotNull(), found(show_dir, g(stem, rx, 1), g(stem, rx, 2))) for rx in (BARE_SXXEXX, BARE_NXNN)],
            *[F.when(near.rlike(rx), found(g(near, rx, 1), g(near, rx, 2), g(near, rx, 3))) for rx in (SXXEXX, NXNN)],
        )

    parts = F.filter(F.split(path, "/"), lambda d: d != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    named = F.filter(F.reverse(folders), lambda d: ~F.lower(d).isin(*GENERIC_DIRS))
    bound = F.struct(
        F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("stem"), F.when(F.size(folders) > 0, _tv_root(folders)).alias("root"),
        named.alias("dirs"), F.coalesce(F.try_element_at(folders, F.lit(-1)), F.lit("")).alias("folder"))
    key = lambda r: F.when(r.isNotNull(), F.struct(slug(r["show"]).alias("show_name"), r["season"].try_cast("bigint").alias("season"), r["episode"].try_cast("bigint").alias("episode")))
    return F.when(path.rlike(r"[^/]"), T.let(T.let(bound, rules), key))


def coarse_tag(name: Column) -> Column:
    """``S01`` from a season mark, else ``EP001`` from an episode number, else ''."""
    s = F.regexp_extract(name, r"(?i)(?:^|[^a-z0-9])s(\d{1,2})[ ._-]?e\d", 1)
    e = F.regexp_extract(name, r"(?i)(?:^|[^a-z0-9])(?:ep|e|episode)[ ._-]?(\d{1,3})(?:\D|$)", 1)
    return F.when(s != "", F.concat(F.lit("S"), F.lpad(s, 2, "0"))).when(e != "", F.concat(F.lit("EP"), F.lpad(e, 3, "0"))).otherwise("")
