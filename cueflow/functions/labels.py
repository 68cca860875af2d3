"""Sound and speaker labels: classification, stripping, translation, rewrites."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueflow.functions import text as T

# Words that make a short label a sound description. Callers may pass more.
SOUND_WORDS = (
    "applause applauding cheering cheers booing laugh laughs laughing laughter chuckle chuckles chuckling giggle "
    "giggles giggling sigh sighs sighing gasp gasps gasping exhales inhales groan groans groaning moan moans moaning "
    "scream screams screaming crying cries sobbing sniffles cough coughs coughing sneeze sneezes breathing panting "
    "grunting whisper whispers whispering murmur murmurs murmuring chanting music song singing sings plays playing "
    "tense dramatic ominous somber upbeat soft door knock knocks phone ringing beeping alarm thunder explosion "
    "gunshot siren engine crowd noise silence chatter inaudible indistinct overlapping continues distant "
    "footsteps crash crashing shatters barking howling growling roaring chirping wind rain storm clock ticking "
    "gunfire humming buzzing rumbling clicking clapping typing whistling shouting yelling echoing static "
    "alkis kahkaha muzik sarki siren motor kalabalik gurultu nefes ciglik rires soupir musique applaudissements "
    "lachen seufzt musik applaus risas suspira musica aplausos risate sospira applausi"
).split()

# Verbs of sounds; their forms follow by rule.
SOUND_VERBS = (
    "applaud cheer boo laugh chuckle giggle sigh gasp exhale inhale groan moan scream cry sob sniffle cough sneeze breathe "
    "pant grunt whisper murmur chant sing play knock ring beep walk run crash break shatter smash bark howl growl meow roar "
    "chirp blow rain slam tick dial honk whistle squeal hum rumble click clap type ping shout yell rap start stop toll crow "
    "coo shiver echo shriek rattle backfire sputter crank rev idle chatter buzz crackle hiss hit creak thunder"
).split()


def verb_forms(verb: str) -> tuple[str, ...]:
    """A verb, its s form and its ing form."""
    s = verb + "es" if re.search("(?:s|x|ch|sh)$", verb) else re.sub("([^aeiou])y$", r"\1ie", verb) + "s"
    double = re.search("^[^aeiou]*[aeiou][^aeiouwxy]$", verb)
    return verb, s, (re.sub("([^e])e$", r"\1", verb) + verb[-1] * bool(double)) + "ing"


SOUND_WORDS = list(dict.fromkeys([*SOUND_WORDS, *(f for v in SOUND_VERBS for f in verb_forms(v))]))

# Speaker labels and their rendering.
SPEAKERS = {
    "narrator": "Anlatıcı", "man": "Adam", "woman": "Kadın", "male": "Erkek", "female": "Kadın", "boy": "Oğlan",
    "girl": "Kız", "child": "Çocuk", "kid": "Çocuk", "announcer": "Sunucu", "speaker": "Konuşmacı", "voice": "Ses",
    "voiceover": "Dış Ses", "interviewer": "Röportajcı", "host": "Sunucu", "reporter": "Muhabir",
    "crowd": "Kalabalık", "audience": "Seyirci", "director": "Yönetmen", "producer": "Yapımcı", "police": "Polis",
    "doctor": "Doktor", "nurse": "Hemşire", "officer": "Memur", "teacher": "Öğretmen", "judge": "Hakim",
    "king": "Kral", "queen": "Kraliçe", "soldier": "Asker", "captain": "Kaptan", "priest": "Rahip",
    "baby": "Bebek", "patient": "Hasta",
}

# Ordered label translations (pattern, rendering).
SOUND_TRANSLATIONS = (
    (r"\blaughing\s+continues\b", "KAHKAHALAR SÜRÜYOR"), (r"\bmusic\s+playing\b", "MÜZİK ÇALIYOR"),
    (r"\baudience\b", "SEYİRCİ"), (r"\bcrowd\b", "KALABALIK"), (r"\blaughing\b|\blaughter\b", "KAHKAHA ATIYOR"),
    (r"\bchuckles?\b|\bchuckling\b", "KIKIRDAR"), (r"\bapplauding\b|\bapplause\b", "ALKIŞLIYOR"),
    (r"\bcheering\b|\bcheers\b", "TEZAHÜRAT YAPIYOR"), (r"\bsighs?\b|\bsighing\b", "İÇ ÇEKER"),
    (r"\bgasps?\b|\bgasping\b", "NEFESİ KESİLİR"), (r"\bgroans?\b|\bgroaning\b", "İNLER"),
    (r"\bscreams?\b|\bscreaming\b", "ÇIĞLIK ATAR"), (r"\bcrying\b|\bcries\b|\bsobbing\b", "AĞLIYOR"),
    (r"\bcoughs?\b|\bcoughing\b", "ÖKSÜRÜR"), (r"\bwhispers?\b|\bwhispering\b", "FISILDAR"),
    (r"\binaudible\b|\bindistinct\b", "ANLAŞILMIYOR"), (r"\bengines?\b", "MOTOR"),
    (r"\bexplosion\b", "PATLAMA"), (r"\bgunshot\b", "SİLAH SESİ"), (r"\bmusic\b", "MÜZİK"), (r"\bplaying\b", "ÇALIYOR"),
)

# Ordered repairs of model artefacts (pattern, replacement). Callers may pass their own table.
ARTEFACTS = (
    (r"\b([Oo])['’](nu|na|nun|nda|ndan)\b", "$1$2"), (r"\bİsrael\b", "Israel"), (r"\btaksidermiya\b", "taksidermi"),
    (r"\bventriloq\b", "ventrilok"), (r"\bchiropraktör\b", "kiropraktör"), (r"\bbrasekler\b", "korseler"),
    (r"\bbrasek\b", "korse"), (r"\bsideshow\b", "yan gösteri"), (r"\bcollection\b", "koleksiyon"),
    (r"\bclient\b", "müşteri"), (r"\bmacabre\b", "ürkütücü"), (r"\btuaf\b", "tuhaf"), (r"\byasıyoruz\b", "yaşıyoruz"),
    (r"\boreriler\b", "gök modelleri"), (r"\bkafatları\b", "kafatasları"), (r"\bauthentic\b", "gerçek"),
    (r"\byada\b", "ya da"),
)

FORMAT_TAG = r"(?i)</?(?:i|b|u|font)[^>]*>"
NOTES = "[♪♫♬♩]+"
GROUP = r"\[[^\[\]\n]+\]|\([^()\n]+\)"
SPEAKER_PREFIX = r"^\s*(?:[-–—]\s*)?[\p{Lu}][\p{Lu}'’ .]{1,30}(?:\s+\d+)?:\s+"
CARD = (
    r"(?i)^(?:act|part|chapter|episode|volume|book|scene|day|year|week|month)\b[\s.:-]*"
    r"(?:[ivxlcdm]+|\d+|one|two|three|four|five|six|seven|eight|nine|ten|first|second|third|final|last)?$"
)
# Cards that are screen text, not labels.
CARD_PHRASES = (
    "the end", "fin", "ende", "son", "the beginning", "intermission", "epilogue", "prologue", "meanwhile", "later",
    "earlier", "the next day", "that night", "based on a true story", "to be continued", "in memory of", "exit",
    "entrance", "danger", "warning", "police", "hospital", "for sale", "closed", "open", "wanted", "missing",
)
CREDIT = r"(?i)(?:subtitles?|captions?|translation|altyaz[ıi]|çeviri)\s*(?:by\b|:)|opensubtitles|synced by|www\."


def bare(c: Column) -> Column:
    """A cue text without format tags, notes, overrides and its opening dash."""
    c = F.regexp_replace(F.regexp_replace(c, T.OVERRIDE, ""), FORMAT_TAG, "")
    return T.strip(F.regexp_replace(F.regexp_replace(c, NOTES, " "), r"^\s*(?:>>|[-–—])\s*", ""))


def one_of(c: Column, words) -> Column:
    """Membership as one pattern: short to build and to compile, unlike a long ``isin``."""
    return c.rlike("^(?:" + "|".join(re.escape(w) for w in words) + ")$")


def _card(v: Column) -> Column:
    def test(x: Column) -> Column:
        return (x != "") & (x.rlike(r"(?:^|\D)[12]\d{3}(?:\D|$)") | one_of(F.lower(x), CARD_PHRASES) | x.rlike(CARD))

    return ~v.contains("\n") & T.let(F.regexp_replace(v, r"[.!?\s]+$", ""), test)


def _structural(v: Column) -> Column:
    """Cheap tests come first: most cues are too long or have a lower-case letter."""
    letters = F.regexp_replace(v, r"[^\p{L}]", "")
    solid = F.length(F.regexp_replace(v, r"\s", ""))
    return (
        (F.length(v) <= 60) & ~v.rlike(r"\p{Ll}") & ~v.contains("\n") & ~v.rlike(r"[.!?…]['\"”’»]?\s*$") & (F.length(letters) >= 2)
        & ~letters.rlike(r"[^\p{Lu}]") & (F.length(letters) >= F.floor(solid / 2)) & ~_card(v)
    )


def _sound(v: Column, words=SOUND_WORDS) -> Column:
    return F.lower(v).rlike(r"(?:^|[^\p{L}])(?:" + "|".join(words) + r")(?:[^\p{L}]|$)")


def is_card(c: Column) -> Column:
    """A year, a set phrase or a numbered heading: screen text to translate."""
    return T.let(bare(c), _card)


def is_structural_label(c: Column) -> Column:
    """All letters capital, at most 60 characters, no sentence end, not a screen card."""
    return T.let(bare(c), _structural)


def has_sound_word(inner: Column, words=SOUND_WORDS) -> Column:
    return _sound(inner, words)


# Contents of brackets that are speech or marks of this process, words that begin a clause, and
# words that make a bracket speech.
KEPT_CONTENTS = ("ok", "no", "yes", "hey")
OWN_MARKS = ("ceviri eksik", "çeviri eksik", "ceviri hatasi", "çeviri hatası", "hata")
CLAUSE_STARTERS = ("and", "but", "or", "because", "if", "that", "which", "ve", "ama", "çünkü", "eğer", "ki", "veya")
PRONOUNS = ("i", "you", "he", "she", "we", "they", "it")
_QUOTES = "[\"“”«»„‟]"
_WORD = r"[\p{L}\p{N}'’]+"


def _shape(v: Column, alone: Column) -> Column:
    """A short bracket without sentence end, quote or number: capitals, a closing colon, or, where it has a line to itself, small words."""
    words = F.regexp_extract_all(v, F.lit(_WORD), F.lit(0))
    letters = F.regexp_replace(v, r"[^\p{L}]", "")
    capital = ~letters.rlike(r"[^\p{Lu}]")
    form = (
        F.when(capital, F.size(words) <= 6).when(v.rlike(r":$"), F.size(words) <= 4)
        .otherwise(alone & v.rlike(r"(?:^|\s)\p{Ll}") & (F.size(words) <= 4))
    )
    return (
        (F.length(v) <= 60) & ~v.rlike(r"^[#♪♫]|[=+*/<>\[\]()]|" + _QUOTES) & ~v.rlike(r"[.!?…]['\"”’»]?$") & (F.length(letters) >= 2) & ~_card(v)
        & ~one_of(F.lower(F.try_element_at(words, F.lit(1))), CLAUSE_STARTERS) & ~F.exists(words, lambda w: w.rlike(r"^\p{N}+$")) & form
    )


def _described(v: Column) -> Column:
    """Words of a sound or a speaker and nothing else, or words without a pronoun that end in a sound or an -ing form."""
    known = lambda w: one_of(w, tuple(SOUND_WORDS) + tuple(SPEAKERS))
    words = F.filter(F.regexp_extract_all(F.lower(v), F.lit(_WORD), F.lit(0)), lambda w: ~w.rlike(r"^\p{N}+$"))
    last = F.try_element_at(words, F.lit(-1))
    ends = (F.size(words) <= 10) & ~F.exists(words, lambda w: one_of(w, PRONOUNS)) & (known(last) | last.rlike("ing$") | F.array_contains(words, "music")) & ~v.rlike(r"[.!?…]$")
    return (F.size(words) > 0) & (F.forall(words, known) | (F.size(words) > 1) & ends)


def is_label_group(inner: Column, alone: Column | None = None) -> Column:
    """Content of a bracket group that describes a sound or names a speaker; ``alone``: the group fills its line."""
    stands = F.lit(False) if alone is None else alone

    def test(v: Column) -> Column:
        said = F.lower(F.translate(F.regexp_replace(v, r"[.!?]+$", ""), "İI", "iı"))
        return (v != "") & ~one_of(said, (*KEPT_CONTENTS, *OWN_MARKS)) & (_described(v) | _shape(v, stands) | _structural(v))

    return T.let(T.strip(inner), test)


#: Signs that a bracket group may hold.
LONGEST_GROUP = 300


def bracket_pieces(line: Column) -> Column:
    """array<struct<t, g>>: a text cut into balanced bracket groups (``g``) and what stands between them.

    One pass with a stack of open brackets over the brackets, line ends and stretches between them. A closing
    bracket of the other kind, a line end or too long a content ends the group; its signs are plain text.
    """
    tokens = F.regexp_extract_all(line, F.lit(r"[\[\]()\n]|[^\[\]()\n]+"), F.lit(0))
    kind = "struct<out:array<struct<t:string,g:boolean>>,held:string,stack:string>"
    state = lambda out, held, stack: F.struct(out.alias("out"), held.alias("held"), stack.alias("stack"))
    none = F.lit("")

    def step(acc: Column, x: Column) -> Column:
        out, stack = acc["out"], acc["stack"]
        held = F.concat(acc["held"], x)
        add = lambda to, t, g: F.concat(to, F.array(F.struct(t.alias("t"), F.lit(g).alias("g"))))
        before = F.when(acc["held"] != "", add(out, acc["held"], False)).otherwise(out)
        opens, closes = x.isin("[", "("), x.isin("]", ")") & (stack != "")
        fits = F.right(stack, F.lit(1)) == F.when(x == "]", "[").otherwise("(")
        return (
            F.when(x == "\n", state(add(before, x, False), none, none))
            .when(opens & (stack == ""), state(before, x, x)).when(opens, state(out, held, F.concat(stack, x)))
            .when(closes & ~fits, state(add(out, held, False), none, none))
            .when(closes & (F.length(stack) > 1), state(out, held, F.substring(stack, F.lit(1), F.length(stack) - 1)))
            .when(closes & (F.length(held) <= LONGEST_GROUP + 2), state(add(out, held, True), none, none))
            .when(closes | (stack != "") & (F.length(held) > LONGEST_GROUP + 2), state(add(out, held, False), none, none))
            .otherwise(state(out, held, stack))
        )

    end = lambda acc: F.when(acc["held"] != "", F.concat(acc["out"], F.array(F.struct(acc["held"].alias("t"), F.lit(False).alias("g"))))).otherwise(acc["out"])
    plain = F.array(F.struct(line.alias("t"), F.lit(False).alias("g")))
    return F.when(line.rlike(r"[\[(]"), F.aggregate(tokens, state(F.array().cast("array<struct<t:string,g:boolean>>"), none, none).cast(kind), step, end)).otherwise(plain)


def bracket_groups(line: Column) -> Column:
    """The balanced bracket groups of a text, brackets included."""
    return F.transform(F.filter(bracket_pieces(line), lambda p: p["g"]), lambda p: p["t"])


def inside(group: Column) -> Column:
    return F.substring(group, F.lit(2), F.length(group) - 2)


def replace_groups(line: Column, replacement) -> Column:
    """A text with each group replaced by ``replacement(group, number of the group from 1)``."""
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("i"))
    step = lambda acc, p: F.struct(F.concat(acc["t"], F.when(p["g"], replacement(p["t"], acc["i"])).otherwise(p["t"])).alias("t"), F.when(p["g"], acc["i"] + 1).otherwise(acc["i"]).alias("i"))
    return F.when(line.rlike(r"[\[(]"), F.aggregate(bracket_pieces(line), start, step, lambda acc: acc["t"])).otherwise(line)


def _alone(line: Column) -> Column:
    """Nothing stands in a line beside its groups but tags, notes, dashes and separators."""
    rest = F.regexp_replace(replace_groups(line, lambda g, i: F.lit(" ")), FORMAT_TAG, "")
    return F.regexp_replace(rest, r"[\s\-–—>♪♫♬♩:;,.]+", "") == ""


def is_speaker_name(inner: Column, colon: Column) -> Column:
    """A known speaker, numbered or not; a capital word; up to three words before a colon."""
    def test(v: Column) -> Column:
        base = F.regexp_replace(v, r"\s+#?\s*\d+\s*$", "")
        numbered = (base != v) & base.rlike(r"^\p{Lu}") & (F.size(F.split(base, r"\s+")) <= 5)
        spoken = one_of(F.lower(F.regexp_replace(v, r"[.!?]+$", "")), KEPT_CONTENTS)
        one = v.rlike(r"^\p{Lu}\p{L}*$") & ~spoken
        few = v.rlike(r"^\S+(?:\s+\S+){0,2}$") & ~spoken
        return (v != "") & ~v.rlike(r"[?!,;:]") & ~_card(v) & (one_of(F.lower(base), SPEAKERS) | numbered | one | (few & colon))

    return T.let(T.strip(inner), test)


def is_label_only(c: Column) -> Column:
    """Nothing but bracket groups, notes and dashes, or one bare sound description."""
    def test(v: Column) -> Column:
        left = F.regexp_replace(replace_groups(v, lambda g, i: F.lit("")), r"[\s,.;:!?_#\-–—]+", "")
        emptied = (left == "") & F.forall(bracket_groups(v), lambda g: is_label_group(inside(g), F.lit(True)))
        return emptied | (~v.rlike(r"[\[(]") & _structural(v) & _sound(v))

    # A cue of words outside brackets cannot be a label unless it has no lower-case letter.
    wordy = c.rlike(r"^[^\[(]*\p{Ll}") & ~c.rlike(r"<|\{")
    return F.when(wordy | (T.strip(c) == ""), False).otherwise(T.let(bare(c), test))


def _without_speaker(line: Column) -> Column:
    """A line without a bracket group of up to 40 signs that opens it and names a speaker or a sound."""
    def cut(v: Column) -> Column:
        group, rest = v["group"], v["rest"]
        tail = F.substring(rest, F.length(group) + 1, F.length(rest))
        colon = tail.rlike(r"^\s*:")
        gone = F.startswith(rest, group) & (F.length(group) <= 42) & (colon | is_label_group(inside(group)) | is_speaker_name(inside(group), colon))
        return F.when(gone, F.regexp_replace(tail, r"^\s*:?\s*", "")).otherwise(line)

    first = F.struct(F.try_element_at(bracket_groups(line), F.lit(1)).alias("group"), F.regexp_replace(line, r"^\s*-?\s*", "").alias("rest"))
    return F.when(line.rlike(r"^\s*-?\s*[\[(]"), T.let(first, lambda v: F.when(v["group"].isNull(), line).otherwise(cut(v)))).otherwise(line)


def strip_line(c: Column) -> Column:
    """One line without bracket labels, speaker prefix, lone notes and the tag pairs that they leave empty."""
    line = F.regexp_replace(c, r"(?i)^\s*(?:&gt;|>){2}\s*", "")
    bracketed = lambda x: x.rlike(r"[\[(]")
    for _ in range(3):
        line = T.let(line, lambda x: F.when(bracketed(x), _without_speaker(x)).otherwise(x))
    drop = lambda x: T.let(_alone(x), lambda alone: replace_groups(x, lambda g, i: F.when(is_label_group(inside(g), alone), "").otherwise(g)))
    cut = T.let(line, lambda x: F.when(bracketed(x), drop(x)).otherwise(x))
    cut = F.regexp_replace(F.regexp_replace(cut, SPEAKER_PREFIX, ""), r"\s+([,.;:!?])", "$1")
    cut = F.regexp_replace(cut, r"(?i)<(i|b|u|font)(?:\s[^>]*)?>\s*</\1\s*>", "")
    bare_notes = lambda x: F.when(~F.regexp_replace(x, NOTES, "").rlike(r"\p{L}|\p{N}"), F.regexp_replace(x, NOTES, "")).otherwise(x)
    cut = F.regexp_replace(T.let(cut, bare_notes), r"^\s*[-–—]\s*$", "")
    return T.strip(F.regexp_replace(cut, r"\s{2,}", " "))


def strip_labels(c: Column) -> Column:
    """Labels removed line by line; a cue that would be empty stays as it is."""
    out = F.array_join(F.filter(F.transform(F.split(c, "\n"), strip_line), lambda x: x != ""), "\n")
    return F.when(out == "", c).otherwise(out)


def drop_groups(c: Column, replacement: str = "") -> Column:
    """Bracket groups of any depth replaced: one innermost round per opening bracket."""
    rounds = F.sequence(F.lit(1), F.greatest(F.regexp_count(c, F.lit(r"[\[(]")), F.lit(1)))
    return F.aggregate(rounds, c, lambda acc, _: F.regexp_replace(acc, GROUP, replacement))


def _strip_like(target: Column, source: Column) -> Column:
    """A target line without the groups that are labels in its source line.

    Groups that stand in both lines in the same order and kind go or stay together; otherwise a target
    group goes if it is a label itself. A source line without a label leaves the target as it is.
    """
    follows = lambda line, g: F.regexp_replace(F.split_part(line, g, F.lit(-1)), r"^\s+", "").startswith(":")

    def strip(groups: Column) -> Column:
        gone = F.transform(groups, lambda g: is_label_group(inside(g)) | is_speaker_name(inside(g), follows(source, g)))
        own = bracket_groups(target)
        kinds = lambda a: F.transform(a, lambda g: F.substring(g, 1, 1))
        paired = (F.size(own) == F.size(groups)) & (kinds(own) == kinds(groups))
        alone = lambda g: ~T.strip(inside(g)).rlike(r"[=+*/<>\[\]()]") & (is_label_group(inside(g)) | is_speaker_name(inside(g), F.lit(False)))
        cut = replace_groups(target, lambda g, i: F.when(F.when(paired, F.try_element_at(gone, i)).otherwise(alone(g)), "").otherwise(g))
        cut = T.strip(F.regexp_replace(F.regexp_replace(cut, r"^(\s*[-–—]?\s*):\s*", "$1"), r"\s{2,}", " "))
        done = F.when(F.regexp_replace(cut, FORMAT_TAG, "").rlike(r"^\s*[-–—]\s*$"), "").otherwise(cut)
        return F.when(F.exists(gone, lambda x: x), done).otherwise(target)

    return F.when(source.rlike(r"[\[(]"), T.let(bracket_groups(source), strip)).otherwise(target)


def strip_by_source(tgt: Column, src: Column) -> Column:
    """Labels leave the target only where the source has them: line by line, or by the whole source if the lines don't match."""
    t, s = F.split(tgt, "\n"), F.split(src, "\n")
    by_line = F.array_join(F.zip_with(t, s, _strip_like), "\n")
    flat = F.replace(src, F.lit("\n"), F.lit(" "))
    whole = F.array_join(F.transform(t, lambda line: _strip_like(line, flat)), "\n")
    return F.when(~src.rlike(r"[\[(]"), tgt).when(F.size(t) == F.size(s), by_line).otherwise(whole)


def fold_rules(c: Column, rules) -> Column:
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, c)


def translate_labels(c: Column) -> Column:
    """Sound words in bracket groups and speaker prefixes in their target rendering."""
    groups = F.regexp_extract_all(c, F.lit(GROUP), F.lit(0))
    done = F.aggregate(
        groups, c,
        lambda acc, g: F.replace(acc, g, fold_rules(g, [("(?i)" + p, r) for p, r in SOUND_TRANSLATIONS])),
    )
    # Dotted and dotless i are kept apart when a rendering is put in capitals.
    up = lambda s: s.replace("i", "İ").replace("ı", "I").upper()
    prefixes = [
        (rf"(?m)^(\s*-?\s*){form(k)}\s*:", "$1" + form_out(v) + ":")
        for k, v in SPEAKERS.items()
        for form, form_out in ((str.upper, up), (str.capitalize, str))
    ]
    return fold_rules(done, prefixes)


def rewrite_artefacts(c: Column, rules=ARTEFACTS) -> Column:
    return fold_rules(c, rules)


def sentence_case(c: Column) -> Column:
    low = F.lower(c)
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))
