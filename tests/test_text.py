"""Pinned cases of the column expressions."""

from pyspark.sql import functions as F

from cueflow.functions import guards as G
from cueflow.functions import keys as K
from cueflow.functions import labels as L
from cueflow.functions import text as T
from cueflow.functions import timecode as TC
from cueflow.functions import turkish as TR


def ask(spark, values, fn):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)])
    return [r[0] for r in df.orderBy("_1").select(fn(*[F.col(c) for c in df.columns[1:]])).collect()]


def test_timecode(spark):
    assert ask(spark, ["00:00:01,000", "01:02.5", "1:02:03.45", "x"], TC.parse_ms) == [1000, 62500, 3723450, None]
    assert ask(spark, ["1;02:03 --> 00:00:05,12 line:1"], TC.normalise_line) == ["01:02:03,000 --> 00:00:05,120"]
    assert ask(spark, ["X-TIMESTAMP-MAP=MPEGTS:900000,LOCAL:00:00:00.000", ""], TC.hls_offset_ms) == [10000.0, 0.0]
    assert ask(spark, ["Timer: 50,0", "Timer: 0"], TC.timer_scale) == [2.0, 1.0]


def test_failure_reason(spark):
    got = ask(spark, [("<i>[HATA]</i>", "a"), ("<i></i>", "a"), ("—", "word"), ("—", "..."), ("ok", "a"), ("{red}", "a")], T.failure_reason)
    assert got == ["hata_isareti", "bos_hedef", "sozcuksuz_hedef", "", "", ""]


def test_source_clean(spark):
    got = ask(spark, ["漢<rt>kan</rt>", "Wait<br>here", "a<00:00:01.500>b", "<v Roger><00:00:01.500>Choose", "<i>x</i>{\\an8}"], T.clean_source)
    assert got == ["漢", "Wait here", "a b", "<v Roger>Choose", "x"]


def test_entities(spark):
    got = ask(spark, ["a &amp; b", "&#233;&#xE9;", "&#xD800;", "&filmname;", "&lt;i&gt;x", "1 &lt; 2"], T.decode_entities)
    assert got == ["a & b", "éé", "&#xD800;", "&filmname;", "&lt;i&gt;x", "1 < 2"]


def test_ass_visible(spark):
    got = ask(spark, ["{\\alpha&HFF&}hid{\\alpha&H00&}seen", "{\\p1}m 0 0{\\p0}text", "a{\\i1}b"], T.ass_visible)
    assert got == ["seen", "text", "ab"]


def test_restore_tags(spark):
    got = ask(spark, [("<i>a</i>", "b"), ("{\\an8}a", "b"), ("♪ <i>a</i> ♪", "♪ b ♪"), ("a <i>b</i>", "c"), ("<i>a</i>", "<i>b</i>")], T.restore_tags)
    assert got == ["<i>b</i>", "{\\an8}b", "♪ <i>b</i> ♪", "c", "<i>b</i>"]


def test_memory_gate(spark):
    same = lambda a, b: K.gate(a) == K.gate(b)
    got = ask(spark, [("Let's eat, Grandma!", "Let's eat Grandma!"), ("a great day", "a great day!"), ("You go?", "You go."), ("I’m here", "I'm here")], same)
    assert got == [False, True, False, True]


def test_series_key(spark):
    got = ask(spark, ["/x/Show.Name.S01E05.720p.srt", "/x/Show Name 1x05.srt", "/x/Film.2019.1280x720.srt", "/x/Anime - 05 [1080p].ass", "/shows/Big One/S02E03.srt"], K.series_key)
    assert [tuple(g) if g else None for g in got] == [("show-name", 1, 5), ("show-name", 1, 5), None, ("anime", 1, 5), ("big-one", 2, 3)]


PATHS = {
    "/a/Show.TV.S02/Show 204 Title.srt": ("show", 2, 4), "/a/Show.TV.S02/Show 304 Title.srt": None, "/a/Big Show (1999).tv.s03/Episode 7/x.srt": ("big-show", 3, 7),
    "/a/Show tv/Season 2/Puntata 5.srt": ("show", 2, 5), "/a/tv/My Show/Season 4/3 of 8.srt": ("my-show", 4, 3), "/a/Show.TV.S02/Other.S05E06.srt": ("show", 5, 6),
    "/a/A History of Art S0103.srt": ("a-history-of-art", 1, 3), "/a/BBC.Sacred.Music.Series2.1of4.srt": ("bbc-sacred-music", 2, 1), "/a/The.Question.Of.God.1of4.srt": ("the-question-of-god", 1, 1),
    "/a/Film.CD1of2.srt": None, "/a/Film CD 1of2.srt": None, "/shows/Show/S01E01 New York/S01E01.srt": ("show", 1, 1), "/shows/Show/Season 1/1x02.srt": ("show", 1, 2),
    "/d/Show.S01E04.720p/raporlar/x.srt": ("show", 1, 4), "/Show.S01E04/a/b/x.srt": None, "x.srt": None, "/a/Show Bölüm 05.srt": ("show", 1, 5), "/": None, "": None,
    "/a/Show.TV.S02/Show Ep 9.srt": ("show", 2, 9),
}


def test_series_key_rules(spark):
    got = ask(spark, list(PATHS), K.series_key)
    assert {p: tuple(g) if g else None for p, g in zip(PATHS, got)} == PATHS


def test_labels(spark):
    assert ask(spark, ["[MUSIC PLAYING]", "APPLAUSE", "♪♪", "(sighs)", "(sighs) Go.", "THE END", "Hello there", "[New York]", ""], L.is_label_only) == [True, True, True, True, False, False, False, False, False]
    assert ask(spark, ["THE END", "BERLIN 1961", "ACT I", "BOOM"], L.is_card) == [True, True, True, False]
    assert ask(spark, ["MAN: Hello\n[door slams] Go", "[APPLAUSE]"], L.strip_labels) == ["Hello\nGo", "[APPLAUSE]"]
    assert ask(spark, [("(gülme) Evet", "(laughs) Yes"), ("(gülme) Evet", "Yes")], L.strip_by_source) == ["Evet", "(gülme) Evet"]


def test_turkish(spark):
    got = ask(spark, ["geliyorsun", "gelirsin", "olsun", "gelsin", "yaptın", "kentin", "kadın", "insan"], TR.second_person)
    assert got == [True, True, False, False, True, False, False, False]
    assert ask(spark, [("Ada'ya", "Ada"), ("Adalet", "Ada"), ("Catalog", "Cat"), ("Adalar", "Ada")], TR.suffix_form) == [True, False, False, True]
    assert ask(spark, ["Sevinme, ey toprak", "Elma ye.", "Sinema iyiydi.", "Başka aşk yoktur.", "Yoksul bir ülke."], TR.negated) == [True, False, False, True, False]


def test_numbers(spark):
    got = ask(spark, [("For 3 years", "Üç yıl"), ("For 15 years.", "On beş yıl"), ("200 grams", "iki yüz gram"), ("3 years", "O 5 yaşında"), ("at 8:30", "saat 08.30'da"), ("none", "üç")], lambda s, t: F.size(G.lost_numbers(s, t)) > 0)
    assert got == [False, False, False, True, False, False]


def test_rewrite_guard(spark):
    cases = [("Bu\niyi.", "Bu iyi.", "linebreak_count"), ("[ÇEVİRİ EKSİK]", "x", "missing_placeholder"), ("", "x", "old_empty"), ("100 dolar ver", "para ver bana", "numbers"),
             ("<i>Git.</i>", "Git.", "format_tags"), ("- Gel.", "Gel.", "speaker_dash"), ("Bu iyi.", "Bu güzel.", "")]
    assert ask(spark, [(o, n) for o, n, _ in cases], lambda o, n: G.rewrite_reason(F.lit("s"), o, n)) == [r for *_, r in cases]


def test_json_and_replicas(spark):
    assert ask(spark, ["},{", "a },{ b", "{\\i0}x", ","], T.strip_json) == ["", "a   b", "{\\i0}x", ","]
    assert ask(spark, [("- a\n- b", "- a"), ("- a\n- [door]", "- a"), ("- a\n- b", "- a\n- b")], G.missing_replica) == [True, False, False]
