"""Lost numbers with units, and classes of inflected renderings."""

from pyspark.sql import functions as F

from cueflow.functions import guards as G
from cueflow.operators import audit

KEPT = [
    ("For 3 years nobody noticed", "Üç yıl boyunca kimse fark etmedi"), ("200 grams", "iki yüz gram"), ("50,000 spectators", "Elli bin seyirci"),
    ("2 more cows", "İki inek daha"), ("I start at 5", "Beşte başlıyorum"), ("Today at 8:30 A.M.", "Bugün saat 08.30'da,"),
    ("150 pounds", "68 kilo"), ("102 degrees", "38,9 derece"), ("6 feet tall", "1,80 metre boyunda"), ("no numbers here", "üç beş"),
    ("1,500 pounds", "680 kilo"), ("10 miles and 20 miles", "16 kilometre ve 32 km"), ("5.5 inches", "14 santim"),
]
LOST = [
    ("200 grams", "300 gram", ["200"]), ("1993 idi", "1933 idi", ["1993"]), ("He was 3 years old", "O 5 yaşındaydı", ["3"]), ("back in 1912", "savaş öncesi", ["1912"]),
    ("150 pounds", "90 kilo", ["150"]), ("10 miles and 20 miles", "16 kilometre", ["20"]), ("6 feet", "on metre", ["6"]),
]


def test_lost_numbers(spark):
    rows = [(i, s, t, []) for i, (s, t) in enumerate(KEPT)] + [(100 + i, s, t, want) for i, (s, t, want) in enumerate(LOST)]
    d = spark.createDataFrame(rows, "i int, s string, t string, want array<string>")
    got = d.withColumn("got", F.array_sort(G.lost_numbers(F.col("s"), F.col("t")))).filter("got <> want").collect()
    assert got == []


def classes(forms):
    """Connected components of words and their stems by plain search."""
    import re

    from cueflow.functions import turkish as TR

    run = re.compile(TR.SUFFIX_RUN.replace(r"\p{L}", "[^\\W\\d_]"))
    fits = lambda w, p: w.startswith(p) and len(re.sub("['’]", "", w[len(p) :])) <= 12 and run.match(w[len(p) :])
    stems = {w: {w[:i] for i in range(min(3, len(w)), len(w) + 1) if fits(w, w[:i])} for w in forms}
    out, left = [], set(forms)
    while left:
        group = {left.pop()}
        while more := {w for w in left if any(stems[w] & stems[g] for g in group)}:
            group |= more
            left -= more
        out.append(sorted(group))
    return sorted(out)


def test_stem_classes(spark):
    forms = ["abcdeone", "abcdetwo", "inkalar", "inkaların", "inka", "incas", "incas'ın", "evler", "evde", "evimizden", "ev", "kitap", "kitaplar", "kitabı", "ab", "a", "araba", "arabalı", "arabada"]
    d = spark.createDataFrame([("t", f) for f in forms] + [("u", "evler")], "term string, form string")
    got = {}
    for r in audit.stem_classes(d, ["term"], "form").filter("term = 't'").collect():
        got.setdefault(r.stem, []).append(r.form)
    assert sorted(sorted(v) for v in got.values()) == classes(forms)
    assert not any({"abcdeone", "abcdetwo"} <= set(v) for v in got.values())


def test_mixed_renderings(spark):
    cases = {
        "Incas": ["İnkalar", "İnkalar", "Incas", "Incas", "İnkaların"], "one": ["İnkalar", "İnkalar", "İnkalar", "İnkalar", "İnkaların"],
        "few": ["İnkalar", "Incas"], "single": ["İnkalar", "İnkalar", "İnkalar", "İnkalar", "Incas'ın"], "abc": ["abcdeone", "abcdeone", "abcdetwo", "abcdetwo"],
    }
    d = spark.createDataFrame([(t, r) for t, rs in cases.items() for r in rs], "term string, rendering string")
    got = {r.term: (r.total, r.renderings) for r in audit.mixed_renderings(d).collect()}
    assert got == {"Incas": (5, 2), "abc": (4, 2)}
