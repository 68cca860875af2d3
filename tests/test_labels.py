"""Bracket groups, label strips and glossary automata, next to plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from cueflow.functions import labels as L
from cueflow.operators import canon


def groups(text):
    """Balanced bracket groups by a walk over the signs."""
    out, stack, start = [], [], 0
    for i, c in enumerate(text):
        if c == "\n":
            stack = []
        elif c in "[(":
            if not stack:
                start = i
            stack.append(c)
        elif c in "])" and stack:
            if stack.pop() + c not in ("[]", "()"):
                stack = []
            elif not stack and i - start - 1 <= L.LONGEST_GROUP:
                out.append(text[start : i + 1])
    return out


def ask(spark, texts, *columns):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    return [tuple(r)[1:] for r in d.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()]


def test_bracket_groups(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("[]()\n[](a é♪:") for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += ["[" + "x" * n + "]" for n in (299, 300, 301)] + ["", "((a) [b [c]]) (d)"]
    got = ask(spark, texts, L.bracket_groups(F.col("s")), F.aggregate(L.bracket_pieces(F.col("s")), F.lit(""), lambda a, p: F.concat(a, p["t"])))
    for text, (found, whole) in zip(texts, got, strict=True):
        assert found == groups(text) and whole == text, text


STRIPS = {
    "[door creaks] Hello": "Hello", "(sighs) <i>Yes</i>": "<i>Yes</i>", "[Soft Power] A documentary.": "[Soft Power] A documentary.",
    "- [John]: hi\n[LAUGHS]": "hi", "(OK)": "(OK)", "x [y": "x [y", "JOHN: hey": "hey", "((whispering)) no": "no", ">> [MAN 2] go": "go",
    "[THE END]": "[THE END]", "[1978]": "[1978]", "(and then he left)": "(and then he left)", "[MUSIC]": "[MUSIC]", "♪ la ♪": "♪ la ♪",
    "Well [coughs] , so": "Well, so", "<i>[soft music]</i>\nNow": "Now", "a (b [c] d) e": "a (b [c] d) e", "[a (b] c)": "[a (b] c)",
}


def test_strip_labels(spark):
    got = ask(spark, list(STRIPS), L.strip_labels(F.col("s")))
    assert {k: v[0] for k, v in zip(STRIPS, got, strict=True)} == STRIPS


BY_SOURCE = [
    ("[Müzik] Selam", "[MUSIC] Hi", "Selam"), ("(şimdi) Selam", "(now) Hi", "(şimdi) Selam"), ("[JOHN]: Selam", "[JOHN]: Hi", "Selam"),
    ("- (iç çeker)", "- (sighs)", ""), ("[a] [b]", "[MUSIC] [New York]", "[b]"), ("[x] y", "no group", "[x] y"), ("[LAUGHS] q", "(LAUGHS) r", "q"),
    ("a (b)\n(c) d", "e\n(sighs) f", "a (b)\nd"), ("(a [b] c) d", "(door [loud] creaks) e", "d"), ("♪ (x) ♪", "♪ (laughs) ♪", "♪ ♪"),
]


def test_strip_by_source(spark):
    d = spark.createDataFrame(BY_SOURCE, "t string, s string, want string")
    assert [r for r in d.withColumn("got", L.strip_by_source(F.col("t"), F.col("s"))).collect() if r.got != r.want] == []


@pytest.mark.parametrize("forms", [200_000, 2])
def test_glossary_by_walk(spark, monkeypatch, forms):
    monkeypatch.setattr(canon, "SHARD_FORMS", forms)
    terms = ["cat", "the cat", "the", "iron man", "man", "ox", "a b c", "é"]
    texts = ["The cats and the cat", "iron man's ironmans", "oxs ox", "a b c a b cs", "", None, "Men, man! THE é."] * 3
    g = spark.createDataFrame([(t, t.upper()) for t in terms], "term string, rendering string")
    d = spark.createDataFrame(list(enumerate(texts)), "i int, src string")
    got = sorted((r.i, r.term) for r in canon.term_hits(d, g, "src").collect())
    lines = {r.i: r.line for r in d.select("i", F.array_join(canon._tokens(F.col("src")), " ").alias("line")).collect()}
    want = []
    for i, line in lines.items():
        for t in terms:
            ends = ("", "s") if len(t.split()[-1]) >= 3 else ("",)
            if line is not None and any(f" {t}{e} " in f" {line} " for e in ends):
                want.append((i, t))
    assert got == sorted(want) and len(got) > 12
