"""The similarity lookup next to all pairs in plain Python."""

import difflib
import random

from pyspark.sql import functions as F

from cueflow.functions import keys as K
from cueflow.functions import text as T
from cueflow.operators import memory


def test_similar_by_all_pairs(spark):
    rng = random.Random(4)
    words = ["Größe", "niño", "l'eau", "go", "12", "no", "it's", "été", "ok"]
    some = [" ".join(rng.choice(words) + rng.choice(["", "", ",", " -"]) for _ in range(rng.randrange(1, 6))) + rng.choice([".", "?", "!", "…", ""]) for _ in range(60)]
    entries = [("de" if i % 3 else "fr", s, f"hedef {i % 7}") for i, s in enumerate(some)] + [("de", "same same", "same same"), ("de", "[Hm] Wait, what?", "x"), ("de", "", "y")]
    asked = [(lang, s + rng.choice(["", "!", ".", " ", "?"])) for lang, s, _ in entries] + [("fr", None), ("de", "short")]
    m = spark.createDataFrame(entries, "lang string, source string, target string")
    a = spark.createDataFrame(asked, "lang string, text string")
    key = lambda d, c: d.withColumns({"norm": K.memory_norm(F.col(c)), "gate": K.gate(F.col(c))})
    stored = {}
    for r in key(m, "source").withColumn("fit", K.usable(F.col("source"), F.col("target")) & (F.size(T.tokens(F.col("source"))) > 0)).filter("fit").collect():
        stored.setdefault((r.lang, r.gate), {}).setdefault(r.norm, []).append(r.target)
    want = {}
    for r in key(a, "text").filter(F.length("norm") >= 6).collect():
        own = stored.get((r.lang, r.gate), {})
        best = [(1.0, r.norm, max(own[r.norm]))] if r.norm in own else []
        for cand, targets in own.items():
            ratio = difflib.SequenceMatcher(None, cand, r.norm, autojunk=False).ratio()
            if not best and 0.6 * len(r.norm) <= len(cand) <= 1.4 * len(r.norm) and ratio >= memory.THRESHOLD:
                want.setdefault((r.lang, r.norm, r.gate), []).append((ratio, cand, max(targets)))
        if best:
            want[(r.lang, r.norm, r.gate)] = best
    got = sorted((r.lang, r.norm, r.target, round(r.ratio, 6)) for r in memory.similar(a, m, "text", ["lang"]).collect())
    assert got == sorted((lang, norm, max(c)[2], round(max(c)[0], 6)) for (lang, norm, _), c in want.items()) and len(got) > 20


def test_keys_read_their_text_once(spark):
    d = spark.createDataFrame([("Wait… no, it's 4:30?", "Bekle"), (" x  ", "x"), ("a\t b", "<i></i>"), (None, "y")], "source string, target string").repartition(1)
    made = d.select(K.usable(F.col("source"), F.translate("target", "a", "b")).alias("u"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert sorted(str(r.u) for r in made.collect()) == ["False", "False", "None", "True"]
    got = d.coalesce(1).orderBy(F.col("target") != "Bekle", F.col("target") != "x", F.col("target") == "y").select(K.skeleton(F.col("source")).alias("s"), T.squeeze(F.col("source")).alias("q"), K.unworded(F.col("source")).alias("w")).collect()
    assert [r.s for r in got] == [".,:", "", "", None]
    assert [r.q for r in got] == ["Wait… no, it's 4:30?", "x", "a b", None]
    assert [r.w for r in got][:1] == ["a… a, a'a:a?"]
