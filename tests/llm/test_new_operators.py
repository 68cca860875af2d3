"""Substring de-duplication, structure repair and collocations, next to brute force."""

import collections
import functools
import hashlib
import itertools
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))

from cueflow.llm import fm_index, phrases, repair, substring  # noqa: E402

WORDS = r"[^\x20\x09-\x0D]+"


# --- substring de-duplication --------------------------------------------------------------


def test_fm_index_finds_repeated_windows():
    rng = np.random.default_rng(1)
    for trial in range(150):
        pieces, window = rng.integers(1, 8), rng.integers(2, 6)
        sizes = rng.integers(1, 12, pieces)
        text = rng.integers(1, 4, sizes.sum())
        weights = rng.integers(1, 3, pieces) if trial % 2 else np.ones(pieces, int)
        at = np.cumsum(sizes) - sizes
        places = [(i, s) for i in range(pieces) for s in range(sizes[i] - window + 1)]
        take = lambda i, s: tuple(text[at[i] + s : at[i] + s + window])  # noqa: B023,E731
        n = collections.Counter()
        for i, s in places:
            n[take(i, s)] += weights[i]
        got = [(int(i), s) for i, a, b in zip(*fm_index.FMIndex(text, sizes, weights).repeated(window), strict=True) for s in range(a, b + 1)]
        assert len(got) == len(set(got)) and set(got) == {x for x in places if n[take(*x)] >= 2}


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (63, 2), (64, 5), (1000, 37)):
        s = rng.integers(0, k, n)
        m = fm_index.WaveletMatrix(s, k)
        ask, upto = rng.integers(0, k, 200), rng.integers(0, n + 1, 200)
        assert m.rank(ask, upto).tolist() == [int((s[:i] == c).sum()) for c, i in zip(ask, upto, strict=True)]


def brute_substring(rows, size=35):
    ws = [re.findall(WORDS, t or "") for _, t in rows]
    n = collections.Counter(tuple(w[i : i + size]) for w in ws for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, ws, strict=True):
        gone = {k for i in range(len(w) - size + 1) if n[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("anchor_words", "index_bytes"), [(1 << 21, 8 << 20), (100, 8 << 20), (1 << 21, 2000)])
def test_substring(spark, monkeypatch, anchor_words, index_bytes):
    monkeypatch.setattr(substring, "ANCHOR_WORDS", anchor_words)
    monkeypatch.setattr(substring, "INDEX_BYTES", index_bytes)
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(1000)}" for _ in range(n)]
    passage, short = some(60), some(36)
    # Null, empty, periodic and very long texts; a passage in many contexts; windows of 34 to 36 words; repeated rows and ids.
    rows = [(None, None), (1, ""), (2, " \n"), (3, "a " * 500), (4, "a b " * 40), (5, " ".join(some(3000) + passage)), (6, "é" * 5000)]
    rows += [(10 + i, " ".join(some(rng.randrange(10)) + passage + some(rng.randrange(10)))) for i in range(60)]
    rows += [(100 + i, " \n ".join(some(5) + short[: 34 + i % 3] + some(30) + short)) for i in range(20)]
    rows += [(200, rows[20][1]), (200, rows[20][1]), (None, rows[30][1]), (None, "x " * 34), (7, "y " * 36)]
    d = spark.createDataFrame([(a, b, 1, 2, "s") for a, b in rows], "doc_id long, text string, n_words int, _k int, spans string")
    got = substring.without_repeats(d)
    assert got.columns == ["doc_id", "text", "_k", "spans", "n_words", "n_removed", "kept_text"]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()], key=str) == brute_substring(rows)


def test_substring_of_nothing(spark):
    assert substring.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- structure repair -------------------------------------------------------------------------


def brute_repair(rows):
    """conv -> all result columns, by memoised search over edits; rows are (conv, turn, role, text)."""
    convs={}
    for c,t,r,x in rows: convs.setdefault(c,[]).append((t,r if r is not None else " ",x if x is not None else " "))
    out={}
    for c,rs in convs.items():
        dam=[]
        for t,r,x in sorted(rs,key=lambda v:(v[0] is not None,v[0] or 0,v[1],v[2])):
            h=zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode())%20
            if h==0: continue
            if h==1: x=""
            if h==2: x=re.sub("[.!?]","",x)
            if h==4: r="user"
            dam+= [(t,r,x)]*(2 if h==3 else 1)
        if not dam: out[c]=(0,0,0,0,0,0,"",hashlib.sha256().hexdigest()); continue
        ts=[t for t,_,_ in dam if t is not None]
        gaps=max(ts)-min(ts)+1-len(set(ts)) if ts else 0
        seen=set(); f=[]
        for t,r,x in dam:
            s=re.findall(r"[^\x20\x09-\x0D]",x)
            if not s: f.append("b")
            elif (r,x) in seen: f.append("d")
            elif s[-1] not in ".!?": f.append("t")
            else: f.append("")
            seen.add((r,x))
        ill=sum(a[1][:1]+b[1][:1] not in("su","ua","au") for a,b in zip(dam,dam[1:]))
        n=len(dam)
        def trans(q,ch):
            if ch=="s": return 1 if q==0 else None
            if ch=="u": return 2 if q in(0,1,3) else None
            if ch=="a": return 3 if q==2 else None
        @functools.lru_cache(None)
        def best(i,q,ins):
            # (cost, audit, rows)
            cands=[]
            if i==n and q in(0,3): cands.append((0,"",()))
            if i<n:
                t,r,x=dam[i]; extra=5 if f[i]=="t" else 0
                def add(cost,l,q2,row):
                    if q2 is None: return
                    b=best(i+1,q2,0)
                    if b: cands.append((cost+b[0],l+b[1],row+b[2]))
                add(2,"D",q,())
                if f[i] not in("b","d"):
                    add(extra,"K",trans(q,r[:1]) ,((r,x),))
                    for rr in("user","assistant"): add(1+extra,"R",trans(q,rr[0]),((rr,x),))
            if ins<4:
                for rr in("user","assistant"):
                    q2=trans(q,rr[0])
                    if q2 is not None:
                        b=best(i,q2,ins+1)
                        if b: cands.append((5+b[0],"I"+b[1],((rr,""),)+b[2]))
            return min(cands) if cands else None
        b=best(0,0,0)
        out[c]=(gaps,f.count("b"),f.count("d"),f.count("t"),ill,b[0],b[1],hashlib.sha256("\n".join(f"{r}:{x}" for r,x in b[2]).encode()).hexdigest())
    return out


def conversations(seed,n):
    rng=random.Random(seed); rows=[]
    for c in range(n):
        for t in range(rng.randrange(0,12)):
            if rng.random()<.05: continue
            role=rng.choice(["user","assistant","user","assistant","system","tool",None,""])
            text=rng.choice(["Hi.","Yes!","what","Why? ","  ","","ok.\n","a.b"])+str(rng.randrange(9) if rng.random()<.5 else "") if rng.random()<.9 else None
            rows.append((c if rng.random()<.99 else None, t if rng.random()<.95 else None, role, text))
    return rows


@pytest.mark.parametrize(("ranked", "coalesce", "partitions"), [(1 << 15, "true", 4), (3, "false", 24)])
def test_repair(spark, monkeypatch, ranked, coalesce, partitions):
    monkeypatch.setattr(repair, "RANKED", ranked)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        # One conversation holds a third of the rows and spans several tasks; one has repeated rows on one turn.
        rows = conversations(1, 100) + [(9999, i, "user" if i % 3 else "assistant", f"t{i}." if i % 7 else f"t{i}") for i in range(200)] + [(5, 3, "user", "Same.")] * 4
        sys.setrecursionlimit(10_000)
        want = brute_repair(rows)
        d = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, pos int, conv string").repartition(5)
        got = {r.conv_id: tuple(r)[1:] for r in repair.summary(d).collect()}
        assert got == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_repaired_rows_have_the_form(spark):
    rows = conversations(2, 60)
    d = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    edits, totals = repair.repair(d)
    by = collections.defaultdict(list)
    for r in repair.repaired_rows(edits).collect():
        by[r.conv].append((r.pos, r.step, r.role[:1]))
    left = {r.conv: r.left for r in edits.orderBy("pos").select("conv", "left").collect()}
    for conv, rs in by.items():
        initials = "".join(x[2] for x in sorted(rs)) + {0: "", 3: "", 2: "a", 1: "ua"}[left[conv]]
        assert re.fullmatch("(s?(ua)+)?", initials), (conv, initials)


def test_repair_of_nothing(spark):
    assert repair.summary(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- collocations --------------------------------------------------------------------------------


def brute_phrases(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k, i in itertools.product(range(1, 5), range(len(w))):
                if i + k <= len(w):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        own = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = collections.Counter()
        for p, a in own.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in own.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), a, l, r, score))
        for rank, (_, _, p, a, l, r, score) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), a, l, r, n[lang], score))
    return sorted(out)


@pytest.mark.parametrize(("hot", "windows"), [(1 / 1024, 1_500_000), (0.02, 50), (2.0, 50)])
def test_phrases(spark, monkeypatch, hot, windows):
    monkeypatch.setattr(phrases, "HOT_SHARE", hot)
    monkeypatch.setattr(phrases, "SHARD_WINDOWS", windows)
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "D", "é", "日", "x-y", "a'b"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(60)) for _ in range(60)]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts] + [("en", None), ("fr", ""), ("en", "." * 50), ("en", "of the " * 400)] + [("de", texts[3])] * 5
    d = spark.createDataFrame([(*r, 1, "w") for r in rows], "lang string, text string, w0 int, n string").repartition(3)
    got = phrases.collocations(d, least=5, top=20)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 5, 20)


def test_phrase_scores_beyond_64_bits(spark, monkeypatch):
    big = 10**13
    monkeypatch.setattr(phrases, "counted", lambda d, least: spark.createDataFrame([("en", [], 4 * big), ("en", ["a"], 2 * big), ("en", ["b"], 2 * big), ("en", ["a", "b"], big)], "lang string, p array<string>, f long"))
    assert [tuple(r) for r in phrases.collocations(None).collect()] == [("en", 1, "a b", big, 2 * big, 2 * big, 4 * big, 500_000)]


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
