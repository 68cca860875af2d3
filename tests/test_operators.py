"""Pinned cases of the table operators."""

from pyspark.sql import functions as F

from cueflow.functions import text as T
from cueflow.operators import align, audit, canon, findings, journal, memory, payload, sequence
from cueflow.sources import subtitles
from cueflow.streaming import jobs

CUES = "file_id long, pos long, start_ms long, end_ms long, text string"


def cues(spark, *rows):
    return spark.createDataFrame([(1, i + 1, s, e, t) for i, (s, e, t) in enumerate(rows)], CUES).withColumn("cue_no", F.col("pos"))


def test_srt_round(spark, rows):
    text = "1\n00:00:01,000 --> 00:00:02,000\nHello\n\n2\n00:00:03,000 --> 00:00:04,000\na\n\nb\n"
    got = rows(subtitles.parse_srt(spark.createDataFrame([(1, text)], "f int, c string"), "f", "c"), "pos")
    assert [(r[2], r[3], r[4], r[5]) for r in got] == [(1, 1000, 2000, "Hello"), (2, 3000, 4000, "a\nb")]


def test_scene_gap(spark, rows):
    c = cues(spark, (0, 2000, "a"), (5000, 6000, "b"), (7000, 8000, "c"))
    assert [r[0] for r in sequence.scenes(c).orderBy("pos").select("scene").collect()] == [1, 2, 2]


def test_alignment_pairs_duplicates_once(spark):
    s = cues(spark, (0, 1, "a"), (0, 1, "b"), (5, 6, "c"))
    d = cues(spark, (0, 1, "x"), (0, 1, "y"), (9, 10, "z"), (20, 21, "w"))
    got = {(r.src_text, r.tgt_text, r.how) for r in align.by_time(s, d).collect()}
    assert got == {("a", "x", "time"), ("b", "y", "time"), ("c", "z", "number"), (None, "w", "delivery_only")}


def test_composite_span(spark):
    s = cues(spark, (0, 1000, "I do"), (1000, 2000, "not know.")).withColumn("cue_no", F.col("pos") + 9).withColumn("scene", F.lit(1))
    d = cues(spark, (0, 2000, "Bilmiyorum."))
    r = align.season_spans(s, d).collect()[0]
    assert (r.src_id, r.src_text) == ("10|11", "I do not know.")
    split = s.withColumn("scene", F.col("pos"))
    assert align.season_spans(split, d).collect()[0].src_id is None


def test_memory_ambiguity(spark):
    b = spark.createDataFrame([("h", "Right.", "Sağ.", 1), ("h", "Right.", "Doğru.", 2), ("k", "Go.", "Git.", 3)], "hash string, source string, target string, n int")
    old = spark.createDataFrame([("h", "Right.", "Evet."), ("o", "x", "y")], "hash string, source string, target string")
    assert {r.hash for r in memory.store(old, b, ["n"]).collect()} == {"k", "o"}


def test_payload_faults(spark):
    data = [(1, '[{"i":"1","t":"a"},{"i":"1","t":"b"}]'), (2, '[{"i":"1","t":"a"},{"i":"9","t":"b"}]'), (3, 'x [{"i":"1","t":"a"},{"i":"2","t":"b"'), (4, "no"),
            (5, '[{"i":"1","t":"a"}] [{"i":"1","t":"z"}]')]
    df = spark.createDataFrame(data, "k int, raw string").withColumn("expected", F.array(F.lit("1"), F.lit("2")))
    got = {r.k: (r.mode, r.fatal, r.missing_ids) for r in payload.integrity(df, "k", "raw", "expected").collect()}
    assert got[1][1] == "duplicate_id" and got[2][1] == "unexpected_id" and got[4] == ("invalid", "invalid_json", ["1", "2"])
    assert got[3][0] == "salvaged" and got[3][2] == ["2"] and got[5][0] == "ambiguous_multiple_payloads"


def test_retention_keeps_newest(spark):
    r = spark.createDataFrame([(1, 1, 500), (1, 2, 10), (1, 3, 10)], "s int, o long, b long")
    assert [x.kept for x in journal.retention(r, "s", "o", "b", 20, 100).orderBy("o").collect()] == [True, False, False]


CALLS = "route long, model string, call_no long, status long, ts_ms long"


def test_breaker_batch_and_stream(spark, tmp_path):
    status = [503, 503, 503, 503, 200, 503, 503, 429, 503, 503, 503, 401, 200]
    data = [(1, "m", i + 1, s, i * 1000) for i, s in enumerate(status)] + [(2, "m", 50 + i, 503, i) for i in range(2)]
    df = spark.createDataFrame(data, CALLS)
    for block in (2, 4, 100):
        b = journal.breaker(df, ["route", "model"], block).filter("event <> ''")
        got = sorted((r.route, r.call_no, r.event) for r in b.collect())
        assert got == [(1, 3, "open"), (1, 4, "reopen"), (1, 5, "recovered"), (1, 11, "open")]
    # A row far behind moves the watermark past the others; Spark's first watermark is the epoch, so times lie after it.
    end = spark.createDataFrame([(-1, "", 999, 200, 10**10)], CALLS)
    df.withColumn("ts_ms", F.col("ts_ms") + 1000).unionByName(end).withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(str(tmp_path / "calls"))
    with jobs.with_state_store(spark):
        out = jobs.run_append(jobs.breaker_stream(jobs.tail_parquet(spark, str(tmp_path / "calls")), "ts"), "breaker")
    assert sorted((r.route, r.call_no, r.event) for r in spark.read.parquet(out).collect()) == got


def test_canon_as_of_is_numeric(spark):
    c = spark.createDataFrame([("t", 1, 10), ("u", 1, 1), ("v", None, None)], "src string, season int, episode int")
    seen = lambda **k: {r.src for r in canon.visible(c, F.lit(1), F.lit(2), **k).collect()}
    assert seen() == {"u", "v"} and seen(blocked=True) == {"u"}


def test_glossary_words(spark):
    t = spark.createDataFrame([(1, "let's start now"), (2, "the cylon's plan"), (3, "old yorkshire"), (4, "in New York")], "i int, src string")
    g = spark.createDataFrame([("art", "x"), ("cylon", "x"), ("new york", "x")], "term string, rendering string")
    assert {(r.i, r.term) for r in canon.term_hits(t, g, "src").collect()} == {(2, "cylon"), (4, "new york")}


def test_findings_pins(spark):
    data = [("a", "very very very good"), ("♪ a ♪", "♪ b"), ("♪ a", "♪ b"), ("a", "x (yani) y"), ("a", "a\ne b"), ("a b", "halo },{ b")]
    p = spark.createDataFrame([(1, i + 1, 500, 0, 1, s, t) for i, (s, t) in enumerate(data)], "file_id int, pos long, no long, start_ms long, end_ms long, src string, tgt string")
    got = {(r["class"], r.pos) for r in findings.by_row(p, ["repetition_collapse", "unbalanced_note", "translator_gloss", "stray_line_initial_e", "serialized_json_residue"]).collect()}
    assert got == {("repetition_collapse", 1), ("unbalanced_note", 2), ("translator_gloss", 4), ("stray_line_initial_e", 5), ("serialized_json_residue", 6)}


def test_gate_rules(spark):
    f = spark.createDataFrame([("broken_italic", 1), ("english_filler", 2), ("introduced_out_of_order", 3)], "class string, file_id int")
    assert {r.file_id: (r.scan_fails, r.fails) for r in findings.gate(f).collect()} == {1: (True, True), 2: (False, False), 3: (False, True)}


def greedy_chunks(tags, scenes, target, reach):
    out, i, n = [], 0, len(tags)
    while i < n:
        if n - i <= target:
            out.append(n - i)
            break
        ends = [j for j in range(i + target - 1, n) if tags[j] in ("none", "end")]
        gaps = [j for j in ends if j < min(i + reach, n - 1) and scenes[j] != scenes[j + 1]]
        j = gaps[0] if gaps else ends[0]
        out.append(j + 1 - i)
        i = j + 1
    return out


def test_chunks_against_walk(spark):
    words = ["one", "two.", "three", "four", "five.", "six", "seven.", "eight"] * 6
    t = 0
    rows = []
    for i, w in enumerate(words):
        t += 4000 if i % 7 == 3 else 100
        rows.append((t, t + 50, w))
        t += 50
    c = sequence.scenes(sequence.fragments(cues(spark, *rows), "text")).orderBy("pos").collect()
    want = greedy_chunks([r.tag for r in c], [r.scene for r in c], 4, 9)
    got = [r["n"] for r in sequence.chunks(cues(spark, *rows), "text", target=4, reach=9).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()]
    assert got == want and sum(got) == len(words)


def test_chunks_keep_a_long_group_whole(spark):
    words = ["a."] * 3 + ["so"] * 59 + ["end."] + ["b."] * 10
    rows = [(i * 1000, i * 1000 + 900, w) for i, w in enumerate(words)]
    got = [r["n"] for r in sequence.chunks(cues(spark, *rows), "text", target=5, reach=9).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()]
    assert got == [63, 5, 5]
    # A scene gap behind the target, inside the reach.
    rows = [(i * 1000 + (8000 if i >= 7 else 0), i * 1000 + 900 + (8000 if i >= 7 else 0), "Line.") for i in range(12)]
    got = [r["n"] for r in sequence.chunks(cues(spark, *rows), "text", target=5, reach=10).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()]
    assert got == [7, 5]


def test_merge_fragments(spark):
    c = cues(spark, (5706, 7000, "Peki, ananla ne yapacaksın"), (7000, 7975, "ki?"), (12000, 13000, "dur"), (16100, 17000, "gel"))
    got = [(r.start_ms, r.end_ms, r.text) for r in sequence.merge_fragments(c.withColumn("src", F.lit("open")), "src", "text").orderBy("cue_no").collect()]
    assert got == [(5706, 7975, "Peki, ananla ne yapacaksın ki?"), (12000, 13000, "dur"), (16100, 17000, "gel")]
    long = cues(spark, *[(i * 1000, i * 1000 + 1000, "x" * 30) for i in range(7)])
    sizes = [r.parts for r in sequence.merge_fragments(long.withColumn("src", F.lit("open")), "src", "text").orderBy("cue_no").collect()]
    assert sizes == [2, 2, 2, 1]


def test_rebreak_keeps_text(spark):
    s = "this is a rather long line of words that has to be broken in two"
    r = spark.createDataFrame([(s,)], "t string").select(sequence.rebreak(F.col("t"))).collect()[0][0]
    assert r.replace("\n", " ") == s and max(map(len, r.split("\n"))) <= 42


def test_reading_speed_limits(spark):
    c = spark.createDataFrame([(1, 1, 1000, "x" * 60), (1, 2, 5000, "x" * 7)], "file_id int, pos int, dur_ms long, t string")
    assert [(r.fast, r.char_budget) for r in audit.reading_speed(c, "t", target_cps=20).orderBy("pos").collect()] == [(True, 20), (False, 100)]


def test_span_over_hours_and_hot_minute(spark):
    import itertools

    from cueflow.operators import ranges

    spans = [(0, 0, 360_000_000_000), (1, 5_000, 6_000), (2, 5_000, 6_000), (3, 59_999, 60_001), (4, 100, 50), (5, None, 7)]
    points = [(i, s, s + w) for i, (s, w) in enumerate(itertools.product((0, 5_000, 5_500, 59_999, 7_200_000), (0, 1, 500)))]
    s = spark.createDataFrame([(1, *r) for r in spans], "f int, a int, s0 long, s1 long")
    p = spark.createDataFrame([(1, *r) for r in points], "f int, b int, p0 long, p1 long")
    got = sorted((r.a, r.b) for r in ranges.containment(p, s, "f", "p0", "p1", "s0", "s1").collect())
    whole = [x for x in spans if x[1] is not None and x[1] <= x[2]]
    assert got == sorted((x[0], y[0]) for x in whole for y in points if x[1] <= y[1] and y[2] <= x[2])
    got = sorted((r.a, r.b) for r in ranges.overlaps(s, p, "f", "s0", "s1", "p0", "p1").collect())
    assert got == sorted((x[0], y[0]) for x in whole for y in points if x[1] <= y[2] and y[1] <= x[2])


def test_equal_stamps_are_paired_one_to_one(spark):
    c = cues(spark, (0, 1, "one"), (0, 1, "two"), (0, 1, "three"))
    assert align.gated(c, c).count() == 3
    r = align.rewrite_diff(c, c).collect()[0]
    assert (r.changed, r.removed, r.added, r.tokens_lost) == (0, 0, 0, 0)
    fewer = cues(spark, (0, 1, "bir"), (0, 1, "iki"))
    assert [(g.pos, g["class"]) for g in align.dialogue_gaps(c, fewer).collect()] == [(3, "missing_dialogue")]


def test_encodings(spark):
    from cueflow.sources import encodings

    long = "x" * 5000
    cases = [
        ("utf-8", "naïve 語\r\n".encode()), ("utf-8", b"ab\0" + long.encode()), ("utf-16-le", (long + " ağaç 語").encode("utf-16-le")), ("utf-16-be", "a\n語語語".encode("utf-16-be")),
        ("utf-32-le", "ağ 😀".encode("utf-32-le")), ("utf-32-be", "ağ 😀".encode("utf-32-be")), ("utf-32", "a語".encode("utf-32")), ("utf-16", "a😀".encode("utf-16")),
        ("utf-8-sig", "ağ".encode("utf-8-sig")), ("cp1251", (long + " привет, как дела").encode("cp1251")), ("cp1253", "καλημέρα σας".encode("cp1253")),
        ("cp1254", "şaşırdığı için".encode("cp1254")), ("cp1255", "שלום לכולם, אני הולך הביתה עכשיו".encode("cp1255")), ("cp1256", "السلام عليكم".encode("cp1256")), ("mac_roman", "déjà vu, très bien".encode("mac_roman")),
    ]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (_, b) in enumerate(cases)] + [(99, None), (98, bytearray(b"\xff\xfe\x00\xd8")), (97, bytearray(b""))], "i int, c binary")
    got = {r.i: (r.encoding, r.text) for r in encodings.decode(df, "c").collect()}
    for i, (enc, raw) in enumerate(cases):
        assert got[i] == (enc, raw.decode(enc).replace("\r\n", "\n")), enc
    assert got[99] == (None, None) and got[97] == ("utf-8", "") and got[98][0] not in ("utf-16", None)


def test_payload_knows_strings_and_types(spark):
    item = lambda i, t: '{"i":"%s","t":%s}' % (i, t)
    odd = r'"{\\an8}Hi [MUSIC] \"q\" ]}"'
    data = [(1, "[" + item(1, odd) + "," + item(2, '"b"') + "]"), (2, '{"tr": [' + item(1, odd) + "]}"), (3, "Here: [" + item(1, odd) + ", " + item(2, '"b"') + ', {"i": "3", "t": "x'),
            (4, "[" + item(1, "5") + "," + item(2, '"b"') + "]"), (5, "note [MUSIC] [" + item(1, odd) + "] end"), (6, None), (7, "")]
    df = spark.createDataFrame(data, "k int, raw string").withColumn("expected", F.array(F.lit("1"), F.lit("2")))
    got = {r.k: r for r in payload.integrity(df, "k", "raw", "expected").collect()}
    text = '{\\an8}Hi [MUSIC] "q" ]}'
    assert [got[k].mode for k in (1, 2, 3, 5)] == ["array", "envelope", "salvaged", "array"]
    assert all(got[k].translations["1"] == text for k in (1, 2, 3, 5)) and got[3].translations["2"] == "b"
    assert got[4].fatal == "invalid_text_type" and got[4].invalid_ids == ["1"]
    assert got[6].fatal == got[7].fatal == "invalid_json"


def test_gate_of_several_triggers(spark, tmp_path):
    found = [("partial_echo", 1), ("broken_italic", 1), ("partial_echo", 2), ("line_parity_mismatch", 1)]
    for c, f in found:
        spark.createDataFrame([(c, f)], "class string, file_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema("class string, file_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    _, gates = jobs.gate_batches(stream)
    got = {r.file_id: r.fails for r in jobs.merged_gate(spark.read.parquet(gates)).collect()}
    assert got == {1: True, 2: False}
