"""Alignment of source, delivered and raw cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.functions import keys as K
from cueflow.functions import labels as L
from cueflow.functions import text as T
from cueflow.operators import ordered, ranges
from cueflow.session import cut

# Both sides carry file_id, pos (dense), cue_no, start_ms, end_ms, text.


def kth_of_stamp(cues: DataFrame, key: str = "file_id") -> DataFrame:
    """Adds ``k``: the how-manieth row of this file with the same stamp.

    The rows of one stamp are ranked through blocks of positions, so a stamp that most of a
    file shares does not have to fit into one task.
    """
    return ordered.dense_pos(cues, [key, "start_ms", "end_ms"], "pos", "k")


def by_time(source: DataFrame, delivery: DataFrame, key: str = "file_id") -> DataFrame:
    """Full outer, duplicate-safe: first by stamp (k-th to k-th), the rest by cue number.

    ``how`` is time / number / source_only / delivery_only; no cue of either side is lost.
    """
    side = lambda df, p: df.select(key, F.col("start_ms"), F.col("end_ms"), "k", F.col("cue_no").alias(p + "_no"), F.col("pos").alias(p + "_pos"), F.col("text").alias(p + "_text"))
    s, d = side(kth_of_stamp(source, key), "src"), side(kth_of_stamp(delivery, key), "tgt")
    full = s.join(d, [key, "start_ms", "end_ms", "k"], "full_outer").drop("k")
    both = full.filter("src_pos is not null and tgt_pos is not null").withColumn("how", F.lit("time"))
    left = full.filter("tgt_pos is null").select(key, F.col("src_no").alias("no"), "src_no", "src_pos", "src_text", F.col("start_ms").alias("s0"), F.col("end_ms").alias("e0"))
    right = full.filter("src_pos is null").select(key, F.col("tgt_no").alias("no"), "tgt_no", "tgt_pos", "tgt_text", F.col("start_ms").alias("s1"), F.col("end_ms").alias("e1"))
    rest = left.join(right, [key, "no"], "full_outer").withColumn(
        "how", F.when(F.col("tgt_pos").isNull(), "source_only").when(F.col("src_pos").isNull(), "delivery_only").otherwise("number"))
    rest = rest.withColumn("start_ms", F.coalesce("s1", "s0")).withColumn("end_ms", F.coalesce("e1", "e0"))
    cols = [key, "start_ms", "end_ms", "src_no", "src_pos", "src_text", "tgt_no", "tgt_pos", "tgt_text", "how"]
    return both.select(*cols).unionByName(rest.select(*cols))


def coverage(source: DataFrame, delivery: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file: stamps of each side, common ones, and the alignment mode that follows."""
    stamps = lambda df: df.select(key, "start_ms", "end_ms").distinct()
    s, d = stamps(source), stamps(delivery)
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    common = n(s.join(d, [key, "start_ms", "end_ms"], "left_semi"), "common")
    rows = n(source, "src_rows").join(n(delivery, "tgt_rows"), key, "full_outer")
    out = rows.join(n(s, "src_stamps"), key, "left").join(n(d, "tgt_stamps"), key, "left").join(common, key, "left").fillna(0)
    mode = F.when((F.col("tgt_stamps") > 0) & (F.col("common") * 100 >= 80 * F.col("tgt_stamps")), "time").when(F.col("src_rows") == F.col("tgt_rows"), "position").otherwise("unaligned")
    return out.withColumn("mode", mode)


def gated(source: DataFrame, delivery: DataFrame, key: str = "file_id") -> DataFrame:
    """Pairs by time (k-th to k-th of a stamp) or by position, as the coverage of the file says."""
    mode = coverage(source, delivery, key).select(key, "mode")
    s = kth_of_stamp(source, key).select(key, "pos", "k", "start_ms", "end_ms", F.col("text").alias("src_text"))
    d = kth_of_stamp(delivery, key).select(key, "pos", "k", "start_ms", "end_ms", F.col("text").alias("tgt_text"))
    time = d.join(s.drop("pos"), [key, "start_ms", "end_ms", "k"]).join(mode.filter("mode = 'time'"), key)
    place = d.join(s.drop("start_ms", "end_ms"), [key, "pos"]).join(mode.filter("mode = 'position'"), key)
    cols = [key, "pos", "start_ms", "end_ms", "src_text", "tgt_text", "mode"]
    return time.select(*cols).unionByName(place.select(*cols))


def source_in_span(source: DataFrame, delivery: DataFrame, key: str = "file_id") -> DataFrame:
    """Per delivered cue the source text inside its span, else of an equal start, else end."""
    d = delivery.select(key, F.col("pos").alias("d_pos"), F.col("start_ms").alias("d_s"), F.col("end_ms").alias("d_e"))
    s = source.select(key, F.col("pos").alias("s_pos"), F.col("start_ms").alias("s_s"), F.col("end_ms").alias("s_e"), F.col("text").alias("s_text"))
    inside = ranges.containment(s, d, key, "s_s", "s_e", "d_s", "d_e")
    joined = lambda df: df.groupBy(key, "d_pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_s", "s_e", "s_pos", "s_text"))), lambda x: x["s_text"]), "\n").alias("src_text"), F.count("*").alias("parts"))
    first = joined(inside).withColumn("how", F.lit("span"))
    left = d.join(first, [key, "d_pos"], "left_anti")
    start = joined(left.join(s, (left[key] == s[key]) & (F.col("s_s") == F.col("d_s"))).drop(s[key])).withColumn("how", F.lit("start"))
    left = left.join(start, [key, "d_pos"], "left_anti")
    end = joined(left.join(s, (left[key] == s[key]) & (F.col("s_e") == F.col("d_e"))).drop(s[key])).withColumn("how", F.lit("end"))
    return first.unionByName(start).unionByName(end)


def span_members(before: DataFrame, after: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows of ``after`` that hold more than one row of ``before``."""
    a = after.select(key, F.col("pos").alias("a_pos"), F.col("start_ms").alias("a_s"), F.col("end_ms").alias("a_e"))
    b = before.select(key, F.col("pos").alias("b_pos"), F.col("start_ms").alias("b_s"), F.col("end_ms").alias("b_e"))
    m = ranges.containment(b, a, key, "b_s", "b_e", "a_s", "a_e")
    return m.groupBy(key, "a_pos").agg(F.count("*").alias("members"), F.min("b_pos").alias("first_pos"), F.max("b_pos").alias("last_pos")).filter("members > 1")


def season_spans(source: DataFrame, delivery: DataFrame, key: str = "file_id") -> DataFrame:
    """Composite source per delivered cue; a span over a scene gap stays unmapped.

    ``source`` carries ``scene``.
    """
    d = delivery.select(key, F.col("pos").alias("d_pos"), F.col("start_ms").alias("d_s"), F.col("end_ms").alias("d_e"))
    s = source.select(key, "scene", F.col("cue_no").alias("s_no"), F.col("start_ms").alias("s_s"), F.col("end_ms").alias("s_e"), F.col("text").alias("s_text"))
    m = ranges.containment(s, d, key, "s_s", "s_e", "d_s", "d_e")
    # Scenes are compared first; only spans inside one scene gather their texts.
    one = m.groupBy(key, "d_pos").agg(F.min("scene").alias("_a"), F.max("scene").alias("_b")).filter("_a = _b").select(key, "d_pos")
    parts = F.array_sort(F.collect_list(F.struct("s_s", "s_no", "s_text")))
    mapped = m.join(one, [key, "d_pos"], "left_semi").groupBy(key, "d_pos").agg(parts.alias("_p")).select(key, "d_pos", F.array_join(F.transform("_p", lambda x: x["s_no"].cast("string")), "|").alias("src_id"), F.array_join(F.transform("_p", lambda x: x["s_text"]), " ").alias("src_text"))
    return d.select(key, "d_pos").join(mapped, [key, "d_pos"], "left")


def lost_cues(raw: DataFrame, delivery: DataFrame, key: str = "file_id", slack_ms: int = 10_000) -> DataFrame:
    """Raw cues without a delivered cue at their time whose words are in no neighbour either."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(T.visible(c)), r"[^\p{L}\p{N}]+", " "))
    r = raw.filter(T.has_word(F.col("text"))).join(delivery.select(key, "start_ms"), [key, "start_ms"], "left_anti")
    r = r.withColumn("_rn", norm(F.col("text"))).withColumn("_r0", F.greatest(F.col("start_ms") - slack_ms, F.lit(0))).withColumn("_r1", F.col("end_ms") + slack_ms)
    d = delivery.select(F.col(key), F.col("start_ms").alias("_s"), F.greatest("start_ms", "end_ms").alias("_e"), norm(F.col("text")).alias("_dn"))
    # Equal texts on equal stamps meet once.
    asked = [key, "_rn", "_r0", "_r1"]
    near = ranges.overlaps(r.select(*asked).distinct(), d.distinct(), key, "_r0", "_r1", "_s", "_e")
    held = near.filter(F.contains("_dn", F.col("_rn"))).select(*asked).distinct()
    return r.join(held, asked, "left_anti").select(key, "pos", "cue_no", "start_ms", "text")


def dialogue_gaps(source: DataFrame, delivery: DataFrame, key: str = "file_id") -> DataFrame:
    """missing_dialogue / expected_removed (source side), extra_dialogue (delivery side).

    Of several cues on one stamp as many count as found as the other side has there.
    """
    stamp = [key, "start_ms", "end_ms"]
    count = lambda df: df.groupBy(*stamp).agg(F.count("*").alias("n"))
    beyond = lambda df, other: kth_of_stamp(df, key).join(count(other), stamp, "left").filter(F.col("k") > F.coalesce("n", F.lit(0)))
    # What the texts decide is read off once; they do not travel with the stamps.
    said = cut(delivery.filter(T.strip(F.col("text")) != "").select(*stamp, "pos"), "said")
    worded = cut(source.filter(T.has_word(F.col("text"))).select(*stamp, "pos", L.is_label_only(F.col("text")).alias("label")), "worded")
    gone = beyond(worded, said)
    gone = gone.select(key, "pos", "start_ms", F.when(F.col("label"), "expected_removed").otherwise("missing_dialogue").alias("class"))
    return gone.unionByName(beyond(said, source.select(*stamp)).select(key, "pos", "start_ms", F.lit("extra_dialogue").alias("class")))


def rewrite_diff(before: DataFrame, after: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file: cues changed, removed, added and tokens lost between two versions.

    The k-th cue of a stamp is compared with the k-th of the other version.
    """
    b = kth_of_stamp(before, key).select(key, "start_ms", "end_ms", "k", F.col("text").alias("b"))
    a = kth_of_stamp(after, key).select(key, "start_ms", "end_ms", "k", F.col("text").alias("a"))
    j = b.join(a, [key, "start_ms", "end_ms", "k"], "full_outer")
    lost = F.size(F.array_except(K.T.norm_tokens(F.coalesce("b", F.lit(""))), K.T.norm_tokens(F.coalesce("a", F.lit("")))))
    return j.groupBy(key).agg(
        F.count_if(F.expr("a is not null and b is not null and trim(a) <> trim(b)")).alias("changed"), F.count_if(F.col("a").isNull()).alias("removed"),
        F.count_if(F.col("b").isNull()).alias("added"), F.sum(F.when(F.expr("a is not null and b is not null"), lost).otherwise(0)).cast("bigint").alias("tokens_lost"))
