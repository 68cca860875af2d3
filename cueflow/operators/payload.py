"""Model responses: parsing, integrity and assembly into files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.functions import labels as L
from cueflow.functions import text as T

RAW = "array<struct<i:variant,t:variant>>"
ITEM = "array<struct<i:string,t:string>>"
# Quoted strings are passed over whole, so brackets and braces inside them end nothing.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_OBJECT = r'\{[^{}"\[\]]*+(?:' + _STRING + r'[^{}"\[\]]*+)*+\}'
_ARRAY = r"\[\s*" + _OBJECT + r"(?:\s*,\s*" + _OBJECT + r")*+\s*\]"


def _typed(x: Column) -> Column:
    """Id as text, text only where the reply holds a string there."""
    t = F.when(F.schema_of_variant(x["t"]) == "STRING", x["t"].cast("string"))
    return F.struct(x["i"].cast("string").alias("i"), t.alias("t"))


def items(raw: Column) -> Column:
    """``struct(mode, items)`` of a response text.

    A fence is removed; then the whole text as an array or an envelope ``{"tr": [...]}``, a whole
    array inside other text, else the complete objects of a broken array. Two different whole
    arrays in one text are ambiguous. A text that is no string comes back as null.
    """
    v = T.strip(F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    none = F.array().cast(ITEM)
    result = lambda mode, found: F.struct(F.lit(mode).alias("mode"), found.alias("items"))
    typed = lambda found: F.transform(found, _typed)

    def parse(x: Column) -> Column:
        whole = F.when(F.startswith(x, F.lit("[")), F.from_json(x, RAW))
        envelope = F.when(F.startswith(x, F.lit("{")), F.from_json(x, f"tr {RAW}")["tr"])
        arrays = F.transform(F.regexp_extract_all(x, F.lit(_ARRAY), F.lit(0)), lambda a: typed(F.from_json(a, RAW)))
        arrays = F.array_distinct(F.filter(arrays, lambda a: a.isNotNull()))
        pieces = F.transform(F.regexp_extract_all(x, F.lit(_OBJECT), F.lit(0)), lambda o: _typed(F.from_json(o, "i variant, t variant")))
        pieces = F.filter(pieces, lambda o: o["i"].isNotNull())
        return (
            F.when(F.size(arrays) > 1, result("ambiguous_multiple_payloads", none)).when(F.size(whole) > 0, result("array", typed(whole)))
            .when(F.size(envelope) > 0, result("envelope", typed(envelope))).when(F.size(arrays) == 1, result("array", arrays[0]))
            .when(x.contains("[") & (F.size(pieces) > 0), result("salvaged", pieces)).otherwise(result("invalid", none))
        )

    return T.let(v, parse)


def integrity(responses: DataFrame, key: str, raw: str, expected: str) -> DataFrame:
    """Per response: sorted id lists of every kind and the fatal reason.

    A response is one row with its few items, so all of this is array work inside the row.
    """
    r = responses.withColumn("_p", items(F.col(raw))).withColumn("_i", F.col("_p.items"))
    ok = F.filter("_i", lambda x: x["i"].isNotNull())
    ids = F.transform(ok, lambda x: x["i"])
    r = r.withColumn("_ok", ok).withColumn("_ids", ids)
    r = r.withColumn("_dup", F.array_distinct(F.filter("_ids", lambda x: F.size(F.filter("_ids", lambda y: y == x)) > 1)))
    known = lambda x: F.array_contains(expected, x["i"])
    clean = lambda x: T.strip_json(F.coalesce(x["t"], F.lit("")))
    good = F.filter("_ok", lambda x: known(x) & (clean(x) != "") & ~F.array_contains("_dup", x["i"]))
    bad = F.filter("_ok", lambda x: known(x) & (clean(x) == ""))
    r = r.withColumn("translations", F.map_from_entries(F.transform(good, lambda x: F.struct(x["i"], clean(x)))))
    r = r.withColumn("duplicate_ids", F.array_sort("_dup")).withColumn("unexpected_ids", F.array_sort(F.array_except("_ids", F.col(expected))))
    r = r.withColumn("invalid_ids", F.array_sort(F.array_distinct(F.transform(bad, lambda x: x["i"]))))
    r = r.withColumn("missing_ids", F.array_sort(F.array_except(F.col(expected), F.map_keys("translations"))))
    fatal = (
        F.when(F.col("_p.mode").isin("invalid", "ambiguous_multiple_payloads"), "invalid_json").when(F.size("duplicate_ids") > 0, "duplicate_id")
        .when(F.size("unexpected_ids") > 0, "unexpected_id").when(F.size("invalid_ids") > 0, "invalid_text_type").otherwise("")
    )
    return r.withColumn("fatal", fatal).withColumn("mode", F.col("_p.mode")).withColumn("malformed", F.size(F.filter("_i", lambda x: x["i"].isNull()))).drop("_p", "_i", "_ok", "_ids", "_dup")


def strict_accept(ids: Column, expected: Column) -> Column:
    """A chunk counts only if its ids are exactly the expected ones, none twice."""
    return F.array_sort(ids) == F.array_sort(expected)


def assemble(requests: DataFrame, results: DataFrame, file: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cues, unknown result ids, file status) of a batch.

    ``requests``: custom_id, file, source text ``src``; ``results``: custom_id, error, finish, content.
    """
    dup = results.groupBy("custom_id").agg(F.count("*").alias("n")).filter("n > 1").select("custom_id")
    usable = results.filter(F.col("error").isNull() & ~F.coalesce(F.col("finish").isin("length", "content_filter"), F.lit(False)) & (T.strip(F.coalesce("content", F.lit(""))) != ""))
    usable = usable.join(dup, "custom_id", "left_anti").select("custom_id", "content")
    j = requests.join(usable, "custom_id", "left")
    label = L.is_label_only(F.col("src"))
    cues = j.filter(~(F.col("content").isNull() & label)).withColumn("failed", F.col("content").isNull()).withColumn("text", F.coalesce("content", "src"))
    unknown = results.join(requests.select("custom_id"), "custom_id", "left_anti").select("custom_id").distinct()
    status = cues.groupBy(file).agg(F.count("*").alias("cues"), F.count_if("failed").alias("failed")).withColumn("status", F.when(F.col("failed") == 0, "complete").otherwise("partial"))
    return cues, unknown, status
