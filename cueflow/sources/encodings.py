"""File bytes to text with the encoding that was chosen, and an audit of the choices.

All but the last step is column work over the whole content. ISO-8859-1 gives one sign per byte, so bytes can
be counted and mapped with ``translate``:

- a byte-order mark decides at once, unless the content is broken;
- a text holds no U+0000, so NUL bytes come from two- or four-byte units. They are four-byte units
  if the content is a multiple of four and the lane of the highest byte holds nothing but NULs;
  else the lane with more NULs holds the high bytes of two-byte units. Surrogates must be paired
  and the decoded text free of U+0000. Valid UTF-8 with fewer than one NUL in ten bytes stays UTF-8;
- other content that is valid UTF-8 is UTF-8;
- the rest is a legacy code page, which ``legacy.detect`` finds by letter pairs. Only this residue goes
  through an Arrow stage; East Asian pages are multi-byte, which Spark's ``decode`` does not know.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cueflow.sources import legacy


def _count(c: Column, signs: str) -> Column:
    return F.length(c) - F.length(F.translate(c, signs, ""))


def _lane(latin: Column, step: int, place: int) -> Column:
    """Every ``step``-th byte from ``place`` on."""
    return F.regexp_replace(F.regexp_replace(latin, f"(?s)^.{{0,{place}}}", ""), f"(?s)(.).{{0,{step - 1}}}", "$1")


def _result(encoding: str, text: Column) -> Column:
    return F.struct(F.lit(encoding).alias("encoding"), text.alias("text"))


@F.pandas_udf(StructType([StructField("encoding", StringType()), StructField("text", StringType())]))
def code_page(content: pd.Series) -> pd.DataFrame:
    """``struct(encoding, text)`` of content that is read by a legacy code page; null stays null."""
    found = [(None, None) if c is None else legacy.detect(bytes(c)) for c in content]
    return pd.DataFrame(found, columns=["encoding", "text"])


def _whole_units(high: Column) -> Column:
    """The high bytes of two-byte units hold surrogates in pairs only."""
    return ~F.regexp_replace(high, r"[\xD8-\xDB][\xDC-\xDF]", "").rlike(r"[\xD8-\xDF]")


def decode(files: DataFrame, content: str) -> DataFrame:
    """Adds ``encoding`` and ``text`` with newlines unified; null content gives nulls."""
    c = F.col(content)
    latin, size = F.decode(c, "ISO-8859-1"), F.octet_length(c)
    utf8 = F.is_valid_utf8(c.cast("string"))
    mark = lambda h: F.startswith(F.hex(F.substring(c, 1, 4)), F.lit(h))
    nuls = lambda step, place: _count(_lane(F.col("_l"), step, place), "\0")

    k = files.withColumn("_l", latin).withColumn("_u8", utf8)
    many = F.contains("_l", F.lit("\0")) & ~(F.col("_u8") & (_count(F.col("_l"), "\0") * 10 < size))
    four = lambda top, plane: (size % 4 == 0) & (nuls(4, top) * 4 == size) & ~_lane(F.col("_l"), 4, plane).rlike(r"[^\x00-\x10]")
    two = lambda high: (size % 2 == 0) & _whole_units(_lane(F.col("_l"), 2, high))
    unit = (
        F.when(mark("FFFE0000") & four(3, 2) | mark("0000FEFF") & four(0, 1), "utf-32").when(mark("FFFE") & two(1) | mark("FEFF") & two(0), "utf-16")
        .when(mark("EFBBBF") & F.col("_u8"), "utf-8-sig").when(many & four(0, 1), "utf-32-be").when(many & four(3, 2), "utf-32-le")
        .when(many & (nuls(2, 0) > nuls(2, 1)) & two(0), "utf-16-be").when(many & (nuls(2, 0) <= nuls(2, 1)) & two(1), "utf-16-le")
    )
    k = k.withColumn("_unit", unit)
    u = lambda name: F.col("_unit") == name
    marked = lambda h: F.concat(F.unhex(F.lit(h)), c)
    units = (
        F.when(u("utf-32"), _result("utf-32", F.decode(c, "UTF-32"))).when(u("utf-16"), _result("utf-16", F.decode(c, "UTF-16")))
        .when(u("utf-8-sig"), _result("utf-8-sig", F.decode(F.substring(c, 4, 1 << 30), "UTF-8")))
        .when(u("utf-32-be"), _result("utf-32-be", F.decode(marked("0000FEFF"), "UTF-32"))).when(u("utf-32-le"), _result("utf-32-le", F.decode(marked("FFFE0000"), "UTF-32")))
        .when(u("utf-16-be"), _result("utf-16-be", F.decode(c, "UTF-16BE"))).when(u("utf-16-le"), _result("utf-16-le", F.decode(c, "UTF-16LE")))
    )
    k = k.withColumn("_w", units)
    k = k.withColumn("_w", F.when(~F.contains("_w.text", F.lit("\0")), F.col("_w")))
    # The Arrow stage sees the residue alone, everything else is null there.
    k = k.withColumn("_p", code_page(F.when(F.col("_w").isNull() & ~F.col("_u8"), c)))
    rest = F.when(F.col("_u8"), _result("utf-8", F.col("_l"))).when(c.isNotNull(), F.col("_p"))
    k = k.withColumn("_d", F.coalesce("_w", rest))
    chosen = F.when((F.col("_d.encoding") == "utf-8") & F.col("_u8"), F.decode(c, "UTF-8")).otherwise(F.col("_d.text"))
    text = F.regexp_replace(F.regexp_replace(chosen, "^\ufeff", ""), "\r\n?", "\n")
    return k.withColumn("encoding", F.col("_d.encoding")).withColumn("text", text).drop("_l", "_u8", "_unit", "_w", "_p", "_d")


def audit(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("encoding").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))
