"""Which files of a tree are source subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.functions.keys import identity

EXTENSIONS = ("srt", "vtt", "ass", "ssa")
# Names of generated files.
INTERNAL = r"(?i)\.partial\.srt$|\.wave[12]of2\.srt$|\.bak\.srt$|\.ham\.srt$|^\..*\.stage\.srt$"
AMBIGUOUS_FORMAT = r"(?i)^(.+)\.(vtt|ass|ssa)\.srt$"
AMBIGUOUS_TR = r"(?i)^(.+)\.tr\.srt$"
OUTPUT_DIRS = ("ÇIKTI", "Raporlar")


def split_path(paths: DataFrame, path: str) -> DataFrame:
    return (
        paths.withColumn("dir", F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "^$", "/"))
        .withColumn("name", F.regexp_extract(path, r"([^/]*)$", 1))
        .withColumn("ext", F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)))
    )


def drop_generated(paths: DataFrame, path: str) -> DataFrame:
    """Drop generated files; an ambiguous name counts as generated only beside its source.

    The siblings come from the same listing: a left-anti self join on (dir, folded name).
    """
    p = split_path(paths, path).filter(~F.col("name").rlike(INTERNAL))
    siblings = split_path(paths, path).select(F.col("dir").alias("_d"), F.lower("name").alias("_n")).distinct()
    g = lambda rx, i: F.regexp_extract("name", rx, i)
    fmt = F.col("name").rlike(AMBIGUOUS_FORMAT)
    wanted = (
        F.when(fmt, F.array(F.lower(F.concat(g(AMBIGUOUS_FORMAT, 1), F.lit("."), g(AMBIGUOUS_FORMAT, 2)))))
        .when(F.col("name").rlike(AMBIGUOUS_TR), F.transform(F.array(*[F.lit(e) for e in EXTENSIONS]), lambda e: F.lower(F.concat(g(AMBIGUOUS_TR, 1), F.lit("."), e))))
    )
    probe = p.filter(wanted.isNotNull()).select(path, "dir", F.explode(wanted).alias("_w"))
    generated = probe.join(siblings, (F.col("dir") == F.col("_d")) & (F.col("_w") == F.col("_n")), "left_semi").select(path).distinct()
    return p.join(generated, path, "left_anti")


def discover(paths: DataFrame, path: str, exclude_dirs=OUTPUT_DIRS, exclude_suffixes=(".ham.srt",), exclude_paths: DataFrame | None = None) -> DataFrame:
    """Source subtitles of a listing; sort at the sink if an order is wanted."""
    p = split_path(paths, path).filter(F.col("ext").isin(*EXTENSIONS))
    folded = F.transform(F.split("dir", "/"), identity)
    banned = F.array(*[identity(F.lit(d)) for d in exclude_dirs])
    p = p.filter(~F.arrays_overlap(folded, banned))
    for s in exclude_suffixes:
        p = p.filter(~F.endswith(F.lower("name"), F.lit(s)))
    if exclude_paths is not None:
        p = p.join(exclude_paths.select(path), path, "left_anti")
    return drop_generated(p.drop("dir", "name", "ext"), path)
