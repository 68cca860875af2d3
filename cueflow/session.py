"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import functools
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "cueflow", master: str | None = None) -> SparkSession:
    """Build a session; a cluster's own master and settings win over these."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        cores = master[6:-1] if master.startswith("local[") else "8"
        b = (
            b.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("CUEFLOW_DRIVER_MEMORY", "8g"))
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session (as in tests) gets a folder of this machine, and any other
    stops with an error: executors would not see such a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "path" not in _local:
        _local["path"] = tempfile.mkdtemp(prefix="cueflow-")
    return _local["path"]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared folder."""
    jvm = spark.sparkContext._jvm
    return f"{shared_dir(spark).rstrip('/')}/{name}-{jvm.java.util.UUID.randomUUID()}"


def hadoop(spark: SparkSession, path: str):
    """``path`` and its file system, as Spark sees them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what the folder ``path`` holds; none if there is no such folder."""
    p, fs = hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def memo(fn):
    """Reuse the (lazy) frame a view function built for the same application and folder."""
    built: dict[tuple[str, str], DataFrame] = {}

    @functools.wraps(fn)
    def view(spark: SparkSession, sf_dir: str) -> DataFrame:
        k = (spark.sparkContext.applicationId, sf_dir)
        if k not in built:
            built[k] = fn(spark, sf_dir)
        return built[k]

    return view


def stored(name: str, told=lambda df: df):
    """A view that is written once per application to the shared folder and then read; ``told`` adds what follows from a row.

    Cue tables are made once and asked many times; reading the written one gives every
    query column pruning and filter pushdown and keeps its plan short.
    """

    def wrap(fn):
        @memo
        @functools.wraps(fn)
        def view(spark: SparkSession, sf_dir: str) -> DataFrame:
            return told(cut(fn(spark, sf_dir), name))

        return view

    return wrap


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer partitions than there are cores.

    Text work is heavy per row, and one small file would keep it on one core. A table of
    many splits is left alone, so a large scan never pays for this shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def explode_rows(df: DataFrame, keep: list, array: Column) -> DataFrame:
    """``keep``, ``p`` (0-based) and ``e``: one row per element of a computed array.

    A plain explode makes the optimizer test the array for emptiness in a filter of its own,
    which computes an expensive array twice; the outer form with a filter behind does not.
    """
    return df.select(*keep, F.posexplode_outer(array).alias("p", "e")).filter(F.col("p").isNotNull())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a text table, spread for heavy work per row."""
    return spread(read_table(spark, sf_dir, name).select(*columns))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    For a plan that is used several times: it is computed once, and a lost executor costs
    a re-read of the table, not the whole plan.
    """
    path = work_path(df.sparkSession, name)
    with short_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives its shuffle files back as soon as it is written, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)
