"""What a query leaves on disk while it runs."""

from pyspark.sql import functions as F

from cueflow import session
from cueflow.operators import audit
from cueflow.plans import findings_queries
from cueflow.plans import views as V


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def documents(spark, path):
    text = "\n".join(f"Line {i} of this file says it again.\nShe left the house and never came back {i}.\n" for i in range(30))
    spark.createDataFrame([(k, "en", "s", text) for k in range(8)], "doc_id long, lang string, source string, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_a_written_table_keeps_no_shuffle(spark):
    before = shuffle_files(spark)
    t = session.cut(spark.range(2000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.count("*").alias("n")), "t")
    assert shuffle_files(spark) <= before and t.agg(F.sum("n")).first()[0] == 2000


def test_findings_leave_no_shuffle_and_cues_are_written_once(spark, tmp_path):
    sf = documents(spark, tmp_path)
    before = shuffle_files(spark)
    found = findings_queries.found(spark, sf)
    assert shuffle_files(spark) <= before and found.count() > 0
    assert not {"src", "tgt", "prev_text", "prev_tgt"} & set(V.timed.__wrapped__.__wrapped__(spark, sf).columns)
    assert {"src", "tgt", "prev_text", "prev_tgt"} < set(V.timed(spark, sf).columns)


def test_repeats_with_two_targets_of_a_file(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "x"), (1, "b", None), (2, "a", "x"), (2, "c", None), (2, "c", "z"), (None, "d", "1"), (None, "d", "2"), (3, None, "1"), (3, None, "2")]
    got = audit.inconsistent(spark.createDataFrame(rows, "f long, s string, t string"), "f", "s", "t")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(["(1, 'a')", "(None, 'd')", "(3, None)"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan
