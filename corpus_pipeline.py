"""From raw documents to tokens: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's rows as Parquet
in the shared folder and reads them again as the next one's ``docs``. All but the last return the
columns of ``docs``.

Null and empty texts pass the first stage and fail the second; rows without an id are never merged;
repeated rows are merged; an empty table passes through; further columns of ``docs`` are carried
along, whatever their names, and the last stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueflow.llm import bpe, jaccard, mixing, perplexity, quality, store


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose perplexity is above their language's threshold."""
    return perplexity.filter_documents(docs, store.read(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the word counters or the regression, which learns from all labelled rows."""
    model = quality.train(store.read(spark, sf_dir, "documents"), store.read(spark, sf_dir, "labels"))
    return quality.filter_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is linked by shared shingles."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents until every source has its target of words; a document may be drawn twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding them."""
    return bpe.tokenised(docs, *bpe.vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL has no byte-pair encoding, no language model and no fitted regression.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
