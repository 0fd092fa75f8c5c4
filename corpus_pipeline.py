"""The corpus pipeline: every stage reads all that the one before it kept, as written Parquet.

All stages but the last return the columns of ``documents``, whatever they are called.  An empty table stays empty.  Odd rows, stage by stage:
language drops null, blank and letterless texts; near_duplicates treats what is left by its words (rows without words are one group) and
never groups by doc_id, so repeated or null doc_ids are rows like any other; decontaminate keeps texts without words; mix leaves out texts of
no words (they have no size) and treats a null source as a source of its own; shard places every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import decontam, langid, mixing, sharding, simhash
from skyledger.llm.common import table
from skyledger.session import scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without letters and texts no language explains go."""
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, that of the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a test item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the source weights ask for: documents repeated, cut or left out."""
    return mixing.take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every row."""
    return sharding.shard_rows(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The stages before sharding learn models and compare fingerprints, which SQL cannot express; tests compare them one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
