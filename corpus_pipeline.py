"""From raw documents to packed windows: five stages, each over all that the one before kept.

Every stage's result is written as Parquet in the shared folder and read again;
what the stage before wrote is deleted then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm.common import checkpoint_dir, table
from fieldloom.llm.langid import keep_identified
from fieldloom.llm.line_dedup import dedup_lines
from fieldloom.llm.mixing import mix_sources
from fieldloom.llm.ngram_jaccard import drop_near_duplicates
from fieldloom.llm.packing import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is ambiguous go; those too short to tell stay."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each line only the first occurrence stays; documents left empty by it go."""
    return dedup_lines(docs, min_bytes=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return drop_near_duplicates(docs, threshold=0.6, n=3)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources repeat, at most twice as often as those of the largest."""
    return mix_sources(docs, target_entropy=0.98, max_repetition=2.0, budget="cover", extra=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The layout of all tokens in windows of 2048."""
    return pack_documents(docs, capacity=2048)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("mixing", mixing), ("best_fit_packing", packing)]

#: Language identification and bin completion can't be said in SQL; tests/llm/test_brute_force.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}_{name}")
        docs = spark.read.parquet(path)
        if last is not None:
            old = spark._jvm.org.apache.hadoop.fs.Path(last)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        last = path
    return docs
