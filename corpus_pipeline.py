"""A corpus pipeline out of the operators in wirelake.llm: each stage is written and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wirelake.llm import decontaminate, language, mixing, shingles, simhash, tokens
from wirelake.llm.common import fresh_path, table

#: Rows that a Python worker gets at a time. Rows hold whole texts: of the usual 10,000 there are several copies of some 40 MB in each task.
BATCH_ROWS = "1000"


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage, with the session's batches for Python workers bounded for what it plans; the setting stays, as its plan may be made later."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return f(spark, docs, sf_dir)

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter (null and empty texts too), or no language of at least half the evidence.

    Repeated rows are judged alike, extra columns stay, an empty table gives none; with no language to learn all with letters stay.
    """
    return language.keep_known(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingles' Jaccard similarity 0.8 or more stays, the one with the smallest doc_id.

    Texts without words (null ones too) are one group. Rows without a doc_id stay unless one with it is in their group; of rows that share
    a doc_id one stays. Extra columns of any names stay, an empty table gives none.
    """
    return simhash.keep_one(docs, shingles.similar(docs))


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out; a document of nothing else goes.

    Null and empty texts stay as they are, repeated rows are alike, extra columns stay, an empty table or benchmark changes nothing.
    """
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"), clean=True)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row comes as often as the mix of sources takes it, at most three times.

    A null source is one of its own. Rows of the same doc_id, source and text share their copies; rows without a word are dealt like others of their
    length. Extra columns of any names stay, an empty table gives none.
    """
    return mixing.mixed(docs)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The written token files' rows: doc_id, start, n_tokens and ids_crc32. Null and empty texts have the end id alone; rows without a doc_id come first."""
    return tokens.op3(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("source_mix", source_mix), ("token_output", token_output)]

#: The mixing plan is a dynamic programme and the output an encoding; neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
