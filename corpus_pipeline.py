"""A corpus cleaned and packed: quality rules, near-duplicates, benchmark decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import table, written
from tallyweave.llm.near_dedup import keep_one_each
from tallyweave.llm.op2_quality import keep_good
from tallyweave.llm.op3_packing import packed
from tallyweave.llm.op6_secrets import redact
from tallyweave.llm.op7_templates import decontaminate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go, as they fail the base rules; null ids, languages and sources are values like others; repeated rows are judged alike; an empty table gives no row; further columns stay.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id.

    Texts without words are alike, so one of them stays; of rows that are equal in id and text one stays; an empty table gives no row; further columns stay.
    """
    return keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts stay, as all do where the benchmark is empty; repeated rows are judged alike; further columns stay.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, n_chars counted anew.

    Null texts stay null; repeated rows stay repeated; an empty table gives no row; further columns stay, whatever their names.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row a piece of a document.

    A null or empty text is a document of the end id alone; repeated rows are documents of their own; an empty table gives no row; of further columns none is kept.
    """
    return packed(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Robust estimates, similarity and tokens can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
