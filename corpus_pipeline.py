"""The corpus pipeline: rules, near duplicates, decontamination, mixing, shards.

Each stage works on all rows its predecessor kept and returns a DataFrame, which the next one
gets as docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from statuta.llm.shared import staged, table


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; texts that are null or without words are rejected, repeated rows are judged each."""
    return quality_rules.keep_good(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, of rows with one id one row; texts without words are linked with nothing and stay."""
    return ngram_join.one_of_each(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, null sources as one source; equal ids draw alike."""
    return mixing.mix(docs)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard; null texts weigh nothing, texts above the limit are shards of their own."""
    return sharding.shard(docs)


STAGES = [("quality_rules", _rules), ("ngram_join", _near_duplicates), ("decontamination", _decontaminate), ("mixing", _mix), ("sharding", _shard)]

#: Stages 1 to 3 (expectation maximisation, signature trees, spaced seeds) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and reread. An empty
    table gives no rows; extra columns pass through. shared.sweep(spark) removes what was written
    once the result is stored."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
