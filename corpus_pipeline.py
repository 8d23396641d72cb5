"""From documents to training tokens: quality, near-duplicates, benchmark leaks, source weights, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, mixing, quality, simhash, tokenfile
from graphloom.llm.common import save


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more), empty and null texts by their score like any.

    Without usable labels the untrained model decides. Rows are judged one by one, repeated ones alike.
    """
    return quality.good_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (see simhash.near_dedup)."""
    return simhash.near_dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts have none, so they stay."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words are never taken (see mixing.mix)."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and reads them back: doc_id, start, n_tokens, ids_crc32 for each row (see tokenfile)."""
    return tokenfile.token_output(docs, tokenfile.default_tokenizer())


STAGES = [("quality", good), ("near_dedup", apart), ("decontamination", clean), ("mixing", mixed), ("token_output", tokens)]

#: XXH64, the classifier and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written, and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
