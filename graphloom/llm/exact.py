"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bounded, save


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest_bits: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space became one space.
    Rows are combined in three steps, and each compares whole texts besides their digests: within a
    task (the partial aggregate), within a salt, and over all salts. A text thus leaves a task once,
    however many copies it has, and no task gets a group. Texts whose digest occurs once have nothing
    to be compared with and stay where they are.

    Null text counts as empty; a very long text is hashed as a whole, and leaves its task only if its digest occurs again. A null id is never the smallest unless the whole group has none, and
    then keep_id is null. Of rows that repeat an id and its text just one is kept. An empty table gives
    an empty result; other columns of docs, whatever their names, are not looked at. digest_bits shortens the digests
    by which texts are grouped, so that tests see collisions; results don't depend on it.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumns({"sha": F.sha2("norm", 256), "check": F.xxhash64("norm")})
    rows = rows.withColumn("digest", F.substring("sha", 1, digest_bits // 4))
    meta = save(rows.select("doc_id", "sha", "check", "digest", F.monotonically_increasing_id().alias("uid")))

    repeated = save(meta.groupBy("digest").count().where("count > 1").select("digest"))
    local = rows.join(bounded(repeated), "digest", "left_semi").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("digest", "norm", "salt").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = save(winners.select("digest", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("check"), "keep_id", "group_size"))
    # Rows find their group by two hashes of the whole text: the groups themselves were told apart by the texts.
    out = meta.join(bounded(winners), ["digest", "sha", "check"], "left")

    alike = meta.groupBy("sha", "check", "doc_id").agg(F.count("*").alias("same"), F.min("uid").alias("first")).where("same > 1")
    alike = save(alike.select(F.col("sha").alias("sha2"), F.col("check").alias("check2"), F.col("doc_id").alias("id2"), "first"))
    out = out.join(bounded(alike), (F.col("sha") == F.col("sha2")) & (F.col("check") == F.col("check2")) & F.col("doc_id").eqNullSafe(F.col("id2")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("first").isNull() | (F.col("uid") == F.col("first")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, sha256(norm) AS text_sha256, norm
           FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (norm)
"""
