"""Vector search and its fusion with traversal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import similarity
from graphloom.functions.predicates import where

from .traverse import Condition


#: Nodes of the traversal that a fusion ranks, in queue order, unless told otherwise.
NODE_LIMIT = 1000


@dataclass(frozen=True)
class Weights:
    vector: float = 0.5
    keyword: float = 0.5


def scored(entities: DataFrame, query: list[float], metric: str = "cosine", threshold: float | None = None, filters: Condition = None, strict: bool = True) -> DataFrame:
    """id, seq, score of entities with an embedding, filtered before scoring.

    An embedding of another length is an error, or with strict=False left out.
    """
    rows = where(entities, filters).where(F.size("embedding") > 0).select("id", "seq", "embedding")
    if strict:
        bad = F.raise_error(F.concat(F.lit(f"expected {len(query)} dimensions, found "), F.size("embedding").cast("string")))
        rows = rows.withColumn("embedding", F.when(F.size("embedding") != len(query), bad.cast("array<double>")).otherwise(F.col("embedding")))
    else:
        rows = rows.where(F.size("embedding") == len(query))
    rows = rows.select("id", "seq", similarity.score(F.col("embedding"), query, metric).alias("score"))
    return rows if threshold is None else rows.where(F.col("score") >= threshold)


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The k best by score; ties by seq."""
    return rows.orderBy(F.desc("score"), "seq").limit(k)


def search(entities: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", threshold: float | None = None, filters: Condition = None) -> DataFrame:
    return top_k(scored(entities, query, metric, threshold, filters), k)


def keyword_scores(entities: DataFrame, text: str) -> DataFrame:
    """id, keyword_score: the share of the query's words that an entity's label or an alias of it has, whatever their case."""
    words = sorted(set(text.lower().split()))
    bag = F.split(F.lower(F.concat_ws(" ", F.col("label"), F.col("aliases"))), r"\s+")
    n = F.size(F.array_intersect(bag, F.array(*map(F.lit, words)).cast("array<string>")))
    return entities.select("id", (n / max(1, len(words))).alias("keyword_score"))


def fuse(nodes: DataFrame, hits: DataFrame, method: str = "rrf", rrf_k: int = 60, weights: Weights = Weights(), node_limit: int = NODE_LIMIT, keywords: DataFrame | None = None) -> DataFrame:
    """Fused score of every traversal node (the first node_limit in queue order), best first ties as vector rank, then queue order.

    hits are the vector's top k; those that the traversal didn't reach drop out. Both lists are bounded by k and
    node_limit, so their ranks are windows over few rows. The weighted method's keyword part is 1 for each node that
    the traversal reached, or, with keywords (id, keyword_score), its score there.
    """
    order = Window.orderBy("depth", "pos")
    ranked = nodes.orderBy("depth", "pos").limit(node_limit).withColumn("node_rank", F.row_number().over(order))
    near = hits.join(ranked, "id", "left_semi").withColumn("vector_rank", F.row_number().over(Window.orderBy(F.desc("score"), "seq")))
    both = ranked.join(near.select("id", "score", "vector_rank"), "id", "left")
    v = F.coalesce("score", F.lit(0.0))
    if method == "rrf":
        total = F.coalesce(1 / (rrf_k + F.col("vector_rank")), F.lit(0.0)) + 1 / (rrf_k + F.col("node_rank"))
    elif method == "weighted":
        if keywords is not None:
            both = both.join(keywords.select("id", "keyword_score"), "id", "left")
        total = weights.vector * v + weights.keyword * (F.lit(1.0) if keywords is None else F.coalesce("keyword_score", F.lit(0.0)))
    elif method == "additive":
        total = v + 1
    else:
        raise ValueError(f"unknown fusion: {method}")
    return both.select("id", "depth", "pos", "vector_rank", "node_rank", F.col("score").alias("vector_score"), total.alias("fused"))


def hybrid(nodes: DataFrame, hits: DataFrame, limit: int = 10, method: str = "rrf", rrf_k: int = 60, weights: Weights = Weights(), node_limit: int = NODE_LIMIT, keywords: DataFrame | None = None) -> DataFrame:
    """The best `limit` of fuse."""
    fused = fuse(nodes, hits, method, rrf_k, weights, node_limit, keywords)
    return fused.orderBy(F.desc("fused"), F.asc_nulls_last("vector_rank"), "node_rank").limit(limit)


def hybrid_stats(nodes: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    return (
        nodes.agg(F.count("*").alias("nodes_visited"))
        .crossJoin(edges.agg(F.count("*").alias("edges_traversed")))
        .crossJoin(hits.agg(F.count("*").alias("total_candidates")))
        .crossJoin(hits.join(nodes, "id", "left_semi").agg(F.count("*").alias("matched_in_traversal")))
    )  # single rows
