"""Breadth-first traversal by levels: one join per level, order and paths without a global sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import Filter, where
from graphloom.sources.scratch import cut

#: Nodes of a frontier that are broadcast: their ids, positions and paths take some hundred bytes each.
BROADCAST_IDS = 20_000
#: Nodes whose ids alone are broadcast: some 130 bytes each.
NEAR_IDS = 1_500_000
Condition = Sequence[Filter] | Column | Callable[[DataFrame], Column] | None


@dataclass
class Traversal:
    """What a traversal found.

    nodes: id, depth, pos (orders nodes as a queue would reach them), path (ids from a start); id and depth of an unordered one.
    edges: relation id, source_id, target_id, type, of every usable relation of an expanded node, also to nodes
    that were reached before, were filtered, or don't exist; once per direction.
    """

    nodes: DataFrame
    edges: DataFrame

    @property
    def paths(self) -> DataFrame:
        return self.nodes.where("depth > 0").select("id", "depth", "pos", "path")

    def tree(self) -> DataFrame:
        return self.paths.select(F.element_at("path", -2).alias("parent"), F.col("id").alias("child"), "depth")


def incident(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations whose source or target is one of ids (column id): node_id and the relation, a self-loop once."""
    ids = ids.select(F.col("id").alias("node_id")).distinct()
    out = ids.join(relations, F.col("node_id") == F.col("source_id"))
    into = ids.join(relations.where("source_id <> target_id"), F.col("node_id") == F.col("target_id"))
    return out.unionByName(into)


def outgoing(relations: DataFrame, ids: DataFrame) -> DataFrame:
    return relations.join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")


def incoming(relations: DataFrame, ids: DataFrame) -> DataFrame:
    return relations.join(ids.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")


def adjacency(relations: DataFrame, directions: Sequence[str] = ("outbound",)) -> DataFrame:
    """src, dst, direction and the relation's id, type and seq; a row per direction that may be followed."""
    ways = set(directions)
    if unknown := ways - {"outbound", "inbound", "both"}:
        raise ValueError(f"unknown directions: {sorted(unknown)}")
    if "both" in ways:
        ways = {"outbound", "inbound"}
    one = lambda a, b, d: relations.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(d).alias("direction"), F.col("id").alias("rel_id"), "type", "seq", "source_id", "target_id")
    out = one("source_id", "target_id", "outbound") if "outbound" in ways else None
    if "inbound" in ways:
        back = one("target_id", "source_id", "inbound")
        out = back if out is None else out.unionByName(back)
    if out is None:
        raise ValueError("a traversal needs a direction")
    return out


def degree(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """id, degree of every entity; a self-loop counts once."""
    ends = relations.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    counted = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return entities.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def traverse(
    entities: DataFrame,
    relations: DataFrame,
    start_ids: Sequence[str] | DataFrame,
    max_depth: int = 3,
    directions: Sequence[str] = ("outbound",),
    relation_types: Sequence[str] | None = None,
    node_filter: Condition = None,
    edge_filter: Condition = None,
    ordered: bool = True,
) -> Traversal:
    """Nodes within max_depth relations of the starts.

    A node that the filter refuses is neither returned nor expanded. Of several ways to a node the first in queue
    order counts. That order is the order of the list of relations (by seq, then id) on the way, so it is kept as
    an array and the least one per node is found by a plain aggregate. The frontier and the visited ids, not entities,
    go through the loop; each level is checkpointed, so plans stay small. The ids of a frontier of at most NEAR_IDS nodes are sent
    to the scans of relations and entities, which keep just what it touches before anything is shuffled; at most BROADCAST_IDS
    nodes are sent with their ways. Unordered, nodes are the same ones at the same depth without pos and path, and of a
    level's relations nothing but the distinct ids they lead to is shuffled.
    """
    spark = entities.sparkSession
    usable = relations.where(F.col("type").isin(list(relation_types))) if relation_types else relations
    usable = where(usable, edge_filter)
    adj = adjacency(usable, directions)
    allowed = where(entities, node_filter).select("id")
    if isinstance(start_ids, DataFrame):
        starts = start_ids.select("id").distinct().withColumn("at", F.lit(0))
    else:
        unique = list(dict.fromkeys(start_ids))
        starts = spark.createDataFrame([(x, i) for i, x in enumerate(unique)], "id string, at int")
    first = F.concat(F.format_string("%09d", F.col("at")), F.lit("|"), F.col("id"))
    frontier = starts.select("id", F.lit(0).alias("depth"), F.array(first).alias("pos"), F.array("id").alias("path"))
    frontier, n = _known(cut(frontier) if isinstance(start_ids, DataFrame) else frontier, allowed)
    if not ordered:
        frontier = frontier.select("id", "depth")
    nodes, n_expanded = frontier, n
    for depth in range(1, max_depth + 1 if n else 1):
        near = touching(adj, frontier, n <= NEAR_IDS)
        if ordered:
            key = F.concat(F.format_string("%019d", F.col("seq")), F.lit("|"), F.col("rel_id"))
            near = near.join(F.broadcast(frontier) if n <= BROADCAST_IDS else frontier, F.col("src") == frontier["id"])
            steps = near.select(F.col("dst").alias("id"), F.struct(F.concat("pos", F.array(key)).alias("pos"), F.concat("path", F.array("dst")).alias("path")).alias("way"))
            found = steps.groupBy("id").agg(F.min("way").alias("way"))
        else:
            found = near.select(F.col("dst").alias("id")).distinct()
        ways = [F.col("way.pos").alias("pos"), F.col("way.path").alias("path")] if ordered else []
        found = cut(found.join(nodes.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), *ways))
        frontier, n = _known(found, allowed)
        if not n:
            break
        nodes = nodes.unionByName(frontier)
        if depth < max_depth:
            n_expanded += n
    expanded = nodes.where(F.col("depth") < max_depth).select("id")
    edges = touching(adj, expanded, n_expanded <= NEAR_IDS).select(F.col("rel_id").alias("id"), "source_id", "target_id", "type", "direction")
    return Traversal(nodes, edges)


def touching(adj: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """Rows of adj whose src is one of ids; a semi-join, which Spark moves below unions and distincts to the scans."""
    src = ids.select(F.col("id").alias("src"))
    return adj.join(F.broadcast(src) if few else src, "src", "left_semi")


def _known(found: DataFrame, allowed: DataFrame) -> tuple[DataFrame, int]:
    """Rows of found (checkpointed) whose id is allowed, checkpointed, and how many at most.

    Few ids are sent to the entities' scans, not the other way round.
    """
    n = found.count()
    if n <= NEAR_IDS:
        # Ids of entities are unique, so what is left of them is as few.
        allowed = F.broadcast(allowed.join(F.broadcast(found.select("id")), "id", "left_semi"))
    return cut(found.join(allowed, "id", "left_semi")) if n else found, n


def page(df: DataFrame, order: Sequence[Column | str], limit: int | None = None, offset: int = 0, default: int = 100) -> DataFrame:
    """Rows offset..offset+limit of an order; no limit means the default, 0 means none."""
    return df.orderBy(*order).offset(offset).limit(default if limit is None else limit)
