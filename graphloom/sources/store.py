"""Graph stores and exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.mutate import upsert

from .tables import PropertyGraph


class GraphStore:
    """Graphs by name: entities and relations, each partitioned by type.

    A backend opens and closes, saves and loads. Changes of rows are frames as well: a put or delete of a few rows reads a
    graph and saves it, so callers that change much hand over many rows at once.
    """

    def open(self) -> GraphStore:
        return self

    def close(self) -> None:
        """What a backend holds is let go; what it has saved stays."""

    def __enter__(self) -> GraphStore:
        return self.open()

    def __exit__(self, *_) -> None:
        self.close()

    def save(self, name: str, graph: PropertyGraph) -> None:
        raise NotImplementedError

    def load(self, name: str) -> PropertyGraph:
        raise NotImplementedError

    def entity(self, name: str, entity_id: str) -> DataFrame:
        return self.load(name).entities.where(F.col("id") == entity_id)

    def relation(self, name: str, relation_id: str) -> DataFrame:
        return self.load(name).relations.where(F.col("id") == relation_id)

    def entities_by_type(self, name: str, type_: str) -> DataFrame:
        return self.load(name).entities.where(F.col("type") == type_)

    def relations_by_type(self, name: str, type_: str) -> DataFrame:
        return self.load(name).relations.where(F.col("type") == type_)

    def put(self, name: str, entities: DataFrame | None = None, relations: DataFrame | None = None) -> None:
        """Adds rows; those with a known id replace the old ones."""
        g = self.load(name)
        self.save(name, g.replaced(None if entities is None else upsert(g.entities, entities), None if relations is None else upsert(g.relations, relations)))

    def delete(self, name: str, entity_ids: DataFrame | None = None, relation_ids: DataFrame | None = None) -> None:
        """Removes rows for good, by id."""
        g = self.load(name)
        without = lambda df, ids: None if ids is None else df.join(ids.select("id"), "id", "left_anti")
        self.save(name, g.replaced(without(g.entities, entity_ids), without(g.relations, relation_ids)))

    def stats(self, name: str) -> DataFrame:
        g = self.load(name)
        return storage_stats(g.entities, g.relations)


class MemoryStore(GraphStore):
    """Graphs as frames: lazy plans, kept by name in this session."""

    def __init__(self):
        self._graphs: dict[str, PropertyGraph] = {}

    def save(self, name: str, graph: PropertyGraph) -> None:
        self._graphs[name] = graph

    def load(self, name: str) -> PropertyGraph:
        return self._graphs[name]

    def close(self) -> None:
        self._graphs.clear()


class ParquetStore(GraphStore):
    """A type's rows are a folder of their own, so a scan by type reads just that."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, name: str, graph: PropertyGraph) -> None:
        """Writes a new version beside the one that readers have open, then names it the current one."""
        version = uuid.uuid4().hex
        for part in ("entities", "relations"):
            getattr(graph, part).write.partitionBy("type").parquet(f"{self.path}/{name}/{version}/{part}")
        told = [F.lit(version).alias("version"), F.unix_millis(F.current_timestamp()).alias("saved_at"), F.lit(graph.entities.schema.json()).alias("entities"), F.lit(graph.relations.schema.json()).alias("relations")]
        self.spark.range(1).select(*told).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}/versions")

    def load(self, name: str) -> PropertyGraph:
        """The version saved last. Its schemas are kept with it, as a part without rows has no files to tell them."""
        newest = self.spark.read.parquet(f"{self.path}/{name}/versions").agg(F.max(F.struct("saved_at", "version", "entities", "relations")).alias("v")).select("v.*").first()
        part = lambda p: self.spark.read.schema(T.StructType.fromJson(json.loads(newest[p]))).parquet(f"{self.path}/{name}/{newest.version}/{p}")
        return PropertyGraph(part("entities"), part("relations"))


def open_store(spark: SparkSession, kind: str = "memory", path: str | None = None) -> GraphStore:
    if kind == "memory":
        return MemoryStore()
    if kind == "parquet" and path:
        return ParquetStore(spark, path)
    raise ValueError(f"unknown store: {kind}")


def storage_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    one = lambda df, c: df.agg(F.count("*").alias(f"{c}_count"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias(f"{c}_bytes"))
    return one(entities, "entity").crossJoin(one(relations, "relation"))  # single rows


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def of_json(lines: DataFrame, like: DataFrame) -> DataFrame:
    return lines.select(F.from_json("value", like.schema).alias("r")).select("r.*")


#: Rows of a file of a bundle at most: a gzip file is read by one task.
BUNDLE_ROWS = 1_000_000


def export_bundle(graph: PropertyGraph, path: str) -> None:
    """entities and relations as JSON lines in gzip files, as each line tells all names again, and a manifest."""
    for part in ("entities", "relations"):
        getattr(graph, part).write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", BUNDLE_ROWS).json(f"{path}/{part}")
    spark = graph.entities.sparkSession
    spark.range(1).select(F.lit("1.0").alias("version"), F.current_timestamp().alias("exported_at")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_bundle(spark: SparkSession, path: str, like: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(spark.read.schema(like.entities.schema).json(f"{path}/entities"), spark.read.schema(like.relations.schema).json(f"{path}/relations"))


def _xml(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Node and edge elements, a line each; write_graphml puts the frame around them."""
    nodes = entities.select(F.format_string('<node id="%s"><data key="type">%s</data><data key="label">%s</data></node>', _xml("id"), _xml("type"), _xml("label")).alias("value"))
    return nodes.unionByName(relations.select(F.format_string('<edge id="%s" source="%s" target="%s"><data key="type">%s</data></edge>', _xml("id"), _xml("source_id"), _xml("target_id"), _xml("type")).alias("value")))


def rdf(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """N-Triples: types and labels of entities, then relations."""
    text = F.replace(F.replace("label", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    one = entities.select(F.explode(F.array(F.format_string("<urn:%s> <urn:type> <urn:%s> .", "id", "type"), F.format_string('<urn:%s> <urn:label> "%s" .', F.col("id"), text))).alias("value"))
    return one.unionByName(relations.select(F.format_string("<urn:%s> <urn:%s> <urn:%s> .", "source_id", "type", "target_id").alias("value")))


def csv_rows(entities: DataFrame) -> DataFrame:
    """Flat columns that a CSV writer takes."""
    return entities.select("id", "type", "label", F.to_json("properties").alias("properties"), F.array_join("tags", ";").alias("tags"), "version", "confidence")


def drawing_nodes(entities: DataFrame) -> DataFrame:
    return entities.select("id", "label", "type", "properties")


def drawing_edges(relations: DataFrame) -> DataFrame:
    return relations.select("id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type", "weight", "bidirectional")


def write_graphml(graph: PropertyGraph, path: str) -> None:
    """A folder of text files that, in order of their names, are one GraphML document."""
    lines = graphml(graph.entities, graph.relations)
    head, tail = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph edgedefault="directed">'], ["</graph>", "</graphml>"]
    spark = lines.sparkSession
    one = lambda rows: spark.createDataFrame([("\n".join(rows),)], "value string").coalesce(1)
    one(head).unionByName(lines).unionByName(one(tail)).write.mode("overwrite").text(path)


def write_rdf(graph: PropertyGraph, path: str) -> None:
    rdf(graph.entities, graph.relations).write.mode("overwrite").text(path)


def write_csv(graph: PropertyGraph, path: str) -> None:
    csv_rows(graph.entities).write.mode("overwrite").option("header", True).csv(f"{path}/entities")
    graph.relations.select("id", "source_id", "target_id", "type", "weight").write.mode("overwrite").option("header", True).csv(f"{path}/relations")
