"""Batch changes of entities and relations; each gives a new frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(old: Column | str, new: Column | str) -> Column:
    """Properties with those of `new` on top; null counts as empty."""
    none = F.create_map().cast("map<string,string>")
    col = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, none)
    return F.map_zip_with(col(old), col(new), lambda _, a, b: F.coalesce(b, a))


def add_entities(entities: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """new has at least id, type, label, seq; what it lacks gets the defaults."""
    now = F.lit(0).cast("long") if now is None else now
    defaults = {
        "properties": F.create_map().cast("map<string,string>"),
        "embedding": F.array().cast("array<double>"),
        "tags": F.array().cast("array<string>"),
        "aliases": F.array().cast("array<string>"),
        "version": F.lit(1).cast("long"),
        "confidence": F.lit(1.0),
        "created_at": now,
        "updated_at": now,
        "deleted_at": F.lit(None).cast("long"),
    }
    return entities.unionByName(new.withColumns({k: v for k, v in defaults.items() if k not in new.columns}), allowMissingColumns=True)


def update_entities(entities: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """updates: id, and type, label, properties where they change. Versions rise; ids that don't exist change nothing."""
    now = F.lit(0).cast("long") if now is None else now
    u = updates.select("id", *[F.col(c).alias(f"_{c}") for c in ("type", "label", "properties") if c in updates.columns]).withColumn("_hit", F.lit(True))
    rows = entities.join(u, "id", "left")
    hit = F.col("_hit").isNotNull()
    change = {"version": F.when(hit, F.col("version") + 1).otherwise(F.col("version")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    for c in ("type", "label"):
        if f"_{c}" in u.columns:
            change[c] = F.coalesce(f"_{c}", c)
    if "_properties" in u.columns:
        change["properties"] = F.when(hit, merged("properties", "_properties")).otherwise(F.col("properties"))
    return rows.withColumns(change).select(*entities.columns)


def soft_delete(entities: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Marks entities as deleted; their relations stay."""
    rows = entities.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return rows.withColumn("deleted_at", F.when(F.col("_hit"), now).otherwise(F.col("deleted_at"))).select(*entities.columns)


def add_relations(entities: DataFrame, relations: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Adds relations both ends of which exist; a soft-deleted end counts."""
    now = F.lit(0).cast("long") if now is None else now
    defaults = {"properties": F.create_map().cast("map<string,string>"), "weight": F.lit(1.0), "bidirectional": F.lit(False), "confidence": F.lit(1.0), "created_at": now, "updated_at": now}
    new = new.withColumns({k: v for k, v in defaults.items() if k not in new.columns})
    ids = entities.select("id")
    new = new.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return relations.unionByName(new.select(*relations.columns))


def update_relations(relations: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """updates: id, and weight, properties where they change."""
    now = F.lit(0).cast("long") if now is None else now
    u = updates.select("id", *[F.col(c).alias(f"_{c}") for c in ("weight", "properties") if c in updates.columns]).withColumn("_hit", F.lit(True))
    rows = relations.join(u, "id", "left")
    change = {"updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}
    if "_weight" in u.columns:
        change["weight"] = F.coalesce("_weight", "weight")
    if "_properties" in u.columns:
        change["properties"] = F.when(F.col("_hit"), merged("properties", "_properties")).otherwise(F.col("properties"))
    return rows.withColumns(change).select(*relations.columns)


def delete_relations(relations: DataFrame, ids: DataFrame) -> DataFrame:
    return relations.join(ids.select("id"), "id", "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of old with the same id; of rows that repeat an id in new the last by seq counts."""
    order = Window.partitionBy("id").orderBy(F.desc("seq"))
    last = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return old.join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)


def with_relations(entities: DataFrame, relations: DataFrame, entity_id: str) -> DataFrame:
    """An entity with the ids of its relations, sorted."""
    near = relations.where((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id)).agg(F.sort_array(F.collect_list("id")).alias("relation_ids"))
    return entities.where(F.col("id") == entity_id).crossJoin(near)  # single rows
