"""The star tables as a property graph: entities and relations, one branch per kind.

Typed properties are columns named p_<property>; a filter on one reaches the scan of the kind that has it, and the
branches of other kinds fall away. The properties map is there for generic access and is pruned when unused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: kind: (table, key, type, label, properties, tags)
KINDS: dict[str, tuple[str, str, str, str | None, dict[str, str], list[str]]] = {
    "region": ("region", "r_regionkey", "location", "r_name", {}, ["'region'"]),
    "nation": ("nation", "n_nationkey", "location", "n_name", {"regionkey": "n_regionkey"}, ["'nation'"]),
    "customer": ("customer", "c_custkey", "person", "c_name", {"acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}, ["c_mktsegment"]),
    "supplier": ("supplier", "s_suppkey", "organization", "s_name", {"acctbal": "s_acctbal"}, ["'supplier'"]),
    "part": ("part", "p_partkey", "resource", "p_name", {"brand": "p_brand", "ptype": "p_type", "size": "p_size", "retailprice": "p_retailprice"}, ["p_brand", "p_type"]),
    "order": ("orders", "o_orderkey", "event", None, {"status": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "priority": "o_orderpriority"}, ["o_orderpriority"]),
    "document": ("documents", "doc_id", "document", None, {"lang": "lang", "source": "source", "n_chars": "n_chars"}, ["lang", "source"]),
    "vec": ("embeddings", "vec_id", "concept", None, {"vlabel": "label"}, ["'vec'"]),
}
#: Room for the keys of a kind in seq.
KIND_ROOM = 10**12

#: relation: (table, type, source id, target id, weight, id, key for seq)
RELATIONS: dict[str, tuple[str, str, str, str, str, str, str]] = {
    "nation_region": ("nation", "part_of", "concat('nation:', n_nationkey)", "concat('region:', n_regionkey)", "1.0D", "concat('nr:', n_nationkey)", "n_nationkey"),
    "customer_nation": ("customer", "part_of", "concat('customer:', c_custkey)", "concat('nation:', c_nationkey)", "1.0D", "concat('cn:', c_custkey)", "c_custkey"),
    "supplier_nation": ("supplier", "located_in", "concat('supplier:', s_suppkey)", "concat('nation:', s_nationkey)", "1.0D", "concat('sn:', s_suppkey)", "s_suppkey"),
    "order_customer": ("orders", "created_by", "concat('order:', o_orderkey)", "concat('customer:', o_custkey)", "1.0D", "concat('oc:', o_orderkey)", "o_orderkey"),
    "order_part": ("lineitem", "references", "concat('order:', l_orderkey)", "concat('part:', l_partkey)", "l_quantity", "concat('op:', l_orderkey, ':', l_linenumber, ':', l_partkey, ':', l_suppkey)", "l_orderkey * 10 + l_linenumber"),
    "part_supplier": ("lineitem", "depends_on", "concat('part:', l_partkey)", "concat('supplier:', l_suppkey)", "1.0D", "concat('ps:', l_partkey, ':', l_suppkey)", "l_partkey * 100000 + l_suppkey"),
    "vec_ring": ("embeddings", "related_to", "concat('vec:', vec_id)", "concat('vec:', (7 * vec_id + 1) % n)", "1.0D", "concat('vv:', vec_id)", "vec_id"),
}


_schemas: dict[tuple[str, str], T.StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is read from its files once in an application, as a graph reads each table many times."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def entities(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Entities of some kinds, or of all."""
    out = None
    for number, (kind, (table, key, type_, label, props, tags)) in enumerate(KINDS.items()):
        if kinds and kind not in kinds:
            continue
        eid = F.concat(F.lit(f"{kind}:"), F.col(key))
        name = F.col(label) if label else F.concat(F.lit("doc:" if kind == "document" else f"{kind}:"), F.col(key))
        bag = F.create_map(*[x for p, c in props.items() for x in (F.lit(p), F.col(c).cast("string"))]) if props else F.create_map().cast("map<string,string>")
        df = read(spark, sf_dir, table).select(
            eid.alias("id"),
            F.lit(type_).alias("type"),
            name.alias("label"),
            bag.alias("properties"),
            (F.col("embedding").cast("array<double>") if kind == "vec" else F.array().cast("array<double>")).alias("embedding"),
            F.array(*[F.expr(t) for t in tags]).alias("tags"),
            F.array().cast("array<string>").alias("aliases"),
            F.lit(1).cast("long").alias("version"),
            F.lit(1.0).alias("confidence"),
            F.lit(0).cast("long").alias("created_at"),
            F.lit(0).cast("long").alias("updated_at"),
            F.lit(None).cast("long").alias("deleted_at"),
            (F.lit(number * KIND_ROOM) + F.col(key)).cast("long").alias("seq"),
            *[F.col(c).alias(f"p_{p}") for p, c in props.items()],
        )
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def relations(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Relations of some names, or of all."""
    out = None
    for number, (name, (table, type_, source, target, weight, rid, key)) in enumerate(RELATIONS.items()):
        if names and name not in names:
            continue
        df = read(spark, sf_dir, table)
        if name == "part_supplier":
            df = df.select("l_partkey", "l_suppkey").distinct()
        if name == "vec_ring":
            df = df.select("vec_id", df.agg(F.count("*")).scalar().alias("n"))
        df = df.select(
            F.expr(rid).alias("id"),
            F.expr(source).alias("source_id"),
            F.expr(target).alias("target_id"),
            F.lit(type_).alias("type"),
            F.expr(weight).cast("double").alias("weight"),
            F.create_map().cast("map<string,string>").alias("properties"),
            F.lit(False).alias("bidirectional"),
            F.lit(1.0).alias("confidence"),
            F.lit(0).cast("long").alias("created_at"),
            F.lit(0).cast("long").alias("updated_at"),
            (F.lit(number * 1000 * KIND_ROOM) + F.expr(key)).cast("long").alias("seq"),
        )
        out = df if out is None else out.unionByName(df)
    return out


def _sql_entity(number: int, kind: str) -> str:
    table, key, type_, label, props, tags = KINDS[kind]
    name = label or f"'{'doc' if kind == 'document' else kind}:' || {key}"
    every = {p: "NULL" for k in KINDS.values() for p in k[4]} | props
    return f"SELECT '{kind}:' || {key} AS id, '{type_}' AS type, {name} AS label, [{', '.join(tags)}] AS tags, ({number * KIND_ROOM} + {key})::BIGINT AS seq, " + ", ".join(f"{c} AS p_{p}" for p, c in every.items()) + f" FROM {table}"


def sql_entities(*kinds: str) -> str:
    """The same entities for DuckDB."""
    return " UNION ALL ".join(_sql_entity(i, k) for i, k in enumerate(KINDS) if not kinds or k in kinds)


def sql_relations(*names: str) -> str:
    out = []
    for number, (name, (table, type_, source, target, weight, rid, key)) in enumerate(RELATIONS.items()):
        if names and name not in names:
            continue
        rows = {"part_supplier": "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)", "vec_ring": "(SELECT vec_id, (SELECT count(*) FROM embeddings) AS n FROM embeddings)"}.get(name, table)
        out.append(f"SELECT {rid} AS id, {source} AS source_id, {target} AS target_id, '{type_}' AS type, {weight.replace('1.0D', '1.0')}::DOUBLE AS weight, ({number * 1000 * KIND_ROOM} + {key})::BIGINT AS seq FROM {rows}")
    return " UNION ALL ".join(out)


class PropertyGraph:
    """Entities and relations with a version; mutations return a new graph."""

    def __init__(self, entities: DataFrame, relations: DataFrame, version: int = 0):
        self.entities, self.relations, self.version = entities, relations, version

    @classmethod
    def of_tables(cls, spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> PropertyGraph:
        return cls(entities(spark, sf_dir, *kinds), relations(spark, sf_dir, *names))

    def replaced(self, entities: DataFrame | None = None, relations: DataFrame | None = None) -> PropertyGraph:
        return PropertyGraph(self.entities if entities is None else entities, self.relations if relations is None else relations, self.version + 1)
