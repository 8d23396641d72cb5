"""Every operator of the graph engine as a query over the star tables, with its SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import clocks, predicates, similarity
from graphloom.functions.predicates import Filter, all_of, candidates, not_deleted, resolve, search
from graphloom.operators import aggregate as agg
from graphloom.operators import inference as inf
from graphloom.operators import layout, merge, mutate, oplog, traverse, vector
from graphloom.sources import scratch, store
from graphloom.sources.tables import KINDS, PropertyGraph, entities, read, relations, sql_entities, sql_relations
from graphloom.plans.engine import GraphEngine
from graphloom.streaming import fold as streaming

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def with_graph(body: str, kinds: tuple[str, ...] = (), names: tuple[str, ...] = (), recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}E AS ({sql_entities(*kinds)}), R AS ({sql_relations(*names)}) {body}"


# Scans and lookups

_FLAT = "id, type, label, array_to_string(tags, ',') AS tags, seq"


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "type", "label", F.array_join("tags", ",").alias("tags"), "seq")


def _rel(df: DataFrame) -> DataFrame:
    return df.select("id", "source_id", "target_id", "type", "weight")


_REL = "id, source_id, target_id, type, weight"


@query(with_graph(f"SELECT {_FLAT} FROM E"))
def scan_entities(spark, d):
    return _flat(entities(spark, d))


@query(with_graph(f"SELECT {_REL} FROM R"))
def scan_relations(spark, d):
    return _rel(relations(spark, d))


@query(with_graph(f"SELECT {_FLAT} FROM E WHERE id = 'customer:7'"))
def get_entity(spark, d):
    return _flat(entities(spark, d).where("id = 'customer:7'"))


@query(with_graph(f"SELECT {_FLAT} FROM E WHERE type = 'location'"))
def find_by_type(spark, d):
    return _flat(entities(spark, d).where((F.col("type") == "location") & not_deleted()))


@query(with_graph(f"SELECT {_FLAT} FROM E WHERE list_contains(tags, 'BUILDING')"))
def find_by_tag(spark, d):
    return _flat(entities(spark, d).where(F.array_contains("tags", "BUILDING") & not_deleted()))


@query(with_graph(f"SELECT {_REL} FROM R WHERE type = 'located_in'"))
def relations_by_type(spark, d):
    return _rel(relations(spark, d).where("type = 'located_in'"))


def _folder(spark: SparkSession) -> str:
    return f"{scratch.folder(spark)}/graphloom-store-{os.urandom(6).hex()}"


@query(with_graph(f"SELECT {_FLAT} FROM E"))
def store_roundtrip(spark, d):
    with store.open_store(spark, "parquet", _folder(spark)) as kept:
        kept.save("g", PropertyGraph.of_tables(spark, d))
        return _flat(kept.load("g").entities)


@query(with_graph(f"SELECT {_REL} FROM R WHERE type = 'part_of'"))
def store_relations_by_type(spark, d):
    kept = store.open_store(spark, "parquet", _folder(spark))
    kept.save("g", PropertyGraph.of_tables(spark, d))
    return _rel(kept.relations_by_type("g", "part_of"))


@query(with_graph(f"SELECT {_FLAT} FROM E WHERE type = 'person'"))
def store_entities_by_type(spark, d):
    kept = store.open_store(spark, "memory")
    kept.save("g", PropertyGraph.of_tables(spark, d))
    return _flat(kept.entities_by_type("g", "person"))


@query(
    """
SELECT 'nation:' || n_nationkey AS id, upper(n_name) || '!' AS label FROM nation WHERE n_regionkey <> 2
UNION ALL SELECT 'nation:new', 'Atlantis'
"""
)
def store_rows(spark, d):
    """Rows put into a stored graph and deleted from it by id: labels change, one is new, those of one region go."""
    kept = store.open_store(spark, "parquet", _folder(spark))
    e = entities(spark, d, "nation")
    kept.save("g", PropertyGraph(e, relations(spark, d, "nation_region")))
    new = e.limit(1).withColumns({"id": F.lit("nation:new"), "label": F.lit("Atlantis")})
    kept.put("g", e.withColumn("label", F.concat(F.upper("label"), F.lit("!"))).unionByName(new))
    kept.delete("g", e.where("p_regionkey = 2").select("id"))
    return kept.load("g").entities.select("id", "label")


@query(
    """
SELECT 'part:' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS label FROM part
UNION ALL SELECT 'part:x' || p_partkey, 'new ' || p_name FROM part WHERE p_partkey % 5 = 0
"""
)
def import_upsert(spark, d):
    old = entities(spark, d, "part")
    key = F.split("id", ":")[1].cast("long")
    new = old.where(key % 3 == 0).withColumn("label", F.concat(F.lit("new "), "label"))
    more = old.where(key % 5 == 0).withColumn("label", F.concat(F.lit("new "), "label")).withColumn("id", F.concat(F.lit("part:x"), key))
    return mutate.upsert(old, new.unionByName(more)).select("id", "label")


@query(with_graph("SELECT to_json({'id': id, 'type': type, 'label': label, 'tags': tags, 'version': 1, 'confidence': 1.0::DOUBLE, 'created_at': 0, 'seq': seq})::VARCHAR AS value FROM E"))
def export_json(spark, d):
    return store.as_json(entities(spark, d).select("id", "type", "label", "tags", "version", "confidence", "created_at", "seq"))


@query(with_graph(f"SELECT {_FLAT} FROM E"))
def json_roundtrip(spark, d):
    e = entities(spark, d)
    return _flat(store.of_json(store.as_json(e), e))


@query(with_graph(f"SELECT {_REL} FROM R"))
def bundle_roundtrip(spark, d):
    """Entities, relations and a manifest as JSON files, and back."""
    folder, graph = _folder(spark), PropertyGraph.of_tables(spark, d)
    store.export_bundle(graph, folder)
    return _rel(store.import_bundle(spark, folder, graph).relations)


@query(with_graph("SELECT (SELECT count(*) FROM E) AS entity_count, (SELECT count(*) FROM R) AS relation_count"))
def storage_stats(spark, d):
    return store.storage_stats(entities(spark, d), relations(spark, d)).select("entity_count", "relation_count")


@query(with_graph("SELECT id, source_id AS source, target_id AS target, type, weight, false AS bidirectional FROM R"))
def visualize_edges(spark, d):
    return store.drawing_edges(relations(spark, d))


@query(with_graph("SELECT id, label, type FROM E"))
def visualize_nodes(spark, d):
    return store.drawing_nodes(entities(spark, d)).select("id", "label", "type")


def _props_sql(kind: str) -> str:
    table, key, _, _, props, _ = KINDS[kind]
    fields = ", ".join(f"'{p}', {c}::VARCHAR" for p, c in props.items())
    return f"SELECT '{kind}:' || {key} AS id, {f'json_object({fields})::VARCHAR' if props else repr('{}')} AS properties FROM {table}"


_CSV_KINDS = [k for k in KINDS if k not in ("customer", "supplier", "part", "order")]
_CSV = " UNION ALL ".join(map(_props_sql, _CSV_KINDS))


@query(with_graph(f"SELECT E.id, type, label, properties, array_to_string(tags, ';') AS tags, 1::BIGINT AS version, 1.0::DOUBLE AS confidence FROM E JOIN ({_CSV}) p ON E.id = p.id", tuple(_CSV_KINDS)))
def export_csv(spark, d):
    """Of the kinds whose properties are no decimals: engines write those differently."""
    return store.csv_rows(entities(spark, d, *_CSV_KINDS))


_XML_SQL = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    with_graph(
        f"""
SELECT '<node id="' || {_XML_SQL.format("id")} || '"><data key="type">' || type || '</data><data key="label">' || {_XML_SQL.format("label")} || '</data></node>' AS value FROM E
UNION ALL
SELECT '<edge id="' || id || '" source="' || source_id || '" target="' || target_id || '"><data key="type">' || type || '</data></edge>' FROM R
"""
    )
)
def export_graphml(spark, d):
    return store.graphml(entities(spark, d), relations(spark, d))


@query(
    with_graph(
        r"""
SELECT '<urn:' || source_id || '> <urn:' || type || '> <urn:' || target_id || '> .' AS value FROM R
UNION ALL SELECT '<urn:' || id || '> <urn:type> <urn:' || type || '> .' FROM E
UNION ALL SELECT '<urn:' || id || '> <urn:label> "' || replace(replace(label, '\', '\\'), '"', '\"') || '" .' FROM E
"""
    )
)
def export_rdf(spark, d):
    return store.rdf(entities(spark, d), relations(spark, d))


# Changes


@query("SELECT 'customer:' || c_custkey AS id, c_name AS label, 1::BIGINT AS version FROM customer UNION ALL SELECT 'person:' || s_suppkey, 'contact of ' || s_name, 1 FROM supplier")
def add_entities(spark, d):
    new = read(spark, d, "supplier").select(F.concat(F.lit("person:"), "s_suppkey").alias("id"), F.lit("person").alias("type"), F.concat(F.lit("contact of "), "s_name").alias("label"), F.col("s_suppkey").alias("seq"))
    return mutate.add_entities(entities(spark, d, "customer"), new).select("id", "label", "version")


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'renamed' ELSE c_name END AS label, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN c_custkey % 4 = 0 THEN 'VIP' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN 'yes' END AS extra, CASE WHEN c_custkey % 4 = 0 THEN 99 ELSE 0 END::BIGINT AS updated_at FROM customer")
def update_entities(spark, d):
    e = entities(spark, d, "customer")
    u = e.where(F.col("seq") % 4 == 0).select("id", F.lit("renamed").alias("label"), F.create_map(F.lit("mktsegment"), F.lit("VIP"), F.lit("extra"), F.lit("yes")).alias("properties"))
    out = mutate.update_entities(e, u, F.lit(99).cast("long"))
    p = lambda k: F.try_element_at("properties", F.lit(k))
    return out.select("id", "label", "version", p("mktsegment").alias("segment"), p("extra").alias("extra"), "updated_at")


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE NOT (p_size < 10)")
def soft_delete(spark, d):
    e = entities(spark, d, "part")
    gone = e.where(F.col("p_size") < 10).select("id")
    return mutate.soft_delete(e, gone, F.lit(5).cast("long")).where(not_deleted()).select("id")


@query("SELECT 'cn:' || c_custkey AS id FROM customer UNION ALL SELECT 'new:' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey IN (SELECT c_custkey FROM customer)")
def add_relations_valid(spark, d):
    """Every second nation to the customer of its key, others to one that doesn't exist."""
    n = read(spark, d, "nation")
    target = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("customer:"), "n_nationkey")).otherwise(F.lit("customer:none"))
    new = n.select(F.concat(F.lit("new:"), "n_nationkey").alias("id"), F.concat(F.lit("nation:"), "n_nationkey").alias("source_id"), target.alias("target_id"), F.lit("knows").alias("type"), F.col("n_nationkey").cast("long").alias("seq"))
    return mutate.add_relations(entities(spark, d, "nation", "customer"), relations(spark, d, "customer_nation"), new).select("id")


@query("SELECT 'cn:' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS weight FROM customer")
def update_relations(spark, d):
    r = relations(spark, d, "customer_nation")
    u = r.where(F.split("id", ":")[1].cast("long") % 3 == 0).select("id", F.lit(0.25).alias("weight"))
    return mutate.update_relations(r, u).select("id", "weight")


@query("SELECT 'oc:' || o_orderkey AS id FROM orders WHERE NOT o_orderkey % 10 = 3")
def delete_relations(spark, d):
    r = relations(spark, d, "order_customer")
    return mutate.delete_relations(r, r.where(F.split("id", ":")[1].cast("long") % 10 == 3)).select("id")


@query("SELECT 'part:' || p_partkey AS id, 'size=' || p_size || ',brand=' || CASE WHEN p_partkey % 2 = 0 THEN 'NEW' ELSE p_brand END || ',color=' || CASE WHEN p_partkey % 2 = 0 THEN 'red' ELSE '-' END AS props FROM part")
def merge_props(spark, d):
    e = entities(spark, d, "part")
    new = F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("brand"), F.lit("NEW"), F.lit("color"), F.lit("red")))
    p = mutate.merged(F.col("properties"), new)
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("-"))
    return e.select("id", p.alias("m")).select("id", F.concat(F.lit("size="), get("size"), F.lit(",brand="), get("brand"), F.lit(",color="), get("color")).alias("props"))


# Filters

_FILTERS: dict[str, tuple[str, list[Filter], str]] = {
    "filter_eq": ("customer", [Filter("properties.mktsegment", "eq", "BUILDING")], "p_mktsegment = 'BUILDING'"),
    "filter_neq": ("customer", [Filter("properties.mktsegment", "neq", "BUILDING")], "p_mktsegment <> 'BUILDING'"),
    "filter_gt": ("customer", [Filter("properties.acctbal", "gt", 5000.0)], "p_acctbal > 5000"),
    "filter_gte": ("part", [Filter("properties.size", "gte", 40)], "p_size >= 40"),
    "filter_lt": ("customer", [Filter("properties.acctbal", "lt", 0.0)], "p_acctbal < 0"),
    "filter_lte": ("part", [Filter("properties.size", "lte", 3)], "p_size <= 3"),
    "filter_in": ("order", [Filter("properties.status", "in", ["F", "P"])], "p_status IN ('F', 'P')"),
    "filter_nin": ("order", [Filter("properties.status", "nin", ["F", "P"])], "p_status NOT IN ('F', 'P')"),
    "filter_contains": ("part", [Filter("label", "contains", "a")], "contains(label, 'a')"),
    "filter_startswith": ("part", [Filter("properties.brand", "startsWith", "Brand#1")], "starts_with(p_brand, 'Brand#1')"),
    "filter_endswith": ("customer", [Filter("label", "endsWith", "7")], "ends_with(label, '7')"),
    "filter_regex": ("customer", [Filter("label", "regex", "0[1-3]$")], "regexp_matches(label, '0[1-3]$')"),
    "filter_conjunction": ("customer", [Filter("properties.mktsegment", "in", ["BUILDING", "MACHINERY"]), Filter("properties.acctbal", "gte", 1000.0), Filter("metadata.tags", "contains", "BUILD")], "p_mktsegment IN ('BUILDING', 'MACHINERY') AND p_acctbal >= 1000 AND contains(array_to_string(tags, ','), 'BUILD')"),
}


def _filter_query(kind: str, filters: list[Filter]) -> Query:
    def run(spark, d):
        e = entities(spark, d, kind)
        return e.where(all_of(e, filters)).select("id", "label")

    return run


for _name, (_kind, _filters, _where) in _FILTERS.items():
    query(with_graph(f"SELECT id, label FROM E WHERE {_where}", (_kind,)), _name)(_filter_query(_kind, _filters))


@query("SELECT 'event:' || event_id AS id, (props->>'k')::DOUBLE AS k FROM events WHERE (props->>'k')::DOUBLE > 50")
def nested_property(spark, d):
    e = read(spark, d, "events").select(F.concat(F.lit("event:"), "event_id").alias("id"), F.from_json("props", "map<string,string>").alias("properties"))
    k = resolve(e, "properties.k", 0.0)
    return e.select("id", k.alias("k")).where(F.col("k") > 50)


@query("SELECT 'customer:' || c_custkey AS a_id, 'nation:' || c_nationkey AS b_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 AND contains(n_name, 'A')")
def pattern_constraint(spark, d):
    p = inf.Pattern((inf.Node("a", "person", constraints=(Filter("properties.acctbal", "gt", 9000.0),)), inf.Node("b", "location", constraints=(Filter("label", "contains", "A"),))), (inf.Edge("a", "part_of", "b"),))
    return inf.matches(entities(spark, d, "customer", "nation"), relations(spark, d, "customer_nation"), p)


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE contains(lower(p_name), 'brand#2') OR contains(lower(p_brand), 'brand#2')")
def candidate_label(spark, d):
    """Parts, each of which has its brand as an alias."""
    e = entities(spark, d, "part").withColumn("aliases", F.array("p_brand"))
    return e.where(candidates(e, "BRAND#2", "resource")).select("id")


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_size BETWEEN 10 AND 20 AND (p_retailprice >= 1500 OR p_retailprice <= 950)")
def inside_box(spark, d):
    """A box over the date line, with sizes and prices for degrees."""
    e = entities(spark, d, "part")
    return e.where(predicates.inside_box(e, 10, 1500, 20, 950, "properties.size", "properties.retailprice")).select("id")


@query("SELECT 'event:' || event_id AS id, (props->>'k')::DOUBLE AS k FROM events WHERE (props->>'k')::DOUBLE < 20")
def nested_path(spark, d):
    """A path of three steps into a property whose value is JSON."""
    raw = F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k")).alias("b")))
    e = read(spark, d, "events").select(F.concat(F.lit("event:"), "event_id").alias("id"), F.create_map(F.lit("a"), raw).alias("properties"))
    return e.where(all_of(e, [Filter("properties.a.b.k", "lt", 20)])).select("id", resolve(e, "properties.a.b.k", 0.0).alias("k"))


@query(with_graph("SELECT id FROM E WHERE contains(lower(label), 'er') OR contains(lower(type), 'er')", ("customer", "nation", "supplier")))
def search_label(spark, d):
    return entities(spark, d, "customer", "nation", "supplier").where(search("ER")).select("id")


@query(with_graph("SELECT id, (count(*) OVER ())::BIGINT AS total FROM E WHERE type = 'person' AND list_contains(tags, 'BUILDING') ORDER BY seq LIMIT 20 OFFSET 10", ("customer", "supplier")))
def list_entities(spark, d):
    """A page of a REST list; total counts before paging."""
    e = entities(spark, d, "customer", "supplier").where((F.col("type") == "person") & F.array_contains("tags", "BUILDING"))
    total = e.agg(F.count("*").alias("total"))
    return traverse.page(e.select("id", "seq"), ["seq"], 20, 10).crossJoin(F.broadcast(total)).select("id", "total")  # one row


@query(with_graph("SELECT id, source_id FROM R WHERE type = 'created_by' AND target_id = 'customer:7' ORDER BY seq, id LIMIT 50", ("region",), ("order_customer",)))
def list_relations(spark, d):
    r = relations(spark, d, "order_customer").where((F.col("type") == "created_by") & (F.col("target_id") == "customer:7"))
    return traverse.page(r, ["seq", "id"], 50).select("id", "source_id")


# Traversal


@query(with_graph("SELECT id, 'customer:7' AS node_id FROM R WHERE source_id = 'customer:7' OR target_id = 'customer:7'"))
def incident_relations(spark, d):
    ids = spark.createDataFrame([("customer:7",)], "id string")
    return traverse.incident(relations(spark, d), ids).select("id", "node_id")


@query(with_graph("SELECT id, target_id FROM R WHERE source_id IN ('order:1', 'order:5', 'customer:7')"))
def outgoing_relations(spark, d):
    ids = spark.createDataFrame([("order:1",), ("order:5",), ("customer:7",)], "id string")
    return traverse.outgoing(relations(spark, d), ids).select("id", "target_id")


@query(with_graph("SELECT id, source_id FROM R WHERE target_id IN ('nation:3', 'part:5')"))
def incoming_relations(spark, d):
    ids = spark.createDataFrame([("nation:3",), ("part:5",)], "id string")
    return traverse.incoming(relations(spark, d), ids).select("id", "source_id")


@query(
    with_graph(
        """
SELECT source_id AS src, target_id AS dst, 'outbound' AS direction, id AS rel_id FROM R
UNION ALL SELECT target_id, source_id, 'inbound', id FROM R
"""
    )
)
def adjacency_both(spark, d):
    return traverse.adjacency(relations(spark, d), ["both"]).select("src", "dst", "direction", "rel_id")


def bfs_sql(starts: list[str], depth: int, select: str, adj: str = "SELECT source_id AS src, target_id AS dst, id AS rel_id, seq, source_id, target_id, 'outbound' AS direction FROM R", node: str = "true", kinds: tuple[str, ...] = (), names: tuple[str, ...] = ()) -> str:
    """Level by level, unrolled: nodes N (id, depth, pos, path), relations A."""
    key = "lpad(a.seq::VARCHAR, 19, '0') || '|' || a.rel_id"
    seed = " UNION ALL ".join(f"SELECT '{s}' AS id, {i} AS at" for i, s in enumerate(starts))
    ctes = [f"OKAY AS (SELECT id FROM E WHERE {node})", f"A AS ({adj})", f"L0 AS (SELECT s.id, 0 AS depth, [lpad(s.at::VARCHAR, 9, '0') || '|' || s.id] AS pos, [s.id] AS path FROM ({seed}) s JOIN OKAY USING (id))", "V0 AS (SELECT * FROM L0)"]
    for k in range(1, depth + 1):
        ctes.append(f"S{k} AS (SELECT a.dst AS id, list_append(l.pos, {key}) AS pos, list_append(l.path, a.dst) AS path FROM L{k - 1} l JOIN A a ON a.src = l.id)")
        ctes.append(f"L{k} AS (SELECT s.id, {k} AS depth, min(s.pos) AS pos, arg_min(s.path, s.pos) AS path FROM S{k} s JOIN OKAY USING (id) WHERE s.id NOT IN (SELECT id FROM V{k - 1}) GROUP BY s.id)")
        ctes.append(f"V{k} AS (SELECT * FROM V{k - 1} UNION ALL SELECT * FROM L{k})")
    ctes.append(f"N AS (SELECT * FROM V{depth})")
    return with_graph(", " + ", ".join(ctes) + " " + select, kinds, names)


_BOTH = "SELECT source_id AS src, target_id AS dst, id AS rel_id, seq, source_id, target_id, 'outbound' AS direction FROM R UNION ALL SELECT target_id, source_id, id, seq, source_id, target_id, 'inbound' FROM R"


@query(bfs_sql(["order:0", "order:1"], 2, "SELECT id, depth FROM N"))
def traverse_nodes(spark, d):
    return traverse.traverse(entities(spark, d), relations(spark, d), ["order:0", "order:1"], 2).nodes.select("id", "depth")


@query(bfs_sql(["order:0", "order:1"], 2, "SELECT DISTINCT a.rel_id AS id, a.source_id, a.target_id FROM A a JOIN N n ON a.src = n.id WHERE n.depth < 2"))
def traverse_edges(spark, d):
    return traverse.traverse(entities(spark, d), relations(spark, d), ["order:0", "order:1"], 2).edges.select("id", "source_id", "target_id")


_PLACES_ONLY = _BOTH.replace("FROM R", "FROM R WHERE type IN ('part_of', 'located_in')")


@query(bfs_sql(["region:1"], 2, "SELECT id, depth FROM N", _PLACES_ONLY))
def traverse_filtered(spark, d):
    """Both directions, two types of relations."""
    return traverse.traverse(entities(spark, d), relations(spark, d), ["region:1"], 2, ["both"], ["part_of", "located_in"]).nodes.select("id", "depth")


@query(bfs_sql(["customer:7"], 1, "SELECT id, depth FROM N", _BOTH))
def traverse_depth1(spark, d):
    return traverse.traverse(entities(spark, d), relations(spark, d), ["customer:7"], 1, ["both"]).nodes.select("id", "depth")


@query(bfs_sql(["nation:3"], 3, "SELECT id, depth FROM N", _BOTH, "type <> 'person' OR p_acctbal > 3000"))
def traverse_node_filter(spark, d):
    rich = lambda _: (F.col("type") != "person") | (F.col("p_acctbal") > 3000)
    return traverse.traverse(entities(spark, d), relations(spark, d), ["nation:3"], 3, ["both"], node_filter=rich, ordered=False).nodes.select("id", "depth")


_HEAVY = "SELECT source_id AS src, target_id AS dst, id AS rel_id, seq, source_id, target_id, 'outbound' AS direction FROM R WHERE weight >= 20 OR type <> 'references'"


@query(bfs_sql(["order:1", "order:2", "order:3"], 2, "SELECT id, depth FROM N", _HEAVY))
def traverse_edge_filter(spark, d):
    heavy = lambda _: (F.col("weight") >= 20) | (F.col("type") != "references")
    return traverse.traverse(entities(spark, d), relations(spark, d), ["order:1", "order:2", "order:3"], 2, edge_filter=heavy).nodes.select("id", "depth")


@query(bfs_sql(["order:1"], 3, "SELECT id, depth, array_to_string(path, '>') AS path FROM N WHERE depth > 0"))
def traverse_paths(spark, d):
    found = traverse.traverse(entities(spark, d), relations(spark, d), ["order:1"], 3)
    return found.paths.select("id", "depth", F.array_join("path", ">").alias("path"))


@query(bfs_sql(["supplier:1", "supplier:2", "nowhere:1"], 2, "SELECT id, depth FROM N"))
def traverse_multi_source(spark, d):
    """Starts that are told twice, or don't exist, change nothing."""
    starts = ["supplier:1", "supplier:2", "supplier:1", "nowhere:1"]
    return traverse.traverse(entities(spark, d), relations(spark, d), starts, 2).nodes.select("id", "depth")


@query(bfs_sql(["vec:0"], 6, "SELECT id, depth AS hops FROM N", _BOTH, kinds=("vec",), names=("vec_ring",)))
def hop_distance(spark, d):
    return traverse.traverse(entities(spark, d, "vec"), relations(spark, d, "vec_ring"), ["vec:0"], 6, ["both"]).nodes.select("id", F.col("depth").alias("hops"))


@query(bfs_sql(["order:1"], 3, "SELECT path[-2] AS parent, id AS child, depth FROM N WHERE depth > 0"))
def traverse_tree(spark, d):
    return traverse.traverse(entities(spark, d), relations(spark, d), ["order:1"], 3).tree()


@query(bfs_sql(["nation:3"], 2, "SELECT id, depth FROM N ORDER BY depth, pos LIMIT 15 OFFSET 5", _BOTH))
def traverse_page(spark, d):
    found = traverse.traverse(entities(spark, d), relations(spark, d), ["nation:3"], 2, ["both"])
    return traverse.page(found.nodes, ["depth", "pos"], 15, 5).select("id", "depth")


@query(bfs_sql(["nation:3"], 2, "SELECT (SELECT count(*) FROM N) AS nodes, (SELECT count(*) FROM A JOIN N ON A.src = N.id WHERE N.depth < 2) AS edges, (SELECT count(*) FROM N WHERE depth > 0) AS paths", _BOTH))
def traverse_totals(spark, d):
    """What a query found before paging: the counts of a result whose page is one row."""
    spec = {"type": "traversal", "traversal": {"start_ids": ["nation:3"], "max_depth": 2, "directions": ["both"]}, "options": {"limit": 1}}
    totals = GraphEngine(spark, PropertyGraph.of_tables(spark, d)).query(spec).totals()
    return spark.createDataFrame([tuple(totals[k] for k in ("nodes", "edges", "paths"))], "nodes long, edges long, paths long")


@query(with_graph("SELECT E.id, coalesce(n, 0)::BIGINT AS degree FROM E LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM R UNION ALL SELECT target_id FROM R WHERE source_id <> target_id) GROUP BY id) c ON E.id = c.id"))
def node_degree(spark, d):
    return traverse.degree(entities(spark, d), relations(spark, d))


# Join shapes


@query("SELECT 'customer:' || c_custkey AS a_id, 'nation:' || c_nationkey AS b_id, 'region:' || n_regionkey AS c_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def pattern_two_hop(spark, d):
    p = inf.Pattern((inf.Node("a", "person"), inf.Node("b", "location"), inf.Node("c", "location")), (inf.Edge("a", "part_of", "b"), inf.Edge("b", "part_of", "c")))
    return inf.matches(entities(spark, d, "customer", "nation", "region"), relations(spark, d, "customer_nation", "nation_region"), p)


@query("SELECT 'order:' || a.o_orderkey AS a_id, 'order:' || b.o_orderkey AS b_id, 'customer:' || a.o_custkey AS o_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey")
def pattern_colleague(spark, d):
    """Two orders of one customer: relations meet in their target."""
    p = inf.Pattern((inf.Node("a", "event"), inf.Node("b", "event"), inf.Node("o", "person")), (inf.Edge("a", "created_by", "o"), inf.Edge("b", "created_by", "o")), distinct_vars=True)
    return inf.matches(entities(spark, d, "order", "customer"), relations(spark, d, "order_customer"), p)


@query("SELECT 'nation:' || c_nationkey AS a_id, min('customer:' || c_custkey) AS b_id FROM customer GROUP BY 1")
def pattern_first_per_anchor(spark, d):
    """Of the many customers of a nation the first."""
    p = inf.Pattern((inf.Node("a", "location"), inf.Node("b", "person")), (inf.Edge("b", "part_of", "a"),))
    return inf.matches(entities(spark, d), relations(spark, d), p, first_per_anchor=True)


@query("SELECT 'region:' || r_regionkey AS a_id, 'supplier:' || s_suppkey AS b_id FROM region, supplier WHERE s_acctbal > 9000")
def pattern_unlinked(spark, d):
    """Two variables that no relation ties: combined, as the rows that this makes were counted first."""
    rich = Filter("properties.acctbal", "gt", 9000.0)
    p = inf.Pattern((inf.Node("a", "location", constraints=(Filter("id", "startsWith", "region:"),)), inf.Node("b", "organization", constraints=(rich,))))
    return inf.matches(entities(spark, d, "region", "supplier"), relations(spark, d, "nation_region"), p, most_crossed=1_000_000)


@query(
    """
SELECT 'customer:' || c_custkey AS source_id, 'region:' || n_regionkey AS target_id
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'
"""
)
def infer_anti_existing(spark, d):
    """Customers of one segment have their regions as relations already: those are not derived again."""
    e, r = entities(spark, d, *_PLACE_KINDS), relations(spark, d, *_PLACE_RELS)
    nations = r.where("id like 'nr:%'").select(F.col("source_id").alias("nation"), F.col("target_id").alias("region"))
    building = e.where("p_mktsegment = 'BUILDING'").select(F.col("id").alias("source_id"))
    known = r.where("id like 'cn:%'").join(building, "source_id").join(nations, F.col("target_id") == F.col("nation"))
    known = known.select(*[F.col("region").alias("target_id") if c == "target_id" else F.concat(F.lit("x"), "id").alias("id") if c == "id" else c for c in r.columns])
    return inf.infer(e, r.unionByName(known), inf.built_in(), rule_ids=["part-of-transitive"]).select("source_id", "target_id")


@query("SELECT 'nation:' || n_nationkey AS id, n_name AS label, (SELECT string_agg(r, ',' ORDER BY r) FROM (SELECT 'nr:' || n_nationkey AS r FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'sn:' || s_suppkey FROM supplier WHERE s_nationkey = 3)) AS relation_ids FROM nation WHERE n_nationkey = 3")
def entity_with_relations(spark, d):
    out = mutate.with_relations(entities(spark, d, "nation"), relations(spark, d, "nation_region", "supplier_nation"), "nation:3")
    return out.select("id", "label", F.array_join("relation_ids", ",").alias("relation_ids"))


# Aggregation

_AGGS = {
    "agg_count": ("count", "count(c_acctbal)"),
    "agg_sum": ("sum", "round(sum(c_acctbal), 2)"),
    "agg_avg": ("avg", "round(avg(c_acctbal), 6)"),
    "agg_min": ("min", "min(c_acctbal)"),
    "agg_max": ("max", "max(c_acctbal)"),
    "agg_cardinality": ("cardinality", "count(DISTINCT c_acctbal)"),
}


def _agg_query(kind: str) -> Query:
    def run(spark, d):
        out = agg.aggregate(entities(spark, d, "customer"), [agg.Aggregation("value", kind, "properties.acctbal")])
        return out.select(F.round("value", {"sum": 2, "avg": 6}[kind]).alias("value") if kind in ("sum", "avg") else "value")

    return run


for _name, (_kind, _expr) in _AGGS.items():
    query(f"SELECT {_expr} AS value FROM customer", _name)(_agg_query(_kind))


@query()
def agg_cardinality_approx(spark, d):
    return agg.aggregate(entities(spark, d, "customer"), [agg.Aggregation("value", "cardinality", "properties.acctbal", {"approximate": True})])


@query("SELECT " + ", ".join(f"round(quantile_cont(c_acctbal, {p}), 6) AS p{int(p * 100)}" for p in agg.PERCENTILES) + " FROM customer")
def agg_percentiles(spark, d):
    out = agg.aggregate(entities(spark, d, "customer"), [agg.Aggregation("value", "percentiles", "properties.acctbal")])
    return out.select(*[F.round(F.col("value")[i], 6).alias(f"p{int(p * 100)}") for i, p in enumerate(agg.PERCENTILES)])


@query("SELECT (floor(c_acctbal / 500.0) * 500.0)::DOUBLE AS bucket, count(*) AS count FROM customer GROUP BY 1")
def agg_histogram(spark, d):
    return agg.histogram(entities(spark, d, "customer"), "properties.acctbal", 500.0)


@query("SELECT p_brand AS brand, count(p_size) AS n, round(avg(p_size), 6) AS mean, max(p_retailprice) AS dearest FROM part GROUP BY 1")
def agg_group_by(spark, d):
    out = agg.aggregate(entities(spark, d, "part"), [agg.Aggregation("n", "count", "properties.size"), agg.Aggregation("mean", "avg", "properties.size"), agg.Aggregation("dearest", "max", "properties.retailprice")], ["properties.brand"])
    return out.select("brand", "n", F.round("mean", 6).alias("mean"), "dearest")


@query("SELECT name, type, round(value, 4) AS value FROM (SELECT 'n' AS name, 'count' AS type, count(o_totalprice)::DOUBLE AS value FROM orders UNION ALL SELECT 'total', 'sum', sum(o_totalprice) FROM orders UNION ALL SELECT 'least', 'min', min(o_totalprice) FROM orders UNION ALL SELECT 'kinds', 'cardinality', count(DISTINCT o_orderpriority) FROM orders)")
def agg_multi(spark, d):
    rows = agg.as_rows(entities(spark, d, "order"), [agg.Aggregation("n", "count", "properties.totalprice"), agg.Aggregation("total", "sum", "properties.totalprice"), agg.Aggregation("least", "min", "properties.totalprice"), agg.Aggregation("kinds", "cardinality", "properties.priority")])
    return rows.select("name", "type", F.round("value", 4).alias("value"))


@query(with_graph("SELECT type, count(*) AS count FROM E GROUP BY 1"))
def stats_entity_types(spark, d):
    return agg.stats(entities(spark, d))


@query(with_graph("SELECT type, count(*) AS count FROM R GROUP BY 1"))
def stats_relation_types(spark, d):
    return agg.stats(relations(spark, d))


@query(with_graph("SELECT (SELECT count(*) FROM E) AS entities, (SELECT count(*) FROM R) AS relations"))
def stats_totals(spark, d):
    return entities(spark, d).agg(F.count("*").alias("entities")).crossJoin(relations(spark, d).agg(F.count("*").alias("relations")))  # single rows


# Vectors

_Q = [round(((i * 37) % 64 - 32) / 32, 4) for i in range(64)]
_QS = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"


def _scores(metric: str) -> Query:
    def run(spark, d):
        return vector.scored(entities(spark, d, "vec"), _Q, metric).select("id", F.round("score", 6).alias("score"))

    return run


for _name, _metric, _expr in (("vector_cosine", "cosine", "list_cosine_similarity(v, q)"), ("vector_euclidean", "euclidean", "1 / (1 + list_distance(v, q))"), ("vector_dot", "dotProduct", "list_dot_product(v, q)")):
    query(f"SELECT 'vec:' || vec_id AS id, round({_expr}, 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS v, {_QS} AS q FROM embeddings)", _name)(_scores(_metric))

_COS = f"(SELECT 'vec:' || vec_id AS id, vec_id, label, list_cosine_similarity(embedding::DOUBLE[], {_QS}) AS s FROM embeddings)"


@query(f"SELECT id, round(s, 6) AS score FROM {_COS} ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return vector.search(entities(spark, d, "vec"), _Q, 10).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(s, 6) AS score FROM {_COS} WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 10")
def vector_prefilter(spark, d):
    return vector.search(entities(spark, d, "vec"), _Q, 10, filters=[Filter("properties.vlabel", "eq", 3)]).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round(s, 6) AS score FROM {_COS} WHERE s >= 0.1")
def vector_threshold(spark, d):
    return vector.scored(entities(spark, d, "vec"), _Q, threshold=0.1).select("id", F.round("score", 6).alias("score"))


def _hybrid(spark, d):
    e = entities(spark, d, "vec")
    found = traverse.traverse(e, relations(spark, d, "vec_ring"), ["vec:0", "vec:5"], 3, ["both"])
    return found, vector.search(e, _Q, 100)


def _hybrid_sql(score: str) -> str:
    body = f"""SELECT n.id, round({score}, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY depth, pos) AS nr FROM N) n
      LEFT JOIN (SELECT id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS vr FROM (SELECT * FROM {_COS} ORDER BY s DESC, vec_id LIMIT 100) WHERE id IN (SELECT id FROM N)) v USING (id)
      ORDER BY {score} DESC, vr NULLS LAST, nr LIMIT 10"""
    return bfs_sql(["vec:0", "vec:5"], 3, body, _BOTH, kinds=("vec",), names=("vec_ring",))


def _hybrid_query(method: str, weights: vector.Weights = vector.Weights()) -> Query:
    def run(spark, d):
        found, hits = _hybrid(spark, d)
        return vector.hybrid(found.nodes, hits, 10, method, weights=weights).select("id", F.round("fused", 6).alias("score"))

    return run


query(_hybrid_sql("coalesce(1.0::DOUBLE / (60 + vr), 0) + 1.0::DOUBLE / (60 + nr)"), "hybrid_rrf")(_hybrid_query("rrf"))
query(_hybrid_sql("0.7::DOUBLE * coalesce(s, 0) + 0.3::DOUBLE"), "hybrid_weighted")(_hybrid_query("weighted", vector.Weights(0.7, 0.3)))
query(_hybrid_sql("coalesce(s, 0) + 1"), "hybrid_additive")(_hybrid_query("additive"))


@query(bfs_sql(["vec:0", "vec:5"], 3, f"SELECT id FROM (SELECT id FROM {_COS} ORDER BY s DESC, vec_id LIMIT 100) WHERE id IN (SELECT id FROM N)", _BOTH, kinds=("vec",), names=("vec_ring",)))
def hybrid_semi(spark, d):
    found, hits = _hybrid(spark, d)
    return hits.join(found.nodes, "id", "left_semi").select("id")


@query(bfs_sql(["vec:0", "vec:5"], 3, f"SELECT (SELECT count(*) FROM N) AS nodes_visited, (SELECT count(*) FROM A JOIN N ON A.src = N.id WHERE N.depth < 3) AS edges_traversed, 100::BIGINT AS total_candidates, (SELECT count(*) FROM (SELECT id FROM {_COS} ORDER BY s DESC, vec_id LIMIT 100) WHERE id IN (SELECT id FROM N)) AS matched_in_traversal", _BOTH, kinds=("vec",), names=("vec_ring",)))
def hybrid_stats(spark, d):
    found, hits = _hybrid(spark, d)
    return vector.hybrid_stats(found.nodes, found.edges, hits)


@query("SELECT vec_id AS id, round(list_dot_product(embedding[1:8]::DOUBLE[], [1, 0, 2, 0, 0, 3, 0, 0]::DOUBLE[]), 6) AS score FROM embeddings")
def sparse_dot(spark, d):
    v = F.map_from_entries(F.transform(F.slice("embedding", 1, 8), lambda x, i: F.struct(i.alias("k"), x.cast("double").alias("v"))))
    q = F.map_from_arrays(F.array(F.lit(0), F.lit(2), F.lit(5)), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(similarity.sparse_dot(v, q), 6).alias("score"))


_WORDS = "string_split(lower(p_name || ' ' || p_brand), ' ')"


@query(f"SELECT 'part:' || p_partkey AS id, round((list_contains({_WORDS}, 'brand#12')::INT + list_contains({_WORDS}, 'part')::INT + list_contains({_WORDS}, 'nothing')::INT) / 3.0::DOUBLE, 6) AS keyword_score FROM part")
def keyword_score(spark, d):
    """The share of three words that a part's label or alias, its brand, has."""
    e = entities(spark, d, "part").withColumn("aliases", F.array("p_brand"))
    return vector.keyword_scores(e, "Part nothing BRAND#12").select("id", F.round("keyword_score", 6).alias("keyword_score"))


@query(_hybrid_sql("0.5::DOUBLE * coalesce(s, 0) + 0.5::DOUBLE * (n.id = 'vec:5')::INT"))
def hybrid_keyword(spark, d):
    """Weighted fusion in which a text scores the keyword part."""
    found, hits = _hybrid(spark, d)
    e = entities(spark, d, "vec").withColumn("aliases", F.array("id"))
    return vector.hybrid(found.nodes, hits, 10, "weighted", keywords=vector.keyword_scores(e, "vec:5")).select("id", F.round("fused", 6).alias("score"))


# Inference

_PLACE_KINDS, _PLACE_RELS = ("region", "nation", "customer"), ("nation_region", "customer_nation")
_PART_OF = "SELECT 'customer:' || c_custkey AS source_id, 'part_of' AS type, 'region:' || n_regionkey AS target_id, 0.8::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _derived(spark, d, **options):
    return inf.infer(entities(spark, d, *_PLACE_KINDS), relations(spark, d, *_PLACE_RELS), inf.built_in(), **options)


@query(with_graph("SELECT id, true AS matched_pattern FROM E WHERE p_size > 45", ("part",)))
def pattern_filter(spark, d):
    e = entities(spark, d, "part")
    return e.where(all_of(e, [Filter("properties.size", "gt", 45)])).select("id", F.lit(True).alias("matched_pattern"))


@query(_PART_OF)
def infer_part_of(spark, d):
    return _derived(spark, d, rule_ids=["part-of-transitive"]).select("source_id", "type", "target_id", "confidence")


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT 'vec:' || vec_id AS source_id, 'vec:' || (7 * ((7 * vec_id + 1) % n) + 1) % n AS target_id FROM embeddings, n EXCEPT SELECT 'vec:' || vec_id, 'vec:' || (7 * vec_id + 1) % n FROM embeddings, n")
def infer_transitive_pass1(spark, d):
    return inf.infer(entities(spark, d, "vec"), relations(spark, d, "vec_ring"), inf.built_in(), max_iterations=1, rule_ids=["transitive-closure"]).select("source_id", "target_id")


@query(
    """
WITH RECURSIVE r AS (SELECT p_partkey AS s, p_partkey // 7 AS t FROM part WHERE p_partkey // 7 > 0),
c AS (SELECT s, t FROM r UNION SELECT c.s, r.t FROM c JOIN r ON c.t = r.s)
SELECT 'part:' || s AS source_id, 'part:' || t AS target_id FROM c EXCEPT SELECT 'part:' || s, 'part:' || t FROM r
"""
)
def infer_transitive_fixpoint(spark, d):
    """All parts as a tree in which a part belongs to that of a seventh of its key; the closure has all ancestors."""
    to = F.expr("p_partkey div 7")
    tree = read(spark, d, "part").where(to > 0).select(F.concat(F.lit("t"), "p_partkey").alias("id"), F.concat(F.lit("part:"), "p_partkey").alias("source_id"), F.concat(F.lit("part:"), to).alias("target_id"), F.lit("related_to").alias("type"))
    return inf.infer(entities(spark, d, "part"), tree, inf.built_in(), rule_ids=["transitive-closure"]).select("source_id", "target_id")


@query("SELECT 'a' AS rule_id, round(0.9 * 0.95 * 0.95, 6)::DOUBLE AS confidence, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def infer_confidence(spark, d):
    p = inf.Pattern((inf.Node("a", constraints=(Filter("properties.acctbal", "gt", 5000.0), Filter("properties.mktsegment", "eq", "BUILDING"))), inf.Node("b")), (inf.Edge("a", "part_of", "b"),))
    out = inf.infer(entities(spark, d, *_PLACE_KINDS), relations(spark, d, *_PLACE_RELS), [inf.Rule("a", p, "b", "serves", "a", 0.9)])
    return out.groupBy("rule_id").agg(F.round(F.max("confidence"), 6).alias("confidence"), F.count("*").alias("n"))


@query(
    """
SELECT g.s, 'part:' || p_partkey AS t FROM part JOIN (SELECT p_brand AS b, min('part:' || p_partkey) AS s FROM part GROUP BY 1) g ON p_brand = g.b
WHERE g.s < 'part:' || p_partkey
"""
)
def infer_same_as(spark, d):
    """Parts with their brand as an alias: each is tied to the least of its brand."""
    e = entities(spark, d, "part").withColumn("aliases", F.array("p_brand"))
    return inf.infer(e, relations(spark, d, "nation_region"), inf.built_in(), rule_ids=["same-as-alias"]).select(F.col("source_id").alias("s"), F.col("target_id").alias("t"))


@query(
    """
SELECT a.id AS s, b.id AS t FROM (SELECT 'supplier:' || s_suppkey AS id, s_nationkey AS n FROM supplier) a
JOIN (SELECT 'supplier:' || s_suppkey AS id, s_nationkey AS n FROM supplier) b ON a.n = b.n AND a.id < b.id
"""
)
def infer_same_as_pairs(spark, d):
    """Suppliers with their nation as an alias: all pairs, as the rule asks for."""
    e = entities(spark, d, "supplier").join(read(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("n")), "id")
    e = e.withColumn("aliases", F.array("n")).drop("n")
    rule = replace(inf.built_in()[2], options={"alias_pairs": True})
    return inf.infer(e, relations(spark, d, "nation_region"), [rule]).select(F.col("source_id").alias("s"), F.col("target_id").alias("t"))


@query("SELECT 'part_of' AS type, (SELECT count(*) FROM nation) + 2 * count(*) AS n, round((SELECT count(*) FROM nation) + 1.8::DOUBLE * count(*), 4) AS weight FROM customer")
def infer_apply(spark, d):
    derived = inf.as_relations(_derived(spark, d, rule_ids=["part-of-transitive"]))
    out = mutate.add_relations(entities(spark, d, *_PLACE_KINDS), relations(spark, d, *_PLACE_RELS), derived)
    return out.groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    """
SELECT 'part-of-transitive' AS rule_id, 'part_of' AS type, 'customer:7>nation:' || c_nationkey || '>region:' || n_regionkey AS derivation_path,
  0.8::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7
"""
)
def infer_explain(spark, d):
    derived = inf.as_relations(_derived(spark, d, rule_ids=["part-of-transitive"]))
    all_relations = mutate.add_relations(entities(spark, d, *_PLACE_KINDS), relations(spark, d, *_PLACE_RELS), derived)
    return inf.explain(all_relations, "customer:7")


@query(
    """
WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT 'transitive-closure' AS rule_id, count(*) AS count FROM (
  SELECT vec_id, (7 * ((7 * vec_id + 1) % n) + 1) % n FROM embeddings, n EXCEPT SELECT vec_id, (7 * vec_id + 1) % n FROM embeddings, n)
UNION ALL SELECT 'same-as-alias', (SELECT count(*) FROM part) - (SELECT count(DISTINCT p_brand) FROM part)
UNION ALL SELECT 'part-of-transitive', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
)
def infer_applied_rules(spark, d):
    """One pass of all three rules over the whole graph, in which parts have their brand as an alias."""
    e = entities(spark, d).withColumn("aliases", F.when(F.col("p_brand").isNotNull(), F.array("p_brand")).otherwise(F.array().cast("array<string>")))
    return inf.applied(inf.infer(e, relations(spark, d), inf.built_in(), max_iterations=1), inf.built_in())


# Clocks and the op log


def _ops(spark, d, concurrent: bool = True, target: str = "concat('user:', user_id)") -> DataFrame:
    """The events as operations on users. Clocks: the node's own count, or with concurrent=False the counts of all nodes so far."""
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.expr(target).alias("target_id"), F.concat(F.lit("n"), F.col("event_id") % 3).alias("node_id"), "event_type", "props", "value")
    kind = F.when(F.col("event_type") == "signup", "entity_add").when(F.col("event_type") == "error", "entity_delete").otherwise("entity_update")
    # event_id counts from the least, and nodes take turns: a node's count follows from the id alone.
    count = lambda n: F.floor((F.col("seq") + 3 - n) / 3).cast("long")
    own = F.floor(F.col("seq") / 3).cast("long") + 1
    clock = F.create_map("node_id", own) if concurrent else F.create_map(*[x for n in range(3) for x in (F.lit(f"n{n}"), count(n))])
    k = F.get_json_object("props", "$.k")
    patches = F.when(kind == "entity_update", F.array(F.struct(F.lit("replace").alias("op"), F.lit("/properties/k").alias("path"), k.alias("value"))))
    return e.select(
        "seq",
        "target_id",
        "node_id",
        kind.alias("type"),
        clock.alias("clock"),
        (F.col("seq") % 11 != 0).alias("causally_ready"),
        F.when(kind == "entity_add", F.create_map(F.lit("k"), k)).alias("payload"),
        patches.cast(oplog.PATCH).alias("patches"),
        F.when(kind == "entity_delete", oplog.tombstone(F.col("target_id"), F.col("node_id"), F.col("seq"))).alias("tombstone"),
        F.struct(k.alias("k")).alias("value"),
    )


_PAIRS = "(SELECT event_id AS id, event_id % 4 AS a0, event_id % 3 AS a1, event_id % 5 AS b0, event_id % 2 AS b1 FROM events)"


def _pairs(spark, d) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_id").alias("id"))
    clock = lambda x, y: F.map_filter(F.create_map(F.lit("n0"), x, F.lit("n1"), y), lambda _, v: v > 0)
    return e.select("id", clock(F.col("id") % 4, F.col("id") % 3).alias("a"), clock(F.col("id") % 5, F.col("id") % 2).alias("b"))


_CMP = "CASE WHEN (a0 > b0 OR a1 > b1) AND (b0 > a0 OR b1 > a1) THEN NULL WHEN a0 > b0 OR a1 > b1 THEN 1 WHEN b0 > a0 OR b1 > a1 THEN -1 ELSE 0 END"


@query(f"SELECT id, {_CMP} AS cmp FROM {_PAIRS}")
def clock_compare(spark, d):
    return _pairs(spark, d).select("id", clocks.compare("a", "b").alias("cmp"))


@query(f"SELECT id, coalesce({_CMP} = -1, false) AS before FROM {_PAIRS}")
def clock_happens_before(spark, d):
    return _pairs(spark, d).select("id", clocks.happens_before("a", "b").alias("before"))


@query(f"SELECT id, greatest(a0, b0)::BIGINT AS n0, greatest(a1, b1)::BIGINT AS n1 FROM {_PAIRS}")
def clock_merge(spark, d):
    get = lambda n: F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0)).cast("long").alias(n)
    return _pairs(spark, d).select("id", clocks.merge("a", "b").alias("m")).select("id", get("n0"), get("n1"))


@query(f"SELECT id, a0 + (id % 2 = 0)::INT AS n0, a1 + (id % 2 = 1)::INT AS n1 FROM {_PAIRS}")
def clock_increment(spark, d):
    get = lambda n: F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0)).cast("long").alias(n)
    return _pairs(spark, d).select("id", clocks.increment("a", F.concat(F.lit("n"), F.col("id") % 2)).alias("m")).select("id", get("n0"), get("n1"))


_LATEST = "SELECT 'user:' || user_id AS target_id, bool_or(event_type = 'error') AS deleted, arg_max(props->>'k', floor(event_id / 3) * 1000 + event_id % 3) FILTER (event_type <> 'error') AS k, count(*) AS n_ops FROM events GROUP BY 1"


@query(_LATEST)
def crdt_fold_latest(spark, d):
    return oplog.latest(_ops(spark, d)).select("target_id", "deleted", F.col("value.k").alias("k"), "n_ops")


@query("SELECT DISTINCT 'user:' || user_id AS target_id FROM events WHERE event_type = 'error'")
def crdt_deleted(spark, d):
    return oplog.fold(_ops(spark, d, False)).where("deleted").select("target_id")


# With all clocks in order every operation is newer than the last, so only the order of arrival matters: an add always
# counts, an update between the first add and the first deletion.
def _folded_sql(target: str, select: str) -> str:
    return f"""
WITH b AS (SELECT {target} AS t, min(event_id) FILTER (event_type = 'signup') AS born, min(event_id) FILTER (event_type = 'error') AS dead FROM events GROUP BY 1),
o AS (SELECT t, born, dead, event_id AS i, event_type AS e, props->>'k' AS k,
  event_type = 'signup' OR event_type <> 'error' AND event_id > born AND (dead IS NULL OR event_id < dead) AS sets FROM events JOIN b ON b.t = {target}),
s AS (SELECT t AS target_id, any_value(born) IS NOT NULL AS present, any_value(dead) IS NOT NULL AS deleted, arg_max(k, i) FILTER (sets) AS k,
  count(*) FILTER (sets OR e = 'error') AS n_applied FROM o GROUP BY t)
{select}"""


_SESSION = "user_id || '@' || strftime(ts, '%Y-%m-%d %H')"


@query(_folded_sql(_SESSION, "SELECT target_id, k FROM s WHERE present AND NOT deleted"))
def crdt_active(spark, d):
    """Hours of users as targets, so that some live to the end of the log."""
    ops = _ops(spark, d, False, "concat(user_id, '@', date_format(ts, 'yyyy-MM-dd HH'))")
    return oplog.active(oplog.fold(ops)).select("target_id", F.col("props")["k"].alias("k"))


@query("SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN NULL ELSE props->>'k' END AS k, 'on' AS flag FROM events")
def crdt_patch(spark, d):
    e = read(spark, d, "events").select("event_id", F.create_map(F.lit("k"), F.lit("old")).alias("p"), F.get_json_object("props", "$.k").alias("k"))
    op = lambda o, path, v: F.struct(o.alias("op"), F.lit(path).alias("path"), v.alias("value"))
    patches = F.array(op(F.when(F.col("event_id") % 2 == 0, "remove").otherwise("replace"), "/properties/k", F.col("k")), op(F.lit("add"), "/flag", F.lit("on")), op(F.lit("add"), "/too/deep/path", F.lit("x")), op(F.lit("move"), "/flag", F.lit("y"))).cast(oplog.PATCH)
    m = oplog.patched(F.col("p"), patches)
    return e.select(F.col("event_id").alias("seq"), m.alias("m")).select("seq", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("flag")).alias("flag"))


@query(_folded_sql("'user:' || user_id", "SELECT target_id, present, deleted, n_applied, k FROM s"))
def crdt_stream(spark, d):
    """The fold as a stream over the whole log, read from files; the last state of each target, from what the stream wrote."""
    folder = _folder(spark)
    messages = streaming.as_messages(_ops(spark, d, False))
    messages.write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(messages.schema).parquet(f"{folder}/log")
    streaming.written(streaming.fold_stream(stream), folder).awaitTermination()
    return streaming.last_states(spark, folder).select("target_id", "present", "deleted", "n_applied", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id AS msg_id, 'user:' || user_id AS target_id FROM events WHERE event_id % 11 <> 0")
def gossip_dedup(spark, d):
    ops = _ops(spark, d).select(F.col("seq").alias("msg_id"), "target_id", "causally_ready")
    return oplog.deliverable(ops.unionByName(ops.where("msg_id % 4 = 0"))).select("msg_id", "target_id")


_FANOUT = """
WITH p AS (SELECT 'peer' || i AS peer_id, ('0x' || substr(md5('peer' || i), 1, 15))::BIGINT % 1024 AS bucket FROM range(7) t(i)),
n AS (SELECT peer_id, row_number() OVER (ORDER BY bucket, peer_id) - 1 AS number FROM p),
h AS (SELECT event_id AS m, ('0x' || substr(md5(event_id || ':0:3'), 1, 15))::BIGINT % 5 AS a, ('0x' || substr(md5(event_id || ':0:2'), 1, 15))::BIGINT % 6 AS b,
  ('0x' || substr(md5(event_id || ':0:1'), 1, 15))::BIGINT % 7 AS c FROM events),
g AS (SELECT m, a, CASE WHEN b = a THEN 5 ELSE b END AS b, c FROM h),
f AS (SELECT m, a, b, CASE WHEN c IN (a, b) THEN 6 ELSE c END AS c FROM g)
SELECT m AS msg_id, peer_id FROM (SELECT m, unnest([a, b, c]) AS number FROM f) JOIN n USING (number)
"""


@query(_FANOUT)
def gossip_fanout(spark, d):
    peers = spark.createDataFrame([(f"peer{i}",) for i in range(7)], "peer_id string")
    return oplog.fanout(_ops(spark, d).select(F.col("seq").alias("msg_id")), peers, 3)


_UNSEEN = "e.event_id // 3 + 1 > CASE e.event_id % 3 WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END"
_PEERS = "(SELECT 'a' AS peer_id, 100 AS n0, 50 AS n1, 0 AS n2 UNION ALL SELECT 'b', 5, 0, 700 UNION ALL SELECT 'c', 1000000, 1000000, 1000000)"


def _peers(spark):
    known = [("a", {"n0": 100, "n1": 50}), ("b", {"n0": 5, "n2": 700}), ("c", {"n0": 1000000, "n1": 1000000, "n2": 1000000})]
    return oplog.register(None, spark.createDataFrame(known, "peer_id string, clock map<string,bigint>"))


@query(f"SELECT p.peer_id, e.event_id AS seq FROM events e, {_PEERS} p WHERE {_UNSEEN}")
def ops_for_peer(spark, d):
    return oplog.ops_for_peer(_ops(spark, d), _peers(spark)).select("peer_id", "seq")


@query(f"SELECT p.peer_id, 'idle' AS status, 1 AS priority, count(e.event_id) AS pending, count(e.event_id) = 0 AS in_sync FROM {_PEERS} p LEFT JOIN events e ON {_UNSEEN} GROUP BY 1")
def sync_status(spark, d):
    return oplog.sync_status(_peers(spark), _ops(spark, d))


@query("SELECT 's' || s_suppkey AS peer_id, CASE WHEN s_acctbal > 0 THEN 2 ELSE 1 END AS priority, 5000 AS interval_ms, CASE WHEN s_nationkey % 2 = 0 THEN 4 ELSE 0 END::BIGINT AS n0 FROM supplier WHERE s_nationkey <> 3")
def peer_registry(spark, d):
    """Suppliers as peers: registered with defaults, some again with a clock and all with a priority, those of one nation removed."""
    s = read(spark, d, "supplier").withColumn("peer_id", F.concat(F.lit("s"), "s_suppkey"))
    peers = oplog.register(None, s.where("s_nationkey % 2 = 0").select("peer_id", F.create_map(F.lit("n0"), F.lit(4).cast("long")).alias("clock")))
    peers = oplog.register(peers, s.select("peer_id", F.when(F.col("s_acctbal") > 0, 2).otherwise(1).alias("priority")))
    peers = oplog.without_peers(peers, s.where("s_nationkey = 3"))
    return peers.select("peer_id", "priority", "interval_ms", F.coalesce(F.try_element_at("clock", F.lit("n0")), F.lit(0)).cast("long").alias("n0"))


@query("SELECT p.peer_id, greatest(n0, 300)::BIGINT AS n0, greatest(n1, 0)::BIGINT AS n1, greatest(n2, 20)::BIGINT AS n2 FROM (SELECT 'a' AS peer_id, 100 AS n0, 50 AS n1, 0 AS n2 UNION ALL SELECT 'b', 5, 0, 700 UNION ALL SELECT 'c', 1000000, 1000000, 1000000) p")
def peers_advanced(spark, d):
    peers = _peers(spark)
    seen = peers.select("peer_id", F.create_map(F.lit("n0"), F.lit(300).cast("long"), F.lit("n2"), F.lit(20).cast("long")).alias("clock"))
    get = lambda n: F.coalesce(F.try_element_at("clock", F.lit(n)), F.lit(0)).cast("long").alias(n)
    return oplog.advance(peers, seen).select("peer_id", *map(get, ("n0", "n1", "n2")))


@query("SELECT event_id AS seq, event_id % 3 < 2 OR event_id % 11 <> 0 AS kept FROM events WHERE event_id % 3 < 2 OR event_id % 11 <> 0")
def remote_ops(spark, d):
    """A replica that has the operations of two nodes gets all nodes', twice, and takes what is new and causally ready."""
    ops = _ops(spark, d)
    log = oplog.received(ops.where("node_id <> 'n2'"), ops.unionByName(ops))
    return log.select("seq", F.lit(True).alias("kept"))


@query("SELECT max(event_id // 3 + 1) FILTER (event_id % 3 = 0) AS n0, max(event_id // 3 + 1) FILTER (event_id % 3 = 1) AS n1, max(event_id // 3 + 1) FILTER (event_id % 3 = 2) AS n2 FROM events")
def replica_clock(spark, d):
    return oplog.clock_of(_ops(spark, d)).select(*[F.col("clock")[n].alias(n) for n in ("n0", "n1", "n2")])


@query(f"SELECT peer_id, n FROM (SELECT p.peer_id, count(*) AS n FROM events e, {_PEERS} p WHERE {_UNSEEN} GROUP BY 1)")
def gossip_round(spark, d):
    """A round that reaches all three peers: how many operations it sends to each."""
    return oplog.gossip_round(_ops(spark, d), _peers(spark), 3).groupBy("peer_id").agg(F.count("*").alias("n"))


@query(
    """
SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'entity_add' WHEN 'error' THEN 'relation_delete' ELSE 'entity_update' END AS type,
  'user:' || user_id AS target_id, CASE WHEN event_type = 'error' THEN event_id + 2592000000 END AS gc_after, CASE WHEN event_type = 'signup' THEN props->>'k' END AS k FROM events
"""
)
def op_constructors(spark, d):
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    clock, target, seq = F.create_map(F.lit("n0"), F.col("event_id")), F.concat(F.lit("user:"), "user_id"), F.col("event_id")
    make = lambda rows, kind, **more: rows.select(*oplog.operation(kind, seq, target, F.lit("n0"), clock, now=seq, **more))
    adds = make(e.where("event_type = 'signup'"), "entity_add", payload=F.create_map(F.lit("k"), F.col("k")))
    gone = make(e.where("event_type = 'error'"), "relation_delete")
    rest = make(e.where("event_type not in ('signup', 'error')"), "entity_update", patches=F.array(F.struct(F.lit("replace").alias("op"), F.lit("/k").alias("path"), F.col("k").alias("value"))))
    return adds.unionByName(gone).unionByName(rest).select("seq", "type", "target_id", F.col("tombstone.gc_after").alias("gc_after"), F.col("payload")["k"].alias("k"))


@query(
    """
SELECT target_id, seq, expected FROM (SELECT 'user:' || user_id AS target_id, event_id AS seq, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM events)
WHERE expected IS NOT NULL AND event_type = 'error' AND expected <> seq - 1
"""
)
def version_gaps(spark, d):
    """Each operation names the one before it on its target; those of errors name the log's last one, so most leave a gap."""
    ops = _ops(spark, d).withColumn("new_version", F.col("seq"))
    before = F.lag("seq").over(Window.partitionBy("target_id").orderBy("seq"))
    ops = ops.withColumn("prior_version", F.when(F.col("type") == "entity_delete", F.col("seq") - 1).otherwise(before))
    return oplog.version_gaps(ops).select("target_id", "seq", "expected")


@query("SELECT 'user:' || user_id AS id, event_id + 2592000000 AS gc_after FROM events WHERE event_type = 'error' AND event_id > 500")
def tombstone_gc(spark, d):
    stones = _ops(spark, d).where("tombstone is not null").select("tombstone.*")
    return oplog.collected(stones, F.lit(500 + oplog.RETENTION_MS)).select("id", "gc_after")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    out = streaming.tumbling(read(spark, d, "events"), "ts", "1 hour", "1 hour", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events) GROUP BY 1, 2")
def events_sliding(spark, d):
    out = streaming.sliding(read(spark, d, "events"), "ts", "2 hours", "1 hour", "1 hour", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    """
WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 97 MINUTE AS new FROM events),
s AS (SELECT user_id, ts, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS nth FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 97 MINUTE AS end, user_id, count(*) AS n FROM s GROUP BY user_id, nth
"""
)
def events_sessions(spark, d):
    out = streaming.sessions(read(spark, d, "events"), "ts", "97 minutes", "1 hour", "user_id")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


# Conflicts and merges


@query("""WITH o AS (SELECT event_id, user_id, event_id % 3 AS node, [CASE event_id % 2 WHEN 0 THEN '/properties/a' ELSE '/properties/b' END, CASE event_id % 5 WHEN 0 THEN '/label' ELSE '/properties/c' END] AS p FROM events WHERE event_type = 'purchase')
SELECT 'user:' || x.user_id AS target_id, x.event_id AS op_a, y.event_id AS op_b, list_filter(x.p, lambda v: list_contains(y.p, v))[1] AS path FROM o x JOIN o y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.node <> y.node AND len(list_intersect(x.p, y.p)) > 0""")
def detect_conflicts(spark, d):
    e = read(spark, d, "events").where("event_type = 'purchase'")
    i = F.col("event_id")
    paths = F.array(F.when(i % 2 == 0, "/properties/a").otherwise("/properties/b"), F.when(i % 5 == 0, "/label").otherwise("/properties/c"))
    ops = e.select(i.alias("op_id"), F.concat(F.lit("user:"), "user_id").alias("target_id"), F.create_map(F.concat(F.lit("n"), i % 3), F.floor(i / 3) + 1).alias("clock"), paths.alias("paths"))
    return merge.detect(ops)


def _versions(spark, d) -> DataFrame:
    """Two versions of each event's value, with the clocks of clock_compare."""
    p = _pairs(spark, d)
    side = lambda s, c, n: [F.concat(F.lit(f"{s}-"), "id").alias(f"{s}_value"), F.col(c).alias(f"{s}_clock"), n.alias(f"{s}_node")]
    path = F.when(F.col("id") % 3 == 0, "/properties/x").when(F.col("id") % 3 == 1, "/properties/y").otherwise("/properties/z")
    return p.select("id", path.alias("path"), *side("local", "a", F.concat(F.lit("n"), F.col("id") % 7)), *side("remote", "b", F.concat(F.lit("n"), F.col("id") % 6)))


_LWW = f"CASE WHEN {_CMP} = 1 THEN 'local' WHEN {_CMP} = -1 THEN 'remote' WHEN id % 7 > id % 6 THEN 'local' ELSE 'remote' END"
_FWW = f"CASE WHEN {_CMP} = 1 THEN 'remote' ELSE 'local' END"
_PRIO = f"CASE WHEN (id % 7 = 1)::INT > (id % 6 = 1)::INT THEN 'local' WHEN (id % 6 = 1)::INT > (id % 7 = 1)::INT THEN 'remote' ELSE {_LWW} END"


@query(f"SELECT id, {_LWW} AS winner FROM {_PAIRS}")
def merge_lww(spark, d):
    return _versions(spark, d).select("id", merge.last_write_wins().alias("winner"))


@query(f"SELECT id, {_FWW} AS winner FROM {_PAIRS}")
def merge_fww(spark, d):
    return _versions(spark, d).select("id", merge.first_write_wins().alias("winner"))


@query("SELECT event_id AS id, 'local-' || event_id || '@n' || event_id % 7 || '|remote-' || event_id || '@n' || event_id % 6 AS both FROM events")
def merge_multi_value(spark, d):
    both = F.transform(merge.multi_value(), lambda v: F.concat(v["value"], F.lit("@"), v["source"]))
    return _versions(spark, d).select("id", F.array_join(both, "|").alias("both"))


@query(f"SELECT id, {_PRIO} AS winner FROM {_PAIRS}")
def merge_priority(spark, d):
    return merge.resolve(_versions(spark, d), "source_priority", priorities={"n1": 1}).select("id", "winner")


_STRATEGY = "CASE id % 3 WHEN 0 THEN 'first_write_wins' WHEN 1 THEN 'multi_value' ELSE 'last_write_wins' END"
_RESOLVED = f"CASE id % 3 WHEN 0 THEN {_FWW} || '-' || id WHEN 1 THEN 'local-' || id || ',remote-' || id ELSE {_LWW} || '-' || id END"


@query(f"SELECT id, {_STRATEGY} AS strategy, {_RESOLVED} AS value FROM {_PAIRS}")
def resolve_conflicts(spark, d):
    return merge.resolve(_versions(spark, d), "last_write_wins", {"x": "first_write_wins", "y": "multi_value"}).select("id", "strategy", "value")


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 'kept' ELSE {_LWW} || '-' || id END AS value, true AS resolved FROM {_PAIRS}")
def auto_resolve(spark, d):
    v = _versions(spark, d).withColumns({"resolved": F.col("id") % 4 == 0, "value": F.when(F.col("id") % 4 == 0, "kept")})
    return merge.auto_resolve(v).select("id", "value", "resolved")


def _replicas(spark, d):
    e = entities(spark, d, "customer")
    k = F.split("id", ":")[1].cast("long")
    extra = F.create_map(F.lit("remote_only"), F.lit("yes"), F.lit("mktsegment"), F.lit("REMOTE"))
    local = e.where(k % 3 != 0).withColumns({"version": 1 + k % 2, "updated_at": k % 7})
    remote = e.where(k % 3 != 1).withColumns({"version": 1 + k % 5 % 2, "updated_at": k % 5, "properties": mutate.merged("properties", extra)})
    return local, remote


_REPLICA = """(SELECT c_custkey AS k, c_mktsegment AS seg, 'customer:' || c_custkey AS id, c_custkey % 3 <> 0 AS l, c_custkey % 3 <> 1 AS r, 1 + c_custkey % 2 AS lv, 1 + c_custkey % 5 % 2 AS rv FROM customer)"""


@query(f"SELECT id, CASE WHEN l AND r AND lv = rv THEN lv + 1 WHEN l AND (NOT r OR lv > rv) THEN lv ELSE rv END::BIGINT AS version, CASE WHEN r AND (NOT l OR rv >= lv) THEN 'yes' END AS remote_only, CASE WHEN l AND (NOT r OR lv >= rv) THEN seg ELSE 'REMOTE' END AS segment FROM {_REPLICA}")
def merge_graphs_entities(spark, d):
    local, remote = _replicas(spark, d)
    p = lambda k: F.try_element_at("properties", F.lit(k))
    return merge.merge_entities(local, remote).select("id", "version", p("remote_only").alias("remote_only"), p("mktsegment").alias("segment"))


@query("SELECT 'cn:' || c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN c_custkey % 7 WHEN c_custkey % 3 = 0 THEN c_custkey % 5 ELSE greatest(c_custkey % 7, c_custkey % 5) END AS updated_at, CASE WHEN c_custkey % 3 = 1 OR (c_custkey % 3 = 2 AND c_custkey % 7 > c_custkey % 5) THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM customer")
def merge_graphs_relations(spark, d):
    r = relations(spark, d, "customer_nation")
    k = F.split("id", ":")[1].cast("long")
    return merge.merge_relations(r.where(k % 3 != 0).withColumn("updated_at", k % 7), r.where(k % 3 != 1).withColumns({"updated_at": k % 5, "weight": F.lit(0.5)})).select("id", "updated_at", "weight")


_CELLS = "(SELECT p_partkey AS k, p_size AS b, p_size + p_partkey % 2 AS l, p_size + 2 * (p_partkey % 3 = 0)::INT AS r FROM part)"


def _three(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("value"))
    return merge.three_way(p, p.withColumn("value", F.col("value") + F.col("key") % 2), p.withColumn("value", F.col("value") + 2 * (F.col("key") % 3 == 0).cast("long")))


@query(f"SELECT k AS key, CASE WHEN l = r THEN l WHEN l = b THEN r ELSE l END::BIGINT AS value FROM {_CELLS}")
def three_way_merge(spark, d):
    return _three(spark, d).select("key", "value")


@query(f"SELECT k AS key FROM {_CELLS} WHERE l <> r AND l <> b AND r <> b")
def three_way_conflicts(spark, d):
    return _three(spark, d).where("conflict").select("key")


@query("SELECT id FROM (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0 UNION SELECT 'customer:' || c_custkey FROM customer WHERE c_custkey % 3 <> 1)")
def union_ids(spark, d):
    local, remote = _replicas(spark, d)
    return local.select("id").union(remote.select("id")).distinct()


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey % 3 = 2")
def intersect_ids(spark, d):
    local, remote = _replicas(spark, d)
    return local.select("id").intersect(remote.select("id"))


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_custkey % 3 = 1")
def except_ids(spark, d):
    local, remote = _replicas(spark, d)
    return local.select("id").exceptAll(remote.select("id"))


# Scalars


@query("SELECT 'part:' || p_partkey AS id, CASE WHEN length(p_name) > 15 THEN substr(p_name, 1, 15) || '...' ELSE p_name END AS label FROM part")
def label_truncate(spark, d):
    return entities(spark, d, "part").select("id", layout.short_label(F.col("label")).alias("label"))


@query("SELECT event_id AS id, (props->>'k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT 'order:' || o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def created_iso(spark, d):
    return entities(spark, d, "order").select("id", F.date_format("p_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


# Layout: of the nations and regions, a graph that fits a screen

_LAY_KINDS, _LAY_RELS = ("region", "nation"), ("nation_region",)
_CIRCLE = f"C AS (SELECT id, seq, 400 + 200 * cos(2 * pi() * (row_number() OVER (ORDER BY seq) - 1) / count(*) OVER ()) AS x, 300 + 200 * sin(2 * pi() * (row_number() OVER (ORDER BY seq) - 1) / count(*) OVER ()) AS y FROM E)"
_REPEL = "P AS (SELECT a.id AS s, b.id AS t, b.x - a.x AS dx, b.y - a.y AS dy FROM C a JOIN C b ON a.id < b.id), D AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 1.0 ELSE sqrt(dx * dx + dy * dy) END AS d FROM P), F1 AS (SELECT id, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT s AS id, -dx / d * 5000 / (d * d) AS fx, -dy / d * 5000 / (d * d) AS fy FROM D UNION ALL SELECT t, dx / d * 5000 / (d * d), dy / d * 5000 / (d * d) FROM D) GROUP BY id)"
_PULL = "F2 AS (SELECT id, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT R.source_id AS id, (b.x - a.x) * 0.01 AS fx, (b.y - a.y) * 0.01 AS fy FROM R JOIN C a ON R.source_id = a.id JOIN C b ON R.target_id = b.id UNION ALL SELECT R.target_id, (a.x - b.x) * 0.01, (a.y - b.y) * 0.01 FROM R JOIN C a ON R.source_id = a.id JOIN C b ON R.target_id = b.id) GROUP BY id)"


def _lay(select: str, *ctes: str) -> str:
    return with_graph(", " + ", ".join([_CIRCLE, *ctes]) + " " + select, _LAY_KINDS, _LAY_RELS)


def _circle(spark, d):
    return layout.circle(entities(spark, d, *_LAY_KINDS), 800, 600)


def _xy(df: DataFrame, *names: str) -> DataFrame:
    return df.select("id", *[F.round(n, 4).alias(n) for n in names])


@query(_lay("SELECT id, round(x, 4) AS x, round(y, 4) AS y FROM C"))
def layout_circle(spark, d):
    return _xy(_circle(spark, d), "x", "y")


@query(_lay("SELECT id, round(fx, 4) AS fx, round(fy, 4) AS fy FROM F1", _REPEL))
def layout_repulsion(spark, d):
    return _xy(layout.repulsion(_circle(spark, d)), "fx", "fy")


@query(_lay("SELECT id, round(fx, 4) AS fx, round(fy, 4) AS fy FROM F2", _PULL))
def layout_attraction(spark, d):
    return _xy(layout.attraction(_circle(spark, d), relations(spark, d, *_LAY_RELS)), "fx", "fy")


@query(_lay("SELECT C.id, round(least(greatest(x + (coalesce(F1.fx, 0) + coalesce(F2.fx, 0)) * 0.9, 50), 750), 4) AS x, round(least(greatest(y + (coalesce(F1.fy, 0) + coalesce(F2.fy, 0)) * 0.9, 50), 550), 4) AS y FROM C LEFT JOIN F1 USING (id) LEFT JOIN F2 USING (id)", _REPEL, _PULL))
def layout_step(spark, d):
    return _xy(layout.step(_circle(spark, d), relations(spark, d, *_LAY_RELS), 800, 600), "x", "y")


@query()
def layout_run(spark, d):
    return _xy(layout.run(entities(spark, d, *_LAY_KINDS), relations(spark, d, *_LAY_RELS)), "x", "y")


@query(_lay("SELECT round(min(x) - 50, 4) AS min_x, round(max(x) + 50, 4) AS max_x, round(min(y) - 50, 4) AS min_y, round(max(y) + 50, 4) AS max_y, round(least(800 / (max(x) - min(x) + 100), 600 / (max(y) - min(y) + 100), 2), 4) AS scale FROM C"))
def layout_bbox(spark, d):
    return layout.bounds(_circle(spark, d), 800, 600).select(*[F.round(c, 4).alias(c) for c in ("min_x", "max_x", "min_y", "max_y", "scale")])


@query(_lay("SELECT id FROM C WHERE sqrt((x - 600) * (x - 600) + (y - 310) * (y - 310)) <= 20 + least(2 * (SELECT count(*) FROM R WHERE R.source_id = C.id OR R.target_id = C.id), 15) + 5 ORDER BY seq LIMIT 1"))
def layout_hit(spark, d):
    e = entities(spark, d, *_LAY_KINDS)
    at = _circle(spark, d).join(traverse.degree(e, relations(spark, d, *_LAY_RELS)), "id").join(e.select("id", "seq"), "id")
    return layout.hit(at.withColumn("radius", layout.radius(F.col("degree"))), 600, 310).select("id")
