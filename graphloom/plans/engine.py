"""One object for a graph: declarative queries compiled to lazy frames, changes, inference, merging."""

from __future__ import annotations

import json
import threading
import uuid
from collections import OrderedDict
from collections.abc import Mapping, Sequence
from copy import deepcopy
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.predicates import Filter, not_deleted, search, where
from graphloom.operators import aggregate, inference, merge, mutate, oplog, traverse, vector
from graphloom.sources import store
from graphloom.sources.tables import PropertyGraph

DEFAULTS: dict[str, Any] = {
    "node_id": "node-1",
    "query": {"default_limit": 100, "max_limit": 10_000, "cache": True, "cache_size": 1000, "timeout_ms": None},
    "inference": {"max_iterations": 10, "threshold": 0.5},
    "storage": {"type": "memory", "path": None},
}


def deep_merged(base: Mapping, over: Mapping) -> dict:
    out = deepcopy(dict(base))
    for k, v in over.items():
        out[k] = deep_merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def as_filters(specs: Sequence[Filter | Mapping] | None) -> list[Filter]:
    return [s if isinstance(s, Filter) else Filter(s["field"], s["operator"], s.get("value")) for s in specs or ()]


#: Consistency levels of a query. All read one graph version, so each is met by a snapshot; the level is told in the result.
LEVELS = ("strong", "eventual", "bounded", "read_my_writes")


@dataclass
class Result:
    """Frames of a query, none of them computed yet; count(), totals() and rows() compute.

    whole has the frames before paging, by the name of the total that counts them.
    """

    type: str
    frames: dict[str, DataFrame]
    options: dict = field(default_factory=dict)
    whole: dict[str, DataFrame] = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    @property
    def data(self) -> DataFrame:
        return next(iter(self.frames.values()))

    def count(self) -> int:
        return self.data.count()

    def totals(self) -> dict[str, int]:
        """How many there are before paging: hits, and for a traversal nodes, edges and paths."""
        return {k: df.count() for k, df in self.whole.items()}

    def rows(self, timeout_ms: int | None = None) -> list:
        """The rows of the first frame; a query that takes longer than timeout_ms is cancelled, and TimeoutError raised."""
        timeout_ms = self.options.get("timeout_ms") if timeout_ms is None else timeout_ms
        if timeout_ms is None:
            return self.data.collect()
        sc, tag, late = self.data.sparkSession.sparkContext, f"query-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout_ms / 1000, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            return self.data.collect()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"query took longer than {timeout_ms} ms") from e
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def explain(self) -> None:
        self.data.explain("formatted")


#: Frames of a result, and those before paging.
Frames = tuple[dict[str, DataFrame], dict[str, DataFrame]]


class GraphEngine:
    """Every change makes a new graph version, which is part of the key of cached results."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph, config: Mapping | None = None):
        self.spark, self.graph = spark, graph
        self.config = deep_merged(DEFAULTS, config or {})
        self.rules = list(self.config["inference"].get("rules") or inference.built_in())
        self.store = store.open_store(spark, self.config["storage"]["type"], self.config["storage"]["path"])
        self._cache: OrderedDict[tuple, Result] = OrderedDict()
        self.hits = 0
        self.listeners: dict[str, list] = {}
        self.log: DataFrame | None = None
        self.peers: DataFrame | None = None
        self.runs: list[DataFrame] = []

    # Lookups and changes

    def get(self, entity_id: str) -> DataFrame:
        return self.graph.entities.where(F.col("id") == entity_id)

    def by_type(self, type_: str) -> DataFrame:
        return self.graph.entities.where((F.col("type") == type_) & not_deleted())

    def by_tag(self, tag: str) -> DataFrame:
        return self.graph.entities.where(F.array_contains("tags", tag) & not_deleted())

    def search(self, text: str) -> DataFrame:
        return self.graph.entities.where(search(text))

    def relations_of(self, entity_id: str) -> DataFrame:
        return self.graph.relations.where((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id))

    def on(self, event: str, listener) -> None:
        self.listeners.setdefault(event, []).append(listener)

    def _changed(self, event: str, rows: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None) -> None:
        self.graph = self.graph.replaced(entities, relations)
        for f in self.listeners.get(event, ()):
            f(rows)

    def add_entities(self, new: DataFrame, now: Column | None = None) -> None:
        self._changed("entity:add", new, mutate.add_entities(self.graph.entities, new, now))

    def update_entities(self, updates: DataFrame, now: Column | None = None) -> None:
        self._changed("entity:update", updates, mutate.update_entities(self.graph.entities, updates, now))

    def delete_entities(self, ids: DataFrame, now: Column | None = None) -> None:
        now = F.unix_millis(F.current_timestamp()) if now is None else now
        self._changed("entity:delete", ids, mutate.soft_delete(self.graph.entities, ids, now))

    def add_relations(self, new: DataFrame, now: Column | None = None) -> None:
        self._changed("relation:add", new, None, mutate.add_relations(self.graph.entities, self.graph.relations, new, now))

    def update_relations(self, updates: DataFrame, now: Column | None = None) -> None:
        self._changed("relation:update", updates, None, mutate.update_relations(self.graph.relations, updates, now))

    def delete_relations(self, ids: DataFrame) -> None:
        self._changed("relation:delete", ids, None, mutate.delete_relations(self.graph.relations, ids))

    # Queries

    def query(self, spec: Mapping) -> Result:
        """spec: type (traversal, vector, hybrid, pattern, aggregation), its part, filters, options.

        Filters select from the result of traversal, vector and hybrid queries, and from the input of the others.
        Options: limit, offset, include_deleted, explain (does not read the cache), timeout_ms, consistency.
        """
        options = dict(spec.get("options") or {})
        level = options.get("consistency", "strong")
        if level not in LEVELS:
            raise ValueError(f"unknown consistency level: {level}")
        options.setdefault("timeout_ms", self.config["query"]["timeout_ms"])
        key = (self.graph.version, json.dumps({k: v for k, v in spec.items() if k != "id"}, sort_keys=True, default=repr))
        cached = self.config["query"]["cache"]
        if cached and key in self._cache and not options.get("explain"):
            self.hits += 1
            return self._cache[key]
        kinds = {"traversal": self._traversal, "vector": self._vector, "hybrid": self._hybrid, "pattern": self._pattern, "aggregation": self._aggregation}
        if spec.get("type") not in kinds:
            raise ValueError(f"unknown query type: {spec.get('type')}")
        frames, whole = kinds[spec["type"]](spec, options)
        result = Result(spec["type"], frames, options, whole, {"graph_version": self.graph.version, "consistency": level})
        if cached:
            self._cache[key] = result
            while len(self._cache) > self.config["query"]["cache_size"]:
                self._cache.popitem(last=False)
        return result

    def clear_cache(self) -> None:
        self._cache.clear()

    def cache_stats(self) -> dict[str, int]:
        return {"size": len(self._cache), "max_size": self.config["query"]["cache_size"], "hits": self.hits}

    def _entities(self, options: Mapping) -> DataFrame:
        return self.graph.entities if options.get("include_deleted") else self.graph.entities.where(not_deleted())

    def _limit(self, options: Mapping, default: int) -> int:
        limit = options.get("limit")
        return min(default if limit is None else limit, self.config["query"]["max_limit"])

    def _walk(self, t: Mapping, options: Mapping) -> traverse.Traversal:
        return traverse.traverse(
            self._entities(options),
            self.graph.relations,
            t["start_ids"],
            t.get("max_depth", 3),
            t.get("directions", ("outbound",)),
            t.get("relation_types"),
            as_filters(t.get("node_filters")),
            as_filters(t.get("edge_filters")),
        )

    def _result_filter(self, rows: DataFrame, spec: Mapping) -> DataFrame:
        filters = as_filters(spec.get("filters"))
        return rows.join(where(self.graph.entities, filters).select("id"), "id", "left_semi") if filters else rows

    def _traversal(self, spec: Mapping, options: Mapping) -> Frames:
        found = self._walk(spec["traversal"], options)
        limit, offset = self._limit(options, self.config["query"]["default_limit"]), options.get("offset", 0)
        kept = self._result_filter(found.nodes, spec)
        nodes = traverse.page(kept, ["depth", "pos"], limit, offset)
        if spec["traversal"].get("include_properties"):
            nodes = nodes.join(self.graph.entities, "id")
        frames = {"nodes": nodes, "edges": traverse.page(found.edges, ["id", "direction"], limit, offset), "paths": traverse.page(found.paths, ["depth", "pos"], limit, offset)}
        whole = {"nodes": kept, "edges": found.edges, "paths": found.paths}
        shape = spec["traversal"].get("path_format")
        if shape == "tree":
            return {"tree": found.tree()} | frames, whole
        return ({"nodes": nodes} if shape == "list" else frames), whole

    def _vector(self, spec: Mapping, options: Mapping) -> Frames:
        v = spec["vector"]
        rows = vector.scored(self._entities(options), v["embedding"], v.get("metric", "cosine"), v.get("threshold"), as_filters(v.get("filters")))
        return {"hits": self._result_filter(vector.top_k(rows, v.get("k", 10)), spec), "candidates": rows}, {"hits": rows}

    def _hybrid(self, spec: Mapping, options: Mapping) -> Frames:
        """Of the traversal the first node_limit nodes (hybrid part of the spec) are fused; with a text, the weighted method's keyword part scores it."""
        found, v, h = self._walk(spec["traversal"], options), spec["vector"], spec.get("hybrid") or {}
        entities = self._entities(options)
        if h.get("prefilter"):
            entities = entities.join(found.nodes.select("id"), "id", "left_semi")
        rows = vector.scored(entities, v["embedding"], v.get("metric", "cosine"), v.get("threshold"), as_filters(v.get("filters")))
        hits = vector.top_k(rows, v.get("k", 10))
        weights = vector.Weights(h.get("vector_weight", 0.5), h.get("keyword_weight", 0.5))
        keywords = vector.keyword_scores(entities, h["text"]) if h.get("text") else None
        kept = self._result_filter(found.nodes, spec)
        fused = vector.hybrid(kept, hits, self._limit(options, 10), h.get("fusion", "rrf"), h.get("rrf_k", 60), weights, h.get("node_limit", vector.NODE_LIMIT), keywords)
        return {"hits": fused, "stats": vector.hybrid_stats(found.nodes, found.edges, hits)}, {"hits": kept}

    def _pattern(self, spec: Mapping, options: Mapping) -> Frames:
        rows = where(self._entities(options), as_filters(spec.get("filters")))
        if isinstance(spec.get("pattern"), inference.Pattern):
            out = inference.matches(rows, self.graph.relations, spec["pattern"], bool(options.get("first_per_anchor")), most_crossed=options.get("most_crossed", 0))
        else:
            out = rows.withColumn("matched_pattern", F.lit(True))
        return {"matches": out}, {"hits": out}

    def _aggregation(self, spec: Mapping, options: Mapping) -> Frames:
        a = spec["aggregation"]
        parts = [x if isinstance(x, aggregate.Aggregation) else aggregate.Aggregation(x["name"], x["type"], x["field"], x.get("options", {})) for x in a["aggregations"]]
        rows = where(self._entities(options), as_filters(spec.get("filters")))
        histograms = {x.name: aggregate.histogram(rows, x.field, x.options.get("interval", 10)) for x in parts if x.type == "histogram"}
        scalar = [x for x in parts if x.type != "histogram"]
        return ({"groups": aggregate.aggregate(rows, scalar, a.get("group_by", ()))} if scalar else {}) | histograms, {"hits": rows}

    def traverse(self, start_ids: Sequence[str], max_depth: int = 3, **options) -> traverse.Traversal:
        return traverse.traverse(self._entities({}), self.graph.relations, start_ids, max_depth, **options)

    def search_by_vector(self, embedding: list[float], k: int = 10, threshold: float | None = None) -> DataFrame:
        return vector.search(self._entities({}), embedding, k, threshold=threshold)

    def hybrid_search(self, start_ids: Sequence[str], embedding: list[float], max_depth: int = 3, k: int = 10) -> DataFrame:
        return self.query({"type": "hybrid", "traversal": {"start_ids": list(start_ids), "max_depth": max_depth}, "vector": {"embedding": embedding, "k": k}}).data

    # Inference

    def add_rule(self, rule: inference.Rule) -> None:
        self.rules.append(rule)

    def remove_rule(self, rule_id: str) -> bool:
        kept = [r for r in self.rules if r.id != rule_id]
        gone, self.rules = len(kept) < len(self.rules), kept
        return gone

    def infer(self, rule_ids: Sequence[str] | None = None, max_iterations: int | None = None, threshold: float | None = None) -> DataFrame:
        """Derived relations; kept for inference_stats."""
        c = self.config["inference"]
        out = inference.infer(self._entities({}), self.graph.relations, self.rules, c["max_iterations"] if max_iterations is None else max_iterations, c["threshold"] if threshold is None else threshold, rule_ids)
        self.runs.append(out)
        return out

    def explain(self, source_id: str, target_id: str | None = None) -> DataFrame:
        """Rules and derivations of the graph's derived relations from one entity to another, or to any."""
        return inference.explain(self.graph.relations, source_id, target_id)

    def apply(self, derived: DataFrame) -> int:
        """Adds derived relations; returns how many."""
        before = self.graph.relations
        self.add_relations(inference.as_relations(derived))
        return self.graph.relations.count() - before.count()

    def inference_stats(self) -> dict[str, Any]:
        """The rules, how often inference ran, and how many relations each rule derived in the last run."""
        last = {r.rule_id: r["count"] for r in inference.applied(self.runs[-1], self.rules).collect()} if self.runs else {}
        return {"rules": len(self.rules), "ids": [r.id for r in self.rules], "runs": len(self.runs), "derived": last}

    # Storage, merging, status

    def save(self, name: str) -> None:
        self.store.save(name, self.graph)

    def load(self, name: str) -> None:
        self.graph = self.store.load(name)

    def export(self) -> tuple[DataFrame, DataFrame]:
        return store.as_json(self.graph.entities), store.as_json(self.graph.relations)

    def import_json(self, entities: DataFrame, relations: DataFrame, replace: bool = False) -> None:
        """Lines as export makes; merged into the graph, or in its place."""
        e, r = store.of_json(entities, self.graph.entities), store.of_json(relations, self.graph.relations)
        if replace:
            self.graph = self.graph.replaced(e, r)
        else:
            self.merge(PropertyGraph(e, r))

    def merge(self, other: PropertyGraph) -> None:
        self.graph = self.graph.replaced(merge.merge_entities(self.graph.entities, other.entities), merge.merge_relations(self.graph.relations, other.relations))

    # Replication

    def add_peers(self, new: DataFrame) -> None:
        self.peers = oplog.register(self.peers, new)

    def remove_peers(self, gone: DataFrame) -> None:
        self.peers = None if self.peers is None else oplog.without_peers(self.peers, gone)

    def receive(self, ops: DataFrame) -> DataFrame:
        """Takes operations into the log, each once, and gives the state of every target after all of them."""
        self.log = oplog.received(ops.limit(0), ops) if self.log is None else oplog.received(self.log, ops)
        return oplog.fold(self.log)

    def sync(self, seen: DataFrame | None = None) -> DataFrame:
        """What each peer lacks of the log; with seen (peer_id, clock) peers' clocks are advanced first."""
        if self.log is None or self.peers is None:
            raise ValueError("nothing to sync: no operations or no peers")
        if seen is not None:
            self.peers = oplog.advance(self.peers, seen)
        return oplog.ops_for_peer(self.log, self.peers)

    def federation_status(self) -> dict[str, Any]:
        """This node, and frames of its clock and of its peers' state."""
        known = self.log is not None
        return {
            "node_id": self.config["node_id"],
            "clock": oplog.clock_of(self.log) if known else None,
            "peers": oplog.sync_status(self.peers, self.log) if known and self.peers is not None else self.peers,
        }

    def stats(self) -> dict[str, DataFrame]:
        return {"entities": aggregate.stats(self.graph.entities), "relations": aggregate.stats(self.graph.relations)}
