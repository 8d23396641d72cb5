"""Conjunctive patterns and forward chaining."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import Filter, all_of, candidates
from graphloom.sources.scratch import cut


@dataclass(frozen=True)
class Node:
    """A variable of a pattern, and what its entity must satisfy."""

    var: str
    type: str | None = None
    label: str | None = None
    constraints: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Edge:
    source: str
    type: str | None
    target: str


@dataclass(frozen=True)
class Pattern:
    """Entities of variables, tied by relations. same_alias ties two variables that have an alias in common."""

    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...] = ()
    distinct_vars: bool = False
    same_alias: tuple[str, str] | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: Pattern
    source: str
    type: str
    target: str
    confidence: float = 1.0
    options: dict = field(default_factory=dict, hash=False)


def transitive(rule_id: str, type_: str, confidence: float) -> Rule:
    a = Pattern((Node("a"), Node("b"), Node("c")), (Edge("a", type_, "b"), Edge("b", type_, "c")))
    return Rule(rule_id, a, "a", type_, "c", confidence)


def built_in() -> list[Rule]:
    """A new list of the three rules that every engine starts with."""
    alias = Pattern((Node("a"), Node("b")), same_alias=("a", "b"))
    return [transitive("transitive-closure", "related_to", 0.7), transitive("part-of-transitive", "part_of", 0.8), Rule("same-as-alias", alias, "a", "same_as", "b", 0.9)]


def confidence(rule: Rule) -> float:
    """Less by a twentieth for each constraint, within 0 and 1. A match is always a whole one."""
    n = sum(len(x.constraints) for x in rule.pattern.nodes)
    return min(1.0, max(0.0, rule.confidence * 0.95**n))


def _entities_of(entities: DataFrame, node: Node) -> DataFrame | None:
    """Ids that a variable may take, as <var>_id; None if it may take any."""
    if node.type is None and node.label is None and not node.constraints:
        return None
    rows = entities.where(candidates(entities, node.label, node.type)).where(all_of(entities, node.constraints))
    return rows.select(F.col("id").alias(f"{node.var}_id"))


#: Entities of an alias that are paired with as many others of it at a time.
BLOCK = 1024
#: Known triples that are sent to all tasks: three short strings each.
FEW_TRIPLES = 100_000


def _alias_links(entities: DataFrame, pairs: bool) -> DataFrame:
    """a, b: entities with an alias in common, a < b, each two once.

    Each entity of an alias is tied to the least one that has it: as many links as entities, and whoever shares an alias
    meets in the least one. With pairs, every pair of an alias, which for a common one is the square of its entities.
    """
    if pairs:
        return _alias_pairs(entities)
    one = entities.select("id", F.explode(F.array_distinct("aliases")).alias("alias"))
    first = one.groupBy("alias").agg(F.min("id").alias("a"))
    return first.join(one.select(F.col("id").alias("b"), "alias"), "alias").where("a < b").select("a", "b").distinct()


def _alias_pairs(entities: DataFrame) -> DataFrame:
    """All pairs of each alias, as they are met: pairs are neither shuffled nor sorted nor held.

    The entities of an alias are dealt by hash into parts of about BLOCK, and a task takes two parts at a time. Two entities that
    share several aliases are a pair at the least of these only, so there is nothing to make distinct afterwards.
    """
    all_of_id = F.filter(F.array_distinct(F.flatten(F.collect_list("aliases"))), lambda x: x.isNotNull())
    one = entities.where("id IS NOT NULL").groupBy("id").agg(all_of_id.alias("aliases")).select("id", "aliases", F.explode("aliases").alias("alias"))
    parts = one.groupBy("alias").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    one = one.join(parts, "alias").select("alias", "parts", "id", F.filter("aliases", lambda x: x < F.col("alias")).alias("lesser"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    keys = ["alias", "i", "j"]
    n = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = one.select("alias", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), F.col("id").alias("x"), F.col("lesser").alias("x_lesser"))
    right = one.select("alias", F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"), F.col("id").alias("y"), F.col("lesser").alias("y_lesser"))
    # A fixed number of partitions: few rows make very many pairs, so merging small partitions would leave one task with all.
    met = left.repartition(n, *keys).join(right.repartition(n, *keys).hint("merge"), keys)
    new = (F.size("x_lesser") == 0) | (F.size("y_lesser") == 0) | ~F.arrays_overlap("x_lesser", "y_lesser")
    return met.where(((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))) & new).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def matches(
    entities: DataFrame,
    relations: DataFrame,
    pattern: Pattern,
    first_per_anchor: bool = False,
    check_entities: bool = True,
    per_edge: Sequence[DataFrame] | None = None,
    alias_pairs: bool = False,
    most_crossed: int = 0,
) -> DataFrame:
    """A row per match, with <var>_id for each variable. Every relation joins on exactly its two variables.

    Relations are joined in an order in which each shares a variable with those before. Parts of a pattern that nothing
    links are combined only if that makes most_crossed rows at most, which is counted first; else it is an error.
    Variables that may be any entity cost no join if check_entities is off. per_edge gives each relation of
    the pattern rows of its own. For alias_pairs see _alias_links.
    """
    by_var = {n.var: n for n in pattern.nodes}
    out, bound = None, set()
    if pattern.same_alias:
        a, b = pattern.same_alias
        out = _alias_links(entities, alias_pairs).select(F.col("a").alias(f"{a}_id"), F.col("b").alias(f"{b}_id"))
        bound = {a, b}

    def crossed(left: DataFrame | None, right: DataFrame) -> DataFrame:
        if left is None:
            return right
        left, right = cut(left), cut(right)
        if left.count() * right.count() > most_crossed:
            raise ValueError("variables without a relation between them")
        return left.crossJoin(right)

    def may_be(var: str) -> DataFrame:
        rows = _entities_of(entities, by_var[var]) if var in by_var else None
        return entities.select(F.col("id").alias(f"{var}_id")) if rows is None else rows

    waiting = list(zip(pattern.edges, per_edge or [relations] * len(pattern.edges), strict=True))
    while waiting:
        linked = next((e for e in waiting if not bound or {e[0].source, e[0].target} & bound), None)
        edge, rows = linked or waiting[0]
        waiting.remove(linked or waiting[0])
        rows = rows if edge.type is None else rows.where(F.col("type") == edge.type)
        s, t = f"{edge.source}_id", f"{edge.target}_id"
        if edge.source == edge.target:
            rows = rows.where("source_id = target_id").select(F.col("source_id").alias(s))
        else:
            rows = rows.select(F.col("source_id").alias(s), F.col("target_id").alias(t))
        for var in {edge.source, edge.target} - bound:
            if check_entities or var in by_var and _entities_of(entities, by_var[var]) is not None:
                rows = rows.join(may_be(var), f"{var}_id", "left_semi")
        out = rows if out is None else out.join(rows, [f"{v}_id" for v in {edge.source, edge.target} & bound]) if linked else crossed(out, rows)
        bound |= {edge.source, edge.target}
    for node in pattern.nodes:
        if node.var not in bound:
            out = crossed(out, may_be(node.var))
            bound.add(node.var)
    names = [f"{n.var}_id" for n in pattern.nodes]
    out = out.select(*names)
    if pattern.distinct_vars:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                out = out.where(F.col(a) != F.col(b))
    if first_per_anchor:
        rest = F.min(F.struct(*names[1:])) if names[1:] else F.lit(None)
        out = out.groupBy(names[0]).agg(rest.alias("_rest")).select(names[0], *[F.col(f"_rest.{n}").alias(n) for n in names[1:]])
    return out


TRIPLE = ["source_id", "type", "target_id"]


def _derive(entities: DataFrame, relations: DataFrame, rule: Rule, place: int, per_edge: Sequence[DataFrame] | None = None) -> DataFrame:
    found = matches(entities, relations, rule.pattern, per_edge=per_edge, alias_pairs=bool(rule.options.get("alias_pairs")), most_crossed=rule.options.get("most_crossed", 0))
    names = [F.col(f"{n.var}_id") for n in rule.pattern.nodes]
    return found.select(
        F.col(f"{rule.source}_id").alias("source_id"),
        F.lit(rule.type).alias("type"),
        F.col(f"{rule.target}_id").alias("target_id"),
        F.struct(F.lit(place).alias("place"), F.array(*names).alias("entities")).alias("how"),
        F.lit(rule.id).alias("rule_id"),
        F.lit(confidence(rule)).alias("confidence"),
    )


def _once_per_triple(rule: Rule) -> bool:
    """Whether no two matches of a rule derive one triple: its two variables are those tied by an alias."""
    p = rule.pattern
    return bool(p.same_alias) and not p.edges and {n.var for n in p.nodes} == set(p.same_alias) == {rule.source, rule.target}


def infer(entities: DataFrame, relations: DataFrame, rules: Sequence[Rule], max_iterations: int = 10, threshold: float = 0.5, rule_ids: Sequence[str] | None = None) -> DataFrame:
    """Derived relations: source_id, type, target_id, confidence, rule_id, derivation, iteration.

    A triple that exists is not derived; of several derivations the first rule's, then the least match, counts.
    Each iteration matches against all that is known; after the first, only matches that need a triple of the last
    iteration can be new, so a rule is matched once for each relation of its pattern, with that one taken from the
    last iteration's triples. Ends when nothing is new, or after max_iterations. Rules without relations in their patterns
    need one iteration, and if there are no others its triples, which nothing reads again, are not written but left lazy.
    """
    chosen = [(i, r) for i, r in enumerate(rules) if (rule_ids is None or r.id in rule_ids) and confidence(r) >= threshold]
    spark = entities.sparkSession
    empty = "source_id string, type string, target_id string, confidence double, rule_id string, derivation struct<place:int,entities:array<string>>, iteration int"
    if not chosen:
        return spark.createDataFrame([], empty)
    types = [r.type for _, r in chosen]
    again = any(r.pattern.edges for _, r in chosen)
    known = cut((relations if again else relations.where(F.col("type").isin(types))).select(*TRIPLE).distinct())
    derived, delta = None, known
    for iteration in range(1, max_iterations + 1):
        out, single = None, None
        for place, rule in chosen:
            for rows in _new_matches(entities, known, delta, rule, place, iteration):
                if _once_per_triple(rule) and types.count(rule.type) == 1:
                    single = rows if single is None else single.unionByName(rows)
                else:
                    out = rows if out is None else out.unionByName(rows)
        if out is None and single is None:
            break
        told = lambda df: df.select(*TRIPLE, F.col("b.confidence").alias("confidence"), F.col("b.rule_id").alias("rule_id"), F.col("b.how").alias("derivation"), F.lit(iteration).alias("iteration"))  # noqa: B023, E731
        fresh = None
        if out is not None:
            fresh = told(out.groupBy(*TRIPLE).agg(F.min(F.struct("how", "rule_id", "confidence")).alias("b")).join(known, TRIPLE, "left_anti"))
        if single is not None:
            single = told(_unknown(single, known, types).select(*TRIPLE, F.struct("how", "rule_id", "confidence").alias("b")))
            fresh = single if fresh is None else fresh.unionByName(single)
        if not again:
            return fresh
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        derived = fresh if derived is None else derived.unionByName(fresh)
        delta = fresh.select(*TRIPLE)
        known = known.unionByName(delta)
    return spark.createDataFrame([], empty) if derived is None else derived


def _unknown(rows: DataFrame, known: DataFrame, types: Sequence[str]) -> DataFrame:
    """Rows whose triple is not known. Where few triples of their types are known, which is counted, rows stay where they are."""
    met = known.where(F.col("type").isin(types))
    n = met.count()
    return rows.join(F.broadcast(met) if n <= FEW_TRIPLES else met, TRIPLE, "left_anti") if n else rows


def _new_matches(entities: DataFrame, known: DataFrame, delta: DataFrame, rule: Rule, place: int, iteration: int) -> list[DataFrame]:
    if iteration == 1:
        return [_derive(entities, known, rule, place)]
    edges = range(len(rule.pattern.edges))
    return [_derive(entities, known, rule, place, [delta if j == i else known for j in edges]) for i in edges]


def applied(derived: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule_id, count of derived relations; rules that derived none have 0."""
    spark = derived.sparkSession
    names = spark.createDataFrame([(r.id,) for r in rules], "rule_id string")
    return names.join(derived.groupBy("rule_id").agg(F.count("*").alias("count")), "rule_id", "left").select("rule_id", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def as_relations(derived: DataFrame, now: Column | None = None) -> DataFrame:
    """Derived relations as relations: weight is the confidence, and the properties tell how they came about."""
    now = F.lit(0).cast("long") if now is None else now
    path = F.array_join("derivation.entities", ">")
    return derived.select(
        F.concat_ws(":", F.lit("inf"), "source_id", "type", "target_id").alias("id"),
        "source_id",
        "target_id",
        "type",
        F.col("confidence").alias("weight"),
        F.create_map(F.lit("inferredBy"), F.col("rule_id"), F.lit("confidence"), F.col("confidence").cast("string"), F.lit("derivationPath"), path).alias("properties"),
        F.lit(False).alias("bidirectional"),
        "confidence",
        now.alias("created_at"),
        now.alias("updated_at"),
        F.abs(F.xxhash64("source_id", "type", "target_id")).alias("seq"),
    )


def explain(relations: DataFrame, source_id: str, target_id: str | None = None) -> DataFrame:
    """Steps behind the derived relations from one entity to another, or to any."""
    to = F.lit(True) if target_id is None else F.col("target_id") == target_id
    rows = relations.where((F.col("source_id") == source_id) & to & F.col("properties")["inferredBy"].isNotNull())
    return rows.select(F.col("properties")["inferredBy"].alias("rule_id"), F.col("properties")["derivationPath"].alias("derivation_path"), "type", F.col("weight").alias("confidence"))
