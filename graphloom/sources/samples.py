"""Small graphs to try things on: a workshop's team, and a library's subjects as a hierarchy."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.operators import mutate

from .tables import PropertyGraph

_TEAM = (
    [("mira", "person", "Mira", {"role": "lead"}), ("otto", "person", "Otto", {"role": "builder"}), ("pia", "person", "Pia", {"role": "tester"}), ("kiln", "project", "Kiln", {"status": "active"})]
    + [("loom", "project", "Loom", {"status": "planned"}), ("shop", "organization", "Workshop", {}), ("glaze", "concept", "Glazing", {}), ("weave", "concept", "Weaving", {})],
    [("mira", "shop", "works_at"), ("otto", "shop", "works_at"), ("pia", "shop", "works_at"), ("mira", "kiln", "leads"), ("otto", "kiln", "works_on"), ("pia", "loom", "works_on")]
    + [("kiln", "shop", "part_of"), ("loom", "shop", "part_of"), ("kiln", "glaze", "related_to"), ("loom", "weave", "related_to"), ("glaze", "weave", "related_to"), ("otto", "pia", "knows")],
)
_SUBJECTS = (
    [(s, "concept", s.title(), {}) for s in ("knowledge", "science", "physics", "optics", "lasers", "biology", "botany", "mosses", "arts", "music", "song")],
    [(a, b, "part_of") for a, b in (("science", "knowledge"), ("physics", "science"), ("optics", "physics"), ("lasers", "optics"), ("biology", "science"), ("botany", "biology"), ("mosses", "botany"), ("arts", "knowledge"), ("music", "arts"), ("song", "music"))]
    + [("optics", "botany", "related_to"), ("song", "lasers", "related_to")],
)
SAMPLES = {"team": _TEAM, "subjects": _SUBJECTS}


def sample(spark: SparkSession, name: str = "team") -> PropertyGraph:
    if name not in SAMPLES:
        raise ValueError(f"unknown sample: {name}; there are {sorted(SAMPLES)}")
    nodes, edges = SAMPLES[name]
    rows = spark.createDataFrame([(i, t, label, props, n) for n, (i, t, label, props) in enumerate(nodes)], "id string, type string, label string, properties map<string,string>, seq long")
    empty = spark.createDataFrame([], "id string, type string, label string, properties map<string,string>, embedding array<double>, tags array<string>, aliases array<string>, version long, confidence double, created_at long, updated_at long, deleted_at long, seq long")
    links = spark.createDataFrame([(f"{a}-{t}-{b}", a, b, t, n) for n, (a, b, t) in enumerate(edges)], "id string, source_id string, target_id string, type string, seq long")
    none = spark.createDataFrame([], "id string, source_id string, target_id string, type string, weight double, properties map<string,string>, bidirectional boolean, confidence double, created_at long, updated_at long, seq long")
    entities = mutate.add_entities(empty, rows)
    return PropertyGraph(entities, mutate.add_relations(entities, none, links, F.lit(0).cast("long")))
