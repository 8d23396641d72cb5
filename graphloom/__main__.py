"""Command line: one command on a stored graph, its result printed as a table.

python -m graphloom --store FOLDER --name NAME COMMAND ...
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import sortable_id
from graphloom.operators.traverse import page
from graphloom.plans.engine import GraphEngine
from graphloom.sources import samples, store
from graphloom.sources.tables import PropertyGraph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("graphloom", description="A property graph in a folder.")
    p.add_argument("--store", required=True, help="folder of stored graphs")
    p.add_argument("--name", default="graph")
    p.add_argument("--rows", type=int, default=100, help="rows to print at most")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("demo", help="store a sample graph").add_argument("sample", nargs="?", default="team", choices=sorted(samples.SAMPLES))
    c.add_parser("tables", help="store the star tables of a folder as a graph").add_argument("folder")
    for name, text in (("stats", "counts by type"), ("list", "entities"), ("relations", "relations"), ("infer", "derive relations and store them")):
        c.add_parser(name, help=text)
    add = c.add_parser("add", help="add an entity")
    add.add_argument("type")
    add.add_argument("label")
    add.add_argument("properties", nargs="?", default="{}", help="JSON")
    rel = c.add_parser("addrel", help="add a relation")
    for a in ("source", "type", "target"):
        rel.add_argument(a)
    for name in ("get", "delete"):
        c.add_parser(name, help=f"{name} an entity").add_argument("id")
    c.add_parser("search", help="entities whose label or type has a text").add_argument("text")
    walk = c.add_parser("traverse", help="what can be reached from an entity")
    walk.add_argument("id")
    walk.add_argument("depth", nargs="?", type=int, default=3)
    out = c.add_parser("export", help="write the graph to a folder")
    out.add_argument("format", choices=["json", "csv", "graphml", "rdf"])
    out.add_argument("folder")
    return p


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    kept = store.open_store(spark, "parquet", args.store)
    show = lambda df: print(df.toPandas().to_string(index=False) if (df := df.limit(args.rows)).take(1) else "nothing", file=out)
    if args.command in ("demo", "tables"):
        kept.save(args.name, samples.sample(spark, args.sample) if args.command == "demo" else PropertyGraph.of_tables(spark, args.folder))
        return 0
    engine = GraphEngine(spark, kept.load(args.name))
    now = F.unix_millis(F.current_timestamp())
    brief = lambda df: page(df, ["seq", "id"], args.rows).select("id", "type", "label")
    if args.command == "stats":
        for frame in engine.stats().values():
            show(frame)
    elif args.command == "list":
        show(brief(engine.graph.entities.where("deleted_at is null")))
    elif args.command == "relations":
        show(page(engine.graph.relations, ["seq", "id"], args.rows).select("id", "source_id", "type", "target_id", "weight"))
    elif args.command == "add":
        props = json.dumps({k: v if isinstance(v, str) else json.dumps(v) for k, v in json.loads(args.properties).items()})
        row = spark.range(1).select(sortable_id(now, F.lit(args.type), F.lit(args.label), F.uuid()).alias("id"), F.lit(args.type).alias("type"), F.lit(args.label).alias("label"), F.from_json(F.lit(props), "map<string,string>").alias("properties"), now.alias("seq"))
        row = spark.createDataFrame(row.collect(), row.schema)  # one row, whose id must not be drawn again
        engine.add_entities(row, now)
        kept.save(args.name, engine.graph)
        show(row.select("id"))
    elif args.command == "addrel":
        row = spark.createDataFrame([(f"{args.source}-{args.type}-{args.target}", args.source, args.target, args.type)], "id string, source_id string, target_id string, type string").withColumn("seq", now)
        engine.add_relations(row, now)
        added = not engine.graph.relations.where(F.col("id") == f"{args.source}-{args.type}-{args.target}").isEmpty()
        kept.save(args.name, engine.graph)
        print("added" if added else "no such entities", file=out)
        return 0 if added else 1
    elif args.command == "get":
        show(engine.get(args.id).select("id", "type", "label", F.to_json("properties").alias("properties"), "version"))
        show(engine.relations_of(args.id).select("id", "source_id", "type", "target_id"))
    elif args.command == "delete":
        engine.delete_entities(spark.createDataFrame([(args.id,)], "id string"), now)
        kept.save(args.name, engine.graph)
    elif args.command == "search":
        show(brief(engine.search(args.text)))
    elif args.command == "traverse":
        show(page(engine.traverse([args.id], args.depth, directions=["both"]).nodes, ["depth", "pos"], args.rows).select("id", "depth", F.array_join("path", " > ").alias("path")))
    elif args.command == "infer":
        print(engine.apply(engine.infer()), "relations derived", file=out)
        kept.save(args.name, engine.graph)
    elif args.command == "export":
        {"json": store.export_bundle, "csv": store.write_csv, "graphml": store.write_graphml, "rdf": store.write_rdf}[args.format](engine.graph, args.folder)
    return 0


if __name__ == "__main__":
    session = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    code = run(session, sys.argv[1:])
    session.stop()
    sys.exit(code)
