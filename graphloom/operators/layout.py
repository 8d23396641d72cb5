"""The numbers of a drawing: circular and force-directed layouts, bounds, hit tests. For graphs that fit a screen."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import cut

#: Constants of the forces, the damping, and the margin.
REPULSION, ATTRACTION, DAMPING, MARGIN = 5000.0, 0.01, 0.9, 50.0
#: Nodes that all repel each other; more don't fit a screen. Of at most SMALL nodes a run of many steps is one row's work.
MOST, SMALL = 5000, 300


def circle(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """id, x, y: nodes in order of seq on a circle of a third of the smaller side."""
    i = F.row_number().over(Window.orderBy("seq", "id")) - 1
    n = F.count("*").over(Window.partitionBy())
    angle, r = 2 * math.pi * i / n, min(width, height) / 3
    return nodes.select("id", (width / 2 + r * F.cos(angle)).alias("x"), (height / 2 + r * F.sin(angle)).alias("y"))


def fits(nodes: DataFrame, most: int = MOST) -> None:
    if nodes.limit(most + 1).count() > most:
        raise ValueError(f"a layout takes {most} nodes at most: choose those to draw first, as by a traversal")


def repulsion(at: DataFrame) -> DataFrame:
    """id, fx, fy of all pairs' repulsion, REPULSION / distance ** 2; a distance of 0 counts as 1. For MOST nodes at most."""
    fits(at)
    a, b = at.alias("a"), at.alias("b")
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    pairs = a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("s"), F.col("b.id").alias("t"), dx.alias("dx"), dy.alias("dy"))
    d = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    d = F.when(d == 0, 1.0).otherwise(d)
    pairs = pairs.withColumn("d", d).withColumn("f", F.lit(REPULSION) / (F.col("d") * F.col("d")))
    fx, fy = F.col("dx") / F.col("d") * F.col("f"), F.col("dy") / F.col("d") * F.col("f")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("s").alias("id"), (-fx).alias("fx"), (-fy).alias("fy")), F.struct(F.col("t").alias("id"), fx.alias("fx"), fy.alias("fy")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def attraction(at: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fx, fy of the relations' pull, ATTRACTION * distance."""
    s, t = at.select(F.col("id").alias("source_id"), F.col("x").alias("sx"), F.col("y").alias("sy")), at.select(F.col("id").alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    rows = edges.select("source_id", "target_id").join(s, "source_id").join(t, "target_id")
    fx, fy = (F.col("tx") - F.col("sx")) * ATTRACTION, (F.col("ty") - F.col("sy")) * ATTRACTION
    ends = rows.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), fx.alias("fx"), fy.alias("fy")), F.struct(F.col("target_id").alias("id"), (-fx).alias("fx"), (-fy).alias("fy")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def step(at: DataFrame, edges: DataFrame, width: float, height: float, keep_speed: bool = False) -> DataFrame:
    """at (id, x, y and, with keep_speed, vx, vy) after one step of both forces, kept within the margins."""
    r = repulsion(at).select("id", F.col("fx").alias("rx"), F.col("fy").alias("ry"))
    p = attraction(at, edges).select("id", F.col("fx").alias("ax"), F.col("fy").alias("ay"))
    zero = F.lit(0.0)
    rows = at.join(r, "id", "left").join(p, "id", "left")
    v = {c: ((F.col(f"v{c}") if keep_speed else zero) + F.coalesce(f"r{c}", zero) + F.coalesce(f"a{c}", zero)) * DAMPING for c in "xy"}
    inside = lambda c, size: F.least(F.greatest(c, F.lit(MARGIN)), F.lit(size - MARGIN))
    return rows.select("id", inside(F.col("x") + v["x"], width).alias("x"), inside(F.col("y") + v["y"], height).alias("y"), *([v["x"].alias("vx"), v["y"].alias("vy")] if keep_speed else []))


def run(nodes: DataFrame, edges: DataFrame, width: float = 800, height: float = 600, iterations: int = 100) -> DataFrame:
    """id, x, y, vx, vy after so many steps of both forces from the circle, with velocities that go on from step to step.

    Of SMALL nodes at most all positions are one row's array, and all steps one expression over it; of more, each step is a job.
    """
    fits(nodes)
    at = circle(nodes, width, height).withColumns({"vx": F.lit(0.0), "vy": F.lit(0.0)})
    at, edges = cut(at.join(nodes.select("id", "seq"), "id")), cut(edges.select("source_id", "target_id"))
    if at.count() <= SMALL:
        return _run_small(at, edges, width, height, iterations)
    at = at.drop("seq")
    for _ in range(iterations):  # a step reads `at` several times, so a plan of two steps would square
        at = cut(step(at, edges, width, height, keep_speed=True))
    return at


def _run_small(at: DataFrame, edges: DataFrame, width: float, height: float, iterations: int) -> DataFrame:
    numbered = at.withColumn("n", F.row_number().over(Window.orderBy("seq", "id")) - 1)  # SMALL rows at most
    body = "struct<x:double,y:double,vx:double,vy:double>"
    start = numbered.agg(F.array_sort(F.collect_list(F.struct("n", "id", "x", "y", "vx", "vy"))).alias("rows"))
    names = numbered.select("id", "n")
    ends = edges.join(names.select(F.col("id").alias("source_id"), F.col("n").alias("s")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("n").alias("t")), "target_id")
    ends = ends.agg(F.collect_list(F.struct("s", "t")).alias("ends"))
    pair = "struct<x:double,y:double>"
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).cast(pair)

    def push(me: F.Column, i: F.Column, state: F.Column) -> F.Column:
        def one(acc: F.Column, j: F.Column) -> F.Column:
            dx, dy = F.get(state, j)["x"] - me["x"], F.get(state, j)["y"] - me["y"]
            d2 = dx * dx + dy * dy
            d2 = F.when(d2 == 0, 1.0).otherwise(d2)
            f = F.lit(REPULSION) / (d2 * F.sqrt(d2))
            return F.when(i == j, acc).otherwise(F.struct((acc["x"] - dx * f).alias("x"), (acc["y"] - dy * f).alias("y"))).cast(pair)

        return F.aggregate(F.sequence(F.lit(0), F.size(state) - 1), zero, one)

    def pull(me: F.Column, i: F.Column, state: F.Column, links: F.Column) -> F.Column:
        def one(acc: F.Column, e: F.Column) -> F.Column:
            other = F.get(state, F.when(e["s"] == i, e["t"]).otherwise(e["s"]))
            x, y = acc["x"] + (other["x"] - me["x"]) * ATTRACTION, acc["y"] + (other["y"] - me["y"]) * ATTRACTION
            return F.when((e["s"] == i) | (e["t"] == i), F.struct(x.alias("x"), y.alias("y"))).otherwise(acc).cast(pair)

        return F.aggregate(links, zero, one)

    inside = lambda c, size: F.least(F.greatest(c, F.lit(MARGIN)), F.lit(size - MARGIN))

    def moved(me: F.Column, r: F.Column, p: F.Column) -> F.Column:
        vx, vy = (me["vx"] + r["x"] + p["x"]) * DAMPING, (me["vy"] + r["y"] + p["y"]) * DAMPING
        return F.struct(inside(me["x"] + vx, width).alias("x"), inside(me["y"] + vy, height).alias("y"), vx.alias("vx"), vy.alias("vy")).cast(body)

    def advance(state: F.Column, _: F.Column) -> F.Column:
        forces = F.transform(state, lambda me, i: F.struct(me.alias("me"), push(me, i, state).alias("r"), pull(me, i, state, F.col("ends")).alias("p")))
        return F.transform(forces, lambda f: moved(f["me"], f["r"], f["p"]))

    first = F.transform("rows", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["vx"].alias("vx"), r["vy"].alias("vy")).cast(body))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), first, advance) if iterations else first
    both = start.crossJoin(ends)  # single rows
    return both.select(F.explode(F.arrays_zip(F.transform("rows", lambda r: r["id"]).alias("id"), end.alias("at"))).alias("z")).select("z.id", "z.at.*")


def bounds(at: DataFrame, width: float, height: float) -> DataFrame:
    """The drawing's bounds with the margin, and the scale, 2 at most, that fits them to the view."""
    b = at.agg((F.min("x") - MARGIN).alias("min_x"), (F.max("x") + MARGIN).alias("max_x"), (F.min("y") - MARGIN).alias("min_y"), (F.max("y") + MARGIN).alias("max_y"))
    return b.withColumn("scale", F.least(F.lit(width) / (F.col("max_x") - F.col("min_x")), F.lit(height) / (F.col("max_y") - F.col("min_y")), F.lit(2.0)))


def radius(degree: F.Column) -> F.Column:
    return 20 + F.least(2 * degree, F.lit(15))


def hit(at: DataFrame, x: float, y: float) -> DataFrame:
    """The first node, by seq, within its radius and 5 of a point. at: id, x, y, radius, seq."""
    d = F.sqrt(F.pow(F.col("x") - x, F.lit(2)) + F.pow(F.col("y") - y, F.lit(2)))
    return at.where(d <= F.col("radius") + 5).orderBy("seq").limit(1)


def short_label(label: F.Column) -> F.Column:
    return F.when(F.length(label) > 15, F.concat(F.substring(label, 1, 15), F.lit("..."))).otherwise(label)
