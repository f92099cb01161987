"""Strongly connected components, the condensation, and closeness sums of directed weighted graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.graph import Graph
from farness.operators.traverse import least_sums, shortest_paths
from farness.scratch import Scratch


def _trimmed(edges: DataFrame, scratch: Scratch, rounds: int = 2) -> DataFrame:
    """Edges between vertices that have ways in and out; what is cut off are components of one vertex."""
    for _ in range(rounds):
        both = edges.select(F.col("src").alias("v")).intersect(edges.select(F.col("dst").alias("v")))
        edges = scratch.cut(edges.join(both.withColumnRenamed("v", "src"), "src", "left_semi").join(both.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"))
    return edges


def _spread(values: DataFrame, arcs: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, color): the greatest id that reaches v along arcs; only colors that rose go on."""
    state = scratch.cut(values.withColumn("rose", F.lit(True)))
    while not (live := state.where("rose")).isEmpty():
        onward = live.join(arcs, live["v"] == arcs["src"]).select(F.col("dst").alias("v"), "color", F.lit(None).cast("long").alias("old"))
        merged = state.select("v", "color", F.col("color").alias("old")).unionByName(onward).groupBy("v").agg(F.max("color").alias("color"), F.max("old").alias("old"))
        state = scratch.cut(merged.select("v", "color", (F.col("color") > F.col("old")).alias("rose")))
    return state.select("v", "color")


def strong_components(graph: Graph, scratch: Scratch) -> DataFrame:
    """(id, comp) for every vertex of a canonical directed graph; comp is the least id of the component.

    In each round colors (the greatest id that reaches a vertex) split the graph; what reaches a color's own vertex within the
    color is its component. Vertices without ways in or out are cut off first.
    """
    edges = _trimmed(scratch.cut(graph.edges.select("src", "dst")), scratch)
    found = None
    while not edges.isEmpty():
        vertices = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
        colors = scratch.cut(_spread(vertices.select("v", F.col("v").alias("color")), edges, scratch))
        inside = edges.join(colors.select(F.col("v").alias("src"), F.col("color").alias("cs")), "src").join(colors.select(F.col("v").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd")
        inside = scratch.cut(inside.select("src", "dst", F.col("cs").alias("color")))
        reached = scratch.cut(colors.where("v = color"))
        frontier = reached
        while not frontier.isEmpty():
            back = frontier.join(inside.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("color").alias("c")), "v").where("c = color").select(F.col("u").alias("v"), "color").distinct()
            frontier = scratch.cut(back.join(reached, ["v", "color"], "left_anti"))
            reached = scratch.cut(reached.unionByName(frontier))
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select("v")
        edges = _trimmed(inside.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst"), scratch)
    if found is None:
        return graph.vertices.select("id", F.col("id").alias("comp"))
    names = found.groupBy("color").agg(F.min("v").alias("comp"))
    named = scratch.cut(found.join(names, "color").select(F.col("v").alias("id"), "comp"))
    return graph.vertices.join(named, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def condensation(graph: Graph, comps: DataFrame) -> DataFrame:
    """(s, t, eu, ev, weight, bridges): for components with edges between them the least edge by (weight, ends) and how many there are."""
    own = lambda end, name: comps.select(F.col("id").alias(end), F.col("comp").alias(name))
    between = graph.edges.join(own("src", "s"), "src").join(own("dst", "t"), "dst").where("s <> t")
    best = between.groupBy("s", "t").agg(F.min(F.struct("weight", "src", "dst")).alias("least"), F.count("*").alias("bridges"))
    return best.select("s", "t", F.col("least.src").alias("eu"), F.col("least.dst").alias("ev"), F.col("least.weight").alias("weight"), "bridges")


def topological_levels(comps: DataFrame, bridges: DataFrame, scratch: Scratch) -> DataFrame:
    """(comp, level): the longest way to a component from one without ways in, in bridges."""
    arcs = bridges.select(F.col("s").alias("src"), F.col("t").alias("dst")).distinct()
    state = scratch.cut(comps.select("comp").distinct().withColumn("level", F.lit(0)).withColumn("rose", F.lit(True)))
    while not (live := state.where("rose")).isEmpty():
        onward = live.join(arcs, live["comp"] == arcs["src"]).select(F.col("dst").alias("comp"), (F.col("level") + 1).alias("level"), F.lit(None).cast("int").alias("old"))
        merged = state.select("comp", "level", F.col("level").alias("old")).unionByName(onward).groupBy("comp").agg(F.max("level").alias("level"), F.max("old").alias("old"))
        state = scratch.cut(merged.select("comp", "level", (F.col("level") > F.col("old")).alias("rose")))
    return state.select("comp", "level")


def directed_sums(graph: Graph, scratch: Scratch, mass: DataFrame | None = None) -> DataFrame:
    """(id, r, d): how many others a vertex reaches and the sum of its least distances to them, by exact relaxation of all sources."""
    return least_sums(graph.edges, graph.vertices, scratch, mass=mass)


def forest_of_components(bridges: DataFrame) -> bool:
    """Whether every component has one bridge in at most, so that sums over components add up."""
    return bridges.groupBy("t").agg(F.sum("bridges").alias("n")).where("n > 1").isEmpty()


#: Ways from entries to bridges, and bridges, whose sums one task makes at most; more go through rounds, as many as the forest is deep.
LOCAL_ROWS = 1_000_000


def confined_sums(graph: Graph, scratch: Scratch, local_rows: int = LOCAL_ROWS, mass: DataFrame | None = None) -> DataFrame:
    """(id, r, d) as directed_sums: confined to strong components where these form an out-forest by single bridges, else exact relaxation.

    Within components distances come from one loop over all of them, and those to the starts of bridges from these, against the arcs. What
    lies beyond all bridges of one start adds its count and sum, from the leaves to the roots.
    """
    comps = scratch.cut(strong_components(graph, scratch))
    bridges = scratch.cut(condensation(graph, comps))
    if not forest_of_components(bridges):
        return directed_sums(graph, scratch, mass)
    own = lambda end, name: comps.select(F.col("id").alias(end), F.col("comp").alias(name))
    inside = scratch.cut(graph.edges.join(own("src", "s"), "src").join(own("dst", "t"), "dst").where("s = t").select("src", "dst", "weight"))
    intra = scratch.cut(least_sums(inside, graph.vertices, scratch, mass=mass))
    kind = dict(intra.dtypes)["d"]
    ends = bridges.select(F.col("eu").alias("tail"), F.col("ev").alias("entry"), F.col("weight").cast(kind).alias("w"))
    n = F.lit(1).cast("long")
    ends = scratch.cut(ends.withColumn("n", n) if mass is None else ends.join(mass.withColumnRenamed("v", "entry"), "entry", "left").select("tail", "entry", "w", F.coalesce("mass", n).alias("n")))
    back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    ways = shortest_paths(back, ends.select(F.col("tail").alias("id")).distinct(), scratch).select(F.col("v").alias("id"), F.col("source").alias("tail"), F.col("d").cast(kind).alias("to"))
    ways = scratch.cut(ways)
    entries = ends.select(F.col("entry").alias("id")).distinct()
    needed = scratch.cut(ways.join(entries, "id", "left_semi"))
    if needed.count() + ends.count() <= local_rows:
        none = F.lit(0).cast("long")
        rows = intra.join(entries, "id", "left_semi").select(F.lit(0).alias("kind"), F.col("id").alias("a"), none.alias("b"), F.col("d").alias("x"), F.col("r").alias("n"))
        rows = rows.unionByName(needed.select(F.lit(1).alias("kind"), F.col("id").alias("a"), F.col("tail").alias("b"), F.col("to").alias("x"), none.alias("n")))
        rows = rows.unionByName(ends.select(F.lit(2).alias("kind"), F.col("tail").alias("a"), F.col("entry").alias("b"), F.col("w").alias("x"), "n"))
        beyond = scratch.cut(rows.coalesce(1).mapInPandas(_beyond_in_a_task, f"tail long, more long, far {kind}"))
        return scratch.cut(_added(intra, ways, beyond, kind))
    now = intra
    while True:
        held = ends.join(now.withColumnRenamed("id", "entry"), "entry").groupBy("tail")
        beyond = held.agg(F.sum(F.col("r") + F.col("n")).alias("more"), F.sum(F.col("w") * (F.col("r") + F.col("n")) + F.col("d")).alias("far"))
        new = scratch.cut(_added(intra, ways, beyond, kind))
        if new.exceptAll(now).isEmpty():
            return new
        now = new


def _added(intra: DataFrame, ways: DataFrame, beyond: DataFrame, kind: str) -> DataFrame:
    """intra and what lies beyond bridges: (tail, more, far) is what all bridges of a start lead to, seen from there."""
    added = ways.join(beyond, "tail").groupBy("id").agg(F.sum("more").alias("more"), F.sum(F.col("to") * F.col("more") + F.col("far")).alias("far"))
    return intra.join(added, "id", "left").select("id", (F.col("r") + F.coalesce("more", F.lit(0))).alias("r"), (F.col("d") + F.coalesce("far", F.lit(0).cast(kind))).alias("d"))


def _beyond_in_a_task(frames):
    """What lies beyond the bridges of each start, from the leaves of the forest on.

    Rows by kind: 0 an entry, what it reaches in its component (n) and how far (x); 1 an entry, a start and the way to it; 2 a start, an
    entry, the bridge's weight and the entry's mass.
    """
    import pandas as pd

    own: dict = {}
    ways: dict = {}
    bridges: dict = {}
    for frame in frames:
        for kind, a, b, x, n in frame.itertuples(index=False):
            if kind == 0:
                own[a] = (n, x)
            elif kind == 1:
                ways.setdefault(a, []).append((b, x))
            else:
                bridges.setdefault(a, []).append((b, x, n))
    whole: dict = {}
    for start in bridges:
        walk = [start]
        while walk:
            tail = walk[-1]
            missing = [t for entry, _, _ in bridges[tail] for t, _ in ways.get(entry, ()) if t not in whole]
            if tail in whole:
                walk.pop()
            elif missing:
                walk += missing
            else:
                more, far = 0, 0
                for entry, w, n in bridges[tail]:
                    r, d = own[entry]
                    for t, to in ways.get(entry, ()):
                        r, d = r + whole[t][0], d + to * whole[t][0] + whole[t][1]
                    more, far = more + r + n, far + w * (r + n) + d
                whole[walk.pop()] = (more, far)
    yield pd.DataFrame([(t, more, far) for t, (more, far) in whole.items()], columns=["tail", "more", "far"])
