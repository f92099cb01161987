"""Biconnected components (blocks), articulation vertices and the block-cut tree.

Blocks are labelled by the least edge (a, b) they hold. Components of up to local_edges edges are decomposed one to a task by a depth-first
search; larger ones by table operations on a spanning forest: the reach of the subtrees' non-tree edges links tree edges, and connected
components of that auxiliary graph are the blocks. A breadth-first forest is summed up level by level. Where that would take
many levels, trees are toured instead: places in the tours are found by doubling, a subtree's reach over ranges of places.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farness.graph import Graph
from farness.operators.components import connected_components
from farness.scratch import Scratch

#: A breadth-first forest is given up when so many levels, as wide as the last ones, would follow.
DEEP = 16
#: Arcs of tours that one task follows at most.
TOUR_ARCS = 1_000_000


def _local_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """The block of every edge of one component; edges leave the stack when the search closes their block."""
    near: dict = {}
    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    order, reach, out = {}, {}, []
    for root in near:
        if root in order:
            continue
        order[root] = reach[root] = len(order)
        walk: list[tuple[object, object, Iterator]] = [(root, None, iter(near[root]))]
        edges: list[tuple] = []
        while walk:
            v, parent, rest = walk[-1]
            for w in rest:
                if w not in order:
                    edges.append((v, w))
                    order[w] = reach[w] = len(order)
                    walk.append((w, v, iter(near[w])))
                    break
                if w != parent and order[w] < order[v]:
                    edges.append((v, w))
                    reach[v] = min(reach[v], order[w])
            else:
                walk.pop()
                if parent is not None:
                    reach[parent] = min(reach[parent], reach[v])
                    if reach[v] >= order[parent]:
                        block = []
                        while True:
                            block.append(tuple(sorted(edge := edges.pop())))
                            if edge == (parent, v):
                                break
                        least = min(block)
                        out += [(*e, *least) for e in block]
    return pd.DataFrame(out, columns=["a", "b", "block_a", "block_b"]).astype("int64")


def _forest(arcs: DataFrame, roots: DataFrame, scratch: Scratch, n: int, deep: int) -> list[DataFrame] | None:
    """Levels (v, parent) of a breadth-first forest of n vertices; the parent is the least neighbour of the level before.

    None where, with four levels made, more than `deep` levels as wide as the widest of the last three would follow.
    """
    levels = [scratch.cut(roots.select(F.col("id").alias("v"), F.lit(None).cast("long").alias("parent")))]
    widths = [levels[0].count()]
    seen = levels[0].select("v")
    while sum(widths) < n:
        if len(levels) > 3 and n - sum(widths) > deep * max(widths[-3:]):
            return None
        step = levels[-1].select(F.col("v").alias("src")).join(arcs, "src").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent"))
        levels.append(scratch.cut(step.join(seen, "v", "left_anti")))
        widths.append(levels[-1].count())
        seen = seen.unionByName(levels[-1].select("v"))
    return levels


def _by_levels(edges: DataFrame, levels: list[DataFrame], scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tree (v, parent), cross (a, b, v) and links (src, dst) of a breadth-first forest, as _by_tours(): sizes and reach are summed level by level."""
    sized = [None] * len(levels)
    below = None
    for k in reversed(range(len(levels))):
        own = levels[k].withColumn("own", F.lit(1).cast("long"))
        if below is not None:
            own = own.join(below.groupBy(F.col("parent").alias("v")).agg(F.sum("size").alias("under")), "v", "left").select("v", "parent", (F.col("own") + F.coalesce("under", F.lit(0))).alias("size"))
        else:
            own = own.withColumnRenamed("own", "size")
        sized[k] = below = scratch.cut(own)
    earlier = Window.partitionBy("parent").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    numbered = [scratch.cut(sized[0].withColumn("pre", F.lit(0).cast("long")))]
    for k in range(1, len(levels)):
        placed = sized[k].withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        up = numbered[-1].select(F.col("v").alias("parent"), F.col("pre").alias("up"))
        numbered.append(scratch.cut(placed.join(up, "parent").select("v", "parent", "size", (F.col("up") + 1 + F.col("before")).alias("pre"))))
    every = numbered[0]
    for t in numbered[1:]:
        every = every.unionByName(t)
    every = scratch.cut(every)
    tree = every.where("parent IS NOT NULL").select(F.least("v", "parent").alias("a"), F.greatest("v", "parent").alias("b"))
    cross = scratch.cut(edges.select("a", "b").join(tree, ["a", "b"], "left_anti"))
    ends = cross.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(cross.select(F.col("b").alias("v"), F.col("a").alias("w")))
    reach = ends.join(every.select(F.col("v").alias("w"), F.col("pre").alias("p")), "w").groupBy("v").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    reach = scratch.cut(reach)
    spread, below = [], None
    for k in reversed(range(len(levels))):
        own = numbered[k].join(reach, "v", "left")
        if below is not None:
            own = own.join(below.groupBy(F.col("parent").alias("v")).agg(F.min("low").alias("clo"), F.max("high").alias("chi")), "v", "left")
        else:
            own = own.withColumn("clo", F.lit(None).cast("long")).withColumn("chi", F.lit(None).cast("long"))
        below = scratch.cut(own.select("v", "parent", "size", "pre", F.least("pre", "lo", "clo").alias("low"), F.greatest("pre", "hi", "chi").alias("high")))
        spread.append(below)
    all_of = spread[0]
    for t in spread[1:]:
        all_of = all_of.unionByName(t)
    up = every.where("parent IS NOT NULL").select(F.col("v").alias("parent"), F.col("pre").alias("up"), F.col("size").alias("usize"))
    joins = all_of.join(up, "parent").where("low < up OR high >= up + usize").select(F.col("v").alias("src"), F.col("parent").alias("dst"))
    # ends of such an edge are a level apart at most, so neither is above the other
    return every.where("parent IS NOT NULL").select("v", "parent"), cross.withColumn("v", F.col("a")), joins.unionByName(cross.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _spanning_forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, component) of a spanning forest of edges (a, b, component).

    In each round every part takes an edge to the least part beside it. Such edges close no circle but that of two parts that take
    the same edge, and leave half of the parts at most.
    """
    rest, taken = edges.select(F.col("a").alias("p"), F.col("b").alias("q"), "a", "b", "component"), []
    while True:
        ways = rest.unionByName(rest.select(F.col("q").alias("p"), F.col("p").alias("q"), "a", "b", "component"))
        taken.append(scratch.cut(ways.groupBy("p").agg(F.min(F.struct("q", "a", "b", "component")).alias("least")).select("p", "least.*")))
        part = connected_components(taken[-1], scratch, "p", "q")
        at = rest.join(part.select(F.col("id").alias("p"), F.col("component").alias("one")), "p").join(part.select(F.col("id").alias("q"), F.col("component").alias("two")), "q").where("one <> two")
        beside = at.groupBy(F.least("one", "two").alias("p"), F.greatest("one", "two").alias("q")).agg(F.min(F.struct("a", "b", "component")).alias("least"))
        rest = scratch.cut(beside.select("p", "q", "least.*"))
        if rest.isEmpty():
            forest = taken[0].select("a", "b", "component")
            for t in taken[1:]:
                forest = forest.unionByName(t.select("a", "b", "component"))
            return forest.distinct()


def _followed_in_a_task(batches):
    import numpy as np
    import pyarrow as pa

    table = pa.Table.from_batches(list(batches)).sort_by("arc")
    arc, after = table.column("arc").to_numpy(), table.column("next").fill_null(-1).to_numpy()
    at = np.where(after < 0, np.arange(len(arc)), np.searchsorted(arc, after))
    far = (after >= 0).astype("int64")
    while (more := far[at]).any():
        far, at = far + more, at[at]
    yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(far)], ["arc", "far"])


def _followed(now: DataFrame, scratch: Scratch, most: int, local_arcs: int = TOUR_ARCS) -> DataFrame:
    """(arc, far): how many steps off the end of its list an arc is; now (arc, next), lists of `most` arcs or less, next null at their ends.

    Up to local_arcs arcs, as counted, are followed by one task; more by tables, in as many doublings as `most` has binary digits.
    """
    if now.count() <= local_arcs:
        return scratch.cut(now.coalesce(1).mapInArrow(_followed_in_a_task, "arc long, far long"))
    now, known = now.withColumn("far", F.col("next").isNotNull().cast("long")), 1
    while known < most:
        ahead = now.select(F.col("arc").alias("next"), F.col("next").alias("after"), F.col("far").alias("more"))
        # arcs that know their end stay out of the join, where all would have one key
        further = now.where("next IS NOT NULL").join(ahead, "next").select("arc", F.col("after").alias("next"), (F.col("far") + F.col("more")).alias("far"))
        now = scratch.cut(further.unionByName(now.where("next IS NULL")))
        scratch.drop(f"cut-{scratch.n - 1}")
        known *= 2
    return now.select("arc", "far")


def _toured(forest: DataFrame, scratch: Scratch, most: int, local_arcs: int) -> DataFrame:
    """(v, parent, component, pre, last) for the vertices of a forest (a, b, component): trees are rooted at component.

    pre and last are the steps at which a tour of the tree enters and leaves v, 0 and most + 1 for a root; no tour is longer than `most` steps.
    """
    numbered = scratch.cut(forest.withColumn("e", F.monotonically_increasing_id()))
    # arc 2e goes from a to b and 2e + 1 back; after the arc into a vertex comes the next one out of it, in a circle
    arcs = numbered.select("component", (F.col("e") * 2).alias("arc"), F.col("a").alias("u")).unionByName(numbered.select("component", (F.col("e") * 2 + 1).alias("arc"), F.col("b").alias("u")))
    out = Window.partitionBy("u")
    after = F.coalesce(F.lead("arc").over(out.orderBy("arc")), F.when(F.col("u") != F.col("component"), F.min("arc").over(out)))
    now = scratch.cut(arcs.select(F.col("arc").bitwiseXOR(F.lit(1).cast("long")).alias("arc"), after.alias("next")))
    far = _followed(now, scratch, most, local_arcs)
    way = far.groupBy(F.shiftright("arc", 1).alias("e")).agg(F.max(F.when(F.col("arc") % 2 == 0, F.col("far"))).alias("there"), F.max(F.when(F.col("arc") % 2 == 1, F.col("far"))).alias("back"))
    down = F.col("there") > F.col("back")
    inner = numbered.join(way, "e").select(
        F.when(down, F.col("b")).otherwise(F.col("a")).alias("v"),
        F.when(down, F.col("a")).otherwise(F.col("b")).alias("parent"),
        "component",
        (F.lit(most) - F.greatest("there", "back")).alias("pre"),
        (F.lit(most) - F.least("there", "back")).alias("last"),
    )
    root = forest.select("component").distinct().selectExpr("component AS v", "CAST(NULL AS BIGINT) AS parent", "component", "0L AS pre", f"{most + 1}L AS last")
    return scratch.cut(inner.unionByName(root))


def _by_tours(edges: DataFrame, scratch: Scratch, most: int, local_arcs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """tree (v, parent), cross (a, b, v) and links (src, dst) of a spanning forest of edges (a, b, component), in rounds that don't grow with its depth.

    Tree edges go by their lower end v. Those of linked vertices are in one block, and a cross edge is in the block of v's tree edge.
    """
    forest = scratch.cut(_spanning_forest(edges, scratch))
    every = _toured(forest, scratch, most, local_arcs)
    cross = edges.join(forest.select("a", "b"), ["a", "b"], "left_anti")
    for x in "ab":
        cross = cross.join(every.select(F.col("v").alias(x), F.col("pre").alias(f"pre_{x}"), F.col("last").alias(f"last_{x}")), x)
    cross = scratch.cut(cross)
    ways = cross.selectExpr("component", "pre_a AS place", "pre_b AS to").unionByName(cross.selectExpr("component", "pre_b AS place", "pre_a AS to"))
    reach = ways.groupBy("component", "place").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
    # least and greatest reach from ranges of 2^k places, of which at most two of each k make up a subtree
    heights = F.explode(F.sequence(F.lit(0), F.lit((most + 1).bit_length()))).alias("k")
    ranges = reach.select("*", heights).groupBy("component", "k", F.expr("shiftright(place, k)").alias("range")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    up = every.where("parent IS NOT NULL").select(F.col("v").alias("parent"), F.col("pre").alias("up"), F.col("last").alias("up_last"))
    spans = every.join(up, "parent").select("*", heights).withColumn("l", F.expr("shiftright(pre + shiftleft(1L, k) - 1, k)")).withColumn("r", F.expr("shiftright(last + 1, k)"))
    picked = spans.where("l < r").withColumn("range", F.explode(F.expr("filter(array(if(l % 2 = 1, l, NULL), if(r % 2 = 1, r - 1, NULL)), x -> x IS NOT NULL)")))
    joins = picked.join(ranges, ["component", "k", "range"]).where("lo < up OR hi > up_last").select(F.col("v").alias("src"), F.col("parent").alias("dst"))
    apart = cross.where("last_a < pre_b OR last_b < pre_a").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    lower = F.when(F.col("pre_a") > F.col("pre_b"), F.col("a")).otherwise(F.col("b")).alias("v")
    return every.where("parent IS NOT NULL").select("v", "parent"), cross.select("a", "b", lower), joins.unionByName(apart)


def _table_blocks(edges: DataFrame, of: DataFrame, scratch: Scratch, deep: int, local_arcs: int) -> DataFrame:
    """(a, b, block_a, block_b) by table operations; edges (a, b, component) with a < b, of (id, component) their vertices."""
    n, widest = of.groupBy("component").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    arcs = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    levels = _forest(arcs, of.where("id = component").select("id"), scratch, n, deep) if deep else None
    tree, cross, links = _by_levels(edges, levels, scratch) if levels else _by_tours(edges, scratch, 2 * (widest - 1), local_arcs)
    same = connected_components(links, scratch)
    label = scratch.cut(tree.join(same, tree["v"] == same["id"], "left").select("v", "parent", F.coalesce("component", "v").alias("label")))
    labelled = label.select(F.least("v", "parent").alias("a"), F.greatest("v", "parent").alias("b"), "label").unionByName(cross.join(label.select("v", "label"), "v").select("a", "b", "label"))
    names = labelled.groupBy("label").agg(F.min(F.struct("a", "b")).alias("least"))
    return labelled.join(names, "label").select("a", "b", F.col("least.a").alias("block_a"), F.col("least.b").alias("block_b"))


def edge_blocks(graph: Graph, scratch: Scratch, local_edges: int = 200_000, deep: int = DEEP, local_arcs: int = TOUR_ARCS) -> DataFrame:
    """(a, b, block_a, block_b) for every edge a < b of a canonical undirected graph with BIGINT ids.

    Of components above local_edges edges, breadth-first forests are given up for tours if they are deep; at deep = 0 they aren't tried.
    """
    edges = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    of = scratch.cut(connected_components(graph.edges, scratch))
    placed = scratch.cut(edges.join(of, edges["a"] == of["id"]).select("a", "b", "component"))
    sizes = scratch.cut(placed.groupBy("component").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > local_edges).select("component")
    schema = "a long, b long, block_a long, block_b long"
    out = placed.join(large, "component", "left_anti").groupBy("component").applyInPandas(_local_blocks, schema)
    if not large.isEmpty():
        mine = scratch.cut(placed.join(large, "component", "left_semi").select("a", "b", "component"))
        out = out.unionByName(_table_blocks(mine, of.join(large, "component", "left_semi").select("id", "component"), scratch, deep, local_arcs))
    return scratch.cut(out)


def block_members(blocks: DataFrame) -> DataFrame:
    """(block_a, block_b, v) from edge_blocks()."""
    return blocks.select("block_a", "block_b", F.explode(F.array("a", "b")).alias("v")).distinct()


def articulation_points(members: DataFrame) -> DataFrame:
    """(v) of the vertices in two blocks or more."""
    return members.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")


def block_cut_tree(members: DataFrame) -> DataFrame:
    """(block_a, block_b, art): the edges between blocks and the articulation vertices they hold."""
    return members.join(articulation_points(members), "v", "left_semi").select("block_a", "block_b", F.col("v").alias("art"))


def block_stats(members: DataFrame, n: int) -> DataFrame:
    """One row: blocks, articulations, the largest block and sum K*K / n*n (the work of confined traversal against the whole)."""
    sizes = members.groupBy("block_a", "block_b").agg(F.count("*").alias("k"))
    arts = articulation_points(members).agg(F.count("*").alias("articulations"))
    return sizes.agg(F.count("*").alias("blocks"), F.coalesce(F.max("k"), F.lit(0)).alias("largest"), (F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0)) / F.lit(float(n) * n)).alias("work_ratio")).crossJoin(arts)
