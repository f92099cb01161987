"""Closeness sums confined to blocks: distances within blocks, then messages along the block-cut forest.

The blocks side by side are one graph, so one traversal loop serves all of them. What lies beyond an articulation vertex reaches a
block as a count and a sum. Up to LOCAL_ROWS distances between articulation vertices, as counted, one task makes all messages in
two sweeps, from the leaves and back. More go through rounds of tables, as many as the forest is deep, in which a message is
made when all that it is made of is there.
"""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farness.graph import Graph
from farness.operators.biconnected import _local_blocks, articulation_points, block_members, edge_blocks
from farness.operators.traverse import bfs_pairs, msbfs_sums
from farness.scratch import Scratch

B = ["block_a", "block_b"]
#: Distances between articulation vertices of one block that one task takes at most.
LOCAL_ROWS = 1_000_000
#: Edges of a graph that one task decomposes, traverses and sums up, and steps of all searches within blocks, at most.
LOCAL_EDGES, LOCAL_STEPS = 20_000, 5_000_000


def _in_block(v: str):
    return F.struct(*B, F.col(v).alias("v"))


def swept(counts: dict, near: dict) -> dict:
    """{(block, art): (count, sum of distances)} of what lies beyond art as seen from the block, by two sweeps over each tree.

    counts: {(block, art): (plain members, their distances from art)}. near: {(block, art): [(other art of the block, distance, its mass)]}.
    """
    blocks_of: dict = {}
    arts_of: dict = {}
    for block, art in counts:
        blocks_of.setdefault(art, []).append(block)
        arts_of.setdefault(block, []).append(art)
    beyond: dict = {}

    def through(block, art):
        """What the block and all beyond its other articulation vertices hold, from art."""
        count, total = counts[block, art]
        for other, d, mass in near.get((block, art), ()):
            n, far = beyond[block, other]
            count, total = count + n + mass, total + d * (n + mass) + far
        return count, total

    seen: set = set()
    for root in blocks_of:
        if root in seen:
            continue
        # (block, the art towards the root), nearer ones first
        order, level = [], [root]
        seen.add(root)
        entered: set = set()
        while level:
            fresh = [(b, art) for art in level for b in blocks_of[art] if b not in entered]
            entered.update(b for b, _ in fresh)
            order += fresh
            level = [a for b, up in fresh for a in arts_of[b] if a != up]
            seen.update(level)
        # what each art's blocks away from the root hold together
        below: dict = {}
        inward: dict = {}
        for block, up in reversed(order):
            for art in arts_of[block]:
                if art != up:
                    beyond[block, art] = below.get(art, (0, 0))
            inward[block] = through(block, up)
            n, far = below.get(up, (0, 0))
            below[up] = (n + inward[block][0], far + inward[block][1])
        # from the root: all of an art's blocks but the one that asks
        total = {root: below.get(root, (0, 0))}
        for block, up in order:
            n, far = inward[block]
            beyond[block, up] = (total[up][0] - n, total[up][1] - far)
            for art in arts_of[block]:
                if art != up:
                    n, far = through(block, art)
                    under = below.get(art, (0, 0))
                    total[art] = (n + under[0], far + under[1])
    return beyond


def _swept_in_a_task(frames):
    counts: dict = {}
    near: dict = {}
    for frame in frames:
        for a, b, art, other, one, two in frame.itertuples(index=False):
            if other < 0:
                counts[(a, b), art] = (one, two)
            else:
                near.setdefault(((a, b), art), []).append((other, one, two))
    rows = [(a, b, art, n, far) for ((a, b), art), (n, far) in swept(counts, near).items()]
    yield pd.DataFrame(rows, columns=[*B, "art", "cnt", "dist"]).astype("int64")


def _messages(counts: DataFrame, between: DataFrame, scratch: Scratch, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(block, art, cnt, dist): how many vertices lie beyond art as seen from the block, and the sum of their distances from art.

    counts: block, art, home (plain members), home_sum (their distances from art). between: block, art, other, d, mass (of other).
    """
    if counts.count() + between.count() <= local_rows:
        # ids are not negative where they stand in for 'none'; others are told by their rank
        names = counts.select("art").distinct().coalesce(1).select("art", F.monotonically_increasing_id().alias("rank"))
        names = scratch.cut(names)
        ranked = counts.join(names, "art").select(*B, F.col("rank").alias("art"), F.lit(-1).cast("long").alias("other"), F.col("home").alias("one"), F.col("home_sum").alias("two"))
        others = names.select(F.col("art").alias("other"), F.col("rank").alias("rank_of_other"))
        pairs = between.join(names, "art").join(others, "other").select(*B, F.col("rank").alias("art"), F.col("rank_of_other").alias("other"), F.col("d").alias("one"), F.col("mass").alias("two"))
        made = ranked.unionByName(pairs).coalesce(1).mapInPandas(_swept_in_a_task, "block_a long, block_b long, art long, cnt long, dist long")
        return scratch.cut(made.join(names.withColumnRenamed("art", "name"), F.col("art") == F.col("rank")).select(*B, F.col("name").alias("art"), "cnt", "dist"))
    parts = between.groupBy(*B, "art").agg(F.count("*").alias("parts"))
    done, now = None, None
    # a message from (block, art) inward is whole once those beyond all other arts of the block are
    waiting = scratch.cut(counts.join(parts, [*B, "art"], "left").select(*B, "art", "home", "home_sum", F.coalesce("parts", F.lit(0)).alias("parts")))
    blocks_at = counts.groupBy("art").agg(F.count("*").alias("blocks"))
    while True:
        if done is None:
            ready = waiting.where("parts = 0").select(*B, "art", F.col("home").alias("f"), F.col("home_sum").alias("g"))
        else:
            seen = now.select(*B, F.col("art").alias("other"), "cnt", "dist")
            inward = between.join(seen, [*B, "other"]).groupBy(*B, "art").agg(F.count("*").alias("have"), F.sum(F.col("cnt") + F.col("mass")).alias("more"), F.sum(F.col("d") * (F.col("cnt") + F.col("mass")) + F.col("dist")).alias("far"))
            ready = waiting.join(inward, [*B, "art"]).where("have = parts").select(*B, "art", (F.col("home") + F.col("more")).alias("f"), (F.col("home_sum") + F.col("far")).alias("g"))
        if done is not None:
            ready = ready.join(done.select(*B, "art"), [*B, "art"], "left_anti")
        ready = scratch.cut(ready)
        if ready.isEmpty():
            return now
        done = scratch.cut(ready if done is None else done.unionByName(ready))
        # beyond art as seen from a block: whole once all other blocks of art have spoken
        total = done.groupBy("art").agg(F.sum("f").alias("tf"), F.sum("g").alias("tg"), F.count("*").alias("spoken")).join(blocks_at, "art")
        mine = counts.select(*B, "art").join(done, [*B, "art"], "left").join(total, "art")
        silent = F.col("f").isNull()
        whole = F.col("spoken") == F.col("blocks") - F.when(silent, 1).otherwise(0)
        now = scratch.cut(mine.where(whole).select(*B, "art", (F.col("tf") - F.coalesce("f", F.lit(0))).alias("cnt"), (F.col("tg") - F.coalesce("g", F.lit(0))).alias("dist")))


def sums_in_blocks(a: list, b: list, mass: dict, most: int = LOCAL_STEPS) -> list[tuple[int, int, int]] | None:
    """(id, r, d) of the vertices of edges a, b, as block_sums(); None where searches within blocks would take more than `most` steps."""
    of: dict = {}
    for u, v, *block in _local_blocks(pd.DataFrame({"a": a, "b": b})).itertuples(index=False):
        near = of.setdefault(tuple(block), {})
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    if sum(len(near) * sum(map(len, near.values())) for near in of.values()) > most:
        return None
    blocks_of: dict = {}
    for block in sorted(of):
        for v in of[block]:
            blocks_of.setdefault(v, []).append(block)
    far: dict = {}
    counts: dict = {}
    between: dict = {}
    for block, near in of.items():
        for v in near:
            # distances are asked for from articulation vertices, and from all where the block is home
            if len(blocks_of[v]) > 1 or blocks_of[v][0] == block:
                known, frontier, level = {v: 0}, [v], 0
                while frontier:
                    level += 1
                    frontier = [w for w in dict.fromkeys(w for u in frontier for w in near[u]) if w not in known]
                    known.update(dict.fromkeys(frontier, level))
                far[block, v] = known
            if len(blocks_of[v]) > 1:
                plain = [(mass.get(w, 1), d) for w, d in known.items() if len(blocks_of[w]) == 1]
                counts[block, v] = sum(m for m, _ in plain), sum(m * d for m, d in plain)
                between[block, v] = [(w, d, mass.get(w, 1)) for w, d in known.items() if w != v and len(blocks_of[w]) > 1]
    beyond = swept(counts, between)
    out = []
    for v, (block, *_) in blocks_of.items():
        r = sum(mass.get(w, 1) for w in of[block] if w != v)
        d = sum(mass.get(w, 1) * k for w, k in far[block, v].items())
        for art, k in far[block, v].items():
            if (block, art) in beyond:
                n, more = beyond[block, art]
                r, d = r + n, d + k * n + more
        out.append((v, r, d))
    return out


def _whole_in_a_task(graph: Graph, mass: DataFrame | None) -> DataFrame | None:
    """block_sums() of a graph of few edges, by one task; None where it has too many, or too much to search."""
    edges = graph.edges.select("src", "dst").limit(LOCAL_EDGES + 1).toArrow()
    if edges.num_rows > LOCAL_EDGES or not edges.num_rows:
        return None
    spark = graph.edges.sparkSession
    a, b = (edges.column(k).to_pylist() for k in range(2))
    masses = {} if mass is None else {r.v: r.mass for r in mass.collect()}
    found = spark.sparkContext.parallelize([0], 1).map(lambda _: sums_in_blocks(a, b, masses)).collect()[0]
    return found and spark.createDataFrame(pd.DataFrame(found, columns=["id", "r", "d"]).astype("int64"), "id long, r long, d long")


def block_sums(graph: Graph, scratch: Scratch, phases: list | None = None, mass: DataFrame | None = None) -> DataFrame:
    """(id, r, d) for every vertex of a canonical undirected graph that has an edge, the same as msbfs_sums gives.

    mass (v, mass) names the vertices that count more than once.

    phases takes (name, ms) of the decomposition, the traversals within blocks and the messages between them.
    """
    if phases is None and (few := _whole_in_a_task(graph, mass)):
        return few
    began = time.perf_counter()

    def passed(name: str) -> None:
        nonlocal began
        if phases is not None:
            phases.append((name, 1000 * (time.perf_counter() - began)))
        began = time.perf_counter()

    blocks = edge_blocks(graph, scratch)
    members, single = block_members(blocks), F.lit(1).cast("long")
    members = members.withColumn("mass", single) if mass is None else members.join(mass, "v", "left").select(*B, "v", F.coalesce("mass", single).alias("mass"))
    members = scratch.cut(members)
    arts = scratch.cut(articulation_points(members))
    one = blocks.select(F.struct(*B, F.col("a").alias("v")).alias("src"), F.struct(*B, F.col("b").alias("v")).alias("dst"))
    arcs = scratch.cut(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    passed("decomposition")
    sizes = scratch.cut(members.groupBy(*B).agg(F.count("*").alias("k"), F.sum("mass").alias("all")))
    wide = sizes.where("k > 2").select(*B)
    inside = members.join(wide, B, "left_semi").select(_in_block("v").alias("id"))
    wide_arcs = arcs.join(wide.select(F.col("block_a").alias("wa"), F.col("block_b").alias("wb")), (F.col("src.block_a") == F.col("wa")) & (F.col("src.block_b") == F.col("wb")), "left_semi")
    heavy = None if mass is None else members.where("mass > 1").select(_in_block("v").alias("v"), "mass")
    traversed = msbfs_sums(scratch.cut(wide_arcs), inside, scratch, True, mass=heavy).select("id.block_a", "id.block_b", "id.v", F.col("d").alias("intra"))
    # a bridge's ends are one apart
    bridges = members.join(sizes.where("k = 2").select(*B, "all"), B).select(*B, "v", (F.col("all") - F.col("mass")).alias("intra"))
    intra = scratch.cut(traversed.unionByName(bridges))
    sources = members.join(arts, "v", "left_semi").select(_in_block("v").alias("id"))
    to_art = bfs_pairs(arcs, sources, scratch, True).select("source.block_a", "source.block_b", F.col("source.v").alias("art"), F.col("v.v").alias("v"), F.col("d").cast("long").alias("d"))
    to_art = to_art.join(arts.withColumn("is_art", F.lit(True)), "v", "left").withColumn("is_art", F.coalesce("is_art", F.lit(False)))
    to_art = scratch.cut(to_art.join(members, [*B, "v"]))
    plain = F.when(~F.col("is_art"), F.col("mass")).otherwise(0).cast("long")
    counts = scratch.cut(to_art.groupBy(*B, "art").agg(F.sum(plain).alias("home"), F.sum(plain * F.col("d")).alias("home_sum")))
    between = scratch.cut(to_art.where("is_art AND v <> art").select(*B, "art", F.col("v").alias("other"), "d", "mass"))
    passed("blocks")
    ext = _messages(counts, between, scratch)
    passed("messages")
    home = members.groupBy("v").agg(F.min(F.struct(*B)).alias("home")).select("v", "home.block_a", "home.block_b")
    beyond = to_art.join(ext, [*B, "art"]).groupBy(*B, "v").agg(F.sum("cnt").alias("cnt"), F.sum(F.col("d") * F.col("cnt") + F.col("dist")).alias("dist"))
    out = home.join(intra, [*B, "v"]).join(members, [*B, "v"]).join(sizes, B).join(beyond, [*B, "v"], "left")
    return out.select(F.col("v").alias("id"), (F.col("all") - F.col("mass") + F.coalesce("cnt", F.lit(0))).alias("r"), (F.col("intra") + F.coalesce("dist", F.lit(0))).alias("d"))
