"""Registered queries of sources and sinks, generators, blocks of graphs with cycles, confined sums, reports and directed updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from farness import sources
from farness.graph import Graph
from farness.operators import biconnected, checks
from farness.operators.blocks import block_sums
from farness.operators.redundant import reduction_stats
from farness.plans import closeness
from farness.queries import _DIRECTED, GEO, HUB, STATES_DUCK, TRI, _closeness_sql, _kept, _result, _sssp, _und, geo, graph_of, query, rows_of, states, tri
from farness.scratch import Scratch
from farness.sources import generate
from farness.streaming import affected_by_batch, apply_updates, refreshed_directed

#: Rings of a nation's suppliers hung on its nation, nations on regions: blocks of several kinds.
RINGS = """SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(100 + n_nationkey AS BIGINT) AS dst FROM nation
UNION ALL SELECT CAST(100 + s_nationkey AS BIGINT), 1000 + min(s_suppkey) FROM supplier GROUP BY s_nationkey
UNION ALL SELECT 1000 + s_suppkey, 1000 + after FROM (SELECT s_suppkey, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS after FROM supplier) AS x WHERE after IS NOT NULL
UNION ALL SELECT 1000 + min(s_suppkey), 1000 + max(s_suppkey) FROM supplier GROUP BY s_nationkey HAVING count(*) > 2"""
#: Nations and their customers make a strong component each, with one way in from the region: an out-forest.
FOREST = """SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(100 + n_nationkey AS BIGINT) AS dst, CAST(2 AS BIGINT) AS weight FROM nation
UNION ALL SELECT CAST(100 + c_nationkey AS BIGINT), 1000000 + c_custkey, 1 + c_custkey % 3 FROM customer
UNION ALL SELECT 1000000 + c_custkey, CAST(100 + c_nationkey AS BIGINT), CAST(1 AS BIGINT) FROM customer
UNION ALL SELECT 1000000 + max(c_custkey), 1000 + s_suppkey, CAST(4 AS BIGINT) FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY s_suppkey"""
#: The same rows without a row for each customer and supplier of a nation on the way.
FOREST_EDGES = FOREST.replace(
    "max(c_custkey), 1000 + s_suppkey, CAST(4 AS BIGINT) FROM customer JOIN",
    "max(c_custkey), 1000 + s_suppkey, CAST(4 AS BIGINT) FROM (SELECT c_nationkey, max(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey) AS most JOIN",
)
CLIQUES = """SELECT 6 * c + i src, 6 * c + j dst, 1 + (i + j) % 3 weight FROM range(8) a(c), range(6) b(i), range(6) d(j) WHERE i <> j
UNION ALL SELECT 6 * c + 5, 6 * c + 6, 2 FROM range(7) e(c)"""


def _directed(edges: str) -> str:
    return _DIRECTED.replace(STATES_DUCK, edges)


def _blocks_sql(edges: str) -> str:
    """cut: components without each vertex; two edges at a vertex are in one block if their other ends are joined without it."""
    return f"""{_und(edges)},
cut(x, v, c) USING KEY (x, v) AS (SELECT a.id, b.id, b.id FROM vtx a, vtx b WHERE a.id <> b.id
  UNION SELECT k.x, n.v, min(k.c) FROM cut k JOIN und n ON n.u = k.v AND n.v <> k.x LEFT JOIN recurring.cut o ON o.x = k.x AND o.v = n.v WHERE o.c > k.c GROUP BY 1, 2),
ed AS MATERIALIZED (SELECT u, v, least(u, v) * 4294967296 + greatest(u, v) k FROM und),
meet AS MATERIALIZED (SELECT e.k k1, f.k k2 FROM ed e JOIN ed f ON e.u = f.u AND e.v <> f.v JOIN cut c1 ON c1.x = e.u AND c1.v = e.v JOIN cut c2 ON c2.x = f.u AND c2.v = f.v WHERE c1.c = c2.c),
lab(k, l) USING KEY (k) AS (SELECT DISTINCT k, k FROM ed UNION SELECT m.k2, min(b.l) FROM lab b JOIN meet m ON m.k1 = b.k LEFT JOIN recurring.lab o ON o.k = m.k2 WHERE o.l > b.l GROUP BY 1),
blk AS (SELECT k // 4294967296 a, k % 4294967296 b, l // 4294967296 block_a, l % 4294967296 block_b FROM lab),
mem AS (SELECT DISTINCT block_a, block_b, unnest([a, b]) v FROM blk),
art AS (SELECT v FROM mem GROUP BY 1 HAVING count(*) > 1)"""


def rings(spark, d) -> Graph:
    return graph_of(spark, d, RINGS, ("nation", "supplier"))


def _edge_blocks(spark, d, local_edges: int):
    scratch = Scratch(spark, "rings")
    return scratch.cut(biconnected.edge_blocks(_kept(rings(spark, d), scratch), scratch, local_edges))


_EDGES = f"WITH RECURSIVE {_blocks_sql(RINGS)} SELECT a, b, block_a, block_b FROM blk"


@query(_EDGES)
def bcc_rings_by_search(spark, d):
    return _edge_blocks(spark, d, 1 << 40)


@query(_EDGES)
def bcc_rings_by_tables(spark, d):
    return _edge_blocks(spark, d, 0)


def _members(spark, d):
    return Scratch(spark, "members").cut(biconnected.block_members(_edge_blocks(spark, d, 1 << 40)))


@query(f"WITH RECURSIVE {_blocks_sql(RINGS)} SELECT v FROM art")
def articulation_rings(spark, d):
    return biconnected.articulation_points(_members(spark, d))


@query(f"WITH RECURSIVE {_blocks_sql(RINGS)} SELECT block_a, block_b, v art FROM mem JOIN art USING (v)")
def block_cut_rings(spark, d):
    return biconnected.block_cut_tree(_members(spark, d))


@query(f"WITH RECURSIVE {_blocks_sql(RINGS)}, k AS (SELECT count(*) k FROM mem GROUP BY block_a, block_b), nn AS (SELECT count(*) n FROM vtx) SELECT count(*) blocks, max(k) largest, CAST(sum(k * k) AS DOUBLE) / (CAST(max(n) AS DOUBLE) * max(n)) work_ratio, (SELECT count(*) FROM art) articulations FROM k, nn")
def block_stats_rings(spark, d):
    return biconnected.block_stats(_members(spark, d), rings(spark, d).vertices.count())


@query(_closeness_sql(RINGS, "wf"))
def closeness_blocks_rings(spark, d):
    return closeness(rings(spark, d), "blocks")


_TIGHT = """p AS (SELECT a.u c, a.v x, b.v y FROM und a JOIN k ON k.u = a.u AND k.k IN (3, 4) JOIN und b ON b.u = a.u AND a.v < b.v JOIN und t ON t.u = a.v AND t.v = b.v),
t AS (SELECT c, z, count(*) n FROM (SELECT c, x z FROM p UNION ALL SELECT c, y FROM p) GROUP BY 1, 2), s AS (SELECT c, count(*) n, min(n) lo, max(n) hi FROM t GROUP BY 1),
tight AS (SELECT count(*) FILTER (k = 3 AND s.n = 3 AND lo = 2) r3, count(*) FILTER (k = 4 AND s.n = 4 AND lo = 2 AND hi = 2) r4 FROM s JOIN k ON k.u = c)"""


# all customers hang on one core of triangles: a single block without articulations
@query(f"WITH {_und(TRI)}, k AS (SELECT u, count(*) k FROM und GROUP BY 1), {_TIGHT} SELECT CAST(1 AS BIGINT) blocks, CAST(0 AS BIGINT) articulations, r3, r4, CAST(r3 + r4 AS DOUBLE) / (SELECT count(*) FROM vtx) redundant_share FROM tight")
def reduction_statistics(spark, d):
    scratch = Scratch(spark, "reduction")
    graph = _kept(tri(spark, d), scratch)
    return reduction_stats(graph, scratch.cut(biconnected.block_members(biconnected.edge_blocks(graph, scratch))))


@query(f"WITH RECURSIVE {_directed(FOREST)}, {_sssp()}, {_result('reachable')} SELECT * FROM full_rows")
def closeness_confined(spark, d):
    return closeness(graph_of(spark, d, FOREST_EDGES, ("nation", "customer", "supplier"), True), "confined")


@query(f"WITH RECURSIVE {_directed(CLIQUES)}, {_sssp()}, {_result('reachable')} SELECT id, r, CAST(d AS DOUBLE) d, closeness FROM full_rows")
def closeness_confined_cliques(spark, d):
    return closeness(generate.chain_of_cliques(spark), "confined")


@query("SELECT unnest(['decomposition', 'blocks', 'messages']) phase, true measured")
def phase_timings(spark, d):
    scratch, phases = Scratch(spark, "phases"), []
    block_sums(_kept(geo(spark, d), scratch), scratch, phases)
    return spark.createDataFrame(phases, "phase string, ms double").select("phase", (F.col("ms") >= 0).alias("measured"))


# directed updates


def _arc(spark, d):
    return rows_of(spark, d, f"SELECT CAST({HUB} AS BIGINT) AS src, CAST(min(user_id) * 8 AS BIGINT) AS dst, CAST(5 AS BIGINT) AS weight FROM events", ("events",)).withColumn("op", F.lit("insert"))


_MORE = f"{STATES_DUCK}\nUNION ALL SELECT CAST({HUB} AS BIGINT), CAST(min(user_id) * 8 AS BIGINT), CAST(5 AS BIGINT) FROM events"


@query(f"WITH RECURSIVE {_directed(_MORE)}, {_sssp()}, {_result('reachable')} SELECT * FROM full_rows")
def directed_insert_closeness(spark, d):
    return closeness(apply_updates(states(spark, d), _arc(spark, d)), "weighted")


@query(f"WITH RECURSIVE {_directed(_MORE)}, {_sssp()}, {_result('reachable')} SELECT id, r, d FROM full_rows")
def refreshed_directed_sums(spark, d):
    scratch, graph = Scratch(spark, "refreshed-directed"), states(spark, d)
    graph = Graph(scratch.cut(graph.vertices), scratch.cut(graph.edges), True)
    return refreshed_directed(graph, scratch.cut(closeness(graph, "weighted", scratch=scratch)), _arc(spark, d), scratch)


# the region's ends come nearer to each other, and the first nation's edge to its region goes
@query(f"""WITH RECURSIVE {_und(GEO)}, up(op, u, w) AS (VALUES ('insert', 0, 1), ('insert', 1, 2), ('delete', (SELECT min(src) FROM e), (SELECT min(dst) FROM e WHERE src = (SELECT min(src) FROM e)))),
bfs(s, v, d) USING KEY (s, v) AS (SELECT DISTINCT x, x, 0 FROM (SELECT u x FROM up UNION SELECT w FROM up)
  UNION SELECT b.s, x.v, min(b.d + 1) FROM bfs b JOIN und x ON x.u = b.v LEFT JOIN recurring.bfs o ON o.s = b.s AND o.v = x.v WHERE o.d IS NULL OR o.d > b.d + 1 GROUP BY 1, 2),
t AS (SELECT up.op, up.u, up.w, bfs.v id, max(d) FILTER (s = up.u) du, max(d) FILTER (s = up.w) dw FROM up JOIN bfs ON bfs.s IN (up.u, up.w) GROUP BY ALL)
SELECT DISTINCT id FROM t WHERE du IS NULL OR dw IS NULL OR (op = 'insert' AND abs(du - dw) > 1) OR (op = 'delete' AND du <> dw)""")
def affected_by_updates(spark, d):
    graph = geo(spark, d)
    gone = graph.edges.agg(F.min(F.struct("src", "dst")).alias("e")).select(F.lit("delete").alias("op"), "e.src", "e.dst")
    new = spark.createDataFrame([("insert", 0, 1), ("insert", 1, 2)], "op string, src long, dst long")
    return affected_by_batch(graph, new.unionByName(gone), Scratch(spark, "affected"))


# sources and sinks


@query("SELECT CAST(n_regionkey AS BIGINT) src, CAST(5 + n_nationkey AS BIGINT) dst, (SELECT count(*) + 5 FROM nation) vertices FROM nation")
def edge_list_round_trip(spark, d):
    path = Scratch(spark, "edge-list").path("graph")
    edges = rows_of(spark, d, "SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(5 + n_nationkey AS BIGINT) AS dst FROM nation", ("nation",))
    sources.write_edge_list(Graph(spark.range(5 + edges.count()), edges), path)
    graph = sources.read_edge_list(spark, path)
    return graph.edges.crossJoin(graph.vertices.agg(F.count("*").alias("vertices")))


@query(f"SELECT row_number() OVER (ORDER BY id) - 1 place, closeness AS value FROM ({_closeness_sql(RINGS, 'classic')}) x")
def value_lines(spark, d):
    path = Scratch(spark, "values").path("lines")
    sources.write_values(closeness(rings(spark, d), "bits", "classic"), path, plain=True)
    return sources.read_values(spark, path)


@query("SELECT s_acctbal AS value FROM supplier WHERE s_suppkey % 2 = 0")
def strict_values(spark, d):
    path = Scratch(spark, "strict").path("lines")
    lines = rows_of(spark, d, "SELECT CASE WHEN s_suppkey % 2 = 0 THEN concat_ws(',', s_acctbal, s_name) ELSE concat_ws(',', concat(s_acctbal, 'x'), s_name) END AS value FROM supplier", ("supplier",))
    lines.write.text(path)
    return sources.read_values(spark, path).select("value")


_RUNS = "SELECT o_orderstatus AS method, o_orderpriority AS graph, CAST(floor(o_totalprice) AS DOUBLE) AS ms FROM orders"
_STATS = f"SELECT method, graph, avg(ms) mean_ms, min(ms) min_ms, max(ms) max_ms, count(*) runs FROM ({_RUNS}) x GROUP BY 1, 2"


@query("SELECT o_orderstatus AS method, CAST(floor(o_totalprice) AS DOUBLE) AS ms FROM orders WHERE o_orderkey % 10 IN (0, 1)")
def timing_log(spark, d):
    path = Scratch(spark, "timings").path("log")
    for k in (0, 1):
        runs = rows_of(spark, d, f"SELECT o_orderstatus AS method, CAST(floor(o_totalprice) AS DOUBLE) AS ms FROM orders WHERE o_orderkey % 10 = {k}", ("orders",))
        sources.append_timing_lines(runs, path)
    return sources.read_timing_lines(spark, path)


@query(_STATS)
def run_statistics(spark, d):
    return checks.run_stats(rows_of(spark, d, _RUNS, ("orders",)), ["method", "graph"])


@query(f"WITH s AS ({_STATS}) SELECT s.*, b.mean_ms / s.mean_ms speedup FROM s JOIN s b ON b.graph = s.graph AND b.method = 'O'")
def method_speedups(spark, d):
    return checks.speedups(run_statistics(spark, d), ["graph"], "O")


@query(f"SELECT method, graph, min_ms, runs FROM ({_STATS}) x")
def summary_file(spark, d):
    path = Scratch(spark, "summary").path("csv")
    sources.write_summary(run_statistics(spark, d).select("method", "graph", "min_ms", "runs"), path)
    return spark.read.option("header", True).schema("method string, graph string, min_ms double, runs long").csv(path)


# generators


def _report(spark, graph: Graph, name: str):
    return checks.graph_report(graph, Scratch(spark, name))


@query("SELECT CAST(300 AS BIGINT) n, CAST(450 AS BIGINT) m, CAST(450 AS BIGINT) unique_edges, CAST(0 AS BIGINT) self_loops, CAST(0 AS BIGINT) duplicates")
def generated_uniform(spark, d):
    return _report(spark, generate.uniform(spark, 300, 450), "uniform").drop("components")


@query("SELECT CAST(200 AS BIGINT) n, CAST(900 AS BIGINT) m, CAST(900 AS BIGINT) unique_edges, CAST(0 AS BIGINT) self_loops, CAST(0 AS BIGINT) duplicates, CAST(1 AS BIGINT) components")
def generated_blocks_exact(spark, d):
    return _report(spark, generate.blocks_in_a_row(spark, 200, 900, blocks=5), "blocks")


@query("SELECT CAST(60 AS BIGINT) n, CAST(900 AS BIGINT) m, CAST(0 AS BIGINT) self_loops, CAST(1 AS BIGINT) components, true repeats")
def generated_multi_edges(spark, d):
    return _report(spark, generate.blocks_in_a_row(spark, 60, 900, blocks=3, distinct=False), "multi").select("n", "m", "self_loops", "components", (F.col("duplicates") > 0).alias("repeats"))


@query("SELECT CAST(0 AS BIGINT) loops, CAST(0 AS BIGINT) repeats, CAST(0 AS BIGINT) odd_weights, true drawn")
def generated_directed(spark, d):
    edges = generate.random_directed(spark, 120, 0.05).edges
    odd = ~F.col("weight").isin(*[1 + 0.5 * k for k in range(10)])
    return edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"), (F.count("*") - F.count_distinct("src", "dst")).alias("repeats"), F.count_if(odd).alias("odd_weights"), (F.count("*") > 0).alias("drawn"))


@query("SELECT CAST(10 AS BIGINT) inserts, CAST(10 AS BIGINT) edges, CAST(0 AS BIGINT) known")
def generated_inserts(spark, d):
    graph = generate.connected(spark, 100, 150)
    new = Scratch(spark, "inserts").cut(generate.insert_batch(graph, 10))
    known = checks.edges_present(graph, new.select("src", "dst"))
    return known.agg(F.count("*").alias("inserts"), F.count_distinct("src", "dst").alias("edges"), F.count_if("present").alias("known"))
