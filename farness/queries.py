"""Registered graph queries over whole tables, and DuckDB SQL for their rows.

Graphs: geo (region - nation - supplier, customer: a forest), market (geo and customer - segment: one large block with pendants),
tri (customers tied to a triangle of nation, region and segment), states (directed, weighted: a user's event types in order,
each with an arc to its type's hub, hubs in order of all users). Edges come from one text of SQL that both engines run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farness.graph import Graph
from farness.operators import biconnected, checks
from farness.operators.components import connected_components
from farness.operators.redundant import redundant_vertices
from farness.operators.strong import condensation, strong_components, topological_levels
from farness.operators.traverse import bfs_pairs, shortest_paths
from farness.plans import closeness
from farness.scratch import Scratch
from farness.sources import generate
from farness.streaming import affected_sources, apply_updates, refreshed

GEO = """SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(100 + n_nationkey AS BIGINT) AS dst FROM nation
UNION ALL SELECT CAST(100 + s_nationkey AS BIGINT), 1000 + s_suppkey FROM supplier
UNION ALL SELECT CAST(100 + c_nationkey AS BIGINT), 1000000 + c_custkey FROM customer"""
SEGMENTS = "(SELECT c_mktsegment, 49 + row_number() OVER (ORDER BY c_mktsegment) AS seg FROM (SELECT DISTINCT c_mktsegment FROM customer) AS x)"
MARKET = f"{GEO}\nUNION ALL SELECT CAST(seg AS BIGINT), 1000000 + c_custkey FROM customer JOIN {SEGMENTS} AS s USING (c_mktsegment)"
TRI = f"""SELECT CAST(100 + c_nationkey AS BIGINT) AS src, 1000000 + c_custkey AS dst FROM customer
UNION ALL SELECT CAST(n_regionkey AS BIGINT), 1000000 + c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT CAST(seg AS BIGINT), 1000000 + c_custkey FROM customer JOIN {SEGMENTS} AS s USING (c_mktsegment)
UNION ALL SELECT CAST(n_regionkey AS BIGINT), CAST(100 + n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT DISTINCT CAST(seg AS BIGINT), CAST(100 + c_nationkey AS BIGINT) FROM customer JOIN {SEGMENTS} AS s USING (c_mktsegment)
UNION ALL SELECT DISTINCT CAST(n_regionkey AS BIGINT), CAST(seg AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN {SEGMENTS} AS s USING (c_mktsegment)"""
HUB = 1_000_000_000


def _states(minutes: str) -> str:
    kinds = "(SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events) AS x)"
    steps = f"""(SELECT user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pk, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pts
  FROM events JOIN {kinds} AS t USING (event_type))"""
    return f"""SELECT CAST(user_id * 8 + pk AS BIGINT) AS src, CAST(user_id * 8 + k AS BIGINT) AS dst, CAST(min({minutes}) + 1 AS BIGINT) AS weight FROM {steps} AS a WHERE pk <> k GROUP BY 1, 2
UNION ALL SELECT DISTINCT CAST(user_id * 8 + k AS BIGINT), CAST({HUB} + k AS BIGINT), CAST(1 AS BIGINT) FROM {steps} AS b
UNION ALL SELECT CAST({HUB} + pk AS BIGINT), CAST({HUB} + k AS BIGINT), CAST(min({minutes}) + 1 AS BIGINT) FROM {steps} AS c WHERE pk <> k GROUP BY 1, 2"""


STATES = _states("(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(pts AS TIMESTAMP))) DIV 60000000")
STATES_DUCK = _states("(epoch_us(ts) - epoch_us(pts)) // 60000000")
#: Updates of the dynamic queries: a chain through all regions comes; the hubs' arcs to lower types go.
CHAIN = "SELECT CAST(a.r_regionkey AS BIGINT) AS src, CAST(b.r_regionkey AS BIGINT) AS dst FROM region AS a JOIN region AS b ON b.r_regionkey = a.r_regionkey + 1"


def graph_of(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...], directed: bool = False) -> Graph:
    # as a table: vertices and edges, and updates of them, are all made from these rows
    return Graph.of_edges(Scratch(spark, "edges").cut(rows_of(spark, sf_dir, sql, tables)), directed)


def rows_of(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    """The rows of SQL over tables of sf_dir, by views of names of their own."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"farness_{t}")
        sql = sql.replace(f"FROM {t}", f"FROM farness_{t} AS {t}").replace(f"JOIN {t}", f"JOIN farness_{t} AS {t}").replace(f"AS {t} AS ", "AS ")
    return spark.sql(sql)


def geo(spark: SparkSession, d: str) -> Graph:
    return graph_of(spark, d, GEO, ("nation", "supplier", "customer"))


def market(spark: SparkSession, d: str) -> Graph:
    return graph_of(spark, d, MARKET, ("nation", "supplier", "customer"))


def tri(spark: SparkSession, d: str) -> Graph:
    return graph_of(spark, d, TRI, ("nation", "customer"))


def states(spark: SparkSession, d: str) -> Graph:
    return graph_of(spark, d, STATES, ("events",), True)


def _kept(graph: Graph, scratch: Scratch) -> Graph:
    plain = graph.canonical()
    return Graph(scratch.cut(plain.vertices), scratch.cut(plain.edges), plain.directed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# SQL pieces


def _und(edges: str) -> str:
    return f"e AS ({edges}), und AS MATERIALIZED (SELECT src u, dst v FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), vtx AS (SELECT DISTINCT u id FROM und)"


def _bfs(start: str = "SELECT DISTINCT u, u, 0 FROM und", arcs: str = "und") -> str:
    return f"""bfs(s, v, d) USING KEY (s, v) AS ({start}
  UNION SELECT b.s, x.v, min(b.d + 1) FROM bfs b JOIN {arcs} x ON x.u = b.v LEFT JOIN recurring.bfs o ON o.s = b.s AND o.v = x.v WHERE o.d IS NULL OR o.d > b.d + 1 GROUP BY 1, 2)"""


_FORMULA = {
    "classic": "CAST(n - 1 AS DOUBLE) / d",
    "wf": "(CAST(r AS DOUBLE) * r) / (CAST(n - 1 AS DOUBLE) * d)",
    "reachable": "CAST(r AS DOUBLE) / d",
}


def _result(normalization: str) -> str:
    return f"""agg AS (SELECT s id, CAST(count(*) - 1 AS BIGINT) r, CAST(sum(d) AS BIGINT) d FROM bfs GROUP BY 1), nn AS (SELECT count(*) n FROM vtx),
full_rows AS (SELECT vtx.id, coalesce(r, 0) r, coalesce(d, 0) d, CASE WHEN d > 0 THEN {_FORMULA[normalization]} ELSE CAST(0 AS DOUBLE) END closeness FROM vtx CROSS JOIN nn LEFT JOIN agg ON agg.id = vtx.id)"""


def _closeness_sql(edges: str, normalization: str) -> str:
    return f"WITH RECURSIVE {_und(edges)}, {_bfs()}, {_result(normalization)} SELECT * FROM full_rows"


_DIRECTED = f"e AS ({STATES_DUCK}), arc AS MATERIALIZED (SELECT src u, dst v, min(weight) w FROM e WHERE src <> dst GROUP BY 1, 2), vtx AS (SELECT src id FROM e UNION SELECT dst FROM e)"


def _sssp(arcs: str = "arc") -> str:
    return f"""bfs(s, v, d) USING KEY (s, v) AS (SELECT id, id, CAST(0 AS BIGINT) FROM vtx
  UNION SELECT b.s, x.v, min(b.d + x.w) FROM bfs b JOIN {arcs} x ON x.u = b.v LEFT JOIN recurring.bfs o ON o.s = b.s AND o.v = x.v WHERE o.d IS NULL OR o.d > b.d + x.w GROUP BY 1, 2)"""


_REACH = "bfs(s, v, d) USING KEY (s, v) AS (SELECT id, id, 0 FROM vtx UNION SELECT b.s, x.v, min(b.d + 1) FROM bfs b JOIN arc x ON x.u = b.v LEFT JOIN recurring.bfs o ON o.s = b.s AND o.v = x.v WHERE o.d IS NULL GROUP BY 1, 2)"
_SCC = f"{_DIRECTED}, {_REACH}, comps AS (SELECT a.s id, min(a.v) comp FROM bfs a JOIN bfs b ON b.s = a.v AND b.v = a.s GROUP BY 1)"
_BRIDGES = "cross_arcs AS (SELECT a.comp s, b.comp t, u, v, w FROM arc JOIN comps a ON a.id = u JOIN comps b ON b.id = v WHERE a.comp <> b.comp)"


# queries


@query(f"WITH {_und(MARKET)} SELECT u id, count(*) degree FROM und GROUP BY 1")
def degree(spark, d):
    return checks.degrees(market(spark, d).canonical())


@query(f"WITH RECURSIVE {_und(GEO)}, {_bfs()}, c AS (SELECT s, min(v) c FROM bfs GROUP BY 1) SELECT (SELECT count(*) FROM vtx) n, (SELECT count(*) FROM e) m, (SELECT CAST(count(*) // 2 AS BIGINT) FROM und) unique_edges, (SELECT count(*) FROM e WHERE src = dst) self_loops, (SELECT count(*) FROM e) - (SELECT CAST(count(*) // 2 AS BIGINT) FROM und) duplicates, (SELECT count(DISTINCT c) FROM c) components")
def graph_check(spark, d):
    return checks.graph_report(geo(spark, d), Scratch(spark, "graph-check"))


@query(f"WITH RECURSIVE {_und(MARKET)}, {_bfs('SELECT DISTINCT u, u, 0 FROM und WHERE u = (SELECT min(id) FROM vtx)')} SELECT s source, v, CAST(d AS INTEGER) d FROM bfs")
def bfs_single_source(spark, d):
    g, scratch = market(spark, d).canonical(), Scratch(spark, "bfs")
    return bfs_pairs(scratch.cut(g.arcs()), g.vertices.agg(F.min("id").alias("id")), scratch)


@query(_closeness_sql(GEO, "classic"))
def closeness_classic(spark, d):
    return closeness(geo(spark, d), "bits", "classic")


@query(_closeness_sql(GEO, "wf"))
def closeness_wf(spark, d):
    return closeness(geo(spark, d), "bits", "wf")


@query(_closeness_sql(GEO, "reachable"))
def closeness_reachable(spark, d):
    return closeness(geo(spark, d), "bits", "reachable")


@query(_closeness_sql(GEO, "classic"))
def closeness_pairs(spark, d):
    return closeness(geo(spark, d), "pairs")


@query(_closeness_sql(MARKET, "wf"))
def closeness_msbfs(spark, d):
    return closeness(market(spark, d), "bits")


@query(_closeness_sql(MARKET, "wf"))
def closeness_blocks(spark, d):
    return closeness(market(spark, d), "blocks")


@query(_closeness_sql(GEO, "wf"))
def closeness_blocks_forest(spark, d):
    return closeness(geo(spark, d), "blocks")


@query(_closeness_sql(TRI, "classic"))
def closeness_r3r4(spark, d):
    return closeness(tri(spark, d), "reduced")


@query(f"""WITH {_und(TRI)}, k AS (SELECT u, count(*) k FROM und GROUP BY 1), p AS (SELECT a.u c, a.v x, b.v y FROM und a JOIN k ON k.u = a.u AND k.k IN (3, 4) JOIN und b ON b.u = a.u AND a.v < b.v JOIN und t ON t.u = a.v AND t.v = b.v),
t AS (SELECT c, z, count(*) n FROM (SELECT c, x z FROM p UNION ALL SELECT c, y FROM p) GROUP BY 1, 2), s AS (SELECT c, count(*) n, min(n) lo, max(n) hi FROM t GROUP BY 1)
SELECT c id, CASE WHEN k = 3 THEN 'r3' ELSE 'r4' END kind FROM s JOIN k ON k.u = c WHERE (k = 3 AND s.n = 3 AND lo = 2) OR (k = 4 AND s.n = 4 AND lo = 2 AND hi = 2)""")
def r3_r4_vertices(spark, d):
    return redundant_vertices(tri(spark, d).canonical())


@query(f"WITH RECURSIVE {_und(GEO)}, {_bfs()} SELECT s id, min(v) component FROM bfs GROUP BY 1")
def components(spark, d):
    return connected_components(geo(spark, d).edges)


@query(f"WITH {_und(GEO)}, b AS (SELECT u a, v b FROM und WHERE u < v) SELECT a block_a, b block_b, a v FROM b UNION ALL SELECT a, b, b FROM b")
def bcc_blocks(spark, d):
    scratch = Scratch(spark, "blocks")
    return biconnected.block_members(biconnected.edge_blocks(_kept(geo(spark, d), scratch), scratch))


@query(f"WITH {_und(GEO)} SELECT u v FROM und GROUP BY 1 HAVING count(*) > 1")
def articulation_points(spark, d):
    return biconnected.articulation_points(bcc_blocks(spark, d))


def _market_blocks(local_edges: int):
    def run(spark, d):
        scratch = Scratch(spark, "blocks")
        return biconnected.edge_blocks(_kept(market(spark, d), scratch), scratch, local_edges)

    return run


@query()
def bcc_edges_by_search(spark, d):
    return _market_blocks(1 << 40)(spark, d)


@query()
def bcc_edges_by_tables(spark, d):
    return _market_blocks(0)(spark, d)


@query(f"WITH {_und(GEO)}, b AS (SELECT u a, v b FROM und WHERE u < v), art AS (SELECT u FROM und GROUP BY 1 HAVING count(*) > 1) SELECT a block_a, b block_b, art.u art FROM b JOIN art ON art.u = a OR art.u = b")
def block_cut_tree(spark, d):
    return biconnected.block_cut_tree(Scratch(spark, "members").cut(bcc_blocks(spark, d)))


@query(f"WITH {_und(GEO)}, b AS (SELECT count(*) n FROM und WHERE u < v), nn AS (SELECT count(*) n FROM vtx) SELECT b.n blocks, CAST(2 AS BIGINT) largest, CAST(4 * b.n AS DOUBLE) / (CAST(nn.n AS DOUBLE) * nn.n) work_ratio, (SELECT count(*) FROM (SELECT u FROM und GROUP BY 1 HAVING count(*) > 1)) articulations FROM b, nn")
def block_stats(spark, d):
    return biconnected.block_stats(Scratch(spark, "members").cut(bcc_blocks(spark, d)), geo(spark, d).vertices.count())


@query(f"WITH RECURSIVE {_DIRECTED}, {_sssp()} SELECT s source, v, d FROM bfs")
def sssp_weighted(spark, d):
    g, scratch = states(spark, d).canonical(), Scratch(spark, "sssp")
    return shortest_paths(scratch.cut(g.edges), g.vertices, scratch)


@query(f"WITH RECURSIVE {_DIRECTED}, {_sssp()}, {_result('reachable')} SELECT * FROM full_rows")
def closeness_directed_weighted(spark, d):
    return closeness(states(spark, d), "weighted")


@query(f"WITH RECURSIVE {_SCC} SELECT id, comp FROM comps")
def scc(spark, d):
    scratch = Scratch(spark, "scc")
    return strong_components(_kept(states(spark, d), scratch), scratch)


def _condensed(spark, d):
    scratch = Scratch(spark, "condensation")
    g = _kept(states(spark, d), scratch)
    comps = scratch.cut(strong_components(g, scratch))
    return comps, scratch.cut(condensation(g, comps)), scratch


@query(f"WITH RECURSIVE {_SCC}, {_BRIDGES}, best AS (SELECT s, t, min(row(w, u, v)) b, count(*) bridges FROM cross_arcs GROUP BY 1, 2) SELECT s, t, b[2] eu, b[3] ev, b[1] weight, bridges FROM best")
def condensation_bridges(spark, d):
    return _condensed(spark, d)[1]


@query(f"WITH RECURSIVE {_SCC}, {_BRIDGES}, lev(c, l) USING KEY (c) AS (SELECT DISTINCT comp, 0 FROM comps UNION SELECT x.t, max(b.l + 1) FROM lev b JOIN (SELECT DISTINCT s, t FROM cross_arcs) x ON x.s = b.c LEFT JOIN recurring.lev o ON o.c = x.t WHERE o.l < b.l + 1 GROUP BY 1) SELECT c comp, CAST(l AS INTEGER) AS level FROM lev")
def topological_order(spark, d):
    comps, bridges, scratch = _condensed(spark, d)
    return topological_levels(comps, bridges, scratch)


def _chain(spark, d) -> DataFrame:
    return rows_of(spark, d, CHAIN, ("region",)).withColumn("op", F.lit("insert")).select("op", "src", "dst")


@query(_closeness_sql(f"{GEO}\nUNION ALL {CHAIN}", "reachable"))
def insert_batch_closeness(spark, d):
    return closeness(apply_updates(geo(spark, d), _chain(spark, d)), "bits", "reachable")


@query(f"WITH RECURSIVE {_und(GEO + chr(10) + 'UNION ALL ' + CHAIN)}, {_bfs()}, {_result('wf')} SELECT id, r, d FROM full_rows")
def refreshed_sums(spark, d):
    scratch, g = Scratch(spark, "refreshed"), geo(spark, d)
    before = scratch.cut(closeness(g, "bits", scratch=scratch))
    return refreshed(g, before, _chain(spark, d), scratch)


_GONE = _DIRECTED.replace("FROM e WHERE src <> dst GROUP BY", f"FROM e WHERE src <> dst AND NOT (src >= {HUB} AND dst < src AND dst >= {HUB}) GROUP BY")


@query(f"WITH RECURSIVE {_GONE}, {_sssp()}, {_result('reachable')} SELECT * FROM full_rows")
def delete_batch_closeness(spark, d):
    g = states(spark, d)
    gone = g.edges.where(f"src >= {HUB} AND dst >= {HUB} AND dst < src").select(F.lit("delete").alias("op"), "src", "dst", "weight")
    return closeness(apply_updates(g, gone), "weighted")


@query(f"WITH RECURSIVE {_und(MARKET)}, {_bfs('SELECT DISTINCT u, u, 0 FROM und WHERE u IN (0, 50)')}, t AS (SELECT v id, min(d) FILTER (s = 0) du, min(d) FILTER (s = 50) dv FROM bfs GROUP BY 1) SELECT id FROM t WHERE du IS NULL OR dv IS NULL OR abs(du - dv) > 1")
def affected_by_insert(spark, d):
    return affected_sources(market(spark, d), 0, 50, Scratch(spark, "affected"))


@query(_closeness_sql(GEO, "wf") + " ORDER BY closeness DESC, id LIMIT 10")
def top10_closeness(spark, d):
    return checks.top_k(closeness(geo(spark, d), "bits"))


def _methods(spark, d):
    # as tables: rows are used several times, and Spark may zip what is united by partitions that differ in number
    g, scratch = market(spark, d), Scratch(spark, "methods")
    return {m: scratch.cut(closeness(g, m, "wf")) for m in ("bits", "blocks")}


@query("SELECT 'bits' method_i, 'blocks' method_j, CAST(0 AS DOUBLE) mse")
def method_mse(spark, d):
    bits, blocks = (df.select(F.lit(m).alias("method"), "id", "closeness") for m, df in _methods(spark, d).items())
    return checks.method_mse(bits.unionByName(blocks))


@query(f"WITH {_und(MARKET)} SELECT count(*) compared, CAST(0 AS DOUBLE) max_error, true passed FROM vtx")
def max_abs_error(spark, d):
    return checks.max_abs_error(*_methods(spark, d).values())


@query(f"WITH {_und(MARKET)}, p AS (SELECT s_suppkey + 1000 src, CAST(100 + n_nationkey AS BIGINT) dst FROM supplier CROSS JOIN nation) SELECT src, dst, EXISTS (SELECT 1 FROM und WHERE u = src AND v = dst) present FROM p")
def edge_probes(spark, d):
    probes = rows_of(spark, d, "SELECT s_suppkey + 1000 AS src, CAST(100 + n_nationkey AS BIGINT) AS dst FROM supplier CROSS JOIN nation", ("supplier", "nation"))
    return checks.edges_present(market(spark, d), probes)


def _generated(name: str, make, sql: str):
    def run(spark, d):
        return checks.graph_report(make(spark), Scratch(spark, name))

    run.__name__ = name
    query(sql)(run)


_generated("generated_connected", lambda s: generate.connected(s, 200, 400), "SELECT CAST(200 AS BIGINT) n, CAST(400 AS BIGINT) m, CAST(400 AS BIGINT) unique_edges, CAST(0 AS BIGINT) self_loops, CAST(0 AS BIGINT) duplicates, CAST(1 AS BIGINT) components")


@query("SELECT CAST(9 AS BIGINT) blocks, CAST(40 AS BIGINT) largest, CAST(5 * 1600 + 4 * 4 AS DOUBLE) / 40000 work_ratio, CAST(8 AS BIGINT) articulations")
def generated_blocks(spark, d):
    scratch = Scratch(spark, "generated")
    g = _kept(generate.blocks_in_a_row(spark, 200, 500, blocks=5), scratch)
    return biconnected.block_stats(biconnected.block_members(biconnected.edge_blocks(g, scratch)), 200)


@query("SELECT CAST(8 AS BIGINT) components, CAST(7 AS BIGINT) bridges, CAST(0.125 AS DOUBLE) work_ratio")
def generated_cliques(spark, d):
    scratch = Scratch(spark, "cliques")
    g = _kept(generate.chain_of_cliques(spark), scratch)
    comps = scratch.cut(strong_components(g, scratch))
    sizes = comps.groupBy("comp").agg(F.count("*").alias("k")).agg(F.count("*").alias("components"), (F.sum(F.col("k") * F.col("k")) / F.lit(48.0 * 48)).alias("work_ratio"))
    return sizes.crossJoin(condensation(g, comps).agg(F.sum("bridges").alias("bridges"))).select("components", "bridges", "work_ratio")
