"""Registered queries: every operator over a named graph, and the same in DuckDB's SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import GRAPHS, TABLES, load
from .graph import Graph
from .operators import approximation as ap
from .operators import centrality as ce
from .operators import community as cm
from .operators import components as co
from .operators import generators as ge
from .operators import links as li
from .operators import metrics as me
from .operators import mst as ms
from .operators import parallel as px
from .operators import paths as pa
from .operators import subgraphs as sg
from .operators import traversal as tr
from .operators import validation as va
from .plans.tables import Steps
from .sources import store, text
from .streaming import edges as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Operator and graph of the queries over a named graph, for use on a graph that is stored already.
OPERATORS: dict[str, tuple[Callable[[Graph], DataFrame], str]] = {}
ORACLE_SQL: dict[str, str] = {}


def _with(name: str) -> str:
    """Common table expressions of a graph: v (id, attr), e (eid, src, dst, weight), a (out-arcs), y (arcs both ways)."""
    vertices, edges, directed = GRAPHS[name]
    plain = {t: t for t in TABLES}
    both = "SELECT src, dst, weight, eid FROM e UNION ALL SELECT dst, src, weight, eid FROM e WHERE src <> dst"
    return f"""WITH RECURSIVE v AS MATERIALIZED ({vertices.format(**plain)}),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, weight FROM ({edges.format(**plain)}) z),
y AS MATERIALIZED ({both}), a AS MATERIALIZED ({"SELECT src, dst, weight, eid FROM e" if directed else both}),
n AS MATERIALIZED (SELECT DISTINCT src, dst FROM a)
"""


def query(name: str, graph: str | None = "supplier_co", sql: str | None = None):
    """Registers ``f(graph)`` (or ``f(spark, sf_dir)`` without a graph) and its SQL, which may use the graph's expressions."""

    def put(f):
        QUERIES[name] = f if graph is None else lambda spark, sf_dir: f(load(spark, sf_dir, graph))
        if graph is not None:
            OPERATORS[name] = (f, graph)
        if sql is not None:
            ORACLE_SQL[name] = sql if graph is None else _with(graph) + sql
        return f

    return put


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    # A zero, which most scores of pairs are, takes no decimal arithmetic.
    return df.withColumns({c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.round(c, digits)) for c in cols})


def _least(g: Graph) -> int:
    return g.vertices.agg(F.min("id")).first()[0]


# --------------------------------------------------------------------------- sizes, degrees, matrices

query("graph_counts", sql="SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT 2.0 * count(*) FROM e) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)) AS density")(lambda g: g.density_frame())
query("graph_scan", sql="SELECT eid, src, dst, weight FROM e")(lambda g: g.edges)
query("graph_weights", sql="SELECT min(weight) AS min_weight, max(weight) AS max_weight, sum(weight) AS total_weight FROM e")(lambda g: g.weight_stats())
query("degrees", sql="SELECT id, count(src) AS degree FROM v LEFT JOIN a ON src = id GROUP BY id")(lambda g: g.degrees())
query("degrees_directed", "nation_trade", "SELECT id, count(src) AS degree FROM v LEFT JOIN (SELECT src FROM e UNION ALL SELECT dst FROM e) ON src = id GROUP BY id")(lambda g: g.degrees())
query("in_degrees", "nation_trade", "SELECT id, count(dst) AS in_degree FROM v LEFT JOIN e ON dst = id GROUP BY id")(lambda g: g.in_degrees())
query("out_degrees", "nation_trade", "SELECT id, count(src) AS out_degree FROM v LEFT JOIN e ON src = id GROUP BY id")(lambda g: g.out_degrees())
query("degree_centrality", sql="SELECT id, count(x)::DOUBLE AS degree FROM v LEFT JOIN (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) ON x = id GROUP BY id")(ce.degree_centrality)
query("in_degree_centrality", "nation_trade", "SELECT id, count(dst)::DOUBLE AS degree FROM v LEFT JOIN e ON dst = id GROUP BY id")(ce.in_degree_centrality)
query("out_degree_centrality", "nation_trade", "SELECT id, count(src)::DOUBLE AS degree FROM v LEFT JOIN e ON src = id GROUP BY id")(ce.out_degree_centrality)
query("degrees_parallel", sql="SELECT id, count(src) AS degree FROM v LEFT JOIN a ON src = id GROUP BY id")(px.degrees_parallel)
query("adjacency_matrix", sql="SELECT src AS row, dst AS col, arg_max(weight, eid) AS weight FROM a GROUP BY ALL")(lambda g: g.adjacency_matrix())
query("sparse_adjacency_matrix", "nation_trade", "SELECT src AS row, dst AS col, sum(weight) AS weight FROM a GROUP BY ALL")(lambda g: g.sparse_adjacency_matrix())
query("matrix_round_trip", sql="SELECT eid, src, dst, weight FROM e")(lambda g: Graph.from_matrix(g.adjacency_matrix()).edges)
query("flow_arcs", "nation_trade", "SELECT eid, src, dst, weight FROM e")(lambda g: g.arcs("flow"))
query("neighbors", sql="SELECT dst AS id FROM a WHERE src = (SELECT min(id) FROM v)")(lambda g: g.neighbors(_least(g)))
query("incoming_neighbors", "nation_trade", "SELECT src AS id FROM e WHERE dst = (SELECT min(id) FROM v)")(lambda g: g.incoming_neighbors(_least(g)))
query("outgoing_edges", sql="SELECT dst AS target, weight FROM a WHERE src = (SELECT min(id) FROM v)")(lambda g: g.outgoing_edges(_least(g)))
query("map_weights", sql="SELECT eid, src, dst, weight * 2 + 1 AS weight FROM e")(lambda g: g.map_edge_weights("weight * 2 + 1").edges)
query("map_attrs", sql="SELECT id, attr * 10 AS attr FROM v")(lambda g: g.map_node_attrs("attr * 10").vertices)

# --------------------------------------------------------------------------- changes and parts

query("retain_nodes", sql="SELECT eid, src, dst, weight FROM e WHERE src % 3 <> 0 AND dst % 3 <> 0")(lambda g: g.retain_nodes("id % 3 <> 0").edges)
query("retain_edges", sql="SELECT eid, src, dst, weight FROM e WHERE weight > (SELECT avg(weight) FROM e)")(lambda g: g.retain_edges(F.col("weight") > g.edges.agg(F.avg("weight")).first()[0]).edges)
query("remove_nodes", sql="SELECT eid, src, dst, weight FROM e WHERE src % 5 <> 0 AND dst % 5 <> 0")(lambda g: g.remove_nodes(g.vertices.filter("id % 5 = 0")).edges)
query("update_nodes", sql="SELECT id, CASE WHEN id % 2 = 0 THEN -1 ELSE attr END::BIGINT AS attr FROM v")(lambda g: g.update_nodes(g.vertices.filter("id % 2 = 0").select("id", F.lit(-1).cast("long").alias("attr"))).vertices)
query("add_edges_if_absent", sql="SELECT src, dst FROM e UNION SELECT v.id, v.id + 1 FROM v WHERE id + 1 IN (SELECT id FROM v) AND NOT EXISTS (SELECT 1 FROM e WHERE src = v.id AND dst = v.id + 1)")(
    lambda g: g.add_edges_if_absent(g.vertices.select("id").join(g.vertices.select((F.col("id") - 1).alias("id")), "id", "left_semi").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))).edges.select("src", "dst")
)
query("add_nodes", sql="SELECT id, attr FROM v UNION ALL SELECT (SELECT max(id) FROM v) + 1, 7 UNION ALL SELECT (SELECT max(id) FROM v) + 2, 8")(lambda g: g.add_nodes([7, 8])[0].vertices)
query("relabel", sql="SELECT e.eid, s.k AS src, d.k AS dst, e.weight FROM e JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) s ON s.id = src JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) d ON d.id = dst")(lambda g: g.relabel().edges)
query("subgraph", sql="SELECT eid, src, dst, weight FROM e WHERE src IN (SELECT id FROM v WHERE attr >= 10) AND dst IN (SELECT id FROM v WHERE attr >= 10)")(lambda g: sg.subgraph(g, g.vertices.filter("attr >= 10")).edges)
query("filter_nodes", sql="SELECT eid, src, dst, weight FROM e WHERE (SELECT attr FROM v WHERE id = src) < 12 AND (SELECT attr FROM v WHERE id = dst) < 12")(lambda g: sg.filter_nodes(g, "attr < 12").edges)
query("filter_edges", sql="SELECT eid, src, dst, weight FROM e WHERE weight >= 5")(lambda g: sg.filter_edges(g, "weight >= 5").edges)

_HOPS = """, h(src, id, depth) AS (
  SELECT id, id, 0 FROM v {start} UNION SELECT h.src, a.dst, h.depth + 1 FROM h JOIN a ON a.src = h.id WHERE h.depth < {most}),
d AS MATERIALIZED (SELECT src, id, min(depth)::BIGINT AS depth FROM h GROUP BY src, id)
"""
_ONE, _ALL = "WHERE id = (SELECT min(id) FROM v)", ""
_FAR = 12

query("ego_graph", sql=_HOPS.format(start=_ONE, most=2) + "SELECT eid, e.src, e.dst, weight FROM e WHERE e.src IN (SELECT id FROM d) AND e.dst IN (SELECT id FROM d)")(lambda g: sg.ego_graph(g, _least(g), 2).edges)
query("k_hop_neighbors", sql=_HOPS.format(start=_ONE, most=2) + "SELECT id FROM d")(lambda g: sg.k_hop_neighbors(g, _least(g), 2))
query("connected_component", sql=_HOPS.format(start=_ONE, most=_FAR) + "SELECT id FROM d")(lambda g: sg.connected_component(g, _least(g)))
query("component_subgraph", "geo_tree", _HOPS.format(start=_ONE, most=_FAR) + "SELECT eid, e.src, e.dst, weight FROM e WHERE e.src IN (SELECT id FROM d) AND e.dst IN (SELECT id FROM d)")(lambda g: sg.component_subgraph(g, _least(g)).edges)

# --------------------------------------------------------------------------- traversal and hops

query("bfs", sql=_HOPS.format(start=_ONE, most=_FAR) + "SELECT id, depth FROM d")(lambda g: tr.bfs(g, _least(g)))
query("bfs_directed", "geo_tree", _HOPS.format(start=_ONE, most=_FAR) + "SELECT id, depth FROM d")(lambda g: tr.bfs(g, _least(g), plan="distributed"))
query("bfs_parallel", sql=_HOPS.format(start="WHERE id IN (SELECT id FROM v ORDER BY id LIMIT 3)", most=_FAR) + "SELECT src, id, depth FROM d")(lambda g: px.bfs_parallel(g, [r[0] for r in g.vertices.select("id").orderBy("id").limit(3).collect()]))
query("dfs", sql=_HOPS.format(start=_ONE, most=_FAR) + "SELECT id FROM d")(lambda g: tr.dfs(g, _least(g)).select("id"))
query("iddfs_length", sql=_HOPS.format(start=_ONE, most=6) + "SELECT id, depth FROM d WHERE id = (SELECT max(id) FROM v)")(
    lambda g: g.spark.createDataFrame([(p[-1], len(p) - 1) for p in [tr.iddfs(g, _least(g), g.vertices.agg(F.max("id")).first()[0], 6)] if p], "id long, depth long")
)
query("bidirectional_search_length", sql=_HOPS.format(start=_ONE, most=_FAR) + "SELECT id, depth FROM d WHERE id = (SELECT max(id) FROM v)")(
    lambda g: g.spark.createDataFrame([(p[-1], len(p) - 1) for p in [tr.bidirectional_search(g, _least(g), g.vertices.agg(F.max("id")).first()[0])] if p], "id long, depth long")
)
query("all_pairs_hops", sql=_HOPS.format(start=_ALL, most=_FAR) + "SELECT src, id, depth FROM d")(pa.all_pairs_shortest_path_length)
query("shortest_paths_parallel", sql=_HOPS.format(start=_ONE, most=_FAR) + "SELECT src, id, depth FROM d")(lambda g: px.shortest_paths_parallel(g, [_least(g)]))
query("all_pairs_parallel", "geo_tree", _HOPS.format(start=_ALL, most=_FAR) + "SELECT src, id, depth FROM d")(px.all_pairs_shortest_path_length_parallel)
query("local_reaching_centrality", sql=_HOPS.format(start=_ALL, most=2) + "SELECT src AS id, count(*)::DOUBLE AS reach FROM d GROUP BY src")(lambda g: ce.local_reaching_centrality(g, 2))
query("global_reaching_centrality", "geo_tree", _HOPS.format(start=_ALL, most=_FAR) + "SELECT src AS id, count(*)::DOUBLE AS reach FROM d GROUP BY src")(ce.global_reaching_centrality)
query(
    "distances_summary",
    sql=_HOPS.format(start=_ALL, most=_FAR)
    + """SELECT CASE WHEN ok THEN dia END AS diameter, CASE WHEN ok THEN rad END AS radius, CASE WHEN ok THEN apl END AS average_path_length FROM (
  SELECT min(r) = (SELECT count(*) FROM v) AS ok, max(m) AS dia, min(m) AS rad, round(sum(t) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 6) AS apl
  FROM (SELECT src, count(*) AS r, max(depth) AS m, sum(depth) AS t FROM d GROUP BY src))""",
)(lambda g: _round(me.distance_frame(g), "average_path_length"))

# --------------------------------------------------------------------------- weighted paths

_DIST = """, w(src, id, dist) USING KEY (src, id) AS (
  SELECT id, id, 0.0::DOUBLE FROM v {start}
  UNION (SELECT w.src, a.dst, min(w.dist + a.weight) FROM w JOIN a ON a.src = w.id LEFT JOIN recurring.w r ON r.src = w.src AND r.id = a.dst
         WHERE r.dist IS NULL OR w.dist + a.weight < r.dist GROUP BY w.src, a.dst))
"""
query("dijkstra", sql=_DIST.format(start=_ONE) + "SELECT v.id, dist FROM v LEFT JOIN w ON w.id = v.id")(lambda g: pa.dijkstra(g, _least(g)).select("id", "dist"))
query("dijkstra_cutoff", sql=_DIST.format(start=_ONE) + "SELECT v.id, dist FROM v LEFT JOIN w ON w.id = v.id AND dist <= 8")(lambda g: pa.dijkstra(g, _least(g), cutoff=8.0).select("id", "dist"))
query("dijkstra_distributed", sql=_DIST.format(start=_ONE) + "SELECT v.id, dist FROM v LEFT JOIN w ON w.id = v.id")(lambda g: pa.dijkstra(g, _least(g), plan="distributed").select("id", "dist"))
_TIGHT = _DIST.format(start=_ONE) + """, tight AS MATERIALIZED (SELECT a.src, a.dst FROM a JOIN w x ON x.id = a.src JOIN w z ON z.id = a.dst WHERE z.dist = x.dist + a.weight),
hop(id, k) AS (SELECT id, 0 FROM v WHERE id = (SELECT min(id) FROM v) UNION SELECT dst, k + 1 FROM hop JOIN tight ON src = id WHERE k < 24), few AS MATERIALIZED (SELECT id, min(k) AS k FROM hop GROUP BY id)
SELECT v.id, dist, (SELECT min(t.src) FROM tight t JOIN few p ON p.id = t.src WHERE t.dst = v.id AND p.k = few.k - 1) AS pred FROM v LEFT JOIN w ON w.id = v.id LEFT JOIN few ON few.id = v.id"""
query("dijkstra_pred", sql=_TIGHT)(lambda g: pa.dijkstra(g, _least(g)))
query("dijkstra_pred_distributed", sql=_TIGHT)(lambda g: pa.dijkstra(g, _least(g), plan="distributed"))
#: 2**53 + 1, which no double holds.
_WIDE = 9007199254740993
query("dijkstra_whole", sql=_DIST.format(start=_ONE) + f"SELECT v.id, dist::BIGINT * {_WIDE} AS dist FROM v LEFT JOIN w ON w.id = v.id")(lambda g: pa.dijkstra(g, _least(g), cost=f"cast(weight as bigint) * {_WIDE}").select("id", "dist"))
query("ida_star_cost", "nation_trade", _DIST.format(start=_ONE) + "SELECT id, dist FROM w WHERE id = (SELECT max(id) FROM v)")(
    lambda g: g.spark.createDataFrame([(p[1][-1], p[0]) for p in [pa.ida_star(g, _least(g), g.vertices.agg(F.max("id")).first()[0], F.lit(0.0))]], "id long, dist double")
)
query("bellman_ford", sql=_DIST.format(start=_ONE) + "SELECT v.id, dist FROM v LEFT JOIN w ON w.id = v.id")(lambda g: pa.bellman_ford(g, _least(g)))
query("shortest_path_cost", sql=_DIST.format(start=_ONE) + "SELECT id, dist FROM w WHERE id = (SELECT max(id) FROM v)")(
    lambda g: g.spark.createDataFrame([(p[1][-1], p[0]) for p in [pa.shortest_path(g, _least(g), g.vertices.agg(F.max("id")).first()[0])] if p], "id long, dist double")
)
query("a_star_cost", sql=_DIST.format(start=_ONE) + "SELECT id, dist FROM w WHERE id = (SELECT max(id) FROM v)")(
    lambda g: g.spark.createDataFrame([(p[1][-1], p[0]) for p in [pa.a_star(g, _least(g), g.vertices.agg(F.max("id")).first()[0], F.lit(0.0))] if p], "id long, dist double")
)
query("floyd_warshall", "nation_trade", _DIST.format(start=_ALL) + "SELECT src, id, dist FROM w")(pa.floyd_warshall)
query("johnson", "nation_trade", _DIST.format(start=_ALL) + "SELECT src, id, dist FROM w")(lambda g: pa.johnson(g))
query("closeness_centrality", sql=_DIST.format(start=_ALL) + "SELECT v.id, coalesce(round(r / s * r / ((SELECT count(*) FROM v) - 1), 6), 0) AS closeness FROM v LEFT JOIN (SELECT src, count(*) AS r, sum(dist) AS s FROM w WHERE dist > 0 GROUP BY src) x ON x.src = v.id")(lambda g: _round(ce.closeness_centrality(g), "closeness"))
query("closeness_parallel", "nation_trade", _DIST.format(start=_ALL) + "SELECT v.id, coalesce(round(r / s * r / ((SELECT count(*) FROM v) - 1), 6), 0) AS closeness FROM v LEFT JOIN (SELECT src, count(*) AS r, sum(dist) AS s FROM w WHERE dist > 0 GROUP BY src) x ON x.src = v.id")(lambda g: _round(px.closeness_centrality_parallel(g), "closeness"))
query("harmonic_centrality", sql=_DIST.format(start=_ALL) + "SELECT v.id, coalesce(round(s, 6), 0) AS harmonic FROM v LEFT JOIN (SELECT src, sum(1 / dist) AS s FROM w WHERE dist > 0 GROUP BY src) x ON x.src = v.id")(lambda g: _round(ce.harmonic_centrality(g), "harmonic"))

_SIGMA = (
    _HOPS.format(start=_ALL, most=_FAR)
    + ", g0 AS MATERIALIZED (SELECT id AS src, id, 1.0::DOUBLE AS sigma, 0 AS k FROM v)"
    + "".join(f", g{k + 1} AS MATERIALIZED (SELECT x.src, a.dst AS id, sum(x.sigma) AS sigma, {k + 1} AS k FROM g{k} x JOIN a ON a.src = x.id JOIN d ON d.src = x.src AND d.id = a.dst AND d.depth = {k + 1} GROUP BY x.src, a.dst)" for k in range(_FAR))
    + ", g AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM g{k}" for k in range(_FAR + 1)) + ")\n"
)
query("betweenness_centrality", sql=_SIGMA + "SELECT v.id, coalesce(round(b, 6), 0) AS betweenness FROM v LEFT JOIN (SELECT x.id, sum(x.sigma * y.sigma / z.sigma) / ((SELECT count(*) FROM v) - 1) / ((SELECT count(*) FROM v) - 2) AS b FROM g x JOIN g y ON y.src = x.id JOIN g z ON z.src = x.src AND z.id = y.id AND z.k = x.k + y.k WHERE x.k > 0 AND y.k > 0 GROUP BY x.id) t ON t.id = v.id")(lambda g: _round(ce.betweenness_centrality(g, True), "betweenness"))
query("edge_betweenness_centrality", sql=_SIGMA + "SELECT n.src AS u, n.dst AS v, coalesce(round(b, 6), 0) AS betweenness FROM n LEFT JOIN (SELECT a.src, a.dst, sum(x.sigma * y.sigma / z.sigma) AS b FROM a JOIN g x ON x.id = a.src JOIN g y ON y.src = a.dst JOIN g z ON z.src = x.src AND z.id = y.id AND z.k = x.k + 1 + y.k GROUP BY a.src, a.dst) t ON t.src = n.src AND t.dst = n.dst")(lambda g: _round(ce.edge_betweenness_centrality(g), "betweenness"))

# --------------------------------------------------------------------------- power iterations

#: Most steps of PageRank by default.
_STEPS = 100


def _rank_sql(weight: str, restart: str, change: str) -> str:
    """All steps, and the first after which the change is below the default tolerance."""
    flow = "SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e"
    head = f""", f AS MATERIALIZED (SELECT src, dst, {weight} AS weight FROM ({flow})), o AS MATERIALIZED (SELECT src, sum(weight) AS o FROM f GROUP BY src),
t AS MATERIALIZED (SELECT f.src, dst, weight / o AS w FROM f JOIN o ON o.src = f.src), q AS MATERIALIZED (SELECT id, {restart} AS q FROM v), x0 AS MATERIALIZED (SELECT id, q AS x FROM q)"""
    step = "".join(
        f""", x{k + 1} AS MATERIALIZED (SELECT q.id, 0.15 * q + 0.85 * (coalesce(s, 0) + (SELECT coalesce(sum(x), 0) FROM x{k} WHERE id NOT IN (SELECT src FROM o)) * q) AS x
FROM q LEFT JOIN (SELECT dst, sum(w * x) AS s FROM t JOIN x{k} ON id = src GROUP BY dst) z ON z.dst = q.id)"""
        for k in range(_STEPS)
    )
    every = " UNION ALL ".join(f"SELECT {k + 1} AS k, id, b.x, abs(b.x - a.x) AS d FROM x{k} a JOIN x{k + 1} b USING (id)" for k in range(_STEPS))
    return head + step + f""", xs AS MATERIALIZED ({every})
SELECT id, round(x, 6) AS pagerank FROM xs WHERE k = coalesce((SELECT min(k) FROM (SELECT k FROM xs GROUP BY k HAVING {change}(d) < 1e-6)), {_STEPS})"""


_EVEN = "1.0::DOUBLE / (SELECT count(*) FROM v)"
query("pagerank", sql=_rank_sql("weight", _EVEN, "sum"))(lambda g: _round(ce.pagerank(g), "pagerank"))
query("pagerank_distributed", sql=_rank_sql("weight", _EVEN, "sum"))(lambda g: _round(ce.pagerank(g, plan="distributed"), "pagerank"))
query("pagerank_parallel", sql=_rank_sql("1.0", _EVEN, "max"))(lambda g: _round(px.pagerank_parallel(g), "pagerank"))
query("personalized_pagerank", sql=_rank_sql("weight", "(id % 3) / (SELECT sum(id % 3) FROM v)::DOUBLE", "sum"))(lambda g: _round(ce.personalized_pagerank(g, g.vertices.select("id", (F.col("id") % 3).cast("double").alias("value"))), "pagerank"))
query(
    "katz_centrality",
    sql=", x0 AS MATERIALIZED (SELECT id, 0.0::DOUBLE AS x FROM v)"
    + "".join(f", x{k + 1} AS MATERIALIZED (SELECT v.id, 0.0001 * coalesce(s, 0) + 1 AS x FROM v LEFT JOIN (SELECT src, sum(weight * x) AS s FROM a JOIN x{k} ON id = dst GROUP BY src) z ON z.src = v.id)" for k in range(40))
    + " SELECT id, round(x, 6) AS katz FROM x40",
)(lambda g: _round(ce.katz_centrality(g, alpha=0.0001, tol=1e-9), "katz"))
query(
    "eigenvector_centrality",
    sql=", x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS x FROM v)"
    + "".join(
        f", y{k} AS MATERIALIZED (SELECT v.id, coalesce(s, 0) + x AS y FROM v JOIN x{k} ON x{k}.id = v.id LEFT JOIN (SELECT dst, sum(weight * x) AS s FROM a JOIN x{k} ON id = src GROUP BY dst) z ON z.dst = v.id), x{k + 1} AS MATERIALIZED (SELECT id, y / (SELECT sqrt(sum(y * y)) FROM y{k}) AS x FROM y{k})"
        for k in range(150)
    )
    + " SELECT id, round(x * (SELECT count(*) FROM v) / (SELECT sum(x) FROM x150), 4) AS eigenvector FROM x150",
)(lambda g: _round(ce.eigenvector_centrality(g, tol=1e-10), "eigenvector", digits=4))
query("laplacian_centrality", sql=", k AS (SELECT id, count(src) AS k FROM v LEFT JOIN a ON src = id GROUP BY id) SELECT k.id, (k * k + k + 2 * coalesce(s, 0))::DOUBLE AS laplacian FROM k LEFT JOIN (SELECT src, sum(k) AS s FROM a JOIN k ON id = dst GROUP BY src) z ON z.src = k.id")(ce.laplacian_centrality)
_VOTES = 10
query(
    "voterank",
    sql=", k0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS ability, false AS taken FROM v), l AS MATERIALIZED (SELECT (SELECT count(*) FROM v)::DOUBLE / count(*) AS loss FROM a)"
    + "".join(
        f""", b{k} AS MATERIALIZED (SELECT d.id, round(sum(s.ability), 9) AS score FROM k{k} d JOIN a ON a.dst = d.id JOIN k{k} s ON s.id = a.src WHERE NOT d.taken GROUP BY d.id HAVING round(sum(s.ability), 9) > 0 ORDER BY score DESC, d.id LIMIT 1),
k{k + 1} AS MATERIALIZED (SELECT x.id, CASE WHEN x.id IN (SELECT id FROM b{k}) THEN 0.0 ELSE greatest(0.0, ability - coalesce(n, 0) * (SELECT loss FROM l)) END AS ability, taken OR x.id IN (SELECT id FROM b{k}) AS taken
FROM k{k} x LEFT JOIN (SELECT dst, count(*) AS n FROM a WHERE src IN (SELECT id FROM b{k}) GROUP BY dst) z ON z.dst = x.id)"""
        for k in range(_VOTES)
    )
    + "\n"
    + " UNION ALL ".join(f"SELECT {k}::BIGINT AS rank, id FROM b{k}" for k in range(_VOTES)),
)(lambda g: ce.voterank(g, _VOTES))

# --------------------------------------------------------------------------- metrics and links

_TRI = ", u AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), t AS MATERIALIZED (SELECT x.a AS x, x.b AS y, z.b AS z FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b), tc AS MATERIALIZED (SELECT id, count(k) AS triangles FROM v LEFT JOIN (SELECT unnest([x, y, z]) AS k FROM t) ON k = id GROUP BY id), dg AS MATERIALIZED (SELECT id, count(src) AS k FROM v LEFT JOIN y ON src = id GROUP BY id)\n"
query("triangles", sql=_TRI + "SELECT id, triangles FROM tc")(me.triangles)
query("triangles_parallel", "nation_trade", _TRI + "SELECT id, triangles FROM tc")(px.triangles_parallel)
query("clustering_coefficients", sql=_TRI + "SELECT id, CASE WHEN k >= 2 THEN round(2.0 * triangles / (k * (k - 1)), 6) ELSE 0 END::DOUBLE AS clustering FROM tc JOIN dg USING (id)")(lambda g: _round(me.clustering_coefficients(g), "clustering"))
query("clustering_parallel", "nation_trade", _TRI + "SELECT id, CASE WHEN k >= 2 THEN round(2.0 * triangles / (k * (k - 1)), 6) ELSE 0 END::DOUBLE AS clustering FROM tc JOIN dg USING (id)")(lambda g: _round(px.clustering_coefficients_parallel(g), "clustering"))
query("average_clustering", sql=_TRI + "SELECT round(avg(CASE WHEN k >= 2 THEN 2.0 * triangles / (k * (k - 1)) ELSE 0 END), 6) AS average_clustering FROM tc JOIN dg USING (id)")(lambda g: _round(me.average_clustering_frame(g), "average_clustering"))
query("average_clustering_approx", sql=_TRI + "SELECT round(coalesce(avg(2.0 * triangles / (k * (k - 1))), 0), 6) AS average_clustering FROM tc JOIN dg USING (id) WHERE k >= 2")(lambda g: _round(ap.average_clustering(g), "average_clustering"))
query("transitivity", sql=_TRI + ", p AS (SELECT (sum(k * (k - 1)) / 2)::BIGINT AS triples FROM dg) SELECT (SELECT count(*) FROM t) AS triangles, triples, round(3.0 * (SELECT count(*) FROM t) / triples, 6) AS transitivity FROM p")(lambda g: _round(me.transitivity_frame(g), "transitivity"))
query("assortativity", sql=_TRI + "SELECT round((n * jk - j * j) / (n * jj - j * j), 6) AS assortativity FROM (SELECT count(*) AS n, sum(p.k)::DOUBLE AS j, sum(p.k * q.k)::DOUBLE AS jk, sum(p.k * p.k)::DOUBLE AS jj FROM y JOIN dg p ON p.id = y.src JOIN dg q ON q.id = y.dst)")(lambda g: _round(me.assortativity_frame(g), "assortativity"))

_PAIR = ", p AS MATERIALIZED (SELECT x.id AS u, y.id AS v FROM v x JOIN v y ON x.id < y.id), dg AS MATERIALIZED (SELECT id, count(src) AS k FROM v LEFT JOIN n ON src = id GROUP BY id), c AS MATERIALIZED (SELECT x.src AS u, y.src AS v, x.dst AS w FROM n x JOIN n y ON y.dst = x.dst AND x.src < y.src)\n"


def _pair_sql(score: str, more: str = "", default: str = "0.0") -> str:
    return _PAIR + f"SELECT p.u, p.v, coalesce(s, {default}) AS score FROM p LEFT JOIN (SELECT c.u, c.v, {score} AS s FROM c JOIN dg du ON du.id = c.u JOIN dg dv ON dv.id = c.v JOIN dg dw ON dw.id = c.w {more} GROUP BY c.u, c.v) z ON z.u = p.u AND z.v = p.v"


_IN = "WHERE c.u % 4 = c.v % 4 AND c.u % 4 = c.w % 4"
query("jaccard_coefficient", sql=_pair_sql("round(count(*) / (any_value(du.k) + any_value(dv.k) - count(*)), 6)"))(lambda g: _round(li.jaccard_coefficient(g), "score"))
query("adamic_adar_index", sql=_pair_sql("round(sum(1 / ln(dw.k)), 6)", "AND dw.k > 1"))(lambda g: _round(li.adamic_adar_index(g), "score"))
query("resource_allocation_index", sql=_pair_sql("round(sum(1.0 / dw.k), 6)"))(lambda g: _round(li.resource_allocation_index(g), "score"))
query("common_neighbors", sql=_pair_sql("count(*)", default="0"))(li.common_neighbors)
query("common_neighbors_nonzero", sql=_PAIR + "SELECT u, v, count(*) AS score FROM c GROUP BY u, v")(lambda g: li.common_neighbors(g, nonzero=True))
query("common_neighbors_of_pair", sql=_PAIR + "SELECT p.u, p.v, coalesce(s, 0) AS score FROM p LEFT JOIN (SELECT u, v, count(*) AS s FROM c GROUP BY u, v) z ON z.u = p.u AND z.v = p.v WHERE p.u = (SELECT min(id) FROM v) AND p.v = (SELECT max(id) FROM v)")(
    lambda g: li.common_neighbors(g, g.vertices.agg(F.min("id").alias("u"), F.max("id").alias("v")))
)
query("preferential_attachment", sql=_PAIR + "SELECT p.u, p.v, (x.k * y.k)::DOUBLE AS score FROM p JOIN dg x ON x.id = p.u JOIN dg y ON y.id = p.v")(li.preferential_attachment)
query("common_neighbor_centrality", sql=_pair_sql("round(pow(count(*), 0.8), 6)"))(lambda g: _round(li.common_neighbor_centrality(g), "score"))
query("cn_soundarajan_hopcroft", sql=_pair_sql("count(*)::DOUBLE", _IN))(lambda g: li.cn_soundarajan_hopcroft(g, "id % 4"))
query("ra_index_soundarajan_hopcroft", sql=_pair_sql("round(sum(1.0 / dw.k), 6)", _IN))(lambda g: _round(li.ra_index_soundarajan_hopcroft(g, "id % 4"), "score"))
query("within_inter_cluster", sql=_pair_sql("round((count(*) FILTER (c.u % 4 = c.v % 4 AND c.u % 4 = c.w % 4) + 0.001) / (count(*) FILTER (NOT (c.u % 4 = c.v % 4 AND c.u % 4 = c.w % 4)) + 0.001), 6)", default="1.0"))(lambda g: _round(li.within_inter_cluster(g, "id % 4"), "score"))

# --------------------------------------------------------------------------- components and validation

_WEAK = ", r(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, y.dst FROM r JOIN y ON y.src = r.b), wc AS MATERIALIZED (SELECT a AS id, min(b) AS component FROM r GROUP BY a)\n"
_STRONG = ", r(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)\n"
query("connected_components", "geo_tree", _WEAK + "SELECT id, component FROM wc")(co.connected_components)
query("connected_components_distributed", "geo_tree", _WEAK + "SELECT id, component FROM wc")(lambda g: co.connected_components(g, plan="distributed"))
query("connected_components_map", "geo_tree", _WEAK + "SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS component FROM wc")(co.connected_components_map)
query("connected_components_parallel", "geo_tree", _WEAK + "SELECT id, dense_rank() OVER (ORDER BY component) - 1 AS component FROM wc")(px.connected_components_parallel)
query("component_sizes", "geo_tree", _WEAK + "SELECT component, count(*) AS size FROM wc GROUP BY component")(lambda g: px.connected_components_parallel_list(g).drop("members"))
query("weakly_connected_components", "nation_trade", _WEAK + "SELECT id, component FROM wc")(co.weakly_connected_components)
query("strongly_connected_components", "nation_trade", _STRONG + "SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")(co.strongly_connected_components)
query("strongly_connected_distributed", "nation_trade", _STRONG + "SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")(lambda g: co.strongly_connected_components(g, plan="distributed"))
query("acyclic_rest", "nation_trade", _STRONG + "SELECT DISTINCT r.b AS id FROM r WHERE r.a IN (SELECT e.src FROM e JOIN r z ON z.a = e.dst AND z.b = e.src)")(co.acyclic_rest)
query("bipartition_odd", "supplier_co", ", r(a, b, p) AS (SELECT id, id, 0 FROM v UNION SELECT r.a, y.dst, 1 - r.p FROM r JOIN y ON y.src = r.b) SELECT a AS id, bool_or(p = 1 AND a = b) AS odd FROM r GROUP BY a")(lambda g: co.bipartition(g).select("id", "odd"))
query("validation", "geo_tree", _WEAK + "SELECT false AS is_empty, (SELECT count(DISTINCT component) = 1 FROM wc) AS is_connected, (SELECT count(*) > 0 FROM e WHERE weight < 0) AS negative, (SELECT count(*) > 0 FROM e WHERE src = dst) AS loops, true AS dag, true AS bipartite, (SELECT count(DISTINCT component) FROM wc) AS components")(
    lambda g: g.spark.createDataFrame([(va.is_empty(g), va.is_connected(g), va.has_negative_weights(g), va.has_self_loops(g), va.is_dag(g), va.is_bipartite(g), va.count_components(g))], "is_empty boolean, is_connected boolean, negative boolean, loops boolean, dag boolean, bipartite boolean, components long")
)

# --------------------------------------------------------------------------- generators

query("erdos_renyi", None, "SELECT i AS src, j AS dst FROM range(60) a(i) JOIN range(60) b(j) ON i < j WHERE ('0x' || substr(md5('7-' || i || '-' || j), 1, 13))::BIGINT / 4503599627370496.0 < 0.1")(lambda spark, sf: ge.erdos_renyi_graph(spark, 60, 0.1, 7).edges.select("src", "dst"))
query("erdos_renyi_directed", None, "SELECT i AS src, j AS dst FROM range(40) a(i) JOIN range(40) b(j) ON i <> j WHERE ('0x' || substr(md5('9-' || i || '-' || j), 1, 13))::BIGINT / 4503599627370496.0 < 0.2")(lambda spark, sf: ge.erdos_renyi_graph(spark, 40, 0.2, 9, True).edges.select("src", "dst"))
query("bipartite_graph", None, "SELECT i AS src, j AS dst FROM range(20) a(i) JOIN range(20, 50) b(j) ON true WHERE ('0x' || substr(md5('5-' || i || '-' || j), 1, 13))::BIGINT / 4503599627370496.0 < 0.3")(lambda spark, sf: ge.bipartite_graph(spark, 20, 30, 0.3, 5).edges.select("src", "dst"))
query("complete_graph", None, "SELECT i AS src, j AS dst FROM range(30) a(i) JOIN range(30) b(j) ON i < j")(lambda spark, sf: ge.complete_graph(spark, 30).edges.select("src", "dst"))
query("star_graph", None, "SELECT 0::BIGINT AS src, i AS dst FROM range(1, 25) a(i)")(lambda spark, sf: ge.star_graph(spark, 25).edges.select("src", "dst"))
query("cycle_graph", None, "SELECT i AS src, (i + 1) % 25 AS dst FROM range(25) a(i)")(lambda spark, sf: ge.cycle_graph(spark, 25).edges.select("src", "dst"))
query("path_graph", None, "SELECT i AS src, i + 1 AS dst FROM range(24) a(i)")(lambda spark, sf: ge.path_graph(spark, 25).edges.select("src", "dst"))
query("grid_graph", None, "SELECT i AS src, i + 1 AS dst FROM range(20) a(i) WHERE i % 5 < 4 UNION ALL SELECT i, i + 5 FROM range(15) a(i)")(lambda spark, sf: ge.grid_graph(spark, 4, 5).edges.select("src", "dst"))
query("random_tree", None, "SELECT least(floor(('0x' || substr(md5('3-' || i), 1, 13))::BIGINT / 4503599627370496.0 * i)::BIGINT, i - 1) AS src, i AS dst FROM range(1, 50) a(i)")(lambda spark, sf: ge.random_tree(spark, 50, 3).edges.select("src", "dst"))
query("watts_strogatz_counts", None, "SELECT 50::BIGINT AS nodes, 100::BIGINT AS edges")(lambda spark, sf: ge.watts_strogatz_graph(spark, 50, 4, 0.2, 1).density_frame().select("nodes", "edges"))
query("barabasi_albert_counts", None, "SELECT 50::BIGINT AS nodes, 144::BIGINT AS edges")(lambda spark, sf: ge.barabasi_albert_graph(spark, 50, 3, 1).density_frame().select("nodes", "edges"))

# --------------------------------------------------------------------------- files and streams


def _folder(g: Graph) -> str:
    return Steps(g.spark).at


@query("edge_list_round_trip", "nation_trade", "SELECT eid, src, dst, weight FROM e")
def _edge_list(g: Graph) -> DataFrame:
    at = _folder(g)
    text.write_edge_list(g.map_node_attrs("id"), at, ",")
    return text.read_edge_list(g.spark, at, ",", directed=True).edges


@query("adjacency_list_round_trip", "geo_tree", "SELECT eid, src, dst, weight FROM e")
def _adjacency_list(g: Graph) -> DataFrame:
    at = _folder(g)
    text.write_adjacency_list(g.map_node_attrs("id"), at, " ")
    return text.read_adjacency_list(g.spark, at, " ", directed=True).edges


@query("json_round_trip", "nation_trade", "SELECT eid, s.k AS src, d.k AS dst, weight FROM e JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) s ON s.id = src JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) d ON d.id = dst")
def _json(g: Graph) -> DataFrame:
    at = _folder(g) + ".json"
    store.save_json(g, at)
    return store.load_json_strict(g.spark, at, True).edges


@query("json_lenient", "nation_trade", "SELECT id, count(dst) AS in_degree FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS id, id AS old FROM v) LEFT JOIN e ON dst = old GROUP BY id")
def _json_lenient(g: Graph) -> DataFrame:
    at = _folder(g) + ".json"
    store.save_json(g, at)
    return store.load_json(g.spark, at).in_degrees()


@query("load_edge_list", "nation_trade", "SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT sum(weight) FROM e) AS total_weight")
def _load_edge_list(g: Graph) -> DataFrame:
    at = _folder(g)
    text.write_edge_list(g.map_node_attrs("id"), at, " ")
    loaded, (nodes, edges) = text.load_edge_list(g.spark, at, " ", True)
    return loaded.edges.agg(F.lit(nodes).cast("long").alias("nodes"), F.lit(edges).cast("long").alias("edges"), F.sum("weight").alias("total_weight"))


@query("loose_edges", "nation_trade", "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst")
def _loose_edges(g: Graph) -> DataFrame:
    at = _folder(g)
    noise = g.vertices.select(F.concat(F.lit("# node "), F.col("id")).alias("value"))
    noise.unionByName(g.edges.select(F.concat_ws(", ", "src", "dst", "weight").alias("value"))).write.text(at)
    return text.read_loose_edges(g.spark, at).edges.select("src", "dst")


@query("convert", "nation_trade", "SELECT e.eid, s.k AS src, d.k AS dst, e.weight::BIGINT AS weight FROM e JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) s ON s.id = src JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) d ON d.id = dst")
def _convert(g: Graph) -> DataFrame:
    return g.convert("bigint").edges


@query("parquet_round_trip", sql="SELECT eid, src, dst, weight FROM e")
def _parquet(g: Graph) -> DataFrame:
    at = _folder(g)
    store.save_binary(g, at)
    return store.load_binary_strict(g.spark, at, False).edges


query("graphml_edges", "geo_tree", "SELECT count(*) AS lines FROM (SELECT id FROM v UNION ALL SELECT eid FROM e UNION ALL SELECT * FROM range(7))")(lambda g: store.graphml_lines(g).agg(F.count("*").alias("lines")))


@query("edge_stream", "supplier_co", "SELECT id, count(src) AS degree FROM v LEFT JOIN a ON src = id GROUP BY id")
def _stream(g: Graph) -> DataFrame:
    at = _folder(g)
    g.edges.repartition(3).write.parquet(f"{at}/in")
    rows = g.spark.readStream.schema(g.edges.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    stream.ingest(rows, f"{at}/out", f"{at}/state").awaitTermination()
    return Graph(g.vertices, stream.stored_graph(g.spark, f"{at}/out").edges, False).degrees()


# --------------------------------------------------------------------------- trees, communities, heuristics

_LIGHT = ", r(k, a, b) AS (SELECT eid, src, src FROM e UNION SELECT r.k, r.a, y.dst FROM r JOIN y ON y.src = r.b JOIN e ON e.eid = r.k WHERE y.weight < e.weight OR y.weight = e.weight AND y.eid < e.eid)\n"
#: An edge is in the forest exactly if no path of earlier edges joins its ends.
_MST = _LIGHT + "SELECT eid, src AS u, dst AS v, weight FROM e WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM r WHERE k = eid AND r.b = e.dst)"
query("boruvka_mst", sql=_MST)(lambda g: ms.boruvka_mst(g, plan="distributed"))
query("kruskal_mst", sql=_MST)(ms.kruskal_mst)
query("prim_mst", "nation_trade", _MST)(ms.prim_mst)
query("label_propagation")(lambda g: cm.label_propagation(g, 20, 1))
query("infomap")(lambda g: cm.infomap(g, 20, 1))
query("louvain")(lambda g: cm.louvain(g, 1))
query("girvan_newman")(lambda g: cm.girvan_newman(g, 3))
query("spectral_embeddings", "nation_trade")(lambda g: cm.spectral_embeddings(g, 3))
query("spectral_clustering", "nation_trade")(lambda g: cm.spectral_clustering(g, 3, 1))


def _partition(g: Graph, labels: DataFrame) -> DataFrame:
    """One row: vertices, those without a component or not alone in having one, components not named by their least member."""
    labels = Steps(g.spark).write(labels)
    named = g.vertices.select("id").join(labels.groupBy("id").agg(F.count("*").alias("n"), F.min("component").alias("c")), "id", "left")
    heads = labels.groupBy("component").agg(F.min("id").alias("least")).agg(F.count(F.when(F.col("least") != F.col("component"), 1)).alias("misnamed"))
    return named.agg(F.count("*").alias("vertices"), F.count(F.when(F.col("n").isNull() | (F.col("n") != 1) | F.col("c").isNull(), 1)).alias("unnamed")).join(heads)


def _unsettled(g: Graph, labels: DataFrame, weight: str) -> DataFrame:
    """One row: vertices whose neighbours hold another component with more votes than their own has."""
    labels = Steps(g.spark).write(labels)
    votes = g.arcs("out").join(labels.toDF("dst", "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum(F.expr(weight)).alias("n"))
    own = votes.join(labels, "id").groupBy("id").agg(F.max("n").alias("most"), F.max(F.when(F.col("c") == F.col("component"), F.col("n")).otherwise(0.0)).alias("own"))
    return own.agg(F.count(F.when(F.col("own") < F.col("most"), 1)).alias("unsettled"))


_WHOLE = "SELECT count(*) AS vertices, 0::BIGINT AS unnamed, 0::BIGINT AS misnamed FROM v"
query("label_propagation_partition", sql=_WHOLE)(lambda g: _partition(g, cm.label_propagation(g, 20, 1)))
query("label_propagation_settled", sql="SELECT 0::BIGINT AS unsettled")(lambda g: _unsettled(g, cm.label_propagation(g, 200, 1), "1.0"))
query("infomap_partition", sql=_WHOLE)(lambda g: _partition(g, cm.infomap(g, 20, 1)))
query("infomap_settled", sql="SELECT 0::BIGINT AS unsettled")(lambda g: _unsettled(g, cm.infomap(g, 200, 1), "weight"))
query("louvain_partition", sql=_WHOLE)(lambda g: _partition(g, cm.louvain(g, 1)))
query("louvain_distributed_partition", sql=_WHOLE)(lambda g: _partition(g, cm.louvain(g, 1, plan="distributed")))
query("girvan_newman_partition", sql=_WHOLE)(lambda g: _partition(g, cm.girvan_newman(g, 3)))
query("spectral_clustering_partition", "nation_trade", _WHOLE + " WHERE id IS NOT NULL")(lambda g: _partition(g, cm.spectral_clustering(g, 3, 1)))


def _gain(g: Graph, labels: DataFrame) -> DataFrame:
    """Whether the communities' modularity exceeds that of components and of the vertex attribute."""
    of = lambda x: cm.modularity(g, x).first()[0]
    q = of(labels)
    return g.spark.createDataFrame([(q > of(co.connected_components(g)) + 0.1, q > of(g.vertices.select("id", F.col("attr").alias("component"))) + 0.1)], "better_than_components boolean, better_than_attr boolean")


_BETTER = "SELECT true AS better_than_components, true AS better_than_attr"
query("louvain_gain", sql=_BETTER)(lambda g: _gain(g, cm.louvain(g, 1)))
query("louvain_distributed_gain", sql=_BETTER)(lambda g: _gain(g, cm.louvain(g, 1, plan="distributed")))


@query("girvan_newman_parts", sql="SELECT true AS enough, 0::BIGINT AS in_pieces")
def _girvan_newman_parts(g: Graph) -> DataFrame:
    """Whether there are three communities, and how many of them do not hang together."""
    labels = Steps(g.spark).write(cm.girvan_newman(g, 3))
    own = labels.toDF("src", "a"), labels.toDF("dst", "b")
    inside = g.with_parts(edges=g.edges.join(own[0], "src").join(own[1], "dst").filter("a = b").select(*g.edges.columns))
    pieces = co.connected_components(inside).withColumnRenamed("component", "piece").join(labels, "id").groupBy("component").agg(F.countDistinct("piece").alias("n"))
    return pieces.agg((F.count("*") >= 3).alias("enough"), F.count(F.when(F.col("n") > 1, 1)).alias("in_pieces"))


@query("spectral_products", "nation_trade", "SELECT i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS product, 0.0::DOUBLE AS coupling FROM range(3) x(i) JOIN range(3) z(j) ON i <= j WHERE i < j OR i = 0")
def _spectral_products(g: Graph) -> DataFrame:
    """Products of the embedding's columns (orthonormal), and how far the Laplacian couples them (not at all; the first lies in its null space)."""
    x = Steps(g.spark).write(cm.spectral_embeddings(g, 3))
    one = x.select("id", F.posexplode("embedding").alias("i", "a"))
    pairs = F.struct("i", "j")
    product = one.join(one.toDF("id", "j", "b"), "id").filter("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("product"))
    arcs = g.arcs("sym")
    lx = arcs.join(one.toDF("src", "i", "a"), "src").join(one.toDF("dst", "j", "b"), ["dst"]).join(one.toDF("src", "j", "c"), ["src", "j"]).filter("i <= j")
    coupling = lx.groupBy("i", "j").agg(F.sum(F.col("weight") * F.col("a") * (F.col("c") - F.col("b"))).alias("coupling"))
    out = product.join(coupling, ["i", "j"]).filter("i < j or i = 0").withColumn("__k", pairs).drop("__k")
    # Rounded; a zero may carry a sign.
    near = lambda c, digits: (F.round(c, digits) + F.lit(0.0)).alias(c)
    return out.select("i", "j", near("product", 6), near("coupling", 3))


query("modularity_by_attr", sql="SELECT round((SELECT coalesce(sum(weight), 0) FROM e JOIN v s ON s.id = src JOIN v d ON d.id = dst WHERE s.attr = d.attr) / m - (SELECT sum(k * k) FROM (SELECT attr, sum(weight) AS k FROM (SELECT src AS id, weight FROM e UNION ALL SELECT dst, weight FROM e) JOIN v USING (id) GROUP BY attr)) / (4 * m * m), 6) AS modularity FROM (SELECT sum(weight) AS m FROM e)")(lambda g: _round(cm.modularity(g, g.vertices.select("id", F.col("attr").alias("component"))), "modularity"))
# Sequential heuristics replayed step by step: lists hold the state, one row a step.
_NEAR = ", nb AS MATERIALIZED (SELECT v.id, coalesce(list(y.dst ORDER BY y.dst) FILTER (y.dst <> v.id), []) AS near FROM v LEFT JOIN (SELECT DISTINCT src, dst FROM y) y ON y.src = v.id GROUP BY v.id), nm AS MATERIALIZED (SELECT map_from_entries(list((id, near))) AS m, list(id ORDER BY id) AS ids FROM nb)"


def _clique(around: str, seed: str) -> str:
    return f"list_reduce(list_transform(list_sort(list_transform({around}, lambda x: {{'d': -len(m[x]), 'i': x}})), lambda x: [x.i]), lambda c, x: CASE WHEN list_has_all(m[x[1]], c) THEN list_concat(c, x) ELSE c END, [{seed}])"


_MAX_CLIQUE = "SELECT unnest(c) AS id FROM (SELECT c FROM (SELECT " + _clique("near", "id") + " AS c, id AS seed FROM nb, nm) ORDER BY len(c) DESC, seed LIMIT 1)"
_INDEPENDENT = """, turns AS MATERIALIZED (SELECT list(id ORDER BY d, id) AS turn FROM (SELECT v.id, count(a.src) AS d FROM v LEFT JOIN a ON a.src = v.id GROUP BY v.id)),
s(k, taken, blocked) AS (SELECT 1, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT k + 1, CASE WHEN list_contains(blocked, turn[k]) THEN taken ELSE list_append(taken, turn[k]) END, CASE WHEN list_contains(blocked, turn[k]) THEN blocked ELSE list_concat(blocked, m[turn[k]]) END FROM s, turns, nm WHERE k <= len(turn))
"""
_TAKEN = "SELECT unnest(taken) AS id FROM s WHERE k = (SELECT max(k) FROM s)"
query("max_clique", sql=_NEAR + "\n" + _MAX_CLIQUE)(ap.max_clique)
query(
    "clique_removal",
    sql=_NEAR
    + """, s(k, clique, rest) AS (SELECT -1::BIGINT, []::BIGINT[], ids FROM nm UNION ALL
  SELECT k + 1, best, list_filter(rest, lambda x: NOT list_contains(best, x)) FROM (
    SELECT k, rest, list_reduce(list_transform(rest, lambda z: """
    + _clique("list_intersect(m[z], rest)", "z")
    + """), lambda p, q: CASE WHEN len(q) > len(p) THEN q ELSE p END) AS best FROM s, nm WHERE len(rest) > 0))
SELECT k AS clique, unnest(clique) AS id FROM s WHERE k >= 0""",
)(ap.clique_removal)
query("maximum_independent_set", sql=_NEAR + _INDEPENDENT + _TAKEN)(ap.maximum_independent_set)
query(
    "min_maximal_matching",
    sql=""", turns AS MATERIALIZED (SELECT list({'eid': eid, 'u': src, 'v': dst} ORDER BY eid) AS turn FROM e),
s(k, used, kept) AS (SELECT 1, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT k + 1, CASE WHEN list_has_any(used, [turn[k].u, turn[k].v]) THEN used ELSE list_concat(used, [turn[k].u, turn[k].v]) END, CASE WHEN list_has_any(used, [turn[k].u, turn[k].v]) THEN kept ELSE list_append(kept, turn[k].eid) END FROM s, turns WHERE k <= len(turn))
SELECT eid, src AS u, dst AS v FROM e WHERE eid IN (SELECT unnest(kept) FROM s WHERE k = (SELECT max(k) FROM s))""",
)(ap.min_maximal_matching)
query(
    "densest_subgraph",
    sql=_NEAR
    + """, s(step, part, best, keep) AS (
  SELECT 0, list_filter(ids, lambda x: len(m[x]) > 0), 0.0::DOUBLE, []::BIGINT[] FROM nm UNION ALL
  SELECT step + 1, list_filter(stay, lambda x: list_has_any(m[x], stay)), greatest(best, now), CASE WHEN now > best THEN part ELSE keep END FROM (
    SELECT *, list_transform(list_filter(deg, lambda x: x.d > list_min(deg).d AND x.d >= greatest(best, now)), lambda x: x.i) AS stay FROM (
      SELECT *, list_sum(list_transform(deg, lambda x: x.d)) / 2.0 / len(part) AS now FROM (
        SELECT step, part, best, keep, m, list_transform(part, lambda x: {'d': len(list_intersect(m[x], part)), 'i': x}) AS deg FROM s, nm WHERE len(part) > 0))))
SELECT unnest(keep) AS id FROM s WHERE step = (SELECT max(step) FROM s)""",
)(ap.densest_subgraph)
query(
    "min_weighted_vertex_cover",
    sql=_NEAR
    + """, s(cover, top) AS (SELECT []::BIGINT[], list_max(list_transform(ids, lambda x: {'d': len(m[x]), 'i': x})) FROM nm UNION ALL
  SELECT c, list_max(list_transform(list_filter(ids, lambda x: NOT list_contains(c, x)), lambda x: {'d': len(list_filter(m[x], lambda y: NOT list_contains(c, y))), 'i': x})) FROM (SELECT list_append(cover, top.i) AS c FROM s WHERE top.d > 0), nm)
SELECT unnest(cover) AS id FROM s WHERE top IS NULL OR top.d = 0""",
)(ap.min_weighted_vertex_cover)
query("vertex_cover_left", sql="SELECT 0::BIGINT AS uncovered")(
    lambda g: g.edges.join(ap.min_weighted_vertex_cover(g).toDF("src"), "src", "left_anti").join(ap.min_weighted_vertex_cover(g).toDF("dst"), "dst", "left_anti").agg(F.count("*").alias("uncovered"))
)


def _eliminated(name: str, cost: str) -> str:
    return f""", {name}(step, adj, width) AS (SELECT 0, list({{'i': id, 'n': near}} ORDER BY id), 0::BIGINT FROM nb UNION ALL
  SELECT step + 1, list_transform(list_filter(adj, lambda x: x.i <> v.i), lambda x: CASE WHEN list_contains(v.n, x.i) THEN {{'i': x.i, 'n': list_filter(list_distinct(list_concat(x.n, v.n)), lambda z: z <> x.i AND z <> v.i)}} ELSE x END), greatest(width, len(v.n)) FROM (
    SELECT step, adj, width, list_min(list_transform(adj, lambda x: {{'d': {cost}, 'i': x.i, 'n': x.n}})) AS v FROM (
      SELECT *, MAP(list_transform(adj, lambda x: x.i), list_transform(adj, lambda x: x.n)) AS m FROM {name} WHERE len(adj) > 0)))"""


query(
    "treewidth",
    sql=_NEAR
    + _eliminated("by_degree", "len(x.n)")
    + _eliminated("by_fill", "coalesce(list_sum(list_transform(x.n, lambda z: len(x.n) - 1 - len(list_intersect(m[z], x.n)))), 0)")
    + "\nSELECT 'degree' AS rule, max(width)::BIGINT AS width FROM by_degree UNION ALL SELECT 'fill', max(width)::BIGINT FROM by_fill",
)(lambda g: g.spark.createDataFrame([("degree", ap.treewidth_min_degree(g)[0]), ("fill", ap.treewidth_min_fill_in(g)[0])], "rule string, width long"))
query(
    "greedy_tsp",
    sql=_DIST.format(start=_ALL).rstrip()
    + """, far AS MATERIALIZED (SELECT map_from_entries(list((src, near))) AS m FROM (SELECT src, list({'d': dist, 'i': id} ORDER BY dist, id) AS near FROM w GROUP BY src)),
t(pos, here, rest) AS (SELECT 0::BIGINT, min(id), list(id) FROM v UNION ALL
  SELECT pos + 1, CASE WHEN len(r) > 0 THEN list_filter(m[here], lambda x: list_contains(r, x.i))[1].i ELSE (SELECT min(id) FROM v) END, CASE WHEN len(r) > 0 THEN r END FROM (SELECT pos, here, list_filter(rest, lambda x: x <> here) AS r FROM t WHERE rest IS NOT NULL), far)
SELECT pos, here AS id FROM t""",
)(lambda g: tr.path_frame(g, ap.greedy_tsp(g, _least(g))[0]))
#: A breadth-first queue at a time: mode 0 takes the next of the queue, mode 1 walks back from the target and blocks what it passes.
query(
    "local_node_connectivity",
    sql=""", nb AS MATERIALIZED (SELECT map_from_entries(list((src, near))) AS m FROM (SELECT src, list(DISTINCT dst ORDER BY dst) AS near FROM a GROUP BY src)), z AS MATERIALIZED (SELECT min(id) AS s, max(id) AS t FROM v),
q(mode, i, line, pred, blocked, paths, here) AS (SELECT 0, 1, [s], [s], []::BIGINT[], 0::BIGINT, s FROM z UNION ALL
  SELECT CASE WHEN mode = 0 AND i > len(line) OR hit AND pred[i] = s THEN 9 WHEN hit THEN 1 WHEN mode = 1 AND here = s THEN 0 ELSE mode END,
    CASE WHEN mode = 0 THEN i + 1 ELSE 1 END,
    CASE WHEN mode = 0 THEN list_concat(line, new) WHEN here = s THEN [s] ELSE line END,
    CASE WHEN mode = 0 THEN list_concat(pred, list_transform(new, lambda x: line[i])) WHEN here = s THEN [s] ELSE pred END,
    CASE WHEN mode = 1 AND here <> s THEN list_append(blocked, here) ELSE blocked END,
    CASE WHEN hit THEN paths + 1 ELSE paths END,
    CASE WHEN hit THEN pred[i] WHEN mode = 1 AND here <> s THEN pred[list_position(line, here)] ELSE here END
  FROM (SELECT *, mode = 0 AND i <= len(line) AND line[i] = t AS hit, CASE WHEN mode = 0 AND i <= len(line) AND line[i] <> t THEN list_filter(coalesce(m[line[i]], []), lambda x: NOT list_contains(line, x) AND NOT list_contains(blocked, x)) ELSE []::BIGINT[] END AS new FROM q, nb, z WHERE mode < 9))
SELECT max(paths) AS paths FROM q""",
)(lambda g: g.spark.createDataFrame([(ap.local_node_connectivity(g, _least(g), g.vertices.agg(F.max("id")).first()[0]),)], "paths long"))
query("ramsey_r2", sql=_NEAR + _INDEPENDENT + "SELECT id, 'clique' AS part FROM (" + _MAX_CLIQUE + ") UNION ALL SELECT id, 'independent' FROM (" + _TAKEN + ")")(lambda g: (lambda c, i: c.withColumn("part", F.lit("clique")).unionByName(i.withColumn("part", F.lit("independent"))))(*ap.ramsey_r2(g)))

# --------------------------------------------------------------------------- the whole co-order network, whose hubs no cut removes

query("whole_network_counts", "supplier_all", "SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT 2.0 * count(*) FROM e) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)) AS density")(lambda g: g.density_frame())
query("whole_network_degrees", "supplier_all", "SELECT id, count(src) AS degree FROM v LEFT JOIN a ON src = id GROUP BY id")(lambda g: g.degrees())
query("whole_network_components", "supplier_all", _WEAK + "SELECT id, component FROM wc")(lambda g: co.connected_components(g, plan="distributed"))
query("whole_network_bfs", "supplier_all", _HOPS.format(start=_ONE, most=6) + "SELECT id, depth FROM d")(lambda g: tr.bfs(g, _least(g), plan="distributed"))
query("whole_network_pagerank", "supplier_all", _rank_sql("weight", _EVEN, "sum"))(lambda g: _round(ce.pagerank(g, plan="distributed"), "pagerank"))
