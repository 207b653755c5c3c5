"""Queries on chains of sites along the street graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpoints.operators import chains as CH, graph as G
from roadpoints.operators.celljoin import near_join
from roadpoints.plans import tables as T
from roadpoints.plans.graph_queries import pixel_graph
from roadpoints.plans.registry import query
from roadpoints.plans.tables import sql
from roadpoints.operators.cuts import cut

R6 = lambda c: F.round(c, 6).alias(c)
REACH = 40.0


def street_sites(spark, sf):
    """(sites, nodes, edges): the vertices of the street graph with a point within 40 m, junctions as intersections, all others as curves."""
    nodes, edges = pixel_graph(spark, sf)
    n = G.degrees(nodes, edges)
    near = near_join(n, T.points(spark, sf).select("layer_id", "x", "y").distinct(), REACH, how="left_semi")
    sites = near.select("layer_id", "ord", "x", "y", F.when(F.col("degree") >= 3, "intersection").otherwise("curve").alias("category"))
    return cut(sites), nodes, edges


# chains walked step by step from both ends
WALK = """nd AS MATERIALIZED (SELECT layer_id, x, y, min(ord) AS ord FROM skeleton GROUP BY ALL),
    ne AS MATERIALIZED (SELECT a.layer_id, a.ord AS u, b.ord AS v, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy FROM nd a JOIN (VALUES (10, 0), (-10, 0), (0, 10), (0, -10)) m(i, j) ON true JOIN nd b ON b.layer_id = a.layer_id AND b.x = a.x + m.i AND b.y = a.y + m.j),
    st AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM ne WHERE ne.layer_id = n.layer_id AND ne.u = n.ord) >= 3 AS junction FROM nd n
      SEMI JOIN points p ON p.layer_id = n.layer_id AND abs(p.x - n.x) <= 40 AND abs(p.y - n.y) <= 40 AND sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) <= 40),
    se AS MATERIALIZED (SELECT ne.* FROM ne JOIN st a ON a.layer_id = ne.layer_id AND a.ord = ne.u JOIN st b ON b.layer_id = ne.layer_id AND b.ord = ne.v),
    dg AS MATERIALIZED (SELECT layer_id, u AS ord, count(*) AS n FROM se GROUP BY ALL),
    wk AS (SELECT se.layer_id, u AS start, v AS second, u AS was, v AS ord, 1 AS pos, vx AS x, vy AS y, ux AS sx, uy AS sy FROM se JOIN dg ON dg.layer_id = se.layer_id AND dg.ord = se.u AND dg.n <> 2
      UNION ALL SELECT w.layer_id, w.start, w.second, w.ord, se.v, w.pos + 1, se.vx, se.vy, w.sx, w.sy FROM wk w JOIN dg ON dg.layer_id = w.layer_id AND dg.ord = w.ord AND dg.n = 2 JOIN se ON se.layer_id = w.layer_id AND se.u = w.ord AND se.v <> w.was),
    en AS MATERIALIZED (SELECT w.layer_id, w.start, w.second, w.ord AS last, w.was AS before, w.pos AS steps, w.x, w.y, w.sx, w.sy FROM wk w JOIN dg ON dg.layer_id = w.layer_id AND dg.ord = w.ord AND dg.n <> 2),
    ch AS MATERIALIZED (SELECT *, start = last AS is_loop FROM en WHERE start < last OR (start = last AND second < before)),
    mb AS MATERIALIZED (SELECT layer_id, start, second, 0 AS pos, start AS ord, is_loop FROM ch UNION ALL SELECT w.layer_id, w.start, w.second, w.pos, w.ord, is_loop FROM wk w JOIN ch USING (layer_id, start, second) WHERE w.ord <> w.start),
    tl AS (SELECT layer_id, start, second, arg_max(ord, pos) AS tip, max(pos) AS steps, count(*) AS sites FROM mb GROUP BY ALL),
    sh AS MATERIALIZED (SELECT t.layer_id, start, second, sites, steps * 10.0 AS length, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (steps * 10.0) AS ratio FROM tl t JOIN nd a ON a.layer_id = t.layer_id AND a.ord = start JOIN nd b ON b.layer_id = t.layer_id AND b.ord = tip)"""


@query("g11_site_chains", sql("points skeleton", f"{WALK} SELECT layer_id, start, second, pos, ord, pos * 10.0 AS measure, is_loop FROM mb"))
def g11(spark, sf):
    sites, nodes, edges = street_sites(spark, sf)
    return CH.chains(CH.site_graph(sites, nodes, edges)[1]).select("layer_id", "start", "second", "pos", "ord", R6("measure"), "is_loop")


@query("g12_chain_straightness", sql("points skeleton", f"{WALK} SELECT layer_id, start, second, sites, length, round(ratio, 6) AS ratio, sites >= 3 AND ratio >= 0.92 AS straight FROM sh"))
def g12(spark, sf):
    sites, nodes, edges = street_sites(spark, sf)
    held, pair = CH.site_graph(sites, nodes, edges)
    return CH.chain_shape(CH.chains(pair), held).select("layer_id", "start", "second", "sites", R6("length"), R6("ratio"), "straight")


@query("d22_redundant_curves", sql("points skeleton", f"""{WALK} SELECT layer_id, ord, x, y, CASE WHEN junction THEN 'intersection' ELSE 'curve' END AS category FROM st s WHERE junction OR NOT EXISTS (
    SELECT 1 FROM mb JOIN sh USING (layer_id, start, second) WHERE mb.layer_id = s.layer_id AND mb.ord = s.ord AND sites >= 3 AND ratio >= 0.92 AND pos > 0 AND pos < sites - 1)"""))
def d22(spark, sf):
    sites, nodes, edges = street_sites(spark, sf)
    return CH.without_redundant(sites, nodes, edges).select("layer_id", "ord", "x", "y", "category")
