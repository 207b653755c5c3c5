"""Queries on rasters, clipping, line networks and composite jobs."""

from __future__ import annotations


from pyspark.sql import functions as F

from roadpoints.functions.geom import dist, natural_direction
from roadpoints.operators import clip as C, graph as G, lines as LN, links as L, raster as R, stats as S
from roadpoints.operators.celljoin import nearest, near_join, pairs_within
from roadpoints.plans import jobs as J, tables as T
from roadpoints.plans.graph_queries import NODES
from roadpoints.plans.link_queries import SKELT, VISUAL, held_sql, FREE, interval_sql, pair_sql, segd, union_sql
from roadpoints.plans.neighbour_queries import BAND, COVER, D, PAIRW, POINTIMP, district_edges
from roadpoints.plans.registry import query
from roadpoints.plans.tables import grid_dist, sql

R6 = lambda c: F.round(c, 6)
PX = 4.0


def pixels(spark, sf):
    return R.rasterise_bands(T.streets(spark, sf), PX)


# a street ends at 2001; its round cap reaches 6 m further
AT = "least(sqrt((y - 200 * least(10, greatest(0, round(y / 200)))) ** 2 + greatest(0, -x, x - 2001) ** 2), sqrt((x - 200 * least(10, greatest(0, round(x / 200)))) ** 2 + greatest(0, -y, y - 2001) ** 2))"
PIX = f"""g AS (SELECT layer_id, i AS row_, j AS col, (j + 0.5) * 4.0 AS x, (i + 0.5) * 4.0 AS y FROM layers, range(-3, 504) a(i), range(-3, 504) b(j)), px AS MATERIALIZED (SELECT layer_id, row_, col FROM g WHERE {AT} <= 6)"""


@query("r01_raster", sql("layers", f"{PIX} SELECT layer_id, row_, col FROM px"))
def r01(spark, sf):
    return pixels(spark, sf).select("layer_id", F.col("row").alias("row_"), "col")


@query("r03_neighbour_counts", sql("layers", f"""{PIX} SELECT layer_id, neighbours, count(*) AS n FROM (SELECT p.layer_id, p.row_, p.col, count(o.col) AS neighbours FROM (SELECT p.*, p.row_ + i AS r2, p.col + j AS c2 FROM px p, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE i <> 0 OR j <> 0) p
    LEFT JOIN px o ON o.layer_id = p.layer_id AND o.row_ = r2 AND o.col = c2 GROUP BY ALL) GROUP BY ALL"""))
def r03(spark, sf):
    return R.neighbour_counts(pixels(spark, sf)).groupBy("layer_id", F.col("neighbours").cast("long").alias("neighbours")).agg(F.count(F.lit(1)).alias("n"))


@query("r02_thinned_raster")
def r02(spark, sf):
    return R.thin(pixels(spark, sf)).select("layer_id", "row", "col")


@query("r04_junction_centres")
def r04(spark, sf):
    return R.junction_centres(R.thin(pixels(spark, sf)), PX).select("layer_id", "cluster", "members", R6("x").alias("x"), R6("y").alias("y"))


@query("r05_skeleton_edges")
def r05(spark, sf):
    return R.skeleton_edges(R.thin(pixels(spark, sf)), PX).groupBy("layer_id").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("w"), 3).alias("length"))


@query("r01_ring_raster", sql("districts", "SELECT layer_id, 180 * 180 AS n FROM districts"))
def r01_ring(spark, sf):
    e = district_edges(spark, sf).withColumn("shape_id", F.lit(0))
    return R.rasterise_rings(e, 10.0).groupBy("layer_id").agg(F.count(F.lit(1)).alias("n"))


@query("j10_clipped_roads", sql("streets districts", """s AS (SELECT layer_id, road_id, road_id < 100 AS flat, CASE WHEN road_id < 100 THEN y1 ELSE x1 END AS c FROM streets)
    SELECT layer_id, road_id, round(CASE WHEN c BETWEEN 100 AND 1900 THEN 1820.0 ELSE 1800 + 2 * sqrt(100 - (100 - 92.0) ** 2) * 0 END, 4) AS length FROM s WHERE c BETWEEN 100 AND 1900"""))
def j10(spark, sf):
    c = C.clip_lines(T.streets(spark, sf), district_edges(spark, sf), 10.0)
    return c.groupBy("layer_id", "road_id").agg(F.round(F.sum("length"), 4).alias("length"))


@query("j12_clip_ladder", sql("streets", "SELECT layer_id, 10.0 AS reach, 18 AS roads FROM streets GROUP BY layer_id"))
def j12(spark, sf):
    c = C.clip_with_ladder(T.streets(spark, sf), district_edges(spark, sf))
    return c.groupBy("layer_id", "reach").agg(F.countDistinct("road_id").alias("roads"))


@query("j11_roads_touching_district", sql("streets", "SELECT layer_id, road_id FROM streets WHERE CASE WHEN road_id < 100 THEN y1 ELSE x1 END BETWEEN 90 AND 1910"))
def j11(spark, sf):
    return C.clip_lines(T.streets(spark, sf), district_edges(spark, sf), 10.0).select("layer_id", "road_id").distinct()


@query("j34_line_end_gaps", sql("streets", """e AS (SELECT layer_id, road_id, x1 AS x, y1 AS y FROM streets UNION ALL SELECT layer_id, road_id, x2, y2 FROM streets),
    p AS (SELECT a.layer_id, a.road_id, a.x, a.y, b.road_id AS o, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM e a JOIN e b ON a.layer_id = b.layer_id AND a.road_id <> b.road_id)
    SELECT DISTINCT layer_id, least(road_id, o) AS line1, greatest(road_id, o) AS line2, round(d, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY layer_id, road_id, x, y ORDER BY d, o) AS k FROM p WHERE d <= 50) WHERE k = 1"""))
def j34(spark, sf):
    s = T.streets(spark, sf)
    e = s.select("layer_id", "road_id", F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(s.select("layer_id", "road_id", F.col("x2").alias("x"), F.col("y2").alias("y")))
    hit = near_join(e, e, 50.0).where("road_id <> r_road_id").groupBy("layer_id", "road_id", "x", "y").agg(F.min(F.struct("d", "r_road_id")).alias("m"))
    return hit.select("layer_id", F.least("road_id", "m.r_road_id").alias("line1"), F.greatest("road_id", "m.r_road_id").alias("line2"), R6("m.d").alias("gap")).distinct()


# level pieces of road that begin at the points of one category: 30 m long
PIECES = "pieces AS MATERIALIZED (SELECT layer_id, ord AS line_id, x AS x1, y AS y1, x + 30 AS x2, y AS y2 FROM points WHERE category = 'endpoint')"


def pieces(spark, sf):
    x, y = F.col("x"), F.col("y")
    return T.points(spark, sf).where("category = 'endpoint'").select("layer_id", F.col("ord").alias("line_id"), x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), y.alias("y2"))


@query("j33_touching_lines", sql("layers", f"{NODES} SELECT layer_id, h AS line1, 100 + v AS line2, 'near' AS kind FROM jn"))
def j33(spark, sf):
    t = LN.touching_lines(T.streets(spark, sf))
    return t.where("kind = 'near'").select("layer_id", "line1", "line2", "kind").distinct()


@query("j33_close_pieces", sql("points", f"""{PIECES}, g AS (SELECT a.layer_id, a.line_id AS line1, b.line_id AS line2, a.x1 AS ax, a.x2 AS ax2, a.y1 AS ay, b.x1 AS bx, b.x2 AS bx2, b.y1 AS by_ FROM pieces a JOIN pieces b ON a.layer_id = b.layer_id AND a.line_id < b.line_id),
    d AS (SELECT layer_id, line1, line2, sqrt(greatest(0, ax - bx2, bx - ax2) ** 2 + (ay - by_) ** 2) AS gap, least(sqrt((ax - bx) ** 2 + (ay - by_) ** 2), sqrt((ax - bx2) ** 2 + (ay - by_) ** 2), sqrt((ax2 - bx) ** 2 + (ay - by_) ** 2), sqrt((ax2 - bx2) ** 2 + (ay - by_) ** 2)) AS ends FROM g)
    SELECT layer_id, line1, line2, 'near' AS kind, round(gap, 6) AS gap FROM d WHERE gap <= 5 UNION ALL SELECT layer_id, line1, line2, 'ends', round(ends, 6) FROM d WHERE ends <= 3"""))
def j33_pieces(spark, sf):
    return LN.touching_lines(pieces(spark, sf), line_id="line_id").select("layer_id", "line1", "line2", "kind", R6("gap").alias("gap"))


@query("j39_skeleton_band", sql("skeleton", """l AS (SELECT layer_id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM skeleton WINDOW w AS (PARTITION BY layer_id ORDER BY ord))
    SELECT layer_id, count(*) AS steps, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 3) AS length, 15.0 AS half_width FROM l WHERE sqrt((nx - x) ** 2 + (ny - y) ** 2) > 1 GROUP BY ALL"""))
def j39(spark, sf):
    b = L.skeleton_band(T.skeleton(spark, sf))
    return b.groupBy("layer_id", "half_width").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum(dist("x1", "y1", "x2", "y2")), 3).alias("length"))


@query("j41_combined_visual_test", sql("points skeleton", f"""{pair_sql(15.0, 50.0)}, {SKELT}
    SELECT layer_id, ord1, ord2 FROM pairs p JOIN followed f USING (layer_id, ord1, ord2) WHERE f.hits / 11.0 > 0.7 AND (abs(x1 - x2) < 5 OR abs(y1 - y2) < 5 OR least(abs(x1 - x2), abs(y1 - y2)) / greatest(abs(x1 - x2), abs(y1 - y2)) > 0.3)
      AND NOT EXISTS (SELECT 1 FROM points o WHERE o.layer_id = p.layer_id AND sqrt((o.x - x1) ** 2 + (o.y - y1) ** 2) >= 5 AND sqrt((o.x - x2) ** 2 + (o.y - y2) ** 2) >= 5 AND {segd('o.x', 'o.y')} < 8)"""))
def j41(spark, sf):
    p = T.points(spark, sf)
    t = L.skeleton_tests(pairs_within(p, 15.0, 50.0), T.skeleton(spark, sf)).where("followed > 0.7").where(natural_direction("x1", "y1", "x2", "y2"))
    far = (dist("x", "y", "x1", "y1") >= 5) & (dist("x", "y", "x2", "y2") >= 5) & (F.col("line_d") < 8)
    held = L.rows_near_links(t, p, 8.0).where(far).select("layer_id", "ord1", "ord2").distinct()
    return t.join(held, ["layer_id", "ord1", "ord2"], "left_anti").select("layer_id", "ord1", "ord2")


@query("j37_connection_suggestion", sql("points skeleton", f"""iso AS (SELECT layer_id, ord, x, y FROM points p WHERE {grid_dist()} <= 6 AND NOT EXISTS (SELECT 1 FROM points o WHERE o.layer_id = p.layer_id AND o.ord <> p.ord AND {D('o', 'p')} <= 30)
      QUALIFY row_number() OVER (PARTITION BY layer_id ORDER BY ord) = 1),
    n AS (SELECT i.layer_id, i.ord, min({{'d': {D('i', 's')}, 'ord': s.ord, 'x': s.x, 'y': s.y}}) AS m FROM iso i JOIN skeleton s ON s.layer_id = i.layer_id AND {D('i', 's')} <= 50 GROUP BY ALL)
    SELECT layer_id, ord, m.x AS x, m.y AS y FROM n WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.layer_id = n.layer_id AND sqrt((p.x - m.x) ** 2 + (p.y - m.y) ** 2) < 25)"""))
def j37(spark, sf):
    p = T.points(spark, sf)
    first = L.isolated_points(p, T.streets(spark, sf), 30.0).groupBy("layer_id").agg(F.min_by(F.struct("ord", "x", "y"), "ord").alias("p")).select("layer_id", "p.*")
    near = nearest(first, T.skeleton(spark, sf), cap=50.0).where("near_ord is not null").select("layer_id", "ord", F.col("near_x").alias("x"), F.col("near_y").alias("y"))
    return near_join(near, p.select("layer_id", "x", "y").distinct(), 25.0, strict=True, how="left_anti").select("layer_id", "ord", "x", "y")


@query("j24_crossed_cells", sql("points", f"""{pair_sql(15.0, 50.0)} SELECT layer_id, ord1, ord2, (abs(floor(x1 / 100) - floor(x2 / 100)) + 1 + abs(floor(y1 / 100) - floor(y2 / 100)))::BIGINT AS cells FROM pairs"""))
def j24(spark, sf):
    from roadpoints.operators.celljoin import segment_cells
    c = segment_cells(pairs_within(T.points(spark, sf), 15.0, 50.0), 100.0)
    return c.groupBy("layer_id", "ord1", "ord2").agg(F.count(F.lit(1)).alias("cells"))


LINES = """ln AS (SELECT layer_id, ord, (SELECT count(*) FROM range(11) r(k) WHERE abs(y - 200 * k) <= R) AS nh, (SELECT count(*) FROM range(11) r(k) WHERE abs(x - 200 * k) <= R) AS nv FROM points)"""


@query("e10_e12_line_scores", sql("points", LINES.replace("R)", "40.0)") + " SELECT layer_id, ord, (nh + nv) * 2001.0 AS flow, 0.0 AS curvature FROM ln WHERE nh + nv > 0"))
def e10(spark, sf):
    from roadpoints.operators.lines import line_shape, site_line_scores
    shape = line_shape(T.skeleton(spark, sf)).drop("length").join(T.streets(spark, sf).select("layer_id", F.col("road_id").alias("line"), dist("x1", "y1", "x2", "y2").alias("length")), ["layer_id", "line"])
    s = site_line_scores(T.points(spark, sf), T.streets(spark, sf), shape, 40.0)
    return s.select("layer_id", "ord", R6("flow").alias("flow"), R6("curvature").alias("curvature"))


@query("e11_connectivity_score", sql("points", LINES.replace("R)", "50.0)") + " SELECT layer_id, ord, round(nh * nv * (10 + 5 * pi() / 2), 6) AS score FROM ln WHERE nh + nv >= 2"))
def e11(spark, sf):
    from roadpoints.operators.lines import connectivity_score
    return connectivity_score(T.points(spark, sf), T.streets(spark, sf), 50.0).select("layer_id", "ord", R6("score").alias("score"))


@query("e22_overlap", sql("points districts", f"""{COVER.replace('RADIUS', '20')}, c AS (SELECT layer_id, count(*) * 100.0 AS covered FROM hit GROUP BY ALL), n AS (SELECT layer_id, count(*) AS n FROM points GROUP BY ALL)
    SELECT layer_id, round((n * pi() * 400 - covered) / (n * pi() * 400), 6) AS overlap_ratio FROM c JOIN n USING (layer_id)"""))
def e22(spark, sf):
    return S.coverage(T.points(spark, sf), T.districts(spark, sf), 20.0).select("layer_id", R6("overlap_ratio").alias("overlap_ratio"))


@query("e23_coverage_gaps")
def e23(spark, sf):
    return S.coverage_gaps(T.points(spark, sf), T.districts(spark, sf), 50.0).select("layer_id", "gap", "cells", "area", R6("x").alias("x"), R6("y").alias("y"))


@query("q04_optimal_connections", sql("points skeleton", f"""{pair_sql(15.0, 100.0)}, {SKELT}, {interval_sql(26.0)}, {union_sql()}, {VISUAL}, {POINTIMP},
    net AS (SELECT layer_id, ord1, ord2, count_if({grid_dist('(x1 + (x2 - x1) * k / 10.0)', '(y1 + (y2 - y1) * k / 10.0)')} <= 21.0 + 1e-9) AS n FROM pairs, range(11) r(k)
      WHERE {grid_dist('x1', 'y1')} <= 56 AND {grid_dist('x2', 'y2')} <= 56 GROUP BY ALL HAVING n / 11.0 >= 0.4),
    m AS (SELECT layer_id, ord1, ord2, n IS NOT NULL AS has_network, vis.d IS NOT NULL AS has_visual FROM net FULL JOIN vis USING (layer_id, ord1, ord2)),
    prio AS (SELECT p.*, has_network, has_visual, least(1.0, (a.importance + b.importance) / 2.0 * 0.3 + {BAND} * 0.5 + {PAIRW} * 0.2) AS priority FROM pairs p JOIN m USING (layer_id, ord1, ord2)
      JOIN importance a ON a.layer_id = p.layer_id AND a.ord = ord1 JOIN importance b ON b.layer_id = p.layer_id AND b.ord = ord2)
    SELECT layer_id, ord1, ord2, round(d, 6) AS distance, round(priority, 6) AS priority, has_network, has_visual FROM prio WHERE priority >= 0.3 QUALIFY row_number() OVER (PARTITION BY layer_id ORDER BY round(priority, 9) DESC, ord1, ord2) <= 20"""))
def q04(spark, sf):
    c = J.optimal_connections(T.points(spark, sf), T.skeleton(spark, sf), T.streets(spark, sf), 15.0, 100.0)
    return c.select("layer_id", "ord1", "ord2", R6("d").alias("distance"), R6("priority").alias("priority"), "has_network", "has_visual")


@query("q05_smart_links", sql("points", f"{pair_sql(0.0, 100.0)}, {held_sql(9.0, 0.8)}, {FREE} SELECT layer_id, ord1, ord2, category1, category2, round(d, 6) AS distance FROM free"))
def q05(spark, sf):
    return L.road_links(T.points(spark, sf), T.streets(spark, sf), 0.0, 100.0).select("layer_id", "ord1", "ord2", "category1", "category2", R6("d").alias("distance"))


@query("q01_detection_run")
def q01(spark, sf):
    return J.detection_report(T.streets(spark, sf), PX)


@query("m15_site_placement")
def m15(spark, sf):
    from roadpoints.operators.lines import place_sites
    return place_sites(T.reference_points(spark, sf), T.districts(spark, sf), 50.0).select("layer_id", "round", "ord", "gain_area")


FEET = """f AS MATERIALIZED (SELECT layer_id, ord, CASE WHEN dh <= dv THEN x ELSE 200 * round(x / 200) END AS x, CASE WHEN dh <= dv THEN 200 * round(y / 200) ELSE y END AS y
    FROM (SELECT *, abs(x - 200 * round(x / 200)) AS dv, abs(y - 200 * round(y / 200)) AS dh FROM points)),
    fp AS MATERIALIZED (SELECT a.layer_id, a.ord AS ord1, b.ord AS ord2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
      FROM f a JOIN f b ON a.layer_id = b.layer_id AND a.ord < b.ord WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) BETWEEN 15 AND 50)"""


def feet(spark, sf):
    n = L.nearest_segment(T.points(spark, sf), T.streets(spark, sf))
    from roadpoints.operators.cuts import cut
    return cut(n.select("layer_id", "ord", R6("foot_x").alias("x"), R6("foot_y").alias("y"), "category"))


@query("j44_projected_links", sql("points", f"""{FEET} SELECT layer_id, ord1, ord2, round(d, 6) AS distance FROM fp p WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.layer_id = p.layer_id
    AND (o.x <> x1 OR o.y <> y1) AND (o.x <> x2 OR o.y <> y2) AND {segd('o.x', 'o.y')} <= 1.0)"""))
def j44(spark, sf):
    f = feet(spark, sf)
    links = pairs_within(f, 15.0, 50.0)
    end = ((F.col("x") == F.col("x1")) & (F.col("y") == F.col("y1"))) | ((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))
    held = L.rows_near_links(links, f, 1.0).where(~end).select("layer_id", "ord1", "ord2").distinct()
    return links.join(held, ["layer_id", "ord1", "ord2"], "left_anti").select("layer_id", "ord1", "ord2", R6("d").alias("distance"))


@query("g25_same_segment_pairs", sql("points", """v AS (SELECT *, abs(x - 200 * round(x / 200)) AS dv, abs(y - 200 * round(y / 200)) AS dh FROM points),
    s AS (SELECT layer_id, ord, CASE WHEN dh <= dv THEN round(y / 200) ELSE 100 + round(x / 200) END AS line, CASE WHEN dh <= dv THEN x ELSE y END AS m FROM v WHERE least(dv, dh) <= 2 AND dh <> dv),
    k AS (SELECT *, floor(m / 200) AS part FROM s WHERE m < 2000 AND m % 200 <> 0)
    SELECT layer_id, min(ord) AS ord1, max(ord) AS ord2, round(max(m) - min(m), 6) AS distance, 'same_segment' AS type FROM k GROUP BY layer_id, line, part HAVING count(*) = 2"""))
def g25(spark, sf):
    # a site as near to two streets counts on the one of the smaller number, one on a junction in the part that begins there
    n = L.nearest_segment(T.points(spark, sf), T.streets(spark, sf), cap=2.0).where("near_line is not null")
    k = n.withColumn("part", F.floor(F.col("measure") / 200)).groupBy("layer_id", "near_line", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord1"), F.max("ord").alias("ord2"), R6(F.max("measure") - F.min("measure")).alias("distance"))
    return k.where("n = 2").select("layer_id", "ord1", "ord2", "distance", F.lit("same_segment").alias("type"))


@query("r05_skeleton_lines")
def r05_lines(spark, sf):
    lines = R.skeleton_lines(R.thin(pixels(spark, sf)), PX)
    return lines.groupBy("layer_id", F.col("seg.u").alias("u"), F.col("seg.v").alias("v")).agg(F.count(F.lit(1)).alias("vertices"), F.max("step").alias("last_step"))


@query("q02_district_run")
def q02(spark, sf):
    _, found = J.district_run(T.streets(spark, sf), district_edges(spark, sf), PX)
    return found.groupBy("layer_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query("q03_batch_report", sql("points", """SELECT layer_id, count_if(category = 'intersection')::BIGINT AS intersection, count_if(category = 'curve')::BIGINT AS curve, count_if(category = 'endpoint')::BIGINT AS endpoint,
    count(*) AS total, round(avg(count(*)) OVER (), 6) AS batch_mean FROM points GROUP BY layer_id"""))
def q03(spark, sf):
    return J.batch_report(T.points(spark, sf)).withColumn("batch_mean", R6("batch_mean"))


@query("q07_evaluation")
def q07(spark, sf):
    want = T.labels_before(spark, sf).groupBy("layer_id").agg(F.count(F.lit(1)).alias("expected"))
    return J.evaluate(T.points(spark, sf), want, T.skeleton(spark, sf), T.streets(spark, sf))


@query("q10_curves_of_all")
def q10(spark, sf):
    return J.curves_of_all(T.waves(spark, sf), T.points(spark, sf).where("category = 'intersection'")).select("layer_id", "ord", "detector")


@query("l05_deletion_candidates", sql("points layers", f"""{NODES}, s AS (SELECT p.layer_id, p.ord, min(sqrt((p.x - j.x) * (p.x - j.x) + (p.y - j.y) * (p.y - j.y))) AS d FROM points p JOIN jn j USING (layer_id) WHERE p.category <> 'intersection' GROUP BY ALL)
    SELECT layer_id, ord, round(1.0 / (1.0 + d / 50), 6) AS priority, row_number() OVER (PARTITION BY layer_id ORDER BY d, ord) AS rank FROM s QUALIFY rank <= 5"""))
def l05(spark, sf):
    from roadpoints.operators.sequence import top_n
    from roadpoints.plans.graph_queries import network
    n, _ = network(spark, sf)
    s = nearest(T.points(spark, sf).where("category <> 'intersection'"), n)
    return top_n(s, 5, [F.col("near_d"), F.col("ord")]).select("layer_id", "ord", R6(1.0 / (1.0 + F.col("near_d") / 50)).alias("priority"), "rank")
