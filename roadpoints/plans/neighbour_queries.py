"""Queries on neighbourhoods of points: joins by distance, counts, densities, importance, coverage."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from roadpoints.functions.geom import dist
from roadpoints.operators import links as L, stats as S
from roadpoints.operators.celljoin import around, cell, k_nearest, near_join, nearest, pairs_within
from roadpoints.plans import tables as T
from roadpoints.plans.link_queries import pair_sql
from roadpoints.plans.registry import query
from roadpoints.plans.tables import grid_dist, sql

R6 = lambda c: F.round(c, 6)
D = lambda a, b: f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


@query("j01_grid_key", sql("points", """SELECT layer_id, CAST(floor(x / 100) AS BIGINT) AS cell_x, CAST(floor(y / 100) AS BIGINT) AS cell_y,
    count(*) AS n, min(ord) AS first_ord FROM points GROUP BY ALL"""))
def j01(spark, sf):
    p = T.points(spark, sf)
    return p.groupBy("layer_id", cell("x", 100.0).alias("cell_x"), cell("y", 100.0).alias("cell_y")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


@query("j02_range_pairs", sql("points", f"{pair_sql(0.0, 20.0)} SELECT layer_id, ord1, ord2, round(d, 6) AS distance FROM pairs"))
def j02(spark, sf):
    return pairs_within(T.points(spark, sf), 0.0, 20.0).select("layer_id", "ord1", "ord2", R6("d").alias("distance"))


@query("j02_range_pairs_wide", sql("points", f"""{pair_sql(15.0, 300.0)} SELECT layer_id, count(*) AS pairs, round(avg(d), 6) AS mean_d,
    round(min(d), 6) AS min_d, round(max(d), 6) AS max_d FROM pairs GROUP BY ALL"""))
def j02_wide(spark, sf):
    return pairs_within(T.points(spark, sf), 15.0, 300.0).groupBy("layer_id").agg(
        F.count(F.lit(1)).alias("pairs"), R6(F.avg("d")).alias("mean_d"), R6(F.min("d")).alias("min_d"), R6(F.max("d")).alias("max_d"))


NEAR_SKEL = f"""nskel AS MATERIALIZED (SELECT p.layer_id, p.ord, p.x, p.y, p.category, min({{'d': {D('p', 's')}, 'ord': s.ord}}) AS m
    FROM points p JOIN skeleton s USING (layer_id) GROUP BY ALL)"""


@query("j03_nearest_skeleton", sql("points skeleton", f"{NEAR_SKEL} SELECT layer_id, ord, m.ord AS skeleton_ord, round(m.d, 6) AS distance FROM nskel"))
def j03(spark, sf):
    n = nearest(T.points(spark, sf), T.skeleton(spark, sf))
    return n.select("layer_id", "ord", F.col("near_ord").alias("skeleton_ord"), R6("near_d").alias("distance"))


@query("j03_nearest_skeleton_capped", sql("points skeleton", f"{NEAR_SKEL} SELECT layer_id, ord, CASE WHEN m.d <= 50 THEN m.ord END AS skeleton_ord FROM nskel"))
def j03_cap(spark, sf):
    n = nearest(T.points(spark, sf), T.skeleton(spark, sf), cap=50.0)
    return n.select("layer_id", "ord", F.col("near_ord").alias("skeleton_ord"))


@query("j04_five_nearest", sql("points reference_points", f"""r AS (SELECT s.layer_id, s.ord, {D('s', 'p')} AS d,
      row_number() OVER (PARTITION BY s.layer_id, s.ord ORDER BY {D('s', 'p')}) AS k FROM reference_points s JOIN points p USING (layer_id) QUALIFY k <= 5)
    SELECT s.layer_id, s.ord, {', '.join(f"round(coalesce(max(d) FILTER (k = {i}), 1000.0), 6) AS d{i}" for i in range(1, 6))}
    FROM reference_points s LEFT JOIN r USING (layer_id, ord) GROUP BY s.layer_id, s.ord"""))
def j04(spark, sf):
    k = k_nearest(T.reference_points(spark, sf), T.points(spark, sf), 5)
    return k.select("layer_id", "ord", *[R6(F.col("near_d")[i]).alias(f"d{i + 1}") for i in range(5)])


@query("j05_curves_off_intersections", sql("points", f"""SELECT layer_id, ord FROM points c WHERE category = 'curve' AND NOT EXISTS (
    SELECT 1 FROM points i WHERE i.category = 'intersection' AND i.layer_id = c.layer_id AND {D('c', 'i')} <= 10)"""))
def j05(spark, sf):
    p = T.points(spark, sf)
    return near_join(p.where("category = 'curve'"), p.where("category = 'intersection'").select("layer_id", "x", "y"), 10.0,
                     how="left_anti").select("layer_id", "ord")


def box_distance():
    dx = F.greatest(F.col("minx") - F.col("x"), F.lit(0.0), F.col("x") - F.col("maxx"))
    dy = F.greatest(F.col("miny") - F.col("y"), F.lit(0.0), F.col("y") - F.col("maxy"))
    return F.sqrt(dx * dx + dy * dy)


@query("j06_points_near_district", sql("points districts", """SELECT layer_id, ord FROM points JOIN districts USING (layer_id)
    WHERE sqrt(greatest(minx - x, 0, x - maxx) ** 2 + greatest(miny - y, 0, y - maxy) ** 2) <= 30"""))
def j06(spark, sf):
    # polygon rings go through the edge join; the boundary of a district here is its ring of four edges
    from roadpoints.operators.polygons import within_ring_distance
    return within_ring_distance(T.points(spark, sf), district_edges(spark, sf), 30.0).select("layer_id", "ord")


def district_edges(spark, sf):
    d = T.districts(spark, sf)
    c = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy")]
    edges = F.array(*[F.struct(F.lit(i).alias("edge_id"), F.col(c[i][0]).alias("x1"), F.col(c[i][1]).alias("y1"),
                               F.col(c[(i + 1) % 4][0]).alias("x2"), F.col(c[(i + 1) % 4][1]).alias("y2")) for i in range(4)])
    return d.select("layer_id", F.explode(edges).alias("e")).select("layer_id", "e.*")


@query("j07_reference_notes", sql("points reference_points", f"""near AS (SELECT p.layer_id, p.ord, min({{'d': {D('p', 'r')}, 'ord': r.ord}}) AS m
      FROM points p JOIN reference_points r USING (layer_id) WHERE {D('p', 'r')} <= 20 GROUP BY ALL)
    SELECT p.layer_id, p.ord, n.m.ord AS reference_ord, round(n.m.d, 2) AS reference_distance,
      CASE WHEN n.m IS NULL THEN '' WHEN p.kind = 'error' THEN 'kept by user' ELSE 'near known site' END AS note
    FROM points p LEFT JOIN near n USING (layer_id, ord)"""))
def j07(spark, sf):
    n = nearest(T.points(spark, sf), T.reference_points(spark, sf), cap=20.0)
    note = F.when(F.col("near_d").isNull(), "").when(F.col("kind") == "error", "kept by user").otherwise("near known site")
    return n.select("layer_id", "ord", F.col("near_ord").alias("reference_ord"), F.round("near_d", 2).alias("reference_distance"), note.alias("note"))


@query("j15_boundary_distance", sql("points districts", """r AS (SELECT layer_id, ord, x, y, minx, miny, maxx, maxy,
      x > minx AND x < maxx AND y > miny AND y < maxy AS inside FROM points JOIN districts USING (layer_id)),
    s AS (SELECT layer_id, ord, CASE WHEN inside THEN least(x - minx, maxx - x, y - miny, maxy - y)
      ELSE -sqrt(greatest(minx - x, 0, x - maxx) ** 2 + greatest(miny - y, 0, y - maxy) ** 2) END AS d FROM r)
    SELECT layer_id, ord, round(d, 6) + 0.0 AS distance, abs(d) <= 50 AS near_boundary, round(greatest(0, 1 - abs(d) / 200.0), 6) AS score FROM s"""))
def j15(spark, sf):
    from roadpoints.operators.polygons import boundary_distance
    b = boundary_distance(T.points(spark, sf), district_edges(spark, sf))
    d = F.col("boundary_d")
    return b.select("layer_id", "ord", (R6(d) + 0.0).alias("distance"), (F.abs(d) <= 50).alias("near_boundary"),
                    R6(F.greatest(F.lit(0.0), 1 - F.abs(d) / 200.0)).alias("score"))


@query("j14_point_on_road", sql("points", f"SELECT layer_id, ord FROM points WHERE {grid_dist()} <= 6"))
def j14(spark, sf):
    return L.on_road(T.points(spark, sf), T.streets(spark, sf)).where("on_road").select("layer_id", "ord")


@query("j16_snap_to_road", sql("points", """v AS (SELECT *, abs(x - 200 * round(x / 200)) AS dv, abs(y - 200 * round(y / 200)) AS dh FROM points)
    SELECT layer_id, ord, round(least(dv, dh), 6) AS distance,
      round(CASE WHEN least(dv, dh) <= 6 OR dh <= dv THEN x ELSE 200 * round(x / 200) + sign(x - 200 * round(x / 200)) * 6 END, 6) AS snap_x,
      round(CASE WHEN least(dv, dh) <= 6 OR dh > dv THEN y ELSE 200 * round(y / 200) + sign(y - 200 * round(y / 200)) * 6 END, 6) AS snap_y FROM v"""))
def j16(spark, sf):
    n = L.nearest_segment(T.points(spark, sf), T.streets(spark, sf))
    part = F.lit(6.0) / F.nullif("near_d", F.lit(0.0))
    off = F.col("near_d") > 6.0
    at = lambda p, f: F.when(off, F.col(f) + (F.col(p) - F.col(f)) * part).otherwise(F.col(p))
    return n.select("layer_id", "ord", R6("near_d").alias("distance"), R6(at("x", "foot_x")).alias("snap_x"), R6(at("y", "foot_y")).alias("snap_y"))


@query("j19_nearest_line", sql("points", """v AS (SELECT *, abs(x - 200 * round(x / 200)) AS dv, abs(y - 200 * round(y / 200)) AS dh FROM points)
    SELECT layer_id, ord, CAST(CASE WHEN dh <= dv THEN round(y / 200) ELSE 100 + round(x / 200) END AS BIGINT) AS line, round(least(dv, dh), 6) AS distance,
      round(CASE WHEN dh <= dv THEN x ELSE y END, 6) AS measure FROM v"""))
def j19(spark, sf):
    n = L.nearest_segment(T.points(spark, sf), T.streets(spark, sf))
    return n.select("layer_id", "ord", F.col("near_line").alias("line"), R6("near_d").alias("distance"), R6("measure").alias("measure"))


@query("j18_points_near_lines", sql("points", """SELECT layer_id, ord, k AS line, round(abs(y - 200 * k), 6) AS distance, round(x, 6) AS measure
      FROM points, range(11) r(k) WHERE abs(y - 200 * k) < 10 UNION ALL
    SELECT layer_id, ord, 100 + k, round(abs(x - 200 * k), 6), round(y, 6) FROM points, range(11) r(k) WHERE abs(x - 200 * k) < 10"""))
def j18(spark, sf):
    n = L.lines_near(T.points(spark, sf), T.streets(spark, sf), 10.0)
    return n.select("layer_id", "ord", "line", R6("d").alias("distance"), R6("measure").alias("measure"))


@query("j32_location_class", sql("points skeleton", f"""SELECT s.layer_id, s.ord, coalesce((SELECT min(CASE p.category WHEN 'intersection' THEN 1 WHEN 'curve' THEN 2 ELSE 3 END)
    FROM points p WHERE p.layer_id = s.layer_id AND p.x BETWEEN s.x - 5 AND s.x + 5 AND p.y BETWEEN s.y - 5 AND s.y + 5 AND {D('s', 'p')} < 5), 0) AS class_id FROM skeleton s"""))
def j32(spark, sf):
    return S.mark_class(T.skeleton(spark, sf), T.points(spark, sf)).select("layer_id", "ord", F.col("mark_class").alias("class_id"))


COUNTS = f"""cnt AS MATERIALIZED (SELECT p.layer_id, p.ord, p.category, p.kind, count_if(d <= 10) AS n10, count_if(d <= 30) AS n30, count_if(d <= 50) AS n50,
      min(d) AS dmin, count_if(d <= 25) AS n25, count_if(d <= 100) AS n100, count_if(d BETWEEN 5 AND 100) AS nring, sum(d) FILTER (d BETWEEN 5 AND 100) AS sring
    FROM (SELECT p.*, {D('p', 's')} AS d FROM points p JOIN skeleton s USING (layer_id)) p GROUP BY ALL)"""


@query("e01_skeleton_importance", sql("points skeleton", f"""{COUNTS} SELECT layer_id, ord,
    round(CASE category WHEN 'intersection' THEN 15.0 WHEN 'endpoint' THEN 7.0 ELSE 5.0 END + n10 * 3.0 + n30 * 2.0 + n50
      + CASE WHEN dmin < 5 THEN 5 WHEN dmin < 10 THEN 4 WHEN dmin < 15 THEN 3 WHEN dmin < 20 THEN 2 ELSE 1 END, 6) AS importance FROM cnt"""))
def e01(spark, sf):
    return S.skeleton_importance_score(T.points(spark, sf), T.skeleton(spark, sf)).select("layer_id", "ord", R6("importance").alias("importance"))


@query("e01_skeleton_importance_plain", sql("points skeleton", f"""{COUNTS} SELECT layer_id, ord,
    round(CASE category WHEN 'intersection' THEN 10.0 WHEN 'endpoint' THEN 7.0 ELSE 5.0 END + n10 * 3.0 + n30 * 2.0 + n50, 6) AS importance FROM cnt"""))
def e01_plain(spark, sf):
    return S.skeleton_importance_score(T.points(spark, sf), T.skeleton(spark, sf), banded=False).select("layer_id", "ord", R6("importance").alias("importance"))


@query("e02_local_density", sql("points skeleton", f"""{COUNTS} SELECT layer_id, ord, {', '.join(f"round(n{r} / (pi() * {r} * {r}) * 10000, 6) AS density{r}" for r in (25, 50, 100))} FROM cnt"""))
def e02(spark, sf):
    d = S.local_density(T.points(spark, sf), T.skeleton(spark, sf))
    return d.select("layer_id", "ord", *[R6(f"density{r}").alias(f"density{r}") for r in (25, 50, 100)])


OFFS = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in S.disc_samples(20.0))
# street ends stop at 0 and 2001, so a sample outside the box is measured to the end of its street
ROADAT = lambda x, y: (f"least(sqrt(({y} - 200 * least(10, greatest(0, round({y} / 200)))) ** 2 + greatest(0, -({x}), {x} - 2001) ** 2), "
                       f"sqrt(({x} - 200 * least(10, greatest(0, round({x} / 200)))) ** 2 + greatest(0, -({y}), {y} - 2001) ** 2))")
SKELIMP = f"""spots AS (SELECT layer_id, x, y, count(*) AS w FROM skeleton GROUP BY ALL),
    nb AS (SELECT a.layer_id, a.x, a.y, sum(b.w) - 1 AS n, sum({D('a', 'b')} * b.w) AS s FROM spots a JOIN spots b ON a.layer_id = b.layer_id
      AND b.x BETWEEN a.x - 30 AND a.x + 30 AND b.y BETWEEN a.y - 30 AND a.y + 30 AND {D('a', 'b')} <= 30 GROUP BY ALL),
    rs AS (SELECT layer_id, x, y, count_if({ROADAT('(x + ox)', '(y + oy)')} <= 6) / 32.0 AS share FROM spots, (VALUES {OFFS}) o(ox, oy) GROUP BY ALL),
    imp AS MATERIALIZED (SELECT layer_id, x, y, least(n / 10.0, 1.0) AS connectivity, least(share * 2.0, 1.0) AS road_width,
      CASE WHEN n > 0 THEN greatest(0, 1 - s / n / 30.0) ELSE 0 END AS centrality FROM nb JOIN rs USING (layer_id, x, y))"""


@query("e03_skeleton_site_importance", sql("skeleton", f"""{SKELIMP} SELECT layer_id, ord, round(connectivity, 6) AS connectivity, round(road_width, 6) AS road_width,
    round(centrality, 6) AS centrality, round(connectivity * 0.4 + road_width * 0.3 + centrality * 0.3, 6) AS total FROM skeleton JOIN imp USING (layer_id, x, y)"""))
def e03(spark, sf):
    s = T.skeleton(spark, sf)
    return S.skeleton_importance(s, s, T.streets(spark, sf)).select(
        "layer_id", "ord", *[R6(c).alias(c) for c in ("connectivity", "road_width", "centrality", "total")])


POINTIMP = f"""{NEAR_SKEL}, {SKELIMP}, importance AS MATERIALIZED (SELECT n.layer_id, n.ord, least(1.0, CASE n.category WHEN 'intersection' THEN 1.0 WHEN 'curve' THEN 0.7 ELSE 0.5 END * 0.4
      + (connectivity * 0.4 + road_width * 0.3 + centrality * 0.3) * 0.4 + greatest(0, 1 - n.m.d / 50.0) * 0.2) AS importance
    FROM nskel n JOIN skeleton s ON s.layer_id = n.layer_id AND s.ord = n.m.ord JOIN imp i ON i.layer_id = s.layer_id AND i.x = s.x AND i.y = s.y)"""


@query("e04_point_importance", sql("points skeleton", f"{POINTIMP} SELECT layer_id, ord, round(importance, 6) AS importance FROM importance"))
def e04(spark, sf):
    return S.point_importance(T.points(spark, sf), T.skeleton(spark, sf), T.streets(spark, sf)).select("layer_id", "ord", R6("importance").alias("importance"))


PAIRW = """CASE least(category1, category2) || '|' || greatest(category1, category2) WHEN 'intersection|intersection' THEN 1.0 WHEN 'curve|intersection' THEN 0.8
    WHEN 'endpoint|intersection' THEN 0.7 WHEN 'curve|curve' THEN 0.6 WHEN 'curve|endpoint' THEN 0.5 ELSE 0.4 END"""
BAND = "CASE WHEN d BETWEEN 50 AND 150 THEN 1.0 WHEN d >= 15 AND d < 50 THEN 0.8 WHEN d > 150 AND d <= 300 THEN 0.6 ELSE 0.2 END"
PRIORITY = f"""prio AS MATERIALIZED (SELECT p.*, least(1.0, (a.importance + b.importance) / 2.0 * 0.3 + {BAND} * 0.5 + {PAIRW} * 0.2) AS priority
    FROM pairs p JOIN importance a ON a.layer_id = p.layer_id AND a.ord = ord1 JOIN importance b ON b.layer_id = p.layer_id AND b.ord = ord2)"""


@query("e05_connection_priority", sql("points skeleton", f"{pair_sql(15.0, 100.0)}, {POINTIMP}, {PRIORITY} SELECT layer_id, ord1, ord2, round(priority, 6) AS priority FROM prio"))
def e05(spark, sf):
    p = T.points(spark, sf)
    imp = S.point_importance(p, T.skeleton(spark, sf), T.streets(spark, sf))
    return S.connection_priority(pairs_within(p, 15.0, 100.0), imp).select("layer_id", "ord1", "ord2", R6("priority").alias("priority"))


@query("e05_pair_weight_parity", sql("points", f"""{pair_sql(15.0, 50.0)} SELECT category1, category2, round(CASE WHEN least(category1, category2) || '|' || greatest(category1, category2)
    IN ('curve|intersection', 'endpoint|intersection') THEN 0.5 ELSE {PAIRW} END, 6) AS weight, count(*) AS n FROM pairs GROUP BY ALL"""))
def e05_parity(spark, sf):
    return (pairs_within(T.points(spark, sf), 15.0, 50.0).groupBy("category1", "category2").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("weight", S.pair_priority("category1", "category2", parity=True)))


@query("w13_top_connections", sql("points skeleton", f"""{pair_sql(15.0, 100.0)}, {POINTIMP}, {PRIORITY} SELECT layer_id, ord1, ord2, round(priority, 6) AS priority,
    row_number() OVER (PARTITION BY layer_id ORDER BY round(priority, 9) DESC, ord1, ord2) AS rank FROM prio WHERE priority >= 0.3 QUALIFY rank <= 20"""))
def w13(spark, sf):
    from roadpoints.operators.sequence import top_n
    p = T.points(spark, sf)
    imp = S.point_importance(p, T.skeleton(spark, sf), T.streets(spark, sf))
    pr = S.connection_priority(pairs_within(p, 15.0, 100.0), imp).where("priority >= 0.3")
    return top_n(pr, 20, [F.round("priority", 9).desc(), F.col("ord1"), F.col("ord2")]).select(
        "layer_id", "ord1", "ord2", R6("priority").alias("priority"), "rank")


@query("e06_hybrid_importance", sql("points skeleton", f"""{COUNTS} SELECT c.layer_id, c.ord, round(least(1.0, (n100 * 0.4 + greatest(0.3, 1 - greatest(0, {grid_dist()} - 6) / 200.0) * 0.3
    + coalesce(greatest(0.1, 1 - abs(sring / nullif(nring, 0) - 25) / 25), 1.0) * 0.3) / 10), 6) AS score FROM cnt c JOIN points USING (layer_id, ord)"""))
def e06(spark, sf):
    return S.hybrid_importance(T.points(spark, sf), T.skeleton(spark, sf), T.streets(spark, sf)).select("layer_id", "ord", R6("score").alias("score"))


@query("p23_importance_filter", sql("points skeleton", f"""{COUNTS} SELECT layer_id, ord FROM cnt WHERE round(least(1.0, (n100 * 0.4 + 0.3
    + coalesce(greatest(0.1, 1 - abs(sring / nullif(nring, 0) - 25) / 25), 1.0) * 0.3) / 10), 9) >= 0.9"""))
def p23(spark, sf):
    return S.hybrid_importance(T.points(spark, sf), T.skeleton(spark, sf)).where("round(score, 9) >= 0.9").select("layer_id", "ord")


STATS = """round(avg(d), 6) AS mean_d, round(min(d), 6) AS min_d, round(max(d), 6) AS max_d"""


@query("e14_e15_link_statistics", sql("points", f"""{pair_sql(15.0, 200.0)} SELECT layer_id, count(*) AS total, {STATS}, round(quantile_cont(d, 0.5), 6) AS median_d,
    round(stddev_pop(d), 6) AS std_d, count_if(d <= 50)::BIGINT AS short, count_if(d > 50 AND d <= 150)::BIGINT AS medium, count_if(d > 150)::BIGINT AS long FROM pairs GROUP BY layer_id"""))
def e14(spark, sf):
    s = S.link_statistics(pairs_within(T.points(spark, sf), 15.0, 200.0))
    return s.select("layer_id", "total", "short", "medium", "long", *[R6(c).alias(c) for c in ("mean_d", "min_d", "max_d", "median_d", "std_d")])


@query("e16_connected_counts", sql("points", f"""{pair_sql(0.0, 50.0)}, e AS (SELECT layer_id, ord1 AS ord FROM pairs UNION ALL SELECT layer_id, ord2 FROM pairs)
    SELECT p.layer_id, p.ord, count(e.ord) AS connected FROM points p LEFT JOIN e USING (layer_id, ord) GROUP BY ALL"""))
def e16(spark, sf):
    p = T.points(spark, sf)
    return S.connected_counts(p, pairs_within(p, 0.0, 50.0)).select("layer_id", "ord", "connected")


@query("e17_network_statistics", sql("points", f"""{pair_sql(0.0, 50.0)}, n AS (SELECT layer_id, count(*) AS nodes FROM points GROUP BY ALL)
    SELECT layer_id, nodes, count(*) AS connections, {STATS}, round(2.0 * count(*) / (nodes * (nodes - 1)), 6) AS density FROM pairs JOIN n USING (layer_id) GROUP BY layer_id, nodes"""))
def e17(spark, sf):
    p = T.points(spark, sf)
    s = S.network_statistics(p, pairs_within(p, 0.0, 50.0))
    return s.select("layer_id", "nodes", "connections", *[R6(c).alias(c) for c in ("mean_d", "min_d", "max_d", "density")])


@query("e20_mean_spacing", sql("points", f"""SELECT layer_id, round(avg(m), 6) AS spacing FROM (SELECT a.layer_id, a.ord, min({D('a', 'b')}) AS m FROM points a JOIN points b
    ON a.layer_id = b.layer_id AND a.ord <> b.ord GROUP BY ALL) GROUP BY ALL"""))
def e20(spark, sf):
    return S.mean_spacing(T.points(spark, sf)).select("layer_id", R6("spacing").alias("spacing"))


COVER = f"""cells AS (SELECT layer_id, i, j, (100 + j * 10)::DOUBLE AS x, (100 + i * 10)::DOUBLE AS y FROM districts, range(1, 180) a(i), range(1, 180) b(j)),
    hit AS MATERIALIZED (SELECT c.layer_id, c.i, c.j FROM cells c SEMI JOIN (SELECT layer_id, x, y FROM points) p ON p.layer_id = c.layer_id
      AND sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) <= RADIUS)"""
BOX = 3240000.0


@query("e19_coverage", sql("points districts", f"""{COVER.replace('RADIUS', '20')}, c AS (SELECT layer_id, count(*) * 100.0 AS covered FROM hit GROUP BY ALL),
      n AS (SELECT layer_id, count(*) AS num_points FROM points GROUP BY ALL),
      f AS (SELECT *, covered / {BOX} AS ratio, (num_points * pi() * 400 - covered) / (num_points * pi() * 400) AS overlap FROM c JOIN n USING (layer_id))
    SELECT layer_id, num_points, round(covered, 6) AS covered_area, round({BOX} - covered, 6) AS uncovered_area, round(ratio, 6) AS coverage_ratio,
      round(covered / num_points, 6) AS per_point, round(overlap, 6) AS overlap_ratio,
      round(greatest(0, least(1, ratio / least(num_points * pi() * 400 / {BOX}, 1.0) * (1 - overlap * 0.5))), 6) AS efficiency FROM f"""))
def e19(spark, sf):
    c = S.coverage(T.points(spark, sf), T.districts(spark, sf), 20.0)
    return c.select("layer_id", "num_points", *[R6(n).alias(n) for n in ("covered_area", "uncovered_area", "coverage_ratio", "per_point", "overlap_ratio", "efficiency")])


@query("e21_coverage_grid", sql("points districts", f"""{COVER.replace('RADIUS', '20')} SELECT layer_id, i AS gi, j AS gj FROM hit"""))
def e21(spark, sf):
    return S.covered(S.coverage_cells(T.districts(spark, sf)), T.points(spark, sf), 20.0).select("layer_id", F.col("gi").cast("long").alias("gi"), F.col("gj").cast("long").alias("gj"))


@query("e24_best_next_site", sql("points districts reference_points", f"""{COVER.replace('RADIUS', '30')},
    free AS (SELECT c.* FROM cells c ANTI JOIN hit h USING (layer_id, i, j)),
    g AS (SELECT r.layer_id, r.ord, count(*) * 100.0 AS gain_area FROM free f JOIN reference_points r ON r.layer_id = f.layer_id
      AND sqrt((f.x - r.x) * (f.x - r.x) + (f.y - r.y) * (f.y - r.y)) <= 30 GROUP BY ALL)
    SELECT layer_id, ord, gain_area FROM g QUALIFY row_number() OVER (PARTITION BY layer_id ORDER BY gain_area DESC, ord) = 1"""))
def e24(spark, sf):
    return S.best_next_site(T.points(spark, sf), T.reference_points(spark, sf), T.districts(spark, sf), 30.0)


MARKS = f"""mk AS MATERIALIZED (SELECT s.layer_id, s.ord, count_if(d <= 50 AND category = 'intersection') AS n_intersection, count_if(d <= 50 AND category = 'curve') AS n_curve,
    count_if(d <= 50 AND category = 'endpoint') AS n_endpoint, min(d) AS near_mark FROM (SELECT s.layer_id, s.ord, p.category, {D('s', 'p')} AS d FROM skeleton s JOIN points p USING (layer_id)) s GROUP BY ALL)"""


@query("e41_category_neighbourhood", sql("points skeleton", f"""{MARKS} SELECT layer_id, ord, n_intersection::BIGINT AS n_intersection, n_curve::BIGINT AS n_curve, n_endpoint::BIGINT AS n_endpoint,
    round(least(near_mark, 1000.0), 6) AS near_mark, round((n_intersection + n_curve + n_endpoint) / (pi() * 2500) * 1000, 6) AS mark_density FROM mk"""))
def e41(spark, sf):
    n = S.category_neighbourhood(T.skeleton(spark, sf), T.points(spark, sf))
    return n.select("layer_id", "ord", "n_intersection", "n_curve", "n_endpoint", R6("near_mark").alias("near_mark"), R6("mark_density").alias("mark_density"))
