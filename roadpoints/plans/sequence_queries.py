"""Queries along ordered vertices: angles, turns, runs, ends, ranks."""

from __future__ import annotations


from pyspark.sql import functions as F

from roadpoints.functions.geom import dist
from roadpoints.operators import curves as K
from roadpoints.operators.sequence import framed, ranked, with_position
from roadpoints.plans import tables as T
from roadpoints.plans.registry import query
from roadpoints.plans.tables import sql

R6 = lambda c: F.round(c, 6)
POS = "s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY layer_id ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY layer_id) AS n FROM skeleton)"
LL = """v AS MATERIALIZED (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x, 2) OVER w AS p2x, lag(y, 2) OVER w AS p2y,
    lead(x, 2) OVER w AS n2x, lead(y, 2) OVER w AS n2y FROM s WINDOW w AS (PARTITION BY layer_id ORDER BY pos))"""


def ang(ux, uy, vx, vy):
    return f"acos(greatest(-1.0, least(1.0, (({ux}) * ({vx}) + ({uy}) * ({vy})) / nullif(sqrt(({ux}) * ({ux}) + ({uy}) * ({uy})) * sqrt(({vx}) * ({vx}) + ({vy}) * ({vy})), 0))))"


INTERIOR = ang("px - x", "py - y", "nx - x", "ny - y")
TURN = ang("x - px", "y - py", "nx - x", "ny - y")


@query("w01_w02_steps", sql("skeleton", f"""{POS}, {LL}, a AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS pd, atan2(y - py, x - px) AS pa,
      sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) AS nd, atan2(ny - y, nx - x) AS na FROM v), c AS (SELECT *, abs(na - pa) AS k FROM a)
    SELECT layer_id, ord, round(coalesce(pd, 0), 6) AS prev_d, round(coalesce(pa, 0), 6) AS prev_a, round(coalesce(nd, 0), 6) AS next_d, round(coalesce(na, 0), 6) AS next_a,
      round(coalesce(CASE WHEN k > pi() THEN 2 * pi() - k ELSE k END, 0), 6) AS curvature FROM c"""))
def w01(spark, sf):
    return K.steps(T.skeleton(spark, sf)).select("layer_id", "ord", *[R6(c).alias(c) for c in ("prev_d", "prev_a", "next_d", "next_a", "curvature")])


def _islands(gap, size, src):
    return f"""hit AS MATERIALIZED ({src}), g AS (SELECT *, sum(CASE WHEN step IS NULL OR step > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY layer_id ORDER BY pos) AS run
      FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY layer_id ORDER BY pos) AS step FROM hit)),
    m AS (SELECT *, row_number() OVER (PARTITION BY layer_id, run ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY layer_id, run) AS size FROM g)
    SELECT layer_id, ord, pos, size AS run_size FROM m WHERE size >= {size} AND i = size // 2"""


@query("w03_interior_angles", sql("skeleton", f"{POS}, {LL} SELECT layer_id, ord, round(degrees({INTERIOR}), 4) AS angle FROM v WHERE px IS NOT NULL AND nx IS NOT NULL AND {INTERIOR} IS NOT NULL"))
def w03(spark, sf):
    return K.vertex_angles(T.skeleton(spark, sf)).select("layer_id", "ord", F.round("angle", 4).alias("angle"))


@query("w03_w10_w11_turn_curves", sql("skeleton", f"{POS}, {LL}, {_islands(10, 1, f'SELECT * FROM v WHERE degrees({TURN}) > 30')}"))
def w03_curves(spark, sf):
    return K.angle_curves(T.skeleton(spark, sf), turn=True, min_size=1).select("layer_id", "ord", "pos", "run_size")


@query("w10_islands_parity", sql("skeleton", f"{POS}, {LL}, {_islands(10, 3, f'SELECT * FROM v WHERE degrees({INTERIOR}) > 30')}"))
def w10(spark, sf):
    return K.angle_curves(T.skeleton(spark, sf)).select("layer_id", "ord", "pos", "run_size")


@query("w04_sharp_turns", sql("skeleton", f"{POS}, {LL} SELECT layer_id, ord, row_number() OVER (PARTITION BY layer_id ORDER BY pos) AS rank FROM v WHERE {TURN} > pi() / 3"))
def w04(spark, sf):
    return K.sharp_turns(T.skeleton(spark, sf)).select("layer_id", "ord", "rank")


FRAMES = f"""{POS}, f AS (SELECT *, avg(x) OVER b AS bx, avg(y) OVER b AS bxy, avg(x) OVER a AS fx, avg(y) OVER a AS fy FROM s
    WINDOW b AS (PARTITION BY layer_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY layer_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    fa AS MATERIALIZED (SELECT *, degrees({ang('bx - x', 'bxy - y', 'fx - x', 'fy - y')}) AS angle FROM f WHERE pos >= 5 AND pos < n - 5)"""


@query("w05_frame_angles", sql("skeleton", f"{FRAMES} SELECT layer_id, ord, round(angle, 4) AS angle FROM fa"))
def w05(spark, sf):
    return K.frame_angles(T.skeleton(spark, sf)).select("layer_id", "ord", F.round("angle", 4).alias("angle"))


@query("w05_frame_curves", sql("skeleton", f"{FRAMES}, {_islands(40, 3, 'SELECT * FROM fa WHERE angle > 25')}"))
def w05_curves(spark, sf):
    return K.frame_curves(T.skeleton(spark, sf)).select("layer_id", "ord", "pos", "run_size")


STENCIL = ", ".join([ang("px - p2x", "py - p2y", "x - px", "y - py"), TURN, ang("nx - x", "ny - y", "n2x - nx", "n2y - ny")])


@query("w06_stencil_turns", sql("skeleton", f"""{POS}, {LL}, t AS (SELECT *, list_filter([{STENCIL}], lambda z: z IS NOT NULL) AS a FROM v WHERE p2x IS NOT NULL AND n2x IS NOT NULL)
    SELECT layer_id, ord, round(list_max(a), 6) AS max_turn, round(list_avg(a), 6) AS mean_turn FROM t WHERE len(a) > 0 AND list_max(a) > 0.4 AND list_avg(a) > 0.2"""))
def w06(spark, sf):
    return K.stencil_turns(with_position(T.skeleton(spark, sf))).select("layer_id", "ord", R6("max_turn").alias("max_turn"), R6("mean_turn").alias("mean_turn"))


@query("p15_resampled_skeleton", sql("skeleton", f"""{POS}, {LL}, st AS (SELECT layer_id, pos, x, y, px, py, nx, ny,
      -- acc over the next two rows is enough on the 10 m grid: one step is 10 or a jump of at least 15
      CASE WHEN sqrt((nx - x) ** 2 + (ny - y) ** 2) >= 15 THEN pos + 1 WHEN n2x IS NOT NULL THEN pos + 2 END AS nxt, n FROM v),
    r AS (SELECT layer_id, pos, nxt FROM st WHERE pos = 0 UNION ALL SELECT s2.layer_id, s2.pos, s2.nxt FROM r JOIN st s2 ON s2.layer_id = r.layer_id AND s2.pos = r.nxt),
    e AS (SELECT layer_id, max(pos) AS lastpos FROM r GROUP BY ALL),
    tail AS (SELECT s.layer_id, s.pos FROM s JOIN e USING (layer_id) JOIN s b ON b.layer_id = e.layer_id AND b.pos = e.lastpos
      WHERE s.pos = s.n - 1 AND s.pos > e.lastpos AND sqrt((s.x - b.x) ** 2 + (s.y - b.y) ** 2) > 7.5)
    SELECT layer_id, ord, s.pos FROM s JOIN (SELECT layer_id, pos FROM r UNION ALL SELECT layer_id, pos FROM tail) USING (layer_id, pos)"""))
def p15(spark, sf):
    return K.resample(T.skeleton(spark, sf)).select("layer_id", "ord", "pos")


def _smoothed(order):
    g = lambda c, d, src: f"(SELECT *, CASE WHEN pos = 0 THEN lead({c}) OVER w - {c} WHEN pos = n - 1 THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS {d} FROM {src} WINDOW w AS (PARTITION BY layer_id, road_id ORDER BY pos))"
    head = f"""{POS.replace("PARTITION BY layer_id", "PARTITION BY layer_id, road_id").replace("skeleton", "bends")}, k AS (SELECT i, exp(-0.5 * (i / 2.0) ** 2) / (SELECT sum(exp(-0.5 * (j / 2.0) ** 2)) FROM range(-8, 9) t(j)) AS wt FROM range(-8, 9) r(i)),
      m AS (SELECT a.layer_id, a.road_id, a.ord, a.pos, a.n, k.wt, ((a.pos + k.i) % (2 * a.n) + 2 * a.n) % (2 * a.n) AS q FROM s a, k),
      z AS (SELECT m.layer_id, m.road_id, m.ord, m.pos, m.n, sum(m.wt * b.x) AS sx, sum(m.wt * b.y) AS sy FROM m JOIN s b ON b.layer_id = m.layer_id AND b.road_id = m.road_id AND b.pos = CASE WHEN q < m.n THEN q ELSE 2 * m.n - 1 - q END GROUP BY ALL),
      d1 AS {g('sx', 'dx', 'z')}, d2 AS {g('sy', 'dy', 'd1')}"""
    if order == 1:
        return f"{head}, a AS (SELECT *, atan2(dy, dx) AS t FROM d2), e AS {g('t', 'c', 'a')} SELECT layer_id, ord, round(abs(c), 4) AS curvature FROM e"
    head += f", d3 AS {g('dx', 'ddx', 'd2')}, d4 AS {g('dy', 'ddy', 'd3')}, d5 AS {g('ddx', 'd3x', 'd4')}, d6 AS {g('ddy', 'd3y', 'd5')}"
    c = "abs(dx * ddy - dy * ddx) / CASE WHEN (dx * dx + dy * dy) ** 1.5 = 0 THEN 1e-10 ELSE (dx * dx + dy * dy) ** 1.5 END" + (" + 0.1 * abs(d3x + d3y)" if order == 3 else "")
    return f"{head} SELECT layer_id, ord, round({c}, 4) AS curvature FROM d6"


def _w07(name, order):
    @query(name, sql("bends", _smoothed(order)))
    def run(spark, sf):
        """Every vertex of every road, each road smoothed by itself."""
        road = ("layer_id", "road_id")
        g = K.smoothed_curvature(with_position(T.bends(spark, sf), road, total="n"), order=order, keys=road)
        return g.select("layer_id", "ord", F.round("curvature", 4).alias("curvature"))


_w07("w07_smoothed_curvature", 1)
_w07("w07_smoothed_curvature_2", 2)
_w07("w07_smoothed_curvature_3", 3)


@query("w09_arc_curvature", sql("streets", """m AS (SELECT layer_id, road_id, i, (i * 15)::DOUBLE % 2000.0 AS arc FROM streets, range(133) r(i))
    SELECT layer_id, road_id, i, round(CASE WHEN road_id < 100 THEN arc ELSE (road_id - 100) * 200 END, 6) AS x, round(CASE WHEN road_id < 100 THEN road_id * 200 ELSE arc END, 6) AS y,
      0.0::DOUBLE AS curvature FROM m"""))
def w09(spark, sf):
    line = T.skeleton(spark, sf).withColumn("pos", F.col("ord"))
    return K.arc_curvature(line).select("layer_id", "road_id", F.col("i").cast("long").alias("i"), R6("x").alias("x"), R6("y").alias("y"), F.round("curvature", 5).alias("curvature"))


@query("w12_sequence_ends", sql("skeleton", """e AS (SELECT layer_id, arg_min({'x': x, 'y': y}, ord) AS a, arg_max({'x': x, 'y': y}, ord) AS b FROM skeleton GROUP BY ALL)
    SELECT layer_id, a.x AS x, a.y AS y FROM e UNION ALL SELECT layer_id, b.x, b.y FROM e WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) >= 25"""))
def w12(spark, sf):
    return K.sequence_ends(T.skeleton(spark, sf)).select("layer_id", "x", "y")


@query("w14_circle_curvature", sql("points skeleton", """h AS (SELECT p.layer_id, p.ord, s.x, s.y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY p.layer_id, p.ord) AS n
      FROM points p JOIN skeleton s ON s.layer_id = p.layer_id AND sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) < 30 WHERE p.category = 'curve' WINDOW w AS (PARTITION BY p.layer_id, p.ord ORDER BY s.ord)),
    t AS (SELECT layer_id, ord, max(x) FILTER (i = 0) AS ax, max(y) FILTER (i = 0) AS ay, max(x) FILTER (i = n // 2) AS bx, max(y) FILTER (i = n // 2) AS by_, max(x) FILTER (i = n - 1) AS cx, max(y) FILTER (i = n - 1) AS cy
      FROM h WHERE n >= 3 GROUP BY ALL),
    l AS (SELECT *, sqrt((bx - cx) ** 2 + (by_ - cy) ** 2) AS a, sqrt((ax - cx) ** 2 + (ay - cy) ** 2) AS b, sqrt((ax - bx) ** 2 + (ay - by_) ** 2) AS c FROM t),
    k AS (SELECT layer_id, ord, 4 * sqrt(greatest(0, (a + b + c) / 2 * ((a + b + c) / 2 - a) * ((a + b + c) / 2 - b) * ((a + b + c) / 2 - c))) / nullif(a * b * c, 0) AS k FROM l)
    SELECT p.layer_id, p.ord, round(coalesce(k, 0), 6) AS curvature FROM points p LEFT JOIN k USING (layer_id, ord) WHERE p.category = 'curve' AND round(coalesce(k, 0), 6) > 0.01"""))
def w14(spark, sf):
    c = K.circle_curvature(T.points(spark, sf).where("category = 'curve'"), T.skeleton(spark, sf))
    return c.select("layer_id", "ord", R6("curvature").alias("curvature")).where("curvature > 0.01")


@query("w16_importance_rank", sql("points", "SELECT layer_id, ord, row_number() OVER (PARTITION BY layer_id ORDER BY x DESC, ord) AS rank FROM points"))
def w16(spark, sf):
    return ranked(T.points(spark, sf), "x").select("layer_id", "ord", "rank")


@query("w17_even_subsample", sql("skeleton", f"{POS} SELECT layer_id, ord FROM s WHERE pos % 4 = 0"))
def w17(spark, sf):
    """Every fourth row of a layer's order: the step is the caller's."""
    return with_position(T.skeleton(spark, sf)).where("pos % 4 = 0").select("layer_id", "ord")


@query("w18_sliding_window", sql("skeleton", f"""{POS} SELECT layer_id, ord, count(*) OVER w AS members, round(avg(x) OVER w, 6) AS mean_x, round(avg(y) OVER w, 6) AS mean_y FROM s
    WINDOW w AS (PARTITION BY layer_id ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)"""))
def w18(spark, sf):
    def build(w):
        f = w.rowsBetween(-50, 50)
        return {"members": F.count(F.lit(1)).over(f), "mean_x": F.avg("x").over(f), "mean_y": F.avg("y").over(f)}
    s = framed(with_position(T.skeleton(spark, sf)), build, 50, 50)
    return s.select("layer_id", "ord", "members", R6("mean_x").alias("mean_x"), R6("mean_y").alias("mean_y"))


@query("w15_index_ends", sql("skeleton", f"{POS} SELECT layer_id, ord, pos FROM s WHERE pos < 20 OR pos >= n - 20"))
def w15(spark, sf):
    return with_position(T.skeleton(spark, sf), total="n").where("pos < 20 or pos >= n - 20").select("layer_id", "ord", "pos")


@query("p20_box_distance", sql("points", """SELECT p.layer_id, ord, round(least(x - minx, maxx - x, y - miny, maxy - y), 6) AS box_distance FROM points p
    JOIN (SELECT layer_id, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM points GROUP BY ALL) b USING (layer_id)"""))
def p20(spark, sf):
    p = T.points(spark, sf)
    return p.join(K.bounds(p), "layer_id").select("layer_id", "ord", R6(K.box_gap()).alias("box_distance"))


@query("r06_road_ends", sql("skeleton", """b AS (SELECT layer_id, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM skeleton GROUP BY ALL)
    SELECT layer_id, ord, x, y FROM skeleton s JOIN b USING (layer_id) WHERE least(x - minx, maxx - x, y - miny, maxy - y) < 30 AND (SELECT count(*) FROM skeleton o WHERE o.layer_id = s.layer_id
      AND o.x BETWEEN s.x - 25 AND s.x + 25 AND o.y BETWEEN s.y - 25 AND s.y + 25 AND (o.x <> s.x OR o.y <> s.y) AND sqrt((o.x - s.x) ** 2 + (o.y - s.y) ** 2) < 25) <= 4"""))
def r06(spark, sf):
    s = T.skeleton(spark, sf)
    return K.road_ends(s, s, radius=25.0, most=4).select("layer_id", "ord", "x", "y")


@query("e31_line_steps", sql("skeleton", """d AS (SELECT layer_id, road_id, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d FROM skeleton WINDOW w AS (PARTITION BY layer_id, road_id ORDER BY ord))
    SELECT layer_id, road_id, count(d) AS steps, round(avg(d), 6) AS mean_step, round(min(d), 6) AS min_step, round(max(d), 6) AS max_step FROM d GROUP BY ALL"""))
def e31(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("layer_id", "road_id").orderBy("ord")
    d = T.skeleton(spark, sf).withColumn("d", dist("x", "y", F.lead("x").over(w), F.lead("y").over(w)))
    return d.groupBy("layer_id", "road_id").agg(F.count("d").alias("steps"), R6(F.avg("d")).alias("mean_step"), R6(F.min("d")).alias("min_step"), R6(F.max("d")).alias("max_step"))


@query("r07_edge_curves")
def r07(spark, sf):
    return K.edge_curves(T.waves(spark, sf)).select("layer_id", "cluster", "ord", "x", "y")


@query("r08_edge_curves_per_road")
def r08(spark, sf):
    return K.edge_curves(T.waves(spark, sf), weighted=False, per_road=True).select("layer_id", "road_id", "cluster", "ord", "x", "y")
