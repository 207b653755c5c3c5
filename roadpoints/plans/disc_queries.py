"""Queries on what lies in a disc around a site, and on sharp vertices of rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpoints.operators import discs as D, lines as LN
from roadpoints.plans import tables as T
from roadpoints.plans.registry import query
from roadpoints.plans.tables import sql

R6 = lambda c: F.round(c, 6).alias(c)


def disc_sql(source: str, radius: float) -> str:
    """Tables c (an edge's piece in the disc of a site) and g (sums per site and ring) over ``source`` (layer_id, ord, ring, ux, uy, vx, vy).

    Another way than the operator's: every edge of a ring counts, those outside by the angle they sweep.
    """
    r2 = radius * radius
    swept = lambda ax, ay, bx, by: f"atan2(({ax}) * ({by}) - ({ay}) * ({bx}), ({ax}) * ({bx}) + ({ay}) * ({by}))"
    p, q = ("ux + t1 * dx", "uy + t1 * dy"), ("ux + t2 * dx", "uy + t2 * dy")
    return f"""e1 AS (SELECT *, vx - ux AS dx, vy - uy AS dy FROM {source}),
      e2 AS (SELECT *, dx * dx + dy * dy AS a, ux * dx + uy * dy AS b, (ux * dx + uy * dy) ** 2 - (dx * dx + dy * dy) * (ux * ux + uy * uy - {r2}) AS q FROM e1),
      e3 AS (SELECT *, CASE WHEN q > 0 THEN greatest(0.0, (-b - sqrt(greatest(q, 0.0))) / a) ELSE 1.0 END AS t1, CASE WHEN q > 0 THEN least(1.0, (-b + sqrt(greatest(q, 0.0))) / a) ELSE 0.0 END AS t2 FROM e2),
      c AS (SELECT layer_id, ord, ring, CASE WHEN t1 < t2 THEN (t2 - t1) * sqrt(a) ELSE 0.0 END AS len, CASE WHEN t1 < t2 THEN (t2 - t1) * (ux * dy - uy * dx) / 2 ELSE 0.0 END AS area,
        CASE WHEN t1 < t2 THEN CASE WHEN t1 > 0 THEN {swept('ux', 'uy', *p)} ELSE 0.0 END + CASE WHEN t2 < 1 THEN {swept(*q, 'vx', 'vy')} ELSE 0.0 END ELSE {swept('ux', 'uy', 'vx', 'vy')} END AS arc FROM e3),
      g AS (SELECT layer_id, ord, ring, sum(len) AS len, sum(area) AS area, sum(arc) AS arc FROM c GROUP BY ALL)"""


FLOW = f"""n AS (SELECT p.layer_id, p.ord, e.ring, e.x1 - p.x AS ux, e.y1 - p.y AS uy, e.x2 - p.x AS vx, e.y2 - p.y AS vy FROM points p JOIN outline_edges e ON e.layer_id = p.layer_id
        AND (e.ring = 0 OR (p.x BETWEEN (e.ring - 1) // 10 * 200 - 45 AND (e.ring - 1) // 10 * 200 + 245 AND p.y BETWEEN (e.ring - 1) % 10 * 200 - 45 AND (e.ring - 1) % 10 * 200 + 245))),
      {disc_sql('n', 40.0)},
      f0 AS (SELECT layer_id, ord, sum(area) + 800.0 * sum(arc) AS road_area, sum(len) + 40.0 * sum(arc) AS road_length FROM g GROUP BY ALL),
      f AS (SELECT *, road_area * 0.1 + road_length * 10 AS flow_score, road_area > 1000 OR road_length > 100 AS is_major FROM f0)"""


def flow(spark, sf):
    return D.disc_flow(T.points(spark, sf), T.outline_edges(spark, sf))


@query("e09_disc_flow", sql("points outline_edges", f"""{FLOW} SELECT layer_id, ord, round(road_area, 4) AS road_area, round(road_length, 4) AS road_length, round(flow_score, 4) AS flow_score, is_major FROM f"""))
def e09(spark, sf):
    return flow(spark, sf).select("layer_id", "ord", *[F.round(c, 4).alias(c) for c in ("road_area", "road_length", "flow_score")], "is_major")


TURNS = """k AS (SELECT *, row_number() OVER (PARTITION BY layer_id, road_id ORDER BY ord) - 1 AS rn FROM bends),
      h AS (SELECT p.layer_id, p.ord, k.ord AS o, k.x, k.y FROM points p JOIN k ON k.layer_id = p.layer_id AND rn % 2 = 0 AND abs(k.x - p.x) <= 25 AND abs(k.y - p.y) <= 25 AND sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)) <= 25),
      v AS (SELECT layer_id, ord, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM h WINDOW w AS (PARTITION BY layer_id, ord ORDER BY o)),
      t AS (SELECT layer_id, ord, acos(greatest(-1.0, least(1.0, (ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_))))) AS turn, ax IS NOT NULL AND bx IS NOT NULL AS inner_ FROM v),
      s AS (SELECT layer_id, ord, count(*) AS m, avg(turn) FILTER (inner_) AS av, max(turn) FILTER (inner_) AS mx FROM t GROUP BY ALL),
      u0 AS (SELECT p.layer_id, p.ord, coalesce(m, 0) AS n_near, CASE WHEN m >= 3 THEN m / (pi() * 625) ELSE 0.0 END AS curve_density, CASE WHEN m >= 3 THEN av + mx * 0.5 ELSE 0.0 END AS curve_complexity,
        coalesce(m >= 3 AND mx > pi() / 6, false) AS is_critical FROM points p LEFT JOIN s ON s.layer_id = p.layer_id AND s.ord = p.ord),
      u AS (SELECT *, curve_density * curve_complexity * 100 AS curve_score FROM u0)"""


def turns(spark, sf):
    return D.disc_turns(T.points(spark, sf), T.bends(spark, sf).withColumnRenamed("road_id", "ring"))


@query("e08_disc_turns", sql("points bends", f"""{TURNS} SELECT layer_id, ord, n_near, round(curve_density, 6) AS curve_density, round(curve_complexity, 6) AS curve_complexity, round(curve_score, 6) AS curve_score, is_critical FROM u"""))
def e08(spark, sf):
    return turns(spark, sf).select("layer_id", "ord", "n_near", R6("curve_density"), R6("curve_complexity"), R6("curve_score"), "is_critical")


@query("e46_curve_and_flow", sql("points bends outline_edges", f"""{TURNS}, {FLOW} SELECT u.layer_id, u.ord, round(curve_score * 0.4 + flow_score * 0.6, 4) AS combined, is_critical, is_major FROM u JOIN f ON f.layer_id = u.layer_id AND f.ord = u.ord"""))
def e46(spark, sf):
    return D.curve_and_flow(turns(spark, sf), flow(spark, sf)).select("layer_id", "ord", F.round("combined", 4).alias("combined"), "is_critical", "is_major")


BOX = """b AS (SELECT layer_id, road_id AS ring, CASE WHEN road_id < 100 THEN x1 ELSE x1 - 6 END AS lx, CASE WHEN road_id < 100 THEN y1 - 6 ELSE y1 END AS ly, CASE WHEN road_id < 100 THEN x2 ELSE x2 + 6 END AS hx, CASE WHEN road_id < 100 THEN y2 + 6 ELSE y2 END AS hy FROM streets)"""
WIDTH = f"""{BOX}, o AS (SELECT p.layer_id, p.ord, p.x, p.y, b.ring, lx, ly, hx, hy, sqrt(greatest(lx - p.x, p.x - hx, 0.0) ** 2 + greatest(ly - p.y, p.y - hy, 0.0) ** 2) AS d FROM points p JOIN b ON b.layer_id = p.layer_id),
      w AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY layer_id, ord ORDER BY d, ring) = 1),
      n AS (SELECT layer_id, ord, ring, lx - x AS ux, ly - y AS uy, hx - x AS vx, ly - y AS vy FROM w UNION ALL SELECT layer_id, ord, ring, hx - x, ly - y, hx - x, hy - y FROM w
        UNION ALL SELECT layer_id, ord, ring, hx - x, hy - y, lx - x, hy - y FROM w UNION ALL SELECT layer_id, ord, ring, lx - x, hy - y, lx - x, ly - y FROM w),
      {disc_sql('n', 15.0)},
      near_ AS (SELECT p.layer_id, p.ord, count(*) AS m FROM points p JOIN skeleton s ON s.layer_id = p.layer_id AND abs(s.x - p.x) <= 15 AND abs(s.y - p.y) <= 15 AND (s.x - p.x) ** 2 + (s.y - p.y) ** 2 <= 225 GROUP BY ALL),
      z AS (SELECT w.layer_id, w.ord, w.ring, w.d AS road_d, (g.area + 112.5 * g.arc) / greatest(g.len + 15.0 * g.arc, 1.0) AS road_width, coalesce(m, 0) / (pi() * 225) AS skeleton_density
        FROM w JOIN g ON g.layer_id = w.layer_id AND g.ord = w.ord LEFT JOIN near_ q ON q.layer_id = w.layer_id AND q.ord = w.ord)"""


def width(spark, sf):
    return D.local_width(T.points(spark, sf), T.street_edges(spark, sf), T.skeleton(spark, sf))


@query("e07_local_width", sql("points streets skeleton", f"""{WIDTH} SELECT layer_id, ord, ring, round(road_d, 6) AS road_d, round(road_width, 6) AS road_width, round(skeleton_density, 6) AS skeleton_density, round(road_width * 10 + skeleton_density * 1000, 4) AS importance FROM z"""))
def e07(spark, sf):
    return width(spark, sf).select("layer_id", "ord", "ring", R6("road_d"), R6("road_width"), R6("skeleton_density"), F.round("importance", 4).alias("importance"))


LINE_SCORES = """l AS (SELECT layer_id, ord, (SELECT count(*) FROM range(11) r(k) WHERE abs(y - 200 * k) <= 40) + (SELECT count(*) FROM range(11) r(k) WHERE abs(x - 200 * k) <= 40) AS n40,
        (SELECT count(*) FROM range(11) r(k) WHERE abs(y - 200 * k) <= 50) * (SELECT count(*) FROM range(11) r(k) WHERE abs(x - 200 * k) <= 50) AS n50 FROM points)"""


@query("e13_combined_importance", sql("points streets skeleton", f"""{WIDTH}, {LINE_SCORES} SELECT z.layer_id, z.ord, round(road_width * 10 + skeleton_density * 1000, 4) AS basic, round(n50 * (10 + 5 * pi() / 2), 4) AS connectivity, n40 * 2000.0 AS flow, 0.0 AS curvature,
      round((road_width * 10 + skeleton_density * 1000) * 0.3 + n50 * (10 + 5 * pi() / 2) * 0.3 + n40 * 2000.0 * 0.2, 4) AS importance FROM z JOIN l ON l.layer_id = z.layer_id AND l.ord = z.ord"""))
def e13(spark, sf):
    sites, lines = T.points(spark, sf), T.streets(spark, sf)
    shape = LN.line_shape(T.skeleton(spark, sf))
    i = LN.site_importance(width(spark, sf), sites, lines, shape)
    return i.select("layer_id", "ord", *[F.round(c, 4).alias(c) for c in ("basic", "connectivity", "flow", "curvature", "importance")])


def _sharp(source: str, ring: str) -> str:
    return f"""p0 AS (SELECT layer_id, {ring} AS ring, ord, x, y, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY layer_id, {ring}) AS n, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM {source} WINDOW w AS (PARTITION BY layer_id, {ring} ORDER BY ord)),
      p1 AS (SELECT layer_id, ring, ord, x, y, pos FROM p0 UNION ALL SELECT layer_id, ring, NULL, fx, fy, n FROM p0 WHERE pos = n - 1 AND (x <> fx OR y <> fy)),
      a AS (SELECT *, atan2(lead(y) OVER w - y, lead(x) OVER w - x) AS t FROM p1 WINDOW w AS (PARTITION BY layer_id, ring ORDER BY pos)),
      d AS (SELECT *, CASE WHEN pos = 1 THEN t - lag(t) OVER w ELSE (t - lag(t, 2) OVER w) / 2 END AS g FROM a WINDOW w AS (PARTITION BY layer_id, ring ORDER BY pos))
      SELECT layer_id, ring, ord, round(x, 6) AS x, round(y, 6) AS y, round(abs(g), 6) AS change FROM d WHERE pos >= 1 AND t IS NOT NULL AND abs(g) > 0.3"""


@query("w08_sharp_vertices", sql("outline", _sharp("outline", "ring")))
def w08(spark, sf):
    return D.sharp_vertices(T.outline(spark, sf)).select("layer_id", "ring", "ord", R6("x"), R6("y"), R6("change"))


@query("w08_sharp_bends", sql("bends", _sharp("bends", "road_id")))
def w08_bends(spark, sf):
    rings = T.bends(spark, sf).withColumnRenamed("road_id", "ring")
    return D.sharp_vertices(rings).select("layer_id", "ring", "ord", R6("x"), R6("y"), R6("change"))
