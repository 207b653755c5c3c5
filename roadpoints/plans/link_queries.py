"""Queries on links between points."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpoints.functions.geom import dist, natural_direction, seg_dist
from roadpoints.operators import links as L
from roadpoints.operators.celljoin import near_join, nearest, pairs_within
from roadpoints.plans import tables as T
from roadpoints.plans.registry import query
from roadpoints.plans.tables import grid_dist, sql

R6 = lambda c: F.round(c, 6)


def pair_sql(lo: float, hi: float, strict: bool = False) -> str:
    """Pairs of points as SQL, using a join on cells of edge hi."""
    op = "<" if strict else "<="
    return f"""cells AS MATERIALIZED (SELECT *, CAST(floor(x / {hi}) AS BIGINT) AS cx, CAST(floor(y / {hi}) AS BIGINT) AS cy FROM points),
    pairs AS MATERIALIZED (SELECT * FROM (SELECT a.layer_id, a.ord AS ord1, b.ord AS ord2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.category AS category1, b.category AS category2,
      sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d
      FROM cells a JOIN (SELECT cells.*, cx + i AS ex, cy + j AS ey FROM cells, (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j)) b
        ON a.layer_id = b.layer_id AND a.cx = b.ex AND a.cy = b.ey AND a.ord < b.ord) WHERE d >= {lo} AND d {op} {hi})"""


def slab(p1: str, p2: str, c: str, w: float) -> tuple[str, str]:
    """t-range of p1 + t (p2 - p1) within w of the line at c, for axis-parallel streets."""
    lo, hi = f"(({c} - {w}) - {p1}) / ({p2} - {p1})", f"(({c} + {w}) - {p1}) / ({p2} - {p1})"
    inside = f"abs({p1} - {c}) <= {w}"
    t0 = f"CASE WHEN {p1} = {p2} THEN CASE WHEN {inside} THEN 0.0 ELSE 2.0 END ELSE greatest(0.0, least({lo}, {hi})) END"
    t1 = f"CASE WHEN {p1} = {p2} THEN CASE WHEN {inside} THEN 1.0 ELSE -1.0 END ELSE least(1.0, greatest({lo}, {hi})) END"
    return t0, t1


def interval_sql(w: float, name: str = "iv") -> str:
    """(pair, road) intervals inside streets widened to w."""
    v0, v1 = slab("x1", "x2", "200.0 * k", w)
    h0, h1 = slab("y1", "y2", "200.0 * k", w)
    return f"""{name} AS MATERIALIZED (SELECT * FROM (
      SELECT layer_id, ord1, ord2, k AS road_id, {h0} AS t0, {h1} AS t1 FROM pairs, range(11) r(k) UNION ALL
      SELECT layer_id, ord1, ord2, k + 100, {v0}, {v1} FROM pairs, range(11) r(k)) WHERE t0 <= t1)"""


def union_sql(iv: str = "iv", name: str = "shares") -> str:
    return f"""{name} AS (SELECT layer_id, ord1, ord2, sum(greatest(0.0, t1 - greatest(t0, coalesce(seen, 0.0)))) AS share FROM (
      SELECT *, max(t1) OVER (PARTITION BY layer_id, ord1, ord2 ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {iv})
      GROUP BY ALL)"""


def segd(px: str, py: str) -> str:
    """Distance of (px, py) from the link x1,y1 - x2,y2, and the clamped ratio."""
    t = f"least(1.0, greatest(0.0, (({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0)))"
    dx, dy = f"({px} - (x1 + {t} * (x2 - x1)))", f"({py} - (y1 + {t} * (y2 - y1)))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def ratio(px: str, py: str) -> str:
    return f"least(1.0, greatest(0.0, (({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0)))"


def held_sql(w: float, share: float) -> str:
    return f"""{interval_sql(w)}, held AS MATERIALIZED (SELECT p.*, s.share FROM pairs p JOIN
      (SELECT layer_id, ord1, ord2, max(t1 - t0) AS share FROM iv GROUP BY ALL) s USING (layer_id, ord1, ord2) WHERE share >= {share})"""


FREE = f"""free AS (SELECT * FROM held h WHERE NOT EXISTS (SELECT 1 FROM points o WHERE o.layer_id = h.layer_id AND o.ord <> h.ord1 AND o.ord <> h.ord2
    AND {segd('o.x', 'o.y')} < 1.0 AND {ratio('o.x', 'o.y')} > 0.01 AND {ratio('o.x', 'o.y')} < 0.99))"""


@query("flagship_road_links", sql("points", f"""{pair_sql(15.0, 50.0)}, {held_sql(9.0, 0.8)}, {FREE}
    SELECT layer_id, count(*) AS links, round(avg(d), 6) AS mean_distance, round(min(d), 6) AS min_distance, round(max(d), 6) AS max_distance
    FROM free GROUP BY layer_id"""))
def flagship_road_links(spark, sf):
    links = L.road_links(T.points(spark, sf), T.streets(spark, sf), 15.0, 50.0)
    return links.groupBy("layer_id").agg(F.count(F.lit(1)).alias("links"), R6(F.avg("d")).alias("mean_distance"),
                                         R6(F.min("d")).alias("min_distance"), R6(F.max("d")).alias("max_distance"))


@query("j20_single_road_share", sql("points", f"""{pair_sql(15.0, 50.0)}, {interval_sql(9.0)}
    SELECT layer_id, ord1, ord2, round(max(t1 - t0), 6) AS share FROM iv GROUP BY ALL"""))
def j20_single(spark, sf):
    iv = L.link_intervals(pairs_within(T.points(spark, sf), 15.0, 50.0), T.streets(spark, sf), {"b": 3.0})
    return L.best_share(iv, "b").where("share is not null").select("layer_id", "ord1", "ord2", R6("share").alias("share"))


@query("j20_union_road_share", sql("points", f"""{pair_sql(15.0, 50.0)}, {interval_sql(26.0)}, {union_sql()}
    SELECT layer_id, ord1, ord2, round(share, 6) AS share, share >= 0.6 AS contained FROM shares"""))
def j20_union(spark, sf):
    iv = L.link_intervals(pairs_within(T.points(spark, sf), 15.0, 50.0), T.streets(spark, sf), {"b": 20.0})
    return L.union_share(iv, "b").select("layer_id", "ord1", "ord2", R6("share").alias("share"), (F.col("share") >= 0.6).alias("contained"))


@query("j21_sampled_cover", sql("points", f"""{pair_sql(15.0, 50.0)}
    SELECT layer_id, ord1, ord2, count_if({grid_dist('(x1 + (x2 - x1) * k / 10.0)', '(y1 + (y2 - y1) * k / 10.0)')} <= 21.0 + 1e-9)::BIGINT AS hits
    FROM pairs, range(11) r(k) GROUP BY ALL HAVING hits >= 5"""))
def j21(spark, sf):
    iv = L.link_intervals(pairs_within(T.points(spark, sf), 15.0, 50.0), T.streets(spark, sf), {"b": L.SAMPLED})
    s = L.sampled_share(iv, "b").where("share >= 0.4")
    return s.select("layer_id", "ord1", "ord2", F.round(F.col("share") * 11).cast("long").alias("hits"))


@query("g28_network_links", sql("points", f"""{pair_sql(15.0, 300.0)}
    SELECT layer_id, ord1, ord2, round(d, 6) AS distance FROM (
      SELECT layer_id, ord1, ord2, d, count_if({grid_dist('(x1 + (x2 - x1) * k / 10.0)', '(y1 + (y2 - y1) * k / 10.0)')} <= 21.0 + 1e-9) AS hits
      FROM pairs, range(11) r(k) WHERE {grid_dist('x1', 'y1')} <= 56 AND {grid_dist('x2', 'y2')} <= 56 GROUP BY ALL) WHERE hits / 11.0 >= 0.4"""))
def g28(spark, sf):
    net = L.network_links(T.points(spark, sf), T.streets(spark, sf))
    return net.select("layer_id", "ord1", "ord2", R6("d").alias("distance"))


SKELT = f"""near AS (SELECT p.layer_id, ord1, ord2,
      count_if({segd('s.x', 's.y')} < 8.0 AND NOT (abs(s.x - x1) < 1 AND abs(s.y - y1) < 1) AND NOT (abs(s.x - x2) < 1 AND abs(s.y - y2) < 1))::BIGINT AS blockers
      FROM pairs p JOIN skeleton s ON p.layer_id = s.layer_id AND s.x BETWEEN least(x1, x2) - 10 AND greatest(x1, x2) + 10
        AND s.y BETWEEN least(y1, y2) - 10 AND greatest(y1, y2) + 10 GROUP BY ALL),
    samples AS (SELECT layer_id, ord1, ord2, k, x1 + (x2 - x1) * k / 10.0 AS sx, y1 + (y2 - y1) * k / 10.0 AS sy FROM pairs, range(11) r(k)),
    followed AS (SELECT layer_id, ord1, ord2, count_if(
      least((sx - 10 * round(sx / 10)) ** 2 + (sy - 200 * round(sy / 200)) ** 2, (sx - 200 * round(sx / 200)) ** 2 + (sy - 10 * round(sy / 10)) ** 2) <= 100.0 + 1e-7)::BIGINT AS hits
      FROM samples GROUP BY ALL)"""


@query("j22_j23_skeleton_tests", sql("points skeleton", f"""{pair_sql(15.0, 50.0)}, {SKELT}
    SELECT p.layer_id, p.ord1, p.ord2, coalesce(blockers, 0) AS blockers, hits, coalesce(blockers, 0) > 3 AS blocked, hits / 11.0 >= 0.7 AS follows
    FROM pairs p LEFT JOIN near USING (layer_id, ord1, ord2) LEFT JOIN followed USING (layer_id, ord1, ord2)"""))
def j22_j23(spark, sf):
    t = L.skeleton_tests(pairs_within(T.points(spark, sf), 15.0, 50.0), T.skeleton(spark, sf))
    return t.select("layer_id", "ord1", "ord2", "blockers", F.round(F.col("followed") * 11).cast("long").alias("hits"),
                    (F.col("blockers") > 3).alias("blocked"), (F.col("followed") >= 0.7).alias("follows"))


@query("j42_visibility_score", sql("points skeleton", f"""{pair_sql(15.0, 50.0)}, {SKELT}, {interval_sql(26.0)}, {union_sql()}
    SELECT p.layer_id, p.ord1, p.ord2, round(greatest(0.0, 1 - (d - 15.0) / 285.0) * 0.2 + CASE WHEN coalesce(share, 0) >= 0.6 THEN 1.0 ELSE 0.0 END * 0.3
      + CASE WHEN coalesce(blockers, 0) <= 3 THEN 1.0 ELSE 0.0 END * 0.3 + CASE WHEN hits / 11.0 >= 0.7 THEN 1.0 ELSE 0.0 END * 0.2, 6) AS score
    FROM pairs p LEFT JOIN near USING (layer_id, ord1, ord2) LEFT JOIN followed USING (layer_id, ord1, ord2) LEFT JOIN shares USING (layer_id, ord1, ord2)"""))
def j42(spark, sf):
    links = pairs_within(T.points(spark, sf), 15.0, 50.0)
    iv = L.link_intervals(links, T.streets(spark, sf), {"b": 20.0})
    t = L.skeleton_tests(L.with_share(links, L.union_share(iv, "b"), "union20"), T.skeleton(spark, sf))
    return t.select("layer_id", "ord1", "ord2", R6(L.visibility_score(t)).alias("score"))


VISUAL = f"""vis AS MATERIALIZED (SELECT p.*, coalesce(share, 0) AS share, coalesce(blockers, 0) AS blockers, hits
    FROM pairs p JOIN shares USING (layer_id, ord1, ord2) LEFT JOIN near USING (layer_id, ord1, ord2) JOIN followed USING (layer_id, ord1, ord2)
    WHERE share >= 0.6 AND coalesce(blockers, 0) <= 3 AND hits / 11.0 >= 0.7)"""


@query("j43_visual_links", sql("points skeleton", f"""{pair_sql(15.0, 100.0)}, {SKELT}, {interval_sql(26.0)}, {union_sql()}, {VISUAL}
    SELECT layer_id, ord1, ord2, round(d, 6) AS distance FROM vis"""))
def j43(spark, sf):
    v = L.visual_links(T.points(spark, sf), T.streets(spark, sf), T.skeleton(spark, sf), 15.0, 100.0)
    return v.select("layer_id", "ord1", "ord2", R6("d").alias("distance"))


@query("j25_no_point_between", sql("points", f"""{pair_sql(15.0, 50.0)}, held AS (SELECT * FROM pairs), {FREE}
    SELECT layer_id, ord1, ord2, round(d, 6) AS distance FROM free"""))
def j25(spark, sf):
    p = T.points(spark, sf)
    return L.without_points_between(pairs_within(p, 15.0, 50.0), p).select("layer_id", "ord1", "ord2", R6("d").alias("distance"))


@query("j26_point_near_path", sql("points", f"""{pair_sql(15.0, 50.0)}
    SELECT layer_id, ord1, ord2 FROM pairs p WHERE EXISTS (SELECT 1 FROM points o WHERE o.layer_id = p.layer_id
      AND NOT (abs(o.x - x1) < 1 AND abs(o.y - y1) < 1) AND NOT (abs(o.x - x2) < 1 AND abs(o.y - y2) < 1) AND {segd('o.x', 'o.y')} <= 8.0)"""))
def j26(spark, sf):
    p = T.points(spark, sf)
    return L.points_between(pairs_within(p, 15.0, 50.0), p, 8.0).select("layer_id", "ord1", "ord2")


SIGHT = f"""{interval_sql(6.0)}, {union_sql()}, sight AS MATERIALIZED (SELECT p.* FROM pairs p LEFT JOIN shares USING (layer_id, ord1, ord2)
    WHERE d < 0.1 OR share >= 1 - 1e-9)"""


@query("j27_line_of_sight", sql("points", f"""{pair_sql(0.0, 200.0)}, {SIGHT} SELECT layer_id, ord1, ord2, round(d, 6) AS distance FROM sight"""))
def j27(spark, sf):
    return L.sight_links(T.points(spark, sf), T.streets(spark, sf)).select("layer_id", "ord1", "ord2", R6("d").alias("distance"))


@query("j28_visible_neighbours", sql("points", f"""{pair_sql(0.0, 200.0)}, {SIGHT},
    ends AS (SELECT layer_id, ord1 AS ord FROM sight UNION ALL SELECT layer_id, ord2 FROM sight),
    n AS (SELECT layer_id, ord, count(*) AS c FROM ends GROUP BY ALL)
    SELECT p.layer_id, p.ord, coalesce(c, 0) AS visible, round(coalesce(c, 0) / (count(*) OVER (PARTITION BY p.layer_id) - 1), 6) AS visible_share
    FROM points p LEFT JOIN n USING (layer_id, ord)"""))
def j28(spark, sf):
    p = T.points(spark, sf)
    return L.visible_counts(p, L.sight_links(p, T.streets(spark, sf))).select("layer_id", "ord", "visible", R6("visible_share").alias("visible_share"))


@query("j29_few_visible", sql("points", f"""{pair_sql(0.0, 200.0)}, {SIGHT},
    ends AS (SELECT layer_id, ord1 AS ord FROM sight UNION ALL SELECT layer_id, ord2 FROM sight)
    SELECT layer_id, ord FROM points p WHERE (SELECT count(*) FROM ends e WHERE e.layer_id = p.layer_id AND e.ord = p.ord) < 2"""))
def j29(spark, sf):
    p = T.points(spark, sf)
    return L.visible_counts(p, L.sight_links(p, T.streets(spark, sf))).where("visible < 2").select("layer_id", "ord")


@query("j30_merged_links", sql("points skeleton", f"""{pair_sql(15.0, 100.0)}, {SKELT}, {interval_sql(26.0)}, {union_sql()}, {VISUAL},
    net AS (SELECT layer_id, ord1, ord2, count_if({grid_dist('(x1 + (x2 - x1) * k / 10.0)', '(y1 + (y2 - y1) * k / 10.0)')} <= 21.0 + 1e-9) AS n
      FROM pairs, range(11) r(k) WHERE {grid_dist('x1', 'y1')} <= 56 AND {grid_dist('x2', 'y2')} <= 56 GROUP BY ALL HAVING n / 11.0 >= 0.4)
    SELECT layer_id, ord1, ord2, n.n IS NOT NULL AS has_network, vis.d IS NOT NULL AS has_visual FROM net n FULL JOIN vis USING (layer_id, ord1, ord2)"""))
def j30(spark, sf):
    p, r, s = T.points(spark, sf), T.streets(spark, sf), T.skeleton(spark, sf)
    m = L.merge_links(L.network_links(p, r, 15.0, 100.0), L.visual_links(p, r, s, 15.0, 100.0))
    return m.select("layer_id", "ord1", "ord2", "has_network", "has_visual")


@query("j36_isolated_points", sql("points", f"""SELECT layer_id, ord FROM points p WHERE {grid_dist()} <= 6 AND NOT EXISTS (SELECT 1 FROM points o
    WHERE o.layer_id = p.layer_id AND o.ord <> p.ord AND sqrt((o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y)) <= 30)"""))
def j36(spark, sf):
    return L.isolated_points(T.points(spark, sf), T.streets(spark, sf), 30.0).select("layer_id", "ord")


@query("j40_natural_direction", sql("points", f"""{pair_sql(15.0, 50.0)} SELECT layer_id, ord1, ord2, abs(x1 - x2) < 5 OR abs(y1 - y2) < 5
    OR least(abs(x1 - x2), abs(y1 - y2)) / greatest(abs(x1 - x2), abs(y1 - y2)) > 0.3 AS is_natural FROM pairs"""))
def j40(spark, sf):
    return pairs_within(T.points(spark, sf), 15.0, 50.0).select("layer_id", "ord1", "ord2", natural_direction("x1", "y1", "x2", "y2").alias("is_natural"))
