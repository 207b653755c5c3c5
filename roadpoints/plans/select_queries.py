"""Queries on point selection, checked against list-order SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from roadpoints.operators import fixpoint as X, select as D, stats as S
from roadpoints.operators.celljoin import pairs_within
from roadpoints.plans import tables as T
from roadpoints.plans.link_queries import interval_sql, pair_sql, segd, union_sql
from roadpoints.plans.neighbour_queries import COUNTS
from roadpoints.plans.registry import query
from roadpoints.plans.tables import sql
from roadpoints.operators.cuts import cut

R6 = lambda c: F.round(c, 6)
Q = lambda a, b: f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def greedy_sql(gap: float, order: str = "ord", src: str = "points", closed: bool = False, name: str = "kept") -> str:
    """List-order greedy spacing as a recursion that carries the list of kept rows per layer."""
    op = "<=" if closed else "<"
    return f"""q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY layer_id ORDER BY {order}) AS rn FROM {src}),
    g AS (SELECT layer_id, 0::BIGINT AS rn, []::STRUCT(x DOUBLE, y DOUBLE, ord BIGINT, rn BIGINT)[] AS l FROM (SELECT DISTINCT layer_id FROM q)
      UNION ALL SELECT g.layer_id, q.rn, CASE WHEN len(list_filter(g.l, lambda k: sqrt((k.x - q.x) * (k.x - q.x) + (k.y - q.y) * (k.y - q.y)) {op} {gap})) > 0 THEN g.l
        ELSE list_append(g.l, {{'x': q.x, 'y': q.y, 'ord': q.ord, 'rn': q.rn}}) END FROM g JOIN q ON q.layer_id = g.layer_id AND q.rn = g.rn + 1),
    {name} AS MATERIALIZED (SELECT layer_id, k.ord AS ord, k.x AS x, k.y AS y, k.rn AS rn FROM (SELECT layer_id, unnest(l) AS k FROM (SELECT layer_id, arg_max(l, rn) AS l FROM g GROUP BY layer_id)))"""


def thin_sql(radius: float, later: bool = False, src: str = "points") -> str:
    return f"""nb AS MATERIALIZED (SELECT a.layer_id, a.ord, list({{'d': {Q('a', 'b')}, 'o': b.ord}} ORDER BY {Q('a', 'b')}, b.ord) AS l FROM {src} a JOIN {src} b
      ON a.layer_id = b.layer_id AND a.ord {'<' if later else '<>'} b.ord AND {Q('a', 'b')} <= {radius} GROUP BY ALL),
    q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY layer_id ORDER BY ord) AS rn FROM nb),
    g AS (SELECT layer_id, 0::BIGINT AS rn, []::BIGINT[] AS used, []::BIGINT[] AS gone FROM (SELECT DISTINCT layer_id FROM q) UNION ALL
      SELECT layer_id, rn, CASE WHEN hit IS NULL THEN used ELSE list_concat(used, [ord, hit]) END, CASE WHEN hit IS NULL THEN gone ELSE list_append(gone, hit) END FROM (
        SELECT g.layer_id, q.rn, g.used, g.gone, q.ord, CASE WHEN list_contains(g.used, q.ord) THEN NULL ELSE list_filter(q.l, lambda e: NOT list_contains(g.used, e.o))[1].o END AS hit
        FROM g JOIN q ON q.layer_id = g.layer_id AND q.rn = g.rn + 1)),
    gone AS (SELECT layer_id, unnest(gone) AS ord FROM (SELECT layer_id, arg_max(gone, rn) AS gone FROM g GROUP BY layer_id))
    SELECT layer_id, ord FROM {src} ANTI JOIN gone USING (layer_id, ord)"""


def comp_sql(eps: float, src: str = "points", name: str = "comp") -> str:
    """Connected components of the d <= eps graph: (layer_id, ord, cluster)."""
    return f"""e AS MATERIALIZED (SELECT a.layer_id, a.ord AS u, b.ord AS v FROM {src} a JOIN {src} b ON a.layer_id = b.layer_id AND a.ord <> b.ord AND {Q('a', 'b')} <= {eps}),
    reach AS (SELECT layer_id, u, v FROM e UNION SELECT r.layer_id, r.u, e.v FROM reach r JOIN e ON e.layer_id = r.layer_id AND e.u = r.v),
    {name} AS MATERIALIZED (SELECT p.layer_id, p.ord, least(p.ord, coalesce(min(r.v), p.ord)) AS cluster FROM {src} p LEFT JOIN reach r ON r.layer_id = p.layer_id AND r.u = p.ord GROUP BY p.layer_id, p.ord)"""


@query("d01_greedy_spacing", sql("points", f"{greedy_sql(30.0)} SELECT layer_id, ord FROM kept"))
def d01(spark, sf):
    return X.spaced(T.points(spark, sf), 30.0).select("layer_id", "ord")


@query("d01_greedy_spacing_closed", sql("points", f"ends AS (SELECT * FROM points WHERE category = 'endpoint'), {greedy_sql(40.0, src='ends', closed=True)} SELECT layer_id, ord FROM kept"))
def d01_closed(spark, sf):
    return X.spaced(T.points(spark, sf).where("category = 'endpoint'"), 40.0, closed=True).select("layer_id", "ord")


RANK = lambda a, b, c: f"CASE category WHEN 'endpoint' THEN {a} WHEN 'intersection' THEN {b} ELSE {c} END"


@query("d02_priority_spacing", sql("points", f"{greedy_sql(5.0, RANK(1, 2, 3) + ', ord')} SELECT layer_id, ord FROM kept"))
def d02(spark, sf):
    return D.priority_spacing(T.points(spark, sf)).select("layer_id", "ord")


LEAD = f"""own AS (SELECT p.layer_id, p.ord, p.category, arg_min(k.ord, k.rn) AS leader FROM points p JOIN kept k ON k.layer_id = p.layer_id AND {Q('p', 'k')} <= 20 GROUP BY ALL)"""


@query("d03_best_of_group", sql("points", f"""{greedy_sql(20.0, closed=True)}, {LEAD} SELECT layer_id, ord FROM own
    QUALIFY row_number() OVER (PARTITION BY layer_id, leader ORDER BY CASE category WHEN 'intersection' THEN 1 WHEN 'endpoint' THEN 2 ELSE 3 END, ord <> leader, ord) = 1"""))
def d03(spark, sf):
    return D.best_of_group(T.points(spark, sf)).select("layer_id", "ord")


IMP = """imp AS (SELECT layer_id, ord, CASE category WHEN 'intersection' THEN 15.0 WHEN 'endpoint' THEN 7.0 ELSE 5.0 END + n10 * 3.0 + n30 * 2.0 + n50
    + CASE WHEN dmin < 5 THEN 5 WHEN dmin < 10 THEN 4 WHEN dmin < 15 THEN 3 WHEN dmin < 20 THEN 2 ELSE 1 END AS importance FROM cnt)"""


@query("d04_best_of_cluster", sql("points skeleton", f"""{COUNTS}, {IMP}, {comp_sql(20.0)} SELECT layer_id, ord, importance FROM comp JOIN imp USING (layer_id, ord)
    QUALIFY row_number() OVER (PARTITION BY layer_id, cluster ORDER BY importance DESC, ord) = 1"""))
def d04(spark, sf):
    s = S.skeleton_importance_score(T.points(spark, sf), T.skeleton(spark, sf))
    return D.best_of_cluster(cut(s), "importance").select("layer_id", "ord", "importance")


@query("d05_leader_clusters", sql("points skeleton", f"""{COUNTS}, {IMP}, src AS (SELECT p.*, importance FROM points p JOIN imp USING (layer_id, ord)),
    {greedy_sql(20.0, 'importance DESC, ord', 'src', closed=True)}, {LEAD} SELECT layer_id, leader, count(*) AS members FROM own GROUP BY ALL"""))
def d05(spark, sf):
    s = cut(S.skeleton_importance_score(T.points(spark, sf), T.skeleton(spark, sf)))
    return X.leaders(s, 20.0, order=[-F.col("importance")]).groupBy("layer_id", "leader").agg(F.count(F.lit(1)).alias("members"))


@query("d06_pairwise_thinning", sql("points", thin_sql(15.0)))
def d06(spark, sf):
    return X.thin_pairs(T.points(spark, sf), 15.0).select("layer_id", "ord")


@query("d06_pairwise_thinning_later", sql("points", thin_sql(15.0, later=True)))
def d06_later(spark, sf):
    return X.thin_pairs(T.points(spark, sf), 15.0, later_only=True).select("layer_id", "ord")


@query("d07_collinear_curve", sql("points", f"""{pair_sql(10.0, 80.0)}, {interval_sql(6.0)}, held AS (SELECT p.* FROM pairs p SEMI JOIN iv USING (layer_id, ord1, ord2)),
    h AS (SELECT h.layer_id, ord1, ord2, o.ord, d FROM held h JOIN points o ON o.layer_id = h.layer_id AND o.category = 'curve' AND o.ord <> ord1 AND o.ord <> ord2 AND {segd('o.x', 'o.y')} < 5)
    SELECT layer_id, ord, ord1, ord2, round(d, 6) AS distance FROM h QUALIFY row_number() OVER (PARTITION BY layer_id ORDER BY d, ord1, ord2, ord) = 1"""))
def d07(spark, sf):
    return D.collinear_curve(T.points(spark, sf), T.streets(spark, sf)).select("layer_id", "ord", "ord1", "ord2", R6("d").alias("distance"))


@query("d08_border_ends", sql("points skeleton", f"""b AS (SELECT layer_id, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM skeleton GROUP BY ALL)
    SELECT layer_id, ord FROM points p JOIN b USING (layer_id) WHERE category = 'endpoint' AND least(x - minx, maxx - x, y - miny, maxy - y) < 20
      AND NOT EXISTS (SELECT 1 FROM points o WHERE o.layer_id = p.layer_id AND o.category <> 'endpoint' AND {Q('p', 'o')} < 50)"""))
def d08(spark, sf):
    return D.border_ends(T.points(spark, sf), T.skeleton(spark, sf)).select("layer_id", "ord")


@query("d09_border_ends_by_skeleton", sql("points skeleton", f"""b AS (SELECT layer_id, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM skeleton GROUP BY ALL)
    SELECT layer_id, ord FROM points p JOIN b USING (layer_id) WHERE category = 'endpoint' AND least(x - minx, maxx - x, y - miny, maxy - y) < 30
      AND (SELECT count(*) FROM skeleton s WHERE s.layer_id = p.layer_id AND (s.x <> p.x OR s.y <> p.y) AND {Q('s', 'p')} < 50) <= 2"""))
def d09(spark, sf):
    from roadpoints.operators.curves import road_ends
    return road_ends(T.points(spark, sf).where("category = 'endpoint'"), T.skeleton(spark, sf)).select("layer_id", "ord")


@query("d10_category_conflicts", sql("points", f"""SELECT layer_id, ord FROM points p WHERE EXISTS (SELECT 1 FROM points o WHERE o.layer_id = p.layer_id AND {Q('p', 'o')} < 5 AND o.ord <> p.ord
    AND ((p.category = 'curve' AND o.category <> 'curve') OR (p.category = 'endpoint' AND o.category = 'intersection')))"""))
def d10(spark, sf):
    return D.cross_category_conflicts(T.points(spark, sf)).select("layer_id", "ord")


def line_edge_sql(near: float, src: str = "points") -> str:
    return f"""ln AS (SELECT layer_id, ord, x, y, k AS line, x AS m FROM {src}, range(11) r(k) WHERE abs(y - 200 * k) < {near}
      UNION ALL SELECT layer_id, ord, x, y, 100 + k, y FROM {src}, range(11) r(k) WHERE abs(x - 200 * k) < {near}),
    nx AS (SELECT *, lead(ord) OVER w AS no, lead(x) OVER w AS nxx, lead(y) OVER w AS nyy FROM ln WINDOW w AS (PARTITION BY layer_id, line ORDER BY m, ord)),
    le AS MATERIALIZED (SELECT DISTINCT layer_id, least(ord, no) AS u, greatest(ord, no) AS v, sqrt((x - nxx) * (x - nxx) + (y - nyy) * (y - nyy)) AS w FROM nx WHERE no IS NOT NULL),
    deg AS MATERIALIZED (SELECT layer_id, ord, count(*) AS degree, sum(w) AS reach FROM (SELECT layer_id, u AS ord, w FROM le UNION ALL SELECT layer_id, v, w FROM le) GROUP BY ALL)"""


@query("d11_skeleton_degree_filter", sql("points", f"{line_edge_sql(10.0)} SELECT layer_id, ord, degree FROM deg WHERE degree = 1 OR degree >= 3 OR (degree = 2 AND reach > 20)"))
def d11(spark, sf):
    p, s = T.points(spark, sf), T.streets(spark, sf)
    kept = D.skeleton_degree_filter(p, s)
    return kept.join(D.degrees(D.line_edges(p, s)), ["layer_id", "ord"]).select("layer_id", "ord", "degree")


@query("d25_category_preserving_dedupe", sql("points", f"{line_edge_sql(15.0)} SELECT layer_id, category, count(*) AS n FROM deg JOIN points USING (layer_id, ord) WHERE degree = 1 OR degree >= 3 OR (degree = 2 AND reach > 50) GROUP BY ALL"))
def d25(spark, sf):
    kept = D.skeleton_degree_filter(T.points(spark, sf), T.streets(spark, sf), 15.0, 50.0)
    return kept.groupBy("layer_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query("d13_road_components", sql("points", f"""{pair_sql(0.0, 50.0)}, {interval_sql(8.0)}, {union_sql()}, e AS MATERIALIZED (SELECT layer_id, ord1 AS u, ord2 AS v FROM shares WHERE share >= 1 - 1e-9
      UNION ALL SELECT layer_id, ord2, ord1 FROM shares WHERE share >= 1 - 1e-9),
    reach AS (SELECT layer_id, u, v FROM e UNION SELECT r.layer_id, r.u, e.v FROM reach r JOIN e ON e.layer_id = r.layer_id AND e.u = r.v)
    SELECT p.layer_id, p.ord, least(p.ord, coalesce(min(r.v), p.ord)) AS component FROM points p LEFT JOIN reach r ON r.layer_id = p.layer_id AND r.u = p.ord GROUP BY p.layer_id, p.ord"""))
def d13(spark, sf):
    return D.road_components(T.points(spark, sf), T.streets(spark, sf)).select("layer_id", "ord", "component")


@query("d12_hybrid_filter")
def d12(spark, sf):
    s = T.streets(spark, sf)
    return D.hybrid_filter(T.points(spark, sf), T.skeleton(spark, sf), s, s).select("layer_id", "ord", "category")


SCORES = f"""sc AS MATERIALIZED (SELECT p.layer_id, p.ord, coalesce((SELECT sum(1 / (1 + d)) FROM (SELECT abs(p.y - 200 * k) AS d FROM range(11) r(k) UNION ALL SELECT abs(p.x - 200 * k) FROM range(11) r(k)) WHERE d < 10), 0) AS line_score,
    coalesce((SELECT sum((12 * 2001 / (4002 + 24.0) + 5) / (1 + d)) FROM (SELECT greatest(0, abs(p.y - 200 * k) - 6) AS d FROM range(11) r(k) UNION ALL SELECT greatest(0, abs(p.x - 200 * k) - 6) FROM range(11) r(k)) WHERE d < 50), 0) AS road_score,
    CASE WHEN degree IS NULL THEN 0.5 ELSE least(degree, 3) END AS role_score FROM points p LEFT JOIN deg USING (layer_id, ord))"""


@query("d15_d16_d17_cluster_scores", sql("points", f"{line_edge_sql(10.0)}, {SCORES} SELECT layer_id, ord, round(line_score, 6) AS line_score, round(road_score, 6) AS road_score, round(role_score, 6) AS role_score FROM sc"))
def d15(spark, sf):
    p, s = T.points(spark, sf), T.streets(spark, sf)
    r = D.role_score(D.road_closeness(D.line_closeness(p, s), s), D.line_edges(p, s))
    return r.select("layer_id", "ord", *[R6(c).alias(c) for c in ("line_score", "road_score", "role_score")])


@query("d14_weighted_cluster_pick", sql("points", f"""{line_edge_sql(10.0)}, {SCORES}, {comp_sql(20.0)}, f AS (SELECT layer_id, cluster, ord,
      round(coalesce(line_score / nullif(max(line_score) OVER w, 0), 0) * 0.3 + coalesce(road_score / nullif(max(road_score) OVER w, 0), 0) * 0.3 + role_score / max(role_score) OVER w * 0.4, 9) AS f
      FROM sc JOIN comp USING (layer_id, ord) WINDOW w AS (PARTITION BY layer_id, cluster))
    SELECT layer_id, cluster, ord, round(f, 6) AS final FROM f QUALIFY row_number() OVER (PARTITION BY layer_id, cluster ORDER BY f DESC, ord) = 1"""))
def d14(spark, sf):
    p, s = T.points(spark, sf), T.streets(spark, sf)
    return D.weighted_cluster_pick(p, s, s, D.line_edges(p, s)).select("layer_id", "cluster", "ord", R6("final").alias("final"))


@query("d18_seed_centres", sql("points", f"""src AS (SELECT * FROM points WHERE category = 'intersection'), {greedy_sql(30.0, src='src')}
    SELECT k.layer_id, k.ord, count(*) AS members, round(avg(p.x), 6) AS x, round(avg(p.y), 6) AS y FROM kept k JOIN src p ON p.layer_id = k.layer_id AND {Q('p', 'k')} < 30 GROUP BY ALL"""))
def d18(spark, sf):
    c = D.seed_centres(T.points(spark, sf).where("category = 'intersection'"))
    return c.select("layer_id", "ord", "members", R6("cx").alias("x"), R6("cy").alias("y"))


@query("d19_refined_detections")
def d19(spark, sf):
    r = D.refine(T.points(spark, sf), T.skeleton(spark, sf))
    return r.groupBy("layer_id", "category").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("x")).alias("mean_x"))


@query("d20_class_postprocess")
def d20(spark, sf):
    pred = T.points(spark, sf).withColumn("class_id", S.choose("category", S.CATEGORY_ORDER, 0))
    return D.class_postprocess(pred).groupBy("layer_id", "category").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("x")).alias("mean_x"))


@query("d24_optimisation_stages")
def d24(spark, sf):
    st = D.optimisation_stages(T.points(spark, sf), T.skeleton(spark, sf), T.streets(spark, sf))
    parts = [df.groupBy("layer_id").agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), "layer_id", "rows_left") for i, (n, df) in enumerate(st)]
    return reduce(DataFrame.unionByName, parts)


@query("g02_g03_components", sql("points", f"{comp_sql(20.0)} SELECT layer_id, cluster, count(*) AS members FROM comp GROUP BY ALL"))
def g03(spark, sf):
    return X.cluster(T.points(spark, sf), 20.0).groupBy("layer_id", "cluster").agg(F.count(F.lit(1)).alias("members"))


@query("g02_components", sql("points", f"{comp_sql(20.0)} SELECT layer_id, ord, cluster AS component FROM comp"))
def g02(spark, sf):
    p = T.points(spark, sf)
    e = pairs_within(p, 0.0, 20.0).select("layer_id", F.col("ord1").alias("u"), F.col("ord2").alias("v"))
    return X.components(p.select("layer_id", F.col("ord").alias("node")), e).select("layer_id", F.col("node").alias("ord"), "component")


@query("g04_clusters_without_noise", sql("points", f"{comp_sql(20.0)} SELECT layer_id, cluster, count(*) AS members FROM comp GROUP BY ALL HAVING count(*) >= 2"))
def g04(spark, sf):
    return X.cluster(T.points(spark, sf), 20.0, min_size=2).groupBy("layer_id", "cluster").agg(F.count(F.lit(1)).alias("members"))


@query("e18_pair_summary", sql("points", f"""{pair_sql(0.0, 20.0)}, {comp_sql(20.0)}, c AS (SELECT layer_id, count(DISTINCT cluster) AS components FROM comp GROUP BY ALL)
    SELECT layer_id, components, count(*) AS pairs, round(sum(d), 5) AS total_d, round(min(d), 6) AS min_d, round(max(d), 6) AS max_d, round(avg(d), 6) AS mean_d FROM pairs JOIN c USING (layer_id) GROUP BY layer_id, components"""))
def e18(spark, sf):
    p = T.points(spark, sf)
    links = cut(pairs_within(p, 0.0, 20.0))
    comp = X.components(p.select("layer_id", F.col("ord").alias("node")), links.select("layer_id", F.col("ord1").alias("u"), F.col("ord2").alias("v")))
    # a component is named by one of its nodes, so counting those nodes counts components without a distinct
    n = comp.where("node = component").groupBy("layer_id").agg(F.count(F.lit(1)).alias("components"))
    s = links.groupBy("layer_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("d"), 5).alias("total_d"), R6(F.min("d")).alias("min_d"), R6(F.max("d")).alias("max_d"), R6(F.avg("d")).alias("mean_d"))
    return s.join(n, "layer_id")


@query("e39_cluster_centres", sql("points", f"{comp_sql(20.0)} SELECT layer_id, cluster, count(*) AS members, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM comp JOIN points USING (layer_id, ord) GROUP BY ALL"))
def e39(spark, sf):
    return D.cluster_centres(T.points(spark, sf), 20.0).select("layer_id", "cluster", "members", R6("x").alias("x"), R6("y").alias("y"))


@query("e40_weighted_centres", sql("points", f"""{comp_sql(20.0)}, w AS (SELECT *, CASE category WHEN 'intersection' THEN 3.0 WHEN 'curve' THEN 2.0 ELSE 1.0 END AS w FROM points)
    SELECT layer_id, cluster, count(*) AS members, round(sum(x * w) / sum(w), 6) AS x, round(sum(y * w) / sum(w), 6) AS y FROM comp JOIN w USING (layer_id, ord) GROUP BY ALL HAVING count(*) >= 2"""))
def e40(spark, sf):
    c = D.cluster_centres(T.points(spark, sf), 20.0, weight=S.choose("category", S.ROLE_RANK, 1).cast("double"), min_size=2)
    return c.select("layer_id", "cluster", "members", R6("x").alias("x"), R6("y").alias("y"))


def deletion_sql(cap: float, by_category: bool) -> str:
    rank = "CASE p.category WHEN 'intersection' THEN 1 WHEN 'curve' THEN 2 ELSE 3 END" if by_category else "0"
    return f"""nb AS MATERIALIZED (SELECT r.layer_id, r.ord, list({{'k': {rank}, 'd': {Q('r', 'p')}, 'o': p.ord}} ORDER BY {rank}, {Q('r', 'p')}, p.ord) AS l FROM reference_points r JOIN points p
      ON p.layer_id = r.layer_id AND {Q('r', 'p')} < {cap} GROUP BY ALL),
    q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY layer_id ORDER BY ord) AS rn FROM nb),
    g AS (SELECT layer_id, 0::BIGINT AS rn, []::BIGINT[] AS gone FROM (SELECT DISTINCT layer_id FROM q) UNION ALL
      SELECT layer_id, rn, CASE WHEN hit IS NULL THEN gone ELSE list_append(gone, hit) END FROM (
        SELECT g.layer_id, q.rn, g.gone, list_filter(q.l, lambda e: NOT list_contains(g.gone, e.o))[1].o AS hit FROM g JOIN q ON q.layer_id = g.layer_id AND q.rn = g.rn + 1)),
    gone AS (SELECT layer_id, unnest(gone) AS ord FROM (SELECT layer_id, arg_max(gone, rn) AS gone FROM g GROUP BY layer_id))
    SELECT layer_id, ord FROM points ANTI JOIN gone USING (layer_id, ord)"""


@query("j08_apply_deletions", sql("points reference_points", deletion_sql(10.0, True)))
def j08(spark, sf):
    return D.nearest_deletions(T.points(spark, sf), T.reference_points(spark, sf)).select("layer_id", "ord")


@query("j09_accept_deletions", sql("points reference_points", deletion_sql(30.0, False)))
def j09(spark, sf):
    return D.nearest_deletions(T.points(spark, sf), T.reference_points(spark, sf), 30.0, by_category=False).select("layer_id", "ord")


@query("l02_role_order", sql("points", "SELECT layer_id, ord, CASE category WHEN 'intersection' THEN 3 WHEN 'curve' THEN 2 ELSE 1 END AS role_rank FROM points"))
def l02(spark, sf):
    return D.by_role(T.points(spark, sf)).select("layer_id", "ord", "role_rank").orderBy(F.desc("role_rank"), "ord")


@query("l01_shortest_links", sql("points", f"{pair_sql(15.0, 100.0)} SELECT layer_id, ord1, ord2, round(d, 6) AS distance, row_number() OVER (PARTITION BY layer_id ORDER BY d, ord1, ord2) AS rank FROM pairs QUALIFY rank <= 20"))
def l01(spark, sf):
    from roadpoints.operators.sequence import top_n
    return top_n(pairs_within(T.points(spark, sf), 15.0, 100.0), 20, [F.col("d"), F.col("ord1"), F.col("ord2")]).select("layer_id", "ord1", "ord2", R6("d").alias("distance"), "rank")
