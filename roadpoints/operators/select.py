"""Point selection: thinning, clusters, priority rules and their chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadpoints.functions.geom import dist, seg_dist
from roadpoints.operators import curves as K, stats as S
from roadpoints.operators.celljoin import KEYS, around, near_join, pairs_within
from roadpoints.operators.fixpoint import cluster, components, leaders, spaced, thin_pairs
from roadpoints.operators.links import PAIR, link_intervals, lines_near, rows_near_links, touched, union_share
from roadpoints.operators.cuts import cut, cut_counting, sieved, united

DUP_RANK = {"endpoint": 3, "intersection": 2, "curve": 1}
GROUP_RANK = {"intersection": 3, "endpoint": 2, "curve": 1}


def priority_spacing(points: DataFrame, gap: float = 5.0, rank: dict = DUP_RANK, keys: Sequence[str] = KEYS) -> DataFrame:
    """Greedy spacing in order of category rank, then list order."""
    return spaced(points, gap, keys, [-S.choose("category", rank, 0)])


def best_of_group(points: DataFrame, radius: float = 20.0, rank: dict = GROUP_RANK, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per leader group, the row of highest category rank; the leader wins ties, then the list order."""
    g = leaders(points, radius, keys)
    order = F.struct(S.choose("category", rank, 0).alias("r"), F.when(F.col("ord") == F.col("leader"), 1).otherwise(0).alias("h"), (-F.col("ord")).alias("o"))
    best = g.groupBy(*keys, "leader").agg(F.max(order).alias("b")).select(*keys, (-F.col("b.o")).alias("ord"))
    return sieved(points, best, [*keys, "ord"], "left_semi")


def best_of_cluster(points: DataFrame, score: str, eps: float = 20.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per density cluster, the row with the highest score (first of equals)."""
    g = cluster(points, eps, keys)
    best = g.groupBy(*keys, "cluster").agg(F.max(F.struct(F.col(score), (-F.col("ord")).alias("o"))).alias("b"))
    return sieved(points, best.select(*keys, (-F.col("b.o")).alias("ord")), [*keys, "ord"], "left_semi")


def cluster_centres(points: DataFrame, eps: float = 30.0, keys: Sequence[str] = KEYS, weight: Column | None = None, min_size: int = 1) -> DataFrame:
    """Centre of each density cluster, weighted if a weight is given."""
    w = F.lit(1.0) if weight is None else weight
    return (cluster(points, eps, keys, min_size).withColumn("_w", w).groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("members"), (F.sum(F.col("x") * F.col("_w")) / F.sum("_w")).alias("x"),
        (F.sum(F.col("y") * F.col("_w")) / F.sum("_w")).alias("y")))


def seed_centres(points: DataFrame, radius: float = 30.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Seeds in list order; each gives the mean of all points closer than ``radius``, also of those taken before."""
    seeds = cut(spaced(points, radius, keys).select(*keys, "ord", "x", "y"))
    w = F.col("r_w")
    return around(seeds, points, radius, {"cx": F.sum(F.col("r_x") * w) / F.sum(w), "cy": F.sum(F.col("r_y") * w) / F.sum(w),
                                          "members": F.sum(w)}, keys, strict=True)


def collinear_curve(points: DataFrame, roads: DataFrame | None, near: float = 5.0, shortest: float = 10.0, first: float = 20.0,
                    keys: Sequence[str] = KEYS) -> DataFrame:
    """Per layer at most one curve point: closer than ``near`` to the line of a pair of other points at least
    ``shortest`` apart (and touching a road, if roads are given); the shortest such pair decides.

    Pairs are looked at in rings of doubling length; a layer leaves at its first hit, so long pairs are only
    made for layers that have no short one.
    """
    k, lo, hi = list(keys), shortest, first
    todo, parts = cut(points.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("category") == "curve").alias("_c"),
                                             (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) * 1.5).alias("_reach"))
                      .where("_n >= 3 and _c > 0")), []
    left = todo.count()
    while left:
        live = sieved(points, todo.select(*k), k, "left_semi")
        links = pairs_within(live, lo, hi, keys=keys)
        if roads is not None:
            touch = touched(link_intervals(links, roads, {"b": 0.0}, keys), "b", keys)
            links = links.join(touch, [*k, *PAIR], "left_semi")
        curves = live.where("category = 'curve'")
        hit = rows_near_links(links, curves, near, keys).where(F.col("line_d") < near)
        # the row's own order is needed: ends are left out by order, not by place
        named = (hit.join(curves.select(*k, "x", "y", "ord"), [*k, "x", "y"]).where("ord <> ord1 and ord <> ord2")
                 .withColumn("d", dist("x1", "y1", "x2", "y2")))
        best = named.groupBy(*k).agg(F.min(F.struct("d", "ord1", "ord2", "ord")).alias("b")).select(*k, "b.d", "b.ord1", "b.ord2", "b.ord")
        best = cut(best)
        parts.append(best)
        todo, left = cut_counting(todo.join(best, k, "left_anti").where(F.col("_reach") > hi))
        lo, hi = hi, hi * 2
    return united(parts)


def border_ends(points: DataFrame, skel: DataFrame, edge: float = 20.0, radius: float = 50.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Endpoints near the skeleton's box with no intersection or curve closer than ``radius`` (to be removed)."""
    ends = points.where("category = 'endpoint'").join(K.bounds(skel, keys), list(keys)).where(K.box_gap() < edge).select(*points.columns)
    return near_join(ends, points.where("category <> 'endpoint'").select(*keys, "x", "y"), radius, keys, strict=True, how="left_anti")


def cross_category_conflicts(points: DataFrame, gap: float = 5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows that lose to a row of another category closer than ``gap``: a curve to any, an endpoint to an intersection.

    Only whether a stronger row is near matters, so this is one semi join on coarse categories, not a pair list.
    """
    strong = points.where("category <> 'curve'").select(*keys, "x", "y").distinct()
    cross = points.where("category = 'intersection'").select(*keys, "x", "y").distinct()
    a = near_join(points.where("category = 'curve'"), strong, gap, keys, strict=True, how="left_semi")
    b = near_join(points.where("category = 'endpoint'"), cross, gap, keys, strict=True, how="left_semi")
    return united([a, b])


def chain_next(df: DataFrame, keys: Sequence[str], value: str, cols: Sequence[str], tie: str = "ord", step: float = 500.0) -> DataFrame:
    """Add n_<col>: the next row of its group by ``value``, from windows over bins of the value.

    The last row of a bin takes the first row of the next non-empty bin, so no group has to fit in one task.
    """
    k = list(keys)
    b = df.withColumn("_b", F.floor(F.col(value) / step))
    w = Window.partitionBy(*k, "_b").orderBy(value, tie)
    here = F.struct(*cols)
    heads = b.groupBy(*k, "_b").agg(F.min_by(here, F.struct(value, tie)).alias("_h"))
    heads = heads.withColumn("_h", F.lead("_h").over(Window.partitionBy(*k).orderBy("_b")))
    out = b.withColumn("_n", F.lead(here).over(w)).join(heads, [*k, "_b"]).withColumn("_n", F.coalesce("_n", "_h"))
    return out.withColumns({f"n_{c}": F.col(f"_n.{c}") for c in cols}).drop("_b", "_n", "_h")


def line_edges(points: DataFrame, lines: DataFrame, near: float = 10.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Links between points that follow each other along a line they are close to: u, v, w."""
    hit = cut(lines_near(points.select(*keys, "ord", "x", "y"), lines, near, keys).select(*keys, "line", "measure", "ord", "x", "y"))
    nx = chain_next(hit, [*keys, "line"], "measure", ["ord", "x", "y"]).where("n_ord is not null")
    return nx.select(*keys, F.least("ord", "n_ord").alias("u"), F.greatest("ord", "n_ord").alias("v"), dist("x", "y", "n_x", "n_y").alias("w")).distinct()


def degrees(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    ends = edges.select(*keys, F.col("u").alias("ord"), "w").unionByName(edges.select(*keys, F.col("v").alias("ord"), "w"))
    return ends.groupBy(*keys, "ord").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("reach"))


def skeleton_degree_filter(points: DataFrame, lines: DataFrame, near: float = 10.0, shortest: float = 20.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep degree 1 or 3 and more; degree 2 only when both neighbours together are farther than ``shortest``."""
    d = degrees(line_edges(points, lines, near, keys), keys)
    keep = d.where((F.col("degree") == 1) | (F.col("degree") >= 3) | ((F.col("degree") == 2) & (F.col("reach") > shortest)))
    return sieved(points, keep.select(*keys, "ord"), [*keys, "ord"], "left_semi")


def road_components(points: DataFrame, roads: DataFrame, reach: float = 50.0, band: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus ``component``: linked when close and joined by a line wholly in the widened roads. No row is dropped."""
    links = pairs_within(points, 0.0, reach, keys=keys)
    iv = link_intervals(links, roads, {"b": band}, keys)
    full = union_share(iv, "b", keys).where(F.col("share") >= 1 - 1e-9)
    comp = components(points.select(*keys, F.col("ord").alias("node")), full.select(*keys, F.col("ord1").alias("u"), F.col("ord2").alias("v")), keys)
    return points.join(comp.withColumnRenamed("node", "ord"), [*keys, "ord"])


def by_role(points: DataFrame) -> DataFrame:
    """Role order: intersection, curve, endpoint, then list order (role_rank). The row set is unchanged."""
    return points.withColumn("role_rank", S.choose("category", S.ROLE_RANK, 0))


def hybrid_filter(points: DataFrame, skel: DataFrame, roads: DataFrame, lines: DataFrame, eps: float = 20.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Score, cluster, link components, role order, skeleton degree (15 m, 50 m), 8 m spacing in that order."""
    scored = cut(S.hybrid_importance(points, skel, roads, keys))
    one = cut(best_of_cluster(scored, "score", eps, keys))
    linked = cut(by_role(road_components(one, roads, keys=keys)))
    kept = cut(skeleton_degree_filter(linked, lines, 15.0, 50.0, keys))
    return spaced(kept, 8.0, keys, [-F.col("role_rank"), F.col("component")])


def line_closeness(points: DataFrame, lines: DataFrame, near: float = 10.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus ``line_score``: sum of 1 / (1 + d) over lines closer than ``near``."""
    s = lines_near(points.select(*keys, "ord", "x", "y"), lines, near, keys).groupBy(*keys, "ord").agg(F.sum(1 / (1 + F.col("d"))).alias("line_score"))
    return points.join(s, [*keys, "ord"], "left").fillna({"line_score": 0.0})


def road_closeness(points: DataFrame, roads: DataFrame, near: float = 50.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus ``road_score``: sum over roads closer than ``near`` of (width + vertices) / (1 + d).

    Width is area / outline length of the road's band; its outline has five vertices.
    """
    hw, ln = F.col("half_width"), dist("ax", "ay", "bx", "by")
    from roadpoints.operators.celljoin import with_cell
    from roadpoints.operators.links import _roads
    hit = (with_cell(points.select(*keys, "ord", "x", "y"), 50.0).join(_roads(roads, keys, near, 50.0), [*keys, "cx", "cy"])
           .withColumn("d", F.greatest(F.lit(0.0), seg_dist("x", "y", "ax", "ay", "bx", "by") - hw)).where(F.col("d") < near))
    width = 2 * hw * ln / (2 * ln + 4 * hw)
    s = hit.groupBy(*keys, "ord").agg(F.sum((width + 5) / (1 + F.col("d"))).alias("road_score"))
    return points.join(s, [*keys, "ord"], "left").fillna({"road_score": 0.0})


def role_score(points: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus ``role_score``: 1, 2, 3 for degree 1, 2, 3 or more; 0.5 when not in the graph."""
    d = degrees(edges, keys).select(*keys, "ord", "degree")
    s = F.when(F.col("degree").isNull(), 0.5).when(F.col("degree") >= 3, 3.0).otherwise(F.col("degree").cast("double"))
    return points.join(d, [*keys, "ord"], "left").withColumn("role_score", s).drop("degree")


def weighted_cluster_pick(points: DataFrame, lines: DataFrame, roads: DataFrame, edges: DataFrame, eps: float = 20.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per cluster, the row with the best 0.3 line + 0.3 road + 0.4 role score, each divided by the cluster's maximum."""
    k = list(keys)
    s = cut(cluster(role_score(road_closeness(line_closeness(points, lines, keys=keys), roads, keys=keys), edges, keys), eps, keys))
    top = s.groupBy(*k, "cluster").agg(*[F.max(c).alias("m_" + c) for c in ("line_score", "road_score", "role_score")])
    part = lambda c: F.coalesce(F.col(c) / F.nullif("m_" + c, F.lit(0.0)), F.lit(0.0))
    t = s.join(top, [*k, "cluster"]).withColumn("final", part("line_score") * 0.3 + part("road_score") * 0.3 + part("role_score") * 0.4)
    best = t.groupBy(*k, "cluster").agg(F.max(F.struct(F.round("final", 9).alias("f"), (-F.col("ord")).alias("o"))).alias("b"))
    return best.select(*k, "cluster", (-F.col("b.o")).alias("ord"), F.col("b.f").alias("final"))


def class_postprocess(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Classes 1, 2, 3 of ordered sites: seed centres at 30 m, middles of runs (gap 3, 5 or more), spacing above 40 m."""
    from roadpoints.operators.sequence import islands, representatives
    one = seed_centres(pred.where("class_id = 1"), 30.0, keys).select(*keys, "ord", F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit("intersection").alias("category"))
    two = representatives(islands(pred.where("class_id = 2"), 3, 5, keys, "ord")).select(*keys, "ord", "x", "y", F.lit("curve").alias("category"))
    three = spaced(pred.where("class_id = 3"), 40.0, keys, closed=True).select(*keys, "ord", "x", "y", F.lit("endpoint").alias("category"))
    return one.unionByName(two).unionByName(three)


def refine(points: DataFrame, skel: DataFrame, eps: float = 30.0, merge: float = 20.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Detections refined per category: cluster means; curvature above 0.01 and spacing; at most 3 skeleton points in 30 m."""
    one = cluster_centres(points.where("category = 'intersection'"), eps, keys).select(*keys, F.col("cluster").alias("ord"), "x", "y", F.lit("intersection").alias("category"))
    bent = K.circle_curvature(points.where("category = 'curve'"), skel, 30.0, keys).where("round(curvature, 9) > 0.01")
    two = spaced(cut(bent.select(*keys, "ord", "x", "y", "category")), merge, keys)
    few = around(points.where("category = 'endpoint'"), skel, 30.0, {"_n": F.sum("r_w")}, keys, strict=True, default={"_n": 0}).where("_n <= 3")
    return one.unionByName(two).unionByName(few.select(*keys, "ord", "x", "y", "category"))


def optimisation_stages(points: DataFrame, skel: DataFrame, roads: DataFrame, keys: Sequence[str] = KEYS, gaps: Sequence[float] = (12.0, 15.0, 18.0),
                        final: str = "conflicts") -> list[tuple[str, DataFrame]]:
    """The selection chain as (stage, rows left): clusters by importance, three pairwise thinnings, one collinear
    curve per layer, border ends, and the last clean-up by category conflicts or skeleton degree."""
    out = []

    def add(name, df):
        out.append((name, cut(df)))
        return out[-1][1]

    now = add("start", points)
    scored = S.skeleton_importance_score(now, skel, keys=keys).select(*points.columns, "importance")
    now = add("cluster", best_of_cluster(cut(scored), "importance", 20.0, keys).select(*points.columns))
    for gap in gaps:
        now = add(f"thin_{gap:g}", thin_pairs(now, gap, keys))
    one = collinear_curve(now, roads, keys=keys).select(*keys, "ord")
    now = add("collinear", now.join(one, [*keys, "ord"], "left_anti"))
    now = add("border_ends", now.join(border_ends(now, skel, keys=keys).select(*keys, "ord"), [*keys, "ord"], "left_anti"))
    if final == "conflicts":
        add("final", now.join(cross_category_conflicts(now, keys=keys).select(*keys, "ord"), [*keys, "ord"], "left_anti"))
    else:
        add("final", skeleton_degree_filter(now, roads, keys=keys))
    return out


def nearest_deletions(points: DataFrame, deletes: DataFrame, cap: float = 10.0, by_category: bool = True, keys: Sequence[str] = KEYS,
                      limit: int = 1000) -> DataFrame:
    """Rows left after each deletion site, in order, removed its nearest row closer than ``cap``.

    By category order (intersection, curve, endpoint): the first category with a row in reach gives the row. Two sites
    may want one row; the earlier gets it and the others choose again. A site may act when no earlier open site
    competes for its choice, so every round settles the first site of every contested row.
    """
    k = list(keys)
    rank = S.choose("category", S.CATEGORY_ORDER, 9) if by_category else F.lit(0)
    rows = points.select(*k, "ord", "x", "y", rank.alias("rank"))
    spots = deletes.select(*k, F.col("ord").alias("site"), "x", "y")
    cand = near_join(spots, rows, cap, keys, strict=True).select(*k, "site", F.col("r_ord").alias("ord"), F.col("r_rank").alias("rank"), "d")
    cand, left = cut_counting(cand)
    gone = []
    while left:
        if len(gone) == limit:
            raise RuntimeError(f"nearest_deletions: no fixpoint after {limit} rounds")
        want = cand.groupBy(*k, "site").agg(F.min(F.struct("rank", "d", "ord"))["ord"].alias("ord"))
        # a site is settled when it is the earliest open site among all that can reach its choice
        first = cand.groupBy(*k, "ord").agg(F.min("site").alias("first"))
        done = cut(want.join(first, [*k, "ord"]).where("site = first").select(*k, "site", "ord"))
        gone.append(done.select(*k, "ord"))
        cand, left = cut_counting(cand.join(done.select(*k, "site"), [*k, "site"], "left_anti").join(done.select(*k, "ord"), [*k, "ord"], "left_anti"))
    out = points
    for g in gone:
        out = out.join(g, [*k, "ord"], "left_anti")
    return out
