"""Aggregations over neighbourhoods, links, coverage, sessions and predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from roadpoints.operators.celljoin import KEYS, around, count_if, near_join, nearest, with_cell
from roadpoints.operators.links import EDGE, both_ways, road_gap

# Category base scores, nearest-distance bands, pair weights.
BASE_SCORE = {"intersection": 10.0, "endpoint": 7.0, "curve": 5.0}
CATEGORY_WEIGHT = {"intersection": 1.0, "curve": 0.7, "endpoint": 0.5}
PAIR_PRIORITY = {("intersection", "intersection"): 1.0, ("curve", "intersection"): 0.8, ("endpoint", "intersection"): 0.7,
                 ("curve", "curve"): 0.6, ("curve", "endpoint"): 0.5, ("endpoint", "endpoint"): 0.4}
ROLE_RANK = {"intersection": 3, "curve": 2, "endpoint": 1}
CATEGORY_ORDER = {"intersection": 1, "curve": 2, "endpoint": 3}


def choose(col: str | Column, values: dict, default) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def skeleton_importance_score(points: DataFrame, skel: DataFrame, banded: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus ``importance``: category base + 3, 2, 1 times the skeleton counts in 10, 30, 50 m.

    ``banded`` adds the band of the nearest skeleton distance and 5 for intersections.
    """
    n = {f"n{r}": count_if(F.col("d") <= r) for r in (10, 30, 50)}
    out = around(points, skel, 50.0, {**n, "skel_d": F.min("d")}, keys, default={f"n{r}": 0 for r in (10, 30, 50)})
    score = choose("category", BASE_SCORE, 0.0) + F.col("n10") * 3.0 + F.col("n30") * 2.0 + F.col("n50")
    if banded:
        d = F.col("skel_d")
        score = score + F.when(d < 5, 5.0).when(d < 10, 4.0).when(d < 15, 3.0).when(d < 20, 2.0).otherwise(1.0)
        score = score + F.when(F.col("category") == "intersection", 5.0).otherwise(0.0)
    return out.withColumn("importance", score)


def local_density(sites: DataFrame, data: DataFrame, radii: Sequence[int] = (25, 50, 100), keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus density<r>: rows per 10,000 square metres within each radius, from one join."""
    aggs = {f"density{r}": count_if(F.col("d") <= r) / (math.pi * r * r) * 10000 for r in radii}
    return around(sites, data, float(max(radii)), aggs, keys, default={k: 0.0 for k in aggs})


def disc_samples(radius: float, rings: int = 4, spokes: int = 8) -> list[tuple[float, float]]:
    """Offsets of equal-area samples of a disc."""
    out = []
    for i in range(rings):
        r = radius * math.sqrt((i + 0.5) / rings)
        for j in range(spokes):
            a = 2 * math.pi * (j + 0.5) / spokes
            out.append((round(r * math.cos(a), 6), round(r * math.sin(a), 6)))
    return out


def road_share_of_disc(sites: DataFrame, roads: DataFrame, radius: float = 20.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus ``road_share``: share of the disc's samples that lie on a road."""
    from roadpoints.functions.geom import seg_dist
    from roadpoints.operators.links import _roads
    offs = disc_samples(radius)
    spots = sites.select(*keys, "x", "y").distinct()
    hits = (with_cell(spots, EDGE).join(_roads(roads, keys, radius), [*keys, "cx", "cy"]))
    mask = F.lit(0).cast("long")
    for i, (ox, oy) in enumerate(offs):
        inside = seg_dist(F.col("x") + ox, F.col("y") + oy, "ax", "ay", "bx", "by") <= F.col("half_width")
        mask = mask.bitwiseOR(F.when(inside, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    share = hits.groupBy(*keys, "x", "y").agg((F.bit_count(F.bit_or(mask)) / float(len(offs))).alias("road_share"))
    return sites.join(share, [*keys, "x", "y"], "left").fillna({"road_share": 0.0})


def skeleton_importance(sites: DataFrame, skel: DataFrame, roads: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Skeleton sites plus connectivity, road_width, centrality and total importance.

    Neighbours are skeleton points within 30 m; the site itself, a skeleton point, is not counted.
    """
    near = around(sites, skel, 30.0, {"_n": F.sum("r_w") - 1, "_s": F.sum(F.col("d") * F.col("r_w"))}, keys)
    wide = road_share_of_disc(near, roads, 20.0, keys)
    n = F.coalesce("_n", F.lit(0))
    mean = F.col("_s") / F.nullif(n, F.lit(0))
    return (wide.withColumn("connectivity", F.least(n / 10.0, F.lit(1.0)))
            .withColumn("road_width", F.least(F.col("road_share") * 2.0, F.lit(1.0)))
            .withColumn("centrality", F.coalesce(F.greatest(F.lit(0.0), 1 - mean / 30.0), F.lit(0.0)))
            .withColumn("total", F.col("connectivity") * 0.4 + F.col("road_width") * 0.3 + F.col("centrality") * 0.3)
            .drop("_n", "_s", "road_share"))


def point_importance(points: DataFrame, skel: DataFrame, roads: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus ``importance``: 0.4 category + 0.4 nearest skeleton total + 0.2 closeness.

    The skeleton score is computed only for skeleton places that are nearest to some point.
    """
    hit = nearest(points, skel, keys=keys)
    used = hit.where("near_x is not null").select(*keys, F.col("near_x").alias("x"), F.col("near_y").alias("y")).distinct()
    total = skeleton_importance(used, skel, roads, keys).select(
        *keys, F.col("x").alias("near_x"), F.col("y").alias("near_y"), "total")
    d = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("near_d") / 50.0), F.lit(0.0))
    score = choose("category", CATEGORY_WEIGHT, 0.5) * 0.4 + F.coalesce("total", F.lit(0.5)) * 0.4 + d * 0.2
    return (hit.join(total, [*keys, "near_x", "near_y"], "left")
            .withColumn("importance", F.least(score, F.lit(1.0))).drop("near_ord", "near_x", "near_y", "near_d", "total"))


def pair_priority(c1: str, c2: str, parity: bool = False) -> Column:
    """Category-pair weight. ``parity`` gives 0.5 to the two pairs whose key is not in sorted order."""
    key = F.concat_ws("|", F.least(c1, c2), F.greatest(c1, c2))
    table = {"|".join(k): v for k, v in PAIR_PRIORITY.items()}
    if parity:
        table = {k: 0.5 if k in ("curve|intersection", "endpoint|intersection") else v for k, v in table.items()}
    return choose(key, table, 0.5)


def connection_priority(links: DataFrame, importance: DataFrame, parity: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """``links`` plus ``priority``: 0.3 mean importance + 0.5 distance band + 0.2 category pair."""
    i1 = importance.select(*keys, F.col("ord").alias("ord1"), F.col("importance").alias("_i1"))
    i2 = importance.select(*keys, F.col("ord").alias("ord2"), F.col("importance").alias("_i2"))
    d = F.col("d")
    band = (F.when(d.between(50, 150), 1.0).when((d >= 15) & (d < 50), 0.8).when((d > 150) & (d <= 300), 0.6).otherwise(0.2))
    score = (F.col("_i1") + F.col("_i2")) / 2.0 * 0.3 + band * 0.5 + pair_priority("category1", "category2", parity) * 0.2
    return (links.join(i1, [*keys, "ord1"]).join(i2, [*keys, "ord2"])
            .withColumn("priority", F.least(score, F.lit(1.0))).drop("_i1", "_i2"))


def hybrid_importance(points: DataFrame, skel: DataFrame, roads: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus ``score``: skeleton density in 100 m, road closeness, mean 5-100 m distance around 25."""
    ring = F.col("d").between(5, 100)
    out = around(points, skel, 100.0, {"_n": count_if(F.lit(True)), "_k": count_if(ring),
                                       "_s": F.sum(F.when(ring, F.col("d") * F.col("r_w")))}, keys)
    edge = F.lit(1.0)
    if roads is not None:
        # beyond 140 m the road term is at its floor, so the search may stop there
        out = road_gap(out, roads, 140.0, keys)
        edge = F.greatest(F.lit(0.3), 1 - F.coalesce("gap", F.lit(140.0)) / 200.0)
    mean = F.col("_s") / F.nullif("_k", F.lit(0))
    spread_ = F.coalesce(F.greatest(F.lit(0.1), 1 - F.abs(mean - 25) / 25), F.lit(1.0))
    score = (F.coalesce("_n", F.lit(0)) * 0.4 + edge * 0.3 + spread_ * 0.3) / 10
    return out.withColumn("score", F.least(F.lit(1.0), score)).drop("_n", "_k", "_s", "gap")


def category_neighbourhood(sites: DataFrame, marks: DataFrame, radius: float = 50.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus counts per category within ``radius``, the nearest mark (1000 when none), and density x 1000."""
    aggs = {f"n_{c}": count_if(F.col("r_category") == c) for c in CATEGORY_ORDER}
    out = around(sites, marks, radius, aggs, keys, also=["category"], default={k: 0 for k in aggs})
    all_ = F.col("n_intersection") + F.col("n_curve") + F.col("n_endpoint")
    out = nearest(out, marks, keys=keys).drop("near_ord", "near_x", "near_y")
    return (out.withColumn("near_mark", F.least(F.coalesce("near_d", F.lit(1000.0)), F.lit(1000.0))).drop("near_d")
            .withColumn("mark_density", all_ / (math.pi * radius * radius) * 1000))


def mark_class(sites: DataFrame, marks: DataFrame, radius: float = 5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus ``mark_class``: 1-3 for the first category with a mark closer than ``radius``, else 0."""
    rank = F.min(choose("r_category", CATEGORY_ORDER, 9))
    return around(sites, marks, radius, {"mark_class": rank}, keys, ["category"], strict=True, default={"mark_class": 0})


def link_statistics(links: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Count, range, mean, exact median and population deviation of link lengths, and the three length bands."""
    from roadpoints.operators.sequence import exact_quantile
    d = F.col("d")
    base = links.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.min(d).alias("min_d"), F.max(d).alias("max_d"), F.avg(d).alias("mean_d"),
        F.stddev_pop(d).alias("std_d"), F.count_if(d <= 50).alias("short"),
        F.count_if((d > 50) & (d <= 150)).alias("medium"), F.count_if(d > 150).alias("long"))
    return base.join(exact_quantile(links, "d", 0.5, by, "median_d"), list(by))


def connected_counts(points: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    n = both_ways(links, keys).groupBy(*keys, "ord").agg(F.count(F.lit(1)).alias("connected"))
    return points.join(n, [*keys, "ord"], "left").fillna({"connected": 0})


def network_statistics(points: DataFrame, links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Link totals per layer and density 2m / (n (n - 1))."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"))
    m = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("connections"), F.avg("d").alias("mean_d"),
                                 F.min("d").alias("min_d"), F.max("d").alias("max_d"))
    out = n.join(m, list(keys), "left").fillna({"connections": 0, "mean_d": 0.0, "min_d": 0.0, "max_d": 0.0})
    pairs = F.nullif(F.col("nodes").cast("double") * (F.col("nodes") - 1), F.lit(0.0))
    return out.withColumn("density", F.coalesce(2.0 * F.col("connections") / pairs, F.lit(0.0)))


def mean_spacing(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean distance to the nearest other point, per layer."""
    return nearest(points, points, keys=keys, skip_self=True).groupBy(*keys).agg(F.avg("near_d").alias("spacing"))


# coverage on a grid of cells: the size of a cell bounds the error

def coverage_cells(bounds: DataFrame, grid: float = 10.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Grid nodes strictly inside each layer's box (minx, miny, maxx, maxy): gi, gj, x, y."""
    n = lambda a, b: F.floor((F.col(b) - F.col(a)) / grid).cast("int")
    return (bounds.withColumn("gj", F.explode(F.sequence(F.lit(0), n("minx", "maxx"))))
            .withColumn("gi", F.explode(F.sequence(F.lit(0), n("miny", "maxy"))))
            .withColumns({"x": F.col("minx") + F.col("gj") * grid, "y": F.col("miny") + F.col("gi") * grid})
            .where("x > minx and x < maxx and y > miny and y < maxy").select(*keys, "gi", "gj", "x", "y"))


def covered(cells: DataFrame, points: DataFrame, radius: float, keys: Sequence[str] = KEYS, how: str = "left_semi") -> DataFrame:
    """Cells with (left_semi) or without (left_anti) a point within ``radius``."""
    return near_join(cells, points.select(*keys, "x", "y").distinct(), radius, keys, how=how)


def coverage(points: DataFrame, bounds: DataFrame, radius: float = 50.0, grid: float = 10.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Covered and uncovered area, ratio, area per point, overlap ratio and efficiency per layer."""
    k = list(keys)
    area = bounds.select(*k, ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("total_area"))
    hit = covered(coverage_cells(bounds, grid, keys), points, radius, keys).groupBy(*k).agg((F.count(F.lit(1)) * grid * grid).alias("covered_area"))
    n = points.groupBy(*k).agg(F.count(F.lit(1)).alias("num_points"))
    out = area.join(hit, k, "left").join(n, k, "left").fillna({"covered_area": 0.0, "num_points": 0})
    disc = math.pi * radius * radius
    each = F.nullif(F.col("num_points") * disc, F.lit(0.0))
    ratio = F.least(F.col("covered_area") / F.col("total_area"), F.lit(1.0))
    overlap = F.when(F.col("num_points") <= 1, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (each - F.col("covered_area")) / each)))
    out = out.withColumns({"coverage_ratio": ratio, "uncovered_area": F.col("total_area") - F.col("covered_area"),
                           "per_point": F.coalesce(F.col("covered_area") / F.nullif("num_points", F.lit(0)), F.lit(0.0)),
                           "overlap_ratio": overlap})
    expected = F.least(F.col("num_points") * disc / F.col("total_area"), F.lit(1.0))
    eff = F.col("coverage_ratio") / F.nullif(expected, F.lit(0.0)) * (1 - F.col("overlap_ratio") * 0.5)
    return out.withColumn("efficiency", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), eff)), F.lit(0.0)))


def coverage_gaps(points: DataFrame, bounds: DataFrame, radius: float = 50.0, grid: float = 10.0, min_area: float = 100.0,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Uncovered parts (4-neighbour cell groups) of at least ``min_area``: gap, cells, area and centre."""
    from roadpoints.operators.fixpoint import components
    k = list(keys)
    wide = 1 << 20
    free = covered(coverage_cells(bounds, grid, keys), points, radius, keys, "left_anti").withColumn(
        "node", F.col("gi").cast("long") * wide + F.col("gj"))
    from roadpoints.operators.cuts import cut
    free = cut(free)
    base = free.select(*k, "node")
    step = base.withColumn("v", F.explode(F.array(F.col("node") + 1, F.col("node") + wide)))
    edges = step.join(base.select(*k, F.col("node").alias("v")), [*k, "v"]).select(*k, F.col("node").alias("u"), "v")
    parts = free.join(components(base, edges, keys), [*k, "node"])
    return (parts.groupBy(*k, F.col("component").alias("gap")).agg(
        F.count(F.lit(1)).alias("cells"), F.avg("x").alias("x"), F.avg("y").alias("y"))
        .withColumn("area", F.col("cells") * grid * grid).where(F.col("area") >= min_area))


def best_next_site(points: DataFrame, candidates: DataFrame, bounds: DataFrame, radius: float = 50.0, grid: float = 10.0,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Per layer, the candidate that adds most coverage (first of equals): ord, gain_area."""
    free = covered(coverage_cells(bounds, grid, keys), points, radius, keys, "left_anti")
    hits = near_join(free, candidates.select(*keys, "x", "y", "ord"), radius, keys)
    gain = hits.groupBy(*keys, F.col("r_ord").alias("ord")).agg((F.count(F.lit(1)) * grid * grid).alias("gain_area"))
    return gain.groupBy(*keys).agg(F.max(F.struct("gain_area", (-F.col("ord")).alias("o"))).alias("b")).select(
        *keys, (-F.col("b.o")).alias("ord"), F.col("b.gain_area").alias("gain_area"))
