"""Composite jobs over many layers at once."""

from __future__ import annotations

from functools import reduce

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from roadpoints.operators import curves as K, links as L, raster as R, select as D, stats as S
from roadpoints.operators.celljoin import KEYS, near_join
from roadpoints.operators.sequence import top_n
from roadpoints.operators.cuts import cut


def optimal_connections(points: DataFrame, skel: DataFrame, roads: DataFrame, lo: float = 15.0, hi: float = 300.0, top: int = 20,
                        least: float = 0.3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Network and visual links merged, ranked by priority, the best per layer."""
    both = cut(L.merge_links(L.network_links(points, roads, lo, hi, keys=keys), L.visual_links(points, roads, skel, lo, hi, keys=keys), keys))
    imp = cut(S.point_importance(points, skel, roads, keys).select(*keys, "ord", "importance"))
    ranked = S.connection_priority(both, imp, keys=keys).where(F.col("priority") >= least)
    return top_n(ranked, top, [F.round("priority", 9).desc(), F.col("ord1"), F.col("ord2")], keys)


def detect(roads: DataFrame, px: float = 4.0, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(skeleton points, detected points with category) of road bands: raster, thinning, junctions, ends, curves off junctions."""
    skel = R.thin(R.rasterise_bands(roads, px, keys), keys)
    pts = cut(R.pixel_points(skel, px).select(*keys, "ord", "x", "y"))
    cross = cut(R.junction_centres(skel, px, keys=keys).select(*keys, F.col("cluster").alias("ord"), "x", "y"))
    ends = K.road_ends(pts, pts, keys=keys).select(*keys, "ord", "x", "y")
    lines = cut(R.skeleton_lines(skel, px, keys).select(*keys, F.col("seg").alias("road_id"), F.col("step").cast("long").alias("ord"), "x", "y"))
    bent = K.edge_curves(lines, keys=keys).select(*keys, F.col("cluster").alias("ord"), "x", "y")
    bent = near_join(bent, cross.select(*keys, "x", "y"), 10.0, keys, how="left_anti")
    tag = lambda df, c: df.withColumn("category", F.lit(c))
    return pts, cut(tag(cross, "intersection").unionByName(tag(bent, "curve")).unionByName(tag(ends, "endpoint")))


def detection_report(roads: DataFrame, px: float = 4.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Detected points per layer and category."""
    _, found = detect(roads, px, keys)
    return found.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))


def district_run(roads: DataFrame, outlines: DataFrame, px: float = 4.0, ladder: Sequence[float] = (10.0, 100.0, 200.0, 500.0),
                 keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Roads clipped by their district's outline (edges), then detected. Key by file and polygon to run all polygons at once."""
    from roadpoints.operators.clip import clip_with_ladder
    half = roads.select(*keys, "road_id", "half_width")
    cut_roads = clip_with_ladder(roads, outlines, ladder, keys).join(half, [*keys, "road_id"]).select(
        *keys, "road_id", F.col("cx1").alias("x1"), F.col("cy1").alias("y1"), F.col("cx2").alias("x2"), F.col("cy2").alias("y2"), "half_width")
    return detect(cut(cut_roads), px, keys)


def road_run(roads: DataFrame, deletes: DataFrame | None = None, px: float = 4.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Detected points, less the nearest point of each scored deletion, thinned by the skeleton degree filter."""
    _, found = detect(roads, px, keys)
    rank = S.choose("category", S.CATEGORY_ORDER, 9)
    found = cut(found.withColumn("ord", F.xxhash64(rank, "ord")))
    if deletes is not None:
        found = cut(D.nearest_deletions(found, deletes, keys=keys))
    return D.skeleton_degree_filter(found, roads, 15.0, 50.0, keys)


def batch_report(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals per layer and category with the batch mean of the layer totals."""
    per = points.groupBy(*keys).agg(*[F.count_if(F.col("category") == c).alias(c) for c in S.CATEGORY_ORDER], F.count(F.lit(1)).alias("total"))
    return per.crossJoin(F.broadcast(per.agg(F.avg("total").alias("batch_mean"))))  # one row


def evaluate(found: DataFrame, expected: DataFrame, skel: DataFrame, roads: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Detected points through the selection chain, counted per layer and compared with the expected table."""
    from roadpoints.operators.clip import compare_counts
    last = D.optimisation_stages(found, skel, roads, keys)[-1][1]
    return compare_counts(last.groupBy(*keys).agg(F.count(F.lit(1)).alias("predicted")), expected)


def flagged(found: DataFrame, scored: DataFrame, threshold: float = 0.7, delete: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """Detected points plus the sites a scorer is sure to delete, as a fourth category."""
    sure = scored.where((F.col("action") == delete) & (F.col("confidence") >= threshold))
    return found.select(*keys, "ord", "x", "y", "category").unionByName(sure.select(*keys, "ord", "x", "y", F.lit("delete").alias("category")))


def curves_of_all(skel: DataFrame, junctions: DataFrame, detectors: Sequence[str] = ("stencil", "edge"), keys: Sequence[str] = KEYS) -> DataFrame:
    """Curves by each of the detectors that the caller names, on all layers: the five-point stencil on a 20 m resampled line, and the edge
    rule (threshold 0.25, 25 m off junctions)."""
    from roadpoints.operators.sequence import with_position
    parts = []
    if "stencil" in detectors:
        thin = cut(with_position(K.resample(skel, 20.0, keys).drop("pos", "n"), keys))
        parts.append(K.stencil_turns(thin, 0.4, keys).select(*keys, "ord", "x", "y", F.lit("stencil").alias("detector")))
    if "edge" in detectors:
        two = K.edge_curves(skel, 20.0, 0.25, keys=keys).select(*keys, "ord", "x", "y")
        two = near_join(two, junctions.select(*keys, "x", "y").distinct(), 25.0, keys, how="left_anti")
        parts.append(two.withColumn("detector", F.lit("edge")))
    return reduce(DataFrame.unionByName, parts)
