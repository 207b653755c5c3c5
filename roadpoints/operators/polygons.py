"""Point-in-polygon and boundary operators over polygon edges (one row per edge)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from roadpoints.operators.celljoin import KEYS
from roadpoints.operators.links import nearest_segment

ROW = 100.0


def inside(sites: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, row: float = ROW) -> DataFrame:
    """``sites`` plus ``inside`` by ray crossing: edges that a ray to the right crosses, odd means inside.

    Edges are cut by rows of height ``row``, so a site meets only the edges of its own row.
    """
    on = [*keys, "x", "y"]
    lo = F.floor(F.least("y1", "y2") / row)
    hi = F.floor(F.greatest("y1", "y2") / row)
    strips = edges.where("y1 <> y2").select(*keys, "x1", "y1", "x2", "y2", F.explode(F.sequence(lo, hi)).alias("cy"))
    spots = sites.select(*on).distinct().withColumn("cy", F.floor(F.col("y") / row))
    at = F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    hit = (spots.join(strips, [*keys, "cy"])
           .where(((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < at)))
    odd = hit.groupBy(*on).agg((F.count(F.lit(1)) % 2 == 1).alias("inside"))
    return sites.join(odd, on, "left").fillna({"inside": False})


def boundary_distance(sites: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, missing: float = 1000.0) -> DataFrame:
    """``sites`` plus ``boundary_d``: distance to the boundary, negative outside, ``missing`` without one."""
    near = nearest_segment(inside(sites, edges, keys), edges, keys=keys, line_id="edge_id", first_edge=200.0)
    d = F.when(F.col("inside"), F.col("near_d")).otherwise(-F.col("near_d"))
    return near.withColumn("boundary_d", F.coalesce(d, F.lit(missing))).drop("near_line", "near_d", "foot_x", "foot_y", "measure")


def within_ring_distance(sites: DataFrame, edges: DataFrame, reach: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sites inside the ring or within ``reach`` of it."""
    near = nearest_segment(inside(sites, edges, keys), edges, cap=reach, keys=keys, line_id="edge_id")
    return near.where("inside or near_d is not null").select(*sites.columns)
