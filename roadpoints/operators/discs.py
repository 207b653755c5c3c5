"""What lies in a disc around a site: road area and outline, turns of the road boundary, local road width.

Areas come from the edges near a site alone, as sums, so no ring and no site is gathered. Sites on one place are
folded before the join. A site without coordinates meets nothing: its measures are 0. Discs are true circles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from roadpoints.functions.geom import bearing, dist, turn_angle
from roadpoints.operators.celljoin import KEYS, near_join
from roadpoints.operators.links import finite, lines_near, nearest_segment
from roadpoints.operators.polygons import ROW, inside
from roadpoints.operators.sequence import BLOCK, framed, neighbours, with_position
from roadpoints.operators.cuts import cut

TINY = 1e-9


def disc_cut(sites: DataFrame, edges: DataFrame, radius: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus ``cut_area`` and ``cut_length``: area and outline of the polygons' part within ``radius``.

    ``edges`` are those of polygons that do not overlap, directed with the inside on the left: outer rings
    counter-clockwise, holes clockwise. The part's outline is made of edge pieces in the disc and of arcs that run from
    where an edge leaves the disc to where the next one enters. Only the arcs' total matters, and it is the sum of
    the entry angles less that of the exit angles, up to one full turn: so plain sums do. Discs that meet no
    edge are all inside or all outside.
    """
    on, r2 = [*keys, "x", "y"], radius * radius
    edges = finite(edges, ("x1", "y1", "x2", "y2"))
    spots = sites.select(*on).distinct()
    hit = lines_near(spots, edges.where("x1 <> x2 or y1 <> y2"), radius * (1 + TINY), keys, "edge_id", strict=False)
    hit = hit.select(*on, (F.col("ax") - F.col("x")).alias("ux"), (F.col("ay") - F.col("y")).alias("uy"),
                     (F.col("bx") - F.col("x")).alias("vx"), (F.col("by") - F.col("y")).alias("vy"))
    # ends are judged by their coordinates, so two edges that share one agree on it
    hit = hit.withColumns({"dx": F.col("vx") - F.col("ux"), "dy": F.col("vy") - F.col("uy"),
                           "in1": F.expr("ux * ux + uy * uy") <= r2, "in2": F.expr("vx * vx + vy * vy") <= r2})
    hit = hit.withColumns({"a": F.expr("dx * dx + dy * dy"), "b": F.expr("ux * dx + uy * dy")})
    hit = hit.withColumn("q", F.col("b") * F.col("b") - F.col("a") * (F.expr("ux * ux + uy * uy") - r2))
    root = F.sqrt(F.greatest(F.col("q"), F.lit(0.0)))
    hit = hit.withColumns({"s1": (-F.col("b") - root) / F.col("a"), "s2": (-F.col("b") + root) / F.col("a")})
    hit = hit.where("in1 or in2 or (q > 0 and s1 > 0 and s2 < 1)")
    hit = hit.withColumns({"t1": F.when(F.col("in1"), 0.0).otherwise(F.expr("least(1D, greatest(0D, s1))")),
                           "t2": F.when(F.col("in2"), 1.0).otherwise(F.expr("least(1D, greatest(0D, s2))"))})
    angle = lambda t: F.expr(f"atan2(uy + {t} * dy, ux + {t} * dx)")
    zero = F.lit(0.0)
    sums = hit.groupBy(*on).agg(
        F.sum(F.expr("(t2 - t1) * sqrt(a)")).alias("_len"), F.sum(F.expr("(t2 - t1) * (ux * dy - uy * dx) / 2")).alias("_area"),
        F.sum(F.when(~F.col("in1"), angle("t1")).otherwise(zero) - F.when(~F.col("in2"), angle("t2")).otherwise(zero)).alias("_arc"))
    turn = (F.col("_arc") < -TINY) | (F.col("_area") + F.col("_arc") * r2 / 2 < -TINY)
    sums = sums.withColumn("_arc", F.when(turn, F.col("_arc") + 2 * math.pi).otherwise(F.col("_arc")))
    met = cut(spots.join(sums, on, "left"))
    bare = inside(met.where("_arc is null").select(*on), edges, keys).select(
        *on, F.lit(0.0).alias("_len"), F.lit(0.0).alias("_area"), F.when(F.col("inside"), 2 * math.pi).otherwise(0.0).alias("_arc"))
    full = met.where("_arc is not null").unionByName(bare).select(
        *on, (F.col("_area") + F.col("_arc") * r2 / 2).alias("cut_area"), (F.col("_len") + F.col("_arc") * radius).alias("cut_length"))
    return sites.join(full, on, "left").fillna(0.0, ["cut_area", "cut_length"])


def disc_flow(sites: DataFrame, edges: DataFrame, radius: float = 40.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus road_area, road_length, flow_score and is_major (area above 1000 or length above 100)."""
    c = disc_cut(sites, edges, radius, keys).withColumnsRenamed({"cut_area": "road_area", "cut_length": "road_length"})
    return c.withColumns({"flow_score": F.col("road_area") * 0.1 + F.col("road_length") * 10,
                          "is_major": (F.col("road_area") > 1000) | (F.col("road_length") > 100)})


def disc_turns(sites: DataFrame, boundary: DataFrame, radius: float = 25.0, step: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus n_near, curve_density, curve_complexity, curve_score and is_critical, from the turns of the boundary near them.

    ``boundary`` has one row per vertex: ``ring``, an integer ``ord`` through the layer, ``x``, ``y``; every ``step``-th
    vertex of a ring counts. Vertices in the disc, in order, form one line; its turns are measured at each
    inner vertex. Where both neighbours of a vertex lie in the disc too, its turn is known before the join;
    only vertices at the rim need the next vertex met, and these go through windows of bounded blocks.
    """
    on = [*keys, "x", "y"]
    seen = with_position(boundary.select(*keys, "ring", "ord", "x", "y"), (*keys, "ring"), name="_p").where(F.col("_p") % step == 0)
    line = neighbours(with_position(seen.select(*keys, "ord", "x", "y"), keys), keys=keys)
    line = line.withColumn("turn", turn_angle("p1_x", "p1_y", "x", "y", "n1_x", "n1_y"))
    hit = near_join(sites.select(*on).distinct(), line.select(*keys, "pos", "x", "y", "turn", "p1_x", "p1_y", "n1_x", "n1_y"), radius, keys)
    within = lambda px, py: F.coalesce(dist("x", "y", px, py) <= radius, F.lit(False))
    hit = cut(hit.withColumns({"_in1": within("r_p1_x", "r_p1_y"), "_in2": within("r_n1_x", "r_n1_y")}).drop("d"))
    rim = with_position(hit.where("not (_in1 and _in2)"), on, "r_pos")
    back, on_ = lambda w, c: F.lag(c).over(w), lambda w, c: F.lead(c).over(w)
    rim = framed(rim, lambda w: {"_px": back(w, "r_x"), "_py": back(w, "r_y"), "_nx": on_(w, "r_x"), "_ny": on_(w, "r_y")}, 1, 1, on)
    pick = lambda flag, here, else_: F.when(F.col(flag), F.col(here)).otherwise(F.col(else_))
    rim = rim.select(*on, turn_angle(pick("_in1", "r_p1_x", "_px"), pick("_in1", "r_p1_y", "_py"), "r_x", "r_y",
                                     pick("_in2", "r_n1_x", "_nx"), pick("_in2", "r_n1_y", "_ny")).alias("turn"))
    turns = hit.where("_in1 and _in2").select(*on, F.col("r_turn").alias("turn")).unionByName(rim)
    near = turns.groupBy(*on).agg(F.count(F.lit(1)).alias("n_near"), F.avg("turn").alias("_avg"), F.max("turn").alias("_max"))
    few = F.col("n_near") < 3
    near = near.select(*on, "n_near", F.when(few, 0.0).otherwise(F.col("n_near") / (math.pi * radius * radius)).alias("curve_density"),
                       F.when(few, 0.0).otherwise(F.coalesce(F.col("_avg") + F.col("_max") * 0.5, F.lit(0.0))).alias("curve_complexity"),
                       (~few & F.coalesce(F.col("_max") > math.pi / 6, F.lit(False))).alias("is_critical"))
    out = sites.join(near, on, "left").fillna({"n_near": 0, "curve_density": 0.0, "curve_complexity": 0.0, "is_critical": False})
    return out.withColumn("curve_score", F.col("curve_density") * F.col("curve_complexity") * 100)


def curve_and_flow(curve: DataFrame, flow: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sites with combined = 0.4 curve_score + 0.6 flow_score and the flags of both."""
    on = [*keys, "ord"]
    return (curve.select(*on, "curve_score", "is_critical").join(flow.select(*on, "flow_score", "is_major"), on)
            .withColumn("combined", F.col("curve_score") * 0.4 + F.col("flow_score") * 0.6))


def nearest_ring(sites: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus ``ring`` and ``ring_d``: the first ring around the site at 0, else the nearest one, ties to the first."""
    on = [*keys, "x", "y"]
    edges = finite(edges, ("x1", "y1", "x2", "y2"))
    spots = sites.select(*on).distinct()
    strips = edges.where("y1 <> y2").select(*keys, "ring", "x1", "y1", "x2", "y2", F.explode(F.expr(
        f"sequence(floor(least(y1, y2) / {ROW}D), floor(greatest(y1, y2) / {ROW}D))")).alias("cy"))
    crossed = spots.withColumn("cy", F.floor(F.col("y") / ROW)).join(strips, [*keys, "cy"]).where(
        "(y1 > y) <> (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)")
    around = crossed.groupBy(*on, "ring").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").groupBy(*on).agg(F.min("ring").alias("_in"))
    near = nearest_segment(spots, edges, keys=keys, line_id="ring")
    found = near.join(around, on, "left").select(*on, F.coalesce("_in", "near_line").alias("ring"),
                                                 F.when(F.col("_in").isNull(), F.col("near_d")).otherwise(0.0).alias("ring_d"))
    return sites.join(found, on, "left")


def local_width(sites: DataFrame, edges: DataFrame, skeleton: DataFrame, radius: float = 15.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus road_d, road_width, skeleton_density and importance.

    Width is area over outline (at least 1) of the nearest polygon's part in the disc, 0 where it has none; density
    counts skeleton points per area of the disc. ``edges`` carry ``ring``; polygons may overlap here.
    """
    on = [*keys, "x", "y"]
    near = cut(nearest_ring(sites, edges, keys))
    part = disc_cut(near, edges, radius, (*keys, "ring"))
    weighed = skeleton.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    dense = near_join(sites.select(*on).distinct(), weighed, radius, keys).groupBy(*on).agg(F.sum("r_n").alias("_n"))
    out = part.join(dense, on, "left").withColumns({
        "road_width": F.col("cut_area") / F.greatest(F.col("cut_length"), F.lit(1.0)),
        "skeleton_density": F.coalesce("_n", F.lit(0)) / (math.pi * radius * radius)})
    return (out.withColumn("importance", F.col("road_width") * 10 + F.col("skeleton_density") * 1000)
            .withColumnRenamed("ring_d", "road_d").drop("cut_area", "cut_length", "_n"))


def sharp_vertices(rings: DataFrame, threshold: float = 0.3, keys: Sequence[str] = KEYS, block: int = BLOCK) -> DataFrame:
    """Vertices where the bearing along a ring changes by more than ``threshold``, with ``change``.

    ``rings`` has ``ring``, an integer ``ord``, ``x``, ``y``; an open ring is closed with its first vertex. The change
    at a vertex is half the difference of the bearings one edge on and one edge back from the edge that ends there; at the
    first edge it is the plain difference to the next one. The end of the ring is not looked at.
    """
    k = [*keys, "ring"]
    v = with_position(rings.select(*k, "ord", "x", "y"), k, total="n")
    tip = v.where("pos = 0 or pos = n - 1").groupBy(*k).agg(F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"), F.max("n").alias("n"))
    shut = tip.where("a <> b").select(*k, F.lit(None).cast("long").alias("ord"), "a.x", "a.y", F.col("n").alias("pos"), "n")
    v = neighbours(v.select(*k, "ord", "x", "y", "pos", "n").unionByName(shut), reach=2, keys=k, block=block)
    on_ = bearing("x", "y", "n1_x", "n1_y")
    change = F.when(F.col("pos") == 1, on_ - bearing("p1_x", "p1_y", "x", "y")).otherwise((on_ - bearing("p2_x", "p2_y", "p1_x", "p1_y")) / 2)
    v = v.where("pos >= 1 and n1_x is not null").withColumn("change", F.abs(change))
    return v.where(F.col("change") > threshold).select(*k, "ord", "x", "y", "change")
