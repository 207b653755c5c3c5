"""Scores of sites from the lines around them, and greedy site placement."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from roadpoints.functions.geom import crossing, dist, seg_dist, turn_angle, vector_angle
from roadpoints.operators import stats as S
from roadpoints.operators.celljoin import KEYS, near_join, segment_cells
from roadpoints.operators.graph import line_crossings
from roadpoints.operators.links import lines_near
from roadpoints.operators.sequence import ranked
from roadpoints.operators.cuts import cut, cut_counting


def line_shape(vertices: DataFrame, keys: Sequence[str] = KEYS, line_id: str = "road_id") -> DataFrame:
    """Per line: length, mean turn and number of turns above 30 degrees."""
    w = Window.partitionBy(*keys, line_id).orderBy("ord")
    v = vertices.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    v = v.withColumn("t", turn_angle("px", "py", "x", "y", "nx", "ny"))
    return v.groupBy(*keys, F.col(line_id).alias("line")).agg(
        F.sum(F.coalesce(dist("x", "y", "nx", "ny"), F.lit(0.0))).alias("length"), F.coalesce(F.avg("t"), F.lit(0.0)).alias("mean_turn"),
        F.count_if(F.col("t") > math.pi / 6).alias("sharp"))


def site_line_scores(sites: DataFrame, segs: DataFrame, shape: DataFrame, radius: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sites with a line within ``radius``: flow (length + 5 per sharp turn) and curvature (sum of mean turns)."""
    hit = lines_near(sites.select(*keys, "ord", "x", "y"), segs, radius, keys, strict=False).select(*keys, "ord", "line").distinct()
    return hit.join(shape, [*keys, "line"]).groupBy(*keys, "ord").agg(
        F.sum(F.col("length") + 5 * F.col("sharp")).alias("flow"), F.sum("mean_turn").alias("curvature"))


def connectivity_score(sites: DataFrame, segs: DataFrame, radius: float = 50.0, keys: Sequence[str] = KEYS, line_id: str = "road_id") -> DataFrame:
    """Sites with two or more lines near: 10 per crossing pair plus 5 times the summed direction differences.

    Pairs are made only among the lines near one site.
    """
    k = list(keys)
    way = segs.select(*k, F.col(line_id).alias("line"), (F.col("x2") - F.col("x1")).alias("vx"), (F.col("y2") - F.col("y1")).alias("vy"))
    hit = cut(lines_near(sites.select(*k, "ord", "x", "y"), segs, radius, keys, line_id, strict=False).select(*k, "ord", "line").distinct().join(way, [*k, "line"]))
    b = hit.select(*k, "ord", F.col("line").alias("line2"), F.col("vx").alias("wx"), F.col("vy").alias("wy"))
    meet = line_crossings(segs, keys, line_id).select(*k, F.col("line1").alias("line"), "line2").distinct().withColumn("met", F.lit(1))
    pair = hit.join(b, [*k, "ord"]).where("line < line2").join(meet, [*k, "line", "line2"], "left")
    return pair.groupBy(*k, "ord").agg((F.sum(F.coalesce("met", F.lit(0))) * 10 + F.sum(vector_angle("vx", "vy", "wx", "wy")) * 5).alias("score"))


def touching_lines(segs: DataFrame, reach: float = 5.0, ends: float = 3.0, keys: Sequence[str] = KEYS, line_id: str = "road_id") -> DataFrame:
    """Pairs line1 < line2 with their gap: kind near where segments come within ``reach``, kind ends where end points come within ``ends``."""
    s = segs.select(*keys, F.col(line_id).alias("line1"), "x1", "y1", "x2", "y2")
    t = segs.select(*keys, F.col(line_id).alias("line2"), F.col("x1").alias("u1"), F.col("y1").alias("v1"), F.col("x2").alias("u2"), F.col("y2").alias("v2"))
    met = segment_cells(s, 200.0, reach).join(segment_cells(t, 200.0, 0.0, ("u1", "v1", "u2", "v2")), [*keys, "cx", "cy"]).where("line1 < line2")
    x, _ = crossing("x1", "y1", "x2", "y2", "u1", "v1", "u2", "v2")
    apart = F.least(seg_dist("x1", "y1", "u1", "v1", "u2", "v2"), seg_dist("x2", "y2", "u1", "v1", "u2", "v2"),
                    seg_dist("u1", "v1", "x1", "y1", "x2", "y2"), seg_dist("u2", "v2", "x1", "y1", "x2", "y2"))
    near = met.withColumn("gap", F.when(x.isNotNull(), 0.0).otherwise(apart)).where(F.col("gap") <= reach).groupBy(*keys, "line1", "line2").agg(F.min("gap").alias("gap"))
    tip = s.select(*keys, F.col("line1").alias("line"), F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(*keys, "line", "p.*")
    tips = near_join(tip, tip, ends, keys).where("line < r_line").groupBy(*keys, F.col("line").alias("line1"), F.col("r_line").alias("line2")).agg(F.min("d").alias("gap"))
    return near.select("*", F.lit("near").alias("kind")).unionByName(tips.withColumn("kind", F.lit("ends")))


def combined_importance(basic: float, curvature, connectivity, flow):
    """0.3 basic + 0.2 curvature + 0.3 connectivity + 0.2 flow, as a column."""
    return basic * 0.3 + curvature * 0.2 + connectivity * 0.3 + flow * 0.2


def site_importance(basic: DataFrame, sites: DataFrame, segs: DataFrame, shape: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every site with basic (``importance`` of ``basic``), curvature of lines within 30 m, connectivity within 50 m, flow within 40 m, and their weighted sum ``importance``.

    A site without lines in reach has 0 for the measure.
    """
    on = [*keys, "ord"]
    curved = site_line_scores(sites, segs, shape, 30.0, keys).select(*on, "curvature")
    flowing = site_line_scores(sites, segs, shape, 40.0, keys).select(*on, "flow")
    linked = connectivity_score(sites, segs, 50.0, keys).select(*on, F.col("score").alias("connectivity"))
    all_ = basic.select(*on, F.col("importance").alias("basic")).join(curved, on, "left").join(linked, on, "left").join(flowing, on, "left").fillna(0.0)
    return all_.withColumn("importance", combined_importance(F.col("basic"), F.col("curvature"), F.col("connectivity"), F.col("flow")))


def place_sites(candidates: DataFrame, bounds: DataFrame, radius: float = 50.0, target: float = 0.95, grid: float = 10.0,
                keys: Sequence[str] = KEYS) -> DataFrame:
    """Greedy placement per layer: ``round`` numbers the sites in the order in which each adds most new area, ties by ``ord``, until the
    target ratio or until no candidate gains.

    A candidate that gains more than all others that share a free cell with it is placed before them whatever happens elsewhere, and gains
    never grow. So all such candidates are placed at once, and the order by gain is the greedy order.
    """
    k = list(keys)
    grid_cells = cut(S.coverage_cells(bounds, grid, keys))
    hits = cut(near_join(grid_cells, candidates.select(*k, "x", "y", "ord"), radius, keys).select(*k, "gi", "gj", F.col("r_ord").alias("ord")))
    parts = []
    while True:
        gain = hits.groupBy(*k, "ord").agg(F.count(F.lit(1)).alias("n"))
        best = cut(hits.join(gain, [*k, "ord"]).groupBy(*k, "gi", "gj").agg(F.max(F.struct("n", (-F.col("ord")).alias("o"))).alias("b")).select(*k, "gi", "gj", "b.n", (-F.col("b.o")).alias("ord")))
        placed = cut(best.groupBy(*k, "ord", "n").agg(F.count(F.lit(1)).alias("_won")).where("_won = n").drop("_won"))
        parts.append(placed)
        gone = hits.join(placed, [*k, "ord"], "left_semi").select(*k, "gi", "gj").distinct()
        hits, left = cut_counting(hits.join(gone, [*k, "gi", "gj"], "left_anti"))
        if not left:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = ranked(out, "n", keys, "round")
    upto = grid_cells.groupBy(*k).agg(F.count(F.lit(1)).alias("_all"))
    # sums before a site from those of equal gains: fewer rows a layer than a disc has cells
    step = order.groupBy(*k, "n").agg(F.count(F.lit(1)).alias("_m"), F.min("round").alias("_r"))
    before = F.sum(F.col("n") * F.col("_m")).over(Window.partitionBy(*k).orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1))
    step = step.withColumn("_b", F.coalesce(before, F.lit(0))).drop("_m")
    open_ = F.col("_all") - F.col("_b") - (F.col("round") - F.col("_r")) * F.col("n")
    kept = order.join(step, [*k, "n"]).join(upto, k).where((F.col("round") == 1) | (open_ > (1 - target) * F.col("_all")))
    at = candidates.select(*k, "ord", "x", "y")
    return kept.join(at, [*k, "ord"]).select(*k, F.col("round").cast("int").alias("round"), "ord", "x", "y", (F.col("n") * grid * grid).alias("gain_area"))
