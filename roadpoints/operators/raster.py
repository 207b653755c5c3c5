"""Sparse rasters: one row per set pixel (layer, row, col). Thinning and neighbour counts are aggregates over
neighbour offsets, so a crowded area is summed on the map side and no pixel block has to fit in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadpoints.functions.geom import seg_dist
from roadpoints.operators.celljoin import KEYS, segment_cells
from roadpoints.operators.cuts import cut, cut_counting, united

# neighbours in circular order from north, as (row, col) steps; bit i of a mask is neighbour i
AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def rasterise_bands(roads: DataFrame, px: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels whose centre lies on a widened road; row and col count cells of size ``px`` up and right from 0."""
    hw = F.col("half_width")
    cells = segment_cells(roads, px, hw)
    inside = seg_dist((F.col("cx") + 0.5) * px, (F.col("cy") + 0.5) * px, "x1", "y1", "x2", "y2") <= hw
    return cells.where(inside).select(*keys, F.col("cy").alias("row"), F.col("cx").alias("col")).distinct()


def rasterise_rings(edges: DataFrame, px: float = 1.0, keys: Sequence[str] = KEYS, shape: str = "shape_id") -> DataFrame:
    """Pixels whose centre lies in a polygon, by scanline: each row's crossings in order, filled between pairs."""
    k = [*keys, shape]
    lo, hi = F.ceil(F.least("y1", "y2") / px - 0.5), F.ceil(F.greatest("y1", "y2") / px - 0.5) - 1
    cross = edges.where("y1 <> y2").where(hi >= lo).withColumn("row", F.explode(F.sequence(lo, hi)))
    at = F.col("x1") + ((F.col("row") + 0.5) * px - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    w = Window.partitionBy(*k, "row").orderBy("xc")
    span = cross.withColumn("xc", at).withColumns({"i": F.row_number().over(w), "xn": F.lead("xc").over(w)}).where("i % 2 = 1 and xn is not null")
    a, b = F.ceil(F.col("xc") / px - 0.5), F.ceil(F.col("xn") / px - 0.5) - 1
    return span.where(b >= a).withColumn("col", F.explode(F.sequence(a, b))).select(*keys, "row", "col").distinct()


def neighbour_mask(pixels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pixels plus ``mask``: bit i is set when neighbour i is set. One shuffle, no join."""
    steps = F.array(*[F.struct(F.lit(-r).alias("r"), F.lit(-c).alias("c"), F.lit(1 << i).alias("b")) for i, (r, c) in enumerate(AROUND)],
                    F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(256).alias("b")))
    told = pixels.withColumn("s", F.explode(steps)).select(*keys, (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), F.col("s.b").alias("b"))
    m = told.groupBy(*keys, "row", "col").agg(F.sum("b").alias("m")).where("m >= 256")
    return m.select(*keys, "row", "col", (F.col("m") - 256).cast("int").alias("mask"))


def neighbour_counts(pixels: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return neighbour_mask(pixels, keys).withColumn("neighbours", F.bit_count("mask")).drop("mask")


def _removable(first: bool) -> Column:
    """Zhang and Suen's conditions on the neighbour mask (Communications of the ACM 27, 1984)."""
    m = F.col("mask")
    on = lambda i: m.bitwiseAND(1 << i) != 0
    turned = F.shiftright(m, 1).bitwiseOR(F.shiftleft(m.bitwiseAND(1), 7))
    starts = F.bit_count(F.bitwise_not(m).bitwiseAND(turned).bitwiseAND(255))
    n, e, s, w = on(0), on(2), on(4), on(6)
    sides = ~(n & e & s) & ~(e & s & w) if first else ~(n & e & w) & ~(n & s & w)
    return F.bit_count(m).between(2, 6) & (starts == 1) & sides


def thin(pixels: DataFrame, keys: Sequence[str] = KEYS, limit: int = 10000) -> DataFrame:
    """Thin to lines one pixel wide: two sub-steps per round until a round removes nothing."""
    now, left = cut_counting(pixels)
    for _ in range(limit):
        before = left
        for first in (True, False):
            now, left = cut_counting(neighbour_mask(now, keys).where(~_removable(first)).select(*keys, "row", "col"))
        if left == before:
            return now
    raise RuntimeError(f"thin: no fixpoint after {limit} rounds")


def pixel_points(pixels: DataFrame, px: float = 1.0) -> DataFrame:
    """Pixel centres as ordered points in scan order (row by row)."""
    return pixels.withColumns({"x": (F.col("col") + 0.5) * px, "y": (F.col("row") + 0.5) * px, "ord": F.col("row") * (1 << 24) + F.col("col")})


def junction_centres(skel: DataFrame, px: float = 1.0, least: int = 3, eps: float = 5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Centres of clusters of skeleton pixels with at least ``least`` neighbours."""
    from roadpoints.operators.select import cluster_centres
    hot = neighbour_counts(skel, keys).where(F.col("neighbours") >= least)
    return cluster_centres(cut(pixel_points(hot, px).select(*keys, "ord", "x", "y")), eps, keys)


def skeleton_edges(skel: DataFrame, px: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges between 8-neighbour pixels: u, v, w."""
    p = pixel_points(skel, px).select(*keys, "row", "col", "ord")
    half = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    to = p.withColumn("s", F.explode(half)).select(*keys, F.col("ord").alias("u"), (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"),
                                                   (F.sqrt(F.abs("s.r") + F.abs("s.c")) * px).alias("w"))
    return to.join(p.withColumnRenamed("ord", "v"), [*keys, "row", "col"]).select(*keys, "u", "v", "w")


def skeleton_lines(skel: DataFrame, px: float = 1.0, keys: Sequence[str] = KEYS, limit: int = 60) -> DataFrame:
    """Skeleton pixels by line: seg and step along it from its start (the sound order, unlike the scan order).

    Each directed edge knows the one after it; doubling gives its distance to the line's end in log(length) rounds.
    """
    from roadpoints.operators.graph import segment_table, segments
    k = [*keys, "seg"]
    nodes = cut(pixel_points(skel, px))
    segs = segments(nodes, cut(skeleton_edges(skel, px, keys)), keys)
    low = segs.groupBy(*k).agg(F.min("u").alias("_u"))
    tips = cut(segment_table(nodes, segs, keys).join(low, k).select(*k, "edges", F.coalesce("start", "_u").alias("start"), F.coalesce("end", "_u").alias("end")))
    arcs = united([segs.select(*k, "u", "v"), segs.select(*k, F.col("v").alias("u"), F.col("u").alias("v"))])
    on = arcs.join(tips, k).where("v <> start and v <> end").select(*k, "u", "v")
    nxt = on.join(arcs.select(*k, F.col("u").alias("v"), F.col("v").alias("w")), [*k, "v"]).where("w <> u").select(*k, "u", "v", F.col("v").alias("nu"), F.col("w").alias("nv"))
    # an edge without a next one is its line's last; it points at itself
    walk, moving = cut_counting(arcs.join(nxt, [*k, "u", "v"], "left").select(
        *k, "u", "v", F.when(F.col("nu").isNull(), 0).otherwise(1).cast("long").alias("left"), F.coalesce("nu", "u").alias("nu"), F.coalesce("nv", "v").alias("nv")), F.sum("left"))
    for _ in range(limit):
        ahead = walk.select(*k, F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("left").alias("more"), F.col("nu").alias("fu"), F.col("nv").alias("fv"))
        before = moving
        walk, moving = cut_counting(walk.join(ahead, [*k, "nu", "nv"]).select(*k, "u", "v", (F.col("left") + F.col("more")).alias("left"), F.col("fu").alias("nu"), F.col("fv").alias("nv")), F.sum("left"))
        if moving == before:
            break
    else:
        raise RuntimeError(f"skeleton_lines: no fixpoint after {limit} rounds")
    # one direction per line: towards its end; a loop ends where it starts, so there the smaller last step decides
    way = walk.join(tips, k).where(F.col("nv") == F.col("end"))
    pick = way.groupBy(*k).agg(F.min("nu").alias("_n"))
    way = way.join(pick, k).where("start <> end or nu = _n")
    head = tips.select(*k, F.col("start").alias("ord"), F.lit(0).cast("long").alias("step"))
    rest = way.where("start <> end or v <> end").select(*k, F.col("v").alias("ord"), (F.col("edges") - F.col("left")).alias("step"))
    return head.unionByName(rest).join(nodes.select(*keys, "ord", "x", "y"), [*keys, "ord"])
