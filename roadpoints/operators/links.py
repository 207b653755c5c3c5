"""Tests on links between points: road cover, sight, blockers, paths along the skeleton.

A links table has the layer keys, ord1, ord2, x1, y1, x2, y2 and d. A roads table has
road_id, x1, y1, x2, y2 and half_width: a road is its centre line and a width, so every
test against a widened road is a distance rule, not a polygon.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadpoints.functions.geom import (dist, foot, measure_ratio, same_box, seg_dist, with_band_interval)
from roadpoints.operators.celljoin import KEYS, around, finite, pairs_within, segment_cells, with_cell
from roadpoints.operators.cuts import cut, cut_counting, united

EDGE = 50.0
PAIR = ("ord1", "ord2")
# band of the sampled share; the nanometre keeps samples at a link's end that lie just on the band's border
SAMPLED = 15.0 + 1e-9


def _roads(roads: DataFrame, keys: Sequence[str], reach: float, edge: float = EDGE) -> DataFrame:
    r = roads.select(*keys, "road_id", F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("bx"),
                     F.col("y2").alias("by"), "half_width")
    return segment_cells(r, edge, F.col("half_width") + reach, ("ax", "ay", "bx", "by"))


def _ends(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    return links.select(*keys, *PAIR, "x1", "y1", "x2", "y2").distinct()


def nearest_segment(sites: DataFrame, segs: DataFrame, cap: float | None = None, keys: Sequence[str] = KEYS,
                    line_id: str = "road_id", strict: bool = False, first_edge: float = 50.0) -> DataFrame:
    """``sites`` plus the nearest segment: near_line, near_d (to the centre line), foot_x, foot_y, measure.

    ``measure`` is the distance along the segment to the foot. Without a cap, cells double
    for the sites that are still open. Sites and segments whose coordinates are no finite numbers meet none.
    """
    on = [*keys, "x", "y"]
    segs = finite(segs, ("x1", "y1", "x2", "y2"))
    lines = segs.select(*keys, F.col(line_id).alias("line"), F.col("x1").alias("ax"), F.col("y1").alias("ay"),
                        F.col("x2").alias("bx"), F.col("y2").alias("by"))

    def attempt(todo, reach):
        edge = max(reach, EDGE)
        cells = segment_cells(lines, edge, reach, ("ax", "ay", "bx", "by"))
        fx, fy = foot("x", "y", "ax", "ay", "bx", "by")
        hit = (with_cell(todo, edge).join(cells, [*keys, "cx", "cy"])
               .withColumn("d", seg_dist("x", "y", "ax", "ay", "bx", "by"))
               .where(F.col("d") < reach if strict and cap is not None else F.col("d") <= reach))
        along = measure_ratio("x", "y", "ax", "ay", "bx", "by") * dist("ax", "ay", "bx", "by")
        return hit.groupBy(*on).agg(F.min(F.struct(
            "d", "line", fx.alias("fx"), fy.alias("fy"), along.alias("m"))).alias("near"))

    spots = finite(sites.select(*on)).distinct()
    if cap is not None:
        found = attempt(spots, cap)
    else:
        todo, left = cut_counting(spots.join(segs.select(*keys).distinct(), list(keys), "left_semi"))
        parts, edge = [], first_edge
        while left:
            part, got = cut_counting(attempt(todo, edge))
            parts.append(part)
            todo, left = todo.join(part, on, "left_anti"), left - got
            edge *= 2
        found = united(parts) if parts else attempt(spots, first_edge)
    return (sites.join(found, on, "left")
            .withColumns({"near_line": F.col("near.line"), "near_d": F.col("near.d"), "foot_x": F.col("near.fx"),
                          "foot_y": F.col("near.fy"), "measure": F.col("near.m")}).drop("near"))


def lines_near(sites: DataFrame, segs: DataFrame, radius: float, keys: Sequence[str] = KEYS,
               line_id: str = "road_id", strict: bool = True) -> DataFrame:
    """(site, line) rows within ``radius`` with distance ``d`` and position ``measure`` along the line."""
    lines = segs.select(*keys, F.col(line_id).alias("line"), F.col("x1").alias("ax"), F.col("y1").alias("ay"),
                        F.col("x2").alias("bx"), F.col("y2").alias("by"))
    edge = max(radius, EDGE)
    cells = segment_cells(lines, edge, radius, ("ax", "ay", "bx", "by"))
    near = F.col("d") < radius if strict else F.col("d") <= radius
    return (with_cell(sites, edge).join(cells, [*keys, "cx", "cy"])
            .withColumn("d", seg_dist("x", "y", "ax", "ay", "bx", "by")).where(near)
            .withColumn("measure", measure_ratio("x", "y", "ax", "ay", "bx", "by") * dist("ax", "ay", "bx", "by"))
            .drop("cx", "cy"))


def road_gap(sites: DataFrame, roads: DataFrame, cap: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus ``gap``: distance to the nearest road surface, 0 on it, null beyond ``cap``."""
    on = [*keys, "x", "y"]
    edge = max(cap, 25.0)
    hits = (with_cell(sites.select(*on).distinct(), edge).join(_roads(roads, keys, cap, edge), [*keys, "cx", "cy"])
            .withColumn("gap", F.greatest(F.lit(0.0), seg_dist("x", "y", "ax", "ay", "bx", "by") - F.col("half_width")))
            .where(F.col("gap") <= cap).groupBy(*on).agg(F.min("gap").alias("gap")))
    return sites.join(hits, on, "left")


def on_road(sites: DataFrame, roads: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus the flag ``on_road``."""
    return road_gap(sites, roads, 0.0, keys).withColumn("on_road", F.col("gap").isNotNull()).drop("gap")


def link_intervals(links: DataFrame, roads: DataFrame, bands: dict[str, float], keys: Sequence[str] = KEYS) -> DataFrame:
    """(link, road) rows with <name>_t0 and <name>_t1 per band: the part of the link inside the widened road."""
    reach = max(bands.values())
    hits = segment_cells(_ends(links, keys), EDGE).join(_roads(roads, keys, reach), [*keys, "cx", "cy"])
    pair = [*keys, *PAIR, "road_id"]
    geo = ["x1", "y1", "x2", "y2", "ax", "ay", "bx", "by", "half_width"]
    once = hits.groupBy(*pair).agg(*[F.first(c).alias(c) for c in geo])
    for name, band in bands.items():
        once = with_band_interval(once, F.col("half_width") + band, name)
    return once


def best_share(iv: DataFrame, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest part of a link inside one single road."""
    return iv.groupBy(*keys, *PAIR).agg(F.max(F.col(f"{name}_t1") - F.col(f"{name}_t0")).alias("share"))


def union_share(iv: DataFrame, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Part of a link inside the union of the roads: intervals merged in order of their start."""
    w = Window.partitionBy(*keys, *PAIR).orderBy("t0", "t1")
    # empty intervals stay as nulls: a filter here would be pushed below the steps that build them
    add = F.when(F.col("t0").isNotNull(), F.greatest(F.lit(0.0), F.col("t1") - F.greatest("t0", F.coalesce("seen", F.lit(0.0)))))
    return (iv.select(*keys, *PAIR, F.col(f"{name}_t0").alias("t0"), F.col(f"{name}_t1").alias("t1"))
            .withColumn("seen", F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("add", add).groupBy(*keys, *PAIR).agg(F.sum("add").alias("share")).where("share is not null"))


def touched(iv: DataFrame, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Links that meet at least one widened road."""
    return iv.groupBy(*keys, *PAIR).agg(F.count(f"{name}_t0").alias("_n")).where("_n > 0").drop("_n")


def _mask(t0: Column, t1: Column, n: int = 10) -> Column:
    """Bit i is set when sample i of n+1 lies in t0..t1 (to 1e-9, so that exact touches count)."""
    bits = [F.when((t0 <= i / n + 1e-9) & (t1 >= i / n - 1e-9), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(n + 1)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def sampled_share(iv: DataFrame, name: str, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of n+1 even samples of a link that lie in a widened road; no sample rows are made."""
    t0, t1 = F.col(f"{name}_t0"), F.col(f"{name}_t1")
    return iv.groupBy(*keys, *PAIR).agg((F.bit_count(F.bit_or(_mask(t0, t1, n))) / (n + 1.0)).alias("share"))


def with_share(links: DataFrame, shares: DataFrame, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return (links.join(shares.withColumnRenamed("share", name), [*keys, *PAIR], "left")
            .withColumn(name, F.coalesce(name, F.lit(0.0))))


def road_tests(links: DataFrame, roads: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Links plus the four shares the tests use, from one join with the roads.

    single3: best single road, 3 m band; union20 and union8: union of roads; sampled15: 11 samples, 15 m band.
    """
    bands = {"b3": 3.0, "b20": 20.0, "b8": 8.0, "b15": SAMPLED}
    iv = cut(link_intervals(links, roads, bands, keys))
    out = with_share(links, best_share(iv, "b3", keys), "single3", keys)
    out = with_share(out, union_share(iv, "b20", keys), "union20", keys)
    out = with_share(out, union_share(iv, "b8", keys), "union8", keys)
    return with_share(out, sampled_share(iv, "b15", keys=keys), "sampled15", keys)


def rows_near_links(links: DataFrame, data: DataFrame, radius: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """(link, row) hits within ``radius`` of the link: x, y, w, line_d and ratio; copies of a place are one row."""
    cells = segment_cells(_ends(links, keys), EDGE, radius)
    spots = with_cell(data.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w")), EDGE)
    return (cells.join(spots, [*keys, "cx", "cy"])
            .withColumn("line_d", seg_dist("x", "y", "x1", "y1", "x2", "y2")).where(F.col("line_d") <= radius)
            .withColumn("ratio", measure_ratio("x", "y", "x1", "y1", "x2", "y2")).drop("cx", "cy"))


def skeleton_tests(links: DataFrame, skel: DataFrame, keys: Sequence[str] = KEYS, block: float = 8.0,
                   follow: float = 10.0) -> DataFrame:
    """Links plus ``blockers`` (skeleton points within 8 m, ends left out) and ``followed``
    (share of 11 samples within 10 m of a skeleton point), from one join with the skeleton.

    Samples are measured one by one, to 1e-7 of the squared distance: of a link that just touches the disc no interval is left.
    """
    hit = rows_near_links(links, skel, max(block, follow) + 1e-8, keys)
    own = same_box("x", "y", "x1", "y1") | same_box("x", "y", "x2", "y2")
    bits = F.lit(0)
    for i in range(11):
        dx, dy = (F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * i / 10.0 - F.col(c) for c in ("x", "y"))
        bits = bits.bitwiseOR(F.when(dx * dx + dy * dy <= follow * follow + 1e-7, F.lit(1 << i)).otherwise(F.lit(0)))
    agg = hit.groupBy(*keys, *PAIR).agg(
        F.coalesce(F.sum(F.when((F.col("line_d") < block) & ~own, F.col("w"))), F.lit(0)).alias("blockers"),
        (F.bit_count(F.bit_or(bits)) / 11.0).alias("followed"))
    return links.join(agg, [*keys, *PAIR], "left").fillna({"blockers": 0, "followed": 0.0})


def without_points_between(links: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS, gap: float = 1.0,
                           lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Links with no other point closer than ``gap`` strictly inside their run (ratio in lo..hi)."""
    hit = rows_near_links(links, points, gap, keys).where((F.col("line_d") < gap) & (F.col("ratio") > lo) & (F.col("ratio") < hi))
    # the ends themselves have ratio 0 or 1, so a hit is always another place
    return links.join(hit.select(*keys, *PAIR).distinct(), [*keys, *PAIR], "left_anti")


def points_between(links: DataFrame, points: DataFrame, radius: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Links with a point within ``radius`` of them that is not in the 1 m box of an end."""
    own = same_box("x", "y", "x1", "y1") | same_box("x", "y", "x2", "y2")
    hit = rows_near_links(links, points, radius, keys).where(~own)
    return links.join(hit.select(*keys, *PAIR).distinct(), [*keys, *PAIR], "left_semi")


def network_links(points: DataFrame, roads: DataFrame, lo: float = 15.0, hi: float = 300.0, end_cap: float = 50.0,
                  share: float = 0.4, keys: Sequence[str] = KEYS) -> DataFrame:
    """Links in range whose ends are near a road and whose samples mostly lie on widened roads."""
    near = road_gap(points, roads, end_cap, keys).where("gap is not null").drop("gap")
    links = cut(pairs_within(near, lo, hi, keys=keys))
    iv = link_intervals(links, roads, {"b15": SAMPLED}, keys)
    return with_share(links, sampled_share(iv, "b15", keys=keys), "cover", keys).where(F.col("cover") >= share)


def visual_links(points: DataFrame, roads: DataFrame, skel: DataFrame, lo: float = 15.0, hi: float = 300.0,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Links in range that pass the road (20 m band, 0.6), blocker (at most 3) and skeleton (0.7) tests."""
    links = pairs_within(points, lo, hi, keys=keys)
    iv = link_intervals(links, roads, {"b20": 20.0}, keys)
    held = cut(with_share(links, union_share(iv, "b20", keys), "cover", keys).where(F.col("cover") >= 0.6))
    return skeleton_tests(held, skel, keys).where((F.col("blockers") <= 3) & (F.col("followed") >= 0.7))


def visibility_score(links: DataFrame, lo: float = 15.0, hi: float = 300.0) -> Column:
    """0.2 distance + 0.3 road + 0.3 clear + 0.2 skeleton, from union20, blockers and followed."""
    near = F.greatest(F.lit(0.0), 1 - (F.col("d") - lo) / (hi - lo))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    return (near * 0.2 + yes(F.col("union20") >= 0.6) * 0.3 + yes(F.col("blockers") <= 3) * 0.3
            + yes(F.col("followed") >= 0.7) * 0.2)


def road_links(points: DataFrame, roads: DataFrame, lo: float, hi: float, keys: Sequence[str] = KEYS,
               band: float = 3.0, share: float = 0.8) -> DataFrame:
    """Links mostly inside one widened road, with no other point between their ends."""
    links = pairs_within(points, lo, hi, keys=keys)
    iv = link_intervals(links, roads, {"b": band}, keys)
    # a road outside the join gives no share, so an inner join is enough
    held = links.join(best_share(iv, "b", keys).where(F.col("share") >= share), [*keys, *PAIR])
    return without_points_between(cut(held), points, keys)


def sight_links(points: DataFrame, roads: DataFrame, hi: float = 200.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs that see each other: closer than 0.1, or joined by a line wholly on the roads."""
    links = pairs_within(points, 0.0, hi, keys=keys)
    iv = link_intervals(links, roads, {"b0": 0.0}, keys)
    return with_share(links, union_share(iv, "b0", keys), "cover", keys).where((F.col("d") < 0.1) | (F.col("cover") >= 1 - 1e-9))


def both_ways(links: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, ord, other, d): every link from both of its ends."""
    return links.select(*keys, F.col("ord1").alias("ord"), F.col("ord2").alias("other"), "d").unionByName(
        links.select(*keys, F.col("ord2").alias("ord"), F.col("ord1").alias("other"), "d"))


def visible_counts(points: DataFrame, sight: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus ``visible`` (how many others) and ``visible_share`` of the layer's other points."""
    n = both_ways(sight, keys).groupBy(*keys, "ord").agg(F.count(F.lit(1)).alias("visible"))
    total = points.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_others"))
    return (points.join(n, [*keys, "ord"], "left").join(total, list(keys))
            .withColumn("visible", F.coalesce("visible", F.lit(0)))
            .withColumn("visible_share", F.coalesce(F.col("visible") / F.nullif("_others", F.lit(0)), F.lit(1.0)))
            .drop("_others"))


def merge_links(net: DataFrame, vis: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Union of both link sets with the flags has_network and has_visual."""
    cols = ["x1", "y1", "x2", "y2", "category1", "category2", "d"]
    a = net.select(*keys, *PAIR, F.struct(*cols).alias("a"))
    b = vis.select(*keys, *PAIR, F.struct(*cols).alias("b"))
    one = F.coalesce("a", "b")
    return (a.join(b, [*keys, *PAIR], "full_outer")
            .select(*keys, *PAIR, one.alias("o"), F.col("a").isNotNull().alias("has_network"), F.col("b").isNotNull().alias("has_visual"))
            .select(*keys, *PAIR, *[F.col(f"o.{c}").alias(c) for c in cols], "has_network", "has_visual"))


def isolated_points(points: DataFrame, roads: DataFrame, radius: float = 50.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Points on a road with no other point within ``radius``."""
    n = around(points, points, radius, {"_n": F.sum("r_w")}, keys)
    return on_road(n.where("_n = 1").drop("_n"), roads, keys).where("on_road").drop("on_road")


def split_edges(lines: DataFrame) -> DataFrame:
    """Consecutive vertices of each line as segments, from an array of (x, y) structs."""
    return (lines.withColumn("_e", F.explode(F.arrays_zip(
        F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b"))))
        .withColumns({"x1": F.col("_e.a.x"), "y1": F.col("_e.a.y"), "x2": F.col("_e.b.x"), "y2": F.col("_e.b.y")}).drop("_e"))


def skeleton_band(skel: DataFrame, half_width: float = 15.0, min_step: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Road band along the skeleton order: steps longer than ``min_step``, with a half width."""
    from roadpoints.operators.sequence import neighbours, with_position
    s = neighbours(with_position(skel, keys), keys=keys)
    step = dist("x", "y", "n1_x", "n1_y")
    return s.where(step > min_step).select(*keys, F.col("pos").alias("road_id"), F.col("x").alias("x1"), F.col("y").alias("y1"),
                                           F.col("n1_x").alias("x2"), F.col("n1_y").alias("y2"), F.lit(half_width).alias("half_width"))
