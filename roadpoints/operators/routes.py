"""Links judged by the way along the skeleton: index paths, detours, chains of sites.

No path is listed to judge it. Along an order, what a path holds is the difference of two running sums; on a graph, a search ends where
its pair's bound can no longer be kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadpoints.functions.geom import dist, same_box, seg_dist
from roadpoints.operators.celljoin import KEYS, near_join, nearest, pairs_within, segment_cells, with_cell
from roadpoints.operators.graph import radius_edges
from roadpoints.operators.links import EDGE, PAIR, link_intervals, union_share, with_share
from roadpoints.operators.sequence import BLOCK, neighbours, with_position
from roadpoints.operators.cuts import cut, cut_counting

#: lengths are summed in whole micrometres, so that sums do not depend on their order
MICRO = 1_000_000


def running_sums(df: DataFrame, cols: dict[str, Column], keys: Sequence[str] = KEYS, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Add a column per entry of ``cols``: the sum over all earlier rows by ``pos``, this row left out. Sums run over blocks of positions; the
    blocks' own sums run over the small table of blocks."""
    k = list(keys)
    tagged = df.withColumns({**{f"_v_{n}": c for n, c in cols.items()}, "_b": F.floor(F.col(pos) / block)})
    total = tagged.groupBy(*k, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in cols])
    before = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = total.select(*k, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in cols])
    w = Window.partitionBy(*k, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(start, [*k, "_b"]).withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)) + F.col(f"_s_{n}") for n in cols})
    return out.drop("_b", *[f"_{a}_{n}" for a in "vs" for n in cols])


def skeleton_steps(skel: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(vertices with their dense position ``pos``, steps pos to pos + 1 as links with d)."""
    at = cut(with_position(skel.select(*keys, "ord", "x", "y"), keys))
    step = neighbours(at, keys=keys).where("n1_x is not null")
    step = step.select(*keys, F.col("pos").alias("ord1"), (F.col("pos") + 1).alias("ord2"), F.col("x").alias("x1"), F.col("y").alias("y1"),
                       F.col("n1_x").alias("x2"), F.col("n1_y").alias("y2"), dist("x", "y", "n1_x", "n1_y").alias("d"))
    return at, cut(step)


def index_paths(points: DataFrame, skel: DataFrame, roads: DataFrame, lo: float = 15.0, hi: float = 300.0, cap: float = 50.0, near: float = 10.0,
                tight: float = 0.5, wide: float = 20.0, share: float = 0.8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs lo to hi apart that are linked by the skeleton's own order: ord1, ord2, d, path_length, cover, off_steps.

    The path of a pair runs along the skeleton's order from the vertex nearest to one point to that nearest to the other; points farther than ``cap``
    from the skeleton, and pairs with one vertex, have none. A pair is linked if

    * the path lies wholly on the roads widened by ``tight`` (off_steps is 0), or at least ``share`` of it (cover) on the roads widened by ``wide``;
    * no other point is within ``near`` of the path. Points in the 1 m box of an end do not count.

    Both are differences of sums that run along the order: covered length, steps off the road, and places within reach of a step. The ends' own
    places are few and taken off one by one. Points of equal coordinates are one place.
    """
    k = list(keys)
    at, steps = skeleton_steps(skel, keys)
    iv = cut(link_intervals(steps, roads, {"tight": tight, "wide": wide}, keys))
    judged = with_share(with_share(steps, union_share(iv, "tight", keys), "in_tight", keys), union_share(iv, "wide", keys), "in_wide", keys)
    # (place, step) within reach; a place is named by its coordinates
    spots = points.select(*k, "x", "y").distinct()
    edge = max(near, EDGE)
    met = (with_cell(spots, edge).join(segment_cells(steps, edge, near), [*k, "cx", "cy"])
           .where(seg_dist("x", "y", "x1", "y1", "x2", "y2") <= near).select(*k, "x", "y", F.col("ord1").alias("pos")))
    met = cut(met.distinct())
    busy = met.groupBy(*k, "pos").agg(F.count(F.lit(1)).alias("places"))
    size = lambda c: F.round(c * MICRO).cast("long")
    row = (at.join(judged.select(*k, F.col("ord1").alias("pos"), "d", "in_tight", "in_wide"), [*k, "pos"], "left").join(busy, [*k, "pos"], "left")
           .fillna({"d": 0.0, "in_tight": 1.0, "in_wide": 0.0, "places": 0}))
    off = ((F.col("in_tight") < 1 - 1e-9) & (F.col("d") > 0)).cast("long")
    sums = running_sums(row, {"length": size(F.col("d")), "covered": size(F.col("d") * F.col("in_wide")), "off": off, "met": F.col("places")}, keys)
    sums = cut(sums.select(*k, "pos", "length", "covered", "off", "met"))

    heads = at.select(*k, F.col("pos").alias("ord"), "x", "y")
    on = nearest(points, heads, cap, keys).where("near_ord is not null").withColumnRenamed("near_ord", "pos")
    pairs = pairs_within(on, lo, hi, ["x", "y", "pos"], keys).where("pos1 <> pos2")
    pairs = pairs.withColumns({"a": F.least("pos1", "pos2"), "b": F.greatest("pos1", "pos2")}).select(*k, *PAIR, "x1", "y1", "x2", "y2", "d", "a", "b")
    for end in "ab":
        pairs = pairs.join(sums.select(*k, F.col("pos").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("length", "covered", "off", "met")]), [*k, end])
    over = lambda c: F.col(f"{c}_b") - F.col(f"{c}_a")
    good = pairs.withColumns({"path": over("length"), "cover": over("covered") / F.nullif(over("length"), F.lit(0)), "off_steps": over("off"), "hits": over("met")})
    good = cut(good.where((F.col("off_steps") == 0) | (F.col("cover") >= share)).select(*k, *PAIR, "x1", "y1", "x2", "y2", "d", "a", "b", "path", "cover", "off_steps", "hits"))
    # hits of places in the box of an end: box neighbours of each end, and their steps on the path
    ends = good.select(*k, F.col("x1").alias("x"), F.col("y1").alias("y")).union(good.select(*k, "x2", "y2")).distinct()
    boxes = near_join(ends, spots, 1.5, keys).where(same_box("x", "y", "r_x", "r_y")).select(*k, "x", "y", "r_x", "r_y")
    steps_of = cut(boxes.join(met.select(*k, F.col("x").alias("r_x"), F.col("y").alias("r_y"), "pos"), [*k, "r_x", "r_y"]))
    each = [good.select(*k, *PAIR, "a", "b", F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")).join(steps_of, [*k, "x", "y"])
            .where("pos >= a and pos < b").select(*k, *PAIR, "r_x", "r_y", "pos") for i in (1, 2)]
    own = each[0].union(each[1]).distinct().groupBy(*k, *PAIR).agg(F.count(F.lit(1)).alias("own"))
    out = good.join(own, [*k, *PAIR], "left").where(F.col("hits") - F.coalesce("own", F.lit(0)) == 0)
    return out.select(*k, *PAIR, "d", (F.col("path") / float(MICRO)).alias("path_length"), "cover", "off_steps")


def shortcuts(edges: DataFrame, doublings: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """(u, v, w, hops, via), both ways: the shortest runs of up to 2 ** ``doublings`` edges between two vertices, with the vertices between them. A search over
    them needs so many times fewer rounds."""
    k = list(keys)
    both = edges.where("u <> v").select(*k, "u", "v", "w").unionByName(edges.where("u <> v").select(*k, F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    out = cut(both.groupBy(*k, "u", "v").agg(F.min("w").alias("w")).select("*", F.lit(1).alias("hops"), F.array().cast("array<long>").alias("via")))
    for _ in range(doublings):
        on = out.select(*k, F.col("u").alias("m"), "v", F.col("w").alias("w2"), F.col("hops").alias("h2"), F.col("via").alias("via2"))
        longer = (out.withColumnRenamed("v", "m").join(on, [*k, "m"]).where("u <> v")
                  .select(*k, "u", "v", (F.col("w") + F.col("w2")).alias("w"), (F.col("hops") + F.col("h2")).alias("hops"), F.concat("via", F.array("m"), "via2").alias("via")))
        least = out.unionByName(longer).groupBy(*k, "u", "v").agg(F.min(F.struct("w", "hops", "via")).alias("c"))
        out = cut(least.select(*k, "u", "v", "c.*"))
    return out


def _searched(nodes: DataFrame, short: DataFrame, goals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(source, node, dist, prev, hops): shortest ways over shortcuts, as far as a goal (x, y, most) of the source can still be met."""
    k, on = list(keys), [*keys, "source", "node"]
    ends = cut(short.join(nodes.select(*k, F.col("ord").alias("v"), "x", "y"), [*k, "v"]).select(*k, F.col("u").alias("node"), "v", "x", "y", "w", F.col("hops").alias("h")))
    best = cut(goals.select(*k, "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("prev"), F.lit(0).alias("hops")))
    front, left = best, 1
    rest = lambda g: F.col("dist") + dist("x", "y", g["x"], g["y"]) <= g["most"] + 1e-6
    while left:
        step = front.join(ends, [*k, "node"]).select(*k, "source", F.col("v").alias("node"), "x", "y", (F.col("dist") + F.col("w")).alias("dist"),
                                                     F.col("node").alias("prev"), (F.col("hops") + F.col("h")).alias("hops"))
        step = step.join(goals, [*k, "source"]).where(F.exists("goals", rest)).groupBy(*on).agg(F.min(F.struct("dist", "prev", "hops")).alias("c"))
        old = best.select(*on, F.col("dist").alias("known"))
        front, left = cut_counting(step.join(old, on, "left").where("known is null or c.dist < known - 1e-9").select(*on, "c.*"))
        if left:
            best = cut(best.join(front, on, "left_anti").unionByName(front))
    return best


def detour_links(points: DataFrame, skel: DataFrame, roads: DataFrame, lo: float = 15.0, hi: float = 300.0, cap: float = 25.0, reach: float = 20.0,
                 detour: float = 2.0, share: float = 0.5, near: float = 20.0, free: float = 30.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs lo to hi apart whose shortest way along the skeleton is no more than ``detour`` times their distance: ord1, ord2, d, path_length, cover.

    Vertices of the skeleton within ``reach`` of each other are joined. A point starts from the nearest vertex closer than ``cap``. At least ``share`` of
    the straight link lies on the roads, and no other point farther than ``free`` from both ends is closer than ``near`` to the way, unless that has two
    vertices or one. Of ways of equal length one is taken, the same whatever the partitioning.

    The road test comes first, since it needs no way. Ways are then searched from all starts at once; a row of the search stays only while a target of its
    start can still be met: way so far plus straight rest within the pair's own bound.
    """
    k = list(keys)
    nodes = cut(skel.select(*k, "ord", "x", "y"))
    on = nearest(points, nodes, cap, keys, strict=True).where("near_ord is not null").withColumnRenamed("near_ord", "node")
    pairs = cut(pairs_within(on, lo, hi, ["x", "y", "node"], keys))
    iv = link_intervals(pairs, roads, {"road": 0.0}, keys)
    held = cut(with_share(pairs, union_share(iv, "road", keys), "cover", keys).where(F.col("cover") >= share))
    here = lambda name, *cols: nodes.select(*k, F.col("ord").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in cols])
    goals = held.where("node1 <> node2").groupBy(*k, F.col("node1").alias("source"), F.col("node2").alias("target")).agg(F.max(F.col("d") * detour).alias("most"))
    goals = goals.join(here("target", "x", "y"), [*k, "target"])
    # as many targets as vertices within reach of the start: bounded by the skeleton's density, not by the points
    goals = cut(goals.groupBy(*k, "source").agg(F.collect_list(F.struct(F.col("target_x").alias("x"), F.col("target_y").alias("y"), "most")).alias("goals")))

    short = shortcuts(radius_edges(nodes, reach, keys), keys=keys)
    best = _searched(nodes, short, goals, keys)
    ways = best.select(*k, F.col("source").alias("node1"), F.col("node").alias("node2"), "dist", "hops")
    same = F.col("node1") == F.col("node2")
    linked = held.join(ways, [*k, "node1", "node2"], "left").withColumn("path_length", F.when(same, F.lit(0.0)).otherwise(F.col("dist")))
    linked = cut(linked.where((F.col("path_length") <= detour * F.col("d")) & F.col("path_length").isNotNull()))
    # back along the ways that are left, all at once; a shortcut gives its inner vertices
    front, left = cut_counting(linked.where("hops > 1").select(*k, F.col("node1").alias("source"), F.col("node2").alias("end"), F.col("node2").alias("node")).distinct())
    prev, trail = best.select(*k, "source", "node", "prev"), []
    inner = short.select(*k, F.col("u").alias("prev"), F.col("v").alias("node"), "via")
    while left:
        hop = cut(front.join(prev, [*k, "source", "node"]).join(inner, [*k, "prev", "node"]).select(*k, "source", "end", "node", "prev", "via"))
        trail.append(hop)
        front, left = cut_counting(hop.where("prev <> source").select(*k, "source", "end", F.col("prev").alias("node")))
    if trail:
        way = trail[0]
        for t in trail[1:]:
            way = way.unionByName(t)
        run = F.concat(F.array("prev"), "via", F.array("node"))
        way = way.select(*k, F.col("source").alias("node1"), F.col("end").alias("node2"), F.explode(F.arrays_zip(F.slice(run, 1, F.size(run) - 1).alias("p"), F.slice(run, 2, F.size(run) - 1).alias("q"))).alias("e"))
        way = cut(way.select(*k, "node1", "node2", F.least("e.p", "e.q").alias("u"), F.greatest("e.p", "e.q").alias("v")))
        used = way.select(*k, "u", "v").distinct().join(here("u", "x", "y"), [*k, "u"]).join(here("v", "x", "y"), [*k, "v"])
        cells = segment_cells(used, max(near, EDGE), near, ("u_x", "u_y", "v_x", "v_y"))
        spots = with_cell(points.select(*k, "x", "y").distinct(), max(near, EDGE))
        beside = spots.join(cells, [*k, "cx", "cy"]).where(seg_dist("x", "y", "u_x", "u_y", "v_x", "v_y") < near).select(*k, "u", "v", "x", "y").distinct()
        between = (linked.where("hops > 1").join(way, [*k, "node1", "node2"]).join(beside, [*k, "u", "v"])
                   .where((dist("x", "y", "x1", "y1") > free) & (dist("x", "y", "x2", "y2") > free)).select(*k, *PAIR).distinct())
        linked = linked.join(between, [*k, *PAIR], "left_anti")
    return linked.select(*k, *PAIR, "d", "path_length", "cover")
