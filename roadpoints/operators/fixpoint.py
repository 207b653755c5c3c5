"""Iterative operators: components, clusters, greedy spacing, shortest paths.

Every loop ends at a fixpoint and raises if it meets its round limit, so a result is
either whole or an error. Each round's tables are written by ``cut``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from roadpoints.functions.geom import dist
from roadpoints.operators.celljoin import KEYS, cell, near_join, spread
from roadpoints.operators.cuts import cut, cut_counting, sieved, unfolded, united


def _stop(name: str, limit: int):
    raise RuntimeError(f"{name}: no fixpoint after {limit} rounds")


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, limit: int = 60) -> DataFrame:
    """(keys, node, component): the component is named by its smallest node.

    ``nodes`` has a column node, ``edges`` has u and v. Each round hooks every node to
    its neighbour of smallest hash, follows the hooks to their roots by pointer
    doubling, and contracts the edges; live edges shrink geometrically.
    """
    k = list(keys)
    live, left = cut_counting(edges.where("u <> v").select(*k, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps = []
    while left:
        if len(maps) == limit:
            _stop("components", limit)
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = live.unionByName(live.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut(both.groupBy(*k, "u").agg(F.min(rank("v")).alias("m"))
                   .select(*k, "u", F.least(F.col("m"), rank("u"))["n"].alias("to")))

        def follow(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.join(b.select(*k, F.col("u").alias("to"), F.col("to").alias("top")), [*k, "to"]).select(*k, "u", F.col("top").alias("to"))

        # hooks lead to ever smaller hashes, so the chains are short; four steps per pass, until all end at a root
        roots, moving = hook, 1
        while moving:
            twice = follow(roots, roots)
            ends = hook.select(*k, F.col("u").alias("to"), (F.col("to") != F.col("u")).alias("on"))
            roots, moving = cut_counting(follow(twice, twice).join(ends, [*k, "to"]), F.sum(F.col("on").cast("int")))
            roots = roots.select(*k, "u", "to")
        maps.append(roots)
        a = roots.select(*k, "u", F.col("to").alias("ru"))
        b = roots.select(*k, F.col("u").alias("v"), F.col("to").alias("rv"))
        live, left = cut_counting(live.join(a, [*k, "u"]).join(b, [*k, "v"]).where("ru <> rv")
                                  .select(*k, F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
    root = nodes.select(*k, "node", F.col("node").alias("root"))
    for m in maps:
        root = root.join(m.select(*k, F.col("u").alias("root"), "to"), [*k, "root"], "left").select(*k, "node", F.coalesce("to", "root").alias("root"))
    root = cut(root)
    name = root.groupBy(*k, "root").agg(F.min("node").alias("component"))
    return root.join(name, [*k, "root"]).select(*k, "node", "component")


def _half(reach: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (j, i) > (0, 0)]


def cluster(points: DataFrame, eps: float, keys: Sequence[str] = KEYS, min_size: int = 1) -> DataFrame:
    """Density clusters for min_samples 1 or 2: ``points`` plus ``cluster`` (its smallest ord).

    With these sizes they equal the components of the d <= eps graph. That graph is
    never listed: points in one cell of edge eps/1.5 always belong together, so cells
    are the nodes. Neighbour cells are linked at once if any of their outermost points
    are close; only pairs that stay open are tested point by point.
    """
    k, edge = list(keys), eps / 1.5
    home = points.withColumns({"mx": cell("x", edge), "my": cell("y", edge)})
    xy = F.struct("x", "y")
    cells = home.groupBy(*k, "mx", "my").agg(
        F.min("ord").alias("node"),
        F.array_distinct(F.array(F.min_by(xy, F.struct("x", "y")), F.max_by(xy, F.struct("x", "y")),
                                 F.min_by(xy, F.struct("y", "x")), F.max_by(xy, F.struct("y", "x")))).alias("rim"))
    cells = cut(cells)
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _half(2)])
    left = cells.select(*k, "mx", "my", F.col("node").alias("u"), F.col("rim").alias("a"))
    right = unfolded(cells.withColumn("o", F.explode(half))
                     .select(*k, (F.col("mx") - F.col("o.i")).alias("mx"), (F.col("my") - F.col("o.j")).alias("my"),
                             F.col("node").alias("v"), F.col("rim").alias("b"), F.col("mx").alias("vx"), F.col("my").alias("vy")))
    close = F.exists("a", lambda p: F.exists("b", lambda q: dist(p["x"], p["y"], q["x"], q["y"]) <= eps))
    pair = cut(left.join(right, [*k, "mx", "my"])
               .withColumn("close", close)
               .withColumn("open", ~F.col("close") & ((F.size("a") > 1) | (F.size("b") > 1)))
               .where("close or open").select(*k, "mx", "my", "vx", "vy", "u", "v", "open"))
    sure = pair.where("not open").select(*k, "u", "v")
    spots = home.select(*k, "mx", "my", "x", "y").distinct()
    other = spots.select(*k, F.col("mx").alias("vx"), F.col("my").alias("vy"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    late = (pair.where("open").join(spots, [*k, "mx", "my"]).join(other, [*k, "vx", "vy"])
            .where(dist("x", "y", "x2", "y2") <= eps).select(*k, "u", "v").distinct())
    comp = components(cells.select(*k, "node"), sure.unionByName(late), keys)
    label = cells.join(comp, [*k, "node"]).select(*k, "mx", "my", F.col("component").alias("cluster"))
    out = home.join(label, [*k, "mx", "my"]).drop("mx", "my")
    if min_size > 1:
        big = out.groupBy(*k, "cluster").count().where(F.col("count") >= min_size).drop("count")
        out = out.join(big, [*k, "cluster"], "left_semi")
    return out


def spaced(points: DataFrame, gap: float, keys: Sequence[str] = KEYS, order: Sequence[Column] | None = None,
           closed: bool = False, limit: int = 500) -> DataFrame:
    """Greedy minimum spacing: walk the rows in order, keep a row when no kept row is near.

    Near means d < gap, or d <= gap with ``closed``. The order is ord unless given.
    Rounds: the first open row of a cell of edge gap/1.5 is kept once no earlier open row
    is near it; kept rows then close all rows near them. A cell holds at most one kept row,
    so both joins stay linear in the rows; no pair list is made. Of equal coordinates only
    the first can be kept, so copies are folded before the first round.
    """
    k, edge = list(keys), gap / 1.5
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*(order or []), F.col("ord")])])
    near = lambda d: d <= gap if closed else d < gap
    live = (points.withColumn("_r", rank).groupBy(*k, "x", "y").agg(F.min("_r").alias("r"))
            .withColumns({"mx": cell("x", edge), "my": cell("y", edge)}))
    live, kept = cut(live), []
    around = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])

    def fan(df: DataFrame) -> DataFrame:
        return unfolded(df.withColumn("o", F.explode(offsets))
                        .select(*k, (F.col("mx") + F.col("o.i")).alias("mx"), (F.col("my") + F.col("o.j")).alias("my"),
                                F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("r").alias("fr")))

    for _ in range(limit):
        first = live.groupBy(*k, "mx", "my").agg(F.min(F.struct("r", "x", "y")).alias("f")).select(
            *k, "mx", "my", "f.r", "f.x", "f.y")
        seen = live.join(fan(first), [*k, "mx", "my"])
        blocked = (seen.where((F.col("r") < F.col("fr")) & near(dist("x", "y", "fx", "fy")))
                   .select(*k, F.col("fx").alias("x"), F.col("fy").alias("y")).distinct())
        new = cut(first.join(blocked, [*k, "x", "y"], "left_anti"))
        kept.append(new.select(*k, "x", "y", "r"))
        closers = fan(new).drop("fr")
        a, b = live.alias("a"), closers.alias("b")
        cond = near(dist("a.x", "a.y", "b.fx", "b.fy"))
        for c in (*k, "mx", "my"):
            cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        live, left = cut_counting(a.join(b, cond, "left_anti"))
        if not left:
            break
    else:
        _stop("spaced", limit)
    chosen = united(kept).select(*k, F.col(f"r.o{len(order or [])}").alias("ord"))
    return sieved(points, chosen, [*k, "ord"], "left_semi")


def leaders(points: DataFrame, radius: float, keys: Sequence[str] = KEYS,
            order: Sequence[Column] | None = None, strict: bool = False) -> DataFrame:
    """Leader clusters: ``points`` plus ``leader`` (ord of the first kept row that reaches it)."""
    heads = cut(spaced(points, radius, keys, order, closed=not strict))
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*(order or []), F.col("ord")])])
    ranked = heads.select(*keys, "x", "y", rank.alias("rank"))
    spots = points.select(*keys, "x", "y").distinct()
    owner = (near_join(spots, ranked, radius, keys, strict=strict).groupBy(*keys, "x", "y")
             .agg(F.min("r_rank").alias("_o")))
    return (points.join(owner, [*keys, "x", "y"])
            .withColumn("leader", F.col(f"_o.o{len(order or [])}")).drop("_o"))


def thin_pairs(points: DataFrame, radius: float, keys: Sequence[str] = KEYS, later_only: bool = False,
               limit: int = 2000) -> DataFrame:
    """Pairwise thinning: in order, each unused row removes its nearest unused row within
    ``radius``; both are then used. Returns the rows left.

    A row may act when no earlier open row lies within two radii, since only such a row
    could change what it sees. Rows with no open row near them are done.
    """
    k, edge = list(keys), 2 * radius / 1.5
    cols = [*k, "ord", "x", "y"]
    near_any = near_join(points.select(*cols), points.select(*cols), radius, keys).where("ord <> r_ord")
    open_, left = cut_counting(near_any.select(*cols).distinct().withColumns({"mx": cell("x", edge), "my": cell("y", edge)}))
    gone = []
    for _ in range(limit):
        if not left:
            break
        first = open_.groupBy(*k, "mx", "my").agg(F.min(F.struct("ord", "x", "y")).alias("f")).select(*k, "f.ord", "f.x", "f.y")
        fan = spread(first, edge, reach=2).select(*k, F.col("cx").alias("mx"), F.col("cy").alias("my"),
                                                  F.col("ord").alias("fo"), F.col("x").alias("fx"), F.col("y").alias("fy"))
        blocked = (open_.join(fan, [*k, "mx", "my"])
                   .where((F.col("ord") < F.col("fo")) & (dist("x", "y", "fx", "fy") <= 2 * radius))
                   .select(*k, F.col("fo").alias("ord")).distinct())
        actors = first.join(blocked, [*k, "ord"], "left_anti")
        seen = near_join(open_.select(*cols), actors, radius, keys)
        seen = seen.where("ord > r_ord" if later_only else "ord <> r_ord")
        taken = seen.groupBy(*k, "r_ord").agg(F.min(F.struct("d", "ord"))["ord"].alias("ord"))
        acts = cut(actors.select(*k, F.col("ord").alias("actor")).join(
            taken.select(*k, F.col("r_ord").alias("actor"), "ord"), [*k, "actor"], "left"))
        gone.append(acts.where("ord is not null").select(*k, "ord"))
        used = united([acts.select(*k, F.col("actor").alias("ord")), gone[-1]])
        rest = open_.join(used, [*k, "ord"], "left_anti")
        open_, left = cut_counting(rest)
    else:
        _stop("thin_pairs", limit)
    if not gone:
        return points
    return sieved(points, united(gone), [*k, "ord"], "left_anti")


def shortest_paths(edges: DataFrame, sources: DataFrame, bound: float | None = None, weight: str = "w",
                   keys: Sequence[str] = KEYS, limit: int = 5000) -> DataFrame:
    """(keys, source, node, dist, prev, hops) by frontier relaxation from all sources at once.

    ``edges`` has u, v and a weight and is used both ways; ``sources`` has source.
    Only rows that improved go on to the next round. Equal lengths keep the smaller
    predecessor. Distances above ``bound`` are not followed.
    """
    k = list(keys)
    both = cut(edges.select(*k, "u", "v", F.col(weight).alias("w"))
               .unionByName(edges.select(*k, F.col("v").alias("u"), F.col("u").alias("v"), F.col(weight).alias("w")))
               .groupBy(*k, "u", "v").agg(F.min("w").alias("w")))
    best = cut(sources.select(*k, "source", F.col("source").alias("node"), F.lit(0.0).alias("dist"),
                              F.lit(None).cast("long").alias("prev"), F.lit(0).alias("hops")).distinct())
    front = best
    for _ in range(limit):
        step = (front.join(both, (F.col("node") == F.col("u")) & _same(front, both, k), "inner")
                .select(*[front[c] for c in k], "source", F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"),
                        F.col("u").alias("prev"), (F.col("hops") + 1).alias("hops")))
        if bound is not None:
            step = step.where(F.col("dist") <= bound)
        step = step.groupBy(*k, "source", "node").agg(F.min(F.struct("dist", "prev", "hops")).alias("c"))
        old = best.select(*k, "source", "node", F.struct("dist", "prev", "hops").alias("o"))
        front, left = cut_counting(step.join(old, [*k, "source", "node"], "left")
                    .where("o is null or c.dist < o.dist or (c.dist = o.dist and c.prev < o.prev)")
                    .select(*k, "source", "node", "c.dist", "c.prev", "c.hops"))
        if not left:
            break
        best = cut(best.join(front, [*k, "source", "node"], "left_anti").unionByName(front))
    else:
        _stop("shortest_paths", limit)
    return best


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda p, q: p & q, [a[c] == b[c] for c in keys])
