"""Road graphs: edges, degrees, segments between junctions, paths, chains and connection verdicts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadpoints.functions.geom import crossing, dist, turn_angle
from roadpoints.operators.celljoin import KEYS, around, near_join, nearest, pairs_within, segment_cells
from roadpoints.operators.fixpoint import components, shortest_paths
from roadpoints.operators.links import nearest_segment
from roadpoints.operators.select import chain_next
from roadpoints.operators.sequence import framed, with_position
from roadpoints.operators.cuts import cut, cut_counting, united


def radius_edges(points: DataFrame, radius: float, keys: Sequence[str] = KEYS, strict: bool = False) -> DataFrame:
    return pairs_within(points, 0.0, radius, ["x", "y"], keys, strict=strict).select(*keys, F.col("ord1").alias("u"), F.col("ord2").alias("v"), F.col("d").alias("w"))


def order_edges(points: DataFrame, ahead: int = 9, radius: float = 20.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges to the next ``ahead`` rows by order that are closer than ``radius``."""
    def build(w):
        return {"_on": F.array(*[F.struct(F.lead("ord", i).over(w).alias("v"), F.lead("x", i).over(w).alias("x2"), F.lead("y", i).over(w).alias("y2")) for i in range(1, ahead + 1)])}
    s = framed(with_position(points, keys), build, 0, ahead, keys)
    return (s.withColumn("e", F.explode("_on")).where("e.v is not null").withColumn("w", dist("x", "y", "e.x2", "e.y2"))
            .where(F.col("w") < radius).select(*keys, F.col("ord").alias("u"), F.col("e.v").alias("v"), "w"))


def degrees(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``nodes`` plus degree and role."""
    ends = edges.select(*keys, F.col("u").alias("ord")).unionByName(edges.select(*keys, F.col("v").alias("ord")))
    d = ends.groupBy(*keys, "ord").agg(F.count(F.lit(1)).alias("degree"))
    out = nodes.join(d, [*keys, "ord"], "left").fillna({"degree": 0})
    return out.withColumn("role", F.when(F.col("degree") == 0, "isolated").when(F.col("degree") == 1, "end").when(F.col("degree") == 2, "middle").otherwise("branch"))


def line_crossings(lines: DataFrame, keys: Sequence[str] = KEYS, line_id: str = "road_id", edge: float = 200.0) -> DataFrame:
    """Crossing points of segments of different lines: line1 < line2, x, y."""
    cells = segment_cells(lines.select(*keys, F.col(line_id).alias("line"), "x1", "y1", "x2", "y2"), edge, 1e-6)
    b = cells.select(*keys, "cx", "cy", F.col("line").alias("line2"), F.col("x1").alias("cx1"), F.col("y1").alias("cy1"), F.col("x2").alias("cx2"), F.col("y2").alias("cy2"))
    x, y = crossing("x1", "y1", "x2", "y2", "cx1", "cy1", "cx2", "cy2")
    hit = cells.join(b, [*keys, "cx", "cy"]).where("line < line2").withColumns({"x": x, "y": y})
    return hit.select(*keys, F.col("line").alias("line1"), "line2", "x", "y").distinct().where("x is not null")


LINE_IDS = 1 << 31


def node_id(line1: str = "line1", line2: str = "line2") -> Column:
    """One number for a pair of line ids, different for different pairs; ids must be 0 or more and below 2**31."""
    a, b = F.col(line1).cast("long"), F.col(line2).cast("long")
    fits = (a >= 0) & (b >= 0) & (a < LINE_IDS) & (b < LINE_IDS)
    return F.when(fits, a * LINE_IDS + b).otherwise(F.raise_error(F.lit("line ids must be below 2**31: number the lines first")).cast("long"))


def network_edges(lines: DataFrame, cross: DataFrame, keys: Sequence[str] = KEYS, line_id: str = "road_id") -> DataFrame:
    """Edges between crossings that follow each other along a line; a crossing is named by node_id."""
    node = cross.withColumn("ord", node_id())
    on = node.select(*keys, F.col("line1").alias(line_id), "ord", "x", "y").unionByName(node.select(*keys, F.col("line2").alias(line_id), "ord", "x", "y"))
    at = on.join(lines.select(*keys, line_id, "x1", "y1"), [*keys, line_id]).withColumn("m", dist("x", "y", "x1", "y1"))
    nx = chain_next(at, [*keys, line_id], "m", ["ord", "m"]).where("n_ord is not null")
    return nx.select(*keys, F.col("ord").alias("u"), F.col("n_ord").alias("v"), (F.col("n_m") - F.col("m")).alias("w"))


def segments(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges plus ``seg``: the run between junctions (degree other than 2) that each belongs to.

    Runs are the components of edges that share a middle node, so no path is traced node by node.
    """
    k = list(keys)
    deg = degrees(nodes, edges, keys).select(*k, "ord", "degree")
    e = cut(edges.withColumn("eid", F.struct("u", "v")))  # a segment is named by its smallest edge, whatever the partitioning
    ends = e.select(*k, "eid", F.col("u").alias("ord")).unionByName(e.select(*k, "eid", F.col("v").alias("ord")))
    mid = ends.join(deg.where("degree = 2"), [*k, "ord"]).groupBy(*k, "ord").agg(F.min("eid").alias("u"), F.max("eid").alias("v"))
    comp = components(e.select(*k, F.col("eid").alias("node")), mid.select(*k, "u", "v"), keys)
    return cut(e.join(comp.select(*k, F.col("node").alias("eid"), F.col("component").alias("seg")), [*k, "eid"]))


def segment_table(nodes: DataFrame, segs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per segment: length, edges, its two end nodes and their degrees, main or branch.

    A closed ring without a junction has no ends.
    """
    k = list(keys)
    deg = degrees(nodes, segs, keys).select(*k, "ord", "degree")
    ends = segs.select(*k, "seg", F.col("u").alias("ord")).unionByName(segs.select(*k, "seg", F.col("v").alias("ord")))
    tip = (ends.groupBy(*k, "seg", "ord").agg(F.count(F.lit(1)).alias("n")).join(deg, [*k, "ord"])
           .where("n = 1 or degree <> 2").groupBy(*k, "seg").agg(F.min(F.struct("ord", "degree")).alias("a"), F.max(F.struct("ord", "degree")).alias("b")))
    size = segs.groupBy(*k, "seg").agg(F.sum("w").alias("length"), F.count(F.lit(1)).alias("edges"))
    t = size.join(tip, [*k, "seg"], "left").select(*k, "seg", "length", "edges", F.col("a.ord").alias("start"), F.col("b.ord").alias("end"),
                                                   F.coalesce("a.degree", F.lit(2)).alias("start_degree"), F.coalesce("b.degree", F.lit(2)).alias("end_degree"))
    s, e = F.col("start_degree"), F.col("end_degree")
    main = ((F.col("length") >= 100) & (s >= 3) & (e >= 3)) | ((F.col("length") >= 50) & (((s >= 3) & (e == 1)) | ((s == 1) & (e >= 3))))
    return t.withColumn("is_main", main)


def segment_vertices(nodes: DataFrame, segs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    ends = segs.select(*keys, "seg", F.col("u").alias("ord")).unionByName(segs.select(*keys, "seg", F.col("v").alias("ord"))).distinct()
    return ends.join(nodes.select(*keys, "ord", "x", "y"), [*keys, "ord"])


def point_context(points: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float = 100.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Topology of the surroundings of each point: branch_ratio, junction_density, junction_d, position_score,
    deletion_priority, main_near, branch_near, on_main, on_branch."""
    k = list(keys)
    nodes = cut(nodes.select(*k, "ord", "x", "y"))
    segs = segments(nodes, cut(edges), keys)
    table = cut(segment_table(nodes, segs, keys))
    deg = cut(degrees(nodes, edges, keys))
    vert = segment_vertices(nodes, segs, keys).join(table.select(*k, "seg", "length", "is_main"), [*k, "seg"])
    hit = near_join(points.select(*k, "ord", "x", "y"), vert.select(*k, "seg", "length", "is_main", "x", "y"), radius, keys)
    per = hit.groupBy(*k, "ord", "r_seg").agg(F.first("r_length").alias("length"), F.first("r_is_main").alias("main"), F.min("d").alias("d"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    main = F.col("main")
    local = per.groupBy(*k, "ord").agg(
        F.sum(F.when(~main, F.col("length")).otherwise(0.0)).alias("b"), F.sum("length").alias("t"),
        n(main & (F.col("d") <= 30)).alias("main_near"), n(~main & (F.col("d") <= 30)).alias("branch_near"),
        F.coalesce(F.bool_or(main & (F.col("d") < 10)), F.lit(False)).alias("on_main"), F.coalesce(F.bool_or(~main & (F.col("d") < 10)), F.lit(False)).alias("on_branch"))
    junction = deg.where("degree >= 3").select(*k, "ord", "x", "y")
    out = points.join(local, [*k, "ord"], "left").fillna({"main_near": 0, "branch_near": 0, "on_main": False, "on_branch": False})
    out = out.withColumn("branch_ratio", F.coalesce(F.col("b") / F.nullif("t", F.lit(0.0)), F.lit(0.5))).drop("b", "t")
    out = around(out, junction, radius, {"_j": F.sum("r_w")}, keys, default={"_j": 0})
    out = out.withColumn("junction_density", F.col("_j") / (math.pi * radius * radius)).drop("_j")
    out = nearest(cut(out), junction, keys=keys).withColumn("junction_d", F.coalesce("near_d", F.lit(1000.0))).drop("near_ord", "near_x", "near_y", "near_d")
    out = nearest(cut(out), deg.select(*k, "ord", "x", "y", "degree"), keys=keys, also=["degree"])
    score = F.when(F.col("near_degree") == 1, 1.0).when(F.col("near_degree") == 2, 0.5).otherwise(0.0)
    out = out.withColumn("position_score", score).drop("near_ord", "near_x", "near_y", "near_d", "near_degree")
    pr = (F.col("branch_ratio") * 0.3 + F.col("junction_density") * 1000 * 0.3 + 1.0 / (1.0 + F.col("junction_d") / 50) * 0.2 + F.col("position_score") * 0.2)
    return out.withColumn("deletion_priority", pr)


def topology_features() -> Column:
    """The eight-value vector over the columns of ``point_context``."""
    one = lambda c: F.least(c, F.lit(1.0))
    return F.array(F.col("branch_ratio"), F.col("junction_density") * 10000, one(F.col("junction_d") / 100), F.col("position_score"), one(F.col("deletion_priority")),
                   one(F.col("main_near") / 5.0), one(F.col("branch_near") / 5.0), F.col("on_branch").cast("double"))


def path_nodes(paths: DataFrame, targets: DataFrame, keys: Sequence[str] = KEYS, limit: int = 5000) -> DataFrame:
    """Nodes of the shortest paths from each source to each target: source, target, node, step (0 at the target).

    All targets walk back one predecessor per round; the frontier holds one row per open path.
    """
    k = list(keys)
    back = paths.select(*k, "source", "node", "prev")
    front = cut(targets.select(*k, "source", "target", F.col("target").alias("node"), F.lit(0).alias("step")).join(back, [*k, "source", "node"]))
    parts = []
    for i in range(limit):
        parts.append(front.select(*k, "source", "target", "node", "step"))
        front = cut(front.where("prev is not null").select(*k, "source", "target", F.col("prev").alias("node"), F.lit(i + 1).alias("step")).join(back, [*k, "source", "node"]))
        if front.isEmpty():
            break
    else:
        raise RuntimeError(f"path_nodes: longer than {limit} nodes")
    return united(parts)


def path_straightness(path: DataFrame, nodes: DataFrame, keys: Sequence[str] = KEYS, ratio: float = 0.85, turn: float = 30.0, strict: float = 0.92) -> DataFrame:
    """Chord / length and summed turn in degrees per path; straight, and straight by ratio alone at ``strict``.

    The window runs over one path, whose length the search bound limits.
    """
    p = path.join(nodes.select(*keys, F.col("ord").alias("node"), "x", "y"), [*keys, "node"])
    g = [*keys, "source", "target"]
    w = Window.partitionBy(*g).orderBy("step")
    p = p.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "nx": F.lead("x").over(w), "ny": F.lead("y").over(w)})
    v = F.struct("x", "y")
    s = p.groupBy(*g).agg(F.sum(dist("x", "y", "nx", "ny")).alias("length"), F.sum(F.degrees(turn_angle("px", "py", "x", "y", "nx", "ny"))).alias("turns"),
                          F.min_by(v, "step").alias("a"), F.max_by(v, "step").alias("b"))
    r = F.coalesce(dist("a.x", "a.y", "b.x", "b.y") / F.nullif(F.col("length"), F.lit(0.0)), F.lit(1.0))
    s = s.withColumns({"ratio": r, "turns": F.coalesce("turns", F.lit(0.0)), "length": F.coalesce("length", F.lit(0.0))}).drop("a", "b")
    return s.withColumns({"straight": (F.col("ratio") >= ratio) & (F.col("turns") <= turn), "straight_strict": F.col("ratio") >= strict})


def merge_straight_junctions(sites: DataFrame, nodes: DataFrame, edges: DataFrame, reach: float = 30.0, snap: float = 5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sites within ``reach`` of each other joined by a straight path are one group; the most important stays.

    Importance is roads * total branch length + 1000 * roads, from the segments at the site's node.
    """
    k = list(keys)
    at = cut(nearest(sites, nodes, cap=snap, keys=keys, strict=True).withColumnRenamed("near_ord", "node").drop("near_x", "near_y", "near_d"))
    pair = cut(pairs_within(at.where("node is not null"), 0.0, reach, ["x", "y", "node"], keys).where("node1 <> node2"))
    src = pair.select(*k, F.col("node1").alias("source")).distinct()
    paths = shortest_paths(edges, src, bound=reach * 2, keys=keys)
    want = pair.select(*k, F.col("node1").alias("source"), F.col("node2").alias("target")).distinct()
    line = path_straightness(path_nodes(paths, want, keys), nodes, keys).where("straight").select(*k, F.col("source").alias("node1"), F.col("target").alias("node2"))
    linked = pair.join(line, [*k, "node1", "node2"]).select(*k, F.col("ord1").alias("u"), F.col("ord2").alias("v"))
    group = components(sites.select(*k, F.col("ord").alias("node")), linked, keys).select(*k, F.col("node").alias("ord"), F.col("component").alias("grp"))
    score = junction_importance(nodes, edges, keys).select(*k, F.col("ord").alias("node"), "score")
    s = at.join(score, [*k, "node"], "left").fillna({"score": 0.0}).join(group, [*k, "ord"])
    best = s.groupBy(*k, "grp").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"))).alias("b")).select(*k, (-F.col("b.o")).alias("ord"))
    return sites.join(best, [*k, "ord"], "left_semi")


def junction_importance(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, cap: float = 1000.0) -> DataFrame:
    """Per node: roads that leave it, their summed length up to the next junction (each at most ``cap``), and the score."""
    k = list(keys)
    segs = segments(nodes, edges, keys)
    length = segs.groupBy(*k, "seg").agg(F.least(F.sum("w"), F.lit(cap)).alias("length"))
    out = segs.select(*k, "seg", F.col("u").alias("ord")).unionByName(segs.select(*k, "seg", F.col("v").alias("ord"))).join(length, [*k, "seg"])
    s = out.groupBy(*k, "ord").agg(F.count(F.lit(1)).alias("roads"), F.sum("length").alias("total"))
    return s.withColumn("score", F.col("roads") * F.col("total") + F.col("roads") * 1000)


def ways_between(paths: DataFrame, stops: DataFrame, keys: Sequence[str] = KEYS, limit: int = 32) -> DataFrame:
    """``paths`` as source, target, on_network and ``direct``: no node of ``stops`` lies on the path between its two ends.

    Every path looks back by pointer doubling until it meets a stop or its source, so a path of n nodes takes log2(n)
    rounds, and no path is listed node by node.
    """
    k = list(keys)
    stop = stops.select(*k, F.col("node").alias("prev"), F.lit(True).alias("stop")).distinct()
    inner = F.col("prev").isNotNull() & (F.col("prev") != F.col("source"))
    start = paths.join(stop, [*k, "prev"], "left").withColumn("held", inner & F.col("stop").isNotNull())
    open_ = F.count_if(F.col("up").isNotNull())
    state, left = cut_counting(start.select(*k, "source", "node", "dist", "held", F.when(inner & ~F.col("held"), F.col("prev")).alias("up")), open_)
    for _ in range(limit):
        if not left:
            break
        to = state.select(*k, "source", F.col("node").alias("up"), F.col("held").alias("more"), F.col("up").alias("next"))
        moved = state.where("up is not null").join(to, [*k, "source", "up"]).select(*k, "source", "node", "dist", F.col("more").alias("held"), F.col("next").alias("up"))
        state, left = cut_counting(state.where("up is null").unionByName(moved), open_)
    else:
        raise RuntimeError(f"ways_between: no end after {limit} rounds")
    return state.select(*k, "source", F.col("node").alias("target"), F.col("dist").alias("on_network"), (~F.col("held")).alias("direct"))


def site_distances(sites: DataFrame, nodes: DataFrame, edges: DataFrame, bound: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Network distance between all sites that a path joins, with the legs to their nearest nodes: ord1 < ord2,
    distance, and ``direct`` when no other site's node lies on the path. Of nodes equally near a site its node is the one
    of largest number, as when halves are rounded up. ``bound`` limits the search on the network; without one all pairs
    are reached. The paths are between nodes, each once; pairs of sites are made only as the result.
    """
    k = list(keys)
    back = nodes.withColumn("ord", -F.col("ord"))
    at = cut(nearest(sites, back, keys=keys).select(*k, "ord", (-F.col("near_ord")).alias("node"), F.col("near_d").alias("leg")))
    paths = shortest_paths(edges, at.select(*k, F.col("node").alias("source")).distinct(), bound, keys=keys)
    ways = ways_between(paths, at, keys)
    a = at.select(*k, F.col("ord").alias("ord1"), F.col("node").alias("source"), F.col("leg").alias("leg1"))
    b = at.select(*k, F.col("ord").alias("ord2"), F.col("node").alias("target"), F.col("leg").alias("leg2"))
    return (a.join(ways, [*k, "source"]).join(b, [*k, "target"]).where("ord1 < ord2")
            .withColumn("distance", F.col("leg1") + F.col("on_network") + F.col("leg2")))


def segment_adjacency(table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of segments that share a junction (an end of degree 3 or more): seg1 < seg2."""
    tips = table.select(*keys, "seg", F.explode(F.array_distinct(F.array(F.struct(F.col("start").alias("n"), F.col("start_degree").alias("d")), F.struct(F.col("end").alias("n"), F.col("end_degree").alias("d"))))).alias("t"))
    tips = tips.where("t.d >= 3").select(*keys, "seg", F.col("t.n").alias("node"))
    b = tips.select(*keys, "node", F.col("seg").alias("seg2"))
    return tips.join(b, [*keys, "node"]).where("seg < seg2").select(*keys, F.col("seg").alias("seg1"), "seg2").distinct()


def line_neighbours(points: DataFrame, lines: DataFrame, cap: float = 5.0, keys: Sequence[str] = KEYS, line_id: str = "road_id") -> DataFrame:
    """Direct connections: points that follow each other on their nearest line (type same_line), and the single points
    of two lines that touch (type connected_lines). Distances are between the feet."""
    k = list(keys)
    at = cut(nearest_segment(points, lines, cap=cap, keys=keys, line_id=line_id).where("near_line is not null")
             .select(*k, "ord", F.col("near_line").alias("line"), "measure", F.col("foot_x").alias("x"), F.col("foot_y").alias("y")))
    nx = chain_next(at, [*k, "line"], "measure", ["ord", "x", "y"]).where("n_ord is not null")
    same = nx.select(*k, F.least("ord", "n_ord").alias("ord1"), F.greatest("ord", "n_ord").alias("ord2"), dist("x", "y", "n_x", "n_y").alias("d"), F.lit("same_line").alias("type"))
    # two lines hold no other point exactly when each holds one
    single = at.groupBy(*k, "line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "x", "y")).alias("p")).where("n = 1").drop("n")
    used = lines.join(single.select(*k, F.col("line").alias(line_id)), [*k, line_id], "left_semi")
    meet = line_crossings(used, keys, line_id).select(*k, "line1", "line2").distinct()
    one, two = single.select(*k, F.col("line").alias("line1"), F.col("p").alias("p1")), single.select(*k, F.col("line").alias("line2"), F.col("p").alias("p2"))
    other = meet.join(one, [*k, "line1"]).join(two, [*k, "line2"]).select(
        *k, F.least("p1.ord", "p2.ord").alias("ord1"), F.greatest("p1.ord", "p2.ord").alias("ord2"), dist("p1.x", "p1.y", "p2.x", "p2.y").alias("d"), F.lit("connected_lines").alias("type"))
    return same.unionByName(other)


def centrality(nodes: DataFrame, edges: DataFrame, bound: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Degree and closeness centrality: closeness over the nodes each can reach, scaled by their share of the layer.

    ``bound`` limits the search; without one every pair of connected nodes is reached.
    """
    k = list(keys)
    n = nodes.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    deg = degrees(nodes, edges, keys).join(n, k)
    paths = shortest_paths(edges, nodes.select(*k, F.col("ord").alias("source")), bound, keys=keys)
    c = paths.groupBy(*k, F.col("source").alias("ord")).agg((F.count(F.lit(1)) - 1).alias("r"), F.sum("dist").alias("total"))
    out = deg.join(c, [*k, "ord"], "left")
    others = F.nullif(F.col("n") - 1, F.lit(0))
    close = F.col("r") / F.nullif("total", F.lit(0.0)) * (F.col("r") / others)
    return out.withColumns({"degree_centrality": F.coalesce(F.col("degree") / others, F.lit(0.0)), "closeness": F.coalesce(close, F.lit(0.0))}).drop("n", "r", "total")


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Betweenness summed over the given sources (all nodes give the exact value), by Brandes' dependency pass.

    Path counts grow outward and dependencies come back one hop-level of the shortest-path graph per round.
    """
    k = list(keys)
    far = cut(shortest_paths(edges, sources, keys=keys).select(*k, "source", "node", "dist"))
    both = united([edges.select(*k, "u", "v", "w"), edges.select(*k, F.col("v").alias("u"), F.col("u").alias("v"), "w")])
    du = far.select(*k, "source", F.col("node").alias("u"), F.col("dist").alias("du"))
    dv = far.select(*k, "source", F.col("node").alias("v"), F.col("dist").alias("dv"))
    arcs = cut(du.join(both, [*k, "u"]).join(dv, [*k, "source", "v"]).where(F.abs(F.col("du") + F.col("w") - F.col("dv")) < 1e-9).select(*k, "source", "u", "v"))
    # a node is ready when all its predecessors are counted; level = longest hop count in the shortest-path graph
    level = cut(sources.select(*k, "source", F.col("source").alias("node"), F.lit(0).alias("level"), F.lit(1.0).alias("paths")))
    need = arcs.groupBy(*k, "source", F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    done, front, i, got = level, level, 0, None
    while True:
        i += 1
        push = front.join(arcs.withColumnRenamed("u", "node"), [*k, "source", "node"]).select(*k, "source", F.col("v").alias("node"), "paths").groupBy(*k, "source", "node").agg(F.sum("paths").alias("p"), F.count(F.lit(1)).alias("c"))
        got = push if got is None else got.unionByName(push).groupBy(*k, "source", "node").agg(F.sum("p").alias("p"), F.sum("c").alias("c"))
        got = cut(got)
        ready = got.join(need, [*k, "source", "node"]).where("c = need")
        front = cut(ready.select(*k, "source", "node", F.lit(i).alias("level"), F.col("p").alias("paths")))
        if front.isEmpty():
            break
        got = got.join(front.select(*k, "source", "node"), [*k, "source", "node"], "left_anti")
        done = cut(done.unionByName(front))
    top = done.agg(F.max("level").alias("m")).first()["m"]
    dep = cut(done.withColumn("dep", F.lit(0.0)))
    for lv in range(top, 0, -1):
        low = dep.where(F.col("level") == lv).select(*k, "source", F.col("node").alias("v"), F.col("paths").alias("pv"), F.col("dep").alias("dv"))
        up = arcs.join(low, [*k, "source", "v"]).join(done.select(*k, "source", F.col("node").alias("u"), F.col("paths").alias("pu")), [*k, "source", "u"])
        add = up.groupBy(*k, "source", F.col("u").alias("node")).agg(F.sum(F.col("pu") / F.col("pv") * (1 + F.col("dv"))).alias("add"))
        dep = cut(dep.join(add, [*k, "source", "node"], "left").select(*k, "source", "node", "level", "paths", (F.col("dep") + F.coalesce("add", F.lit(0.0))).alias("dep")))
    s = dep.where("node <> source").groupBy(*k, F.col("node").alias("ord")).agg(F.sum("dep").alias("betweenness"))
    return nodes.join(s, [*k, "ord"], "left").fillna({"betweenness": 0.0})
