"""Curve, turn and end detection along ordered vertices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from roadpoints.functions.geom import bearing, dist, fold, heron_curvature, interior_angle, turn_angle, vector_angle
from roadpoints.operators.celljoin import KEYS, near_join
from roadpoints.operators.sequence import framed, islands, neighbours, representatives, top_n, with_position
from roadpoints.operators.cuts import cut


def steps(skel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distance and bearing from the previous and to the next vertex (0 at the ends), and the folded bearing change."""
    s = neighbours(with_position(skel, keys), keys=keys)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    s = s.withColumns({"prev_d": zero(dist("x", "y", "p1_x", "p1_y")), "prev_a": zero(bearing("p1_x", "p1_y", "x", "y")),
                       "next_d": zero(dist("x", "y", "n1_x", "n1_y")), "next_a": zero(bearing("x", "y", "n1_x", "n1_y"))})
    both = F.col("p1_x").isNotNull() & F.col("n1_x").isNotNull()
    return s.withColumn("curvature", F.when(both, fold(F.col("next_a") - F.col("prev_a"))).otherwise(0.0)).drop(
        "p1_x", "p1_y", "n1_x", "n1_y")


def vertex_angles(skel: DataFrame, turn: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Angle in degrees at each inner vertex: interior (180 on a straight run), or the turn (0 on one)."""
    s = neighbours(with_position(skel, keys), keys=keys)
    angle = (turn_angle if turn else interior_angle)("p1_x", "p1_y", "x", "y", "n1_x", "n1_y")
    return s.withColumn("angle", F.degrees(angle)).where("angle is not null").drop("p1_x", "p1_y", "n1_x", "n1_y")


def angle_curves(skel: DataFrame, threshold: float = 30.0, turn: bool = False, gap: int = 10, min_size: int = 3,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Middle vertex of each run of sharp vertices."""
    sharp = vertex_angles(skel, turn, keys).where(F.col("angle") > threshold)
    return representatives(islands(cut(sharp), gap, min_size, keys, "pos"))


def frame_angles(skel: DataFrame, window: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Angle in degrees between the mean directions to the ``window`` vertices before and from here on."""
    def build(w):
        back, on = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
        return {"bx": F.avg("x").over(back), "by": F.avg("y").over(back), "fx": F.avg("x").over(on), "fy": F.avg("y").over(on)}
    s = framed(with_position(skel, keys, total="n"), build, window, window, keys)
    s = s.where((F.col("pos") >= window) & (F.col("pos") < F.col("n") - window))
    angle = vector_angle(F.col("bx") - F.col("x"), F.col("by") - F.col("y"), F.col("fx") - F.col("x"), F.col("fy") - F.col("y"))
    return s.withColumn("angle", F.degrees(angle)).drop("bx", "by", "fx", "fy")


def frame_curves(skel: DataFrame, threshold: float = 25.0, window: int = 5, gap: int = 40, min_size: int = 3,
                 keys: Sequence[str] = KEYS) -> DataFrame:
    sharp = frame_angles(skel, window, keys).where(F.col("angle") > threshold)
    return representatives(islands(cut(sharp), gap, min_size, keys, "pos"))


def sharp_turns(skel: DataFrame, threshold: float = 60.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Vertices that turn by more than ``threshold`` degrees, with their rank in the layer's order."""
    s = neighbours(with_position(skel, keys), keys=keys)
    ok = (dist("p1_x", "p1_y", "x", "y") > 1e-6) & (dist("x", "y", "n1_x", "n1_y") > 1e-6)
    hit = s.where(ok).where(turn_angle("p1_x", "p1_y", "x", "y", "n1_x", "n1_y") > math.radians(threshold)).drop("p1_x", "p1_y", "n1_x", "n1_y")
    return with_position(hit, keys, order="pos", name="rank").withColumn("rank", F.col("rank") + 1)


def stencil_turns(line: DataFrame, threshold: float = 0.4, keys: Sequence[str] = KEYS) -> DataFrame:
    """Vertices whose five-point stencil has a largest turn above the threshold and a mean above half of it."""
    s = neighbours(line, reach=2, keys=keys, pos="pos").where("p2_x is not null and n2_x is not null")
    path = [("p2_x", "p2_y"), ("p1_x", "p1_y"), ("x", "y"), ("n1_x", "n1_y"), ("n2_x", "n2_y")]
    turns = F.filter(F.array(*[turn_angle(*path[i], *path[i + 1], *path[i + 2]) for i in range(3)]), lambda t: t.isNotNull())
    s = s.withColumn("_t", turns).where(F.size("_t") > 0)
    s = s.withColumns({"max_turn": F.array_max("_t"), "mean_turn": F.aggregate("_t", F.lit(0.0), lambda a, t: a + t) / F.size("_t")})
    cols = [c for c in line.columns] + ["max_turn", "mean_turn"]
    return s.where((F.col("max_turn") > threshold) & (F.col("mean_turn") > threshold * 0.5)).select(*cols)


def smoothed_curvature(line: DataFrame, sigma: float = 2.0, order: int = 1, keys: Sequence[str] = KEYS, total: str = "n", keep: bool = False) -> DataFrame:
    """Curvature of Gauss-smoothed coordinates by their differences: order 1 is the change of direction, 2 the curvature formula, 3 that
    plus a tenth of the third differences.

    Needs dense ``pos`` and the layer's row count ``total``. Weights reach four sigma; at the ends the line is reflected, its end included.
    ``keep`` keeps the first differences dx and dy.
    """
    reach = int(4 * sigma + 0.5)
    weight = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    weight = [w / sum(weight) for w in weight]
    n, pos, gone = F.col(total), F.col("pos"), () if keep else ("dx", "dy")
    around_ = framed(line, lambda w: {"_f": F.collect_list(F.struct("pos", "x", "y")).over(w.rowsBetween(-reach, reach))}, reach, reach, keys)
    lo = F.greatest(F.lit(0), pos - reach)

    def smooth(c: str) -> Column:
        total_ = F.lit(0.0)
        for i, w in zip(range(-reach, reach + 1), weight):
            m = F.pmod(pos + i, 2 * n)
            at = F.when(m < n, m).otherwise(2 * n - 1 - m)
            total_ = total_ + F.get("_f", (at - lo).cast("int"))[c] * w
        return total_

    def gradient(src: str, dst: str):
        def build(w):
            p, q, v = F.lag(src).over(w), F.lead(src).over(w), F.col(src)
            return {dst: F.when(p.isNull() & q.isNull(), 0.0).when(p.isNull(), q - v).when(q.isNull(), v - p).otherwise((q - p) / 2)}
        return lambda df: framed(df, build, 1, 1, keys)

    s = around_.select(*line.columns, smooth("x").alias("sx"), smooth("y").alias("sy"))
    for src, dst in (("sx", "dx"), ("sy", "dy")):
        s = gradient(src, dst)(s)
    if order == 1:
        s = gradient("_a", "curvature")(s.withColumn("_a", F.atan2("dy", "dx"))).withColumn("curvature", F.abs("curvature"))
        return s.drop("sx", "sy", "_a", *gone)
    for src, dst in (("dx", "ddx"), ("dy", "ddy")):
        s = gradient(src, dst)(s)
    den = F.pow(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), F.lit(1.5))
    s = s.withColumn("curvature", F.abs(F.col("dx") * F.col("ddy") - F.col("dy") * F.col("ddx")) / F.when(den == 0, 1e-10).otherwise(den))
    if order > 2:
        s = gradient("ddy", "d3y")(gradient("ddx", "d3x")(s))
        s = s.withColumn("curvature", F.col("curvature") + 0.1 * F.abs(F.col("d3x") + F.col("d3y"))).drop("d3x", "d3y")
    return s.drop("sx", "sy", "ddx", "ddy", *gone)


def arc_positions(line: DataFrame, keys: Sequence[str] = KEYS, line_id: str = "road_id") -> DataFrame:
    """Segments of each line with the arc length at their start: m0, m1, and the line's length.

    Lines are summed per line, not per layer; ``pos`` orders the vertices.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*keys, line_id).orderBy("pos")
    s = line.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    s = s.withColumn("_d", F.coalesce(dist("x", "y", "x2", "y2"), F.lit(0.0)))
    s = s.withColumn("m1", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumns({"m0": F.col("m1") - F.col("_d"), "length": F.sum("_d").over(Window.partitionBy(*keys, line_id))})
    return s.where("x2 is not null").drop("_d")


def at_arc(segs: DataFrame, marks: DataFrame, at: str, name: str, keys: Sequence[str] = KEYS, line_id: str = "road_id",
           bin_: float = 50.0) -> DataFrame:
    """``marks`` plus <name>x, <name>y: the point of its line at arc length ``at``; segments are found by arc bins."""
    k = [*keys, line_id]
    b = segs.select(*k, "m0", "m1", "x", "y", "x2", "y2", "length", F.explode(
        F.sequence(F.floor(F.col("m0") / bin_), F.floor(F.col("m1") / bin_))).alias("_b")).withColumnsRenamed(
        {"x": "_x", "y": "_y", "x2": "_x2", "y2": "_y2", "length": "_len"})
    a = F.col(at)
    hit = marks.withColumn("_b", F.floor(a / bin_)).join(b, [*k, "_b"])
    inside = (a >= F.col("m0")) & ((a < F.col("m1")) | ((a >= F.col("_len")) & (F.col("m1") >= F.col("_len"))))
    t = F.coalesce((a - F.col("m0")) / F.nullif(F.col("m1") - F.col("m0"), F.lit(0.0)), F.lit(0.0))
    return (hit.where(inside).withColumns({name + "x": F.col("_x") + t * (F.col("_x2") - F.col("_x")),
                                           name + "y": F.col("_y") + t * (F.col("_y2") - F.col("_y"))})
            .drop("_b", "m0", "m1", "_x", "_y", "_x2", "_y2", "_len"))


def arc_curvature(line: DataFrame, sample: float = 15.0, window: float | None = None, keys: Sequence[str] = KEYS,
                  line_id: str = "road_id", min_samples: int = 10) -> DataFrame:
    """Samples along each line every ``sample`` metres with the turn between the chords ``window`` back and on."""
    k, window = [*keys, line_id], window or sample
    segs = cut(arc_positions(line, keys, line_id))
    length = segs.groupBy(*k).agg(F.max("length").alias("length"))
    n = F.greatest(F.lit(min_samples), F.floor(F.col("length") / sample).cast("int"))
    marks = (length.where(F.col("length") >= sample).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
             .withColumn("at", F.col("i") * sample % F.col("length"))
             .withColumns({"a1": F.greatest(F.lit(0.0), F.col("at") - window), "a3": F.least("length", F.col("at") + window)})
             .where(F.col("a3") - F.col("a1") >= window * 0.5))
    for col, name in (("at", ""), ("a1", "p"), ("a3", "n")):
        marks = at_arc(segs, marks, col, name, keys, line_id)
    turn = F.coalesce(turn_angle("px", "py", "x", "y", "nx", "ny"), F.lit(0.0))
    return marks.withColumn("curvature", turn).select(*k, "i", "at", "x", "y", "curvature")


def band_edges(skel: DataFrame, half: float = 3.0, keys: Sequence[str] = KEYS, line_id: str = "road_id") -> DataFrame:
    """Both edges of a band along each line: its vertices moved sideways by ``half``; side is 0 or 1.

    The edge of a dissolved buffer differs at junctions; this is the rule used here.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*keys, line_id).orderBy("ord")
    s = skel.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w), "qx": F.lag("x").over(w), "qy": F.lag("y").over(w)})
    vx, vy = F.coalesce(F.col("nx"), F.col("x")) - F.coalesce(F.col("qx"), F.col("x")), F.coalesce(F.col("ny"), F.col("y")) - F.coalesce(F.col("qy"), F.col("y"))
    s = s.withColumns({"vx": vx, "vy": vy}).withColumn("vl", F.nullif(F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2), F.lit(0.0)))
    s = s.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("sg", F.when(F.col("side") == 0, half).otherwise(-half))
    return s.where("vl is not null").select(
        *keys, line_id, "side", F.col("ord").alias("pos"), (F.col("x") - F.col("vy") / F.col("vl") * F.col("sg")).alias("x"),
        (F.col("y") + F.col("vx") / F.col("vl") * F.col("sg")).alias("y"))


def edge_curves(skel: DataFrame, sample: float = 15.0, threshold: float = 0.2, half: float = 3.0, radius: float = 20.0,
                weighted: bool = True, keys: Sequence[str] = KEYS, line_id: str = "road_id", per_road: bool = False) -> DataFrame:
    """Curve points from the road edges: sampled turns above the threshold, clustered (2 or more),
    centre weighted by turn, snapped to the nearest skeleton point."""
    from roadpoints.operators.celljoin import nearest
    from roadpoints.operators.fixpoint import cluster
    edges = band_edges(skel, half, keys, line_id).withColumn("edge", F.struct(F.col(line_id), F.col("side")))
    bent = arc_curvature(edges.select(*keys, "edge", "pos", "x", "y"), sample, keys=keys, line_id="edge").where(F.col("curvature") > threshold)
    # numbered by road, side and place: each side's numbers begin after those of the sides before it
    from pyspark.sql import Window
    sides = bent.groupBy(*keys, "edge").agg((F.max("i") + 1).alias("_k"))
    before = Window.partitionBy(*keys).orderBy("edge").rowsBetween(Window.unboundedPreceding, -1)
    sides = sides.withColumn("_s", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    bent = cut(bent.join(sides, [*keys, "edge"]).withColumn("ord", F.col("_s") + F.col("i")).drop("_s"))
    k = [*keys, line_id] if per_road else list(keys)
    if per_road:
        bent = bent.withColumn(line_id, F.col(f"edge.{line_id}"))
    grouped = cluster(bent.select(*k, "ord", "x", "y", "curvature"), radius, k, min_size=2)
    w = F.col("curvature") if weighted else F.lit(1.0)
    centre = grouped.groupBy(*k, "cluster").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y"),
                                                F.count(F.lit(1)).alias("members"))
    snapped = nearest(centre, skel, keys=keys)
    return snapped.select(*k, "cluster", "members", F.col("near_ord").alias("ord"), F.col("near_x").alias("x"), F.col("near_y").alias("y"))


def circle_curvature(points: DataFrame, skel: DataFrame, radius: float = 30.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus ``curvature``: 1/radius of the circle through the first, middle and last skeleton point near it.

    The middle of the n rows in order is found by rank inside each point's own neighbourhood.
    """
    from pyspark.sql import Window
    hits = near_join(points.select(*keys, "ord", "x", "y"), skel.select(*keys, "ord", "x", "y"), radius, keys, strict=True)
    w = Window.partitionBy(*keys, "ord").orderBy("r_ord")
    r = hits.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys, "ord"))})
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    a, b, c = F.col("_i") == 0, F.col("_i") == F.expr("_n div 2"), F.col("_i") == F.col("_n") - 1
    t = r.where(a | b | c).groupBy(*keys, "ord").agg(
        F.max("_n").alias("_n"), *[pick(cond, f"r_{v}").alias(f"{n}{v}") for n, cond in (("a", a), ("b", b), ("c", c)) for v in ("x", "y")])
    t = t.where("_n >= 3").withColumn("curvature", heron_curvature("ax", "ay", "bx", "by", "cx", "cy")).select(*keys, "ord", "curvature")
    return points.join(t, [*keys, "ord"], "left").fillna({"curvature": 0.0})


def sequence_ends(skel: DataFrame, min_gap: float = 25.0, keys: Sequence[str] = KEYS, close: str = "first") -> DataFrame:
    """First and last vertex per layer; when closer than ``min_gap`` only the first (or their midpoint)."""
    v = F.struct("x", "y")
    e = skel.groupBy(*keys).agg(F.min_by(v, "ord").alias("a"), F.max_by(v, "ord").alias("b"))
    far = dist("a.x", "a.y", "b.x", "b.y") >= min_gap
    mid = F.struct(((F.col("a.x") + F.col("b.x")) / 2).alias("x"), ((F.col("a.y") + F.col("b.y")) / 2).alias("y"))
    one = F.array(F.col("a") if close == "first" else mid)
    return (e.withColumn("e", F.explode(F.when(far, F.array("a", "b")).otherwise(one)))
            .select(*keys, F.col("e.x").alias("x"), F.col("e.y").alias("y")))


def bounds(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"))


def box_gap() -> Column:
    """Distance to the nearest side of the layer's box (minx, maxx, miny, maxy), from inside."""
    x, y = F.col("x"), F.col("y")
    return F.least(x - F.col("minx"), F.col("maxx") - x, y - F.col("miny"), F.col("maxy") - y)


def road_ends(sites: DataFrame, skel: DataFrame, edge: float = 30.0, radius: float = 50.0, most: int = 2,
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Sites near the skeleton's box with at most ``most`` other skeleton points closer than ``radius``."""
    from roadpoints.operators.celljoin import around
    close = sites.join(bounds(skel, keys), list(keys)).where(box_gap() < edge).drop("minx", "maxx", "miny", "maxy")
    # points at the site's own coordinates are not counted
    n = around(close, skel, radius, {"_n": F.sum(F.when(F.col("d") > 0, F.col("r_w")).otherwise(0))}, keys, strict=True, default={"_n": 0})
    return n.where(F.col("_n") <= most).drop("_n")


def resample(line: DataFrame, step: float = 15.0, keys: Sequence[str] = KEYS, block: int = 4096, look: int = 64) -> DataFrame:
    """Thin each layer's ordered vertices: from a kept vertex, the distances of the following ones to it are
    summed until they reach ``step``; that vertex is kept next. The last vertex is added when it is more than
    step/2 from the last kept one.

    What follows a vertex depends on it alone, so each vertex has one successor. Successors are found per
    block of positions; which blocks are entered where is followed by doubling over the few entry rows.
    """
    import pandas as pd
    from functools import reduce
    k = list(keys)
    s = cut(with_position(line, keys, total="n").select(*k, "ord", "x", "y", "pos", "n"))

    found, width = [], look
    while True:
        lent = s.withColumn("_b", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - width) / block)), F.floor(F.col("pos") / block))))

        def succ(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos")
            x, y, p = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["pos"].to_numpy()
            total = pdf["n"].iloc[0]
            home = pdf["_b"].iloc[0]
            out = []
            for i in range(len(p)):
                if p[i] // block != home:
                    continue
                acc, nxt = 0.0, -1
                for j in range(i + 1, min(i + 1 + width, len(p))):
                    acc += ((x[j] - x[i]) ** 2 + (y[j] - y[i]) ** 2) ** 0.5
                    if acc >= step:
                        nxt = p[j]
                        break
                else:
                    nxt = total if p[i] + width >= total - 1 else -1
                out.append(nxt)
            own = pdf[(pdf["pos"] // block) == home][[*k, "pos"]].copy()
            own["nxt"] = out
            return own
        schema = ", ".join([f"{c} long" for c in k] + ["pos long", "nxt long"])
        part = cut(lent.groupBy(*k, "_b").applyInPandas(succ, schema))
        if found:
            part = part.join(found[-1].where("nxt < 0").select(*k, "pos"), [*k, "pos"], "left_semi")
        found.append(cut(part))
        if found[-1].where("nxt < 0").isEmpty():
            break
        width *= 8
        block = max(block, width)
    nxt = reduce(DataFrame.unionByName, [f.where("nxt >= 0") for f in found]) if len(found) > 1 else found[0]
    home = 4096
    tagged = cut(nxt.withColumn("_b", F.floor(F.col("pos") / home)))

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first, nx = int(pdf["pos"].iloc[0]), pdf["nxt"].to_numpy()
        last = first + len(nx)
        ex = nx.copy()
        for i in range(len(nx) - 1, -1, -1):
            if nx[i] < last:
                ex[i] = ex[nx[i] - first]
        return pdf[[*k, "pos"]].assign(nxt=ex)

    jump = tagged.groupBy(*k, "_b").applyInPandas(exits, ", ".join([f"{c} long" for c in k] + ["pos long", "nxt long"]))
    jump = cut(jump)
    entries = tagged.where(F.floor(F.col("nxt") / home) != F.col("_b")).select(*k, F.col("nxt").alias("pos")).distinct().unionByName(
        s.select(*k).distinct().withColumn("pos", F.lit(0).cast("long"))).distinct()
    jump = cut(jump.join(entries, [*k, "pos"], "left_semi"))
    reached = cut(s.select(*k).distinct().withColumn("pos", F.lit(0).cast("long")))
    while True:
        more = reached.join(jump, [*k, "pos"]).select(*k, F.col("nxt").alias("pos"))
        grown = cut(reached.unionByName(more).distinct())
        ahead = jump.join(jump.select(*k, F.col("pos").alias("nxt"), F.col("nxt").alias("far")), [*k, "nxt"]).select(*k, "pos", F.col("far").alias("nxt"))
        reached, jump = grown, cut(ahead)
        if jump.isEmpty():
            break

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first, nx, inn = int(pdf["pos"].iloc[0]), pdf["nxt"].to_numpy(), pdf["entry"].to_numpy()
        keep = inn.copy()
        for i in range(len(nx)):
            if keep[i] and nx[i] < first + len(nx):
                keep[nx[i] - first] = True
        return pdf.loc[keep, [*k, "pos", "nxt"]]

    flagged = tagged.join(reached.withColumn("entry", F.lit(True)), [*k, "pos"], "left").fillna({"entry": False})
    kept = cut(flagged.groupBy(*k, "_b").applyInPandas(walk, ", ".join([f"{c} long" for c in k] + ["pos long", "nxt long"])))
    rows = s.join(kept.select(*k, "pos"), [*k, "pos"], "left_semi")
    last = s.where("pos = n - 1")
    end = rows.groupBy(*k).agg(F.max_by(F.struct("x", "y", "pos"), "pos").alias("e"))
    tail = (last.join(end, k).where((F.col("e.pos") > 0) & (F.col("pos") > F.col("e.pos")) & (dist("x", "y", "e.x", "e.y") > step * 0.5)).drop("e"))
    return rows.unionByName(tail.select(*rows.columns))
