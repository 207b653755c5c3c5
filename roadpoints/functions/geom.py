"""Column expressions for planar geometry. All stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def C(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def clamp(v: Column, lo: float, hi: float) -> Column:
    # least and greatest skip nulls, so a null has to be kept by hand
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def dist(x1, y1, x2, y2, scale: float = 1.0) -> Column:
    dx, dy = C(x1) - C(x2), C(y1) - C(y2)
    d = F.sqrt(dx * dx + dy * dy)
    return d if scale == 1.0 else d * scale


def measure_ratio(px, py, ax, ay, bx, by) -> Column:
    """Position of the foot of P on A-B, clamped to 0..1; a zero-length segment gives 0."""
    vx, vy = C(bx) - C(ax), C(by) - C(ay)
    len2 = vx * vx + vy * vy
    t = ((C(px) - C(ax)) * vx + (C(py) - C(ay)) * vy) / F.nullif(len2, F.lit(0.0))
    return F.coalesce(clamp(t, 0.0, 1.0), F.lit(0.0))


def seg_dist(px, py, ax, ay, bx, by) -> Column:
    t = measure_ratio(px, py, ax, ay, bx, by)
    return dist(px, py, C(ax) + t * (C(bx) - C(ax)), C(ay) + t * (C(by) - C(ay)))


def foot(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    t = measure_ratio(px, py, ax, ay, bx, by)
    return C(ax) + t * (C(bx) - C(ax)), C(ay) + t * (C(by) - C(ay))


def bearing(x1, y1, x2, y2) -> Column:
    return F.atan2(C(y2) - C(y1), C(x2) - C(x1))


def fold(angle: Column) -> Column:
    """Absolute angle difference folded into 0..pi."""
    a = F.abs(angle)
    return F.when(a > math.pi, 2 * math.pi - a).otherwise(a)


def vector_angle(ux, uy, vx, vy) -> Column:
    """Angle between two vectors in radians; null when either has no length."""
    ux, uy, vx, vy = C(ux), C(uy), C(vx), C(vy)
    norms = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.acos(clamp((ux * vx + uy * vy) / F.nullif(norms, F.lit(0.0)), -1.0, 1.0))


def interior_angle(px, py, x, y, nx, ny) -> Column:
    """Angle at a vertex between the way back and the way on: pi on a straight run."""
    return vector_angle(C(px) - C(x), C(py) - C(y), C(nx) - C(x), C(ny) - C(y))


def turn_angle(px, py, x, y, nx, ny) -> Column:
    """Change of direction at a vertex: 0 on a straight run."""
    return vector_angle(C(x) - C(px), C(y) - C(py), C(nx) - C(x), C(ny) - C(y))


def same_box(x1, y1, x2, y2, tol: float = 1.0) -> Column:
    return (F.abs(C(x1) - C(x2)) < tol) & (F.abs(C(y1) - C(y2)) < tol)


def natural_direction(x1, y1, x2, y2) -> Column:
    """Nearly axis-parallel, or not too slanted: the look-natural test for links."""
    dx, dy = F.abs(C(x1) - C(x2)), F.abs(C(y1) - C(y2))
    return (dx < 5) | (dy < 5) | (F.least(dx, dy) / F.nullif(F.greatest(dx, dy), F.lit(0.0)) > 0.3)


def heron_curvature(ax, ay, bx, by, cx, cy) -> Column:
    """1 / radius of the circle through three points; 0 when they are on one line."""
    a, b, c = dist(bx, by, cx, cy), dist(ax, ay, cx, cy), dist(ax, ay, bx, by)
    s = (a + b + c) / 2
    area = F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c)))
    return F.coalesce(4 * area / F.nullif(a * b * c, F.lit(0.0)), F.lit(0.0))


def _ring_fold(ring: Column, term) -> Column:
    n = F.size(ring)
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), n - 1).alias("a"), F.slice(ring, F.lit(2), n - 1).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + term(p["a"], p["b"]))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of (x, y) structs."""
    return F.when(F.size(ring) < 4, 0.0).otherwise(
        F.abs(_ring_fold(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2)


def line_length(line: Column) -> Column:
    return F.when(F.size(line) < 2, 0.0).otherwise(
        _ring_fold(line, lambda a, b: dist(a["x"], a["y"], b["x"], b["y"])))


def with_disc_interval(df: DataFrame, cx: str, cy: str, r: float | Column, name: str) -> DataFrame:
    """Add <name>_t0, <name>_t1: the part of the link x1,y1 - x2,y2 inside a disc; nulls when outside.

    Columns are added in steps, so that each term is computed once.
    """
    dx, dy, fx, fy = C("x2") - C("x1"), C("y2") - C("y1"), C("x1") - C(cx), C("y1") - C(cy)
    df = df.withColumns({"_a": F.nullif(dx * dx + dy * dy, F.lit(0.0)), "_b": fx * dx + fy * dy, "_c": fx * fx + fy * fy - C(r) * C(r)})
    df = df.withColumn("_q", C("_b") * C("_b") - C("_a") * C("_c"))
    df = df.withColumn("_q", F.when(C("_q") >= 0, F.sqrt("_q")))
    df = df.withColumns({"_u": F.greatest(F.lit(0.0), (-C("_b") - C("_q")) / C("_a")), "_v": F.least(F.lit(1.0), (-C("_b") + C("_q")) / C("_a"))})
    ok = C("_q").isNotNull() & (C("_u") <= C("_v"))
    return df.withColumns({f"{name}_t0": F.when(ok, C("_u")), f"{name}_t1": F.when(ok, C("_v"))}).drop("_a", "_b", "_c", "_q", "_u", "_v")


def _slab(p, d, lo, hi) -> tuple[Column, Column]:
    """t-range in which p + t*d lies in lo..hi; null when it never does."""
    ta, tb = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
    inside = (p >= lo) & (p <= hi)
    t0 = F.when(d == 0, F.when(inside, F.lit(0.0))).otherwise(F.least(ta, tb))
    t1 = F.when(d == 0, F.when(inside, F.lit(1.0))).otherwise(F.greatest(ta, tb))
    return t0, t1


def with_band_interval(df: DataFrame, w: Column, name: str) -> DataFrame:
    """Add <name>_t0, <name>_t1: the part of the link x1,y1 - x2,y2 within ``w`` of the segment ax,ay - bx,by.

    The band is convex, so the part is one interval: the hull of the parts in its
    rectangle and its two end discs.
    """
    t0, t1 = f"{name}_t0", f"{name}_t1"
    df = df.withColumns({"_w": w, "_lx": C("bx") - C("ax"), "_ly": C("by") - C("ay")})
    df = df.withColumn("_l", F.sqrt(C("_lx") * C("_lx") + C("_ly") * C("_ly")))
    df = df.withColumns({"_lx": C("_lx") / F.nullif("_l", F.lit(0.0)), "_ly": C("_ly") / F.nullif("_l", F.lit(0.0))})
    df = df.withColumns({
        "_s": (C("x1") - C("ax")) * C("_lx") + (C("y1") - C("ay")) * C("_ly"),
        "_sd": (C("x2") - C("x1")) * C("_lx") + (C("y2") - C("y1")) * C("_ly"),
        "_n": (C("y1") - C("ay")) * C("_lx") - (C("x1") - C("ax")) * C("_ly"),
        "_nd": (C("y2") - C("y1")) * C("_lx") - (C("x2") - C("x1")) * C("_ly")})
    a0, a1 = _slab(C("_s"), C("_sd"), F.lit(0.0), C("_l"))
    b0, b1 = _slab(C("_n"), C("_nd"), -C("_w"), C("_w"))
    df = df.withColumns({"_a0": a0, "_a1": a1, "_b0": b0, "_b1": b1})
    df = df.withColumns({"_r0": F.greatest("_a0", "_b0", F.lit(0.0)), "_r1": F.least("_a1", "_b1", F.lit(1.0)),
                         "_ok": C("_a0").isNotNull() & C("_b0").isNotNull()})
    df = with_disc_interval(df, "ax", "ay", C("_w"), "_p")
    df = with_disc_interval(df, "bx", "by", C("_w"), "_e")
    rect = C("_ok") & (C("_r0") <= C("_r1"))
    df = df.withColumns({t0: F.least(F.when(rect, C("_r0")), "_p_t0", "_e_t0"), t1: F.greatest(F.when(rect, C("_r1")), "_p_t1", "_e_t1")})
    return df.drop("_w", "_lx", "_ly", "_l", "_s", "_sd", "_n", "_nd", "_a0", "_a1", "_b0", "_b1", "_r0", "_r1", "_ok",
                   "_p_t0", "_p_t1", "_e_t0", "_e_t1")


def crossing(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[Column, Column]:
    """Crossing point of segments A-B and C-D (nulls when they do not cross or are parallel)."""
    ax, ay, bx, by, cx, cy, dx, dy = map(C, (ax, ay, bx, by, cx, cy, dx, dy))
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    den = F.nullif(rx * sy - ry * sx, F.lit(0.0))
    t = ((cx - ax) * sy - (cy - ay) * sx) / den
    u = ((cx - ax) * ry - (cy - ay) * rx) / den
    ok = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return F.when(ok, ax + t * rx), F.when(ok, ay + t * ry)
