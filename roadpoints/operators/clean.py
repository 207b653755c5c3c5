"""Geometry cleaning: audits, ring repair, splits, size filters, projections."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from roadpoints.functions.geom import C, dist, ring_area
from roadpoints.operators.celljoin import KEYS

# GRS80 ellipsoid and the Korean belts (central meridian per code; latitude of origin 38, false origin 200000, 600000, scale 1).
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
BELTS = {"EPSG:5185": 125.0, "EPSG:5186": 127.0, "EPSG:5187": 129.0, "EPSG:5188": 131.0}
FALSE_E, FALSE_N, LAT0 = 200000.0, 600000.0, 38.0


def audit(shapes: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Counts per geometry type: rows, null or empty rings, rings of fewer than four vertices, unclosed rings."""
    n = F.coalesce(F.size("ring"), F.lit(0))
    shut = (n > 0) & (F.element_at("ring", 1) == F.element_at("ring", -1))
    return shapes.groupBy(*by, "geom_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(n <= 0).alias("empty"),
                                                F.count_if((n > 0) & (n < 4)).alias("short"), F.count_if((n >= 1) & ~shut).alias("unclosed"))


def repair_ring(ring: Column) -> Column:
    """Drop repeated vertices and close the ring; null when fewer than four vertices are left."""
    same = F.filter(ring, lambda v, i: (i == 0) | (F.get(ring, i - 1) != v))
    open_ = F.when((F.size(same) > 1) & (F.element_at(same, 1) == F.element_at(same, -1)), same).otherwise(F.concat(same, F.slice(same, 1, 1)))
    return F.when(F.size(open_) >= 4, open_)


def valid_shapes(shapes: DataFrame, min_area: float = 1e-10) -> DataFrame:
    """Rows whose repaired ring has an area; ``ring`` is the repaired one and ``area`` is added."""
    # generators keep the optimizer from copying the nested expressions into every filter below
    fixed = shapes.withColumn("_r", F.explode(F.array_compact(F.array(repair_ring(F.col("ring")))))).drop("ring").withColumnRenamed("_r", "ring")
    return fixed.withColumn("area", F.explode(F.filter(F.array(ring_area(F.col("ring"))), lambda a: a >= min_area)))


def rejects(shapes: DataFrame) -> DataFrame:
    """Rows that repair cannot save."""
    return shapes.where(repair_ring(F.col("ring")).isNull() | (ring_area(repair_ring(F.col("ring"))) < 1e-10))


def explode_parts(layers: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per polygon with the 1-based polygon_index."""
    return layers.select("*", F.posexplode(parts).alias("_p", "ring")).withColumn("polygon_index", F.col("_p") + 1).drop("_p", parts)


def ring_lines(shapes: DataFrame) -> DataFrame:
    """Each ring (or line) as its segments; points are dropped."""
    v = shapes.where(F.size("ring") > 1).withColumn("e", F.explode(F.arrays_zip(
        F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"))))
    return v.withColumns({"x1": F.col("e.a.x"), "y1": F.col("e.a.y"), "x2": F.col("e.b.x"), "y2": F.col("e.b.y")}).drop("e", "ring")


def drop_small_outliers(shapes: DataFrame, q: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """Where areas vary (deviation at least half the mean), keep those at or above the q-quantile."""
    from roadpoints.operators.sequence import exact_quantile
    s = shapes.groupBy(*keys).agg(F.stddev_pop("area").alias("_sd"), F.avg("area").alias("_m")).join(exact_quantile(shapes, "area", q, keys, "_q"), list(keys))
    return shapes.join(s, list(keys)).where((F.col("_sd") < 0.5 * F.col("_m")) | (F.col("area") >= F.col("_q"))).drop("_sd", "_m", "_q")


def drop_fragments(shapes: DataFrame, ladder: Sequence[float] = (10.0, 50.0, 100.0), keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep areas at or above the first threshold of the ladder that leaves a layer any row, else all its rows."""
    t = shapes.groupBy(*keys).agg(F.coalesce(*[F.when(F.count_if(F.col("area") >= v) > 0, F.lit(v)) for v in ladder], F.lit(0.0)).alias("_t"))
    return shapes.join(t, list(keys)).where(F.col("area") >= F.col("_t")).drop("_t")


def split_at_points(lines: DataFrame, cuts: DataFrame, near: float = 20.0, shortest: float = 10.0, keys: Sequence[str] = KEYS, line_id: str = "road_id") -> DataFrame:
    """Lines cut at the feet of the points near them: part, m0, m1, length; parts of at most ``shortest`` are dropped.

    All cuts are made at once and short parts dropped after.
    """
    from pyspark.sql import Window
    from roadpoints.operators.links import lines_near
    from roadpoints.operators.select import chain_next
    k = [*keys, line_id]
    whole = lines.select(*k, dist("x1", "y1", "x2", "y2").alias("full"))
    at = lines_near(cuts, lines, near, keys, line_id).select(*keys, F.col("line").alias(line_id), F.col("measure").alias("m"))
    marks = at.unionByName(whole.select(*k, F.lit(0.0).alias("m"))).unionByName(whole.select(*k, F.col("full").alias("m"))).distinct()
    nx = chain_next(marks.withColumn("ord", F.lit(0)), k, "m", ["m"]).where("n_m is not null").withColumn("length", F.col("n_m") - F.col("m")).where(F.col("length") > shortest)
    return nx.select(*k, F.col("m").alias("m0"), F.col("n_m").alias("m1"), "length").withColumn("part", F.row_number().over(Window.partitionBy(*k).orderBy("m0")) - 1)


# Transverse Mercator by Krueger's series to the fourth power of the third flattening (sub-millimetre near the belts)
_N = GRS80_F / (2 - GRS80_F)
_E = math.sqrt(GRS80_F * (2 - GRS80_F))
_RECT = GRS80_A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
_ALPHA = [_N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16 + 41 * _N ** 4 / 180, 13 * _N ** 2 / 48 - 3 * _N ** 3 / 5 + 557 * _N ** 4 / 1440,
          61 * _N ** 3 / 240 - 103 * _N ** 4 / 140, 49561 * _N ** 4 / 161280]
_BETA = [_N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96 - _N ** 4 / 360, _N ** 2 / 48 + _N ** 3 / 15 - 437 * _N ** 4 / 1440,
         17 * _N ** 3 / 480 - 37 * _N ** 4 / 840, 4397 * _N ** 4 / 161280]
_DELTA = [2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3 + 116 * _N ** 4 / 45, 7 * _N ** 2 / 3 - 8 * _N ** 3 / 5 - 227 * _N ** 4 / 45,
          56 * _N ** 3 / 15 - 136 * _N ** 4 / 35, 4279 * _N ** 4 / 630]


def _meridian0() -> float:
    phi = math.radians(LAT0)
    t = math.sinh(math.atanh(math.sin(phi)) - _E * math.atanh(_E * math.sin(phi)))
    xi = math.atan2(t, 1.0)
    return _RECT * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_ALPHA)))


_M0 = _meridian0()


def project(df: DataFrame, lon0: float | Column, lon: str = "lon", lat: str = "lat", out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Degrees to belt coordinates."""
    df = df.withColumns({"_s": F.sin(F.radians(C(lat))), "_l": F.radians(C(lon) - C(lon0))})
    df = df.withColumn("_t", F.sinh(F.atanh("_s") - _E * F.atanh(C("_s") * _E)))
    df = df.withColumns({"_xi": F.atan2(C("_t"), F.cos("_l")), "_et": F.atanh(F.sin("_l") / F.sqrt(1 + C("_t") * C("_t")))})
    xi, et = C("_xi"), C("_et")
    for j, a in enumerate(_ALPHA):
        k = 2.0 * (j + 1)
        xi, et = xi + a * F.sin(C("_xi") * k) * F.cosh(C("_et") * k), et + a * F.cos(C("_xi") * k) * F.sinh(C("_et") * k)
    return df.withColumns({out[0]: FALSE_E + _RECT * et, out[1]: FALSE_N + _RECT * xi - _M0}).drop("_s", "_l", "_t", "_xi", "_et")


def unproject(df: DataFrame, lon0: float | Column, x: str = "x", y: str = "y", out: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """Belt coordinates to degrees."""
    df = df.withColumns({"_xi": (C(y) - FALSE_N + _M0) / _RECT, "_et": (C(x) - FALSE_E) / _RECT})
    xi, et = C("_xi"), C("_et")
    for j, b in enumerate(_BETA):
        k = 2.0 * (j + 1)
        xi, et = xi - b * F.sin(C("_xi") * k) * F.cosh(C("_et") * k), et - b * F.cos(C("_xi") * k) * F.sinh(C("_et") * k)
    df = df.withColumns({"_p": xi, "_q": et})
    df = df.withColumn("_ch", F.asin(F.sin("_p") / F.cosh("_q")))
    phi = C("_ch")
    for j, d in enumerate(_DELTA):
        phi = phi + d * F.sin(C("_ch") * (2.0 * (j + 1)))
    return df.withColumns({out[1]: F.degrees(phi), out[0]: C(lon0) + F.degrees(F.atan2(F.sinh("_q"), F.cos("_p")))}).drop("_xi", "_et", "_p", "_q", "_ch")


def convert(df: DataFrame, source: str, target: str) -> DataFrame:
    """x, y from one belt to another; the same belt is left as it is."""
    if source == target:
        return df
    return project(unproject(df, BELTS[source], out=("_lon", "_lat")), BELTS[target], "_lon", "_lat").drop("_lon", "_lat")
