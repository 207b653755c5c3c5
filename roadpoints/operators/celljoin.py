"""Distance joins by grid cell: an equi-join on (layer, cell) plus an exact residual test.

Copies of one coordinate are folded before any join that only aggregates, so a
place that holds a large share of all rows costs one row per side, not its square.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadpoints.functions.geom import clamp, dist
from roadpoints.operators.cuts import cut, cut_counting, sieved, unfolded, united

KEYS = ("layer_id",)
RING = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
HALF = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def cell(v: str | Column, edge: float) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / edge)


def with_cell(df: DataFrame, edge: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"cx": cell(x, edge), "cy": cell(y, edge)})


def spread(df: DataFrame, edge: float, x: str = "x", y: str = "y", reach: int = 1) -> DataFrame:
    """One row per cell of the (2*reach+1)^2 neighbourhood."""
    side = range(-reach, reach + 1)
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in side for j in side])
    return unfolded(df.withColumn("_o", F.explode(offsets))
                    .withColumns({"cx": cell(x, edge) + F.col("_o.i"), "cy": cell(y, edge) + F.col("_o.j")})
                    .drop("_o"))


def renamed(df: DataFrame, prefix: str, keep: Sequence[str] = KEYS) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def near_join(left: DataFrame, right: DataFrame, radius: float, keys: Sequence[str] = KEYS,
              prefix: str = "r_", strict: bool = False, how: str = "inner") -> DataFrame:
    """All (left, right) rows within ``radius``, with distance ``d``.

    The right side is the one repeated over nine cells, so pass the smaller or
    narrower table there. ``how`` may be inner, left_semi or left_anti.
    """
    lhs = with_cell(left, radius)
    rhs = renamed(spread(right.select(*right.columns), radius), prefix, (*keys, "cx", "cy"))
    d = dist("x", "y", prefix + "x", prefix + "y")
    hit = d < radius if strict else d <= radius
    on = [*keys, "cx", "cy"]
    if how == "inner":
        return lhs.join(rhs, on).withColumn("d", d).where(
            F.col("d") < radius if strict else F.col("d") <= radius).drop("cx", "cy")
    a, b = lhs.alias("a"), rhs.alias("b")
    cond = hit
    for k in on:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return sieved(a, b, cond, how).drop("cx", "cy")


def pairs_within(points: DataFrame, lo: float, hi: float, cols: Sequence[str] = ("x", "y", "category"),
                 keys: Sequence[str] = KEYS, order: str = "ord", strict: bool = False) -> DataFrame:
    """Unordered pairs with lo <= d <= hi: ord1 < ord2, the columns of both ends, and ``d``.

    Five of the nine neighbour cells are enough, since each pair of different
    cells is met from one side only.
    """
    base = points.select(*keys, F.col(order).alias("ord"), *[F.col(c) for c in cols if c != order])
    end = F.struct("ord", *[c for c in cols if c != order])
    lhs = with_cell(base, hi).select(*keys, "cx", "cy", end.alias("a"))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in HALF])
    rhs = unfolded(with_cell(base, hi).withColumn("o", F.explode(offsets))
                   .select(*keys, (F.col("cx") - F.col("o.i")).alias("cx"), (F.col("cy") - F.col("o.j")).alias("cy"),
                           end.alias("b"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("home")))
    d = dist("a.x", "a.y", "b.x", "b.y")
    near = F.col("d") < hi if strict else F.col("d") <= hi
    first = F.col("a.ord") < F.col("b.ord")
    one, two = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    return (lhs.join(rhs, [*keys, "cx", "cy"])
            .where(~F.col("home") | first)
            .withColumn("d", d).where(near & (F.col("d") >= lo))
            .select(*keys, one.alias("p"), two.alias("q"), "d")
            .select(*keys, F.col("p.ord").alias("ord1"), F.col("q.ord").alias("ord2"),
                    *[F.col(f"p.{c}").alias(f"{c}1") for c in cols if c != order],
                    *[F.col(f"q.{c}").alias(f"{c}2") for c in cols if c != order], "d"))


def finite(df: DataFrame, cols: Sequence[str] = ("x", "y")) -> DataFrame:
    """Rows whose coordinates are numbers: null, NaN and infinite ones lie in no cell and are near nothing."""
    for c in cols:
        df = df.where(F.abs(c) < float("inf"))
    return df


def fold_copies(df: DataFrame, keys: Sequence[str] = KEYS, also: Sequence[str] = ()) -> DataFrame:
    """Distinct coordinates with weight ``w`` and the first ``ord``."""
    first = F.min("ord") if "ord" in df.columns else F.lit(None).cast("long")
    return df.groupBy(*keys, "x", "y", *also).agg(F.count(F.lit(1)).alias("w"), first.alias("ord"))


def around(sites: DataFrame, data: DataFrame, radius: float, aggs: dict[str, Column],
           keys: Sequence[str] = KEYS, also: Sequence[str] = (), strict: bool = False,
           default: dict[str, object] | None = None) -> DataFrame:
    """``sites`` plus aggregates over ``data`` within ``radius``.

    ``aggs`` may use d, r_w (how many copies), r_ord, r_x, r_y and r_<also>.
    """
    spots = sites.select(*keys, "x", "y").distinct()
    hits = near_join(spots, fold_copies(data, keys, also), radius, keys, strict=strict)
    found = hits.groupBy(*keys, "x", "y").agg(*[a.alias(n) for n, a in aggs.items()])
    out = sites.join(found, [*keys, "x", "y"], "left")
    return out.fillna(default) if default else out


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("r_w"))), F.lit(0)).cast("long")


def nearest(sites: DataFrame, data: DataFrame, cap: float | None = None, keys: Sequence[str] = KEYS,
            also: Sequence[str] = (), skip_self: bool = False, strict: bool = False,
            first_edge: float = 50.0) -> DataFrame:
    """``sites`` plus the nearest row of ``data``: near_ord, near_x, near_y, near_<also>, near_d.

    Ties go to the smaller ord. With a cap, sites without a hit get nulls. Without one,
    sites still open are tried again with cells twice as wide, until all are served.
    Sites whose coordinates are no finite numbers get nulls, such rows of ``data`` are near nothing.
    ``skip_self`` leaves out rows at the site's own coordinates held by the site alone.
    """
    best = F.struct(F.col("d"), F.col("r_ord").alias("ord"), F.col("r_x").alias("x"), F.col("r_y").alias("y"),
                    *[F.col("r_" + c).alias(c) for c in also])
    spots = finite(sites.select(*keys, "x", "y")).distinct()
    heap = fold_copies(finite(data), keys, also)

    def attempt(open_spots: DataFrame, edge: float) -> DataFrame:
        hits = near_join(open_spots, heap, edge, keys, strict=strict and cap is not None)
        if skip_self:
            hits = hits.where((F.col("d") > 0) | (F.col("r_w") > 1))
        return hits.groupBy(*keys, "x", "y").agg(F.min(best).alias("near"))

    if cap is not None:
        found = attempt(spots, cap)
    else:
        served = heap.groupBy(*keys).agg(F.sum("w").alias("_n"))
        if skip_self:
            served = served.where("_n > 1")
        todo, left = cut_counting(spots.join(served, list(keys), "left_semi"))
        edge, parts = first_edge, []
        while left or not parts:
            part, got = cut_counting(attempt(todo, edge))
            parts.append(part)
            left -= got
            if left:
                todo = sieved(todo, part, [*keys, "x", "y"], "left_anti")
            edge *= 2
        found = united(parts)
    return (sites.join(found, [*keys, "x", "y"], "left")
            .withColumns({f"near_{c}": F.col(f"near.{c}") for c in ("ord", "x", "y", "d", *also)}).drop("near"))


def k_nearest(sites: DataFrame, data: DataFrame, k: int, keys: Sequence[str] = KEYS, pad: float = 1000.0,
              first_edge: float = 50.0) -> DataFrame:
    """``sites`` plus ``near_d``: the k smallest distances to ``data``, padded with ``pad``.

    Cells double for the sites that have met fewer than k rows and fewer than their layer holds. Sites and rows whose coordinates are
    no finite numbers meet none.
    """
    on = [*keys, "x", "y"]
    heap = cut(fold_copies(finite(data), keys))
    total = heap.groupBy(*keys).agg(F.sum("w").alias("_all"))
    todo, left = cut_counting(finite(sites.select(*on)).distinct().join(total, list(keys)))
    edge, parts = first_edge, []
    while left:
        hits = near_join(todo, heap, edge, keys)
        w = Window.partitionBy(*on).orderBy("d", "r_ord")
        few = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        copies = few.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.col("r_w"), F.lit(k)))))
        got = copies.groupBy(*on).agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("near_d"))
        got, n = cut_counting(got.join(todo, on).where((F.size("near_d") >= k) | (F.size("near_d") >= F.col("_all"))).drop("_all"))
        parts.append(got)
        todo, left = sieved(todo, got, on, "left_anti"), left - n
        edge *= 2
    out = sites
    if parts:
        out = sites.join(united(parts), on, "left")
    else:
        out = sites.withColumn("near_d", F.lit(None).cast("array<double>"))
    padded = F.concat(F.coalesce("near_d", F.array().cast("array<double>")), F.array_repeat(F.lit(pad), k))
    return out.withColumn("near_d", F.slice(padded, 1, k))


def segment_cells(df: DataFrame, edge: float, reach: float | Column = 0.0,
                  ends: Sequence[str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """One row per cell that a segment, widened by ``reach``, may touch; no cell is met twice.

    For each column of cells the segment is clipped to that column's strip, which gives the rows.
    """
    x1, y1, x2, y2 = map(F.col, ends)
    floor = lambda v: F.floor(v / edge)
    cols = df.withColumn("cx", F.explode(F.sequence(floor(F.least(x1, x2) - reach), floor(F.greatest(x1, x2) + reach))))
    run = F.nullif(x2 - x1, F.lit(0.0))
    ta, tb = (F.col("cx") * edge - reach - x1) / run, ((F.col("cx") + 1) * edge + reach - x1) / run
    t0 = F.coalesce(clamp(F.least(ta, tb), 0.0, 1.0), F.lit(0.0))
    t1 = F.coalesce(clamp(F.greatest(ta, tb), 0.0, 1.0), F.lit(1.0))
    cols = cols.withColumns({"_ya": y1 + t0 * (y2 - y1), "_yb": y1 + t1 * (y2 - y1)})
    return unfolded(cols.withColumn("cy", F.explode(F.sequence(
        floor(F.least("_ya", "_yb") - reach), floor(F.greatest("_ya", "_yb") + reach)))).drop("_ya", "_yb"))
