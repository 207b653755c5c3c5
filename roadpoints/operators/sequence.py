"""Ordered-sequence operators that never gather a whole layer in one task.

A layer may hold a large share of all rows, so windows run over blocks of consecutive
positions. Rows near a block's border are lent to the neighbour block, which gives
every row its full frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from roadpoints.operators.celljoin import KEYS

BLOCK = 4096


def with_position(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "ord", name: str = "pos",
                  total: str | None = None, block: int = 1 << 14) -> DataFrame:
    """Dense 0-based position by an integer order column, from counts per block of order values."""
    k = list(keys)
    part = F.floor(F.col(order) / block)
    tagged = df.withColumn("_b", part)
    counts = tagged.groupBy(*k, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        starts = starts.withColumn(total, F.sum("_n").over(Window.partitionBy(*k)))
    w = Window.partitionBy(*k, "_b").orderBy(order)
    # dealt by block here, as rows that come dealt by layer alone would stay so
    return (tagged.repartition(*k, "_b").join(starts.drop("_n"), [*k, "_b"])
            .withColumn(name, F.row_number().over(w) - 1 + F.col("_s")).drop("_b", "_s"))


def framed(df: DataFrame, build: Callable[[WindowSpec], dict[str, Column]], before: int, after: int,
           keys: Sequence[str] = KEYS, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows on.

    ``pos`` must be dense. ``build`` gets a window ordered by position and returns the columns.
    """
    p = F.col(pos)
    lent = df.withColumn("_b", F.explode(F.sequence(F.floor((p - after) / block), F.floor((p + before) / block))))
    w = Window.partitionBy(*keys, "_b").orderBy(pos)
    return lent.repartition(*keys, "_b").withColumns(build(w)).where(F.col("_b") == F.floor(p / block)).drop("_b")


def neighbours(df: DataFrame, cols: Sequence[str] = ("x", "y"), reach: int = 1, keys: Sequence[str] = KEYS,
               pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """Add p<i>_<col> and n<i>_<col>: values of the i-th row before and after."""
    def build(w):
        out = {}
        for i in range(1, reach + 1):
            for c in cols:
                out[f"p{i}_{c}"] = F.lag(c, i).over(w)
                out[f"n{i}_{c}"] = F.lead(c, i).over(w)
        return out
    return framed(df, build, reach, reach, keys, pos, block)


def islands(df: DataFrame, gap: int, min_size: int = 1, keys: Sequence[str] = KEYS, order: str = "idx") -> DataFrame:
    """Runs of rows whose order values are at most ``gap`` apart: adds run, run_pos, run_size.

    ``run`` is the first order value of the run. Runs are found per block of order values and
    then joined across block borders on the block table alone, so a run of any length is whole.
    """
    k, block = list(keys), max(BLOCK, gap + 1)
    tagged = df.withColumn("_b", F.floor(F.col(order) / block))
    w = Window.partitionBy(*k, "_b").orderBy(order)
    step = F.col(order) - F.lag(order).over(w)
    local = (tagged.withColumn("_new", F.when(step.isNull() | (step > gap), F.col(order)))
             .withColumn("_start", F.last("_new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    parts = local.groupBy(*k, "_b", "_start").agg(F.max(order).alias("_end"), F.count(F.lit(1)).alias("_n"))
    edge = parts.groupBy(*k, "_b").agg(F.min("_start").alias("lo"), F.max("_end").alias("hi"),
                                       F.max("_start").alias("last"))
    # only the first and the last piece of a block can touch another block
    seam = Window.partitionBy(*k).orderBy("_start")
    rim = (parts.join(edge, [*k, "_b"]).where("_start = lo or _start = last")
           .withColumn("_prev", F.lag("_end").over(seam))
           .withColumn("_head", F.when(F.col("_prev").isNull() | (F.col("_start") - F.col("_prev") > gap)
                                       | (F.col("_start") != F.col("lo")), F.col("_start")))
           .withColumn("run", F.last("_head", ignorenulls=True).over(seam.rowsBetween(Window.unboundedPreceding, 0)))
           .select(*k, "_start", "run"))
    pieces = parts.join(rim, [*k, "_start"], "left").withColumn("run", F.coalesce("run", "_start"))
    inside = Window.partitionBy(*k, "run").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (pieces.withColumn("_off", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
              .withColumn("run_size", F.sum("_n").over(Window.partitionBy(*k, "run"))))
    if min_size > 1:
        pieces = pieces.where(F.col("run_size") >= min_size)
    rn = F.row_number().over(Window.partitionBy(*k, "_b", "_start").orderBy(order)) - 1
    return (local.join(pieces.select(*k, "_b", "_start", "run", "_off", "run_size"), [*k, "_b", "_start"])
            .withColumn("run_pos", rn + F.col("_off")).drop("_b", "_new", "_start", "_off"))


def representatives(runs: DataFrame) -> DataFrame:
    """The middle row (element n div 2) of each run."""
    return runs.where("run_pos = run_size div 2")


def top_n(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str] = KEYS, name: str = "rank") -> DataFrame:
    """First n rows per layer; Spark cuts each input partition to n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def ranked(df: DataFrame, value: str, keys: Sequence[str] = KEYS, name: str = "rank", descending: bool = True,
           tie: str = "ord", block: int = 1 << 14) -> DataFrame:
    """Exact 1-based rank by a numeric value, ties by ``tie``, without one task per layer.

    Rows are binned by value; a bin's offset is the count of the bins before it. Bins are
    equal steps of the layer's value range, so most bins are small.
    """
    k = list(keys)
    span = df.groupBy(*k).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    bins = F.least(F.lit(block - 1), F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * block))
    tagged = df.join(span, k).withColumn("_b", F.coalesce(bins, F.lit(0))).drop("_lo", "_hi")
    counts = tagged.groupBy(*k, "_b").agg(F.count(F.lit(1)).alias("_n"))
    way = F.col("_b").desc() if descending else F.col("_b")
    before = Window.partitionBy(*k).orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    v = F.col(value).desc() if descending else F.col(value)
    rn = F.row_number().over(Window.partitionBy(*k, "_b").orderBy(v, tie))
    return tagged.join(starts, [*k, "_b"]).withColumn(name, rn + F.col("_s")).drop("_b", "_s")


def exact_quantile(df: DataFrame, value: str, q: float, keys: Sequence[str] = KEYS, name: str = "quantile") -> DataFrame:
    """Exact interpolated quantile per group from value counts: equal values are folded first."""
    k = list(keys)
    vals = df.groupBy(*k, value).agg(F.count(F.lit(1)).alias("_w")).withColumn("ord", F.lit(0))
    span = df.groupBy(*k).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_all"))
    b = F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * 4096)
    tagged = vals.join(span, k).withColumn("_b", F.coalesce(b, F.lit(0)))
    counts = tagged.groupBy(*k, "_b").agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = (F.col("_all") - 1) * q
    lo, hi = F.floor(at), F.ceil(at)
    need = tagged.join(starts, [*k, "_b"]).where((F.col("_s") <= hi) & (F.col("_s") + F.col("_n") > lo))
    w = Window.partitionBy(*k, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = need.withColumn("_c", F.col("_s") + F.sum("_w").over(w))
    pick = upto.groupBy(*k).agg(F.min(F.when(F.col("_c") > lo, F.col(value))).alias("_a"),
                                F.min(F.when(F.col("_c") > hi, F.col(value))).alias("_z"),
                                F.first(at - lo).alias("_f"))
    return pick.select(*k, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias(name))
