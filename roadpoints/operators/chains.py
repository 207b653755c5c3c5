"""Chains of sites along a road graph, their straightness, and the curves that straight chains make redundant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from roadpoints.functions.geom import dist
from roadpoints.operators.celljoin import KEYS, nearest
from roadpoints.operators.fixpoint import components
from roadpoints.operators.cuts import cut, cut_counting, united


def site_graph(sites: DataFrame, nodes: DataFrame, edges: DataFrame, snap: float = 5.0, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(sites on nodes, edges between sites whose nodes are neighbours: u, v, w).

    A site stands on its nearest node closer than ``snap``; of several on one node the first by ``ord`` stands for it.
    Sites without a node are left out. x and y become those of the node.
    """
    k = list(keys)
    on = nearest(sites.select(*k, "ord", "x", "y"), nodes.select(*k, "ord", "x", "y"), cap=snap, keys=keys, strict=True).where("near_ord is not null")
    first = on.groupBy(*k, F.col("near_ord").alias("node")).agg(F.min("ord").alias("ord"))
    held = cut(first.join(nodes.select(*k, F.col("ord").alias("node"), "x", "y"), [*k, "node"]))
    a = held.select(*k, F.col("node").alias("u"), F.col("ord").alias("su"))
    b = held.select(*k, F.col("node").alias("v"), F.col("ord").alias("sv"))
    e = edges.where("u <> v").join(a, [*k, "u"]).join(b, [*k, "v"])
    pair = e.groupBy(*k, F.least("su", "sv").alias("u"), F.greatest("su", "sv").alias("v")).agg(F.min("w").alias("w"))
    return held.select(*k, "ord", "x", "y"), pair


def _stops(both: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes where chains end: those without exactly two neighbours, and the smallest node of each closed ring."""
    k = list(keys)
    degree = cut(both.groupBy(*k, F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n")))
    inner = degree.where("n = 2").select(*k, "node")
    named = components(degree.select(*k, "node"), edges.select(*k, "u", "v"), keys)
    rings = named.join(degree, [*k, "node"]).groupBy(*k, "component").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    rings = rings.where("lo = 2 and hi = 2").select(*k, F.col("component").alias("node"))
    return degree.join(inner.join(rings, [*k, "node"], "left_anti"), [*k, "node"], "left_anti").select(*k, "node")


def chains(edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sites of each chain: start, second, pos (from 0), ord, measure (length from the start), is_loop.

    A chain runs between two sites that have one neighbour, or three and more, over sites with two; it is named by its start, the
    smaller end, and the site after it. A ring of its own starts at its smallest site, and from there to the smaller
    neighbour. A site of three and more neighbours stands in every chain that ends there; a chain that comes back to its start holds it once.
    ``edges`` (u, v, w) list each pair once; sites without edges have no chain.

    Every edge is taken in both directions, and each direction learns its end by pointer doubling, so a chain of n sites
    takes log2(n) rounds; all joins are on single edges.
    """
    k = list(keys)
    edges = cut(edges.where("u <> v"))
    both = united([edges.select(*k, "u", "v", "w"), edges.select(*k, F.col("v").alias("u"), F.col("u").alias("v"), "w")])
    stop = cut(_stops(both, edges, keys))
    ends = both.join(stop.withColumnRenamed("node", "v"), [*k, "v"], "left_semi").select(
        *k, "u", "v", F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("w").alias("d"), F.lit(1).cast("long").alias("h"), F.lit(True).alias("done"))
    on = both.select(*k, F.col("u").alias("v"), F.col("v").alias("pv"))
    runs = both.join(stop.withColumnRenamed("node", "v"), [*k, "v"], "left_anti").join(on, [*k, "v"]).where("pv <> u").select(
        *k, "u", "v", F.col("v").alias("pu"), "pv", F.col("w").alias("d"), F.lit(1).cast("long").alias("h"), F.lit(False).alias("done"))
    state, left = cut_counting(ends.unionByName(runs), F.count_if(~F.col("done")))
    while left:
        far = state.select(*k, F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("pu").alias("qu"), F.col("pv").alias("qv"), F.col("d").alias("fd"), F.col("h").alias("fh"), F.col("done").alias("fdone"))
        moved = state.where("not done").join(far, [*k, "pu", "pv"]).select(
            *k, "u", "v", F.col("qu").alias("pu"), F.col("qv").alias("pv"), (F.col("d") + F.col("fd")).alias("d"), (F.col("h") + F.col("fh")).alias("h"), F.col("fdone").alias("done"))
        state, left = cut_counting(state.where("done").unionByName(moved), F.count_if(~F.col("done")))
    back = state.select(*k, F.col("u").alias("v"), F.col("v").alias("u"), F.col("pv").alias("start"), F.col("pu").alias("second"), F.col("d").alias("measure"), F.col("h").alias("pos"))
    step = state.select(*k, "u", "v", F.col("pv").alias("last"), F.col("pu").alias("before")).join(back, [*k, "u", "v"])
    step = step.where("start < last or (start = last and second < before)").withColumn("is_loop", F.col("start") == F.col("last"))
    name = [*k, "start", "second"]
    first = step.where("pos = 1").select(*name, F.lit(0).cast("long").alias("pos"), F.col("u").alias("ord"), F.lit(0.0).alias("measure"), "is_loop")
    return first.unionByName(step.where("not is_loop or v <> start").select(*name, "pos", F.col("v").alias("ord"), "measure", "is_loop"))


def chain_shape(chain: DataFrame, sites: DataFrame, keys: Sequence[str] = KEYS, ratio: float = 0.92) -> DataFrame:
    """Per chain: sites, length, chord, ratio and straight (three sites or more and a ratio of at least ``ratio``; a length of 0 counts as straight)."""
    k = list(keys)
    at = chain.join(sites.select(*k, "ord", "x", "y"), [*k, "ord"])
    p = F.struct("x", "y")
    # the start of a chain that comes back is its end too
    s = at.groupBy(*k, "start", "second").agg(F.count(F.lit(1)).alias("sites"), F.max("measure").alias("length"), F.min_by(p, "pos").alias("a"), F.max_by(p, "pos").alias("b"))
    s = s.withColumn("chord", dist("a.x", "a.y", "b.x", "b.y")).drop("a", "b")
    s = s.withColumn("ratio", F.when(F.col("length") == 0, 1.0).otherwise(F.col("chord") / F.col("length")))
    return s.withColumn("straight", (F.col("sites") >= 3) & (F.col("ratio") >= ratio))


def without_redundant(sites: DataFrame, nodes: DataFrame, edges: DataFrame, snap: float = 5.0, ratio: float = 0.92, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of ``sites`` (with ``category``) that stay: curves inside a straight chain go, its two ends and all other categories stay."""
    k = list(keys)
    held, pair = site_graph(sites, nodes, edges, snap, keys)
    chain = cut(chains(pair, keys))
    shape = chain_shape(chain, held, keys, ratio).where("straight").select(*k, "start", "second", "sites")
    inner = chain.join(shape, [*k, "start", "second"]).where("pos > 0 and pos < sites - 1").select(*k, "ord").distinct()
    gone = inner.withColumn("category", F.lit("curve"))
    return sites.join(gone, [*k, "ord", "category"], "left_anti")
