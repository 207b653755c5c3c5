"""Rows made by an explode: dealt out over tasks, never broadcast by their size before it."""

import re

import pytest
from pyspark.sql import functions as F

from roadpoints.operators import fixpoint, select
from roadpoints.operators.celljoin import near_join, pairs_within
from roadpoints.operators.links import lines_near
from roadpoints.operators.sequence import framed, with_position
from roadpoints.plans import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture
def uncoalesced(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_layers_are_dealt_out(spark):
    # coalescing is on: the few bytes of the layers would make one task of all that is exploded from them
    assert T.layers(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_layer_that_comes_in_one_task_is_dealt_by_block(spark, uncoalesced):
    rows = spark.range(200_000).select(F.lit(7).cast("long").alias("layer_id"), F.col("id").alias("ord"), F.col("id").cast("double").alias("x"))
    one = rows.groupBy("layer_id", "ord").agg(F.first("x").alias("x")).repartition(4, "layer_id")
    most = lambda df: df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most(one) == 200_000
    s = with_position(one)
    assert most(s) < 200_000
    dense = one.withColumn("pos", F.col("ord"))
    near = framed(dense, lambda w: {"p": F.lag("x").over(w), "n": F.lead("x").over(w)}, 1, 1)
    assert most(near) < 200_000
    assert near.where("p = x - 1 and n = x + 1").count() == 199_998


@pytest.mark.parametrize("join", [
    lambda p, r: near_join(p, p, 30.0),
    lambda p, r: pairs_within(p, 0.0, 30.0),
    lambda p, r: lines_near(p, r, 30.0),
])
def test_spread_rows_are_not_broadcast(spark, join):
    plan = join(T.points(spark, SF), T.streets(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_rows_that_compress_well_are_not_broadcast(spark):
    from roadpoints.operators.cuts import cut, united
    rows = spark.range(200_000).select(F.lit(7).cast("long").alias("layer_id"), F.floor(F.col("id") / 1000).alias("ord"))
    many, few = cut(rows), cut(rows.limit(10))
    assert "SortMergeJoin" in joins(rows.join(many, ["layer_id", "ord"], "left_semi"))
    assert "SortMergeJoin" in joins(rows.join(united([many, few]), ["layer_id", "ord"], "left_semi"))
    assert "BroadcastHashJoin" in joins(rows.join(few, ["layer_id", "ord"], "left_semi"))


@pytest.mark.parametrize("table", [T.streets, T.skeleton, T.bends, T.outline, T.outline_edges, T.street_edges])
def test_tables_made_by_an_explode_are_not_broadcast(spark, table):
    plan = joins(T.points(spark, SF).join(table(spark, SF).select("layer_id"), "layer_id"))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("table", [T.points, T.actions, T.reference_points, T.labels_after])
def test_points_are_not_broadcast_by_the_size_of_their_file(spark, table):
    many = spark.range(10_000_000).withColumnRenamed("id", "ord")
    plan = joins(many.join(table(spark, SF).select("ord", "x", "y"), "ord"))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("left", [
    lambda p, r: near_join(p, p.where("category = 'endpoint'"), 5.0, how="left_anti"),
    lambda p, r: select.skeleton_degree_filter(p, r),
    lambda p, r: select.best_of_group(p),
    lambda p, r: fixpoint.spaced(p, 30.0),
    lambda p, r: fixpoint.thin_pairs(p, 15.0),
])
def test_rows_that_a_semi_join_left_are_not_broadcast(spark, left):
    many = spark.range(10_000_000).withColumnRenamed("id", "ord")
    plan = joins(many.join(left(T.points(spark, SF), T.streets(spark, SF)).select("ord", "x", "y"), "ord"))
    assert re.search(r"\w+Join", plan).group() == "SortMergeJoin"


def test_the_open_layers_of_collinear_curves_are_not_broadcast(spark, monkeypatch):
    seen, near = [], select.rows_near_links
    monkeypatch.setattr(select, "rows_near_links", lambda links, rows, *a: [seen.append(rows), near(links, rows, *a)][1])
    select.collinear_curve(T.points(spark, SF), T.streets(spark, SF))
    many = spark.range(10_000_000).withColumnRenamed("id", "ord")
    assert seen and all(re.search(r"\w+Join", joins(many.join(rows.select("ord", "x", "y"), "ord"))).group() == "SortMergeJoin" for rows in seen)
