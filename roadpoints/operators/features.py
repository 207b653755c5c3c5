"""Feature vectors, labels, scoring and classifier jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from roadpoints.functions.geom import bearing, dist
from roadpoints.operators import curves as K, stats as S
from roadpoints.operators.celljoin import KEYS, around, k_nearest, near_join, nearest
from roadpoints.operators.cuts import cut

# Confidence by mark class, reward by outcome.
CLASS_CONFIDENCE = {1: 0.9, 2: 0.7, 3: 0.8}
ACTIONS = {0: "keep", 1: "add_curve", 2: "delete"}
WEIGHTS_LIMIT = 1 << 22


def mark_features(sites: DataFrame, marks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``sites`` plus mark_class, confidence, counts per category in 50 m, nearest mark and mark density."""
    s = S.category_neighbourhood(S.mark_class(sites, marks, keys=keys), marks, keys=keys)
    return s.withColumn("confidence", S.choose("mark_class", CLASS_CONFIDENCE, 0.0))


def state_vectors(skel: DataFrame, marks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Skeleton points plus ``state``: 20 values - place, steps and bearings, share of the skeleton in 50 m, curvature,
    mark class one-hot, confidence, category counts, nearest mark, mark density, one zero."""
    s = K.steps(skel, keys)
    total = skel.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    s = around(s, skel, 50.0, {"_n": F.sum("r_w")}, keys).join(total, list(keys)).withColumn("share", F.col("_n") / F.col("_all"))
    s = mark_features(s, marks, keys)
    hot = [F.when(F.col("mark_class") == i, 1.0).otherwise(0.0) for i in range(4)]
    vals = [F.col(c) for c in ("x", "y", "prev_d", "prev_a", "next_d", "next_a", "share", "curvature")] + hot + [
        F.col(c).cast("double") for c in ("confidence", "n_intersection", "n_curve", "n_endpoint", "near_mark", "mark_density")]
    vals += [F.lit(0.0)] * (20 - len(vals))
    return s.withColumn("state", F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in vals])).drop("_n", "_all")


def basic_vector(points: DataFrame, skel: DataFrame, marks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus ``basic``: place, road count in 50 m and mean road length (steps between the vertices there, in their order, per
    road), five nearest marks, three densities, four place terms, confidence."""
    n = around(points, skel, 50.0, {"_k": F.sum("r_w")}, keys, default={"_k": 0})
    n = n.withColumn("road_count", F.when(F.col("_k") == 0, 0).otherwise(F.greatest(F.lit(1), F.expr("_k div 3"))))
    # a step leads from a vertex of the disc to the next one of the disc
    seen = near_join(points.select(*keys, "ord", "x", "y"), skel.select(*keys, "ord", "x", "y"), 50.0, keys)
    w = Window.partitionBy(*keys, "ord").orderBy("r_ord")
    step = seen.select(*keys, "ord", dist("r_x", "r_y", F.lead("r_x").over(w), F.lead("r_y").over(w)).alias("_d"))
    length = step.groupBy(*keys, "ord").agg(F.sum("_d").alias("_l"))
    n = n.join(length, [*keys, "ord"], "left").withColumn("road_length", F.when(F.col("road_count") > 0, F.coalesce("_l", F.lit(0.0)) / F.col("road_count")).otherwise(0.0)).drop("_k", "_l")
    n = S.local_density(k_nearest(n, marks, 5, keys).withColumnRenamed("near_d", "marks_d"), skel, keys=keys)
    n = category_confidence(n, marks, keys)
    x, y = F.col("x"), F.col("y")
    vals = [x, y, F.col("road_count").cast("double"), F.col("road_length"), *[F.col("marks_d")[i] for i in range(5)], *[F.col(f"density{r}") for r in (25, 50, 100)],
            F.pmod(x, F.lit(100.0)), F.pmod(y, F.lit(100.0)), F.pmod(x + y, F.lit(50.0)), F.pmod(F.abs(x - y), F.lit(30.0)), F.col("category_confidence")]
    return n.withColumn("basic", F.array(*vals, *[F.lit(0.0)] * (20 - len(vals))))


def category_confidence(points: DataFrame, marks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` plus category_confidence from the nearest mark of the same category: 0.9 below 20, 0.7 below 50, else 0.3;
    0.5 where the layer has no mark of that category."""
    k = [*keys, "category"]
    near = nearest(points, marks.select(*k, "ord", "x", "y"), cap=50.0, keys=k, strict=True).drop("near_ord", "near_x", "near_y")
    has = marks.select(*k).distinct().withColumn("_has", F.lit(True))
    d = F.col("near_d")
    c = F.when(d < 20, 0.9).when(d < 50, 0.7).when(F.col("_has"), 0.3).otherwise(0.5)
    return near.join(has, k, "left").withColumn("category_confidence", c).drop("near_d", "_has")


def three_class_labels(skel: DataFrame, curves: DataFrame, deleted: DataFrame, radius: float = 5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Label 2 where a deleted point is closer than ``radius``, else 1 where a curve is, else 0."""
    near = lambda df, marks, c: around(df, marks, radius, {c: F.lit(True) & (F.count(F.lit(1)) > 0)}, keys, strict=True, default={c: False})
    s = near(near(skel, deleted, "_d"), curves, "_c")
    return s.withColumn("label", F.when(F.col("_d"), 2).when(F.col("_c"), 1).otherwise(0)).drop("_d", "_c")


def four_class_labels(skel: DataFrame, labels: DataFrame, deleted: DataFrame, radius: float = 10.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Label 3 where a deleted point is closer than ``radius``, else the nearest curve (1) or endpoint (2), else 0."""
    two = labels.where("category in ('curve', 'endpoint')")
    s = around(skel, deleted, radius, {"_d": F.count(F.lit(1)) > 0}, keys, strict=True, default={"_d": False})
    pick = F.min(F.struct("d", F.when(F.col("r_category") == "curve", 1).otherwise(2).alias("c")))["c"]
    s = around(s, two, radius, {"_c": pick}, keys, ["category"], strict=True, default={"_c": 0})
    return s.withColumn("label", F.when(F.col("_d"), 3).otherwise(F.col("_c"))).drop("_d", "_c")


def action_labels(actions: DataFrame) -> DataFrame:
    """Edit actions as class labels: remove 2, added curve 1, any other addition 0."""
    return actions.withColumn("label", F.when(F.col("action") == "remove", 2).when(F.col("category") == "curve", 1).otherwise(0))


def reconstructed_edits(before: DataFrame, after: DataFrame, skel: DataFrame, gap: float = 20.0, every: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edits implied by two label sets: added (curve 1, other 0), removed (2), and every 50th skeleton point far from any label (0)."""
    from roadpoints.operators.sequence import with_position
    on = [*keys, "category", "x", "y"]
    added = after.join(before, on, "left_anti").select(*on, F.when(F.col("category") == "curve", 1).otherwise(0).alias("label"), F.lit("added").alias("source"))
    removed = before.join(after, on, "left_anti").select(*on, F.lit(2).alias("label"), F.lit("removed").alias("source"))
    thin = with_position(skel, keys).where(F.col("pos") % every == 0)
    calm = near_join(thin, after.select(*keys, "x", "y").distinct(), gap, keys, how="left_anti")
    return added.unionByName(removed).unionByName(calm.select(*keys, F.lit("curve").alias("category"), "x", "y", F.lit(0).alias("label"), F.lit("kept").alias("source")))


def junction_features(sites: DataFrame, skel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Junction sites plus skeleton points below 20 m, the nearest other site (1000 when none), sites below 100 m, spread of bearings."""
    from roadpoints.operators.sequence import neighbours, with_position
    nxt = neighbours(with_position(skel, keys), keys=keys).where("n1_x is not null").select(*keys, "ord", "x", "y", F.col("n1_x").alias("nx"), F.col("n1_y").alias("ny"))
    s = around(sites, skel, 20.0, {"skeleton_20": F.sum("r_w")}, keys, strict=True, default={"skeleton_20": 0})
    s = around(s, sites, 100.0, {"sites_100": F.sum("r_w")}, keys, strict=True, default={"sites_100": 0})
    s = nearest(cut(s), sites, keys=keys, skip_self=True)
    s = s.withColumn("nearest_site", F.coalesce("near_d", F.lit(1000.0))).drop("near_ord", "near_x", "near_y", "near_d")
    a = bearing("x", "y", "r_nx", "r_ny")
    return around(s, nxt, 30.0, {"bearing_spread": F.stddev_pop(a)}, keys, ["nx", "ny"], strict=True, default={"bearing_spread": 0.0})


def score_linear(states: DataFrame, weights: list[list[float]], bias: list[float], col: str = "state") -> DataFrame:
    """Scoring by one linear layer: adds q. The weights are a fixed small matrix, whose size is checked, and stand in the plan."""
    if 8 * len(weights) * len(bias) > WEIGHTS_LIMIT:
        raise ValueError("weights too large to ship with each task")

    def one(k):
        w = F.array(*[F.lit(float(row[k])) for row in weights])
        return F.aggregate(F.zip_with(F.col(col), w, lambda a, b: a * b), F.lit(float(bias[k])), lambda s, v: s + v)
    return states.withColumn("q", F.array(*[one(k) for k in range(len(bias))]))


def decide(scored: DataFrame, threshold: float = 0.7, by: str = "gap") -> DataFrame:
    """Adds action (first of the largest q), confidence (top gap or softmax) and ``sure``."""
    top = F.sort_array("q", asc=False)
    soft = 1 / F.aggregate("q", F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max("q")))
    conf = (top[0] - F.coalesce(F.get(top, 1), F.lit(0.0))) if by == "gap" else soft
    return (scored.withColumn("action", (F.array_position("q", F.array_max("q")) - 1).cast("int"))
            .withColumn("confidence", conf).withColumn("sure", F.col("confidence") >= threshold))


# Rewards of right predictions by class (0 normal, 1 intersection, 2 curve, 3 endpoint, 4 delete) and of the kinds of errors.
RIGHT = {0: 1.0, 1: 10.0, 2: 8.0, 3: 8.0, 4: 5.0}
MISSED, WRONG_DELETE, WRONG = -10.0, -15.0, -5.0


def reward(predicted: str = "action", truth: str = "truth") -> Column:
    """Reward of a prediction: of the class if right, else that of a missed intersection or endpoint, of a wrong deletion, of another error."""
    p, t = F.col(predicted), F.col(truth)
    right = F.coalesce(*[F.when(t == k, v) for k, v in RIGHT.items()], F.lit(RIGHT[0]))
    return F.when(p == t, right).when(t.isin(1, 3), MISSED).when(p == 4, WRONG_DELETE).otherwise(WRONG)


def split_rows(rows: DataFrame, keys: Sequence[str] = (*KEYS, "ord"), share: float = 0.8) -> DataFrame:
    """All rows with ``part``, train or test, by a hash of their keys."""
    h = F.pmod(F.xxhash64(*keys), F.lit(1_000_000))
    return rows.withColumn("part", F.when(h < int(share * 1_000_000), "train").otherwise("test"))


def fit_rows(rows: DataFrame, max_fit_rows: int = 10_000, keys: Sequence[str] = (*KEYS, "ord")) -> DataFrame:
    """The labelled rows a model is fitted on: at most ``max_fit_rows`` train rows, those of the smallest hashes. Scoring covers all rows."""
    h = F.xxhash64(F.lit("fit"), *keys)
    return rows.where("part = 'train'").withColumn("_h", h).orderBy("_h", *keys).limit(max_fit_rows).drop("_h")


def fit_forest(rows: DataFrame, features: Sequence[str], label: str = "label", trees: int = 50, depth: int = 10, seed: int = 42):
    """Keep/remove classifier."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    steps = [VectorAssembler(inputCols=list(features), outputCol="features"),
             RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]
    return _stored(Pipeline(stages=steps).fit(rows), rows.sparkSession)


def _stored(model, spark):
    """The model as read back from the shared folder: it no longer holds its training summary or the session."""
    import uuid
    from pyspark.ml import PipelineModel
    from roadpoints.session import shared_dir
    path = f"{shared_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return PipelineModel.load(path)


def fit_classifier(rows: DataFrame, label: str = "label", state: str = "state", classes: int = 3, layers: Sequence[int] = (256, 128, 64), iterations: int = 100, seed: int = 42):
    """Action classifier on state vectors: a multilayer perceptron over scaled values."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector
    steps = [StandardScaler(inputCol="raw", outputCol="features", withMean=True),
             MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[20, *layers, classes], maxIter=iterations, seed=seed)]
    return _stored(Pipeline(stages=steps).fit(rows.withColumn("raw", array_to_vector(state))), rows.sparkSession)
