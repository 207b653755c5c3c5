"""Queries on features, labels and predictions."""

from __future__ import annotations


from pyspark.sql import functions as F

from roadpoints.operators import features as M
from roadpoints.plans import tables as T
from roadpoints.plans.neighbour_queries import COUNTS, MARKS
from roadpoints.plans.registry import query
from roadpoints.plans.sequence_queries import LL, POS
from roadpoints.plans.tables import sql

R6 = lambda c: F.round(c, 6)
NEAR = lambda a, b, r, op="<": f"{b}.x BETWEEN {a}.x - {r} AND {a}.x + {r} AND {b}.y BETWEEN {a}.y - {r} AND {a}.y + {r} AND sqrt(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2) {op} {r}"


@query("m01_state_vectors", sql("points skeleton", f"""{POS}, {LL}, {MARKS}, cls AS (SELECT s.layer_id, s.ord, min(CASE p.category WHEN 'intersection' THEN 1 WHEN 'curve' THEN 2 ELSE 3 END) AS c FROM skeleton s JOIN points p ON p.layer_id = s.layer_id AND {NEAR('s', 'p', 5)} GROUP BY ALL),
    sh AS (SELECT s.layer_id, s.ord, count(*) AS k FROM skeleton s JOIN skeleton p ON p.layer_id = s.layer_id AND {NEAR('s', 'p', 50, '<=')} GROUP BY ALL)
    SELECT layer_id, ord, round(coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0), 6) AS f3, round(coalesce(atan2(ny - y, nx - x), 0), 6) AS f6, round(k / n, 6) AS f7,
      CASE WHEN coalesce(c, 0) = 1 THEN 1.0 ELSE 0.0 END AS f10, CASE coalesce(c, 0) WHEN 0 THEN 0.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.8 END AS f13, n_curve::DOUBLE AS f15,
      round(least(near_mark, 1000.0), 6) AS f17, round((n_intersection + n_curve + n_endpoint) / (pi() * 2500) * 1000, 6) AS f18, 0.0 AS f20
    FROM v JOIN mk USING (layer_id, ord) JOIN sh USING (layer_id, ord) LEFT JOIN cls USING (layer_id, ord)"""))
def m01(spark, sf):
    s, v = M.state_vectors(T.skeleton(spark, sf), T.points(spark, sf)), F.col("state")
    return s.select("layer_id", "ord", *[R6(v[i - 1]).alias(f"f{i}") for i in (3, 6, 7, 10, 13, 15, 17, 18, 20)])


@query("m02_mark_features", sql("points skeleton", f"""{MARKS}, cls AS (SELECT s.layer_id, s.ord, min(CASE p.category WHEN 'intersection' THEN 1 WHEN 'curve' THEN 2 ELSE 3 END) AS c FROM skeleton s JOIN points p ON p.layer_id = s.layer_id AND {NEAR('s', 'p', 5)} GROUP BY ALL)
    SELECT layer_id, ord, coalesce(c, 0) AS mark_class, CASE coalesce(c, 0) WHEN 0 THEN 0.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.8 END AS confidence, n_curve::BIGINT AS n_curve FROM mk LEFT JOIN cls USING (layer_id, ord)"""))
def m02(spark, sf):
    return M.mark_features(T.skeleton(spark, sf), T.points(spark, sf)).select("layer_id", "ord", "mark_class", "confidence", "n_curve")


@query("m03_basic_vector", sql("points skeleton", f"""{COUNTS}, v AS (SELECT p.layer_id, p.ord, s.x, s.y, lead(s.x) OVER w AS nx, lead(s.y) OVER w AS ny FROM points p JOIN skeleton s ON s.layer_id = p.layer_id AND {NEAR('p', 's', 50, '<=')}
      WINDOW w AS (PARTITION BY p.layer_id, p.ord ORDER BY s.ord)), l AS (SELECT layer_id, ord, sum(coalesce(sqrt((x - nx) ** 2 + (y - ny) ** 2), 0)) AS len FROM v GROUP BY ALL)
    SELECT p.layer_id, p.ord, CASE WHEN n50 = 0 THEN 0.0 ELSE greatest(1, n50 // 3) END::DOUBLE AS f3, round(CASE WHEN n50 = 0 THEN 0.0 ELSE coalesce(len, 0) / greatest(1, n50 // 3) END, 6) AS f4, round(n25 / (pi() * 625) * 10000, 6) AS f10,
    round(p.x % 100, 6) AS f13, round((p.x + p.y) % 50, 6) AS f15, round(abs(p.x - p.y) % 30, 6) AS f16 FROM points p JOIN cnt USING (layer_id, ord) LEFT JOIN l USING (layer_id, ord)"""))
def m03(spark, sf):
    p, v = T.points(spark, sf), F.col("basic")
    return M.basic_vector(p, T.skeleton(spark, sf), p).select("layer_id", "ord", *[R6(v[i - 1]).alias(f"f{i}") for i in (3, 4, 10, 13, 15, 16)])


@query("m04_category_confidence", sql("labels_before labels_after", """SELECT a.layer_id, a.ord, CASE WHEN min(d) < 20 THEN 0.9 WHEN min(d) < 50 THEN 0.7 ELSE 0.3 END AS confidence FROM (
    SELECT a.layer_id, a.ord, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM labels_after a JOIN labels_before b ON a.layer_id = b.layer_id AND a.category = b.category) a GROUP BY ALL"""))
def m04(spark, sf):
    return M.category_confidence(T.labels_after(spark, sf), T.labels_before(spark, sf)).select("layer_id", "ord", F.col("category_confidence").alias("confidence"))


@query("m05_three_class_labels", sql("points skeleton", f"""SELECT s.layer_id, s.ord, CASE WHEN EXISTS (SELECT 1 FROM points p WHERE p.layer_id = s.layer_id AND p.kind = 'error' AND {NEAR('s', 'p', 5)}) THEN 2
    WHEN EXISTS (SELECT 1 FROM points p WHERE p.layer_id = s.layer_id AND p.category = 'curve' AND {NEAR('s', 'p', 5)}) THEN 1 ELSE 0 END AS label FROM skeleton s"""))
def m05(spark, sf):
    p = T.points(spark, sf)
    return M.three_class_labels(T.skeleton(spark, sf), p.where("category = 'curve'"), p.where("kind = 'error'")).select("layer_id", "ord", "label")


@query("m06_four_class_labels", sql("points skeleton", f"""c AS (SELECT s.layer_id, s.ord, arg_min(CASE p.category WHEN 'curve' THEN 1 ELSE 2 END, sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2)) AS c FROM skeleton s JOIN points p ON p.layer_id = s.layer_id AND p.category <> 'intersection' AND {NEAR('s', 'p', 10)} GROUP BY ALL)
    SELECT s.layer_id, s.ord, CASE WHEN EXISTS (SELECT 1 FROM points p WHERE p.layer_id = s.layer_id AND p.kind = 'error' AND {NEAR('s', 'p', 10)}) THEN 3 ELSE coalesce(c, 0) END AS label FROM skeleton s LEFT JOIN c USING (layer_id, ord)"""))
def m06(spark, sf):
    p = T.points(spark, sf)
    return M.four_class_labels(T.skeleton(spark, sf), p, p.where("kind = 'error'")).select("layer_id", "ord", "label")


@query("m07_action_labels", sql("actions", "SELECT label, count(*) AS n, count(DISTINCT session_id) AS sessions FROM (SELECT *, CASE WHEN action = 'remove' THEN 2 WHEN category = 'curve' THEN 1 ELSE 0 END AS label FROM actions) GROUP BY ALL"))
def m07(spark, sf):
    return M.action_labels(T.actions(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


@query("m08_endpoint_labels", sql("points skeleton", f"SELECT s.layer_id, s.ord FROM skeleton s WHERE EXISTS (SELECT 1 FROM points p WHERE p.layer_id = s.layer_id AND p.category = 'endpoint' AND {NEAR('s', 'p', 5)})"))
def m08(spark, sf):
    from roadpoints.operators.celljoin import near_join
    return near_join(T.skeleton(spark, sf), T.points(spark, sf).where("category = 'endpoint'").select("layer_id", "x", "y"), 5.0, strict=True, how="left_semi").select("layer_id", "ord")


@query("m09_reconstructed_edits", sql("labels_before labels_after skeleton", f"""{POS}, e AS (SELECT layer_id, 'added' AS source, CASE category WHEN 'curve' THEN 1 ELSE 0 END AS label FROM labels_after ANTI JOIN labels_before USING (layer_id, category, x, y) UNION ALL
    SELECT layer_id, 'removed', 2 FROM labels_before ANTI JOIN labels_after USING (layer_id, category, x, y) UNION ALL
    SELECT layer_id, 'kept', 0 FROM s WHERE pos % 50 = 0 AND NOT EXISTS (SELECT 1 FROM labels_after p WHERE p.layer_id = s.layer_id AND {NEAR('s', 'p', 20, '<=')}))
    SELECT layer_id, source, label, count(*) AS n FROM e GROUP BY ALL"""))
def m09(spark, sf):
    e = M.reconstructed_edits(T.labels_before(spark, sf), T.labels_after(spark, sf), T.skeleton(spark, sf))
    return e.groupBy("layer_id", "source", "label").agg(F.count(F.lit(1)).alias("n"))


@query("e42_junction_features", sql("points skeleton", f"""j AS (SELECT * FROM points WHERE category = 'intersection'), {POS}, {LL}, a AS (SELECT j.layer_id, j.ord, stddev_pop(atan2(v.ny - j.y, v.nx - j.x)) AS sp FROM j JOIN v ON v.layer_id = j.layer_id AND v.nx IS NOT NULL AND {NEAR('j', 'v', 30)} GROUP BY ALL),
    k AS (SELECT j.layer_id, j.ord, count(*) AS c FROM j JOIN skeleton s ON s.layer_id = j.layer_id AND {NEAR('j', 's', 20)} GROUP BY ALL),
    o AS (SELECT j.layer_id, j.ord, min(CASE WHEN j.ord <> b.ord THEN sqrt((j.x - b.x) ** 2 + (j.y - b.y) ** 2) END) AS near, count_if(sqrt((j.x - b.x) ** 2 + (j.y - b.y) ** 2) < 100)::BIGINT AS n FROM j JOIN j b USING (layer_id) GROUP BY ALL)
    SELECT layer_id, ord, coalesce(c, 0) AS skeleton_20, round(coalesce(near, 1000.0), 6) AS nearest_site, n AS sites_100, round(coalesce(sp, 0), 5) AS bearing_spread FROM o LEFT JOIN k USING (layer_id, ord) LEFT JOIN a USING (layer_id, ord)"""))
def e42(spark, sf):
    j = M.junction_features(T.points(spark, sf).where("category = 'intersection'"), T.skeleton(spark, sf))
    return j.select("layer_id", "ord", "skeleton_20", R6("nearest_site").alias("nearest_site"), "sites_100", F.round("bearing_spread", 5).alias("bearing_spread"))


@query("m12_decisions", sql("predictions", """SELECT vec_id, action, round(confidence, 6) AS confidence, confidence >= 0.1 AS sure,
    round(1 / (exp(q[1] - list_max(q)) + exp(q[2] - list_max(q)) + exp(q[3] - list_max(q))), 6) AS softmax FROM predictions"""))
def m12(spark, sf):
    p = M.decide(T.predictions(spark, sf).drop("action", "confidence"), 0.1)
    soft = 1 / F.aggregate("q", F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max("q")))
    return p.select("vec_id", "action", R6("confidence").alias("confidence"), "sure", R6(soft).alias("softmax"))


@query("m12_linear_scores", sql("predictions", "SELECT vec_id, round(q[1] * 0.5 - q[2] + 0.1, 6) AS q0, round(q[1] + q[2] * 0.25 + q[3] * 2.0 - 0.2, 6) AS q1 FROM predictions"))
def m12_linear(spark, sf):
    s = M.score_linear(T.predictions(spark, sf).select("vec_id", F.col("q").alias("state")), [[0.5, 1.0], [-1.0, 0.25], [0.0, 2.0]], [0.1, -0.2])
    return s.select("vec_id", R6(F.col("q")[0]).alias("q0"), R6(F.col("q")[1]).alias("q1"))


@query("m13_rewards", """WITH e AS (SELECT label % 5 AS truth, [list_reduce(list_prepend(0.0::DOUBLE, list_filter(embedding, lambda v, i: (i - 1) % 5 = k)::DOUBLE[]), lambda a, b: a + b) for k in [0, 1, 2, 3, 4]] AS q FROM embeddings),
    p AS (SELECT truth, (list_position(q, list_max(q)) - 1)::INT AS action FROM e)
    SELECT action, truth, count(*) AS n, round(sum(CASE WHEN action = truth THEN [1.0, 10.0, 8.0, 8.0, 5.0][truth + 1] WHEN truth IN (1, 3) THEN -10.0 WHEN action = 4 THEN -15.0 ELSE -5.0 END)::DOUBLE, 6) AS reward FROM p GROUP BY ALL""")
def m13(spark, sf):
    return T.predictions(spark, sf, 5).withColumn("r", M.reward()).groupBy("action", "truth").agg(F.count(F.lit(1)).alias("n"), R6(F.sum("r")).alias("reward"))


@query("m10_junction_classifier", sql("points", "SELECT CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END AS label, count(*) AS n, count(*) AS decided FROM points WHERE category = 'intersection' GROUP BY ALL"))
def m10(spark, sf):
    """Every junction is scored; the SQL checks that, by label, and leaves the learned decisions to the tests."""
    from roadpoints.operators.cuts import cut
    j = M.junction_features(T.points(spark, sf).where("category = 'intersection'"), T.skeleton(spark, sf))
    rows = cut(M.split_rows(j.withColumn("label", F.when(F.col("kind") == "purchase", 1).otherwise(0))))
    out = M.fit_forest(M.fit_rows(rows), ["skeleton_20", "nearest_site", "sites_100", "bearing_spread"]).transform(rows)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction").isin(0.0, 1.0)).alias("decided"))


@query("m14_split_rows", sql("points", "SELECT count(*) AS n, true AS near_share FROM points"))
def m14(spark, sf):
    s = M.split_rows(T.points(spark, sf))
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("part") == "train", 1.0).otherwise(0.0)).between(0.77, 0.83).alias("near_share"))


@query("m11_action_classifier", sql("points skeleton", f"""l AS (SELECT s.layer_id, s.ord, CASE WHEN EXISTS (SELECT 1 FROM points p WHERE p.layer_id = s.layer_id AND p.kind = 'error' AND {NEAR('s', 'p', 5)}) THEN 2
    WHEN EXISTS (SELECT 1 FROM points p WHERE p.layer_id = s.layer_id AND p.category = 'curve' AND {NEAR('s', 'p', 5)}) THEN 1 ELSE 0 END AS label FROM skeleton s) SELECT label, count(*) AS n, count(*) AS decided FROM l GROUP BY ALL"""))
def m11(spark, sf):
    """Every row is scored by a model fitted on a bounded number of train rows; the SQL checks all-row counts and label totals."""
    from pyspark.ml.functions import array_to_vector
    from roadpoints.operators.cuts import cut
    p = T.points(spark, sf)
    s = M.three_class_labels(M.state_vectors(T.skeleton(spark, sf), p), p.where("category = 'curve'"), p.where("kind = 'error'"))
    rows = cut(M.split_rows(s.select("layer_id", "ord", "state", "label")))
    model = M.fit_classifier(M.fit_rows(rows), layers=(32, 16), iterations=20)
    out = model.transform(rows.withColumn("raw", array_to_vector("state")))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction").isin(0.0, 1.0, 2.0)).alias("decided"))


@query("m16_candidate_features", sql("reference_points points", f"""SELECT r.layer_id, r.ord, round(min(d), 6) AS nearest, count_if(d BETWEEN 40 AND 60)::BIGINT AS ring, count_if(d <= 50)::BIGINT AS n50, count_if(d <= 100)::BIGINT AS n100
    FROM (SELECT r.layer_id, r.ord, sqrt((r.x - p.x) * (r.x - p.x) + (r.y - p.y) * (r.y - p.y)) AS d FROM reference_points r JOIN points p USING (layer_id)) r WHERE d <= 100 GROUP BY ALL"""))
def m16(spark, sf):
    from roadpoints.operators.celljoin import around, count_if
    d = F.col("d")
    a = around(T.reference_points(spark, sf), T.points(spark, sf), 100.0, {"nearest": R6(F.min("d")), "ring": count_if(d.between(40, 60)), "n50": count_if(d <= 50), "n100": count_if(d <= 100)})
    return a.select("layer_id", "ord", "nearest", "ring", "n50", "n100")
