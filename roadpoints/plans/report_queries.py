"""Queries on cleaning, names, label sets, sessions, predictions and summaries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from roadpoints.functions import text as X
from roadpoints.functions.geom import dist, line_length
from roadpoints.operators import clean as P
from roadpoints.operators.celljoin import near_join, pairs_within
from roadpoints.plans import tables as T
from roadpoints.plans.link_queries import pair_sql
from roadpoints.plans.neighbour_queries import D
from roadpoints.plans.registry import query
from roadpoints.plans.tables import sql

R6 = lambda c: F.round(c, 6)
N = lambda: F.count(F.lit(1))


@query("p01_geometry_audit", sql("shapes", """SELECT layer_id, geom_type, count(*) AS total, 0 AS empty, count_if(kind IN (3, 4))::BIGINT AS short, count_if(kind IN (1, 3, 4) AND side > 0)::BIGINT AS unclosed FROM shapes GROUP BY ALL"""))
def p01(spark, sf):
    return P.audit(T.shapes(spark, sf))


@query("p02_p03_valid_shapes", sql("shapes", """SELECT layer_id, shape_id, CASE WHEN kind = 3 THEN 4 ELSE 5 END AS vertices, round(CASE WHEN kind = 3 THEN side * side / 2 ELSE side * side END, 4) AS area
    FROM shapes WHERE kind < 4 AND side > 0"""))
def p02(spark, sf):
    return P.valid_shapes(T.shapes(spark, sf)).select("layer_id", "shape_id", F.size("ring").alias("vertices"), F.round("area", 4).alias("area"))


@query("p03_rejects", sql("shapes", "SELECT layer_id, shape_id FROM shapes WHERE kind = 4 OR side = 0"))
def p03(spark, sf):
    return P.rejects(T.shapes(spark, sf)).select("layer_id", "shape_id")


@query("p04_polygon_parts", sql("shapes", "SELECT layer_id, shape_id, CAST(row_number() OVER (PARTITION BY layer_id ORDER BY shape_id) AS INT) AS polygon_index FROM shapes"))
def p04(spark, sf):
    multi = T.shapes(spark, sf).groupBy("layer_id").agg(F.array_sort(F.collect_list(F.struct("shape_id", "ring"))).alias("parts"))
    return P.explode_parts(multi).select("layer_id", F.col("ring.shape_id").alias("shape_id"), "polygon_index")


@query("p05_split_by_type", sql("shapes", "SELECT geom_type, count(*) AS n FROM shapes GROUP BY ALL"))
def p05(spark, sf):
    return T.shapes(spark, sf).select(F.explode_outer(F.array("geom_type")).alias("geom_type")).groupBy("geom_type").agg(N().alias("n"))


@query("p06_ring_lines", sql("shapes", "SELECT layer_id, sum(CASE kind WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 2 ELSE 1 END)::BIGINT AS edges, round(sum(CASE kind WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 1 + sqrt(2) ELSE 1 END * side), 4) AS length FROM shapes GROUP BY ALL"))
def p06(spark, sf):
    return P.ring_lines(T.shapes(spark, sf)).groupBy("layer_id").agg(N().alias("edges"), F.round(F.sum(dist("x1", "y1", "x2", "y2")), 4).alias("length"))


VALID = "valid AS (SELECT layer_id, shape_id, round(CASE WHEN kind = 3 THEN side * side / 2 ELSE side * side END, 4) AS area FROM shapes WHERE kind < 4 AND side > 0)"


def valid(spark, sf):
    return P.valid_shapes(T.shapes(spark, sf)).select("layer_id", "shape_id", F.round("area", 4).alias("area"))


@query("p08_size_outliers", sql("shapes", f"""{VALID}, s AS (SELECT layer_id, stddev_pop(area) AS sd, avg(area) AS m, quantile_cont(area, 0.05) AS q FROM valid GROUP BY ALL)
    SELECT layer_id, shape_id FROM valid JOIN s USING (layer_id) WHERE sd < 0.5 * m OR area >= q"""))
def p08(spark, sf):
    return P.drop_small_outliers(valid(spark, sf)).select("layer_id", "shape_id")


@query("p09_fragments", sql("shapes", f"""{VALID}, t AS (SELECT layer_id, CASE WHEN count_if(area >= 10) > 0 THEN 10 WHEN count_if(area >= 50) > 0 THEN 50 WHEN count_if(area >= 100) > 0 THEN 100 ELSE 0 END AS t FROM valid GROUP BY ALL)
    SELECT layer_id, shape_id FROM valid JOIN t USING (layer_id) WHERE area >= t"""))
def p09(spark, sf):
    return P.drop_fragments(valid(spark, sf)).select("layer_id", "shape_id")


@query("p10_belt_round_trip", sql("points", "SELECT layer_id, ord, round(x, 4) AS x, round(y, 4) AS y FROM points"))
def p10(spark, sf):
    p = T.points(spark, sf).withColumns({"x": F.col("x") + 220000, "y": F.col("y") + 300000})
    back = P.convert(P.convert(p, "EPSG:5186", "EPSG:5187"), "EPSG:5187", "EPSG:5186")
    return back.select("layer_id", "ord", F.round(F.col("x") - 220000, 4).alias("x"), F.round(F.col("y") - 300000, 4).alias("y"))


# by form of T.NAMES: form, province, county, district, short and full province, region names, code by region, code by name
_FORMS = ("""(0, 1, '전북', '남원시', '강석#지구', '전북특별자치도', '남원시', 'EPSG:5186', 'EPSG:5186'), (1, 2, '전북특별자치도', '김제시', '만경1,#지구', '전북특별자치도', '김제시', 'EPSG:5186', 'EPSG:5186'),
    (2, 4, '인천', '남동구', '고잔#지구', '인천광역시', '남동구', 'EPSG:5186', 'EPSG:5186'), (3, 6, '광주시', '검복#지구', '미확인', '광주광역시', '광주시', 'EPSG:5186', 'EPSG:5186'),
    (4, 7, '오산시', '고현동', '고현#지구', NULL, '오산시', 'EPSG:5186', NULL), (5, 1, '강원', '강릉시', '교동#지구', '강원특별자치도', '강릉시', 'EPSG:5187', 'EPSG:5187'),
    (6, 1, '강원', '원주시', '단구#지구', '강원특별자치도', '원주시', 'EPSG:5186', 'EPSG:5186'), (7, 1, '경북', '울릉군', '도동#지구', '경상북도', '울릉군', 'EPSG:5188', 'EPSG:5187'),
    (8, NULL, NULL, NULL, NULL, NULL, NULL, 'EPSG:5186', NULL), (9, 1, '경남', '고성군', '석지#지구', '경상남도', '고성군', 'EPSG:5187', 'EPSG:5187'),
    (10, 1, '용인시', '기흥구', '언남#지구', NULL, '용인시,기흥구,언남#지구', 'EPSG:5186', NULL), (11, 4, '인천', '서남동구', '고잔#지구', '인천광역시', '서남동구', 'EPSG:5186', 'EPSG:5186')""")
FORMS = f"""w(kind, form, province, county, district, sido, names, by_region, detected) AS (VALUES {_FORMS}),
    f AS (SELECT d.file_id, d.file_name, d.acct, w.form, w.province, replace(w.county, '#', d.file_id::VARCHAR) AS county, replace(w.district, '#', d.file_id::VARCHAR) AS district, w.sido, w.names, w.by_region, w.detected FROM district_names d JOIN w USING (kind))"""


@query("p11_p12_region_codes", sql("district_names", f"""{FORMS} SELECT file_id, by_region, CASE WHEN acct > 5000 THEN 'EPSG:5187' ELSE detected END AS detected FROM f"""))
def p11(spark, sf):
    f = T.district_names(spark, sf)
    own = F.when(F.col("acct") > 5000, "EPSG:5187").otherwise("EPSG:4326")
    county = F.get(X.region_names(F.col("file_name")), 0)
    return f.select("file_id", X.region_crs(X.province_of(F.col("file_name")), county).alias("by_region"), X.detect_crs(own, F.col("file_name")).alias("detected"))


@query("p14_name_forms", sql("district_names", f"{FORMS} SELECT file_id, form, province, county, district FROM f"))
def p14(spark, sf):
    f = T.district_names(spark, sf).withColumn("p", X.name_parts(F.col("file_name")))
    return f.select("file_id", X.name_form(F.col("file_name")).alias("form"), "p.province", "p.county", "p.district")


@query("p13_region_names", sql("district_names", f"{FORMS} SELECT file_id, sido, split_part(coalesce(names, ''), ',', 1) AS first_name FROM f"))
def p13_regions(spark, sf):
    f = T.district_names(spark, sf)
    return f.select("file_id", X.province_of(F.col("file_name")).alias("sido"), F.coalesce(F.get(X.region_names(F.col("file_name")), 0), F.lit("")).alias("first_name"))


@query("p13_f06_names", sql("file_names", """SELECT file_id, trim(regexp_replace(regexp_replace(file_name, '[\\[\\]()_\\-.]+', ' ', 'g'), '\\s+', ' ', 'g')) AS clean, file_name AS stem FROM file_names"""))
def p13(spark, sf):
    f = T.file_names(spark, sf)
    path = F.concat(F.lit("in/"), "file_name", F.lit("_현황_폴리곤.shp"))
    return f.select("file_id", X.clean_name(F.col("file_name")).alias("clean"), X.stem(path).alias("stem"))


@query("e37_name_histogram", sql("district_names", f"""{FORMS} SELECT province, county, count(*) AS files FROM f GROUP BY ROLLUP (province, county)"""))
def e37(spark, sf):
    p = T.district_names(spark, sf).select(X.name_parts(F.col("file_name")).alias("p")).select("p.*")
    return p.rollup("province", "county").agg(N().alias("files"))


@query("s03_j13_catalogue_match", sql("district_names district_catalog", """w(kind, sido, sigungu, priority) AS (VALUES (0, '전북특별자치도', '남원시', 1), (1, '전북특별자치도', '김제시', 1), (2, '인천광역시', '남동구', 2), (3, '경기도', '광주시', 1), (4, '경기도', '오산시', 1),
    (5, '강원특별자치도', '강릉시', 1), (6, '강원특별자치도', '원주시', 1), (7, '경상북도', '울릉군', 1), (9, '강원특별자치도', '고성군', 1), (10, '경기도', '기흥구', 2), (11, '인천광역시', '남동구', 3))
    SELECT file_id, path, priority FROM district_names JOIN w USING (kind) JOIN district_catalog USING (sido, sigungu)"""))
def j13(spark, sf):
    from roadpoints.operators.clip import match_catalogue
    f = T.district_names(spark, sf).select("file_id", X.region_names(F.col("file_name")).alias("names"))
    return match_catalogue(f, T.district_catalog(spark, sf)).select("file_id", "path", "priority")


@query("p16_line_samples", sql("points", f"{pair_sql(15.0, 30.0)} SELECT layer_id, ord1, ord2, k::INT AS k, round(x1 + (x2 - x1) * k / 10.0, 6) AS x, round(y1 + (y2 - y1) * k / 10.0, 6) AS y FROM pairs, range(11) r(k)"))
def p16(spark, sf):
    s = pairs_within(T.points(spark, sf), 15.0, 30.0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10))))
    at = lambda a, b: R6(F.col(a) + (F.col(b) - F.col(a)) * F.col("k") / 10.0)
    return s.select("layer_id", "ord1", "ord2", "k", at("x1", "x2").alias("x"), at("y1", "y2").alias("y"))


@query("p17_every_kth_vertex", sql("shapes", "SELECT layer_id, shape_id, k::INT AS pos FROM shapes, range(6) r(k) WHERE k < CASE kind WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 3 ELSE 2 END AND k % 2 = 0"))
def p17(spark, sf):
    return T.shapes(spark, sf).select("layer_id", "shape_id", F.posexplode("ring").alias("pos", "v")).where("pos % 2 = 0").select("layer_id", "shape_id", "pos")


@query("p18_candidate_sites", sql("skeleton", """l AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM skeleton WINDOW w AS (PARTITION BY layer_id, road_id ORDER BY ord))
    SELECT DISTINCT layer_id, x, y FROM l WHERE nx IS NOT NULL"""))
def p18(spark, sf):
    from roadpoints.operators.clip import candidate_sites
    return candidate_sites(T.skeleton(spark, sf)).select("layer_id", "x", "y")


@query("p19_rounded_dedupe", sql("skeleton", "SELECT layer_id, min(ord) AS ord, round(x, 3) AS x, round(y, 3) AS y FROM skeleton GROUP BY layer_id, round(x, 3), round(y, 3)"))
def p19(spark, sf):
    return T.skeleton(spark, sf).groupBy("layer_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y")).agg(F.min("ord").alias("ord"))


@query("p21_point_list", sql("points", "SELECT layer_id, ord, category, row_number() OVER (PARTITION BY layer_id, category ORDER BY ord) - 1 AS original_index FROM points"))
def p21(spark, sf):
    from roadpoints.operators.sequence import with_position
    return with_position(T.points(spark, sf), ["layer_id", "category"], name="original_index").select("layer_id", "ord", "category", "original_index")


@query("p22_pixel_mapping", sql("points", "SELECT layer_id, ord, CAST(floor(x) AS BIGINT) AS col, CAST(floor(2001 - y) AS BIGINT) AS row_, floor(x) + 0.5 AS px, 2001 - (floor(2001 - y) + 0.5) AS py FROM points"))
def p22(spark, sf):
    c, r = F.floor("x"), F.floor(2001 - F.col("y"))
    return T.points(spark, sf).select("layer_id", "ord", c.alias("col"), r.alias("row_"), (c + 0.5).alias("px"), (2001 - (r + 0.5)).alias("py"))


@query("p24_vertex_estimate", sql("shapes", "SELECT layer_id, greatest(1, sum(CASE kind WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 3 ELSE 2 END)::BIGINT // 20) AS estimate FROM shapes GROUP BY ALL"))
def p24(spark, sf):
    return T.shapes(spark, sf).groupBy("layer_id").agg(F.sum(F.size("ring")).alias("v")).select("layer_id", F.expr("greatest(1L, v div 20)").alias("estimate"))


@query("p07_road_bands", sql("streets", "SELECT layer_id, road_id, half_width, round(2001.0 * 2 * half_width, 6) AS band_area FROM streets"))
def p07(spark, sf):
    return T.streets(spark, sf).select("layer_id", "road_id", "half_width", R6(dist("x1", "y1", "x2", "y2") * 2 * F.col("half_width")).alias("band_area"))


# label sets

@query("u01_u02_label_changes", sql("labels_before labels_after", """c AS (SELECT coalesce(a.layer_id, b.layer_id) AS layer_id, coalesce(a.category, b.category) AS category, count_if(b.ord IS NULL)::BIGINT AS added, count_if(a.ord IS NULL)::BIGINT AS removed, count_if(a.ord IS NOT NULL AND b.ord IS NOT NULL)::BIGINT AS kept
      FROM labels_after a FULL JOIN labels_before b ON a.layer_id = b.layer_id AND a.category = b.category AND a.x = b.x AND a.y = b.y GROUP BY 1, 2)
    SELECT *, round(added + removed * 0.8 - kept * 0.1, 6) AS score FROM c"""))
def u01(spark, sf):
    on = ["layer_id", "category", "x", "y"]
    a = T.labels_after(spark, sf).select(*on).distinct().withColumn("a", F.lit(1))
    b = T.labels_before(spark, sf).select(*on).distinct().withColumn("b", F.lit(1))
    c = a.join(b, on, "full_outer").groupBy("layer_id", "category").agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"),
                                                                         F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"))
    return c.withColumn("score", R6(F.col("added") + F.col("removed") * 0.8 - F.col("kept") * 0.1))


@query("u03_detector_union", sql("labels_before labels_after", f"""SELECT layer_id, x, y, category FROM labels_before WHERE category <> 'intersection' UNION ALL SELECT a.layer_id, a.x, a.y, a.category FROM labels_after a WHERE a.category = 'intersection'
    AND NOT EXISTS (SELECT 1 FROM labels_before b WHERE b.layer_id = a.layer_id AND b.category = 'endpoint' AND {D('a', 'b')} < 20)"""))
def u03(spark, sf):
    b, a = T.labels_before(spark, sf), T.labels_after(spark, sf)
    new = near_join(a.where("category = 'intersection'"), b.where("category = 'endpoint'").select("layer_id", "x", "y"), 20.0, strict=True, how="left_anti")
    c = ["layer_id", "x", "y", "category"]
    return b.where("category <> 'intersection'").select(*c).unionByName(new.select(*c))


@query("u04_distinct_places", sql("skeleton", "SELECT layer_id, count(*) AS places FROM (SELECT DISTINCT layer_id, x, y FROM skeleton) GROUP BY ALL"))
def u04(spark, sf):
    return T.skeleton(spark, sf).dropDuplicates(["layer_id", "x", "y"]).groupBy("layer_id").agg(N().alias("places"))


@query("e32_filter_statistics", sql("labels_before points", """n AS (SELECT layer_id, count(*) AS original FROM points GROUP BY ALL), m AS (SELECT layer_id, count(*) AS kept FROM labels_before GROUP BY ALL)
    SELECT layer_id, original, kept, original - kept AS removed, round((original - kept) / original, 6) AS removal_rate, round(kept / original, 6) AS retention_rate FROM n JOIN m USING (layer_id)"""))
def e32(spark, sf):
    n = T.points(spark, sf).groupBy("layer_id").agg(N().alias("original"))
    m = T.labels_before(spark, sf).groupBy("layer_id").agg(N().alias("kept"))
    rate = lambda c: R6(F.coalesce(c / F.nullif("original", F.lit(0)), F.lit(0.0)))
    j = n.join(m, "layer_id", "left").fillna({"kept": 0}).withColumn("removed", F.col("original") - F.col("kept"))
    return j.withColumns({"removal_rate": rate(F.col("removed")), "retention_rate": rate(F.col("kept"))})


@query("e27_layer_summary", sql("points", """SELECT layer_id, count_if(category = 'intersection')::BIGINT AS intersection, count_if(category = 'curve')::BIGINT AS curve, count_if(category = 'endpoint')::BIGINT AS endpoint,
    count(*) AS total, round(avg(count(*)) OVER (), 6) AS batch_mean FROM points GROUP BY ALL"""))
def e27(spark, sf):
    p = T.points(spark, sf).groupBy("layer_id").pivot("category", ["intersection", "curve", "endpoint"]).agg(N()).fillna(0)
    p = p.withColumn("total", F.col("intersection") + F.col("curve") + F.col("endpoint"))
    mean = p.agg(R6(F.avg("total")).alias("batch_mean"))
    return p.crossJoin(F.broadcast(mean))  # one row


@query("e38_edit_comparison", sql("labels_before labels_after", """a AS (SELECT layer_id, category, count(*) AS ai FROM labels_before GROUP BY ALL), u AS (SELECT layer_id, category, count(*) AS edited FROM labels_after GROUP BY ALL)
    SELECT layer_id, category, coalesce(ai, 0) AS ai, coalesce(edited, 0) AS edited, coalesce(edited, 0) - coalesce(ai, 0) AS difference, round(abs(coalesce(edited, 0) - coalesce(ai, 0)) / nullif(ai, 0), 6) AS rate FROM a FULL JOIN u USING (layer_id, category)"""))
def e38(spark, sf):
    both = T.labels_before(spark, sf).withColumn("s", F.lit("ai")).unionByName(T.labels_after(spark, sf).withColumn("s", F.lit("edited")))
    p = both.groupBy("layer_id", "category").pivot("s", ["ai", "edited"]).agg(N()).fillna(0).withColumn("difference", F.col("edited") - F.col("ai"))
    return p.withColumn("rate", R6(F.abs("difference") / F.nullif("ai", F.lit(0))))


@query("e29_action_distribution", sql("actions", "SELECT action, category, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM actions GROUP BY ALL"))
def e29(spark, sf):
    c = T.actions(spark, sf).groupBy("action", "category").agg(N().alias("n"))
    # the window is over one row per action and category
    return c.withColumn("percent", R6(100 * F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("e28_e45_session_statistics", sql("points", """SELECT layer_id, count(*) AS points, count(DISTINCT category) AS categories, 'points' AS mode FROM points GROUP BY ALL"""))
def e28(spark, sf):
    from roadpoints.sources.sessions import from_points
    s = from_points(T.points(spark, sf))
    n = F.aggregate(F.map_values("labels"), F.lit(0).cast("long"), lambda a, v: a + F.size(v))
    return s.select("layer_id", n.alias("points"), F.size("labels").cast("long").alias("categories"), F.coalesce(F.element_at("metadata", F.lit("file_mode")), F.lit("unknown")).alias("mode"))


@query("s05_f09_session_round_trip", sql("points", "SELECT layer_id, category, count(*) AS n, round(sum(x), 4) AS sum_x FROM points GROUP BY ALL"))
def s05(spark, sf):
    from roadpoints.sources import sessions as Z
    docs = Z.from_points(T.points(spark, sf)).select("layer_id", F.to_json(F.struct(*Z.SESSION.fieldNames())).alias("doc"))
    back = docs.select("layer_id", F.from_json("doc", Z.SESSION).alias("s"))
    rows = back.select("layer_id", F.explode("s.labels").alias("category", "pts")).select("layer_id", "category", F.explode("pts").alias("p"))
    return rows.groupBy("layer_id", "category").agg(N().alias("n"), F.round(F.sum(F.col("p")[0]), 4).alias("sum_x"))


@query("e33_prediction_statistics", sql("predictions", "SELECT action, count(*) AS n, round(avg(confidence), 6) AS mean_c, round(stddev_pop(confidence), 6) AS std_c, round(min(confidence), 6) AS min_c, round(max(confidence), 6) AS max_c FROM predictions GROUP BY ALL"))
def e33(spark, sf):
    c = F.col("confidence")
    return T.predictions(spark, sf).groupBy("action").agg(N().alias("n"), R6(F.avg(c)).alias("mean_c"), R6(F.stddev_pop(c)).alias("std_c"), R6(F.min(c)).alias("min_c"), R6(F.max(c)).alias("max_c"))


@query("e34_accuracy", sql("predictions", "SELECT truth, count(*) AS n, round(avg((action = truth)::INT), 6) AS accuracy FROM predictions GROUP BY ROLLUP (truth)"))
def e34(spark, sf):
    return T.predictions(spark, sf).rollup("truth").agg(N().alias("n"), R6(F.avg((F.col("action") == F.col("truth")).cast("int"))).alias("accuracy"))


@query("e35_metric_summary", sql("actions", "SELECT session_id, round(min(x), 6) AS min_v, round(arg_max(x, ord), 6) AS last_v, round(avg(x), 6) AS mean_v FROM actions GROUP BY ALL"))
def e35(spark, sf):
    return T.actions(spark, sf).groupBy("session_id").agg(R6(F.min("x")).alias("min_v"), R6(F.max_by("x", "ord")).alias("last_v"), R6(F.avg("x")).alias("mean_v"))


@query("e36_outcome_report", sql("file_names", "SELECT CASE WHEN acct < 0 THEN 'error' WHEN acct < 1000 THEN 'skip' ELSE 'success' END AS status, count(*) AS n FROM file_names GROUP BY ALL"))
def e36(spark, sf):
    s = F.when(F.col("acct") < 0, "error").when(F.col("acct") < 1000, "skip").otherwise("success")
    return T.file_names(spark, sf).groupBy(s.alias("status")).agg(N().alias("n")).orderBy(F.desc("n"))


@query("l03_top_histogram", sql("actions", "SELECT session_id, count(*) AS n FROM actions GROUP BY ALL ORDER BY n DESC, session_id LIMIT 20"))
def l03(spark, sf):
    return T.actions(spark, sf).groupBy("session_id").agg(N().alias("n")).orderBy(F.desc("n"), "session_id").limit(20)


@query("j31_predicted_vs_table", sql("points labels_before", """p AS (SELECT layer_id, count(*) AS predicted FROM points WHERE category <> 'endpoint' GROUP BY ALL), t AS (SELECT layer_id, count(*) AS expected FROM labels_before WHERE category = 'intersection' GROUP BY ALL)
    SELECT layer_id, predicted, expected, predicted - expected AS difference, CASE WHEN expected IS NULL THEN 'no table' ELSE 'ok' END AS status FROM p LEFT JOIN t USING (layer_id)"""))
def j31(spark, sf):
    from roadpoints.operators.clip import compare_counts
    p = T.points(spark, sf).where("category <> 'endpoint'").groupBy("layer_id").agg(N().alias("predicted"))
    t = T.labels_before(spark, sf).where("category = 'intersection'").groupBy("layer_id").agg(N().alias("expected"))
    return compare_counts(p, t)


@query("e43_connection_report", sql("points", f"""{pair_sql(0.0, 30.0)}, e AS (SELECT layer_id, ord1 AS ord, ord2 AS o FROM pairs UNION ALL SELECT layer_id, ord2, ord1 FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY layer_id, ord ORDER BY o) AS k FROM e)
    SELECT layer_id, ord, count(*) AS connections, string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (k <= 3) AS first_three FROM r GROUP BY layer_id, ord"""))
def e43(spark, sf):
    from roadpoints.operators.links import both_ways
    e = both_ways(pairs_within(T.points(spark, sf), 0.0, 30.0))
    w = Window.partitionBy("layer_id", "ord").orderBy("other")
    few = e.withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("layer_id", "ord").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("other")), lambda v: v.cast("string"))).alias("first_three"))
    return e.groupBy("layer_id", "ord").agg(N().alias("connections")).join(few, ["layer_id", "ord"])


@query("e44_f07_distance_label", sql("points", f"{pair_sql(0.0, 20.0)} SELECT layer_id, count(*) AS links, printf('%.1fm', avg(d)) AS mean_label, printf('%.1fm', min(d)) AS min_label, printf('%.1fm', max(d)) AS max_label FROM pairs GROUP BY ALL"))
def e44(spark, sf):
    d = F.col("d")
    return pairs_within(T.points(spark, sf), 0.0, 20.0).groupBy("layer_id").agg(N().alias("links"), X.distance_label(F.avg(d)).alias("mean_label"), X.distance_label(F.min(d)).alias("min_label"), X.distance_label(F.max(d)).alias("max_label"))


@query("e30_skeleton_spacing", sql("skeleton", """s AS (SELECT layer_id, x, y, count(*) AS w FROM skeleton GROUP BY ALL), p AS (SELECT a.layer_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, a.w * b.w AS k FROM s a JOIN s b ON a.layer_id = b.layer_id AND (a.x, a.y) < (b.x, b.y)
      AND abs(a.x - b.x) <= 10 AND abs(a.y - b.y) <= 10)
    SELECT layer_id, sum(k) FILTER (d <= 10)::BIGINT AS within_10, coalesce(sum(k) FILTER (d <= 5), 0)::BIGINT AS within_5 FROM p GROUP BY ALL"""))
def e30(spark, sf):
    from roadpoints.operators.celljoin import fold_copies
    # copies of a place are one weighted row, so crowded places do not list their pairs
    s = fold_copies(T.skeleton(spark, sf))
    p = pairs_within(s, 0.0, 10.0, ["x", "y", "w"]).withColumn("k", F.col("w1") * F.col("w2"))
    return p.groupBy("layer_id").agg(F.sum("k").alias("within_10"), F.coalesce(F.sum(F.when(F.col("d") <= 5, F.col("k"))), F.lit(0)).alias("within_5"))


@query("f01_f04_scalar_geometry", sql("points", """SELECT layer_id, ord, round(sqrt(x * x + y * y) * 1.5, 6) AS scaled, round(degrees(atan2(y, x)), 6) AS bearing, round(degrees(acos(greatest(-1, least(1, x / nullif(sqrt(x * x + y * y), 0))))), 5) AS angle FROM points"""))
def f01(spark, sf):
    from roadpoints.functions.geom import bearing, vector_angle
    z = F.lit(0.0)
    return T.points(spark, sf).select("layer_id", "ord", R6(dist("x", "y", z, z, 1.5)).alias("scaled"), R6(F.degrees(bearing(z, z, "x", "y"))).alias("bearing"),
                                      F.round(F.degrees(vector_angle("x", "y", F.lit(1.0), z)), 5).alias("angle"))


@query("f05_place_exists", sql("points reference_points", f"SELECT r.layer_id, r.ord, EXISTS (SELECT 1 FROM points p WHERE p.layer_id = r.layer_id AND {D('r', 'p')} < 5) AS taken FROM reference_points r"))
def f05(spark, sf):
    from roadpoints.operators.celljoin import around
    return around(T.reference_points(spark, sf), T.points(spark, sf), 5.0, {"taken": F.count(F.lit(1)) > 0}, strict=True, default={"taken": False}).select("layer_id", "ord", "taken")


@query("f02_line_length", sql("shapes", "SELECT shape_id, round(CASE kind WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 1 + sqrt(2) ELSE 1 END * side, 4) AS length FROM shapes"))
def f02(spark, sf):
    return T.shapes(spark, sf).select("shape_id", F.round(line_length(F.col("ring")), 4).alias("length"))


@query("f08_day_age", sql("actions", "SELECT ord, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, epoch_us(TIMESTAMP '2024-03-01') // 86400000000 - epoch_us(ts) // 86400000000 AS day_age FROM actions"))
def f08(spark, sf):
    return T.actions(spark, sf).select("ord", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.datediff(F.lit("2024-03-01").cast("date"), F.col("ts").cast("date")).cast("long").alias("day_age"))


@query("f10_content_key", sql("file_names", "SELECT file_id, md5(file_name || '_' || file_id) AS key FROM file_names"))
def f10(spark, sf):
    return T.file_names(spark, sf).select("file_id", X.content_key(F.col("file_name"), F.col("file_id").cast("string")).alias("key"))


@query("x01_custom_filter", sql("points", "SELECT layer_id, ord FROM points WHERE x > y"))
def x01(spark, sf):
    from roadpoints.operators.clip import custom_filter
    return custom_filter(T.points(spark, sf), lambda df, lead: df.where(F.col("x") > F.col("y") + lead), lead=0.0).select("layer_id", "ord")


# edit log

@query("t01_t04_session_context", sql("actions", """SELECT session_id, ord, round((epoch_us(ts) - min(epoch_us(ts)) OVER p) / 1e6, 6) AS relative_time, count(*) OVER w AS edits,
    round(count(*) OVER w / greatest((epoch_us(ts) - min(epoch_us(ts)) OVER p) / 1e6, 1.0) * 60, 6) AS edit_rate FROM actions WINDOW p AS (PARTITION BY session_id), w AS (PARTITION BY session_id ORDER BY ts, ord ROWS UNBOUNDED PRECEDING)"""))
def t01(spark, sf):
    from roadpoints.streaming.actions import session_context
    c = session_context(T.actions(spark, sf))
    return c.select("session_id", "ord", F.round("relative_time", 6).alias("relative_time"), "edits", R6("edit_rate").alias("edit_rate"))


@query("t02_latest_actions", sql("actions", "SELECT session_id, ord FROM actions QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, ord DESC) <= 5000"))
def t02(spark, sf):
    """The newest 5,000 actions of each session: the length of the log is the feature, the whole log stays in ``actions``."""
    from roadpoints.operators.sequence import top_n
    return top_n(T.actions(spark, sf), 5000, [F.desc("ts"), F.desc("ord")], ["session_id"]).select("session_id", "ord")


@query("t03_session_spans", sql("actions", """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM actions WINDOW w AS (PARTITION BY session_id ORDER BY ts, ord)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY ts, ord) AS k FROM g) SELECT session_id, min(epoch_us(ts)) AS start_us, count(*) AS edits FROM s GROUP BY session_id, k"""))
def t03(spark, sf):
    a = T.actions(spark, sf)
    return a.groupBy("session_id", F.session_window("ts", "6 hours").alias("w")).agg(N().alias("edits")).select("session_id", F.unix_micros("w.start").alias("start_us"), "edits")


@query("t05_action_classes", sql("actions", "SELECT ord, CASE WHEN action = 'remove' THEN 2 WHEN category = 'curve' THEN 1 ELSE 0 END AS label FROM actions"))
def t05(spark, sf):
    from roadpoints.operators.features import action_labels
    return action_labels(T.actions(spark, sf)).select("ord", "label")


@query("t06_current_points", sql("actions", "SELECT session_id, category, x, y FROM actions GROUP BY ALL HAVING arg_max(action, ord) = 'add'"))
def t06(spark, sf):
    from roadpoints.streaming.actions import current_points
    return current_points(T.actions(spark, sf)).select("session_id", "category", "x", "y")


@query("t08_edit_activity", sql("actions", "SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS start_us, action, count(*) AS n FROM actions GROUP BY ALL"))
def t08(spark, sf):
    a = T.actions(spark, sf)
    return a.groupBy(F.window("ts", "5 minutes").alias("w"), "action").agg(N().alias("n")).select(F.unix_micros("w.start").alias("start_us"), "action", "n")
