"""The derived tables every registered query reads, in Spark and as SQL text.

All are computed from the given Parquet tables, so they grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpoints.operators.cuts import unfolded, united


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category_of(kind: str = "event_type"):
    return (F.when(F.col(kind).isin("purchase", "error"), "intersection")
            .when(F.col(kind) == "signup", "endpoint").otherwise("curve"))


def instant(spark: SparkSession):
    """The zone-less event time as a UTC instant, whatever the session's zone."""
    if spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC"):
        return F.col("ts").cast("timestamp")
    return F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")


def micros(spark: SparkSession):
    return F.unix_micros(instant(spark))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,000 points per layer, spread over 2,001 m x 2,001 m."""
    return unfolded(read(spark, sf_dir, "events")).select(
        F.expr("event_id div 1000").alias("layer_id"), F.col("event_id").alias("ord"),
        (F.expr("pmod(event_id * 7919, 20011)") / 10.0).alias("x"),
        (F.pmod(micros(spark), F.lit(20011)) / 10.0).alias("y"),
        category_of().alias("category"), F.col("event_type").alias("kind"))


def layers(spark, sf_dir) -> DataFrame:
    """The layers, dealt out evenly.

    Without that, a layer's few bytes are coalesced to one partition by layer_id, and all rows made from it, and all
    windows by layer_id and more columns after it, stay in that one task.
    """
    found = read(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("layer_id")).distinct()
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def streets(spark, sf_dir) -> DataFrame:
    """A grid of 11 x 11 streets per layer, 200 m apart, 12 m wide."""
    k = F.explode(F.sequence(F.lit(0), F.lit(10)))
    g = layers(spark, sf_dir).withColumn("k", k)
    flat = g.select("layer_id", F.col("k").cast("long").alias("road_id"), F.lit(0.0).alias("x1"), (F.col("k") * 200.0).alias("y1"),
                    F.lit(2001.0).alias("x2"), (F.col("k") * 200.0).alias("y2"), F.lit(6.0).alias("half_width"))
    tall = g.select("layer_id", (F.col("k") + 100).cast("long").alias("road_id"), (F.col("k") * 200.0).alias("x1"), F.lit(0.0).alias("y1"),
                    (F.col("k") * 200.0).alias("x2"), F.lit(2001.0).alias("y2"), F.lit(6.0).alias("half_width"))
    return united([flat, tall])


def skeleton(spark, sf_dir) -> DataFrame:
    """Street centre lines as points 10 m apart, in scan order by ord."""
    j = streets(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(200))))
    flat = F.col("road_id") < 100
    return j.select("layer_id", (F.col("road_id") * 1000 + F.col("j")).alias("ord"), "road_id",
                    F.when(flat, F.col("j") * 10.0).otherwise(F.col("x1")).alias("x"),
                    F.when(flat, F.col("y1")).otherwise(F.col("j") * 10.0).alias("y"))


def waves(spark, sf_dir) -> DataFrame:
    """Winding roads: the level streets bent to 50 sin(x / 50)."""
    return skeleton(spark, sf_dir).where("road_id < 100").withColumn("y", F.col("y") + 50 * F.sin(F.col("x") / 50))


def bends(spark, sf_dir) -> DataFrame:
    """Winding roads of both directions: every street bent to a sine of 50 m across its run."""
    flat, s = F.col("road_id") < 100, skeleton(spark, sf_dir)
    return s.select("layer_id", "ord", "road_id", (F.col("x") + F.when(flat, 0.0).otherwise(50 * F.sin(F.col("y") / 50))).alias("x"),
                    (F.col("y") + F.when(flat, 50 * F.sin(F.col("x") / 50)).otherwise(0.0)).alias("y"))


# The dissolved road area of a layer: one outer ring with cut corners, counter-clockwise, and 100 holes, clockwise, whose corners lie
# 6 m to 40 m off the street lines, each by its own amount, so roads are slanted and of changing width.
RIM = ((0, -6), (2001, -6), (2001, 0), (2006, 0), (2006, 2001), (2001, 2001), (2001, 2006), (0, 2006), (0, 2001), (-6, 2001), (-6, 0), (0, 0))


def outline(spark, sf_dir) -> DataFrame:
    """Vertices of the rings of the road area, unclosed; ``ord`` runs through the layer."""
    g = layers(spark, sf_dir)
    rim = g.select("layer_id", F.posexplode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in RIM])).alias("ord", "v"))
    rim = rim.select("layer_id", F.lit(0).cast("long").alias("ring"), F.col("ord").cast("long").alias("ord"), "v.x", "v.y")
    hole = g.select("layer_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(100).cast("long"))).alias("ring")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(3))))
    off = lambda a, b, c: 6.0 + F.pmod(F.col("layer_id") * a + F.col("ring") * b + F.col("c") * c, F.lit(35))
    left, low = F.expr("(ring - 1) div 10") * 200, F.expr("(ring - 1) % 10") * 200
    return united([rim, hole.select("layer_id", "ring", (F.col("ring") * 100 + F.col("c")).alias("ord"),
                                    F.when(F.col("c") < 2, left + off(31, 17, 7)).otherwise(left + 200 - off(31, 17, 7)).alias("x"),
                                    F.when(F.col("c").isin(0, 3), low + off(13, 29, 11)).otherwise(low + 200 - off(13, 29, 11)).alias("y"))])


def outline_edges(spark, sf_dir) -> DataFrame:
    """The edges of ``outline``, road on the left."""
    ends = F.struct("ord", "x", "y")
    v = outline(spark, sf_dir).groupBy("layer_id", "ring").agg(F.sort_array(F.collect_list(ends)).alias("v"))
    e = v.select("layer_id", "ring", F.posexplode(F.arrays_zip(F.col("v").alias("a"), F.expr("concat(slice(v, 2, size(v)), slice(v, 1, 1))").alias("b"))).alias("k", "e"))
    return unfolded(e).select("layer_id", "ring", F.col("e.a.ord").alias("edge_id"), F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def street_edges(spark, sf_dir) -> DataFrame:
    """The four edges of each street's band, counter-clockwise; bands overlap at crossings."""
    s = streets(spark, sf_dir)
    flat, w = F.col("road_id") < 100, F.col("half_width")
    lo_x, hi_x = F.when(flat, F.col("x1")).otherwise(F.col("x1") - w), F.when(flat, F.col("x2")).otherwise(F.col("x2") + w)
    lo_y, hi_y = F.when(flat, F.col("y1") - w).otherwise(F.col("y1")), F.when(flat, F.col("y2") + w).otherwise(F.col("y2"))
    side = lambda k, *p: F.struct(F.lit(k).alias("k"), *[c.alias(n) for c, n in zip(p, ("x1", "y1", "x2", "y2"))])
    e = s.select("layer_id", F.col("road_id").alias("ring"), F.explode(F.array(side(0, lo_x, lo_y, hi_x, lo_y), side(1, hi_x, lo_y, hi_x, hi_y),
                                                                               side(2, hi_x, hi_y, lo_x, hi_y), side(3, lo_x, hi_y, lo_x, lo_y))).alias("e"))
    return e.select("layer_id", "ring", (F.col("ring") * 4 + F.col("e.k")).alias("edge_id"), "e.x1", "e.y1", "e.x2", "e.y2")


def districts(spark, sf_dir) -> DataFrame:
    return layers(spark, sf_dir).select("layer_id", F.lit(100.0).alias("minx"), F.lit(100.0).alias("miny"),
                                        F.lit(1900.0).alias("maxx"), F.lit(1900.0).alias("maxy"))


def reference_points(spark, sf_dir) -> DataFrame:
    """Known sites: the purchase points, moved by (3, 4), so the source is 5 m away."""
    return points(spark, sf_dir).where("kind = 'purchase'").select(
        "layer_id", "ord", (F.col("x") + 3).alias("x"), (F.col("y") + 4).alias("y"))


def labels_before(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).where("kind <> 'view'")


def labels_after(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).where("kind <> 'error'")


def actions(spark, sf_dir) -> DataFrame:
    """Edit log: one session per user; an error event removes its point, any other adds it."""
    return unfolded(read(spark, sf_dir, "events")).select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), instant(spark).alias("ts"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"),
        category_of().alias("category"),
        (F.expr("pmod(event_id * 7919, 20011)") / 10.0).alias("x"), (F.pmod(micros(spark), F.lit(20011)) / 10.0).alias("y"))


def predictions(spark, sf_dir, classes: int = 3) -> DataFrame:
    """Scores of classes: class k has the sum of the vector's values at positions k, k + classes, ..."""
    at = lambda k: F.aggregate(F.filter("embedding", lambda v, i: i % classes == k), F.lit(0.0), lambda s, v: s + v.cast("double"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % classes).alias("truth"), F.array(*[at(k) for k in range(classes)]).alias("q"))
    top = F.sort_array("q", asc=False)
    return e.select("vec_id", "truth", "q", (F.array_position("q", F.array_max("q")) - 1).cast("int").alias("action"),
                    (top[0] - top[1]).alias("confidence"))


# File names and catalogue rows by number: all name forms with a match, both kinds of no match, every step of the catalogue match.
NAMES = ("'25년_전북_남원시_강석{}지구_현황_폴리곤", "'25년도 전북특별자치도 김제시 만경1,{}지구_현황_폴리곤", "25년도_인천_남동구_고잔{}지구_현황_폴리곤", "25년_광주시_검복{}지구_현황_폴리곤",
         "25년_오산시 고현동_고현{}지구_현황_폴리곤", "`25년_강원_강릉시_교동{}지구_현황_폴리곤", "25년_강원_원주시_단구{}지구_현황_폴리곤", "25년_경북_울릉군_도동{}지구_현황_폴리곤",
         "survey {}", "25년_경남_고성군_석지{}지구_현황_폴리곤", "25년_용인시_기흥구_언남{}지구_현황_폴리곤", "25년도_인천_서남동구_고잔{}지구_현황_폴리곤")
CATALOG = ("전북특별자치도/남원시", "전북특별자치도/김제시", "인천광역시/남동구", "경기도/광주시", "경기도/오산시", "강원특별자치도/강릉시", "강원특별자치도/원주시", "경상북도/울릉군",
           "경상남도/고성군", "강원특별자치도/고성군", "경기도/기흥구", "부산광역시/기장군")


def district_names(spark, sf_dir) -> DataFrame:
    """One district file per supplier; ``kind`` is the number of its form in NAMES."""
    kind = F.pmod("s_suppkey", F.lit(len(NAMES))).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), kind + 1)
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.replace(name, F.lit("{}"), F.col("s_suppkey").cast("string")).alias("file_name"), kind.alias("kind"), F.col("s_acctbal").alias("acct"))


def district_catalog(spark, sf_dir) -> DataFrame:
    place = F.split(F.element_at(F.array(*[F.lit(n) for n in CATALOG]), F.pmod("n_nationkey", F.lit(len(CATALOG))).cast("int") + 1), "/")
    return read(spark, sf_dir, "nation").select(place[0].alias("sido"), place[1].alias("sigungu"), F.concat_ws("/", place[0], F.concat(place[1], F.lit(".shp"))).alias("path")).distinct()


def road_catalog(spark, sf_dir) -> DataFrame:
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.replace("r_name", F.lit(" "), F.lit("_")).alias("sido"), F.col("n_name").alias("sigungu"),
        F.concat_ws("/", "r_name", F.concat("n_name", F.lit(".shp"))).alias("path"))


def file_names(spark, sf_dir) -> DataFrame:
    """One district file per supplier: region_nation plus a running name."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("file_id"), F.concat_ws(" ", F.replace("r_name", F.lit(" "), F.lit("_")), "n_name", "s_name").alias("file_name"),
                    F.col("s_acctbal").alias("acct")))


def shapes(spark, sf_dir) -> DataFrame:
    """Polygons of mixed quality, one per customer: closed, unclosed, with a repeated vertex, triangles, and too short."""
    c = read(spark, sf_dir, "customer")
    x, y, s = F.col("x"), F.col("y"), F.col("side")
    v = lambda *p: F.array(*[F.struct((x + a * s).alias("x"), (y + b * s).alias("y")) for a, b in p])
    kind = F.pmod("c_custkey", F.lit(5))
    ring = (F.when(kind == 0, v((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))).when(kind == 1, v((0, 0), (1, 0), (1, 1), (0, 1)))
            .when(kind == 2, v((0, 0), (1, 0), (1, 0), (1, 1), (0, 1), (0, 0))).when(kind == 3, v((0, 0), (1, 0), (0, 1))).otherwise(v((0, 0), (1, 0))))
    return (c.withColumns({"x": F.pmod(F.col("c_custkey") * 37, F.lit(1000)).cast("double"), "y": F.pmod(F.col("c_custkey") * 91, F.lit(1000)).cast("double"),
                           "side": F.abs("c_acctbal") / 100})
            .select(F.col("c_nationkey").cast("long").alias("layer_id"), F.col("c_custkey").alias("shape_id"), F.col("c_mktsegment").alias("geom_type"), "side", kind.alias("kind"), ring.alias("ring")))


SQL = {
    "shapes": """SELECT c_nationkey AS layer_id, c_custkey AS shape_id, c_mktsegment AS geom_type, abs(c_acctbal) / 100 AS side, c_custkey % 5 AS kind FROM customer""",
    "points": """SELECT event_id // 1000 AS layer_id, event_id AS ord, ((event_id * 7919) % 20011) / 10.0::DOUBLE AS x,
        (epoch_us(ts) % 20011) / 10.0::DOUBLE AS y,
        CASE WHEN event_type IN ('purchase', 'error') THEN 'intersection' WHEN event_type = 'signup' THEN 'endpoint' ELSE 'curve' END AS category,
        event_type AS kind FROM events""",
    "layers": "SELECT DISTINCT event_id // 1000 AS layer_id FROM events",
    "streets": """SELECT layer_id, k AS road_id, 0.0::DOUBLE AS x1, (k * 200)::DOUBLE AS y1, 2001.0::DOUBLE AS x2, (k * 200)::DOUBLE AS y2, 6.0::DOUBLE AS half_width
        FROM layers, range(11) r(k) UNION ALL
        SELECT layer_id, k + 100, (k * 200)::DOUBLE, 0.0::DOUBLE, (k * 200)::DOUBLE, 2001.0::DOUBLE, 6.0::DOUBLE FROM layers, range(11) r(k)""",
    "skeleton": """SELECT layer_id, road_id * 1000 + j AS ord, road_id, CASE WHEN road_id < 100 THEN (j * 10)::DOUBLE ELSE x1 END AS x,
        CASE WHEN road_id < 100 THEN y1 ELSE (j * 10)::DOUBLE END AS y FROM streets, range(201) r(j)""",
    "waves": "SELECT layer_id, ord, road_id, x, y + 50 * sin(x / 50) AS y FROM skeleton WHERE road_id < 100",
    "bends": """SELECT k.layer_id, k.ord, k.road_id, k.x + CASE WHEN k.road_id < 100 THEN 0 ELSE 50 * sin(k.y / 50) END AS x,
        k.y + CASE WHEN k.road_id < 100 THEN 50 * sin(k.x / 50) ELSE 0 END AS y FROM skeleton k""",
    "outline": f"""SELECT layer_id, 0 AS ring, i AS ord, [{', '.join(str(x) for x, _ in RIM)}][i + 1]::DOUBLE AS x, [{', '.join(str(y) for _, y in RIM)}][i + 1]::DOUBLE AS y
        FROM layers, range({len(RIM)}) r(i) UNION ALL
        SELECT layer_id, b, b * 100 + c, ((b - 1) // 10 * 200 + CASE WHEN c < 2 THEN 6 + (layer_id * 31 + b * 17 + c * 7) % 35 ELSE 194 - (layer_id * 31 + b * 17 + c * 7) % 35 END)::DOUBLE,
          ((b - 1) % 10 * 200 + CASE WHEN c IN (0, 3) THEN 6 + (layer_id * 13 + b * 29 + c * 11) % 35 ELSE 194 - (layer_id * 13 + b * 29 + c * 11) % 35 END)::DOUBLE
        FROM layers, range(1, 101) s(b), range(4) t(c)""",
    "outline_edges": """SELECT layer_id, ring, ord AS edge_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
        FROM outline WINDOW w AS (PARTITION BY layer_id, ring ORDER BY ord)""",
    "districts": "SELECT layer_id, 100.0::DOUBLE AS minx, 100.0::DOUBLE AS miny, 1900.0::DOUBLE AS maxx, 1900.0::DOUBLE AS maxy FROM layers",
    "reference_points": "SELECT layer_id, ord, x + 3 AS x, y + 4 AS y FROM points WHERE kind = 'purchase'",
    "labels_before": "SELECT * FROM points WHERE kind <> 'view'",
    "labels_after": "SELECT * FROM points WHERE kind <> 'error'",
    "actions": """SELECT user_id AS session_id, event_id AS ord, ts, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS action,
        CASE WHEN event_type IN ('purchase', 'error') THEN 'intersection' WHEN event_type = 'signup' THEN 'endpoint' ELSE 'curve' END AS category,
        ((event_id * 7919) % 20011) / 10.0::DOUBLE AS x, (epoch_us(ts) % 20011) / 10.0::DOUBLE AS y FROM events""",
    "predictions": """SELECT vec_id, label % 3 AS truth, q, list_position(q, list_max(q)) - 1 AS action,
        list_sort(q, 'DESC')[1] - list_sort(q, 'DESC')[2] AS confidence
        FROM (SELECT vec_id, label, [list_reduce(list_prepend(0.0::DOUBLE, list_filter(embedding, lambda v, i: (i - 1) % 3 = k)::DOUBLE[]), lambda a, b: a + b) for k in [0, 1, 2]] AS q FROM embeddings)""",
    "district_names": "SELECT s_suppkey AS file_id, replace([" + ", ".join("'" + n.replace("'", "''") + "'" for n in NAMES) + f"][s_suppkey % {len(NAMES)} + 1], '{{}}', s_suppkey::VARCHAR) AS file_name, (s_suppkey % {len(NAMES)})::INT AS kind, s_acctbal AS acct FROM supplier",
    "district_catalog": "SELECT DISTINCT split_part(c, '/', 1) AS sido, split_part(c, '/', 2) AS sigungu, c || '.shp' AS path FROM (SELECT [" + ", ".join(f"'{n}'" for n in CATALOG) + f"][n_nationkey % {len(CATALOG)} + 1] AS c FROM nation)",
    "road_catalog": """SELECT replace(r_name, ' ', '_') AS sido, n_name AS sigungu, r_name || '/' || n_name || '.shp' AS path
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "file_names": """SELECT s_suppkey AS file_id, replace(r_name, ' ', '_') || ' ' || n_name || ' ' || s_name AS file_name, s_acctbal AS acct
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}

_NEEDS = {"streets": ["layers"], "skeleton": ["layers", "streets"], "waves": ["skeleton"], "bends": ["skeleton"], "outline": ["layers"], "outline_edges": ["outline"], "districts": ["layers"], "reference_points": ["points"],
          "labels_before": ["points"], "labels_after": ["points"]}


def sql(names: str, body: str) -> str:
    """``WITH`` clause for the named tables (and those they need) before ``body``.

    ``body`` may itself start with further common table expressions followed by SELECT:
    write them as ``name AS (...), ... SELECT``.
    """
    order: list[str] = []

    def add(n):
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    head = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order)
    # plain decimal literals would give DECIMAL results; write them as doubles
    body = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", body.strip())
    if not head:
        return body if body.upper().startswith("SELECT") else f"WITH RECURSIVE {body}"
    return f"WITH RECURSIVE {head}{' ' if body.upper().startswith('SELECT') else ', '}{body}"


# Distance from (x, y) to the street grid: streets are axis-parallel, so it has a closed form.
def grid_dist(x: str = "x", y: str = "y") -> str:
    return f"least(abs({x} - 200 * round({x} / 200)), abs({y} - 200 * round({y} / 200)))"
