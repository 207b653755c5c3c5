"""File sources and sinks: GeoJSON, shapefiles, reference tables, catalogue, reports, manifests and snapshots."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

XY = "array<struct<x:double,y:double>>"
ROADS = f"path string, record long, geom_type string, part int, ring {XY}"
# Shapefile type codes.
SHAPE_TYPES = {1: "Point", 3: "LineString", 5: "Polygon", 11: "Point", 13: "LineString", 15: "Polygon", 21: "Point", 23: "LineString", 25: "Polygon"}


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature part: path, feature id, geometry type, part and its line or ring."""
    crd = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(crd).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode("features").alias("record", "f"))
    g = raw.select("path", "record", F.element_at("f.properties", F.lit("id")).alias("id"), F.col("f.properties").alias("attrs"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("c"))
    deep = lambda n: F.from_json("c", "array<" * n + "double" + ">" * n)
    point, line, rings, multi = deep(1), deep(2), deep(3), deep(4)
    lines = (F.when(F.col("geom_type") == "Point", F.array(F.array(point))).when(F.col("geom_type").isin("LineString", "MultiPoint"), F.array(line))
             .when(F.col("geom_type").isin("Polygon", "MultiLineString"), rings).when(F.col("geom_type") == "MultiPolygon", F.flatten(multi)))
    return g.select("path", "record", "id", "attrs", "geom_type", F.posexplode(lines).alias("part", "l")).withColumn(
        "ring", F.transform("l", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).drop("l")


def decode_shp(data: bytes) -> Iterator[tuple[int, str, int, list[tuple[float, float]]]]:
    """Records of one .shp file as (record, type, part, vertices)."""
    pos = 100
    while pos + 12 <= len(data):
        number, words = struct.unpack(">ii", data[pos:pos + 8])
        body = data[pos + 8:pos + 8 + words * 2]
        pos += 8 + words * 2
        kind = SHAPE_TYPES.get(struct.unpack("<i", body[:4])[0])
        if kind == "Point":
            yield number, kind, 0, [struct.unpack("<dd", body[4:20])]
        elif kind:
            parts, total = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44:44 + 4 * parts]), total]
            at = 44 + 4 * parts
            for i in range(parts):
                n = starts[i + 1] - starts[i]
                v = struct.unpack(f"<{2 * n}d", body[at + 16 * starts[i]:at + 16 * starts[i + 1]])
                yield number, kind, i, list(zip(v[::2], v[1::2]))


def shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """All .shp files below a path, one row per part. Files are decoded where they are read; batches stay small."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for number, kind, part, v in decode_shp(content):
                    rows.append((name, number, kind, part, [{"x": x, "y": y} for x, y in v]))
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=["path", "record", "geom_type", "part", "ring"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "record", "geom_type", "part", "ring"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, ROADS)


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Road files as sido, sigungu, path, from a province/county folder tree."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").option("recursiveFileLookup", True).load(root).select("path")
    p = F.split("path", "/")
    return files.select(F.element_at(p, -3).alias("sido"), F.element_at(p, -2).alias("sigungu"), "path").dropDuplicates(["sido", "sigungu"])


def reference_table(spark: SparkSession, path: str) -> DataFrame:
    """Known sites from a table without header whose columns are Y, X; rows that are not numbers and repeats are dropped."""
    raw = spark.read.schema("_c0 string, _c1 string").option("header", False).csv(path)
    return raw.select(F.expr("try_cast(_c1 as double)").alias("x"), F.expr("try_cast(_c0 as double)").alias("y")).dropna().dropDuplicates(["x", "y"])


def write_layer(df: DataFrame, path: str, layer: str) -> None:
    """One export layer (points, roads, district) as Parquet; roads are split by geometry type."""
    out = df.withColumn("layer", F.lit(layer))
    parts = ["layer", "geom_type"] if "geom_type" in df.columns else ["layer"]
    out.write.mode("append").partitionBy(*parts).parquet(path)


def write_geojson_points(points: DataFrame, path: str) -> None:
    """Point features as one JSON object per line."""
    props = [c for c in points.columns if c not in ("x", "y")]
    f = F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"))
    points.select(F.to_json(f).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def input_keys(files: DataFrame, params: str = "") -> DataFrame:
    """path, stamp, size and the content key of each input file of a binaryFile scan."""
    stamp = F.col("modificationTime")
    return files.select("path", stamp.alias("stamp"), F.col("length").alias("size"),
                        F.md5(F.concat_ws("_", "path", F.unix_micros(stamp).cast("string"), F.col("length").cast("string"), F.lit(params))).alias("key"))


def not_done(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """Inputs whose key is not in the manifest yet. Append theirs after the run."""
    return keys.join(manifest.select("key"), "key", "left_anti")


def memo(spark: SparkSession, key: Column | str, folder: str, make) -> DataFrame:
    """The table stored under a key, made and written on first use."""
    path = f"{folder.rstrip('/')}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def latest_states(snapshots: DataFrame, stamps: DataFrame) -> DataFrame:
    """Newest edit state per (file, polygon), kept only while the file's stamp is unchanged."""
    now = snapshots.join(stamps, ["file", "stamp"])
    return now.groupBy("file", "polygon_index").agg(F.max_by("state", "ts").alias("state"))
