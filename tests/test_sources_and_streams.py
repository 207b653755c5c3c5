"""File sources, sinks, manifests and streams."""

import json
import struct

from pyspark.sql import functions as F

from roadpoints.sources import files, sessions
from roadpoints.streaming import actions as A


def shp(polygons):
    recs = b""
    for i, rings in enumerate(polygons):
        pts = [p for r in rings for p in r]
        starts, n = [], 0
        for r in rings:
            starts.append(n)
            n += len(r)
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(pts)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        recs += struct.pack(">2i", i + 1, len(body) // 2) + body
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(recs)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + recs


SQUARE = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]


def test_shapefiles_and_catalogue(spark, tmp_path):
    f = tmp_path / "north" / "alpha"
    f.mkdir(parents=True)
    (f / "roads.shp").write_bytes(shp([[SQUARE], [SQUARE, [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]]]))
    rows = files.shapefiles(spark, str(tmp_path)).orderBy("record", "part").collect()
    assert [(r.record, r.part, r.geom_type, len(r.ring)) for r in rows] == [(1, 0, "Polygon", 5), (2, 0, "Polygon", 5), (2, 1, "Polygon", 4)]
    assert [(p.x, p.y) for p in rows[0].ring] == SQUARE
    c = files.catalogue(spark, str(tmp_path)).first()
    assert (c.sido, c.sigungu) == ("north", "alpha")


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"id": 7}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}},
        {"type": "Feature", "properties": {"id": 8}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [SQUARE]]}}]}
    (tmp_path / "p.geojson").write_text(json.dumps(doc, indent=1))
    rows = files.geojson(spark, str(tmp_path)).orderBy("record", "part").collect()
    assert [(r.id, r.geom_type, r.part, len(r.ring)) for r in rows] == [("7", "Point", 0, 1), ("8", "MultiPolygon", 0, 5), ("8", "MultiPolygon", 1, 5)]
    assert (rows[0].ring[0].x, rows[0].ring[0].y) == (1.5, 2.5)


def test_reference_table_drops_text_and_repeats(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Y,X\n2.0,1.0\n2.0,1.0\nabc,3\n5,4\n")
    assert {(r.x, r.y) for r in files.reference_table(spark, str(tmp_path)).collect()} == {(1.0, 2.0), (4.0, 5.0)}


def test_sessions_round_trip_and_statistics(spark, tmp_path):
    p = spark.createDataFrame([(0, 1, 1.0, 2.0, "curve"), (0, 2, 3.0, 4.0, "endpoint"), (1, 3, 5.0, 6.0, "curve")], "layer_id long, ord long, x double, y double, category string")
    sessions.write(sessions.from_points(p), str(tmp_path / "s"))
    back = sessions.scan(spark, str(tmp_path / "s" / "*"))
    labels = {r.file_path: r.labels for r in back.collect()}
    assert labels["layer-0"] == {"curve": [[1.0, 2.0]], "endpoint": [[3.0, 4.0]]}
    assert sessions.statistics(back).first().sessions == 2
    assert sessions.older_than(back, 1).count() == 0


def test_manifest_memo_and_snapshots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"x")
    keys = files.input_keys(spark.read.format("binaryFile").load(str(tmp_path / "in")))
    done = spark.createDataFrame([("other",)], "key string")
    assert files.not_done(keys, done).count() == 1
    assert files.not_done(keys, keys.select("key")).count() == 0
    calls = []

    def make():
        calls.append(1)
        return spark.range(3).toDF("v")
    assert files.memo(spark, "k", str(tmp_path / "memo"), make).count() == 3
    assert files.memo(spark, "k", str(tmp_path / "memo"), make).count() == 3 and calls == [1]
    snap = spark.createDataFrame([("f", 1, 10, "old", 1), ("f", 1, 10, "new", 2), ("g", 1, 10, "void", 1)], "file string, polygon_index int, stamp long, state string, ts long")
    now = spark.createDataFrame([("f", 10), ("g", 11)], "file string, stamp long")
    assert [tuple(r) for r in files.latest_states(snap, now).collect()] == [("f", 1, "new")]


def test_exports(spark, tmp_path):
    p = spark.createDataFrame([(1, 1.0, 2.0)], "ord long, x double, y double")
    files.write_geojson_points(p, str(tmp_path / "g"))
    assert json.loads(spark.read.text(str(tmp_path / "g")).first().value)["geometry"]["coordinates"] == [1.0, 2.0]
    files.write_layer(p, str(tmp_path / "l"), "points")
    assert spark.read.parquet(str(tmp_path / "l")).first().layer == "points"
    files.write_report(p, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["ord", "x", "y"]


ROWS = [(1, 1, "2024-01-01 00:00:00", "add", "curve", 1.0, 1.0), (1, 2, "2024-01-01 00:02:00", "add", "endpoint", 2.0, 2.0), (1, 3, "2024-01-01 00:04:00", "remove", "curve", 1.0, 1.0), (2, 4, "2024-01-01 00:01:00", "add", "curve", 3.0, 3.0)]


def log(spark, path):
    rows = spark.createDataFrame(ROWS, "session_id long, ord long, t string, action string, category string, x double, y double")
    rows.select("session_id", "ord", F.to_timestamp("t").alias("ts"), "action", "category", "x", "y").write.mode("append").parquet(path)


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streamed_context_equals_batch(spark, tmp_path):
    src = str(tmp_path / "a")
    log(spark, src)
    drain(A.stream_context(A.read_actions(spark, src)), "ctx", "append")
    got = sorted((r.session_id, r.ord, r.relative_time, r.edits) for r in spark.table("ctx").collect())
    want = sorted((r.session_id, r.ord, r.relative_time, r.edits) for r in A.session_context(spark.read.parquet(src)).collect())
    assert got == want


def test_streamed_points_keep_tombstones(spark, tmp_path):
    src = str(tmp_path / "b")
    log(spark, src)
    drain(A.stream_current_points(A.read_actions(spark, src)), "pts", "update")
    last = {(r.session_id, r.category, r.x): r.action for r in spark.table("pts").collect()}
    assert last == {(1, "curve", 1.0): "remove", (1, "endpoint", 2.0): "add", (2, "curve", 3.0): "add"}
    kept = {(r.session_id, r.category, r.x) for r in A.current_points(spark.read.parquet(src)).collect()}
    assert kept == {k for k, a in last.items() if a == "add"}


def test_activity_windows_and_file_job(spark, tmp_path):
    src = str(tmp_path / "c")
    log(spark, src)
    drain(A.activity(A.read_actions(spark, src)), "act", "complete")
    assert sum(r.n for r in spark.table("act").collect()) == 4
    q = A.process_files(A.read_actions(spark, src), lambda df: df.groupBy("action").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out_status")).first()["rows"] == 4
