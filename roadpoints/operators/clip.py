"""District clipping, catalogue matching, candidate sites and small public helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from roadpoints.functions.geom import dist
from roadpoints.operators.celljoin import KEYS, segment_cells
from roadpoints.operators.cuts import cut


def match_catalogue(files: DataFrame, catalog: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Road file of each district file by the region names in its own name: ``files`` has file_id and ``names`` (array).

    A city or county name comes first (priority 1), then a ward name (2), then a name that holds or is held by a catalogue name (3); within
    a step the earlier name, then the smaller catalogue row. All steps are equi-joins: where one name holds another, the first two
    characters of the shorter one are among the pairs of characters of the longer one.
    """
    cat = catalog.select("sido", "sigungu", "path").distinct()
    named = files.select(file_id, F.posexplode("names").alias("pos", "name")).where("name <> ''")
    step = F.when(F.col("name").rlike("[시군]$"), 1).when(F.col("name").endswith("구"), 2)
    exact = cut(named.withColumn("priority", step).where("priority is not null").join(cat, F.col("name") == F.col("sigungu"))
                .select(file_id, "priority", "pos", "sido", "sigungu", "path"))
    left = named.join(exact, file_id, "left_anti")
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(2))))
    head = lambda c: F.substring(c, 1, 2)
    held = left.withColumn("_g", F.explode(pairs("name"))).join(cat.withColumn("_g", head("sigungu")), "_g").where(F.col("name").contains(F.col("sigungu")))
    holds = left.withColumn("_g", head("name")).join(cat.withColumn("_g", F.explode(pairs("sigungu"))), "_g").where(F.col("sigungu").contains(F.col("name")))
    part = held.unionByName(holds).select(file_id, F.lit(3).alias("priority"), "pos", "sido", "sigungu", "path")
    best = exact.unionByName(part).groupBy(file_id).agg(F.min(F.struct("priority", "pos", "sido", "sigungu", "path")).alias("b"))
    return best.select(file_id, "b.sido", "b.sigungu", "b.path", "b.priority")


def compare_counts(predicted: DataFrame, table: DataFrame, by: str = "layer_id") -> DataFrame:
    """Predicted against expected counts; the difference is null where the table has no row."""
    j = predicted.join(table, by, "left").withColumn("difference", F.col("predicted") - F.col("expected"))
    return j.withColumn("status", F.when(F.col("expected").isNull(), "no table").otherwise("ok"))


def candidate_sites(skel: DataFrame, step: float = 10.0, keys: Sequence[str] = KEYS, line_id: str = "road_id") -> DataFrame:
    """Sites along lines: the midpoint of a step shorter than ``step``, else every ``step`` metres; each place once."""
    w = Window.partitionBy(*keys, line_id).orderBy("ord")
    s = skel.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).where("nx is not null")
    s = s.withColumn("d", dist("x", "y", "nx", "ny"))
    t = F.when(F.col("d") < step, F.array(F.lit(0.5))).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.col("d") / step).cast("int") - 1)), lambda i: i * step / F.col("d")))
    s = s.withColumn("t", F.explode(t))
    sites = s.select(*keys, (F.col("x") + F.col("t") * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + F.col("t") * (F.col("ny") - F.col("y"))).alias("y"), "ord")
    return sites.groupBy(*keys, "x", "y").agg(F.min("ord").alias("ord"))


def custom_filter(points: DataFrame, fn: Callable[..., DataFrame], **kwargs) -> DataFrame:
    """A caller's DataFrame filter. A failure is raised, not hidden."""
    return points.transform(fn, **kwargs)


def clip_lines(lines: DataFrame, edges: DataFrame, reach: float = 10.0, keys: Sequence[str] = KEYS, line_id: str = "road_id", edge: float = 200.0) -> DataFrame:
    """Parts of straight lines inside a district or within ``reach`` of its outline: x1, y1, x2, y2, t0, t1.

    A line is cut where it crosses the outline and where it enters or leaves the outline's band; a piece is kept when
    its middle is inside or near. Lines that touch no outline cell are tested as a whole.
    """
    from roadpoints.functions.geom import crossing, measure_ratio, with_band_interval
    from roadpoints.operators.polygons import inside
    k = [*keys, line_id]
    ln = lines.select(*k, "x1", "y1", "x2", "y2")
    band = segment_cells(edges.select(*keys, F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by")), edge, reach, ("ax", "ay", "bx", "by"))
    hit = segment_cells(ln, edge).join(band, [*keys, "cx", "cy"]).drop("cx", "cy").distinct()
    cx, cy = crossing("x1", "y1", "x2", "y2", "ax", "ay", "bx", "by")
    hit = with_band_interval(hit.withColumns({"qx": cx, "qy": cy}), F.lit(reach), "b")
    hit = cut(hit.withColumn("tc", F.when(F.col("qx").isNotNull(), measure_ratio("qx", "qy", "x1", "y1", "x2", "y2"))).select(*k, "tc", "b_t0", "b_t1"))
    marks = hit.withColumn("t", F.explode(F.array("tc", "b_t0", "b_t1"))).where("t is not null").select(*k, "t")
    ends = ln.select(*k, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    marks = marks.unionByName(ends).distinct()
    from roadpoints.operators.select import chain_next
    piece = chain_next(marks.withColumn("ord", F.lit(0)), k, "t", ["t"], step=0.25).where("n_t is not null and n_t > t").select(*k, F.col("t").alias("t0"), F.col("n_t").alias("t1"))
    mid = cut(piece.join(ln, k).withColumn("tm", (F.col("t0") + F.col("t1")) / 2).withColumns(
        {"x": F.col("x1") + F.col("tm") * (F.col("x2") - F.col("x1")), "y": F.col("y1") + F.col("tm") * (F.col("y2") - F.col("y1"))}))
    near = mid.join(hit.where("b_t0 is not null").select(*k, "b_t0", "b_t1"), k).where("tm between b_t0 and b_t1").select(*k, "t0").distinct().withColumn("near", F.lit(True))
    kept = inside(mid, edges, keys).join(near, [*k, "t0"], "left").where("inside or near")
    at = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    return kept.select(*k, "t0", "t1", at("x1", "x2", "t0").alias("cx1"), at("y1", "y2", "t0").alias("cy1"), at("x1", "x2", "t1").alias("cx2"), at("y1", "y2", "t1").alias("cy2"),
                       (dist("x1", "y1", "x2", "y2") * (F.col("t1") - F.col("t0"))).alias("length"))


def clip_with_ladder(lines: DataFrame, edges: DataFrame, ladder: Sequence[float] = (10.0, 100.0, 200.0, 500.0), keys: Sequence[str] = KEYS, line_id: str = "road_id") -> DataFrame:
    """Clip with the first reach of the ladder that leaves a layer any line; ``reach`` says which."""
    todo, parts = edges, []
    for reach in ladder:
        part = cut(clip_lines(lines, todo, reach, keys, line_id).withColumn("reach", F.lit(reach)))
        parts.append(part)
        todo = cut(todo.join(part.select(*keys).distinct(), list(keys), "left_anti"))
        if todo.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
