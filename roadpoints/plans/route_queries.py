"""Queries on ways along the skeleton."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpoints.operators import routes as P
from roadpoints.operators.sequence import top_n
from roadpoints.plans import tables as T
from roadpoints.plans.link_queries import interval_sql, union_sql
from roadpoints.plans.registry import query
from roadpoints.plans.tables import sql

R6 = lambda c: F.round(c, 6)
_SEG = """(SELECT least(1.0, greatest(0.0, ((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)))))"""


def index_sql(body: str) -> str:
    """Index paths with the points beside them looked up among all steps of a path; a step of the grid is a street's own 10 m or a jump to the next street."""
    return sql("points skeleton", f"""pairs AS MATERIALIZED (SELECT * FROM (SELECT layer_id, row_number() OVER w - 1 AS ord1, row_number() OVER w AS ord2, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
      FROM skeleton WINDOW w AS (PARTITION BY layer_id ORDER BY ord)) WHERE x2 IS NOT NULL),
    {interval_sql(6.5, "tight")}, {union_sql("tight", "tights")}, {interval_sql(26.0, "wide")}, {union_sql("wide", "wides")},
    steps AS MATERIALIZED (SELECT p.*, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS len, coalesce(t.share, 0.0) AS tight, coalesce(w.share, 0.0) AS wide FROM pairs p
      LEFT JOIN tights t USING (layer_id, ord1, ord2) LEFT JOIN wides w USING (layer_id, ord1, ord2)),
    spots AS MATERIALIZED (SELECT layer_id, ord, x, y, category FROM points),
    met AS MATERIALIZED (SELECT s.layer_id, s.ord, s.x, s.y, t.ord1 AS pos FROM spots s JOIN steps t ON t.layer_id = s.layer_id
        AND s.x BETWEEN least(t.x1, t.x2) - 10 AND greatest(t.x1, t.x2) + 10 AND s.y BETWEEN least(t.y1, t.y2) - 10 AND greatest(t.y1, t.y2) + 10
      WHERE sqrt((s.x - (t.x1 + least(1.0, greatest(0.0, ((s.x - t.x1) * (t.x2 - t.x1) + (s.y - t.y1) * (t.y2 - t.y1)) / (len * len))) * (t.x2 - t.x1))) ** 2
               + (s.y - (t.y1 + least(1.0, greatest(0.0, ((s.x - t.x1) * (t.x2 - t.x1) + (s.y - t.y1) * (t.y2 - t.y1)) / (len * len))) * (t.y2 - t.y1))) ** 2) <= 10),
    verts AS MATERIALIZED (SELECT layer_id, row_number() OVER (PARTITION BY layer_id ORDER BY ord) - 1 AS pos, x, y FROM skeleton),
    here AS MATERIALIZED (SELECT s.layer_id, s.ord, s.x, s.y, arg_min(v.pos, (sqrt((s.x - v.x) ** 2 + (s.y - v.y) ** 2), v.pos)) AS pos FROM spots s JOIN verts v ON v.layer_id = s.layer_id
      AND v.x BETWEEN s.x - 50 AND s.x + 50 AND v.y BETWEEN s.y - 50 AND s.y + 50 WHERE sqrt((s.x - v.x) ** 2 + (s.y - v.y) ** 2) <= 50 GROUP BY ALL),
    two AS MATERIALIZED (SELECT a.layer_id, a.ord AS ord1, b.ord AS ord2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, least(a.pos, b.pos) AS a, greatest(a.pos, b.pos) AS b
      FROM here a JOIN here b ON a.layer_id = b.layer_id AND a.ord < b.ord AND a.pos <> b.pos AND b.x BETWEEN a.x - 300 AND a.x + 300 AND b.y BETWEEN a.y - 300 AND a.y + 300),
    free AS MATERIALIZED (SELECT * FROM two t WHERE d BETWEEN 15 AND 300 AND NOT EXISTS (SELECT 1 FROM met m WHERE m.layer_id = t.layer_id AND m.pos >= t.a AND m.pos < t.b
      AND NOT (abs(m.x - t.x1) < 1 AND abs(m.y - t.y1) < 1) AND NOT (abs(m.x - t.x2) < 1 AND abs(m.y - t.y2) < 1))),
    judged AS (SELECT f.layer_id, f.ord1, f.ord2, f.d, sum(s.len) AS path_length, sum(s.len * s.wide) / sum(s.len) AS cover, count_if(s.tight < 1 - 1e-9) AS off_steps
      FROM free f JOIN steps s ON s.layer_id = f.layer_id AND s.ord1 >= f.a AND s.ord1 < f.b GROUP BY ALL),
    found AS (SELECT * FROM judged WHERE off_steps = 0 OR cover >= 0.8) {body}""")


def _paths(spark, sf):
    return P.index_paths(T.points(spark, sf), T.skeleton(spark, sf), T.streets(spark, sf))


@query("j38_index_paths", index_sql("SELECT layer_id, ord1, ord2, round(d, 6) AS d, round(path_length, 4) AS path_length, round(cover, 4) AS cover, off_steps FROM found"))
def j38(spark, sf):
    return _paths(spark, sf).withColumns({"d": R6("d"), "path_length": F.round("path_length", 4), "cover": F.round("cover", 4)})


@query("j38_shortest_links", index_sql("SELECT layer_id, ord1, ord2, round(d, 6) AS d, row_number() OVER (PARTITION BY layer_id ORDER BY d, ord1, ord2) AS rank FROM found QUALIFY rank <= 20"))
def j38_shortest(spark, sf):
    top = top_n(_paths(spark, sf), 20, [F.col("d"), F.col("ord1"), F.col("ord2")])
    return top.select("layer_id", "ord1", "ord2", R6("d").alias("d"), "rank")


@query("g27_detour_links")
def g27(spark, sf):
    out = P.detour_links(T.points(spark, sf), T.skeleton(spark, sf), T.streets(spark, sf))
    return out.withColumns({"d": R6("d"), "path_length": R6("path_length"), "cover": R6("cover")})
