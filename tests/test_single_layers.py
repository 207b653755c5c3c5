"""Queries against their SQL on single layers of sf0.1 that hold a case the smaller tables lack."""

import duckdb
import pytest

from roadpoints.operators.links import network_links
from roadpoints.plans import all_queries
from roadpoints.plans import tables as T

QUERIES, ORACLES = all_queries()


@pytest.mark.parametrize("name, layer", [
    ("g06_site_network_distance", 2),  # a site halfway between two nodes
    ("g26_direct_connections", 13),  # streets with a single point each
    ("g26_single_points", 13),
    ("j22_j23_skeleton_tests", 20),  # a link that just touches the disc of a skeleton point
])
def test_layer_matches_sql(spark, tmp_path, name, layer):
    con = duckdb.connect()
    con.execute(f"copy (select * from '/root/testdata/sf0.1/events.parquet' where event_id // 1000 = {layer}) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert want and [r[:3] for r in got] == [r[:3] for r in want]
    assert all(a == pytest.approx(b) if isinstance(b, float) else a == b for r, s in zip(got, want) for a, b in zip(r, s))


def test_sample_on_the_border_at_the_end_of_a_link(spark):
    # the last of the samples lies 21 m from a street's centre, which is the band's border
    p = spark.createDataFrame([(0, 1, 1612.2, 131.4, "curve"), (0, 2, 1445.3, 379.0, "curve")], "layer_id long, ord long, x double, y double, category string")
    assert [(r.ord1, r.ord2) for r in network_links(p, T.streets(spark, "/root/testdata/sf0.001")).collect()] == [(1, 2)]
