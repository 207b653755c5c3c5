"""Queries give all rows: small tables against brute force in plain Python."""

import math
import random

from roadpoints.operators import lines as LN


def greedy(sites, cells, radius, target):
    free, out = set(cells), []
    while sites:
        gain, o = max((sum(math.dist(c, s) <= radius for c in free), -k) for k, s in sites.items())
        if gain == 0:
            break
        out.append((len(out) + 1, -o, gain * 100.0))
        free = {c for c in free if math.dist(c, sites[-o]) > radius}
        if len(free) <= (1 - target) * len(cells):
            break
    return out


def test_sites_are_placed_to_the_target(spark):
    """Up to 95 % by default, or to the last candidate that gains; ties and candidates on one place included."""
    rng = random.Random(3)
    sites = {1: [(rng.randrange(0, 430) + 0.5, rng.randrange(0, 430) + 0.25) for _ in range(150)], 2: [(60.0, 60.0), (60.0, 60.0), (160.0, 60.0), (260.0, 160.0), (900.0, 900.0)],
             3: [(x * 20.0, y * 20.0) for x in range(20) for y in range(20)]}
    rows = [(k, n + 1, x, y) for k, v in sites.items() for n, (x, y) in enumerate(v)]
    box = spark.createDataFrame([(k, 0.0, 0.0, 400.0, 400.0) for k in sites], "layer_id long, minx double, miny double, maxx double, maxy double")
    cells = [(x * 10.0, y * 10.0) for x in range(1, 40) for y in range(1, 40)]
    for target in (None, 0.5):
        df = LN.place_sites(spark.createDataFrame(rows, "layer_id long, ord long, x double, y double"), box, 50.0, **({} if target is None else {"target": target}))
        got = df.collect()
        for k, v in sites.items():
            want = greedy({n + 1: p for n, p in enumerate(v)}, cells, 50.0, target or 0.95)
            assert sorted((r["round"], r["ord"], r["gain_area"]) for r in got if r["layer_id"] == k) == want


def test_site_placement_query_has_no_lower_target(spark):
    from roadpoints.plans import job_queries as Q
    sf = "/root/testdata/sf0.001"
    share = sum(r["gain_area"] for r in Q.m15(spark, sf).where("layer_id = 0").collect()) / (179 * 179 * 100)
    assert share > 0.3


def street_tables(monkeypatch, spark, sites):
    from roadpoints.plans import tables as T
    streets = [(1, k + t, *((0.0, k * 200.0, 2001.0, k * 200.0) if t == 0 else (k * 200.0, 0.0, k * 200.0, 2001.0)), 6.0) for k in range(11) for t in (0, 100)]
    line = spark.createDataFrame(streets, "layer_id long, road_id long, x1 double, y1 double, x2 double, y2 double, half_width double")
    at = spark.createDataFrame([(1, k, x, y, "curve", "view") for k, (x, y) in sites.items()], "layer_id long, ord long, x double, y double, category string, kind string")
    monkeypatch.setattr(T, "points", lambda *a: at)
    monkeypatch.setattr(T, "streets", lambda *a: line)


def test_same_segment_pairs_leave_out_no_site(spark, monkeypatch):
    """On a junction, as near to two streets, and past 2,000 m; a part with a third site has no pair, since it lies between."""
    from roadpoints.plans import job_queries as Q
    street_tables(monkeypatch, spark, {1: (200.0, 400.0), 2: (250.0, 401.0), 3: (601.0, 601.0), 4: (650.0, 600.0), 5: (2000.25, 800.0), 6: (2000.75, 800.5), 7: (10.0, 1000.0), 8: (20.0, 1000.0), 9: (0.0, 1000.0)})
    got = sorted((r["ord1"], r["ord2"], r["distance"], r["type"]) for r in Q.g25(spark, "").collect())
    assert got == [(1, 2, 50.0, "same_segment"), (3, 4, 49.0, "same_segment"), (5, 6, 0.5, "same_segment")]


def test_direct_connections_list_connected_lines(spark, monkeypatch):
    from roadpoints.plans import graph_queries as Q
    street_tables(monkeypatch, spark, {1: (150.0, 400.0), 2: (600.0, 990.0), 3: (610.0, 1400.0), 4: (690.0, 1400.0)})
    got = sorted((r["ord1"], r["ord2"], round(r["distance"], 3), r["type"]) for r in Q.g26(spark, "").collect())
    assert got == [(1, 2, round(math.hypot(450, 590), 3), "connected_lines"), (3, 4, 80.0, "same_line")]


def test_sites_without_coordinates_are_near_nothing(spark):
    """Null, NaN and infinite coordinates end the search for the nearest rows; all other sites are served."""
    from roadpoints.operators import celljoin as C, links as L
    nan, inf = float("nan"), float("inf")
    at = [(1, 1, 0.0, 0.0), (1, 2, 3000.0, 0.0), (1, 3, None, 0.0), (1, 4, 0.0, nan), (1, 5, inf, 0.0), (2, 1, 5.0, 5.0), (2, 2, None, None), (3, 1, nan, nan)]
    sites = spark.createDataFrame(at, "layer_id long, ord long, x double, y double")
    data = spark.createDataFrame([(1, 7, 1.0, 0.0), (1, 8, None, 0.0), (2, 7, nan, 1.0), (3, 7, 0.0, 0.0)], "layer_id long, ord long, x double, y double")
    want = {(1, 1): 1.0, (1, 2): 2999.0}
    got = C.nearest(sites, data).collect()
    assert len(got) == len(at) and {(r["layer_id"], r["ord"]): r["near_d"] for r in got if r["near_d"] is not None} == want
    got = C.k_nearest(sites, data, 2).collect()
    assert len(got) == len(at) and {(r["layer_id"], r["ord"]): r["near_d"][0] for r in got if r["near_d"] != [1000.0, 1000.0]} == want
    segs = spark.createDataFrame([(1, 1, 1.0, -5.0, 1.0, 5.0), (1, 2, None, 0.0, 1.0, 1.0), (2, 1, nan, 0.0, 1.0, 1.0)], "layer_id long, road_id long, x1 double, y1 double, x2 double, y2 double")
    got = L.nearest_segment(sites, segs).collect()
    assert len(got) == len(at) and {(r["layer_id"], r["ord"]): r["near_d"] for r in got if r["near_d"] is not None} == want
