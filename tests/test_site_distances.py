"""Network distances between sites: every pair that a path joins, against plain Python."""

import heapq
import math
import random
from itertools import combinations

import pytest

from roadpoints.operators import graph as G


def shortest(edges, start):
    """node -> (dist, nodes of the path)"""
    adj, best, q = {}, {}, [(0.0, start, (start,))]
    for u, v, w in edges:
        adj.setdefault(u, []).append((v, w))
        adj.setdefault(v, []).append((u, w))
    while q:
        d, u, way = heapq.heappop(q)
        if u not in best:
            best[u] = (d, way)
            for v, w in adj.get(u, []):
                heapq.heappush(q, (d + w, v, (*way, v)))
    return best


def pairs(nodes, edges, sites):
    at = {}
    for o, x, y in sites:
        if x is not None and y is not None and not math.isnan(x + y):
            d, n = min((math.dist((x, y), p), -n) for n, p in nodes.items())
            at[o] = (-n, d)
    held, out = {n for n, _ in at.values()}, {}
    for a, b in combinations(sorted(at), 2):
        far = shortest(edges, at[a][0]).get(at[b][0])
        if far:
            out[a, b] = (round(at[a][1] + far[0] + at[b][1], 6), not held & set(far[1][1:-1]))
    return out


def tables(spark, data):
    frame = lambda rows, cols: spark.createDataFrame([(k, *r) for k, v in data.items() for r in rows(v)], f"layer_id long, {cols}")
    return (frame(lambda v: v[2], "ord long, x double, y double"), frame(lambda v: [(n, *p) for n, p in v[0].items()], "ord long, x double, y double"),
            frame(lambda v: v[1], "u long, v long, w double"))


def layers():
    r = random.Random(5)
    place = {n: (r.uniform(0, 3000), r.uniform(0, 3000)) for n in range(30)}
    # two parts without a way between them
    roads = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), r.uniform(50, 900)) for a, b in ((r.randrange(15) + h, r.randrange(15) + h) for h in (0, 15) for _ in range(30)) if a != b}.values())
    sites = [(100 + i, r.uniform(0, 3000), r.uniform(0, 3000)) for i in range(25)]
    sites += [(200, None, 5.0), (201, float("nan"), 5.0), (202, *place[3]), (203, *place[3])]
    line = {n: (n * 150.0, 0.0) for n in range(10)}
    return {1: (place, roads, sites),
            2: (line, [(n, n + 1, 150.0) for n in range(9)], [(7, 0.0, 10.0), (3, 1350.0, 0.0), (5, 600.0, 1.0)]),
            3: (line, [(n, n + 1, 150.0) for n in range(9)], [(1, 0.0, 10.0), (2, 1350.0, 20.0)])}


def test_all_pairs_of_sites_that_a_path_joins(spark):
    data = layers()
    got = G.site_distances(*tables(spark, data)).collect()
    for k, v in data.items():
        mine = [r for r in got if r["layer_id"] == k]
        assert {(r["ord1"], r["ord2"]): (round(r["distance"], 6), r["direct"]) for r in mine} == pairs(*v)
        assert len(mine) == len(pairs(*v))
    assert {(r["ord1"], r["ord2"], r["distance"], r["direct"]) for r in got if r["layer_id"] == 3} == {(1, 2, 1380.0, True)}


def test_a_bound_holds_for_the_way_on_the_network_alone(spark):
    data = layers()
    every = G.site_distances(*tables(spark, data)).collect()
    near = G.site_distances(*tables(spark, data), 600.0).collect()
    key = lambda r: (r["layer_id"], r["ord1"], r["ord2"], r["distance"], r["direct"])
    assert sorted(map(key, near)) == sorted(key(r) for r in every if r["on_network"] <= 600.0) and 0 < len(near) < len(every)


def test_a_circle_of_steps_ends_with_an_error(spark):
    path = spark.createDataFrame([(1, 0, 0, 0.0, None), (1, 0, 1, 1.0, 2), (1, 0, 2, 1.0, 1)], "layer_id long, source long, node long, dist double, prev long")
    stops = spark.createDataFrame([(1, 9)], "layer_id long, node long")
    with pytest.raises(RuntimeError):
        G.ways_between(path, stops, limit=3)


def test_query_has_sites_of_every_kind_and_no_bound(spark, monkeypatch):
    from roadpoints.plans import graph_queries as Q, tables as T
    streets = [(1, k + t, *((0.0, k * 200.0, 2001.0, k * 200.0) if t == 0 else (k * 200.0, 0.0, k * 200.0, 2001.0)), 6.0) for k in range(11) for t in (0, 100)]
    line = spark.createDataFrame(streets, "layer_id long, road_id long, x1 double, y1 double, x2 double, y2 double, half_width double")
    at = [(1, 1, 3.0, 4.0, "curve", "view"), (1, 2, 2000.0, 2000.0, "endpoint", "signup"), (1, 3, 600.0, 405.0, "intersection", "error"), (1, 4, 100.0, 0.0, "curve", None)]
    monkeypatch.setattr(T, "points", lambda *a: spark.createDataFrame(at, "layer_id long, ord long, x double, y double, category string, kind string"))
    monkeypatch.setattr(T, "streets", lambda *a: line)
    got = sorted((r["ord1"], r["ord2"], r["distance"]) for r in Q.g06(spark, "").collect())
    # the fourth lies halfway between two nodes and takes the one of larger number
    assert got == [(1, 2, 4005.0), (1, 3, 1010.0), (1, 4, 305.0), (2, 3, 3005.0), (2, 4, 3900.0), (3, 4, 905.0)]
