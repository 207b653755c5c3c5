"""Index paths and detour links against plain Python on bent roads with copies of places."""

import heapq
import math
import random

import pytest

from roadpoints.operators import routes

POINTS, SKEL, ROADS = ("layer_id long, ord long, x double, y double, category string", "layer_id long, ord long, x double, y double",
                       "layer_id long, road_id long, x1 double, y1 double, x2 double, y2 double, half_width double")


def town(seed, sites):
    """A winding road and a branch as vertices in order, roads along parts of it, sites beside it, some of them twice in one place."""
    rng = random.Random(seed)
    line = [(9.0 * i + rng.random(), 40 * math.sin(i / 7) + rng.random()) for i in range(60)]
    branch = [(line[30][0] + 3 + rng.random(), line[30][1] + 8.7 * (j + 1)) for j in range(25)]
    skel = [(0, 10 * i + 3, x, y) for i, (x, y) in enumerate(line + branch)]
    roads, n = [], 0
    for a, b in zip(line + branch, (line + branch)[1:]):
        if math.dist(a, b) < 50 and n % 17 != 5:
            roads.append((0, n, *a, *b, 6.0))
        n += 1
    places = [rng.choice(line + branch) for _ in range(sites)]
    rows = [(x + rng.uniform(-30, 30) * (k % 2), y + rng.uniform(-9, 9)) for k, (x, y) in enumerate(places)]
    rows += [rows[0], rows[1], (rows[2][0] + 0.5, rows[2][1] - 0.5), (5000.0, 5000.0)]
    return [(0, 7 * k, x, y, "curve") for k, (x, y) in enumerate(rows)], skel, roads


def seg(p, a, b):
    vx, vy = b[0] - a[0], b[1] - a[1]
    q = vx * vx + vy * vy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * vx + (p[1] - a[1]) * vy) / q)) if q else 0.0
    return math.dist(p, (a[0] + t * vx, a[1] + t * vy))


def cover(a, b, roads, band, n=4000):
    """Share of a-b within ``band`` of a road's surface, by sampling."""
    at = [(a[0] + (b[0] - a[0]) * (i + 0.5) / n, a[1] + (b[1] - a[1]) * (i + 0.5) / n) for i in range(n)]
    close = [r for r in roads if min(seg(a, r[2:4], r[4:6]), seg(b, r[2:4], r[4:6])) < r[6] + band + math.dist(a, b)]
    return sum(any(seg(p, r[2:4], r[4:6]) <= r[6] + band for r in close) for p in at) / n


def test_running_sums_cross_blocks(spark):
    rows = [(j, i, (i * 7 + j) % 5) for j in range(2) for i in range(23)]
    got = {(r.layer_id, r.pos): r.s for r in routes.running_sums(spark.createDataFrame(rows, "layer_id long, pos long, v long"), {"s": routes.F.col("v")}, block=4).collect()}
    assert got == {(j, i): sum((m * 7 + j) % 5 for m in range(i)) for j, i, _ in rows}


def test_index_paths_equal_listed_paths(spark):
    points, skel, roads = town(3, 26)
    line = [s[2:4] for s in skel]
    step = [(math.dist(a, b), cover(a, b, roads, 0.5, 400), cover(a, b, roads, 20.0, 400)) for a, b in zip(line, line[1:])]
    want = {}
    for i, p in enumerate(points):
        for q in points[i + 1:]:
            a, b = (min(range(len(line)), key=lambda v: (math.dist(line[v], s[2:4]), v)) for s in (p, q))
            if a == b or max(math.dist(line[a], p[2:4]), math.dist(line[b], q[2:4])) > 50 or not 15 <= math.dist(p[2:4], q[2:4]) <= 300:
                continue
            a, b = min(a, b), max(a, b)
            own = lambda o: any(abs(o[2] - e[2]) < 1 and abs(o[3] - e[3]) < 1 for e in (p, q))
            if any(not own(o) and min(seg(o[2:4], line[v], line[v + 1]) for v in range(a, b)) <= 10 for o in points):
                continue
            length = sum(s[0] for s in step[a:b])
            share = sum(s[0] * s[2] for s in step[a:b]) / length
            off = sum(s[1] < 0.999 for s in step[a:b])
            if off == 0 or share >= 0.8:
                want[p[1], q[1]] = (length, share, off)
    got = {(r.ord1, r.ord2): (r.path_length, r.cover, r.off_steps) for r in routes.index_paths(spark.createDataFrame(points, POINTS).repartition(3), spark.createDataFrame(skel, SKEL).repartition(5), spark.createDataFrame(roads, ROADS)).collect()}
    assert set(got) == set(want) and len(want) > 5
    for key, (length, share, off) in want.items():
        assert got[key][0] == pytest.approx(length, abs=1e-3) and got[key][1] == pytest.approx(share, abs=0.02) and got[key][2] == off


def shortest(line, start):
    best, heap = {start: (0.0, None)}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u][0]:
            continue
        for v in range(len(line)):
            w = math.dist(line[u], line[v])
            if v != u and w <= 20 and d + w < best.get(v, (math.inf,))[0]:
                best[v] = (d + w, u)
                heapq.heappush(heap, (d + w, v))
    return best


def test_detour_links_equal_searched_ways(spark):
    points, skel, roads = town(5, 22)
    line = [s[2:4] for s in skel]
    want = {}
    for i, p in enumerate(points):
        for q in points[i + 1:]:
            a, b = (min(range(len(line)), key=lambda v: (math.dist(line[v], s[2:4]), v)) for s in (p, q))
            d = math.dist(p[2:4], q[2:4])
            if max(math.dist(line[a], p[2:4]), math.dist(line[b], q[2:4])) >= 25 or not 15 <= d <= 300:
                continue
            found = shortest(line, a)
            if b not in found or found[b][0] > 2 * d or cover(p[2:4], q[2:4], roads, 0.0) < 0.5:
                continue
            way = [b]
            while found[way[-1]][1] is not None:
                way.append(found[way[-1]][1])
            beside = lambda o: min(seg(o[2:4], line[u], line[v]) for u, v in zip(way, way[1:])) < 20 and math.dist(o[2:4], p[2:4]) > 30 and math.dist(o[2:4], q[2:4]) > 30
            if len(way) > 2 and any(beside(o) for o in points):
                continue
            want[p[1], q[1]] = found[b][0]
    got = {(r.ord1, r.ord2): r.path_length for r in routes.detour_links(spark.createDataFrame(points, POINTS).repartition(3), spark.createDataFrame(skel, SKEL).repartition(5), spark.createDataFrame(roads, ROADS)).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(want) > 5
