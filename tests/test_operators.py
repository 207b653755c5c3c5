"""Operators against plain Python on small fixtures: hand fixtures, hot groups, order and ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadpoints.operators import clean, curves, features, fixpoint, graph, links, polygons, raster, select, sequence
from roadpoints.operators.celljoin import k_nearest, nearest, near_join, pairs_within, segment_cells

PTS = "layer_id long, ord long, x double, y double, category string"


def points(spark, rows):
    return spark.createDataFrame(rows, PTS)


def cloud(n, seed, side=100.0, copies=0):
    r = random.Random(seed)
    kinds = ["intersection", "curve", "endpoint"]
    rows = [(i % 2, i, round(r.uniform(0, side), 1), round(r.uniform(0, side), 1), r.choice(kinds)) for i in range(n)]
    return rows + [(0, n + i, 50.0, 50.0, "curve") for i in range(copies)]


def d(a, b):
    return math.hypot(a[2] - b[2], a[3] - b[3])


def by_layer(rows):
    out = {}
    for p in rows:
        out.setdefault(p[0], []).append(p)
    return out


@pytest.mark.parametrize("gap,closed", [(8.0, False), (15.0, True)])
def test_spacing_equals_list_order_even_with_copies(spark, gap, closed):
    rows = cloud(120, 1, copies=60)
    want = set()
    for ps in by_layer(rows).values():
        kept = []
        for p in ps:
            if all((d(p, k) > gap if closed else d(p, k) >= gap) for k in kept):
                kept.append(p)
        want |= {p[1] for p in kept}
    got = {r.ord for r in fixpoint.spaced(points(spark, rows).repartition(5), gap, closed=closed).collect()}
    assert got == want


def test_clusters_equal_components_even_with_copies(spark):
    rows = cloud(80, 2, copies=50)
    eps, want = 9.0, {}
    for ps in by_layer(rows).values():
        left = list(ps)
        while left:
            group, todo = [], [left.pop(0)]
            while todo:
                p = todo.pop()
                group.append(p)
                near = [q for q in left if d(p, q) <= eps]
                left = [q for q in left if q not in near]
                todo += near
            name = min(q[1] for q in group)
            want.update({q[1]: name for q in group})
    got = {r.ord: r.cluster for r in fixpoint.cluster(points(spark, rows), eps).collect()}
    assert got == want


def test_long_chain_component(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(300)], "layer_id long, u long, v long")
    nodes = spark.createDataFrame([(0, i) for i in range(302)], "layer_id long, node long")
    got = {r.node: r.component for r in fixpoint.components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 301: 301}


@pytest.mark.parametrize("later", [False, True])
def test_pairwise_thinning_equals_list_order(spark, later):
    rows = cloud(150, 3)
    gone = set()
    for ps in by_layer(rows).values():
        used = set()
        for i, p in enumerate(ps):
            if p[1] in used:
                continue
            near = [q for q in (ps[i + 1:] if later else ps) if q is not p and q[1] not in used and d(p, q) <= 8.0]
            if near:
                q = min(near, key=lambda q: (d(p, q), q[1]))
                used |= {p[1], q[1]}
                gone.add(q[1])
    left = {r.ord for r in fixpoint.thin_pairs(points(spark, rows), 8.0, later_only=later).collect()}
    assert left == {p[1] for p in rows} - gone


def test_deletions_equal_list_order(spark):
    rows, sites = cloud(100, 4), cloud(60, 5)
    rank = {"intersection": 1, "curve": 2, "endpoint": 3}
    left = {p[1]: p for p in rows}
    for s in sites:
        near = [p for p in left.values() if p[0] == s[0] and d(p, s) < 10]
        if near:
            del left[min(near, key=lambda p: (rank[p[4]], d(p, s), p[1]))[1]]
    got = {r.ord for r in select.nearest_deletions(points(spark, rows), points(spark, sites)).collect()}
    assert got == set(left)


def test_pairs_and_nearest_equal_brute_force(spark):
    rows = cloud(90, 6, copies=5)
    df = points(spark, rows)
    want = {(a[1], b[1]) for ps in by_layer(rows).values() for a in ps for b in ps if a[1] < b[1] and d(a, b) <= 12.0}
    assert {(r.ord1, r.ord2) for r in pairs_within(df, 0.0, 12.0).collect()} == want
    far = points(spark, [(0, 1000, 5000.0, 5000.0, "curve"), (7, 1001, 0.0, 0.0, "curve")])
    got = {r.ord: (r.near_ord, r.near_d) for r in nearest(df.unionByName(far), df).collect()}
    best = min((p for p in rows if p[0] == 0), key=lambda p: (math.hypot(p[2] - 5000, p[3] - 5000), p[1]))
    assert got[1000][0] == best[1] and got[1001] == (None, None)
    k = {r.ord: r.near_d for r in k_nearest(far, df, 5).collect()}
    assert k[1001] == [1000.0] * 5
    assert k[1000] == pytest.approx(sorted(math.hypot(p[2] - 5000, p[3] - 5000) for p in rows if p[0] == 0)[:5])


def test_segment_cells_cover_their_neighbourhood_once(spark):
    r = random.Random(7)
    segs = [(0, i, r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(-50, 50), r.uniform(-50, 50)) for i in range(40)] + [(0, 98, 5.0, -20.0, 5.0, 20.0), (0, 99, 3.0, 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(segs, "layer_id long, id long, x1 double, y1 double, x2 double, y2 double")
    cells = [(c.id, c.cx, c.cy) for c in segment_cells(df, 10.0, 4.0).collect()]
    assert len(cells) == len(set(cells))
    have = set(cells)
    for _, i, x1, y1, x2, y2 in segs:
        for k in range(51):
            a = r.uniform(0, 2 * math.pi)
            x, y = x1 + (x2 - x1) * k / 50 + 3.99 * math.cos(a), y1 + (y2 - y1) * k / 50 + 3.99 * math.sin(a)
            assert (i, math.floor(x / 10), math.floor(y / 10)) in have


# a square loop of side 40 with 5 m bands; shares by hand
LOOP = [(0, 1, 0.0, 0.0, 40.0, 0.0, 5.0), (0, 2, 40.0, 0.0, 40.0, 40.0, 5.0), (0, 3, 40.0, 40.0, 0.0, 40.0, 5.0), (0, 4, 0.0, 40.0, 0.0, 0.0, 5.0)]
CASES = [((0, 0), (40, 0), 1.0), ((0, 0), (40, 40), 0.25), ((0, 0), (20, 20), 0.25), ((0, 20), (40, 20), 0.25), ((20, 0), (20, 40), 0.25), ((0, 0), (0, 40), 1.0), ((40, 0), (40, 40), 1.0)]


def test_union_share_on_the_square_loop(spark):
    roads = spark.createDataFrame(LOOP, "layer_id long, road_id long, x1 double, y1 double, x2 double, y2 double, half_width double")
    rows = [(0, i, 100 + i, *map(float, p), *map(float, q)) for i, (p, q, _) in enumerate(CASES)]
    lk = spark.createDataFrame(rows, "layer_id long, ord1 long, ord2 long, x1 double, y1 double, x2 double, y2 double")
    got = {r.ord1: r.share for r in links.union_share(links.link_intervals(lk, roads, {"b": 0.0}), "b").collect()}
    for i, (_, _, share) in enumerate(CASES):
        assert got[i] == pytest.approx(share, abs=1e-9), CASES[i]


def test_band_interval_equals_sampling(spark):
    r = random.Random(8)
    rows = [(0, i, 1000 + i, *[r.uniform(0, 60) for _ in range(4)]) for i in range(30)]
    lk = spark.createDataFrame(rows, "layer_id long, ord1 long, ord2 long, x1 double, y1 double, x2 double, y2 double")
    roads = spark.createDataFrame([(0, 1, 10.0, 10.0, 45.0, 30.0, 7.0)], "layer_id long, road_id long, x1 double, y1 double, x2 double, y2 double, half_width double")
    got = {x.ord1: x.share for x in links.best_share(links.link_intervals(lk, roads, {"b": 0.0}), "b").collect()}

    def seg(px, py):
        t = max(0.0, min(1.0, ((px - 10) * 35 + (py - 10) * 20) / (35 * 35 + 400)))
        return math.hypot(px - 10 - 35 * t, py - 10 - 20 * t)
    for _, i, _, x1, y1, x2, y2 in rows:
        share = sum(seg(x1 + (x2 - x1) * (k + .5) / 2000, y1 + (y2 - y1) * (k + .5) / 2000) <= 7 for k in range(2000)) / 2000
        assert (got.get(i) or 0.0) == pytest.approx(share, abs=2e-3)


def test_thinning_equals_the_published_rule(spark):
    img = {(r, c) for r in range(4, 9) for c in range(2, 40)} | {(r, c) for r in range(0, 30) for c in range(18, 23)} | {(r, c) for r in range(20, 26) for c in range(22, 34)}
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    want = set(img)
    while True:
        before = len(want)
        for first in (True, False):
            out = set()
            for r, c in want:
                n = [(r + a, c + b) in want for a, b in around]
                turns = sum(not n[i] and n[(i + 1) % 8] for i in range(8))
                p2, p4, p6, p8 = n[0], n[2], n[4], n[6]
                sides = (not (p2 and p4 and p6) and not (p4 and p6 and p8)) if first else (not (p2 and p4 and p8) and not (p2 and p6 and p8))
                if 2 <= sum(n) <= 6 and turns == 1 and sides:
                    out.add((r, c))
            want -= out
        if len(want) == before:
            break
    px = spark.createDataFrame([(0, r, c) for r, c in img], "layer_id long, row long, col long")
    assert {(x.row, x.col) for x in raster.thin(px).collect()} == want


def test_ring_raster_and_inside(spark):
    ring = [(0.0, 0.0), (30.0, 5.0), (22.0, 28.0), (12.0, 14.0), (3.0, 25.0)]
    rows = [(0, 1, i, *ring[i], *ring[(i + 1) % 5]) for i in range(5)]
    e = spark.createDataFrame(rows, "layer_id long, shape_id long, edge_id long, x1 double, y1 double, x2 double, y2 double")

    def inside(x, y):
        odd = False
        for i in range(5):
            (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % 5]
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                odd = not odd
        return odd
    want = {(r, c) for r in range(-2, 32) for c in range(-2, 34) if inside(c + .5, r + .5)}
    assert {(p.row, p.col) for p in raster.rasterise_rings(e, 1.0).collect()} == want
    sites = points(spark, [(0, i, r_ + .5, c + .5, "curve") for i, (r_, c) in enumerate([(5, 5), (12, 20), (12, 10), (40, 2)])])
    got = {s.ord: s.inside for s in polygons.inside(sites, e, row=7.0).collect()}
    assert got == {i: inside(r_ + .5, c + .5) for i, (r_, c) in enumerate([(5, 5), (12, 20), (12, 10), (40, 2)])}


def test_positions_and_windows_cross_block_borders(spark):
    rows = [(l, i * 3 + (i % 2), float(i), float((i * 7) % 11)) for l in (0, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "layer_id long, ord long, x double, y double")
    p = sequence.with_position(df, block=16, total="n")
    assert {(r.layer_id, r.ord): (r.pos, r.n) for r in p.collect()} == {(l, o): (i, 200) for l in (0, 1) for i, o in enumerate(sorted(r[1] for r in rows if r[0] == l))}
    got = {(r.layer_id, r.pos): (r.p2_x, r.n2_x) for r in sequence.neighbours(p, ["x"], 2, block=8).collect()}
    assert got == {(l, i): (float(i - 2) if i >= 2 else None, float(i + 2) if i < 198 else None) for l in (0, 1) for i in range(200)}


def test_islands_across_blocks(spark):
    r = random.Random(9)
    idx = sorted(r.sample(range(30000), 4000)) + list(range(40000, 52000))
    df = spark.createDataFrame([(0, i) for i in idx], "layer_id long, idx long")
    runs, cur = [], [idx[0]]
    for a in idx[1:]:
        if a - cur[-1] <= 3:
            cur.append(a)
        else:
            runs.append(cur)
            cur = [a]
    runs.append(cur)
    want = {x[0]: (len(x), x[len(x) // 2]) for x in runs if len(x) >= 5}
    got = {x.run: (x.run_size, x.idx) for x in sequence.representatives(sequence.islands(df, 3, 5)).collect()}
    assert got == want


@pytest.mark.parametrize("q", [0.05, 0.5, 0.9])
def test_exact_quantile(spark, q):
    import numpy as np
    v = [random.Random(i).choice([1.0, 2.0, 2.0, 7.5]) * (i % 17) for i in range(500)]
    df = spark.createDataFrame([(0, x) for x in v], "layer_id long, v double")
    assert sequence.exact_quantile(df, "v", q).first().quantile == pytest.approx(float(np.quantile(v, q)))


def test_ranks_equal_sort(spark):
    v = [((i * 37) % 50) / 7 for i in range(300)]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "layer_id long, ord long, v double")
    want = {o: k + 1 for k, (o, _) in enumerate(sorted(enumerate(v), key=lambda t: (-t[1], t[0])))}
    assert {r.ord: r["rank"] for r in sequence.ranked(df, "v", block=8).collect()} == want


def test_resample_equals_the_walk(spark):
    r = random.Random(10)
    x = y = 0.0
    rows = []
    for i in range(600):
        x, y = x + r.choice([0.0, 1.0, 3.0]), y + r.choice([0.0, 2.0])
        rows.append((0, i, x, y))
    kept, acc, last = [0], 0.0, rows[0]
    for p in rows[1:]:
        acc += math.hypot(p[2] - last[2], p[3] - last[3])
        if acc >= 15:
            kept.append(p[1])
            acc, last = 0.0, p
    if math.hypot(rows[-1][2] - last[2], rows[-1][3] - last[3]) > 7.5:
        kept.append(599)
    df = spark.createDataFrame(rows, "layer_id long, ord long, x double, y double")
    assert sorted(p.ord for p in curves.resample(df, 15.0, block=64, look=4).collect()) == kept


def test_projection_round_trip_and_known_point(spark):
    df = spark.createDataFrame([(221436.193, 307987.531)], "x double, y double")
    there = clean.convert(df, "EPSG:5186", "EPSG:5187")
    back = clean.convert(there, "EPSG:5187", "EPSG:5186").first()
    assert (back.x, back.y) == (pytest.approx(221436.193, abs=1e-4), pytest.approx(307987.531, abs=1e-4))
    origin = clean.project(spark.createDataFrame([(127.0, 38.0)], "lon double, lat double"), 127.0).first()
    assert (origin.x, origin.y) == (pytest.approx(200000.0, abs=1e-6), pytest.approx(600000.0, abs=1e-6))


def test_segments_and_context_on_a_t_network(spark):
    nodes = [(0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (100, 0), (200, 0), (300, 0), (100, 60), (100, 120)])]
    e = [(0, 0, 1, 100.0), (0, 1, 2, 100.0), (0, 2, 3, 100.0), (0, 1, 4, 60.0), (0, 4, 5, 60.0)]
    n = spark.createDataFrame(nodes, "layer_id long, ord long, x double, y double")
    ed = spark.createDataFrame(e, "layer_id long, u long, v long, w double")
    t = sorted((r.length, r.edges, r.is_main) for r in graph.segment_table(n, graph.segments(n, ed)).collect())
    assert t == [(100.0, 1, True), (120.0, 2, True), (200.0, 2, True)]
    c = graph.point_context(points(spark, [(0, 9, 102.0, 1.0, "curve")]), n, ed).first()
    assert c.main_near == 3 and c.branch_ratio == 0.0 and c.on_main and c.position_score == 0.0


def test_shortest_paths_equal_dijkstra(spark):
    import heapq
    r = random.Random(11)
    e = list({(min(a, b), max(a, b)): (0, min(a, b), max(a, b), float(r.randint(1, 9))) for a, b in ((r.randrange(25), r.randrange(25)) for _ in range(60)) if a != b}.values())
    adj = {}
    for _, u, v, w in e:
        adj.setdefault(u, []).append((v, w))
        adj.setdefault(v, []).append((u, w))
    best, q = {}, [(0.0, e[0][1])]
    while q:
        dd, u = heapq.heappop(q)
        if u in best:
            continue
        best[u] = dd
        for v, w in adj.get(u, []):
            heapq.heappush(q, (dd + w, v))
    s = spark.createDataFrame([(0, e[0][1])], "layer_id long, source long")
    got = {x.node: x.dist for x in fixpoint.shortest_paths(spark.createDataFrame(e, "layer_id long, u long, v long, w double"), s).collect()}
    assert got == best


def test_betweenness_of_a_path(spark):
    n = spark.createDataFrame([(0, i) for i in range(5)], "layer_id long, ord long")
    e = spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(4)], "layer_id long, u long, v long, w double")
    got = {r.ord: r.betweenness for r in graph.betweenness(n, e, n.withColumnRenamed("ord", "source")).collect()}
    assert got == {0: 0.0, 1: 6.0, 2: 8.0, 3: 6.0, 4: 0.0}


def test_order_of_input_does_not_matter(spark):
    rows = cloud(100, 12)
    a = {r.ord for r in select.priority_spacing(points(spark, rows)).collect()}
    b = {r.ord for r in select.priority_spacing(points(spark, rows[::-1]).repartition(7)).collect()}
    assert a == b


def test_skeleton_lines_are_ordered(spark):
    line = {(0, c) for c in range(30)} | {(r, 15) for r in range(1, 12)}
    ring = {(20, c) for c in range(5)} | {(24, c) for c in range(5)} | {(r, 0) for r in range(21, 24)} | {(r, 4) for r in range(21, 24)}
    ring -= {(20, 0), (20, 4), (24, 0), (24, 4)}  # corner pixels would be chords, not a plain loop
    px = spark.createDataFrame([(0, r, c) for r, c in line | ring], "layer_id long, row long, col long")
    rows = raster.skeleton_lines(px).collect()
    by = {}
    for r in rows:
        by.setdefault(r.seg, []).append((r.step, r.x, r.y))
    for pts in by.values():
        pts.sort()
        assert [p[0] for p in pts] == list(range(len(pts)))
        assert all(max(abs(a[1] - b[1]), abs(a[2] - b[2])) == 1 for a, b in zip(pts, pts[1:]))
    assert len(ring) in {len(p) for p in by.values()}
