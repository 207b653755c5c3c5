"""Disc measures against a fine grid and plain Python, and rings longer than a block."""

import math
import random

import numpy as np

from roadpoints.operators import discs as D

SITE = "layer_id long, ord long, x double, y double"
EDGE = "layer_id long, ring long, edge_id long, x1 double, y1 double, x2 double, y2 double"
RING = "layer_id long, ring long, ord long, x double, y double"


def edges_of(rings):
    out = []
    for layer, ring, pts in rings:
        out += [(layer, ring, ring * 1000 + i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(pts, pts[1:] + pts[:1]))]
    return out


def held(px, py, pts):
    odd = np.zeros(px.shape, bool)
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
        if y1 != y2:
            odd ^= ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) / (y2 - y1) * (x2 - x1))
    return odd


def test_area_and_outline_in_a_disc(spark):
    """A frame with a slanted hole and an island in it; discs across corners, touching, all inside, all outside, around everything."""
    outer, hole, isle = [(0, 0), (300, 0), (300, 200), (150, 260), (0, 200)], [(100, 60), (90, 150), (190, 160), (200, 70)], [(130, 90), (160, 95), (150, 120)]
    rng = random.Random(7)
    at = [(rng.uniform(-30, 330), rng.uniform(-30, 290)) for _ in range(60)] + [(50.0, 100.0), (-500.0, 0.0), (0.0, 0.0), (300.0, 40.0), (145.0, 105.0), (145.0, 105.0), (300.0, -40.0)]
    sites = [(1, i, x, y) for i, (x, y) in enumerate(at)] + [(1, 900, None, 5.0), (1, 901, float("nan"), 5.0), (2, 902, 5.0, 5.0)]
    edges = spark.createDataFrame(edges_of([(1, 0, outer), (1, 1, hole), (1, 2, isle)]), EDGE)
    for r in (40.0, 400.0):
        got = {g["ord"]: g for g in D.disc_cut(spark.createDataFrame(sites, SITE), edges, r).collect()}
        assert len(got) == len(sites)
        step = r / 400
        g = np.arange(-r + step / 2, r, step)
        gx, gy = (v.ravel() for v in np.meshgrid(g, g))
        disc = gx * gx + gy * gy <= r * r
        ang = (np.arange(200_000) + 0.5) / 200_000 * 2 * math.pi
        for i, (x, y) in enumerate(at):
            road = lambda px, py: held(px, py, outer) & ~held(px, py, hole) | held(px, py, isle)
            area = road(gx[disc] + x, gy[disc] + y).sum() * step * step
            length = road(x + r * np.cos(ang), y + r * np.sin(ang)).mean() * 2 * math.pi * r
            for pts in (outer, hole, isle):
                for p, q in zip(pts, pts[1:] + pts[:1]):
                    t = (np.arange(4000) + 0.5) / 4000
                    on = np.hypot(p[0] + t * (q[0] - p[0]) - x, p[1] + t * (q[1] - p[1]) - y) <= r
                    length += on.mean() * math.dist(p, q)
            assert abs(got[i]["cut_area"] - area) < 0.004 * math.pi * r * r, (r, i, x, y, got[i]["cut_area"], area)
            assert abs(got[i]["cut_length"] - length) < 0.5, (r, i, x, y, got[i]["cut_length"], length)
        assert all(got[o]["cut_area"] == 0 and got[o]["cut_length"] == 0 for o in (900, 901, 902))
    none = D.disc_cut(spark.createDataFrame(sites[:2], SITE), edges.where("false"), 40.0).collect()
    assert [n["cut_area"] for n in none] == [0.0, 0.0]


def turn_list(near):
    out = []
    for a, b, c in zip(near, near[1:], near[2:]):
        u, v = (b[0] - a[0], b[1] - a[1]), (c[0] - b[0], c[1] - b[1])
        n = math.hypot(*u) * math.hypot(*v)
        if n > 0:
            out.append(math.acos(max(-1, min(1, (u[0] * v[0] + u[1] * v[1]) / n))))
    return out


def test_turns_in_a_disc(spark):
    """Rings that leave and enter the disc often, repeated vertices, one site many times, sites with too few vertices."""
    rng = random.Random(11)
    rings, n = [], 0
    for ring in range(6):
        for _ in range(41):
            x, y = rng.uniform(0, 90), rng.uniform(0, 90)
            for _ in range(rng.choice((1, 1, 3))):
                rings.append((1, ring, n, x, y))
                n += 1
    sites = [(1, i, rng.uniform(0, 90), rng.uniform(0, 90)) for i in range(40)] + [(1, 50 + i, 45.0, 45.0) for i in range(5)] + [(1, 90, 500.0, 0.0), (1, 91, None, None), (2, 92, 1.0, 1.0)]
    for step in (1, 2):
        line = [(x, y) for r in range(6) for i, (_, _, _, x, y) in enumerate(v for v in rings if v[1] == r) if i % step == 0]
        got = D.disc_turns(spark.createDataFrame(sites, SITE), spark.createDataFrame(rings, RING), 25.0, step).collect()
        assert len(got) == len(sites)
        for g in got:
            near = [] if g["x"] is None or g["layer_id"] == 2 else [p for p in line if math.sqrt((p[0] - g["x"]) ** 2 + (p[1] - g["y"]) ** 2) <= 25]
            t = turn_list(near) if len(near) >= 3 else []
            want = sum(t) / len(t) + max(t) / 2 if t else 0.0
            assert g["n_near"] == len(near) and abs(g["curve_complexity"] - want) < 1e-6
            assert g["is_critical"] == any(a > math.pi / 6 for a in t)
            assert abs(g["curve_score"] - (len(near) / (math.pi * 625) * want * 100)) < 1e-6


def test_sharp_vertices_on_rings_longer_than_a_block(spark):
    rng = random.Random(5)
    rows, want = [], []
    for ring, size in enumerate((0, 1, 2, 3, 4, 5, 37, 90)):
        pts = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(size)]
        if ring % 2 and size > 2:
            pts.append(pts[0])
        rows += [(1, ring, ring * 100 + i, x, y) for i, (x, y) in enumerate(pts)]
        shut = pts if not pts or pts[0] == pts[-1] else pts + [pts[0]]
        a = [math.atan2(q[1] - p[1], q[0] - p[0]) for p, q in zip(shut, shut[1:])]
        if len(a) >= 2:
            slope = np.gradient(np.array(a))
            want += [(ring, round(shut[i + 1][0], 6), round(abs(float(slope[i])), 6)) for i in range(len(a) - 1) if abs(slope[i]) > 0.3]
    got = D.sharp_vertices(spark.createDataFrame(rows, RING), block=8).collect()
    assert sorted((g["ring"], round(g["x"], 6), round(g["change"], 6)) for g in got) == sorted(want)


def test_width_of_the_first_ring_around_a_site(spark):
    """Overlapping bands: the first ring that holds the site; ties outside to the first; no skeleton, no roads."""
    bands = [(1, 5, [(0, -6), (100, -6), (100, 6), (0, 6)]), (1, 3, [(44, -50), (56, -50), (56, 50), (44, 50)])]
    sites = [(1, 0, 50.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 20.0, 20.0), (1, 3, 38.0, 12.0), (2, 4, 0.0, 0.0)]
    skel = spark.createDataFrame([(1, 50.0, 1.0), (1, 50.0, 1.0), (1, 10.0, 15.0)], "layer_id long, x double, y double")
    got = {g["ord"]: g for g in D.local_width(spark.createDataFrame(sites, SITE), spark.createDataFrame(edges_of(bands), EDGE), skel).collect()}
    assert [got[i]["ring"] for i in range(5)] == [3, 5, 5, 3, None]
    assert [got[i]["road_d"] for i in range(4)] == [0.0, 0.0, 14.0, 6.0]
    assert abs(got[0]["skeleton_density"] - 2 / (math.pi * 225)) < 1e-12 and abs(got[1]["skeleton_density"] - 1 / (math.pi * 225)) < 1e-12
    half = 12 * math.sqrt(225 - 36) + 2 * 225 * math.asin(6 / 15)
    assert abs(got[0]["road_width"] - half / (4 * math.sqrt(225 - 36) + 4 * 15 * math.asin(6 / 15))) < 1e-9
    assert got[4]["road_width"] == 0 and got[4]["importance"] == 0
