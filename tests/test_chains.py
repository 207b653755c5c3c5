"""Chains of sites: shapes by hand, random graphs against a walk in Python, a long chain in few rounds."""

import math
import random
from collections import defaultdict

from roadpoints.operators import chains as CH

EDGE = "layer_id long, u long, v long, w double"


def walked(pairs):
    """Every chain by walking: {(start, second): ([sites], is_loop)}."""
    near = defaultdict(set)
    for u, v in pairs:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    stop = {n for n in near if len(near[n]) != 2}
    seen = set()
    for n in sorted(near):  # closed rings
        if n in seen:
            continue
        todo, part = [n], {n}
        while todo:
            for m in near[todo.pop()] - part:
                part.add(m)
                todo.append(m)
        seen |= part
        if not part & stop:
            stop.add(min(part))
    out = {}
    for s in stop:
        for t in near[s]:
            way = [s, t]
            while way[-1] not in stop:
                way.append(next(m for m in near[way[-1]] if m != way[-2]))
            if (s, t) <= (way[-1], way[-2]) and (s != way[-1] or t < way[-2]):
                out[(s, t)] = (way[:-1] if way[-1] == s else way, way[-1] == s)
    return out


def gathered(df):
    got = defaultdict(list)
    for r in df.collect():
        got[(r["layer_id"], r["start"], r["second"])].append((r["pos"], r["ord"], r["is_loop"], r["measure"]))
    return {k: sorted(v) for k, v in got.items()}


def test_chains_of_all_shapes(spark):
    """Open chains, a ring, rings hanging on a branch, a ring of three, self links, random sparse graphs."""
    rng = random.Random(2)
    graphs = {0: [(1, 2)], 1: [(5, 3), (3, 9), (9, 1)], 2: [(4, 7), (7, 2), (2, 9), (9, 4)], 3: [(1, 2), (2, 3), (3, 1), (1, 9), (1, 8)], 4: [(1, 2), (2, 3), (1, 3)], 5: [(7, 7), (7, 8)],
              6: [(10, 11), (11, 12), (12, 10), (12, 13), (13, 14), (14, 15), (15, 16), (16, 14)]}
    for g in range(7, 13):
        graphs[g] = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(55)})
    rows = [(g, u, v, 1.0) for g, e in graphs.items() for u, v in e]
    got = gathered(CH.chains(spark.createDataFrame(rows, EDGE)))
    want = {(g, *k): [(i, s, loop, float(i)) for i, s in enumerate(way)] for g, e in graphs.items() for k, (way, loop) in walked(e).items()}
    assert got == want
    assert CH.chains(spark.createDataFrame([], EDGE)).count() == 0


def test_a_long_chain(spark):
    """100,000 sites in one chain, named at random: 17 rounds of doubling."""
    n = 100_000
    name = list(range(n))
    random.Random(1).shuffle(name)
    rows = spark.range(n - 1).select("id")
    ids = spark.createDataFrame(list(enumerate(name)), "id long, name long")
    e = rows.join(ids.selectExpr("id", "name AS u"), "id").join(ids.selectExpr("id - 1 AS id", "name AS v"), "id").selectExpr("1L AS layer_id", "u", "v", "2D AS w")
    got = [(r["ord"], r["measure"]) for r in CH.chains(e).orderBy("pos").collect()]
    line = name if name[0] < name[-1] else name[::-1]
    assert got == [(s, 2.0 * i) for i, s in enumerate(line)]


def test_redundant_curves_go(spark):
    """A straight run between two sites loses its inner curves only; a bent one, a pair and sites off the graph lose none."""
    nodes = [(1, i, i * 5.0, 0.0) for i in range(6)] + [(1, 20 + i, 0.0 if i < 3 else (i - 2) * 5.0, 100.0 + min(i, 2) * 5.0) for i in range(5)]
    link = [(1, i, i + 1, 5.0) for i in range(5)] + [(1, 20 + i, 21 + i, 5.0) for i in range(4)]
    sites = [(1, i, i * 5.0 + 0.5, 1.0, "intersection" if i == 2 else "curve") for i in range(6)] + [(1, 20 + i, n[2], n[3], "curve") for i, n in enumerate(nodes[6:])]
    sites += [(1, 50, 3.0 * 5, 2.0, "curve"), (1, 51, 500.0, 0.0, "curve"), (1, 52, None, 0.0, "curve")]
    S, N = "layer_id long, ord long, x double, y double, category string", "layer_id long, ord long, x double, y double"
    got = CH.without_redundant(spark.createDataFrame(sites, S), spark.createDataFrame(nodes, N), spark.createDataFrame(link, EDGE))
    assert {s[1] for s in sites} - {r["ord"] for r in got.collect()} == {1, 3, 4}
    held, pair = CH.site_graph(spark.createDataFrame(sites, S), spark.createDataFrame(nodes, N), spark.createDataFrame(link, EDGE))
    shape = {r["start"]: r for r in CH.chain_shape(CH.chains(pair), held).collect()}
    assert shape[0]["sites"] == 6 and shape[0]["ratio"] == 1.0 and shape[0]["straight"]
    assert not shape[20]["straight"] and abs(shape[20]["ratio"] - math.hypot(10, 10) / 20) < 1e-12
