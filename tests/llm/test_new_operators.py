"""Multi-index search, spelling variants and collocations against brute force on small tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import frame

from roadpoints.llm import collocations, multi_index, permuterm

VECTORS = "vec_id long, embedding array<double>, ids long, cell int, score double"


def vectors(n, seed, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    rows = [(i, (centres[i % 6] + 0.4 * rng.normal(size=size)).tolist()) for i in range(n)]
    same = rows[10][1]
    rows += [(1000 + i, same) for i in range(60)]  # one vector many times
    rows += [(1000, same), (1000, same), (2000, rows[0][1]), (2000, rows[1][1])]  # repeated rows, and two vectors of one id
    rows += [(2001, None), (2002, []), (2003, [0.0] * size), (2004, [1.0, None] + [1.0] * (size - 2)), (2050, [float("nan")] * size), (2100, [float("inf")] + [1.0] * (size - 1)),
             (2150, [1.0, 2.0]), (None, rows[3][1]), (2200, [1e200 * v for v in rows[4][1]]), (2250, [1e-200 * v for v in rows[5][1]])]
    return [(i, v, 1, 2, 3.0) for i, v in rows]


def exact(rows, k, every):
    size = 8
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and len(v) == size and all(c is not None and np.isfinite(c) for c in v) and any(v):
            a = np.array(v)
            good.setdefault(i, set()).add(tuple(a / np.abs(a).max()))
    out = {}
    for q in good:
        if q % every == 0:
            best = {i: max(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) for a in map(np.array, good[q]) for b in map(np.array, vs)) for i, vs in good.items() if i != q}
            out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_multi_index_finds_true_neighbours(spark):
    rows = vectors(400, 1)
    got = defaultdict(list)
    for r in multi_index.nearest(spark.createDataFrame(rows, VECTORS).repartition(5), every=50, target=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = exact(rows, 5, 50)
    assert set(got) == set(want) and 1000 in want and 2200 in want and 2050 not in got
    assert all([r for r, *_ in v] == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(i in dict(want[q]) for q, v in got.items() for _, i, _ in v)
    assert hits >= 0.9 * 5 * len(want)
    assert [i for _, i, _ in got[1000]] == [i for i, _ in want[1000]]  # ties among copies go to the smaller ids
    for q, v in got.items():
        for _, i, s in v:
            assert i not in dict(want[q]) or s == pytest.approx(dict(want[q])[i], abs=1e-12)


def test_multi_index_visits_cells_in_order():
    rng = np.random.default_rng(3)
    index = multi_index.Index(rng.normal(size=(200, 6)), 8)
    index.counts[:] = rng.integers(0, 4, index.counts.shape)
    a, b = rng.random(len(index.books[0])), rng.random(len(index.books[1]))
    cells = [c for c, _ in index.visits(a, b, int(index.counts.sum()))]
    sums = [a[c // len(b)] + b[c % len(b)] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == np.flatnonzero(index.counts.reshape(-1)).tolist()
    assert list(index.visits(a, b, int(index.counts.sum())))[-1][1] == index.counts.sum()


def test_multi_index_small_tables(spark):
    assert multi_index.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    assert multi_index.nearest(spark.createDataFrame([(7, [1.0, 2.0], 1, 2, 3.0)], VECTORS)).count() == 0
    two = multi_index.nearest(spark.createDataFrame([(50, [1.0], 1, 2, 3.0), (51, [-2.0], 1, 2, 3.0)], VECTORS)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in two] == [(50, 1, 51, -1.0)]


def variants(rows, least, count, times, every):
    n = Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        beside = [v for v in n if near(v, w)]
        best = min(beside, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= times * n[w]:
            form[w] = best
        out[w] = len(beside)
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n[w], k, n.get(form.get(w))) for w, k in out.items()}


@pytest.mark.parametrize("every", [31, 3])
def test_spelling_variants(spark, every):
    words = ["Committee", "committee", "comittee", "commmittee", "committée", "kommittee", "ÀÉÎÕÜÿ×÷", "àéîõüÿ×÷", "aaaaaaaa", "aaaaaaa", "aaabaaaa", "x" * 400, "x" * 401, "x" * 200 + "y" + "x" * 199, "short"]
    rows = [(i if i % 9 else None, " ".join(words[(i * k + k) % len(words)] + ",;\n "[k % 4] for k in range(1, 40)), "en", "s", 0) for i in range(80)]
    rows += [(1, None, None, None, None), (2, "", "", "", 0), (3, "committee " * 3000, None, None, 0), (3, "committee " * 3000, None, None, 0)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in permuterm.spelling_variants(frame(spark, rows, clashing=True), every=every).collect()}
    want = variants(rows, 7, 2, 10, every)
    assert got == want and any(v[0] for v in want.values())


def test_no_words(spark):
    none = frame(spark).limit(0)
    assert permuterm.spelling_variants(none).count() == 0 and collocations.collocations(none).count() == 0


def phrases(rows, least, top, inside):
    f, total = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p for q, b in cand.items() if len(q) == 3 for p in (q[:2], q[1:]) if p in cand and 100 * b >= inside * cand[p]}
        rows_ = []
        for p, a in cand.items():
            if p not in gone:
                score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return out


def test_collocations(spark, monkeypatch):
    rng = np.random.default_rng(5)
    zipf = lambda n: " ".join(f"w{min(int(x), 40)}" + ["", "", "", ".", ",", "\t", "!\n", "É"][int(rng.integers(8))] for x in rng.zipf(1.4, n))
    rows = [(i, zipf(int(rng.integers(0, 120))), ["en", "und", None, "de"][i % 4], "s", 0) for i in range(60)]
    rows += [(1, "New York City " * 30, "en", "", 0), (1, "New York City " * 30, "en", "", 0), (2, "the the the " * 4000, "en", "", 0), (3, None, None, None, None), (4, "", "xx", "", 0), (5, "\x00 odd \x00 odd " * 9, "xx", "", 0)]
    for most, held in ((300_000, 150_000), (20, 30)):  # also when tasks hand on often
        monkeypatch.setattr(collocations, "MOST", most)
        monkeypatch.setattr(collocations, "HELD", held)
        df = collocations.collocations(frame(spark, rows, clashing=True).repartition(4), least=4, top=50)
        assert {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == phrases(rows, 4, 50, 50)


def test_automata_unite_and_compose():
    rng = np.random.default_rng(9)
    part = lambda n: (np.where(np.arange(3) < rng.integers(1, 4, n)[:, None], rng.integers(1, 9, (n, 3)), 0).astype(np.uint64), rng.integers(1, 5, n))
    parts = [part(50), part(80), part(1)]
    want = Counter()
    for w, n in parts:
        for p, c in zip(w.tolist(), n.tolist()):
            want[tuple(p)] += c
    one = collocations.Counts.load(collocations.Counts.union([collocations.Counts.of(*p) for p in parts]).dump())
    words, n = one.hashes()
    assert {tuple(p): c for p, c in zip(words.tolist(), n.tolist())} == dict(want)
    asked = np.array([[x, y, z] for x in range(1, 10) for y in range(10) for z in range(10) if y or not z], np.uint64)
    assert one.weights(asked).tolist() == [want.get(tuple(p), 0) for p in asked.tolist()]
    assert len(one.b3) - 1 <= len(one.a2)  # states with equal ends are shared
