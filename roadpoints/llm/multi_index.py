"""Nearest vectors by cosine with an inverted multi-index.

Unit vectors are cut into two halves, and each half has a codebook of its own. A cell is a pair of centroids, one of each half. A query visits
cells by the sum of its two squared distances: a heap walks the two sorted lists of distances and pops the next best pair. All entries of
a visited cell are compared on the original vectors.

How many entries a query visits is measured, not set: for a bounded number of query vectors the true neighbours are found by brute force
over all rows, and the visits end where TARGET of these neighbours have been met. On vectors without structure this is a large share of the rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from roadpoints.llm.registry import query, table
from roadpoints.session import cut, cut_counting

NEAREST, QUERY_EVERY = 5, 50
#: rows on which the codebooks are fitted, at most (those of smallest hash), and rounds of the fit
FIT_ROWS, FIT_ROUNDS = 16_384, 12
#: centroids of a half, at most: cells and their counts stay a table of MOST_CENTROIDS ** 2 numbers
MOST_CENTROIDS = 128
#: query vectors on which the visits are measured, at most, and the share of true neighbours that they must meet
MEASURED, TARGET = 128, 0.96
#: shares into which the entries are dealt by cells, entries of a share at least and at most, and query vectors of a block
SHARES, SHARE_LEAST, SHARE_MOST, QUERY_BLOCK = 48, 256, 65_536, 8_192
#: how far a first score, computed in another order of additions, may be from the exact one
SLACK = 1e-9


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``a`` with the same rows of ``b``, each computed alike wherever the rows stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def _usable(batches):
    """(vec_id, digest, size, v): vectors of finite numbers, not all zero, divided by a power of two so that no square overflows."""
    schema = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("size", pa.int32()), ("v", pa.binary())])
    for batch in batches:
        ids, out = batch.column(0).to_pylist(), []
        for i, v in zip(ids, batch.column(1).to_pylist()):
            if i is None or not v or any(c is None for c in v):
                continue
            a = np.array(v, np.float64)
            top = np.abs(a).max()
            if not np.isfinite(top) or top == 0:
                continue
            a = np.ldexp(a, -int(np.frexp(top)[1])) + 0.0
            out.append((i, hashlib.md5(np.array(v, np.float64).tobytes()).digest(), len(a), a.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


def codebook(x: np.ndarray, size: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids of the rows of ``x`` by Lloyd's rounds; starts are chosen one after the other, far from the earlier ones."""
    rng = np.random.default_rng(7)
    size = min(size, len(x))
    start, far = [int(rng.integers(len(x)))], None
    for _ in range(size - 1):
        d = ((x - x[start[-1]]) ** 2).sum(axis=1)
        far = d if far is None else np.minimum(far, d)
        total = far.sum()
        if total <= 0:
            break
        start.append(int(min(np.searchsorted(np.cumsum(far), rng.random() * total), len(x) - 1)))
    c = x[start].copy()
    for _ in range(rounds):
        near = distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all centroids."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :], 0)


class Index:
    """Two codebooks, and the number of entries of each cell."""

    def __init__(self, fit: np.ndarray, centroids: int):
        self.cut = (fit.shape[1] + 1) // 2
        u = unit(fit)
        # vectors of one number have an empty second half: one centroid
        self.books = [codebook(u[:, :self.cut], centroids), codebook(u[:, self.cut:], centroids) if fit.shape[1] > 1 else np.zeros((1, 0))]
        self.counts = np.zeros((len(self.books[0]), len(self.books[1])), np.int64)

    def halves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(u[:, :self.cut], self.books[0]), distances(u[:, self.cut:], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(unit(x))
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def visits(self, a: np.ndarray, b: np.ndarray, until: int):
        """Cells by the sum of the distances ``a`` and ``b`` to the centroids of the two halves, until ``until`` entries are met: yields
        (cell, entries met so far, this cell's included). A pair enters the heap when both its predecessors have left it."""
        first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db = a[first].tolist(), b[second].tolist()
        first, second, wide = first.tolist(), second.tolist(), len(self.books[1])
        counts, met = self.counts.reshape(-1), 0
        done = [0] * len(da)  # of each place in the first list, how many places of the second have left the heap
        heap = [(da[0] + db[0], 0, 0)]
        while heap and met < until:
            _, i, j = heapq.heappop(heap)
            cell = first[i] * wide + second[j]
            n = int(counts[cell])
            done[i] = j + 1
            if i + 1 < len(da) and done[i + 1] == j:
                heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
            if j + 1 < len(db) and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if n:
                met += n
                yield cell, met


def _best(q: np.ndarray, x: np.ndarray, keep: int) -> list[np.ndarray]:
    """Of each row of ``q`` the rows of ``x`` that can be among its ``keep`` best, all ties and near ties included."""
    s = unit(q) @ unit(x).T
    if s.shape[1] <= keep:
        return [np.arange(s.shape[1])] * len(s)
    least = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
    return [np.flatnonzero(row >= low - SLACK) for row, low in zip(s, least)]


_FOUND = "rep long, vec_id long, score double"


class Found:
    """Rows (rep, vec_id, score): the best ``keep`` of each query vector among what a task has seen of it."""

    def __init__(self, keep: int):
        self.keep, self.rows = keep, {}

    def add(self, rep: int, q: np.ndarray, x: np.ndarray, ids: list) -> None:
        s = scores(np.broadcast_to(q, x.shape), x).tolist()
        new = [(-t, i) for t, own in zip(s, ids) for i in own]
        self.rows[rep] = heapq.nsmallest(self.keep, self.rows.get(rep, []) + new)

    def table(self) -> pa.Table:
        flat = [(rep, i, -t) for rep, rows in self.rows.items() for t, i in rows]
        return pa.table({"rep": pa.array([r[0] for r in flat], pa.int64()), "vec_id": pa.array([r[1] for r in flat], pa.int64()),
                         "score": pa.array([r[2] for r in flat], pa.float64())})


def _top(found: DataFrame, keep: int) -> DataFrame:
    w = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)


def _true_neighbours(entries: DataFrame, reps: list[int], q: np.ndarray, keep: int) -> dict[int, list[int]]:
    """The ``keep`` best rows of ``entries`` for each of a bounded number of query vectors, by brute force; by cell."""
    shared = entries.sparkSession.sparkContext.broadcast((reps, q))

    def run(batches):
        reps, q = shared.value
        found = Found(keep)
        for batch in batches:
            x, cells = _matrix(batch.column("v")), batch.column("cell").to_pylist()
            if len(x):
                for rep, row, at in zip(reps, q, _best(q, x, keep)):
                    found.add(rep, row, x[at], [[cells[k]] for k in at])
        yield from found.table().to_batches()

    out: dict[int, list[int]] = {}
    for r in _top(entries.select("v", "cell").mapInArrow(run, _FOUND), keep).orderBy("rep", "r").collect():  # len(reps) * keep rows
        out.setdefault(r["rep"], []).append(r["vec_id"])
    return out


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``vectors`` (vec_id, embedding; other columns are
    ignored) whose vec_id is divisible by ``every``, among all rows of another vec_id, by cosine; ties go to the smaller vec_id.

    Null vec_ids, and vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do vectors of another
    length than most have (ties: the shorter). Repeated rows count once. A vec_id with several vectors is one candidate with
    the best of their scores and one query with the best of their results. An empty table gives an empty result.

    Equal vectors are folded to one entry with as many of their smallest vec_ids as any result can need, so a third of all rows
    with one vector cost one comparison for a query. Entries are dealt to shares by cell, a large cell to several; each share meets the queries that visit one of its
    cells, in blocks. Codebooks, cell counts and the measured visits are all that reaches the driver; their sizes are bounded above.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = cut(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_usable, "vec_id long, digest binary, size int, v binary"))
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return empty
    rows = rows.where(F.col("size") == sizes["size"])
    ids = rows.select("vec_id", "digest").distinct()
    several = ids.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    keep = (k + 1) * int(several)
    w = Window.partitionBy("digest").orderBy("vec_id")
    least = ids.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).groupBy("digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries, n = cut_counting(rows.groupBy("digest").agg(F.first("v").alias("v")).join(least, "digest").select(F.xxhash64("digest").alias("rep"), "digest", "ids", "v"))
    asked = cut(ids.where(F.col("vec_id") % every == 0).join(entries.select("digest", "rep"), "digest").select("digest", "rep", "vec_id"))
    fit = entries.orderBy(F.xxhash64("digest"), "digest").limit(FIT_ROWS).select("v").toArrow()
    centroids = 1 << max(2, min(round(math.log2(math.sqrt(n) / 4)), MOST_CENTROIDS.bit_length() - 1))
    index = Index(_matrix(fit["v"]), centroids)
    shared = spark.sparkContext.broadcast(index)

    def coded(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            yield batch.append_column("cell", pa.array(shared.value.cells(x) if len(x) else [], pa.int32()))

    entries = cut(entries.mapInArrow(coded, "rep long, digest binary, ids array<long>, v binary, cell int"))
    for r in entries.groupBy("cell").count().collect():  # a row a cell
        index.counts.reshape(-1)[r["cell"]] = r["count"]

    queries = entries.join(asked.select("digest").distinct(), "digest", "left_semi").select("rep", "digest", "v")
    sample = queries.orderBy(F.xxhash64("digest", F.lit(1)), "digest").limit(MEASURED).toArrow()
    if not sample.num_rows:
        return empty
    reps, q = sample["rep"].to_pylist(), _matrix(sample["v"])
    true, needed = _true_neighbours(entries, reps, q, k + 1), []
    for rep, a, b in zip(reps, *index.halves(unit(q))):
        met = dict(index.visits(a, b, n))
        needed += [met[c] for c in true[rep][1:]]  # the first is the vector itself
    needed.sort()
    visits = needed[min(math.ceil(target * len(needed)), len(needed)) - 1] if needed else n

    # shares: cells in order of their numbers, cut after every ``size`` entries; a larger cell begins a share and has several
    size = min(max(-(-n // SHARES), SHARE_LEAST), SHARE_MOST)
    counts = index.counts.reshape(-1)
    share, parts, at, filled = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), 0, 0
    for c, m in enumerate(counts.tolist()):
        if filled and filled + m > size:
            at, filled = at + 1, 0
        share[c], parts[c] = at, max(1, -(-m // size))
        if parts[c] > 1:
            at, filled = at + int(parts[c]), 0
        else:
            filled += m
    plan = spark.sparkContext.broadcast((index, share, parts, int(visits)))

    def visiting(batches):
        """(share, rep, v, cells): a row for each share that holds a cell the query vector visits."""
        index, share, parts, visits = plan.value
        schema = pa.schema([("share", pa.int32()), ("rep", pa.int64()), ("v", pa.binary()), ("cells", pa.binary())])
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            for rep, raw, a, b in zip(batch.column("rep").to_pylist(), batch.column("v").to_pylist(), *index.halves(unit(x))):
                cells = np.array([c for c, _ in index.visits(a, b, visits)], np.int32)
                cells.sort()
                place = np.repeat(share[cells], parts[cells])
                spread = np.arange(len(place)) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                place, cells = place + spread, np.repeat(cells, parts[cells])
                begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                lists = [c.tobytes() for c in np.split(cells, begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(place[begin].astype(np.int32)), pa.array([rep] * len(begin), pa.int64()),
                                                  pa.array([raw] * len(begin), pa.binary()), pa.array(lists, pa.binary())], schema=schema)

    n_queries = queries.count()
    blocks = -(-n_queries // QUERY_BLOCK)
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block")
    asks = queries.select("rep", "v").mapInArrow(visiting, "share int, rep long, v binary, cells binary").select("share", block, "rep", "v", "cells")
    where = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(counts)), pa.int32()), "first": pa.array(share), "parts": pa.array(parts)}))
    dealt = (entries.select("ids", "v", "cell", "digest").join(F.broadcast(where), "cell")
             .select((F.col("first") + F.pmod(F.xxhash64("digest"), "parts").cast("int")).alias("share"),
                     F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "ids", "v", "cell"))

    def compare(_, asks: pa.Table, entries: pa.Table) -> pa.Table:
        found = Found(keep)
        if asks.num_rows and entries.num_rows:
            entries = entries.sort_by("cell")
            x, cell, own = _matrix(entries["v"]), entries["cell"].to_numpy(), entries["ids"].to_pylist()
            q, reps = _matrix(asks["v"]), asks["rep"].to_pylist()
            lists = [np.frombuffer(c, np.int32) for c in asks["cells"].to_pylist()]
            who, wanted = np.repeat(np.arange(len(lists)), [len(c) for c in lists]), np.concatenate(lists)
            order = np.argsort(wanted, kind="stable")
            who, wanted = who[order], wanted[order]
            near: list[list[np.ndarray]] = [[] for _ in lists]
            for c in np.unique(cell).tolist():
                asking = who[np.searchsorted(wanted, c):np.searchsorted(wanted, c, "right")]
                lo, hi = np.searchsorted(cell, c), np.searchsorted(cell, c, "right")
                for k0 in range(0, len(asking), 256):
                    part = asking[k0:k0 + 256]
                    for k1 in range(lo, hi, 8192):
                        for i, at in zip(part.tolist(), _best(q[part], x[k1:min(k1 + 8192, hi)], keep)):
                            near[i].append(at + k1)
            for i, at in enumerate(near):
                if at:
                    at = np.concatenate(at)
                    at = at[_best(q[i:i + 1], x[at], keep)[0]]
                    found.add(reps[i], q[i], x[at], [own[k] for k in at])
        return found.table()

    found = asks.groupBy("share", "block").cogroup(dealt.groupBy("share", "block")).applyInArrow(compare, _FOUND)
    top = cut(_top(found, keep).select("rep", "vec_id", "score"))
    pairs = (asked.select("rep", F.col("vec_id").alias("query_id")).join(top, "rep").where("query_id <> vec_id")
             .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op11_multi_index")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector of ``embeddings``."""
    return nearest(table(spark, sf_dir, "embeddings"))
