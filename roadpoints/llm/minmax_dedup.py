"""Near-duplicate documents by min-max hashing over five-word shingles.

Each permutation of the shingle hashes gives two signature values, the minimum and the maximum, so half as many hash
evaluations give the same number of values. Bands of the signature propose links; full shingle sets confirm them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from roadpoints.llm.registry import query, table
from roadpoints.llm.textnum import LOWER, Words, slices, texts
from roadpoints.session import cut, cut_counting

#: words of a shingle; per cent of the union that the intersection must reach
SHINGLE, PERCENT = 5, 75
#: bands and values of a band: a link of similarity s is proposed with probability 1 - (1 - s**ROWS)**BANDS, at the threshold
#: 0.75 all but 2e-5, at 0.8 all but 4e-8. Every band has as many minima as maxima, of different permutations.
BANDS, ROWS = 56, 6
#: pairs in different components for each member up to which a bucket's pairs are listed; ratio of the sizes of a size band
SPREAD, BAND = 1, 1.05
_RNG = np.random.default_rng(20240521)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS // 2, dtype=np.uint64)


def shingles(w: Words, d: int, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of text ``d``; a shorter text is one shingle, an empty one none."""
    a, b = int(w.first[d]), int(w.first[d + 1])
    if b == a:
        return np.zeros(0, np.uint64)
    begin = np.arange(a, max(b - size, a) + 1)
    return np.unique(w.gram(begin, np.minimum(begin + size, b)))


def signature(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band hashes (texts x BANDS) of the sets that begin at ``starts`` in ``hashes``; no set is empty."""
    half = ROWS // 2
    out = np.zeros((len(starts), BANDS), np.uint64)
    mul = np.uint64(0x9FB21C651E98DF25)
    with np.errstate(over="ignore"):
        for p in range(BANDS * half):
            x = hashes * _A[p] + _B[p]
            x ^= x >> np.uint64(29)
            low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
            i, j = p // half, (p // half + 1 + p % half) % BANDS
            # bands i and j get values of the same permutation, but never both of them
            out[:, i] = (out[:, i] + low) * mul
            out[:, j] ^= (high * mul) * np.uint64(2 * (p % half) + 3)
    return out


def _signed(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
    for batch in batches:
        data, offsets = texts(batch.column(1))
        for i, j in slices(offsets):
            w = Words(data, offsets, i, j, LOWER)
            sets = [shingles(w, d) for d in range(j - i)]
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            bands = np.zeros((0, BANDS), np.uint64)
            if len(full):
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                bands = signature(np.concatenate([sets[k] for k in full]), starts)
            lists = np.zeros(j - i + 1, np.int32)
            lists[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
            digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(lists), pa.array(bands.reshape(-1).view(np.int64)))], schema=schema)


def _sets(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for batch in batches:
        data, offsets = texts(batch.column(1))
        for i, j in slices(offsets):
            w = Words(data, offsets, i, j, LOWER)
            sets = [shingles(w, d) for d in range(j - i)]
            lists = np.zeros(j - i + 1, np.int32)
            lists[1:] = np.cumsum([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(lists), pa.array(np.concatenate(sets).view(np.int64)))], schema=schema)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the similarity. The join on v comes last: few pairs share a v, while one leader u
    may have many, so that the sets are compared evenly over the tasks."""
    both = (pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u")
            .join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v"))
    shared = both.select("u", "v", F.size(F.array_intersect("a", "b")).alias("n"), (F.size("a") + F.size("b")).alias("total"))
    return shared.where(100 * F.col("n") >= PERCENT * (F.col("total") - F.col("n"))).select("u", "v")


def groups(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (u, v): the smallest node that can be reached.

    In each round a node takes the smallest label among its own, its neighbours' and what other nodes of its label have seen, and
    then that label's label; rounds end when nothing changes, after about the logarithm of the longest chain.
    """
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    label = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("c")))
    moved = 1
    while moved:
        near = both.join(label.select(F.col("node").alias("v"), "c"), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("m"))
        seen = label.join(near, "node").select("node", "c", F.least("c", "m").alias("m"))
        hook = seen.groupBy("c").agg(F.min("m").alias("h"))
        to = seen.join(hook, "c").select("node", F.col("c").alias("old"), F.least("m", "h").alias("x"))
        jump = to.join(to.select(F.col("node").alias("x"), F.col("x").alias("y")), "x")
        label, moved = cut_counting(jump.select("node", F.least("x", "y").alias("c"), "old"), F.sum((F.col("c") != F.col("old")).cast("int")))
        label = label.select("node", "c")
    return label.select("node", F.col("c").alias("component"))


def regrouped(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after ``links`` (u, v) have joined more nodes: only the components that they join are gone through anew."""
    if label is None:
        return groups(links)
    at = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    joined, n = cut_counting(ends.where("u <> v").distinct())
    if not n:
        return label
    top = groups(joined)
    old = label.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    # nodes without a label are components of their own
    return cut(old.unionByName(top.join(label.select("node"), "node", "left_anti")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs`` (doc_id, text; other columns are ignored).

    Documents are linked if 100 * intersection >= 75 * union of their sets of distinct five-word shingles; a component is
    named by its smallest doc_id, which is the one kept. A null, empty or blank text has no shingles and no links. Rows with
    equal doc_id and text give one row each, with the same values. An empty table gives an empty result.

    Equal sets are folded to their smallest doc_id before anything else. In a bucket (a band and its hash) members are not all compared
    with each other: first each with its smallest leader, then, in buckets with many pairs in different components, with the node that
    shares most buckets with others, in turns, as long as a turn halves those pairs. Of buckets with few such pairs they are then listed and
    compared; members of the others are joined on their rarest shingles. No proposed link is lost, and a group of near
    copies costs about as many comparisons as it has members.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    signed = cut(docs.mapInArrow(_signed, "doc_id long, n_shingles long, digest binary, bands array<long>"))
    classes = cut(signed.where("digest is not null").groupBy("digest")
                  .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    entries = classes.select("node", "n", F.posexplode("bands").alias("band", "h"))
    bucket = ["band", "h"]
    live = entries.groupBy(*bucket).agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("f")).where("size > 1")
    members, n_members = cut_counting(entries.join(live.select(*bucket, F.col("f.node").alias("leader"), F.col("f.n").alias("m")), bucket))
    label = classes.select("digest", "node")
    if n_members:
        wanted = cut(members.select(F.col("node").alias("doc_id")).distinct())
        sets = cut(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]))
        found = _components(members, sets)
        label = label.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    else:
        label = label.select("digest", F.col("node").alias("component_id"))
    label = cut(label)  # a table, so that the join below can split the digest of a large group of copies
    out = signed.where("digest is not null").select("doc_id", "n_shingles", "digest").join(label, "digest").drop("digest")
    out = out.unionByName(signed.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _named(members: DataFrame, label: DataFrame | None) -> DataFrame:
    named = members.select("node", "n", "band", "h")
    if label is None:
        return named.withColumn("component", F.col("node"))
    return cut(named.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))


def _prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n, leader, m): all pairs of ``nodes`` (node, n, component) in different components that can reach the similarity.

    With sizes n and m they must share c = ceil(3/7 (n + m)) shingles, so their n - c + 1 and m - c + 1 rarest ones (in one order for
    all) have one in common. Sizes are taken in bands, which fixes c for each pair of bands from below. What copies of a text have in
    common is frequent among them, so copies that differ too much from each other do not meet.
    """
    each = nodes.join(sets.withColumnRenamed("doc_id", "node"), "node").select("node", "n", "component", F.explode("shingles").alias("t"))
    rare = each.groupBy("t").agg(F.count("*").alias("df"))
    w = Window.partitionBy("node").orderBy("df", "t")
    front = each.join(rare, "t").withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * 0.75) + 1).where("df > 1")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND))
    least = F.ceil(F.pow(F.lit(BAND), F.col("other")) - 1e-9)  # smallest size of the other band
    reach = math.ceil(math.log(4 / 3) / math.log(BAND)) + 1
    front = front.withColumn("own", band)
    # only shingles that two components have in front, and only the size bands that have the shingle
    held = front.groupBy("t").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1")
    front = front.join(held.select("t", "lo", "hi"), "t")
    front = front.withColumn("other", F.explode(F.sequence(F.greatest(F.col("own") - reach, "lo"), F.least(F.col("own") + reach, "hi"))))
    front = front.where(F.col("r") <= F.col("n") - F.ceil((F.col("n") + least) * 3 / 7 - 1e-9) + 1).select("t", "own", "other", "node", "n", "component")
    mate = front.select("t", F.col("other").alias("own"), F.col("own").alias("other"), F.col("node").alias("leader"), F.col("n").alias("m"), F.col("component").alias("apart"))
    return front.join(mate, ["t", "own", "other"]).where("node < leader and component <> apart").select("node", "n", "leader", "m").distinct()


def _components(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of the linked nodes among ``members`` (band, h, node, n, leader, m)."""
    bucket = ["band", "h"]
    fits = 4 * F.least("n", "m") >= 3 * F.greatest("n", "m")  # the sizes alone rule out all other pairs

    def pairs_of(df: DataFrame) -> DataFrame:
        return df.where(fits).select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")).distinct()

    tried = cut(members.where("node <> leader").where(fits).groupBy(F.col("node").alias("v")).agg(F.min("leader").alias("u")).select("u", "v"))
    links, n_links = cut_counting(confirmed(tried, sets))
    label = groups(links) if n_links else None
    before = used = None
    while True:
        named = _named(members, label)
        parts = named.groupBy(*bucket, "component").agg(F.count("*").alias("k"))
        parts = parts.groupBy(*bucket).agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"))
        parts = parts.where("all * all > same").withColumn("heavy", F.col("all") * F.col("all") - F.col("same") > 2 * SPREAD * F.col("all"))
        parts, open_ = cut_counting(parts, F.sum(F.when(F.col("heavy"), F.col("all") * F.col("all") - F.col("same"))))
        if not open_ or (before is not None and 2 * open_ > before):
            break
        # members against the node of their bucket that shares most buckets of most members; another one in each turn
        before = open_
        crowd = cut(named.join(parts.where("heavy").select(*bucket, "all"), bucket))
        weight = crowd.groupBy("node").agg(F.sum("all").alias("weight"))
        free = crowd.join(weight, "node") if used is None else crowd.join(weight, "node").join(used, "node", "left_anti")
        lead = cut(free.groupBy(*bucket).agg(F.max(F.struct("weight", "node", "n", "component")).alias("f"))
                   .select(*bucket, F.col("f.node").alias("leader"), F.col("f.n").alias("m"), F.col("f.component").alias("other")))
        heads = lead.select(F.col("leader").alias("node")).distinct()
        used = cut(heads if used is None else used.unionByName(heads))
        apart = crowd.join(lead, bucket).where("component <> other").select("node", "n", "leader", "m").distinct()
        new = cut(pairs_of(apart).join(tried, ["u", "v"], "left_anti"))
        more, n_more = cut_counting(confirmed(new, sets))
        tried = cut(tried.unionByName(new))
        if n_more:
            label = regrouped(label, more)
    # buckets with few open pairs for each member: these pairs; the others: pairs with a rare shingle in common
    few = named.join(parts.where("not heavy").select(*bucket), bucket)
    other = few.select(*bucket, F.col("node").alias("leader"), F.col("n").alias("m"), F.col("component").alias("other"))
    rest = pairs_of(few.join(other, bucket).where("component <> other and node < leader"))
    if open_:
        crowd = named.join(parts.where("heavy").select(*bucket), bucket).select("node", "n", "component").distinct()
        rest = rest.unionByName(pairs_of(_prefix_pairs(crowd, sets))).distinct()
    more, n_more = cut_counting(confirmed(cut(rest.join(tried, ["u", "v"], "left_anti")), sets))
    if n_more:
        label = regrouped(label, more)
    return label if label is not None else members.select("node", F.col("node").alias("component")).distinct()


@query("op4_minmax_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table with the smallest doc_id of its near-duplicate component."""
    return near_duplicates(table(spark, sf_dir, "documents"))
