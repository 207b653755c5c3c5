"""Benchmark decontamination by winnowing.

Of every GAP consecutive k-grams of words the one with the smallest hash is a fingerprint, so two texts that share
K + GAP - 1 = 13 words in a row share a fingerprint at the same place. Training fingerprints are joined with test
fingerprints and the hits are extended word by word both ways.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpoints.llm.registry import query, table
from roadpoints.llm.textnum import ALNUM, Words, slices, texts
from roadpoints.session import cut

WINDOW, K = 13, 8
GAP = WINDOW - K + 1
#: words of context kept on either side of a fingerprint: enough for every window that contains it
REACH = WINDOW - K
#: bits of the filter of test fingerprints; its size does not depend on the data (a full one only passes more to the join)
FILTER_BITS = 1 << 23
#: shares into which the rows of one fingerprint are dealt, so that a passage common to many documents is not one task's work
SHARES = 32


def minima(grams: np.ndarray, first: np.ndarray, gap: int) -> np.ndarray:
    """Positions in ``grams`` of the (leftmost) minimum of each run of ``gap`` within a text; fewer than ``gap`` give one minimum.
    ``first`` has the position of each text's first gram."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.int64)
    # the minimum of positions p..p+gap-1 as an argmin that moves right only for a strictly smaller hash
    best = np.arange(n)
    owner = np.searchsorted(first, np.arange(n), "right") - 1
    stop = np.append(first, n)[owner + 1]
    for step in range(1, gap):
        at = np.minimum(np.arange(n) + step, stop - 1)
        best = np.where(grams[at] < grams[best], at, best)
    whole = (np.arange(n) + gap <= stop) | (np.arange(n) == first[owner])
    return np.unique(best[whole])


def _grams(w: Words, size: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash) of the fingerprints of ``size`` words."""
    counts = np.maximum(np.diff(w.first) - size + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    begin = w.first[:-1][doc] + np.arange(len(doc)) - first[doc]
    h = w.gram(begin, begin + size)
    if gap > 1:
        has = counts > 0
        pick = minima(h, first[has], gap)
        doc, begin, h = doc[pick], begin[pick], h[pick]
    return doc, begin, h


_ROW = pa.list_(pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("left", pa.string()), ("mid", pa.string()), ("right", pa.string())]))
_FP = "array<struct<fp:long,size:int,pos:int,left:string,mid:string,right:string>>"


def _fingerprints(keep, sizes):
    """Rows of texts: their other columns, n_words, fps; ``keep`` is the filter (None: all), ``sizes`` the lengths of short test items, None for the
    test side itself, where an item of fewer than WINDOW words is one fingerprint."""

    def passed(h: np.ndarray) -> np.ndarray:
        bits = keep.value
        at = h & np.uint64(FILTER_BITS - 1)
        return np.flatnonzero((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets):
                w = Words(data, offsets, i, j, ALNUM)
                count = np.diff(w.first)
                found = [[] for _ in range(j - i)]
                wanted = [(K, GAP)] + [(s, 1) for s in (range(1, WINDOW) if sizes is None else sizes)]
                for size, gap in wanted:
                    doc, begin, h = _grams(w, size, gap)
                    if keep is None:
                        pick = np.flatnonzero(count[doc] >= WINDOW) if gap > 1 else np.flatnonzero(count[doc] == size)
                    else:
                        pick = passed(h)
                    for p in pick.tolist():
                        d, b = int(doc[p]), int(begin[p])
                        reach = REACH if gap > 1 else 0
                        lo, hi = max(int(w.first[d]), b - reach), min(int(w.first[d + 1]), b + size + reach)
                        found[d].append({"fp": int(h[p].view(np.int64)), "size": size if gap == 1 else 0, "pos": b - int(w.first[d]),
                                         "left": w.text(lo, b), "mid": w.text(b, b + size), "right": w.text(b + size, hi)})
                own = [c.slice(i, j - i) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(count, pa.int64()), pa.array(found, _ROW)], names=[*batch.schema.names[:-1], "n_words", "fps"])
    return run


def _filter(spark: SparkSession, tests: DataFrame):
    """The filter as a broadcast bit array of FILTER_BITS / 8 bytes, and the lengths (1 to 12 at most) of short items."""
    word = F.shiftright(F.expr(f"fp & {FILTER_BITS - 1}L"), 5)
    bit = F.expr("shiftleft(1L, cast(fp & 31L as int))")
    rows = tests.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).collect()  # at most FILTER_BITS / 32 rows
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in rows:
        bits[r["w"]] = r["b"]
    sizes = sorted(r["size"] for r in tests.where("size > 0").select("size").distinct().collect())  # at most 12 rows
    return spark.sparkContext.broadcast(bits.view(np.uint8)), sizes


def _same(a: str, b: str, reverse: bool):
    """How many leading (or with reverse, trailing) words of the texts ``a`` and ``b`` are equal."""
    x, y = (F.split(F.reverse(c) if reverse else F.col(c), " ") for c in (a, b))
    pairs = F.zip_with(x, y, lambda p, q: (p == q) & (p != ""))
    stop = F.array_position(F.transform(pairs, lambda v: F.coalesce(v, F.lit(False))), False)
    return F.when(stop == 0, F.size(pairs)).otherwise(stop - 1).cast("int")


def contamination(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of ``docs`` (doc_id, text) against ``tests`` (item_id, text).

    Words are runs of letters a-z (A-Z lower-cased), digits and bytes above 0x7F. A window is 13 words in a row of an item, or the
    whole item if it has 1 to 12. A word of a document is hit if it lies in an occurrence of a window; the document is contaminated
    if at least a twentieth of its words are hit. Null, empty and word-less texts have no windows and no hits. Every row
    is judged and returned by itself, also rows without a doc_id and repeated ones; of equal item texts every item_id is listed, items without an item_id are left out. Empty tables give no rows or no hits; other columns are ignored.

    One pass over the documents: only fingerprints that pass the fixed-size filter leave it, with five words of context on either
    side, and the join with the test fingerprints compares the words themselves.
    """
    spark = docs.sparkSession
    item = (tests.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
            .mapInArrow(_fingerprints(None, None), f"item_id long, n_words long, fps {_FP}")
            .select("item_id", F.inline("fps")).distinct())
    item = cut(item)
    keep, sizes = _filter(spark, item)
    # the numbers of the rows hold from here on, as they are written
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
               .mapInArrow(_fingerprints(keep, sizes), f"row long, doc_id long, n_words long, fps {_FP}"))
    rows = rows.select("row", "doc_id", "n_words", F.explode_outer("fps").alias("f"))
    # documents without a candidate go along under a key of their own, spread over all partitions
    rows = rows.select("row", "doc_id", "n_words", F.coalesce("f.fp", F.xxhash64("row")).alias("fp"), F.coalesce("f.size", F.lit(-1)).alias("size"), "f.pos",
                       F.col("f.left").alias("l1"), F.col("f.mid").alias("m1"), F.col("f.right").alias("r1"),
                       F.pmod(F.xxhash64("row"), F.lit(SHARES)).alias("share"))
    known = item.select("item_id", "fp", "size", F.col("left").alias("l2"), F.col("mid").alias("m2"), F.col("right").alias("r2"),
                        F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<long>")).alias("share"))
    joined = rows.join(known, ["fp", "size", "share"], "left")
    before, after = _same("l1", "l2", True), _same("r1", "r2", False)
    length = F.when(F.col("size") == 0, F.lit(K)).otherwise(F.col("size"))
    hit = (joined.withColumns({"before": F.when(F.col("m1") == F.col("m2"), before), "after": F.when(F.col("m1") == F.col("m2"), after)})
           .withColumn("whole", (F.col("m1") == F.col("m2")) & ((F.col("size") > 0) | (F.col("before") + F.col("after") + K >= WINDOW)))
           .withColumn("span", F.when(F.col("whole"), F.struct((F.col("pos") - F.col("before")).alias("b"), (F.col("pos") + length + F.col("after")).alias("e"))))
           .withColumn("item", F.when(F.col("whole"), F.col("item_id").cast("string"))))
    per = hit.groupBy("row", "doc_id", "n_words").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("e"))
    covered = F.aggregate("spans", zero, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["b"], s["e"]))).alias("n"),
                                                               F.greatest(s["e"], x["e"]).alias("e")), lambda s: s["n"])
    return (per.select("doc_id", "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
