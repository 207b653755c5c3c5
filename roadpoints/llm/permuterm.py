"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found among sorted permuterm rotations.

A word of letters w with its end mark has the rotations ``w[i:] $ w[:i]``. Written without its last letter, the rotation that ends with
letter i is the prefix that all words share which have any letter, or one letter more, at that place. So of each word go to the sort: its whole
rotations, and those that skip their last letter. Rows with one key stand together after the sort and are scanned once:

* skipping rows of different words: a replacement at that place;
* a whole rotation and skipping rows: the skipping words have one letter more. In a run of equal letters any may be
  the one too many; only its first is counted.

Every near pair meets at exactly one key, and at a key the words differ in one letter, so that a group has no more rows than
there are letters. Each row takes the count and the best of the others from its group; pairs are never listed.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from roadpoints.llm.registry import query, table
from roadpoints.llm.textnum import Powers, mix, slices, texts
from roadpoints.session import cut, cut_counting

#: words have so many letters and occurrences at least; a form has so many times the occurrences of its word
MIN_LETTERS, MIN_COUNT, TIMES = 7, 2, 10
#: of the copies of a run one in so many has a letter deleted, as the query's contract wants it
EVERY = 31
#: bytes from which on a rotation is sorted by its digest, and entries of a task's counts before they are handed on
LONG, MOST = 256, 200_000
_POWERS = Powers(np.uint64(0xA24BAED4963EE407))
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
_CRC ^= _CRC[0]  # the table of the linear part
_ONES = np.uint32(0xFFFFFFFF)


class Runs:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of texts ``i..j``, A-Z lower-cased: bytes, spans, numbers of letters, text of each run."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, least: int):
        at = offsets[i:j + 1] - offsets[i]
        raw = data[offsets[i]:offsets[j]]
        on = _LETTER[raw]
        lead = np.flatnonzero(raw == 0xC3)  # its second byte makes a letter of U+00C0 to U+00FF
        on[lead + 1] = True
        before, after = np.zeros_like(on), np.zeros_like(on)
        before[1:], after[:-1] = on[:-1], on[1:]
        inner = at[(at > 0) & (at < len(on))]
        before[inner], after[inner - 1] = False, False
        start, end = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
        more = np.concatenate([[0], np.cumsum((raw & 0xC0) == 0x80)])
        letters = end - start - (more[end] - more[start])
        long = letters >= least
        self.data, self.start, self.end, self.letters = _LOWER[raw], start[long], end[long], letters[long]
        self.text = np.searchsorted(at, self.start, "right") - 1

    def hashes(self) -> np.ndarray:
        up, down = _POWERS.get(len(self.data) + 1)
        c = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:len(self.data)], out=c[1:])
        return mix((c[self.end] - c[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def crc(self, prefixes: list[bytes]) -> np.ndarray:
        """crc32 of each run after the prefix of its text: one table step a byte for all runs at once; very long runs one by one."""
        begun = np.array([zlib.crc32(p) for p in prefixes], np.uint32)
        state = begun[self.text] ^ _ONES if len(self.text) else np.zeros(0, np.uint32)
        size = self.end - self.start
        order = np.argsort(size, kind="stable")
        left, s, at = order, state[order], self.start[order]
        for p in range(int(min(size.max(initial=0), LONG))):
            skip = int(np.searchsorted(size[left], p, "right"))
            state[left[:skip]] = s[:skip]
            left, s, at = left[skip:], s[skip:], at[skip:]
            s = _CRC[(s ^ self.data[at + p]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
        state[left] = s
        for k in np.flatnonzero(size > LONG).tolist():
            state[k] = zlib.crc32(self.data[self.start[k]:self.end[k]].tobytes(), int(begun[self.text[k]])) ^ 0xFFFFFFFF
        return state ^ _ONES

    def word(self, k: int) -> str:
        return self.data[self.start[k]:self.end[k]].tobytes().decode("utf-8")


def _counted(least: int, every: int):
    def run(batches):
        total: Counter[str] = Counter()

        def rows():
            return pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for batch in batches:
            data, offsets = texts(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in slices(offsets):
                r = Runs(data, offsets, i, j, least)
                if not len(r.start):
                    continue
                h = r.crc([b":" if d is None else b"%d:" % d for d in ids[i:j]])
                hit = h % np.uint32(every) == 0
                plain = np.flatnonzero(~hit)
                _, first, n = np.unique(r.hashes()[plain], return_index=True, return_counts=True)
                for k, c in zip(plain[first].tolist(), n.tolist()):
                    total[r.word(k)] += c
                for k in np.flatnonzero(hit & (r.letters > least)).tolist():
                    w = r.word(k)
                    gone = int(h[k]) % len(w)
                    total[w[:gone] + w[gone + 1:]] += 1
                if len(total) > MOST:
                    yield rows()
                    total.clear()
        yield rows()
    return run


def words(docs: DataFrame, least: int = MIN_LETTERS, count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): words of at least ``least`` letters with at least ``count`` occurrences in ``docs`` (doc_id, text).

    A run whose crc32 with its doc_id is divisible by ``every`` loses a letter first. Counts are summed per task before the shuffle. A null text has
    no words; a null doc_id counts as an empty one.
    """
    each = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted(least, every), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def _key(rotation: Column) -> Column:
    return F.when(F.octet_length(rotation) > LONG, F.concat(F.lit("#"), F.sha2(rotation, 256))).otherwise(rotation)


def rotations(words: DataFrame) -> DataFrame:
    """(key, skips, first, word, n): the rotations of each word, whole and without their last letter. ``first``: the skipped letter is not
    equal to the one before it."""
    size = F.length("word")

    def whole(i: Column) -> Column:
        key = F.concat(F.substring("word", i + 1, size), F.lit("$"), F.substring("word", F.lit(1), i))
        return F.struct(_key(key).alias("key"), F.lit(False).alias("skips"), F.lit(False).alias("first"))

    def skipping(i: Column) -> Column:
        key = F.concat(F.substring("word", i + 2, size), F.lit("$"), F.substring("word", F.lit(1), i))
        first = (i == 0) | (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1)))
        return F.struct(_key(key).alias("key"), F.lit(True).alias("skips"), first.alias("first"))

    both = F.concat(F.transform(F.sequence(F.lit(0), size), whole), F.transform(F.sequence(F.lit(0), size - 1), skipping))
    return words.select("word", "n", F.explode(both).alias("r")).select("r.*", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): number of near words and struct(-n, word) of the most frequent one, for words that have any."""
    group = Window.partitionBy("key")  # one sort of all rotations serves all windows
    me = F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"))
    skips, first = F.col("skips"), F.col("first")
    r = rotations(words).withColumn("rows", F.count("*").over(group)).where("rows > 1")
    r = r.withColumns({"me": me, "cuts": F.count(F.when(skips, 1)).over(group), "firsts": F.count(F.when(first, 1)).over(group),
                       "whole": F.min(F.when(~skips, me)).over(group), "one": F.min(F.when(skips, me)).over(group), "lead": F.min(F.when(first, me)).over(group)})
    r = r.withColumn("two", F.min(F.when(skips & (F.col("me") != F.col("one")), F.col("me"))).over(group))
    other = F.when(F.col("me") == F.col("one"), F.col("two")).otherwise(F.col("one"))
    whole = F.when(first, F.col("whole"))
    r = r.select("word", F.when(skips, F.col("cuts") - 1 + whole.isNotNull().cast("int")).otherwise(F.col("firsts")).alias("k"),
                 F.when(skips, F.least(other, whole)).otherwise(F.col("lead")).alias("best"))
    return r.where("k > 0").groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last word of each chain of forms. Steps double each round; a form has TIMES the
    occurrences of its word, so that chains are short and have no loops."""
    at, open_ = cut_counting(forms.select("word", F.col("form").alias("root")))
    while open_:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at, open_ = cut_counting(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")),
                                 F.sum(F.col("on").cast("int")))
        at = at.select("word", "root")
    return at


def spelling_variants(docs: DataFrame, least: int = MIN_LETTERS, count: int = MIN_COUNT, times: int = TIMES, every: int = EVERY) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of the words of ``docs`` (doc_id, text; other columns are ignored), see ``words``.

    ``form`` is the near word with most occurrences (ties: the smallest in code-point order) if it has at least ``times`` those of the word,
    else null; ``root`` is the end of the chain of forms. Rows count as often as they stand in the table. Empty tables, null and empty texts give no words.
    Rotations of more than LONG bytes are sorted by their SHA-256.
    """
    known = cut(words(docs, least, count, every))
    near = near_words(known)
    out = known.join(near, "word", "left").withColumn("fits", -F.col("best.m") >= times * F.col("n"))
    out = cut(out.select("word", "n", F.when(F.col("fits"), F.col("best.w")).alias("form"), F.when(F.col("fits"), -F.col("best.m")).alias("form_n"),
                         F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")))
    ends = roots(out.where("form is not null").select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op12_permuterm")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of ``documents`` with its near words, form and root."""
    return spelling_variants(table(spark, sf_dir, "documents"))
