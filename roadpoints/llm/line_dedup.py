"""Repeated passages, found by winnowing and removed from all but their first place.

Passages are runs of MIN_WORDS words or more, wherever they begin and end. Of each MIN_WORDS words the smallest hash of GRAM words is the
fingerprint; the words around a fingerprint for which it is the smallest are its context. Positions with equal fingerprints are joined. Equal
contexts match as a whole; where contexts of a fingerprint differ, all runs of MIN_WORDS words in them are compared, which extends a match
word by word to both sides, up to where the texts differ.

A place is a row's key and a word of it. The key is the doc_id with a 32-bit hash of the text, so that rows of one doc_id with different texts are places of
their own. Rows without a doc_id come after all others, by a 48-bit hash of their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roadpoints.llm.registry import query, table
from roadpoints.llm.textnum import PLAIN, Words, line_edges, slices, texts
from roadpoints.session import cut

#: words from which on a repeated run is removed
MIN_WORDS = 30
#: words of a fingerprint, at most
GRAM = 8
_KEY = ("doc_id", "tag")


def _key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """The key of a row: never null, and the same wherever it is computed."""
    late = F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(text), F.lit(1 << 48))
    return F.coalesce(F.col(doc_id).cast("long"), late).alias("doc_id"), F.hash(text).alias("tag")


class Lines:
    """Lines with words of the texts ``i..j``: ``begin`` and ``end`` bytes, first word ``word`` (and the end), ``first`` line of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int):
        self.words = w = Words(data, offsets, i, j, PLAIN)
        edge = line_edges(w.data, w.at)
        owner = np.searchsorted(edge, w.start, "right") - 1
        fresh = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        self.word = np.append(fresh, len(w.start))
        self.begin = edge[owner[fresh]] if len(owner) else np.zeros(0, np.int64)
        self.end = edge[owner[fresh] + 1] if len(owner) else np.zeros(0, np.int64)
        self.first = np.searchsorted(fresh, w.first)


def _windows(w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of all runs of ``least`` words within a text."""
    counts = np.maximum(np.diff(w.first) - least + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return text, w.first[:-1][text] + np.arange(len(text)) - (np.cumsum(counts) - counts)[text]


def _contexts(least: int):
    """(doc_id, tag, p, n, fp, digest): the fingerprints of each text, with the ``n`` runs of ``least`` words from word ``p`` on that have it in common
    and the digest of all their words."""
    size = min(GRAM, least)

    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(2))
            key = batch.columns[:2]
            for i, j in slices(offsets):
                w = Words(data, offsets, i, j, PLAIN)
                text, at = _windows(w, least)
                if not len(at):
                    continue
                begin = np.arange(len(w.start) - size + 1)
                gram = w.gram(begin, begin + size)  # those across texts lie in no window
                low, reach = begin, 1  # the last of the smallest of gram[k..k+reach-1], for twice as long runs each time
                while reach < least - size + 1:
                    step = min(reach, least - size + 1 - reach)
                    a, b = low[:len(low) - step], low[step:]
                    low, reach = np.where(gram[b] <= gram[a], b, a), reach + step
                low = low[at]
                new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (text[1:] != text[:-1])]))
                n = np.diff(np.append(new, len(at)))
                yield pa.RecordBatch.from_arrays([*[k.take(pa.array(text[new] + i)) for k in key], pa.array((at[new] - w.first[text[new]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(gram[low[new]].view(np.int64)),
                                                  pa.array(w.gram(at[new], at[new] + n + least - 1).view(np.int64))], names=[*_KEY, "p", "n", "fp", "digest"])
    return run


def _spelled(least: int):
    """Batches of (doc_id, tag, text, spots): (doc_id, tag, p, fp, digest) of every run of ``least`` words of the spots (fp, p, n)."""
    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(2))
            key, lists = batch.columns[:2], batch.column(3)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            spots = lists.flatten()
            fp, p, n = (spots.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for i, j in slices(offsets):
                w = Words(data, offsets, i, j, PLAIN)
                text, some = np.repeat(np.arange(j - i), np.diff(ends[i:j + 1])), slice(ends[i], ends[j])
                fits = p[some] + n[some] + least - 1 <= np.diff(w.first)[text]  # else it is of a row with another text and the same key
                text, f, q, m = text[fits], fp[some][fits], p[some][fits].astype(np.int64), n[some][fits].astype(np.int64)
                k = np.repeat(np.arange(len(text)), m)
                at = q[k] + np.arange(len(k)) - (np.cumsum(m) - m)[k]
                word = w.first[text[k]] + at
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(text[k] + i)) for c in key], pa.array(at.astype(np.int32)), pa.array(f[k]), pa.array(w.gram(word, word + least).view(np.int64))], names=[*_KEY, "p", "fp", "digest"])
    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tag, b, e): runs of words of ``docs`` (doc_id, text) that are in some run of ``min_words`` words which stands earlier, in a row of
    smaller key or in the same one. In the row of the first place only what lies behind that place is a repeat.
    """
    own = docs.select(*_key(), "text")
    rows = cut(own.mapInArrow(_contexts(min_words), "doc_id long, tag int, p int, n int, fp long, digest long"))
    # tables of their own, so that both sides of the joins are plain exchanges and a hot fingerprint can be split
    shared = cut(rows.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select("fp"))
    spots = cut(rows.join(shared, "fp", "left_semi"))
    place = F.struct(*_KEY, "p")
    home = (F.col("doc_id") == F.col("f.doc_id")) & (F.col("tag") == F.col("f.tag"))

    def behind(words):
        return F.when(home, F.greatest("p", F.col("f.p") + min_words)).otherwise(F.col("p")).alias("b"), (F.col("p") + words).alias("e")

    kinds = cut(spots.groupBy("fp", "digest").agg(F.min(place).alias("f"), F.first("n").alias("n"), F.count("*").alias("k")))
    whole = spots.drop("n").join(kinds.where("k > 1"), ["fp", "digest"]).where(place > F.col("f")).select(*_KEY, *behind(F.col("n") + min_words - 1))
    # of equal contexts the first stands for all: what is repeated in the others is gone already
    mixed = cut(kinds.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select("fp"))
    asked = kinds.join(mixed, "fp", "left_semi").groupBy("f.doc_id", "f.tag").agg(F.collect_set(F.struct("fp", "f.p", "n")).alias("spots"))
    runs = cut(own.join(asked, list(_KEY)).mapInArrow(_spelled(min_words), "doc_id long, tag int, p int, fp long, digest long"))
    firsts = cut(runs.groupBy("fp", "digest").agg(F.min(place).alias("f"), F.count("*").alias("k")).where("k > 1").drop("k"))
    part = runs.join(firsts, ["fp", "digest"]).where(place > F.col("f")).select(*_KEY, *behind(F.lit(min_words)))
    return whole.unionByName(part)


def _without(names: list[str]):
    """Batches of documents with two more columns, the number of lines and the runs of words to remove (or null): text and n_removed after the
    other columns. Lines are removed of which no word is left, and what else of a line is no repeat stays. Rows without runs pass as they are."""
    def run(batches):
        at = names.index("text")
        for batch in batches:
            hit = batch.column(len(names) + 1).is_valid()
            rest = batch.filter(pc.invert(hit))
            if len(rest):
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(np.zeros(len(rest), np.int64))], names=[*names, "_lines", "_removed"])
            batch = batch.filter(hit)
            data, offsets = texts(batch.column(at))
            runs = batch.column(len(names) + 1)
            for i, j in slices(offsets):
                lines = Lines(data, offsets, i, j)
                w, raw = lines.words, lines.words.data.tobytes()
                out, left = [], np.ones(len(w.start) + 1, bool)
                for d, own in enumerate(runs.slice(i, j - i).to_pylist()):
                    lo, hi, begin, stop = int(w.first[d]), int(w.first[d + 1]), int(w.at[d]), int(w.at[d + 1])
                    parts = []
                    for b, e in _union(own):
                        b, e = lo + b, min(lo + e, hi)
                        left[b:e] = False
                        head = begin if b == lo else int(w.end[b - 1])
                        if b == lo or b"\n" in raw[head:w.start[b]]:  # from the begin of a line on the white space behind goes, else that before
                            parts.append(raw[begin:head if b == lo else w.start[b]])
                            begin = int(w.start[e]) if e < hi else stop
                        else:
                            parts.append(raw[begin:head])
                            begin = int(w.end[e - 1])
                    parts.append(raw[begin:stop])
                    out.append(b"".join(parts).decode("utf-8"))
                kept = np.add.reduceat(left[:-1].astype(np.int64), lines.word[:-1]) if len(lines.begin) else np.zeros(0, np.int64)
                less = np.diff(np.concatenate([[0], np.cumsum(kept == 0)])[lines.first])
                cols = [c.slice(i, j - i) for c in batch.columns[:-1]]
                cols[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(less, pa.int64())], names=[*names, "_lines", "_removed"])
    return run


def _union(runs) -> list[list[int]]:
    """Runs (b, e) that touch or overlap as one, in order."""
    out: list[list[int]] = []
    for b, e in sorted((r["b"], r["e"]) for r in runs):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def _line_count(text: str = "text") -> Column:
    """Lines with a word: they end at line feeds, and at a space behind a sentence end."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\n|(?<=[.!?]) ")
    return F.size(F.filter(lines, lambda x: x.rlike(r"[^ \t-\r]"))).cast("long")


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without its repeated runs of at least ``min_words`` words, wherever in a line they begin and end.

    What stays of a text is unchanged. With ``counts`` the columns n_lines (lines with words before) and n_removed (lines of which no word is
    left) are added; columns of these names are replaced. A null text stays null, an empty one empty; a document that only repeats others
    becomes empty, and no row is dropped. Of equal passages that stays which comes first by doc_id, then by a hash of the text, then in the text;
    rows without a doc_id come last. Rows equal in doc_id and text are one place: they keep and lose the same words. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")] if counts else docs.columns
    gone = "_gone" + "_" * max(len(c) for c in names)
    key = [gone + c for c in _KEY]
    runs = repeated_passages(docs, min_words).groupBy(*_KEY).agg(F.collect_set(F.struct("b", "e")).alias(gone)).withColumnsRenamed(dict(zip(_KEY, key)))
    own = docs.select(*names, *[c.alias(k) for c, k in zip(_key(), key)])
    both = own.join(runs, key, "left").select(*names, (_line_count() if counts else F.lit(0).cast("long")).alias("_lines"), gone)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name != gone)
    out = both.mapInArrow(_without(names), f"{fields}, _removed long")
    return out.withColumnsRenamed({"_lines": "n_lines", "_removed": "n_removed"}) if counts else out.select(names)


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after the removal, and how many lines it had and lost."""
    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
