"""Token counts by rank-synchronous merging: the distinct pre-tokens of a batch lie in one ragged array, and in each round every
pre-token applies its own lowest-rank pair. What is counted are the symbols that survive."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpoints.llm.bpe_model import NONE, Model, PreTokens, ragged
from roadpoints.llm.registry import query, table
from roadpoints.llm.textnum import slices, texts

MAX_TOKENS = 1024


def surviving(model: Model, words: list[str], block: int = 1 << 16) -> np.ndarray:
    """Number of symbols of each pre-token after all merges."""
    out = [_merged(model, words[k:k + block]) for k in range(0, len(words), block)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _merged(model: Model, words: list[str]) -> np.ndarray:
    symbol, count = ragged(words)
    final = count.copy()
    owner = np.repeat(np.arange(len(words)), count)
    while len(symbol) > 1:
        rank = np.full(len(symbol), NONE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = model.merge(symbol[inner], symbol[inner + 1])
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(owner)))
        # pre-tokens without a pair left are done and leave the array
        alive = np.repeat(low < NONE, size)
        if not alive.any():
            break
        low = np.repeat(low, size)
        hit = (rank == low) & alive
        # of overlapping pairs (a a a) every second one merges, from the left
        at = np.flatnonzero(hit)
        run = np.concatenate([[True], np.diff(at) > 1])
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[place % 2 == 0]
        symbol[at] = rank[at]
        keep = alive
        keep[at + 1] = False
        final -= np.bincount(owner[at], minlength=len(words))
        symbol, owner = symbol[keep], owner[keep]
    return final


def _counted(shared):
    def run(batches):
        model = shared.value
        pre = PreTokens(model)
        counts = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column(1).cast(pa.large_string()).fill_null("")
            _, offsets = texts(column)
            for i, j in slices(offsets):
                if len(pre.number) > pre.most:
                    pre.clear()
                    counts = np.zeros(0, np.int64)
                each, first, new = pre.numbers(column.slice(i, j - i).to_pylist())
                counts = np.concatenate([counts, surviving(model, new)])
                size = np.where(each >= 0, counts[np.maximum(each, 0)], 1) if len(counts) else np.ones(len(each), np.int64)
                total = np.concatenate([[0], np.cumsum(size)])[first]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(offsets[i:j + 1])), pa.array(np.diff(total))],
                                                 names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str | None = None, most: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs`` (doc_id, text; other columns are ignored), one row per row.

    Counts are those of the tokenizers library for the byte-level BPE file at ``path``: its special strings inside a text count as
    one token each, none are added, nothing is cut or padded. A null or empty text has no bytes and no tokens.
    The vocabulary is broadcast; its size is that of the file. Work is one pass over the texts, without a shuffle.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model.read(path or public_tokenizers.path("byte_bpe_50k.json")))
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted(model), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > most)


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
