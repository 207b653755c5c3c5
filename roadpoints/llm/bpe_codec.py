"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token one token can be the last of its encoding. A suffix automaton of the vocabulary gives the tokens
that end at a position, longest first; the one that may follow the last token of the prefix before it is stored. Following these
back-pointers from the end gives the ids. Many pre-tokens go through the automaton together, one byte at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpoints.llm.bpe_model import NONE, Lookup, Model, PreTokens, ragged
from roadpoints.llm.registry import query, table
from roadpoints.llm.textnum import slices, texts


@dataclass
class Automaton:
    """States are the distinct token prefixes; ``fail`` leads to the longest proper suffix that is one."""

    edges: Lookup  # of state * 256 + byte
    fail: np.ndarray
    token: np.ndarray  # longest token that is a suffix of the state
    shorter: np.ndarray  # of each token: the longest token that is a proper suffix of it, or -1

    @classmethod
    def build(cls, tokens: list[bytes]) -> Automaton:
        edges: dict[int, int] = {}
        own, parent, byte = [-1], [0], [0]
        for t, word in enumerate(tokens):
            s = 0
            for b in word:
                key = s * 256 + b
                s = edges.get(key, -1)
                if s < 0:
                    s = edges[key] = len(own)
                    own.append(-1)
                    parent.append(key >> 8)
                    byte.append(b)
            own[s] = t
        depth = [0] * len(own)
        for s in range(1, len(own)):
            depth[s] = depth[parent[s]] + 1
        fail, token, shorter = [0] * len(own), own[:], [-1] * len(tokens)
        for s in sorted(range(1, len(own)), key=depth.__getitem__):
            if depth[s] > 1:
                f = fail[parent[s]]
                while f and f * 256 + byte[s] not in edges:
                    f = fail[f]
                fail[s] = edges.get(f * 256 + byte[s], 0)
            if own[s] >= 0:
                shorter[own[s]] = token[fail[s]]
            else:
                token[s] = token[fail[s]]
        return cls(Lookup(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64), -1), np.array(fail, np.int64), np.array(token, np.int64), np.array(shorter, np.int64))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        state, out, left = state.copy(), np.zeros_like(state), np.arange(len(state))
        while len(left):
            to = self.edges.get(state[left] * 256 + byte[left])
            ok = to >= 0
            out[left[ok]] = to[ok]
            left = left[~ok]
            left = left[state[left] > 0]
            state[left] = self.fail[state[left]]
        return out


class Codec:
    """Encoder and decoder of one vocabulary; pickled once into a broadcast."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton.build(model.tokens)
        self.size = np.array([len(t) for t in model.tokens], np.int64)
        n = np.arange(256, 256 + len(model.left))
        together = self.compatible(model.left, model.right, n)
        self.whole = np.ones(len(model.tokens), bool)  # tokens whose own bytes encode to them alone
        for t, a, b, ok in zip(n.tolist(), model.left.tolist(), model.right.tolist(), together.tolist()):
            self.whole[t] = ok and self.whole[a] and self.whole[b]
        of = dict(zip(model.ids.tolist(), model.tokens)) | {i: s.encode("utf-8") for s, i in model.special.items()}
        table = [of.get(i, b"") for i in range(max(of) + 1)]
        self.flat, self.begin = np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in table])])

    def compatible(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
        """Whether ``left`` and ``right`` stay side by side when their bytes are encoded together.

        The merges inside both are undone from the last one back. At no time may the two symbols that meet have a merge of lower
        rank than the one undone (of equal rank if that one lies to the right, as the leftmost pair goes first).
        """
        merges_l, merges_r = self.model.left, self.model.right
        ok = np.ones(len(left), bool)
        at = np.arange(len(left))
        a, b = left.astype(np.int64), right.astype(np.int64)
        bound = np.full(len(left), NONE) if bound is None else bound.astype(np.int64)
        while len(at):
            bad = self.model.merge(a, b) < bound
            ok[at[bad]] = False
            go = ~bad & (np.maximum(a, b) >= 256)
            at, a, b = at[go], a[go], b[go]
            undo = a > b
            bound = np.where(undo, a, b + 1)
            a, b = np.where(undo, merges_r[np.where(undo, a - 256, 0)], a), np.where(undo, b, merges_l[np.where(undo, 0, b - 256)])
        return ok

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of distinct pre-tokens."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        auto = self.automaton
        byte, size = ragged(words)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        order = np.argsort(-size, kind="stable")
        last = np.zeros(len(byte), np.int64)
        state = np.zeros(len(words), np.int64)
        falling = -size[order]
        for p in range(int(size.max(initial=0))):
            live = order[:np.searchsorted(falling, -p)]  # the words of more than p bytes
            here = begin[live] + p
            state[live] = s = auto.step(state[live], byte[here])
            token, todo = auto.token[s], np.arange(len(live))
            while len(todo):
                t = token[todo]
                start = p + 1 - self.size[t]
                ok = self.whole[t].copy()
                inner = np.flatnonzero(ok & (start > 0))
                ok[inner] = self.compatible(last[begin[live[todo[inner]]] + start[inner] - 1], t[inner])
                last[here[todo[ok]]] = t[ok]
                todo = todo[~ok]
                token[todo] = auto.shorter[token[todo]]
                if len(todo) and token[todo].min() < 0:
                    raise ValueError("a prefix without a last token: the vocabulary is not closed under its merges")
        steps, left, at = [], size.copy(), np.flatnonzero(size)
        count = np.zeros(len(words), np.int64)
        while len(at):
            t = last[begin[at] + left[at] - 1]
            steps.append((at, t))
            count[at] += 1
            left[at] -= self.size[t]
            at = at[left[at] > 0]
        ids = np.zeros(int(count.sum()), np.int64)
        end = np.cumsum(count)
        for k, (at, t) in enumerate(steps):
            ids[end[at] - 1 - k] = self.model.ids[t]
        return ids, count


def _encoded(shared):
    def run(batches):
        codec = shared.value
        pre = PreTokens(codec.model)
        ids, begin = np.zeros(0, np.int64), np.zeros(1, np.int64)
        for batch in batches:
            column = batch.column(1).cast(pa.large_string()).fill_null("")
            _, offsets = texts(column)
            for i, j in slices(offsets):
                if len(pre.number) > pre.most:
                    pre.clear()
                    ids, begin = np.zeros(0, np.int64), np.zeros(1, np.int64)
                each, first, new = pre.numbers(column.slice(i, j - i).to_pylist())
                more, count = codec.encode(new)
                ids = np.concatenate([ids, more])
                begin = np.concatenate([begin, begin[-1] + np.cumsum(count)])
                word = each >= 0
                known = np.where(word, each, 0)
                size = np.where(word, np.diff(begin)[known], 1) if len(begin) > 1 else np.ones(len(each), np.int64)
                start = np.concatenate([[0], np.cumsum(size)])
                flat = -1 - np.repeat(each, size)  # right for special tokens
                if len(ids):
                    source = np.arange(start[-1]) + np.repeat(begin[known] - start[:-1], size)
                    flat = np.where(flat >= 0, flat, ids[np.minimum(source, len(ids) - 1)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(start[first], pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])
    return run


def _decoded(shared):
    def run(batches):
        flat, begin = shared.value.flat, shared.value.begin
        for batch in batches:
            names = batch.schema.names
            lists = batch.column(names.index("ids"))
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            for i, j in slices(ends, 1 << 18):
                own = ids[ends[i]:ends[j]]
                size = begin[own + 1] - begin[own]
                start = np.concatenate([[0], np.cumsum(size)])
                data = flat[np.arange(start[-1]) + np.repeat(begin[own] - start[:-1], size)].tobytes()
                at = start[ends[i:j + 1] - ends[i]]
                out = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                rest = [c.slice(i, j - i) for c, n in zip(batch.columns, names) if n != "ids"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.string())], names=[*[n for n in names if n != "ids"], "decoded"])
    return run


def codec(spark: SparkSession, path: str | None = None):
    """The codec of the byte-level BPE file at ``path`` as a broadcast; its size is a small multiple of the file's."""
    return spark.sparkContext.broadcast(Codec(Model.read(path or public_tokenizers.path("byte_bpe_50k.json"))))


def encode(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, ids) of ``docs`` (doc_id, text; other columns are ignored), one row per row.

    The ids are those of the tokenizers library without added special tokens; special strings inside a text become their ids.
    A null or empty text has no ids. One pass over the texts, without a shuffle.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoded(shared), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, shared) -> DataFrame:
    """``encoded`` with its column ids (array<int>) replaced by decoded, the text of all ids, special ones included.

    Bytes that are not UTF-8 become U+FFFD; a null or empty list gives an empty text; an id outside the vocabulary is an error.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids")
    return encoded.mapInArrow(_decoded(shared), f"{fields}, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): of the ids of every text, and of the text decoded from them."""
    shared = codec(docs.sparkSession, path)
    ids = encode(docs, shared)
    ids = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids")
    return decode(ids, shared).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_bpe_codec")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table."""
    return digests(table(spark, sf_dir, "documents"))
