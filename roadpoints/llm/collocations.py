"""Collocations from weighted acyclic automata of word sequences.

A task counts the phrases of its texts in automata: words are labels, a path from the start is a phrase and carries its number of occurrences; states that
accept the same ends with the same numbers are one. Automata are built from sorted phrases and united as the task goes on. What a task has counted
is cut by prefix range: the range of the first word, shared out by the words after it. One task unites the automata of a range from all
tasks and sums their weights; phrases below the least count go.

Phrases of three words are counted in a second pass, only where both their pairs of words are frequent, as every frequent phrase's are. A filter of a fixed
number of bits tells most infrequent pairs; what slips through is counted and goes with the others.

Parts of phrases lie in other ranges. Each range asks the others for the parts it needs, each part once, and composes its phrases with the answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from roadpoints.llm.registry import query, table
from roadpoints.llm.textnum import Words, _table, mix, slices, texts
from roadpoints.session import cut

#: occurrences of a candidate at least, phrases returned for each language, and the share of a longer phrase, in hundredths, from which on a phrase is part of it
LEAST, TOP, INSIDE = 10, 2000, 50
#: phrases that a task holds before it hands them on, and phrases in new automata from which on they are united with the others
MOST, HELD = 300_000, 150_000
#: bytes of text for each place (a prefix range's share); the number of places follows the table
PLACE_BYTES = 4 << 20
#: bits of the filter of frequent pairs; its size does not depend on the data
FILTER_BITS = 1 << 26
SPLITS = b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = _table(SPLITS + b" \t", True)
_SPLIT = np.zeros(256, bool)
_SPLIT[list(SPLITS)] = True
_C = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_NONE = np.uint64(0)


def _sorted(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of small numbers in order, with the sums of ``n``."""
    if len(a) and max(int(a.max()), int(b.max()), int(c.max())) < 1 << 21:  # three numbers in one
        key = (a << 42) | (b << 21) | c
        key, total = _summed(key, n)
        return key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF, total
    pair, at = np.unique((a << 32) | b, return_inverse=True)
    key, total = _summed((at.astype(np.int64) << 32) | c, n)
    pair = pair[key >> 32]
    return pair >> 32, pair & 0xFFFFFFFF, key & 0xFFFFFFFF, total


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def _pile(held: list[Counts], counts: Counts) -> None:
    """Adds an automaton to ``held``. All are united when the new ones have as many phrases as the first: a phrase is moved few times."""
    held.append(counts)
    size = [len(c.a1) + len(c.a2) + len(c.a3) for c in held]
    if sum(size[1:]) >= max(size[0], HELD):
        held[:] = [Counts.union(held)]


def _arcs(values: np.ndarray, size: int) -> np.ndarray:
    """Where the arcs of each of ``size`` states begin, and the end; ``values`` are the states of the arcs, in order."""
    return np.searchsorted(values, np.arange(size + 1))


class Counts:
    """A weighted acyclic automaton of phrases of one to three words.

    ``labels`` are the sorted hashes of its words. The start has the arcs ``a1`` (numbers of labels) with weights ``n1``; the state behind
    arc k has the arcs ``b1[k]:b1[k + 1]`` of ``a2`` and ``n2``; these lead to the states ``to``, whose arcs are ``b3[s]:b3[s + 1]`` of ``a3`` and ``n3``. A
    weight of 0 accepts nothing.
    """

    PARTS = ("labels", "a1", "n1", "b1", "a2", "n2", "to", "b3", "a3", "n3")

    def __init__(self, *parts: np.ndarray):
        for name, part in zip(self.PARTS, parts):
            setattr(self, name, part)

    @classmethod
    def build(cls, labels: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> Counts:
        """From distinct phrases in order; ``a``, ``b``, ``c`` are 1 + the numbers of the labels, 0 where the phrase has ended."""
        n = n.astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        a1, n1 = a[first] - 1, np.where(b[first] == 0, n[first], 0)
        two = np.flatnonzero(b)
        pair = (a[two] << 32) | b[two]
        first = two[np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))] if len(two) else two
        a2, n2 = b[first] - 1, np.where(c[first] == 0, n[first], 0)
        b1 = _arcs(np.searchsorted(a1, a[first] - 1), len(a1))
        three = np.flatnonzero(c)
        owner = np.searchsorted((a[first] << 32) | b[first], (a[three] << 32) | b[three])
        b3 = _arcs(owner, len(first))
        a3, n3 = c[three] - 1, n[three]
        # states with the same arcs become one: 0 is the state without arcs
        c3 = np.concatenate([[_NONE], np.cumsum(mix(a3.astype(np.uint64) * _C[0] + n3.astype(np.uint64) * _C[1]), dtype=np.uint64)])
        sign = mix(c3[b3[1:]] - c3[b3[:-1]] + np.diff(b3).astype(np.uint64))
        sign[np.diff(b3) == 0] = 0
        distinct, one, to = np.unique(np.concatenate([[_NONE], sign]), return_index=True, return_inverse=True)
        size = np.concatenate([[0], np.diff(b3)])[one]
        begin = np.concatenate([[0], b3[:-1]])[one]
        edge = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])
        return cls(labels, a1, n1, b1, a2, n2, to[1:], edge, a3[at], n3[at])

    def phrases(self) -> tuple[np.ndarray, ...]:
        """(a, b, c, n) of all accepted phrases, as ``build`` takes them, but not in order."""
        owner = np.repeat(np.arange(len(self.a1)), np.diff(self.b1))
        size = np.diff(self.b3)[self.to]
        arc = np.repeat(np.arange(len(self.a2)), size)
        at = np.arange(len(arc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.b3[self.to], size)
        none1, none2 = np.zeros(len(self.a1), np.int64), np.zeros(len(self.a2), np.int64)
        a = np.concatenate([self.a1, self.a1[owner], self.a1[owner[arc]]]).astype(np.int64) + 1
        b = np.concatenate([none1, self.a2 + 1, self.a2[arc] + 1]).astype(np.int64)
        c = np.concatenate([none1, none2, self.a3[at] + 1]).astype(np.int64)
        n = np.concatenate([self.n1, self.n2, self.n3[at]]).astype(np.int64)
        on = n > 0
        return a[on], b[on], c[on], n[on]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of all accepted phrases as an array of three columns, 0 for none; weights)."""
        a, b, c, n = self.phrases()
        known = np.concatenate([[_NONE], self.labels])
        return np.stack([known[a], known[b], known[c]], axis=1), n

    @classmethod
    def of(cls, words: np.ndarray, n: np.ndarray) -> Counts:
        """Of phrases as ``hashes`` gives them, in any order, repeated ones summed."""
        labels, at = np.unique(np.concatenate([[_NONE], words.reshape(-1)]), return_inverse=True)
        at = at[1:].reshape(-1, 3).astype(np.int64)
        return cls.build(labels[1:], *_sorted(at[:, 0], at[:, 1], at[:, 2], n))

    @classmethod
    def union(cls, parts: list[Counts]) -> Counts:
        """All phrases of all parts, weights summed."""
        if len(parts) == 1:
            return parts[0]
        labels = np.unique(np.concatenate([p.labels for p in parts]))
        rows = []
        for p in parts:
            place = np.concatenate([[0], np.searchsorted(labels, p.labels) + 1])
            a, b, c, n = p.phrases()
            rows.append((place[a], place[b], place[c], n))
        return cls.build(labels, *_sorted(*[np.concatenate(x) for x in zip(*rows)]))

    def weights(self, words: np.ndarray) -> np.ndarray:
        """Composition with an acceptor of the phrases ``words`` (three columns, 0 for none): their weights, 0 where not accepted."""
        out = np.zeros(len(words), np.int64)
        if not len(self.labels):
            return out

        def label(column: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(self.labels, column), len(self.labels) - 1)
            return np.where(self.labels[at] == column, at, -1)

        def follow(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(wanted), -1)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where((wanted >= 0) & (keys[at] == wanted), at, -1)

        def step(state: np.ndarray, column: np.ndarray) -> np.ndarray:
            return np.where((state >= 0) & (column >= 0), (state.astype(np.int64) << 32) | np.maximum(column, 0), -1)

        x, y, z = (label(words[:, k]) for k in range(3))
        s1 = follow(self.a1.astype(np.int64), x)
        s2 = follow((np.repeat(np.arange(len(self.a1)), np.diff(self.b1)).astype(np.int64) << 32) | self.a2, step(s1, y))
        s3 = follow((np.repeat(np.arange(len(self.b3) - 1), np.diff(self.b3)).astype(np.int64) << 32) | self.a3,
                    step(np.where(s2 >= 0, self.to[s2] if len(self.to) else -1, -1), z))
        for state, n, on in ((s1, self.n1, words[:, 1] == 0), (s2, self.n2, (words[:, 1] != 0) & (words[:, 2] == 0)), (s3, self.n3, words[:, 2] != 0)):
            hit = np.flatnonzero(on & (state >= 0))
            out[hit] = n[state[hit]]
        return out

    def dump(self) -> bytes:
        """The arrays, each with the smallest number type that holds it."""
        parts = [getattr(self, name) for name in self.PARTS]
        packed = [p if k == 0 else p.astype(np.min_scalar_type(int(p.max(initial=0)))) for k, p in enumerate(parts)]
        head = np.array([[len(p), p.itemsize] for p in packed], np.int64)
        return b"".join([head.tobytes(), *[p.tobytes() for p in packed]])

    @classmethod
    def load(cls, data: bytes) -> Counts:
        n = len(cls.PARTS)
        head, at, parts = np.frombuffer(data, np.int64, 2 * n).reshape(n, 2), 16 * n, []
        for k, (size, width) in enumerate(head.tolist()):
            part = np.frombuffer(data, f"u{width}", size, at)
            parts.append(part if k == 0 else part.astype(np.int64))
            at += size * width
        return cls(*parts)


class Places:
    """Where a phrase is counted: a range of the first word's hash, and in it a share by the words after it. A frequent first word is in one range, but in
    all its shares."""

    def __init__(self, places: int):
        bits = max(places - 1, 1).bit_length()
        self.share_bits = bits // 2
        self.range_bits = bits - self.share_bits

    def of(self, words: np.ndarray) -> np.ndarray:
        prefix = (mix(words[:, 0] * _C[0]) >> np.uint64(64 - self.range_bits)).astype(np.int64)
        if not self.share_bits:
            return prefix
        rest = mix(words[:, 1] * _C[1] + words[:, 2] * _C[2]) >> np.uint64(64 - self.share_bits)
        return (prefix << self.share_bits) | np.where(words[:, 1] == 0, _NONE, rest).astype(np.int64)


def _bit(words: np.ndarray) -> np.ndarray:
    """The filter's bit of each pair of words (two columns)."""
    return (mix(words[:, 0] * _C[1] + words[:, 1] * _C[2]) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


class Tokens:
    """The words of a slice of texts: hash of language and word, and whether a piece goes on with the next word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, tags: np.ndarray):
        w = self.words = Words(data, offsets, i, j, _KIND)
        owner = np.repeat(np.arange(j - i), np.diff(w.first))
        self.label = mix(w.hash + tags[owner]) if len(owner) else np.zeros(0, np.uint64)
        self.label[self.label == 0] = 1
        split = np.concatenate([[0], np.cumsum(_SPLIT[w.data])])
        self.on = np.zeros(len(self.label), bool)
        if len(self.label):
            self.on[:-1] = (owner[1:] == owner[:-1]) & (split[w.start[1:]] == split[w.end[:-1]])
        self.owner = owner

    def count(self, allowed: np.ndarray | None) -> tuple[Counts, np.ndarray, np.ndarray]:
        """Phrases of one and two words, or with the filter ``allowed`` those of three whose pairs it holds. (automaton, labels, first place of each)"""
        labels, first, at = np.unique(self.label, return_index=True, return_inverse=True)
        at = at.astype(np.int64) + 1
        n = np.flatnonzero(self.on)
        if allowed is None:
            none = np.zeros(len(at), np.int64)
            a, b = np.concatenate([at, at[n]]), np.concatenate([none, at[n + 1] if len(n) else n])
            return Counts.build(labels, *_sorted(a, b, np.zeros(len(a), np.int64), np.ones(len(a), np.int64))), labels, first
        bit = _bit(np.stack([self.label[n], self.label[n + 1]], axis=1)) if len(n) else n
        good = np.zeros(len(at), bool)
        good[n] = (allowed[bit >> 3] >> (bit & 7)) & 1 == 1
        n = np.flatnonzero(good[:-1] & good[1:]) if len(good) else n
        return Counts.build(labels, *_sorted(at[n], at[n + 1], at[n + 2], np.ones(len(n), np.int64))), labels, first


_PIECE = "place int, counts binary, words array<string>, langs array<string>"
_PIECE_SCHEMA = pa.schema([("place", pa.int32()), ("counts", pa.binary()), ("words", pa.list_(pa.string())), ("langs", pa.list_(pa.string()))])


def _pieces(places: Places, counts: Counts, name=None):
    """Rows of ``_PIECE``: the automaton cut by place; words and languages are those of its phrases of one word, in order."""
    words, n = counts.hashes()
    place = places.of(words)
    order = np.argsort(place, kind="stable")
    words, n, place = words[order], n[order], place[order]
    edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(1, np.int64)
    rows = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        part = Counts.of(words[lo:hi], n[lo:hi])
        single = part.labels[part.a1[part.n1 > 0]].tolist() if name else []
        rows.append((int(place[lo]), part.dump(), [name[h][1] for h in single], [name[h][0] for h in single]))
        if len(rows) == 256 or hi == edge[-1]:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PIECE_SCHEMA)], schema=_PIECE_SCHEMA)
            rows = []


def _counted(places: Places, shared):
    """A task's automata; ``shared`` is the filter's bytes for phrases of three words, None for those of one and two."""
    def run(batches):
        held: list[Counts] = []
        name: dict[int, tuple[str, str]] = {}
        allowed = None if shared is None else np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            data, offsets = texts(batch.column(1))
            langs = ["und" if v is None else v for v in batch.column(0).to_pylist()]
            for i, j in slices(offsets):
                tag = {v: np.frombuffer(v.encode("utf-8") + b"\0" * (-len(v.encode("utf-8")) % 8 + 8), np.uint64) for v in set(langs[i:j])}
                tag = {v: mix((t * mix(np.arange(1, len(t) + 1, dtype=np.uint64))).sum(dtype=np.uint64)[None])[0] for v, t in tag.items()}
                t = Tokens(data, offsets, i, j, np.array([tag[v] for v in langs[i:j]], np.uint64))
                counts, labels, first = t.count(allowed)
                if shared is None:
                    for h, k in zip(labels.tolist(), first.tolist()):
                        if h not in name:
                            name[h] = (langs[i + t.owner[k]], t.words.text(k, k + 1))
                _pile(held, counts)
                size = len(held[0].a1) + len(held[0].a2) + len(held[0].a3)
                if size > MOST:
                    yield from _pieces(places, Counts.union(held), name if shared is None else None)
                    held, name = [], {}
        if held:
            yield from _pieces(places, Counts.union(held), name if shared is None else None)
    return run


_RANGE = f"{_PIECE}, totals map<string,long>"
_RANGE_SCHEMA = pa.schema([*_PIECE_SCHEMA, ("totals", pa.map_(pa.string(), pa.int64()))])


def _united(least: int):
    """Sums the automata of each place, which come one after the other, and keeps frequent phrases; totals are all words by language."""
    def run(batches):
        place, held, name, rows = None, [], {}, []

        def close():
            counts = Counts.union(held)
            words, n = counts.hashes()
            totals: dict[str, int] = {}
            if name:
                single = words[:, 1] == 0
                for h, k in zip(words[single, 0].tolist(), n[single].tolist()):
                    lang = name[h][0]
                    totals[lang] = totals.get(lang, 0) + k
            counts = Counts.of(words[n >= least], n[n >= least])
            own = counts.labels[counts.a1[counts.n1 > 0]].tolist() if name else []
            return (place, counts.dump(), [name[h][1] for h in own], [name[h][0] for h in own], list(totals.items()))

        for batch in batches:
            for p, data, words, langs in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if p != place:
                    if place is not None:
                        rows.append(close())
                    place, held, name = p, [], {}
                single = Counts.load(data)
                if words:
                    for h, w, v in zip(single.labels[single.a1[single.n1 > 0]].tolist(), words, langs):
                        name[h] = (v, w)
                _pile(held, single)
            if len(rows) >= 16:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RANGE_SCHEMA)], schema=_RANGE_SCHEMA)
                rows = []
        if place is not None:
            rows.append(close())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RANGE_SCHEMA)], schema=_RANGE_SCHEMA)
    return run


def _ranges(docs: DataFrame, places: Places, n_places: int, least: int, shared=None) -> DataFrame:
    pieces = docs.mapInArrow(_counted(places, shared), _PIECE)
    tasks = max(min(n_places, 4096), n_places // 64)
    return cut(pieces.repartition(tasks, "place").sortWithinPartitions("place").mapInArrow(_united(least), _RANGE))


def _filter(ranges: DataFrame) -> bytes:
    """The bytes of the filter of frequent pairs."""
    def bits(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                words, _ = Counts.load(data).hashes()
                bit = np.unique(_bit(words[(words[:, 1] != 0) & (words[:, 2] == 0)]))
                yield pa.RecordBatch.from_pydict({"at": pa.array(bit >> 5, pa.int32()), "mask": pa.array(np.int64(1) << (bit & 31), pa.int64())})

    words = ranges.select("counts").mapInArrow(bits, "at int, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(FILTER_BITS // 32, "<u4")  # at most so many rows
    out[words["at"].to_numpy()] = words["mask"].to_numpy()
    return out.tobytes()


_ASK = "home int, place int, x long, y long, longer long"
_ASK_SCHEMA = pa.schema([("home", pa.int32()), ("place", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("longer", pa.int64())])


def _asked(places: Places):
    """Parts that each place needs: (place of the part, place that asks, part, count of the longest asking phrase it is a pair of)."""
    def run(batches):
        for batch in batches:
            for place, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, n = Counts.load(data).hashes()
                many = words[:, 1] != 0
                words, n = words[many], n[many]
                three = words[:, 2] != 0
                triple, m = words[three], n[three]
                zero = np.zeros(len(triple), np.uint64)
                pairs = np.concatenate([np.stack([triple[:, 0], triple[:, 1], zero], axis=1), np.stack([triple[:, 1], triple[:, 2], zero], axis=1)])
                pairs, at = np.unique(pairs, axis=0, return_inverse=True)
                longer = np.zeros(len(pairs), np.int64)
                np.maximum.at(longer, at.reshape(-1), np.concatenate([m, m]))
                single = np.unique(words[words != 0])
                parts = np.concatenate([pairs, np.stack([single, np.zeros_like(single), np.zeros_like(single)], axis=1)])
                longer = np.concatenate([longer, np.zeros(len(single), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(places.of(parts), pa.int32()), pa.array(np.full(len(parts), place), pa.int32()),
                                                  pa.array(parts[:, 0].view(np.int64)), pa.array(parts[:, 1].view(np.int64)), pa.array(longer)], schema=_ASK_SCHEMA)
    return run


def _row_words(t: pa.Table) -> np.ndarray:
    x, y = t["x"].to_numpy().view(np.uint64), t["y"].to_numpy().view(np.uint64)
    return np.stack([x, y, np.zeros_like(x)], axis=1)


_ANSWER = "place int, x long, y long, n long, word string, lang string, longer long"
_ANSWER_SCHEMA = pa.schema([("place", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("word", pa.string()), ("lang", pa.string()), ("longer", pa.int64())])


def _answered(_, own: pa.Table, asks: pa.Table) -> pa.Table:
    """Weights of the asked parts, addressed to the place that asked, and of each pair the count of the longest phrase it lies in, to its own place."""
    if not own.num_rows or not asks.num_rows:
        return _ANSWER_SCHEMA.empty_table()
    counts = Counts.union([Counts.load(d) for d in own["counts"].to_pylist()])
    words = _row_words(asks)
    n = counts.weights(words)
    name = {}
    for data, texts_, langs in zip(*[own[c].to_pylist() for c in ("counts", "words", "langs")]):
        single = Counts.load(data)
        if texts_:
            name.update(zip(single.labels[single.a1[single.n1 > 0]].tolist(), zip(texts_, langs)))
    named = [name[h] if y == 0 else (None, None) for h, y in zip(words[:, 0].tolist(), words[:, 1].tolist())]
    pairs, at = np.unique(words, axis=0, return_inverse=True)
    longer = np.zeros(len(pairs), np.int64)
    np.maximum.at(longer, at.reshape(-1), asks["longer"].to_numpy())
    pairs, longer = pairs[longer > 0], longer[longer > 0]
    home = own["place"][0].as_py()
    out = [np.concatenate([asks["place"].to_numpy(), np.full(len(pairs), home)]), np.concatenate([words[:, 0], pairs[:, 0]]).view(np.int64),
           np.concatenate([words[:, 1], pairs[:, 1]]).view(np.int64), np.concatenate([n, np.zeros(len(pairs), np.int64)]),
           [v[0] for v in named] + [None] * len(pairs), [v[1] for v in named] + [None] * len(pairs), np.concatenate([np.zeros(len(n), np.int64), longer])]
    return pa.table([pa.array(c, f.type) for c, f in zip(out, _ANSWER_SCHEMA)], schema=_ANSWER_SCHEMA)


_SCORED = "lang string, phrase string, a long, l long, r long, score long"


def _scored(inside: int):
    """Candidates of a place composed with the automaton of the answered parts."""
    def run(_, own: pa.Table, answers: pa.Table) -> pa.Table:
        words, a = Counts.union([Counts.load(d) for d in own["counts"].to_pylist()]).hashes() if own.num_rows else (np.zeros((0, 3), np.uint64), np.zeros(0, np.int64))
        many = words[:, 1] != 0
        words, a = words[many], a[many]
        rows = []
        if len(words):
            part, n = _row_words(answers), answers["n"].to_numpy()
            known = Counts.of(part[n > 0], n[n > 0])
            mark = answers["longer"].to_numpy()
            longer = Counts.of(part[mark > 0], mark[mark > 0]) if (mark > 0).any() else None
            name = {h: (w, v) for h, w, v in zip(part[:, 0].tolist(), answers["word"].to_pylist(), answers["lang"].to_pylist()) if w is not None}
            zero = np.zeros(len(words), np.uint64)

            def f(*columns):
                return known.weights(np.stack([*columns, *[zero] * (3 - len(columns))], axis=1)).tolist()

            x, y, z = words.T
            one, last, front, back = f(x), f(np.where(z == 0, y, z)), f(x, y), f(y, z)
            held = (longer.weights(words) if longer is not None else np.zeros(len(words), np.int64)).tolist()
            for k, (h, n) in enumerate(zip(words.tolist(), a.tolist())):
                if h[2] == 0 and 100 * held[k] >= inside * n:
                    continue
                cuts = [(one[k], last[k])] if h[2] == 0 else [(one[k], back[k]), (front[k], last[k])]
                score, _, l, r = min((1_000_000 * n * n // (l * r), c, l, r) for c, (l, r) in enumerate(cuts))
                rows.append((name[h[0]][1], " ".join(name[v][0] for v in h if v), n, l, r, score))
        types = [pa.string(), pa.string(), *[pa.int64()] * 4]
        names = ("lang", "phrase", "a", "l", "r", "score")
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, types))})
    return run


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs`` (text, lang; other columns are ignored): of each language the ``top`` phrases of two or three words.

    A null lang counts as ``und``, a null text as empty. Pieces end at ``. , ; : ! ?`` and line ends, words at spaces and tabs; A-Z are lower-cased. Repeated rows count as often
    as they stand. ``a`` occurrences, ``l`` and ``r`` those of the two parts at the cut of lowest score floor(10^6 a^2 / (l r)), in Python's exact integers. Phrases of fewer than ``least``
    occurrences are no candidates; pairs that lie in a candidate of three words with ``inside`` hundredths of their occurrences are dropped. Words
    are compared by 64-bit hashes of language and word. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("lang", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_places = 1 << max(2, int(size // PLACE_BYTES).bit_length())
    places = Places(n_places)
    pairs = _ranges(docs, places, n_places, least)
    triples = _ranges(docs, places, n_places, least, spark.sparkContext.broadcast(_filter(pairs)))
    both = pairs.select("place", "counts", "words", "langs").unionByName(triples.select("place", "counts", "words", "langs"))
    asks = both.select("place", "counts").mapInArrow(_asked(places), _ASK)
    asks = cut(asks.groupBy("home", "place", "x", "y").agg(F.max("longer").alias("longer")))
    answers = cut(asks.groupBy("home").cogroup(both.withColumnRenamed("place", "home").groupBy("home")).applyInArrow(
        lambda key, a, own: _answered(key, own.rename_columns(["place" if c == "home" else c for c in own.column_names]), a), _ANSWER))
    found = both.groupBy("place").cogroup(answers.groupBy("place")).applyInArrow(_scored(inside), _SCORED)
    totals = pairs.select(F.explode("totals").alias("lang", "k")).groupBy("lang").agg(F.sum("k").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_WORDS = r"list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '')"
SQL = rf"""
with d as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
w as (select lang, {_WORDS} w from d),
u as (select lang, unnest(range(1, len(w) + 1)) i, w from w),
g as (select lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') phrase from u, range(1, 4) s(k) where i + k - 1 <= len(w)),
f as materialized (select lang, phrase, count(*)::hugeint f, any_value(k) k from g group by lang, phrase),
c as materialized (select *, string_split(phrase, ' ') w from f where k > 1 and f >= {LEAST}),
t as materialized (select lang, k, phrase, f a, j, list_aggregate(w[1:j], 'string_agg', ' ') lp, list_aggregate(w[j + 1:], 'string_agg', ' ') rp
      from (select *, unnest(range(1, k)) j from c)),
h as materialized (select t.*, f.f l from t join f on f.lang = t.lang and f.phrase = t.lp),
s as (select h.*, f.f r, 1000000 * a * a // (l * f.f) score from h join f on f.lang = h.lang and f.phrase = h.rp),
m as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
b as (select lang, list_aggregate(w[x:x + 1], 'string_agg', ' ') phrase, max(f) f from c, range(1, 3) t(x) where k = 3 group by all),
o as (select m.* from m left join b using (lang, phrase) where b.f is null or m.k = 3 or 100 * b.f < {INSIDE} * m.a),
n as (select lang, sum(f) n from f where k = 1 group by lang)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score
from o join n using (lang) qualify rank <= {TOP}"""


@query("op13_collocations", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))
