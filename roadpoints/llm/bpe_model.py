"""A byte-level BPE vocabulary as arrays, and the pre-tokens of text batches.

Symbols are numbered by rank here: the byte value for single bytes, 256 + the number of the merge for merged symbols.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import regex

from roadpoints.llm.textnum import Powers, mix

#: fixed value: the published split pattern of byte-level BPE, which PreTokens follows
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)
OTHER, LETTER, NUMBER, SPACE = range(4)
_CHARS, _LONG = Powers(np.uint64(0xC2B2AE3D27D4EB4F)), np.uint64(0x165667B19E3779F9)


def kinds() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text, at = "".join(map(chr, points)), np.array(points)
    out = np.zeros(0x110000, np.uint8)
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[at[m.start():m.end()]] = value
    return out


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Lookup:
    """A fixed map of non-negative int64 keys for whole arrays: open addressing at a tenth of the load."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, missing, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)  # one key for each free slot
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = self.values[at]  # an empty slot has the value for missing keys
        left = np.flatnonzero((found != keys) & (found >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.keys[at]
            out[left] = self.values[at]
            more = (found != keys[left]) & (found >= 0)
            left, at = left[more], at[more]
        return out


@dataclass
class Model:
    left: np.ndarray  # of merge k, symbol 256 + k
    right: np.ndarray
    ids: np.ndarray  # the vocabulary's id of each symbol
    tokens: list[bytes]
    special: dict[str, int]
    kind: np.ndarray
    merges: Lookup = field(init=False)  # of left << 20 | right

    def __post_init__(self):
        self.merges = Lookup((self.left << np.int64(20)) | self.right, np.arange(256, 256 + len(self.left)), int(NONE))

    @classmethod
    def read(cls, path: str) -> Model:
        """Of a tokenizers .json file with a byte-level BPE model."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, letters = file["model"]["vocab"], byte_letters()
        number = {c: b for c, b in letters.items()}
        names = sorted(letters, key=letters.get)
        pairs = []
        for m in file["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append((number[a], number[b]))
            names.append(a + b)
            number[a + b] = len(names) - 1
        tokens = [bytes(letters[c] for c in n) for n in names]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return cls(both[:, 0], both[:, 1], np.array([vocab[n] for n in names], np.int64), tokens,
                   {t["content"]: t["id"] for t in file.get("added_tokens", [])}, kinds())

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to, NONE for no merge."""
        return self.merges.get((a << np.int64(20)) | b)


class PreTokens:
    """Splits texts to pre-tokens and numbers the distinct ones seen so far, begun anew above ``most``, which bounds the memory.

    The published pattern is followed on whole arrays of characters: a pre-token is a run of letters, of numbers or of other
    characters with one space before it, a contraction, or white space up to the last character before the next run.
    """

    def __init__(self, model: Model, most: int = 300_000):
        self.kind, self.special, self.most = model.kind, model.special, most
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split if self.special else None
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}

    def numbers(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(number of each pre-token, first pre-token of each row and the end, pre-tokens that are new). Special tokens, which are cut
        out first, have -1 - id."""
        pieces, owner, marks = rows, None, []
        if self.split is not None and any(s in t for t in rows for s in self.special):
            pieces, owner = [], []
            for k, t in enumerate(rows):
                for part in self.split(t):
                    if part in self.special:
                        marks.append((len(pieces), self.special[part]))
                    pieces.append(part)
                    owner.append(k)
        text = "".join(pieces)
        size = np.array([len(t) for t in pieces], np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.int64), np.zeros(len(rows) + 1, np.int64), []
        start = self._starts(cp, edge)
        for k, _ in marks:
            start[edge[k] + 1:edge[k + 1]] = False
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(cp))
        up, down = _CHARS.get(len(cp) + 1)
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp + np.uint32(1)) * up[:len(cp)], out=total[1:])
        key = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _LONG)
        distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
        get, known = self.number, len(self.number)
        number = np.array([get.setdefault(h, len(get)) for h in distinct.tolist()], np.int64)
        fresh = np.flatnonzero(number >= known)
        fresh = fresh[np.argsort(number[fresh])]
        new = [text[i:j] for i, j in zip(begin[at[fresh]].tolist(), end[at[fresh]].tolist())]
        out = number[back]
        first = np.searchsorted(begin, edge)
        for k, i in marks:
            out[first[k]] = -1 - i
        if owner is not None:
            first = first[np.searchsorted(np.array(owner), np.arange(len(rows) + 1))]
        return out, first, new

    def _starts(self, cp: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each character; texts begin at ``edge``."""
        n, kind = len(cp), self.kind[cp]
        begins = np.zeros(n + 1, bool)
        begins[edge] = True
        ends, begins = begins[1:], begins[:-1]  # is the last, the first character of a text
        run = begins.copy()
        run[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        start = run.copy()
        blank = np.zeros(n, bool)  # after a space of the same text
        blank[1:] = (cp[:-1] == 0x20) & ~begins[1:]
        start[run & ~space & blank] = False
        final = space & ~ends
        final[:-1] &= ~space[1:]
        start[final] = True
        quote = np.flatnonzero((cp == 0x27) & run & ~blank & ~ends)
        if len(quote):
            after = cp[quote + 1]
            more = np.where(ends[quote + 1], 0, cp[np.minimum(quote + 2, n - 1)])
            one = np.isin(after, [ord(c) for c in "stmd"])
            two = ((after == ord("r")) & (more == ord("e"))) | ((after == ord("v")) & (more == ord("e"))) | ((after == ord("l")) & (more == ord("l")))
            start[quote[one | two] + 1] = False
            for hit, length in ((one, 2), (two, 3)):
                rest = quote[hit] + length
                start[rest[rest < n]] = True
        return start


def ragged(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as int64, lengths) of the words, one after the other."""
    coded = [w.encode("utf-8") for w in words]
    return np.frombuffer(b"".join(coded), np.uint8).astype(np.int64), np.array([len(c) for c in coded], np.int64)
