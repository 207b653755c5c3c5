"""Small tables that hold the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns named like internal ones of the operators
CLASHING = ("n", "h", "band", "digest", "node", "component", "fp", "b", "e", "words", "kept", "n_lines", "spans", "ids", "share", "q")


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def sentences(words: list[str], per_line: int = 25) -> str:
    lines = [" ".join(words[k:k + per_line]) + "." for k in range(0, len(words), per_line)]
    return "\n".join(lines)


def documents() -> list[tuple]:
    rng = random.Random(11)
    base = prose(rng, 220)
    near = list(base)
    near[100] = "changed"
    far = base[:110] + prose(rng, 110)
    rows = [(1, sentences(base)), (2, sentences(near)), (3, sentences(base)), (4, sentences(far)), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "One  TWO"),
            (10, "short text of five words"), (11, "Short TEXT of five words"), (12, sentences(prose(rng, 30000))), (13, "x" * 50000), (14, "ä é 中文 \U0001f600 " * 300),
            (15, sentences(base)), (15, sentences(base)), (16, "a b c " * 100), (17, "don't stop!!! I've 12,345 <|endoftext|> tokens\r\n\r\n  end "),
            (18, "\x1c \x85\xa0 odd\x00spaces")]
    rows += [(100 + k, sentences(prose(rng, 120))) for k in range(12)]
    # a group of near copies, each with words of its own changed
    for k in range(20):
        own = list(base)
        own[k * 11] = f"own{k}"
        rows.append((200 + k, sentences(own)))
    langs = ["en", "de", None]
    return [(i, t, langs[i % 3], f"s{i % 2}" if i % 5 else None, None if t is None else len(t)) for i, t in rows]


def frame(spark, rows=None, clashing: bool = False):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if clashing:
        df = df.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    return df


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def first_places(rows, least):
    """Words that stay: those in no run of ``least`` words that stands earlier."""
    first, words = {}, {}
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: r[0]):
        words[i] = w = WORD.findall(t or "")
        for p in range(len(w) - least + 1):
            first.setdefault(tuple(w[p:p + least]), (i, p))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - least + 1):
            d, q = first[tuple(w[p:p + least])]
            if (d, q) != (i, p):
                gone |= set(range(max(p, q + least) if d == i else p, p + least))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out
