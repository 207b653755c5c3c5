"""Personal data: patterns for e-mail addresses, IP addresses, cards and phones, and terms that give a protected entity away.

Terms are judged by information content. With n(t), n(e) and n(t, e) the numbers of units (lines, at most UNIT words) with a term, with
an entity (a found value, or any value of a kind) and with both, and N all units, a term discloses PMI(t; e) = log(N n(t, e) / (n(t) n(e))) of the
entity's IC(e) = log(N / n(e)). Terms that disclose at least the share GENERALISE of it in SUPPORT different units are generalised, from
REMOVE on they are removed, wherever they stand.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpoints.llm.registry import query, table
from roadpoints.llm.textnum import ALNUM, Words, line_edges, slices, texts
from roadpoints.session import cut

KINDS = ("email", "ip", "card", "phone")
UNIT, SUPPORT, GENERALISE, REMOVE = 64, 3, 0.8, 0.95
#: bits of the filter of terms that leave a pass over the texts; its size does not depend on the data
FILTER_BITS = 1 << 23
#: the search starts at the sign; what stands before it is added, so that long runs are not scanned again and again
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9][.\x20-]?[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_WORDY = re.compile(r"[a-z\u0080-\U0010ffff]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, in that order."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            begin = m.start()
            while begin > last and text[begin - 1] in _LOCAL_CHARS:
                begin -= 1
            if begin < m.start():
                out.append((begin, 0, m.end()))
                last = m.end()
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _units(w: Words) -> np.ndarray:
    """First word of each unit, and the end: units are lines, and begin anew after UNIT words."""
    n = len(w.start)
    if not n:
        return np.zeros(1, np.int64)
    line = np.searchsorted(line_edges(w.data, w.at), w.start, "right")
    new = np.concatenate([[True], line[1:] != line[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.append(np.flatnonzero((np.arange(n) - first) % UNIT == 0), n)


def _entity(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value.lower()}".encode(), digest_size=8).digest(), "big", signed=True)


def _contexts(rows: list[str], spans: list[list[tuple[int, int, int]]]) -> list[list[dict]]:
    """For each text its (term, entity, unit) triples; term is null once for every entity of a unit."""
    data, offsets = texts(pa.array(rows, pa.string()))
    out = []
    for d, (text, own) in enumerate(zip(rows, spans)):
        w = Words(data, offsets, d, d + 1, ALNUM)
        unit = _units(w)
        inside: dict[int, set] = {}
        covered, byte, char = set(), 0, 0
        for start, kind, end in own:
            if start >= char:
                byte, char = byte + len(text[char:start].encode("utf-8")), start
                b0 = byte
            else:  # overlaps the match before it
                b0 = byte - len(text[start:char].encode("utf-8"))
            b1 = b0 + len(text[start:end].encode("utf-8"))
            a, b = int(np.searchsorted(w.end, b0, "right")), int(np.searchsorted(w.start, b1))
            covered.update(range(a, b))
            inside.setdefault(int(np.searchsorted(unit, a, "right")) - 1, set()).update((_entity(kind, text[start:end]), _entity(kind, "")))
        triples = []
        for u, entities in inside.items():
            a, b = int(unit[u]), int(unit[u + 1])
            key = int(w.gram(np.array([a]), np.array([b]))[0].view(np.int64))
            terms = {w.text(k, k + 1) for k in range(a, b) if k not in covered and w.end[k] - w.start[k] >= 3}
            terms = {t for t in terms if _WORDY.search(t)}
            triples += [{"term": t, "ent": e, "unit": key} for e in entities for t in (None, *terms)]
        out.append(triples)
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_CTX = pa.list_(pa.struct([("term", pa.string()), ("ent", pa.int64()), ("unit", pa.int64())]))
_FOUND = "doc_id long, spans array<struct<start:int,kind:int,end:int>>, ctx array<struct<term:string,ent:long,unit:long>>"


def _found(batches):
    for batch in batches:
        _, offsets = texts(batch.column(1))
        for i, j in slices(offsets):
            rows = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
            spans = [find(t) for t in rows]
            some = [k for k, s in enumerate(spans) if s]
            ctx: list[list] = [[]] * len(rows)
            for k, c in zip(some, _contexts([rows[k] for k in some], [spans[k] for k in some])):
                ctx[k] = c
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()),
                                              pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in own] for own in spans], _SPAN), pa.array(ctx, _CTX)],
                                             names=["doc_id", "spans", "ctx"])


def _hashed(batches):
    for batch in batches:
        data, offsets = texts(batch.column(0))
        h = [int(Words(data, offsets, k, k + 1, ALNUM).hash[0].view(np.int64)) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64())], names=["term", "h"])


def _passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(FILTER_BITS - 1)
    return np.flatnonzero((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


def _unit_counts(keep, most: int = 1 << 21):
    """(h, n): units with each term that passes the filter, summed over the texts of a task (in parts of at most ``most`` terms); all
    units under a null h."""
    def summed(held):
        h, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return h, np.bincount(back, np.concatenate([n for _, n in held]), minlength=len(h)).astype(np.int64)

    def run(batches):
        units, held, size = 0, [], 0
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for i, j in slices(offsets):
                w = Words(data, offsets, i, j, ALNUM)
                unit = _units(w)
                units += len(unit) - 1
                k = _passing(keep.value, w.hash)
                if not len(k):
                    continue
                pair = np.stack([w.hash[k], (np.searchsorted(unit, k, "right") - 1).astype(np.uint64)], 1)
                held.append(np.unique(np.unique(pair, axis=0)[:, 0], return_counts=True))
                size += len(held[-1][0])
                if size > 2 * most:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > most:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["h", "n"])
                        held, size = [], 0
        h, n = summed(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([None], pa.int64()), pa.array(h.view(np.int64))]), pa.array(np.append(units, n))], names=["h", "n"])
    return run


def _occurrences(keep):
    """(doc_id, h, term, start, end), in code points, of the words that pass the filter."""
    def run(batches):
        for batch in batches:
            data, offsets = texts(batch.column(1))
            ids = batch.column(0).cast(pa.int64())
            for i, j in slices(offsets):
                w = Words(data, offsets, i, j, ALNUM)
                k = _passing(keep.value, w.hash)
                chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                doc = np.searchsorted(w.first, k, "right") - 1
                base = chars[w.at[doc]]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc + i)), pa.array(w.hash[k].view(np.int64)), pa.array([w.text(x, x + 1) for x in k.tolist()], pa.string()),
                     pa.array(chars[w.start[k]] - base, pa.int32()), pa.array(chars[w.end[k]] - base, pa.int32())], names=["doc_id", "h", "term", "start", "end"])
    return run


def _filter(terms: DataFrame):
    word = F.shiftright(F.expr(f"h & {FILTER_BITS - 1}L"), 5)
    rows = terms.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31L as int))")).alias("b")).collect()  # at most FILTER_BITS / 32 rows
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in rows:
        bits[r["w"]] = r["b"]
    return terms.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, share: float = GENERALISE) -> DataFrame:
    """(term, h, disclosed): terms that disclose at least ``share`` of an entity, with the largest share; ``found`` is find_base()'s."""
    ctx = found.select(F.inline("ctx"))
    # unit keys are hashes of the words: copies of a unit count as often as they stand, but support needs different ones
    each = ctx.groupBy("term", "ent", "unit").agg(F.count("*").alias("n"))
    pairs = each.groupBy("term", "ent").agg(F.sum("n").alias("n_both"), F.count("*").alias("support"))
    pairs = cut(pairs)
    entity = pairs.where("term is null").select("ent", F.col("n_both").alias("n_ent"))
    pairs = pairs.where(F.col("term").isNotNull() & (F.col("support") >= support))
    terms = cut(pairs.select("term").distinct().mapInArrow(_hashed, "term string, h long"))
    counts = cut(docs.select("text").mapInArrow(_unit_counts(_filter(terms)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = float(counts.where("h is null").agg(F.max("n")).first()[0] or 0)
    scored = (pairs.join(terms, "term").join(counts.where("h is not null").select("h", F.col("n").alias("n_term")), "h").join(entity, "ent"))
    disclosed = (F.log(F.lit(total)) + F.log("n_both") - F.log("n_term") - F.log("n_ent")) / (F.log(F.lit(total)) - F.log("n_ent"))
    return (scored.where(F.col("n_ent") < total).groupBy("term", "h").agg(F.max(disclosed).alias("disclosed")).where(F.col("disclosed") >= share))


def find_base(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, ctx): base matches of every text and the terms beside them, one row per row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_found, _FOUND)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, terms): base spans array<struct<start,kind,end>>, and the disclosing terms array<struct<start,end,remove>>.

    ``docs`` has doc_id and text; other columns are ignored. Positions are code points, ends exclusive; kind is a place in KINDS. A null
    or empty text has no spans. Rows of equal doc_id and text give equal rows; of equal doc_id and different texts each row gets the terms of both.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = cut(find_base(docs))
    terms = cut(disclosing_terms(docs, found))
    spots = docs.where("doc_id is not null").mapInArrow(_occurrences(_filter(terms)), "doc_id long, h long, term string, start int, end int")
    spots = spots.join(terms, ["h", "term"]).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("start", "end", (F.col("disclosed") >= REMOVE).alias("remove")))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,remove:boolean>>")
    return found.select("doc_id", "spans").join(spots, "doc_id", "left").select("doc_id", "spans", F.coalesce("terms", none).alias("terms"))


def sanitised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text): ``docs`` with the spans of personal_data() replaced: base spans by their kind in brackets, terms by [TERM] or nothing.
    Of overlapping spans the first counts, of those with one start the longest."""
    cols = F.concat(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"] + 1).alias("by"))),
                    F.transform("terms", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), F.when(s["remove"], "").otherwise("[TERM]").alias("by"))))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(found.select("doc_id", F.array_sort(cols).alias("all")).dropDuplicates(["doc_id"]), "doc_id", "left")
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
        F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), s["by"]).alias("out"), (-s["neg"]).alias("at")))
    text = F.aggregate("all", zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return both.select("doc_id", F.coalesce(text, F.col("text")).alias("text"))


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base matches and all spans of every document."""
    found = personal_data(table(spark, sf_dir, "documents"))
    name = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("spans", lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"]))
    every = F.array_sort(F.concat(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))),
                                  F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))))
    label = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(label, s["kind"] + 1), s["start"], s["end"])), ",").alias("spans"),
                        F.size("terms").cast("long").alias("n_terms"))
