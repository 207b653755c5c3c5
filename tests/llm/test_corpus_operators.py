"""The operators on documents against brute force on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from cases import by_id, documents, first_places, frame
from tokenizers import Tokenizer

from roadpoints.llm import bpe_codec, decontaminate, line_dedup, minmax_dedup, pii, quality_rules, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    return documents()


def shingle_sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        out[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def smallest_linked(sets):
    top = {i: i for i in sets}
    links = defaultdict(set)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        top[i] = min(seen)
    return top


@pytest.mark.parametrize("clashing", [False, True])
def test_near_duplicates(spark, rows, clashing):
    sets = shingle_sets(rows)
    top = smallest_linked(sets)
    got = by_id(minmax_dedup.near_duplicates(frame(spark, clashing=clashing)), "n_shingles", "component_id", "kept")
    assert got == {i: (len(s), top[i], top[i] == i) for i, s in sets.items()}


def test_near_duplicates_in_turns(spark):
    """Chains of copies whose ends are not alike: found although a bucket's members are not compared with each other."""
    rows, words = [], [f"t{k}" for k in range(400)]
    for k in range(40):
        words = list(words)
        for p in range(k * 3, k * 3 + 6):
            words[p % 400] = f"n{k}p{p}"
        rows.append((1000 - k, " ".join(words), "en", "s", 0))
    sets = shingle_sets(rows)
    got = by_id(minmax_dedup.near_duplicates(frame(spark, rows)), "component_id")
    assert got == {i: (t,) for i, t in smallest_linked(sets).items()}


def test_minima_and_maxima_estimate_similarity():
    """Shares of equal signature values are unbiased estimates: of two sets of similarity 1/2 about half the bands of one value agree."""
    import numpy as np
    rng = np.random.default_rng(5)
    hit = total = 0
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = x[:200], x[100:]
        sa = minmax_dedup.signature(np.concatenate([a, b]), np.array([0, 200]))
        hit += int((sa[0] == sa[1]).sum())
        total += sa.shape[1]
    assert abs(hit / total - (1 / 3) ** minmax_dedup.ROWS) < 0.02


def test_quality_statistics(spark, rows):
    want = {}
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        rep = {k + j for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))
    got = by_id(quality_rules.quality(frame(spark, clashing=True)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == want


def test_quality_outliers(spark):
    rows = [(k, " ".join(f"word{(k * j) % 997}" for j in range(1, 90)), "en", "a" if k % 3 else "b", 0) for k in range(1, 301)]
    junk = [(k, " ".join(f"W{(k * j) % 997}$$$###" for j in range(1, 90)), "en", "a", 0) for k in range(1000, 1010)]
    got = by_id(quality_rules.quality(frame(spark, rows + junk)), "kept")
    assert all(got[k] == (True,) for k in range(1, 301)) and not any(got[k][0] for k in range(1000, 1010))


def test_fingerprints_are_guaranteed():
    import numpy as np
    assert np.array_equal(decontaminate.minima(np.array([5, 3, 4, 3, 9, 1, 2], np.uint64), np.array([0]), 3), [1, 3, 5])


def contaminated(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k:k + size])].add(i)
    sizes = {len(k) for k in windows}
    out = {}
    for i, t, *_ in rows:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                if own := windows.get(tuple(w[k:k + s])):
                    found |= own
                    hit |= set(range(k, k + s))
        names = ",".join(sorted(map(str, found)))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


COLS5 = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination(spark, rows):
    base = rows[0][1].split()
    items = [(1, " ".join(base[5:40])), (2, " ".join(base[30:60]).upper()), (3, "one two"), (4, None), (5, ""), (6, "!?"), (7, "five"), (8, " ".join(base[100:109])),
             (9, " ".join(base[5:40])), (10, " ".join(base[-13:])), (11, "not there at all in any of the texts that are here today ok yes")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert by_id(decontaminate.contamination(frame(spark, clashing=True), tests), *COLS5) == contaminated(rows, items)


def test_decontamination_without_items(spark, rows):
    tests = spark.createDataFrame([], "item_id long, text string")
    got = by_id(decontaminate.contamination(frame(spark), tests), "n_hit", "contaminated")
    assert set(got) == {r[0] for r in rows} and set(got.values()) == {(0, False)}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, rows, library):
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows}
    got = by_id(token_counts.token_counts(frame(spark, clashing=True)), "n_bytes", "n_tokens", "over_limit")
    assert got == {i: (b, n, n > 1024) for i, (b, n) in want.items()}


def test_bpe_codec(spark, rows, library):
    shared = bpe_codec.codec(spark)
    ids = bpe_codec.encode(frame(spark, clashing=True), shared)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == want
    got = by_id(bpe_codec.decode(ids, shared), "decoded")
    assert got == {i: (library.decode(x, skip_special_tokens=False),) for i, x in want.items()}


def test_bpe_on_random_texts(library):
    import random
    from roadpoints.llm.bpe_model import Model, PreTokens
    codec = bpe_codec.Codec(Model.read(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(2)
    texts = ["".join(rng.choice("aabthesinr \n\t1.,'é中ß😀<|>") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 999, " " * 70, "'s've'll'x 's \n's", "it's we've\n\n  x", "''s"]
    each, first, new = PreTokens(codec.model).numbers(texts)
    ids, count = codec.encode(new)
    end = count.cumsum()
    counts = token_counts.surviving(codec.model, new)
    assert (counts == count).all()
    for k, t in enumerate(texts):
        own = [x for p in each[first[k]:first[k + 1]] for x in ids[end[p] - count[p]:end[p]]]
        assert own == library.encode(t, add_special_tokens=False).ids


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PII = ["mail a.b@c.d@e.f.g x@y @z.de a@b..c p@q.r-", "1.2.3.4.5.6.7.8 256.1.1.1 999.0.0.1 1.2.3 010.20.030.4 1.1.1.1.", "4111 1111 1111 1111 4111-1111-1111-1112 5500000000000004", "+1 (377) 555-0271 +49.30.1234567 ++12 345 678 901 +1",
       "é中 x@y.de 😀 +4930123456789, 8.8.8.8", "+1 4111 1111 1111 1111 a@1.2.3.4", ""]


def test_pii_patterns():
    for t in PII:
        assert pii.find(t) == base_spans(t), t


def test_pii_terms(spark):
    rng_words = [f"word{k}" for k in range(300)]
    rows = [(k, " ".join(rng_words[(k * 7 + j) % 300] for j in range(30)), "en", "s", 0) for k in range(200)]
    rows += [(1000 + k, f"please write to Quixote here today {rng_words[k]} at q@mail.example.com now", "en", "s", 0) for k in range(6)]
    rows += [(2000, "Only quixote himself knows", "en", "s", 0), (2001, None, "en", "s", 0), (2002, "é quixote", "en", "s", 0)]
    found = pii.personal_data(frame(spark, rows, clashing=True))
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(rows)
    assert [(s["start"], s["end"]) for s in got[2000]["terms"] if s["start"] == 5] == [(5, 12)]
    assert [(s["start"], s["end"]) for s in got[2002]["terms"]] == [(2, 9)] and got[2001]["terms"] == []
    assert got[0]["terms"] == [] and len(got[1000]["spans"]) == 1
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, rows), found).collect()}
    assert "quixote" not in clean[2000].lower() and "[EMAIL]" in clean[1003] and "@" not in clean[1003]
    assert clean[0] == rows[0][1] and clean[2001] is None


def test_decontamination_of_rows(spark):
    """One row per row: equal ids with different texts, repeated rows and rows without an id are judged each by itself."""
    items = [(1, "one two three four"), (2, "five six seven eight")]
    rows = [(1, "one two three four"), (1, "five six seven eight"), (2, "x one two three four"), (2, "x one two three four"), (None, "five six seven eight"), (None, "clean"), (3, None)]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = [(i, *contaminated([(i, t)], items)[i]) for i, t in rows]
    assert sorted(((r["doc_id"], *(r[c] for c in COLS5)) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    none = frame(spark, [])
    tests = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for df in (minmax_dedup.near_duplicates(none), quality_rules.quality(none), line_dedup.dedup_passages(none), decontaminate.contamination(none, tests),
               token_counts.token_counts(none), bpe_codec.digests(none), pii.personal_data(none)):
        assert df.collect() == []


def test_pipeline(spark, tmp_path):
    """Every stage does on its input what its operator says, and keeps the columns of documents."""
    import corpus_pipeline as p
    rows = documents()
    frame(spark, clashing=True).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(rows[19][1].split()[:40]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = at[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encoded":
            assert docs.columns == list(p.COLUMNS)
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    kept = texts(at["quality"])
    assert {i for i, _ in kept} <= {i for i, t, *_ in rows if len(WORD.findall(t or "")) >= 50}
    lines = first_places(kept, line_dedup.MIN_WORDS)
    assert sorted((i, WORD.findall(t)) for i, t in texts(at["lines"])) == sorted((i, lines[i]) for i, _ in kept)
    top = smallest_linked(shingle_sets(texts(at["lines"])))
    assert {i for i, _ in texts(at["near_duplicates"])} == {i for i in top if top[i] == i}
    judged = contaminated(texts(at["near_duplicates"]), items)
    assert {i for i, _ in texts(at["contamination"])} == {i for i, v in judged.items() if not v[4]}
    assert sorted(r["doc_id"] for r in at["encoded"].collect()) == sorted(i for i, _ in texts(at["contamination"]))
    assert sorted(map(tuple, p.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, at["encoded"].collect()))
