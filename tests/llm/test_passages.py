"""Repeated passages against a brute force over word spans."""

import random

import pytest
from cases import WORD, documents, first_places, frame, prose, sentences

from roadpoints.llm import line_dedup

def passages():
    """A passage inside sentences, in lists without sentence ends, in a headline, at text ends, twice in one text, and periodic texts."""
    rng = random.Random(5)
    fresh = lambda n: prose(rng, n, 10**6)
    p, q = fresh(55), fresh(31)
    rows = [(1, " ".join(fresh(9) + p + fresh(7)) + ". " + " ".join(fresh(20)) + "."), (2, " ".join(fresh(12) + p + fresh(3)) + "! " + " ".join(fresh(40))),
            (3, " | ".join(fresh(5) + p + fresh(5))), (4, " | ".join(fresh(2) + p)), (5, "\n".join(p[:20]) + "\n" + " ".join(p[20:] + fresh(4))), (6, " ".join(p)),
            (7, " ".join(fresh(3) + q + fresh(3) + q + fresh(2))), (8, " ".join(q[:30])), (9, " ".join(q[:29])), (10, "a b c " * 60), (11, "x " + "b c a " * 40), (12, "z " * 31), (13, "z " * 200),
            (14, sentences(p[:29] + fresh(10) + q[1:] + p[25:])), (15, " ".join(fresh(4) + p[:40] + q + p[10:]))]
    for k in range(40):  # pieces of one text, put together again
        a, b = sorted(rng.randrange(56) for _ in range(2))
        rows.append((100 + k, sentences(fresh(rng.randrange(6)) + p[a:b] + q[rng.randrange(5):] + fresh(rng.randrange(6)) + p[b:], rng.randrange(5, 40))))
    return [(i, t, None, None, len(t)) for i, t in rows]


@pytest.mark.parametrize("made", [passages, documents])
def test_passages(spark, made):
    rows = made()
    want = first_places(rows, line_dedup.MIN_WORDS)
    got = line_dedup.dedup_passages(frame(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert WORD.findall(r["text"] or "") == want[r["doc_id"]]
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r["text"] is None) == (text[r["doc_id"]] is None)
        if len(want[r["doc_id"]]) == len(WORD.findall(text[r["doc_id"]] or "")):
            assert r["text"] == text[r["doc_id"]] and r["n_removed"] == 0


def test_query_removes_passages(spark, tmp_path):
    rows = passages()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = first_places(rows, line_dedup.MIN_WORDS)
    assert {r["doc_id"]: WORD.findall(r["text"] or "") for r in line_dedup.op1(spark, str(tmp_path)).collect()} == want


def test_rows_of_one_id(spark):
    """Rows of one doc_id with different texts, repeated rows and rows without an id: nothing unique is lost, no row is left out."""
    rng = random.Random(6)
    p, q, r, s = (" ".join(prose(rng, 60, 10**6)) for _ in range(4))
    rows = [(1, p), (2, p), (2, q), (3, r), (3, r), (None, s), (None, f"{s} tail"), (None, p), (None, None), (4, None), (4, "")]
    got = line_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    found = sorted(((x["doc_id"], x["text"]) for x in got if x["doc_id"] is not None), key=str)
    assert found == sorted([(1, p), (2, ""), (2, q), (3, r), (3, r), (4, None), (4, "")], key=str)
    left = sorted(x["text"] for x in got if x["doc_id"] is None and x["text"] is not None)
    assert left in (sorted(["", s, "tail"]), sorted(["", "", f"{s} tail"]))


def test_no_rows(spark):
    assert line_dedup.dedup_passages(frame(spark, [])).collect() == []


def test_line_counts(spark):
    rows = [(1, "one. two! three\n\n four?  \n. five"), (2, " \n\t "), (3, None), (4, "a.b c. d")]
    got = line_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_lines"] for r in got} == {1: 6, 2: 0, 3: 0, 4: 2}
