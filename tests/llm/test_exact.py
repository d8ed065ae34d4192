"""Exact duplicates: fingerprints, their collisions, and the edges."""

import random
from collections import defaultdict

import pytest

from attrium.llm import exact


def brute(rows):
    """doc_id, keep_id, group_size of each row, and how many rows stay of each text."""
    same = defaultdict(list)
    for i, t in rows:
        same[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in same.items()}
    return sorted((repr(i), repr(keep[t or ""]), len(same[t or ""])) for i, t in rows)


def checked(spark, rows):
    found = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((repr(r["doc"]["doc_id"]), repr(r["keep_id"]), r["group_size"]) for r in found) == brute(rows)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len({t or "" for _, t in rows}) == len({r["doc"]["text"] or "" for r in kept})
    assert all(r["doc"]["doc_id"] == r["keep_id"] for r in kept)


def polynomial(text, b):
    h = 0
    for c in text:
        h = (h * b + c) % exact.PRIME
    return h


def test_chunks_compose():
    rng = random.Random(3)
    whole = rng.randbytes(3 * exact.BLOCK + 77)
    h = exact.Hash(0)
    assert h.of(whole) == [polynomial(whole, b) for b in h.bases]
    for cuts in ([100], [0, exact.BLOCK, 2 * exact.BLOCK + 5], [1, 2, 3, 20_000]):
        ends = [*cuts, len(whole)]
        parts = [h.shifted(whole[a:b], len(whole) - b) for a, b in zip([0, *cuts], ends, strict=True)]
        assert [sum(p) % exact.PRIME for p in zip(*parts, strict=True)] == h.of(whole)


TEXTS = ["abc", "acb", "bac", "", None, "x" * 40 + "ab", "x" * 40 + "ba", "ü" * 50, "\0a", "a", "a\0", " a", "abc "]


@pytest.mark.parametrize("sent", [exact.SENT, 0])
def test_texts_whose_fingerprints_meet_are_told_apart(spark, monkeypatch, sent):
    """With bases of one, texts of the same bytes in another order have one fingerprint."""
    real = exact.bases
    monkeypatch.setattr(exact, "bases", lambda turn: [1] * exact.BASES if turn < 2 else real(turn))
    monkeypatch.setattr(exact, "CHUNK", 16)
    monkeypatch.setattr(exact, "SENT", sent)
    rng = random.Random(1)
    checked(spark, [(i, rng.choice(TEXTS)) for i in range(60)] + [(None, "abc"), (None, "q"), (None, "q"), (3, "acb"), (3, "acb")])


def test_long_texts_and_copies(spark):
    long = "wörter " * 30_000
    checked(spark, [(i, long) for i in range(5)] + [(9, long[:-1] + "."), (10, "." + long[1:]), (11, long + " ")] + [(100 + i, "copied") for i in range(500)])


def test_edges(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    names = "doc_id long, text string, doc string, row int, n map<string,int>, keep_id int, s0 long"
    rows = [(1, "t", "d", 5, {"a": 1}, None, 2), (2, "t", None, None, None, 7, None)]
    found = exact.exact_duplicates(spark.createDataFrame(rows, names)).orderBy("doc.doc_id").collect()
    assert [tuple(r["doc"]) for r in found] == rows and [(r["keep_id"], r["kept"]) for r in found] == [(2, False), (2, True)]
