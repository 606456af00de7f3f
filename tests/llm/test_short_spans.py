"""Substring deduplication of passages and texts of fewer than three clauses."""

import pytest
from fixtures import saved

from nimbogrid.llm import substring_dedup


def clause(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n))


@pytest.fixture(scope="module")
def removed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("s")
    two = f"{clause('a', 30)}. {clause('b', 32)}."
    rows = [
        (1, f"{clause('own', 9)}, {two} {clause('mine', 5)}."), (2, f"{clause('other', 7)}; {two} {clause('next', 6)}."),  # two whole clauses
        (3, clause("w", 128)), (4, clause("w", 128)), (5, clause("W", 128)),  # whole texts without a mark
        (6, f"{clause('x', 20)}. {clause('y', 5)}"), (7, f"{clause('x', 20)}. {clause('y', 5)}"),  # the short tail goes with the whole
        (8, f"{clause('漢', 20)}。{clause('p', 3)}、{clause('q', 9)}"), (9, f"{clause('r', 8)}！{clause('漢', 20)}。{clause('s', 9)}"),
        (10, "a few words."), (11, "a few words."), (12, None), (13, ""), (14, None),
        (15, f"{clause('z', 40)}. {clause('z', 40)}."),  # inside one document
    ]
    saved(spark, rows, folder / "documents.parquet")
    return dict(rows), {r["doc_id"]: r["n_removed"] for r in substring_dedup.op9(spark, str(folder)).collect()}


def test_two_whole_clauses(removed):
    rows, n = removed
    assert n[1] == 0 and n[2] == len(f" {clause('a', 30)}. {clause('b', 32)}.")


def test_whole_short_texts(removed):
    rows, n = removed
    assert n[3] == n[6] == 0
    assert all(n[k] == len(rows[k]) for k in (4, 5, 7))
    assert n[15] == len(f" {clause('z', 40)}.")


def test_marks_beyond_ascii(removed):
    rows, n = removed
    assert n[8] == 0 and n[9] == len(f"{clause('漢', 20)}。".encode())


def test_little_stays(removed):
    rows, n = removed
    assert all(n[k] == 0 for k in (10, 11, 12, 13, 14)) and set(n) == set(rows)


def test_no_span_twice():
    for t in (clause("a", 20), f"{clause('a', 20)}. b", f"a. {clause('b', 20)}", f"{clause('a', 9)}. {clause('b', 9)}", f"{clause('a', 20)}. b. c", f"{clause('a', 20)}. {clause('b', 20)}. {clause('c', 20)}."):
        h1, _, s, e = substring_dedup.spans(t, 3, 16, 16)
        assert len(h1) and len(set(zip(s.tolist(), e.tolist(), strict=True))) == len(h1)
