"""Row identity, hot groups and salted groups give the same results as the plain case."""

import random

import pytest
from fixtures import corpus, saved, text
from test_dedup import brute_bytes, ordered

from nimbogrid.llm import covered, exact_dedup, near_dedup, simhash_dedup, substring_dedup, suffix_dedup
from nimbogrid.llm.hashing import slabs


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(21)
    passage = text(rng, "en", 6)
    rows = corpus(3) + [(9000 + i, f"{text(rng, 'de', 2)} {passage} {text(rng, 'fr', 2)}") for i in range(40)]
    return saved(spark, rows, tmp_path_factory.mktemp("d") / "docs", extra=True)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "make",
    [exact_dedup.keep_distinct, near_dedup.keep_one_of_each, simhash_dedup.keep_one_of_each, lambda d: suffix_dedup.suffix_dedup(d), lambda d: substring_dedup.substring_dedup(d, short_words=16)],
    ids=["exact", "near", "simhash", "suffix", "substring"],
)
def test_cores_may_change_between_planning_and_reading(spark, docs, make):
    name = "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set(name, "1")
        want = rows_of(make(docs))
        result = make(docs)
        spark.conf.set(name, "7")
        assert rows_of(result) == want and len(want) > 50
    finally:
        spark.conf.unset(name)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_hot_classes_and_salted_groups_of_strings(docs, monkeypatch, sent):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_SENT", sent)
    monkeypatch.setattr(suffix_dedup, "SALTED", 1)
    got = suffix_dedup.suffix_dedup(docs)
    assert sorted(tuple(r) for r in got.collect()) == brute_bytes(ordered(docs))


def test_salted_groups_of_spans(docs, monkeypatch):
    want = rows_of(substring_dedup.substring_dedup(docs, short_words=16))
    monkeypatch.setattr(substring_dedup, "SLABS", 1)
    monkeypatch.setattr(substring_dedup, "SLAB", 20_000)
    assert len(list(slabs(["x" * 9000] * 9, substring_dedup.SLAB))) > 2
    assert rows_of(substring_dedup.substring_dedup(docs, short_words=16)) == want


def test_batches_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    d = saved(spark, [(i, "x" * (1 << 20)) for i in range(12)] + [(50, None)], tmp_path / "d").coalesce(1)
    from nimbogrid.llm.common import Scratch

    held = covered.number_batches(d, Scratch(spark), "doc_id", "text")
    by = {}
    for r in held.select("uid", "n_bytes").collect():
        by.setdefault(r["uid"] // covered.BATCH_ROWS, []).append(r["n_bytes"])
    assert len(by) == 3 and max(map(sum, by.values())) <= covered.BATCH_BYTES


def test_passage_inside_text_without_marks(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n: " ".join(text(rng, "en", 1).rstrip(".").lower().split()[0] + str(rng.randrange(100)) for _ in range(n))
    passage = words(60)
    rows = [(1, f"{words(70)} {passage} {words(50)}"), (2, f"{words(45)} {passage} {words(80)}"), (3, words(150))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(saved(spark, rows, tmp_path / "d"), short_words=16).collect()}
    assert got[1] == got[3] == 0 and len(passage) * 0.5 < got[2] <= len(passage) + 1
