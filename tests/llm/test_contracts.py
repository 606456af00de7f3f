"""Single points of the contracts, odd rows, and recall at the threshold."""

import random
import zlib

import numpy as np
import pytest
from fixtures import corpus, saved, text

from nimbogrid.llm import decontamination, html_extraction, language_id, packing, quality, sharding
from nimbogrid.llm.hashing import mix

ODD = [(None, "one two three"), (None, None), (8007, "one two three"), (8007, "one two three"), (8008, ""), (8009, "½ 12"), (8010, "x " * 60_000), (8011, "İİİ alpha beta")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return saved(spark, corpus(5) + ODD, tmp_path_factory.mktemp("o") / "docs", extra=True)


def test_letters_are_of_category_l(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, 5), lang) for i in range(60) for lang in [("en", "fr")[i % 2]]]
    rows += [(100, "12 ½ ² ⅷ", None), (101, "日本語", None), (102, "ªº 1", None), (103, "ただの日本語のテキストです。" * 9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = d.filter("lang IS NOT NULL")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d, learned, rounds=60).collect()}
    assert got[100] == "und" and "und" not in (got[101], got[102], got[103])
    kept = {r["doc_id"] for r in language_id.keep_identified(d, learned, rounds=60).collect()}
    assert not kept & {100, 101, 103} and len(kept & set(range(60))) >= 58


def test_every_label_is_learned(spark):
    rows = [(100 * k + i, f"{chr(97 + k % 26) * (2 + k // 26)} " * 20, f"l{k:03d}") for k in range(70) for i in range(3)]
    d = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, lang string")
    sample = language_id.labelled_sample(d, "lang", 2)
    assert {x for _, x in sample} == {f"l{k:03d}" for k in range(70)} and len(sample) > 120


def test_ids_are_those_of_a_fresh_tokenizer(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(9)
    parts = ["a", " ", "  ", "\n", "'s", "12", "é", "ß.", "!!", "<|endoftext|>", "<|endoftext", "|>", "word", " x"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(1000, "<|endoftext|>"), (None, None)]
    got = packing.pack(saved(spark, rows, tmp_path / "d"), keep_ids=True).collect()
    ids = {r["doc_id"]: r["ids"] for r in got}
    assert ids == {i: np.array([*fresh.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for i, t in rows}
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in got)


def test_nothing_else_is_dropped_from_an_article():
    page = "<article><p>Area <math><mi>x=2</mi></math> here</p><p><svg><text>label</text></svg> <object>plan</object> <noscript>still</noscript></p></article>"
    assert [b[0] for b in html_extraction.blocks(page)] == ["Area x=2 here", "label plan still"]


def test_deep_pages_take_time_in_proportion():
    n = 64_000
    found = html_extraction.blocks("<div>x" * n)
    assert len(found) == n and found[-1][1].depth == n
    assert html_extraction.vectors(found[:50]).shape == (50, html_extraction.INPUT)
    assert len(html_extraction.blocks("<p><b>x</div>" * n)) == n


def test_recall_at_the_threshold():
    """Windows whose weighted similarity to an item is just 0.8 or more, and the share of them that are candidates."""
    rng, found, n = np.random.default_rng(0), 0, 1500
    for _ in range(n):
        s = int(rng.integers(11, 60))
        item = rng.integers(0, 1 << 63, s, dtype=np.uint64)
        common = int(np.ceil(1.6 * s / 1.8))
        window = np.r_[item[:common], rng.integers(0, 1 << 63, s - common, dtype=np.uint64)]
        group = decontamination.Sizes(5, s, [0], [item])
        w, _ = group.candidates(window, mix(window ^ decontamination.OTHER), np.zeros(1, np.int64))
        found += len(w)
    assert found / n > 0.995


def test_offsets_are_of_the_original_text(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    t = "İİİ x, " + item.upper() + ", y İ"
    d = saved(spark, [(1, t), (None, item), (2, "İ " + item), (3, None)], tmp_path / "d", extra=True)
    b = spark.createDataFrame([(5, item), (6, "İİİ one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"]) for r in decontamination.contaminated(d, b).collect()}
    a = t.encode().index(b"ALPHA")
    assert got == {(1, 5): (a, a + len(item)), (None, 5): (0, len(item)), (2, 5): (3, 3 + len(item))}


def test_odd_rows(spark, odd):
    """Null ids, repeated rows, long texts and clashing names: a row for a row."""
    n = odd.count()
    rng = random.Random(2)
    learned = spark.createDataFrame([(i, text(rng, lang, 5), lang) for i in range(30) for lang in [("en", "de")[i % 2]]], "doc_id long, text string, lang string")
    named = language_id.identify(odd, learned, rounds=20).collect()
    assert len(named) == n and {r["lang_pred"] for r in named if r["doc_id"] in (8008, 8009)} == {"und"}
    ids = odd.select("doc_id").limit(30)
    scores = quality.quality_scores(odd, odd, ids).collect()
    assert len(scores) == n and all(0 <= r["score"] <= 1 for r in scores)
    same = [r["score"] for r in scores if r["doc_id"] == 8007]
    assert len(same) == 2 and same[0] == same[1]
    shards = sharding.shard_documents(odd).collect()
    assert len(shards) == n and sum(r["doc_id"] is None for r in shards) == 2
    packed = packing.pack(odd).collect()
    assert sum(r["piece"] == 0 for r in packed) == n
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    hits = decontamination.contaminated(odd, b).collect()
    assert sorted((r["doc_id"] or -1) for r in hits) == [-1, 8007, 8007]
    kept = decontamination.decontaminate(odd, b)
    assert kept.columns == odd.columns and kept.count() == n - 3


def test_extraction_of_clashing_columns(spark, tmp_path):
    d = spark.createDataFrame([(1, "u", "<article><p>Some text that is the article's own here.</p></article>")], "page_id long, url string, html string").selectExpr("*", "page_id AS text", "url AS n_chars")
    got = html_extraction.extract_pages(d, html_extraction.trained(300, 60)).collect()
    assert len(got) == 1 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_empty_tables_go_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(3)
    some = [(i, text(rng, "en", 6), "en", "s", 1) for i in range(12)]
    for k, (rows, items) in enumerate([([], [(1, "one two")]), (some, [])]):
        folder = tmp_path / str(k)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(folder)).select("doc_id").collect()} == {r[0] for r in rows}
