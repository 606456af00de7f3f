"""Sharding, extraction and the classifiers against independent computation or held-out rows of the given tables."""

import re
import zlib

import numpy as np
from fixtures import corpus, saved
from pyspark.sql import functions as F

from nimbogrid.llm import html_extraction, language_id, quality, sharding


def test_shards_are_equal_parts_of_the_sorted_line(spark, tmp_path):
    """The same shards from one sort of all rows by (hash of the text, doc_id), without samples or ranges."""
    rows = list(dict.fromkeys(corpus(8)))
    d = saved(spark, rows, tmp_path / "d")
    hashes = {r["doc_id"]: r["k"] for r in d.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    assert len(size) == len(rows)
    line, at, want = sorted((hashes[i], i) for i, _ in rows), 0, {}
    total = sum(size.values())
    for n, (_, i) in enumerate(line):
        middle = at + size[i] - (size[i] + 1) // 2
        want[i] = (min(15, middle * 16 // total), n)
        at += size[i]
    first = {}
    for s, n in want.values():
        first[s] = min(first.get(s, n), n)
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(d, rows_per_range=9).collect()}
    assert got == {i: (s, n - first[s]) for i, (s, n) in want.items()}


def test_pages_of_the_table(spark, sf):
    """The text of the article element, cut into blocks by other means than the parser's."""
    import html

    def article(page):
        body = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:p|h\d|ul|ol|li|div|table|tr|td|th|blockquote|pre|section|header|figure|figcaption|aside|form|dl|dt|dd)\b[^>]*>", body)
        text = [" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", x)).split()) for x in (re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", y, flags=re.S) for y in parts)]
        return "\n".join(x for x in (re.sub(r"\s+", " ", re.sub(r"<[^>]*>", "", t)).strip() for t in text) if x)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages).collect()}
    assert len(got) == len(want) and np.mean([got[i] == t for i, t in want.items()]) > 0.98


def test_held_out_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.op1(spark, "/root/testdata/sf0.01").collect()}
    held = [r for r in d.select("doc_id", "lang").collect() if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r["score"] for r in quality.op5(spark, sf).filter("held_out").collect()}
    good, bad = (np.array([s for i, s in got.items() if labels.get(i) == q]) for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and (good >= 0.7).mean() > 0.9 and (bad < 0.7).mean() > 0.7
