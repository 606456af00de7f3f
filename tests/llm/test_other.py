"""Language ID, sharding, quality, decontamination, extraction, packing, pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import corpus, frame, saved, text

from nimbogrid.llm import decontamination, html_extraction, language_id, packing, quality, sharding
from nimbogrid.llm.recurrent import ByteGRU

ROWS = corpus(1)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return saved(spark, ROWS, tmp_path_factory.mktemp("d") / "docs", extra=True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return saved(spark, [], tmp_path_factory.mktemp("e") / "docs")


def test_gru_gradients():
    net = ByteGRU(3, 4, 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(1, 256, (9, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.ones((9, 5))
    _, grad = net.gradients(x, y, w)
    for name, p in net.params.items():
        at = (3, int(x[3, 2])) if name[0] == "E" else (0, 0)
        keep, e = p[at], 1e-3
        p[at] = keep + e
        up = net.gradients(x, y, w)[0]
        p[at] = keep - e
        down = net.gradients(x, y, w)[0]
        p[at] = keep
        assert grad[name][at] == pytest.approx((up - down) / (2 * e), rel=0.02, abs=1e-5)


def test_language(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, 6), lang) for i in range(240) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, text(rng, "fr", 5), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(d, d.filter(~language_id.held_out()), rounds=150).collect()}
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0
    kept = language_id.keep_identified(d, d.filter(~language_id.held_out()), rounds=150)
    assert kept.columns == d.columns and kept.count() == 241
    nothing = d.filter("lang = 'xx'")
    assert {r["lang_pred"] for r in language_id.identify(d, nothing).collect()} == {"und"}
    assert language_id.identify(nothing, d, rounds=5).count() == 0


def test_long_texts_are_read_whole():
    net = ByteGRU(2, 4)
    a, b = "ab" * 5000, "ab" * 5000 + "zz" * 5000
    p = language_id.pooled(net, [a, b, None])
    assert not np.allclose(p[0], p[1]) and np.isnan(p[2]).all()


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, rows_per_range=7).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, size(t), zlib.crc32((t or "").encode())) for i, t in ROWS)
    total, largest = sum(size(t) for _, t in ROWS), max(size(t) for _, t in ROWS)
    by = Counter()
    for r in got:
        by[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert max(by.values()) <= total / 16 + largest
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_one_text(spark, tmp_path):
    """A single hot key is subdivided."""
    d = saved(spark, [(i % 50, "same text") for i in range(800)], tmp_path / "d")
    by = Counter(r["shard"] for r in sharding.shard_documents(d).collect())
    assert sorted(by) == list(range(16)) and max(by.values()) - min(by.values()) <= 1


def test_quality(spark, empty):
    rng = random.Random(3)
    good = [(i, text(rng, "en", 8)) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "###" for w in text(rng, "en", 6).split())) for i in range(60)]
    d = frame(spark, good + bad + [(5000, None), (5001, "")])
    trusted = frame(spark, good[:120]).select("doc_id")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(d, d, trusted).collect()}
    assert np.mean([got[i] >= 0.7 for i, _ in good]) > 0.95 and np.mean([got[i] < 0.7 for i, _ in bad]) > 0.9
    assert 0 <= got[5000] == got[5001] <= 1
    assert {r["score"] for r in quality.quality_scores(d, empty, trusted).collect()} == {0.5}
    assert quality.quality_scores(empty, d, trusted).count() == 0


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, (900, 2)), rng.normal(-2, 1, (300, 2))
    u = np.concatenate([rng.normal(2, 1, (700, 2)), n])
    assert quality.estimate_prior(p, rng.permutation(u)) == pytest.approx(0.7, abs=0.06)


def brute_matches(rows, items, similarity=0.8):
    import re

    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
    out = {}
    for n, item in items:
        w = words(item)
        if not w:
            continue
        k = min(5, len(w))
        sh = lambda v, k=k: Counter(b" ".join(v[i : i + k]) for i in range(len(v) - k + 1))
        own = sh(w)
        for i, t in rows:
            v = words(t)
            for s in range(len(v) - len(w) + 1):
                x = decontamination.weighted_similarity(own, sh(v[s : s + len(w)]))
                if x >= similarity:
                    out[i, n] = max(out.get((i, n), 0), x)
    return out


def test_decontamination(spark, docs, empty, tmp_path):
    rng = random.Random(4)
    items = [(n, text(rng, "en", rng.randint(2, 4))) for n in range(12)] + [(50, "short one"), (51, None), (52, "..."), (53, "short one")]
    rows = list(ROWS)
    for n in range(0, 12, 2):
        w = items[n][1].split()
        rows.append((7000 + n, text(rng) + " x" + " ".join(w).upper() + " " + text(rng)))
        w[len(w) // 2] = "changed"
        rows.append((7100 + n, text(rng) + " " + " ".join(w) + " " + text(rng)))
        rows.append((7200 + n, " ".join(w[: len(w) // 2])))
    rows.append((7300, "a Short  ONE here"))
    d, b = saved(spark, rows, tmp_path / "d"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(d, b).collect()}
    assert got == pytest.approx(brute_matches(rows, items)) and len(got) >= 6
    blocks = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(d, b, block_bytes=300).collect()}
    assert blocks == got
    clean = decontamination.decontaminate(d, b)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in got}
    none = b.filter("item_id = 51")
    assert decontamination.contaminated(d, none).count() == 0 and decontamination.contaminated(empty, b).count() == 0


def test_multi_index_misses_nothing():
    rng = np.random.default_rng(5)
    items = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    group = decontamination.Size(5, 20, list(range(30)), items)
    prints = np.array([v ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False))) for v in items for _ in range(20)], np.uint64)
    w, i = group.candidates(prints)
    want = np.argwhere(np.bitwise_count(prints[:, None] ^ items[None, :]) <= decontamination.RADIUS)
    assert sorted(zip(w.tolist(), i.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


@pytest.fixture(scope="module")
def labeller():
    return html_extraction.trained(700, 220)


def test_block_parser():
    b = html_extraction.blocks("<p>a &amp;amp; b<br>c<p>d <b>e</b> <a href='x>y'>f</a><script>var t='</p>';</script><!-- no --><ul><li>1<li>2</ul>tail < 3 &#233;")
    assert [x[0] for x in b] == ["a &amp; b c", "d e f", "1", "2", "tail < 3 é"]
    assert html_extraction.blocks(None) == [] and html_extraction.blocks("<<><p") == html_extraction.blocks("<<><p")
    assert html_extraction.blocks("<div" * 20000 + '"' * 2000) is not None


def test_extraction(spark, labeller):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Head</h1><p>First  part\n here.</p><p>Second &lt;part&gt;.</p></article><aside class="sidebar"><p>Other news.</p></aside><form><label>Mail</label><input></form><div class="comments"><p>Nice post.</p></div><footer>&copy; us</footer></body></html>'
    rows = [(1, "u1", page), (2, "u2", None), (3, None, ""), (4, "u4", "<nav>menu</nav>"), (1, "u1", page)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id as n_chars", "url as text")
    got = html_extraction.extract_pages(d.select("page_id", "url", "html"), labeller).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 5 and by[1]["text"] == "Head\nFirst part here.\nSecond <part>." and by[1]["n_chars"] == len(by[1]["text"])
    assert by[2]["text"] == by[3]["text"] == by[4]["text"] == ""
    assert html_extraction.extract_pages(d.limit(0), labeller).count() == 0


def test_labeller_on_unseen_pages(labeller):
    maker, right, n = html_extraction.PageMaker(77), 0, 0
    for _ in range(150):
        page, labels = maker.page()
        found = html_extraction.blocks(page)
        x, _ = html_extraction.padded([html_extraction.vectors(found)])
        y = labeller.forward(x, np.ones(x.shape[:2], np.float32))[:, 0] > 0
        right, n = right + int((y == np.array(labels)).sum()), n + len(labels)
    assert right / n > 0.97


def test_lstm_gradients():
    net = html_extraction.BlockLSTM(3, 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(1)
    x, mask, y = rng.normal(size=(6, 4, html_extraction.INPUT)) * 0.3, np.ones((6, 4)), rng.integers(0, 2, (6, 4)).astype(float)
    mask[4:, 2] = 0
    _, grad = net.gradients(x, mask, y)
    for name, p in net.params.items():
        at = (0,) * p.ndim
        keep, e = p[at], 1e-4
        p[at] = keep + e
        up = net.gradients(x, mask, y)[0]
        p[at] = keep - e
        down = net.gradients(x, mask, y)[0]
        p[at] = keep
        assert grad[name][at] == pytest.approx((up - down) / (2 * e), rel=0.02, abs=2e-5)


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=64, keep_ids=True).collect()
    memory = packing.WordTokenizer().memory
    by_doc = Counter()
    for i, t in ROWS:
        by_doc[i] += len(memory.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert by_doc == Counter({i: sum(r["length"] for r in got if r["doc_id"] == i) for i in by_doc})
    seqs = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["piece"] > 0:
            assert r["length"] == 64
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    lengths = sorted((r["length"] for r in got), reverse=True)
    bins = []
    for n in lengths:
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(64 - n)
    assert len(seqs) == len(bins)
    assert packing.pack(empty).count() == 0


def test_words_give_the_tokenizers_ids():
    rng = random.Random(6)
    parts = ["a", " ", "  ", "\n", " \n", "'s", "12", "é", "ß.", "\t", "!!", "<|endoftext|>", "x", "\x1c", "日本", " '", "\x0b", " ", " \t", "\x85", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    w = packing.WordTokenizer()
    want = [np.array(e.ids, "<u4").tobytes() for e in w.memory.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [w(t) for t in texts] == want


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(7)
    for _ in range(60):
        c = rng.choice([5, 16, 64])
        counts = {n: rng.choice([0, 0, 1, 3, 7]) for n in range(1, c + 1)}
        length, rank0, first, offset = packing.best_fit(counts, c)
        used: dict = {}
        keys = length << 44 | rank0
        for n, k in counts.items():
            for q in range(k):
                at = np.searchsorted(keys, n << 44 | q, side="right") - 1
                used.setdefault(int(first[at] + q - rank0[at]), []).append((int(offset[at]), n))
        for own in used.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= c


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = c.run(spark, sf)
    kept = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    import re

    norm = {i: re.sub(r"[\x20\x09-\x0d]+", "", t or "") for i, t in rows.items()}
    assert len({norm[i] for i in kept}) == len(kept)  # no two equal texts
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontamination.Index(items)
    assert not decontamination.matches([rows[i] for i in sorted(kept)], index, 0.8)
    dirty = {i for i, m in zip(sorted(rows), [decontamination.matches([rows[i]], index, 0.8) for i in sorted(rows)], strict=True) if m}
    lost = [i for i in rows if i not in kept and i not in dirty and norm[i] not in {norm[k] for k in kept}]
    assert len(lost) <= 4  # near duplicates only


def test_queries_equal_sql(spark, sf):
    from compare import connect, same

    from nimbogrid.llm.queries import ORACLES, QUERIES

    con = connect(sf)
    for name, sql in ORACLES.items():
        same(QUERIES[name](spark, sf), con, sql)
