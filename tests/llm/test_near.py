"""Near duplicates of the pipeline at five-word similarity 0.8 against brute force."""

import random

import numpy as np
from fixtures import saved, text

import corpus_pipeline
from nimbogrid.llm import near_dedup, simhash_dedup
from nimbogrid.llm.common import Scratch


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def corpus():
    rng = random.Random(11)
    rows = []
    for n in range(40):
        w = text(rng, "en", 20).split()
        rows.append((10 * n, " ".join(w)))
        for k in (1, 2, 3, 4):  # words changed here and there: similarities on both sides of 0.8
            v = list(w)
            for at in rng.sample(range(len(v)), k):
                v[at] = f"changed{n}x{k}x{at}"
            rows.append((10 * n + k, " ".join(v)))
    rows += [(5000 + k, text(rng, "en", 20)) for k in range(40)] + [(6000, None), (6001, " "), (6002, "two words"), (6003, "Two  words"), (6004, "two others")]
    return rows


def test_stage_leaves_no_near_pair(spark, tmp_path):
    docs = saved(spark, corpus(), tmp_path / "d")
    order = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    stay = [t for i, t in order if i in kept]
    assert not [1 for k, a in enumerate(stay) for b in stay[:k] if similarity(a, b) >= 0.8]
    # what went is near an earlier text
    assert all(any(similarity(t, b) >= 0.8 for _, b in order[:k]) for k, (i, t) in enumerate(order) if i not in kept)
    assert 0 < len(order) - len(kept) and {5000 + k for k in range(40)} <= kept
    assert corpus_pipeline.near_stage(spark, docs.filter("doc_id < 0"), "").count() == 0


def test_bands_find_what_is_at_the_threshold():
    rng = random.Random(12)
    found = 0
    for _ in range(400):
        common, own = [rng.getrandbits(64) for _ in range(160)], [[rng.getrandbits(64) for _ in range(20)] for _ in range(2)]
        a, b = (np.unique(np.array(common + o, np.uint64)) for o in own)
        assert near_dedup.near(a, [b], 0.8).tolist() == [True] and near_dedup.near(a, [b], 0.801).tolist() == [False]
        found += bool((near_dedup.band_keys(a) == near_dedup.band_keys(b)).any())
    assert found == 400


def missed_by_bands():
    """Nine words and the first eight of them, a similarity of 0.8, of which no band agrees though the fingerprints do but for four bits."""
    return [[" ".join(f"w{n}" for n in range(at, at + size)) for size in (9, 8)] for at in (30158652, 39748898, 42608602)]


def test_simhash_finds_what_the_bands_miss(spark, tmp_path):
    pairs = missed_by_bands()
    for pair in pairs:
        a, b = (near_dedup.shingle_set(t, 5) for t in pair)
        assert near_dedup.near(a, [b], 0.8).all() and not (near_dedup.band_keys(a) == near_dedup.band_keys(b)).any()
        assert (simhash_dedup.majority(a) ^ simhash_dedup.majority(b)).bit_count() <= 4
    rows = [(2 * n + k, t) for n, pair in enumerate(pairs) for k, t in enumerate(pair)] + [(10, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    kept = corpus_pipeline.near_stage(spark, saved(spark, rows, tmp_path / "d"), "")
    assert sorted(r["doc_id"] // 2 for r in kept.collect()) == [0, 1, 2, 5]


def test_fingerprints_within_four_bits_share_a_key(spark, tmp_path):
    rng = random.Random(13)
    rows = [rng.getrandbits(64) for _ in range(200)]
    rows += [x ^ sum(1 << b for b in rng.sample(range(64), n % 8)) for n, x in enumerate(rows)] + rows[:5]
    prints = spark.createDataFrame([(n, x - (x >> 63 << 64)) for n, x in enumerate(rows)], "uid long, fp long")
    keys = {}
    for r in simhash_dedup.shared_keys(prints, Scratch(spark)).collect():
        keys.setdefault(r["uid"], set()).add(r["key"])
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a] ^ rows[b]).bit_count() <= 4:
                assert keys[a] & keys[b]
            elif a - b == 200:
                assert not keys.get(a, set()) & keys.get(b, set())
