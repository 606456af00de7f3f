"""The near stage: many texts that share a band, against comparison of all with all."""

import random
import time

import numpy as np
from fixtures import saved, text

from nimbogrid.llm import near_dedup


def naive(sets, similarity):
    gone = []
    for n, s in enumerate(sets):
        kept = [sets[k] for k in range(n) if not gone[k]]
        gone.append(any(len(np.intersect1d(s, k)) >= similarity * len(np.union1d(s, k)) - 1e-9 for k in kept))
    return gone


def test_rare_shingles_lose_no_pair():
    rng = np.random.default_rng(1)
    for similarity in (0.8, 0.5, 0.95, 1.0):
        for _ in range(30):
            base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
            sets = []
            for _ in range(25):
                own = rng.random(60) > rng.choice([0.0, 0.05, 0.1, 0.3])
                more = rng.integers(0, 1 << 62, int(rng.integers(0, 9)), dtype=np.uint64)
                sets.append(np.unique(np.r_[base[own], more, base[:1]]))
            assert near_dedup.later_by_rare_shingles(sets, similarity).tolist() == naive(sets, similarity)


def test_ten_thousand_texts_round_one_boilerplate():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 62, 50, dtype=np.uint64)
    sets = [np.unique(np.r_[shared, rng.integers(0, 1 << 62, 200, dtype=np.uint64)]) for _ in range(10_000)]
    sets[9_000] = np.unique(np.r_[sets[17][:240], sets[9_000][:10]])
    keys, members = np.zeros(len(sets), np.uint64), np.arange(len(sets))
    began = time.perf_counter()
    gone = near_dedup.later_copies(keys, members, sets, 0.8)
    assert np.flatnonzero(gone).tolist() == [9_000] and time.perf_counter() - began < 10


def test_planted_near_copies_are_found(spark, tmp_path):
    """Texts with one word in sixty changed, which leaves a similarity of about 0.85 of five-word shingles."""
    rng = random.Random(9)
    rows, pairs = [], 0
    for n in range(120):
        words = text(rng, "en", 30).split()
        rows.append((n, " ".join(words)))
        for k in range(0, len(words), 60):
            words[k] = f"changed{n}"
        rows.append((1000 + n, " ".join(words)))
        a, b = (set(near_dedup.shingle_set(t, 5).tolist()) for _, t in rows[-2:])
        pairs += len(a & b) / len(a | b) >= 0.8
    d = saved(spark, rows, tmp_path / "d")
    kept = near_dedup.keep_one_of_each(d).count()
    assert pairs > 100 and kept == len(rows) - pairs


def test_words_of_one_polynomial_hash_are_two():
    bits = [bin(k).count("1") & 1 for k in range(4096)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    rest = " one two three four five six"
    assert set(near_dedup.shingle_set(a + rest, 5).tolist()) != set(near_dedup.shingle_set(b + rest, 5).tolist())
