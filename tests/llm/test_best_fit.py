"""Rounds over runs of equal gaps against best fit of one piece after another."""

import random

import numpy as np
import pytest

from nimbogrid.llm import packing


def naive(counts, capacity):
    """Sorted gaps: each piece, longest first, goes into the smallest gap that holds it."""
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - n)
            else:
                gaps.append(capacity - n)
    return sorted(gaps)


def placed(counts, capacity):
    length, rank0, first, offset = packing.best_fit(counts, capacity)
    keys, used = length << 44 | rank0, {}
    for n, k in counts.items():
        for q in range(k):
            at = np.searchsorted(keys, n << 44 | q, side="right") - 1
            assert length[at] == n
            used.setdefault(int(first[at] + q - rank0[at]), []).append((int(offset[at]), n))
    for own in used.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
    assert set(used) == set(range(len(used)))
    return sorted(capacity - sum(n for _, n in own) for own in used.values())


@pytest.mark.parametrize("capacity", [5, 10, 16, 64, 257])
def test_gaps_are_those_of_best_fit(capacity):
    rng = random.Random(capacity)
    for _ in range(80):
        counts = {n: rng.choice([0, 0, 0, 1, 2, 3, 7, 19]) for n in range(1, capacity + 1) if rng.random() < 20 / capacity + 0.2}
        assert placed(counts, capacity) == naive(counts, capacity)


def test_the_fullest_sequence_is_filled_first():
    assert placed({3: 7}, 10) == [1, 1, 7] and placed({}, 10) == [] and placed({10: 2}, 10) == [0, 0]


def test_a_round_of_many_lengths_is_quick():
    """Two thousand lengths of up to a hundred thousand pieces: what the driver does for any amount of data."""
    import time

    rng = random.Random(1)
    counts = {n: rng.randrange(100_000) for n in range(1, 2049)}
    began = time.perf_counter()
    packing.best_fit(counts, 2048)
    assert time.perf_counter() - began < 20
