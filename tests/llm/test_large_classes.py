"""Classes of many contexts: shared parts found in several ranges of hashes are those found at once."""

import numpy as np
import pytest

from nimbogrid.llm.suffix_dedup import shared_parts


def contexts(n, seed=0):
    """Contexts round one anchor, with left and right sides out of a few of each, and some of their own."""
    rng = np.random.default_rng(seed)
    side = lambda k: rng.integers(97, 123, k).astype(np.uint8).tobytes()
    lefts, rights, anchor = [side(68) for _ in range(9)], [side(68) for _ in range(9)], side(32)
    out, shifts, classes = [], [], []
    for k in range(n):
        left = lefts[int(rng.integers(9))] if k % 3 else side(68)
        right = rights[int(rng.integers(9))] if k % 4 else side(68)
        cut = int(rng.integers(0, 40))
        out.append(left[cut:] + anchor + right)
        shifts.append(68 - cut)
        classes.append(k % 2)
    return classes, shifts, out


def brute(classes, shifts, texts, length):
    seen = {}
    for n, (c, s, t) in enumerate(zip(classes, shifts, texts, strict=True)):
        for at in range(len(t) - length + 1):
            seen.setdefault((c, s - at, t[at : at + length]), set()).add((n, at))
    out = [None] * len(texts)
    for places in seen.values():
        if len(places) > 1:
            for n, at in places:
                out[n] = (at, at) if out[n] is None else (min(out[n][0], at), max(out[n][1], at))
    return out


@pytest.mark.parametrize("most", [4_000_000, 2000, 333, 60])
def test_shared_parts(most):
    case = contexts(150)
    got, want = shared_parts(*case, 100, most), brute(*case, 100)
    # A clash of hashes may keep more, never less.
    assert all(w is None or (g is not None and g[0] <= w[0] and g[1] >= w[1]) for g, w in zip(got, want, strict=True))
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 1
    assert shared_parts([], [], [], 100, most) == []


def test_memory_of_a_large_class():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import resource, sys
sys.path.insert(0, 'tests/llm')
from test_large_classes import contexts
from nimbogrid.llm.suffix_dedup import shared_parts
case = contexts(150_000)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(shared_parts([0] * 150_000, *case[1:], 100)) == 150_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300, cwd=root, env={"PYTHONPATH": str(root), "PATH": "/usr/bin:/bin"})
    assert int(done.stdout) < 900
