"""Tridiagonal systems in blocks against elimination in one go."""

import numpy as np
import pytest

from nimbogrid.operators import tridiagonal
from nimbogrid.operators.regrid import thomas


def systems(rng, n, left_out=0.0):
    low, high, rhs = rng.normal(size=(3, n))
    mid = 2 + np.abs(low) + np.abs(high)
    index = np.flatnonzero(rng.random(n) >= left_out)
    return index, low, mid, high, rhs


@pytest.mark.parametrize(("n", "block", "left_out"), [(1, 8, 0), (2, 8, 0), (8, 8, 0), (9, 8, 0), (17, 8, 0), (300, 8, 0), (300, 4, 0.6), (10_000, 64, 0), (10_000, 1024, 0.01)])
def test_blocks_are_one_elimination(spark, n, block, left_out):
    rng = np.random.default_rng(n + block)
    want, rows = {}, []
    for key in ("a", "b"):
        index, *v = systems(rng, n, left_out)
        low, mid, high, rhs = (x[index] for x in v)
        if len(index):
            want |= {(key, int(i)): x for i, x in zip(index, thomas(low, mid, high, rhs), strict=True)}
        rows += [(key, int(i), *map(float, r)) for i, *r in zip(index, low, mid, high, rhs, strict=True)]
    d = spark.createDataFrame(rows, "key string, i int, low double, mid double, high double, rhs double").repartition(4)
    got = {(r["key"], r["i"]): r["x"] for r in tridiagonal.solve(d, ["key"], "i", n, block).collect()}
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)


def test_coefficients_of_zero_and_no_rows(spark):
    d = spark.createDataFrame([(i, 0.0, 2.0, 0.0, float(i)) for i in range(20)], "i long, low double, mid double, high double, rhs double")
    assert {r["i"]: r["x"] for r in tridiagonal.solve(d, [], "i", 20, 4).collect()} == {i: i / 2 for i in range(20)}
    assert tridiagonal.solve(d.limit(0), [], "i", 20, 4).count() == 0


def test_heat_conduction_in_one_step(spark):
    """An implicit step of diffusion keeps the sum where nothing leaves at the ends."""
    n, k = 500, 3.0
    rng = np.random.default_rng(1)
    t = rng.normal(size=n)
    rows = [(i, -k if i else 0.0, 1 + k * ((i > 0) + (i < n - 1)), -k if i < n - 1 else 0.0, float(t[i])) for i in range(n)]
    d = spark.createDataFrame(rows, "i int, low double, mid double, high double, rhs double")
    got = np.array([r["x"] for r in tridiagonal.solve(d, [], "i", n, 16).orderBy("i").collect()])
    assert got.sum() == pytest.approx(t.sum()) and got.std() < t.std()
    full = np.diag([r[2] for r in rows]) + np.diag([-k] * (n - 1), 1) + np.diag([-k] * (n - 1), -1)
    assert np.allclose(got, np.linalg.solve(full, t))
