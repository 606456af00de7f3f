"""The local spline against a direct evaluation on random columns, those of two and three levels too."""

import numpy as np
import pytest

from nimbogrid.operators import regrid


def direct(z, v, s):
    m = np.diff(v) / np.diff(z)
    e = np.r_[0, 0, m, 0, 0].astype(float)  # slopes go on in a line beyond the ends
    first, last = (m[0], m[-1]) if len(m) < 2 else (2 * m[0] - m[1], 2 * m[-1] - m[-2])
    e[1], e[-2] = first, last
    e[0], e[-1] = 2 * first - m[0], 2 * last - m[-1]
    out = []
    t = np.empty(len(z))
    for n in range(len(z)):
        a, b, c, d = e[n : n + 4]
        wa, wb = abs(d - c), abs(b - a)
        t[n] = (b + c) / 2 if wa + wb < 1e-12 else (wa * b + wb * c) / (wa + wb)
    for n, h in enumerate(np.diff(z)):
        basis = (2 * s**3 - 3 * s**2 + 1, s**3 - 2 * s**2 + s, -2 * s**3 + 3 * s**2, s**3 - s**2)
        out.append((z[n] + s * h, float(np.dot(basis, (v[n], h * t[n], v[n + 1], h * t[n + 1])))))
    return out


@pytest.mark.parametrize("fraction", [0.5, 0.2])
def test_akima_is_the_direct_evaluation(spark, fraction):
    rng, columns = np.random.default_rng(9), {}
    for c, n in enumerate((2, 3, 4, 5, 9, 20)):
        columns[c] = np.cumsum(rng.uniform(0.5, 2, n)), np.where(rng.random(n) < 0.3, 1.0, rng.normal(0, 3, n))
    rows = [(c, float(z), float(v)) for c, (zs, vs) in columns.items() for z, v in zip(zs, vs, strict=True)]
    got = {}
    for r in regrid.akima(spark.createDataFrame(rows, "c int, z double, v double").repartition(3), ["c"], "z", "v", fraction).collect():
        got.setdefault(r["c"], []).append((r["at"], r["v"]))
    for c, (z, v) in columns.items():
        assert np.allclose(sorted(got[c]), direct(z, v, fraction), atol=1e-10)
