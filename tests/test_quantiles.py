"""Quantiles by bins against sorted values."""

import math

import numpy as np
import pytest

from nimbogrid.operators import stats


def brute(rows, f):
    out = {}
    for k, v in rows:
        out.setdefault(k, []).append(v)
    result = {}
    for k, vs in out.items():
        s = sorted(v for v in vs if v is not None and not math.isnan(v))
        result[k] = (len(s), *[s[max(1, math.ceil(round(q * len(s), 9))) - 1] if s else None for q in f])
    return result


@pytest.mark.parametrize(("bins", "passes"), [(1024, 3), (4, 1), (3, 2)])
def test_quantiles_are_those_of_sorted_values(spark, bins, passes):
    rng = np.random.default_rng(7)
    rows = [("wide", float(v)) for v in rng.lognormal(0, 8, 300)] + [("ties", float(v)) for v in rng.integers(0, 4, 200)] + [("one", 2.5), (None, -1.0), (None, 3.0), ("none", None)]
    rows += [("near", 1.0 + n * 2**-50) for n in range(40)] + [("near", -1e300), ("near", float("nan")), ("ties", None)]
    f = {"least": 0.0, "low": 0.1, "median": 0.5, "high": 0.99, "most": 1.0}
    got = stats.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", f, bins, passes).collect()
    assert {r["k"]: (r["n"], *[r[c] for c in f]) for r in got} == brute(rows, f.values())


def test_quantiles_without_keys_and_rows(spark):
    d = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    assert [tuple(r) for r in stats.quantiles(d, [], "v", {"q": 0.25}).collect()] == [(101, 25.0)]
    assert [tuple(r) for r in stats.quantiles(d.limit(0), [], "v", {"q": 0.25}).collect()] == [(0, None)]
