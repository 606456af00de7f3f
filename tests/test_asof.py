"""As-of interpolation: one pass over a bucket in each order, and defined results of several samples at a time."""

import pytest

from nimbogrid.operators import timeops


@pytest.mark.parametrize("width", [None, 10.0])
def test_no_window_over_what_is_left(spark, width):
    src = spark.createDataFrame([(float(t), v) for t in (0, 5, 40) for v in (3.0, 1.0, 2.0)], "t double, v double")
    tgt = spark.createDataFrame([(t,) for t in (-1.0, 0.0, 2.5, 20.0, 20.0, 41.0)], "t double")
    out = timeops.asof_linear(tgt, src, "t", "v", width=width)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    # A frame that ends with the partition is gone through anew for each row: quadratic in a bucket's rows.
    assert "unboundedfollowing" not in plan
    got = sorted(((r["t"], r["prev"], r["next"], r["v"]) for r in out.collect()), key=str)
    one = 3.0 + (20.0 - 5.0) / 35.0 * (1.0 - 3.0)
    assert got == sorted([(-1.0, None, 1.0, None), (0.0, 3.0, 3.0, 3.0), (2.5, 3.0, 1.0, 2.0), (20.0, 3.0, 1.0, pytest.approx(one)), (20.0, 3.0, 1.0, pytest.approx(one)), (41.0, 3.0, None, None)], key=str)
