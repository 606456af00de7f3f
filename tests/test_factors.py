"""Interpolation factors in three dimensions: against horizontal after vertical interpolation; the stored table is not shuffled."""

import numpy as np
import pytest

from nimbogrid.operators import factors


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(6)
    heights = [(s, k, float(h)) for s in range(12) for k, h in enumerate(np.cumsum(rng.uniform(1, 3, 6)))]
    horizontal = [(t, int(s), float(w)) for t in range(9) for s, w in zip(rng.choice(12, 3, replace=False), rng.dirichlet([1, 1, 1]), strict=True)]
    targets = [(t, m, float(a)) for t in range(9) for m, a in enumerate(rng.uniform(0, 16, 4))] + [(0, 9, heights[0][2])]
    values = [(s, k, float(rng.normal()), float(rng.normal()) if rng.random() > 0.1 else None) for s in range(12) for k in range(6)]
    make = spark.createDataFrame
    return {
        "h": horizontal, "t": targets, "z": heights, "v": values,
        "frames": (make(horizontal, "target int, source int, w double"), make(targets, "target int, to int, at double"), make(heights, "source int, level int, height double")),
        "values": make(values, "source int, level int, u double, q double").repartition(3),
    }


def brute(case, field, clamp, least):
    z, v = {}, {}
    for s, k, h in case["z"]:
        z.setdefault(s, []).append(h)
    for row in case["v"]:
        v[row[0], row[1]] = row[2 + field]
    out = {}
    for t, m, at in case["t"]:
        total, known, met = 0.0, 0.0, False
        for tt, s, w in case["h"]:
            if tt != t or not (clamp or z[s][0] <= at <= z[s][-1]):
                continue
            met = True
            k = int(np.clip(np.searchsorted(z[s], at, "right") - 1, 0, 4))
            f = float(np.clip((at - z[s][k]) / (z[s][k + 1] - z[s][k]), 0, 1))
            for kk, ff in ((k, 1 - f), (k + 1, f)):
                if ff > 0 and v[s, kk] is not None:
                    total, known = total + w * ff * v[s, kk], known + w * ff
        if met:
            out[t, m] = total / known if known >= least - 1e-9 and known else None
    return out


@pytest.mark.parametrize(("clamp", "least"), [(False, 1.0), (True, 1.0), (True, 0.4)])
def test_factors_are_horizontal_after_vertical(spark, case, tmp_path, clamp, least):
    table = factors.factors(*case["frames"], "target", "source", "level", "height", clamp=clamp)
    assert clamp is False or all(abs(r["s"] - 1) < 1e-12 for r in table.groupBy("target", "to").agg({"w": "sum"}).withColumnRenamed("sum(w)", "s").collect())
    name = f"factors_{int(clamp)}_{int(10 * least)}"
    factors.store(table, name, f"file://{tmp_path}/t", "source", "level", 8)
    got = factors.apply(spark, name, case["values"], "target", "to", "source", "level", ["u", "q"], least=least).collect()
    for n, field in enumerate("uq"):
        want = brute(case, n, clamp, least)
        mine = {(r["target"], r["to"]): r[field] for r in got}
        assert set(mine) == set(want)
        assert all(want[c] is None and mine[c] is None or mine[c] == pytest.approx(want[c], abs=1e-12) for c in want)
    spark.sql(f"DROP TABLE {name}")


def test_the_stored_table_has_no_exchange(spark, case, tmp_path):
    factors.store(factors.factors(*case["frames"], "target", "source", "level", "height"), "factors_plan", f"file://{tmp_path}/t", "source", "level", 8)
    d = factors.apply(spark, "factors_plan", case["values"], "target", "to", "source", "level", ["u"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = factors.apply(spark, "factors_plan", case["values"], "target", "to", "source", "level", ["u"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # Below the join only the values move; the table is read by its buckets.
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in join and "Exchange" not in join[join.rindex("Sort [") :], plan
    assert d.count() > 0
    spark.sql("DROP TABLE factors_plan")
