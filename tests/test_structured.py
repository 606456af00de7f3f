"""Nearest points of structured grids against all distances; a parent model's fields on a child grid."""

import math
import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nimbogrid.operators import external, parent, regrid, structured


def curved(ni, nj):
    """Whole coordinates of a curved grid with repeated distances."""
    return {(i, j): (10 * i + j * j // 4, 8 * j + i * i // 6) for i in range(ni) for j in range(nj)}


def frame(spark, places, names="x double, y double"):
    return spark.createDataFrame([(i, j, *map(float, p)) for (i, j), p in places.items()], f"i int, j int, {names}")


def brute(points, places, k, limit=None):
    out = {}
    for t, p in points.items():
        d = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), *ij) for ij, q in places.items())
        out[t] = [(i, j, math.sqrt(x)) for x, i, j in d[:k] if limit is None or x <= limit**2]
    return {t: v for t, v in out.items() if v}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["cell"], r["rank"])):
        out.setdefault(r["cell"], []).append((r["i"], r["j"], r["dist"]))
    return out


@pytest.mark.parametrize(("k", "fan", "limit"), [(1, 8, None), (5, 3, None), (4, 2, None), (7, 8, 25.0)])
def test_nearest_is_that_of_all_distances(spark, k, fan, limit):
    places, rng = curved(40, 31), np.random.default_rng(k)
    for gone in list(places)[:: 11 + k]:  # holes
        del places[gone]
    points = {n: (float(a), float(b)) for n, (a, b) in enumerate(rng.integers(-100, 700, (60, 2)))} | {100: tuple(map(float, list(places.values())[500])), 101: (1e6, -1e6)}
    targets = spark.createDataFrame([(t, *p) for t, p in points.items()], "cell long, x double, y double")
    assert got(structured.nearest(targets, frame(spark, places), k, fan=fan, limit=limit)) == brute(points, places, k, limit)


def test_nearest_odd_cases(spark):
    targets = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 5.0, 5.0)], "cell long, x double, y double")
    few = {(0, 0): (0, 0), (100000, -70000): (3, 4)}
    grid = frame(spark, few).unionByName(spark.createDataFrame([(5, 5, None, 1.0)], "i int, j int, x double, y double"))
    assert got(structured.nearest(targets, grid, 9)) == brute({1: (0.0, 0.0), 3: (5.0, 5.0)}, few, 9)
    assert structured.nearest(targets, grid.limit(0), 2).count() == 0
    assert structured.nearest(targets.limit(0), grid, 2).count() == 0
    same = {(i, j): (1, 1) for i in range(12) for j in range(12)}  # all at one distance: by (i, j)
    assert got(structured.nearest(targets, frame(spark, same), 3, fan=2)) == brute({1: (0.0, 0.0), 3: (5.0, 5.0)}, same, 3)
    with pytest.raises(ValueError):
        structured.nearest(targets, grid, 0)


def test_nearest_on_the_sphere_goes_over_the_date_line(spark):
    grid = spark.range(0, 36 * 17).select((F.col("id") % 36).cast("int").alias("i"), F.floor(F.col("id") / 36).cast("int").alias("j"))
    grid = structured.sphere(grid.withColumns({"lon": F.col("i") * 10.0 - 180, "lat": F.col("j") * 10.0 - 80}))
    targets = structured.sphere(spark.createDataFrame([(1, 178.0, 1.0), (2, -10.0, 89.0)], "cell long, lon double, lat double"))
    near = got(structured.nearest(targets, grid, 2, axes=("sx", "sy", "sz"), fan=4))
    assert [p[:2] for p in near[1]] == [(0, 8), (35, 8)]
    assert [p[:2] for p in near[2]] == [(17, 16), (16, 16)] or [p[:2] for p in near[2]] == [(17, 16), (18, 16)]


def far_and_near(rng, n):
    """Places close together, a few far away and some far apart, more than once."""
    some = np.r_[rng.integers(0, 400, (n, 2)), rng.integers(-90_000, 90_000, (n // 20, 2)), [[10**9, 5], [-(10**9), 5]]]
    return some[rng.integers(0, len(some), 12 * n)].astype(float)


@pytest.mark.parametrize(("n", "k", "fan", "limit"), [(1800, 4, 8, None), (100, 100, 8, None), (300, 3, 2, 60.0)])
def test_many_targets_share_a_search(spark, n, k, fan, limit):
    """Targets at many places and more than once; one by one, 15,000 searches on sf0.1 had not ended within about 50 s."""
    rng, places = np.random.default_rng(k), curved(60, 50)
    line = np.array([(*ij, *p) for ij, p in sorted(places.items())], float)
    points = far_and_near(rng, n)
    targets = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(points)), "x": points[:, 0], "y": points[:, 1]}))
    grid = spark.createDataFrame(pd.DataFrame(line, columns=["i", "j", "x", "y"]).astype({"i": int, "j": int}))
    began = time.perf_counter()
    out = structured.nearest(targets, grid, k, fan=fan, limit=limit).toPandas().sort_values(["cell", "rank"])
    assert time.perf_counter() - began < 45
    d = (points[:, 0, None] - line[:, 2]) ** 2 + (points[:, 1, None] - line[:, 3]) ** 2
    first = np.argsort(d, axis=1, kind="stable")[:, :k]
    d = np.take_along_axis(d, first, axis=1)
    cell, rank = np.nonzero(d <= (math.inf if limit is None else limit**2))
    want = [cell, line[first[cell, rank], 0], line[first[cell, rank], 1], np.sqrt(d[cell, rank]), rank + 1]
    assert len(cell) and all(np.array_equal(out[c].to_numpy(), w) for c, w in zip(("cell", "i", "j", "dist", "rank"), want, strict=True))


def test_a_run_holds_few_nodes():
    """1,024 places over 4,096 nodes: each run holds a few, and no node is lost that is nearest to a place."""
    rng = np.random.default_rng(3)
    low = np.array([(10.0 * a, 10.0 * b) for a in range(64) for b in range(64)])
    own = rng.uniform(0, 640, (1024, 2))
    own = own[np.lexsort((own[:, 1], own[:, 0] // 20))]
    pairs = np.zeros(len(low), np.int64), np.arange(len(low))
    spans, group, node = structured._pruned(own, np.array([[0, 1024]]), *pairs, np.full(len(low), 9), low, low + 9, 4, np.inf, 16)
    assert sorted(n for a, b in spans.tolist() for n in range(a, b)) == list(range(1024))
    held = np.bincount(group)
    assert held.max() <= 32 and len(held) == len(spans)
    for g, (a, b) in enumerate(spans.tolist()):
        for p in own[a:b]:
            gap = np.maximum(np.maximum(low - p, p - low - 9), 0)
            assert np.argmin((gap**2).sum(axis=1)) in node[group == g]


def test_weights(spark):
    places = curved(9, 9)
    targets = spark.createDataFrame([(1, *map(float, places[4, 4])), (2, 33.0, 17.0)], "cell long, x double, y double")
    rows = structured.nearest_weights(targets, frame(spark, places), 3, 2.0).collect()
    assert {(r["i"], r["j"]): r["w"] for r in rows if r["cell"] == 1 and r["w"] > 0} == {(4, 4): 1.0}
    two = [r for r in rows if r["cell"] == 2]
    total = sum(r["dist"] ** -2 for r in two)
    assert all(r["w"] == pytest.approx(r["dist"] ** -2 / total) for r in two)


def warped(ni, nj):
    return {(i, j): (i + 0.2 * math.sin(j), j + 0.15 * math.cos(i) + 0.1 * i) for i in range(ni) for j in range(nj)}


def test_index_in_a_curved_grid(spark):
    """The bilinear map of the index that is found gives the point."""
    places, rng = warped(12, 10), np.random.default_rng(4)
    points = {n: (float(a), float(b)) for n, (a, b) in enumerate(zip(rng.uniform(1, 10, 80), rng.uniform(2.5, 8, 80), strict=True))}
    p = spark.createDataFrame([(n, *v) for n, v in points.items()], "row int, x double, y double")
    found = {r["row"]: (r["ri"], r["rj"]) for r in regrid.curvilinear_index(p, frame(spark, places, "gx double, gy double"), "row", "x", "y", "i", "j", 1.5).collect()}
    assert set(found) == set(points)
    for n, (ri, rj) in found.items():
        i, j = min(int(ri + 1e-9), 10), min(int(rj + 1e-9), 8)
        a, b = ri - i, rj - j
        for c in (0, 1):
            v = (1 - a) * (1 - b) * places[i, j][c] + a * (1 - b) * places[i + 1, j][c] + (1 - a) * b * places[i, j + 1][c] + a * b * places[i + 1, j + 1][c]
            assert v == pytest.approx(points[n][c], abs=1e-9)


@pytest.fixture(scope="module")
def case(spark):
    """A warped parent with terrain-following levels, read through its names; child points with two levels each."""
    ni, nj, nk, places = 12, 10, 6, warped(12, 10)
    z = {(i, j, k): 100.0 * k + 5 * ((i + j) % 3) for i, j in places for k in range(nk)}
    rows = []
    for (i, j), (x, y) in places.items():
        for k in range(nk):
            for var, v in (("HGT", z[i, j, k]), ("T", 280 + 2 * x - y + 0.01 * z[i, j, k] - 273.15), ("Q", 7.0), ("U", 3.0), ("V", 4.0)):
                rows.append(("p", var, [k, j, i], v))
    values = spark.createDataFrame(rows, "path string, var string, index array<int>, value double")
    names = {"z": ("HGT", 1.0, 0.0), "t": ("T", 1.0, 273.15), "q": ("Q", 0.001, 0.0), "u": ("U", 1.0, 0.0), "v": ("V", 1.0, 0.0)}
    fields = external.parent_fields(values, names, ["k", "j", "i"]).withColumn("source", parent.source_id(F.col("i"), F.col("j"), ni))
    rng = np.random.default_rng(5)
    child = {n: (float(a), float(b)) for n, (a, b) in enumerate(zip(rng.uniform(1, 10, 25), rng.uniform(2.5, 8, 25), strict=True))} | {25: places[3, 3]}
    points = spark.createDataFrame([(n, *v) for n, v in child.items()], "cell int, x double, y double")
    levels = points.select("cell", F.explode(F.array(*[F.struct(F.lit(m).alias("to"), F.lit(h).alias("at")) for m, h in ((0, 20.0), (1, 333.0))])).alias("l")).select("cell", "l.to", "l.at")
    return ni, frame(spark, places), child, points, levels, fields


def table_name():
    return "parent_" + uuid.uuid4().hex


def test_constant_and_linear_parents_are_exact(spark, case, tmp_path):
    ni, columns, child, points, levels, fields = case
    across = parent.bilinear_weights(points, columns, ni, "cell", 1.5)
    turn = points.select("cell", F.lit(0.6).alias("cos"), F.lit(0.8).alias("sin"))
    name = table_name()
    out = parent.remap(across, levels, fields, "z", ["t", "q", "u", "v"], "cell", name, f"file://{tmp_path}/t", keys=["path"], wind=("u", "v"), turn=turn, buckets=4).collect()
    assert len(out) == 2 * len(child)
    for r in out:
        (x, y), h = child[r["cell"]], (20.0, 333.0)[r["to"]]
        assert r["t"] == pytest.approx(280 + 2 * x - y + 0.01 * h, abs=1e-8)
        assert r["q"] == pytest.approx(0.007)
        assert (r["u"], r["v"]) == (pytest.approx(5.0), pytest.approx(0.0, abs=1e-9))
    spark.sql(f"DROP TABLE {name}")


def test_heights_outside_and_points_outside(spark, case, tmp_path):
    ni, columns, _, points, levels, fields = case
    far = points.limit(1).withColumns({"x": F.lit(-50.0), "cell": F.lit(99)})
    assert parent.bilinear_weights(far, columns, ni, "cell", 1.5).count() == 0
    near = parent.distance_weights(points.unionByName(far), columns, ni, "cell", 3)
    assert near.filter("cell = 99").count() == 3
    high = levels.withColumn("at", F.lit(1e5)).filter("to = 0")
    for clamp, n in ((False, 0), (True, points.count())):
        name = table_name()
        out = parent.remap(near, high, fields, "z", ["q"], "cell", name, f"file://{tmp_path}/{clamp}", keys=["path"], clamp=clamp, buckets=4).collect()
        assert len(out) == n and all(r["q"] == pytest.approx(0.007) for r in out)
        spark.sql(f"DROP TABLE {name}")


def test_surface_takes_the_masked_side_only(spark):
    across = spark.createDataFrame([(1, 10, 0.25), (1, 11, 0.75), (2, 11, 1.0)], "cell int, source long, w double")
    surface = spark.createDataFrame([(10, 300.0, None, True), (11, 200.0, 5.0, False)], "source long, sst double, ice double, sea boolean")
    out = {r["cell"]: (r["sst"], r["ice"]) for r in parent.remap_surface(across, surface, ["sst", "ice"], "cell", mask=F.col("sea")).collect()}
    assert out == {1: (300.0, None), 2: (None, None)}
    out = {r["cell"]: (r["sst"], r["ice"]) for r in parent.remap_surface(across, surface, ["sst", "ice"], "cell").collect()}
    assert out == {1: (225.0, 5.0), 2: (200.0, 5.0)}
