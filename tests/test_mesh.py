"""Meshes of spherical triangles and the divergence-free projection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbogrid.operators import mesh, regrid, spectral


def vector(lon, lat):
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=-1)


@pytest.fixture(scope="module")
def globe(spark):
    nodes, triangles = mesh.icosahedral(spark, 6)
    return nodes.cache(), triangles.cache()


def test_icosahedral_mesh_covers_the_sphere(globe):
    nodes, triangles = (d.toPandas() for d in globe)
    assert len(triangles) == 20 * 36 and len(nodes) == 10 * 36 + 2 and triangles["tri"].is_unique
    at = {n: vector(x, y) for n, x, y in nodes.itertuples(index=False)}
    solid = 0.0
    for _, a, b, c in triangles.itertuples(index=False):
        p, q, r = at[a], at[b], at[c]
        solid += 2 * np.arctan2(np.linalg.det([p, q, r]), 1 + p @ q + q @ r + r @ p)
    assert solid == pytest.approx(4 * np.pi)


def test_every_point_has_weights_of_sum_one(spark, globe):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(400, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    places = [(float(np.degrees(np.arctan2(y, x))), float(np.degrees(np.arcsin(z)))) for x, y, z in p]
    places += [(0.0, 90.0), (0.0, -90.0), (180.0, 0.0), (-180.0, 0.0), (359.9, 45.0), (540.0, -30.0)]
    nodes, triangles = globe
    places += [(r["lon"], r["lat"]) for r in nodes.limit(40).collect()]
    points = spark.createDataFrame([(n, *x) for n, x in enumerate(places)], "cell long, lon double, lat double").repartition(3)
    got = {r["cell"]: r for r in mesh.locate(points, triangles, nodes).collect()}
    assert len(got) == len(places)
    at = {r["node"]: vector(r["lon"], r["lat"]) for r in nodes.collect()}
    for n, (lon, lat) in enumerate(places):
        r = got[n]
        w = np.array([r["wa"], r["wb"], r["wc"]])
        assert abs(w.sum() - 1) < 1e-12 and w.min() > -1e-9
        # Linear fields are exact where the point's line meets the plane of the corners: the mean of the corners lies on that line.
        hit = w @ np.stack([at[r[c]] for c in "abc"])
        assert np.allclose(hit / np.linalg.norm(hit), vector(lon, lat), atol=1e-12)
    table = mesh.weight_table(mesh.locate(points, triangles, nodes))
    ones = regrid.remap(table, nodes.select(F.col("node").alias("source"), F.lit(3.5).alias("v")), "source", "target", "v")
    assert all(abs(r["v"] - 3.5) < 1e-12 for r in ones.collect())


def test_triangles_of_any_size_meet_few_points(spark):
    """Sizes from half an octant to a thousandth of a degree, nested: the smallest number wins, and no point is compared with all."""
    nodes, triangles = [], []
    for k in range(18):
        s = 40 * 0.55**k
        nodes += [(3 * k, 10 - s, 20 - s), (3 * k + 1, 10 + s, 20 - s), (3 * k + 2, 10.0, 20 + s)]
        triangles.append((100 - k, 3 * k, 3 * k + 1, 3 * k + 2))
    n = spark.createDataFrame(nodes, "node int, lon double, lat double")
    t = spark.createDataFrame(triangles, "tri int, a int, b int, c int")
    points = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.0, 19.0), (3, 200.0, -80.0)], "cell int, lon double, lat double")
    got = {r["cell"]: r["tri"] for r in mesh.locate(points, t, n).collect()}
    assert got[1] == 83 and 3 not in got and 83 < got[2] <= 100
    cubes = mesh.indexed(mesh.corners_of(t, n))
    assert max(r["count"] for r in cubes.groupBy("tri").count().collect()) <= 8
    assert mesh.locate(points, t.limit(0), n).count() == 0


def test_projection_has_no_divergence_and_is_one(spark):
    rng = np.random.default_rng(5)
    ni, nj, li, lj = 16, 12, 5, 4
    u, v = rng.normal(size=(2, 2, ni, nj))
    d = spark.createDataFrame([(k, i, j, float(u[k, i, j]), float(v[k, i, j])) for k in range(2) for i in range(ni) for j in range(nj)], "k int, i int, j int, u double, v double").repartition(5)
    once = spectral.divergence_free(d, "i", "j", "u", "v", ni, nj, li, lj, ["k"]).cache()
    twice = spectral.divergence_free(once, "i", "j", "u", "v", ni, nj, li, lj, ["k"])

    def grid(df):
        out = np.zeros((2, 2, ni, nj))
        for r in df.collect():
            out[0, r["k"], r["i"], r["j"]], out[1, r["k"], r["i"], r["j"]] = r["u"], r["v"]
        return out

    a, b = grid(once), grid(twice)
    assert np.allclose(a, b, atol=1e-12)
    l, m = np.fft.fftfreq(ni, 1 / ni)[:, None], np.fft.fftfreq(nj, 1 / nj)[None, :]
    half = np.exp(-1j * np.pi * l / ni), np.exp(-1j * np.pi * m / nj)
    for k in range(2):
        fu, fv = (np.fft.fft2(a[n, k]) * half[n] for n in range(2))
        assert np.abs(l * fu + m * fv).max() < 1e-9
        # What is left is the input's rotation at the wavenumbers that are kept, and its mean.
        gu, gv = (np.fft.fft2(x[k]) * half[n] for n, x in enumerate((u, v)))
        kept = (np.abs(l) <= li) & (np.abs(m) <= lj)
        assert np.allclose((l * fv - m * fu)[kept], (l * gv - m * gu)[kept]) and np.allclose(fu[~kept], 0, atol=1e-9)
        assert a[0, k].mean() == pytest.approx(u[k].mean()) and a[1, k].mean() == pytest.approx(v[k].mean())
    with pytest.raises(ValueError):
        spectral.divergence_free(d, "i", "j", "u", "v", ni, nj, 8, 4)


def test_missing_values_count_as_zero(spark):
    rows = [(i, j, float(i), None if i == j else float(j)) for i in range(8) for j in range(8) if (i, j) != (3, 4)]
    d = spark.createDataFrame(rows, "i int, j int, u double, v double")
    full = spark.createDataFrame([(i, j, 0.0 if (i, j) == (3, 4) else float(i), 0.0 if i == j or (i, j) == (3, 4) else float(j)) for i in range(8) for j in range(8)], "i int, j int, u double, v double")
    got, want = (sorted(map(tuple, spectral.divergence_free(x, "i", "j", "u", "v", 8, 8, 3, 3).collect())) for x in (d, full))
    assert np.allclose(got, want, atol=1e-12) and len(got) == 64
