"""Analysis by variable, filters, Fourier series, interpolation, sinks, NetCDF and names against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbogrid.functions import text
from nimbogrid.operators import ensemble, reduce, regrid, setops, stats, timeops
from nimbogrid.sources import netcdf, observations, sinks


def test_analysis_by_variable_is_a_direct_solve(spark):
    rng = np.random.default_rng(0)
    m, cells, elms = 6, 4, ("a", "b")
    obs = [(c, k, e, rng.normal(size=m), float(rng.normal()), float(rng.uniform(0.5, 2))) for c in range(cells) for k in (1, 2) for e in elms for _ in range(3)]
    obs = [(c, k, e, (y - y.mean()).tolist(), d, r) for c, k, e, y, d, r in obs]
    fields = [(c, k, v, rng.normal(size=m).tolist()) for c in range(cells + 1) for k in (1, 2) for v in ("t", "u", "q")]
    factors = {("t", "a"): 1.0, ("t", "b"): 0.5, ("u", "a"): 1.0, ("u", "b"): 0.5, ("q", "b"): 2.0}
    out = ensemble.analyse_variables(
        spark.createDataFrame(obs, "cell int, k int, elm string, y array<double>, d double, r double"), spark.createDataFrame(fields, "cell int, k int, var string, x array<double>"),
        spark.createDataFrame([(*a, f) for a, f in factors.items()], "var string, elm string, factor double"), rho=1.3, relax=0.25, cell=["cell", "k"],
    )
    got = {(r["cell"], r["k"], r["var"]): r["x"] for r in out.collect()}
    assert len(got) == len(fields)
    for c, k, v, x in fields:
        own = [(y, d, r / factors[v, e]) for a, b, e, y, d, r in obs if (a, b) == (c, k) and (v, e) in factors]
        x = np.array(x)
        p = x - x.mean()
        if own:
            y, d, r = np.array([o[0] for o in own]), np.array([o[1] for o in own]), np.array([o[2] for o in own])
            a = np.linalg.inv(y.T @ np.diag(1 / r) @ y + np.eye(m) * (m - 1) / 1.3)
            values, vectors = np.linalg.eigh(a * (m - 1))
            t = 0.75 * vectors @ np.diag(np.sqrt(values)) @ vectors.T + 0.25 * np.sqrt(1.3) * np.eye(m)
            want = x.mean() + p @ (t + (a @ y.T @ (d / r))[:, None])
        else:
            want = x.mean() + p * np.sqrt(1.3)
        assert got[c, k, v] == pytest.approx(want.tolist())


def test_adaptive_inflation_keeps_cells_without_observations(spark):
    prior = spark.createDataFrame([(1, 1.1), (2, 1.2), (3, 1.0)], "cell int, inflation double")
    pairs = spark.createDataFrame([(1, [1.0, -1.0, 0.0], 2.0, 0.5, 1.0), (1, [0.5, 0.0, -0.5], -1.0, 1.0, 0.5), (3, [0.0, 0.0, 0.0], 1.0, 1.0, 1.0)], "cell int, y array<double>, d double, r double, weight double")
    got = {r["cell"]: r["inflation"] for r in ensemble.adaptive_inflation(pairs, prior, 0.2).collect()}
    dd, p, w = 4 / 0.5 + 1, 2 / 2 / 0.5 + 0.5 / 2, 1.5
    error = 2 / w * ((1.1 * p + w) / p) ** 2
    assert got[2] == 1.2 and got[3] == 1.0 and got[1] == pytest.approx(1.1 + 0.04 / (0.04 + error) * ((dd - w) / p - 1.1))


def test_hyperdiffusion(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 4))

    def rough(p):
        out = np.zeros_like(p)
        for i in range(5):
            for j in range(4):
                near = [p[x, y] for x, y in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= x < 5 and 0 <= y < 4]
                out[i, j] = (len(near) * p[i, j] - sum(near)) / (2 * len(near))
        return out

    want = a.copy()
    for _ in range(2):
        want = want - rough(rough(rough(rough(want))))
        want = np.where(a < 0, -np.maximum(-want, 0), np.maximum(want, 0))
    d = spark.createDataFrame([(i, j, float(a[i, j]), -1.0 if a[i, j] < 0 else 1.0) for i in range(5) for j in range(4)], "i int, j int, v double, s double")
    got = {(r["i"], r["j"]): r["v"] for r in reduce.hyperdiffusion(d, "i", "j", "v", 5, 4, 4, 2, "s").collect()}
    assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-12) for i in range(5) for j in range(4))
    with pytest.raises(ValueError):
        reduce.hyperdiffusion(d, "i", "j", "v", 5, 4, 3)


def test_fourier_series_is_numpys(spark):
    a = np.random.default_rng(2).normal(size=(12, 8))
    d = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(8)], "i int, j int, v double")
    f = np.fft.fft2(a)
    ki, kj = np.abs(np.fft.fftfreq(12, 1 / 12)), np.abs(np.fft.fftfreq(8, 1 / 8))
    want = np.fft.ifft2(np.where((ki[:, None] <= 3) & (kj[None, :] <= 4), f, 0)).real
    got = {(r["i"], r["j"]): r["v"] for r in regrid.dft_lowpass_2d(d, "i", "j", "v", 12, 8, 3, 4).collect()}
    assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-9) for i in range(12) for j in range(8))


def test_trilinear_is_exact_on_planes_and_missing_outside(spark):
    g = spark.createDataFrame([(i, j, k, 2.0 * i - j + 3 * k) for i in range(3) for j in range(3) for k in range(3)], "i int, j int, k int, v double")
    p = spark.createDataFrame([(1, 0.25, 1.5, 1.75), (2, 2.0, 2.0, 2.0), (3, 2.1, 0.0, 0.0)], "row int, ri double, rj double, rk double")
    got = {r["row"]: r["v"] for r in regrid.trilinear(p, g, "ri", "rj", "rk", "i", "j", "k", "v", "row").collect()}
    assert got[1] == pytest.approx(0.5 - 1.5 + 5.25) and got[2] == 8.0 and got[3] is None


def test_curvilinear_index(spark):
    place = lambda i, j: (i + 0.1 * j * j, 1.2 * j + 0.05 * i * j)
    g = spark.createDataFrame([(i, j, *map(float, place(i, j))) for i in range(6) for j in range(6)], "i int, j int, gx double, gy double")
    points = [(1, *map(float, place(2, 3))), (2, -5.0, 0.0), (3, *(float((a + b) / 2) for a, b in zip(place(1, 1), place(2, 1), strict=True)))]
    got = {r["row"]: (r["ri"], r["rj"]) for r in regrid.curvilinear_index(spark.createDataFrame(points, "row int, x double, y double"), g, "row", "x", "y", "i", "j", 1.0).collect()}
    assert set(got) == {1, 3} and got[1] == pytest.approx((2, 3)) and got[3] == pytest.approx((1.5, 1))


def test_rows_are_numbered_by_buckets(spark):
    d = spark.createDataFrame([(float(x), x * x) for x in range(50)], "t double, v int").repartition(5)
    got = timeops.row_numbers(d, ["t"], F.floor(F.col("t") / 7)).collect()
    assert all(r["nth"] == r["t"] + 1 for r in got)
    for lag in (2, -3):
        a = stats.with_lag(d, "t", "v", lag).collect()
        b = stats.with_lag(d, "t", "v", lag, bucket=F.floor(F.col("t") / 7)).collect()
        assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)
    a, b = (sorted(map(tuple, stats.monitor_modes(d, "t", "v", F.lit(0.5), bucket=x).collect())) for x in (None, F.floor(F.col("t") / 7)))
    assert a == b


def test_names_and_digits(spark):
    d = spark.createDataFrame([(3, 12, 0.000123456789), (None, 1234567, -98765.4321), (50, 0, 0.0)], "m int, p int, x double")
    name = text.fill(F.lit("m<m>/p<p>"), {"<p>": (F.col("p"), 6)})
    got = d.select(F.replace(name, F.lit("<m>"), text.member_name(F.col("m"))).alias("n"), text.significant(F.col("x"), 4).alias("x")).collect()
    assert [r["n"] for r in got] == ["m0003/p000012", "mmean/p1234567", "m0050/p000000"]
    assert [r["x"] for r in got] == pytest.approx([0.0001235, -98770.0, 0.0])


def test_perturbations_of_an_initial_state(spark):
    d = spark.range(400).select("id", F.lit(10.0).alias("t"))
    got = ensemble.perturb(d, 8, {"t": 0.5}, ["id"], 1)
    by = got.groupBy("id").agg(F.avg("t").alias("m"), F.count("t").alias("n")).collect()
    assert all(r["m"] == pytest.approx(10.0) and r["n"] == 8 for r in by)
    sd = got.agg(F.stddev("t")).first()[0]
    assert sd == pytest.approx(0.5 * np.sqrt(7 / 8), rel=0.05)
    again = ensemble.perturb(d.repartition(7), 8, {"t": 0.5}, ["id"], 1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_set_operations_and_unequal_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, 5)], "k int, v int")
    b = spark.createDataFrame([(1, None), (3, 5)], "k int, v int")
    assert setops.common_rows(a, b).collect() == [(1, None)]
    assert sorted(setops.only_rows(a, b, every=True).collect()) == [(1, None), (2, 5)] and setops.only_rows(a, b).collect() == [(2, 5)]
    tiles = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 0, 3.0)], "k int, i int, j int, v double")
    with pytest.raises(Exception, match="copies of a cell differ"):
        setops.retile(tiles, ["k"], "i", "j", 2, 2).collect()


def test_netcdf_round_trip(spark, tmp_path):
    a, t = np.arange(24.0).reshape(2, 3, 4), np.array([0.0, 30.0])
    a[1, 2, 3] = -99.0
    variables = {
        "lat": (["lat"], np.array([34.0, 35.0, 36.0], "f4"), {}), "lon": (["lon"], np.array([130.0, 131, 132, 133], "f4"), {"units": "degrees_east"}), "time": (["time"], t, {}),
        "ref": (["time", "lat", "lon"], a, {"_FillValue": -99.0, "scale_factor": 2.0, "units": "dBZ"}), "n": (["lat"], np.array([1, 2, 3], "i2"), {}),
    }
    for name, unlimited in (("a.nc", "time"), ("b.nc", None)):
        (tmp_path / name).write_bytes(netcdf.encode([("time", 2), ("lat", 3), ("lon", 4)], variables, {"title": "test"}, unlimited))
    d = netcdf.read_netcdf(spark, str(tmp_path / "*.nc"), ["ref", "n"])
    assert d.filter("var = 'ref'").count() == 48 and d.filter("var = 'ref' and value is null").count() == 2
    for path, own in {r["path"]: None for r in d.select("path").distinct().collect()}.items():
        ref = netcdf.variable(d.filter(F.col("path") == path), "ref", ["t", "y", "x"], coordinates=True)
        row = ref.filter("t = 30 and y = 35 and x = 132").first()
        assert row["ref"] == 2 * a[1, 1, 2]
    heads = {(r["path"][-4:], r["var"]): (r["dims"], r["sizes"], r["unit"]) for r in netcdf.read_headers(spark, str(tmp_path / "*.nc")).collect()}
    assert heads["a.nc", "ref"] == (["time", "lat", "lon"], [2, 3, 4], "dBZ") == heads["b.nc", "ref"]
    with pytest.raises(ValueError, match="HDF5"):
        netcdf.Header(b"\x89HDF\r\n")
    single = netcdf.encode([("time", 3), ("x", 3)], {"s": (["time", "x"], np.arange(9, dtype="i2").reshape(3, 3), {})}, unlimited="time")
    assert netcdf.Header(single).values("s").tolist() == np.arange(9.0).reshape(3, 3).tolist()


def test_netcdf_radar_observations(spark, tmp_path):
    dims = [("time", 1), ("z", 2), ("lat", 2), ("lon", 2)]
    axes = {n: ([n], np.arange(s, dtype="f8") * 10 + 1, {}) for n, s in dims}
    body = np.arange(8.0).reshape(1, 2, 2, 2)
    (tmp_path / "r.nc").write_bytes(netcdf.encode(dims, {**axes, "ze": ([n for n, _ in dims], body, {"missing_value": 0.0})}))
    got = netcdf.radar_observations(netcdf.read_netcdf(spark, str(tmp_path / "r.nc")), {"ze": 4001}, {"ze": 5.0}).collect()
    assert len(got) == 7 and {(r["elm"], r["typ"], r["err"]) for r in got} == {(4001, 22, 5.0)}
    assert {(r["lev"], r["lat"], r["lon"]): r["dat"] for r in got}[11.0, 1.0, 11.0] == 5.0


def test_sinks(spark, tmp_path):
    obs = spark.createDataFrame([("t", 1, 1, 0, 2.0), ("t", 1, 2, 0, -1.0), ("u", 2, 1, 5, 9.0)], "elm string, typ int, idx int, qc int, dep double")
    sinks.write_departures(obs, str(tmp_path / "d"), "analysis")
    assert spark.read.parquet(str(tmp_path / "d")).filter("elm = 't' and kind = 'analysis'").count() == 2
    for step in (1, 2, 1):
        sinks.write_monitor(sinks.monitor_table(obs), str(tmp_path / "m"), step)
    m = spark.read.parquet(str(tmp_path / "m"))
    row = m.filter("step = 1 and elm = 't'").first()
    assert m.count() == 4 and row["bias"] == 0.5 and row["rmse"] == pytest.approx(np.sqrt(2.5)) and m.filter("elm = 'u'").first()["n_good"] == 0
    sinks.write_counts(obs, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("typ is null and elm is null").first()["n_all"] == 3
    values = spark.createDataFrame([(1, 2, 0, 1.0, [1.0, 2.0]), (1, 1, 0, 3.0, [1.0, 4.0]), (2, 1, 1, 0.0, [])], "set int, idx int, qc int, val double, ensval array<double>")
    sinks.write_observation_space(values, str(tmp_path / "v"))
    sinks.write_by_rank(values.withColumn("rank", F.col("set") % 2), str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "v")).filter("set = 1 and idx = 1").first()
    assert back["ensval"] == [1.0, 4.0] and spark.read.parquet(str(tmp_path / "r")).filter("rank = 0").count() == 1
    state = spark.createDataFrame([(n, k, float(n * k)) for n in (1, 2, 3) for k in (1, 2)], "member int, k int, t double")
    sinks.write_members(state, str(tmp_path / "s"), ["k"], ["t"])
    s = spark.read.parquet(str(tmp_path / "s"))
    assert s.filter("member = -1 and k = 2").first()["t"] == 4.0 and s.filter("member = -2 and k = 1").first()["t"] == 1.0 and s.count() == 10
    sinks.write_superobs(spark.createDataFrame([(1, 2, 3, 4.0)], "i int, j int, k int, z double"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_external_series_and_names(spark):
    from nimbogrid.operators.external import External, Source

    x = External()
    data = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 3.0), ("b", 0.0, 5.0)], "k string, time double, v double")
    x.register("s", Source(data, "series", ["k"], "v"))
    with pytest.raises(ValueError):
        x.register("s", Source(data, "series", ["k"], "v"))
    with pytest.raises(ValueError):
        x.register("t", Source(data, "often", ["k"], "v"))
    targets = spark.createDataFrame([(1, "a", 5.0), (2, "a", 11.0), (3, "b", 0.0), (4, "c", 1.0)], "id int, k string, time double")
    assert {r["id"]: r["s"] for r in x.lookup(targets, "s").collect()} == {1: 2.0, 2: None, 3: 5.0, 4: None}


def test_parent_fields(spark, tmp_path):
    from nimbogrid.operators.external import parent_fields

    a = np.arange(6.0).reshape(2, 3)
    (tmp_path / "p.nc").write_bytes(netcdf.encode([("y", 2), ("x", 3)], {"TEMP": (["y", "x"], a, {}), "PRES": (["y", "x"], a + 850, {}), "H": (["y"], np.array([1.0, 2.0]), {})}))
    got = parent_fields(netcdf.read_netcdf(spark, str(tmp_path / "p.nc")), {"t": ("TEMP", 1.0, 273.15), "p": ("PRES", 100.0, 0.0)}, ["j", "i"]).collect()
    assert len(got) == 6 and {(r["j"], r["i"]): (r["t"], r["p"]) for r in got}[1, 2] == pytest.approx((278.15, 85500.0))


def test_described_binary(spark, tmp_path):
    from nimbogrid.sources import grids

    np.arange(24, dtype=">f4").tofile(tmp_path / "g.bin")
    (tmp_path / "g.ctl").write_text("dset ^g.bin\n* a comment\noptions big_endian yrev\nundef 5\nxdef 3 linear 130 0.5\nydef 2 levels 30 31\nzdef 3 levels 1000 850 500\ntdef 1 linear 00Z01JAN2024 1hr\nvars 2\nt 3 99 temperature\nps 0 99 pressure\nendvars\n")
    spec, rest = grids.parse_ctl((tmp_path / "g.ctl").read_text().splitlines())
    assert spec.variables == (("t", 3), ("ps", 1)) and rest["x"] == (3, 130.0, 0.5) and spec.missing == 5
    got = {(r["var"], r["k"], r["j"], r["i"]): r["value"] for r in grids.read_described(spark, str(tmp_path / "g.ctl")).collect()}
    assert got["ps", 1, 2, 1] == 18.0 and got["t", 1, 1, 3] is None and len(got) == 24


def test_records_of_several_sizes():
    raw = observations.encode([(1.0,)] * 2 + [(1.0, 2.0, 3.0)] * 4 + [(7.0,)])
    assert [x.shape for x in observations.records(raw)] == [(2, 1), (4, 3), (1, 1)]
    with pytest.raises(ValueError):
        observations.records(raw + b"\0")


def test_hyperdiffusion_over_many_tiles(spark):
    """Several tiles and rounds, gaps and missing values, against the whole grid at once; fifty iterations have a short plan."""
    import time

    rng = np.random.default_rng(4)
    ni, nj, v = 21, 13, rng.normal(size=(21, 13))
    cells = [(i, j, None if rng.random() < 0.05 else float(v[i, j])) for i in range(ni) for j in range(nj) if rng.random() > 0.1]
    d = spark.createDataFrame(cells, "i int, j int, v double")
    whole = {(r["i"], r["j"]): r["v"] for r in reduce.hyperdiffusion(d, "i", "j", "v", ni, nj, 2, 7).collect()}
    tiled = {(r["i"], r["j"]): r["v"] for r in reduce.hyperdiffusion(d, "i", "j", "v", ni, nj, 2, 7, tile=8).collect()}
    assert set(whole) == set(tiled) == {(i, j) for i, j, _ in cells}
    assert all(whole[c] == pytest.approx(tiled[c], abs=1e-12) if whole[c] is not None else tiled[c] is None for c in whole)
    once, step = reduce.hyperdiffusion(d, "i", "j", "v", ni, nj, 2, 1, tile=8), d
    for _ in range(2):
        step = reduce.diffusion_step(step, "i", "j", "v", ni, nj)
    rough = {(r["i"], r["j"]): r["v"] for r in step.collect()}
    for i, j, x in cells:
        got = {(r["i"], r["j"]): r["v"] for r in once.collect()} if (i, j) == cells[0][:2] else got
        want = None if x is None or rough[i, j] is None else x - rough[i, j]
        assert got[i, j] is None if want is None else got[i, j] == pytest.approx(want, abs=1e-12)
    began = time.perf_counter()
    many = reduce.hyperdiffusion(d, "i", "j", "v", ni, nj, 2, 50)
    assert many._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3 and time.perf_counter() - began < 5
    assert many.count() == len(cells)


def test_a_set_is_written_by_many_tasks(spark, tmp_path):
    values = spark.range(4000).selectExpr("1 AS set", "id AS idx", "0 AS qc", "id * 0.5D AS val").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together
    try:
        sinks.write_observation_space(values, str(tmp_path / "v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "v" / "set=1").glob("*.parquet"))
    assert len(files) > 1
    spans = sorted((r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path / "v")).groupBy(F.input_file_name()).agg(F.min("idx").alias("a"), F.max("idx").alias("b")).collect())
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[-1][1] == 3999


def test_splines_of_many_columns_are_those_of_each(spark):
    from nimbogrid.operators import regrid

    rng = np.random.default_rng(8)
    cols = {c: (np.sort(rng.uniform(0, 10, n)), rng.normal(size=n)) for c, n in enumerate([0, 1, 2, 3, 4, 9, 30])}
    d = spark.createDataFrame([(c, float(z), None if c == 6 and k == 3 else float(v)) for c, (zs, vs) in cols.items() for k, (z, v) in enumerate(zip(zs, vs, strict=True))], "c int, z double, v double").repartition(3)
    got = {(r["c"], r["target"]): r["v"] for r in regrid.vertical_spline(d, ["c"], "z", "v", [0.5, 5.0, 11.0]).collect()}
    for c, (z, v) in cols.items():
        v = np.where((np.arange(len(v)) == 3) & (c == 6), np.nan, v)
        want = regrid.spline_at(z, v, np.array([0.5, 5.0, 11.0]))
        for t, x in zip((0.5, 5.0, 11.0), want, strict=True):
            assert (c, t) not in got if not len(z) else got[c, t] is None if np.isnan(x) else got[c, t] == pytest.approx(x)
