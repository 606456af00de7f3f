"""Closed forms and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbogrid.functions import calendar, geo, thermo
from nimbogrid.operators import derived, ensemble, joins, qc, reduce, regrid, setops, stats, timeops


def test_slots(spark):
    d = spark.createDataFrame([(x,) for x in (-50.0, -49.9, 0.0, 50.0, 50.1)], "d double")
    assert [r[0] for r in d.select(qc.time_slot(F.col("d"), 100.0, 1)).collect()] == [0, 1, 1, 1, 2]


def test_first_rule_wins_and_boundary_passes(spark):
    d = spark.createDataFrame([(6.0, 1.0), (5.0, 1.0), (None, 1.0)], "dep double, err double")
    code = qc.first_code([(F.col("dep").isNull(), qc.BAD_VALUE), (qc.gross_error(F.col("dep"), F.col("err")), qc.GROSS_ERROR)])
    assert [r[0] for r in d.select(code).collect()] == [5, 0, 50]


def test_poison_and_skip(spark):
    d = spark.createDataFrame([(1, 1.0, 1.0), (1, None, 1.0), (2, 2.0, 3.0), (2, 4.0, 1.0)], "g int, v double, dt double")
    run = lambda skip: {r["interval"]: r["v"] for r in reduce.history(d, F.col("g"), [], "v", "dt", "mean", skip).collect()}
    assert run(False) == {1: None, 2: 2.5}
    assert run(True) == {1: 1.0, 2: 2.5}


def test_time_average_drops_partial_and_gives_zero(spark):
    d = spark.createDataFrame([(1, None), (2, None), (3, 5.0), (4, 7.0), (5, 9.0)], "step int, v double")
    assert sorted((r["group"], r["v"]) for r in reduce.time_average(d, [], "step", "v", 2).collect()) == [(0, 0.0), (1, 6.0)]


def test_pairwise_policy(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0), (4.0, 5.0), (None, 9.0)], "x double, y double")
    got = d.agg(stats.correlation(F.col("x"), F.col("y"))).first()[0]
    x, y = np.array([1.0, 3.0, 4.0]), np.array([2.0, 1.0, 5.0])
    assert got == pytest.approx(np.cov(x, y)[0, 1] / (np.std([1, 2, 3, 4], ddof=1) * np.std([2, 1, 5, 9], ddof=1)))
    assert got != pytest.approx(np.corrcoef(x, y)[0, 1])


def test_one_row_has_no_variance(spark):
    assert spark.createDataFrame([(1.0,)], "x double").agg(F.var_samp("x")).first()[0] is None


def test_bucket_join_is_brute_force(spark):
    rng = np.random.default_rng(1)
    a = [(int(n), float(x), float(y)) for n, (x, y) in enumerate(rng.uniform(-20, 20, (60, 2)))]
    b = [(int(n), float(x), float(y)) for n, (x, y) in enumerate(rng.uniform(-20, 20, (80, 2)))]
    b.append((99, a[0][1] + 3.0, a[0][2]))
    got = joins.bucket_join(spark.createDataFrame(a, "m long, x double, y double"), spark.createDataFrame(b, "n long, x double, y double"), 3.0)
    want = {(m, n) for m, x, y in a for n, u, v in b if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 3.0}
    assert {(r["m"], r["n"]) for r in got.collect()} == want


def test_great_circle_join_wraps_and_covers_poles(spark):
    rng = np.random.default_rng(2)
    a = [(int(n), float(x), float(y)) for n, (x, y) in enumerate(zip(rng.uniform(-180, 180, 50), rng.uniform(-90, 90, 50), strict=True))] + [(100, 179.9, 10.0), (101, 0.0, 89.9)]
    b = [(int(n), float(x), float(y)) for n, (x, y) in enumerate(zip(rng.uniform(-180, 180, 90), rng.uniform(-90, 90, 90), strict=True))] + [(100, -179.9, 10.0), (101, 180.0, 89.9)]
    got = joins.great_circle_join(spark.createDataFrame(a, "m long, lon double, lat double"), spark.createDataFrame(b, "n long, lon double, lat double"), 1.5e6)

    def far(x, y, u, v):
        x, y, u, v = np.radians([x, y, u, v])
        return 2 * 6.37122e6 * np.arcsin(np.sqrt(np.sin((y - v) / 2) ** 2 + np.cos(y) * np.cos(v) * np.sin((x - u) / 2) ** 2))

    want = {(m, n) for m, x, y in a for n, u, v in b if far(x, y, u, v) <= 1.5e6}
    found = [(r["m"], r["n"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_constant_survives_regridding(spark):
    rng = np.random.default_rng(3)
    src = spark.createDataFrame([(int(n), float(x), float(y), 7.0) for n, (x, y) in enumerate(rng.uniform(0, 10, (40, 2)))], "obs_id long, x double, y double, dat double")
    tgt = spark.createDataFrame([(1, 5.0, 5.0), (2, 2.0, 8.0)], "cell long, x double, y double")
    w = joins.nearest_weights(tgt, src, 4, 2.0, 9.0)
    assert all(abs(r[0] - 1) < 1e-12 for r in w.groupBy("cell").agg(F.sum("w")).select("sum(w)").collect())
    assert all(abs(r["dat"] - 7) < 1e-12 for r in regrid.apply_weights(w, src, ["cell"], "obs_id", "dat", 0.999).collect())


def test_transform_closed_form_and_identity():
    rng = np.random.default_rng(4)
    m, rho = 6, 1.3
    y = rng.normal(size=m)
    y -= y.mean()
    w, t = ensemble.local_transform(y[None, :], np.array([1.7]), np.array([2.0]), rho)
    c, u = (m - 1) / rho, y / np.linalg.norm(y)
    assert np.allclose(w, y * 1.7 / (2.0 * c + y @ y))
    assert np.allclose(t, np.sqrt(m - 1) * ((np.eye(m) - np.outer(u, u)) / np.sqrt(c) + np.outer(u, u) / np.sqrt(c + y @ y / 2.0)))
    assert np.allclose(ensemble.local_transform(np.zeros((0, m)), np.zeros(0), np.zeros(0), rho)[1], np.sqrt(rho) * np.eye(m))
    x = rng.normal(size=m)
    x -= x.mean()
    _, full = ensemble.local_transform(y[None, :], np.array([1.7]), np.array([2.0]), rho, relax_spread=1.0, x=x)
    assert np.std(x @ full, ddof=1) == pytest.approx(np.std(x, ddof=1) * np.sqrt(rho), rel=1e-6)


def test_global_transform_equals_local_solve(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(30, 5))
    y -= y.mean(axis=1, keepdims=True)
    d, r, x = rng.normal(size=30), rng.uniform(0.5, 2, 30), rng.normal(size=5)
    obs = spark.createDataFrame([(y[n].tolist(), float(d[n]), float(r[n])) for n in range(30)], "y array<double>, d double, r double")
    got = ensemble.global_transform(obs, spark.createDataFrame([("a", x.tolist())], "name string, x array<double>")).first()["x"]
    w, t = ensemble.local_transform(y, d, r)
    assert np.allclose(got, x.mean() + (x - x.mean()) @ (t + w[:, None]))


def test_perturbations_add_up_to_zero(spark):
    d = spark.createDataFrame([([1.0, 2.0, 6.0],)], "e array<double>")
    assert abs(sum(d.select(ensemble.perturbations(F.col("e"))).first()[0])) < 1e-12


def test_spline_and_tridiagonal():
    z, v = np.array([0.0, 1.0, 2.5, 3.0, 4.2]), np.array([1.0, 3.0, -1.0, 0.5, 2.0])
    assert np.allclose(regrid.spline_at(z, v, z), v)
    line = 2 * z + 1
    assert np.allclose(regrid.spline_at(z, line, np.array([-1.0, 0.3, 2.7, 6.0])), 2 * np.array([-1.0, 0.3, 2.7, 6.0]) + 1)
    u = regrid.spline_coefficients(z, v)
    assert u[0] == u[1] and u[-1] == u[-2]
    assert np.isnan(regrid.spline_at(z[:1], v[:1], z)).all()
    rng = np.random.default_rng(6)
    low, mid, high, rhs = rng.normal(size=7), 5 + rng.normal(size=7), rng.normal(size=7), rng.normal(size=7)
    a = np.diag(mid) + np.diag(high[:-1], 1) + np.diag(low[1:], -1)
    assert np.allclose(regrid.thomas(low, mid, high, rhs), np.linalg.solve(a, rhs))


def test_akima_is_exact_on_a_line(spark):
    d = spark.createDataFrame([(1, float(k), 3.0 * k - 1) for k in range(6)], "c int, k double, v double")
    assert all(abs(r["v"] - (3 * r["at"] - 1)) < 1e-12 for r in regrid.akima(d, ["c"], "k", "v", 0.3).collect())


def test_projections_invert(spark):
    d = spark.createDataFrame([(float(a), float(b)) for a in (100, 135, 150) for b in (-20, 20, 60)], "lon double, lat double")
    for kind in ("NONE", "LC", "PS", "MER", "EC"):
        p = geo.Projection(kind, 135.0, 35.0)
        x, y = p.forward(F.col("lon"), F.col("lat"))
        u, v = p.inverse(F.col("x"), F.col("y"))
        for r in d.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", u.alias("u"), v.alias("v")).collect():
            assert r["u"] == pytest.approx(r["lon"], abs=1e-8) and r["v"] == pytest.approx(r["lat"], abs=1e-8)


def test_diffusion_keeps_a_constant_out(spark):
    d = spark.createDataFrame([(i, j, 4.0) for i in range(4) for j in range(5)], "i int, j int, v double")
    assert all(abs(r["v"]) < 1e-12 for r in reduce.diffusion_step(d, "i", "j", "v", 4, 5).collect())


def test_lanczos_weights(spark):
    w = reduce.lanczos_weights(0.6)
    assert len(w) == 21 and w == pytest.approx(w[::-1]) and w[10] == pytest.approx(0.6 / np.pi)
    assert w[13] == pytest.approx(np.sin(0.6 * 3) * np.sin(np.pi * 3 / 10) * 10 / (np.pi * 3) ** 2) and w[0] == pytest.approx(0, abs=1e-15)
    d = spark.createDataFrame([(n, 3.0) for n in range(12)], "n long, v double")
    assert all(r["v"] == pytest.approx(3.0 * sum(w)) for r in reduce.lanczos(d, "n", "v", 12, w).collect())


def test_asof_buckets_change_nothing(spark):
    rng = np.random.default_rng(7)
    src = spark.createDataFrame([("a", float(t), float(v)) for t, v in rng.uniform(0, 100, (25, 2))], "g string, t double, v double")
    tgt = spark.createDataFrame([("a", float(t)) for t in np.linspace(-20, 130, 40)], "g string, t double")
    run = lambda w: sorted((r["t"], r["prev"], r["next"], r["v"]) for r in timeops.asof_linear(tgt, src, "t", "v", ["g"], w).collect())
    key = lambda rows: [tuple(None if x is None else round(x, 9) for x in r) for r in rows]
    assert key(run(None)) == key(run(7.0))


def test_dew_point_and_latent_heat(spark):
    d = spark.createDataFrame([(t,) for t in (220.0, 260.0, 300.0)], "t double")
    for r in d.select("t", thermo.dew_point(thermo.saturation_liquid(F.col("t"))).alias("d")).collect():
        assert r["d"] == pytest.approx(r["t"], abs=1e-6)
    assert d.select(thermo.latent_heat_vaporisation(F.lit(273.15))).first()[0] == pytest.approx(2.501e6)


def test_parcel_in_stable_air_has_no_energy():
    z = np.arange(0.0, 12000.0, 500.0)
    t = 290 - 0.002 * z
    p = 1e5 * np.exp(-z / 8000)
    cape, cin, *_ = derived.lift_parcel(z, p, t, np.full(len(z), 0.004))
    assert cape == 0 and cin > 0
    hot = derived.lift_parcel(z, p, 303 - 0.0085 * z, np.r_[0.018, np.full(len(z) - 1, 0.004)])
    assert hot[0] > 100 and hot[2] <= hot[3] < hot[4]


def test_registry_rejects_unknown_names(spark):
    with pytest.raises(KeyError):
        derived.resolve(spark.createDataFrame([(1.0,)], "t double"), ["NOPE"])


def test_calendar(spark):
    d = spark.sql("SELECT TIMESTAMP_NTZ'2016-12-31 23:59:59' AS a, TIMESTAMP_NTZ'2017-01-01 00:00:00' AS b")
    got = d.select(calendar.utc_to_tai93(F.col("b")) - calendar.utc_to_tai93(F.col("a")), calendar.is_leap(F.col("a")), calendar.day_360(F.col("a"))).first()
    assert got[0] == 2 and got[1] is True and got[2] == 2016 * 360 + 11 * 30 + 29
    u = spark.createDataFrame([("hours since 2000-01-01 00:00:00", 5.0)], "u string, v double")
    assert str(u.select(calendar.cf_time(F.col("v"), F.col("u"))).first()[0]) == "2000-01-01 05:00:00"


def test_superob_method_zero_and_unknown(spark):
    d = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 1)], "c int, dat double, err double, dist double, obs_id int")
    assert reduce.superob(d, ["c"], 0).count() == 1
    with pytest.raises(ValueError):
        reduce.superob(d, ["c"], 9)


def test_compare_and_catalogue(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], "var string, step int, value double")
    b = spark.createDataFrame([("x", 1, 1.05), ("x", 3, 2.0)], "var string, step int, value double")
    assert {r["step"] for r in setops.compare(a, b, ["var", "step"], "value", 0.1).collect()} == {2, 3}


def test_level_mean_without_area_is_missing(spark):
    d = spark.createDataFrame([(1, None, 1.0), (2, 3.0, 2.0)], "k int, v double, a double")
    assert {r["k"]: r["mean"] for r in stats.level_means(d, "v", "a").collect()} == {1: None, 2: 3.0}


def test_serial_filter_has_the_transforms_mean():
    rng = np.random.default_rng(8)
    x, y, d, r_ = rng.normal(size=9), rng.normal(size=(7, 9)), rng.normal(size=7), rng.uniform(0.5, 2, 7)
    y -= y.mean(axis=1, keepdims=True)
    w, t = ensemble.local_transform(y, d, r_)
    a, b = ensemble.serial_filter(x, y, d, r_), x.mean() + (x - x.mean()) @ (t + w[:, None])
    assert a.mean() == pytest.approx(b.mean()) and a.std() == pytest.approx(b.std())


def test_gamma(spark):
    import math

    from nimbogrid.functions.special import gamma

    xs = [0.3, 1.0, 4.5, 10.0, -0.5, -2.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(gamma(F.col("x"))).collect()]
    assert got[:5] == pytest.approx([math.gamma(x) for x in xs[:5]], rel=1e-9) and got[5] is None


def test_stretched_levels():
    from nimbogrid.operators.forward import stretched_levels

    assert stretched_levels(10.0, 2.0, 40.0, 5) == [10.0, 30.0, 70.0, 110.0, 150.0]
