"""Filters with localised covariances and in the members' subspace against direct computation."""

import numpy as np
import pytest

from nimbogrid.operators import ensemble, kalman


def setup(rng, cells, most, m=6):
    obs, back = [], []
    for c in range(cells):
        back.append((c, rng.normal(size=m).tolist()))
        for n in range(int(rng.integers(0, most + 1))):
            y = rng.normal(size=m)
            obs.append((c, 100 * c + n, *rng.uniform(-3, 3, 2).tolist(), (y - y.mean()).tolist(), float(rng.normal()), float(rng.uniform(0.2, 2))))
    return obs, back


def direct(x, obs, half, noise):
    """The state and all observations as one joint ensemble with a tapered covariance matrix."""
    m = len(x)
    p = np.array(x) - np.mean(x)
    if not obs:
        return np.array(x)
    at = np.array([[0.0, 0.0]] + [[o[2], o[3]] for o in obs])
    z = np.vstack([p] + [o[4] for o in obs])
    cov = kalman.fifth_order(np.linalg.norm(at[:, None] - at[None], axis=2), half) * (z @ z.T / (m - 1))
    r = np.diag([o[6] for o in obs])
    d = np.array([o[5] for o in obs])
    s = cov[1:, 1:] + r
    gain = cov[0, 1:] @ np.linalg.inv(s)
    if noise is not None:
        return np.mean(x) + p + gain @ (d[:, None] + noise - z[1:])
    root = lambda a: (lambda w, v: v @ np.diag(np.sqrt(w)) @ v.T)(*np.linalg.eigh(a))
    k = cov[0, 1:] @ np.linalg.inv(root(s)).T @ np.linalg.inv(root(s) + root(r))
    return np.mean(x) + gain @ d + p - k @ z[1:]


@pytest.mark.parametrize("seed", [None, 5])
def test_localised_analysis_is_the_dense_solve(spark, seed):
    rng = np.random.default_rng(2)
    obs, back = setup(rng, 30, 7)
    pairs = spark.createDataFrame([(c, i, x, y, float(np.hypot(x, y)), p, d, r) for c, i, x, y, p, d, r in obs], "cell int, obs_id int, ox double, oy double, dist double, y array<double>, d double, r double").repartition(4)
    got = {r["cell"]: r["x"] for r in kalman.localised_analysis(pairs, spark.createDataFrame(back, "cell int, x array<double>"), 1.7, seed=seed).collect()}
    noise = {}
    if seed is not None:
        from pyspark.sql import functions as F

        draws = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda m: F.sqrt("r") * ensemble.normal(seed, F.col("obs_id"), m))
        noise = {r["obs_id"]: np.array(r["n"]) for r in pairs.select("obs_id", ensemble.perturbations(draws).alias("n")).collect()}
    for c, x in back:
        own = [o for o in obs if o[0] == c]
        want = direct(x, own, 1.7, np.array([noise[o[1]] for o in own]) if seed is not None and own else None)
        assert np.allclose(got[c], want, atol=1e-10)
    assert len(got) == 30


def test_one_observation_in_closed_form():
    rng = np.random.default_rng(1)
    x, y = (v - v.mean() for v in rng.normal(size=(2, 8)))
    t, r = np.array([[0.4]]), np.array([[0.7]])
    gain, root = kalman.localised_gain(x[None], y[None, None], r, t, np.ones((1, 1, 1)))
    var, cov = y @ y / 7, 0.4 * x @ y / 7
    assert np.isclose(gain[0, 0], cov / (var + 0.7)) and np.isclose(root[0, 0], cov / (var + 0.7) / (1 + np.sqrt(0.7 / (var + 0.7))))


def test_far_observations_and_none(spark):
    pairs = spark.createDataFrame([(1, 7, 50.0, 0.0, 50.0, [1.0, -1.0, 0.0], 3.0, 1e-6)], "cell int, obs_id int, ox double, oy double, dist double, y array<double>, d double, r double")
    back = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [4.0, 5.0, 6.0])], "cell int, x array<double>")
    got = {r["cell"]: r["x"] for r in kalman.localised_analysis(pairs, back, 2.0).collect()}
    assert np.allclose(got[1], [1, 2, 3]) and np.allclose(got[2], [4, 5, 6])
    assert kalman.localised_analysis(pairs, back.limit(0), 2.0).count() == 0


def test_taper_is_that_of_the_columns(spark):
    from pyspark.sql import functions as F

    from nimbogrid.operators.forward import taper

    d = np.linspace(0.01, 7, 60)
    got = [r["t"] for r in spark.createDataFrame([(float(x),) for x in d], "d double").select(taper(F.col("d"), 2.5).alias("t")).collect()]
    assert np.allclose(got, kalman.fifth_order(d, 2.5), atol=1e-12) and kalman.fifth_order(np.zeros(1), 1.0)[0] == 1


@pytest.mark.parametrize("variables", [2, 9])
def test_subspace_filter_is_the_transform_filter(spark, variables):
    """More variables than members and fewer; the observations are linear in the variables."""
    rng = np.random.default_rng(3)
    x, h = rng.normal(size=(variables, 6)), rng.normal(size=(4, variables))
    d, r = rng.normal(size=4), rng.uniform(0.3, 2, 4)
    p = x - x.mean(axis=1, keepdims=True)
    y = h @ p
    got = kalman.subspace_filter(x, y, d, r)
    w, t = ensemble.local_transform(y, d, r)
    assert np.allclose(got, x.mean(axis=1, keepdims=True) + p @ (t + w[:, None]))
    more = kalman.subspace_filter(x, y, d, r, inflation=0.3)
    assert np.allclose(more.mean(axis=1), got.mean(axis=1)) and (more.var(axis=1) > got.var(axis=1)).all()
    pairs = spark.createDataFrame([(3, n, y[n].tolist(), float(d[n]), float(r[n])) for n in range(4)], "cell long, obs_id int, y array<double>, d double, r double")
    back = spark.createDataFrame([(c, n, x[n].tolist()) for c in (3, 4) for n in range(variables)], "cell long, var int, x array<double>")
    out = {(q["cell"], q["var"]): q["x"] for q in kalman.patch_analysis(pairs, back).collect()}
    assert all(np.allclose(out[3, n], got[n]) and np.allclose(out[4, n], x[n]) for n in range(variables)) and len(out) == 2 * variables


def test_members_without_spread():
    x = np.ones((3, 5))
    assert np.allclose(kalman.subspace_filter(x, np.zeros((1, 5)), np.ones(1), np.ones(1)), x)


def test_local_analysis_query_is_a_direct_solve(spark, sf):
    """The query's own pairs, solved cell by cell with dense matrices; every cell has a row, cell 0 too."""
    from nimbogrid.plans import QUERIES, q_ensemble
    from nimbogrid.plans.views import v_ens_array, v_grid

    pairs = {}
    for p in q_ensemble._local_pairs(spark, sf).select("cell", "obs_id", "y", "d", "r").collect():
        pairs.setdefault(p["cell"], []).append(p)
    ens = {r["vec_id"]: np.array(r["ens"], float) for r in v_ens_array(spark, sf).collect()}
    cells = {r["cell"] for r in v_grid(spark, sf).select("cell").collect()}
    got = {r["cell"]: r for r in QUERIES["transform_local_analysis"](spark, sf).collect()}
    spread = {r["cell"]: r for r in QUERIES["transform_relax_spread"](spark, sf).collect()}
    assert set(got) == set(spread) == cells & set(ens) and 0 in got
    for c in got:
        x, obs = ens[c], pairs.get(c, [])
        p, m = x - x.mean(), len(x)
        y, d, r = np.array([o["y"] for o in obs]).reshape(-1, m), np.array([o["d"] for o in obs]), np.array([o["r"] for o in obs])
        a = np.linalg.inv(y.T @ np.diag(1 / r) @ y + (m - 1) / 1.1 * np.eye(m)) if obs else np.eye(m) * 1.1 / (m - 1)
        mean = x.mean() + (p @ a @ y.T @ (d / r) if obs else 0.0)
        assert got[c]["mean"] == pytest.approx(mean, abs=2e-6) and spread[c]["mean"] == pytest.approx(mean, abs=2e-6)
        post = p @ a @ p  # variance of the analysis, whose square root goes back to the prior's by 0.9
        want = np.sqrt(post) * (0.9 * np.sqrt(p @ p * 1.1 / (m - 1) / post) + 0.1) if obs else np.sqrt(p @ p / (m - 1) * 1.1)
        assert spread[c]["spread"] == pytest.approx(want, abs=5e-6)
