"""Ensemble statistics, inflation and the local ensemble transform."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_spread(members: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """Mean and spread (N - 1) over members."""
    return members.groupBy(*cell).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread"))


def array_mean(ens: Column) -> Column:
    return F.aggregate(ens, F.lit(0.0), lambda a, x: a + x) / F.size(ens)


def perturbations(ens: Column) -> Column:
    """Departures of each member from the mean; they add up to zero."""
    m = array_mean(ens)
    return F.transform(ens, lambda x: x - m)


def observation_departure(obs: Column, ens: Column) -> tuple[Column, Column]:
    """(observation minus ensemble mean, perturbations in observation space)."""
    return obs - array_mean(ens), perturbations(ens)


def inflate(ens: Column, factor: Column | float) -> Column:
    """Multiplies perturbations by sqrt(factor) round the mean."""
    m, f = array_mean(ens), F.sqrt(F.lit(factor) if isinstance(factor, (int, float)) else factor)
    return F.transform(ens, lambda x: m + f * (x - m))


def additive_inflation(ens: Column, extra: Column, scale: float) -> Column:
    """Adds scaled, centred perturbations to the members."""
    return F.zip_with(ens, perturbations(extra), lambda a, b: a + scale * b)


def limit_spread(ens: Column, most: float) -> Column:
    """Caps the ratio of spread to mean at most, by shrinking perturbations."""
    m = array_mean(ens)
    var = F.aggregate(ens, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (F.size(ens) - 1)
    ratio = F.try_divide(F.sqrt(var), m)
    return F.when(ratio > most, F.transform(ens, lambda x: m + (x - m) * most / ratio)).otherwise(ens)


def boundary_weight(x: Column, y: Column, x1: float, y1: float, width: float) -> Column:
    """Ramp from 0 at the edge of the domain [0, x1] x [0, y1] to 1 at width inside."""
    edge = F.least(x, F.lit(x1) - x, y, F.lit(y1) - y)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), edge / width))


def single_obs_weights(members: DataFrame, cell: Sequence[str], y: str, d: str, r: str, rho: float) -> DataFrame:
    """Mean weights of the transform for one observation per cell, in closed form: y d / (r c + |y|^2), c = (m - 1) / rho."""
    w = Window.partitionBy(*cell)
    n = F.count(F.lit(1)).over(w)
    yy = F.sum(F.col(y) * F.col(y)).over(w)
    return members.withColumn("w", F.col(y) * F.col(d) / (F.col(r) * (n - 1) / rho + yy))


def local_transform(y: np.ndarray, d: np.ndarray, r: np.ndarray, rho: float = 1.0, relax: float = 0.0, relax_spread: float = 0.0, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean weights, transform matrix) from perturbations y (obs, members), departures d and error variances r.

    r is already divided by the localisation weight. relax blends in the prior perturbations; relax_spread brings
    the posterior spread of the variable x (members' perturbations) back to its prior one.
    """
    m = y.shape[1]
    if not len(d):
        return np.zeros(m), np.eye(m) * np.sqrt(rho)
    yr = y / r[:, None]
    values, vectors = np.linalg.eigh(yr.T @ y + np.eye(m) * (m - 1) / rho)
    inverse = vectors / values
    w = inverse @ vectors.T @ yr.T @ d
    t = vectors * np.sqrt((m - 1) / values) @ vectors.T
    if relax:
        t = (1 - relax) * t + relax * np.sqrt(rho) * np.eye(m)
    if relax_spread and x is not None:
        prior, post = x @ x, x @ (inverse @ vectors.T) @ x * (m - 1)
        if prior > 0 and post > 0:
            t = t * (relax_spread * np.sqrt(prior * rho / post) - relax_spread + 1)
    return w, t


def serial_filter(x: np.ndarray, y: np.ndarray, d: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Analysis members by a serial square-root filter: observations one after another.

    x: members of a variable; y: perturbations in observation space (obs, members); d: departures; r: error variances. With
    linear operators its mean is that of the transform filter.
    """
    m = len(x)
    mean, p, y, d = x.mean(), x - x.mean(), y.copy(), d.copy()
    for n in range(len(d)):
        v = y[n] @ y[n] / (m - 1)
        if v == 0:
            continue
        a = 1 / (1 + np.sqrt(r[n] / (v + r[n])))
        gain_x, gain_y = p @ y[n] / (m - 1) / (v + r[n]), y @ y[n] / (m - 1) / (v + r[n])
        mean, own, step = mean + gain_x * d[n], y[n].copy(), d[n]
        d = d - gain_y * step
        p = p - a * gain_x * own
        y = y - a * np.outer(gain_y, own)
    return mean + p


def analyse(pairs: DataFrame, background: DataFrame, cell: str = "cell", rho: float = 1.0, relax: float = 0.0, relax_spread: float = 0.0, serial: bool = False) -> DataFrame:
    """Analysis members of each cell, by the transform or, with serial, by the serial square-root filter (which takes no inflation or relaxation).

    pairs: (cell, y array, d, r), the selected observations of each cell, bounded by the top-k of the local search.
    background: (cell, x array). A cell without observations keeps its members, inflated. One row per cell goes to Python: its arrays.
    """
    local = pairs.groupBy(cell).agg(F.collect_list(F.struct("y", "d", "r")).alias("obs"))  # at most k per cell and group
    rows = background.join(local, cell, "left").select(cell, "x", "obs")
    kind = dict(background.dtypes)[cell]

    def run(batches):
        for pdf in batches:
            out = []
            for x, obs in zip(pdf["x"], pdf["obs"], strict=True):
                x = np.asarray(x, float)
                obs = [] if obs is None else sorted(obs, key=lambda o: (o["d"], o["r"], tuple(o["y"])))
                y = np.array([o["y"] for o in obs], float).reshape(len(obs), len(x))
                p = x - x.mean()
                if serial:
                    out.append(serial_filter(x, y, np.array([o["d"] for o in obs], float), np.array([o["r"] for o in obs], float)).tolist())
                    continue
                w, t = local_transform(y, np.array([o["d"] for o in obs], float), np.array([o["r"] for o in obs], float), rho, relax, relax_spread, p)
                out.append((x.mean() + p @ (t + w[:, None])).tolist())
            yield pd.DataFrame({cell: pdf[cell], "x": out})

    return rows.mapInPandas(run, f"{cell} {kind}, x array<double>")


def global_transform(obs: DataFrame, parameters: DataFrame, rho: float = 1.0) -> DataFrame:
    """Transform of a few global parameters by all observations, without localisation.

    The m x m matrices are sums over observations, so that only m * m + m numbers leave the executors.
    obs: (y array, d, r); parameters: (name, x array). Returns parameters with analysis members.
    """
    pairs = obs.select(F.posexplode("y").alias("a", "ya"), "y", "d", "r").select("a", "ya", F.posexplode("y").alias("b", "yb"), "d", "r")
    sums = pairs.groupBy("a", "b").agg(F.sum(F.col("ya") * F.col("yb") / F.col("r")).alias("c"), F.sum(F.col("ya") * F.col("d") / F.col("r")).alias("e")).collect()  # m * m rows
    m = 1 + max((s["a"] for s in sums), default=-1)
    c, e = np.zeros((m, m)), np.zeros(m)
    for s in sums:
        c[s["a"], s["b"]] = s["c"]
        e[s["a"]] = s["e"]
    values, vectors = np.linalg.eigh(c + np.eye(m) * (m - 1) / rho)
    w = vectors / values @ vectors.T @ e
    t = vectors * np.sqrt((m - 1) / values) @ vectors.T
    g = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in (t + w[:, None]).T])
    mean = array_mean(F.col("x"))
    p = perturbations(F.col("x"))
    return parameters.select("name", F.transform(g, lambda col: mean + F.aggregate(F.zip_with(p, col, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("x"))


def observation_impact(pairs: DataFrame, forecast: DataFrame, cell: str = "cell") -> DataFrame:
    """Sensitivity of a forecast error norm to each observation.

    pairs: (cell, obs_id, y array, d, r); forecast: (cell, f array, e): forecast perturbations and error of each cell,
    weighted as the norm asks. Impact: d / r * sum over cells of (y . f) e / (m - 1), fully relational.
    """
    met = pairs.join(forecast, cell)
    dot = F.aggregate(F.zip_with("y", "f", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    part = F.col("d") / F.col("r") * dot * F.col("e") / (F.size("y") - 1)
    return met.groupBy("obs_id").agg(F.sum(part).alias("impact"))


def adaptive_inflation(pairs: DataFrame, prior: DataFrame, sigma_b: float, cell: str = "cell") -> DataFrame:
    """The inflation of each cell, updated by how large its departures are against what ensemble and errors explain.

    pairs: (cell, y array, d, r, weight), r already divided by the localisation weight; prior: (cell, inflation). The observed
    inflation (sum d^2 / r - sum of weights) / (sum |y|^2 / r / (m - 1)) has the error variance 2 / W ((i P + W) / P)^2, W the sum of weights
    and P the denominator, the prior one sigma_b^2; the result is their weighted mean. A cell without observations or spread keeps its own.
    """
    yy = F.aggregate("y", F.lit(0.0), lambda s, v: s + v * v) / (F.size("y") - 1)
    sums = pairs.groupBy(cell).agg(F.sum(F.col("d") * F.col("d") / F.col("r")).alias("_dd"), F.sum(yy / F.col("r")).alias("_p"), F.sum("weight").alias("_w"))
    own, p, w = F.col("inflation"), F.col("_p"), F.col("_w")
    ratio = F.try_divide(own * p + w, p)
    error = F.try_divide(F.lit(2.0), w) * ratio * ratio
    gain = sigma_b**2 / (error + sigma_b**2)
    new = own + gain * (F.try_divide(F.col("_dd") - w, p) - own)
    return prior.join(sums, cell, "left").select(cell, F.coalesce(new, own).alias("inflation"))


def analyse_variables(pairs: DataFrame, background: DataFrame, factors: DataFrame, rho: float = 1.0, relax: float = 0.0, relax_spread: float = 0.0, cell: Sequence[str] = ("cell",), inflation: DataFrame | None = None) -> DataFrame:
    """Analysis members of every variable at every point of the grid, with localisation by variable.

    pairs: (cell..., elm, y array, d, r), the selected observations of each point, bounded by the top-k of the local search;
    background: (cell..., var, x array); factors: (var, elm, factor), by which an observation's weight is multiplied for a variable: zero or no
    row leaves it out. cell names the columns of a point, as column and level. inflation: (cell..., inflation) of each point in place of rho.

    Variables with the same factors share one transform, so that a point's matrix is made once for each kind of variable. One row per
    point and kind goes to Python: its arrays.
    """
    kinds = factors.filter(F.col("factor") > 0).groupBy("var").agg(F.sort_array(F.collect_list(F.struct("elm", "factor"))).alias("own"))  # one row per variable
    kinds = kinds.withColumn("kind", F.to_json("own"))
    by = [*cell, "kind"]
    wanted = kinds.select("kind", "own").distinct().select("kind", F.explode("own").alias("o")).select("kind", F.col("o.elm").alias("elm"), F.col("o.factor").alias("factor"))
    obs = pairs.join(wanted, "elm").withColumn("r", F.col("r") / F.col("factor")).groupBy(*by).agg(F.collect_list(F.struct("y", "d", "r")).alias("obs"))
    fields = background.join(kinds.select("var", "kind"), "var", "left").withColumn("kind", F.coalesce("kind", F.lit(""))).groupBy(*by).agg(F.collect_list(F.struct("var", "x")).alias("fields"))
    rows = fields.join(obs, by, "left")
    rows = rows.join(inflation, list(cell), "left").withColumn("inflation", F.coalesce("inflation", F.lit(float(rho)))) if inflation is not None else rows.withColumn("inflation", F.lit(float(rho)))
    types = dict(background.dtypes)
    out = ", ".join(f"{c} {types[c]}" for c in [*cell, "var"]) + ", x array<double>"

    def run(batches):
        for pdf in batches:
            done = []
            for n, (own, obs, rho) in enumerate(zip(pdf["fields"], pdf["obs"], pdf["inflation"], strict=True)):
                obs = [] if obs is None else sorted(obs, key=lambda o: (o["d"], o["r"], tuple(o["y"])))
                m = len(own[0]["x"])
                y = np.array([o["y"] for o in obs], float).reshape(len(obs), m)
                d, r = np.array([o["d"] for o in obs], float), np.array([o["r"] for o in obs], float)
                shared = None
                for f in own:
                    x = np.asarray(f["x"], float)
                    p = x - x.mean()
                    if relax_spread or shared is None:  # the spread to return to is the variable's own
                        shared = local_transform(y, d, r, rho, relax, relax_spread, p)
                    w, t = shared
                    done.append((n, f["var"], (x.mean() + p @ (t + w[:, None])).tolist()))
            at = [r[0] for r in done]
            yield pd.DataFrame({**{c: pdf[c].iloc[at].to_numpy() for c in cell}, "var": [r[1] for r in done], "x": [r[2] for r in done]})

    return rows.mapInPandas(run, out)


def impact_table(impact: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number, sum and mean of observation impacts and the share that improves the forecast, by keys and over all, as element, type or region."""
    t = impact.groupBy(*keys).agg(F.count("impact").alias("n"), F.sum("impact").alias("total"), F.avg("impact").alias("mean"), F.avg(F.when(F.col("impact") < 0, 1.0).otherwise(0.0)).alias("good"))
    return t


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number made of hashes of the keys: the same however the rows are partitioned."""
    u = lambda n: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(n), *keys), 11) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))


def perturb(state: DataFrame, members: int, scale: dict[str, float], keys: Sequence[str], seed: int = 0) -> DataFrame:
    """An initial ensemble: each row once per member (from 1), the named variables with normal errors of the given deviations, which add up to zero over members."""
    each = state.withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(members))))
    for name, sd in scale.items():
        draws = [normal(seed, F.lit(name), F.lit(m), *keys) for m in range(1, members + 1)]
        mean = fold(lambda a, b: a + b, draws) / members
        each = each.withColumn(name, F.col(name) + sd * (normal(seed, F.lit(name), F.col("member"), *keys) - mean))
    return each
