"""Ensemble Kalman filters in the space of observations, with localised covariances, and in the subspace that the members span.

The transform of ``ensemble.py`` localises by observation errors and has its weights in the space of members. Here the gain is made of sample covariances that are
tapered themselves (Schur product): between the state and each observation, and between observations, K = (t_xy P_xy) (t_yy P_yy + R)^-1. So an increment isn't confined to
combinations of members, and a far observation's spurious covariance is gone however accurate it is.

Cells are independent given their local observations, bounded by the top-k of the local search. Python gets one row per cell, its arrays, and solves all cells of
a batch together: cells with fewer observations are filled up with ones that carry nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ensemble import normal, perturbations

#: Cells that are solved together, at most.
TOGETHER = 1024


def fifth_order(distance: np.ndarray, half: float) -> np.ndarray:
    """The correlation function of ``forward.taper``: 1 at 0, 0 from twice half on."""
    z = np.abs(distance) / half
    near = (((-0.25 * z + 0.5) * z + 0.625) * z - 5 / 3) * z * z + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        far = ((((z / 12 - 0.5) * z + 0.625) * z + 5 / 3) * z - 5) * z + 4 - 2 / (3 * z)
    return np.where(z <= 1, near, np.where(z < 2, far, 0.0))


def _power(s: np.ndarray, p: float) -> np.ndarray:
    """Powers of stacked symmetric, positive matrices."""
    values, vectors = np.linalg.eigh(s)
    return (vectors * np.maximum(values, 0)[:, None, :] ** p) @ np.swapaxes(vectors, 1, 2)


def localised_gain(x: np.ndarray, y: np.ndarray, r: np.ndarray, txy: np.ndarray, tyy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain, gain of perturbations) of stacked cells: x (cells, members) and y (cells, obs, members) are perturbations, r error variances.

    The second is the square-root gain P_xy S^-T/2 (S^1/2 + R^1/2)^-1, with which perturbations have the right spread without perturbed observations.
    """
    m = x.shape[1]
    pxy = txy * np.einsum("cm,ckm->ck", x, y) / (m - 1)
    s = tyy * (y @ np.swapaxes(y, 1, 2)) / (m - 1) + r[:, :, None] * np.eye(r.shape[1])
    gain = np.linalg.solve(s, pxy[:, :, None])[:, :, 0]
    # With tapered covariances S and R do not commute: the root of R is its diagonal.
    half = np.sqrt(r)[:, :, None] * np.eye(r.shape[1])
    root = np.linalg.solve(_power(s, 0.5) + half, (_power(s, -0.5) @ pxy[:, :, None]))[:, :, 0]
    return gain, root


def _filled(rows: list, places: int, members: int) -> tuple[np.ndarray, ...]:
    """(y, d, r, x, y coordinates, distance to the cell, noise) of cells, filled up to one number of observations."""
    k = max((len(o or []) for o in rows), default=0)
    y, noise = np.zeros((len(rows), k, members)), np.zeros((len(rows), k, members))
    d, r, at, dist = np.zeros((len(rows), k)), np.ones((len(rows), k)), np.zeros((len(rows), k, places)), np.full((len(rows), k), np.inf)
    for n, obs in enumerate(rows):
        for i, o in enumerate(obs or []):
            y[n, i], d[n, i], r[n, i], dist[n, i], at[n, i] = o["y"], o["d"], o["r"], o["dist"], (o["ox"], o["oy"])
            if o["noise"] is not None:
                noise[n, i] = o["noise"]
    return y, d, r, at, dist, noise


def localised_analysis(pairs: DataFrame, background: DataFrame, half: float, cell: str = "cell", seed: int | None = None) -> DataFrame:
    """(cell, x array): analysis members of each cell by the gain of tapered covariances.

    pairs: (cell, obs_id, ox, oy, dist, y array, d, r), the selected observations of each cell with their place, distance from the cell, perturbations in observation
    space, departure from the mean and error variance; background: (cell, x array). half: half of the distance at which covariances end. With a seed every member
    is drawn to an observation perturbed by a normal error of its own, made of hashes of observation and member and centred over members; otherwise perturbations
    take the square-root gain. A cell without observations keeps its members.
    """
    width = F.size("y")
    draws = F.transform(F.sequence(F.lit(0), width - 1), lambda m: F.sqrt("r") * normal(seed or 0, F.col("obs_id"), m))
    noise = perturbations(draws) if seed is not None else F.lit(None).cast("array<double>")
    local = pairs.withColumn("_noise", noise).groupBy(cell).agg(F.sort_array(F.collect_list(F.struct("obs_id", "ox", "oy", "dist", "y", "d", "r", F.col("_noise").alias("noise")))).alias("obs"))
    rows = background.join(local, cell, "left").select(cell, "x", "obs")
    kind = dict(background.dtypes)[cell]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                x = np.array(part.column("x").to_pylist(), float)
                y, d, r, at, dist, noise = _filled(part.column("obs").to_pylist(), 2, x.shape[1])
                mean = x.mean(axis=1, keepdims=True)
                p = x - mean
                if y.shape[1]:
                    far = np.linalg.norm(at[:, :, None, :] - at[:, None, :, :], axis=3)
                    gain, root = localised_gain(p, y, r, fifth_order(dist, half), fifth_order(far, half))
                    mean = mean + np.einsum("ck,ck->c", gain, d)[:, None]
                    p = p - np.einsum("ck,ckm->cm", root, y) if seed is None else p + np.einsum("ck,ckm->cm", gain, noise - y)
                yield pa.RecordBatch.from_arrays([part.column(cell), pa.array((mean + p).tolist(), pa.list_(pa.float64()))], [cell, "x"])

    return rows.mapInArrow(run, f"{cell} {kind}, x array<double>")


def subspace_filter(x: np.ndarray, y: np.ndarray, d: np.ndarray, r: np.ndarray, inflation: float = 0.0, least: float = 1e-10) -> np.ndarray:
    """Analysis members (variables, members) of one patch, in the basis of its covariance's eigenvectors.

    x: members of all variables of a patch; y: perturbations in observation space (obs, members). The analysis covariance in the basis gets ``inflation`` times
    its mean variance on the diagonal; what of the perturbations lies outside the basis stays. Without inflation this is the transform filter.
    """
    m = x.shape[1]
    mean = x.mean(axis=1, keepdims=True)
    p = x - mean
    values, vectors = np.linalg.eigh(p.T @ p / (m - 1))
    held = values > least * max(values.max(initial=0.0), 1e-300)
    values, vectors = values[held], vectors[:, held]
    if not len(values) or not len(d):
        return x.copy()
    size = np.sqrt((m - 1) * values)
    basis, h = p @ vectors / size, y @ vectors / size
    own = size[:, None] * vectors.T
    posterior = np.linalg.inv(np.diag(1 / values) + h.T @ (h / r[:, None]))
    step = posterior @ h.T @ (d / r)
    posterior = posterior + inflation * np.trace(posterior) / len(values) * np.eye(len(values))
    whole = np.eye(m) + own.T @ ((posterior - np.diag(values)) / values[:, None] / values[None, :]) @ own / (m - 1)
    low, turn = np.linalg.eigh(whole)
    change = (turn * np.sqrt(np.maximum(low, 0))) @ turn.T
    return mean + basis @ step[:, None] + basis @ (own @ change) + p - basis @ (basis.T @ p)


def patch_analysis(pairs: DataFrame, background: DataFrame, cell: str = "cell", inflation: float = 0.0) -> DataFrame:
    """(cell, var, x array): analysis of all variables of each patch together by :func:`subspace_filter`.

    pairs: (cell, obs_id, y array, d, r), bounded by the local search; background: (cell, var, x array), the variables (of a patch's points and levels) as var.
    """
    local = pairs.groupBy(cell).agg(F.sort_array(F.collect_list(F.struct("obs_id", "y", "d", "r"))).alias("obs"))
    fields = background.groupBy(cell).agg(F.sort_array(F.collect_list(F.struct("var", "x"))).alias("fields"))
    kinds = dict(background.dtypes)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for c, fields, obs in zip(batch.column(cell), batch.column("fields").to_pylist(), batch.column("obs").to_pylist(), strict=True):
                x = np.array([f["x"] for f in fields], float)
                obs = obs or []
                got = subspace_filter(x, np.array([o["y"] for o in obs], float).reshape(len(obs), x.shape[1]), np.array([o["d"] for o in obs], float), np.array([o["r"] for o in obs], float), inflation)
                out += [(c.as_py(), f["var"], v) for f, v in zip(fields, got.tolist(), strict=True)]
            types = [batch.schema.field(cell).type, batch.schema.field("fields").type.value_type.field("var").type, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in enumerate(types)], [cell, "var", "x"])

    return fields.join(local, cell, "left").select(cell, "fields", "obs").mapInArrow(run, f"{cell} {kinds[cell]}, var {kinds['var']}, x array<double>")
