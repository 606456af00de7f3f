"""Tridiagonal systems along lines of any length, by elimination of blocks.

A line is cut into blocks. Inside a block every unknown is a linear function of its two outer neighbours, so that a block leaves two equations, of its first and its last
unknown; these make a tridiagonal system again, shorter by half a block's size, which is solved in the same way. With blocks of a thousand rows a line of a
million needs two rounds. A task holds a block at a time, never a line, and solves all blocks of a batch together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("low", "mid", "high", "rhs")


def thomas_together(low: np.ndarray, mid: np.ndarray, high: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solutions of stacked systems: low, mid, high (systems, n), rhs (systems, n, right sides); low[:, 0] and high[:, -1] are not used."""
    n = mid.shape[1]
    c, d = np.zeros(mid.shape), np.zeros(rhs.shape)
    for i in range(n):
        m = mid[:, i] - (low[:, i] * c[:, i - 1] if i else 0.0)
        c[:, i] = high[:, i] / m
        d[:, i] = (rhs[:, i] - (low[:, i, None] * d[:, i - 1] if i else 0.0)) / m[:, None]
    for i in range(n - 2, -1, -1):
        d[:, i] -= c[:, i, None] * d[:, i + 1]
    return d


def _blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(index, whether there is a row, rows of each block, coefficients) of a batch, filled up with rows of the identity."""
    rows = batch.column("rows")
    count = np.diff(rows.offsets.to_numpy())
    own, flat = np.repeat(np.arange(batch.num_rows), count), rows.flatten()
    place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    shape = (batch.num_rows, int(count.max(initial=1)))
    held, index = np.zeros(shape, bool), np.zeros(shape, np.int64)
    held[own, place], index[own, place] = True, flat.field("i").to_numpy()
    values = {}
    for name in NAMES:
        values[name] = np.full(shape, 1.0 if name == "mid" else 0.0)
        values[name][own, place] = flat.field(name).to_numpy(zero_copy_only=False)
    return index, held, count, values


def _inner(count: np.ndarray, v: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, p, q) of each block: unknowns are y - p * low of the first row * left neighbour - q * high of the last row * right neighbour."""
    at, last = np.arange(len(count)), count - 1
    right = np.zeros((*v["mid"].shape, 3))
    right[:, :, 0], right[:, 0, 1], right[at, last, 2] = v["rhs"], 1.0, 1.0
    high = v["high"].copy()
    high[at, last] = 0.0
    low = v["low"].copy()
    low[:, 0] = 0.0
    out = thomas_together(low, v["mid"], high, right)
    return out[:, :, 0], out[:, :, 1], out[:, :, 2]


def solve(systems: DataFrame, keys: Sequence[str], index: str, n: int, block: int = 1024) -> DataFrame:
    """(keys, index, x) of systems (keys, index, low, mid, high, rhs): low * x[index - 1] + mid * x + high * x[index + 1] = rhs.

    Indexes lie in 0 .. n - 1; an index that is left out is no unknown, and its neighbours in order are next to each other. The first low and the last high of a line are not used. Systems
    should be diagonally dominant, as those of diffusion and of splines are: there is no pivoting.
    """
    if block < 4:
        raise ValueError("a block has four rows at least, or it would not make the line shorter")
    kinds = dict(systems.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys) + (", " if keys else "")
    plain = systems.select(*keys, F.col(index).cast("long").alias("_i"), *[F.col(c).cast("double").alias(c) for c in NAMES])
    part = F.floor(F.col("_i") / block) if n > block else F.lit(0).cast("long")
    lines = plain.groupBy(*keys, part.alias("_b")).agg(F.sort_array(F.collect_list(F.struct(F.col("_i").alias("i"), *NAMES))).alias("rows"))

    def spread(batch: pa.RecordBatch, which: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(which)) for k in keys] + [pa.array(c) for c in columns.values()], [*keys, *columns])

    def direct(batches):
        for batch in batches:
            index_, held, count, v = _blocks(batch)
            last = count - 1
            v["low"][:, 0], v["high"][np.arange(len(count)), last] = 0.0, 0.0
            x = thomas_together(v["low"], v["mid"], v["high"], v["rhs"][:, :, None])[:, :, 0]
            yield spread(batch, np.nonzero(held)[0], {"_i": index_[held], "x": x[held]})

    if n <= block:
        return lines.mapInArrow(direct, f"{head}_i long, x double").select(*keys, F.col("_i").cast(kinds[index]).alias(index), "x")

    def outer(batches):
        for batch in batches:
            _, _, count, v = _blocks(batch)
            y, p, q = _inner(count, v)
            at, last = np.arange(len(count)), count - 1
            low, high = v["low"][:, 0], v["high"][at, last]
            one = count == 1
            # The first unknown without the right neighbour, the last one without the left; a single row stays as it is.
            s, t = q[:, 0] / q[at, last], p[at, last] / p[:, 0]
            first = {"low": low * (p[:, 0] - s * p[at, last]), "mid": np.ones(len(count)), "high": -s, "rhs": y[:, 0] - s * y[at, last]}
            ends = {"low": -t, "mid": np.ones(len(count)), "high": high * (q[at, last] - t * q[:, 0]), "rhs": y[at, last] - t * y[:, 0]}
            single = {"low": low, "mid": v["mid"][:, 0], "high": high, "rhs": v["rhs"][:, 0]}
            b = batch.column("_b").to_numpy()
            yield spread(batch, at, {"_i": 2 * b, **{c: np.where(one, single[c], first[c]) for c in NAMES}})
            yield spread(batch, at[~one], {"_i": 2 * b[~one] + 1, **{c: ends[c][~one] for c in NAMES}})

    reduced = lines.mapInArrow(outer, f"{head}_i long, " + ", ".join(f"{c} double" for c in NAMES))
    solved = solve(reduced, keys, "_i", 2 * (-(-n // block)), block)
    # Neighbours in order: of each block the last unknown before it and the first behind it.
    w = Window.partitionBy(*keys).orderBy("_b")
    ends = solved.groupBy(*keys, F.expr("_i div 2").alias("_b")).agg(F.min_by("x", "_i").alias("first"), F.max_by("x", "_i").alias("last"))
    ends = ends.select(*keys, "_b", F.coalesce(F.lag("last").over(w), F.lit(0.0)).alias("left"), F.coalesce(F.lead("first").over(w), F.lit(0.0)).alias("right"))

    def inner(batches):
        for batch in batches:
            index_, held, count, v = _blocks(batch)
            y, p, q = _inner(count, v)
            low, high = v["low"][:, 0], v["high"][np.arange(len(count)), count - 1]
            left, right = (batch.column(c).to_numpy() for c in ("left", "right"))
            x = y - p * (low * left)[:, None] - q * (high * right)[:, None]
            yield spread(batch, np.nonzero(held)[0], {"_i": index_[held], "x": x[held]})

    joined = lines.join(ends, [*keys, "_b"]).select(*keys, "_b", "rows", "left", "right")
    return joined.mapInArrow(inner, f"{head}_i long, x double").select(*keys, F.col("_i").cast(kinds[index]).alias(index), "x")
