"""Reduction of samples to cells and of series to intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def radar_superob(samples: DataFrame, cell: Sequence[str], z: str = "z", vr: str = "vr", most_deviation: float | None = None) -> DataFrame:
    """Mean of (linear) reflectivity, velocity weighted by reflectivity, their counts; a velocity whose population deviation is too great is void."""
    w = F.when(F.col(vr).isNotNull(), F.col(z))
    out = samples.groupBy(*cell).agg(
        F.avg(z).alias("z"), F.try_divide(F.sum(F.col(vr) * F.col(z)), F.sum(w)).alias("vr"), F.count(z).alias("n_z"), F.count(vr).alias("n_vr"), F.stddev_pop(vr).alias("_sd")
    )
    if most_deviation is not None:
        wild = F.col("_sd") > most_deviation
        out = out.withColumn("vr", F.when(~wild, F.col("vr"))).withColumn("n_vr", F.when(wild, F.lit(0).cast("long")).otherwise(F.col("n_vr")))
    return out.drop("_sd")


def superob(obs: DataFrame, cell: Sequence[str], method: int, value: str = "dat", err: str = "err", distance: str = "dist", row: str = "obs_id") -> DataFrame:
    """One row per cell (method 0: all rows).

    1 keeps the row with the least error, of equal ones the nearest to the centre; 2 averages all rows, with the least error;
    3 averages the rows that have the least error. Combined before the shuffle, no window over a cell's rows.
    """
    if method == 0:
        return obs
    if method == 1:
        best = F.min(F.struct(err, distance, row, value))
        return obs.groupBy(*cell).agg(best.alias("b")).select(*cell, F.col(f"b.{value}").alias(value), F.col(f"b.{err}").alias(err), F.col(f"b.{row}").alias(row))
    if method == 2:
        return obs.groupBy(*cell).agg(F.avg(value).alias(value), F.min(err).alias(err), F.count(F.lit(1)).alias("n"))
    if method == 3:
        # Sums by error first: a cell has few distinct errors at its minimum.
        by = obs.groupBy(*cell, err).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
        best = F.min(F.struct(err, "s", "n"))
        return by.groupBy(*cell).agg(best.alias("b")).select(*cell, F.try_divide(F.col("b.s"), F.col("b.n")).alias(value), F.col(f"b.{err}").alias(err), F.col("b.n").alias("n"))
    raise ValueError("method must be 0, 1, 2 or 3")


def slot_reduction(obs: DataFrame, same: Sequence[str], slot: str, base: int, seq: str, method: int = 1) -> DataFrame:
    """Of rows at one place keeps the one in the slot nearest to base, the earlier slot on a tie, the first in it; method 2 takes base-slot rows only."""
    rows = obs.filter(F.col(slot) == base) if method == 2 else obs
    rest = [c for c in obs.columns if c not in same]
    best = F.min(F.struct(F.abs(F.col(slot) - base).alias("_d"), F.col(slot).alias("_s"), F.col(seq).alias("_q"), *rest))
    return rows.groupBy(*same).agg(best.alias("b")).select(*same, *[F.col(f"b.{c}").alias(c) for c in rest])


def islands(rows: DataFrame, order: Sequence[str], same: Sequence[str], within: Sequence[str], name: str = "island") -> DataFrame:
    """Numbers runs of consecutive rows that agree in ``same``, inside each ``within`` group."""
    if not within:
        raise ValueError("within must name the groups: a window over all rows would be one task")
    w = Window.partitionBy(*[F.col(c) for c in within]).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    marked = rows.withColumn("_new", F.when(first | changed, 1).otherwise(0))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def column_reduce(cells: DataFrame, column: Sequence[str], value: str, level: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Greatest, least, sum and plain average over the levels of each column."""
    if low is not None:
        cells = cells.filter(F.col(level) >= low)
    if high is not None:
        cells = cells.filter(F.col(level) <= high)
    return cells.groupBy(*column).agg(F.max(value).alias("most"), F.min(value).alias("least"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def poisoned(statistic: Column, value: Column) -> Column:
    """statistic, missing if any sample of the interval is (history policy)."""
    return F.when(F.count(value) == F.count(F.lit(1)), statistic)


def history(series: DataFrame, interval: Column, keys: Sequence[str], value: str, dt: str, op: str, skip_missing: bool) -> DataFrame:
    """mean (weighted by dt), min, max or none (the last sample) of each interval.

    skip_missing False: one missing sample makes the interval missing. True: missing samples do not count.
    """
    v, w = F.col(value), F.col(dt)
    known = F.when(v.isNotNull(), w)
    stat = {"mean": F.try_divide(F.sum(v * w), F.sum(known)), "min": F.min(v), "max": F.max(v)}
    if op == "none":
        out = F.max_by(F.col(value), F.col("_t"))
    else:
        out = stat[op] if skip_missing else poisoned(stat[op], v)
    return series.groupBy(*keys, interval.alias("interval")).agg(out.alias(value))


def time_average(series: DataFrame, keys: Sequence[str], step: str, value: str, n: int) -> DataFrame:
    """Averages of n steps each that skip missing samples; a group without any is 0.0, and a last group of fewer steps is dropped."""
    g = F.floor((F.col(step) - 1) / n)
    out = series.groupBy(*keys, g.alias("group")).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(value), F.max(step).alias("_last"))
    return out.filter(F.col("_last") == (F.col("group") + 1) * n).drop("_last")


def calendar_average(series: DataFrame, keys: Sequence[str], ts: str, value: str, period: str) -> DataFrame:
    """Averages by day, month or year that skip missing samples; the last period counts even if it is not full; 0.0 without samples."""
    return series.groupBy(*keys, F.date_trunc(period, ts).cast("date").alias("period")).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(value))


def category_share(samples: DataFrame, cell: Sequence[str], category: str, weight: Column, top: int, default: str | None = None, cells: DataFrame | None = None) -> DataFrame:
    """The top classes of each cell by weight, with shares that add up to 1; cells without any get the default class."""
    by = samples.filter(F.col(category).isNotNull()).groupBy(*cell, category).agg(F.sum(weight).alias("w"))
    order = Window.partitionBy(*cell).orderBy(F.col("w").desc(), category)  # at most one row per class
    ranked = by.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = ranked.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*cell))).drop("w")
    if cells is not None:
        empty = cells.select(*cell).distinct().join(by.select(*cell).distinct(), list(cell), "left_anti")
        out = out.unionByName(empty.select(*cell, F.lit(default).alias(category), F.lit(1).alias("rank"), F.lit(1.0).alias("share")))
    return out


def lanczos_weights(cutoff: float, resolution: int = 10) -> list[float]:
    """Low-pass weights for offsets -resolution .. resolution; cutoff is an angular frequency in [0, pi].

    The ideal filter's weight sin(c l) / (pi l), c / pi at 0, times the window sin(pi l / n) / (pi l / n). They are not scaled.
    """
    import math

    def weight(k: int) -> float:
        return cutoff / math.pi if k == 0 else math.sin(cutoff * k) / (math.pi * k) * math.sin(math.pi * k / resolution) / (math.pi * k / resolution)

    return [weight(k) for k in range(-resolution, resolution + 1)]


def lanczos(series: DataFrame, index: str, value: str, n: int, weights: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Weighted moving window over indexes 0 .. n - 1, joined end to end: each sample is sent to the windows that it is in."""
    half = len(weights) // 2
    spread = series.select(*keys, index, value, F.posexplode(F.array(*[F.lit(float(w)) for w in weights])).alias("o", "w"))
    at = F.pmod(F.col(index) + F.col("o") - half, F.lit(n))
    return spread.groupBy(*keys, at.alias(index)).agg(F.sum(F.col(value) * F.col("w")).alias(value))


def diffusion_step(cells: DataFrame, i: str, j: str, value: str, ni: int, nj: int) -> DataFrame:
    """One pass of the two-dimensional second-difference filter on a full grid 0 .. ni - 1, 0 .. nj - 1.

    Sum over the existing neighbours of (own - neighbour), over 8 inside, 6 on an edge and 4 in a corner.
    """
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    out = cells.select(F.col(i), F.col(j), F.col(value), F.explode(moves).alias("m")).select((F.col(i) + F.col("m.a")).alias(i), (F.col(j) + F.col("m.b")).alias(j), F.lit(0).alias("own"), F.col(value).alias("v"))
    both = cells.select(i, j, F.lit(1).alias("own"), F.col(value).alias("v")).unionByName(out.filter(F.col(i).between(0, ni - 1) & F.col(j).between(0, nj - 1)))
    own, near = F.max(F.when(F.col("own") == 1, F.col("v"))), F.sum(F.when(F.col("own") == 0, F.col("v")))
    n = F.count(F.when(F.col("own") == 0, 1))
    # Only cells that exist have a result; one without neighbours has none.
    return both.groupBy(i, j).agg(F.try_divide(n * own - near, 2 * n).alias(value), F.count(F.when(F.col("own") == 1, 1)).alias("_own")).filter("_own > 0").drop("_own")


def _second_difference(v: np.ndarray, held: np.ndarray) -> np.ndarray:
    """diffusion_step on an array: v with nan for missing values, held where there is a cell."""
    n, known, near = np.zeros(v.shape), np.zeros(v.shape), np.zeros(v.shape)
    own, some = np.where(np.isnan(v), 0.0, v), ~np.isnan(v)
    for to, of in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
        for x, y in ((to, of), (of, to)):
            n[x] += held[y]
            known[x] += some[y]
            near[x] += own[y]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(held & (known > 0), (n * v - near) / (2 * n), np.nan)


def _tiles(i: str, j: str, value: str, order: int, iterations: int, tile: int, halo: int):
    size = tile + 2 * halo

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        ti, tj = table.column("_ti")[0].as_py(), table.column("_tj")[0].as_py()
        a, b = (column(c) - t * tile + halo for c, t in ((i, ti), (j, tj)))
        v, held, sign = np.full((size, size), np.nan), np.zeros((size, size), bool), np.full((size, size), np.nan)
        v[a, b], held[a, b], sign[a, b] = column("_v"), True, column("_sign")
        for _ in range(iterations):
            rough = v
            for _ in range(order):
                rough = _second_difference(rough, held)
            v = v - rough
            v = np.where(np.isnan(sign), v, sign * np.maximum(sign * v, 0.0))
        own = (a >= halo) & (a < halo + tile) & (b >= halo) & (b < halo + tile)
        out = v[a[own], b[own]]
        return pa.table({i: pa.array(column(i)[own], pa.int64()), j: pa.array(column(j)[own], pa.int64()), value: pa.array(out, pa.float64(), mask=np.isnan(out)), "_sign": pa.array(column("_sign")[own], pa.float64())})

    return run


def hyperdiffusion(cells: DataFrame, i: str, j: str, value: str, ni: int, nj: int, order: int = 2, iterations: int = 1, limiter: str | None = None, tile: int = 256) -> DataFrame:
    """Takes from each cell its ``order`` times repeated second difference (see diffusion_step), ``iterations`` times over.

    limiter: a column whose sign the value may not leave; it becomes zero instead. order must be even. Returns (i, j, value).

    The grid is cut into square tiles, each with a rim of the cells that reach it in some iterations: one shuffle for as many iterations as fit into a rim of a
    quarter of a tile, and a plan that grows by one exchange for each such round. A task holds one tile at a time.
    """
    if order % 2:
        raise ValueError("order must be even")
    kinds = dict(cells.dtypes)
    sign = F.when(F.col(limiter) < 0, -1.0).otherwise(1.0) if limiter else F.lit(None).cast("double")
    inside = F.col(i).between(0, ni - 1) & F.col(j).between(0, nj - 1)
    data = cells.filter(inside).select(F.col(i).cast("long").alias(i), F.col(j).cast("long").alias(j), F.col(value).cast("double").alias(value), sign.alias("_sign"))
    left = iterations
    while left:
        # An iteration reaches order cells far.
        now = min(left, max(1, tile // 4 // order))
        halo = now * order
        reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))  # noqa: E731, B023
        near = data.select(i, j, F.col(value).alias("_v"), "_sign", F.explode(reach(i)).alias("_ti")).select("*", F.explode(reach(j)).alias("_tj"))
        near = near.filter(F.col("_ti").between(0, (ni - 1) // tile) & F.col("_tj").between(0, (nj - 1) // tile))
        data = near.groupBy("_ti", "_tj").applyInArrow(_tiles(i, j, value, order, now, tile, halo), f"{i} long, {j} long, {value} double, _sign double")
        left -= now
    return data.select(F.col(i).cast(kinds[i]).alias(i), F.col(j).cast(kinds[j]).alias(j), value)
