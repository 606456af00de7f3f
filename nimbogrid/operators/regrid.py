"""Application of interpolation weights, vertical and horizontal regridding, splines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_weights(weights: DataFrame, values: DataFrame, target: Sequence[str], row: str, value: str, least: float = 1.0, log: bool = False) -> DataFrame:
    """Weighted mean of the values that are not missing; missing when their weight is below ``least``. log averages logarithms."""
    met = weights.join(values.select(row, value), row)
    v = F.ln(value) if log else F.col(value)
    known = F.sum(F.when(F.col(value).isNotNull(), F.col("w")))
    mean = F.try_divide(F.sum(v * F.col("w")), known)
    out = F.when(known >= least - 1e-12, F.exp(mean) if log else mean)
    return met.groupBy(*target).agg(out.alias(value), known.alias("known"))


def remap(table: DataFrame, values: DataFrame, source: str, target: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Regrids with a table (source, target, w) made once: an equi-join and a sum."""
    return values.join(table, source).groupBy(*keys, target).agg(F.sum(F.col(value) * F.col("w")).alias(value))


def lonlat_axis(spark, x0: float, x1: float, y0: float, y1: float, dx: float) -> DataFrame:
    """Points (ix, iy, x, y) of a regular target grid."""
    nx, ny = int(round((x1 - x0) / dx)) + 1, int(round((y1 - y0) / dx)) + 1
    p = spark.range(nx * ny)
    return p.select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy")).select("ix", "iy", (x0 + F.col("ix") * dx).alias("x"), (y0 + F.col("iy") * dx).alias("y"))


def quadratic(df: DataFrame, column: Sequence[str], level: str, value: str, at: Column) -> DataFrame:
    """Lagrange parabola through a level and its two neighbours, at a place near the middle one (rows without both are dropped)."""
    w = Window.partitionBy(*column).orderBy(level)
    z = [F.lag(level).over(w), F.col(level), F.lead(level).over(w)]
    v = [F.lag(value).over(w), F.col(value), F.lead(value).over(w)]
    d = df
    for n, (a, b) in enumerate(zip(z, v, strict=True)):
        d = d.withColumn(f"_z{n}", a).withColumn(f"_v{n}", b)
    d = d.filter("_z0 is not null and _z2 is not null").withColumn("_at", at)
    c = [F.col(f"_z{n}") for n in range(3)]
    total = F.lit(0.0)
    for n in range(3):
        a, b = (c[m] for m in range(3) if m != n)
        total = total + F.col(f"_v{n}") * (F.col("_at") - a) * (F.col("_at") - b) / ((c[n] - a) * (c[n] - b))
    return d.withColumn(value, total).drop(*[f"_{p}{n}" for p in "zv" for n in range(3)], "_at")


def spline_coefficients(z: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Second derivatives of the cubic spline through (z, v) whose ends have those of their neighbours."""
    n = len(z)
    u = np.zeros(n)
    if n < 4:
        return u
    h = np.diff(z)
    rhs = 6 * (np.diff(v[1:]) / h[1:] - np.diff(v[:-1]) / h[:-1])
    low, mid, high = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    mid[0] += h[0]
    mid[-1] += h[-1]
    low[0] = high[-1] = 0
    u[1:-1] = thomas(low, mid, high, rhs)
    u[0], u[-1] = u[1], u[-2]
    return u


def thomas(low: np.ndarray, mid: np.ndarray, high: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves a tridiagonal system; low[0] and high[-1] are not used."""
    n = len(mid)
    c, d, x = np.zeros(n), np.zeros(n), np.zeros(n)
    c[0], d[0] = high[0] / mid[0], rhs[0] / mid[0]
    for i in range(1, n):
        m = mid[i] - low[i] * c[i - 1]
        c[i], d[i] = high[i] / m, (rhs[i] - low[i] * d[i - 1]) / m
    x[-1] = d[-1]
    for i in range(n - 2, -1, -1):
        x[i] = d[i] - c[i] * x[i + 1]
    return x


def spline_at(z: np.ndarray, v: np.ndarray, t: np.ndarray, near: float = 1e-6) -> np.ndarray:
    """Spline values at t: missing values and near-duplicate levels are left out; linear with three levels or fewer and outside them."""
    ok = ~(np.isnan(z) | np.isnan(v))
    z, v = z[ok], v[ok]
    order = np.argsort(z, kind="stable")
    z, v = z[order], v[order]
    keep = np.r_[True, np.diff(z) > near] if len(z) else np.empty(0, bool)
    z, v = z[keep], v[keep]
    if len(z) < 2:
        return np.full(len(t), np.nan)
    u = spline_coefficients(z, v)
    k = np.clip(np.searchsorted(z, t, side="right") - 1, 0, len(z) - 2)
    h = z[k + 1] - z[k]
    a, b = (z[k + 1] - t) / h, (t - z[k]) / h
    out = a * v[k] + b * v[k + 1]
    inside = (t >= z[0]) & (t <= z[-1])
    return np.where(inside, out + ((a**3 - a) * u[k] + (b**3 - b) * u[k + 1]) * h * h / 6, out)


def vertical_spline(levels: DataFrame, column: Sequence[str], level: str, value: str, targets: Sequence[float]) -> DataFrame:
    """Spline of each column at fixed target levels, missing where a column has fewer than two. A column, its levels, is one row; a task takes many columns at a time."""
    t = np.array(targets, float)
    schema = ", ".join(f"{c} {dict(levels.dtypes)[c]}" for c in column) + f", target double, {value} double"

    def run(batches):
        for batch in batches:
            rows, out = batch.column("rows"), []
            ends, flat = rows.offsets.to_numpy(), rows.flatten()
            z, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in "zv")
            for a, b in zip(ends, ends[1:], strict=False):
                out.append(spline_at(z[a - ends[0] : b - ends[0]], v[a - ends[0] : b - ends[0]], t))
            which = pa.array(np.repeat(np.arange(batch.num_rows), len(t)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(which) for c in column), pa.array(np.tile(t, batch.num_rows)), pa.array(np.concatenate(out) if out else np.empty(0), from_pandas=True)], [*column, "target", value])

    rows = levels.groupBy(*column).agg(F.collect_list(F.struct(F.col(level).cast("double").alias("z"), F.col(value).cast("double").alias("v"))).alias("rows"))
    return rows.mapInArrow(run, schema)


def akima(df: DataFrame, column: Sequence[str], level: str, value: str, fraction: float) -> DataFrame:
    """Local spline from five neighbouring slopes, evaluated at a fraction of each interval; slopes beyond the ends go on in a line."""
    w = Window.partitionBy(*column).orderBy(level)
    d = df.withColumn("_z1", F.lead(level).over(w)).withColumn("_v1", F.lead(value).over(w))
    d = d.withColumn("_m", F.try_divide(F.col("_v1") - F.col(value), F.col("_z1") - F.col(level)))
    prev1, prev2, next1, next2 = F.lag("_m", 1).over(w), F.lag("_m", 2).over(w), F.lead("_m", 1).over(w), F.lead("_m", 2).over(w)
    d = d.withColumn("_p1", prev1).withColumn("_p2", prev2).withColumn("_n1", next1).withColumn("_n2", next2)
    m = F.col("_m")
    p1 = F.coalesce("_p1", 2 * m - F.coalesce("_n1", m))
    p2 = F.coalesce("_p2", 2 * p1 - m)
    n1 = F.coalesce("_n1", 2 * m - F.coalesce("_p1", m))
    n2 = F.coalesce("_n2", 2 * n1 - m)

    def tangent(a, b, c, e):
        """At the point between slopes b and c, with a before and e after."""
        wa, wb = F.abs(e - c), F.abs(b - a)
        return F.when(wa + wb < 1e-12, (b + c) / 2).otherwise((wa * b + wb * c) / (wa + wb))

    d = d.withColumn("_t0", tangent(p2, p1, m, n1)).withColumn("_t1", tangent(p1, m, n1, n2)).withColumn("_h", F.col("_z1") - F.col(level))
    s = fraction
    cubic = (
        (2 * s**3 - 3 * s**2 + 1) * F.col(value) + (s**3 - 2 * s**2 + s) * F.col("_h") * F.col("_t0") + (-2 * s**3 + 3 * s**2) * F.col("_v1") + (s**3 - s**2) * F.col("_h") * F.col("_t1")
    )
    out = d.filter("_z1 is not null").select(*column, (F.col(level) + s * F.col("_h")).alias("at"), cubic.alias(value))
    return out


def dft_lowpass(cells: DataFrame, i: str, j: str, value: str, n: int, most: int) -> DataFrame:
    """Truncated Fourier series along i (0 .. n - 1) of each row j: wavenumbers 0 .. most.

    A row of the grid, n numbers, is one array; spectrum and series are array expressions, so that nothing is joined.
    """
    angle = lambda q, c: 2 * np.pi / n * q * c
    rows = cells.groupBy(j).agg(F.collect_list(F.struct(F.col(i).alias("i"), F.col(value).alias("v"))).alias("row"))

    def wave(q: Column) -> Column:
        part = lambda f: F.aggregate("row", F.lit(0.0), lambda s, c: s + c["v"] * f(angle(q, c["i"])))
        scale = F.when((q == 0) | (2 * q == n), 1.0 / n).otherwise(2.0 / n)
        return F.struct(q.alias("q"), (scale * part(F.cos)).alias("a"), (scale * part(F.sin)).alias("b"))

    spectrum = rows.select(j, F.transform(F.sequence(F.lit(0), F.lit(most)), wave).alias("waves"))
    back = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda c: F.struct(c.alias(i), F.aggregate("waves", F.lit(0.0), lambda s, w: s + w["a"] * F.cos(angle(w["q"], c)) + w["b"] * F.sin(angle(w["q"], c))).alias(value)),
    )
    return spectrum.select(j, F.explode(back).alias("c")).select(F.col(f"c.{i}").alias(i), j, F.col(f"c.{value}").alias(value))


def dft_lowpass_2d(cells: DataFrame, i: str, j: str, value: str, ni: int, nj: int, most_i: int, most_j: int) -> DataFrame:
    """Truncated Fourier series along both axes of a full, doubly periodic grid."""
    return dft_lowpass(dft_lowpass(cells, i, j, value, ni, most_i), j, i, value, nj, most_j).select(i, j, value)


def trilinear(points: DataFrame, grid: DataFrame, ri: str, rj: str, rk: str, i: str, j: str, k: str, value: str, row: str) -> DataFrame:
    """Value at fractional indexes of a grid of three dimensions: eight corners by equi-join. Missing where a corner with weight is."""
    at = {a: (F.floor(F.col(c)), F.col(c) - F.floor(F.col(c))) for a, c in (("i", ri), ("j", rj), ("k", rk))}
    corners = []
    for bits in range(8):
        step = {a: bits >> n & 1 for n, a in enumerate("ijk")}
        weight = F.lit(1.0)
        for a, on in step.items():
            weight = weight * (at[a][1] if on else 1 - at[a][1])
        corners.append(F.struct(*[(at[a][0] + on).alias(a) for a, on in step.items()], weight.alias("w")))
    spread = points.select(row, F.explode(F.array(*corners)).alias("c")).select(row, F.col("c.i").alias(i), F.col("c.j").alias(j), F.col("c.k").alias(k), F.col("c.w").alias("w")).filter("w > 0")
    met = spread.join(grid.select(*[F.col(c).cast("long").alias(c) for c in (i, j, k)], value), [i, j, k], "left")
    return met.groupBy(row).agg(F.when(F.count(value) == F.count(F.lit(1)), F.sum(F.col(value) * F.col("w"))).alias(value))


def curvilinear_index(points: DataFrame, grid: DataFrame, row: str, x: str, y: str, i: str, j: str, size: float) -> DataFrame:
    """Fractional index (ri, rj) of each point (row, x, y) in a curvilinear grid (i, j, gx, gy); none outside of it.

    Four neighbouring grid points make a cell. Cells and points meet in square buckets of ``size``, then the cell's bilinear map is
    inverted by a fixed number of Newton steps. A point on an edge takes the cell with the smallest index.
    """
    corner = lambda di, dj, n: grid.select((F.col(i) - di).alias(i), (F.col(j) - dj).alias(j), F.col("gx").alias(f"x{n}"), F.col("gy").alias(f"y{n}"))
    cells = corner(0, 0, 0).join(corner(1, 0, 1), [i, j]).join(corner(0, 1, 2), [i, j]).join(corner(1, 1, 3), [i, j])
    ends = {c: (F.least(*[F.col(f"{c}{n}") for n in range(4)]), F.greatest(*[F.col(f"{c}{n}") for n in range(4)])) for c in "xy"}
    bucket = lambda c: F.floor(c / size)
    spread = cells.withColumn("_bx", F.explode(F.sequence(bucket(ends["x"][0]), bucket(ends["x"][1])))).withColumn("_by", F.explode(F.sequence(bucket(ends["y"][0]), bucket(ends["y"][1]))))
    p = points.select(row, F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("_bx", bucket(F.col("_x"))).withColumn("_by", bucket(F.col("_y")))
    met = p.join(spread, ["_bx", "_by"]).filter((F.col("_x") >= ends["x"][0]) & (F.col("_x") <= ends["x"][1]) & (F.col("_y") >= ends["y"][0]) & (F.col("_y") <= ends["y"][1]))

    def newton(s: Column, _: Column) -> Column:
        a, b = s["a"], s["b"]
        f, da, db = {}, {}, {}
        for c in "xy":
            v = [F.col(f"{c}{n}") for n in range(4)]
            f[c] = (1 - a) * (1 - b) * v[0] + a * (1 - b) * v[1] + (1 - a) * b * v[2] + a * b * v[3] - F.col(f"_{c}")
            da[c] = (1 - b) * (v[1] - v[0]) + b * (v[3] - v[2])
            db[c] = (1 - a) * (v[2] - v[0]) + a * (v[3] - v[1])
        det = da["x"] * db["y"] - da["y"] * db["x"]
        return F.struct((a - F.try_divide(f["x"] * db["y"] - f["y"] * db["x"], det)).alias("a"), (b - F.try_divide(f["y"] * da["x"] - f["x"] * da["y"], det)).alias("b"))

    found = met.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct(F.lit(0.5).alias("a"), F.lit(0.5).alias("b")), newton))
    inside = found.filter((F.col("_s.a") >= -1e-9) & (F.col("_s.a") <= 1 + 1e-9) & (F.col("_s.b") >= -1e-9) & (F.col("_s.b") <= 1 + 1e-9))
    best = F.min(F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col("_s").alias("s")))
    return inside.groupBy(row).agg(best.alias("m")).select(row, (F.col("m.i") + F.col("m.s.a")).alias("ri"), (F.col("m.j") + F.col("m.s.b")).alias("rj"))
