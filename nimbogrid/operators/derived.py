"""Derived variables by name: each name has inputs and an expression, and is expanded into one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as c
from ..functions import thermo

#: name -> (inputs, builder of a column). Inputs are names of stored columns or of other derived variables.
REGISTRY: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {}

COLUMN = ("i", "j")


def derived(name: str, *inputs: str):
    def wrap(f: Callable[..., Column]):
        REGISTRY[name] = (inputs, f)
        return f

    return wrap


def resolve(state: DataFrame, names: Sequence[str], drop: bool = True) -> DataFrame:
    """Adds the named variables to a state (dens, u, v, w, t, p, q..., z, dz, area per i, j, k); unknown names are an error.

    Every variable is added once, after its inputs; Catalyst merges the projections and prunes what is not asked for.
    """
    have, out = set(state.columns), state

    def add(name: str, path: tuple[str, ...] = ()) -> None:
        nonlocal out
        if name in have:
            return
        if name not in REGISTRY:
            raise KeyError(f"unknown variable {name}")
        if name in path:
            raise ValueError(f"circular definition of {name}")
        inputs, build = REGISTRY[name]
        for x in inputs:
            add(x, (*path, name))
        out = out.withColumn(name, build(*[F.col(x) for x in inputs]))
        have.add(name)

    for n in names:
        add(n)
    return out.select(*state.columns, *[n for n in dict.fromkeys(names) if n not in state.columns]) if drop else out


def _over(order: str = "k"):
    return Window.partitionBy(*COLUMN).orderBy(order)


derived("QLIQ", "qc", "qr")(lambda a, b: a + b)
derived("QICE", "qi", "qs", "qg")(lambda a, b, d: a + b + d)
derived("QHYD", "QLIQ", "QICE")(lambda a, b: a + b)
derived("QTOT", "qv", "QHYD")(lambda a, b: a + b)
derived("QDRY", "QTOT")(lambda q: 1 - q)
derived("EXNER", "p")(thermo.exner)
derived("PT", "t", "p")(thermo.potential_temperature)
derived("POTV", "PT", "qv")(thermo.virtual_temperature)
derived("LHV", "t")(thermo.latent_heat_vaporisation)
derived("LHS", "t")(thermo.latent_heat_sublimation)
derived("LHF", "LHS", "LHV")(lambda a, b: a - b)
derived("TEML", "t", "LHV", "LHS", "QLIQ", "QICE")(lambda t, lv, ls, ql, qi: t - (lv * ql + ls * qi) / c.CP_DRY)
derived("POTL", "TEML", "EXNER")(lambda t, e: t / e)
derived("POTE", "PT", "t", "qv", "p")(thermo.equivalent_potential_temperature)
derived("PSATL", "t")(thermo.saturation_liquid)
derived("PSATI", "t")(thermo.saturation_ice)
derived("QSAT", "PSATL", "p", "QDRY")(thermo.saturation_mixing)
derived("RHL", "dens", "qv", "t", "PSATL")(thermo.relative_humidity_density)
derived("RHI", "dens", "qv", "t", "PSATI")(thermo.relative_humidity_density)
derived("RHA", "dens", "qv", "t")(lambda d, q, t: thermo.relative_humidity_density(d, q, t, thermo.saturation(t)))
derived("TDEW", "dens", "qv", "t")(lambda d, q, t: thermo.dew_point(d * q * c.R_VAP * t))
derived("MSE", "t", "z", "LHV", "qv")(lambda t, z, lv, q: c.CP_DRY * t + c.GRAVITY * z + lv * q)
derived("UABS", "u", "v", "w")(lambda u, v, w: F.sqrt(u * u + v * v + w * w))
derived("ENGP", "dens", "z")(lambda d, z: d * c.GRAVITY * z)
derived("ENGK", "dens", "UABS")(lambda d, s: 0.5 * d * s * s)
derived("ENGI", "dens", "QDRY", "t", "qv", "QLIQ", "QICE")(lambda d, qd, t, qv, ql, qi: d * (qd * c.CV_DRY * t + qv * (c.CV_VAP * t + c.LHV00) + ql * c.C_LIQUID * t + qi * (c.C_ICE * t - (c.LHS00 - c.LHV00))))
derived("ENGT", "ENGP", "ENGK", "ENGI")(lambda a, b, d: a + b + d)


@derived("N2", "POTV", "z")
def _n2(pt: Column, z: Column) -> Column:
    """g / theta d theta / dz, central inside the column, one-sided at its ends."""
    w = _over()
    up, zu, down, zd = F.lead(pt).over(w), F.lead(z).over(w), F.lag(pt).over(w), F.lag(z).over(w)
    return c.GRAVITY / pt * (F.coalesce(up, pt) - F.coalesce(down, pt)) / (F.coalesce(zu, z) - F.coalesce(zd, z))


@derived("VELZ", "mw", "dens")
def _velz(m: Column, d: Column) -> Column:
    """Vertical velocity on the upper face of a cell; 0 at the top."""
    return F.coalesce(2 * m / (d + F.lead(d).over(_over())), F.lit(0.0))


def level_means(state: DataFrame, names: Sequence[str], mass: Sequence[str] = ()) -> DataFrame:
    """Area-weighted means by level; those in ``mass`` are weighted by density too."""
    s = resolve(state, [*names, *mass], drop=False)
    a, d = F.col("area"), F.col("dens")
    aggs = [(F.sum(F.col(n) * a) / F.sum(a)).alias(f"{n}_MEAN") for n in names] + [(F.sum(F.col(n) * d * a) / F.sum(d * a)).alias(f"{n}_MEAN") for n in mass]
    return s.groupBy("k").agg(*aggs)


def primes(state: DataFrame, names: Sequence[str], mass: Sequence[str] = ()) -> DataFrame:
    """Departures from the level means: one row of means per level is sent to the cells."""
    s = resolve(state, [*names, *mass], drop=False)
    out = s.join(level_means(state, names, mass), "k")
    for n in (*names, *mass):
        out = out.withColumn(f"{n}_PRIM", F.col(n) - F.col(f"{n}_MEAN"))
    return out


def turbulence(state: DataFrame) -> DataFrame:
    """By level: w'w', w'w'w', the heat flux w'theta' and the resolved kinetic energy, area-weighted."""
    s = primes(state, [], ["u", "v", "w", "PT"])
    u, v, w, t, a = (F.col(x) for x in ("u_PRIM", "v_PRIM", "w_PRIM", "PT_PRIM", "area"))
    mean = lambda e: F.sum(e * a) / F.sum(a)
    return s.groupBy("k").agg(
        mean(w * w).alias("W_PRIM2"), mean(w * w * w).alias("W_PRIM3"), mean(w * t * F.col("dens") * c.CP_DRY).alias("PT_W_PRIM"), mean(0.5 * (u * u + v * v + w * w)).alias("TKE_RS")
    )


def column_paths(state: DataFrame) -> DataFrame:
    """Water paths of each column: liquid, ice, vapour plus condensate; q times density times thickness, in g/m2."""
    s = resolve(state, ["QLIQ", "QICE", "QTOT"], drop=False)
    m = F.col("dens") * F.col("dz") * 1000
    return s.groupBy(*COLUMN).agg(F.sum(F.col("QLIQ") * m).alias("LWP"), F.sum(F.col("QICE") * m).alias("IWP"), F.sum(F.col("QTOT") * m).alias("PW"))


def boundary_layer_height(state: DataFrame) -> DataFrame:
    """Height at which the virtual potential temperature first exceeds that of the lowest level, between levels; the lowest height if nowhere."""
    s = resolve(state, ["POTV"], drop=False)
    w = _over()
    s = s.select(*COLUMN, "k", "z", "POTV", F.first("POTV").over(w).alias("_p0"), F.first("z").over(w).alias("_z0"), F.lag("POTV").over(w).alias("_pl"), F.lag("z").over(w).alias("_zl"))
    at = F.col("_zl") + (F.col("z") - F.col("_zl")) * (F.col("_p0") - F.col("_pl")) / (F.col("POTV") - F.col("_pl"))
    first = F.min(F.when(F.col("POTV") > F.col("_p0"), F.struct("k", at.alias("h"))))
    return s.groupBy(*COLUMN).agg(F.coalesce(first["h"], F.min("_z0")).alias("PBLH"))


def rotation_divergence(state: DataFrame, dx: float, dy: float) -> DataFrame:
    """Vertical vorticity and horizontal divergence by central differences; null on the edge of the domain."""
    wi, wj = Window.partitionBy("j", "k").orderBy("i"), Window.partitionBy("i", "k").orderBy("j")
    d = lambda name, w, step: (F.lead(name).over(w) - F.lag(name).over(w)) / (2 * step)
    return state.withColumn("VOR", d("v", wi, dx) - d("u", wj, dy)).withColumn("HDIV", d("u", wi, dx) + d("v", wj, dy))


def lift_parcel(z: np.ndarray, p: np.ndarray, t: np.ndarray, qv: np.ndarray) -> tuple[float, float, float, float, float]:
    """(CAPE, CIN, LCL, LFC, LNB) of a parcel from the lowest level, lifted along the saturated adiabat above condensation."""
    order = np.argsort(z)
    z, p, t, qv = (a[order].astype(float) for a in (z, p, t, qv))

    def psat(x):
        return c.PSAT0 * (x / c.T0) ** ((c.CP_VAP - c.C_LIQUID) / c.R_VAP) * np.exp(c.LHV00 / c.R_VAP * (1 / c.T0 - 1 / x))

    def qsat(x, pr):
        e = min(psat(x), 0.5 * pr)
        return c.EPS_VAP * e / (pr - (1 - c.EPS_VAP) * e)

    energy = c.CP_DRY * t[0] + c.GRAVITY * z[0] + c.LHV0 * qv[0]
    dry = c.CP_DRY * t[0] + c.GRAVITY * z[0]
    buoyancy, lcl = np.zeros(len(z)), np.nan
    for n in range(len(z)):
        tp, q = (dry - c.GRAVITY * z[n]) / c.CP_DRY, qv[0]
        if tp < 100 or q > qsat(tp, p[n]):
            if np.isnan(lcl):
                lcl = z[n]
            low, high = 100.0, 350.0
            for _ in range(60):  # moist static energy grows with temperature
                tp = (low + high) / 2
                if c.CP_DRY * tp + c.GRAVITY * z[n] + c.LHV0 * qsat(tp, p[n]) > energy:
                    high = tp
                else:
                    low = tp
            q = qsat(tp, p[n])
        buoyancy[n] = c.GRAVITY * (tp * (1 + c.EPST_VAP * q) / (t[n] * (1 + c.EPST_VAP * qv[n])) - 1)
    cape = cin = 0.0
    lfc = lnb = np.nan
    for n in range(len(z) - 1):
        part = (buoyancy[n] + buoyancy[n + 1]) / 2 * (z[n + 1] - z[n])
        if part > 0 and z[n + 1] > lcl:  # never so while nothing has condensed
            if np.isnan(lfc):
                lfc = max(z[n], lcl)
            lnb = z[n + 1]
            cape += part
        elif part < 0 and np.isnan(lfc):
            cin -= part
    return cape, cin, lcl, lfc, lnb


def convective_energy(state: DataFrame) -> DataFrame:
    """CAPE, CIN, LCL, LFC and LNB of each column. A column, its levels, is one row; a task takes many columns at a time."""

    def run(batches):
        for batch in batches:
            rows = batch.column("rows")
            ends, flat = rows.offsets.to_numpy() - rows.offsets[0].as_py(), rows.flatten()
            parts = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("z", "p", "t", "qv")]
            out = [lift_parcel(*(x[a:b] for x in parts)) for a, b in zip(ends, ends[1:], strict=False)]
            numbers = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("i").cast(pa.int32()), batch.column("j").cast(pa.int32()), *(pa.array(x, pa.float64(), from_pandas=True) for x in numbers)], ["i", "j", "CAPE", "CIN", "LCL", "LFC", "LNB"])

    rows = state.groupBy(*COLUMN).agg(F.collect_list(F.struct("z", "p", "t", "qv")).alias("rows"))
    return rows.mapInArrow(run, "i int, j int, CAPE double, CIN double, LCL double, LFC double, LNB double")
