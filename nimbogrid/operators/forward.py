"""From model state to observations: forward operators, terrain, nudging, request-driven history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import radar, thermo
from ..sources.observations import ELEMENTS
from . import qc
from .reduce import history


def model_value(elm: Column, at: Mapping[str, Column], rk: Column, most_adjustment: float = 100.0, surface_only: Column | None = None, ten_metre: Column | None = None) -> tuple[Column, Column]:
    """(H(x), code) of conventional observations from columns interpolated to their places.

    at: u v t q p, u10 v10 (10 m), t2 q2 ps topo (surface). rk: height of surface-pressure observations. surface_only
    marks reports of which only surface pressure is used, ten_metre those that see the 10 m wind. Unknown elements are coded as not used.
    """
    ten = F.lit(False) if ten_metre is None else ten_metre
    dz = rk - at["topo"]
    u, v = F.when(ten, at["u10"]).otherwise(at["u"]), F.when(ten, at["v10"]).otherwise(at["v"])
    is_ = lambda name: elm == ELEMENTS[name]
    y = (
        F.when(is_("U"), u).when(is_("V"), v).when(is_("T"), at["t"]).when(is_("TV"), thermo.virtual_temperature(at["t"], at["q"])).when(is_("Q"), at["q"])
        .when(is_("PS"), thermo.adjust_pressure(at["ps"], dz, at["t2"], at["q2"])).when(is_("RH"), thermo.relative_humidity(at["t"], at["q"], at["p"]))
    )
    known = elm.isin([ELEMENTS[e] for e in ("U", "V", "T", "TV", "Q", "PS", "RH")])
    rules = [(~known, qc.NOT_USED), (is_("PS") & (F.abs(dz) > most_adjustment), qc.PS_TERRAIN)]
    if surface_only is not None:
        rules.insert(0, (surface_only & ~is_("PS"), qc.NOT_USED))
    return y, qc.first_code(rules)


def radar_value(at: Mapping[str, Column], lon: Column, lat: Column, z: Column, site: tuple[float, float, float], least: float, shift: float) -> dict[str, Column]:
    """Reflectivity in dB, radial velocity and whether the reflectivity is a low value, at places seen from a radar site."""
    az, el = radar.beam_angles(lon, lat, z, *site)
    rho = radar.air_density(at["p"], at["t"])
    ref, low = radar.dbz(F.greatest(radar.reflectivity_power(rho, at["qr"], at["qs"], at["qg"]), F.lit(1e-30)), least, shift)
    return {"ref": ref, "vr": radar.radial_velocity(at["u"], at["v"], at["w"], az, el), "low": low}


def terrain_height(xi: Column, topo: Column, top: float) -> Column:
    """Height of a terrain-following level xi above the sea."""
    return (top - topo) / top * xi + topo


def search_thinning(dx: Column, dy: Column, dz: Column, method: int, size_h: float, size_v: float, every_h: int, every_v: int, near_h: int = 1, near_v: int = 1) -> Column:
    """Whether an observation at an offset from a grid point is kept. 1: every so many bins of distance, and all the near ones; 2: the same by nearest bins, without the exemption."""
    if method == 1:
        i, j, k = (F.floor(F.abs(d) / s) for d, s in ((dx, size_h), (dy, size_h), (dz, size_v)))
        near = (i < near_h) & (j < near_h) & (k < near_v)
    elif method == 2:
        i, j, k = F.round(dx / size_h), F.round(dy / size_h), F.signum(F.round(dz)) * F.floor(F.abs(F.round(dz)) / size_v)
        near = F.lit(False)
    else:
        return F.lit(True)
    return ((i % every_h == 0) & (j % every_h == 0) & (k % every_v == 0)) | near


def nudge(x: Column, reference: Column, weight: Column, dt: float, tau: float) -> Column:
    """x after a step towards a reference; where that is missing x stays."""
    return F.coalesce(x + dt / tau * weight * (reference - x), x)


@dataclass(frozen=True)
class Request:
    """One requested output: a variable under a name, a statistic per interval."""

    variable: str
    interval: float
    op: str = "mean"
    name: str | None = None


def history_requests(samples: DataFrame, requests: Sequence[Request], keys: Sequence[str], t: str, dt: str, skip_missing: bool = False) -> DataFrame:
    """(keys, name, interval, value) of all requests over samples with one column per variable.

    Requests with the same statistic share one scan and one aggregation, whatever their intervals: the requests, a small table, are exploded on
    each sample.
    """
    out = None
    for op in dict.fromkeys(q.op for q in requests):
        own = [q for q in requests if q.op == op]
        rows = F.explode(F.array(*[F.struct(F.lit(q.name or q.variable).alias("name"), F.lit(float(q.interval)).alias("every"), F.col(q.variable).cast("double").alias("value")) for q in own]))
        # The step at the end of an interval belongs to it.
        s = samples.select(*keys, F.col(t).alias("_t"), dt, rows.alias("q")).select(*keys, "_t", dt, "q.*")
        h = history(s, F.ceil(F.col("_t") / F.col("every")), [*keys, "name"], "value", dt, op, skip_missing)
        out = h if out is None else out.unionByName(h)
    return out


def stretched_levels(first: float, ratio: float, most: float, n: int) -> list[float]:
    """Tops of n layers whose thickness grows by a ratio up to a greatest one."""
    out, z, dz = [], 0.0, first
    for _ in range(n):
        z += dz
        out.append(z)
        dz = min(dz * ratio, most)
    return out


def taper(distance: Column, half: float) -> Column:
    """Compactly supported correlation function of fifth order: 1 at 0, 0 from twice ``half`` on."""
    z = distance / half
    near = ((((-0.25 * z + 0.5) * z + 0.625) * z - 5.0 / 3.0) * z * z) + 1
    far = ((((z / 12 - 0.5) * z + 0.625) * z + 5.0 / 3.0) * z - 5) * z + 4 - F.try_divide(F.lit(2.0 / 3.0), z)
    return F.when(z <= 1, near).when(z < 2, far).otherwise(0.0)
