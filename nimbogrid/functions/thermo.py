"""Thermodynamics and moisture of air as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as c

Tracers = Mapping[str, Column]


def missing(value: Column) -> Column:
    """null for any of the sentinels of missing data."""
    out = value
    for u in c.UNDEFINED:
        out = F.when(F.abs(value - u) > abs(u) * 1e-4, out)
    return out


def q_dry(q: Tracers) -> Column:
    out = F.lit(1.0)
    for v in q.values():
        out = out - v
    return out


def cv_total(q: Tracers) -> Column:
    out = c.CV_DRY * q_dry(q)
    for name, v in q.items():
        out = out + v * c.CV_TRACERS[name]
    return out


def r_total(q: Tracers) -> Column:
    return c.R_DRY * q_dry(q) + c.R_VAP * q["qv"]


def pressure(rhot: Column, q: Tracers) -> Column:
    """From density times potential temperature."""
    cv, r = cv_total(q), r_total(q)
    return c.P00 * F.pow(rhot * r / c.P00, (cv + r) / cv)


def temperature(rho: Column, rhot: Column, q: Tracers) -> Column:
    return pressure(rhot, q) / (rho * r_total(q))


def rho_theta(p: Column, q: Tracers) -> Column:
    """The inverse of pressure()."""
    cv, r = cv_total(q), r_total(q)
    return c.P00 / r * F.pow(p / c.P00, cv / (cv + r))


def density(p: Column, t: Column, q: Tracers) -> Column:
    return p / (r_total(q) * t)


def state_to_physical(rho: Column, mu: Column, mv: Column, mw: Column, rhot: Column, q: Tracers) -> dict[str, Column]:
    """Momenta and density times potential temperature to wind, temperature and pressure."""
    return {"u": mu / rho, "v": mv / rho, "w": mw / rho, "t": temperature(rho, rhot, q), "p": pressure(rhot, q)}


def physical_to_state(u: Column, v: Column, w: Column, t: Column, p: Column, q: Tracers, clip: bool = False) -> dict[str, Column]:
    """The inverse; clip sets negative moisture to zero first."""
    q = {k: F.greatest(x, F.lit(0.0)) for k, x in q.items()} if clip else q
    rho = density(p, t, q)
    return {"rho": rho, "mu": u * rho, "mv": v * rho, "mw": w * rho, "rhot": rho_theta(p, q), **q}


def exner(p: Column) -> Column:
    return F.pow(p / c.P00, c.R_DRY / c.CP_DRY)


def potential_temperature(t: Column, p: Column) -> Column:
    return t / exner(p)


def virtual_temperature(t: Column, qv: Column) -> Column:
    return t * (1.0 + c.EPST_VAP * qv)


def latent_heat_vaporisation(t: Column) -> Column:
    return c.LHV00 + (c.CP_VAP - c.C_LIQUID) * t


def latent_heat_sublimation(t: Column) -> Column:
    return c.LHS00 + (c.CP_VAP - c.C_ICE) * t


def _psat(t: Column, cp: float, lh: float) -> Column:
    return c.PSAT0 * F.pow(t / c.T0, (c.CP_VAP - cp) / c.R_VAP) * F.exp(lh / c.R_VAP * (1 / c.T0 - 1 / t))


def saturation_liquid(t: Column) -> Column:
    return _psat(t, c.C_LIQUID, c.LHV00)


def saturation_ice(t: Column) -> Column:
    return _psat(t, c.C_ICE, c.LHS00)


def saturation(t: Column, warm: float = 273.15, cold: float = 233.15) -> Column:
    """Over liquid above ``warm``, over ice below ``cold``, in between in proportion."""
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - cold) / (warm - cold)))
    return a * saturation_liquid(t) + (1 - a) * saturation_ice(t)


def saturation_mixing(psat: Column, p: Column, qdry: Column) -> Column:
    """Specific humidity at saturation."""
    return F.when(p > psat, c.EPS_VAP * qdry * psat / (p - psat))


def relative_humidity_density(rho: Column, qv: Column, t: Column, psat: Column) -> Column:
    """In percent."""
    return rho * qv / psat * c.R_VAP * t * 100


def relative_humidity(t: Column, q: Column, p: Column) -> Column:
    """Vapour pressure over saturation: liquid from 0 C up, ice from -15 C down, mixed between."""
    e = q * p * 0.01 / (0.378 * q + 0.622)
    tc = t - c.T0
    liquid, ice = 6.11 * F.exp(17.3 * tc / (237.3 + tc)), 6.1121 * F.exp(22.587 * tc / (273.86 + tc))
    return e / F.when(tc >= 0, liquid).when(tc <= -15, ice).otherwise(liquid * (15 + tc) / 15 + ice * (-tc) / 15)


def adjust_pressure(p: Column, dz: Column, t: Column, q: Column, lapse: float = 5.0e-3) -> Column:
    """Pressure dz metres higher, with a constant lapse rate."""
    tv = t * (1 + 0.608 * q)
    return F.when(dz == 0, p).otherwise(p * F.pow((tv - lapse * dz) / tv, c.GRAVITY / (lapse * c.R_DRY)))


def dew_point(vapour_pressure: Column, steps: int = 12) -> Column:
    """Temperature at which liquid saturation equals a vapour pressure (Pa): Newton's method, a fixed number of steps, in one expression."""
    start = F.greatest(F.lit(150.0), (237.3 * F.ln(vapour_pressure / 611.0) / (17.3 - F.ln(vapour_pressure / 611.0))) + c.T0)

    def step(t: Column, _: Column) -> Column:
        s = saturation_liquid(t)
        slope = s * (c.LHV00 / (c.R_VAP * t * t) + (c.CP_VAP - c.C_LIQUID) / (c.R_VAP * t))
        return t - (s - vapour_pressure) / slope

    return F.when(vapour_pressure > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step))


def equivalent_potential_temperature(pt: Column, t: Column, qv: Column, p: Column) -> Column:
    return pt * F.exp(latent_heat_vaporisation(t) * qv / (c.CP_DRY * t))


def to_unbounded(x: Column, low: float, high: float) -> Column:
    """A bounded parameter on the whole line."""
    return F.atanh((2 * x - (low + high)) / (high - low))


def to_bounded(y: Column, low: float, high: float) -> Column:
    return (F.tanh(y) * (high - low) + low + high) / 2
