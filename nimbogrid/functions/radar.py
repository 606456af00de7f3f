"""Radar observation operators as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as c

TINY = 1e-9


def radial_velocity(u: Column, v: Column, w: Column, azimuth: Column, elevation: Column, fall: Column | None = None) -> Column:
    """Wind along the beam; angles in degrees, clockwise from north and above the horizon; fall speed is taken off the updraught."""
    a, e = F.radians(azimuth), F.radians(elevation)
    return u * F.cos(e) * F.sin(a) + v * F.cos(e) * F.cos(a) + (w if fall is None else w - fall) * F.sin(e)


def air_density(p: Column, t: Column) -> Column:
    return p / (c.R_DRY * t)


def reflectivity_rain(rho: Column, qt: Column) -> Column:
    """Linear reflectivity of all condensate taken as rain with a Marshall-Palmer distribution."""
    scale = 10.0e18 * 72 / (math.pi**1.75 * 8.0e6**0.75 * 1000.0**1.75)
    return F.when(qt > TINY, scale * F.pow(rho * qt, F.lit(1.75))).otherwise(0.0)


def reflectivity_species(rho: Column, t: Column, qr: Column, qs: Column, qg: Column) -> Column:
    """Linear reflectivity of rain, dry or wet snow, and graupel with exponential distributions."""
    cf, pip = 1.0e18 * 720, math.pi**1.75
    nor, nos, nog, ror, ros, rog, roi, ki2, kr2 = 8.0e6, 3.0e6, 4.0e4, 1000.0, 100.0, 913.0, 917.0, 0.176, 0.930
    zr = cf / (pip * nor**0.75 * ror**1.75) * F.pow(rho * qr, F.lit(1.75))
    dry = cf * ki2 * ros**0.25 / (pip * kr2 * nos**0.75 * roi**2) * F.pow(rho * qs, F.lit(1.75))
    wet = cf / (pip * nos**0.75 * roi**1.75) * F.pow(rho * qs, F.lit(1.75))
    zg = (cf / (pip * nog**0.75 * rog**1.75)) ** 0.95 * F.pow(rho * qg, F.lit(1.6625))
    some = lambda q, z: F.when(q > TINY, z).otherwise(0.0)
    return some(qr, zr) + some(qs, F.when(t <= 273.16, dry).otherwise(wet)) + some(qg, zg)


def reflectivity_power(rho: Column, qr: Column, qs: Column, qg: Column, melting: bool = False) -> Column:
    """Linear reflectivity from power laws of mass in g/m3; with melting, mixtures of rain with snow and with graupel."""
    zero = F.lit(0.0)
    fs = fg = fws = fwg = zero
    if melting:
        both_s, both_g = (qr > 0) & (qs > 0), (qr > 0) & (qg > 0)
        fs = F.when(both_s, 0.5 * F.cbrt(F.least(qr / qs, qs / qr))).otherwise(0.0)
        fg = F.when(both_g, 0.5 * F.cbrt(F.least(qr / qg, qg / qr))).otherwise(0.0)
        fws, fwg = F.when(both_s, qr / (qr + qs)).otherwise(0.0), F.when(both_g, qr / (qr + qg)).otherwise(0.0)
    law = lambda q, a, b: F.when(q > TINY, a * F.pow(rho * q * 1e3, F.lit(b) if isinstance(b, float) else b)).otherwise(0.0)
    out = law((1 - fs - fg) * qr, 2.53e4, 1.84) + law((1 - fs) * qs, 3.48e3, 1.66) + law((1 - fg) * qg, 5.54e3, 1.70)
    if melting:
        out = out + law(fs * (qr + qs), (0.00491 + 5.75 * fws - 5.588 * fws * fws) * 1e5, 1.67 - 0.202 * fws + 0.398 * fws * fws)
        out = out + law(fg * (qr + qg), (0.0358 + 5.27 * fwg - 9.51 * fwg * fwg + 4.68 * fwg * fwg * fwg) * 1e5, 1.70 + 0.020 * fwg + 0.287 * fwg * fwg - 0.186 * fwg * fwg * fwg)
    return out


def fall_speed_rain(qt: Column, p: Column) -> Column:
    return F.when(qt > TINY, 5.40 * F.pow(1.0e5 / p, F.lit(0.4)) * F.pow(qt, F.lit(0.125))).otherwise(0.0)


def dbz(z: Column, least: float, shift: float) -> tuple[Column, Column]:
    """(decibels, whether it is a low value): below ``least`` linear units the value is least in dB plus shift."""
    low = z < least
    return F.when(low, 10 * math.log10(least) + shift).otherwise(10 * F.log10(z)), low


def georeference(azimuth: Column, rng: Column, elevation: Column, lon0: float, lat0: float, z0: float) -> dict[str, Column]:
    """lon, lat (degrees) and height (m) of a range gate: beam over a sphere of 4/3 of the earth's radius."""
    ke = 4.0 / 3.0 * c.EARTH_RADIUS
    e, a = F.radians(elevation), F.radians(azimuth)
    z = z0 + F.sqrt(rng * rng + ke * ke + 2 * rng * ke * F.sin(e)) - ke
    d = ke * F.asin(rng * F.cos(e) / (ke + z - z0)) / c.EARTH_RADIUS
    p0, l0 = math.radians(lat0), math.radians(lon0)
    lat = F.asin(math.sin(p0) * F.cos(d) + math.cos(p0) * F.sin(d) * F.cos(a))
    lon = l0 + F.atan2(F.sin(a) * F.sin(d) * math.cos(p0), F.cos(d) - math.sin(p0) * F.sin(lat))
    return {"lon": F.degrees(lon), "lat": F.degrees(lat), "z": z}


def beam_angles(lon: Column, lat: Column, z: Column, lon0: float, lat0: float, z0: float) -> tuple[Column, Column]:
    """(azimuth, elevation) in degrees of a point as the radar sees it."""
    p0, dl = math.radians(lat0), F.radians(lon - lon0)
    p = F.radians(lat)
    az = F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p), math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(dl))), F.lit(360.0))
    ke = 4.0 / 3.0 * c.EARTH_RADIUS
    d = F.acos(F.least(F.lit(1.0), math.sin(p0) * F.sin(p) + math.cos(p0) * F.cos(p) * F.cos(dl))) * c.EARTH_RADIUS / ke
    h = z - z0
    return az, F.degrees(F.atan2((ke + h) * F.cos(d) - ke, (ke + h) * F.sin(d)))
