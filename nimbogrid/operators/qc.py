"""Observation quality control: an ordered list of rules becomes one column with the code of the first that fires."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quality control codes.
GOOD, GROSS_ERROR, PS_TERRAIN, LOW_REFLECTIVITY, MEMBER_VOTE, RADAR_HIGH, LEVEL_HIGH, LEVEL_LOW = 0, 5, 10, 11, 12, 19, 20, 21
BAD_VALUE, NOT_USED, OUT_OF_TIME, OUT_OF_DOMAIN = 50, 90, 97, 98


def time_slot(dif: Column, interval: float, base: int) -> Column:
    """Slot of a time offset: open on the left, closed on the right, so that an offset of half an interval is in the base slot."""
    return F.ceil(dif / F.lit(interval) - 0.5).cast("int") + F.lit(base)


def first_code(rules: Sequence[tuple[Column, int]]) -> Column:
    """Code of the first rule that is true, else 0; a rule that is null does not fire."""
    return F.coalesce(*[F.when(rule, F.lit(code)) for rule, code in rules], F.lit(GOOD))


def out_of_time(dif: Column, interval: float, base: int, start: int, end: int) -> Column:
    return ~time_slot(dif, interval, base).between(start, end)


def out_of_domain(x: Column, y: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return ~(x.between(x0, x1) & y.between(y0, y1))


def gross_error(dep: Column, err: Column, factor: Column | float = 5.0) -> Column:
    """|O - B| beyond factor times the error; the boundary passes."""
    return F.abs(dep) > (F.lit(factor) if isinstance(factor, (int, float)) else factor) * err


def member_vote(ens: Column, threshold: float) -> Column:
    """Number of members above a threshold."""
    return F.size(F.filter(ens, lambda v: v > threshold))


def vote_fails(ens: Column, observed_rain: Column, threshold: float, least_rain: int, least_clear: int) -> Column:
    """Fewer members with rain than asked for, where rain was observed, or fewer without it, where not."""
    wet = member_vote(ens, threshold)
    return F.when(observed_rain, wet < least_rain).otherwise(F.size(ens) - wet < least_clear)


def level_limits(lev: Column, top: float, bottom: float) -> list[tuple[Column, int]]:
    """Pressure levels: above the top or below the bottom of the column."""
    return [(lev < top, LEVEL_HIGH), (lev > bottom, LEVEL_LOW)]


def thin(i: Column, j: Column, k: Column, horizontal: int, vertical: int) -> Column:
    """Keeps the samples whose three indexes are all multiples of their steps."""
    return (i % horizontal == 0) & (j % horizontal == 0) & (k % vertical == 0)


def used_types(obs: DataFrame, config: DataFrame, on: str = "typ") -> DataFrame:
    """Adds ``used`` from a small configuration table (one row per report type); types that it lacks are not used."""
    return obs.join(config, on, "left").withColumn("used", F.coalesce("used", F.lit(False)))


def update_mask(background: Column, analysis: Column, p: Column, top: float, moisture: bool, moisture_top: float) -> Column:
    """Keeps the background above the update top (smaller pressure), for moisture above its own top too."""
    held = p < top
    return F.when(held | (p < moisture_top) if moisture else held, background).otherwise(analysis)


def radar_sample(z: Column, vr: Column, flag: Column, floor: float, vr_floor: float, vr_most: float, distance: Column, near: float) -> tuple[Column, Column]:
    """(reflectivity, radial velocity) with null where a sample fails.

    Flags from 900 on drop both; reflectivity below its floor is set to the floor; velocity is dropped where the
    reflectivity is below vr_floor, nearer to the radar than ``near``, or greater than vr_most.
    """
    bad = flag >= 900
    out_z = F.when(~bad, F.greatest(z, F.lit(floor)))
    out_v = F.when(~bad & (z >= vr_floor) & (distance >= near) & (F.abs(vr) <= vr_most), vr)
    return out_z, out_v


def radar_departures(obs: DataFrame, threshold: float, least_rain: int, least_clear: int, gross: float = 5.0, additive: tuple[int, float] | None = None, pseudo: float | None = None, elements: Sequence[int] = (4001, 4004)) -> DataFrame:
    """obs with dep, pert (array), qc and kind, the departure and perturbations that are assimilated of radar reflectivities, by the state of the observation.

    obs: elm, dat, err, ens (members' reflectivities) and, as far as asked for, extra (members' additive perturbations, of mean zero), eqv (members' humidities), tm and
    pm (mean temperature and pressure at the place). Where rain is observed but fewer than ``least_rain`` members have it, the vote fails; so it does where none is
    observed and fewer than ``least_clear`` have rain, and such an observation has no departure.

    additive (members, clear): where rain is observed and fewer members have it than this, members become ``clear``, the reflectivity of clear sky, plus their extra
    perturbations, and the observation is good. pseudo: where the departure is greater than this, the humidity of saturation is assimilated in place of the reflectivity (kind
    ``humidity``); the gross error check, ``gross`` times the error, is for others. Rows of other elements get their plain departure and check.
    """
    ours, d, ens = F.col("elm").isin(list(elements)), F.col("dat"), F.col("ens")
    wet, rain = member_vote(ens, threshold + 1e-6), d > threshold + 1e-6
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    off = lambda a, m: F.transform(a, lambda v: v - m)
    poor = ours & F.when(rain, wet < least_rain).otherwise(wet < least_clear)
    members, saved = ens, F.lit(False)
    if additive:
        saved = ours & rain & (wet < additive[0])
        members = F.when(saved, F.transform("extra", lambda v: v + additive[1])).otherwise(ens)
    out = obs.withColumn("_m", members).withColumn("_poor", F.coalesce(poor & ~saved, F.lit(False))).withColumn("_b", mean(F.col("_m")))
    none = d.isNull() | (ours & ~rain & F.col("_poor"))
    out = out.withColumn("dep", F.when(~none, d - F.col("_b"))).withColumn("pert", F.when(~none, off(F.col("_m"), F.col("_b")))).withColumn("kind", F.lit("value"))
    if pseudo is not None:
        t = F.col("tm") - 273.15
        e = 611.2 * F.exp(17.67 * t / (t + 243.5))
        humid = F.coalesce(ours & (F.col("dep") > pseudo), F.lit(False))
        out = out.withColumn("_h", humid).withColumn("_q", mean(F.col("eqv")))
        out = out.withColumn("dep", F.when(F.col("_h"), 0.622 * e / (F.col("pm") - e) - F.col("_q")).otherwise(F.col("dep"))).withColumn("pert", F.when(F.col("_h"), off(F.col("eqv"), F.col("_q"))).otherwise(F.col("pert")))
        out = out.withColumn("kind", F.when(F.col("_h"), "humidity").otherwise("value")).drop("_h", "_q")
    rules = [(d.isNull(), BAD_VALUE), ((F.col("kind") == "value") & gross_error(F.col("dep"), F.col("err"), gross), GROSS_ERROR), (F.col("_poor"), MEMBER_VOTE)]
    return out.withColumn("qc", first_code(rules)).drop("_m", "_b", "_poor")


def additive_perturbations(obs: DataFrame, slopes: DataFrame, ens: Column, on: Sequence[str], name: str = "extra") -> DataFrame:
    """obs with an array of additive perturbations: the departures of ens from its mean times the slope of the observation's level (a small table: on, slope), zero without one."""
    met = obs.join(slopes.select(*on, "slope"), list(on), "left")
    centred = F.transform(ens, lambda v: v - F.aggregate(ens, F.lit(0.0), lambda s, x: s + x) / F.size(ens))
    return met.withColumn(name, F.transform(centred, lambda v: v * F.coalesce("slope", F.lit(0.0)))).drop("slope")
