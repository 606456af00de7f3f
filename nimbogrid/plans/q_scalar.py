"""Scalar functions on data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as c
from ..functions import geo, radar, thermo
from .registry import query
from .views import r, table, v_grid, v_site


def state(spark, sf_dir):
    """Line items as air: t 240-290 K, p 500-1000 hPa, wind, moisture of six kinds."""
    d = table(spark, sf_dir, "lineitem")
    f = F.col
    return d.select(
        f("l_orderkey").alias("okey"), f("l_linenumber").alias("line"), f("l_extendedprice").alias("price"), (240 + f("l_quantity")).alias("t"), (50000 + f("l_extendedprice") % 50000).alias("p"),
        (f("l_tax") * 100).alias("u"), (f("l_discount") * 100 - 5).alias("v"), (f("l_linenumber") - 3.5).alias("w"), (f("l_discount") * 0.1).alias("qv"), (f("l_tax") * 0.01).alias("qr"),
        (f("l_discount") * 0.01).alias("qs"), ((f("l_partkey") % 7) * 0.0005).alias("qg"),
    )


STATE = """WITH st AS (SELECT l_orderkey AS okey, l_linenumber AS line, l_extendedprice AS price, 240 + l_quantity AS t, 50000 + l_extendedprice % 50000 AS p,
  l_tax * 100 AS u, l_discount * 100 - 5 AS v, (l_linenumber - 3.5)::DOUBLE AS w, l_discount * 0.1::DOUBLE AS qv, l_tax * 0.01::DOUBLE AS qr, l_discount * 0.01::DOUBLE AS qs, ((l_partkey % 7) * 0.0005)::DOUBLE AS qg FROM lineitem) """

KEYS = ["okey", "line", "price"]
K = "okey, line, price, "


@query("relative_humidity", STATE + ", e AS (SELECT *, qv * p * 0.01 / (0.378 * qv + 0.622) AS e, t - 273.15 AS tc, 6.11 * exp(17.3 * (t - 273.15) / (237.3 + t - 273.15)) AS l, 6.1121 * exp(22.587 * (t - 273.15) / (273.86 + t - 273.15)) AS i FROM st) SELECT " + K + "round(e / CASE WHEN tc >= 0 THEN l WHEN tc <= -15 THEN i ELSE l * (15 + tc) / 15 + i * (-tc) / 15 END, 6) AS rh FROM e")
def relative_humidity(spark, sf_dir):
    return state(spark, sf_dir).select(*KEYS, r(thermo.relative_humidity(F.col("t"), F.col("qv"), F.col("p")), 6).alias("rh"))


@query("adjust_pressure", STATE + f"SELECT {K} round(p * pow((t * (1 + 0.608 * qv) - 0.005 * (w * 100)) / (t * (1 + 0.608 * qv)), {c.GRAVITY} / (0.005 * {c.R_DRY})), 3) AS p2 FROM st")
def adjust_pressure(spark, sf_dir):
    return state(spark, sf_dir).select(*KEYS, r(thermo.adjust_pressure(F.col("p"), F.col("w") * 100, F.col("t"), F.col("qv")), 3).alias("p2"))


_Q = {"qv": "qv", "qr": "qr", "qs": "qs", "qg": "qg"}
THERMO = STATE + f", th AS (SELECT *, 1 - qv - qr - qs - qg AS qd FROM st), tt AS (SELECT *, {c.R_DRY} * qd + {c.R_VAP} * qv AS r, {c.CV_DRY} * qd + {c.CV_VAP} * qv + {c.C_LIQUID} * qr + {c.C_ICE} * (qs + qg) AS cv FROM th) "


@query("state_to_physical", THERMO + f", s AS (SELECT *, p / (r * t) AS rho, {c.P00} / r * pow(p / {c.P00}, cv / (cv + r)) AS rhot FROM tt) SELECT {K} round(rho, 6) AS rho, round(rho * u, 5) AS mu, round(rhot, 4) AS rhot, round(t, 5) AS t, round(p, 2) AS p FROM s")
def state_to_physical(spark, sf_dir):
    """There and back: temperature and pressure return."""
    q = {k: F.col(k) for k in _Q}
    s = state(spark, sf_dir)
    to = thermo.physical_to_state(F.col("u"), F.col("v"), F.col("w"), F.col("t"), F.col("p"), q)
    s = s.select(*KEYS, *[v.alias(k) for k, v in to.items()])
    back = thermo.state_to_physical(F.col("rho"), F.col("mu"), F.col("mv"), F.col("mw"), F.col("rhot"), q)
    return s.select(*KEYS, r("rho", 6).alias("rho"), r("mu", 5).alias("mu"), r("rhot", 4).alias("rhot"), r(back["t"], 5).alias("t"), r(back["p"], 2).alias("p"))


PSAT_L = f"({c.PSAT0} * pow(t / {c.T0}, {(c.CP_VAP - c.C_LIQUID) / c.R_VAP!r}) * exp({c.LHV00 / c.R_VAP!r} * (1 / {c.T0}::DOUBLE - 1 / t)))"
PSAT_I = f"({c.PSAT0} * pow(t / {c.T0}, {(c.CP_VAP - c.C_ICE) / c.R_VAP!r}) * exp({c.LHS00 / c.R_VAP!r} * (1 / {c.T0}::DOUBLE - 1 / t)))"


@query(
    "saturation",
    STATE + f", s AS (SELECT *, {PSAT_L} AS l, {PSAT_I} AS i, least(1.0, greatest(0.0, (t - 233.15) / 40)) AS a FROM st) SELECT {K} round(l, 4) AS liquid, round(i, 4) AS ice, round(a * l + (1 - a) * i, 4) AS mixed, round({c.EPS_VAP!r} * l / (p - l), 8) AS qsat FROM s",
)
def saturation(spark, sf_dir):
    t = F.col("t")
    return state(spark, sf_dir).select(
        *KEYS, r(thermo.saturation_liquid(t)).alias("liquid"), r(thermo.saturation_ice(t)).alias("ice"), r(thermo.saturation(t)).alias("mixed"), r(thermo.saturation_mixing(thermo.saturation_liquid(t), F.col("p"), F.lit(1.0)), 8).alias("qsat")
    )


_HALVINGS = ", ".join(
    f"h{n} AS (SELECT okey, line, price, e, t, CASE WHEN {PSAT_L.replace('t /', '((lo + hi) / 2) /').replace('/ t)', '/ ((lo + hi) / 2))')} < e THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN {PSAT_L.replace('t /', '((lo + hi) / 2) /').replace('/ t)', '/ ((lo + hi) / 2))')} < e THEN hi ELSE (lo + hi) / 2 END AS hi FROM h{n - 1})"
    for n in range(1, 46)
)


@query("dew_point", STATE + f", h0 AS (SELECT okey, line, price, t, (qv + 0.001) * p * 0.01 / (0.622 + 0.378 * (qv + 0.001)) * 10 AS e, 150.0::DOUBLE AS lo, 350.0::DOUBLE AS hi FROM st), {_HALVINGS} SELECT {K} round((lo + hi) / 2, 4) AS tdew FROM h45")
def dew_point(spark, sf_dir):
    """Of moist air, by Newton's method; the SQL halves an interval 45 times."""
    q = F.col("qv") + 0.001
    return state(spark, sf_dir).select(*KEYS, r(thermo.dew_point(q * F.col("p") * 0.01 / (0.622 + 0.378 * q) * 10)).alias("tdew"))


@query("potential_temperatures", STATE + f", x AS (SELECT *, t / pow(p / {c.P00}, {c.R_DRY / c.CP_DRY!r}) AS pt FROM st) SELECT {K} round(pt, 5) AS pt, round(pt * (1 + {c.EPST_VAP!r} * qv), 5) AS potv, round(pt * exp(({c.LHV00!r} + {c.CP_VAP - c.C_LIQUID!r} * t) * qv / ({c.CP_DRY} * t)), 4) AS pote FROM x")
def potential_temperatures(spark, sf_dir):
    pt = thermo.potential_temperature(F.col("t"), F.col("p"))
    return state(spark, sf_dir).select(
        *KEYS, r(pt, 5).alias("pt"), r(thermo.virtual_temperature(pt, F.col("qv")), 5).alias("potv"), r(thermo.equivalent_potential_temperature(pt, F.col("t"), F.col("qv"), F.col("p"))).alias("pote")
    )


import math  # noqa: E402

_RAIN = 10.0e18 * 72 / (math.pi**1.75 * 8.0e6**0.75 * 1000.0**1.75)
_CF, _PIP = 1.0e18 * 720, math.pi**1.75


@query(
    "reflectivity_methods",
    STATE
    + f""", d AS (SELECT *, p / ({c.R_DRY} * t) AS ro, qr + qs + qg AS qt FROM st) SELECT {K} round(CASE WHEN qt > 1e-9 THEN {_RAIN!r} * pow(ro * qt, 1.75) ELSE 0 END, 1) AS m1,
  round(CASE WHEN qr > 1e-9 THEN {_CF / (_PIP * 8.0e6**0.75 * 1000.0**1.75)!r} * pow(ro * qr, 1.75) ELSE 0 END + CASE WHEN qs > 1e-9 THEN CASE WHEN t <= 273.16 THEN {_CF * 0.176 * 100.0**0.25 / (_PIP * 0.930 * 3.0e6**0.75 * 917.0**2)!r} ELSE {_CF / (_PIP * 3.0e6**0.75 * 917.0**1.75)!r} END * pow(ro * qs, 1.75) ELSE 0 END
    + CASE WHEN qg > 1e-9 THEN {(_CF / (_PIP * 4.0e4**0.75 * 913.0**1.75)) ** 0.95!r} * pow(ro * qg, 1.6625) ELSE 0 END, 1) AS m2,
  round(CASE WHEN qr > 1e-9 THEN 2.53e4 * pow(ro * qr * 1e3, 1.84) ELSE 0 END + CASE WHEN qs > 1e-9 THEN 3.48e3 * pow(ro * qs * 1e3, 1.66) ELSE 0 END + CASE WHEN qg > 1e-9 THEN 5.54e3 * pow(ro * qg * 1e3, 1.7) ELSE 0 END, 1) AS m3 FROM d""",
)
def reflectivity_methods(spark, sf_dir):
    s = state(spark, sf_dir)
    ro = radar.air_density(F.col("p"), F.col("t"))
    q = [F.col(x) for x in ("qr", "qs", "qg")]
    return s.select(*KEYS, r(radar.reflectivity_rain(ro, q[0] + q[1] + q[2]), 1).alias("m1"), r(radar.reflectivity_species(ro, F.col("t"), *q), 1).alias("m2"), r(radar.reflectivity_power(ro, *q), 1).alias("m3"))


@query("reflectivity_melting")
def reflectivity_melting(spark, sf_dir):
    s = state(spark, sf_dir)
    z = radar.reflectivity_power(radar.air_density(F.col("p"), F.col("t")), F.col("qr"), F.col("qs"), F.col("qg"), melting=True)
    value, low = radar.dbz(F.greatest(z, F.lit(1e-6)), 10.0, -5.0)
    return s.select(*KEYS, r(value).alias("dbz"), low.alias("low"))


@query(
    "radial_velocity",
    STATE + f"SELECT {K} round(u * cos(radians(line * 5)) * sin(radians(okey % 360)) + v * cos(radians(line * 5)) * cos(radians(okey % 360)) + (w - CASE WHEN qr + qs + qg > 1e-9 THEN 5.4 * pow(1e5 / p, 0.4) * pow(qr + qs + qg, 0.125) ELSE 0 END) * sin(radians(line * 5)), 6) AS vr FROM st",
)
def radial_velocity(spark, sf_dir):
    fall = radar.fall_speed_rain(F.col("qr") + F.col("qs") + F.col("qg"), F.col("p"))
    vr = radar.radial_velocity(F.col("u"), F.col("v"), F.col("w"), F.col("okey") % 360, F.col("line") * 5, fall)
    return state(spark, sf_dir).select(*KEYS, r(vr, 6).alias("vr"))


@query("radar_georeference")
def radar_georeference(spark, sf_dir):
    """Range gates to places and back to angles: azimuth and elevation return."""
    s = v_site(spark, sf_dir).select("obs_id", (F.col("x") * 3.6).alias("az"), (500 + F.col("y") * 500).alias("rng"), (F.col("lev") * 0.5).alias("el"))
    g = radar.georeference(F.col("az"), F.col("rng"), F.col("el"), 135.0, 34.0, 50.0)
    s = s.select("obs_id", "az", "el", *[v.alias(k) for k, v in g.items()])
    az, el = radar.beam_angles(F.col("lon"), F.col("lat"), F.col("z"), 135.0, 34.0, 50.0)
    return s.select("obs_id", r("lon", 6).alias("lon"), r("lat", 6).alias("lat"), r("z", 2).alias("z"), r(F.abs(F.pmod(az - F.col("az") + 180, F.lit(360.0)) - 180), 4).alias("d_az"), r(F.abs(el - F.col("el")), 3).alias("d_el"))


@query("great_circle_distance", ", p AS (SELECT cell, x * 3.6 - 180 AS lon, y * 1.8 - 90 AS lat FROM v_grid) SELECT cell, round(2 * 6371220.0 * asin(sqrt(least(1.0, sin(radians(lat - 35) / 2)**2 + cos(radians(lat)) * cos(radians(35)) * sin(radians(lon - 135) / 2)**2))), 2) AS d FROM p".lstrip(), "v_grid")
def great_circle_distance(spark, sf_dir):
    lon, lat = F.col("x") * 3.6 - 180, F.col("y") * 1.8 - 90
    return v_grid(spark, sf_dir).select("cell", r(geo.great_circle(lon, lat, F.lit(135.0), F.lit(35.0)), 2).alias("d"))


_R = 6371220.0
_HALF = "tan(pi() / 4 - radians({}) / 2)"
_N = f"(ln(cos(radians(30)) / cos(radians(60))) / ln({_HALF.format(30)} / {_HALF.format(60)}))"
_LC = f"(cos(radians(30)) / ({_N} * pow({_HALF.format(30)}, {_N})))"
_RHO = {"LC": f"{_R} * {_LC} * pow({{}}, {_N})", "PS": f"{_R} * (1 + sin(radians(30))) * {{}}"}
_MER = "ln(tan(pi() / 4 + radians({}) / 2))"
#: The projections' definitions as SQL: x and y of (lon, lat), with (135, 35) at (1000, 2000).
_FORWARD = {
    "NONE": (f"1000 + {_R} * radians(lon - 135)", f"2000 + {_R} * radians(lat - 35)"),
    "LC": (f"1000 + {_RHO['LC'].format(_HALF.format('lat'))} * sin({_N} * radians(lon - 135))", f"2000 + {_RHO['LC'].format(_HALF.format('35'))} - {_RHO['LC'].format(_HALF.format('lat'))} * cos({_N} * radians(lon - 135))"),
    "PS": (f"1000 + {_RHO['PS'].format(_HALF.format('lat'))} * sin(radians(lon - 135))", f"2000 + {_RHO['PS'].format(_HALF.format('35'))} - {_RHO['PS'].format(_HALF.format('lat'))} * cos(radians(lon - 135))"),
    "MER": (f"1000 + {_R} * cos(radians(30)) * radians(lon - 135)", f"2000 + {_R} * cos(radians(30)) * ({_MER.format('lat')} - {_MER.format('35')})"),
    "EC": (f"1000 + {_R} * cos(radians(30)) * radians(lon - 135)", f"2000 + {_R} * radians(lat - 35)"),
}

for _kind, (_x, _y) in _FORWARD.items():

    def _project(spark, sf_dir, kind=_kind):
        p = geo.Projection(kind, 135.0, 35.0, 30.0, 60.0, 1000.0, 2000.0)
        s = v_grid(spark, sf_dir).select("cell", (120 + F.col("x") * 0.3).alias("lon"), (20 + F.col("y") * 0.3).alias("lat"))
        x, y = p.forward(F.col("lon"), F.col("lat"))
        s = s.select("cell", "lon", "lat", x.alias("px"), y.alias("py"))
        lon, lat = p.inverse(F.col("px"), F.col("py"))
        return s.select("cell", r("px", 3).alias("px"), r("py", 3).alias("py"), r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))

    query(f"map_projection_{_kind.lower()}", f", p AS (SELECT cell, 120 + x * 0.3 AS lon, 20 + y * 0.3 AS lat FROM v_grid) SELECT cell, round({_x}, 3) AS px, round({_y}, 3) AS py, round(lon, 7) AS lon, round(lat, 7) AS lat FROM p", "v_grid")(_project)


@query(
    "map_factor",
    "SELECT cell, round(cos(radians(30)) / cos(radians(20 + y * 0.3)), 8) AS mer, round((1 + sin(radians(30))) * tan(pi() / 4 - radians(20 + y * 0.3) / 2) / cos(radians(20 + y * 0.3)), 8) AS ps, round(cos(radians(x * 0.3 - 15)), 8) AS c, round(sin(radians(x * 0.3 - 15)), 8) AS s FROM v_grid",
    "v_grid",
)
def map_factor(spark, sf_dir):
    lat, lon = 20 + F.col("y") * 0.3, 120 + F.col("x") * 0.3
    mer, ps = (geo.Projection(k, 135.0, 35.0) for k in ("MER", "PS"))
    cos, sin = ps.rotation(lon)
    return v_grid(spark, sf_dir).select("cell", r(mer.factor(lat), 8).alias("mer"), r(ps.factor(lat), 8).alias("ps"), r(cos, 8).alias("c"), r(sin, 8).alias("s"))


@query("vector_geometry", "SELECT cell, round(x * y + y * lev + lev * x, 4) AS dot, round(sqrt((y * x - lev * lev)**2 + (lev * y - x * x)**2 + (x * lev - y * y)**2) / 2, 4) AS area FROM v_grid", "v_grid")
def vector_geometry(spark, sf_dir):
    a, b = F.array("x", "y", "lev"), F.array("y", "lev", "x")
    return v_grid(spark, sf_dir).select("cell", r(geo.dot(a, b)).alias("dot"), r(geo.triangle_area(F.array(*[F.lit(0.0)] * 3), a, b)).alias("area"))


@query("parameter_transform", "SELECT cell, round(0.5 * ln((x + 5) / (105 - x)), 7) AS t, round(x, 6) AS x FROM v_grid", "v_grid")
def parameter_transform(spark, sf_dir):
    """To the unbounded line and back."""
    y = thermo.to_unbounded(F.col("x"), -5.0, 105.0)
    return v_grid(spark, sf_dir).select("cell", y.alias("t")).select("cell", r("t", 7).alias("t"), r(thermo.to_bounded(F.col("t"), -5.0, 105.0), 6).alias("x"))


@query("missing_sentinels", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice END AS v FROM part")
def missing_sentinels(spark, sf_dir):
    raw = F.when(F.col("p_size") % 12 == 0, -9.9999e30).when(F.col("p_size") % 12 == 4, -9.99e33).when(F.col("p_size") % 4 == 0, -32768.0).otherwise(F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("v")).select("p_partkey", thermo.missing(F.col("v")).alias("v"))


@query("unit_names", "SELECT event_type, CASE event_type WHEN 'click' THEN 'air_temperature' WHEN 'view' THEN 'air_pressure' ELSE 'unknown' END AS standard_name, count(*) AS n FROM events GROUP BY 1, 2")
def unit_names(spark, sf_dir):
    from ..functions.lookup import case_map

    name = case_map(F.col("event_type"), {"click": "air_temperature", "view": "air_pressure"}, "unknown")
    return table(spark, sf_dir, "events").groupBy("event_type", name.alias("standard_name")).agg(F.count(F.lit(1)).alias("n"))
