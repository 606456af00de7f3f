"""Derived variables of a state made of cell means."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as c
from ..operators import derived
from .registry import query
from .views import r, v_cell


def v_state(spark, sf_dir):
    """i, j, k with dens, u, v, w, mw, t, p, moisture, z, dz, area: smooth profiles disturbed by cell means."""
    m = v_cell(spark, sf_dir).groupBy("i", "j", "k").agg(F.avg("z").alias("a"), F.avg("vr").alias("b"), F.avg("err").alias("e"), F.avg("tax").alias("x"))
    k = F.col("k")
    return m.select(
        "i", "j", "k", (1.2 - 0.1 * k + F.col("e")).alias("dens"), (F.col("x") * 100).alias("u"), (F.col("e") * 100).alias("v"), (F.col("b") / 50 - 0.5).alias("w"), (F.col("b") - 25).alias("mw"),
        (300 - 6 * k + F.col("b") / 50).alias("t"), (100000 - 8000 * k + F.col("a") / 100).alias("p"), (0.012 / k + F.col("x") / 100).alias("qv"), (F.col("e") * 0.001).alias("qc"), (F.col("x") * 0.001).alias("qr"),
        (F.col("e") * 0.0001).alias("qi"), (F.col("x") * 0.0002).alias("qs"), (F.col("e") * 0.0003).alias("qg"), (500.0 * k).alias("z"), F.lit(500.0).alias("dz"), (1 + F.col("i") / 100).alias("area"),
    )


STATE = """, m AS (SELECT i, j, k, avg(z) AS a, avg(vr) AS b, avg(err) AS e, avg(tax) AS x FROM v_cell GROUP BY i, j, k),
 st AS (SELECT i, j, k, 1.2::DOUBLE - 0.1::DOUBLE * k + e AS dens, x * 100 AS u, e * 100 AS v, b / 50 - 0.5 AS w, b - 25 AS mw, 300 - 6 * k + b / 50 AS t, 100000 - 8000 * k + a / 100 AS p, 0.012::DOUBLE / k + x / 100 AS qv,
  e * 0.001 AS qc, x * 0.001 AS qr, e * 0.0001 AS qi, x * 0.0002 AS qs, e * 0.0003 AS qg, 500.0::DOUBLE * k AS z, 500.0::DOUBLE AS dz, 1 + i / 100::DOUBLE AS area FROM m) """.lstrip()

PT = f"(t / pow(p / {c.P00}, {c.R_DRY / c.CP_DRY!r}))"
POTV = f"({PT} * (1 + {c.EPST_VAP!r} * qv))"
LHV = f"({c.LHV00!r} + {c.CP_VAP - c.C_LIQUID!r} * t)"
LHS = f"({c.LHS00!r} + {c.CP_VAP - c.C_ICE!r} * t)"
PSATL = f"({c.PSAT0} * pow(t / {c.T0}, {(c.CP_VAP - c.C_LIQUID) / c.R_VAP!r}) * exp({c.LHV00 / c.R_VAP!r} * (1 / {c.T0}::DOUBLE - 1 / t)))"
PSATI = f"({c.PSAT0} * pow(t / {c.T0}, {(c.CP_VAP - c.C_ICE) / c.R_VAP!r}) * exp({c.LHS00 / c.R_VAP!r} * (1 / {c.T0}::DOUBLE - 1 / t)))"

#: name -> (SQL, digits)
CELLS = {
    "moisture": {"QLIQ": ("qc + qr", 10), "QICE": ("qi + qs + qg", 10), "QHYD": ("qc + qr + qi + qs + qg", 10), "QTOT": ("qv + qc + qr + qi + qs + qg", 9)},
    "heat": {"EXNER": (f"pow(p / {c.P00}, {c.R_DRY / c.CP_DRY!r})", 8), "PT": (PT, 5), "POTV": (POTV, 5), "LHV": (LHV, 2), "LHS": (LHS, 2), "LHF": (f"{LHS} - {LHV}", 2), "MSE": (f"{c.CP_DRY} * t + {c.GRAVITY} * z + {LHV} * qv", 2)},
    "liquid_water": {"TEML": (f"t - ({LHV} * (qc + qr) + {LHS} * (qi + qs + qg)) / {c.CP_DRY}", 6), "POTL": (f"(t - ({LHV} * (qc + qr) + {LHS} * (qi + qs + qg)) / {c.CP_DRY}) / pow(p / {c.P00}, {c.R_DRY / c.CP_DRY!r})", 5), "POTE": (f"{PT} * exp({LHV} * qv / ({c.CP_DRY} * t))", 4)},
    "humidity": {"RHL": (f"dens * qv / {PSATL} * {c.R_VAP} * t * 100", 4), "RHI": (f"dens * qv / {PSATI} * {c.R_VAP} * t * 100", 4), "QSAT": (f"{c.EPS_VAP!r} * (1 - (qv + qc + qr + qi + qs + qg)) * {PSATL} / (p - {PSATL})", 8)},
    "energy": {"UABS": ("sqrt(u * u + v * v + w * w)", 6), "ENGP": (f"dens * {c.GRAVITY} * z", 3), "ENGK": ("0.5 * dens * (u * u + v * v + w * w)", 4)},
}

for _name, _vars in CELLS.items():
    query(f"derived_{_name}", STATE + "SELECT i, j, k, " + ", ".join((f'round(({sql})::DECIMAL(28, 7), {d})::DOUBLE AS "{v}"' if d < 5 else f'round({sql}, {d}) AS "{v}"') for v, (sql, d) in _vars.items()) + " FROM st", "v_cell")(
        lambda spark, sf_dir, names=_vars: derived.resolve(v_state(spark, sf_dir), list(names)).select("i", "j", "k", *[r(v, d, 7 if d < 5 else None).alias(v) for v, (_, d) in names.items()])
    )


@query("derived_total_energy")
def derived_total_energy(spark, sf_dir):
    """Internal and total energy, and the dew point (an iteration in one expression)."""
    s = derived.resolve(v_state(spark, sf_dir), ["ENGI", "ENGT", "TDEW", "RHA"])
    return s.select("i", "j", "k", r("ENGI", 2).alias("ENGI"), r("ENGT", 2).alias("ENGT"), r("TDEW").alias("TDEW"), r("RHA").alias("RHA"))


ENGI = f"dens * ((1 - (qv + qc + qr + qi + qs + qg)) * {c.CV_DRY!r} * t + qv * ({c.CV_VAP!r} * t + {c.LHV00!r}) + (qc + qr) * {c.C_LIQUID!r} * t + (qi + qs + qg) * ({c.C_ICE!r} * t - ({c.LHS00!r} - {c.LHV00!r})))"


@query("derived_energy_sums", STATE + f"SELECT i, j, k, round({ENGI}, 2) AS \"ENGI\", round({ENGI} + dens * {c.GRAVITY!r} * z + 0.5 * dens * (u * u + v * v + w * w), 2) AS \"ENGT\" FROM st", "v_cell")
def derived_energy_sums(spark, sf_dir):
    """Internal energy, and its sum with potential and kinetic energy."""
    s = derived.resolve(v_state(spark, sf_dir), ["ENGI", "ENGT"])
    return s.select("i", "j", "k", r("ENGI", 2).alias("ENGI"), r("ENGT", 2).alias("ENGT"))


@query(
    "derived_stability",
    STATE
    + f""", s AS (SELECT i, j, k, {POTV} AS b, z FROM st), n AS (SELECT *, lead(b) OVER w AS u, lead(z) OVER w AS zu, lag(b) OVER w AS d, lag(z) OVER w AS zd FROM s WINDOW w AS (PARTITION BY i, j ORDER BY k))
SELECT i, j, k, round({c.GRAVITY} / b * (coalesce(u, b) - coalesce(d, b)) / (coalesce(zu, z) - coalesce(zd, z)), 9) AS "N2" FROM n""",
    "v_cell",
)
def derived_stability(spark, sf_dir):
    return derived.resolve(v_state(spark, sf_dir), ["N2"]).select("i", "j", "k", r("N2", 9).alias("N2"))


@query("derived_face_velocity", STATE + 'SELECT i, j, k, round(coalesce(2 * mw / (dens + lead(dens) OVER (PARTITION BY i, j ORDER BY k)), 0), 6) AS "VELZ" FROM st', "v_cell")
def derived_face_velocity(spark, sf_dir):
    return derived.resolve(v_state(spark, sf_dir), ["VELZ"]).select("i", "j", "k", r("VELZ", 6).alias("VELZ"))


@query(
    "derived_level_means",
    STATE + f'SELECT k, round(sum(dens * area) / sum(area), 7) AS "dens_MEAN", round(sum(u * dens * area) / sum(dens * area), 6) AS "u_MEAN", round(sum({PT} * dens * area) / sum(dens * area), 5) AS "PT_MEAN" FROM st GROUP BY k',
    "v_cell",
)
def derived_level_means(spark, sf_dir):
    m = derived.level_means(v_state(spark, sf_dir), ["dens"], ["u", "PT"])
    return m.select("k", r("dens_MEAN", 7).alias("dens_MEAN"), r("u_MEAN", 6).alias("u_MEAN"), r("PT_MEAN", 5).alias("PT_MEAN"))


@query(
    "derived_primes",
    STATE + ', x AS (SELECT k, sum(dens * area) / sum(area) AS d, sum(u * dens * area) / sum(dens * area) AS um FROM st GROUP BY k) SELECT i, j, k, round(dens - d, 7) AS "dens_PRIM", round(u - um, 6) AS "u_PRIM" FROM st JOIN x USING (k)',
    "v_cell",
)
def derived_primes(spark, sf_dir):
    return derived.primes(v_state(spark, sf_dir), ["dens"], ["u"]).select("i", "j", "k", r("dens_PRIM", 7).alias("dens_PRIM"), r("u_PRIM", 6).alias("u_PRIM"))


@query(
    "derived_turbulence",
    STATE
    + f""", x AS (SELECT k, sum(u * dens * area) / sum(dens * area) AS um, sum(v * dens * area) / sum(dens * area) AS vm, sum(w * dens * area) / sum(dens * area) AS wm, sum({PT} * dens * area) / sum(dens * area) AS tm FROM st GROUP BY k),
 y AS (SELECT k, area, dens, u - um AS u, v - vm AS v, w - wm AS w, {PT} - tm AS t FROM st JOIN x USING (k))
SELECT k, round(sum(w * w * area) / sum(area), 7) AS "W_PRIM2", round(sum(w * w * w * area) / sum(area), 7) AS "W_PRIM3", round(sum(w * t * dens * {c.CP_DRY} * area) / sum(area), 4) AS "PT_W_PRIM", round(sum(0.5 * (u * u + v * v + w * w) * area) / sum(area), 6) AS "TKE_RS" FROM y GROUP BY k""",
    "v_cell",
)
def derived_turbulence(spark, sf_dir):
    t = derived.turbulence(v_state(spark, sf_dir))
    return t.select("k", r("W_PRIM2", 7).alias("W_PRIM2"), r("W_PRIM3", 7).alias("W_PRIM3"), r("PT_W_PRIM").alias("PT_W_PRIM"), r("TKE_RS", 6).alias("TKE_RS"))


@query(
    "derived_water_paths",
    STATE + 'SELECT i, j, round((sum((qc + qr) * dens * dz * 1000))::DECIMAL(28, 7), 4)::DOUBLE AS "LWP", round((sum((qi + qs + qg) * dens * dz * 1000))::DECIMAL(28, 7), 4)::DOUBLE AS "IWP", round((sum((qv + qc + qr + qi + qs + qg) * dens * dz * 1000))::DECIMAL(28, 7), 3)::DOUBLE AS "PW" FROM st GROUP BY i, j',
    "v_cell",
)
def derived_water_paths(spark, sf_dir):
    return derived.column_paths(v_state(spark, sf_dir)).select("i", "j", r("LWP", 4, 7).alias("LWP"), r("IWP", 4, 7).alias("IWP"), r("PW", 3, 7).alias("PW"))


@query(
    "derived_boundary_layer",
    STATE
    + f""", s AS (SELECT i, j, k, z, {POTV} AS b FROM st), n AS (SELECT *, first_value(b) OVER w AS b0, min(z) OVER (PARTITION BY i, j) AS z0, lag(b) OVER w AS bl, lag(z) OVER w AS zl FROM s WINDOW w AS (PARTITION BY i, j ORDER BY k)),
 f AS (SELECT i, j, arg_min(zl + (z - zl) * (b0 - bl) / (b - bl), k) AS h FROM n WHERE b > b0 GROUP BY i, j)
SELECT c.i, c.j, round(coalesce(h, z0), 4) AS "PBLH" FROM (SELECT DISTINCT i, j, z0 FROM n) c LEFT JOIN f ON f.i = c.i AND f.j = c.j""",
    "v_cell",
)
def derived_boundary_layer(spark, sf_dir):
    return derived.boundary_layer_height(v_state(spark, sf_dir)).select("i", "j", r("PBLH").alias("PBLH"))


@query(
    "derived_rotation_divergence",
    STATE
    + """, n AS (SELECT *, (lead(v) OVER wi - lag(v) OVER wi) / 2000 AS vx, (lead(u) OVER wi - lag(u) OVER wi) / 2000 AS ux, (lead(v) OVER wj - lag(v) OVER wj) / 2000 AS vy, (lead(u) OVER wj - lag(u) OVER wj) / 2000 AS uy FROM st WINDOW wi AS (PARTITION BY j, k ORDER BY i), wj AS (PARTITION BY i, k ORDER BY j))
SELECT i, j, k, round(vx - uy, 9) AS "VOR", round(ux + vy, 9) AS "HDIV" FROM n""",
    "v_cell",
)
def derived_rotation_divergence(spark, sf_dir):
    return derived.rotation_divergence(v_state(spark, sf_dir), 1000.0, 1000.0).select("i", "j", "k", r("VOR", 9).alias("VOR"), r("HDIV", 9).alias("HDIV"))


@query("derived_convective_energy")
def derived_convective_energy(spark, sf_dir):
    """Parcel ascent; an iteration per level, compared in tests with known profiles."""
    e = derived.convective_energy(v_state(spark, sf_dir))
    return e.select("i", "j", *[r(x, 3).alias(x) for x in ("CAPE", "CIN", "LCL", "LFC", "LNB")])
