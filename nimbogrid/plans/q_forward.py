"""Forward operators, terrain, nudging, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as c
from ..functions.special import gamma
from ..operators import forward
from ..sources.observations import ELEMENTS
from .registry import query
from .views import r, seconds_since, table, v_cell, v_grid, v_site

_ELM = ["U", "V", "T", "TV", "Q", "RH", "PS", "REF"]


def _at(spark, sf_dir):
    """Sites as observations of eight elements, with the model's values at their places."""
    x, y, lev = F.col("x"), F.col("y"), F.col("lev")
    elm = F.element_at(F.array(*[F.lit(ELEMENTS[e]) for e in _ELM]), (F.col("obs_id") % 8 + 1).cast("int"))
    return v_site(spark, sf_dir).select(
        "obs_id", elm.alias("elm"), (F.col("obs_id") % 5).alias("typ"), (x - 50).alias("u"), (y - 50).alias("v"), (x / 2 - 20).alias("u10"), (y / 2 - 20).alias("v10"), (250 + lev).cast("double").alias("t"), (x / 10000).alias("q"),
        (100000 - lev * 1000).cast("double").alias("p"), (270 + lev / 2).alias("t2"), (y / 10000).alias("q2"), (99000 + x * 10).alias("ps"), (y * 3).alias("topo"), (x * 4).alias("rk"),
    )


@query(
    "observation_operator",
    f""", a AS (SELECT obs_id, (obs_id % 8)::INT AS e, obs_id % 5 AS typ, x - 50 AS u, y - 50 AS v, x / 2 - 20 AS u10, y / 2 - 20 AS v10, (250 + lev)::DOUBLE AS t, x / 10000 AS q, (100000 - lev * 1000)::DOUBLE AS p,
   270 + lev / 2.0::DOUBLE AS t2, y / 10000 AS q2, 99000 + x * 10 AS ps, y * 3 AS topo, x * 4 AS rk FROM v_site),
 h AS (SELECT *, q * p * 0.01 / (0.378 * q + 0.622) AS vp, t - 273.15 AS tc, 6.11 * exp(17.3 * (t - 273.15) / (237.3 + t - 273.15)) AS l, 6.1121 * exp(22.587 * (t - 273.15) / (273.86 + t - 273.15)) AS i FROM a)
SELECT obs_id, round(CASE e WHEN 0 THEN CASE WHEN typ = 1 THEN u10 ELSE u END WHEN 1 THEN CASE WHEN typ = 1 THEN v10 ELSE v END WHEN 2 THEN t WHEN 3 THEN t * (1 + {c.EPST_VAP!r} * q) WHEN 4 THEN q
  WHEN 5 THEN vp / CASE WHEN tc >= 0 THEN l WHEN tc <= -15 THEN i ELSE l * (15 + tc) / 15 + i * (-tc) / 15 END
  WHEN 6 THEN CASE WHEN rk = topo THEN ps ELSE ps * pow((t2 * (1 + 0.608 * q2) - 0.005 * (rk - topo)) / (t2 * (1 + 0.608 * q2)), {c.GRAVITY} / (0.005 * {c.R_DRY})) END END, 5) AS y,
  CASE WHEN typ = 2 AND e <> 6 THEN 90 WHEN e = 7 THEN 90 WHEN e = 6 AND abs(rk - topo) > 100 THEN 10 ELSE 0 END AS qc FROM h""".lstrip(),
    "v_site",
)
def observation_operator(spark, sf_dir):
    a = _at(spark, sf_dir)
    y, code = forward.model_value(F.col("elm"), {k: F.col(k) for k in a.columns}, F.col("rk"), 100.0, F.col("typ") == 2, F.col("typ") == 1)
    return a.select("obs_id", r(y, 5).alias("y"), code.alias("qc"))


@query("radar_operator")
def radar_operator(spark, sf_dir):
    """Reflectivity and radial velocity at sites seen from a radar; its parts have SQL of their own."""
    from .q_scalar import state

    s = state(spark, sf_dir)
    at = {k: F.col(k) for k in ("u", "v", "w", "t", "p", "qr", "qs", "qg")}
    h = forward.radar_value(at, 135 + F.col("line") / 10, 34 + F.col("okey") % 7 / 10, 500 * F.col("line"), (135.0, 34.0, 50.0), 10.0, -5.0)
    return s.select("okey", "line", "price", *[(r(v) if k != "low" else v).alias(k) for k, v in h.items()])


@query(
    "terrain_levels",
    ", t AS (SELECT i, j, avg(vr) * 10 AS topo FROM v_cell GROUP BY i, j) SELECT i, j, k, round(((12000 - topo) / 12000 * k * 500 + topo)::DECIMAL(28, 8), 5)::DOUBLE AS z FROM t, (SELECT unnest(range(1, 8))::INT AS k)".lstrip(),
    "v_cell",
)
def terrain_levels(spark, sf_dir):
    t = v_cell(spark, sf_dir).groupBy("i", "j").agg((F.avg("vr") * 10).alias("topo"))
    t = t.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return t.select("i", "j", "k", r(forward.terrain_height(F.col("k") * 500.0, F.col("topo"), 12000.0), 5, 8).alias("z"))


for _m, _sql in (
    (1, "(floor(abs(dx) / 2) % 2 = 0 AND floor(abs(dy) / 2) % 2 = 0 AND floor(abs(dz) / 5) % 3 = 0) OR (floor(abs(dx) / 2) < 2 AND floor(abs(dy) / 2) < 2 AND floor(abs(dz) / 5) < 2)"),
    (2, "round(dx / 2) % 2 = 0 AND round(dy / 2) % 2 = 0 AND (sign(round(dz)) * floor(abs(round(dz)) / 5)) % 3 = 0"),
):

    def _thin(spark, sf_dir, m=_m):
        keep = forward.search_thinning(F.col("x") - 50, F.col("y") - 50, F.col("lev") - 25.0, m, 2.0, 5.0, 2, 3, 2, 2)
        return v_site(spark, sf_dir).filter(keep).groupBy("ctype").agg(F.count(F.lit(1)).alias("n"), F.min("obs_id").alias("first"))

    query(f"search_thinning_{_m}", f", d AS (SELECT *, x - 50 AS dx, y - 50 AS dy, lev - 25.0::DOUBLE AS dz FROM v_site) SELECT ctype, count(*) AS n, min(obs_id) AS first FROM d WHERE {_sql} GROUP BY ctype".lstrip(), "v_site")(_thin)


@query("nudging", "SELECT cell, round(x + 60.0 / 600.0::DOUBLE * (y / 100) * (CASE WHEN cell % 7 <> 0 THEN y END - x), 6) AS t, round(coalesce(x + 60.0 / 600.0::DOUBLE * (y / 100) * (CASE WHEN cell % 7 <> 0 THEN y END - x), x), 6) AS x FROM v_grid", "v_grid")
def nudging(spark, sf_dir):
    ref = F.when(F.col("cell") % 7 != 0, F.col("y"))
    x = forward.nudge(F.col("x"), ref, F.col("y") / 100, 60.0, 600.0)
    return v_grid(spark, sf_dir).select("cell", r(F.when(ref.isNotNull(), x), 6).alias("t"), r(x, 6).alias("x"))


@query(
    "history_requests",
    """WITH s AS (SELECT event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, value, (user_id % 10)::DOUBLE AS load, (1 + user_id % 3)::DOUBLE AS dt FROM events),
 q AS (SELECT event_type, 'value_6h' AS name, ceil(t / 21600)::BIGINT AS interval, sum(value * dt) / sum(dt) AS v FROM s GROUP BY 1, 3 UNION ALL SELECT event_type, 'value_1d', ceil(t / 86400)::BIGINT, sum(value * dt) / sum(dt) FROM s GROUP BY 1, 3
  UNION ALL SELECT event_type, 'load', ceil(t / 86400)::BIGINT, max(load) FROM s GROUP BY 1, 3) SELECT event_type, name, interval, round((v)::DECIMAL(28, 7), 4)::DOUBLE AS value FROM q""",
)
def history_requests(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("event_type", seconds_since("ts", "2024-01-01").alias("t"), "value", (F.col("user_id") % 10).cast("double").alias("load"), (1 + F.col("user_id") % 3).cast("double").alias("dt"))
    q = [forward.Request("value", 21600, "mean", "value_6h"), forward.Request("value", 86400, "mean", "value_1d"), forward.Request("load", 86400, "max")]
    return forward.history_requests(s, q, ["event_type"], "t", "dt").select("event_type", "name", "interval", r("value", 4, 7).alias("value"))


@query("gamma_function", "SELECT p_size, round(lgamma(p_size / 7.0::DOUBLE), 9) AS log_g, round(gamma(p_size / 7.0::DOUBLE), 4) AS g, count(*) AS n FROM part GROUP BY p_size")
def gamma_function(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    g = gamma(F.col("p_size") / 7)
    return p.select("p_size", r(F.log(g), 9).alias("log_g"), r(g).alias("g"), "n")


@query(
    "taper_weights",
    """, z AS (SELECT cell, sqrt((x - 50)**2 + (y - 50)**2) / 20 AS z FROM v_grid)
SELECT cell, round(CASE WHEN z <= 1 THEN -0.25 * z**5 + 0.5 * z**4 + 0.625 * z**3 - 5.0::DOUBLE / 3 * z**2 + 1 WHEN z < 2 THEN z**5 / 12 - 0.5 * z**4 + 0.625 * z**3 + 5.0::DOUBLE / 3 * z**2 - 5 * z + 4 - 2.0::DOUBLE / 3 / z ELSE 0 END, 8) AS w FROM z""".lstrip(),
    "v_grid",
)
def taper_weights(spark, sf_dir):
    d = F.sqrt((F.col("x") - 50) ** 2 + (F.col("y") - 50) ** 2)
    return v_grid(spark, sf_dir).select("cell", r(forward.taper(d, 20.0), 8).alias("w"))


@query(
    "monthly_constant",
    """, m AS (SELECT month(day) AS mon, avg(total) AS clim FROM v_series GROUP BY 1) SELECT s.day, round((s.total - m.clim)::DECIMAL(28, 4), 1)::DOUBLE AS anomaly FROM v_series s JOIN m ON month(s.day) = m.mon""".lstrip(),
    "v_series",
)
def monthly_constant(spark, sf_dir):
    """External data that are constant in each month: an equi-join on the month, twelve rows."""
    from .views import v_series

    s = v_series(spark, sf_dir).withColumn("mon", F.month("day"))
    m = s.groupBy("mon").agg(F.avg("total").alias("clim"))
    return s.join(m, "mon").select("day", r(F.col("total") - F.col("clim"), 1, 4).alias("anomaly"))


@query("stretched_levels")
def stretched_levels(spark, sf_dir):
    """A generated vertical grid; compared in tests with the sum of a geometric series."""
    z = forward.stretched_levels(50.0, 1.1, 500.0, 40)
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(z)], "k int, z double")
