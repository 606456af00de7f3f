"""Superobing, slots, category shares, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reduce, timeops
from .q_obs import QC_SQL, obs_with_qc
from .registry import query
from .views import r, table, v_cell, v_series


@query(
    "radar_superob",
    """, a AS (SELECT i, j, k, avg(z) AS z, sum(vr * z) / sum(z) AS vr, count(z) AS n_z, count(vr) AS n_vr, stddev_pop(vr) AS sd FROM v_cell GROUP BY i, j, k)
SELECT i, j, k, round(z, 3) AS z, round(CASE WHEN sd <= 15 THEN vr END, 5) AS vr, n_z, CASE WHEN sd > 15 THEN 0 ELSE n_vr END AS n_vr FROM a""".lstrip(),
    "v_cell",
)
def radar_superob(spark, sf_dir):
    s = reduce.radar_superob(v_cell(spark, sf_dir), ["i", "j", "k"], most_deviation=15.0)
    return s.select("i", "j", "k", r("z", 3).alias("z"), r("vr", 5).alias("vr"), "n_z", "n_vr")


def _near(spark, sf_dir):
    """Cells' rows with a distance from the centre and a row id that breaks all ties."""
    return v_cell(spark, sf_dir).withColumn("dist", F.abs(F.col("vr") - 25)).withColumn("rid", F.col("okey") * 100000000 + F.round(F.col("z") * 100).cast("long"))


NEAR = """, n AS (SELECT *, abs(vr - 25) AS dist, okey * 100000000 + round(z * 100)::BIGINT AS rid FROM v_cell) """.lstrip()


@query("superob_nearest", NEAR + "SELECT i, j, k, z, err, rid FROM (SELECT *, row_number() OVER (PARTITION BY i, j, k ORDER BY err, dist, rid, z) AS o FROM n) WHERE o = 1", "v_cell")
def superob_nearest(spark, sf_dir):
    return reduce.superob(_near(spark, sf_dir), ["i", "j", "k"], 1, "z", "err", "dist", "rid")


@query("superob_average", NEAR + "SELECT i, j, k, round((avg(z))::DECIMAL(28, 7), 4)::DOUBLE AS z, min(err) AS err, count(*) AS n FROM n GROUP BY i, j, k", "v_cell")
def superob_average(spark, sf_dir):
    return reduce.superob(_near(spark, sf_dir), ["i", "j", "k"], 2, "z").withColumn("z", r("z", 4, 7))


@query("superob_best_average", NEAR + "SELECT i, j, k, round((avg(z))::DECIMAL(28, 7), 4)::DOUBLE AS z, min(err) AS err, count(*) AS n FROM (SELECT *, min(err) OVER (PARTITION BY i, j, k) AS e FROM n) WHERE err = e GROUP BY i, j, k", "v_cell")
def superob_best_average(spark, sf_dir):
    return reduce.superob(_near(spark, sf_dir), ["i", "j", "k"], 3, "z").withColumn("z", r("z", 4, 7))


@query(
    "slot_reduction",
    QC_SQL + "SELECT elm, typ, slot, obs_id FROM (SELECT *, row_number() OVER (PARTITION BY elm, typ ORDER BY abs(slot - 1), slot, obs_id) AS o FROM q) WHERE o = 1",
    "v_obs",
)
def slot_reduction(spark, sf_dir):
    o = obs_with_qc(spark, sf_dir).select("elm", "typ", "slot", "obs_id")
    return reduce.slot_reduction(o, ["elm", "typ"], "slot", 1, "obs_id")


@query("slot_base_only", QC_SQL + "SELECT elm, typ, slot, obs_id FROM (SELECT *, row_number() OVER (PARTITION BY elm, typ ORDER BY obs_id) AS o FROM q WHERE slot = 1) WHERE o = 1", "v_obs")
def slot_base_only(spark, sf_dir):
    o = obs_with_qc(spark, sf_dir).select("elm", "typ", "slot", "obs_id")
    return reduce.slot_reduction(o, ["elm", "typ"], "slot", 1, "obs_id", method=2)


@query(
    "record_islands",
    """WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  s AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c)
  SELECT user_id, island, event_type, count(*) AS n FROM s GROUP BY 1, 2, 3""",
)
def record_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return reduce.islands(e, ["event_id"], ["event_type"], ["user_id"]).groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("column_reduce", "SELECT i, j, max(z) AS most, min(z) AS least, round(sum(z), 2) AS total, round(avg(z), 4) AS mean FROM v_cell WHERE k BETWEEN 2 AND 5 GROUP BY i, j", "v_cell")
def column_reduce(spark, sf_dir):
    c = reduce.column_reduce(v_cell(spark, sf_dir), ["i", "j"], "z", "k", 2, 5)
    return c.select("i", "j", "most", "least", r("total", 2).alias("total"), r("mean").alias("mean"))


@query(
    "category_share",
    """, w AS (SELECT i, j, k, sum(cos(radians(vr))) AS w FROM v_cell GROUP BY i, j, k), t AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY w DESC, k) AS n FROM w)
SELECT i, j, k, n::INT AS rank, round(w / sum(w) OVER (PARTITION BY i, j), 6) AS share FROM t WHERE n <= 3""".lstrip(),
    "v_cell",
)
def category_share(spark, sf_dir):
    s = reduce.category_share(v_cell(spark, sf_dir), ["i", "j"], "k", F.cos(F.radians("vr")), 3)
    return s.select("i", "j", "k", "rank", r("share", 6).alias("share"))


@query("density_grid", "SELECT i, j, k, count(*) AS n FROM v_cell GROUP BY i, j, k", "v_cell")
def density_grid(spark, sf_dir):
    return v_cell(spark, sf_dir).groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lanczos_filter",
    """, s AS (SELECT total, (row_number() OVER (ORDER BY day)) - 1 AS n, (count(*) OVER ()) AS c FROM v_series),
w AS (SELECT o, CASE WHEN o = 0 THEN 0.6 / pi() ELSE sin(0.6 * o) * sin(pi() * o / 10) * 10 / (pi() * o * pi() * o) END AS w FROM (SELECT unnest(range(-10, 11)) AS o))
SELECT (s.n + w.o + s.c) % s.c AS n, round(sum(total * w), 2) AS total FROM s, w GROUP BY 1""".lstrip(),
    "v_series",
)
def lanczos_filter(spark, sf_dir):
    s = v_series(spark, sf_dir)
    days = s.count()
    numbered = timeops.row_numbers(s, ["day"], F.year("day"), "nth").select((F.col("nth") - 1).alias("n"), "total")
    return reduce.lanczos(numbered, "n", "total", days, reduce.lanczos_weights(0.6)).withColumn("total", r("total", 2))


@query(
    "diffusion_filter",
    """, g AS (SELECT i, j, avg(z) AS p FROM v_cell GROUP BY i, j)
SELECT a.i, a.j, round(((count(b.p) * a.p - sum(b.p)) / nullif(2 * count(b.p), 0))::DECIMAL(28, 7), 4)::DOUBLE AS p FROM g a LEFT JOIN g b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.i, a.j, a.p""".lstrip(),
    "v_cell",
)
def diffusion_filter(spark, sf_dir):
    g = v_cell(spark, sf_dir).groupBy("i", "j").agg(F.avg("z").alias("p"))
    return reduce.diffusion_step(g, "i", "j", "p", 20, 20).withColumn("p", r("p", 4, 7))


def _rough(table: str, name: str) -> str:
    """SQL of one pass of second differences over a table (i, j, p)."""
    return f"{name} AS (SELECT a.i, a.j, (count(b.p) * a.p - sum(b.p)) / (2 * count(b.p)) AS p FROM {table} a JOIN {table} b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.i, a.j, a.p)"


_ROUNDS = ", ".join(
    f"{_rough(f'g{n}', f'a{n}')}, {_rough(f'a{n}', f'b{n}')}, g{n + 1} AS (SELECT i, j, s * greatest(s * (g{n}.p - b{n}.p), 0) AS p FROM g{n} JOIN b{n} USING (i, j) JOIN l USING (i, j))" for n in range(2)
)


@query(
    "hyperdiffusion_filter",
    f""", g0 AS (SELECT i, j, avg(z) - 30000 AS p FROM v_cell GROUP BY i, j), l AS (SELECT i, j, CASE WHEN (i + j) % 3 = 0 THEN 1.0 WHEN p < 0 THEN -1.0 ELSE 1.0 END AS s FROM g0), {_ROUNDS}
SELECT i, j, round((p)::DECIMAL(28, 7), 3)::DOUBLE AS p FROM g2""".lstrip(),
    "v_cell",
)
def hyperdiffusion_filter(spark, sf_dir):
    """Second order, two iterations, with a limiter of the sign."""
    g = v_cell(spark, sf_dir).groupBy("i", "j").agg((F.avg("z") - 30000).alias("p"))
    g = g.withColumn("s", F.when((F.col("i") + F.col("j")) % 3 == 0, 1.0).when(F.col("p") < 0, -1.0).otherwise(1.0))
    return reduce.hyperdiffusion(g, "i", "j", "p", 20, 20, 2, 2, "s").withColumn("p", r("p", 3, 7))
