"""Ensembles, transforms, observation impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as ens
from ..operators import joins, kalman, stats
from .registry import query
from .views import r, v_ens, v_ens_array, v_grid, v_site


@query("ensemble_mean_spread", "SELECT vec_id, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS spread FROM v_ens GROUP BY vec_id", "v_ens")
def ensemble_mean_spread(spark, sf_dir):
    return ens.mean_spread(v_ens(spark, sf_dir), ["vec_id"], "x").select("vec_id", r("mean", 6).alias("mean"), r("spread", 6).alias("spread"))


@query("ensemble_perturbations", "SELECT vec_id, member, round(x - avg(x) OVER (PARTITION BY vec_id), 6) AS p FROM v_ens", "v_ens")
def ensemble_perturbations(spark, sf_dir):
    e = v_ens_array(spark, sf_dir).select("vec_id", F.posexplode(ens.perturbations(F.col("ens"))).alias("m", "p"))
    return e.select("vec_id", (F.col("m") + 1).cast("long").alias("member"), r("p", 6).alias("p"))


@query("observation_departure", "SELECT vec_id, round(elm / 10.0::DOUBLE - avg(x), 6) AS d, round(sum(x * x) - 10 * avg(x) * avg(x), 6) AS yy FROM v_ens GROUP BY vec_id, elm", "v_ens")
def observation_departure(spark, sf_dir):
    d, y = ens.observation_departure(F.col("elm") / 10, F.col("ens"))
    yy = F.aggregate(y, F.lit(0.0), lambda a, v: a + v * v)
    return v_ens_array(spark, sf_dir).select("vec_id", r(d, 6).alias("d"), r(yy, 6).alias("yy"))


@query("multiplicative_inflation", "SELECT vec_id, member, round(m + sqrt(1.3::DOUBLE) * (x - m), 6) AS x FROM (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS m FROM v_ens)", "v_ens")
def multiplicative_inflation(spark, sf_dir):
    e = v_ens_array(spark, sf_dir).select("vec_id", F.posexplode(ens.inflate(F.col("ens"), 1.3)).alias("m", "x"))
    return e.select("vec_id", (F.col("m") + 1).cast("long").alias("member"), r("x", 6).alias("x"))


@query(
    "additive_inflation",
    """WITH e AS (SELECT vec_id, u.m AS member, embedding[u.m]::DOUBLE AS x, embedding[u.m + 10]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(1, 11)) AS m) u)
SELECT vec_id, member, round(x + 0.2 * (y - avg(y) OVER (PARTITION BY vec_id)), 6) AS x FROM e""",
)
def additive_inflation(spark, sf_dir):
    from .views import table

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 10).cast("array<double>").alias("a"), F.slice("embedding", 11, 10).cast("array<double>").alias("b"))
    out = e.select("vec_id", F.posexplode(ens.additive_inflation(F.col("a"), F.col("b"), 0.2)).alias("m", "x"))
    return out.select("vec_id", (F.col("m") + 1).cast("long").alias("member"), r("x", 6).alias("x"))


@query(
    "spread_limiter",
    """, s AS (SELECT *, avg(x + 1) OVER (PARTITION BY vec_id) AS m, stddev_samp(x + 1) OVER (PARTITION BY vec_id) AS sd FROM v_ens)
SELECT vec_id, member, round(CASE WHEN sd / m > 0.1 THEN m + (x + 1 - m) * 0.1 / (sd / m) ELSE x + 1 END, 6) AS x FROM s""".lstrip(),
    "v_ens",
)
def spread_limiter(spark, sf_dir):
    e = v_ens_array(spark, sf_dir).withColumn("ens", F.transform("ens", lambda x: x + 1))
    out = e.select("vec_id", F.posexplode(ens.limit_spread(F.col("ens"), 0.1)).alias("m", "x"))
    return out.select("vec_id", (F.col("m") + 1).cast("long").alias("member"), r("x", 6).alias("x"))


@query(
    "pooled_slope",
    """WITH e AS (SELECT vec_id, label AS elm, u.m AS member, embedding[u.m]::DOUBLE AS x, embedding[u.m + 10]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(1, 11)) AS m) u),
 d AS (SELECT elm, x - avg(x) OVER (PARTITION BY vec_id) AS dx, y - avg(y) OVER (PARTITION BY vec_id) AS dy FROM e) SELECT elm, round(coalesce(sum(dx * dy) / nullif(sum(dx * dx), 0), 0), 6) AS slope FROM d GROUP BY elm""",
)
def pooled_slope(spark, sf_dir):
    from .views import table

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("elm"), F.arrays_zip(F.slice("embedding", 1, 10).alias("x"), F.slice("embedding", 11, 10).alias("y")).alias("p"))
    m = e.select("vec_id", "elm", F.explode("p").alias("p")).select("vec_id", "elm", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    return stats.pooled_slope(m, ["vec_id"], ["elm"], "x", "y").select("elm", r("slope", 6).alias("slope"))


SINGLE = """, p AS (SELECT vec_id, member, x, avg(x) OVER (PARTITION BY vec_id) AS m, elm / 10.0::DOUBLE - avg(x) OVER (PARTITION BY vec_id) AS d FROM v_ens),
 q AS (SELECT *, x - m AS y, sum((x - m) * (x - m)) OVER (PARTITION BY vec_id) AS yy FROM p) """.lstrip()


@query("transform_single_weights", SINGLE + "SELECT vec_id, member, round(y * d / (0.5::DOUBLE * 9 / 1.2 + yy), 7) AS w FROM q", "v_ens")
def transform_single_weights(spark, sf_dir):
    e = v_ens_array(spark, sf_dir)
    d, y = ens.observation_departure(F.col("elm") / 10, F.col("ens"))
    rows = e.select("vec_id", d.alias("d"), F.posexplode(y).alias("m", "y")).withColumn("r", F.lit(0.5))
    return ens.single_obs_weights(rows, ["vec_id"], "y", "d", "r", 1.2).select("vec_id", (F.col("m") + 1).cast("long").alias("member"), r("w", 7).alias("w"))


@query(
    "transform_single_analysis",
    SINGLE
    + """, c AS (SELECT *, 9 / 1.2::DOUBLE AS c FROM q)
SELECT vec_id, member, round(m + yy * d / (0.5 * c + yy) + sqrt(9.0::DOUBLE) * y / sqrt(c + yy / 0.5), 6) AS x FROM c""",
    "v_ens",
)
def transform_single_analysis(spark, sf_dir):
    """The general transform on one observation of the ensemble itself; the closed form is its oracle."""
    e = v_ens_array(spark, sf_dir)
    d, y = ens.observation_departure(F.col("elm") / 10, F.col("ens"))
    pairs = e.select(F.col("vec_id").alias("cell"), y.alias("y"), d.alias("d"), F.lit(0.5).alias("r"))
    out = ens.analyse(pairs, e.select(F.col("vec_id").alias("cell"), F.col("ens").alias("x")), rho=1.2)
    return out.select(F.col("cell").alias("vec_id"), F.posexplode("x").alias("m", "x")).select("vec_id", (F.col("m") + 1).cast("long").alias("member"), r("x", 6).alias("x"))


def _local_pairs(spark, sf_dir):
    """Observations near each target, with an ensemble made of the embeddings in turn, all of them, by observation id."""
    p = joins.local_observations(v_grid(spark, sf_dir), v_site(spark, sf_dir).withColumn("err", 1 + (F.col("obs_id") % 5) * 0.25), 3.0, 20.0, 2, criterion=2)
    e = v_ens_array(spark, sf_dir).select(F.col("vec_id").alias("key"), ens.perturbations(F.col("ens")).alias("y"))
    n = e.count()
    p = p.select("cell", "obs_id", "dat", "err", "weight", (F.col("obs_id") % F.lit(n)).alias("key"))
    return p.join(e, "key").withColumn("d", (F.col("dat") - 1000) / 1000).withColumn("r", F.col("err") * F.col("err") / F.col("weight"))


@query("transform_local_analysis")
def transform_local_analysis(spark, sf_dir):
    """Local search, top k and transform together; the eigenproblem has no SQL, tests compare with a direct solve."""
    pairs = _local_pairs(spark, sf_dir)
    back = v_ens_array(spark, sf_dir).select(F.col("vec_id").alias("cell"), F.col("ens").alias("x")).join(v_grid(spark, sf_dir).select("cell"), "cell")
    out = ens.analyse(pairs, back, rho=1.1, relax=0.2)
    return out.select("cell", r(ens.array_mean(F.col("x")), 6).alias("mean"), F.size("x").alias("members"))


@query("transform_relax_spread")
def transform_relax_spread(spark, sf_dir):
    pairs = _local_pairs(spark, sf_dir)
    back = v_ens_array(spark, sf_dir).select(F.col("vec_id").alias("cell"), F.col("ens").alias("x")).join(v_grid(spark, sf_dir).select("cell"), "cell")
    out = ens.analyse(pairs, back, rho=1.1, relax_spread=0.9)
    m = ens.array_mean(F.col("x"))
    sd = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (F.size("x") - 1))
    return out.select("cell", r(m, 6).alias("mean"), r(sd, 6).alias("spread"))


@query("serial_filter_analysis", SINGLE + "SELECT vec_id, round(m + yy * d / (0.5::DOUBLE * 9 + yy), 6) AS mean, round(sqrt(yy / 9 * 0.5 / (yy / 9 + 0.5)), 6) AS spread FROM q WHERE member = 1", "v_ens")
def serial_filter_analysis(spark, sf_dir):
    """One observation of the ensemble itself: mean and spread of the scalar filter."""
    e = v_ens_array(spark, sf_dir)
    d, y = ens.observation_departure(F.col("elm") / 10, F.col("ens"))
    pairs = e.select(F.col("vec_id").alias("cell"), y.alias("y"), d.alias("d"), F.lit(0.5).alias("r"))
    out = ens.analyse(pairs, e.select(F.col("vec_id").alias("cell"), F.col("ens").alias("x")), serial=True)
    m = ens.array_mean(F.col("x"))
    sd = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (F.size("x") - 1))
    return out.select(F.col("cell").alias("vec_id"), r(m, 6).alias("mean"), r(sd, 6).alias("spread"))


@query("parameter_estimation")
def parameter_estimation(spark, sf_dir):
    """Global transform of two parameters by all observations; only the members' cross products leave the executors."""
    e = v_ens_array(spark, sf_dir)
    d, y = ens.observation_departure(F.col("elm") / 10, F.col("ens"))
    obs = e.select(y.alias("y"), d.alias("d"), F.lit(0.5).alias("r"))
    parameters = e.filter("vec_id < 2").select(F.concat(F.lit("p"), F.col("vec_id")).alias("name"), F.col("ens").alias("x"))
    out = ens.global_transform(obs, parameters)
    return out.select("name", F.posexplode("x").alias("member", "x")).select("name", "member", r("x", 6).alias("x"))


@query(
    "observation_impact",
    """, p AS (SELECT g.cell, s.obs_id, s.dat, 1 + (s.obs_id % 5) * 0.25 AS err, ((g.x - s.x)**2 + (g.y - s.y)**2) / 9.0 + ((g.lev - s.lev) / 20.0)**2 AS nd, s.ctype FROM v_grid g JOIN v_site s ON sqrt((g.x - s.x)**2 + (g.y - s.y)**2) <= 3.0 * 2 * sqrt(10.0::DOUBLE / 3.0::DOUBLE)),
 k AS (SELECT *, (dat - 1000) / 1000 AS d, err * err / exp(-0.5 * nd) AS r FROM (SELECT *, row_number() OVER (PARTITION BY cell, ctype ORDER BY round(nd, 9), obs_id) AS o FROM p WHERE nd <= 40.0 / 3.0 + 1e-9) WHERE o <= 2),
 y AS (SELECT vec_id, member, x - avg(x) OVER (PARTITION BY vec_id) AS y FROM v_ens)
SELECT k.obs_id, round(sum(d / r * a.y * b.y * (k.cell % 7 - 3) / 9.0), 6) AS impact FROM k JOIN y a ON a.vec_id = k.obs_id % (SELECT count(*) FROM embeddings) JOIN y b ON b.vec_id = k.cell AND b.member = a.member GROUP BY 1""".lstrip(),
    "v_grid v_site v_ens",
)
def observation_impact(spark, sf_dir):
    f = v_ens_array(spark, sf_dir).select(F.col("vec_id").alias("cell"), ens.perturbations(F.col("ens")).alias("f")).withColumn("e", (F.col("cell") % 7 - 3).cast("double"))
    return ens.observation_impact(_local_pairs(spark, sf_dir).select("cell", "obs_id", "y", "d", "r"), f).select("obs_id", r("impact", 6).alias("impact"))


@query("boundary_weight", "SELECT cell, round(greatest(0, least(1, least(x, 100 - x, y, 100 - y) / 12.0::DOUBLE)), 6) AS w FROM v_grid", "v_grid")
def boundary_weight(spark, sf_dir):
    return v_grid(spark, sf_dir).select("cell", r(ens.boundary_weight(F.col("x"), F.col("y"), 100.0, 100.0, 12.0), 6).alias("w"))


@query("synthetic_observations")
def synthetic_observations(spark, sf_dir):
    """Observation-space values plus seeded normal errors; random numbers have no SQL, tests check their moments."""
    e = v_ens_array(spark, sf_dir)
    return e.select("vec_id", ens.array_mean(F.col("ens")).alias("hx"), (ens.array_mean(F.col("ens")) + 0.1 * ens.normal(7, "vec_id")).alias("obs"))


@query("member_shuffle")
def member_shuffle(spark, sf_dir):
    """A random permutation of the members (a few rows) with a seed."""
    from pyspark.sql import Window

    members = spark.range(1, 11).select(F.col("id").alias("member"))
    return members.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("member", F.lit(7)))))


#: Of each cell the nearest observation, first by distance, then by number, within three times ten thirds' root.
_NEAREST = """, q AS (SELECT g.cell, s.obs_id, sqrt((g.x - s.x)**2 + (g.y - s.y)**2) AS dist, (s.dat - 1000) / 1000 - m.m AS d, (1 + (s.obs_id % 5) * 0.25::DOUBLE)**2 AS r FROM v_grid g JOIN v_site s ON sqrt((g.x - s.x)**2 + (g.y - s.y)**2) <= 12
   JOIN (SELECT vec_id, avg(x) AS m FROM v_ens GROUP BY vec_id) m ON m.vec_id = s.obs_id % (SELECT count(*) FROM embeddings)),
 o AS (SELECT *, dist / 6.5::DOUBLE AS z FROM q QUALIFY row_number() OVER (PARTITION BY cell ORDER BY dist, obs_id) = 1),
 t AS (SELECT *, CASE WHEN z <= 1 THEN ((((-0.25 * z + 0.5) * z + 0.625) * z - 5.0::DOUBLE / 3) * z * z) + 1 ELSE ((((z / 12 - 0.5) * z + 0.625) * z + 5.0::DOUBLE / 3) * z - 5) * z + 4 - 2 / (3 * z) END AS taper FROM o),
 p AS (SELECT vec_id, member, x, x - avg(x) OVER (PARTITION BY vec_id) AS y FROM v_ens),
 c AS (SELECT t.cell, any_value(d) AS d, any_value(r) AS r, any_value(taper) * sum(a.y * b.y) / 9 AS pxy, sum(b.y * b.y) / 9 AS pyy, avg(a.x) AS mean, sum(a.y * a.y) / 9 AS pxx
   FROM t JOIN p a ON a.vec_id = t.cell JOIN p b ON b.vec_id = t.obs_id % (SELECT count(*) FROM embeddings) AND b.member = a.member GROUP BY t.cell)""".lstrip()


def _nearest(spark, sf_dir, k: int):
    """(cell, obs_id, ox, oy, dist, y, d, r) of the k nearest observations of each cell, and the cells' members."""
    e = v_ens_array(spark, sf_dir)
    sites = v_site(spark, sf_dir).select("obs_id", "x", "y", F.col("x").alias("ox"), F.col("y").alias("oy"), "dat")
    near = joins.nearest(v_grid(spark, sf_dir), sites, k, 12.0)
    own = e.select(F.col("vec_id").alias("key"), ens.perturbations(F.col("ens")).alias("y"), ens.array_mean(F.col("ens")).alias("m"))
    met = near.select("cell", "obs_id", "ox", "oy", "dist", "dat", (F.col("obs_id") % e.count()).alias("key")).join(own, "key")
    error = 1 + (F.col("obs_id") % 5) * 0.25
    pairs = met.select("cell", "obs_id", "ox", "oy", "dist", "y", ((F.col("dat") - 1000) / 1000 - F.col("m")).alias("d"), (error * error).alias("r"))
    back = e.select(F.col("vec_id").alias("cell"), F.col("ens").alias("x")).join(v_grid(spark, sf_dir).select("cell"), "cell")
    return pairs, back


def _moments(out):
    m = ens.array_mean(F.col("x"))
    sd = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (F.size("x") - 1))
    return out.select("cell", r(m, 6).alias("mean"), r(sd, 6).alias("spread"))


@query(
    "covariance_localised_single",
    _NEAREST
    + """ SELECT cell, round(mean + pxy / (pyy + r) * d, 6) AS mean, round(sqrt(pxx - 2 * k * pxy0 + k * k * pyy), 6) AS spread
FROM (SELECT c.*, pxy / (pyy + r) / (1 + sqrt(r / (pyy + r))) AS k, t0.pxy0 FROM c JOIN (SELECT t.cell, sum(a.y * b.y) / 9 AS pxy0 FROM t JOIN p a ON a.vec_id = t.cell JOIN p b ON b.vec_id = t.obs_id % (SELECT count(*) FROM embeddings) AND b.member = a.member GROUP BY t.cell) t0 ON t0.cell = c.cell)
UNION ALL SELECT vec_id, round(avg(v.x), 6), round(stddev_samp(v.x), 6) FROM v_ens v JOIN v_grid g ON g.cell = vec_id WHERE vec_id NOT IN (SELECT cell FROM c) GROUP BY vec_id""",
    "v_grid v_site v_ens",
)
def covariance_localised_single(spark, sf_dir):
    """The nearest observation of each cell: the gain of the tapered covariance, in closed form in SQL."""
    return _moments(kalman.localised_analysis(*_nearest(spark, sf_dir, 1), 6.5))


@query("covariance_localised_analysis")
def covariance_localised_analysis(spark, sf_dir):
    """Up to eight observations a cell with perturbed observations; tests compare with a dense solve."""
    return _moments(kalman.localised_analysis(*_nearest(spark, sf_dir, 8), 6.5, seed=11))


@query("patch_analysis")
def patch_analysis(spark, sf_dir):
    """Two variables of each cell, analysed together in the basis of their covariance; tests compare with the transform filter."""
    pairs, back = _nearest(spark, sf_dir, 8)
    both = back.select("cell", F.lit("a").alias("var"), "x").unionByName(back.select("cell", F.lit("b").alias("var"), F.transform("x", lambda v: v * v).alias("x")))
    out = kalman.patch_analysis(pairs, both, inflation=0.02)
    return out.select("cell", "var", r(ens.array_mean(F.col("x")), 6).alias("mean"))
